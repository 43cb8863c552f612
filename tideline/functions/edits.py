"""Edits of UTF-8 text by byte ranges: canonical order, overlap, application."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True, order=True)
class Edit:
    """Replace bytes [start, end) by new_text."""

    start: int
    end: int
    new_text: str


def canonical(edits: list[Edit]) -> list[Edit]:
    return sorted(edits)


def check(edits: list[Edit], size: int | None = None) -> None:
    """ValueError unless the ranges are proper, in canonical order and free of overlap."""
    before = 0
    for e in edits:
        if e.start < 0 or e.end < e.start or size is not None and e.end > size:
            raise ValueError(f"not a range: {e.start}-{e.end}")
        if e.start < before:
            raise ValueError(f"edits overlap or are out of order at {e.start}")
        before = max(before, e.end)


def on_boundary(data: bytes, at: int) -> bool:
    """Whether a position stands between two characters."""
    return 0 <= at <= len(data) and (at == len(data) or data[at] & 0xC0 != 0x80)


def apply(text: str, edits: list[Edit]) -> str:
    data = text.encode()
    edits = canonical(edits)
    check(edits, len(data))
    if not all(on_boundary(data, p) for e in edits for p in (e.start, e.end)):
        raise ValueError("an edit cuts a character")
    out, at = [], 0
    for e in edits:
        out += [data[at : e.start], e.new_text.encode()]
        at = e.end
    return b"".join([*out, data[at:]]).decode()
