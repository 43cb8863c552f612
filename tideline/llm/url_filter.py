"""URL filters: rules in a sorted, memory-mapped array of 64-bit xxhash keys, probed by vectorised binary search.

A rule is a host, a path and a verdict; it fits the urls of its host and all subdomains whose path starts with the
rule's. The rules' digests lie sorted in one file beside their strings. For each url the digests of its host's suffixes
are looked up first, then, for the suffixes that some rule has, the digests of suffix + path prefix at the path lengths
of that host's rules. Every hit is confirmed against the stored string, so a collision of digests changes nothing. The
longest rule (bytes of host and path) wins; of equally long ones that with the longer host, then block.

The file goes to the executors through Spark's file server and is mapped there, not loaded, so a list of any size takes
no more of their memory than the pages it touches. The driver sorts the list once, in memory, to write the file.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end.
Cases: null, empty or without `://`: both empty, no rule, the default verdict. Repeated rows are judged alike, one row
each; an empty table gives an empty table; an empty rule list gives the default verdict; other columns are not read. A very
long url is judged whole.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from tideline.llm._common import pick, scratch


def _digest(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


def write_rules(rules: Iterable[tuple[str, str, str]], path: str) -> None:
    """Write (host, path, allow or block) rules as one file: host digests, rule digests, strings. Repeats count once."""
    kept = sorted({(h.encode(), p.encode(), v) for h, p, v in rules if h}, key=lambda r: (_digest(r[0] + r[1]), r))
    if bad := {v for *_, v in kept} - {"allow", "block"}:
        raise ValueError(f"verdicts are allow and block, not {sorted(bad)}")
    text = [h + p for h, p, _ in kept]
    hosts: dict[bytes, set[int]] = {}
    for h, p, _ in kept:
        hosts.setdefault(h, set()).add(len(p))
    by_host = sorted(hosts, key=lambda h: (_digest(h), h))
    parts = {
        "key": np.array([_digest(t) for t in text], np.uint64), "at": np.cumsum([0, *map(len, text)]).astype(np.int64),
        "host_len": np.array([len(h) for h, *_ in kept], np.int64), "block": np.array([v == "block" for *_, v in kept], np.uint8),
        "host_key": np.array([_digest(h) for h in by_host], np.uint64), "host_at": np.cumsum([0, *map(len, by_host)]).astype(np.int64),
        "sizes_at": np.cumsum([0, *(len(hosts[h]) for h in by_host)]).astype(np.int64), "sizes": np.array([n for h in by_host for n in sorted(hosts[h])], np.int64),
        "text": np.frombuffer(b"".join(text), np.uint8), "host_text": np.frombuffer(b"".join(by_host), np.uint8),
    }
    head, at = {}, 0
    for name, x in parts.items():
        head[name] = (at, len(x), x.dtype.str)
        at += -(-x.nbytes // 8) * 8
    line = json.dumps(head).encode()
    with open(path, "wb") as f:
        f.write(len(line).to_bytes(8, "little") + line + b" " * (-len(line) % 8))
        for x in parts.values():
            f.write(x.tobytes() + b"\0" * (-x.nbytes % 8))


class Rules:
    """A rules file, memory-mapped."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int.from_bytes(bytes(raw[:8]), "little")
        base = 8 + n + (-n % 8)
        for name, (at, size, kind) in json.loads(bytes(raw[8 : 8 + n])).items():
            kind = np.dtype(kind)
            setattr(self, name, raw[base + at : base + at + size * kind.itemsize].view(kind))

    @staticmethod
    def _find(keys, at, text, wanted: list[bytes]) -> np.ndarray:
        """Place of each wanted string, or -1: binary search for all digests at once, then the strings are compared."""
        digests = np.array([_digest(w) for w in wanted], np.uint64)
        place = np.searchsorted(keys, digests)
        out = np.full(len(wanted), -1)
        left = np.flatnonzero(place < len(keys))
        left = left[keys[place[left]] == digests[left]]
        while len(left):
            more = []
            for k in left:
                p = place[k]
                if bytes(text[at[p] : at[p + 1]]) == wanted[k]:
                    out[k] = p
                elif p + 1 < len(keys) and keys[p + 1] == digests[k]:
                    place[k] += 1
                    more.append(k)
            left = np.array(more, int)
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> list[int]:
        """The winning rule of each (host, path), or -1."""
        best: list[tuple] = [()] * len(hosts)
        if not len(self.key):
            return [-1] * len(hosts)
        tails, which = [], []  # the different host suffixes, and each host's
        seen: dict[bytes, int] = {}
        for h in hosts:
            host, own = h.encode(), []
            cut = 0
            while host and cut >= 0:
                tail = host[cut:]
                if tail not in seen:
                    seen[tail] = len(tails)
                    tails.append(tail)
                own.append(seen[tail])
                dot = host.find(b".", cut)
                cut = dot + 1 if dot >= 0 else -1
            which.append(own)
        known = self._find(self.host_key, self.host_at, self.host_text, tails) if tails else np.zeros(0, int)
        wanted, who = [], []
        for k, own in enumerate(which):
            path = None
            for t in own:
                if known[t] >= 0:
                    path = paths[k].encode() if path is None else path
                    for size in self.sizes[self.sizes_at[known[t]] : self.sizes_at[known[t] + 1]]:
                        if size <= len(path):
                            wanted.append(tails[t] + path[:size])
                            who.append((k, len(tails[t])))
        if wanted:
            for (k, host_len), p in zip(who, self._find(self.key, self.at, self.text, wanted)):
                # the same string may stand for different hosts only if a host holds "/"; such rules never fit a url
                while p >= 0 and p < len(self.key):
                    if self.host_len[p] == host_len:
                        best[k] = max(best[k], (int(self.at[p + 1] - self.at[p]), host_len, int(self.block[p]), int(p)))
                    same = p + 1 < len(self.key) and self.key[p + 1] == self.key[p] and bytes(self.text[self.at[p + 1] : self.at[p + 2]]) == bytes(self.text[self.at[p] : self.at[p + 1]])
                    p = p + 1 if same else -1
        return [b[3] if b else -1 for b in best]


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule (host and path of the winning rule, or null) and verdict for every row."""
    data = pick(pages, id=id_col, url=url_col)
    name = f"rules-{uuid.uuid4().hex}"
    path = os.path.join(scratch(), name)
    write_rules(rules, path)
    data.sparkSession.sparkContext.addFile(path)

    def run(batches):
        found = Rules(SparkFiles.get(name))
        for batch in batches:
            parts = pc.extract_regex(batch.column(1).fill_null(""), r"^(?s:.*?)://(?P<host>[^/?#]*)(?P<path>[^?#]*)")
            host = pc.ascii_lower(pc.struct_field(parts, "host").fill_null(""))
            path = pc.struct_field(parts, "path").fill_null("")
            won = found.judge(host.to_pylist(), path.to_pylist())
            rule = [bytes(found.text[found.at[p] : found.at[p + 1]]).decode() if p >= 0 else None for p in won]
            verdict = [default if p < 0 else "block" if found.block[p] else "allow" for p in won]
            yield pa.RecordBatch.from_arrays([batch.column(0), host.cast(pa.string()), path.cast(pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"])

    return data.mapInArrow(run, f"id {data.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
