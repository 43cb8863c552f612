"""Suffix-array dedup: remove bytes that a `length`-byte string covers which a document with a smaller id also holds.

The deciding structure is a collection's Burrows-Wheeler transform with its common prefixes, built column by column:
each round inserts one symbol of every document, from the last to the first, and updates transform and common prefixes
by one sequential pass over files of the round before. Runs of suffixes whose common prefix reaches `length` are the
places of one string; all of them but those in the smallest document are marked.

Rounds rewrite the whole transform, so its cost is symbols times the longest document. The construction is therefore
given short documents, and only those where something is to be decided, which three exact steps find:

1. Every `length`-byte string is assigned to its minimiser, the 20-byte string inside it with the least hash. Strings in
   a row with the same minimiser form a span (at most 31 strings). Equal strings have equal minimisers, so a match is
   always between spans of one minimiser.
2. Equal spans collapse: spans are grouped by minimiser and by their own hash (128 bits together), each unit of
   documents sending a span once with its smallest document. A span that a smaller document has is removed whole; one
   whose minimiser only this text has is kept.
3. Spans of one minimiser that differ in text but come from different documents are the collection's documents, one of
   each text. A pair can share a string only if the 35 bytes left or right from a minimiser on agree; spans that share
   neither with another are left out. A minimiser with over `HOT` different spans is split by longer minimisers first.

Units are documents by hash, a few MB each; spans travel in one packed row for each unit and bucket of hashes, and the
answer is a byte for each span sent. Shuffles that are no longer read are given back before the next step.

Equal spans are told by 128 bits (64 of the minimiser, 64 of the span) without comparing bytes: both hashes are polynomials
modulo 2 ** 64, and the strings known to confuse such (2,048 bytes and more) are longer than any span.

Cases: ids are integers; null text is empty; rows with a null id lose nothing and count for no other row; rows that
repeat an id are one document, so they lose nothing to each other. Texts shorter than `length` bytes lose nothing. An
empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import _bytes as B
from tideline.llm._common import discard, pick, save

SHORT = 20
LONGER = 38
HOT = 256
UNIT_BYTES = 4 << 20
BUCKET_SPANS = 250_000
COLLECTION_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _power(n: int) -> np.uint64:
    return _U(pow(_BASE, n, 1 << 64))


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-byte string of buf, by doubling."""
    if len(buf) < k:
        return np.zeros(0, _U)
    doubled = {1: buf.astype(_U) + _U(1)}
    size = 1
    while 2 * size <= k:
        a = doubled[size]
        doubled[2 * size] = a[:-size] * _power(size) + a[size:]
        size *= 2
    out, done = doubled[size], size
    for step in sorted(doubled, reverse=True):
        if done + step <= k and (k - done) & step:
            n = len(buf) - done - step + 1
            out = out[:n] * _power(step) + doubled[step][done : done + n]
            done += step
    return B.mix(out)


def spans(buf: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """Spans of every text: first string's start, number of strings, and the minimiser's hash, mixed anew: as the least
    of several it is small, and by its leading bits most spans would fall into the first buckets."""
    w = length - k + 1
    low = gram_hashes(buf, k)
    if len(buf) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    reach = 1
    while 2 * reach <= w:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < w:
        low = np.minimum(low[: len(low) - (w - reach)], low[w - reach :])
    n = len(low)
    valid = np.zeros(n + 1, np.int64)  # starts whose string ends inside its text
    size = np.diff(offsets)
    fits = size >= length
    np.add.at(valid, offsets[:-1][fits], 1)
    np.add.at(valid, np.minimum(offsets[1:][fits] - length + 1, n), -1)
    ok = np.cumsum(valid[:n]) > 0
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    fresh = edge[:n].copy()
    fresh[0] = True
    fresh[1:] |= (low[1:] != low[:-1]) | ~ok[:-1]
    start = np.flatnonzero(fresh & ok)
    last = np.ones(n, bool)
    last[:-1] = fresh[1:] | ~ok[1:]
    count = np.flatnonzero(last & ok) - start + 1
    if (count > w).any():  # repetitive text: cut from the span's start
        pieces = -(-count // w)
        at = B.ranges(np.zeros(len(count), np.int64), pieces) * w
        count = np.minimum(w, np.repeat(count, pieces) - at)
        start = np.repeat(start, pieces) + at
    return start, count, B.mix(low[start])


def _order(key: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """The order by all three; the last two are looked at only where the key repeats."""
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    again = np.flatnonzero(same[1:] | same[:-1])
    some = order[again]
    order[again] = some[np.lexsort((third[some], second[some], key[some]))]
    return order


def _release() -> None:
    """Give memory that a group no longer needs back to the system, so that an executor's workers stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


class Unit:
    """The spans of a unit's documents: row, place, minimiser, own hash; and the different (minimiser, hash) pairs."""

    def __init__(self, ids: np.ndarray, column: pa.Array, length: int):
        self.buf, self.offsets = B.texts(column)
        self.length = length
        rows, starts, counts, keys, own = [], [], [], [], []
        for i, j in B.chunks(self.offsets, 1 << 20):
            part, at = self.buf[self.offsets[i] : self.offsets[j]], self.offsets[i : j + 1] - self.offsets[i]
            start, count, key = spans(part, at, length, SHORT)
            row = np.searchsorted(at, start, "right") - 1
            rows.append(row + i)
            starts.append(start - at[row])
            counts.append(count)
            keys.append(key)
            own.append(B.hashes(part, start, start + count + length - 1))
        cat = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
        self.row, self.start, self.count, key, own = cat(rows, np.int64), cat(starts, np.int64), cat(counts, np.int64), cat(keys, _U), cat(own, _U)
        self.id = ids[self.row]
        order = _order(key, own, self.id)
        key, own = key[order], own[order]
        head = np.ones(len(key), bool)
        head[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        self.entry = np.empty(len(key), np.int64)
        self.entry[order] = np.cumsum(head) - 1
        self.key, self.own, self.least = key[head], own[head], self.id[order][head]

    def buckets(self, n: int):
        """Bounds of the entries of each bucket, of n (a power of two), by the minimiser's leading bits."""
        bits = n.bit_length() - 1
        return np.searchsorted(self.key >> _U(64 - bits), np.arange(n + 1, dtype=_U)) if bits else np.array([0, len(self.key)])


def _planes(x: np.ndarray) -> bytes:
    """Bytes of like weight together, so that the shuffle's compression finds the zeros."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def judge_bucket(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each unit's (minimiser, own hash, smallest id) arrays of a bucket a code for each entry: 1 a smaller document
    has the span; 2 this unit's smallest document is the span's, and other spans of its minimiser come from other
    documents; 3 as 2, and there are over HOT of them; 0 nothing to do."""
    key, own, least = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = _order(key, own, least)
    k, o, d = key[order], own[order], least[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    first = head.copy()
    first[1:] |= o[1:] != o[:-1]
    span, group = np.cumsum(first) - 1, np.cumsum(head) - 1
    smallest = d[first]  # of each different span
    of = group[first]
    at = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, int)
    kinds = np.bincount(of)
    apart = np.minimum.reduceat(smallest, at) < np.maximum.reduceat(smallest, at) if len(at) else np.zeros(0, bool)
    code = np.where(d > smallest[span], 1, np.where(apart[group], np.where(kinds[group] > HOT, 3, 2), 0)).astype(np.uint8)
    out = np.empty(len(code), np.uint8)
    out[order] = code
    return np.split(out, np.cumsum([len(p[0]) for p in parts])[:-1])


class Collection:
    """Burrows-Wheeler transform and common prefixes of some strings, built a symbol of each string a round.

    Between rounds the suffixes seen so far lie in order in one file of `folder`, 8 bytes each: the symbol before the
    suffix (8 bits, 0 for none), its common prefix with the suffix before it (11), its length (11) and its string (32).
    A round reads the file once from front to back, merges every string's next longer suffix in, and writes the next.
    Strings are UTF-8 (no byte 255) of fewer than 2,048 bytes.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, folder: str):
        self.data, self.bounds, self.folder, self.round = data, bounds, Path(folder), 0
        m = len(bounds) - 1
        self.m, self.sizes = m, np.diff(bounds)
        if m and self.sizes.max() >= 2048:
            raise ValueError("a string of a collection has 2,047 bytes at most")
        self.at = np.arange(m)  # place of each string's longest suffix so far
        self.files = [open(self.folder / f"suffixes.{k}", "w+b", buffering=0) for k in (0, 1)]
        self.room, self.next_room = np.empty(m + len(data), _U), np.empty(m + len(data), _U)
        self._write(self._pack(self._symbol(np.arange(m), 1), 0, 0, np.arange(m)))

    @staticmethod
    def _pack(symbol, common, size, string) -> np.ndarray:
        return symbol.astype(_U) | _U(common << 8) | _U(size << 19) | string.astype(_U) << _U(30)

    def _symbol(self, strings: np.ndarray, n: int) -> np.ndarray:
        """The n-th symbol from the end, from 1; 0 if there is none."""
        there = self.sizes[strings] >= n
        return np.where(there, self.data[np.where(there, self.bounds[strings + 1] - n, 0)].astype(np.int64) + 1, 0)

    def _write(self, rows: np.ndarray) -> None:
        file, data = self.files[self.round % 2], memoryview(rows).cast("B") if len(rows) else b""
        file.seek(0)
        while data:
            data = data[file.write(data) :]
        self.n = len(rows)

    def _read(self) -> np.ndarray:
        file, rows = self.files[self.round % 2], self.room[: self.n]
        data = memoryview(rows).cast("B") if self.n else b""
        file.seek(0)
        while data:
            data = data[file.readinto(data) :]
        return rows

    def insert(self) -> None:
        """One round: every string's next symbol."""
        old, m = self._read(), self.m
        symbol = old.astype(np.uint8)
        # suffixes that begin with a symbol stand in the order of the suffixes they continue
        order = np.argsort(symbol, kind="stable")[len(symbol) - np.count_nonzero(symbol) :]
        new_at = np.zeros(len(symbol), bool)
        new_at[self.at[self.sizes > self.round]] = True
        fresh = np.flatnonzero(new_at[order])
        who = (old[order[fresh]] >> _U(30)).astype(np.int64)
        rows = self.next_room[: m + len(order)]
        is_old = np.ones(len(rows), bool)
        is_old[m + fresh] = False
        rows[is_old] = old
        rows[m + fresh] = self._pack(self._symbol(who, self.round + 2), 0, self.round + 1, who)
        # a common prefix is one more than the least between the two continued suffixes
        touched = np.zeros(len(order) + 1, bool)
        touched[fresh] = touched[fresh + 1] = True
        k = np.flatnonzero(touched[:-1])
        second = order[k]
        first = order[np.maximum(k - 1, 0)]
        same = (k > 0) & (symbol[second] == symbol[first])
        common = np.zeros(len(k), _U)
        if same.any():
            before = np.append((old >> _U(8)).astype(np.uint16) & np.uint16(2047), np.uint16(0))
            common[same] = np.minimum.reduceat(before, np.column_stack((first[same] + 1, second[same] + 1)).reshape(-1))[::2] + 1
        rows[m + k] = (rows[m + k] & ~_U(2047 << 8)) | common << _U(8)
        self.at[who] = m + fresh
        self.round += 1
        self._write(rows)

    def build(self) -> dict:
        """All rounds; the suffixes' strings, lengths and common prefixes, in order."""
        for _ in range(int(self.sizes.max(initial=0))):
            self.insert()
        rows = self._read()
        for file in self.files:
            file.close()
        return {"string": (rows >> _U(30)).astype(np.int64), "size": (rows >> _U(19)).astype(np.int64) & 2047, "common": (rows >> _U(8)).astype(np.int64) & 2047}


def repeated(data: np.ndarray, bounds: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of every `length`-byte string that a string with a smaller id also holds."""
    with tempfile.TemporaryDirectory() as folder:
        done = Collection(data, bounds, folder).build()
    head = done["common"] < length
    run = np.cumsum(head) - 1
    own = ids[done["string"]]
    least = np.minimum.reduceat(own, np.flatnonzero(head)) if len(own) else own
    marked = np.flatnonzero((done["size"] >= length) & (own > least[run]))
    string = done["string"][marked]
    return string, (bounds[string + 1] - bounds[string]) - done["size"][marked]


def candidates(data: np.ndarray, bounds: np.ndarray, keys: np.ndarray, k: int, length: int) -> np.ndarray:
    """Which strings may share a `length`-byte string with another: those with the same bytes as another from half the
    free length left of a minimiser to its end, or from its start to half the free length right of it."""
    half = (length - k) // 2
    keep = np.zeros(len(keys), bool)
    if not len(keys):
        return keep
    hashed = gram_hashes(data, k)
    string = np.repeat(np.arange(len(keys)), np.diff(bounds))[: len(hashed)]
    at = np.flatnonzero(B.mix(hashed) == keys[string])
    s = string[at]
    at, s = (x[at + k <= bounds[s + 1]] for x in (at, s))
    left, right = at - half >= bounds[s], at + k + half <= bounds[s + 1]
    begin = np.concatenate((at[left] - half, at[right]))
    who = np.concatenate((s[left], s[right]))
    side = np.repeat(np.array([1, 2], _U), (left.sum(), right.sum()))
    context = gram_hashes(data, k + half)[begin] ^ B.mix(keys[who] + side)
    context, which = np.unique(context, return_inverse=True)
    pairs = np.unique(np.column_stack((which, who)), axis=0)
    shared = np.bincount(pairs[:, 0], minlength=len(context)) > 1
    keep[pairs[shared[pairs[:, 0]], 1]] = True
    return keep


def _give_back(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referred to. The first round frees what Python held
    in the JVM, the second what that held; the cleaner works beside, so it gets a moment."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def _merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Union of byte ranges of each row, which come in order of row and start: (row, start, stop)."""
    if not len(row):
        return row, start, stop
    reach = np.maximum.accumulate(stop + row * (int(stop.max()) + 1)) - row * (int(stop.max()) + 1)
    head = np.ones(len(row), bool)
    head[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
    last = np.append(np.flatnonzero(head)[1:] - 1, len(row) - 1)
    return row[head], start[head], reach[last]


_FOUND = "kind int, key long, id long, version long, ranges binary, text binary"


def _found(kind, key, ids, version, ranges, text) -> pa.Table:
    n = len(ids)
    fill = lambda x, t: pa.array(x, t) if x is not None else pa.nulls(n, t)
    return pa.table({"kind": pa.array(np.full(n, kind, np.int32)), "key": fill(key, pa.int64()), "id": pa.array(ids, pa.int64()), "version": pa.array(version, pa.int64()), "ranges": fill(ranges, pa.binary()), "text": fill(text, pa.binary())})


def _settle(unit: Unit, version: np.ndarray, code: np.ndarray) -> pa.Table:
    """What a unit knows once its spans are judged: ranges to remove (kind 0), and spans to compare by minimisers of
    SHORT or LONGER bytes (kind 1, 2), each text of a row once, with the places where it begins."""
    length, own = unit.length, code[unit.entry]
    gone = (unit.id > unit.least[unit.entry]) | (own == 1)
    order = np.lexsort((unit.start[gone], unit.row[gone]))
    row, start, stop = _merged(*(x[gone][order] for x in (unit.row, unit.start, unit.start + unit.count + length - 1)))
    heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, int)
    packed = np.column_stack((start, stop)).astype("<i8")
    tables = []
    ids_of = np.zeros(len(unit.offsets) - 1, np.int64)
    ids_of[unit.row] = unit.id
    ranges = [packed[a:b].tobytes() for a, b in zip(heads, np.append(heads[1:], len(row)))]
    tables.append(_found(0, None, ids_of[row[heads]], version[row[heads]], ranges, None))
    for kind in (2, 3):
        k = np.flatnonzero(~gone & (own == kind))
        k = k[np.lexsort((unit.start[k], unit.row[k], unit.entry[k]))]
        head = np.ones(len(k), bool)
        head[1:] = (unit.entry[k][1:] != unit.entry[k][:-1]) | (unit.row[k][1:] != unit.row[k][:-1])
        one = k[head]
        begin = unit.offsets[unit.row[one]] + unit.start[one]
        size = unit.count[one] + length - 1
        cuts = np.append(np.flatnonzero(head), len(k))
        places = [unit.start[k[a:b]] for a, b in zip(cuts, cuts[1:])]
        key = unit.key[unit.entry[one]]
        if kind == 3 and len(one):  # split by longer minimisers
            joined = unit.buf[B.ranges(begin, size)]
            bounds = np.concatenate(([0], np.cumsum(size)))
            s, n, key = spans(joined, bounds, length, LONGER)
            of = np.searchsorted(bounds, s, "right") - 1
            inner = s - bounds[of]
            begin, size, places, one = begin[of] + inner, n + length - 1, [places[o] + i for o, i in zip(of, inner)], one[of]
        text = [unit.buf[a : a + n].tobytes() for a, n in zip(begin, size)]
        tables.append(_found(kind - 1, key.view(np.int64), unit.id[one], version[unit.row[one]], [p.astype("<i8").tobytes() for p in places], text))
    return pa.concat_tables(tables)


def ranges(docs: DataFrame, length: int = 50) -> DataFrame:
    """(id, version, ranges): byte ranges to remove, several rows a document; docs has id (long), version, text."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units = max(1, -(-total // UNIT_BYTES))
    buckets = 1
    while buckets * BUCKET_SPANS < total // 16:
        buckets *= 2
    dealt = docs.withColumn("unit", F.pmod(F.xxhash64("id", "version"), F.lit(units)))

    def send(key, rows):
        unit = Unit(rows.column("id").to_numpy(), rows.column("text").combine_chunks(), length)
        cut = unit.buckets(buckets)
        some = np.flatnonzero(np.diff(cut))
        packed = [[_planes(x[cut[b] : cut[b + 1]]) for b in some] for x in (unit.key, unit.own, unit.least)]
        del unit
        _release()
        return pa.table({"unit": pa.array([key[0].as_py()] * len(some), pa.int64()), "bucket": pa.array(some, pa.int64()), **{n: pa.array(x, pa.binary()) for n, x in zip(("keys", "own", "least"), packed)}})

    def judge(key, rows):
        parts = [tuple(_unplanes(rows.column(n)[k].as_py(), t) for n, t in (("keys", _U), ("own", _U), ("least", np.int64))) for k in range(rows.num_rows)]
        codes = judge_bucket(parts)
        del parts
        _release()
        return pa.table({"unit": rows.column("unit"), "bucket": rows.column("bucket"), "code": pa.array([c.tobytes() for c in codes], pa.binary())})

    sent = dealt.select("unit", "id", "text").groupBy("unit").applyInArrow(send, "unit long, bucket long, keys binary, own binary, least binary")
    answers = save(sent.groupBy("bucket").applyInArrow(judge, "unit long, bucket long, code binary"), "answers")
    del sent
    _give_back(spark)

    def settle(key, rows, answers):
        unit = Unit(rows.column("id").to_numpy(), rows.column("text").combine_chunks(), length)
        answers = answers.sort_by("bucket")
        code = np.frombuffer(b"".join(answers.column("code").to_pylist()), np.uint8)
        out = _settle(unit, rows.column("version").to_numpy(), code)
        del unit, code
        _release()
        return out

    found = save(dealt.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(settle, _FOUND), "found")
    _give_back(spark)
    open_ = found.where("kind > 0").select("kind", "key", "id", "version", "ranges", "text")
    size = open_.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    collections = max(1, -(-size // COLLECTION_BYTES))

    def compare(key, rows):
        out = []
        kinds = rows.column("kind").to_numpy()
        for kind, k in ((1, SHORT), (2, LONGER)):
            part = rows.filter(pa.array(kinds == kind))
            data, bounds = B.texts(part.column("text").combine_chunks().cast(pa.binary()).view(pa.string()))
            kept = np.flatnonzero(candidates(data, bounds, part.column("key").to_numpy().view(_U), k, length))
            sizes = np.diff(bounds)[kept]
            data, bounds = data[B.ranges(bounds[kept], sizes)], np.concatenate(([0], np.cumsum(sizes)))
            string, inner = repeated(data, bounds, part.column("id").to_numpy()[kept], length)
            order = np.lexsort((inner, string))
            string, inner = string[order], inner[order]
            heads = np.flatnonzero(np.concatenate(([True], string[1:] != string[:-1]))) if len(string) else np.zeros(0, int)
            rows_of, packed = kept[string[heads]], []
            for r, a, b in zip(rows_of, heads, np.append(heads[1:], len(string))):
                places = np.frombuffer(part.column("ranges")[int(r)].as_py(), "<i8")
                start = np.sort((places[:, None] + inner[a:b][None, :]).reshape(-1))
                _, s, e = _merged(np.zeros(len(start), np.int64), start, start + length)
                packed.append(np.column_stack((s, e)).astype("<i8").tobytes())
            out.append(pa.table({"id": part.column("id").take(pa.array(rows_of)), "version": part.column("version").take(pa.array(rows_of)), "ranges": pa.array(packed, pa.binary())}))
        _release()
        return pa.concat_tables(out)

    more = open_.groupBy(F.pmod(F.xxhash64("key"), F.lit(collections)).alias("collection")).applyInArrow(compare, "id long, version long, ranges binary")
    out = save(found.where("kind = 0").select("id", "version", "ranges").unionByName(more), "ranges")
    discard(found)
    discard(answers)
    _give_back(spark)
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256 for every row."""
    data = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    data = data.withColumn("version", F.xxhash64("text"))
    gone = ranges(data.where("id is not null"), length).groupBy("id", "version").agg(F.collect_list("ranges").alias("ranges"))
    gone = gone.select(F.col("id").alias("gone_id"), F.col("version").alias("gone_version"), "ranges")
    both = data.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("version") == F.col("gone_version")), "left").select("id", "text", "ranges")

    def cut(batches):
        for batch in batches:
            buf, offsets = B.texts(batch.column(1))
            removed, count, kept, digest = [], [], [], []
            for k, found in enumerate(batch.column(2)):
                text = buf[offsets[k] : offsets[k + 1]]
                found = found.as_py()
                if not found:
                    removed.append(0)
                    count.append(0)
                    left = text.tobytes()
                else:
                    r = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in found])
                    r = r[np.argsort(r[:, 0], kind="stable")]
                    _, s, e = _merged(np.zeros(len(r), np.int64), r[:, 0], r[:, 1])
                    removed.append(int((e - s).sum()))
                    count.append(len(s))
                    left = b"".join(text[a:b].tobytes() for a, b in zip(np.append(0, e), np.append(s, len(text))))
                kept.append(left)
                digest.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()), pa.array(digest, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return both.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
