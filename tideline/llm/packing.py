"""Best-fit packing of tokenised documents into sequences.

Every document becomes its tokens and one end token; longer documents than `capacity` are cut into pieces of that length
(the last may be shorter). Best-fit decreasing then places each piece in the fullest sequence that still has room; a
segment tree over remaining capacities finds it in logarithmic time. Pieces of one length are alike to best-fit
decreasing, so the driver plans over the histogram of lengths (at most `capacity` numbers), placing all pieces of a
length that meet the same kind of sequence in one step. Each plan step takes whole runs of equal sequences, and a run
that takes part at least halves its remaining capacity, so a plan has some 11 steps a run and at most three new runs a
length: under 100,000 steps for any corpus. Pieces find their place from their rank among the pieces of their length,
which Spark counts by partition and length, so no task ever holds a length's pieces together.

Tokens: the tokenizer is applied to words, each different word once; a text with characters for which its normaliser and
Python might disagree, or with a special token's mark, goes through the tokenizer as a whole.

Cases: null text is empty; an empty text is one piece of the end token. Rows that repeat a doc_id are packed one by one,
each as a document of its own. An empty table gives an empty table. Other columns are not read. A very long text is
tokenised whole, at some 60 bytes a byte. Ties: of pieces of one length and of equally full sequences either may go first;
which one does follows the partitions, and how many sequences there are doesn't depend on it.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import _bytes as B
from tideline.llm._common import pick, save

#: The normaliser and the splitting of the tokenizer files whose words are cut here.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_SPACE, _LETTER, _DIGIT, _OTHER, _UNSAFE = range(5)
_tables: dict = {}


def _char_tables():
    """Class and lower case of each code point below U+0250; what is not plainly the same everywhere is unsafe."""
    if not _tables:
        import regex

        kind, lower = np.full(0x250, _UNSAFE, np.uint8), np.arange(0x250, dtype=np.int64)
        for cp in range(0x250):
            c = chr(cp)
            if 0x20 <= cp < 0x7F or 0xA1 <= cp or c in "\t\n\v\f\r":
                low = c.lower()
                if len(low) == 1 and ord(low) < 0x250 and (ord(low) < 0x80) == (cp < 0x80):
                    lower[cp] = ord(low)
                    kind[cp] = _SPACE if c.isspace() else _LETTER if regex.match(r"\p{L}", low) else _DIGIT if regex.match(r"\p{N}", low) else _OTHER
        _tables["kind"], _tables["lower"] = kind, lower
    return _tables["kind"], _tables["lower"]


class Tokens:
    """Token ids of whole texts by a tokenizer file of lower-cased words; different words are tokenised once."""

    LIMIT = 1_200_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # words are cut here only as this kind of file cuts them; any other kind encodes whole texts
        parts = json.loads(self.tokenizer.to_str())
        self.by_words = (parts["normalizer"], parts["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER) and all(t["content"].startswith("<|") for t in parts["added_tokens"])
        suffix, vocabulary = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.closes[[v for k, v in vocabulary.items() if suffix and k.endswith(suffix)]] = True
        self.forget()

    def forget(self):
        self.known, self.flat, self.at = {}, np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin."""
        if not self.by_words:
            pieces = [np.array(self.tokenizer.encode(buf[a:b].tobytes().decode(), add_special_tokens=False).ids, np.uint32) for a, b in zip(offsets, offsets[1:])]
            return np.concatenate([np.zeros(0, np.uint32), *pieces]), np.cumsum([0, *map(len, pieces)])
        kind_of, lower_of = _char_tables()
        low = B.LOWER[buf]
        kind = kind_of[:256][buf]
        kind[buf > 0x7F] = _UNSAFE
        lead = np.flatnonzero((buf >= 0xC2) & (buf <= 0xC9))
        lead = lead[lead + 1 < len(buf)]
        cp = (buf[lead].astype(np.int64) & 0x1F) << 6 | (buf[lead + 1] & 0x3F)
        fine = cp < 0x250
        lead, cp = lead[fine], cp[fine]
        kind[lead] = kind[lead + 1] = kind_of[cp]
        cp = lower_of[cp]
        low[lead], low[lead + 1] = 0xC0 | cp >> 6, 0x80 | cp & 0x3F
        special = np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124)) if len(buf) else np.zeros(0, int)
        odd = np.diff(np.searchsorted(np.flatnonzero(kind == _UNSAFE), offsets)) > 0
        odd |= np.diff(np.searchsorted(special, offsets)) > 0
        # pieces: runs of letters, single digits, runs of others
        n = len(buf)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        inside = kind != _SPACE
        first = np.ones(n, bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        first[lead + 1] = False  # the second byte of a character
        first |= edge[:n]
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], n)[: len(starts)]
        keep = inside[starts]
        starts, ends = starts[keep], ends[keep]
        # 's 't 'm 'd 're 've 'll right after a lone apostrophe are one piece with it
        lone = np.flatnonzero((low[starts] == 39) & (ends - starts == 1))
        lone = lone[lone + 1 < len(starts)]
        lone = lone[(starts[lone + 1] == ends[lone]) & ~edge[ends[lone]] & (kind[starts[lone + 1]] == _LETTER)]
        for k in lone[::-1] if len(lone) < 1000 else ():
            starts, ends = self._join(low, starts, ends, k)
        if len(lone) >= 1000:
            starts, ends = self._join_many(low, starts, ends, lone)
        which, where = B.numbers(low, starts, ends)
        if len(self.known) + len(where) > self.LIMIT:
            self.forget()
        data = low.tobytes()
        spelled = [data[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())]
        place = [self.known.get(x, -1) for x in spelled]
        new = [k for k, p in enumerate(place) if p < 0]
        if new:
            names = [spelled[k].decode("utf-8", "replace") for k in new]
            # the form of encode() that works out no offsets
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(names)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.closes[ids]) + 1
            if len(stops) != len(names):  # a piece without an end of its own: one by one
                one = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in names]
                ids, stops = np.array([v for x in one for v in x], np.uint32), np.cumsum([len(x) for x in one])
            for n, k in enumerate(new):
                place[k] = self.known[spelled[k]] = len(self.at) - 1 + n
            self.at = np.concatenate((self.at, self.at[-1] + stops))
            self.flat = np.concatenate((self.flat, ids))
        at = self.at
        place = np.array(place, np.int64)[which] if len(which) else np.zeros(0, np.int64)
        lengths = at[place + 1] - at[place]
        ids = self.flat[B.ranges(at[place], lengths)]
        bounds = np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(starts, offsets)]
        if odd.any():
            pieces = [ids[bounds[k] : bounds[k + 1]] for k in range(len(offsets) - 1)]
            for k in np.flatnonzero(odd):
                pieces[k] = np.array(self.tokenizer.encode(buf[offsets[k] : offsets[k + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            bounds = np.cumsum([0, *map(len, pieces)])
            ids = np.concatenate(pieces)
        return ids, bounds

    @staticmethod
    def _tail(low, starts, ends, k):
        """How many bytes of the letters after apostrophe k belong to it."""
        word = bytes(low[starts[k + 1] : min(ends[k + 1], starts[k + 1] + 2)])
        return 1 if word[:1] in (b"s", b"t", b"m", b"d") else 2 if word in (b"re", b"ve", b"ll") else 0

    def _join(self, low, starts, ends, k):
        return self._join_many(low, starts, ends, np.array([k]))

    def _join_many(self, low, starts, ends, lone):
        starts, ends = starts.copy(), ends.copy()
        take = np.array([self._tail(low, starts, ends, k) for k in lone])
        lone, take = lone[take > 0], take[take > 0]
        ends[lone] += take
        starts[lone + 1] += take
        full = starts < ends
        return starts[full], ends[full]


class OpenBins:
    """How many sequences are open at each remaining capacity, in a segment tree: the least that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, first: int, n: int) -> None:
        if n and room:
            self.runs[room].append((first, n))
            self._change(room, n)

    def _change(self, room: int, n: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += n
            k //= 2

    def take(self, length: int) -> tuple[int, int, int] | None:
        """The tightest run of sequences with room for length: (room, first, how many); it is no longer open."""
        k = length + self.leaves
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k //= 2
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.leaves
        first, n = self.runs[room].pop()
        self._change(room, -n)
        return room, first, n


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts of lengths. Steps (length, first rank, first sequence, pieces a sequence, offset)
    in order of length and rank, and the number of sequences."""
    bins, steps, opened = OpenBins(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            got = bins.take(length)
            if got is None:
                each = capacity // length
                got = capacity, opened, -(-left // each)
                opened += got[2]
            room, first, n = got
            each = room // length
            full = min(n, left // each)
            if full:
                steps.append((length, rank, first, each, capacity - room))
                bins.add(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left and left < each:
                steps.append((length, rank, first + full, each, capacity - room))
                bins.add(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            bins.add(room, first + full, n - full)
    return np.array(sorted(steps), np.int64).reshape(-1, 5), opened


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32 (and ids), the partition that made it, and its rank
    among that partition's pieces of its length."""
    data = pick(docs, id=id_col, text=text_col)

    def run(batches):
        tokens = _tables.get(tokenizer_path) or _tables.setdefault(tokenizer_path, Tokens(tokenizer_path))
        part, ranks = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            buf, offsets = B.texts(batch.column(1))
            for i, j in B.chunks(offsets, 1 << 21):
                ids, bounds = tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                whole = np.insert(ids, bounds[1:], np.uint32(end_id)).astype("<u4")
                first = bounds + np.arange(len(bounds))
                size = np.diff(first)
                count = -(-size // capacity)
                doc = np.repeat(np.arange(j - i), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                at = first[doc] + start
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                head = np.searchsorted(ordered, ordered)
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - head + ranks[ordered]
                ranks += np.bincount(length, minlength=capacity + 1)
                raw = memoryview(whole.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                columns = [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part)), pa.array(rank)]
                names = ["id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(np.cumsum(length) - length, length.sum()).astype(np.int32)), pa.array(whole.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = data.schema["id"].dataType.simpleString()
    return data.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, rank long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and its offset there; offsets leave no gap."""
    made = save(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids), "pieces")
    counts = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    steps, _ = plan(histogram, capacity)
    shared = made.sparkSession.sparkContext.broadcast(steps)  # under 100,000 rows of 40 bytes, see above
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = made.join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")
    names = [c for c in ranked.columns if c != "rank"]

    def place(batches):
        steps = shared.value
        lengths = steps[:, 0]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                a, b = np.searchsorted(lengths, (n, n + 1))
                at[own] = a + np.searchsorted(steps[a:b, 1], rank[own], "right") - 1
            _, first_rank, first, each, offset = steps[at].T
            k = rank - first_rank
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(first + k // each), pa.array(offset + k % each * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names)
    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")
