"""Benchmark decontamination: suffix arrays over the training text, searched for every benchmark suffix.

A shard is a few MB of documents that a task holds anyway. Its suffix array sorts the positions of its words (prefix
doubling over word numbers); words that no benchmark item has end every match, so only runs of benchmark words as long
as the shortest window are sorted. Every suffix of every benchmark item is then binary-searched in the array, all at
once, a word deeper each round: the interval of a suffix at the depth of its window holds all places where that window
occurs in the shard, and the depth at which the interval runs empty is the longest verbatim match.

A window is `window` consecutive words of an item, or all words of a shorter item. Word numbers come from 64-bit hashes;
words of the benchmark that share one are told apart by their bytes, and the bytes of every hit are compared: a hash that
stood for another word is taken out and the shard searched again.

The benchmark is read in blocks of at most `block_words` words. Each block is broadcast by itself and a task holds one
at a time, so benchmarks of any size take bounded memory.

Cases: null, empty and wordless documents have no words and stay; items without a word match nothing; a null item_id
counts as the empty string; repeated items count once. Rows that repeat a doc_id are judged one by one. An empty
benchmark hits nothing, an empty table gives an empty table. Other columns are not read (or kept as they are, by keep). A
very long text is a shard by itself, searched whole, at some 60 bytes a word. Of an item's equally long matches the one that
begins first in the document is given, and of those the one first in the item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _bytes as B
from tideline.llm._common import filter_batches, pick, place


class Block:
    """Some items: their words, suffixes and windows."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        buf, offsets = B.texts(pa.array(texts, pa.string()))
        low = B.LOWER[buf]
        starts, ends = B.words(low, offsets, B.ALNUM)
        bounds = np.searchsorted(starts, offsets)
        n = np.diff(bounds)
        which, first = B.numbers(low, starts, ends)
        self.spelled = [low[starts[k] : ends[k]].tobytes() for k in first]
        self.words = which + 1  # number of each word of all items; 0 is any other word
        hashed = np.empty(len(first), np.uint64)
        by_start = np.argsort(first)
        hashed[by_start] = B.hashes(low, starts[first[by_start]], ends[first[by_start]])
        self.hashes, one, count = np.unique(hashed, return_index=True, return_counts=True)
        self.known = B.Lookup(self.hashes, one + 1)
        twins = np.isin(hashed, self.hashes[count > 1])  # words whose hash another word has too
        self.twin_hashes, self.twins = self.hashes[count > 1], {self.spelled[k]: int(k) + 1 for k in np.flatnonzero(twins)}
        self.bounds, self.ids = bounds, ids
        self.item = np.repeat(np.arange(len(ids)), n)
        size = np.repeat(np.minimum(n, window), n)
        left = np.repeat(bounds[1:], n) - np.arange(len(self.words))
        self.window = np.where(left >= size, size, 0)  # length of the window that begins at each word, or 0
        self.left = left
        self.least = int(n[n > 0].min(initial=window)) if (n > 0).any() else window
        self.least = min(self.least, window)
        self.deepest = int(n.max(initial=0))


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int):
    """The benchmark in bounded blocks; its rows come to the driver one partition's at a time."""
    items = pick(benchmark, id=id_col, text=text_col).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    ids, texts, size = [], [], 0
    for r in items.distinct().toLocalIterator():
        if ids and size + len(r["text"]) // 2 > block_words:
            yield Block(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(r["id"])
        texts.append(r["text"])
        size += len(r["text"]) // 2 + 1
    if ids:
        yield Block(ids, texts, window)


def suffix_array(seq: np.ndarray, at: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Positions `at` of seq sorted by their next `depth` words, each up to its run's end; ties in order of position."""
    rank = np.unique(seq[at], return_inverse=True)[1].astype(np.int64) if len(at) else np.zeros(0, np.int64)
    place = np.full(len(seq), -1, np.int64)
    size = 1
    while size < depth and len(at) and rank.max() < len(at) - 1:
        place[at] = rank
        follow = at + size
        after = np.where(follow < end, place[np.minimum(follow, len(seq) - 1)] + 1, 0)
        rank = np.unique(rank * np.int64(len(at) + 1) + after, return_inverse=True)[1]
        size *= 2
    return at[np.argsort(rank, kind="stable")]


def search(seq: np.ndarray, array: np.ndarray, block: Block):
    """Binary search of all suffixes of the block's items. Longest match of each suffix (words) and a place of it, and
    the array's interval [low, high) at the depth of the suffix's window, empty if the window doesn't occur."""
    n = len(block.words)
    low, high = np.zeros(n, np.int64), np.full(n, len(array), np.int64)
    match, place = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    from_, to = np.zeros(n, np.int64), np.zeros(n, np.int64)
    padded = np.concatenate((seq, np.zeros(1, np.int64)))
    live, depth = np.arange(n) if len(array) else np.zeros(0, np.int64), 0
    while len(live):
        live = live[block.left[live] > depth]
        want = block.words[live + depth]
        edges = []
        for upper in (False, True):
            a, b = low[live].copy(), high[live].copy()
            while (a < b).any():
                mid = (a + b) // 2
                word = padded[np.minimum(array[np.minimum(mid, len(array) - 1)] + depth, len(seq))]
                right = (word <= want) if upper else (word < want)
                open_ = a < b
                a, b = np.where(open_ & right, mid + 1, a), np.where(open_ & ~right, mid, b)
            edges.append(a)
        low[live], high[live] = edges
        found = edges[0] < edges[1]
        live = live[found]
        depth += 1
        match[live], place[live] = depth, array[low[live]]
        full = live[block.window[live] == depth]
        from_[full], to[full] = low[full], high[full]
    return match, place, from_, to


class Shard:
    """A few documents' words."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.low = B.LOWER[buf]
        self.starts, self.ends = B.words(self.low, offsets, B.ALNUM)
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = B.hashes(self.low, self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))

    def find(self, block: Block):
        """Which words are hit, and (document, item, longest match, word in the document, word in the item) of each item
        with a window in a document."""
        n_docs, hit = len(self.bounds) - 1, np.zeros(len(self.starts), bool)
        nothing = hit, np.zeros((0, 5), np.int64)
        if not len(block.words) or not len(self.starts):
            return nothing
        number = block.known(self.hashes, 0)
        if block.twins:
            for k in np.flatnonzero(np.isin(self.hashes, block.twin_hashes)):
                number[k] = block.twins.get(self.low[self.starts[k] : self.ends[k]].tobytes(), 0)
        while True:
            seq = np.zeros(len(number) + n_docs, np.int64)
            where = np.arange(len(number)) + self.doc  # a 0 between documents
            seq[where] = number
            on = np.concatenate(([False], seq > 0, [False]))
            begin, stop = np.flatnonzero(on[1:-1] & ~on[:-2]), np.flatnonzero(on[1:-1] & ~on[2:]) + 1
            long = stop - begin >= block.least
            begin, stop = begin[long], stop[long]
            at = B.ranges(begin, stop - begin)
            array = suffix_array(seq, at, np.repeat(stop, stop - begin), block.deepest)
            match, place, low, high = search(seq, array, block)
            some = np.flatnonzero(high > low)
            if not len(some):
                return nothing
            # a window that several suffixes share is one interval
            spans, which = np.unique(np.column_stack((low[some], high[some], block.window[some])), axis=0, return_inverse=True)
            size = spans[:, 1] - spans[:, 0]
            inside = array[B.ranges(spans[:, 0], size)]
            span = np.repeat(np.arange(len(spans)), size)
            cover = np.zeros(len(seq) + 1, np.int64)
            np.add.at(cover, inside, 1)
            np.add.at(cover, inside + spans[span, 2], -1)
            hit = (np.cumsum(cover)[:-1] > 0)[where]
            wrong = [k for k in np.flatnonzero(hit) if self.low[self.starts[k] : self.ends[k]].tobytes() != block.spelled[number[k] - 1]]
            if not wrong:
                break
            number[wrong] = 0
        # suffixes by interval, then documents by interval
        word_of = np.full(len(seq), -1, np.int64)
        word_of[where] = np.arange(len(number))
        word = word_of[inside]
        order = np.argsort(which, kind="stable")
        begin, end = np.searchsorted(which[order], np.arange(len(spans))), np.searchsorted(which[order], np.arange(len(spans)), "right")
        pairs = []
        for k in range(0, len(inside), 100_000):  # in bounded steps
            own = span[k : k + 100_000]
            many = (end - begin)[own]
            suffix = some[order[B.ranges(begin[own], many)]]
            w = np.repeat(word[k : k + 100_000], many)
            rows = np.column_stack((self.doc[w], block.item[suffix], w - self.bounds[self.doc[w]], suffix - block.bounds[block.item[suffix]], block.window[suffix]))
            pairs.append(np.unique(rows, axis=0))
        rows = np.unique(np.concatenate(pairs), axis=0)
        # windows one after the other, in document and item alike, are one longer match
        rows = rows[np.lexsort((rows[:, 2], rows[:, 2] - rows[:, 3], rows[:, 1], rows[:, 0]))]
        head = np.ones(len(rows), bool)
        head[1:] = (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0) | (np.diff(rows[:, 2]) != 1) | (np.diff(rows[:, 3]) != 1)
        first = np.flatnonzero(head)
        length = np.diff(np.append(first, len(rows))) - 1 + rows[first, 4]
        runs = np.column_stack((rows[first, 0], rows[first, 1], length, rows[first, 2], rows[first, 3]))
        runs = runs[np.lexsort((runs[:, 3], -runs[:, 2], runs[:, 1], runs[:, 0]))]
        best = np.ones(len(runs), bool)
        best[1:] = (np.diff(runs[:, 0]) != 0) | (np.diff(runs[:, 1]) != 0)
        return hit, runs[best]


def _shared(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> list:
    context = docs.sparkSession.sparkContext
    return [context.broadcast(b) for b in blocks(benchmark, id_col, text_col, window, block_words)]


def _search_all(shared: list, column: pa.Array):
    """For each text of a batch: words, hit mask bounds, and its items' longest matches."""
    buf, offsets = B.texts(column)
    for i, j in B.chunks(offsets, 1 << 23):
        shard = Shard(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        hit, matches = np.zeros(len(shard.starts), bool), [[] for _ in range(j - i)]
        for one in shared:
            block = one.value
            mask, rows = shard.find(block)
            hit |= mask
            for doc, item, *rest in rows.tolist():
                matches[doc].append((block.ids[item], *rest))
            if len(shared) > 1:  # hold one block at a time
                one.__dict__.pop("_value", None)
        yield i, j, shard, hit, matches


def inspect(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """For every document: id, n_words, n_hit, and matches: of each item with a window in it the longest verbatim match
    (item_id, words, first word in the document, first word in the item), by item_id."""
    data = pick(docs, id=id_col, text=text_col)
    shared = _shared(docs, benchmark, item_col, item_text_col, window, block_words)
    match = pa.struct([("item_id", pa.string()), ("words", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64())])

    def run(batches):
        for batch in batches:
            for i, j, shard, hit, matches in _search_all(shared, batch.column(1)):
                sums = np.concatenate(([0], np.cumsum(hit)))
                best = []
                for own in matches:
                    one = {}
                    for m in own:  # items of the same id count together
                        if m[0] not in one or (-m[1], m[2]) < (-one[m[0]][1], one[m[0]][2]):
                            one[m[0]] = m
                    best.append([dict(zip(("item_id", "words", "doc_word", "item_word"), one[k])) for k in sorted(one)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(shard.bounds)), pa.array(sums[shard.bounds[1:]] - sums[shard.bounds[:-1]]), pa.array(best, pa.list_(match))], ["id", "n_words", "n_hit", "matches"])

    return data.mapInArrow(run, f"id {data.schema['id'].dataType.simpleString()}, n_words long, n_hit long, matches array<struct<item_id:string, words:long, doc_word:long, item_word:long>>")


def keep(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """docs without the documents that hold a window of the benchmark; all columns as they were."""
    shared = _shared(docs, benchmark, item_col, item_text_col, window, block_words)

    def clean(batch, names):
        out = np.ones(batch.num_rows, bool)
        for i, _, shard, hit, _ in _search_all(shared, batch.column(place(names, text_col))):
            out[i + np.unique(shard.doc[hit])] = False
        return pa.array(out)

    return filter_batches(docs, clean)
