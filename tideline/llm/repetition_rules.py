"""Quality rules: repetition inside a document, found by a suffix array over its words.

The suffixes of every document (as sequences of white-space words) are sorted by prefix doubling, many documents at a
time, a document's suffixes apart from all others'. Neighbours' longest common prefixes come from the doubling's ranks.
Runs of the suffix array whose common prefix is `min_words` words or more are the LCP intervals of the maximal repeated
substrings; the union of the spans these cover, over the document's words, is the covered fraction. A document fails
when more than `max_covered` of its words are covered or its longest repeat exceeds `max_repeat` words.

Words and lines are told apart by hashes whose spans' bytes are compared, so no two texts' strings are taken for each other.

Base rules beside it: words, code points in words, symbols of #*$%&|<>, lines equal to an earlier line, and words in
3-word windows that occur twice or more.

Cases: null and empty texts have no words: all counts 0, base_failed true. Lines are what lies between \\n; a line
without a word is never a duplicate. Repeated rows are judged alike, one row each; an empty table gives an empty table;
other columns are not read. A very long text is sorted by itself, whole, at some 100 bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm import _bytes as B
from tideline.llm._common import pick

#: Words of texts up to which the ranks of all levels are kept: 4 bytes a word and level.
KEPT = 1 << 21
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CODE_POINT = np.ones(256, bool)
_CODE_POINT[0x80:0xC0] = False


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of the keys, and the sorted order."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    fresh = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    return rank, order


def suffix_array(word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array over all documents' words (document first, then the words up to its end), and the longest common prefix
    of each suffix with the one before it (0 across documents).

    word: a number of each word; only equal words have equal numbers. bounds: each document's range. The
    doubling's ranks are kept for the common prefixes, one array a level; beyond `KEPT` words (one very long text) they would
    be too many, and prefixes are followed position by position instead, each being that of the one before less one at least.
    """
    n = len(word)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = np.repeat(bounds[1:], np.diff(bounds))
    rank, order = _ranks(word)
    rank, order = _ranks(doc * np.int64(n + 1) + rank)
    kept = n <= KEPT
    levels, size = [rank.astype(np.int32)], 1
    while n and rank[order[-1]] < n - 1:
        # suffixes that are not yet alone in their class are sorted by what follows; those alone keep their place
        counts = np.bincount(rank)
        open_ = np.flatnonzero(counts[rank] > 1)
        begin = np.cumsum(counts) - counts
        place = begin[rank]  # the class's first place in the suffix array: a rank that later splits keep in order
        follow = open_ + size
        after = np.where(follow < end[open_], place[np.minimum(follow, n - 1)] + 1, 0)
        sub, by = _ranks(place[open_] * np.int64(n + 1) + after)
        # new places: the old class's first place plus the number of its members before
        srt = open_[by]
        pos = np.arange(len(srt))
        old, new = place[srt], sub[by]
        head = np.concatenate(([True], old[1:] != old[:-1]))
        group = np.maximum.accumulate(np.where(head, pos, 0))
        step = np.concatenate(([True], new[1:] != new[:-1]))
        first = np.maximum.accumulate(np.where(step, pos, 0))
        place = place.copy()
        place[srt] = old + (first - group)
        order = np.argsort(place, kind="stable")
        p = place[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([True], p[1:] != p[:-1]))) - 1
        if kept:
            levels.append(rank.astype(np.int32))
        size *= 2
        if (np.bincount(rank) == counts[: rank.max() + 1] if rank.max() + 1 == len(counts) else np.array([False])).all():
            break
    lcp = np.zeros(n, np.int64)
    if not kept:
        return order, _followed(word, end, order)
    if n:
        a, b = order[:-1].copy(), order[1:].copy()
        together = doc[a] == doc[b]
        for level in range(len(levels) - 1, -1, -1):
            step = 1 << level
            while True:
                fits = together & (a + step <= end[order[:-1]]) & (b + step <= end[order[1:]])
                same = fits & (levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)])
                if not same.any():
                    break
                a[same] += step
                b[same] += step
                if level < len(levels) - 1:
                    break
        lcp[1:] = a - order[:-1]
    return order, lcp


def _followed(word: np.ndarray, end: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefixes with the suffix before, by following the text's positions in order."""
    n = len(word)
    before = np.empty(n, np.int64)  # of each position, the suffix before it in the array
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    w, stop, prior = (memoryview(np.ascontiguousarray(x, np.int64)) for x in (word, end, before))
    found = np.zeros(n, np.int64)
    out, k = memoryview(found), 0
    for i in range(n):
        j = prior[i]
        if j < 0 or stop[i] != stop[j]:
            k = 0
            continue
        most = stop[i] - (i if i > j else j)
        while k < most and w[i + k] == w[j + k]:
            k += 1
        out[i] = k
        if k:
            k -= 1
    return found[order]


def repeats(order: np.ndarray, lcp: np.ndarray, n: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the n positions a repeated substring of min_words or more covers, and how long the longest repeat that
    begins at each position is."""
    longest = np.zeros(n, np.int64)
    if n:
        nxt = np.concatenate((lcp[1:], [0]))
        longest[order] = np.maximum(lcp, nxt)
    reach = np.where(longest >= min_words, np.arange(n) + longest, 0)
    covered = np.maximum.accumulate(reach) > np.arange(n) if n else np.zeros(0, bool)
    return covered, longest


def measure(buf: np.ndarray, offsets: np.ndarray, min_words: int) -> dict[str, np.ndarray]:
    """All counts of each text."""
    n_docs = len(offsets) - 1
    starts, ends = B.words(buf, offsets, B.NOT_SPACE)
    bounds = np.searchsorted(starts, offsets)
    n_words = np.diff(bounds)
    per_doc = lambda positions: np.diff(np.searchsorted(positions, offsets))
    out = {"n_words": n_words, "word_chars": per_doc(np.flatnonzero(_CODE_POINT[buf] & B.NOT_SPACE[buf])), "n_symbols": per_doc(np.flatnonzero(_SYMBOL[buf]))}
    # lines
    cut = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(buf == 10) + 1)))
    cut = cut[cut < len(buf)]
    stop = np.concatenate((cut[1:], [len(buf)])) if len(cut) else cut
    stop = np.where(buf[stop - 1] == 10, stop - 1, stop) if len(cut) else stop
    has_word = np.searchsorted(starts, stop) > np.searchsorted(starts, cut)
    cut, stop = cut[has_word], stop[has_word]
    line_doc = np.searchsorted(offsets, cut, "right") - 1
    line = B.numbers(buf, cut, stop)[0]
    order = np.lexsort((line, line_doc))
    again = np.zeros(len(line), bool)
    again[order[1:]] = (line[order[1:]] == line[order[:-1]]) & (line_doc[order[1:]] == line_doc[order[:-1]])
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n_docs)
    # repeated words
    word = B.numbers(buf, starts, ends)[0]
    order, lcp = suffix_array(word, bounds)
    covered, longest = repeats(order, lcp, len(word), min_words)
    triple = np.where(longest >= 3, np.arange(len(word)) + 3, 0)
    in_triple = np.maximum.accumulate(triple) > np.arange(len(word)) if len(word) else covered
    doc = np.repeat(np.arange(n_docs), n_words)
    out["n_repeat_words"] = np.bincount(doc[in_triple], minlength=n_docs)
    out["n_covered"] = np.bincount(doc[covered], minlength=n_docs)
    top = np.zeros(n_docs, np.int64)
    some = np.flatnonzero(n_words)
    if len(some):
        top[some] = np.maximum.reduceat(longest, bounds[some])
    out["longest_repeat"] = top
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8, max_covered: float = 0.3, max_repeat: int = 100, least_words: int = 50, max_repeat_words: int = 50) -> DataFrame:
    """id, the counts, base_failed, repetition_failed and kept for every row."""
    data = pick(docs, id=id_col, text=text_col)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]

    def run(batches):
        for batch in batches:
            buf, offsets = B.texts(batch.column(1))
            parts = [measure(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], min_words) for i, j in B.chunks(offsets, 1 << 21)]
            x = {k: np.concatenate([np.zeros(0, np.int64), *(p[k].astype(np.int64) for p in parts)]) for k in names}
            base = (x["n_words"] < least_words) | (100 * x["n_repeat_words"] > max_repeat_words * x["n_words"])
            bad = (x["n_covered"] > max_covered * x["n_words"]) | (x["longest_repeat"] > max_repeat)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[k]) for k in names), pa.array(base), pa.array(bad), pa.array(~base & ~bad)], ["id", *names, "base_failed", "repetition_failed", "kept"])

    return data.mapInArrow(run, f"id {data.schema['id'].dataType.simpleString()}, {', '.join(f'{k} long' for k in names)}, base_failed boolean, repetition_failed boolean, kept boolean")
