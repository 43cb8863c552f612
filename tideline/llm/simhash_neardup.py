"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Fingerprints are 64-bit SimHashes of word shingles. Two that differ in `BITS` = 3 bits or fewer agree in at least 5 of
their 8 bytes, place by place. The index posts each different fingerprint under positional bytes; to keep lists short a
posting holds three positional bytes of one half (8 such triples), of which any pair with 5 matches shares at least one,
since one half then holds 3 of them. For every pair that meets in a list, the shared positional bytes are tallied; pairs
with 5 matches or more are kept and verified bit by bit. Equal fingerprints are one entry from the start.

A list of more than `BLOCK` entries is dealt into blocks, and each pair of blocks is a task's work of its own, so no
list, however hot, lands in one task. Of a list's links only those that connect something new are passed on.

By similarity, `keep_first` links documents whose sets of shingles have a Jaccard similarity of `SIMILARITY` or more. The
index's pairs (within `BITS`) and rows of one fingerprint come first. That similarity is about 10 of 64 bits, which
positional bytes can't reach (5 of 8 equal bytes would ask for 3), so documents are posted besides under the `SKETCH`
smallest hashes of their shingles: sets of similarity 0.8 share none of 6 with a chance of 0.2 ** 6, under one in ten
thousand. Documents that share a posting, of sizes that allow the similarity and fingerprints within `RADIUS` bits, are
candidates too. All candidates are verified on their whole sets. In a list of more than two each first meets the list's
ends, and then only what these don't connect, so a group of alike documents costs no more than its postings. For the rest a
bound goes before the sets: `ODD` bits hold the parity of how many of a set's hashes fall on each, and two sets differ in
as many hashes at least as in bits. It drops no pair that is similar.

Cases: null and empty texts, and texts without a word, have the fingerprint zero and are linked like any others. A null
id has a fingerprint, no links of its own, and its fingerprint's component if another row has it, else null. Rows that
repeat an id count as one document. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _bytes as B
from tideline.llm import line_dedup
from tideline.llm._common import discard, pick, place, release, save
from tideline.llm.components import connected_components

BITS = 3
MATCHES = 5
BLOCK = 1024
SEED = 42
SIMILARITY, SKETCH, RADIUS, FEW, ODD = 0.8, 6, 22, 32, 1024


def shingles(buf: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' shingles, repeats included, and how many each text has."""
    low = B.LOWER[buf]
    starts, ends = B.words(low, offsets, B.NOT_SPACE)
    bounds = np.searchsorted(starts, offsets)
    lengths = ends - starts
    at = np.cumsum(lengths + 1) - lengths - 1  # words one space apart
    tight = np.full(int((lengths + 1).sum()), 32, np.uint8)
    tight[B.ranges(at, lengths)] = low[B.NOT_SPACE[low]]
    n = np.diff(bounds)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    first = B.ranges(bounds[:-1], count)
    last = np.minimum(first + shingle, np.repeat(bounds[1:], count)) - 1
    view, digest = memoryview(tight), xxhash.xxh64_intdigest
    h = np.fromiter((digest(view[a:b], SEED) for a, b in zip(at[first].tolist(), (at[last] + lengths[last]).tolist())), np.uint64, len(first))
    return h, count


def simhash(buf: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """Fingerprint of each text: bit k is 1 if over half of the hashes of its shingles, repeats included, have it."""
    return _majority(*shingles(buf, offsets, shingle))


def _majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each group of hashes, the bits that over half of them have."""
    n = count
    # sums of 4 bits at a time in fields of 16 bits, over at most 60,000 shingles
    doc = np.repeat(np.arange(len(n)), count)
    begin = np.concatenate(([0], np.cumsum(count)))
    heads = np.unique(np.concatenate((begin[:-1][count > 0], *(np.arange(begin[k], begin[k + 1], 60_000) for k in np.flatnonzero(count > 60_000)))))
    ones = np.zeros((len(n), 64), np.int64)
    if len(heads):
        for shift in range(16):
            sums = np.add.reduceat((h >> np.uint64(shift)) & np.uint64(0x0001000100010001), heads)
            for field in range(4):
                np.add.at(ones[:, shift + 16 * field], doc[heads], ((sums >> np.uint64(16 * field)) & np.uint64(0xFFFF)).astype(np.int64))
    bits = 2 * ones > count[:, None]
    return (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """id and fp (the 64 bits as a signed long) of every row."""
    data = pick(docs, id=id_col, text=text_col)

    def run(batches):
        for batch in batches:
            buf, offsets = B.texts(batch.column(1))
            parts = [simhash(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle) for i, j in B.chunks(offsets, 1 << 21)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64))], ["id", "fp"])

    return data.mapInArrow(run, f"id {data.schema['id'].dataType.simpleString()}, fp long")


def _links(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each group (rows of a group stand together): a forest that connects all that are within BITS.

    Pairs that meet are tallied over the 8 postings of each (its byte at every place); only those that reach MATCHES are
    verified bit by bit."""
    postings = np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8)
    root = np.arange(len(fp))
    parent = root.copy()

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = [], []
    here = np.arange(len(fp) - 1) if len(fp) else np.zeros(0, int)
    step = 1
    while len(here):
        here = here[here + step < len(fp)]
        here = here[group[here] == group[here + step]]
        apart = here[root[here] != root[here + step]]
        shared = (postings[apart] == postings[apart + step]).sum(axis=1)
        apart = apart[shared >= MATCHES]
        apart = apart[np.bitwise_count(fp[apart] ^ fp[apart + step]) <= BITS]
        for a in apart.tolist():
            p, q = find(a), find(a + step)
            if p != q:
                parent[max(p, q)] = min(p, q)
                left.append(a)
                right.append(a + step)
        if len(apart):
            while True:  # point all to their roots
                root = parent[parent]
                if (root == parent).all():
                    break
                parent = root.copy()
            root = parent.copy()
        step += 1
    return np.array(left, int), np.array(right, int)


def links(different: DataFrame) -> DataFrame:
    """Edges (a, b) between the reps of fingerprints within BITS of each other; different has a row (fp, rep) for each
    fingerprint. The edges connect all such reps; links that connect nothing new are left out."""
    halves = [F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)]
    keys = [F.lit(s << 32) + halves[s // 4].bitwiseAND(F.lit(0xFFFFFFFF ^ 0xFF << 8 * (s % 4))) for s in range(8)]
    postings = different.where("rep is not null").select("fp", "rep", F.explode(F.array(*keys)).alias("key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = postings.join(sizes, "key").select("key", "fp", "rep", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"))
    dealt = met.select("key", "fp", "rep", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp", "rep")
    dealt = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "fp")

    def run(batches):
        for held in _whole(batches):
            group = np.cumsum(np.concatenate(([0], np.any([np.diff(held[c]) != 0 for c in "kpq"], axis=0))))
            a, b = _links(group, held["fp"].view(np.uint64))
            yield pa.RecordBatch.from_arrays([held["rep"].take(pa.array(a)), held["rep"].take(pa.array(b))], ["a", "b"])

    kind = different.schema["rep"].dataType.simpleString()
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def _whole(batches):
    """Sorted batches cut where a group ends: each yields whole groups only, and holds one unfinished group at most."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        group = [table.column(c).to_numpy() for c in (0, 1, 2)]
        change = np.flatnonzero(np.any([np.diff(g) != 0 for g in group], axis=0)) + 1
        cut = int(change[-1]) if len(change) else 0
        if cut:
            yield _columns(table.slice(0, cut))
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield _columns(rest)


def _columns(table: pa.Table) -> dict:
    k, p, q, fp = (table.column(c).to_numpy() for c in range(4))
    return {"k": k, "p": p, "q": q, "fp": np.ascontiguousarray(fp), "rep": table.column(4).combine_chunks()}


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """id, fp and component (the smallest id it reaches by links) of every row."""
    prints = save(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    different = save(prints.groupBy("fp").agg(F.min("id").alias("rep")), "different")
    edges = save(links(different), "links")
    joined = connected_components(edges)
    where = different.join(joined, different["rep"] == joined["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    out = prints.join(where, "fp", "left").select("id", "fp", "component")
    discard(edges)
    return out


def _sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    buf, offsets = B.texts(column)
    out = []
    for i, j in B.chunks(offsets, 1 << 21):
        h, count = shingles(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
        out += [np.unique(x) for x in np.split(h, np.cumsum(count)[:-1])]
    return out


def _fits(x, m, n):
    """Whether two shingle sets, of which these are the fingerprints' xor and the sizes, may be similar; few shingles leave
    a fingerprint to chance."""
    m, n = F.col(m), F.col(n)
    return (F.least(m, n) >= F.greatest(m, n) * SIMILARITY - 1e-6) & ((F.bit_count(x) <= RADIUS) | (F.least(m, n) < FEW))


def _odd(hashes: np.ndarray) -> np.ndarray:
    """The parity of how many of the hashes fall on each of ODD bits, as longs."""
    ones = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % ODD, minlength=ODD) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").view(np.int64)


def _may_be_alike(x: str, y: str, m: str, n: str):
    """Whether sets of m and n hashes with these parities may be similar: they differ in m + n - 2 * common hashes, which is
    at most (1 - SIMILARITY) / (1 + SIMILARITY) of m + n."""
    bits = F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, b: s + b)
    return bits <= (F.col(m) + F.col(n)) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6


def alike(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id and component (the smallest id it reaches) of each row with an id, linked by the shingles' Jaccard similarity."""
    data = pick(docs, id=id_col, text=text_col).where("id is not null")
    kind = data.schema["id"].dataType.simpleString()

    def mark(batches):
        for batch in batches:
            whole, fp, size, first, odd = [], [], [], [], []
            buf, offsets = B.texts(batch.column(1))
            for i, j in B.chunks(offsets, 1 << 21):
                h, count = shingles(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                fp.append(_majority(h, count))
                for x in np.split(h, np.cumsum(count)[:-1]):
                    x = np.unique(x)
                    whole.append(xxhash.xxh3_128_digest(x.tobytes()))
                    size.append(len(x))
                    first.append(x[:SKETCH].view(np.int64))
                    odd.append(_odd(x).tobytes())
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in first]))), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *first])))
            parities = pa.ListArray.from_arrays(pa.array(np.arange(len(odd) + 1) * (ODD // 64), pa.int32()), pa.array(np.frombuffer(b"".join(odd), np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.binary()), pa.array(np.concatenate([np.zeros(0, np.uint64), *fp]).view(np.int64)), pa.array(size, pa.int64()), keys, parities], ["id", "whole", "fp", "length", "sketch", "odd"])

    marked = save(data.mapInArrow(mark, f"id {kind}, whole binary, fp long, length long, sketch array<long>, odd array<long>"), "marked")
    # rows of one set are linked to its smallest id, and only that meets others
    reps = save(marked.groupBy("whole").agg(F.min("id").alias("lid"), F.first("fp").alias("fp"), F.first("length").alias("length"), F.first("sketch").alias("sketch"), F.first("odd").alias("odd")), "sets")
    lists = save(line_dedup.key_lists(reps), "lists")

    def verify(batches):
        for batch in batches:
            sets = [_sets(batch.column(c), shingle) for c in (2, 3)]
            common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets)]
            good = [c >= SIMILARITY * (len(x) + len(y) - c) - 1e-9 for c, x, y in zip(common, *sets)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    def verified(pairs):
        some = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        texts = save(data.join(some, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "texts")
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
        out = save(both.select("a", "b", "x", "y").mapInArrow(verify, f"a {kind}, b {kind}"), "verified")
        discard(texts)
        return out

    different = save(reps.groupBy("fp").agg(F.min("lid").alias("rep")), "different")
    near = links(different).unionByName(reps.join(different, "fp").where("lid != rep").select(F.col("rep").alias("a"), F.col("lid").alias("b")))
    hubs = line_dedup.hub_pairs(reps, lists, _fits)
    first = save(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(hubs).distinct(), "pairs")
    linked = verified(first)
    joined = connected_components(linked)
    found = line_dedup.candidates(reps, lists, joined, _fits, "odd", _may_be_alike)
    for df in (different, hubs, first, linked, lists):
        discard(df)
    joined = line_dedup.settled(found, joined, verified)
    edges = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
    edges = edges.unionByName(marked.join(reps.select("whole", "lid"), "whole").where("id != lid").select(F.col("lid").alias("a"), F.col("id").alias("b")))
    found = connected_components(edges)
    out = marked.select("id").join(found, marked["id"] == found["node"], "left").select("id", F.coalesce("component", "id").alias("component"))
    discard(reps)
    discard(joined)
    release(docs.sparkSession)
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, by_similarity: bool = False) -> DataFrame:
    """docs with one document of each group, that with the smallest id; all columns as they were. Rows that repeat the
    kept id stay, as do rows with a null id. Groups are those of the fingerprints, or of the shingles' similarity."""
    found = alike(docs, id_col, text_col, shingle) if by_similarity else groups(docs, id_col, text_col, shingle)
    gone = found.where(F.col("id") != F.col("component")).select(F.col("id").alias("gone")).distinct()
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.join(gone, plain[f"c{place(names, id_col)}"] == gone["gone"], "left_anti").toDF(*names)
