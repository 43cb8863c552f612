"""The text operators against their plain forms, and their defined results for odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tests.llm import plain
from tideline.llm import _bytes, _common, components, decontamination, language_id, line_dedup, packing, quality_mil, repetition_rules, simhash_neardup, suffix_dedup, toxicity_kn, url_filter
from tideline.llm import queries as Q

DOCS = "doc_id long, text string"
ODD = [(901, None), (902, ""), (903, " \n \t"), (904, "é漢字 ßÀ"), (905, "x" * 5000), (906, "a b " * 3000), (907, "same text here"), (907, "same text here"), (None, "same text here"), (None, None)]


def table(spark, rows, schema=DOCS):
    """The rows with extra columns whose names clash with what the operators make."""
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df.select("*", F.lit(1).alias("id"), F.lit("x").alias("n_words"), F.lit(2.5).alias("score"), F.lit("y").alias("c0"), F.lit(True).alias("component"))


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def prose(seed, n, vocabulary=400, most=120):
    r = random.Random(seed)
    known = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
    return [" ".join(r.choice(known) for _ in range(r.randint(1, most))) for _ in range(n)]


# 1
@pytest.mark.parametrize("block_words", [2_000_000, 20])
def test_decontamination(spark, block_words):
    r = random.Random(3)
    known = ["a", "B", "cc", "é", "d1", "ff", "g", "zz"]
    docs = [(i, r.choice([" ", "\n", "-", "!! "]).join(r.choice(known) for _ in range(r.randint(0, 40)))) for i in range(60)] + ODD
    bench = [(i, " ".join(r.choice(known) for _ in range(r.choice([0, 3, 4, 12, 15])))) for i in range(12)] + [(50, docs[3][1]), (50, docs[4][1]), (None, docs[5][1]), (51, None), (51, "")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = decontamination.inspect(table(spark, docs), items, block_words=block_words)
    digest = F.sha2(F.array_join("matches.item_id", ","), 256)
    got = sorted_rows(got.select("id", "n_words", "n_hit", F.size("matches"), digest, F.col("n_hit") > 0))
    want = sorted(plain.decontaminated(docs, bench), key=repr)
    assert got == want and any(x[5] for x in want)
    kept = decontamination.keep(table(spark, docs), items, block_words=block_words)
    assert kept.count() == sum(not x[5] for x in want) and kept.columns == table(spark, docs).columns


def test_decontamination_finds_the_longest_match(spark):
    item = " ".join(f"w{k}" for k in range(30))
    docs = [(1, "zz " + " ".join(f"w{k}" for k in range(5, 25)) + " yy " + " ".join(f"w{k}" for k in range(11)))]
    got = decontamination.inspect(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert [tuple(m) for m in got["matches"]] == [("7", 20, 1, 5)] and got["n_hit"] == 31


def test_decontamination_of_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], DOCS)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.keep(none, bench).count() == 0 and decontamination.keep(some, bench).count() == 1


# 2
def test_line_dedup(spark):
    r = random.Random(5)
    base = prose(6, 40, most=60)

    def changed(line):
        w = line.split(" ")
        kind = r.random()
        if kind < 0.4 and len(w) > 8:
            w[r.randrange(len(w))] = "other"
        elif kind < 0.5:
            w[0] = w[0].upper() + "  "
        elif kind < 0.6 and len(w) > 20:
            del w[3]
        return " ".join(w)

    docs = [(i, "\n".join(changed(r.choice(base)) if r.random() < 0.9 else r.choice(["", " ", "-"]) for _ in range(r.randint(0, 20)))) for i in range(50)] + ODD
    docs += [(3, docs[3][1]), (4, docs[5][1]), (920, " ".join(base * 3)), (921, " ".join(base * 3) + " x")]
    lines = line_dedup.different_lines(spark.createDataFrame(docs, "id long, text string"))
    lines.cache()
    prints = {x["norm"]: x["fp"] % 2**64 for x in lines.join(line_dedup.fingerprints(lines), "lid").collect()}
    runs = lambda u: list(zip(u.split(" "), [*u.split(" ")[1:], None]))
    hashes = {(x["a"], x["b"]): x["h"] % 2**64 for x in spark.createDataFrame(sorted({r for u in prints for r in runs(u)}, key=str), "a string, b string").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    norm = lambda line: line.lower().strip(" ")
    assert set(prints) == {norm(x) for i, t in docs if i is not None and t is not None for x in t.split("\n")} - {""}
    for u, fp in prints.items():
        own = [hashes[r] for r in runs(u)]
        assert fp == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))

    keys = {x["norm"]: set(x["sketch"]) for x in lines.join(line_dedup.fingerprints(lines), "lid").collect()}
    radius = lambda k: line_dedup.BITS["runs" if k < 0 else "words" if k < 1 << 62 else "chars"]

    def alike(a, b):
        allowed = int(round(max(len(a), len(b)) * (1 - line_dedup.SIMILARITY), 6))
        if abs(len(a) - len(b)) > allowed or not any((prints[a] ^ prints[b]).bit_count() <= radius(k) for k in keys[a] & keys[b]):
            return False
        return plain.levenshtein(a, b) <= allowed

    names = sorted(prints)
    edges = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if alike(a, b)]
    group, keeper = plain.components(names, edges), {}
    assert edges
    for i, t in docs:
        for k, line in enumerate((t or "").split("\n") if i is not None and t is not None else ()):
            if norm(line):
                g = group[norm(line)]
                keeper[g] = min(keeper.get(g, (10**9, 0)), (i, k))
    want = []
    for i, t in docs:
        stay = t if i is None or t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not norm(x) or keeper[group[norm(x)]] == (i, k))
        want.append((i, stay))
    out = line_dedup.deduplicate(table(spark, docs))
    assert sorted_rows(out.toDF(*[f"k{k}" for k in range(len(out.columns))]).select("k0", "k1")) == sorted(want, key=repr)
    assert out.columns == [*table(spark, docs).columns, "n_lines", "n_removed"]


def test_edit_similarity(spark):
    r = random.Random(13)
    pairs = []
    for _ in range(400):
        w = [r.choice(["a", "bb", "ccc", "dd e", "é"]) for _ in range(r.randint(1, 9))]
        v = list(w)
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(v) + 1)
            v[k : k + r.randint(0, 2)] = r.choice([[], ["zz"], ["a", "q"]])
        x, y = " ".join(w), " ".join(v)
        if x != y and x.strip() and y.strip():
            pairs.append((x, y))
    pairs += [(" ".join(w), " ".join(v)) for w in (t.split(" ") for t in prose(14, 200, most=150)) for v in [[r.choice([x, x, x, x, "zz", ""]) for x in w]] if v != w]
    code = lambda c: [x.alias(f"{c}_{n}") for x, n in zip(line_dedup.coded(c), ("code", "widest"))]
    df = spark.createDataFrame(pairs, "x string, y string").select("x", "y", *code("x"), *code("y"))
    df = df.select("*", F.length("x").alias("m"), F.length("y").alias("n")).select("x", "y", line_dedup.similar("x", "y").alias("s"), line_dedup.surely("m", "n", "x_code", "y_code", "x_widest", "y_widest").alias("sure"))
    for row in df.collect():
        assert row["s"] == (plain.levenshtein(row["x"], row["y"]) <= int(round(max(len(row["x"]), len(row["y"])) * 0.2, 6))), row
        assert row["s"] or not row["sure"], row


@pytest.mark.parametrize("least, most, changes", [(8, 12, 1), (21, 40, 1), (81, 160, 1), (100, 160, 12)])
def test_line_dedup_finds_edited_lines(spark, least, most, changes):
    """Lines with words replaced, by brute-force edit similarity: all but a few per cent are found, whatever the length."""
    r = random.Random(least)
    known = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 8))) for _ in range(2000)]
    pairs = []
    while len(pairs) < 120:
        w = [r.choice(known) for _ in range(r.randint(least, most))]
        v = list(w)
        for k in r.sample(range(len(w)), changes):
            v[k] = r.choice(known)
        x, y = " ".join(w), " ".join(v)
        if x != y and plain.levenshtein(x, y) <= int(round(max(len(x), len(y)) * 0.2, 6)):
            pairs.append((x, y))
    out = line_dedup.deduplicate(spark.createDataFrame([(2 * k + j, line) for k, p in enumerate(pairs) for j, line in enumerate(p)], DOCS))
    removed = {x["doc_id"] for x in out.where("n_removed > 0").collect()}
    assert removed <= {2 * k + 1 for k in range(len(pairs))} and len(removed) >= 0.97 * len(pairs)


def test_line_dedup_of_long_lines(spark):
    """Lines over 4,000 characters: the same words in another order differ; 15 % of the words changed are still alike."""
    r = random.Random(4)
    known = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    w = [r.choice(known) for _ in range(900)]
    turned, changed = r.sample(w, len(w)), [r.choice(known) if k % 7 == 3 else x for k, x in enumerate(w)]
    x, y, z = (" ".join(v) for v in (w, turned, changed))
    allowed = int(round(max(len(x), len(z)) * 0.2, 6))
    assert min(len(x), len(y), len(z)) > 4000 and plain.levenshtein(x, z) <= allowed < plain.levenshtein(x, y)
    out = line_dedup.deduplicate(spark.createDataFrame([(1, x), (2, y), (3, z)], DOCS))
    assert {v["doc_id"]: v["n_removed"] for v in out.collect()} == {1: 0, 2: 0, 3: 1}


def test_line_dedup_is_native(spark):
    plan = line_dedup.different_lines(spark.createDataFrame([(1, "a\nb")], "id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.deduplicate(spark.createDataFrame([], DOCS)).count() == 0


def test_lines_of_one_list_that_hubs_do_not_connect(spark, monkeypatch):
    """Lines that are near each other but not near the list's ends are found by the second step."""
    prints = [(0, 0), (1, (1 << 30) - 1), (2, (1 << 29) - 1), (3, ((1 << 30) - 1) << 30), (4, ((1 << 23) - 1) << 40)]
    df = spark.createDataFrame([(i, fp, 100, [-7]) for i, fp in prints], "lid long, fp long, length int, sketch array<long>")
    want = [(a, b) for a, x in prints for b, y in prints if a < b and (x ^ y).bit_count() <= line_dedup.BITS["runs"]]
    assert want == [(1, 2), (3, 4)]
    for block in (512, 2):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        lists = line_dedup.key_lists(df)
        hubs = line_dedup.hub_pairs(df, lists)
        both = hubs.unionByName(line_dedup.other_pairs(df, lists, components.connected_components(hubs)))
        assert sorted(map(tuple, both.collect())) == want


def test_line_dedup_meets_each_pair_in_one_list(spark, monkeypatch):
    # 12 lines of groups of their own under the same two keys, in blocks of 4
    rows = [(lid, lid << 20, 50, [-9, -4]) for lid in range(12)]
    prints = spark.createDataFrame(rows, "lid long, fp long, length int, sketch array<long>")
    met = []
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    monkeypatch.setattr(DataFrame, "distinct", lambda df: met.append(df.count()) or df)
    found = line_dedup.candidates(prints, line_dedup.key_lists(prints), spark.createDataFrame([], "node long, component long"))
    assert met == [66] and found.count() == 66


def test_line_dedup_bounds_pairs_by_their_characters(spark):
    """Lines whose characters' counts forbid the similarity become no candidates; no similar pair is lost by that."""
    r = random.Random(31)
    words = [w for t in prose(32, 60, most=80) for w in t.lower().split()]
    pairs = [("e" * 3_000 + "é", "e" * 2_900), ("日本語" * 9, "日本語" * 8 + "字字字"), ("a" * 10, "a" * 8 + "bb"), ("a" * 10, "a" * 7 + "bbb")]
    for _ in range(300):
        x = " ".join(r.choice(words) for _ in range(r.randint(3, 30)))
        y = "".join(r.choice(["", r.choice("etaoin é1"), c + "s", "zq"]) if r.random() < r.choice([0.1, 0.2, 0.3]) else c for c in x)
        pairs.append((x, y or "-"))
    df = spark.createDataFrame(pairs, "x string, y string").select("x", "y", F.length("x").alias("m"), F.length("y").alias("n"), line_dedup.counts("x").alias("bx"), line_dedup.counts("y").alias("by"))
    got = {(v["x"], v["y"]): v["may"] for v in df.select("x", "y", line_dedup._may_be_alike("bx", "by", "m", "n").alias("may")).collect()}
    for (x, y), may in got.items():
        assert may or plain.levenshtein(x, y) > int(round(max(len(x), len(y)) * 0.2, 6)), (x, y)
    assert got[pairs[2]] and not got[pairs[3]] and sum(not v for v in got.values()) > 20

    # three lines of one list, none near the first: of the other two pairs the counts allow one
    rows = [(0, "x" * 50, (1 << 30) - 1), (1, "a" * 50, 0), (2, "a" * 45 + "b" * 5, 1), (3, "c" * 50, 3)]
    lines = spark.createDataFrame([x[:2] for x in rows], "lid long, norm string")
    prints = spark.createDataFrame([(lid, fp, 50, [-7]) for lid, _, fp in rows], "lid long, fp long, length int, sketch array<long>")
    none = spark.createDataFrame([], "node long, component long")
    lists = line_dedup.key_lists(prints)
    assert [(x["a"], x["b"]) for x in line_dedup.candidates(prints, lists, none, lines=lines).collect()] == [(1, 2)]
    assert line_dedup.candidates(prints, lists, none).count() == 3


def test_line_dedup_counts_characters_beyond_the_basic_plane_once(spark):
    # 20 % of the code points changed, but more of the UTF-16 units; and 24 % of them, but fewer of the units
    x, y = "\U0001f600" * 8 + "a" * 32, "b" * 8 + "a" * 32
    u, v = "\U0001f600" * 30 + "a" * 12 + "c" * 8, "\U0001f600" * 30 + "b" * 12 + "c" * 8
    df = spark.createDataFrame([(x, y), (u, v)], "x string, y string")
    assert [r["s"] for r in df.select(line_dedup.similar("x", "y").alias("s")).collect()] == [True, False]


def test_packing_works_out_no_offsets_of_plain_words():
    import public_tokenizers

    tokens = packing.Tokens(public_tokenizers.path("word_bpe_49k.json"))
    whole = tokens.tokenizer

    class Fast:
        def encode_batch_fast(self, texts, add_special_tokens):
            return whole.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    tokens.tokenizer = Fast()  # has no encode()
    texts = ["Some words, it's 42 of them", "", "qzxv été some words"]
    ids, bounds = tokens(*_bytes.texts(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [whole.encode(x, add_special_tokens=False).ids for x in texts]


def test_line_dedup_keeps_no_tables_but_its_result(spark):
    """What the steps save goes again; only the groups stay, which the result reads."""
    import os

    rows = [(k, "\n".join(prose(60 + k % 7, 3, most=60))) for k in range(30)]
    folder = _common.shared_folder(spark).removeprefix("file://") + "/tideline"
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    assert line_dedup.deduplicate(spark.createDataFrame(rows, DOCS)).count() == 30
    assert {n.split("-")[0] for n in set(os.listdir(folder)) - before} <= {"groups"}


def test_nearest_candidates_come_first(spark):
    """All candidates are settled, but pairs of lines that others have joined by then are not verified."""
    nodes = range(40)  # a line of nodes: neighbours are alike, the others are candidates only
    rows = [(a, b, b - a) for a in nodes for b in nodes if a < b] + [(a, 100, 15) for a in nodes]
    verified = []

    def verify(pairs):
        got = [tuple(x) for x in pairs.collect()]
        verified.extend(got)
        return _common.save(spark.createDataFrame([(a, b) for a, b in got if b - a == 1 or (a, b) == (3, 100)], "a long, b long"), "good")

    labels = _common.save(spark.createDataFrame([(200, 200), (201, 200), (39, 39), (300, 39)], "node long, component long"), "labels")
    found = line_dedup.settled(_common.save(spark.createDataFrame(rows, "a long, b long, apart int"), "found"), labels, verify)
    got = {x["node"]: x["component"] for x in found.collect()}
    assert got == {n: 0 for n in [*nodes, 100, 300]} | {200: 200, 201: 200}
    assert len(verified) == len(set(verified)) <= 80 < len(rows)


@pytest.mark.parametrize("least, most", [(2, 6), (40, 90)])
def test_line_dedup_finds_lines_without_spaces(spark, least, most):
    """Lines of one long word with some letters changed."""
    r = random.Random(least)
    pairs = []
    for _ in range(60):
        x = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(r.randint(10 * least, 10 * most)))
        k = r.randrange(len(x))
        pairs.append((x, x[:k] + "abc"[: 1 + len(x) // 40] + x[k + 1 :]))
    out = line_dedup.deduplicate(spark.createDataFrame([(2 * k + j, line) for k, p in enumerate(pairs) for j, line in enumerate(p)], DOCS))
    removed = {x["doc_id"] for x in out.where("n_removed > 0").collect()}
    assert removed <= {2 * k + 1 for k in range(60)} and len(removed) >= 57


def test_two_groups_of_many_lines_keep_their_first(spark):
    """One group holds most lines; its first line stays, in the document with the smallest id."""
    line = " ".join(prose(41, 1, most=60)[0].split() + [f"word{k}" for k in range(20)])
    rows = [(1000 - k, "\n".join([f"{line} {k % 7}", "another line altogether", line])) for k in range(300)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    assert got[701] == f"{line} {299 % 7}\nanother line altogether" and {v for k, v in got.items() if k != 701} == {""}


# 3
def test_simhash_groups(spark, monkeypatch):
    texts = prose(7, 40, most=200)
    docs = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t.replace(" ", "  ").upper()) for i, t in enumerate(texts[:10])]
    docs += [(200 + i, texts[0] + f" tail{i}") for i in range(60)] + [r for r in ODD if r[0] is not None]
    want = plain.near_groups(docs, 3)
    for block in (1024, 4):
        monkeypatch.setattr(simhash_neardup, "BLOCK", block)
        got = {r["id"]: (r["fp"] % 2**64, r["component"]) for r in simhash_neardup.groups(table(spark, docs), shingle=3).collect()}
        assert got == want
    assert len({g for _, g in want.values()}) < len(want)


def test_simhash_of_null_ids_and_keep_first(spark):
    docs = [(5, "a b c d"), (2, "a b c d"), (9, "x y z w q"), *ODD]
    got = simhash_neardup.groups(table(spark, docs), shingle=5)
    assert got.count() == len(docs)
    assert [r["component"] for r in got.where("id is null").collect()].count(907) == 1
    kept = simhash_neardup.keep_first(table(spark, docs))
    ids = [r["doc_id"] for r in kept.collect()]
    assert 5 not in ids and ids.count(2) == 1 and ids.count(907) == 2 and ids.count(None) == 2 and 901 in ids and 902 not in ids
    assert simhash_neardup.groups(spark.createDataFrame([], DOCS)).count() == 0


def test_keep_first_by_similarity(spark):
    """Groups by brute-force Jaccard of five-word shingles; near copies, many bits apart, go."""
    r = random.Random(8)
    texts = prose(17, 30, most=200)
    docs = [(i, t) for i, t in enumerate(texts)]
    for i, t in enumerate(texts):
        w = t.split(" ")
        for k in range(3):
            v = list(w)
            for _ in range(k + 1 + len(w) // 60):
                v[r.randrange(len(v))] = "other"
            docs.append((100 * (k + 1) + i, " ".join(v)))
    docs += [(900, texts[0].upper()), (901, None), (902, ""), (903, "a b"), (904, "A  b")]
    sets = {i: {" ".join(w[k : k + 5]) for w in [plain.SPACED.findall((t or "").translate(plain.LOW))] for k in range(max(len(w) - 4, min(len(w), 1)))} for i, t in docs}
    like = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    ids = sorted(sets)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if like(sets[a], sets[b])]
    group = plain.components(ids, edges)
    prints = {i: plain.simhash(t, 5) for i, t in docs}
    assert sum((prints[a] ^ prints[b]).bit_count() > 3 for a, b in edges) > 10
    kept = simhash_neardup.keep_first(table(spark, [*docs, (None, texts[0])]), by_similarity=True)
    assert sorted((x["doc_id"] for x in kept.collect()), key=str) == sorted([*set(group.values()), None], key=str)
    assert simhash_neardup.keep_first(spark.createDataFrame([], DOCS), by_similarity=True).count() == 0


def test_keep_first_by_similarity_asks_the_positional_index(spark, monkeypatch):
    """Pairs within 3 bits come from the index: with the lists of smallest hashes taken away they are still found."""
    words = prose(23, 1, vocabulary=3000, most=4)[0].split() + [f"w{k}" for k in range(1500)]
    docs = [(1, " ".join(words)), (2, " ".join([*words, "tail"])), (3, " ".join(prose(24, 1)))]
    assert 0 < (plain.simhash(docs[0][1], 5) ^ plain.simhash(docs[1][1], 5)).bit_count() <= 3
    none = lambda prints, *_: prints.select(prints["lid"].alias("a"), prints["lid"].alias("b")).where("false")
    monkeypatch.setattr(line_dedup, "hub_pairs", none)
    monkeypatch.setattr(line_dedup, "key_lists", lambda prints: prints.selectExpr("lid key", "3L n").where("false"))
    assert sorted(x["doc_id"] for x in simhash_neardup.keep_first(spark.createDataFrame(docs, DOCS), by_similarity=True).collect()) == [1, 3]


def test_parities_pass_every_similar_pair(spark):
    """Sets of Jaccard similarity 0.8 and more pass the bound by parities; most others don't."""
    r = np.random.default_rng(3)
    rows, alike = [], []
    for n in (1, 5, 40, 300, 1500):
        for changed in (0.0, 0.05, 0.1, 0.11, 0.5, 0.9):
            x = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            y = np.unique(np.concatenate((x[int(changed * len(x)) :], r.integers(0, 2**63, int(changed * len(x))).astype(np.uint64))))
            rows.append((simhash_neardup._odd(x).tolist(), simhash_neardup._odd(y).tolist(), len(x), len(y)))
            common = len(np.intersect1d(x, y))
            alike.append(common >= 0.8 * (len(x) + len(y) - common))
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k int, x array<long>, y array<long>, m long, n long")
    got = [x["s"] for x in df.select("k", simhash_neardup._may_be_alike("x", "y", "m", "n").alias("s")).orderBy("k").collect()]
    assert all(s for s, same in zip(got, alike) if same) and sum(not s for s, same in zip(got, alike) if not same) >= 6


def test_long_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, 1001 + k) for k in range(500)]
    got = components.connected_components(spark.createDataFrame(chain + star + [(5000, 5000), (None, 3)], "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {k: 0 for k in range(301)} | {1000 + k: 1000 for k in range(501)}


# 4
URLS = [
    "http://a.Example.COM/en/7x", "https://com/en/", "http://xcom/en/1", "x://b.com/en", "http://example.net/de/8?q#f", "http://sub.example.net:80/de/9", "http://u@org/es/x", "no scheme com/en/", "", None,
    "http://org?/es/", "http://org#/es/", "http://org", "ftp://a//b://org/es/", "http://.com/en/1", "http://com./en/1", "http://é.org/es/ü",
]


def by_hand(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([k for k in map(rest.find, "/?#") if k >= 0] + [len(rest)])
    host, path = rest[:cut].translate(plain.LOW), rest[cut:]
    path = path[: min([k for k in map(path.find, "?#") if k >= 0] + [len(path)])]
    fits = [(len((h + p).encode()), len(h.encode()), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


@pytest.mark.parametrize("rules", [Q.URL_RULES, [], [("com", "", "block"), ("com", "", "allow"), ("a.b", "/x", "block"), ("b", "/x/y", "allow"), ("", "/en/", "block")]])
def test_url_filter(spark, rules):
    urls = [*URLS, "http://a.b/x/y", "http://q.a.b/xx", "http://z.com"]
    df = table(spark, list(enumerate(urls)), "page_id long, url string")
    got = {r["id"]: tuple(r)[1:] for r in url_filter.judge(df, rules).collect()}
    assert got == {k: by_hand(u, rules) for k, u in enumerate(urls)}


def test_url_digests_that_collide(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(url_filter, "_digest", lambda data: len(data) % 3)
    url_filter.write_rules(Q.URL_RULES, str(tmp_path / "rules"))
    rules = url_filter.Rules(str(tmp_path / "rules"))
    for u in URLS:
        host, path, rule, _ = by_hand(u, Q.URL_RULES)
        k = rules.judge([host], [path])[0]
        assert (bytes(rules.text[rules.at[k] : rules.at[k + 1]]).decode() if k >= 0 else None) == rule


def test_url_filter_of_an_empty_table(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), Q.URL_RULES).count() == 0


def test_bad_verdicts_are_refused(tmp_path):
    with pytest.raises(ValueError):
        url_filter.write_rules([("com", "/", "maybe")], str(tmp_path / "r"))


# 5
def test_tokens_are_the_tokenizers(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    theirs, mine = Tokenizer.from_file(path), packing.Tokens(path)
    r = random.Random(1)
    alphabet = "abcXYZ''''''  \n\tstmdrevel0123!.,<|>é ÉÈñß¿«½ªµ \u0085\x1cǅİΑΣς漢字́ŸŠ"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += ["it's we'll they're I'd'x 's't ''s !'s 'then a'b", "<|endoftext|> a", "", "'", "a'", "'\n's", *(chr(c) + x for c in range(1, 0x300) for x in ("", "a", "1 "))]
    ids, bounds = mine(*_bytes.texts(pa.array(texts, pa.string())))
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == theirs.encode(t, add_special_tokens=False).ids, t


def bins_of_plain(lengths, capacity):
    import bisect

    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, x)
        room, n = (rooms.pop(k), n) if k < len(rooms) else (capacity, n + 1)
        if room - x:
            bisect.insort(rooms, room - x)
    return n


def test_plan_is_best_fit_decreasing():
    from collections import Counter

    r = random.Random(2)
    for _ in range(200):
        capacity = r.choice([7, 20, 64, 2048])
        lengths = [r.randint(1, capacity) if r.random() < 0.7 else min(capacity, 5) for _ in range(r.randint(0, 300))]
        steps, n = packing.plan(Counter(lengths), capacity)
        assert n == bins_of_plain(lengths, capacity)
        bins = {}
        for x, c in Counter(lengths).items():
            own = steps[steps[:, 0] == x]
            for q in range(c):
                _, first, at, each, offset = own[np.searchsorted(own[:, 1], q, "right") - 1]
                bins.setdefault(at + (q - first) // each, []).append((offset + (q - first) % each * x, x))
        for parts in bins.values():
            at = 0
            for offset, x in sorted(parts):
                assert offset == at
                at += x
            assert at <= capacity


def test_packing_round_trip(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    docs = [(i, t) for i, t in enumerate(prose(8, 60, most=400))] + ODD
    rows = packing.pack(table(spark, docs), path, capacity=256, with_ids=True).collect()
    theirs = Tokenizer.from_file(path)
    want = sorted([*theirs.encode(t or "", add_special_tokens=False).ids, 0] for _, t in docs)
    sequences, whole = {}, {}
    for r in rows:
        assert r["length"] == len(r["ids"]) <= 256 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["start"] == 256 * r["piece"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["id"] is not None and r["id"] != 907:
            whole.setdefault(r["id"], []).append((r["piece"], r["ids"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    texts = {i: t for i, t in docs if i is not None}
    for i, parts in whole.items():
        assert [x for _, ids in sorted(parts) for x in ids] == [*theirs.encode(texts[i] or "", add_special_tokens=False).ids, 0]
    assert sum(r["length"] for r in rows) == sum(map(len, want))
    assert len(sequences) == bins_of_plain([r["length"] for r in rows], 256)
    assert packing.pack(spark.createDataFrame([], DOCS), path).count() == 0


# 6
def test_collection_marks_repeats():
    r = random.Random(2)
    for _ in range(150):
        texts = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 30))]
        data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(x) for x in texts])
        ids, length = np.array([r.randint(0, 9) for _ in texts]), r.randint(1, 5)
        least = {}
        for i, x in zip(ids, texts):
            for o in range(len(x) - length + 1):
                least[x[o : o + length]] = min(least.get(x[o : o + length], 99), i)
        want = sorted((k, o) for k, x in enumerate(texts) for o in range(len(x) - length + 1) if least[x[o : o + length]] < ids[k])
        assert sorted(zip(*(a.tolist() for a in suffix_dedup.repeated(data, bounds, ids, length)))) == want


@pytest.mark.parametrize("sizes", [{}, {"HOT": 2, "UNIT_BYTES": 4000, "BUCKET_SPANS": 100, "COLLECTION_BYTES": 2000}])
def test_suffix_dedup(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    r = random.Random(4)
    docs = [(i, "".join(r.choice("abcdefgh é") for _ in range(r.randint(0, 400)))) for i in range(40)]

    def glued():
        out = ""
        for _ in range(r.randint(1, 6)):
            t = r.choice(docs)[1]
            a = r.randint(0, max(0, len(t) - 1))
            out += t[a : a + r.randint(10, 120)]
        return out

    docs += [(40 + i, glued()) for i in range(100)] + [(300, "a" * 500), (301, "a" * 49), (302, "a" * 50), (303, "xy" * 200), (304, "b" + "xy" * 100), (None, docs[3][1]), (7, docs[8][1]), (8, docs[8][1])]
    docs += [r for r in ODD if r[0] != 906]
    got = suffix_dedup.deduplicate(table(spark, docs))
    want = sorted(plain.suffix_dedup(docs), key=repr)
    assert sorted_rows(got.drop("kept")) == want and sum(x[2] for x in want)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_suffix_dedup_of_an_empty_table(spark):
    assert suffix_dedup.deduplicate(spark.createDataFrame([], DOCS)).count() == 0


# 7, 8, 10
def labelled(spark, make, n=400):
    docs = [(i, make(i, i % 4 == 0)) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(0, n, 1)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality(spark):
    texts = prose(9, 400)
    docs, labels = labelled(spark, lambda i, bad: " ".join(w + "###" for w in texts[i].split()) if bad else texts[i] + ".")
    df = table(spark, docs + ODD)
    model = quality_mil.learn(df, labels)
    got = quality_mil.score(df, model)
    assert got.count() == len(docs) + len(ODD)
    held = [r for r in got.collect() if r["id"] is not None and r["id"] < 400 and zlib.crc32(str(r["id"]).encode()) % 5 == 0]
    assert sum((r["score"] >= 0.3) == (r["id"] % 4 != 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    none = quality_mil.learn(df, labels.limit(0))
    assert none is None and {r["score"] for r in quality_mil.score(df, none).collect()} == {0.5}
    assert quality_mil.score(spark.createDataFrame([], DOCS), model).count() == 0


def test_toxicity(spark):
    texts = prose(10, 400, vocabulary=3000)
    docs, labels = labelled(spark, lambda i, bad: texts[i] + (f" nastyword{i % 7} {texts[i - 1]}" if bad else " kind"))
    df = table(spark, docs + ODD)
    model = toxicity_kn.learn(df, labels)
    got = toxicity_kn.score(df, model).collect()
    held = [r for r in got if r["id"] is not None and r["id"] < 400 and zlib.crc32(str(r["id"]).encode()) % 4 == 2]
    assert sum((r["score"] >= 0.3) == (r["id"] % 4 == 0) for r in held) >= 0.9 * len(held) and len(got) == len(docs) + len(ODD)
    assert all(r["score"] >= 0.3 for r in held if r["id"] % 4 == 0)
    # an unseen word with a known beginning still counts
    new = spark.createDataFrame([(1, texts[1] + " nastyword999"), (2, texts[1])], DOCS)
    a, b = (r["score"] for r in toxicity_kn.score(new, model).orderBy("id").collect())
    assert a >= 0.3 > b
    none = toxicity_kn.learn(df, labels.limit(0))
    assert none is None and {r["score"] for r in toxicity_kn.score(df, none).collect()} == {0.0}
    assert toxicity_kn.score(spark.createDataFrame([], DOCS), model).count() == 0


def _plain_contexts(texts):
    """{word: classes of the words before it}"""
    out = {}
    for t in texts:
        before = None
        for word in plain.words(t):
            b = np.frombuffer(word.encode(), np.uint8)
            h = _bytes.hashes(b, np.array([0]), np.array([len(b)]))
            out.setdefault(word.encode(), set()).add(63 if before is None else int(_bytes.mix(before)[0] % np.uint64(63)))
            before = h
    return out


def test_contexts_count_each_word_of_the_corpus_once(spark):
    texts = prose(31, 60, vocabulary=50) + ["Été naïve ÉTÉ", "", None, "A a AB"]
    want = {k: sum(1 << c for c in v) for k, v in _plain_contexts(texts).items()}
    for parts in (1, 7):
        docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 2)], DOCS).repartition(parts)
        assert {bytes(r["word"]): r["seen"] % 2**64 for r in toxicity_kn.contexts(docs).collect()} == want


def _lookup(texts):
    """Shared counts from plain contexts."""
    seen = {k: len(v) for k, v in _plain_contexts(texts).items()}

    def of(words):
        stems = sorted({w[: toxicity_kn.STEM] for w in words.to_pylist()})
        sums = [sum(n for w, n in seen.items() if w[: toxicity_kn.STEM] == s) for s in stems]
        return toxicity_kn.Shared(words, np.array([seen[w] for w in words.to_pylist()]), pa.array(stems, pa.binary()), np.array(sums), float(sum(seen.values())))

    return of


@pytest.mark.parametrize("discount", [0.75, 3.0])
def test_kneser_ney_against_plain_counts(monkeypatch, discount):
    """Probabilities equal a plain model's over dicts and sum to 1 over the words after every context."""
    monkeypatch.setattr(toxicity_kn, "DISCOUNT", discount)
    texts = prose(32, 40, vocabulary=25, most=40)
    y = np.array([k % 3 == 0 for k in range(40)]).astype(int)
    of = _lookup(texts)
    c = toxicity_kn.Counts(texts, y)
    model = toxicity_kn.Model(c, of(c.spelled))
    merged = toxicity_kn.Counts.merged([toxicity_kn.Counts(texts[k::2], y[k::2]) for k in (0, 1)])
    seen = {k: len(v) for k, v in _plain_contexts(texts).items()}
    vocabulary, total, stem = sorted(seen), sum(seen.values()), lambda w: w[: toxicity_kn.STEM]
    runs = [set(), set()]
    for t, v in zip(texts, y):
        w = [None, None, *(x.encode() for x in plain.words(t))]
        runs[1 - v] |= set(zip(w, w[1:], w[2:]))
    pairs = [{} for _ in runs]
    for k, own in enumerate(runs):
        for _, a, b in own:
            pairs[k][a, b] = pairs[k].get((a, b), 0) + 1
    words = [{w: len({a for a, b in p if b == w}) for w in vocabulary} for p in pairs]
    stems = [{s: sum(n for w, n in own.items() if stem(w) == s) for s in {stem(w) for w in vocabulary}} for own in words]

    def mixed(counts, lower):
        """counts: of each class {item: n}; lower: of each class {item: p}"""
        free = sum(min(n, discount) for c in counts for n in c.values()) / max(1, sum(n for c in counts for n in c.values()))
        out = []
        for k in (0, 1):
            left = {x: max(n - discount, 0) for x, n in counts[k].items()}
            out.append({x: (1 - free) * left.get(x, 0) / sum(left.values()) + free * p for x, p in lower[k].items()} if sum(left.values()) else dict(lower[k]))
        return out

    share = {s: sum(seen[w] for w in vocabulary if stem(w) == s) / total for s in stems[0]}
    p_stem = mixed(stems, [share, share])
    p_word = mixed(words, [{w: p_stem[k][stem(w)] * seen[w] / total / share[stem(w)] for w in vocabulary} for k in (0, 1)])
    for a in {a for p in pairs for a, _ in p}:
        after = mixed([{b: n for (x, b), n in p.items() if x == a} for p in pairs], p_word)
        assert all(abs(sum(p.values()) - 1) < 1e-9 for p in after)
        for m in (model, toxicity_kn.Model(merged, of(merged.spelled))):
            for b in vocabulary:
                if a is not None:
                    w = toxicity_kn.Words(np.frombuffer(a + b" " + b, np.uint8), np.array([0, len(a) + 1 + len(b)]))
                    assert abs(m.gains(w)[1] - np.log(after[0][b] / after[1][b])) < 1e-5


def test_toxicity_does_not_depend_on_partitions(spark):
    texts = prose(33, 200, vocabulary=300)
    docs, labels = labelled(spark, lambda i, bad: texts[i] + (f" nasty{i % 5}" if bad else ""), 200)
    scores = []
    for parts in (1, 16):
        df = spark.createDataFrame(docs, DOCS).repartition(parts)
        scores.append({r["id"]: r["score"] for r in toxicity_kn.score(df, toxicity_kn.learn(df, labels)).collect()})
    assert all(abs(scores[0][k] - scores[1][k]) < 1e-9 for k in scores[0])


def test_toxicity_counts_all_labelled_rows(spark, monkeypatch):
    """What is learned from tables equals a plain count of ALL labelled rows, however many; no sample stands for them."""
    monkeypatch.setattr(toxicity_kn, "PASSES", 3)
    r = random.Random(41)
    known = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 8))) for _ in range(30)]
    docs = [(i, " ".join(r.choice(known[:20] if i % 3 else known[10:]) for _ in range(r.randint(2, 12)))) for i in range(6000)] + [(1, "once more"), (9001, None)]
    toxic = lambda i: int(i % 3 == 0)
    labels = spark.createDataFrame([(i, toxic(i)) for i in range(6000)] + [(9001, 1)], "doc_id long, toxic int")
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    model = toxicity_kn.learn(df, labels)
    rows = [(t, toxic(i)) for i, t in docs if t is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    assert min(sum(y == v for _, y in rows) for v in (0, 1)) > 1000 and sum(y == 0 for _, y in rows) > 2000
    counts = toxicity_kn.Counts([t for t, _ in rows], np.array([y for _, y in rows]))
    want = toxicity_kn.Model(counts, _lookup([t for _, t in docs])(counts.spelled))
    buf, offsets = toxicity_kn._batch([*[t for _, t in docs], "never seen words", known[0] + "zz"])
    w = toxicity_kn.Words(buf, offsets)
    assert len(model.pairs.keys) > 100 and np.array_equal(np.sort(model.pairs.keys), np.sort(want.pairs.keys))
    assert np.abs(model.gains(w) - want.gains(w)).max() < 1e-6


def test_language(spark):
    r = random.Random(11)
    tongues = {"aa": "bcdfgaeiou", "bb": "klmnpäöü", "cc": "qrstvéèê"}
    docs = [(i, " ".join("".join(r.choice(tongues[lang]) for _ in range(r.randint(2, 9))) for _ in range(r.randint(1, 60))), lang) for i, lang in enumerate(sorted(tongues) * 60)]
    docs += [(*d, None if k % 2 else "aa") for k, d in enumerate(ODD)] + [(950, "123 !!", "bb")]
    df = table(spark, docs, "doc_id long, text string, lang string")
    model = language_id.learn(df)
    got = {r["id"]: r for r in language_id.identify(df, model).collect() if r["id"] is not None}
    held = [d for d in docs if d[0] is not None and d[0] < 180 and zlib.crc32(str(d[0]).encode()) % 5 == 0]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in held) >= 0.95 * len(held)
    assert {got[i]["lang_pred"] for i in (901, 902, 903, 950)} == {"und"} and got[904]["lang_pred"] != "und"
    kept = language_id.keep_identified(df, model)
    assert kept.columns == df.columns and kept.where("doc_id in (901, 902, 903, 950)").count() == 0 and kept.where("doc_id < 180").count() >= 175
    none = language_id.learn(df.limit(0))
    assert none is None and {r["lang_pred"] for r in language_id.identify(df, none).collect()} == {"und"}
    assert language_id.identify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


# 9
def test_repetition(spark):
    r = random.Random(12)
    texts = [" ".join(r.choice("a b c d e ff gg".split()) + r.choice(["", "", "#", "\n", ","]) for _ in range(r.randint(0, 90))) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(100, "line one\nline one\n \nline one "), (101, "x y z w " * 30), *(o for o in ODD if o[0] != 906)]
    got = {}
    for row in repetition_rules.judge(table(spark, docs)).collect():
        got.setdefault(row["id"], []).append(row)
    for i, t in docs:
        want = plain.repetition(t)
        for row in got[i] if i is not None else ():
            assert {k: row[k] for k in want} == want, (i, t)
            assert row["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
            assert not (row["base_failed"] and row["kept"])
    assert repetition_rules.judge(spark.createDataFrame([], DOCS)).count() == 0


def test_repetition_verdict(spark):
    """The covered fraction and the longest repeat decide, each by itself."""
    r = random.Random(21)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    a, b, c = fresh(40), fresh(101), fresh(100)
    docs = [(1, " ".join(fresh(100) + a + fresh(200) + a)), (2, " ".join(a + fresh(60) + a)), (3, " ".join(b + fresh(900) + b)), (4, " ".join(c + fresh(900) + c)), (5, " ".join(fresh(60)))]
    got = {x["id"]: x for x in repetition_rules.judge(spark.createDataFrame(docs, DOCS)).collect()}
    for i, t in docs:
        want = plain.repetition(t)
        bad = want["n_covered"] > 0.3 * want["n_words"] or want["longest_repeat"] > 100
        assert got[i]["repetition_failed"] == bad and got[i]["kept"] == (not bad and not got[i]["base_failed"])
    assert [got[k]["kept"] for k in range(1, 6)] == [True, False, False, True, True]


@pytest.mark.parametrize("kept", [1 << 21, 10])
def test_long_repetitive_texts(monkeypatch, kept):
    """Repetitive texts, with the ranks kept and with prefixes followed, against known counts."""
    monkeypatch.setattr(repetition_rules, "KEPT", kept)
    n = 60_000
    texts = ["a b " * (n // 2), "x " * 500, " ".join(f"u{k}" for k in range(3000)) + " u1 u2 u3"]
    buf, offsets = _bytes.texts(pa.array(texts, pa.string()))
    got = repetition_rules.measure(buf, offsets, 8)
    assert got["longest_repeat"].tolist() == [n - 2, 499, 3] and got["n_covered"].tolist() == [n, 500, 0] and got["n_repeat_words"].tolist() == [n, 500, 6]


def thue_morse(n, a, b):
    """Two texts of n letters, each the other with its letters exchanged: equal under any polynomial hash modulo 2 ** 64."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def few_hashes(monkeypatch):
    """Hashes of 3 bits: nearly all words collide."""
    real = _bytes.hashes
    monkeypatch.setattr(_bytes, "hashes", lambda *args: real(*args) & np.uint64(7))


def test_numbers_tell_all_spans_apart(monkeypatch):
    r = random.Random(3)
    for stubbed in (False, True):
        if stubbed:
            few_hashes(monkeypatch)
        words = ["".join(r.choice("ab") for _ in range(r.randint(1, 5))) for _ in range(300)] + list(thue_morse(2048, "a", "b")) * 2
        buf = np.frombuffer(" ".join(words).encode(), np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = ends - [len(w) for w in words]
        number, first = _bytes.numbers(buf, starts, ends)
        assert len(set(zip(words, number.tolist()))) == len(set(words)) == len(set(number.tolist()))
        assert all(words[first[n]] == w for w, n in zip(words, number.tolist()))


@pytest.mark.parametrize("stubbed", [False, True])
def test_strings_whose_hashes_collide(spark, monkeypatch, stubbed):
    """Words and lines that share a hash are told apart by op1, op5 and op9."""
    if stubbed:
        few_hashes(monkeypatch)
    x, y = thue_morse(2048, "a", "b")
    texts = [f"{x}\n{y}", x, y, "some words and some words", f"{x} one {y}", *prose(51, 12, vocabulary=40, most=30)]
    buf, offsets = _bytes.texts(pa.array(texts, pa.string()))
    got = repetition_rules.measure(buf, offsets, 8)
    for k, t in enumerate(texts):
        want = plain.repetition(t)
        assert {name: int(got[name][k]) for name in want} == want
    bench = [(k, t) for k, t in enumerate([x, y, f"{x} one", *texts[5:9]])]
    block = decontamination.Block([str(k) for k, _ in bench], [t for _, t in bench], 3)
    shard = decontamination.Shard(buf, offsets)
    hit, rows = shard.find(block)
    want = list(plain.decontaminated(list(enumerate(texts)), bench, 3))
    sums = np.concatenate(([0], np.cumsum(hit)))
    assert [int(sums[b] - sums[a]) for a, b in zip(shard.bounds, shard.bounds[1:])] == [w[2] for w in want]
    assert [len({i for d, i, *_ in rows.tolist() if d == k}) for k in range(len(texts))] == [w[3] for w in want]
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    theirs = Tokenizer.from_file(path)
    ids, bounds = packing.Tokens(path)(buf, offsets)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_other_tokenizer_files_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "t.json"))
    ids, bounds = packing.Tokens(str(tmp_path / "t.json"))(*_bytes.texts(pa.array(["a b", "", "B a", None], pa.string())))
    assert ids.tolist() == [0, 1, 2, 0] and bounds.tolist() == [0, 2, 2, 4, 4]


def test_very_long_texts(spark):
    """A text of 400,000 characters, twice, beside short ones, through every operator."""
    r = random.Random(71)
    words = [f"{w}{r.randrange(10**6)}" for w in prose(72, 1, most=400)[0].split()]
    long = " ".join(r.choice(words) if k % 50 else "word" + str(k) for k in range(50_000))
    assert len(long) > 400_000
    docs = spark.createDataFrame([(1, long), (2, long), (3, "a short text"), (4, None)], DOCS)
    n = len(plain.words(long))
    found = {x["id"]: x for x in decontamination.inspect(docs, spark.createDataFrame([(9, " ".join(long.split()[20_000:20_030]))], "item_id long, text string")).collect()}
    assert found[1]["n_words"] == n and found[1]["n_hit"] >= 30 and found[1]["matches"][0]["words"] == 30 and found[3]["n_hit"] == 0
    assert {x["doc_id"]: x["n_removed"] for x in line_dedup.deduplicate(docs).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
    assert {x["id"]: x["component"] for x in simhash_neardup.groups(docs, shingle=3).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {x["id"]: (x["n_removed"], x["n_bytes"]) for x in suffix_dedup.deduplicate(docs).collect()} == {1: (0, len(long)), 2: (len(long), len(long)), 3: (0, 12), 4: (0, 0)}
    judged = {x["id"]: x for x in repetition_rules.judge(docs).collect()}
    assert judged[1]["n_words"] == judged[2]["n_words"] == 50_000 and judged[1]["longest_repeat"] == judged[2]["longest_repeat"]
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    size = len(Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(long, add_special_tokens=False).ids) + 1
    packed = packing.pack(docs, P.path("word_bpe_49k.json")).groupBy("id").agg(F.sum("length").alias("n")).collect()
    assert {x["id"]: x["n"] for x in packed}[1] == size
    rows = [(t, k % 2) for k, t in enumerate(prose(73, 20))]
    quality, kn, tongue = quality_mil.fit(rows, epochs=1), toxicity_kn.fit(rows, _lookup([t for t, _ in rows])), language_id.fit([(t, "ab"[v]) for t, v in rows], buckets=64, width=4)
    for scored in (quality_mil.score(docs, quality), toxicity_kn.score(docs, kn), language_id.identify(docs, tongue)):
        by = {x["id"]: x["score"] for x in scored.collect()}
        assert by[1] == by[2] and all(0 <= v <= 1 for v in by.values())


# helpers
def test_temporary_tables_go_at_the_end_of_a_block(spark):
    import os

    with _common.temporary(spark):
        kept = line_dedup.deduplicate(spark.createDataFrame([(1, "a b c\na b c")], DOCS)).collect()
        made = _common.save(spark.range(3), "some")
        path = made._tideline_path.removeprefix("file://")
        assert made.count() == 3 and os.path.exists(path)
    assert kept[0]["text"] == "a b c" and not os.path.exists(path) and not _common._open


def test_lookup_is_exact():
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(0, 2**63, 5000).astype(np.uint64)) & ~np.uint64(0xFFF)
    keys = np.unique(keys)
    look = _bytes.Lookup(keys, np.arange(len(keys)))
    assert (look(keys, -1) == np.arange(len(keys))).all() and (look(keys + np.uint64(1), -1) == -1).all()
    assert len(_bytes.Lookup(keys[:0], np.zeros(0, int))(keys, -1)) == len(keys)


def test_column_names_that_differ_in_case(spark):
    df = spark.createDataFrame([(1, "a b", "c")], "DOC_ID long, Text string, other string")
    assert language_id.identify(df, None).count() == 1


def test_labelled_sample_is_bounded(spark):
    """An id that is repeated counts once; of too many labels the most frequent stay, of as many the first by name."""
    rows = [(1, f"text {k % 50:02}", "x") for k in range(20_000)] + [(2, "b", "x"), (3, "c", "y"), (4, "d", "z"), (None, "e", "z"), (5, None, "z"), (6, "f", None)]
    df = spark.createDataFrame(rows, "id long, text string, label string").repartition(4)
    assert sorted(map(tuple, _common.labelled_sample(df, 10, 1 << 20, "label"))) == [(1, "text 00", "x"), (2, "b", "x"), (3, "c", "y"), (4, "d", "z")]
    assert {r["label"] for r in _common.labelled_sample(df, 10, 1 << 20, "label", most_labels=2)} == {"x", "y"}
    assert len(_common.labelled_sample(df, 1, 1 << 20, "label")) == 3 and _common.labelled_sample(df.limit(0), 10, 1 << 20, "label") == []


def test_quality_gradients():
    """The backward pass against finite differences, over bags of several passages."""
    r = np.random.default_rng(5)
    bags, y = np.array([1, 3, 2]), np.array([1.0, 0.0, 1.0])
    x = r.normal(size=(6, quality_mil.FEATURES))
    p = {"W": r.normal(0, 0.3, (quality_mil.FEATURES, 4)), "w0": r.normal(size=4), "V": r.normal(size=(4, 3)), "U": r.normal(size=(4, 3)), "a": r.normal(size=3), "c": r.normal(size=4), "c0": np.array(0.2)}

    def loss(q):
        prob = quality_mil._forward(q, x, bags)[0]
        return -(y * np.log(prob) + (1 - y) * np.log(1 - prob)).mean()

    grad = quality_mil.gradients(p, x, bags, y)
    for name, value in p.items():
        for at in list(np.ndindex(value.shape))[:: max(1, value.size // 12)]:
            near = []
            for step in (1e-5, -1e-5):
                q = dict(p)
                q[name] = value.copy()
                q[name][at] += step
                near.append(loss(q))
            assert abs((near[0] - near[1]) / 2e-5 - grad[name][at]) < 1e-6, (name, at)


def test_quality_scores_against_a_plain_bag(spark):
    """Each text alone, passage by passage, attention worked out by hand, gives the score of the whole batch."""
    texts = prose(61, 30, most=300) + ["", "a"]
    model = quality_mil.fit([(t, k % 2) for k, t in enumerate(texts)], epochs=2)
    got = model.score(*quality_mil.encode(*_bytes.texts(pa.array(texts, pa.string()))))
    q = model.weights
    for t, score in zip(texts, got):
        x, bags = quality_mil.encode(*_bytes.texts(pa.array([t], pa.string())))
        assert bags[0] == max(1, -(-len(t.split()) // quality_mil.PASSAGE))
        h = [np.tanh((row - model.mean) / model.scale @ q["W"] + q["w0"]) for row in x]
        s = np.array([(np.tanh(v @ q["V"]) / (1 + np.exp(-(v @ q["U"])))) @ q["a"] for v in h])
        w = np.exp(s) / np.exp(s).sum()
        assert abs(1 / (1 + np.exp(-(sum(a * v for a, v in zip(w, h)) @ q["c"] + q["c0"]))) - score) < 1e-9


def test_language_scores_against_a_plain_mean():
    """The mean of a text's subwords' weights, worked out window by window."""
    texts = ["Äpfel und Birnen", "un été à la mer", "x", "12 a1b", "AbC abc"]
    model = language_id.fit([(t, "ab"[k % 2]) for k, t in enumerate(texts * 4)], buckets=64, width=4)
    buf, offsets = _bytes.texts(pa.array(texts, pa.string()))
    got = language_id.logits(model, buf, offsets)
    for k, t in enumerate(texts):
        data = t.encode()
        counts = [int(b) for at, found in language_id.subwords(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 64) for b in found]
        want = model.weights[counts].astype(float).mean(axis=0) + model.bias if counts else model.bias
        assert np.allclose(got[k], want)


def test_labelled_sample_takes_every_label(spark):
    rows = [(k, f"text {k}", f"l{k % 1100:04}") for k in range(3300)]
    got = _common.labelled_sample(spark.createDataFrame(rows, "id long, text string, label string").repartition(5), 2, 1 << 20, "label")
    assert len(got) == 2200 and {r["label"] for r in got} == {f"l{k:04}" for k in range(1100)}
    assert sorted(map(tuple, got)) == sorted(map(tuple, _common.labelled_sample(spark.createDataFrame(rows[::-1], "id long, text string, label string"), 2, 1 << 20, "label")))
