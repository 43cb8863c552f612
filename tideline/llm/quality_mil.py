"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of `PASSAGE` white-space words (the last may be shorter). A passage is encoded by how
often its bytes of each of 8 classes follow each other (64 shares), its mean word length, its share of words that
occurred before in the document, and its length. A tanh layer embeds a passage; gated attention (tanh times sigmoid)
weighs the passages, and the weighted mean is scored by a logistic unit. Weights are learned from document labels alone
by Adam in numpy on a bounded sample; every document is scored over all of its passages.

Cases: null or empty text is one passage without words. Repeated rows are scored alike, one row each. Without labelled
rows every score is 0.5. An empty table gives an empty table. Columns other than the named ones are not read. A row with a
null id is scored and never learned from. Of ties in the sample the smaller id goes first. A very long text is scored over
all its passages, as a piece of its own, at some 40 bytes a byte and 600 a passage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _bytes as B
from tideline.llm._common import labelled_sample, pick

PASSAGE = 64
#: Byte classes: 0 lower case, 1 upper case, 2 digit, 3 space, 4 line end, 5 prose punctuation, 6 other ASCII, 7 beyond ASCII.
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9]], _CLASS[[10, 11, 12, 13]] = 0, 1, 2, 3, 4
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 5
_CLASS[128:] = 7
FEATURES = 64 + 3


def encode(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages of each text (1 at least)."""
    n = len(offsets) - 1
    starts, ends = B.words(buf, offsets, B.NOT_SPACE)
    bounds = np.searchsorted(starts, offsets)
    per = np.diff(bounds)
    bags = np.maximum(1, -(-per // PASSAGE))
    first = np.concatenate(([0], np.cumsum(bags)))
    doc = np.repeat(np.arange(n), per)
    passage = first[doc] + (np.arange(len(starts)) - bounds[doc]) // PASSAGE
    total = int(first[-1])
    x = np.zeros((total, FEATURES))
    if len(starts):
        # a byte belongs to the passage of the last word that began; bytes before a text's first word to its first passage
        own = np.zeros(len(buf), np.int64)
        heads = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        at = np.concatenate((starts[heads], offsets[:-1][np.diff(offsets) > 0]))
        who = np.concatenate((passage[heads], first[:-1][np.diff(offsets) > 0]))
        order = np.lexsort((who, at))
        at, who = at[order], who[order]
        own = np.repeat(who, np.diff(np.concatenate((at, [len(buf)]))))
        kind = _CLASS[buf]
        same = own[1:] == own[:-1]
        pair = (own[:-1] * 64 + kind[:-1] * 8 + kind[1:])[same]
        x[:, :64] = np.bincount(pair, minlength=total * 64).reshape(total, 64)
        x[:, :64] /= np.maximum(1, x[:, :64].sum(axis=1, keepdims=True))
        count = np.bincount(passage, minlength=total)
        x[:, 64] = np.bincount(passage, ends - starts, total) / np.maximum(1, count) / 10
        key = B.hashes(B.LOWER[buf], starts, ends) ^ B.mix(doc.astype(np.uint64))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        x[:, 65] = np.bincount(passage, again, total) / np.maximum(1, count)
        x[:, 66] = np.minimum(count, PASSAGE) / PASSAGE
    return x, bags


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(p, x, bags):
    """Scores of the bags, and what the backward pass needs."""
    first = np.concatenate(([0], np.cumsum(bags)[:-1]))
    h = np.tanh(x @ p["W"] + p["w0"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    s = (t * g) @ p["a"]
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, first), bags))
    att = e / np.repeat(np.add.reduceat(e, first), bags)
    z = np.add.reduceat(att[:, None] * h, first, axis=0)
    return _sigmoid(z @ p["c"] + p["c0"]), (first, h, t, g, att, z)


def gradients(p, x, bags, y) -> dict:
    """Of the mean log loss of the bags' labels, by every weight."""
    prob, (first, h, t, g, att, z) = _forward(p, x, bags)
    dz0 = (prob - y) / len(y)
    grad = {"c": z.T @ dz0, "c0": dz0.sum()}
    dz = np.repeat(dz0[:, None] * p["c"], bags, axis=0)
    da = (dz * h).sum(axis=1)
    ds = att * (da - np.repeat(np.add.reduceat(att * da, first), bags))
    grad["a"] = (t * g).T @ ds
    dt, dg = ds[:, None] * p["a"] * g * (1 - t * t), ds[:, None] * p["a"] * t * g * (1 - g)
    grad["V"], grad["U"] = h.T @ dt, h.T @ dg
    dh = (att[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
    grad["W"], grad["w0"] = x.T @ dh, dh.sum(axis=0)
    return grad


class Model:
    """Standardisation and weights; score() takes encoded passages."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return _forward(self.weights, (x - self.mean) / self.scale, bags)[0] if len(bags) else np.zeros(0)


def fit(rows: list, hidden: int = 16, gate: int = 8, epochs: int = 30, rate: float = 0.01, batch: int = 128) -> Model | None:
    """Fit on (text, 0 or 1) rows; None without both labels."""
    if len({y for _, y in rows}) < 2:
        return None
    column = pa.array([t for t, _ in rows], pa.string())
    x, bags = encode(*B.texts(column))
    y = np.array([float(v) for _, v in rows])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    random = np.random.default_rng(11)
    shapes = {"W": (FEATURES, hidden), "w0": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "a": (gate,), "c": (hidden,), "c0": ()}
    p = {k: random.normal(0, 0.3, s) if len(s) == 2 or k in "ac" else np.zeros(s) for k, s in shapes.items()}
    m, v = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}
    begin = np.concatenate(([0], np.cumsum(bags)))
    step = 0
    for epoch in range(epochs):
        order = random.permutation(len(y))
        for k in range(0, len(order), batch):
            docs = order[k : k + batch]
            part, own = x[B.ranges(begin[docs], bags[docs])], bags[docs]
            grad = gradients(p, part, own, y[docs])
            grad["W"] += 1e-4 * p["W"]
            step += 1
            for name, q in grad.items():
                m[name] = 0.9 * m[name] + 0.1 * q
                v[name] = 0.999 * v[name] + 0.001 * q * q
                p[name] = p[name] - rate * (1 - epoch / epochs) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, p)


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", held_out_mod: int = 5, held_out: int = 0, rows_per_label: int = 1500, max_bytes: int = 32 << 20) -> Model | None:
    """Fit on at most `rows_per_label` rows of each label and `max_bytes` of text, from rows whose
    crc32(id as text) mod held_out_mod is not held_out. The bounds make the sample as large for any corpus."""
    return fit([(r["text"], r["label"]) for r in sample(docs, labels, label_col, id_col, text_col, held_out_mod, held_out, rows_per_label, max_bytes)])


def sample(docs, labels, label_col, id_col, text_col, held_out_mod, held_out, rows_per_label, max_bytes) -> list:
    """The bounded sample of labelled rows; a document with several label rows counts with its largest label."""
    marks = pick(labels, id=id_col, label=label_col).where(F.crc32(F.col("id").cast("string")) % held_out_mod != held_out)
    marks = marks.where(F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    ranked = [marks.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(rows_per_label) for v in (0, 1)]
    few = ranked[0].unionByName(ranked[1]).collect()  # at most two labels' rows
    if not few:
        return []
    known = docs.sparkSession.createDataFrame(few, marks.schema)
    return labelled_sample(pick(docs, id=id_col, text=text_col).join(F.broadcast(known), "id"), rows_per_label, max_bytes, "label")


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and number of passages for every row; the model is a few KB whatever the corpus."""
    data = pick(docs, id=id_col, text=text_col)
    shared = data.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            buf, offsets = B.texts(batch.column(1))
            scores, counts = [np.zeros(0)], [np.zeros(0, np.int64)]
            for i, j in B.chunks(offsets, 1 << 21):
                x, bags = encode(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                scores.append(model.score(x, bags) if model else np.full(j - i, 0.5))
                counts.append(bags)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores)), pa.array(np.concatenate(counts))], ["id", "score", "n_passages"])

    return data.mapInArrow(run, f"id {data.schema['id'].dataType.simpleString()}, score double, n_passages long")
