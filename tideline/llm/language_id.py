"""Language identification: averaged embeddings of hashed subwords, a linear softmax, calibrated rejection.

A text is lower-cased (A-Z) and its bytes other than letters, digits' neighbours and non-ASCII become spaces; every
window of 2, 3 and 4 bytes that is not all spaces is a subword, hashed to one of `buckets` embeddings. The text's vector
is the mean of its subwords' embeddings; a linear softmax over it gives the language. Both layers are fitted by
stochastic gradient descent in numpy on a bounded sample of labelled rows; a held-back part of the sample sets the
softmax's temperature and the score below which a text is rejected.

Cases: null text and text without a letter give `und`, score 0.0, rejected. Without a labelled row every text does.
Equal scores go to the first language in sorted order. Repeated rows are scored alike, one row each; an empty table
gives an empty table. Columns other than the named ones are not read. A row with a null id is scored and never learned
from. A very long text is scored whole, as a piece of its own, at some 40 bytes a byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _bytes as B
from tideline.llm._common import filter_batches, labelled_sample, pick, place

_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = _LETTERS[128:] = True
_KEEP = np.where(_LETTERS, B.LOWER, np.uint8(32)).astype(np.uint8)
_KEEP[65:91] = np.arange(97, 123)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
SIZES = (2, 3, 4)


@dataclass
class Model:
    """weights: what each bucket adds to each language's score; bias, temperature and the rejection bound."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


def subwords(buf: np.ndarray, offsets: np.ndarray, buckets: int):
    """For each window size: where its windows start and their buckets; windows never pass the end of a text."""
    plain = _KEEP[buf].astype(np.uint32)
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets[1:]] = True
    rolled, blank, cut = plain, plain == 32, np.zeros(len(buf), bool)
    for size in range(2, max(SIZES) + 1):
        if len(plain) < size:
            return
        rolled = rolled[: len(plain) - size + 1] * np.uint32(257) + plain[size - 1 :]
        blank = blank[: len(rolled)] & (plain[size - 1 :] == 32)
        cut = cut[: len(rolled)] | edge[size - 1 : size - 1 + len(rolled)]
        if size in SIZES:
            at = np.flatnonzero(~(cut | blank))
            h = rolled[at] * np.uint32(0x9E3779B1) + np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield at, ((h ^ (h >> np.uint32(13))) % np.uint32(buckets)).astype(np.int64)


def logits(model: Model, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean over a text's subwords of their weights, plus the bias; one row for each text."""
    n = len(offsets) - 1
    total, count = np.zeros((n, len(model.languages))), np.zeros(n)
    for i, j in B.chunks(offsets, 1 << 21):
        part, own = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        for at, bucket in subwords(part, own, len(model.weights)):
            bounds = np.searchsorted(at, own)
            count[i:j] += np.diff(bounds)
            for k in range(len(model.languages)):
                sums = np.concatenate(([0.0], np.cumsum(model.weights[:, k][bucket], dtype=np.float64)))
                total[i:j, k] += np.diff(sums[bounds])
    return total / np.maximum(count, 1)[:, None] + model.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list, buckets: int = 1 << 15, width: int = 16, epochs: int = 4, rate: float = 0.5, wrong_rejections: float = 0.002) -> Model | None:
    """Fit on (text, language) rows. Every fifth row is kept for the temperature and the rejection bound, which lies
    where at most `wrong_rejections` of the rightly labelled kept rows would be rejected, and never above 0.5."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    random = np.random.default_rng(7)
    embed, out, bias = random.normal(0, 0.1, (buckets, width)), np.zeros((width, len(languages))), np.zeros(len(languages))
    seen = []
    for text, lang in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        found = [b for _, b in subwords(data, np.array([0, len(data)]), buckets)]
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        ids, counts = np.unique(flat, return_counts=True)
        seen.append((ids, counts / max(1, counts.sum()), languages.index(lang)))
    train = [x for k, x in enumerate(seen) if k % 5 or len(seen) < 10]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in random.permutation(len(train)):
            ids, share, label = train[k]
            mean = share @ embed[ids] if len(ids) else np.zeros(width)
            error = softmax((mean @ out + bias)[None])[0]
            error[label] -= 1
            back = out @ error
            out -= step * np.outer(mean, error)
            bias -= 0.02 * step * error
            if len(ids):
                embed[ids] -= (step * len(ids) ** 0.5) * share[:, None] * back[None, :]
    model = Model(languages, (embed @ out).astype(np.float32), bias, 1.0, 0.0)
    held = [x for k, x in enumerate(seen) if k % 5 == 0] or train
    raw = np.array([share @ model.weights[ids] + bias if len(ids) else bias for ids, share, _ in held])
    label = np.array([x[2] for x in held])
    losses = {t: -np.log(softmax(raw / t)[np.arange(len(label)), label] + 1e-12).mean() for t in np.geomspace(0.01, 2, 30)}
    model.temperature = float(min(losses, key=losses.get))
    p = softmax(raw / model.temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == label])
    model.reject_below = float(min(0.5, right[int(wrong_rejections * len(right))])) if len(right) else 0.0
    return model


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_mod: int = 5, rows_per_language: int = 500, max_bytes: int = 24 << 20, most_languages: int = 10_000) -> Model | None:
    """Fit on at most `rows_per_language` ids of each of the `most_languages` most frequent languages and `max_bytes` of
    text, from rows whose crc32(id as text) mod held_out_mod is not 0. The bounds make the sample as large for any corpus."""
    known = pick(docs, id=id_col, text=text_col, label=lang_col).where(F.crc32(F.col("id").cast("string")) % held_out_mod != 0)
    return fit([(r["text"], r["label"]) for r in labelled_sample(known, rows_per_language, max_bytes, "label", most_languages)])


def classify(model: Model | None, column: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
    """Language, score and rejection of each text of an Arrow string column."""
    buf, offsets = B.texts(column)
    n = len(column)
    lettered = np.diff(np.searchsorted(np.flatnonzero(_ASCII_LETTER[buf]), offsets)) > 0
    beyond = np.diff(np.searchsorted(np.flatnonzero(buf > 127), offsets)) > 0
    for k in np.flatnonzero(~lettered & beyond):
        lettered[k] = any(c.isalpha() for c in column[int(k)].as_py())
    if model is None or not n:
        return ["und"] * n, np.zeros(n), np.ones(n, bool)
    p = softmax(logits(model, buf, offsets) / model.temperature)
    score = np.where(lettered, p.max(axis=1), 0.0)
    names = np.where(lettered, np.array(model.languages, object)[p.argmax(axis=1)], "und")
    return names.tolist(), score, ~lettered | (score < model.reject_below)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and rejected for every row; the model is a few MB whatever the corpus."""
    data = pick(docs, id=id_col, text=text_col)
    kind = data.schema["id"].dataType.simpleString()
    shared = data.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            lang, score, rejected = classify(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"])

    return data.mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects; all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batch, names):
        return pa.array(~classify(shared.value, batch.column(place(names, text_col)))[2])

    return filter_batches(docs, keep)
