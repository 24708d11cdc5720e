"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its hashed words and word beginnings, less what an empty
sentence would score and scaled to reach 1; so a sentence without a weighted feature scores 0, and no number of them makes a document toxic. The document's score is
the noisy-or of its sentences' scores and of LEAK, the same for all. The weights are trained from document labels alone, by gradient descent on the
bags' likelihood, and the sentence scores then say where the offence is.

Edge cases: a null or empty text, and any text without a weighted feature, scores LEAK; ties and repeated rows are
scored row by row; a null id takes part, but not in fitting; an empty table gives an empty result; without labels every score is LEAK (nothing is toxic);
further columns of the input, and of labels, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import Adam, chunks, drop_kept, fold, groups_of, labelled_sample, return_memory, segment_sums, sigmoid, utf8, words_of

BITS = 18
#: Chance that a document is toxic whatever its sentences say.
LEAK = 0.01
_END = re.compile(r"[.!?\n]")
_ENDS = np.isin(np.arange(256), [*b".!?\n"])
#: Lengths in bytes of the beginnings of words that are features besides the words.
STEMS = (4, 5, 6)
#: ASCII letters lower-cased; all other ASCII but digits to blanks; bytes of longer characters stay.
_TABLE = bytes(ord(c.lower()) if (c := chr(i)).isascii() and c.isalnum() else 32 if i < 128 else i for i in range(256))


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, the sentence of each, and sentences of each document."""
    w = words_of(texts, _TABLE)
    marks, per_doc = [], []
    base = 0
    for t in texts:
        raw = np.frombuffer(utf8(t), np.uint8)
        ends = np.flatnonzero(_ENDS[raw])
        marks += [ends + base, [base + len(raw)]]
        per_doc.append(len(ends) + 1)
        base += len(raw) + 1
    sentence = np.searchsorted(np.concatenate(marks) if marks else np.zeros(0), w.starts)
    hashes, of = [w.hashes], [sentence]
    for n in STEMS:
        long, h = w.prefix(n)
        hashes.append(h)
        of.append(sentence[long])
    return (np.concatenate(hashes) & np.uint64((1 << BITS) - 1)).astype(np.int64), np.concatenate(of), np.array(per_doc, np.int64)


def sentence_scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of each document, of each sentence, and sentences of each document."""
    features, sent_of, per_doc = _bags(texts)
    heavy = np.flatnonzero(model.weights[features])
    cells = np.unique((sent_of[heavy] << BITS) + features[heavy])  # a feature counts once a sentence
    z = np.bincount(cells >> BITS, model.weights[cells & ((1 << BITS) - 1)], int(per_doc.sum())) + model.bias
    empty = np.logaddexp(0, model.bias)
    clean = np.maximum(np.logaddexp(0, z) - empty, 0)  # minus the logarithm of a sentence's chance to be clean
    return 1 - (1 - LEAK) * np.exp(-segment_sums(clean, per_doc)), -np.expm1(-clean), per_doc


def train(texts: list[str], y: np.ndarray, rounds: int = 150, rate: float = 0.15, penalty: float = 1.5) -> Model:
    """Weights, none negative, that make the labelled bags likeliest; the penalty on their sum leaves most at 0."""
    weights = np.zeros(1 << BITS, np.float64)
    if not len(texts) or not y.any():
        return Model(weights, -6.0)
    groups = list(groups_of(texts))

    def cells() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """First document, then sentence and feature of each distinct pair, and sentences of each document."""
        for at, some in groups:
            features, sent_of, per_doc = _bags(some)
            pairs = np.unique((sent_of << BITS) + features)
            yield at, pairs >> BITS, pairs & ((1 << BITS) - 1), per_doc

    # weights are never negative, so only what offensive documents hold more often than others can have one
    offensive, in_docs = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for at, sent_of, features, per_doc in cells():
        doc_of = np.repeat(np.arange(at, at + len(per_doc)), per_doc)[sent_of]
        pairs = np.unique((doc_of << BITS) + features)
        offensive += np.bincount(pairs & ((1 << BITS) - 1), y[pairs >> BITS], 1 << BITS)
        in_docs += np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS)
    keep = (offensive > 2) & (offensive > 1.5 * y.mean() * in_docs)
    kept, counts, n_sentences = [], [], 0
    for _, sent_of, features, per_doc in cells():
        usable = keep[features]
        kept.append((sent_of[usable] + n_sentences, features[usable]))
        counts.append(per_doc)
        n_sentences += int(per_doc.sum())
    sent_of, words, per_doc = np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept]), np.concatenate(counts)
    doc_of = np.repeat(np.arange(len(per_doc)), per_doc)
    used, at = np.unique(words, return_inverse=True)
    w, b = np.zeros(len(used)), np.array([-5.0])
    adam = Adam([w, b], rate)
    for _ in range(rounds):
        z = b[0] + np.bincount(sent_of, w[at], n_sentences)
        s = sigmoid(z)
        clean = np.bincount(doc_of, np.logaddexp(0, z) - np.logaddexp(0, b[0]), len(per_doc))
        p = 1 - (1 - LEAK) * np.exp(-clean)
        each = np.where(y > 0, -(1 - p) / p, 1.0)[doc_of]
        adam.step([np.bincount(at, (each * s)[sent_of], len(used)) + penalty, np.array([(each * (s - sigmoid(b[0]))).sum()])])
        np.maximum(w, 0, out=w)
    weights[used] = w
    return Model(weights, float(b[0]))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most_rows: int = 8000, held_out: tuple[int, int] = (5, 0)) -> Model:
    """A model from at most about `most_rows` labelled rows whose crc32(id) mod held_out[0] is not held_out[1]."""
    usable = fold("_id", held_out[0]) != held_out[1]
    got = labelled_sample(docs, labels, label, usable, most_rows, id_col, text_col).select("_id", "text", "y").toArrow().to_pandas()
    got = got.sort_values(["_id", "text"])
    model = train([t or "" for t in got["text"]], got["y"].to_numpy(np.float64))
    del got
    return_memory()  # of the driver
    return model


def offences(text: str, scores: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """(start, end, score) in code points of the sentences that score at least `least`."""
    bounds = [-1, *(m.start() for m in _END.finditer(text)), len(text)]
    return [(bounds[i] + 1, bounds[i + 1], float(scores[i])) for i in np.flatnonzero(scores >= least)]


OUT = "doc_id long, score double, predicted int, offences array<struct<start:int,end:int,score:double>>"


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, score, predicted and the offending sentences' spans of every row of docs; one pass, no shuffle."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.bias))
    schema = T.StructType.fromDDL(OUT)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        model = shipped.value
        for batch in batches:
            for at, texts in chunks(batch, "text"):
                p, s, per_doc = sentence_scores(model, texts)
                first = np.cumsum(per_doc) - per_doc
                worst = np.maximum.reduceat(s, first) if len(s) else s
                found = [
                    [dict(zip(("start", "end", "score"), x, strict=True)) for x in offences(t, s[i : i + n], least)] if w >= least else []
                    for t, i, n, w in zip(texts, first, per_doc, worst, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(found, spans)],
                    names=schema.names,
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
