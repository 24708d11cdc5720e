"""Quality by a factorisation machine.

Inputs of a score: hashed words (each occurrence weighs 1/number of words), statistics of the text's structure and
the metadata `n_chars`. The machine adds to a linear score the interaction of every pair of inputs, with rank-k
factors; the pairs' sum is half of (sum of v x)^2 - sum of (v x)^2 per factor, so a text is scored in time linear in
its words.

Edge cases: a null text is empty; a text without a word scores 0, as no text like it is fitted; statistics further from their mean than
MOST_DEVIATIONS standard deviations count as that far, in fitting and in scoring; a null n_chars counts as 0; a null id takes part, but not in fitting; repeated rows are scored row by row; an empty table gives an empty result; without labels of both
kinds every score is 0.5 or the labels' share; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import Adam, chunks, drop_kept, fold, labelled_sample, return_memory, segment_sums, sigmoid, utf8, words_of

BITS, RANK = 14, 4
MOST_DEVIATIONS = 4.0
_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_LETTER = _UPPER + _UPPER.lower() + bytes(range(128, 256))
_MARKS = b"!#$%&*|{}<>=/\\"
_SPACE = b" \t\n\r\x0b\x0c"


@dataclass
class Model:
    bias: float
    table: np.ndarray  # one row per bucket: RANK factors, linear weight
    dense: np.ndarray  # the same for each statistic
    mean: np.ndarray
    scale: np.ndarray


def _statistics(raw: bytes, n_words: int, n_distinct: int, n_chars: float) -> list[float]:
    n, k = max(1, len(raw)), max(1, n_words)

    def share(of: bytes) -> float:
        return (len(raw) - len(raw.translate(None, of))) / n

    lines = raw.split(b"\n")
    return [
        np.log1p(n_words), share(_UPPER), share(_DIGIT), share(_LETTER), share(_MARKS), share(_SPACE),
        len(raw.translate(None, _SPACE)) / k / 10, n_distinct / k, len(set(lines)) / len(lines), np.log1p(len(lines)), np.log1p(max(0.0, n_chars)),
    ]


def features(texts: list[str], n_chars: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word of all texts, words of each text, statistics of each text."""
    w = words_of(texts)
    stops = np.cumsum(w.counts)
    distinct = [len(np.unique(w.hashes[b - n : b])) for b, n in zip(stops, w.counts, strict=True)]
    stats = np.array([_statistics(utf8(t), *x) for t, *x in zip(texts, w.counts.tolist(), distinct, n_chars, strict=True)], np.float64)
    return (w.hashes & np.uint64((1 << BITS) - 1)).astype(np.int64), w.counts, stats


def _terms(table: np.ndarray, dense: np.ndarray, rows: np.ndarray, counts: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the sum of v x by factor, and linear part less half of the sum of (v x)^2."""
    v, each = table[rows], np.maximum(counts, 1)[:, None]
    own = np.concatenate([v, (v[:, :RANK] ** 2).sum(1, keepdims=True)], 1)
    sums = segment_sums(own, counts)
    total = sums[:, :RANK] / each + x @ dense[:, :RANK]
    squares = sums[:, -1:] / each**2 + (x * x) @ (dense[:, :RANK] ** 2).sum(1, keepdims=True)
    linear = sums[:, RANK : RANK + 1] / each + x @ dense[:, RANK:]
    return total, (linear - squares / 2)[:, 0]


def standard(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((stats - mean) / scale, -MOST_DEVIATIONS, MOST_DEVIATIONS)


def scores(model: Model, texts: list[str], n_chars: list[float]) -> np.ndarray:
    rows, counts, stats = features(texts, n_chars)
    total, rest = _terms(model.table, model.dense, rows, counts, standard(stats, model.mean, model.scale))
    return np.where(counts > 0, sigmoid(model.bias + rest + (total**2).sum(1) / 2), 0.0)


def train(texts: list[str], n_chars: list[float], y: np.ndarray, rounds: int = 80, rate: float = 0.05, ridge: float = 1e-3) -> Model:
    """Weights by gradient descent on the labels' log-likelihood, with a ridge penalty."""
    rng = np.random.default_rng(0)
    n_stats = len(_statistics(b"", 0, 0, 0))
    table, dense = np.zeros((1 << BITS, RANK + 1)), np.zeros((n_stats, RANK + 1))
    table[:, :RANK], dense[:, :RANK] = rng.normal(0, 0.05, (1 << BITS, RANK)), rng.normal(0, 0.05, (n_stats, RANK))
    if not len(texts) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(share / (1 - share))), table * 0, dense * 0, np.zeros(n_stats), np.ones(n_stats))
    rows, counts, stats = features(texts, n_chars)
    mean, scale = stats.mean(0), stats.std(0) + 1e-6
    x = standard(stats, mean, scale)
    doc_of = np.repeat(np.arange(len(counts)), counts)
    cells, times = np.unique(doc_of * (1 << BITS) + rows, return_counts=True)
    doc_of, rows = cells >> BITS, cells & ((1 << BITS) - 1)
    share = (times / np.maximum(counts, 1)[doc_of]).astype(np.float32)
    alone = (times / np.maximum(counts, 1)[doc_of] ** 2).astype(np.float32)
    per_doc = np.bincount(doc_of, minlength=len(counts))
    used, at = np.unique(rows, return_inverse=True)
    w, b = table[used], np.array([np.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    order = np.argsort(at, kind="stable")
    per_word = np.bincount(at, minlength=len(used))
    adam = Adam([w, dense, b], rate)
    for _ in range(rounds):
        v = w[at].astype(np.float32)
        total = segment_sums(v[:, :RANK] * share[:, None], per_doc) + x @ dense[:, :RANK]
        squares = segment_sums((v[:, :RANK] ** 2).sum(1) * alone, per_doc) + (x * x) @ (dense[:, :RANK] ** 2).sum(1)
        linear = segment_sums(v[:, RANK] * share, per_doc) + x @ dense[:, RANK]
        g = (sigmoid(b[0] + linear + ((total**2).sum(1) - squares) / 2) - y) / len(y)
        gt = g[:, None] * total
        by_cell = np.empty((len(at), RANK + 1), np.float32)
        by_cell[:, :RANK] = share[:, None] * gt[doc_of] - (alone * g[doc_of])[:, None] * v[:, :RANK]
        by_cell[:, RANK] = share * g[doc_of]
        gd = np.concatenate([x.T @ gt - ((x * x).T @ g)[:, None] * dense[:, :RANK], (x.T @ g)[:, None]], 1)
        adam.step([segment_sums(by_cell[order], per_word) + ridge / 10 * w, gd + ridge * dense, np.array([g.sum()])])
    table[used] = w
    return Model(float(b[0]), table, dense, mean, scale)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", most_rows: int = 2500, held_out: tuple[int, int] = (3, 1)) -> Model:
    """A model from at most about `most_rows` labelled rows whose crc32(id) mod held_out[0] is not held_out[1]."""
    usable = fold("_id", held_out[0]) != held_out[1]
    got = labelled_sample(docs, labels, label, usable, most_rows, id_col, text_col, (chars_col,)).toArrow().to_pandas().sort_values(["_id", "text"])
    model = train([t or "" for t in got["text"]], got[chars_col].fillna(0).tolist(), got["y"].to_numpy(np.float64))
    del got
    return_memory()  # of the driver
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """doc_id, score (of label 1) and predicted of every row of docs; one pass, no shuffle."""
    small = Model(model.bias, model.table.astype(np.float32), model.dense, model.mean, model.scale)
    shipped = docs.sparkSession.sparkContext.broadcast(small)
    schema = T.StructType.fromDDL("doc_id long, score double, predicted int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        model = shipped.value
        for batch in batches:
            for at, texts in chunks(batch, "text"):
                n_chars = [c or 0 for c in batch.column("n_chars").slice(at, len(texts)).to_pylist()]
                p = scores(model, texts, n_chars)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(chars_col).cast("double").alias("n_chars")]
    return docs.select(*cols).mapInArrow(run, schema)
