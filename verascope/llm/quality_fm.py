"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's size.

Pairwise interactions have low rank, and the sum-of-squares identity scores them in time linear in the
features: half of the squared sums less the summed squares. Trained on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verascope.llm.tokens import NOT_SPACE, portions, words

STATISTICS = 16
_BYTE = np.arange(256)
_KINDS = [
    (_BYTE >= 65) & (_BYTE <= 90),
    (_BYTE >= 97) & (_BYTE <= 122),
    (_BYTE >= 48) & (_BYTE <= 57),
    np.isin(_BYTE, list(b".,;:'\"-()")),
    np.isin(_BYTE, list(b"!?")),
    np.isin(_BYTE, list(b"#*$%&|<>@_=+~^{}[]\\/")),
    _BYTE >= 128,
    _BYTE == 10,
]


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the labelled sample that is collected for training."""

    bits: int = 16
    rank: int = 8
    max_rows: int = 6000
    epochs: int = 8
    rate: float = 0.05
    l2: float = 1e-4
    init: float = 0.05


def features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of a portion, by text. Words have the weight sqrt(count) / sqrt(words); statistics come last."""
    found = words(texts, NOT_SPACE)
    n_texts = len(texts)
    n_words = np.diff(found.first)
    text_of = found.text_of()
    slot = (found.hashes >> np.uint64(64 - bits)).astype(np.int64)
    pair, count = np.unique(text_of << bits | slot, return_counts=True)
    text, feature = pair >> bits, pair & ((1 << bits) - 1)
    value = np.sqrt(count / n_words[text])

    sizes = np.fromiter(map(len, texts), np.int64, n_texts)
    bounds = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    safe = np.maximum(sizes, 1)
    stats = np.zeros((n_texts, STATISTICS))
    for k, table in enumerate(_KINDS):
        totals = np.concatenate(([0], np.cumsum(table[found.data], dtype=np.int64)))
        stats[:, k] = np.sqrt((totals[bounds + sizes] - totals[bounds]) / safe)
    length = (found.end - found.start).astype(np.float64)
    per = lambda x: np.bincount(text_of, x, n_texts) / np.maximum(n_words, 1)
    again = np.zeros(len(slot))
    if len(slot) > 1:
        again[1:] = (found.hashes[1:] == found.hashes[:-1]) & (text_of[1:] == text_of[:-1])
    mean = per(length)
    stats[:, 8] = mean / 10
    stats[:, 9] = np.sqrt(np.maximum(per(length * length) - mean**2, 0)) / 10
    stats[:, 10] = per(again)
    stats[:, 11] = np.bincount(text, minlength=n_texts) / np.maximum(n_words, 1)
    stats[:, 12] = np.log1p(n_words) / 10
    stats[:, 13] = np.log1p(sizes) / 10
    stats[:, 14] = np.sqrt(per(length > 20))
    stats[:, 15] = 1.0 * (n_words == 0)
    rows, cols = np.nonzero(stats)
    text, feature, value = np.concatenate([text, rows]), np.concatenate([feature, cols + (1 << bits)]), np.concatenate([value, stats[rows, cols]])
    order = np.argsort(text, kind="stable")
    return text[order], feature[order], value[order]


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    bits: int

    def scores(self, texts: list[bytes]) -> np.ndarray:
        text, feature, value = features(texts, self.bits)
        raw = np.full(len(texts), self.bias) + np.bincount(text, self.linear[feature] * value, len(texts))
        for f in range(self.factors.shape[1]):
            v = self.factors[feature, f] * value
            raw += 0.5 * (np.bincount(text, v, len(texts)) ** 2 - np.bincount(text, v * v, len(texts)))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings) -> Model:
    """AdaGrad on the logistic loss, row by row."""
    size = (1 << s.bits) + STATISTICS
    rng = np.random.default_rng(11)
    share = float(labels.mean()) if len(labels) else 0.5
    bias = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    w, v = np.zeros(size), rng.normal(0, s.init, (size, s.rank))
    gw, gv, gb = np.full(size, 1e-6), np.full((size, s.rank), 1e-6), 1e-6
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            vx = v[at] * x[:, None]
            sums = vx.sum(axis=0)
            raw = bias + w[at] @ x + 0.5 * ((sums**2).sum() - (vx * vx).sum())
            g = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[i]
            gb += g * g
            bias -= s.rate * g / np.sqrt(gb)
            dw = g * x + s.l2 * w[at]
            gw[at] += dw * dw
            w[at] -= s.rate * dw / np.sqrt(gw[at])
            dv = g * x[:, None] * (sums - vx) + s.l2 * v[at]
            gv[at] += dv * dv
            v[at] -= s.rate * dv / np.sqrt(gv[at])
    return Model(bias, w, v, s.bits)


def train(
    docs: DataFrame, labels: DataFrame, learnable: Column, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> Model:
    """Learns from rows of labels that are learnable (an expression over its columns) and have a 0/1 label and a document.

    More than max_rows are thinned by a hash of the id. The labels are joined to the documents; only texts of the
    sample are shuffled. Null labels, and ids that are null or on one side only, teach nothing; repeated rows count as
    often as they meet. Nothing to learn from gives a model that scores all texts near one half.
    """
    known = labels.where(learnable & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    total = known.count()
    bits = s.bits
    draw = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit(29)), F.lit(1 << 20))
    sample = known.where(draw < F.lit(int((1 << 20) * min(1.0, s.max_rows / max(total, 1)))))
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the sample holds about max_rows ids, so it is broadcast
    joined = d.join(F.broadcast(sample), "_id").select("text", "_y", F.xxhash64(F.col("_id").cast("string"), F.lit(31)).alias("order"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 0):
            text, feature, value = features([t.encode() for t in b.column(0).to_pylist()], bits)
            ends = np.searchsorted(text, np.arange(b.num_rows + 1))
            cut = lambda x, kind: pa.array([x[p:q] for p, q in zip(ends[:-1], ends[1:], strict=True)], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([cut(feature.astype(np.int32), pa.int32()), cut(value.astype(np.float32), pa.float32()), b.column(1), b.column(2)], ["at", "x", "y", "order"])

    got = joined.mapInArrow(run, "at array<int>, x array<float>, y int, order bigint").toPandas().sort_values("order", kind="stable")
    rows = [(np.asarray(a, np.int64), np.asarray(x, np.float64)) for a, x in zip(got["at"], got["x"], strict=True)]
    return fit(rows, got["y"].to_numpy(np.float64), s)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row; a null text scores as an empty one.

    A score at the threshold is predicted 1. Texts may have any length. Repeated rows and ids stay, a null doc_id too. Other
    columns are not read, so their names may clash. An empty table gives none.
    """
    source = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 1):
            p = model.scores([t.encode() for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return source.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
