"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams are hashed into a fixed number of buckets. Document frequencies cover all learnable
rows. The model is trained by follow-the-regularised-leader with L1 and L2 penalties on a bounded sample,
spread over the languages, and its temperature is fitted on a part of that sample kept back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verascope.llm.tokens import portions

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """About sample_rows rows, shared evenly by all languages, or rows_per_lang of each if that is more, are collected; every fifth calibrates."""

    bits: int = 15
    sample_rows: int = 2400
    rows_per_lang: int = 300
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.5


def buckets(text: str, bits: int) -> np.ndarray:
    """Hash buckets of all 1-, 2- and 3-grams of the lower-cased text, repeats included."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    m1, m2, m3, shift = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(32 - bits)
    a, b = c * m1, c * m2
    two = a[:-1] ^ (b[1:] + np.uint32(0x7F4A7C15))
    three = (a[:-2] ^ (b[1:-1] << np.uint32(1))) * m3 + c[2:] * m2
    return np.concatenate([((a ^ (a >> np.uint32(15))) * m2) >> shift, (two * m3) >> shift, ((three ^ (three >> np.uint32(13))) * m1) >> shift])


def counts(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, 1 + ln of counts) of a text."""
    all_counts = np.bincount(buckets(text, bits), minlength=1 << bits)
    at = np.flatnonzero(all_counts)
    return at, 1 + np.log(all_counts[at])


def document_frequency(df: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts; over all rows of df (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << bits, np.int64), 0
        for b in batches:
            for x in b.column(0):
                mark = np.zeros(1 << bits, bool)
                mark[buckets(x.as_py() or "", bits)] = True
                seen += mark
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], ["b", "n"])

    rows = df.select("text").mapInArrow(run, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << bits, np.int64)
    real = rows[rows.b >= 0]
    out[real.b.to_numpy()] = real.n.to_numpy()
    return out, int(rows.n[rows.b < 0].sum())


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    bits: int

    def logits(self, text: str) -> np.ndarray:
        at, tf = counts(text, self.bits)
        x = tf * self.idf[at]
        norm = np.sqrt((x * x).sum())
        return (x / norm if norm else x) @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not any(map(str.isalpha, text)) or not self.langs:
            return UNDETERMINED, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        best = int(z.argmax())
        return self.langs[best], float(p[best] / p.sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_labels: int, size: int, s: Settings) -> np.ndarray:
    """Weights (size + 1, n_labels), the last row the intercept, by per-coordinate FTRL-proximal steps."""
    z, n = np.zeros((size + 1, n_labels)), np.zeros((size + 1, n_labels))

    def solve(at: np.ndarray) -> np.ndarray:
        over = np.sign(z[at]) * s.l1 - z[at]
        return np.where(np.abs(z[at]) <= s.l1, 0.0, over / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], size), np.append(rows[i][1], 1.0)
            w = solve(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - step * w
            n[at] += g * g
    return solve(np.arange(size + 1))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of logits that makes held-back labels likeliest."""

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), labels]).mean())

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    return float(min(grid, key=loss)) if len(logits) else 1.0


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists of a column, and where each list starts and the last one ends."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    starts = lists.offsets.to_numpy()
    return lists.values.to_numpy()[: starts[-1]], starts


def train(df: DataFrame, learnable: Column, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from rows that are learnable and have a text and a lang; nothing else of them is used.

    Repeated rows count as often as they occur. No learnable row gives a model without languages. Rows are drawn by a hash of
    id and text, so that a null id draws each of its texts by itself.
    """
    d = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), learnable.alias("ok"))
    d = d.where("ok and text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros(1 << s.bits), np.zeros(((1 << s.bits) + 1, 0)), 1.0, s.bits)
    df_counts, n = document_frequency(d, s.bits)
    idf = np.log((1 + n) / (1 + df_counts)) + 1
    langs = sorted(sizes)
    each = max(s.sample_rows / len(langs), s.rows_per_lang)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, each / sizes[lang]))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(17)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)
    bits = s.bits

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [counts(x.as_py(), bits) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0].astype(np.int32) for p in pairs], pa.list_(pa.int32())), pa.array([p[1].astype(np.float32) for p in pairs], pa.list_(pa.float32())), b.column(1), b.column(2)],
                ["at", "tf", "lang", "order"],
            )

    sample = d.where(F.col("lang").isin(langs)).where(draw).select("text", "lang", F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(23)).alias("order"))
    # numbers stay in Arrow's arrays: as objects of pandas they take the driver several times as much
    got = sample.mapInArrow(features, "at array<int>, tf array<float>, lang string, order bigint").toArrow().combine_chunks()
    order = np.argsort(got["order"].to_numpy(), kind="stable").tolist()
    drawn = got["lang"].to_pylist()
    rows, labels = [], np.array([langs.index(drawn[i]) for i in order], np.int64)
    (at, ends), (tf, _) = (_lists(got[name]) for name in ("at", "tf"))
    for i in order:
        one, x = at[ends[i] : ends[i + 1]], tf[ends[i] : ends[i + 1]]
        x = x.astype(np.float64) * idf[one]
        norm = np.sqrt((x * x).sum())
        rows.append((one, (x / norm if norm else x).astype(np.float32)))
    del got, tf
    kept_back = np.arange(len(rows)) % 5 == 4
    fit = np.flatnonzero(~kept_back)
    weights = ftrl([rows[i] for i in fit], labels[fit], len(langs), 1 << s.bits, s)
    rest = np.flatnonzero(kept_back)
    logits = np.array([rows[i][1] @ weights[rows[i][0]] + weights[-1] for i in rest]).reshape(len(rest), len(langs))
    return Model(langs, idf, weights, temperature(logits, labels[rest]), s.bits)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row.

    Null and empty texts and texts without a letter: 'und', 0; so all texts of a model without languages. Of equally likely
    languages the first by name. Texts may have any length: their counts take a fixed size. Repeated rows and ids stay, a null doc_id
    too. Other columns are not read, so their names may clash. An empty table gives none.
    """
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 1):
            done = [model.predict(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.float64())], ["doc_id", "lang_pred", "score"])

    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def accepted(df: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of df, whole, whose language is determined with min_score or more; null, empty and letterless texts go.

    Repeated rows, null ids and columns of any name stay as they are; an empty table stays empty.
    """
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, at):
            done = [model.predict(x) for x in b.column(at).to_pylist()]
            yield b.filter(pa.array([lang != UNDETERMINED and p >= min_score for lang, p in done], pa.bool_()))

    return df.mapInArrow(run, df.schema)
