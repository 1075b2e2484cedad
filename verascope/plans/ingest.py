"""The whole path: bronze files to silver, new documents scored into gold, the daily and composite indices renewed.

A run is idempotent: documents in the registry are not scored again, so repeating it adds none. All that a run writes
counts with its commit, the last step: a run that fails anywhere before has changed nothing. Gold and the registry only
grow by the run's own rows; of the indices only the days that the run's documents fall on are read and written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verascope.functions.scalars import day_or
from verascope.functions.text import score_documents
from verascope.operators import dedup, index, ngrams, normalise, summary
from verascope.session import written
from verascope.sources.bronze import read_bronze
from verascope.sources.segments import SegmentRegistry
from verascope.sources.sinks import RunStore


@dataclass(frozen=True)
class Settings:
    """cap: the newest documents of one run that are scored, as the method has it; None scores all that are new."""

    as_of: date
    sources: tuple[str, ...] = tuple(normalise.NORMALISERS)
    cap: int | None = 6000
    smooth: int = 21
    min_docs: int = 10
    weights: dict[str, float] | None = field(default=None, hash=False)
    #: Medians and deviations of all of a day's documents; False has those of its last batch, as the method has it.
    exact: bool = True
    #: The optional model: a function from text to its sub-score (perplexity.scorer), and sources that go without.
    perplexity: Callable[[Column], Column] | None = field(default=None, hash=False)
    without_model: tuple[str, ...] = ("common_crawl",)
    #: A model of ngrams.train() instead, looked up by joins.
    language_model: ngrams.Model | None = field(default=None, hash=False)


def silver(spark: SparkSession, bronze: str, sources: tuple[str, ...]) -> DataFrame:
    """Documents of all sources, the first of equal hashes within each."""
    parts = []
    for s in sources:
        d = normalise.normalise(read_bronze(spark, bronze, s), s)
        if "position" not in d.columns:
            d = d.withColumn("position", F.lit(0))
        parts.append(dedup.keep_first(d, ["file", "line", "position"]))
    return normalise.silver(parts)


REPLACED = ("silver", "composite")
DATED = ("daily", "domains")


def run(spark: SparkSession, bronze: str, out: str, s: Settings) -> dict[str, DataFrame]:
    """Tables under out: silver, gold, registry, daily, domains, composite, and the state that daily comes from."""
    store = RunStore(spark, out)
    last = store.last()
    n = last + 1
    registry = SegmentRegistry(spark, f"{out}/registry")
    if last and registry.manifests.newest(last) is None:
        raise FileNotFoundError(f"PATH_NOT_FOUND: {out}/registry has no manifest up to run {last}")
    documents = store.write("silver", n, silver(spark, bronze, s.sources))
    fresh = registry.unseen(documents, last)
    fresh = dedup.keep_last(fresh, "doc_id", ["ingested_at", "content_hash"])
    if s.cap is not None:
        fresh = dedup.newest(fresh, s.cap)
    # a model never sees the texts of sources that go without
    judged = ~F.col("source").isin(list(s.without_model))
    if s.language_model is not None:
        fresh = written(fresh, "fresh")
        found = ngrams.scores(fresh.where(judged), s.language_model).withColumnRenamed("doc_id", "_judged")
        both = fresh.join(found, fresh["doc_id"].eqNullSafe(found["_judged"]), "left")
        scored = score_documents(both, perplexity=F.col("score_perplexity"), where=judged).drop("_judged")
    elif s.perplexity is None:
        scored = score_documents(fresh)
    else:
        scored = score_documents(fresh, perplexity=s.perplexity(F.when(judged, F.col("text"))), where=judged)
    batch = store.write("gold", n, scored)
    rows = batch.withColumn("date", day_or(F.col("created_dt"), F.lit(s.as_of)))
    # a row a day: of the tables by date only these days are read and written
    days = [r["date"] for r in rows.select("date").distinct().collect()]
    merged = _merged(store, "daily_state", days, index.daily_state(rows), index.merge_states)
    store.upsert("daily_state", n, merged)
    if s.exact:
        store.upsert("daily", n, index.daily_of_state(store.dated("daily_state", n, days), digits=3))
    else:
        store.upsert("daily", n, _merged(store, "daily", days, index.daily_index(rows, digits=3), index.merge_delta))
    store.upsert("domains", n, _merged(store, "domains", days, index.domain_index(rows, "doc_id"), index.merge_domain_delta))
    daily = store.dated("daily", n)
    store.write("composite", n, index.with_anomalies(index.smoothed(index.composite(daily, s.weights, s.min_docs), width=s.smooth)))
    registry.add(batch.select("doc_id").where("doc_id is not null").distinct(), n)
    store.commit(n, REPLACED, ("daily_state", *DATED))
    found = {name: store.current(name) for name in REPLACED} | {name: store.dated(name) for name in DATED}
    found |= {"gold": store.whole("gold"), "registry": registry.read(n)}
    return found | {"summary": summary.corpus_summary(found["gold"])}


def _merged(store: RunStore, name: str, days: list, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The rows of some days after a merge with what a dated table has for them."""
    old = store.dated(name, only=days)
    return new if old is None else merge(old, new).select(*new.columns)
