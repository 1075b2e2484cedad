"""Corpus pipeline: language ID, near-dedup, decontamination, secret redaction, tokenization.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return
the columns that docs has, whatever their names, and an empty table for an empty table. Texts may have any length.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verascope.llm import bpe, decontaminate, langid, secrets, simhash
from verascope.llm.common import fold, table, written
from verascope.llm.queries import RANKS
from verascope.session import reachable


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determined language go: null, empty or letterless text, or a score under one half."""
    return langid.accepted(docs, langid.train(docs, fold("doc_id", 4) != 2))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, the document of least doc_id stays, with all rows of it that are in the group.

    Null and wordless texts are one group. Rows of a null doc_id stay. A row whose doc_id another text has, too, is judged by its own.
    """
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, others of their doc_id don't. Null and empty texts hold none; an empty benchmark takes nothing away.

    A null doc_id is one like others.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows. No document goes; null texts stay null."""
    forest = secrets.train(secrets.built_in_findings(spark))
    return secrets.redacted(docs, forest, length_col="n_chars" if "n_chars" in docs.columns else None)


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what stayed; a null text counts as empty, repeated rows each, rows without a doc_id, too."""
    return bpe.digests(bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


def _on_workers(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, with this package within reach of the session's Python workers."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(reachable(spark), docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _on_workers(language_id)),
    ("near_dedup", _on_workers(near_dedup)),
    ("decontamination", _on_workers(decontamination)),
    ("secret_scan", _on_workers(secret_scan)),
    ("tokenization", _on_workers(tokenization)),
]

#: Trained models and recursive contraction are beyond SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
