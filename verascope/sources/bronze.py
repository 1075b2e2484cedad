"""Readers: bronze JSON lines, registries, web-archive text records, snapshots of small databases."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verascope.functions.scalars import CRAWL_CATEGORIES, content_hash, host, host_category, is_english
from verascope.sources.schemas import BRONZE, REGISTRY


def partition_of(path: Column, root: str) -> Column:
    """The directory of a file below root, joined by '/'; 'unknown' right at the root."""
    tail = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    below = F.regexp_replace(F.element_at(F.split(tail, _quoted(root.rstrip("/").split(":")[-1].lstrip("/")), 2), -1), r"^/+", "")
    return F.when(below == "", "unknown").otherwise(below)


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def read_bronze(spark: SparkSession, root: str, source: str) -> DataFrame:
    """(raw, keys, partition, file, line): valid JSON objects under root/source, with raw as the source's struct.

    Blank and malformed lines are skipped. keys holds the names that are present, which tells null from absent.
    line orders records within a file (split by split).
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(f"{root}/{source}")
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).where("trim(value) <> ''")
    return parse_lines(lines, source.split("/")[0]).withColumn("partition", partition_of(F.col("file"), f"{root}/{source}"))


def parse_lines(lines: DataFrame, source: str) -> DataFrame:
    """lines (value, ...) with raw and keys; rows that are no JSON object are left out.

    The record is the one entry of an exploded array: filters on its fields stay above, where otherwise each of them
    would parse the line again, and make it again if it is an expression.
    """
    rest = [c for c in lines.columns if c != "value"]
    lines = lines.select(*rest, F.explode(F.array("value")).alias("value"))
    # what is valid and starts so is an object
    ok = F.expr("try_parse_json(value) is not null") & F.col("value").rlike(r"^[ \t\n\r]*\{")
    parsed = lines.where(ok).select("*", F.explode(F.array(F.from_json("value", BRONZE[source]))).alias("raw")).where("raw is not null")
    return parsed.select(*rest, "raw", F.json_object_keys("value").alias("keys"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id) of the registry. A missing registry is an error: going on without would score everything again."""
    try:
        return spark.read.schema(REGISTRY).parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no registry at {path}") from e


def read_archive_paths(spark: SparkSession, path: str) -> DataFrame:
    """(path) lines of a gzipped index."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def read_archive_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(block, file, at) of web-archive text files; gzip is seen through."""
    blocks = spark.read.option("lineSep", "WARC/1.0\r\n").text(path)
    return blocks.select(F.col("value").alias("block"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))


def parse_archive_blocks(blocks: DataFrame, min_chars: int = 80, max_chars: int = 5000, per_file: int | None = 2000) -> DataFrame:
    """(url, domain, category, date, text, text_length, content_hash, file) of accepted conversion records.

    Hash and length are those of the whole body, which is then cut. per_file keeps a file's first accepted records.
    """
    parts = F.split("block", "\r\n\r\n", 2)
    d = blocks.withColumns({"head": parts[0], "body": F.regexp_replace(F.coalesce(F.get(parts, 1), F.lit("")), r"(?U)^\s+|\s+$", "")})
    field = lambda k: F.regexp_extract("head", rf"(?im)^{k}: *([^\r\n]*)", 1)
    d = d.where(field("WARC-Type") == "conversion").withColumns({"url": field("WARC-Target-URI"), "date": field("WARC-Date")})
    d = d.withColumn("domain", host(F.col("url")))
    d = d.where((F.col("url") != "") & (F.length("body") >= min_chars) & (F.col("domain") != "") & is_english(F.col("body")))
    out = d.select(
        "url", "domain", host_category(F.col("domain"), CRAWL_CATEGORIES).alias("category"), "date", F.substring("body", 1, max_chars).alias("text"), F.length("body").cast("long").alias("text_length"), content_hash(F.col("body")).alias("content_hash"), "file", "at",
    )
    if per_file is not None:
        from verascope.operators.dedup import head_per_group

        out = head_per_group(out, ["file"], ["at"], per_file)
    return out.drop("at")


def read_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a relational store by JDBC. Give partitionColumn, lowerBound, upperBound and numPartitions for large ones."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
