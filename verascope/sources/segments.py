"""A registry of ids far larger than a batch: immutable sorted segments, each with a stored filter.

A segment holds the ids of one run, or of several that were merged, in files of ascending ranges, and a blocked Bloom filter: an
id looks at one block of 512 bits. A batch meets a segment's filter in a join on block numbers; only ids that pass can be
known, and only files whose range holds one of them are opened. Segments of like size are merged once there are MERGE of them,
so there are few, and each id is rewritten a logarithmic number of times. What a run did counts once its manifest does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verascope.sources.sinks import Manifests

#: Bits a block and an id, and bits an id sets: about one id in 500 passes in vain.
BLOCK_BITS, ID_BITS, PROBES = 512, 16, 6
#: Segments of one size class that are merged, and how much larger the next class is.
MERGE = 4
_LANES = BLOCK_BITS // 64


def _probes(key: Column) -> list[tuple[Column, Column]]:
    """(lane, bit as a mask) of each probe within the id's block."""
    h = F.xxhash64(key, F.lit(7))
    out = []
    for k in range(PROBES):
        at = F.shiftrightunsigned(h, 9 * k).bitwiseAND(F.lit(BLOCK_BITS - 1).cast("long"))
        out.append((F.shiftright(at, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int"))))
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


class SegmentRegistry:
    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.manifests = Manifests(spark, self.path)

    def segments(self, upto: int) -> list[dict]:
        """Descriptions of the segments as of a run: name, count, blocks, files with their ranges."""
        return self.manifests.newest(upto) or []

    def _filter(self, ids: DataFrame, blocks: int) -> DataFrame:
        key = F.col(self.key)
        bits = F.explode(F.array(*[F.struct(lane.alias("lane"), mask.alias("mask")) for lane, mask in _probes(key)]))
        rows = ids.select(_block(key, blocks).alias("block"), bits.alias("b"))
        lanes = [F.coalesce(F.bit_or(F.when(F.col("b.lane") == k, F.col("b.mask"))), F.lit(0).cast("long")).alias(f"lane_{k}") for k in range(_LANES)]
        return rows.groupBy("block").agg(*lanes)

    def _write(self, name: str, ids: DataFrame) -> dict | None:
        at = f"{self.path}/{name}"
        ids.select(self.key).orderBy(self.key).write.mode("overwrite").parquet(f"{at}/ids")
        stored = self.spark.read.schema(ids.select(self.key).schema).parquet(f"{at}/ids")
        # a row for each file
        files = stored.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.min(self.key).alias("low"), F.max(self.key).alias("high")).collect()
        count = sum(f["n"] for f in files)
        if not count:
            return None
        blocks = math.ceil(count * ID_BITS / BLOCK_BITS)
        self._filter(stored, blocks).write.mode("overwrite").parquet(f"{at}/filter")
        # names as they lie in the folder, so that the registry can be moved
        return {"name": name, "count": count, "blocks": blocks, "files": [[f["file"].rsplit("/", 1)[1], f["low"], f["high"]] for f in sorted(files, key=lambda f: f["low"])]}

    def possible(self, ids: DataFrame, segment: dict) -> DataFrame:
        """The ids that a segment's ranges and filter don't rule out."""
        key = F.col(self.key)
        near = ids.where((key >= segment["files"][0][1]) & (key <= segment["files"][-1][2])).withColumn("block", _block(key, segment["blocks"]))
        lanes = self.spark.read.schema("block long, " + ", ".join(f"lane_{k} long" for k in range(_LANES))).parquet(f"{self.path}/{segment['name']}/filter")
        met = near.join(lanes, "block").withColumn("lanes", F.array(*[f"lane_{k}" for k in range(_LANES)]))
        hit = F.lit(True)
        for lane, mask in _probes(key):
            hit = hit & (F.get("lanes", lane).bitwiseAND(mask) != 0)
        return met.where(hit).select(self.key)

    def files_for(self, ids: DataFrame, upto: int) -> list[str]:
        """The id files that must be opened to tell which of the ids are known: those whose range holds a possible one."""
        out = []
        for segment in self.segments(upto):
            lows = self.spark.createDataFrame([(i, f[1], f[2]) for i, f in enumerate(segment["files"])], f"file int, low {self._kind(ids)}, high {self._kind(ids)}")
            held = self.possible(ids, segment).join(F.broadcast(lows), (F.col(self.key) >= F.col("low")) & (F.col(self.key) <= F.col("high")))  # a row for each file
            out += [f"{self.path}/{segment['name']}/ids/{segment['files'][r['file']][0]}" for r in held.select("file").distinct().collect()]
        return sorted(out)

    def _kind(self, df: DataFrame) -> str:
        return df.schema[self.key].dataType.simpleString()

    def unseen(self, df: DataFrame, upto: int) -> DataFrame:
        """Rows of df whose id no segment holds as of a run; rows of a null id stay."""
        ids = df.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        files = self.files_for(ids, upto)
        if not files:
            return df
        known = self.spark.read.schema(ids.schema).parquet(*files)
        return df.join(known, self.key, "left_anti").select(*df.columns)

    def read(self, upto: int, like: DataFrame | None = None) -> DataFrame | None:
        """All ids as of a run; None before the first."""
        paths = [f"{self.path}/{s['name']}/ids" for s in self.segments(upto)]
        return self.spark.read.parquet(*paths) if paths else None

    def add(self, ids: DataFrame, run: int) -> None:
        """A segment of distinct ids that no other one has, and merges where MERGE segments are of like size; counts from its manifest on."""
        have = self.segments(run - 1)
        new = self._write(f"run={run}", ids)
        have = [*have, new] if new else have
        step = 0
        while group := self._alike(have):
            names = [s["name"] for s in group]
            merged = self._write(f"run={run}-{step}", self.spark.read.schema(ids.select(self.key).schema).parquet(*[f"{self.path}/{n}/ids" for n in names]))
            have, step = [s for s in have if s["name"] not in names] + [merged], step + 1
        self.manifests.write(run, have)

    def _alike(self, segments: list[dict]) -> list[dict]:
        by: dict[int, list[dict]] = {}
        for s in segments:
            by.setdefault(int(math.log(s["count"], MERGE)), []).append(s)
        return next((x for _, x in sorted(by.items()) if len(x) >= MERGE), [])
