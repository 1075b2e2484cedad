"""Hard-negative mining: exact searches by inner product in vantage-point trees.

The top of one tree, fitted on a bounded sample, deals all rows into cells; a cell of more than CELL_ROWS rows is
dealt over several tasks by hash. Each task builds the tree of its rows and answers the anchors that reach the cell.
First an anchor's positives are found; their scores become windows, that is annuli around the anchor, and a
nearest-first traversal inside each annulus yields the first rows of another label. Sampled rows only bound how far an
anchor must look; every row is searched, and the result is that of brute force.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verascope.llm.common import written
from verascope.llm.vptree import VPTree, exact, matrix, scores

#: Rows that a task's tree holds, and sampled rows that the top of the tree is fitted on.
CELL_ROWS, SAMPLE_ROWS = 8192, 4096
#: Cells at most; beyond, cells are dealt over more tasks instead.
MOST_CELLS, MOST_PARTS = 512, 1 << 40
#: Greatest component after scaling: sums of 512 products stay below 2 ** 63.
GREATEST = 1 << 27
_ANY = (1 << 62) - 1


def _vectors(batch: pa.RecordBatch, column: int, dims: int) -> np.ndarray:
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return matrix(flat, np.diff(lists.offsets.to_numpy()), dims)


def prepared(df: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, label, v) of rows that take part, v: floor(scale * component); of rows that share an id the least."""
    v = F.col(vec_col)
    usable = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double") * scale) <= GREATEST, F.lit(False)))  # NaN exceeds all numbers
    rows = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & usable)
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), ints.alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")


class Index:
    """Rows (id, label, v) dealt into cells and parts in a written table, and the top of the tree that dealt them."""

    def __init__(self, rows: DataFrame, cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS) -> None:
        norm2 = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
        self.rows = written(rows, "vectors")
        n, dims, most = self.rows.agg(F.count("*"), F.max(F.size("v")), F.max(norm2)).first()
        self.n, self.dims, self.norm2 = n, max(1, dims or 0), most or 0
        sample = self.rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow().combine_chunks().to_batches()
        if not sample:
            self.dealt = None
            return
        points = _vectors(sample[0], 2, self.dims)
        cells = min(MOST_CELLS, -(-n // cell_rows))
        # a cell has two sampled rows or more, and halves with each level
        self.top = VPTree(points, self.norm2, leaf=2, depth=max(0, (cells - 1).bit_length()))
        self.seen = exact(points, self.norm2)
        self.seen_ids, self.seen_labels = sample[0].column(0).to_numpy(), sample[0].column(1).to_numpy()
        top, size = self.top, self.dims

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(top.routes(_vectors(b, 2, size))), *b.columns], ["cell", "id", "label", "v"])

        routed = written(self.rows.mapInArrow(route, "cell long, id long, label long, v array<int>"), "vector-cells")
        # a row for each cell, MOST_CELLS at most
        counts = routed.groupBy("cell").count().collect()
        self.parts = {r["cell"]: -(-r["count"] // cell_rows) for r in counts}
        parts = F.element_at(F.create_map(*[F.lit(x) for kv in self.parts.items() for x in kv]), F.col("cell"))
        self.dealt = routed.select((F.col("cell") * MOST_PARTS + F.pmod(F.xxhash64("id"), parts)).alias("place"), "id", "label", "v")

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, high, rank, id, score): for each query the first k rows of its label, or of others, in each window.

        queries: id, label, windows (array of struct low, high of scores), v. The query's own id is never returned.
        """
        top, parts, dims, norm2 = self.top, self.parts, self.dims, self.norm2
        seen, seen_ids, seen_labels = self.seen, self.seen_ids, self.seen_labels

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                vectors = _vectors(b, 3, dims)
                rows, places = [], []
                for i, (anchor, label, windows) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                    s = scores(seen, vectors[i])
                    s = s[((seen_labels == label) == same) & (seen_ids != anchor)]
                    cells: set[int] = set()
                    for w in windows:
                        within = s[(s >= w["low"]) & (s <= w["high"])]
                        # k sampled rows in the window: nothing below the k-th can be among the first k
                        low = int(np.partition(within, len(within) - k)[len(within) - k]) if len(within) >= k else w["low"]
                        cells.update(top.reached(vectors[i], low, w["high"]))
                    at = [c * MOST_PARTS + p for c in sorted(cells) for p in range(parts.get(c, 0))]
                    places += at
                    rows += [i] * len(at)
                for x in range(0, len(rows), 4096):
                    taken = b.take(pa.array(rows[x : x + 4096], pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(places[x : x + 4096], pa.int64()), *taken.columns], ["place", "id", "label", "windows", "v"])

        kind = "array<struct<low:long,high:long>>"
        visits = queries.select("id", "label", "windows", "v").mapInArrow(deal, f"place long, id long, label long, windows {kind}, v array<int>")
        homes = self.dealt.select("place", F.lit(False).alias("visits"), "id", "label", F.lit(None).cast(kind).alias("windows"), "v")
        met = homes.unionByName(visits.withColumn("visits", F.lit(True))).repartition("place").sortWithinPartitions("place", "visits", "id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, held, tree, ids, labels = None, [], None, None, None
            for b in batches:
                if not b.num_rows:
                    continue
                at, visiting = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero((at[1:] != at[:-1]) | (visiting[1:] != visiting[:-1])) + 1
                out: list[tuple] = []
                for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                    if at[x] != place:
                        place, held, tree = at[x], [], None
                    part = b.slice(x, y - x)
                    if not visiting[x]:
                        held.append((_vectors(part, 5, dims), part.column(2).to_numpy(), part.column(3).to_numpy()))
                        continue
                    if tree is None:
                        if not held:
                            continue
                        tree = VPTree(np.concatenate([h[0] for h in held]), norm2)
                        ids, labels = (np.concatenate([h[c] for h in held])[tree.order] for c in (1, 2))
                        held = held[:1]
                    vectors = _vectors(part, 5, dims)
                    for i, (anchor, label, windows) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)):
                        wanted, kept = ((labels == label) == same) & (ids != anchor), {}
                        for w in windows:
                            out += [(anchor, w["high"], found, score) for score, found in tree.search(vectors[i], w["low"], w["high"], k, wanted, ids, kept)]
                columns = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "high", "id", "score"])

        hits = met.mapInArrow(run, "anchor long, high long, id long, score long")
        first = Window.partitionBy("anchor", "high").orderBy(F.desc("score"), "id")
        return hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame,
    anchors: Callable[[Column], Column],
    id_col: str = "vec_id",
    label_col: str = "label",
    vec_col: str = "embedding",
    positives: int = 5,
    negatives: int = 5,
    least_percent: int = 80,
    scale: int = 256,
    cell_rows: int = CELL_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows whose id `anchors` holds for.

    Components become floor(scale * x); scores are integer inner products; higher ones come first, then lesser ids. An
    anchor's positives are its first rows of the same label, itself excluded. Each pair gets the first `negatives` rows of
    another label whose score is from least_percent percent of the positive's score to all of it (none if that is negative).
    Rows with a null id, label or vector take no part, nor those with a component that is null, not finite or, scaled,
    beyond 2 ** 27. Shorter vectors end in zeros, empty ones are all zeros. Rows that share an id count as one, the least by
    label and vector. Copies under different ids stay apart and tie by id. Other columns are not read. An empty table
    gives none. No result depends on cell_rows and sample_rows.
    """
    spark = df.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = Index(prepared(df, id_col, label_col, vec_col, scale), cell_rows, sample_rows)
    if index.dealt is None:
        return spark.createDataFrame([], schema)
    asked = index.rows.where(anchors(F.col("id")))
    window = lambda low, high: F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))
    near = index.search(asked.withColumn("windows", F.array(window(F.lit(-_ANY), F.lit(_ANY)))), positives, same=True)
    near = written(near.select("anchor", F.col("id").alias("positive"), F.col("score").alias("high")), "positives")
    # low: the least integer that is least_percent percent or more
    low = F.expr(f"high div 100 * {least_percent} + (high % 100 * {least_percent} + 99) div 100")
    windows = near.where("high >= 0").groupBy(F.col("anchor").alias("id")).agg(F.array_sort(F.collect_set(window(low, F.col("high")))).alias("windows"))
    hard = index.search(index.rows.join(windows, "id"), negatives, same=False)
    return near.join(hard, ["anchor", "high"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("high").alias("positive_score"), F.col("score").alias("negative_score")
    )

