"""A back-off language model: three-word counts with absolute discounts over continuation counts, as tables.

The tables are counted and looked up by joins, so that their size is bounded by no machine. A word's probability after two
others is its discounted share there, plus what the discounts left times its probability after one, in which a pair counts as
often as words precede it; likewise below, where half a count is kept for words never seen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verascope.functions import text
from verascope.functions.perplexity import CAP, FLOOR, NEUTRAL
from verascope.session import written

#: Words of a text that are judged, and what stands before its first one.
LONGEST, START = 512, "<s>"


@dataclass
class Model:
    """three: u, v, w, c; two: v, w, c (words before the pair); one: w, c (words before the word). after_two, after_one: total and
    types of what follows; discounts of three and two; total and types of one."""

    three: DataFrame
    two: DataFrame
    one: DataFrame
    after_two: DataFrame
    after_one: DataFrame
    discount_three: float
    discount_two: float
    total: int
    types: int


def _triples(df: DataFrame, text_col: str, most: int | None, *keep: str) -> DataFrame:
    """(keep, u, v, w, i) of every word w of the texts, the i-th from 0 on, up to the most-th."""
    t = text.tokens(F.col(text_col))
    t = F.concat(F.array(F.lit(START), F.lit(START)), t if most is None else F.slice(t, 1, most))
    rows = df.select(*keep, t.alias("t")).select(*keep, "t", F.explode(F.when(F.size("t") > 2, F.sequence(F.lit(0), F.size("t") - 3)).otherwise(F.array().cast("array<int>"))).alias("i"))
    return rows.select(*keep, F.get("t", F.col("i")).alias("u"), F.get("t", F.col("i") + 1).alias("v"), F.get("t", F.col("i") + 2).alias("w"), "i")


def _discount(table: DataFrame) -> float:
    """n1 / (n1 + 2 n2) of what was counted once and twice; a half where there is neither."""
    n1, n2 = table.agg(F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).first()
    return round(n1 / (n1 + 2 * n2), 6) if n1 else 0.5


def train(df: DataFrame, text_col: str = "text") -> Model:
    """The model of all words of all texts."""
    three = written(_triples(df, text_col, None).groupBy("u", "v", "w").agg(F.count("*").alias("c")), "three-words")
    two = written(three.groupBy("v", "w").agg(F.count("*").alias("c")), "two-words")
    one = written(two.groupBy("w").agg(F.count("*").alias("c")), "one-word")
    after_two = written(three.groupBy("u", "v").agg(F.sum("c").alias("total"), F.count("*").alias("types")), "after-two")
    after_one = written(two.groupBy("v").agg(F.sum("c").alias("total"), F.count("*").alias("types")), "after-one")
    total, types = one.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    return Model(three, two, one, after_two, after_one, _discount(three), _discount(two), total, types)


def _unigram(c: str, total: int, types: int) -> Column:
    return (F.coalesce(c, F.lit(0)) + 0.5) / F.lit(total + 0.5 * (types + 1))


def _discounted(c: str, total: str, types: str, d: float, below: Column) -> Column:
    """A share less its discount, and the discounts' mass by the distribution below; that one alone where nothing was counted."""
    share = (F.greatest(F.coalesce(F.col(c), F.lit(0)) - d, F.lit(0.0)) + d * F.col(types) * below) / F.col(total)
    return F.when(F.col(total) > 0, share).otherwise(below)


def probabilities(triples: DataFrame, m: Model, *keep: str) -> DataFrame:
    """triples (u, v, w) with p, the probability of w after u and v; with columns to keep, those and p alone."""
    d = triples.join(m.one.withColumnRenamed("c", "c1"), "w", "left")
    d = d.join(m.two.withColumnRenamed("c", "c2"), ["v", "w"], "left").join(m.after_one.toDF("v", "total2", "types2"), "v", "left")
    d = d.join(m.three.withColumnRenamed("c", "c3"), ["u", "v", "w"], "left").join(m.after_two.toDF("u", "v", "total3", "types3"), ["u", "v"], "left")
    p1 = _unigram("c1", m.total, m.types)
    p2 = _discounted("c2", "total2", "types2", m.discount_two, p1)
    return d.withColumn("p", _discounted("c3", "total3", "types3", m.discount_three, p2)).select(*(keep or triples.columns), "p")


def scores(df: DataFrame, m: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score_perplexity) of every id: the mean loss of the first LONGEST words as perplexity between FLOOR and CAP, on a logarithmic
    scale from 0 to 1; NEUTRAL without a word. Rows that share an id are judged together.

    Triples carry their text's id through the look-ups: nearly all are distinct, so that looking each up once and joining back
    shuffled more.
    """
    rows = probabilities(_triples(df, text_col, LONGEST, id_col), m, id_col)
    loss = rows.groupBy(id_col).agg((-F.avg(F.log("p"))).alias("loss"))
    return _scaled(df, loss, id_col)


def own_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """scores(df, train(df)), with three shuffles of the triples in all instead of one for each table and look-up.

    Triples travel with their id to their first two words, where windows count them; then to their last two, which bring the
    probability below; then home. Shuffled files go as soon as what they made is written.
    """
    pair, triple = Window.partitionBy("u", "v"), Window.partitionBy("u", "v", "w")
    judged = F.col("i") < LONGEST
    rows = _triples(df, text_col, None, id_col).select(F.when(judged, F.col(id_col)).alias("id"), judged.alias("judged"), "u", "v", "w").repartition("u", "v")
    rows = rows.withColumn("first", F.row_number().over(triple.orderBy("w")) == 1).withColumn("c3", F.count("*").over(triple).cast("int"))
    rows = rows.withColumns({"total3": F.count("*").over(pair).cast("int"), "types3": F.count(F.when(F.col("first"), 1)).over(pair).cast("int")})
    met = written(rows.where("judged or first").drop("u"), "own-triples", release=True)
    two = written(met.where("first").groupBy("v", "w").agg(F.count("*").alias("c2")), "own-pairs", release=True)
    one = written(two.groupBy("w").agg(F.count("*").alias("c1")), "own-words", release=True)
    after_one = two.groupBy("v").agg(F.sum("c2").alias("total2"), F.count("*").alias("types2"))
    total, types = one.agg(F.coalesce(F.sum("c1"), F.lit(0)), F.count("*")).first()
    d3, d2 = _discount(met.where("first").withColumnRenamed("c3", "c")), _discount(two.withColumnRenamed("c2", "c"))
    p1 = _unigram("c1", total, types)
    below = two.join(one, "w").join(after_one, "v").select("v", "w", _discounted("c2", "total2", "types2", d2, p1).alias("p2"))
    below = written(below, "own-below", release=True)
    p = _discounted("c3", "total3", "types3", d3, F.col("p2"))
    loss = met.where("judged").select("id", "v", "w", "c3", "total3", "types3").join(below, ["v", "w"]).groupBy("id").agg((-F.avg(F.log(p))).alias("loss"))
    return _scaled(df, loss.withColumnRenamed("id", id_col), id_col)


def _scaled(df: DataFrame, loss: DataFrame, id_col: str) -> DataFrame:
    """(id, score_perplexity) of every id of df by (id, loss)."""
    scale = F.log(F.lit(CAP)) - F.log(F.lit(FLOOR))
    score = (F.log(F.greatest(F.lit(FLOOR), F.least(F.lit(CAP), F.exp(F.least("loss", F.lit(50.0)))))) - F.log(F.lit(FLOOR))) / scale
    out = df.select(id_col).distinct().join(loss.withColumnRenamed(id_col, "_id"), F.col(id_col).eqNullSafe(F.col("_id")), "left")
    return out.select(id_col, F.when(F.col("loss").isNotNull(), score).otherwise(NEUTRAL).alias("score_perplexity"))
