"""Automation signals of accounts: moments of gaps by ranges of times, one aggregation per account, pairs by an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verascope.functions.arrays import total
from verascope.operators import similarity
from verascope.operators.ranges import gap_moments
from verascope.session import written


def burstiness(events: DataFrame, account: str = "account", ts: str = "ts") -> DataFrame:
    """((sd - mu) / (sd + mu) + 1) / 2 of the gaps; under three times or two gaps: 0.5."""
    b = (F.try_divide(F.col("sd") - F.col("mu"), F.col("sd") + F.col("mu")) + 1) / 2
    few = (F.col("n_ts") < 3) | (F.col("n_gaps") < 2)
    return gap_moments(events, account, ts).select(account, F.when(few, 0.5).otherwise(F.coalesce(b, F.lit(0.5))).alias("burstiness"))


def regularity(events: DataFrame, account: str = "account", ts: str = "ts") -> DataFrame:
    """1 - cv / 1.5 of the gaps, 0 at least; under four times or two gaps: 0."""
    few = (F.col("n_ts") < 4) | (F.col("n_gaps") < 2)
    r = F.greatest(F.lit(0.0), 1 - F.col("sd") / F.col("mu") / 1.5)
    return gap_moments(events, account, ts).select(account, "n_ts", F.when(few, 0.0).otherwise(r).alias("regularity"))


def engagement(events: DataFrame, account: str = "account", score: str = "score", limit: float = 3.0) -> DataFrame:
    """Share of an account's scores over `limit` population deviations from its mean; under five or no spread: 0.

    The moments are aggregated first and joined back, so no account's rows meet in one task.
    """
    s = events.where(F.col(score).isNotNull()).select(account, F.col(score).cast("double").alias("_s"))
    m = s.groupBy(account).agg(F.avg("_s").alias("mu"), F.stddev_pop("_s").alias("sd"), F.count("*").alias("n_scores"))
    far = F.avg(F.when((F.col("sd") > 0) & (F.abs((F.col("_s") - F.col("mu")) / F.col("sd")) > limit), 1.0).otherwise(0.0))
    out = s.join(m, account).groupBy(account).agg(F.first("n_scores").alias("n_scores"), far.alias("far"))
    return out.select(account, "n_scores", F.when(F.col("n_scores") < 5, 0.0).otherwise(F.col("far")).alias("engagement"))


def velocity(events: DataFrame, account: str = "account", ts: str = "ts", created: str | None = None) -> DataFrame:
    """Events a day over the account's span (a day at least), from its creation if that is earlier. ts in seconds."""
    low = F.min(ts)
    if created:
        c = F.min(F.when(F.col(created) > 0, F.col(created)))
        low = F.least(low, F.coalesce(c, low))
    return events.groupBy(account).agg((F.count(ts) / F.greatest(F.lit(1.0), (F.max(ts) - low) / 86400.0)).alias("velocity"))


def _set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""))


def cloning(texts: DataFrame, account: str = "account", text: str = "text", order: str = "id", limit: float = 0.85, max_pairs: int | None = 200) -> DataFrame:
    """(account, n_texts, n_pairs, cloning): share of text pairs whose word sets have a Jaccard similarity over limit.

    max_pairs is the signal's sample of pairs per account, chosen by a hash and drawn by text number, so pairs that
    are not drawn are never made; None compares all pairs, for small groups. Fewer than two texts: 0.
    """
    w = Window.partitionBy(account).orderBy(order)
    t = texts.select(account, _set(F.col(text)).alias("w"), (F.row_number().over(w) - 1).alias("i"))
    sizes = t.groupBy(account).agg(F.count("*").alias("n"))
    all_pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    if max_pairs is None:
        drawn = sizes.select(account, "n", F.explode(F.when(F.col("n") > 1, F.sequence(F.lit(1), (F.col("n") - 1).cast("int"))).otherwise(F.array().cast("array<int>"))).alias("j"))
        drawn = drawn.select(account, F.explode(F.sequence(F.lit(0), F.col("j") - 1)).alias("i"), "j")
    else:
        # pair numbers: all of them if they are few, else distinct hashes modulo their count
        tries = F.when(all_pairs <= max_pairs, F.when(all_pairs > 0, F.sequence(F.lit(0).cast("long"), all_pairs - 1)).otherwise(F.array().cast("array<bigint>"))).otherwise(
            F.slice(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(3 * max_pairs)), lambda k: F.pmod(F.xxhash64(F.col(account), k), all_pairs))), 1, max_pairs)
        )
        p = sizes.select(account, F.explode(tries).alias("p"))
        j = F.floor((1 + F.sqrt(1 + 8 * F.col("p").cast("double"))) / 2).cast("long")
        j = F.when(j * (j - 1) / 2 > F.col("p"), j - 1).when((j + 1) * j / 2 <= F.col("p"), j + 1).otherwise(j)
        drawn = p.select(account, "p", j.alias("j")).select(account, (F.col("p") - F.col("j") * (F.col("j") - 1) / 2).cast("long").alias("i"), "j")
    left, right = t.select(account, "i", F.col("w").alias("wi")), t.select(account, F.col("i").alias("j"), F.col("w").alias("wj"))
    both = drawn.join(left, [account, "i"]).join(right, [account, "j"])
    same = F.size(F.array_intersect("wi", "wj")) / F.nullif(F.size(F.array_union("wi", "wj")), F.lit(0))
    rates = both.groupBy(account).agg(F.count("*").alias("n_pairs"), F.avg(F.when(F.coalesce(same, F.lit(0.0)) > limit, 1.0).otherwise(0.0)).alias("cloning"))
    return sizes.join(rates, account, "left").select(account, F.col("n").alias("n_texts"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.coalesce("cloning", F.lit(0.0)).alias("cloning"))


def cloning_of_all(texts: DataFrame, account: str = "account", text: str = "text", limit: float = 0.85) -> DataFrame:
    """(account, n_texts, n_pairs, cloning): as cloning(), of all pairs of an account's texts, none drawn and none made in vain.

    Copies are counted, not paired; other pairs over the limit are found by similarity.similar_pairs(). Texts without a
    word are like none. Rows of a null account count for none.
    """
    known = texts.where(F.col(account).isNotNull())
    sizes = known.groupBy(account).agg(F.count("*").alias("n_texts"))
    counted = known.select(F.explode(F.transform(similarity.words_of(F.col(text)), lambda w: F.xxhash64(w))).alias("word"))
    sets = written(similarity.numbered(similarity.by_rarity(similarity.word_sets(known, account, text), counted=counted)), "word-sets")
    equal = sets.select(account, (F.col("copies") * (F.col("copies") - 1) / 2).cast("long").alias("copies"))
    alike = equal.unionByName(similarity.similar_pairs(sets, account, limit).select(account, "copies"))
    found = sizes.join(alike.groupBy(account).agg(F.sum("copies").alias("alike")), account, "left")
    pairs = (F.col("n_texts") * (F.col("n_texts") - 1) / 2).cast("long")
    return found.select(account, "n_texts", pairs.alias("n_pairs"), F.coalesce(F.try_divide(F.coalesce("alike", F.lit(0)).cast("double"), pairs), F.lit(0.0)).alias("cloning"))


def account_scores(events: DataFrame, texts: DataFrame, account: str = "account", limit: float = 0.85) -> DataFrame:
    """(account, regularity, cloning, engagement, bot_score) of accounts with events or texts; a signal without enough data is null.

    events: account, ts, score; texts: account, text. Regularity needs four times, cloning two texts, engagement five scores.
    """
    signals = regularity(events, account).join(engagement(events, account), account, "full").join(cloning_of_all(texts, account, limit=limit), account, "full")
    known = signals.select(
        account, F.when(F.col("n_ts") >= 4, F.col("regularity")).alias("regularity"), F.when(F.col("n_texts") >= 2, F.col("cloning")).alias("cloning"), F.when(F.col("n_scores") >= 5, F.col("engagement")).alias("engagement")
    )
    return known.withColumn("bot_score", bot_score([F.col("regularity"), F.col("cloning"), F.col("engagement")]))


def bot_score(signals: list[Column]) -> Column:
    """Mean of the signals that are not null, within 0 to 1; none: 0."""
    known = F.array_compact(F.array(*signals))
    return F.when(F.size(known) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), total(known) / F.size(known)))).otherwise(0.0)
