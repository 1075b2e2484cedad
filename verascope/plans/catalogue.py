"""The queries, each with its DuckDB twin where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verascope.functions import html, scalars, text
from verascope.operators import bots, dedup, index, ngrams, ranges, summary, timeseries
from verascope.plans import bronze_queries, payload_queries, store_queries
from verascope.plans.standins import ACTIVITY, DAILY, SCORED, SERIES, SILVER, TOKENS, activity, daily, daily_sql, scored, series, silver, table
from verascope.session import shared_dir
from verascope.streaming import changepoints, incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles at a fixed number of decimals, as both engines' sums differ in the last bits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expr: str, name: str, digits: int = 8) -> str:
    return f"round({expr}, {digits}) AS {name}"


# ── text signals ──

_DOCS = lambda spark, sf: table(spark, sf, "documents")

TTR = "CASE WHEN len(t) > 0 THEN CAST(len(list_distinct(t[1:200])) AS DOUBLE) / least(len(t), 200) ELSE 0.0 END"
REPETITION = "CASE WHEN len(t) < 4 THEN 0.0 ELSE 1 - CAST(len(list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS DOUBLE) / (len(t) - 1) END"
WORD_LENGTH = "CASE WHEN len(t) > 0 THEN CAST(length(array_to_string(t, '')) AS DOUBLE) / len(t) ELSE 0.0 END"
_SENTENCES = r"regexp_extract_all(coalesce(text, ''), '[^.!?]+[.!?]+')"
_SENTENCE_SQL = rf"""sl AS (SELECT doc_id, list_transform({_SENTENCES}, lambda s: CAST(len(list_filter(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{2,}}'))) AS DOUBLE)) AS l FROM documents),
 cv AS (SELECT doc_id, len(l) AS sentence_count, CASE WHEN len(l) < 3 THEN 0.5 WHEN list_sum(l) = 0 THEN 0.0
  ELSE sqrt(list_sum(list_transform(l, lambda x: (x - list_avg(l)) * (x - list_avg(l)))) / len(l)) / list_avg(l) END AS sentence_variance FROM sl)"""
_COUNTS_SQL = "cnt AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(t) AS w FROM tok) GROUP BY 1, 2)"
_ENTROPY_SQL = "ent AS (SELECT doc_id, greatest(0.0, log2(CAST(sum(c) AS DOUBLE)) - sum(c * log2(CAST(c AS DOUBLE))) / CAST(sum(c) AS DOUBLE)) AS entropy FROM cnt GROUP BY 1)"
_ZIPF_SQL = """rk AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, w) AS k, count(*) OVER (PARTITION BY doc_id) AS types FROM cnt),
 zf AS (SELECT doc_id, greatest(0.0, 1 - abs(regr_slope(ln(c), ln(k)) + 1) / 2) AS z, max(types) AS types FROM rk WHERE k <= 50 AND types >= 5 GROUP BY 1)"""
_ZIPF = "CASE WHEN len(t) < 30 OR coalesce(types, 0) < 5 THEN 0.5 ELSE z END"
_MTLD_FOLD = """list_reduce(list_transform({t}, lambda x: {{'f': 0.0::DOUBLE, 's': [x], 'n': 0::BIGINT}}), lambda a, b:
  CASE WHEN CAST(len(CASE WHEN list_contains(a.s, b.s[1]) THEN a.s ELSE list_append(a.s, b.s[1]) END) AS DOUBLE) / (a.n + 1) <= 0.72
    THEN {{'f': a.f + 1.0::DOUBLE, 's': []::VARCHAR[], 'n': 0::BIGINT}}
    ELSE {{'f': a.f, 's': CASE WHEN list_contains(a.s, b.s[1]) THEN a.s ELSE list_append(a.s, b.s[1]) END, 'n': a.n + 1}} END, {{'f': 0.0::DOUBLE, 's': []::VARCHAR[], 'n': 0::BIGINT}})"""
_MTLD_SQL = f"""fold AS (SELECT doc_id, len(t) AS n, {_MTLD_FOLD.format(t='t')} AS a, {_MTLD_FOLD.format(t='list_reverse(t)')} AS b FROM tok WHERE len(t) >= 10),
 fac AS (SELECT doc_id, n, a.f + CASE WHEN a.n > 0 THEN (1 - CAST(len(a.s) AS DOUBLE) / a.n) / (1 - 0.72) ELSE 0 END AS x, b.f + CASE WHEN b.n > 0 THEN (1 - CAST(len(b.s) AS DOUBLE) / b.n) / (1 - 0.72) ELSE 0 END AS y FROM fold),
 mt AS (SELECT doc_id, ((CASE WHEN x > 0 THEN n / x ELSE n END) + (CASE WHEN y > 0 THEN n / y ELSE n END)) / 2 AS mtld FROM fac)"""


def _signal(name: str, sql: str, extra: str = "") -> None:
    column = "sentence_cv" if name == "sentence_cv" else name

    def run(spark: SparkSession, sf: str) -> DataFrame:
        fn = {"ttr": text.type_token_ratio, "entropy": text.entropy, "repetition": text.repetition, "zipf": text.zipf_alignment, "avg_word_length": text.average_word_length, "mtld": text.mtld}
        d = _DOCS(spark, sf)
        if name == "sentence_cv":
            value = text.sentence_variation(F.col("text"))
        else:
            d = d.withColumn("t", text.tokens(F.col("text")))
            value = fn[name](F.col("t"))
        return d.select("doc_id", F.round(value, 6).alias(column))

    query(f"text_{name}", sql)(run)


@query(
    "text_tokens",
    f"WITH {TOKENS} SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM tok",
)
def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = _DOCS(spark, sf).withColumn("t", text.tokens(F.col("text")))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


@query(
    "text_sentences",
    rf"SELECT doc_id, CAST(len({_SENTENCES}) AS BIGINT) AS n_sentences, CAST(list_sum(list_transform({_SENTENCES}, lambda s: length(regexp_replace(s, '^[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', '')))) AS BIGINT) AS n_chars FROM documents",
)
def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    s = text.sentences(F.col("text"))
    n = F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return _DOCS(spark, sf).select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.when(F.size(s) > 0, n).alias("n_chars"))


_signal("ttr", f"WITH {TOKENS} SELECT doc_id, {r(TTR, 'ttr', 6)} FROM tok")
_signal("entropy", f"WITH {TOKENS}, {_COUNTS_SQL}, {_ENTROPY_SQL} SELECT doc_id, {r('coalesce(entropy, 0.0)', 'entropy', 6)} FROM tok LEFT JOIN ent USING (doc_id)")
_signal("sentence_cv", f"WITH {_SENTENCE_SQL} SELECT doc_id, {r('sentence_variance', 'sentence_cv', 6)} FROM cv")
_signal("repetition", f"WITH {TOKENS} SELECT doc_id, {r(REPETITION, 'repetition', 6)} FROM tok")
_signal("zipf", f"WITH {TOKENS}, {_COUNTS_SQL}, {_ZIPF_SQL} SELECT doc_id, {r(_ZIPF, 'zipf', 6)} FROM tok LEFT JOIN zf USING (doc_id)")
_signal("avg_word_length", f"WITH {TOKENS} SELECT doc_id, {r(WORD_LENGTH, 'avg_word_length', 6)} FROM tok")
_signal("mtld", f"WITH {TOKENS}, {_MTLD_SQL} SELECT doc_id, {r('coalesce(mtld, 0.0)', 'mtld', 6)} FROM tok LEFT JOIN mt USING (doc_id)")

_C01 = "greatest(0.0, least(1.0, {}))"
_FEATURES_SQL = f"""WITH {TOKENS}, {_COUNTS_SQL}, {_ENTROPY_SQL}, {_ZIPF_SQL}, {_SENTENCE_SQL}, {_MTLD_SQL},
 ft AS (SELECT doc_id, {TTR} AS ttr, coalesce(mtld, 0.0) AS mtld, coalesce(entropy, 0.0) AS entropy, sentence_variance, {REPETITION} AS repetition, {_ZIPF} AS zipf_deviation, {WORD_LENGTH} AS avg_word_length,
   CAST(len(t) AS BIGINT) AS token_count, CAST(sentence_count AS BIGINT) AS sentence_count
  FROM tok LEFT JOIN ent USING (doc_id) LEFT JOIN zf USING (doc_id) LEFT JOIN cv USING (doc_id) LEFT JOIN mt USING (doc_id)),
 sb AS (SELECT doc_id, {_C01.format('(ttr - 0.2) / 0.5')} AS ttr, {_C01.format('(mtld - 20) / 100')} AS mtld, {_C01.format('(entropy - 5) / 8')} AS entropy, {_C01.format('sentence_variance / 1.2')} AS sentence_variance,
   {_C01.format('1 - repetition / 0.3')} AS repetition, {_C01.format('zipf_deviation')} AS zipf_deviation, 0.5::DOUBLE AS burstiness FROM ft)"""
_WEIGHTED = " + ".join(f"{k} * {w}::DOUBLE" for k, w in text.WEIGHTS.items())
_COMPOSITE = f"greatest(0.0, least(100.0, 100 * ({_WEIGHTED})))"


@query("text_features", _FEATURES_SQL + " SELECT doc_id, " + ", ".join(r(k, f"feat_{k}", 6) for k in ("ttr", "mtld", "entropy", "sentence_variance", "repetition", "zipf_deviation", "avg_word_length")) + ", 0.5::DOUBLE AS feat_burstiness, token_count AS feat_token_count, sentence_count AS feat_sentence_count FROM ft")
def _features(spark: SparkSession, sf: str) -> DataFrame:
    d = text.features(_DOCS(spark, sf).select("doc_id", "text"))
    return rounded(d.drop("text"), 6)


@query("text_subscores", _FEATURES_SQL + " SELECT doc_id, " + ", ".join(r(k, f"score_{k}", 5) for k in text.WEIGHTS) + " FROM sb")
def _subscores(spark: SparkSession, sf: str) -> DataFrame:
    d = text.features(_DOCS(spark, sf).select("doc_id", "text"))
    return d.select("doc_id", *[F.round(v, 5).alias(f"score_{k}") for k, v in text.sub_scores().items()])


@query("text_score", _FEATURES_SQL + f" SELECT doc_id, {r(_COMPOSITE, 'aliveness_score', 4)} FROM sb")
def _score(spark: SparkSession, sf: str) -> DataFrame:
    return text.score_documents(_DOCS(spark, sf).select("doc_id", "text"), round_to=4).select("doc_id", "aliveness_score")


_JUDGED = "CAST(n_chars % 100 AS DOUBLE) / 100"
_WITH_MODEL = " + ".join(f"{k} * {round(w * 0.85, 4)}::DOUBLE" for k, w in text.WEIGHTS.items())


@query("text_weights", _FEATURES_SQL + f" SELECT doc_id, {r(_COMPOSITE, 'plain', 4)}, {r(f'greatest(0.0, least(100.0, 100 * ({_WITH_MODEL} + {_JUDGED} * 0.15::DOUBLE)))', 'with_model', 4)} FROM sb JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id)")
def _weights(spark: SparkSession, sf: str) -> DataFrame:
    d = _DOCS(spark, sf).select("doc_id", "text", (F.col("n_chars") % 100 / 100.0).alias("judged"))
    both = text.score_documents(d, perplexity=F.col("judged"), round_to=4).withColumnRenamed("aliveness_score", "with_model")
    plain = text.composite({k: F.col(f"score_{k}") for k in text.WEIGHTS}, text.weights())
    return both.select("doc_id", F.round(plain, 4).alias("plain"), "with_model")


@query(
    "flagship_daily_index",
    _FEATURES_SQL + f""", rows AS (SELECT CAST(DATE '2024-01-01' + CAST(d.doc_id % 60 AS INTEGER) AS DATE) AS date, source, lang AS category, {_COMPOSITE} AS s FROM sb JOIN documents d USING (doc_id))
 SELECT date, source, category, count(*) AS n_docs, {r('avg(s)', 'mean_score', 4)}, {r('quantile_cont(round(s, 2), 0.5)', 'median_score', 4)}, {r('100.0 * count(CASE WHEN s < 50 THEN 1 END) / count(*)', 'pct_below_50', 4)} FROM rows GROUP BY date, source, category""",
)
def _flagship(spark: SparkSession, sf: str) -> DataFrame:
    rows = text.score_documents(silver(spark, sf).select("date", "source", "category", "text"), round_to=None)
    return rounded(index.daily_index(rows), 4).select("date", "source", "category", "n_docs", "mean_score", "median_score", "pct_below_50")


# ── indices ──

_DAILY_OUT = "date, source, category, n_docs, " + ", ".join(r(c, c) for c in index.VALUES[1:])


@query("daily_index", f"WITH {SCORED}, x AS ({daily_sql('scored')}) SELECT {_DAILY_OUT} FROM x")
def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(index.daily_index(scored(spark, sf)))


@query("domain_index", f"WITH {SCORED} SELECT date, domain, arg_min(category, ord) AS category, {r('avg(aliveness_score)', 'mean_score')}, count(*) AS n_docs FROM scored GROUP BY date, domain HAVING avg(aliveness_score) IS NOT NULL")
def _domain(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(index.domain_index(scored(spark, sf), "ord"))


_HALVES = f"{SCORED}, old AS ({daily_sql('(SELECT * FROM scored WHERE ord % 3 < 2)')}), new AS ({daily_sql('(SELECT * FROM scored WHERE ord % 3 >= 1)')}), both_ AS (SELECT *, 0 AS b FROM old UNION ALL SELECT *, 1 FROM new)"


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = scored(spark, sf)
    return index.daily_index(s.where("ord % 3 < 2")), index.daily_index(s.where("ord % 3 >= 1"))


@query(
    "index_delta_merge",
    f"WITH {_HALVES} SELECT date, source, category, CAST(sum(n_docs) AS BIGINT) AS n_docs, {r('sum(mean_score * n_docs) / sum(n_docs)', 'mean_score')}, {r('arg_max(median_score, b)', 'median_score')}, "
    f"round(last(std_score ORDER BY b), 8) AS std_score, {r('sum(pct_below_50 * n_docs) / sum(n_docs)', 'pct_below_50')}, {r('sum(bot_fraction * n_docs) / sum(n_docs)', 'bot_fraction')}, {r('sum(aliveness_index * n_docs) / sum(n_docs)', 'aliveness_index')} FROM both_ GROUP BY date, source, category",
)
def _merge(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(index.merge_delta(*_parts(spark, sf)))


@query("index_state_merge", f"WITH {SCORED}, x AS ({daily_sql('scored')}) SELECT {_DAILY_OUT} FROM x")
def _state_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Four deltas merged out of order are one batch."""
    s = scored(spark, sf)
    parts = [index.daily_state(s.where(F.col("ord") % 4 == k)) for k in (2, 0, 3, 1)]
    return rounded(index.daily_of_state(index.merge_states(index.merge_states(parts[0], parts[1]), index.merge_states(parts[2], parts[3]))))


@query("index_replace_upsert", f"WITH {_HALVES} SELECT {_DAILY_OUT} FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.date = old.date AND new.source = old.source AND new.category = old.category) UNION ALL SELECT {_DAILY_OUT} FROM new")
def _replace(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(index.replace_rows(*_parts(spark, sf)))


@query("index_replace_dates", f"WITH {_HALVES}, part AS (SELECT * FROM new WHERE date < DATE '2024-01-20') SELECT {_DAILY_OUT} FROM old WHERE date NOT IN (SELECT date FROM part) UNION ALL SELECT {_DAILY_OUT} FROM part")
def _replace_dates(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _parts(spark, sf)
    return rounded(index.replace_dates(old, new.where("date < '2024-01-20'")))


@query(
    "domain_delta_merge",
    f"""WITH {SCORED}, d AS (SELECT date, domain, CASE WHEN ord % 2 = 0 THEN 0 ELSE 1 END AS b, arg_min(category, ord) AS category, avg(aliveness_score) AS m, count(*) AS n FROM scored GROUP BY 1, 2, 3 HAVING avg(aliveness_score) IS NOT NULL)
 SELECT date, domain, arg_max(category, b) AS category, {r('sum(m * n) / sum(n)', 'mean_score')}, CAST(sum(n) AS BIGINT) AS n_docs FROM d GROUP BY 1, 2""",
)
def _domain_merge(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    return rounded(index.merge_domain_delta(index.domain_index(s.where("ord % 2 = 0"), "ord"), index.domain_index(s.where("ord % 2 = 1"), "ord")))


_W = "CASE source WHEN 'view' THEN 0.3 WHEN 'click' THEN 0.15 WHEN 'purchase' THEN 0.05 ELSE 0.1 END::DOUBLE"
_DEMO_WEIGHTS = {"view": 0.3, "click": 0.15, "purchase": 0.05}
_COMP = f"{DAILY}, comp AS (SELECT date, sum(mean_score * {_W}) / sum({_W}) AS aliveness_index, CAST(sum(n_docs) AS BIGINT) AS n_docs FROM daily GROUP BY date HAVING sum(n_docs) >= 10)"


@query("composite_index", f"WITH {_COMP} SELECT date, {r('aliveness_index', 'aliveness_index')}, n_docs FROM comp")
def _composite(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(index.composite(daily(spark, sf), _DEMO_WEIGHTS))


@query("composite_smoothed", f"WITH {SERIES} SELECT date, aliveness_index, n_docs, {r('avg(aliveness_index) OVER (ORDER BY date ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)', 'smoothed_index', 10)} FROM series")
def _smoothed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(index.smoothed(series(spark, sf)), 10)


@query("composite_smoothed_even", f"WITH {SERIES} SELECT date, {r('avg(aliveness_index) OVER (ORDER BY date ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)', 'smoothed_index', 10)} FROM series")
def _smoothed_even(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(index.smoothed(series(spark, sf), width=4), 10).select("date", "smoothed_index")


def _z_sql(width: int, least: int) -> str:
    w = f"OVER (ORDER BY date ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(aliveness_index) {w} >= {least} THEN (aliveness_index - avg(aliveness_index) {w}) / (stddev_samp(aliveness_index) {w} + 1e-9) END"


@query("composite_anomaly", f"WITH {SERIES}, z AS (SELECT *, {_z_sql(30, 7)} AS z FROM series) SELECT date, round(z, 5) AS z_score, CASE WHEN abs(coalesce(z, 0)) > 2.5 THEN 1 ELSE 0 END AS anomaly_flag, CASE WHEN z > 2.5 THEN 'spike' WHEN z < -2.5 THEN 'drop' ELSE '' END AS anomaly_reason FROM z")
def _anomaly(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(index.with_anomalies(series(spark, sf)), 5).select("date", "z_score", "anomaly_flag", "anomaly_reason")


_COMPOSITE_SQL = """SELECT date, round(aliveness_index, 8) AS aliveness_index, round(avg(aliveness_index) OVER (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 8) AS smoothed_index, n_docs, 0 AS anomaly_flag, '' AS anomaly_reason
 FROM (SELECT date, sum(mean_score * w) / nullif(sum(w), 0) AS aliveness_index, CAST(sum(n_docs) AS BIGINT) AS n_docs
  FROM (SELECT date, mean_score, coalesce(n_docs, 0) AS n_docs, CASE source WHEN 'view' THEN 0.3D WHEN 'click' THEN 0.15D WHEN 'purchase' THEN 0.05D ELSE 0.1D END AS w FROM {daily} WHERE mean_score IS NOT NULL)
  GROUP BY date HAVING sum(n_docs) >= 10)"""


@query("composite_sql", f"WITH {DAILY} " + _COMPOSITE_SQL.format(daily="daily").replace("0.3D", "0.3::DOUBLE").replace("0.15D", "0.15::DOUBLE").replace("0.05D", "0.05::DOUBLE").replace("0.1D", "0.1::DOUBLE"))
def _composite_sql(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_COMPOSITE_SQL, daily=daily(spark, sf))


_NAMED = [*index.SOURCE_WEIGHTS, "elsewhere"]


@query("source_weights", f"SELECT name, round(sum(n_chars * weight) / sum(n_chars), 8) AS weight, count(*) AS n_docs FROM (SELECT {_NAMED}[CAST(doc_id % {len(_NAMED)} AS INTEGER) + 1] AS name, n_chars FROM documents) JOIN (VALUES " + ", ".join(f"('{k}', {index.SOURCE_WEIGHTS.get(k, 0.1)}::DOUBLE)" for k in _NAMED) + ") t(name, weight) USING (name) GROUP BY name")
def _source_weights(spark: SparkSession, sf: str) -> DataFrame:
    d = _DOCS(spark, sf).select(F.get(F.array(*map(F.lit, _NAMED)), (F.col("doc_id") % len(_NAMED)).cast("int")).alias("name"), "n_chars")
    w = index.weight_of(F.col("name"))
    return d.groupBy("name").agg(F.round(F.sum(F.col("n_chars") * w) / F.sum("n_chars"), 8).alias("weight"), F.count("*").alias("n_docs"))


# ── summaries and dashboard ──


@query(
    "corpus_summary",
    f"""WITH {SCORED} SELECT CASE WHEN grouping(source, category) = 3 THEN 'all' WHEN grouping(source, category) = 1 THEN 'source' ELSE 'category' END AS level, coalesce(CASE WHEN grouping(source, category) = 1 THEN source WHEN grouping(source, category) = 2 THEN category END, '') AS key,
 count(*) AS n_rows, count(aliveness_score) AS n_scored, {r('avg(aliveness_score)', 'mean')}, {r('quantile_cont(round(aliveness_score, 2), 0.5)', 'median')}, {r('stddev_samp(aliveness_score)', 'std')},
 {r('100.0 * count(CASE WHEN aliveness_score < 50 THEN 1 END) / count(aliveness_score)', 'pct_below_50')}, {r('100.0 * count(CASE WHEN aliveness_score < 30 THEN 1 END) / count(aliveness_score)', 'pct_below_30')} FROM scored GROUP BY GROUPING SETS ((), (source), (category))""",
)
def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.corpus_summary(scored(spark, sf)))


_LATEST = f"""WITH {DAILY}, ld AS (SELECT source, max(date) AS date FROM daily WHERE mean_score IS NOT NULL GROUP BY source)
 SELECT source, 'all' AS category, date, {r('CASE WHEN sum(n_docs) > 0 THEN sum(mean_score * n_docs) / sum(n_docs) ELSE avg(mean_score) END', 'mean_score')}, CAST(sum(n_docs) AS BIGINT) AS n_docs FROM daily JOIN ld USING (source, date) GROUP BY source, date"""


@query("latest_source_scores", _LATEST)
def _latest(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.latest_source_scores(daily(spark, sf)))


@query("latest_source_distinct_on", f"WITH {DAILY} SELECT DISTINCT ON (source) source, category, date, {r('mean_score', 'mean_score')}, n_docs FROM daily ORDER BY source, date DESC, category")
def _distinct_on(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.latest_by_source(daily(spark, sf)).select("source", "category", "date", "mean_score", "n_docs"))


_LOAD = "SELECT source, category, date, round(mean_score, 8) AS mean_score, n_docs FROM {daily} d WHERE mean_score IS NOT NULL AND date = (SELECT max(date) FROM {daily} x WHERE x.source = d.source AND x.mean_score IS NOT NULL)"


@query("load_sources", f"WITH {DAILY} " + _LOAD.format(daily="daily"))
def _load(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_LOAD, daily=daily(spark, sf))


@query("weekly_index", f"WITH {SERIES} SELECT CAST(date_trunc('week', date) AS DATE) AS week, {r('avg(aliveness_index)', 'aliveness_index', 10)}, {r('avg(aliveness_index * 2)', 'smoothed_index', 10)}, CAST(sum(n_docs) AS BIGINT) AS n_docs FROM series GROUP BY 1")
def _weekly(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.weekly_index(series(spark, sf).withColumn("smoothed_index", F.col("aliveness_index") * 2)), 10)


@query("yearly_source_scores", f"WITH {SCORED}, x AS ({daily_sql('scored')}) SELECT CAST(year(date) AS INTEGER) AS year, source, {r('avg(mean_score)', 'mean_score')}, CAST(sum(n_docs) AS BIGINT) AS n_docs FROM x GROUP BY 1, 2")
def _yearly(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.yearly_source_scores(index.daily_index(scored(spark, sf))))


@query("total_docs", f"WITH {DAILY} SELECT CAST(coalesce(sum(n_docs), 0) AS BIGINT) AS total_docs FROM daily")
def _total(spark: SparkSession, sf: str) -> DataFrame:
    return summary.total_docs(daily(spark, sf))


@query("mean_by_source", f"WITH {DAILY} SELECT source, {r('avg(mean_score)', 'mean_score')} FROM daily GROUP BY source")
def _mean_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.mean_by_source(daily(spark, sf)))


@query("top_domains", f"WITH {SCORED} SELECT date, domain, arg_min(category, ord) AS category, {r('avg(aliveness_score)', 'mean_score')}, count(*) AS n_docs FROM scored GROUP BY date, domain HAVING avg(aliveness_score) IS NOT NULL ORDER BY n_docs DESC, domain, date LIMIT 20")
def _top_domains(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.top_domains(index.domain_index(scored(spark, sf), "ord"), 20))


@query("timeline", f"WITH {SERIES} SELECT date, aliveness_index, n_docs FROM series WHERE date >= DATE '2001-08-01' - 90")
def _timeline(spark: SparkSession, sf: str) -> DataFrame:
    return summary.timeline(series(spark, sf), F.lit("2001-08-01").cast("date"), 90)


@query("latest_score", f"WITH {SERIES} SELECT coalesce(arg_max(aliveness_index, date), 41.3) AS score FROM series")
def _latest_score(spark: SparkSession, sf: str) -> DataFrame:
    return summary.latest_score(series(spark, sf).withColumnRenamed("aliveness_index", "smoothed_index"))


@query(
    "kpi_asof_delta",
    f"""WITH {SERIES}, l AS (SELECT max(date) AS d, arg_max(aliveness_index, date) AS score, min(aliveness_index) AS low, CAST(sum(n_docs) AS BIGINT) AS n FROM series), p AS (SELECT arg_max(aliveness_index, date) AS past FROM series, l WHERE date <= l.d - 30)
 SELECT score, round(100 - score, 1) AS synthetic, round(score - past, 6) AS delta_30, low AS observed_low, n AS documents FROM l, p""",
)
def _kpi(spark: SparkSession, sf: str) -> DataFrame:
    s = series(spark, sf)
    now = s.agg(F.max_by("aliveness_index", "date").alias("score"), F.min("aliveness_index").alias("observed_low"), F.sum("n_docs").alias("documents"))
    past = timeseries.as_of(s, "aliveness_index", 30).select(F.col("aliveness_index").alias("past"))
    both = now.crossJoin(past)  # one row each
    return both.select("score", F.round(100 - F.col("score"), 1).alias("synthetic"), F.round(F.col("score") - F.col("past"), 6).alias("delta_30"), "observed_low", "documents")


_LABEL = " ".join(f"WHEN aliveness_score >= {k} THEN '{v}'" for k, v in scalars.SCORE_LABELS)


@query("score_bands", f"WITH {SCORED} SELECT CASE {_LABEL} ELSE '{scalars.LOWEST_LABEL}' END AS band, count(*) AS n FROM scored WHERE aliveness_score IS NOT NULL GROUP BY 1")
def _bands(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).where("aliveness_score is not null").groupBy(scalars.score_label(F.col("aliveness_score")).alias("band")).agg(F.count("*").alias("n"))


def _bar_sql(n: int) -> str:
    x = f"(aliveness_score * {n} / 100)"
    part = f"CASE WHEN i < floor({x}) THEN 1.0::DOUBLE WHEN i = floor({x}) AND {x} > floor({x}) THEN round(0.12 + ({x} - floor({x})) * 0.88, 3) ELSE 0.12::DOUBLE END"
    return f"""WITH {SCORED} SELECT doc_id, CASE WHEN aliveness_score >= 65 THEN 'forest' WHEN aliveness_score >= 45 THEN 'gold' ELSE 'burgundy' END AS band, CAST(floor({x}) AS BIGINT) AS lit,
 round(list_sum(list_transform(range(0, {n}), lambda i: {part})), 3) AS total_opacity FROM scored WHERE aliveness_score IS NOT NULL"""


def _health_bar(name: str, n: int) -> None:
    @query(name, _bar_sql(n))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = F.col("aliveness_score")
        total = F.aggregate(scalars.bar_opacities(s, n), F.lit(0.0), lambda a, x: a + x)
        return scored(spark, sf).where(s.isNotNull()).select("doc_id", scalars.bar_band(s).alias("band"), F.floor(s * n / 100).alias("lit"), F.round(total, 3).alias("total_opacity"))


_health_bar("health_bar", 10)
_health_bar("health_bar_wide", 20)


@query("display_names", "SELECT source, n, CASE WHEN n >= 1000000 THEN printf('%.2fM', n / 1e6) ELSE format('{:,}', n) END AS shown FROM (SELECT source, count(*) * 977 AS n FROM documents GROUP BY source UNION ALL SELECT 'all', count(*) * 9770 FROM documents)")
def _names(spark: SparkSession, sf: str) -> DataFrame:
    docs = _DOCS(spark, sf)
    d = docs.groupBy("source").agg((F.count("*") * 977).alias("n")).unionByName(docs.agg(F.lit("all").alias("source"), (F.count("*") * 9770).alias("n")))
    return d.select("source", "n", scalars.short_count(F.col("n")).alias("shown"))


@query(
    "edit_patterns",
    """SELECT count(*) AS total_edits, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 4) AS bot_edit_ratio, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 4) AS revert_ratio, round(avg(abs(floor(value))), 1) AS avg_edit_size_bytes,
 count(DISTINCT CASE WHEN event_type NOT IN ('error', 'signup') THEN user_id END) AS unique_human_editors, round(avg(CASE WHEN event_type = 'signup' THEN 1.0 ELSE 0.0 END), 4) AS anon_editor_ratio, (SELECT string_agg(h || '=' || n, ',' ORDER BY h) FROM (SELECT hour(ts) AS h, count(*) AS n FROM events GROUP BY 1)) AS hours FROM events""",
)
def _edits(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    edits = e.select(
        F.col("user_id").cast("string").alias("user"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.when(F.col("event_type") == "click", "Reverted edits").otherwise("ok").alias("comment"), F.array(F.lit("mobile")).alias("tags"),
        (F.col("event_type") == "error").alias("bot"), (F.col("event_type") == "signup").alias("anon"), F.lit(0).cast("long").alias("oldlen"), F.floor("value").alias("newlen"),
    )
    d = summary.edit_patterns(edits)
    hours = F.array_join(F.transform(F.map_entries("hourly_distribution"), lambda x: F.concat(x["key"].cast("string"), F.lit("="), x["value"].cast("string"))), ",")
    return d.select("total_edits", *[F.round(c, 4).alias(c) for c in ("bot_edit_ratio", "revert_ratio")], F.round("avg_edit_size_bytes", 1).alias("avg_edit_size_bytes"), "unique_human_editors", F.round("anon_editor_ratio", 4).alias("anon_editor_ratio"), hours.alias("hours"))


_META_SQL = "(SELECT 'k' || CAST(item_id AS VARCHAR) AS key, text AS value, item_id FROM benchmark)"


@query("meta_upsert", f"WITH m AS {_META_SQL}, o AS (SELECT key, value FROM m WHERE item_id % 2 = 0), n AS (SELECT key, 'new' AS value FROM m WHERE item_id % 3 = 0) SELECT * FROM n UNION ALL SELECT * FROM o WHERE key NOT IN (SELECT key FROM n)")
def _meta(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "benchmark").select(F.concat(F.lit("k"), F.col("item_id").cast("string")).alias("key"), F.col("text").alias("value"), "item_id")
    return summary.upsert_meta(m.where("item_id % 2 = 0").select("key", "value"), m.where("item_id % 3 = 0").select("key", F.lit("new").alias("value")))


@query("public_meta", f"WITH m AS {_META_SQL} SELECT key, value FROM m WHERE key IN ('k1', 'k2')")
def _public(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "benchmark").select(F.concat(F.lit("k"), F.col("item_id").cast("string")).alias("key"), F.col("text").alias("value"))
    return summary.public_meta(m, ("k1", "k2"))


# ── series ──


def _width(spark: SparkSession, sf: str) -> int:
    return timeseries.anomaly_width(series(spark, sf).count())


_CUSUM_SQL = f"""WITH RECURSIVE {SERIES}, st AS (SELECT avg(aliveness_index) AS mu, CASE WHEN stddev_pop(aliveness_index) > 0 THEN stddev_pop(aliveness_index) ELSE 1 END AS sd FROM series),
 xs AS (SELECT row_number() OVER (ORDER BY date) AS i, date, aliveness_index AS v, (aliveness_index - mu) / sd AS x FROM series, st),
 f(i, date, v, p, n, hit) AS (SELECT CAST(0 AS BIGINT), NULL::DATE, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, false
  UNION ALL SELECT xs.i, xs.date, xs.v, CASE WHEN greatest(0.0, CASE WHEN f.hit THEN 0 ELSE f.p END + x - 0.5) > 4 OR greatest(0.0, CASE WHEN f.hit THEN 0 ELSE f.n END - x - 0.5) > 4 THEN 5 ELSE greatest(0.0, CASE WHEN f.hit THEN 0 ELSE f.p END + x - 0.5) END,
   greatest(0.0, CASE WHEN f.hit THEN 0 ELSE f.n END - x - 0.5), greatest(0.0, CASE WHEN f.hit THEN 0 ELSE f.p END + x - 0.5) > 4 OR greatest(0.0, CASE WHEN f.hit THEN 0 ELSE f.n END - x - 0.5) > 4 FROM f JOIN xs ON xs.i = f.i + 1)
 """


@query("cusum_changepoints", _CUSUM_SQL + "SELECT date, v AS aliveness_index FROM f WHERE hit")
def _cusum(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.cusum(series(spark, sf), "aliveness_index")


@query("label_anomalies", _CUSUM_SQL.rstrip() + f", z AS (SELECT date, {_z_sql(30, 3)} AS z FROM series) SELECT z.date, round(z, 3) AS z_score, CASE WHEN z > 2.5 THEN 'spike' WHEN z < -2.5 THEN 'drop' ELSE '' END AS anomaly_type, coalesce(abs(z) > 2.5, false) AS is_anomaly, coalesce(hit, false) AS cusum_flag FROM z LEFT JOIN f ON f.date = z.date")
def _label(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.label_anomalies(series(spark, sf)).select("date", "z_score", "anomaly_type", "is_anomaly", "cusum_flag")


@query("rolling_zscore", f"WITH {SERIES}, z AS (SELECT date, {_z_sql(30, 5)} AS z FROM series) SELECT date, coalesce(abs(z) > 2.5, false) AS is_outlier FROM z")
def _rolling(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.rolling_zscore(series(spark, sf), "aliveness_index").select("date", "is_outlier")


@query("notable_anomalies", f"WITH {SERIES}, z AS (SELECT date, aliveness_index, {_z_sql(30, 3)} AS z FROM series), a AS (SELECT *, rank() OVER (ORDER BY abs(round(z, 3)) DESC) AS k FROM z WHERE abs(z) > 2.5) SELECT date, aliveness_index AS score, round(z, 3) AS z_score, CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS type FROM a WHERE k <= 10")
def _notable(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.notable_anomalies(timeseries.label_anomalies(series(spark, sf)), 10)


def _slope_sql(width: int) -> str:
    w = f"OVER (ORDER BY date ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(aliveness_index) {w} = {width} THEN regr_slope(aliveness_index, rn) {w} END"


_TREND_SQL = "CASE WHEN s30 IS NULL THEN 'unknown' WHEN abs(s30) < 0.05 THEN 'stable' WHEN s30 < -0.3 THEN 'crash' WHEN s30 < 0 THEN 'declining' ELSE 'recovering' END"
_SLOPES = f"WITH {SERIES}, o AS (SELECT date, aliveness_index, CAST(row_number() OVER (ORDER BY date) AS DOUBLE) AS rn FROM series), sl AS (SELECT date, aliveness_index, {_slope_sql(90)} AS s90, {_slope_sql(30)} AS s30 FROM o)"
_SD = "(5 + 10 * (1 - abs(aliveness_index - 50) / 50))"


@query("decay_rate", _SLOPES + " SELECT date, round(s90, 4) AS decay_rate_90d, round(s30, 4) AS decay_rate_30d FROM sl")
def _decay(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.enrich_timeline(series(spark, sf)).select("date", "decay_rate_90d", "decay_rate_30d")


@query(
    "enrich_timeline",
    _SLOPES + f" SELECT date, {_TREND_SQL.replace('s30', 'round(s30, 4)')} AS trend, round(100 - aliveness_index, 1) AS synthetic_pct, round(greatest(0.0, least(100.0, 100 - aliveness_index - 1.96 * {_SD})), 1) AS synthetic_low, round(greatest(0.0, least(100.0, 100 - aliveness_index + 1.96 * {_SD})), 1) AS synthetic_high FROM sl",
)
def _enrich(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.enrich_timeline(series(spark, sf)).select("date", "trend", "synthetic_pct", "synthetic_low", "synthetic_high")


@query("synthetic_estimate", f"WITH {SCORED}, x AS (SELECT doc_id, aliveness_score AS aliveness_index FROM scored WHERE aliveness_score IS NOT NULL) SELECT doc_id, round(100 - aliveness_index, 1) AS pct, round(greatest(0.0, least(100.0, 100 - aliveness_index - 1.96 * {_SD})), 1) AS low, round(greatest(0.0, least(100.0, 100 - aliveness_index + 1.96 * {_SD})), 1) AS high FROM x")
def _estimate(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).where("aliveness_score is not null").select("doc_id", timeseries.synthetic_estimate(F.col("aliveness_score")).alias("s")).select("doc_id", "s.*")


@query("trend", "SELECT event_id, CASE WHEN abs(value / 100 - 2) < 0.05 THEN 'stable' WHEN value / 100 - 2 < -0.3 THEN 'crash' WHEN value / 100 - 2 < 0 THEN 'declining' ELSE 'recovering' END AS trend FROM events")
def _trend(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", timeseries.trend(F.col("value") / 100 - 2).alias("trend"))


@query("platform_trends", f"WITH {DAILY}, p AS (SELECT date, source, avg(mean_score) AS mean_score FROM daily GROUP BY 1, 2) SELECT source, date, {r('avg(mean_score) OVER (PARTITION BY source ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 'smoothed')} FROM p WHERE source IN ('click', 'view', 'purchase') AND date >= DATE '2024-01-05'")
def _platforms(spark: SparkSession, sf: str) -> DataFrame:
    p = daily(spark, sf).groupBy("date", "source").agg(F.avg("mean_score").alias("mean_score"))
    return rounded(timeseries.platform_trends(p, ["click", "view", "purchase"], F.lit("2024-01-05").cast("date"))).select("source", "date", "smoothed")


@query("asof_join", "SELECT e.event_id, o.o_orderkey AS o_orderkey FROM (SELECT event_id, user_id, CAST(ts AS TIMESTAMP) - INTERVAL 8000 DAY AS at FROM events) e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.at >= o.o_orderdate")
def _asof(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", (F.col("ts").cast("timestamp") - F.expr("interval 8000 days")).alias("at"))
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("ordered")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return ranges.asof_join(e, o, ["user_id"], "at", "ordered", ["o_orderkey"]).select("event_id", "o_orderkey")


# ── keys, joins, sets ──


@query("dedup_keep_first", f"WITH {SILVER} SELECT doc_id, source, content_hash FROM silver QUALIFY row_number() OVER (PARTITION BY source, content_hash ORDER BY ord) = 1")
def _first(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.keep_first(silver(spark, sf).select("doc_id", "source", "content_hash", "ord"), ["ord"]).drop("ord")


@query("dedup_keep_last", f"WITH {SILVER} SELECT doc_id, source, content_hash FROM silver QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY ord DESC) = 1")
def _last(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.keep_last(silver(spark, sf).select("doc_id", "source", "content_hash", "ord"), "content_hash", ["ord"]).drop("ord")


@query("incremental_antijoin", f"WITH {SILVER} SELECT doc_id, source FROM silver WHERE ord % 3 <> 0 AND ord % 5 <> 0")
def _anti(spark: SparkSession, sf: str) -> DataFrame:
    s = silver(spark, sf)
    return dedup.new_rows(s, s.where("ord % 3 = 0"), s.where("ord % 5 = 0")).select("doc_id", "source")


@query("semi_inserted", f"WITH {SILVER} SELECT doc_id, source FROM silver WHERE ord IN (SELECT doc_id FROM labels)")
def _semi(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.inserted(silver(spark, sf), table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))).select("doc_id", "source")


@query("newest_topk", f"WITH {SILVER} SELECT doc_id, date FROM silver ORDER BY date DESC NULLS LAST, doc_id LIMIT 600")
def _newest(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.newest(silver(spark, sf).select("doc_id", "date"), 600, "date")


@query("head_per_group", f"WITH {SILVER} SELECT source, doc_id FROM silver QUALIFY row_number() OVER (PARTITION BY source ORDER BY ord) <= 5")
def _head(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.head_per_group(silver(spark, sf).select("source", "doc_id", "ord"), ["source"], ["ord"], 5).drop("ord")


@query("hash_sample", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7'), doc_id LIMIT 100")
def _sample(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.hash_sample(_DOCS(spark, sf).select("doc_id"), "doc_id", 100, 7)


@query("crawl_frontier", "WITH d AS (SELECT DISTINCT source AS id FROM documents), c AS (SELECT * FROM (VALUES ('src5', 0), ('src3', 1), ('nowhere', 2)) t(id, k)), a AS (SELECT id, 0 AS g, k FROM c WHERE id IN (SELECT id FROM d) UNION ALL SELECT id, 1, row_number() OVER (ORDER BY id DESC) FROM d WHERE id > (SELECT max(id) FROM c)) SELECT id FROM a WHERE id <> 'src8' ORDER BY g, k LIMIT 4")
def _frontier(spark: SparkSession, sf: str) -> DataFrame:
    ids = _DOCS(spark, sf).select(F.col("source").alias("id")).distinct()
    configured = spark.createDataFrame([("src5", 0), ("src3", 1), ("nowhere", 2)], "id string, rank int")
    return dedup.frontier(configured, ids, spark.createDataFrame([("src8",)], "id string"), 4)


@query("doc_id_hash", "SELECT doc_id, substr(sha256(source || ':' || CAST(doc_id AS VARCHAR) || ':' || substr(text, 1, 64)), 1, 24) AS id FROM documents")
def _doc_id(spark: SparkSession, sf: str) -> DataFrame:
    return _DOCS(spark, sf).select("doc_id", scalars.doc_id(F.col("source"), F.col("doc_id").cast("string"), F.col("text")).alias("id"))


@query("content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, substr(sha1(text), 1, 16) AS short_sha1 FROM documents")
def _hash(spark: SparkSession, sf: str) -> DataFrame:
    return _DOCS(spark, sf).select("doc_id", scalars.content_hash(F.col("text")).alias("content_hash"), scalars.short_sha1(F.col("text"), 16).alias("short_sha1"))


_NETLOC = r"regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def _category_sql(rules: dict[str, tuple[str, ...]]) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"ends_with(h, '{e}')" for e in ends) + f" THEN '{name}'" for name, ends in rules.items()) + " ELSE 'web' END"


@query("domain_extract", f"SELECT page_id, {_NETLOC} AS netloc, ltrim(lower({_NETLOC}), 'w.') AS host FROM pages")
def _host(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", scalars.host(F.col("url"), lower=False, cut_www=False).alias("netloc"), scalars.host(F.col("url")).alias("host"))


_VARIANTS = "('https://www.nytimes.com/a'), ('http://www.washingtonpost.com/x'), ('https://en.wikipedia.org/wiki/A'), ('https://netflix.com'), ('https://user:pw@old.reddit.com:8080/r'), ('no scheme'), ('https://blog.medium.com/p'), ('https://lobste.rs/s/1')"


@query("domain_category", f"WITH u AS (SELECT url FROM pages UNION ALL SELECT * FROM (VALUES {_VARIANTS}) t(url)), x AS (SELECT ltrim(lower({_NETLOC}), 'w.') AS h FROM u) SELECT h AS host, {_category_sql(scalars.CRAWL_CATEGORIES)} AS crawl, {_category_sql(scalars.ARCHIVE_CATEGORIES)} AS archive, count(*) AS n FROM x GROUP BY 1, 2, 3")
def _category(spark: SparkSession, sf: str) -> DataFrame:
    extra = spark.sql(f"SELECT * FROM VALUES {_VARIANTS} AS t(url)")
    h = table(spark, sf, "pages").select("url").unionByName(extra).select(scalars.host(F.col("url")).alias("host"))
    return h.groupBy("host").agg(F.count("*").alias("n")).select("host", scalars.host_category(F.col("host")).alias("crawl"), scalars.host_category(F.col("host"), scalars.ARCHIVE_CATEGORIES).alias("archive"), "n")


_WORDS = ", ".join(f"'{w}'" for w in scalars.ENGLISH_WORDS)


@query("english_filter", rf"SELECT doc_id FROM documents WHERE len(list_intersect(list_distinct(regexp_split_to_array(lower(substr(text, 1, 600)), '\s+')), [{_WORDS}])) >= 4")
def _english(spark: SparkSession, sf: str) -> DataFrame:
    return _DOCS(spark, sf).where(scalars.is_english(F.col("text"))).select("doc_id")


@query("comment_flatten", "SELECT conv_id, turn, length(trim(text, ' \n\t')) AS n FROM conversations WHERE turn > 0 AND length(trim(text, ' \n\t')) > 15")
def _flatten(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    posts = c.where("turn > 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("comments"))
    flat = posts.select("conv_id", F.explode("comments").alias("c")).select("conv_id", "c.turn", F.length(scalars.strip(F.col("c.text"))).cast("long").alias("n"))
    return flat.where("n > 15")


@query("parent_child_join", "SELECT a.conv_id, a.turn, length(q.text) AS parent_chars, length(a.text) AS chars FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = 0 WHERE a.turn > 0")
def _parent(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    q = c.where("turn = 0").select("conv_id", F.length("text").cast("long").alias("parent_chars"))
    return c.where("turn > 0").join(q, "conv_id").select("conv_id", "turn", "parent_chars", F.length("text").cast("long").alias("chars"))


@query("lookup_join", "SELECT CAST(s.s_suppkey AS BIGINT) AS s_suppkey, coalesce(n.n_name, CAST(s.s_nationkey AS VARCHAR)) AS nation FROM supplier s LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n ON n.n_nationkey = s.s_nationkey")
def _lookup(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    s = table(spark, sf, "supplier")
    return s.join(n, "s_nationkey", "left").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.coalesce("n_name", F.col("s_nationkey").cast("string")).alias("nation"))


@query("set_union", "SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def _union(spark: SparkSession, sf: str) -> DataFrame:
    return _DOCS(spark, sf).select("doc_id").union(table(spark, sf, "labels").select("doc_id")).distinct()


@query("set_union_all", "SELECT doc_id, source FROM documents UNION ALL SELECT doc_id, NULL FROM labels")
def _union_all(spark: SparkSession, sf: str) -> DataFrame:
    return _DOCS(spark, sf).select("doc_id", "source").unionByName(table(spark, sf, "labels").select("doc_id"), allowMissingColumns=True)


@query("set_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _except(spark: SparkSession, sf: str) -> DataFrame:
    return _DOCS(spark, sf).select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@query("set_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def _intersect(spark: SparkSession, sf: str) -> DataFrame:
    return _DOCS(spark, sf).select("doc_id").intersect(table(spark, sf, "labels").where("quality = 1").select("doc_id"))


@query("time_formats", "SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS at FROM events")
def _times(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    forms = [F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.concat(F.lit("Mon, "), F.date_format(ts, "dd MMM yyyy HH:mm:ss"), F.lit(" +0000")), F.date_format(ts, "yyyyMMddHHmmss")]
    pick = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        pick = F.when(F.col("event_id") % len(forms) == i, f).otherwise(pick)
    return table(spark, sf, "events").select("event_id", scalars.any_time(pick).cast("timestamp_ntz").alias("at"))


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# ── the language model ──

_PAIR = "CASE WHEN i > 1 THEN t[i - 1] ELSE '<s>' END"
_NGRAMS = f"""g AS (SELECT doc_id, source, i, CASE WHEN i > 2 THEN t[i - 2] ELSE '<s>' END AS u, {_PAIR} AS v, t[i] AS w FROM (SELECT doc_id, source, t, unnest(range(1, len(t) + 1)) AS i FROM tok JOIN (SELECT doc_id, source FROM documents) USING (doc_id))),
 three AS (SELECT u, v, w, count(*) AS c FROM g WHERE source <> 'src1' GROUP BY 1, 2, 3), two AS (SELECT v, w, count(*) AS c FROM three GROUP BY 1, 2), one AS (SELECT w, count(*) AS c FROM two GROUP BY 1),
 a3 AS (SELECT u, v, sum(c) AS total, count(*) AS types FROM three GROUP BY 1, 2), a2 AS (SELECT v, sum(c) AS total, count(*) AS types FROM two GROUP BY 1), a1 AS (SELECT sum(c) AS total, count(*) AS types FROM one),
 d3 AS (SELECT round(count(CASE WHEN c = 1 THEN 1 END) / (count(CASE WHEN c = 1 THEN 1 END) + 2.0::DOUBLE * count(CASE WHEN c = 2 THEN 1 END)), 6) AS d FROM three),
 d2 AS (SELECT round(count(CASE WHEN c = 1 THEN 1 END) / (count(CASE WHEN c = 1 THEN 1 END) + 2.0::DOUBLE * count(CASE WHEN c = 2 THEN 1 END)), 6) AS d FROM two),
 q AS (SELECT g.doc_id, (coalesce(one.c, 0) + 0.5::DOUBLE) / (a1.total + 0.5::DOUBLE * (a1.types + 1)) AS p1, two.c AS c2, a2.total AS n2, a2.types AS t2, three.c AS c3, a3.total AS n3, a3.types AS t3, d2.d AS d2, d3.d AS d3
  FROM g CROSS JOIN a1 CROSS JOIN d2 CROSS JOIN d3 LEFT JOIN one USING (w) LEFT JOIN two USING (v, w) LEFT JOIN a2 ON a2.v = g.v LEFT JOIN three USING (u, v, w) LEFT JOIN a3 ON a3.u = g.u AND a3.v = g.v WHERE i <= 512 AND source <> 'src1'),
 p AS (SELECT doc_id, CASE WHEN n3 > 0 THEN (greatest(coalesce(c3, 0) - d3, 0) + d3 * t3 * p2) / n3 ELSE p2 END AS p FROM (SELECT *, CASE WHEN n2 > 0 THEN (greatest(coalesce(c2, 0) - d2, 0) + d2 * t2 * p1) / n2 ELSE p1 END AS p2 FROM q)),
 l AS (SELECT doc_id, -avg(ln(p)) AS loss FROM p GROUP BY doc_id)"""


@query("perplexity_scores", f"WITH {TOKENS}, {_NGRAMS} SELECT doc_id, CASE WHEN source <> 'src1' THEN round(CASE WHEN loss IS NULL THEN 0.5::DOUBLE ELSE ln(greatest(1.0::DOUBLE, least(1000.0::DOUBLE, exp(loss)))) / ln(1000.0::DOUBLE) END, 8) END AS score_perplexity FROM documents LEFT JOIN l USING (doc_id)")
def _perplexity(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of all sources but one train the model and are judged by it; the one that goes without has no score."""
    d = _DOCS(spark, sf).select("doc_id", "source", "text")
    judged = d.where("source <> 'src1'")
    found = ngrams.own_scores(judged)
    return d.join(found, "doc_id", "left").select("doc_id", F.round("score_perplexity", 8).alias("score_perplexity"))


# ── accounts ──

_GAPS = f"WITH {ACTIVITY}, g AS (SELECT account, ts - lag(ts) OVER (PARTITION BY account ORDER BY ts) AS gap FROM activity), m AS (SELECT account, count(*) AS ng, avg(gap) AS mu, stddev_pop(gap) AS sd FROM g WHERE gap > 0 GROUP BY 1), a AS (SELECT account, count(*) AS nt FROM activity GROUP BY 1), x AS (SELECT a.account, nt, coalesce(ng, 0) AS ng, mu, sd FROM a LEFT JOIN m USING (account))"


@query("bot_burstiness", _GAPS + f" SELECT account, {r('CASE WHEN nt < 3 OR ng < 2 THEN 0.5 ELSE ((sd - mu) / (sd + mu) + 1) / 2 END', 'burstiness', 6)} FROM x")
def _burst(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bots.burstiness(activity(spark, sf)), 6)


_REGULARITY = "CASE WHEN nt < 4 OR ng < 2 THEN 0.0 ELSE greatest(0.0, 1 - sd / mu / 1.5) END"


@query("bot_regularity", _GAPS + f" SELECT account, {r(_REGULARITY, 'regularity', 6)} FROM x")
def _regular(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bots.regularity(activity(spark, sf)), 6).select("account", "regularity")


@query("bot_velocity", f"WITH {ACTIVITY} SELECT account, {r('count(*) / greatest(1.0, (max(ts) - min(ts)) / 86400)', 'velocity', 6)} FROM activity GROUP BY 1")
def _velocity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bots.velocity(activity(spark, sf)), 6)


_ENGAGEMENT = "en AS (SELECT account, CASE WHEN count(*) < 5 THEN 0.0 ELSE avg(CASE WHEN sd > 0 AND abs((score - mu) / sd) > 3 THEN 1.0 ELSE 0.0 END) END AS engagement, count(*) AS ns FROM (SELECT account, score, avg(score) OVER (PARTITION BY account) AS mu, stddev_pop(score) OVER (PARTITION BY account) AS sd FROM activity) GROUP BY 1)"


@query("bot_engagement", f"WITH {ACTIVITY}, {_ENGAGEMENT} SELECT account, {r('engagement', 'engagement', 6)} FROM en")
def _engage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bots.engagement(activity(spark, sf)), 6).select("account", "engagement")


@query("bot_score", _GAPS + f", {_ENGAGEMENT} SELECT account, round(CASE WHEN nt >= 4 AND ns >= 5 THEN ({_REGULARITY} + engagement) / 2 WHEN nt >= 4 THEN {_REGULARITY} WHEN ns >= 5 THEN engagement ELSE 0.0 END, 4) AS bot_score FROM x JOIN en USING (account)")
def _bot_score(spark: SparkSession, sf: str) -> DataFrame:
    a = activity(spark, sf)
    both = bots.regularity(a).join(bots.engagement(a), "account")
    signals = [F.when(F.col("n_ts") >= 4, F.col("regularity")), F.when(F.col("n_scores") >= 5, F.col("engagement"))]
    return both.select("account", F.round(bots.bot_score(signals), 4).alias("bot_score"))


@query(
    "bot_cloning",
    r"""WITH p AS (SELECT conv_id AS account, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS w FROM conversations), n AS (SELECT account, count(*) AS n_texts FROM p GROUP BY 1),
 j AS (SELECT a.account, CASE WHEN CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0) > 0.1 THEN 1.0 ELSE 0.0 END AS hit FROM p a JOIN p b ON a.account = b.account AND a.turn < b.turn)
 SELECT n.account, n_texts, count(hit) AS n_pairs, round(coalesce(avg(hit), 0.0), 6) AS cloning FROM n LEFT JOIN j USING (account) GROUP BY 1, 2""",
)
def _cloning(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("account"), F.col("turn").alias("id"), "text")
    return rounded(bots.cloning(c, limit=0.1), 6)


@query("bot_cloning_sampled")
def _cloning_sampled(spark: SparkSession, sf: str) -> DataFrame:
    return bots.cloning(_DOCS(spark, sf).select(F.col("source").alias("account"), F.col("doc_id").alias("id"), "text"))


_ALIKE = """t AS (SELECT source AS account, doc_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')) AS w FROM documents WHERE source IS NOT NULL),
 nt AS (SELECT account, count(*) AS n_texts FROM t GROUP BY 1),
 j AS (SELECT a.account, count(*) AS alike FROM t a JOIN t b ON a.account = b.account AND a.doc_id < b.doc_id AND least(len(a.w), len(b.w)) > 0.85 * greatest(len(a.w), len(b.w)) - 1e-6
  AND CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) > 0.85 GROUP BY 1),
 cl AS (SELECT account, n_texts, n_texts * (n_texts - 1) // 2 AS n_pairs, CASE WHEN n_texts > 1 THEN CAST(coalesce(alike, 0) AS DOUBLE) / (n_texts * (n_texts - 1) // 2) ELSE 0.0 END AS cloning FROM nt LEFT JOIN j USING (account))"""


@query("bot_cloning_all_pairs", f"WITH {_ALIKE} SELECT account, n_texts, CAST(n_pairs AS BIGINT) AS n_pairs, {r('cloning', 'cloning', 10)} FROM cl")
def _cloning_all(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bots.cloning_of_all(_DOCS(spark, sf).select(F.col("source").alias("account"), "text")), 10)


_BY_SOURCE = _GAPS.replace("user_id AS account", "'src' || CAST(user_id % 12 AS VARCHAR) AS account")


@query(
    "bot_score_all_signals",
    _BY_SOURCE + f""", {_ENGAGEMENT}, {_ALIKE},
 s AS (SELECT coalesce(x.account, cl.account) AS account, CASE WHEN nt >= 4 THEN {_REGULARITY} END AS regularity, CASE WHEN n_texts >= 2 THEN cloning END AS cloning, CASE WHEN ns >= 5 THEN engagement END AS engagement FROM x JOIN en USING (account) FULL JOIN cl ON cl.account = x.account)
 SELECT account, round(regularity, 6) AS regularity, round(cloning, 8) AS cloning, round(engagement, 6) AS engagement, round(coalesce(list_avg(list_filter([regularity, cloning, engagement], lambda v: v IS NOT NULL)), 0.0), 4) AS bot_score FROM s""",
)
def _bot_score_all(spark: SparkSession, sf: str) -> DataFrame:
    a = activity(spark, sf).withColumn("account", F.concat(F.lit("src"), (F.col("account") % 12).cast("string")))
    s = bots.account_scores(a, _DOCS(spark, sf).select(F.col("source").alias("account"), "text"))
    return s.select("account", F.round("regularity", 6).alias("regularity"), F.round("cloning", 8).alias("cloning"), F.round("engagement", 6).alias("engagement"), F.round("bot_score", 4).alias("bot_score"))


# ── HTML ──


@query("html_strip", rf"SELECT page_id, {html.STRIP_SQL} AS text FROM pages")
def _strip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.strip_tags(F.col("html")).alias("text"))


@query("html_title", rf"SELECT page_id, {html.TITLE_SQL} AS title FROM pages")
def _title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.title(F.col("html")).alias("title"))


for _module in (bronze_queries, payload_queries, store_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
_HOURS = """s AS (SELECT event_type AS source, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS hour, round(avg(value), 6) AS value FROM events GROUP BY 1, 2),
 m AS (SELECT source, round(avg(value), 6) AS mu, round(stddev_pop(value), 6) AS sd FROM s GROUP BY 1),
 x AS (SELECT source, hour, value, (value - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS d, row_number() OVER (PARTITION BY source ORDER BY hour) AS i FROM s JOIN m USING (source))"""


@query(
    "stream_change_points",
    f"""WITH RECURSIVE {_HOURS}, f AS (SELECT source, CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS p, 0.0::DOUBLE AS n, false AS hit FROM m
  UNION ALL SELECT source, i, CASE WHEN hit THEN 0.0::DOUBLE ELSE p END, CASE WHEN hit THEN 0.0::DOUBLE ELSE n END, hit FROM (SELECT *, p > 4 OR n > 4 AS hit
   FROM (SELECT f.source, x.i, greatest(0.0::DOUBLE, f.p + x.d - 0.5::DOUBLE) AS p, greatest(0.0::DOUBLE, f.n - x.d - 0.5::DOUBLE) AS n FROM f JOIN x ON x.source = f.source AND x.i = f.i + 1)))
 SELECT source, hour, value, 'alarm' AS kind FROM f JOIN x USING (source, i) WHERE hit""",
)
def _stream_change_points(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly means of each event type, read as a stream in four parts, measured against the whole."""
    root = f"{shared_dir(spark)}/change-points-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("hour"), "value")
    s = e.groupBy("source", "hour").agg(F.round(F.avg("value"), 6).alias("value"))
    reference = s.groupBy("source").agg(F.round(F.avg("value"), 6).alias("mu"), F.round(F.stddev_pop("value"), 6).alias("sd"))
    low, high = s.agg(F.min("hour"), F.max("hour")).first()
    for k in range(4):
        # the parts come one after the other, as the source takes files by age
        part = F.least(F.lit(3), F.floor((F.col("hour") - F.lit(low)) * 4 / F.lit(max(1, high - low)))) if low is not None else F.lit(0)
        s.where(part == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    found = changepoints.alarm_stream(stream, reference, "source", "hour", "value")
    incremental.run_available(found, lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/progress")
    return spark.read.schema("source string, hour bigint, value double, kind string").parquet(f"{root}/out").select("source", "hour", "value", "kind")


QUERIES["stream_incremental"] = incremental.events_by_batches
ORACLES["stream_incremental"] = "WITH " + DAILY + " SELECT date, source, category, n_docs, " + ", ".join(r(c, c) for c in ("mean_score", "median_score", "std_score", "pct_below_50")) + " FROM daily"
