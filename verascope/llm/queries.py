"""The opN queries over whole tables, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verascope.llm import bpe, decontaminate, html_text, langid, lm, negatives, passages, personal, phrases, quality_fm, quality_rules, secrets, simhash
from verascope.llm.common import fold, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = langid.train(docs, ~held_out)
    predicted = langid.predict(docs, model)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 5) == 0
    model = quality_fm.train(docs, labels, ~held_out)
    scored = quality_fm.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 1
    model, counts = lm.train(docs, ~held_out)
    scored = lm.score(docs, model, counts)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.train(secrets.built_in_findings(spark))
    return secrets.findings(table(spark, sf_dir, "documents"), forest)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digests(personal.personal_data(table(spark, sf_dir, "documents")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), lambda i: i % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_simhash": op1_simhash, "op2_html_extraction": op2_html_extraction, "op3_language_id": op3_language_id, "op4_substring_dedup": op4_substring_dedup, "op5_quality_classifier": op5_quality_classifier, "op6_lm_score": op6_lm_score, "op7_secret_scan": op7_secret_scan, "op8_quality_rules": op8_quality_rules, "op9_bpe": op9_bpe, "op10_decontamination": op10_decontamination, "op11_collocations": op11_collocations, "op12_personal_data": op12_personal_data, "op13_hard_negatives": op13_hard_negatives}


def _op8_sql(r: quality_rules.Rules = quality_rules.Rules()) -> str:
    """The rules as SQL: base counts, profiles of all rows by language, least distances, verdict."""
    cut = r"[\x20\x09-\x0D]+"
    gone = lambda c, pattern: f"regexp_replace({c}, '{pattern}', '', 'g')"
    half = "(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2"
    shares = ", ".join(f"CAST(c_{c} AS DOUBLE) / total AS q_{c}" for c in quality_rules.CLASSES)
    means = ", ".join(f"CAST(sum(c_{c}) AS DOUBLE) / sum(total) AS p_{c}" for c in quality_rules.CLASSES)
    by_class = " + ".join("(" + half.replace("p + q", f"p_{c} + q_{c}").replace("p > 0", f"p_{c} > 0").replace("q > 0", f"q_{c} > 0").replace("THEN p * log2(2 * p", f"THEN p_{c} * log2(2 * p_{c}").replace("THEN q * log2(2 * q", f"THEN q_{c} * log2(2 * q_{c}") + ")" for c in quality_rules.CLASSES)
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, text IS NOT NULL AS there, row_number() OVER () AS k FROM documents),
 r AS (SELECT *, {gone('text', r'\p{Ll}+')} AS r0 FROM d), r1 AS (SELECT *, {gone('r0', cut)} AS r1 FROM r), r2 AS (SELECT *, {gone('r1', r'\p{Lu}+')} AS r2 FROM r1), r3 AS (SELECT *, {gone('r2', r'\p{Nd}+')} AS r3 FROM r2),
 r4 AS (SELECT *, {gone('r3', '[#*$%&|<>]')} AS r4, list_filter(regexp_split_to_array(text, '{cut}'), lambda x: x <> '') AS w FROM r3),
 c AS (SELECT k, doc_id, lang, there, text, w, len(w) AS n_words, length(text) AS total, length(text) - length(r0) AS c_lower, length(r0) - length(r1) AS c_space, length(r1) - length(r2) AS c_upper, length(r2) - length(r3) AS c_digit, length(r3) - length(r4) AS c_symbol, length(r4) AS c_other FROM r4),
 lines AS (SELECT k, list_filter(string_split(text, chr(10)), lambda x: {gone('x', cut)} <> '') AS l FROM d),
 tri AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM c WHERE len(w) >= 3)),
 twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, t) AS n FROM tri) WHERE n > 1),
 rep AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY k),
 chosen AS (SELECT lang FROM c WHERE lang IS NOT NULL AND there GROUP BY lang HAVING sum(total - c_space) >= {r.profile_min_chars}),
 pc AS (SELECT lang, {means} FROM c JOIN chosen USING (lang) WHERE there GROUP BY lang),
 wl AS (SELECT k, lang, lower(unnest(w)) AS word FROM c), wc AS (SELECT lang, word, count(*) AS n FROM wl JOIN chosen USING (lang) GROUP BY 1, 2),
 pw AS (SELECT lang, word, CAST(n AS DOUBLE) / total AS p FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS total, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM wc) WHERE rank <= {r.common_words}),
 dw AS (SELECT k, word, count(*) AS n FROM wl WHERE word IN (SELECT word FROM pw) GROUP BY 1, 2),
 known AS (SELECT lang, sum(p) AS known FROM pw GROUP BY lang),
 js AS (SELECT k, lang, sum({half} - p / 2) AS js, sum(q) AS q FROM (SELECT dw.k, pw.lang, pw.p, CAST(dw.n AS DOUBLE) / c.n_words AS q FROM dw JOIN pw USING (word) JOIN c USING (k)) GROUP BY 1, 2),
 far AS (SELECT c.k, min(sqrt(greatest(0.0, known / 2 + coalesce(js, 0) + (SELECT {half} FROM (SELECT greatest(0.0, 1 - known) AS p, greatest(0.0, 1 - coalesce(js.q, 0)) AS q))))) AS word_distance FROM c CROSS JOIN known LEFT JOIN js ON js.k = c.k AND js.lang = known.lang WHERE c.n_words >= {r.word_min_words} AND (c.lang IS NULL OR c.lang IN (FROM chosen)) GROUP BY c.k),
 qc AS (SELECT k, {shares} FROM c WHERE total >= {r.class_min_chars} AND (lang IS NULL OR lang IN (FROM chosen))),
 fc AS (SELECT k, min(sqrt(greatest(0.0, {by_class}))) AS class_distance FROM qc CROSS JOIN pc GROUP BY k)
SELECT c.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(total - c_space AS BIGINT) AS word_chars, CAST(c_symbol AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
 n_words < {r.min_words} OR 100 * coalesce(rep.n, 0) > {r.max_repeat_percent} * n_words AS base_failed,
 NOT (n_words < {r.min_words} OR 100 * coalesce(rep.n, 0) > {r.max_repeat_percent} * n_words) AND coalesce(class_distance, 0) <= {r.max_class_distance} AND coalesce(word_distance, 0) <= {r.max_word_distance} AS kept
FROM c JOIN lines USING (k) LEFT JOIN rep USING (k) LEFT JOIN far USING (k) LEFT JOIN fc USING (k)"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every phrase of one to five words, every cut, every longer phrase.
_OP11_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
 total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
 f AS MATERIALIZED ({" UNION ALL ".join(f"SELECT lang, {k} AS k, phrase, CAST(count(*) AS HUGEINT) AS f FROM (SELECT lang, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM w)) GROUP BY lang, phrase HAVING count(*) >= 100" for k in range(1, 6))}),
 c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
 cuts AS (SELECT lang, k, phrase, f, cut, array_to_string(w[1:cut], ' ') AS a_part, array_to_string(w[cut + 1:], ' ') AS b_part FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
 s AS (SELECT cuts.lang, cuts.phrase, cuts.f AS a, x.f AS l, y.f AS r, n, 1000 * cuts.f * n // (x.f * y.f) AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = a_part JOIN f y ON y.lang = cuts.lang AND y.phrase = b_part JOIN total ON total.lang = cuts.lang
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, cut) = 1),
 gone AS (SELECT DISTINCT lang, phrase FROM (SELECT o.lang, o.f AS longer, array_to_string(o.w[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) o) JOIN c USING (lang, phrase) WHERE 100 * longer >= 100 * c.f)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM s ANTI JOIN gone USING (lang, phrase) QUALIFY rank <= 2000"""

#: Brute force: every anchor against every row.
_OP13_SQL = """
WITH raw AS (SELECT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, embedding AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
 fit AS (SELECT id, min({'label': label, 'v': list_transform(e, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))}) AS r FROM raw WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY id),
 rows AS (SELECT id, r.label AS label, r.v AS v FROM fit),
 s AS (SELECT a.id AS anchor_id, b.id AS other, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS score FROM rows a JOIN rows b ON a.id <> b.id WHERE a.id % 100 = 0),
 p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are held against brute force in tests/llm."""
    return {"op8_quality_rules": _op8_sql(), "op11_collocations": _OP11_SQL, "op13_hard_negatives": _OP13_SQL}
