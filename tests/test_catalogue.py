"""Every query against its SQL on the smallest tables; queries without SQL give rows."""

import duckdb
import pytest
from compare import connection, rows

from verascope.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    found = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLES:
        assert len(found)
        return
    assert rows(found) == rows(con.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["normalise_hackernews", "normalise_reddit", "silver_union"])
def test_documents_without_text_and_rare_white_space(spark, tmp_path, name):
    """A null or empty text makes no post; what SQL counts as white space at the ends goes, other white space stays."""
    white = ["", " ", "\n", "\u00a0", "\v", "\x1c", "\x85", "\u2003", "\u2028", "\u3000", "\u200b"]
    texts = [None, "", *white] + [t for w in white for t in (w + "ten words or so", "ten words or so" + w, "comment of sixteen"[:17] + w)]
    texts = [t for t in texts for _ in range(3)]  # every remainder of 3
    data = [(i * 41, t, "en", f"src{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
