import json

from verascope.sources import cursors


def page(spark, path, cursor, after, ids):
    body = json.dumps({"continue": {"next": after}, "items": [{"id": i, "text": f"line\n{i}"} for i in ids]})
    cursors.write_pages(spark.createDataFrame([(cursor, body)], "cursor string, body string"), path)


def go_on(spark, root, **options):
    stream = cursors.cursor_pages(spark, f"{root}/in", "continue.next", "items", **options)
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}")
    cursors.take_all(stream, write, f"{root}/progress")
    return sorted((r.number, r.cursor, len(json.loads(r.body)["items"])) for r in spark.read.parquet(f"{root}/out").collect())


def test_a_restart_repeats_no_page_and_goes_on(spark, tmp_path):
    root, path = str(tmp_path), f"{tmp_path}/in"
    page(spark, path, "first", "c1", range(3))
    page(spark, path, "c1", "c2", range(2))
    page(spark, path, "elsewhere", None, range(9))
    assert go_on(spark, root, per_batch=1) == [(0, "first", 3), (1, "c1", 2)]
    # the page that was missing has come meanwhile
    page(spark, path, "c2", None, [])
    assert go_on(spark, root, per_batch=1) == [(0, "first", 3), (1, "c1", 2), (2, "c2", 0)]
    assert go_on(spark, root, per_batch=1) == [(0, "first", 3), (1, "c1", 2), (2, "c2", 0)]


def test_the_cap_ends_the_walk(spark, tmp_path):
    root, path = str(tmp_path), f"{tmp_path}/in"
    for k in range(6):
        page(spark, path, "first" if k == 0 else f"c{k}", f"c{k + 1}" if k < 5 else "", range(4))
    assert [n for n, *_ in go_on(spark, root, cap=9)] == [0, 1, 2]


def test_a_page_that_cannot_be_read_is_the_last(spark, tmp_path):
    root, path = str(tmp_path), f"{tmp_path}/in"
    page(spark, path, "first", "c1", range(2))
    cursors.write_pages(spark.createDataFrame([("c1", "<html>busy</html>")], "cursor string, body string"), path)
    reader = cursors._Reader({"path": path, "next": "continue.next", "items": "items"})
    rows, end = reader.read(reader.initialOffset())
    assert [r[0] for r in rows] == ["first", "c1"] and end == {"cursor": None, "pages": 2, "records": 2}
    assert [r[0] for r in reader.readBetweenOffsets({"cursor": "first", "pages": 0, "records": 0}, end)] == ["first", "c1"]
    assert reader.read(end)[1] == end and root
