import gzip
import random

import pytest
from pyspark.sql import functions as F

from verascope.sources import archives, bronze

ENGLISH = "It is the story of a man and the sea, and this was what he had for all his days. "


def block(i, kind="conversion", body=None, url=None):
    return f"WARC-Type: {kind}\r\nWARC-Target-URI: {url or f'https://site{i}.example/p'}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n\r\n{ENGLISH * 3 if body is None else body} number {i}\r\n\r\n"


def noise(n, seed):
    """Bytes that hold gzip headers by chance, and by intent."""
    rng = random.Random(seed)
    return "".join(chr(rng.randrange(32, 0x800)) for _ in range(n)) + "\x1f\x8b\x08" * 3


def write(path, blocks):
    path.write_bytes(b"".join(gzip.compress(archives.MARK + b.encode(), compresslevel=rng_level) for rng_level, b in zip([0, 1, 6, 9] * len(blocks), blocks, strict=False)))


def test_every_record_once_for_any_split(spark, tmp_path):
    blocks = [block(i, body=ENGLISH * (i % 5) + noise(50 * (i % 40), i)) for i in range(200)]
    write(tmp_path / "a.gz", blocks)
    # one member for the whole file
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"".join(archives.MARK + b.encode() for b in blocks[:50])))
    (tmp_path / "empty.gz").write_bytes(b"")
    (tmp_path / "other.txt").write_text("no archive")
    for split in (700, 30_000, 64 << 20):
        found = archives.read_archives(spark, str(tmp_path), split_bytes=split)
        rows = found.select(F.regexp_extract("file", "[^/]*$", 0).alias("f"), "at", "block").collect()
        for name, want in (("a.gz", blocks), ("b.gz", blocks[:50])):
            mine = [r.block for r in sorted((r for r in rows if r.f == name), key=lambda r: r["at"])]
            assert mine == want
    # ranges of the large file were read by many tasks
    assert archives.read_archives(spark, str(tmp_path / "a.gz"), split_bytes=30_000).select(F.spark_partition_id().alias("p")).distinct().count() > 3


def test_few_records_stop_the_reading(spark, tmp_path):
    blocks = [block(i, kind="warcinfo" if i % 3 == 0 else "conversion", body=noise(3000, i) if i % 3 == 1 else None) for i in range(400)]
    write(tmp_path / "a.gz", blocks)
    size = (tmp_path / "a.gz").stat().st_size
    few = archives.read_archives(spark, str(tmp_path), per_file=4)
    got = bronze.parse_archive_blocks(few, per_file=4).collect()
    assert sorted(r.url for r in got) == sorted(f"https://site{i}.example/p" for i in (2, 5, 8, 11))
    read = few.agg(F.max("read_to")).first()[0]
    assert read <= 200_000 < size
    whole = bronze.parse_archive_blocks(archives.read_archives(spark, str(tmp_path)), per_file=4).collect()
    assert sorted(r.url for r in whole) == sorted(r.url for r in got)


def test_written_archives_come_back(spark, tmp_path):
    rows = [(block(i),) for i in range(40)] + [("",)]
    archives.write_archives(spark.createDataFrame(rows, "block string").repartition(3), str(tmp_path / "out"))
    back = archives.read_archives(spark, str(tmp_path / "out"), split_bytes=1000)
    assert sorted(r.block for r in back.collect()) == sorted(b for b, in rows)
    assert len(list((tmp_path / "out").glob("*.gz"))) == 3 and not list((tmp_path / "out").glob("*.writing"))


@pytest.mark.parametrize("body", [ENGLISH, "kurz", ENGLISH * 2 + "\u3000\x85", "\x1c" * 90, "the and of is " * 10, " " * 100 + ENGLISH, "the\u2003and\u2003of\u2003is" + "x" * 90, ""])
def test_acceptance_is_that_of_the_expressions(spark, body):
    for url in ("https://www.a.example/x", "no url", "http://www/", "HTTPS://WWW.B.example?q"):
        for kind in ("conversion", "response"):
            b = block(1, kind, body, url)
            df = spark.createDataFrame([(b, "f", 1)], "block string, file string, at int")
            assert archives.accepted(b) == (bronze.parse_archive_blocks(df, per_file=None).count() == 1)
