import gzip
import os
import tempfile

import pytest

from tempora.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, shard int"
PAGES = [
    (5, "http://a/1", "x" * 200), (3, "http://a/2", "x" * 200), (9, "http://a/3", "short"), (2, "http://a/4", "short"), (7, None, None),
    (8, "http://b/ü", "é🙂" * 60), (11, "http://b/2", "é🙂" * 60), (None, "http://c", "x" * 200), (12, "http://d", ""), (1 << 60, "http://e", "far away " * 30),
]


def pages(spark, parts=3, rows=PAGES):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA).repartition(parts)


def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-warc-") + "/w"


def archives(path):
    root = path.removeprefix("file://")
    return {n: open(f"{root}/{n}", "rb").read() for n in sorted(os.listdir(root)) if n.endswith(".gz")}


def test_round_trip_and_revisits(spark):
    path = folder()
    warc.write(pages(spark), path)
    got = {r["page_id"]: r for r in warc.read(spark, path).collect()}
    assert len(got) == len(PAGES)
    want = {5: ("revisit", 3), 3: ("response", None), None: ("revisit", 3), 11: ("revisit", 8), 8: ("response", None), 9: ("response", None), 2: ("response", None)}
    for page, (kind, first) in want.items():
        assert (got[page]["record_type"], got[page]["refers_to"]) == (kind, first)
    for page, _, html in PAGES:
        assert got[page]["payload_bytes"] == len((html or "").encode())
        if got[page]["record_type"] == "response":
            assert got[page]["html"] == (html or "")


def test_same_archives_whatever_the_partitions(spark):
    a, b = folder(), folder()
    warc.write(pages(spark, 1), a, roll_bytes=700)
    warc.write(pages(spark, 7), b, roll_bytes=700)
    assert archives(a) == archives(b) and len(archives(a)) > 2
    assert not [n for n in os.listdir(a.removeprefix("file://")) if n.endswith(".tmp")]


def test_files_roll_and_members_stand_alone(spark):
    path = folder()
    rows = [(n, "http://x", f"page {n} " * 40) for n in range(60)]
    warc.write(pages(spark, 2, rows), path, roll_bytes=2000, least_shards=1)
    files = archives(path)
    assert len(files) > 3 and all(gzip.decompress(f).count(b"WARC/1.1\r\n") > 1 for f in files.values())


def test_a_damaged_archive_fails(spark):
    path = folder()
    warc.write(pages(spark), path)
    name, data = next(iter(archives(path).items()))
    with open(f"{path.removeprefix('file://')}/{name}", "wb") as f:
        f.write(data[:-9] + b"123456789")
    with pytest.raises(Exception):  # noqa: B017
        warc.read(spark, path).collect()


def test_uneven_ids_are_split_again(spark):
    rows = [(n, "u", "p" * 300) for n in range(200)] + [(1 << 50, "u", "p" * 10)]
    sizes = spark.createDataFrame([(r[0], len(r[2])) for r in rows], "page_id long, bytes long")
    assert warc.shard_map(sizes, 1 << 20, 10)[1] >= 9


def test_nothing(spark):
    path = folder()
    assert warc.write(pages(spark, 1, []), path).count() == 0 and warc.round_trip(pages(spark, 1, [])).count() == 0
