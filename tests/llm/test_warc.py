import base64
import hashlib
from pathlib import Path

from tierbook.llm import warc
from tierbook.session import work_dir

FAKE = "before WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:77>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\nWARC/1.0\r\nContent-Length: x\r\n\r\nafter"
SCHEMA = "page_id long, url string, html string, digest string, value int"


def expected(rows, least=0):
    out = []
    for page, _, html, *_ in rows:
        raw = (html or "").encode()
        same = [p for p, _, h, *_ in rows if (h or "") == (html or "") and p is not None]
        top = max(same, default=None)
        again = len(raw) >= least and page != top and top is not None
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page, len(raw), digest, "revisit" if again else "response", top if again else None))
    return out


def order(rows):
    return sorted(tuple(-1 if x is None else x for x in r) for r in rows)


ROWS = [
    (1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://b/\r\nX: y", ""), (5, "u", FAKE),
    (6, "u", FAKE), (7, "u", "WARC/1.0\r\n"), (8, "u", "é" * 1000), (9, "u", "a\r\n\r\nb\r\n"), (10, "u", "HTTP/1.1 200\r\n\r\nWARC/1.0\r\n\r\n"),
    (None, "u", "no id"), (None, "u", "<p>x</p>"), (12, "u", "twice"), (12, "u", "twice"), (13, "u", FAKE * 40),
]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "d", 1) for r in ROWS], SCHEMA).repartition(3)
    for least, per_file in ((0, 50_000), (5, 2)):
        found = warc.round_trip(pages, least, per_file)
        rows = found.collect()
        assert all(r["intact"] for r in rows)
        assert order(r[:5] for r in rows) == order(expected(ROWS, least))
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_records_across_blocks(spark):
    pages = spark.createDataFrame([(*r, "d", 1) for r in ROWS], SCHEMA).coalesce(1)
    path = work_dir(spark, "warc-test")
    warc.write_archives(pages, path)
    whole = order(tuple(str(x) for x in r[1:]) for r in warc.read_archives(spark, path).collect())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("150", "1000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            parts = order(tuple(str(x) for x in r[1:]) for r in warc.read_archives(spark, path).collect())
            assert parts == whole
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = [p.read_bytes() for p in Path(path).glob("part-*")]
    assert all(f.startswith(b"WARC/1.0\r\n") and f.endswith(b"\r\n\r\n") for f in files if f)


def test_scans_that_split_the_files_differently(spark, monkeypatch):
    pages = spark.createDataFrame([(*r, "d", 1) for r in ROWS], SCHEMA).coalesce(1)
    path = work_dir(spark, "warc-test")
    warc.write_archives(pages, path)
    whole = order(tuple(str(x) for x in r[1:]) for r in warc.read_archives(spark, path).collect())
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in names}

    def narrowed(df, label):
        out = stored(df, label)
        for k, v in zip(names, ("150", "1"), strict=True):
            spark.conf.set(k, v)
        return out

    stored = warc.stored
    monkeypatch.setattr(warc, "stored", narrowed)
    try:
        found = warc.read_archives(spark, path).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert order(tuple(str(x) for x in r[1:]) for r in found) == whole
