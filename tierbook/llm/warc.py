"""WARC archives of pages: writing with revisit records, and reading with boundary-chain verification.

Archives are uncompressed WARC 1.0 files, written by Spark's text writer (the blank lines after a record are its line
separator) and so on any store that Spark reaches.  Of rows with equal payloads that with the largest page_id is stored; the
others become revisit records that name it.

Reading splits the files at the magic line, which may as well stand inside a payload.  Each piece is a candidate: its offset
and header give the offset of its successor.  Pointer jumping from the start of a file keeps the candidates that can be
reached, which are the records; a record whose payload holds the magic is put together from its pieces in a second scan, which
finds them by their SHA-256, as the two scans may split the files at other places.
All candidates of one file meet in one task: their number is bounded by ``records_per_file`` of the writer (payloads are not
among them).

Null html is an empty payload.  Rows without page_id are written under the id ``none``, come back with a null page_id and
are named by others only if all rows of their payload lack an id (then all are responses).  Rows that repeat the largest
page_id of a payload are all responses.  Line breaks in a url become spaces, a null url is left out.  Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierbook.llm.common import stored
from tierbook.session import work_dir

MAGIC = "WARC/1.0\r\n"
GAP = "\r\n\r\n"
#: Base32 alphabet of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Repeated digests are broadcast up to this many (about 60 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 100_000


def base32_sha1(text: Column) -> Column:
    digest = F.sha1(text.cast("binary"))
    letters = []
    for i in range(8):
        group = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("long")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(group, shift).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)))
    return F.concat(*letters)


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, n_bytes, digest and refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("n_bytes", F.octet_length("html").cast("long")).withColumn("digest", base32_sha1(F.col("html")))
    large = rows.where(F.col("n_bytes") >= least_bytes)
    again = large.groupBy("digest", "n_bytes").agg(F.max("page_id").alias("original"), F.count("*").alias("rows"))
    again = stored(again.where("rows > 1 and original is not null").drop("rows"), "digests")
    few = again.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(again) if few else again, ["digest", "n_bytes"], "left")
    same = F.col("page_id").eqNullSafe(F.col("original"))
    return rows.withColumn("refers_to", F.when(~same, F.col("original"))).drop("original")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, records_per_file: int = 50_000) -> None:
    rows = with_roles(pages, least_bytes)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(GAP)
    )
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    url = F.regexp_replace("url", r"[\r\n]+", " ")
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("page_id")), F.lit(f"\r\nWARC-Date: {DATE}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _record_id(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"), F.lit(GAP),
    )
    archive = rows.withColumn("block", block).select(F.concat(head, "block").alias("value"))
    archive.write.option("lineSep", GAP).option("maxRecordsPerFile", records_per_file).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Text between magic lines, with the file and the start of the block it was read in."""
    text = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, block, number within the block, piece); Spark hands out the pieces of a block in order."""
    at, number = None, 0
    for batch in batches:
        for file, block, value in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            number = number + 1 if (file, block) == at else 0
            at = (file, block)
            yield file, block, number, value


def header(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, found, v in (x.partition(":") for x in lines) if found}


def facts(piece: bytes) -> tuple:
    """(header length, content length or -1, type, id, refers, digest) of a candidate."""
    end = piece.find(b"\r\n\r\n")
    fields = header(piece[:end]) if end >= 0 else {}
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        return 0, -1, None, None, None, None
    return end + 4, int(length), fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-payload-digest")


def payload(block: bytes) -> tuple[int, str]:
    """Length and digest of the payload of an HTTP block."""
    body = block[block.find(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else block
    return len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()


def http_length(block: bytes) -> int | None:
    value = header(block.split(b"\r\n\r\n")[0]).get("content-length", "")
    return int(value) if re.fullmatch(r"[0-9]{1,18}", value) else None


CANDIDATE = (
    "file string, block long, number long, size long, head long, content long, type string, id string, refers string, "
    "digest string, payload_bytes long, payload_digest string, mark string"
)
RECORD = "file string, type string, id string, refers string, digest string, payload_bytes long, payload_digest string, head long, content long, start long, pieces array<string>"


def _measure(kind: str | None, block: bytes) -> tuple:
    return (http_length(block), None) if kind == "revisit" else payload(block)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CANDIDATE.split(", ")]
    kinds = [pa.string() if x.split()[1] == "string" else pa.int64() for x in CANDIDATE.split(", ")]
    rows: list[tuple] = []

    def packed() -> pa.RecordBatch:
        return pa.record_batch([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for file, block, number, piece in numbered(batches):
        head, content, kind, name, refers, digest = facts(piece)
        whole = content >= 0 and head + content + 4 == len(piece)
        measured = _measure(kind, piece[head : head + content]) if whole else (None, None)
        rows.append((file, block, number, len(piece), head, content, kind, name, refers, digest, *measured, hashlib.sha256(piece).hexdigest()))
        if len(rows) == 5000:
            yield packed()
            rows.clear()
    if rows:
        yield packed()


def reachable(start: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 meets; start is sorted.  Each round doubles the jumps."""
    n = len(start)
    at = np.minimum(np.searchsorted(start, successor), n - 1)
    jump = np.append(np.where(start[at] == successor, at, n), n)
    mask = np.zeros(n + 1, bool)
    mask[np.searchsorted(start, 0)] = True
    for _ in range(max(1, n.bit_length())):
        mask[jump[np.flatnonzero(mask)]] = True
        jump = jump[jump]
    return np.flatnonzero(mask[:n])


def _records(group: pa.Table) -> pa.Table:
    group = group.sort_by([("block", "ascending"), ("number", "ascending")])
    size = group["size"].to_numpy()
    begin = np.concatenate([[0], np.cumsum(size + len(MAGIC))])[:-1]  # of the text after the magic
    start = begin - len(MAGIC)
    content = group["content"].to_numpy()
    # the piece before the first magic is no candidate, nor is one without a header
    successor = np.where((content >= 0) & (start >= 0), begin + group["head"].to_numpy() + content + 4, -1)
    kept = reachable(start, successor)
    kept = kept[successor[kept] >= 0]
    marks = group["mark"]
    ends = np.searchsorted(start, successor[kept])
    lists = [
        [] if group["payload_bytes"][int(i)].is_valid else marks.slice(int(i), int(e - i)).to_pylist()
        for i, e in zip(kept, ends, strict=True)
    ]
    out = group.take(pa.array(kept)).select(["file", "type", "id", "refers", "digest", "payload_bytes", "payload_digest", "head", "content"])
    return out.append_column("start", pa.array(start[kept], pa.int64())).append_column("pieces", pa.array(lists, pa.list_(pa.string())))


def _joined(group: pa.Table) -> pa.Table:
    group = group.sort_by("at")
    head, content = group["head"][0].as_py(), group["content"][0].as_py()
    if group.num_rows != group["parts"][0].as_py() or group["value"].null_count:
        raise ValueError(f"record {group['id'][0].as_py()} of {group['file'][0].as_py()}: pieces are missing")
    block = MAGIC.encode().join(group["value"].to_pylist())[head : head + content]
    if len(block) != content:
        raise ValueError(f"record {group['id'][0].as_py()} of {group['file'][0].as_py()}: {len(block)} bytes of {content}")
    size, digest = _measure(group["type"][0].as_py(), block)
    first = group.slice(0, 1).select(["file", "type", "id", "refers", "digest"])
    return first.append_column("payload_bytes", pa.array([size], pa.int64())).append_column("payload_digest", pa.array([digest], pa.string()))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: type, id, refers, digest (as stated), payload_bytes, payload_digest (as found; null for revisits)."""
    candidates = _pieces(spark, path).mapInArrow(_candidates, CANDIDATE)
    records = stored(candidates.groupBy("file").applyInArrow(_records, RECORD), "records")
    columns = ["file", "type", "id", "refers", "digest", "payload_bytes", "payload_digest"]
    split = records.where("size(pieces) > 0")
    out = records.where("size(pieces) = 0").select(*columns)
    if not split.isEmpty():
        wanted = split.select(
            "file", "type", "id", "refers", "digest", "head", "content", "start", F.size("pieces").alias("parts"), F.posexplode("pieces").alias("at", "mark")
        )
        raw = _pieces(spark, path).select(F.sha2("value", 256).alias("mark"), "value").join(wanted.select("mark").distinct(), "mark", "left_semi")
        found = wanted.join(raw.dropDuplicates(["mark"]), "mark", "left")
        kinds = "file string, type string, id string, refers string, digest string, payload_bytes long, payload_digest string"
        out = out.unionByName(found.groupBy("file", "start").applyInArrow(_joined, kinds))
    return out


def round_trip(pages: DataFrame, least_bytes: int = 0, records_per_file: int = 50_000) -> DataFrame:
    """Write the pages as archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, intact."""
    spark = pages.sparkSession
    path = work_dir(spark, "warc")
    write_archives(pages, path, least_bytes, records_per_file)
    stated = F.regexp_replace("digest", "^sha1:", "")

    def page(col: str) -> Column:
        return F.regexp_extract(col, r"^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("long")

    return read_archives(spark, path).select(
        page("id").alias("page_id"), "payload_bytes", F.coalesce("payload_digest", stated).alias("payload_digest"),
        F.col("type").alias("record_type"), page("refers").alias("refers_to"),
        F.coalesce(F.col("payload_digest") == stated, F.lit(True)).alias("intact"),
    )
