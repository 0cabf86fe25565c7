"""Best-fit packing of documents into sequences of fixed capacity, with certified bounds.

Every partition packs its own pieces by best fit, longest first, and dual feasible functions give a lower bound of the
sequences its pieces need.  A partition whose count equals its bound is certified.  The others release the pieces of their
emptiest sequences; groups of such partitions exchange what they released and pack it again, keeping the better result,
until one group is left or none has a gap.  Pieces are dealt by a stored row number, so groups are even however often a row repeats.

Null text is empty: one piece that holds the end mark alone.  A null doc_id is carried along.  Repeated rows are packed as
often as they occur.  Columns other than the id and the text are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierbook.llm.common import by_batch, stored

CAPACITY = 1024
END = 2
FAN_IN = 8
#: Longest run of white space that the rank file encodes.
BLANKS = 10_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", grp long, sequence_id long, offset long, bound long, used long, open boolean"


@cache
def encoder(ranks_file: str):
    """The byte-level vocabulary as ranks: the ids are those of the tokenizers file of the same vocabulary."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def slow_encoder(ranks_file: str):
    """The tokenizers file next to the rank file."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(ranks_file.removesuffix(".tiktoken") + ".json")
    model.encode_special_tokens = True
    return model


def ids_of(text: str, ranks_file: str) -> list[int]:
    """The ids of a text.  The pattern engine of the ranks gives up on very long runs of white space; the tokenizers file does not."""
    if len(text) >= BLANKS and max(map(len, re.findall(r"\s+", text)), default=0) >= BLANKS:
        return slow_encoder(ranks_file).encode(text, add_special_tokens=False).ids
    return encoder(ranks_file).encode_ordinary(text)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenised(docs: DataFrame, capacity: int, end: int, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; the ids themselves stay in the task, their checksum is kept."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ranks = vocabulary or default_vocabulary()
        out = [[], [], [], [], []]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = [*ids_of(text or "", ranks), end]
            raw = np.array(ids, "<u4")
            for k, (start, length) in enumerate(cut(len(ids), capacity)):
                for column, value in zip(out, (doc, k, start, length, zlib.crc32(raw[start : start + length])), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return by_batch(docs.select(F.col(id_col).cast("long"), F.col(text_col)), PIECES, rows)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Most sequences that dual feasible functions prove necessary.

    Thresholds: below t counts nothing, above capacity - t counts a whole sequence.  Rounding, for k: a length that is not a
    multiple of capacity / (k + 1) counts floor((k + 1) length / capacity) / k.  Both, one after the other.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = 0
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        exact = scaled % capacity == 0
        # in units of capacity * k, so that every value is whole
        rounded = np.where(exact, sizes * k, scaled // capacity * capacity)
        weight = counts * rounded
        whole, part = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(weight)])
        t = np.arange(0, capacity // 2 + 1)
        above = whole[-1] - whole[capacity - t + 1]
        between = part[capacity - t + 1] - part[t]
        most = int((above * capacity * k + between).max())
        best = max(best, -(-most // (capacity * k)))
    plain = int(-(-(counts * sizes).sum() // capacity))
    return max(best, plain)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, and the fill of each sequence; longest pieces first, into the fullest that fits."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fill = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += size
        rest = room - size
        if rest:
            rooms[rest].append(b)
            mask |= 1 << rest
    return where, offset, np.array(fill, np.int64)


def _pack_group(capacity: int, part_rows: int, level: int, last: bool):
    release = part_rows // FAN_IN

    def run(group: pa.Table) -> pa.Table:
        length = group["length"].to_numpy().astype(np.int64)
        order = np.lexsort((group["start"].to_numpy(), group["doc_id"].to_numpy(zero_copy_only=False), -length))
        group, length = group.take(pa.array(order)), length[order]
        grp = group["grp"][0].as_py()
        where, offset, fill = best_fit(length, capacity)
        base = (level << 58) | (grp << 22)
        names = where + base
        if level:  # keep what came in if packing again gave no gain
            old, at = np.unique(group["sequence_id"].to_numpy(), return_inverse=True)
            if len(old) <= len(fill):
                names, where, offset = group["sequence_id"].to_numpy(), at, group["offset"].to_numpy()
                fill = np.bincount(at, weights=length).astype(np.int64)
        bound, used = lower_bound(length, capacity), len(fill)
        out = np.zeros(used, bool)
        if used > bound and not last:
            pieces = np.bincount(where, minlength=used)
            emptiest = np.argsort(fill, kind="stable")
            emptiest = emptiest[(fill[emptiest] < capacity)]
            out[emptiest[np.cumsum(pieces[emptiest]) <= release]] = True
        keep = [group[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "grp")]
        n = len(length)
        return pa.table(
            [*keep, pa.array(names), pa.array(offset), pa.array(np.full(n, bound)), pa.array(np.full(n, used)), pa.array(out[where])],
            ["doc_id", "piece", "start", "length", "ids_crc32", "grp", "sequence_id", "offset", "bound", "used", "open"],
        )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_rows: int = 40_000) -> DataFrame:
    """Pieces with sequence_id, offset and whether the sequence's partition met its lower bound (certified)."""
    # the number is fixed by the written table, so a task that runs again deals as before
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, math.ceil(pieces.count() / part_rows))
    rows = pieces.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups))).drop("row")
    rows = rows.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    done, level = [], 0
    while True:
        last = groups == 1
        packed = stored(rows.groupBy("grp").applyInArrow(_pack_group(capacity, part_rows, level, last), PACKED), "packed")
        done.append(packed.where("not open"))
        if last:
            break
        level, groups = level + 1, math.ceil(groups / FAN_IN)
        rows = packed.where("open").withColumn("grp", F.pmod(F.xxhash64(F.lit(level), "grp"), F.lit(groups)) if groups > 1 else F.lit(0).cast("long"))
        rows = rows.select("doc_id", "piece", "start", "length", "ids_crc32", "grp", "sequence_id", "offset")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", F.expr("used = bound").alias("certified"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None) -> DataFrame:
    return pack(tokenised(docs, capacity, end, vocabulary), capacity)
