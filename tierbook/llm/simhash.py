"""Near-duplicate groups by SimHash fingerprints.

A fingerprint bit is set if it is set in over half the shingle hashes of a document.  Fingerprints that differ in at most
three bits link.  Equal fingerprints form a class first, so copies never meet one another.  The 64 bits are split into six
blocks; two fingerprints within three bits agree in at least three blocks, so every choice of three blocks (20 of them, 31
bits or more) is an equality join key, and the Hamming distance is verified on what meets.

A key that more than ``crowd`` classes share is not joined pair by pair: there each fingerprint is listed under every centre
within two bits of it (over the bits outside the key).  Whatever lies within one bit of a centre links to everything within
two bits of it, and each pair within three bits has such a centre, so a star around one member gives the same groups with a
number of rows proportional to the members.

Words are runs outside ASCII white space after A-Z are lower-cased; shingles have three words, repeats included; fewer words
make one shingle, none gives fingerprint zero, which links like any other.  Null text is empty.  The nodes of the graph are the fingerprints;
ids are their values.  So rows without doc_id link like all others but never name a group (one that no id belongs to has a null
component_id), and texts under the same doc_id are told apart.  Repeated rows are returned as often as they occur.  Other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tierbook.llm.common import by_batch, components, lowered, stored

SHINGLE = 3
SEED = 42
BITS = 3
#: Block widths from the low end; they add up to 64.
BLOCKS = (11, 11, 11, 11, 10, 10)


def shingle_hashes(text: str | None) -> np.ndarray:
    words = lowered(text).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    return np.fromiter((xxh64_intdigest(s, SEED) for s in joined), np.uint64, len(words) - SHINGLE + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of every bit, counted in slices so that a long text needs no more memory than a short one."""
    ones = np.zeros(64, np.int64)
    for s in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[s : s + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(hashes)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a digest of the text and the fingerprint as a signed 64-bit number."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(shingle_hashes(t)) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.record_batch([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], ["doc_id", "mark", "fp"])

    read = docs.select(F.col(id_col).cast("long"), F.col(text_col), text_mark(text_col))
    return by_batch(read, "doc_id long, mark string, fp long", rows)


def text_mark(text_col: str) -> Column:
    """128 bits of the text."""
    return F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def block_masks() -> list[int]:
    """One mask for each choice of three blocks, as signed numbers."""
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    single = [((1 << w) - 1) << s for s, w in zip(starts, BLOCKS, strict=True)]
    out = []
    for chosen in combinations(single, len(BLOCKS) - BITS):
        mask = sum(chosen)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every centre within two bits outside the key, with its distance."""
    masks = np.array(block_masks(), np.int64)
    for batch in batches:
        for k in range(batch.num_rows):
            t, fp, node = (batch.column(c)[k].as_py() for c in range(3))
            free = [np.int64(np.uint64(1 << b).astype(np.int64)) for b in range(64) if not (int(masks[t]) >> b) & 1]
            one = np.array(free, np.int64)
            i, j = np.triu_indices(len(one), 1)
            flips = np.concatenate([np.zeros(1, np.int64), one, one[i] ^ one[j]])
            far = np.concatenate([np.zeros(1, np.int32), np.ones(len(one), np.int32), np.full(len(i), 2, np.int32)])
            n = len(flips)
            yield pa.record_batch(
                [pa.array(np.full(n, t, np.int32)), pa.array(flips ^ np.int64(fp)), pa.array(far), pa.array(np.full(n, node, np.int64))],
                ["t", "centre", "far", "node"],
            )


def links(classes: DataFrame, crowd: int = 256) -> DataFrame:
    """Edges (a, b) between class nodes that give the groups of all links; classes has fp and node, fp distinct."""
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks()])
    keys = classes.select("fp", "node", F.posexplode(masks).alias("t", "mask"))
    keys = stored(keys.select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "node"), "blocks")
    shared = stored(keys.groupBy("t", "key").count().where("count > 1"), "shared")
    few = keys.join(shared.where(F.col("count") <= crowd).select("t", "key"), ["t", "key"])
    left, right = few.alias("l"), few.alias("r")
    on = (F.col("l.t") == F.col("r.t")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node"))
    pairs = left.join(right, on & (distance(F.col("l.fp"), F.col("r.fp")) <= BITS))
    pairs = pairs.select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
    many = keys.join(shared.where(F.col("count") > crowd).select("t", "key"), ["t", "key"]).select("t", "fp", "node")
    near = many.mapInArrow(_crowded, "t int, centre long, far int, node long")
    hubs = near.where("far <= 1").groupBy("t", "centre").agg(F.min("node").alias("hub"))
    stars = near.join(hubs, ["t", "centre"]).where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    return pairs.union(stars)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = 256) -> DataFrame:
    """doc_id, mark, fp, fingerprint (hexadecimal), the group (its smallest fp) and component_id, the smallest doc_id reachable over links."""
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    found = components(links(classes.select("fp", F.col("fp").alias("node")), crowd)).withColumnRenamed("node", "fp")
    classes = stored(classes.join(found, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("group")), "grouped")
    named = classes.join(classes.groupBy("group").agg(F.min("low").alias("component_id")), "group").select("fp", "group", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", "mark", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "group", "component_id"
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = 256) -> DataFrame:
    """One row of each group, all columns: that with the smallest id (and text digest, where an id is repeated); one without an id only
    where no row of the group has one."""
    found = groups(docs, id_col, text_col, crowd)
    best = found.where("doc_id <=> component_id").groupBy("group").agg(F.min(F.struct("doc_id", "mark")).alias("k"))
    absent = F.lit(-(1 << 63)).cast("long")  # no id is lost to it: the text has to be equal as well
    kept = stored(best.select(F.coalesce("k.doc_id", absent).alias("id"), F.col("k.mark").alias("mark")).distinct(), "kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.coalesce(F.col(id_col).cast("long"), absent).alias("id"), text_mark(text_col).alias("mark"))
    once = rows.join(kept, ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"])
    return once.select(*[F.col("row")[c].alias(c) for c in docs.columns])
