"""Spelling variants: words within one inserted, deleted or replaced code point, by pairs of trie nodes.

The words are numbered in code-point order, and so are the nodes of the trie of their beginnings (forward) and of the trie of their
endings (reversed).  A pair (node of what precedes a place, node of what follows it) stands for a word with that place
skipped, or, if nothing is skipped, for the word itself split there.  Two words differ in one replaced code point if they share
a pair that skips one in both, and in one inserted code point if a pair that skips one in the longer word is a split of the
shorter one.  The pairs are integers, equal pairs mean equal texts, so what meets needs no verification; a pair is shared by at
most one word for each code point that may stand in the gap (90 by the word pattern) and one split, which bounds every group.
Each group adds to its words how many others it holds and which of them is the most frequent; no pairs of words are written out.

Words longer than ``NUMBERED`` code points would have a trie larger than the text; for them 128-bit digests of what precedes and
follows stand for the nodes, written as they stream over the word.  Words of exactly that length take part in both.

Words are counted per task before they are shuffled.  Null and empty texts hold no words; a null doc_id is hashed as an empty string.
Repeated rows count as often as they occur.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128

from tierbook.llm.common import lowered, stored
from tierbook.llm.order import numbered

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: One in so many runs loses a code point, chosen by a hash of document and run.
DAMAGED = 31
#: A form is so many times as frequent as its variant.
RATIO = 10
NUMBERED = 64
#: Words a task counts before it hands the counts on.
HELD = 400_000


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word and n over the rows of docs(doc_id, text)."""
    run_of = re.compile(f"[a-zÀ-ÿ]{{{max(1, least_length)},}}")

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
                for word, n in Counter(run_of.findall(lowered(text.as_py()).decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % DAMAGED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    counts[word] += n
                if len(counts) > HELD:
                    yield batch_of(counts)
                    counts = Counter()
        yield batch_of(counts)

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def trie_nodes(words: DataFrame) -> DataFrame:
    """For each word of words(id, word) the numbers of its nodes: ``before[i]`` of its first i code points, ``after[i]`` of the rest.

    The root, which is nothing, has number -1.  Nodes of both tries are numbered alike; equal numbers of one side mean equal strings.
    """
    places = words.select("id", "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    strings = places.select("id", F.lit(False).alias("tail"), "i", F.expr("substring(word, 1, i)").alias("string")).union(
        places.select("id", F.lit(True), F.col("i") - 1, F.expr("substring(word, i)"))
    )
    strings = stored(strings, "trie_strings")
    nodes = stored(strings.select("tail", "string").distinct().withColumn("node", F.monotonically_increasing_id()), "trie_nodes")
    found = strings.join(nodes, ["tail", "string"]).groupBy("id", "tail").agg(F.sort_array(F.collect_list(F.struct("i", "node"))).alias("path"))
    root = F.array(F.lit(-1).cast("long"))
    sides = found.groupBy("id").agg(
        F.max(F.when(~F.col("tail"), F.concat(root, F.col("path.node")))).alias("before"), F.max(F.when(F.col("tail"), F.concat(F.col("path.node"), root))).alias("after")
    )
    return stored(sides, "trie_paths")


def _numbered_pairs(words: DataFrame) -> DataFrame:
    """Rows (p, s, split, only, id, less) of the words by their trie nodes."""
    paths = trie_nodes(words.select("id", "word")).join(words, "id")
    places = paths.select("*", F.posexplode("before").alias("i", "p"))
    same = F.expr("i > 0 and substring(word, i + 1, 1) = substring(word, i, 1)")
    skips = places.where("i < length(word)").select("p", F.expr("after[i + 1]").alias("s"), F.lit(False).alias("split"), (~same).alias("only"), "id", "less")
    splits = places.select("p", F.expr("after[i]").alias("s"), F.lit(True).alias("split"), F.lit(True).alias("only"), "id", "less")
    return skips.union(splits)


def _digest_pairs(words: DataFrame) -> DataFrame:
    """The same for long words, with digests for nodes; one word at a time, written out in pieces."""

    def pieces(word: str) -> Iterator[tuple[bytes, ...]]:
        def stream(chars) -> Iterator[bytes]:
            state = xxh3_128()
            yield state.digest()
            for c in chars:
                state.update(c.encode())
                yield state.digest()

        after = b"".join(stream(reversed(word)))
        last, k = "", len(word)
        for i, p in enumerate(stream(word)):
            if i < k:
                yield p, after[16 * (k - i - 1) : 16 * (k - i)], False, word[i] != last
                last = word[i]
            yield p, after[16 * (k - i) : 16 * (k - i + 1)], True, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["p", "s", "split", "only"], [pa.binary(), pa.binary(), pa.bool_(), pa.bool_()]
        for batch in batches:
            for word, key, less in zip(*(batch.column(c) for c in range(3)), strict=True):
                held: list[tuple] = []
                found = pieces(word.as_py())
                while held := [row for _, row in zip(range(100_000), found, strict=False)]:
                    columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)]
                    ends = [pa.array([x.as_py()] * len(held), pa.int64()) for x in (key, less)]
                    yield pa.record_batch([*columns, *ends], [*names, "id", "less"])

    return words.select("word", "id", "less").mapInArrow(run, "p binary, s binary, split boolean, only boolean, id long, less long")


def _near(pairs: DataFrame) -> DataFrame:
    """For each word that shares a pair: how many near words it finds there and the most frequent of them.

    ``only`` marks one of the skipped places that give the same string (a run of one code point).
    """
    member = F.struct("less", "id", "split", "only")
    groups = pairs.groupBy("p", "s").agg(F.sort_array(F.collect_list(member)).alias("all")).where("size(all) > 1")
    groups = groups.select("all", F.expr("filter(all, x -> not x.split)").alias("skips"), F.expr("filter(all, x -> x.split)").alias("splits"))
    groups = groups.withColumn("longer", F.expr("filter(skips, x -> x.only)"))
    each = groups.select("skips", "splits", "longer", F.explode("all").alias("w"))
    others = F.expr("""case when w.split then longer
        else concat(filter(slice(skips, 1, 2), x -> x.id <> w.id), if(w.only, splits, array())) end""")
    count = F.expr("case when w.split then size(longer) else size(skips) - 1 + if(w.only, size(splits), 0) end")
    best = F.array_min(F.transform(others, lambda x: F.struct(x["less"].alias("less"), x["id"].alias("id"))))
    return each.select(F.col("w.id").alias("id"), count.alias("near"), best.alias("best")).where("near > 0")


def near_words(words: DataFrame, longest: int = NUMBERED) -> DataFrame:
    """id, n_near and best (less: minus the count, id) of the words(id, word, n) that have near words; ids in code-point order."""
    words = words.withColumn("less", -F.col("n"))
    size = F.length("word")
    short = _near(_numbered_pairs(words.where(size <= longest)))
    long = words.where(size >= longest)
    if long.isEmpty():
        return short.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    # words of the common length have met one another already; two of them are told apart by their length
    digests = stored(_digest_pairs(long), "digests")
    edge = long.where(size == longest).select("id", F.lit(True).alias("edge"))
    digests = digests.join(edge, "id", "left").where("not (coalesce(edge, false) and not split)").drop("edge")
    both = stored(short.union(_near(digests)), "near")
    return both.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """id and root of forms(id, form): forms are followed to the last, twice as far in every round."""
    cur = stored(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        ahead = cur.select(F.col("id").alias("root"), F.col("root").alias("further"))
        cur = stored(cur.join(ahead, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if cur.where("moved").isEmpty():
            return cur.select("id", "root")
        cur = cur.select("id", "root")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, longest: int = NUMBERED,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word that is long and frequent enough."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = stored(word_counts(rows, least_length).where(F.col("n") >= least_count), "words")
    words = stored(numbered(words, [F.col("word")], "id"), "vocabulary")
    near = stored(near_words(words, longest), "near")
    found = words.join(near, "id", "left")
    form = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.id"))
    found = stored(found.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form_id"),
                                F.when(form.isNotNull(), -F.col("best.less")).alias("form_n")), "found")
    last = roots(found.where("form_id is not null").select("id", F.col("form_id").alias("form")))
    name = words.select("id", "word")
    named = last.join(found.select("id", "form_id"), "id").join(name.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
    named = named.join(name.select(F.col("id").alias("form_id"), F.col("word").alias("form")), "form_id").select("id", "form", "root_word")
    out = found.join(named, "id", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
