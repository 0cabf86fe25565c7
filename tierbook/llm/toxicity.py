"""Toxicity scores by a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings: of the word itself and of its beginnings of several lengths.  The hash space is so
large that words hardly meet by chance; it is kept sparsely, as the rows of what the training texts hold often enough, and
all else is zero, so unknown words add nothing.  Filters of several widths run over the words of the whole text, each keeps
its maximum, and a logistic layer joins them.  Scores are calibrated by language: the offset that separates the training
texts of a language best moves its threshold to 0.5.  The language is guessed from common words of the text itself.

Training takes all labelled texts outside the held-out fifth, whole.  Up to ``AT_ONCE`` (and ``AT_ONCE_BYTES``) are trained in one place.
More are trained in rounds that take ever larger shares of them, each text in one round: groups of a round start from the same model, train on
their texts in tasks, and their changes are averaged; a group and the model are all that one place ever holds.  Which hashes count, and
the thresholds, are counted over all texts too.  Labels, lang, source and doc_id are never inputs of a score.

Null or empty texts score by the offset alone.  Documents without doc_id are scored and never used for training.  Repeated
documents each get the same score; a doc_id with several labels counts as toxic if any is.  Without labels of both kinds
every score is 0 (next to it: 4e-18).  Other columns are passed on; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierbook.llm.common import stored, words_of

PREFIXES = (4, 5, 6, 7, 8, 9)
WIDTHS = (1, 2, 3)
SIZE = 8
FILTERS = 8
#: Labelled texts (and their bytes) trained in one place; beyond, in groups of about half as many.
AT_ONCE = 4000
AT_ONCE_BYTES = 16 << 20
#: Shares of the texts, of 16, at which the rounds of groups end.
ROUNDS = (1, 2, 4, 8, 16)
#: How often a group sees a text of the rarer class at most.
SHOWN = 4
#: Changes of groups are summed as whole numbers of this size, so their order does not matter.
UNIT = 2.0**-36
#: Thresholds of groups lie on a grid of this width.
GRID = 1 / 64
LEAST_TEXTS = 3
#: Steps of training, and passes over the texts at most.
STEPS = 20_000
EPOCHS = 12
RATE = 0.05
#: Share of the words of a toxic text that a step does not see.
HIDDEN = 0.5
#: Words scored at a time, so that memory does not grow with the text.
CHUNK = 20_000
CACHE = 300_000
#: Common words that tell languages apart; anything else is language "".
COMMON = {
    "en": (b"the", b"of", b"and", b"to", b"that", b"with", b"for", b"is"),
    "fr": (b"le", b"les", b"des", b"est", b"que", b"dans", b"pas", b"une"),
    "de": (b"der", b"die", b"und", b"das", b"ist", b"von", b"nicht", b"zu"),
    "es": (b"el", b"los", b"las", b"que", b"por", b"una", b"del", b"y"),
}


#: Rows of a word at most: its own and those of its beginnings.
WORD_ROWS = 1 + len(PREFIXES)
WHOLE, BEGINNING = zlib.crc32(b"="), zlib.crc32(b"<")


def features(word: bytes) -> list[int]:
    """Hashes of the word and of its beginnings; beginnings are marked so that they are not taken for words."""
    out = [zlib.crc32(word, WHOLE)]
    out += [zlib.crc32(word[:n], BEGINNING) for n in PREFIXES if len(word) >= n]
    return out


def language(words: list[bytes]) -> str:
    """The language whose common words are most frequent among the words given."""
    counts = {name: 0 for name in COMMON}
    present = set(words)
    for name, common in COMMON.items():
        counts[name] = sum(w in present for w in common)
    best = max(counts, key=lambda name: (counts[name], name))
    return best if counts[best] else ""


@dataclass
class Model:
    rows: dict[int, int] = field(default_factory=dict)
    embedding: np.ndarray = field(default_factory=lambda: np.zeros((1, SIZE), np.float32))
    filters: list[np.ndarray] = field(default_factory=list)
    bias: list[np.ndarray] = field(default_factory=list)
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    offset: float = 0.0
    shift: dict[str, float] = field(default_factory=dict)

    def responses(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Of the filters of each width, at every place where that many words are left."""
        every = vectors @ np.concatenate([f for w in self.filters for f in w], axis=1)
        out, column = [], 0
        for width, b in zip(WIDTHS, self.bias, strict=True):
            n = len(vectors) - width + 1
            part = every[:n, column : column + FILTERS] + b
            for k in range(1, width):
                part += every[k : k + n, column + k * FILTERS : column + (k + 1) * FILTERS]
            out.append(part)
            column += width * FILTERS
        return out


#: Empty places after each text, so that the widest filter has room.
PAD = max(WIDTHS) - 1


class Encoder(dict):
    """Numbers and vectors of words, remembered up to a bounded number of words; number 0 is the empty place, and all words without a row."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.none = len(model.embedding) - 1  # its last row is zero
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.fresh: list[list[int]] = []
        self.vectors = np.zeros((1, SIZE), np.float32)

    def __missing__(self, word: bytes) -> int:
        # a text that holds a word holds its beginnings: without a row for the first, the others and the word have none
        known = len(word) < PREFIXES[0] or zlib.crc32(word[: PREFIXES[0]], BEGINNING) in self.model.rows
        rows = [at for at in map(self.model.rows.get, features(word)) if at is not None] if known else []
        if not rows:
            self[word] = 0
            return 0
        self.fresh.append(rows + [self.none] * (WORD_ROWS - len(rows)))
        at = self[word] = len(self.vectors) + len(self.fresh) - 1
        return at

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def table(self) -> np.ndarray:
        if self.fresh:
            new = self.model.embedding[np.array(self.fresh)].sum(axis=1, dtype=np.float32)
            self.vectors = np.concatenate([self.vectors, new])
            self.fresh.clear()
        return self.vectors


def logits(model: Model, encode: Encoder, texts: list[list[bytes]]) -> np.ndarray:
    """Of many texts at once; long ones in overlapping pieces, whose largest responses are joined."""
    if not len(model.weight):
        return np.full(len(texts), -50.0)
    best = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
    held: list[tuple[int, list[bytes]]] = []

    def flush() -> None:
        if len(encode) > CACHE:
            encode._forget()
        sizes = np.array([len(w) + PAD for _, w in held])
        starts = np.cumsum(sizes) - sizes
        ids = np.zeros(int(sizes.sum()) + 1, np.int64)
        for (_, words), s in zip(held, starts.tolist(), strict=True):
            ids[s : s + len(words)] = encode.numbers(words)
        owner = np.array([k for k, _ in held])
        for b, (width, part) in enumerate(zip(WIDTHS, model.responses(encode.table()[ids]), strict=True)):
            edges = np.stack([starts, starts + sizes - width + 1], axis=1).ravel()
            most = np.maximum.reduceat(part, np.minimum(edges, len(part) - 1))[::2]
            np.maximum.at(best[:, b * FILTERS : (b + 1) * FILTERS], owner, most)
        held.clear()

    total = 0
    for k, words in enumerate(texts):
        for s in range(0, max(1, len(words)), CHUNK - PAD):
            held.append((k, words[s : s + CHUNK]))
            total += len(held[-1][1]) + PAD
            if total > 2 * CHUNK:
                flush()
                total = 0
    if held:
        flush()
    return np.maximum(best, 0).astype(np.float64) @ model.weight + model.offset


def scores(model: Model, encode: Encoder, texts: list[str | None]) -> np.ndarray:
    words = [words_of(t) for t in texts]
    z = logits(model, encode, words)
    z += np.array([model.shift.get(language(w), model.shift.get("*", 0.0)) for w in words]).reshape(z.shape)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(texts: list[str], toxic: list[int], seed: int = 7) -> Model:
    """A model of the texts with thresholds by language."""
    labels = np.array(toxic, np.int64)
    if not len(labels) or labels.min() == labels.max():
        return Model()
    model = _trained(texts, labels, seed)
    _calibrate(model, texts, labels)
    return model


def _numbered(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Words of each text by number, and the hashes of every word; a short word repeats its first."""
    number: dict[bytes, int] = {}
    hashes, texts_ids = array("I"), []
    for text in texts:
        words = words_of(text)
        ids = np.empty(len(words), np.int32)
        for k, w in enumerate(words):
            at = number.get(w)
            if at is None:
                at = number[w] = len(number)
                found = features(w)
                hashes.extend(found + found[:1] * (WORD_ROWS - len(found)))
            ids[k] = at
        texts_ids.append(ids)
    return texts_ids, np.frombuffer(hashes, np.uint32).reshape(-1, WORD_ROWS)


def _texts_of_hashes(texts_ids: list[np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and the number of texts that hold each."""
    return np.unique(np.concatenate([np.unique(hashes[np.unique(ids)]) for ids in texts_ids]), return_counts=True)


def _rows_of_words(hashes: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Rows of each word; a short word has fewer beginnings, the places left point to the empty row."""
    none = len(held)
    table = np.searchsorted(held, hashes).astype(np.int32)
    table[(table == none) | (np.append(held, 0)[table] != hashes)] = none
    table[:, 1:][hashes[:, 1:] == hashes[:, :1]] = none
    return np.concatenate([table, np.full((1, WORD_ROWS), none, np.int32)])


def _untrained(rows: int, rng: np.random.Generator) -> Model:
    """Random filters and no word vectors yet; the last row stays empty."""
    model = Model()
    model.embedding = np.zeros((rows + 1, SIZE), np.float32)
    model.filters = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    model.bias = [np.full(FILTERS, 0.1, np.float32) for _ in WIDTHS]
    model.weight = np.abs(rng.normal(0, 0.3, FILTERS * len(WIDTHS)))
    model.offset = -1.0
    return model


def _trained(texts: list[str], labels: np.ndarray, seed: int) -> Model:
    """Gradient steps on the logistic loss, text by text; embeddings start at zero and change where filters look (Adagrad)."""
    rng = np.random.default_rng(seed)
    texts_ids, hashes = _numbered(texts)
    held, n = _texts_of_hashes(texts_ids, hashes)
    held = held[n >= LEAST_TEXTS]
    table = _rows_of_words(hashes, held)
    model = _untrained(len(held), rng)
    model.rows = {f: k for k, f in enumerate(held.tolist())}
    second = np.full(len(held) + 1, 1e-8)
    rate = RATE
    # the rarer class is shown as often as the other
    kinds = [np.flatnonzero(labels == y) for y in (0, 1)]
    most = max(map(len, kinds))
    shown = np.concatenate([np.resize(k, most) for k in kinds])
    epochs = max(1, min(EPOCHS, STEPS // len(shown)))
    for _ in range(epochs):
        _steps(model, second, table, texts_ids, labels, rng.permutation(shown), rng, rate)
        rate *= 0.1 ** (1 / epochs)
    return model


def _steps(model: Model, second: np.ndarray, table: np.ndarray, texts_ids: list[np.ndarray], labels: np.ndarray, order: np.ndarray,
           rng: np.random.Generator, rate: float) -> None:
    """One pass over the texts in this order."""
    none = len(model.embedding) - 1
    empty = np.zeros((PAD + 1, SIZE), np.float32)
    words_now = model.embedding[table].sum(axis=1)  # vectors of all words, kept up to date below
    for i in order.tolist():
        ids = texts_ids[i]
        vectors = np.concatenate([words_now[ids], empty])
        if labels[i]:  # words of toxic texts are hidden at random, so that each has to speak for itself
            vectors[: len(ids)][rng.random(len(ids)) < HIDDEN] = 0
        parts = model.responses(vectors)
        place = np.concatenate([p.argmax(axis=0) for p in parts])
        best = np.concatenate([p.max(axis=0) for p in parts])
        on = best > 0
        z = float(np.maximum(best, 0) @ model.weight + model.offset)
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[i]
        if abs(error) < 0.02:
            continue
        back = np.where(on, error * model.weight, 0.0)
        # what a filter finds speaks for toxicity or not at all, never against it
        model.weight = np.maximum(model.weight - 0.02 * error * np.maximum(best, 0), 0)
        model.offset -= 0.02 * error
        touched: dict[int, np.ndarray] = {}
        for b, w in enumerate(WIDTHS):
            filters = model.filters[b]
            for f in np.flatnonzero(on[b * FILTERS : (b + 1) * FILTERS]).tolist():
                g, at = back[b * FILTERS + f], int(place[b * FILTERS + f])
                for k in range(w):
                    if at + k < len(ids):
                        word = int(ids[at + k])
                        touched[word] = touched.get(word, 0) + g * filters[k, :, f]
                    filters[k, :, f] -= 0.02 * g * vectors[at + k]
                model.bias[b][f] -= 0.02 * g
        for word, g in touched.items():
            rows = table[word]
            rows = rows[rows < none]
            second[rows] += float(g @ g)
            model.embedding[rows] -= (rate * g[None, :] / np.sqrt(second[rows])[:, None]).astype(np.float32)
            words_now[word] = model.embedding[rows].sum(axis=0)


# -- groups ----------------------------------------------------------------------------------------------------


def _dense(model: Model) -> np.ndarray:
    """All that is trained but the word vectors, as one list, filled up to whole rows of changes."""
    flat = np.concatenate([*(f.ravel() for f in model.filters), *model.bias, model.weight, [model.offset]]).astype(np.float64)
    return np.append(flat, np.zeros(-len(flat) % CHANGE)).reshape(-1, CHANGE)


def _with_dense(model: Model, rows: np.ndarray) -> None:
    flat, at = rows.ravel(), 0

    def taken(shape: tuple[int, ...]) -> np.ndarray:
        nonlocal at
        at += int(np.prod(shape))
        return flat[at - int(np.prod(shape)) : at].reshape(shape)

    model.filters = [taken(f.shape).astype(np.float32) for f in model.filters]
    model.bias = [taken(b.shape).astype(np.float32) for b in model.bias]
    model.weight = np.maximum(taken(model.weight.shape), 0)
    model.offset = float(flat[at])


#: A row's vector and its second moment.
CHANGE = SIZE + 1
CHANGES = "row long, " + ", ".join(f"c{k} long" for k in range(CHANGE))


def _held_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts_ids, hashes = _numbered(batch.column(0).to_pylist())
        if len(hashes):
            held, n = _texts_of_hashes([ids for ids in texts_ids if len(ids)], hashes)
            yield pa.record_batch([pa.array(held.astype(np.int64)), pa.array(n)], ["hash", "n"])


def _group(shared, rate: float, seed: int):
    """What the texts of a group change in the model."""

    def run(group: pa.Table) -> pa.Table:
        model, second, held = shared.value
        group = group.sort_by("doc_id")
        model = Model(embedding=model.embedding.copy(), filters=[f.copy() for f in model.filters], bias=[b.copy() for b in model.bias], weight=model.weight, offset=model.offset)
        before, second_before, dense_before, second = model.embedding.copy(), second, _dense(model), second.copy()
        labels = np.array(group["toxic"].to_pylist(), np.int64)
        texts_ids, hashes = _numbered(group["text"].to_pylist())
        rng = np.random.default_rng([seed, group["group"][0].as_py()])
        kinds = [np.flatnonzero(labels == y) for y in (0, 1)]
        most = max(map(len, kinds))
        order = np.concatenate([np.resize(k, min(most, SHOWN * len(k))) for k in kinds])
        _steps(model, second, _rows_of_words(hashes, held), texts_ids, labels, rng.permutation(order), rng, rate)
        changed = np.flatnonzero(second[:-1] != second_before[:-1])
        rows = np.column_stack([model.embedding[changed] - before[changed], second[changed] - second_before[changed]]).astype(np.float64)
        dense = _dense(model) - dense_before
        values = np.rint(np.concatenate([rows, dense]) / UNIT).astype(np.int64)
        place = np.concatenate([changed, -1 - np.arange(len(dense))])
        return pa.table([pa.array(place), *(pa.array(values[:, k]) for k in range(CHANGE))], ["row", *(f"c{k}" for k in range(CHANGE))])

    return run


def train_groups(texts: DataFrame, count: int, size: int, seed: int = 7) -> Model:
    """A model of labelled texts (doc_id, text, toxic), of which there are ``count`` with ``size`` bytes; only models come to the driver."""
    context = texts.sparkSession.sparkContext
    counted = texts.where("toxic = 1").select("text").mapInArrow(_held_hashes, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    held = np.sort(counted.where(F.col("n") >= LEAST_TEXTS).select("hash").toArrow()["hash"].to_numpy()).astype(np.uint32)
    model = _untrained(len(held), np.random.default_rng(seed))
    second = np.full(len(held) + 1, 1e-8)
    share, last = F.pmod(F.xxhash64("doc_id", F.lit("share")), F.lit(ROUNDS[-1])), 0
    for number, until in enumerate(ROUNDS):
        groups = max(1, round((until - last) / ROUNDS[-1] * max(2 * count / AT_ONCE, 2 * size / AT_ONCE_BYTES)))
        part = texts.where((share >= last) & (share < until)).withColumn("group", F.pmod(F.xxhash64("doc_id", F.lit("group")), F.lit(groups)))
        shared = context.broadcast((model, second, held))
        changes = part.groupBy("group").applyInArrow(_group(shared, RATE * 0.1 ** (number / len(ROUNDS)), seed + number), CHANGES)
        sums = changes.groupBy("row").agg(F.count("*").alias("n"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(CHANGE)]).toArrow()
        last = until
        if not sums.num_rows:
            continue
        # a row is averaged over the groups that changed it, the rest over all
        mean = np.column_stack([sums[f"c{k}"].to_numpy() for k in range(CHANGE)]) * UNIT / sums["n"].to_numpy()[:, None]
        place = sums["row"].to_numpy()
        words, rest = place >= 0, place < 0
        model.embedding[place[words]] += mean[words, :SIZE].astype(np.float32)
        second[place[words]] += mean[words, SIZE]
        dense = _dense(model)
        dense[-1 - place[rest]] += mean[rest]
        _with_dense(model, dense)
        shared.unpersist()
    used = np.flatnonzero(model.embedding[:-1].any(axis=1))
    model.embedding = np.concatenate([model.embedding[used], np.zeros((1, SIZE), np.float32)])
    model.rows = {f: k for k, f in enumerate(held[used].tolist())}
    _calibrate_all(model, texts)
    return model


def _calibrate_all(model: Model, texts: DataFrame) -> None:
    """The same offsets as ``_calibrate``, from counts over all texts on a grid."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(shared.value)
        for batch in batches:
            words = [words_of(t) for t in batch.column(0).to_pylist()]
            cells = np.floor(logits(shared.value, encode, words) / GRID).astype(np.int64)
            yield pa.record_batch([pa.array([language(w) for w in words], pa.string()), pa.array(cells), batch.column(1)], ["name", "cell", "toxic"])

    cells = texts.select("text", "toxic").mapInArrow(run, "name string, cell long, toxic int")
    counts = cells.groupBy("name", "cell").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("other")).collect()
    for name in ["*", *COMMON, ""]:
        found: dict[int, list[int]] = {}
        for r in counts:
            if name in ("*", r["name"]):
                cell = found.setdefault(r["cell"], [0, 0])
                cell[0] += r["toxic"]
                cell[1] += r["other"]
        toxic, other = (np.array([found[c][k] for c in sorted(found)], np.int64) for k in (0, 1))
        if toxic.sum() + other.sum() < 20 or not toxic.sum() or not other.sum():
            continue
        z = (np.array(sorted(found)) + 0.5) * GRID
        errors = np.append(0, np.cumsum(toxic)) + other.sum() - np.append(0, np.cumsum(other))
        model.shift[name] = _widest(errors, z)


def _widest(errors: np.ndarray, z: np.ndarray) -> float:
    """The offset for the widest of the cuts between ``z`` with the least errors."""
    good = np.flatnonzero(errors == errors.min())
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    at = good[(edges[good + 1] - edges[good]).argmax()]
    return -float((edges[at] + edges[at + 1]) / 2)


def _calibrate(model: Model, texts: list[str], labels: np.ndarray) -> None:
    """For each language with texts of both kinds, and for all ("*"), the offset that errs least on the texts."""
    encode, z, names = Encoder(model), [], []
    for s in range(0, len(texts), 200):
        words = [words_of(t) for t in texts[s : s + 200]]
        z.append(logits(model, encode, words))
        names += [language(w) for w in words]
    z, names = np.concatenate(z), np.array(names)
    for name in ["*", *COMMON, ""]:
        mine = np.flatnonzero(names == name) if name != "*" else np.arange(len(z))
        if len(mine) < 20 or labels[mine].min() == labels[mine].max():
            continue
        order = mine[np.argsort(z[mine])]
        y = labels[order]
        errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([[0], np.cumsum((1 - y)[::-1])])[::-1]
        model.shift[name] = _widest(errors, z[order])


def held_out(doc: Column) -> Column:
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, at_once: int = AT_ONCE, at_once_bytes: int = AT_ONCE_BYTES) -> Model:
    """A model of all labelled documents outside the held-out fifth; of several texts under one id that of least hash."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")).join(known, "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct("mark", "text")).alias("text")).select("doc_id", "toxic", text.alias("text"))
    rows = stored(rows, "labelled")
    sizes = {r["toxic"]: (r["n"], r["size"]) for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    if len(sizes) < 2:
        return Model()
    count, size = (sum(s[k] for s in sizes.values()) for k in range(2))
    if count > at_once or size > at_once_bytes:
        return train_groups(rows, count, size)
    found = sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows.collect())
    return train([t for _, t, _ in found], [y for _, _, y in found])


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row (the columns to keep, all if none are named) and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    inside = text_col in keep
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    rows = docs.select(row) if inside else docs.select(row, F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(0).field(keep.index(text_col)) if inside else batch.column(1)
            values = scores(shared.value, encode, texts.to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(values, pa.float64())], ["row", "score"])

    return rows.mapInArrow(run, rows.select("row").schema.add("score", "double"))
