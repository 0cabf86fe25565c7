"""Ids of texts by a vocabulary whose tokens never span white space: distinct chunks are encoded once for all their places.

The vocabulary drops white space, and neither its normal form nor its pattern reaches across it, so the ids of a text are those of its
chunks between ASCII white space, one after another.  Chunks of plain letters, digits and marks are lower-cased and split by Arrow kernels and
merged by rank, all of a batch in one call; the tokenizers file takes the few others.  Both give the same ids: a token's id is the rank of
the merge that makes it, and the end of a word is a byte of its own that merges before all else.
Names of special tokens are ordinary text.
"""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks in the text handed to the ranks: the end of a word, and of a chunk.
WORD_END, CHUNK_END = "\x01", "\x02"
CHUNK_ID = (1 << 16) - 1
#: White space outside ASCII among the plain characters.
BLANK = r"\x{85}\x{a0}"
#: A chunk is plain if lower-casing maps its characters one to one, no normal form changes them and no mark is among them.
NOT_PLAIN = r"[^\x{00}\x{03}-\x{12F}\x{131}-\x{2FF}]"
WORD = rf"[{BLANK}]*('s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^\s{BLANK}\p{{L}}\p{{N}}]+)[{BLANK}]*"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def joined(strings: pa.Array, mark: str) -> str:
    """The strings, each followed by the mark."""
    if not len(strings):
        return ""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings), mark)[0].as_py() + mark


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on every core already
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        if self.model.get_vocab_size() >= CHUNK_ID:
            raise ValueError("ids must fit 16 bits")
        with open(path, encoding="utf-8") as file:
            inner = json.load(file)["model"]
        suffix, byte = inner["end_of_word_suffix"], byte_of_symbol()
        ranks = {}
        for token, rank in inner["vocab"].items():
            word = token.removesuffix(suffix)
            if all(c in byte for c in word):
                raw = bytes(byte[c] for c in word)
                if len(raw) == 1 or not {1, 2} & set(raw):
                    ranks[raw + (WORD_END.encode() if word != token else b"")] = rank
        ranks[CHUNK_END.encode()] = CHUNK_ID
        pattern = f"[^{WORD_END}{CHUNK_END}]+{WORD_END}|{CHUNK_END}"
        self.ranks = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def chunks(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct chunks, where those of each begin, and how many it has."""
        plain = pc.invert(pc.match_substring_regex(distinct, NOT_PLAIN))
        lower = pc.utf8_lower(distinct)
        letters = pc.and_(plain, pc.utf8_is_alpha(lower))  # one word; the pattern is for the rest
        mixed = pc.and_not(plain, letters)
        marked = pc.replace_substring_regex(pc.filter(lower, mixed), WORD, rf"\1{WORD_END}")
        text = joined(pc.filter(lower, letters), WORD_END + CHUNK_END) + joined(marked, CHUNK_END)
        ids = self.ranks.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)
        ends = np.flatnonzero(ids == CHUNK_ID)
        others = self.model.encode_batch(pc.filter(distinct, pc.invert(plain)).to_pylist(), add_special_tokens=False)
        order = np.concatenate([np.flatnonzero(mask.to_numpy(zero_copy_only=False)) for mask in (letters, mixed, pc.invert(plain))])
        first, sizes = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        sizes[order] = np.concatenate([np.diff(ends, prepend=-1) - 1, np.array([len(e.ids) for e in others], np.int64)])
        first[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate([np.delete(ids, ends), np.fromiter((i for e in others for i in e.ids), np.uint16)]), first, sizes

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text begins (one more entry for the end).  Null is empty."""
        lists = pc.ascii_split_whitespace(texts)
        row = pc.list_parent_indices(lists).to_numpy()
        words = pc.list_flatten(lists).dictionary_encode()
        flat, first, sizes = self.chunks(words.dictionary)
        index = words.indices.to_numpy()
        first, length = first[index], sizes[index]
        ends = np.cumsum(length)
        at = np.repeat(first - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)
        starts = np.concatenate([[0], ends])[np.searchsorted(row, np.arange(len(texts) + 1))]
        return flat[at], starts


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
