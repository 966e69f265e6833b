"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Texts are cut into pre-tokens; the distinct new ones of a batch lie end to end in one ragged array of symbols. In
each step every sequence finds the lowest-ranked pair that it holds and merges all occurrences of it at once, until
no sequence holds a pair of the vocabulary; what is left of a sequence is its tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import doc_view, parts, texts

#: How the byte-level vocabularies cut text before merging: a fixed value of their format.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose counts a worker remembers; it forgets them all beyond.
REMEMBERED = 1_000_000
COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it is printable Latin-1, else the next
    free code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class Merges:
    """A vocabulary file's merges as sorted arrays, and its special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        self.first = np.array([vocab[x] for x in byte_letters()], np.int64)
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = [t["content"] for t in file["added_tokens"]]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the number of merges where there is none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], len(self.key))

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each of the (non-empty) pre-tokens."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        result = sizes.copy()
        symbols = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), sizes)
        none = len(self.key)
        while len(symbols):
            # Pair i is symbols i and i+1; there is none across the end of a sequence.
            rank = np.full(len(symbols), none, np.int64)
            same = owner[:-1] == owner[1:]
            rank[:-1][same] = self.ranks(symbols[:-1][same], symbols[1:][same])
            starts = np.flatnonzero(np.r_[True, ~same])
            sizes = np.diff(np.r_[starts, len(symbols)])
            least = np.minimum.reduceat(rank, starts)
            result[owner[starts]] = sizes
            live = least < none
            if not live.any():
                break
            if not live.all():
                stay = np.repeat(live, sizes)
                symbols, owner, rank, sizes, least = symbols[stay], owner[stay], rank[stay], sizes[live], least[live]
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            # In a run of overlapping hits (as in aaa) every other one, from the left, merges.
            fresh = np.r_[True, np.diff(hit) != 1]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return result


class Counter:
    """Counts the tokens of texts; remembers the pre-tokens it has merged."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.pre = regex.compile(PRE_TOKEN)
        self.special = regex.compile("|".join(map(regex.escape, self.merges.special)) or r"(?!)")
        self.known: dict[str, int] = {}

    def __call__(self, batch: list[str]) -> list[int]:
        """A special token's string inside a text counts as one token and parts what stands around it."""
        pieces, extra = [], []
        for t in batch:
            if any(s in t for s in self.merges.special):
                parts = self.special.split(t)
                extra.append(len(parts) - 1)
                pieces.append(list(chain.from_iterable(map(self.pre.findall, parts))))
            else:
                extra.append(0)
                pieces.append(self.pre.findall(t))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [p for p in set(chain.from_iterable(pieces)) if p not in self.known]
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            self.known.update(zip(part, self.merges.counts([p.encode() for p in part]).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, p)) + n for p, n in zip(pieces, extra, strict=True)]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for each row of docs.

    vocabulary: path of a byte-level BPE file in the JSON format, the same on every executor. A null or empty text
    has no bytes and no tokens; a null doc_id stays null; repeated rows give repeated rows; an empty table gives
    none. Further columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for b in parts(batches):
            raw = texts(b)
            n = counter([t.decode("utf-8", "replace") for t in raw])
            over = pa.array([x > limit for x in n], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, raw), pa.int64()), pa.array(n, pa.int64()), over],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return doc_view(docs).mapInArrow(run, COUNTS)
