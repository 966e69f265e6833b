"""Spelling variants of words by anagram hashing.

A word's key is the sum of a power of each of its letters, so anagrams share it and the keys of two words that differ by
one letter differ by that letter's value, or by the difference of two. Words with an added or removed letter meet where
the longer one's key less a letter is the shorter one's key; words with an exchanged letter where both keys less a letter
are equal. Beside the key stands a hash of one half of the word, which one edit can't reach: either the half before it or
the half behind it is the same in both words. So only words that share a half meet, not all anagrams, and a word has
about as many rows as it has letters. What meets is verified in full.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_view, materialize, parts, texts
from .packing import slices

#: Code points and occurrences of a word at least, and how many times more frequent its form is.
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
#: A letter's value is this power of its code point.
POWER = 5
#: One run in so many, by its hash, loses a letter.
SPOILT = 31
#: Words that a worker counts before it passes them on; letters whose keys it makes at once; letters of a long word.
WORDS, LETTERS_AT_ONCE, LONG = 400_000, 1_000_000, 64
#: By Latin-1 code: letters (A-Z in lower case) as they are, the rest parts runs.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))


def utf8(run: bytes) -> bytes:
    """A run of Latin-1 letters in UTF-8."""
    return run if run.isascii() else run.decode("latin-1").encode()


def runs(text: bytes) -> Iterator[bytes]:
    """The runs of letters of a UTF-8 text in order, in Latin-1, A-Z in lower case."""
    for part in slices(text):
        yield from part.decode("utf-8", "replace").encode("latin-1", "replace").translate(LETTERS).split()


def spoil(run: bytes, begin: int) -> bytes:
    """The run without one letter if its hash says so. begin: crc32 of what is hashed before it."""
    h = zlib.crc32(utf8(run), begin)
    at = h % len(run)
    return run if h % SPOILT else run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, least: int = LEAST_LETTERS) -> DataFrame:
    """word, n: occurrences in all texts; words of fewer letters are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array(map(utf8, found), pa.binary()).cast(pa.string())
            batch = pa.RecordBatch.from_arrays([words, pa.array(found.values(), pa.int64())], names=["word", "n"])
            found.clear()
            return batch

        for b in parts(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b), strict=True):
                begin = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for r, n in Counter(r for r in runs(text) if len(r) >= least).items():
                    if len(word := spoil(r, begin)) >= least:
                        found[word] += n
            if len(found) > WORDS:
                yield out()
        yield out()

    return doc_view(docs).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of each row, which tells its length and order."""
    h = np.full(len(codes), 0x9E3779B97F4A7C15 + codes.shape[1], np.uint64)
    for column in codes.T.astype(np.uint64):
        h = (h ^ column) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _once(codes: np.ndarray, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words and of letters between start and end, each letter of a word once. By columns, or word by word
    where words are long."""
    if codes.shape[1] <= LONG:
        for k in range(start, end):
            new = np.flatnonzero((codes[:, start:k] != codes[:, k : k + 1]).all(axis=1))
            yield new, np.full(len(new), k)
    else:
        for row, word in enumerate(codes[:, start:end]):
            first = np.unique(word, return_index=True)[1]
            yield np.full(len(first), row), first + start


def _keys(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(place of the word, key, half, kind) for words of one length, given by their letters. kind: 0 or 1: less one
    letter, 2 or 3: the whole word; even: the half in front is the same, odd: the one behind."""
    size = codes.shape[1]
    value = codes.astype(np.int64) ** POWER
    key, every = value.sum(axis=1), np.arange(len(codes))
    for left in (size - 1, size):  # letters that two words that meet have in common
        half = left // 2
        for behind in (0, 1):
            start = size - (left - half)
            tag = _hashes(codes[:, start:] if behind else codes[:, :half])
            if left == size:
                yield every, key, tag, 2 + behind
            else:
                for rows, at in _once(codes, *((0, start) if behind else (half, size))):
                    yield rows, key[rows] - value[rows, at], tag[rows], behind


def anagram_keys(words: DataFrame) -> DataFrame:
    """key, half, kind, word, n: the rows by which words (word, n) meet; see the module."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 10_000):
            by_size: dict[int, list[int]] = {}
            letters = [w.encode("latin-1") for w in b.column(0).to_pylist()]
            for k, w in enumerate(letters):
                by_size.setdefault(len(w), []).append(k)
            for size, own in by_size.items():
                step = max(1, LETTERS_AT_ONCE // size)
                for at in range(0, len(own), step):
                    place = np.array(own[at : at + step])
                    codes = np.frombuffer(b"".join(letters[k] for k in place), np.uint8).reshape(-1, size)
                    for rows, key, half, kind in _keys(codes):
                        columns = [pa.array(key), pa.array(half), pa.array(np.full(len(rows), kind, np.int8)), *b.take(pa.array(place[rows])).columns]
                        yield pa.RecordBatch.from_arrays(columns, names=["key", "half", "kind", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key bigint, half bigint, kind tinyint, word string, n bigint")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: each pair of words (word, n) that differ by exactly one letter put in, left out or
    exchanged, both ways round."""
    keys = anagram_keys(words)
    other = keys.select("key", "half", F.col("kind").alias("kind2"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = keys.join(other, ["key", "half"]).where("word < near AND kind % 2 = kind2 % 2 AND (kind < 2 OR kind2 < 2)")
    # The letters that two words differ by are the only ones that make their keys equal, so they meet once for each half
    # that they share; where they share both, the one in front counts.
    front = "(greatest(length(word), length(near)) - 1) div 2"
    met = met.where(f"(kind % 2 = 0 OR left(word, int({front})) <> left(near, int({front}))) AND levenshtein(word, near, 1) = 1")
    ways = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return met.select(ways.alias("w")).select("w.*")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of words (word, root) lead in the end. Each round doubles the way gone; a form is so
    much more frequent than its word that ways are short and never lead back."""
    ways = materialize(forms)
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        gone = materialize(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        ways = gone.drop("moved")
        if gone.where("moved").isEmpty():
            return ways


def group_variants(docs: DataFrame, least: int = LEAST_LETTERS, count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word: n occurrences, the number of words near it, the most frequent of
    these (of equal ones the first by code points) if it is so many times as frequent, and where forms lead in the end.

    Words are runs of letters, A-Z in lower case, some of them spoilt (see spoil()), of so many letters and occurrences
    at least. A null or empty text has none, and a null doc_id is hashed as an empty one; each of several rows of the
    same id counts; an empty table gives no words; further columns are left out.
    """
    words = materialize(count_words(docs, least).where(F.col("n") >= count))
    best = near_pairs(words).select("word", "n", F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")).alias("near"))
    none = words.select("word", "n", F.lit(None).cast(best.schema["near"].dataType).alias("near"))
    found = best.unionAll(none).groupBy("word", "n").agg(F.count("near").alias("n_near"), F.min("near").alias("first"))
    good = -F.col("first.less") >= times * F.col("n")
    found = materialize(found.select("word", F.when(good, F.col("first.form")).alias("form"), "n", "n_near", F.when(good, -F.col("first.less")).alias("form_n")))
    roots = _roots(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
