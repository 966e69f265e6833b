"""Repeated passages by hashing normalised units.

Units are lines: the words of a line, A-Z in lower case and parted by one space each, if these are LEAST_CHARS code
points or more. On request there are also segments of the whole text across line breaks, for passages that are set into
other lines: a text is cut between two words where a fixed rule over both says so, hence a passage is cut at the same
words wherever it stands, and every cut starts a segment that runs to the first cut at least LEAST_WORDS on. Segments
overlap and leave no words out. Digests of all units are grouped; the earliest document keeps a unit, in its first
place, and all others lose it. What is removed is reported by its offsets in the original text.

Units that occur in one document alone, and documents that lose nothing, stay out of the shuffles that follow the
grouping.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, Sieve, doc_view, materialize, parts, texts

#: Code points from which a normalised line is a unit.
LEAST_CHARS = 10
#: Words from which a segment is a unit.
LEAST_WORDS = 20
#: A unit in more than so many documents, and in more than one in MOST_HOT of all repeated places, is hot: at most
#: MOST_HOT units are, and their owners are broadcast instead of shuffling their places by key.
HOT, MOST_HOT = 1_000, 10_000
#: One in so many pairs of words is cut.
CUT = 6
_KEY = ["h1", "h2"]
_CONTINUES = bytes(range(0x80, 0xC0))
#: The bytes that bytes.split() takes for space.
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\v\f", np.uint8))
#: Two odd factors, and their inverses modulo 2 to the 64.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_INVERSES = np.array([pow(int(f), -1, 1 << 64) for f in _FACTORS], np.uint64)


def cut_class(word: bytes) -> int:
    """Two neighbouring words whose classes add up to a multiple of CUT are cut."""
    return int(hashlib.md5(word).hexdigest()[:8], 16) % CUT


class Numbers(dict):
    """Numbers of words as met, with their hashes, classes and sizes in code points."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes, self.classes, self.sizes = np.empty(1024, np.uint64), np.empty(1024, np.int64), np.empty(1024, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        if n == len(self.hashes):
            self.hashes, self.classes, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.hashes, self.classes, self.sizes))
        self.hashes[n], self.classes[n] = xxhash.xxh3_64_intdigest(word), cut_class(word)
        self.sizes[n] = len(word.translate(None, _CONTINUES))
        return n


class Cutter:
    """Finds the units of texts, segments too if asked for; remembers words."""

    def __init__(self, segments: bool = False) -> None:
        self.words, self.within = Numbers(), segments
        self.powers = np.ones((4, 1), np.uint64)

    def _powers(self, n: int) -> np.ndarray:
        """Powers of the factors and of their inverses, up to n."""
        if self.powers.shape[1] <= n:
            self.powers = np.empty((4, n + n // 4 + 1), np.uint64)
            self.powers[:, 1:], self.powers[:, 0] = np.concatenate([_FACTORS, _INVERSES])[:, None], 1
            np.cumprod(self.powers, axis=1, out=self.powers)
        return self.powers

    def units(self, batch: list[bytes]) -> Units:
        words = [t.lower().split() for t in batch]
        if len(self.words) > 200_000:
            self.words.clear()
        counts = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.fromiter(map(self.words.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        doc, past = np.repeat(np.arange(len(words)), counts), np.cumsum(counts)
        raw = np.frombuffer(b"\n".join([*batch, b""]), np.uint8)
        origin = np.cumsum([0, *(len(t) + 1 for t in batch[:-1])])
        edge = np.flatnonzero(np.diff(_SPACE[raw], prepend=True, append=True))
        first, last = edge[::2], edge[1::2]
        ends = np.flatnonzero(raw == ord("\n"))
        begin = np.append(0, ends[:-1] + 1)
        a, b = np.searchsorted(first, begin), np.searchsorted(first, ends)
        size = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.words.sizes[ids] + 1)])
        long = size[b] - size[a] > LEAST_CHARS
        c, d = self.segments(self.words.classes[ids], doc, past) if self.within else (np.empty(0, np.int64),) * 2
        line = np.arange(long.sum() + len(c)) < long.sum()
        starts, stops = np.concatenate([begin[long], first[c]]), np.concatenate([ends[long], last[d - 1]])
        a, b = np.concatenate([a[long], c]), np.concatenate([b[long], d])
        hashes, powers, out = self.words.hashes[ids], self._powers(len(ids)), []
        for k, mixed in enumerate((hashes, (hashes ^ (hashes >> np.uint64(31))) * _FACTORS[0])):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers[k, : len(ids)], dtype=np.uint64)])
            h = ((sums[b] - sums[a]) * powers[k + 2, a] + (b - a).astype(np.uint64)) * _FACTORS[1 - k]
            out.append((h ^ (h >> np.uint64(29))) + line)
        own = doc[a]
        return Units(own, *out, starts - origin[own], stops - origin[own], line)

    @staticmethod
    def segments(classes: np.ndarray, doc: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and ends of the segments of texts end to end: doc is the number of each word's text, past where
        the texts end. The ends of a text are cuts too, and a last segment ends there."""
        inner = np.flatnonzero(((classes[:-1] + classes[1:]) % CUT == 0) & (doc[:-1] == doc[1:])) + 1
        cuts = np.unique(np.concatenate([[0], inner, past]))
        a = cuts[:-1][cuts[:-1] + LEAST_WORDS <= past[doc[cuts[:-1]]]]
        b = cuts[np.searchsorted(cuts, a + LEAST_WORDS)]
        # a has all cuts of a text up to the last that is LEAST_WORDS from its end, but that one's segment may end before.
        of = doc[a]
        last = np.flatnonzero(np.append(of[1:] != of[:-1], np.ones(min(1, len(of)), bool)))
        last = last[b[last] < past[of[last]]]
        return np.concatenate([a, a[last]]), np.concatenate([b, past[of[last]]])


@dataclass
class Units:
    """Of each unit of some texts: the number of its text; two hashes of its words, A-Z in lower case, and of whether it
    is a line; start and end in bytes; whether it is a line. Equal units of a text are in order of start."""

    doc: np.ndarray
    h1: np.ndarray
    h2: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    line: np.ndarray

    @staticmethod
    def keys(doc: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """One hash of a unit and its text."""
        return (h1 ^ h2 * _FACTORS[0]) + doc.astype(np.uint64) * _FACTORS[1]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The first of equal units of a text, and which of all begin at or behind its end."""
        _, first, of = np.unique(self.keys(self.doc, self.h1, self.h2), return_index=True, return_inverse=True)
        again = self.start >= self.stop[first[of]]
        return first, again


def unit_hashes(docs: DataFrame, segments: bool = False, sieve: Sieve | None = None) -> DataFrame:
    """h1, h2, id, again: the distinct unit hashes of each row; id is doc_id, or NULL_ID where it is null; again: the
    unit is repeated in the row. With a sieve of h1, only those that pass it."""
    shared = sieve and (sieve.shared, sieve.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(segments)
        for b in parts(batches):
            found = cutter.units(texts(b))
            first, again = found.distinct()
            repeats = np.isin(found.keys(found.doc, found.h1, found.h2)[first], found.keys(found.doc, found.h1, found.h2)[again])
            ids = np.array([NULL_ID if x is None else x for x in b.column(0).to_pylist()], np.int64)
            if shared:
                own = Sieve.holds(shared[0].value, (found.h1[first] & np.uint64(shared[1] - 1)).view(np.int64))
                first, repeats = first[own], repeats[own]
            columns = [found.h1[first].view(np.int64), found.h2[first].view(np.int64), ids[found.doc[first]], repeats]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["h1", "h2", "id", "again"])

    return doc_view(docs).mapInArrow(run, "h1 bigint, h2 bigint, id bigint, again boolean")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _removed(batch: list[bytes], cutter: Cutter, drops: pa.ListArray) -> list[list[tuple[int, int]]]:
    """The spans in bytes that each text loses: its units in drops (h1, h2), and those it repeats. A line goes with its
    end. What overlaps the first place of the same unit is no repetition."""
    found = cutter.units(batch)
    _, gone = found.distinct()
    sizes = np.diff(drops.offsets.to_numpy()) if len(drops) else np.empty(0, np.int64)
    lost = [drops.flatten().field(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(2)]
    gone |= np.isin(found.keys(found.doc, found.h1, found.h2), found.keys(np.repeat(np.arange(len(batch)), sizes), *lost))
    spans: list[list[tuple[int, int]]] = [[] for _ in batch]
    stops = found.stop + found.line
    for k, a, b in zip(found.doc[gone].tolist(), found.start[gone].tolist(), stops[gone].tolist(), strict=True):
        spans[k].append((a, min(b, len(batch[k]))))
    return list(map(_merged, spans))


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def _points(text: bytes, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Ascending spans in bytes as spans in code points."""
    out, at, n = [], 0, 0
    for a, b in spans:
        n += len(text[at:a].translate(None, _CONTINUES))
        out.append({"start": n, "end": (n := n + len(text[a:b].translate(None, _CONTINUES)))})
        at = b
    return out


def dedup_passages(docs: DataFrame, segments: bool = False) -> DataFrame:
    """The rows of docs with all columns, text without repeated units, and n_removed (spans) and removed, an array of
    (start, end) offsets in code points of the original text; these replace columns of docs so named.

    segments: whether segments are units besides lines. The smallest doc_id that has a unit keeps it, in its first place, but for words that are also in a unit, overlapping
    it, that goes: each word removed is kept in an earlier place of its unit, or goes there in favour of one earlier
    yet. Null doc_ids are one document, larger than all others, and rows with the same doc_id are one document. A null
    or empty text has no units and stays as it is. An empty table gives none. The units are found anew for each use:
    they would take more disk than time.
    """
    docs = docs.drop("n_removed", "removed")
    units = unit_hashes(docs, segments)
    owners = units.groupBy(_KEY).agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.max("again").alias("again"), F.count("*").alias("places"))
    shared = materialize(owners.where("owner != last OR again").select(*_KEY, "owner", "places"))
    many = max(HOT, (shared.agg(F.sum("places")).first()[0] or 0) // MOST_HOT)
    hot, rest = (shared.where(F.col("places") > many), shared.where(F.col("places") <= many))
    places = materialize(unit_hashes(docs, segments, Sieve(shared, "h1", hashed=True)))
    cold = places.join(F.broadcast(hot.select(_KEY)), _KEY, "left_anti").join(rest, _KEY)
    met = places.join(F.broadcast(hot), _KEY).unionByName(cold).where("id != owner OR again")
    drop = F.collect_set(F.when(F.col("id") != F.col("owner"), F.struct("h1", "h2")))
    lost = materialize(met.groupBy("id").agg(drop.alias("drops")))
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema, T.StructField("n_removed", T.LongType()), T.StructField("removed", spans)])
    at = docs.columns.index("text")
    key, sieve = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)), Sieve(lost)
    whole = sieve.part(docs, key, False).select(*docs.columns, F.lit(0).cast("bigint").alias("n_removed"), F.array().cast(spans).alias("removed"))
    some = sieve.part(docs, key)
    both = some.join(lost, key == lost["id"], "left").select(*(some[c] for c in docs.columns), F.coalesce(lost["drops"], F.array().cast(lost.schema["drops"].dataType)).alias("__drops"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(segments)
        for b in parts(batches):
            raw = b.column(at).cast(pa.binary()).to_pylist()
            plain = [t or b"" for t in raw]
            spans = _removed(plain, cutter, b.column(b.num_columns - 1))
            kept = [_without(t, x) if x else t for t, x in zip(raw, spans, strict=True)]
            removed = list(map(_points, plain, spans))
            columns = [b.column(k) for k in range(b.num_columns - 1)]
            columns[at] = pa.array(kept, pa.binary()).cast(pa.string())
            columns += [pa.array(map(len, removed), pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return whole.unionAll(both.mapInArrow(run, schema))
