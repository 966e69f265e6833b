"""Benchmark decontamination by spaced seeds.

A seed is a mask over consecutive tokens: positions marked 1 are hashed, positions marked 0 may differ. The hashes of
all windows of the benchmark items are a table. A document's windows are looked up in a Bloom filter of it, of a bounded
size, where the document is read; what passes is joined with the table, and each pair of document and item that a seed
aligns is verified token by token. Neither documents nor the benchmark pass through the driver, and only documents with
a window that passes are shuffled.

A document overlaps an item if WINDOW tokens of the item in a row, or all of a shorter item, lie on tokens of the
document in a row of which four fifths are equal: 13 of 16. The masks are such that every placement of the tokens that
differ leaves a seed untouched, so no overlap is missed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, Sieve, doc_view, materialize, parts, texts

#: Tokens of an item that are compared at once; of a shorter item, all.
WINDOW = 16
#: Items of fewer tokens aren't checked.
LEAST_ITEM = 8
#: Masks for items of WINDOW tokens or more, and for shorter ones.
SEEDS = ("1110010111", "11110111", "1110000010111", "1111111", "11101111")
SHORT_SEEDS = ("110111", "11010011", "11111")
#: Bits of the Bloom filter, at most; and for each seed, which has so many places.
BLOOM_BITS, BITS_EACH, PLACES = 1 << 28, 128, 4
#: Written forms of words whose hashes a task remembers.
WORDS_KEPT = 100_000
#: Contaminated rows that are sent to all tasks; beyond, rows that may be among them are shuffled.
BROADCAST_ROWS = 1_000_000
#: More than any mask spans, between two documents.
GAP = 13
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

FOUND = "doc_id bigint, item_id bigint, equal int, doc_token int, item_token int, length int"


def normal(word: str) -> str:
    """A word's compatibility form, case-folded, without what isn't a letter, number or mark at its ends; words of signs
    alone become empty and are dropped."""
    word = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", word).casefold())
    inner = [k for k, c in enumerate(word) if unicodedata.category(c)[0] in "LNM"]
    return word[inner[0] : inner[-1] + 1] if inner else ""


def split(text: bytes) -> list[str]:
    """The words as written, parted by any space that Unicode knows."""
    return text.decode("utf-8", "replace").split()


class Hashes(dict):
    """64-bit hashes of words by their normal form, other than 0, which is that of words of signs alone. Written forms
    are remembered as met."""

    def __missing__(self, word: str) -> int:
        plain = normal(word)
        n = xxhash.xxh3_64_intdigest(plain.encode()) | 1 if plain else 0
        if len(self) > WORDS_KEPT:
            self.clear()
        self[word] = n
        return n


def tokens(texts: list[bytes], words: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the texts' tokens end to end, and the number of its text for each."""
    raw = [split(t) for t in texts]
    counts = np.fromiter(map(len, raw), np.int64, len(raw))
    found = np.fromiter(map(words.__getitem__, chain.from_iterable(raw)), np.uint64, int(counts.sum()))
    return found[found > 0], np.repeat(np.arange(len(raw)), counts)[found > 0]


def share(length: int) -> int:
    """Four fifths of so many tokens, rounded up."""
    return -(-4 * length // 5)


def spaced(ids: np.ndarray, mask: str) -> np.ndarray:
    """Hashes of the windows under the mask."""
    n = max(0, len(ids) - len(mask) + 1)
    h = np.full(n, int(mask, 2), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            h = (h ^ ids[k : k + n]) * _FACTOR
            h ^= h >> np.uint64(29)
    return h


def _places(h: Column, bits: int) -> list[Column]:
    low, step = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return [F.pmod(low + k * step, F.lit(bits)) for k in range(PLACES)]


def bloom(seeds: DataFrame) -> Broadcast:
    """A Bloom filter of the seeds' hashes. seeds: a written table."""
    bits = 1 << min(BLOOM_BITS.bit_length() - 1, max(10, (BITS_EACH * seeds.count()).bit_length()))
    places = seeds.select(F.explode(F.array(*_places(F.col("h"), bits))).alias("at"))
    words = places.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, int(at % 64))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    filled = np.zeros(bits >> 6, np.int64)
    filled[found["word"].to_numpy()] = found["bits"].to_numpy()
    return seeds.sparkSession.sparkContext.broadcast(filled)


def _passes(filled: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where the hashes that pass the filter are."""
    low, step = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    last, found = np.uint64(64 * len(filled) - 1), np.arange(len(h))
    for k in range(PLACES):
        at = (low[found] + np.uint64(k) * step[found] & last).astype(np.int64)
        found = found[filled[at >> 6] >> (at & 63) & 1 == 1]
    return found


def unchecked(benchmark: DataFrame) -> DataFrame:
    """item_id, n_tokens of each row of the benchmark that has too few tokens to be checked, null and empty texts
    among them; null item_ids stay null, repeated rows repeat, and an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Hashes()
        for b in parts(batches):
            owner = tokens(texts(b), words)[1]
            n = np.bincount(owner, minlength=b.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], names=["item_id", "n_tokens"])

    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id bigint, n_tokens bigint").where(F.col("n_tokens") < LEAST_ITEM)


def _items(benchmark: DataFrame) -> DataFrame:
    """item (a number for each row), item_id, n, tokens (hashes of 64 bits), without items of too few tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Hashes()
        for b in batches:
            raw = [tokens([t], words)[0] for t in texts(b)]
            stay = [k for k, x in enumerate(raw) if len(x) >= LEAST_ITEM]
            own = b.take(pa.array(stay, pa.int64()))
            more = [pa.array([len(raw[k]) for k in stay], pa.int32()), pa.array([raw[k].tobytes() for k in stay], pa.binary())]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *more], names=["item", "item_id", "n", "tokens"])

    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, "item bigint, item_id bigint, n int, tokens binary"))


def _seeds(items: DataFrame) -> DataFrame:
    """h, item, start: every window of the items under the masks for their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, n, x in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                ids = np.frombuffer(x, np.uint64)
                for mask in SEEDS if n >= WINDOW else SHORT_SEEDS:
                    h = spaced(ids, mask).view(np.int64)
                    columns = [pa.array(h), pa.array(np.full(len(h), item)), pa.array(np.arange(len(h), dtype=np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["h", "item", "start"])

    return materialize(items.select("item", "n", "tokens").mapInArrow(run, "h bigint, item bigint, start int"))


def _hits(docs: DataFrame, filled: Broadcast, masks: tuple[str, ...]) -> DataFrame:
    """docs: doc_id, text, and what is to be kept. For each row with a window that passes the filter: a number of its
    own (rid), doc_id, what was kept, its tokens, and the windows' hashes and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Hashes()
        for b in parts(batches):
            ids, owner = tokens(texts(b), words)
            first = np.searchsorted(owner, np.arange(b.num_rows + 1))
            spread = np.zeros(len(ids) + GAP * b.num_rows, np.uint64)
            spread[np.arange(len(ids)) + GAP * owner] = ids
            begin = first + GAP * np.arange(b.num_rows + 1)
            doc, at, hashes = [], [], []
            for m in masks:
                n = len(spread) - len(m) + 1
                if n < 1:
                    continue
                h = spaced(spread, m)
                hit = _passes(filled.value, h)
                hit = hit[(spread[hit] > 0) & (spread[hit + len(m) - 1] > 0)]
                of = np.searchsorted(begin, hit, "right") - 1
                doc.append(of)
                at.append(hit - begin[of])
                hashes.append(h[hit])
            doc, at, hashes = (np.concatenate(x or [np.empty(0, np.int64)]) for x in (doc, at, hashes))
            order = np.argsort(doc, kind="stable")
            own, sizes = np.unique(doc, return_counts=True)
            ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order].astype(t))) for x, t in ((hashes, np.int64), (at, np.int32))]
            kept = b.drop_columns(["text"]).take(pa.array(own, pa.int64()))
            raw = pa.array([ids[first[k] : first[k + 1]].tobytes() for k in own.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*kept.columns, raw, *lists], names=[*kept.schema.names, "tokens", "hashes", "places"])

    rows = docs.withColumn("rid", F.monotonically_increasing_id())
    schema = rows.drop("text").schema
    for name, kind in (("tokens", T.BinaryType()), ("hashes", T.ArrayType(T.LongType())), ("places", T.ArrayType(T.IntegerType()))):
        schema = schema.add(name, kind)
    return materialize(rows.mapInArrow(run, schema))


def best_run(same: np.ndarray) -> tuple[int, int, int] | None:
    """same: which of an item's tokens equal those that they lie on. Windows with enough equal tokens that overlap or
    touch are one run, without unequal tokens at its ends; of the run with most equal tokens, then the first: how many,
    the first token, and the length. None without such a window."""
    wide = min(WINDOW, len(same))
    total = np.concatenate([[0], np.cumsum(same)])
    ends = np.flatnonzero(total[wide:] - total[:-wide] >= share(wide)) + wide
    if not len(ends):
        return None
    new = np.flatnonzero(np.diff(ends) > wide) + 1
    begin, end = ends[np.concatenate([[0], new])] - wide, ends[np.concatenate([new - 1, [len(ends) - 1]])]
    best = int(np.argmax(total[end] - total[begin]))
    inside = np.flatnonzero(same[begin[best] : end[best]])
    return len(inside), int(begin[best] + inside[0]), int(inside[-1] - inside[0] + 1)


def _verified(met: DataFrame) -> DataFrame:
    """met: rid, item_id, shift, n, theirs (the item's tokens), ours (the document's from the item's first on, or from
    its own first). The best run of each row that overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rid, item, shift, n, theirs, ours in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                a, doc, same = max(0, -shift), np.frombuffer(ours, np.uint64), np.zeros(n, bool)
                same[a : a + len(doc)] = np.frombuffer(theirs, np.uint64)[a : a + len(doc)] == doc
                if found := best_run(same):
                    out.append((rid, item, found[0], shift + found[1], found[1], found[2]))
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    names = ["rid", "item_id", "equal", "doc_token", "item_token", "length"]
    return met.mapInArrow(run, "rid bigint, item_id bigint, equal int, doc_token int, item_token int, length int")


def _overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs: doc_id, text, and further columns, which are kept. One row for each row of docs and item that overlap."""
    items = _items(benchmark)
    long, short = items.agg(F.coalesce(F.max(F.col("n") >= WINDOW), F.lit(False)), F.coalesce(F.max(F.col("n") < WINDOW), F.lit(False))).first()
    seeds = _seeds(items)
    hits = _hits(docs, bloom(seeds), SEEDS * long + SHORT_SEEDS * short)
    windows = hits.select("rid", F.explode(F.arrays_zip("hashes", "places")).alias("w"))
    windows = windows.select("rid", F.col("w.hashes").alias("h"), F.col("w.places").alias("place"))
    pairs = windows.join(seeds, "h").select("rid", "item", (F.col("place") - F.col("start")).alias("shift")).distinct()
    # Of a document's tokens only those that the item lies on go on.
    skip, n = F.greatest("shift", F.lit(0)), F.col("n") + F.least("shift", F.lit(0))
    ours = F.substring("tokens", (8 * skip + 1).cast("int"), (8 * n).cast("int"))
    met = pairs.join(items.withColumnRenamed("tokens", "theirs"), "item").join(hits.select("rid", "tokens"), "rid")
    found = _verified(met.select("rid", "item_id", "shift", "n", "theirs", ours.alias("ours")))
    best = found.groupBy("rid", "item_id").agg(F.max_by(F.struct("equal", "doc_token", "item_token", "length"), F.struct("equal", -F.col("doc_token"), -F.col("item_token"))).alias("b"))
    return hits.drop("tokens", "hashes", "places").join(best, "rid").select(*docs.drop("text").columns, "item_id", "b.*")


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each pair of document and benchmark item that overlap: doc_id, item_id, equal tokens, where the
    run starts in the document's and the item's tokens, and its length.

    Null or empty texts, on either side, hold no tokens and overlap nothing; items of fewer than LEAST_ITEM tokens
    aren't checked (unchecked() lists them); null ids stay null; repeated documents give repeated rows, repeated items don't; with an empty table
    on either side there are no rows. Further columns are left out. When an item overlaps a document in several places,
    the run with most equal tokens, then the first, counts.
    """
    return _overlaps(doc_view(docs), benchmark)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_ids (in order), most_equal tokens of a run.

    Rows of docs with the same doc_id are one document, and those without one together another.
    """
    found = (
        find_overlaps(docs, benchmark)
        .groupBy(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"))
        .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("equal").alias("most_equal"))
    )
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    return ids.join(found, F.coalesce("doc_id", F.lit(NULL_ID)) == found["id"], "left").select(
        "doc_id",
        F.col("id").isNotNull().alias("contaminated"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("item_ids", F.expr("array()").cast("array<bigint>")).alias("item_ids"),
        F.coalesce("most_equal", F.lit(0)).cast("bigint").alias("most_equal"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, that overlap no benchmark item. A row is told by its doc_id and the
    hashes of its text."""
    id_, text = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = {"__id": id_, "__h1": F.xxhash64(text), "__h2": F.hash(text)}
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), *(c.alias(k) for k, c in key.items()))
    dirty = materialize(_overlaps(own, benchmark).select(*key).distinct())
    same = [c == dirty[k] for k, c in key.items()]
    if dirty.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(dirty), same, "left_anti")
    sieve = Sieve(dirty, "__h1")
    return sieve.part(docs, key["__h1"], False).unionAll(sieve.part(docs, key["__h1"]).join(dirty, same, "left_anti"))
