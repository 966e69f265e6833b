"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Trigrams of the trusted text are counted in shards by their middle word, as sorted arrays of numbered words: one shuffle,
after which the continuation counts of bigrams and all counts after a context lie within one shard.
Interpolation is written additively: an n-gram's entry in the table of weights is what seeing it adds to the log
probability, beyond what its own suffix and context give; contexts carry their back-off mass. A text's log
probability is then the plain sum, over its words, bigrams and trigrams, of their weights. So the table can be dealt
to parts by key, and each part joined by itself with the documents' n-grams.

The text to learn from is a sample whose size is bounded by Sample, hence so are the weights: tasks hold the parts as
sorted arrays and texts are not shuffled. All other trusted documents, unseen in training, give the quantile of
perplexity of each language beyond which documents are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ordinals import ranked
from .common import doc_view, materialize, parts, texts

#: Stand for the two words before a text and for its end; no hash of a word is used for them.
BEGIN, END = (1, 2), 3
#: Shards of the counts of trigrams.
SHARDS = 64
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)


@dataclass(frozen=True)
class Sample:
    """docs: trusted documents to learn from, at most; docs to calibrate: how fewer are dealt between learning and the
    quantiles; words: at most, of which the same share is learnt; shard: entries of the table of weights in one part."""

    docs: int = 8_000
    calibrate: int = 6_000
    words: int = 6_000_000
    shard: int = 2_000_000


@dataclass(frozen=True)
class Limit:
    """quantile of trusted perplexity, by language, and the factor above it from which a document is rejected.
    prior: tokens at its language's mean that are added to each text, so that a few rare words don't reject a short
    one. Languages without a trusted document to calibrate by take the quantile of all languages."""

    quantile: float = 0.995
    factor: float = 1.05
    prior: float = 20.0


class Words:
    """Hashes of words as met; remembers them."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, batch: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of texts end to end, each with its two begins and its end, and the numbers of their texts."""
        if len(self.known) > 500_000:
            self.known.clear()
        known = self.known
        flat = list(chain.from_iterable(batch))
        for w in set(flat):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w) | 4
        sizes = np.fromiter(map(len, batch), np.int64, len(batch))
        row = np.repeat(np.arange(len(batch)), sizes + 3)
        out = np.zeros(len(row), np.uint64)
        last = np.cumsum(sizes + 3) - 1
        first = last - sizes - 2
        own = np.ones(len(row), bool)
        own[first] = own[first + 1] = own[last] = False
        out[own] = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
        out[first], out[first + 1], out[last] = BEGIN[0], BEGIN[1], END
        return out, row


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _FACTOR ^ b) * _MIX
    return h ^ (h >> _SHIFT)


def vocabulary(docs: DataFrame) -> np.ndarray:
    """The tokens of the texts, the most frequent first. For texts of a bounded size: it comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in parts(batches):
            word, n = np.unique(words([t.split() for t in texts(b)])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    found = doc_view(docs).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    word = found["word"].to_numpy().view(np.uint64)
    return word[np.lexsort((word, -found["n"].to_numpy()))]


def pack(values: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, in little space if most are small."""
    return zstandard.compress(values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<i4").ravel().astype(np.int64)


def _shard(shard: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple:
    """A row of trigrams(): the trigrams in the order of (v, w, u), equal ones as one."""
    pair = v << 32 | w
    order = np.lexsort((u, pair))
    u, pair, n = u[order], pair[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (u[1:] != u[:-1])]))
    u, v, w, n = u[first], pair[first] >> 32, pair[first] & 0xFFFFFFFF, np.add.reduceat(n, first)
    return shard, pack(u), pack(np.diff(v, prepend=0)), pack(w), pack(n)


def _counted(row: dict) -> tuple[np.ndarray, ...]:
    """u, v, w, n of a row of trigrams()."""
    u, v, w, n = (unpack(row[c]) for c in "uvwn")
    return u, np.cumsum(v), w, n


_PACKED = "shard int, u binary, v binary, w binary, n binary"
_PACKED_ARROW = pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in "uvwn")])


def trigrams(docs: DataFrame, vocab: Broadcast, shards: int = SHARDS) -> DataFrame:
    """The counted trigrams (u, v, w) of the texts, in one row for each shard. Words stand by their places in vocab.
    The shard is that of the middle word, so all counts after (u, v) and after v are within one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = Words(), vocab.value
        order = np.argsort(known)
        for b in parts(batches, 2000):
            ids, row = words([t.split() for t in texts(b)])
            ids = order[np.searchsorted(known, ids, sorter=order)]
            at = np.flatnonzero(row[2:] == row[:-2])
            deal = ids[at + 1] % shards
            rows = []
            for k in np.unique(deal).tolist():
                own = at[deal == k]
                rows.append(_shard(k, ids[own], ids[own + 1], ids[own + 2], np.ones(len(own), np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PACKED_ARROW.types, strict=True)], schema=_PACKED_ARROW)

    def merge(table: pa.Table) -> pa.Table:
        columns = [np.concatenate(c) for c in zip(*map(_counted, table.to_pylist()), strict=True)]
        row = _shard(table["shard"][0].as_py(), *columns)
        return pa.table([[x] for x in row], schema=_PACKED_ARROW)

    return doc_view(docs).mapInArrow(run, _PACKED).groupBy("shard").applyInArrow(merge, _PACKED)


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted columns: where each run of equal rows begins, and the number of its run for each row."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _continued(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted trigrams: v and w of their bigrams, the numbers of words before these, the bigram of each trigram."""
    first, of = _groups(v, w)
    return v[first], w[first], np.bincount(of), of


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2, and 3 or more, from the numbers of n-grams seen 1 to 4 times;
    where one of these is missing, the plain absolute discount."""
    n = [0, *n]
    if not n[1] or not n[2]:
        return [0.5, 0.5, 0.5]
    y = n[1] / (n[1] + 2 * n[2])
    found = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else y * k for k in (1, 2, 3)]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), found, strict=True)]


def _less(n: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


#: Kinds of statistics(): words by the number of words before them; trigrams and bigrams by how often they were seen.
WORDS, TRIGRAMS, BIGRAMS = 1, 2, 3


def statistics(tri: DataFrame) -> DataFrame:
    """kind, at, n: for WORDS, the words before word ``at``; else the trigrams or bigrams seen ``at`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                _, v, w, n = _counted(row)
                _, w2, n2, _ = _continued(v, w)
                for kind, values in ((WORDS, w2), (TRIGRAMS, n), (BIGRAMS, n2)):
                    at, times = np.unique(values, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind)), pa.array(at), pa.array(times)], names=["kind", "at", "n"])

    return tri.mapInArrow(run, "kind bigint, at bigint, n bigint").groupBy("kind", "at").agg(F.sum("n").alias("n"))


def weights(tri: DataFrame, vocab: Broadcast, p1: Broadcast, d3: list[float], d2: list[float], bits: int) -> DataFrame:
    """part, keys, weights (arrays of 64 and 32 bits): the weights that each shard of trigrams adds to its n-grams and
    their contexts; a key may come from several shards. The part is the first bits of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, low, none = vocab.value, p1.value, np.zeros(1, np.uint64)
        for b in batches:
            for row in b.to_pylist():
                u, v, w, n = _counted(row)
                v2, w2, n2, of2 = _continued(v, w)
                first, of = _groups(v2)
                c, g = np.bincount(of, n2), np.bincount(of, _less(n2, d2))
                g2 = g / c
                p2 = (n2 - _less(n2, d2)) / c[of] + g2[of] * low[w2]
                context, of3 = np.unique(v << 32 | u, return_inverse=True)
                c, g = np.bincount(of3, n), np.bincount(of3, _less(n, d3))
                g3 = g / c
                p3 = (n - _less(n, d3)) / c[of3] + g3[of3] * p2[of2]
                keys = np.concatenate(
                    [
                        Model.keys(none, none, names[v2[first]]),
                        Model.keys(none, names[v2], names[w2]),
                        Model.keys(none, names[context & 0xFFFFFFFF], names[context >> 32]),
                        Model.keys(names[u], names[v], names[w]),
                    ]
                )
                weight = np.concatenate([g2, p2 / (g2[of] * low[w2]), g3, p3 / (g3[of3] * p2[of2])])
                weight = np.log10(weight).astype(np.float32)
                part = (keys >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)
                for k in np.unique(part).tolist():
                    own = part == k
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k]), pa.array([keys[own].tobytes()], pa.binary()), pa.array([weight[own].tobytes()], pa.binary())],
                        names=["part", "keys", "weights"],
                    )

    return tri.mapInArrow(run, "part bigint, keys binary, weights binary")


@dataclass
class Part:
    """The weights of the keys that begin with some bits: whole keys, sorted."""

    keys: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, weight: np.ndarray) -> Part:
        """Sums the weights of equal keys."""
        order = np.argsort(keys)
        keys, weight = keys[order], weight[order]
        first, of = _groups(keys)
        return Part(keys[first], np.bincount(of, weight).astype(np.float32))


@dataclass
class Model:
    """The weights in parts by the first bits of their keys, and the weight of an unknown word."""

    parts: list[Broadcast]
    bits: int
    unknown: float

    @staticmethod
    def keys(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """0 stands for no word."""
        return _pair(_pair(w, v), u)


class Scorer:
    """Sums of weights of texts."""

    BITS = 25

    def __init__(self, model: Model) -> None:
        self.bits, self.unknown, self.words = model.bits, model.unknown, Words()
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.parts = []
        for part in (p.value for p in model.parts):
            self.maybe[part.keys >> np.uint64(64 - self.BITS)] = True
            self.parts.append((part.keys, part.weight))

    def _add(self, keys: np.ndarray, row: np.ndarray, total: np.ndarray, otherwise: float = 0.0) -> None:
        found = np.flatnonzero(self.maybe[keys >> np.uint64(64 - self.BITS)])
        weight, deal = np.full(len(keys), otherwise), keys[found] >> np.uint64(63 - self.bits) >> np.uint64(1)
        for k, (known, value) in enumerate(self.parts):
            own = found[deal == k]
            if len(known) and len(own):
                asked = keys[own]
                at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                hit = known[at] == asked
                weight[own[hit]] = value[at[hit]]
        total += np.bincount(row, weight, len(total))

    def __call__(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of tokens, end included, of each text and its log10 probability."""
        raw = [t.split() for t in batch]
        ids, row = self.words(raw)
        total, none = np.zeros(len(raw)), np.zeros(1, np.uint64)
        # The begins are context alone: their weights hold nothing else, and unknown begins weigh nothing.
        begin = ids < END
        self._add(self.words_key(ids[~begin]), row[~begin], total, self.unknown)
        self._add(self.words_key(ids[begin]), row[begin], total)
        same = np.flatnonzero(row[1:] == row[:-1])
        self._add(Model.keys(none, ids[same], ids[same + 1]), row[same], total)
        same = np.flatnonzero(row[2:] == row[:-2])
        self._add(Model.keys(ids[same], ids[same + 1], ids[same + 2]), row[same], total)
        return np.fromiter(map(len, raw), np.int64, len(raw)) + 1, total

    @staticmethod
    def words_key(ids: np.ndarray) -> np.ndarray:
        none = np.zeros(1, np.uint64)
        return Model.keys(none, none, ids)


def trusted(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> tuple[DataFrame, DataFrame]:
    """doc_id of all trusted documents (labelled of good quality and not toxic, by all their labels); and doc_id of
    those to learn from, the first in the order of a hash of their ids: sample.docs at most and the same share of fewer,
    of sample.words words in all by the length of their texts. One that doesn't fit is left out, not those after it."""
    good = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .where("doc_id IS NOT NULL AND quality = 1 AND coalesce(toxic, 0) = 0")
        .select("doc_id")
    )
    good = materialize(good)
    share = sample.docs / (sample.docs + sample.calibrate)
    learn = F.pmod(F.xxhash64(F.lit("learn"), "doc_id"), F.lit(1000)) < F.lit(round(share * 1000))
    picked = materialize(good.where(learn).select("doc_id", F.xxhash64("doc_id").alias("rank")).orderBy("rank", "doc_id").limit(sample.docs))
    size = doc_view(docs).select("doc_id", F.length("text").alias("size")).join(F.broadcast(picked), "doc_id")
    size = size.groupBy("doc_id", "rank").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    learnt, left = [], 5 * sample.words * share
    for r in size.orderBy("rank", "doc_id").collect():
        if r["size"] <= left:
            learnt.append((r["doc_id"],))
            left -= r["size"]
    return good, docs.sparkSession.createDataFrame(learnt, "doc_id bigint")


def _only(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is chosen; chosen has as many rows as a sample has documents, at most."""
    return docs.join(F.broadcast(chosen.select(F.col("doc_id").alias("__id"))), F.col("doc_id").cast("bigint") == F.col("__id"), "left_semi")


def train(docs: DataFrame, chosen: DataFrame, sample: Sample = Sample()) -> Model:
    """chosen: doc_id, learn; at most as many rows as the sample has documents, of as many words. All that comes to
    the driver is bounded by these: the vocabulary with its counts, and the weights, one part at a time."""
    own, share = _only(docs, chosen.where("learn")), docs.sparkSession.sparkContext.broadcast
    vocab = share(vocabulary(own))
    size = len(vocab.value)
    tri = materialize(trigrams(own, vocab))
    found = statistics(tri).toArrow()
    kind, at, n = (found[c].to_numpy() for c in ("kind", "at", "n"))
    times = lambda which: dict(zip(at[kind == which].tolist(), n[kind == which].tolist(), strict=True))
    before = np.zeros(size, np.int64)
    before[at[kind == WORDS]] = n[kind == WORDS]
    seen = times(TRIGRAMS)
    d3, d2 = (discounts([t.get(k, 0) for k in (1, 2, 3, 4)]) for t in (seen, times(BIGRAMS)))
    d1 = discounts([int((before == k).sum()) for k in (1, 2, 3, 4)])
    total, saved = int(before.sum()), float(_less(before, d1).sum())
    spread = (saved / total if total else 1.0) / ((before > 0).sum() + 1)
    p1 = np.where(before > 0, (before - _less(before, d1)) / max(1, total) + spread, 0)
    bits = max(0, (3 * sum(seen.values()) + 2 * size - 1) // sample.shard).bit_length()
    table = materialize(weights(tri, vocab, share(p1), d3, d2, bits), "part")
    words = np.flatnonzero(before)
    keys = Scorer.words_key(vocab.value[words])
    deal, one = keys >> np.uint64(63 - bits) >> np.uint64(1), np.log10(p1[words]).astype(np.float32)
    made = []
    for k in range(1 << bits):
        got, own = table.where(F.col("part") == k).select("keys", "weights").toArrow(), deal == k
        some = np.concatenate([keys[own], *(np.frombuffer(x.as_buffer(), np.uint64) for x in got["keys"])])
        weight = np.concatenate([one[own], *(np.frombuffer(x.as_buffer(), np.float32) for x in got["weights"])])
        made.append(share(Part.of(some, weight)))
    return Model(made, bits, math.log10(spread))


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang (null: empty), n_tokens, log_prob (log10) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in parts(batches):
            n, total = scorer(texts(b))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(total)], names=["doc_id", "lang", "n_tokens", "log_prob"])

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")
    return doc_view(docs, lang).mapInArrow(run, "doc_id bigint, lang string, n_tokens bigint, log_prob double")


def quantiles(held: DataFrame, group: str, value: str, tie: str, share: float) -> DataFrame:
    """group, q: the quantile of each group's values, exact and interpolated between neighbours. The rows are dealt by
    ranges of (group, value, tie) and ranked there, so no task has all values of a group, nor all equal ones, however
    many there are."""
    rows = ranked(held.select(group, value, tie), "__rank", group, value, tie)
    sizes = rows.groupBy(group).agg(F.min("__rank").alias("__first"), (F.lit(share) * (F.count("*") - 1)).alias("__place"))
    own = rows.join(materialize(sizes), group)
    ahead = F.col("__rank") - F.col("__first") - F.floor("__place")
    part = F.col("__place") - F.floor("__place")
    weight = F.when(ahead == 0, F.lit(1.0) - part).when(ahead == 1, part)
    return own.where((ahead == 0) | ((ahead == 1) & (part > 0))).groupBy(group).agg(F.sum(F.col(value) * weight).alias("q"))


def classify(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), limit: Limit = Limit()) -> DataFrame:
    """For each row of docs: doc_id, lang, n_tokens (words and one end), log_prob (log10), perplexity, smoothed (the
    perplexity with Limit.prior tokens of its language's mean), threshold, kept (smoothed <= threshold).

    labels: doc_id, quality, toxic. A null or empty text is an end alone; a null doc_id stays null and isn't trusted;
    a null language is the language ''. Repeated rows give repeated rows. Means and quantiles are exact, over all
    trusted documents that weren't learnt from: of a document's language, or of all where it has none of these. Without
    any there is no threshold and all documents are kept; an empty table gives none. Further columns are left out.
    """
    good, learnt = trusted(docs, labels, sample)
    own = materialize(_only(docs.select("doc_id", "text", "lang"), learnt))
    scored = materialize(perplexities(docs, train(own, learnt.withColumn("learn", F.lit(True)), sample)))
    held = materialize(scored.join(good, "doc_id", "left_semi").join(F.broadcast(learnt), "doc_id", "left_anti"))
    a, b = F.col("log_prob"), F.col("n_tokens")
    mean = materialize(held.groupBy("lang").agg((F.sum(a) / F.sum(b)).alias("mean")))
    every = materialize(held.agg((F.sum(a) / F.sum(b)).alias("all_mean")))
    smooth = lambda mean: F.pow(F.lit(10.0), -(a + F.lit(limit.prior) * mean) / (b + F.lit(limit.prior)))
    own = held.join(mean, "lang").crossJoin(F.broadcast(every))
    own = own.select("doc_id", "lang", F.lit("").alias("all"), smooth(F.col("mean")).alias("smoothed"), smooth(F.col("all_mean")).alias("all_smoothed"))
    cut = (F.col("q") * F.lit(limit.factor)).alias
    by_lang = quantiles(own, "lang", "smoothed", "doc_id", limit.quantile).join(mean, "lang").select("lang", "mean", cut("threshold"))
    rest = every.crossJoin(quantiles(own, "all", "all_smoothed", "doc_id", limit.quantile).agg(F.max("q").alias("q"))).select("all_mean", cut("all_threshold"))
    by_lang, rest = materialize(by_lang), materialize(rest)
    out = scored.join(by_lang, "lang", "left").crossJoin(F.broadcast(rest))
    threshold = F.coalesce("threshold", "all_threshold")
    smoothed = F.coalesce(smooth(F.coalesce("mean", "all_mean")), F.pow(F.lit(10.0), -a / b))
    return out.select(
        "doc_id",
        "lang",
        "n_tokens",
        "log_prob",
        F.pow(F.lit(10.0), -a / b).alias("perplexity"),
        smoothed.alias("smoothed"),
        threshold.alias("threshold"),
        F.coalesce(smoothed <= threshold, F.lit(True)).alias("kept"),
    )
