"""Subword lattice likelihood of documents.

The pieces of an existing vocabulary span all segmentations of a word; a log-space forward recursion adds up their
probabilities, so a word's score is its marginal probability and not that of one segmentation. Pieces don't cross
words, hence a text's probability is the product over its words, and the end of text. Nothing else has a part in it.

The vocabulary's own scores weight the segmentations at first; expectation maximisation over the training words, each
as often as it occurs, then makes them piece probabilities of this corpus. All of this works on the table of distinct
words, which Spark counts, shards and joins with the documents: words of the highest counts, of which there are at most
HEAVY, go to the tasks as a dictionary, all others meet the documents' words in a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_view, materialize, parts, texts

#: Words with the highest counts that tasks hold as a dictionary.
HEAVY = 1 << 18
#: Distinct words that a task counts before it hands them on.
BUFFER = 500_000
#: Rounds of expectation maximisation, and what is added to each expected count.
ROUNDS, ADDED = 4, 0.01
#: Stands before a word in pieces; in a text it is read byte by byte.
MARK = "▁"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_CELLS = 1 << 20


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training; a null doc_id is trained on."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def read_pieces(path: str) -> tuple[list[str], np.ndarray]:
    """The pieces of a sentencepiece model that aren't control, unknown or byte pieces, and first log probabilities:
    the scores are ranks, so probability falls with the rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [k for k in range(model.vocab_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    weight = np.array([1 / (2.7 - model.get_score(k)) for k in ids])
    return [model.id_to_piece(k) for k in ids], np.log(weight / weight.sum())


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Rolling hashes of all prefixes."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * _FACTOR + codes[:, k] + np.uint64(1)
    return out


@dataclass
class Lattice:
    """Pieces by hash with their natural log probabilities: those that begin a word add up to 1, and so do the others
    with unknown (each of the 256 bytes that spell a letter without a piece) and stop, the end of a word."""

    keys: np.ndarray
    index: np.ndarray
    begins: np.ndarray
    logp: np.ndarray
    unknown: float
    stop: float
    longest: int

    @classmethod
    def of(cls, pieces: list[str], logp: np.ndarray) -> Lattice:
        h = np.array([_hashes(_codes([p]))[0, -1] for p in pieces], np.uint64)
        order = np.argsort(h)
        begins = np.array([p.startswith(MARK) for p in pieces])
        return cls(h[order], order, begins, logp, math.log(1e-6 / 256), math.log(0.3), max(map(len, pieces)))

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.keys >> np.uint64(44)] = True
        self.powers = np.cumprod(np.r_[np.uint64(1), np.repeat(_FACTOR, self.longest)], dtype=np.uint64)

    def _arcs(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each length of arc, the piece from each start, or -1."""
        h, n = _hashes(codes), codes.shape[1]
        for size in range(1, min(self.longest, n) + 1):
            own = h[:, size:] - h[:, : n + 1 - size] * self.powers[size]
            found = np.full(own.shape, -1, np.int64)
            maybe = self.seen[own >> np.uint64(44)]
            asked = own[maybe]
            at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            found[maybe] = np.where(self.keys[at] == asked, self.index[at], -1)
            yield size, found

    def _weights(self, codes: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, pieces, log probabilities) of the arcs, those of unknown letters too."""
        out = []
        for size, found in self._arcs(codes):
            w = np.where(found >= 0, self.logp[found], -np.inf)
            if size == 1:
                own = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
                w = np.where(found < 0, own * self.unknown, w)
            elif not (found >= 0).any():
                continue
            out.append((size, found, w))
        return out

    def _forward(self, n: int, words: int, arcs: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
        alpha = np.full((words, n + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, n + 1):
            for size, _, w in arcs:
                if size <= j:
                    alpha[:, j] = np.logaddexp(alpha[:, j], alpha[:, j - size] + w[:, j - size])
        return alpha

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and code points of words of one length, in parts of a bounded size."""
        plain = [MARK + w.decode("utf-8", "replace").replace(MARK, "\U0010fffe") for w in words]
        sizes = np.fromiter(map(len, plain), np.int64, len(plain))
        order = np.argsort(sizes, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(sizes[order]) > 0, True])
        for a, b in zip(edges, edges[1:]):
            step = max(1, _CELLS // int(sizes[order[a]] * min(self.longest, sizes[order[a]])))
            for k in range(a, b, step):
                at = order[k : min(b, k + step)]
                yield at, _codes([plain[x] for x in at])

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.zeros(len(words))
        for at, codes in self._groups(words):
            out[at] = self._forward(codes.shape[1], len(at), self._weights(codes))[:, -1] + self.stop
        return out

    def expected(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, of unknown bytes and of stops in all segmentations of the words, each of which
        occurs so many times."""
        total = np.zeros(len(self.logp) + 2)
        total[-1] = times.sum()
        for at, codes in self._groups(words):
            n, arcs = codes.shape[1], self._weights(codes)
            alpha = self._forward(n, len(at), arcs)
            beta = np.full((len(at), n + 1), -np.inf)
            beta[:, n] = 0
            for j in range(n - 1, -1, -1):
                for size, _, w in arcs:
                    if j + size <= n:
                        beta[:, j] = np.logaddexp(beta[:, j], w[:, j] + beta[:, j + size])
            for size, found, w in arcs:
                used = np.exp(alpha[:, : n + 1 - size] + w + beta[:, size:] - alpha[:, -1:]) * times[at, None]
                known = found >= 0
                total[:-2] += np.bincount(found[known], used[known], len(self.logp))
                if size == 1 and not known.all():
                    total[-2] += (used[~known] * np.round(w[~known] / self.unknown)).sum()
        return total

    def learnt(self, total: np.ndarray) -> Lattice:
        """With probabilities from expected uses."""
        mass = total + ADDED
        mass[-2] += ADDED * 255
        first, rest = mass[:-2][self.begins].sum(), mass[:-2][~self.begins].sum() + mass[-2:].sum()
        logp = np.log(mass[:-2] / np.where(self.begins, first, rest))
        unknown, stop = math.log(mass[-2] / rest / 256), math.log(mass[-1] / rest)
        return Lattice(self.keys, self.index, self.begins, logp, unknown, stop, self.longest)


def count_words(docs: DataFrame) -> DataFrame:
    """word, c (in training documents), t (in all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter[bytes] = Counter()
        rest: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = list(train.keys() | rest.keys())
            c = np.fromiter((train[w] for w in words), np.int64, len(words))
            t = c + np.fromiter((rest[w] for w in words), np.int64, len(words))
            train.clear()
            rest.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c), pa.array(t)], names=["word", "c", "t"])

        for b in parts(batches):
            for doc, text in zip(b.column(0).to_pylist(), texts(b), strict=True):
                (rest if held_out(doc) else train).update(words_of(text))
            if len(train) + len(rest) > BUFFER:
                yield flush()
        yield flush()

    counted = doc_view(docs).mapInArrow(run, "word binary, c bigint, t bigint")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    for b in parts(batches, 20_000):
        yield b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)


def train(spark: SparkSession, words: DataFrame, path: str, rounds: int = ROUNDS) -> Lattice:
    """Piece probabilities from the table of words. What comes back to the driver is a number for each piece."""
    lattice = Lattice.of(*read_pieces(path))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(lattice)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(shared.value.logp) + 2)
            for own, c, _ in _word_batches(batches):
                total += shared.value.expected(own, c)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

        uses = words.where("c > 0").mapInArrow(run, "piece bigint, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        total = np.zeros(len(lattice.logp) + 2)
        total[uses["piece"].to_numpy()] = uses["uses"].to_numpy()
        lattice = lattice.learnt(total)
    return lattice


def score_words(spark: SparkSession, words: DataFrame, lattice: Lattice, go: float) -> DataFrame:
    """word, c, t, logp: the log10 of the word's marginal probability, and of go, that a word follows at all."""
    shared = spark.sparkContext.broadcast(lattice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, c, t in _word_batches(batches):
            logp = (shared.value.log_probabilities(own) + math.log(go)) / math.log(10)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.binary()), pa.array(c), pa.array(t), pa.array(logp)], names=["word", "c", "t", "logp"]
            )

    return words.mapInArrow(run, "word binary, c bigint, t bigint, logp double")


def _heavy(scored: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts, at most so many: a histogram of the counts gives where they begin."""
    level = F.floor(F.log2("t") * 8)
    steps = scored.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    least, n = None, 0
    for r in steps:
        n += r["count"]
        if n > most:
            break
        least = r["level"]
    return scored.where(level >= least) if least is not None else scored.limit(0)


def score_documents(docs: DataFrame, path: str, rounds: int = ROUNDS, heavy: int = HEAVY) -> DataFrame:
    """For each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    path: a sentencepiece model, readable on the driver. Tokens are the words, A-Z in lower case, and one end.
    base_score: log10 of an add-one unigram model of the training words; score: log10 of the lattice's marginal
    probability, that of the end being its share of the training tokens. A null or empty text is an end alone. A null
    doc_id is trained on and stays null; repeated rows give repeated rows and count as often; an empty table gives
    none. Further columns are left out. Words without a piece are spelt in bytes.
    """
    spark = docs.sparkSession
    own = doc_view(docs)
    words = materialize(count_words(own))
    trained = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))
    ends = own.agg(F.count_if(trained)).first()[0]
    c = F.col("c")
    total, distinct = words.agg(F.coalesce(F.sum(c), F.lit(0)), F.count_if(c > 0)).first()
    n, below = total + ends, total + ends + distinct + (ends > 0) + 1
    # Of a corpus without words, or without training documents, both a word and an end still have a chance.
    stop = min(max(ends, 0.5), n - 0.5) / n if n else 0.5
    scored = materialize(score_words(spark, words, train(spark, words, path, rounds), 1 - stop))
    top = _heavy(scored, heavy).toArrow()
    c = top["c"].to_numpy()
    shared = spark.sparkContext.broadcast(
        (top["word"].to_pylist(), c > 0, np.log10((c + 1) / below), top["logp"].to_numpy())
    )
    end = int(ends > 0), math.log10((ends + 1) / below), math.log10(stop)
    head = pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, known, base, score = shared.value
        known, base, score = np.r_[known, False], np.r_[base, 0.0], np.r_[score, 0.0]
        get = {w: k for k, w in enumerate(listed)}.get
        for b in parts(batches):
            raw = list(map(words_of, texts(b)))
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            flat = list(chain.from_iterable(raw))
            at = np.fromiter(map(get, flat, repeat(len(listed))), np.int64, len(flat))
            row = np.repeat(np.arange(len(raw)), sizes)
            sums = [np.bincount(row, x, len(raw)) for x in (known[at], base[at], score[at])]
            rest: Counter[tuple[int, bytes]] = Counter()
            for k in np.flatnonzero(at == len(listed)).tolist():
                rest[int(row[k]), flat[k]] += 1
            rid = b.column(2).to_numpy()
            heads = [
                {"doc_id": d, "n_tokens": int(s) + 1, "known": int(k) + end[0], "base": x + end[1], "score": y + end[2]}
                for d, s, k, x, y in zip(b.column(0).to_pylist(), sizes, *sums, strict=True)
            ]
            # A document's own row has a key that no word has, so it meets none and stands apart from the others.
            keys = [b"\xff" + int(r).to_bytes(8, "big") for r in rid]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[rid, rid[np.fromiter((r for r, _ in rest), np.int64, len(rest))]]),
                    pa.array([*keys, *(w for _, w in rest)], pa.binary()),
                    pa.array([*repeat(0, len(raw)), *rest.values()], pa.int64()),
                    pa.array([*heads, *repeat(None, len(rest))], head),
                ],
                names=["rid", "word", "times", "head"],
            )

    out = "rid bigint, word binary, times bigint, head struct<doc_id:bigint,n_tokens:bigint,known:bigint,base:double,score:double>"
    rows = own.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(run, out)
    met = rows.join(scored.select("word", "c", "logp"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    both = lambda field, rest: F.sum(F.coalesce(F.col(f"head.{field}"), F.col("times") * rest))
    total = met.groupBy("rid").agg(
        F.max("head.doc_id").alias("doc_id"),
        F.sum("head.n_tokens").alias("n_tokens"),
        both("known", (c > 0).cast("bigint")).alias("n_known"),
        both("base", F.log10((c + 1) / F.lit(below))).alias("base_score"),
        both("score", F.col("logp")).alias("score"),
    )
    return total.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
