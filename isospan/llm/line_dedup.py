"""Line deduplication with levelled sorted runs.

Documents come in batches in the order of their ids. A batch's line hashes are merge-anti-joined with the runs
written so far; what is new becomes a sorted run of its own. Runs are levelled: once a level holds FANOUT of them,
they are compacted into one run of the next level, so a batch reads few runs. A run holds, for each hash, the
smallest document that has the line; every other document loses it.

Runs are sorted tables in as many buckets as a shuffle has parts: a batch is grouped into these, before and after the
shuffle, and runs are joined and compacted bucket by bucket without one. Lines that very many documents have don't meet
in one task: their owners are sent to all tasks. Of the texts, only those of documents that lose lines are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import bucketed
from .common import NULL_ID, Sieve, doc_view, hash128, materialize, parts, texts

#: Batches, at least; and documents of a batch, at most.
BATCHES, BATCH_DOCS = 4, 50_000_000
FANOUT = 2
#: Documents from which a line is a hot one, at least; and hot ones, at most.
HOT, MOST_HOT = 1_000, 100_000
#: Code points from which a line counts.
LEAST_LENGTH = 10
SPACE = b" \t\n\x0b\x0c\r"
_CONTINUES = bytes(range(0x80, 0xC0))
_KEY = ["h1", "h2"]


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends, A-Z in lower case; empty if that is too short to count."""
    key = line.strip(SPACE).lower()
    if len(key) < LEAST_LENGTH or len(key) < 4 * LEAST_LENGTH and len(key.translate(None, _CONTINUES)) < LEAST_LENGTH:
        return b""
    return key


class Runs:
    """Sorted runs of line hashes and their owners, by level. The hashes of different runs differ."""

    def __init__(self, buckets: int, fanout: int = FANOUT):
        self.buckets, self.fanout = buckets, fanout
        self.levels: list[list[DataFrame]] = []

    def all(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> None:
        """batch: h1, h2, id, each document's distinct hashes; its ids are larger than those of batches before."""
        new = batch.groupBy(_KEY).agg(F.min("id").alias("owner"))
        for run in self.all():
            new = new.join(run.hint("merge"), _KEY, "left_anti")
        run, level = self._write(new), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            run = self._write(reduce(self._merged, self.levels[level]))
            self.levels[level] = []
            level += 1

    @staticmethod
    def _merged(one: DataFrame, other: DataFrame) -> DataFrame:
        both = one.join(other.withColumnRenamed("owner", "also").hint("merge"), _KEY, "full")
        return both.select(*_KEY, F.coalesce("owner", "also").alias("owner"))

    def _write(self, rows: DataFrame) -> DataFrame:
        return bucketed(rows, self.buckets, _KEY)


def line_hashes(docs: DataFrame) -> DataFrame:
    """h1, h2, id: the distinct hashes of each row's lines; id is doc_id, or NULL_ID where it is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            keys, ids = [], []
            for doc, t in zip(b.column(0).to_pylist(), texts(b), strict=True):
                own = set(map(line_key, t.split(b"\n"))) - {b""}
                keys += own
                ids += [NULL_ID if doc is None else doc] * len(own)
            h1, h2 = hash128(keys)
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(ids, pa.int64())], names=["h1", "h2", "id"])

    return doc_view(docs).mapInArrow(run, "h1 bigint, h2 bigint, id bigint")


def drops(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """id and ``drops``, the hashes (h1, h2) of the lines that the document loses; documents that lose none are out."""
    spark, id_ = docs.sparkSession, F.col("doc_id").cast("bigint")
    batches = max(batches, -(-docs.count() // BATCH_DOCS))
    shares = [k / batches for k in range(1, batches)]
    cuts = sorted(set(docs.agg(F.percentile_approx(id_, shares, 100 * batches)).first()[0] or [])) if shares else []
    batch = F.lit(0)
    if cuts:  # how many cuts are smaller than the id
        batch = F.size(F.filter(F.lit(cuts), lambda c: c < F.col("id")))
    runs = Runs(int(spark.conf.get("spark.sql.shuffle.partitions")))
    hashes = materialize(line_hashes(docs).withColumn("batch", batch), "batch")
    for k in range(len(cuts) + 1):
        runs.add(hashes.where(F.col("batch") == k))
    many = F.greatest(F.lit(HOT), F.lit(hashes.count() // MOST_HOT))
    hot = materialize(hashes.groupBy(_KEY).count().where(F.col("count") > many).select(_KEY))
    hot, lost = F.broadcast(hot), []
    for run in runs.all():
        owned = materialize(run.join(hot, _KEY, "left_semi"))
        lost.append(hashes.join(F.broadcast(owned), _KEY))
        lost.append(hashes.join(hot, _KEY, "left_anti").join(run.hint("merge"), _KEY))
    lost = reduce(DataFrame.unionAll, (x.where("id != owner").select("id", *_KEY) for x in lost))
    return lost.groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))


def dedup_lines(docs: DataFrame, batches: int = BATCHES, counts: bool = True) -> DataFrame:
    """The rows of docs with all columns, text without the lines that a smaller doc_id has too, and, if counts, n_lines
    (before dropping) and n_dropped, which replace columns of docs so named.

    Lines are parted by \\n. Those whose key (see line_key) has under 10 code points stay. A null or empty text is one
    empty line and stays as it is. Rows with the same doc_id are one document: each keeps the lines that it owns,
    also those it repeats. Null doc_ids are one document, larger than all others. An empty table gives none.
    """
    more = ["n_lines", "n_dropped"] if counts else []
    docs = docs.drop(*more)
    schema = T.StructType([*docs.schema, *(T.StructField(c, T.LongType()) for c in more)])
    at = docs.columns.index("text")
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID))
    lost = materialize(drops(docs, batches))
    sieve = Sieve(lost)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    found = [n_lines.alias("n_lines"), F.lit(0).cast("bigint").alias("n_dropped")] if counts else []
    whole, some = sieve.part(docs, key, False).select(*docs.columns, *found), sieve.part(docs, key)
    both = some.join(lost, key == lost["id"], "left").select(*(some[c] for c in docs.columns), lost["drops"].alias("__drops"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            kept, n_lines, n_dropped = [], [], []
            raw = b.column(at).cast(pa.binary()).to_pylist()
            for t, gone in zip(raw, b.column(b.num_columns - 1).to_pylist(), strict=True):
                lines = (t or b"").split(b"\n")
                n_lines.append(len(lines))
                if gone:
                    gone = {(x["h1"], x["h2"]) for x in gone}
                    h1, h2 = hash128(keys := list(map(line_key, lines)))
                    own = [not k or x not in gone for k, x in zip(keys, zip(h1.tolist(), h2.tolist(), strict=True), strict=True)]
                    lines = [x for x, k in zip(lines, own, strict=True) if k]
                    t = t and b"\n".join(lines)
                kept.append(t)
                n_dropped.append(n_lines[-1] - len(lines))
            columns = [b.column(k) for k in range(b.num_columns - 1)]
            columns[at] = pa.array(kept, pa.binary()).cast(pa.string())
            found = [pa.array(x, pa.int64()) for x in (n_lines, n_dropped)] if counts else []
            yield pa.RecordBatch.from_arrays([*columns, *found], names=schema.names)

    return whole.unionAll(both.mapInArrow(run, schema))
