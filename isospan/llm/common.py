"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import materialize

#: Stands in for a null doc_id wherever ids are compared: it sorts after every other id.
NULL_ID = (1 << 63) - 1

#: Bits of a sieve, at most; and for each id.
SIEVE_BITS, BITS_EACH = 1 << 28, 16

__all__ = ["NULL_ID", "Sieve", "doc_view", "hash128", "materialize", "parts", "texts"]


class Sieve:
    """A bitmap of hashed ids, of a bounded size however many there are: passes all rows whose id is among them, and
    few others. It leaves rows that can't meet anything out of a shuffle; the join behind it is exact."""

    def __init__(self, ids: DataFrame, column: str = "id", hashed: bool = False):
        """ids: a written table; its ids of type bigint. hashed: the ids are hashes and aren't hashed again."""
        n, self.hashed = ids.count(), hashed
        self.bits = bits = 1 << min(SIEVE_BITS.bit_length() - 1, max(10, (BITS_EACH * n).bit_length()))
        words = ids.select(
            F.shiftright(self.place(F.col(column)), 6).alias("word"),
            F.expr(f"shiftleft(1L, int(pmod({column if hashed else f'xxhash64({column})'}, {bits}) % 64))").alias("bit"),
        )
        found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        bitmap = np.zeros(bits >> 6, np.int64)
        bitmap[found["word"].to_numpy()] = found["bits"].to_numpy()
        self.shared = ids.sparkSession.sparkContext.broadcast(bitmap)

    def place(self, key: Column) -> Column:
        """Where in the bitmap an id, of type bigint, has its bit."""
        return F.pmod(key if self.hashed else F.xxhash64(key), F.lit(self.bits))

    @staticmethod
    def holds(bitmap: np.ndarray, place: pa.Array | np.ndarray) -> np.ndarray:
        at = place if isinstance(place, np.ndarray) else place.to_numpy(zero_copy_only=False)
        return (bitmap[at >> 6] >> (at & 63)) & 1 == 1

    def part(self, rows: DataFrame, key: Column, among: bool = True) -> DataFrame:
        """The rows that may have a key among the ids, or those that have none for certain. Nothing of a row but the
        place of its key goes to Python."""
        shared = self.shared

        @F.arrow_udf("boolean")
        def fits(place: pa.Array) -> pa.Array:
            return pa.array(Sieve.holds(shared.value, place) == among)

        return rows.where(fits(self.place(key)))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The batch's texts as UTF-8 bytes; null is empty."""
    return [t or b"" for t in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def hash128(values: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes as two arrays of bigints."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, values)), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some rows; empty ones are left out."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def doc_view(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as bigint and text as string, and the further columns named: whatever else docs has is left behind."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
