"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; its failure is one bit of ``failed`` and the measurement behind it
is kept. A policy is a named, versioned mask over those bits: applying another version, or asking what a rule alone
rejects, reads the ledger and not the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_view, texts

SYMBOLS = b"#*$%&|<>"

#: Rules in the order of their bits.
RULES = (
    "few_words",  # under 50 words
    "repeated_windows",  # over half of the words in 3-word windows found twice or more
    "symbols",  # symbols: over 10 for each 100 words
    "duplicate_lines",  # over 30 % of the lines with a word equal an earlier one
    "shouting",  # over half of the letters A-Z, a-z are upper-case
    "word_length",  # mean word under 2 or over 20 code points
    "long_word",  # a word of over 1000 code points
)
BIT = {name: 1 << k for k, name in enumerate(RULES)}

LEDGER = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, n_upper bigint, n_letters bigint, longest_word bigint, failed bigint"
)


@dataclass(frozen=True)
class Policy:
    """The rules of one version; a document is kept if it fails none of them."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = {
    p.version: p
    for p in (
        BASE,
        Policy("v1", (*BASE.rules, "symbols", "duplicate_lines")),
        Policy("v2", (*BASE.rules, "symbols", "duplicate_lines", "shouting", "word_length", "long_word")),
    )
}
CURRENT = "v2"

_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_LETTER = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))
_NOT_SYMBOL = bytes(c for c in range(256) if c not in SYMBOLS)
_CONTINUES = bytes(range(0x80, 0xC0))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    if v == n:
        return 0
    _, pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    inside = np.zeros(n, bool)
    inside[:-2] |= again
    inside[1:-1] |= again
    inside[2:] |= again
    return int(inside.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """A ledger row without its doc_id."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.translate(None, _CONTINUES))
    symbols = len(text.translate(None, _NOT_SYMBOL))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    upper, letters = len(text.translate(None, _NOT_UPPER)), len(text.translate(None, _NOT_LETTER))
    longest = max((len(w) for w in words), default=0)
    if longest > 1000:
        longest = max(len(w.translate(None, _CONTINUES)) for w in words)
    failed = (
        (n < 50) * BIT["few_words"]
        | (100 * repeats > 50 * n) * BIT["repeated_windows"]
        | (100 * symbols > 10 * n) * BIT["symbols"]
        | (100 * dup > 30 * len(lines)) * BIT["duplicate_lines"]
        | (2 * upper > letters) * BIT["shouting"]
        | (n > 0 and not 2 * n <= chars <= 20 * n) * BIT["word_length"]
        | (longest > 1000) * BIT["long_word"]
    )
    return n, chars, symbols, len(lines), dup, repeats, upper, letters, longest, failed


def ledger(docs: DataFrame) -> DataFrame:
    """One row per row of docs: measurements and ``failed``, the bits of the failed rules.

    Words are maximal runs without ASCII white space. A null or empty text has no words and fails few_words; a null
    doc_id stays null; repeated rows give repeated rows; an empty table gives none. Further columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                columns = zip(*map(measure, texts(b)), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *(pa.array(c, pa.int64()) for c in columns)],
                    names=[x.split()[0] for x in LEDGER.split(", ")],
                )

    return doc_view(docs).mapInArrow(run, LEDGER)


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``kept``, and ``policy`` naming the version."""
    return book.withColumns(
        {"kept": F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0, "policy": F.lit(policy.version)}
    )


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone (and so would come back without it),
    and the policy's rejects and documents in all. One aggregation of the ledger's bits."""
    bits = F.col("failed").bitwiseAND(F.lit(policy.mask))
    sums = [F.count("*").alias("docs"), F.count_if(bits != 0).alias("rejected")]
    for r in policy.rules:
        sums += [
            F.count_if(bits.bitwiseAND(F.lit(BIT[r])) != 0).alias(f"{r}_n"),
            F.count_if(bits == BIT[r]).alias(f"{r}_alone"),
        ]
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"{r}_n").alias("failing"), F.col(f"{r}_alone").alias("alone")) for r in policy.rules))
    return book.agg(*sums).select("docs", "rejected", F.inline(rows))


def keep(docs: DataFrame, policy: Policy) -> DataFrame:
    """The rows of docs, all columns as they are, that the policy keeps; in one pass over the texts."""
    mask = policy.mask

    @F.arrow_udf("boolean")
    def passes(text: pa.Array) -> pa.Array:
        return pa.array([not measure(t.as_py() or b"")[-1] & mask for t in text.cast(pa.binary())], pa.bool_())

    return docs.where(passes("text"))
