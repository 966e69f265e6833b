"""Mixing sources to target weights.

Temperature mixing raises each source's share of the tokens to a power between 0 and 1. The exponent is found by
bisection, to meet a target entropy, a limit on how often the smallest source repeats, or both. The normalised
weights become token budgets, and a budget is met by going through permutations of the source's blocks of documents:
whole ones first, then a part of one that stops at the budget. With a token budget for the whole mixture, sources are
cut down or repeated to their share of it; without one, the mixture is the smallest in which no document is left out.

What grows with the corpus stays in Spark: sums by source and cell, of which a source has CELLS at most, each bisection
pass one aggregation of them, running sums of the blocks of a source and of the documents of a block. A source's cells
are dealt to about as many blocks as a block has documents, so a source that holds a third of all rows has no larger
task than that. Texts are read twice: for the sums, and for the mixture, into which each goes through one shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bisection steps in one pass over the sources, and passes.
STEPS, PASSES = 5, 4
#: Decimals kept of the exponent, so that the order in which sums are made can't change what follows.
DECIMALS = 5
#: A block has so many documents at least.
LEAST_BLOCK = 64
#: Parts of a source by hash, of which its blocks are made.
CELLS = 1 << 16
#: Steps of the chance with which the document at the end of a budget is taken.
CHANCE = 1 << 20


@dataclass(frozen=True)
class Target:
    """entropy: as a part of the largest, that of equal weights. repeats: how often the source that repeats most may
    do so. tokens: expected of the mixture in all, or None. seed: of the permutations. mix_blocks: parts of the mixture, each with
    every source in its weight."""

    entropy: float | None = 0.9
    repeats: float | None = 3.0
    tokens: int | None = None
    seed: int = 17
    mix_blocks: int = 64


def n_tokens(text: Column | str) -> Column:
    """Words of a text, one at least, so that each document takes part."""
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.greatest(F.coalesce(words, F.lit(0)), F.lit(1)).cast("bigint")


def _measures(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """Entropy as a part of the largest, and the most repeats, for each exponent; one aggregation."""
    grid = F.explode(F.lit(exponents)).alias("a")
    w = F.col("p") ** F.col("a")
    rows = (
        sources.select("p", grid)
        .groupBy("a")
        .agg(F.sum(w).alias("z"), F.sum(w * F.log(w)).alias("e"), F.max(w / F.col("p")).alias("hi"), F.min(w / F.col("p")).alias("lo"), F.count("*").alias("n"))
        .collect()
    )
    found = {}
    for r in rows:
        entropy = (math.log(r["z"]) - r["e"] / r["z"]) / math.log(r["n"]) if r["n"] > 1 else 1.0
        found[r["a"]] = entropy, r["hi"] / r["lo"]
    return [found[a] for a in exponents]


def _bisect(sources: DataFrame, too_high: Callable[[float, float], bool]) -> tuple[float, float]:
    """The bracket of the exponent in [0, 1] from which on entropy and repeats are too high.

    A pass measures all midpoints that the next STEPS bisection steps could ask for.
    """
    low, high, n = 0.0, 1.0, 1 << STEPS
    for _ in range(PASSES):
        points = [low + (high - low) * k / n for k in range(n + 1)]
        over = [too_high(*m) for m in _measures(sources, points[1:-1])]
        a, b = 0, n
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (a, mid) if over[mid - 1] else (mid, b)
        low, high = points[a], points[b]
    return low, high


def find_exponent(sources: DataFrame, target: Target) -> float:
    """sources: p, each source's share of the tokens. A smaller exponent evens the weights out, which raises entropy
    and repeats: the largest that meets the entropy, raised if need be to the smallest within the limit on repeats."""
    found = 1.0
    if target.entropy is not None and _measures(sources, [1.0])[0][0] < target.entropy:
        found, _ = _bisect(sources, lambda entropy, _: entropy < target.entropy)
    if target.repeats is not None and _measures(sources, [found])[0][1] > target.repeats:
        _, found = _bisect(sources, lambda _, repeats: repeats <= target.repeats)
    return round(found, DECIMALS)


def drawn(target: Target, *what: Column | str) -> Column:
    """A random number of 60 bits, the same for the same values and seed."""
    text = F.concat_ws(":", F.lit(str(target.seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in what))
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(15)), 16, 10).cast("bigint")


def weigh(cells: DataFrame, target: Target) -> DataFrame:
    """cells: __source, __cell, __size (tokens), __docs. For each source __all (its tokens), __blocks, __weight and
    __budget in tokens.

    The budgets are those of the target's tokens, or else the smallest in the ratio of the weights under which no
    document is left out.
    """
    totals = cells.groupBy("__source").agg(F.sum("__docs").alias("__docs"), F.sum("__size").alias("__all"))
    totals = materialize(totals)
    everything = totals.agg(F.sum("__all")).first()[0]
    sources = totals.withColumn("p", F.col("__all") / F.lit(everything or 1))
    a = find_exponent(sources, target) if everything else 1.0
    raised = F.col("p") ** F.lit(a)
    z, least = sources.agg(F.sum(raised), F.min(raised / F.col("p"))).first()
    block = F.greatest(F.lit(LEAST_BLOCK), F.sqrt("__docs"))
    weight = F.round(raised / F.lit(z or 1.0), 12)
    if target.tokens is None:
        budget = F.col("__all") * F.greatest(F.lit(1.0), F.round(raised / F.col("p") / F.lit(least or 1.0), 9))
    else:
        budget = weight * F.lit(target.tokens)
    blocks = F.least(F.lit(CELLS), F.ceil(F.col("__docs") / block)).cast("bigint")
    return materialize(sources.select("__source", "__all", blocks.alias("__blocks"), weight.alias("__weight"), F.round(budget).cast("bigint").alias("__budget")))


def mix_sources(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """The mixture as rows of docs, all columns, each as often as its source's budget asks, with n_tokens, weight (of
    the source), copy (from 0), mix_block and slot, which replace columns of docs so named.

    To read the mixture, go through mix_block and within it through slot; every mix_block has each source in its
    weight. Without a token budget each document is in it once at least, and of the last, partial pass through a source
    there are the documents that start within its budget, so it is overrun by less than one document. With one, the
    document at the end of a source's budget is drawn with the part of it that lies within as its chance, so that the
    tokens of each source are expected to be just its budget; realised() tells what they are.

    A null source is a source of its own. A null or empty text counts as one token. Null doc_ids are told apart by
    text. Rows equal in doc_id, source and tokens may change places with each other. An empty table gives none.
    """
    docs = docs.drop("n_tokens", "weight", "copy", "mix_block", "slot")
    own = docs.withColumns(
        {
            "__source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")),
            "__tokens": n_tokens("text"),
            "__id": F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")).cast("binary")))),
        }
    ).withColumn("__cell", drawn(target, F.lit("cell"), "__id") % CELLS)
    cells = materialize(own.groupBy("__source", "__cell").agg(F.sum("__tokens").alias("__size"), F.count("*").alias("__docs")))
    sources = weigh(cells, target)
    block = F.floor(F.col("__cell") * F.col("__blocks") / CELLS).cast("bigint")
    passes = F.explode(F.sequence(F.lit(0), F.ceil(F.col("__budget") / F.col("__all")).cast("int") - 1))
    sources = sources.where("__budget > 0")
    # Where each block starts in each pass through its source.
    blocks = cells.join(sources, "__source").withColumn("__block", block)
    blocks = materialize(blocks.groupBy("__source", "__block").agg(F.sum("__size").alias("__size"), F.max("__budget").alias("__budget"), F.max("__all").alias("__all")))
    in_pass = Window.partitionBy("__source", "copy").orderBy(drawn(target, F.lit("block"), "copy", "__block"), "__block")
    starts = blocks.withColumn("copy", passes).select(
        "__source",
        "copy",
        "__block",
        (F.sum("__size").over(in_pass.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")).alias("__start"),
    )
    in_block = Window.partitionBy("__source", "copy", "__block").orderBy("slot", "doc_id", "__tokens")
    dealt = own.join(sources, "__source").withColumn("__block", block).repartition("__source", "__block")
    placed = (
        dealt.withColumn("copy", passes)
        .withColumn("slot", drawn(target, F.lit("slot"), "copy", "__id"))
        .withColumn("__within", F.sum("__tokens").over(in_block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__tokens"))
        .join(starts, ["__source", "copy", "__block"])
        .withColumn("__at", F.col("copy") * F.col("__all") + F.col("__start") + F.col("__within"))
        .where(F.col("__at") < F.col("__budget"))
    )
    if target.tokens is not None:
        # In whole numbers; a document that lies within as a whole is always taken.
        chance = F.col("__tokens") * (drawn(target, F.lit("edge"), "copy", "__id") % CHANCE)
        within = F.least(F.col("__tokens"), F.col("__budget") - F.col("__at"))
        placed = placed.where(chance < within * CHANCE)
    mix_block = F.floor(F.col("__at") / F.col("__budget") * F.lit(target.mix_blocks)).cast("bigint")
    return placed.select(
        *docs.columns,
        F.col("__tokens").alias("n_tokens"),
        F.col("__weight").alias("weight"),
        F.col("copy").cast("bigint").alias("copy"),
        mix_block.alias("mix_block"),
        "slot",
    )


def realised(mixture: DataFrame) -> DataFrame:
    """What a mixture came to, by source: source, weight, n_docs, n_tokens, share (of all tokens). A null source is one
    of its own; a source of which the mixture has no document isn't listed; an empty mixture gives none."""
    sums = mixture.groupBy("source").agg(F.max("weight").alias("weight"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    sums = materialize(sums)
    every = sums.agg(F.sum("n_tokens").alias("every"))
    return sums.crossJoin(F.broadcast(every)).select("source", "weight", "n_docs", "n_tokens", (F.col("n_tokens") / F.col("every")).alias("share"))
