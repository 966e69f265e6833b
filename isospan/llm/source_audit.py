"""How the sources of a language differ in their words: an inverted index with baseline correction.

A source's probability of a term that it doesn't have is the same for all such terms, and so is the divergence f of two
sources on a term that neither has. A pair of sources therefore starts at f of two zero counts times the number of terms;
what is off is put right by postings alone. For a term that one of them has, the correction is as if the other hadn't; it
depends on the count alone, so that a source's counts go there as a histogram. Where both have it, what is still missing
comes from the term's postings side by side. All numbers are whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parts
from .packing import slices

#: Documents of a language that a term must occur in, the scale of probabilities, and ranks of terms that are kept.
LEAST_DOCS, SCALE, TERM_RANKS = 10, 1_000_000_000, 10
#: Entries that a worker counts before it passes them on.
ENTRIES = 400_000
POSTINGS = "lang string, source string, term string, n bigint, docs bigint"
#: A-Z in lower case, a-z and what isn't ASCII; the rest parts terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _count(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences of terms and the documents that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict = defaultdict(Counter)
        having: dict = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in n.items():
                k, own = len(found), having[lang, source]
                columns = [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(list(found), pa.binary()).cast(pa.string())]
                columns += [pa.array(found.values(), pa.int64()), pa.array([own[t] for t in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            n.clear()
            having.clear()

        for b in parts(batches):
            group = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            for key, text in zip(group, b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                seen: set[bytes] = set()
                for part in slices(text):
                    terms = part.translate(LETTERS).split()
                    n[key].update(terms)
                    seen.update(terms)
                having[key].update(seen)
            if sum(map(len, n.values())) > ENTRIES:
                yield from out()
        yield from out()

    return docs.mapInArrow(run, POSTINGS)


def _p(n: str, all_: str) -> Column:
    """A term's share of all occurrences, smoothed, as a whole number from 1; null where there is no term."""
    return F.expr(f"1 + {SCALE}BD * cast({n} + 2 as decimal(20)) div nullif(cast({all_} + 2 * v as decimal(20)), 0)")


def _f(p: str, q: str) -> Column:
    """What two shares differ by; the square of a difference fits a bigint."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _ranked(found: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language, part `pair`: how much it differs from each
    other source in all terms; part `term`: the terms that it has more of than the language, up to a rank.

    A language's terms are those that at least so many of its documents have; each row of docs is a document. Null lang,
    source and text count as empty. A source without terms is compared as well; with no term in a language all values
    are 0; a single source has no pairs. Equal values rank by the item's UTF-8 bytes. Repeated rows count each; an empty
    table gives none; further columns are left out.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    view = docs.select(*map(text, ("lang", "source", "text")))
    found = materialize(_count(view).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs)
    kept = materialize(found.drop("docs").join(terms.drop("docs"), ["lang", "term"]))
    # v terms of a language, occurrences of them in each group and language, and the share p0 of a term with no count.
    langs = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_all"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("all"))
    groups = view.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialize(groups.fillna(0, ["all", "v"]).withColumn("p0", _p("0", "all")))
    postings = kept.join(groups, ["lang", "source"])
    postings = materialize(postings.select("lang", "source", "term", "p0", _p("n", "all").alias("p"), _p("lang_n", "lang_all").alias("lang_p")))

    side = lambda df, k, *c: df.select("lang", F.col("source").alias(f"s{k}"), *(F.col(x).alias(f"{x}{k}") for x in c))
    base = side(groups, "1", "p0", "v").join(side(groups, "2", "p0"), "lang").where("s1 < s2")
    base = base.select("lang", "s1", "s2", F.coalesce(F.col("v1") * _f("p01", "p02"), F.lit(0).cast("bigint")).alias("value"))
    # A posting whose term the other source hasn't: by how often the source has a count.
    held = postings.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("m"))
    alone = side(held, "", "p0", "p", "m").join(side(groups, "2", "p0"), "lang").where("s <> s2")
    alone = alone.select("lang", F.least("s", "s2").alias("s1"), F.greatest("s", "s2").alias("s2"), (F.col("m") * (_f("p", "p02") - _f("p0", "p02"))).alias("value"))
    # Two postings of a term: what is left to correct.
    both = side(postings, "1", "term", "p0", "p").withColumnRenamed("term1", "term").join(side(postings, "2", "term", "p0", "p").withColumnRenamed("term2", "term"), ["lang", "term"]).where("s1 < s2")
    both = both.select("lang", "s1", "s2", (_f("p1", "p2") - _f("p1", "p02") - _f("p01", "p2") + _f("p01", "p02")).alias("value"))
    off = alone.unionAll(both).where("value <> 0")
    pairs = base.unionAll(off).groupBy("lang", "s1", "s2").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("s1").alias("source"), F.col("s2").alias("item")), F.struct(F.col("s2").alias("source"), F.col("s1").alias("item"))))
    pairs = pairs.select("lang", "value", ways.alias("w")).select("lang", "w.*", "value")
    more = postings.where("p > lang_p").select("lang", "source", F.col("term").alias("item"), _f("p", "lang_p").alias("value"))
    return _ranked(pairs, "pair").unionAll(_ranked(more, "term").where(F.col("rank") <= ranks))
