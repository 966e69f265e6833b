"""From raw documents to a training mixture."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isospan.llm import decontaminate, line_dedup, mixing, ngram_join, quality_rules
from isospan.llm.common import materialize
from isospan.llm.oracles import PIPELINE
from isospan.llm.queries import table

#: What is sent to Python at once. The session's own settings of 10,000 rows and 64 MB let a few tasks hold hundreds of
#: MB of texts outside the heap, more the longer the texts are.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def bound_batches(spark: SparkSession) -> None:
    """Hold for what the session runs from here on; a DataFrame is bound by them when it is computed, not when made."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


@contextmanager
def own_settings(spark: SparkSession) -> Iterator[None]:
    """Gives the session its batch settings back afterwards."""
    before = {key: spark.conf.get(key) for key in BATCHES}
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy keeps. Null and empty texts have no words and go, by the rule of the
    fewest words; repeated rows are judged each by itself and stay or go together."""
    bound_batches(spark)
    return quality_rules.keep(docs, quality_rules.POLICIES[quality_rules.CURRENT])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; n_chars, if there is such a column, is that of what is left
    (null for a null text, which stays null). No document goes, even one that has no line left. Rows of the same doc_id
    are one document and keep each other's lines; null doc_ids come last."""
    bound_batches(spark)
    left = line_dedup.dedup_lines(docs, counts=False)
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies: the smallest doc_id, and of repeated rows of it the first by
    text. Null, empty and blank texts are copies of each other; null doc_ids are one document, larger than all others."""
    bound_batches(spark)
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item. Null and empty texts overlap nothing and stay; a document is
    told by id and text, so repeated rows stay or go together."""
    bound_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the weight of its source asks, once at least, with its place in the mixture. A null
    source is one of its own, null and empty texts count as one token, repeated rows are dealt each by itself."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_join", near_copies),
    ("decontamination", decontaminated),
    ("mixing", mixture),
]

#: The same stages in DuckDB.
ORACLE_SQL = PIPELINE


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole of documents, each written before the next. The session's settings are left as they were:
    what is returned is computed later, but mixing sends nothing to Python. An empty table gives none."""
    docs = table(spark, sf_dir, "documents")
    with own_settings(spark):
        for k, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = materialize(docs)
    return docs
