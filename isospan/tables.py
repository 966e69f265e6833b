"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import operator
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Session, folder and table name: what there is of these.
_written: list[tuple[SparkSession, str | None, str | None]] = []

#: What is kept beside a bucketed table at a path.
LAYOUT = "buckets int, parted array<string>, columns string"


#: Rows that a task sorts, about.
SORTED_ROWS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local runs a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="isospan-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _remove(spark: SparkSession, path: str | None, name: str | None) -> None:
    try:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        if path is None:
            return
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may have ended by then; the folder is scratch space
        pass


@atexit.register
def release() -> None:
    """Delete the tables that materialize() and bucketed() wrote. Whoever has used up all results of a session that goes
    on may call it; at the end of the process it is called anyway."""
    while _written:
        _remove(*_written.pop())


def _new_path(spark: SparkSession, name: str | None = None) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name or f'isospan-{uuid.uuid4().hex}'}"
    _written.append((spark, path, name))
    return path


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, to be deleted with the others."""
    return _new_path(spark)


def materialize(df: DataFrame, *by: str) -> DataFrame:
    """Write df to the shared folder, parted by some columns if named, and read it again: cuts its lineage, survives
    lost executors, and lets the planner see its true size."""
    spark = df.sparkSession
    path = _new_path(spark)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, which has so many rows, dealt by the keys to as many partitions as leave a task about SORTED_ROWS of them: joins,
    sorts and windows by the keys then need no more memory of a task when there are more rows. As it is if the session's
    partitions are enough. A key with many rows has them in one partition."""
    parts = -(-rows // SORTED_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def measured(df: DataFrame, *ids: str) -> tuple[DataFrame, int, int]:
    """As materialize(), with the number of rows and about their bytes, which are counted as they are written. ids: the
    columns whose values may be long."""
    seen = Observation()
    size = F.sum(reduce(operator.add, [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in ids], F.lit(16 * len(df.columns))))
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(size, F.lit(0)).alias("bytes")))
    return out, seen.get["n"], seen.get["bytes"]


def bucketed(df: DataFrame, buckets: int, keys: Sequence[str], *by: str, path: str | None = None) -> DataFrame:
    """As materialize(), in so many buckets by the keys, sorted: joins and groups on the keys need no shuffle of it. df
    is best dealt by the keys to as many partitions already, or each of its tasks writes to all buckets. Scratch, or kept
    at a path from where read_bucketed() reads it."""
    spark, name = df.sparkSession, f"isospan_{uuid.uuid4().hex}"
    where = path or _new_path(spark, name)
    writer = df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", where)
    (writer.partitionBy(*by) if by else writer).saveAsTable(name)
    if path:
        _written.append((spark, None, name))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        spark.createDataFrame([(buckets, list(by), columns)], LAYOUT).coalesce(1).write.mode("overwrite").json(f"{path}.layout")
    return spark.table(name)


def read_bucketed(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """A table that bucketed() wrote to a path, by the same keys, with its buckets and partitions."""
    layout, name = spark.read.schema(LAYOUT).json(f"{path}.layout").first(), f"isospan_{uuid.uuid4().hex}"
    parted, by = (", ".join(f"`{c}`" for c in x) for x in (layout.parted, keys))
    spark.sql(
        f"CREATE TABLE {name} ({layout.columns}) USING parquet " + (f"PARTITIONED BY ({parted}) " if parted else "")
        + f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {layout.buckets} BUCKETS LOCATION '{path}'"
    )
    if parted:
        spark.catalog.recoverPartitions(name)
    _written.append((spark, None, name))
    return spark.table(name)
