"""Population, facilities and prebuilt networks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mesh_centre
from ..ordinals import in_file_order, placed
from ..operators.timetable import Timetable, lay_out, open_timetable


class MissingColumns(ValueError):
    """A table lacks columns; ``missing`` has their names in order."""

    def __init__(self, missing: Iterable[str]):
        self.missing = sorted(missing)
        super().__init__(f"missing columns: {', '.join(self.missing)}")


def require(df: DataFrame, columns: Iterable[str]) -> None:
    if missing := set(columns) - set(df.columns):
        raise MissingColumns(missing)


def optional(load: Callable[[], DataFrame]) -> DataFrame | None:
    """What load() reads, or None if its file isn't there."""
    try:
        return load()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """mesh_ord, meshcode, pop_t, pop_65over, lat, lon. Meshes are told apart by row, so a code may repeat; missing
    numbers of people are 0."""
    raw = placed(spark.read.csv(path, header=True))
    require(raw, ("Meshcode", "PopT", "Pop65over"))
    people = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    return with_centres(
        in_file_order(raw, "mesh_ord").select(
            "mesh_ord",
            F.col("Meshcode").try_cast("bigint").alias("meshcode"),
            people("PopT").alias("pop_t"),
            people("Pop65over").alias("pop_65over"),
        )
    )


def with_centres(meshes: DataFrame) -> DataFrame:
    """Meshes with lat and lon; those with a code too short to place are left out."""
    lat, lon = mesh_centre(F.col("meshcode"))
    return meshes.withColumns({"lat": lat, "lon": lon}).where("lat IS NOT NULL AND lon IS NOT NULL")


def read_facilities(spark: SparkSession, path: str) -> DataFrame:
    """fac_ord, name, type, latitude, longitude."""
    raw = placed(spark.read.csv(path, header=True))
    require(raw, ("name", "type", "latitude", "longitude"))
    return in_file_order(raw, "fac_ord").select(
        "fac_ord",
        "name",
        "type",
        F.col("latitude").try_cast("double").alias("latitude"),
        F.col("longitude").try_cast("double").alias("longitude"),
    )


def write_network(bus: DataFrame, walk: DataFrame, folder: str, csv: bool = False, stops: DataFrame | None = None) -> Timetable:
    """Both edge tables as Parquet, and their layout for searches, which read_timetable() opens again; as CSV too if
    asked for. stops: as for lay_out()."""
    for name, edges in (("bus_edges", bus), ("walk_edges", walk)):
        edges.write.mode("overwrite").parquet(f"{folder}/{name}")
        if csv:  # which has no structs
            edges.drop("ord").write.mode("overwrite").csv(f"{folder}/{name}_csv", header=True)
    return lay_out(*read_network(bus.sparkSession, folder), folder=f"{folder}/timetable", stops=stops)


def read_network(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/bus_edges"), spark.read.parquet(f"{folder}/walk_edges")


def read_timetable(spark: SparkSession, folder: str) -> Timetable:
    """The layout that write_network() wrote: buckets and hours are known again, and no edge is moved or written."""
    return open_timetable(spark, f"{folder}/timetable")
