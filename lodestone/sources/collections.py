"""Collections of vectors as one Parquet table, partitioned by collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import latest
from ..operators.vector import search, valid_point
from ..plans.lineage import cut

# fixed values: distances that a collection may use
DISTANCES = ["cosine", "euclid", "dot", "manhattan"]
# fixed value: what the names of a project's collections begin with
PROJECT = "project-"


class PointStore:
    """Points ``id, vector, payload...`` by collection. Writing replaces the partition of a
    collection; what it replaces is cut off first, so a lost executor cannot need files
    that are gone. Each point stands once: the last one written under its id."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def read(self, collection: str | None = None) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        return rows if collection is None else rows.where(F.col("collection") == collection)

    def upsert(self, collection: str, points: DataFrame, size: int) -> DataFrame:
        """Writes the valid points and gives the others, of the wrong size, without an id
        or with components that are null or not finite."""
        fine = valid_point(F.col("id"), F.col("vector"), size)
        new = points.where(fine).withColumn("collection", F.lit(collection)).withColumn("_new", F.lit(1))
        if self._exists():
            new = new.unionByName(self.read(collection).withColumn("_new", F.lit(0)), allowMissingColumns=True)
        once = latest(new, ["id"], [F.desc("_new"), F.desc(F.xxhash64("vector"))], 1).drop("_new")
        self._write(once)
        return points.where(~F.coalesce(fine, F.lit(False)))

    def _write(self, rows: DataFrame) -> None:
        cut(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(self.path)

    def delete(self, collection: str, ids: DataFrame) -> None:
        """Removes the points whose ids ``ids`` holds."""
        left = cut(self.read(collection).join(ids.select("id").distinct(), "id", "left_anti"))
        if left.isEmpty():
            self.clear(collection)
        else:
            self._write(left)

    def clear(self, collection: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/collection={collection}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.spark.catalog.refreshByPath(self.path)

    def info(self) -> DataFrame:
        """``collection, points, size`` of every collection."""
        return self.read().groupBy("collection").agg(F.count("*").alias("points"), F.max(F.size("vector")).alias("size"))

    def _settings(self, collection: str):  # noqa: ANN202
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}-settings/collection={collection}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def create(self, collection: str, size: int, distance: str = "cosine") -> bool:
        """States the size and the distance of a collection's vectors. True if it is new;
        one that is there with other settings is an error, with the same it stays."""
        if distance not in DISTANCES or size < 1:
            raise ValueError(f"no collection of size {size} and distance {distance}")
        at, system = self._settings(collection)
        if system.exists(at):
            held = self.settings().where(F.col("collection") == collection).first()
            if (held["size"], held["distance"]) != (size, distance):
                raise ValueError(f"{collection} has size {held['size']} and distance {held['distance']}")
            return False
        self.spark.createDataFrame([(size, distance)], "size int, distance string").coalesce(1).write.parquet(at.toString())
        return True

    def settings(self) -> DataFrame:
        """``collection, size, distance`` of every created collection."""
        at, system = self._settings("")
        if not system.exists(at.getParent()):
            return self.spark.createDataFrame([], "collection string, size int, distance string")
        rows = self.spark.read.schema("size int, distance string, collection string").parquet(f"{self.path}-settings")
        return rows.select("collection", "size", "distance")

    def _of(self, collection: str):  # noqa: ANN202
        held = self.settings().where(F.col("collection") == collection).first()
        if held is None:
            raise ValueError(f"{collection} was not created")
        return held

    def put(self, collection: str, points: DataFrame) -> DataFrame:
        """Upserts into a created collection and gives the points that do not fit it. Dates
        and times become ISO texts; points of a project's collection that name no project
        get its."""
        kinds = dict(points.dtypes)
        iso = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'" if k.startswith("timestamp") else "yyyy-MM-dd") for c, k in kinds.items() if k in ("timestamp", "timestamp_ntz", "date")}
        points = points.withColumns(iso) if iso else points
        if collection.startswith(PROJECT):
            own = F.lit(collection.removeprefix(PROJECT))
            points = points.withColumn("project_id", F.coalesce(F.nullif("project_id", F.lit("")), own) if "project_id" in kinds else own)
        return self.upsert(collection, points, self._of(collection)["size"])

    def nearest(self, collection: str, query: list[float], k: int = 10, threshold: float | None = None, where=None) -> DataFrame:  # noqa: ANN001
        """The k nearest points of a created collection by its own distance, with ``score``."""
        held = self._of(collection)
        if len(query) != held["size"]:
            raise ValueError(f"{collection} has vectors of {held['size']} components")
        return search(self.read(collection), query, k, held["distance"], threshold, where, "id", "vector")

    def drop(self, collection: str) -> None:
        """Removes a collection with its points and settings."""
        self.clear(collection)
        at, system = self._settings(collection)
        system.delete(at, True)

    def listed(self) -> DataFrame:
        """``collection, size, distance, points`` of every created collection, empty ones too."""
        made = self.settings()
        if not self._exists():
            return made.withColumn("points", F.lit(0).cast("long"))
        counts = self.read().groupBy("collection").agg(F.count("*").alias("points"))
        return made.join(counts, "collection", "left").withColumn("points", F.coalesce("points", F.lit(0).cast("long")))
