"""Saved files with their history: every save is a version of its own, the first one is the backup, and undo brings it back.

Versions are folders of Parquet below one path. The committer writes a folder's success marker last, so a save is there as a
whole or not at all, and none overwrites another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILES = "path string, text string, version long"


def latest(saves: DataFrame) -> DataFrame:
    """path, text, version: the last save of each file."""
    w = Window.partitionBy("path").orderBy(F.desc("version"))
    return saves.withColumn("k_", F.row_number().over(w)).where("k_ = 1").drop("k_")


def backup(saves: DataFrame) -> DataFrame:
    """path, text, version: each file as it was before it was first changed."""
    w = Window.partitionBy("path").orderBy("version")
    return saves.withColumn("k_", F.row_number().over(w)).where("k_ = 1").drop("k_")


def undone(saves: DataFrame, paths: DataFrame) -> DataFrame:
    """path, text: what an undo of the given paths saves anew; files that nothing has changed are left out."""
    return backup(saves).alias("b").join(latest(saves).alias("l"), "path").join(paths.select("path").distinct(), "path", "left_semi").where("b.version < l.version").select("path", "b.text")


class FileStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self) -> list[int]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(conf)
        if not fs.exists(path(self.folder)):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path(self.folder))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and fs.exists(path(f"{self.folder}/{n}/_SUCCESS")))

    def saves(self) -> DataFrame:
        known = self._versions()
        return self.spark.read.schema(FILES).parquet(*[f"{self.folder}/v{v}" for v in known]) if known else self.spark.createDataFrame([], FILES)

    def save(self, files: DataFrame) -> int:
        """path, text as the next version."""
        version = (self._versions() or [0])[-1] + 1
        files.select("path", "text", F.lit(version).cast("long").alias("version")).write.parquet(f"{self.folder}/v{version}")
        return version

    def current(self) -> DataFrame:
        return latest(self.saves())

    def undo(self, paths: DataFrame) -> int:
        return self.save(undone(self.saves(), paths))
