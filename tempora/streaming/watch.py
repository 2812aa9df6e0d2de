"""The library's watcher as Structured Streaming: file events, debounced folders, settled files and a job table.

Job tables are versioned folders of Parquet below one path; a batch writes the next version and then its marker, so a
batch that is run again after a failure finds its own epoch and does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from tempora.operators.catalog import SUBTITLE_SUFFIXES, upsert

JOBS = "video_path string, srt_path string, status string, attempts int, srt_mtime double, version long"


def file_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of path, dir, modified, size of subtitles below folder, without their content."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    return raw.where(suffix.isin(*SUBTITLE_SUFFIXES)).select("path", F.regexp_extract("path", "^(.*)/", 1).alias("dir"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def settled(events: DataFrame, age_s: int = 30, ahead_s: int = 60) -> DataFrame:
    """Files that nothing has touched for a while; those of a clock that runs ahead count as settled as well."""
    age = F.unix_seconds(F.current_timestamp()) - F.unix_seconds("modified")
    return events.where((F.col("size") > 0) & ((age > age_s) | (age < -ahead_s)))


def debounced(events: DataFrame, gap: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """A row for each burst of events of a folder: dir, n, first, last. State is bounded by the watermark."""
    w = events.withWatermark("modified", late).groupBy("dir", F.session_window("modified", gap).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n")).select("dir", "n", F.col("w.start").alias("first"), F.col("w.end").alias("last"))


class JobTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path

    def epochs(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path(self.path))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        known = self.epochs()
        return self.spark.read.schema(JOBS).parquet(f"{self.path}/v{known[-1]}") if known else self.spark.createDataFrame([], JOBS)

    def upsert(self, batch: DataFrame, epoch: int) -> None:
        known = self.epochs()
        if known and known[-1] >= epoch:
            return
        new = batch.select("video_path", "srt_path", "status", "attempts", "srt_mtime", F.lit(epoch).cast("long").alias("version"))
        upsert(self.read(), new, ["video_path", "srt_path"], "srt_mtime").write.mode("overwrite").parquet(f"{self.path}/v{epoch}")
        fs, path = self._fs()
        for old in known[:-1]:  # the version before stays, for readers that are at it
            fs.delete(path(f"{self.path}/v{old}"), True)


def record_jobs(events: DataFrame, jobs: JobTable, checkpoint: str) -> DataStreamWriter:
    """A writer that queues a job for each settled file; start() it, with an availableNow trigger for one full pass."""

    def batch(df: DataFrame, epoch: int) -> None:
        queued = df.dropDuplicates(["path"]).select(F.regexp_replace("path", r"\.[A-Za-z0-9]+$", ".mkv").alias("video_path"), F.col("path").alias("srt_path"), F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.unix_seconds("modified").cast("double").alias("srt_mtime"))
        jobs.upsert(queued, epoch)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


class Watcher:
    """A standing query over file events that can pause and go on from where it was; a paused one stays so for whoever looks, by a marker beside the checkpoint."""

    def __init__(self, events: DataFrame, jobs: JobTable, checkpoint: str, every: str = "10 seconds"):
        self.events, self.jobs, self.checkpoint, self.every, self.query = events, jobs, checkpoint.rstrip("/"), every, None

    def _marker(self):
        jvm, conf = self.jobs.spark.sparkContext._jvm, self.jobs.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(f"{self.checkpoint}-paused")
        return where.getFileSystem(conf), where

    @property
    def paused(self) -> bool:
        fs, where = self._marker()
        return fs.exists(where)

    def start(self) -> None:
        if not self.paused and (self.query is None or not self.query.isActive):
            self.query = record_jobs(self.events, self.jobs, self.checkpoint).trigger(processingTime=self.every).start()

    def pause(self) -> None:
        fs, where = self._marker()
        fs.create(where, True).close()
        if self.query is not None:
            self.query.stop()

    def resume(self) -> None:
        fs, where = self._marker()
        fs.delete(where, False)
        self.start()


def rescan(events: DataFrame, jobs: JobTable, checkpoint: str) -> StreamingQuery:
    """All that is there now, once; later calls go on from the checkpoint."""
    query = record_jobs(events, jobs, checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
