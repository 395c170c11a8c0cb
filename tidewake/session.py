"""Session defaults and the one place that reads cluster folders from the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "tidewake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC, AQE, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session names none (unit tests, a laptop) a local one is set; on a
    cluster the setting must name shared storage, so a missing one is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tidewake-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def table_stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of change of a table's files, to see whether it changed."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


class Stage:
    """Cuts lineage by writing tables into the shared folder and reading them back.

    A written table survives the loss of any executor, is columnar, and gives the
    optimizer its true size. ``drop`` removes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.base = f"{shared_folder(spark)}/tidewake-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}

    def place(self) -> str:
        """A new path in the shared folder, for a table that is written some other way."""
        if not self.count:  # the folder goes when the application ends
            self._files(self.base, lambda fs, where: fs.mkdirs(where) and fs.deleteOnExit(where))
        self.count += 1
        return f"{self.base}/{self.count}"

    def cut(self, df: DataFrame) -> DataFrame:
        path = self.place()
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def cut_counting(self, df: DataFrame, flag: str) -> tuple[DataFrame, int]:
        """``cut``, with the number of rows whose ``flag`` is true, counted by the same job."""
        seen = Observation()
        out = self.cut(df.observe(seen, F.count_if(flag).alias("n")))
        return out, seen.get["n"]

    def drop(self, *frames: DataFrame | None) -> None:
        for frame in frames:
            path = self.paths.pop(id(frame), None)
            if path:
                self._files(path, lambda fs, where: fs.delete(where, True))

    def there(self) -> bool:
        """Whether the written tables that weren't dropped still exist."""
        return all(self._files(path, lambda fs, where: fs.exists(where)) for path in self.paths.values())

    def _files(self, path: str, do):
        context = self.spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        return do(where.getFileSystem(context._jsc.hadoopConfiguration()), where)
