"""Session helpers: the shared folder, tables that cut lineage, and their removal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "mosaiq", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; further settings as ``key=value``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where it is unset (tests, local mode) a temporary folder is made and set, once per session.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.mosaiq.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.mosaiq.shared.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/mosaiq/{name}-{uuid.uuid4().hex[:12]}"


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system and Path object of a path."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that new_path named. Other paths are refused."""
    for path in paths:
        if not path.startswith(f"{shared_dir(spark)}/mosaiq/"):
            raise ValueError(f"not a table of this library: {path}")
        fs, p = filesystem(spark, path)
        fs.delete(p, True)


class Scratch:
    """Written tables of one operator run.

    ``put`` writes a DataFrame and reads it back, which cuts its lineage in a way that outlives the loss of
    executors. ``drop`` removes tables that are no longer read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, f"{self.name}-{name}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._keep = [*getattr(self, "_keep", []), out]  # ids stay unique while the frames live
        return out

    def path(self, df: DataFrame) -> str:
        return self.paths[id(df)]

    def drop(self, *dfs: DataFrame | None) -> None:
        for df in dfs:
            if df is not None and id(df) in self.paths:
                remove(self.spark, self.paths.pop(id(df)))


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """As many partitions as hold ``rows`` at ``per_partition`` each, and at least the shuffle default."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clashless(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the input can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])
