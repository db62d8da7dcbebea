"""Session and table helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidewatch")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; in local mode, where
    there is one machine, a temporary one stands in."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not (sc.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """``df``, written once as Parquet into the shared folder and read back: what several steps read is computed
    once, and a lost executor costs no recomputation of what came before."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``df`` with each row's place (from 0) in the order of some columns: sorted by ranges and stored; a range
    begins where those before it end. Rows that are equal in ``order`` are numbered in any order."""
    at = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "numbered")
    sizes = at.groupBy(F.shiftright(name, 33).alias("_range")).agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first"))
    out = at.join(F.broadcast(begins), F.shiftright(name, 33) == F.col("_range"))  # a row a range
    return out.withColumn(name, F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_first")).select(at.columns)


def tasks(spark: SparkSession) -> int:
    """How many tasks costly rows are dealt to: few rows of much work would be merged into one otherwise."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
