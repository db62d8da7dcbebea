"""What the corpus operators share: durable tables, word hashing, row keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The contract's word separators: space and \x09-\x0D. ``bytes.split()`` splits on exactly these.
MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only in local mode, where there
    is one machine, a temporary one stands in; elsewhere a session without such a folder is refused."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not (sc.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def durable(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, and a
    lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, buckets: int, name: str = "t") -> DataFrame:
    """``durable``, bucketed by a column: what is grouped or joined by it reads the table in place. The
    table's name is dropped from the catalogue at once; its files stay with the others of the run."""
    spark = df.sparkSession
    name = f"tidewatch_{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, by).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def numbered(df: DataFrame, order: list, name: str, table: str = "numbered") -> DataFrame:
    """``df`` with each row's place (from 0) in the global order, as column ``name``: sorted by ranges and
    written; the ranges' sizes, one row for each, give every range its offset."""
    at = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), table)
    part, before = free_name(at.columns, "_part"), free_name(at.columns, "_before")
    ranges = at.groupBy(F.shiftright(name, 33).alias(part)).agg(F.count("*").alias(before))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(part, F.coalesce(F.sum(before).over(ahead), F.lit(0)).alias(before))
    placed = at.join(F.broadcast(offsets), F.shiftright(name, 33) == F.col(part))  # one row for each range
    return placed.withColumn(name, F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + F.col(before)).select(at.columns)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``durable`` or ``bucketed`` wrote, once nothing will read it again."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores added as make it unlike all of ``columns`` (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns of these names (case aside): an operator's own columns take their place."""
    gone = {n.lower() for n in names}
    return df.select([df[f"`{c}`"] for c in df.columns if c.lower() not in gone])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fewer(df: DataFrame, tasks: int) -> DataFrame:
    """``df`` in no more than ``tasks`` tasks (two for each core at least): a small table leaves most shuffle
    partitions of a large session empty, and several are then read by one task. Nothing is moved; a table
    with work for all partitions stays as it is dealt."""
    spark = df.sparkSession
    tasks = max(tasks, 2 * spark.sparkContext.defaultParallelism)
    return df.coalesce(tasks) if tasks < partitions(spark) else df


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text, unchanged."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """The same, with A-Z alone lowered (``bytes.lower`` leaves other letters)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: Bytes of rows that go to Python at once, see ``lean_batches``.
BATCH_BYTES = 4 << 20


def lean_batches(spark: SparkSession) -> None:
    """From now on this session sends rows to Python in batches of about ``BATCH_BYTES`` at most: long texts would
    else make some of 64 MB, which an executor and its workers hold several times. A bound that the session has
    been given stays; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def release_memory() -> None:
    """Give freed memory, Arrow's too, back to the system, where libc can: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def summed_matrix(rows: DataFrame, make: Callable[[pd.DataFrame], np.ndarray], width: int, meet: int = 8) -> np.ndarray:
    """The sum of ``make(batch)``, a width x width matrix, over all batches of all partitions. Each task
    sums its own, ``meet`` tasks add these up, and the driver adds what is left: meet * width squared numbers."""

    def out(total):
        return pd.DataFrame({"i": np.arange(width), "v": list(total)})

    def own(batches):
        total = np.zeros((width, width))
        for pdf in batches:
            if len(pdf):
                total += make(pdf)
        yield out(total)

    def add(batches):
        total = np.zeros((width, width))
        for pdf in batches:
            if len(pdf):
                np.add.at(total, pdf.i.to_numpy(), np.stack(pdf.v.to_numpy()))
        yield out(total)

    schema = "i int, v array<double>"
    total = np.zeros((width, width))
    for r in rows.mapInPandas(own, schema).repartition(meet).mapInPandas(add, schema).collect():
        total[r.i] += r.v
    return total


class WordHashes(dict):
    """word -> 64-bit hash, remembered; emptied when it has grown past ``bound`` words."""

    def __init__(self, bound: int = 200_000):
        self.bound = bound

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values (splitmix64's)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_ODD = (np.random.default_rng(20240611).integers(1, 1 << 62, 64, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words, from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out += h[i : i + n] * _ODD[i]
    return mix64(out)


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """Rows with equal id and text are one thing; rows that share an id but not the text are not."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull(), F.col(id_col).isNull())


def once(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeats of one row, by id and text, once; rows without id all stay. Only repeats are
    moved: texts without any are read in place."""
    key = free_name(docs.columns, "_key")
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    many = durable(keyed.where(F.col(id_col).isNotNull()).groupBy(id_col, key).agg(F.count("*").alias("rows")).where("rows > 1").select(id_col, key), "repeated")
    if many.isEmpty():
        return docs
    return keyed.join(many, [id_col, key], "left_anti").unionByName(keyed.join(many, [id_col, key], "left_semi").dropDuplicates([id_col, key])).select(docs.columns)
