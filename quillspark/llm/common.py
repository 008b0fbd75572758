"""What the corpus operators share: scratch tables, column handling, word and byte helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of all contracts: space and the control characters tab to carriage return.
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = os.environ.get("QUILLSPARK_SCRATCH")
        if not base:
            base = tempfile.mkdtemp(prefix="quillspark-")
            os.environ["QUILLSPARK_SCRATCH"] = base
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. Hadoop deletes it when the application ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path whose readers are done."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes the frame to the shared folder and reads it back: lineage is cut, and a lost executor costs a file read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) for jobs that run inside, and as they were after."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def give_back() -> None:
    """Returns a worker's freed memory to the system, as far as its C library can: workers outlive tasks."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def bitmap(keys: DataFrame, most_words: int = 1 << 20) -> np.ndarray:
    """A set of hashes (column ``h``, long) as 64-bit words: some 16 bits a key, 8 MB at most whatever their number. Those not
    in the set pass ``in_bitmap`` the more often the fuller it is, so it only saves work."""
    n = keys.count()
    words = min(1 << max(12, (n // 4).bit_length()), most_words)
    bits = keys.select(F.shiftright("h", 6).bitwiseAND(F.lit(words - 1)).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return ((bits[(h >> 6) & (len(bits) - 1)] >> (h & 63)) & 1).astype(bool)


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows to all cores if the scan has fewer partitions than there are cores (one small file, say)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


def schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([field(k, v) for k, v in kinds.items()])


LONG, INT, STR, BIN, DBL, BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType(), T.DoubleType(), T.BooleanType()


def text_or_empty(name: str = "text") -> F.Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(data: bytes) -> bytes:
    """A-Z to a-z and nothing else: bytes.lower() knows ASCII only."""
    return data.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> F.Column:
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame hasn't, whatever the case."""
    have = {c.lower() for c in df.columns}
    while stem.lower() in have:
        stem += "_"
    return stem
