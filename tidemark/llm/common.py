"""Helpers shared by the training-data operators.

Intermediate tables go to the folder named by ``spark.checkpoint.dir`` (shared
by driver and executors); a temporary folder is used only in local mode, where that
setting is absent.
"""

from __future__ import annotations

import tempfile
import time
import uuid

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Words of 64 bits in a bitmap: 8 MB, whatever the input.
BITMAP_WORDS = 1 << 20
#: Keys up to which a bitmap tells much (two bits each); beyond, callers join.
BITMAP_KEYS = 1 << 23
#: Rows up to which a table of short rows is broadcast.
SMALL = 10_000
#: Seconds between two times that the driver gives freed memory back.
RELIEVE_S = 10.0
_relieved = -RELIEVE_S


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can read and write."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    relieve(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a settled table that nothing reads any more."""
    path = getattr(df, "_settled_at", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove every intermediate table of this library from the shared folder."""
    remove(spark, f"{shared_dir(spark)}/tidemark")


def bound_batches(spark: SparkSession) -> None:
    """Texts are long rows: send fewer of them to Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def tidy() -> None:
    """Give the freed memory of a Python worker, which is used again, back."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def relieve(spark: SparkSession) -> None:
    """Give the freed memory of the driver, Python and JVM, back, at most every
    RELIEVE_S seconds.  A query is many jobs on one driver; what plans, broadcasts and
    collected rows leave behind otherwise stays with the process as free heap, and
    blocks of broadcasts that nothing refers to stay until some collection."""
    global _relieved
    if time.monotonic() < _relieved + RELIEVE_S:
        return
    tidy()  # first, as Python's references keep Java objects
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = jvm.java.lang.Class.forName

    def managed(bean: str, method: str, *args: str) -> str:
        """Call a method of strings of a management bean, by its public interface."""
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        values, names = gateway.new_array(jvm.java.lang.Object, len(args)), gateway.new_array(jvm.java.lang.String, len(args))
        for k, x in enumerate(args):
            values[k], names[k] = x, "java.lang.String"
        types = [jvm.javax.management.ObjectName(bean).getClass(), kind("java.lang.String"), values.getClass(), names.getClass()]
        call = gateway.new_array(jvm.java.lang.Class, 4)
        given = gateway.new_array(jvm.java.lang.Object, 4)
        for k, x in enumerate((jvm.javax.management.ObjectName(bean), method, values, names)):
            call[k], given[k] = types[k], x
        return kind("javax.management.MBeanServer").getMethod("invoke", call).invoke(server, given)

    hotspot = "com.sun.management:type=HotSpotDiagnostic"
    options = {"MinHeapFreeRatio": "10", "MaxHeapFreeRatio": "30"}  # for this collection
    before: dict[str, str] = {}
    try:
        for name, value in options.items():
            before[name] = str(managed(hotspot, "getVMOption", name).get("value"))
            managed(hotspot, "setVMOption", name, value)
        jvm.System.gc()
        for name in reversed(options):
            managed(hotspot, "setVMOption", name, before.pop(name))
        managed("com.sun.management:type=DiagnosticCommand", "systemTrimNativeHeap")
    except Py4JError:  # another JVM: it has no such options or commands
        for name in reversed(before):
            try:
                managed(hotspot, "setVMOption", name, before[name])
            except Py4JError:
                pass
    _relieved = time.monotonic()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def bitmap(df: DataFrame, hashed: str) -> np.ndarray:
    """Two bits for each value of a column of hashes."""
    bit = lambda word, bits: F.struct(F.expr(f"cast({word} & {BITMAP_WORDS - 1} as int)").alias("word"), F.expr(f"shiftleft(1L, cast({bits} & 63 as int))").alias("bit"))
    both = F.array(bit(hashed, f"shiftrightunsigned({hashed}, 32)"), bit(f"shiftrightunsigned({hashed}, 40)", f"shiftrightunsigned({hashed}, 20)"))
    rows = df.select(F.inline(both)).groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()  # at most BITMAP_WORDS rows
    out = np.zeros(BITMAP_WORDS, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    h, mask, one = hashed.view(np.uint64), np.uint64(BITMAP_WORDS - 1), np.uint64(1)
    first = bits[h & mask] >> (h >> np.uint64(32) & np.uint64(63)) & one
    return (first & bits[h >> np.uint64(40) & mask] >> (h >> np.uint64(20) & np.uint64(63))).astype(bool)


def rows_in(df: DataFrame, hashed: Column, bits: np.ndarray, inside: bool = True) -> DataFrame:
    """Rows whose hash is (not) in the bitmap; only the hashes go through Python."""
    sent = df.sparkSession.sparkContext.broadcast(bits)  # BITMAP_WORDS numbers

    @F.pandas_udf("boolean")
    def keep(h):
        import pandas as pd

        return pd.Series(in_bitmap(sent.value, h.to_numpy(np.int64)) == inside)

    return df.where(keep(hashed))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that few rows of ``df`` have: a bitmap drops most of the
    others before anything is shuffled, up to BITMAP_KEYS ids."""
    if ids.count() > BITMAP_KEYS:
        return df.join(ids, key)
    bits = bitmap(ids.select(F.xxhash64(key).alias("_h")), "_h")
    return rows_in(df, F.xxhash64(key), bits).join(ids, key)


def drop_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``ids`` (nulls stay); only those that the bitmap
    cannot clear are joined."""
    if ids.count() > BITMAP_KEYS:
        return df.join(ids.select(key).distinct(), key, "left_anti").select(*df.columns)
    bits = bitmap(ids.select(F.xxhash64(key).alias("_h")), "_h")
    clear = rows_in(df, F.xxhash64(key), bits, False)
    rest = rows_in(df, F.xxhash64(key), bits).join(ids.select(key).distinct(), key, "left_anti")
    return clear.unionByName(rest.select(*df.columns))


def sample(df: DataFrame, limit: int, *, by: str | None = None, least: int = 0) -> DataFrame:
    """Distinct rows by the hash of all their columns, about ``limit`` of them; with
    ``by``, in proportion but at least ``least`` of each of its values (or all that
    there are).  The same rows whatever the order or the partitions."""
    cells = 1 << 30
    name = fresh(df, "_hash")
    keyed = df.withColumn(name, F.xxhash64(*df.columns))
    dealt = F.pmod(F.xxhash64(name, F.lit(1)), F.lit(cells))
    if by is None:
        total = df.count()
        chosen = keyed.where(dealt < int(cells * min(1.0, limit / max(1, total))))
    else:
        counts = settle(df.groupBy(by).agg(F.count("*").alias("_n")), "sample-counts")
        total, values = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")).first()
        quota = F.greatest(F.lit(limit / max(1, total)), F.lit(float(least)) / F.col("_n"))
        quotas = counts.withColumn("_quota", quota * cells).drop("_n")
        chosen = keyed.join(F.broadcast(quotas) if values <= SMALL else quotas, by).where(dealt < F.col("_quota"))
    return chosen.groupBy(name).agg(*(F.first(c).alias(c) for c in df.columns))


