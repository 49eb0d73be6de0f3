"""What the operators of this folder share: written intermediate tables, running totals, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may run without that setting; it then gets a temporary folder.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault(context.applicationId, tempfile.mkdtemp(prefix="spark-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes an execution's shuffle files at its end, not at the driver's next garbage collection.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    The table takes the place of the shuffles that made it, so their files go as soon as it is written.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that written() made and nothing needs any more."""
    root = shared_folder(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = hadoop.Path(folder)
        if root.removeprefix("file://") in folder:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_all(*tables: DataFrame) -> None:
    """Delete written tables that only other written tables were made from."""
    for df in tables:
        drop_written(df.sparkSession, df)


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same (non-null) keys that come earlier in ``order``.

    Rows are range-partitioned by keys and order and written, so a hot key spreads over many
    partitions; each partition's totals give the offsets of the later ones. Rows that tie in the
    whole order share it arbitrarily.
    """
    part, at = "__part", "__at"
    cut = written(
        df.repartitionByRange(*[F.col(k) for k in keys], *order)
        .sortWithinPartitions(*[F.col(k) for k in keys], *order)
        .withColumn(part, F.spark_partition_id())
        .withColumn(at, F.monotonically_increasing_id()),
        "running",
    )
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, part)
        .agg(F.sum(value).alias("__sum"))
        .select(*keys, part, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    )
    inside = Window.partitionBy(*keys, part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(offsets, [*keys, part])
        .withColumn(out, F.col("__offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop(part, at, "__offset")
    )


#: A key is hot if it holds more than this share of all rows, and more rows than a task takes easily; so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE, HOT_ROWS = 1e-5, 1000


def split_hot(rows: DataFrame, counted: DataFrame, key: str, count: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equality join on ``key`` with a further key column slice, so that no hot key lies in one task.

    ``counted``: one row for each key, with its number of rows in ``count``. Rows of a hot key are
    dealt over ``slices`` slices by their other columns, and its row in ``counted`` is repeated for
    each. There are at most 1 / HOT_SHARE hot keys, so their list may be broadcast.
    """
    total = counted.agg(F.sum(count)).first()[0] or 0
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    slices = F.ceil(F.col(count) / F.lit(float(least))).cast("int")
    hot = F.broadcast(counted.where(F.col(count) > least).select(key, slices.alias("slices")))
    others = [c for c in rows.columns if c != key]
    spread = rows.join(hot, key, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    spread = spread.withColumn("slice", F.pmod(F.xxhash64(*others), F.col("slices")).cast("int"))
    dealt = F.when(F.col(count) > least, slices).otherwise(1)
    return spread, counted.withColumn("slice", F.explode(F.sequence(F.lit(0), dealt - 1)))


# --- words and hashes, inside tasks -------------------------------------------------------------

#: Lower-cases A-Z and turns every other ASCII character that is no letter or digit into a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SEEDED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEEDED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_POWER = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWER["up"]) < n:
        m = max(n, 1 << 18)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _POWER[key] = np.multiply.accumulate(steps)
    return _POWER["up"][:n], _POWER["down"][:n]


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode().translate(_PLAIN).split()


class Words:
    """Words of several texts: 64-bit hashes, and the number of the text that each belongs to."""

    def __init__(self, texts: list[bytes]) -> None:
        data = b" ".join(texts).translate(_PLAIN)
        raw = np.frombuffer(data, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], raw != 32, [False])).astype(np.int8)))
        start, end = edges[0::2], edges[1::2]
        up, down = _powers(len(raw) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)))
        self.hashes = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        #: Words of text i are those from bounds[i] up to bounds[i + 1].
        self.bounds = np.searchsorted(start, begins)

    def grams(self, k: int) -> np.ndarray:
        """Rolling hash of the k words from each place on; those that leave their text are to be cut off."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = self.hashes[:n].copy()
        for j in range(1, k):
            out = out * _STEP + self.hashes[j : j + n]
        return mixed(out)
