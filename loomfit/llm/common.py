"""What the operators of this folder share: words, scratch tables, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space only; ``bytes.split()`` splits at exactly these bytes.
WORD_RE = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the
    session; only where that is unset (tests), a temporary folder is set."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at is None:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            at = got.get()
        else:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            at = "file://" + tempfile.mkdtemp(prefix="loomfit-")
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str = "t", partition_by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage is cut and the
    shuffle files of the write are freed, so later stages start from whole rows."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/loomfit/{name}-{uuid.uuid4().hex}"
    old = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        out = df.write
        (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    finally:
        spark.conf.set(_CLEAN, old)
    tidy(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table._loomfit_path = path
    return table


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage once it fills a third of the heap. Plans, compiled
    classes and broadcasts of jobs that are over pile up there in a job of many tables,
    and Spark frees broadcasts and shuffles only after a collection (otherwise every
    half hour); a full one also gives memory back to the system."""
    vm = spark.sparkContext._jvm.java.lang
    heap = vm.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() > heap.maxMemory() // 3:
        vm.System.gc()


def discard(table: DataFrame) -> None:
    """Deletes a table that `written` made, once nothing will read it again."""
    spark = table.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._loomfit_path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def words(text) -> list[bytes]:
    """Words of a whole text (None: none)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def crc_mod(doc_id, m: int) -> int:
    """crc32 of the id as text, modulo m (a null id counts as empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def crc_mod_col(c: Column, m: int) -> Column:
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each id that has a link.

    links(a, b): undirected. Returns (id, component_id). Minimum labels spread
    along links and are shortened by following label to label, so paths need a
    logarithmic number of rounds; each round is a written table. Links and
    labels stay distributed; the driver only reads one count a round.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "links")
    label = table = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("l")), "labels")
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("id").alias("b"), "l"), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("m"))
        step = label.join(near, "id").select("id", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = label.select(F.col("id").alias("l"), F.col("l").alias("ll"))
        new = written(step.join(jump, "l", "left").select("id", "old", F.least("l", "ll").alias("l")), "labels")
        discard(table)
        table = new
        if new.where("l <> old").limit(1).count() == 0:
            discard(both)
            return new.select("id", F.col("l").alias("component_id"))
        label = new.select("id", "l")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Arrow batches of at most about `size` bytes, so that long texts don't fill the
    memory of JVM and worker at once; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now > size:
        spark.conf.set(key, str(size))


def lean(run):
    """A function for mapInArrow that gives freed memory back to the system at its
    end: workers are kept for later stages, and would keep it."""

    def out(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return out


def hashed_sample(df: DataFrame, most: int, *key: str, seed: int = 0) -> DataFrame:
    """The `most` rows of least hash of the key. Rows far above the cut go before the
    only sort, so one task sees about `most` rows, whatever the table's size."""
    n = df.count()
    h = F.xxhash64(F.lit(seed), *key)
    share = min(1.0, (1.5 * most + 1000) / max(n, 1))
    near = df if share >= 1 else df.where(h < F.lit(int(-(2**63) + share * 2**64)).cast("long"))
    return near.orderBy(h, *key).limit(most)


def top_levels(table: DataFrame, count: str, most: int) -> DataFrame:
    """Rows of the largest counts, by whole levels of (nearly) equal counts; of the
    level that does not fit, a share by hash, so that about `most` rows remain. No
    sort, and the driver sees one row a level (a few thousand)."""
    if most <= 0:
        return table.limit(0)
    c = F.col(count)
    level = F.when(c < 1000, c).otherwise(1000 + F.floor(F.log(c / 1000.0) * 100)).cast("int")
    held, cut, share = 0, -1, 1.0
    for r in sorted(table.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        if held >= most:
            break
        cut, share = r["level"], min(1.0, (most - held) / r["n"])
        held += r["n"]
    bucket = F.pmod(F.xxhash64(*table.columns), F.lit(1 << 20))
    return table.where((level > cut) | ((level == cut) & (bucket < F.lit(int(share * (1 << 20))))))


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

