"""Reading tables, cutting lineage, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder[len("file://"):], True)
    return folder.rstrip("/")


#: Tables estimated larger than this are not broadcast. Estimates of written tables are of compressed files, which unfold to
#: about ten times as much in memory.
MAX_BROADCAST_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need no path to it of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerloom_shipped", False):
        return
    package = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="ledgerloom-package-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/{package.name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(f"{folder}/{package.name}.zip")
    sc._ledgerloom_shipped = True


_SCRATCH: dict[str, SparkSession] = {}


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A new folder of our own in the shared one, removed when the application ends: results read from it until then."""
    if not _SCRATCH:
        atexit.register(_sweep)
    folder = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _SCRATCH[folder] = spark
    return folder


def _sweep() -> None:
    for folder, spark in _SCRATCH.items():
        try:
            jvm = spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001, S112  the session may have been stopped before
            continue


class Stash:
    """Tables written to the shared folder to cut lineage; ``drop`` removes those no longer read, the end of the application all.

    Unlike ``DataFrame.checkpoint`` the files are columnar and compressed, so a later step reads only its columns,
    and they outlive lost executors.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = scratch_folder(spark, "stash")
        self.count = 0

    def put(self, df: DataFrame, *partition_by: str) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path) if not partition_by else self.spark.read.parquet(path)
        out._stash_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_stash_path", None)
        if path:
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate: an upper bound of the stored size for scans, filters and projections of written tables."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16, how: str = "left") -> DataFrame:
    """Join a large left side whose keys may be hot with a right side of one row per key.

    The right side is repeated once per salt, so a key with a third of the left rows is spread over ``salts`` tasks.
    A right side within the size bound is broadcast instead.
    """
    if estimated_bytes(right) <= MAX_BROADCAST_BYTES:
        return left.join(F.broadcast(right), key, how)
    salt = "__salt"
    others = [F.col(f"`{c}`") for c in left.columns if c != key]
    spread = left.withColumn(salt, F.pmod(F.xxhash64(*(others or [F.col(key)])), F.lit(salts)).cast("int"))
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [key, salt], how).drop(salt)


def pairs_within(rows: DataFrame, group: str, member: str, keep: list[str] | None = None, block: int = 512) -> DataFrame:
    """``(member_a, member_b)``, the smaller first, of all different members of each group, with ``keep`` of both sides.

    A group of more than ``block`` rows is cut into blocks by hash, and each pair of blocks is a task's key of its own, so no
    task pairs out a hot group. Every pair comes out once for each pair of its rows.
    """
    keep = keep or []
    cut = rows.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("__n")).where("__n > 1")
    sized = rows.join(cut, group, "left").withColumn("__n", F.coalesce("__n", F.lit(1))).withColumn("__b", F.pmod(F.xxhash64(member), F.col("__n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__n") - 1))
    side = lambda df, p, i, j: df.select(group, F.col(i).alias("__i"), F.col(j).alias("__j"), *[F.col(c).alias(f"{c}_{p}") for c in (member, *keep)])
    spread = sized.withColumn("__o", every)
    return side(spread, "a", "__b", "__o").join(side(spread, "b", "__o", "__b"), [group, "__i", "__j"]).where(f"{member}_a < {member}_b").drop("__i", "__j")
