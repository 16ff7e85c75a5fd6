"""Shared pieces: tables, scratch tables in the cluster's shared folder, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most this many narrow rows.
BROADCAST_ROWS = 200_000
#: Whether a query's shuffle files are deleted when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a local one only where the session runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="jobloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Scratch:
    """Written tables of one job. A table cuts the lineage, and a lost executor costs none of it.

    With `tidy`, the shuffle files of a table go when it is written, not when the driver next collects its garbage.
    """

    def __init__(self, spark: SparkSession, job: str, tidy: bool = False, codec: str = "snappy"):
        self.spark, self.tidy, self.codec, self.root = spark, tidy, codec, f"{shared_dir(spark)}/jobloom-{job}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with self.tidied():
            df.write.parquet(path, compression=self.codec)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def save_dealt(self, parts: Iterable[DataFrame], name: str, by: str, buckets: int) -> DataFrame:
        """A table of the rows of some frames in buckets by a column, on which joins read it without a shuffle; the session's catalog has it until `drop`."""
        path = self.path(name)
        known = f"{self.root.rsplit('/', 1)[-1]}_{self.n:03d}".replace("-", "_")
        with self.tidied():
            for df in parts:
                df.write.format("parquet").option("path", path).option("compression", self.codec).bucketBy(buckets, by).mode("append").saveAsTable(known)
        out = self.spark.table(known)
        out.scratch_path, out.scratch_table = path, known
        return out

    @contextmanager
    def tidied(self) -> Iterator[None]:
        before = self.spark.conf.get(SHUFFLE_CLEANUP, "false")
        if self.tidy:
            self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            yield
        finally:
            if self.tidy:
                self.spark.conf.set(SHUFFLE_CLEANUP, before)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that nothing reads any more."""
        if known := getattr(df, "scratch_table", None):
            self.spark.sql(f"DROP TABLE IF EXISTS {known}")
        delete(self.spark, df.scratch_path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the counted rows stay under the bound, else the plain frame."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def top_bits(h: Column, bits: int) -> Column:
    """The first bits of a 64-bit hash as an unsigned number: buckets in hash order."""
    return F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(1 << 63))), 64 - bits).cast("long")


_P = 0x9E3779B97F4A7C15 | 1


def fmix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as the longest piece has asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            cls.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _P, np.uint64))])
            cls.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, pow(_P, -1, 1 << 64), np.uint64))])
        return cls.up, cls.down


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (node, component), component the smallest node.

    Alternating large-star and small-star steps. Each step groups by node with map-side minima and joins back on the
    node, so that a hub costs one row per edge and is split by the skew join; no group is gathered anywhere.
    """
    e = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:  # each round moves nodes to smaller ones, so it ends; after some log(n) rounds
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        nxt = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = scratch.save(nxt, "small")
        scratch.drop(large)
        before, after = (x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first() for x in (e, nxt))
        scratch.drop(e)
        e = nxt
        if before == after:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
