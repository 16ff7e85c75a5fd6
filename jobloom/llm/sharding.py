"""Sharding: contiguous shards of near-equal bytes from global prefix sums.

Rows get a place in one global order, which is that of a hash of their group. The order is cut in parts, so that every part's size
is known from one aggregate of partial sums; a prefix sum over the parts (their number follows the rows, up to a bound) and a
running sum inside each part give every row its global byte offset, and the offset gives the shard. A group is not divided
unless it is a good part of a shard itself. Groups of many rows are few and have parts of their own, so that none is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, top_bits, utf8_bytes

#: Rows of a part, and parts at most (so many rows are broadcast: parts, and those of heavy groups).
PART_ROWS, MAX_PARTS = 4_096, 1 << 17
#: A group of more than this share of a shard may be divided. There are fewer than n_shards * HEAVY such groups.
HEAVY = 100
#: A group with the rows of so many parts has parts of its own, so there are at most MAX_PARTS / LARGE such groups.
LARGE = 2


def global_positions(df: DataFrame, group: Column, row: Column, order: list[Column], size: Column, n_shards: int) -> DataFrame:
    """Adds row_no (from 0), offset (bytes before the row), cut (the offset that decides on its shard) and total (all bytes).

    The order is: hash of `group`; in a group of many rows, hash bits of `row`; then `order`. `cut` is where the group begins, or
    the row's own offset in a group of many bytes. The largest part has few times the rows of the mean one.
    """
    x = df.withColumns({"_size": size.cast("long"), "_g": F.xxhash64(group)})
    groups = x.groupBy("_g").agg(F.sum("_size").alias("_gb"), F.count("*").alias("_gn"))
    whole = x.agg(F.count("*").alias("rows"), F.sum("_size").alias("total")).first()
    rows, total = whole.rows, whole.total or 1
    parts = min(MAX_PARTS, max(1, rows // PART_ROWS))
    bits = parts.bit_length()
    # groups of many bytes, which may be divided among shards, and those of many rows, which are only dealt to more tasks: few of either
    divided = F.col("_gb") * (n_shards * HEAVY) > total
    large = groups.where(divided | (F.col("_gn") * parts > LARGE * rows))
    # by the rows it has, in proportion to all parts; rows that repeat an id are told apart by where they stand in the input
    large = large.select(F.col("_g").alias("_hg"), divided.alias("_divided"), F.ceil(F.col("_gn") * parts / rows).cast("long").alias("_pieces"))
    x = x.join(F.broadcast(large), F.col("_g") == F.col("_hg"), "left")
    x = x.withColumns({"_part": top_bits(F.col("_g"), bits), "_piece": F.when(F.col("_hg").isNotNull(), F.pmod(F.xxhash64(row, F.lit(1), F.when(F.col("_pieces") > 1, F.monotonically_increasing_id())), F.col("_pieces")))}).drop("_pieces")
    part = ["_part", "_hg", "_piece"]  # in this order; rows of small groups have nulls and come first
    totals = x.groupBy(*part).agg(F.sum("_size").alias("_b"), F.count("*").alias("_n"))
    w = W.orderBy(*part).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*[F.col(c).alias(f"{c}0") for c in part], F.coalesce(F.sum("_b").over(w), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n0"))
    # where the group of the part begins; in one of several groups, where the part does
    starts = starts.withColumn("_g0", F.min("_b0").over(W.partitionBy("_part0", "_hg0")))
    inside = W.partitionBy(*part).orderBy("_g", *order)
    x = x.withColumns({"_rn": F.row_number().over(inside) - 1, "_run": F.sum("_size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("_size")})
    x = x.withColumn("_first", F.when(F.col("_hg").isNull(), F.first("_run").over(W.partitionBy(*part, "_g").orderBy(*order))))
    same = (F.col("_part") == F.col("_part0")) & F.col("_hg").eqNullSafe(F.col("_hg0")) & F.col("_piece").eqNullSafe(F.col("_piece0"))
    x = x.join(F.broadcast(starts), same)
    cut = F.when(F.col("_hg").isNull(), F.col("_b0") + F.col("_first")).when(F.col("_divided"), F.col("_b0") + F.col("_run")).otherwise(F.col("_g0"))
    x = x.withColumns({"row_no": F.col("_n0") + F.col("_rn"), "offset": F.col("_b0") + F.col("_run"), "cut": cut, "total": F.lit(total)})
    return x.drop(*part, *[f"{c}0" for c in part], "_g", "_rn", "_run", "_first", "_b0", "_n0", "_g0", "_divided")


def shard(df: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", size: Column | None = None) -> DataFrame:
    """Adds shard (0 to n_shards - 1) and slot (from 0 in each shard, without gaps); all rows and columns stay.

    A row's weight is `size`, by default its UTF-8 bytes plus 1 (1 for a null or empty text). Equal texts are a group, null
    and empty ones as well. The shard is the n-th part of all bytes in which the group starts, so a group stays whole; only a
    group of more than a hundredth of a shard may be divided, at most one at each of the n_shards - 1 cuts. So shards
    differ from the mean by less than that, or than the largest row. Null ids come first among
    equal texts; rows that agree in id and text are interchangeable. Columns of `df` named shard or slot are replaced. An
    empty table gives an empty result; shards that nothing starts in stay empty. `text_col` may name a digest of the text
    where the text itself need not be moved.
    """
    df = df.drop("shard", "slot")
    size = utf8_bytes(F.col(text_col)) + 1 if size is None else size
    mine = df.select(F.struct(*df.columns).alias("_doc"), size.alias("_w"))
    text, key = F.col(f"_doc.`{text_col}`"), F.col(f"_doc.`{id_col}`")
    group = F.coalesce(text, F.lit("")) if dict(df.dtypes)[text_col] == "string" else text
    placed = global_positions(mine, group, key, [key.asc_nulls_first()], F.col("_w"), n_shards)
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"cut * {n_shards} div total")).cast("int"))
    first = placed.groupBy("shard").agg(F.min("row_no").alias("_first"))  # n_shards rows
    out = placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("row_no") - F.col("_first"))
    return out.select(*[F.col(f"_doc.`{c}`") for c in df.columns], "shard", "slot")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes."""
    text = F.coalesce("text", F.lit(""))
    # the digest needs no text after the scan: some 40 bytes a row are moved
    d = table(spark, sf_dir, "documents").select("doc_id", (utf8_bytes(F.col("text")) + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    out = shard(d, 16, "doc_id", "text_hash", F.col("size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_sharding": op6_sharding}
ORACLE_SQL: dict[str, str] = {}
