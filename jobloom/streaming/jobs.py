"""Streaming jobs. Each shares its DataFrame code with the batch side and runs with trigger(availableNow=True) in tests."""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from jobloom.operators.load import replace_by_key


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A file stream in name order; `path` holds Parquet files that arrive over time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def event_time(df: DataFrame, column: str) -> DataFrame:
    """A watermark needs a timestamp with time zone: naive times are read as UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def stream_daily_first(src: DataFrame, key: str, ts: str, delay: str = "2 days") -> DataFrame:
    """The first record that arrives for each (key, day); records later than the watermark are dropped.

    State is one row a (key, day) until the watermark passes the day.
    """
    x = event_time(src, ts).withWatermark(ts, delay)
    return x.withColumn("day", F.to_date(ts)).dropDuplicatesWithinWatermark([key, "day"])


def stream_daily_counts(src: DataFrame, ts: str, delay: str = "2 days") -> DataFrame:
    """Records of each day window; a day is told when the watermark has passed it."""
    x = event_time(src, ts).withWatermark(ts, delay)
    return x.groupBy(F.window(ts, "1 day")).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "n")


def stream_dedupe(src: DataFrame, keys: list[str], ts: str, ttl: str = "14 days") -> DataFrame:
    """The first record that arrives for each key; a key is forgotten when the watermark is `ttl` past it."""
    return event_time(src, ts).withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def stream_net_changes(log: DataFrame) -> DataFrame:
    """Running net change of each entity: the batch function on a stream, in update or complete mode."""
    from jobloom.operators.stats import net_changes

    return net_changes(log)


#: Parts that a keyed table is kept in; a batch rewrites the parts of its keys alone.
PARTS = 64


def _hadoop(spark: SparkSession, path: str):
    """(file system of a path, class of paths)."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    return jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.Path


def _newest(spark: SparkSession, store: str, before: int | None = None) -> dict[int, str]:
    """Each part's newest folder of a whole version (below `before`, if given)."""
    fs, path = _hadoop(spark, store)
    if not fs.exists(path(store)):
        return {}
    number = lambda p: int(p.getName().split("=")[1])
    versions = [v.getPath() for v in fs.listStatus(path(store)) if v.getPath().getName().startswith("version=")]
    whole = sorted((v for v in versions if fs.exists(path(v, "_SUCCESS")) and (before is None or number(v) < before)), key=number)
    return {number(p.getPath()): p.getPath().toString() for v in whole for p in fs.listStatus(v) if p.isDirectory()}


def part_of(key: str) -> Column:
    """The part of a keyed table that a key is in."""
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def merge_batch(rows: DataFrame, store: str, key: str, batch_id: int) -> None:
    """Replaces the batch's keys in a keyed table: the parts that hold them are written anew as version `batch_id`.

    A batch that runs again starts from the versions before it and writes the same. What a part's last but one version held is
    deleted, as no batch that runs again reads it. A batch of no rows writes nothing.
    """
    spark = rows.sparkSession
    touched = [r.part for r in rows.select(part_of(key).alias("part")).distinct().collect()]  # PARTS at most
    if not touched:
        return
    known = _newest(spark, store, batch_id)
    old = [known[p] for p in touched if p in known]
    table = replace_by_key(spark.read.schema(rows.schema).parquet(*old), rows, key) if old else rows
    table.withColumn("part", part_of(key)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{store}/version={batch_id}")
    fs, path = _hadoop(spark, store)
    kept = set(old)
    for v in fs.listStatus(path(store)):
        if int(v.getPath().getName().split("=")[1]) < batch_id:
            for p in touched:
                at = path(v.getPath(), f"part={p}")
                if at.toString() not in kept and fs.exists(at):
                    fs.delete(at, True)


#: The name under a store where batches are noted that all of its tables have.
COMMITS = "_commits"


def commit_tables(tables: dict[str, tuple[DataFrame, str]], store: str, batch_id: int) -> None:
    """Merges a batch into several keyed tables (name -> rows, key) under one store, then notes that it is in all of them.

    Readers of `committed` see a batch in all tables or in none: it counts from the note on, which is renamed into place as the last step.
    If a driver is lost between two tables, the version before stays readable, and the batch that runs again writes the same.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    for name, (rows, key) in tables.items():
        merge_batch(rows, f"{store}/{name}", key, batch_id)
    fs, path = _hadoop(spark, store)
    note, draft = path(f"{store}/{COMMITS}/{batch_id}"), path(f"{store}/{COMMITS}/.{batch_id}-{uuid.uuid4().hex[:8]}")
    fs.create(draft, True).close()
    fs.rename(draft, note)
    fs.delete(draft, False)  # it is still there if the note was


def last_commit(spark: SparkSession, store: str) -> int | None:
    """The newest batch that all tables of a store have."""
    fs, path = _hadoop(spark, store)
    notes = path(f"{store}/{COMMITS}")
    names = [f.getPath().getName() for f in fs.listStatus(notes)] if fs.exists(notes) else []
    return max((int(n) for n in names if n.isdigit()), default=None)


def committed(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table of a store as of its last whole batch."""
    batch = last_commit(spark, store)
    paths = list(_newest(spark, f"{store}/{name}", batch + 1).values()) if batch is not None else []
    if not paths:
        raise FileNotFoundError(f"no whole batch of {name} in {store}")
    return spark.read.parquet(*paths)


#: Groups that the keys of expiring state are dealt into: one call of Python and one state for all keys of a group.
KEY_GROUPS = 4096


def stream_expiring(src: DataFrame, key: str, ts: str, ttl_seconds: int, delay: str = "0 seconds", key_groups: int = KEY_GROUPS) -> DataFrame:
    """The first record of each key, and the first again of each time that it had been told `ttl_seconds` or longer ago: (key, ts).

    State is one time a key, kept for `key_groups` groups of keys; it is dropped when the watermark has passed its end, so keys that do not
    come back cost nothing.
    """
    kind, ttl = dict(src.dtypes)[key], ttl_seconds * 1_000_000

    def told(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        # later records than the watermark are told anyway, so an end that it has passed may be forgotten
        known = {k: last for k, last in zip(*state.get, strict=True) if (last + ttl) // 1000 > watermark} if state.exists else {}
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            codes, keys = pd.factorize(rows[key], use_na_sentinel=False)
            order = np.lexsort((rows["_at"], codes))
            at, ends = rows["_at"].to_numpy()[order].tolist(), np.cumsum(np.bincount(codes, minlength=len(keys))).tolist()
            who, when, begin = [], [], 0
            for k, end in zip(keys.tolist(), ends, strict=True):
                k = None if k != k else k
                last = known.get(k)
                n = begin if last is None else bisect_left(at, last + ttl, begin, end)
                while n < end:
                    last = at[n]
                    who.append(k)
                    when.append(last)
                    n = bisect_left(at, last + ttl, n + 1, end)
                known[k], begin = last, end
            if who:
                yield pd.DataFrame({key: pd.Series(who, dtype=rows[key].dtype), "_at": when})
        if known:
            state.update((list(known), list(known.values())))
            state.setTimeoutTimestamp(max((min(known.values()) + ttl) // 1000, watermark + 1))
        elif state.exists:
            state.remove()

    x = event_time(src, ts).select(key, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at")).withWatermark(ts, delay).where(F.col(ts).isNotNull())
    # the null key has a group of its own, so that columns of the others hold no null
    x = x.withColumn("_group", F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(key_groups))))
    x = x.groupBy("_group").applyInPandasWithState(told, f"{key} {kind}, _at long", f"keys array<{kind}>, last array<long>", "append", "EventTimeTimeout")
    return x.select(key, F.timestamp_micros("_at").alias(ts))


def load_batches(src: DataFrame, transform: Callable[[DataFrame], DataFrame], store: str, key: str, checkpoint: str, mode: str = "append"):
    """Starts a stream that replaces each micro-batch's keys in a keyed table under `store`; returns the query."""

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_batch(transform(batch), store, key, batch_id)

    return src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, store: str) -> DataFrame:
    """A keyed table as it stands: each part's newest version."""
    paths = list(_newest(spark, store).values())
    if not paths:
        raise FileNotFoundError(f"no batch was written to {store}")
    return spark.read.parquet(*paths)


def run_to_table(df: DataFrame, out: str, checkpoint: str, mode: str = "append", key: str | None = None) -> None:
    """Runs a stream over all that is there now: into Parquet files (append), or the last state: complete, or update by `key`.

    In update mode a batch tells changed keys alone, so they are merged; `latest_version` reads the table.
    """
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    elif mode == "update":
        if key is None:
            raise ValueError("update mode needs the key that rows are merged by")
        q = load_batches(df, lambda batch: batch, out, key, checkpoint, "update")
    else:

        def keep(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        q = df.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def enrich_payloads(batch: DataFrame, key: str, day: str, normalisers: dict[str, Callable[[DataFrame], DataFrame]], keywords: DataFrame, countries: DataFrame, cities: DataFrame, save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Landed payloads (key, day, kind, payload) to postings: normalised by kind, with countries, category and language requirement.

    A row is (key, id, country_code, category, requires_native_language, local_language_advantage, day) for each posting and country that its place
    names (its own country before that). Kinds without a normaliser, and payloads that do not parse, give no rows; a posting that a
    company lists twice is one. `save` writes the normalised rows and reads them back, as each step uses them; without it they are worked out anew.
    """
    from jobloom.operators.classify import classify_category
    from jobloom.operators.language import detect_language_requirement
    from jobloom.operators.location import resolve_countries

    parts = [n(batch.where(F.col("kind") == kind).select(key, day, "payload")) for kind, n in normalisers.items()]
    x = reduce(lambda a, b: a.unionByName(b), parts).withColumn("_id", F.concat_ws("/", key, "source_id")).dropDuplicates(["_id"])
    x = x.select(key, day, "_id", F.col("source_id").alias("id"), "title", "description", "location", "country_code", F.col("department").alias("function"))
    x = save(x) if save else x  # it is used by each of the steps below
    named = resolve_countries(x, "_id", countries, cities).select("_id", "codes")
    rows = x.join(named, "_id", "left").withColumn("country_code", F.explode(F.when(F.col("country_code").isNotNull(), F.array("country_code")).otherwise(F.coalesce("codes", F.array().cast("array<string>")))))
    category = classify_category(x, "_id", keywords).select("_id", "category")
    lang = detect_language_requirement(rows.select("_id", "country_code", "title", "description"), key="_id").select("_id", "country_code", F.col("value").alias("requires_native_language"), F.col("advantage").alias("local_language_advantage"))
    return rows.join(category, "_id").join(lang, ["_id", "country_code"]).select(key, "id", "country_code", "category", "requires_native_language", "local_language_advantage", day)


def load_postings(src: DataFrame, enrich: Callable[[DataFrame], DataFrame], store: str, key: str, day: str, checkpoint: str):
    """Starts the postings stream: each micro-batch is normalised and classified by `enrich`, and replaces its companies' rows.

    Under `store` are three keyed tables: positions; snapshots, one row a company and day with the first batch's counts; changes,
    one row a company and batch with how many ids came and went. They are committed together (`committed` reads them), and a
    batch that runs again writes the same. Only the parts of the batch's companies are read. Returns the query.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = f"{store}/_batch-{batch_id}-{uuid.uuid4().hex[:8]}"
        enrich(batch).write.parquet(at)  # worked out once for all three tables
        rows = spark.read.parquet(at)
        touched = {r.part for r in rows.select(part_of(key).alias("part")).distinct().collect()}  # PARTS at most
        known = [p for part, p in _newest(spark, f"{store}/positions", batch_id).items() if part in touched]
        before = spark.read.schema(rows.schema).parquet(*known) if known else rows.where("false")
        before = before.join(rows.select(key).distinct(), key, "left_semi")
        both = rows.select(key, "id", F.lit(1).alias("now"), F.lit(0).alias("was")).unionByName(before.select(key, "id", F.lit(0).alias("now"), F.lit(1).alias("was")))
        per = both.groupBy(key, "id").agg(F.max("now").alias("now"), F.max("was").alias("was"))
        changes = per.groupBy(key).agg(F.sum(F.greatest(F.col("now") - F.col("was"), F.lit(0))).alias("came"), F.sum(F.greatest(F.col("was") - F.col("now"), F.lit(0))).alias("went"))
        changes = changes.select(F.concat_ws("/", F.col(key), F.lit(batch_id)).alias("change"), key, "came", "went")
        facts = rows.groupBy(key, F.col(day).alias("day")).agg(F.count("*").alias("total"), F.count_if(~F.col("requires_native_language")).alias("english"))
        facts = facts.withColumn("snapshot", F.concat_ws("/", F.col(key), F.col("day")))
        old = _newest(spark, f"{store}/snapshots", batch_id)
        if old:
            facts = facts.join(spark.read.parquet(*old.values()).select("snapshot"), "snapshot", "left_anti")
        commit_tables({"changes": (changes, "change"), "snapshots": (facts.select("snapshot", key, "day", "total", "english"), "snapshot"), "positions": (rows, key)}, store, batch_id)
        fs, path = _hadoop(spark, at)
        fs.delete(path(at), True)

    return src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
