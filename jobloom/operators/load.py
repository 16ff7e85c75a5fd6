"""Loading: upserts, replacement by key, snapshots, cascades, change tracking, validation. Each function gives the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], set_cols: list[str], now: Column, keep_old: bool = False) -> DataFrame:
    """Updated rows take the set columns and `now` as updated_at, new rows also as created_at; other columns stay.

    With keep_old, a null in an update leaves the old value. Updates hold one row a key. Null keys match as values.
    """
    t, u = target.alias("t"), updates.withColumn("_new", F.lit(True)).alias("u")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys]
    x = t.withColumn("_old", F.lit(True)).join(u, on, "full_outer")
    hit = F.col("_new").isNotNull()
    out = []
    for c in target.columns:
        old = F.col(f"t.`{c}`")
        if c in keys:
            out.append(F.when(F.col("_old"), old).otherwise(F.col(f"u.`{c}`")).alias(c))
        elif c in set_cols:
            new = F.coalesce(F.col(f"u.`{c}`"), old) if keep_old else F.col(f"u.`{c}`")
            out.append(F.when(hit, new).otherwise(old).alias(c))
        elif c == "updated_at":
            out.append(F.when(hit, now).otherwise(old).alias(c))
        elif c == "created_at":
            out.append(F.when(F.col("_old").isNull(), now).otherwise(old).alias(c))
        else:
            out.append(old.alias(c))
    return x.select(*out)


def replace_by_key(target: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All rows of the incoming keys give way to the incoming rows, in one step."""
    return target.join(incoming.select(key).distinct(), key, "left_anti").select(*target.columns).unionByName(incoming.select(*target.columns))


def snapshot_once(snapshots: DataFrame, facts: DataFrame, keys: list[str], day: Column) -> DataFrame:
    """Appends the facts' rows of keys that have no snapshot on that day."""
    today = snapshots.where(F.to_date("snapshotted_at") == day).select(*keys).distinct()
    new = facts.join(today, keys, "left_anti").withColumn("snapshotted_at", day.cast(dict(snapshots.dtypes)["snapshotted_at"]))
    return snapshots.unionByName(new.select(*snapshots.columns))


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Appends rows with new keys; repeated new keys keep the row that sorts first."""
    rest = [c for c in target.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else rows.select(*keys).distinct()
    return target.unionByName(one.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def append_changes(log: DataFrame, changes: DataFrame) -> DataFrame:
    return log.unionByName(changes, allowMissingColumns=True)


def delete_cascade(tables: dict[str, DataFrame], root: str, keys: DataFrame, graph: dict[str, list[tuple[str, str]]]) -> dict[str, DataFrame]:
    """Deletes `keys` (ids) of `root` and, along graph[parent] = [(child, foreign key)], all that refers to them."""
    gone, order, out = {root: keys.select(F.col(keys.columns[0]).alias("id")).distinct()}, [root], dict(tables)
    for parent in order:
        for child, fk in graph.get(parent, []):
            hit = tables[child].join(gone[parent].withColumnRenamed("id", fk), fk, "left_semi").select("id")
            gone[child] = gone[child].union(hit).distinct() if child in gone else hit
            order.append(child)
    for name, ids in gone.items():
        out[name] = tables[name].join(ids, "id", "left_anti")
    return out


def prune_children(target: DataFrame, run: DataFrame, keep: DataFrame, parent: str, child: str) -> DataFrame:
    """Deletes, for parents of this run, children that the run did not see.

    A parent without any kept child keeps all. A kept list of which nothing is in the table is an error: it never means "delete all".
    """
    if not keep.isEmpty() and keep.join(target.select(parent, child), [parent, child], "left_semi").isEmpty():
        raise ValueError("none of the kept children is in the table")
    matched = keep.join(target.select(parent, child), [parent, child], "left_semi").select(parent).distinct()
    in_run = run.select(parent).distinct().join(matched, parent, "left_semi")
    stale = target.join(in_run, parent, "left_semi").join(keep.select(parent, child), [parent, child], "left_anti").select(parent, child)
    return target.join(stale, [parent, child], "left_anti")


def patch_rows(target: DataFrame, patches: DataFrame, key: str, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sparse patches by id: a null patch field leaves the old value, a category slug becomes its id.

    Rejected patches come second, with a reason: unknown_category or no_row.
    """
    cat = categories.select(F.col("slug").alias("category_slug"), F.col("id").alias("_cat"))
    p = patches.join(cat, "category_slug", "left").join(target.select(key, F.lit(True).alias("_there")), key, "left")
    reason = F.when(F.col("category_slug").isNotNull() & F.col("_cat").isNull(), "unknown_category").when(F.col("_there").isNull(), "no_row")
    p = p.withColumn("reason", reason)
    good = p.where("reason is null").withColumn("category_id", F.col("_cat"))
    fields = [c for c in target.columns if c != key and c in good.columns]
    x = target.alias("t").join(good.select(key, *fields).alias("p"), key, "left")
    out = x.select(key, *[(F.coalesce(F.col(f"p.`{c}`"), F.col(f"t.`{c}`")) if c in fields else F.col(f"t.`{c}`")).alias(c) for c in target.columns if c != key])
    return out.select(*target.columns), p.where("reason is not null").select(key, "reason")


def remap_dim(dim: DataFrame, mapping: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Names renamed by (old, new), then new rows whose name is not there yet."""
    renamed = dim.join(mapping.select(F.col("old").alias("name"), "new"), "name", "left").withColumn("name", F.coalesce("new", "name")).drop("new").select(*dim.columns)
    return renamed.unionByName(new_rows.join(renamed.select("name"), "name", "left_anti").select(*dim.columns))


def flag_in(dim: DataFrame, column: str, names: list[str], flag: str) -> DataFrame:
    return dim.withColumn(flag, F.coalesce(F.col(column).isin(names), F.lit(False)))


def orphan_rows(dim: DataFrame, facts: DataFrame, key: str, fk: str) -> DataFrame:
    return dim.join(facts.select(F.col(fk).alias(key)), key, "left_anti")


# -- incremental runs --------------------------------------------------------------------------------------------------


def reuse_outcomes(jobs: DataFrame, cache: DataFrame, now: Column, version: str, days: int = 14) -> DataFrame:
    """Every job with `hit` and the cached outcome: valid if at most `days` old, of this version and for this title."""
    c = cache.select("url", "country_code", F.col("title_hash").alias("c_hash"), F.col("version").alias("c_version"), "cached_at", "outcome")
    age = F.col("cached_at") >= now - F.expr(f"INTERVAL {days} DAYS")
    x = jobs.join(c, ["url", "country_code"], "left")
    hit = F.coalesce(age & (F.col("c_version") == version) & (F.col("c_hash") == F.col("title_hash")), F.lit(False))
    return x.withColumn("hit", hit).withColumn("outcome", F.when(F.col("hit"), F.col("outcome"))).drop("c_hash", "c_version", "cached_at")


def cached_urls(cache: DataFrame, now: Column, days: int = 14) -> DataFrame:
    return cache.where(F.col("cached_at") >= now - F.expr(f"INTERVAL {days} DAYS")).select("url").distinct()


def load_changes(before: DataFrame, after: DataFrame, key: str, row: list[str]) -> DataFrame:
    """created, updated, deleted or none for each key, by fingerprints of its rows, whatever their order.

    A state is made of two sums of row hashes and the count: partial sums before the shuffle, and no key's rows are gathered.
    """
    text = F.to_json(F.struct(*row), {"ignoreNullFields": "false"})
    total = lambda seed: F.sum(F.xxhash64(text, F.lit(seed)).cast("decimal(38,0)"))
    state = lambda df: df.groupBy(key).agg(total(1).alias("s"), total(2).alias("t"), F.count("*").alias("n")).select(key, F.sha2(F.concat_ws("/", "s", "t", "n"), 256).alias("state"), "n")
    b = state(before).select(key, F.col("state").alias("before_state"), F.col("n").alias("before_rows"))
    a = state(after).select(key, F.col("state").alias("after_state"), F.col("n").alias("after_rows"))
    x = b.join(a, key, "full_outer")
    action = F.when(F.col("before_state").isNull(), "created").when(F.col("after_state").isNull(), "deleted").when(F.col("before_state") != F.col("after_state"), "updated").otherwise("none")
    return x.withColumn("action", action)


def publish_state(builds: DataFrame, now: Column, default: Column, minutes: int = 25, recent: int = 5) -> DataFrame:
    """One row: `since` (start of the last ready build, else the default) and `in_flight` (one of the latest builds runs)."""
    since = builds.where("state = 'ready'").agg(F.max_by("created_at", F.struct("finished_at", "build_id")).alias("since"))
    last = builds.orderBy(F.desc("created_at"), F.desc("build_id")).limit(recent)
    running = last.agg(F.coalesce(F.bool_or((F.col("state") == "building") & (F.col("started_at") >= now - F.expr(f"INTERVAL {minutes} MINUTES"))), F.lit(False)).alias("in_flight"))
    return since.select(F.coalesce("since", default).alias("since")).crossJoin(running)  # one row each


STATES = {"building": "building", "enqueued": "building", "ready": "ready", "failed": "error", "error": "error"}


def map_events(df: DataFrame) -> DataFrame:
    """Deployment events of the production context as build rows; unknown states are dropped."""
    state = F.lit(None).cast("string")
    for raw, mapped in STATES.items():
        state = F.when(F.col("raw_state") == raw, mapped).otherwise(state)
    x = df.where("context = 'production' and id is not null").withColumn("state", state).where("state is not null")
    ended = F.col("state").isin("ready", "error")
    return x.select(F.col("id").alias("build_id"), "state", F.when(~ended, F.col("at")).alias("started_at"), F.when(ended, F.col("at")).alias("finished_at"))


# -- validation --------------------------------------------------------------------------------------------------------


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks (a rule is true for a good row; null breaks it)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def apply_defaults(df: DataFrame) -> DataFrame:
    """Booleans default to false and arrays to empty."""
    out = {}
    for name, kind in df.dtypes:
        if kind == "boolean":
            out[name] = F.coalesce(name, F.lit(False))
        elif kind.startswith("array"):
            out[name] = F.coalesce(name, F.array().cast(kind))
    return df.withColumns(out)


def split_valid(df: DataFrame, rules: dict[str, Column], strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with their violations; one pass each over the same plan.

    Rows that are all rejected are an error, which takes a look at them; without `strict` they are told as the others.
    """
    x = df.withColumn("violations", violations(rules))
    if strict and not x.isEmpty() and x.where(F.size("violations") == 0).isEmpty():
        raise ValueError("all rows are rejected")
    return x.where(F.size("violations") == 0).drop("violations"), x.where(F.size("violations") > 0)


def audit(tables: dict[str, DataFrame], unique: list[tuple[str, list[str]]], not_null: list[tuple[str, str]], foreign: list[tuple[str, str, str, str]], enums: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(constraint, n): rows that break each constraint, one row a constraint."""
    out = [tables[t].groupBy(*cols).count().where("count > 1").agg(F.lit(f"unique {t}({','.join(cols)})").alias("constraint"), F.count("*").alias("n")) for t, cols in unique]
    out += [tables[t].agg(F.lit(f"not_null {t}.{c}").alias("constraint"), F.count_if(F.col(c).isNull()).alias("n")) for t, c in not_null]
    out += [tables[t].where(F.col(c).isNotNull()).join(tables[p].select(F.col(pk).alias(c)), c, "left_anti").agg(F.lit(f"foreign {t}.{c}").alias("constraint"), F.count("*").alias("n")) for t, c, p, pk in foreign]
    out += [tables[t].agg(F.lit(f"enum {t}.{c}").alias("constraint"), F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(values)).alias("n")) for t, c, values in enums]
    first, *rest = out
    for x in rest:
        first = first.unionByName(x)
    return first


def nested_upload(companies: DataFrame, positions: DataFrame, fields: list[str]) -> DataFrame:
    """(company_id, country, total, positions): the upload document of each company and country, positions by id; a company without positions has an empty list.

    A document is one row, so its size is that of a company's postings in a country.
    """
    per = positions.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("id", *fields))).alias("positions"))
    x = companies.select(F.col("id").alias("company_id"), "country").join(per, "company_id", "left")
    kind = dict(per.dtypes)["positions"]
    return x.select("company_id", "country", F.coalesce(F.size("positions"), F.lit(0)).alias("total"), F.coalesce("positions", F.array().cast(kind)).alias("positions"))


def duplicate_report(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").withColumn("removed", F.col("n") - 1)
