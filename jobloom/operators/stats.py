"""Aggregates over countries, companies, positions and change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobloom.functions.columns import share

def english() -> Column:
    return ~F.col("requires_native_language")


def counted(digits: int) -> list[Column]:
    """total, english and percentage of the positions of a group; ids that a left join left null do not count."""
    total, eng = F.count("position_id"), F.count(F.when(english(), F.col("position_id")))
    return [total.alias("total_positions"), eng.alias("english_positions"), share(eng, total, digits).alias("english_percentage")]


def country_stats(countries: DataFrame, companies: DataFrame, positions: DataFrame) -> DataFrame:
    """One row for each country, also without companies: totals, percentage to one place and the last update."""
    c = countries.select(F.col("id").alias("country_id"), "name", "slug", "sort_order")
    co = companies.select(F.col("id").alias("company_id"), "country_id", "updated_at")
    # positions meet their company before the country: partial sums a company keep the second join small
    p = positions.groupBy("company_id").agg(F.count("id").alias("t"), F.count(F.when(english(), F.col("id"))).alias("e"))
    joined = c.join(co, "country_id", "left").join(p, "company_id", "left").groupBy("country_id", "name", "slug", "sort_order")
    total, eng = F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("e"), F.lit(0))
    return joined.agg(total.alias("total_positions"), eng.alias("english_positions"), share(eng, total, 1).alias("english_percentage"), F.max("updated_at").alias("last_updated"))


def company_stats(companies: DataFrame, positions: DataFrame, categories: DataFrame) -> DataFrame:
    """One row for each company: counts and the sorted distinct category names, null where there are none."""
    cat = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    p = positions.join(cat, "category_id", "left").groupBy("company_id").agg(F.count("id").alias("t"), F.count(F.when(english(), F.col("id"))).alias("e"), F.array_sort(F.collect_set("category")).alias("cats"))
    total, eng = F.coalesce("t", F.lit(0)), F.coalesce("e", F.lit(0))
    co = companies.select(F.col("id").alias("company_id"), "name", "country_id", "updated_at").join(p, "company_id", "left")
    return co.select("company_id", "name", "country_id", "updated_at", total.alias("total_positions"), eng.alias("english_positions"), share(eng, total, 1).alias("english_percentage"), F.when(F.size("cats") > 0, F.col("cats")).alias("categories"))


def count_distinct_companies(companies: DataFrame) -> DataFrame:
    return companies.agg(F.countDistinct("name").alias("n_companies"))


def per_company_country(companies: DataFrame, countries: DataFrame, positions: DataFrame) -> DataFrame:
    p = positions.groupBy("company_id").agg(F.count("id").alias("t"), F.count(F.when(english(), F.col("id"))).alias("e"))
    co = companies.select(F.col("id").alias("company_id"), "name", "country_id").join(countries.select(F.col("id").alias("country_id"), F.col("slug").alias("country_slug")), "country_id")
    x = co.join(p, "company_id", "left").groupBy("name", "country_id", "country_slug")
    return x.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("total"), F.coalesce(F.sum("e"), F.lit(0)).alias("english"))


def best_country(pairs: DataFrame) -> DataFrame:
    """Each name's country with most english positions, then the first slug (the reference leaves ties open)."""
    return best_per_key(pairs, ["name"], [F.desc("english"), F.asc("country_slug")])


def top_companies(companies: DataFrame, countries: DataFrame, positions: DataFrame, limit: int = 5) -> DataFrame:
    """Names by english positions over all countries; `limit` of 0 or less keeps all. Ties go by name."""
    pairs = per_company_country(companies, countries, positions)
    g = pairs.groupBy("name").agg(F.sum("total").alias("total_positions"), F.sum("english").alias("english_positions"), F.count("*").alias("country_count"))
    g = g.withColumn("english_percentage", share(F.col("english_positions"), F.col("total_positions")))
    g = top_k(g, [F.desc("english_positions"), F.asc("name")], limit)
    best = best_country(pairs).select("name", F.col("country_slug").alias("primary_country_slug"))
    return g.join(best, "name")


def global_stats(countries: DataFrame, companies: DataFrame, positions: DataFrame) -> DataFrame:
    """One row: countries, distinct companies, positions, english ones and their percentage."""
    c = countries.agg(F.count("*").alias("n_countries"))
    co = companies.agg(F.countDistinct("name").alias("n_companies"))
    p = positions.agg(F.count("*").alias("total_positions"), F.count_if(english()).alias("english_positions"))
    return c.crossJoin(co).crossJoin(p).withColumn("english_percentage", share(F.col("english_positions"), F.col("total_positions")))  # three rows of one


def category_breakdown(positions: DataFrame, categories: DataFrame, scope: list[str]) -> DataFrame:
    """Counts of each category in each scope; positions without a category are left out."""
    cat = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return positions.join(cat, "category_id").withColumn("position_id", F.col("id")).groupBy(*scope, "category").agg(*counted(0))


def company_counts(companies: DataFrame) -> DataFrame:
    return companies.groupBy("country_id").agg(F.count("*").alias("n_companies"))


def company_profile(companies: DataFrame, countries: DataFrame, positions: DataFrame) -> DataFrame:
    """One row a company name: totals, last update and an entry for each country, most english first."""
    x = companies.select(F.col("id").alias("company_id"), "name", "country_id", "updated_at").join(countries.select(F.col("id").alias("country_id"), "slug"), "country_id")
    x = x.join(positions.select("company_id", F.col("id").alias("position_id"), "requires_native_language"), "company_id", "left")
    per = x.groupBy("name", "slug").agg(F.count("position_id").alias("total"), F.count(F.when(english(), F.col("position_id"))).alias("english"), F.max("updated_at").alias("updated_at"))
    # entries of a name are as many as countries; their positions are counted, not gathered
    entry = F.struct((-F.col("english")).alias("_order"), "slug", "total", "english")
    return per.groupBy("name").agg(F.sum("total").alias("total_positions"), F.sum("english").alias("english_positions"), F.max("updated_at").alias("updated_at"), F.array_sort(F.collect_list(entry)).alias("countries"))


def group_rows(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Values of each key in order."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("rows"))


def rollup_by_name(df: DataFrame) -> DataFrame:
    """(name, country, total, english, url, updated_at, ord) -> sums, last update, first non-null url and members in order."""
    url = F.min_by("url", F.when(F.col("url").isNotNull(), F.col("ord")))
    return df.groupBy("name").agg(F.sum("total").alias("total"), F.sum("english").alias("english"), F.max("updated_at").alias("updated_at"), url.alias("url"), F.count("*").alias("members"))


def country_totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("country").agg(F.sum("total").alias("total"), F.sum("english").alias("english"), F.count("*").alias("companies")).orderBy("country")


def skill_snapshot(positions: DataFrame, skills: DataFrame, categories: DataFrame, day: Column, fallback: str = "other") -> DataFrame:
    """Counts for (day, company, country, category, skill); unknown skills are dropped, unknown categories fall back.

    A skill that a posting lists twice counts twice.
    """
    x = positions.select(day.alias("captured_at"), "company_id", "country_id", "category", F.explode("skills").alias("skill"))
    x = x.join(skills.select(F.col("name").alias("skill"), F.col("id").alias("skill_id")), "skill")
    known = categories.select(F.col("name").alias("category"), F.lit(True).alias("_known"))
    x = x.join(known, "category", "left").withColumn("category", F.when(F.col("_known"), F.col("category")).otherwise(F.lit(fallback)))
    return x.groupBy("captured_at", "company_id", "country_id", "category", "skill_id").agg(F.count("*").alias("position_count"))


def net_changes(log: DataFrame, since: Column | None = None) -> DataFrame:
    """The net change of each entity: state before its first change against state after its last; null is a state."""
    x = log if since is None else log.where(F.col("changed_at") > since)
    at = F.struct("changed_at", "change_id")
    g = x.groupBy("entity_type", "entity_id").agg(F.min_by("before_state", at).alias("before"), F.max_by("after_state", at).alias("after"), F.count("*").alias("n_changes"))
    same = F.col("before").eqNullSafe(F.col("after"))
    return g.withColumn("action", F.when(same, "none").when(F.col("before").isNull(), "created").when(F.col("after").isNull(), "deleted").otherwise("updated"))


def change_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("entity_type", "action").agg(F.count("*").alias("n"))


def net_actions(log: DataFrame, since: Column | None = None) -> DataFrame:
    """Whether an entity was created in the window, and its last action."""
    x = log if since is None else log.where(F.col("changed_at") > since)
    at = F.struct("changed_at", "change_id")
    return x.groupBy("entity_type", "entity_id").agg(F.bool_or(F.col("action") == "created").alias("created_in_window"), F.max_by("action", at).alias("last_action"))


def run_quality(results: DataFrame, sources: DataFrame) -> DataFrame:
    """Positions and countries of each source against its minimum: ok, warning (none, none asked for) or fail."""
    g = results.groupBy("source").agg(F.count("*").alias("positions"), F.array_sort(F.collect_set("country")).alias("countries"))
    x = sources.join(g, "source", "left").withColumn("positions", F.coalesce("positions", F.lit(0)))
    status = F.when((F.col("positions") == 0) & (F.col("min_positions") == 0), "warning").when(F.col("positions") < F.col("min_positions"), "fail").otherwise("ok")
    return x.select("source", "positions", F.coalesce(F.size("countries"), F.lit(0)).alias("n_countries"), "min_positions", status.alias("status"))


def strict_majority(votes: DataFrame, key: str, label: str) -> DataFrame:
    """The label that more than half of a key's votes are for; keys without one are left out."""
    per = votes.groupBy(key, label).agg(F.count("*").alias("n"))
    top = per.groupBy(key).agg(F.max(F.struct("n", label)).alias("t"), F.sum("n").alias("total"))
    return top.where(F.col("t.n") * 2 > F.col("total")).select(key, F.col(f"t.{label}").alias(label), F.col("t.n").alias("votes"), "total")


def allocate_dims(dim: DataFrame, names: DataFrame) -> DataFrame:
    """New names get the sort orders after the largest one, in name order; known names are left alone."""
    new = names.select("name").where("name is not null").distinct().join(dim.select("name"), "name", "left_anti")
    top = dim.agg(F.coalesce(F.max("sort_order"), F.lit(0)).alias("top"))
    # new rows of a dimension: few, so one window over them is fine
    return new.withColumn("rn", F.row_number().over(W.orderBy("name"))).crossJoin(top).select("name", (F.col("top") + F.col("rn")).alias("sort_order"))


# -- windows, order and limits -----------------------------------------------------------------------------------------


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in input order, which `order` columns carry."""
    return best_per_key(df, keys, [F.asc(c) for c in order])


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k) if k > 0 else df


def ranked(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """A rank for the rows of a top list: the k rows are taken first, so the window sees k rows."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def latest(df: DataFrame, n: int, order: list[Column], where: Column | None = None) -> DataFrame:
    x = df if where is None else df.where(where)
    return x.orderBy(*order).limit(n)


def row_numbers(df: DataFrame, key: str, ties: list[str] | None = None, parts: int = 256) -> DataFrame:
    """_no from 0 in the order of a number or time, nulls first, without one task for all rows: ranges, their counts, then places in a range.

    Ranges are cut at quantiles. Rows of equal keys are in the order of `ties`, or in that of a hash of the row. A key that spans
    whole quantiles is a range of its own and is cut again by quantiles of the first of `ties`, or by the hash.
    """
    x = df.withColumn("_h", F.xxhash64(*df.columns))
    order = [F.asc_nulls_first(c) for c in ties or ["_h"]]
    steps = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    first = ties[0] if ties and dict(df.dtypes)[ties[0]] in ("tinyint", "smallint", "int", "bigint", "double", "float") else None if ties else "_h"
    cuts = x.agg(F.percentile_approx(key, steps, F.lit(100 * parts)).alias("_cuts"))  # one row
    x = x.crossJoin(F.broadcast(cuts))
    cuts_ = F.coalesce("_cuts", F.array().cast(df.select(F.array(key)).schema[0].dataType))
    heavy = F.size(F.filter(cuts_, lambda c: c == F.col(key))) > 1
    x = x.withColumns({"_range": F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(cuts_, lambda c: c < F.col(key)))), "_heavy": F.coalesce(heavy, F.lit(False)) | F.col(key).isNull()}).drop("_cuts")
    # a range ends with its upper cut, so a heavy key is its last
    x = x.withColumn("_rest", F.col("_heavy").cast("int"))
    if first:
        again = x.where("_heavy").groupBy("_range").agg(F.percentile_approx(first, steps, F.lit(10 * parts)).alias("_again"))  # a row a heavy key: fewer than `parts`
        x = x.join(F.broadcast(again), "_range", "left")
        x = x.withColumn("_piece", F.when(F.col("_heavy"), F.when(F.col(first).isNull(), -1).otherwise(F.size(F.filter("_again", lambda c: c < F.col(first))))).otherwise(0)).drop("_again")
    else:
        x = x.withColumn("_piece", F.lit(0))
    at = ["_range", "_rest", "_piece"]
    counts = x.groupBy(*at).agg(F.count("*").alias("_n"))
    before = counts.select(*at, F.coalesce(F.sum("_n").over(W.orderBy(*at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rn = F.row_number().over(W.partitionBy(*at).orderBy(F.asc_nulls_first(key), *order))
    return x.withColumn("_rn", rn).join(F.broadcast(before), at).withColumn("_no", F.col("_before") + F.col("_rn") - 1).select(*df.columns, "_no")


def slice_of(df: DataFrame, key: str, i: int, n: int, ties: list[str] | None = None) -> DataFrame:
    """Every n-th row from the i-th in key order, nulls first."""
    return row_numbers(df, key, ties).where(F.pmod("_no", F.lit(n)) == i).drop("_no")


def with_page(df: DataFrame, key: str, page_size: int, ties: list[str] | None = None) -> DataFrame:
    return row_numbers(df, key, ties).withColumn("page", F.floor(F.col("_no") / page_size)).drop("_no")


def sort_grid(df: DataFrame, field: str, descending: bool = False) -> DataFrame:
    """Rows by a chosen field, text in Unicode order, then by id."""
    kind = dict(df.dtypes)[field]
    c = F.collate(F.col(field), "UNICODE") if kind == "string" else F.col(field)
    return df.orderBy(c.desc() if descending else c.asc(), F.asc("id"))


def run_report(positions: DataFrame, by: list[str]) -> DataFrame:
    """(by..., status, n): the positions of a run by what is asked of language: open, advantage or required.

    Counters of the run itself (skipped, cached, phases) come with the pass that writes it: `sources.tables.write_counted`.
    """
    status = F.when(F.col("local_language_advantage"), "advantage").when(F.col("requires_native_language"), "required").otherwise("open")
    return positions.groupBy(*by, status.alias("status")).agg(F.count("*").alias("n"))
