"""Benchmark decontamination by spaced seeds and diagonals, in DataFrame functions alone.

A mask lays over MASK-long windows of tokens and ignores the tokens at its zeros. Hashes of the masked windows of the texts are
joined with those of the benchmark; a hit names an item and a diagonal (text position minus item position), and the tokens along
the diagonal are compared for the overlap around the hit. With the mask 1101 an overlap that meets no window of the mask
gains one point in five tokens at best (1 1 1 0 0 repeated), so any overlap that scores MIN_SCORE with up to 13 substitutions is hit,
wherever they stand; in shorter items every overlap that counts is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, table

#: Fixed masks over windows of tokens: 1 is hashed, 0 is ignored. Overlaps need not hit all of them.
MASKS = ("1101",)
#: An overlap counts from this score: +1 for an equal token, -1 for a substituted one, best run along the diagonal.
MIN_SCORE = 10
#: Shorter items count from their tokens less 2, as one substitution costs that much; under WHOLE tokens they have to occur whole.
WHOLE = 8
#: Items shorter than a mask have no seed and are no evidence: a phrase of three words occurs anywhere.
MIN_TOKENS = max(map(len, MASKS))


def least_score(n: Column) -> Column:
    """The score from which an overlap with an item of n tokens counts."""
    return F.when(n < WHOLE, n).otherwise(F.least(F.lit(MIN_SCORE), n - 2))


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits of a text; empty for a null or empty one."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(h: Column) -> Column:
    """(p, seed) of all masked windows: place of the window and hash of its unmasked tokens and its mask."""
    out = []
    for k, mask in enumerate(MASKS):
        last = F.size(h) - len(mask)
        at = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
        seed = lambda i: F.xxhash64(*[F.get(h, i + j) for j, bit in enumerate(mask) if bit == "1"], F.lit(k))  # noqa: B023, E731
        out.append(F.when(last >= 0, F.transform(at, lambda i: F.struct(i.alias("p"), seed(i).alias("seed")))).otherwise(F.array().cast("array<struct<p:int,seed:bigint>>")))  # noqa: B023
    return F.concat(*out)


def benchmark_index(benchmark: DataFrame) -> DataFrame:
    """(item_id, h, n) of usable items, h the token hashes; equal texts of one item_id count once."""
    b = benchmark.where("item_id is not null").select("item_id", token_hashes(F.col("text")).alias("h")).distinct()
    return b.withColumn("n", F.size("h")).where(F.col("n") >= MIN_TOKENS)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, doc_from, n_tokens): the verified overlap of each document with each item, best diagonal.

    score is the best run along the diagonal (+1 equal, -1 substituted); doc_from is the token of the text at which the item
    would begin. Rows of one doc_id are read as texts of one document. Null ids, null or empty texts have no overlaps.
    """
    items = benchmark_index(benchmark)
    rows = (items.agg(F.sum("n").alias("rows")).first().rows or 0) * len(MASKS)
    # every place of a seed in an item counts: each is a diagonal of its own
    index = items.select("item_id", "n", F.inline(seeds(F.col("h"))).alias("p", "seed")).distinct()
    index = F.broadcast(index) if rows <= BROADCAST_ROWS else index

    d = docs.where("doc_id is not null").select("doc_id", token_hashes(F.col("text")).alias("h"))
    hits = d.select("doc_id", F.inline(seeds(F.col("h"))).alias("k", "seed")).join(index, "seed")
    diagonals = hits.select("doc_id", "item_id", "n", (F.col("k") - F.col("p")).cast("int").alias("diagonal")).distinct()

    # the texts come back once for each document with hits; each diagonal's tokens are cut out before they meet the items
    per_doc = diagonals.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "n", "diagonal")).alias("ds"))
    back = docs.where("doc_id is not null").select("doc_id", "text").join(per_doc, "doc_id")
    cut = lambda h, x: F.struct(x["item_id"].alias("item_id"), x["n"].alias("n"), x["diagonal"].alias("diagonal"), F.slice(h, F.greatest(x["diagonal"], F.lit(0)) + 1, x["n"] + F.least(x["diagonal"], F.lit(0))).alias("h"))
    # the outer array binds the hashes to a name; else they would be made again for each diagonal
    took = F.transform(F.array(token_hashes(F.col("text"))), lambda h: F.when(F.size(h) >= MIN_TOKENS, F.transform(F.filter("ds", lambda x: x["diagonal"] < F.size(h)), lambda x: cut(h, x))))
    back = back.select("doc_id", F.explode(took[0]).alias("x")).select("doc_id", "x.*")
    tokens = items.withColumnRenamed("h", "item_h")
    both = back.join(F.broadcast(tokens) if rows <= BROADCAST_ROWS else tokens, ["item_id", "n"])
    place = lambda i: i + F.least(F.col("diagonal"), F.lit(0))
    steps = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when((place(i) >= 0) & F.coalesce(F.get("h", F.greatest(place(i), F.lit(0))) == F.get("item_h", i), F.lit(False)), 1).otherwise(-1))
    run = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), lambda acc, s: F.struct(F.greatest(acc["now"] + s, F.lit(0)).alias("now"), F.greatest(acc["best"], acc["now"] + s).alias("best")), lambda acc: acc["best"])
    scored = both.select("doc_id", "item_id", "n", "diagonal", run.alias("score")).where(F.col("score") >= least_score(F.col("n")))
    return scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", -F.col("diagonal"))).alias("b"), F.max("n").alias("n_tokens")).select("doc_id", "item_id", F.col("b.score").alias("score"), (-F.col("b.col2")).alias("doc_from"), "n_tokens")


def flag(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row of `docs` with contaminated, n_items and best_item (highest score, then smallest id; null if none).

    Null and empty texts, null ids and texts of fewer tokens than MIN_TOKENS are clean. Rows that repeat an id are read as one
    document and get one answer. Texts of any length are read whole. Columns of these names are replaced. An empty benchmark
    or table flags nothing; benchmark rows with a null id or text are left out.
    """
    found = overlaps(docs, benchmark).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max_by("item_id", F.struct("score", F.bitwise_not("item_id"))).alias("best_item"), F.max("score").alias("best_score"))
    out = docs.drop("contaminated", "n_items", "best_item", "best_score").join(found, "doc_id", "left")
    return out.withColumns({"contaminated": F.col("n_items").isNotNull(), "n_items": F.coalesce("n_items", F.lit(0).cast("long"))})


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without an overlap, all columns; rows with a null id or text stay. Rows of one id go or stay together."""
    found = overlaps(docs, benchmark).select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").alias("_id"))
    return rows.join(found, "_id", "left_anti").select(*[F.col(f"_doc.`{c}`") for c in docs.columns])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with whether, and by which items, it is contaminated."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = flag(d, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "n_items", "best_item", "best_score")


QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLE_SQL: dict[str, str] = {}
