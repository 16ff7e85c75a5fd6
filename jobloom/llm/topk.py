"""Exact top-k search by term-at-a-time accumulation.

Queries and candidates are dealt in blocks. For a pair of blocks, postings of the candidates (one list a term) are walked term
by term: each query's weight for the term, times the postings, is scattered into the query's dense row of scores. Each block
gives its k best by partition selection, and a rank over the blocks' winners merges them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: Rows of a block: each side is copied once for every block of the other, so blocks are as large as a task can well hold, but for
#: tables with few rows, which are dealt to all cores.
LEAST_BLOCK, BLOCK = 2_048, 16_384
#: Scores under this size are added up in 64 bits; all others in whole numbers of any size.
SAFE = float(1 << 62)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _postings(vectors: list, kind: type) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term the rows that have it and their weights."""
    size = np.array([len(v) for v in vectors], np.int64)
    if not size.sum():
        return []
    values = np.concatenate(vectors)
    row = np.repeat(np.arange(len(size)), size)
    term = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    keep = values != 0
    values, row, term = _whole(values[keep], kind), row[keep], term[keep]
    order = np.argsort(term, kind="stable")
    cuts = np.searchsorted(term[order], np.arange(int(size.max()) + 1))
    return [(row[order[a:b]], values[order[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _whole(values: np.ndarray, kind: type) -> np.ndarray:
    """Whole doubles as 64-bit integers, or as Python's for numbers of any size."""
    return values.astype(np.int64) if kind is np.int64 else np.array([int(x) for x in values], object)


def _scores(query: np.ndarray, postings: list, rows: int, kind: type) -> np.ndarray:
    """Term by term: the query's weight times the postings, scattered into a dense row of scores."""
    scores = np.zeros(rows, kind)
    for weight, (at, values) in zip(_whole(query, kind), postings, strict=False):
        if not weight or not len(at):
            continue
        if len(at) == rows:
            scores += weight * values  # every row has the term, in row order
        else:
            scores[at] += weight * values  # a row has a term once
    return scores


def _ordered(score: int) -> tuple[int, int, str]:
    """A score as long, and how far it lies beyond: (saturated, side, digits that sort as the number does)."""
    if LEAST <= score <= MOST:
        return score, 0, ""
    digits = str(abs(score))
    text = f"{len(digits):06d}{digits}"
    if score < 0:
        text = text.translate(str.maketrans("0123456789", "9876543210"))
    return (MOST, 1, text) if score > 0 else (LEAST, -1, text)


def search_block(queries: pd.DataFrame, cands: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of this block for each query: score down, then id up; a candidate with the query's id is its own row."""
    cands = cands.sort_values("id", kind="stable")
    ids, vectors = cands["id"].to_numpy(np.int64), [np.asarray(v, np.float64) for v in cands["v"]]
    size = np.array([np.abs(v).sum() if len(v) else 0.0 for v in vectors])
    asks = [np.asarray(q, np.float64) for q in queries["v"]]
    most = [float(np.abs(q).max(initial=0.0)) for q in asks]
    # usual vectors are scored in 64 bits; a candidate or a query that could leave them is taken in whole numbers
    usual = size * min(most, default=0.0) < SAFE
    usual &= size < SAFE
    near = _postings([v for v, u in zip(vectors, usual, strict=True) if u], np.int64)
    bound = float(size[usual].max(initial=0.0))
    exact_all = None
    far = None if usual.all() else _postings([v for v, u in zip(vectors, usual, strict=True) if not u], object)
    out = []
    for qid, q, top in zip(queries["id"], asks, most, strict=True):
        if top * bound < SAFE and top < SAFE:
            scores = _scores(q, near, int(usual.sum()), np.int64)
            if far is not None:
                both = np.empty(len(ids), object)
                both[usual], both[~usual] = scores, _scores(q, far, int((~usual).sum()), object)
                scores = both
        else:
            exact_all = exact_all if exact_all is not None else _postings(vectors, object)
            scores = _scores(q, exact_all, len(ids), object)
        at = np.flatnonzero(ids != qid)
        if len(at) > k:
            least = np.partition(scores[at], len(at) - k)[len(at) - k]
            above = at[scores[at] > least]
            at = np.concatenate([above, at[scores[at] == least][: k - len(above)]])  # ids rise, so ties go to the smaller
        if scores.dtype == object:
            told = [_ordered(int(x)) for x in scores[at]]
            score, side, digits = ([t[i] for t in told] for i in range(3))
        else:
            score, side, digits = scores[at], 0, ""
        out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[at], "score": np.asarray(score, np.int64), "side": side, "digits": digits}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "side": [], "digits": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "int64", "side": "int64", "digits": "object"})


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(id long, v array<double> of whole numbers) on both sides -> query_id, rank, vec_id, score: each query's k highest inner products.

    Inner products are exact and ranked as such; one beyond 64 bits is told as the nearest long.

    A term missing from a shorter vector counts 0. Rows with a null id or vector take no part. A candidate with the query's id
    is the query's own row and takes no part. Repeated rows of one id among the queries count once (the least vector); among the
    candidates each is a row. Ties go to the smaller id. Without candidates a query has no rows.
    """
    cands = candidates.where("id is not null and v is not null").select("id", "v")
    asks = queries.where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))
    n_c, n_q = cands.count(), asks.count()
    c_size = min(BLOCK, max(LEAST_BLOCK, n_c // (2 * candidates.sparkSession.sparkContext.defaultParallelism)))
    c_blocks, q_blocks = max(1, -(-n_c // c_size)), max(1, -(-n_q // BLOCK))
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # a candidate goes to each block of queries and a query to each block of candidates: the stated query set, in blocks
    left = asks.select(of(q_blocks).alias("qb"), "id", "v").select("qb", every(c_blocks).alias("cb"), "id", "v")
    right = cands.select(of(c_blocks).alias("cb"), "id", "v").select(every(q_blocks).alias("qb"), "cb", "id", "v")
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(lambda q, c: search_block(q, c, k), "query_id long, vec_id long, score long, side long, digits string")
    best = W.partitionBy("query_id").orderBy(F.desc("side"), F.desc("digits"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embedding: Column) -> Column:
    """floor(256 x) of each component, x as double, as whole doubles; null for a vector that is null or holds a null, NaN or infinity.

    A double whose product with 256 no double holds counts as infinite.
    """
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * 256) == float("inf")))
    # a double of 2**53 or more is whole, and floor() of it would not fit in a long
    whole = lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)
    return F.when(~odd, F.transform(embedding, lambda x: whole(x.cast("double") * 256)))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every vector whose id is divisible by 50."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding")).alias("v"))
    return top_k(e.where("id % 50 = 0"), e, 5)


QUERIES = {"op1_topk": op1_topk}
ORACLE_SQL = {
    "op1_topk": """
WITH e AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])), 0) AS BIGINT) AS score
  FROM e q JOIN e c ON q.id <> c.id
  WHERE q.id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
