"""Mixing sources to target weights by Pfair scheduling.

Time is in slots, one block of rows each. Block j (from 1) of a source of weight w is released at floor((j - 1) / w) and due at
ceil(j / w); earliest deadline first picks a released block for every slot. With weights p / P in whole parts of a cycle of P
slots the schedule repeats after P slots, so one cycle is worked out and every block of any corpus looks up its slot in it. The
cycle grows with the smallest share; sources too rare for the longest one are not rounded up: their blocks go between the slots,
each at a place of its own window that is computed from the exact weight.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, table

#: Slots of a cycle: weights are rounded to parts of it. It is raised to four slots a source where there are many sources.
CYCLE = 1_000
MAX_SOURCES = 20_000
#: Parts that the smallest share of a cycle has at least (rounding moves a share by less than one part), and the longest cycle.
LEAST_PARTS, MAX_CYCLE = 64, 100_000
#: Steps of this size spread the rare sources' places in their windows evenly.
GOLDEN = 0.6180339887498949
BLOCK_ROWS = 8
#: Rows of a source in one bucket, about, and the bits of a hash that buckets are told by at most.
BUCKET_ROWS, MAX_BITS = 4_096, 20


def parts(weights: dict, cycle: int = CYCLE) -> tuple[dict, int]:
    """Whole parts of the cycle for each source with a positive weight: largest remainders, at least 1 each."""
    live = {k: Fraction(w).limit_denominator(10**9) for k, w in weights.items() if w and w > 0}
    if not live:
        return {}, 0
    cycle = max(cycle, 4 * len(live))
    total = sum(live.values())
    exact = {k: w * cycle / total for k, w in live.items()}
    p = {k: max(1, int(x)) for k, x in exact.items()}
    order = sorted(p, key=lambda k: (p[k] - exact[k], str(k)))
    i = 0
    while sum(p.values()) < cycle:
        p[order[i % len(order)]] += 1
        i += 1
    while sum(p.values()) > cycle:
        k = max(p, key=lambda k: (p[k] - exact[k] if p[k] > 1 else Fraction(-1), str(k)))
        p[k] -= 1
    return p, cycle


def schedule(p: dict, cycle: int) -> list[tuple]:
    """One cycle by earliest deadline first: (source, block in cycle from 0, release, deadline, slot).

    The weights fill the cycle, so every slot has a released block and every block runs inside its window; at each time a
    source has got less than one block more or less than its weight times the time.
    """
    window = lambda k, j: ((j - 1) * cycle // p[k], -(-j * cycle // p[k]))
    waiting = [(*window(k, 1), str(k), i, k, 1) for i, k in enumerate(p)]
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for slot in range(cycle):
        while waiting and waiting[0][0] <= slot:
            release, due, name, i, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, name, i, k, j, release))
        due, name, i, k, j, release = heapq.heappop(ready)
        out.append((k, j - 1, release, due, slot))
        if j < p[k]:
            heapq.heappush(waiting, (*window(k, j + 1), name, i, k, j + 1))
    return out


def split_rare(weights: dict, cycle: int = CYCLE) -> tuple[dict, dict, int]:
    """Weights for a cycle, the blocks a slot of sources too rare for one, and the cycle's least length."""
    total = sum(w for w in weights.values() if w and w > 0)
    share = {k: w / total for k, w in weights.items() if w and w > 0}
    common = {k: w for k, w in share.items() if w * MAX_CYCLE >= LEAST_PARTS}
    slots = sum(common.values()) or 1.0
    cycle = max(cycle, math.ceil(LEAST_PARTS * slots / min(common.values()))) if common else cycle
    return common, {k: w / slots for k, w in share.items() if k not in common}, cycle


def tempered(sizes: dict, alpha: float = 0.7, share: float = 0.9) -> dict:
    """Target weights n**alpha, but no source over its rows when `share` of all rows is drawn: water-filling of the rest."""
    goal, full, free = share * sum(sizes.values()), {}, dict(sizes)
    while free:
        c = (goal - sum(full.values())) / sum(n**alpha for n in free.values())
        over = {k: n for k, n in free.items() if c * n**alpha >= n}
        if not over:
            return full | {k: c * n**alpha for k, n in free.items()}
        full |= over
        free = {k: n for k, n in free.items() if k not in over}
    return full


def _with_pieces(x: DataFrame, most: int) -> DataFrame:
    """Adds _hot and _piece to rows (_s, _b, _h): null, but for rows of a hash (null or repeated ids) that more than `most` rows have.

    Those are dealt to pieces by where they stand in the input. Only buckets with more than `most` rows are looked into.
    """
    none = {"_hot": F.lit(None).cast("long"), "_piece": F.lit(None).cast("long")}
    full = x.groupBy("_s", "_b").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(F.col("_s").alias("_fs"), F.col("_b").alias("_fb"))
    if full.isEmpty():
        return x.withColumns(none)
    at = F.col("_s").eqNullSafe(F.col("_fs")) & (F.col("_b") == F.col("_fb"))
    # of a source, there are fewer than its rows / most: some 100,000 in all at any size
    hot = x.join(F.broadcast(full), at, "left_semi").groupBy("_s", "_h").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    hot = hot.select(F.col("_s").alias("_fs"), F.col("_h").alias("_hot"), F.ceil(F.col("_n") / most).cast("long").alias("_pieces"))
    x = x.join(F.broadcast(hot), F.col("_s").eqNullSafe(F.col("_fs")) & (F.col("_h") == F.col("_hot")), "left")
    return x.withColumn("_piece", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_pieces"))).drop("_fs", "_pieces")


def mix(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, cycle: int = CYCLE, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Adds block, release, deadline, slot, position and in_mix to every row.

    `weights`: target weight by source (null is a source); default `tempered` row counts. A source's rows are ordered by a
    hash of the id (then id; ids that very many rows have come last in their bucket of hashes) and cut in blocks of `block_rows`; block j takes the j-th place of its source in the schedule, and
    position orders the mix: by slot, in a slot the cycle's block before those of rare sources, then by place in the block. in_mix
    says that the row lies before the horizon, the first slot for which its source has no row left: up to there every source has
    its weight to less than two blocks, as its last block may not be full. Default weights are rows to draw, so the horizon is
    not before all slots of that draw, and a source that runs dry by rounding leaves its later slots empty. Rows past the horizon
    keep their slots and are not in the mix, as are rows of sources without a positive weight, whose slot is null. Columns of the added names are replaced. An empty table
    gives an empty result. Repeated ids are rows of their own.
    """
    spark = docs.sparkSession
    docs = docs.drop("block", "release", "deadline", "slot", "position", "in_mix")
    counts = docs.groupBy(F.col(source_col).alias("s")).agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: give a coarser source column")
    sizes = {r.s: r.n for r in counts}
    drawn = 0.0
    if weights is None:
        weights = tempered(sizes)
        drawn = sum(weights.values())
    common, rare, cycle = split_rare({k: w for k, w in weights.items() if k in sizes}, cycle)
    p, cycle = parts(common, cycle)
    plan = schedule(p, cycle) if p else []
    # the first slot that finds no row: the next one of each source after its last block
    starts: dict = {}
    for k, j, _, _, slot in plan:
        starts.setdefault(k, {})[j] = slot
    last = {k: -(-sizes[k] // block_rows) for k in [*p, *rare]}
    phase = {k: (i + 0.5) * GOLDEN % 1 for i, k in enumerate(sorted(rare, key=lambda k: (k is None, str(k))))}
    ends = [last[k] // p[k] * cycle + starts[k][last[k] % p[k]] for k in p] + [math.floor((last[k] + phase[k]) / rare[k]) for k in rare]
    all_slots = math.ceil(drawn / block_rows * (sum(common.values()) or 1.0))
    horizon = max(min(ends, default=0), all_slots)

    # Rank in the source: buckets of a hash of the id, more for a larger source, so that no task holds a whole source.
    kind = docs.schema[source_col].dataType.simpleString()
    bits = {k: min(MAX_BITS, max(1, (n // BUCKET_ROWS).bit_length())) for k, n in sizes.items()}
    cuts = F.broadcast(spark.createDataFrame(list(bits.items()), f"_k {kind}, _bits int"))  # at most MAX_SOURCES rows
    x = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(source_col).alias("_s"), F.xxhash64(id_col).alias("_h"), F.col(id_col).alias("_id"))
    x = x.join(cuts, F.col("_s").eqNullSafe(F.col("_k"))).withColumn("_b", F.expr("shiftrightunsigned(_h ^ shiftleft(1L, 63), 64 - _bits)")).drop("_k", "_bits")
    x = _with_pieces(x, max(4 * BUCKET_ROWS, sum(sizes.values()) >> MAX_BITS - 3))
    unit = ["_b", "_hot", "_piece"]  # rows of usual ids have nulls and come first in their bucket
    tally = x.groupBy("_s", *unit).agg(F.count("*").alias("_n"))
    before = tally.select("_s", *unit, (F.sum("_n").over(W.partitionBy("_s").orderBy(*unit)) - F.col("_n")).alias("_before"))
    rn = F.row_number().over(W.partitionBy("_s", *unit).orderBy("_h", "_id"))
    x = x.withColumn("_rn", rn - 1).alias("x")
    bounded = small(before, 2 * sum(1 << b for b in bits.values()))
    x = x.join(bounded.alias("t"), F.col("x._s").eqNullSafe(F.col("t._s")) & (F.col("x._b") == F.col("t._b")) & F.col("x._hot").eqNullSafe(F.col("t._hot")) & F.col("x._piece").eqNullSafe(F.col("t._piece")))
    row = F.col("_rn") + F.col("_before")
    x = x.select("_doc", F.col("x._s").alias("_s"), row.alias("_row")).withColumn("block", F.floor(F.col("_row") / block_rows))
    rows = [(k, p[k], j, release, due, slot) for k, j, release, due, slot in plan]
    table_ = spark.createDataFrame(rows, f"_k {kind}, _p int, _j int, _release int, _due int, _slot int")
    lanes = {k: i for i, k in enumerate(phase, 1)}
    known = [(k, n, None, None, 0) for k, n in p.items()] + [(k, 1, w, phase[k], lanes[k]) for k, w in rare.items()]
    sizes_ = spark.createDataFrame(known, f"_k {kind}, _parts int, _rate double, _phase double, _lane int")
    x = x.alias("x").join(F.broadcast(sizes_).alias("p"), F.col("x._s").eqNullSafe(F.col("p._k")), "left").select("_doc", "_s", "_row", "block", "_parts", "_rate", "_phase", "_lane")
    x = x.alias("x").join(F.broadcast(table_).alias("c"), F.col("x._s").eqNullSafe(F.col("c._k")) & (F.pmod("x.block", "x._parts") == F.col("c._j")), "left")
    turn = F.floor(F.col("block") / F.col("_parts")) * cycle
    # a rare source has less than one block a slot, so its own blocks never share a slot
    placed = lambda rare_, in_cycle: F.when(F.col("_rate").isNotNull(), rare_.cast("long")).otherwise(turn + F.col(in_cycle))
    slot = placed(F.floor((F.col("block") + F.col("_phase")) / F.col("_rate")), "_slot")
    return x.select(
        *[F.col(f"_doc.`{c}`") for c in docs.columns],
        "block",
        placed(F.floor(F.col("block") / F.col("_rate")), "_release").alias("release"),
        placed(F.ceil((F.col("block") + 1) / F.col("_rate")), "_due").alias("deadline"),
        slot.alias("slot"),
        ((slot * (1 + len(rare)) + F.col("_lane")) * block_rows + F.pmod("_row", F.lit(block_rows))).alias("position"),
        F.coalesce(slot < horizon, F.lit(False)).alias("in_mix"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their places in the default mix of their sources."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


QUERIES = {"op8_mixing": op8_mixing}
ORACLE_SQL: dict[str, str] = {}
