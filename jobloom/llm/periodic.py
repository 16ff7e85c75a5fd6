"""Periodic runs of words by a dictionary of basic factors.

Every factor (stretch of words) whose length is a power of two gets a name, equal factors the same one; a factor's name comes from
the names of its halves. A run of period q, 2^k <= q < 2^(k+1), holds a factor of length 2^k that occurs again q words
further on. So the occurrences of a factor of length w at distances from w to 2w propose all periods of that level. Where a
factor comes again within w/2 it lies in an arithmetic progression of occurrences, and only the progression's last
members propose, forwards and backwards: a level proposes about as many pairs as there are words. Proposals with one period
that touch are merged, extended in both directions by names of falling length, and the same stretch is told once, with its
smallest period.

A text's factors that occur once in it are left out at once, so that the longer names cost little on ordinary prose. A
document is worked on by itself in Arrow batches: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: A run is at least so long, and at least two periods.
LEAST_LENGTH = 12
#: log2 of the factor length that proposes all smaller periods too: runs of LEAST_LENGTH hold such a factor and its shift.
FIRST_LEVEL = 2
#: Words that are worked on at once; a longer document goes alone.
CHUNK_WORDS = 300_000


def _named(pos: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of equal keys that occur more than once: (name by position, or -1; positions and names in order of name, position)."""
    order = np.argsort(key, kind="stable")
    pos, key = pos[order], key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(key)))
    many = np.repeat(size > 1, size)
    pos, name = pos[many], np.cumsum(new[many]) - 1
    names = np.full(n, -1, np.int32)
    names[pos] = name
    return names, pos, name.astype(np.int64)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of all indices lo[row] <= index < hi[row]."""
    size = np.maximum(hi - lo, 0)
    row = np.repeat(np.arange(len(lo)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + lo[row]


def _proposed(pos: np.ndarray, name: np.ndarray, w: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) where a factor of length w is proposed to come again a period later; sorted occurrences as `_named` gives them."""
    step = 4 * n + 8  # no reach from one name's positions to another's
    c = name * step + pos
    if w == 1 << FIRST_LEVEL:
        row, at = _ranges(np.arange(len(c)) + 1, np.searchsorted(c, c + 2 * w))
        return pos[row], pos[at] - pos[row]
    following = np.full(len(c), 2 * w)
    following[:-1] = np.where(name[1:] == name[:-1], pos[1:] - pos[:-1], 2 * w)
    inner = following <= w // 2  # the progression goes on
    last = np.flatnonzero(~inner)
    row, at = _ranges(np.searchsorted(c, c[last] + w), np.searchsorted(c, c[last] + 2 * w))
    i, d = pos[last[row]], pos[at] - pos[last[row]]
    row, at = _ranges(np.searchsorted(c, c[last] - 2 * w + 1), np.searchsorted(c, c[last] - w + 1))
    row, at = row[inner[at]], at[inner[at]]  # other pairs were told forwards
    return np.append(i, pos[at]), np.append(d, pos[last[row]] - pos[at])


def find_runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a sequence of numbers, by start, then period."""
    n = len(ids)
    names, pos, name = _named(np.arange(n), ids, n)
    levels, starts, periods, ends = [names], [], [], []
    while len(pos):
        half = 1 << (len(levels) - 1)
        if len(levels) > FIRST_LEVEL:
            i, d = _proposed(pos, name, half, n)
            if len(i):
                order = np.lexsort((i, d))
                i, d = i[order], d[order]
                head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] > i[:-1] + half)]))
                tail = np.append(head[1:], len(i)) - 1
                starts.append(i[head])
                periods.append(d[head])
                ends.append(i[tail] + half)
        pos = np.sort(pos)
        pos = pos[pos + half < n]
        second = levels[-1][pos + half]
        pos, second = pos[second >= 0], second[second >= 0]
        names, pos, name = _named(pos, levels[-1][pos].astype(np.int64) * (n + 1) + second, n)
        levels.append(names)
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none
    s, d, e = (np.concatenate(x) for x in (starts, periods, ends))
    for k in range(len(levels) - 1, -1, -1):  # positions s to e agree with those d further on: as far as they go
        names, w = levels[k], 1 << k
        a = np.minimum(e, n - 1)
        b = np.minimum(e + d, n - 1)
        e = np.where((e + d < n) & (names[a] >= 0) & (names[a] == names[b]), e + w, e)
        a, b = np.maximum(s - w, 0), np.maximum(s - w + d, 0)
        s = np.where((s >= w) & (names[a] >= 0) & (names[a] == names[b]), s - w, s)
    length = e - s + d
    keep = length >= np.maximum(LEAST_LENGTH, 2 * d)
    s, length, d = s[keep], length[keep], d[keep]
    order = np.lexsort((d, length, s))
    s, length, d = s[order], length[order], d[order]
    keep = np.concatenate([[True], (s[1:] != s[:-1]) | (length[1:] != length[:-1])]) if len(s) else np.zeros(0, bool)
    s, length, d = s[keep], length[keep], d[keep]
    order = np.lexsort((d, s))
    return s[order], length[order], d[order]


def _batch(texts: list[bytes | None]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Words of each text; offsets into runs of each text, their starts, lengths and periods; texts without what repeats."""
    split = [t.split() if t else [] for t in texts]  # bytes split at exactly \x20 and \x09 to \x0D
    ids, begin = [], [0]
    for words in split:
        known: dict[bytes, int] = {}
        ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + begin[-1])
        begin.append(begin[-1] + len(words))
    s, length, d = find_runs(np.concatenate(ids))
    begins = np.array(begin)
    text = np.searchsorted(begins, s, side="right") - 1
    offsets = np.searchsorted(text, np.arange(len(texts) + 1))
    change = np.zeros(begin[-1] + 1, np.int64)
    np.add.at(change, s + d, 1)
    np.add.at(change, s + length, -1)
    kept = np.cumsum(change)[:-1] == 0
    out = [b" ".join(words) if a == b else b" ".join([words[i] for i in np.flatnonzero(kept[begin[k] : begin[k + 1]])]) for k, (words, a, b) in enumerate(zip(split, offsets[:-1], offsets[1:], strict=True))]
    return [len(w) for w in split], offsets, s - begins[text], length, d, out


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, runs (array of start, length, period; by start, then period) and collapsed to every row; columns of these names are replaced.

    Words are parted by the characters \\x20 and \\x09 to \\x0D and numbered from 0. A run is a longest stretch whose words
    repeat with smallest period q, of at least 12 words and two periods. `collapsed` is the text's words joined by one space,
    without those that any run holds after its first q words. A null, empty or blank text has 0 words, no runs and an empty
    collapsed text. Rows are independent: repeated rows get equal answers, an empty table an empty result, other columns stay.
    Texts of any length are read whole; a task holds the names of one chunk of CHUNK_WORDS words, or of one longer document.
    """
    docs = docs.drop("n_words", "runs", "collapsed")
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = batch.column(0), batch.column(1)
            begin, some, size = 0, [], 0
            for i in range(len(texts) + 1):
                if some and (i == len(texts) or size > CHUNK_WORDS * 6):  # about so many bytes
                    words, offsets, s, length, d, out = _batch(some)
                    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (s, length, d)], fields=list(run_type)))
                    yield pa.RecordBatch.from_arrays([rows.slice(begin, len(some)), pa.array(words, pa.int64()), runs, pa.array(out, pa.binary())], names=["_doc", "n_words", "runs", "collapsed"])
                    begin, some, size = i, [], 0
                if i < len(texts):
                    some.append(texts[i].as_py())
                    size += len(some[-1] or b"")

    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text_col).cast("binary").alias("_text"))
    schema = T.StructType([rows.schema["_doc"], *T.StructType.fromDDL("n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")])
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"_doc.`{c}`") for c in docs.columns], "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the documents, with words that repeat from some place on where crc32(doc_id) ends in 0."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", "text", (h % 10 == 0).alias("planted"), F.floor(h / 10).alias("g"))
    d = d.withColumn("w", F.when(F.col("planted"), F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))).withColumn("n", F.size("w").cast("long"))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.expr("g % n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))

    def word(i: Column) -> Column:
        return F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))

    changed = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), word), " ")
    return d.select("doc_id", F.when(F.col("planted") & (F.col("n") > 0), changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents after `with_planted_runs`: the longest, and digests of all and of the collapsed text. A null doc_id has nothing planted."""
    d = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    d = d.withColumn("best", best)
    length, period = -F.col("best.less"), F.col("best.period")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), F.expr("(1000 * -best.less) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLE_SQL: dict[str, str] = {}
