"""Near-duplicate documents by HyperMinHash sketches, banding, estimates and exact checks.

A document's set is its distinct 5-word shingles. A sketch splits the hash space in REGISTERS buckets and keeps each bucket's
least hash as a leading-zero count with ten mantissa bits: 16 bits a register. Bands of registers give candidates, the
collision-corrected estimate drops most false ones, and full sets confirm each link. Equal sets are one class from the
start. Buckets are never turned into all their pairs: a first round tries one partner a document, then only members that
are still in different components meet, block by block, and only pairs with a high estimate leave a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _P, Powers, Scratch, components, fmix, table

WORDS = 5
#: 56 bands of 6 registers: a pair of Jaccard similarity 0.75 shares no band with probability 2e-5.
BANDS, ROWS = 56, 6
REGISTERS = BANDS * ROWS
#: From so many shingles on, bands with one register in use are left out.
MANY = 96
MANTISSA = 10
#: Similarity of a link in hundredths, and the estimate under which a candidate is let go: 4 standard errors below.
PERCENT, LEAST_ESTIMATE = 75, 0.65
#: Partners that a document tries in each other component in the middle round, and members in a block.
PARTNERS, SMALL_BLOCK, LARGE_BLOCK, ONE_BLOCK, SHIFTS = 3, 256, 1024, 512, 24

#: Classes of equal sets that are broadcast at most: those with more than this part of all rows each.
CLASSES = 10_000

_CHUNK = 1 << 18
_MASK = (1 << 64) - 1
_MIX = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word [^\\x20\\x09-\\x0D]+ of a UTF-8 text, A-Z lowered; long texts go piece by piece."""
    if len(data) > 2 * _CHUNK:
        out, at = [], 0
        while at < len(data):
            end = at + _CHUNK
            while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":  # a piece ends at a space
                end += 1
            out.append(word_hashes_piece(data[at:end]))
            at = end
        return np.concatenate(out)
    return word_hashes_piece(data)


def word_hashes_piece(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return np.zeros(0, np.uint64)
    inside = np.empty(len(a) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = (a != 32) & ((a < 9) | (a > 13))
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    low = a + ((a >= 65) & (a <= 90)) * np.uint8(32)
    up, down = Powers.get(len(a))
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return fmix(h ^ ((ends - starts).astype(np.uint64) * _MIX[5]))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's 5-word shingles; of fewer words, the hash of all; none without words."""
    if not text:
        return np.zeros(0, np.uint64)
    w = word_hashes(text.encode("utf-8", "surrogatepass"))
    if len(w) < WORDS:
        if not len(w):
            return w
        return fmix(np.array([(w * _MIX[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))], np.uint64))
    n = len(w) - WORDS + 1
    h = w[:n] * _MIX[0]
    for j in range(1, WORDS):
        h += w[j : j + n] * _MIX[j]
    return np.unique(fmix(h))


def sketch(s: np.ndarray) -> np.ndarray:
    """REGISTERS 16-bit registers of a sorted set: 0 is empty, else leading zeros and mantissa of the bucket's least hash."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(s):
        bucket = ((s >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)  # rises with s
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        least = np.minimum.reduceat(fmix(s ^ _MIX[5]), first)
        bits = np.maximum(least, np.uint64(1)).astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA)
        exponent, mantissa = bits >> np.uint64(MANTISSA), bits & np.uint64((1 << MANTISSA) - 1)
        zeros = np.uint64(1023 + 64) - exponent
        out[bucket[first].astype(np.int64)] = np.minimum((zeros << np.uint64(MANTISSA)) + mantissa + np.uint64(1), np.uint64(65535)).astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers: share of equal ones, less the share that different minima collide in.

    Different minima of like rank agree in the leading-zero count with probability 1/3 and in the mantissa with 2**-10.
    """
    used = ((a != 0) | (b != 0)).sum(-1)
    same = ((a == b) & (a != 0)).sum(-1)
    collide = 1 / 3 / (1 << MANTISSA)
    return (same / np.maximum(used, 1) - collide) / (1 - collide)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """Hashes of all bands."""
    r = registers.reshape(BANDS, ROWS).astype(np.uint64)
    keys = fmix((r * _MIX[:ROWS]).sum(1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_P))
    return keys.view(np.int64)


def first_shared_band(a: np.ndarray, b: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The first band that rows of registers agree in and have a key of (`many`: one of the sets has MANY shingles or more)."""
    a, b = a.reshape(len(a), BANDS, ROWS), b.reshape(len(b), BANDS, ROWS)
    return ((a == b).all(2) & ((a != 0).sum(2) >= np.where(many, 2, 1)[:, None])).argmax(1)


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, th, n, fp, sig): hash of the text, set size, digest of the set, registers; fp and sig are null without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.slice(at, 1000)
                n, fp, sig = [], [], []
                for text in b.column(2):
                    s = shingle_set(text.as_py())
                    n.append(len(s))
                    fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sig.append(sketch(s).tobytes() if len(s) else None)
                yield _batch(schema, [b.column(0), b.column(1), n, fp, sig])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, n long, fp binary, sig binary")


def band_rows(reps: DataFrame) -> DataFrame:
    """(doc, n, sig) -> (key, band, doc), one row a band in use.

    A set of MANY shingles or more leaves out bands with a single register in use, which any set with one common shingle may
    hold: the bands with two or more are enough for it (two sets of 72 and 96 shingles and similarity 0.75 miss each other in
    them with probability 2e-6).
    """
    schema = pa.schema([("key", pa.int64()), ("band", pa.int8()), ("doc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, bands = [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
            for n, s in zip(b.column(1).to_numpy(), b.column(2), strict=True):
                registers = np.frombuffer(s.as_buffer(), np.uint16)
                used = np.flatnonzero((registers.reshape(BANDS, ROWS) != 0).sum(1) >= (2 if n >= MANY else 1))
                keys.append(band_keys(registers)[used])
                bands.append(used.astype(np.int8))
            docs = np.repeat(b.column(0).to_numpy(), [len(k) for k in keys[1:]])
            yield _batch(schema, [np.concatenate(keys), np.concatenate(bands), docs])

    return reps.select("doc", "n", "sig").mapInArrow(run, "key long, band byte, doc long")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc, text) -> (doc, set array<long>)."""
    schema = pa.schema([("doc", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.slice(at, 500)
                yield _batch(schema, [b.column(0), [shingle_set(t.as_py()).view(np.int64) for t in b.column(1)]])

    return docs.select("doc", "text").mapInArrow(run, "doc long, set array<bigint>")


def likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches estimate at least LEAST_ESTIMATE."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(s.as_py() for s in b.column(i)), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            keep = np.flatnonzero(estimate(x, y) >= LEAST_ESTIMATE)
            yield _batch(schema, [b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep))])

    both = pairs.join(reps.select(F.col("doc").alias("a"), F.col("sig").alias("sa")), "a").join(reps.select(F.col("doc").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= PERCENT * union."""
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("doc").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb")).alias("s")).where(F.col("i") * 100 >= (F.col("s") - F.col("i")) * PERCENT).select("a", "b")


class Block:
    """Members of one or more tasks as arrays, with their registers."""

    def __init__(self, b: pa.RecordBatch):
        self.key, self.task, self.band, self.doc, self.comp = (b.column(c).to_numpy() for c in ("key", "task", "band", "doc", "comp"))
        self.side, self.n = b.column("side").to_numpy(), b.column("n").to_numpy()
        self.sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, REGISTERS)

    def likely(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of index pairs, those in different components that estimate high and meet here first; with the estimates."""
        keep = self.comp[i] != self.comp[j]
        i, j = i[keep], j[keep]
        out = []
        for at in range(0, len(i), 8192):
            x, y = i[at : at + 8192], j[at : at + 8192]
            e = estimate(self.sig[x], self.sig[y])
            keep = e >= LEAST_ESTIMATE
            x, y, e = x[keep], y[keep], e[keep]
            keep = first_shared_band(self.sig[x], self.sig[y], np.maximum(self.n[x], self.n[y]) >= MANY) == self.band[x] if len(x) else keep[:0]
            out.append((x[keep], y[keep], e[keep]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (i, j, np.zeros(0))


def meetings(live: DataFrame, comps: DataFrame, reps: DataFrame, partners: int | None) -> DataFrame:
    """Likely pairs (a, b) of documents that share a bucket and are in different components; `cut` names buckets with more.

    A bucket of up to ONE_BLOCK members is one task. In a larger one the largest component's members (side 1) meet only the others
    (side 0), and those meet each other; both are dealt in blocks by a hash. A pair is told only in the first bucket that it
    shares. With `partners`, a document in a group of more than SHIFTS members tells that many best estimates in each
    other component, and the bucket's key is told as cut if there were more; without, all.
    """
    x = live.join(comps.select(F.col("node").alias("doc"), "component"), "doc", "left").select("key", "band", "doc", F.coalesce("component", "doc").alias("comp"))
    per = x.groupBy("key", "comp").agg(F.count("*").alias("n"))
    per = per.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("m"), F.count("*").alias("c")).where("c > 1")
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    per = per.select("key", "m", F.col("top.comp").alias("major"), blocks(F.col("top.n"), LARGE_BLOCK).alias("cl"), blocks(F.col("m") - F.col("top.n"), SMALL_BLOCK).alias("cr"))
    x = x.join(per, "key").withColumn("is_l", F.col("comp") == F.col("major"))
    x = x.withColumn("at", F.pmod(F.xxhash64("doc"), F.when(F.col("is_l"), F.col("cl")).otherwise(F.col("cr"))).cast("int"))
    width = F.col("cl") + F.col("cr")
    rows_ = F.sequence(F.lit(0), F.col("cr") - 1)
    put = lambda task, side: F.struct(task.cast("int").alias("task"), F.lit(side).cast("byte").alias("side"))
    # task i * width + j: block i of side 0 against block j of side 1 (j < cl) or block j - cl >= i of side 0
    as_l = F.transform(rows_, lambda i: put(i * width + F.col("at"), 1))
    as_r = F.concat(
        F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.when((j < F.col("cl")) | (j - F.col("cl") >= F.col("at")), put(F.col("at") * width + j, 0))),
        F.transform(rows_, lambda i: F.when(i < F.col("at"), put(i * width + F.col("cl") + F.col("at"), 1))),
    )
    tasks = F.when(F.col("m") <= ONE_BLOCK, F.array(put(F.lit(0), 0))).when(F.col("is_l"), as_l).otherwise(F.array_compact(as_r))
    x = x.select("key", "band", "doc", "comp", F.explode(tasks).alias("t")).select("key", "band", "doc", "comp", "t.task", "t.side")
    x = x.join(reps.select("doc", "n", "sig"), "doc").select("key", "task", "side", "band", "doc", "comp", "n", "sig")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cut", pa.int64())])

    def told(block: Block, i: np.ndarray, j: np.ndarray, cut: int | None = None) -> pa.RecordBatch:
        x, y = block.doc[i], block.doc[j]
        cuts = pa.nulls(len(x), pa.int64()) if cut is None else pa.array([cut] * len(x), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), cuts], schema=schema)

    def large(block: Block, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        left, right = lo + np.flatnonzero(block.side[lo:hi] == 0), lo + np.flatnonzero(block.side[lo:hi] == 1)
        alone = not len(right)
        for n, i in enumerate(left):
            y = left[n + 1 :] if alone else right
            _, y, e = block.likely(np.full(len(y), i), y)
            cut = None
            if partners and len(y) > partners:
                y = y[np.lexsort((-e, block.comp[y]))]
                c = block.comp[y]
                place = np.arange(len(y))
                rank = place - np.maximum.accumulate(np.where(np.concatenate([[True], c[1:] != c[:-1]]), place, 0))
                cut = int(block.key[i]) if (rank >= partners).any() else None
                y = y[rank < partners]
            if len(y):
                yield told(block, np.full(len(y), i), y, cut)

    def small(block: Block, group: np.ndarray, in_small: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All groups of up to SHIFTS members at once: members d places apart, for each d."""
        for d in range(1, SHIFTS):
            i = np.flatnonzero((group[d:] == group[:-d]) & in_small[d:])
            if not len(i):
                break
            i, j, _ = block.likely(i, i + d)
            i, j = (x[(block.side[i] == 0) | (block.side[j] == 0)] for x in (i, j))
            if len(i):
                yield told(block, i, j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def work(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Block(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])
            new = np.concatenate([[True], (block.key[1:] != block.key[:-1]) | (block.task[1:] != block.task[:-1])])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(new)))
            group = np.cumsum(new)
            yield from small(block, group, np.repeat(size <= SHIFTS, size))
            for lo, n in zip(first[size > SHIFTS], size[size > SHIFTS], strict=True):
                yield from large(block, lo, lo + n)

        for whole in batches:
            for at in range(0, len(whole), 8192):
                b = whole.slice(at, 8192)
                key, task = b.column("key").to_numpy(), b.column("task").to_numpy()
                last = np.flatnonzero((key != key[-1]) | (task != task[-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield from work([*rest, b.slice(0, cut)])
                    rest = []
                elif rest and (rest[-1].column("key")[-1].as_py(), rest[-1].column("task")[-1].as_py()) != (int(key[-1]), int(task[-1])):
                    yield from work(rest)
                    rest = []
                rest.append(b.slice(cut))
        if rest:
            yield from work(rest)

    return x.repartition("key", "task").sortWithinPartitions("key", "task").mapInArrow(run, "a long, b long, cut long")


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, stays), one row for each row of (doc_id, text); th is a hash of the text.

    `stays` is true for one document of each component (the head's rows: least id, one text of it) and for rows that are
    linked with nothing. Runs its rounds when called.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    base = scratch.save(sketches(docs), "sketches")
    named = base.where("doc_id is not null and n > 0")
    classes = named.groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.count("*").alias("rows"))
    # a class of equal sets is a node, named by its least id; where texts of one id are in several classes, by a number of its own
    rows = named.join(classes.select("rep.*", "fp"), ["doc_id", "th", "fp"], "left_semi").select("doc_id", "th", "n", "fp", "sig")
    first = rows.dropDuplicates(["fp"])
    shared = first.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id", F.lit(True).alias("shared"))
    node = F.when(F.col("shared"), F.monotonically_increasing_id() + F.lit(-(1 << 63))).otherwise(F.col("doc_id"))
    reps = scratch.save(first.join(shared, "doc_id", "left").withColumn("doc", node).drop("shared"), "reps")

    again = rows.count() > reps.count()
    rows = band_rows(reps)
    buckets = rows.groupBy("key").agg(F.min("doc").alias("pivot"), F.count("*").alias("m")).where("m > 1").drop("m")
    live = scratch.save(rows.join(buckets, "key"), "live")
    wanted = live.select("doc").distinct().join(reps.select("doc", "doc_id", "th"), "doc")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").join(wanted, ["doc_id", "th"])
    if again:  # rows that agree in id and text
        texts = texts.dropDuplicates(["doc"])
    sets = scratch.save(shingle_sets(texts), "sets")

    # one partner each: the pivot (least number) of most shared buckets
    shared = live.where("doc <> pivot").groupBy("doc", "pivot").agg(F.count("*").alias("c"))
    best = shared.groupBy("doc").agg(F.max_by("pivot", F.struct("c", F.bitwise_not("pivot"))).alias("a")).select("a", F.col("doc").alias("b"))
    links = scratch.save(confirmed(likely(best, reps), sets), "links")
    comps = scratch.save(components(links, scratch), "components")
    todo, tried = live, None
    for partners in (PARTNERS, None):
        told = scratch.save(meetings(todo, comps, reps, partners), "pairs")
        pairs = told.select("a", "b").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        more = scratch.save(confirmed(pairs, sets), "links")
        if not more.isEmpty():
            # what is linked already is one component: its spanning links stand for all
            known = comps.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
            comps = scratch.save(components(known.unionByName(more), scratch), "components")
        # only buckets in which a document had more partners than it told go on, with those that were tried left out
        todo, tried = todo.join(told.where("cut is not null").select(F.col("cut").alias("key")).distinct(), "key", "left_semi"), told.select("a", "b").distinct()

    of = comps.join(reps.select(F.col("doc").alias("node"), "doc_id", "th"), "node")
    heads = of.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("head"))
    known = comps.join(heads, "component").select(F.col("node").alias("doc"), "head")
    info = reps.select("doc", "fp").join(known, "doc", "left").join(classes, "fp").select("fp", F.coalesce("head", "rep").alias("head"), F.col("rep").alias("mine"), "rows")
    info = scratch.save(info, "classes")
    # copies of one text may be a third of all rows: such classes, CLASSES at most, are broadcast and their rows stay where they are
    many = F.col("rows") > max(1, base.count() // CLASSES)
    common, rest = F.broadcast(info.where(many)), info.where(~many)
    told = named.join(common, "fp").unionByName(named.join(common, "fp", "left_anti").join(rest, "fp"))
    mine = (F.col("doc_id") == F.col("head.doc_id")) & (F.col("th") == F.col("head.th"))
    out = told.select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("head.doc_id").alias("component_id"), mine.alias("stays"))
    alone = base.where("doc_id is null or n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return out.unionByName(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of (doc_id, text); runs its rounds when called.

    Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z lowered. Texts are linked with 100 * intersection >= 75 * union of
    their distinct 5-word shingles (the whole sequence where there are fewer words); component_id is the smallest id reached
    over links, kept is doc_id = component_id. Null and empty texts and texts of spaces have no shingles and no links. A row
    with a null doc_id is linked with nothing, has a null component and is kept. Rows that repeat an id follow each its own
    text. An empty table gives an empty result; extra columns are not looked at.
    """
    return linked(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, of one document of each component: least id, and of its texts the head's.

    Documents are told apart by id and text: rows that agree in both are one document, and rows of one id with other texts go
    or stay by their own text. Rows without an id or without words stay. Columns of any other name are kept as they are. Ids are
    whole numbers, also as text; any other text is an error of the cast.
    """
    gone = linked(docs.select("doc_id", "text")).where(~F.col("stays")).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"))
    return rows.join(gone, ["_id", "_th"], "left_anti").select(*[F.col(f"_doc.`{c}`") for c in docs.columns])


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`near_duplicates` of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_neardup": op5_neardup}
ORACLE_SQL: dict[str, str] = {}
