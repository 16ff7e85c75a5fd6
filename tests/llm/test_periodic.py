"""Periodic runs against brute force, edge rows, and the query over its table."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def runs(x):
    """All runs by every period: (start, length, smallest period)."""
    out = {}
    for q in range(1, len(x) // 2 + 1):
        t = 0
        while t < len(x) - q:
            s = t
            while t < len(x) - q and x[t] == x[t + q]:
                t += 1
            if t > s and t - s + q >= max(12, 2 * q):
                out.setdefault((s, t - s + q), q)
            t += t == s
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(words):
    gone = {i for s, n, q in runs(words) for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sequences(rnd):
    for _ in range(900):
        kind = rnd.randrange(4)
        if kind == 0:
            x = [rnd.randrange(2) for _ in range(rnd.randrange(150))]
        elif kind == 1:  # repeats in repeats
            x = [rnd.randrange(3) for _ in range(rnd.randrange(1, 6))]
            for _ in range(rnd.randrange(4)):
                x = x * rnd.randrange(1, 4) + x[: rnd.randrange(len(x) + 1)] + [rnd.randrange(3)] * rnd.randrange(2)
        elif kind == 2:  # stretches of one period meet out of step
            r = [rnd.randrange(2) for _ in range(rnd.randrange(1, 6))] * 60
            x = []
            for _ in range(rnd.randrange(2, 6)):
                a = rnd.randrange(6)
                x += r[a : a + rnd.randrange(5, 60)]
        else:
            x, y = [0], [0, 1]
            for _ in range(rnd.randrange(4, 8)):
                x, y = y, y + x
            x = y
        yield x[:300]


def test_runs_brute_force():
    from jobloom.llm.periodic import find_runs

    total = 0
    for x in sequences(random.Random(2)):
        want = runs(x)
        assert list(zip(*(a.tolist() for a in find_runs(np.array(x, np.int64))), strict=True)) == want, x
        total += len(want)
    assert total > 3000
    assert [a.tolist() for a in find_runs(np.zeros(300_000, np.int64))] == [[0], [300_000], [1]]


def test_operator_edges(spark):
    from jobloom.llm.periodic import periodic_runs

    rnd = random.Random(3)
    rows = [(i, " ".join("abc"[v] for v in x)) for i, x in enumerate(list(sequences(rnd))[:120])]
    # characters that are no separators here, though they are spaces
    rows += [(None, None), (None, "a " * 30), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "a b " * 14), (3, "a b " * 14), (4, "x" * 300_000), (5, "w " * 200_000), (6, "\x1c a\x1cb " * 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "_text": F.lit("mine"), "a b": F.lit(2)})
    got = periodic_runs(d).collect()
    assert len(got) == len(rows) and got[0]["a b"] == 2 and got[0]._text == "mine"
    for r in got:
        words = [w.decode() for w in (r.text or "").encode().split()]
        assert r.n_words == len(words)
        if len(words) < 1000:
            assert [tuple(x) for x in r.runs] == runs(words) and r.collapsed == collapsed(words)
        else:
            assert [tuple(x) for x in r.runs] == [(0, 200_000, 1)] and r.collapsed == "w"
    assert periodic_runs(d.where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_brute_force(spark):
    from jobloom.llm.periodic import op12_periodic_runs

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want, planted = {}, 0
    for row in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = [x.decode() for x in (row.text or "").encode().split()]
        h, n = zlib.crc32(str(row.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, planted = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)], planted + 1
        if n > 3000:  # the plain way takes the square
            continue
        found = runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        want[row.doc_id] = (len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(collapsed(w)))
    got = {r.doc_id: tuple(r)[1:] for r in op12_periodic_runs(spark, SF).collect()}
    assert planted > 5 and len(want) > 150 and {k: got[k] for k in want} == want
