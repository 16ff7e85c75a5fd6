"""Landing with quarantine, partition overwrites, counters, atomic commits and expiring state."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from jobloom.sources import tables
from jobloom.streaming import jobs


def test_land_by_row_and_by_file(spark, tmp_path):
    for name, lines in (("a", '{"k": 1}\n{"k": 2}\n'), ("b", '{"k": 3}\n{nope\n'), ("c", "")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_text(lines)
    rows = tables.read_json_landing(spark, f"file://{tmp_path}/in", "k long")
    good, bad = tables.land(rows, f"file://{tmp_path}/one")
    assert sorted(r.k for r in good.collect()) == [1, 2, 3] and [(os.path.basename(r.source_file), r.record) for r in bad.collect()] == [("b.json", "{nope")]
    good, bad = tables.land(rows, f"file://{tmp_path}/two", clean_files=True)
    assert sorted(r.k for r in good.collect()) == [1, 2] and bad.count() == 1
    good, bad = tables.land(rows.where("k < 3"), f"file://{tmp_path}/three")
    assert good.count() == 2 and bad.count() == 0


def test_replace_partitions_leaves_other_files(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    df = lambda rows: spark.createDataFrame(rows, "k long, v string")
    tables.replace_partitions(df([(i, f"a{i}") for i in range(200)]), at, "k", parts=8)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/t/*/*.parquet")}
    tables.replace_partitions(df([(7, "b"), (7, "c")]), at, "k", df([(7, ""), (9, "")]), parts=8)
    bucket = {r.k: r.b for r in df([(7, ""), (9, "")]).select("k", F.pmod(F.xxhash64("k"), F.lit(8)).alias("b")).collect()}
    after = set(glob.glob(f"{tmp_path}/t/*/*.parquet"))
    gone = {f.split("/")[-2] for f in set(before) - after}
    assert gone == {f"bucket={b}" for b in bucket.values()} and {f.split("/")[-2] for f in after} == {f"bucket={b}" for b in range(8)}
    got = {}
    for r in spark.read.parquet(at).collect():
        got.setdefault(r.k, []).append(r.v)
    assert sorted(got[7]) == ["b", "c"] and 9 not in got and all(got[i] == [f"a{i}"] for i in range(200) if i not in (7, 9))


def test_counters_come_with_the_write(spark, tmp_path):
    d = spark.range(100)
    assert tables.write_counted(d, f"file://{tmp_path}/c", {"all": F.lit(True), "even": F.col("id") % 2 == 0, "none": F.col("id") < 0}) == {"all": 100, "even": 50, "none": 0}
    assert spark.read.parquet(f"file://{tmp_path}/c").count() == 100
    assert tables.write_counted(d.where("false"), f"file://{tmp_path}/d", {"all": F.lit(True)}) == {"all": 0}


def test_tables_are_committed_together(spark, tmp_path, monkeypatch):
    store = f"file://{tmp_path}/s"
    batch = lambda n: {"a": (spark.createDataFrame([("x", n), (f"only{n}", n)], "k string, n int"), "k"), "b": (spark.createDataFrame([("x", 10 * n)], "k string, n int"), "k")}
    read = lambda: {t: sorted((r.k, r.n) for r in jobs.committed(spark, store, t).select("k", "n").collect()) for t in "ab"}
    with pytest.raises(FileNotFoundError):
        jobs.committed(spark, store, "a")
    jobs.commit_tables(batch(1), store, 0)
    first = read()
    assert first == {"a": [("only1", 1), ("x", 1)], "b": [("x", 10)]}

    class Lost(Exception):
        pass

    merge, seen = jobs.merge_batch, []

    def lost(rows, at, key, batch_id):
        if seen:
            raise Lost  # the driver goes between the two tables
        seen.append(at)
        merge(rows, at, key, batch_id)

    monkeypatch.setattr(jobs, "merge_batch", lost)
    with pytest.raises(Lost):
        jobs.commit_tables(batch(2), store, 1)
    assert read() == first and jobs.last_commit(spark, store) == 0
    monkeypatch.setattr(jobs, "merge_batch", merge)
    for _ in range(2):  # the batch runs again, and once more as if its note had been lost
        jobs.commit_tables(batch(2), store, 1)
        assert read() == {"a": [("only1", 1), ("only2", 2), ("x", 2)], "b": [("x", 20)]}


def test_expired_keys_are_told_again(spark, tmp_path):
    src = f"{tmp_path}/in"
    times = [[("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 12:00:00"), ("b", "2024-01-01 06:00:00")], [("a", "2024-01-02 00:00:00"), ("c", "2024-01-05 00:00:00")], [("b", "2024-01-06 00:00:00"), ("a", "2024-01-05 23:00:00"), ("a", "2024-01-06 22:59:59"), ("a", None)]]
    for rows in times:
        spark.createDataFrame(rows, "k string, t string").select("k", F.col("t").cast("timestamp").alias("t")).coalesce(1).write.mode("append").parquet(f"file://{src}")
    out = jobs.stream_expiring(jobs.read_stream(spark, f"file://{src}", "k string, t timestamp"), "k", "t", 86_400)
    jobs.run_to_table(out, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    got = sorted((r.k, str(r.t)) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == [("a", "2024-01-01 00:00:00"), ("a", "2024-01-02 00:00:00"), ("a", "2024-01-05 23:00:00"), ("b", "2024-01-01 06:00:00"), ("b", "2024-01-06 00:00:00"), ("c", "2024-01-05 00:00:00")]


def test_expiring_keys_share_calls(spark, tmp_path):
    """Python is called and state is kept for groups of keys, not for each key; what is told is what each key alone would tell."""
    import random

    src, rnd = f"{tmp_path}/in", random.Random(5)
    keys, said = [*range(2**60, 2**60 + 200), None], []
    for turn in range(3):
        rows = [(rnd.choice(keys), 86_400 * 10 * turn + rnd.randrange(86_400 * 10)) for _ in range(1_500)]
        said.append(rows)
        x = spark.createDataFrame(rows, "k long, s long").select("k", F.timestamp_seconds("s").alias("t"))
        x.coalesce(1).write.mode("append").parquet(f"file://{src}")
    want = []
    for k in keys:
        last = None
        for s in sorted(s for rows in said for x, s in rows if x == k):
            if last is None or s >= last + 2 * 86_400:
                last = s
                want.append((k, s))
    out = jobs.stream_expiring(jobs.read_stream(spark, f"file://{src}", "k long, t timestamp"), "k", "t", 2 * 86_400, key_groups=7)
    query = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").select("k", F.unix_seconds("t")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= 8


def test_broken_xml_file_is_told_once(spark, tmp_path):
    """However many of its rows cannot be read, a file's text is one record, and its other rows are there."""
    from jobloom.sources import tables

    (tmp_path / "in" / "part=1").mkdir(parents=True)
    (tmp_path / "in" / "part=1" / "a.xml").write_text("<jobs>" + "".join(f'<job id="{i}"><t>a&#7;</t></job>' for i in range(50)) + "</jobs>")
    (tmp_path / "in" / "part=1" / "b.xml").write_text('<jobs><job id="90"><t>ä</t></job><job id="91"><t>b</wrong></t></job></jobs>')
    (tmp_path / "in" / "part=1" / "c.xml").write_text('<jobs><job id="99"><t>c</t></job></jobs>')
    rows = tables.read_xml_landing(spark, f"file://{tmp_path}/in", "job", "_id bigint, t string")
    good, bad = tables.land(rows, f"file://{tmp_path}/out", clean_files=True)
    assert [tuple(r) for r in good.select("_id", "t", "part").collect()] == [(99, "c", 1)]
    found = sorted((r.source_file.rsplit("/", 1)[1], r.record) for r in bad.collect())
    assert [n for n, _ in found] == ["a.xml", "b.xml"] and found[0][1].count("<job ") == 50 and "ä" in found[1][1]


def test_landed_tables_are_cut_in_many_files(spark):
    """A task sorts a 48th of a landed table, not a third; rows of one value stay in one file, null ones too."""
    from jobloom.plans import streams
    from jobloom.plans.base import Tables

    d = spark.range(20_000).select((F.col("id") % 5_000).alias("k"), "id").unionByName(spark.sql("select cast(null as bigint) as k, 7L as id"))
    root, _ = streams.landed(Tables(spark, ""), d, "k")
    files = spark.read.parquet(f"{root}/in").groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n"), F.collect_set("k").alias("ks")).collect()
    assert len(files) > 40 and max(r.n for r in files) < 1_500 and sum(r.n for r in files) == 20_001
    assert sum(len(r.ks) for r in files) == 5_000


def test_payloads_of_a_batch_are_normalised_once(spark):
    """The normalised rows go through `save` once, and all steps read what it gives back."""
    from jobloom.operators.location import dictionaries
    from jobloom.sources.normalise import normalise_lever
    from jobloom.streaming import jobs

    batch = spark.createDataFrame([(1, "d", "lever", '[{"id": "a", "text": "Data engineer", "descriptionPlain": "You must speak German.", "categories": {"location": "Berlin, Germany"}}]')], "k long, day string, kind string, payload string")
    words = spark.createDataFrame([("data", 0, "data engineer", 0)], "category string, cat_no int, keyword string, kw_no int")
    saved = []

    def save(x):
        saved.append(x.collect())
        return spark.createDataFrame(saved[0], x.schema)

    out = jobs.enrich_payloads(batch, "k", "day", {"lever": normalise_lever}, words, *dictionaries(spark), save)
    assert [tuple(r) for r in out.collect()] == [(1, "a", "DE", "data", True, False, "d")] and len(saved) == 1
    assert "parse_json" not in out._jdf.queryExecution().optimizedPlan().toString()
