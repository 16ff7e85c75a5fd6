"""Selectors, elements and JSON in pages."""

import pytest
from pyspark.sql import functions as F

from jobloom.operators import location
from jobloom.sources import html as H
from jobloom.sources.selectors import Page, fits, parse

PAGE = """<html><body><nav class="x"><a href='/jobs/0'>Job zero</a></nav><div id=main class="list big">
<div class='card'><h3 class=t>First role</h3><a data-k="a,b" href='/jobs/1'>go</a><i class="city">Oslo</i><div class="card in"><b>inner</b></div> tail</div>
<p>one<p>two</p><ul><li>a<li>b <em>c</em></ul></div><aside class="left sidebar"><a href="/jobs/9">Side job</a></aside><a href=/job/2?x=1>Second role</a></body></html>"""


CARD, INNER, LINKS = "First role go Oslo inner tail", "inner", ["/jobs/0", "/jobs/1", "/jobs/9", "/job/2?x=1"]


@pytest.mark.parametrize(
    ("selector", "found"),
    [
        ("div.card", [CARD, INNER]), ("#main > div", [CARD]), ("div div.card.in", [INNER]), ("div.card div", [INNER]), (".car", []), ("a[href]", LINKS), ("a[href='/jobs/1']", LINKS[1:2]), ('[data-k="a,b"], h3', ["First role", "/jobs/1"]), ("a[href^=/job/]", LINKS[3:]),
        ("[href$='1'] ", [LINKS[1], LINKS[3]]), ("a[href*=jobs]", LINKS[:3]), ("body > * > div", [CARD]), ("li em", ["c"]), ("ul > li", ["a", "b c"]), ("p", ["one", "two"]), ("nav a, aside a", [LINKS[0], LINKS[2]]), ("html div > b", [INNER]), ("div > b", [INNER]), ("#main > b", []),
    ],
)
def test_selectors(selector, found):
    page = Page(PAGE)
    assert [e.attrs.get("href") or page.text(e) for e in page.find(selector)] == found


def test_selector_errors_and_brute_force():
    for bad in ("", "div >", "a[", "..x", "a:hover"):
        with pytest.raises(ValueError):
            parse(bad)
    page = Page("<a><b><a><b class=x><c></c></b></a></b></a>" * 3)
    for steps in ("a c", "a > b > a c", "b b c", "a > b c", "b.x > c"):
        words = steps.replace(">", " > ").split()

        def way(e, k):  # noqa: ANN001
            """Every chain of ancestors in turn."""
            tag, _, cls = words[k].partition(".")
            if e is None or e.tag != tag or cls and cls not in e.classes:
                return False
            if k == 0:
                return True
            direct, k2 = (True, k - 2) if words[k - 1] == ">" else (False, k - 1)
            p = e.parent
            while p is not None:
                if way(p, k2):
                    return True
                if direct:
                    return False
                p = p.parent
            return False

        assert [fits(e, parse(steps)[0]) for e in page.elements] == [way(e, len(words) - 1) for e in page.elements], steps


def frame(spark, *pages):
    return spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")


def test_pages_operators(spark):
    nested = "<article>" + "a" * 150 + "<article>" + "b" * 100 + "</article>" + "c" * 100 + "</article>"
    p = frame(spark, PAGE, None, "", nested, "<b>" * 20_000 + "deep", "<p>" * 100_000)
    got = {r.page_id: r.text for r in H.descriptions(p).collect()}
    assert got[1] is None and got[2] == "" and got[3].replace("\n", "") == "a" * 150 + "b" * 100 + "c" * 100 and got[4] == "deep"
    assert [(r.title, r.url) for r in H.links(p).orderBy("no").collect()] == [("Second role", "/job/2?x=1")]
    assert [(r.title, r.url, r.location) for r in H.cards(p, "#main > .card", title="b", url="a[href]", location="i").collect()] == [("inner", "/jobs/1", "Oslo")]
    assert [r.text for r in H.select(p, "div.card").orderBy("no").collect()] == ["First role go Oslo inner tail", "inner"]
    options = frame(spark, "<select name=c><option value='all'>All<option value=\"c-fi\">Finland<option value='c-se'>Sweden</select><ul class=f><li data-v=no>Norway</ul>")
    assert [(r.label, r.value) for r in H.select_options(options, "select[name=c] option", prefix="c-").orderBy("no").collect()] == [("All", "all"), ("Finland", "fi"), ("Sweden", "se")][1:]
    assert [(r.label, r.value) for r in H.select_options(options, "ul.f li", value="data-v").collect()] == [("Norway", "no")]


def test_json_scanner(spark):
    text = '{"a": "jobs", "jobs" : [1, {"x": "]}"}] tail ] "jobs": nope "jobs":[2]]"jobs":[{]'
    assert list(H.json_values(text, '"jobs"', "[")) == [[1, {"x": "]}"}], [2]]
    assert H.json_under(text, "a") == "jobs" and H.json_under(text, "zz") is None
    assert list(H.json_values('"k":' * 200_000, '"k"', "[")) == []
    page = '<script>push([1,"{\\"jobs\\":[{\\"t\\":\\"a\\"}"])</script>' + "x" * 1_000_000 + '<script>push([1,", {\\"t\\":\\"b\\"}]} and ]"])</script>'
    assert [r.t for r in H.script_json(frame(spark, page, None), "jobs", "t string").collect()] == ["a", "b"]


def test_work_modes_of_places(spark):
    said = ["Hybrid - Oslo", "On-site – Berlin (Remote)", "onsite-Rome", "Remote", "In-Office - X (Hybrid) ", "Baden-Baden - Hybrid", "Paris (12e)", "Remote (Hybrid)", "Mid-level - Rome", None]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "id long, x string")
    got = [r.y for r in d.select("id", location.without_work_mode(F.col("x")).alias("y")).orderBy("id").collect()]
    assert got == ["Oslo", "Berlin", "Rome", "Remote", "X", "Baden-Baden - Hybrid", "Paris (12e)", "Remote", "Mid-level - Rome", None]


def test_job_board_of_a_url_is_read_once(spark):
    """What a rule uses is bound to a name: the host is not read anew for each rule that asks for it."""
    from jobloom.sources.items import job_board

    d = spark.createDataFrame([(1, "https://www.ouraring.com/x"), (2, "https://apply.workable.com/"), (3, None), (4, "https://jobs.eu.lever.co/api/x"), (5, "https://b.c.myworkdaysite.com/recruiting/acme")], "id int, url string")
    x = d.select("id", job_board(F.concat("url", F.lit(""))).alias("b"))
    assert {r.id: tuple(r.b) for r in x.collect()} == {1: ("greenhouse", "oura", False), 2: ("workable", "apply", False), 3: (None, None, False), 4: (None, "lever", True), 5: ("workday", "acme", False)}
    assert x._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") < 20
