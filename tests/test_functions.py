"""Functions and operators on small cases with known answers."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from jobloom.functions import columns as C
from jobloom.operators import classify, language, load, location, phrases, shape, stats
from jobloom.streaming import jobs


def value(spark, expr, **cols):
    return spark.createDataFrame([Row(**cols)]).select(expr.alias("x")).first().x


def test_slugs_and_entities(spark):
    assert value(spark, C.slug(F.col("a")), a="Ünïçødé & Co. ") == "unic-de-co"
    assert value(spark, C.decode_entities(F.col("a")), a="a &amp;lt; &#65;&#x1F600; &nbsp;b &#55555;") == "a &lt; A\U0001f600  b �"
    assert value(spark, C.html_to_text(F.col("a")), a="<nav>x</nav><p>Hi <b>you</b></p><script>1</script>") == "Hi you"
    assert value(spark, C.strip_bilingual(F.col("a")), a="Seller / Pārdevējs") == "Seller"


def test_urls(spark):
    assert value(spark, C.safe_url(F.col("a")), a="[x](https://a.b/c)") == "https://a.b/c"
    assert value(spark, C.safe_url(F.col("a")), a="javascript:alert(1)") is None
    assert value(spark, C.host_slug(F.col("a")), a="jobs.careers.acme.com") == "acme"
    assert value(spark, C.absolute_url(F.lit("https://a.b/c/d?x#y"), F.col("a")), a="e.html") == "https://a.b/c/e.html"


def test_stats_keep_empty_groups(spark):
    countries = spark.createDataFrame([(1, "A", "a", 1), (2, "B", "b", 2)], "id int, name string, slug string, sort_order int")
    companies = spark.createDataFrame([(1, 1, None)], "id long, country_id int, updated_at timestamp")
    positions = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, 1, False)], "id long, company_id long, requires_native_language boolean")
    rows = {r.name: r for r in stats.country_stats(countries, companies, positions).collect()}
    assert (rows["A"].total_positions, rows["A"].english_positions, rows["A"].english_percentage) == (3, 2, 66.7)
    assert (rows["B"].total_positions, rows["B"].english_percentage) == (0, 0.0)
    cats = spark.createDataFrame([], "id int, name string")
    c = stats.company_stats(companies.withColumn("name", F.lit("x")), positions.withColumn("category_id", F.lit(1)), cats).first()
    assert c.categories is None


def test_net_changes_null_states(spark):
    log = spark.createDataFrame([(1, "a", 1, None, "x", 1), (2, "a", 1, "x", None, 2), (3, "a", 2, "y", None, 3), (4, "a", 3, "u", "v", 4)], "change_id long, entity_type string, entity_id long, before_state string, after_state string, changed_at long")
    assert {r.entity_id: r.action for r in stats.net_changes(log).collect()} == {1: "none", 2: "deleted", 3: "updated"}


def test_prune_never_deletes_all(spark):
    target = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "parent string, child int")
    keep = spark.createDataFrame([("a", 1), ("b", 9)], "parent string, child int")
    left = {tuple(r) for r in load.prune_children(target, target.select("parent"), keep, "parent", "child").select("parent", "child").collect()}
    assert left == {("a", 1), ("b", 1)}


def test_education_and_location(spark):
    assert value(spark, classify.education_floor(F.col("a")), a="Master’s or PhD") == "master"
    assert value(spark, classify.education_floor(F.col("a")), a="none") is None
    c, k = location.dictionaries(spark)
    df = spark.createDataFrame([(1, "Mo i Rana, Norway"), (2, "Nowhere"), (3, None), (4, "Riga central; Tartu")], "id long, location string")
    assert {r.id: r.codes for r in location.resolve_with_fallback(df, "id", c, k).collect()} == {1: ["NO"], 2: [], 3: [], 4: ["LV", "EE"]}


def test_prune_unmatched_list_is_an_error(spark):
    target = spark.createDataFrame([("a", 1)], "parent string, child int")
    with pytest.raises(ValueError):
        load.prune_children(target, target.select("parent"), spark.createDataFrame([("a", 9)], "parent string, child int"), "parent", "child")
    rows = spark.createDataFrame([(None,)], "title string")
    with pytest.raises(ValueError):
        load.split_valid(rows, {"title": F.col("title").isNotNull()})


def test_row_numbers_keep_nulls_and_split_ties(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, i long")
    for ties in (["i"], None):
        out = stats.row_numbers(df, "k", ties).collect()
        assert sorted(r["_no"] for r in out) == list(range(3000))
        got = [(r.k, r.i) for r in sorted(out, key=lambda r: r["_no"])]
        want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        assert [k for k, _ in got] == [k for k, _ in want] and (ties is None or got == want)
    assert stats.row_numbers(df.where("false"), "k").count() == 0 and stats.with_page(df.where("k is null"), "k", 10).count() == 1000


def test_phrase_borders(spark):
    d = spark.createDataFrame([(1, "python_dev"), (2, "_python_ and c++"), (3, "pythons"), (4, "use node.js, Python"), (5, None)], "id long, text string")
    p = spark.createDataFrame([(1, "Python"), (2, "c++"), (3, "node.js"), (4, "use python")], "phrase_id long, phrase string")
    hits = {(r.id, r.phrase_id): r.pos for r in phrases.phrase_hits(d, ["id"], "text", p).collect()}
    assert hits == {(1, 1): 1, (2, 1): 2, (2, 2): 14, (4, 1): 14, (4, 3): 5}
    assert {(r.id, r.phrase_id) for r in phrases.phrase_hits(d, ["id"], "text", p, "[a-z0-9_]").collect()} == {(2, 2), (4, 1), (4, 3)}


def test_language_lists_of_any_length(spark):
    text = value(spark, language.normalise_signal_text(F.lit("x"), F.col("a")), a="finnish/swedish/danish/norwegian/icelandic speaking")
    assert text == "x finnish speaking swedish speaking danish speaking norwegian speaking icelandic speaking"


def test_paragraph_languages(spark):
    """A paragraph needs two letters of the country's language, and 400 characters in languages that are taken for English."""
    de, pad = "der und die nicht mit ein ", "der und die nicht mit ein " * 30
    profile = spark.createDataFrame([("de", g, 10, 100) for g in {f" {w} "[i : i + 3] for w in de.split() for i in range(len(w))}], "lang string, gram string, n long, total long")
    rows = [(1, "DE", pad[:300]), (2, "DE", "über öl " + pad[:300]), (3, "FI", pad[:300]), (4, "FI", pad[:500]), (5, "CH", pad[:300])]
    out = {r.id: (r.native, r.foreign) for r in language.paragraph_languages(spark.createDataFrame(rows, "id long, country_code string, description string"), profile).collect()}
    assert out == {1: (None, None), 2: ("german", None), 3: (None, None), 4: (None, "german"), 5: ("german", None)}


def test_language_cascade_order(spark):
    """Whole postings: which rule decides, and the languages that it names."""
    cases = [
        ("FI", "Kehittäjä", "Fluent in Swedish.", "1a", ["Finnish"], []), ("DE", "Engineer", "German is a plus. You must speak Polish.", "1b", [], ["German"]), ("DE", "Engineer", "German is a plus. You must speak German.", "2a", ["German"], []),
        ("IT", "Engineer", "Knowledge of additional EU languages is a plus.", "1b-group", [], ["Italian"]), ("SE", "Engineer", "å" * 15, "1b-chars", ["Swedish"], []), ("SE", "Engineer", "å" * 14, "2c", [], []), ("DK", "Engineer", "å" * 10, "1b-chars", ["Danish"], []),
        ("US", "Engineer", "Dutch, French, and English: Full proficiency is required for all three languages.", "2a-all", ["Dutch", "French"], []), ("NO", "Engineer", "English in addition to Swedish, Danish or Norwegian.", "2a-generic", ["Norwegian"], []),
        ("PT", "Engineer", "Your local language (Portuguese).", "2a-generic", ["Portuguese"], []), ("JP", "Engineer", "You must speak Japanese.", "2a", ["Japanese"], []), ("ES", "Engineer", "You must speak Castellano.", "2a", ["Spanish"], []), ("GB", "Engineer", "Must speak Arabic.", "2a-cross", ["Arabic"], []),
    ]
    jobs_ = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "id long, country_code string, title string, description string")
    out = {r.id: (r.phase, r.required, r.preferred) for r in language.detect_language_requirement(jobs_).collect()}
    assert out == {i: c[3:] for i, c in enumerate(cases)}


def test_classify_postings_is_its_parts(spark):
    k = spark.createDataFrame([("data", 0, "data engineer", 0), ("sales", 1, "sales", 0)], "category string, cat_no int, keyword string, kw_no int")
    s = spark.createDataFrame([("Python", 0, ["python"]), ("Go", 1, ["golang", "go"])], "name string, skill_no int, aliases array<string>")
    rows = [(1, "DE", "Data Engineer", "Python_x, golang and a B.Sc. You must speak German.", None, None), (2, "DE", "Open application", "sales", None, True), (2, "SE", "Open application", "sales", None, True), (3, "US", None, None, "Sales", None)]
    jobs_ = spark.createDataFrame(rows, "id long, country_code string, title string, description string, function string, requires_native_language boolean")
    out = {(r.id, r.country_code): (r.category, r.skills, r.required_education, r.requires_native_language, r.required_languages) for r in language.classify_postings(jobs_, k, s).collect()}
    assert out == {(1, "DE"): ("data", ["Python", "Go"], "bachelor", True, ["German"]), (2, "DE"): ("other", [], None, True, []), (2, "SE"): ("other", [], None, True, []), (3, "US"): ("sales", [], None, False, [])}


def test_keyed_stream_store_replays_and_keeps_other_keys(spark, tmp_path):
    store = f"file://{tmp_path}/t"
    batch = lambda rows: spark.createDataFrame(rows, "k string, n int")
    jobs.merge_batch(batch([("a", 1), ("b", 1)]), store, "k", 0)
    for _ in range(2):  # the second time as after a lost driver
        jobs.merge_batch(batch([("b", 2), ("b", 3), ("c", 1)]), store, "k", 1)
    jobs.merge_batch(batch([]), store, "k", 2)
    assert sorted(tuple(r) for r in jobs.latest_version(spark, store).select("k", "n").collect()) == [("a", 1), ("b", 2), ("b", 3), ("c", 1)]


def test_merge_sources(spark):
    p = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, title string, location string")
    s = spark.createDataFrame([(1, "A", None), (3, "c", "z")], "id long, title string, location string")
    assert {tuple(r) for r in shape.merge_sources(p, s, "id").collect()} == {(1, "A", "x"), (2, "b", "y"), (3, "c", "z")}


FORM_CASES = [  # phrase, country, what decides
    ("{l} required", "2a"), ("Knowledge of {l} law", "2c"), ("Mother tongue {l}", "2a"), ("{l} (C1)", "2a"), ("Fluent in {l} or English", "2c"), ("Fluent {l} is nice-to-have", "2a"), ("Bonus points if you speak {l}", "2a"),
    ("Italian, {l}, Danish a bonus", "1b"), ("{l}, Danish, or other European languages are a strong advantage", "1b"), ("{l} speaking skills on top of that are seen as a plus", "1b"), ("{l} cuisine is a strong advantage", "2c"), ("Our {l} team", "2c"),
]


def test_every_phrase_form():
    """All phrases of the tables, around each name of a language, and forms that only the scanner can read."""
    from jobloom.operators import signals as s

    reader = s.Reader(s.Forms({"german": ["german", "deutsch"], "korean": ["한국어"]}))
    for name, country in (("german", "DE"), ("deutsch", "CH"), ("한국어", "KR")):
        said = lambda form: language.read_signals(s.one_line("Engineer", f"We build things. {form}. We are kind.".replace("{l}", name)), country, reader)  # noqa: B023, E731
        for form in s.REQUIRED:
            assert said(form)["own"]["says"] == "required" and said(form)["advantage"] is None, form
        for form in [f"{m} {x}" for m in s.MENTIONS for x in s.MODIFIERS] + s.WELCOME:
            assert said(form)["advantage"], form
    for group, forms in s.GROUP_REQUIRED.items():
        for form in forms:
            assert language.read_signals(f"we want {form}.".replace("{g}", group), s.GROUPS[group][0])["group_required"], form
    for group, forms in s.GROUP_WELCOME.items():
        for form in forms:
            assert language.read_signals(f"we want {form}.".replace("{g}", group), s.GROUPS[group][0])["group_plus"], form
            assert language.read_signals(f"we want {form}.".replace("{g}", group), "US")["group_plus"] is None


def test_phrases_brute_force():
    """The automaton finds what a look for every phrase in turn finds."""
    import random

    from jobloom.operators import signals as s

    rnd, reader = random.Random(5), s.Reader(s.Forms({"german": ["german"], "dutch": ["dutch", "flemish"]}))
    pool = [w for f in s.REQUIRED + s.MENTIONS + s.MODIFIERS for w in f.split()]
    for _ in range(300):
        text = " ".join(rnd.choice(["{l}", "{l}", *rnd.sample(pool, 6)]) for _ in range(40))
        text = "".join(rnd.choice(["german", "dutch", "flemish"]) if x == "{l}" else x for x in __import__("re").split(r"(\{l\})", text))
        r = reader.read(text)
        got = {(kind, a, b) for kind, hits in r.hits.items() for a, b, _, _ in hits}
        want = {(kind, i, i + len(p)) for p, kinds in s.Forms({}).phrases().items() for kind, _ in kinds for i in range(len(r.marked)) if r.marked.startswith(p, i)}
        assert got == want
        assert r.original(0, len(r.marked)) == text.strip()
        for kind, a, b in got:
            assert r.marked[a:b].count(s.NAME) == 0 or any(n in r.original(a, b) for n in reader.named), kind


def test_scanner_cases(spark):
    rows = [(i, "DE", "Engineer", f.replace("{l}", "German")) for i, (f, _) in enumerate(FORM_CASES)]
    out = {r.id: r.phase for r in language.detect_language_requirement(spark.createDataFrame(rows, "id long, country_code string, title string, description string")).collect()}
    assert out == {i: p for i, (_, p) in enumerate(FORM_CASES)}


def test_trigrams_are_counted_where_texts_are_read(spark):
    """One row a text and language leaves the reading of texts, not one a trigram; rows of one key count together, ties go by name."""
    docs = spark.createDataFrame([("en", "The cat, the hat"), ("de", "Die Katze"), ("de", None), ("de", "12 !"), (None, "die"), ("xx", "the 𝔘𝔫𝔦 Ⅳ")], "lang string, text string")
    want: dict = {}
    for lang, text in (("en", "the cat the hat"), ("de", "die katze"), ("xx", "the 𝔘𝔫𝔦")):
        for w in text.split():
            for i in range(len(w)):
                want[lang, f" {w} "[i : i + 3]] = want.get((lang, f" {w} "[i : i + 3]), 0) + 1
    profile = classify.build_lang_profile(docs)
    assert {(r.lang, r.gram): r.n for r in profile.collect()} == want
    rows = [(1, "cat"), (2, "Katze"), (3, "the"), (4, ""), (5, None), (6, "qqq"), (7, "die"), (7, "the the the the the the cat"), (8, "x" * 900_000 + " katze")]
    texts = spark.createDataFrame(rows, "id long, text string")
    got = classify.detect_lang(texts, ["id"], "text", profile)
    assert {r.id: r.detected for r in got.collect()} == {1: "en", 2: "de", 3: "en", 7: "en", 8: "de"}
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert classify.detect_lang(texts, ["id"], "text", profile.where("false")).count() == 0


def test_sentences_far_from_any_name_are_passed_over(monkeypatch):
    """What a text says is the same whether all of its words are read or the sentences around names alone; the rest makes no words."""
    import random

    from jobloom.operators import signals as s

    rnd = random.Random(3)
    forms = [f.replace("{g}", "nordic") for f in (*s.REQUIRED[::7], *s.WELCOME, *s.GENERIC, *s.GROUP_WELCOME["nordic"][::3], *s.GROUP_REQUIRED["nordic"])]
    forms += ["Local language skills at work are a plus", "Knowledge of additional EU languages is a plus", "Your local language ({l})", "In addition to a, b or {l}", "Danish, {l}, and English: Full fluency is required for all three languages", "{l} or English, depending on your location", "Bonus points if you speak {l}", "{l}, " * 60 + "or Danish a bonus"]
    filler = lambda: " ".join(rnd.choice(["we", "build", "node.js", "a/b", "x +", "e.g.", "things, all:", "or", "and/or", "done."]) for _ in range(rnd.choice([0, 5, 90, 200])))
    texts = [s.one_line(None, " ".join(filler() + rnd.choice([". ", " ", "\n"]) + rnd.choice(forms).replace("{l}", rnd.choice(["german", "Finnish", "danish"])) + rnd.choice([". ", ", ", " "]) for _ in range(rnd.randint(1, 4))) + filler()) for _ in range(1500)]
    countries = [rnd.choice(["DE", "FI", "DK", "US"]) for _ in texts]
    got = [language.read_signals(*x) for x in zip(texts, countries, strict=True)]
    monkeypatch.setattr(s, "MARGIN", 10**9)
    assert got == [language.read_signals(*x) for x in zip(texts, countries, strict=True)] and sum(g is not None for g in got) > 1400
    monkeypatch.undo()
    r = language._reader(None).read("we build. " * 50_000 + "must speak german. " + "we build. " * 50_000)
    assert r.requirements() == {"german": ("required", "must speak german")} and len(r.tokens) < 300


def test_names_of_languages_begin_a_word():
    """A word that holds a name's letters further on names no language; a word may go on behind a name."""
    said = lambda text, country: language.read_signals(text, country)
    for text in ("depending on the location you speak german. reestion and aanbleesti", "depending on your location: heesti"):
        assert not (said(text, "EE") or {}).get("conditional"), text
    assert said("depending on the location you speak eesti", "EE")["conditional"] and said("depending on location: deutschkenntnisse", "DE")["conditional"]
    assert said("depending on location, 流利的日本語", "JP")["conditional"] and said("depending on location (בעברית)", "IL")["conditional"]


def test_language_texts_of_a_megabyte(spark):
    """Texts that patterns with backtracking or recursion cannot read."""
    texts = ["word, and " * 120_000, "german, " * 130_000, "in addition to x or " * 50_000, "a/b skills " * 90_000, "and a, " * 150_000 + ": fluency is required for all the languages", "x" * 1_200_000, "(german) " * 120_000 + "is a plus", "local language " * 70_000]
    jobs_ = spark.createDataFrame([(i, "DE", "Engineer", t) for i, t in enumerate(texts)], "id long, country_code string, title string, description string").repartition(2)
    out = {r.id: r.phase for r in language.detect_language_requirement(jobs_).collect()}
    assert len(out) == len(texts) and out[0] == "2c" and out[6] == "1b"


def test_classify_prefers_html_and_leaves_names_out(spark):
    k = spark.createDataFrame([("data", 0, "data engineer", 0)], "category string, cat_no int, keyword string, kw_no int")
    s = spark.createDataFrame([("Go", 0, ["go"])], "name string, skill_no int, aliases array<string>")
    rows = [
        (1, "DE", "Role", "You must speak Polish.", "<p>You must speak <b>German</b>. We go.</p>", "Data Engineer", "Acme"), (2, "SE", "Engineer, Malmö", "We build.", None, None, "Fluent Swedish AB"),
        (3, "FI", "Engineer", "Fluent Finnish Oy is fluent finnish oy", None, None, "Fluent Finnish Oy"), (4, "FI", "Engineer", None, None, None, None),
    ]
    jobs_ = spark.createDataFrame(rows, "id long, country_code string, title string, description string, description_html string, classifier_title string, company string").withColumns({"function": F.lit(None).cast("string"), "requires_native_language": F.lit(None).cast("boolean")})
    out = {r.id: (r.category, r.required_languages, r.phase, r.skills) for r in language.classify_postings(jobs_, k, s, place_names=["Malmö", "Oslo"]).collect()}
    assert out == {1: ("data", ["German"], "2a", []), 2: ("other", [], "2c", []), 3: ("other", [], "2c", []), 4: ("other", [], "2c", [])}


def test_title_words_of_labelled_texts(spark):
    docs = spark.createDataFrame([("de", "Der Entwickler und der Leiter im Team " * 3), ("en", "The team lead in Berlin im"), ("fr", "le développeur senior " * 4), ("de", None), (None, "x y z")], "lang string, text string")
    words = classify.title_words(docs)
    assert sorted((r.lang, r.word) for r in words.collect()) == [("de", "der"), ("de", "entwickler"), ("de", "leiter"), ("de", "und"), ("fr", "développeur"), ("fr", "senior")]
    titles = spark.createDataFrame([(1, "Leiter und Entwickler (Senior)"), (2, "Senior team lead"), (3, None), (4, "Team"), (5, "Der Senior")], "id long, title string")
    assert sorted((r.id, r.lang) for r in classify.title_language(titles, "id", "title", words).collect()) == [(1, "de"), (2, "fr"), (5, "de")]
    assert classify.title_words(docs, top=1).count() == 2 and classify.title_language(titles.where("false"), "id", "title", words).count() == 0
