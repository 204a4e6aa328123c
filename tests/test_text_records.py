import json

from pyspark.sql import functions as F
from shortlens.functions import pages as pg
from shortlens.functions import records as rec
from shortlens.functions import text as tx
from shortlens.plans import embedding as em
from shortlens.plans import naming as nm
from shortlens.plans.postings import posts_table


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").repartition(3)
    return [r[0] for r in df.select(make(F.col("s")).alias("o"), "i").orderBy("i").select("o").collect()]


def test_cleaning_agrees_with_plain_python(spark):
    texts = ["  Söme  (x [y]) text!  ", "a\tb\n\nc", "C++/C# .NET, e@x", "", "   ", None, "((nested) out)"]
    table = str.maketrans("!\"$%&'()*-/:;<=>?[\\]^_`{|}~", " " * 27)
    expected = [None if t is None else " ".join(t.translate(table).split()) for t in texts]
    assert column(spark, texts, tx.clean_text) == expected
    import re

    expected = [None if t is None else re.sub(r"[^\x00-\x7F]+", "", t).strip() for t in texts]
    assert column(spark, texts, tx.ascii_only) == expected
    assert column(spark, ["((nested) out)", "a [b] {c}"], tx.drop_bracketed) == ["( out)", "a  "]
    assert column(spark, ["a-b_c;d.e 1,#"], tx.keep_chars) == ["ab_c;de 1#"]


def test_title_case_like_python(spark):
    texts = ["c++/java devs", "o'NEIL", "éa ßb", "", "1st x2y", None]
    assert column(spark, texts, tx.title_case) == [None if t is None else t.title() for t in texts]


def test_stopwords_keep_it_and_case(spark):
    df = spark.createDataFrame([(1, "The IT team and it"), (2, None)], "i int, s string")
    assert [r.s for r in tx.remove_stopwords(df, "s").orderBy("i").collect()] == ["it team it", None]
    assert tx.remove_stopwords(df, "s", lowered=False).orderBy("i").first().s == "IT team it"


def test_legacy_strings(spark):
    assert column(spark, ["[a, b]", "[]", "[a,  b ]"], tx.string_to_list) == [["a", "b"], [""], ["a", "b"]]
    text = "{Industry=Z, Job function=X, and Y, Seniority level=Z}"
    assert column(spark, [text, ""], tx.extract_job_function) == ["X, and Y", ""]
    assert column(spark, ["X, and Y and Z, W", "", None], tx.split_functions) == [["X", "Y", "Z", "W"], ["Unlabelled"], None]


def test_badges_and_junk(spark):
    texts = ["Be an early applicant now", "Medical insurance, Actively Hiring", "other", None]
    assert column(spark, texts, tx.normalize_badge) == ["Be an early applicant", "Actively Hiring", "other", None]
    assert column(spark, ["N.A.", "None", "Pay not specified here", "ok", " "], tx.is_junk) == [True, True, True, False, True]


def test_no_python_in_text_plans(spark):
    df = spark.createDataFrame([("a",)], "s string")
    steps = [tx.drop_bracketed, tx.ascii_only, tx.clean_text, tx.title_case, tx.norm_content, tx.slug]
    plan = df.select(tx.pipeline(F.col("s"), steps))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_first_object(spark):
    texts = ['x {"a": {"b": 1}} y {z}', "} {a}", "{ {a}", 'p {"q": "}"} r', None, "none"]
    assert column(spark, texts, rec.first_object) == ['{"a": {"b": 1}}', None, None, '{"q": "}', None, None]
    assert column(spark, texts[3:4], lambda c: rec.first_object(c, quoted=True)) == ['{"q": "}"}']
    assert column(spark, ["{'it\\'s': '{'} x"], lambda c: rec.first_object(c, quoted=True)) == ["{'it\\'s': '{'}"]


def test_literals_are_read_and_never_run(spark):
    texts = ["{'a': None, 'b': True, 'c': \"it's\"}", "__import__('os').getcwd()", "{", None]
    assert column(spark, texts, rec.literal_to_json) == ['{"a": null, "b": true, "c": "it\'s"}', None, None, None]


def test_criteria_last_wins(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["1", "2", "3"])], "n array<string>, v array<string>")
    assert df.select(rec.criteria_map(F.col("n"), F.col("v")).alias("m")).first().m == {"b": "2", "a": "3"}


PAGE = """<html><body><h1 class="t big">Dev &amp; <i>Ops</i></h1><div class="d"><p>One<br>two</p><div>in</div></div>
<ul class="c"><li class="i"><h3 class="k"> Job function </h3><span class="v"> IT </span></li></ul><script>var h="<h1>";</script></body></html>"""
MARKS = {
    "title": ("h1", "t"),
    "description": ("div", "d"),
    "criteria_list": ("ul", "c"),
    "criteria_item": ("li", "i"),
    "criteria_name": ("h3", "k"),
    "criteria_value": ("span", "v"),
}


def test_pages(spark):
    wall = '<a class="join-form__form-body-submit-button">x</a><div class="d">y</div>'
    assert column(spark, [PAGE, "<p>", None], lambda c: pg.element_text(c, "h1", "t big")) == ["Dev &Ops", None, None]
    assert column(spark, [PAGE], lambda c: pg.element_text(c, "div", "d", inner=True)) == ["<p>One<br>two</p><div>in</div>"]
    jobs = column(spark, [PAGE, wall, "<p>", None], lambda c: pg.job_record(c, MARKS))
    assert jobs[1:] == [None, None, None]
    assert (jobs[0].title, jobs[0].location, jobs[0].criterias) == ("Dev &Ops", None, {"Job function": "IT"})


def test_cards(spark):
    page = """<div class="base-card x job-search-card"><a class="base-card__full-link" href="/j1">J</a>
    <span class="job-posting-benefits__text"> Actively Hiring </span><time class="job-search-card__listdate" datetime="2024-04-01">
    </time><a class="hidden-nested-link">Acme</a></div><div class="base-card job-search-card"><p>no link</p></div>"""
    (cards,) = column(spark, [page], pg.job_cards)
    assert [tuple(c) for c in cards] == [("/j1", "Actively Hiring", "2024-04-01", "Acme")]


def reply(**topics):
    return "Sure! " + str({"Job Title and Summary": "T", **{k.replace("_", " "): v for k, v in topics.items()}}) + " done"


def test_posts_table(spark):
    replies = [
        (0, "u", reply(Job_Responsibilities=["a", "b"], Company_Overview="N.A.")),
        (2, "u", reply(Job_Responsibilities="text", Required_Education=["x"], Salary=3)),
        (1, "u", "no answer"),
        (3, "u", "{broken: }"),
        (4, "u", None),
        (5, "u", 'Here: {"Job Title and Summary": "plain JSON", "Required Education": null, "Job Responsibilities": ["c"]}'),
        (0, "w", reply(Benefits_and_Perks=["gym", "Not specified"])),
    ]
    raw = [("u", i, f"title {i}", "badge") for i in (0, 1, 2, 5)]
    parsed = spark.createDataFrame(replies, "idx int, url string, payload string")
    raws = spark.createDataFrame(raw, "url string, idx int, title string, benefit_badge string")
    table, misses, wrong, failures = posts_table(parsed, raws)
    assert not any(f.nullable for f in table.schema) and table.columns == ["url", "chunk", "jobs_parsed"]
    assert sorted((r.idx, r.payload, r.reason) for r in failures.collect()) == [
        (1, "no answer", "no dictionary"),
        (3, "{broken: }", "unreadable dictionary"),
        (4, None, "no reply"),
    ]
    posts = {r.url: r.jobs_parsed for r in table.collect()}
    assert [p.title for p in posts["u"]] == ["title 0", "title 2", "title 5"]
    assert posts["u"][2].title_and_summary == "plain JSON" and posts["u"][2].responsibilities == ["c"]
    assert posts["u"][0].responsibilities == ["a", "b"] and posts["u"][0].company_overview == ""
    assert posts["u"][1].responsibilities == [] and posts["u"][1].education == ""
    assert posts["w"][0].benefits == [] and posts["u"][0].benefit_badge == "badge"
    assert [(r.url, r.idx) for r in misses.collect()] == [("w", 0)]
    assert sorted((r.idx, r.topic, r.problem) for r in wrong.collect()) == [
        (2, "Job Responsibilities", "wrong type"),
        (2, "Required Education", "wrong type"),
        (2, "Salary", "unknown topic"),
        (5, "Required Education", "wrong type"),
    ]
    kept = posts_table(parsed, raws, per_item=True)[0].filter("url = 'w'").first().jobs_parsed
    assert kept[0].benefits == ["gym"]


def test_null_and_default_topics(spark):
    payload = json.dumps({"Job Title and Summary": None, "Job Responsibilities": None})
    df = spark.createDataFrame([(payload,), ("not json",), (None,)], "p string")
    for r in df.select(rec.repair_record(F.col("p")).alias("r")).collect():
        assert r.r.title_and_summary == "" and r.r.responsibilities == []


def test_embedding_covers_every_row_once(spark):
    data = [(1, "x", "Red (big) Bolt"), (2, "y", "red bolt"), (3, "x", None), (4, "x", "the and"), (5, "y", "Red Bolt")]
    df = spark.createDataFrame(data, "index long, kind string, sentence string")
    out = em.embed_sentences(df, steps=[tx.drop_bracketed], category="kind", normalize=True)
    found = {r["index"]: r for r in out.collect()}
    assert set(found) == {1, 2, 4, 5} and found[1].sentence_cleaned == "red  bolt" and found[5].sentence_cleaned == "red bolt"
    assert found[2].embedding == found[5].embedding


def test_pos_filter_keeps_order_and_whole_sentence(spark):
    df = spark.createDataFrame([(1, "cold bolt ring bolt"), (2, "cold old"), (3, None)], "i int, s string")
    lexicon = spark.createDataFrame([("bolt", "NN"), ("ring", "NNS"), ("cold", "JJ")], "word string, pos string")
    assert [r.s for r in nm.keep_pos(df, "s", lexicon).orderBy("i").collect()] == ["bolt ring bolt", "cold old", None]
    assert nm.keep_pos(df, "s", lexicon, ("N", "J")).filter("i = 2").first().s == "cold"


def test_hierarchical_names_regroup(spark):
    data = [(1, "a a b b c"), (2, "a b c"), (3, "z"), (5, "a b b c")]
    df = spark.createDataFrame(data, "soft_cluster int, sentence_cleaned string")
    options = {"min_word_len": 1, "fill_gaps": True}
    out = {r.soft_cluster: r for r in nm.hierarchical_layers(df, "soft_cluster", "sentence_cleaned", 1, 3, **options).collect()}
    assert [out[1][c] for c in nm.layer_names(3, 1)] == ["a, b, c", "a, b", "a"]
    assert out[5].layer_0 == "b, a, c" and out[5].layer_1 == "b, a"
    assert out[3].layer_0 == "Unlabelled" and out[4].layer_2 == "Unlabelled"


def test_job_record_does_not_wait_for_thousands_of_pages(spark):
    page = "<h1>Cook</h1><article>" + "x" * 50 + "</article><div class='ad'>Here</div>"
    marks = {"title": ("h1", None), "description": ("article", None), "location": ("div", "ad")}
    df = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "id int, html string")
    out = df.select("id", pg.job_record(F.col("html"), marks).alias("job"))
    assert "ArrowEvalPython" not in out._jdf.queryExecution().toString()
    found = {r["id"]: r["job"] for r in out.collect()}
    assert found[2] is None and found[3] is None
    assert found[1].asDict() == {"title": "Cook", "description": "x" * 50, "location": "Here", "post_time": None, "criterias": {}}
