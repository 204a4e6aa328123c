import datetime as dt

import pytest
from pyspark.sql import functions as F
from shortlens import sources as src
from shortlens.functions import records as rec
from shortlens.functions.fixed_values import INDUSTRY_GROUPS
from shortlens.operators import aggregates as agg
from shortlens.operators import filters as flt
from shortlens.operators import joins as jn
from shortlens.operators import ranking as rk
from shortlens.operators import sets as st
from shortlens.plans import naming as nm
from shortlens.plans.companies import hiring_answers, hiring_by, target_companies
from shortlens.streaming.resume import append_new

COMPANY = "url string, industries string, company_size string, about string"
COMPANIES = [
    ("a", "Software Development", "11-50 employees", "x"),
    ("b", "Software Development", None, "x"),
    ("c", "Software Development", "None", "x"),
    ("d", "Software Development", "1 employee", "x"),
    ("e", "Software Development", "11-50 employees", None),
    ("f", "Banking", "51-200 employees", "x"),
    ("g", None, "51-200 employees", "x"),
]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_null_size_drops_like_small_ones(spark):
    df = spark.createDataFrame(COMPANIES, COMPANY)
    assert rows(flt.exclude_values(df, "company_size", ["None", "1 employee"]).select("url")) == [("a",), ("e",), ("f",), ("g",)]
    assert rows(target_companies(df).select("url")) == [("a",)]


def test_unknown_industry(spark):
    df = spark.createDataFrame([("Banking",), ("Alchemy",), (None,)], "industries string")
    with pytest.raises(Exception, match="Alchemy"):
        flt.map_values(df, "industries", INDUSTRY_GROUPS, "g").collect()
    found = {r.industries: r.g for r in flt.map_values(df, "industries", INDUSTRY_GROUPS, "g", "null").collect()}
    assert found == {"Banking": "Financial and Investment", "Alchemy": None, None: None}
    other = flt.map_values(df, "industries", INDUSTRY_GROUPS, "g", "default", "Other")
    assert {r.industries: r.g for r in other.collect()} == {"Banking": "Financial and Investment", "Alchemy": "Other", None: None}


def test_industry_table():
    assert len(INDUSTRY_GROUPS) == 148 and len(set(INDUSTRY_GROUPS.values())) == 12


def test_answers_retry_and_rate(spark):
    schema = "url string, status string, error_code int"
    first = spark.createDataFrame([("a", "No jobs", None), ("b", None, 0), ("c", "Jobs found!", None)], schema)
    second = spark.createDataFrame([("b", "Jobs found!", None)], schema)
    answers = hiring_answers(first, second)
    assert rows(answers) == [("a", False), ("b", True), ("c", True)]
    companies = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("z", "y")], "url string, kind string")
    jobs = spark.createDataFrame([("b",), ("b",), ("c",)], "url string")
    found = {r.kind: r for r in hiring_by(companies, answers, jobs, ["kind"]).collect()}
    assert (found["x"].companies, found["x"].known, found["x"].hiring, found["x"].rate, found["x"].jobs) == (2, 2, 1, 0.5, 2)
    assert (found["y"].companies, found["y"].known, found["y"].rate, found["y"].jobs_variance) == (2, 1, 1.0, None)


def test_fresh_keeps_undated_only_without_limit(spark):
    df = spark.createDataFrame([("a", "2024-01-02"), ("b", None), ("c", "2023-05-05"), ("d", "soon")], "url string, posted string")
    assert flt.fresh(df, "posted").count() == 4
    assert rows(flt.fresh(df, "posted", "2024-01-01").select("url")) == [("a",)]


def test_typed_dates_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "d")
    src.save(spark.sql("SELECT 'a' AS url, DATE '2024-01-02' AS posted UNION ALL SELECT 'b', NULL"), path)
    df = flt.fresh(spark.read.parquet(path), "posted", "2024-01-01")
    assert rows(df.select("url")) == [("a",)]
    assert "GreaterThanOrEqual(posted" in df._jdf.queryExecution().executedPlan().toString()


def test_page_status(spark):
    df = spark.createDataFrame([("<a wall>",), ("<a jobs>",), ("<p>",), (None,)], "html string")
    status, code = flt.page_status(F.col("html"), "wall", "jobs")
    assert [tuple(r) for r in df.select(status.alias("s"), code.alias("c")).collect()] == [
        (None, 0),
        ("Jobs found!", None),
        ("No jobs", None),
        (None, None),
    ]


def test_denoise_order(spark):
    schema = "id int, soft_cluster int, probability double, soft_probability double, soft_prob_initial double"
    data = [(1, 4, 0.9, 0.5, 0.0), (2, 4, 0.9, 0.5, 0.003), (3, 4, 0.19, 0.5, 0.5), (4, 4, 0.0, 0.1, 0.0), (5, 4, 0.3, 0.9, 0.9)]
    out = {r.id: r for r in flt.denoise(spark.createDataFrame(data, schema)).collect()}
    assert [out[i].soft_cluster for i in range(1, 6)] == [4, -1, -1, -1, 4]
    assert (out[1].probability, out[1].soft_probability) == (0.5, 0.0)


def test_size_stats_of_one_company(spark):
    df = spark.createDataFrame([("a",), ("a",)], "url string")
    assert rows(agg.size_stats(df, "url")) == [(1, 2, 2.0, 2.0, None)]


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(3,), (3,)], "n int")
    out = agg.histogram(df, "n", 2).orderBy("bin").collect()
    assert [(r.lower, r.upper, r.n) for r in out] == [(2.5, 3.0, 0), (3.0, 3.5, 2)]


def test_nest_and_unnest_agree_in_chunks(spark):
    df = spark.range(25).selectExpr("id % 2 as k", "id as o", "map('v', id) as m")
    nested = agg.nest(df, "k", "o", ["o", "m"], chunk_rows=5)
    assert nested.count() == 6
    back = nested.select("k", F.inline("items"))
    assert rows(back.selectExpr("k", "o", "m['v']")) == rows(df.selectExpr("k", "o", "m['v']"))
    first = nested.filter("k = 1 and chunk = 1").first()
    assert [i["o"] for i in first["items"]] == [11, 13, 15, 17, 19]


def test_chunks_are_part_of_the_key_at_every_size(spark):
    df = spark.range(25).selectExpr("1 as k", "id as o")
    nested = agg.nest(df, "k", "o", ["o"], chunk_rows=10)
    assert rows(nested.select("k", "chunk", F.size("items"))) == [(1, 0, 10), (1, 1, 10), (1, 2, 5)]
    assert rows(agg.list_sizes(nested, "k", "items")) == [(1, 25)]
    flat = rec.unnest(nested, "k", "items", chunk="chunk", chunk_rows=10)
    assert rows(flat.select("pos", "item.o")) == [(i, i) for i in range(25)]
    empty = agg.nest(df.limit(0), "k", "o", ["o"])
    assert empty.columns == ["k", "chunk", "items"] and empty.count() == 0


def test_equal_vectors_do_not_multiply(spark):
    df = spark.range(60).selectExpr("id", "array(cast(id div 20 as double), 1D) as v", "id div 20 as label")
    assert jn.join_on_vector(df.select("id", "v"), df.select("v", "label"), "v").count() == 60


def test_names_only_of_present_clusters(spark):
    df = spark.createDataFrame([(10, "red pen"), (4_000_000, "blue pen"), (7, "")], "cluster int, s string")
    out = nm.cluster_layers(df, "cluster", "s", 1, 1)
    assert sorted(r.cluster for r in out.collect()) == [7, 10, 4_000_000]


def test_positions_match_window_when_hot(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, null, id % 3) as k", "(id * 7919) % 5000 as o")
    hot = rk.with_position(df, "k", "o", hot_rows=100)
    plain = rk.with_position(df, "k", "o")
    assert hot.exceptAll(plain).count() == 0 and hot.count() == 5000


def test_top_words_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, w) for w in "b b a a c".split()], "cluster int, word string")
    out = rk.top_words(df, "cluster", "word", 2)
    assert rows(out.select("word", "rank")) == [("a", 1), ("b", 2)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_occurrences_keep_null_rows(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "s string")
    assert sorted(r.occurrences for r in rk.with_occurrences(df, "s").collect()) == [1, 2, 2]


def test_not_in_keeps_duplicates_and_lookup_takes_first(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "url string")
    b = spark.createDataFrame([("y",)], "url string")
    assert rows(jn.not_in(a, b, "url")) == [("x",), ("x",)]
    meta = spark.createDataFrame([("x", 2, "late"), ("x", 1, "early")], "url string, n int, badge string")
    assert rows(jn.lookup_first(b.union(a.limit(1)), meta, "url", "n").na.fill("-")) == [("x", "early"), ("y", "-")]


def test_missing_ids_and_supplement(spark):
    df = spark.createDataFrame([(1, ["a"]), (4, ["b"])], "cluster int, words array<string>")
    full = st.supplement(df, jn.missing_ids(df, "cluster"), "cluster", "words")
    assert rows(full) == [(1, ["a"]), (2, ["Unlabelled"]), (3, ["Unlabelled"]), (4, ["b"])]
    assert jn.missing_ids(df.limit(0), "cluster").count() == 0


def test_payload_round_trip(spark, tmp_path):
    data = [(1, 'a "quoted"\r\nline, two'), (2, ""), (3, None), (4, "x" * 200_000)]
    path = str(tmp_path / "p")
    src.append_csv(spark.createDataFrame(data, "idx int, payload string"), path)
    assert rows(src.read_payload_csv(spark, path, "idx int, payload string").na.fill("~")) == [
        (1, 'a "quoted"\r\nline, two'),
        (2, ""),
        (3, "~"),
        (4, "x" * 200_000),
    ]


def test_answers_file_has_one_header_per_part(spark, tmp_path):
    path = str(tmp_path / "a")
    df = spark.createDataFrame([("u", True), ("v", None)], "url string, hiring boolean").coalesce(1)
    src.write_answers(df, path)
    src.write_answers(df, path, append=True)
    back = spark.read.schema("url string, hiring boolean").option("header", True).csv(path)
    assert sorted(map(str, rows(back))) == ["('u', True)"] * 2 + ["('v', None)"] * 2


def test_materialize_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("a", 1), ("b", 2)], "category string, n int")

    for _ in range(2):
        assert rows(src.materialize(spark, str(tmp_path / "m"), build, "category").select("category", "n")) == [("a", 1), ("b", 2)]
    assert calls == [1]


def test_append_new_resumes(spark, tmp_path):
    source, target, progress = (str(tmp_path / p) for p in ("in", "out", "done"))
    schema = "idx int, payload string"
    for i in range(2):
        src.append_csv(spark.createDataFrame([(i, "line\nbreak")], schema), source)
        append_new(spark, source, schema, lambda df: df.withColumn("n", F.length("payload")), target, progress)
        assert spark.read.parquet(target).count() == i + 1
    append_new(spark, source, schema, lambda df: df.withColumn("n", F.length("payload")), target, progress)
    assert rows(spark.read.parquet(target)) == [(0, "line\nbreak", 10), (1, "line\nbreak", 10)]


def test_sample_repeats(spark):
    df = spark.range(1000)
    one, two = rk.sample_n(df, 50, "id", 1), rk.sample_n(df.repartition(7), 50, "id", 1)
    assert rows(one) == rows(two) != rows(rk.sample_n(df, 50, "id", 2))


def test_upsert_keeps_types(spark):
    a = spark.createDataFrame([(1, dt.date(2024, 1, 1))], "k int, d date")
    assert rows(jn.upsert(a, a.limit(0), "k")) == [(1, dt.date(2024, 1, 1))]


def test_materialize_keeps_values_and_rebuilds_half_tables(spark, tmp_path):
    path = str(tmp_path / "m")
    built = spark.createDataFrame([("007", 1), ("7", 2), ("", 3), (None, 4)], "category string, n int")
    stored = src.materialize(spark, path, lambda: built, "category")
    assert stored.columns == ["category", "n"]
    assert sorted(map(tuple, stored.collect()), key=str) == sorted([("007", 1), ("7", 2), ("", 3), (None, 4)], key=str)
    (tmp_path / "m" / "_SUCCESS").unlink()
    other = spark.createDataFrame([("a", 5)], "category string, n int")
    assert [tuple(r) for r in src.materialize(spark, path, lambda: other, "category").collect()] == [("a", 5)]
