"""Text, page and record functions (H1-H36)."""

from pyspark.sql import functions as F

from shortlens.catalog.registry import chunk_sql, query
from shortlens.functions import pages as pg
from shortlens.functions import records as rec
from shortlens.functions import text as tx
from shortlens.functions.fixed_values import (
    BLANKED_PUNCTUATION,
    JUNK_PHRASES,
    JUNK_WORDS,
    KEPT_STOPWORDS,
    PROMPT,
    STOPWORDS,
    TOPICS,
)
from shortlens.operators.aggregates import list_sizes, nest
from shortlens.plans.postings import posts_table


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


STOP_SQL = "[" + ", ".join(quoted(w) for w in STOPWORDS if w not in KEPT_STOPWORDS) + "]"
# Blanks in Unicode text, in the dialect of the SQL engine's regular expressions.
BLANK_SQL = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(text):
    return f"regexp_replace({text}, '^{BLANK_SQL}+|{BLANK_SQL}+$', '', 'g')"


def clean_sql(text):
    spaced = f"translate({text}, {quoted(BLANKED_PUNCTUATION)}, '{' ' * len(BLANKED_PUNCTUATION)}')"
    return strip_sql(f"regexp_replace({spaced}, '{BLANK_SQL}+', ' ', 'g')")


def ascii_sql(text):
    return strip_sql(f"regexp_replace({text}, '[^\\x00-\\x7F]+', '', 'g')")


def brackets_sql(text):
    return rf"regexp_replace({text}, '\([^()]*\)|\[[^\[\]]*\]|\{{[^{{}}]*\}}', '', 'g')"


def whitelist_sql(text):
    return f"regexp_replace({text}, '[^a-zA-Z+#/-_ ]', '', 'g')"


def tokens_sql(text):
    return rf"string_split_regex(regexp_replace({text}, '\s+$', ''), '\s')"


def stopped_sql(text):
    return f"array_to_string(list_filter({tokens_sql(text)}, lambda w: NOT list_contains({STOP_SQL}, lower(w))), ' ')"


def documents(t, text):
    return t("documents").select("doc_id", text.alias("text"))


def body():
    return F.col("text")


@query("h1_lower", "SELECT doc_id, lower(text) AS text FROM documents")
def _(t):
    return documents(t, tx.lower(body()))


@query("h2_ascii_only", f"SELECT doc_id, {ascii_sql('text')} AS text FROM documents")
def _(t):
    return documents(t, tx.ascii_only(body()))


@query("h3_drop_bracketed", f"SELECT page_id, {brackets_sql('html')} AS html FROM pages")
def _(t):
    return t("pages").select("page_id", tx.drop_bracketed(F.col("html")).alias("html"))


@query("h4_clean_text", f"SELECT doc_id, {clean_sql('text')} AS text FROM documents")
def _(t):
    return documents(t, tx.clean_text(body()))


@query("h5_keep_chars", f"SELECT doc_id, {whitelist_sql('text')} AS text FROM documents")
def _(t):
    return documents(t, tx.keep_chars(body()))


@query("h6_tokens", f"SELECT doc_id, len({tokens_sql('lower(text)')}) AS n, array_to_string({tokens_sql('lower(text)')}, '|') AS text FROM documents")
def _(t):
    found = tx.tokens(body())
    return t("documents").select("doc_id", F.size(found).cast("bigint").alias("n"), F.array_join(found, "|").alias("text"))


@query("h7_remove_stopwords", f"SELECT doc_id, {stopped_sql('lower(text)')} AS text FROM documents")
def _(t):
    return tx.remove_stopwords(t("documents").select("doc_id", "text"), "text")


@query("h7_remove_stopwords_keep_case", f"SELECT doc_id, {stopped_sql('text')} AS text FROM documents")
def _(t):
    return tx.remove_stopwords(t("documents").select("doc_id", "text"), "text", lowered=False)


@query("h8_join_words", "SELECT p_partkey, replace(p_name, ' ', ', ') AS label FROM part")
def _(t):
    return t("part").select("p_partkey", tx.join_words(F.split("p_name", " "), ", ").alias("label"))


@query("h9_words", r"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(text, '\s+|,\s*')) AS word FROM documents) GROUP BY 1, 2")
def _(t):
    return tx.words(t("documents").select("doc_id", "text"), "text").groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query("h10_word_chars", "SELECT doc_id, regexp_replace(text, '[^a-zA-Z+#/]', '', 'g') AS text FROM documents")
def _(t):
    return documents(t, tx.word_chars(body()))


@query(
    "h13_string_to_list",
    "SELECT p_partkey, array_to_string([p_name, p_brand, trim(p_type)], '|') AS items FROM part",
)
def _(t):
    printed = F.format_string("[%s, %s,   %s ]", "p_name", "p_brand", "p_type")
    return t("part").select("p_partkey", F.array_join(tx.string_to_list(printed), "|").alias("items"))


FUNCTION_SQL = """CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN p_type || ', and ' || p_brand || ' and ' || p_name
    ELSE p_type || ', ' || p_name END"""


def printed_criteria():
    """A printed map of criteria; every third part has none."""
    many = F.concat(F.col("p_type"), F.lit(", and "), F.col("p_brand"), F.lit(" and "), F.col("p_name"))
    job = F.when(F.col("p_size") % 3 == 1, many).otherwise(F.concat_ws(", ", "p_type", "p_name"))
    full = F.format_string("{Industry=%s, Job function=%s, Seniority level=%s}", "p_brand", job, "p_size")
    return F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("{Industry="), "p_brand", F.lit("}"))).otherwise(full)


@query("h14_extract_job_function", f"SELECT p_partkey, {FUNCTION_SQL} AS job_function FROM part")
def _(t):
    return t("part").select("p_partkey", tx.extract_job_function(printed_criteria()).alias("job_function"))


@query(
    "h15_split_functions",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Unlabelled' WHEN p_size % 3 = 1 THEN p_type || '|' || p_brand || '|' || p_name
    ELSE p_type || '|' || p_name END AS functions FROM part""",
)
def _(t):
    found = tx.split_functions(tx.extract_job_function(printed_criteria()))
    return t("part").select("p_partkey", F.array_join(found, "|").alias("functions"))


@query("h16_norm_content", "SELECT doc_id, replace(lower(text), '.', '') AS text FROM documents")
def _(t):
    return documents(t, tx.norm_content(body()))


JUNK_SQL = "(n IN (" + ", ".join(quoted(w) for w in JUNK_WORDS) + ") OR " + " OR ".join(f"contains(n, {quoted(p)})" for p in JUNK_PHRASES) + ")"


@query(
    "h17_is_junk",
    f"""SELECT o_orderkey, {JUNK_SQL} AS junk FROM (SELECT o_orderkey, replace(lower(CASE WHEN o_orderkey % 7 = 0 THEN 'N/A.'
    WHEN o_orderkey % 7 = 1 THEN 'none of it' ELSE o_orderpriority END), '.', '') AS n FROM orders)""",
)
def _(t):
    key = F.col("o_orderkey") % 7
    said = F.when(key == 0, "N/A.").when(key == 1, "none of it").otherwise(F.col("o_orderpriority"))
    return t("orders").select("o_orderkey", tx.is_junk(said).alias("junk"))


@query(
    "h18_normalize_badge",
    """SELECT p_partkey, CASE WHEN contains(p_name, 'bolt') THEN 'bolt' WHEN contains(p_name, 'red') THEN 'red'
    WHEN contains(p_name, 'ring') THEN 'ring' ELSE p_name END AS badge FROM part""",
)
def _(t):
    return t("part").select("p_partkey", tx.normalize_badge(F.col("p_name"), ["bolt", "red", "ring"]).alias("badge"))


@query(
    "h19_title_case",
    r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '\p{L}+|\P{L}+'),
    lambda w: CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(w[2:])), '') AS text FROM documents""",
)
def _(t):
    return documents(t, tx.title_case(body()))


@query(
    "h20_first_object",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '{"a": ' || props || '}' WHEN 2 THEN NULL ELSE props END AS found
    FROM events""",
)
def _(t):
    shape, props = F.col("event_id") % 4, F.col("props")
    text = (
        F.when(shape == 0, F.concat(F.lit("so } "), props))
        .when(shape == 1, F.concat(F.lit('Sure: {"a": '), props, F.lit("} and {more}")))
        .when(shape == 2, F.concat(F.lit('{"a": '), props))
        .otherwise(F.concat(F.lit("text "), props, F.lit(" }")))
    )
    return t("events").select("event_id", rec.first_object(text).alias("found"))


@query(
    "h21_parse_literal",
    """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
    CASE WHEN event_id % 5 <> 0 THEN event_type || '''s' END AS name, CASE WHEN event_id % 5 <> 0 THEN value > 50 END AS ok FROM events""",
)
def _(t):
    number = F.get_json_object("props", "$.k")
    ok = F.when(F.col("value") > 50, "True").otherwise("False")
    good = F.concat(F.lit("{'k': "), number, F.lit(", 'name': \""), "event_type", F.lit("'s\", 'none': None, 'ok': "), ok, F.lit("}"))
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("__import__('os')."), "event_type")).otherwise(good)
    parsed = rec.parse_literal(text, "k bigint, name string, ok boolean")
    return t("events").select("event_id", parsed.alias("r")).select("event_id", "r.k", "r.name", "r.ok")


@query("h21_parse_plain_literal", "SELECT event_id, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    text = F.format_string("{'kind': '%s', 'k': %s}", "event_type", F.get_json_object("props", "$.k"))
    parsed = rec.parse_literal(text, "kind string, k bigint", plain=True)
    return t("events").select("event_id", parsed.alias("r")).select("event_id", "r.kind", "r.k")


def unescaped_sql(text):
    """Entities as browsers read them, also where a cut left out the closing semicolon."""
    return f"regexp_replace(regexp_replace({text}, '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"


@query(
    "h22_element_text",
    f"""SELECT page_id, trim({unescaped_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}) AS heading,
    regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad, NULL::VARCHAR AS missing FROM pages""",
)
def _(t):
    fields = {"heading": ("h1", None, False), "ad": ("div", "ad", True), "missing": ("div", "none", False)}
    return t("pages").select("page_id", pg.element_fields(F.col("html"), fields).alias("f")).select("page_id", "f.*")


@query("h22_simple_element", "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def _(t):
    return t("pages").select("page_id", pg.simple_element(F.col("html"), "title").alias("title"))


@query(
    "h23_job_record",
    f"""SELECT page_id, trim({unescaped_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}) AS title,
    regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS description,
    trim({unescaped_sql("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")}) AS location FROM pages
    WHERE html LIKE '%<article>%'""",
)
def _(t):
    marks = {"title": ("h1", None), "description": ("article", None), "location": ("div", "ad")}
    found = t("pages").select("page_id", pg.job_record(F.col("html"), marks).alias("job")).filter("job is not null")
    return found.select("page_id", "job.title", "job.description", "job.location")


@query(
    "h23_job_cards",
    f"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS card FROM pages)
    SELECT page_id, {unescaped_sql("regexp_extract(card, 'href=.([^>]*).>', 1)")} AS url,
    {unescaped_sql("regexp_extract(card, '<a [^>]*>(.*)</a>', 1)")} AS company FROM c""",
)
def _(t):
    marks = {"card": ("li", None), "link": ("a", None), "company": ("a", None)}
    cards = t("pages").select("page_id", F.inline(pg.job_cards(F.col("html"), marks)))
    return cards.select("page_id", "url", "company")


@query(
    "h24_criteria_map",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN user_id ELSE event_id END AS viewed,
    CASE WHEN event_type = 'view' THEN 0 ELSE user_id END AS last FROM events""",
)
def _(t):
    again = F.when(F.col("event_type") == "view", "view").otherwise("last")
    names = F.array("event_type", F.lit("view"), F.lit("last"), again)
    values = F.array(F.lit(-1).cast("bigint"), "event_id", F.lit(0).cast("bigint"), "user_id")
    table = t("events").select("event_id", rec.criteria_map(names, values).alias("m"))
    return table.select("event_id", F.element_at("m", "view").alias("viewed"), F.element_at("m", "last").alias("last"))


@query("h25_render_prompt", "SELECT doc_id, replace(" + quoted(PROMPT) + ", '%s', text) AS prompt FROM documents")
def _(t):
    return t("documents").select("doc_id", tx.render_prompt(PROMPT, body()).alias("prompt"))


@query("h26_pipeline", f"SELECT doc_id, {clean_sql(ascii_sql(brackets_sql('lower(text)')))} AS text FROM documents")
def _(t):
    return documents(t, tx.pipeline(body(), [tx.drop_bracketed, tx.ascii_only, tx.clean_text]))


@query("h27_slug", "SELECT p_partkey, replace(lower(p_type || ' ' || p_name), ' ', '_') AS slug FROM part")
def _(t):
    return t("part").select("p_partkey", tx.slug(F.concat_ws(" ", "p_type", "p_name")).alias("slug"))


@query(
    "h28_parse_date",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '1800-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS posted
    FROM orders""",
)
def _(t):
    text = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t("orders").select("o_orderkey", tx.parse_date(text).cast("string").alias("posted"))


@query("h29_shard", "SELECT conv_id, turn, turn % 3 AS shard FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", tx.shard(F.col("turn"), 3).alias("shard"))


def nested_orders(t):
    return nest(t("orders"), "o_custkey", "o_orderkey", ["o_orderkey", "o_totalprice", "o_orderstatus"], "posts")


@query("h30_array_size", "SELECT o_custkey, count(*) AS jobs_number FROM orders GROUP BY 1")
def _(t):
    return list_sizes(nested_orders(t), "o_custkey", "posts", "jobs_number")


@query("h31_unnest", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders")
def _(t):
    rows = rec.unnest(nested_orders(t), "o_custkey", "posts", chunk="chunk")
    return rows.select("o_custkey", "item.o_orderkey", F.col("pos").cast("bigint").alias("pos"))


@query(
    "h32_struct_fields",
    f"""SELECT o_custkey, chunk, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS statuses, min(o_orderkey) AS first_order
    FROM (SELECT *, {chunk_sql("o_custkey", "o_orderkey")} AS chunk FROM orders) GROUP BY 1, 2""",
)
def _(t):
    statuses = F.array_join(rec.field_of(F.col("posts"), "o_orderstatus"), "")
    return nested_orders(t).select("o_custkey", "chunk", statuses.alias("statuses"), rec.first_of(F.col("posts"))["o_orderkey"].alias("first_order"))


@query("h33_with_defaults", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, '' AS title FROM events")
def _(t):
    filled = rec.with_defaults(F.from_json("props", "map<string,string>"), {"k": "0", "title": ""})
    return t("events").select("event_id", filled.alias("r")).select("event_id", "r.k", "r.title")


def order_payload(drop_some: bool = True):
    """A reply built from an order: wrong types, junk, unknown and missing topics included."""
    key = F.col("o_orderkey")
    title = F.when(key % 5 == 0, F.format_string('["%s"]', "o_orderstatus")).otherwise(F.format_string('"%s"', "o_orderpriority"))
    tasks = (
        F.when(key % 4 == 0, F.format_string('["%s", "Not specified."]', "o_orderstatus"))
        .when(key % 4 == 1, F.format_string('"%s"', "o_orderstatus"))
        .otherwise(F.format_string('["%s", "%s"]', "o_orderstatus", F.col("o_custkey")))
    )
    extra = F.when(key % 3 == 0, F.format_string(', "Salary": %s', "o_custkey")).otherwise("")
    return F.concat(F.lit('{"Job Title and Summary": '), title, F.lit(', "Job Responsibilities": '), tasks, extra, F.lit("}"))


REPAIRED_SQL = """CASE WHEN o_orderkey % 5 = 0 OR o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END AS title_and_summary"""


@query(
    "h34_repair_record",
    f"""SELECT o_orderkey, {REPAIRED_SQL}, CASE WHEN o_orderkey % 4 IN (0, 1) THEN '' ELSE o_orderstatus || '|' || o_custkey END
    AS responsibilities, '' AS education, 0 AS skills FROM orders""",
)
def _(t):
    fixed = t("orders").select("o_orderkey", rec.repair_record(order_payload()).alias("r"))
    return fixed.select(
        "o_orderkey",
        "r.title_and_summary",
        F.array_join("r.responsibilities", "|").alias("responsibilities"),
        "r.education",
        F.size("r.qualifications_and_skills").alias("skills"),
    )


@query(
    "h34_repair_record_per_item",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN '' ELSE o_orderstatus || '|' || o_custkey END
    AS responsibilities FROM orders""",
)
def _(t):
    fixed = t("orders").select("o_orderkey", rec.repair_record(order_payload(), per_item=True).alias("r"))
    return fixed.select("o_orderkey", F.array_join("r.responsibilities", "|").alias("responsibilities"))


@query(
    "h35_violations",
    """SELECT o_orderkey, 'Salary' AS topic, 'unknown topic' AS problem FROM orders WHERE o_orderkey % 3 = 0 UNION ALL
    SELECT o_orderkey, 'Job Title and Summary', 'wrong type' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL
    SELECT o_orderkey, 'Job Responsibilities', 'wrong type' FROM orders WHERE o_orderkey % 4 = 1""",
)
def _(t):
    return rec.violations(t("orders").withColumn("payload", order_payload()), "o_orderkey", "payload", TOPICS)


@query(
    "h36_to_jobs_parsed",
    f"""SELECT o_custkey AS url, o_orderkey AS idx, {REPAIRED_SQL}, strftime(o_orderdate, '%Y-%m-%d') AS posted,
    o_orderstatus AS benefit_badge, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders""",
)
def _(t):
    rows = t("orders").select(
        F.col("o_custkey").cast("string").alias("url"),
        F.col("o_orderkey").alias("idx"),
        rec.repair_record(order_payload()).alias("r"),
        F.col("o_orderdate").alias("posted"),
        F.col("o_orderstatus").alias("benefit_badge"),
        F.col("o_orderkey").cast("string").alias("job_url"),
    )
    nested = rec.to_jobs_parsed(rows.select("url", "idx", "r.*", "posted", "benefit_badge", "job_url"))
    return rec.unnest(nested, "url", "jobs_parsed", into="job", chunk="chunk").select(
        F.col("url").cast("bigint").alias("url"),
        F.col("job.job_url").cast("bigint").alias("idx"),
        "job.title_and_summary",
        F.col("job.posted").cast("string").alias("posted"),
        "job.benefit_badge",
        F.col("pos").cast("bigint").alias("pos"),
    )


def replies_of_orders(t):
    """Replies with talk around the dictionary, some without one, and raw posts that lack the pending orders."""
    key = F.col("o_orderkey")
    text = F.concat(F.lit("Sure! "), order_payload(), F.lit(" Anything {else}?"))
    payload = F.when(F.col("o_orderpriority") == "2-HIGH", F.lit("no answer } {}")).otherwise(text)
    replies = t("orders").select(key.alias("idx"), F.col("o_custkey").cast("string").alias("url"), payload.alias("payload"))
    raw = t("orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_custkey").cast("string").alias("url"),
        key.alias("idx"),
        F.col("o_orderpriority").alias("title"),
        F.col("o_orderdate").alias("posted"),
        key.cast("string").alias("job_url"),
        F.col("o_orderstatus").alias("benefit_badge"),
    )
    return replies, raw


@query(
    "posts_table",
    f"""SELECT CAST(o_custkey AS VARCHAR) AS url, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos,
    {REPAIRED_SQL}, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS title,
    CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS posted,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS benefit_badge FROM orders WHERE o_orderpriority <> '2-HIGH'""",
)
def _(t):
    table = posts_table(*replies_of_orders(t))[0]
    flat = rec.unnest(table, "url", "jobs_parsed", into="job", chunk="chunk")
    fields = ["job.title_and_summary", "job.title", F.col("job.posted").cast("string").alias("posted"), "job.benefit_badge"]
    return flat.select("url", F.col("pos").cast("bigint").alias("pos"), *fields)


@query(
    "posts_table_misses",
    """SELECT CAST(o_custkey AS VARCHAR) AS url, o_orderkey AS idx FROM orders
    WHERE o_orderpriority <> '2-HIGH' AND o_orderstatus = 'P'""",
)
def _(t):
    return posts_table(*replies_of_orders(t))[1].select("url", "idx")


@query(
    "posts_table_failures",
    """SELECT CAST(o_custkey AS VARCHAR) AS url, o_orderkey AS idx, 'no answer } {}' AS payload, 'no dictionary' AS reason FROM orders
    WHERE o_orderpriority = '2-HIGH'""",
)
def _(t):
    return posts_table(*replies_of_orders(t))[3]
