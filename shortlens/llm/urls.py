"""URL filters: written rules first, then rules that FP-growth mines from labels. DataFrame functions only.

A URL is a set of items: scheme, host, every suffix and label of the host, every leading part of its folders, the words of
labels, folders and the file name, extension, query keys, anchor. Items that the same labelled URLs have are one class and are
mined once. Items inside each other would multiply what FP-growth counts, so a URL is seen from several views: each takes
at most one host suffix and one leading part of the folders, and only labels and words that neither of them holds. A set with an
item that another one implies is in no view; it fits the same URLs as the set without it. Supports inside a view are exact.

Every set with the mark of bad URLs is a rule candidate: its support is the count with the mark, its confidence the share of
that in the count without. Rules are matched by an inverted index from item to rule: a URL fits a rule when it meets it in each class.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlens.llm.common import store

MIN_SUPPORT = 0.002
MIN_ROWS = 30
MIN_CONFIDENCE = 0.6
# Largest table of items, in bytes of text, that is sent to every task.
BROADCAST_BYTES = 16_000_000
# Stands in FP-growth for the label; no item is called so, since items have a kind and a colon.
MARK = "bad"
# Kinds of items, in the order in which one stands for the others that the same URLs have.
SUFFIX, FOLDERS, HOST_WORD, PATH_WORD, SINGLE = range(5)
ITEM = "struct<item:string,kind:int,depth:int>"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; only A to Z become lower case. Null or no `://`: empty."""
    rest = F.regexp_extract(_rest(url), "^([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def written_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest written rule that fits; null where none does. A rule is (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, text in sorted(rules, key=lambda r: len(r[1])):  # longer ones are asked first
        own_host, _, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith("/" + own_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(name)).otherwise(verdict)
    return rule, verdict


def _words(name: Column) -> Column:
    return F.split(F.lower(name), r"[^\p{L}\p{N}]+")


def _with(value: Column, use) -> Column:
    """`use(value)` with the value worked out once; inside lambdas an expression is worked out again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def items_of(url: Column, host: Column, path: Column) -> Column:
    """The items of a URL, array<struct<item, kind, depth>>, each once at its least depth; a port or a user name belongs to the host only.

    A suffix of n labels and a leading part of n folders have depth n; a label or word has that of the shortest suffix or leading
    part that holds it.
    """
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.array_join(F.array_sort(F.transform(F.split(query, "&"), lambda pair: F.substring_index(pair, "=", 1))), "&")
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    parts = F.split(path, "/")
    file = F.regexp_replace(F.element_at(parts, -1), r"\.[A-Za-z0-9]+$", "")
    above = F.when(F.size(parts) > 2, F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))

    def made(kind: int, prefix: str, value: Column, depth: Column) -> Column:
        return F.struct(F.concat(F.lit(f"{prefix}:"), value).alias("item"), F.lit(kind).alias("kind"), depth.cast("int").alias("depth"))

    def words(kind: int, prefix: str, listed: Column, first: int) -> Column:
        return F.flatten(F.transform(listed, lambda text, i: F.transform(_words(text), lambda word: made(kind, prefix, word, i + first))))

    def single(labels: Column) -> Column:
        values = {
            "scheme": F.lower(F.substring_index(url, "://", 1)),
            "host": host,
            "sub": F.when(F.size(labels) > 2, F.element_at(labels, -1)),
            "ext": F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1),
            "query": keys,
            "anchor": F.when(F.instr(url, "#") > 0, F.lit("yes")),
        }
        return F.array_compact(F.array(*[F.when(value != "", made(SINGLE, kind, value, F.lit(0))) for kind, value in values.items()]))

    def of_host(labels: Column) -> Column:
        return F.concat(
            single(labels),
            F.transform(labels, lambda _, i: made(SUFFIX, "suffix", F.array_join(F.reverse(F.slice(labels, F.lit(1), i + 1)), "."), i + 1)),
            F.transform(labels, lambda label, i: made(HOST_WORD, "label", label, i + 1)),
            words(HOST_WORD, "hostword", labels, 1),
        )

    def of_path(folders: Column) -> Column:
        return F.concat(
            F.transform(folders, lambda _, i: made(FOLDERS, "folders", F.array_join(F.slice(folders, F.lit(1), i + 1), "/"), i + 1)),
            words(PATH_WORD, "pathword", F.concat(folders, F.array(file)), 1),
        )

    listed = F.concat(_with(F.reverse(F.split(name, r"\.")), of_host), _with(above, of_path))
    kept = F.array_sort(F.filter(listed, lambda one: ~one["item"].endswith(":")))
    # Sorted by item, then kind and depth: the first of each item has its least depth.
    first = _with(kept, lambda all: F.filter(all, lambda one, i: (i == 0) | (F.get(all, i - 1)["item"] != one["item"])))
    return first.cast(f"array<{ITEM}>")


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The items of a URL as an array of texts without repeats."""
    return F.transform(items_of(url, host, path), lambda one: one["item"])


def _classes(rows: DataFrame, need: int) -> DataFrame:
    """(item, class, kind, depth): items with enough bad rows; those that the same rows of (row, items, bad) have share a class, named by one of them."""
    single = rows.select("row", "bad", F.explode("items").alias("one")).select("row", "bad", "one.*")
    digest = F.xxhash64("row")
    counted = single.groupBy("item").agg(
        F.sum(F.col("bad").cast("bigint")).alias("support"),
        F.count("*").alias("freq"),
        F.bit_xor(digest).alias("one"),
        F.sum(F.pmod(digest, F.lit(1 << 31))).alias("other"),
        F.min("kind").alias("kind"),
    )
    often = store(counted.filter(F.col("support") >= need), "url-items")
    heads = often.groupBy("support", "freq", "one", "other").agg(F.min(F.struct("kind", F.length("item").alias("n"), "item"))["item"].alias("class"))
    return store(often.join(heads, ["support", "freq", "one", "other"]).select("item", "class"), "url-classes")


def _views(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(items): what FP-growth reads. Items carry the name of their view, so that views do not add up."""
    heads = _small(classes.select("class").distinct(), "class")
    single = rows.select("row", "bad", F.explode("items").alias("one"))
    kept = single.join(heads, F.col("one.item") == F.col("class")).groupBy("row", "bad").agg(F.collect_list("one").alias("items"))

    def chain(kind: int) -> Column:
        none = F.struct(F.lit(None).cast("string").alias("item"), F.lit(kind).alias("kind"), F.lit(0).alias("depth")).cast(ITEM)
        return F.concat(F.array(none), F.filter("items", lambda one: one["kind"] == kind))

    seen = kept.withColumn("suffix", F.explode(chain(SUFFIX))).withColumn("folders", F.explode(chain(FOLDERS)))
    free = F.filter(
        "items",
        lambda one: (one["kind"] == SINGLE)
        | ((one["kind"] == HOST_WORD) & (one["depth"] > F.col("suffix.depth")))
        | ((one["kind"] == PATH_WORD) & (one["depth"] > F.col("folders.depth"))),
    )
    names = F.concat(
        F.array_compact(F.array("suffix.item", "folders.item", F.when(F.col("bad"), F.lit(MARK)))),
        F.transform(free, lambda one: one["item"]),
    )
    view = F.concat(F.col("suffix.depth").cast("string"), F.lit("."), F.col("folders.depth").cast("string"), F.lit("|"))
    return seen.select(F.array_distinct(F.transform(names, lambda name: F.concat(view, name))).alias("items"))


def _small(df: DataFrame, text: str) -> DataFrame:
    """`df`, marked for broadcast where its texts are within the bound."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(text) + 32), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def mine_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE
) -> tuple[DataFrame, DataFrame]:
    """Rules (rule_id, items, support, confidence, lift) from `labelled` (items, bad), and classes (item, class) that rules name.

    A rule has at least `min_support` of all labelled URLs and `min_rows` of them bad, and at least `min_confidence`; one with
    another rule among its parts is left out.
    """
    rows = store(labelled.select(F.monotonically_increasing_id().alias("row"), "items", "bad"), "url-labelled")
    spark = labelled.sparkSession
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("bigint")), F.lit(0))).first()
    need = max(1, math.ceil(max(min_support * n, min_rows) - 1e-9))
    classes = _classes(rows, need)
    if classes.isEmpty():
        return spark.createDataFrame([], "rule_id bigint, items array<string>, support bigint, confidence double, lift double"), classes
    views = store(_views(rows, classes), "url-views")
    count = views.count()
    model = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / count, minConfidence=1.0).fit(views)
    sets = model.freqItemsets.select("freq", F.substring_index(F.col("items")[0], "|", 1).alias("view"), F.transform("items", lambda i: F.substr(i, F.instr(i, "|") + 1)).alias("items"))
    # What a view is named after belongs to its sets; without it the set is counted in a wider view.
    suffix, folders = F.exists("items", lambda one: one.startswith("suffix:")), F.exists("items", lambda one: one.startswith("folders:"))
    own = (suffix == (F.substring_index("view", ".", 1) != "0")) & (folders == (F.substring_index("view", ".", -1) != "0"))
    marked = F.array_contains("items", MARK)
    sets = sets.filter(own).select(F.array_sort(F.array_remove("items", MARK)).alias("items"), "freq", marked.alias("marked"))
    sets = sets.filter(F.size("items") > 0).groupBy("items").agg(F.max(F.when(F.col("marked"), F.col("freq"))).alias("support"), F.max(F.when(~F.col("marked"), F.col("freq"))).alias("freq"))
    rules = sets.filter("support is not null").withColumn("confidence", F.col("support") / F.col("freq"))
    rules = store(rules.filter(F.col("confidence") >= min_confidence), "url-rules")
    parts = rules.select("items", F.explode(F.transform("items", lambda one: F.array_remove(F.col("items"), one))).alias("part"))
    wider = parts.join(rules.select(F.col("items").alias("part")), "part", "left_semi").select("items")
    least = rules.join(wider, "items", "left_anti").withColumn("lift", F.col("confidence") * n / bad)
    return store(least.select(F.monotonically_increasing_id().alias("rule_id"), "items", "support", "confidence", "lift"), "url-least"), classes


def matched_rows(rows: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """(row): those of `rows` (row, tokens) that fit a rule, by an inverted index."""
    index = rules.select("rule_id", F.size("items").alias("needed"), F.explode("items").alias("class"))
    used = classes.join(index.select("class").distinct(), "class", "left_semi")
    has = rows.select("row", F.explode("tokens").alias("item")).join(_small(used, "item"), "item").select("row", "class").distinct()
    full = has.join(_small(index, "class"), "class").groupBy("row", "rule_id", "needed").agg(F.count("*").alias("met")).filter("met = needed")
    return full.select("row").distinct()


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str]],
    page_id: str = "page_id",
    url: str = "url",
    label_key: str = "page_id",
    bad: str = "bad",
    min_support: float = MIN_SUPPORT,
    min_rows: int = MIN_ROWS,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined): one row per row of `pages`.

    `labels` has `label_key` (a page id) and a boolean `bad`. A null URL, or one without `://`, has an empty host and path, no
    tokens, and is allowed. Pages with several labels count once for each; null labels are not used. Repeated pages each
    give a row. Empty tables work: without labels nothing is mined. Other columns are not read.
    """
    column = F.coalesce(F.col(url), F.lit(""))
    table = pages.select(F.col(page_id).alias("page_id"), column.alias("url"))
    table = table.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    items = F.when(F.col("host") == "", F.array().cast(f"array<{ITEM}>")).otherwise(items_of(F.col("url"), F.col("host"), F.col("path")))
    table = table.select("page_id", "host", "path", items.alias("items"), F.monotonically_increasing_id().alias("row"))
    rows = store(table.withColumn("tokens", F.col("items.item")), "url-rows")
    known = labels.select(F.col(label_key).alias("page_id"), F.col(bad).alias("bad")).filter("bad is not null")
    mined, classes = mine_rules(rows.join(known, "page_id").select("items", "bad"), min_support, min_rows, min_confidence)
    rule, verdict = written_rule(F.col("host"), F.col("path"), rules)
    judged = rows.withColumn("rule", rule).withColumn("_written", verdict)
    if mined.isEmpty():
        judged = judged.withColumn("mined", F.lit(False))
    else:
        hit = matched_rows(rows, mined, classes).withColumn("_hit", F.lit(True))
        judged = judged.join(hit, "row", "left").withColumn("mined", F.coalesce("_hit", F.lit(False)))
    own = F.when(F.col("mined"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_written", own).alias("verdict"), "mined")
