"""Text helpers, Column to Column. No Python runs per row; null in gives null out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlens.functions.fixed_values import (
    BADGES,
    BLANKED_PUNCTUATION,
    BRACKETED,
    JUNK_PHRASES,
    JUNK_WORDS,
    KEPT_CHARS,
    KEPT_STOPWORDS,
    STOPWORDS,
    WORD_CHARS,
    WORD_SPLIT,
)
from shortlens.operators.filters import OLDEST_DATE, UNLABELLED

# Every character that counts as blank in Unicode text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def lower(c: Column) -> Column:
    return F.lower(c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def ascii_only(c: Column) -> Column:
    """Drop characters outside ASCII, then blanks at both ends."""
    return strip(F.regexp_replace(c, r"[^\x00-\x7F]+", ""))


def drop_bracketed(c: Column) -> Column:
    """Remove (..), [..] and {..} without brackets of the same kind inside; one pass."""
    return F.regexp_replace(c, BRACKETED, "")


def clean_text(c: Column) -> Column:
    """Punctuation but # + , . @ becomes a blank; runs of blanks become one."""
    blank = BLANKED_PUNCTUATION + BLANKS
    return F.trim(F.regexp_replace(F.translate(c, blank, " " * len(blank)), "  +", " "))


def keep_chars(c: Column) -> Column:
    """Keep letters, + # blank and everything from / to _ in ASCII order, which covers digits and : ; < = > ? @ [ \\ ] ^."""
    return F.regexp_replace(c, KEPT_CHARS, "")


def tokens(c: Column, lowered: bool = True) -> Column:
    """Split on each single blank; blanks at the end leave no empty tokens."""
    text = F.lower(c) if lowered else c
    return F.split(F.regexp_replace(text, r"\s+$", ""), r"\s")


def drop_stopwords(words: Column, keep: Sequence[str] = KEPT_STOPWORDS) -> Column:
    """Tokens that are no stop words, whatever their case."""
    gone = [w for w in STOPWORDS if w not in keep]
    return F.filter(words, lambda w: ~F.lower(w).isin(gone))


def remove_stopwords(df: DataFrame, column: str, keep: Sequence[str] = KEPT_STOPWORDS, lowered: bool = True) -> DataFrame:
    words = drop_stopwords(tokens(F.col(column), lowered), keep)
    return df.withColumn(column, F.when(F.col(column).isNotNull(), join_words(words)))


def join_words(words: Column, separator: str = " ") -> Column:
    return F.concat_ws(separator, words)


def words(df: DataFrame, column: str, into: str = "word") -> DataFrame:
    """One row per word."""
    return df.withColumn(into, F.explode(F.split(F.col(column), WORD_SPLIT)))


def word_chars(c: Column) -> Column:
    return F.regexp_replace(c, WORD_CHARS, "")


def string_to_list(c: Column) -> Column:
    """A list printed as text, such as `[a, b]`. Items holding a comma and a blank are cut; real arrays are preferable."""
    inner = F.substr(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))
    return F.transform(F.split(inner, ", "), strip)


def extract_job_function(c: Column) -> Column:
    return F.regexp_extract(c, r"Job function=(.*?), Seniority level", 1)


def split_functions(c: Column) -> Column:
    parts = F.split(c, r", and | and |, ")
    return F.when(c == "", F.array(F.lit(UNLABELLED))).when(c.isNotNull(), parts)


def norm_content(c: Column) -> Column:
    return F.replace(F.lower(c.cast("string")), F.lit("."), F.lit(""))


def is_junk(c: Column) -> Column:
    """Content that says nothing: one of a few words, or any text around a phrase such as `not specified`."""
    said = norm_content(c)
    return said.isin(list(JUNK_WORDS)) | said.rlike("|".join(JUNK_PHRASES))


def normalize_badge(c: Column, badges: Sequence[str] = BADGES) -> Column:
    """The first known badge found in the text, else the text."""
    hits = [F.when(F.contains(c, F.lit(b)), F.lit(b)) for b in badges]
    return F.coalesce(*hits, c)


def title_case(c: Column) -> Column:
    """Capitalise a letter after anything that is no letter, lower the rest: `c++/java` becomes `C++/Java`."""
    pieces = F.split(c, r"(?<=\P{L})(?=\p{L})")
    first = lambda p: F.initcap(F.upper(F.left(p, F.lit(1))))
    return F.array_join(F.transform(pieces, lambda p: F.concat(first(p), F.lower(F.substr(p, F.lit(2))))), "")


def render_prompt(template: str, *columns: Column) -> Column:
    return F.format_string(template, *columns)


def pipeline(c: Column, steps: Sequence[Callable[[Column], Column]], lowered: bool = True) -> Column:
    """Cleaning steps in order, lower-casing first when asked."""
    return reduce(lambda text, step: step(text), steps, F.lower(c) if lowered else c)


def slug(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def parse_date(c: Column, default: str = OLDEST_DATE) -> Column:
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.lit(default).cast("date"))


def shard(c: Column, n: int) -> Column:
    return F.pmod(c, F.lit(n))
