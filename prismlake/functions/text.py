"""Scalar text functions as Column expressions; pandas UDFs only where Spark has no built-in (entities, NFKD, ratio)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """HTML entities resolved; null stays null."""
    import html

    return s.map(lambda x: x if x is None or "&" not in x else html.unescape(x))


def clean_text(text: Column, limit: int | None = None) -> Column:
    """Entities, then tags, then white space; cut to `limit` characters with an ellipsis in the last. Null gives ''."""
    t = F.regexp_replace(unescape(F.coalesce(text, F.lit(""))), r"<[^>]+>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"^ | $", "")
    return t if limit is None else F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…"))).otherwise(t)


def clean_date(text: Column) -> Column:
    """'2019.0' is '2019'; other texts are trimmed and cut to 80 characters."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t.rlike(r"^\d{4}\.0$"), F.substring(t, 1, 4)).otherwise(F.substring(t, 1, 80))


def path_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def last_segment(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def document_text(title: Column, abstract: Column, style: str = "sentence") -> Column:
    """Title and abstract as one text: 'doubled' (title twice), 'separator' ([SEP] between) or 'sentence'."""
    t, a = F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))
    parts = {"doubled": (t, F.lit(". "), t, F.lit(". "), a), "separator": (t, F.lit("[SEP]"), a), "sentence": (t, F.lit(". "), a)}
    return F.concat(*parts[style])


def type_code(text: Column) -> Column:
    """2 review, 1 book, 0 article, -1 other; tested in that order, as 'book review' is a review."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(t.contains("review"), 2).when(t.contains("book") | t.contains("книга"), 1)
        .when(t.contains("article") | t.contains("articolo"), 0).otherwise(-1).cast("short")
    )


def year(text: Column) -> Column:
    """First stand-alone year 1500-2099, or null."""
    y = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?<!\d)(1[5-9]\d{2}|20\d{2})(?!\d)", 1)
    return F.when(y != "", y.cast("int"))


def period_code(text: Column) -> Column:
    """5 unpublished, 0-4 by year (before 1990, then by decade), -1 unknown."""
    t, y = F.lower(F.coalesce(text, F.lit(""))), year(text)
    return (
        F.when(t.contains("manuscript") | t.contains("forthcoming"), 5).when(y.isNull(), -1).when(y < 1990, 0)
        .when(y < 2000, 1).when(y < 2010, 2).when(y < 2020, 3).otherwise(4).cast("short")
    )


@F.pandas_udf(StringType())
def decompose(s: pd.Series) -> pd.Series:
    """NFKD without combining marks U+0300-036F; null stays null."""
    import re
    import unicodedata

    mark = re.compile("[̀-ͯ]")
    return s.map(lambda x: x if x is None or x.isascii() else mark.sub("", unicodedata.normalize("NFKD", x)))


def search_form(text: Column) -> Column:
    """Letters and digits of any script in lower case, single blanks, apostrophes dropped, & as 'and'."""
    t = F.lower(F.regexp_replace(decompose(F.coalesce(text, F.lit(""))), "[’'`]", ""))
    return F.trim(F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " "))


def link_form(text: Column) -> Column:
    """ASCII letters and digits only, case folded."""
    return F.trim(F.regexp_replace(F.lower(F.replace(decompose(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def singular(token: Column) -> Column:
    """Rough English singular."""
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - F.lit(k))
    return (
        F.when((n >= 5) & token.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n >= 5) & token.rlike("(sses|shes|ches|xes|zes)$"), cut(2))
        .when((n >= 4) & token.endswith("s") & ~token.rlike("(ss|us|is|ics)$"), cut(1))
        .otherwise(token)
    )


def equivalent(a: Column, b: Column) -> Column:
    return (a == b) | (singular(a) == singular(b))


def one_edit(a: str, b: str) -> Column:
    """Equal, one edit apart, or two neighbours swapped. a and b are column names."""
    swap = f"length({a}) = length({b}) AND length({a}) >= 2 AND exists(sequence(1, greatest(1, length({a}) - 1)), i -> concat(substr({a}, 1, i - 1), substr({a}, i + 1, 1), substr({a}, i, 1), substr({a}, i + 2)) = {b})"
    return F.expr(f"coalesce(levenshtein({a}, {b}, 1) >= 0, false) OR coalesce({swap}, false)")


def contains_phrase(value: Column, phrase: Column) -> Column:
    return F.concat(F.lit(" "), value, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


def surname(name: Column) -> Column:
    """What stands before a comma, else the last word, in link form."""
    n = link_form(name)
    return F.when(F.contains(F.coalesce(name, F.lit("")), F.lit(",")), link_form(F.substring_index(name, ",", 1))).otherwise(F.element_at(F.split(n, " "), -1))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; null if either is null."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _single(t: str) -> str:
    if len(t) >= 5 and t.endswith("ies"):
        return t[:-3] + "y"
    if len(t) >= 5 and t.endswith(("sses", "shes", "ches", "xes", "zes")):
        return t[:-2]
    return t[:-1] if len(t) >= 4 and t.endswith("s") and not t.endswith(("ss", "us", "is", "ics")) else t


def _near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :]
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k:]


def _fits(q: str, c: str, mode: str) -> bool:
    if q == c or _single(q) == _single(c):
        return True
    if "i" in mode and len(q) == 1 and c.startswith(q) or "p" in mode and len(q) >= 2 and c.startswith(q):
        return True
    return "f" in mode and len(q) >= 4 and len(c) >= 4 and _near(q, c)


def tokens_match(query: list[str], candidate: list[str], mode: str) -> bool:
    """Whether every query token has a candidate token of its own. mode: letters of p (prefix), i (initial), f (one edit)."""
    taken: dict[int, int] = {}

    def place(i: int, seen: set[int]) -> bool:  # augmenting paths
        for j, c in enumerate(candidate):
            if j not in seen and _fits(query[i], c, mode):
                seen.add(j)
                if j not in taken or place(taken[j], seen):
                    taken[j] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(query)))
