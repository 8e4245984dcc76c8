"""Text and date cleaning as column expressions (no Python workers)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark import params


# What counts as white space, as a set of characters and as a pattern.
BLANKS = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000")
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def symbol_of(raw: Column) -> Column:
    return F.upper(strip(raw))


def stated_date_text(ts: Column) -> Column:
    """First ten characters when they look like an ISO date, else NULL."""
    head = F.substring(strip(ts), 1, 10)
    return F.when(head.rlike(params.ISO_DATE_PATTERN), head)


def plausible_year(date_text: Column, first: int = 1990, last: int = 2026) -> Column:
    return F.substring(date_text, 1, 4).try_cast("int").between(first, last)


def strip(raw: Column) -> Column:
    """Without white space at both ends: blanks, tabs, line ends and Unicode's own, as in :data:`SPACE`."""
    return F.btrim(raw, F.lit(BLANKS))


def first_words(text: Column, count: int) -> Column:
    """The first ``count`` words, one blank apart. What is behind them is not looked at."""
    head = F.regexp_extract(text, rf"^{SPACE}*+(?:[^{SPACE[1:-1]}]++{SPACE}*+){{0,{count}}}", 0)
    return strip(F.regexp_replace(head, f"{SPACE}+", " "))


def title_or_lead(title: Column, body: Column, count: int = params.TITLE_FALLBACK_WORDS) -> Column:
    """The title, or the first words of the body when the title is blank."""
    stripped = strip(F.coalesce(title, F.lit("")))
    return F.when(stripped != "", stripped).otherwise(
        first_words(strip(F.coalesce(body, F.lit(""))), count))


def normal_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), f"{SPACE}+", " "))


def normal_url(url: Column) -> Column:
    bare = F.substring_index(F.lower(strip(F.coalesce(url, F.lit("")))), "?", 1)
    return F.regexp_replace(F.substring_index(bare, "#", 1), "/+$", "")


def words(text: Column) -> Column:
    """Lower-case words, also repeated ones, cut in one pass at white space, commas and points; an end may give an empty one."""
    return F.split(F.lower(text), f"[{SPACE[1:-1]},.]+")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(words(text), lambda w: w != ""))


def hits(words: Column, vocabulary: Sequence[str]) -> Column:
    """How many words of the vocabulary, none of them empty, occur."""
    return F.size(F.array_intersect(words, F.lit(list(vocabulary))))


def date_only(ts: Column) -> Column:
    """True when a UTC text timestamp has midnight as its time; unreadable is false."""
    parsed = F.coalesce(*[F.try_to_timestamp(strip(ts), F.lit(pattern)) for pattern in (
        "yyyy-MM-dd HH:mm:ss 'UTC'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")])
    return F.coalesce(F.date_format(parsed, "HH:mm:ss") == "00:00:00", F.lit(False))
