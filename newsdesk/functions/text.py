"""Text functions, Column to Column."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript's \s has it, spelt out for Java and RE2 alike.
SPACE = "[ \\t\\n\\r\\x0B\\f\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
EDGES = f"^{SPACE}|{SPACE}$"
#: The same for Java alone: what cannot be white space is ruled out by one comparison.
_RUN = f"(?:(?![!-\\x9f]){SPACE[:-1]})+"


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(text, _RUN, " "))


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, EDGES, "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def truncate(text: Column, limit: int) -> Column:
    """Collapsed text of at most ``limit`` code points, the last an ellipsis if cut; empty is null."""
    value = F.nullif(collapse(text), F.lit(""))
    return F.when(F.length(value) <= limit, value).otherwise(F.concat(F.substring(value, 1, limit - 1), F.lit("…")))


def sanitised(text: Column) -> Column:
    """Text without NUL; strings here are UTF-8, so lone surrogates cannot occur."""
    return F.replace(F.make_valid_utf8(text), F.lit("\x00"), F.lit(""))


def clean(text: Column) -> Column:
    """Text without NUL and without white space at its ends; null if nothing is left."""
    return F.nullif(strip(sanitised(text)), F.lit(""))


@lru_cache(maxsize=16)
def _automaton(words: tuple[str, ...]):
    """Finds all words of a text in one pass over it; made once a worker."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, w)
    found.make_automaton()
    return found


def held(text: Column, keywords: Iterable[str]) -> Column:
    """The set of keywords (in lower case) that a text holds as substrings, none if it is null; the text comes lower-cased.

    Built-in functions would scan a text once for each of some hundred keywords; an automaton over Arrow
    batches does so once for all.
    """
    words = tuple(sorted({k.lower() for k in keywords}))

    def scan(texts: pa.Array) -> pa.Array:
        find = _automaton(words)
        return pa.array([sorted({w for _, w in find.iter(t)}) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    scan.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(scan, "array<string>")(text)


def hits(found: Column, keywords: Iterable[str]) -> Column:
    """How many of the keywords are among those that a text holds."""
    counts = Counter(k.lower() for k in keywords)
    if not counts:
        return F.lit(0)
    total = F.size(F.array_intersect(found, F.array(*map(F.lit, counts))))
    # A keyword that a list has more than once counts as often.
    for k, n in counts.items():
        if n > 1:
            total = total + F.when(F.array_contains(found, k), n - 1).otherwise(0)
    return total


def matches(found: Column, keywords: Iterable[str], prefix: str) -> Column:
    """``prefix:keyword`` for each keyword that a text holds, in the keywords' order."""
    return F.array_compact(F.array(*[F.when(F.array_contains(found, k.lower()), F.lit(f"{prefix}:{k.lower()}")) for k in keywords]))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), 0)


def key(text: Column, minimum: int) -> Column:
    """A title as a key: lower case, no links, only a-z, 0-9, kana and CJK; null if shorter than ``minimum``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(low, "https?://[^ \\t\\n\\r]+", " "), "[^a-z0-9぀-ヿ㐀-鿿 \\t\\n\\r]+", " ")
    value = F.trim(F.regexp_replace(plain, "[ \\t\\n\\r]+", " "))
    return once(value, lambda v: F.when(F.length(v) >= minimum, v))


def tokens(text: Column, minimum: int = 4) -> Column:
    """Distinct words of a title key of at least ``minimum`` characters, in order."""
    return F.array_distinct(F.filter(F.split(F.coalesce(key(text, 1), F.lit("")), " "), lambda t: F.length(t) >= minimum))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)).otherwise(0.0)


def sentences(summary: Column) -> Column:
    """Up to three sentences, or the text in two halves if it has fewer than two."""
    found = F.filter(F.transform(F.regexp_extract_all(summary, F.lit("[^。！？.!?]+[。！？.!?]?"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")
    half = F.ceil(F.length(summary) / 2).cast("int")
    left, right = F.trim(F.substr(summary, F.lit(1), half)), F.trim(F.substr(summary, half + 1))
    none = F.array(F.lit("要約データなし。"), F.lit("要点データなし。"))
    halves = F.when(right == "", F.array(F.coalesce(F.nullif(left, F.lit("")), F.lit("要約データなし。")), F.coalesce(F.nullif(left, F.lit("")), F.lit("要約データなし。")))).otherwise(F.array(left, right))
    return F.when(F.coalesce(summary, F.lit("")) == "", none).when(F.size(found) >= 2, F.slice(found, 1, 3)).otherwise(halves)


def without_links(text: Column, limit: int) -> Column:
    """Markdown links reduced to their labels, bare links dropped, spaces collapsed, at most ``limit`` code points."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"https?://[^ \t\n\r]+", "")
    return F.nullif(F.substring(F.trim(F.regexp_replace(plain, "[ \\t\\n\\r]+", " ")), 1, limit), F.lit(""))


def title_case(text: Column) -> Column:
    """Words with a capital, names such as ``gpt4`` and short all-capitals kept in capitals."""
    return F.array_join(F.transform(F.filter(F.split(collapse(text), " "), lambda t: t != ""), lambda t: (
        F.when(t.rlike(r"(?i)^[a-z]{1,4}\d+(\.\d+)?$"), F.upper(t)).when(t.rlike("^[A-Z]{1,6}$"), t).otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2)))))
    )), " ")


def handle(text: Column) -> Column:
    """An account name: trimmed, without a leading @, lower case; null unless 1 to 15 word characters and not reserved."""
    from newsdesk.config import RESERVED_HANDLES

    value = F.lower(F.regexp_replace(F.trim(text), "^@", ""))
    return F.when(value.rlike("^[a-z0-9_]{1,15}$") & ~value.isin(*RESERVED_HANDLES), value)


def name(text: Column) -> Column:
    """An account name: trimmed, without a leading @, lower case; null unless 1 to 15 word characters."""
    value = F.lower(F.regexp_replace(F.trim(text), "^@", ""))
    return F.when(value.rlike("^[a-z0-9_]{1,15}$"), value)


def compact_number(n: Column) -> Column:
    """1,234,567 as 1.2M, 1,234 as 1.2K, smaller ones as they are."""
    return F.when(n >= 1_000_000, F.concat(F.format_number(n / 1_000_000, 1), F.lit("M"))).when(n >= 1000, F.concat(F.format_number(n / 1000, 1), F.lit("K"))).otherwise(n.cast("bigint").cast("string"))


def without_first(text: Column, part: Column) -> Column:
    """``text`` less the first occurrence of ``part``."""
    at = F.position(part, text)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(part)))).otherwise(text)


def prepend_badge(title: Column, badge: Column) -> Column:
    """``badge`` before ``title``, moved there if the title holds it elsewhere, in collapsed space."""
    plain = F.coalesce(collapse(title), F.lit(""))
    rest = collapse(without_first(plain, badge))
    return F.when(badge.isNull(), title).when(rest == "", badge).otherwise(F.concat_ws(" ", badge, rest))


def append_badge(text: Column, badge: Column) -> Column:
    """``badge`` after ``text``, unless the text holds it."""
    return F.when(badge.isNull(), text).when(F.coalesce(text, F.lit("")) == "", badge).when(F.contains(text, badge), text).otherwise(F.concat_ws(" ", text, badge))
