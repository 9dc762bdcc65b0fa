"""HTML functions: readable text, titles, images, entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsdesk.functions.text import collapse, once

#: The named entities that are decoded.
ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&"))


def decoded(text: Column) -> Column:
    """Six named and all numeric character references decoded, once each, in one pass over the text; null stays null."""
    pattern = r"&(?:#x?[0-9a-fA-F]+|[a-zA-Z]+);"

    def one(ref: Column) -> Column:
        name = F.substring(ref, 2, 1 << 20)
        name = F.substr(name, F.lit(1), F.length(name) - 1)
        hexa = F.try_to_number(F.conv(F.regexp_extract(name, "^#[xX]([0-9a-fA-F]{1,6})$", 1), 16, 10), F.lit("99999999")).cast("int")
        deci = F.regexp_extract(name, "^#([0-9]{1,7})$", 1).try_cast("int")
        code = F.when(name.rlike("^#[xX]"), hexa).otherwise(deci)
        value = F.when((code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF), _character(code))
        named = F.lit(None).cast("string")
        for k, v in ENTITIES:
            named = F.when(name == k, F.lit(v)).otherwise(named)
        return F.coalesce(F.when(F.startswith(name, F.lit("#")), value).otherwise(named), ref)

    def parts(t: Column) -> Column:
        met = F.arrays_zip(F.split(t, pattern, -1).alias("text"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("ref"))
        joined = F.array_join(F.transform(met, lambda p: F.concat(p["text"], F.when(p["ref"].isNotNull(), one(p["ref"])).otherwise(""))), "")
        return F.when(F.contains(t, F.lit("&")), joined).otherwise(t)

    return once(text, parts)


def _character(code: Column) -> Column:
    """A code point as a string, by its UTF-16 units."""
    low = code - 0x10000
    unit = lambda u: F.lpad(F.hex(u), 4, "0")
    pair = F.concat(unit(F.shiftright(low, 10) + 0xD800), unit(low.bitwiseAND(0x3FF) + 0xDC00))
    return F.decode(F.unhex(F.when(code < 0x10000, unit(code)).otherwise(pair)), "UTF-16BE")


def without_markup(html: Column) -> Column:
    """Text outside tags; scripts, styles and embedded objects go with their contents."""
    out = html
    for tag in ("script", "style", "noscript", "svg", "iframe"):
        out = F.regexp_replace(out, f"(?is)<{tag}.*?</{tag}>", " ")
    return F.regexp_replace(out, "<[^>]+>", " ")


def readable(html: Column) -> Column:
    return collapse(decoded(without_markup(html)))


def title(html: Column) -> Column:
    return F.nullif(collapse(decoded(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(""))


def meta(html: Column, *names: str) -> Column:
    """The content of the first of the named meta tags, whichever way round its attributes stand."""
    found = []
    for n in names:
        for p in (rf"(?is)<meta[^>]+(?:name|property)=[\"']{n}[\"'][^>]+content=[\"'](.*?)[\"'][^>]*>", rf"(?is)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]+(?:name|property)=[\"']{n}[\"'][^>]*>"):
            found.append(F.nullif(F.regexp_extract(html, p, 1), F.lit("")))
    return F.nullif(collapse(decoded(F.coalesce(*found))), F.lit(""))


def description(html: Column) -> Column:
    return meta(html, "description", "og:description")


def image(html: Column) -> Column:
    return meta(html, "og:image", "og:image:url", "twitter:image")


def context(html: Column, url: Column, limit: int = 1000) -> Column:
    """What a classifier gets to read of a page: title, description, content and link, at most ``limit`` characters."""
    part = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))
    return F.substring(F.concat_ws("\n", part("title", title(html)), part("description", description(html)), part("content", readable(html)), part("url", url)), 1, limit)
