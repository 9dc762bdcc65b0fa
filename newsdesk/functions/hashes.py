"""Content hashes: SHA-256 of JSON with its fields in the order of their definition and nulls kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsdesk.functions import text, variants

#: Control characters whose hexadecimal digits JSON writers print in either case.
_UPPER = [c for c in range(0x20) if any(x in "ABCDEF" for x in f"{c:02X}") and c not in (0x0A, 0x0C, 0x0D)]


def instant(at: Column) -> Column:
    """A time as ISO text in UTC with milliseconds."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def json(**fields: Column) -> Column:
    """An object of ``fields`` as JSON without spaces; doubles print as in JavaScript if they come as ``number``."""
    out = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})
    for c in _UPPER:
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u{c:04X}", rf"$1\\u{c:04x}")
    # Numbers come as marked strings, as writers print doubles in ways of their own.
    return F.regexp_replace(out, r':"\\u0001n:([0-9.eE+\-]+)"', ":$1")


def number(x: Column) -> Column:
    """A double for ``json``."""
    return F.concat(F.lit("\u0001n:"), variants.number_text(x.cast("double")))


def digest(**fields: Column) -> Column:
    return F.sha2(json(**fields), 256)


def item(platform: Column, source_item: Column, canonical_url: Column, title: Column, body: Column, published_at: Column) -> Column:
    """Of an item as collected: what makes it a new version."""
    return digest(platform=platform, sourceItemId=source_item, canonicalUrl=canonical_url, title=text.clean(title), body=text.clean(body), publishedAt=instant(published_at))


def rules_input(version: str, item_id: Column, platform: Column, title: Column, body: Column, url: Column, canonical_url: Column, published_at: Column, updated_at: Column) -> Column:
    """Of what the rules classify; empty texts count as none."""
    some = lambda c: F.nullif(c, F.lit(""))
    return digest(
        ruleVersion=F.lit(version), id=item_id, platform=platform, title=some(title), body=some(body), url=url, canonicalUrl=some(canonical_url), publishedAt=instant(published_at), updatedAt=instant(updated_at),
    )


def publish_input(edition_at: Column, item: Column, classification: Column, decision: Column, placement: Column) -> Column:
    """Of an item as it is planned for an edition; the parts are structs, the decision null if there is none, times as ``instant``, doubles as ``number``."""
    return digest(editionDate=instant(edition_at), item=item, classification=classification, decision=decision, placement=placement)


def raw(value: Column) -> Column:
    """Of a VARIANT, whatever the order of its keys and the form of its numbers."""
    return F.sha2(variants.canonical(value), 256)
