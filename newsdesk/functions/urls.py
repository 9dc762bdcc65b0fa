"""URL functions, Column to Column: canonical forms, keys, link and video extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsdesk.config import TRACKING_PARAMS

_PARTS = r"^(?i)(https?)://([^/?#\s]+)([^?#\s]*)(\?[^#\s]*)?(#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def _param(query: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(query, rf"[?&]{name}=([^&]*)", 1), F.lit(""))


def unwrapped(url: Column) -> Column:
    """The target of a search engine's redirect link, other links as they are."""
    host = F.lower(F.regexp_replace(_part(url, 2), r":\d+$", ""))
    target = F.coalesce(_param(_part(url, 4), "url"), _param(_part(url, 4), "q"))
    return F.when(host.endswith("google.com") & (_part(url, 3) == "/url"), F.coalesce(F.try_url_decode(target), url)).otherwise(url)


def canonical(url: Column, tracking: str = TRACKING_PARAMS) -> Column:
    """The canonical form: redirect unwrapped, host in lower case, no default port, fragment, tracking parameter or final slash, parameters sorted.

    Anything that isn't an http(s) link comes back trimmed.
    """
    original = F.trim(url)
    u = unwrapped(original)
    scheme, host, path, query = F.lower(_part(u, 1)), F.lower(_part(u, 2)), _part(u, 3), _part(u, 4)
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    path = F.when(path == "", "/").when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    entries = F.filter(F.split(F.substr(query, F.lit(2)), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(tracking))
    keyed = F.array_sort(F.transform(entries, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))).alias("p"))))
    params = F.array_join(F.transform(keyed, lambda e: e["p"]), "&")
    return F.when(u.rlike(_PARTS), F.concat(scheme, F.lit("://"), host, path, F.when(params != "", F.concat(F.lit("?"), params)).otherwise(""))).otherwise(original)


def alert_link(url: Column, params: tuple[str, ...]) -> Column:
    """An alert's link: redirect unwrapped, host in lower case without default port, named parameters off, one final slash off; order and fragment stay.

    Anything that isn't an http(s) link comes back as it is.
    """
    host = F.lower(_part(url, 2))
    target = F.try_url_decode(_param(_part(url, 4), "url"))
    u = F.when(F.contains(host, F.lit("google.com")) & (_part(url, 3) == "/url"), F.coalesce(target, url)).otherwise(url)
    scheme, host, path = F.lower(_part(u, 1)), F.lower(_part(u, 2)), _part(u, 3)
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    path = F.when(path == "", "/").otherwise(path)
    kept = F.filter(F.split(F.substr(_part(u, 4), F.lit(2)), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*params))
    out = F.concat(scheme, F.lit("://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""), _part(u, 5))
    return F.when(u.rlike(_PARTS), F.when(path != "/", F.regexp_replace(out, "/$", "")).otherwise(out)).otherwise(url)


def rules_key(url: Column) -> Column:
    return F.nullif(F.lower(F.trim(canonical(url))), F.lit(""))


def prefilter_key(url: Column) -> Column:
    """Lower case without scheme, fragment and one final slash; the cheaper key of the prefilter."""
    low = F.lower(F.trim(url))
    return F.nullif(F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "^https?://", ""), "#.*$", ""), "/?$", ""), F.lit(""))


def article_key(url: Column) -> Column:
    """The viewer's key: trimmed, scheme and host in lower case, no default port, one final slash off; query, case of the path and fragment stay; null for blank."""
    u = F.nullif(F.trim(url), F.lit(""))
    scheme, host, path = F.lower(_part(u, 1)), F.lower(_part(u, 2)), _part(u, 3)
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    whole = F.when(u.rlike(_PARTS), F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), _part(u, 4), _part(u, 5))).otherwise(u)
    return F.regexp_replace(whole, "/$", "")


def first_link(text: Column) -> Column:
    """The first http(s) link of a text: a Markdown link's target if none stands bare before it; null without any."""
    marked, bare = r"(?i)\[[^\]]*\]\((https?://[^\s)]+)\)", r"(?i)https?://[^\s)]+"
    before = lambda p: F.length(F.get(F.split(text, p, 2), 0))
    target, plain = F.nullif(F.regexp_extract(text, marked, 1), F.lit("")), F.nullif(F.regexp_extract(text, bare, 0), F.lit(""))
    return F.when(target.isNotNull() & (before(marked) <= before(bare)), target).otherwise(plain)


def links(text: Column) -> Column:
    """http(s) links in a text, without closing punctuation."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)https?://[^\s<>\"')\]]+"), F.lit(0))
    return F.filter(F.transform(found, lambda u: F.regexp_replace(u, r"[).,!?;:'\"\]]+$", "")), lambda u: u != "")


def valid_link(url: Column) -> Column:
    """The canonical form of a well-formed http(s) link, else null."""
    return F.when(F.trim(url).rlike(_PARTS) & ~url.rlike("%(?![0-9A-Fa-f]{2})"), canonical(url))


def url_id(url: Column) -> Column:
    return F.sha2(url, 256)


def video_id(url: Column) -> Column:
    """The 11 characters of a YouTube video, from watch, short, embed, live and v links."""
    of = lambda p: F.nullif(F.regexp_extract(url, p, 1), F.lit(""))
    return F.coalesce(of(r"youtu\.be/([A-Za-z0-9_-]{11})"), of(r"youtube(?:-nocookie)?\.com/(?:embed|shorts|live|v)/([A-Za-z0-9_-]{11})"), of(r"youtube(?:-nocookie)?\.com/watch\?(?:[^#]*&)?v=([A-Za-z0-9_-]{11})"))


def repo_key(url: Column) -> Column:
    """owner/name of a GitHub link in lower case, without ``.git``."""
    return F.nullif(F.lower(F.regexp_replace(F.regexp_extract(url, r"(?i)github\.com/([^/\s?#]+/[^/\s?#]+)", 1), r"\.git$", "")), F.lit(""))
