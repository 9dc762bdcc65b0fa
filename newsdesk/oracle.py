"""DuckDB SQL for the registered queries, written from the operators' definitions over the raw tables."""

from __future__ import annotations

from collections.abc import Iterable

from newsdesk import config as C
from newsdesk.functions.text import SPACE

EPOCH, AS_OF = "TIMESTAMP '2024-01-01 00:00:00'", "TIMESTAMP '2024-01-31 00:00:00'"
STOP = "TIMESTAMP '2024-01-08 00:00:00'"
BLANK = "[ \\t\\n\\r]+"
ORACLE_SQL: dict[str, str] = {}


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def nth(values: Iterable[str], index: str) -> str:
    return f"([{', '.join(map(lit, values))}])[CAST({index} AS BIGINT) + 1]"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(SPACE)}, ' ', 'g'))"


def hits(text: str, words: Iterable[str]) -> str:
    return "(" + (" + ".join(f"CAST(contains({text}, {lit(w.lower())}) AS INT)" for w in words) or "0") + ")"


def cases(of: str, values: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {of} = {lit(k)} THEN {lit(v) if isinstance(v, str) else v}" for k, v in values.items()) + f" ELSE {default} END"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def key(x: str, minimum: int) -> str:
    plain = f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), 'https?://[^ \\t\\n\\r]+', ' ', 'g'), '[^a-z0-9\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}} \\t\\n\\r]+', ' ', 'g'), '{BLANK}', ' ', 'g'))"
    return f"CASE WHEN length({plain}) >= {minimum} THEN {plain} END"


ITEMS = f"""items AS (
  SELECT 'd' || doc_id AS id, doc_id AS n, {nth(C.PLATFORMS, "doc_id % 7")} AS platform, '@' || source AS source_ref, left({collapse("text")}, 140) AS title, text AS body,
    'https://Example.com/' || source || '/' || (doc_id - doc_id % 3) || '/?utm_source=feed&b=2&a=' || (doc_id % 2) || '#top' AS url,
    'https://example.com/' || source || '/' || (doc_id - doc_id % 3) || '?a=' || (doc_id % 2) || '&b=2' AS canonical_url,
    CASE WHEN doc_id % 10 <> 0 THEN {EPOCH} + to_minutes(doc_id) END AS published_at, {EPOCH} + to_minutes(doc_id) + INTERVAL 6 HOUR AS ingested_at, {EPOCH} + to_minutes(doc_id) + INTERVAL 6 HOUR AS created_at, n_chars
  FROM documents)"""
CLASSES = f"""classes AS (
  SELECT doc_id * 10 + v AS classification_id, 'd' || doc_id AS item_id, doc_id AS n, CASE WHEN v = 1 THEN quality = 0 AND toxic = 1 ELSE quality = 0 END AS noise, (1 + quality) / 2.0 AS score,
    {nth(C.PRIMARY_ORDER, "(doc_id + v) % 11")} AS primary_tag, {nth(C.ACTION_ORDER, "doc_id % 4")} AS action_tag, CASE WHEN doc_id % 5 <> 0 THEN {nth(("PROMPT", "PAPER", "MCP"), "(doc_id + v) % 3")} END AS sub_tag, doc_id % 13 = 0 AS is_headline, doc_id % 19 = 0 AS is_dup, doc_id % 23 = 0 AS is_published,
    {EPOCH} + to_minutes(doc_id) + to_hours(v) AS classified_at
  FROM labels, (VALUES (0), (1)) AS t(v)),
latest_class AS (SELECT DISTINCT ON (item_id) * FROM classes ORDER BY item_id, classified_at DESC, classification_id DESC)"""
DECISIONS = f"""decisions AS (
  SELECT doc_id AS decision_id, 'd' || doc_id AS item_id, CAST(n_chars % 101 AS DOUBLE) AS priority_score, CAST(doc_id % 100 AS DOUBLE) AS headline_score, (doc_id % 10) / 10.0 AS dup_score, doc_id % 17 = 0 AS headline_candidate,
    CASE WHEN doc_id % 3 = 0 THEN 'tc_' || (doc_id % 50) END AS topic_cluster_key, doc_id % 4 AS distinct_sources, doc_id % 29 = 0 AS fallback
  FROM documents)"""
SOURCES = f"""sources AS (
  SELECT handle, {nth(("high", "medium", "low", "unknown", "blocked"), "rank % 5")} AS trust_label, rank AS source_id, CAST(rank * 7 % 100 AS DOUBLE) AS ai_score
  FROM (SELECT source AS handle, row_number() OVER (ORDER BY source) - 1 AS rank FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)))"""
ACCOUNTS = f"""accounts AS (
  SELECT source_id, handle, CASE WHEN source_id % 6 = 5 THEN 'seed' ELSE 'discovered' END AS type, source_id % 7 <> 6 AS active, {EPOCH} - to_days(CAST(source_id * 11 % 31 AS INT)) AS made_at,
    CASE WHEN source_id % 4 = 1 THEN {EPOCH} + to_days(CAST(source_id % 12 AS INT)) END AS cooldown_until, CASE WHEN source_id % 7 = 6 THEN {EPOCH} - INTERVAL 2 DAY END AS deactivated_at, trust_label AS label
  FROM sources)"""
EVENTS = "ev AS (SELECT 'e' || event_id AS id, event_id AS n, event_type AS platform, 'u' || user_id AS handle, ts AS published_at, ts + INTERVAL 1 HOUR AS ingested_at, value AS score, CAST(props ->> '$.k' AS DOUBLE) AS k FROM events)"


def add(name: str, select: str, *ctes: str, recursive: bool = False) -> None:
    ORACLE_SQL[name] = (f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(ctes) + "\n" if ctes else "") + select


add("normalize_items", f"""SELECT id, platform, source_ref, CASE WHEN length(title) <= 80 THEN nullif({collapse("title")}, '') ELSE left({collapse("title")}, 79) || '…' END AS title,
  {stamp("published_at")} AS published, {stamp("ingested_at")} AS ingested FROM (SELECT * REPLACE ({collapse("title")} AS title) FROM items)""", ITEMS)
add("future_dates_clamped", f"SELECT id, {stamp('CASE WHEN p > ingested_at THEN ingested_at ELSE p END')} AS published FROM (SELECT *, published_at + to_hours(n % 12) AS p FROM items)", ITEMS)
_CANON = """c AS (
  SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]+)([^?#]*)(\\?[^#]*)?', ['scheme', 'host', 'path', 'query']) AS u FROM pages),
p AS (SELECT page_id, u, list_sort(list_filter(string_split(u.query[2:], '&'), lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^(utm_.*|fbclid|gclid|igshid|mc_cid|mc_eid|ref|source|s)$'))) AS q FROM c),
k AS (SELECT page_id, u.scheme || '://' || lower(u.host) || CASE WHEN u.path = '' THEN '/' WHEN length(u.path) > 1 THEN regexp_replace(u.path, '/$', '') ELSE u.path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM p)"""
add("canonical_urls", "SELECT page_id, canonical, lower(canonical) AS rules_key FROM k", _CANON)
add("item_urls", "SELECT id, canonical_url AS canonical, lower(regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://', ''), '#.*$', ''), '/?$', '')) AS prefilter_key, regexp_replace('https://example.com' || substr(url, 20), '/$', '') AS article_key FROM items", ITEMS)
_alert = lambda names: f"""regexp_replace(u.scheme || '://' || lower(u.host) || CASE WHEN u.path = '' THEN '/' ELSE u.path END || coalesce('?' || nullif(array_to_string(list_filter(string_split(u.query[2:], '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ({', '.join(map(lit, names))})), '&'), ''), '') || regexp_extract(url, '#.*$'), CASE WHEN u.path IN ('', '/') THEN '^$' ELSE '/$' END, '')"""
add("alert_links", f"SELECT page_id, {_alert(C.ALERT_PARAMS)} AS collected, {_alert(C.FETCH_PARAMS)} AS fetched FROM c JOIN pages USING (page_id)", _CANON.partition(",\np AS")[0])
add("url_key_prefilter", "SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '#.*$', ''), '/?$', ''), '') AS key FROM pages")
add("content_hash", f"SELECT id, sha256(platform || '|' || id || '|' || coalesce(title, '') || '|' || coalesce(body, '') || '|' || coalesce({stamp('published_at')}, '')) AS content_hash FROM items", ITEMS)
add("title_keys", f"SELECT id, {key('title', 24)} AS rules_key, {key('title', 20)} AS prefilter_key FROM items", ITEMS)
_TOKENS = f"tok AS (SELECT id, n, list_filter(string_split(coalesce({key('title', 1)}, ''), ' '), lambda t: length(t) >= 4) AS raw FROM items), tk AS (SELECT id, n, list_filter(raw, lambda t, i: list_position(raw, t) = i) AS words FROM tok)"
add("title_tokens", "SELECT id, array_to_string(words, ',') AS tokens FROM tk", ITEMS, _TOKENS)
add("sanitised_text", "SELECT id, CAST(length(title) AS INT) AS length FROM items", ITEMS)
_PARTS = "sen AS (SELECT id, t, list_filter(list_transform(regexp_extract_all(t, '[^。！？.!?]+[。！？.!?]?'), lambda x: trim(x)), lambda x: x <> '') AS p FROM (SELECT id, " + collapse("body") + " AS t FROM items))"
add("summary_sentences", """SELECT id, CAST(CASE WHEN len(p) >= 2 THEN least(len(p), 3) ELSE 2 END AS INT) AS parts, CASE WHEN coalesce(t, '') = '' THEN '要約データなし。' WHEN len(p) >= 2 THEN p[1]
  WHEN trim(substr(t, CAST(ceil(length(t) / 2) AS BIGINT) + 1)) = '' THEN coalesce(nullif(trim(left(t, CAST(ceil(length(t) / 2) AS BIGINT))), ''), '要約データなし。') ELSE trim(left(t, CAST(ceil(length(t) / 2) AS BIGINT))) END AS first_part FROM sen""", ITEMS, _PARTS)
_LINKS = """found AS (SELECT page_id, regexp_replace(unnest(regexp_extract_all('see (' || url || '). ' || html, '(?i)https?://[^ \\t\\n\\r\\x0B\\f<>"'')\\]]+')), '[).,!?;:''"\\]]+$', '') AS link FROM pages),
c AS (SELECT page_id, link, regexp_extract(link, '^(https?)://([^/?#]+)([^?#]*)(\\?[^#]*)?', ['scheme', 'host', 'path', 'query']) AS u FROM found WHERE link <> '')"""
add("page_links", "SELECT page_id, count(*) AS links, count(DISTINCT CASE WHEN u.host <> '' AND NOT regexp_matches(regexp_replace(link, '%[0-9A-Fa-f]{2}', '', 'g'), '%') THEN canonical END) AS distinct_links FROM (SELECT * FROM k JOIN p USING (page_id, link)) GROUP BY 1",
    _LINKS, _CANON.partition(",\n")[2].replace("SELECT page_id, u,", "SELECT DISTINCT page_id, link, u,").replace("k AS (SELECT page_id, u.scheme", "k AS (SELECT page_id, link, u.scheme"))
add("links_stripped", f"SELECT id, nullif(left(trim(regexp_replace('see ' || regexp_replace(regexp_replace(title, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), 'https?://[^ \\t\\n\\r]+', '', 'g') || ' ', '{BLANK}', ' ', 'g')), 60), '') AS plain FROM items", ITEMS)
add("blurbs", f"SELECT id, CASE WHEN length(b) <= 280 THEN b ELSE left(b, 279) || '…' END AS blurb FROM (SELECT id, coalesce(nullif({collapse('body')}, ''), nullif({collapse('title')}, '')) AS b FROM items)", ITEMS)
_OUT = "html"
for _t in ("script", "style", "noscript", "svg", "iframe"):
    _OUT = f"regexp_replace({_OUT}, '(?is)<{_t}.*?</{_t}>', ' ', 'g')"
_OUT = f"regexp_replace({_OUT}, '<[^>]+>', ' ', 'g')"


def decoded(x: str) -> str:
    for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        x = f"replace({x}, '&{name};', {lit(value)})"
    return x


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
add("page_titles", f"SELECT page_id, nullif({collapse(decoded(_TITLE))}, '') AS title FROM pages")
add("readable_pages", f"SELECT page_id, CAST(length(r) AS INT) AS chars, sha256(r) AS text_sha256 FROM (SELECT page_id, {collapse(decoded(_OUT))} AS r FROM pages)")
add("video_ids", "SELECT 'd' || doc_id AS id, lpad(CAST(doc_id AS VARCHAR), 11, 'a') AS video_id, lpad(CAST(doc_id AS VARCHAR), 11, 'b') AS short_id FROM documents")
add("strict_times", """SELECT doc_id, strftime(d, '%Y-%m-%d') AS day, strftime(CASE WHEN doc_id % 5 < 2 THEN d + INTERVAL 10 HOUR WHEN doc_id % 5 = 2 THEN d + INTERVAL 30 MINUTE END, '%Y-%m-%d %H:%M:%S') AS instant
FROM (SELECT doc_id, TRY_CAST('2024-02-' || lpad(CAST(doc_id % 33 AS VARCHAR), 2, '0') AS DATE) AS d FROM documents)""")
add("entities_decoded", "SELECT id, title || ' &lt; é😀 &nope; \"' AS decoded FROM items", ITEMS)

# --- classification
_text = collapse("lower(concat_ws(chr(10), CASE WHEN trim(title) <> '' THEN title END, CASE WHEN trim(body) <> '' THEN body END, source_ref, url))")
_boost = lambda tag, base, boosts: hits("text", base) + "".join(f" + CASE WHEN platform = {lit(p)} THEN {hits('text', w[tag])} ELSE 0 END" for p, w in boosts.items() if tag in w)
_min = cases("platform", C.LOW_INFO_MIN_CHARS, str(C.DEFAULT_LOW_INFO_MIN_CHARS))
SCORED = f"""texts AS (SELECT *, {_text} AS text FROM items),
counted AS (SELECT *, {hits("text", C.AI_KEYWORDS)} AS ai, {_min} AS low_min FROM texts),
scored AS (SELECT *, CASE WHEN text = '' THEN 'EMPTY_CONTENT' WHEN platform = 'twitter' AND regexp_matches(text, '^(rt\\s+@|@[a-z0-9_]+\\s*$)') THEN 'PLATFORM_NOISE_PATTERN'
  WHEN length(text) < low_min AND ai < 2 THEN 'LOW_INFORMATION_DENSITY' WHEN epoch({AS_OF}) - epoch(coalesce(published_at, ingested_at)) > 31 * 86400 THEN 'STALE_INFORMATION' WHEN ai = 0 THEN 'OUT_OF_SCOPE' END AS noise_reason FROM counted)"""
add("rules_noise", "SELECT id, ai AS ai_hits, noise_reason IS NOT NULL AS noise, noise_reason FROM scored", ITEMS, SCORED)
_arg = lambda scores: "CASE " + " ".join(f"WHEN greatest({', '.join(c for _, c in scores)}) = {c} THEN {lit(t)}" for t, c in scores) + " END"
_pcols = ", ".join(f"{_boost(t, C.PRIMARY_KEYWORDS[t], C.PRIMARY_BOOSTS)} AS p_{t}" for t in C.PRIMARY_ORDER)
_acols = ", ".join(f"{_boost(t, C.ACTION_KEYWORDS[t], C.ACTION_BOOSTS)} AS a_{t}" for t in C.ACTION_ORDER)
_scols = ", ".join(f"{hits('text', w)} AS s_{t}" for t, w in C.SUB_KEYWORDS.items())
TAGGED = f"""cols AS (SELECT *, {_pcols}, {_acols}, {_scols} FROM scored),
best AS (SELECT *, greatest({', '.join('p_' + t for t in C.PRIMARY_ORDER)}) AS pmax, {_arg([(t, 'p_' + t) for t in C.PRIMARY_ORDER])} AS ptag, greatest({', '.join('a_' + t for t in C.ACTION_ORDER)}) AS amax, {_arg([(t, 'a_' + t) for t in C.ACTION_ORDER])} AS atag FROM cols),
tag AS (SELECT *, CASE WHEN pmax > 0 THEN ptag ELSE 'OTHER' END AS pt, CASE WHEN amax > 0 THEN atag ELSE 'INFO' END AS act FROM best),
sub AS (SELECT *, CASE {' '.join(f"WHEN pt = {lit(p)} AND greatest({', '.join('s_' + x for x in ss)}) > 0 THEN {_arg([(x, 's_' + x) for x in ss])}" for p, ss in C.SUB_BY_PRIMARY.items())} END AS st FROM tag)"""
add("rules_primary_tag", "SELECT id, pt AS primary_tag, CAST(pmax AS INT) AS hits FROM tag", ITEMS, SCORED, TAGGED)
add("rules_classify", """SELECT id, noise_reason IS NOT NULL AS noise, noise_reason, CASE WHEN noise_reason IS NULL THEN pt END AS primary_tag, CASE WHEN noise_reason IS NULL THEN st END AS sub_tag, CASE WHEN noise_reason IS NULL THEN act END AS action_tag,
  noise_reason IS NULL AND length(text) < 120 AS low_info,
  round(CASE WHEN noise_reason = 'LOW_INFORMATION_DENSITY' THEN 0.72 WHEN noise_reason IS NOT NULL THEN 0.92 ELSE greatest(0.4, least(0.99, 0.5::DOUBLE + least(greatest(pmax, 1), 4) * 0.08 + CASE WHEN st IS NOT NULL THEN 0.08 ELSE 0 END
    + CASE WHEN act <> 'INFO' THEN 0.06 ELSE 0 END + CASE WHEN ai > 2 THEN 0.08 ELSE 0 END - CASE WHEN length(text) < 120 THEN 0.12 ELSE 0 END)) END::DOUBLE, 6) AS confidence FROM sub""", ITEMS, SCORED, TAGGED)
_sig = lambda words, prefix: ", ".join(f"CASE WHEN contains(text, {lit(w.lower())}) THEN {lit(prefix + ':' + w)} END" for w in words)
_dom = f"list_filter([{_sig(C.AI_KEYWORDS, 'domain:ai')}], lambda x: x IS NOT NULL)"
_rest = ", ".join([_sig(w, f"primary:{t}") for t, w in C.PRIMARY_KEYWORDS.items() if w] + [_sig(w, f"action:{t}") for t, w in C.ACTION_KEYWORDS.items() if w])
add("matched_signals", f"SELECT id, array_to_string(CASE WHEN noise_reason IS NOT NULL THEN {_dom} ELSE list_concat({_dom}, list_filter([{_rest}], lambda x: x IS NOT NULL))[1:20] END, ';') AS signals FROM scored", ITEMS, SCORED)
add("latest_classification", "SELECT item_id, classification_id, noise, score::DOUBLE AS score, primary_tag FROM latest_class", CLASSES)
add("normalised_tags", f"""SELECT classification_id, primary_tag, CASE {' '.join(f"WHEN primary_tag = {lit(p)} AND s IN ({', '.join(map(lit, ss))}) THEN s" for p, ss in C.SUB_BY_PRIMARY.items())} END AS sub_tag, CASE WHEN n % 3 = 0 THEN 'INFO' ELSE action_tag END AS action_tag
FROM (SELECT *, CASE WHEN n % 2 = 0 THEN 'RAG_SEARCH' ELSE 'PAPER' END AS s FROM classes)""", CLASSES)
add("flags_carried_forward", "SELECT a.item_id, coalesce(b.is_headline, false) AS is_headline, coalesce(b.is_dup, false) AS is_dup, coalesce(b.is_published, false) AS is_published FROM classes a LEFT JOIN (SELECT DISTINCT ON (item_id) * FROM classes WHERE classification_id % 10 = 0 AND n % 2 = 0 ORDER BY item_id, classified_at DESC) b USING (item_id) WHERE a.classification_id % 10 = 1", CLASSES)
add("pending_classification", "SELECT 'd' || doc_id AS id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 3 <> 1")
add("request_batches", "SELECT CAST((r - 1) // 45 AS BIGINT) AS batch, count(*) AS items, CAST(min(r) AS INT) AS first_rank FROM (SELECT row_number() OVER (ORDER BY published_at DESC NULLS LAST, id) AS r FROM items) WHERE r <= 600 GROUP BY 1", ITEMS)

# --- duplicates
_KEYS = lambda profile: f"""keyed AS (SELECT id, n, reason, key FROM (
  SELECT id, n, 'canonical_url_match' AS reason, {"lower(canonical_url)" if profile == "rules" else "lower(regexp_replace(regexp_replace(canonical_url, '^https?://', ''), '/?$', ''))"} AS key FROM items
  UNION ALL SELECT id, n, 'url_match', {"lower(canonical_url)" if profile == "rules" else "regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://', ''), '#.*$', ''), '/?$', '')"} FROM items
  UNION ALL SELECT id, n, 'title_exact_match', {key("title", 24 if profile == "rules" else 20)} FROM items) WHERE key IS NOT NULL)"""  # noqa: E731
_COMP = """both_ways AS (SELECT u, v FROM edge UNION SELECT v, u FROM edge),
reach AS (SELECT u AS x, v AS y FROM both_ways UNION SELECT r.x, e.v FROM reach r JOIN both_ways e ON r.y = e.u),
comp AS (SELECT x AS n, least(x, min(y)) AS component FROM reach GROUP BY x),
sized AS (SELECT *, count(*) OVER (PARTITION BY component) AS size FROM comp)"""
_STAR = "edge AS (SELECT k.n AS u, m.v FROM keyed k JOIN (SELECT reason, key, min(n) AS v, count(*) AS c FROM keyed GROUP BY ALL HAVING count(*) > 1) m USING (reason, key) WHERE k.n <> m.v)"
_LEN = lambda c, collapsed: f"length({collapse(f'coalesce({c}, {lit(str())})') if collapsed else f'trim(coalesce({c}, {lit(str())}))'})"
_DETAIL = {
    "rules": f"round((least({_LEN('body', False)}, 4000) + least({_LEN('title', False)}, 220) * 1.8 + 20 + CASE WHEN published_at IS NOT NULL THEN 14 ELSE 0 END + {cases('platform', C.DETAIL_PLATFORM, '0')})::DOUBLE, 3)",
    "prefilter": f"round((least({_LEN('body', True)}, 3500) + least({_LEN('title', True)}, 220) * 1.6 + 18 + CASE WHEN published_at IS NOT NULL THEN 12 ELSE 0 END)::DOUBLE, 3)",
}
_MASTER = lambda p: f"mem AS (SELECT i.*, component, {_DETAIL[p]} AS detail FROM items i JOIN sized USING (n)), top AS (SELECT DISTINCT ON (component) component, id AS master_id FROM mem ORDER BY component, detail DESC, coalesce(published_at, ingested_at) DESC, id)"
add("exact_dup_groups", "SELECT reason, key, count(*) AS items, min(id) AS first_id FROM keyed GROUP BY ALL HAVING count(*) > 1", ITEMS, _KEYS("rules"))
add("dup_components", "SELECT id, component, size FROM items JOIN sized USING (n)", ITEMS, _KEYS("rules"), _STAR, _COMP, recursive=True)
add("dup_master", "SELECT id, component, master_id, detail FROM mem JOIN top USING (component)", ITEMS, _KEYS("rules"), _STAR, _COMP, _MASTER("rules"), recursive=True)
add("published_match", """SELECT id, published_id, string_agg(reason, ',' ORDER BY reason) AS reasons, CAST(max(CASE reason WHEN 'canonical_url_match' THEN 0.96 WHEN 'url_match' THEN 0.92 WHEN 'title_exact_match' THEN 0.82 END) AS DOUBLE) AS score
FROM (SELECT DISTINCT a.id, b.id AS published_id, reason FROM keyed a JOIN keyed b USING (reason, key) WHERE a.n % 11 <> 0 AND b.n % 11 = 0) GROUP BY ALL""", ITEMS, _KEYS("rules"))
_PAIRS = """cand AS (SELECT DISTINCT a.n AS u, b.n AS v, a.words AS wu, b.words AS wv FROM (SELECT n, words, unnest(words[1:4]) AS w FROM tk WHERE len(words) >= 4) a JOIN (SELECT n, words, unnest(words) AS w FROM tk WHERE len(words) >= 4) b USING (w) WHERE a.n < b.n),
sim AS (SELECT u, v, len(list_intersect(wu, wv)) / (len(wu) + len(wv) - len(list_intersect(wu, wv))) AS s, wu = wv AS same FROM cand),
pairs AS (SELECT u, v, round(s, 3) AS similarity, same FROM sim WHERE s >= 0.82)"""
# Equal word lists are tied to their first item, and only first items are compared with other lists.
_FIRSTS = "firsts AS (SELECT words, min(n) AS f FROM tk WHERE len(words) >= 4 GROUP BY words), star AS (SELECT f AS u, n AS v, 1.0::DOUBLE AS similarity FROM tk JOIN firsts USING (words) WHERE n <> f), tied AS (SELECT u, v, similarity FROM pairs WHERE NOT same AND u IN (SELECT f FROM firsts) AND v IN (SELECT f FROM firsts) UNION ALL SELECT * FROM star)"
add("title_jaccard_pairs", "SELECT u, v, similarity::DOUBLE AS similarity FROM tied", ITEMS, _TOKENS, _PAIRS, _FIRSTS)
add("prefilter_clusters", "SELECT id, component, master_id, detail FROM mem JOIN top USING (component)", ITEMS, _KEYS("prefilter"), _TOKENS, _PAIRS, _FIRSTS, "exact AS (SELECT k.n AS u, m.v FROM keyed k JOIN (SELECT reason, key, min(n) AS v, count(*) AS c FROM keyed GROUP BY ALL HAVING count(*) > 1) m USING (reason, key) WHERE k.n <> m.v), edge AS (SELECT u, v FROM exact UNION SELECT u, v FROM tied)", _COMP, _MASTER("prefilter"), recursive=True)
SEEDS = f"""placed AS (SELECT i.*, coalesce(c.component, i.n) AS component FROM items i LEFT JOIN comp c ON c.n = i.n),
rated AS (SELECT *, round(CAST(least(length(coalesce({collapse('body')}, '')), 3500) + least(length(coalesce({collapse('title')}, '')), 220) * 1.6 + 18 + CASE WHEN published_at IS NULL THEN 0 ELSE 12 END AS DOUBLE), 3) AS detail FROM placed),
led AS (SELECT component, id AS master_id, n AS m FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY detail DESC, coalesce(published_at, ingested_at, created_at) DESC, id) AS r FROM rated) WHERE r = 1),
serial AS (SELECT component, row_number() OVER (ORDER BY component) AS no FROM (SELECT DISTINCT component FROM placed)),
tie AS (SELECT a.n, a.reason, CAST(CASE a.reason WHEN 'canonical_url_match' THEN 1.0 WHEN 'url_match' THEN 0.96 ELSE 0.9 END AS DOUBLE) AS s, CASE a.reason WHEN 'canonical_url_match' THEN 0 WHEN 'url_match' THEN 1 ELSE 2 END AS o FROM placed p JOIN led USING (component) JOIN keyed a ON a.n = p.n JOIN keyed b ON b.n = m AND a.reason = b.reason AND a.key = b.key
  UNION ALL SELECT p.n, 'title_similarity', round(len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))), 3), 3 FROM placed p JOIN led USING (component) JOIN tk a ON a.n = p.n JOIN tk b ON b.n = m WHERE len(a.words) >= 4 AND len(b.words) >= 4),
best AS (SELECT DISTINCT ON (n) n, s, reason FROM tie WHERE s >= 0.82 ORDER BY n, s DESC, o)"""
_PREFILTER = (ITEMS, _KEYS("prefilter"), _TOKENS, _PAIRS, _FIRSTS, "exact AS (SELECT k.n AS u, m.v FROM keyed k JOIN (SELECT reason, key, min(n) AS v, count(*) AS c FROM keyed GROUP BY ALL HAVING count(*) > 1) m USING (reason, key) WHERE k.n <> m.v), edge AS (SELECT u, v FROM exact UNION SELECT u, v FROM tied)", _COMP)
add("prefilter_seeds", """SELECT p.id, '2024-01-31-c' || CASE WHEN no < 10000 THEN lpad(CAST(no AS VARCHAR), 4, '0') ELSE CAST(no AS VARCHAR) END AS cluster_id, master_id AS canonical_id, CAST(CASE WHEN p.id = master_id THEN 0 ELSE coalesce(s, 0.76) END AS DOUBLE) AS seed_score,
  CASE WHEN p.id = master_id THEN 'cluster_canonical' ELSE coalesce(reason, 'cluster_similarity') END AS seed_reason, p.id <> master_id AS pruned FROM placed p JOIN led USING (component) JOIN serial USING (component) LEFT JOIN best b ON b.n = p.n""", *_PREFILTER, SEEDS, recursive=True)
add("member_reasons", """SELECT mem.id, master_id, coalesce(r.reasons, 'cluster_match') AS reasons, CAST(coalesce(r.score, 0.7) AS DOUBLE) AS score FROM mem JOIN top USING (component) LEFT JOIN (
  SELECT a.id, string_agg(a.reason, ',' ORDER BY a.reason) AS reasons, max(CASE a.reason WHEN 'canonical_url_match' THEN 0.96 WHEN 'url_match' THEN 0.92 ELSE 0.82 END) AS score FROM mem x JOIN top USING (component) JOIN keyed a ON a.id = x.id JOIN keyed b ON b.id = master_id AND a.reason = b.reason AND a.key = b.key GROUP BY 1) r ON r.id = mem.id WHERE mem.id <> master_id""", ITEMS, _KEYS("rules"), _STAR, _COMP, _MASTER("rules"), recursive=True)
add("numbered_batches", "SELECT id, CAST((row_number() OVER (ORDER BY published_at DESC NULLS LAST, id) - 1) // 45 AS BIGINT) AS batch FROM items", ITEMS)
_utc = lambda x: f"strftime({x}, '%Y-%m-%dT%H:%M:%S.000Z')"
_js = lambda x: f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST(CAST({x} AS DOUBLE) AS VARCHAR) END"
_edges = lambda x: f"nullif(regexp_replace(regexp_replace({x}, {lit(SPACE + '$')}, ''), {lit('^' + SPACE)}, ''), '')"
add("input_hashes", f"""SELECT i.id, sha256(CAST(json_object('platform', platform, 'sourceItemId', i.id, 'canonicalUrl', canonical_url, 'title', {_edges('title')}, 'body', {_edges('body')}, 'publishedAt', {_utc('published_at')}) AS VARCHAR)) AS item_hash,
  sha256(CAST(json_object('ruleVersion', 'v1', 'id', i.id, 'platform', platform, 'title', nullif(title, ''), 'body', nullif(body, ''), 'url', url, 'canonicalUrl', canonical_url, 'publishedAt', {_utc('published_at')}, 'updatedAt', {_utc('ingested_at')}) AS VARCHAR)) AS rules_hash,
  sha256('{{"editionDate":"2024-01-08T00:00:00.000Z","item":' || CAST(json_object('id', i.id, 'platform', platform, 'url', url, 'canonicalUrl', canonical_url, 'title', nullif(title, ''), 'updatedAt', {_utc('ingested_at')}, 'publishedAt', {_utc('published_at')}) AS VARCHAR)
    || ',"classification":{{"id":' || classification_id || ',"primaryTag":"' || primary_tag || '","subTag":' || coalesce('"' || sub_tag || '"', 'null') || ',"actionTag":"' || action_tag || '","score":' || {_js('l.score')} || ',"isDup":' || is_dup || '}},"decision":'
    || CASE WHEN d.decision_id IS NULL THEN 'null' ELSE '{{"id":' || d.decision_id || ',"inputHash":"' || CASE WHEN i.n % 29 = 0 THEN {lit(C.FALLBACK_HASH_PREFIX)} ELSE 'h' END || i.n || '","priorityScore":' || {_js('priority_score / 8')} || '}}' END || ',"placement":{{"section":"4_tech","position":' || i.n || '}}}}') AS publish_hash
FROM items i JOIN latest_class l ON l.item_id = i.id LEFT JOIN (SELECT * FROM decisions WHERE decision_id % 2 = 0) d ON d.item_id = i.id""", ITEMS, CLASSES, DECISIONS)
add("raw_hashes", """SELECT event_id, sha256('{"list":[1,{"a":null,"z":' || CASE event_id % 3 WHEN 0 THEN event_id || '.5' WHEN 1 THEN CAST(event_id * 100 AS VARCHAR) ELSE CAST(event_id AS VARCHAR) END || '}],"props":{"k":' || CAST(props ->> '$.k' AS VARCHAR) || '}}') AS raw_hash FROM events""")
add("items_table", f"""SELECT platform, id, n, CASE WHEN n % 3 = 0 AND n % 2 = 0 THEN 'new ' || title ELSE title END AS text, CASE WHEN n % 5 > 0 THEN {stamp('created_at')} END AS created FROM items WHERE (n % 5 > 0 OR n % 3 = 0) AND n % 7 <> 6""", ITEMS)
_COS = lambda t: f"cos AS (SELECT a.vec_id AS u, b.vec_id AS v, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id), edge AS (SELECT u, v, c FROM cos WHERE c >= {t})"
add("cosine_pairs", "SELECT u, v, round(c, 6) AS cosine FROM edge", _COS(0.45))
add("topic_clusters", f"""SELECT vec_id, topic_key, size, sources, platforms, round(CASE WHEN sources >= 2 THEN log2(1 + sources) * (1 + {C.CLUSTER_GAMMA} * (platforms - 1)) ELSE 0 END::DOUBLE, 6) AS boost
FROM m JOIN (SELECT component, 'tc_' || left(sha256(string_agg(CAST(vec_id AS VARCHAR), '|' ORDER BY CAST(vec_id AS VARCHAR))), 16) AS topic_key, count(*) AS size, count(DISTINCT (label % 3) || ':' || label) AS sources, count(DISTINCT label % 3) AS platforms FROM m GROUP BY component) USING (component)""",
    _COS(0.40), _COMP, "m AS (SELECT vec_id, label, coalesce(component, vec_id) AS component FROM embeddings LEFT JOIN comp ON n = vec_id)", recursive=True)
add("event_components", "SELECT n AS node, component FROM comp", "edge AS (SELECT DISTINCT user_id AS u, event_id % 40 + 100000 AS v FROM events WHERE event_type = 'purchase')", _COMP, recursive=True)

# --- scores
_age = f"(epoch({AS_OF}) - epoch(coalesce(published_at, ingested_at))) / 3600"
HEADLINES = f"""hs AS (SELECT id, round(greatest(0, least(120, 10 + coalesce(score, 0.5) * 40 + {cases('primary_tag', C.HEADLINE_PRIMARY, '0')} + {cases('action_tag', C.HEADLINE_ACTION, '0')}
  + least({_LEN('body', False)}, 1200) / 120 + least({_LEN('title', False)}, 120) / 30 + CASE WHEN {_age} <= 24 THEN 20 WHEN {_age} <= 72 THEN 14 WHEN {_age} <= 168 THEN 8 WHEN {_age} <= 336 THEN 4 ELSE 0 END
  + CASE WHEN platform IN ('qiita', 'github', 'alerts') THEN 2 ELSE 0 END + CASE WHEN {_LEN('body', False)} > 900 THEN 3 ELSE 0 END - CASE WHEN {_LEN('body', False)} < 60 THEN 4 ELSE 0 END))::DOUBLE, 3) AS headline_score
  FROM items JOIN latest_class ON id = item_id)"""
add("headline_scores", "SELECT * FROM hs", ITEMS, CLASSES, HEADLINES)
add("headline_slots", "SELECT id, headline_score, CAST(slot AS INT) AS slot FROM (SELECT *, row_number() OVER (ORDER BY headline_score DESC, id) AS slot, count(*) OVER () AS c FROM hs) WHERE slot <= least(5, greatest(1, ceil(c * 0.2))) AND (headline_score >= 35 OR slot = 1)", ITEMS, CLASSES, HEADLINES)
OWNED = "owned AS (SELECT id AS item_id, n, source_id, created_at FROM items JOIN sources ON lower(source_ref[2:]) = lower(handle))"
SUMMARY = f"""isum AS (SELECT source_id, count(*) AS items_28, count(*) FILTER (created_at >= {STOP} - INTERVAL 7 DAY) AS items_7, max(created_at) AS latest_at FROM owned WHERE created_at >= {STOP} - INTERVAL 28 DAY AND created_at < {STOP} GROUP BY source_id),
c28 AS (SELECT source_id, item_id, noise, score, created_at >= {STOP} - INTERVAL 7 DAY AND classified_at >= {STOP} - INTERVAL 7 DAY AS week FROM owned JOIN classes USING (item_id) WHERE created_at >= {STOP} - INTERVAL 28 DAY AND created_at < {STOP} AND classified_at >= {STOP} - INTERVAL 28 DAY AND classified_at < {STOP}),
csum AS (SELECT source_id, count(*) AS classes_28, count(*) FILTER (week) AS classes_7, count(DISTINCT item_id) AS classified_28, count(DISTINCT item_id) FILTER (week) AS classified_7, count(*) FILTER (noise) AS noise_28, round(avg(score), 6) AS mean_score FROM c28 GROUP BY source_id),
asum AS (SELECT source_id, count(DISTINCT item_id) AS adopted_28 FROM owned WHERE n % 11 = 0 AND item_id IN (SELECT item_id FROM classes) GROUP BY source_id),
dsum AS (SELECT source_id, round(avg(priority_score), 6) AS mean_priority, round(avg(1 - dup_score), 6) AS mean_originality FROM owned JOIN decisions USING (item_id) GROUP BY source_id),
summ AS (SELECT s.*, coalesce(items_28, 0) AS items_28, coalesce(items_7, 0) AS items_7, latest_at, coalesce(classes_28, 0) AS classes_28, coalesce(classes_7, 0) AS classes_7, coalesce(classified_28, 0) AS classified_28, coalesce(classified_7, 0) AS classified_7, coalesce(noise_28, 0) AS noise_28, mean_score, coalesce(adopted_28, 0) AS adopted_28, mean_priority, mean_originality
  FROM sources s LEFT JOIN isum USING (source_id) LEFT JOIN csum USING (source_id) LEFT JOIN asum USING (source_id) LEFT JOIN dsum USING (source_id)),
med AS (SELECT round(median(adopted_28 / classified_28), 6) AS median_adoption, round(median(mean_priority / 100), 6) AS median_priority FROM summ WHERE classified_28 >= 15)"""
_base = (ITEMS, SOURCES, CLASSES, DECISIONS, OWNED, SUMMARY)
add("item_summary", f"SELECT source_id, items_28, items_7, {stamp('latest_at')} AS latest FROM isum", *_base)
add("class_summary", "SELECT * FROM csum", *_base)
add("adoption_summary", "SELECT * FROM asum", *_base)
add("decision_summary", "SELECT * FROM dsum", *_base)
add("source_summary", "SELECT * EXCLUDE (latest_at) FROM summ", *_base)
add("trust_medians", "SELECT * FROM med", *_base)
_w = {k: v / sum(C.TRUST_WEIGHTS.values()) for k, v in C.TRUST_WEIGHTS.items()}
_unit = lambda x: f"greatest(0, least(1, {x}))"
_above = lambda v, m: f"CASE WHEN {v} IS NULL OR {m} IS NULL OR {v} <= {m} OR {m} >= 1 THEN 0.5 ELSE {_unit(f'0.5 + 0.5 * ({v} - {m}) / (1 - {m})')} END"
TRUST = f"""parts AS (SELECT *, coalesce(1 - CASE WHEN classes_28 > 0 THEN {_unit('noise_28 / classes_28')} END, 0.5) AS nn, CASE WHEN classified_28 > 0 THEN {_unit('adopted_28 / classified_28')} ELSE 0 END AS ad, {_unit('mean_priority / 100')} AS pr, {_unit('1 - classified_28 / 50')} AS decay FROM summ, med),
total AS (SELECT *, (0.6::DOUBLE * nn + 0.4 * {_unit('coalesce(mean_score, 0.5)')}) * ({_w['item_quality']}::DOUBLE + {_w['prior']}::DOUBLE * (1 - decay)) + (0.6::DOUBLE * {_above('CASE WHEN mean_priority IS NOT NULL THEN pr END', 'median_priority')} + 0.4 * {_above('ad', 'median_adoption')}) * {_w['selection']}::DOUBLE
  + {_unit('coalesce(ai_score / 100, 0.5)')} * {_w['prior']}::DOUBLE * decay + (0.6::DOUBLE * coalesce(exp(-greatest(0, (epoch({STOP}) - epoch(latest_at)) / 86400) / 14), 0.5) + 0.4 * {_unit('coalesce(mean_originality, 0.5)')}) * {_w['freshness']}::DOUBLE AS t FROM parts),
trust AS (SELECT source_id, CAST(floor(round({_unit('t')} * 100, 6) + 0.5) AS INT) AS trust_score, trust_label, classified_28 < 15 OR made_at > {STOP} - INTERVAL 14 DAY AS cold_start FROM total JOIN accounts USING (source_id)),
labelled AS (SELECT source_id, trust_score, CASE WHEN trust_label = 'blocked' THEN 'blocked' WHEN cold_start THEN 'unknown' WHEN trust_score >= 75 THEN 'high' WHEN trust_score >= 50 THEN 'medium' ELSE 'low' END AS new_label, cold_start FROM trust)"""
TRUSTED = (*_base, ACCOUNTS, TRUST)
add("trust_score", "SELECT * FROM labelled", *TRUSTED)
add("trust_labels", "SELECT new_label, count(*) AS sources FROM labelled GROUP BY 1", *TRUSTED)
add("noise_percentile", "SELECT round(quantile_cont(rate, 0.1), 9) AS bottom_decile, round(median(rate), 9) AS median, count(*) AS users FROM (SELECT user_id, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END)::DOUBLE AS rate FROM events GROUP BY 1)")
FLAGS = f"""scanned AS (SELECT summ.*, trust_score, made_at, cooldown_until, CASE WHEN classes_28 > 0 THEN noise_28 / classes_28 END AS rate FROM summ JOIN labelled USING (source_id) JOIN accounts a USING (source_id) WHERE a.type = 'discovered' AND a.active),
bars AS (SELECT median(rate) AS nm, quantile_cont(mean_priority, 0.1) AS lo FROM scanned WHERE classified_28 >= 20),
flagged AS (SELECT source_id, concat_ws('+', CASE WHEN rate >= 0.35 AND rate >= nm + 0.15 THEN 'noisy' END, CASE WHEN mean_priority <= lo THEN 'low_priority' END, CASE WHEN trust_score < 45 THEN 'low_trust' END) AS condition_keys, coalesce(rate, 0) >= 0.85 AS severe,
  (cooldown_until IS NULL OR cooldown_until <= {STOP}) AND made_at < {STOP} - INTERVAL 14 DAY AND classified_28 >= 20 AND (coalesce(rate >= 0.35 AND rate >= nm + 0.15, false) OR coalesce(mean_priority <= lo, false) OR coalesce(trust_score < 45, false)) AS should_act FROM scanned, bars)"""
add("lifecycle_flags", "SELECT * FROM flagged", *TRUSTED, FLAGS)
ACTED = f"""happened AS (SELECT user_id % (SELECT count(*) FROM sources) AS source_id, ts - to_days(CAST(24 + 2 * (user_id % (SELECT count(*) FROM sources) % 5) AS INT)) AS happened_at, event_id, CASE WHEN event_id % 40 = 0 THEN 'deactivate' WHEN event_id % 41 = 0 THEN 'restore' ELSE 'demote' END AS action, event_id % 80 = 0 AS severe,
  CASE event_id % 3 WHEN 0 THEN ['noisy', 'low_trust'] WHEN 1 THEN ['low_priority'] ELSE ['low_trust'] END AS keys FROM events WHERE event_type = 'error'),
resets AS (SELECT DISTINCT ON (source_id) source_id, happened_at AS reset_at, action AS reset, severe AS reset_severe FROM happened WHERE action <> 'demote' ORDER BY source_id, happened_at DESC, event_id DESC),
demoted AS (SELECT DISTINCT ON (source_id) source_id, h.happened_at AS demoted_at, keys AS old FROM happened h LEFT JOIN resets USING (source_id) WHERE h.action = 'demote' AND (reset_at IS NULL OR h.happened_at > reset_at) ORDER BY source_id, h.happened_at DESC, event_id DESC),
judged AS (SELECT f.source_id, f.severe, CASE WHEN f.source_id % 2 = 0 THEN ['noisy'] ELSE ['low_priority', 'low_trust'] END AS keys, coalesce(list_has_any(old, CASE WHEN f.source_id % 2 = 0 THEN ['noisy'] ELSE ['low_priority', 'low_trust'] END), false) AS shared, (epoch({STOP}) - epoch(demoted_at)) / 86400 AS age
  FROM flagged f LEFT JOIN demoted USING (source_id) WHERE f.source_id % 5 <> 4),
acted AS (SELECT source_id, CASE WHEN shared AND age BETWEEN 6 AND 8 THEN 'deactivate' WHEN shared AND age < 6 THEN 'skip' ELSE 'demote' END AS action, severe, keys FROM judged)"""
add("lifecycle_actions", "SELECT source_id, action, 'lifecycle:' || array_to_string(keys, '+') || CASE WHEN action = 'skip' THEN ':awaiting_second_window' ELSE '' END AS reason, severe, array_to_string(keys, '+') AS condition_keys FROM acted", *TRUSTED, FLAGS, ACTED)
add("lifecycle_state", f"""SELECT source_id, CASE WHEN reset IS NOT NULL THEN reset = 'restore' ELSE active END AS active, CASE WHEN reset = 'deactivate' AND reset_severe THEN 'blocked' WHEN reset = 'restore' AND label = 'blocked' THEN 'unknown' ELSE label END AS trust_label,
  {stamp('CASE WHEN reset IS NOT NULL THEN reset_at + INTERVAL 30 DAY ELSE cooldown_until END')} AS cooldown, {stamp("CASE WHEN reset = 'deactivate' THEN reset_at WHEN reset IS NULL THEN deactivated_at END")} AS deactivated
FROM accounts LEFT JOIN (SELECT DISTINCT ON (source_id) source_id, happened_at AS reset_at, action AS reset, severe AS reset_severe FROM (SELECT source_id, happened_at, action, severe FROM happened WHERE action <> 'demote' UNION ALL SELECT source_id, {STOP}, action, severe FROM acted WHERE action = 'deactivate') ORDER BY source_id, happened_at DESC) USING (source_id)""", *TRUSTED, FLAGS, ACTED)
add("lifecycle_due", f"SELECT source_id, {stamp('u')} AS cooldown FROM (SELECT source_id, CASE WHEN source_id % 3 > 0 THEN {STOP} - to_days(CAST(source_id * 9 AS INT)) + INTERVAL {C.COOLDOWN_DAYS} DAY END AS u FROM sources) WHERE source_id % 5 <> 4 AND (u IS NULL OR u <= {STOP})", SOURCES)
add("demotion_gate", """SELECT user_id AS source_id, event_id FROM (
  SELECT *, last_value(CASE WHEN a = 0 THEN ts END IGNORE NULLS) OVER w AS pt, last_value(CASE WHEN a = 0 THEN event_id % 2 END IGNORE NULLS) OVER w AS pk, last_value(CASE WHEN a > 0 THEN ts END IGNORE NULLS) OVER w AS rt
  FROM (SELECT *, event_id % 3 AS a FROM events WHERE event_type = 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE a = 0 AND (epoch(ts) - epoch(pt)) / 86400 BETWEEN 6 AND 8 AND (rt IS NULL OR rt < pt) AND pk = event_id % 2""")
_asked = """c AS (SELECT c_name AS handle, c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN c_mktsegment END AS bio, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 200 END AS followers, c_custkey % 5 > 1 AS sampled FROM customer),
known AS (SELECT DISTINCT lower(handle) AS handle FROM accounts WHERE active),
mentions AS (SELECT DISTINCT handle, by_ FROM (SELECT handle, unnest(([('src' || (k * 3) % 40), ('src' || (k * 5 + 1) % 40), ('src' || (k * 7 + 2) % 40)])[1:k % 5]) AS by_ FROM c)),
trust_of AS (SELECT m.handle, CAST(count(*) AS INT) AS trusted FROM mentions m JOIN known n ON n.handle = m.by_ GROUP BY 1),
asked AS (SELECT c.handle, k, coalesce(trusted, 0) AS trusted, trim(coalesce(bio, '')) = '' AND coalesce(followers, 0) < 100 AND NOT sampled AS poor, k % 31 <> 0 AND k % 37 <> 0 AS answered,
  CASE WHEN k % 17 = 0 THEN 0.0 ELSE least(100.0, k * 7 % 120) END AS score, k % 10 / 10.0 AS sure, k % 19 = 0 OR k % 23 = 0 AS severe, ['poor', 'mixed', 'good', 'mixed'][k % 4 + 1] AS quality FROM c LEFT JOIN trust_of USING (handle))"""
ORACLE_SQL["demotion_stream"] = ORACLE_SQL["demotion_gate"]
add("candidate_ladder", f"""SELECT handle, CASE WHEN poor THEN 'rejected' WHEN NOT answered THEN 'pending' WHEN severe OR score < 45 THEN 'rejected' WHEN score < 65 THEN 'watch' WHEN score < 78 THEN CASE WHEN trusted >= 1 AND quality <> 'poor' THEN 'needs_review' ELSE 'watch' END
  WHEN sure >= 0.65 AND (trusted >= 2 OR trusted >= 1 AND quality = 'good') THEN 'needs_review' ELSE 'watch' END AS status, CASE WHEN NOT poor AND answered THEN CAST(score AS DOUBLE) END AS ai_score,
  CASE WHEN poor THEN {lit(C.PREFILTER_REASON)} WHEN answered THEN 'because ' || k END AS reason, trusted FROM asked""", SOURCES, ACCOUNTS, _asked)

# --- editions
add("edition_key", "SELECT event_id, strftime(ts + INTERVAL 27 HOUR, '%Y-%m-%d') AS edition, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS local_day FROM events")
add("edition_window_counts", f"SELECT {stamp('date_trunc(' + lit('day') + ', ts + INTERVAL 3 HOUR) - INTERVAL 3 HOUR')} AS window_start, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1")
_handle = lambda x: f"CASE WHEN regexp_matches(lower(regexp_replace(trim({x}), '^@', '')), '^[a-z0-9_]{{1,15}}$') AND lower(regexp_replace(trim({x}), '^@', '')) NOT IN ({', '.join(map(lit, C.RESERVED_HANDLES))}) THEN lower(regexp_replace(trim({x}), '^@', '')) END"
ELIGIBLE = f"""joined AS (SELECT i.*, c.noise, c.score, c.primary_tag, c.action_tag, c.is_headline, c.is_dup, c.is_published, d.decision_id, d.priority_score, d.headline_candidate AND NOT d.fallback AS hl, s.trust_label
  FROM items i JOIN latest_class c ON i.id = c.item_id LEFT JOIN decisions d ON d.item_id = i.id LEFT JOIN sources s ON i.platform = 'twitter' AND {_handle('s.handle')} = {_handle('i.source_ref')}),
elig AS (SELECT *, coalesce(hl, false) AS headline, round((CASE WHEN decision_id IS NOT NULL THEN coalesce(priority_score, 0) ELSE coalesce(score, 0) * 100 END * {cases('trust_label', C.TRUST_MULTIPLIERS, '1.0')})::DOUBLE, 6) AS priority,
  CASE WHEN CASE WHEN decision_id IS NOT NULL THEN coalesce(hl, false) ELSE is_headline END THEN '1_latest_ai_news' ELSE {cases('primary_tag', C.SECTION_OF, lit('9_other'))} END AS section, coalesce(published_at, ingested_at, created_at) AS recency
  FROM joined WHERE NOT noise AND NOT is_dup AND NOT is_published AND trust_label IS DISTINCT FROM 'blocked'),
planned AS (SELECT *, CAST(row_number() OVER (ORDER BY headline DESC, priority DESC, recency DESC, id) AS INT) AS rank FROM elig)"""
_pub = (ITEMS, SOURCES, CLASSES, DECISIONS, ELIGIBLE)
add("publish_candidates", "SELECT id, headline, priority, section FROM elig", *_pub)
add("publish_counters", f"SELECT (SELECT count(*) FROM joined) AS scanned, (SELECT count(*) FROM elig) AS eligible, count(*) AS selected, count(*) FILTER (headline) AS headline_selected, count(*) FILTER (NOT headline) AS tagged_selected FROM planned WHERE rank <= {C.SELECTION_LIMIT}", *_pub)
add("publish_plan", "SELECT id, headline, priority, section, rank, rank AS position FROM planned WHERE rank <= 120", *_pub)
add("appended_positions", "SELECT id, rank + 120 AS position FROM planned WHERE rank <= 20", *_pub)
add("section_topn", "SELECT id, section, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY rank, id) AS place FROM planned WHERE rank <= 120) WHERE place <= 3", *_pub)
_titles = [f"{i + 1}. {t}" for i, t in enumerate(C.SECTION_TITLES.values())]
PRESS = f"""press AS (SELECT *, {cases('section', {k: i for i, k in enumerate(C.SECTION_TITLES)}, 'NULL')} AS no, {cases('section', dict(zip(C.SECTION_TITLES, _titles, strict=True)), 'NULL')} AS heading FROM (
  SELECT *, row_number() OVER (PARTITION BY section ORDER BY rank, id) AS place FROM planned WHERE rank <= 120) WHERE place <= {C.SECTION_LIMIT})"""
add("markdown_articles", f"SELECT heading AS section, CAST(row_number() OVER (ORDER BY no, place) AS BIGINT) AS article, coalesce(nullif({collapse('title')}, ''), 'Untitled') AS title, url FROM press", *_pub, PRESS)
add("markdown_counts", "SELECT heading AS section, count(*) AS articles FROM press GROUP BY 1", *_pub, PRESS)
_factor = f"CAST({cases('t.trust_label', C.TRUST_MULTIPLIERS, '1.0')} AS DOUBLE)"
PRINTED = f"""scored_rows AS (SELECT p.id, p.section, p.rank, d.priority_score * {_factor} AS ps, d.headline_score * {_factor} AS h, (d.headline_score + 7 * d.distinct_sources) * {_factor} AS fh, CAST(l.score AS DOUBLE) * {_factor} AS sc
  FROM planned p JOIN decisions d ON d.item_id = p.id JOIN latest_class l ON l.item_id = p.id JOIN sources t ON t.handle = p.source_ref[2:] WHERE p.rank <= 120),
printed AS (SELECT *, count(*) OVER (PARTITION BY section) AS candidates, CAST(row_number() OVER (PARTITION BY section ORDER BY CASE WHEN section = '1_latest_ai_news' THEN fh ELSE ps END DESC, CASE WHEN section = '1_latest_ai_news' THEN ps ELSE h END DESC, sc DESC, rank, id) AS INT) AS place FROM scored_rows),
chosen AS (SELECT * FROM printed WHERE place <= {cases('section', C.SECTION_LIMITS, str(C.SECTION_LIMIT))})"""
_titled = lambda badge: f"CASE WHEN rest = '' THEN {badge} ELSE {badge} || ' ' || rest END"
_rest = lambda badge: f"trim(regexp_replace(CASE WHEN contains(plain, {badge}) THEN left(plain, instr(plain, {badge}) - 1) || substr(plain, instr(plain, {badge}) + length({badge})) ELSE plain END, {lit(SPACE)}, ' ', 'g'))"
STANDING = f"""grouped AS (SELECT s.*, i.n, i.platform, {collapse("CASE WHEN i.n % 3 = 0 THEN '  old  [3媒体が言及] ' || i.title ELSE i.title END")} AS plain, CASE WHEN i.n % 3 = 0 THEN '  old  [3媒体が言及] ' || i.title ELSE i.title END AS title, i.url, e.topic_cluster_key AS topic, e.distinct_sources, CASE WHEN i.n % 2 = 0 OR i.platform = 'github' THEN 'org/repo' || (i.n % 5) END AS repo
  FROM scored_rows s JOIN items i USING (id) JOIN decisions e ON e.item_id = s.id)"""
add("topic_collapse", f"""SELECT id, CASE WHEN many THEN '1_latest_ai_news' ELSE section END AS section, CASE WHEN many THEN {_titled('badge')} ELSE title END AS title, CASE WHEN many THEN most ELSE distinct_sources END AS distinct_sources FROM (SELECT *, {_rest('badge')} AS rest FROM (
  SELECT *, topic IS NOT NULL AND count(*) OVER g > 1 AND max(distinct_sources) OVER g >= 2 AS many, max(distinct_sources) OVER g AS most, '[' || max(distinct_sources) OVER g || '媒体が言及]' AS badge, row_number() OVER (PARTITION BY topic ORDER BY fh DESC, ps DESC, sc DESC, rank, id) AS b FROM grouped WINDOW g AS (PARTITION BY topic))) WHERE NOT many OR b = 1""", *_pub, PRINTED, STANDING)
add("repository_collapse", f"""SELECT id, CASE WHEN many THEN {_titled('badge')} ELSE title END AS title FROM (SELECT *, {_rest('badge')} AS rest FROM (
  SELECT *, repo IS NOT NULL AND count(*) OVER g > 1 AS many, '[' || repo || ' 更新' || count(*) OVER g || '件]' AS badge, row_number() OVER (PARTITION BY repo ORDER BY fh DESC, ps DESC, sc DESC, rank, id) AS b FROM grouped WINDOW g AS (PARTITION BY repo))) WHERE NOT many OR b = 1""", *_pub, PRINTED, STANDING)
add("edition_trust_badges", f"""SELECT g.id, CASE f.label WHEN 'unknown' THEN '未検証/単一ソース' WHEN 'low' THEN '低信頼' END AS badge FROM grouped g LEFT JOIN (
  SELECT DISTINCT ON (url) url, t.trust_label AS label FROM grouped JOIN items i USING (id) JOIN sources t ON t.handle = i.source_ref[2:] WHERE t.trust_label IN ('unknown', 'low') ORDER BY url, rank) f USING (url)""".replace("SELECT DISTINCT ON (url) url", "SELECT DISTINCT ON (grouped.url) grouped.url").replace("ORDER BY url, rank", "ORDER BY grouped.url, rank"), *_pub, PRINTED, STANDING)
add("composed_sections", "SELECT id, section, place, candidates FROM chosen", *_pub, PRINTED)
add("compose_density", """SELECT section, candidates, selected, CAST(required AS BIGINT) AS required, actual, required > 0 AND actual < required AS short FROM (
  SELECT section, max(candidates) AS candidates, count(*) AS selected, CASE WHEN max(candidates) >= 5 AND count(*) >= 4 THEN 4 ELSE 0 END AS required, count(*) FILTER (place % 3 > 0 AND section NOT IN ('4_tech', '9_other')) AS actual FROM chosen GROUP BY section)""", *_pub, PRINTED)
_in = lambda a, b: f"(published_at >= {a} AND published_at < {b} OR published_at IS NULL AND ingested_at >= {a} AND ingested_at < {b})"
_d0, _d1 = "TIMESTAMP '2024-01-03 21:00:00'", "TIMESTAMP '2024-01-04 21:00:00'"
add("rescue_union", f"""SELECT id, origin, (SELECT count(*) > 150 FROM ev WHERE {_in(_d0, _d1)}) AS clamped FROM (
  SELECT id, 'main' AS origin, row_number() OVER (ORDER BY published_at DESC, ingested_at DESC, id) AS r, 150 AS cap FROM ev WHERE {_in(_d0, _d1)}
  UNION ALL SELECT id, 'rescue', row_number() OVER (ORDER BY published_at DESC, ingested_at DESC, id), 40 FROM ev WHERE published_at >= {_d0} - INTERVAL 2 DAY AND published_at < {_d0}
    AND (ingested_at >= {_d0} AND ingested_at < {_d1} OR published_at + to_hours(n % 40) >= {_d0} AND published_at + to_hours(n % 40) < {_d1})) WHERE r <= cap""", EVENTS)
add("window_items", "SELECT id FROM items WHERE " + _in("TIMESTAMP '2024-01-01 02:00:00'", "TIMESTAMP '2024-01-01 12:00:00'"), ITEMS)
add("repair_gate", f"""SELECT count(*) AS items, count(fallback) AS decided, count(*) FILTER (fallback) AS fallbacks, count(*) > 0 AND (count(*) FILTER (fallback) > 0 OR count(fallback) = 0) AS needed
FROM items LEFT JOIN (SELECT item_id, fallback FROM decisions WHERE decision_id % 2 = 0) d ON d.item_id = id WHERE {_in("TIMESTAMP '2024-01-01 00:00:00'", "TIMESTAMP '2024-01-01 12:00:00'")}""", ITEMS, DECISIONS)
add("trust_badges", f"""SELECT id, CASE WHEN trust_label <> 'blocked' THEN trust_label END AS badge, CAST({cases('trust_label', C.TRUST_MULTIPLIERS, '1.0')} AS DOUBLE) AS factor
FROM items LEFT JOIN (SELECT handle, CASE WHEN source_id % 2 = 0 THEN {nth(("low", "blocked", "high"), "source_id % 3")} ELSE trust_label END AS trust_label FROM sources) s ON {_handle('s.handle')} = {_handle('source_ref')} WHERE platform = 'twitter'""", ITEMS, SOURCES)

# --- feeds
_feed = lambda n: f"cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY published_at DESC NULLS LAST, id) AS r FROM items) WHERE r <= {n})"
add("feed_search", "SELECT id, platform, CAST(length(left(body, 500)) AS INT) AS chars FROM cut WHERE (contains(lower(left(body, 500)), 'an') OR contains(lower(CASE WHEN length(title) > 100 THEN left(title, 100) || '…' ELSE title END), 'an')) AND contains(lower(source_ref), 'src1') ORDER BY published_at DESC NULLS LAST, id LIMIT 100", ITEMS, _feed(50))
add("feed_counts", "SELECT platform, count(*) AS items FROM (SELECT * FROM cut ORDER BY published_at DESC NULLS LAST, id LIMIT 150) GROUP BY 1", ITEMS, _feed(40))
FAMILY = """hit AS (SELECT c.*, i.published_at FROM classes c JOIN items i ON i.id = c.item_id WHERE NOT noise AND (primary_tag IN ('SECURITY', 'AGENT', 'APPLY', 'PAPER') OR sub_tag IN ('SECURITY', 'AGENT', 'APPLY', 'PAPER') OR action_tag IN ('SECURITY', 'AGENT', 'APPLY', 'PAPER')) AND classified_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-01 12:00:00' ORDER BY classified_at, classification_id LIMIT 250),
safe AS (SELECT *, (SELECT count(*) FROM hit) AS read FROM hit WHERE (SELECT count(*) FROM hit) < 250 OR classified_at < (SELECT max(classified_at) FROM hit) OR (SELECT min(classified_at) = max(classified_at) FROM hit)),
newest AS (SELECT DISTINCT ON (item_id) * FROM safe ORDER BY item_id, classified_at DESC, classification_id DESC),
grouped AS (SELECT n.*, d.headline_score, d.priority_score, CASE WHEN d.topic_cluster_key IS NOT NULL AND d.distinct_sources >= 2 THEN d.topic_cluster_key ELSE 'id:' || item_id END AS g FROM newest n LEFT JOIN decisions d USING (item_id)),
full_ AS (SELECT DISTINCT ON (g) * FROM grouped ORDER BY g, headline_score DESC, priority_score DESC, classified_at, item_id),
page AS (SELECT * FROM full_ WHERE classified_at <= (SELECT max(classified_at) FROM (SELECT classified_at FROM full_ ORDER BY classified_at LIMIT 25)))"""
add("family_feed_page", f"SELECT item_id, classification_id, primary_tag, {stamp('classified_at')} AS classified FROM page", ITEMS, CLASSES, DECISIONS, FAMILY)
add("family_feed_meta", f"SELECT count(*) AS total_items, {stamp('max(classified_at)')} AS next_since, (SELECT count(*) FROM full_) AS before_limit, (SELECT count(*) FROM hit) >= 250 OR (SELECT count(*) FROM full_) > 25 AS truncated FROM page", ITEMS, CLASSES, DECISIONS, FAMILY)
add("family_feed_dedup", "SELECT DISTINCT ON (g) item_id, g FROM (SELECT c.*, headline_score, priority_score, CASE WHEN topic_cluster_key IS NOT NULL AND distinct_sources >= 2 THEN topic_cluster_key ELSE 'id:' || item_id END AS g FROM (SELECT DISTINCT ON (item_id) * FROM classes WHERE NOT noise ORDER BY item_id, classified_at DESC, classification_id DESC) c JOIN decisions USING (item_id)) ORDER BY g, headline_score DESC, priority_score DESC, classified_at, item_id", CLASSES, DECISIONS)
add("tie_page", "SELECT o_orderkey FROM orders WHERE o_orderdate <= (SELECT max(o_orderdate) FROM (SELECT o_orderdate FROM orders ORDER BY 1 LIMIT 50))")
add("digest_rank", "SELECT id, CAST(r AS INT) AS rank, round(e, 6) AS engagement FROM (SELECT *, row_number() OVER (ORDER BY e IS NULL, e DESC NULLS LAST, published_at DESC, id) AS r FROM (SELECT *, CASE WHEN n % 4 <> 0 THEN k * 2 + score * 0.001 END AS e FROM ev)) WHERE r <= 200", EVENTS)
add("engagement_scores", "SELECT id, round(score * 2 + score * 10 * 0.001, 6) AS engagement, CAST(CASE WHEN score > 0 THEN least(9, greatest(1, 1 + floor(log10(score + score * 10 + score + 1)))) ELSE 1 END AS INT) AS sample_size FROM ev", EVENTS)
add("daily_top10", "SELECT handle, count(*) AS items FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", EVENTS)
add("offset_page", "SELECT c_custkey, (SELECT count(*) FROM customer) AS total, CAST(ceil((SELECT count(*) FROM customer) / 25) AS BIGINT) AS total_pages FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
add("platform_counts", "SELECT platform, count(*) AS items, count(DISTINCT handle) AS authors FROM ev GROUP BY 1", EVENTS)
add("child_counts", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
add("status_counts", "SELECT count(*) FILTER (o_orderstatus = 'F') AS status_f, count(*) FILTER (o_orderstatus = 'O') AS status_o, count(*) FILTER (o_orderstatus = 'P') AS status_p, count(*) AS total, round(avg(o_totalprice), 4) AS mean_price FROM orders")
add("calendar_days", "SELECT strftime(d, '%Y-%m-%d') AS day, CAST(dayofweek(d) + 1 AS INT) AS weekday, coalesce(n, 0) AS events FROM range((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events) + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d) LEFT JOIN (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1) ON day = d")
add("edition_choice", f"""SELECT (SELECT slug FROM e WHERE content IS NOT NULL ORDER BY status <> 'published', updated_at DESC, slug LIMIT 1) AS slug, 'latest' AS asked
UNION ALL SELECT (SELECT slug FROM e WHERE slug = 'ed-src1' LIMIT 1), 'slug' UNION ALL SELECT coalesce((SELECT slug FROM e WHERE strftime(edition_at + INTERVAL 9 HOUR, '%Y-%m-%d') = '2024-01-02' ORDER BY updated_at DESC, slug LIMIT 1), (SELECT slug FROM e WHERE content IS NOT NULL ORDER BY status <> 'published', updated_at DESC, slug LIMIT 1)), 'day'""",
    SOURCES, f"e AS (SELECT 'ed-' || handle AS slug, CASE WHEN source_id % 2 = 0 THEN 'published' ELSE 'draft' END AS status, CASE WHEN source_id % 3 <> 0 THEN 'text' END AS content, {EPOCH} + to_minutes(source_id * 600) AS edition_at, {EPOCH} + to_minutes(source_id * 60) AS updated_at FROM sources)")

# --- voices
VOICES = f"""voices AS (SELECT conv_id * 1000 + turn AS n, 'c' || (conv_id * 1000 + turn) AS id, {nth(C.PLATFORMS, "(conv_id * 1000 + turn) % 7")} AS platform, text AS body, '@conv' || (conv_id % 20) AS source_ref, (conv_id * 1000 + turn) % 10 / 10.0 AS score, (conv_id * 1000 + turn) % 19 = 0 AS is_dup, (conv_id * 1000 + turn) % 23 = 0 AS is_published,
  {nth(C.ACTION_ORDER, "(conv_id * 1000 + turn) % 4")} AS action_tag, {EPOCH} + to_minutes(conv_id) AS recency FROM conversations WHERE role = 'user')"""
_vt = f"length(coalesce(nullif({collapse('body')}, ''), nullif({collapse('source_ref')}, ''), ''))"
_va = "(epoch(TIMESTAMP '2024-01-03 00:00:00') - epoch(recency)) / 3600"
add("voice_candidates", f"""SELECT id, len_ >= 20 AND CASE WHEN social THEN len_ <= 420 ELSE len_ <= 180 END AS speaks, CASE WHEN len_ >= 20 AND CASE WHEN social THEN len_ <= 420 ELSE len_ <= 180 END THEN round((CASE WHEN is_dup THEN -24 ELSE 30 END + CASE WHEN is_published THEN -6 ELSE 8 END + CASE WHEN social THEN 18 ELSE 0 END
  + CASE WHEN len_ BETWEEN 40 AND 260 THEN 12 WHEN len_ <= 420 THEN 5 ELSE 0 END + score * 12 + CASE WHEN action_tag IN ('APPLY', 'EVAL') THEN 3 ELSE 0 END + CASE WHEN {_va} <= 24 THEN 8 WHEN {_va} <= 72 THEN 4 WHEN {_va} <= 168 THEN 1 ELSE 0 END)::DOUBLE, 3) ELSE -999.0 END::DOUBLE AS voice_score
FROM (SELECT *, {_vt} AS len_, platform IN ('twitter', 'facebook', 'reddit', 'instagram') AS social FROM voices)""", VOICES)
_use = [(k, "u_" + k) for k in C.USAGE_CONTEXTS]
add("voice_sentiment", f"""SELECT id, CASE WHEN p - g >= 1 THEN 'positive' WHEN p - g <= -1 THEN 'negative' ELSE 'neutral' END AS sentiment, use AS usage_context,
  round(greatest(0.4, least(0.95, greatest(0.42, least(0.93, 0.54::DOUBLE + least(abs(p - g), 4) * 0.09 - CASE WHEN p > 0 AND g > 0 THEN 0.08 ELSE 0 END - CASE WHEN p = 0 AND g = 0 THEN 0.08 ELSE 0 END)) + CASE WHEN use = 'general' THEN -0.04 ELSE 0.04 END + (score - 0.5) * 0.2))::DOUBLE, 3) AS confidence
FROM (SELECT *, CASE WHEN greatest({', '.join(c for _, c in _use)}) > 0 THEN {_arg(_use)} ELSE 'general' END AS use FROM (SELECT *, {hits('t', C.POSITIVE)} AS p, {hits('t', C.NEGATIVE)} AS g, {', '.join(f"{hits('t', w)} AS u_{k}" for k, w in C.USAGE_CONTEXTS.items())} FROM (SELECT *, lower({collapse("concat_ws(chr(10), body, source_ref)")}) AS t FROM voices)))""", VOICES)
_old = """old AS (SELECT id AS item_id, n * 10 + k AS signal_id, CASE WHEN (n + k) % 4 > 0 THEN 'e' || ((n + k) % 4) END AS edition_id, CASE WHEN k = 2 THEN 'other:v2' ELSE 'rule-based:v1' END AS model, 't' || (n % 2 + k % 2) AS topic,
  CASE WHEN (n + k) % 3 = 0 THEN 'positive' ELSE 'neutral' END AS sentiment, CASE WHEN k <> 1 THEN 'general' END AS usage_context, recency + to_minutes(n * k % 3) AS created_at FROM voices, (VALUES (0), (1), (2), (3)) AS t(k) WHERE n % 5 <> 0)"""
add("voice_targets", """SELECT item_id, CASE WHEN NOT skipped THEN signal_id END AS signal_id, CAST(kind AS INT) AS kind, CASE WHEN kind IS NULL THEN 'created' WHEN skipped THEN 'skipped' ELSE 'updated' END AS action FROM (
  SELECT *, coalesce(edition_id IN ('e1', 'e3') AND edition_id IS DISTINCT FROM wanted, false) AS skipped FROM (
    SELECT DISTINCT ON (f.id) f.id AS item_id, s.signal_id, s.edition_id, wanted, CASE WHEN s.signal_id IS NULL THEN NULL WHEN s.edition_id IS NOT DISTINCT FROM wanted AND s.topic = f.topic AND s.sentiment = f.sentiment AND s.usage_context IS NOT DISTINCT FROM f.usage_context THEN 1 WHEN s.edition_id IS NOT DISTINCT FROM wanted THEN 2 ELSE 3 END AS kind
    FROM (SELECT id, CASE WHEN n % 4 > 0 THEN 'e' || (n % 4) END AS wanted, 't' || (n % 2) AS topic, CASE WHEN n % 3 = 0 THEN 'positive' ELSE 'neutral' END AS sentiment, CASE WHEN n % 7 > 0 THEN 'general' END AS usage_context FROM voices) f LEFT JOIN old s ON s.item_id = f.id AND s.model = 'rule-based:v1'
    ORDER BY f.id, kind NULLS LAST, s.created_at DESC NULLS LAST, s.signal_id DESC))""", VOICES, _old)

# --- maintenance
add("mention_signals", f"""SELECT handle, count(DISTINCT id) AS posts, array_to_string(list_sort(list(DISTINCT by_)), ',') AS mentioned_by, count(DISTINCT by_) AS mentioners FROM (
  SELECT id, {_handle('source_ref')} AS by_, lower(unnest(regexp_extract_all(body, '@([A-Za-z0-9_]+)', 1))) AS handle FROM items) WHERE length(handle) <= 15 AND handle <> by_ AND handle NOT IN (SELECT lower(handle) FROM sources) GROUP BY handle HAVING count(DISTINCT id) >= 2 OR count(DISTINCT by_) >= 2""", ITEMS, SOURCES)
add("referenced_authors", "SELECT 'd' || doc_id AS id, array_to_string(list_sort(['q' || (doc_id % 5), 'r' || (doc_id % 3), 't1', 't2']), ',') AS authors FROM documents")
_counts = ORACLE_SQL["mention_signals"].partition(chr(10) + "SELECT")[2].partition("GROUP BY handle")[0]
add("candidates_updated", f"""SELECT handle, coalesce(posts, 0) AS mentions, coalesce(mentioned_by, '') AS mentioned_by, CASE WHEN length(handle) % 2 = 0 OR posts IS NULL THEN 'watch' ELSE 'pending' END AS status
FROM (SELECT{_counts}GROUP BY handle UNION ALL SELECT handle, NULL, NULL, NULL FROM sources) WHERE length(handle) % 2 = 0 OR posts IS NULL OR posts >= 2 OR mentioners >= 2""", ITEMS, SOURCES)
CATALOGUE = """cat AS (SELECT p_partkey AS id, p_retailprice AS price, CAST(p_size AS BIGINT) AS context FROM part),
events_ AS (SELECT id + 1000000 AS id, 'new' AS event FROM cat WHERE id % 19 = 0 UNION ALL SELECT id, 'removed' FROM cat WHERE id % 13 = 0
  UNION ALL SELECT id, 'price_change' FROM cat WHERE id % 13 <> 0 AND id % 7 = 0 UNION ALL SELECT id, 'context_change' FROM cat WHERE id % 13 <> 0 AND id % 5 = 0)"""
add("catalogue_diff", "SELECT event, count(*) AS events, min(id) AS first_id, max(id) AS last_id FROM events_ GROUP BY 1", CATALOGUE)
add("catalogue_events", "SELECT id, event FROM events_", CATALOGUE)
add("catalogue_guard", "SELECT count(*) AS active, count(*) FILTER (p_partkey % 13 <> 0) + count(*) FILTER (p_partkey % 19 = 0) AS fetched, count(*) FILTER (p_partkey % 13 <> 0) + count(*) FILTER (p_partkey % 19 = 0) < ceil(count(*) / 2) AS abort FROM part")
add("upsert_items", """SELECT platform, n AS external_id, title, CAST(CASE WHEN n % 5 <> 0 AND n % 2 = 0 THEN length(body) + 1 ELSE length(body) END AS INT) AS size, CASE WHEN n % 3 <> 0 THEN 'e' || n END AS enrichment,
  CASE WHEN n % 5 = 0 THEN 'kept' WHEN n % 3 = 0 THEN 'inserted' WHEN n % 2 = 0 THEN 'updated' ELSE 'skipped' END AS action FROM items WHERE n % 3 <> 0 OR n % 5 <> 0""", ITEMS)
add("link_diff", "SELECT CASE WHEN h IS NULL THEN 'insert' WHEN w IS NULL THEN 'delete' ELSE 'update' END AS change, count(*) AS links FROM (SELECT min(l_linenumber) FILTER (l_linenumber <= 3) AS w, min(l_linenumber % 4) FILTER (l_linenumber BETWEEN 2 AND 4) AS h FROM lineitem GROUP BY l_orderkey, l_partkey) WHERE w IS DISTINCT FROM h GROUP BY 1")
add("item_lookup", """SELECT n.n, coalesce((SELECT min(e.n) FROM items e WHERE e.n % 2 = 0 AND e.platform = n.platform AND e.n = CASE WHEN n.n % 3 = 0 THEN n.n + 1000000 WHEN n.n % 7 > 0 THEN n.n END),
  (SELECT min(e.n) FROM items e WHERE e.n % 2 = 0 AND e.platform = n.platform AND e.url = n.url)) AS item_id FROM items n WHERE n.n % 5 < 4""", ITEMS)
add("union_first_wins", "SELECT 'd' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'main' ELSE 'rescue' END AS origin FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
add("unchanged_skipped", "SELECT id FROM items WHERE n % 4 = 0 AND coalesce(title, '') <> 'changed'", ITEMS)
add("retention_keep", """SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM kept)) AS children, count(*) AS parents, CAST(sum(o_orderkey) AS BIGINT) AS id_sum FROM kept""",
    "kept AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-08-02 00:00:00' - INTERVAL 400 DAY OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49))")
add("children_detached", "SELECT count(*) AS rows, count(*) FILTER (l_orderkey % 3 = 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)) AS attached FROM lineitem")
add("collector_health", "SELECT kind, CAST(count(*) AS BIGINT) AS sources, CAST(sum(bad) AS BIGINT) AS errors, sum(bad) < count(*) AS ok FROM (SELECT event_type AS kind, user_id, max(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS bad FROM events GROUP BY ALL) GROUP BY 1")
add("stale_runs", "SELECT CASE WHEN event_id % 2 = 0 AND ts < TIMESTAMP '2024-01-14 12:00:00' THEN 'aborted' WHEN event_id % 2 = 0 THEN 'running' ELSE 'done' END AS status, count(*) AS runs FROM events GROUP BY 1")
add("rate_limits", f"SELECT 'user' || user_id AS login, count(*) AS files, count(*) >= 3 AS limited FROM events WHERE ts >= {AS_OF} - INTERVAL 7 DAY GROUP BY 1")
add("seeds_imported", "SELECT handle, CASE WHEN source_id % 6 = 0 THEN 'seed,old,new' WHEN source_id % 2 = 0 THEN 'seed,old' ELSE 'new,seed' END AS tags FROM sources WHERE source_id % 2 = 0 OR source_id % 3 = 0", SOURCES)
add("key_links", "SELECT 'd' || doc_id AS id, 4 AS links FROM documents")
add("json_links", "SELECT 'd' || doc_id AS id, 'https://a.b/' || (doc_id % 7) || ' https://c.d/1' AS links FROM documents")
add("enrichment_merged", "SELECT 'd' || doc_id AS id, 'k1,k9,k3' AS kept FROM documents")
_ident = "CASE WHEN k % 12 = 1 THEN 'too_long_for_a_handle' WHEN k % 12 = 2 THEN 'Settings' WHEN k % 60 = 3 THEN 'twin_OF_3' WHEN k % 60 = 15 THEN 'Twin_of_3' ELSE 'Acc_' || k END"
add("community_files", f"""SELECT 'x--' || CASE WHEN k % 36 = 0 THEN 'other' ELSE lower(ident) END || '.json' AS name, CASE WHEN NOT shape THEN ident END AS identifier, CASE
  WHEN k % 24 = 23 THEN 'C4 root must be an object' WHEN k % 12 = 4 THEN 'C4 schema_version must be 1' WHEN k % 24 = 11 THEN 'C4 root unrecognized keys: note' ELSE concat_ws('; ',
  CASE k % 12 WHEN 1 THEN 'C5 identifier must be 1-15 ASCII letters, digits, or underscores' WHEN 2 THEN 'C5 identifier matches a reserved X route' WHEN 5 THEN 'C7 topic does not satisfy the single-line length and character policy' WHEN 6 THEN 'C7 topic does not satisfy the single-line length and character policy'
  WHEN 7 THEN 'C4 language must match xx or xx-YY' WHEN 8 THEN 'C4 submitted_by is not a valid GitHub login' WHEN 9 THEN 'C4 first_seen must be a real UTC date from 2006-01-01 through today' WHEN 10 THEN 'C4 first_seen must be a real UTC date from 2006-01-01 through today' END,
  CASE WHEN k % 36 = 0 THEN 'C4 name filename must be x--' || lower(ident) || '.json' END, CASE WHEN count(*) FILTER (NOT shape) OVER (PARTITION BY lower(ident)) > 1 THEN 'C6 identifier duplicate identifier already exists' END) END AS failures
FROM (SELECT *, {_ident} AS ident, k % 12 = 4 OR k % 12 = 11 AS shape FROM (SELECT c_custkey AS k FROM customer))""")
add("weekly_review", "SELECT e.user_id, count(*) AS errors, any_value(last_type) AS last_type FROM events e JOIN (SELECT DISTINCT ON (user_id) user_id, event_type AS last_type FROM events ORDER BY user_id, ts DESC, event_id DESC) l USING (user_id) WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1")
add("ranked_ids", "SELECT user_id, event_id, CAST(r AS INT) AS r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS FIRST, event_id) AS r FROM events) WHERE r <= 2")

# --- collectors, models, mutations
_c = collapse("text")
_short = lambda x: f"CASE WHEN length({collapse(x)}) > 140 THEN 140 ELSE nullif(length({collapse(x)}), 0) END"
_iso = f"{EPOCH} + to_minutes(doc_id)"
add("collected_candidates", f"""SELECT platform, external_id, source_type, source_ref, CAST(title_chars AS INT) AS title_chars, CAST(body_chars AS INT) AS body_chars, canonical_url, {stamp('published')} AS published FROM (
  SELECT 'twitter' AS platform, 'k' || doc_id AS external_id, 'x_account' AS source_type, '@' || source AS source_ref, {_short("CASE WHEN doc_id % 2 = 0 THEN 'note ' || text ELSE text END")} AS title_chars, length(CASE WHEN doc_id % 2 = 0 THEN 'note ' || text ELSE text END) AS body_chars, 'https://x.com/a/status/' || doc_id AS canonical_url, {_iso} + INTERVAL 6 HOUR AS published FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT 'alerts', CAST(doc_id AS VARCHAR), 'alert_feed', 'https://f.com/rss', length('T k' || doc_id), length(trim(left({_c}, 1000))), 'https://n.com/' || (doc_id % 100), CASE WHEN doc_id % 2 = 0 THEN {_iso} ELSE {_iso} + INTERVAL 6 HOUR END FROM (SELECT *, row_number() OVER (PARTITION BY doc_id % 100 ORDER BY doc_id) AS r FROM documents WHERE doc_id % 7 = 1) WHERE r = 1
  UNION ALL SELECT 'facebook', 'k' || doc_id, 'fb_page', 'https://fb.com/p', {_short("text")}, length(text), 'https://item.invalid/facebook/k' || doc_id, {_iso} FROM documents WHERE doc_id % 7 = 2
  UNION ALL SELECT 'reddit', 'k' || doc_id, 'subreddit', 'r/ai', length('k' || doc_id), length(text), 'https://www.reddit.com/r/ai/k' || doc_id, {_iso} FROM documents WHERE doc_id % 7 = 3
  UNION ALL SELECT 'qiita', 'k' || doc_id, 'qiita_tag', 'llm', length('k' || doc_id), length(text), 'https://qiita.com/k' || doc_id, {_iso} FROM documents WHERE doc_id % 7 = 4
  UNION ALL SELECT 'github', 'o/r' || (doc_id % 9) || CASE WHEN doc_id % 2 = 0 THEN ':v' || doc_id ELSE '' END, 'gh_source', 'o/r' || (doc_id % 9), length('k' || doc_id), length(text), 'https://github.com/o/r' || (doc_id % 9), {_iso} + INTERVAL 6 HOUR FROM documents WHERE doc_id % 7 = 5
  UNION ALL SELECT 'instagram', 'k' || doc_id, 'ig_account', 'ig', CASE WHEN doc_id % 2 = 0 THEN {_short("text")} END, CASE WHEN doc_id % 2 = 0 THEN length(text) END, 'https://www.instagram.com/p/k' || doc_id, {_iso} FROM documents WHERE doc_id % 7 = 6)""")
add("due_sources", "SELECT handle FROM sources WHERE source_id % 4 <> 3 AND (source_id % 3 = 0 OR source_id >= 8)", SOURCES)
add("fallback_decisions", f"SELECT item_id, round(CAST(score AS DOUBLE) * 50, 3) AS priority_score, false AS headline_candidate, '{C.FALLBACK_HASH_PREFIX}' || sha256(item_id) AS input_hash FROM latest_class WHERE item_id IN (SELECT id FROM items)", ITEMS, CLASSES)
add("clamped_decisions", "SELECT item_id, CASE WHEN decision_id % 5 = 0 THEN 50 ELSE least(100, priority_score * 2) END::DOUBLE AS priority_score, greatest(0, headline_score - 50)::DOUBLE AS headline_score, least(1, dup_score * 2)::DOUBLE AS dup_score FROM decisions", DECISIONS)
add("decisions_upserted", "SELECT item_id, CASE WHEN decision_id % 3 = 0 THEN priority_score + 1 ELSE priority_score END AS priority_score FROM decisions WHERE decision_id % 2 = 0 OR decision_id % 3 = 0", DECISIONS)
add("embeddings_missing", "SELECT id FROM items WHERE coalesce(title, '') NOT IN (SELECT coalesce(title, '') FROM items WHERE n % 3 = 0)", ITEMS)
add("untranslated_items", "SELECT item_id FROM latest_class WHERE classification_id % 3 <> 0 AND NOT noise ORDER BY classified_at DESC, classification_id DESC LIMIT 50", CLASSES)
add("bindings_upserted", "SELECT 'e1' AS edition, 'd' || doc_id AS id, CASE WHEN doc_id % 7 > 2 THEN doc_id % 7 + 10 ELSE doc_id % 7 END AS position FROM documents")
add("published_marked", "SELECT classification_id, is_published OR n % 5 = 0 AS is_published FROM classes", CLASSES)
add("orphans_adopted", "SELECT id AS item_id, CASE WHEN n % 4 = 0 THEN 'old' WHEN " + _in("TIMESTAMP '2024-01-01 01:00:00'", "TIMESTAMP '2024-01-01 09:00:00'") + " THEN 'new' END AS edition_id FROM items", ITEMS)
add("edition_labels", "SELECT event_id, 'daily-ai-news-' || strftime(ts, '%Y-%m-%d') AS slug, 'Daily AI News ' || strftime(ts, '%Y/%m/%d') AS title FROM events")
_raw = lambda n: f"CASE {n} % 11 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE p_size / 1e6 END"
add("price_labels", f"""SELECT p_partkey, coalesce({_raw('p_partkey')}, 0) = 0 AND coalesce({_raw('(xor(p_partkey, 5) + 1)')}, 0) = 0 AS free, CASE WHEN coalesce({_raw('p_partkey')}, 0) = 0 THEN 'free' ELSE '$' || p_size || '.00/M' END AS label,
  CASE WHEN p_partkey * 777 >= 1000000 THEN format('{{:.1f}}', p_partkey * 777 / 1000000) || 'M' WHEN p_partkey * 777 >= 1000 THEN format('{{:,.1f}}', p_partkey * 777 / 1000) || 'K' ELSE CAST(p_partkey * 777 AS VARCHAR) END AS compact FROM part""")
add("trusted_mentions", "SELECT 'm' || (source_id % 4) AS handle, count(DISTINCT lower(handle)) AS trusted FROM sources WHERE trust_label IN ('high', 'medium') GROUP BY 1", SOURCES)
_found = "found AS (SELECT *, row_number() OVER (ORDER BY published_at DESC, id) AS r FROM (SELECT *, CASE WHEN n % 3 > 0 THEN 'Au' || (n % 4) END AS author, row_number() OVER (PARTITION BY platform ORDER BY published_at DESC, id) AS p FROM ev) WHERE p <= 40 AND author = 'Au1')"
add("feed_payload", "SELECT CAST(count(*) AS VARCHAR) AS total, CAST(nullif(count(*) FILTER (platform = 'click'), 0) AS VARCHAR) AS clicks, string_agg(id || ':' || platform || ':' || author || ':https://e.com/' || id || ':' || CAST(CAST(k AS INT) AS VARCHAR), ' ' ORDER BY r) AS items FROM found WHERE r <= 30", EVENTS, _found)
_big = lambda x: f"CASE WHEN {x} >= 1000000 THEN format('{{:.1f}}', {x} / 1000000) || 'M' WHEN {x} >= 1000 THEN format('{{:,.1f}}', {x} / 1000) || 'K' ELSE CAST(CAST({x} AS BIGINT) AS VARCHAR) END"
add("daily_summary", f"""SELECT '📡 *News — Daily Summary (2024-01-31)*' || chr(10) || 'Collected ' || (SELECT count(*) FROM posts) || ' tweets from ' || (SELECT count(DISTINCT handle) FROM posts) || ' accounts' || chr(10) || chr(10) || '*🏆 Top 10 by Engagement Score*' || chr(10)
  || '_(score = bookmark×5 + like×2 + RT×3 + view×0.001)_' || chr(10) || chr(10) || (SELECT string_agg(CASE r WHEN 1 THEN '🥇' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉' ELSE r || '.' END || ' *@' || handle || '* ' || CASE WHEN note THEN '📝' ELSE '' END || chr(10) || '> ' || replace(left(t, 120), chr(10), ' ') || CASE WHEN length(t) > 120 THEN '…' ELSE '' END || chr(10)
    || '> 👁' || {_big('v')} || ' ❤️' || {_big('l')} || ' 🔖' || {_big('b')} || ' 🔄0' || chr(10) || '> <https://x.com/' || id || '>' || chr(10), chr(10) ORDER BY r) FROM ranked WHERE r <= 10) || chr(10) || '*📊 Per Account*' || chr(10)
  || (SELECT string_agg('• @' || handle || ': ' || c || ' tweets' || chr(10), '' ORDER BY c DESC, latest DESC, handle) FROM (SELECT handle, count(*) AS c, max(made) AS latest FROM posts GROUP BY 1)) AS summary""", EVENTS,
    "posts AS (SELECT id, handle, repeat('text of' || chr(10) || id || ' ', CAST(n % 20 AS INT)) AS t, round(score) AS l, round(score * 1000) AS v, CAST(n % 5 AS DOUBLE) AS b, date_trunc('day', published_at) AS made, n % 3 = 0 AS note FROM ev WHERE platform = 'view')",
    "ranked AS (SELECT *, row_number() OVER (ORDER BY b * 5 + l * 2 + v * 0.001::DOUBLE DESC, made DESC, id) AS r FROM posts)")
add("model_tags", """SELECT 'd' || doc_id AS id, CASE WHEN n12 THEN NULL WHEN doc_id % 3 > 0 THEN 'TECH' ELSE 'OTHER' END AS primary_tag, CAST(NULL AS VARCHAR) AS sub_tag, CASE WHEN n12 THEN NULL WHEN doc_id % 2 > 0 THEN 'INFO' ELSE 'APPLY' END AS action_tag,
  CASE WHEN n12 THEN 'rules' ELSE 'model' END AS by, CAST(CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS INT) AS attempts FROM (SELECT doc_id, doc_id % 12 = 0 AS n12 FROM documents)""")
add("composed_editions", f"""SELECT edition, CAST(CASE WHEN short IS NULL THEN 1 ELSE 2 END AS INT) AS attempts, CASE WHEN edition = 3 THEN short END AS shortages, CAST(CASE WHEN short IS NULL OR edition = 3 THEN 2 ELSE 6 END AS INT) AS articles FROM (
  SELECT edition, string_agg(section || '(1/{C.DENSE_ITEMS})', ' ' ORDER BY section) FILTER (c >= {C.DENSE_ITEMS}) AS short FROM (SELECT doc_id % 6 AS edition, CASE WHEN doc_id % 4 = 3 THEN 'b' ELSE 'a' END AS section, count(*) AS c FROM documents WHERE doc_id % 10 > 0 AND NOT (doc_id % 6 = 1 AND doc_id > 40) AND NOT (doc_id % 6 = 5 AND doc_id % 4 <> 3) GROUP BY ALL) GROUP BY 1)""")
add("embedding_cache", """SELECT id, CAST(length(t) AS DOUBLE) AS x, CAST(CASE WHEN t = '' THEN 0 ELSE unicode(t) END AS DOUBLE) AS y, (SELECT count(DISTINCT t) FROM v WHERE n % 2 = 0) AS asked_first, 0::BIGINT AS asked_again, (SELECT count(DISTINCT t) FROM v) - (SELECT count(DISTINCT t) FROM v WHERE n % 2 = 0) AS asked_more FROM v""", ITEMS, "v AS (SELECT id, n, coalesce(left(title, 3), '') AS t FROM items)")
add("sweep_rollup", """SELECT sweep, collectors, failed, sources, errors, errors > 0 OR bad > 0 AS has_failures, sources > 0 AND errors >= sources OR part > 0 AND part = part_bad AS all_failed FROM (
  SELECT sweep, count(*) FILTER (own) AS collectors, count(*) FILTER (own AND NOT ok) AS failed, CAST(sum(CASE WHEN own THEN sources ELSE 0 END) AS BIGINT) AS sources, CAST(sum(CASE WHEN own THEN errors ELSE 0 END) AS BIGINT) AS errors, count(*) FILTER (NOT ok) AS bad, count(*) FILTER (own AND (sources > 0 OR NOT ok)) AS part, count(*) FILTER (own AND NOT ok) AS part_bad
  FROM (SELECT strftime(ts, '%Y-%m-%d') AS sweep, event_id % 9 > 0 AS own, event_id % 50 > 0 AND day(ts) <> 5 AS ok, CASE WHEN day(ts) = 5 THEN 0 ELSE event_id % 4 END AS sources, CASE WHEN day(ts) = 7 THEN event_id % 5 WHEN event_id % 30 = 0 THEN 1 ELSE 0 END AS errors FROM events) GROUP BY 1)""")
add("digest_payload", f"""SELECT id, source_type, CAST(row_number() OVER (ORDER BY e IS NULL, e DESC NULLS LAST, at_ DESC, id) AS INT) AS rank, title, CAST(chars AS INT) AS chars, author, source AS "sourceName", strftime(at_, '%Y-%m-%dT%H:%M:%S.%gZ') AS published, round(e, 6) AS engagement, note AS "isNote" FROM (
  SELECT id, 'tweet' AS source_type, left(t, 100) || CASE WHEN length(t) > 100 THEN '…' ELSE '' END AS title, least(length(t), 500) AS chars, handle AS author, NULL AS source, published_at AS at_, CASE WHEN n % 4 > 0 THEN round(score) * 2 + CAST(1000.0 AS DOUBLE) * CAST(0.001 AS DOUBLE) END AS e, n % 7 = 0 AS note FROM (SELECT *, repeat(id || ' ', CAST(n % 40 AS INT)) AS t FROM ev)
  UNION ALL SELECT CAST(page_id AS VARCHAR), 'alert', 'Alert ' || page_id, CASE WHEN page_id % 2 = 0 THEN 5 ELSE 0 END, NULL, 'feed', {EPOCH} + to_minutes(page_id * 100) + CASE WHEN page_id % 3 > 0 THEN INTERVAL 0 HOUR ELSE INTERVAL 1 HOUR END, NULL, NULL FROM pages) QUALIFY rank <= 9000""", EVENTS)
add("edition_payloads", f"""SELECT e.edition, '2024-01-31' AS day, coalesce(c, 0) AS bindings, CAST(CASE WHEN e.edition % 2 = 0 THEN 4 ELSE 0 END AS INT) AS chars, CASE WHEN e.edition % 2 = 0 THEN 'text' END AS content, items FROM range(5) e(edition) LEFT JOIN (
  SELECT n % 4 AS edition, count(*) AS c, string_agg(id || '|' || section || '|' || n % 50 || '|' || CASE WHEN n % 5 = 0 THEN 'ja' ELSE '-' END || '|' || CASE WHEN n % 2 = 0 THEN url ELSE canonical_url END || '|' || platform || '|' || coalesce(label, '-'), chr(10) ORDER BY section, n % 50, id) AS items
  FROM (SELECT i.*, CASE WHEN n % 3 = 0 THEN '2_update' ELSE '4_tech' END AS section, CASE WHEN platform = 'twitter' AND t.trust_label <> 'blocked' THEN t.trust_label END AS label FROM items i LEFT JOIN sources t ON t.handle = i.source_ref[2:] WHERE n % 11 = 0) GROUP BY 1) b ON b.edition = e.edition""", ITEMS, SOURCES)
add("appended_after", """SELECT e AS edition, id, CAST(rank + coalesce(most, 0) AS INT) AS position FROM planned, (VALUES ('ed0'), ('ed1'), ('ed9')) t(e) LEFT JOIN (SELECT 'ed' || n % 2 AS edition, max(n * 7 % 613) AS most FROM items WHERE n % 11 = 0 GROUP BY 1) ON edition = e WHERE rank <= 15""", *_pub)
add("voice_selected", f"""SELECT id, CAST(row_number() OVER (ORDER BY voice_score DESC, conv_id DESC, id) AS INT) AS rank, voice_score FROM (SELECT v.id, v.voice_score, conv_id, n FROM ({ORACLE_SQL["voice_candidates"]}) v
  JOIN (SELECT conv_id, conv_id * 1000 + turn AS n, 'c' || (conv_id * 1000 + turn) AS id FROM conversations WHERE role = 'user' ORDER BY conv_id DESC, 'c' || (conv_id * 1000 + turn) LIMIT 160) USING (id)) WHERE n % 13 > 0 AND n % 6 <> 0 AND voice_score >= 0 QUALIFY rank <= 20""")
add("run_ledger", """SELECT item_id, CAST(CASE WHEN known AND last = due AND ok THEN attempts ELSE attempts + 1 END AS INT) AS attempt, 'h' || due AS input_hash, 'success' AS status FROM (
  SELECT 'd' || doc_id AS item_id, doc_id % 5 > 0 AS known, CASE WHEN doc_id % 5 > 0 THEN doc_id % 3 + 1 ELSE 0 END AS attempts, doc_id % 3 + 1 AS last, doc_id % 4 AS due, (doc_id + doc_id % 3 + 1) % 4 <> 0 AS ok FROM documents)""")
