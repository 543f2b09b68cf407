"""The same results in DuckDB SQL, written from the definitions: pairs are compared where the Spark plans group."""

from __future__ import annotations

from ..functions.text import SYNONYMS

NOW = 1706659200.0
SQL: dict[str, str] = {}


# --- expressions


def origin(u: str) -> str:
    return f"regexp_extract({u}, '^([a-z]+://[^/?#]*)', 1)"


def host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[a-z]+://([^/?#:]*)', 1))"


def bare(u: str) -> str:
    return f"regexp_replace({host(u)}, '^www\\.', '')"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def params(u: str) -> str:
    return f"regexp_extract({u}, '\\?([^#]*)', 1)"


def directory(u: str) -> str:
    return f"coalesce(nullif(regexp_extract({path(u)}, '^(.*/)', 1), ''), '/')"


def key(u: str) -> str:
    return f"({origin(u)} || {path(u)})"


def segs(u: str) -> str:
    return f"list_filter(string_split({path(u)}, '/'), lambda s: s <> '')"


def normal_url(u: str) -> str:
    kept = f"list_filter(string_split({params(u)}, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[^=]*|_ga|_gl|fbclid|igshid|mc_cid|mc_eid|ref_src)(=|$)'))"
    joined = f"array_to_string({kept}, '&')"
    return f"({origin(u)} || CASE WHEN {path(u)} = '' THEN '/' ELSE {path(u)} END || CASE WHEN {joined} <> '' THEN '?' || {joined} ELSE '' END)"


def squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def unescape(t: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")):
        t = f"replace({t}, '{a}', '{b}')"
    return t


def opaque(s: str) -> str:
    return f"regexp_full_match({s}, '(?i)([0-9a-f]{{12,}}|[0-9a-f-]{{32,36}})')"


def blank(s: str) -> str:
    return f"CASE WHEN {opaque(s)} THEN '{{id}}' ELSE regexp_replace({s}, '[0-9]+', '{{n}}', 'g') END"


def shape(s: str) -> str:
    return f"CASE WHEN regexp_full_match({s}, '[A-Za-z0-9_-]{{5,}}') AND regexp_matches({s}, '[0-9]') AND regexp_matches({s}, '[A-Za-z]') THEN '{{id}}' ELSE {blank(s)} END"


def template(u: str) -> str:
    return f"({host(u)} || '/' || array_to_string(list_transform({segs(u)}, lambda s: {blank('s')}), '/'))"


def plain_words(t: str) -> str:
    t = f"regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '(\\p{{L}})(\\p{{N}})', '\\1 \\2', 'g'), '(\\p{{N}})(\\p{{L}})', '\\1 \\2', 'g')"
    return f"trim(regexp_replace({t}, '(^| )0+(\\p{{N}})', '\\1\\2', 'g'))"


def index_words(t: str) -> str:
    return plain_words(f"strip_accents({t})")


def tokens(t: str) -> str:
    return f"list_filter(string_split({index_words(t)}, ' '), lambda w: w <> '')"


STOP = "['a','an','the','of','for','to','in','on','at','by','with','from','and','or','not','is','are','my','me','i','this','that','page','open','go','show','find','please']"


def query_tokens(t: str) -> str:
    telling = f"list_filter({tokens(t)}, lambda w: NOT list_contains({STOP}, w))"
    return f"CASE WHEN len({telling}) > 0 THEN {telling} ELSE {tokens(t)} END"


def clip(t: str, n: int) -> str:
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE coalesce(nullif(regexp_extract(left({t}, {n}), '(?s)^(.*) [^ ]*$', 1), ''), left({t}, {n})) || '…' END"


def pick(i: str, *values: str) -> str:
    return f"([{', '.join(values)}])[{i} + 1]"


# --- relations

URL = """CASE event_type WHEN 'click' THEN 'https://search.example/s?q=' || k
  WHEN 'view' THEN 'https://site' || (k % 6) || '.example/courses/c' || (k % 4) || '/lectures/l' || (k % 10) || '.html'
  WHEN 'purchase' THEN 'https://site' || (k % 6) || '.example/shop/orders/' || k
  WHEN 'signup' THEN 'https://site' || (k % 6) || '.example/account'
  ELSE 'https://sso.example/login?step=' || (k % 2) END"""
EV = f"""ev0 AS (SELECT *, epoch(ts) AS ts_s, cast(json_extract_string(props, '$.k') AS INT) AS k FROM events),
ev AS (SELECT *, {URL} AS url FROM ev0)"""
V = f"""{EV},
v AS (SELECT user_id, event_id, ts_s, url, value AS duration_s,
  lag(url) OVER (PARTITION BY user_id ORDER BY ts_s, event_id) AS from_url FROM ev)"""


def hubs_of(v: str, name: str = "hub") -> str:
    return f"""{name}_s AS (SELECT user_id, {key('url')} AS path_key, count(*) AS n_visits,
  round(count(DISTINCT {params('url')})::DOUBLE / count(DISTINCT ({params('url')}, floor(ts_s / 86400))), 6) AS distinct_share,
  round(coalesce(avg(CASE WHEN duration_s > 0 THEN CASE WHEN duration_s < 10 THEN 1.0 ELSE 0.0 END END), 0), 6) AS brief_share
  FROM {v} GROUP BY 1, 2),
{name}_o AS (SELECT user_id, {key('from_url')} AS path_key, count(DISTINCT {origin('url')}) AS n_origins FROM {v}
  WHERE from_url IS NOT NULL AND {origin('url')} <> {origin('from_url')} GROUP BY 1, 2),
{name}_stats AS (SELECT s.*, coalesce(o.n_origins, 0) AS n_origins FROM {name}_s s LEFT JOIN {name}_o o USING (user_id, path_key)),
{name} AS (SELECT user_id, path_key FROM {name}_stats WHERE n_visits >= 3 AND n_origins >= 3
  AND (distinct_share >= 0.8 OR (brief_share >= 0.8 AND distinct_share >= 0.5)))"""


def flagged(v: str, hub: str, name: str) -> str:
    return f"""{name} AS (SELECT v.*, EXISTS (SELECT 1 FROM {hub} h WHERE h.user_id = v.user_id AND h.path_key = {key('v.url')}) AS on_hub,
  v.from_url IS NOT NULL AND EXISTS (SELECT 1 FROM {hub} h WHERE h.user_id = v.user_id AND h.path_key = {key('v.from_url')}) AS from_hub FROM {v} v)"""


def features(rows: str, keys: str, half: float, name: str, breadth: bool = True) -> str:
    """rows: user_id, ts_s, url, duration_s, from_hub, arrival and the keys."""
    b = " + 0.5 * ln(1 + breadth)" if breadth else ""
    return f"""{name}_d AS (SELECT DISTINCT {keys}, floor(ts_s / 86400) AS day FROM {rows}),
{name}_g AS (SELECT *, day - lag(day) OVER (PARTITION BY {keys} ORDER BY day) AS gap FROM {name}_d),
{name}_day AS (SELECT {keys}, count(*) AS n_days, round(sum(pow(0.5, greatest(floor({NOW} / 86400) - day, 0) / {half})), 4) AS days,
  round(CASE WHEN count(*) >= 3 THEN 1 - least(1.0, stddev_pop(gap) / avg(gap)) ELSE 0 END, 4) AS regular FROM {name}_g GROUP BY ALL),
{name}_v AS (SELECT {keys}, count(*) AS visits, count(DISTINCT url) AS breadth,
  round(avg(CASE WHEN duration_s > 0 AND duration_s < 10 THEN 1.0 ELSE 0.0 END), 4) AS bounce,
  round(coalesce(avg(CASE WHEN arrival THEN CASE WHEN from_hub THEN 1.0 ELSE 0.0 END END), 0), 4) AS from_search,
  min(ts_s) AS first_visit, max(ts_s) AS last_visit FROM {rows} GROUP BY ALL),
{name} AS (SELECT *, round(1 / (1 + exp(-(-3.0 + 1.5 * ln(1 + days){b} - 1.0 * bounce + 0.5 * regular))), 4) AS revisit
  FROM {name}_v JOIN {name}_day USING ({keys}))"""


STATUS = f"CASE WHEN revisit >= 0.5 THEN 'active' WHEN revisit >= 0.2 AND {NOW} - last_visit <= 14 * 86400 THEN 'probation' ELSE 'dropped' END"
H = f"{V},\n{hubs_of('v')},\n{flagged('v', 'hub', 'fl')}"


def arrivals(rows: str, place: str, name: str) -> str:
    return f"{name} AS (SELECT a.*, NOT EXISTS (SELECT 1 FROM {rows} b WHERE b.user_id = a.user_id AND b.{place} = a.{place} AND b.url = a.from_url) AS arrival FROM {rows} a)"


SI = f"{H},\nsi0 AS (SELECT *, {origin('url')} || {directory('url')} AS scope FROM fl),\n{arrivals('si0', 'scope', 'si')},\n{features('si', 'user_id, scope', 14.0, 'pf')}"

BODY = "regexp_extract(html, '(?s)<body>(.*)', 1)"
for _t in ("script", "style", "nav", "footer", "header", "noscript", "template"):
    BODY = f"regexp_replace({BODY}, '(?s)<{_t}[ >].*?</{_t}>', ' ', 'g')"
BODY = squeeze(unescape(f"regexp_replace(regexp_replace({BODY}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"))
PG = f"""pg0 AS (SELECT page_id, {normal_url('url')} AS url, url AS raw, html,
  {squeeze(unescape("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS title,
  list_filter(list_transform(regexp_extract_all(html, '(?s)<h[123]>(.*?)</h[123]>', 1), lambda x: {squeeze(unescape('x'))}), lambda x: x <> '') AS headings,
  {BODY} AS body FROM pages),
pg AS (SELECT *, concat_ws(' · ', nullif(title, ''), nullif(array_to_string(headings[:10], ' · '), ''), nullif({clip('body', 300)}, '')) AS snippet,
  CASE WHEN page_id % 4 <> 3 THEN min(page_id) OVER (PARTITION BY {host('url')}) END AS place_id,
  page_id % 3 = 0 AS visited, CASE WHEN page_id % 3 = 0 THEN page_id % 5 ELSE 0 END AS visit_count,
  CASE WHEN page_id % 3 = 0 THEN {NOW} - (page_id % 60) * 86400 END AS last_visit,
  CASE WHEN page_id % 3 = 0 THEN (page_id * 13 % 100) / 100 ELSE 0.0 END AS revisit,
  CASE WHEN page_id % 7 = 0 THEN {NOW} - (page_id % 3) * 43200 END AS crawled_at FROM pg0)"""
HL = f"""{PG},
hl0 AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS ts FROM pg),
hl1 AS (SELECT page_id, url, unnest(generate_series(1, len(hs))) AS i, hs, ts FROM hl0),
hl AS (SELECT page_id, url, i - 1 AS link_seq, {normal_url(f"({origin('url')} || {unescape('hs[i]')})")} AS target, {squeeze(unescape('ts[i]'))} AS anchor FROM hl1)"""
LK = f"""{HL},
lk AS (SELECT page_id AS from_id, (page_id * 7 + link_seq * 3 + 1) % (SELECT count(*) FROM pages) AS to_id, anchor,
  CASE WHEN link_seq % 2 = 1 THEN 'row ' || (link_seq % 3) ELSE '' END AS context, page_id * 1000 + link_seq AS link_seq FROM hl
  WHERE page_id <> (page_id * 7 + link_seq * 3 + 1) % (SELECT count(*) FROM pages))"""


def site_alias(h: str) -> str:
    ls = f"list_filter(string_split({h}, '.'), lambda x: x <> 'www')"
    return f"CASE WHEN len({ls}) >= 3 AND length({ls}[-1]) = 2 AND length({ls}[-2]) <= 3 THEN {ls}[-3] WHEN len({ls}) >= 2 THEN {ls}[-2] ELSE {ls}[1] END"


PL = f"""{LK},
pl0 AS (SELECT {host('url')} AS h, min(page_id) AS place_id, arg_min({origin('url')}, page_id) AS origin FROM pg GROUP BY 1),
pl AS (SELECT place_id, origin, '/' AS path_prefix, origin || '/' AS scope, {site_alias('h')} AS alias, (place_id * 37 % 100) / 100 AS revisit,
  CASE WHEN place_id % 11 = 0 THEN 'hub' WHEN (place_id * 37 % 100) / 100 >= 0.5 THEN 'active' WHEN (place_id * 37 % 100) / 100 >= 0.2 THEN 'probation' ELSE 'dropped' END AS status FROM pl0)"""


def first_words(t: str, n: int) -> str:
    return f"array_to_string(list_filter(string_split({t}, ' '), lambda w: w <> '')[:{n}], ' ')"


PK = f"""{PL}, {EV},
pk AS (SELECT event_id AS pick_id, (k % (SELECT count(*) FROM pages)) AS page_id, {first_words('title', 2)} AS query
  FROM ev JOIN pg ON pg.page_id = k % (SELECT count(*) FROM pages) WHERE event_type = 'click'),
ql AS (SELECT DISTINCT page_id + 1000000 AS query_id, query FROM pk UNION ALL SELECT item_id, {first_words('text', 3)} FROM benchmark)"""


def add(name: str, ctes: str, select: str) -> None:
    SQL[name] = f"WITH {ctes}\n{select}"


# --- URLs and HTML

P1 = f"p AS (SELECT page_id, url AS raw, {normal_url('url')} AS url FROM pages)"
add("url_normalize", P1, "SELECT page_id, url FROM p")
add("url_origin", P1, f"SELECT page_id, {origin('raw')} AS origin FROM p")
add("url_segments", P1, f"SELECT page_id, array_to_string({segs('raw')}, '|') AS segments, len({segs('raw')}) AS n FROM p")


def kind_of(u: str) -> str:
    p = f"lower({path(u)})"
    return f"""CASE WHEN {p} LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches({p}, '\\.(pptx?|key)$') OR ({host(u)} = 'docs.google.com' AND starts_with({p}, '/presentation')) THEN 'slides'
  WHEN regexp_matches({p}, '\\.(mp4|mov|webm|m4v)$') OR regexp_matches({host(u)}, '(youtube\\.com|youtu\\.be|panopto|vimeo)') THEN 'video'
  WHEN regexp_matches({p}, '\\.(docx?|xlsx?|zip|tar|gz|txt|md|ipynb|py|java|go|c|h|cpp|rs|png|jpe?g|gif|svg)$') THEN 'file' ELSE 'html' END"""


_ended = f"({origin('url')} || {path('url')} || {pick('page_id % 7', *(repr(x) for x in ('', '.pdf', 'x.pptx', 'v.mp4', 'a.zip', 'b.PDF', '.md')))})"
add("url_kind", P1, f"SELECT page_id, {kind_of('u')} AS kind FROM (SELECT page_id, {_ended} AS u FROM p)")
add("url_template", P1, f"SELECT page_id, {template('url')} AS template FROM p")
_w = f"regexp_replace(regexp_replace({host('url')} || ' ' || {path('url')}, '([a-zA-Z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-zA-Z])', '\\1 \\2', 'g')"
add("url_words", P1, f"SELECT page_id, trim(regexp_replace(lower({_w}), '[^a-z0-9]+', ' ', 'g')) AS words FROM p")
add("url_directory", P1, f"SELECT page_id, {directory('url')} AS directory, {key('url')} AS path_key FROM p")
add("segment_shape", P1, f"SELECT page_id, array_to_string(list_transform({segs('url')}, lambda s: {shape('s')}), '|') AS shapes FROM p")
add("action_urls", P1, "SELECT page_id, page_id % 5 IN (1, 2, 4) OR regexp_matches(url, '(?i)(logout|log_out|signout|sign_out|delete|remove|unsubscribe|/edit\\b)') AS is_action FROM p")
_s = f"({bare('url')} || regexp_replace({path('url')} || CASE WHEN {params('url')} = '' THEN repeat('/abcdefghij', (page_id % 5)::INT) ELSE '' END, '/$', ''))"
add("short_url", P1, f"SELECT page_id, CASE WHEN length({_s}) > 60 THEN left({_s}, 57) || '…' ELSE {_s} END AS short FROM p")
_named = f"list_filter({segs('url')}, lambda s: length(s) > 1 AND NOT regexp_full_match(s, '(?i)([0-9]+[a-z]{{0,2}}|[a-z]?[0-9]+|[0-9a-f-]{{12,}})'))"
add("place_alias", P1, f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'my docs' ELSE coalesce(left(lower({_named}[-1]), 40), {site_alias(host('url'))}) END AS alias FROM p")
add("url_relation", HL, f"""SELECT page_id, link_seq, CASE WHEN {origin('target')} <> {origin('url')} THEN 'outside'
  WHEN starts_with({path('target')}, {directory('url')}) AND {path('target')} <> {path('url')} THEN 'deeper' ELSE 'sideways' END AS relation FROM hl""")
add("html_title", PG, "SELECT page_id, title FROM pg")
add("html_headings", PG, "SELECT page_id, array_to_string(headings, ' | ') AS headings, len(headings) AS n FROM pg")
# of the pages' links, all stand alone in a list item: the item says no more than they do
add("html_links", HL, "SELECT page_id, link_seq, target, anchor, '' AS context FROM hl")
add("html_snippet", PG, "SELECT page_id, snippet FROM pg")
# pages have paragraphs, which end where the next begins, and boxes without any; what stands in menus does not count
_shown = "regexp_extract(html, '(?s)<body>(.*)', 1)"
for _t in ("nav", "header", "footer", "aside", "form", "script", "style"):
    _shown = f"regexp_replace({_shown}, '(?s)<{_t}[ >].*?</{_t}>', ' ', 'g')"
_text = lambda x: squeeze(unescape(f"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"))
OUT = f"""ou0 AS (SELECT page_id, regexp_replace({_shown}, '(?s)<!--.*?-->', ' ', 'g') AS b FROM pages),
ou1 AS (SELECT page_id, b, list_filter(list_transform(regexp_extract_all(b, '(?s)<h[123]>(.*?)</h[123]>', 1), lambda x: left({_text('x')}, 120)), lambda x: x <> '') AS hs,
  list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(b, '<p>', '</p><p>', 'g'), '</?(article|div|body)[^>]*>', '</p>', 'g'), '(?s)<p>(.*?)</p>', 1), lambda x: {_text('x')}), lambda x: len(string_split(x, ' ')) >= 5) AS ps,
  list_filter(list_transform(regexp_extract_all(b, '(?s)<div[^>]*>([^<]*)</div>', 1), lambda x: {_text('x')}), lambda x: len(string_split(x, ' ')) >= 5) AS ds FROM ou0)"""
add("page_outline", OUT, """SELECT page_id, array_to_string(hs, ' | ') AS headings, array_to_string(list_transform(CASE WHEN len(ps) > 0 THEN ps[:2] ELSE ds[:6] END, lambda x: left(x, 300)), ' … ') AS blocks,
  len(regexp_extract_all(b, '<a href="')) AS n_links FROM ou1""")
add("compose_snippet", PG, f"""SELECT page_id, left(concat_ws(' | ', CASE WHEN title <> '' THEN 'Description: ' || title END,
  CASE WHEN page_id % 2 = 0 THEN 'Breadcrumb: ' || {host('url')} END, nullif(array_to_string(headings, ' | '), '')), 1000) AS snippet FROM pg""")
add("clip_text", PG, f"SELECT page_id, {clip('title', 20)} AS clipped FROM pg")
_read = "CASE WHEN raw IS NULL THEN '' WHEN json_valid(raw) THEN CASE WHEN json_type(raw::JSON) = 'ARRAY' THEN array_to_string(from_json(raw, '[\"VARCHAR\"]'), ' | ') ELSE raw::JSON ->> '$' END ELSE {} END"
add("headings_json", f"{PG}, hj AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN to_json(headings)::VARCHAR WHEN 1 THEN '\"one\"' WHEN 2 THEN 'not json' END AS raw FROM pg)",
    f"SELECT page_id, {_read.format('raw')} AS kept, {_read.format(repr(''))} AS strict FROM hj")
SQL["login_wall"] = "SELECT page_id, page_id % 5 = 0 OR regexp_matches(html, '(?i)<input[^>]+type\\s*=\\s*[\"'']?password') AS login FROM pages"
_types = pick("page_id % 5", *(f"'{x}'" for x in ("text/html; charset=utf-8", "application/pdf", "image/png", "", "Application/XHTML+xml ;q=1")))
SQL["content_kind"] = f"""SELECT page_id, media IN ('text/html', 'application/xhtml+xml') AS is_html, CASE WHEN media = 'application/pdf' THEN 'pdf' WHEN media <> '' THEN 'file' END AS kind
  FROM (SELECT page_id, lower(trim(split_part({_types}, ';', 1))) AS media FROM pages)"""

# --- visits and scores

add("visits_window", V, f"SELECT user_id, event_id, url FROM v WHERE ts_s >= {NOW} - 14 * 86400")
add("visit_referrer", V, """SELECT event_id, event_id % 3 AS tab_id, url, CASE WHEN b <> url THEN b END AS from_url FROM
  (SELECT *, lag(url) OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts_s, event_id) AS b FROM v)""")
SESSIONS = f"""{EV},
t AS (SELECT user_id, event_id, ts_s, event_type AS title, CASE WHEN k % 17 <> 0 THEN url END AS url, CASE WHEN k % 17 <> 0 THEN 't' || (user_id % 3 + k % 2) END AS tab FROM ev),
f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR url IS DISTINCT FROM lag(url) OVER w OR tab IS DISTINCT FROM lag(tab) OVER w THEN 1 ELSE 0 END AS new FROM t
  WINDOW w AS (PARTITION BY user_id ORDER BY ts_s, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts_s, event_id) AS run FROM f),
g AS (SELECT user_id, run, any_value(url) AS url, any_value(tab) AS tab, min(ts_s) AS s, max(ts_s) AS l, arg_min(title, event_id) AS title FROM r GROUP BY 1, 2),
e AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY run), l) AS e FROM g),
w AS (SELECT *, lag(url) OVER (PARTITION BY user_id, tab ORDER BY s, run) AS b FROM e WHERE url IS NOT NULL)"""
add("sessionize", SESSIONS, "SELECT user_id, url, title, round(s, 3) AS start_s, round(e - s, 3) AS duration_s, CASE WHEN b <> url THEN b END AS from_url FROM w")
add("url_days", V, "SELECT user_id, url, count(DISTINCT floor(ts_s / 86400)) AS n_days FROM v GROUP BY 1, 2")
add("day_gaps", SI, "SELECT user_id, scope, left((DATE '1970-01-01' + day::INT)::VARCHAR, 10) AS day, gap::INT AS gap FROM pf_g WHERE gap IS NOT NULL")
add("arrivals", SI, "SELECT user_id, scope, count(*) FILTER (arrival) AS arrivals, count(*) AS visits FROM si GROUP BY 1, 2")
for _n, _c in (("decayed_days", "days"), ("bounce_rate", "bounce"), ("regularity", "regular"), ("from_search_share", "from_search"), ("revisit_score", "revisit")):
    add(_n, SI, f"SELECT user_id, scope, {_c} FROM pf")
add("place_features", SI, "SELECT user_id, scope, visits, n_days, days, breadth, bounce, regular, from_search FROM pf")
add("features_json", SI, """SELECT user_id, scope, '{"visits":' || visits || ',"n_days":' || n_days || ',"breadth":' || breadth || '}' AS features FROM pf""")
add("place_span", SI, f"SELECT user_id, scope, round(CASE WHEN length(scope) % 2 = 0 THEN least(first_visit, {NOW} - 40 * 86400) ELSE first_visit END, 3) AS first_visit, round(last_visit, 3) AS last_visit FROM pf")
add("place_status", SI, f"SELECT user_id, scope, {STATUS} AS status FROM pf")
add("page_scores", f"{H}, ps0 AS (SELECT *, TRUE AS arrival FROM fl), {features('ps0', 'user_id, url', 7.0, 'ps', False)}", "SELECT user_id, url, visits, days, bounce, regular, from_search, revisit FROM ps")

# --- hubs and places

add("hub_stats", H, "SELECT user_id, path_key, n_visits, distinct_share, brief_share, n_origins FROM hub_stats")
add("hubs", H, "SELECT * FROM hub")
add("hub_split", H, "SELECT user_id, on_hub, from_hub, count(*) AS n FROM fl GROUP BY ALL")


def joined(list_: str) -> str:
    return f"('/' || array_to_string(list_transform({list_}, lambda s: s || '/'), ''))"


AT = '"at"'  # a reserved word


def grouping(rows: str, name: str) -> str:
    """From user_id, url, n_days: {name} (user_id, origin, path_prefix, url, n_days), level by level."""
    out = [
        f"""{name}_a0 AS (SELECT user_id, url, n_days, {origin('url')} AS origin, {segs('url')} AS own,
  list_filter(string_split({directory('url')}, '/'), lambda s: s <> '') AS node FROM {rows}),
{name}_k AS (SELECT DISTINCT user_id, origin, node[:i] AS d FROM (SELECT *, unnest(generate_series(1, len(node))) AS i FROM {name}_a0))"""
    ]
    for i in range(1, 5):
        out.append(
            f"""{name}_a{i} AS (SELECT a.user_id, a.url, a.n_days, a.origin, a.own, CASE WHEN k.d IS NOT NULL THEN k.d ELSE a.node END AS node
  FROM {name}_a{i - 1} a LEFT JOIN {name}_k k ON k.user_id = a.user_id AND k.origin = a.origin AND len(a.node) < 4 AND len(a.own) > 0 AND k.d = list_append(a.node, a.own[-1]))"""
        )
    out.append(f"{name}_r0 AS (SELECT * FROM {name}_a4)")
    places = []
    for d in range(5):
        out.append(f'{name}_l{d} AS (SELECT *, node[:{d}] AS "at", node[{d + 1}] AS child FROM {name}_r{d})')
        if d == 4:
            out.append(f"{name}_x{d} AS (SELECT *, FALSE AS goes FROM {name}_l{d})")
        else:
            out.append(
                f"""{name}_s{d} AS (SELECT DISTINCT user_id, origin, "at", child, list_transform(own[{d + 3}:], lambda s: {shape('s')}) AS sh
  FROM {name}_l{d} WHERE child IS NOT NULL AND len(own) - {d + 1} >= 2),
{name}_t{d} AS (SELECT DISTINCT a.user_id, a.origin, a."at", a.child FROM {name}_s{d} a JOIN {name}_s{d} b ON a.user_id = b.user_id AND a.origin = b.origin AND a."at" = b."at"
  AND a.child <> b.child AND len(a.sh) = len(b.sh) AND list_sum(list_transform(generate_series(1, len(a.sh)), lambda i: CASE WHEN a.sh[i] = b.sh[i] THEN 1 ELSE 0 END)) >= greatest(1, ceil(len(a.sh) / 2))),
{name}_w{d} AS (SELECT user_id, origin, "at", child, sum(n_days) AS w FROM {name}_l{d} GROUP BY ALL),
{name}_b{d} AS (SELECT *, sum(w) OVER (PARTITION BY user_id, origin, "at") AS total, row_number() OVER (PARTITION BY user_id, origin, "at" ORDER BY child IS NULL, w DESC, child) AS r FROM {name}_w{d}),
{name}_x{d} AS (SELECT l.*, l.child IS NOT NULL AND (EXISTS (SELECT 1 FROM {name}_t{d} t WHERE t.user_id = l.user_id AND t.origin = l.origin AND t."at" = l."at" AND t.child = l.child)
  OR (NOT EXISTS (SELECT 1 FROM {name}_t{d} t WHERE t.user_id = l.user_id AND t.origin = l.origin AND t."at" = l."at")
  AND EXISTS (SELECT 1 FROM {name}_b{d} b WHERE b.user_id = l.user_id AND b.origin = l.origin AND b."at" = l."at" AND b.child = l.child AND b.r = 1 AND b.w >= 0.8 * b.total))) AS goes FROM {name}_l{d} l),
{name}_r{d + 1} AS (SELECT user_id, url, n_days, origin, own, node FROM {name}_x{d} WHERE goes)"""
            )
        places.append(f"SELECT user_id, origin, {joined(AT)} AS path_prefix, url, n_days FROM {name}_x{d} WHERE NOT goes")
    out.append(f"{name} AS ({' UNION ALL '.join(places)})")
    return ",\n".join(out)


def cycle(v: str, name: str) -> str:
    """{name} (user_id, scope, origin, path_prefix, url, is_hub) and {name}_p (features, status) of the visits in v."""
    return f"""{hubs_of(v, name + '_h')},
{flagged(v, name + '_h', name + '_f')},
{name}_ud AS (SELECT user_id, url, count(DISTINCT floor(ts_s / 86400)) AS n_days FROM {name}_f WHERE NOT on_hub GROUP BY 1, 2),
{grouping(name + '_ud', name + '_g')},
{name}_ho AS (SELECT DISTINCT user_id, {origin('url')} AS origin, {directory('url')} AS path_prefix, url FROM {name}_f WHERE on_hub),
{name} AS (SELECT user_id, origin || path_prefix AS scope, url, FALSE AS is_hub FROM {name}_g UNION ALL
  SELECT user_id, origin || path_prefix, url, TRUE FROM {name}_ho h WHERE NOT EXISTS (SELECT 1 FROM {name}_g g WHERE g.user_id = h.user_id AND g.origin || g.path_prefix = h.origin || h.path_prefix)),
{name}_m AS (SELECT f.*, p.scope, p.is_hub FROM {name}_f f JOIN {name} p USING (user_id, url)),
{arrivals(name + '_m', 'scope', name + '_ar')},
{features(name + '_ar', 'user_id, scope, is_hub', 14.0, name + '_ft')},
{name}_p AS (SELECT *, CASE WHEN is_hub THEN 'hub' ELSE {STATUS} END AS status FROM {name}_ft)"""


UD = f"{H},\nud AS (SELECT user_id, url, count(DISTINCT floor(ts_s / 86400)) AS n_days FROM fl WHERE NOT on_hub GROUP BY 1, 2),\n{grouping('ud', 'gr')}"
add("prefix_weights", UD, f"SELECT user_id, origin, {joined('node[:i]')} AS prefix, sum(n_days)::BIGINT AS weight FROM (SELECT *, unnest(generate_series(0, len(node))) AS i FROM gr_a4) GROUP BY 1, 2, 3")
_all_t = [f"""tn{d}_s AS (SELECT DISTINCT user_id, origin, node[:{d}] AS "at", node[{d + 1}] AS child, list_transform(own[{d + 3}:], lambda s: {shape('s')}) AS sh
  FROM gr_a4 WHERE len(node) > {d} AND len(own) - {d + 1} >= 2),
tn{d} AS (SELECT DISTINCT a.user_id, a.origin, {joined("a." + AT)} AS "at", a.child FROM tn{d}_s a JOIN tn{d}_s b ON a.user_id = b.user_id AND a.origin = b.origin AND a."at" = b."at"
  AND a.child <> b.child AND len(a.sh) = len(b.sh) AND list_sum(list_transform(generate_series(1, len(a.sh)), lambda i: CASE WHEN a.sh[i] = b.sh[i] THEN 1 ELSE 0 END)) >= greatest(1, ceil(len(a.sh) / 2)))""" for d in range(4)]
add("tenant_children", ",\n".join([UD, *_all_t]), " UNION ALL ".join(f"SELECT * FROM tn{d}" for d in range(4)))
add("place_groups", UD, "SELECT user_id, origin || path_prefix AS scope, count(*) AS n_urls, sum(n_days)::BIGINT AS weight FROM gr GROUP BY 1, 2")
add("all_places", f"{V}, {cycle('v', 'cy')}", "SELECT user_id, scope, is_hub, count(*) AS n_urls FROM cy GROUP BY 1, 2, 3")
add("watch_summary", f"{V}, {cycle('v', 'cy')}", "SELECT user_id, count(*) FILTER (NOT is_hub) AS places, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'probation') AS probation, count(*) FILTER (status = 'dropped') AS dropped, count(*) FILTER (status = 'hub') AS hub FROM cy_p GROUP BY 1")
add("retired_places", f"{V}, vn AS (SELECT * FROM v WHERE ts_s >= {NOW} - 2 * 86400), {cycle('v', 'old')}, {cycle('vn', 'cur')}",
    "SELECT user_id, scope, 'dropped' AS status, 0.0::DOUBLE AS revisit FROM old_p o WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE c.user_id = o.user_id AND c.scope = o.scope) AND (status <> 'dropped' OR revisit <> 0)")

# --- the store

FRESH = "fr AS (SELECT url, CASE WHEN page_id % 2 = 0 THEN title || '!' END AS title, 7 AS visit_count, 9.0 AS revisit FROM pg WHERE page_id % 3 = 0 UNION ALL SELECT url || '#new', 'new', 1, 1.0 FROM pg WHERE page_id % 5 = 0)"
add("upsert_pages", f"{PG}, {FRESH}", """SELECT url, CASE WHEN f.url IS NOT NULL THEN f.title ELSE p.title END AS title, CASE WHEN f.url IS NOT NULL THEN f.visit_count ELSE p.visit_count END AS visit_count,
  coalesce(p.revisit, 0.0)::DOUBLE AS revisit FROM pg p FULL JOIN fr f USING (url)""")
add("changed_pages", f"{PG}, {FRESH}", """SELECT f.url, f.title, f.visit_count FROM fr f LEFT JOIN pg p USING (url)
  WHERE p.page_id IS NULL OR f.title IS DISTINCT FROM p.title OR f.visit_count IS DISTINCT FROM p.visit_count""")
add("upsert_places", PL, """SELECT scope, CASE WHEN n.scope IS NULL OR p.scope IS NOT NULL THEN p.alias END AS alias, coalesce(n.status, p.status) AS status, round(coalesce(n.revisit, p.revisit), 6) AS revisit
  FROM pl p FULL JOIN (SELECT scope, 'active' AS status, revisit / 2 AS revisit FROM pl WHERE revisit >= 0.5 UNION ALL SELECT 'https://new.example/', 'active', 0.5) n USING (scope)""")
add("upsert_links", LK, """SELECT from_id, to_id, CASE WHEN to_id % 2 = 0 THEN arg_max(anchor, link_seq) || '!' ELSE arg_max(anchor, link_seq) END AS anchor,
  arg_max(context, link_seq) AS context, min(link_seq) AS link_seq FROM lk GROUP BY 1, 2""")
add("places_listing", PL, """SELECT scope, status, round(pl.revisit, 6) AS revisit, count(pg.page_id) AS pages FROM pl LEFT JOIN pg ON pg.place_id = pl.place_id
  WHERE status IN ('active', 'probation') GROUP BY 1, 2, 3 ORDER BY 3 DESC, 1 LIMIT 30""")

# --- the graph

add("link_dedup", f"""{HL}, both_ AS (SELECT page_id, target, anchor, link_seq FROM hl UNION ALL SELECT page_id, target, anchor || ' again', link_seq + 100 FROM hl),
sm AS (SELECT page_id, target, CASE WHEN link_seq % 3 = 0 THEN '' ELSE anchor END AS anchor, link_seq FROM both_)""",
    "SELECT page_id, target, coalesce(arg_min(anchor, link_seq) FILTER (anchor <> ''), '') AS anchor, min(link_seq) AS link_seq FROM sm GROUP BY 1, 2")


def first_ten(column: str) -> str:
    return f"""(SELECT to_id, string_agg(t, ' | ' ORDER BY seq, t) AS s, list(t ORDER BY seq, t) AS l FROM (SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY seq, t) AS r FROM
  (SELECT to_id, {squeeze(column)} AS t, min(link_seq) AS seq FROM lk WHERE {squeeze(column)} <> '' GROUP BY 1, 2)) WHERE r <= 10 GROUP BY 1)"""


LT = f"lt AS (SELECT to_id AS page_id, coalesce(a.s, '') AS anchors, coalesce(c.s, '') AS contexts, coalesce(a.l, []) AS al, coalesce(c.l, []) AS cl FROM {first_ten('anchor')} a FULL JOIN {first_ten('context')} c USING (to_id))"
add("link_texts", f"{LK}, {LT}", "SELECT page_id, anchors, contexts FROM lt")
add("incoming_anchors", LK, "SELECT to_id AS page_id, string_agg(anchor, ' | ' ORDER BY link_seq) AS anchors FROM lk WHERE anchor <> '' GROUP BY 1")
add("page_with_place", PL, "SELECT page_id, status, alias AS place_alias, round(pl.revisit, 6) AS place_revisit FROM pg LEFT JOIN pl ON pl.place_id = pg.place_id")
add("non_hub_pages", PL, "SELECT page_id FROM pg LEFT JOIN pl ON pl.place_id = pg.place_id WHERE coalesce(status, '') <> 'hub'")
INH = "inh AS (SELECT l.to_id AS page_id, max(p.revisit) AS inherited FROM lk l JOIN pg f ON f.page_id = l.from_id JOIN pl p ON p.place_id = f.place_id GROUP BY 1)"
add("inherited_revisit", f"{PL}, {INH}", "SELECT page_id, round(inherited, 6) AS inherited FROM inh")
RV = f"{INH}, rv AS (SELECT g.*, p.status, p.alias, p.origin, greatest(g.revisit, coalesce(p.revisit, i.inherited, 0)) AS rv FROM pg g LEFT JOIN pl p ON p.place_id = g.place_id LEFT JOIN inh i ON i.page_id = g.page_id)"
add("effective_revisit", f"{PL}, {RV}", "SELECT page_id, round(rv, 6) AS rv FROM rv")
SITE = """st AS (SELECT page_id, site FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY revisit DESC, site) AS r FROM
  (SELECT l.to_id AS page_id, coalesce(p.alias, p.origin) AS site, max(p.revisit) AS revisit FROM lk l JOIN pg f ON f.page_id = l.from_id JOIN pl p ON p.place_id = f.place_id GROUP BY 1, 2)) WHERE r = 1)"""
add("linking_site", f"{PL}, {SITE}", "SELECT page_id, site FROM st")
RECENT = f"""rc AS (SELECT page_id, visited FROM pg g WHERE (visited AND last_visit >= {NOW} - 30 * 86400) OR (NOT visited AND EXISTS
  (SELECT 1 FROM lk l JOIN pg f ON f.page_id = l.from_id WHERE l.to_id = g.page_id AND f.visited AND f.last_visit >= {NOW} - 30 * 86400)))"""
add("recent_or_one_hop", f"{LK}, {RECENT}", "SELECT * FROM rc")
_nothing = "(?i)\\W*(slides?|pdf|ppt|pptx|here|click here|link|video|recording|download|view|open|notes|handout|html|watch|more|read more|[0-9]+)?\\W*"
_tell = f"list_filter(al, lambda a: NOT regexp_full_match(a, '{_nothing}'))"
LABEL = f"""lb AS (SELECT g.page_id, g.url, g.snippet, coalesce(al, []) AS al, coalesce(cl, []) AS cl, coalesce(p.alias, p.origin, s.site, {host('g.url')}) AS site,
  coalesce(left({_tell}[1], 120), CASE WHEN len(al) > 0 AND len(cl) > 0 THEN left(cl[1], 100) || ' — ' || al[1] END, nullif(left(title, 120), ''), headings[1], {segs('g.url')}[-1], {host('g.url')}) AS label
  FROM pg g LEFT JOIN lt USING (page_id) LEFT JOIN st s USING (page_id) LEFT JOIN pl p ON p.place_id = g.place_id)"""
add("page_label", f"{PL}, {LT}, {SITE}, {LABEL}", "SELECT page_id, label FROM lb")
_extra = "array_to_string(list_concat(list_filter(cl, lambda c: NOT contains(label, c)), al[2:3]), ' · ')"
add("page_description", f"{PL}, {LT}, {SITE}, {LABEL}", f"""SELECT page_id, site, left(concat_ws(' | ', label, site || ' › ' || {bare('url')} || {path('url')}, 'html',
  CASE WHEN {_extra} <> '' THEN {_extra} ELSE {squeeze('snippet')} END), 400) AS description FROM lb""")

# --- names

SEP = "\\s+[–—|·•-]\\s+"
TITLED = """SELECT page_id, 'https://site' || (page_id % 5) || '.example/p/' || page_id AS url, 'site' || (page_id % 5) || '.example' AS host,
  CASE WHEN page_id % 6 = 0 THEN '' WHEN page_id % 3 = 0 THEN '(' || page_id || ') ' || title || ' – Site Name' WHEN page_id % 3 = 1 THEN 'Home · Site Name' ELSE title END AS title, headings FROM pg"""


def cleaned(pages: str) -> str:
    """ct: pages with their clean titles; sf: suffixes of sites; gt: titles that several pages of a site have."""
    tt = f"""{LK}, tt AS ({pages}),
t2 AS (SELECT *, trim(regexp_replace({squeeze('title')}, '\\s*\\([0-9][0-9,]*\\)', '', 'g')) AS plain FROM tt),
sf AS (SELECT host, suffix, count(*) AS n FROM (SELECT DISTINCT host, plain, lower(string_split_regex(plain, '{SEP}')[-1]) AS suffix FROM t2 WHERE title <> '' AND regexp_matches(plain, '{SEP}')) GROUP BY 1, 2 HAVING count(*) >= 3)"""
    # endings are dropped one after the other; more than four do not occur
    steps = ["c0 AS (SELECT *, plain AS clean FROM t2)"]
    for i in range(4):
        end = f"lower(string_split_regex(clean, '{SEP}')[-1])"
        steps.append(
            f"""c{i + 1} AS (SELECT * REPLACE (CASE WHEN regexp_matches(clean, '{SEP}') AND EXISTS (SELECT 1 FROM sf s WHERE s.host = c.host AND s.suffix = {end})
  THEN regexp_replace(left(clean, length(clean) - length({end})), '[ –—|·•-]+$', '') ELSE clean END AS clean) FROM c{i} c)"""
        )
    return ",\n".join([tt, *steps, "ct AS (SELECT * REPLACE (trim(clean) AS clean) FROM c4)", "gt AS (SELECT host, lower(clean) AS lowered, count(*) AS n FROM ct WHERE title <> '' GROUP BY 1, 2 HAVING count(*) >= 2)"])


CT = cleaned(TITLED)
add("site_suffixes", CT, "SELECT host, suffix, n FROM sf")
add("clean_title", CT, "SELECT page_id, clean FROM ct")
add("generic_titles", CT, "SELECT host, lowered, n FROM gt")


def named(pages: str, links: str) -> str:
    no_name = "(?i)(here|link|pdf|slides?|video|recording|notes|click here|download|code|handout|\\[.*\\]|[0-9]+|more|open|view)"
    default = "(?i)(powerpoint presentation|presentation[0-9]*|untitled( document| presentation| spreadsheet)?|document[0-9]*|microsoft (word|powerpoint|excel) - .*|slide [0-9]+|new tab)"
    tail = f"coalesce({segs('c.url')}[-1], c.host)"
    ok = f"c.clean <> '' AND NOT regexp_full_match(c.clean, '{default}')"
    return f"""na AS (SELECT to_id AS page_id, list(trim(anchor) ORDER BY link_seq) AS al FROM lk WHERE anchor <> '' AND {links} GROUP BY 1),
nm AS (SELECT c.url, coalesce(left(list_filter(al, lambda a: a <> '' AND NOT regexp_full_match(a, '{no_name}'))[1], 100),
  CASE WHEN {ok} AND g.lowered IS NULL THEN left(c.clean, 100) END, left(c.headings[1], 100), CASE WHEN {ok} THEN left(c.clean || ' · ' || {tail}, 100) END, left({tail}, 100)) AS name
  FROM {pages} c LEFT JOIN na USING (page_id) LEFT JOIN gt g ON g.host = c.host AND g.lowered = lower(c.clean))"""


add("page_names", f"{CT}, {named('ct', 'to_id % 4 = 0')}", "SELECT url, name FROM nm")
OWN = f"SELECT page_id, url, {bare('url')} AS host, title, headings FROM pg"
add("changed_names", f"{cleaned(OWN)}, {named('ct', 'TRUE')}", """SELECT n.url, n.name FROM nm n LEFT JOIN (SELECT url, CASE WHEN page_id % 2 = 0 THEN title END AS was FROM pg) o USING (url)
  WHERE n.name <> '' AND n.name IS DISTINCT FROM o.was""")

# --- text, index and retrieval

SQL["normalize_text"] = f"SELECT page_id, {plain_words(chr(39) + 'CSE452 L04! 007 ' + chr(39) + ' || url')} AS normal FROM (SELECT page_id, url FROM pages)"
add("query_tokens", PK, f"SELECT query_id, array_to_string({query_tokens(chr(39) + 'the page of ' + chr(39) + ' || query')}, ' ') AS tokens FROM ql")


def atoms(queries: str, name: str) -> str:
    """{name}: query_id, group_no, atom_no, kind, word, for queries without synonyms, which the driver's words never are."""
    plural = "length(w) >= 4 AND w LIKE '%s' AND w NOT LIKE '%ss'"
    return f"""{name}_q AS (SELECT query_id, {query_tokens('query')} AS ws FROM {queries}),
{name}_w AS (SELECT query_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS group_no FROM {name}_q),
{name} AS (SELECT query_id, group_no, 0 AS atom_no, CASE WHEN length(w) < 3 THEN 'term' ELSE 'prefix' END AS kind, CASE WHEN length(w) >= 3 AND {plural} THEN left(w, length(w) - 1) ELSE w END AS word FROM {name}_w)"""


SYN = ", ".join(f"({g}, {i}, '{w}')" for g, group in enumerate(SYNONYMS) for i, w in enumerate(group))
GROUPS = f"""{PK}, sy AS (SELECT * FROM (VALUES {SYN}) t(g, i, w)),
gq AS (SELECT query_id, {query_tokens("query || ' lectures pull request class hw the pr'")} AS ts FROM ql),
gw AS (SELECT query_id, unnest(generate_series(1, len(ts))) AS i, ts FROM gq),
gp AS (SELECT *, ts[i] || ' ' || ts[i + 1] IN (SELECT w FROM sy) IS TRUE AS two FROM gw),
gt_ AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS group_no, CASE WHEN two THEN ts[i] || ' ' || ts[i + 1] ELSE ts[i] END AS term
  FROM (SELECT *, coalesce(lag(two) OVER (PARTITION BY query_id ORDER BY i), FALSE) AS taken FROM gp) WHERE NOT taken),
ge AS (SELECT query_id, group_no, -1 AS i, term AS t FROM gt_ UNION ALL SELECT query_id, group_no, o.i, o.w FROM gt_ JOIN sy s ON s.w = term JOIN sy o ON o.g = s.g AND o.w <> term),
ga AS (SELECT query_id, group_no, i, CASE WHEN contains(t, ' ') THEN 'phrase' WHEN length(t) < 3 THEN 'term' ELSE 'prefix' END AS kind,
  CASE WHEN length(t) >= 4 AND NOT contains(t, ' ') AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END AS words FROM ge),
gd AS (SELECT query_id, group_no, kind, words, min(i) AS i FROM ga GROUP BY ALL)"""
add("query_atoms", GROUPS, "SELECT query_id, group_no, row_number() OVER (PARTITION BY query_id, group_no ORDER BY i) - 1 AS atom_no, kind, words FROM gd")
add("match_string", GROUPS, """SELECT query_id, string_agg('"' || words || CASE WHEN kind = 'prefix' THEN '"*' ELSE '"' END, ' OR ' ORDER BY group_no, i) AS match FROM gd GROUP BY 1
  UNION ALL SELECT query_id, '' FROM gq WHERE len(ts) = 0""")


def posts(rows: str, name: str) -> str:
    """rows: doc_id, field, text."""
    return f"{name}_t AS (SELECT doc_id, field, {tokens('text')} AS ts FROM {rows}),\n{name} AS (SELECT doc_id, field, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS pos FROM {name}_t)"


DOCS = f"dr AS (SELECT doc_id, 'text' AS field, text FROM documents),\n{posts('dr', 'dp')}"
BQ = f"bq AS (SELECT item_id AS query_id, {first_words('text', 3)} AS query FROM benchmark),\n{atoms('bq', 'ba')}"
add("fts_tokens", DOCS, "SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM dp GROUP BY 1")
PR = f"""{LT}, fld AS (SELECT page_id AS doc_id, unnest(['title', 'anchors', 'contexts', 'headings', 'snippet', 'words']) AS field,
  unnest([title, coalesce(lt.anchors, ''), coalesce(lt.contexts, ''), array_to_string(headings, ' '), snippet, {_w}]) AS text FROM pg LEFT JOIN lt USING (page_id)),
{posts('fld', 'pp')}"""
add("fts_postings", f"{LK}, {PR}", "SELECT doc_id, field, pos, token FROM pp")
# the odd pages keep the title that was indexed before
add("fts_incremental", f"{LK}, {PR}".replace("unnest([title,", "unnest([CASE WHEN page_id % 2 = 0 THEN title ELSE 'stale' END,"), "SELECT doc_id, field, pos, token FROM pp")


def matched(p: str, a: str, name: str) -> str:
    return f"""{name}_a AS (SELECT DISTINCT kind, word FROM {a}),
{name}_k AS (SELECT a.kind, a.word, t.token FROM {name}_a a JOIN (SELECT DISTINCT token FROM {p}) t ON (a.kind = 'term' AND t.token = a.word) OR (a.kind = 'prefix' AND starts_with(t.token, a.word))),
{name} AS (SELECT k.kind, k.word, p.doc_id, p.field, p.pos FROM {name}_k k JOIN {p} p USING (token))"""


add("fts_match", f"{DOCS}, {BQ}, {matched('dp', 'ba', 'mt')}", "SELECT word AS words, doc_id, pos FROM mt WHERE kind = 'term'")
add("fts_prefix", f"{DOCS}, {BQ}, {matched('dp', 'ba', 'mt')}", "SELECT word AS words, doc_id, pos FROM mt WHERE kind = 'prefix'")
add("fts_phrase", f"{DOCS}, two AS (SELECT DISTINCT {tokens(first_words('text', 2))} AS ws FROM benchmark)",
    "SELECT array_to_string(ws, ' ') AS words, a.doc_id, a.pos FROM two JOIN dp a ON a.token = ws[1] JOIN dp b ON b.doc_id = a.doc_id AND b.field = a.field AND b.pos = a.pos + 1 AND b.token = ws[2] WHERE len(ws) = 2")
add("bm25_stats", DOCS, "SELECT token, count(DISTINCT doc_id) AS df, (SELECT count(*) FROM documents) AS docs, (SELECT round(count(*) / (SELECT count(*) FROM documents), 6) FROM dp) AS avg_len FROM dp GROUP BY 1")


def ranked(p: str, a: str, docs: str, weight: str, name: str) -> str:
    return f"""{matched(p, a, name + '_m')},
{name}_f AS (SELECT kind, word, doc_id, sum({weight}) AS f FROM {name}_m GROUP BY 1, 2, 3),
{name}_n AS (SELECT kind, word, count(*) AS n FROM {name}_f GROUP BY 1, 2),
{name}_l AS (SELECT d.doc_id, count(p.token) AS len FROM {docs} d LEFT JOIN {p} p USING (doc_id) GROUP BY 1),
{name}_s AS (SELECT f.kind, f.word, f.doc_id, greatest(ln((g.docs - n.n + 0.5) / (n.n + 0.5)), 0) AS idf, f.f, 1.2 * (0.25 + 0.75 * l.len / g.avg_len) AS norm
  FROM {name}_f f JOIN {name}_n n USING (kind, word) JOIN {name}_l l USING (doc_id), (SELECT count(*) AS docs, avg(len) AS avg_len FROM {name}_l) g),
{name} AS (SELECT a.query_id, s.doc_id, sum(CASE WHEN s.idf <= 0 THEN 1e-6 ELSE s.idf END * s.f * 2.2 / (s.f + s.norm)) AS bm25, count(DISTINCT a.group_no) AS covered
  FROM {a} a JOIN {name}_s s USING (kind, word) GROUP BY 1, 2)"""


BM = f"{DOCS}, {BQ}, {ranked('dp', 'ba', 'documents', '1.0', 'bm')}"
add("bm25", BM, "SELECT query_id, doc_id, round(bm25, 6) AS bm25 FROM bm")
add("term_coverage", BM, "SELECT query_id, doc_id, covered FROM bm")
AW = f"aw AS (SELECT place_id, {tokens('alias')} AS ws FROM pl WHERE alias <> ''), awd AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT place_id, unnest(ws) AS word FROM aw) GROUP BY 1)"
add("alias_word_df", f"{PL}, {AW}", "SELECT word, n FROM awd")


def alias_hits(queries: str) -> str:
    return f"""{AW}, aq AS (SELECT query_id, {query_tokens('query')} AS ts FROM {queries}),
ag AS (SELECT DISTINCT query_id, array_to_string(ts[i:i + n - 1], '') AS g FROM aq, generate_series(1, 3) a(n), generate_series(1, 50) b(i) WHERE i <= len(ts)),
ah AS (SELECT query_id, place_id FROM ag JOIN aw ON array_to_string(ws, '') = g UNION SELECT query_id, place_id FROM aq, aw WHERE len(list_intersect(list_intersect(ws, ts), (SELECT coalesce(list(word), []) FROM awd WHERE n <= 2))) > 0),
ab AS (SELECT ah.query_id, g.page_id FROM ah JOIN pg g USING (place_id) UNION SELECT ah.query_id, l.to_id FROM ah JOIN pg g USING (place_id) JOIN lk l ON l.from_id = g.page_id)"""


ALQ = "alq AS (SELECT place_id AS query_id, 'open ' || alias || ' notes' AS query FROM pl)"
add("alias_places", f"{PL}, {ALQ}, {alias_hits('alq')}", "SELECT query_id, place_id FROM ah")
add("alias_boost", f"{PL}, {ALQ}, {alias_hits('alq')}", "SELECT query_id, page_id FROM ab")
_set = lambda q: f"list_sort(list_distinct({query_tokens(q)}))"
PICKS = f"""qs AS (SELECT query_id, {_set('query')} AS a FROM ql), ps_ AS (SELECT pick_id, page_id, {_set('query')} AS b FROM pk)"""
_applies = "len(a) > 0 AND len(b) > 0 AND (list_has_all(b, a) OR list_has_all(a, b))"
add("applicable_picks", f"{PK}, {PICKS}", f"SELECT query_id, page_id, count(*) AS n_picks FROM qs JOIN ps_ ON {_applies} GROUP BY 1, 2")


def collapsed(rows: str, k: int, name: str) -> str:
    key_ = f"regexp_replace({template('url')}, '^www\\.', '')"
    return f"""{name}_1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS r FROM {rows}),
{name}_2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, {key_} ORDER BY r) AS a FROM {name}_1 WHERE r <= {2 * k}),
{name}_3 AS (SELECT * EXCLUDE (a), row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM {name}_2 WHERE a = 1),
{name} AS (SELECT * FROM {name}_3 WHERE rank <= {k})"""


add("lookalike_collapse", f"{PG}, lc0 AS (SELECT page_id % 3 AS query_id, page_id, url, round(revisit + page_id % 7, 6) AS score FROM pg), {collapsed('lc0', 20, 'lc')}", "SELECT query_id, page_id, score, rank FROM lc")
WEIGHT = "CASE field WHEN 'title' THEN 2.5 WHEN 'anchors' THEN 3.0 WHEN 'contexts' THEN 1.5 WHEN 'headings' THEN 1.0 WHEN 'snippet' THEN 0.7 ELSE 0.5 END"


def retrieved(queries: str, picks: str, cases: str | None = None) -> str:
    """picks: query_id, page_id, n_picks. cases: case_id, query_id, hidden - the page that one pick is taken from."""
    hits = alias_hits(queries)
    n = "b.n_picks" + (" - (c.hidden = b.page_id)::INT" if cases else "")
    return f"""{PR}, {RV}, {RECENT}, {hits}, {atoms(queries, 'ra')}, pd AS (SELECT page_id AS doc_id FROM pg), {ranked('pp', 'ra', 'pd', WEIGHT, 'rk')},
rb AS (SELECT m.query_id, g.page_id, g.url, coalesce(k.n_picks, 0) AS n_picks, (m.bm25 + 2.0 * m.covered) * (0.5 + g.rv) AS base, CASE WHEN b.page_id IS NOT NULL THEN 3.0 ELSE 1.0 END AS boost
  FROM rk m JOIN rv g ON g.page_id = m.doc_id JOIN rc USING (page_id) LEFT JOIN ({picks}) k ON k.query_id = m.query_id AND k.page_id = g.page_id
  LEFT JOIN ab b ON b.query_id = m.query_id AND b.page_id = g.page_id WHERE coalesce(g.status, '') <> 'hub'),
rs AS (SELECT {'c.case_id' if cases else 'b.query_id'} AS query_id, b.page_id, b.url, {n} AS n_picks, round(b.base * (1 + {n}) * b.boost, 10) AS score FROM rb b{f' JOIN {cases} c USING (query_id)' if cases else ''}),
{collapsed('rs', 200, 'rt')}"""


_past = f"SELECT query_id, page_id, sum(n) AS n_picks FROM (SELECT query_id, a FROM qs) q JOIN (SELECT b, page_id, count(*) AS n FROM ps_ GROUP BY 1, 2) p ON {_applies} GROUP BY 1, 2"
RET = f"{PK}, {PICKS}, {retrieved('ql', _past)}"
add("retrieve", RET, "SELECT query_id, rank, page_id, round(score, 4) AS score, n_picks::BIGINT AS n_picks FROM rt")
add("search", RET, "SELECT query_id, rank AS place, page_id FROM rt WHERE rank <= 5")
# each distinct query is searched once, and ranked once for each page that was picked for it
EVAL = f"""{PK}, ps_ AS (SELECT pick_id, page_id, {_set('query')} AS b FROM pk), lq AS (SELECT row_number() OVER () AS query_id, query FROM (SELECT DISTINCT query FROM pk)),
qs AS (SELECT query_id, {_set('query')} AS a FROM lq), lc_ AS (SELECT row_number() OVER () AS case_id, query_id, query, page_id AS hidden FROM (SELECT DISTINCT query, page_id FROM pk) JOIN lq USING (query)),
{retrieved('lq', _past, 'lc_')},
ev5 AS (SELECT query_id, arg_min(page_id, rank) AS got, list(page_id) AS five FROM rt WHERE rank <= 5 GROUP BY 1),
ec AS (SELECT pick_id AS case_id, page_id AS picked, got, coalesce(got = page_id, FALSE) AS hit1, coalesce(list_contains(five, page_id), FALSE) AS hit5
  FROM pk JOIN lc_ c ON c.query = pk.query AND c.hidden = pk.page_id LEFT JOIN ev5 ON ev5.query_id = c.case_id)"""
add("eval_loo", EVAL, "SELECT * FROM ec")
add("eval_summary", EVAL, "SELECT count(*) AS cases, round(avg(hit1::INT), 2) AS top1, round(avg(hit5::INT), 2) AS top5, count(*) FILTER (NOT hit1) AS misses FROM ec")

# --- reranking

CA = "ca AS (SELECT item_id AS query_id, rank, item_id * 3 + rank AS page_id, 'option ' || rank || ' of ' || item_id AS description, (item_id + rank) % 3 AS n_picks FROM benchmark, generate_series(1, 3) t(rank))"
add("rerank_request", CA, """SELECT query_id, '{' || string_agg('"c' || (rank - 1) || '":"' || description || '"', ',' ORDER BY rank) || '}' AS criteria FROM ca GROUP BY 1""")
_answers = pick("query_id % 6", *(f"'{x}'" for x in ('{"probabilities": {"c0": 0.1, "c1": 0.7, "c2": "x"}}', '{"choice": "c2"}', '{"choice": "c1", "confidence": 0.4}', "not json", '{"probabilities": {"c0": -1, "c1": 0}}', '{"probabilities": {"c0": 0.04, "c2": 0.06}}')))
_positive = lambda x: f"greatest(coalesce(try_cast({x} AS DOUBLE), 0), 0)"
PRB = f"""{CA}, an AS (SELECT *, CASE WHEN json_valid(a) THEN a::JSON END AS j FROM (SELECT *, {_answers} AS a FROM ca)),
ap AS (SELECT * EXCLUDE (a, j), CASE WHEN len(json_keys(j, '$.probabilities')) > 0 THEN {_positive("j ->> ('$.probabilities.c' || (rank - 1))")}
  WHEN j ->> '$.choice' = 'c' || (rank - 1) THEN CASE WHEN j ->> '$.confidence' IS NULL THEN 1.0 ELSE {_positive("j ->> '$.confidence'")} END ELSE 0.0 END AS w FROM an),
pr AS (SELECT * EXCLUDE (w), CASE WHEN max(w) OVER (PARTITION BY query_id) > 0 THEN w END AS probability FROM ap)"""
add("rerank_parse", PRB, "SELECT query_id, rank, probability FROM pr")
add("rerank_cutoff", PRB, """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY probability * (1 + n_picks) DESC NULLS LAST, rank) AS place, page_id FROM pr
  WHERE probability IS NULL OR probability * (1 + n_picks) >= 0.1""")

# --- jobs and crawling

JB = f"""{EV}, jb AS (SELECT event_id AS job_id, CASE WHEN k % 2 = 0 THEN 'crawl' ELSE 'name' END AS type, 'key' || (k % 20) AS key,
  ['pending', 'running', 'done', 'failed'][k % 4 + 1] AS status, k % 3 AS attempts, ts_s AS started_at FROM ev WHERE event_type = 'error')"""
add("job_dedupe", f"{JB}, po AS (SELECT event_id AS post_id, 'crawl' AS type, CASE WHEN k % 10 <> 0 THEN 'key' || (k % 20) END AS key FROM ev WHERE event_type = 'error')",
    """SELECT * FROM po p WHERE key IS NULL OR (NOT EXISTS (SELECT 1 FROM jb j WHERE j.status = 'pending' AND j.job_id % 2 = 0 AND j.type = p.type AND j.key = p.key)
  AND NOT EXISTS (SELECT 1 FROM po q WHERE q.key = p.key AND q.post_id < p.post_id))""")
add("job_claim", JB, "SELECT job_id, type, 'running' AS status, attempts + 1 AS attempts FROM jb WHERE status = 'pending' AND type = 'crawl' ORDER BY job_id LIMIT 5")
add("job_state", f"""{EV}, je AS (SELECT event_id, k AS job_id, 'key' || (k % 20) AS key, ts_s AS at_s, CASE WHEN event_type = 'signup' THEN 'error ' || k END AS error, event_type,
  row_number() OVER (PARTITION BY k ORDER BY ts_s DESC, event_id DESC) AS r FROM ev WHERE event_type IN ('error', 'click', 'purchase', 'signup'))""",
    """SELECT job_id, 'crawl' AS type, min(key) AS key, max(CASE event_type WHEN 'error' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'failed' END) FILTER (r = 1) AS status,
  count(*) FILTER (event_type = 'click') AS attempts, round(max(at_s), 3) AS changed_at, max(error) FILTER (r = 1) AS error FROM je GROUP BY 1""")
add("job_requeue", JB, f"SELECT job_id, CASE WHEN status = 'running' AND started_at < {NOW} - 864000 THEN 'pending' ELSE status END AS status, status = 'running' AND started_at < {NOW} - 864000 AS requeued FROM jb")
add("crawl_requests", HL, f"""SELECT p.url, (SELECT count(*) FROM hl h WHERE h.url = p.url) AS n_links FROM pg p WHERE EXISTS (SELECT 1 FROM hl h WHERE h.url = p.url) AND NOT EXISTS (SELECT 1 FROM pg q WHERE q.url = p.url AND q.crawled_at > {NOW} - 86400)""")
TG = f"""{HL}, tg AS (SELECT page_id AS job_id, url AS from_url, target AS url, link_seq FROM hl UNION ALL SELECT page_id, url, url, 90 FROM pg
  UNION ALL SELECT page_id, url, {origin('url')} || {directory('url')} || 'deep/page.html', 91 FROM pg)"""
FT = f"""{TG}, ft AS (SELECT from_url, url, link_seq, CASE WHEN starts_with({path('url')}, {directory('from_url')}) AND {path('url')} <> {path('from_url')} THEN 'deeper' ELSE 'sideways' END AS relation FROM tg t
  WHERE {origin('url')} = {origin('from_url')} AND NOT regexp_matches(url, '(?i)(logout|log_out|signout|sign_out|delete|remove|unsubscribe|/edit\\b)')
  AND NOT regexp_matches({path('url')}, '(?i)\\.(pdf|pptx?|key|mp4|mov|webm|m4v|docx?|xlsx?|zip|tar|gz|txt|md|ipynb|py|java|go|c|h|cpp|rs|png|jpe?g|gif|svg)$')
  AND NOT EXISTS (SELECT 1 FROM pg p WHERE p.url = t.url AND ((p.visited AND p.snippet <> '') OR p.crawled_at > {NOW} - 86400)))"""
add("crawl_frontier", FT, "SELECT * FROM ft")
add("crawl_budget", FT, "SELECT from_url, url, turn FROM (SELECT *, row_number() OVER (PARTITION BY from_url ORDER BY relation <> 'deeper', link_seq, url) AS turn FROM ft) WHERE turn <= 3")
add("crawl_discover", TG, f"""SELECT url, {kind_of('url')} AS kind, CASE WHEN {origin('url')} = {origin('from_url')} AND starts_with(rtrim({path('url')}, '/') || '/', {directory('from_url')}) THEN {origin('from_url')} || {directory('from_url')} END AS place_scope
  FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY job_id, link_seq) AS r FROM tg t WHERE NOT EXISTS (SELECT 1 FROM pg p WHERE p.url = t.url)) WHERE r = 1""")
REPLY = f"""rp AS (SELECT page_id, url, title, headings, snippet, visited, CASE page_id % 9 WHEN 0 THEN 404 WHEN 1 THEN 0 ELSE 200 END AS status FROM pg)"""
add("crawl_fetch_join", f"{FT}, {REPLY}", "SELECT f.url, coalesce(r.status, 0) AS status, coalesce(r.page_id % 9 >= 4, FALSE) AS has_body FROM (SELECT DISTINCT url FROM ft) f LEFT JOIN rp r USING (url)")
add("crawl_record", f"{PG}, {REPLY}", """SELECT url, CASE WHEN page_id % 9 = 4 THEN 401 ELSE status END AS fetch_status, CASE WHEN page_id % 9 >= 5 THEN 'html' WHEN page_id % 9 = 2 THEN 'pdf' WHEN page_id % 9 = 3 THEN 'file' END AS kind,
  CASE WHEN page_id % 9 >= 5 AND NOT (visited AND snippet <> '') THEN title END AS title, CASE WHEN page_id % 9 >= 5 AND NOT (visited AND snippet <> '') THEN len(headings) ELSE 0 END AS n_headings FROM rp""")
add("crawl_run", FT, """SELECT url, CASE WHEN odd THEN 0 ELSE 200 END AS fetch_status, CASE WHEN NOT odd THEN split_part(url, '?', 1) END AS title
  FROM (SELECT DISTINCT url, regexp_extract(url, '([0-9])[^0-9]*$', 1) IN ('1', '3', '5', '7', '9') AS odd FROM
  (SELECT url, row_number() OVER (PARTITION BY from_url ORDER BY relation <> 'deeper', link_seq, url) AS turn FROM ft) WHERE turn <= 50)""")
_own = f"{HL}, tg AS (SELECT page_id AS job_id, url AS from_url, target AS url, min(link_seq) AS link_seq FROM hl WHERE page_id % 10 <> 0 AND target <> url GROUP BY ALL)"
add("crawl_counts", FT.replace(TG, _own), """SELECT (SELECT count(DISTINCT page_id) FROM hl) AS jobs, (SELECT count(DISTINCT page_id) FROM hl WHERE page_id % 10 = 0) AS failed,
  (SELECT count(DISTINCT url) FROM (SELECT url, row_number() OVER (PARTITION BY from_url ORDER BY relation <> 'deeper', link_seq, url) AS turn FROM ft) WHERE turn <= 50) AS fetched,
  (SELECT count(DISTINCT url) FROM tg WHERE url NOT IN (SELECT url FROM pg)) AS discovered""")
add("job_keys", EV, """SELECT event_id, CASE WHEN k % 4 = 0 THEN bare ELSE regexp_replace(bare, '\\}$', '') || CASE WHEN bare = '{}' THEN '' ELSE ',' END || '"_key":"' || key || '"}' END AS payload, CASE WHEN k % 4 <> 0 THEN key END AS key
  FROM (SELECT event_id, k, 'key' || (k % 20) AS key, CASE WHEN k % 3 = 0 THEN '{}' ELSE '{"url": "u' || k || '"}' END AS bare FROM ev WHERE event_type = 'error')""")
SQL["upsert_meta"] = """SELECT key, coalesce(n.value, o.value) AS value FROM (SELECT 'k' || page_id AS key, 'old' AS value FROM pages) o
  FULL JOIN (SELECT 'k' || page_id * 2 AS key, 'new' AS value FROM pages WHERE page_id % 3 = 0) n USING (key)"""
add("page_captures", V, """SELECT user_id, url, round(ts_s, 3) AS start_s, t.turn, t.after, t.text
  FROM (SELECT v.*, v.duration_s % 40 AS d, k FROM v JOIN ev USING (event_id)), (VALUES (0, 4.0::DOUBLE, 'first'), (1, 16.0::DOUBLE, 'second')) n(turn, after, said),
  LATERAL (SELECT n.turn, n.after, CASE WHEN n.turn = 0 AND k % 3 <> 0 THEN '' ELSE n.said END AS text) t WHERE d >= t.after AND (t.turn = 0 OR k % 3 <> 0)""".replace("v.*, v", "v.user_id, v.url, v.ts_s, v"))
SQL["robots_policy"] = f"""SELECT page_id, CASE WHEN status = 0 OR status >= 500 OR status IN (401, 403) THEN FALSE WHEN status >= 400 THEN TRUE ELSE NOT starts_with({path('url')}, '/private/') END AS allowed
  FROM (SELECT page_id, {pick('page_id % 7', '200', '401', '403', '404', '500', '503', '0')} AS status, 'https://h' || (page_id % 7) || '.example/' || CASE WHEN page_id % 2 = 0 THEN 'private/' ELSE 'open/' END || page_id AS url FROM pages)"""
SQL["stream_visits"] = SQL["sessionize"] + " WHERE (user_id, run) NOT IN (SELECT (user_id, max(run)) FROM g GROUP BY user_id)"
