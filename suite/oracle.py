"""The suite's questions in plain SQL."""

from __future__ import annotations

ACCESS = """
access AS (
  SELECT event_id AS id, user_id % 5 + 1 AS site_id,
    CAST(floor(epoch(ts)) AS BIGINT) AS timestamp,
    CASE user_id % 4 WHEN 0 THEN '203.0.113.' WHEN 1 THEN '10.0.0.' WHEN 2 THEN '9.9.9.'
      ELSE '192.168.1.' END || CAST(user_id % 250 AS VARCHAR) AS remote_addr,
    CASE WHEN event_id % 17 = 0 THEN 'HEAD' WHEN event_type IN ('signup','purchase') THEN 'POST'
      ELSE 'GET' END AS method,
    CASE WHEN event_type = 'click' AND event_id % 3 = 0
           THEN '/assets/app.js?v=' || json_extract_string(props,'$.k')
         WHEN event_type = 'view' THEN '/articles/' || json_extract_string(props,'$.k')
           || '?id=' || CAST(user_id AS VARCHAR)
         WHEN event_type = 'error' THEN '/missing/' || json_extract_string(props,'$.k') || '.php'
         WHEN event_type = 'click' THEN '/' ELSE '/api/' || event_type END AS uri,
    'HTTP/1.1' AS protocol,
    CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 404 ELSE 500 END
         WHEN event_type = 'click' AND event_id % 11 = 0 THEN 304 ELSE 200 END AS status,
    CAST(floor(value * 100) AS BIGINT) AS body_bytes, '-' AS referer,
    CASE user_id % 8
      WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/140.0 Safari/537.36 Edg/140.0'
      WHEN 1 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 18_0 like Mac OS X) Version/18.0 Mobile Safari/604.1'
      WHEN 2 THEN 'Mozilla/5.0 (Linux; Android 15) Chrome/140.0 Mobile Safari/537.36'
      WHEN 3 THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:140.0) Firefox/140.0'
      WHEN 4 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)'
      WHEN 5 THEN 'Mozilla/5.0 (compatible; GPTBot/1.2)'
      WHEN 6 THEN 'anthropic-ai'
      ELSE 'Mozilla/5.0 (Macintosh; Intel Mac OS X 15_0) Version/18.0 Safari/605.1' END AS user_agent
  FROM events)"""


def _when(column: str, rules: list[tuple[str, str]], otherwise: str) -> str:
    arms = " ".join(f"WHEN regexp_matches({column},'{p}','is') THEN '{n}'" for n, p in rules)
    return f"CASE {arms} ELSE {otherwise} END"


def agent_columns(column: str) -> str:
    spiders = [
        ("Baiduspider", "baiduspider"), ("Googlebot", "googlebot"), ("Bingbot", "bingbot|msnbot"),
        ("Sogou", "sogou[^\\n]*spider"), ("360Spider", "360spider|haosouspider"),
        ("Shenma", "yisouspider|sm\\.cn"), ("YandexBot", "yandexbot"),
        ("Bytespider", "bytespider"), ("AhrefsBot", "ahrefsbot"), ("SemrushBot", "semrushbot"),
        ("MJ12bot", "mj12bot"), ("DotBot", "dotbot"), ("PetalBot", "petalbot"),
        ("GPTBot", "gptbot|chatgpt-user"), ("ClaudeBot", "claudebot|anthropic-ai"),
        ("CommonCrawl", "ccbot|commoncrawl"), ("ArchiveBot", "ia_archiver|archive\\.org_bot"),
        ("OtherBot", "bot|spider|crawler|slurp"),
    ]
    browsers = [("Edge", "edg/"), ("Opera", "opr/|opera"), ("Chrome", "chrome/|crios/"),
                ("Firefox", "firefox/|fxios/"), ("Safari", "safari/")]
    systems = [("Windows", "windows"), ("Android", "android"), ("iOS", "iphone|ipad|ios"),
               ("macOS", "mac os|macintosh"), ("Linux", "linux")]
    devices = [("Bot", "bot|spider|crawler|slurp"), ("Tablet", "ipad|tablet"),
               ("Mobile", "mobile|iphone|android")]
    return (
        f"{_when(column, spiders, 'NULL')} AS spider, {_when(column, browsers, repr('Other'))} AS browser, "
        f"{_when(column, systems, repr('Other'))} AS system, {_when(column, devices, repr('Desktop'))} AS device"
    )


# File suffixes that never count as a page view.
STATIC = (
    "css", "js", "map", "jpg", "jpeg", "png", "gif", "webp", "svg", "ico",
    "woff", "woff2", "ttf", "eot", "mp3", "mp4", "avi", "mov",
    "zip", "gz", "rar", "7z", "pdf",
)
_STATIC = ", ".join(f"'{s}'" for s in STATIC)
PATH = "'^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1"
SUFFIX = "'(?:^|/)[^/]+\\.([^./]+)(?:/\\.?)*$', 1"

REQ = f"""
classed AS (
  SELECT *, coalesce(nullif(regexp_extract(uri, {PATH}), ''), '/') AS path,
    {agent_columns('user_agent')} FROM access),
req AS (
  SELECT *, regexp_extract(lower(path), {SUFFIX}) AS suffix,
    CAST(CASE WHEN method IN ('GET','HEAD') AND status >= 200 AND status < 400 AND spider IS NULL
      AND regexp_extract(lower(path), {SUFFIX}) NOT IN ({_STATIC}) THEN 1 ELSE 0 END AS BIGINT) AS pv,
    timestamp - timestamp % 60 AS minute_ts, timestamp - timestamp % 3600 AS hour_ts,
    strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d') AS day,
    status BETWEEN 400 AND 599 AS failed,
    sha256('pepper' || chr(0) || remote_addr || chr(0) || user_agent) AS visitor,
    sha256('pepper' || chr(0) || remote_addr) AS address
  FROM classed)"""

SPAN = """
span AS (SELECT CAST(min(timestamp) - min(timestamp) % 86400 AS BIGINT) AS lo,
    CAST(max(timestamp) - max(timestamp) % 86400 + 86400 AS BIGINT) AS hi FROM access),
halves AS (SELECT lo, hi, hi - ((hi - lo) // 86400 + 1) // 2 * 86400 AS mid,
    hi - 2 * (((hi - lo) // 86400 + 1) // 2 * 86400) AS early FROM span)"""

SITES = """
site AS (SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, CAST(n_regionkey + 1 AS BIGINT) AS panel_site_id,
    n_name AS name, '/logs/' || n_name || '.log' AS log_path FROM nation),
mapping AS (SELECT id AS site_id, min(id) OVER (PARTITION BY panel_site_id) AS canonical_id FROM site)"""

BASE = 9 * 2**24 + 9 * 2**16 + 9 * 2**8
NETS = f"""
net AS (
  SELECT {BASE} + n_nationkey * 8 AS a, {BASE} + n_nationkey * 8 + 7 AS b,
    r_name AS country, n_name AS region, n_name AS city
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT {BASE} + r_regionkey * 64, {BASE} + r_regionkey * 64 + 63, r_name, 'area', ''
  FROM region
  UNION ALL SELECT {9 * 2**24}, {10 * 2**24 - 1}, max(r_name), '', '' FROM region),
addr AS (SELECT DISTINCT remote_addr AS address FROM access),
num AS (SELECT address, CAST(split_part(address,'.',1) AS BIGINT) * 16777216
    + CAST(split_part(address,'.',2) AS BIGINT) * 65536 + CAST(split_part(address,'.',3) AS BIGINT) * 256
    + CAST(split_part(address,'.',4) AS BIGINT) AS n FROM addr),
hit AS (SELECT address, country, region, city,
    row_number() OVER (PARTITION BY address ORDER BY b - a) AS r
  FROM num JOIN net ON n BETWEEN a AND b
  WHERE address NOT LIKE '10.%' AND address NOT LIKE '192.168.%' AND address NOT LIKE '203.0.113.%'),
place AS (SELECT num.address,
    CASE WHEN num.address LIKE '9.%' THEN CASE
        WHEN hit.region IS NULL OR hit.region = '' THEN coalesce(hit.country, '未知')
        WHEN hit.region = 'area' THEN hit.country || ' · area'
        ELSE hit.country || ' · ' || hit.region END
      ELSE '内网地址' END AS location,
    coalesce(country,'') AS country, coalesce(region,'') AS region, coalesce(city,'') AS city
  FROM num LEFT JOIN hit ON hit.address = num.address AND r = 1)"""


def q(body: str, *ctes: str) -> str:
    return "WITH " + ",".join((ACCESS, REQ, *ctes)) + body


def total(*columns: str) -> str:
    return ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in columns)


METRIC = """
metric AS (SELECT site_id, minute_ts, count(*) AS requests, CAST(sum(pv) AS BIGINT) AS pv,
    CAST(sum(body_bytes) AS BIGINT) AS body_bytes, CAST(sum(CAST(failed AS INT)) AS BIGINT) AS errors,
    count(spider) AS bot_requests FROM req GROUP BY ALL)"""
SPIDER = """
spiders AS (SELECT site_id, minute_ts, spider, count(*) AS requests,
    CAST(sum(body_bytes) AS BIGINT) AS body_bytes, CAST(sum(CAST(failed AS INT)) AS BIGINT) AS errors
  FROM req WHERE spider IS NOT NULL GROUP BY ALL)"""
DIMS = """
wide AS (SELECT site_id, day, body_bytes, CAST(status >= 400 AS INT) AS bad, timestamp,
    remote_addr AS ip, path AS uri, browser, system, device FROM req),
long AS (SELECT site_id, day, body_bytes, bad, timestamp, 'ip' AS dimension, ip AS value FROM wide
  UNION ALL SELECT site_id, day, body_bytes, bad, timestamp, 'uri', uri FROM wide
  UNION ALL SELECT site_id, day, body_bytes, bad, timestamp, 'browser', browser FROM wide
  UNION ALL SELECT site_id, day, body_bytes, bad, timestamp, 'system', system FROM wide
  UNION ALL SELECT site_id, day, body_bytes, bad, timestamp, 'device', device FROM wide),
dims AS (SELECT site_id, day, dimension, value, count(*) AS requests,
    CAST(sum(body_bytes) AS BIGINT) AS body_bytes, CAST(sum(bad) AS BIGINT) AS errors,
    max(timestamp) AS last_seen FROM long GROUP BY ALL)"""
UNIQ = """
uniq AS (SELECT site_id, count(DISTINCT visitor) AS uv, count(DISTINCT address) AS ip FROM req GROUP BY 1)"""
SUMS = "requests, pv, body_bytes, errors, bot_requests"
SUMMARY = """
sums AS (SELECT site_id, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(pv) AS BIGINT) AS pv,
    CAST(sum(body_bytes) AS BIGINT) AS body_bytes, CAST(sum(errors) AS BIGINT) AS errors,
    CAST(sum(bot_requests) AS BIGINT) AS bot_requests, max(minute_ts) AS last_seen,
    arg_max(body_bytes, minute_ts) AS realtime_bytes, arg_max(requests, minute_ts) AS last_requests
  FROM metric GROUP BY 1),
summary AS (SELECT id AS site_id, coalesce(requests,0) AS requests, coalesce(pv,0) AS pv,
    coalesce(body_bytes,0) AS body_bytes, coalesce(errors,0) AS errors,
    coalesce(bot_requests,0) AS bot_requests, coalesce(uv,0) AS uv, coalesce(ip,0) AS ip,
    coalesce(realtime_bytes,0) AS realtime_bytes,
    round_even(coalesce(last_requests,0) / CAST(60 AS DOUBLE), 2) AS qps,
    coalesce(last_seen,0) AS last_seen,
    CASE WHEN requests > 0 THEN round_even(errors * CAST(100 AS DOUBLE) / requests, 2)
      ELSE CAST(0 AS DOUBLE) END AS error_rate
  FROM site LEFT JOIN sums ON sums.site_id = id LEFT JOIN uniq ON uniq.site_id = id)"""


def _trend(width: int) -> str:
    return q(f"""
, spine AS (SELECT id AS site_id, unnest(generate_series(lo, hi - 1, {width})) AS timestamp FROM site, span),
b AS (SELECT site_id, timestamp - timestamp % {width} AS timestamp, count(*) AS requests,
    CAST(sum(pv) AS BIGINT) AS pv, CAST(sum(body_bytes) AS BIGINT) AS body_bytes,
    CAST(sum(CAST(failed AS INT)) AS BIGINT) AS errors, count(spider) AS bot_requests,
    count(DISTINCT visitor) AS uv, count(DISTINCT address) AS ip FROM req GROUP BY 1, 2)
SELECT spine.site_id, spine.timestamp, coalesce(requests,0) AS requests, coalesce(pv,0) AS pv,
  coalesce(body_bytes,0) AS body_bytes, coalesce(errors,0) AS errors,
  coalesce(bot_requests,0) AS bot_requests, coalesce(uv,0) AS uv, coalesce(ip,0) AS ip
FROM spine LEFT JOIN b USING (site_id, timestamp)""", SPAN, SITES)


RANKING = """
ranking AS (SELECT site_id, spider, count(*) AS requests, CAST(sum(body_bytes) AS BIGINT) AS body_bytes,
    CAST(sum(CAST(failed AS INT)) AS BIGINT) AS errors, max(minute_ts) AS last_seen
  FROM req WHERE spider IS NOT NULL GROUP BY 1, 2)"""


def _rank(kind: str, extra: str = "", join: str = "", *ctes: str) -> str:
    return q(f"""
, t AS (SELECT site_id, value AS name, {total('requests', 'body_bytes', 'errors')}, max(last_seen) AS last_seen
  FROM dims WHERE dimension = '{kind}' GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY requests DESC, name) AS r FROM t)
SELECT site_id, name, requests, body_bytes, errors, last_seen,
  round_even(errors * CAST(100 AS DOUBLE) / requests, 2) AS error_rate{extra}
FROM n {join} WHERE r <= 100""", DIMS, *ctes)


CLIENTS = """
c AS (SELECT site_id, dimension, value AS name, CAST(sum(requests) AS BIGINT) AS requests,
    CAST(sum(body_bytes) AS BIGINT) AS body_bytes
  FROM dims WHERE dimension IN ('browser','system','device') GROUP BY 1, 2, 3),
clients AS (SELECT *, requests * CAST(100 AS DOUBLE)
    / CAST(sum(requests) OVER (PARTITION BY site_id, dimension) AS DOUBLE) AS share FROM c)"""

DETAIL = ("id, site_id, timestamp, remote_addr, method, path AS uri, status, body_bytes, browser, "
          "system, device, coalesce(spider,'') AS spider")

COMPARED = """
spine AS (SELECT id AS site_id, unnest(generate_series(mid, hi - 1, 3600)) AS timestamp, mid, early FROM site, halves),
h AS (SELECT site_id, timestamp - timestamp % 3600 AS t, count(*) AS n FROM req GROUP BY 1, 2),
cmp AS (SELECT s.site_id, CAST((s.timestamp - s.mid) // 3600 AS BIGINT) AS position, s.timestamp,
    coalesce(a.n, 0) AS current, coalesce(b.n, 0) AS previous
  FROM spine s LEFT JOIN h a ON a.site_id = s.site_id AND a.t = s.timestamp
  LEFT JOIN h b ON b.site_id = s.site_id AND b.t = s.timestamp - s.mid + s.early)"""


def _change(current: str, previous: str) -> str:
    return (f"CASE WHEN {previous} > 0 THEN (CAST({current} AS DOUBLE) - CAST({previous} AS DOUBLE))"
            f" / CAST({previous} AS DOUBLE) * 100 END AS change_pct")


def _compare() -> str:
    part = lambda name, lo, hi: f"""
{name}_m AS (SELECT m.* FROM metric m, halves WHERE minute_ts >= {lo} AND minute_ts < {hi}),
{name}_s AS (SELECT site_id, CAST(sum(requests) AS DOUBLE) AS requests, CAST(sum(pv) AS DOUBLE) AS pv,
    CAST(sum(body_bytes) AS DOUBLE) AS body_bytes, CAST(sum(errors) AS DOUBLE) AS errors,
    CAST(sum(bot_requests) AS DOUBLE) AS bot_requests,
    CAST(arg_max(body_bytes, minute_ts) AS DOUBLE) AS realtime_bytes,
    round_even(arg_max(requests, minute_ts) / CAST(60 AS DOUBLE), 2) AS qps FROM {name}_m GROUP BY 1),
{name}_u AS (SELECT site_id, CAST(count(DISTINCT visitor) AS DOUBLE) AS uv,
    CAST(count(DISTINCT address) AS DOUBLE) AS ip FROM req, halves
  WHERE hour_ts >= {lo} AND hour_ts < {hi} GROUP BY 1),
{name} AS (SELECT * FROM {name}_s FULL JOIN {name}_u USING (site_id))"""  # noqa: E731
    metrics = "pv uv ip requests body_bytes errors bot_requests realtime_bytes qps".split()
    rows = " UNION ALL ".join(
        f"SELECT id AS site_id, '{m}' AS metric, coalesce(c.{m}, 0) AS current, coalesce(p.{m}, 0) AS previous "
        "FROM site LEFT JOIN cur c ON c.site_id = id LEFT JOIN prev p ON p.site_id = id"
        for m in metrics
    )
    return q(f", {part('cur', 'mid', 'hi')}, {part('prev', 'early', 'mid')}, r AS ({rows}) "
             f"SELECT *, {_change('current', 'previous')} FROM r", METRIC, SPAN, SITES)


def _hll(source: str, key: str) -> str:
    return f"""
bits AS (SELECT DISTINCT {key}, md5(value) AS h FROM ({source})),
parts AS (SELECT {key}, CAST('0x' || substr(h,1,3) AS BIGINT) AS x, CAST('0x' || substr(h,4,13) AS BIGINT) AS y FROM bits),
ranks AS (SELECT {key}, x // 4 AS idx, (x % 4) * 4503599627370496 + y AS rem FROM parts),
regs AS (SELECT {key}, idx, max(55 - CASE WHEN rem = 0 THEN 0 ELSE length(ltrim(bin(rem),'0')) END) AS rank
  FROM ranks GROUP BY 1, 2),
f AS (SELECT {key}, count(*) AS registers, sum(pow(CAST(2 AS DOUBLE), -rank)) AS hs FROM regs GROUP BY 1),
e AS (SELECT *, (0.7213::DOUBLE / (1 + 1.079::DOUBLE / 1024)) * 1024 * 1024 / (hs + 1024 - registers) AS raw FROM f)
SELECT {key}, registers, CAST(round(CASE WHEN raw <= 2560 AND registers < 1024
  THEN 1024 * ln(CAST(1024 AS DOUBLE) / (1024 - registers)) ELSE raw END) AS BIGINT) AS estimate FROM e"""


def _max_merge(source: str, keys: str, measures: list[str]) -> str:
    picked = ", ".join(f"max({m}) AS {m}" for m in measures)
    rest = "".join(f", {k}" for k in keys.split(", ")[1:])
    return (f" SELECT canonical_id AS site_id{rest}, {picked} FROM {source} JOIN mapping USING (site_id)"
            f" GROUP BY canonical_id{rest}")


LEGACY = """
lv AS (SELECT site_id, day, visitor, min(minute_ts) AS m FROM req GROUP BY 1, 2, 3),
la AS (SELECT site_id, day, address, min(minute_ts) AS m FROM req GROUP BY 1, 2, 3)"""

EXPORT = ("strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:%M:%S') AS time, remote_addr AS ip, "
          "method, path AS uri, CAST(status AS VARCHAR) AS status, CAST(body_bytes AS VARCHAR) AS bytes, "
          "browser, system, device, coalesce(spider,'') AS spider")

ORACLE: dict[str, str] = {
    "q00_classified_requests": q(
        " SELECT id, path, suffix, spider, browser, system, device, pv, minute_ts, hour_ts, day, failed,"
        " starts_with(path, '/api/signup') AS excluded FROM req"),
    "q00_agents_in_text": f"SELECT spider, browser, system, device, count(*) AS documents "
                          f"FROM (SELECT {agent_columns('text')} FROM documents) GROUP BY ALL",
    "q00_visitor_hashes": q(" SELECT id, visitor, address FROM req"),
    "q01_minute_metrics": q(" SELECT * FROM metric", METRIC),
    "q02_spider_minute": q(" SELECT * FROM spiders", SPIDER),
    "q03_dimension_day": q(" SELECT * FROM dims", DIMS),
    "q03_dimensions_from_cube": q(
        " SELECT * FROM dims WHERE dimension IN ('browser','system','device')", DIMS),
    "q03_additive_upsert": q(" SELECT * FROM metric", METRIC),
    "q04_overview": q(f" SELECT site_id, {SUMS}, uv, ip, realtime_bytes, qps FROM summary",
                      METRIC, UNIQ, SITES, SUMMARY),
    "q05_trend_dense": _trend(3600),
    "q05_trend_daily": _trend(86400),
    "q05_trend_series": q("""
, spine AS (SELECT id AS site_id, unnest(generate_series(lo, hi - 1, 86400)) AS timestamp FROM site, span),
b AS (SELECT site_id, timestamp - timestamp % 86400 AS timestamp, count(*) AS requests,
    CAST(sum(body_bytes) AS BIGINT) AS body_bytes FROM req GROUP BY 1, 2)
SELECT spine.site_id, spine.timestamp, coalesce(requests,0) AS requests, coalesce(body_bytes,0) AS body_bytes,
  coalesce(requests,0) / CAST(86400 AS DOUBLE) AS qps, coalesce(body_bytes,0) AS realtime_bytes
FROM spine LEFT JOIN b USING (site_id, timestamp)""", SPAN, SITES),
    "q06_spider_report": q("""
 SELECT *, requests * CAST(100 AS DOUBLE) / CAST(sum(requests) OVER (PARTITION BY site_id) AS DOUBLE) AS share,
  round_even(errors * CAST(100 AS DOUBLE) / requests, 2) AS error_rate FROM ranking""", RANKING),
    "q06_spider_summary": q(f"""
, s AS (SELECT site_id, {total('requests', 'body_bytes', 'errors')}, count(*) AS types FROM ranking GROUP BY 1)
SELECT id AS site_id, coalesce(requests,0) AS requests, coalesce(types,0) AS types,
  coalesce(body_bytes,0) AS body_bytes, coalesce(errors,0) AS errors,
  CASE WHEN requests > 0 THEN round_even(errors * CAST(100 AS DOUBLE) / requests, 2)
    ELSE CAST(0 AS DOUBLE) END AS error_rate
FROM site LEFT JOIN s ON site_id = id""", RANKING, SITES),
    "q06_spider_trend": q("""
, spine AS (SELECT id AS site_id, unnest(generate_series(lo, hi - 1, 86400)) AS timestamp FROM site, span),
b AS (SELECT site_id, timestamp - timestamp % 86400 AS timestamp, count(*) AS n
  FROM req WHERE spider IS NOT NULL GROUP BY 1, 2)
SELECT spine.site_id, spine.timestamp, coalesce(n,0) AS requests
FROM spine LEFT JOIN b USING (site_id, timestamp)""", SPAN, SITES),
    "q06_spider_slices": q("""
, o AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY requests DESC, spider) AS r FROM ranking)
SELECT site_id, CASE WHEN r <= 1 THEN spider ELSE '(other)' END AS spider,
  CAST(least(r, 2) AS INTEGER) AS position, CAST(sum(requests) AS BIGINT) AS requests
FROM o GROUP BY 1, 2, 3""", RANKING),
    "q07_rank_uri": _rank("uri"),
    "q08_rank_ip": _rank("ip", ", location, country, region, city", "JOIN place ON address = name", NETS),
    "q09_clients": q(" SELECT * FROM clients", DIMS, CLIENTS),
    "q09_top_clients": q("""
 SELECT *, CAST(row_number() OVER (PARTITION BY site_id, dimension ORDER BY requests DESC, name) AS INTEGER)
  AS position FROM clients QUALIFY position <= 2""", DIMS, CLIENTS),
    "q10_request_search": q(f"""
 SELECT {DETAIL}, CASE WHEN remote_addr LIKE '9.%' THEN '未知' ELSE '内网地址' END AS location FROM req
WHERE path ILIKE '%ARTICLES/1%' OR remote_addr ILIKE '%ARTICLES/1%' OR user_agent ILIKE '%ARTICLES/1%'
ORDER BY timestamp DESC, id LIMIT 200"""),
    "q10_error_page": q(f"""
, d AS (SELECT {DETAIL} FROM req WHERE status >= 400 ORDER BY timestamp DESC, id LIMIT 100 OFFSET 200)
SELECT d.*, location, country FROM d JOIN place ON address = remote_addr""", NETS),
    "q10_deep_page": q(f" SELECT {DETAIL} FROM req ORDER BY timestamp DESC, id LIMIT 200 OFFSET 4321"),
    "q10_search_counts": q("""
 SELECT 'all' AS filter, count(*) AS total FROM req
UNION ALL SELECT 'errors', count(*) FROM req WHERE status >= 400
UNION ALL SELECT '4xx', count(*) FROM req WHERE status >= 400 AND status < 500
UNION ALL SELECT '5xx', count(*) FROM req WHERE status >= 500
UNION ALL SELECT 'wildcard', count(*) FROM req WHERE path ILIKE '%art_cles/\\%7%' ESCAPE '~'
  OR path ILIKE '%art_cles/%7%'"""),
    "q11_site_summary": q(" SELECT * FROM summary", METRIC, UNIQ, SITES, SUMMARY),
    "q11_site_list": q(" SELECT id AS site_id, name, requests, pv, uv, ip, errors FROM summary"
                       " JOIN site ON site_id = id WHERE contains(lower(name), 'nation_1')",
                       METRIC, UNIQ, SITES, SUMMARY),
    "q11_sites_with_statistics": q(
        " SELECT id, name, CAST(id IN (SELECT site_id FROM req) AS BIGINT) AS has_statistics FROM site", SITES),
    "q12_period_compare": _compare(),
    "q12_trend_compare": q(f" SELECT *, {_change('current', 'previous')} FROM cmp", SPAN, SITES, COMPARED),
    "q12_trend_summary": q(f"""
, t AS (SELECT site_id, CAST(sum(current) AS BIGINT) AS total, avg(current) AS average, max(current) AS peak,
    arg_max(timestamp, current * 1000000 - position) AS peak_time,
    CAST(sum(previous) AS BIGINT) AS previous_total FROM cmp GROUP BY 1)
SELECT *, {_change('total', 'previous_total')} FROM t""", SPAN, SITES, COMPARED),
    "q13_parse_roundtrip": q(
        " SELECT id, site_id, timestamp, remote_addr, method, uri, protocol, status, body_bytes, referer,"
        " user_agent FROM req"),
    "q13_parse_accounting": q("""
, j AS (SELECT site_id, id % 13 <> 0 AND NOT starts_with(path, '/api/signup') AND timestamp >= mid AS ok
  FROM req, halves)
SELECT site_id, count(*) AS lines, count(*) FILTER (ok) AS events, count(*) FILTER (NOT ok) AS rejected
FROM j GROUP BY 1""", SPAN),
    "q13_parse_document_lines": """
WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS value FROM documents)
SELECT source, count(*) AS lines, count(*) FILTER (ok) AS events, count(*) FILTER (NOT ok) AS rejected FROM (
  SELECT source, regexp_matches(value,
    '^\\s*\\S+\\s+\\S+\\s+\\S+\\s+\\[[^\\]]+\\]\\s+"(?:\\\\.|[^"\\\\])*"\\s+\\d{3}\\s+(?:\\d+|-)') AS ok FROM l)
GROUP BY 1""",
    "q14_hll_relational": q("," + _hll(
        "SELECT site_id, remote_addr || '|' || user_agent AS value FROM req", "site_id")),
    "q14_hll_words": "WITH " + _hll(
        "SELECT lang, unnest(string_split(text, ' ')) AS value FROM documents", "lang"),
    "q15_hll_sketch": q(" SELECT site_id, uv, ip, true AS uv_near, true AS ip_near FROM uniq", UNIQ),
    "q15_exact_daily_uniques": q(
        " SELECT site_id, day, count(DISTINCT visitor) AS uv, count(DISTINCT address) AS ip"
        " FROM req GROUP BY 1, 2"),
    "q16_geo_range_join": q(" SELECT * FROM place", NETS),
    "q17_retention": q("""
 SELECT id, site_id, timestamp, status FROM req, span
WHERE (status < 400 AND timestamp >= hi - 7 * 86400) OR (status >= 400 AND timestamp >= hi - 30 * 86400)""", SPAN),
    "q17_retention_days": q("""
 SELECT dims.* FROM dims, halves WHERE day >= strftime(make_timestamp(mid * 1000000), '%Y-%m-%d')""",
                            DIMS, SPAN),
    "q17_detail_keep": q(f"""
 SELECT {DETAIL} FROM req, halves WHERE timestamp >= mid OR (failed AND timestamp >= lo + 86400)""", SPAN),
    "q18_site_merge": q(_max_merge("metric", "site_id, minute_ts", SUMS.split(", ")), METRIC, SITES),
    "q18_site_merge_spiders": q(
        _max_merge("spiders", "site_id, minute_ts, spider", ["requests", "body_bytes", "errors"]),
        SPIDER, SITES),
    "q18_site_merge_dimensions": q(
        _max_merge("dims", "site_id, day, dimension, value",
                   ["requests", "body_bytes", "errors", "last_seen"]), DIMS, SITES),
    "q18_site_merge_details": q(
        " SELECT r.id, canonical_id AS site_id, timestamp FROM req r JOIN mapping USING (site_id)", SITES),
    "q18_site_merge_sketches": q("""
 SELECT canonical_id AS site_id, count(DISTINCT visitor) AS uv, count(DISTINCT address) AS ip,
  true AS uv_near, true AS ip_near FROM req JOIN mapping USING (site_id) GROUP BY 1""", SITES),
    "q18_site_merge_exact": q("""

, v AS (SELECT site_id, day, 'uv' AS kind, visitor AS value, m FROM lv
  UNION ALL SELECT site_id, day, 'ip', address, m FROM la),
w AS (SELECT canonical_id, v.* FROM v JOIN mapping USING (site_id))
SELECT canonical_id AS site_id, day, kind, value, arg_min(m, w.site_id) AS first_minute
FROM w GROUP BY canonical_id, day, kind, value""", LEGACY, SITES),
    "q19_migrate_exact": q("""
, v AS (SELECT site_id, m - m % 3600 AS hour_ts, 'uv' AS kind, visitor AS value FROM lv
  UNION ALL SELECT site_id, m - m % 3600, 'ip', address FROM la)
SELECT site_id, hour_ts, kind, count(DISTINCT value) AS n, true AS near FROM v GROUP BY 1, 2, 3""", LEGACY),
    "q19_rebuild_dimensions": q(" SELECT * FROM dims", DIMS),
    "q20_client_ip": q("""
, t AS (SELECT id, remote_addr, remote_addr LIKE '10.%' OR remote_addr LIKE '192.168.%' AS trusted FROM req)
SELECT id, trusted, CASE WHEN NOT trusted THEN remote_addr
  WHEN id % 7 = 0 THEN '9.8.7.' || (id % 200) WHEN id % 5 = 0 THEN '10.1.1.1'
  WHEN id % 5 = 1 THEN remote_addr ELSE '198.51.100.' || (id % 200) END AS client FROM t"""),
    "q20_address_class": """
WITH n AS (SELECT o_orderkey, CAST((CAST(o_orderkey AS HUGEINT) * 2654435761) % 4294967296 AS BIGINT) AS n FROM orders),
a AS (SELECT *, n // 16777216 AS a, n // 65536 % 256 AS b, n // 256 % 256 AS c, n % 256 AS d FROM n)
SELECT o_orderkey, a || '.' || b || '.' || c || '.' || d AS address,
  CASE WHEN a = 127 THEN 'loopback'
    WHEN n IN (3221225481, 3221225482) THEN 'public'
    WHEN a IN (0, 10) OR a >= 240 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
      OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19))
      OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) THEN 'private'
    WHEN a BETWEEN 224 AND 239 THEN 'reserved' ELSE 'public' END AS class FROM a""",
    "q21_url_path": f"""
WITH p AS (SELECT page_id, coalesce(nullif(regexp_extract(url, {PATH}), ''), '/') AS path FROM pages)
SELECT *, regexp_extract(lower(path), {SUFFIX}) AS suffix FROM p""",
    "q22_csv_guard": """
WITH m AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@'
  WHEN 4 THEN '' ELSE 'a=' END || text AS text FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS doc_id,
  CASE WHEN substr(text,1,1) IN ('=','+','-','@') THEN '''' || text ELSE text END AS text FROM m""",
    "q22_request_export": q(f" SELECT {EXPORT} FROM req"),
    "q22_csv_written": q(f" SELECT {EXPORT} FROM req"),
    "q23_stream_equals_batch": q(" SELECT * FROM metric", METRIC),
    "q24_parse_messages": q("""
 SELECT id, site_id AS panel_site_id, timestamp, CASE WHEN remote_addr LIKE '10.%' OR remote_addr LIKE '192.168.%'
  THEN '198.51.100.' || (id % 200) ELSE remote_addr END AS remote_addr,
  method, uri, protocol, status, body_bytes, referer, user_agent FROM req"""),
    "q25_route_messages": q("""
, v AS (SELECT CASE WHEN name = 'NATION_4' THEN 0 ELSE site_id END AS site_id,
    CASE WHEN name = 'NATION_4' OR starts_with(path, '/api/signup') THEN 'rejected'
      WHEN name = 'NATION_2' THEN 'deferred' ELSE 'accepted' END AS verdict
  FROM req LEFT JOIN site ON site.id = site_id)
SELECT site_id, verdict, count(*) AS messages FROM v GROUP BY 1, 2""", SITES),
    "q26_store_history": q(" SELECT * FROM dims", DIMS),
    "q28_register_sites": "WITH " + SITES + """
, can AS (SELECT DISTINCT canonical_id FROM mapping)
SELECT id, panel_site_id, r_name AS name, '/logs/' || r_name || '.log' AS log_path, 'apache' AS web_server,
  true AS enabled FROM site JOIN can ON id = canonical_id JOIN region ON panel_site_id = r_regionkey + 1
UNION ALL SELECT (SELECT max(id) FROM site) + row_number() OVER (ORDER BY r_regionkey), r_regionkey + 101,
  'NEW ' || r_name, '/logs/NEW ' || r_name || '.log', 'apache', true FROM region""",
    "q28_register_merges": "WITH " + SITES + " SELECT * FROM mapping WHERE site_id <> canonical_id",
    "q28_retain_sites": "WITH " + SITES + " SELECT id, name, panel_site_id <> 2 AS enabled FROM site",
    "q28_list_sites": q("""
, c AS (SELECT site_id, count(*) AS n FROM req GROUP BY 1)
SELECT id, name, coalesce(n,0) AS lines, coalesce(n,0) AS events, CAST(0 AS BIGINT) AS rejected
FROM site LEFT JOIN c ON site_id = id""", SITES),
    "q29_byte_sizes": """
WITH b AS (SELECT o_orderkey, CAST(floor(o_totalprice * o_custkey) AS DOUBLE) AS n FROM orders),
u AS (SELECT o_orderkey, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2
    WHEN n < 1099511627776 THEN 3 ELSE 4 END AS p, n FROM b),
v AS (SELECT *, n / pow(CAST(1024 AS DOUBLE), p) AS x FROM u)
SELECT o_orderkey, CASE WHEN p = 0 OR x >= 100 THEN format('{:.0f}', floor(x + 0.5::DOUBLE))
  ELSE format('{:.2f}', floor(x * 100 + 0.5::DOUBLE) / 100) END || ' '
  || ['B', 'KB', 'MB', 'GB', 'TB'][p + 1] AS size FROM v""",
}

ORACLE["q30_rotated_files"] = ORACLE["q01_minute_metrics"]
ORACLE["q31_unknown_files"] = f"""WITH {ACCESS}
SELECT CASE WHEN site_id = 5 THEN 0 ELSE site_id END AS site_id, count(*) AS lines,
  count(*) FILTER (WHERE site_id <> 5) AS events, count(*) FILTER (WHERE site_id = 5) AS rejected
FROM access GROUP BY 1"""
ORACLE["q32_long_targets"] = """
WITH long AS (SELECT '/' || regexp_replace(text, '[^A-Za-z]', '', 'g') AS value
  FROM documents JOIN events ON event_id = doc_id)
SELECT md5(value) AS target, length(value) AS length, count(*) AS requests FROM long GROUP BY 1, 2"""


def _near(name: str) -> str:
    """The exact query with its distinct counts replaced by flags."""
    return f"SELECT * EXCLUDE (uv, ip), TRUE AS uv_near, TRUE AS ip_near FROM ({ORACLE[name]})"


ORACLE["q33_stored_overview"] = _near("q04_overview")
ORACLE["q33_stored_summaries"] = _near("q11_site_summary")
ORACLE["q33_stored_trend"] = _near("q05_trend_dense")
ORACLE["q33_dashboard_summary"] = f"SELECT * FROM ({ORACLE['q12_trend_summary']}) WHERE site_id = 1"


# the arms of the agents, as in ACCESS
_AGENT_ARMS = ACCESS[ACCESS.index("CASE user_id % 8") + 16 : ACCESS.index("\n  FROM events")]
VISITS = f"""
access AS (
  SELECT page_id AS id, page_id % 5 + 1 AS site_id, 1788220800 + page_id * 7919 % 1728000 AS timestamp,
    '203.0.113.' || CAST(page_id * 31 % 250 AS VARCHAR) AS remote_addr,
    CASE WHEN page_id % 17 = 0 THEN 'HEAD' ELSE 'GET' END AS method,
    regexp_replace(url, '^[a-z]+://[^/]*', '') AS uri, 'HTTP/1.1' AS protocol,
    CASE WHEN page_id % 13 = 0 THEN 404 WHEN page_id % 29 = 0 THEN 500 ELSE 200 END AS status,
    page_id * 97 % 5000 AS body_bytes, '-' AS referer,
    CASE page_id % 8{_AGENT_ARMS}
  FROM pages)"""


def of_visits(name: str) -> str:
    """A query's SQL with the requests of ``pages`` instead of those of ``events``."""
    return ORACLE[name].replace(ACCESS, VISITS)


ORACLE["q34_rotation_inside_load"] = ORACLE["q35_followed_logs"] = of_visits("q01_minute_metrics")
ORACLE["q34_repeated_progress"] = f"""WITH {VISITS}
SELECT CASE WHEN site_id = 5 THEN 0 ELSE site_id END AS site_id, count(*) AS lines, count(*) FILTER (WHERE site_id <> 5) AS events,
  count(*) FILTER (WHERE site_id = 5) AS rejected, false AS registered FROM access GROUP BY 1
UNION ALL SELECT site_id, count(*), count(*), CAST(0 AS BIGINT), true FROM access GROUP BY 1"""
ORACLE["q36_sites_merged_in_store"] = f"""
WITH metric AS ({of_visits("q01_minute_metrics")}),
moved AS (SELECT CASE WHEN site_id IN (4, 5) THEN 1 ELSE site_id END AS to_site, * FROM metric WHERE site_id <> 2)
SELECT to_site AS site_id, minute_ts, max(requests) AS requests, max(pv) AS pv, max(body_bytes) AS body_bytes, max(errors) AS errors,
  max(bot_requests) AS bot_requests FROM moved GROUP BY 1, 2"""
ORACLE["q36_details_after_merge"] = f"""WITH {VISITS}
SELECT CASE WHEN site_id IN (4, 5) THEN 1 ELSE site_id END AS site_id, status, count(*) AS requests, CAST(sum(body_bytes) AS BIGINT) AS body_bytes
FROM access GROUP BY 1, 2"""
ORACLE["q37_live_counters"] = f"""WITH {VISITS},
v AS (SELECT CASE WHEN site_id = 5 THEN 0 ELSE site_id END AS site_id, site_id < 4 AS taken FROM access)
SELECT site_id, count(*) AS lines, count(*) FILTER (WHERE taken) AS events, count(*) FILTER (WHERE site_id = 0) AS rejected,
  count(*) AS live_lines, count(*) FILTER (WHERE taken) AS live_events, count(*) FILTER (WHERE site_id = 0) AS live_rejected,
  count(*) FILTER (WHERE site_id = 4) AS live_deferred FROM v GROUP BY 1"""
ORACLE["q37_stream_days"] = of_visits("q03_dimension_day")
ORACLE["q37_stream_crawlers"] = of_visits("q02_spider_minute")
ORACLE["q37_stream_details"] = q(
    " SELECT site_id, timestamp, remote_addr, method, path AS uri, status, body_bytes, browser, system, device FROM req").replace(ACCESS, VISITS)
ORACLE["q38_start_at_end"] = ORACLE["q34_rotation_inside_load"].replace("FROM pages)", "FROM pages WHERE page_id % 2 = 1)")
ORACLE["q38_history_files"] = f"""WITH {VISITS}
SELECT remote_addr, status, count(*) AS requests, CAST(sum(body_bytes) AS BIGINT) AS body_bytes FROM access WHERE site_id = 3 GROUP BY 1, 2"""
ORACLE["q38_escaped_lines"] = f"""WITH {VISITS}
SELECT id, timestamp, CASE WHEN id % 3 = 0 THEN '' ELSE method END AS method, uri, CASE WHEN id % 3 = 2 THEN 'HTTP/2.0' ELSE '' END AS protocol,
  CAST(0 AS BIGINT) AS body_bytes, 'a"' || id || chr(92) || 'n "b' AS referer, 'a"' || id || chr(92) || 'n "b' AS user_agent FROM access"""
_HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"
ORACLE["q38_registered_sites"] = f"""
SELECT page_id - 1 AS panel_site_id, {_HOST} AS name, '/www' AS document_root,
  CASE WHEN page_id % 5 = 0 THEN '/own/access.log' WHEN page_id % 2 = 0 THEN '/logs/' || {_HOST} || '-access_log' ELSE '/logs/' || {_HOST} || '.log' END AS log_path,
  CASE WHEN page_id % 2 = 0 THEN 'apache' ELSE 'nginx' END AS web_server
FROM pages WHERE page_id > 1 AND page_id % 7 > 0"""
ORACLE["q38_orphan_logs"] = f"""
WITH files AS (SELECT DISTINCT '/logs/' || {_HOST} || '.log' AS log_path FROM pages WHERE page_id % 3 = 1),
known AS (SELECT DISTINCT '/logs/' || {_HOST} || '.log' AS log_path FROM pages WHERE page_id % 4 = 0),
loose AS (SELECT log_path FROM files WHERE log_path NOT IN (SELECT log_path FROM known))
SELECT -row_number() OVER (ORDER BY log_path) AS panel_site_id, replace(replace(log_path, '/logs/', ''), '.log', '') AS name,
  '' AS document_root, log_path, 'nginx' AS web_server FROM loose"""
_V6 = """forms AS (SELECT page_id AS id, page_id % 7 AS form, page_id % 65535 + 1 AS n, page_id % 250 AS quad FROM pages),
told AS (SELECT id, form, CASE form WHEN 0 THEN '2001:db8::' || format('{:x}', n) WHEN 1 THEN '2600:1f18::' || format('{:x}', n)
  WHEN 2 THEN '::ffff:203.0.113.' || quad WHEN 3 THEN 'fe80::' || format('{:x}', n) || '%eth0'
  WHEN 4 THEN '2a00:1450:4001::' || format('{:x}', n) || ':0:0' WHEN 5 THEN 'ff02::' || format('{:x}', n) END AS address FROM forms)"""
ORACLE["q39_v6_addresses"] = f"""WITH {_V6}
SELECT id, address, CASE form WHEN 0 THEN 'private' WHEN 1 THEN 'public' WHEN 2 THEN 'private' WHEN 3 THEN 'private' WHEN 4 THEN 'public'
  WHEN 5 THEN 'reserved' ELSE 'invalid' END AS class, form IN (0, 3) AS inside FROM told"""
# a forwarded address inside the trusted network is a proxy itself, a malformed one is passed over: both leave the outermost address of the chain
ORACLE["q39_v6_messages"] = f"""WITH {_V6} SELECT id, coalesce(address, '10.0.0.7') AS remote_addr FROM told"""
ORACLE["q39_named_periods"] = f"""WITH {VISITS},
named(period, low, high) AS (VALUES ('today', 1789401600, 1789444801), ('yesterday', 1789315200, 1789401601),
  ('7d', 1788883200, 1789444801), ('30d', 1786896000, 1789444801))
SELECT site_id, count(*) AS requests, period FROM access JOIN named ON timestamp >= low AND timestamp < high GROUP BY site_id, period"""
ORACLE["q39_report_top"] = q(
    " SELECT path AS name, count(*) AS requests FROM req WHERE site_id = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10").replace(ACCESS, VISITS)
ORACLE["q39_switched_off"] = f"SELECT id, name FROM ({ORACLE['q28_register_sites']}) WHERE id <> 1"
