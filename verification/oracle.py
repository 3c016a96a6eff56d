"""The registered queries as SQL for a second engine, written apart from the Spark expressions."""

from __future__ import annotations

from hostledger.functions import tables

# Country codes that are no language codes and occur as path segments of the derived URLs.
COUNTRY_SEGMENTS = ["gb"]

RFC3986 = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
BAD_ESCAPE = r"%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)"


def text_list(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def any_of(column: str, values, test: str) -> str:
    return "(" + " OR ".join(test.format(c=column, v=v, n=len(v)) for v in values) + ")"


# ---- derived tables ----------------------------------------------------------------------------

TARGETS = """
    SELECT page_id AS pos, url AS raw_url FROM pages
    UNION ALL SELECT page_id + 1000000, regexp_replace(url, '^https?://', '') FROM pages WHERE page_id % 5 = 0
    UNION ALL SELECT page_id + 2000000, concat(' ', upper(substr(url, 1, 4)), substr(url, 5), ' ')
              FROM pages WHERE page_id % 7 = 0
    UNION ALL SELECT 3000000, ''
    UNION ALL SELECT 3000001, '://invalid-url'
"""

PROBES = """
    SELECT e.event_id AS probe_id, p.url AS input_url,
      CASE WHEN e.event_id % 7 = 0 THEN regexp_replace(p.url, '^http://', 'https://') END AS final_url,
      CASE WHEN e.event_id % 11 = 0 THEN NULL
           WHEN e.event_type = 'error' THEN CASE WHEN e.event_id % 2 = 0 THEN 500 ELSE 404 END
           WHEN e.event_type = 'signup' THEN 301 ELSE 200 END AS status_code,
      CASE WHEN e.event_id % 11 = 0 THEN 'No response from probe' END AS error,
      CAST(floor(abs(e.value) * 100) AS BIGINT) AS content_length,
      CASE WHEN e.event_id % 3 = 0 THEN 'text/html; charset=utf-8'
           WHEN e.event_id % 3 = 1 THEN 'application/json' END AS content_type,
      CASE WHEN e.event_id % 4 = 0 THEN 'nginx,react' WHEN e.event_id % 4 = 1 THEN 'apache' END AS tech_csv,
      concat('{"Server":"s', CAST(e.event_id % 3 AS VARCHAR), '"}') AS headers_json,
      CAST(CAST(e.ts AS DATE) AS VARCHAR) AS scan_session_id, e.ts AS scan_ts
    FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)
"""

EDGES = """
    SELECT c.url AS child, p.url AS parent FROM pages c
    JOIN pages p ON p.page_id = CAST(floor((c.page_id - 1) / 2) AS BIGINT) WHERE c.page_id >= 8
"""

SEEDS = "SELECT page_id AS pos, url FROM pages WHERE page_id < 4"

CONTENTS = """
    SELECT concat('doc/', doc_id) AS url, 1 AS ts, text AS content FROM documents WHERE doc_id % 10 <> 9
    UNION ALL
    SELECT concat('doc/', doc_id), 2,
      CASE WHEN doc_id % 3 = 1 THEN concat(text, chr(10), 'changed line') ELSE text END
    FROM documents WHERE doc_id % 10 <> 8
"""

SCAN_LOG = f"""
    SELECT scan_session_id, 'STARTED' AS status, min(scan_ts) AS event_ts FROM ({PROBES}) GROUP BY 1
    UNION ALL
    SELECT scan_session_id,
      CASE WHEN substr(scan_session_id, 10, 1) IN ('5', '0') THEN 'FAILED' ELSE 'COMPLETED' END, max(scan_ts)
    FROM ({PROBES}) GROUP BY 1
"""

VARIANTS = r"""
    SELECT page_id, CAST(variant AS INTEGER) AS variant, url FROM (
      SELECT page_id, unnest(range(10)) AS variant, unnest([
        url,
        concat(base, joint, 'Q=x y&tid=', page_id, '&UTM_Medium=a&b=%C3%A9*'),
        concat(base, '#sec-', page_id),
        concat(root, ':8080/p', page_id, '/'),
        concat(root, '/js/js/x', page_id),
        concat(root, '/ä b/', page_id, '.css'),
        concat(root, '/%zz/', page_id),
        concat('://bad', page_id),
        concat('/api/en-GB/deadbeef', page_id, '/session', page_id, '?ref=1'),
        concat('  ', upper(root), '/A/b/A/b/c', page_id, '/A ')
      ]) AS url
      FROM (SELECT page_id, url, split_part(url, '#', 1) AS base,
              regexp_extract(url, '^(https?://[^/]+)', 1) AS root,
              CASE WHEN contains(split_part(url, '#', 1), '?') THEN '&' ELSE '?' END AS joint FROM pages))
"""

SEGMENTS = f"""
    SELECT page_id, variant, CAST(item AS INTEGER) AS item, segment FROM (
      SELECT page_id, variant, unnest(range(len(parts))) AS item, unnest(parts) AS segment
      FROM (SELECT page_id, variant, regexp_split_to_array(url, '[/?#&=]') AS parts FROM ({VARIANTS})))
    WHERE segment <> ''
"""

MESSAGES = """
    SELECT e.event_id, concat(e.event_type, ' in src/app/main.go ', chr(10), chr(10), ' at ',
      'https://host.example.com/a/', repeat('x', 50), '/y',
      CASE WHEN e.event_id % 9 = 0 THEN concat(' Context Canceled', chr(10)) ELSE chr(10) END,
      d.text) AS message
    FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)
"""

RAW_PROBES = """
    SELECT event_id AS probe_id,
      CASE event_id % 5 WHEN 0 THEN concat(event_id % 90, 'm30s') WHEN 1 THEN concat(event_id, 'ms')
        WHEN 2 THEN concat(event_id, '.5') WHEN 3 THEN '1h2m' ELSE 'soon' END AS response_time,
      CAST(CASE event_id % 5 WHEN 0 THEN (event_id % 90) * 60 + 30 WHEN 1 THEN event_id / 1000.0
        WHEN 2 THEN event_id + 0.5 WHEN 3 THEN 3720 END AS DOUBLE) AS duration_s,
      concat('a, ', event_id) AS via, concat('nginx,', event_type) AS technologies,
      CASE WHEN event_id % 3 = 0 THEN event_id END AS asn, concat('10.0.0.', event_id % 255) AS ips
    FROM events
"""

# ---- URL parts ---------------------------------------------------------------------------------


def parts(source: str, url: str = "url") -> str:
    """The rows of ``source`` with the parts of ``url`` and whether it can be read at all."""
    return f"""
    SELECT *, u_auth_ok AND u_text_ok AND NOT regexp_matches(u_path, '{BAD_ESCAPE}')
        AND NOT regexp_matches(u_frag, '{BAD_ESCAPE}') AS u_ok,
      regexp_replace(regexp_replace(u_host_port, ':[0-9]*$', ''), '^\\[(.*)\\]$', '\\1') AS u_host,
      CASE WHEN u_scheme <> '' AND u_auth = '' AND NOT starts_with(u_path, '/') THEN ''
           WHEN contains(u_path, '%') AND NOT regexp_matches(u_path, '{BAD_ESCAPE}') THEN url_decode(u_path)
           ELSE u_path END AS u_plain
    FROM (SELECT *, NOT regexp_matches(u_host_port, '[ \\\\^`{{|}}%]|:[0-9]*[^0-9:\\]][^:\\]]*$') AS u_auth_ok,
        NOT regexp_matches({url}, '[\\x00-\\x1f\\x7f]')
          AND (u_scheme <> '' OR NOT regexp_matches({url}, '^[^/?#:]*:')) AS u_text_ok
      FROM (SELECT *, lower(regexp_extract({url}, '{RFC3986}', 1)) AS u_scheme,
          regexp_extract({url}, '{RFC3986}', 2) AS u_auth, regexp_extract({url}, '{RFC3986}', 3) AS u_path,
          regexp_extract({url}, '{RFC3986}', 4) AS u_query, regexp_extract({url}, '{RFC3986}', 5) AS u_frag,
          regexp_replace(regexp_extract({url}, '{RFC3986}', 2), '^//(.*@)?', '') AS u_host_port
        FROM ({source})))
    """


def escape(plain: str) -> str:
    out = f"url_encode({plain})"
    for char in "/$&+,:;=@":
        out = f"replace({out}, '%{ord(char):02X}', '{char}')"
    return out


ESCAPED_PATH = (
    r"CASE WHEN regexp_matches(u_path, '[^A-Za-z0-9_.~!$&''()*+,;=:@%\[\]/-]') THEN "
    + escape("u_plain")
    + " ELSE u_path END"
)

PAIRS = """list_filter(list_transform(string_split(substr(u_query, 2), '&'), lambda p, i: {
      'k': url_decode(replace(split_part(p, '=', 1), '+', ' ')), 'i': i,
      'v': CASE WHEN contains(p, '=') THEN url_decode(replace(substr(p, strpos(p, '=') + 1), '+', ' ')) ELSE '' END,
      'ok': p <> '' AND NOT contains(p, ';')}), lambda s: s.ok)"""

NOISE = text_list(sorted(set(tables.TRACKING_PARAMS + tables.CUSTOM_STRIP_PARAMS)))


def form(value: str) -> str:
    return f"replace(url_encode({value}), '%20', '+')"


def normalized(source: str, url: str = "url") -> str:
    """The rows of ``source`` with ``norm``."""
    kept = f"list_sort(list_filter({PAIRS}, lambda s: lower(s.k) NOT IN {NOISE}))"
    query = f"""CASE WHEN len(list_filter({PAIRS}, lambda s: lower(s.k) IN {NOISE})) = 0 THEN u_query
      WHEN len({kept}) = 0 THEN ''
      ELSE concat('?', array_to_string(list_transform({kept},
        lambda s: concat({form('s.k')}, '=', {form('s.v')})), '&')) END"""
    return f"""
    SELECT * EXCLUDE (u_auth_ok, u_text_ok, u_ok, u_host, u_plain, u_scheme, u_auth, u_path, u_query, u_frag, u_host_port),
      CASE WHEN u_ok THEN concat(u_scheme, u_auth, {ESCAPED_PATH}, {query}) END AS norm
    FROM ({parts(source, url)})
    """


def target(text: str) -> str:
    """The seed rule over an expression whose host holds no user part."""
    trimmed = f"trim({text})"
    full = f"CASE WHEN regexp_matches({trimmed}, '^https?://') THEN {trimmed} ELSE concat('https://', {trimmed}) END"
    return full


def targets(source: str, raw: str, keep: str) -> str:
    """``keep`` columns and ``url``: the usable seeds of ``source``."""
    inner = f"SELECT *, {target(raw)} AS full_url FROM ({source}) WHERE trim({raw}) <> ''"
    return f"""
    SELECT {keep}, concat(u_scheme, lower(u_auth), {ESCAPED_PATH}, u_query, CASE WHEN u_frag = '#' THEN '' ELSE u_frag END) AS url
    FROM ({parts(inner, 'full_url')}) WHERE u_ok
    """


# ---- patterns ----------------------------------------------------------------------------------

LANGS, NATIONS = text_list(tables.LANGUAGES), text_list(tables.LANGUAGES + COUNTRY_SEGMENTS)
WORDS = text_list(sorted(set(tables.COMMON_LOCALES + tables.LANGUAGES + COUNTRY_SEGMENTS + tables.SPECIAL_LOCALE_WORDS)))
CRAWL_WORDS = text_list(
    tables.CRAWL_LANGUAGES + tables.CRAWL_COUNTRIES + tables.CRAWL_DASHED_LOCALES + tables.CRAWL_COMPOUND_LOCALES
)
IGNORED = text_list(tables.IGNORED_PARAMS)


def locale(s: str, mode: str) -> str:
    if mode == "preprocess":
        return f"""(lower({s}) IN {WORDS} OR (len(string_split({s}, '-')) = 2
          AND lower(split_part({s}, '-', 1)) IN {LANGS} AND lower(split_part({s}, '-', 2)) IN {NATIONS}))"""
    return f"""(lower({s}) IN {CRAWL_WORDS} OR (length({s}) = 5 AND substr({s}, 3, 1) = '-'
      AND lower(substr({s}, 1, 2)) IN {text_list(tables.CRAWL_LANGUAGES)}
      AND lower(substr({s}, 4, 2)) IN {text_list(tables.CRAWL_COUNTRIES)}))"""


def variable(s: str, mode: str) -> str:
    if mode == "preprocess":
        session = any_of(s, tables.SESSION_PREFIXES, "(starts_with(lower({c}), '{v}') AND strlen({c}) > {n} + 4)")
        return f"""((regexp_full_match({s}, '[+-]?[0-9]+') AND TRY_CAST({s} AS BIGINT) IS NOT NULL)
          OR (strlen({s}) >= 8 AND regexp_full_match({s}, '[+-]?0*([1-7][0-9a-fA-F]{{15}}|[0-9a-fA-F]{{0,15}})'))
          OR (strlen({s}) = 36 AND len(string_split({s}, '-')) = 5) OR contains({s}, '%')
          OR (strlen({s}) > 16 AND regexp_full_match({s}, '[A-Za-z0-9]*')) OR {session})"""
    value = f"split_part({s}, '=', 2)"
    return f"""({s} <> '' AND (strlen({s}) <= 2 OR starts_with({s}, 'id=')
      OR (len(string_split({s}, '=')) = 2 AND (regexp_full_match({value}, '[0-9]{{1,6}}')
        OR lower(split_part({s}, '=', 1)) IN {text_list(tables.VARIABLE_FRAGMENT_KEYS)} OR strlen({value}) <= 3))
      OR regexp_full_match({s}, '[0-9]{{1,6}}') OR regexp_full_match({s}, '[0-9a-fA-F]{{1,8}}')))"""


def pattern(mode: str) -> str:
    """The pattern of the URL whose parts are in the row."""
    kept = f"list_filter({PAIRS}, lambda s: lower(s.k) NOT IN {IGNORED})"
    fragment = "substr(u_frag, 2)"
    if mode == "preprocess":
        path = f"""CASE WHEN u_plain = '' THEN '' ELSE concat('/', array_to_string(list_transform(
          list_filter(string_split(u_plain, '/'), lambda s: s <> ''), lambda s: CASE WHEN {locale('s', mode)}
          THEN '<locale>' WHEN {variable('s', mode)} THEN '<variable>' ELSE s END), '/')) END"""
        query = f"""array_to_string(list_transform(list_sort({kept}), lambda s: concat(s.k, '=',
          CASE WHEN {variable('s.v', mode)} THEN '<variable>' ELSE s.v END)), '&')"""
        tail = f"CASE WHEN {variable(fragment, mode)} THEN '#<variable>' ELSE u_frag END"
    else:
        inner = "trim(u_plain, '/')"
        path = f"""CASE WHEN {inner} = '' THEN '/' ELSE concat('/', array_to_string(list_transform(
          string_split({inner}, '/'), lambda s: CASE WHEN {locale('s', mode)} THEN '*' ELSE s END), '/'),
          CASE WHEN ends_with(u_plain, '/') THEN '/' ELSE '' END) END"""
        query = f"array_to_string(list_sort(list_transform({kept}, lambda s: concat(s.k, '=*'))), '&')"
        tail = f"CASE WHEN {variable(fragment, mode)} THEN '' ELSE u_frag END"
    return f"""CASE WHEN u_ok THEN concat(CASE WHEN u_scheme = '' THEN ':' ELSE u_scheme END, '//', u_host_port, {path},
      CASE WHEN {query} = '' THEN '' ELSE concat('?', {query}) END,
      CASE WHEN length(u_frag) <= 1 THEN '' ELSE {tail} END) END"""


def patterned(source: str, mode: str, keep: str, url: str = "norm") -> str:
    return f"SELECT {keep}, {pattern(mode)} AS pattern FROM ({parts(source, url)})"


CLEAN_TARGETS = targets(TARGETS, "raw_url", "pos")
NORM_TARGETS = f"SELECT pos, url, norm FROM ({normalized(CLEAN_TARGETS)}) WHERE norm IS NOT NULL"
FIRST_TARGETS = f"SELECT norm, min(pos) AS pos FROM ({NORM_TARGETS}) GROUP BY norm"
RANKED_TARGETS = f"""
    SELECT pos, norm, pattern, row_number() OVER (PARTITION BY pattern ORDER BY pos) AS rk
    FROM ({patterned(FIRST_TARGETS, 'preprocess', 'pos, norm')})
"""

# ---- links -------------------------------------------------------------------------------------

HREFS = r"""
    SELECT page_id, page_url, tag_pos, href FROM (
      SELECT page_id, url AS page_url, unnest(range(len(h))) AS tag_pos, unnest(h) AS href
      FROM (SELECT page_id, url, regexp_extract_all(
          regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<script>.*?</script>', '', 'g'),
          '<a href="([^"]*)"', 1) AS h FROM pages))
"""
LINKS = f"""
    SELECT page_id, page_url, tag_pos, href,
      concat(regexp_extract(page_url, '^(https?://[^/?#]+)', 1), {ESCAPED_PATH}, u_query, u_frag) AS link
    FROM ({parts(HREFS, 'href')})
"""
BLOCKED_EXT = any_of("u_plain", tables.DISALLOWED_EXTENSIONS, "ends_with({c}, '{v}')")
SCOPED_LINKS = f"""
    SELECT page_id, page_url, tag_pos, href, link, u_host,
      u_ok AND u_host NOT IN ('spam-farm.example.com', 'spam-farm.example.net', 'spam-farm.example.org',
        'blog.ththan.example.com', 'blog.ththan.example.net', 'blog.ththan.example.org')
        AND NOT {BLOCKED_EXT} AS in_scope
    FROM ({parts(LINKS, 'link')})
"""


def found(scope: str, seeds: str) -> str:
    """Discovered URLs of the links that pass ``scope``, seeds first, one per crawl pattern."""
    rows = f"""
      SELECT 1 AS src, page_id AS pg, tag_pos, link AS url FROM ({SCOPED_LINKS}) WHERE in_scope AND {scope}
      UNION ALL SELECT 0, pos, 0, url FROM ({seeds})
    """
    return f"""
    SELECT norm AS url, pattern FROM (
      SELECT norm, pattern, row_number() OVER (PARTITION BY pattern ORDER BY src, pg, tag_pos) AS rk
      FROM ({patterned(normalized(rows), 'crawl', 'src, pg, tag_pos, norm')})) WHERE rk = 1
    """


def norm_edges(links: str) -> str:
    child = f"SELECT page_id, tag_pos, page_url, norm AS child FROM ({normalized(links, 'link')})"
    return f"""
    SELECT child, norm AS parent FROM ({normalized(child, 'page_url')})
    QUALIFY row_number() OVER (PARTITION BY child ORDER BY page_id DESC, tag_pos DESC) = 1
    """


def roots(urls: str, edges: str, seeds: str) -> str:
    """(url, root_target, via) of distinct URLs; ``seeds`` are well-formed URLs."""
    host = r"regexp_extract({0}, '^https?://([^/?#:]+)', 1)"
    return f"""
    WITH RECURSIVE s AS ({seeds}), e AS ({edges}), w AS (SELECT DISTINCT url FROM ({urls})),
    up(url, cur, hops) AS (
      SELECT child, parent, 1 FROM e WHERE child NOT IN (SELECT url FROM s)
      UNION ALL SELECT up.url, e.parent, hops + 1 FROM up JOIN e ON e.child = up.cur
      WHERE up.cur NOT IN (SELECT url FROM s) AND hops < 60),
    chain AS (SELECT url, arg_min(cur, hops) AS root FROM up WHERE cur IN (SELECT url FROM s) GROUP BY url),
    by_host AS (SELECT {host.format('url')} AS h, arg_min(url, pos) AS root FROM s GROUP BY 1)
    SELECT w.url,
      CASE WHEN s2.url IS NOT NULL THEN w.url WHEN chain.root IS NOT NULL THEN chain.root
           WHEN by_host.root IS NOT NULL THEN by_host.root
           ELSE regexp_extract(w.url, '^(https?://[^/?#]+)', 1) END AS root_target,
      CASE WHEN s2.url IS NOT NULL THEN 'seed' WHEN chain.root IS NOT NULL THEN 'chain'
           WHEN by_host.root IS NOT NULL THEN 'host' ELSE 'site' END AS via
    FROM w LEFT JOIN (SELECT DISTINCT url FROM s) s2 ON s2.url = w.url LEFT JOIN chain ON chain.url = w.url
    LEFT JOIN by_host ON by_host.h = {host.format('w.url')}
    """


# ---- diff --------------------------------------------------------------------------------------

LAST_SESSION = "(SELECT max(CAST(CAST(ts AS DATE) AS VARCHAR)) FROM events)"
KEYED = rf"""
    SELECT *, regexp_extract(input_url, '^https?://([^/?#:]+)', 1) AS host,
      coalesce(nullif(final_url, ''), input_url) AS url_key FROM ({PROBES})
"""
NOW = f"SELECT * FROM ({KEYED}) WHERE scan_session_id = {LAST_SESSION}"
BEFORE_ALL = f"""
    SELECT k.* FROM ({KEYED}) k JOIN (SELECT host, max(scan_session_id) AS last FROM ({KEYED})
      WHERE scan_session_id < {LAST_SESSION} GROUP BY host) m ON m.host = k.host AND m.last = k.scan_session_id
"""
BEFORE = f"SELECT * FROM ({BEFORE_ALL}) WHERE host IN (SELECT host FROM ({NOW}))"
DIFF = f"""
    SELECT *, CASE WHEN (host, url_key) IN (SELECT (host, url_key) FROM ({BEFORE})) THEN 'existing' ELSE 'new' END
      AS url_status FROM ({NOW})
    UNION ALL
    SELECT *, 'old' FROM (SELECT * FROM ({BEFORE})
      QUALIFY row_number() OVER (PARTITION BY host, url_key ORDER BY scan_ts DESC, probe_id DESC) = 1)
    WHERE (host, url_key) NOT IN (SELECT (host, url_key) FROM ({NOW}))
"""
OK_STATUS = "(error IS NULL AND coalesce(status_code BETWEEN 200 AND 399, false))"
BY_SESSION = f"""
    WITH k AS ({KEYED}), hs AS (SELECT DISTINCT host, scan_session_id AS s FROM k),
    nx AS (SELECT host, s, lag(s) OVER (PARTITION BY host ORDER BY s) AS prev FROM hs),
    cur AS (SELECT nx.s, EXISTS (SELECT 1 FROM k o WHERE o.host = k.host AND o.scan_session_id = nx.prev
        AND o.url_key = k.url_key) AS known FROM k JOIN nx ON nx.host = k.host AND nx.s = k.scan_session_id),
    gone AS (SELECT DISTINCT nx.s, o.host, o.url_key FROM nx JOIN k o ON o.host = nx.host AND o.scan_session_id = nx.prev
        WHERE NOT EXISTS (SELECT 1 FROM k c WHERE c.host = nx.host AND c.scan_session_id = nx.s AND c.url_key = o.url_key))
    SELECT c.s AS scan_session_id, c.n_new, coalesce(g.n_old, 0) AS n_old, c.n_existing FROM
      (SELECT s, count(*) FILTER (NOT known) AS n_new, count(*) FILTER (known) AS n_existing FROM cur GROUP BY s) c
      LEFT JOIN (SELECT s, count(*) AS n_old FROM gone GROUP BY s) g ON g.s = c.s
"""
HISTORY = f"""
    SELECT scan_session_id, min(event_ts) FILTER (status = 'STARTED') AS start_ts,
      max(event_ts) FILTER (status <> 'STARTED') AS end_ts,
      arg_max(status, (event_ts, status <> 'STARTED')) AS status FROM ({SCAN_LOG}) GROUP BY 1
"""
SHOWN = """NOT (error IS NOT NULL AND status_code IS NULL) AND (coalesce(status_code BETWEEN 200 AND 499, false)
    OR tech_csv IS NOT NULL OR content_type IS NOT NULL OR coalesce(status_code IN (500, 502, 503), false))"""


def facets(source: str, status: str) -> str:
    return f"""
    SELECT facet, value, count(*) AS n_rows FROM (
      SELECT 'host' AS facet, host AS value FROM ({source}) WHERE {SHOWN}
      UNION ALL SELECT 'status_code', CAST(status_code AS VARCHAR) FROM ({source}) WHERE status_code > 0
      UNION ALL SELECT 'content_type', content_type FROM ({source})
      UNION ALL SELECT 'technology', unnest(string_split(tech_csv, ',')) FROM ({source})
      UNION ALL SELECT 'url_status', {status} FROM ({source}))
    WHERE value <> '' GROUP BY facet, value
    """


SUMMARIES = f"""
    SELECT *, CAST(substr(day, 9, 2) AS INTEGER) AS d FROM (
      SELECT scan_session_id AS day, count(*) AS total_probed, count(*) FILTER {OK_STATUS.replace('(error', '(error', 1)} AS good
      FROM ({PROBES}) GROUP BY 1)
"""
STATUS_CLASS = """CASE WHEN status_code BETWEEN 200 AND 299 THEN '2xx Success'
    WHEN status_code BETWEEN 300 AND 399 THEN '3xx Redirect' WHEN status_code BETWEEN 400 AND 499 THEN '4xx Client Error'
    WHEN status_code >= 500 THEN '5xx Server Error' ELSE 'Other' END"""
MS = "epoch_us(scan_ts) // 1000"
STORED = f"""
    SELECT input_url AS original_url, nullif(final_url, '') AS final_url, status_code,
      nullif(content_length, 0) AS content_length, content_type, CAST(NULL AS VARCHAR) AS title,
      CAST(NULL AS VARCHAR) AS web_server, coalesce(tech_csv, '') AS technologies, '' AS ip_address,
      CAST(NULL AS VARCHAR) AS root_target_url, error AS probe_error, CAST(NULL AS VARCHAR) AS method, headers_json,
      CAST(NULL AS VARCHAR) AS diff_status, scan_session_id, {MS} AS scan_timestamp, {MS} AS first_seen_timestamp,
      {MS} AS last_seen_timestamp, host FROM ({KEYED})
"""
DIGEST = r"""trim(array_to_string(list_transform(
    list_filter(list_transform(string_split(message, chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(160))), lambda s: s <> '')[1:8],
    lambda s: CASE WHEN length(SHORT) <= 150 THEN SHORT ELSE concat(substr(SHORT, 1, 147), '...') END), chr(10)),
    ' ' || chr(10))""".replace(
    "SHORT",
    r"""regexp_replace(regexp_replace(regexp_replace(s, '([a-zA-Z0-9_-]+/)*([\w-]+\.(go|js|html|css|json))', '\2', 'g'),
      '(https://\S{22})\S{11,}(\S{20})', '\1...\2', 'g'), '(http://\S{23})\S{11,}(\S{20})', '\1...\2', 'g')""",
)
CANCELLED = any_of("lower(message)", tables.CANCEL_PHRASES, "contains({c}, '{v}')")
LINES = r"""list_filter(list_transform(string_split(regexp_replace(
    regexp_replace(content, '(?s)<!--.*?-->|/\*.*?\*/', '', 'g'), '\r\n', chr(10), 'g'), chr(10)),
    lambda s: trim(regexp_replace(regexp_replace(s, '(^|\s)//.*', '', 'g'), '\s+', ' ', 'g'))), lambda s: s <> '')"""

# ---- link rules --------------------------------------------------------------------------------

REPEATED = any_of("url", tables.REPEATED_FRAGMENTS, "contains({c}, '{v}')")
PROBLEM = f"""(strlen(url) > 2000 OR len(string_split(url, '/')) > 51 OR {REPEATED}
    OR {any_of('url', tables.RECURSIVE_FRAGMENTS_STRICT, "contains({c}, '{v}')")})"""
OFTEN = """(coalesce(list_max(list_transform({s}, lambda a: CASE WHEN strlen(a) >= 2
    THEN len(list_filter({s}, lambda b: b = a)) ELSE 0 END)), 0) > 3)"""
URL_SEGMENTS = r"""string_split(trim(CASE WHEN regexp_matches(url, '//[^/]*/')
    THEN regexp_extract(url, '//[^/]*(/.*)$', 1) ELSE url END, '/'), '/')"""
TOO_OFTEN = f"(len({URL_SEGMENTS}) > 5 AND {OFTEN.format(s=URL_SEGMENTS)})"
INVALID = f"""(url = '' OR strlen(url) > 1000 OR {REPEATED}
    OR {any_of('url', tables.RECURSIVE_FRAGMENTS, "contains({c}, '{v}')")}
    OR len(string_split(url, '/')) > 31 OR {TOO_OFTEN})"""
SEEN_SEGMENTS = "string_split(trim(u_plain, '/'), '/')"
TRAP_SOURCE = f"""
    SELECT page_id, variant, full_url, text_ok FROM (
      SELECT page_id, variant, {target('url')} AS full_url, u_ok AS text_ok
      FROM ({parts(f"SELECT page_id, variant, trim(url) AS url FROM ({VARIANTS})")}))
"""
TRAP = f"""(trim(u_plain, '/') <> '' AND (len(s) > 15 OR {OFTEN.format(s='s')}
    OR len(list_filter(range(1, len(s)), lambda i: strlen(s[i]) >= 2 AND s[i] = s[i + 1])) > 0
    OR list_max(list_transform(s, lambda a: strlen(a))) > 200
    OR (len(s) > 3 AND s[1] = s[-1] AND strlen(s[1]) >= 2)
    OR len(list_filter(range(1, len(s) - 4), lambda i: strlen(s[i]) >= 2 AND s[i] = s[i + 2] AND s[i] = s[i + 4]
        AND s[i + 1] = s[i + 3] AND s[i + 1] = s[i + 5])) > 0))"""


def over_variants(expr: str, name: str) -> str:
    return f"SELECT page_id, variant, {expr} AS {name} FROM ({VARIANTS})"


def over_parts(expr: str, name: str) -> str:
    return f"SELECT page_id, variant, {expr} AS {name} FROM ({parts(VARIANTS)})"


def over_segments(expr: str, name: str) -> str:
    return f"SELECT page_id, variant, item, {expr} AS {name} FROM ({SEGMENTS})"


def over_probes(expr: str, name: str) -> str:
    return f"SELECT probe_id, {expr} AS {name} FROM ({PROBES})"


ABSOLUTE_HOST = r"regexp_extract(u, '^(https?://[^/?#]+)', 1)"
RESOLVED = f"""
    SELECT v.page_id, v.variant, CASE WHEN NOT v.u_ok OR v.t = '' THEN NULL
      WHEN v.u_scheme <> '' THEN concat(v.u_scheme, v.u_auth, v.esc, v.u_query, v.u_frag)
      ELSE concat(regexp_extract(p.url, '^(https?://[^/?#]+)', 1), v.esc, v.u_query, v.u_frag) END AS resolved
    FROM (SELECT *, {ESCAPED_PATH} AS esc
      FROM ({parts(f"SELECT page_id, variant, trim(url) AS t FROM ({VARIANTS})", 't')})) v
    JOIN pages p ON p.page_id = v.page_id
"""
CAP_PAGES = patterned(normalized("SELECT page_id AS pos, url FROM pages"), "crawl", "pos, norm")
SCAN_TARGETS = f"SELECT pos, norm AS url FROM ({RANKED_TARGETS}) WHERE rk = 1"
SCAN_HOSTS = rf"SELECT DISTINCT regexp_extract(url, '^https?://([^/?#:]+)', 1) FROM ({SCAN_TARGETS})"
PLAIN_LINKS = f"""
    SELECT page_id, page_url, tag_pos, link, u_ok AND NOT {BLOCKED_EXT} AND u_host IN ({SCAN_HOSTS}) AS in_scope
    FROM ({parts(LINKS, 'link')})
"""
SCAN_ROWS = f"""
    SELECT 1 AS src, page_id AS pg, tag_pos, link AS url FROM ({PLAIN_LINKS}) WHERE in_scope
    UNION ALL SELECT 0, pos, 0, url FROM ({SCAN_TARGETS})
"""
SCAN_FOUND = f"""
    SELECT norm AS url FROM (
      SELECT norm, row_number() OVER (PARTITION BY pattern ORDER BY src, pg, tag_pos) AS rk
      FROM ({patterned(normalized(SCAN_ROWS), 'crawl', 'src, pg, tag_pos, norm')})) WHERE rk = 1
"""


def last_probes(urls: str, columns: str) -> str:
    return f"""
    SELECT u.url AS input_url, {columns},
      CASE WHEN l.probe_id IS NULL THEN 'No response from probe' ELSE l.error END AS error
    FROM ({urls}) u LEFT JOIN (SELECT * FROM ({PROBES})
      QUALIFY row_number() OVER (PARTITION BY input_url ORDER BY scan_ts DESC, probe_id DESC) = 1) l
    ON l.input_url = u.url
    """


INVENTORY = f"""
    SELECT host, url_key, min(scan_ts) AS first_seen, max(scan_ts) AS last_seen,
      (array_agg(status_code ORDER BY scan_ts DESC, probe_id DESC))[1] AS last_status,
      count(DISTINCT scan_session_id) AS n_sessions FROM ({KEYED}) GROUP BY 1, 2
"""
CYCLED = f"SELECT *, CAST((CAST(substr(scan_session_id, 9, 2) AS INTEGER) - 1) // 10 AS BIGINT) AS c0 FROM ({KEYED})"
EVERY_DIFF = f"""
    WITH k AS ({KEYED}), hs AS (SELECT DISTINCT host, scan_session_id AS s FROM k),
    nx AS (SELECT host, s, lag(s) OVER (PARTITION BY host ORDER BY s) AS prev FROM hs),
    before AS (SELECT nx.s, o.* FROM nx JOIN k o ON o.host = nx.host AND o.scan_session_id = nx.prev)
    SELECT k.scan_session_id, k.host, k.url_key, k.probe_id,
      CASE WHEN b.url_key IS NULL THEN 'new' ELSE 'existing' END AS url_status
    FROM k LEFT JOIN (SELECT DISTINCT s, host, url_key FROM before) b
      ON b.s = k.scan_session_id AND b.host = k.host AND b.url_key = k.url_key
    UNION ALL
    SELECT s, host, url_key, probe_id, 'old' FROM (SELECT * FROM before
      QUALIFY row_number() OVER (PARTITION BY s, host, url_key ORDER BY scan_ts DESC, probe_id DESC) = 1) b
    WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.scan_session_id = b.s AND k.host = b.host AND k.url_key = b.url_key)
"""
# The links that the rewritten pages of ``extract_links_mixed`` hold, by page.
MIXED = r"""
    SELECT page_id, 'a' AS asset_type, 'href' AS attr, concat(h, '/p', page_id, '?a=1&b=é') AS link FROM (
      SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS h FROM pages)
    UNION ALL SELECT page_id, 'link', 'href', concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), '/&a') FROM pages
    UNION ALL SELECT page_id, 'img', 'src', concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), '/caf%C3%A9') FROM pages
    UNION ALL SELECT page_id, 'img', 'srcset', concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), '/s', page_id, '.png') FROM pages
    UNION ALL SELECT page_id, 'img', 'srcset', concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), '/t.png') FROM pages
    UNION ALL SELECT page_id, 'form', 'action', concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), '/do?x=1&ampy=2') FROM pages
"""


def dashboard(rows: str) -> str:
    return f"""
    SELECT total, good AS success_count, total - good AS error_count,
      CASE WHEN total = 0 THEN 0 ELSE CAST(floor(100.0 * good / total + 0.5) AS BIGINT) END AS success_rate,
      CASE WHEN total = 0 THEN 0 ELSE CAST(floor(100.0 * (total - good) / total + 0.5) AS BIGINT) END AS error_rate, unique_hosts,
      (SELECT count(DISTINCT t) FROM (SELECT unnest(string_split(tech_csv, ',')) AS t FROM ({rows}))) AS unique_technologies
    FROM (SELECT count(*) AS total, count(*) FILTER (status_code BETWEEN 200 AND 399) AS good,
      count(DISTINCT host) AS unique_hosts FROM ({rows}))"""


def oracle_sql() -> dict[str, str]:
    host_of_norm = r"regexp_extract(url, '^https?://([^/?#:]+)', 1)"
    return {
        # sources and sinks
        "read_targets": f"SELECT url FROM ({CLEAN_TARGETS})",
        "target_report": f"""SELECT count(*) AS total, (SELECT count(*) FROM ({CLEAN_TARGETS})) AS ok,
            count(*) - (SELECT count(*) FROM ({CLEAN_TARGETS})) AS skipped FROM ({TARGETS})""",
        "read_snapshot": f"""SELECT original_url, host, status_code, host AS root_target_url, scan_timestamp,
            scan_session_id FROM ({STORED}) WHERE scan_session_id = {LAST_SESSION}""",
        "read_snapshot_page": f"""SELECT original_url, scan_session_id, scan_timestamp, (SELECT count(*) FROM ({STORED})) AS n_total FROM ({STORED})
            ORDER BY scan_session_id, scan_timestamp, original_url, final_url LIMIT 25 OFFSET 50""",
        "write_snapshot": f"SELECT scan_session_id, count(*) AS n_rows FROM ({STORED}) GROUP BY 1",
        "write_snapshot_by_host": f"SELECT original_url, host, scan_session_id, scan_timestamp FROM ({STORED})",
        "diff_every_session": EVERY_DIFF,
        "extract_links_mixed": MIXED,
        "merged_errors": f"""SELECT substr(day, 1, 9) AS parent_session, d AS batch, i AS item, ['x', 'y'][i + 1] AS message
            FROM ({SUMMARIES}), (SELECT unnest([0, 1]) AS i) WHERE d % 2 = 0""",
        "write_snapshot_codec": f"SELECT host, count(*) AS n_rows FROM ({STORED}) GROUP BY 1",
        "to_storage_row": f"SELECT * EXCLUDE host FROM ({STORED})",
        "from_storage_row": f"""SELECT input_url, coalesce(final_url, '') AS final_url, coalesce(status_code, 0) AS status_code,
            content_length, coalesce(content_type, '') AS content_type, coalesce(error, '') AS error, scan_session_id,
            json_extract_string(headers_json, '$.Server') AS server, coalesce(tech_csv, '') AS technologies,
            {MS} AS timestamp_ms FROM ({PROBES})""",
        "scan_history_append": HISTORY,
        "last_completed_scan": f"SELECT max(start_ts) AS last_scan_start FROM ({HISTORY}) WHERE status = 'COMPLETED'",
        "export_rows_json": f"SELECT probe_id, input_url, status_code, coalesce(tech_csv, '') AS technologies FROM ({PROBES})",
        "export_rows": f"""SELECT probe_id, input_url, status_code, CASE WHEN tech_csv IS NULL THEN '' ELSE
            concat('["', replace(tech_csv, ',', '","'), '"]') END AS technologies FROM ({PROBES})""",
        "report_parts": f"""SELECT probe_id, rn, CAST((rn + 999) // 1000 AS BIGINT) AS part, n_parts,
            CASE WHEN n_parts = 1 THEN '' ELSE concat('Part ', (rn + 999) // 1000, ' of ', n_parts) END AS part_info,
            CASE WHEN n_parts = 1 THEN 'report' ELSE concat('report-part', (rn + 999) // 1000) END AS part_name
            FROM (SELECT probe_id, row_number() OVER (ORDER BY scan_ts, probe_id) AS rn,
              CAST((count(*) OVER () + 999) // 1000 AS BIGINT) AS n_parts FROM ({PROBES}))""",
        # expressions
        "normalize_target": f"""SELECT v.page_id, v.variant, t.url AS target FROM ({VARIANTS}) v LEFT JOIN
            ({targets(VARIANTS, 'url', 'page_id, variant')}) t ON t.page_id = v.page_id AND t.variant = v.variant""",
        "normalize_url": f"SELECT page_id, variant, norm FROM ({normalized(VARIANTS)})",
        "extract_host": over_parts("CASE WHEN u_ok THEN nullif(u_host, '') END", "host"),
        "snapshot_key": over_variants(
            r"""trim(replace(replace(replace(regexp_replace(regexp_replace(
                regexp_replace(url, '^.*?://', ''), '[^a-zA-Z0-9_.-]+', '_', 'g'), '_+', '_', 'g'),
                '..', '_'), '_.', '_'), '._', '_'), '_.')""",
            "snapshot_key",
        ),
        "is_valid_url": f"""SELECT page_id, variant, u_ok AND u <> '' AS is_valid
            FROM ({parts(f"SELECT page_id, variant, trim(url) AS u FROM ({VARIANTS})", 'u')})""",
        "url_pattern_preprocess": over_parts(pattern("preprocess"), "pattern"),
        "url_pattern_crawl": over_parts(pattern("crawl"), "pattern"),
        "is_skippable_href": over_variants("url = '' OR regexp_matches(url, '^(data|mailto|tel|javascript):')", "skippable"),
        "has_path_trap": f"""SELECT page_id, variant, coalesce(text_ok AND u_ok AND {TRAP}, false) AS trap
            FROM (SELECT *, {SEEN_SEGMENTS} AS s FROM ({parts(TRAP_SOURCE, 'full_url')}))""",
        "has_problem_pattern": over_variants(PROBLEM, "problem"),
        "is_invalid_url": over_variants(INVALID, "invalid"),
        "has_repeated_segments": over_variants(TOO_OFTEN, "repeated"),
        "in_scope_path": over_variants(
            "NOT " + any_of("split_part(split_part(url, '?', 1), '#', 1)", tables.DISALLOWED_EXTENSIONS, "ends_with({c}, '{v}')"),
            "allowed",
        ),
        "is_blocked_file": over_variants(
            r"regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '(\.[^.]*)$', 1) IN "
            + text_list(tables.DISALLOWED_EXTENSIONS),
            "blocked",
        ),
        "is_locale_preprocess": over_segments(locale("segment", "preprocess"), "is_locale"),
        "is_locale_crawl": over_segments(locale("segment", "crawl"), "is_locale"),
        "is_variable_preprocess": over_segments(variable("segment", "preprocess"), "is_variable"),
        "is_variable_crawl": over_segments(variable("segment", "crawl"), "is_variable"),
        "is_ignored_param": over_segments(f"lower(segment) IN {IGNORED}", "is_ignored"),
        "effective_url": over_probes("coalesce(nullif(final_url, ''), input_url)", "effective_url"),
        "is_success": over_probes(OK_STATUS, "success"),
        "status_class": over_probes(STATUS_CLASS, "status_class"),
        "has_facet_host": over_probes(SHOWN, "shown"),
        "short_content_type": over_probes("split_part(split_part(content_type, ';', 1), '/', 2)", "short_type"),
        "resolve_url": RESOLVED,
        "base_domain": "SELECT page_id, regexp_extract(url, '^https?://(?:[^/?#:]*\\.)?([^./?#:]+\\.[^./?#:]+)(?:[/?#:]|$)', 1) AS base_domain FROM pages",
        "url_key": f"""SELECT v.page_id, v.variant, v.url AS exact_key, lower(v.url) AS folded_key,
            coalesce(t.url, v.url) AS normal_key FROM ({VARIANTS}) v LEFT JOIN
            ({targets(VARIANTS, 'url', 'page_id, variant')}) t ON t.page_id = v.page_id AND t.variant = v.variant""",
        "parse_srcset": over_variants(r"concat(regexp_extract(url, '^\s*(\S+)', 1), '|/i.png')", "urls"),
        "in_scope_host": over_parts(
            """coalesce(u_ok AND u_host <> '' AND u_host <> 'blog.ththan.example.net' AND u_host <> 'example.org'
               AND NOT ends_with(u_host, '.blog.ththan.example.net') AND NOT ends_with(u_host, '.example.org')
               AND NOT regexp_matches(lower(u_host), '^(m\\.therou|spam-farm)\\.example\\.(com|net|org)$'), false)""",
            "allowed",
        ),
        "in_scope": f"""SELECT page_id, variant, coalesce(u_ok AND u_host <> ''
            AND u_host IN (SELECT {host_of_norm} FROM ({SEEDS}))
            AND NOT regexp_matches(lower(u_host), '^blog\\.ththan\\.example\\.(com|net|org)$')
            AND NOT {BLOCKED_EXT}, false) AS allowed FROM ({parts(VARIANTS)})""",
        "seed_hosts": f"SELECT {host_of_norm} AS host, min(page_id) AS first_pos FROM pages GROUP BY 1",
        "parse_duration_s": f"SELECT probe_id, duration_s FROM ({RAW_PROBES})",
        "parse_asn": f"SELECT probe_id, asn FROM ({RAW_PROBES})",
        "flatten_headers": f"SELECT probe_id, via FROM ({RAW_PROBES})",
        "clean_probes": f"SELECT probe_id, duration_s, via, technologies, asn, ips FROM ({RAW_PROBES})",
        "error_digest": f"SELECT event_id, {DIGEST} AS digest FROM ({MESSAGES})",
        "is_cancellation": f"SELECT event_id, {CANCELLED} AS cancelled FROM ({MESSAGES})",
        # preprocessing
        "preprocess_urls": f"SELECT pos, norm, pattern FROM ({RANKED_TARGETS}) WHERE rk <= 1",
        "preprocess_urls_k2": f"SELECT pos, norm, pattern FROM ({RANKED_TARGETS}) WHERE rk <= 2",
        "dedupe_urls": FIRST_TARGETS,
        "cap_per_pattern": f"""SELECT pos, norm, pattern FROM ({CAP_PAGES})
            QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY pos) <= 3""",
        "preprocess_stats": f"""
            WITH n AS ({normalized(f"SELECT pos, raw_url AS url FROM ({TARGETS})")}),
            g AS (SELECT norm, min(pos) AS pos, count(*) AS n FROM n WHERE norm IS NOT NULL GROUP BY norm),
            r AS (SELECT n, row_number() OVER (PARTITION BY pattern ORDER BY pos) AS rk
              FROM ({patterned('SELECT * FROM g', 'preprocess', 'pos, n')}))
            SELECT (SELECT count(*) FROM n) AS total_processed, (SELECT count(*) FROM n WHERE norm <> url) AS normalized,
              CAST(coalesce(sum(n) FILTER (rk > 2), 0) AS BIGINT) AS skipped_by_pattern,
              CAST(coalesce(sum(n - 1) FILTER (rk <= 2), 0) AS BIGINT) AS skipped_duplicate,
              count(*) FILTER (rk <= 2) AS final_count FROM r""",
        "pattern_stats": f"""SELECT pattern, count(*) AS n_urls FROM ({RANKED_TARGETS}) WHERE rk <= 3
            GROUP BY pattern HAVING count(*) >= 2""",
        # links and graph
        "extract_links": f"SELECT page_id, 'a' AS asset_type, 'href' AS attr, href, link FROM ({LINKS})",
        "asset_inventory": f"""SELECT page_id, 'a' AS asset_type, in_scope, count(*) AS n_links
            FROM ({SCOPED_LINKS}) GROUP BY ALL""",
        "html_pages_only": f"""SELECT probe_id, input_url FROM ({PROBES}) WHERE content_type ILIKE '%text/html%'""",
        "discovered_urls": found("true", SEEDS),
        "link_edges": norm_edges(f"SELECT page_id, tag_pos, page_url, link FROM ({LINKS})"),
        "crawl_frontier": f"""
            WITH RECURSIVE e AS ({EDGES}), r(url, depth) AS (
              SELECT url, 1 FROM ({SEEDS}) UNION SELECT e.child, r.depth + 1 FROM r JOIN e ON e.parent = r.url WHERE r.depth < 6)
            SELECT url, min(depth) AS depth FROM r GROUP BY url""",
        "root_target": roots("SELECT url FROM pages", EDGES, SEEDS),
        "attach_probes": last_probes(
            f"SELECT child AS url FROM ({EDGES}) UNION ALL SELECT concat(url, '/unprobed') FROM pages",
            "l.probe_id, l.status_code",
        ),
        # diff
        "group_by_host": f"""SELECT coalesce(CASE WHEN u_ok THEN nullif(u_host, '') END, 'unknown') AS host,
            count(*) AS n_rows FROM ({parts(VARIANTS)}) GROUP BY 1""",
        "latest_per_key": f"""SELECT host, url_key, probe_id, status_code FROM ({KEYED})
            QUALIFY row_number() OVER (PARTITION BY host, url_key ORDER BY scan_ts DESC, probe_id DESC) = 1""",
        "previous_snapshot": f"SELECT probe_id, host, scan_session_id, url_key FROM ({BEFORE})",
        "previous_snapshot_all_hosts": f"SELECT probe_id, host, scan_session_id, url_key FROM ({BEFORE_ALL})",
        "url_diff": f"SELECT host, url_key, probe_id, url_status FROM ({DIFF})",
        "diff_counts": f"""SELECT host, count(*) FILTER (url_status = 'new') AS n_new,
            count(*) FILTER (url_status = 'old') AS n_old, count(*) FILTER (url_status = 'existing') AS n_existing,
            CAST(0 AS BIGINT) AS n_changed FROM ({DIFF}) GROUP BY ROLLUP (host)""",
        "diff_counts_by_session": BY_SESSION,
        "apply_status": f"SELECT probe_id, url_status FROM ({DIFF}) WHERE url_status <> 'old'",
        "diff_and_store": f"""SELECT input_url AS original_url, host, url_status AS diff_status, {MS} AS scan_timestamp
            FROM ({DIFF}) WHERE url_status <> 'old'""",
        "report_rows": f"SELECT scan_session_id, url_status, count(*) AS n_rows FROM ({DIFF}) GROUP BY ALL",
        "url_inventory": INVENTORY,
        # report
        "to_report_view": f"""SELECT input_url, final_url, status_code, content_length, content_type,
            tech_csv AS technologies, error, NULL AS title, NULL AS web_server, NULL AS method, NULL AS root_target_url,
            NULL AS url_status, ips, cnames, asn, asn_org, duration_s, server, concat(strftime(scan_ts, '%Y-%m-%d %H:%M:%S'), ' UTC') AS timestamp,
            {OK_STATUS} AS is_success, tech_csv IS NOT NULL AS has_technologies, ips IS NOT NULL AS has_ips,
            cnames IS NOT NULL AS has_cnames, coalesce(asn, 0) > 0 AS has_asn FROM (SELECT *,
              CASE WHEN probe_id % 2 = 0 THEN concat('10.0.0.', probe_id % 255) END AS ips,
              CASE WHEN probe_id % 5 = 0 THEN 'c.example,d.example' END AS cnames, CASE WHEN probe_id % 3 = 0 THEN probe_id END AS asn,
              CASE WHEN probe_id % 3 = 0 THEN 'net' END AS asn_org, probe_id / 1000.0 AS duration_s,
              concat('s', probe_id % 3) AS server FROM ({PROBES}))""",
        "facets": facets(DIFF, "url_status"),
        "facets_all_sessions": facets(KEYED, "NULL"),
        "dashboard_stats": dashboard(KEYED),
        "status_distribution": f"SELECT {STATUS_CLASS} AS status_class, count(*) AS n_rows FROM ({PROBES}) GROUP BY 1",
        "diff_distribution": f"SELECT url_status, count(*) AS n_rows FROM ({DIFF}) GROUP BY 1",
        "report_facets": facets(DIFF, "url_status"),
        "report_stats": dashboard(DIFF),
        "report_status": f"SELECT {STATUS_CLASS} AS status_class, count(*) AS n_rows FROM ({DIFF}) GROUP BY 1",
        "report_distribution": f"SELECT url_status, count(*) AS n_rows FROM ({DIFF}) GROUP BY 1",
        "search_report": f"""SELECT probe_id, input_url, status_code, content_length FROM ({PROBES})
            WHERE (contains(lower(input_url), 'example.org') OR coalesce(contains(lower(final_url), 'example.org'), false))
              AND contains(lower(input_url), '/en/') AND status_code IN (200, 301) AND tech_csv IS NOT NULL
            ORDER BY content_length DESC, probe_id LIMIT 25 OFFSET 50""",
        # summaries
        "probe_stats": f"""SELECT scan_session_id, count(*) AS total_probed, count(*) FILTER ({OK_STATUS}) AS successful_probes,
            count(*) FILTER (NOT {OK_STATUS}) AS failed_probes, count(*) AS discoverable_items FROM ({PROBES}) GROUP BY 1""",
        "scan_summary": f"""
            SELECT p.scan_session_id, 'file' AS target_source, 'auto' AS scan_mode, CAST(2 AS BIGINT) AS total_targets, 1 AS retries,
              concat_ws('; ', CASE substr(h.scan_session_id, 10, 1) WHEN '0' THEN 'Operation interrupted' WHEN '1' THEN 'slow' END,
                CASE WHEN h.status = 'FAILED' THEN 'run failed' END) AS messages,
              total_probed, good AS successful_probes, total_probed - good AS failed_probes,
              total_probed AS discoverable_items, n_new, n_old, n_existing, CAST(0 AS BIGINT) AS n_changed,
              (epoch_us(h.end_ts) - epoch_us(h.start_ts)) / 1e6 AS duration_s,
              CASE WHEN h.status = 'FAILED' AND substr(h.scan_session_id, 10, 1) = '0' THEN 'INTERRUPTED'
                   WHEN h.status = 'FAILED' THEN 'FAILED'
                   WHEN substr(h.scan_session_id, 10, 1) = '1' THEN 'PARTIAL_COMPLETE' ELSE 'COMPLETED' END AS status,
              '' AS report_path
            FROM (SELECT scan_session_id, count(*) AS total_probed, count(*) FILTER ({OK_STATUS}) AS good
              FROM ({PROBES}) GROUP BY 1) p
            JOIN ({BY_SESSION}) d ON d.scan_session_id = p.scan_session_id
            JOIN ({HISTORY}) h ON h.scan_session_id = p.scan_session_id""",
        "validate_summary": f"""SELECT day, array_to_string(list_filter([
            CASE WHEN d % 7 = 0 THEN 'scan_session_id is required' END, CASE WHEN d % 5 = 0 THEN 'scan_mode is required' END,
            CASE WHEN total_probed - good - CASE WHEN d % 3 = 0 THEN 100000 ELSE 0 END < 0
              THEN 'failed_probes cannot be negative' END], lambda x: x IS NOT NULL), '; ') AS violations FROM ({SUMMARIES})""",
        "assign_batches": f"""SELECT pos, CASE WHEN count(*) OVER () >= 100
            THEN (row_number() OVER (ORDER BY pos) - 1) // 50 ELSE 0 END AS batch FROM ({CLEAN_TARGETS})""",
        "batching_stats": f"""SELECT n AS n_rows, CASE WHEN n < 100 THEN 1 ELSE (n + 69) // 70 END AS n_batches,
            CASE WHEN n < 100 THEN n ELSE n % 70 END AS remaining FROM (SELECT count(*) AS n FROM ({CLEAN_TARGETS}))""",
        "merge_summaries": f"""SELECT substr(day, 1, 9) AS parent_session, CAST(sum(total_probed) AS BIGINT) AS total_probed,
            CAST(sum(good) AS BIGINT) AS successful_probes,
            CAST(sum(total_probed - good - CASE WHEN d % 3 = 0 THEN 100000 ELSE 0 END) AS BIGINT) AS failed_probes,
            CAST(sum(1.5) AS DOUBLE) AS duration_s, count(*) AS total_batches, count(*) FILTER (d % 10 < 5) AS processed_batches,
            CAST(sum(CASE WHEN d % 2 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS n_errors,
            CASE WHEN bool_or(d >= 10 AND d < 20) THEN 'PARTIAL_COMPLETE' WHEN bool_or(d = 25) THEN 'FAILED'
              ELSE 'COMPLETED' END AS status FROM ({SUMMARIES}) GROUP BY 1""",
        "top_errors": f"""
            WITH g AS (SELECT digest, count(*) AS n_errors FROM (SELECT {DIGEST} AS digest FROM ({MESSAGES})) GROUP BY 1),
            r AS (SELECT *, row_number() OVER (ORDER BY n_errors DESC, digest) AS rank, count(*) OVER () AS total FROM g),
            l AS (SELECT *, concat(rank, '. ', digest) AS line FROM r),
            b AS (SELECT *, coalesce(sum(length(line) + 1) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              AS used FROM l),
            stop AS (SELECT min(rank) AS s FROM b WHERE used + length(line) > 800)
            SELECT CAST(rank AS INTEGER) AS rank, line, n_errors FROM b WHERE rank < (SELECT s FROM stop)
            UNION ALL SELECT CAST(rank AS INTEGER), concat('... and ', total - (rank - 1), ' more errors'), NULL FROM b
            WHERE rank = (SELECT s FROM stop)
              AND used + length(concat('... and ', total - (rank - 1), ' more errors')) + 1 <= 800""",
        "sample_targets": f"""
            WITH t AS (SELECT url, row_number() OVER (ORDER BY pos) AS rank, count(*) OVER () AS n FROM ({CLEAN_TARGETS}))
            SELECT CAST(rank AS INTEGER) AS rank, url AS line FROM t WHERE n <= 10 OR rank <= 8
            UNION ALL SELECT DISTINCT 9, concat('... and ', n - 8, ' more URLs') FROM t WHERE n > 10""",
        "report": f"""SELECT part, n_parts, url_status, count(*) AS n_rows FROM (
            SELECT url_status, (row_number() OVER (ORDER BY url_status, input_url) + 99) // 100 AS part,
              (count(*) OVER () + 99) // 100 AS n_parts FROM ({DIFF})) GROUP BY 1, 2, 3""",
        # content
        "content_history": f"SELECT url, ts, sha256(content) AS hash, length(content) AS n_chars FROM ({CONTENTS})",
        "last_known_record": f"""SELECT url, ts, sha256(content) AS hash FROM ({CONTENTS})
            QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC) = 1""",
        "records_for_url": f"SELECT url, ts, sha256(content) AS hash FROM ({CONTENTS})",
        "content_changes": f"""
            SELECT coalesce(o.url, n.url) AS url, CASE WHEN o.url IS NULL THEN 'new' WHEN n.url IS NULL THEN 'deleted'
              WHEN o.content = n.content THEN 'identical' ELSE 'changed' END AS change,
              sha256(o.content) AS old_hash, sha256(n.content) AS new_hash
            FROM (SELECT * FROM ({CONTENTS}) WHERE ts = 1) o FULL JOIN (SELECT * FROM ({CONTENTS}) WHERE ts = 2) n
              ON o.url = n.url""",
        "version_changes": f"""SELECT url, ts, CASE WHEN b IS NULL THEN 'new' WHEN b = content THEN 'identical'
            ELSE 'changed' END AS change
            FROM (SELECT *, lag(content) OVER (PARTITION BY url ORDER BY ts) AS b FROM ({CONTENTS}))""",
        "line_diff_counts": f"""
            WITH pairs AS (SELECT url FROM ({CONTENTS}) GROUP BY url HAVING count(*) = 2),
            l AS (SELECT url, ts, unnest({LINES}) AS line FROM ({CONTENTS}) WHERE url IN (SELECT url FROM pairs)),
            c AS (SELECT url, line, count(*) FILTER (ts = 2) - count(*) FILTER (ts = 1) AS net FROM l GROUP BY 1, 2),
            s AS (SELECT url, CAST(sum(greatest(net, 0)) AS BIGINT) AS a, CAST(sum(greatest(-net, 0)) AS BIGINT) AS d FROM c GROUP BY 1)
            SELECT pairs.url, coalesce(a, 0) AS lines_added, coalesce(d, 0) AS lines_deleted,
              coalesce(a, 0) = 0 AND coalesce(d, 0) = 0 AS is_identical FROM pairs LEFT JOIN s ON s.url = pairs.url""",
        # streams
        "stream_dedupe_urls": f"SELECT DISTINCT norm FROM ({normalized('SELECT url FROM pages')})",
        "stream_cap_per_pattern": f"""
            SELECT pattern, norm, pos FROM ({patterned(
                f"SELECT norm, min(page_id) AS pos FROM ({normalized('SELECT page_id, url FROM pages')}) GROUP BY 1",
                'preprocess', 'pos, norm')})
            QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY pos) <= 2""",
        "stream_url_inventory": INVENTORY,
        "stream_snapshots": EVERY_DIFF,
        "stream_progress": f"""SELECT count(*) AS n_written, count(*) AS n_processed, count(error) AS n_errors
            FROM ({PROBES})""",
        # whole job
        "inventory_scan": f"""
            SELECT p.input_url, r.root_target AS root_target_url, p.probe_id, p.error
            FROM ({last_probes(SCAN_FOUND, 'l.probe_id')}) p JOIN ({roots(
                SCAN_FOUND,
                norm_edges(f"SELECT page_id, tag_pos, page_url, link FROM ({PLAIN_LINKS}) WHERE in_scope"),
                SCAN_TARGETS)}) r ON r.url = p.input_url""",
    }
