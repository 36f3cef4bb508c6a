"""SQL for DuckDB that gives the rows of the registered queries from the same tables."""

from __future__ import annotations

from ..functions.identity import INVALID, RESERVED
from ..functions.scalars import YAML_PATTERNS, YAML_WORDS, title_prefixes
from ..operators.verify import UNLINKED
from . import inputs, queries


def _quoted(values) -> str:
    return ", ".join("('" + v.replace("'", "''") + "')" for v in values)


_LANGS = "('en', 'fr', 'de', 'es')"


def _strip(x: str, suffixes) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({x}, '{s}') THEN left({x}, len({x}) - {len(s)})" for s in suffixes) + f" ELSE {x} END"


def _identity(source: str, two: bool = False) -> str:
    suffixes = inputs.CONFIG.url_pattern.suffixes
    locale = "CASE WHEN lang_prefix IN ('fr', 'de', 'es') THEN 'intl' ELSE 'en' END" if two else "CASE WHEN lang_prefix <> '' THEN lang_prefix ELSE 'en' END"
    return f"""
i0 AS ({source}),
i1 AS (SELECT *, string_split(rel_path, '/') AS ps, CASE WHEN string_split(rel_path, '/')[1] IN {_LANGS} THEN string_split(rel_path, '/')[1] ELSE '' END AS lang_prefix FROM i0),
i2 AS (SELECT *, {locale} AS locale, CASE WHEN lang_prefix <> '' THEN ps[2:] ELSE ps END AS tail FROM i1),
i3 AS (SELECT *, CASE WHEN len(tail) > 1 THEN tail[1] ELSE '' END AS section, coalesce(tail[-1], '') AS last, array_to_string(tail, '/') AS joined FROM i2),
i4 AS (SELECT *, CASE WHEN {_strip("last", suffixes)} = '' THEN 'index' ELSE {_strip("last", suffixes)} END AS slug,
  CASE WHEN lang_prefix = '' THEN '/' ELSE '' END || {_strip("joined", suffixes)} AS translation_key, '{inputs.BASE}/' || regexp_replace(rel_path, '\\.html$', '') AS source_url FROM i3),
i5 AS (SELECT *, array_to_string(list_filter(['content', lang_prefix, section, slug || '.md'], lambda x: x <> ''), '/') AS md_path,
  CASE section WHEN 's0' THEN CASE WHEN slug = 'index' THEN 'listing' ELSE 'article' END WHEN 's1' THEN CASE WHEN slug = 'index' THEN 'listing' ELSE 'event' END ELSE 'page' END AS page_type,
  regexp_replace(source_url, '^https://[^/]*', '') AS upath FROM i4),
i6 AS (SELECT *, list_filter(string_split(CASE WHEN ends_with(upath, '.html') THEN left(upath, len(upath) - 5) ELSE upath END, '/'), lambda x: x <> '') AS rs0 FROM i5),
i7 AS (SELECT *, CASE WHEN rs0[-1] = 'index' THEN rs0[:-2] ELSE rs0 END AS rs FROM i6),
ident AS (SELECT *, CASE WHEN len(rs) = 1 THEN '/' || rs[1] || '/' ELSE '/' || array_to_string(rs, '/') END AS route FROM i7)"""


_MIRROR = "SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) || '.html' AS rel_path, html FROM pages"
_SAFE = "safe AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(md_path) ORDER BY rel_path, page_id) AS r FROM ident) WHERE r = 1)"
_PAGES = f"WITH {_identity(_MIRROR)},\n{_SAFE}"


def _norm(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, '[#?].*$', '', 's'), '/+$', '')"
    return f"CASE WHEN {bare} = '' THEN '/' ELSE {bare} END"


def _inventory(two: bool) -> str:
    source = """SELECT page_id, html, p || '/s' || (n // 6) % 5 || '/' || n // 6 || '.html.html' AS rel_path FROM
  (SELECT page_id, html, regexp_extract(url, '/(en|fr|de|es)/([0-9]+)', 1) AS p, TRY_CAST(regexp_extract(url, '/(en|fr|de|es)/([0-9]+)', 2) AS BIGINT) AS n FROM pages) WHERE n IS NOT NULL"""
    locales = ["en", "intl"] if two else ["en", "fr", "de", "es"]
    has = ", ".join(f"bool_or(locale = '{x}') AS has_{x}" for x in locales)
    lens = ", ".join(f"CAST(coalesce(arg_max(CASE WHEN locale = '{x}' THEN len(html) END, CASE WHEN locale = '{x}' THEN row(rel_path, page_id) END), 0) AS BIGINT) AS text_len_{x}" for x in locales)
    everywhere = " AND ".join(f"has_{x}" for x in locales)
    return f"""WITH {_identity(source, two)},
{_SAFE},
f AS (SELECT translation_key, arg_min(section, row(rel_path, page_id)) AS section, arg_min(slug, row(rel_path, page_id)) AS slug, arg_min(page_type, row(rel_path, page_id)) AS suggested_type,
  CASE WHEN bool_or(section = 's2') THEN 'needs_rebuild' ELSE '' END AS flags, CAST(max(len(string_split(html, '<li')) - 1) AS BIGINT) AS image_count, {has}, {lens} FROM safe GROUP BY translation_key),
inv AS (SELECT *, '' AS final_type, CASE WHEN starts_with(translation_key, '/') THEN 'site_level' WHEN {everywhere} THEN 'paired' ELSE 'missing' END AS pair_status, '' AS suggested_pair, '' AS pair_evidence, '' AS notes FROM f)
"""


_DECLARATIONS = (
    _PAGES
    + f""",
n AS (SELECT count(*) AS n FROM pages),
e0 AS (SELECT page_id, (7 * page_id + 3) % n AS target_id FROM safe, n),
e AS (SELECT * FROM e0 UNION ALL SELECT target_id, page_id FROM e0 WHERE page_id % 2 = 0),
links AS (SELECT a.source_url, a.route AS source_route, a.translation_key AS source_key, a.locale AS source_locale,
  CASE WHEN e.page_id % 10 = 0 THEN 'x-default' ELSE coalesce(b.locale, 'en') END AS hreflang,
  coalesce(b.source_url, '{inputs.BASE}/gone/' || target_id) AS target_url, coalesce(b.route, '/gone/' || target_id) AS target_route
  FROM e JOIN safe a ON a.page_id = e.page_id LEFT JOIN safe b ON b.page_id = target_id),
keys AS (SELECT route, arg_max(translation_key, row(rel_path, page_id)) AS key FROM safe GROUP BY route),
j AS (SELECT links.*, key AS target_key, EXISTS (SELECT 1 FROM links x WHERE x.source_route = links.target_route AND x.target_route = links.source_route) AS reciprocal
  FROM links LEFT JOIN keys ON keys.route = links.target_route),
k AS (SELECT *, CASE WHEN target_key IS NULL THEN 'not_in_mirror' WHEN lower(hreflang) = 'x-default' THEN 'x_default' WHEN target_key = source_key THEN 'self_reference'
  WHEN starts_with(source_key, '/') OR starts_with(target_key, '/') THEN 'site_level' END AS r FROM j),
amb AS (SELECT target_key, source_locale FROM k WHERE r IS NULL GROUP BY ALL HAVING count(DISTINCT source_key) > 1),
hm AS (SELECT source_url, hreflang, target_url, coalesce(k.target_key, '') AS target_translation_key, k.target_key IS NOT NULL AS in_mirror, reciprocal,
  r IS NULL AND amb.target_key IS NULL AS usable, coalesce(r, CASE WHEN amb.target_key IS NOT NULL THEN 'ambiguous_target' END, '') AS reject_reason, source_key
  FROM k LEFT JOIN amb ON amb.target_key = k.target_key AND amb.source_locale = k.source_locale)
"""
)

_ORDER_SLUGS = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%m%d%Y') WHEN 2 THEN 'news-' || strftime(o_orderdate, '%d%m%Y') || 'x' ELSE 'n' || o_orderkey END AS slug,
  o_orderstatus AS locale, o_orderpriority || '-' || o_custkey % 50 AS section FROM orders"""


def _date(x: str) -> str:
    run = f"regexp_extract({x}, '[0-9]{{8}}')"
    tries = ", ".join(f"CASE WHEN year(try_strptime({run}, '{f}')) BETWEEN 1990 AND 2100 THEN CAST(try_strptime({run}, '{f}') AS DATE) END" for f in ("%Y%m%d", "%m%d%Y", "%d%m%Y"))
    return f"coalesce({tries})"


def _pad(x: str) -> str:
    return f"lpad(CAST({x} AS VARCHAR), 12, '0')"


def _titles() -> str:
    def squeeze(x: str) -> str:
        return rf"regexp_replace(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g')"

    out = "raw_title"
    for _ in range(3):
        for pattern in title_prefixes(["新聞", "News"]):
            out = f"regexp_replace({out}, '(?i){pattern}', '')"
        out = f"regexp_replace({out}, '^[ \\-–—|:：]+|[ \\-–—|:：]+$', '', 'g')"
    return f"""WITH t AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t FROM pages),
r AS (SELECT page_id, {squeeze("CASE page_id % 4 WHEN 0 THEN '2025/02/02 News: ' WHEN 1 THEN 'News 02/02/2025:' WHEN 2 THEN '02-02-2025新聞:' ELSE '' END || t")} AS raw_title FROM t)
SELECT page_id, raw_title, {out} AS title FROM r"""


_REFS = r"""refs AS (SELECT page_id, unnest(list_filter(list_concat(list_concat(regexp_extract_all(html, '\]\(([^)\s]+)\)', 1), regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*"([^"]*)"', 1)), regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*''([^'']*)''', 1)), lambda x: starts_with(x, '/') AND NOT starts_with(x, '//'))) AS ref FROM pages)"""


def _path_issue(x: str) -> str:
    reserved = ", ".join(f"'{r}'" for r in RESERVED)
    bad = INVALID.replace("\\\\", "\\\\")
    one = f"CASE WHEN upper(split_part(s, '.', 1)) IN ({reserved}) THEN 'reserved device name ''' || s || '''' WHEN regexp_matches(s, '{bad}') THEN 'invalid character in ''' || s || '''' WHEN regexp_matches(s, '[. ]$') THEN 'trailing dot/space in ''' || s || '''' END"
    return f"list_filter(list_transform(list_filter(string_split({x}, '/'), lambda s: s <> ''), lambda s: {one}), lambda x: x IS NOT NULL)[1]"


def _audit_sql() -> str:
    img = "chr(10) || '<img src=\"/media/p' || page_id % 7 || '.jpg\">'"
    refs = _REFS[_REFS.index("list_filter(") : _REFS.rindex(") AS ref")].replace("(html,", "(b,")
    route = "CASE WHEN rel = 'index' THEN '/' ELSE '/' || regexp_replace(rel, '/index$', '') END"
    return (
        _PAGES
        + f""",
p AS (SELECT page_id % 10 AS d, regexp_replace(md_path, '^content/', '') AS page, regexp_replace(regexp_replace(md_path, '^content/', ''), '\\.md$', '') AS rel, page_type, slug, html || {img} AS b FROM safe),
r AS (SELECT *, {_norm(route)} AS own FROM p),
good AS (SELECT * FROM r WHERE d NOT IN (0, 1, 3)),
refs AS (SELECT page, own, unnest({refs}) AS ref FROM good),
k AS (SELECT DISTINCT own AS route FROM r),
l AS (SELECT page, own, ref, CASE WHEN x.route IS NULL AND y.route IS NOT NULL THEN {_norm("url_decode(ref)")} ELSE {_norm("ref")} END AS route, x.route IS NOT NULL OR y.route IS NOT NULL AS found
  FROM refs LEFT JOIN k x ON x.route = {_norm("ref")} LEFT JOIN k y ON y.route = {_norm("url_decode(ref)")} WHERE NOT starts_with(ref, '/media/')),
audit AS (SELECT 'error' AS severity, page, 'invalid_frontmatter' AS kind, CASE WHEN d = 3 THEN 'unreadable' ELSE 'no frontmatter block' END AS detail FROM r WHERE d IN (0, 1, 3)
  UNION ALL SELECT 'error', page, 'missing_field', 'title' FROM good WHERE d = 2
  UNION ALL SELECT 'error', page, 'broken_link', ref FROM l WHERE NOT found
  UNION ALL SELECT 'warning', page, 'unlinked_page', '{UNLINKED}' FROM good WHERE page_type <> 'listing' AND NOT ((page = 'index.md' OR ends_with(page, '/index.md')) AND CASE WHEN own = '/' THEN 0 ELSE len(own) - len(replace(own, '/', '')) END <= 1)
    AND own NOT IN (SELECT route FROM l WHERE route <> own)
  UNION ALL SELECT CASE WHEN ref = '/media/p4.jpg' THEN 'warning' ELSE 'error' END, page, CASE WHEN ref = '/media/p4.jpg' THEN 'known_missing_media' ELSE 'missing_media' END, ref
    FROM refs WHERE starts_with(ref, '/media/') AND ref NOT IN ('/media/p0.jpg', '/media/p1.jpg', '/media/p2.jpg', '/media/p3.jpg'))
"""
    )


def _pair_sql() -> str:
    """Every heuristic's pairs, scored; ``_PAIR_TITLES`` is that of ``title_similarity``."""
    n, unit = len(queries.FALLBACK), 1_000_000

    def shared(name: str, value: str, rows: str, counted: bool = False) -> str:
        what = "CAST(count(*) AS VARCHAR)" if counted else "any_value(x.v)"
        return f"SELECT a, b, '{name}' AS name, {what} AS value FROM sides JOIN {rows} x ON x.key = a JOIN {rows} y ON y.key = b AND y.v = x.v{value} GROUP BY a, b"

    score = " + ".join(f"sum(CASE name WHEN '{h}' THEN {(n - i) * unit}{f' + least(CAST(value AS BIGINT), {unit - 1})' if h == 'shared_media' else ''} ELSE 0 END)" for i, h in enumerate(queries.FALLBACK))
    place = " ".join(f"WHEN '{h}' THEN {i}" for i, h in enumerate(queries.FALLBACK))
    shown = "CASE WHEN name <> 'title_similarity' THEN value WHEN CAST(value AS INT) >= 100 THEN '1.00' ELSE '0.' || lpad(value, 2, '0') END"
    return f"""WITH RECURSIVE pool AS (SELECT 'k' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS key, source AS section, lang AS locale, 'd-' || doc_id // 3 AS slug,
  ['m' || doc_id // 4, 'm' || doc_id // 6] AS media, lower(regexp_extract(text, '^[^.\\n]*')) AS t FROM documents),
declared AS (SELECT 'k' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS f, 'k' || lpad(CAST(doc_id - 1 AS VARCHAR), 9, '0') AS g, lang AS token FROM documents WHERE doc_id % 9 = 4),
said AS (SELECT least(f, g) AS a, greatest(f, g) AS b, coalesce(max(CASE WHEN f < g THEN token END), max(token)) AS value FROM declared GROUP BY 1, 2),
hreflang AS (SELECT a, b, 'hreflang' AS name, value FROM said JOIN pool x ON x.key = a JOIN pool y ON y.key = b WHERE x.locale <> y.locale),
sides AS (SELECT x.key AS a, y.key AS b FROM pool x JOIN pool y ON x.section = y.section AND x.key < y.key AND x.locale <> y.locale
  UNION SELECT a, b FROM hreflang),
slugs AS (SELECT key, lower(translate(slug, '-_ ', '')) AS v FROM pool WHERE translate(slug, '-_ ', '') <> ''),
days AS (SELECT key, strftime({_date("slug")}, '%Y-%m-%d') AS v FROM pool WHERE {_date("slug")} IS NOT NULL),
files AS (SELECT DISTINCT key, unnest(media) AS v FROM pool),
grams AS (SELECT key, t[i:i + 1] AS v, count(*) AS c FROM (SELECT key, t, unnest(range(1, len(t))) AS i FROM pool) GROUP BY ALL),
sizes AS (SELECT key, sum(c) AS n FROM grams GROUP BY key),
common AS (SELECT a, b, sum(least(x.c, y.c)) AS o FROM sides JOIN grams x ON x.key = a JOIN grams y ON y.key = b AND y.v = x.v GROUP BY a, b),
titles AS (SELECT a, b, 'title_similarity' AS name, CAST((400 * o + x.n + y.n) // (2 * (x.n + y.n)) AS VARCHAR) AS value
  FROM common JOIN sizes x ON x.key = a JOIN sizes y ON y.key = b WHERE 4 * o >= x.n + y.n),
each AS (SELECT * FROM hreflang UNION ALL {shared("slug_normalized", "", "slugs")} UNION ALL {shared("date", "", "days")}
  UNION ALL {shared("shared_media", "", "files", True)} UNION ALL SELECT * FROM titles),
scored AS (SELECT a, b, CAST({score} AS BIGINT) AS score, string_agg(name || '=' || {shown}, ';' ORDER BY CASE name {place} END) AS evidence, bool_or(name = 'hreflang') AS declared FROM each GROUP BY a, b),
candidates AS (SELECT scored.*, section FROM scored JOIN pool ON key = a)
"""


def _match_sql() -> str:
    """Keys in order, those with a declared partner first, take the best partner that is left."""
    return (
        _pair_sql()
        + """,
turns AS (SELECT *, row_number() OVER (ORDER BY declared DESC, a) AS turn FROM
  (SELECT a, declared, list(struct_pack(b := b, evidence := evidence) ORDER BY score DESC, b) AS options FROM
    (SELECT a, b, score, evidence, true AS declared FROM candidates WHERE declared UNION ALL SELECT a, b, score, evidence, false FROM candidates) GROUP BY a, declared)),
walk AS (SELECT CAST(0 AS BIGINT) AS turn, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS STRUCT(b VARCHAR, evidence VARCHAR)) AS won
  UNION ALL SELECT turn, CASE WHEN won IS NULL THEN taken ELSE list_concat(taken, [a, won.b]) END, a, won FROM
    (SELECT t.turn, w.taken, t.a, CASE WHEN NOT list_contains(w.taken, t.a) THEN list_filter(t.options, lambda x: NOT list_contains(w.taken, x.b))[1] END AS won
     FROM walk w JOIN turns t ON t.turn = w.turn + 1))
SELECT a, won.b AS b, won.evidence AS evidence FROM walk WHERE won IS NOT NULL"""
    )


def oracle_sql() -> dict[str, str]:
    status_cols = "suggested_type, flags, pair_status"
    inv = _inventory(False)
    out = {
        "page_identity": _PAGES + "SELECT page_id, rel_path, lang_prefix, locale, section, slug, source_url, translation_key, md_path, page_type FROM ident",
        "page_routes": _PAGES + f"SELECT page_id, route, {_norm('route')} AS normal, CAST(CASE WHEN {_norm('route')} IS NOT NULL AND route = '/' THEN 0 ELSE len(route) - len(replace(route, '/', '')) END AS BIGINT) AS depth FROM ident",
        "content_inventory": inv + "SELECT translation_key, section, slug, has_en, has_fr, has_de, has_es, suggested_type, final_type, flags, pair_status, suggested_pair, pair_evidence, text_len_en, text_len_fr, text_len_de, text_len_es, image_count, notes FROM inv",
        "content_inventory_two_locales": _inventory(True) + "SELECT translation_key, section, slug, has_en, has_intl, suggested_type, final_type, flags, pair_status, suggested_pair, pair_evidence, text_len_en, text_len_intl, image_count, notes FROM inv",
        "inventory_status_counts": inv + f"SELECT {status_cols}, count(*) AS n, max(image_count) AS max_images FROM inv GROUP BY {status_cols}",
        "single_locale_counts": inv + "SELECT CASE WHEN has_en THEN 'en' WHEN has_fr THEN 'fr' WHEN has_de THEN 'de' ELSE 'es' END AS locale, count(*) AS n FROM inv WHERE has_en::INT + has_fr::INT + has_de::INT + has_es::INT = 1 GROUP BY 1",
        "path_safety": _PAGES + f"SELECT md_path, {_path_issue('md_path')} AS issue, CASE WHEN len(md_path) + 251 > 259 THEN 'path length ' || (len(md_path) + 251) || ' exceeds classic Windows limit (260)' END AS length_issue FROM (SELECT md_path FROM ident UNION SELECT * FROM (VALUES {_quoted(queries.BAD_PATHS)}))",
        "path_collisions": _PAGES
        + """, m AS (SELECT page_id, rel_path, CASE WHEN page_id % 3 = 0 THEN upper(md_path) ELSE md_path END AS md_path FROM ident),
o AS (SELECT *, row_number() OVER w AS r, first_value(md_path) OVER w AS f FROM m WINDOW w AS (PARTITION BY lower(md_path) ORDER BY rel_path, page_id))
SELECT page_id, md_path, CASE WHEN f = md_path THEN 'duplicate output path (another source also maps to ''' || md_path || ''')' ELSE 'case-insensitive collision with ''' || f || '''' END AS issue FROM o WHERE r > 1""",
        "redirect_map": _PAGES + "SELECT source_url AS old_url, route AS new_path, locale AS lang, translation_key FROM safe",
        "redirect_rules": _PAGES + "SELECT DISTINCT upath AS old, 'location = ' || upath || ' { return 301 ' || route || '; }' AS nginx, upath || ' ' || route || ' 301' AS netlify FROM safe WHERE upath <> route",
        "page_titles": _titles(),
        "internal_links": f"WITH {_REFS} SELECT page_id, count(*) AS n_links, count(DISTINCT {_norm('ref')}) AS n_routes FROM refs GROUP BY page_id",
        "broken_links": _PAGES + f", {_REFS}, al AS (SELECT * FROM refs UNION ALL SELECT page_id, route || '?a=1#b' FROM safe) SELECT page_id, ref, {_norm('ref')} AS route FROM al WHERE {_norm('ref')} NOT IN (SELECT {_norm('route')} FROM safe) AND {_norm('url_decode(ref)')} NOT IN (SELECT {_norm('route')} FROM safe)",
        "unlinked_pages": _PAGES
        + f""", own AS (SELECT page_id, md_path AS page, {_norm("route")} AS route, page_type, slug FROM safe),
l AS (SELECT a.route AS self_route, b.route FROM own a JOIN own b ON b.page_id = (13 * a.page_id + 5) % (SELECT count(*) FROM pages))
SELECT page, route FROM own WHERE page_id % 17 <> 0 AND page_type <> 'listing' AND NOT (slug = 'index' AND CASE WHEN route = '/' THEN 0 ELSE len(route) - len(replace(route, '/', '')) END <= 1)
AND route NOT IN (SELECT route FROM own WHERE page_id % 17 = 0 AND false) AND route NOT IN (SELECT route FROM l WHERE route <> self_route)""",
        "hreflang_map": _DECLARATIONS + "SELECT * FROM hm",
        "hreflang_reject_counts": _DECLARATIONS + "SELECT reject_reason, count(*) AS n, CAST(sum(reciprocal::INT) AS BIGINT) AS n_reciprocal FROM hm GROUP BY 1",
        "hreflang_alternates": _DECLARATIONS + "SELECT source_key AS a, target_translation_key AS b, arg_min(hreflang, row(source_url, hreflang, target_url)) AS token FROM hm WHERE usable GROUP BY 1, 2",
        "slug_dates": f"SELECT o_orderkey, slug, {_date('slug')} AS day FROM ({_ORDER_SLUGS})",
        "pairs_by_date": f"WITH p AS (SELECT {_pad('o_orderkey')} AS key, section, locale, {_date('slug')} AS d FROM ({_ORDER_SLUGS})) SELECT a.key AS a, b.key AS b, strftime(a.d, '%Y-%m-%d') AS value FROM p a JOIN p b ON a.section = b.section AND a.d = b.d AND a.key < b.key AND a.locale <> b.locale",
        "pairs_by_slug": f"WITH p AS (SELECT {_pad('p_partkey')} AS key, p_type AS section, p_partkey % 2 AS locale, lower(translate(upper(p_brand) || '-' || p_size, '-_ ', '')) AS v FROM part) SELECT a.key AS a, b.key AS b, a.v AS value FROM p a JOIN p b ON a.section = b.section AND a.v = b.v AND a.key < b.key AND a.locale <> b.locale",
        "shared_media": f"WITH p AS (SELECT DISTINCT {_pad('l_orderkey')} AS key, l_orderkey % 20 AS section, l_orderkey // 20 % 2 AS locale, l_partkey AS m FROM lineitem) SELECT a.key AS a, b.key AS b, count(*) AS value FROM p a JOIN p b ON a.section = b.section AND a.m = b.m AND a.key < b.key AND a.locale <> b.locale GROUP BY 1, 2",
        "media_manifest": f"""WITH u AS (SELECT 'part' || l_partkey AS media, '{inputs.BASE}/files/part' || l_partkey || '?' || l_linenumber AS url, '{inputs.BASE}/o' || l_orderkey AS page, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS alt, {_pad("l_orderkey")} AS rel, lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || l_suppkey AS pos FROM lineitem)
SELECT media, arg_min(url, row(rel, pos)) AS original_url, string_agg(DISTINCT page, ' | ' ORDER BY page) AS referenced_by, coalesce(string_agg(DISTINCT alt, ' | ' ORDER BY alt), '') AS alt, coalesce(any_value(sha1(p_name)), '') AS sha1, coalesce(CAST(any_value(strlen(p_name)) AS VARCHAR), '') AS bytes
FROM u LEFT JOIN part ON 'part' || p_partkey = media GROUP BY media""",
        "title_similarity": """WITH t AS (SELECT 'k' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS key, source AS section, lang AS locale, lower(regexp_extract(text, '^[^.\\n]*')) AS t FROM documents),
g AS (SELECT key, section, locale, t[i:i + 1] AS g FROM (SELECT *, unnest(range(1, len(t))) AS i FROM t)),
c AS (SELECT key, section, locale, g, count(*) AS c FROM g GROUP BY ALL), n AS (SELECT key, sum(c) AS n FROM c GROUP BY key),
o AS (SELECT a.key AS a, b.key AS b, sum(least(a.c, b.c)) AS o FROM c a JOIN c b ON a.section = b.section AND a.g = b.g AND a.key < b.key AND a.locale <> b.locale GROUP BY 1, 2)
SELECT a, b, CAST((400 * o + x.n + y.n) // (2 * (x.n + y.n)) AS BIGINT) AS value FROM o JOIN n x ON x.key = a JOIN n y ON y.key = b WHERE 4 * o >= x.n + y.n""",
        "verify_audit": _audit_sql() + "SELECT * FROM audit",
        "verify_counters": _audit_sql()
        + """SELECT (SELECT count(*) FROM audit WHERE severity = 'error') AS errors, (SELECT count(*) FROM audit WHERE severity = 'warning') AS warnings, (SELECT count(*) FROM r) AS pages,
(SELECT count(*) FROM l) AS links, (SELECT count(*) FROM refs WHERE starts_with(ref, '/media/')) AS media_refs, false AS media_skipped""",
        "flag_counts": inv + "SELECT flags AS flag, count(*) AS n FROM inv WHERE flags <> '' GROUP BY 1",
        "pair_candidates": _pair_sql() + "SELECT * FROM candidates",
        "pair_suggestions": _match_sql(),
        "date_candidates": "SELECT CAST(d AS DATE) AS day, CAST(form AS INTEGER) AS form, CASE form WHEN 0 THEN strftime(d, '%m%d%Y') ELSE strftime(d, '%Y%m%d') END AS slug FROM generate_series(DATE '2024-01-01', DATE '2025-12-31', INTERVAL 1 DAY) t(d), (VALUES (0), (1)) f(form)",
        "orphan_hits": """WITH r0 AS (SELECT strftime(o_orderdate, '%Y%m%d') || CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 3 THEN 'A' ELSE 'B' END AS slug, o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 = 0),
r AS (SELECT slug, min(k) AS k, min(s) AS s FROM r0 GROUP BY slug), ok AS (SELECT slug FROM r WHERE s <> 'O'),
base AS (SELECT unnest([strftime(d, '%m%d%Y'), strftime(d, '%Y%m%d')]) AS slug FROM generate_series(DATE '1990-01-01', DATE '2000-12-31', INTERVAL 1 DAY) t(d)),
b AS (SELECT DISTINCT slug FROM base WHERE slug IN (SELECT slug FROM ok) AND slug NOT IN (SELECT strftime(o_orderdate, '%Y%m%d') FROM orders WHERE o_orderkey % 50 = 0)),
t AS (SELECT b.slug, p, b.slug || l AS probe, b.slug || l IN (SELECT slug FROM ok) AS hit FROM b, (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D')) v(p, l)),
m AS (SELECT *, min(CASE WHEN NOT hit THEN p END) OVER (PARTITION BY slug) AS miss FROM t)
SELECT slug FROM b UNION ALL SELECT probe FROM m WHERE hit AND (miss IS NULL OR p < miss)""",
        "orphan_hits_all_orders": """WITH r0 AS (SELECT strftime(o_orderdate, '%Y%m%d') || CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 3 THEN 'A' ELSE 'B' END AS slug, o_orderkey AS k, o_orderstatus AS s FROM orders),
r AS (SELECT slug, min(k) AS k, min(s) AS s FROM r0 GROUP BY slug), ok AS (SELECT slug FROM r WHERE s <> 'O'),
base AS (SELECT unnest([strftime(d, '%m%d%Y'), strftime(d, '%Y%m%d')]) AS slug FROM generate_series(DATE '1990-01-01', DATE '2000-12-31', INTERVAL 1 DAY) t(d)),
b AS (SELECT DISTINCT slug FROM base WHERE slug IN (SELECT slug FROM ok) AND slug NOT IN (SELECT strftime(o_orderdate, '%Y%m%d') FROM orders WHERE o_orderkey % 50 = 0)),
t AS (SELECT b.slug, p, b.slug || l AS probe, b.slug || l IN (SELECT slug FROM ok) AS hit FROM b, (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D')) v(p, l)),
m AS (SELECT *, min(CASE WHEN NOT hit THEN p END) OVER (PARTITION BY slug) AS miss FROM t)
SELECT slug FROM b UNION ALL SELECT probe FROM m WHERE hit AND (miss IS NULL OR p < miss)""",
        "fetch_plan": _PAGES + "SELECT lang_prefix, slug FROM (SELECT DISTINCT slug FROM safe), (VALUES ('en'), ('fr'), ('de'), ('es')) v(lang_prefix) EXCEPT SELECT lang_prefix, slug FROM safe",
        "mirror_slugs": inv + "SELECT DISTINCT lang_prefix, split_part(string_split(rel_path, '/')[-1], '.', 1) AS slug FROM safe WHERE section = 's1'",
        "stale_outputs": _PAGES + "SELECT md_path FROM safe EXCEPT SELECT md_path FROM safe WHERE page_id % 5 <> 0",
        "csv_fields": f"SELECT value, CASE WHEN regexp_matches(value, '^[=+\\-@\\t\\r]') THEN '''' || value ELSE value END AS guarded FROM (SELECT CASE doc_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '-' ELSE '' END || split_part(text, chr(10), 1) AS value FROM documents UNION SELECT * FROM (VALUES {_quoted(queries.SCALARS)}))",
        "csv_texts": f"SELECT value, CASE WHEN regexp_matches(value, '^[=+\\-@\\t\\r]') THEN '''' || value ELSE value END AS guarded FROM (SELECT CASE doc_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '-' ELSE '' END || text AS value FROM documents UNION SELECT * FROM (VALUES {_quoted(queries.SCALARS)}))",
        "yaml_quoting": f"SELECT value, lower(value) IN ({', '.join(repr(w) for w in YAML_WORDS)}) OR {' OR '.join(f"regexp_matches(value, '{p}')" for p in YAML_PATTERNS)} AS quoted, lower(translate(value, '-_ ', '')) AS folded FROM (SELECT * FROM (VALUES {_quoted(queries.SCALARS)}) v(value) UNION SELECT p_name FROM part UNION SELECT slug FROM ({_ORDER_SLUGS}))",
        "media_paths": rf"""WITH u AS (SELECT * FROM (VALUES {_quoted(queries.MEDIA_URLS)}) v(url)), r AS (SELECT url, regexp_replace(url_decode(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '^/+', '') AS rel FROM u),
s AS (SELECT url, CASE WHEN rel <> '' AND NOT list_has_any(string_split(replace(rel, '\', '/'), '/'), ['.', '..']) THEN rel END AS rel FROM r)
SELECT url, rel, '/media/' || array_to_string(list_transform(string_split(rel, '/'), lambda x: url_encode(x)), '/') AS web FROM s""",
    }
    return out
