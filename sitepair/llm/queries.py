"""One registered query for each training-data operator, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, language_id, licenses, mixing, near_dedup, quality_classifier, quality_rules, substring_dedup, topk, url_filter
from .common import read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
QUERY_EVERY = 50
WORD = r"[^\x20\x09-\x0D]+"


def op1_pfair_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"))


def op2_redirect_url_filter(spark, sf_dir):
    return url_filter.judge(read(spark, sf_dir, "pages"))


def redirect_classes(spark, sf_dir):
    """The URL filter with synthetic redirects, as the pages declare none: every page leads to the first of its four."""
    pages = read(spark, sf_dir, "pages")
    firsts = pages.select(F.col("page_id").alias("first"), F.col("url").alias("target_url"))
    moved = pages.select(F.col("url").alias("source_url"), F.expr("page_id div 4 * 4").alias("first")).join(firsts, "first")
    return url_filter.judge(pages, moved.select("source_url", "target_url"))


def op3_importance_resampling(spark, sf_dir):
    return quality_classifier.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_probminhash_near_dedup(spark, sf_dir):
    return near_dedup.classes(read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark, sf_dir):
    return substring_dedup.digests(read(spark, sf_dir, "documents"))


def op6_byte_bpe(spark, sf_dir):
    ranks = bpe.load_ranks(public_tokenizers.path(VOCABULARY))
    return bpe.encode_digests(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_hamming_topk(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0).withColumnRenamed("vec_id", "query_id"))


def op8_quality_rules(spark, sf_dir):
    judged = quality_rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_license_digests(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


def op10_cross_parsing_language(spark, sf_dir):
    return language_id.learn_and_identify(read(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_pfair_mixing, op2_redirect_url_filter, redirect_classes, op3_importance_resampling, op4_probminhash_near_dedup, op5_substring_dedup, op6_byte_bpe, op7_hamming_topk, op8_quality_rules, op9_license_digests, op10_cross_parsing_language, pipeline]
    return {f.__name__: f for f in own}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _url_sql(redirects: str = "") -> str:
    """``redirects``: a query of more edges ``(source_url, target_url)``."""

    def part(url: str, n: int) -> str:
        return f"coalesce(regexp_extract({url}, '{url_filter.ADDRESS}', {n}), '')"

    def host(url: str) -> str:
        return f"translate({part(url, 1)}, '{url_filter.UPPER}', '{url_filter.LOWER}')"

    def rule(url: str, field: int) -> str:
        cases = ""
        for verdict, rule_host, path in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2])):
            value = (rule_host + path, verdict)[field]
            cases += f" WHEN ({host(url)} = '{rule_host}' OR ends_with({host(url)}, '.{rule_host}')) AND starts_with({part(url, 2)}, '{path}') THEN '{value}'"
        return f"CASE{cases} END"

    def resolved(path: str) -> str:
        fold = f"""list_reduce(list_transform(string_split({path}, '/'), lambda x: [x]), lambda a, x: CASE WHEN x[1] = '..' THEN a[:greatest(len(a) - 1, 1)] WHEN x[1] = '.' THEN a ELSE list_concat(a, x) END)"""
        out = f"array_to_string({fold}, '/') || CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN '/' ELSE '' END"
        return f"CASE WHEN {path} IN ('', '/.', '/..') THEN '/' WHEN contains({path}, '/.') THEN {out} ELSE {path} END"

    def address(url: str) -> str:
        return f"CASE WHEN {host(url)} <> '' THEN {host(url)} || {resolved(part(url, 2))} || {part(url, 3)} END"

    def quoted(pattern: str) -> str:
        return pattern.replace("'", "''")

    def attribute(name: str) -> str:
        value = quoted(rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
        return " || ".join(f"regexp_extract(tag, '{value}', {i})" for i in (1, 2, 3))

    to = "t"
    for entity, character in url_filter.ENTITIES:
        to = f"replace({to}, '{entity}', '{quoted(character)}')"
    scheme = "'^[A-Za-z][A-Za-z0-9+.-]*"
    more = f" UNION ALL SELECT {address('source_url')}, {address('target_url')} FROM ({redirects})" if redirects else ""
    return rf"""
WITH RECURSIVE shown AS (SELECT url, regexp_replace(html, '{url_filter.HIDDEN}', ' ', 'g') AS html FROM pages),
tags AS (
  SELECT url, unnest(list_concat(regexp_extract_all(html, '{quoted(url_filter.CANONICAL)}', 1), regexp_extract_all(html, '{quoted(url_filter.REFRESH)}', 1))) AS tag FROM shown),
raw AS (SELECT url, CASE WHEN lower(tag[1:5]) = '<link' THEN {attribute("href")} ELSE regexp_extract({attribute("content")}, '{quoted(url_filter.MOVED)}', 1) END AS t FROM tags),
targets AS (SELECT url, trim(translate({to}, chr(9) || chr(13) || chr(10), '   ')) AS t FROM raw),
complete AS (
  SELECT url, CASE WHEN regexp_matches(t, {scheme}://') THEN t WHEN t = '' OR starts_with(t, '#') OR regexp_matches(t, {scheme}:') THEN NULL
    WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN 'http://' || {host("url")} || t WHEN starts_with(t, '?') THEN 'http://' || {host("url")} || {part("url", 2)} || t
    ELSE 'http://' || {host("url")} || '/' || regexp_replace(regexp_replace({part("url", 2)}, '^/', ''), '[^/]*$', '') || t END AS t FROM targets),
edges AS (SELECT {address("url")} AS u, {address("t")} AS v FROM complete{more}),
ties AS (SELECT DISTINCT u, v FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v),
reach AS (
  SELECT DISTINCT u AS a FROM ties WHERE {rule("'x://' || u", 1)} = 'block'
  UNION SELECT ties.v FROM reach JOIN ties ON ties.u = reach.a)
SELECT page_id, {host("url")} AS host, {part("url", 2)} AS path, {rule("url", 0)} AS rule,
  coalesce({rule("url", 1)}, CASE WHEN reach.a IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN {rule("url", 1)} IS NOT NULL THEN 'rule' WHEN reach.a IS NOT NULL THEN 'redirect_class' ELSE 'default' END AS via
FROM pages LEFT JOIN reach ON reach.a = {address("url")}
"""


def _substring_sql() -> str:
    n = substring_dedup.WINDOW
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w)),
o AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM g),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM o, (SELECT unnest(range(0, {n})) AS j) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _rules_sql() -> str:
    n = quality_rules.WINDOW
    stop = ", ".join(_quoted(w) for w in quality_rules.STOP_WORDS)
    met = " AND ".join(f"coalesce(CAST(({value}) AS DOUBLE) {how} {bound}, true)" for _, value, how, bound in quality_rules.THRESHOLDS)
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
l AS (SELECT doc_id, text, ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (SELECT unnest(range(0, {n})) AS j) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(ws, '')), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop_words FROM l LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {met} AS kept FROM b
"""


def _license_sql() -> str:
    def digest(text: str) -> str:
        out = f"regexp_replace(lower({text}), '{licenses.COPYRIGHT_LINE}', ' ', 'g')"
        for spelling, to in licenses.SPELLINGS:
            out = f"replace({out}, '{spelling}', '{to}')"
        pattern, to = licenses.VERSION
        out = f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
        return f"sha256(trim(regexp_replace({out}, '{licenses.PUNCTUATION}', ' ', 'g')))"

    values = ", ".join(f"({_quoted(name)}, {_quoted(body)})" for name, body in licenses.KNOWN)
    digests = ", ".join(f"('{value}', '{name}')" for name, value in licenses.DIGESTS)
    return f"""
WITH known AS (SELECT digest, min(license) AS license FROM (SELECT {digest("body")} AS digest, license FROM (VALUES {values}) v(license, body)
  UNION ALL SELECT * FROM (VALUES {digests}) v(digest, license)) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
notes AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM
  (SELECT doc_id, {digest("line")} AS digest FROM lines WHERE regexp_matches(lower(line), '{licenses.NAMES_A_LICENSE}')) JOIN known USING (digest) GROUP BY doc_id)
SELECT d.doc_id, d.digest, known.license, coalesce(notices, '') AS notices
FROM (SELECT doc_id, {digest("text")} AS digest FROM documents) d LEFT JOIN known USING (digest) LEFT JOIN notes ON notes.doc_id = d.doc_id
"""


def _topk_sql() -> str:
    return f"""
WITH p AS (SELECT q.vec_id AS query_id, b.vec_id,
  CAST(list_sum(list_transform(range(1, greatest(len(q.embedding), len(b.embedding)) + 1), lambda i: CASE WHEN (coalesce(q.embedding[i], 0) > 0) <> (coalesce(b.embedding[i], 0) > 0) THEN 1 ELSE 0 END)) AS BIGINT) AS distance
  FROM embeddings q, embeddings b WHERE q.vec_id % {QUERY_EVERY} = 0 AND q.embedding IS NOT NULL AND b.embedding IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= {topk.K}
"""


def oracle_sql() -> dict[str, str]:
    moved = "SELECT p.url AS source_url, f.url AS target_url FROM pages p JOIN pages f ON f.page_id = p.page_id // 4 * 4"
    return {"op2_redirect_url_filter": _url_sql(), "redirect_classes": _url_sql(moved), "op5_substring_dedup": _substring_sql(), "op7_hamming_topk": _topk_sql(), "op8_quality_rules": _rules_sql(), "op9_license_digests": _license_sql()}
