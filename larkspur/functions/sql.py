"""The scalar functions as SQL functions, for use from spark.sql: their bodies are SQL, so Catalyst plans through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from larkspur.functions.robots import FIELD, LINE, VALUE
from larkspur.functions.text import DOC_TOKENS, LOWER, MARKED, MOST_LINKS, TOKEN_BYTES, UPPER
from larkspur.functions.urls import MOST_BYTES

_WS = r"[ \\t\\n\\x0B\\f\\r]"
_URL = "(?i)^(https?)://([^/?#]+)([^#]*)"
_HOST = f"translate(regexp_extract(u, '{_URL}', 2), '{UPPER}', '{LOWER}')"
_SCHEME = f"lower(regexp_extract(u, '{_URL}', 1))"
_REST = f"regexp_extract(u, '{_URL}', 3)"
_BASE = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^#]*)"
_MARKED = "|".join(rf"{a}[\s\S]*?(?:{b}|\z)" for a, b, _ in MARKED)
_BLANK = r" \\t\\x0B\\f\\r"
_RULE = f"(?s)^[{_BLANK}]*([^:{_BLANK}][^:]{{0,{FIELD - 1}}}):[{_BLANK}]*([^{_BLANK}].{{0,{VALUE - 1}}})"

BODIES = {
    "ascii_tokens(t STRING) RETURNS ARRAY<STRING>": f"transform(regexp_extract_all(substring_index(t, char(0), 1), '[A-Za-z0-9]+', 0), x -> lower(substring(x, 1, {TOKEN_BYTES})))",
    "unicode_tokens(t STRING) RETURNS ARRAY<STRING>": (
        f"transform(slice(regexp_extract_all(substring_index(t, char(0), 1), '[A-Za-z0-9_\\\\-\\\\x{{80}}-\\\\x{{10FFFF}}]+', 0), 1, {DOC_TOKENS}), x -> translate(x, '{UPPER}', '{LOWER}'))"
    ),
    "collapsed(t STRING) RETURNS STRING": f"trim(regexp_replace(t, '{_WS}+', ' '))",
    "html_title(h STRING) RETURNS STRING": "collapsed(regexp_extract(h, '(?i)<title\\\\b[^>]*>([\\\\s\\\\S]*?)</title>', 1))",
    "html_text(h STRING) RETURNS STRING": (
        "collapsed(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(h, '(?i)<script\\\\b[^>]*>[\\\\s\\\\S]*?</script>', ' '), "
        "'(?i)<style\\\\b[^>]*>[\\\\s\\\\S]*?</style>', ' '), '<[^>]*>?|>', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '\\''))"
    ),
    "html_links(h STRING) RETURNS ARRAY<STRING>": f"slice(filter(regexp_extract_all(h, '(?i)href{_WS}*={_WS}*[\"\\']([^\"\\']+)[\"\\']', 1), x -> NOT startswith(x, '#')), 1, {MOST_LINKS})",
    "url_canonical(u STRING) RETURNS STRING": (
        f"CASE WHEN u RLIKE '{_URL}' THEN transform(array(concat({_SCHEME}, '://', CASE WHEN startswith({_HOST}, '[') AND length({_HOST}) >= 2 THEN {_HOST} "
        f"WHEN {_SCHEME} = 'http' THEN regexp_replace({_HOST}, ':80$', '') ELSE regexp_replace({_HOST}, ':443$', '') END, "
        f"CASE WHEN {_REST} = '' THEN '/' ELSE {_REST} END)), x -> CASE WHEN octet_length(x) <= {MOST_BYTES} THEN x END)[0] END"
    ),
    "url_steps(p STRING) RETURNS STRING": (
        "transform(array(filter(split(p, '/'), s -> s <> '' AND s <> '.')), steps -> transform(array(aggregate(steps, CAST(array() AS ARRAY<STRING>), "
        "(done, s) -> CASE WHEN s = '..' THEN slice(done, 1, greatest(size(done) - 1, 0)) ELSE concat(done, array(s)) END)), "
        "done -> concat(CASE WHEN startswith(p, '/') THEN '/' ELSE '' END, array_join(done, '/'), "
        "CASE WHEN coalesce(try_element_at(steps, -1) = '..', false) AND size(done) > 0 THEN '/' ELSE '' END))[0])[0]"
    ),
    "url_resolve(b STRING, r STRING) RETURNS STRING": (
        f"CASE WHEN r IS NULL OR r = '' THEN NULL WHEN r RLIKE '(?i)^https?://' THEN url_canonical(r) WHEN startswith(r, '//') THEN url_canonical(concat(regexp_extract(b, '{_BASE}', 1), ':', r)) "
        f"ELSE url_canonical(concat(regexp_extract(b, '{_BASE}', 1), '://', regexp_extract(b, '{_BASE}', 2), coalesce(nullif(url_steps(substring_index("
        f"CASE WHEN startswith(r, '#') THEN substring_index(regexp_extract(b, '{_BASE}', 3), '?', 1) WHEN startswith(r, '?') THEN concat(substring_index(regexp_extract(b, '{_BASE}', 3), '?', 1), r) "
        f"WHEN startswith(r, '/') THEN r ELSE concat(regexp_extract(substring_index(regexp_extract(b, '{_BASE}', 3), '?', 1), '^(.*/)', 1), r) END, '#', 1)), ''), '/'))) END"
    ),
    "text_segments(t STRING) RETURNS ARRAY<STRUCT<index: INT, kind: STRING, start: BIGINT, length: BIGINT>>": (
        rf"aggregate(transform(filter(split(regexp_replace(translate(t, char(1), ' '), r'({_MARKED})', concat(char(1), '$1', char(1))), char(1)), x -> length(x) > 0), "
        r"(x, i) -> named_struct('index', CAST(i AS INT), 'kind', CASE WHEN startswith(x, '```') THEN 'code' WHEN startswith(x, '$$') OR startswith(x, r'\[') OR startswith(x, r'\(') THEN 'latex' ELSE 'text' END, "
        "'length', CAST(octet_length(x) AS BIGINT))), CAST(array() AS ARRAY<STRUCT<index: INT, kind: STRING, start: BIGINT, length: BIGINT>>), "
        "(done, s) -> concat(done, array(named_struct('index', s.index, 'kind', s.kind, 'start', coalesce(try_element_at(done, -1).start + try_element_at(done, -1).length, 0L), 'length', s.length))))"
    ),
    # Bytes as characters, so that lengths and cuts are those of bytes.
    "bytewise(t STRING) RETURNS STRING": "decode(encode(t, 'UTF-8'), 'ISO-8859-1')",
    "robots_allows(p STRING, body STRING, agent STRING) RETURNS BOOLEAN": (
        "CASE WHEN p IS NULL OR body IS NULL THEN true ELSE aggregate(transform(split(bytewise(body), char(10)), raw -> transform(array(substring_index(substring(raw, 1, "
        f"{LINE}), '#', 1)), l -> named_struct('field', translate(regexp_extract(l, '{_RULE}', 1), '{UPPER}', '{LOWER}'), 'value', regexp_extract(l, '{_RULE}', 2)))[0]), "
        "named_struct('active', false, 'allowed', true, 'size', -1), (s, f) -> CASE "
        f"WHEN f.field = 'user-agent' THEN named_struct('active', translate(f.value, '{UPPER}', '{LOWER}') = translate(bytewise(coalesce(nullif(agent, ''), '*')), '{UPPER}', '{LOWER}') OR f.value = '*', 'allowed', s.allowed, 'size', s.size) "
        "WHEN s.active AND f.value <> '' AND startswith(bytewise(p), f.value) AND (f.field = 'allow' AND length(f.value) >= s.size OR f.field = 'disallow' AND length(f.value) > s.size) "
        "THEN named_struct('active', s.active, 'allowed', f.field = 'allow', 'size', length(f.value)) ELSE s END, s -> s.allowed) END"
    ),
    "url_allowed(u STRING) RETURNS BOOLEAN": (
        "coalesce(regexp_extract(u, '^https?://([^/?#]*)', 1) <> '' AND NOT contains(regexp_extract(u, '^https?://([^/?#]*)', 1), '@') "
        "AND NOT regexp_extract(u, '^https?://([^/?#]*)', 1) RLIKE '^(localhost|127[.]0[.]0[.]1|0[.]0[.]0[.]0|\\\\[::1\\\\]|169[.]254[.]169[.]254)(:|$)', false)"
    ),
    "truth_class(sources BIGINT, conflicts BIGINT) RETURNS STRING": (
        "CASE WHEN sources IS NULL OR sources = 0 THEN 'UNKNOWN' WHEN conflicts >= greatest(sources, 1) THEN 'CONFLICTED' WHEN conflicts > 0 THEN 'UNCERTAIN' "
        "WHEN sources >= 2 THEN 'FACT' ELSE 'INFERENCE' END"
    ),
}


#: Table functions, for use with LATERAL.
TABLES = {
    "page_links(h STRING) RETURNS TABLE(nth INT, link STRING)": "SELECT n, x FROM (SELECT html_links(h) AS l) LATERAL VIEW posexplode(l) e AS n, x",
    "segments_of(t STRING) RETURNS TABLE(index INT, kind STRING, start BIGINT, length BIGINT)": "SELECT s.index, s.kind, s.start, s.length FROM (SELECT text_segments(t) AS l) LATERAL VIEW explode(l) e AS s",
    "tokens_of(t STRING) RETURNS TABLE(nth INT, token STRING)": "SELECT n, x FROM (SELECT ascii_tokens(t) AS l) LATERAL VIEW posexplode(l) e AS n, x",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions, scalar and table ones, for this session; returns their names."""
    for head, body in {**BODIES, **TABLES}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.partition("(")[0] for head in [*BODIES, *TABLES]]
