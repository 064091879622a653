"""The same queries in DuckDB's SQL, over views named as the tables."""

from __future__ import annotations

from larkspur.plans import catalogue as c

DOCS = "(SELECT doc_id, text FROM documents WHERE doc_id <> 0)"
ASCII = "list_transform(regexp_extract_all({x}, '[A-Za-z0-9]+'), lambda t: lower(substr(t, 1, 127)))"
UNICODE = "list_transform(list_slice(regexp_extract_all({x}, '[A-Za-z0-9_\\-\\x{{80}}-\\x{{10FFFF}}]+'), 1, {n}), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
WS = "[ \\t\\n\\x0B\\f\\r]+"


def ascii_(x: str) -> str:
    return ASCII.format(x=x)


def unicode_(x: str, n: int = 1024) -> str:
    return UNICODE.format(x=x, n=n)


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'), ' ')"


def title(x: str) -> str:
    return collapsed(f"regexp_extract({x}, '(?i)<title\\b[^>]*>([\\s\\S]*?)</title>', 1)")


def page_text(x: str) -> str:
    for name in ("script", "style"):
        x = f"regexp_replace({x}, '(?i)<{name}\\b[^>]*>[\\s\\S]*?</{name}>', ' ', 'g')"
    x = f"regexp_replace({x}, '<[^>]*>?|>', ' ', 'g')"
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        x = f"replace({x}, '{a}', '{b}')"
    return collapsed(x)


def links(x: str) -> str:
    found = f"regexp_extract_all({x}, '(?i)href[ \\t\\n\\x0B\\f\\r]*=[ \\t\\n\\x0B\\f\\r]*[\"'']([^\"'']+)[\"'']', 1)"
    return f"list_slice(list_filter({found}, lambda x: NOT starts_with(x, '#')), 1, 2048)"


def canonical(x: str) -> str:
    pattern = "(?i)^(https?)://([^/?#]+)([^#]*)"
    scheme, host, rest = (f"regexp_extract({x}, '{pattern}', {i})" for i in (1, 2, 3))
    host = f"translate({host}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    plain = f"CASE WHEN starts_with({host}, '[') THEN {host} WHEN lower({scheme}) = 'http' THEN regexp_replace({host}, ':80$', '') ELSE regexp_replace({host}, ':443$', '') END"
    return f"CASE WHEN regexp_matches({x}, '{pattern}') THEN lower({scheme}) || '://' || {plain} || CASE WHEN {rest} = '' THEN '/' ELSE {rest} END END"


def index_sql(source: str, tokens: str, distinct: bool = False, extra: str = "") -> str:
    """Common table expressions: d (id, tokens, ...), p (term, id, tf), s (n, avgdl is left to the caller)."""
    each = "list_distinct(t)" if distinct else "t"
    return f"d AS (SELECT id{extra}, {tokens} AS t FROM {source}), p AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest({each}) AS term FROM d) GROUP BY 1, 2)"


DOC_ROWS = "(SELECT doc_id AS id, text FROM documents WHERE doc_id <> 0)"


def bm25(with_: str, query: str, profile: str = "ascii", active: str = "TRUE", boost: str = "", k1: float = 1.2, b: float = 0.75) -> str:
    terms = ascii_(f"'{query}'") if profile == "ascii" else f"list_distinct({unicode_(chr(39) + query + chr(39), 128)})"
    tf = "p.tf" if profile == "ascii" else "1"
    return f"""{with_}, q AS (SELECT term, count(*) AS times FROM (SELECT unnest({terms}) AS term) GROUP BY 1),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT count(*) AS n, sum(CASE WHEN {active} THEN len(t) ELSE 0 END) / CAST(count(*) AS DOUBLE) AS avgdl FROM d),
r AS (SELECT d.id, round(sum(q.times * (ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * {tf} * {k1 + 1} / ({tf} + {k1} * ({1 - b} + {b} * len(d.t) / s.avgdl)){boost})), 6) AS score
      FROM p JOIN q USING (term) JOIN f USING (term) JOIN d ON d.id = p.id, s WHERE {active} GROUP BY d.id)
"""


def top(cte: str, k: int = 10) -> str:
    return f"WITH {cte} SELECT id AS doc_id, score FROM r WHERE score > 0 ORDER BY score DESC, id LIMIT {k}"


NATIVE = index_sql(DOC_ROWS, ascii_("text"))
BINARY = index_sql(DOC_ROWS, unicode_("text"), True)
PAGE_ROWS = f"(SELECT page_id AS id, url, {title('html')} AS title, {page_text('html')} AS text FROM pages WHERE page_id <> 0)"
PAGES = index_sql(PAGE_ROWS, ascii_("text"), extra=f", {ascii_('title')} AS tt, {ascii_('url')} AS ut")
PAGES_BINARY = index_sql(PAGE_ROWS, unicode_("text"), True, ", url, title")

FTS_WORDS = f"list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: translate(w, '{c.fts.ACCENTED}', '{c.fts.PLAIN}'))"
FTS = f"w AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS word FROM (SELECT doc_id, {FTS_WORDS} AS ws FROM documents WHERE doc_id <> 0))"

MARK = "chr(1)"
SEGMENTS = (
    "list_filter(string_split(regexp_replace({x}, '((?:```[\\s\\S]*?(?:```|\\z))|(?:\\$\\$[\\s\\S]*?(?:\\$\\$|\\z))|(?:\\\\\\[[\\s\\S]*?(?:\\\\\\]|\\z))|(?:\\\\\\([\\s\\S]*?(?:\\\\\\)|\\z)))', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda s: len(s) > 0)"
)
KIND = "CASE WHEN starts_with(s, '```') THEN 'code' WHEN starts_with(s, '$$') OR starts_with(s, '\\[') OR starts_with(s, '\\(') THEN 'latex' ELSE 'text' END"


def resolved(base: str, ref: str) -> str:
    """Resolution as nested selects: r(base, ref) to target."""
    return f"""
p AS (
  SELECT *, lower(regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
         regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS authority,
         string_split(regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1), '?')[1] AS path
  FROM l
), j AS (
  SELECT *, string_split(CASE WHEN starts_with({ref}, '#') THEN path WHEN starts_with({ref}, '?') THEN path || {ref}
              WHEN starts_with({ref}, '/') THEN {ref} ELSE regexp_extract(path, '^(.*/)', 1) || {ref} END, '#')[1] AS joined
  FROM p
), k AS (
  SELECT *, list_filter(string_split(joined, '/'), lambda s: s <> '' AND s <> '.') AS steps FROM j
), n AS (
  SELECT *, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(steps, lambda s: [s])),
                        lambda a, s: CASE WHEN s[1] = '..' THEN a[1:greatest(len(a) - 1, 0)] ELSE list_concat(a, s) END) AS stack FROM k
), u AS (
  SELECT *, CASE WHEN {ref} = '' THEN NULL WHEN regexp_matches({ref}, '(?i)^https?://') THEN {ref} WHEN starts_with({ref}, '//') THEN scheme || ':' || {ref}
            ELSE scheme || '://' || authority || coalesce(nullif(CASE WHEN starts_with(joined, '/') THEN '/' ELSE '' END || coalesce(array_to_string(stack, '/'), '')
              || CASE WHEN len(steps) > 0 AND steps[-1] = '..' AND len(stack) > 0 THEN '/' ELSE '' END, ''), '/') END AS whole
  FROM n
), t AS (SELECT *, {canonical("whole")} AS target FROM u)"""


LINKS = f"l0 AS (SELECT page_id, url, {links('html')} AS ls FROM pages), l AS (SELECT page_id, url, generate_subscripts(ls, 1) - 1 AS nth, unnest(ls) AS ref FROM l0), {resolved('url', 'ref')}"
ARRIVALS = f"{LINKS}, a AS (SELECT page_id * 10000 + nth AS seq, target AS url, CAST(page_id % 3 AS INTEGER) AS depth FROM t WHERE target IS NOT NULL)"
DEDUP = "x AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS k FROM a)"

NODES = "v AS (SELECT n_nationkey + 1000 AS id, 5 AS kind FROM nation UNION ALL SELECT s_suppkey + 1000000, 1 FROM supplier WHERE s_acctbal >= 0)"
EDGES = "e AS (SELECT s_suppkey + 1 AS id, s_suppkey + 1000000 AS src, CASE WHEN s_suppkey % 11 = 0 THEN s_suppkey + 1000000 ELSE s_nationkey + 1000 END AS dst, CAST(s_suppkey % 8 AS INTEGER) AS kind, s_acctbal AS weight FROM supplier)"
CLAIMS = "(SELECT l.*, d.source, d.lang FROM labels l JOIN documents d USING (doc_id))"
EVIDENCE = """(SELECT doc_id, CAST(doc_id % 6 AS INTEGER) AS kind, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS source,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS claim,
  CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'zero' ELSE 'hash' END AS hash, doc_id % 8 <> 0 AS verified FROM documents)"""
TELEMETRY = "(SELECT event_type AS name, event_id % 1000 AS duration_ms, CAST(floor(value) AS BIGINT) AS bytes_in, CAST(json_extract_string(props, '$.k') AS BIGINT) AS bytes_out, event_type = 'error' AS error, event_id FROM events)"
COUNTERS = "count(*) AS events, CAST(sum(CAST(error AS INTEGER)) AS BIGINT) AS errors, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(coalesce(sum(bytes_out), 0) AS BIGINT) AS bytes_out"
KEYWORDS = ", ".join(f"('{d}', '{k}', {w})" for d, k, w in c.KEYWORDS)
ROBOTS = ", ".join(f"({i}, {str(x[3]).upper()})" for i, x in enumerate(c.ROBOTS))


ARRIVING = "(SELECT id, arg_min(text, seq) AS text FROM (SELECT doc_id AS seq, doc_id // 2 AS id, text FROM documents WHERE doc_id % 9 <> 4 AND doc_id // 2 <> 0 AND text IS NOT NULL) GROUP BY id)"


def fts_words(x: str) -> str:
    return FTS_WORDS.replace("lower(text)", f"lower(coalesce({x}, ''))")


#: One event of each queue after another: the state is the list of what waits.
QUEUE = f"""
WITH RECURSIVE {ARRIVALS}, e AS (
  SELECT CAST((seq // 10000) % 7 AS VARCHAR) AS queue, row_number() OVER (PARTITION BY (seq // 10000) % 7 ORDER BY seq) AS n, seq, seq % 5 = 3 AS pop, url, depth FROM a
), s(queue, n, q, seq, op, url, depth, decision) AS (
  SELECT DISTINCT queue, CAST(0 AS BIGINT), CAST([] AS STRUCT(u VARCHAR, d INTEGER)[]), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR) FROM e
  UNION ALL
  SELECT e.queue, e.n, CASE WHEN e.pop THEN s.q[2:] WHEN len(s.q) < 16 AND NOT list_contains(list_transform(s.q, lambda x: x.u), e.url) THEN list_append(s.q, {{'u': e.url, 'd': e.depth}}) ELSE s.q END,
    e.seq, CASE WHEN e.pop THEN 'pop' ELSE 'enqueue' END, CASE WHEN e.pop THEN s.q[1].u ELSE e.url END, CASE WHEN e.pop THEN s.q[1].d ELSE e.depth END,
    CASE WHEN e.pop THEN CASE WHEN len(s.q) = 0 THEN 'EMPTY' ELSE 'ALLOW' END WHEN len(s.q) >= 16 THEN 'FRONTIER_FULL' WHEN list_contains(list_transform(s.q, lambda x: x.u), e.url) THEN 'DUPLICATE' ELSE 'ALLOW' END
  FROM s JOIN e ON e.queue = s.queue AND e.n = s.n + 1
)
SELECT queue, seq, op, url, depth, decision FROM s WHERE n > 0
"""


def fts_cover() -> str:
    """Covers of all words: of stretches between two occurrences that hold all, those that hold no other."""
    last = ", ".join(f"max(CASE WHEN word = '{t}' THEN pos END) OVER o AS l{i}" for i, t in enumerate(c.COVER))
    names = [f"l{i}" for i in range(len(c.COVER))]
    words_ = ", ".join(f"'{t}'" for t in c.COVER)
    return (
        f"WITH a AS (SELECT doc_id, {fts_words('source')} AS s, {fts_words('text')} AS t FROM documents WHERE doc_id <> 0), "
        "w AS (SELECT doc_id, len(s) AS k, unnest(s || t) AS word, generate_subscripts(s || t, 1) AS pos FROM a), "
        f"f AS (SELECT doc_id, pos, word, CASE WHEN pos <= k THEN 1.0 ELSE 10.0 END AS inv FROM w WHERE word IN ({words_})), "
        f"r AS (SELECT *, {last} FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY pos)), "
        f"p AS (SELECT doc_id, least({', '.join(names)}) AS a, min(pos) AS b FROM r WHERE {' AND '.join(f'{n} IS NOT NULL' for n in names)} GROUP BY 1, 2), "
        "x AS (SELECT p.doc_id, p.a, p.b, count(*) AS n, sum(f.inv) AS inv FROM p JOIN f ON f.doc_id = p.doc_id AND f.pos BETWEEN p.a AND p.b GROUP BY 1, 2, 3) "
        "SELECT doc_id, round(sum(n / inv / (1 + b - a - (n - 1))), 6) AS score FROM x GROUP BY 1"
    )


def fts_rank() -> str:
    """Phrases of one or two words, weights 10 and 1."""

    def times(ws: str, p: list[str]) -> str:
        return f"len(list_filter(range(1, len({ws}) + {2 - len(p)}), lambda i: " + " AND ".join(f"{ws}[i + {k}] = '{w}'" for k, w in enumerate(p)) + "))"

    n = range(len(c.RANK_PHRASES))
    counts = ", ".join(f"{times('a', p)} AS a{i}, {times('b', p)} AS b{i}" for i, p in enumerate(c.RANK_PHRASES))
    stats = ", ".join(f"greatest(1e-6, ln((count(*) - count(*) FILTER (a{i} + b{i} > 0) + 0.5) / (count(*) FILTER (a{i} + b{i} > 0) + 0.5))) AS idf{i}" for i in n)
    part = " + ".join(f"idf{i} * (10.0 * a{i} + b{i}) * 2.2 / (10.0 * a{i} + b{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in n)
    return (
        f"WITH w AS (SELECT doc_id, {fts_words('source')} AS a, {fts_words('text')} AS b FROM documents WHERE doc_id <> 0), "
        f"h AS (SELECT doc_id, CAST(len(a) + len(b) AS DOUBLE) AS size, {counts} FROM w), s AS (SELECT avg(size) AS mean, {stats} FROM h) "
        f"SELECT doc_id, round(-({part}), 6) AS score FROM h, s WHERE {' OR '.join(f'a{i} + b{i} > 0' for i in n)} ORDER BY score, doc_id LIMIT 10"
    )


def world(depth: int = 3) -> str:
    """w: the pages; m (url, depth): all URLs that are reached; x: those with pages; i (in order): what is indexed."""
    page = (
        "SELECT s_suppkey AS k, 'http://world.example/s/' || s_suppkey AS url, s_name, s_suppkey % 7 <> 5 AS ok, s_suppkey * 3 AS took, "
        "CASE WHEN s_suppkey % 11 = 9 THEN NULL WHEN s_suppkey % 5 = 4 THEN 'http://moved.example' ELSE 'http://world.example' END AS host, "
        "strlen('<title>' || s_name || '</title><p>number ' || s_suppkey || ' </p><a href=''./x/../' || (2 * s_suppkey + 1) || '''>l</a><a href=\"/s/' || (2 * s_suppkey + 2) || '#r\">r</a><a href=''/gone/' || s_suppkey || '''>g</a>') AS size FROM supplier"
    )
    return (
        f"w AS (SELECT *, ok AND host IS NOT NULL AS indexed, [host || '/s/' || (2 * k + 1), host || '/s/' || (2 * k + 2), host || '/gone/' || k] AS links FROM ({page})), "
        # A path lists the seed's number and the place of each link on its page: at one depth, paths stand in the order of arrival.
        "r(url, depth, path) AS (SELECT 'http://world.example/s/' || n, 0, [n] FROM range(2) t(n) UNION ALL "
        f"SELECT u, depth + 1, list_append(path, o) FROM (SELECT unnest(links) AS u, generate_subscripts(links, 1) AS o, depth, path FROM r JOIN w USING (url) WHERE indexed AND depth < {depth})), "
        "m AS (SELECT url, depth, path FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY depth, path) AS f FROM r) WHERE f = 1), x AS (SELECT * FROM m LEFT JOIN w USING (url)), "
        "i AS (SELECT *, row_number() OVER (ORDER BY depth, path) AS id FROM x WHERE indexed)"
    )


def runtime(after: int = -1, node_capacity: int = 1 << 40, edge_capacity: int = 1 << 40) -> str:
    return (
        f"WITH RECURSIVE a AS (SELECT 2 * s_suppkey AS seq, CASE WHEN s_suppkey % 4 > 0 THEN 2 * (s_suppkey // 3) END AS up, s_suppkey % 10 AS kind, least(127, 8 * strlen(s_name)) AS size FROM supplier WHERE 2 * s_suppkey > {after}), "
        "o(seq) AS (SELECT seq FROM a WHERE up IS NULL AND kind BETWEEN 1 AND 8 UNION SELECT a.seq FROM a JOIN o ON a.up = o.seq WHERE kind BETWEEN 1 AND 8), "
        f"n AS (SELECT a.* FROM a JOIN o USING (seq) ORDER BY seq LIMIT {node_capacity}), "
        f"e AS (SELECT * FROM (SELECT 2 * c_custkey + 1 AS seq, 2 * (c_custkey % 97) AS f, 2 * (c_custkey % 89) AS t, c_custkey % 8 AS kind FROM customer) WHERE seq > {after} AND kind BETWEEN 1 AND 6 AND f <> t "
        f"AND f IN (SELECT seq FROM n) AND t IN (SELECT seq FROM n) ORDER BY seq LIMIT {edge_capacity}), "
        "d AS (SELECT seq, row_number() OVER (ORDER BY seq) AS id FROM (SELECT seq FROM n UNION ALL SELECT seq FROM e)) "
        "SELECT 'node' AS what, n.seq, d.id, coalesce(p.id, 0) AS a, CAST(size AS BIGINT) AS b FROM n JOIN d ON d.seq = n.seq LEFT JOIN d p ON p.seq = n.up "
        "UNION ALL SELECT 'edge', e.seq, d.id, x.id, y.id FROM e JOIN d ON d.seq = e.seq JOIN d x ON x.seq = e.f JOIN d y ON y.seq = e.t"
    )


STORE_INSERT = """
WITH RECURSIVE b AS (
  SELECT doc_id AS k, 'c' || doc_id // 4 AS id, CASE WHEN doc_id % 10 <> 3 THEN 'd' || doc_id % 50 END AS d, doc_id % 7 - 1 AS o, sha256(text) AS h FROM documents WHERE doc_id <> 0
), t AS (SELECT * FROM b WHERE k % 300 = 5), v AS (
  SELECT *, list_filter([
    CASE WHEN d IS NULL THEN 'document_id not null' END, CASE WHEN o < 0 THEN 'ordinal' END,
    CASE WHEN CAST(substr(d, 2) AS INTEGER) >= 45 THEN 'document_id references documents.id' END, CASE WHEN id IN (SELECT id FROM t) THEN 'key' END,
    CASE WHEN h IN (SELECT h FROM t) THEN 'unique text_sha256' END, CASE WHEN d || ' ' || o IN (SELECT d || ' ' || o FROM t WHERE d IS NOT NULL) THEN 'unique document_id, ordinal' END
  ], lambda x: x IS NOT NULL) AS w FROM b
), c AS (SELECT *, row_number() OVER (ORDER BY k) AS n FROM v WHERE len(w) = 0), s(n, w, ids, hs, ps) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
  UNION ALL
  SELECT c.n, x.w, CASE WHEN len(x.w) = 0 THEN list_append(ids, c.id) ELSE ids END, CASE WHEN len(x.w) = 0 THEN list_append(hs, c.h) ELSE hs END,
         CASE WHEN len(x.w) = 0 THEN list_append(ps, c.d || ' ' || c.o) ELSE ps END
  FROM s JOIN c ON c.n = s.n + 1, LATERAL (SELECT list_filter([
    CASE WHEN list_contains(ids, c.id) THEN 'key' END, CASE WHEN list_contains(hs, c.h) THEN 'unique text_sha256' END,
    CASE WHEN list_contains(ps, c.d || ' ' || c.o) THEN 'unique document_id, ordinal' END], lambda x: x IS NOT NULL) AS w) x
)
SELECT array_to_string(list_sort(w), '; ') AS violations, count(*) AS n, count(DISTINCT id) AS ids
FROM (SELECT id, w FROM v WHERE len(w) > 0 UNION ALL SELECT c.id, s.w FROM s JOIN c USING (n)) GROUP BY 1
"""


STORE_DELETE = """
WITH s AS (SELECT DISTINCT source AS id FROM documents WHERE source IS NOT NULL), x AS (SELECT id FROM s WHERE ascii(right(id, 1)) % 3 = 1),
d AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, source, lang, len(text) AS size, coalesce(source IN (SELECT id FROM x), FALSE) AS dead FROM documents),
k AS (SELECT *, id || '/' || o AS chunk FROM (SELECT *, unnest(range(0, size // 1000 + 1)) AS o FROM d)),
c AS (SELECT * FROM k WHERE o % 3 = 0),
e AS (SELECT 'e' || id AS id, dead FROM d WHERE doc_id IN (SELECT doc_id FROM labels)),
r AS (
  SELECT 'sources' AS t, id AS key, id IN (SELECT id FROM x) AS dead, FALSE AS n FROM s
  UNION ALL SELECT 'documents', id, dead, FALSE FROM d UNION ALL SELECT 'document_chunks', chunk, dead, FALSE FROM k
  UNION ALL SELECT 'chunk_keywords', chunk, dead, FALSE FROM k WHERE lang IS NOT NULL UNION ALL SELECT 'claims', 'c' || chunk, dead, FALSE FROM c
  UNION ALL SELECT 'claim_keywords', 'c' || chunk, dead, FALSE FROM c, range(2) UNION ALL SELECT 'evidence', id, dead, FALSE FROM e
  UNION ALL SELECT 'graph_edges', id, FALSE, 'e' || id IN (SELECT id FROM e WHERE dead) FROM d
)
SELECT t AS "table", count(*) FILTER (WHERE NOT dead) AS kept, count(*) FILTER (WHERE dead) AS gone, count(*) FILTER (WHERE n) AS nulls,
CAST(coalesce(sum(CAST(regexp_extract(key, '[0-9]+') AS BIGINT)) FILTER (WHERE NOT dead), 0) AS BIGINT) AS numbers FROM r GROUP BY 1
"""


def layout(v: int, e: int, n: int, k: int, f: int) -> str:
    floats = n * (2 * e * e + 3 * f * e + 2 * k * e + 2 * e) + 2 * v * e + e if min(v, e, n, k, f) > 0 else None
    fits = [x if x is not None and x < 1 << 63 else None for x in (floats, None if floats is None else 4 * floats)]
    return "(" + ", ".join(f"CAST({x} AS BIGINT)" for x in (v, e, n, k, f)) + ", " + ", ".join("NULL" if x is None else str(x) for x in fits) + ")"


def oracle_sql() -> dict[str, str]:
    near_a, near_b, near_d = c.NEAR
    return {
        "tokenize_ascii": f"SELECT doc_id, array_to_string({ascii_('text')}, ' ') AS tokens FROM {DOCS}",
        "tokenize_unicode": f"SELECT doc_id, array_to_string({unicode_('text')}, ' ') AS tokens FROM {DOCS}",
        "term_freq": f"WITH {NATIVE} SELECT term, id AS doc_id, tf FROM p",
        "doc_freq": f"WITH {NATIVE} SELECT term, count(*) AS df FROM p GROUP BY term",
        "doc_length": f"SELECT doc_id, CAST(len({ascii_('text')}) AS BIGINT) AS length FROM {DOCS}",
        "corpus_stats": f"SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total_length, round(sum(n) / CAST(count(*) AS DOUBLE), 6) AS avgdl FROM (SELECT len({ascii_('text')}) AS n FROM {DOCS})",
        "postings_binary": f"WITH {BINARY} SELECT term, id AS doc_id FROM p",
        "bm25_native": top(bm25(NATIVE, c.QUERY)),
        "bm25_native_boost": top(bm25(PAGES, c.PAGE_QUERY, boost=" + 0.25 * len(list_filter(d.tt, lambda x: x = q.term)) + 0.1 * len(list_filter(d.ut, lambda x: x = q.term))")),
        "bm25_native_tombstone": top(bm25(NATIVE, c.QUERY, active="d.id % 7 <> 3")),
        "bm25_segmented": top(bm25(NATIVE, c.QUERY, active="d.id % 7 <> 3")),
        "bm25_repeat_terms": top(bm25(NATIVE, c.REPEATED)),
        "bm25_binary": top(bm25(BINARY, c.QUERY, "unicode")),
        "search_results_join": f"WITH {bm25(PAGES_BINARY, c.PAGE_QUERY, 'unicode')} SELECT r.id AS doc_id, score, url, title FROM r JOIN d ON d.id = r.id WHERE score > 0 ORDER BY score DESC, r.id LIMIT 10",
        "vector_cosine": "SELECT v.vec_id, round(list_sum(list_transform(list_zip(v.e, p.e), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(v.e, lambda x: x * x))) * sqrt(list_sum(list_transform(p.e, lambda x: x * x)))), 6) AS score FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) v, (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 0) p WHERE v.vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 10",
        "fts_phrase": f"WITH {FTS} SELECT DISTINCT a.doc_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.word = '{c.PHRASE[0]}' AND b.word = '{c.PHRASE[1]}'",
        "fts_prefix": f"WITH {FTS} SELECT DISTINCT doc_id FROM w WHERE starts_with(word, 'worth')",
        "fts_boolean": f"WITH {FTS} SELECT doc_id FROM (SELECT doc_id, bool_or(word = 'worthless') AS a, bool_or(word = 'the') AS b, bool_or(word = 'moron') AS m, bool_or(word = 'idiot') AS i FROM w GROUP BY 1) WHERE ((a AND b) OR m) AND NOT i",
        "fts_near": f"WITH {FTS} SELECT DISTINCT a.doc_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) <= {near_d + 1} AND a.pos <> b.pos WHERE a.word = '{near_a}' AND b.word = '{near_b}'",
        "html_title": f"SELECT page_id, {title('html')} AS title FROM pages",
        "html_text": f"SELECT page_id, {page_text('html')} AS text FROM pages",
        "html_links": f"SELECT page_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS nth, unnest(ls) AS link FROM (SELECT page_id, {links('html')} AS ls FROM pages)",
        "page_extract": f"SELECT page_id, {canonical('url')} AS url, {title('html')} AS title, sha256({page_text('html')}) AS text_sha256, CAST(len({links('html')}) AS INTEGER) AS n_links FROM pages",
        "url_canonical": f"SELECT page_id, {canonical('url')} AS url FROM pages",
        "url_policy": "SELECT page_id, coalesce(a <> '' AND NOT contains(a, '@') AND NOT regexp_matches(a, '^(localhost|127[.]0[.]0[.]1|0[.]0[.]0[.]0|\\[::1\\]|169[.]254[.]169[.]254)(:|$)'), FALSE) AS allowed FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS a FROM pages)",
        "url_resolve": f"WITH {LINKS} SELECT page_id, CAST(nth AS INTEGER) AS nth, ref, target FROM t",
        "link_frontier_dedup": f"WITH {ARRIVALS}, {DEDUP} SELECT seq, url, depth, CASE WHEN k > 1 THEN 'DUPLICATE' ELSE 'ALLOW' END AS decision FROM x",
        "frontier_bounded": f"WITH {ARRIVALS}, {DEDUP}, y AS (SELECT *, coalesce(sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS waiting FROM x) SELECT seq, url, depth, CASE WHEN waiting >= 256 THEN 'FRONTIER_FULL' WHEN k > 1 THEN 'DUPLICATE' ELSE 'ALLOW' END AS decision FROM y",
        "frontier_depth_min": f"WITH {ARRIVALS}, x AS (SELECT *, min(depth) OVER (PARTITION BY url ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM a) SELECT seq, url, depth FROM x WHERE least IS NULL OR depth < least",
        "crawl_closed_world": f"WITH {LINKS}, z AS (SELECT DISTINCT {canonical('url')} AS url FROM pages WHERE {canonical('url')} IS NOT NULL), r AS (SELECT url, 0 AS depth FROM z UNION ALL SELECT DISTINCT target, 1 FROM t WHERE target IS NOT NULL AND target NOT IN (SELECT url FROM z)) SELECT url, depth, depth = 0 AS fetched FROM r",
        "fetch_filter": "SELECT page_id, CAST(200 + page_id % 5 * 75 AS INTEGER) AS status, 'text/html; n=' || page_id AS content_type FROM pages WHERE page_id % 5 * 75 < 100 AND octet_length(encode(html)) BETWEEN 1 AND 4194304 AND regexp_matches(url, '^https?://[^/?#@]+([/?#]|$)')",
        "robots_decision": f"SELECT * FROM (VALUES {ROBOTS}) t(case_id, allowed)",
        "segment_documents": f"WITH g AS (SELECT doc_id, {SEGMENTS.format(x='text')} AS ss FROM documents WHERE doc_id <> 0), h AS (SELECT doc_id, generate_subscripts(ss, 1) - 1 AS nth, unnest(ss) AS s FROM g) SELECT doc_id, CAST(nth AS INTEGER) AS nth, {KIND} AS kind, CAST(coalesce(sum(strlen(s)) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(strlen(s) AS BIGINT) AS length FROM h",
        "segment_counts": f"SELECT {KIND} AS kind, count(*) AS n, CAST(sum(strlen(s)) AS BIGINT) AS total_bytes FROM (SELECT unnest({SEGMENTS.format(x='text')}) AS s FROM conversations) GROUP BY 1",
        "content_dedup": f"SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM {DOCS} GROUP BY 2",
        "chunk_hash_dedup": f"SELECT place // 1000000 AS doc_id, CAST(place % 1000000 AS INTEGER) AS ordinal, h AS sha256 FROM (SELECT min(doc_id * 1000000 + n) AS place, sha256(s) AS h FROM (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS n, unnest(ls) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {DOCS})) WHERE len(s) > 0 GROUP BY sha256(s))",
        "graph_valid_edges": f"WITH {NODES}, {EDGES} SELECT * FROM e WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)",
        "graph_orphans": f"WITH {NODES}, {EDGES} SELECT id, src, dst FROM e WHERE src NOT IN (SELECT id FROM v) OR dst NOT IN (SELECT id FROM v)",
        "graph_self_loops": f"WITH {EDGES} SELECT id, src FROM e WHERE src = dst",
        "graph_runtime_edges": f"WITH {NODES}, {EDGES} SELECT * FROM e WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v) AND src <> dst AND kind BETWEEN 1 AND 6 AND isfinite(weight)",
        "graph_kind_counts": f"WITH {NODES} SELECT CASE kind WHEN 5 THEN 'organization' ELSE 'source' END AS kind, count(*) AS n FROM v GROUP BY 1",
        "graph_evidence_link": "SELECT d.doc_id AS edge_id, source, lang, 'quality ' || q AS claim, CASE q WHEN 1 THEN 'FACT' WHEN 0 THEN 'UNCERTAIN' END AS classification FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l USING (doc_id)",
        "crawl_events": f"WITH w AS (SELECT {canonical('url')} AS url, min(html) AS html, count(*) AS n FROM pages WHERE url IS NOT NULL GROUP BY 1), x AS (SELECT octet_length(encode(html)) AS n, strlen({page_text('html')}) AS m, regexp_matches(url, '^https?://[^/?#@]+([/?#]|$)') AND octet_length(encode(html)) BETWEEN 1 AND 4194304 AS ok FROM w WHERE url IS NOT NULL) SELECT CASE WHEN ok THEN 'crawl_indexed' ELSE 'crawl_fetch_failed' END AS name, count(*) AS events, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS bytes_in, CAST(sum(CASE WHEN ok THEN m ELSE 0 END) AS BIGINT) AS bytes_out FROM x GROUP BY 1 UNION ALL SELECT 'crawl_seed', CAST(sum(n) AS BIGINT), CAST(sum(CASE WHEN url IS NULL THEN n ELSE n - 1 END) AS BIGINT), 0, 0 FROM w UNION ALL SELECT 'crawl_empty', 1, 0, 0, 0",
        "truth_classify": f"SELECT *, CASE WHEN sources = 0 THEN 'UNKNOWN' WHEN conflicts >= sources THEN 'CONFLICTED' WHEN conflicts > 0 THEN 'UNCERTAIN' WHEN sources >= 2 THEN 'FACT' ELSE 'INFERENCE' END AS truth FROM (SELECT source, lang, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS sources, CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS conflicts FROM {CLAIMS} GROUP BY 1, 2)",
        "single_source_flag": f"SELECT source, lang, count(*) AS sources, CASE WHEN count(*) <= 1 THEN 1 ELSE 0 END AS flag FROM {CLAIMS} WHERE toxic = 1 GROUP BY 1, 2",
        "evidence_valid": f"SELECT doc_id, CASE kind WHEN 0 THEN 'fact' WHEN 1 THEN 'inference' WHEN 2 THEN 'uncertain' WHEN 4 THEN 'conflicted' ELSE 'unknown' END AS kind, claim <> '' AND (kind <> 0 OR source <> '') AND kind <= 4 AS valid FROM {EVIDENCE}",
        "source_usable": f"SELECT doc_id, source <> '' AND kind <> 0 AND verified AND coalesce(hash <> 'zero', TRUE) AS usable FROM {EVIDENCE}",
        "source_reject_code": f"SELECT doc_id, CASE WHEN source = '' OR kind = 0 THEN 1 WHEN NOT verified THEN 2 WHEN hash IS NULL THEN 3 ELSE 0 END AS code FROM {EVIDENCE}",
        "telemetry_stats": f"SELECT {COUNTERS} FROM {TELEMETRY}",
        "telemetry_by_name": f"SELECT name, {COUNTERS} FROM {TELEMETRY} GROUP BY name",
        "telemetry_jsonl": "SELECT event_id, '{\"type\":\"event\",\"name\":\"' || name || '\",\"duration_ms\":' || duration_ms || ',\"bytes_in\":' || bytes_in || coalesce(',\"bytes_out\":' || bytes_out, '') || ',\"error\":' || CASE WHEN error THEN 'true' ELSE 'false' END || '}' AS line FROM " + TELEMETRY,
        "events_hourly": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
        "constraint_violations": f"SELECT doc_id, array_to_string(list_filter(v, lambda x: x IS NOT NULL), ',') AS violations FROM (SELECT doc_id, [CASE WHEN doc_id % 9 - 1 < 0 THEN 'ordinal' END, CASE WHEN doc_id % 13 < doc_id % 10 THEN 'end_offset' END, CASE WHEN len(text) - 100 < 0 THEN 'token_count' END] AS v FROM {DOCS}) WHERE len(list_filter(v, lambda x: x IS NOT NULL)) > 0",
        "role_violations": "SELECT role, count(*) AS n FROM (SELECT CASE WHEN turn % 4 = 3 THEN 'bot' ELSE role END AS role FROM conversations) WHERE role NOT IN ('user', 'assistant', 'system') GROUP BY 1",
        "unique_violations": f"SELECT sha256(text) AS content_sha256, count(*) AS n FROM {DOCS} GROUP BY 1 HAVING count(*) > 1",
        "fk_orphans": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)",
        "fk_cascade": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1",
        "fk_set_null": "SELECT l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) AS orphaned, count(*) AS n FROM lineitem GROUP BY 1",
        "latest_fetch_per_source": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
        "conversation_messages": "SELECT conv_id, count(*) AS n_turns, CAST(sum(CASE WHEN role = 'user' THEN len(text) ELSE 0 END) AS BIGINT) AS user_chars, CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS BIGINT) AS assistant_chars, arg_min(text, turn) FILTER (WHERE role = 'user') AS first_said FROM conversations GROUP BY 1",
        "keyword_domain_match": f"WITH {NATIVE}, k(domain, term, weight) AS (VALUES {KEYWORDS}) SELECT id AS doc_id, domain, CAST(sum(weight) AS DOUBLE) AS weight FROM p JOIN k USING (term) GROUP BY 1, 2",
        "model_layout": f"SELECT * FROM (VALUES {', '.join(layout(*x) for x in c.LAYOUTS)}) t(vocab, embed, layers, kv, ffn, floats, bytes)",
        "index_first_wins": f"SELECT id AS doc_id, CAST(len(t) AS BIGINT) AS length, CAST(len(t) AS BIGINT) AS tf, CAST(len(list_distinct(t)) AS BIGINT) AS terms FROM (SELECT id, {ascii_('text')} AS t FROM {ARRIVING})",
        "bm25_first_wins": top(bm25(index_sql(ARRIVING, ascii_("text")), c.QUERY)),
        "bm25_parameters": top(bm25(NATIVE, "moron idiot", k1=2.0, b=0.25), 10_000_000),
        "document_lookup": f"SELECT doc_id, CAST(len({ascii_('text')}) AS BIGINT) AS length FROM documents WHERE doc_id = 7",
        "document_count": "SELECT count(*) AS n FROM documents WHERE doc_id <> 0 AND text IS NOT NULL",
        "fts_column": f"SELECT doc_id FROM documents WHERE doc_id <> 0 AND list_contains({fts_words('text')}, 'en') AND NOT list_contains({fts_words('lang')}, 'en')",
        "fts_rank": fts_rank(),
        "fetch_limits": "SELECT p_partkey, p_size % 7 > 1 AND p_size % 3 > 1 AND p_size % 5 > 1 AND p_size % 4 >= 1 AS valid FROM part",
        "crawl_documents": f"WITH RECURSIVE {world()} SELECT id, host || '/s/' || k AS url, s_name AS title, CAST(len(s_name || ' number ' || k || ' l r g') AS INTEGER) AS n_chars FROM i",
        "crawl_depths": f"WITH RECURSIVE {world()} SELECT CASE WHEN indexed THEN 'crawl_indexed' WHEN ok THEN 'crawl_invalid_effective_url' ELSE 'crawl_fetch_failed' END AS name, indexed IS NOT TRUE AS error, count(*) AS n, CAST(sum(coalesce(took, 0)) AS BIGINT) AS duration_ms, CAST(sum(CASE WHEN indexed IS NOT TRUE AND ok THEN 0 ELSE coalesce(size, 0) END) AS BIGINT) AS bytes_in FROM x GROUP BY 1, 2 UNION ALL SELECT * FROM (VALUES ('crawl_seed', FALSE, 2, 0, 0), ('crawl_seed', TRUE, 2, 0, 0), ('crawl_empty', FALSE, 1, 0, 0))",
        "crawl_capped": f"WITH RECURSIVE {world()}, f AS (SELECT depth, path FROM i WHERE id = 5), q AS (SELECT m.url, m.depth, m.path FROM m, f WHERE m.depth = f.depth AND m.path > f.path UNION ALL SELECT u, depth + 1, path FROM (SELECT u, depth, path, row_number() OVER (PARTITION BY u ORDER BY path) AS n FROM (SELECT unnest(links) AS u, i.depth, list_append(i.path, generate_subscripts(links, 1)) AS path FROM i, f WHERE i.depth = f.depth AND i.path < f.path AND f.depth < 3)) WHERE n = 1 AND u NOT IN (SELECT m.url FROM m, f WHERE m.depth <= f.depth)) SELECT host || '/s/' || k AS url, 'indexed' AS state, id AS place FROM i WHERE id <= 5 UNION ALL SELECT url, 'waiting', row_number() OVER (ORDER BY depth, path) FROM q",
        "url_resolve_sql": f"WITH {LINKS} SELECT page_id, CAST(nth AS INTEGER) AS nth, ref, target FROM t",
        "segments_sql": f"SELECT {KIND} AS kind, count(*) AS n, CAST(sum(strlen(s)) AS BIGINT) AS total_bytes FROM (SELECT unnest({SEGMENTS.format(x='text')}) AS s FROM conversations) GROUP BY 1",
        "robots_pages": "SELECT page_id, NOT starts_with(p, '/fr/' || d) AND (NOT starts_with(p, '/en') OR starts_with(p, '/en/' || d)) AS allowed, TRUE AS agree FROM (SELECT page_id, page_id % 10 AS d, regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', '') AS p FROM pages)",
        "frontier_pop": f"WITH {ARRIVALS}, q AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM a) SELECT seq, url FROM q WHERE n <= 100 UNION ALL SELECT count(*), NULL FROM q WHERE n > 100",
        "graph_find": f"WITH {NODES}, {EDGES} SELECT id, src AS at FROM e WHERE id = 12 UNION ALL SELECT id, kind FROM v WHERE id = 1003",
        "graph_neighbours": f"WITH {EDGES} SELECT DISTINCT dst AS id FROM e WHERE src BETWEEN 1000001 AND 1000009",
        "graph_runtime": runtime(),
        "graph_runtime_capped": runtime(20, 30, 40),
        "store_insert": STORE_INSERT,
        "store_delete": STORE_DELETE,
        "fts_cover_rank": fts_cover(),
        "engine_searched": f"WITH {bm25(PAGES_BINARY, c.PAGE_QUERY, 'unicode')}, h AS (SELECT r.id AS doc_id, score, url, title FROM r JOIN d ON d.id = r.id WHERE score > 0 ORDER BY score DESC, r.id LIMIT 10) SELECT *, 'search' AS name, {len(c.PAGE_QUERY.encode())} AS bytes_in, (SELECT count(*) FROM h) AS bytes_out, FALSE AS error FROM h",
        "telemetry_streamed": f"SELECT name, {COUNTERS} FROM {TELEMETRY} GROUP BY name",
        "queue_streamed": QUEUE,
        "graph_reach": "WITH RECURSIVE l AS (SELECT DISTINCT l_suppkey * 2 AS s, l_partkey * 2 + 1 AS p FROM lineitem), e AS (SELECT s AS src, p AS dst FROM l UNION ALL SELECT p, s FROM l WHERE (p - 1) // 2 % 5 = 0), r(id, steps) AS (SELECT s_suppkey * 2, 0 FROM supplier WHERE s_suppkey <= 4 UNION SELECT dst, steps + 1 FROM r JOIN e ON src = id WHERE steps < 3) SELECT id, min(steps) AS steps FROM r GROUP BY id",
        "lateral_links": f"WITH {LINKS} SELECT page_id, CAST(nth AS INTEGER) AS nth, ref AS link, target FROM t",
        "lateral_segments": f"SELECT {KIND} AS kind, count(*) AS n, CAST(sum(strlen(s)) AS BIGINT) AS total_bytes, CAST(max(e) AS BIGINT) AS longest FROM (SELECT s, sum(strlen(s)) OVER (PARTITION BY k ORDER BY i) AS e FROM (SELECT k, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT row_number() OVER () AS k, {SEGMENTS.format(x='text')} AS l FROM conversations))) GROUP BY 1",
        "model_sizes": "SELECT p_partkey, CAST(CASE WHEN f <= 9223372036854775807 THEN f END AS BIGINT) AS floats, CAST(CASE WHEN 4 * f <= 9223372036854775807 THEN 4 * f END AS BIGINT) AS bytes FROM (SELECT p_partkey, CASE WHEN least(v, e, n, k, h) > 0 THEN n * (2 * e * e + 3 * h * e + 2 * k * e + 2 * e) + 2 * v * e + e END AS f FROM (SELECT p_partkey, CAST(p_partkey * 1009 AS HUGEINT) AS v, CAST(p_size * 12345 AS HUGEINT) AS e, CAST(p_size AS HUGEINT) AS n, CAST(p_size * 256 AS HUGEINT) AS k, CAST(p_partkey * 1000003 AS HUGEINT) AS h FROM part))",
    }
