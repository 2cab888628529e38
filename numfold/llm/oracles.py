"""DuckDB forms of the queries that SQL can express."""

from __future__ import annotations

from .secrets import BASE, RULES

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(table: str, key: str, text: str) -> str:
    """(id, w): the words of each row as a list."""
    return f"SELECT {key} AS id, regexp_extract_all(coalesce({text}, ''), '{WORD}') AS w FROM {table}"


def shingles(k: int) -> str:
    """Distinct k-word shingles of w; a shorter text is one."""
    pieces = f"list_transform(range(len(w)-{k - 1}), lambda i: array_to_string(w[i+1:i+{k}], ' '))"
    return f"CASE WHEN len(w)=0 THEN [] WHEN len(w)<{k} THEN [array_to_string(w, ' ')] ELSE list_distinct({pieces}) END"


#: Windows that start earlier elsewhere, then the words that one of the last 20 starts covers.
SUBSTRING = f"""WITH d AS ({words('documents', 'doc_id', 'text')}),
p AS (SELECT id, w, unnest(range(1, len(w)+1)) AS s FROM d),
o AS (SELECT id, s, w[s] AS word, CASE WHEN s+19<=len(w) THEN array_to_string(w[s:s+19], ' ') END AS win FROM p),
f AS (SELECT id, s, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY id, s)>1 AS later FROM o),
c AS (SELECT id, s, word, max(later::INT) OVER (PARTITION BY id ORDER BY s ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT id, count(*) AS n, sum(gone) AS r, string_agg(CASE WHEN gone=0 THEN word END, ' ' ORDER BY s) AS kept FROM c GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN k ON k.id=doc_id"""

#: Candidates share one of their rarest shingles (a prefix long enough for 0.8); links are counted in full.
NEAR = f"""WITH RECURSIVE d AS ({words('documents', 'doc_id', LOWER)}),
h AS (SELECT id, {shingles(2)} AS h FROM d),
s AS (SELECT id, len(h) AS n, unnest(h) AS x FROM h),
r AS (SELECT id, n, x, row_number() OVER (PARTITION BY id ORDER BY df, x) AS k FROM (SELECT *, count(*) OVER (PARTITION BY x) AS df FROM s)),
p AS (SELECT * FROM r WHERE k<=n-ceil(0.8*n)+1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.x=b.x AND a.id<b.id AND 10*a.n>=8*b.n AND 10*b.n>=8*a.n),
l AS (SELECT c.a, c.b FROM c JOIN s x ON x.id=c.a JOIN s y ON y.id=c.b AND y.x=x.x GROUP BY c.a, c.b, na, nb HAVING 100*count(*)>=80*(na+nb-count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
z AS (SELECT id, id AS m FROM h UNION SELECT e.b, z.m FROM z JOIN e ON e.a=z.id WHERE z.m<e.b)
SELECT h.id AS doc_id, len(h)::BIGINT AS n_shingles, q.m AS component_id, h.id=q.m AS kept FROM h JOIN (SELECT id, min(m) AS m FROM z GROUP BY id) q ON q.id=h.id"""

CONTAINED = f"""WITH d AS ({words('documents', 'doc_id', LOWER)}), i AS ({words('benchmark', 'item_id', LOWER)}),
y AS (SELECT id, n, unnest(h) AS x FROM (SELECT id, h, len(h) AS n FROM (SELECT id, {shingles(5)} AS h FROM i))),
x AS (SELECT id, unnest({shingles(5)}) AS x FROM d)
SELECT x.id AS doc_id, y.id AS item_id, y.n::BIGINT AS item_shingles, count(*)::BIGINT AS shared, count(*)/y.n::DOUBLE AS containment FROM x JOIN y USING (x) GROUP BY x.id, y.id, y.n HAVING 100*count(*)>=80*y.n"""


def spans(place: int, kind: str, pattern: str, keep: str) -> str:
    """Matches of one kind: a match begins after all pieces and matches before it."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, a, a+length(m) AS z FROM (
SELECT doc_id, ms[i] AS m, gs[i] AS g, list_sum(list_transform(ps[1:i], lambda x: length(x)))+coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS a FROM (
SELECT *, unnest(range(1, len(ms)+1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {2 if kind == 'assign' else 0}) AS gs, string_split_regex(text, '{p}') AS ps FROM documents WHERE text IS NOT NULL))) WHERE {keep}"""


FOUND = " UNION ALL ".join(spans(k, r.kind, r.pattern, {"assign": "length(g)>=12", "access": "length(m)>=18"}.get(r.kind, "true")) for k, r in enumerate(RULES))
LINE = "string_agg(kind || ':' || a::BIGINT || ':' || z::BIGINT, ',' ORDER BY a, place)"
SECRETS = f"""WITH s AS ({FOUND}),
t AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind='{k}') AS n_{k}" for k in BASE)}, {LINE} FILTER (kind IN {BASE}) AS base, {LINE} AS line FROM s GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0)::BIGINT AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(line, '') AS spans FROM documents LEFT JOIN t USING (doc_id)"""

#: A base-32 digit is five bits of two hex digits.
DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((strpos('0123456789abcdef', substr(h, 5*i//4+1, 1))-1)*16+strpos('0123456789abcdef', substr(h, 5*i//4+2, 1))-1)//(2**(3-(5*i)%4))::INT)%32+1, 1)"
ARCHIVED = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), q AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: {DIGIT}), '') AS payload_digest, CASE WHEN page_id=last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id<>last THEN last END AS refers_to FROM q"""

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE label IS NOT NULL AND len(x)>0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e)))=0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label=b.label AND a.vec_id<>b.vec_id AND len(a.x)=len(b.x) WHERE a.n>0 AND b.n>0 AND list_dot_product(a.x, b.x)/(a.n*b.n)>=0.93),
z AS (SELECT vec_id AS id, vec_id AS m FROM v UNION SELECT l.b, z.m FROM z JOIN l ON l.a=z.id WHERE z.m<l.b)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, m AS component_id, vec_id=m AS kept FROM v JOIN (SELECT id, min(m) AS m FROM z GROUP BY id) q ON q.id=vec_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) c ON c.a=vec_id"""

ORACLES = {"op3_substring_dedup": SUBSTRING, "op4_near_dedup": NEAR, "op5_secret_scan": SECRETS, "op8_decontamination": CONTAINED, "op9_warc": ARCHIVED, "op10_embedding_dedup": VECTORS}
