"""What DuckDB's SQL can ask of the operators: repeats by all 400-byte strings, near-dedup by all shared shingles, ranked search by all terms."""

_LOWER = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws)=0 THEN [] WHEN len(ws)<5 THEN [array_to_string(ws,' ')] ELSE list_transform(range(1,len(ws)-3), lambda i: array_to_string(ws[i:i+4],' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g=b.g AND a.doc_id<b.doc_id GROUP BY 1,2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id=u JOIN n y ON y.doc_id=v WHERE 100*k>=85*(x.n+y.n-k)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT b.v, r.root FROM r JOIN b ON b.u=r.doc_id)
SELECT d.doc_id, coalesce(n.n,0) AS n_shingles, c.root AS component_id, d.doc_id=c.root AS kept
FROM documents d LEFT JOIN n ON n.doc_id=d.doc_id JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY 1) c ON c.doc_id=d.doc_id
"""

REPEATS = """
WITH h AS (SELECT doc_id, hex(coalesce(text,'')) AS x FROM documents),
w AS (SELECT doc_id, i, hash(substr(x, 2*i+1, 800)) AS k FROM (SELECT doc_id, x, unnest(range(length(x)//2-399)) AS i FROM h WHERE length(x)>=800)),
g AS (SELECT k FROM w GROUP BY k HAVING count(*)>1),
m AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM g)),
f AS (SELECT doc_id, i, CASE WHEN i-lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS head FROM m),
r AS (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
p AS (SELECT doc_id, run, min(i) AS a, max(i)+400 AS b FROM r GROUP BY 1,2),
q AS (SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS last FROM p),
k AS (SELECT q.doc_id, sum(b-a) AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(substr(h.x, CAST(2*last+1 AS BIGINT), CAST(2*(a-last) AS BIGINT)), '' ORDER BY run) AS x, string_agg(a||':'||b, ',' ORDER BY run) AS spans FROM q JOIN h ON h.doc_id=q.doc_id GROUP BY 1)
SELECT doc_id, length(x)//2 AS n_bytes, CAST(coalesce(n_removed,0) AS BIGINT) AS n_removed, coalesce(n_spans,0) AS n_spans,
sha256(kept) AS kept_sha256, coalesce(spans,'') AS spans, TRY(decode(kept)) AS kept_text
FROM (SELECT h.doc_id, h.x, k.n_removed, k.n_spans, k.spans, unhex(CASE WHEN k.doc_id IS NULL THEN h.x ELSE k.x||substr(h.x, CAST(2*k.tail+1 AS BIGINT)) END) AS kept FROM h LEFT JOIN k ON k.doc_id=h.doc_id)
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
d AS (SELECT r, doc_id, len(ws) AS n FROM t WHERE len(ws)>0),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
i AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS ws FROM benchmark),
q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(ws) AS term FROM i) GROUP BY ALL),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000*ln((2*any_value(g.docs)+2)/(2*count(*)+1))) AS BIGINT) AS w FROM f, g GROUP BY 1),
p AS (SELECT f.r, f.term, w.w*((1000000000*tf)//(1000*tf+12*(100-25+((25*d.n*g.docs)//g.terms)))) AS adds FROM f JOIN w ON w.term=f.term JOIN d ON d.r=f.r, g),
s AS (SELECT q.i, q.item_id, p.r, CAST(sum(q.times*p.adds) AS BIGINT) AS score FROM q JOIN p ON p.term=q.term GROUP BY ALL),
o AS (SELECT s.item_id, row_number() OVER (PARTITION BY s.i ORDER BY s.score DESC, d.doc_id) AS k, d.doc_id, s.score FROM s JOIN d ON d.r=s.r WHERE s.score>0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM o WHERE k<=20
"""

ORACLE_SQL = {"op13_ranked_search": RANKED, "op1_repeat_removal": REPEATS, "op2_near_dedup": NEAR_DEDUP}
