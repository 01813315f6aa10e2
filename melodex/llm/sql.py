"""What DuckDB says for the queries whose whole result SQL can express."""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_HOST = f"translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), {_LOWER})"

#: Hosts and paths, given rules, and association rules by self-joins of the transactions.
OP1 = f"""WITH u AS (SELECT page_id, url, coalesce({_HOST}, '') AS host, coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path FROM (SELECT page_id, url, regexp_extract(url, '(?s)^.*?://(.*)$', 1) AS rest FROM pages)),
q AS (SELECT page_id, url, host, path, list_filter(string_split(host, '.'), lambda x: x<>'') AS labels, regexp_extract(url, '(?s)://[^?#]*(.*)$', 1) AS tail FROM u),
t AS MATERIALIZED (SELECT page_id, url, host, path, CASE WHEN host<>'' THEN list_distinct(list_concat(['scheme:'||lower(regexp_extract(url, '(?s)^(.*?)://', 1)), 'host:'||host], CASE WHEN len(labels)>=2 THEN ['site:'||array_to_string(labels[-2:], '.')] ELSE [] END,
 list_transform(labels, lambda x: 'label:'||x), list_transform(list_filter(regexp_split_to_array(lower(path), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x<>'' AND NOT regexp_full_match(x, '\\p{{N}}+')), lambda x: 'path:'||x),
 list_transform(regexp_extract_all(tail, '[?&]([^=&#]+)', 1), lambda x: 'query:'||x), CASE WHEN contains(tail, '#') THEN ['fragment:'] ELSE [] END)) ELSE [] END AS tokens FROM q),
g AS (SELECT doc_id, min((coalesce(quality,1)=1 AND coalesce(toxic,0)=0)::INT) AS good FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
known AS MATERIALIZED (SELECT row_number() OVER () AS r, tokens, good FROM t JOIN g ON doc_id=try_cast(regexp_extract(url, '://[^/?#]*/(?:[^?#]*/)?(\\d{{1,18}})(?:\\.\\w+)?/?(?:[?#].*)?$', 1) AS BIGINT)),
least AS (SELECT ceil(round(0.002*count(*), 9)) AS k FROM known),
wh AS (SELECT token, list(r ORDER BY r) AS rs FROM (SELECT r, unnest(tokens) AS token FROM known) GROUP BY token HAVING count(*)>=(SELECT k FROM least)),
it AS MATERIALIZED (SELECT token, min(token) OVER (PARTITION BY rs) AS item FROM wh),
b AS MATERIALIZED (SELECT DISTINCT r, good, item FROM (SELECT r, good, unnest(tokens) AS token FROM known) JOIN it USING (token)),
s AS (SELECT [item] AS items, count(*) AS n, sum(good) AS good FROM b GROUP BY ALL UNION ALL SELECT [x.item, y.item], count(*), sum(x.good) FROM b x JOIN b y ON x.r=y.r AND x.item<y.item GROUP BY ALL
 UNION ALL SELECT [x.item, y.item, z.item], count(*), sum(x.good) FROM b x JOIN b y ON x.r=y.r AND x.item<y.item JOIN b z ON z.r=y.r AND y.item<z.item GROUP BY ALL),
ru AS MATERIALIZED (SELECT items, verdict, hit/n AS sure, hit FROM (SELECT items, n, 'allow' AS verdict, good AS hit FROM s UNION ALL SELECT items, n, 'block', n-good FROM s) WHERE hit>=(SELECT k FROM least) AND hit>0 AND hit/n>=0.6),
pt AS (SELECT items, verdict, sure, unnest(CASE len(items) WHEN 2 THEN [[items[1]], [items[2]]] WHEN 3 THEN [[items[1]], [items[2]], [items[3]], [items[1], items[2]], [items[1], items[3]], [items[2], items[3]]] ELSE [] END) AS part FROM ru),
kept AS MATERIALIZED (SELECT * FROM ru ANTI JOIN (SELECT pt.items, pt.verdict FROM pt JOIN ru ON ru.items=pt.part AND ru.verdict=pt.verdict AND ru.sure>=pt.sure) USING (items, verdict)),
given AS (SELECT * FROM (VALUES ('com','/','allow'), ('example.com','/en/','block'), ('www.example.com','/en/','allow'), ('net','/es/','block'), ('net','/fr/','block')) v(h, p, verdict)),
gv AS (SELECT page_id, url, h||p AS rule, verdict FROM u JOIN given ON (host=h OR ends_with(host, '.'||h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY length(h||p) DESC)=1),
own AS (SELECT page_id, url, list(DISTINCT item) AS items FROM (SELECT page_id, url, unnest(tokens) AS token FROM t) JOIN it USING (token) GROUP BY ALL),
md AS (SELECT page_id, url, array_to_string(kept.items, ' + ') AS mined_rule, verdict FROM own ANTI JOIN gv USING (page_id, url) JOIN kept ON list_has_all(own.items, kept.items) QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY sure DESC, hit DESC, len(kept.items), kept.items, verdict)=1)
SELECT page_id, host, path, rule, coalesce(gv.verdict, md.verdict, 'allow') AS verdict, mined_rule FROM t LEFT JOIN gv USING (page_id, url) LEFT JOIN md USING (page_id, url)"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text,''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows of both sides as texts, joined.
OP7 = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(w[k:k+n-1], ' ') AS g FROM (SELECT item, w, least(len(w),10) AS n FROM b WHERE len(w)>0), unnest(generate_series(1, len(w)-n+1)) u(k)),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k+n-1], ' ') AS g FROM d, (SELECT DISTINCT n FROM iw) s, unnest(generate_series(1, len(w)-n+1)) u(k)),
hit AS MATERIALIZED (SELECT doc_id, k, dw.n, item FROM dw JOIN iw ON dw.n=iw.n AND dw.g=iw.g),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(generate_series(k, k+n-1)) u(p) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item FROM hit WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit,0) AS n_hit, coalesce(n_items,0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit,0)>0 AS contaminated FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""


def _escaped(x: str) -> str:
    """Length of a column with an escape before backslashes, colons, end marks and each # of three or more."""
    return rf"(length({x}) + length({x})-length(regexp_replace({x},'[\\:]','','g')) + (length({x})-length(replace({x},'</turn>','')))//7 + length({x})-length(regexp_replace({x},'#{{3,}}','','g')))"


OP8 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\\### Assistant: </turn> ok' FROM unnest([0,1]) u(k)),
f AS (SELECT *, 4 + CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 WHEN 'system' THEN 6 ELSE 1+{_escaped('role')} END + 2 + {_escaped('text')} + 9 AS chars FROM c),
s AS (SELECT conv_id, count(*) AS n_turns, string_agg(role||chr(10)||text||chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role='assistant'), '') AS said, sum(chars)::BIGINT AS formatted_chars FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(said)::BIGINT AS loss_chars, sha256(said) AS loss_sha256, formatted_chars FROM s"""

#: All pairs by brute force, and what each vector reaches.
OP9 = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CASE WHEN len(embedding)>0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0 AND list_max(list_transform(embedding, lambda x: abs(x)))>0 THEN embedding::DOUBLE[] END AS e FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id<>b.vec_id AND len(a.e)=len(b.e) WHERE CASE WHEN len(a.e)=len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= 0.9),
r AS (SELECT vec_id, vec_id AS far FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a=r.far),
m AS (SELECT vec_id, min(far) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n_links,0) AS n_links, component_id, v.vec_id=component_id AS kept FROM v JOIN m USING (vec_id) LEFT JOIN n USING (vec_id)"""

#: Periodic stretches planted by CRC-32, whose table is made here; runs out of equal spans of six words, which every run has.
OP11 = r"""WITH c AS MATERIALIZED (SELECT unnest(generate_series(0,255)) AS b), crc AS MATERIALIZED (WITH RECURSIVE z(b,v,k) AS (SELECT b, b::BIGINT, 0 FROM c UNION ALL SELECT b, CASE WHEN v&1=1 THEN xor(v>>1, 3988292384::BIGINT) ELSE v>>1 END, k+1 FROM z WHERE k<8) SELECT list(v ORDER BY b) AS t FROM z WHERE k=8),
h AS (SELECT doc_id, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') AS w, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR,''), lambda x: ord(x)::BIGINT), lambda a, x: xor(a>>8, t[(xor(a,x)&255)+1]), 4294967295::BIGINT), 4294967295::BIGINT)::BIGINT AS h FROM documents, crc),
a AS (SELECT doc_id, w, h, len(w) AS n, CASE WHEN h%10=0 AND len(w)>0 THEN (h//10)%len(w) END AS a FROM h),
p AS (SELECT *, 1+(n-a)//(3+(h//10)%8) AS p FROM a),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(generate_series(0,n-1), lambda i: w[1+CASE WHEN i<a THEN i ELSE a+(i-a)%p END]) END AS w FROM p),
s AS MATERIALIZED (SELECT r, n, unnest(generate_series(0,n-6)) AS i, md5(array_to_string(w[i+1:i+6],' ')) AS g FROM d WHERE n>=12),
e AS (SELECT x.r, x.i, y.i-x.i AS q FROM s x JOIN s y ON x.r=y.r AND x.g=y.g AND y.i>x.i AND 2*(y.i-x.i)<=x.n),
o AS (SELECT r, q, min(i) AS s, max(i)+6+q AS e FROM (SELECT *, i-row_number() OVER (PARTITION BY r,q ORDER BY i) AS k FROM e) GROUP BY r, q, k),
u AS MATERIALIZED (SELECT r, s AS start, e-s AS length, min(q) AS period FROM o WHERE e-s>=greatest(12,2*q) GROUP BY r, s, e),
x AS (SELECT r, count(*) AS n_runs, string_agg(start||','||length||','||period||chr(10), '' ORDER BY start, period) AS runs, arg_min({'s':start,'l':length,'p':period}, (-length,start,period)) AS b FROM u GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(generate_series(start+period, start+length-1)) AS i FROM u),
v AS (SELECT r, unnest(w) AS word, unnest(generate_series(0,n-1)) AS i FROM d WHERE r IN (SELECT r FROM u)),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM v ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs,0) AS n_runs, b.s AS start, b.l AS length, b.p AS period, 1000*b.l//b.p AS exponent_milli, sha256(coalesce(runs,'')) AS runs_sha256,
 sha256(coalesce(kept, array_to_string(w, ' '))) AS collapsed_sha256 FROM d LEFT JOIN x USING (r) LEFT JOIN k USING (r)"""

#: Lengths, digests and the first page of each payload of 100 bytes or more.
OP12 = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html,''))) AS payload_bytes, sha256(coalesce(html,'')) AS payload_digest, row_number() OVER (PARTITION BY sha256(coalesce(html,'')) ORDER BY page_id NULLS LAST) AS k, first_value(page_id) OVER (PARTITION BY sha256(coalesce(html,'')) ORDER BY page_id NULLS LAST) AS f FROM pages)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k>1 AND payload_bytes>=100 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN k>1 AND payload_bytes>=100 THEN f END AS refers_to FROM p"""

ORACLES = {"op1_url_filters": OP1, "op7_decontamination": OP7, "op8_chat_tree": OP8, "op9_embedding_graph": OP9, "op11_periodic_runs": OP11, "op12_warc": OP12}
