"""DuckDB SQL for the queries of this package."""

ORACLE: dict[str, str] = {}

#: Words of one window are joined by spaces; a document word is hit if a window that covers it occurs in an item.
ORACLE["op8_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bw),
widths AS (SELECT DISTINCT k FROM grams),
dw AS (SELECT doc_id, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i, w FROM d, widths WHERE len(w) >= k),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM dw),
hits AS (SELECT doc_id, k, i, item FROM dg JOIN grams USING (k, g)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(item) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hw.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AND 20 * coalesce(hw.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_ASSIGN = (r'''([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])'''
           r'''["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)''')


def _matches(kind: str, pattern: str, least: int, group: int = 0) -> str:
    """Matches with their places: the lengths of the pieces and matches before them."""
    return f"""SELECT doc_id, '{kind}' AS kind, m, p AS start, p + length(m) AS stop FROM (
        SELECT doc_id, unnest(f) AS m, unnest(g) AS g, unnest(list_transform(range(1, CAST(len(f) + 1 AS BIGINT)), lambda i:
               length(array_to_string(s[1:i], '')) + length(array_to_string(f[1:i - 1], '')))) AS p
        FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS f, regexp_extract_all(t, '{pattern}', {group}) AS g, string_split_regex(t, '{pattern}') AS s FROM d)
        ) WHERE length(g) >= {least}"""


#: Windows of candidates are rated one by one, without the increments.
ORACLE["op4_secret_scan"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_matches("assign", _ASSIGN, 6, 2)} UNION ALL {_matches("access", "AKIA[A-Z0-9]+", 20)} UNION ALL {_matches("hex", "[0-9a-f]{24,}", 24)}),
cand AS (SELECT *, row_number() OVER () AS c, regexp_matches(m, '^[0-9A-Fa-f]+$') AS hex FROM ({_matches("", "[A-Za-z0-9+/=_-]{20,}", 0)})
    WHERE NOT regexp_matches(m, '^[A-Za-z]+$') AND NOT regexp_matches(m, '^[0-9]+$') AND len(list_distinct(string_split(m, ''))) > 1
    AND NOT regexp_matches(m, '^[A-Za-z]+[-_/+=][A-Za-z_/+=-]*$') AND NOT regexp_matches(lower(m), 'example|placeholder|changeme')),
win AS (SELECT c, substr(m, i, 20) AS w FROM (SELECT c, m, unnest(range(1, length(m) - 18)) AS i FROM cand)),
bits AS (SELECT c, max(log2(20) - list_sum(list_transform(list_distinct(string_split(w, '')), lambda x:
         (20 - length(replace(w, x, ''))) * log2(20 - length(replace(w, x, ''))))) / 20) AS b FROM win GROUP BY c),
high AS (SELECT doc_id, CASE WHEN hex THEN 'entropy_hex' ELSE 'entropy_mixed' END AS kind, start, stop FROM cand JOIN bits USING (c)
    WHERE b >= CASE WHEN hex THEN 3.01 ELSE 3.81 END
    AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = cand.doc_id AND base.start <= cand.start AND cand.stop <= base.stop)),
spans AS (SELECT doc_id, kind, start, stop, list_position(['assign', 'access', 'hex', 'entropy_hex', 'entropy_mixed'], kind) AS r,
          kind || ':' || start || ':' || stop AS s FROM (SELECT doc_id, kind, start, stop FROM base UNION ALL SELECT * FROM high)),
sums AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(s, ',' ORDER BY start, r) FILTER (r <= 3) AS base, string_agg(s, ',' ORDER BY start, r) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(sums.spans, '') AS spans FROM d LEFT JOIN sums USING (doc_id)
"""

#: The base-32 digits of a digest come from its bits, five at a time.
ORACLE["op5_warc"] = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x, max(page_id) OVER (PARTITION BY b) AS last FROM p),
bits AS (SELECT *, array_to_string(list_transform(string_split(x, ''), lambda c: right('0000' || bin(strpos('0123456789abcdef', c) - 1), 4)), '') AS s FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(list_sum(list_transform(range(1, 6), lambda j: CASE WHEN substr(s, CAST(5 * i + j AS BIGINT), 1) = '1' THEN CAST(pow(2, 5 - j) AS INT) ELSE 0 END)) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM bits
"""

#: Every window of 400 bytes by its digest; windows that occur twice cover what goes.
ORACLE["op1_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT doc_id, place, substr(h, 2 * place + 1, 1198) AS x FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 - 399 AS BIGINT), 200)) AS place FROM d WHERE length(h) >= 800)),
w AS (SELECT doc_id, place + unnest(i) AS i, unnest(list_transform(i, lambda p: md5(substr(x, 2 * p + 1, 800)))) AS k
      FROM (SELECT doc_id, place, x, range(0, CAST(length(x) // 2 - 399 AS BIGINT)) AS i FROM parts)),
hit AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
steps AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM hit),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM steps) GROUP BY doc_id, g),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM runs
         UNION ALL SELECT doc_id, max(b), length(any_value(h)) // 2 FROM runs JOIN d USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * f + 1 AS BIGINT), CAST(2 * (t - f) AS BIGINT)), '' ORDER BY f) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Pairs by their shared shingles, and what is reachable from each document.
ORACLE["op2_minhash_near_dedup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, CAST(len(w) - 1 AS BIGINT)), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT u AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(v) AS component_id, u = min(v) AS kept FROM r LEFT JOIN n ON n.doc_id = u GROUP BY u
"""

ORACLE["op12_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d
"""


def _crc32(n: str) -> str:
    """CRC-32 of a number's decimal digits, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({n} AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""


def _leaf(text: str) -> str:
    part = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    return f"sha256({' || '.join(part(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: Levels of all trees at once, then every leaf's path upwards with its siblings.
ORACLE["op13_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(':' || source, '-') AS tree, {_leaf("text")} AS leaf,
    CASE WHEN {_crc32("doc_id")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS tested FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
t AS (SELECT tree, 0 AS lvl, i, n, leaf AS h FROM l
      UNION ALL SELECT tree, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY tree, lvl, i // 3, n),
s AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, i, n, h FROM s UNION ALL SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 3, n),
p AS (SELECT tree, doc_id, leaf, 0 AS lvl, i, n, i AS place, '' AS sib, tested AS h FROM l
      UNION ALL SELECT p.tree, doc_id, leaf, p.lvl + 1, p.i // 3, (p.n + 2) // 3, place, sib || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i <> p.i), ''),
          sha256(string_agg(CASE WHEN t.i = p.i THEN p.h ELSE t.h END, '' ORDER BY t.i))
      FROM p JOIN t ON t.tree = p.tree AND t.lvl = p.lvl AND t.i // 3 = p.i // 3 WHERE p.n > 1 GROUP BY p.tree, doc_id, leaf, p.lvl, p.i, p.n, place, sib),
q AS (SELECT doc_id, leaf, s.h AS subroot, 0 AS lvl, s.i, s.n, place, p.tree, sib, p.h FROM p JOIN s ON s.tree = p.tree WHERE p.n = 1
      UNION ALL SELECT doc_id, leaf, subroot, q.lvl + 1, q.i // 3, (q.n + 2) // 3, place, tree, sib || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i <> q.i), ''),
          sha256(string_agg(CASE WHEN u.i = q.i THEN q.h ELSE u.h END, '' ORDER BY u.i))
      FROM q JOIN u ON u.lvl = q.lvl AND u.i // 3 = q.i // 3 WHERE q.n > 1 GROUP BY doc_id, leaf, subroot, q.lvl, q.i, q.n, place, tree, sib)
SELECT doc_id, leaf, subroot, u.h AS root, sha256(sib) AS proof_sha256, q.h AS folded_root, q.h = u.h AS verified FROM q, u WHERE q.n = 1 AND u.n = 1
"""

#: Prefixes of all rebuilt conversations by name; a node's subtree are the later prefixes of its members.
ORACLE["op11_prefix_trie"] = rf"""
WITH t AS (SELECT conv_id AS c, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'id': id, 'w': w}} ORDER BY turn NULLS FIRST, id) AS l, {_crc32("c")} % 4 AS h FROM t GROUP BY c),
r AS (SELECT o.c, list_concat(coalesce(b.l[1:o.h], []), o.l[o.h + 1:]) AS l FROM o LEFT JOIN o b ON b.c = o.c - o.c % 20),
p AS (SELECT c, d, len(l) = d AS last, sha256(array_to_string(list_transform(l[1:d], lambda x: x.id), ',')) AS name, CASE WHEN d > 0 THEN l[d].w ELSE 0 END AS w
      FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM r)),
u AS (SELECT p.*, lag(name) OVER (PARTITION BY c ORDER BY d) AS up FROM p),
n AS (SELECT name, any_value(d) AS d, any_value(up) AS up, any_value(w) AS w, min(c) AS c, count(*) AS n,
      sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends FROM u GROUP BY name),
k AS (SELECT up AS name, count(*) AS k FROM n WHERE up IS NOT NULL GROUP BY up),
s AS (SELECT top, count(*) FILTER (k.name IS NULL) AS leaves, sum((n.n - 1) * n.w) AS saved
      FROM (SELECT DISTINCT a.name AS top, b.name FROM p a JOIN p b ON a.c = b.c AND a.d <= b.d) x JOIN n ON n.name = x.name LEFT JOIN k ON k.name = x.name GROUP BY top)
SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, m.c AS parent_conv_id, n.n AS n_convs, CAST(coalesce(k, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n LEFT JOIN n m ON m.name = n.up LEFT JOIN k ON k.name = n.name JOIN s ON s.top = n.name
"""
