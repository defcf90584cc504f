"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

import string


def _fill(depth: int) -> str:
    """Budgets of the nodes of one level from those of the level above, by filling siblings in the order of capacity per weight."""
    levels = ["domain", "lang", "source"]
    keys, above = ", ".join(levels[:depth]), levels[: depth - 1]
    part = f"PARTITION BY {', '.join(above)} " if above else ""
    join = f"JOIN b{depth - 1} USING ({', '.join(above)})" if above else "CROSS JOIN b0"
    weight = {1: "CASE domain WHEN 'web' THEN 5 WHEN 'forum' THEN 2 WHEN 'reference' THEN 3 ELSE 1 END", 2: "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END", 3: "1"}[depth]
    return f"""n{depth} AS (SELECT g.*, given FROM (SELECT {keys}, sum(able)::DOUBLE AS able, {weight}::DOUBLE AS w FROM lv GROUP BY {keys}) g {join} WHERE able > 0),
s{depth} AS (SELECT *, (given - coalesce(sum(able) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM n{depth} WINDOW f AS ({part}ORDER BY able / w, {levels[depth - 1]})),
b{depth} AS (SELECT {keys}, CASE WHEN able / w > share THEN w * max(CASE WHEN able / w > share THEN share END) OVER ({part.strip()}) ELSE able END AS given FROM s{depth})"""


OP2 = f"""WITH d AS (SELECT doc_id, CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '6' THEN 'web' WHEN substr(md5(coalesce(source, '')), 1, 1) < 'b' THEN 'forum' ELSE 'reference' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
lv AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, sum(n_tokens)::DOUBLE * 2 AS able FROM d GROUP BY ALL),
b0 AS (SELECT least(sum(able), floor(sum(supply) * 60 / 100.0))::DOUBLE AS given FROM lv),
{_fill(1)},
{_fill(2)},
{_fill(3)},
lb AS (SELECT domain, lang, source, supply, floor(coalesce(given, 0))::BIGINT AS budget FROM lv LEFT JOIN b3 USING (domain, lang, source)),
le AS (SELECT *, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS epochs FROM lb),
p AS (SELECT d.*, epochs, budget - epochs * supply AS rest, ('0x' || substr(md5('17:' || (epochs + 1) || ':' || doc_id), 1, 8))::BIGINT AS u FROM d JOIN le USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, (epochs + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END)::BIGINT AS n_copies FROM p"""

OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT r.d, u.b FROM r JOIN u ON u.a = r.r),
c AS (SELECT d, min(r) AS c FROM r GROUP BY d)
SELECT d AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d = c AS kept FROM c LEFT JOIN n ON n.doc_id = d"""

#: A list of the 256 remainders of a byte, and a text's CRC32 from it.
_CRC_TABLE = "tab AS (SELECT list(v ORDER BY b) AS crcs FROM (SELECT b, list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) x(b)))"


def _crc32(text: str) -> str:
    """Over a row with the column crcs."""
    data = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {data}), lambda c, x: xor(c >> 8, crcs[xor(c & 255, x) + 1])), 4294967295)"


OP11 = f"""WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS i, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[A-Za-z\u00c0-\u00ff]+')) AS r FROM documents),
g AS (SELECT i || ':' || r AS x, r, count(*) AS m FROM r GROUP BY i, r),
h AS (SELECT r, m, {_crc32("x")} AS h FROM g, tab),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, sum(m)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(m) >= 3),
k AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT a.word AS u, b.word AS v FROM k a JOIN k b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT k.word, w.word FROM k JOIN w ON w.word = k.rest UNION SELECT w.word, k.word FROM k JOIN w ON w.word = k.rest),
b AS (SELECT u, count(*) AS n_near, max(n) AS n FROM e JOIN w ON w.word = v GROUP BY u),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 2 * w.n THEN b.n END AS form_n, CASE WHEN b.n >= 2 * w.n THEN (SELECT min(v) FROM e JOIN w o ON o.word = v WHERE e.u = w.word AND o.n = b.n) END AS form FROM w LEFT JOIN b ON b.u = w.word),
s AS (SELECT word, word AS root FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL),
t AS (SELECT s.word, s.root FROM s JOIN f ON f.word = s.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN t USING (word)"""

OP13 = f"""WITH {_CRC_TABLE},
t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, list(struct_pack(role := role, txt := txt) ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || txt)) AS s FROM t GROUP BY c),
h AS (SELECT c, c - (c % 20 + 20) % 20 AS base, {_crc32("c::VARCHAR")} % 4 AS h FROM s, tab),
r AS (SELECT h.c, list_concat(coalesce(b.s, [])[1:h.h], o.s[h.h + 1:]) AS s FROM h JOIN s o ON o.c = h.c LEFT JOIN s b ON b.c = h.base),
m AS (SELECT c, s, d, s[1:d] AS p FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM r)),
n AS (SELECT p, d, min(c) AS c, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(s) = d), '') AS ends FROM m GROUP BY p, d),
k AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(kids, 0) AS kids, (n - 1) * CASE WHEN d > 0 THEN len(regexp_extract_all(p[d].txt, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM n LEFT JOIN k USING (p, d)),
u AS (SELECT p[1:e] AS p, e AS d, saved, kids FROM (SELECT p, saved, kids, unnest(range(d + 1)) AS e FROM w)),
v AS (SELECT p, d, count(*) FILTER (kids = 0) AS leaves, sum(saved)::BIGINT AS saved FROM u GROUP BY p, d)
SELECT w.c AS conv_id, w.d AS depth, a.c AS parent_conv_id, w.n AS n_convs, w.kids AS n_children, leaves AS n_leaves, v.saved AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN v ON v.p = w.p AND v.d = w.d LEFT JOIN n a ON w.d > 0 AND a.d = w.d - 1 AND a.p = w.p[1:w.d - 1]"""

ORACLE_SQL = {"op2_source_mixture": OP2, "op10_minhash_near_dedup": OP10, "op11_spelling_variants": OP11, "op13_prefix_trie": OP13}
