"""Registered queries of the operators on vectors, conversations and manifests, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.llm.conversation_trie import prefix_trie, spliced
from lumora.llm.merkle import leaf, manifest
from lumora.llm.metric_tree import top_products, whole
from lumora.llm.text import table


def op11_metric_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", whole(F.col("embedding"), 64).alias("v"))
    return top_products(vectors, F.col("vec_id") % 20 == 0, k=20).drop("n_products")


def op12_conversation_trie(spark, sf_dir):
    return prefix_trie(spliced(table(spark, sf_dir, "conversations"), group=5, heads=9))


def op13_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return manifest(docs, leaf([*columns, F.col("text")]), F.col("source"), "doc_id", claimed=leaf([*columns, tampered]))


QUERIES = {f.__name__: f for f in (op11_metric_topk, op12_conversation_trie, op13_merkle_manifest)}

ORACLE_SQL: dict[str, str] = {}


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit: a byte is folded in, then eight shifts (-1 each)."""
    steps = f"[4294967295] || flatten(list_transform(string_split({text}, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce({steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _levels(lists: str) -> str:
    """Each group's nodes level by level, as lists of digests."""
    return f"""SELECT g, 0 AS k, a FROM {lists} UNION ALL
  SELECT g, k + 1, list_transform(range(0, len(a), 3), lambda i: sha256(array_to_string(a[i + 1:i + 3], ''))) FROM up WHERE len(a) > 1"""


_MERKLE_FIELDS = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))

ORACLE_SQL["op13_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, sha256({_MERKLE_FIELDS} || {_field("text")}) AS leaf,
  sha256({_MERKLE_FIELDS} || CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_field("replace(text, chr(10), '')")} ELSE {_field("text")} END) AS claimed FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
s0 AS (SELECT source AS g, list(leaf ORDER BY pos) AS a FROM p GROUP BY source),
up AS ({_levels("s0")}),
sub AS (SELECT g, a[1] AS subroot FROM up WHERE len(a) = 1),
sp AS (SELECT g, subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos FROM sub),
t0 AS (SELECT 0 AS g, list(subroot ORDER BY pos) AS a FROM sp),
top AS ({_levels("t0").replace("FROM up", "FROM top")}),
root AS (SELECT a[1] AS root FROM top WHERE len(a) = 1),
st AS (SELECT r, up.k AS k, a, pos // CAST(pow(3, up.k) AS BIGINT) AS nth FROM p JOIN up ON up.g IS NOT DISTINCT FROM p.source WHERE len(a) > 1
  UNION ALL SELECT r, 1000 + top.k, a, sp.pos // CAST(pow(3, top.k) AS BIGINT) FROM p JOIN sp ON sp.g IS NOT DISTINCT FROM p.source, top WHERE len(a) > 1),
w AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY k) AS step, array_to_string(list_slice(a, nth - nth % 3 + 1, nth), '') AS lft, array_to_string(list_slice(a, nth + 2, nth - nth % 3 + 3), '') AS rgt FROM st),
proof AS (SELECT r, max(step) AS steps, string_agg(lft || rgt, '' ORDER BY step) AS sib FROM w GROUP BY r),
f AS (SELECT r, 0 AS step, claimed AS x FROM d UNION ALL SELECT f.r, w.step, sha256(lft || x || rgt) FROM f JOIN w ON w.r = f.r AND w.step = f.step + 1)
SELECT p.doc_id, p.leaf, sub.subroot, root.root, sha256(coalesce(proof.sib, '')) AS proof_sha256, f.x AS folded_root, f.x = root.root AS verified
FROM p JOIN sub ON sub.g IS NOT DISTINCT FROM p.source LEFT JOIN proof USING (r) JOIN f ON f.r = p.r AND f.step = coalesce(proof.steps, 0), root
"""

ORACLE_SQL["op11_metric_topk"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT max(len(v)) AS w FROM v),
p AS (SELECT r, vec_id, list_resize(v, w, 0) AS v FROM v, w),
s AS (SELECT q.r, q.vec_id AS query_id, p.vec_id, CAST(CASE WHEN len(q.v) = 0 THEN 0 ELSE list_inner_product(q.v, p.v) END AS BIGINT) AS score FROM p q JOIN p ON p.r <> q.r WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM k WHERE rank <= 20
"""

ORACLE_SQL["op12_conversation_trie"] = f"""
WITH t AS (SELECT conv_id AS c, turn, strlen(coalesce(text, '')) AS nb, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS td FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, td) - 1 AS i FROM t),
ids AS (SELECT DISTINCT c, c - c % 5 AS base, {_crc32("CAST(c AS VARCHAR)")} % 9 AS h FROM o),
b AS (SELECT ids.c, 0 AS own, i, td, nb FROM ids JOIN o ON o.c = ids.base AND o.i < ids.h UNION ALL SELECT ids.c, 1, i, td, nb FROM ids JOIN o ON o.c = ids.c AND o.i >= ids.h),
x AS (SELECT c, row_number() OVER w AS depth, string_agg(td, '') OVER w AS p, nb FROM b WINDOW w AS (PARTITION BY c ORDER BY own, i)),
m AS (SELECT c, depth, p, left(p, 64 * (depth - 1)) AS parent, nb FROM x UNION ALL SELECT c, 0, '', NULL, 0 FROM ids),
e AS (SELECT c, max(depth) AS depth FROM m GROUP BY c),
n AS (SELECT p, any_value(parent) AS parent, any_value(depth) AS depth, min(c) AS c, count(*) AS k, any_value(nb) AS nb FROM m GROUP BY p),
kids AS (SELECT parent AS p, count(*) AS kids FROM n WHERE parent IS NOT NULL GROUP BY parent),
v AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (p)),
sub AS (SELECT a.p, count(*) FILTER (WHERE z.kids = 0) AS leaves, sum((z.k - 1) * z.nb) AS saved FROM v a JOIN v z ON starts_with(z.p, a.p) GROUP BY a.p),
fin AS (SELECT m.p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ends FROM m JOIN e USING (c, depth) GROUP BY m.p)
SELECT v.c AS conv_id, CAST(v.depth AS BIGINT) AS depth, up.c AS parent_conv_id, v.k AS n_convs, v.kids AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM v JOIN sub USING (p) LEFT JOIN fin USING (p) LEFT JOIN n up ON up.p = v.parent
"""
