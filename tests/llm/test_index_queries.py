"""The operators on vectors, conversations and manifests by plain loops, with many small regions, blocks and full sketches."""

import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow.parquet as pq
import pytest

from lumora.llm import conversation_trie, index_queries, merkle, metric_tree

SMALL, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def plain_top(rows, k):
    """rows: (vec_id, list of ints) in any order."""
    out = []
    for i, (q, v) in enumerate(rows):
        if q % 20 == 0:
            score = sorted((-sum(a * b for a, b in zip(v, w)), x, j) for j, (x, w) in enumerate(rows) if j != i)
            out += [(q, r + 1, x, -s) for r, (s, x, _) in enumerate(score[:k])]
    return sorted(out)


@pytest.mark.parametrize(("region", "page"), [(16_384, 128), (40, 8), (9, 3)])
def test_top_products_of_clusters_and_copies(spark, region, page):
    rng = np.random.default_rng(region)
    centres = rng.integers(-60, 60, (6, 8))
    x = np.concatenate((centres[rng.integers(0, 6, 400)] + rng.integers(-9, 9, (400, 8)), np.tile(centres[:1], (90, 1)), np.zeros((30, 8), int)))
    rows = list(enumerate(x.tolist()))
    got = metric_tree.top_products(spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(7), metric_tree.F.col("vec_id") % 20 == 0, 20, region, page)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == plain_top(rows, 20)


def test_stored_distances_and_radii_save_products(spark):
    """On clusters, most regions, pages and objects are ruled out; none of the result is lost."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-300, 300, (40, 8))
    x = centres[rng.integers(0, 40, 4000)] + rng.integers(-5, 5, (4000, 8))
    rows = list(enumerate(x.tolist()))
    got = metric_tree.top_products(spark.createDataFrame(rows, "vec_id long, v array<long>"), metric_tree.F.col("vec_id") % 20 == 0, 5, 500, 32).toPandas()
    assert sorted(got[["query_id", "rank", "vec_id", "score"]].itertuples(index=False, name=None)) == plain_top(rows, 5)
    assert got.groupby("query_id").n_products.first().mean() < 0.25 * len(rows)


def test_products_beyond_doubles_are_exact(spark):
    rows = [(i, [2**29 + i, 2**28 - i * i, 1]) for i in range(41)]
    got = metric_tree.top_products(spark.createDataFrame(rows, "vec_id long, v array<long>"), metric_tree.F.col("vec_id") % 20 == 0, 3, 9, 3)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == plain_top(rows, 3)


def plain_trie(rows):
    """rows: conv_id to turns (role, text)."""
    nodes = defaultdict(list)
    for c, turns in rows.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = []
    for p, members in nodes.items():
        below = [x for x in nodes if x[: len(p)] == p]
        leaf = lambda x: not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in nodes)
        ends = sorted(c for c in members if len(rows[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(x) == len(p) + 1 for x in below), sum(map(leaf, below)), sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in below if x), sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("counts", ["sketch", "full", "small pieces"])
def test_trie_by_plain_loops(spark, monkeypatch, counts):
    """A sketch whose counters are all taken proves nothing, and changes nothing."""
    if counts == "full":
        monkeypatch.setattr(conversation_trie, "prefix_counts", lambda prefixes, bits: np.full(2 << bits, 9, np.uint8))
    rng = np.random.default_rng(6)
    said = {int(c): [("user" if t % 2 else "assistant", "abcé"[rng.integers(0, 4)] * int(rng.integers(0, 3))) for t in range(rng.integers(0, 6))] for c in range(80)}
    said |= {500 + i: said[7] + [("user", "again")] for i in range(30)}
    rows = [(c, t, r, x) for c, turns in said.items() for t, (r, x) in enumerate(turns)]
    got = conversation_trie.prefix_trie(conversation_trie.ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)), piece=3 if counts == "small pieces" else 1 << 16)
    want = plain_trie({c: t for c, t in said.items() if t})
    assert sorted((tuple(r[c] for c in TRIE) for r in got.collect()), key=str) == want


def test_sketch_never_counts_too_little(spark):
    turns = conversation_trie.spliced(spark.read.parquet(f"{SMALL}/conversations.parquet"))
    prefixes = conversation_trie._prefixes(turns)
    true = prefixes.where("depth > 0").groupBy("digest").count().toPandas()
    counts = conversation_trie.prefix_counts(prefixes, 15)
    x, y = conversation_trie._places(conversation_trie.pa.array([bytes(d) for d in true.digest]), 15)
    estimate = np.minimum(counts[x], counts[y])
    assert (estimate >= np.minimum(true["count"], 255)).all() and (estimate == true["count"]).mean() > 0.95


def test_splicing_by_plain_loops(spark, folder):
    turns = pq.read_table(f"{folder}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()
    own = defaultdict(list)
    for r in turns:
        if r["conv_id"] is not None:
            role, text = r["role"] or "", r["text"] or ""
            own[r["conv_id"]].append((-1 if r["turn"] is None else r["turn"], sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()))
    for c in own:
        own[c].sort()
    got = defaultdict(list)
    for r in conversation_trie.spliced(spark.read.parquet(f"{folder}/conversations.parquet")).collect():
        got[r.conv_id] += [] if r.digest is None else [bytes(r.digest)]
    h = lambda c: zlib.crc32(str(c).encode()) % 9
    want = {c: [d for _, d in own.get(c - c % 5, [])[: h(c)] + own[c][h(c) :]] for c in own}
    assert dict(got) == want and any(not x for x in want.values())


def plain_root(digests):
    while len(digests) > 1:
        digests = [sha256("".join(digests[i : i + 3]).encode()).hexdigest() for i in range(0, len(digests), 3)]
    return digests[0]


@pytest.mark.parametrize("levels", [7, 2, 1])
def test_manifest_by_plain_loops(spark, levels):
    """Blocks of 3 to 2187 rows, in one or many rounds; the witness leads from each leaf to the root."""
    rows = [(i, None if i % 7 == 0 else f"s{min(i % 7, 4 if i % 2 else 3)}", f"text\n{i}") for i in range(211)] + [(500, "one", None)] + [(3, "s3", "same")] * 4
    leaf = lambda r: sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r).encode()).hexdigest()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0], leaf(r)))
    subroots = {g: plain_root([d for _, d in sorted(x)]) for g, x in groups.items()}
    root = plain_root([subroots[g] for g in sorted(subroots, key=lambda g: (g is not None, g or ""))])
    F = metric_tree.F
    cols = [F.col("doc_id"), F.col("source"), F.col("text")]
    claimed = merkle.leaf([*cols[:2], F.when(F.col("doc_id") % 2 == 0, F.lit("other")).otherwise(F.col("text"))])
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    got = merkle.manifest(docs, merkle.leaf(cols), F.col("source"), "doc_id", claimed=claimed, steps=True, levels=levels).collect()
    assert sorted((r.doc_id, r.leaf) for r in got) == sorted((r[0], leaf(r)) for r in rows)
    by_leaf = {leaf(r): r for r in rows}
    for r in got:
        steps = [(bytes(s.l), bytes(s.r)) for s in r.steps]
        assert r.root == root and r.subroot == subroots[by_leaf[r.leaf][1]]
        assert merkle.folded(bytes.fromhex(r.leaf), steps).hex() == root
        assert r.proof_sha256 == sha256(b"".join(a + b for a, b in steps)).hexdigest()
        assert r.verified == (r.doc_id % 2 == 1) and r.verified == (r.folded_root == root)


def test_witnesses_grow_with_their_siblings():
    """A partial witness is extended when a sibling subtree completes, and not before."""
    tree = merkle.OpenTree(2, witnesses=True)
    found = [tree.append(bytes([i]) * 32) for i in range(3)]
    assert [len(w) for w in found] == [1, 1, 1]
    found += [tree.append(bytes([i]) * 32) for i in range(3, 8)]
    assert [len(w) for w in found] == [1] * 6 + [0] * 2
    root = tree.finish()
    assert all(merkle.folded(bytes([i]) * 32, w) == root for i, w in enumerate(found))


def test_larger_tables_need_no_recall_figure(spark):
    """The search is exact: at sf 0.1 it equals all products."""
    t = pq.read_table(f"{LARGER}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    x = np.floor(64 * np.array(t["embedding"], np.float64))
    ids = np.array(t["vec_id"])
    got = index_queries.op11_metric_topk(spark, LARGER).toPandas()
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x @ x[q]).astype(int)
        s[q] = -(10**9)
        best = np.lexsort((ids, -s))[:20]
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert mine.vec_id.tolist() == ids[best].tolist() and mine.score.tolist() == s[best].tolist()
