"""Queries against SQL, brute force, exact round trips or held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from lumora.llm import brown_lm, language_crf, packing, queries, quality_rules, secret_scan
from lumora.llm.text import Chunk, map_chunks
from tests.oracle import connect, same

SMALL, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(folder):
    return pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_fixture_against_sql(spark, folder, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings", "conversations"):
        # a repeated doc_id makes op1's SQL ambiguous only in its row count; it is compared as rows
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    same(queries.QUERIES[name](spark, folder).toPandas(), c.execute(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_small_tables_against_sql(spark, name):
    same(queries.QUERIES[name](spark, SMALL).toPandas(), connect(SMALL).execute(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if not n.startswith(("op11", "op12"))))
def test_odd_rows_come_back_once_each(spark, folder, name):
    got = queries.QUERIES[name](spark, folder).toPandas()
    table, key = ("pages", "page_id") if name.startswith("op3") else ("documents", "doc_id")
    want = pq.read_table(f"{folder}/{table}.parquet", columns=[key]).column(0).to_pylist()
    plain = lambda x: -1 if x is None or x != x else int(x)
    if name.startswith("op5"):
        assert set(map(plain, got[key])) == set(map(plain, want))
    elif not name.startswith("op10"):
        assert Counter(map(plain, got[key])) == Counter(map(plain, want))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_null_id_links_nothing(spark):
    from lumora.llm.ngram_jaccard import jaccard_classes

    t = "a b c d e f g"
    rows = spark.createDataFrame([(2, t), (None, t), (1, t), (1, t)], "doc_id long, text string")
    assert sorted(((r.doc_id or -1), r.component_id or -1) for r in jaccard_classes(rows).collect()) == [(-1, -1), (1, 1), (1, 1), (2, 1)]


def test_large_group_of_near_copies(spark):
    """A chain of texts, each linked with its neighbours only, and a star of near copies: one component each."""
    from lumora.llm.ngram_jaccard import jaccard_classes

    words = [f"w{i}" for i in range(3000)]
    chain = [(i, " ".join(words[i * 10 : i * 10 + 100])) for i in range(30)]
    star = [(100 + i, " ".join([f"s{j}" if j != i * 2 % 97 else f"edit{i}" for j in range(100)])) for i in range(300)]
    got = {r.doc_id: r.component_id for r in jaccard_classes(spark.createDataFrame(chain + star, "doc_id long, text string").repartition(5)).collect()}
    assert {got[i] for i in range(30)} == {0} and {got[100 + i] for i in range(300)} == {100}


@pytest.mark.parametrize(("sets", "entries"), [(512, 1_000_000), (7, 1_000_000), (7, 10)])
def test_every_link_of_a_component(spark, monkeypatch, sets, entries):
    """Links within a component count too, however its sets are dealt to blocks, and whether the blocks' lists are sent or joined."""
    from lumora.llm import ngram_jaccard

    monkeypatch.setattr(ngram_jaccard, "BLOCK_SETS", sets)
    monkeypatch.setattr(ngram_jaccard, "BROADCAST_ENTRIES", entries)
    texts = [(100 + i, " ".join([f"s{j}" if j != i * 2 % 97 else f"edit{i}" for j in range(100 - i % 30)])) for i in range(60)]
    texts += [(7, texts[0][1]), (100, texts[0][1]), (5, "alone with nothing that is like it")]
    made = {i: frozenset(tuple(t.split(" ")[k : k + 5]) for k in range(len(t.split(" ")) - 4)) for i, t in texts}
    alike = lambda a, b: a != b and 100 * len(a & b) >= 75 * len(a | b)
    want = {i: sum(alike(a, b) for b in set(made.values())) for i, a in made.items()}
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert sum(want.values()) > 1000 and {(r.doc_id, r.n_links) for r in ngram_jaccard.link_counts(docs).collect()} == set(want.items())
    links, members = ngram_jaccard.jaccard_links(docs)
    name = {r.node: r.doc_id for r in members.where("doc_id != 7").collect()}
    got = [frozenset((name[r.a], name[r.b])) for r in links.collect()]
    ids = sorted(set(name.values()))
    assert len(got) == len(set(got)) and set(got) == {frozenset((a, b)) for a in ids for b in ids if a < b and alike(made[a], made[b])}


def test_cascade_order_changes_no_verdict(spark, folder):
    c = Chunk([d["text"] for d in documents(folder)])
    counts = quality_rules.counts(c)
    rejected = {name: [f(*quality_rules._one(c, counts, i)) for i in range(c.docs)] for name, f in quality_rules.RULES.items()}
    any_rule = np.any(list(rejected.values()), axis=0)
    got = quality_rules.quality_rules(spark.read.parquet(f"{folder}/documents.parquet")).toPandas()
    failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
    assert got.kept.sum() == (~failed & ~any_rule).sum()
    assert got[~got.kept & ~got.base_failed].rejected_by.notna().all()
    assert quality_rules.order({"symbols": (1.0, 0.5), "digits": (0.1, 0.2)}, ["symbols", "digits"]) == ["digits", "symbols"]


def test_cascade_is_ordered_by_what_is_left(spark):
    """A rule that rejects much of what fails the hard limits anyway, or of what an earlier rule rejects, comes late."""
    assert quality_rules.cascade_order({"a": 1.0, "b": 1.0, "c": 1.0}, {0b011: 50, 0b001: 5, 0b100: 10, 0: 100}, {"a": None, "b": None, "c": None}) == ["a", "c", "b"]
    assert quality_rules.cascade_order({"a": 9.0, "b": 1.0}, {0b01: 50, 0b10: 30}, {"a": None, "b": None}) == ["b", "a"]
    words = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    rows = [(i, "AB CD!") for i in range(50)] + [(100 + i, words + " 1234567890" * 40) for i in range(10)] + [(200 + i, words) for i in range(20)]
    seconds, sets = quality_rules.estimates(spark.createDataFrame(rows, "doc_id long, text string"), sample=80)
    assert sum(sets.values()) == 30 and set(seconds) == set(quality_rules.RULES)  # the 50 short texts aren't in the sample
    bit = list(quality_rules.RULES).index("capitals")
    assert not any(s >> bit & 1 for s in sets)


def test_weights_of_soft_terms_decide():
    from lumora.llm import url_filter as u

    a = u.automaton()
    blocks = lambda text: u.vocabulary_blocks(a, text)
    assert blocks("example.org/poker/bonus") and not blocks("example.org/win/bonus")  # two terms each
    assert blocks("a.org/cheap-free/win/bonus") and not blocks("a.org/cheap-free/win") and not blocks("a.org/poker/poker")
    assert not blocks("x.com/x/free") and not blocks("a.org/pokerface/bonus") and blocks("a.org/casino")
    assert max(u.SOFT.values()) < u.SOFT_LIMIT and u.SOFT_LIMIT > 2 * min(u.SOFT.values()) and min(map(len, u.SOFT)) > 1


def test_marginals_are_exact():
    import itertools

    rng = np.random.default_rng(1)
    scores, passing = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    want, total = np.zeros((7, 3)), 0.0
    for y in itertools.product(range(3), repeat=7):
        p = math.exp(sum(scores[i, y[i]] for i in range(7)) + sum(passing[y[i - 1], y[i]] for i in range(1, 7))) * np.exp(passing[:, y[0]]).sum()
        total += p
        for i in range(7):
            want[i, y[i]] += p
    whole, language_crf.BLOCK = language_crf.BLOCK, 3
    try:
        np.testing.assert_allclose(language_crf.marginals(scores, passing, np.array([0, 0, 7])), want / total, atol=1e-12)
    finally:
        language_crf.BLOCK = whole


def test_language_of_held_out_documents(spark):
    got = queries.op4_language_id(spark, SMALL).toPandas().merge(pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "lang"]).to_pandas())
    held = got[got.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (held.lang_pred == held.lang).mean() > 0.95 and held.score.between(0, 1).all()


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_crf, "train", lambda rows: sorted({lang for _, lang in rows}))
    rows = [(i, f"text {i}", f"l{i % 70:02}") for i in range(350)]
    assert language_crf.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 3) == [f"l{i:02}" for i in range(70)]


def test_switched_text_is_split(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_crf.fit(docs)
    a, b = (" ".join(r.text for r in docs.where(f"lang = '{x}'").orderBy("doc_id").limit(3).collect())[:1500] for x in ("en", "de"))
    spans = language_crf.language_spans(spark.createDataFrame([(1, a + " " + b)], "doc_id long, text string"), model).toPandas()
    long = spans[spans.end - spans.start > 700]
    assert set(long.lang) == {"en", "de"}


def test_unlettered_text_is_und(spark, folder):
    got = queries.op4_language_id(spark, folder).toPandas()
    texts = {d["doc_id"]: d["text"] for d in documents(folder)}
    for r in got.itertuples():
        t = texts[r.doc_id]
        assert (r.lang_pred == "und") == (t is None or not any(c.isalpha() for c in t))


def test_packing_is_a_round_trip(spark, folder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary_path())
    got = queries.op5_packing(spark, folder).toPandas()
    for d in documents(folder):
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        mine = got[got.doc_id == d["doc_id"]].sort_values("start")
        copies = sum(x["doc_id"] == d["doc_id"] for x in documents(folder))
        assert (mine.doc_tokens == len(ids)).all() and mine.length.sum() == copies * len(ids)
        for p in mine.itertuples():
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 4096
    total = got.groupby("sequence_id").length.sum()
    assert total.map(lambda n: n & (n - 1) == 0).all()  # full, or a power of two: no padding at all


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30) | st.text(alphabet="ab'sé,.-< ̸İß1", max_size=20), min_size=1, max_size=5))
def test_parts_encode_like_whole_texts(texts):
    ids = packing.part_ids(queries.vocabulary_path(), True)
    whole = ids.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in ids.encode(Chunk(texts), True)] == [w.ids for w in whole]


def chosen_well(size, sizes):
    """Each choice leaves the least sum of squares that any open level, a new sequence or a full one would leave."""
    p = packing.Packer(size)
    for i, n in enumerate(sizes):
        before = p.count.copy()
        p.add(i, np.zeros(n, "<u4"))
        rest = n % size
        if rest:
            was = int((before[1:size] ** 2).sum())

            def cost(h):
                gone = 1 - 2 * before[h] if h else 0
                return was + gone + (2 * before[h + rest] + 1 if h + rest < size else 0)

            assert (p.count[1:size] ** 2).sum() == min(cost(h) for h in range(0, size + 1 - rest) if h == 0 or before[h])
    p.finish()
    assert sum(r[2] for r in p.rows) == sum(sizes)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
@example([1, 1, 11, 4, 4, 6, 1, 13, 1])  # filling a sequence isn't as good here as it looks
def test_sum_of_squares_choice(sizes):
    chosen_well(16, sizes)


@pytest.mark.parametrize("size", [16, 64, 4096])
def test_sum_of_squares_choice_at_other_sizes(size):
    chosen_well(size, np.random.default_rng(size).integers(1, 3 * size, 2000).tolist())


def test_quality_of_held_out_documents(spark):
    labels = pq.read_table(f"{SMALL}/labels.parquet").to_pandas()
    got = queries.op6_quality_classifier(spark, SMALL).toPandas().merge(labels)
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and (held[held.quality == 1].predicted == 1).mean() > 0.97
    assert (got.predicted == (got.score >= 0.3)).all()


def test_lm_base_by_hand_and_better_than_it(spark):
    texts = documents(SMALL)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    words = {d["doc_id"]: WORD.findall((d["text"] or "").translate(UPPER)) for d in texts}
    c = Counter(w for i, ws in words.items() if not held(i) for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    got = queries.op7_brown_lm(spark, SMALL).toPandas()
    for r in got.itertuples():
        ws = [*words[r.doc_id], None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_exchange_raises_the_likelihood_and_finds_blocks():
    rng = np.random.default_rng(0)
    kind = np.arange(12) % 3
    counts = np.where(kind[:, None] == (kind[None] + 1) % 3, rng.integers(50, 99, (12, 12)), 0).astype(float)
    cls = brown_lm.exchange(counts, 3, 10)
    assert all(len(set(cls[kind == k])) == 1 for k in range(3)) and len(set(cls)) == 3


def naive_secrets(text):
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in p.finditer(text) if ok(m)]
    return [(name, a, b) for a, _, name, b in sorted(found)]


@pytest.mark.parametrize("which", ["fixture", "small"])
def test_base_secrets_by_plain_patterns(spark, folder, which):
    path = folder if which == "fixture" else SMALL
    got = queries.op8_secret_scan(spark, path).toPandas()
    texts = {d["doc_id"]: d["text"] or "" for d in documents(path)}
    for r in got.itertuples():
        base = naive_secrets(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in base) for x in secret_scan.KINDS)
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_network_tells_keys_from_words():
    rng = np.random.default_rng(2)
    line = lambda key: f"some words here token = {key} and more of them"
    good = ["".join(rng.choice(list("0123456789abcdef"), 32)) for _ in range(200)]
    bad = ["".join(rng.choice(list("etaoinshrdlu"), 14)) + str(rng.integers(10, 99)) for _ in range(200)]
    chunk = Chunk([line(k) for k in good + bad])
    s, e = secret_scan.candidates(chunk)
    x, y = secret_scan.windows(chunk, s, e), (np.arange(400) < 200).astype(int)
    net = secret_scan.train(x[::2], y[::2])
    p = net.probability(x[1::2])
    assert ((p >= net.threshold) == y[1::2]).mean() > 0.97


def test_network_reads_whole_runs_without_digits_too(spark):
    """What only the middle of a long run shows is found, with a digit in it or not."""

    net = secret_scan.CharCnn(np.zeros((130, 8)), np.tile(np.eye(8)[:, :1], (5, 16)), np.full(16, -3.5), np.ones(16), -2.0, threshold=0.5)
    net.vectors[ord("Q"), 0] = 1  # four in a row pass
    texts = [(1, "a " + "x" * 57 + "QQQQ" + "y" * 90 + " b"), (2, "a " + "x" * 37 + "QQQQ7" + "y" * 30), (3, "x" * 90)]
    got = secret_scan.find_secrets(spark.createDataFrame(texts, "doc_id long, text string"), net).collect()
    assert {r.doc_id: [(x.start, x.end) for x in r.spans] for r in got} == {1: [(2, 153)], 2: [(2, 74)], 3: []}


def test_findings_come_from_all_documents(spark):
    rows = [(i, f"words here token = {i:032x} and more" if i % 10 == 0 else f"longcandidatewords{i} and more") for i in range(400)]
    x, y = secret_scan.labelled_candidates(spark.createDataFrame(rows, "doc_id long, text string"), sample_docs=20)
    assert y.sum() == 40 and 0 < (y == 0).sum() < 80


def test_threshold_keeps_the_recall_asked_for():
    """Findings that look like other candidates are kept, however low that puts the threshold."""
    x = np.full((1520, secret_scan.BEFORE + secret_scan.INSIDE + secret_scan.AFTER), 97, np.int16)
    net = secret_scan.train(x, (np.arange(1520) < 20).astype(int), epochs=1)
    assert (net.probability(x[:20]) >= net.threshold).all() and net.threshold < 0.5


def test_toxicity_of_held_out_documents(spark):
    """On the larger tables: the small ones have some thirty toxic documents to learn from."""
    labels = pq.read_table(f"{LARGER}/labels.parquet").to_pandas()
    got = queries.op9_toxicity(spark, LARGER).toPandas().merge(labels, on="doc_id", suffixes=("", "_label"))
    held = got[got.held_out]
    clean, toxic = held[held.toxic_label == 0], held[held.toxic_label == 1]
    assert (clean.toxic == 0).mean() > 0.99 and (toxic.toxic == 1).mean() > 0.9
    assert got.severity.between(0, 3).all() and held[held.toxic_label == 1].severity.mean() > clean.severity.mean()


def test_chunks_keep_surrogates_and_long_texts(spark):
    rows = spark.createDataFrame([(1, "𝒳 " * 3), (2, "a " * 300_000)], "doc_id long, text string")
    got = map_chunks(rows, lambda k, c: {"doc_id": k, "n": np.bincount(c.words()[2], minlength=c.docs)}, "doc_id long, n long").collect()
    assert sorted(map(tuple, got)) == [(1, 3), (2, 300_000)]
