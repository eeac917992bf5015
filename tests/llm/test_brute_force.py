"""Models' outputs recomputed by plain loops over characters and words, and statements about bounds and counts."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumora.llm import brown_lm, decontaminate, language_crf, ngram_jaccard, quality_model, queries, sampling, secret_scan, text, toxicity
from lumora.llm.text import Chunk

SMALL = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALL = (1 << 64) - 1


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def code(c):
    return int(text._CODES[ord(c)]) if ord(c) < 65536 else int(text.mix(np.array([ord(c) + (1 << 40)], np.uint64))[0]) | 1


def poly(s):
    return sum(code(c) * pow(text._BASE, i, 1 << 64) for i, c in enumerate(s)) & ALL


def hashed(s):
    return int(text.mix(np.array([(poly(s) + len(s)) & ALL], np.uint64))[0])


def some_texts():
    rows = pq.read_table(f"{SMALL}/documents.parquet", columns=["text"]).column(0).to_pylist()
    return [t for t in rows if len(t) < 1500][:12] + [None, "", " \n", "a", "Éa éa 𝒳𝒴z ab ab", "1 2 - 3", "x1y2 the the"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "t", i) for i, t in enumerate(texts)], "doc_id long, text string, score string, label int")


def test_language_by_plain_loops(spark):
    model = language_crf.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), 20)
    kinds, shift, k = [int(x) for x in language_crf._KINDS], int(language_crf._SHIFT), len(model.languages)

    def bucket(s, kind):
        return ((poly(low(s)) * kinds[kind] + len(s)) * kinds[0] & ALL) >> shift

    def scores(word):
        on = [i for i, c in enumerate(word) if c.isalpha()]
        if not on:
            return np.zeros(k)
        w = word[on[0] : on[-1] + 1]
        found = [bucket(w, 1)]
        for n in (1, 2, 3):
            if len(w) >= n:
                found += [bucket(w[:n], 1 + n), bucket(w[-n:], 4 + n)]
        for n in (2, 3):
            found += [bucket(w[i : i + n], 8 if n == 2 else 0) for i in range(len(w) - n + 1)]
        return model.weights[found].sum(axis=0)

    texts = some_texts()
    got = {r.doc_id: r for r in language_crf.languages(frame(spark, texts), model).collect()}
    t = np.exp(model.passing)
    for i, s in enumerate(texts):
        words = WORD.findall(s or "")
        if not any(c.isalpha() for c in s or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        psi = [np.exp(scores(w) - scores(w).max()) for w in words]
        ahead, behind = [np.full(k, 1 / k) @ t * psi[0]], [np.ones(k)]
        for p in psi[1:]:
            v = ahead[-1] @ t * p
            ahead.append(v / v.sum())
        for p in reversed(psi[1:]):
            v = t @ (p * behind[-1])
            behind.append(v / v.sum())
        share = sum(a * b / (a @ b) for a, b in zip(ahead, reversed(behind), strict=True)) / len(words)
        assert got[i].lang_pred == model.languages[int(np.argmax(share))] and math.isclose(got[i].score, share.max(), abs_tol=1e-9)


def test_quality_by_plain_loops(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality_model.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), per_class=40)
    kinds, shift = [int(x) for x in quality_model._KINDS], int(quality_model._SHIFT)
    texts = some_texts()
    got = {r.doc_id: r for r in quality_model.quality_scores(frame(spark, texts), model).collect()}
    for i, s in enumerate(texts):
        words = WORD.findall(s or "")
        h = [hashed(w) for w in words]
        found = [(x * kinds[0] & ALL) >> shift for x in h]
        found += [quality_model.AGAIN if a == b else ((a ^ (b * kinds[4] & ALL)) * kinds[1] & ALL) >> shift for a, b in zip(h, h[1:], strict=False)]
        for n in quality_model.NGRAMS:
            found += [((poly(w[j : j + n]) * kinds[n % 3 + 2] + n) * kinds[0] & ALL) >> shift for w in words for j in range(len(w) - n + 1)]
        mean = model.vectors[found].astype(float).mean(axis=0) if found else np.zeros(quality_model.WIDTH)
        z = model.map.astype(float) @ mean + model.bias
        assert math.isclose(got[i].score, math.exp(z[1]) / np.exp(z).sum(), rel_tol=1e-4)


def test_toxicity_by_plain_loops(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), per_class=60)
    kinds, shift = [int(x) for x in toxicity._KINDS], int(toxicity._SHIFT)
    toxic = docs.join(spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 1").select("doc_id"), "doc_id").limit(3).collect()
    texts = some_texts() + [r.text for r in toxic]
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, texts), model).collect()}
    hits = 0
    for i, s in enumerate(texts):
        found = []
        for w in re.findall("[A-Za-zÀ-\U0010ffff]+", s or ""):
            found.append((hashed(low(w)) * kinds[0] & ALL) >> shift)
            found += [((poly(low(w[:n])) * kinds[j] + n) * kinds[0] & ALL) >> shift for j, n in enumerate(toxicity.PREFIXES, 1) if len(w) > n]
        eta = sum(model.weights[b] * math.log1p(c) for b, c in Counter(found).items())
        below = [1 / (1 + math.exp(eta - c)) for c in model.cuts] + [1.0]
        p = np.diff([0.0, *below])
        hits += eta > 0
        assert math.isclose(got[i].score, 1 - p[0], abs_tol=1e-9) and math.isclose(got[i].severity, p @ np.arange(4), abs_tol=1e-9)
        assert got[i].toxic == int(1 - p[0] >= model.threshold)
    assert hits


def test_toxicity_fit_takes_in_all_that_the_penalty_lets_in(monkeypatch):
    """Starting with two features or with all ends at the same scores (equal columns share their weight in any way)."""
    rng = np.random.default_rng(5)
    rows = [(" ".join(rng.choice([f"clean{i}" for i in range(30)], 20)) + (" " + " ".join(rng.choice(["foul", "vile", "nasty", "gross"], 2)) if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(90)]
    got = []
    for first in (2, 4096):
        monkeypatch.setattr(toxicity, "FIRST_FEATURES", first)
        model = toxicity.train(rows, 2, steps=3000)
        d, b, v = toxicity.values(Chunk([t for t, _ in rows]))
        got.append(np.bincount(d, weights=model.weights[b] * v, minlength=len(rows)) - model.cuts[0])
        assert (model.weights > 0).sum() > 2
    np.testing.assert_allclose(got[0], got[1], atol=0.02)


def lm_texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(400)]
    p = np.array([1 / (i + 2) for i in range(len(words))])
    return [" ".join(rng.choice(words, int(n), p=p / p.sum())) for n in rng.integers(0, 60, 150)] + ["", "never seen before w1 w2 never", "W1 w1"]


def test_lm_score_by_plain_loops(spark, monkeypatch):
    """With a small core, so that rarer and unseen words take their own ways."""
    for name, n in (("SEEDS", 10), ("CORE", 40), ("SENT", 100)):
        monkeypatch.setattr(brown_lm, name, n)
    texts = lm_texts()
    docs = frame(spark, texts).repartition(3)
    trains = lambda i: i % 10 != 0 and i != 151
    model, rest, common = brown_lm.fit(docs.where("doc_id % 10 != 0 and doc_id != 151"))
    names = sorted({w for t in texts for w in low(t).split()})
    place = {w: int(h) for w, h in zip(names, Chunk(names).word_hashes(True).view(np.int64), strict=True)} | {None: int(brown_lm.END)}
    cls = {int(w): int(k) for w, k in zip(model.core.words, model.core.cls[model.core.place], strict=True)}
    core = set(cls)
    cls |= {r.word: r.cls for r in rest.collect()}
    sequences = [[place[w] for w in low(t).split()] + [place[None]] for t in texts]
    c = Counter(w for i, s in enumerate(sequences) if trains(i) for w in s)
    assert set(c) == set(cls) and len(core) == 40 and model.n_train == sum(c.values())
    state = lambda w: cls[w] if w in core else brown_lm.RARE
    size, tokens = Counter(cls.values()), Counter()
    pairs, out = Counter(), Counter()
    for i, s in enumerate(sequences):
        if trains(i):
            for v, w in zip([place[None], *s], s, strict=False):
                pairs[state(v), cls[w]] += 1
                out[state(v)] += 1
                tokens[cls[w]] += 1
    unseen = max(range(brown_lm.CLASSES), key=lambda k: (size[k], -k))
    total = sum(tokens.values())

    def p(v, w):
        k = cls.get(w, unseen)
        share = (tokens[k] + 0.1) / (total + 0.1 * len(size))
        step = brown_lm.BIGRAM_WEIGHT * (pairs[state(v), k] / out[state(v)] if out[state(v)] else share) + (1 - brown_lm.BIGRAM_WEIGHT) * share
        return step * (c[w] + brown_lm.WORD_PRIOR) / (tokens[k] + brown_lm.WORD_PRIOR * (size[k] + (k == unseen)))

    for v in (place[None], place["w1"], place["rare3"]):
        assert math.isclose(sum(p(v, w) for w in [*c, "unseen"]), 1, rel_tol=1e-9)
    got = {r.doc_id: r for r in brown_lm.lm_scores(docs, F.expr("doc_id % 10 != 0 and doc_id != 151")).collect()}
    for i, s in enumerate(sequences):
        assert math.isclose(got[i].score, sum(math.log10(p(v, w)) for v, w in zip([place[None], *s], s, strict=False)), rel_tol=1e-9)
        assert got[i].n_known == sum(c[w] > 0 for w in s)


def test_classes_gather_words_of_like_neighbours(spark):
    """Words of two alternating kinds: the classes don't mix them."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"{'ab'[j % 2]}{rng.integers(0, 80)}" for j in range(60)) for _ in range(200)]
    model, _, _ = brown_lm.fit(frame(spark, texts))
    kind = {int(h): n[0] for n, h in ((f"{k}{i}", Chunk([f"{k}{i}"]).word_hashes(True).view(np.int64)[0]) for k in "ab" for i in range(80))}
    of = {}
    for w, k in zip(model.core.words.tolist(), model.core.cls[model.core.place].tolist(), strict=True):
        if w in kind:
            of.setdefault(k, Counter())[kind[w]] += 1
    assert sum(max(x.values()) for x in of.values()) > 0.98 * 160


def test_each_pair_is_verified_once(spark, monkeypatch):
    seen, whole = [], ngram_jaccard.verified

    def spy(pairs, *rest):
        seen.extend(tuple(sorted((r.lead, r.member))) for r in pairs.collect())
        return whole(pairs, *rest)

    monkeypatch.setattr(ngram_jaccard, "verified", spy)
    monkeypatch.setattr(ngram_jaccard, "MEETING", 3)
    rng = np.random.default_rng(2)
    texts = []
    for f in range(25):
        base = [f"f{f}w{i}" for i in range(100)]
        for _ in range(8):
            w = list(base)
            for at in rng.integers(0, 100, 1):
                w[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(w))
    docs = frame(spark, texts).repartition(4)
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_classes(docs).collect()}
    made = [{tuple(t.split(" ")[k : k + 5]) for k in range(96)} for t in texts]
    want = list(range(len(texts)))
    for _ in range(8):
        for i, a in enumerate(made):
            for j in range(i // 8 * 8, i):
                if 100 * len(a & made[j]) >= 75 * len(a | made[j]):
                    want[i] = want[j] = min(want[i], want[j])
    assert [got[i] for i in range(len(texts))] == want
    assert len(seen) == len(set(seen)) > 100


def test_suffix_filter_drops_no_link():
    rng = np.random.default_rng(0)
    dropped = 0
    for _ in range(400):
        n, shared = int(rng.integers(1, 800)), rng.random()
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate((x[: int(shared * len(x))], rng.integers(0, 1 << 63, int(rng.integers(1, 800)), dtype=np.int64).astype(np.uint64) * np.uint64(2))))
        may = ngram_jaccard._may_link(75, len(x), ngram_jaccard._ranges(x), len(y), ngram_jaccard._ranges(y))
        both = len(np.intersect1d(x, y))
        link = 100 * both >= 75 * (len(x) + len(y) - both)
        assert may or not link
        dropped += not may
    assert dropped > 100


def test_repeated_ids_do_not_lift_the_bound(spark):
    docs = spark.createDataFrame([(1, f"text {i}", "en") for i in range(3000)] + [(2, "other", "en"), (3, "x" * (sampling.LONGEST + 1), "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    rows = sampling.labelled_texts(docs, sampling.drawn(labels, "quality", 10), "quality", 10, ["doc_id"])
    assert Counter(y for _, y in rows) == {1: 10, 0: 1}


def test_least_of_each_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), int(v)) for k, v in zip(rng.integers(0, 4, 5000), rng.permutation(5000), strict=True)]
    got = {(r.k, r.v) for r in sampling.least_of_each(spark.createDataFrame(rows, "k int, v long").repartition(7), "k", "v", 30).collect()}
    assert got == {(k, v) for k in range(4) for v in sorted(v for a, v in rows if a == k)[:30]}


@pytest.mark.parametrize("chars", [8_000_000, 4000])
def test_recall_of_containment(spark, monkeypatch, chars):
    """Items whole, edited, cut into two far parts, in one pass and in several: recall against exact containment."""
    monkeypatch.setattr(decontaminate, "ITEM_CHARS", chars)
    rng = np.random.default_rng(6)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    items = [word(int(n)) for n in rng.integers(1, 90, 80)]
    docs = []
    for i, item in enumerate(items):
        w = list(item)
        if i % 3 == 1 and len(w) > 40:
            w[len(w) // 2] = "changed"
        if i % 3 == 2:
            w = [*w[: len(w) // 2 + 2], *word(400), *w[max(len(w) // 2 - 2, 0) :]]
        docs.append(" ".join([*word(int(rng.integers(0, 3000))), *w, *word(int(rng.integers(0, 800)))]))
    frames = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained(*frames).collect()}
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = set()
    for j, item in enumerate(items):
        k = min(5, len(item))
        own = grams(item, k)
        want |= {(i, j) for i, t in enumerate(docs) if 100 * len(own & grams(t.split(" "), k)) >= 75 * len(own)}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 60
    left = {r.doc_id for r in decontaminate.without_items(*frames).collect()}
    assert left == set(range(len(docs))) - {i for i, _ in got}


def test_repeated_items_are_sent_once(spark, monkeypatch):
    """However many rows a benchmark text has, each gets its rows, and a block holds the text once."""
    monkeypatch.setattr(decontaminate, "ITEM_CHARS", 400)
    text = " ".join(f"w{i}" for i in range(40))
    items = spark.createDataFrame([(i, text) for i in range(300)] + [(None, text), (500, "other words that are not there at all"), (501, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x y " + text + " z"), (2, "nothing of it")], "doc_id long, text string")
    texts = decontaminate._numbered(items)
    assert sum(len(decontaminate._block(texts, i, n)) for i, n in decontaminate._passes(texts)) == 2
    got = decontaminate.contained(docs, items).collect()
    assert sorted((r.doc_id, -1 if r.item_id is None else r.item_id) for r in got) == [(1, i) for i in range(-1, 300)] and {(r.n_shared, r.n_item) for r in got} == {(36, 36)}
    assert [r.doc_id for r in decontaminate.without_items(docs, items).collect()] == [2]


def test_added_spans_by_plain_loops(spark):
    """The network's probability for every candidate and context, with one position at a time."""
    rng = np.random.default_rng(9)
    net = secret_scan.CharCnn(rng.normal(size=(130, secret_scan.VECTOR)), rng.normal(size=(secret_scan.REACH * secret_scan.VECTOR, secret_scan.FILTERS)), rng.normal(size=secret_scan.FILTERS), rng.normal(size=secret_scan.FILTERS), 0.1, 0.3, 0.2, 0.5)
    long = "".join(rng.choice(list("abcXYZ019"), 130))
    texts = ["aaaabbbbccccdddd at the start", f"é {long} end", "short only", "key = sk_live_0123456789abcdefXYZ, then", None, "", "ab1cdefghi is ten, ab1cdefgh nine, abcdefghij has no digit"]

    def probability(t, s, e):
        c = [ord(x) if ord(x) < 128 else 128 for x in t]
        pick = lambda at, lo, hi: [c[i] if lo <= i < hi else 129 for i in at]
        half = secret_scan.INSIDE // 2
        window = pick(range(s - secret_scan.BEFORE, s), 0, len(t)) + pick(range(s, s + half), s, e) + pick(range(e - half, e), s, e) + pick(range(e, e + secret_scan.AFTER), 0, len(t))
        best = np.max([np.concatenate([net.vectors[x] for x in window[i : i + secret_scan.REACH]]) @ net.filters + net.shift for i in range(len(window) - secret_scan.REACH + 1)], axis=0)
        return 1 / (1 + math.exp(-(net.scale * (np.maximum(best, 0) @ net.out + net.bias) + net.offset)))

    got = {r.doc_id: [(x.start, x.end) for x in r.spans if x.kind == secret_scan.MODEL_KIND] for r in secret_scan.find_secrets(frame(spark, texts), net).collect()}
    for i, t in enumerate(texts):
        want = []
        for m in re.finditer("[A-Za-z0-9+/_=-]+", t or ""):
            s, e = m.span()
            if e - s < (secret_scan.LEAST_DIGIT if re.search("[0-9]", m[0]) else secret_scan.LEAST):
                continue
            step = secret_scan.INSIDE // 2
            parts = [(s, e)] + ([(min(s + k, e - secret_scan.INSIDE), min(s + k, e - secret_scan.INSIDE) + secret_scan.INSIDE) for k in range(0, e - s - secret_scan.INSIDE + step, step)] if e - s > secret_scan.INSIDE else [])
            if max(probability(t, a, b) for a, b in parts) >= net.threshold:
                want.append((s, e))
        assert got[i] == want


@pytest.mark.parametrize("corpus", ["given", "without findings"])
def test_made_keys_that_were_held_out_are_found(spark, corpus):
    """Keys of kinds that the patterns don't know, made by another seed and put into texts; hardly any clean text gets a span, and a corpus without findings trains as well."""
    rows = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    clean = [r for r in rows if not secret_scan.base_findings(Chunk([r["text"]]))]
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in (rows if corpus == "given" else clean)], "doc_id long, text string")
    net = secret_scan.fit(docs)
    rng, put, clean = np.random.default_rng(77), [], clean[:400]
    for i, r in enumerate(clean):
        words, key = r["text"].split(" "), secret_scan.made_key(rng)
        words.insert(len(words) // 2, key)
        put.append((i, " ".join(words), key))
    found = secret_scan.find_secrets(spark.createDataFrame(put, "doc_id long, text string, key string"), net, "text", "key").collect()
    hit = [any(r.text[s.start : s.end] in r.key or r.key in r.text[s.start : s.end] for s in r.spans) for r in found]
    assert np.mean(hit) >= 0.93
    spans = secret_scan.find_secrets(spark.createDataFrame([(i, r["text"]) for i, r in enumerate(clean)], "doc_id long, text string"), net).collect()
    assert np.mean([bool(r.spans) for r in spans]) < 0.01


def test_added_tokens_of_the_vocabulary(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary_path())
    texts = ["one text<|endoftext|>two", "<|startoftext|>A<|endoftext|><|endoftext|>'s", "<|ENDOFTEXT|> <|endoftext", "x <|endoftext|> y,<|startoftext|>z"]
    got = queries.pack(frame(spark, texts), queries.vocabulary_path(), lower=True, ids=True).collect()
    for i, s in enumerate(texts):
        mine = [x for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start) for x in r.ids]
        assert mine == t.encode(s, add_special_tokens=False).ids + [2]
