"""4. Language ID: a linear-chain conditional random field over words.

Each word has features: the word itself (the lexicon), its first and last one to three letters, and its
character bigrams and trigrams, hashed. Learned weights give each language's score for a word, a learned
matrix the score of passing from one word's language to the next one's. Forward-backward gives each
word's language probabilities, so that a switch within a text shows. A document's language is the one with
the largest share of its words' probability.

Training maximises the likelihood of mixed sequences made from labelled texts: runs of words of one
language, switching at random, so that the transitions are learned from switched text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumora.llm.sampling import drawn, labelled_texts
from lumora.llm.text import _INVERSE, Chunk, map_chunks, pieces, powers

BITS = 17
#: Labelled documents of each language in the training sample, at most; words in each training sequence; chance of a switch after a word.
PER_LANGUAGE, SEQUENCE, SWITCH = 250, 64, 0.02
#: Words that are scanned as one block.
BLOCK = 64

_SHIFT = np.uint64(64 - BITS)
_KINDS = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0x2545F4914F6CDD1D, 0xFF51AFD7ED558CCD)]
_LETTERS = np.array([chr(c).isalpha() for c in range(1 << 16)])


def has_letter(cp: np.ndarray) -> np.ndarray:
    out = _LETTERS[np.minimum(cp, 65535)]
    high = cp > 65535
    if high.any():
        out[high] = [chr(c).isalpha() for c in cp[high].tolist()]
    return out


def word_features(chunk: Chunk, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each feature of the words s:e, A to Z lower-cased, from their first to their last letter; words without a letter have none."""
    sums, inv = chunk.sums(folded=True), powers(_INVERSE, len(chunk.cp) + 1)
    letters = np.concatenate(([0], np.cumsum(has_letter(chunk.cp))))
    # where the count of letters first passes its value at s, and first reaches its value at e
    at = np.searchsorted(letters, letters[s] + 1) - 1
    to = np.searchsorted(letters, letters[e])
    real = letters[e] > letters[s]
    s, e = np.where(real, at, s), np.where(real, to, s)

    def bucket(a, b, kind):
        return ((sums[b] - sums[a]) * inv[a] * _KINDS[kind] + (b - a).astype(np.uint64)) * _KINDS[0] >> _SHIFT

    words = np.arange(len(s))
    out = [(words[real], bucket(s[real], e[real], 1))]
    for n in (1, 2, 3):
        long = e - s >= n
        out += [(words[long], bucket(s[long], s[long] + n, 1 + n)), (words[long], bucket(e[long] - n, e[long], 4 + n))]
    for n in (2, 3):
        k = np.maximum(e - s - n + 1, 0)
        which = np.repeat(words, k)
        start = s[which] + np.arange(len(which)) - np.repeat(np.cumsum(k) - k, k)
        out.append((which, bucket(start, start + n, 8 if n == 2 else 0)))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out]).astype(np.int64)


@dataclass
class CrfModel:
    languages: list[str]
    weights: np.ndarray  # 2^BITS x languages
    passing: np.ndarray  # languages x languages, log scores

    def scores(self, chunk: Chunk) -> np.ndarray:
        """Each word's score for each language; equal words are looked at once."""
        s, e, _ = chunk.words()
        if not len(s):
            return np.zeros((0, len(self.languages)))
        _, first, which = np.unique(chunk.span(chunk.sums(folded=True), s, e), return_index=True, return_inverse=True)
        word, b = word_features(chunk, s[first], e[first])
        own = np.stack([np.bincount(word, weights=self.weights[b, k], minlength=len(first)) for k in range(len(self.languages))], axis=1)
        return own[which]


def marginals(scores: np.ndarray, passing: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Language probabilities of each word by forward-backward. starts: bounds of the documents' words.

    Documents are cut into blocks. Each block's product of transitions is made for all blocks at once,
    the products are chained within a document, and both passes then run within all blocks at once: the
    steps depend on a document's blocks, not on its words.
    """
    n, k = scores.shape
    if not n:
        return np.zeros((0, k))
    t = np.exp(passing - passing.max())
    psi = np.exp(scores - scores.max(axis=1, keepdims=True))
    sizes = np.diff(starts)
    blocks = -(-sizes // BLOCK)
    doc = np.repeat(np.arange(len(sizes)), blocks)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = starts[doc] + place * BLOCK
    size = np.minimum(BLOCK, starts[doc + 1] - begin)
    at = np.minimum(begin[:, None] + np.arange(BLOCK), n - 1)
    inside = np.arange(BLOCK) < size[:, None]
    p = psi[at]  # blocks x BLOCK x k

    whole = np.broadcast_to(np.eye(k), (len(doc), k, k)).copy()
    for i in range(BLOCK):
        on = inside[:, i]
        if not on.any():
            break
        m = (whole[on] @ t) * p[on, i][:, None, :]
        whole[on] = m / m.max(axis=(1, 2), keepdims=True)
    ahead, behind = np.full((len(doc), k), 1.0 / k), np.ones((len(doc), k))
    first = np.cumsum(blocks) - blocks
    for j in range(1, int(blocks.max())):
        b = first[blocks > j] + j
        v = np.einsum("bi,bij->bj", ahead[b - 1], whole[b - 1])
        ahead[b] = v / v.sum(axis=1, keepdims=True)
        b = first[blocks > j] + blocks[blocks > j] - 1 - j
        v = np.einsum("bij,bj->bi", whole[b + 1], behind[b + 1])
        behind[b] = v / v.sum(axis=1, keepdims=True)
    alpha = np.empty_like(p)
    a = ahead
    for i in range(BLOCK):
        v = (a @ t) * p[:, i]
        v /= np.maximum(v.sum(axis=1, keepdims=True), 1e-300)
        a = np.where(inside[:, i, None], v, a)
        alpha[:, i] = a
    b = behind
    for i in reversed(range(BLOCK)):
        alpha[:, i] *= b
        v = (p[:, i] * b) @ t.T
        v /= np.maximum(v.sum(axis=1, keepdims=True), 1e-300)
        b = np.where(inside[:, i, None], v, b)
    out = alpha[inside]
    return out / out.sum(axis=1, keepdims=True)


def mixed(words_by_language: list[np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of words (ids) and their languages: runs from the languages' texts, in order, until the words are used up."""
    left = [len(w) for w in words_by_language]
    used = [0] * len(left)
    ids, tags = [], []
    now = 0
    while sum(left):
        have = [i for i, n in enumerate(left) if n]
        others = [i for i in have if i != now] or have
        now = int(rng.choice(others, p=np.array([left[i] for i in others]) / sum(left[i] for i in others)))
        n = min(int(rng.geometric(SWITCH)), left[now])
        ids.append(words_by_language[now][used[now] : used[now] + n])
        tags.append(np.full(n, now))
        used[now] += n
        left[now] -= n
    x, y = np.concatenate(ids), np.concatenate(tags)
    whole = max(len(x) // SEQUENCE, 1) * SEQUENCE
    return np.resize(x, whole).reshape(-1, SEQUENCE), np.resize(y, whole).reshape(-1, SEQUENCE)


def train(rows: list[tuple[str, str]], steps: int = 40, seed: int = 11) -> CrfModel:
    """rows: (text, language). Adam on the mean negative log-likelihood of the mixed sequences."""
    languages = sorted({lang for _, lang in rows})
    k = len(languages)
    chunk = Chunk([t for t, _ in rows])
    s, e, doc = chunk.words()
    weights, passing = np.zeros((1 << BITS, max(k, 1))), np.zeros((max(k, 1), max(k, 1)))
    if k < 2 or not len(s):
        return CrfModel(languages, weights, passing)
    _, first, which = np.unique(chunk.span(chunk.sums(folded=True), s, e), return_index=True, return_inverse=True)
    word, bucket = word_features(chunk, s[first], e[first])
    tag = np.array([languages.index(lang) for _, lang in rows])[doc]
    x, y = mixed([which[tag == i] for i in range(k)], np.random.default_rng(seed))
    n, m1, m2 = len(first), np.zeros_like(weights), np.zeros_like(weights)
    p1, p2 = np.zeros_like(passing), np.zeros_like(passing)
    truth = np.zeros((n, k))
    np.add.at(truth, (x.ravel(), y.ravel()), 1)
    pairs = np.zeros((k, k))
    np.add.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    for step in range(1, steps + 1):
        own = np.stack([np.bincount(word, weights=weights[bucket, j], minlength=n) for j in range(k)], axis=1)
        psi = np.exp(own - own.max(axis=1, keepdims=True))[x]
        t = np.exp(passing - passing.max())
        alpha, beta = np.empty_like(psi), np.ones_like(psi)
        alpha[:, 0] = psi[:, 0] / psi[:, 0].sum(axis=1, keepdims=True)
        for i in range(1, SEQUENCE):
            v = (alpha[:, i - 1] @ t) * psi[:, i]
            alpha[:, i] = v / v.sum(axis=1, keepdims=True)
        both = np.zeros((k, k))
        for i in range(SEQUENCE - 2, -1, -1):
            out = psi[:, i + 1] * beta[:, i + 1]
            v = out @ t.T
            beta[:, i] = v / v.sum(axis=1, keepdims=True)
            joint = alpha[:, i][:, :, None] * t[None] * out[:, None, :]
            both += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        post = alpha * beta
        post /= post.sum(axis=2, keepdims=True)
        g_word = np.stack([np.bincount(x.ravel(), weights=post[:, :, j].ravel(), minlength=n) for j in range(k)], axis=1) - truth
        g = np.stack([np.bincount(bucket, weights=g_word[word, j], minlength=1 << BITS) for j in range(k)], axis=1) / x.size + 1e-7 * weights
        g_pass = (both - pairs) / x.size
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        p1, p2 = 0.9 * p1 + 0.1 * g_pass, 0.99 * p2 + 0.01 * g_pass * g_pass
        fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
        weights -= 0.1 * (m1 / fix1) / (np.sqrt(m2 / fix2) + 1e-8)
        passing -= 0.1 * (p1 / fix1) / (np.sqrt(p2 / fix2) + 1e-8)
    return CrfModel(languages, weights, passing)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> CrfModel:
    """From docs with a lang: all languages, at most per_language documents of each, those with the least hash of doc_id."""
    known = docs.where("lang is not null and text is not null")
    rows = labelled_texts(known, drawn(known, "lang", per_language), "lang", per_language, ["doc_id", "lang"])
    return train(rows) if rows else CrfModel([], np.zeros((1 << BITS, 1)), np.zeros((1, 1)))


def languages(docs: DataFrame, model: CrfModel) -> DataFrame:
    """Per row: doc_id, lang_pred, score (the language's share of the words' probability), n_switches (changes of the likeliest language).

    A null text, one without a letter, or a model without languages gives und and score 0. Of languages
    with equal shares the first by name counts. Texts are read whole. Rows are labelled alone: repeated rows and null ids come back as they are; an empty table
    gives no rows; further columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(keys, chunk):
        m = sent.value
        d = chunk.docs
        lettered = np.add.reduceat(has_letter(chunk.cp).astype(np.int64), chunk.starts[:-1]) > 0
        if not m.languages:
            return {"doc_id": pa.array(keys, pa.int64()), "lang_pred": ["und"] * d, "score": np.zeros(d), "n_switches": np.zeros(d, np.int64)}
        _, _, doc = chunk.words()
        p = marginals(m.scores(chunk), m.passing, chunk.word_at)
        share = np.stack([np.bincount(doc, weights=p[:, j], minlength=d) for j in range(p.shape[1])], axis=1).astype(float)
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
        best = np.argmax(share, axis=1)
        likely = np.argmax(p, axis=1)
        turns = np.bincount(doc[1:][(likely[1:] != likely[:-1]) & (doc[1:] == doc[:-1])], minlength=d)
        return {
            "doc_id": pa.array(keys, pa.int64()),
            "lang_pred": [m.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)],
            "score": np.where(lettered, np.clip(share[np.arange(d), best], 0, 1), 0.0),
            "n_switches": np.where(lettered, turns, 0),
        }

    return map_chunks(docs, label, "doc_id long, lang_pred string, score double, n_switches long")


def language_spans(docs: DataFrame, model: CrfModel) -> DataFrame:
    """doc_id, start, end (code points), lang: the runs of words of one likeliest language, for code-switched text.

    A word without letters goes with the language that its neighbours make likeliest; of equally likely ones
    the first by name. Null, empty and wordless texts, and a model without languages, give no rows. Repeated
    rows give their spans each, null ids are carried, an empty table gives no rows, further columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for keys, chunk in pieces(batches):
            s, e, doc = chunk.words()
            if not len(s) or not sent.value.languages:
                continue
            likely = np.argmax(marginals(sent.value.scores(chunk), sent.value.passing, chunk.word_at), axis=1)
            new = np.flatnonzero(np.concatenate(([True], (likely[1:] != likely[:-1]) | (doc[1:] != doc[:-1]))))
            last = np.concatenate((new[1:], [len(s)])) - 1
            base = chunk.starts[doc[new]]
            yield pa.RecordBatch.from_arrays([pa.array([keys[d] for d in doc[new]], pa.int64()), pa.array(s[new] - base), pa.array(e[last] - base), pa.array([sent.value.languages[x] for x in likely[new]])], ["doc_id", "start", "end", "lang"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, end long, lang string")
