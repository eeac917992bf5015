"""7. LM scoring: a Brown class-based bigram model over words, beside the smoothed unigram base.

Every training word belongs to one class, found by exchange clustering for the likelihood of class bigrams:

* The SEEDS most frequent words, all others as one unit, are exchanged one at a time on their full bigram counts.
* The CORE most frequent words then join them and are exchanged against counts of each word with each class
  before and after it; these are made in Spark anew for each sweep and are as many as words times classes.
* Every rarer word goes to the class that makes its own neighbours likeliest, by counts that stay in Spark: what
  is gathered there grows with the corpus and its vocabulary.
* Words that no training document has share one place, in the class with the most words.

P(w | v) = P(class of w | state of v) P(w | class of w). A core word's state is its class; rarer words have one
state in common, so that a text can be scored before its rarer words' classes are looked up. Over all training
words and the unseen one, P(w | v) sums to 1. Counts and classes of the SENT most frequent words go to every task;
a rarer word's tokens leave the scoring pass as one row a document and state, and meet their class in a join: being
rare, no such word is a hot key.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.llm.text import Chunk, drop, kept, pieces

#: Words exchanged on their full bigrams, words exchanged by their classes' counts, words sent to every task, and classes.
SEEDS, CORE, SENT, CLASSES = 1000, 30_000, 100_000, 48
#: Weight of the class bigram against the class unigram; added to every count of a word in its class.
BIGRAM_WEIGHT, WORD_PRIOR = 0.9, 0.1

#: The token that ends a document.
END = np.int64(0x5BD1E9955BD1E995)
#: The state of words outside the core, and the number of states.
RARE, STATES = CLASSES, CLASSES + 1
#: Core words in one row of counts.
_ROW = 500


def _hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (hash, A to Z lower-cased), their documents, and the bounds of documents."""
    h = chunk.word_hashes(folded=True).view(np.int64)
    _, _, doc = chunk.words()
    return h, doc, chunk.word_at


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c: tokens of all documents, the end token too."""

    def run(batches):
        for keys, chunk in pieces(batches, chars=1 << 21):
            u, c = np.unique(_hashes(chunk)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(u, END)), pa.array(np.append(c, len(keys)))], ["word", "c"])

    return docs.select("doc_id", "text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Known:
    """Sorted hashes of words, the place of each by frequency, and its class (RARE: none yet)."""

    words: np.ndarray
    place: np.ndarray
    cls: np.ndarray  # by place

    @classmethod
    def of_ranked(cls, ranked: np.ndarray, classes: np.ndarray) -> Known:
        o = np.argsort(ranked, kind="stable")
        return cls(ranked[o], o, classes)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of words; -1 where unknown."""
        if not len(self.words):
            return np.full(len(h), -1)
        near = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[near] == h, self.place[near], -1)

    def states(self, places: np.ndarray) -> np.ndarray:
        return np.where(places >= 0, self.cls[places], RARE) if len(self.cls) else np.full(len(places), RARE)


def _with_ends(x: np.ndarray, at: np.ndarray, end) -> np.ndarray:
    """Tokens of documents in a row, each document followed by end."""
    return np.insert(x, at[1:], end)


def _placed(chunk: Chunk, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, places and states of all tokens, ends included."""
    h, _, at = _hashes(chunk)
    h = _with_ends(h, at, END)
    places = known.find(h)
    return h, places, known.states(places)


def seed_bigrams(docs: DataFrame, seeds: Known) -> np.ndarray:
    """Counts of unit pairs over the documents; a document starts after an end. The last unit is all other words."""
    sent, n = docs.sparkSession.sparkContext.broadcast(seeds), len(seeds.words) + 1

    def run(batches):
        total = np.zeros(n * n, np.int64)
        for _, chunk in pieces(batches, chars=1 << 21):
            u = _placed(chunk, sent.value)[1]
            u = np.where(u < 0, n - 1, u)
            end = sent.value.find(np.array([END]))
            total += np.bincount(np.concatenate((end, u[:-1])) * n + u, minlength=n * n)
        on = np.flatnonzero(total)
        for i in range(0, len(on), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(on[i : i + (1 << 16)]), pa.array(total[on[i : i + (1 << 16)]])], ["pair", "c"])

    found = docs.select("doc_id", "text").mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()  # at most n^2 rows
    out = np.zeros(n * n)
    out[found["pair"].to_numpy()] = found["c"].to_numpy()
    return out.reshape(n, n)


def neighbour_counts(docs: DataFrame, core: Known) -> tuple[np.ndarray, np.ndarray]:
    """How often each core word has each state before it, and after it: two arrays, words x STATES.

    Tasks send _ROW words a row, compressed; rows of one number are added up in two steps.
    """
    sent, n = docs.sparkSession.sparkContext.broadcast(core), len(core.words)

    def run(batches):
        both = np.zeros((2, n * STATES), np.uint32)
        for _, chunk in pieces(batches, chars=1 << 21):
            _, place, state = _placed(chunk, sent.value)
            end = sent.value.states(sent.value.find(np.array([END])))
            before, after = np.concatenate((end, state[:-1])), np.concatenate((state[1:], [-1]))
            on = place >= 0
            both[0] += np.bincount(place[on] * STATES + before[on], minlength=n * STATES).astype(np.uint32)
            on &= after >= 0
            both[1] += np.bincount(place[on] * STATES + after[on], minlength=n * STATES).astype(np.uint32)
        yield from _packed(both, int(both[0].sum()) & 31)

    def add(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for side, part, salt, raw in zip(*(b.column(c).to_pylist() for c in ("side", "part", "salt", "counts")), strict=True):
                x, k = np.frombuffer(zlib.decompress(raw), np.uint64), (side, part, salt)
                sums[k] = sums[k] + x if k in sums else x
        for (side, part, salt), x in sums.items():
            yield _row(side, part, salt, x)

    schema = "side int, part int, salt int, counts binary"
    rows = docs.select("doc_id", "text").mapInArrow(run, schema)
    rows = rows.repartition("side", "part", "salt").mapInArrow(add, schema).withColumn("salt", F.lit(0)).repartition("side", "part").mapInArrow(add, schema)
    out = np.zeros((2, n * STATES))
    for r in rows.collect():  # words x STATES numbers
        x = np.frombuffer(zlib.decompress(r.counts), np.uint64)
        out[r.side, r.part * _ROW * STATES :][: len(x)] = x
    return out[0].reshape(n, STATES), out[1].reshape(n, STATES)


def _row(side: int, part: int, salt: int, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([side], pa.int32()), pa.array([part], pa.int32()), pa.array([salt], pa.int32()), pa.array([zlib.compress(x.astype(np.uint64).tobytes(), 1)], pa.binary())], ["side", "part", "salt", "counts"])


def _packed(both: np.ndarray, salt: int):
    for side in (0, 1):
        for part in range(-(-both.shape[1] // (_ROW * STATES))):
            x = both[side, part * _ROW * STATES : (part + 1) * _ROW * STATES]
            if x.any():
                yield _row(side, part, salt, x)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _gain(n_cd: np.ndarray, to: np.ndarray, fro: np.ndarray, own: float) -> np.ndarray:
    """How much the likelihood rises when a word outside all classes, with so many tokens after (to) and before it (fro) in each, comes to each class."""
    t, f = np.flatnonzero(to), np.flatnonzero(fro)
    x, y, d = n_cd[:, t], n_cd[f], np.diag(n_cd)
    gain = (xlogx(x + to[t]) - xlogx(x)).sum(axis=1)
    gain += (xlogx(y + fro[f, None]) - xlogx(y)).sum(axis=0)
    gain += xlogx(d + to + fro + own) - xlogx(d + to) - xlogx(d + fro) + xlogx(d)
    left, right = n_cd.sum(axis=1), n_cd.sum(axis=0)
    gain -= xlogx(left + to.sum() + own) - xlogx(left)
    gain -= xlogx(right + fro.sum() + own) - xlogx(right)
    # what the word adds to other classes' totals on the other side is the same for every class
    return gain


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = 6) -> np.ndarray:
    """Class of each unit. Units start in classes by rank; each in turn, most frequent first, moves to the class that raises the likelihood most."""
    n = len(bigrams)
    weight = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    turn = np.argsort(-weight, kind="stable")
    cls = np.empty(n, np.int64)
    cls[turn] = np.arange(n) % classes
    one = np.eye(classes)[cls]
    n_cd = one.T @ bigrams @ one
    for _ in range(rounds):
        moved = 0
        for u in turn:
            if not weight[u]:
                break
            own = bigrams[u, u]
            to = np.bincount(cls, weights=bigrams[u], minlength=classes)
            fro = np.bincount(cls, weights=bigrams[:, u], minlength=classes)
            a = cls[u]
            to[a] -= own
            fro[a] -= own
            n_cd[a] -= to
            n_cd[:, a] -= fro
            n_cd[a, a] -= own
            # the likelihood's terms of row and column k change when u comes to k; those of the class totals too
            gain = _gain(n_cd, to, fro, own)
            k = int(np.argmax(gain))
            if gain[k] <= gain[a] + 1e-9:
                k = a
            moved += k != a
            cls[u] = k
            n_cd[k] += to
            n_cd[:, k] += fro
            n_cd[k, k] += own
        if not moved:
            break
    return cls


def class_pairs(before: np.ndarray, after: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """STATES x STATES counts of neighbours, from core words' counts and classes; pairs of two rare words are not in them."""
    out = np.zeros((STATES, STATES))
    np.add.at(out, cls, after)
    rare = np.bincount(cls, weights=before[:, RARE], minlength=STATES)
    rare[RARE] = 0
    out[RARE] += rare
    return out


def likeliest(before: np.ndarray, after: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """For each word (counts of the states around it) the class under which its neighbours and itself are likeliest, given all other words' classes."""
    p = pairs + 0.1
    came = np.log(p[:, :CLASSES] / p.sum(axis=1, keepdims=True))  # class after a state
    goes = np.log(p[:CLASSES] / p[:CLASSES].sum(axis=1, keepdims=True))  # state after a class
    share = np.log(p[:, :CLASSES].sum(axis=0))
    return np.argmax(before @ came + after @ goes.T - before.sum(axis=1, keepdims=True) * share, axis=1)


def sweep(before: np.ndarray, after: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Classes after one exchange sweep over the core words, most frequent first. Words whose neighbours already fit their class best stay; for the others every class's gain is computed."""
    cls, pairs = cls.copy(), class_pairs(before, after, cls)
    for u in np.flatnonzero(likeliest(before, after, pairs) != cls):
        to, fro, a = after[u], before[u], cls[u]
        pairs[a] -= to
        pairs[:, a] -= fro
        np.maximum(pairs, 0, out=pairs)
        gain = _gain(pairs, to, fro, 0.0)[:CLASSES]
        k = int(np.argmax(gain))
        k = a if gain[k] <= gain[a] + 1e-9 else k
        cls[u] = k
        pairs[k] += to
        pairs[:, k] += fro
    return cls


def all_classes(docs: DataFrame, core: Known, pairs: np.ndarray) -> DataFrame:
    """kind, word, c, cls: every training word outside the core (kind 0) with its count and class; and counts of (state before, class), word being state * CLASSES + class, to be added up (kind 1: of core words, 2: of the others)."""
    sent = docs.sparkSession.sparkContext.broadcast((core, pairs))

    def run(batches):
        known, cells = sent.value[0], np.zeros(STATES * CLASSES, np.int64)
        end = known.states(known.find(np.array([END])))
        for _, chunk in pieces(batches, chars=1 << 21):
            h, place, state = _placed(chunk, known)
            before, after = np.concatenate((end, state[:-1])), np.concatenate((state[1:], end))
            on = place >= 0
            cells += np.bincount(before[on] * CLASSES + state[on], minlength=len(cells))
            word, around = h[~on], before[~on] * STATES + after[~on]
            o = np.lexsort((around, word))
            word, around = word[o], around[o]
            first = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (around[1:] != around[:-1])))) if len(o) else o
            if len(first):
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(first), np.int8)), pa.array(word[first]), pa.array(around[first].astype(np.int16)), pa.array(np.diff(np.append(first, len(word))).astype(np.int64))], ["kind", "word", "around", "n"])
        on = np.flatnonzero(cells)
        if len(on):
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(on), np.int8)), pa.array(on), pa.array(np.zeros(len(on), np.int16)), pa.array(cells[on])], ["kind", "word", "around", "n"])

    def assign(batches):
        pairs, cells = sent.value[1], np.zeros(STATES * CLASSES)
        held = None  # the last word so far, its kind, and the states around it

        def done(kind, word, before, after):
            c, cls = before.sum(axis=1).astype(np.int64), likeliest(before, after, pairs).astype(np.int32)
            own = kind == 0
            cells[:] += np.bincount((np.arange(STATES)[None] * CLASSES + cls[own][:, None]).ravel(), weights=before[own].ravel(), minlength=len(cells))
            return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int8)), pa.array(word), pa.array(c), pa.array(cls)], ["kind", "word", "c", "cls"])

        for b in batches:
            if not b.num_rows:
                continue
            kind, word, around, n = (b.column(c).to_numpy().astype(np.int64) for c in ("kind", "word", "around", "n"))
            new = np.concatenate(([True], (word[1:] != word[:-1]) | (kind[1:] != kind[:-1])))
            which, first = np.cumsum(new) - 1, np.flatnonzero(new)
            before = np.bincount(which * STATES + around // STATES, weights=n, minlength=len(first) * STATES).reshape(-1, STATES)
            after = np.bincount(which * STATES + around % STATES, weights=n, minlength=len(first) * STATES).reshape(-1, STATES)
            kind, word = kind[first], word[first]
            if held is not None:
                if held[0][0] == kind[0] and held[1][0] == word[0]:
                    before[0] += held[2][0]
                    after[0] += held[3][0]
                else:
                    kind, word, before, after = (np.concatenate(x) for x in zip(held, (kind, word, before, after), strict=True))
            held = kind[-1:], word[-1:], before[-1:], after[-1:]
            if len(word) > 1:
                yield done(kind[:-1], word[:-1], before[:-1], after[:-1])
        if held is not None:
            yield done(*held)
        on = np.flatnonzero(cells)
        if len(on):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), 2, np.int8)), pa.array(on), pa.array(cells[on].astype(np.int64)), pa.array(np.zeros(len(on), np.int32))], ["kind", "word", "c", "cls"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "kind byte, word long, around short, n long")
    return rows.repartition("kind", "word").sortWithinPartitions("kind", "word").mapInArrow(assign, "kind byte, word long, c long, cls int")


@dataclass
class ClassModel:
    core: Known
    passing: np.ndarray  # log10 P(class | state before), STATES x CLASSES
    class_total: np.ndarray  # tokens of each class in training
    class_words: np.ndarray  # training words of each class
    unseen: int  # the class that words without training tokens belong to
    n_train: int
    n_vocabulary: int

    def places(self) -> np.ndarray:
        """Words of each class, the unseen one counted."""
        return self.class_words + (np.arange(CLASSES) == self.unseen)

    def emission(self, c: np.ndarray, cls: np.ndarray) -> np.ndarray:
        return np.log10((c + WORD_PRIOR) / (self.class_total + WORD_PRIOR * self.places())[cls])

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n_train + 0.1 * (self.n_vocabulary + 1)))


def fit(docs: DataFrame) -> tuple[ClassModel, DataFrame, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The model; word, c, cls of all training words outside the core (written to the shared folder); and the SENT most frequent words, sorted, with counts and classes."""
    counts = kept(word_counts(docs), "counts")
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(CORE).toArrow()
    ranked, c = top["word"].to_numpy(), top["c"].to_numpy()
    if len(ranked) and END not in ranked:
        ranked, c = np.append(ranked[:-1], END), np.append(c[:-1], counts.where(F.col("word") == int(END)).first().c)
    drop(counts)
    cls = np.full(len(ranked), RARE)
    seeds = np.flatnonzero((np.arange(len(ranked)) < SEEDS) | (ranked == END))
    if len(seeds):
        cls[seeds] = exchange(seed_bigrams(docs, Known.of_ranked(ranked[seeds], cls[seeds])))[:-1]
        for turn in range(2):
            before, after = neighbour_counts(docs, Known.of_ranked(ranked, cls))
            if turn == 0:
                cls = np.where(cls == RARE, likeliest(before, after, class_pairs(before, after, cls)), cls)
            else:
                cls = sweep(before, after, cls)
        pairs = class_pairs(before, after, cls)
    else:
        pairs = np.zeros((STATES, STATES))
    core = Known.of_ranked(ranked, cls)
    table = kept(all_classes(docs, core, pairs), "classes")
    cells = np.zeros(STATES * CLASSES)
    for r in table.where("kind > 0").groupBy("word").agg(F.sum("c").alias("c")).collect():  # at most STATES x CLASSES rows
        cells[r.word] = r.c
    pairs = cells.reshape(STATES, CLASSES)
    words = np.bincount(cls, minlength=CLASSES)[:CLASSES].astype(float)
    total = np.bincount(cls, weights=c, minlength=CLASSES)[:CLASSES]
    rest = table.where("kind = 0").select("word", "c", "cls")
    for r in rest.groupBy("cls").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect():
        words[r.cls] += r.n
        total[r.cls] += r.c
    unseen = int(np.argmax(words))
    used = (words > 0) | (np.arange(CLASSES) == unseen)  # a class without words is never passed to
    share = np.where(used, total + 0.1, 0) / (total.sum() + 0.1 * used.sum())
    out = pairs.sum(axis=1, keepdims=True)
    passing = BIGRAM_WEIGHT * np.where(out > 0, pairs / np.maximum(out, 1), share) + (1 - BIGRAM_WEIGHT) * share
    model = ClassModel(core, np.log10(np.maximum(passing, 1e-300)), total, words, unseen, int(n or 0), int(v or 0))
    more = rest.orderBy(F.desc("c"), "word").limit(max(SENT - len(ranked), 0)).toArrow()
    words, c, cls = (np.concatenate((a, more[k].to_numpy())) for a, k in ((ranked, "word"), (c, "c"), (cls, "cls")))
    o = np.argsort(words, kind="stable")
    return model, rest, (words[o], c[o], cls[o])


def lm_scores(docs: DataFrame, training: Column) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities), perplexity.

    training: which documents the model learns from. Tokens are the words of a text, A to Z lower-cased,
    and one end; a null or empty text is the end alone. base_score: the sum of log10((c + 0.1) / (N + 0.1
    (V + 1))). score: of the class model. Whole texts are counted and scored. Repeated rows count, and come
    back, each; null ids are carried; an empty table gives no rows; further columns are not read. Words of
    equal count are ranked by their hash.
    """
    model, rest, common = fit(docs.where(training))
    sent = docs.sparkSession.sparkContext.broadcast((model, common))

    def run(batches):
        from pyspark import TaskContext

        m, (words, c, cls) = sent.value
        row = TaskContext.get().partitionId() << 36
        end = m.core.states(m.core.find(np.array([END])))
        for keys, chunk in pieces(batches):
            h, _, at = _hashes(chunk)
            d = chunk.docs
            h = _with_ends(h, at, END)
            doc = np.repeat(np.arange(d), np.diff(at) + 1)
            state = m.core.states(m.core.find(h))
            before = np.concatenate((end, state[:-1]))
            if len(words):
                near = np.minimum(np.searchsorted(words, h), len(words) - 1)
                found = words[near] == h
                k, at_class = c[near[found]], cls[near[found]]
                score = np.bincount(doc[found], weights=m.passing[before[found], at_class] + m.emission(k, at_class), minlength=d).astype(float)
                base = np.bincount(doc[found], weights=m.base(k), minlength=d).astype(float)
            else:  # nothing to learn from: every word is an unseen one
                found, score, base = np.zeros(len(h), bool), np.zeros(d), np.zeros(d)
            known = np.bincount(doc[found], minlength=d)
            rows = row + np.arange(d)
            row += d
            # a document's own row, then its rarer words
            (rd, rw, rs), times = _distinct(doc[~found], h[~found], before[~found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.concatenate((rows, rows[rd])), np.concatenate((np.zeros(d, np.int64), rw)), np.concatenate((np.diff(at) + 1, times)), np.concatenate((known, np.zeros(len(times), np.int64))), np.concatenate((base, np.zeros(len(times)))), np.concatenate((score, np.zeros(len(times)))), np.concatenate((np.full(d, -1), rs)).astype(np.int32))] + [pa.array(keys + [None] * len(times), pa.int64())],
                ["row", "word", "n", "known", "base", "score", "state", "doc_id"],
            )

    rows = kept(docs.select("doc_id", "text").mapInArrow(run, "row long, word long, n long, known long, base double, score double, state int, doc_id long"), "scored")
    rare = rows.where("state >= 0").select("row", "word", "n", "state").join(rest, "word", "left")
    c, cls = F.coalesce("c", F.lit(0)), F.coalesce("cls", F.lit(model.unseen))
    numbers = lambda x: F.split(F.lit(",".join(map(repr, x.ravel().tolist()))), ",").cast("array<double>")  # noqa: E731  one constant
    passing, totals = numbers(model.passing), numbers(model.class_total + WORD_PRIOR * model.places())
    base_total = float(model.n_train + 0.1 * (model.n_vocabulary + 1))
    rare = rare.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * F.log10((c + 0.1) / F.lit(base_total))).alias("rare_base"),
        F.sum(F.col("n") * (F.element_at(passing, F.col("state") * CLASSES + cls + 1) + F.log10((c + WORD_PRIOR) / F.element_at(totals, cls + 1)))).alias("rare_score"),
    )
    own = rows.where("state < 0")
    score = F.col("score") + F.coalesce("rare_score", F.lit(0.0))
    return own.join(rare, "row", "left").select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n")).alias("perplexity"),
    )


def _distinct(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of keys, and the count of each."""
    o = np.lexsort(keys[::-1])
    x = [k[o] for k in keys]
    new = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in x], axis=0)))) if len(o) else np.zeros(0, np.int64)
    return [k[new] for k in x], np.diff(np.append(new, len(o)))
