"""1. N-gram Jaccard join: documents whose sets of 5-word shingles are alike, by prefix filtering.

Texts with equal sets are one class from the start (a fingerprint of the set). For the rest the usual
filters hold, each of them exact:

* rare first: a set's shingles are ordered by how often their bucket occurs in the corpus (a sketch that
  grows with the corpus up to a bound, summed over all documents), then by hash. Sets of n shingles that
  are alike share one of the first n - ceil(t n) + 1.
* length: t <= sizes' quotient.
* position: after the first shared shingle, enough shingles must remain in both.
* suffix: the counts of both sets in ranges of the hash bound their difference from below. The counts take
  about a thirtieth of a set's bytes and meet before any set is sent.

Pairs come in two rounds. In the first, each prefix shingle pairs its documents with the one that has
it earliest, so that a group of thousands of near copies gives thousands of pairs, not their square.
Once those are verified, the second round pairs what the same shingle holds in different components; long
lists are split by the sets' sizes and, beyond that, over several tasks. A pair that several shingles
propose, in whichever order, is verified once. All pairs that the filters let through are then verified or
lie within one component. That settles the
classes. The links themselves lie within components, so jaccard_links and link_counts compare all sets of
a component with one another, block by block.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumora.llm.components import components
from lumora.llm.text import Chunk, drop, kept, shingles

#: Bits of the number of buckets for the corpus's shingle counts (some eight a document), at least and at most; buckets in a row of counts.
LEAST_BITS, MOST_BITS, SKETCH_ROW = 20, 23, 1 << 14
#: Sets whose fingerprints a task remembers so as not to post them twice.
SEEN = 1 << 20
#: A shingle's list up to so long is searched for pairs at once; longer ones go on whole.
LONG = 64
#: Members that are verified against one lead in one group, postings of a shingle and size that meet in one group, and leads that a set is sent to at once; more are dealt to several.
MEMBERS, MEETING, LEADS = 128, 1000, 64
#: Different sets and shingles in a block of a component, about; two blocks' shared shingles are matrix products of so many columns.
BLOCK_SETS, BLOCK_SHINGLES, COLUMNS = 512, 1 << 20, 4096
#: Up to so many ids, and of rows with lists so many entries (some 50 bytes each), are sent to all executors; more are joined by a shuffle.
BROADCAST_IDS, BROADCAST_ENTRIES = 200_000, 1_000_000


def _sets(chunk: Chunk, words: int) -> list[np.ndarray]:
    h = chunk.word_hashes(folded=True)
    at = chunk.word_at
    return [shingles(h[at[i] : at[i + 1]], words) for i in range(chunk.docs)]


def _fingerprint(x: np.ndarray) -> int:
    """Of a whole set; 64 bits, so that among 10^10 different sets about three pairs would be taken for one."""
    a = np.bitwise_xor.reduce(x * np.uint64(0x9E3779B97F4A7C15)) if len(x) else np.uint64(0)
    b = int(np.add.reduce(x ^ (x >> np.uint64(17)))) if len(x) else 0
    h = (int(a) * 0x2545F4914F6CDD1D + b * 0xD6E8FEB86659FD93 + len(x)) & (2**64 - 1)
    h ^= h >> 32
    h = (h * 0xD6E8FEB86659FD93) & (2**64 - 1)
    h ^= h >> 29
    return h - 2**64 if h >= 2**63 else h


def _ranges(x: np.ndarray) -> bytes:
    """Counts of a set's shingles in ranges of the hash, a byte each (255: or more); about a range for four shingles."""
    bits = max(3, int(len(x) / 4 - 1e-9).bit_length())
    return np.minimum(np.bincount((x >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _may_link(percent: int, n: int, a: bytes, m: int, b: bytes) -> bool:
    """Suffix filter: what differs in the ranges is in one set only. A count of 255 may be more, so that ranges with one prove nothing."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    if (x == 255).any() or (y == 255).any():
        return True
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    apart = int(np.abs(x - y.reshape(len(x), -1).sum(axis=1)).sum())
    return n + m - apart >= 2 * -(-percent * (n + m) // (100 + percent))


def _pressed(x: np.ndarray) -> bytes:
    """Counts compressed by planes of bytes: most are small, so that all but the lowest are zeros."""
    return zlib.compress(np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpressed(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def sketch_bits(docs: DataFrame) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (docs.count() * 8).bit_length()))


def signatures(docs: DataFrame, words: int = 5, bits: int = LEAST_BITS) -> DataFrame:
    """doc_id, node (a set's fingerprint), n (its size), ranges for each document, and the corpus's shingle counts (doc_id null, n a row of the sketch)."""

    def run(batches):
        from lumora.llm.text import pieces

        total = np.zeros(1 << bits, np.uint32)
        for keys, chunk in pieces(batches):
            sets = _sets(chunk, words)
            u, c = np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_counts=True)
            total[u.astype(np.int64)] += c.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(["d"] * len(sets)), pa.array(keys, pa.int64()), pa.array([_fingerprint(x) for x in sets]), pa.array([len(x) for x in sets], pa.int64()), pa.array([_ranges(x) if len(x) else None for x in sets], pa.binary())], ["kind", "doc_id", "node", "n", "counts"])
        if total.any():
            salt = int(total.sum()) & 7
            for i in range(len(total) // SKETCH_ROW):
                yield pa.RecordBatch.from_arrays([pa.array(["s"]), pa.nulls(1, pa.int64()), pa.array([salt]), pa.array([i], pa.int64()), pa.array([_pressed(total[i * SKETCH_ROW : (i + 1) * SKETCH_ROW])], pa.binary())], ["kind", "doc_id", "node", "n", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "kind string, doc_id long, node long, n long, counts binary")


def _summed(rows: DataFrame, *by: str) -> DataFrame:
    """Sketch rows added up, a running sum for each n of a partition: memory doesn't grow with the rows."""

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for node, n, c in zip(b.column("node").to_pylist(), b.column("n").to_pylist(), b.column("counts").to_pylist(), strict=True):
                x = _unpressed(c)
                k = (node, n) if len(by) > 1 else (0, n)
                sums[k] = np.minimum(sums[k] + x.astype(np.uint64), 2**32 - 1) if k in sums else x.astype(np.uint64)
        for (node, n), x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([n], pa.int64()), pa.array([_pressed(x)], pa.binary())], ["node", "n", "counts"])

    return rows.select("node", "n", "counts").repartition(*by).mapInArrow(run, "node long, n long, counts binary")


def corpus_counts(sketch: DataFrame, bits: int) -> np.ndarray:
    """The bucket counts, added in two steps (2^MOST_BITS times 4 bytes at most, whatever the corpus)."""
    out = np.zeros(1 << bits, np.uint32)
    for r in _summed(_summed(sketch, "n", "node"), "n").toLocalIterator():
        out[r.n * SKETCH_ROW : (r.n + 1) * SKETCH_ROW] = _unpressed(r.counts)
    return out


def prefix_postings(docs: DataFrame, counts: np.ndarray, percent: int, words: int = 5) -> DataFrame:
    """shingle, pos, node, n: the rare-first prefix of each set; a set that a task has seen is not given again."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        from lumora.llm.text import pieces

        common, seen = sent.value, set()
        shift = np.uint64(65 - len(common).bit_length())
        for _, chunk in pieces(batches):
            if len(seen) > SEEN:
                seen.clear()  # a set that comes again is dropped where its postings meet
            cols: tuple[list, list, list, list] = ([], [], [], [])
            for x in _sets(chunk, words):
                if not len(x) or (node := _fingerprint(x)) in seen:
                    continue
                seen.add(node)
                n = len(x)
                p = n - -(-percent * n // 100) + 1
                first = x[np.argsort(common[(x >> shift).astype(np.int64)], kind="stable")[:p]]
                for c, v in zip(cols, (first.view(np.int64), np.arange(p, dtype=np.int32), np.full(p, node, np.int64), np.full(p, n, np.int32)), strict=True):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["shingle", "pos", "node", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "shingle long, pos int, node long, n int")


def _fits(percent: int, n: np.ndarray, pos: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Length and positional filter for pairs whose first shared shingle this may be."""
    small, large = np.minimum(n, m), np.maximum(n, m)
    need = -(-percent * (n + m) // (100 + percent))
    return (100 * small >= percent * large) & (1 + np.minimum(n - pos, m - at) - 1 >= need)


def _some_partner(percent: int, sh: np.ndarray, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which postings the filters let pair with another one of the same shingle. Lists of more than LONG count as paired."""
    out, i, d = np.zeros(len(sh), bool), np.arange(len(sh)), 1
    while len(i := i[i + d < len(sh)]) and len(i := i[sh[i + d] == sh[i]]):
        if d >= LONG:
            return out | np.isin(sh, sh[i])
        ok = i[_fits(percent, n[i], pos[i], n[i + d], pos[i + d])]
        out[ok] = out[ok + d] = True
        d += 1
    return out


def shared_postings(postings: DataFrame, percent: int) -> DataFrame:
    """Postings that may pair with another one of their shingle, each with the shingle's first set (lead) and whether the filters let that pair through (fits)."""

    def run(batches):
        held: list[np.ndarray] = []  # the last shingle's rows so far, if just one node
        lead = None  # of the shingle that goes on: shingle, node, n, pos
        for b in batches:
            sh, pos, node, n = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shingle", "pos", "node", "n"))
            if not len(sh):
                continue
            if held:
                sh, pos, node, n = (np.concatenate(([h], x)) for h, x in zip(held, (sh, pos, node, n), strict=True))
                held = []
            new = np.concatenate(([True], sh[1:] != sh[:-1]))
            same = np.concatenate(([False], ~new[1:] & (node[1:] == node[:-1])))
            if same.any():
                sh, pos, node, n = (x[~same] for x in (sh, pos, node, n))
                new = np.concatenate(([True], sh[1:] != sh[:-1]))
            first = np.flatnonzero(new)
            size = np.diff(np.concatenate((first, [len(sh)])))
            which = np.repeat(np.arange(len(first)), size)
            l_node, l_n, l_pos = node[first][which], n[first][which], pos[first][which]
            more = size[which] > 1
            if lead is not None and lead[0] == sh[0]:
                run0 = which == 0
                l_node[run0], l_n[run0], l_pos[run0] = lead[1:]
                more |= run0
            elif lead is not None:
                lead = None
            open_run = (which == which[-1]) | ((which == 0) & (more & (size[which] == 1) | (lead is not None)))
            if size[-1] == 1 and not more[-1]:
                held = [x[-1] for x in (sh, pos, node, n)]
                lead = None
            else:
                lead = (sh[-1], l_node[-1], l_n[-1], l_pos[-1])
            more[more] = open_run[more] | _some_partner(percent, sh[more], n[more], pos[more])
            if more.any():
                sh, pos, node, n, l_node, l_n, l_pos = (x[more] for x in (sh, pos, node, n, l_node, l_n, l_pos))
                ok = (node != l_node) & _fits(percent, n, pos, l_n, l_pos)
                yield pa.RecordBatch.from_arrays([pa.array(sh), pa.array(pos.astype(np.int32)), pa.array(node), pa.array(n.astype(np.int32)), pa.array(l_node), pa.array(ok)], ["shingle", "pos", "node", "n", "lead", "fits"])

    return postings.repartition("shingle").sortWithinPartitions("shingle", "pos", "node").mapInArrow(run, "shingle long, pos int, node long, n int, lead long, fits boolean")


def proposed(pairs: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """lead, member: each pair of nodes (lead, member) once, whichever is which, of those that the suffix filter lets through. named: node, n, ranges, a row or more for each node."""
    low, high = F.least("lead", "member"), F.greatest("lead", "member")
    once = pairs.where("lead != member").groupBy(low.alias("a"), high.alias("b")).agg(F.min("lead").alias("lead"))
    once = once.select("lead", F.when(F.col("lead") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("member"))
    base = once = kept(once, "once")
    nodes = kept(once.select(F.col("lead").alias("node")).union(once.select("member")).distinct(), "nodes")
    names = named.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("ranges").alias("ranges"))
    names = kept(names, "ranges")
    for side in ("lead", "member"):
        once = once.join(names.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("ranges").alias(f"{side}_r")), side)

    def run(batches):
        for b in batches:
            keep = [_may_link(percent, *row) for row in zip(*(b.column(c).to_pylist() for c in ("lead_n", "lead_r", "member_n", "member_r")), strict=True)]
            if any(keep):
                yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep)) for c in ("lead", "member")], ["lead", "member"])

    out = kept(once.mapInArrow(run, "lead long, member long"), "pairs")
    drop(nodes, names, base)
    return out


def _sent(goes: DataFrame) -> DataFrame:
    """goes (doc_id, node, to: a list), for a broadcast if its rows and the entries of its lists are within bounds."""
    n, entries = goes.agg(F.count("*"), F.sum(F.size("to"))).first()
    return F.broadcast(goes) if n <= BROADCAST_IDS and (entries or 0) <= BROADCAST_ENTRIES else goes


def verified(pairs: DataFrame, docs: DataFrame, names: DataFrame, percent: int, words: int = 5) -> DataFrame:
    """The pairs (lead, member) of nodes whose sets are alike, as (a, b). names: a document (doc_id) for each node.

    The sets are made again from the texts of documents that are in a pair. A set goes to each of its
    leads, where it meets the lead's own: it is shuffled once for each pair, a lead's once for each
    MEMBERS members. Each pair is verified once.
    """
    spread = pairs.groupBy("lead").agg((F.count("*") / MEMBERS).cast("int").alias("last"))
    dealt = pairs.join(spread, "lead").select("lead", F.col("member").alias("node"), F.pmod(F.xxhash64("member"), F.col("last") + 1).cast("int").alias("salt"), F.lit(1).alias("role"))
    own = spread.select("lead", F.col("lead").alias("node"), F.explode(F.sequence(F.lit(0), "last")).alias("salt"), F.lit(0).alias("role"))
    rows = dealt.union(own)
    parts = rows.groupBy("node").agg(F.ceil(F.count("*") / LEADS).alias("parts"))
    rows = rows.join(parts, "node").groupBy("node", F.pmod(F.xxhash64("lead", "salt"), "parts").alias("part")).agg(F.collect_list(F.struct("lead", "salt", "role")).alias("to"))
    goes = kept(names.select("node", "doc_id").join(rows, "node").select("doc_id", "node", "to"), "goes")
    docs = docs.select("doc_id", "text").join(_sent(goes), "doc_id")

    def sets(batches):
        for b in batches:
            nodes, to = b.column("node").to_pylist(), b.column("to").to_pylist()
            for i in range(0, len(nodes), 64):
                rows = []
                for node, leads, x in zip(nodes[i : i + 64], to[i : i + 64], _sets(Chunk(b.column("text")[i : i + 64].to_pylist()), words), strict=True):
                    if len(x) and _fingerprint(x) == node:  # another text of a repeated doc_id is not the one meant
                        raw = x.tobytes()
                        rows += [(t["lead"], t["salt"], t["role"], node, raw) for t in leads]
                if rows:
                    c = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.binary())], ["lead", "salt", "role", "node", "s"])

    def alike(batches):
        at, x = None, None
        for b in batches:
            a_out, b_out = [], []
            for lead, salt, role, node, raw in zip(*(b.column(c).to_pylist() for c in ("lead", "salt", "role", "node", "s")), strict=True):
                y = np.frombuffer(raw, np.uint64)
                if role == 0:
                    at, x = (lead, salt), y
                    continue
                if at != (lead, salt):
                    continue
                both = np.sort(np.concatenate((x, y)), kind="stable")
                if int((both[1:] == both[:-1]).sum()) >= -(-percent * (len(x) + len(y)) // (100 + percent)):
                    a_out.append(lead)
                    b_out.append(node)
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    made = docs.select("node", "to", "text").mapInArrow(sets, "lead long, salt int, role int, node long, s binary")
    links = kept(made.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "role", "node").mapInArrow(alike, "a long, b long"), "links")
    drop(goes)
    return links


def _second_round(shared: DataFrame, groups: DataFrame, percent: int) -> DataFrame | None:
    """lead, member: sets in different components that a shingle holds and the length and positional filters let through; None if no shingle is in two.

    The shingle's largest component need not be paired with itself, so its rows meet the others' only. Rows
    of a shingle meet by the classes of their sets' sizes, and more than MEETING of one class in several groups.
    """
    step = float(np.log(100 / percent) * 1.0001) if percent < 100 else 1e-9
    placed = shared.select("shingle", "pos", "node", "n").join(groups, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    main = placed.groupBy("shingle", "c").agg(F.count("*").alias("size")).groupBy("shingle").agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
    main = kept(main.select("shingle", "main"), "main")
    n = main.count()
    if not n:
        return None
    if n <= BROADCAST_IDS:
        placed = placed.join(F.broadcast(main), "shingle")
    else:  # a frequent shingle's rows are dealt to 16 groups
        placed = placed.withColumn("deal", F.pmod(F.xxhash64("node"), F.lit(16))).join(main.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long")))), ["shingle", "deal"]).drop("deal")
    placed = kept(placed.withColumn("size", F.floor(F.log("n") / step)), "placed")
    drop(main)
    long = kept(placed.groupBy("shingle", "size").agg(F.ceil(F.count("*") / MEETING).alias("parts")).where("parts > 1"), "long")
    parts = F.broadcast(long) if long.count() <= BROADCAST_IDS else long
    there = placed.join(parts, ["shingle", "size"], "left").withColumn("salt", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), "parts"))).alias("q")
    here = placed.where("c != main").withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))).join(parts, ["shingle", "size"], "left")
    here = here.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).alias("p")
    need = F.ceil(F.lit(percent) * (F.col("p.n") + F.col("q.n")) / (100.0 + percent) - 1e-9)
    fits = (F.col("p.c") != F.col("q.c")) & (100 * F.least("p.n", "q.n") >= percent * F.greatest("p.n", "q.n")) & (F.least(F.col("p.n") - F.col("p.pos"), F.col("q.n") - F.col("q.pos")) >= need)
    met = here.join(there, (F.col("p.shingle") == F.col("q.shingle")) & (F.col("p.size") == F.col("q.size")) & (F.col("p.salt") == F.col("q.salt")) & fits)
    return met.select(F.least("p.node", "q.node").alias("lead"), F.greatest("p.node", "q.node").alias("member"))


def _grouped(docs: DataFrame, percent: int, words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """marks (doc_id, node, n) for each row; known (node, least_id, component) for each set of a named row; and links (a, b) that connect the components."""
    docs = docs.select("doc_id", "text")
    bits = sketch_bits(docs)
    seen = kept(signatures(docs, words, bits), "signatures")
    marks = seen.where("kind = 'd'").select("doc_id", "node", "n")
    counts = corpus_counts(seen.where("kind = 's'"), bits)
    named = seen.where("kind = 'd' and doc_id is not null and n > 0").select("doc_id", "node", "n", F.col("counts").alias("ranges"))
    names = named.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    shared = kept(shared_postings(prefix_postings(docs.where("doc_id is not null"), counts, percent, words), percent), "postings")

    first = proposed(shared.where("fits").select("lead", F.col("node").alias("member")), named, percent)
    links = verified(first, docs, names, percent, words)
    groups = components(links)
    second = _second_round(shared, groups, percent)
    if second is not None:
        done = first.select(F.least("lead", "member").alias("lead"), F.greatest("lead", "member").alias("member"))
        second = proposed(second.join(done, ["lead", "member"], "left_anti"), named, percent)
        if not second.isEmpty():
            links = links.union(verified(second, docs, names, percent, words))
            groups = components(links)
        drop(second)
    drop(shared, first)

    known = names.select("node", F.col("doc_id").alias("least_id")).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return marks, known, links


def jaccard_classes(docs: DataFrame, percent: int = 75, words: int = 5) -> DataFrame:
    """Per row of docs: doc_id, n_shingles (size of its set), component_id (smallest doc_id reachable by links).

    Two texts link when 100 * intersection >= percent * union of their sets. Words are lower-cased in A
    to Z. Texts without words (null, empty, blank) have an empty set and link with nothing: such rows
    have their own doc_id as component_id. Repeated rows stay repeated. A row without doc_id counts as a
    document that can't be named: component_id is null, and it links nothing. Further columns of docs
    are not read. An empty table gives no rows.
    """
    marks, known, _ = _grouped(docs, percent, words)
    smallest = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    found = known.join(smallest, "component").select("node", "component_id")
    return marks.join(found, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of left shares with each of right, by products of 0-1 matrices."""
    x = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    order = np.argsort(x, kind="stable")
    x, owner = x[order], owner[order]
    new = np.concatenate(([True], x[1:] != x[:-1]))
    col = np.cumsum(new) - 1
    more = np.bincount(col)[col] > 1
    owner, col = owner[more], np.cumsum(new & more)[more] - 1
    out = np.zeros((len(left), len(right)), np.int64)
    for low in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        i, j = np.searchsorted(col, (low, low + COLUMNS))
        m = np.zeros((len(left) + len(right), int(min(COLUMNS, col[-1] + 1 - low))), np.float32)
        m[owner[i:j], col[i:j] - low] = 1
        out += (m[: len(left)] @ m[len(left) :].T).astype(np.int64)
    return out


def _within(docs: DataFrame, marks: DataFrame, known: DataFrame, percent: int, words: int, count: bool) -> DataFrame:
    """All links between different sets of the same component: (a, b), or with count (node, n_links) in parts to be added.

    A component's sets are dealt to blocks by their size, so that sets whose sizes allow a link are in the
    same or the next size class, and within it by a hash. Each pair of blocks is compared once; a set goes
    to the pairs that its block is in.
    """
    sets_of = marks.where("doc_id is not null and n > 0").groupBy("node").agg(F.first("n").alias("n"))
    members = kept(known.join(sets_of, "node").select("node", "component", "least_id", "n"), "members")
    whole = members.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).where("sets > 1")
    one = (F.col("sets") <= BLOCK_SETS) & (F.col("shingles") <= BLOCK_SHINGLES)
    # a quotient of percent : 100 is less than one step, so sets two classes apart can't link
    step = float(np.log(100 / percent) * 1.0001) if percent < 100 else 1e-9
    placed = members.join(whole, "component").withColumn("size", F.when(one, F.lit(0)).otherwise(F.floor(F.log("n") / step)).cast("long"))
    parts = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    blocks = placed.groupBy("component", "size").agg(parts.alias("parts")).groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("size", "parts"))).alias("parts"))

    def cells(other: int):
        n = F.coalesce(F.try_element_at("parts", F.col("size") + other), F.lit(0))

        def cell(k):
            if other:
                return F.struct(F.concat_ws(":", F.col("size") + min(other, 0), F.col("block") if other > 0 else k, F.col("size") + max(other, 0), k if other > 0 else F.col("block")).alias("cell"), F.lit(int(other < 0)).alias("side"))
            side = F.when(k == F.col("block"), 2).when(k > F.col("block"), 0).otherwise(1)
            return F.struct(F.concat_ws(":", "size", F.least(k, "block"), "size", F.greatest(k, "block")).alias("cell"), side.alias("side"))

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), cell)).otherwise(F.array().cast("array<struct<cell:string,side:int>>"))

    placed = placed.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.element_at("parts", F.col("size"))).cast("int"))
    goes = kept(placed.select(F.col("least_id").alias("doc_id"), "node", "component", F.concat(cells(0), cells(1), cells(-1)).alias("to")), "goes")
    docs = docs.select("doc_id", "text").join(_sent(goes), "doc_id")

    def sets(batches):
        for b in batches:
            nodes, groups, to = (b.column(c).to_pylist() for c in ("node", "component", "to"))
            for i in range(0, len(nodes), 64):
                rows = []
                for node, group, cs, x in zip(nodes[i : i + 64], groups[i : i + 64], to[i : i + 64], _sets(Chunk(b.column("text")[i : i + 64].to_pylist()), words), strict=True):
                    if len(x) and _fingerprint(x) == node:  # another text of a repeated doc_id is not the one meant
                        raw = x.tobytes()
                        rows += [(group, c["cell"], c["side"], node, raw) for c in cs]
                if rows:
                    c = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1]), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.binary())], ["component", "cell", "side", "node", "s"])

    def linked(nodes, held):
        """Of one pair of blocks; nodes and held (their sets) are for sides 0, 1 and 2."""
        (a, x), (b, y) = ((nodes[2], held[2]),) * 2 if nodes[2] else ((nodes[0], held[0]), (nodes[1], held[1]))
        if not a or not b or (nodes[2] and len(a) < 2):
            return
        n, m = np.array([len(s) for s in x]), np.array([len(s) for s in y])
        link = _shared(x, y) >= -(-percent * (n[:, None] + m[None]) // (100 + percent))
        if nodes[2]:
            link = np.triu(link, 1)
        a, b = np.array(a), np.array(b)
        if count:
            k = np.concatenate((link.sum(axis=1), link.sum(axis=0)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((a, b))[k > 0]), pa.array(k[k > 0])], ["node", "n_links"])
        else:
            i, j = np.nonzero(link)
            yield pa.RecordBatch.from_arrays([pa.array(a[i]), pa.array(b[j])], ["a", "b"])

    def compared(batches):
        at, nodes, held = None, ([], [], []), ([], [], [])
        for batch in batches:
            for group, cell, side, node, raw in zip(*(batch.column(c).to_pylist() for c in ("component", "cell", "side", "node", "s")), strict=True):
                if at != (group, cell):
                    yield from linked(nodes, held)
                    at, nodes, held = (group, cell), ([], [], []), ([], [], [])
                if not nodes[side] or nodes[side][-1] != node:  # a repeated row's set comes twice
                    nodes[side].append(node)
                    held[side].append(np.frombuffer(raw, np.uint64))
        yield from linked(nodes, held)

    made = docs.select("node", "component", "to", "text").mapInArrow(sets, "component long, cell string, side int, node long, s binary")
    return made.repartition("component", "cell").sortWithinPartitions("component", "cell", "side", "node").mapInArrow(compared, "node long, n_links long" if count else "a long, b long")


def jaccard_links(docs: DataFrame, percent: int = 75, words: int = 5) -> tuple[DataFrame, DataFrame]:
    """All links (a, b) between different sets, each once, and the members (node, doc_id) of the sets, a row for each named row of docs.

    Copies with equal sets are one node and are not expanded. The links of a group of near copies are
    as many as its pairs; link_counts gives their numbers only.
    """
    docs = docs.select("doc_id", "text")
    marks, known, _ = _grouped(docs, percent, words)
    return _within(docs, marks, known, percent, words, False), marks.where("doc_id is not null and n > 0").select("node", "doc_id")


def link_counts(docs: DataFrame, percent: int = 75, words: int = 5) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, n_links (how many different sets link with its own; equal sets are one and don't count).

    Rows with an empty set or without doc_id link with nothing.
    """
    docs = docs.select("doc_id", "text")
    marks, known, _ = _grouped(docs, percent, words)
    n = _within(docs, marks, known, percent, words, True).groupBy("node").agg(F.sum("n_links").alias("n_links"))
    return marks.join(n, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"))


def _with_nodes(docs: DataFrame, words: int, node: str) -> DataFrame:
    """docs with the fingerprint of each row's set in a further column node; null for an empty set."""

    def run(batches):
        from lumora.llm.text import pieces

        for b in batches:
            out = []
            for _, chunk in pieces(iter([b])):
                out += [_fingerprint(x) if len(x) else None for x in _sets(chunk, words)]
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, node])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(node, T.LongType())]))


def one_of_each(docs: DataFrame, percent: int = 75, words: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, of which one stays for each class: one with the smallest doc_id.

    Rows with an empty set or without doc_id stay. Where a doc_id repeats, rows are told apart by their
    sets: of a class's rows with the smallest doc_id those with the least fingerprint are taken, and of
    these one.
    """
    marks, known, _ = _grouped(docs.select("doc_id", "text"), percent, words)
    stay = kept(known.groupBy("component").agg(F.min(F.struct("least_id", "node")).alias("s")).select(F.col("s.least_id").alias("doc_id"), F.col("s.node").alias("node")), "stay")
    again = kept(marks.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    go = kept(marks.where("doc_id is not null and n > 0").join(stay, ["doc_id", "node"], "left_anti").select("doc_id").distinct().union(again).distinct(), "go")
    out = docs.join(F.broadcast(go) if go.count() <= BROADCAST_IDS else go, "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return out
    node = "node"
    while node in docs.columns:
        node += "_"
    some = _with_nodes(docs.join(again, "doc_id", "left_semi").select(*docs.columns), words, node)
    some_stay = some.join(stay.select("doc_id", F.col("node").alias(node)), ["doc_id", node], "left_semi").dropDuplicates(["doc_id", node])
    return out.union(some.where(F.col(node).isNull()).select(*docs.columns)).union(some_stay.select(*docs.columns))
