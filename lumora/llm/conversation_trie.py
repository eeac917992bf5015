"""Prefix trie of conversations, with exact counts for every node.

A prefix's digest is a chain over its turns. A count-min sketch of all prefixes' digests (every conversation adds one to
each of its prefixes) never counts too little: where it says one, the prefix has one conversation, and so has
all that follows it. Such tails are given out where they stand; the prefixes before them, which may be shared, are
grouped by digest. A sketch that fills up costs grouping, never a result.

Sums over subtrees take no pass a level: a node's own share goes to its smallest member, along whose path it is summed
from the end, so that each node counts once for each of its ancestors. Everything is dealt by digest with counts made
before the shuffle, or by conversation; a conversation's turns stream through, they are never held.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.llm.ngram_jaccard import SKETCH_ROW, _pressed, corpus_counts
from lumora.llm.text import drop, kept

#: Counters of one of the sketch's two rows, as powers of two: eight for each prefix, within these.
LEAST_BITS, MOST_BITS = 17, 22
ROOT = sha256(b"").digest()
#: Characters of joined ids from which on they are sent as a piece.
PIECE = 1 << 16

_TURNS = "conv_id long, digest binary, n_bytes long"


def turn_digest(role: Column, text: Column) -> Column:
    """32 bytes for a turn; a null role or text is an empty one."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.where("conv_id is not null").select("conv_id", "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


def ordered(conversations: DataFrame) -> DataFrame:
    """Turns of each conversation in order, in one run of a partition: the input of prefix_trie()."""
    rows = _turns(conversations).repartition("conv_id")
    return rows.sortWithinPartitions("conv_id", "turn", "digest").select("conv_id", "digest", "n_bytes")


def spliced(conversations: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """Like ordered(), of rebuilt conversations: the first h turns of conversation c - c % group, then c's own after its first h; h = crc32(c) % heads.

    A conversation that has no turn then is one row without digest. The conversations of a group meet in one task, in
    which at most heads - 1 turns are held.
    """

    def run(batches):
        base, head, conv, at, given = None, [], None, 0, False
        out: list[tuple] = []
        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("base", "conv_id", "h", "digest", "n_bytes"))
            for g, c, h, d, n in zip(*cols, strict=True):
                if c != conv:
                    if conv is not None and not given:
                        out.append((conv, None, 0))
                    if g != base:
                        base, head = g, []
                    conv, at, given = c, 0, False
                    if c != g and h:
                        out += [(c, *t) for t in head[:h]]
                        given = bool(head)
                if c == g and len(head) < heads - 1:
                    head.append((d, n))
                if c == g or at >= h:
                    out.append((c, d, n))
                    given = True
                at += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64()), strict=True)], ["conv_id", "digest", "n_bytes"])
                out = []
        if conv is not None and not given:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([None], pa.binary()), pa.array([0], pa.int64())], ["conv_id", "digest", "n_bytes"])

    rows = _turns(conversations).select("*", F.expr(f"conv_id - conv_id % {group}").alias("base"), (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h"))
    rows = rows.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", "turn", "digest")
    return rows.select("base", "conv_id", "h", "digest", "n_bytes").mapInArrow(run, _TURNS)


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest, parent, n_bytes, last: a row for each prefix of each conversation, the root's included."""
    names = ["conv_id", "depth", "digest", "parent", "n_bytes", "last"]
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())

    def run(batches):
        conv, held = None, None
        for b in batches:
            out = []
            for c, d, n in zip(b.column("conv_id").to_pylist(), b.column("digest").to_pylist(), b.column("n_bytes").to_pylist(), strict=True):
                if c != conv:
                    if held:
                        out.append((*held, True))
                    conv, held = c, (c, 0, ROOT, None, 0)
                if d is not None:
                    out.append((*held, False))
                    held = c, held[1] + 1, sha256(held[2] + d).digest(), held[2], n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*held, True), types, strict=True)], names)

    return turns.mapInArrow(run, "conv_id long, depth long, digest binary, parent binary, n_bytes long, last boolean")


def _places(digests: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each digest's counter in both rows of the sketch."""
    x = np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)
    shift = np.uint64(64 - bits)
    return (x[:, 0] >> shift).astype(np.int64), (x[:, 1] >> shift).astype(np.int64) + (1 << bits)


def prefix_counts(prefixes: DataFrame, bits: int) -> np.ndarray:
    """The count-min sketch, two rows of 2^bits counters behind each other. Counters stop at 255."""

    def run(batches):
        total = np.zeros(2 << bits, np.uint32)
        for b in batches:
            for at in _places(b.column(0), bits):
                u, c = np.unique(at, return_counts=True)
                total[u] += c.astype(np.uint32)
        for i in range(len(total) // SKETCH_ROW):
            part = total[i * SKETCH_ROW : (i + 1) * SKETCH_ROW]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([int(total.sum()) & 7]), pa.array([i], pa.int64()), pa.array([_pressed(part)], pa.binary())], ["node", "n", "counts"])

    return np.minimum(corpus_counts(prefixes.where("depth > 0").select("digest").mapInArrow(run, "node long, n long, counts binary"), bits + 1), 255).astype(np.uint8)


def _screened(prefixes: DataFrame, counts: np.ndarray) -> DataFrame:
    """prefixes with kind: 's' may be shared; 't' is of a tail that the sketch proves to have one conversation, 'u' the first of it.

    n_next: for a tail's node whether another one follows, for other nodes whether a tail does.
    """
    sent = prefixes.sparkSession.sparkContext.broadcast(counts)
    names = ["conv_id", "depth", "digest", "parent", "n_bytes", "last", "kind", "n_next"]
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.string(), pa.int64())

    def run(batches):
        table, held, tail = sent.value, None, False
        bits = len(table).bit_length() - 2
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _places(b.column("digest"), bits)
            alone = np.minimum(table[x], table[y]) == 1
            out = []
            for row, one in zip(zip(*(b.column(n).to_pylist() for n in names[:6]), strict=True), alone.tolist(), strict=True):
                same = held is not None and held[0] == row[0]
                tail = same and tail
                kind = "t" if tail else "u" if one and row[1] else "s"
                tail = kind != "s"
                if held:
                    out.append((*held, int(same and (kind == "u" or held[6] != "s"))))
                held = (*row, kind)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*held, 0), types, strict=True)], names)

    rows = prefixes.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return rows.mapInArrow(run, "conv_id long, depth long, digest binary, parent binary, n_bytes long, last boolean, kind string, n_next long")


def _ends(rows: DataFrame, piece: int) -> DataFrame:
    """digest, ends_sha256 of (digest, conv_id): the hash of each digest's ids in order. Ids are joined to pieces where a range sort has put them; one task hashes a digest's pieces."""

    def pieces(batches):
        digest, first, text, size = None, None, [], 0
        done: list[tuple] = []
        for b in batches:
            for d, c in zip(b.column("digest").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if d != digest or size > piece:
                    if text:
                        done.append((digest, first, ",".join(text)))
                    digest, first, text, size = d, c, [], 0
                text.append(str(c))
                size += len(text[-1]) + 1
            if done:
                yield _columns(done, (pa.binary(), pa.int64(), pa.string()), ["digest", "first", "ids"])
                done = []
        if text:
            yield _columns([(digest, first, ",".join(text))], (pa.binary(), pa.int64(), pa.string()), ["digest", "first", "ids"])

    def hashed(batches):
        digest, h = None, None
        for b in batches:
            done = []
            for d, t in zip(b.column("digest").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if d != digest:
                    if h:
                        done.append((digest, h.hexdigest()))
                    digest, h = d, sha256(t.encode())
                else:
                    h.update(b"," + t.encode())
            if done:
                yield _columns(done, (pa.binary(), pa.string()), ["digest", "ends_sha256"])
        if h:
            yield _columns([(digest, h.hexdigest())], (pa.binary(), pa.string()), ["digest", "ends_sha256"])

    joined = rows.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(pieces, "digest binary, first long, ids string")
    return joined.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(hashed, "digest binary, ends_sha256 string")


def _columns(rows: list[tuple], types: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _subtree_sums(paths: DataFrame, shares: DataFrame) -> DataFrame:
    """digest, n_leaves, saved: shares (conv_id, depth, n_leaves, saved) summed over each prefix of the path that they lie on."""

    def run(batches):
        conv, leaves, saved = None, 0, 0
        for b in batches:
            out = []
            for c, d, n, s in zip(*(b.column(x).to_pylist() for x in ("conv_id", "digest", "n_leaves", "saved")), strict=True):
                if c != conv:
                    conv, leaves, saved = c, 0, 0
                if d is None:
                    leaves, saved = leaves + n, saved + s
                elif leaves or saved:
                    out.append((d, leaves, saved))
            if out:
                yield _columns(out, (pa.binary(), pa.int64(), pa.int64()), ["digest", "n_leaves", "saved"])

    both = paths.select("conv_id", "depth", "digest", F.lit(0).alias("n_leaves"), F.lit(0).alias("saved")).unionByName(shares.select("conv_id", "depth", F.lit(None).cast("binary").alias("digest"), "n_leaves", "saved"))
    summed = both.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("depth"), F.col("digest").isNotNull()).mapInArrow(run, "digest binary, n_leaves long, saved long")
    return summed.groupBy("digest").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def prefix_trie(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: from ordered() or spliced(). A node is named by the smallest of its conversations and its depth; saved_tokens is
    what its subtree's shared turns would take again, in bytes of text; ends_sha256 hashes the ids of the
    conversations that end there. Null roles and texts are empty; rows without conv_id are left out; turns that repeat or
    tie are turns each, in the order of their digests; an empty table has no root; further columns are not
    read. Of very long texts, only the digest leaves the task that reads it.
    """
    prefixes = kept(_prefixes(turns), "prefixes")
    bits = min(MOST_BITS, max(LEAST_BITS, (prefixes.count() * 8).bit_length()))
    rows = kept(_screened(prefixes, prefix_counts(prefixes, bits)), "screened")
    drop(prefixes)
    shared, tails = rows.where("kind = 's'"), rows.where("kind != 's'")
    nodes = kept(shared.groupBy("digest").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.count("*").alias("n_convs"), F.first("n_bytes").alias("n_bytes"), F.sum("n_next").alias("tails"), F.max("last").alias("last")), "nodes")
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("kids"))
    counted = nodes.join(kids, "digest", "left").withColumn("n_children", F.col("tails") + F.coalesce("kids", F.lit(0)))
    counted = kept(counted.drop("tails", "kids"), "counted")
    drop(nodes)
    own = counted.select("conv_id", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    own = own.where("n_leaves > 0 or saved > 0").unionByName(tails.where("kind = 'u'").select("conv_id", (F.col("depth") - 1).alias("depth"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved")))
    sums, ends = _subtree_sums(shared, own), _ends(shared.where("last").select("digest", "conv_id"), piece)
    above = counted.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nothing = sha256(b"").hexdigest()
    grouped = counted.join(sums, "digest", "left").join(ends, "digest", "left").join(above, "parent", "left")
    grouped = grouped.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
    one = F.lit(1).cast("long")
    alone = lambda df, parent: df.select("conv_id", "depth", parent.alias("parent_conv_id"), one.alias("n_convs"), F.col("n_next").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"))
    first = tails.where("kind = 'u'").join(above, "parent", "left")
    return grouped.unionByName(alone(first, F.col("parent_conv_id"))).unionByName(alone(tails.where("kind = 't'"), F.col("conv_id")))
