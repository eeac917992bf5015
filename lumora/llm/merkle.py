"""Merkle manifest of a table: a subtree for each group of rows, a tree of the groups' roots, and a witness for each row.

Rows are ranked in their group by a range sort and the counts of its parts. A group is cut into aligned blocks of
ARITY ** BLOCK_LEVELS rows. A task appends a block's rows one by one (OpenTree): a row's partial witness hangs
on its open subtree, and each sibling that is completed later extends the witnesses below. Block roots are
appended to the next round's blocks in the same way, until a group has one root; the groups' roots are
appended alike. Witnesses then go down: a block's upper witness reaches its rows in front of them, in one sorted stream.

No task holds more than a block; no digest goes to the driver. A hot group has many blocks. Rounds: the logarithm of
the largest group to the base ARITY ** BLOCK_LEVELS.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.llm.text import drop, kept

ARITY, BLOCK_LEVELS = 3, 7

_STEPS = "array<struct<l:binary,r:binary>>"


def leaf(columns: list[Column]) -> Column:
    """The digest (32 bytes) of a row's values: each `-` if null, else the length of its text in bytes, a colon, its text."""
    texts = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256))


def _joined(digests: list[bytes]) -> bytes:
    """Digests as one run of lowercase hex text."""
    return b"".join(digests).hex().encode()


class OpenTree:
    """A subtree of a fixed height that grows by appended nodes, with a witness for each node if witnesses are asked for.

    open[k] holds the completed nodes of level k that wait for their siblings, with the witnesses of all that was
    appended below. A witness is a list of steps, from the bottom: what stands left and right of the node in its run.
    """

    def __init__(self, height: int, witnesses: bool):
        self.height, self.witnesses = height, witnesses
        self.open: list[list[tuple[bytes, list[list]]]] = [[] for _ in range(height + 1)]

    def append(self, digest: bytes) -> list:
        witness: list = []
        self._put(0, digest, [witness] if self.witnesses else [])
        return witness

    def _put(self, level: int, digest: bytes, below: list[list]) -> None:
        self.open[level].append((digest, below))
        if level < self.height and len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests, members = [d for d, _ in run], []
        for i, (_, below) in enumerate(run):
            if below:
                step = _joined(digests[:i]), _joined(digests[i + 1 :])
                for witness in below:
                    witness.append(step)
                members += below
        self._put(level + 1, sha256(_joined(digests)).digest(), members)

    def finish(self) -> bytes:
        """The root, after runs that stay short are completed, even those of one node."""
        for level in range(self.height):
            if self.open[level]:
                self._complete(level)
        return self.open[self.height][0][0]


def folded(digest: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    """What a witness makes of a node."""
    for left, right in steps:
        digest = sha256(left + digest.hex().encode() + right).digest()
    return digest


def height(n: int, levels: int) -> int:
    """Levels of a block of a group of n nodes; levels is what a full one has."""
    h, wide = 0, 1
    while wide < n and h < levels:
        h, wide = h + 1, wide * ARITY
    return h


def ranked(nodes: DataFrame, by: list[str]) -> DataFrame:
    """nodes with pos, their rank in their group g by these columns from 0, and n, the group's nodes. No group meets in one task.

    The order is that of a range sort written to the shared folder; a part's rank in a group is a sum over the parts before it.
    """
    schema = nodes.schema.simpleString()[len("struct<") : -1] + ",part:long,i:long"

    def run(batches):
        part, last, i = TaskContext.get().partitionId(), None, 0
        for b in batches:
            at = []
            for g in b.column("g").to_pylist():
                i = i + 1 if g == last else 0
                last = g
                at.append(i)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(at), pa.int64()), pa.array(at, pa.int64())], [*b.schema.names, "part", "i"])

    rows = kept(nodes.repartitionByRange("g", *by).sortWithinPartitions("g", *by).mapInArrow(run, schema), "sorted")
    parts = rows.groupBy("g", "part").count()
    before = F.sum("count").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("g", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("count").over(Window.partitionBy("g")).alias("n"))
    out = rows.join(parts, ["g", "part"]).select(*nodes.columns, (F.col("before") + F.col("i")).alias("pos"), "n")
    out.kept_path = rows.kept_path
    return out


def _blocks(batches, keys: tuple[str, ...]):
    """Runs of rows (dicts of the columns) with equal keys; a run may go on over batches."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and any(held[0][k] != row[k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _dealt(nodes: DataFrame, *order: str) -> DataFrame:
    return nodes.repartition("g", "block").sortWithinPartitions("g", "block", *order)


def block_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """g, pos, n, digest of the next round: a node for each block of these."""

    def run(batches):
        for rows in _blocks(batches, ("g", "block")):
            n = rows[0]["n"]
            tree = OpenTree(height(n, levels), witnesses=False)
            for r in rows:
                tree.append(r["digest"])
            yield pa.RecordBatch.from_arrays([pa.array([rows[0]["g"]]), pa.array([rows[0]["block"]], pa.int64()), pa.array([-(-n // ARITY**levels)], pa.int64()), pa.array([tree.finish()], pa.binary())], ["g", "pos", "n", "digest"])

    rows = nodes.select("g", F.expr(f"pos div {ARITY**levels}").alias("block"), "pos", "n", "digest")
    return _dealt(rows, "pos").mapInArrow(run, "g string, pos long, n long, digest binary")


def rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Block roots, round by round, until every group has one node."""
    out = [kept(block_roots(nodes, levels), "blocks")]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(kept(block_roots(out[-1], levels), "blocks"))
    return out


def with_witnesses(nodes: DataFrame, upper: DataFrame, levels: int, emit, schema: str, *columns: str) -> DataFrame:
    """emit(row, steps, upper's row) for each node, where upper has, for each block (g, pos), its steps up to the root.

    steps are those of the whole way; columns of nodes and of upper that emit reads are in columns.
    """
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]

    def run(batches):
        for rows in _blocks(batches, ("g", "block")):
            top, own = rows[0], rows[1:]
            tree = OpenTree(height(own[0]["n"], levels), witnesses=True)
            found = [tree.append(r["digest"]) for r in own]
            tree.finish()
            above = [(s["l"], s["r"]) for s in top["steps"]]
            kept_folds: dict[bytes, bytes] = {}
            out = [emit(r, w, above, top, kept_folds) for r, w in zip(own, found, strict=True)]
            types = pa.schema([(n, _ARROW[t]) for n, t in (x.strip().split(" ", 1) for x in schema.split(", "))])
            yield pa.RecordBatch.from_pydict({n: [o[i] for o in out] for i, n in enumerate(names)}, types)

    first = upper.select("g", F.col("pos").alias("block"), F.lit(0).alias("own"), "steps", *(c for c in columns if c in upper.columns))
    rest = nodes.select("g", F.expr(f"pos div {ARITY**levels}").alias("block"), F.lit(1).alias("own"), "pos", "n", "digest", *(c for c in columns if c in nodes.columns))
    return _dealt(first.unionByName(rest, allowMissingColumns=True), "own", "pos").mapInArrow(run, schema)


_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), _STEPS: pa.list_(pa.struct([("l", pa.binary()), ("r", pa.binary())]))}


def _passed_down(done: list[DataFrame], top: DataFrame, levels: int) -> DataFrame:
    """g, pos, steps, subroot, root of the first round's nodes, from those of the last round's."""
    for nodes in reversed(done[:-1]):
        emit = lambda r, w, above, up, _: (r["g"], r["pos"], [{"l": a, "r": b} for a, b in w + above], up["subroot"], up["root"])
        top = with_witnesses(nodes, top, levels, emit, f"g string, pos long, steps {_STEPS}, subroot binary, root binary", "subroot", "root")
    return top


def manifest(rows: DataFrame, digest: Column, group: Column, order: str, claimed: Column | None = None, steps: bool = False, levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per row: order, leaf, subroot, root, proof_sha256 (of the witness' siblings), folded_root, verified; with steps, the witness itself.

    digest: a row's leaf, as leaf() makes it; claimed: the leaf to verify with the witness, if it's another one. A group's
    rows ascend by order (null first, equal ones by leaf), groups by their text (null first, bytewise). Repeated rows are
    leaves each; an empty table gives no rows; further columns are only read if digest or claimed say so. Of very long
    texts, only the digest leaves the task that reads it. A block has ARITY ** levels rows, which a task holds.
    """
    g = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    made = rows.select(g.alias("g"), F.col(order).alias("key"), digest.alias("digest"), (digest if claimed is None else claimed).alias("claimed"), F.monotonically_increasing_id().alias("row"))
    made = kept(made, "leaves")
    leaves = ranked(made, ["key", "digest", "row"])
    blocks = rounds(leaves, levels)
    drop(made)
    subroots = ranked(blocks[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), ["name"])
    tops = rounds(subroots, levels)
    root = tops[-1].select("g", F.lit(0).cast("long").alias("pos"), F.expr(f"cast(array() as {_STEPS})").alias("steps"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    below = _passed_down(tops, root, levels)
    emit = lambda r, w, above, up, _: (r["name"], 0, [{"l": a, "r": b} for a, b in w + above], r["digest"], up["root"])
    sources = with_witnesses(subroots, below, levels, emit, f"g string, pos long, steps {_STEPS}, subroot binary, root binary", "name", "root")
    upper = kept(_passed_down(blocks, sources, levels), "upper")

    def last(r, w, above, up, seen):
        mine = folded(r["claimed"], w)
        if mine not in seen:  # the rest of the way is the same for a whole block
            seen[mine] = folded(mine, above)
        proof = sha256()
        for a, b in w + above:
            proof.update(a + b)
        row = r["key"], r["digest"].hex(), up["subroot"].hex(), up["root"].hex(), proof.hexdigest(), seen[mine].hex(), seen[mine] == up["root"]
        return (*row, [{"l": a, "r": b} for a, b in w + above]) if steps else row

    kind = "long" if dict(made.dtypes)["key"] == "bigint" else "string"
    schema = f"{order} {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (f", steps {_STEPS}" if steps else "")
    out = with_witnesses(leaves, upper, levels, last, schema, "key", "claimed", "subroot", "root")
    drop(*blocks, *tops, subroots)
    return out
