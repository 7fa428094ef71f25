"""Merkle manifest of a table: one tree per group, versions of changed leaves by path copying, a proof for every row.

Leaves are numbered by a range sort and cut into aligned blocks of ``1 << BITS`` consecutive ones. A block is a whole subtree,
so its root is found in one small task and becomes a leaf of the next level, until one node is left per tree. On the way back
each block receives the path from its root to the top, once for the whole block, and continues the versions of its leaves
along it. A version is a persistent tree: it holds the nodes from its changed leaf upwards and shares all others.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barlab.llm.common import store

BITS = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATHS = "tree string, pos long, path string, subroot string, root string"
_MANIFEST = "doc_id long, leaf string, subroot string, root string, path string, folded_root string, copied long"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_text(columns: Sequence[Column]) -> Column:
    """What a leaf's digest covers: ``-`` for a null, else the UTF-8 length, ``:`` and the value."""
    framed = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat(*[framed(c.cast("string")) for c in columns])


def height(n: int) -> int:
    """Levels above ``n`` nodes until a single one is left."""
    return (n - 1).bit_length()


class BlockTree:
    """The nodes above consecutive digests, ``levels`` deep; a node without a sibling is hashed alone."""

    def __init__(self, leaves: Sequence[str], levels: int):
        self.rows = [list(leaves)]
        for _ in range(levels):
            low = self.rows[-1]
            self.rows.append([digest("".join(low[i:i + 2])) for i in range(0, len(low), 2)])

    def path(self, at: int) -> str:
        """The siblings of leaf ``at`` from below: ``L`` or ``R`` (their side) and the digest, ``-`` where there is none."""
        steps = []
        for row in self.rows[:-1]:
            other = at ^ 1
            steps.append("-" if other >= len(row) else ("L" if other < at else "R") + row[other])
            at >>= 1
        return "".join(steps)

    def version(self, at: int, leaf: str) -> list[str]:
        """The nodes that a version with another leaf copies, from that leaf to its root; the rest stays shared."""
        copied = [leaf]
        for row in self.rows[:-1]:
            other = at ^ 1
            pair = (copied[-1],) if other >= len(row) else (row[other], copied[-1]) if other < at else (copied[-1], row[other])
            copied.append(digest("".join(pair)))
            at >>= 1
        return copied


def follow(path: str, node: str) -> list[str]:
    """The nodes from ``node`` to the top of ``path``, each computed from the one before and its sibling."""
    out, at = [node], 0
    while at < len(path):
        side = path[at]
        other = "" if side == "-" else path[at + 1:at + 65]
        out.append(digest(other + out[-1] if side == "L" else out[-1] + other))
        at += 1 + len(other)
    return out


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _levels(table: pa.Table, bits: int) -> int:
    return min(bits, height(table["n"][0].as_py()))


def _block_root(table: pa.Table, bits: int) -> pa.Table:
    nodes = _in_order(table)
    top = BlockTree(nodes["digest"].to_pylist(), _levels(nodes, bits)).rows[-1][0]
    n, block = nodes["n"][0].as_py(), nodes["pos"][0].as_py() >> bits
    return pa.table({"tree": [nodes["tree"][0].as_py()], "pos": pa.array([block], pa.int64()),
                     "n": pa.array([((n - 1) >> bits) + 1], pa.int64()), "digest": [top]})


def _hand_down(nodes: pa.Table, above: pa.Table, bits: int) -> pa.Table:
    """The path from every node of a block to the top, below the path that the block's root has."""
    nodes = _in_order(nodes)
    block, upper = BlockTree(nodes["digest"].to_pylist(), _levels(nodes, bits)), above["path"][0].as_py()
    return pa.table({"tree": nodes["tree"], "pos": nodes["pos"], "path": [block.path(i) + upper for i in range(nodes.num_rows)],
                     "subroot": [above["subroot"][0].as_py()] * nodes.num_rows, "root": [above["root"][0].as_py()] * nodes.num_rows})


def _manifest_rows(nodes: pa.Table, above: pa.Table, bits: int) -> pa.Table:
    """A block's rows of the manifest: paths, and for every leaf the root of the version that holds its changed digest."""
    nodes = _in_order(nodes)
    leaves, changed = nodes["digest"].to_pylist(), nodes["changed"].to_pylist()
    block, upper = BlockTree(leaves, _levels(nodes, bits)), above["path"][0].as_py()
    n = len(leaves)
    paths, roots, copied = [], [], []
    for i, (leaf, other) in enumerate(zip(leaves, changed)):
        version = block.version(i, leaf if other is None else other)
        version += follow(upper, version[-1])[1:]
        paths.append(block.path(i) + upper)
        roots.append(version[-1])
        copied.append(0 if other is None else len(version))
    return pa.table({"doc_id": nodes["doc_id"], "leaf": leaves, "subroot": [above["subroot"][0].as_py()] * n,
                     "root": [above["root"][0].as_py()] * n, "path": paths, "folded_root": roots, "copied": pa.array(copied, pa.int64())})


def numbered(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``pos``, the 0-based place inside ``tree`` under ``order``, and ``n``, the rows of the tree.

    One range exchange sorts the rows; as many ranges as the input has splits, at least the session's shuffle partitions. The
    order must be total. Places are a range's first place, from a table with one row per (tree, range), plus the row's own.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    sort = [F.col("tree"), *order]
    ranged = store(rows.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33).alias("part")
    runs = ranged.groupBy("tree", part).agg(F.min("at").alias("first"), F.count("*").alias("held"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "part", (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("held").over(tree).alias("n"))
    return ranged.withColumn("part", part).join(runs, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def climb(nodes: DataFrame, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of block leaves (tree, pos, n, digest) from ``nodes`` upwards, and the top digest of every tree (tree, digest)."""
    levels, tops = [], []
    while True:
        levels.append(nodes.where("n > 1"))
        tops.append(nodes.where("n = 1").select("tree", "digest"))
        most = nodes.agg(F.max("n")).first()[0]
        if most is None or most == 1:
            break
        block = F.shiftright("pos", bits)
        nodes = store(levels[-1].select("tree", "pos", "n", "digest").groupBy("tree", block).applyInArrow(
            lambda t: _block_root(t, bits), "tree string, pos long, n long, digest string"), "blocks")
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return levels[:-1], out


def _beside(nodes: DataFrame, above: DataFrame, bits: int, fn, schema: str) -> DataFrame:
    """``fn`` over every block of ``nodes`` and the path of its root."""
    pairs = nodes.withColumn("block", F.shiftright("pos", bits)).groupBy("tree", "block").cogroup(
        above.withColumnRenamed("pos", "block").groupBy("tree", "block"))
    return pairs.applyInArrow(lambda a, b: fn(a, b, bits), schema)


def descend(levels: Sequence[DataFrame], tops: DataFrame, bits: int) -> DataFrame:
    """Paths (tree, pos, path, subroot, root) for the blocks of the lowest of ``levels``; ``tops`` has them for the trees.

    A tree of few nodes joins in where its own top lies.
    """
    above = None
    for nodes in reversed(levels):
        trees = nodes.where(F.col("n") <= 1 << bits).select("tree").distinct().join(tops, "tree").select(
            "tree", F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")
        above = store(trees if above is None else above.unionByName(trees), "paths")
        if nodes is not levels[0]:
            above = _beside(nodes, above, bits, _hand_down, _PATHS)
    return above


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", columns: Sequence[str] = COLUMNS,
             changes: Mapping[str, Column] | None = None, where: Column | None = None, bits: int = BITS) -> DataFrame:
    """doc_id (the integer ``key``), leaf, subroot, root, path, folded_root, copied for every row of ``docs``.

    Leaves of a ``group`` ascend by ``key``; a null key is the smallest, rows with equal keys follow their leaf's digest (equal rows
    get neighbouring places in any order). Groups ascend bytewise, null first. ``path`` lists the siblings from the leaf to the root
    as ``L``/``R`` and digest, or ``-`` on a level without one. Rows that meet ``where`` get another leaf from ``changes``
    (column -> new value): each such leaf makes a version of the tree, ``folded_root`` is that version's root and ``copied`` the
    number of its own nodes. For the other rows ``folded_root`` is recomputed from the leaf and its siblings, ``copied`` is 0.

    Nulls in any column hash as ``-``, an empty text as ``0:``. Texts of any length are hashed as a whole by Spark. A tree of one row
    is its leaf. An empty table gives an empty manifest. Other columns, whatever their names, are not read.
    """
    col = lambda c: F.col(f"`{c}`")
    leaf = F.sha2(leaf_text([col(c) for c in columns]), 256)
    other = F.lit(None).cast("string")
    if changes:
        other = F.sha2(leaf_text([changes.get(c, col(c)) for c in columns]), 256)
        other = other if where is None else F.when(where, other)
    tree = F.coalesce(F.concat(F.lit("="), col(group).cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), col(key).cast("long").alias("doc_id"), leaf.alias("digest"), other.alias("changed"),
                       F.monotonically_increasing_id().alias("row"))
    rows = store(rows, "leaves")
    leaves = store(numbered(rows, [F.col("doc_id"), F.col("digest"), F.col("row")]).drop("row"), "leaves")
    levels, subroots = climb(leaves, bits)
    subroots = store(subroots, "subroots")
    forest = store(numbered(subroots.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("group")), [F.col("group")]), "forest")
    upper, roots = climb(forest, bits)
    roots = roots.select("tree", F.lit("").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    one = forest.crossJoin(roots.select("root"))  # the root is one row
    if upper:
        paths = _beside(upper[0], descend(upper, roots, bits), bits, _hand_down, _PATHS)
        one = forest.join(paths.select("pos", "path", "root"), "pos")
    else:
        one = one.withColumn("path", F.lit(""))
    tops = store(one.select(F.col("group").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "tops")
    lone = leaves.where("n = 1").join(tops, "tree").select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", "changed")
    alone = lone.mapInArrow(_lone_rows, _MANIFEST)
    if not levels:
        return alone
    many = _beside(levels[0].select("tree", "pos", "n", "digest", "doc_id", "changed"), descend(levels, tops, bits), bits, _manifest_rows, _MANIFEST)
    return many.unionByName(alone)


def _lone_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of a single leaf: its path begins at the subroot."""
    for b in batches:
        versions = [follow(p, leaf if other is None else other) for p, leaf, other in
                    zip(b["path"].to_pylist(), b["leaf"].to_pylist(), b["changed"].to_pylist())]
        copied = [0 if other is None else len(v) for v, other in zip(versions, b["changed"].to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"], b["leaf"], b["subroot"], b["root"], b["path"], pa.array([v[-1] for v in versions], pa.string()), pa.array(copied, pa.int64())],
            ["doc_id", "leaf", "subroot", "root", "path", "folded_root", "copied"])


def tampered_manifest(docs: DataFrame, modulus: int = 7) -> DataFrame:
    """The manifest's digests when every row whose crc32 of the decimal doc_id divides by ``modulus`` reports one character more.

    A null doc_id is never tampered with, a null n_chars stays null.
    """
    crc = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    m = manifest(docs, changes={"n_chars": F.col("n_chars").cast("long") + 1}, where=crc % modulus == 0)
    return m.select("doc_id", "leaf", "subroot", "root", F.sha2(F.regexp_replace("path", "[LR-]", ""), 256).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), F.col("copied").alias("copied_nodes"))
