"""Merkle manifest of a dataset as a persistent tree: a changed leaf is a version that copies only its own path.

Leaves of one tree (a source) ascend by ``doc_id``; ``FAN`` consecutive nodes become their parent.  Blocks of
``FAN ** HEIGHT`` consecutive nodes are aligned to the tree, so a block's nodes depend on its own leaves only:

* up: a block computes its inner nodes and gives its top node to the next layer, where these tops are the nodes of
  the next blocks; a tree is done when one node is left.  The trees' roots are the nodes of one more tree.
* down: every block learns the untouched siblings between its top and the root, one row per block.
* versions: a changed leaf makes a version; it shares all nodes of its block and copies its ancestors there, then
  continues over the block's own path to the root.  A version is the list of its copied digests.

No step collects a tree: a layer has one row per block, and the number of layers is the logarithm of the rows.

Defined results: NULL columns are written ``-``; NULL sources are a tree of their own and come first; rows of equal
``doc_id`` (NULL first) are ordered by their digest, so repeated rows have equal leaves next to each other; a NULL
``doc_id`` is never changed; a text without a line break stays as it is; texts of any length are digested in one pass
outside Python; other columns, with any names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detectframe.scale import Scratch

FAN = 3
#: Levels inside one block; a block has FAN ** HEIGHT leaves.
HEIGHT = 7
BLOCK = FAN**HEIGHT
#: Rows of the size table (range, tree) up to which it is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 100_000

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def encoded(value: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, a colon, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(encoded, values)), 256))


def without_breaks(row: dict[str, Column]) -> dict[str, Column]:
    """The change the audit looks for: line breaks taken out of the text."""
    return row | {"text": F.replace(row["text"].cast("string"), F.lit("\n"), F.lit(""))}


def leaves(docs: DataFrame, changed: Column) -> DataFrame:
    """``tree, id, leaf, other``: the digest of every row and, where it is changed, that of the changed row."""
    row = {c: F.col(f"`{c}`") for c in FIELDS}
    other = F.when(changed, digest(*without_breaks(row).values()))
    return docs.select(row["source"].cast("string").alias("tree"), row["doc_id"].alias("id"), digest(*row.values()).alias("leaf"), other.alias("other"))


def placed(s: Scratch, nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos`` (from 0, per tree) and ``size`` (nodes of the tree) in the order of ``(tree, order)``.

    Rows are dealt by ranges and numbered inside their range; a row's place is its number there, less that of its
    tree's first row there, plus the tree's rows in the ranges before.
    """
    dealt = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie")
    ranged = s.cut(dealt.drop("tie").withColumn("at", F.monotonically_increasing_id()), "ranged").withColumn("range", F.shiftright("at", 33))
    sizes = ranged.groupBy("range", "tree").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    mine = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(mine.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = s.cut(sizes.select("range", F.col("tree").alias("t"), (before - F.col("first")).alias("shift"), F.sum("n").over(mine).alias("size")), "sizes")
    small = sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    on = (ranged["range"] == sizes["range"]) & F.equal_null(ranged["tree"], sizes["t"])
    return ranged.join(F.broadcast(sizes) if small else sizes, on).select(*[ranged[c] for c in nodes.columns], (F.col("at") + F.col("shift")).alias("pos"), "size")


def blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """One row per aligned block: ``tree, block, size, items`` (by position)."""
    items = F.array_sort(F.collect_list(F.struct("pos", *payload)))
    return nodes.groupBy("tree", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.first("size").alias("size"), items.alias("items"))


def _parent(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


class Tree:
    """Inner nodes of one block, lowest level first; never changed once built."""

    def __init__(self, leaves: list[str], whole: bool):
        # a block that is a whole tree ends at its single node, any other one at its top level
        self.levels = [leaves]
        while len(self.levels[-1]) > 1 if whole else len(self.levels) <= HEIGHT:
            row = self.levels[-1]
            self.levels.append([_parent(row[i : i + FAN]) for i in range(0, len(row), FAN)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def path(self, at: int) -> list[tuple[str, str]]:
        """Siblings left and right of a leaf's ancestors, level by level."""
        out = []
        for row in self.levels[:-1]:
            first = at - at % FAN
            out.append(("".join(row[first:at]), "".join(row[at + 1 : first + FAN])))
            at //= FAN
        return out


def copied(leaf: str, path: list[tuple[str, str]]) -> list[str]:
    """Digests a version copies for a changed leaf: its ancestors up to the end of the path."""
    out = []
    for left, right in path:
        leaf = _parent([left, leaf, right])
        out.append(leaf)
    return out


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tops = []
        for size, items in zip(batch.column("size").to_pylist(), batch.column("leaves")):
            tops.append(bytes.fromhex(Tree([x.hex() for x in items.as_py()], size <= BLOCK).top))
        yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("block"), batch.column("size"), pa.array(tops, pa.binary())], ["tree", "block", "size", "leaf"])


def tops(layer: DataFrame) -> DataFrame:
    """``tree, block, size, leaf``: the top node of every block."""
    rows = layer.select("tree", "block", "size", F.col("items.leaf").alias("leaves"))
    return rows.mapInArrow(_tops, "tree string, block long, size long, leaf binary")


def layers_of(s: Scratch, nodes: DataFrame, payload: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every layer, lowest first, and ``tree, leaf`` of the roots."""
    layer = s.cut(blocks(nodes, payload), "layer")
    out, done = [layer], []
    while True:
        top = s.cut(tops(layer), "tops")
        done.append(top.where(F.col("size") <= BLOCK).select("tree", "leaf"))
        above = top.where(F.col("size") > BLOCK)
        if not above.limit(1).count():
            break
        # one node per block is left of a tree that has several
        up = above.select("tree", F.col("block").alias("pos"), F.expr(f"(size + {BLOCK - 1}) div {BLOCK}").alias("size"), "leaf")
        layer = s.cut(blocks(up, ["leaf"]), "layer")
        out.append(layer)
    roots = done[0]
    for more in done[1:]:
        roots = roots.unionByName(more)
    return out, roots


_PATH = "array<struct<left:string,right:string>>"
_KNOWN = f"tree string, pos long, path {_PATH}, subroot string"


def _with_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    for batch in batches:
        for tree, size, items, up, subroot in zip(*(batch.column(c) for c in ("tree", "size", "items", "path", "subroot"))):
            items, above = items.as_py(), [(p["left"], p["right"]) for p in up.as_py()]
            block = Tree([x["leaf"].hex() for x in items], size.as_py() <= BLOCK)
            paths = [block.path(i) + above for i in range(len(items))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree.as_py()] * len(items), pa.string()), pa.array([x["pos"] for x in items], pa.int64()),
                 pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], pair), pa.array([subroot.as_py()] * len(items), pa.string())],
                ["tree", "pos", "path", "subroot"])


def paths_down(s: Scratch, layers: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """``tree, block, size, items, path, subroot`` of the lowest layer: siblings from each block's top to the root.

    ``above`` has ``tree, path, subroot`` for the trees' roots (None: they are the root itself).  Each layer adds its part and hands it to the blocks
    below, whose number in the tree is their node's position in the layer; so every join is by block, never by tree
    alone but for a tree's one highest block.
    """
    known = None
    for i in range(len(layers) - 1, -1, -1):
        layer = layers[i].withColumnRenamed("tree", "t")
        rows = layer.where(F.col("size") <= BLOCK)
        if above is None:
            rows = rows.withColumns({"path": F.array().cast(_PATH), "subroot": F.lit(None).cast("string")})
        else:
            rows = rows.join(above, F.equal_null("t", "tree")).drop("tree")
        if known is not None:
            lower = layer.where(F.col("size") > BLOCK).join(known, F.equal_null("t", "tree") & (F.col("block") == F.col("pos")))
            rows = rows.unionByName(lower.drop("tree", "pos"))
        rows = rows.withColumnRenamed("t", "tree")
        if i:
            known = s.cut(rows.mapInArrow(_with_paths, _KNOWN), "paths")
    return rows


@dataclass
class Manifest:
    """Blocks of leaves, each with the path from its top to the root and its subroot, and the root (hex, None if empty)."""

    blocks: DataFrame
    root: str | None


def manifest(s: Scratch, docs: DataFrame, changed: Column) -> Manifest:
    """Builds the tree of all rows; ``changed`` marks rows whose changed digest is carried along."""
    body = s.cut(leaves(docs, changed), "leaves")
    layers, roots = layers_of(s, placed(s, body, ["id", "leaf"]), ["id", "leaf", "other"])
    forest = placed(s, roots.select(F.lit("").alias("tree"), F.struct(F.col("tree").isNotNull().alias("named"), F.col("tree").alias("name")).alias("id"), "leaf"), ["id"])
    top_layers, whole = layers_of(s, forest, ["id", "leaf"])
    found = whole.select(F.lower(F.hex("leaf")).alias("root")).collect()  # one row: the root
    named = s.cut(paths_down(s, top_layers, None), "forest")
    over = named.mapInArrow(_with_paths, _KNOWN).select("pos", "path")
    names = named.select(F.explode("items").alias("x")).select("x.pos", F.col("x.id.name").alias("tree"), F.lower(F.hex("x.leaf")).alias("subroot"))
    above = s.cut(names.join(over, "pos").select("tree", "path", "subroot"), "above")
    return Manifest(paths_down(s, layers, above), found[0].root if found else None)


_VERSION = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, copied array<string>"


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for size, items, up, subroot, root in zip(*(batch.column(c) for c in ("size", "items", "path", "subroot", "root"))):
            items, above, subroot, root = items.as_py(), [(p["left"], p["right"]) for p in up.as_py()], subroot.as_py(), root.as_py()
            tree = Tree([x["leaf"].hex() for x in items], size.as_py() <= BLOCK)
            beyond = "".join(a + b for a, b in above).encode()
            rows = []
            for i, x in enumerate(items):
                own = tree.path(i)
                proof = hashlib.sha256("".join(a + b for a, b in own).encode())
                proof.update(beyond)
                same = x["other"] is None or x["other"] == x["leaf"]
                nodes = [] if same else copied(x["other"].hex(), own + above)
                # an unchanged row is folded as well: its path must lead to the root from its own leaf
                leaf = x["leaf"].hex()
                folded = nodes[-1] if nodes else (copied(leaf, own + above) or [leaf])[-1] if same else x["other"].hex()
                rows.append((x["id"], leaf, subroot, root, proof.hexdigest(), folded, folded == root, nodes))
            cols = list(zip(*rows))
            types = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [f.split(" ")[0] for f in _VERSION.split(", ")])


def audit(docs: DataFrame, changed: Column) -> DataFrame:
    """Every row's leaf, its proof, and the root of the version in which that row is changed.

    ``copied`` lists the digests the version has of its own (leaf's parent first); everything else it shares.
    """
    with Scratch(docs.sparkSession) as s:
        tree = manifest(s, docs, changed)
        rows = tree.blocks.select("size", "items", "path", "subroot", F.lit(tree.root).alias("root"))
        return s.keep(rows.mapInArrow(_versions, _VERSION), "manifest")
