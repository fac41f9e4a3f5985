"""Merkle manifest of a dataset by fractal traversal of aligned blocks.

Every row is a leaf. The leaves of a group (a language) are numbered in order without sorting a group in
one task, and cut into aligned blocks of 2^`HEIGHT` of them. A block is one row of bounded size; its subtree
is a node of the group's upper tree, whose nodes are cut into blocks in turn until a group is one block.
The groups' roots are the leaves of a last tree over the dataset.

Inside a block the authentication paths are emitted one after the other by fractal traversal: the block's
tree is cut into levels of small subtrees; per level the existing subtree (which the current path crosses)
is kept and the desired one (its right neighbour) is built up by a few hash steps a leaf on a stack, so
that it stands complete when the traversal gets there. What is held besides the block's leaves is two
subtrees of `SUBTREE` levels for each level of subtrees, however large the block. The paths of the
blocks' own nodes come from the upper trees by a join of one row a block and are appended.

H is the lowercase hex SHA-256 of the inputs' digests as hex text. A last run of one node is hashed alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Levels of a block's tree: a block holds 2^HEIGHT leaves.
HEIGHT = 10
#: Levels of one subtree of the traversal.
SUBTREE = 3
#: The columns that a document's leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PATH = "array<struct<left: boolean, hash: string>>"


def leaf_hash(*columns: Column | str) -> Column:
    """H of the columns: "-" if null, else number of UTF-8 bytes, ":", value."""
    text = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def _h(left: str | None, right: str | None) -> str | None:
    if left is None:
        return None
    return hashlib.sha256((left + (right or "")).encode()).hexdigest()


class _Stack:
    """Treehash: builds one subtree of the block from left to right, a hash step at a time.

    Nodes are placed by (level, index). `low` is the level of the subtree's bottom nodes, `high` that of
    its root; nodes below `low` live on the stack only.
    """

    def __init__(self, leaves: list[str | None], low: int, high: int, index: int):
        self.leaves, self.low, self.high = leaves, low, high
        self.next, self.end = index << high, (index + 1) << high
        self.stack: list[tuple[int, int, str | None]] = []
        self.nodes: dict[tuple[int, int], str | None] = {}

    @property
    def done(self) -> bool:
        return self.next >= self.end and len(self.stack) == 1

    def step(self) -> None:
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            level, _, right = stack.pop()
            _, index, left = stack.pop()
            self._put(level + 1, index >> 1, _h(left, right))
        elif self.next < self.end:
            i, self.next = self.next, self.next + 1
            self._put(0, i, self.leaves[i] if i < len(self.leaves) else None)

    def _put(self, level: int, index: int, node: str | None) -> None:
        self.stack.append((level, index, node))
        if self.low <= level < self.high:
            self.nodes[level, index] = node


def block_root(leaves: list[str], height: int) -> str:
    """The node `height` levels above the leaves, which are 2^height or, in a group's last block, fewer."""
    level = leaves
    for _ in range(height):
        level = [_h(level[i], level[i + 1] if i + 1 < len(level) else None) for i in range(0, len(level), 2)]
    return level[0]


def paths(leaves: list[str], height: int, subtree: int = SUBTREE) -> Iterator[list[tuple[bool, str | None]]]:
    """For each leaf in order: (sibling is on the left, sibling or None where the node is hashed alone), by level.

    Level j's subtree has its bottom nodes at height cuts[j]. Its existing subtree holds all siblings of
    the current path at these heights; when the path leaves it, the desired subtree takes its place.
    """
    cuts = list(range(0, height, subtree))
    tops = [min(c + subtree, height) for c in cuts]
    exist: list[dict] = []
    desired: list[_Stack | None] = []
    for low, high in zip(cuts, tops):
        first = _Stack(leaves, low, high, 0)
        while not first.done:
            first.step()
        exist.append(first.nodes)
        desired.append(_Stack(leaves, low, high, 1) if high < height and 1 << high < len(leaves) else None)
    for i in range(len(leaves)):
        if i:
            for j, high in enumerate(tops):
                if high < height and i % (1 << high) == 0:
                    ready = desired[j]
                    while not ready.done:  # steps that are left over
                        ready.step()
                    exist[j] = ready.nodes
                    after = (i >> high) + 1
                    desired[j] = _Stack(leaves, cuts[j], high, after) if after << high < len(leaves) else None
        out = []
        for j, (low, high) in enumerate(zip(cuts, tops)):
            for level in range(low, high):
                at = i >> level
                out.append((bool(at & 1), exist[j].get((level, at ^ 1))))
        yield out
        for ahead in desired:
            if ahead is not None:
                ahead.step()
                ahead.step()


def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with _at, the place of each from 0 inside its group in the given order.

    Rows are cut into ranges of (group, order) by Spark's sampled bounds and counted in their ranges; a range's
    start is the sum of the counts before it. No group meets in one task. Equal rows are interchangeable,
    so a number of their own spreads them over ranges.
    """
    schema = rows.schema
    names = rows.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, now, n = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            places = []
            for g in batch.column(names.index(group)).to_pylist():
                if now != (g,):
                    now, n = (g,), 0
                places.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*names, "_part", "_in"])

    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = rows.withColumn("_any", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*keys, "_any").sortWithinPartitions(*keys).select(names)
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    placed = stored(dealt.mapInArrow(count, f"{typed}, _part int, _in long"), "placed")
    sums = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_start"))
    out = placed.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return out.select(*names, (F.col("_start") + F.col("_in")).alias("_at"))


def _blocks(nodes: DataFrame) -> DataFrame:
    """nodes (_group, _at, _hash, ...) -> a row for each aligned block: _group, _block, _rows in order."""
    item = F.struct("_at", "_hash", *(c for c in nodes.columns if c not in ("_group", "_at", "_hash")))
    return nodes.groupBy("_group", F.shiftright("_at", HEIGHT).alias("_block")).agg(F.sort_array(F.collect_list(item)).alias("_rows"))


def _levels(count: Column) -> Column:
    """Levels of a block's tree in a group of so many nodes: all HEIGHT, or those up to the group's root."""
    return F.least(F.lit(HEIGHT), F.length(F.bin(count - 1)) - (count == 1).cast("int"))


def _per_block(blocks: DataFrame, schema: str, f: Callable[[list[dict], int], object]) -> DataFrame:
    """blocks with _made, what f makes of a block's hashes and its tree's height."""
    names = [c for c in blocks.columns if c != "_hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a block at a time: what is made of it is larger than it is
                one = batch.slice(i, 1)
                made = f(one.column("_hashes")[0].as_py(), one.column("_levels")[0].as_py())
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in names), pa.array([made], kind)], names=[*names, "_made"])

    kind = pa.list_(pa.list_(pa.struct([("left", pa.bool_()), ("hash", pa.string())]))) if "array" in schema else pa.string()
    typed = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in blocks.schema if x.name in names)
    return blocks.mapInArrow(run, f"{typed}, _made {schema}")


def _block_paths(hashes: list[str], height: int) -> list[list[dict]]:
    return [[{"left": s, "hash": h} for s, h in path] for path in paths(hashes, height)]


def _tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (_group, _at, _hash, others) -> its blocks (_group, _block, _levels, _rows, _hashes), stored, and
    (_g, _b, _above, _root): each block's path to its group's root, a row a block.

    Every round shrinks a group by 2^HEIGHT; there are as many as the largest group needs.
    """
    counts = stored(nodes.groupBy("_group").agg(F.count("*").alias("_n")), "counts")
    most = counts.agg(F.max("_n")).first()[0] or 0
    tall = _blocks(nodes).join(counts.select(F.col("_group").alias("_g"), "_n"), F.col("_group").eqNullSafe(F.col("_g")))
    tall = tall.select("_group", "_block", _levels(F.col("_n")).alias("_levels"), "_rows", F.transform("_rows", lambda r: r["_hash"]).alias("_hashes"))
    tall = stored(tall, "blocks")
    roots = stored(_per_block(tall.select("_group", "_block", "_levels", "_hashes"), "string", block_root), "roots")
    if most <= 1 << HEIGHT:
        return tall, roots.select(F.col("_group").alias("_g"), F.col("_block").alias("_b"), F.array().cast(PATH).alias("_above"), F.col("_made").alias("_root"))
    higher = _proofs(*_tree(roots.select("_group", F.col("_block").alias("_at"), F.col("_made").alias("_hash"))))
    return tall, stored(higher.select(F.col("_group").alias("_g"), F.col("_row._at").alias("_b"), F.col("_path").alias("_above"), "_root"), "upper")


def _proofs(tall: DataFrame, upper: DataFrame) -> DataFrame:
    """Of each node in the blocks: _group, _row (its struct), _path to the root of upper, upper's other columns."""
    more = [c for c in upper.columns if c not in ("_g", "_b", "_above")]
    joined = tall.join(upper, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b")))
    made = _per_block(joined.select("_group", "_rows", "_levels", "_hashes", "_above", *more), f"array<{PATH}>", _block_paths)
    each = made.select("_group", "_above", *more, F.explode(F.arrays_zip(F.col("_rows").alias("r"), F.col("_made").alias("p"))).alias("_x"))
    return each.select("_group", F.col("_x.r").alias("_row"), F.concat("_x.p", "_above").alias("_path"), *more)


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """order, group, leaf, subroot, root, path and the columns of `keep` for every row of docs.

    path: (left, hash) level by level from the leaf via its group's root to the dataset's; hash is null
    where the node is alone in its run and hashed by itself. `keep` names expressions of docs' columns
    whose values go along. Rows are leaves each, repeated ones too; equal orders are in the order of the
    leaves' hashes, null orders come first. A null group is a group of its own, before all others. Fields may
    be null, empty or of any length. No rows, no manifest. Columns that the leaf does not cover are ignored.
    """
    keep = keep or {}
    leaves = docs.select(F.col(group).cast("string").alias("_group"), F.col(order).alias("_order"), leaf_hash(*FIELDS).alias("_hash"), *(e.alias(f"_keep_{c}") for c, e in keep.items()))
    tall, upper = _tree(_numbered(stored(leaves, "leaves"), "_group", ["_order", "_hash"]))
    subroots = upper.select(F.lit(0).alias("_every"), F.col("_g").alias("_name"), F.col("_root").alias("_hash")).distinct()
    top = _numbered(stored(subroots, "subroots"), "_every", ["_name"]).withColumnRenamed("_every", "_group")
    top = _proofs(*_tree(top)).select(F.col("_row._name").alias("_name"), F.col("_path").alias("_last"), F.col("_root").alias("root"))
    upper = upper.join(stored(top, "top"), F.col("_g").eqNullSafe(F.col("_name")))
    upper = upper.select("_g", "_b", F.concat("_above", "_last").alias("_above"), F.col("_root").alias("subroot"), "root")
    out = _proofs(tall, upper)
    return out.select(F.col("_row._order").alias(order), F.col("_group").alias(group), F.col("_row._hash").alias("leaf"), "subroot", "root", F.col("_path").alias("path"), *(F.col("_row")[f"_keep_{c}"].alias(c) for c in keep))


def folded(leaf: Column, path: Column) -> Column:
    """The root recomputed from a leaf and its path."""
    side = lambda s, on: F.when(s["left"] == F.lit(on), F.coalesce(s["hash"], F.lit(""))).otherwise(F.lit(""))
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(side(s, True), acc, side(s, False)), 256))


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row with 1 added to n_chars, where 7 divides the CRC-32 of doc_id in decimal; else null."""
    more = F.col("n_chars") + 1
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf_hash(*(more if c == "n_chars" else c for c in FIELDS)))


def audit(docs: DataFrame) -> DataFrame:
    """The manifest's digests, and what each row's proof says of the row after tampering."""
    proven = manifest(docs, keep={"_claimed": tampered(docs)})
    fold = folded(F.coalesce("_claimed", "leaf"), F.col("path"))
    out = proven.withColumn("proof_sha256", F.sha2(F.array_join(F.transform("path", lambda s: s["hash"]), ""), 256)).withColumn("folded_root", fold)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
