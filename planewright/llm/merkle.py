"""A Merkle manifest of a dataset: a node store in external memory, and proofs by merge-scans of it.

Leaves are digests of rows, in one tree per source. They are sorted once by a range partition into
runs, which give every leaf its coordinate (tree, number in its level). Blocks of ARITY**BLOCK_LEVELS
consecutive leaves then stream through a task that keeps the open nodes of each level only and writes
all levels of its block; the blocks' top nodes are the leaves of the next tier. The store is Parquet,
partitioned by level. Proofs come from the top tier down: the nodes of a block, sorted by the first
leaf below their parent, higher levels first, are read once, with one group of siblings a level in
memory. No tree, whatever its size, meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planewright.llm.common import shared_folder, written

#: Children of a node.
ARITY = 3
#: Levels that one task builds of a block, which so has at most 2187 leaves.
BLOCK_LEVELS = 7
#: Rows in a batch that leaves a task; a row with its path takes some kilobytes.
BATCH = 2048
#: Stands for the node itself in an entry of a path, between the siblings to its left and right.
HERE = "|"

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "level int, tree string, i long, hash string"


@dataclass
class Tree:
    """Trees of nodes: where their inner nodes lie, the leaves (tree, i, hash and more), the levels that begin a tier, and a tier's depth."""

    nodes: str
    leaves: DataFrame
    tiers: list[int]
    depth: int


@dataclass
class Manifest:
    """The trees over each source's rows, the tree over their roots, and its root (null for an empty dataset).

    Leaves of ``rows`` are named by source in ``tree``, and carry doc_id and ``other``, a digest to be verified in their place (or null).
    """

    rows: Tree
    sources: Tree
    root: str | None


# ------------------------------------------------------------------------------ leaves


def framed(column: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null as a dash."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(columns: list[Column]) -> Column:
    """Lowercase hexadecimal SHA-256 of framed values, one after the other."""
    return F.sha2(F.concat(*(framed(c) for c in columns)), 256)


def tampered(doc_id: Column) -> Column:
    """Whether a row is one whose text loses its line feeds: the CRC-32 of its decimal id is even. Null ids aren't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """Per row its source, id, leaf digest, and the digest after tampering (that of the row itself where none is due)."""
    held = [F.col(f"`{c}`") for c in COLUMNS]
    other = digest([*held[:-1], F.replace(held[-1], F.lit("\n"), F.lit(""))])
    return docs.select(held[1].cast("string").alias("tree"), held[0].alias("doc_id"), digest(held).alias("hash"), F.when(tampered(held[0]), other).alias("other"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``i``, their number within their ``tree`` in ascending order (null first), whatever share of them a tree has.

    A range partition by tree and order makes sorted runs; a row's place in its run, the place at
    which its tree begins there, and the tree's rows in runs before add up to its number.
    """
    key, place = ["tree", *order, "__row"], F.monotonically_increasing_id()
    runs = rows.withColumn("__row", place).repartitionByRange(*key).sortWithinPartitions(*key).drop("__row").withColumn("__at", place)
    runs = written(runs.withColumn("__run", F.shiftright("__at", 33)), "merkle-runs")
    begin = runs.groupBy("__run", "tree").agg(F.min("__at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))
    begin = begin.select(F.col("__run").alias("__r"), F.col("tree").alias("__t"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("__base"))
    met = runs.join(begin, (F.col("__run") == F.col("__r")) & F.col("tree").eqNullSafe(F.col("__t")))
    return met.select(*rows.columns, (F.col("__at") + F.col("__base")).alias("i"))


# ------------------------------------------------------------------------------ nodes


def parent(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def block_nodes(level: int, block: int, hashes: Iterator[str], depth: int = BLOCK_LEVELS) -> Iterator[tuple[int, int, str]]:
    """Level, number and digest of all nodes above one block's leaves, which lie at ``level``; each level keeps its open node only.

    A first block that isn't full is the whole tree and ends at its root; any other reaches
    ``depth`` levels up, be its last nodes as narrow as they may.
    """
    waiting: list[list[str]] = [[] for _ in range(depth + 1)]
    made = [0] * (depth + 1)

    def add(k: int, h: str) -> Iterator[tuple[int, int, str]]:
        waiting[k].append(h)
        made[k] += 1
        if k < depth and len(waiting[k]) == ARITY:
            yield from close(k)

    def close(k: int) -> Iterator[tuple[int, int, str]]:
        h = parent(waiting[k])
        waiting[k] = []
        yield level + k + 1, block * ARITY ** (depth - k - 1) + made[k + 1], h
        yield from add(k + 1, h)

    for h in hashes:
        yield from add(0, h)
    whole = block == 0 and made[0] < ARITY**depth
    for k in range(depth):
        if whole and made[k] == 1:
            return
        if waiting[k]:
            yield from close(k)


def _rows(batches: Iterator) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: object) -> Iterator:
    """Rows as record batches of at most BATCH rows."""
    import itertools

    import pyarrow as pa

    while lot := list(itertools.islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lot, strict=True), schema, strict=True)], schema=schema)


def _built(level: int, depth: int):
    def run(batches: Iterator) -> Iterator:
        import itertools

        import pyarrow as pa

        def made() -> Iterator[tuple]:
            for (tree, block), rows in itertools.groupby(_rows(batches), lambda r: r[:2]):
                for k, i, h in block_nodes(level, block, (r[3] for r in rows), depth):
                    yield k, tree, i, h

        yield from _batches(made(), pa.schema([("level", pa.int32()), ("tree", pa.string()), ("i", pa.int64()), ("hash", pa.string())]))

    return run


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of a store."""
    return spark.read.schema("tree string, i long, hash string, level int").parquet(path)


def build(found: DataFrame, depth: int = BLOCK_LEVELS) -> Tree:
    """Write all nodes above the leaves ``found`` (tree, i, hash), tier by tier."""
    spark, tree = found.sparkSession, Tree(shared_folder(found.sparkSession, "merkle-nodes"), found, [], depth)
    base = found
    while True:
        level = depth * len(tree.tiers)
        tree.tiers.append(level)
        blocks = base.select("tree", F.expr(f"i div {ARITY**depth}").alias("block"), "i", "hash").repartition("tree", "block").sortWithinPartitions("tree", "block", "i")
        blocks.mapInArrow(_built(level, depth), NODE).write.mode("append").partitionBy("level").parquet(tree.nodes)
        base = stored(spark, tree.nodes).filter(F.col("level") == level + depth).select("tree", "i", "hash")
        if base.filter("i > 0").isEmpty():
            return tree


def tops(trees: Tree) -> DataFrame:
    """Per tree the digest and height of its root."""
    inner = stored(trees.leaves.sparkSession, trees.nodes).filter("i = 0").select("tree", "hash", "level")
    return inner.unionByName(trees.leaves.filter("i = 0").select("tree", "hash", F.lit(0).alias("level"))).groupBy("tree").agg(F.max_by("hash", "level").alias("hash"), F.max("level").alias("height"))


def write_manifest(docs: DataFrame, depth: int = BLOCK_LEVELS) -> Manifest:
    """Digests of all rows of ``docs``, the trees over each source's rows, and the tree over their roots.

    Rows of a source are in ascending order of doc_id (null first), rows with one id in that of their
    digests; repeated rows are a leaf each. A null in any column is written as a dash; null is a
    source like others, before them. Texts of any length are digested whole; an empty table has no
    leaf and a null root; further columns don't count.
    """
    rows = build(written(numbered(written(leaves(docs), "merkle-leaves"), "doc_id", "hash"), "merkle-level0"), depth)
    roots = tops(rows).select(F.lit("").alias("tree"), F.col("tree").alias("source"), "hash", "height")
    sources = build(written(numbered(written(roots, "merkle-subroots"), "source"), "merkle-sources"), depth)
    top = tops(sources).select("hash").head()
    return Manifest(rows, sources, top["hash"] if top else None)


# ------------------------------------------------------------------------------ proofs


def paths(level: int, block: int, rows: Iterator[tuple], depth: int = BLOCK_LEVELS) -> Iterator[tuple[tuple, list[str], str | None]]:
    """Of each base row of a block its path to the root and its subroot, in one scan of the block's rows.

    Rows are (first leaf below the parent, level, number, digest, path, subroot, ...); the path and
    subroot of the block's top come first, in a row with -1, and each level's siblings before those
    below them. A path has an entry a level: the siblings' digests around HERE.
    """
    above: list[str] = []
    subroot = None
    group: dict[int, tuple[int, list[tuple]]] = {}
    spent: list[tuple] = []

    def entry(k: int, number: int) -> str:
        own = group[k][1]
        return "".join(r[3] for r in own if r[2] < number) + HERE + "".join(r[3] for r in own if r[2] > number)

    def flush() -> Iterator[tuple[tuple, list[str], str | None]]:
        # in the first block, a level of one node is the tree's root: it has no siblings to tell
        number, upper, alone = spent[0][2], [], block == 0 and len(spent) == 1 and spent[0][2] == 0
        for k in range(level + 1, level + depth) if not alone else ():
            number //= ARITY
            if k not in group or (block == 0 and group[k][0] == 0 and len(group[k][1]) == 1):
                break
            upper.append(entry(k, number))
        group[level] = (0, spent)
        for r in spent:
            yield r, [*([] if alone else [entry(level, r[2])]), *upper, *above], subroot

    for r in rows:
        if spent and spent[0][0] != r[0]:
            yield from flush()
            spent = []
        if r[0] < 0:
            above, subroot = r[4], r[5]
        elif r[1] == level:
            spent.append(r)
        elif r[1] in group and group[r[1]][0] == r[0]:
            group[r[1]][1].append(r)
        else:
            group[r[1]] = (r[0], [r])
    if spent:
        yield from flush()


def _scanned(level: int, carried: int, depth: int):
    def run(batches: Iterator) -> Iterator:
        import itertools

        import pyarrow as pa

        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        kept = [pa.field(f.name, f.type) for f in list(first.schema)[8 : 8 + carried]]

        def found() -> Iterator[tuple]:
            for (tree, block), rows in itertools.groupby(_rows(itertools.chain([first], batches)), lambda r: r[:2]):
                for r, path, subroot in paths(level, block, (x[2:] for x in rows), depth):
                    yield tree, r[2], r[3], path, subroot, *r[6:]

        names = [("tree", pa.string()), ("i", pa.int64()), ("hash", pa.string()), ("path", pa.list_(pa.string())), ("subroot", pa.string())]
        yield from _batches(found(), pa.schema([*map(lambda x: pa.field(*x), names), *kept]))

    return run


def extracted(trees: Tree, above: DataFrame) -> DataFrame:
    """The leaves of ``trees`` with ``path`` and ``subroot``; ``above`` has each tree's path and subroot at its root, and its root's height."""
    spark, last = trees.leaves.sparkSession, len(trees.tiers) - 1
    ends = above.withColumn("tier", F.least(F.expr(f"height div {trees.depth}"), F.lit(last)))
    came, size = None, F.lit(ARITY).cast("long")
    for tier in range(last, -1, -1):
        level = trees.tiers[tier]
        own = ends.filter(F.col("tier") == tier).select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot")
        tips = own if came is None else own.unionByName(came.select("tree", F.col("i").alias("block"), "path", "subroot"))
        nodes = stored(spark, trees.nodes)
        base = trees.leaves.withColumn("level", F.lit(0)) if tier == 0 else nodes.filter(F.col("level") == level)
        extra = [c for c in base.columns if c not in ("tree", "i", "hash", "level")]
        scope = base.unionByName(nodes.filter((F.col("level") > level) & (F.col("level") < level + trees.depth)), allowMissingColumns=True)
        wide = F.pow(size, F.col("level") - level).cast("long")
        scope = scope.select("tree", "i", "hash", "level", *extra, wide.alias("wide"))
        scope = scope.select("tree", F.expr(f"i * wide div {ARITY**trees.depth}").alias("block"), F.expr(f"i div {ARITY} * {ARITY} * wide").alias("start"), "level", "i", "hash", F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), *extra)
        tips = tips.select("tree", "block", F.lit(-1).cast("long").alias("start"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("i"), F.lit("").alias("hash"), "path", "subroot")
        laid = scope.unionByName(tips, allowMissingColumns=True).repartition("tree", "block").sortWithinPartitions("tree", "block", "start", F.desc("level"), "i")
        kinds = "".join(f", {c} {base.schema[c].dataType.simpleString()}" for c in extra)
        came = laid.mapInArrow(_scanned(level, len(extra), trees.depth), "tree string, i long, hash string, path array<string>, subroot string" + kinds)
        if tier:
            came = written(came, "merkle-paths")
    return came


def proofs(manifest: Manifest) -> DataFrame:
    """Per row tree (its source), i, hash, doc_id, other, subroot, and path: an entry a level up to the root of all."""
    none = F.array().cast("array<string>")
    ends = tops(manifest.sources).select("tree", "height", none.alias("path"), F.lit(None).cast("string").alias("subroot"))
    roots = extracted(manifest.sources, ends).select(F.col("source").alias("tree"), "path", F.col("hash").alias("subroot"), "height")
    return extracted(manifest.rows, written(roots, "merkle-tips"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a digest and its path lead to."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.replace(x, F.lit(HERE), h), 256))


def siblings(path: Column) -> Column:
    """Digest of a path's siblings, level by level, left to right."""
    return F.sha2(F.replace(F.array_join(path, ""), F.lit(HERE), F.lit("")), 256)
