"""Near-duplicates: SuperMinHash signatures, banding, exact verification and union-find grouping.

Documents with equal shingle sets are one class from the start, so that copies cost nothing later.
Classes whose signatures agree in a band are candidates. Candidates are taken in rounds, so that a
large group is joined by about as many checks as it has members: first each class against the
smallest class that it shares most bands with, then, in bands that still hold several components,
the best pair of each two components, then all pairs left that the signatures don't rule out. Every
pair is checked on the full shingle sets; links are contracted by union-find inside tasks and by
star contraction between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewright.llm.common import HOT, HOT_ROWS, SPACED, forgotten, mix, released, sections, text_of, with_keys, words, written
from planewright.llm.tokens import utf8

#: Slots of a signature, and of a band. A pair at 0.8 shares no band once in 10**7.
SLOTS, BAND = 128, 4
#: Slots of the finer signatures that the last round compares, a byte each.
FINE_SLOTS = 1024
#: Signatures that agree in a share of slots so many standard deviations below the threshold rule a pair out.
DEVIATIONS = 5.1
#: Bytes of text whose signatures are made together.
BLOCK = 1 << 20
#: Members of a band that one task compares with as many others.
MEMBERS = 1024
#: Documents, or pairs of them, whose sets a task holds at a time.
ROWS = 512

_FAR = np.uint64(1 << 63)


# ------------------------------------------------------------------------------ sets and signatures


def _joined(w: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of ``size`` consecutive words."""
    n = len(w) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += w[k : n + k] * np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1)) % (1 << 64))
    return mix(out + np.uint64(size))


def shingle_sets(data: np.ndarray, borders: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of texts laid end to end, and the texts' borders in them."""
    n = len(borders) - 1
    out, counts, i = [np.zeros(0, np.uint64)], np.zeros(n, np.int64), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(borders, borders[i] + BLOCK, "right")) - 1)
        part, inner = data[borders[i] : borders[j]], borders[i : j + 1] - borders[i]
        if j == i + 1:
            w = np.concatenate([np.zeros(0, np.uint64), *(h for _, _, _, h, _ in sections(part, SPACED, 1, BLOCK))])
            first = np.array([0, len(w)])
        else:
            start, _, w = words(np.insert(part, inner[1:-1], 32), SPACED)
            first = np.searchsorted(start, np.concatenate([[0], inner[1:-1] + np.arange(len(inner) - 2), [len(part) + len(inner)]]))
        full = _joined(w, size) if len(w) >= size else np.zeros(0, np.uint64)
        for k in range(j - i):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= size:
                own = np.sort(full[a : b - size + 1])
                own = own[np.append(True, own[1:] != own[:-1])]
            elif b > a:
                own = _joined(w[a:b], b - a)
            else:
                continue
            out.append(own)
            counts[i + k] = len(own)
        i = j
    return np.concatenate(out), np.concatenate([[0], np.cumsum(counts)])


def signatures(sets: np.ndarray, borders: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash: a row of ``slots`` values for each set; empty sets keep the largest value.

    Step j of an element draws the j-th slot of its own random permutation and a random rank above j.
    All elements take step j together; a set stops as soon as all its slots hold ranks below j + 1,
    which no later step could lower.
    """
    n = len(borders) - 1
    out = np.full((n, slots), _FAR, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(borders))
    flat = out.ravel()

    def drawn(x: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(x + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        return (j + (h & np.uint64(0xFFFFFF)) % np.uint64(slots - j)).astype(np.int64), (np.uint64(j) << np.uint64(40)) | (h >> np.uint64(24))

    slot, rank = drawn(sets, 0)
    np.minimum.at(flat, owner * slots + slot, rank)
    late = np.flatnonzero((out.max(1) >= np.uint64(1 << 40)) & (np.diff(borders) > 0))
    sizes = np.diff(borders)[late]
    lots = np.cumsum(sizes) // (25_600_000 // slots)  # sets whose permutations are held together
    for lot in np.unique(lots):
        own = late[lots == lot]
        at = np.concatenate([np.arange(borders[k], borders[k + 1]) for k in own])
        x, doc = sets[at], owner[at]
        order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(x), 1))
        k, _ = drawn(x, 0)
        order[np.arange(len(x)), k] = 0
        for j in range(1, slots):
            k, rank = drawn(x, j)
            row = np.arange(len(x))
            slot = order[row, k].astype(np.int64)
            order[row, k] = order[row, j]
            np.minimum.at(flat, doc * slots + slot, rank)
            open_ = out[own].max(1) >= np.uint64((j + 1) << 40)
            if not open_.all():
                own = own[open_]
                if not len(own):
                    break
                stay = np.isin(doc, own)
                x, doc, order = x[stay], doc[stay], order[stay]
    return out


def bands_of(sig: np.ndarray, band: int = BAND) -> np.ndarray:
    """A fingerprint for each band of each signature; the band's number is part of it."""
    n, slots = sig.shape
    cut = sig.reshape(n, slots // band, band)
    out = np.zeros(cut.shape[:2], np.uint64)
    for k in range(band):
        out = mix(out + cut[:, :, k])
    return mix(out + np.arange(cut.shape[1], dtype=np.uint64)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


# ------------------------------------------------------------------------------ Spark


def sketch(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, class_id (128-bit fingerprint of the set), bands and 16-bit slots."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                hi = min(lo + ROWS, len(batch))
                part, cut = shingle_sets(*utf8(batch.column(1)[lo:hi]), shingle)
                sig = signatures(part, cut)
                have = np.diff(cut) > 0
                one, two = mix(part), mix(part ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                sums = np.stack([np.add.reduceat(np.append(x, np.uint64(0)), cut[:-1]) if len(part) else np.zeros(hi - lo, np.uint64) for x in (one, two)], 1)
                sums[~have] = 0
                names = [s.tobytes() for s in sums]
                band = bands_of(sig)
                short = (mix(sig.ravel()).astype(np.uint16)).reshape(sig.shape)
                rows = [band[k].tolist() if have[k] else [] for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(np.diff(cut)), pa.array(names, pa.binary()), pa.array(rows, pa.list_(pa.int64())), pa.array([s.tobytes() for s in short], pa.binary())],
                    ["doc_id", "n_shingles", "class_id", "bands", "slots"],
                )

    source = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    return source.mapInArrow(released(run), f"doc_id {kind}, n_shingles long, class_id binary, bands array<bigint>, slots binary")


def contracted(links: DataFrame) -> DataFrame:
    """(node, root) of connected components over links (a, b); the root is the smallest node.

    Tasks first run union-find over the links they hold; then large-star and small-star steps, each
    a grouping with a small table out, go on until nothing changes. Nodes with a large share of all
    links are broadcast with their new neighbour, so that their links stay where they are.
    """

    def local(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        rows = [(x, root(x)) for x in parent]
        rows = [r for r in rows if r[0] != r[1]]
        for lo in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[lo : lo + 50_000]], pa.int64()) for k in (0, 1)], ["a", "b"])

    def star(edges: DataFrame, large: bool, total: int) -> DataFrame:
        """Each node's neighbours hang on the smallest of them: the larger neighbours, or those not larger and itself."""
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        hung = with_keys(both, least, "a", total) if total > HOT_ROWS else both.join(least.drop("n"), "a")
        if large:
            return hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = written(links.select("a", "b").mapInArrow(released(local), "a long, b long"), "links")
    now = mark(edges)
    while True:
        after = written(star(star(edges, True, 2 * now[0]), False, 2 * now[0]), "links")
        forgotten(edges)
        edges, before, now = after, now, mark(after)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _with_texts(pairs: DataFrame, texts: DataFrame, node: str, other: str, text: str, total: int) -> DataFrame:
    """``pairs`` with the texts of their column ``node``.

    Nodes with a large share of all pairs (fewer than HOT; their numbers alone are broadcast) take
    several tasks: pairs are dealt by ``other``, and the text goes to each of the tasks.
    """
    bound = max(HOT_ROWS, total // HOT)
    texts = texts.select(F.col("node").alias(node), F.col("text").alias(text))
    if total <= bound:
        return pairs.join(texts, node)
    hot = F.broadcast(pairs.groupBy(node).agg(F.count("*").alias("n")).filter(F.col("n") > bound).select(node, F.ceil(F.col("n") / bound).cast("int").alias("parts")))
    dealt = pairs.join(hot, node, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(other), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    spread = texts.join(hot, node, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(spread, [node, "part"]).drop("part")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of documents in ``texts`` whose full sets are similar."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ok = []
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                sets = [shingle_sets(*utf8(part.column(k)), shingle) for k in (2, 3)]
                ok += [similar(*(s[e[k] : e[k + 1]] for s, e in sets), percent) for k in range(len(part))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    total = pairs.count()
    both = _with_texts(_with_texts(pairs, texts, "b", "a", "tb", total), texts, "a", "b", "ta", total)
    return both.select("a", "b", "ta", "tb").mapInArrow(released(run), "a long, b long")


def _finer(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, slots) with FINE_SLOTS slots of a byte."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                sig = signatures(*shingle_sets(*utf8(part.column(1)), shingle), FINE_SLOTS)
                short = mix(sig.ravel()).astype(np.uint8).reshape(sig.shape)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in short], pa.binary())], ["node", "slots"])

    return texts.select("node", "text").mapInArrow(released(run), "node long, slots binary")


def _left_over(members: DataFrame, classes: DataFrame, roots: DataFrame, best: bool, percent: int, texts: DataFrame, shingle: int) -> DataFrame:
    """Pairs (a, b) of different components that share a band and whose signatures may be similar.

    Only bands with two components or more are looked at. Their members go to overlapping classes of
    set sizes (similar sets differ little in size); a large group is cut into blocks and each two
    blocks meet in one task. ``best`` gives only the closest pair of each two components in a group.
    """
    now = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    total = members.count()
    mixed = now.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band", "n")
    held = with_keys(now, mixed, "band", total)
    step = float(np.log(100 / percent))
    held = held.withColumn("size_class", F.floor(F.log("n_shingles") / step).cast("long")).withColumn("size_class", F.explode(F.array("size_class", F.col("size_class") + 1)))
    held = held.withColumn("cell", F.struct("band", "size_class"))
    counts = held.groupBy("cell").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    held = with_keys(held, counts.select("cell", "n", F.ceil(F.col("n") / MEMBERS).cast("int").alias("blocks")), "cell", 2 * total)
    held = held.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.select("band", "size_class", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band_no", "node", "root", "n_shingles")
    if best:
        held = held.join(classes.select("node", "slots", "bands"), "node")
    else:
        open_ = texts.join(held.select("node").distinct(), "node", "left_semi")
        fine = written(_finer(open_, shingle).join(classes.select("node", "bands"), "node"), "fine")
        held = held.join(fine, "node")
    key = ["band", "size_class", "i", "j"]
    dealt = held.repartition(*key).sortWithinPartitions(*key).select(*key, "own", "band_no", "node", "root", "n_shingles", "slots", "bands")

    def pairs_in(size_class: int, i: int, j: int, own: np.ndarray, number: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, slots: np.ndarray, bands: np.ndarray) -> list[tuple[int, int]]:
        if len(node) < 2 or (root == root[0]).all():
            return []
        left = np.flatnonzero(own == i)
        least_class = np.floor(np.log(size) / step)
        found = {}
        agree = percent / 100 - DEVIATIONS * np.sqrt(percent * (100 - percent)) / 100 / np.sqrt(slots.shape[1])
        for a in left:
            right = np.flatnonzero((own == j) & (root != root[a]) & (100 * np.minimum(size, size[a]) >= percent * np.maximum(size, size[a])))
            if i == j:
                right = right[right > a]
            # a pair that meets in several groups is taken in its first band and the first size class that both are in
            right = right[np.maximum(least_class[right], least_class[a]) == size_class]
            right = right[(bands[right] == bands[a]).argmax(1) == number[a]] if len(right) else right
            share = (slots[right] == slots[a]).mean(1) if len(right) else np.zeros(0)
            for b, s in zip(right[share >= agree].tolist(), share[share >= agree].tolist(), strict=True):
                two = (min(node[a], node[b]), max(node[a], node[b]))
                name = (min(root[a], root[b]), max(root[a], root[b])) if best else two
                found[name] = max(found.get(name, (-1.0, two)), (s, two))
        return [(int(x), int(y)) for _, (x, y) in found.values()]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        carry = None
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(9)]
            columns.append(np.frombuffer(b"".join(batch.column(9).to_pylist()), np.uint16 if best else np.uint8).reshape(len(batch), -1))
            columns.append(batch.column(10).flatten().to_numpy().reshape(len(batch), -1))
            if carry is not None:
                columns = [np.concatenate(x) for x in zip(carry, columns, strict=True)]
            group = np.stack(columns[:4], 1)
            edge = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
            rows = [r for a, b in zip(np.append(0, edge[:-1]), edge, strict=True) for r in pairs_in(*group[a, 1:].tolist(), *(c[a:b] for c in columns[4:]))] if len(edge) else []
            carry = [c[edge[-1] if len(edge) else 0 :] for c in columns]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])
        if carry is not None and len(carry[0]):
            rows = pairs_in(*(int(c[0]) for c in carry[1:4]), *carry[4:])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])
    return dealt.mapInArrow(released(run), "a long, b long").distinct()


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest id linked with it over any number of links.

    Null and empty texts and texts without words have an empty set and no link; texts of fewer words
    than a shingle are one shingle; equal sets are linked; repeated rows have a row each; a document
    without an id is in a component of its own (null); very long texts have all their shingles; an
    empty table gives no rows; further columns are ignored. Texts that share an id count as one
    document for the links. Ids are integers; component ids are long.
    """
    spark = docs.sparkSession
    sketches = written(sketch(docs, id_column, text_column, shingle), "sketch")
    real = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(real.groupBy("class_id").agg(F.min("doc_id").cast("long").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("slots").alias("slots"), F.count("*").alias("n")), "classes")
    # what is left of a document's signature from here on; those of the classes have a folder of their own
    found = written(sketches.select("doc_id", "n_shingles", "class_id"), "sets")
    forgotten(sketches)
    real = found.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    spread = classes.select(F.posexplode("bands").alias("band_no", "band"), "node", "n_shingles")
    shared = written(spread.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("centre")).filter("n > 1"), "shared")
    members = written(with_keys(spread, shared, "band", classes.count() * SLOTS // BAND), "members")
    forgotten(shared)

    # the texts that checks may need; joined by node, so that repeated rows fall together without a further shuffle
    whole = docs.select(F.col(id_column).cast("long").alias("node"), text_of(text_column).alias("text"))
    needed = whole.join(members.select("node").distinct(), "node").withColumn("hash", F.xxhash64("text"))
    texts = written(needed.dropDuplicates(["node", "hash"]).drop("hash"), "texts")
    roots = spark.createDataFrame([], "node long, root long")
    tried = links = None
    for best in (None, True, False):
        if best is None:
            votes = members.filter("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("n"))
            pairs = votes.groupBy("node").agg(F.max_by("centre", F.struct("n", -F.col("centre"))).alias("a")).select("a", F.col("node").alias("b"))
        else:
            pairs = _left_over(members, classes, roots, best, percent, texts, shingle)
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        forgotten(roots)
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = written(_verified(pairs, texts, shingle, percent), "verified")
        links = new if links is None else links.unionByName(new)
        roots = contracted(links)
    named = written(classes.select("class_id", "node", "n").join(roots, "node", "left").select("class_id", "n", F.coalesce("root", "node").alias("component_id")), "named")
    forgotten(members, texts, classes, tried, links, roots)
    linked = with_keys(real, named, "class_id", found.count()).drop("class_id")
    alone = found.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").cast("long").alias("component_id"))
    return linked.unionByName(alone)


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; columns stay as they are.

    Rows that repeat a kept id all stay only if their texts differ: equal id and text leaves one.
    Documents without an id stay.
    """
    found = groups(docs, id_column, text_column, shingle, percent)
    gone = found.filter(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id"))).select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(gone, docs[id_column] == F.col("__gone"), "left_anti")
    keyed = left.withColumn("__hash", F.xxhash64(text_column))
    named = keyed.filter(F.col(id_column).isNotNull()).dropDuplicates([id_column, "__hash"])
    return named.unionByName(keyed.filter(F.col(id_column).isNull())).drop("__hash")
