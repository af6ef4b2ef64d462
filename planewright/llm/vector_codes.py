"""Product codes of vectors with codebooks by Lloyd's method, all in whole numbers.

A vector's components become integers and are cut into parts; every part position has a codebook.
A task keeps, for each part position and entry, a heap of the parts assigned to the entry, keyed by
slack: the lower bound of the distance to all other entries minus the upper bound of that to its own.
When entries move, a part's slack shrinks at most by its own entry's drift and the largest drift of
the others. So each entry's cumulative drift is all that later rounds need: parts on top of a heap
whose key the drift has reached are popped and compared with all entries again, all others keep
theirs. Keys are written with the vectors between rounds; a round returns changes of sums only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewright.llm.common import with_keys, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A component x counts as floor(SCALE * x), between -LARGEST and LARGEST, so that squared distances fit in 64 bits.
SCALE, LARGEST = 256, 1 << 28


def usable(column: Column) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return column.isNotNull() & F.coalesce(finite, F.lit(False))


def whole(values: np.ndarray) -> np.ndarray:
    """Components as integers."""
    return np.clip(np.floor(SCALE * values.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64)


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of parts (rows) to entries (columns)."""
    out = np.zeros((len(parts), len(entries)), np.int64)
    for a, b in zip(parts.T, entries.T, strict=True):
        out += np.square(a[:, None] - b[None, :])
    return out


class Heaps:
    """The heaps of one part position: per entry its members by key, least first (ascending arrays are heaps)."""

    def __init__(self, entry: np.ndarray, key: np.ndarray, entries: int):
        self.members = np.lexsort((key, entry))
        self.keys = key[self.members]
        self.borders = np.searchsorted(entry[self.members], np.arange(entries + 1))

    def pop(self, bound: np.ndarray) -> np.ndarray:
        """Members whose key their entry's bound has reached, taken from the tops of the heaps."""
        out = []
        for e, b in enumerate(bound):
            first, last = self.borders[e], self.borders[e + 1]
            n = int(np.searchsorted(self.keys[first:last], b, "right"))
            out.append(self.members[first : first + n])
        return np.concatenate(out)


def reached(drift: np.ndarray) -> np.ndarray:
    """Keys up to which a drift may have changed an assignment, with room for rounding."""
    return drift * (1 + 1e-12) + 1e-9


def nearest(parts: np.ndarray, entries: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (the first of equals), and its key: slack plus the entry's drift so far."""
    d = distances(parts, entries)
    best = d.argmin(1)
    rows = np.arange(len(parts))
    upper = np.sqrt(d[rows, best].astype(np.float64))
    d[rows, best] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(1).astype(np.float64)) if d.shape[1] > 1 else np.full(len(parts), np.inf)
    return best, (lower - upper) - 1e-12 * (upper + np.where(np.isinf(lower), 0, lower)) + drift[best]


def moved(drift: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Cumulative drift after codebooks (position, entry, component) went from ``old`` to ``new``."""
    step = np.sqrt(np.square(new - old).sum(2).astype(np.float64))
    out = drift.copy()
    for p, s in enumerate(step):
        order = np.argsort(-s)
        others = np.full(len(s), s[order[0]] if len(s) else 0.0)
        if len(s):
            others[order[0]] = s[order[1]] if len(s) > 1 else 0.0
        out[p] += s + others
    return out


def rounded(vectors: np.ndarray, codes: np.ndarray | None, keys: np.ndarray | None, books: np.ndarray, drift: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and keys of a block of vectors under new codebooks; changes of the entries' sums and counts go to ``sums``.

    Without codes, all parts are compared with all entries; else those that the heaps give.
    """
    positions, entries, width = books.shape
    first = codes is None
    codes = np.zeros((len(vectors), positions), np.uint8) if first else codes.copy()
    keys = np.zeros((len(vectors), positions)) if first else keys.copy()
    for p in range(positions):
        parts = vectors[:, p * width : (p + 1) * width]
        popped = np.arange(len(vectors)) if first else Heaps(codes[:, p], keys[:, p], entries).pop(reached(drift[p]))
        if not len(popped):
            continue
        best, key = nearest(parts[popped], books[p], drift[p])
        old = codes[popped, p]
        keys[popped, p] = key
        codes[popped, p] = best
        changed = slice(None) if first else best != old
        if not first:
            np.subtract.at(sums[p, :, :width], old[changed], parts[popped[changed]])
            np.subtract.at(sums[p, :, width], old[changed], 1)
        np.add.at(sums[p, :, :width], best[changed], parts[popped[changed]])
        np.add.at(sums[p, :, width], best[changed], 1)
    return codes, keys


def errors(vectors: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances of vectors to what their codes stand for."""
    out = np.zeros(len(vectors), np.int64)
    width = books.shape[2]
    for p in range(len(books)):
        out += np.square(vectors[:, p * width : (p + 1) * width] - books[p][codes[:, p]]).sum(1)
    return out


def updated(books: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Entries replaced by the floor of their members' mean; those without members stay."""
    n = sums[:, :, -1:]
    return np.where(n > 0, sums[:, :, :-1] // np.maximum(n, 1), books)


# ------------------------------------------------------------------------------ Spark


def padded(lists: object, size: int) -> np.ndarray:
    """A list array as rows of ``size`` numbers, short ones filled up with zeros."""
    borders, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    length = np.diff(borders)
    if (length == size).all():
        return values[borders[0] : borders[-1]].reshape(len(lists), size)
    out = np.zeros((len(lists), size), values.dtype)
    row = np.repeat(np.arange(len(lists)), length)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = values[borders[0] : borders[-1]]
    return out


def _fixed(rows: np.ndarray) -> object:
    """Rows of an array as binary values."""
    import pyarrow as pa

    rows = np.ascontiguousarray(rows)
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32)), pa.py_buffer(rows)])


def _loose(column: object, kind: type, n: int) -> np.ndarray:
    """Binary values as rows of an array."""
    borders = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8)[borders[0] : borders[-1]].view(kind).reshape(len(column), n)


STATE = "id {id}, label {label}, vector binary, codes binary, keys binary, sums array<long>"


def _round(books: np.ndarray, drift: np.ndarray, first: bool):
    positions, entries, width = books.shape
    size = positions * width

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums, names, kinds = np.zeros((positions, entries, width + 1), np.int64), ["id", "label", "vector", "codes", "keys", "sums"], None
        for batch in batches:
            kinds = [batch.column(0).type, batch.column(1).type]
            if not len(batch):
                continue
            if first:
                vectors = whole(padded(batch.column(2), size))
                codes, keys = rounded(vectors, None, None, books, drift, sums)
            else:
                vectors = _loose(batch.column(2), np.int32, size).astype(np.int64)
                codes, keys = rounded(vectors, _loose(batch.column(3), np.uint8, positions), _loose(batch.column(4), np.float64, positions), books, drift, sums)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _fixed(vectors.astype(np.int32)), _fixed(codes), _fixed(keys), pa.nulls(len(batch), pa.list_(pa.int64()))], names)
        if kinds:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), *(pa.nulls(1, pa.binary()) for _ in range(3)), pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))], names)

    return run


def _last(books: np.ndarray, drift: np.ndarray, first: bool):
    positions, entries, width = books.shape
    size = positions * width

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        spare = np.zeros((positions, entries, width + 1), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            if first:
                vectors = whole(padded(batch.column(2), size))
                codes, _ = rounded(vectors, None, None, books, drift, spare)
            else:
                vectors = _loose(batch.column(2), np.int32, size).astype(np.int64)
                codes, _ = rounded(vectors, _loose(batch.column(3), np.uint8, positions), _loose(batch.column(4), np.float64, positions), books, drift, spare)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _fixed(codes), pa.array(errors(vectors, codes, books))], ["id", "label", "codes", "error"])

    return run


def compress(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Per usable vector id, label, codes (a byte for each part) and error, its squared distance to what the codes stand for; and the codebooks.

    Rows without a vector, or with null or non-finite components, are left out. A codebook starts as
    the parts of the vectors with the smallest ids (null ids last, equal ids in the order of their
    vectors); with fewer vectors than ``entries`` it has as many entries. Vectors shorter than the
    longest, or not divisible by ``parts``, count as filled up with zeros; components beyond 2**20 as
    2**20. Ties go to the lower entry; repeated rows count each; an empty table gives no rows and
    empty codebooks; further columns are ignored.
    """
    names = [F.col(f"`{c}`").alias(n) for c, n in ((id_column, "id"), (label_column, "label"), (vector_column, "vector"))]
    rows = vectors.select(*names).filter(usable(F.col("vector")))
    longest = rows.agg(F.max(F.size("vector"))).head()[0] or 0
    width = -(-longest // parts)
    seeds = rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    start = np.zeros((len(seeds), parts * width))
    for k, r in enumerate(seeds):
        start[k, : len(r["vector"])] = r["vector"]
    books = whole(start).reshape(len(seeds), parts, width).transpose(1, 0, 2)
    drift, sums = np.zeros(books.shape[:2]), np.zeros((parts, len(seeds), width + 1), np.int64)
    kinds = {n: rows.schema[n].dataType.simpleString() for n in ("id", "label")}
    if not seeds:
        return rows.select("id", "label", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("long").alias("error")), books
    for k in range(rounds):
        state = written(rows.mapInArrow(_round(books, drift, k == 0), STATE.format(**kinds)), "vector-codes")
        changes = state.filter("sums IS NOT NULL").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
        flat = sums.reshape(-1)
        for r in changes:
            flat[r["pos"]] += r["n"]
        new = updated(books, sums)
        drift, books = moved(drift, books, new), new
        rows = state.filter("sums IS NULL").drop("sums")
    return rows.mapInArrow(_last(books, drift, rounds == 0), "id {id}, label {label}, codes binary, error long".format(**kinds)), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by position, entry and component."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors of its label's rows summed; rows of common labels stay where they are."""
    name = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")).alias("key")
    rows = written(coded.select("*", name), "vector-labels")
    totals = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("error").alias("label_error"))
    return with_keys(rows, totals, "key", rows.count()).drop("key")
