"""Shared helpers of the text operators: folders, key columns, byte-level hashing."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent, a temporary folder becomes the setting if driver and executors are
    one process (master ``local``); on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[(?!.*cluster)|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; cuts lineage and outlives executors.

    Shuffle files of the writing are removed as soon as it is done.
    """
    spark = df.sparkSession
    path = shared_folder(spark, kind)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Remove folders made by ``shared_folder``."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        with contextlib.suppress(Exception):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forgotten(*frames: DataFrame) -> None:
    """Remove the folders that ``written`` made for frames which nothing reads any more."""
    for df in frames:
        dropped(df.sparkSession, *{f.rpartition("/")[0] for f in df.inputFiles()})


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of batches, after which the worker gives memory that it has freed back to the system.

    Workers wait for further tasks beside the JVM, whose next step may need that memory.
    """

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        import ctypes
        import gc

        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # another C library keeps what it has
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return whole


#: Keys with more than the HOT-th part of all rows (there are fewer than HOT of them) are broadcast instead of shuffled.
HOT, HOT_ROWS = 4096, 8192


def with_keys(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner", bound: int | None = None) -> DataFrame:
    """``rows`` joined with ``table`` on ``key``, or with ``how`` "left_anti" those without a partner.

    ``table`` has one row for a key and in ``n`` how many of the ``total`` rows have it; ``n`` is left
    out of the result. Partners of more than the HOT-th part of the rows are fewer than HOT and are
    broadcast, so that their rows stay where they are; all others meet by a shuffle.
    """
    bound = max(HOT_ROWS, total // HOT) if bound is None else bound
    hot, cold = F.broadcast(table.filter(F.col("n") > bound).drop("n")), table.filter(F.col("n") <= bound).drop("n")
    rest = rows.join(hot, key, "left_anti")
    return rest.join(cold, key, "left_anti") if how == "left_anti" else rows.join(hot, key).unionByName(rest.join(cold, key))


def text_of(column: str = "text") -> Column:
    """The text column with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def boxed(docs: DataFrame) -> Column:
    """All columns of a row in one struct, out of the way of an operator's own names."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__in")


def unboxed(docs: DataFrame, *but: str) -> list[Column]:
    """The columns that ``boxed`` put away, but for some."""
    return [F.col(f"__in.`{c}`").alias(c) for c in docs.columns if c not in but]


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """A 64-bit key of a document's id and text: rows that repeat both share it."""
    return F.xxhash64(F.col(id_column), F.col(text_column))


# --------------------------------------------------------------------------- byte hashing

#: Fingerprints are polynomials modulo the prime 2**61 - 1 at a point drawn at random: two different
#: sequences of n symbols share one with a chance of at most n / 2**61, whatever they look like.
_M = np.uint64((1 << 61) - 1)
_POINT = 0x0B5A1E6D93C7F42B
_POWERS: dict[bool, np.ndarray] = {}
_LOW = np.uint64((1 << 32) - 1)


def _folded(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo 2**61 - 1."""
    x = (x & _M) + (x >> np.uint64(61))
    np.subtract(x, _M, out=x, where=x >= _M)
    return x


def modular_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, by halves of 31 and 30 bits."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    out = (a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30))
    out += (middle & np.uint64((1 << 30) - 1)) << half
    out += a0 * b0
    return _folded(out)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 .. n - 1 of the point, or of its inverse; kept between calls."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        point = pow(_POINT, -1, int(_M)) if inverse else _POINT
        have = np.ones(1, np.uint64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, modular_product(have, np.uint64(pow(point, len(have), int(_M))))])
        _POWERS[inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Two rows of running sums of (symbol + 1) * point**position, in upper and lower 32 bits.

    Symbols are bytes or 64-bit fingerprints. Sums may wrap around; those of a span of up to 2**22
    symbols are their difference.
    """
    power = powers(len(data))
    out = np.zeros((2, len(data) + 1), np.uint64)
    if data.dtype == np.uint8:
        symbol = data.astype(np.uint64) + np.uint64(1)
        high, low = symbol * (power >> np.uint64(32)), symbol * (power & _LOW)
    else:
        term = modular_product(_folded(data.view(np.uint64)) + np.uint64(1), power)
        high, low = term >> np.uint64(32), term & _LOW
    np.cumsum(high, out=out[0, 1:])
    np.cumsum(low, out=out[1, 1:])
    return out


def _named(high: np.ndarray, low: np.ndarray, unit: np.ndarray) -> np.ndarray:
    value = (high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32)) + _folded(low)
    return mix(modular_product(_folded(value), unit))


def _by_parts(n: int, part, size: int = 1 << 15) -> np.ndarray:
    """part(a, b) for consecutive ranges of 0 .. n, which stay in a core's cache."""
    out = np.empty(n, np.uint64)
    for a in range(0, n, size):
        b = min(n, a + size)
        out[a:b] = part(a, b)
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of data[start:end], equal for equal spans wherever they stand."""
    unit = powers(sums.shape[1], inverse=True)
    return _by_parts(len(start), lambda a, b: _named(*(row[end[a:b]] - row[start[a:b]] for row in sums), unit[start[a:b]]))


def rolling_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of every ``width`` consecutive symbols."""
    unit = powers(sums.shape[1], inverse=True)
    return _by_parts(sums.shape[1] - width, lambda a, b: _named(*(row[a + width : b + width] - row[a:b] for row in sums), unit[a:b]))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Word bytes: all but the six ASCII space characters.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Word bytes: digits, lower-case letters and whatever is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def words(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and fingerprints of the words (runs of bytes in ``table``) of bytes with A-Z lower-cased."""
    data = _FOLD[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = table[data]
    edges = np.diff(inside)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return start, end, span_hash(prefix_hash(data), start, end)


def sections(data: np.ndarray, table: np.ndarray, window: int, size: int):
    """One text's words section by section: bytes, starts and ends in them, fingerprints, and the number of words before.

    Sections take ``size`` bytes and overlap by ``window`` - 1 words.
    """
    begin, before = 0, 0
    while True:
        end = min(len(data), begin + size)
        if end < len(data):
            gap = np.flatnonzero(~table[_FOLD[data[begin:end]]])
            if len(gap):
                end = begin + int(gap[-1]) + 1
            else:
                end = next((e for e in range(end, len(data)) if not table[_FOLD[data[e]]]), len(data))
        start, stop, h = words(data[begin:end], table)
        yield data[begin:end], start, stop, h, before
        if end == len(data):
            return
        keep = max(0, len(h) - window + 1)
        if keep == 0 and begin + int(start[0] if len(h) else 0) == begin:
            size *= 2  # fewer words than the overlap: the next section must reach further
        begin, before = begin + int(start[keep]) if keep < len(h) else end, before + keep
