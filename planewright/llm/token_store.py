"""Raw id payloads in shard files with a minimal perfect hash index over document keys.

Documents are dealt to shards by ranges of their key (bounds from an approximate quantile of the key
column alone), and each shard is written by one task, in key order, straight to the shared folder.
A shard file holds, little-endian and one after the other: the ids, the documents' borders in them,
the keys, and the index: displacements of the hash buckets, and per slot a stored fingerprint and the
row of the key. A key's slot takes two hashes and one displacement, whatever the shard's size.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewright.llm.common import mix, released, shared_folder, text_of
from planewright.llm.tokens import encoder, tokenizer_path, utf8

MAGIC = b"IDSHARD1"
TRAILER = struct.Struct("<8sIQQQQ")
#: Mean keys in a bucket of the index.
BUCKET_KEYS = 4
DIRECT = np.uint32(1 << 31)


# ------------------------------------------------------------------------------ index


def _hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket hash, slot hash and 32-bit fingerprint of 64-bit keys."""
    a = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x51ED270B7F4A7C15))
    b = mix(a + np.uint64(0x2545F4914F6CDD1D))
    return a, b, (mix(b) >> np.uint64(32)).astype(np.uint32)


def _displaced(b: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    return (mix(b + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Displacements, fingerprints and rows of a minimal perfect hash of distinct keys.

    Buckets are placed from the largest; a bucket tries displacements until its keys land in free
    slots. A bucket of one key keeps its slot itself, so that the last free slots cost no search.
    """
    n = len(keys)
    buckets = max(1, -(-n // BUCKET_KEYS))
    moves, prints, rows = np.zeros(buckets, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    if not n:
        return moves, prints, rows
    a, b, fp = _hashes(keys)
    bucket = (a % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    count = np.bincount(bucket, minlength=buckets)
    first = np.cumsum(count) - count
    taken = np.zeros(n, bool)
    tries = np.arange(256)
    for k in np.argsort(-count, kind="stable"):
        size = count[k]
        if size < 2:
            break
        own, at = order[first[k] : first[k] + size], 0
        while True:
            slots = _displaced(b[own][None, :], (at + tries)[:, None], n)
            ok = ~taken[slots].any(axis=1)
            for t in np.flatnonzero(ok):
                if len(set(slots[t].tolist())) == size:
                    break
            else:
                at += len(tries)
                continue
            break
        moves[k] = at + t
        taken[slots[t]] = True
        prints[slots[t]], rows[slots[t]] = fp[own], own
    single = np.flatnonzero(count == 1)
    free = np.flatnonzero(~taken)[: len(single)]
    own = order[first[single]]
    moves[single] = free.astype(np.uint32) | DIRECT
    prints[free], rows[free] = fp[own], own
    return moves, prints, rows


def find(keys: np.ndarray, moves: np.ndarray, prints: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Row of each key, or -1 where the stored fingerprint differs."""
    if not len(prints):
        return np.full(len(keys), -1, np.int64)
    a, b, fp = _hashes(keys)
    d = moves[(a % np.uint64(len(moves))).astype(np.int64)]
    slot = np.where(d & DIRECT, (d & ~DIRECT).astype(np.int64), _displaced(b, d, len(prints)))
    return np.where(prints[slot] == fp, rows[slot].astype(np.int64), -1)


# ------------------------------------------------------------------------------ files


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Shard:
    """A shard file opened for keyed access; only the index is held in memory."""

    def __init__(self, uri: str):
        files, path = _open(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        magic, self.width, n, ids, keys, buckets = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no id shard")
        at = ids * self.width

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(self.file.read_at(count * np.dtype(kind).itemsize, at), kind)
            at += out.nbytes
            return out

        self.borders, self.keys, self.nulls = take(n + 1, "<u8"), take(n, "<i8"), take(n, "u1").astype(bool)
        self.moves, self.prints, self.rows = take(buckets, "<u4"), take(keys, "<u4"), take(keys, "<u4")

    def row_of(self, keys: np.ndarray) -> np.ndarray:
        """First row with each key, or -1."""
        row = find(keys, self.moves, self.prints, self.rows)
        ok = (row >= 0) & (self.keys[row] == keys) & ~self.nulls[row] if len(self.keys) else row >= 0
        return np.where(ok, row, -1)

    def ids(self, row: int) -> np.ndarray:
        a, b = int(self.borders[row]), int(self.borders[row + 1])
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")


class ShardWriter:
    def __init__(self, uri: str, width: int):
        files, path = _open(uri)
        self.out, self.width = files.open_output_stream(path, compression=None, buffer_size=1 << 20), width
        self.borders, self.keys, self.nulls = [0], [], []

    def add(self, key: int | None, payload: bytes) -> None:
        self.out.write(payload)
        self.borders.append(self.borders[-1] + len(payload) // self.width)
        self.keys.append(key or 0)
        self.nulls.append(key is None)

    def close(self) -> tuple[int, int]:
        keys, nulls = np.array(self.keys, "<i8"), np.array(self.nulls, "u1")
        kept = np.flatnonzero(nulls == 0)
        distinct, first = np.unique(keys[kept], return_index=True)
        moves, prints, rows = build_index(distinct)
        rows = kept[first][rows] if len(rows) else rows
        for part, kind in ((self.borders, "<u8"), (keys, "<i8"), (nulls, "u1"), (moves, "<u4"), (prints, "<u4"), (rows, "<u4")):
            self.out.write(np.asarray(part).astype(kind).tobytes())
        self.out.write(TRAILER.pack(MAGIC, self.width, len(keys), self.borders[-1], len(distinct), len(moves)))
        self.out.close()
        return len(keys), self.borders[-1]


# ------------------------------------------------------------------------------ Spark


def write_store(df: DataFrame, folder: str | None = None, id_column: str = "doc_id", text_column: str = "text", end_id: int = 2, tokenizer: str | None = None, shards: int | None = None) -> DataFrame:
    """Write ``df`` as id shards and return their table: shard, path, n_docs, n_ids, base.

    ``base`` counts the ids of all shards before. Keys ascend within and over shards, null keys
    first. Null text is empty; repeated keys keep all their rows, next to each other, and the index
    leads to the first; an empty table gives no shards; further columns are ignored. Each attempt of
    a task writes a file of its own and the table names those of the attempts that Spark accepted,
    so a lost executor leaves nothing half written.
    """
    spark = df.sparkSession
    path = tokenizer or tokenizer_path()
    folder = folder or shared_folder(spark, "id-store")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = df.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    cuts = [i / shards for i in range(1, shards)]
    bounds = source.agg(F.percentile_approx("doc_id", cuts, 10 * shards).alias("b")).first()["b"] if cuts else None
    bounds = np.unique(np.array(bounds or [], np.int64))

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        code, squeeze = encoder(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, borders = code.encode(*utf8(batch.column(1)))
            end = np.array([end_id], ids.dtype).tobytes()
            packed = [squeeze.compress(ids[a:b].tobytes() + end) for a, b in zip(borders[:-1], borders[1:], strict=True)]
            key = batch.column(0)
            shard = np.searchsorted(bounds, key.fill_null(np.iinfo(np.int64).min).to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([key, pa.array(shard), pa.array(packed, pa.binary())], ["doc_id", "shard", "ids"])

    def write(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        import zstandard

        loosen, width = zstandard.ZstdDecompressor(), encoder(path).dtype.itemsize
        files, where = _open(folder)
        files.create_dir(where)
        done, now, writer, name = [], None, None, ""
        for batch in batches:
            for shard, key, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if shard != now:
                    if writer:
                        done.append((now, name, *writer.close()))
                    now, name = shard, f"{folder}/{shard:06d}-{uuid.uuid4().hex}.ids"
                    writer = ShardWriter(name, width)
                writer.add(key, loosen.decompress(ids))
        if writer:
            done.append((now, name, *writer.close()))
        if done:
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*done, strict=True), kinds, strict=True)], ["shard", "path", "n_docs", "n_ids"])

    coded = source.mapInArrow(released(encode), "doc_id long, shard int, ids binary")
    dealt = coded.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids").select("shard", "doc_id", "ids")
    table = dealt.mapInArrow(write, "shard int, path string, n_docs long, n_ids long").toPandas().sort_values("shard")
    table["base"] = table["n_ids"].cumsum() - table["n_ids"]
    return spark.createDataFrame(table, "shard int, path string, n_docs long, n_ids long, base long") if len(table) else spark.createDataFrame([], "shard int, path string, n_docs long, n_ids long, base long")


def read_store(spark: SparkSession, table: DataFrame) -> DataFrame:
    """One row per stored document, each fetched by its key through its shard's index."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(uri)
                rows = np.arange(len(shard.keys))
                found = shard.row_of(shard.keys)
                same = np.append(False, (shard.keys[1:] == shard.keys[:-1]) & ~shard.nulls[:-1]) if len(rows) else np.zeros(0, bool)
                head = np.maximum.accumulate(np.where(same, 0, rows)) if len(rows) else rows
                if not np.array_equal(found[~shard.nulls], head[~shard.nulls]):
                    raise ValueError(f"the index of {uri} doesn't lead to its keys")
                for lo in range(0, len(rows), 4096):
                    some = np.arange(lo, min(lo + 4096, len(rows)))
                    # null keys are in no index; the rows that share a key follow the one that the index names
                    reach = np.where(shard.nulls[some], some, found[some] + (some - head[some]))
                    crc = [zlib.crc32(shard.ids(int(r)).astype("<u4").tobytes()) for r in reach]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.keys[some], mask=shard.nulls[some]), pa.array(base + shard.borders[reach].astype(np.int64)), pa.array((shard.borders[reach + 1] - shard.borders[reach]).astype(np.int64)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table.select("path", "base").repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
