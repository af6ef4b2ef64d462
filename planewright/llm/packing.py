"""Packing documents' ids into sequences of a fixed length with little padding.

Each task packs the documents of its own input partition; nothing is shuffled. A document's ids are
cut into full windows, which are sequences by themselves, and a rest. Rests are gathered in blocks
and each block is split by Karmarkar-Karp multiway differencing: every rest starts as a partial
partition of its own, and the two partial partitions with the largest imbalance are merged, large
loads against small ones, until one is left, whose windows are nearly equal. The number of windows
is what the block's ids need; it rises until all windows fit (``cut=False``), or the few windows
above the capacity give their excess to windows below it (``cut=True``, the default, which leaves
less than one window of padding a block).
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewright.llm.common import released, text_of
from planewright.llm.tokens import crc32_ids, encoder, tokenizer_path, utf8

CAPACITY = 2048
#: Rests that one differencing run splits; bounds its memory and time.
BLOCK_RESTS = 1024


class Partial:
    """A partial partition: loads of its windows in falling order (empty ones left out) and their items."""

    __slots__ = ("items", "loads")

    def __init__(self, loads: list[int], items: list[list[int]]):
        self.loads, self.items = loads, items

    def imbalance(self, k: int) -> int:
        return self.loads[0] - (self.loads[-1] if len(self.loads) == k else 0)

    def merge(self, other: Partial, k: int) -> Partial:
        """Large loads meet small ones; windows that only one side fills stay as they are."""
        a, b = (self, other) if len(self.loads) >= len(other.loads) else (other, self)
        if len(b.loads) == 1:  # common and cheap: the smallest window takes it
            load, items = (a.loads.pop() + b.loads[0], a.items.pop() + b.items[0]) if len(a.loads) == k else (b.loads[0], b.items[0])
            at = bisect.bisect_right(a.loads, -load, key=lambda x: -x)
            a.loads.insert(at, load)
            a.items.insert(at, items)
            return a
        shared = max(0, len(a.loads) + len(b.loads) - k)
        keep = len(a.loads) - shared
        pairs = [*zip(a.loads[:keep], a.items[:keep], strict=True), *zip(b.loads[: len(b.loads) - shared], b.items[: len(b.items) - shared], strict=True)]
        small = zip(b.loads[::-1], b.items[::-1], strict=True)
        pairs += [(x + y, p + q) for (x, p), (y, q) in zip(zip(a.loads[keep:], a.items[keep:], strict=True), small, strict=False)]
        pairs.sort(key=lambda x: -x[0])
        return Partial([x for x, _ in pairs], [p for _, p in pairs])


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of ``sizes`` (all positive) in ``k`` windows of nearly equal sums."""
    heap = [(-s, i, Partial([s], [[i]])) for i, s in enumerate(sizes)]
    if not heap:
        return [[] for _ in range(k)]
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        one = heapq.heappop(heap)[2].merge(heapq.heappop(heap)[2], k)
        heapq.heappush(heap, (-one.imbalance(k), order, one))
        order += 1
    items = heap[0][2].items
    return items + [[] for _ in range(k - len(items))]


def windows(sizes: list[int], capacity: int, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (index, start, length), none longer than ``capacity``."""
    k = -(-sum(sizes) // capacity)
    while True:
        parts = differencing(sizes, k)
        if cut or max((sum(sizes[i] for i in p) for p in parts), default=0) <= capacity:
            break
        k += 1
    out, excess = [], []
    for part in parts:
        room, pieces = capacity, []
        for i in part:
            n = min(room, sizes[i])
            if n:
                pieces.append((i, 0, n))
            if n < sizes[i]:
                excess.append((i, n, sizes[i] - n))
            room -= n
        out.append(pieces)
    for pieces in out:
        room = capacity - sum(n for _, _, n in pieces)
        while room and excess:
            i, start, n = excess.pop()
            pieces.append((i, start, min(n, room)))
            if n > room:
                excess.append((i, start + room, n - room))
            room -= min(n, room)
    return out


SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = 1, tokenizer: str | None = None, block_rests: int = BLOCK_RESTS, cut: bool = True, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: where it lies in its document and in its sequence.

    Null text counts as empty, so the document is its end id alone; a null id is kept as it is;
    repeated rows are packed as often as they occur; an empty table gives no rows; further columns
    are ignored. ``sequence_id`` is unique over all tasks; offsets in a sequence leave no gap.
    ``with_ids`` adds the piece's ids.
    """
    path = tokenizer or tokenizer_path()
    kind = df.schema[id_column].dataType.simpleString()
    schema = SCHEMA.format(id=kind) + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        code = encoder(path)
        base, number = TaskContext.get().partitionId() << 36, 0
        rests: list[tuple[object, int, int, np.ndarray]] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, total, seq, off = zip(*rows, strict=True)
            columns = [pa.array(doc, id_type), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([crc32_ids(x) for x in ids], pa.int64()), pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array(off, pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32).tolist() for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        def packed() -> list[tuple]:
            nonlocal number
            rows = []
            for pieces in windows([len(r[3]) for r in rests], capacity, cut):
                offset = 0
                for i, start, n in pieces:
                    doc, before, total, ids = rests[i]
                    rows.append((doc, before + start, ids[start : start + n], total, base + number, offset))
                    offset += n
                number += 1
            rests.clear()
            return rows

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            data, borders = utf8(batch.column(1))
            rows = []
            ids, borders = code.encode(data, borders)
            for k, doc in enumerate(batch.column(0).to_pylist()):
                own = np.append(ids[borders[k] : borders[k + 1]], np.array([end_id], ids.dtype))
                full = len(own) - len(own) % capacity
                for start in range(0, full, capacity):
                    rows.append((doc, start, own[start : start + capacity], len(own), base + number, 0))
                    number += 1
                if full < len(own):
                    rests.append((doc, full, len(own), own[full:]))
                if len(rests) == block_rests:
                    rows += packed()
            if rows:
                yield out(rows)
        if rests:
            yield out(packed())

    return df.select(F.col(id_column), text_of(text_column).alias("text")).mapInArrow(released(run), schema)
