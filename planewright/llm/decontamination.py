"""Benchmark passages in documents, found through suffix arrays of the training text.

Each task takes its documents block by block and builds the block's suffix array over words: the
positions whose first two words also open a benchmark window, sorted by their next ten words (no
other suffix can match). Every benchmark window is then looked up by binary search, which gives all
its places in the block; places that follow each other along one item make up the longest verbatim
matches. Nothing is shuffled. The benchmark is the stated query set: its windows are gathered in
rounds of bounded size, each round goes over all documents and is written before the next begins, so
that one is held at a time, and rounds are put together per document.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewright.llm.common import ALNUM, boxed, released, row_key, sections, text_of, unboxed, words, written
from planewright.llm.tokens import utf8

WINDOW = 10
#: Bytes of documents in one suffix array; longer documents go in sections that overlap.
BLOCK = 4 << 20
#: Windows of the benchmark that one round holds in each worker, in flat arrays of about 100 bytes a window.
ROUND_WINDOWS = 2_000_000


#: A match: its words, the document's word that it starts at, the item, and the item's word that it starts at.
Match = tuple[int, int, str | None, int]
NONE: Match = (0, 0, None, 0)


class Windows:
    """The windows of a round's items, ready for binary search."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        """``items`` are names, word fingerprints, and optionally the number of words of the item before these."""
        self.window = window
        self.names = [x[0] for x in items]
        self.begins = [x[2] if len(x) > 2 else 0 for x in items]
        lengths = np.array([len(x[1]) for x in items], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *(x[1] for x in items)])
        self.vocabulary, ids = np.unique(flat, return_inverse=True)
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        self.per = 64 // self.bits
        counts = np.where(lengths > 0, np.maximum(1, lengths - window + 1), 0)
        item = np.repeat(np.arange(len(items)), counts)
        offset = np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)
        start, sizes = (np.cumsum(lengths) - lengths)[item] + offset, np.minimum(window, lengths[item])
        ids = np.append(ids.astype(np.uint64) + np.uint64(1), np.zeros(window, np.uint64))
        columns = [np.where(k < sizes, ids[start + k], 0).astype(np.uint64) for k in range(window)]
        self.ones = np.unique(columns[0][sizes == 1])
        self.twos = np.unique((columns[0][sizes > 1] << np.uint64(32)) | columns[1][sizes > 1]) if window > 1 else np.zeros(0, np.uint64)
        #: distinct windows in order, and where each stands: items and offsets from ``border`` on
        self.low, first, which = np.unique(self.strings(self.packed(columns)), return_index=True, return_inverse=True)
        self.sizes = sizes[first]
        order = np.argsort(which, kind="stable")
        self.border = np.searchsorted(which[order], np.arange(len(self.low) + 1))
        self.item, self.offset = item[order].astype(np.int32), offset[order].astype(np.int32)
        #: a window shorter than the keys ends below its successor in its last word
        self.short = np.flatnonzero(self.sizes < window)
        after = [c[first[self.short]] + (self.sizes[self.short] - 1 == k).astype(np.uint64) for k, c in enumerate(columns)]
        self.short_high = self.strings(self.packed(after))

    def packed(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for k in range(0, self.window, self.per):
            part = np.zeros(len(ids[0]), np.uint64)
            for j in range(k, min(k + self.per, self.window)):
                part = (part << np.uint64(self.bits)) | ids[j]
            out.append(part)
        return out

    @staticmethod
    def strings(columns: list[np.ndarray]) -> np.ndarray:
        flat = np.stack(columns, 1).astype(">u8")
        return np.ascontiguousarray(flat).view(f"S{8 * len(columns)}").ravel()

    def number(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of word fingerprints, 0 for words of no item."""
        if not len(self.vocabulary):
            return np.zeros(len(h), np.uint64)
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == h, at + 1, 0).astype(np.uint64)

    def search(self, ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions and window numbers of all places; ``text`` numbers each word's document."""
        after = np.append(ids[1:], np.zeros(min(1, len(ids)), np.uint64))
        cand = np.zeros(len(ids), bool)
        known = np.flatnonzero((ids > 0) & (after > 0))
        if len(known) and len(self.twos):
            pair = (ids[known] << np.uint64(32)) | after[known]
            at = np.searchsorted(self.twos, pair)
            at[at == len(self.twos)] = 0
            cand[known] = self.twos[at] == pair
        if len(self.ones):
            cand |= np.isin(ids, self.ones)
        place = np.flatnonzero(cand)
        if not len(place):
            return place, place
        more = np.append(ids, np.zeros(self.window, np.uint64))
        columns = self.packed([more[place + k] for k in range(self.window)])
        order = np.lexsort(columns[::-1])
        array, keys = place[order], self.strings([c[order] for c in columns])  # the block's suffix array
        low, high = np.searchsorted(keys, self.low), np.searchsorted(keys, self.low, "right")
        high[self.short] = np.searchsorted(keys, self.short_high)
        hits = high - low
        which = np.repeat(np.arange(len(hits)), hits)
        spot = array[np.repeat(low - (np.cumsum(hits) - hits), hits) + np.arange(len(which))]
        end = spot + self.sizes[which] - 1
        inside = end < len(ids)
        inside[inside] = text[spot[inside]] == text[end[inside]]
        order = np.argsort(spot[inside], kind="stable")
        return spot[inside][order], which[inside][order]

    def summary(self, spot: np.ndarray, which: np.ndarray) -> tuple[list[tuple[int, int]], set[str], Match]:
        """Merged word spans, item names and the longest verbatim match of one document's places (of equals the first)."""
        spans: list[list[int]] = []
        names: set[int] = set()
        longest, runs, last = NONE, {}, None
        now: dict[tuple[int, int], int] = {}
        for p, k in zip(spot.tolist(), which.tolist(), strict=True):
            size = int(self.sizes[k])
            if spans and p <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], p + size)
            else:
                spans.append([p, p + size])
            if p != last:
                runs, now = (now if last is not None and p == last + 1 else {}), {}
                last = p
            a, b = self.border[k : k + 2].tolist()
            for place in zip(self.item[a:b].tolist(), self.offset[a:b].tolist(), strict=True):
                names.add(place[0])
                now[place] = runs.get((place[0], place[1] - 1), size - 1) + 1
                if now[place] > longest[0]:
                    begin = size - now[place]
                    longest = (now[place], p + begin, self.names[place[0]], self.begins[place[0]] + place[1] + begin)
        return [tuple(s) for s in spans], {self.names[k] for k in names}, longest


def scan(test: Windows, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, list, list, list[Match]]:
    """Word counts, merged spans, sorted item names and longest matches of texts laid end to end."""
    n = len(borders) - 1
    counts, spans, names, longest = np.zeros(n, np.int64), [[]] * n, [[]] * n, [NONE] * n
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(borders, borders[i] + BLOCK, "right")) - 1)
        part, inner = data[borders[i] : borders[j]], borders[i : j + 1] - borders[i]
        if j == i + 1:
            spot, which = [], []
            for _, _, _, h, before in sections(part, ALNUM, test.window, BLOCK):
                s, w = test.search(test.number(h), np.zeros(len(h), np.int64))
                spot.append(s + before)
                which.append(w)
                counts[i] = before + len(h)
            places = np.unique(np.stack([np.concatenate(spot), np.concatenate(which)]).astype(np.int64), axis=1)
            by = [(i, places[0], places[1])] if places.size else []
        else:  # a space between documents keeps their words apart
            start, _, h = words(np.insert(part, inner[1:-1], 32), ALNUM)
            text = np.searchsorted(inner[1:-1] + np.arange(len(inner) - 2), start, "right")
            counts[i:j] = np.bincount(text, minlength=j - i)
            spot, which = test.search(test.number(h), text)
            own = text[spot]
            edge = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            first = np.cumsum(counts[i:j]) - counts[i:j]
            by = [(i + own[a], spot[a:b] - first[own[a]], which[a:b]) for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(own)], strict=False)]
        for k, s, w in by:
            spans[k], found, longest[k] = test.summary(s, w)
            names[k] = sorted(found, key=str.encode)
        i = j
    return counts, spans, names, longest


def rounds(benchmark: DataFrame, id_column: str, text_column: str, window: int = WINDOW) -> Iterator[Windows]:
    """The items' windows, ROUND_WINDOWS at a time at the most; tasks cut the texts into words, and long items into parts."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            names, begins, parts = [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8) if len(text.as_buffer()) else np.zeros(0, np.uint8)
                h = words(data, ALNUM)[2]
                for k in range(0, max(1, len(h) - window + 1), ROUND_WINDOWS):
                    names.append(name)
                    begins.append(k)
                    parts.append(h[k : k + ROUND_WINDOWS + window - 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(begins, pa.int64()), pa.array(parts, pa.binary())], ["name", "begin", "words"])

    rows = benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("null")), text_of(text_column)).mapInArrow(read, "name string, begin long, words binary")
    held, size = [], 0
    for r in rows.toLocalIterator():
        h = np.frombuffer(bytes(r["words"]), np.uint64)
        if held and size + len(h) > ROUND_WINDOWS:
            yield Windows(held, window)
            held, size = [], 0
        held.append((r["name"], h, r["begin"]))
        size += len(h)
    yield Windows(held, window)


def _merged(rows: DataFrame) -> DataFrame:
    """``rows`` with the spans of their last column sorted and merged where they touch or overlap."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for found in batch.column(batch.num_columns - 1).to_pylist():
                spans: list[dict[str, int]] = []
                for x in sorted(found, key=lambda x: (x["start"], x["end"])):
                    if spans and x["start"] <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], x["end"])
                    else:
                        spans.append(x)
                out.append(spans)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, batch.schema.types[-1])], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


LONGEST = "struct<words: bigint, start: bigint, item: string, item_start: bigint>"


def _round(docs: DataFrame, index: object, kind: str, hits_only: bool) -> DataFrame:
    """One round's matches of (doc_id, text, key)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        match_type = pa.struct([("words", pa.int64()), ("start", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())])
        for batch in batches:
            counts, spans, names, longest = scan(index.value, *utf8(batch.column(1)))
            listed = [[{"start": a, "end": b} for a, b in x] for x in spans]
            best = [dict(zip(("words", "start", "item", "item_start"), x, strict=True)) for x in longest]
            columns = [batch.column(0), batch.column(2), pa.array(counts), pa.array(listed, span_type), pa.array(names, pa.list_(pa.string())), pa.array(best, match_type)]
            found = pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_words", "spans", "items", "longest"])
            yield found.filter(pa.array([bool(x) for x in spans], pa.bool_())) if hits_only else found

    return docs.mapInArrow(released(run), f"doc_id {kind}, key long, n_words long, spans array<struct<start: bigint, end: bigint>>, items array<string>, longest {LONGEST}")


def matches(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: id, key, n_words, spans of hit words, item ids found (strings, sorted) and the longest match: its words and where it starts in the document and in which item.

    Null and empty texts have no words and match nothing; an item without words matches nothing, one
    shorter than the window is a window by itself; items that repeat an id count once; repeated
    documents have a row each; documents beyond BLOCK bytes are searched in sections that overlap;
    of longest matches the first counts; of an item in parts, matches within a part; empty tables on
    either side give no rows or no matches; further columns are ignored. ``key`` tells documents that
    share an id apart. Later rounds write the documents that they hit only.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"), row_key(id_column, text_column).alias("key"))
    out = None
    found = rounds(benchmark, "item_id", "text", window)
    index, more = next(found), next(found, None)
    if more is None:
        return _round(source, spark.sparkContext.broadcast(index), kind, False)
    for number, part in enumerate(itertools.chain([index, more], found)):
        index = spark.sparkContext.broadcast(part)
        rows = written(_round(source, index, kind, number > 0), "matches").withColumn("first", F.lit(number == 0))
        index.destroy()
        out = rows if out is None else out.unionByName(rows)
    # repeated rows come as often as they occur and stay as many
    best = F.max_by("longest", F.struct("longest.words", -F.col("longest.start")))
    copies = out.groupBy("doc_id", "key").agg(F.count_if("first").cast("int").alias("copies"), F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), best.alias("longest"))
    each = _merged(copies.select("doc_id", "key", "copies", "n_words", "items", "longest", "spans"))
    return each.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", "key", "n_words", "spans", "items", "longest")


def clean(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without those in which a benchmark window occurs; rows and columns kept stay as they are.

    Documents without words, null ones too, stay; so do all where the benchmark has no words; of
    repeated rows all stay or go; an empty table stays empty; columns of any name are passed on. A
    benchmark of one round takes one pass; of more, each round's hits are written and then taken out.
    """
    spark, found = docs.sparkSession, rounds(benchmark, "item_id", "text", window)
    index, more = next(found), next(found, None)
    if more is None:
        held, at = spark.sparkContext.broadcast(index), docs.columns.index(text_column)

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                _, spans, _, _ = scan(held.value, *utf8(batch.column(at)))
                yield batch.filter(pa.array([not x for x in spans], pa.bool_()))

        return docs.mapInArrow(released(run), docs.schema)
    # the text's digest stands for the text: its rows stay or go alike
    digest = F.sha2(text_of(text_column), 256)
    source, hit = docs.select(digest.alias("doc_id"), text_of(text_column).alias("text"), F.lit(0).cast("long").alias("key")), None
    for part in itertools.chain([index, more], found):
        held = spark.sparkContext.broadcast(part)
        rows = written(_round(source, held, "string", True).select(F.col("doc_id").alias("__digest")).distinct(), "hits")
        held.destroy()
        hit = rows if hit is None else hit.unionByName(rows)
    kept = docs.select(boxed(docs), digest.alias("__digest")).join(hit.distinct(), "__digest", "left_anti")
    return kept.select(*unboxed(docs))
