"""Passages that occur more than once, by prefix-free parsing: 400 bytes or more, or 50 words or more.

Texts are parsed at triggers: positions whose rolling hash over ``trigger`` symbols is the smallest in
some passage, so that every passage holds a trigger and equal passages hold the same one. The phrase
around a trigger (all symbols that a passage with this trigger can reach) goes into a dictionary of
distinct phrases; the parse keeps where each phrase stands. A phrase that stands twice is repeated as
a whole. Phrases that only share their trigger are put in order twice, symbol by symbol: what stands
before the trigger, read backwards (the dictionary's suffixes), and what follows it (the parse from
there on). Both suffix arrays with their common-prefix lengths together give the corpus order of all
passages that hold the trigger, and equal neighbours in it are repeats. No hash decides here. Order
between passages of different triggers isn't needed and isn't made.

A group of too many phrases is first split by what its passages have in common, a sixth of the offsets
at a time; phrases alike in a whole part are settled there and then and one goes on for all, until
each part fits one task. Copies inside a batch of texts are settled before anything is shuffled, and
triggers with a large share of all rows are told apart through a broadcast of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewright.llm.common import SPACED, dropped, mix, prefix_hash, row_key, sections, span_hash, text_of, with_keys, words, written
from planewright.llm.tokens import utf8

#: Bytes of a passage and of a trigger.
PASSAGE, TRIGGER = 400, 200
#: Words of a passage and of a trigger.
PASSAGE_WORDS, TRIGGER_WORDS = 50, 8
BLOCK = 1 << 20
#: Phrases of one trigger that a task orders at once; with its two orders a phrase takes about 3 KB, so this is 100 MB.
GROUP = 32768
#: A group of more is parted by so many ranges of offsets: 201 offsets are down to single ones in three rounds.
WAYS = 6


def sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """op over every ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def trigger_hash(data: np.ndarray, width: int) -> np.ndarray:
    """A quick hash of every ``width`` consecutive symbols; where two share one, a group holds more than it must."""
    x = mix(data.astype(np.uint64) + np.uint64(1))
    out, done, have = np.zeros(len(data) - width + 1, np.uint64), 0, 1
    while have <= width:  # x holds the hashes of ``have`` symbols
        if width & have:
            out = mix(out + x[done : done + len(out)])
            done += have
        have *= 2
        if have <= width:
            x = x[: -(have // 2)] * np.uint64(0x9E3779B97F4A7C15) + x[have // 2 :]
            x ^= x >> np.uint64(29)
    return out | np.uint64(1)


def triggers(data: np.ndarray, borders: np.ndarray, first: int = 0, last: int | None = None, passage: int = PASSAGE, trigger: int = TRIGGER) -> tuple[np.ndarray, np.ndarray]:
    """Trigger positions and hashes in texts laid end to end.

    Only passages inside a text count, and of these those that start in [first, last).
    """
    n = len(data)
    width = passage - trigger + 1
    if n < passage:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = trigger_hash(data, trigger)
    low = sliding(np.minimum, h, width)  # the least hash of the passage at each position
    for b in borders[1:-1].tolist():
        low[max(0, b - passage + 1) : b] = 0
    low[:first] = 0
    if last is not None:
        low[last:] = 0
    edge = np.zeros(width - 1, np.uint64)
    chosen = sliding(np.maximum, np.concatenate([edge, low, edge]), width)
    at = np.flatnonzero(chosen == h)
    return at, h[at]


def parse(data: np.ndarray, borders: np.ndarray, passage: int = PASSAGE, trigger: int = TRIGGER) -> Iterator[tuple[np.ndarray, ...]]:
    """Per lot of texts: text numbers, trigger positions in their texts, hashes of triggers and phrases, and the phrases' places."""
    n, i = len(borders) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(borders, borders[i] + BLOCK, "right")) - 1)
        base, size = int(borders[i]), int(borders[j] - borders[i])
        if j > i + 1 or size <= 2 * BLOCK:
            inner = borders[i : j + 1] - base
            part = data[base : base + size]
            at, h = triggers(part, inner, passage=passage, trigger=trigger)
            text = np.searchsorted(inner, at, "right") - 1
            lo, hi = np.maximum(inner[text], at + trigger - passage), np.minimum(inner[text + 1], at + passage)
            own = inner[text]
            yield i + text, at - own, h, mix(span_hash(prefix_hash(part), lo, hi) + (at - lo).astype(np.uint64)), lo - own, hi - own
        else:  # one long text: stretches of passages, each with the symbols that their phrases reach
            before = np.zeros(0, np.int64)
            for begin in range(0, size, BLOCK):
                left, right = max(0, begin - passage), min(size, begin + BLOCK + 2 * passage)
                part = data[base + left : base + right]
                at, h = triggers(part, np.array([0, right - left]), begin - left, begin - left + BLOCK, passage, trigger)
                new = ~np.isin(at + left, before)  # a trigger of passages on both sides counts once
                before = at + left
                at, h = at[new], h[new]
                lo, hi = np.maximum(0, at + trigger - passage), np.minimum(right - left, at + passage)
                yield np.full(len(at), i), at + left, h, mix(span_hash(prefix_hash(part), lo, hi) + (at - lo).astype(np.uint64)), lo + left, hi + left
        i = j


def word_symbols(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of texts laid end to end (A-Z lower-cased), and the texts' borders in them."""
    n = len(borders) - 1
    out, counts, i = [np.zeros(0, np.uint64)], np.zeros(n, np.int64), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(borders, borders[i] + BLOCK, "right")) - 1)
        part, inner = data[borders[i] : borders[j]], borders[i : j + 1] - borders[i]
        if j == i + 1:
            found = [h for _, _, _, h, _ in sections(part, SPACED, 1, BLOCK)]
            out += found
            counts[i] = sum(map(len, found))
        else:
            start, _, h = words(np.insert(part, inner[1:-1], 32), SPACED)
            out.append(h)
            counts[i:j] = np.diff(np.searchsorted(start, np.concatenate([[0], inner[1:-1] + np.arange(len(inner) - 2), [len(part) + len(inner)]])))
        i = j
    return np.concatenate(out), np.concatenate([[0], np.cumsum(counts)])


def suffix_order(group: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within their groups, and how many symbols of ``width`` bytes each shares with the one before (-1 for a group's first)."""
    order = np.array(sorted(range(len(strings)), key=strings.__getitem__), np.int64)
    order = order[np.argsort(group[order], kind="stable")]
    sizes = np.array([len(s) for s in strings], np.int64)[order]
    most = max(width, int(sizes.max(initial=0)))
    table = np.frombuffer(b"".join(strings[k].ljust(most, b"\0") for k in order.tolist()), np.uint8 if width == 1 else np.uint64).reshape(len(strings), -1)
    common = np.full(len(strings), -1, np.int64)
    if len(strings) > 1:
        unlike = np.concatenate([table[1:] != table[:-1], np.ones((len(strings) - 1, 1), bool)], 1).argmax(1)
        same = group[order[1:]] == group[order[:-1]]
        common[1:] = np.where(same, np.minimum(unlike, np.minimum(sizes[1:], sizes[:-1]) // width), -1)
    return order, common


def repeated_windows(group: np.ndarray, phrases: list[bytes], left: np.ndarray, low: np.ndarray, high: np.ndarray, passage: int = PASSAGE, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each phrase the least and largest offset (symbols before the trigger) of its repeated passages; -1 if none.

    ``left`` has each phrase's symbols before its trigger, [low, high) the offsets to look at. Passages
    at one offset are equal where both suffix arrays put them in one class at the lengths on either side.
    """
    n = len(phrases)
    back = [p[:k] for p, k in zip(phrases, (left * width).tolist(), strict=True)]
    back = [b[::-1] for b in back] if width == 1 else [np.frombuffer(b, np.uint64)[::-1].tobytes() for b in back]
    ahead = [p[k:] for p, k in zip(phrases, (left * width).tolist(), strict=True)]
    room = np.array([len(a) // width for a in ahead], np.int64)
    (order_back, common_back), (order_ahead, common_ahead) = (suffix_order(group, x, width) for x in (back, ahead))
    first, last = np.maximum(low, passage - room), np.minimum(high, left + 1)  # offsets that the phrase has room for
    least, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    class_back, class_ahead = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for offset in range(int(first.min(initial=0)), int(last.max(initial=0))):
        fits = np.flatnonzero((first <= offset) & (offset < last))
        if len(fits) < 2:
            continue
        class_back[order_back] = np.cumsum(common_back < offset)
        class_ahead[order_ahead] = np.cumsum(common_ahead < passage - offset)
        name = class_back[fits] * (n + 1) + class_ahead[fits]
        order = np.argsort(name)
        same = name[order[1:]] == name[order[:-1]]
        twice = np.zeros(len(fits), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        hit = fits[twice]
        least[hit] = np.where(least[hit] < 0, offset, least[hit])
        most[hit] = offset
    return least, most


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each owner, overlapping ones made one."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    if not len(owner):
        return owner, start, end
    rank = np.cumsum(np.append(0, owner[1:] != owner[:-1]))  # lifts each owner's spans above those before
    lift = rank * (int(end.max()) + 1)
    far = np.maximum.accumulate(end + lift)
    new = np.append(True, start[1:] + lift[1:] > far[:-1])
    first = np.flatnonzero(new)
    return owner[first], start[first], (far - lift)[np.append(first[1:], len(owner)) - 1]


# ------------------------------------------------------------------------------ Spark


def _phrases(texts: DataFrame, passage: int, trigger: int, unit: str) -> DataFrame:
    """The phrases named by ``wanted`` (structs grp, pos) of each text."""
    width = 1 if unit == "bytes" else 8

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        for batch in batches:
            rows = []
            data, borders = utf8(batch.column(1))
            if unit == "words":
                data, borders = word_symbols(data, borders)
            for key, a, b, wanted in zip(batch.column(0).to_pylist(), borders[:-1].tolist(), borders[1:].tolist(), batch.column(2).to_pylist(), strict=True):
                own = data[a:b].tobytes()
                for x in wanted:
                    at = x["pos"]
                    lo = max(0, at + trigger - passage)
                    rows.append((x["grp"], key, at, at - lo, own[lo * width : (at + passage) * width]))
                if len(rows) > 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["grp", "key", "pos", "before", "phrase"])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["grp", "key", "pos", "before", "phrase"])

    return texts.mapInArrow(run, "grp long, key long, pos long, before int, phrase binary")


def _ordered(phrases: DataFrame, passage: int, width: int) -> DataFrame:
    """Marks (key, start, end) of the repeated passages in groups of phrases that fit a task."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def marks(table: pa.Table) -> pa.RecordBatch:
            grp, key, pos, before, low, high = (table.column(c).to_numpy() for c in ("grp", "key", "pos", "before", "low", "high"))
            least, most = repeated_windows(grp, table.column("phrase").to_pylist(), before.astype(np.int64), low.astype(np.int64), high.astype(np.int64), passage, width)
            ok = most >= 0
            return pa.RecordBatch.from_arrays([pa.array(key[ok]), pa.array((pos - most)[ok]), pa.array((pos - least + passage)[ok])], ["key", "start", "end"])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            grp = held.column("grp").to_numpy()
            whole = int(np.searchsorted(grp, grp[-1])) if len(grp) else 0  # sorted by group: the last one may go on
            if whole:
                yield marks(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and len(held):
            yield marks(held)

    dealt = phrases.repartition("grp").sortWithinPartitions("grp")
    return dealt.select("grp", "key", "pos", "before", "low", "high", "phrase").mapInArrow(run, "key long, start long, end long")


def _parted(phrases: DataFrame, passage: int, width: int) -> DataFrame:
    """Each phrase once for each of WAYS parts of its offsets, grouped anew by the symbols that all passages of the part share.

    ``whole`` is a 128-bit digest of all symbols that the phrase's passages of the part cover,
    [start, end) their place.
    """
    columns = ["grp", "key", "pos", "before", "low", "high", "phrase"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def name(data: bytes, *more: int) -> bytes:
            return hashlib.blake2b(data + repr(more).encode(), digest_size=16).digest()

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        for batch in batches:
            rows = []
            for grp, key, pos, before, low, high, phrase in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                step = -(-(high - low) // WAYS)
                for lo, hi in ((x, min(x + step, high)) for x in range(low, high, step)):
                    a, b = max(lo, passage - (len(phrase) // width - before)), min(hi, before + 1)  # offsets that the phrase has room for
                    if a < b:
                        core = name(phrase[(before - lo) * width : (before + passage - hi + 1) * width], grp, lo, hi)
                        whole = name(phrase[(before - b + 1) * width : (before - a + passage) * width], a, b)
                        rows.append((int.from_bytes(core[:8], "little", signed=True), key, pos, before, lo, hi, phrase, whole, pos - b + 1, pos - a + passage))
                if len(rows) > 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*columns, "whole", "start", "end"])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*columns, "whole", "start", "end"])

    return phrases.select(*columns).mapInArrow(run, "grp long, key long, pos long, before int, low int, high int, phrase binary, whole binary, start long, end long")


def repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", passage: int = PASSAGE, trigger: int = TRIGGER, unit: str = "bytes") -> DataFrame:
    """Marks (key, start, end): stretches of passages that start at more than one place of all texts.

    ``unit`` is "bytes" (of UTF-8) or "words" (between white space, A-Z lower-cased); ``passage``,
    ``trigger`` and positions count in it. ``key`` is the row key of id and text. Null, empty and
    short texts have no passage; long texts are parsed in stretches that overlap; repeated rows repeat
    each other; an empty table gives no marks; further columns are ignored.
    """
    width = 1 if unit == "bytes" else 8
    spark = docs.sparkSession
    tables: list[DataFrame] = []

    def kept(df: DataFrame, kind: str) -> DataFrame:
        tables.append(written(df, kind))
        return tables[-1]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["trigger", "phrase", "key", "pos", "start", "end"]
        for batch in batches:
            keys = batch.column(0).to_numpy()
            data, borders = utf8(batch.column(1))
            if unit == "words":
                data, borders = word_symbols(data, borders)
            lots = list(parse(data, borders, passage, trigger))
            if not lots:
                continue
            text, at, h, phrase, lo, hi = (np.concatenate(x) for x in zip(*lots, strict=True))
            # phrases that stand twice in this batch: marks for all places, one row for the rest of the work
            order = np.lexsort((at, text, phrase, h))
            new = np.append(True, (h[order[1:]] != h[order[:-1]]) | (phrase[order[1:]] != phrase[order[:-1]])) if len(order) else np.zeros(0, bool)
            one = order[new]
            size = np.diff(np.append(np.flatnonzero(new), len(order)))
            copies = order[np.repeat(size > 1, size)]
            owner, start, end = merged(text[copies], lo[copies], hi[copies])
            if len(one):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[one].view(np.int64), phrase[one].view(np.int64), keys[text[one]], at[one].astype(np.int64), lo[one].astype(np.int64), hi[one].astype(np.int64))], names)
            if len(owner):
                zero = np.zeros(len(owner), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (zero, zero, keys[owner], zero - 1, start.astype(np.int64), end.astype(np.int64))], names)

    source = docs.select(row_key(id_column, text_column).alias("key"), text_of(text_column).alias("text"))
    long = source.filter(F.octet_length("text") >= (passage if unit == "bytes" else 2 * passage - 1))
    parsed = kept(long.mapInArrow(run, "trigger long, phrase long, key long, pos long, start long, end long"), "parse")
    rows = parsed.filter("pos >= 0")
    total = parsed.count()
    common = kept(rows.groupBy("trigger").agg(F.count("*").alias("n")).filter("n > 1"), "common")
    shared = kept(with_keys(rows, common, "trigger", total), "shared")
    marks = kept(parsed.filter("pos < 0").select("key", "start", "end"), "marks")
    dropped(spark, *_folders(parsed, common))
    entries = kept(shared.groupBy("trigger", "phrase").agg(F.count("*").alias("copies"), F.min(F.struct("key", "pos")).alias("place")), "dictionary")
    whole = shared.join(entries.filter("copies > 1").select("trigger", "phrase"), ["trigger", "phrase"], "left_semi")
    marks = marks.unionByName(kept(whole.select("key", "start", "end"), "marks"))

    contested = kept(entries.groupBy("trigger").agg(F.count("*").alias("n")).filter("n > 1"), "contested")
    wanted = with_keys(entries, contested, "trigger", total).select(F.col("place.key").alias("key"), F.struct(F.col("trigger").alias("grp"), F.col("place.pos").alias("pos")).alias("x"))
    texts = source.join(wanted.groupBy("key").agg(F.collect_list("x").alias("wanted")), "key").dropDuplicates(["key"]).select("key", "text", "wanted")
    phrases = kept(_phrases(texts, passage, trigger, unit), "phrases").withColumns({"low": F.lit(0), "high": F.lit(passage - trigger + 1)})
    dropped(spark, *_folders(shared, entries, contested))
    while True:
        large = kept(phrases.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP), "large")
        if large.isEmpty():
            marks = marks.unionByName(kept(_ordered(phrases, passage, width), "marks"))
            break
        marks = marks.unionByName(kept(_ordered(with_keys(phrases, large, "grp", total, "left_anti"), passage, width), "marks"))
        parts = kept(_parted(with_keys(phrases, large, "grp", total), passage, width), "parts")
        # phrases alike in all passages of the part repeat each other in all of them, and one stands for them from here on
        alike = kept(parts.groupBy("grp", "whole").agg(F.count("*").alias("copies"), F.first(F.struct("key", "pos", "before", "low", "high", "phrase")).alias("one")), "alike")
        settled = parts.join(alike.filter("copies > 1").select("grp", "whole"), ["grp", "whole"], "left_semi")
        marks = marks.unionByName(kept(settled.select("key", "start", "end"), "marks"))
        open_ = kept(alike.groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1"), "open")
        phrases = with_keys(alike, open_, "grp", total).select("grp", "one.*")
    found = written(marks, "found")
    dropped(spark, *_folders(*tables))
    return found


def _folders(*tables: DataFrame) -> list[str]:
    return [files[0].rpartition("/")[0] for t in tables if (files := t.inputFiles())]


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", passage: int = PASSAGE, trigger: int = TRIGGER, passage_words: int = PASSAGE_WORDS, trigger_words: int = TRIGGER_WORDS) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeat_words and the kept bytes.

    Removed bytes are those of all marks of ``repeats``; spans are maximal runs. ``n_repeat_words``
    counts the words in passages of ``passage_words`` or more that start at another place too, however
    few bytes they have; nothing is removed for them. Null text is empty; repeated rows have a row
    each and repeat each other; a very long text is one row of the last join; further columns are ignored.
    """
    marks = repeats(docs, id_column, text_column, passage, trigger)
    passages = repeats(docs, id_column, text_column, passage_words, trigger_words, "words")
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def union(found: list[dict] | None) -> list[list[int]]:
            spans: list[list[int]] = []
            for a, b in sorted((x["start"], x["end"]) for x in found or ()):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            return spans

        for batch in batches:
            rows = []
            for doc, text, found in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = text.encode()
                spans = union([x for x in found or () if x["bytes"]])
                at, kept = 0, []
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                rows.append((doc, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), sum(b - a for a, b in union([x for x in found or () if not x["bytes"]])), rest))
            id_type = batch.column(0).type
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (id_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeat_words", "kept"]) if rows else batch.slice(0, 0)

    whole = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"), row_key(id_column, text_column).alias("key"))
    both = marks.withColumn("bytes", F.lit(True)).unionByName(passages.withColumn("bytes", F.lit(False)))
    listed = both.groupBy("key").agg(F.collect_set(F.struct("start", "end", "bytes")).alias("marks"))
    return whole.join(listed, "key", "left").select("doc_id", "text", "marks").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeat_words long, kept binary")
