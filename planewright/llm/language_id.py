"""Languages of texts: script ranges narrow the candidates, Viterbi labels spans word by word.

A model of hashed byte n-grams is counted for each language on a bounded sample of labelled rows. A
word scores under the languages that use its script; the best labelling of a text's words under a
penalty for each change of language gives its spans, and the language with most letters is the
prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewright.llm.common import mix, sections, text_of, words
from planewright.llm.tokens import utf8

#: Labelled rows that training takes at most, shared evenly by the languages.
SAMPLE_ROWS = 20_000
BUCKETS = 1 << 16
#: Bytes in an n-gram, word borders included.
ORDERS = (2, 3, 4, 5)
#: Log-likelihood that a change of language costs.
SWITCH = 6.0
BLOCK = 1 << 20
#: A language uses a script that holds this share of its letters.
SCRIPT_SHARE = 0.01
#: Distinct words whose scores a worker keeps.
WORDS_KEPT = 1_000_000

#: First and last code points of scripts.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F),)),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF))),
    ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
)

_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = _LETTERS[128:] = True


def script_of(word: str) -> int:
    """Number of the script of a word's first letter in a known one, -1 if there is none, -2 without letters."""
    out = -2
    for c in word:
        if c.isalpha():
            out = -1
            for k, (_, ranges) in enumerate(SCRIPTS):
                if any(a <= ord(c) <= b for a, b in ranges):
                    return k
    return out


def ngrams(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and buckets of all n-grams of the words, each with a border before and after."""
    data = np.frombuffer(b"".join(b"\x01" + w + b"\x01" for w in found), np.uint8)
    sizes = np.array([len(w) + 2 for w in found], np.int64)
    owner, end = np.repeat(np.arange(len(found)), sizes), np.repeat(np.cumsum(sizes), sizes)
    out, value = [], np.zeros(len(data), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        value = value[: len(data) - n + 1] * np.uint64(257) + data[n - 1 :] if n > 1 else data.astype(np.uint64)
        if n in ORDERS:
            at = np.flatnonzero(np.arange(len(value)) + n <= end[: len(value)])
            out.append((owner[at], (mix(value[at] + np.uint64(n << 48)) % np.uint64(BUCKETS)).astype(np.int64)))
    return np.concatenate([o for o, _ in out]), np.concatenate([b for _, b in out])


class Model:
    """Log-probabilities of n-gram buckets and scripts of each language."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        total = counts.sum(1, keepdims=True)
        self.logp = np.log((counts + 0.5) / (total + 0.5 * BUCKETS)).T.astype(np.float32)  # buckets x languages
        share = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
        self.uses = (share >= SCRIPT_SHARE).T  # scripts x languages
        self.ids: dict[int, int] = {}
        self.scores = np.zeros((1 << 14, len(languages)), np.float32)
        self.letters = np.zeros(1 << 14, np.int32)

    def score(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and letter counts of words; a script that no language uses tells nothing."""
        owner, bucket = ngrams(found)
        out = np.zeros((len(found), len(self.languages)), np.float64)
        np.add.at(out, owner, self.logp[bucket])
        out -= out.max(1, keepdims=True)
        out /= len(ORDERS)
        letters = np.zeros(len(found), np.int32)
        for k, w in enumerate(found):
            text = w.decode("utf-8", "replace")
            letters[k] = sum(c.isalpha() for c in text) if not text.isalpha() else len(text)
            s = script_of(text)
            if s < 0 or not self.uses[s].any():
                out[k] = 0
            else:
                out[k, ~self.uses[s]] = -1000
        return out, letters

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Rows of the words in the score table, which grows by the words not seen yet."""
        one, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.ids) > WORDS_KEPT:
            self.ids.clear()
        got = [self.ids.get(x, -1) for x in one.tolist()]
        new = [k for k, x in enumerate(got) if x < 0]
        if new:
            raw = data.tobytes()
            scores, letters = self.score([raw[start[first[k]] : end[first[k]]] for k in new])
            base = len(self.ids)
            while base + len(new) > len(self.letters):
                self.scores, self.letters = np.concatenate([self.scores, np.zeros_like(self.scores)]), np.concatenate([self.letters, np.zeros_like(self.letters)])
            self.scores[base : base + len(new)], self.letters[base : base + len(new)] = scores, letters
            for i, k in enumerate(new):
                got[k] = self.ids[int(one[k])] = base + i
        return np.array(got, np.int64)[back]

    def texts(self, data: np.ndarray, borders: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Text numbers, and scores and letter counts of their words; copied before the next words may empty the table."""
        i, n = 0, len(borders) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(borders, borders[i] + BLOCK, "right")) - 1)
            part, inner = data[borders[i] : borders[j]], borders[i : j + 1] - borders[i]
            if j == i + 1 and len(part) > BLOCK:
                scores, letters = [self.scores[:0]], [self.letters[:0]]
                for own, start, end, h, _ in sections(part, _LETTERS, 1, BLOCK):
                    if len(h):
                        rows = self.numbers(own, start, end, h)
                        scores.append(self.scores[rows])
                        letters.append(self.letters[rows])
                yield i, np.concatenate(scores), np.concatenate(letters)
            else:
                apart = np.insert(part, inner[1:-1], 32)
                start, end, h = words(apart, _LETTERS)
                rows = self.numbers(apart, start, end, h) if len(h) else np.zeros(0, np.int64)
                cut = np.searchsorted(start, np.concatenate([inner[:1], inner[1:-1] + np.arange(1, len(inner) - 1), [len(apart) + 1]]))
                for k in range(j - i):
                    own = rows[cut[k] : cut[k + 1]]
                    yield i + k, self.scores[own], self.letters[own]
            i = j


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """The best label of every row of each score matrix, texts side by side."""
    if not scores:
        return []
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    steps, n = len(scores[order[0]]), len(scores)
    langs = scores[0].shape[1]
    alive = np.searchsorted(-np.array([len(scores[k]) for k in order]), -np.arange(steps), "left")  # texts longer than t
    laid = np.zeros((steps, n, langs), np.float32)
    for k, o in enumerate(order):
        laid[: len(scores[o]), k] = scores[o]
    came = np.zeros((steps, n), np.uint8)
    stay = np.zeros((steps, n, langs), bool)
    value = laid[0].astype(np.float64) if steps else np.zeros((n, langs))
    for t in range(1, steps):
        m = alive[t]
        v = value[:m]
        best = v.argmax(1)
        jump = v[np.arange(m), best] - switch
        came[t, :m] = best
        stay[t, :m] = v >= jump[:, None]
        value[:m] = np.maximum(v, jump[:, None]) + laid[t, :m]
    label = value.argmax(1)
    out = np.zeros((steps, n), np.uint8)
    for t in range(steps - 1, -1, -1):
        m = alive[t]
        out[t, :m] = label[:m]
        if t:
            label[:m] = np.where(stay[t, np.arange(m), label[:m]], label[:m], came[t, :m])
    result = [None] * n
    for k, o in enumerate(order):
        result[o] = out[: len(scores[o]), k]
    return result


# ------------------------------------------------------------------------------ Spark


def held_out(id_column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id is not held out, and not learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", most: int = SAMPLE_ROWS) -> Model:
    """Count n-grams of at most about ``most`` labelled rows that aren't held out, evenly by language.

    Rows are taken by the hash of their id, so that every part of the table has its share. What
    comes back to the driver is a table of languages by buckets.
    """
    rows = docs.filter(F.col(label_column).isNotNull() & F.col(text_column).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column))
    rows = rows.select(F.col(label_column).cast("string").alias("lang"), F.lower(text_column).alias("text"), F.pmod(F.xxhash64(F.lit("train"), F.col(id_column)), F.lit(1 << 20)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, len(SCRIPTS))))
    share = most / len(languages)
    chosen = F.lit(False)
    for name in languages:
        chosen = chosen | ((F.col("lang") == name) & (F.col("h") < int((1 << 20) * min(1.0, share / sizes[name]))))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts, scripts = np.zeros((len(languages), BUCKETS), np.int64), np.zeros((len(languages), len(SCRIPTS)), np.int64)
        number = {x: k for k, x in enumerate(languages)}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8) if len(text.as_buffer()) else np.zeros(0, np.uint8)
                start, end, h = words(data, _LETTERS)
                raw = data.tobytes()
                found = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                if found:
                    counts[number[lang]] += np.bincount(ngrams(found)[1], minlength=BUCKETS)
                    _, first, times = np.unique(h, return_index=True, return_counts=True)
                    for k, n in zip(first.tolist(), times.tolist(), strict=True):
                        if (s := script_of(found[k].decode("utf-8", "replace"))) >= 0:
                            scripts[number[lang], s] += n
        for table, shift in ((counts, 0), (scripts, BUCKETS)):
            k, b = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b + shift), pa.array(table[k, b])], ["k", "b", "n"])

    counts = np.zeros((len(languages), BUCKETS + len(SCRIPTS)))
    for r in rows.filter(chosen).select("lang", "text").mapInArrow(count, "k long, b long, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["k"], r["b"]] = r["n"]
    return Model(languages, counts[:, :BUCKETS], counts[:, BUCKETS:])


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", switch: float = SWITCH) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (share of letters in its spans) and spans (lang, first word, last word + 1).

    Null texts and texts without a letter are ``und`` with score 0, as are all if nothing was
    learned; of languages with as many letters the first in order is taken; very long texts are read
    in sections and labelled whole; repeated rows have a row each; an empty table gives no rows;
    further columns are ignored, labels too.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = held.value
        span_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            n = len(batch)
            pred, score, spans = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
            lot: list[tuple[int, np.ndarray, np.ndarray]] = []

            def label(lot: list, pred: list = pred, score: list = score, spans: list = spans) -> None:
                for (k, _, letters), names in zip(lot, viterbi([x[1] for x in lot], switch), strict=True):
                    weight = np.bincount(names, weights=letters, minlength=len(m.languages))
                    best = int(weight.argmax())
                    pred[k], score[k] = m.languages[best], float(weight[best] / weight.sum())
                    edge = np.flatnonzero(np.append(True, names[1:] != names[:-1])).tolist()
                    spans[k] = [{"lang": m.languages[names[a]], "start": a, "end": b} for a, b in zip(edge, [*edge[1:], len(names)], strict=True)]

            found = []
            for k, scores, letters in m.texts(*utf8(batch.column(2))) if m.languages else ():
                if letters.sum():
                    found.append((k, scores, letters))
            found.sort(key=lambda x: len(x[1]))
            size = 0
            for x in found:
                lot.append(x)
                size = len(x[1]) * len(lot)
                if size > 500_000:
                    label(lot)
                    lot = []
            label(lot)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred), pa.array(score, pa.float64()), pa.array(spans, span_type)], ["doc_id", "held_out", "lang_pred", "score", "spans"])

    source = docs.select(F.col(id_column).alias("doc_id"), held_out(id_column).alias("held_out"), F.lower(text_of(text_column)).alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, spans array<struct<lang: string, start: int, end: int>>")
