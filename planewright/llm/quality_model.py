"""Quality scores of documents: random-indexing word vectors, pooled, through a small network.

Every bucket of hashed words has a sparse random index vector. One pass over all documents adds up,
for each bucket, the index vectors of its neighbours, turned by their distance; these sums, scaled
to length one, are the word vectors. A document is the mean of its words' vectors and of their index
vectors, with its length. A network of two layers, trained with numpy on a bounded sample of
labelled rows, gives a logit, and a temperature fitted on rows apart makes it a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewright.llm.common import mix, prefix_hash, span_hash, text_of
from planewright.llm.tokens import utf8

#: Buckets of words, dimensions of their vectors, entries of an index vector that aren't zero, and neighbours to each side.
BUCKETS, DIMENSIONS, NONZERO, REACH = 8192, 64, 4, 2
#: Labelled rows that training takes at most (those with the smallest id hashes).
SAMPLE_ROWS = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 120, 0.01, 1e-4
#: Of the sampled rows, one in APART fits the temperature instead of the weights.
APART = 5
#: Bytes of text that array work takes at once.
BLOCK = 1 << 18

_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and signs of every bucket's index vector."""
    h = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(0x7A11)).reshape(BUCKETS, NONZERO)
    return (h % np.uint64(DIMENSIONS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def buckets_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and buckets of the words of bytes: runs of letters and digits, and runs of other marks, case kept."""
    kind = _KIND[data]
    edge = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]])) if len(data) else np.zeros(1, np.int64)
    start, end = edge[:-1], edge[1:]
    inside = kind[start] > 0
    start, end = start[inside], end[inside]
    return start, (span_hash(prefix_hash(data), start, end) % np.uint64(BUCKETS)).astype(np.int64)


def blocks(data: np.ndarray, borders: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text numbers and buckets of all words of texts, in blocks; a word longer than a block is read in pieces."""
    n, i = len(borders) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(borders, borders[i] + BLOCK, "right")) - 1)
        part, inner = data[borders[i] : borders[j]], borders[i : j + 1] - borders[i]
        if j == i + 1:
            at = 0
            while at < len(part):
                end = min(len(part), at + BLOCK)
                if end < len(part):
                    gap = np.flatnonzero(_KIND[part[at:end]] == 0)
                    end = at + int(gap[-1]) + 1 if len(gap) else end
                _, found = buckets_of(part[at:end])
                yield np.full(len(found), i), found
                at = end
        else:
            start, found = buckets_of(np.insert(part, inner[1:-1], 32))
            yield i + np.searchsorted(inner[1:-1] + np.arange(len(inner) - 2), start, "right"), found
        i = j


def add_contexts(total: np.ndarray, text: np.ndarray, bucket: np.ndarray, known: int) -> None:
    """Add the index vectors of neighbours to ``total`` (flat); of the pairs within the first ``known`` words none is added again."""
    dims, signs = index_vectors()
    for far in range(1, REACH + 1):
        first = np.flatnonzero(text[far:] == text[:-far])
        first = first[first + far >= known]
        for own, other, turn in ((first, first + far, far), (first + far, first, -far)):
            flat = bucket[own][:, None] * DIMENSIONS + (dims[bucket[other]] + turn) % DIMENSIONS
            total += np.bincount(flat.ravel(), weights=signs[bucket[other]].ravel(), minlength=len(total)).astype(np.int64)


def context_sums(docs: DataFrame, text_column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Context sums and counts of every bucket over all texts; one table of a fixed size leaves a task."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, times = np.zeros(BUCKETS * DIMENSIONS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            text, bucket = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for more, found in blocks(*utf8(batch.column(0))):
                times += np.bincount(found, minlength=BUCKETS)
                known = min(REACH, len(bucket))
                text, bucket = np.concatenate([text[len(text) - known :], more]), np.concatenate([bucket[len(bucket) - known :], found])
                add_contexts(total, text, bucket, known)
        kept = np.flatnonzero(times)
        rows = np.column_stack([times[kept], total.reshape(BUCKETS, DIMENSIONS)[kept]])
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(list(rows), pa.list_(pa.int64()))], ["bucket", "sums"])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((BUCKETS, DIMENSIONS + 1), np.int64)
        for batch in batches:
            np.add.at(total, batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(len(batch), -1))
        kept = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(list(total[kept]), pa.list_(pa.int64()))], ["bucket", "sums"])

    schema = "bucket long, sums array<long>"
    total = np.zeros((BUCKETS, DIMENSIONS + 1), np.int64)
    for r in docs.select(text_of(text_column).alias("text")).mapInArrow(count, schema).repartition("bucket").mapInArrow(add, schema).toLocalIterator():
        total[r["bucket"]] += np.array(r["sums"])
    return total[:, 1:], total[:, 0]


def word_table(sums: np.ndarray) -> np.ndarray:
    """Word vectors of length one beside index vectors of length one, for every bucket."""
    dims, signs = index_vectors()
    own = np.zeros((BUCKETS, DIMENSIONS))
    np.add.at(own, (np.repeat(np.arange(BUCKETS), NONZERO), dims.ravel()), signs.ravel())
    unit = lambda x: x / np.maximum(1e-9, np.sqrt(np.square(x).sum(1, keepdims=True)))
    return np.concatenate([unit(sums.astype(np.float64)), unit(own)], axis=1).astype(np.float32)


def pooled(table: np.ndarray, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """A row for each text: the mean of its words' rows of ``table``, and the logarithm of their number; zeros without words."""
    out, n = np.zeros((len(borders) - 1, table.shape[1] + 1)), np.zeros(len(borders) - 1)
    for text, bucket in blocks(data, borders):
        if len(text):
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            out[text[first], :-1] += np.add.reduceat(table[bucket], first, axis=0)
            n[text[first]] += np.diff(np.append(first, len(text)))
    out[:, :-1] /= np.maximum(n, 1)[:, None]
    out[:, -1] = np.log1p(n)
    return out


@dataclass
class Network:
    """Standardised input, a hidden layer, a logit, and its temperature; without weights, one probability for all."""

    centre: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray] | None
    temperature: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def loss(logits: np.ndarray, y: np.ndarray) -> float:
    """Mean negative log-likelihood of labels."""
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def temperature_of(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature in 1/20 .. 20 under which labels are likeliest, by golden sections of its logarithm."""
    if not len(y):
        return 1.0
    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        if loss(logits / np.exp(c), y) <= loss(logits / np.exp(d), y):
            b = d
        else:
            a = c
    return float(np.exp((a + b) / 2))


def fit(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> Network:
    """Train the layers on the rows not ``apart`` (Adam on batches, seeded), then the temperature on those."""
    prior = float((y.sum() + 1) / (len(y) + 2))
    own, label = x[~apart], y[~apart]
    if not len(label) or label.min() == label.max():
        return Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), None, 1.0, prior)
    centre, scale = own.mean(0), own.std(0) + 1e-6
    r = np.random.default_rng(13)
    w = [r.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    net = Network(centre, scale, w, 1.0, prior)
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    own = (own - centre) / scale
    for epoch in range(EPOCHS):
        order = r.permutation(len(own))
        for lot in np.array_split(order, max(1, len(own) // 256)):
            a, t = own[lot], label[lot]
            h = np.tanh(a @ w[0] + w[1])
            z = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -500, 500))) - t) / len(lot)
            back = np.outer(z, w[2]) * (1 - h * h)
            grads = [a.T @ back + DECAY * w[0], back.sum(0), h.T @ z + DECAY * w[2], z.sum()]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.temperature = temperature_of(net.logits(x[apart]), y[apart])
    return net


# ------------------------------------------------------------------------------ Spark


def held_out(id_column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id is not held out, and not learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    table: np.ndarray
    network: Network


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", most: int = SAMPLE_ROWS) -> Model:
    """Word vectors from all texts of ``docs``; the network from at most ``most`` labelled rows that aren't held out.

    An id with several labels counts with their mean, rounded up; null ids and labels don't count.
    """
    table = word_table(context_sums(docs, text_column)[0])
    given = labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & ~held_out(id_column))
    given = given.groupBy(F.col(id_column).alias("id")).agg((F.avg(label_column) >= 0.5).cast("double").alias("label"))
    chosen = given.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(most)
    held = docs.sparkSession.sparkContext.broadcast(table)

    def pool(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = pooled(held.value, *utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], ["id", "label", "x"])

    kind = docs.schema[id_column].dataType.simpleString()
    own = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "label")
    # rows that share a labelled id count once, as the least of their vectors
    found = own.mapInArrow(pool, f"id {kind}, label double, x array<float>").groupBy("id").agg(F.min(F.struct("x", "label")).alias("r")).orderBy("id").collect()
    x = np.array([r["r"]["x"] for r in found], np.float64).reshape(len(found), table.shape[1] + 1)
    y = np.array([r["r"]["label"] for r in found])
    apart = np.arange(len(found)) % APART == 0
    return Model(table, fit(x, y, apart))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document doc_id, held_out, score (the probability of label 1) and predicted.

    Null and empty texts are scored as documents of no words; very long texts are read whole, in
    blocks; repeated rows have a row each; an empty table gives no rows; further columns are
    ignored. With no labels, or of one value only, every document has the same score.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = held.value
        for batch in batches:
            p = m.network.score(pooled(m.table, *utf8(batch.column(2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_column).alias("doc_id"), held_out(id_column).alias("held_out"), text_of(text_column).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
