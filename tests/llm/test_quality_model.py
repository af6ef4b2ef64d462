"""The quality model: word vectors against plain Python, held-out accuracy, edge cases."""

import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from planewright.llm import quality_model as q
from planewright.llm.queries import QUERIES
from planewright.llm.tokens import utf8
from tests.llm.test_operators import SCHEMA, bag, corpus


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@pytest.fixture(scope="module")
def scored(spark):
    return QUERIES["op13_quality_model"](spark, "/root/testdata/sf0.01").collect()


def test_held_out(scored):
    label = dict(duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    for r in scored:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    own = [r for r in scored if r["held_out"] and r["doc_id"] in label]
    y, p = np.array([label[r["doc_id"]] for r in own]), np.array([r["score"] for r in own])
    assert len(own) > 90 and auc(p, y) > 0.95 and np.mean((p >= 0.5) == y) > 0.93
    assert abs(p.mean() - y.mean()) < 0.06  # calibrated


def words(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\t-\r ]+", (text or "").encode())


def bucket(word):
    return int(q.buckets_of(np.frombuffer(word, np.uint8))[1][0])


def test_contexts_and_pools(spark, monkeypatch):
    rows = corpus()
    sums, times = q.context_sums(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want, count = np.zeros_like(sums), np.zeros_like(times)
    dims, signs = q.index_vectors()
    for _, text, *_ in rows:
        found = [bucket(w) for w in words(text)]
        for i, b in enumerate(found):
            count[b] += 1
            for far in (-2, -1, 1, 2):
                if 0 <= i + far < len(found):
                    np.add.at(want[b], (dims[found[i + far]] + far) % q.DIMENSIONS, signs[found[i + far]].astype(int))
    assert (times == count).all() and (sums == want).all()
    table = q.word_table(sums)
    texts = [t for _, t, *_ in rows]
    for block in (q.BLOCK, 64):
        monkeypatch.setattr(q, "BLOCK", block)
        got = q.pooled(table, *utf8(pa.array([t or "" for t in texts])))
        for x, t in zip(got, texts, strict=True):
            found = [bucket(w) for w in words(t)] if block > 64 or not t or max(map(len, t.split() or [""])) < 30 else None
            if found is not None:
                assert np.allclose(x[:-1], table[found].mean(0) if found else 0, atol=1e-4) and np.isclose(x[-1], np.log1p(len(found)))


def test_blocks_of_long_texts(spark, monkeypatch):
    """Neighbours across blocks count once."""
    rows = [(1, "a b " * 50 + "c"), (2, None), (3, "a b")]
    data, borders = utf8(pa.array([t or "" for _, t in rows]))
    monkeypatch.setattr(q, "BLOCK", 16)
    total, text, found = np.zeros(q.BUCKETS * q.DIMENSIONS, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for more, b in q.blocks(data, borders):
        known = min(q.REACH, len(found))
        text, found = np.concatenate([text[len(text) - known :], more]), np.concatenate([found[len(found) - known :], b])
        q.add_contexts(total, text, found, known)
    whole = np.zeros_like(total)
    monkeypatch.setattr(q, "BLOCK", 1 << 20)
    for more, b in q.blocks(data, borders):
        q.add_contexts(whole, more, b, 0)
    assert (total == whole).all() and total.any()


def test_temperature():
    r = np.random.default_rng(1)
    logits = r.normal(0, 2, 20000)
    y = (r.random(20000) < 1 / (1 + np.exp(-logits))).astype(float)
    assert abs(q.temperature_of(logits * 4, y) - 4) < 0.3 and abs(q.temperature_of(logits, y) - 1) < 0.1 and q.temperature_of(logits[:0], y[:0]) == 1.0


def test_edge_cases(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3).withColumnRenamed("key", "score")
    labels = spark.createDataFrame([(k, int(k % 2), 0) for k in range(20)] + [(3, None, 0), (None, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = q.score(docs, q.train(docs, labels)).collect()
    assert bag((r["doc_id"],) for r in got) == bag((r[0],) for r in corpus()) and all(0 <= r["score"] <= 1 for r in got)
    texts = {}
    for r in got:
        texts.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(texts[5]) == 1 and texts[0] == texts[1]  # equal rows, null and empty texts
    for few in (labels.filter("false"), labels.filter("quality = 1")):
        assert len({r["score"] for r in q.score(docs, q.train(docs, few)).collect()}) == 1
    assert q.score(docs.filter("false"), q.train(docs.filter("false"), labels)).collect() == []
