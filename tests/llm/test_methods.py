"""What the models of the native operators decide, in plain Python; the pipeline's stages on awkward tables."""

import math
import re

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from planewright.llm import decontamination, minhash, packing, quality_rules, secret_scan
from planewright.llm.queries import QUERIES
from tests.llm.test_operators import SCHEMA, bag, corpus

SF = "/root/testdata/sf0.001"


def buckets(words):
    """Buckets of unigrams and bigrams: hashes of one word, and of the second with the first's as seed."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    one = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    two = [xxhash.xxh64_intdigest(w.encode(), h) for h, w in zip(one, words[1:], strict=False)]
    return [signed(h) % quality_rules.BUCKETS for h in one + two]


def test_quality_verdicts(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    good = {d for d, q in duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall() if q == 1}
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in texts.items()}
    grams = {d: buckets(w) for d, w in words.items()}
    corpus_, target = [0] * quality_rules.BUCKETS, [0] * quality_rules.BUCKETS
    for d, g in grams.items():
        for b in g:
            corpus_[b] += 1
            target[b] += d in good
    n, t, size = sum(corpus_), sum(target), quality_rules.BUCKETS
    share = [(c + 1) / (n + size) for c in corpus_]
    ratio = [float(f"{math.log((x + 16 * size * p) / (t + 16 * size)) - math.log(p):.6g}") for x, p in zip(target, share, strict=True)]
    rows, near = QUERIES["op6_quality_rules"](spark, SF).collect(), 0
    for r in rows:
        g = grams[r["doc_id"]]
        score = sum(ratio[b] for b in g) / len(g) if g else 0.0
        edge = score - (quality_rules.THRESHOLD - quality_rules.SLACK / math.sqrt(max(1, len(g))))
        assert r["score"] == pytest.approx(score, abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and edge >= 0) or abs(edge) < 1e-9
        near += not r["base_failed"] and not r["kept"]
    assert near > 0  # the ratio itself rejects some


def test_random_strings(spark):
    """Every token's ratio, from pairs counted here, decides the spans that the models add."""
    samples = secret_scan.labelled_samples(spark)
    seen = {True: {}, False: {}}
    for r in samples.collect():
        for a, b in zip(r["token"], r["token"][1:], strict=False):
            seen[r["random"]][a, b] = seen[r["random"]].get((a, b), 0) + 1
    total = {k: {} for k in seen}
    for k, pairs in seen.items():
        for (a, _), m in pairs.items():
            total[k][a] = total[k].get(a, 0) + m
    part = lambda k, a, b: math.log((seen[k].get((a, b), 0) + 0.5) / (total[k].get(a, 0) + 64))
    fresh = [r["token"] for r in secret_scan.labelled_samples(spark, 300, 500_000).collect()]
    texts = [" ".join(fresh[k : k + 7]) + ", end\n" for k in range(0, len(fresh), 7)] + ["token=" + fresh[0], "é " * 30 + fresh[1] + "== x", fresh[2] + "." + fresh[3], "a" * 40, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secret_scan.with_secrets(docs, secret_scan.train(samples)).collect()
    assign, count = re.compile(secret_scan.ASSIGN), 0
    for r in found:
        want = []
        for m in re.finditer(secret_scan.CANDIDATE.replace("(?:(?i)", "(?i:"), r["text"] or ""):
            hit = m[0]
            if assign.search(hit) or re.match(r"^(AKIA[A-Z0-9]{16,}|[0-9a-f]{24,})$", hit):
                continue
            mean = sum(part(True, a, b) - part(False, a, b) for a, b in zip(hit, hit[1:], strict=False)) / (len(hit) - 1)
            if mean >= secret_scan.THRESHOLD:
                want.append((m.start(), m.end()))
        got = [(x["start"], x["end"]) for x in r["__secrets"] if x["rank"] == 3]
        assert got == want
        count += len(got)
    assert count > 200


def awkward(spark):
    rows = [(*r[:5], f"k{k}", r[6], r[7]) for k, r in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:4])
def test_stages_on_awkward_rows(spark, name, stage):
    """Nulls in every column, repeated rows, ties, a long text, extra columns with operators' own names."""
    docs = awkward(spark)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    have, got = bag(docs.collect()), bag(out.collect())
    if name == "secret scan":  # all rows stay, and all columns but the text and its length
        assert bag((r[0], r[2], r[3], *r[5:]) for r in got) == bag((r[0], r[2], r[3], *r[5:]) for r in have)
        assert not any(re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r[1] or "") for r in got)
        assert all(r[4] == len(r[1]) for r in got if r[1] and "[SECRET]" in r[1])
    else:
        assert all(r in have for r in got)
    texts = [r[1] for r in got]
    if name == "quality rules":
        assert None not in texts and "one" not in texts
    if name == "near-duplicates":
        long = max((r[1] for r in have if r[1]), key=len)
        assert texts.count(long) == 1
    if name == "benchmark decontamination":
        assert bag(got) == have  # none of these texts holds a benchmark passage
    empty = stage(spark, docs.filter("false"), SF)
    assert empty.columns == docs.columns and empty.collect() == []


def test_packing_awkward_rows(spark):
    docs = awkward(spark)
    rows = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert rows.filter("start = 0").count() == docs.count() and rows.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= packing.CAPACITY
    assert corpus_pipeline.STAGES[4][1](spark, docs.filter("false"), SF).collect() == []


def test_operators_of_stages_agree(spark):
    """Stages call the operators: what these find is what goes."""
    docs = awkward(spark)
    bench = spark.createDataFrame([("x", corpus()[9][1])], "item_id string, text string")
    hit = {r["doc_id"] for r in decontamination.matches(docs, bench).filter("size(items) > 0").collect()}
    assert hit and {r["doc_id"] for r in decontamination.clean(docs, bench).collect()} == {r[0] for r in corpus()} - hit
    assert minhash.deduplicated(docs).count() <= docs.count()
