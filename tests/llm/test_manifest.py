"""The dataset manifest against a tree built in plain Python."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from planewright.llm import merkle
from planewright.llm.queries import QUERIES
from tests.llm.test_operators import SCHEMA, bag, corpus

SF = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def proved(hashes):
    """The root of a list of leaves, and each leaf's path: per level the siblings to its left and right."""
    paths, owners = [[] for _ in hashes], [[k] for k in range(len(hashes))]
    while len(hashes) > 1:
        runs = [range(k, min(k + 3, len(hashes))) for k in range(0, len(hashes), 3)]
        for run in runs:
            for k in run:
                for o in owners[k]:
                    paths[o].append(([hashes[x] for x in run if x < k], [hashes[x] for x in run if x > k]))
        hashes, owners = [sha(*(hashes[k] for k in run)) for run in runs], [[o for k in run for o in owners[k]] for run in runs]
    return hashes[0], paths


def by_force(rows):
    """The contract's result for rows (doc_id, source, lang, n_chars, text)."""
    order = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((*order(row[0]), leaf(row), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(groups[s], key=lambda x: x[:3]) for s in names}
    tops = {s: proved([x[2] for x in trees[s]]) for s in names}
    root, upper = proved([tops[s][0] for s in names])
    out = []
    for s, above in zip(names, upper, strict=True):
        for (*_, own, row), path in zip(trees[s], tops[s][1], strict=True):
            path, h = path + above, own
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                h = leaf((*row[:4], row[4].replace("\n", "")))
            for left, right in path:
                h = sha(*left, h, *right)
            out.append((row[0], own, tops[s][0], root, sha(*(x for left, right in path for x in left + right)), h, h == root))
    return out


def result(manifest):
    found = merkle.proofs(manifest).withColumn("root", F.lit(manifest.root))
    folded = merkle.folded(F.coalesce("other", "hash"), F.col("path"))
    return found.select("doc_id", "hash", "subroot", "root", merkle.siblings(F.col("path")), folded, folded == F.col("root"))


def test_registered(spark):
    df = QUERIES["op11_merkle_manifest"](spark, SF)
    assert dict(df.dtypes) == {"doc_id": "bigint", "verified": "boolean"} | dict.fromkeys(["leaf", "subroot", "root", "proof_sha256", "folded_root"], "string")
    rows = duckdb.sql(f"SELECT doc_id, source, lang, n_chars, text FROM '{SF}/documents.parquet'").fetchall()
    got = df.collect()
    assert bag(got) == bag(by_force(rows))
    assert 0 < sum(not r["verified"] for r in got) < len(got)


def test_edge_cases(spark):
    rows = [r[:5] for r in corpus()]
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    want = by_force([(r[0], r[3], r[2], r[4], r[1]) for r in rows])
    assert bag(result(merkle.write_manifest(docs)).collect()) == bag(want)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_tiers(spark, depth):
    r = random.Random(depth)
    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 9, "f": 10, "g": 27, "h": 28, "i": 82, None: 31, "é": 8, "z": 243, "": 54}
    rows = [(k, s, None, 1, r.choice(["x\ny", "x", None, ""])) for s, n in sizes.items() for k in range(n)] + [(5, "b", None, 1, "x")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5).withColumn("i", F.lit(1)).withColumn("hash", F.lit("x"))
    assert bag(result(merkle.write_manifest(docs, depth)).collect()) == bag(by_force(rows))


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(3, None, None, None, "a\nb")], "doc_id long, source string, lang string, n_chars long, text string")
    assert bag(result(merkle.write_manifest(docs)).collect()) == bag(by_force([(3, None, None, None, "a\nb")]))
    manifest = merkle.write_manifest(docs.filter("false"))
    assert manifest.root is None and result(manifest).collect() == []
