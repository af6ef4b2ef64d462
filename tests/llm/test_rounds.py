"""Decontamination with a benchmark of many rounds, and its longest matches, against plain Python."""

import re

import pytest

from planewright.llm import decontamination as d
from tests.llm.test_operators import SCHEMA, bag, corpus


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def benchmark():
    texts = [t for _, t, *_ in corpus() if t]
    long = words(texts[-9] if len(words(texts[-9])) > 40 else max(texts, key=len))
    return [("a", " ".join(words(max(texts, key=len))[100:260])), ("b", " ".join(long[5:30])), ("c", "two words"), ("d", None), ("e", " ".join(words(texts[3])[:40])), ("f", "nothing of this occurs anywhere in any of the texts here")]


def longest(w, items, window=10):
    """The longest run of words that a document and an item share, of those that hold a whole window."""
    best = 0
    for item in items:
        need = min(window, len(item))
        for i in range(len(w)):
            for j in range(len(item)):
                n = 0
                while i + n < len(w) and j + n < len(item) and w[i + n] == item[j + n]:
                    n += 1
                if need and n >= need:
                    best = max(best, n)
    return best


@pytest.mark.parametrize("limit", [d.ROUND_WINDOWS, 60, 12])
def test_rounds(spark, monkeypatch, limit):
    monkeypatch.setattr(d, "ROUND_WINDOWS", limit)
    rows, bench = corpus(), benchmark()
    docs, table = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(bench, "item_id string, text string").repartition(2)
    n_rounds = len(list(d.rounds(table, "item_id", "text")))
    assert (n_rounds == 1) == (limit == d.ROUND_WINDOWS and limit > 1000) and (limit > 12 or n_rounds > 3)
    got = d.matches(docs, table).collect()
    assert len(got) == len(rows)
    items = {name: words(text) for name, text in bench}
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(words(r[1]))
    clean = 0
    for r in got:
        w = next(x for x in by_id[r["doc_id"]] if len(x) == r["n_words"] and r["doc_id"] is not None) if r["doc_id"] is not None else None
        if w is None:
            continue
        found, hit = set(), set()
        for name, item in items.items():
            n = min(10, len(item))
            windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in windows:
                    found.add(name)
                    hit |= set(range(i, i + n))
        assert r["items"] == sorted(found) and {k for s in r["spans"] for k in range(s["start"], s["end"])} == hit
        best = r["longest"]
        if limit > 1000:
            assert best["words"] == longest(w, items.values())
        assert (best["words"] > 0) == bool(found)
        if best["words"]:
            assert w[best["start"] :][: best["words"]] == items[best["item"]][best["item_start"] :][: best["words"]]
        clean += not found
    left = d.clean(docs, table)
    assert left.columns == docs.columns
    kept = bag(left.collect())
    bad = {(r["doc_id"], r["n_words"]) for r in got if r["items"]}
    assert kept == bag(r for r in rows if (r[0], len(words(r[1]))) not in bad)
