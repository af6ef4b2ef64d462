"""The registered text queries on the smallest tables, against plain Python or their SQL."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from planewright.llm import tokens
from planewright.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import bag, repeats_by_force

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.tokenizer_path())


def types(df):
    return dict(df.dtypes)


def test_secrets(spark, texts):
    df = QUERIES["op1_secret_scan"](spark, SF)
    assert types(df) == {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    rows = df.collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[1]) >= 6]
        found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = [x for _, _, x in sorted(found)]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for _, k, _ in found) for kind in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("random")] == base


def test_packing(spark, texts, library):
    df = QUERIES["op2_packing"](spark, SF)
    assert {k: v for k, v in types(df).items() if k != "doc_id"} == dict.fromkeys(["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "bigint")
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in df.collect():
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for found, whole in [(pieces[d], len(ids[d])) for d in ids] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(found):
            assert start == at and length > 0
            at += length
        assert at == whole if whole is not None else at <= 2048
    total = sum(map(len, ids.values()))
    assert total / (2048 * len(sequences)) > 0.95


def test_token_store(spark, texts, library):
    df = QUERIES["op4_token_store"](spark, SF)
    want, start = [], 0
    for d in sorted(texts):
        own = np.array([*library.encode(texts[d] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert bag(df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == bag(want)


def test_languages(spark, texts):
    df = QUERIES["op3_language_id"](spark, SF)
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    rows = df.collect()
    assert {r["doc_id"] for r in rows} == set(texts) and all(0 <= r["score"] <= 1 for r in rows)
    right = total = 0
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if not any(c.isalpha() for c in t):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and lang[r["doc_id"]]:
            total += 1
            right += r["lang_pred"] == lang[r["doc_id"]]
    assert total > 10 and right / total > 0.95


def test_repeats(spark, texts):
    got = QUERIES["op5_repeats"](spark, SF).collect()
    assert bag(got) == bag(repeats_by_force(list(texts.items())))


def test_quality(spark, texts):
    df = QUERIES["op6_quality_rules"](spark, SF)
    word, rows = re.compile(r"[^\x20\x09-\x0D]+"), df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        w = word.findall(t)
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = collections.Counter(three)
        covered = {i + k for i, x in enumerate(three) if often[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if word.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (failed and r["kept"])
    good = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    judged = [(good[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in good and not r["base_failed"]]
    assert np.mean([k for q, k in judged if q == 1]) > 0.85


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    found = con.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(df.columns)
    assert bag(df.select(*found.columns).collect()) == bag(found.fetchall())


def test_html(spark):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall())
    rows = QUERIES["op8_html_extract"](spark, SF).collect()
    assert {r["page_id"] for r in rows} == set(pages)
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and "<script" not in r["text"]
        assert not [line for line in r["text"].split("\n") if line != " ".join(line.split())]
    assert sum(r["n_chars"] > 0 for r in rows) > 0.9 * sum(bool(h) for h in pages.values())
