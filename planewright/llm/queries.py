"""The numbered text queries over whole tables, and DuckDB twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewright.llm import decontamination, html_extract, language_id, merkle, minhash, packing, quality_model, quality_rules, repeats, secret_scan, token_store, vector_codes, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: the fixed patterns' spans and those that the models add."""
    ratios = secret_scan.train(secret_scan.labelled_samples(spark))
    found = secret_scan.with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), ratios)
    base = F.filter("__secrets", lambda x: x["rank"] < 3)
    count = lambda k: F.size(F.filter("__secrets", lambda x: x["rank"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("__secrets")).alias("spans"))


@register
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"))


@register
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from the labelled ones that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs)).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


@register
def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as id shards and read back by key."""
    return token_store.read_store(spark, token_store.write_store(table(spark, sf_dir, "documents")))


@register
def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages of 400 bytes that start at more than one place."""
    return repeats.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


@register
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and the verdict of the likelihood ratio for all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = quality_rules.log_ratios(docs, table(spark, sf_dir, "labels"))
    return quality_rules.with_rules(docs, ratios).select("doc_id", "__rules.*")


@register
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in benchmark passages."""
    found = decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), F.col("longest.words").alias("n_longest"))


@register
def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


@register
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of 0.8 or more on shingles of four words."""
    found = minhash.groups(table(spark, sf_dir, "documents"), shingle=4)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@register
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    pages = warc.read_archives(spark, warc.write_archives(table(spark, sf_dir, "pages")))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a manifest, each proved against its root, some after tampering."""
    manifest = merkle.write_manifest(table(spark, sf_dir, "documents"))
    leaf, root = F.coalesce("other", "hash"), F.lit(manifest.root)
    found = merkle.proofs(manifest).select("doc_id", F.col("hash").alias("leaf"), "subroot", root.alias("root"), merkle.siblings(F.col("path")).alias("proof_sha256"), merkle.folded(leaf, F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


@register
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors by two rounds of Lloyd's method with heaps."""
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    found = vector_codes.with_label_errors(coded)
    return found.select(F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


@register
def op13_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op7_decontamination"] = rf"""
WITH item AS (SELECT row_number() OVER () AS k, CAST(item_id AS VARCHAR) AS name, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
asked AS (SELECT k, i AS pos, coalesce(name, 'null') AS name, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
          FROM (SELECT k, name, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
place AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM asked) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, n, name, k AS item, pos FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM place) JOIN asked USING (n, gram)),
word AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS items FROM (SELECT DISTINCT doc_id, name FROM hit) GROUP BY doc_id),
run AS (SELECT doc_id, count(*) + n - 1 AS words FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, n, i - pos ORDER BY i) AS start FROM hit) GROUP BY doc_id, item, n, i - pos, start),
best AS (SELECT doc_id, max(words) AS n_longest FROM run GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_longest, 0) AS n_longest
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
"""

ORACLES["op9_near_duplicates"] = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(w) - 3) + 1), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM doc),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_id AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept FROM sets LEFT JOIN least_id ON doc_id = a
"""

ORACLES["op10_warc"] = """
WITH page AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
top AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS t FROM page)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN t = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN t <> page_id THEN t END AS refers_to FROM top
"""


def _crc_table() -> list[int]:
    """The CRC-32 of every byte, from the polynomial 0xEDB88320."""
    out = list(range(256))
    for _ in range(8):
        out = [(x >> 1) ^ (0xEDB88320 if x & 1 else 0) for x in out]
    return out


def _framed(text: str) -> str:
    values = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


_LEVELS = """{name} AS (
  SELECT tree, 0 AS level, i, h FROM {base} UNION ALL
  SELECT tree, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}) WHERE n > 1 GROUP BY tree, level, i // 3),
{name}_top AS (SELECT tree, arg_max(h, level) AS h, max(level) AS height FROM {name} WHERE i = 0 GROUP BY tree),
{name}_run AS (SELECT l.tree, level, i // 3 AS p, list(l.h ORDER BY i) AS run FROM {name} l JOIN {name}_top t ON l.tree IS NOT DISTINCT FROM t.tree WHERE level < height GROUP BY l.tree, level, i // 3)"""
_WALK = """{name} AS (
  SELECT id, tree, 0 AS level, i, proof, f FROM {base} UNION ALL
  SELECT id, w.tree, w.level + 1, i // 3, proof || array_to_string(run[1 : i % 3], '') || array_to_string(run[i % 3 + 2 :], ''), sha256(array_to_string(run[1 : i % 3], '') || f || array_to_string(run[i % 3 + 2 :], ''))
  FROM {name} w JOIN {runs} r ON w.tree IS NOT DISTINCT FROM r.tree AND w.level = r.level AND w.i // 3 = r.p),
{name}_end AS (SELECT id, arg_max(proof, level) AS proof, arg_max(f, level) AS f FROM {name} GROUP BY id)"""

ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE doc AS (SELECT doc_id, source, {_framed("text")} AS h,
  CASE WHEN (list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, {_crc_table()}[1 + (xor(c, x) & 255)])) & 1) = 1
       THEN {_framed("replace(text, chr(10), '')")} END AS other FROM documents),
leaf AS (SELECT row_number() OVER () AS id, doc_id, source AS tree, h, coalesce(other, h) AS f, '' AS proof, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM doc),
{_LEVELS.format(name="lower_tree", base="leaf")},
subroot AS (SELECT '' AS tree, tree AS source, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i FROM lower_tree_top),
{_LEVELS.format(name="upper_tree", base="subroot")},
{_WALK.format(name="low", base="leaf", runs="lower_tree_run")},
middle AS (SELECT e.id, '' AS tree, s.i, e.proof, e.f FROM low_end e JOIN leaf l USING (id) JOIN subroot s ON l.tree IS NOT DISTINCT FROM s.source),
{_WALK.format(name="high", base="middle", runs="upper_tree_run")}
SELECT doc_id, l.h AS leaf, s.h AS subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.f AS folded_root, e.f = t.h AS verified
FROM leaf l JOIN high_end e USING (id) JOIN subroot s ON l.tree IS NOT DISTINCT FROM s.source, upper_tree_top t
"""

_CODED = """near{k} AS MATERIALIZED (SELECT vec_id, label, p, v, min(d * 64 + e) AS m FROM (
    SELECT x.vec_id, x.label, x.p, x.v, e, CAST(list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, b.v) + list_dot_product(b.v, b.v) AS BIGINT) AS d FROM part x JOIN book{k} b USING (p)) GROUP BY ALL)"""
_MOVED = """mean{n} AS (SELECT p, e, list(x ORDER BY j) AS v FROM (
    SELECT p, m % 64 AS e, j, floor(sum(v[j]) / count(*)) AS x FROM near{k}, range(1, (SELECT max(len(v)) FROM part) + 1) AS r(j) GROUP BY p, m % 64, j) GROUP BY p, e),
book{n} AS MATERIALIZED (SELECT p, e, coalesce(mean{n}.v, book{k}.v) AS v FROM book{k} LEFT JOIN mean{n} USING (p, e))"""

ORACLES["op12_vector_codes"] = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT vec_id, label, p, q[p * (len(q) // 16) + 1 : (p + 1) * (len(q) // 16)] AS v FROM kept, range(16) AS r(p)),
book0 AS MATERIALIZED (SELECT p, e, v FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 64) USING (vec_id)),
{_CODED.format(k=0)}, {_MOVED.format(k=0, n=1)}, {_CODED.format(k=1)}, {_MOVED.format(k=1, n=2)}, {_CODED.format(k=2)},
done AS (SELECT vec_id, label, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM near2 GROUP BY vec_id, label),
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS d FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, d AS codebooks_sha256 FROM done, digest
"""
