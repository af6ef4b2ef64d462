"""Secrets in texts: three fixed patterns, and random strings told from identifiers by Markov models.

DataFrame functions only. Two character bigram models, one of random strings and one of ordinary
identifiers and words, are trained on labelled samples that a rule writes; every token of 20 or more
characters that no base span covers whole is judged, and is a secret where the mean log-likelihood
ratio of its bigrams exceeds a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planewright.llm.common import boxed, text_of, unboxed
from planewright.llm.quality_rules import literal_array

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: (kind, pattern, group whose length counts, least length)
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
#: Long tokens that the models judge; assignments stand first so that their values are passed over.
CANDIDATE = rf"(?:{ASSIGN})|[A-Za-z0-9+/_-]{{20,}}={{0,2}}"
RANDOM = "random"
#: Least mean log-likelihood ratio per character of a random string.
THRESHOLD = 0.6
#: Labelled samples of each class.
SAMPLES = 20_000
#: Positions are summed in blocks of so many matches.
BLOCK = 256

#: Parts of ordinary identifiers, file names and addresses.
PARTS = (
    "get set is has add remove delete update create find load save read write open close start stop init make build parse format render "
    "user name id key value item list map array index count size length type kind state status code error message result response request "
    "file path dir folder page view model data table row column field text string number date time year month day hour first last next "
    "previous current default max min total sum average config option settings param argument result output input source target client "
    "server host port address url link image video audio player game score level order product price cart payment account profile email "
    "phone city country language title content header footer body main test util helper handler manager service factory controller event "
    "the and of to in that it with for on are this from by at article news blog post comment archive category search about contact help "
    "keit heit lich schaft ung ein eine der die das und zeit jahr arbeit stadt gesell ver sch ment tion ation les des une dans pour avec sur que "
    "los las una para con por como ado ando mente ing ness able less ship hood ism ist ary ive ous ful er est un re"
).split()


def _pick(options: list[str] | str, *seed: object) -> str:
    """SQL for the option that a hash of the seed expressions names."""
    at = f"pmod(xxhash64({', '.join(map(str, seed))}), {len(options)})"
    if isinstance(options, str):
        return f"substr('{options}', cast({at} AS int) + 1, 1)"
    return f"split('{' '.join(options)}', ' ')[cast({at} AS int)]"


def labelled_samples(spark: SparkSession, n: int = SAMPLES, first: int = 0) -> DataFrame:
    """(random boolean, token string): ``n`` strings of each class, the same ones every time; others from another ``first``."""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = [digits + "abcdef", lower + digits, upper + digits, lower + upper + digits, lower + upper + digits + "+/", lower + upper + digits + "_-"]
    chosen = "CASE pmod(id, 6) " + " ".join(f"WHEN {i} THEN {_pick(a, 'id', 'j', 7)}" for i, a in enumerate(alphabets)) + " END"
    noise = spark.range(first, first + n).select(F.lit(True).alias("random"), F.expr(f"array_join(transform(sequence(1, 20 + cast(pmod(xxhash64(id, 3), 29) AS int)), j -> {chosen}), '')").alias("token"))
    joiners = "CASE pmod(id, 5) WHEN 0 THEN '_' WHEN 1 THEN '-' WHEN 2 THEN '/' ELSE '' END"
    cased = "CASE pmod(id, 5) WHEN 3 THEN initcap(p) WHEN 4 THEN p ELSE p END"
    number = "if(pmod(xxhash64(id, 5), 3) = 0, cast(pmod(xxhash64(id, 6), 10000) AS string), '')"
    plain = spark.range(first, first + n).select(F.lit(False).alias("random"), F.expr(f"concat(array_join(transform(transform(sequence(1, 4 + cast(pmod(xxhash64(id, 4), 4) AS int)), j -> {_pick(PARTS, 'id', 'j', 8)}), p -> {cased}), {joiners}), {number})").alias("token"))
    return noise.unionByName(plain)


def train(samples: DataFrame) -> list[float]:
    """log P(b | a, random) - log P(b | a, identifier) for the 128 x 128 pairs of ASCII characters."""
    codes = samples.select("random", F.expr("transform(split(token, ''), c -> ascii(c))").alias("c"))
    pairs = codes.select("random", F.explode(F.expr("transform(sequence(1, greatest(size(c) - 1, 1)), i -> c[i - 1] * 128 + coalesce(c[i], 0))")).alias("pair"))
    from math import log

    seen = {True: [0] * 128**2, False: [0] * 128**2}
    for r in pairs.filter("pair < 16384").groupBy("random", "pair").count().collect():
        seen[r["random"]][r.pair] = r["count"]
    out = []
    for a in range(128):
        rows = [seen[kind][a * 128 : a * 128 + 128] for kind in (True, False)]
        sums = [sum(x) for x in rows]
        out += [log((x + 0.5) / (sums[0] + 64)) - log((y + 0.5) / (sums[1] + 64)) for x, y in zip(*rows, strict=True)]
    return out


def _running(values: str, fold: str) -> str:
    """SQL: ``fold`` of the value before (``y``) and each value (``x``), kept for every place of an array of bigint.

    It goes block by block, so that a text with very many matches stays far from quadratic.
    """
    last = "element_at(element_at(a, -1), -1)"
    block = f"aggregate(slice(s, b * {BLOCK} + 1, {BLOCK}), array({last}), (r, x) -> array_append(r, transform(array(element_at(r, -1)), y -> {fold})[0]))"
    return f"transform(array({values}), s -> flatten(transform(slice(aggregate(sequence(0, cast((size(s) - 1) div {BLOCK} AS int)), array(array(0L)), (a, b) -> array_append(a, {block})), 2, cast(size(s) div {BLOCK} AS int) + 1), r -> slice(r, 2, size(r)))))[0]"


def _spans(hits: str, gaps: str) -> str:
    """SQL: structs (start, end, hit) from the matches and the texts between them."""
    ends = _running(f"transform({hits}, (h, i) -> cast(length(h) + length({gaps}[i]) AS bigint))", "x + y")
    return f"if(size({hits}) = 0, array(), transform(array({ends}), e -> transform({hits}, (h, i) -> struct(e[i] - length(h) AS start, e[i] AS end, h AS hit)))[0])"


def _kept(column: str, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """A kind's matches whose counted part is long enough, as spans."""

    def measure(hit: Column) -> Column:
        return F.length(F.regexp_extract(hit, pattern, group) if group else hit)

    kept = F.filter(column, lambda x: measure(x["hit"]) >= least)
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def with_secrets(docs: DataFrame, ratios: list[float], text_column: str = "text", into: str = "__secrets", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with an array of structs (start, rank, kind, end), in order of start and kind, in column ``into``.

    Positions are code points, ``end`` is exclusive; ``rank`` orders the kinds assign, access, hex,
    random. Null and empty texts have an empty array; very long texts and texts of very many secrets
    take time in proportion to their length (sums go block by block); spans that start together are
    ordered by kind; repeated rows are scanned alike; an empty table stays empty; other columns stay as they are (one named ``into`` is replaced).
    """
    held = docs.select(boxed(docs), text_of(text_column).alias("__t")).withColumn("__r", literal_array(ratios))
    found = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        if kind == "hex":  # a match is a whole run, so short runs can be left unmatched at once
            pattern = f"[0-9a-f]{{{least},}}"
        held = held.withColumn("__m", F.regexp_extract_all("__t", F.lit(pattern), F.lit(0)))
        held = held.withColumn("__g", F.when(F.size("__m") > 0, F.split("__t", pattern, -1)))
        held = held.withColumn(f"__x{rank}", F.expr(_spans("__m", "__g")))
        found.append(_kept(f"__x{rank}", rank, kind, pattern, group, least))
    held = held.withColumn("__m", F.regexp_extract_all("__t", F.lit(CANDIDATE), F.lit(0)))
    held = held.withColumn("__g", F.when(F.size("__m") > 0, F.split("__t", CANDIDATE, -1))).withColumn("__x3", F.expr(_spans("__m", "__g")))
    loose = F.filter("__x3", lambda x: ~x["hit"].rlike(ASSIGN) & ~x["hit"].rlike(r"^(AKIA[A-Z0-9]{16,}|[0-9a-f]{24,})$"))
    held = held.withColumn("__x3", F.transform(loose, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.transform(F.split(x["hit"], ""), lambda c: F.ascii(c)).alias("codes"))))
    score = "aggregate(sequence(1, size(x.codes) - 1), 0D, (a, i) -> a + __r[x.codes[i - 1] * 128 + x.codes[i]]) / (size(x.codes) - 1)"
    held = held.withColumn("__x3", F.expr(f"transform(filter(__x3, x -> {score} >= {threshold}), x -> struct(x.start AS start, 3 AS rank, '{RANDOM}' AS kind, x.end AS end))"))
    spans = F.array_sort(F.concat(*found, F.col("__x3")))
    return held.select(*unboxed(docs, into), spans.alias(into))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(docs: DataFrame, spans: str = "__secrets", text_column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each run of overlapping spans replaced by ``mark``; null texts stay null."""
    # a run starts at a span that starts where all before it have ended, and ends where those of the run do
    far = _running(f"transform({spans}, x -> cast(x.end AS bigint))", "greatest(x, y)")
    starts = f"filter(sequence(0, size({spans}) - 1), i -> i = 0 OR {spans}[i].start >= get(f, i - 1))"
    merged = f"transform(array({far}), f -> transform(array({starts}), n -> transform(n, (i, k) -> struct({spans}[i].start AS start, f[if(k + 1 < size(n), n[k + 1], size(f)) - 1] AS end)))[0])[0]"
    # characters once, then the stretches between the merged spans
    stretch = "array_join(slice(c, cast(coalesce(get(m, i - 1).end, 0L) AS int) + 1, cast(if(i < size(m), m[i].start, cast(size(c) AS bigint)) - coalesce(get(m, i - 1).end, 0L) AS int)), '')"
    built = f"transform(array(split(`{text_column}`, '')), c -> array_join(transform(array({merged}), m -> transform(sequence(0, size(m)), i -> {stretch}))[0], '{mark}'))[0]"
    return docs.withColumn(text_column, F.expr(f"if(size({spans}) > 0, {built}, `{text_column}`)"))
