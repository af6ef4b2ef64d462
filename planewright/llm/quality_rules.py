"""Rule counts and a hashed n-gram likelihood ratio for every document, in DataFrame functions only.

The model compares two multinomials over hashed word unigrams and bigrams: that of trusted documents
(a bounded sample of the ids labelled good) and that of the whole corpus. A document's score is the
mean log ratio of its n-grams; it is kept where the score reaches a fixed threshold that gives way a
little for short documents, whose means are noisier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewright.llm.common import boxed, text_of, unboxed

#: Buckets of hashed n-grams.
BUCKETS = 16_384
#: Prior strength: pseudo n-grams per bucket, spread as the corpus is.
PRIOR = 16.0
#: At most so many trusted documents (those with the smallest id hashes) form the target.
TRUSTED_MOST = 20_000
#: A document is kept from this mean log ratio on, less SLACK / sqrt(n-grams).
THRESHOLD, SLACK = -0.045, 0.4
MIN_WORDS, MOST_REPEATED = 50, 50

SPACES = r"[\\x20\\x09-\\x0D]+"
#: Packed windows hold a position in so many bits; longer documents take the wider form.
_POSITION_BITS = 22


def words_of(text: Column) -> Column:
    """Words between the six ASCII space characters."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _ngrams(words: str, buckets: int) -> Column:
    """Buckets of a word array's unigrams and bigrams."""
    return F.expr(
        f"concat(transform({words}, w -> pmod(xxhash64(w), {buckets})),"
        f" if(size({words}) > 1, transform(sequence(0, size({words}) - 2), i -> pmod(xxhash64({words}[i], {words}[i + 1]), {buckets})), array()))"
    )


def trusted_ids(labels: DataFrame, most: int = TRUSTED_MOST) -> DataFrame:
    """The ids labelled good with the smallest hashes, ``most`` at the highest."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def log_ratios(docs: DataFrame, labels: DataFrame, text_column: str = "text", buckets: int = BUCKETS, prior: float = PRIOR, most: int = TRUSTED_MOST) -> list[float]:
    """log(target / corpus) for each bucket; zeros if no document is trusted.

    All documents are counted; only ``buckets`` sums come back.
    """
    trusted = trusted_ids(labels, most).withColumn("__trusted", F.lit(1))
    rows = docs.select("doc_id", words_of(text_of(text_column)).alias("__w")).join(F.broadcast(trusted), "doc_id", "left")
    grams = rows.select("__trusted", F.explode(_ngrams("__w", buckets)).alias("b"))
    corpus, target = [0] * buckets, [0] * buckets
    for r in grams.groupBy("b").agg(F.count("*").alias("n"), F.count("__trusted").alias("t")).collect():
        corpus[r.b], target[r.b] = r.n, r.t
    n, t = sum(corpus), sum(target)
    if not t:
        return [0.0] * buckets
    from math import log

    share = [(c + 1) / (n + buckets) for c in corpus]
    weight = prior * buckets
    return [log((c + weight * p) / (t + weight)) - log(p) for c, p in zip(target, share, strict=True)]


def literal_array(values: list[float]) -> Column:
    """A constant array; parsed once when the plan is made."""
    return F.split(F.lit(",".join(f"{x:.6g}" for x in values)), ",").cast("array<double>")


def _repeated_words() -> Column:
    """Words in three-word windows found twice or more, from ``__w`` and the window hashes ``__h``."""
    bits, mask = _POSITION_BITS, (1 << _POSITION_BITS) - 1
    same = f"shiftright(s[%s], {bits}) = shiftright(s[%s], {bits}) AND __h[cast(s[%s] & {mask} AS int)] = __h[cast(s[%s] & {mask} AS int)]"
    before, after = same % ("k", "k - 1", "k", "k - 1"), same % ("k", "k + 1", "k", "k + 1")
    # each single-element array binds a name for the step above it
    packed = f"array(array_sort(transform(__h, (x, i) -> shiftleft(shiftright(x, {bits}), {bits}) | i)))"
    # different windows that share the packed bits may part equal ones: then the whole hashes are sorted
    mixed = f"exists(sequence(1, size(s) - 1), k -> shiftright(s[k], {bits}) = shiftright(s[k - 1], {bits}) AND __h[cast(s[k] & {mask} AS int)] <> __h[cast(s[k - 1] & {mask} AS int)])"
    flagged = f"transform({packed}, s -> if({mixed}, NULL, sort_array(transform(filter(sequence(0, size(s) - 1), k -> (k > 0 AND {before}) OR (k < size(s) - 1 AND {after})), k -> s[k] & {mask}))))[0]"
    wide_packed = "array(array_sort(transform(__h, (x, i) -> struct(x AS x, i AS i))))"
    wide = f"transform({wide_packed}, s -> sort_array(transform(filter(sequence(0, size(s) - 1), k -> (k > 0 AND s[k].x = s[k - 1].x) OR (k < size(s) - 1 AND s[k].x = s[k + 1].x)), k -> cast(s[k].i AS bigint))))[0]"
    spread = "aggregate(if(size(p) > 1, sequence(1, size(p) - 1), array()), 3L, (a, i) -> a + least(3L, p[i] - p[i - 1]))"
    return F.expr(
        "CASE WHEN size(__h) < 2 OR size(array_distinct(__h)) = size(__h) THEN 0L"
        f" ELSE transform(array(coalesce(if(size(__h) < {mask}, {flagged}, NULL), {wide})), p -> {spread})[0] END"
    )


def kept(docs: DataFrame, ratios: list[float], text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that fail; columns stay as they are."""
    judged = with_rules(docs, ratios, text_column)
    return judged.filter((F.col("__row") >= 0) & F.col("__rules.kept")).select(*(F.col(f"`{c}`") for c in docs.columns))


def with_rules(docs: DataFrame, ratios: list[float], text_column: str = "text", into: str = "__rules", buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with a struct of the rule counts, the score and the verdict in column ``into`` (and a row number, ``__row``).

    Null and empty texts have no words and fail; very long texts are counted whole (sorting their
    windows is the only step that isn't in proportion to their length); ties and repeated rows are judged alike, each by
    itself; an empty table stays empty; all other columns stay as they are (one named ``into`` is
    replaced).
    """
    held = docs.select(boxed(docs), text_of(text_column).alias("__t")).withColumn("__w", words_of(F.col("__t")))
    held = held.withColumn("__h", F.expr("if(size(__w) > 2, transform(sequence(0, size(__w) - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])), array())"))
    held = held.withColumn("__g", _ngrams("__w", buckets)).withColumn("__r", literal_array(ratios))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    held = held.withColumn("__l", lines)
    held = held.withColumn("__n", F.size("__w").cast("long")).withColumn("__p", _repeated_words())
    held = held.withColumn("__s", F.expr("if(size(__g) = 0, 0D, aggregate(__g, 0D, (a, b) -> a + __r[cast(b AS int)]) / size(__g))"))
    failed = (F.col("__n") < MIN_WORDS) | (100 * F.col("__p") > MOST_REPEATED * F.col("__n"))
    fits = F.col("__s") >= F.lit(THRESHOLD) - F.lit(SLACK) / F.sqrt(F.greatest(F.size("__g"), F.lit(1)))
    rules = F.struct(
        F.col("__n").alias("n_words"),
        F.length(F.translate("__t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.col("__p").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & fits).alias("kept"),
        F.col("__s").alias("score"),
    )
    # the row number keeps a filter on the verdict above this projection: pushed below, it would take a copy of all of it
    return held.select(*unboxed(docs, into, "__row"), rules.alias(into), F.monotonically_increasing_id().alias("__row"))
