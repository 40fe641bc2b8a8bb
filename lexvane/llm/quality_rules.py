"""Quality rules: counts of a text, then a hashed n-gram log-likelihood ratio between trusted and all documents."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexvane.llm.common import SPACES, broadcast_if_small, space_words, table

BUCKETS = 1 << 14
#: A weight of 1 nat is stored as so many units: sums of whole numbers don't depend on the order of rows.
SCALE = 1 << 16
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words in repeated 3-word windows
#: Counts that are added to a bucket's target count and to what its raw count lets expect: a bucket with little evidence weighs
#: next to nothing, so that rare words and languages that few trusted documents use don't tell against a document.
PRIOR = 30.0
#: The least mean log-likelihood ratio (nats an n-gram) of a kept document.
THRESHOLD = -0.05


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _gram(hashes: Column, h: Column, i: Column, second: bool, buckets: int) -> Column:
    """Bucket of the 1-word n-gram at i, or of the 2-word one that starts there (the last word pairs with the text's end)."""
    value = F.xxhash64(h, F.get(hashes, i + 1)) if second else h
    return value.bitwiseAND(F.lit(buckets - 1)).cast("int")


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _with_hashes(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    return docs.select(*keep, space_words(F.col(text).cast("string")).alias("_words")).select("*", _hashes(F.col("_words")).alias("_h"))


def fit_weights(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, max_broadcast: int = 1_000_000) -> list[int]:
    """Weight of each bucket (their number is a power of 2): SCALE times the log ratio of its shares among the trusted documents and among all, smoothed by PRIOR.

    trusted has the keys of the trusted documents (repeated keys count once, unknown and null keys not at all); both
    multinomials take every n-gram of every such document. The result has `buckets` whole numbers, whatever the corpus.
    Without trusted documents, or without words in them, all weights are 0.
    """
    ids = trusted.select(F.col(key).alias("_id")).filter("_id is not null").distinct().withColumn("_trusted", F.lit(1))
    marked = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(broadcast_if_small(ids, max_broadcast), F.col("_key") == F.col("_id"), "left")
    words = _with_hashes(marked, "_text", [F.coalesce("_trusted", F.lit(0)).alias("_t")])
    h = F.col("_h")
    gram = lambda second: F.transform(h, lambda x, i: _gram(h, x, i, second, buckets))
    grams = words.select("_t", F.explode_outer(F.concat(gram(False), gram(True))).alias("bucket")).filter("bucket is not null")  # outer: else Spark computes the arrays once more, to filter
    rows = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_t").alias("target"))
    return _weights({r["bucket"]: (r["raw"], r["target"]) for r in rows.collect()}, buckets)  # at most `buckets` rows


def _weights(counts: dict[int, tuple[int, int]], buckets: int) -> list[int]:
    all_raw, all_target = (sum(c[k] for c in counts.values()) for k in (0, 1))
    if not all_target:
        return [0] * buckets
    share = all_target / all_raw
    return [round(SCALE * log((t + PRIOR) / (r * share + PRIOR))) for r, t in (counts.get(b, (0, 0)) for b in range(buckets))]


def _repeated_places(order: Column) -> Column:
    """Sorted places of the windows that occur twice or more; order: all windows as sorted (hash, place)."""
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    found = F.transform(order, lambda a, i: F.when(same(a, F.get(order, i - 1)) | same(a, F.get(order, i + 1)), a["i"]))
    return F.sort_array(F.filter(found, lambda p: p.isNotNull()))


def judge(docs: DataFrame, weights: list[int], key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """A row for each row of docs: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    llr is the mean weight of the text's 1- and 2-word n-grams, in nats; 0 without words. kept: not base_failed and
    llr >= threshold. A null text is one without words. Windows are compared by 64-bit hashes of their words' 64-bit hashes.
    Repeated rows and keys each come back, judged alone; an empty table gives an empty one; a text of any length counts whole.
    keep: columns of docs to carry along before these; others are not read. No shuffle.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = [key] if keep is None else keep
    base = docs.select(*out, body.alias("_body"), space_words(body).alias("_words"))
    base = base.select(*out, "_body", F.size("_words").cast("long").alias("_n"), _hashes(F.col("_words")).alias("_h"), (F.length("_body") - F.length(_without(F.col("_body"), SYMBOLS))).cast("long").alias("_symbols"), F.length(_without(F.col("_body"), SPACES)).cast("long").alias("_chars"))
    base = base.withColumn("_lines", F.filter(F.split("_body", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != ""))
    h = F.col("_h")
    window = lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))
    whole = lambda array: F.slice(array, 1, F.greatest(F.size(h) - 2, F.lit(0)))
    base = base.withColumn("_windows", whole(F.transform(h, window)))
    base = base.withColumn("_sorted", F.sort_array("_windows"))
    again = F.size(F.filter("_sorted", lambda x, i: x == F.get(F.col("_sorted"), i + 1))) > 0  # most texts repeat no window, and need no places
    base = base.withColumn("_order", F.when(again, F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    base = base.withColumn("_places", _repeated_places(F.col("_order")))
    places = F.col("_places")
    covered = F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    repeated = F.coalesce(covered, F.lit(0))
    weight = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    n, buckets = F.col("_n"), len(weights)
    total = F.aggregate(F.transform(h, lambda x, i: F.get(weight, _gram(h, x, i, False, buckets)) + F.get(weight, _gram(h, x, i, True, buckets))), F.lit(0).cast("long"), lambda a, x: a + x)
    llr = F.when(n > 0, total / (2 * n * SCALE).cast("double")).otherwise(F.lit(0.0))
    rows = base.select(*out, n.alias("n_words"), F.col("_chars").alias("word_chars"), F.col("_symbols").alias("n_symbols"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), repeated.cast("long").alias("n_repeat_words"), llr.alias("llr"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    verdict = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr")
    # One row in, one row out: without this step a filter on the verdict would move below the arrays and compute them for each word.
    return rows.select(*out, F.explode(F.array(verdict)).alias("v")).select(*out, "v.*")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Keys of the documents that labels mark as of good quality and not as toxic."""
    return labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit_weights(docs, trusted_ids(table(spark, sf_dir, "labels"))))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents that the rules keep, with their own columns, whatever their names; repeated rows all stay or all go, and null and empty texts go."""
    weights = fit_weights(docs, trusted_ids(table(spark, sf_dir, "labels")))
    rows = docs.select("text", F.struct("*").alias("_row"))  # whole rows, so that no column name can clash
    return judge(rows, weights, keep=["_row"]).filter("kept").select("_row.*")
