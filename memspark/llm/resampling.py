"""Target-distribution importance resampling over position-table n-grams.

Texts become a position table: posexplode gives each word a row with its place, lead() over a
document's places sets the following words beside it, and so the features of every order (runs of
1 to `order` words) are made of columns. Features are hashed into buckets; the counts of the
documents (s in a bucket, S in all) and of the target (t, T) give each bucket a gain,
floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))). A document's weight is the floored mean of the
gains joined to its features, its score the weight plus Gumbel noise that its id fixes: the
highest scores are a sample without replacement in proportion to exp(weight / 1000).

For order 1 nothing follows a word, so the table is aggregated where it is made and no position
is shuffled. For higher orders equal rows are made one first (with their number), which puts each
document's places into one partition before they are exploded: the window needs no shuffle of its own.

Scores are whole numbers within some 10^5 of each other, so that counts by score are a small table
however many documents there are. It tells which scores are drawn; only those rows are ranked,
score by score.

Cases: null text has no words and weight 0; null ids have the noise of the empty id and come last in ties; equal
rows score equally and have ranks of their own; an empty table or target is counted as nothing
(a gain is then that of its smoothing alone); further columns are kept, names that clash with the
new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, prepare

ORDER = 1
BUCKETS = 10_000
PERCENT = 10
MIN_WORDS = 20
SEED = 2024
#: Everything but digits, lower-case ASCII letters and what is not ASCII parts words; capitals are lowered before.
_PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NEW = ("n_features", "weight", "score", "rank")


def split_words(text: Column) -> Column:
    """The words between runs of other characters; the first and the last may be empty strings."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _CAPITALS, _CAPITALS.lower())).otherwise(F.lower(text))
    return F.split(lowered, _PARTS)


def key_columns(doc_id: Column, text: Column) -> list[Column]:
    """What tells documents apart: the id and 96 bits of the text."""
    return [doc_id.cast("long").alias("_id"), F.xxhash64(text).alias("_k1"), F.crc32(text).alias("_k2")]


KEY = ("_id", "_k1", "_k2")


def positions(rows: DataFrame, order: int = ORDER, keyed: bool = True) -> DataFrame:
    """(key, copies, first, pos, w1 .. w<order>): the position table; a row for each word and those that follow it.

    rows: text, and doc_id if the rows are keyed by it. copies: the number of equal rows that a row stands for. first: 1 on one
    row of each row of the table that stands for itself alone, else 0.
    """
    doc_id = F.col("doc_id") if keyed else F.lit(None)
    key = key_columns(doc_id, F.coalesce(F.col("text").cast("string"), F.lit("")))
    if order == 1:
        # two steps: what stands beside a generator is computed again for each of its rows
        split = rows.select(*(key if keyed else []), split_words(F.col("text")).alias("words"))
        made = split.select(*(KEY if keyed else []), F.posexplode("words").alias("pos", "w1"))
        return made.withColumn("copies", F.lit(1)).withColumn("first", (F.col("pos") == 0).cast("int"))
    whole = rows.select(*key, "text").groupBy(*KEY).agg(F.max("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    made = whole.select(*KEY, "copies", F.posexplode(split_words(F.col("text"))).alias("pos", "w1")).where("w1 != ''")
    following = Window.partitionBy(*KEY).orderBy("pos")
    made = made.select("*", F.lit(0).alias("first"), *[F.lead("w1", k).over(following).alias(f"w{k + 1}") for k in range(1, order)])
    return made


def features(places: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """The position table with (word, bucket) in place of the words: a row for each feature that begins at a place.

    word: 1 for a feature of one word. bucket is null on a row without a word.
    """
    def bucket(feature: Column) -> Column:
        return (F.crc32(feature) % buckets).cast("int")

    rest = [c for c in places.columns if not c.startswith("w")]
    if order == 1:
        held = F.col("w1") != ""
        return places.select(*rest, held.cast("int").alias("word"), F.when(held, bucket(F.col("w1"))).alias("bucket"))
    grams = [F.concat_ws(" ", *[f"w{k}" for k in range(1, n + 1)]) for n in range(1, order + 1)]
    made = F.array(*[F.when(F.col(f"w{n}").isNotNull(), F.struct(F.lit(int(n == 1)).alias("word"), bucket(g).alias("bucket"))) for n, g in enumerate(grams, 1)])
    return places.select(*rest, F.inline(F.filter(made, lambda x: x.isNotNull())))


def bucket_counts(rows: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): one row for each bucket in use, so `buckets` rows at most; copies are counted."""
    used = features(positions(rows, order, keyed=False), order, buckets).where("bucket is not null")
    return used.groupBy("bucket").agg(F.sum("copies").alias("n"))


def gains(rows: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): a row for every bucket."""
    spark = rows.sparkSession
    all_buckets = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    s = F.broadcast(bucket_counts(rows, order, buckets).withColumnRenamed("n", "s"))
    t = F.broadcast(bucket_counts(target, order, buckets).withColumnRenamed("n", "t"))
    both = materialize(all_buckets.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"]), "buckets")
    total = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))  # one row
    s1, t1 = F.col("s").cast("double") + 1, F.col("t").cast("double") + 1
    ratio = t1 * (F.col("all_s") + buckets) / (s1 * (F.col("all_t") + buckets))
    return both.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(rows: DataFrame, gain: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, n_features, weight) of each different row; gain: one row for each bucket."""
    used = features(positions(rows, order), order, buckets).join(F.broadcast(gain), "bucket", "left")
    sums = used.groupBy(*KEY).agg(
        F.sum("gain").alias("g"), F.count("bucket").alias("n"), F.sum("word").alias("w"), F.greatest(F.sum("first"), F.lit(1)).alias("r"))
    weight = F.when(F.col("n") > 0, F.expr("(g - pmod(g, n)) div n")).otherwise(0)
    return sums.select(*KEY, F.expr("w div r").alias("n_words"), F.expr("n div r").alias("n_features"), weight.cast("long").alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u in (0, 1) from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, order: int = ORDER, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
    seed: int = SEED, columns: Sequence[str] | None = None,
) -> DataFrame:
    """docs (or these columns of it) with n_features, weight, score and rank (1, 2, 3 .. of the drawn, else null).

    Drawn is `percent` of the rows of min_words words or more, those of the highest scores.
    """
    prepare(docs.sparkSession)
    own = [c for c in (docs.columns if columns is None else columns) if c.lower() not in _NEW]
    found = weights(docs, gains(docs, target, order, buckets), order, buckets).withColumnsRenamed({k: f"_w{k}" for k in KEY})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = F.struct(*own).alias("_kept") if own else F.lit(None).alias("_kept")
    rows = docs.select(kept, *key_columns(F.col("doc_id"), text))
    same = [F.col(k).eqNullSafe(F.col(f"_w{k}")) for k in KEY]
    rows = rows.join(found, same[0] & same[1] & same[2], "left").drop(*[f"_w{k}" for k in KEY])
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_words", "n_features", "weight")})
    rows = materialize(rows.withColumn("score", F.col("weight") + noise(F.col("_id"), seed)), "scores")

    able = rows.where(F.col("n_words") >= min_words).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    higher = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    able = able.select("score", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("_before"), F.sum("n").over(everything).alias("_all"))
    drawn = able.select("score", "_before", F.expr(f"_all * {percent} div 100").alias("_draw")).where("_before < _draw")
    rows = rows.join(F.broadcast(materialize(drawn, "drawn")), "score", "left")  # a row for each score
    near = F.coalesce((F.col("n_words") >= min_words) & (F.col("_before") < F.col("_draw")), F.lit(False))
    within = Window.partitionBy("score").orderBy(F.col("_id").asc_nulls_last(), "_k1", "_k2")
    ranked = rows.where(near).withColumn("rank", F.col("_before") + F.row_number().over(within))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= F.col("_draw"), F.col("rank")))
    out = ranked.unionByName(rows.where(~near).withColumn("rank", F.lit(None).cast("long")))
    return out.select(*([F.col(f"_kept.{c}").alias(c) for c in own]), *_NEW)
