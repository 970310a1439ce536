"""Full-text search: English stems, a positional inverted index, ranks by the positions of terms.

The index is two tables. The lexicon has each distinct word with its stem and its bucket (a hash of the word); words are stemmed
once, here. Postings have a row for each position of a word, written by bucket and sorted by word, so a search reads only the
buckets of its words, and within them the row groups that can hold one. Stop words keep their place but have no postings.
Writing asks Spark to even out parts, so a word that is everywhere is cut into several files.

A text matches a query if it has all of its stems. With two or more of them the rank is 1 - product(1 - c) over all pairs of
places of different stems at a distance d of 1 to 100, c = weight * sqrt(1 / (1.005 + 0.05 exp(d / 1.5 - 2))); with one stem the
places count weight / i^2 in their order, over pi^2 / 6. Pairs further apart than 100 words add nothing to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zenithal.functions.stem import stems
from zenithal.operators.retrieval import bounded, parts, top
from zenithal.session import materialize, shared_dir

#: Words that are not looked for.
STOP = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most
other some such no nor not only own same so than too very s t can will just don should now""".split()
#: The weight of a place, and how far apart places still count as near.
WEIGHT, NEAR = 0.1, 100
BUCKETS = 64


def tokens(text: Column) -> Column:
    """The lower-case words of a text in their order: runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


class Index:
    """The lexicon (word, stem, bucket, places) and the path of the postings (bucket, word, key, pos)."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    @property
    def lexicon(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lexicon")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/postings")

    def places(self, asked: DataFrame) -> DataFrame:
        """(stem, key, pos) of all words whose stem is in ``asked`` (stem). The buckets to read are told to the scan."""
        words = materialize(self.lexicon.join(bounded(asked.select("stem").distinct(), 100_000), "stem"), "fulltext-words")
        buckets = [r.bucket for r in words.select("bucket").distinct().collect()]  # BUCKETS at most
        some = self.postings.where(F.col("bucket").isin(buckets)) if len(buckets) < BUCKETS else self.postings
        return some.join(bounded(words.select("bucket", "word", "stem"), 1_000_000), ["bucket", "word"]).select("stem", "key", "pos")


def build(docs: DataFrame, key: str, text: str, path: str | None = None) -> Index:
    """Index every text of ``docs``. Null and empty texts have no words; rows that share a key share its places."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "fulltext")
    words = docs.select(F.col(key).alias("key"), F.posexplode(tokens(F.col(text))).alias("pos", "word")).where(~F.col("word").isin(STOP))
    words = words.select(bucket(F.col("word")).alias("bucket"), "word", "key", (F.col("pos") + 1).alias("pos"))
    words.hint("rebalance", "bucket").sortWithinPartitions("bucket", "word", "key", "pos").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")
    schema = words.select("word", "key", "pos", "bucket").schema
    made = Index(spark, path, schema)
    # Words are few bytes and much work each: dealt to a fixed number of tasks, which Spark doesn't join to few by their size (by
    # a hash, as it takes a second shuffle by the same column out).
    lexicon = made.postings.groupBy("word").agg(F.count(F.lit(1)).alias("places")).repartition(parts(docs), F.xxhash64("word"))
    stems(lexicon, others=("places",)).select("word", "stem", bucket(F.col("word")).alias("bucket"), "places").write.parquet(f"{path}/lexicon")
    return made


def parse(queries: DataFrame) -> DataFrame:
    """(query, stem) of plain texts (query, text): the distinct stems of their words but stop words."""
    words = queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).where(~F.col("word").isin(STOP))
    return words.join(stems(words.select("word").distinct()), "word").select("query", "stem").distinct()


def search(index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query, key, score, rank): for each query (query, text) the ``k`` highest ranked keys that have all of its stems; equal
    ranks in the order of keys. A query of stop words only finds nothing. Queries may be any number: what is joined with the
    places is broadcast only where it is small."""
    asked = materialize(parse(queries), "fulltext-asked")
    asked = materialize(asked.join(asked.groupBy("query").agg(F.count(F.lit(1)).alias("terms")), "query"), "fulltext-terms")
    single, several = asked.where("terms = 1").select("query", "stem"), asked.where("terms > 1")
    # Places meet no query before it is known to match: texts do, by how often they have a stem.
    places = materialize(index.places(asked).distinct(), "fulltext-places")
    counts = materialize(places.groupBy("stem", "key").agg(F.count(F.lit(1)).alias("n")), "fulltext-counts")
    whole = counts.join(bounded(several, 100_000), "stem").groupBy("query", "key", "terms").agg(F.count(F.lit(1)).alias("found")).where("found = terms").select("query", "key")
    hits = materialize(whole.join(bounded(several.select("query", "stem"), 100_000), "query").join(places, ["stem", "key"]), "fulltext-hits")

    series = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / (i * i))
    one = counts.join(bounded(single, 100_000), "stem").select("query", "key", (WEIGHT * series / 1.64493406685).alias("score"))

    # Places of two stems are near only in the same or neighbouring stretches of NEAR words.
    stretch = F.floor(F.col("pos") / NEAR)
    many = hits.select("query", "key", "stem", "pos", stretch.alias("at"))
    other = many.select("query", "key", F.col("stem").alias("stem2"), F.col("pos").alias("pos2"), F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)).alias("at"))
    gap = F.abs(F.col("pos") - F.col("pos2"))
    pairs = many.join(other, ["query", "key", "at"]).where("stem < stem2").where(gap.between(1, NEAR)).groupBy("query", "key", gap.alias("d")).agg(F.count(F.lit(1)).alias("n"))
    c = WEIGHT * F.sqrt(1.0 / (1.005 + 0.05 * F.exp(F.col("d") / 1.5 - 2)))
    near = pairs.groupBy("query", "key").agg(F.sum((F.col("n") * F.log1p(-c)).cast("decimal(30,15)")).cast("double").alias("s")).select("query", "key", (1 - F.exp("s")).alias("score"))
    many_keys = hits.select("query", "key").distinct()
    ranked = many_keys.join(near, ["query", "key"], "left").select("query", "key", F.coalesce("score", F.lit(1e-20)).alias("score"))
    return top(one.unionByName(ranked).withColumn("score", F.round("score", 9)), "query", "score", "key", k)
