"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source gets a target of words: a share of ``share`` times all words, by its weight, never above ``cap`` times its
own words (what the cap cuts off goes to the other sources by weight, until none is above). A document is first given
``floor(target / words of the source)`` certain whole copies. One more copy goes to a fixed-size sample of the source's
documents: each has an inclusion probability, its rank is the Pareto variable

    q = (U / (1 - U)) / (p / (1 - p)),   U a keyed hash of the document,

and documents are taken by ascending q until the words that are left of the target are used up; the last one is taken if
that brings the sum nearer to the target.

Scale: one narrow table (no texts) is written once. Ranks are cut into value bins of about ``bin_rows`` documents; bins
are summed before the shuffle, a running sum over bins finds the one bin per source in which the target is met, and only
the rows of that bin are sorted. So a source with a third of all rows is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zenithal.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SEED = 7


def row_hash(key: Column, text: Column, seed: int) -> Column:
    """52 bits of a digest of key and text: the same in every engine and run."""
    whole = F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")), F.sha2(F.coalesce(text, F.lit("")), 256), text.isNull().cast("string"))
    return F.conv(F.substring(F.sha2(whole, 256), 1, 13), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, weight, target) of each source in ``sizes`` (source, size).

    Sources stand by code point, null last, and take ``weights`` in turn. The capped shares have a closed form: with
    sources by ascending cap / weight, the first k are at their caps, the others get equal words per weight, for the
    smallest k for which nobody is above. One row per source, so the running sums are small.
    """
    n = len(weights)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % n + 1)
    per = per.withColumn("weight", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    up = W.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, everything = up.rowsBetween(W.unboundedPreceding, -1), up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / open_weight).withColumn("fits", F.col("level") <= F.col("most") / F.col("weight"))
    # The level of the first source that fits holds for it and for all after it.
    per = per.withColumn("level", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(everything))
    return per.select("source", "source_size", "n_docs", "weight", F.least("most", F.coalesce(F.col("weight") * F.col("level"), "most")).alias("target"))


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", importance: str | None = None,
    weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = SEED, bin_rows: int = 5000,
) -> DataFrame:
    """(key, source, row_hash, size, source_size, target, copies, taken): how often the mix takes each document.

    ``importance``: an optional positive column; a document's odds of the extra copy are those of its source times it.
    Null or empty texts have size 0 and, like documents of a source without words, are in no extra copy. A null source is
    a source of its own. Rows that are equal in key and text are ranked next to each other; which of them is taken makes no
    difference. Null keys are ranked by their text. Reruns give the same rows. An empty table gives an empty result.
    """
    odds = F.lit(1.0) if importance is None else F.coalesce(F.col(importance).cast("double"), F.lit(1.0))
    base = materialize(
        docs.select(
            F.col(key).alias("key"), F.col(source).alias("source"), odds.alias("odds"), row_hash(F.col(key), F.col(text), seed).alias("row_hash"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ), "mix-sizes",
    )
    targets = materialize(source_targets(base, weights, share, cap), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets.withColumn("certain", F.floor(ratio)).withColumn("p", ratio - F.floor(ratio))
    plan = plan.withColumn("left", F.col("target") - F.col("certain") * F.col("source_size")).withColumn("bins", F.ceil(F.col("n_docs") / F.lit(bin_rows)).cast("long"))
    u = (F.col("row_hash").cast("double") + 0.5) / float(1 << 52)
    # One row per source; Spark broadcasts it while it is small and shuffles (splitting hot sources) when it is not.
    rows = base.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("u", u)
    q = (F.col("u") / (1 - F.col("u"))) * (1 - F.col("p")) / (F.col("p") * F.col("odds"))
    rows = rows.withColumn("q", F.when((F.col("p") > 0) & (F.col("size") > 0) & (F.col("odds") > 0), q))
    # q in units of its source's odds lies evenly in (0, 1) after x / (1 + x); within a source the order is that of q.
    x = F.col("q") * F.col("p") / (1 - F.col("p"))
    rows = rows.withColumn("bin", F.floor(x / (1 + x) * F.col("bins")).cast("long"))
    per_bin = rows.where("q is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    run = W.partitionBy("source").orderBy("bin")
    per_bin = per_bin.withColumn("before", F.sum("words").over(run) - F.col("words"))
    meets = per_bin.where((F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left")))
    meets = materialize(meets.select(F.col("source").alias("s"), F.col("bin").alias("at"), "before"), "mix-bins")
    rows = rows.join(meets, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    inside = F.col("bin") == F.col("at")
    sort = W.partitionBy("source").orderBy("q", "row_hash", "key").rowsBetween(W.unboundedPreceding, 0)
    edge = rows.where(inside).withColumn("sum", F.col("before") + F.sum("size").over(sort))
    over, under = F.col("sum") - F.col("left"), F.col("left") - (F.col("sum") - F.col("size"))
    edge = edge.withColumn("extra", ((over <= 0) | ((under > 0) & (over <= under))).cast("int")).drop("sum")
    # Where no bin meets the target (it is the whole source), every ranked row is taken.
    rest = rows.where(~F.coalesce(inside, F.lit(False))).withColumn("extra", F.when(F.col("q").isNull(), 0).otherwise((F.col("at").isNull() | (F.col("bin") < F.col("at"))).cast("int")))
    copies = (F.col("certain") + F.col("extra")).cast("long")
    return edge.unionByName(rest).select("key", "source", "row_hash", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


#: The same mix over whole tables in one sort for each source.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(sha256('7|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || sha256(coalesce(text, '')) || '|' || CASE WHEN text IS NULL THEN 'true' ELSE 'false' END), 1, 13) AS BIGINT) AS h
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), o AS (SELECT *, [5e0, 2e0, 1e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2e0 * source_size AS most FROM s
), l AS (
  SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(most) OVER below, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER below, 0)) AS level FROM o
  WINDOW below AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT level AS shared FROM l WHERE level <= most / w ORDER BY most / w, source NULLS LAST LIMIT 1
), t AS (SELECT source, source_size, least(most, coalesce(w * (SELECT shared FROM f), most)) AS target FROM l
), r AS (
  SELECT d.*, t.source_size, t.target, floor(ratio) AS certain, ratio - floor(ratio) AS p, t.target - floor(ratio) * t.source_size AS remaining, (h + 0.5e0) / 4503599627370496e0 AS u
  FROM d JOIN (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM t) t ON d.source IS NOT DISTINCT FROM t.source
), q AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) * (1 - p) / p END AS q FROM r
), c AS (SELECT *, sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, h, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM q)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((certain + CASE WHEN q IS NOT NULL AND (run <= remaining OR (remaining > run - size AND run - remaining <= remaining - (run - size))) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM c
"""


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every row of ``documents``."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns unchanged, whatever their names.

    Rows that are equal in id, source and text take equal shares of their copies; where these don't divide evenly, some of
    the equal rows take one more. Null and empty texts are as in :func:`mix`. An empty table gives an empty result."""
    taken = mix(docs).groupBy("key", "source", "row_hash").agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("equal")).where(F.col("total") > 0)
    # One column with all of docs: no name can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    rows = rows.select("d", row_hash(F.col("d.doc_id"), F.col("d.text"), SEED).alias("h"))
    same = F.col("d.doc_id").eqNullSafe(F.col("key")) & F.col("d.source").eqNullSafe(F.col("source")) & (F.col("h") == F.col("row_hash"))
    met = rows.join(taken, same)
    even = met.where("total % equal = 0").withColumn("n", F.expr("cast(total / equal as int)"))
    place = F.row_number().over(W.partitionBy("key", "source", "row_hash").orderBy("h"))
    odd = met.where("total % equal <> 0").withColumn("n", (F.expr("cast(floor(total / equal) as int)") + (place <= F.col("total") % F.col("equal")).cast("int")))
    out = even.unionByName(odd).where("n > 0").select("d", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    return out.select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])
