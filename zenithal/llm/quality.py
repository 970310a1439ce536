"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of a text are Spark column expressions (:func:`statistics`).
2. A random forest of shallow trees is fitted on a bounded sample of labelled rows; every path from a root to a node is a
   rule, a conjunction of at most one lower and one upper bound per statistic.
3. An L1-penalised logistic regression over the rules gives most of them weight zero.
4. What is left is compiled into one Spark column expression: a sum of ``when(conjunction, weight)`` under a logistic
   function. Scoring needs no Python and no shuffle.

Labels are only read for fitting; language, source and id are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zenithal.session import materialize

#: Rows that are learnt from at most; chosen by a hash of the id, so at any size it is a sample of all labelled rows.
SAMPLE_ROWS = 12_000


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a whole text; all are defined (0) for empty and null texts."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"[\s]+"), lambda w: w != "")
    lines = F.filter(F.split(t, r"\n"), lambda x: F.trim(x) != "")
    chars, n, m = F.length(t), F.size(words), F.size(lines)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    return {
        "log_words": F.log1p(n), "word_length": share(chars, n), "distinct_words": share(F.size(F.array_distinct(words)), n), "log_lines": F.log1p(m),
        "words_a_line": share(n, m), "distinct_lines": share(F.size(F.array_distinct(lines)), m),
        "upper": share(count(r"\p{Lu}"), chars), "digits": share(count(r"[0-9]"), chars), "marks": share(count(r"[!?]"), n), "pipes": share(count(r"[|]"), n),
        "symbols": share(count(r"[#$%&*<>{}\[\]=_~^\\]"), n), "stops": share(count(r"[.,;:]"), n), "repeats": share(count(r"(?<!\S)(\S+) \1(?!\S)"), n),
        "shouted": share(count(r"\b\p{Lu}{2,}\b"), n), "short_words": share(count(r"(?<!\S)\S{1,3}(?!\S)"), n), "junk_runs": share(count(r"[^\p{L}\p{N}\s]{3,}"), n),
    }


@dataclass(frozen=True)
class Rule:
    """lower[i] < statistic i <= upper[i] for every bound that it has."""

    lower: tuple[tuple[str, float], ...]
    upper: tuple[tuple[str, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, x in self.lower:
            out = out & (F.col(name) > x)
        for name, x in self.upper:
            out = out & (F.col(name) <= x)
        return out


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1 as an expression over the statistics' columns."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-z))


def tree_rules(root, names: list[str]) -> set[Rule]:
    """A rule for each node below the root; bounds on the same statistic along a path are merged."""
    found: set[Rule] = set()

    def walk(node, low: dict[str, float], up: dict[str, float]) -> None:
        if low or up:
            found.add(Rule(tuple(sorted(low.items())), tuple(sorted(up.items()))))
        if node.subtreeDepth() == 0:
            return
        name, x = names[node.split().featureIndex()], float(node.split().threshold())
        walk(node.leftChild(), low, up | {name: min(x, up.get(name, x))})
        walk(node.rightChild(), low | {name: max(x, low.get(name, x))}, up)

    walk(root, {}, {})
    return found


def fit(docs: DataFrame, labels: DataFrame, label: str = "label", text: str = "text", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, trees: int = 16, depth: int = 3, penalty: float = 0.002, seed: int = 11) -> RuleModel:
    """Fit on at most ``sample_rows`` rows of ``docs`` that have a label in ``labels`` (one row per key, joined by ``key``);
    null labels are ignored, equal rows count as often as they are there.

    With no rows, or only one label, the model has no rules and scores the share of label 1 (1.0 with no rows).
    """
    names = list(statistics(F.col(text)))
    mark = F.xxhash64(F.lit(seed), key, text)
    # The sample is chosen by hashes alone; whole texts are then read for its rows, whose number is bounded, and never shuffled.
    rows = docs.select(F.col(key).alias("k"), mark.alias("h")).join(labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("y")).where("y is not null"), "k")
    chosen = rows.select("h", "y").orderBy("h", "y").limit(sample_rows).groupBy("h").agg(F.avg("y").alias("share"), F.count(F.lit(1)).cast("double").alias("copies"))
    own = docs.select(mark.alias("h"), F.col(text).alias("t")).join(F.broadcast(chosen), "h")
    own = own.select("h", "share", "copies", F.struct(*[c.cast("double").alias(k) for k, c in statistics(F.col("t")).items()]).alias("s"))
    once = own.groupBy("h").agg(F.first("share").alias("share"), F.first("copies").alias("copies"), F.first("s").alias("s"))
    table = once.select("h", "copies", (F.col("share") >= 0.5).cast("double").alias("y"), "s.*").repartition(4, "h").sortWithinPartitions("h")
    table = materialize(table, "quality-sample")
    n, positive = table.agg(F.coalesce(F.sum("copies"), F.lit(0.0)), F.coalesce(F.sum(F.col("y") * F.col("copies")), F.lit(0.0))).first()
    if positive in (0, n):
        return RuleModel((), 20.0 if positive == n else -20.0)
    vectors = VectorAssembler(inputCols=names, outputCol="x").transform(table)
    # Both labels weigh the same, or the rarer one has few splits of its own.
    vectors = vectors.withColumn("w", F.col("copies") * F.when(F.col("y") == 1, n / (2 * positive)).otherwise(n / (2 * (n - positive))))
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="w", numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, cacheNodeIds=False).fit(vectors)
    rules = sorted(set().union(*(tree_rules(t._call_java("rootNode"), names) for t in forest.trees)), key=repr)
    ruled = table.select("y", "h", "copies", *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    ruled = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(ruled)
    lasso = LogisticRegression(featuresCol="x", labelCol="y", weightCol="copies", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(ruled)
    kept = tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if w)
    return RuleModel(kept, float(lasso.intercept))


def score(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """``docs`` plus ``score``; columns of the same name in ``docs`` are replaced, others are kept."""
    stats = F.struct(*[c.cast("double").alias(k) for k, c in statistics(F.col(text)).items()])
    keep = [F.col(f"_d.`{c}`").alias(c) for c in docs.columns if c != "score"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"), stats.alias("_s")).select("_d", "_s.*")
    return rows.select(*keep, model.score().alias("score"))


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learnt from."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


def fit_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> RuleModel:
    """A model of the rows of ``docs`` that are not held out, by ``labels.quality``. A document with several labels counts as
    good if one of them says so; rows without an id are not learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    return fit(docs.where(~F.coalesce(held_out(), F.lit(True))), labels)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, fit_documents(spark, docs, sf_dir))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
