"""The corpus pipeline: documents through five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zenithal.llm import bpe, mixing, pii, quality, simhash
from zenithal.llm.skew import join_counted
from zenithal.session import discard, materialize, temporary


def _packed(docs: DataFrame) -> DataFrame:
    """One column ``d`` with all of ``docs``, so that no name can clash with one of a stage's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier, fitted on this stage's own input, rejects.

    Null and empty texts are scored like any other; rows that repeat are judged alike; rows without an id are judged but never
    learnt from. An empty table, or one without labels, loses nothing. Columns stay as they are, whatever their names."""
    model = quality.fit_documents(spark, docs, sf_dir)
    rows = quality.score(_packed(docs).select("d", F.col("d.text").alias("text")), model).where("score >= 0.3")
    return _unpacked(rows, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose five-word shingles are alike (Jaccard of at least 0.8) keep one document: that with the
    smallest id, null after all others, and of texts that share this id the one with the smallest digest.

    Candidates come from the trees of SimHash fingerprints and an exact index past their radius; whole sets decide. Null and
    empty texts are alike. Of rows that are equal in id and text, that with the smallest hash of all its columns stays, once.
    An empty table gives an empty result. Columns stay as they are, whatever their names."""
    digest = F.sha2(F.coalesce(F.col("d.text"), F.lit("")), 256).alias("digest")
    rows = _packed(docs).select("d", F.col("d.doc_id").alias("id"), digest, F.xxhash64(*[F.col(f"d.`{c}`") for c in docs.columns]).alias("h"))
    roots = simhash.similar_texts(docs)
    found = join_counted(rows.select("id", "digest", "h"), roots, "digest", "copies")
    found = found.groupBy("root", "id", "digest", "h").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "h", "n")).alias("k")
    keep = materialize(found.groupBy("root").agg(first).select(*[F.col(f"k.{c}").alias(f"k_{c}") for c in ("id", "digest", "h", "n")]), "pipeline-keep")
    met = rows.join(keep, (F.col("digest") == F.col("k_digest")) & F.col("id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h")))
    again = met.where("k_n > 1").groupBy("k_digest").agg(F.first("d").alias("d")).select("d")
    return _unpacked(met.where("k_n = 1").select("d").unionByName(again), docs)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets surrogates; ``n_chars`` follows the new texts that differ from the old ones.

    Null and empty texts stay, long ones are searched whole, rows that repeat get the same text. An empty table gives an empty
    result. Columns stay as they are, whatever their names."""
    return pii.replace(docs, secret=pii.secret_of(spark), length_column="n_chars", count_column=None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring sources to their target weights: each document as often as the mix takes it.

    Null and empty texts have no words and are taken as whole copies only; a null source is a source; rows that repeat share
    their copies evenly. An empty table gives an empty result. Columns stay as they are, whatever their names."""
    return mixing.mix_documents(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every document.

    Null texts count as empty, which have no ids; long ones are encoded whole; rows that repeat give rows that repeat. An empty
    table gives an empty result. Other columns are not read, whatever their names."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("simhash", drop_near_duplicates),
    ("pii", replace_pii),
    ("mixing", mix_sources),
    ("bpe", encode_bpe),
]

#: No SQL can express the stages; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that the one before kept; a stage's tables are deleted when its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with temporary() as keep:
            keep.append(out := materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
