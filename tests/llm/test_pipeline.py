import hashlib
import shutil
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from zenithal.llm import pii, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and the output of every stage, as rows."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return [d.toPandas() for d in out]


def test_names_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "simhash", "pii", "mixing", "bpe"]
    for s in stages[1:-1]:
        assert list(s.columns) == list(stages[0].columns)


def test_quality_keeps_clean_documents(stages, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().dropna(subset=["quality"]).set_index("doc_id").quality
    kept = set(stages[1].doc_id)
    good, bad = [d for d in stages[0].doc_id if labels.get(d) == 1], [d for d in stages[0].doc_id if labels.get(d) == 0]
    assert sum(d in kept for d in good) >= 0.9 * len(good) and sum(d in kept for d in bad) <= 0.3 * len(bad)


def test_one_of_each_group_stays(stages):
    rows = list(stages[1][["doc_id", "text"]].itertuples(index=False))
    sets = []
    for _, t in rows:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    want = {min(rows[i][0] for i in range(len(rows)) if comp[i] == c) for c in set(comp)}
    assert set(stages[2].doc_id) == want and len(stages[2]) == len(want)


def test_texts_change_only_where_there_is_personal_data(stages):
    import regex

    before, after = stages[2].set_index("doc_id").text, stages[3].set_index("doc_id").text
    assert set(before.index) == set(after.index)
    pattern = regex.compile(pii.PATTERN)
    for d in before.index:
        if not pattern.search(before[d]):
            assert before[d] == after[d]


def test_mix_repeats_whole_documents(stages):
    assert set(stages[4].doc_id) <= set(stages[3].doc_id) and stages[4].groupby("doc_id").size().max() <= 2


def test_last_stage_against_the_library(stages):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, x in stages[4][["doc_id", "text"]].itertuples(index=False):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, stages[5][["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]].itertuples(index=False))) == sorted(want)


def test_run_and_empty_tables(spark, tmp_path, stages):
    assert pipeline.run(spark, SF).count() == len(stages[5])
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_pass_every_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(None, "text of a row without an id", "en", "s", 5), (1, None, None, None, None), (2, "", "en", None, 0), (2, "", "en", None, 0), (3, "w " * 100_000, "en", "s", 200_000), (3, "other words here", "de", "s", 16)]
    odd = spark.createDataFrame(rows, docs.schema)
    odd.unionByName(docs).write.parquet(str(tmp_path / "documents.parquet"))
    Path(tmp_path / "labels.parquet").mkdir()
    shutil.copy(f"{SF}/labels.parquet", tmp_path / "labels.parquet" / "part.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() > 0
    assert quality.score(odd, quality.RuleModel((), 0.0)).count() == len(rows)


def test_stages_with_odd_rows_and_clashing_names(spark):
    a = " ".join(f"a{i}" for i in range(40))
    rows = [(None, "text of a row without an id, of some more words"), (1, None), (2, ""), (2, ""), (3, "w " * 60_000), (3, "other words here"), (5, a), (5, a), (6, a), (7, "Dr. Ada Byron has me@x.org")]
    docs = spark.createDataFrame([(k, t, "en" if k else None, "s" if k != 3 else None, len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    odd = ["d", "h", "id", "key", "root", "digest", "hits", "score", "copies", "k_id", "total", "row_hash", "pii_entities", "units", "a.b", "_d"]
    docs = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in odd]).repartition(3)
    out = {}
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        out[name] = got.collect()
        assert all(r[c] == f"own {c}" for r in out[name] for c in odd), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    have = Counter(rows)
    assert not Counter((r.doc_id, r.text) for r in out["quality"]) - have
    assert sorted(((r.doc_id, r.text) for r in out["simhash"]), key=str) == sorted([rows[0], rows[1], rows[4], rows[5], rows[6], rows[9]], key=str)
    assert Counter(r.doc_id for r in out["pii"]) == Counter(k for k, _ in rows)
    for r in out["pii"]:
        assert (r.text in [t for k, t in rows if k == r.doc_id]) == (r.doc_id != 7) and (r.n_chars == len(r.text or ""))
    assert set((r.doc_id, r.text) for r in out["mixing"]) <= set(rows) and max(Counter((r.doc_id, r.text) for r in out["mixing"]).values()) <= 4
    assert spark.createDataFrame(rows, "doc_id long, text string").count() == pipeline.encode_bpe(spark, docs, SF).count()
