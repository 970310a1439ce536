import hashlib
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from zenithal.llm import bpe, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_against_the_library(spark):
    texts = ["Hello  world's\n\n x", "", None, "é ü 中文 😀 <|endoftext|> a<|endoftext|>", "word " * 20_000, "a b  c", "same", "same", "\x00 \x1c"]
    df = spark.createDataFrame([(None if t == "same" else i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(3)
    t = Tokenizer.from_file(PATH)
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, PATH).collect())
    want = []
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((x == "same", None if x == "same" else i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=lambda w: (w[0], w[1] or 0))


def plain_units(text):
    return tokens.units(text, PATH)


def test_words_are_split_as_the_tokenizer_allows(spark):
    texts = ["a  b\u3000c\x85d\n\n", " <|endoftext|> x<|endoftext|><|endoftext|>y ", "", "日本 語 é\u0301 \u2028z", "\x1c a\x00b", "x" * 3_000_000 + " y" * 200_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.u for r in df.select("i", bpe.units(F.col("text"), PATH).alias("u")).collect()}
    assert got == {i: plain_units(t) for i, t in enumerate(texts)}


def test_each_repeated_word_is_in_the_table_once(spark):
    rows = [(i, f"word{i % 5} and more {i}") for i in range(50)] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    table = bpe.word_table(df, PATH).collect()
    count = Counter(u for _, t in rows for u in plain_units(t or ""))
    assert sorted((r.word, r.n) for r in table) == sorted((w, n) for w, n in count.items() if n > 1)
    one = tokens.encoder(PATH)
    assert all(bytes(r.ids) == one(r.word) for r in table)
    few = {r.word for r in bpe.word_table(df, PATH, table_words=4).collect()}
    assert few == {" and", " more"}


def test_words_of_the_table_are_not_encoded_again(spark, tmp_path):
    """Words that are encoded at a position are those that occur once, and nothing else."""
    rows = [(i, f"word{i % 5} and more{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    log = str(tmp_path / "log")
    real = tokens.encoder

    def logging(path):
        one = real(path)

        def run(u):
            with open(log, "a") as f:
                f.write(u + "\n")
            return one(u)

        return run

    t = Tokenizer.from_file(PATH)
    encoded = {r.key: r.ids for r in bpe.encode(df, PATH, encoder=logging).collect()}
    assert encoded == {i: t.encode(x, add_special_tokens=False).ids for i, x in rows}
    seen = Counter(Path(log).read_text().splitlines())
    assert set(seen) == {u for _, x in rows for u in plain_units(x)} and max(seen.values()) == 1


@pytest.mark.parametrize("most", [0, 3, 1 << 20])
def test_any_size_of_the_table_gives_the_same_ids(spark, most):
    df = spark.createDataFrame([(i, f"word{i % 5} and more {i}") for i in range(50)], "doc_id long, text string").coalesce(2)
    t = Tokenizer.from_file(PATH)
    got = {r.key: r.ids for r in bpe.encode(df, PATH, table_words=most).collect()}
    assert got == {i: t.encode(f"word{i % 5} and more {i}", add_special_tokens=False).ids for i in range(50)}


def test_rows_wider_than_a_slice(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(300_000))
    df = spark.createDataFrame([(1, text), (2, "a b"), (2, "a b"), (3, text)], "`a.key` long, `words` string").coalesce(1)
    got = sorted((r.key, len(r.ids), r.decoded) for r in bpe.decode(bpe.encode(df, PATH, key="a.key", text="words"), PATH).collect())
    n = len(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids)
    assert got == [(1, n, text), (2, 2, "a b"), (2, 2, "a b"), (3, n, text)]


def test_empty_and_decode(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert bpe.encode(df, PATH).count() == 0
    ids = spark.createDataFrame([([50256, 15496],), ([],), (None,), ([220, 447],)], "ids array<int>")
    t = Tokenizer.from_file(PATH)
    got = [r.decoded for r in bpe.decode(ids, PATH).collect()]
    assert got == ["<|endoftext|>Hello", "", None, t.decode([220, 447], skip_special_tokens=False)]
