import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from zenithal.llm import files, pfor, tokens
from zenithal.session import shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 60), max_size=3000))
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    blocks = pfor.encode_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks)])
    assert np.array_equal(pfor.decode_blocks(b"".join(blocks), starts), ids)


def test_outliers_are_exceptions():
    ids = np.arange(1024, dtype=np.uint32) % 16
    ids[7] = 50_000
    (block,) = pfor.encode_blocks(ids)
    assert pfor.HEAD.unpack_from(block)[2:] == (4, 1) and len(block) < 600


def test_files_against_the_library(spark):
    rows = [(3, "b c"), (1, "a"), (2, None), (None, "null id"), (3, "again"), (9, "x y " * 30_000), (8, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    manifest = pfor.write_tokens(df, PATH, shared_dir(spark, "t"), file_ids=1000)
    got = sorted(pfor.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.key for r in got] == [None, 1, 2, 3, 3, 8, 9]
    t, at = Tokenizer.from_file(PATH), 0
    texts = {}
    for k, x in rows:
        texts.setdefault(k, set()).add(zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes()))
    for r in got:
        assert r.start == at and r.ids_crc32 in texts[r.key]
        at += r.n_tokens
    last = max(manifest.collect(), key=lambda r: r.start)
    whole = pfor.unpack_file(files.read(last.path))[0]
    assert np.array_equal(pfor.read_ids(last.path, 1500, 2000), whole[1500:3500])
    with pytest.raises(IndexError):
        pfor.read_ids(last.path, len(whole), 1)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pfor.read_tokens(pfor.write_tokens(df, PATH, shared_dir(spark, "t"))).count() == 0


PIECES = [*"aB é \n\t\u00a0\u3000\x1c\x85\u200b1½!'s中😀Ж.,", "<|endoftext|>", "  ", " word", " Ωmega", "ends.", "'s"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join) | st.text(max_size=40))
def test_units_are_independent(library, text):
    found = tokens.units(text, PATH)
    assert "".join(found) == text
    ids = [int(i) for b in map(tokens.encoder(PATH), found) for i in np.frombuffer(b, "<u4")]
    assert ids == library.encode(text, add_special_tokens=False).ids
    for _ in range(2):
        assert np.frombuffer(tokens.cache(PATH).encode(text), "<u4").tolist() == ids


def test_small_caches_give_the_same_ids(library):
    text = " ".join(f"word{i % 37} and\nmore{i % 11}, x" for i in range(500))
    small = tokens.Cache(PATH, most=20)
    for _ in range(3):
        assert np.frombuffer(small.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert small.encode("a  b ") == tokens.Cache(PATH).encode("a  b ")
