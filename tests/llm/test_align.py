import hashlib
from collections import Counter

import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from zenithal.llm import align as A

BYTE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(rows):
    """Token by token, as the two libraries encode; pairs by comparing all byte ranges that can meet."""
    lib, sp = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    lib.encode_special_tokens = True
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in keep)}
    name = {i: bytes(byte_of[c] for c in n) for n, i in lib.get_vocab().items() if all(c in byte_of for c in n)}

    def cut(sizes):
        ends, at = [], 0
        for n in sizes:
            ends.append((at, at + n))
            at += n
        return ends

    found = []
    for _, t in rows:
        a = b = []
        if t:
            want = b" " + t.encode()
            a, b = lib.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
            xs = [name[i] for i in a]
            ys = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(xs) != want or b"".join(ys) != want:
                a = b = []
        if not a:
            found.append(([], [], [], ""))
            continue
        ra, rb = cut(map(len, xs)), cut(map(len, ys))
        links, j0 = [], 0
        for i, (s, e) in enumerate(ra):
            while rb[j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(rb) and rb[j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        shared = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, s = [], 0
        for e in shared:
            groups.append(",".join(str(i) for i, r in zip(a, ra, strict=True) if s < r[1] <= e) + "|" + ",".join(str(i) for i, r in zip(b, rb, strict=True) if s < r[1] <= e) if len(a) < 3000 else None)
            s = e
        found.append((a, b, links, shared if groups and groups[0] is None else groups))
    count = Counter(x for _, _, links, _ in found for x in links)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(n, best.get(y, 0))
    out = []
    for (k, _), (a, b, links, groups) in zip(rows, found, strict=True):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups and isinstance(groups[0], str) else None if groups else ""
        out.append((k, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest))
    return out, count, best


def same(got, want):
    known = Counter(w[:-1] for w in want)
    assert Counter(tuple(r)[:-1] for r in got) == known
    digests = Counter(w for w in want if w[-1] is not None)
    assert not digests - Counter(map(tuple, got))


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    same(A.align(docs.repartition(6), BYTE, PIECE).collect(), brute(rows)[0])


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "  two  blanks "), (6, "tab\there\nnew\r\nline\n\n\n"), (7, "<|endoftext|> and <s> and </s> plain"), (8, "▁ is a space there"), (9, "é ﬁ ﷺ ½"), (10, "日本語のテキスト 中文 한국어"),
    (11, "🙂👩‍🚀🇫🇷"), (12, "\x00\x01\x7f"), (13, "​﻿x"), (14, "xyz " * 20_000), (15, " " * 5000), (16, "a" * 5000), (17, "Ünïcödé " * 50), (18, "don't we'll I'm 12345 !!! ..."), (None, "null key"), (None, "null key"), (4, "a"), (19, "ࡰ\U0001df00Ᲊ new letters"), (20, "ⅷ ² ٣ 　 \x85 \xa0"),
]


def test_odd_texts_keys_and_columns(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"key": F.lit(1), "uri": F.lit("x"), "stripe": F.lit(None), "n_a": F.lit(3)})
    got = A.align(df.repartition(4), BYTE, PIECE)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same(got.collect(), brute(ODD)[0])


def test_an_empty_table(spark):
    assert A.align(spark.createDataFrame([], "doc_id long, text string"), BYTE, PIECE).collect() == []
    assert [tuple(r) for r in A.align(spark.createDataFrame([("x", None)], "doc_id string, text string"), BYTE, PIECE).collect()] == [("x", 0, 0, 0, 0, 0, 0, "")]


def test_counts_of_pairs_over_many_blocks(spark):
    rows = [(i, f"the number {i % 37} of the many, the café № {i % 5}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    shared = A.SharedSides(spark, BYTE, PIECE)
    pairs = A.write_blocks(df, shared, "doc_id", "text")
    assert pairs.select("uri").distinct().count() > 4
    _, count, best = brute(rows)
    got = A.pair_table(A.count_pairs(pairs, shared), shared).collect()
    assert {(r.a_id, r.b_id): r.links for r in got} == dict(count)
    assert all(r.best == (r.links == best[r.b_id]) for r in got)


@pytest.mark.parametrize("size", [1, 40, 1000])
def test_slices_hold_every_row_and_change_nothing(size, monkeypatch):
    monkeypatch.setattr(A, "SLICE_BYTES", size)
    texts = [t for _, t in ODD]
    cut = list(A._slices(pa.array(texts)))
    assert [t for *_, some in cut for t in some] == [t or "" for t in texts] and [s for s, *_ in cut] == [0, *[e for _, e, _ in cut[:-1]]]
    sides = A.Sides(open(BYTE, "rb").read(), open(PIECE, "rb").read())
    whole = A.align_texts([t or "" for t in texts], sides)
    parts = [A.align_texts(some, sides) for *_, some in cut]
    for n in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "code", "times"):
        assert [x for p in parts for x in p[n]] == list(whole[n])


def test_the_quick_encoder_is_the_librarys():
    sides = A.Sides(open(BYTE, "rb").read(), open(PIECE, "rb").read())
    texts = [t for _, t in ODD if t] + ["x" * 300 + " " * 300 + "1" * 300 + "é" * 300, "\n \n  x", "'S 's 'lL'll", "<|endoftext|>"]
    for t in texts:
        assert sides.encode_a(t).tolist() == sides.library.encode(" " + t, add_special_tokens=False).ids, t[:40]
