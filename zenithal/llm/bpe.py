"""BPE encoding by a table of distinct words, and decoding by a join of ids with their pieces.

Encoding. Spark splits every text into words (units that can be encoded alone, see ``tokens``) and counts them; counts are
combined before the shuffle, so a word that is everywhere is one row from each task. Words that occur more than once make
the table: each is encoded once, where Spark has put it. The table, most frequent words first, is broadcast up to
``table_words`` rows, which bounds it at any size of the corpus, and ids are joined back to the words at their positions.

A word that isn't in the table is encoded at its position. For a word that occurs once that is its only encoding. Only where
more than ``table_words`` words occur repeatedly, the rarest of them are encoded again at each position: a join of their
positions by shuffle would move every text once more, which costs more than the encoding of some words in a hundred.

Decoding. The table id -> piece (bounded by the vocabulary) is broadcast, and ids are joined with it by position: an id is the
row of its piece, so the join is a gather over whole Arrow batches.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zenithal.llm import tokens
from zenithal.session import materialize, ship

#: Words that are broadcast at most, and words or ids that a task joins at once.
TABLE_WORDS, SLICE = 1 << 19, 1 << 20


def units(text: Column, tokenizer: str) -> Column:
    """The words of a whole text in their order, as ``tokens.units`` has them; put together they are the text."""
    # A unit begins where a blank follows a non-blank; a split there costs less than half of matching each unit.
    begin = f"(?=[{tokens.BLANK}])(?<=[^{tokens.BLANK}])"
    words = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, begin, -1))
    special = tokens.special_names(tokenizer)
    if not special:
        return words(text)
    pattern = "|".join(map(re.escape, special))
    between = F.transform(F.split(text, pattern, -1), words)
    marked = F.zip_with(between, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda u, m: F.when(m.isNull(), u).otherwise(F.concat(u, F.array(m))))
    return F.when(functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(s)) for s in special]), F.flatten(marked)).otherwise(words(text))


def word_table(docs: DataFrame, tokenizer: str, text: str = "text", table_words: int = TABLE_WORDS, encoder: Callable = tokens.encoder) -> DataFrame:
    """(word, n, ids binary): the distinct words that occur more than once in all texts, how often, and their ids as
    little-endian 32-bit integers. Of more than ``table_words`` such words those of the higher counts (in steps of an eighth
    of a doubling) are taken. Null texts have no words; an empty table gives an empty result."""
    ship(docs.sparkSession)
    counts = docs.select(F.explode(units(F.col(f"`{text}`"), tokenizer)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = materialize(counts, "bpe-counts")
    step = F.floor(F.log2("n") * 8).cast("int")
    least, held = 1 << 30, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r.step):  # some hundred rows
        held += r.words
        if held > table_words:
            break
        least = r.step

    def encode(batches):
        one = encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(map(one, b.column(0).to_pylist())), pa.binary())], ["word", "n", "ids"])

    return materialize(counts.where(step >= least).select("word", "n").mapInArrow(encode, "word string, n long, ids binary"), "bpe-words")


class _Words:
    """The broadcast table as Arrow arrays."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    def arrays(self) -> tuple[pa.Array, pa.Array]:
        t = pa.ipc.open_stream(self.broadcast.value).read_all()
        return t.column("word").combine_chunks(), t.column("ids").combine_chunks()


def _packed(table: DataFrame) -> bytes:
    """The words and ids of a table as one compressed Arrow stream."""
    rows, sink = table.select("word", "ids").toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(rows, max_chunksize=1 << 16)
    return sink.getvalue().to_pybytes()


def join_ids(words: pa.Array, known: pa.Array, ids: pa.Array, one: Callable[[str], bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ends, ids) of all ``words``: those in ``known`` by a hash join, each other one encoded once for this batch."""
    at = pc.index_in(words, value_set=known)
    missing = np.nonzero(at.is_null().to_numpy(zero_copy_only=False))[0]
    if len(missing):
        new = words.take(pa.array(missing)).dictionary_encode()
        ids = pa.concat_arrays([ids, pa.array(list(map(one, new.dictionary.to_pylist())), pa.binary())])
        place = at.fill_null(0).to_numpy().astype(np.int32)
        place[missing] = new.indices.to_numpy() + len(known)
        at = pa.array(place)
    own = ids.take(at)
    ends = own.offsets.to_numpy() if hasattr(own, "offsets") else np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1]
    data = np.frombuffer(own.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(own) else np.zeros(0, np.uint8)
    return (ends - ends[0]).astype(np.int64) // 4 if len(own) else np.zeros(1, np.int64), data.view("<i4")


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", table_words: int = TABLE_WORDS, encoder: Callable = tokens.encoder) -> DataFrame:
    """(key, ids array<int>): the ids of every whole text, as the tokenizer's file gives them without special tokens added.

    Null and empty texts have no ids. Keys may be null or repeat; repeated rows give repeated rows. Other columns are not read,
    whatever their names. Long texts are split and encoded whole. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    shared = _Words(spark.sparkContext.broadcast(_packed(word_table(rows, tokenizer, "text", table_words, encoder))))
    pa.default_memory_pool().release_unused()  # the driver needs none of it from here on

    def place(batches):
        (known, ids), one = shared.arrays(), encoder(tokenizer)
        for b in batches:
            ends_of, at = b.column(1).offsets.to_numpy(), 0
            while at < b.num_rows:  # as many rows as hold SLICE words, one at least
                to = max(at + 1, int(np.searchsorted(ends_of, ends_of[at] + SLICE, "right")) - 1)
                rows_at = ends_of[at : to + 1] - ends_of[at]
                ends, found = join_ids(b.column(1).values.slice(ends_of[at], rows_at[-1]), known, ids, one)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.ListArray.from_arrays(pa.array(ends[rows_at].astype(np.int32)), pa.array(found))], ["key", "ids"])
                at = to

    return rows.select("key", units(F.col("text"), tokenizer).alias("units")).mapInArrow(place, f"key {kind}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` plus the text of its ids (special tokens included); null ids give null, no ids the empty text.

    Bytes that are no UTF-8 become U+FFFD. An id outside the vocabulary is an error. A column named as ``out`` is replaced."""
    ship(encoded.sparkSession)

    def join(column: pa.Array, pieces: pa.Array) -> pa.Array:
        ends, texts, at = column.offsets.to_numpy(), [pa.array([], pa.binary())], 0
        while at < len(column):  # as many rows as hold SLICE ids, one at least
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
            own = pieces.take(column.values.slice(ends[at], ends[to] - ends[at]))
            texts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends[at : to + 1] - ends[at], pa.int32()), own), b""))
            at = to
        whole = pa.concat_arrays(texts)
        try:
            whole = whole.cast(pa.string())
        except pa.ArrowInvalid:  # some ids alone are no UTF-8
            whole = pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())
        return pc.if_else(column.is_null(), pa.scalar(None, pa.string()), whole)

    def run(batches):
        pieces = tokens.piece_table(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], join(b.column(0), pieces)], names)

    rest = [c for c in encoded.columns if c != out]
    names = [*rest, out]
    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in rest)
    return encoded.select(F.col(f"`{ids}`").alias("_"), *[F.col(f"`{c}`") for c in rest]).mapInArrow(run, f"{kinds}, `{out}` string")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoding and decoding every text of ``docs``."""
    both = decode(encode(docs, tokenizer), tokenizer)
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Every text of ``documents`` encoded and decoded."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer)
