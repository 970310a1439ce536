"""Cross-tokenizer alignment: which tokens of a byte-level BPE (side A) meet which of a SentencePiece BPE (side B), and how often.

Both sides cut the same bytes, so the ends of all tokens of a text cut it into segments, each of which lies in one token of A
and one of B: the segments are the links, and the ends that both sides share cut the text into groups.

* Blocks. A task encodes texts and writes blocks to the shared folder: what each document has, and its links as (place in the
  block's list of distinct pairs, how often). Links stay there, they are never shuffled.
* Counts. What is shuffled are the distinct pairs of a block with their counts, by the stripe of their side-B id (``b % STRIPES``,
  so that frequent ids, which have neighbouring numbers, are spread). A stripe is one dense matrix of its B ids by all A ids
  (about 50 MB); ``np.add.at`` adds what comes, and the maxima of its rows tell each B id's highest count. Counts of a task
  are added up before they are sent, so a pair that is everywhere is one row from each task.
* Scores. Each block's pairs meet the counts of their stripe, which give every pair its count and whether it is its B id's best;
  these go back to the block, where they meet the links, document by document.
"""

from __future__ import annotations

import functools
import hashlib
import io
import json
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from zenithal.llm import files, tokens
from zenithal.session import materialize, shared_dir, ship

#: Stripes of the count matrix; bytes of text that are encoded at once, and that make a block (a longer text is one alone).
STRIPES, SLICE_BYTES, BLOCK_BYTES = 256, 1 << 21, 1 << 24
#: Pairs that one part of a stripe gives scores to, at most, and pairs that a task adds up before it sends their counts.
PART_PAIRS, HELD_PAIRS = 1 << 23, 1 << 22

#: How the byte-level tokenizers cut texts before they merge.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that every Unicode version knows alike; a text with others is left to the tokenizers library.
KNOWN = re.compile("[^\x00-ɏΑ-ΡΣ-Ωα-ωЀ-џ‐-‧ぁ-ゔァ-ヺ一-龥가-힣]")


class Sides:
    """Both tokenizers, the bytes of their ids, and the text that stands for an id in a digest of groups."""

    def __init__(self, byte_file: bytes, piece_file: bytes):
        made = json.loads(byte_file)
        self.library = Tokenizer.from_str(byte_file.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True  # their strings in a text are plain text
        byte_of = tokens._byte_table()
        vocab = {name: i for name, i in made["model"]["vocab"].items()}
        added = {t["id"] for t in made["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in name): i for name, i in vocab.items() if i not in added}
        self.quick = tiktoken.Encoding("a", pat_str=CUT, mergeable_ranks=ranks, special_tokens={}) if _by_rank(made, vocab, added) else None
        pieces_a = {i: x for x, i in ranks.items()} | {t["id"]: t["content"].encode() for t in made["added_tokens"]}
        self.bytes_a = _table(pieces_a)
        self.pieces = p = sentencepiece.SentencePieceProcessor(model_proto=piece_file)
        size = p.get_piece_size()
        self.bytes_b = _table({i: bytes([int(p.id_to_piece(i)[3:-1], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(size)})
        self.n_a, self.n_b = len(self.bytes_a), len(self.bytes_b)
        self.size_a, self.size_b = (pc.binary_length(x).to_numpy() for x in (self.bytes_a, self.bytes_b))
        # An id of A with "," or, at the end of its group, "|"; then those of B with "," or ";".
        self.names = pa.array([f"{i}{s}".encode() for n, ends in ((self.n_a, ",|"), (self.n_b, ",;")) for i in range(n) for s in ends], pa.large_binary())
        self.rows = -(-self.n_b // STRIPES)

    def encode_a(self, text: str) -> np.ndarray:
        """The ids of a space and the text."""
        if self.quick is not None and not KNOWN.search(text):
            return self.quick.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
        return np.array(self.library.encode(" " + text, add_special_tokens=False).ids, np.int64)

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.pieces.encode(texts, num_threads=1)

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A number for each pair, in order of stripe, row in the stripe, and A id."""
        return ((b % STRIPES) * self.rows + b // STRIPES) * self.n_a + a


def _by_rank(made: dict, vocab: dict[str, int], added: set[int]) -> bool:
    """Whether merges come in the order of the ids they make, and cutting is the byte-level one, so ids alone tell the merges."""
    kind = made["pre_tokenizer"] or {}
    plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not made["normalizer"] and made["model"]["type"] == "BPE" and not made["model"].get("byte_fallback")
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in made["model"]["merges"]]
    got = [vocab[x] for x in joined]
    return plain and got == sorted(set(got)) and {i for i in vocab.values() if i not in added} == {*range(len(vocab) - len(added & {*vocab.values()}))} and len(got) + 256 == len(vocab) - len(added & {*vocab.values()})


def _table(of: dict[int, bytes]) -> pa.Array:
    return pa.array([of.get(i, b"") for i in range(max(of) + 1)], pa.large_binary())


@functools.lru_cache(maxsize=2)
def _sides(digest: str, byte_file: bytes, piece_file: bytes) -> Sides:
    return Sides(byte_file, piece_file)


class SharedSides:
    """The contents of both vocabulary files, broadcast; loaded once in a process. Only the driver needs the paths."""

    def __init__(self, spark: SparkSession, byte_path: str, piece_path: str):
        with open(byte_path, "rb") as a, open(piece_path, "rb") as b:
            own = (a.read(), b.read())
        self.digest, self.files = hashlib.sha256(own[0] + own[1]).hexdigest(), spark.sparkContext.broadcast(own)

    def load(self) -> Sides:
        return _sides(self.digest, *self.files.value)


def _bytes(ids: np.ndarray, table: pa.Array) -> bytes:
    """The bytes of all ``ids`` in a row."""
    if not len(ids):
        return b""
    got = table.take(pa.array(ids))
    ends = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(got) + 1]
    return bytes(memoryview(got.buffers()[2] or b"")[int(ends[0]) : int(ends[-1])])  # a buffer may be longer


def align_texts(texts: list[str], sides: Sides) -> dict[str, np.ndarray | list[str]]:
    """Of distinct texts: n_a, n_b, n_groups, n_links, groups_sha256, and of their links the distinct ones of each text:
    ``code`` (ascending within a text), ``times``, and ``ends`` (where each text's end). Texts that are empty or that a side
    does not give back byte by byte have no tokens."""
    raw = [b" " + t.encode() for t in texts]
    some_a = [sides.encode_a(t) if t else np.zeros(0, np.int64) for t in texts]
    some_b = [np.array(x, np.int64) for x in sides.encode_b(texts)]
    for i, t in enumerate(texts):
        if t and (_bytes(some_a[i], sides.bytes_a) != raw[i] or _bytes(some_b[i], sides.bytes_b) != raw[i]) or not t:
            some_a[i] = some_b[i] = np.zeros(0, np.int64)
    a, b = np.concatenate([*some_a, np.zeros(0, np.int64)]), np.concatenate([*some_b, np.zeros(0, np.int64)])
    n_a, n_b = (np.array([len(x) for x in s], np.int64) for s in (some_a, some_b))
    stop = np.cumsum([len(r) if n else 0 for r, n in zip(raw, n_a.tolist(), strict=True)], dtype=np.int64)
    end_a, end_b = np.cumsum(sides.size_a[a]), np.cumsum(sides.size_b[b])
    at_a, at_b = (np.zeros(int(stop[-1]) + 1 if len(stop) else 1, bool) for _ in "ab")
    at_a[end_a], at_b[end_b] = True, True
    both, any_ = at_a & at_b, at_a | at_b
    upto_a, upto_b, upto_both, upto_any = (np.cumsum(x) for x in (at_a, at_b, both, any_))
    per = lambda upto: np.diff(upto[stop], prepend=0)
    n_groups, n_links = per(upto_both), per(upto_any)

    # Digests: tokens in the order of their groups, A before B.
    shared = np.nonzero(both)[0]
    before_b, upto_a_of = np.concatenate([[0], upto_b[shared]]), np.concatenate([[0], upto_a[shared]])
    group_a, group_b = upto_both[end_a] - both[end_a], upto_both[end_b] - both[end_b]
    name = np.zeros(len(a) + len(b), np.int64)
    name[np.arange(len(a)) + before_b[group_a]] = 2 * a + both[end_a]
    name[np.arange(len(b)) + upto_a_of[group_b + 1]] = 2 * sides.n_a + 2 * b + both[end_b]
    told = sides.names.take(pa.array(name))
    data, places = memoryview(told.buffers()[2] or b""), np.frombuffer(told.buffers()[1], np.int64)[told.offset :] if len(told) else np.zeros(1, np.int64)
    cuts = places[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    digests = [hashlib.sha256(data[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    # Links: the segments, as the pair of tokens that each lies in; equal ones of a text are one.
    segment = np.nonzero(any_)[0]
    code = sides.code(a[upto_a[segment] - at_a[segment]], b[upto_b[segment] - at_b[segment]]) if len(segment) else np.zeros(0, np.int64)
    most = STRIPES * sides.rows * sides.n_a
    key = np.repeat(np.arange(len(texts), dtype=np.int64), n_links) * most + code
    key.sort()
    first = np.nonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))[0]
    ends = np.searchsorted(key[first], np.arange(1, len(texts) + 1, dtype=np.int64) * most)
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digests, "code": key[first] % most, "times": np.diff(first, append=len(key)), "ends": ends}


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


class _Block:
    """Documents of a task until they make a block."""

    def __init__(self, sides: Sides):
        self.sides, self.size = sides, 0
        self.keys, self.text_of, self.parts, self.texts = [], [], [], 0
        self.code, self.times, self.ends, self.copies = [], [], [], []

    def add(self, keys: pa.Array, texts: list[str]) -> None:
        """Rows of one slice; equal texts of it are encoded once."""
        numbers: dict[str, int] = {}
        of = np.array([numbers.setdefault(t, len(numbers)) for t in texts], np.int64)
        got = align_texts(list(numbers), self.sides)
        copies = np.bincount(of, minlength=len(numbers))
        self.keys.append(keys)
        self.text_of.append(of + self.texts)
        self.parts.append(got)
        self.ends.append(got["ends"] + sum(map(len, self.code)))
        self.code.append(got["code"])
        self.times.append(got["times"])
        self.copies.append(np.repeat(copies, np.diff(got["ends"], prepend=0)))
        self.texts += len(numbers)
        self.size += sum(map(len, numbers))

    def close(self, folder: str) -> tuple[str, np.ndarray, np.ndarray]:
        """Write the block; gives its path, its distinct pairs in order of their code, and how often each occurs."""
        code, times = np.concatenate(self.code), np.concatenate(self.times)
        pairs, place = np.unique(code, return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, place, times * np.concatenate(self.copies))
        of = np.concatenate(self.text_of)
        ends = np.concatenate(self.ends)
        docs = {"key": pa.concat_arrays(self.keys), "text": pa.array(of)}
        docs |= {n: pa.array(np.concatenate([p[n] for p in self.parts])[of]) for n in _NUMBERS}
        docs["groups_sha256"] = pa.array([x for p in self.parts for x in p["groups_sha256"]], pa.string()).take(pa.array(of))
        step = np.diff(place.astype(np.int64), prepend=0).astype(np.int32)  # small within a text, so it packs well
        body = b"".join(_stream(pa.table(t)) for t in (docs, {"ends": pa.array(ends)}, {"step": pa.array(step), "times": pa.array(times.astype(np.int32))}))
        uri = f"{folder}/{uuid.uuid4().hex}.links"
        files.write(uri, body)
        return uri, pairs, counts


def _stream(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return struct.pack("<Q", sink.tell()) + sink.getvalue()


def _streams(data: bytes) -> Iterator[pa.Table]:
    at = 0
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        yield pa.ipc.open_stream(memoryview(data)[at + 8 : at + 8 + n]).read_all()
        at += 8 + n


def _slices(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """(from, to, texts) of rows that hold ``SLICE_BYTES`` together, one row at least."""
    at, n = 0, len(column)
    while at < n:
        to, size, texts = at, 0, []
        while to < n and (to == at or size < SLICE_BYTES):
            t = column[to].as_py() or ""
            texts.append(t)
            size += len(t)
            to += 1
        yield at, to, texts
        at = to


def write_blocks(docs: DataFrame, shared: SharedSides, key: str, text: str) -> DataFrame:
    """(uri, stripe, codes, counts), a written table: for each block and stripe the distinct pairs (code within the stripe, unsigned
    32-bit integers) and how often they are linked in it (64-bit integers). A block without links has one empty row."""
    folder = shared_dir(docs.sparkSession, "align")

    def rows(block: _Block):
        uri, pairs, counts = block.close(folder)
        width = block.sides.rows * block.sides.n_a
        stripe = pairs // width
        which, starts = np.unique(stripe, return_index=True)
        which, starts = (which, [*starts.tolist(), len(pairs)]) if len(pairs) else (np.zeros(1, np.int64), [0, 0])
        cut = list(zip(starts[:-1], starts[1:], strict=True))
        local = (pairs % width).astype("<u4")
        return pa.RecordBatch.from_arrays([pa.array([uri] * len(cut)), pa.array(which.astype(np.int32)), pa.array([local[s:e].tobytes() for s, e in cut], pa.binary()), pa.array([counts[s:e].astype("<i8").tobytes() for s, e in cut], pa.binary())], ["uri", "stripe", "codes", "counts"])

    def run(batches):
        sides = shared.load()
        block = _Block(sides)
        for b in batches:
            for s, e, texts in _slices(b.column(1)):
                block.add(b.column(0).slice(s, e - s), texts)
                if block.size >= BLOCK_BYTES:
                    yield rows(block)
                    block = _Block(sides)
        if block.keys:
            yield rows(block)

    some = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return materialize(some.mapInArrow(run, "uri string, stripe int, codes binary, counts binary"), "align-pairs")


def _added(batches):
    """(stripe, codes, counts) with the counts of a task added up, a bounded number of pairs at a time."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def out():
        for stripe, parts in held.items():
            codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.zeros(len(codes), "<i8")
            np.add.at(counts, place, np.concatenate([p[1] for p in parts]))
            yield pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([codes.astype("<u4").tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["stripe", "codes", "counts"])

    for b in batches:
        for stripe, codes, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            own = np.frombuffer(codes.as_buffer(), "<u4").copy(), np.frombuffer(counts.as_buffer(), "<i8").copy()
            if len(own[0]):
                held.setdefault(stripe, []).append(own)
                size += len(own[0])
        if size >= HELD_PAIRS:
            yield from out()
            held, size = {}, 0
    yield from out()


def count_pairs(pairs: DataFrame, shared: SharedSides) -> DataFrame:
    """(stripe, codes, counts, best), a written table of one row for each stripe: all its pairs in order of their code, how
    often each is linked in all documents, and whether that is the highest count of its B id (a byte each; ties are all best)."""

    def run(batches):
        sides, stripe, block = shared.load(), None, None

        def out():
            flat = block.reshape(-1)
            codes = np.nonzero(flat)[0]
            best = flat[codes] == block.max(axis=1)[codes // sides.n_a]
            return pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (codes.astype("<u4"), flat[codes].astype("<i8"), best.astype(np.uint8))]], ["stripe", "codes", "counts", "best"])

        for b in batches:
            for s, codes, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if s != stripe:
                    if block is not None:
                        yield out()
                    stripe, block = s, np.zeros((sides.rows, sides.n_a), np.int64)
                np.add.at(block.reshape(-1), np.frombuffer(codes.as_buffer(), "<u4"), np.frombuffer(counts.as_buffer(), "<i8"))
        if block is not None:
            yield out()

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = pairs.select("stripe", "codes", "counts").mapInArrow(_added, "stripe int, codes binary, counts binary")
    dealt = sent.repartition(n, "stripe").sortWithinPartitions("stripe")
    return materialize(dealt.mapInArrow(run, "stripe int, codes binary, counts binary, best binary"), "align-counts")


def pair_table(counts: DataFrame, shared: SharedSides) -> DataFrame:
    """(a_id, b_id, links, best): every pair that is linked anywhere."""

    def run(batches):
        sides = shared.load()
        for b in batches:
            for stripe, *parts in zip(b.column(0).to_pylist(), *b.columns[1:], strict=True):
                codes, n, best = (np.frombuffer(p.as_buffer(), t) for p, t in zip(parts, ("<u4", "<i8", np.uint8), strict=True))
                row, a = np.divmod(codes.astype(np.int64), sides.n_a)
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array((row * STRIPES + stripe).astype(np.int32)), pa.array(n), pa.array(best.astype(bool))], ["a_id", "b_id", "links", "best"])

    return counts.mapInArrow(run, "a_id int, b_id int, links long, best boolean")


def _scores(batches):
    """Rows sorted by (stripe, part, kind): the counts of a stripe (no uri), then pairs of blocks, each of which gets its counts."""
    known, n, best = (np.zeros(0, np.int64),) * 3
    for b in batches:
        uris, stripes = b.column(0).to_pylist(), b.column(1).to_pylist()
        for i, (uri, stripe) in enumerate(zip(uris, stripes, strict=True)):
            codes = np.frombuffer(b.column(2)[i].as_buffer(), "<u4")
            if uri is None:
                known, n, best = codes.copy(), np.frombuffer(b.column(3)[i].as_py(), "<i8"), np.frombuffer(b.column(4)[i].as_py(), np.uint8)
                continue
            at = np.searchsorted(known, codes)
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([stripe], pa.int32()), pa.array([n[at].tobytes()], pa.binary()), pa.array([best[at].tobytes()], pa.binary())], ["uri", "stripe", "counts", "best"])


def _documents(kind: pa.DataType):
    schema = pa.schema([("key", kind), *[(n, pa.int64()) for n in (*_NUMBERS, "n_best", "count_sum")], ("groups_sha256", pa.string())])

    def block(uri: str, counts: list[bytes], best: list[bytes]):
        docs, ends, links = _streams(files.read(uri))
        n, good = np.frombuffer(b"".join(counts), "<i8"), np.frombuffer(b"".join(best), np.uint8)
        place, times = np.cumsum(links["step"].to_numpy(), dtype=np.int64), links["times"].to_numpy().astype(np.int64)
        cuts = np.concatenate([[0], ends["ends"].to_numpy()])
        upto = [np.concatenate([[0], np.cumsum(x[place] * times)]) if len(place) else np.zeros(1, np.int64) for x in (good.astype(np.int64), n)]
        of = docs["text"].to_numpy()
        per = [(u[cuts[1:]] - u[cuts[:-1]])[of] for u in upto]
        return pa.Table.from_arrays([docs["key"], *[docs[x] for x in _NUMBERS], *map(pa.array, per), docs["groups_sha256"]], schema=schema).to_batches(max_chunksize=1 << 14)

    def run(batches):
        uri, counts, best = None, [], []
        for b in batches:
            for u, n, g in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if u != uri:
                    if uri is not None:
                        yield from block(uri, counts, best)
                    uri, counts, best = u, [], []
                counts.append(n.as_py())
                best.append(g.as_py())
        if uri is not None:
            yield from block(uri, counts, best)

    return run


def align(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    ``n_best``: links whose pair has the highest count of its B id in all rows, ties included; ``count_sum``: of the counts of
    its links. Null and empty texts, and those that a side does not give back byte by byte, have no tokens: zeros and an
    empty digest. Texts are encoded whole, the strings of special tokens as plain text. Keys may be null or repeat; repeated
    rows give repeated rows and count each. An empty table gives an empty result. Other columns are not read, whatever their
    names.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = SharedSides(spark, byte_path, piece_path)
    pairs = write_blocks(docs, shared, key, text)
    counts = count_pairs(pairs, shared)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = pairs.agg(F.sum(F.length("codes"))).first()[0] or 0
    parts = max(1, -(-total // (4 * PART_PAIRS * STRIPES)))
    asked = pairs.select("uri", "stripe", "codes", F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("best"), F.pmod(F.xxhash64("uri"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"))
    known = counts.select(F.lit(None).cast("string").alias("uri"), "stripe", "codes", "counts", "best", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"))
    dealt = asked.unionByName(known).repartition(n, "stripe", "part").sortWithinPartitions("stripe", "part", "kind")
    scores = dealt.select("uri", "stripe", "codes", "counts", "best").mapInArrow(_scores, "uri string, stripe int, counts binary, best binary")
    back = scores.repartition(n, "uri").sortWithinPartitions("uri", "stripe")
    kind = docs.schema[key].dataType.simpleString()
    columns = ", ".join(f"{x} long" for x in (*_NUMBERS, "n_best", "count_sum"))
    from pyspark.sql.pandas.types import to_arrow_type

    out = back.mapInArrow(_documents(to_arrow_type(docs.schema[key].dataType)), f"key {kind}, {columns}, groups_sha256 string")
    return out.withColumnRenamed("key", key)


def op13_alignment(spark: SparkSession, sf_dir: str, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """Every text of ``documents`` by both tokenizers."""
    if byte_path is None or piece_path is None:
        import public_tokenizers

        byte_path, piece_path = byte_path or public_tokenizers.path("byte_bpe_50k.json"), piece_path or public_tokenizers.path("piece_bpe_32k.model")
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_path, piece_path)
