"""SimHash near-duplicates: 64-bit fingerprints linked at a small Hamming distance, found with vantage-point trees.

Fingerprints. A text is lower-cased (A-Z), cut into words, and every ``shingle`` consecutive words, repeats included, are
hashed (XXH64, seed 42). A bit of the fingerprint is 1 if it is set in over half of the hashes.

Links. Distances of unrelated fingerprints from any vantage point lie close to 32 (+-4), so in one tree over all 64 bits the
triangle bound with a radius of 4 cuts hardly anything. The bits are therefore cut into runs, and there is a tree for each of
several choices of runs (:func:`masks`), made so that every pair with at most ``radius`` differing bits has at most
``SLACK`` of them under the mask of one choice. Each tree is a vantage-point tree of the Hamming distance d under its mask:

* A node has a vantage point v and a radius m, the median distance; rows with d(x, v) <= m are stored in its inner branch, others
  in its outer one, down to leaves, the shards. Points and medians come from a bounded sample, below it from keyed points.
* Where d_mask(x, y) <= SLACK, the triangle inequality gives |d(x, v) - d(y, v)| <= SLACK. So a row also queries a branch
  that it isn't stored in if it lies within SLACK of the boundary, and every other branch is pruned.

The two of a pair are stored together until a boundary parts them; there the outer one lies within SLACK of it, queries the
inner branch, and follows the inner one down to its shard. So each pair meets in a shard of one tree at least. In a shard all
stored rows are compared exactly, over all 64 bits, with each other and with the shard's queries.

Skew. Equal fingerprints are one row from the start. A shard with more than ``shard_rows`` rows is cut into that many
chunks and each pair of chunks is compared in a task of its own. A comparison returns a spanning forest of its links, never
all pairs, which is all that components need; no link is lost.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zenithal.llm import jaccard
from zenithal.llm.components import connected_components
from zenithal.llm.skew import join_counted
from zenithal.session import materialize, ship

SHARD_ROWS = 4096
#: Rows that a tree stores in a shard, about; differing bits of a pair under the mask of its tree, at most; rows that trees
#: are fitted on, at most; sample rows that a node needs for a vantage point of its own.
LEAF_ROWS, SLACK, SAMPLE, FIT_ROWS = 2048, 1, 1 << 14, 32
#: Members of a group of the index that all others are compared with before any pairs are; it changes no result.
PIVOTS = 8


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 without any."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    whole = hashes.astype(">u8")
    for at in range(0, n, 65536):
        ones += np.unpackbits(whole[at : at + 65536].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint of one whole text; 0 without words."""
    return fingerprint_of(jaccard.hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(key, fp) with fp as a signed long, one row for each row of ``docs``; other columns are not read."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["key", "fp"])

    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"key {kind}, fp long")


def runs_for(n: int, radius: int = 4) -> int:
    """The least number of runs at which masks have two bits more than n fingerprints need to be told apart."""
    b = radius + 1
    while b < 60 and 64 * (b - radius + SLACK) / b < math.log2(max(n, 1)) + 2:
        b += 1
    return b


def masks(runs: int, radius: int = 4) -> list[int]:
    """Masks that leave out ``radius - SLACK`` runs each: wherever up to ``radius`` bits lie, one mask has at most SLACK of them."""
    cuts = [round(64 * i / runs) for i in range(runs + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    out = max(radius - SLACK, 0)
    open_cases = {tuple(c.count(i) for i in range(runs)) for c in combinations_with_replacement(range(runs), radius)}
    choices, found = list(combinations(range(runs), out)), []
    while open_cases:  # a greedy cover
        fits = lambda c: [x for x in open_cases if radius - sum(x[i] for i in c) <= SLACK]  # noqa: E731, B023
        best = max(choices, key=lambda c: len(fits(c)))
        open_cases -= set(fits(best))
        found.append(sum(bits[i] for i in range(runs) if i not in best))
    return found


def _keyed(node: np.ndarray, seed: int) -> np.ndarray:
    """Pseudo-random 64-bit numbers of node numbers (the mixing steps of splitmix64)."""
    z = (node.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@dataclass(frozen=True)
class Tree:
    """A vantage-point tree of ``depth`` levels. The children of node i are 2 i (inner) and 2 i + 1 (outer), the root is 1; a
    radius of -1 stands for a node below the sample, whose vantage point is keyed and whose radius is half the mask's bits."""

    mask: int
    depth: int
    points: np.ndarray
    radii: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, mask: int, depth: int) -> Tree:
        levels = min(depth, max(0, int(math.log2(max(len(sample), 1) / FIT_ROWS)) + 1)) if len(sample) >= FIT_ROWS else 0
        points, radii = np.zeros(1 << levels, np.uint64), np.full(1 << levels, -1, np.int64)
        held = {1: sample & np.uint64(mask)}
        for node in range(1, 1 << levels):
            own = held.pop(node, sample[:0])
            if len(own) < FIT_ROWS:
                continue
            # Of some candidates the one whose distances are spread most: fewest rows lie at its boundary.
            tried = own[_keyed(np.arange(8), node) % np.uint64(len(own))]
            d = np.bitwise_count(own[None] ^ tried[:, None]).astype(np.int64)
            best = int(d.var(axis=1).argmax())
            points[node], radii[node] = tried[best], int(np.median(d[best]))
            inner = d[best] <= radii[node]
            held[2 * node], held[2 * node + 1] = own[inner], own[~inner]
        return cls(mask, depth, points, radii)

    def distances(self, fps: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distance of each row from its node's vantage point, and the node's radius."""
        known = np.minimum(node, len(self.points) - 1)
        fitted = (node < len(self.points)) & (self.radii[known] >= 0)
        point = np.where(fitted, self.points[known], _keyed(node, self.mask & 0xFFFFFFFF))
        d = np.bitwise_count((fps ^ point) & np.uint64(self.mask)).astype(np.int64)
        return d, np.where(fitted, self.radii[known], self.mask.bit_count() // 2)

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, side) for every shard that a row is stored in (side 0, one) or queries (side 1)."""
        row, node, side = np.arange(len(fps)), np.ones(len(fps), np.int64), np.zeros(len(fps), np.int64)
        for _ in range(self.depth):
            d, radius = self.distances(fps[row], node)
            inner = d <= radius
            # A stored row only queries inwards: the inner one of a pair is met by the outer one.
            across = np.where(inner, (side == 1) & (d > radius - SLACK), d <= radius + SLACK)
            row, node, side = (
                np.concatenate([row, row[across]]), np.concatenate([2 * node + ~inner, 2 * node[across] + inner[across]]), np.concatenate([side, np.ones(int(across.sum()), np.int64)]),
            )
        return row, node, side


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component, given links (i, j)."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return root
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def _links(fps: np.ndarray, radius: int, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the first ``left`` of fps and those from ``right`` on, each pair once, as a spanning forest."""
    x, found_i, found_j = fps.view(np.uint64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, left, 512):
        first = max(right, at)
        i, j = np.nonzero(np.bitwise_count(x[at : min(at + 512, left), None] ^ x[None, first:]) <= radius)
        i, j = i + at, j + first
        keep = i < j
        found_i.append(i[keep])
        found_j.append(j[keep])
    root = forest(len(x), np.concatenate(found_i), np.concatenate(found_j))
    linked = np.nonzero(root != np.arange(len(x)))[0]
    return fps[linked], fps[root[linked]]


def _compare(rows: DataFrame, radius: int, n: int) -> DataFrame:
    """Spanning forests of the links within each (tree, leaf, cell); rows come as (tree, leaf, cell, side, fp).

    Cell 0 is a whole shard: stored rows (side 0) meet each other and its queries. Others are pairs of chunks, of which side
    0 meets side 1, or all rows each other if there is no side 1."""

    def run(batches):
        # Rows of a cell stand together; a cell that goes over the end of a batch is carried on.
        kept = None
        for b in batches:
            t = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)])
            kept = t if kept is None else np.concatenate([kept, t], axis=1)
            ends = np.nonzero((kept[:3, 1:] != kept[:3, :-1]).any(axis=0))[0] + 1
            if len(ends):
                done, kept = kept[:, : ends[-1]], kept[:, ends[-1] :]
                yield from cells(done, np.concatenate([[0], ends]))
        if kept is not None and kept.shape[1]:
            yield from cells(kept, np.array([0, kept.shape[1]]))

    def cells(t, cuts):
        out_a, out_b = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                first = int((t[3, a:b] == 0).sum())
                u, v = _links(t[4, a:b], radius, first, first if t[2, a] and first < b - a else 0)
                out_a.append(u)
                out_b.append(v)
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    dealt = rows.repartition(n, "tree", "leaf", "cell").sortWithinPartitions("tree", "leaf", "cell", "side", "fp")
    return dealt.select("tree", "leaf", "cell", "side", "fp").mapInArrow(run, "a long, b long")


def link_forest(fps: DataFrame, radius: int = 4, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE) -> DataFrame:
    """Links (a, b) between the distinct values of ``fp`` at ``radius`` or fewer differing bits, as spanning forests of the
    shards: components over them are those over all links. Null fingerprints link with nothing. An empty table gives an empty result."""
    spark = fps.sparkSession
    ship(spark)
    distinct = materialize(fps.where("fp is not null").select("fp").distinct(), "simhash-fps")
    total = distinct.count()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).toArrow().column(0).to_numpy().view(np.uint64) if total else np.zeros(0, np.uint64)
    depth = max(0, math.ceil(math.log2(max(total, 1) / leaf_rows)))
    trees = spark.sparkContext.broadcast([Tree.fit(some, m, depth) for m in masks(runs_for(total, radius), radius)])

    def route(batches):
        for b in batches:
            own = b.column(0).to_numpy().view(np.uint64)
            for k, tree in enumerate(trees.value):
                row, leaf, side = tree.route(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), k, np.int32)), pa.array(leaf), pa.array(side.astype(np.int32)), pa.array(own[row].view(np.int64))], ["tree", "leaf", "side", "fp"])

    rows = distinct.mapInArrow(route, "tree int, leaf long, side int, fp long")
    sizes = rows.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(sizes.withColumn("chunks", F.ceil(F.col("n") / (4 * shard_rows)).cast("int")), "simhash-shards")
    rows = rows.join(sizes.drop("n"), ["tree", "leaf"])
    small = rows.where("chunks = 1").select("tree", "leaf", F.lit(0).cast("long").alias("cell"), "side", "fp")
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    large = rows.where("chunks > 1").withColumn("c", chunk).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cell = F.least("c", "o").cast("long") * F.lit(1 << 31) + F.greatest("c", "o") + 1
    large = large.select("tree", "leaf", cell.alias("cell"), (F.col("c") > F.col("o")).cast("int").alias("side"), "fp")
    return _compare(small.unionByName(large), radius, n)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(key, fp, component) for each row of ``docs``: component is the smallest key whose text is reachable by links.

    Texts that are null or have no words have fingerprint 0 and link like any other. Rows with a null key get the component
    of their text's links, but never name one (null if they only link with each other). Repeated keys give repeated rows.
    Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, key, text, shingle), "simhash-docs")
    least = rows.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("copies"))
    root = connected_components(link_forest(rows, radius))
    # One row per distinct fingerprint: the root of its component, and the smallest key there.
    classes = materialize(least.join(root, least["fp"] == root["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"), "least", "copies"), "simhash-classes")
    names = classes.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("members"))
    named = materialize(join_counted(classes, names, "root", "members").select("fp", "component", "copies"), "simhash-named")
    return join_counted(rows, named, "fp", "copies").select("key", "fp", "component")


def similar_texts(docs: DataFrame, text: str = "text", shingle: int = 5, radius: int = 4) -> DataFrame:
    """(digest, copies, root) for each distinct text of ``docs``: texts with one root are linked by pairs whose sets of
    ``shingle`` words have a Jaccard similarity of at least 0.8.

    Fingerprints at ``radius`` or fewer differing bits are candidates, found by the trees; so are texts that share a shingle
    of the index of prefixes (see ``jaccard``), as a pair at 0.8 may differ in more bits than trees can look for. Every link is
    decided by whole sets. Candidates of one group are first compared with its least and its greatest member, then, where it has
    members of several components, with ``PIVOTS`` more; after that only pairs that are still of different components, whose
    smaller text has a shingle of the group in its early prefix, and whose marks leave 4/5 possible.

    ``digest`` is SHA-256 of the text, ``copies`` the number of rows that have it; null counts as empty, and texts without
    words are alike. Other columns are not read. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digest = F.sha2(body, 256)
    order = docs.sparkSession.sparkContext.broadcast(jaccard.Order(jaccard.frequent(docs, body, shingle)))

    def sketch(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, jaccard.BATCH):
                b = whole.slice(at, jaccard.BATCH)
                every = [jaccard.hashes(t, shingle) for t in b.column(1).to_pylist()]
                sets = [np.unique(h.view(np.int64)) for h in every]
                fps = np.array([fingerprint_of(h) for h in every], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), pa.array([len(s) for s in sets], pa.int64()), jaccard.lists([order.value.prefix(s) for s in sets]), jaccard.wide_marks(sets), *jaccard.marks(sets)], ["digest", "fp", "n", "prefix", "wide", *jaccard.MARKS])

    rows = docs.select(digest.alias("digest"), body.alias("text")).mapInArrow(sketch, "digest string, fp long, n long, prefix array<long>, wide binary, " + ", ".join(f"{m} long" for m in jaccard.MARKS))
    once = rows.groupBy("digest").agg(F.first(F.struct("fp", "n", "prefix", "wide", *jaccard.MARKS)).alias("s"), F.count(F.lit(1)).alias("copies"))
    texts = materialize(once.select(F.monotonically_increasing_id().alias("id"), "digest", "copies", "s.*"), "simhash-texts")
    confirm = lambda pairs: jaccard.confirm(pairs, texts, docs, digest, body, shingle)

    # Candidates by fingerprints: equal ones with the least text that has it, others as the trees link them.
    named = materialize(texts.where("n > 0").groupBy("fp").agg(F.min(F.struct("id", "n")).alias("m"), F.count(F.lit(1)).alias("members")), "simhash-least")
    same = join_counted(texts.where("n > 0").select("fp", "id", "n"), named, "fp", "members")
    same = same.select(F.col("m.id").alias("a"), F.col("id").alias("b"), F.col("m.n").alias("na"), F.col("n").alias("nb")).where("a <> b")
    forest_of = materialize(link_forest(named.select("fp"), radius), "simhash-links")
    ends = [named.select(F.col("fp").alias(x), F.col("m.id").alias(f"i{x}"), F.col("m.n").alias(f"n{x}")) for x in "ab"]
    close = forest_of.join(ends[0], "a").join(ends[1], "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"), "na", "nb")

    # Candidates by the index of prefixes: with the least and the greatest member of each of its groups.
    group = W.partitionBy("h")
    met = texts.select(F.posexplode("prefix").alias("at", "h"), "id", "n").withColumn("early", F.col("at") < jaccard.early(F.col("n")))
    member = F.struct("id", "n")
    met = met.withColumn("size", F.count(F.lit(1)).over(group)).withColumn("least", F.min(member).over(group)).withColumn("greatest", F.max(member).over(group))
    met = met.withColumn("of", F.bit_xor(F.xxhash64("id")).over(group)).where("size > 1")
    # Shingles of one passage have the same members: such groups are one, which counts for as many shingles.
    met = met.groupBy("of", "size", "id", "n", "least", "greatest").agg(F.count(F.lit(1)).alias("w"), F.max("early").alias("early"))
    # A text without a member of a fitting size, which would be next to it by size, has no pair in the group.
    group = W.partitionBy("of", "size")
    sizes, n = group.orderBy("n"), F.col("n")
    fits = F.coalesce(5 * F.lag("n").over(sizes) >= 4 * n, F.lit(False)) | F.coalesce(5 * n >= 4 * F.lead("n").over(sizes), F.lit(False))
    met = materialize(met.withColumn("fits", fits).where("fits").drop("fits"), "jaccard-index")
    star = lambda end: met.select(F.col(f"{end}.id").alias("a"), F.col("id").alias("b"), F.col(f"{end}.n").alias("na"), F.col("n").alias("nb"), "w").where("a <> b")
    stars = jaccard.count_shared(star("least")).unionByName(jaccard.count_shared(star("greatest")))
    turned = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"))
    links = confirm(turned(jaccard.alike(same.unionByName(close)).unionByName(stars)))
    blank = texts.where("n = 0").select("id")
    none = blank.agg(F.min("id")).first()[0]
    links = links if none is None else links.unionByName(blank.where(F.col("id") != none).select(F.lit(none).alias("a"), F.col("id").alias("b")))

    # What is left: groups of the index with members of several components. Those of near copies have most of their pairs linked,
    # so comparing all members with a few, the same in each group that has them, leaves hardly any to be compared with all.

    def several(rows: DataFrame) -> DataFrame:
        root = connected_components(links).withColumnRenamed("node", "id")
        rows = rows.join(root, "id", "left").withColumn("root", F.coalesce("component", "id")).drop("component")
        return rows.withColumn("mixed", F.min("root").over(group) != F.max("root").over(group)).where("mixed").drop("mixed")

    def end(rows: DataFrame, x: str) -> DataFrame:
        return rows.select("of", "size", F.col("early").alias(f"e{x}"), F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("root").alias(f"r{x}"), F.struct(*jaccard.MARKS).alias(f"m{x}"))

    columns = ["of", "size", "early", "id", "n"]
    mixed = materialize(several(met.select(*columns)).join(texts.select("id", *jaccard.MARKS), "id"), "jaccard-mixed")
    pivots = mixed.withColumn("k", F.row_number().over(group.orderBy(F.xxhash64("id"), "id"))).where(F.col("k") <= PIVOTS)
    pairs = end(pivots, "a").join(end(mixed, "b"), ["of", "size"]).where(jaccard.possible("a", "b")).where("ra <> rb")
    links = links.unionByName(confirm(turned(pairs)))

    # The smaller text of a pair must have a shingle of the group in its early prefix, which few texts that only share a passage have.
    mixed = materialize(several(mixed.select(*columns, *jaccard.MARKS)), "jaccard-mixed")
    pairs = end(mixed.where("early"), "a").join(end(mixed, "b"), ["of", "size"]).where(jaccard.possible("a", "b")).where("(na < nb or na = nb and a < b) and ra <> rb")
    links = links.unionByName(confirm(pairs))
    root = connected_components(links).withColumnRenamed("node", "id")
    return materialize(texts.select("id", "digest", "copies").join(root, "id", "left").select("digest", "copies", F.coalesce("component", "id").alias("root")), "simhash-roots")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its fingerprint and component."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
