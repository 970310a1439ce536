"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank.

A vector is scaled to length 1, so cosine >= c means a distance of at most R = sqrt(2 - 2c). The model (coarse centroids and
a codebook for each subspace of the residuals) is fitted on a bounded sample; every vector is indexed.

* Lists: a vector's home is its nearest centroid. A query probes each list c whose bisector with its own home h is near:
  (d(q,c)^2 - d(q,h)^2) / (2 |c - h|) <= reach. The way between the two of a pair crosses the bisector of their homes, so
  their distances from it add up to at most R, and one of them is at most R / 2: with a reach of R / 2 no pair is missed.
  Most directions cross bisectors at a slant, so :func:`reach` measures on the sample how near partners at distance R lie,
  in directions that vectors of the sample, at large and near by, differ in; it takes what all but one in a thousand need.
* Codes: the residual y - c is coded subspace by subspace; with its coding error e, the table-lookup distance of a query at
  distance <= R is at most R + e, whatever the angle; pairs beyond it are cut. Where many are left, the product of the unit
  vectors cuts them further, and what is left is decided by the exact cosine in double precision.

Lists that lie close are a block. A vector is sent once to its home's block and to each other block that has a list which
it probes. A pair is counted at one list only (if each probes the other's list, at the smaller), so no pairs are returned: a
block returns for each of its linked vectors the number of its links and the root of its local component. Equal vectors are
one class from the start. Blocks with many rows are cut into chunks, and each pair of chunks is a cell of its own. Vectors of
each length have an index of their own; where they are too few for one, they are one block and all compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zenithal.llm.components import connected_components
from zenithal.llm.simhash import forest
from zenithal.llm.skew import join_counted
from zenithal.session import materialize, ship

#: Vectors that the model of one length is fitted on at most, and inverted lists for each of these at most; the lists are
#: twice the square root of the number of vectors.
SAMPLE, SHARE_OF_LISTS = 1 << 16, 8
#: Vectors at home in a block, about; components in a cell, about.
BLOCK_ROWS, CELL_VALUES = 4096, 1 << 22
#: Lengths that fewer vectors have are one block without an index.
LEAST_ROWS = 2048

def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm; at most as many centres as there are rows."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        home = nearest(x, centres)
        sums, sizes = np.zeros_like(centres), np.bincount(home, minlength=len(centres))
        np.add.at(sums, home, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[a : a + 2048], centres).argmin(1) for a in range(0, len(x), 2048)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Coarse centroids and residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = 8, codes: int = 64, seed: int = 5):
        self.centres = kmeans(sample, lists, 8, seed)
        self.cuts = [round(i * sample.shape[1] / subspaces) for i in range(subspaces + 1)]
        residual = sample - self.centres[nearest(sample, self.centres)]
        self.books = [kmeans(residual[:, a:b], codes, 6, seed + 1) for a, b in self.parts()]
        self.apart = np.sqrt(squared(self.centres, self.centres))

    def parts(self) -> list[tuple[int, int]]:
        return [(a, b) for a, b in zip(self.cuts, self.cuts[1:], strict=False) if b > a]

    def margins(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Distance of each row from the bisector of its home and each list; 0 for the home."""
        d = squared(x, self.centres)
        return (d - d[np.arange(len(x)), home][:, None]) / (2 * np.maximum(self.apart[home], 1e-12))

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = np.stack([nearest(residual[:, a:b], book) for (a, b), book in zip(self.parts(), self.books, strict=True)], 1)
        back = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], 1)
        return codes, np.sqrt(((residual - back) ** 2).sum(1))

    def lookup(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries (less the centroid) from coded residuals, as sums of table entries."""
        total = np.zeros((len(queries), len(codes)))
        for m, ((a, b), book) in enumerate(zip(self.parts(), self.books, strict=True)):
            total += squared(queries[:, a:b], book)[:, codes[:, m]]
        return total


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # first, or squares may run over
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, as doubles."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return values[ends[0] : ends[-1]].astype(np.float64).reshape(len(column), -1)


def reach(x: np.ndarray, index: Index, cosine: float, seed: int = 9) -> float:
    """How far from bisectors queries have to look: see above. ``x``: unit vectors of the sample."""
    r, rng = math.sqrt(max(0.0, 2 - 2 * cosine)), np.random.default_rng(seed)
    x = x[rng.permutation(len(x))[:4096]]
    most = 0.0
    for near in (False, True):
        j, k = rng.integers(0, len(x), (2, len(x)))
        if near:  # two of the nearest others
            close = np.concatenate([np.argpartition(squared(x[a : a + 512], x), min(12, len(x) - 1), axis=1)[:, :12] for a in range(0, len(x), 512)])
            j, k = close[np.arange(len(x)), j % close.shape[1]], close[np.arange(len(x)), k % close.shape[1]]
        way = x[j] - x[k]
        way -= (way * x).sum(1, keepdims=True) * x
        size = np.sqrt((way * way).sum(1))
        own = size > 1e-6
        if not own.any():
            continue
        a = x[own]
        b = cosine * a + math.sqrt(max(0.0, 1 - cosine**2)) * way[own] / size[own, None]
        needs = []
        for at in range(0, len(a), 512):
            p, q = a[at : at + 512], b[at : at + 512]
            hp, hq = nearest(p, index.centres), nearest(q, index.centres)
            rows = np.arange(len(p))
            needs.append(np.minimum(index.margins(p, hp)[rows, hq], index.margins(q, hq)[rows, hp]))
        most = max(most, float(np.quantile(np.concatenate(needs), 0.999)))
    return min(r / 2, most) + 1e-9


class Model:
    """The index of one length: lists, their blocks, and how far queries look."""

    def __init__(self, sample: np.ndarray, n: int, cosine: float):
        unit = _unit(sample)
        self.index = Index(unit, max(2, min(len(unit) // SHARE_OF_LISTS, round(2 * math.sqrt(n)))))
        self.limit = reach(unit, self.index, cosine)
        blocks = kmeans(self.index.centres, max(1, round(n / BLOCK_ROWS)), 8, 6)
        self.block_of = nearest(self.index.centres, blocks)

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The block of each row's home, and the other blocks with lists that it probes."""
        home, ask = nearest(unit, self.index.centres), []
        for a in range(0, len(unit), 1024):
            probes = self.index.margins(unit[a : a + 1024], home[a : a + 1024]) <= self.limit
            for h, row in zip(self.block_of[home[a : a + 1024]], probes, strict=True):
                own = np.unique(self.block_of[row])
                ask.append(own[own != h].astype(np.int32))
        return self.block_of[home], ask


def linked_pairs(stored, queries, model: Model | None, at: int, cosine: float):
    """Pairs (i in stored, j in queries) with cosine >= ``cosine`` that list ``at`` is to count; without a model, all of them.

    Each side: (unit vectors, raw vectors, homes). ``queries`` None: pairs i < j within ``stored``."""
    r = math.sqrt(max(0.0, 2 - 2 * cosine))
    unit, raw, home = stored
    q_unit, q_raw, q_home = queries or stored
    if model is not None:
        centre = model.index.centres[at]
        codes, error = model.index.encode(unit - centre)
        most = (r + error) ** 2 + 1e-9
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, min(512, (1 << 24) // max(len(unit), 1)))
    for a in range(0, len(q_unit), step):
        q = q_unit[a : a + step]
        if model is None:
            near = q @ unit.T >= cosine - 1e-9
        else:
            near = model.index.lookup(q - centre, codes) <= most[None]
            if np.count_nonzero(near) > near.size // 50:
                near &= q @ unit.T >= cosine - 1e-9
        j, i = np.nonzero(near)
        j += a
        if queries is None:
            i, j = i[i < j], j[i < j]
        rows = max(1, (1 << 22) // raw.shape[1])
        for b in range(0, len(i), rows):
            x, y = raw[i[b : b + rows]], q_raw[j[b : b + rows]]
            cos = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            out_i.append(i[b : b + rows][cos >= cosine])
            out_j.append(j[b : b + rows][cos >= cosine])
    i, j = np.concatenate(out_i), np.concatenate(out_j)
    if queries is not None and model is not None and len(i):
        # The pair also meets in the query's home list if the stored vector probes it: then the smaller list counts it.
        s, at_s = np.unique(i, return_inverse=True)
        there = model.index.margins(unit[s], home[s])[at_s, q_home[j]] <= model.limit
        keep = ~(there & (q_home[j] < at))
        i, j = i[keep], j[keep]
    return i, j


def cell_links(raw: np.ndarray, half: np.ndarray, model: Model | None, block: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs of a cell that it is to count, as rows (i, j): of one chunk if ``half`` is 0 throughout, else across."""
    unit = _unit(raw)
    within = not half.any()
    if model is None:
        first = np.nonzero(half == 0)[0]
        other = np.nonzero(half == 1)[0]
        none = np.zeros(len(raw), np.int64)
        side = lambda m: (unit[m], raw[m], none[m])
        i, j = linked_pairs(side(first), None if within else side(other), None, 0, cosine)
        return first[i], (first if within else other)[j]
    home = nearest(unit, model.index.centres)
    side = lambda m: (unit[m], raw[m], home[m])
    asks = np.concatenate([model.index.margins(unit[a : a + 1024], home[a : a + 1024]) <= model.limit for a in range(0, len(unit), 1024)])
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in np.unique(home[model.block_of[home] == block]).tolist():
        s, q = home == at, asks[:, at] & (home != at)
        ways = [(s, None), (s, q)] if within else [(s & (half == 0), s & (half == 1)), (s & (half == 0), q & (half == 1)), (s & (half == 1), q & (half == 0))]
        for left, right in ways:
            a, b = np.nonzero(left)[0], None if right is None else np.nonzero(right)[0]
            if not len(a) or (b is not None and not len(b)):
                continue
            i, j = linked_pairs(side(a), None if b is None else side(b), model, at, cosine)
            out_i.append(a[i])
            out_j.append((a if b is None else b)[j])
    return np.concatenate(out_i), np.concatenate(out_j)


def similar(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, sample: int = SAMPLE, least_rows: int = LEAST_ROWS, cell_values: int = CELL_VALUES) -> DataFrame:
    """(key, n_links, component) for each row: links are pairs with a cosine of at least ``cosine``.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
    lengths do not link with each other. Equal vectors (repeated rows too) link with each other. Null keys count as links but
    never name a component. Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.when(F.coalesce(finite, F.lit(False)), v).alias("v"))
    rows = materialize(rows, "pq-rows")
    classes = rows.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("least"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dims", F.size("v")), "pq-classes")
    lengths = classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least_rows).collect()  # few: each has many rows
    models: dict[int, Model] = {}
    for r in lengths:
        size = min(sample, max(least_rows, 32 * round(math.sqrt(r.n))))
        picked = classes.where(F.col("dims") == r.dims).orderBy(F.xxhash64("v"), "cid").limit(size).select("v").toArrow().column(0).combine_chunks()
        models[r.dims] = Model(_matrix(picked), r.n, cosine)
    shared = spark.sparkContext.broadcast(models)

    def place(batches):
        for b in batches:
            dims = b.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == d))
                model = shared.value.get(d)
                if model is None:
                    block, ask = np.zeros(own.num_rows, np.int64), [[]] * own.num_rows
                else:
                    block, ask = model.place(_unit(_matrix(own.column(0))))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(block.astype(np.int32)), pa.array(ask, pa.list_(pa.int32()))], ["v", "cid", "dims", "copies", "home", "asks"])

    kind = classes.schema["v"].dataType.simpleString()
    placed = materialize(classes.select("v", "cid", "dims", "copies").mapInArrow(place, f"v {kind}, cid long, dims int, copies long, home int, asks array<int>"), "pq-placed")
    met = placed.select("v", "cid", "dims", "copies", F.explode(F.concat(F.array("home"), "asks")).alias("block"))
    # One row for each block with more rows than a cell holds; all others are one chunk.
    wide = met.groupBy("dims", "block").agg(F.ceil(F.count(F.lit(1)) * F.col("dims") / cell_values).alias("chunks")).where("chunks > 1")
    met = met.join(materialize(wide, "pq-blocks"), ["dims", "block"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    met = met.withColumn("c", F.pmod(F.xxhash64("cid"), F.col("chunks"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    cells = met.select("dims", "block", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), (F.col("c") > F.col("o")).cast("int").alias("half"), "cid", "copies", "v")

    def compare(batches):
        for (dims, block, a, b), half, cid, copies, v in _runs(batches):
            if len(cid) < 2 or (a != b and (half.all() or not half.any())):
                continue
            i, j = cell_links(_matrix(v), half if a != b else np.zeros(len(cid), bool), shared.value.get(dims), block, cosine)
            if len(i):
                links = np.bincount(i, copies[j], len(cid)) + np.bincount(j, copies[i], len(cid))
                root, on = forest(len(cid), i, j), np.nonzero(links)[0]
                yield pa.RecordBatch.from_arrays([pa.array(cid[on]), pa.array(links[on].astype(np.int64)), pa.array(cid[root[on]])], ["cid", "links", "root"])

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(n_parts, "dims", "block", "a", "b").sortWithinPartitions("dims", "block", "a", "b", "half")
    found = materialize(dealt.mapInArrow(compare, "cid long, links long, root long"), "pq-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    root = connected_components(found, "cid", "root").withColumnRenamed("node", "cid")
    joined = classes.join(links, "cid", "left").join(root, "cid", "left")
    joined = materialize(joined.select("v", "copies", "least", F.coalesce("component", "cid").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "pq-joined")
    names = materialize(joined.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("members")), "pq-names")
    named = materialize(join_counted(joined, names, "root", "members").select("v", "n_links", "component", "copies"), "pq-named")
    linked = join_counted(rows.where("v is not null"), named, "v", "copies").select("key", "n_links", "component")
    rest = rows.where("v is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    return linked.unionByName(rest)


def _runs(batches):
    """The cells of a sorted partition: ((dims, block, a, b), half, cid, copies, v), whole even where one goes over several batches."""
    kept, key = [], None

    def whole():
        t = pa.Table.from_batches(kept).combine_chunks()
        return key, t.column("half").to_numpy().astype(bool), t.column("cid").to_numpy(), t.column("copies").to_numpy(), t.column("v").chunk(0)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], 1)
        cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if key is not None and key != tuple(keys[a].tolist()):
                yield whole()
                kept = []
            key = tuple(keys[a].tolist())
            kept.append(batch.slice(a, b - a))
    if kept:
        yield whole()


def op5_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all rows of ``embeddings``."""
    out = similar(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return out.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("key") == F.col("component"), F.lit(False)).alias("kept"))
