"""Top lists of many queries against all rows, as products of blocks within tasks.

A block of queries is a written table that each task reads once. Rows stream through the tasks; a piece of them is scored
against the block as one matrix, in rounded arithmetic. Pairs that could be among a query's ``k`` best are scored again by the
exact rule, and a task keeps no more than the ``k`` best of each query: these leave it, scores of all other pairs never do.
Orders are whole numbers (scores in units of the last digit that counts), so equal scores are equal in each task."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs

#: Rows of one matrix product, pairs that are scored again at once, elements of one gathering, dense columns at most.
PIECE, PAIRS, GATHERED, COLUMNS = 128, 1 << 16, 1 << 22, 2048
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Best:
    """The ``k`` best rows of each of ``n`` queries so far: by order from above, then by key; null keys first."""

    def __init__(self, n: int, k: int, kind: pa.DataType, least: int = LOWEST):
        self.n, self.k, self.fresh = n, k, 0
        self.floor = np.full(n, least, np.int64)
        self.schema = pa.schema([("q", pa.int64()), ("order", pa.int64()), ("score", pa.float64()), ("key", kind)])
        self.parts: list[pa.Table] = []

    def add(self, q: np.ndarray, order: np.ndarray, score: np.ndarray, keys: pa.Array) -> None:
        self.parts.append(pa.table([pa.array(q, pa.int64()), pa.array(order, pa.int64()), pa.array(score, pa.float64()), keys], schema=self.schema))
        self.fresh += len(q)
        if self.fresh > self.n * self.k:
            self.cut()

    def cut(self) -> pa.Table:
        rows = pa.concat_tables(self.parts) if self.parts else self.schema.empty_table()
        rows = rows.take(pc.sort_indices(rows, [("q", "ascending"), ("order", "descending"), ("key", "ascending")], null_placement="at_start"))
        q = rows.column("q").to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = np.flatnonzero(place == self.k - 1)
        self.floor[q[last]] = rows.column("order").to_numpy()[last]
        rows = rows.filter(pa.array(place < self.k)).combine_chunks()
        self.parts, self.fresh = [rows], 0
        return rows


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i] .. starts[i] + sizes[i] - 1``, one range after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _candidates(scores: np.ndarray, floor: np.ndarray, slack: np.ndarray | float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all scores (queries by rows) that may be among the ``k`` best. NaN may be."""
    hit = ~(scores + slack < floor[:, None])
    if scores.shape[1] > k and np.count_nonzero(hit) > 4 * k * len(scores):
        some = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]  # NaN sorts last: it counts as high, as it ranks
        low = scores + slack < some[:, None]
        hit &= ~low
    return np.nonzero(hit)


def _read(uri: str, columns: list[str]) -> pa.Table:
    system, path = fs.FileSystem.from_uri(re.sub("^file:/(?!//)", "file:///", uri))
    return pq.read_table(path, filesystem=system, columns=columns).combine_chunks()


def _told(best: Best, names: pa.Array, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = best.cut()
    out = pa.table([names.take(rows.column("q").combine_chunks()), rows.column("key"), rows.column("score"), rows.column("order")], schema=kinds)
    yield from out.to_batches(max_chunksize=1 << 16)


def dense(uri: str, k: int, least: float | None):
    """A function for ``mapInArrow``: rows (key, _u) of unit vectors against the block (query, _q) at ``uri``.

    Cosines are added up component by component in double precision; the order is that of nine digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = _read(uri, ["query", "_q"]), None
        names, own = block.column("query").combine_chunks(), block.column("_q").combine_chunks()
        lengths = pc.list_value_length(own).to_numpy(zero_copy_only=False)
        sides = {n: (at := np.flatnonzero(lengths == n), own.take(pa.array(at)).flatten().to_numpy().reshape(len(at), n)) for n in np.unique(lengths) if n}
        for batch in batches:
            best = best or Best(len(names), k, batch.column(0).type, LOWEST if least is None else int(np.floor(least * 1e9)) - 1)
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for n, (at, q) in sides.items():
                mine = np.flatnonzero(sizes == n)
                for a in range(0, len(mine), PIECE):
                    some = mine[a : a + PIECE]
                    r = batch.column(1).take(pa.array(some)).flatten().to_numpy().reshape(len(some), n)
                    i, j = _candidates(q @ r.T, best.floor[at] / 1e9, 2e-9, k)
                    for c in range(0, len(i), PAIRS):
                        x, y = i[c : c + PAIRS], j[c : c + PAIRS]
                        score = np.zeros(len(x))
                        for d in range(n):
                            score += r[y, d] * q[x, d]
                        order = np.where(np.isnan(score), HIGHEST, np.floor(np.nan_to_num(score) * 1e9 + 0.5).astype(np.int64))
                        ok = (order >= best.floor[at[x]]) & (True if least is None else ~(score < least))
                        best.add(at[x[ok]], order[ok], score[ok], batch.column(0).take(pa.array(some[y[ok]])))
        if best is not None:
            yield from _told(best, names, _kinds(names.type, best))

    return run


def _kinds(query: pa.DataType, best: Best) -> pa.Schema:
    return pa.schema([("query", query), ("key", best.schema.field("key").type), ("score", pa.float64()), ("_order", pa.int64())])


class _Terms:
    """A block of queries (query, term, weight): what is frequent as columns of a matrix, the rest as lists of a term's queries."""

    def __init__(self, uri: str):
        block = _read(uri, ["query", "term", "weight"])
        q = block.column("query").combine_chunks().dictionary_encode("encode")
        t = block.column("term").combine_chunks().dictionary_encode()
        self.names, self.n = q.dictionary, len(q.dictionary)
        self.places = t.dictionary
        qi, ti, w = q.indices.to_numpy(), t.indices.to_numpy(), block.column("weight").to_numpy()
        many = np.bincount(ti, minlength=len(self.places))
        frequent = np.flatnonzero(many > self.n / 100)
        frequent = frequent[np.argsort(-many[frequent], kind="stable")[:COLUMNS]]
        self.column = np.full(len(self.places), -1)
        self.column[frequent] = np.arange(len(frequent))
        there = self.column[ti] >= 0
        self.matrix = np.zeros((self.n, len(frequent)), np.float32)
        self.matrix[qi[there], self.column[ti[there]]] = w[there]
        rest = np.flatnonzero(~there)
        rest = rest[np.argsort(ti[rest], kind="stable")]
        self.rest_q, self.rest_w, self.rest_n = qi[rest].astype(np.int64), w[rest], np.where(self.column < 0, many, 0)
        self.rest_at = np.cumsum(self.rest_n) - self.rest_n
        by = np.argsort(qi, kind="stable")
        self.terms, self.weights, self.own_n = ti[by], w[by], np.bincount(qi, minlength=self.n)
        self.own_at = np.cumsum(self.own_n) - self.own_n

    def scores(self, ids: np.ndarray, w: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Products with ``rows`` texts, whose terms ``ids`` weigh ``w``, about: queries by texts."""
        out = np.zeros((rows, self.matrix.shape[1]), np.float32)
        often = self.column[ids] >= 0
        out[row[often], self.column[ids[often]]] = w[often]
        out = self.matrix @ out.T
        ids, w, row = ids[~often], w[~often], row[~often]
        sizes = self.rest_n[ids]
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum(), GATHERED))
        for a, b in pairwise([*cuts, len(ids)]):
            at = _spread(self.rest_at[ids[a:b]], sizes[a:b])
            flat = self.rest_q[at] * rows + np.repeat(row[a:b], sizes[a:b])
            out += np.bincount(flat, np.repeat(w[a:b], sizes[a:b]) * self.rest_w[at], self.n * rows).reshape(self.n, rows).astype(np.float32)
        return out

    def exact(self, asked: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sums of products, each to twelve digits, of some queries with a text whose terms have ``weights``."""
        sizes = self.own_n[asked]
        at = _spread(self.own_at[asked], sizes)
        each = np.floor(weights[self.terms[at]] * self.weights[at] * 1e12 + 0.5).astype(np.int64)
        return np.add.reduceat(each, np.cumsum(sizes) - sizes)


def sparse(uri: str, k: int):
    """A function for ``mapInArrow``: rows (key, words) against the block (query, term, weight) at ``uri``; a word weighs its count
    over the greatest count of its text. Pairs without a common word are in no list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = best = None
        for batch in batches:
            block = block or _Terms(uri)
            best = best or Best(block.n, k, batch.column(0).type, 1)
            scratch = np.zeros(len(block.places))
            # Words as numbers: of the batch's own words, and where these are among the block's.
            words = batch.column(1).flatten().dictionary_encode()
            codes, place = words.indices.to_numpy().astype(np.int64), pc.index_in(words.dictionary, block.places).fill_null(-1).to_numpy()
            ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy())
            for a in range(0, batch.num_rows, PIECE):
                own = ends[a : a + PIECE]
                start = ends[a - 1] if a else 0
                row = np.searchsorted(own, np.arange(start, own[-1]), side="right")
                each, n = np.unique(row * max(len(place), 1) + codes[start : own[-1]], return_counts=True)
                row, i = each // max(len(place), 1), place[each % max(len(place), 1)]
                most = np.ones(len(own), np.int64)
                np.maximum.at(most, row, n)
                there = i >= 0
                if not there.any():
                    continue
                row, i, w = row[there], i[there], (n / most[row])[there]
                got = block.scores(i, w, row, len(own))
                # Single precision adds non-negative numbers: the error is below this share of the sum.
                x, y = _candidates(got, best.floor / 1e12, got * np.float32(5e-4), k)
                by = np.argsort(y, kind="stable")
                x, y = x[by], y[by]
                order = np.zeros(len(x), np.int64)
                texts, firsts = np.unique(y, return_index=True)
                for text, (c, d) in zip(texts, pairwise([*firsts, len(y)]), strict=True):
                    mine = slice(*np.searchsorted(row, [text, text + 1]))
                    scratch[i[mine]] = w[mine]
                    for e in range(c, d, 4096):
                        order[e : min(d, e + 4096)] = block.exact(x[e : min(d, e + 4096)], scratch)
                    scratch[i[mine]] = 0
                ok = order >= best.floor[x]
                best.add(x[ok], order[ok], order[ok] / 1e12, batch.column(0).take(pa.array(a + y[ok])))
        if best is not None:
            yield from _told(best, block.names, _kinds(block.names.type, best))

    return run
