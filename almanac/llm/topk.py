"""Exact top-k search by inner product over a bit-sliced index.

Vectors are quantised to integers. A block of rows becomes an index: for every attribute, bitmaps of its bits above the lowest
(offset to be positive), one bit a row. For a query, the slices of all attributes, each taken as often as the query's
component has signed digits, are added with carry-save bitmap arithmetic to the slices of a score that is short of the true
one by a known error at most. From the most significant slice downward the k-th best score is found; rows within the error of
it, the boundary, are scored exactly from their integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanac.llm.common import bounded, cut

#: Most and least rows of an index block, queries of a query block, and query blocks that meet an index block in one task; low
#: bits that the slices leave out.
ROWS, LEAST, QUERIES, TEAM, DROPPED = 16_384, 1_024, 512, 32, 1


def quantise(column: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as long, x as double; null if the vector is null or holds a null, an infinity or
    not-a-number. Empty vectors stay empty."""
    x = column.cast("array<double>")
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(~F.exists(x, odd), F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


class Index:
    """The bit slices of ``rows`` (n, d) int64: row ``first[a] + b`` of ``slices`` is bit b of attribute a, ``bits[a]`` of them."""

    def __init__(self, rows: np.ndarray, dropped: int = DROPPED):
        self.rows, (n, d) = rows, rows.shape
        self.words = -(-n // 64)
        self.low = rows.min(0) if n else np.zeros(d, np.int64)
        above = (rows - self.low).astype(np.uint64)
        self.top = above.max(0).astype(np.int64) if n else self.low
        self.dropped = dropped if d and n and int(self.top.max()) >> dropped else 0
        self.bits = np.array([max(0, int(t).bit_length() - self.dropped) for t in self.top], np.int64)
        self.first = np.cumsum(self.bits) - self.bits
        own = np.zeros((int(self.bits.sum()), self.words * 64), np.uint8)
        for a in range(d):
            places = np.arange(self.dropped, self.dropped + int(self.bits[a]), dtype=np.uint64)
            own[self.first[a] : self.first[a] + self.bits[a], :n] = (above[:, a] >> places[:, None]) & np.uint64(1)
        self.slices = np.packbits(own, axis=1, bitorder="little").view(np.uint64)
        self.valid = np.zeros(self.words * 64, np.uint8)
        self.valid[:n] = 1
        self.valid = np.packbits(self.valid, bitorder="little").view(np.uint64)

    def _summands(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, slice, whether inverted) of every bitmap to be added, by place: each slice once for each signed digit of its
        attribute's component (non-adjacent form: few digits, each 1 or -1)."""
        size, digits = np.abs(query), []
        place = 0
        while size.any():
            digit = np.where(size & 1, 2 - (size & 3), 0)
            a = np.flatnonzero(digit)
            digits.append((np.full(len(a), place), a, (digit[a] > 0) != (query[a] > 0)))
            size = (size - digit) >> 1
            place += 1
        if not digits:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
        place, a, inverted = (np.concatenate(x) for x in zip(*digits, strict=True))
        n = self.bits[a]
        b = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(place, n) + b
        order = np.argsort(place, kind="stable")
        return place[order], (np.repeat(self.first[a], n) + b)[order], np.repeat(inverted, n)[order]

    def score_slices(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices, least significant first, of sum(q * (u >> dropped)) + a constant, and the most by which the true score in
        units of 1 << dropped exceeds it: slices of negative digits are added inverted, so that everything stays positive.
        Bitmaps of one place are added three by three, all triples at once."""
        error = sum(abs(q) * min(t, (1 << self.dropped) - 1) for q, t in zip(query.tolist(), self.top.tolist(), strict=True))
        places, which, inverted = self._summands(query)
        out, carried, place = [], [], 0
        last = int(places[-1]) if len(places) else -1
        while place <= last or carried:
            a, b = np.searchsorted(places, [place, place + 1])
            own = self.slices[which[a:b]]
            own[inverted[a:b]] ^= ~np.uint64(0)
            stack, carried = np.concatenate([own, *carried]), []
            while len(stack) >= 3:  # full adders: three bitmaps become a sum and a carry
                k = len(stack) // 3
                x, y, z = stack[:k], stack[k : 2 * k], stack[2 * k : 3 * k]
                t = x ^ y
                carried.append((x & y) | (t & z))
                stack = np.concatenate([t ^ z, stack[3 * k :]])
            if len(stack) == 2:
                carried.append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
            out.append(stack[0] if len(stack) else np.zeros(self.words, np.uint64))
            place += 1
        return out, error

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows (ascending) that may be among the ``k`` best: those whose score is not below the k-th best by over the error."""
        slices, error = self.score_slices(query)
        better, equal, threshold = np.zeros(self.words, np.uint64), self.valid.copy(), 0
        found = 0
        for s in range(len(slices) - 1, -1, -1):
            ones = equal & slices[s]
            n = int(np.bitwise_count(ones).sum())
            if found + n >= k:
                equal, threshold = ones, threshold | 1 << s
            else:
                better |= ones
                found += n
                equal = equal & ~slices[s]
        if not (margin := -(-error >> self.dropped) if self.dropped else 0):
            keep = better | equal
        else:  # all rows whose score is at least threshold - margin
            bound = max(0, threshold - margin)
            keep, level = np.zeros(self.words, np.uint64), self.valid.copy()
            for s in range(len(slices) - 1, -1, -1):
                if bound >> s & 1:
                    level = level & slices[s]
                else:
                    keep |= level & slices[s]
                    level = level & ~slices[s]
            keep |= level
        return np.flatnonzero(np.unpackbits(keep.view(np.uint8), bitorder="little"))

    def best(self, query: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact scores of the ``k`` best rows without ``skip``, ties to the earlier row."""
        rows = self.candidates(query, k + (0 if skip is None else len(skip)))
        if skip is not None and len(skip):
            rows = rows[~np.isin(rows, skip)]
        score = self.rows[rows] @ query
        order = np.lexsort((rows, -score))[:k]
        return rows[order], score[order]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (pair, side): an index block (side 0), then the query blocks that meet it (side 1)."""
        pair, index, ids = None, None, None
        for batch in batches:
            for p, side, d, i, v in zip(*(batch.column(c) for c in ("pair", "side", "dim", "ids", "vectors")), strict=True):
                i, raw = np.frombuffer(i.as_py(), np.int64), v.as_py()
                rows = np.frombuffer(raw, np.int32 if len(raw) == 4 * len(i) * d.as_py() else np.int64).reshape(len(i), d.as_py()).astype(np.int64)
                if side.as_py() == 0:
                    pair, ids, index = p.as_py(), i, Index(rows)
                elif pair == p.as_py():
                    out = [[], [], []]
                    for query, vector in zip(i.tolist(), rows, strict=True):
                        own = np.flatnonzero(ids == query)
                        at, score = index.best(vector, k, own)
                        out[0] += [query] * len(at)
                        out[1].append(ids[at])
                        out[2].append(score)
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out[1:])], ["query_id", "vec_id", "score"])

    return run


def _narrow(x: np.ndarray) -> np.ndarray:
    fits = not x.size or (x.min() >= -(1 << 31) and x.max() < 1 << 31)
    return np.ascontiguousarray(x.astype(np.int32) if fits else x)


def _pack(rows: int):
    """Rows of a partition as blocks: (dim, block, ids, vectors as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        number = 0

        def flush(dim: int):
            nonlocal number
            parts = held.pop(dim)
            ids, vectors = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(ids, kind="stable")
            for a in range(0, len(ids), rows):
                own = order[a : a + rows]
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([number], pa.int32()), pa.array([ids[own].tobytes()], pa.binary()), pa.array([_narrow(vectors[own]).tobytes()], pa.binary())], ["dim", "number", "ids", "vectors"])
                number += 1

        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("q")
            dims = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                flat = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False)
                held.setdefault(dim, []).append((ids[own], flat.reshape(len(own), dim)))
                if sum(len(p[0]) for p in held[dim]) >= rows:
                    yield from flush(dim)
        for dim in list(held):
            yield from flush(dim)

    return run


def blocks(vectors: DataFrame, rows: int, width: int) -> DataFrame:
    """(dim, block, ids, vectors): rows of equal dimension in blocks of at most ``rows`` (fewer where that gives every task one),
    sorted by id inside, numbered from 0. They are cut, since which rows share a block may change from one evaluation to
    the next. The numbers come from one row for each partition."""
    n = vectors.count()
    rows = min(rows, max(LEAST, -(-n // width)))
    packed = vectors.repartition(max(1, min(width, -(-n // rows)))).mapInArrow(_pack(rows), "dim int, number int, ids binary, vectors binary")
    done = cut(packed.withColumn("part", F.spark_partition_id()))
    before = done.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n"))
    return done.join(bounded(before.select("part", "before")), "part").select("dim", (F.col("before") + F.col("number")).alias("block"), "ids", "vectors")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, rows: int = ROWS, per: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` (vec_id, q array<long>) its ``k`` best rows of ``vectors``
    (same columns) by integer inner product, ties to the smaller vec_id; rows of the query's own id are no candidates.

    Blocks of candidates meet blocks of queries, and only the k best of each meeting go on, so no vectors are broadcast or
    collected; an index block is sent once for every ``TEAM`` query blocks, a query block once for every index block. Meetings
    are numbered and dealt by range of their number, so that tasks have equally many. Null vectors and ids take no part; empty
    vectors score 0 with each other; vectors of different dimension never meet; a repeated vec_id is a candidate as often as
    it occurs; a repeated query is asked once, by its least vector. Other columns are ignored; an empty table on either side gives
    no rows. Scores must fit a long."""
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clean = lambda df: df.where("vec_id is not null and q is not null").select("vec_id", "q")
    index = blocks(clean(vectors), rows, width)
    asked = blocks(clean(queries).groupBy("vec_id").agg(F.min("q").alias("q")), per, width)
    teams = max(1, -(-asked.count() // TEAM))
    cells = index.select("dim", "block", F.explode(F.sequence(F.lit(0), F.lit(teams - 1))).alias("team"))
    pair = (F.col("block") * teams + F.col("team")).alias("pair")
    one = index.withColumn("team", F.explode(F.sequence(F.lit(0), F.lit(teams - 1)))).select(pair, F.lit(0).alias("side"), "dim", "ids", "vectors")
    meets = bounded(cells.select(F.col("dim").alias("d"), F.col("team").alias("t"), pair))
    two = asked.withColumn("team", F.pmod("block", F.lit(teams))).join(meets, (F.col("dim") == F.col("d")) & (F.col("team") == F.col("t"))).select("pair", F.lit(1).alias("side"), "dim", "ids", "vectors")
    met = one.unionByName(two).repartitionByRange(width, "pair").sortWithinPartitions("pair", "side").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
