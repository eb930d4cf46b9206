"""Centroid clustering with block-norm screening, in exact integers.

A vector's components are cut into segments. Of each segment its sum and the norm of what is left beside its mean are kept: a
compressed vector. The squared distance of two segments is the squared distance of their means plus that of their rests, and by
Cauchy-Schwarz the latter is at least the squared difference of the rests' norms. The sum over segments bounds a distance from
below; a centroid whose bound is above the best exact distance so far can't be nearest, and only the others get an exact
distance. Norms are kept with 24 bits and bounds are computed in floating point, so both are lowered by more than their error.

Vectors never move: a round reads the written table, and a task returns one sum for each centroid and component."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import cut, written

#: Components of a segment, and rows that are compared with all centroids at once.
SEGMENT, ROWS = 8, 4096


def quantise(column: Column, size: int = 64, scale: int = 64) -> Column:
    """floor(scale * x) of every component as long, x as double; null if the vector is null, has not ``size`` components or
    holds a null, an infinity or not-a-number."""
    x = column.cast("array<double>")
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when((F.size(x) == size) & ~F.exists(x, odd), F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


def largest(size: int) -> int:
    """The largest component, by amount, for which squared distances of ``size`` components fit a long."""
    return int((2**62 / max(1, size)) ** 0.5) // 2


def _starts(size: int, segment: int) -> list[int]:
    """First components of the segments: at most so long that the rests' sums fit a long too."""
    return list(range(0, size, max(1, min(segment, int((4 * size) ** 0.5)))))


def compress(x: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """(sums, norms) of the segments of the rows of ``x``; the norms rounded to float32."""
    starts = _starts(x.shape[1], segment)
    sums = np.add.reduceat(x, starts, axis=1)
    width = np.diff([*starts, x.shape[1]])
    rest = np.add.reduceat(x * x, starts, axis=1) * width - sums * sums
    return sums, np.sqrt(rest / width).astype(np.float32)


def screened(x: np.ndarray, sums: np.ndarray, norms: np.ndarray, centers: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, its squared distance) of each row, ties to the smaller number; and how many exact distances it took."""
    n, k = len(x), len(centers)
    width = np.diff([*_starts(x.shape[1], segment), x.shape[1]])
    c_sums, c_norms = compress(centers, segment)
    lower = np.empty((n, k))
    own = norms.astype(np.float64)
    for j in range(k):
        gap = np.abs(own - c_norms[j])
        gap = np.maximum(gap - (own + c_norms[j]) * 2.0**-22, 0)  # float32 rounds by at most 2 ** -24 of each norm
        apart = (sums - c_sums[j]).astype(np.float64)
        lower[:, j] = (apart * apart / width + gap * gap).sum(1)
    lower *= 1 - 1e-9

    def exact(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        d = x[rows] - of
        return (d * d).sum(1)

    first = lower.argmin(1)
    label, best, tested = first.copy(), exact(np.arange(n), centers[first]), n
    for j in range(k):
        rows = np.flatnonzero((lower[:, j] <= best) & (first != j))
        d = exact(rows, centers[j])
        tested += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (j < label[rows]))
        rows, d = rows[better], d[better]
        best[rows], label[rows] = d, j
    return label, best, tested


def _rows(batch: pa.RecordBatch, name: str, dtype) -> np.ndarray:
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(batch.num_rows, -1)


def prepared(vectors: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``vectors`` (vec_id, q array<long>, all of one size) with the compressed form of each, written once and read in each round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _rows(batch, "q", np.int64)
            if q.size and max(-int(q.min()), int(q.max())) > largest(q.shape[1]):
                raise ValueError("components too large: their squared distances would not fit a long")
            sums, norms = compress(q, segment)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(sums), pa.list_(pa.int64())), pa.array(list(norms), pa.list_(pa.float32()))], [*batch.schema.names, "sums", "norms"])

    return written(vectors.select("vec_id", "q").mapInArrow(run, "vec_id long, q array<long>, sums array<long>, norms array<float>"), "vectors")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def assigned(table: DataFrame, centers: np.ndarray, segment: int = SEGMENT) -> DataFrame:
    """(vec_id, cluster, distance, tested) of every row; ``tested``: exact distances that its batch took, at the batch's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            label, best, tested = screened(_rows(batch, "q", np.int64), _rows(batch, "sums", np.int64), _rows(batch, "norms", np.float32), centers, segment)
            once = np.zeros(len(label), np.int64)
            once[0] = tested
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(label, pa.int32()), pa.array(best), pa.array(once)], ["vec_id", "cluster", "distance", "tested"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long, tested long")


def moved(table: DataFrame, centers: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The centroids after a round: floor(sum / count) of their vectors' components; those without vectors stay. A task returns
    its sums, (size + 1) numbers for each centroid, and the driver gets them added up."""
    size = centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centers), size + 1), np.int64)
        for batch in _pieces(batches):
            q = _rows(batch, "q", np.int64)
            label, _, _ = screened(q, _rows(batch, "sums", np.int64), _rows(batch, "norms", np.float32), centers, segment)
            order = np.argsort(label, kind="stable")
            found, starts = np.unique(label[order], return_index=True)
            total[found, :size] += np.add.reduceat(q[order], starts)
            total[found, size] += np.bincount(label, minlength=len(centers))[found]
        cluster, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(place, pa.int32()), pa.array(total[cluster, place])], ["cluster", "place", "total"])

    out, sums = centers.copy(), {}
    for r in table.mapInArrow(run, "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect():
        sums[r.cluster, r.place] = r.total
    for j in range(len(centers)):
        if n := sums.get((j, size), 0):
            out[j] = [sums.get((j, i), 0) // n for i in range(size)]
    return out


def seeds(table: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors of the smallest sha256 of "1:<vec_id>" (a null id as nothing), repeats by their components, in that order."""
    mark = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = table.select(mark.alias("mark"), "q").orderBy("mark", "q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, segment: int = SEGMENT) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every row of ``vectors`` (vec_id long, q
    array<long>) after ``rounds`` rounds from ``k`` first centroids (``k`` rows, so that the driver may hold them).

    Rows with a null vector take no part; all others must have equally many components of at most ``largest`` by amount, or
    an error is raised. A null vec_id is kept, as are repeated rows, each with its own row. With fewer than ``k`` vectors each
    is a centroid; equal centroids leave the later ones empty, which then stay. An empty table gives no rows. Other columns are
    ignored. The centroids are by number, so a repeated run gives the same rows."""
    table = prepared(vectors.where("q is not null"), segment)
    centers = seeds(table, k)
    if not len(centers):
        return table.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).where("false")
    for _ in range(rounds):
        centers = moved(table, centers, segment)
    done = cut(assigned(table, centers, segment).drop("tested"))
    sums = {r.cluster: int(r.total) for r in done.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    spark = vectors.sparkSession
    told = spark.createDataFrame([(j, sums.get(j, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centers)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # told has k rows
