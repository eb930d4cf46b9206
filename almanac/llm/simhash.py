"""SimHash near-duplicate groups by BK-trees.

Every document gets a 64-bit fingerprint of its word shingles. Distinct fingerprints are dealt into shards by one of four
16-bit blocks (of two fingerprints that differ in three bits or fewer, one block is equal), a shard that is too large is
dealt again by the blocks of the 48 bits left, and what is still too large is split into chunks of which every pair meets.
Each shard becomes a BK-tree, whose children are keyed by their integer Hamming distance to the parent; a query follows only
the edges within the radius of its own distance. A shard gives a spanning forest of its links, never all pairs, and the
components are joined over all shards by distributed star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import bounded, cut, fresh, numbered_table, picked, pieces, spread, widen

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Most fingerprints of one tree before its shard is dealt again or split.
TREE = 4096


# ---- fingerprints


def _hashes(words: list[bytes], width: int) -> list[int]:
    if not words:
        return []
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    n = max(1, len(words) - width + 1)
    ends = (starts + lengths)[-n:] if n > 1 or len(words) >= width else [len(line)]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), np.asarray(ends).tolist(), strict=True)]


def fingerprints_of(texts: list[str | None], width: int = SHINGLE) -> np.ndarray:
    """uint64 fingerprints. A bit is set if it is set in over half of the shingles' hashes; without words it is zero."""
    out = np.zeros(len(texts), np.uint64)
    pending, counts, where = [], [], []

    def flush() -> None:
        if not counts:
            return
        bits = np.unpackbits(np.array(pending, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        n = np.array(counts)
        ones = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int64)
        out[where] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
        pending.clear(), counts.clear(), where.clear()

    for i, text in enumerate(texts):
        if hashes := _hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), width):
            pending += hashes
            counts.append(len(hashes))
            where.append(i)
            if len(pending) > 200_000:
                flush()
    flush()
    return out


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                fp = fingerprints_of(part.column("text").to_pylist(), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


# ---- BK-trees


def forest(shard: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all shards at once: node order, root of each shard's first item, parent and edge (distance to it).

    Built level by level: at a node, the items below fall apart by their distance to it, the first of each distance becomes
    the child on that edge, the others go below the child. Arrays are by item; a root is its own parent with edge -1."""
    n = len(fp)
    parent, edge = np.arange(n), np.full(n, -1, np.int64)
    order = np.argsort(shard, kind="stable")
    first = np.r_[True, shard[order][1:] != shard[order][:-1]] if n else np.zeros(0, bool)
    roots = order[first]
    at = np.empty(n, np.int64)
    at[order] = roots[np.cumsum(first) - 1]
    items = order[~first]
    while len(items):
        d = np.bitwise_count(fp[items] ^ fp[at[items]]).astype(np.int64)
        key = at[items] * 65 + d
        o = np.argsort(key, kind="stable")
        items, key, d = items[o], key[o], d[o]
        head = np.r_[True, key[1:] != key[:-1]]
        heads = items[head]
        parent[heads], edge[heads] = at[heads], d[head]
        at[items] = heads[np.cumsum(head) - 1]
        items = items[~head]
    root = np.arange(n)
    root[order] = roots[np.cumsum(first) - 1] if n else root[order]
    return order, root, parent, edge


def search(fp: np.ndarray, root: np.ndarray, parent: np.ndarray, edge: np.ndarray, radius: int, chunk: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) index pairs within ``radius`` for each item as a query against the tree of its shard, in blocks."""
    n = len(fp)
    kids = np.flatnonzero(edge >= 0)
    key = parent[kids] * 65 + edge[kids]
    o = np.argsort(key, kind="stable")
    kids, key = kids[o], key[o]
    stack = [(np.arange(a, min(n, a + 65536)), None) for a in range(0, n, 65536)]
    while stack:
        query, node = stack.pop()
        node = root[query] if node is None else node
        d = np.bitwise_count(fp[query] ^ fp[node]).astype(np.int64)
        hit = (d <= radius) & (query != node)
        if hit.any():
            yield query[hit], node[hit]
        low = np.searchsorted(key, node * 65 + np.maximum(d - radius, 0), "left")
        count = np.searchsorted(key, node * 65 + np.minimum(d + radius, 64), "right") - low
        go = count > 0
        query, low, count = query[go], low[go], count[go]
        ends = np.cumsum(count)
        a = 0
        while a < len(query):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + chunk, "right")))
            c = count[a:b]
            offset = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            stack.append((np.repeat(query[a:b], c), kids[np.repeat(low[a:b], c) + offset]))
            a = b


def spanning(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` items the smallest item of its component: minimum labels with path halving, block by block."""
    label = np.arange(n)
    for a, b in links:
        while True:
            la, lb = label[a], label[b]
            live = la != lb
            if not live.any():
                break
            a, b, la, lb = a[live], b[live], la[live], lb[live]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while (label != (up := label[label])).any():
                label = up
    return label


def _trees(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(b.column("shard").to_numpy(zero_copy_only=False), b.column("fp").to_numpy(zero_copy_only=False)) for b in batches]
        if not found:
            return
        shard, fp = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((fp, shard))  # the same trees and forest whichever order the rows came in
        shard, fp = shard[order], fp[order].view(np.uint64)
        _, root, parent, edge = forest(shard, fp)
        label = spanning(len(fp), search(fp, root, parent, edge, radius))
        child = np.flatnonzero(label != np.arange(len(fp)))
        signed = fp.view(np.int64)
        a, b = signed[child], signed[label[child]]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["u", "v"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Links (u, v) between the fingerprints ``fp`` of ``distinct`` that join the same components as all links would.

    Shards are dealt so that none grows with the data: by a 16-bit block; if over ``tree``, also by a 12-bit block of the
    rest; if still over, by pairs of chunks, each of which is one tree. ``radius`` is 3 at most, since four blocks are
    cut."""
    if radius > 3:
        raise ValueError("four blocks find every link up to a radius of 3")
    block = lambda value, i, width: F.shiftrightunsigned(value, i * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    dealt = distinct.select("fp", F.posexplode(F.array(*[block(F.col("fp"), i, 16) for i in range(4)])).alias("b", "value")).withColumn("shard", F.col("b") * 65536 + F.col("value"))
    crowd = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    large = bounded(crowd(dealt, "shard").where(F.col("n") > tree).select("shard", F.lit(True).alias("large")))
    marked = dealt.join(large, "shard", "left")
    # the 48 bits that the block leaves, low and high part put together
    rest = F.when(F.col("b") == 0, F.shiftrightunsigned("fp", 16))
    for i in (1, 2, 3):
        low = F.col("fp").bitwiseAND(F.lit((1 << 16 * i) - 1).cast("long"))
        rest = rest.when(F.col("b") == i, low if i == 3 else low.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", 16 * (i + 1)), 16 * i)))
    small = marked.where("large is null").select("fp", F.col("shard").cast("long").alias("shard"))
    again = (
        marked.where("large")
        .withColumn("rest", rest)
        .select("fp", "shard", F.posexplode(F.array(*[block(F.col("rest"), i, 12) for i in range(4)])).alias("c", "value"))
        .select("fp", ((F.col("shard") * 4 + F.col("c")) * 4096 + F.col("value") + (1 << 20)).cast("long").alias("shard"))
    )
    sized = spread(again, crowd(again, "shard").withColumn("of", F.col("n")), ["shard"], "of").withColumn("chunks", F.ceil(F.col("n") / (tree // 2)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    fits = sized.where(F.col("n") <= tree).select("fp", "shard")
    split = (
        sized.where(F.col("n") > tree)
        .withColumn("own", own)
        .select("fp", "shard", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select("fp", F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("shard"))
    )
    shards = small.unionByName(fits).unionByName(split)
    width = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(width, "shard").mapInArrow(_trees(radius), "u long, v long").distinct()


# ---- components


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for each node of ``edges`` (u, v): the smallest node of its component, by large-star and small-star turns.

    Each turn is two aggregations and joins by node; a node with very many neighbours is pre-aggregated before the shuffle
    and its edges stay where they are in the join (``spread``). The edge list never leaves the executors; each turn is cut."""
    state, last = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = spread(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        small = spread(large, large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), ["u"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        state = cut(small)
        mark = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == last:
            return state.select("u", F.col("v").alias("root"))
        last = mark


# ---- the operator


def named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (node, and any others, one row each) with ``root``, the smallest node of the component by ``edges`` (u, v), and
    ``lone``, whether there is no other in it. Only nodes with an edge take part in the search for components."""
    roots = components(edges)
    roots = roots.unionByName(roots.select(F.col("root").alias("u"), "root").distinct())
    found = nodes.join(roots.withColumnRenamed("u", "node"), "node", "left")
    return found.withColumn("lone", F.col("root").isNull()).withColumn("root", F.coalesce("root", "node"))


def groups(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, tree: int = TREE) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach, for every row of ``docs`` (doc_id, text).

    Exact copies share a fingerprint and cost one row. Null, empty and blank texts have fingerprint zero, linked like any
    other; null ids are kept but are never a component's id unless all its ids are null; repeated rows are kept. Other
    columns are ignored, an empty table gives an empty one."""
    signed = cut(fingerprints(docs, width))
    distinct = cut(signed.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    rooted = cut(named(distinct, links(distinct.select(F.col("node").alias("fp")), radius, tree)))
    joint = rooted.where("not lone")
    least = joint.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    told = rooted.where("lone").select("node", F.col("least").alias("component_id"), "n").unionByName(spread(joint, least, ["root"], "fps").select("node", "component_id", "n"))
    return spread(signed, told.withColumnRenamed("node", "fp"), ["fp"]).select("doc_id", "fp", "component_id")


def numbered(docs: DataFrame, wide: DataFrame, *more: str) -> tuple[tuple[DataFrame, str, str], DataFrame]:
    """``wide`` (``docs`` with the columns ``more``) as a ``numbered_table``, and of it (row, more..., best): ``best`` orders rows by doc_id,
    nulls last, then by text, nulls first and the others by hash."""
    table, row, spot = numbered_table(wide, "rows")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text").isNotNull().alias("c"), F.xxhash64("text").alias("d"), F.col(row).alias("row"))
    return (table.select(*_all(docs), row, spot), row, spot), table.select(F.col(row).alias("row"), *[F.col(m) for m in more], order.alias("best"))


def keep_first(table: tuple[DataFrame, str, str], best: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the rows of a ``numbered_table`` whose number is that of a struct ``best``; only numbers move."""
    return picked(*table, best.select(F.col("best.row").alias("row"))).select(*[F.col(f"`{c}`") for c in columns])


def near_dedup(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, tree: int = TREE) -> DataFrame:
    """``docs`` with one row of each group of ``groups``: the row of the smallest doc_id, nulls last (of its repeats in the group,
    a null text first, then the least hash of the text)."""
    fp = fresh(docs.columns, "signature")
    wide = widen(docs.withColumn(fresh([*docs.columns, fp], "line"), F.col("text").cast("string")), fp, "long", lambda: lambda texts: pa.array(fingerprints_of(texts, width).view(np.int64)), column_read=fresh([*docs.columns, fp], "line"))
    table, rows = numbered(docs, wide, fp)
    distinct = cut(rows.groupBy(F.col(fp).alias("node")).agg(F.min("best").alias("best")))
    rooted = named(distinct, links(distinct.select(F.col("node").alias("fp")), radius, tree))
    return keep_first(table, rooted.groupBy("root").agg(F.min("best").alias("best")), docs.columns)


def _all(df: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in df.columns]


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
