"""Near-duplicate texts by BK-trees over SimHash fingerprints, each link checked against the texts' word shingles.

The fingerprint queries of ``simhash`` link at few bits, which near copies of five-word shingles and a similarity just over
0.8 exceed: their fingerprints differ in about 10 bits of 64, and of 1,000 pairs of similarity 0.80 to 0.82 all but one or two
in 18 at most. Trees are searched within these. Such a radius needs other shards than equal bits: texts meet in a shard if a
band of five minimal hashes agrees in one of 20, which misses a pair of similarity 0.8 once in 2,800. No metric tree prunes much
at such a radius (a search visits over nine tenths of a tree of random fingerprints), so what bounds the work is the shard:
unlike texts rarely share five minimal hashes. What a tree finds is linked if the sets of shingles are similar enough, counted
exactly, for whole arrays of pairs at once.

Shingle sets move only for texts that a tree of fingerprints alone finds a partner for. A shard over ``TREE`` is cut into
chunks that share a leader; texts that are linked to it, by whatever path, need not meet each other again, and only the others
meet every chunk, so that a large group of near copies costs its size and not its square."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import bounded, cut, fresh, picked, pieces, spread, widen
from almanac.llm.simhash import TREE, forest, keep_first, named, numbered, search

#: Words of a shingle, least similarity (as a fraction), bits within which trees are searched, bands and their minimal hashes.
SHINGLE, SIMILAR, RADIUS, BANDS, ROWS = 5, (4, 5), 18, 20, 5
#: Fixed random odd multipliers: one for each minimal hash, one for each word of a shingle.
_ODD = np.random.default_rng(20240229).integers(0, 1 << 63, BANDS * ROWS + 64, np.uint64) * np.uint64(2) + np.uint64(1)
#: Rows of shards, and shingles of pairs, that are worked on together.
TOGETHER, COMPARED = 1 << 15, 1 << 22


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


class Signer:
    """Shingle sets and what is made of them. Hashes of words are remembered up to a bound."""

    def __init__(self, width: int):
        self.width, self.words = width, {}

    def shingles(self, text: str | None) -> np.ndarray:
        """The text's distinct shingles as sorted uint64 hashes: words in lower case (A-Z), the whole sequence if it is short."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        if len(known) > 500_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.array([known[w] for w in words], np.uint64)
        n = max(1, len(h) - self.width + 1)
        total = np.zeros(n, np.uint64)
        for i in range(min(self.width, len(h))):
            total += h[i : i + n] * _ODD[-1 - i]
        return np.unique(_mix(total))

    def sign(self, text: str) -> dict:
        """sig (equal for equal sets), fp (SimHash of the set) and bands."""
        own = self.shingles(text)
        low, ones = np.full(BANDS * ROWS, ~np.uint64(0)), np.zeros(64, np.int64)
        for a in range(0, len(own), 8192):
            part = own[a : a + 8192]
            np.minimum(low, (part * _ODD[: BANDS * ROWS, None]).min(1), out=low)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        fp = np.packbits(2 * ones > len(own), bitorder="little").view(np.int64)[0]
        keyed = _mix(low).reshape(BANDS, ROWS)
        bands = np.arange(BANDS, dtype=np.uint64)
        for i in range(ROWS):
            bands = _mix(bands * np.uint64(31) + keyed[:, i])
        return {"sig": xxhash.xxh128_digest(own.tobytes()), "fp": int(fp), "bands": bands.view(np.int64).tolist() if len(own) else []}


SIGNATURE = "struct<sig: binary, fp: long, bands: array<long>>"


def _shards(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``key``, cut only between its values, in lots of about ``TOGETHER`` rows."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= TOGETHER:
            lot = pa.concat_batches(held)
            keys = lot.column(key).to_numpy(zero_copy_only=False)
            at = int(np.searchsorted(keys, keys[-1]))
            if at:
                yield lot.slice(0, at)
            held, n = [lot.slice(at)], lot.num_rows - at
    if n:
        yield pa.concat_batches(held)


def _candidates(shard: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    _, root, parent, edge = forest(shard, fp)
    yield from search(fp, root, parent, edge, radius)


def _found(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _shards(batches, "shard"):
            shard, fp = (lot.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "fp"))
            hit = np.zeros(len(fp), bool)
            for a, _ in _candidates(shard, fp.view(np.uint64), radius):
                hit[a] = True
            yield lot.filter(pa.array(hit))

    return run


def _alike(sets: list[np.ndarray], size: np.ndarray, a: np.ndarray, b: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """Which pairs of sorted sets (of small numbers, the same in all) share enough: both sides of all pairs as one sorted array
    of (pair, number), one looked up in the other."""
    least, most = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    out = similar[1] * least >= similar[0] * most
    at = np.flatnonzero(out)
    ends = np.cumsum(size[a[at]] + size[b[at]])
    start = 0
    while start < len(at):
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + COMPARED, "right")))
        own = at[start:end]
        side = lambda x: (np.repeat(np.arange(len(own)), size[x]) << 32) | np.concatenate([sets[i] for i in x.tolist()])  # noqa: E731,B023
        one, two = side(a[own]), side(b[own])
        place = np.minimum(np.searchsorted(two, one), max(0, len(two) - 1))
        both = np.bincount((one[two[place] == one] >> 32) if len(two) else np.zeros(0, np.int64), minlength=len(own))
        out[own] = similar[1] * both >= similar[0] * (size[a[own]] + size[b[own]] - both)
        start = end
    return out


def _checked(radius: int, similar: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A spanning forest (u, v) of each cell's links; (u, null) for what is not joined to the cell's leader, if it has one."""
        for lot in _shards(batches, "cell"):
            cell, node, fp, lead = (lot.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "node", "fp", "lead"))
            raw = [np.frombuffer(x.as_py(), np.uint64) for x in lot.column("set")]
            size = np.array([len(x) for x in raw], np.int64)
            small = np.unique(np.concatenate(raw), return_inverse=True)[1].astype(np.int64) if len(raw) else np.zeros(0, np.int64)
            sets = np.split(small, np.cumsum(size)[:-1])  # numbers keep the order of the hashes
            del raw, small
            label = np.arange(len(node))

            def find(i: int) -> int:
                while label[i] != i:
                    label[i] = i = label[label[i]]
                return i

            u, v = [], []
            for a, b in _candidates(cell, fp.view(np.uint64), radius):
                once = a < b
                a, b = a[once], b[once]
                for start in range(0, len(a), 4096):  # pairs that earlier ones have joined need no check
                    while (label != (up := label[label])).any():
                        label[:] = up
                    i, j = a[start : start + 4096], b[start : start + 4096]
                    apart = label[i] != label[j]
                    i, j = i[apart], j[apart]
                    good = _alike(sets, size, i, j, similar)
                    for x, y in zip(i[good].tolist(), j[good].tolist(), strict=True):
                        p, q = find(x), find(y)
                        if p != q:
                            label[max(p, q)] = min(p, q)
                            u.append(node[x]), v.append(node[y])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.nulls(len(u), pa.int64())], ["u", "v", "shard"])
            if lead.any():
                root = np.array([find(i) for i in range(len(node))])
                joined = {int(c): int(root[i]) for i, c in zip(np.flatnonzero(lead).tolist(), cell[lead], strict=True)}
                out = [i for i in range(len(node)) if joined.get(int(cell[i]), root[i]) != root[i]]
                yield pa.RecordBatch.from_arrays([pa.array(node[out]), pa.nulls(len(out), pa.int64()), lot.column("shard").take(pa.array(out, pa.int64()))], ["u", "v", "shard"])

    return run


def text_links(table: DataFrame, texts: tuple[DataFrame, str, str], radius: int = RADIUS, similar: tuple[int, int] = SIMILAR, width: int = SHINGLE, tree: int = TREE) -> DataFrame:
    """Links (u, v) that join the same components as all links between similar texts would. ``table`` (node, fp, bands): one row
    for each distinct set of shingles; ``texts``, a ``numbered_table``, has the text of each under its number."""
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = table.select("node", "fp", F.explode("bands").alias("shard"))
    sizes = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(spread(dealt, sizes.withColumn("size", F.col("n")), ["shard"], "n"))
    small = met.where(F.col("size") <= tree)
    sorted_by = lambda df, key: df.repartition(parts, key).sortWithinPartitions(key)
    hit = sorted_by(small.select("shard", "node", "fp"), "shard").mapInArrow(_found(radius), "shard long, node long, fp long")
    large = met.where(F.col("size") > tree).withColumn("chunks", F.ceil(F.col("size") / (tree // 2)).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    live = cut(hit.select("shard", "node", "fp", F.lit(None).cast("int").alias("chunks"), F.lit(None).cast("int").alias("own")).unionByName(large.select("shard", "node", "fp", "chunks", "own")))

    def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(width)
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([signer.shingles(t).tobytes() for t in part.column("text").to_pylist()], pa.binary())], ["node", "set"])

    asking = picked(*texts, live.select(F.col("node").alias("row")).distinct())
    sets = cut(asking.select(F.col(texts[1]).alias("node"), F.col("text").cast("string").alias("text")).mapInArrow(shingle_sets, "node long, set binary"))
    whole = live.join(sets, "node")
    check = lambda cells: sorted_by(cells.select("cell", "shard", "node", "fp", "lead", "set"), "cell").mapInArrow(_checked(radius, similar), "u long, v long, shard long")
    no = F.lit(False).alias("lead")
    # every chunk of a large shard is joined by its leader, the least node
    leaders = large.groupBy("shard").agg(F.min(F.struct("node", "fp", "chunks", "own")).alias("l")).select("shard", "l.*")
    led = leaders.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).join(sets, "node")
    first = whole.where("chunks is null").select("*", F.col("shard").alias("cell"), no).unionByName(
        whole.where("chunks is not null").join(bounded(leaders.select("shard", F.col("node").alias("leader"))), "shard").where("node <> leader").select(*whole.columns, F.xxhash64("shard", "own").alias("cell"), no)
    ).unionByName(led.select(*whole.columns, F.xxhash64("shard", "chunk").alias("cell"), F.lit(True).alias("lead")))
    found = cut(check(first))
    loose = cut(found.where("v is null").select("shard", F.col("u").alias("node")).distinct())
    links = found.where("v is not null").select("u", "v")
    if loose.isEmpty():
        return links
    # what is not joined to its leader meets every chunk, in lots of at most half a tree
    lots = bounded(loose.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / (tree // 2)).cast("int").alias("lots")))
    crowd = whole.where("chunks is not null").join(lots, "shard")
    asking = crowd.join(loose, ["shard", "node"]).withColumn("lot", F.pmod(F.xxhash64("node", F.lit(1)), F.col("lots")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    asked = crowd.join(loose, ["shard", "node"], "left_anti").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).withColumn("chunk", F.col("own"))
    others = crowd.join(loose, ["shard", "node"], "left_semi").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).withColumn("chunk", F.col("own"))
    cells = asking.select("shard", "node", "fp", "set", "lot", "chunk").unionByName(asked.unionByName(others).select("shard", "node", "fp", "set", "lot", "chunk")).dropDuplicates(["shard", "lot", "chunk", "node"])
    return links.unionByName(check(cells.select("*", F.xxhash64("shard", "lot", "chunk").alias("cell"), no)).where("v is not null").select("u", "v"))


def near_texts(docs: DataFrame, radius: int = RADIUS, similar: tuple[int, int] = SIMILAR, width: int = SHINGLE, tree: int = TREE) -> tuple[tuple[DataFrame, str, str], DataFrame, DataFrame]:
    """``docs`` (doc_id, text and any others) as a ``numbered_table``; (row, sig, best) of its rows, see ``numbered``; and (sig, best, root)
    of every distinct shingle set. Rows belong together if their sets are equal or linked; texts without words are equal."""
    name = fresh(docs.columns, "signature")
    line = fresh([*docs.columns, name], "line")

    def factory():
        signer = Signer(width)
        return lambda texts: list(map(signer.sign, texts))

    wide = widen(docs.withColumn(line, F.col("text").cast("string")), name, SIGNATURE, factory, column_read=line)
    sig, fp, bands = (fresh(wide.columns, c) for c in ("sig", "fp_of", "bands"))
    split = wide.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(name)["sig"].alias(sig), F.col(name)["fp"].alias(fp), F.col(name)["bands"].alias(bands))
    table, rows = numbered(docs, split, sig, fp, bands)
    rows = rows.select("row", F.col(sig).alias("sig"), F.col(fp).alias("fp"), F.col(bands).alias("bands"), "best")
    one = cut(rows.groupBy("sig").agg(F.min("row").alias("node"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min("best").alias("best")))
    rooted = named(one.select("node", "sig", "best"), text_links(one.select("node", "fp", "bands"), table, radius, similar, width, tree))
    return table, rows, rooted


def dedup_texts(docs: DataFrame, radius: int = RADIUS, similar: tuple[int, int] = SIMILAR, width: int = SHINGLE, tree: int = TREE) -> DataFrame:
    """``docs`` (doc_id, text and any others) with one row of each group of near-duplicate texts: the row of the smallest doc_id, nulls
    last (of its repeats in the group, a null text first, then the least hash of the text). Texts are alike if they share
    ``similar`` of their ``width``-word shingles (A-Z in lower case), and groups are what such links join. Null, empty and blank
    texts are one group; shorter texts than a shingle are one shingle. An empty table gives an empty one."""
    table, _, rooted = near_texts(docs, radius, similar, width, tree)
    return keep_first(table, rooted.groupBy("root").agg(F.min("best").alias("best")), docs.columns)


def text_groups(docs: DataFrame, radius: int = RADIUS, similar: tuple[int, int] = SIMILAR, width: int = SHINGLE, tree: int = TREE) -> DataFrame:
    """doc_id and group_id, the smallest doc_id of its group (see ``dedup_texts``), null if all its ids are null, for every row."""
    _, rows, rooted = near_texts(docs, radius, similar, width, tree)
    rooted = cut(rooted)
    group = rooted.groupBy("root").agg(F.min("best.b").alias("group_id"), F.count(F.lit(1)).alias("n"))
    by_sig = spread(rooted, group, ["root"]).select("sig", "group_id").join(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n")), "sig")
    return spread(rows.select(F.col("best.b").alias("doc_id"), "sig"), by_sig, ["sig"]).select("doc_id", "group_id")
