"""Token ids of documents in files of wavelet matrices, in ascending doc_id order, and what is read from them.

Texts are encoded where they lie; only ids move, once, to the task that writes their range of doc_ids. A task sorts its rows and
cuts them into files of about ``SHARD`` ids (a document is never split). Files are written under a name of their own attempt
and then moved to a name that follows from their place, so a task that runs again, or twice, leaves the same files. The
manifest that the job returns names them; what no manifest names is no part of the table."""

from __future__ import annotations

import bisect
import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanac.llm.common import bounded, checkpoint_folder, pieces
from almanac.llm.wavelet import Shard, pack

#: Ids of a file, words of a generation that a worker remembers, and rows for each range from which the bounds of the ranges are taken.
SHARD, REMEMBERED, PER_RANGE = 1 << 21, 400_000, 64
_loaded: dict[int, tuple] = {}


#: Fixed value: the pattern of a tokenizer whose tokens lie inside runs of letters, single digits, or runs of other signs.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Signs (no apostrophe, no part of a special token) that end a word after a letter or digit: a run of their own.
_SIGNS = b"""!"#$%&()*+,-./:;=?@[\\]^_`{}~"""
_LETTER = re.compile(rb"(?:[A-Za-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])\Z")  # and the letters of Latin-1
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


class Known(dict):
    """What ``make`` makes of each word, made when it is first asked for. In two generations: when the new one is full it becomes the
    old one, so frequent words stay."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """The tokenizers library over words. If the tokenizer's file says that it lowers case, drops white space and takes tokens from
    the runs of ``RUNS``, the ids of a text are those of its words, apart at ASCII white space, in lower case (of A-Z, unless the text
    has marks that such a letter may be composed with, or special tokens), and those of a word are those of what is before its
    final signs and of the signs; so the library gets a run when it is met anew. With any other tokenizer, or without ``apart``, it
    gets whole texts. What was met lives as long as the worker, up to a bound; a batch asks for each of its distinct words once, and
    a plain run goes to the library's model without the steps before it."""

    def __init__(self, told: str, apart: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        key = hash(told)
        if key not in _loaded:
            made = Tokenizer.from_str(told)
            made.no_truncation(), made.no_padding()
            # the signs that stand for the bytes of a letter, as the library names them
            level = ByteLevel(add_prefix_space=False, use_regex=False)
            signs = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(256) if _PLAIN.fullmatch(chr(i).encode())}
            _loaded[key] = made, made.model.tokenize, signs, Known(self._parts, REMEMBERED), Known(self._run, REMEMBERED)
        self.model, self.merged, self.signs, self.words, self.runs = _loaded[key]
        rule = json.loads(told)
        steps = lambda kind, many: (rule.get(kind) or {}).get(many) or [rule.get(kind) or {}]
        runs = [x.get("pattern", {}).get("Regex") for x in steps("pre_tokenizer", "pretokenizers") if x.get("type") == "Split" and x.get("behavior") == "Removed" and x.get("invert")]
        plain = all(not (x["single_word"] or x["lstrip"] or x["rstrip"]) and re.fullmatch(r"<\|\w+\|>", x["content"]) for x in rule.get("added_tokens", []))
        last = (rule.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[-1]
        bytes_next = last.get("type") == "ByteLevel" and not last.get("use_regex") and not last.get("add_prefix_space")
        self.apart = apart and plain and bytes_next and runs == [RUNS] and {x.get("type") for x in steps("normalizer", "normalizers")} == {"NFC", "Replace", "Lowercase"}
        self.kind = np.dtype("<u2" if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")

    def _ids(self, text: bytes) -> bytes:
        return array(self.kind.char, self.model.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def _run(self, word: bytes) -> bytes:
        """A run's ids; one of plain letters is composed and in lower case already."""
        if _PLAIN.fullmatch(word):
            return array(self.kind.char, [t.id for t in self.merged(word.decode().translate(self.signs))]).tobytes()
        return self._ids(word)

    def _parts(self, word: bytes) -> bytes:
        """A word's ids: those of what is before its final signs, and those of the signs."""
        body = word.rstrip(_SIGNS)
        if len(body) < len(word) and _LETTER.search(body[-2:]):
            return self.runs[body] + self.runs[word[len(body) :]]
        return self.runs[word]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers."""
        return self.column(texts).to_pylist()

    def column(self, texts: list[bytes]) -> pa.Array:
        """The same as an Arrow column."""
        if not self.apart:
            return pa.array(map(self._ids, texts), pa.binary())
        lower = [t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower() for t in texts]
        words = pc.ascii_split_whitespace(pa.array(lower, pa.binary()).view(pa.string()))
        met = words.values.dictionary_encode()
        distinct = met.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False)
        ids = pa.array(map(self.words.__getitem__, distinct), pa.binary()).take(met.indices)
        return pc.binary_join(pa.ListArray.from_arrays(words.offsets, ids), b"")


def _bounds(docs: DataFrame, width: int) -> list[tuple]:
    """Upper ends of ``width`` ranges of (null or not, doc_id, hash of the text, row) with about equal bytes, from at most some
    ``PER_RANGE`` rows for each range: they decide which task gets a row, and nothing else."""
    n = docs.count()
    most = PER_RANGE * width
    sample = docs if n <= most else docs.sample(most / n, 20240229)
    rows = sorted((r[0] is not None, r[0] or 0, r[1], r[2], r[3]) for r in sample.select("doc_id", "tie", "row", F.coalesce(F.octet_length("text"), F.lit(0)) + 64).collect())
    sums = np.cumsum([r[4] for r in rows]) if rows else np.zeros(0)
    at = np.searchsorted(sums, [sums[-1] * i / width for i in range(1, width)]) if rows else []
    return sorted({rows[i][:4] for i in at})


def encoded(docs: DataFrame, told: str, bounds: list[tuple], end: int, apart: bool = True) -> DataFrame:
    """(pid, doc_id, tie, row, ids) of ``docs`` (doc_id, tie, row, text): ids with ``end`` after them, and the number of their range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(told, apart)
        last = np.array([end], encode.kind).tobytes()
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_numpy(zero_copy_only=False)]
                keys = zip(*(part.column(c).to_pylist() for c in ("doc_id", "tie", "row")), strict=True)
                pid = [bisect.bisect_left(bounds, (d is not None, d or 0, t, r)) for d, t, r in keys]
                made = pc.binary_join_element_wise(encode.column(texts), last, b"")
                yield pa.RecordBatch.from_arrays([pa.array(pid, pa.int32()), part.column("doc_id"), part.column("tie"), part.column("row"), made], ["pid", "doc_id", "tie", "row", "ids"])

    return docs.select("doc_id", "tie", "row", "text").mapInArrow(run, "pid int, doc_id long, tie long, row long, ids binary")


def _place(folder: str):
    """The file system and the path of ``folder``, for tasks: local and shared disks, and the stores that Arrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if ":" in folder else f"file://{folder}")


MANIFEST = "pid int, part int, name string, n_docs long, n_ids long, n_bytes long"


def _writer(folder: str, kind: str, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows of one or more ranges, each range into files of its own."""
        store, path = _place(folder)
        held, total, pid, part = [], 0, None, 0

        def flush() -> pa.RecordBatch:
            raw = [r for _, r in held]
            ends = np.cumsum([len(r) for r in raw], dtype=np.int64) // np.dtype(kind).itemsize
            data, name = pack(np.frombuffer(b"".join(raw), kind), [d for d, _ in held], ends), f"ids-{pid:06d}-{part:06d}.wm"
            own = f"{path}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(data)
            store.move(own, f"{path}/{name}")
            return pa.RecordBatch.from_pylist([{"pid": pid, "part": part, "name": name, "n_docs": len(held), "n_ids": int(ends[-1]), "n_bytes": len(data)}], schema=pa.schema([("pid", pa.int32()), ("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

        size = np.dtype(kind).itemsize
        for batch in batches:
            for p, d, raw in zip(*(batch.column(c).to_pylist() for c in ("pid", "doc_id", "ids")), strict=True):
                if held and (p != pid or total + len(raw) > shard * size):
                    yield flush()
                    held, total, part = [], 0, part + 1 if p == pid else 0
                pid = p
                held.append((d, raw))
                total += len(raw)
        if held:
            yield flush()

    return run


def write(docs: DataFrame, tokenizer: str, end: int, folder: str | None = None, shard: int = SHARD, apart: bool = True) -> tuple[str, DataFrame]:
    """Writes the ids of ``docs`` (doc_id, text; others are ignored) into ``folder`` (a new one below the shared checkpoint folder,
    if none is given; its owner removes it) and returns it with the manifest: pid, part, name, n_docs, n_ids, n_bytes and start,
    the ids of all files before. ``tokenizer``: path of a file of the tokenizers library. ``end`` ends each document.

    Documents are in ascending order of doc_id, nulls first; equal ids by the hash of their text, so repeated rows each have a
    place. Null and empty texts are only ``end``. An empty table gives an empty manifest and no files."""
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with open(tokenizer, encoding="utf-8") as f:
        told = f.read()
    folder = folder or f"{checkpoint_folder(spark)}/ids-{uuid.uuid4().hex}"
    store, path = _place(f"{folder}/files")
    store.create_dir(path, recursive=True)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()).withColumn("tie", F.xxhash64("text"))
    bounds = _bounds(rows, width)
    dealt = encoded(rows, told, bounds, end, apart).repartitionById(width, "pid").sortWithinPartitions("pid", F.asc_nulls_first("doc_id"), "tie", "row")
    done = dealt.select("pid", "doc_id", "ids").mapInArrow(_writer(f"{folder}/files", Encoder(told, apart).kind.str, shard), MANIFEST)
    done.write.parquet(f"{folder}/manifest")
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = manifest.groupBy("pid").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("pid")) - F.col("n")).select("pid", "before")
    here = F.sum("n_ids").over(W.partitionBy("pid").orderBy("part")) - F.col("n_ids")
    return folder, manifest.join(bounded(before), "pid").withColumn("start", F.col("before") + here).drop("before")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of the files in ``folder``, each read whole by one task."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.wm").load(f"{folder}/files")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def _over_files(df: DataFrame, make, kind: str) -> DataFrame:
    """``make(shard)`` gives the columns of each file's rows; the file's name is the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                columns = make(Shard(content.as_py()))
                n = len(next(iter(columns.values())))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), *columns.values()], ["name", *columns])

    return df.mapInArrow(run, f"name string, {kind}")


def documents(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, all from its file."""
    import zlib

    def told(shard: Shard) -> dict:
        ids, ends = shard.ids().astype("<u4"), shard.ends
        starts = np.concatenate([[0], ends[:-1]])
        sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return {"doc_id": pa.array(shard.doc_ids, pa.int64()), "place": pa.array(starts), "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array(sums, pa.int64())}

    found = _over_files(files(spark, folder), told, "doc_id long, place long, n_tokens long, ids_crc32 long")
    return found.join(bounded(manifest.select("name", F.col("start").alias("first"))), "name").select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def counts(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """(token, n) of each of the given ids (a stated list): ranks, without unpacking the files."""
    asked = list(dict.fromkeys(tokens))
    each = _over_files(files(spark, folder), lambda s: {"token": pa.array(asked, pa.int64()), "n": pa.array([s.rank(t) for t in asked], pa.int64())}, "token long, n long")
    return each.groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, folder: str, manifest: DataFrame, token: int) -> DataFrame:
    """(doc_id, place, at) of every occurrence of an id: its place among all ids, and in its document. Select over the planes."""

    def told(shard: Shard) -> dict:
        places = [shard.select(token, k) for k in range(shard.rank(token))]
        docs = [shard.document(p) for p in places]
        starts = [int(shard.ends[d - 1]) if d else 0 for d in docs]
        return {"doc_id": pa.array([shard.doc_ids[d] for d in docs], pa.int64()), "own": pa.array(places, pa.int64()), "at": pa.array([p - a for p, a in zip(places, starts, strict=True)], pa.int64())}

    found = _over_files(files(spark, folder), told, "doc_id long, own long, at long")
    return found.join(bounded(manifest.select("name", "start")), "name").select("doc_id", (F.col("start") + F.col("own")).alias("place"), "at")


def window(spark: SparkSession, folder: str, manifest: DataFrame, start: int, n: int) -> DataFrame:
    """(place, token) of the ``n`` ids (a stated, bounded number) from place ``start`` among all ids on: each by access, from those
    files alone that hold one. Places beyond the end have no row."""
    held = manifest.where((F.col("start") < start + n) & (F.col("start") + F.col("n_ids") > start)).select("name", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, content in zip(batch.column("start").to_pylist(), batch.column("content"), strict=True):
                shard = Shard(content.as_py())
                own = range(max(0, start - first), min(shard.n, start + n - first))
                yield pa.RecordBatch.from_arrays([pa.array([first + i for i in own], pa.int64()), pa.array([shard.access(i) for i in own], pa.int64())], ["place", "token"])

    return files(spark, folder).join(bounded(held), "name").select("start", "content").mapInArrow(run, "place long, token long")
