"""Token ids in binary shard files, with a minimal perfect hash index over document keys.

``write_store`` encodes every text, appends an end id, and writes the ids of ascending
document ids as raw little-endian integers, one ``.ids`` file for each range of ids.  The
index is one ``.mph`` file for each part of the hashed keys: bit arrays in which a key
that is alone at its hashed place sets a bit and the others go on to the next array, so
that the rank of a key's bit is its slot among 0..n-1.  A slot holds a 32-bit fingerprint
of its key, the shard, the first id and the number of ids.  A lookup of one key reads a few
words of bits and ranks, one slot and the ids, each by its offset, however many documents
there are.

Files are written by tasks through ``pyarrow.fs`` under a temporary name and then moved,
so a task that runs again leaves one whole file.
"""

from __future__ import annotations

import io
import json
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.llm.common import mix64, scratch_path, written
from stratalex.llm.tokens import encoder

#: Keys in one part of the index, on average.
PART_KEYS = 100_000
#: Bytes of ids in one batch that is read back, about.
BATCH_BYTES = 1 << 23
#: Bits of an array for each key that reaches it, and arrays before the rest is listed.
GAMMA, LEVELS = 2.0, 40
_NULL = np.uint64(1 << 40)


# -- files ------------------------------------------------------------------------------


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(uri: str, chunks: Iterator[bytes]) -> None:
    where, path = _open(uri)
    folder = path.rpartition("/")[0]
    where.create_dir(folder, recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(chunk)
    where.move(own, path)


def _get(uri: str) -> bytes:
    where, path = _open(uri)
    with where.open_input_stream(path) as f:
        return f.read()


# -- minimal perfect hash -----------------------------------------------------------------


def key_hash(ids: np.ndarray, is_null: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """64-bit keys; a bijection of the id for the first row of every id."""
    low = np.where(is_null, 0, ids).astype(np.int64).view(np.uint64)
    n = seq.astype(np.uint64) + np.where(is_null, _NULL, np.uint64(0))
    return mix64(low ^ np.where(n > 0, mix64(n), np.uint64(0)))


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    return mix64(keys ^ seed) % np.uint64(size)


class PerfectHash:
    """Maps n distinct 64-bit keys to 0..n-1; other keys get any slot or -1."""

    def __init__(self, sizes: list[int], words: np.ndarray, rest: np.ndarray) -> None:
        self.sizes, self.words, self.rest = sizes, words, rest
        self.first = np.concatenate([[0], np.cumsum([(s + 63) // 64 for s in sizes])]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, arrays = np.unique(keys), [], []
        if len(left) != len(keys):
            raise ValueError("keys repeat")
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, math.ceil(GAMMA * len(left)))
            at = _place(left, level, size).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros((size + 63) // 64 * 64, np.uint8)
            bits[at[alone]] = 1
            arrays.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone]
        return cls(sizes, np.concatenate(arrays) if arrays else np.zeros(0, "<u8"), left)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = _place(keys[todo], level, size)
            word = self.first[level] + (at >> np.uint64(6)).astype(np.int64)
            shift = at & np.uint64(63)
            has = (self.words[word] >> shift) & np.uint64(1) == 1
            below = self.words[word[has]] & ((np.uint64(1) << shift[has]) - np.uint64(1))
            out[todo[has]] = self.ranks[word[has]] + np.bitwise_count(below)
            todo = todo[~has]
        if len(todo) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            has = self.rest[at] == keys[todo]
            out[todo[has]] = self.ranks[-1] + at[has]
        return out

    def dump(self) -> bytes:
        head = json.dumps({"sizes": self.sizes, "words": len(self.words), "rest": len(self.rest)}).encode()
        arrays = (self.words, self.ranks[:-1], self.rest)
        return len(head).to_bytes(4, "little") + head + b"".join(a.astype("<u8").tobytes() for a in arrays)

    @classmethod
    def load(cls, f: io.BytesIO) -> PerfectHash:
        head = json.loads(f.read(int.from_bytes(f.read(4), "little")))
        words = np.frombuffer(f.read(8 * head["words"]), "<u8")
        f.seek(8 * head["words"], io.SEEK_CUR)  # the ranks follow from the words
        return cls(head["sizes"], words, np.frombuffer(f.read(8 * head["rest"]), "<u8"))


_SLOT = np.dtype([("mark", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("n", "<u8")])


def _mark(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys + np.uint64(0x51ED2701)) >> np.uint64(32)).astype(np.uint32)


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((mix64(~keys) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _keys(rows: pd.DataFrame) -> np.ndarray:
    null = rows["id"].isna().to_numpy()
    return key_hash(rows["id"].fillna(0).to_numpy(np.int64), null, rows["seq"].to_numpy(np.int64))


def _find_one(f, key: np.ndarray) -> np.void | None:
    """The cell of one key, from a file that is read in a few places."""

    def word(at: int) -> int:
        f.seek(at)
        return int.from_bytes(f.read(8), "little")

    f.seek(0)
    size = int.from_bytes(f.read(4), "little")
    head = json.loads(f.read(size))
    words = 4 + size
    ranks, rest = words + 8 * head["words"], words + 16 * head["words"]
    slot, first = None, 0
    for level, n in enumerate(head["sizes"]):
        at = int(_place(key, level, n)[0])
        bits, bit = word(words + 8 * (first + at // 64)), 1 << at % 64
        if bits & bit:
            slot = word(ranks + 8 * (first + at // 64)) + (bits & (bit - 1)).bit_count()
            break
        first += (n + 63) // 64
    if slot is None:
        low, high, wanted = 0, head["rest"], int(key[0])
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if word(rest + 8 * mid) < wanted else (low, mid)
        if low == head["rest"] or word(rest + 8 * low) != wanted:
            return None
        last = word(ranks + 8 * (head["words"] - 1)) + word(words + 8 * (head["words"] - 1)).bit_count() if head["words"] else 0
        slot = last + low
    f.seek(rest + 8 * head["rest"] + slot * _SLOT.itemsize)
    cell = np.frombuffer(f.read(_SLOT.itemsize), _SLOT)[0]
    return cell if cell["mark"] == _mark(key)[0] else None


def _lookup(blob: bytes, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    f = io.BytesIO(blob)
    table = PerfectHash.load(f)
    cells = np.frombuffer(f.read(), _SLOT)
    slots = table.slots(keys)
    got = cells[np.maximum(slots, 0)] if len(cells) else np.zeros(len(keys), _SLOT)
    return got, (slots >= 0) & (got["mark"] == _mark(keys))


# -- writing ------------------------------------------------------------------------------


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Writes ids and index under ``path``; returns the manifest.

    Null text counts as empty (its ids are the end id alone).  Rows that repeat an id get
    entries of their own, in the order of their texts' hashes; null ids come first.  Ranges
    are of id and that hash, so rows of one id may fill many shards.  Every task holds one
    batch of texts and one shard's narrow index rows.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = end_id.to_bytes(2, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, ids_of = TaskContext.get().partitionId(), [], encoder(vocabulary).encode

        def chunks() -> Iterator[bytes]:
            at, last, seq = 0, (), 0
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for lo in range(0, len(ids), 256):
                    for i, b in zip(ids[lo : lo + 256], ids_of(texts[lo : lo + 256]), strict=True):
                        seq, last = (seq + 1, last) if (i,) == last else (0, (i,))
                        n = len(b) // 2 + 1
                        rows.append((i, seq, shard, at, n))
                        at += n
                        yield b + end

        _put(f"{path}/{shard:06d}.ids", chunks())
        for lo in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[lo : lo + 10_000], strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["id", "seq", "shard", "first", "n"])

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .withColumns({"hash": F.xxhash64("text"), "salt": F.monotonically_increasing_id() % 1024})
        .repartitionByRange(shards, "id", "hash", "salt")
        .sortWithinPartitions("id", "hash", "text", "salt")
        .select("id", "text")
    )
    entries = written(ordered.mapInArrow(encode, "id long, seq long, shard int, first long, n long"), "entries")
    ends = [F.min_by("id", "first").alias("head"), F.max_by("id", "first").alias("tail"), F.max_by("seq", "first").alias("last")]
    sums = entries.groupBy("shard").agg(F.sum("n").alias("n"), F.count("*").alias("docs"), *ends).orderBy("shard").collect()  # one row for each shard
    entries = _numbered_on(entries, sums)
    parts = max(1, math.ceil(sum(r["docs"] for r in sums) / PART_KEYS))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys = _keys(rows)
        table = PerfectHash.build(keys)
        cells = np.zeros(len(keys), _SLOT)
        slot = table.slots(keys)
        cells["mark"][slot] = _mark(keys)
        for name in ("shard", "first", "n"):
            cells[name][slot] = rows[name].to_numpy()
        _put(f"{path}/{int(rows['part'].iloc[0]):06d}.mph", iter([table.dump(), cells.tobytes()]))
        return pd.DataFrame({"part": rows["part"].iloc[:1], "n": [len(rows)]})

    with_part(entries, parts).groupBy("part").applyInPandas(build, "part long, n long").agg(F.sum("n")).collect()
    bases, at = {}, 0
    for r in sums:
        bases[r["shard"]] = at
        at += r["n"]
    manifest = {"path": path, "parts": parts, "bases": bases, "ids": at, "vocabulary": vocabulary}
    return manifest | {"entries": entries}


def _numbered_on(entries: DataFrame, sums: list) -> DataFrame:
    """Goes on with the numbers of rows of one id where they fill more than one shard."""
    more, before, carried = [], None, 0
    for r in sums:
        base = carried if before is not None and before == (r["head"],) else 0
        if base:
            more.append((r["shard"], r["head"], base))
        before, carried = (r["tail"],), r["last"] + 1 + (base if r["head"] == r["tail"] else 0)
    if not more:
        return entries
    bases = F.broadcast(entries.sparkSession.createDataFrame(more, "_shard int, _head long, _base long"))  # one row for each shard at most
    both = entries.join(bases, (F.col("shard") == F.col("_shard")) & F.col("id").eqNullSafe(F.col("_head")), "left")
    return both.select("id", (F.col("seq") + F.coalesce("_base", F.lit(0))).alias("seq"), "shard", "first", "n")


def with_part(entries: DataFrame, parts: int) -> DataFrame:
    """Adds the part of the index that holds the key of (id, seq)."""

    @F.pandas_udf("long")
    def part(i: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series(_part_of(_keys(pd.DataFrame({"id": i, "seq": s})), parts))

    return entries.withColumn("part", part("id", "seq"))


# -- reading ------------------------------------------------------------------------------


def read_store(keys: DataFrame, manifest: dict) -> DataFrame:
    """Ids of the given keys (id, seq), found by the index: id, seq, start, ids (binary).

    ``start`` counts the ids of all documents before it.  Keys that the store does not
    have are left out (but for one in 2**32 by the fingerprint).
    """
    path, bases = manifest["path"], manifest["bases"]

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        got, ok = _lookup(_get(f"{path}/{int(rows['part'].iloc[0]):06d}.mph"), _keys(rows))
        out = rows[["id", "seq"]].assign(**{c: got[c].astype(np.int64) for c in ("shard", "first", "n")})
        return out[ok]

    def packed(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["id", "seq", "start", "ids"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, f = -1, None
        for batch in batches:
            out: list[list] = [[], [], [], []]
            held = 0
            for i, q, s, first, n in zip(*(batch.column(c).to_pylist() for c in ("id", "seq", "shard", "first", "n")), strict=True):
                if s != shard:
                    where, p = _open(f"{path}/{s:06d}.ids")
                    shard, f = s, pa.BufferedInputStream(where.open_input_file(p), 1 << 20)
                    at = 0
                if first < at:
                    where, p = _open(f"{path}/{s:06d}.ids")
                    f, at = pa.BufferedInputStream(where.open_input_file(p), 1 << 20), 0
                while at < first:
                    at += len(f.read(min(2 * (first - at), 1 << 22))) // 2
                for column, x in zip(out, (i, q, bases[s] + first, f.read(2 * n)), strict=True):
                    column.append(x)
                at, held = at + n, held + 2 * n
                if held > BATCH_BYTES:
                    yield packed(out)
                    out, held = [[], [], [], []], 0
            yield packed(out)

    found = with_part(keys.select("id", "seq"), manifest["parts"]).groupBy("part").applyInPandas(find, "id long, seq long, shard long, first long, n long")
    return found.repartition("shard").sortWithinPartitions("shard", "first").mapInArrow(fetch, "id long, seq long, start long, ids binary")


def get_ids(manifest: dict, doc_id: int | None, seq: int = 0) -> list[int] | None:
    """Ids of one document, by a few short reads of the index and one of the ids; None if not there."""
    key = key_hash(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([seq]))
    part = int(_part_of(key, manifest["parts"])[0])
    where, p = _open(f"{manifest['path']}/{part:06d}.mph")
    if where.get_file_info(p).size is None:
        return None
    with where.open_input_file(p) as f:
        cell = _find_one(f, key)
    if cell is None:
        return None
    where, p = _open(f"{manifest['path']}/{int(cell['shard']):06d}.ids")
    with where.open_input_file(p) as f:
        f.seek(2 * int(cell["first"]))
        return np.frombuffer(f.read(2 * int(cell["n"])), "<u2").tolist()


def store_digest(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes a store, reads every document back by its key, and sums up what was read."""
    manifest = write_store(docs, scratch_path(spark, "tokens"), vocabulary, end_id, id_col, text_col)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, "<u2") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("start"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return read_store(manifest["entries"], manifest).mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")
