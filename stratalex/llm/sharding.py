"""Placement of keys on shards by a permutation-filled lookup table.

Every shard has its own order of the table's slots; the shards take turns and each claims
the first free slot of its order until the table is full.  The size is a prime, so that
every offset and step give a full permutation.  Shares differ by at most one slot, and a
shard that comes or goes moves few keys.  The table has a fixed size and is broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the table: a prime, over 100 for each of the default 64 shards.
SLOTS = 8191
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
#: A table beyond this many slots is refused, as it is broadcast.
MOST_SLOTS = 1_000_003


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """Number of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    if not _prime(slots) or slots > MOST_SLOTS:
        raise ValueError(f"slots must be a prime up to {MOST_SLOTS}")
    offset = [zlib.crc32(f"offset {s}".encode()) % slots for s in shards]
    step = [zlib.crc32(f"step {s}".encode()) % (slots - 1) + 1 for s in shards]
    owner, turn, left = [-1] * slots, [0] * len(shards), slots
    while True:
        for i in range(len(shards)):
            while owner[at := (offset[i] + turn[i] * step[i]) % slots] >= 0:
                turn[i] += 1
            owner[at] = i
            turn[i] += 1
            left -= 1
            if not left:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 32 bits of its text's MD5; null is the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % slots).cast("int")


def _free(docs: DataFrame, name: str) -> str:
    """``name``, with underscores in front while ``docs`` has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def assign_shards(docs: DataFrame, key_col: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``docs`` with _slot and _shard (the shard's number); no shuffle.

    Equal keys share a shard; a null key counts as the empty text.  Where ``docs`` has a
    column of such a name it stays, and the new one has one more underscore in front.
    """
    spark, slot = docs.sparkSession, _free(docs, "_slot")
    owners = spark.createDataFrame(list(enumerate(lookup_table(shards, slots))), f"{slot} int, {_free(docs, '_shard')} int")
    return docs.withColumn(slot, slot_of(F.col(key_col), slots)).join(F.broadcast(owners), slot)


def write_shards(docs: DataFrame, path: str, key_col: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS, files: int = 8) -> None:
    """Writes ``docs`` as one folder for each shard, in up to ``files`` files each, with all columns of ``docs``.

    The rows of a shard are dealt over ``files`` tasks by a hash of the whole row, so a
    hot key does not meet in one of them.
    """
    placed = assign_shards(docs, key_col, shards, slots)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(files))
    shard = _free(docs, "_shard")
    placed.repartition(len(shards) * files, shard, salt).drop(_free(docs, "_slot")).write.partitionBy(shard).parquet(path)
