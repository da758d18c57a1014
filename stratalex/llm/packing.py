"""Best-fit packing of tokenised documents into sequences, improved by local search.

Texts are encoded once, where they are read; from there on only narrow piece rows move.
The pieces are dealt at random over groups of a bounded size, and each group is packed in
one task: best fit in the order of arrival, then a local search by swaps, which empties the
bins that this leaves over.  A group leaves a bin or two partly filled, so groups cost next
to nothing in sequences.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import written
from stratalex.llm.tokens import encoder

#: Tokens of a sequence, and pieces packed in one task on average.
CAPACITY = 2048
GROUP_PIECES = 20_000
#: Room below which bins are looked up one by one rather than by the mask of the rest.
NARROW = 16


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32.

    Null text counts as empty and gives the end id alone.  Only longer documents are cut;
    the first piece takes what is over, the others are full.
    """
    end = end_id.to_bytes(2, "little")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary).encode
        for batch in batches:
            ids, texts, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for lo in range(0, len(ids), 256):
                for i, b in zip(ids[lo : lo + 256], ids_of(texts[lo : lo + 256]), strict=True):
                    wide = np.frombuffer(b + end, "<u2").astype("<u4")
                    ends = range(len(wide) % capacity or capacity, len(wide) + 1, capacity) if len(wide) > capacity else [len(wide)]
                    at = 0
                    for k, to in enumerate(ends):
                        rows.append((i, k, at, to - at, zlib.crc32(wide[at:to].tobytes())))
                        at = to
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(cut, schema)


class Bins:
    """Bins of one group, filled in the order of arrival and then improved by exchanges.

    The search takes the emptiest bins one after another and hands their items to fuller
    ones: an item moves into a bin, or one or two items change places with one of a bin, or
    one with two.  Every exchange makes the fuller bin fuller, so squared fill grows.  Where
    none does, an item may change places with two of a full bin that are as long together,
    as smaller items find places more easily.  A bin that can't be emptied is set aside, and
    the search ends when no bin was emptied in a whole round or all room together is less
    than a bin's.

    What can be taken from a bin (nothing, an item or two) is indexed by what it leaves room
    for, so that a give finds an exact partner, or else the next larger place, at once.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.items, self.room, self.exchanges = capacity, [], [], 0
        sets = lambda: [set() for _ in range(capacity + 1)]
        self.narrow, self.wide, self.full = sets(), sets(), sets()
        self.mask = 0  # bit k: a bin with wide room has a take that leaves room for k

    @property
    def used(self) -> int:
        return sum(1 for x in self.items if x)

    def fill(self, lengths: list[int]) -> None:
        """Best fit in the order given."""
        free, mask = [[] for _ in range(self.capacity + 1)], 0
        for i, n in enumerate(lengths):
            if fits := mask >> n:
                r = n + (fits & -fits).bit_length() - 1
                b = free[r].pop()
                if not free[r]:
                    mask &= ~(1 << r)
            else:
                r, b = self.capacity, len(self.items)
                self.items.append([])
                self.room.append(r)
            self.items[b].append((n, i))
            self.room[b] = r = r - n
            free[r].append(b)
            mask |= 1 << r

    def _takes(self, b: int) -> Iterator[tuple[int, tuple[int, tuple]]]:
        room, own = self.room[b], self.items[b]
        if room:
            yield room, (b, ())
            for y in own:
                yield room + y[0], (b, (y,))
        for two in combinations(own, 2):
            yield room + two[0][0] + two[1][0], (b, two)

    def _file(self, b: int) -> None:
        if (room := self.room[b]) >= NARROW:
            for k, take in self._takes(b):
                self.wide[k].add(take)
                self.mask |= 1 << k
        else:
            index = self.narrow if room else self.full
            for k, take in self._takes(b):
                index[k].add(take)

    def _unfile(self, b: int) -> None:
        if (room := self.room[b]) >= NARROW:
            for k, take in self._takes(b):
                self.wide[k].discard(take)
                if not self.wide[k]:
                    self.mask &= ~(1 << k)
        else:
            index = self.narrow if room else self.full
            for k, take in self._takes(b):
                index[k].discard(take)

    def _exchange(self, a: int) -> tuple[tuple, tuple[int, tuple]] | None:
        """What bin ``a`` gives, and the bin and its items that it gets for it.

        The other bin keeps as little room as possible, and of such the one that gains most.
        """
        mine, room, cap = self.items[a], self.room, self.capacity
        gives = [((x,), x[0]) for x in mine] + [(two, n) for two in combinations(mine, 2) if (n := two[0][0] + two[1][0]) <= cap]
        gain, best, most = 0, None, room[a]  # room left beyond that would make squared fill shrink
        for d in range(min(NARROW, most)):
            for give, n in gives:
                if n + d <= cap:
                    for index in (self.narrow, self.wide):
                        for take in index[n + d]:
                            if (more := room[take[0]] - d) > gain and len(give) + len(take[1]) < 4:
                                gain, best = more, (give, take)
            if best:
                return best
        for give, n in gives:
            d, mask = NARROW - 1, self.mask >> (n + NARROW)
            while mask:
                step = (mask & -mask).bit_length()
                d, mask = d + step, mask >> step
                if d >= most:
                    break
                for take in self.wide[n + d]:
                    if (more := room[take[0]] - d) > 0 and len(give) + len(take[1]) < 4 and (d < most or more > gain):
                        gain, best, most = more, (give, take), d
        if best is None:
            best = next((((x,), take) for x in mine for take in self.full[x[0]]), None)
        return best

    def improve(self) -> None:
        for b in range(len(self.items)):
            self._file(b)
        spare, emptied = sum(self.room), True
        while emptied:
            emptied = False
            for a in sorted((b for b in range(len(self.items)) if self.items[b] and self.room[b]), key=lambda b: -self.room[b]):
                if spare < self.capacity:
                    return
                if not self.room[a]:
                    continue
                self._unfile(a)
                while self.items[a] and (found := self._exchange(a)):
                    give, (b, back) = found
                    self._unfile(b)
                    for x in give:
                        self.items[a].remove(x)
                    for y in back:
                        self.items[b].remove(y)
                    self.items[a].extend(back)
                    self.items[b].extend(give)
                    moved = sum(x[0] for x in give) - sum(y[0] for y in back)
                    self.room[a] += moved
                    self.room[b] -= moved
                    self.exchanges += 1
                    self._file(b)
                if self.items[a]:
                    self._file(a)
                else:
                    spare, emptied = spare - self.capacity, True


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; bins are numbered from 0 without gaps."""
    bins = Bins(capacity)
    bins.fill(lengths.tolist())
    bins.improve()
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for n, items in enumerate(x for x in bins.items if x):
        at = 0
        for length, i in items:
            bin_of[i], offset[i] = n, at
            at += length
    return bin_of, offset


def best_fit(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with sequence_id and offset.

    A full piece is a sequence of its own.  The others go to groups by a hash of a number
    that is given to each row as it is written, so that repeated ids, equal lengths or a
    hot source cannot meet in one group.  Repeated rows are packed one by one; an empty
    table gives no rows.
    """
    pieces = written(pieces_of(docs, vocabulary, end_id, capacity, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < capacity)
    groups = max(1, math.ceil(short.count() / GROUP_PIECES))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        bin_of, offset = pack(rows["length"].to_numpy(), capacity)
        return rows.drop(columns=["row", "group"]).assign(sequence_id=rows["group"] * 2**32 + bin_of, offset=offset)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = short.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long")).groupBy("group").applyInPandas(place, schema)
    full = pieces.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
