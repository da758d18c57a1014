"""Near-duplicate groups by consistent weighted sampling over TF-IDF word shingles.

Weights are a text's counts of a shingle times its inverse document frequency.  Frequencies
are counted exactly over all documents for every shingle that makes up 1/SHARE of all
shingles or more (a document counts each of its shingles once); a rarer one weighs what one
at that share does, and none weighs less than what all documents have.  So the same shares give the same weights in tables of any size, and at
most SHARE shingles have a count of their own.

Texts with the same shingles and counts are one node.  A node draws SAMPLES improved
consistent weighted samples; two nodes agree in one with a chance equal to their weighted
Jaccard similarity.  ROWS samples make a band, and nodes that share a band are a set:

* in a set of up to ALL nodes all are compared with each other;
* in a larger one the node with the largest sets leads and the others are compared with it.
  Those not similar to it meet one that is, picked by a hash, and are dealt anew, by this
  band together with one more, then two more, four more and so on until no set has any left.

A node is so compared with a bounded number of others for each of its bands, whatever the
size of the sets.  What this leaves in different groups though it shares a set is compared
by all its samples, block by block, and there on whole texts: every pair of a set but those in
one group already, so no link is lost to the leaders.  A block gives no more links than join
its groups, and none for a pair that is not similar.  Pairs that agree in under AGREE of their samples are not similar (which
is wrong for one pair in 80 000 at similarity 0.8); the weighted Jaccard similarity of the
others is computed on their whole texts.  Groups are the connected components of the links.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import LOWER_ALNUM, Scratch, batches_of, hash_windows, hash_words, mix64, parts, written

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 two texts share none of 20 bands of 4 samples once in 36 000 times.
BANDS, ROWS = 20, 4
SAMPLES = BANDS * ROWS
AGREE = 48
#: Nodes of a set that are all compared with each other.
ALL = 8
#: Nodes of a set on either side of a block of comparisons, about, and bytes of their packed texts.
BLOCK, BLOCK_BYTES = 2048, 1 << 22
#: Sets that are dealt anew go on by bands in these steps; each comes to all bands.
STEPS = (1, 7, 11)
#: A shingle that is 1/SHARE of all shingles has a count of its own.
SHARE = 1 << 20
#: Counters of shingles by their first bits, which tell what can reach that share.
CELL_BITS, BLOCK_BITS = 22, 16
#: Texts that go to a Python worker at a time.
BATCH_ROWS = 1000
#: Values of each table of random variates.
VARIATES = 1 << 16

_CELL = np.uint64(64 - CELL_BITS)


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text and their counts, in order of their hashes.

    Words are runs of ASCII letters (case folded), digits and bytes beyond ASCII.  Fewer
    than SHINGLE words make one shingle; no words make none.
    """
    return np.unique(_shingles(text), return_counts=True)


def _shingles(text: bytes) -> np.ndarray:
    words = hash_words(text.translate(LOWER_ALNUM))[0]
    return hash_windows(words, min(SHINGLE, len(words))) if len(words) else words


@dataclass(frozen=True)
class Frequencies:
    """Document frequencies: of ``known`` shingles (sorted), and ``floor`` for all others."""

    n: int
    floor: float
    known: np.ndarray
    df: np.ndarray

    def idf(self, shingle: np.ndarray) -> np.ndarray:
        """ln((1 + n) / (1 + df)) + 1."""
        df = np.full(len(shingle), self.floor)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, shingle), len(self.known) - 1)
            df = np.where(self.known[at] == shingle, self.df[at], df)
        return np.log((1.0 + self.n) / (1.0 + df)) + 1

    def weights(self, shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
        return count * self.idf(shingle)


@lru_cache(1)
def _variates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of the gamma(2, 1) distribution of r and c: r, 1/r and ln c."""
    p, low, high = (np.arange(VARIATES) + 0.5) / VARIATES, np.zeros(VARIATES), np.full(VARIATES, 64.0)
    for _ in range(64):
        mid = (low + high) / 2
        less = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return high.astype(np.float32), (1 / high).astype(np.float32), np.log(high).astype(np.float32)


_ODD = mix64(np.arange(20_011, 20_011 + SAMPLES, dtype=np.uint64)) | np.uint64(1)
_32 = np.uint64(32)
#: Shingles drawn from at a time, which bounds the memory for very long texts.
_STEP = 256


def samples(shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """SAMPLES consistent weighted samples of a weighted set, as 64-bit values.

    Each shingle has for each sample a hash; its bits are the places of r and c among their
    quantiles, and the uniform variate.
    """
    r, inverse, log_c = _variates()
    log_w = np.log(weight).astype(np.float32)
    rows, least, drawn = np.arange(SAMPLES), None, None
    for lo in range(0, len(shingle), _STEP):
        part = shingle[lo : lo + _STEP]
        x = _ODD[:, None] * part
        x ^= x >> _32
        bits, at = x.view("<u2"), x.view("<u2")[:, ::4].astype(np.int64)
        t = inverse.take(at, mode="clip")
        t *= log_w[lo : lo + _STEP]
        beta = x.view("<u4")[:, 1::2].astype(np.float32)
        beta *= np.float32(2**-32)
        t += beta
        np.floor(t, out=t)
        a = t - beta
        a += 1
        a *= r.take(at, mode="clip")
        np.subtract(log_c.take(bits[:, 1::4].astype(np.int64), mode="clip"), a, out=a)
        k = a.argmin(1)  # shingles come in order of their hashes: ties go alike
        best, pick = a[rows, k], mix64(part[k] + t[rows, k].astype(np.int64).view(np.uint64))
        if least is None:
            least, drawn = best, pick
        else:
            drawn = np.where(best < least, pick, drawn)
            least = np.minimum(best, least)
    return drawn


def bands(drawn: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of samples."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in drawn.reshape(BANDS, ROWS).T:
        keys = mix64(keys * np.uint64(0xBF58476D1CE4E5B9) + column)
    return keys.view(np.int64)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of shingles and weights."""
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = np.minimum(wa[ia], wb[ib]).sum()
    total = wa.sum() + wb.sum() - both
    return float(both / total) if total else 0.0


# -- document frequencies -----------------------------------------------------------------


def frequencies(texts: DataFrame, scratch: Scratch) -> Frequencies:
    """Counts over the whole column ``text``.

    First every task counts its shingles in cells by their first bits; a shingle cannot
    reach the share if its cell doesn't.  Those in the other cells are then counted exactly.
    """
    spark = texts.sparkSession
    blocks, size = 1 << (CELL_BITS - BLOCK_BITS), 1 << BLOCK_BITS

    def in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n, pack = np.zeros(blocks * size, np.uint32), 0, zstandard.ZstdCompressor(level=1).compress
        for b in parts(batches):
            n += b.num_rows
            found = np.concatenate([shingles(t.encode())[0] for t in b.column(0).to_pylist()])
            cell, times = np.unique((found >> _CELL).astype(np.uint32), return_counts=True)
            cells[cell] += times.astype(np.uint32)
        for k, part in enumerate(cells.reshape(blocks, size)):
            if part.any() or (n and not k):
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "docs": pa.array([0 if k else n], pa.int64()), "z": [pack(part.tobytes())]})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        cells: dict[int, np.ndarray] = {}
        docs: dict[int, int] = {}
        for b in batches:
            for k, n, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cells[k] = cells.get(k, 0) + np.frombuffer(unpack(z), np.uint32).astype(np.int64)
                docs[k] = docs.get(k, 0) + n
        for k, part in cells.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "docs": pa.array([docs[k]], pa.int64()), "shingles": pa.array([int(part.sum())], pa.int64()), "z": [pack(part.tobytes())]})

    cells = texts.select("text").mapInArrow(in_cells, "block int, docs long, z binary").repartition("block")
    cells = scratch.written(cells.mapInArrow(summed, "block int, docs long, shingles long, z binary"), "cells")
    n, total = cells.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("shingles"), F.lit(0))).first()
    floor = max(1.0, min(total / SHARE, n))  # in few long texts the share may lie beyond their number

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            bits = [np.packbits(np.frombuffer(unpack(z), np.int64) >= floor).tobytes() for z in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.binary())], ["block", "bits"])

    bits = np.zeros(blocks * size // 8, np.uint8)
    for k, x in cells.select("block", "z").mapInArrow(reaching, "block int, bits binary").collect():  # 512 KB at any size
        bits[k * size // 8 : (k + 1) * size // 8] = np.frombuffer(x, np.uint8)
    marked = spark.sparkContext.broadcast(bits)

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = np.unpackbits(marked.value).view(bool)
        have, times, more = np.zeros(0, np.uint64), np.zeros(0), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([have, *more])
            value, at = np.unique(every, return_inverse=True)
            return value, np.bincount(at, np.concatenate([times, np.ones(len(every) - len(have))]), len(value))

        for b in parts(batches):
            for t in b.column(0).to_pylist():
                s = _shingles(t.encode())
                more.append(np.unique(s[may[(s >> _CELL).astype(np.int64)]]))
            if sum(map(len, more)) > 1 << 20:
                (have, times), more = merged(), []
        have, times = merged()
        for lo in range(0, len(have), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(have[lo : lo + (1 << 16)].view(np.int64)), pa.array(times[lo : lo + (1 << 16)].astype(np.int64))], ["shingle", "df"])

    df = texts.select("text").mapInArrow(exactly, "shingle long, df long").groupBy("shingle").agg(F.sum("df").alias("df"))
    rows = df.where((F.col("df") > 1) & (F.col("df") >= floor)).toArrow()  # SHARE rows at most
    known = rows["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    return Frequencies(n, floor, known[order], rows["df"].to_numpy()[order].astype(np.float64))


# -- groups ---------------------------------------------------------------------------------

_LOWEST = -(2**63)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its group: id, class_id (the smallest id), class_size, kept, _h.

    Null text counts as empty.  Texts without words are grouped with their exact copies
    alone.  A null id is smaller than any other; rows that repeat id and text are one
    document given twice and carry the same decision.  ``_h`` is the text's MD5.
    """
    spark = docs.sparkSession
    with Scratch(spark, "near-groups") as scratch, batches_of(spark, BATCH_ROWS):
        text = F.coalesce(F.col(text_col), F.lit(""))
        texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("key"), F.unhex(F.md5(text)).alias("h"), text.alias("text"))
        of = frequencies(texts, scratch)
        shared = spark.sparkContext.broadcast(of)

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pack, frequent = zstandard.ZstdCompressor(level=3).compress, shared.value
            for b in parts(batches):
                sets, keys, marks, bodies = [], [], [], []
                for h, t in zip(b.column("h").to_pylist(), b.column("text").to_pylist(), strict=True):
                    raw = t.encode()
                    s, times = shingles(raw)
                    drawn = samples(s, frequent.weights(s, times)) if len(s) else np.zeros(0, np.uint64)
                    sets.append(blake2b(s.tobytes() + times.tobytes() if len(s) else h, digest_size=16, person=b"set" if len(s) else b"text").digest())
                    keys.append(bands(drawn) if len(s) else [])
                    marks.append((drawn >> np.uint64(56)).astype(np.uint8).view(np.int8))
                    bodies.append(pack(raw))
                yield pa.RecordBatch.from_arrays(
                    [b.column("key"), b.column("h"), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int8())), pa.array(bodies, pa.binary())],
                    ["key", "h", "set", "bands", "marks", "z"],
                )

        rows = texts.mapInArrow(sketch, "key long, h binary, set binary, bands array<long>, marks array<byte>, z binary")
        rows = scratch.written(rows.select("*", F.octet_length("z").alias("bytes"), F.monotonically_increasing_id().alias("row")), "sketches")
        of_set = scratch.written(rows.groupBy("set").agg(F.min("row").alias("node")), "node-of-set")
        links, members = _links(rows, of_set, shared, scratch)
        labels = components(links, scratch)
        more = scratch.written(_missed(members, labels, rows, shared, scratch), "missed")
        if not more.isEmpty():
            labels = components(links.unionByName(more), scratch)
        placed = rows.select("key", "h", "set").join(of_set, "set").join(labels, "node", "left").select("key", "h", F.coalesce("label", "node").alias("root"))
        placed = scratch.written(placed, "placed")
        sizes = scratch.written(placed.groupBy("root").agg(F.min("key").alias("first"), F.count("*").alias("class_size")), "sizes")
        back = lambda c: F.when(F.col(c) != _LOWEST, F.col(c))
        groups = placed.join(sizes, "root").select(back("key").alias(id_col), back("first").alias("class_id"), "class_size", (F.col("key") == F.col("first")).alias("kept"), F.col("h").alias("_h"))
        return written(groups, "near")


def _ends(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _links(rows: DataFrame, of_set: DataFrame, shared, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs of nodes a, b that are similar to each other or their leaders; the members of all sets: sid, node, n."""
    save = scratch.written
    nodes = save(rows.where(F.size("bands") > 0).select(F.col("row").alias("node"), "bands").join(of_set.select("node"), "node", "left_semi"), "nodes")
    members = nodes.select("node", F.posexplode("bands").alias("band", "sid"))
    counted = save(members.join(members.groupBy("sid").agg(F.count("*").alias("n")).where("n > 1"), "sid"), "members")
    scores = counted.groupBy("node").agg(F.sum("n").alias("score"))
    active = save(counted.select("sid", "node", "band", F.lit(None).cast("int").alias("step")).join(scores, "node"), "active")

    links, extra, turn, taken = [], None, 0, 1
    while True:
        turn += 1
        sets = active.groupBy("sid").agg(F.max_by("node", F.struct("score", "node")).alias("lead"), F.count("*").alias("n")).where("n > 1")
        met = save(active.join(sets, "sid"), "sets")
        few = met.where(F.col("n") <= ALL).groupBy("sid").agg(F.array_sort(F.collect_list("node")).alias("of"))  # ALL nodes at most
        each = F.transform("of", lambda x, i: F.transform(F.slice("of", i + 2, ALL), lambda y: F.struct(x.alias("a"), y.alias("b"))))
        pairs = few.select(F.explode(F.flatten(each)).alias("p")).select("p.a", "p.b")
        many = met.where((F.col("n") > ALL) & (F.col("node") != F.col("lead"))).select("sid", "node", "band", "step", "score", *_ends("lead", "node"))
        pairs = pairs.unionByName(many.select("a", "b"))
        pairs = (pairs if extra is None else pairs.unionByName(extra)).distinct()
        near = _similar(pairs, rows, shared, scratch, turn == 1)
        links.append(near)
        left = save(many.join(near, ["a", "b"], "left_anti").drop("a", "b"), "left")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, links), counted
        extra = None
        if turn == 1:
            alike = many.join(near, ["a", "b"], "left_semi").groupBy("sid").agg(F.min_by("node", F.xxhash64("node", "sid")).alias("other"))
            extra = save(left.join(alike, "sid").select(*_ends("other", "node")).distinct(), "extra")
        steps = F.array(*map(F.lit, STEPS)) if turn == 1 else F.array("step")
        dealt = left.join(nodes.select("node", "bands"), "node").withColumn("step", F.explode(steps))
        # as many bands more as the sets have now, so that the bands in common double
        others = [F.get("bands", F.pmod(F.col("band") + F.col("step") * k, F.lit(BANDS))) for k in range(taken, 2 * taken)]
        active = dealt.select(F.xxhash64("sid", "step", *others).alias("sid"), "node", "band", "step", "score")
        taken *= 2


def _missed(members: DataFrame, labels: DataFrame, rows: DataFrame, shared=None, scratch: Scratch | None = None) -> DataFrame:
    """Pairs a, b that share a set of over ALL, have different labels and agree in AGREE samples.

    In each set the nodes outside the largest group meet all nodes, in blocks that are
    dealt over the tasks; the largest group is not compared with itself.  With ``shared``
    weights the pairs are compared on whole texts where they meet, each in the first band
    that its nodes share, and of the similar ones come as many as join the labels of a block.
    """
    whole = shared is not None
    nodes = rows.select(F.col("row").alias("node"), "marks", *(["bytes", "bands"] if whole else [F.lit(0).alias("bytes")]))
    placed = members.where(F.col("n") > ALL).select("sid", "node").join(labels, "node", "left").select("sid", "node", F.coalesce("label", "node").alias("label"))
    placed = placed.join(nodes.select("node", "bytes"), "node")
    sets = placed.groupBy("sid", "label").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes")).groupBy("sid")
    sets = sets.agg(F.max_by(F.struct("label", "size", "bytes"), F.struct("size", "label")).alias("main"), F.sum("size").alias("n"), F.sum("bytes").alias("bytes")).where("n > main.size")
    block = lambda n, size: F.ceil(F.greatest(n / F.lit(BLOCK), size / F.lit(BLOCK_BYTES))).cast("int")
    sets = sets.select("sid", F.col("main.label").alias("main"), block(F.col("n") - F.col("main.size"), F.col("bytes") - F.col("main.bytes")).alias("of_rest"), block(F.col("n"), F.col("bytes")).alias("of_all"))
    each = placed.drop("bytes").join(sets, "sid").join(nodes.drop("bytes"), "node").withColumn("outer", F.col("label") != F.col("main"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["outer", "node", "label", "marks", *(["bands"] if whole else [])]
    rest = each.where("outer").select("sid", own("of_rest").alias("i"), upto("of_all").alias("j"), F.lit(True).alias("rest"), *columns)
    every = each.select("sid", upto("of_rest").alias("i"), own("of_all").alias("j"), F.lit(False).alias("rest"), *columns)
    blocks = rest.unionByName(every).groupBy("sid", "i", "j")
    if not whole:
        return blocks.applyInArrow(_agreeing_pairs, "a long, b long").distinct()
    facing = scratch.written(blocks.applyInArrow(_agreeing_nodes, "sid long, i int, j int, rest boolean, outer boolean, node long, label long"), "facing")
    texts = rows.select(F.col("row").alias("node"), "marks", "bands", "z").hint("merge")

    def joining(both: pa.Table) -> pa.Table:
        return _joining_links(both, shared.value)

    return facing.join(texts, "node").groupBy("sid", "i", "j").applyInArrow(joining, "a long, b long").distinct()


def _agreeing(both: pa.Table, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each node of the rest in a block, and of those it agrees with under another label."""
    mine, outer, node = (both.column(c).to_numpy() for c in ("rest", "outer", "node"))
    lists = lambda c, n: both.column(c).combine_chunks().flatten().to_numpy().reshape(-1, n)
    marks, keys = lists("marks", SAMPLES), lists("bands", BANDS) if "bands" in both.column_names else None
    every = np.flatnonzero(~mine)
    of, outside, names = marks[every], outer[every], node[every]
    for k in np.flatnonzero(mine):
        met = every[(np.count_nonzero(of == marks[k], axis=1) >= AGREE) & (label[every] != label[k]) & ~(outside & (names < node[k]))]
        if keys is not None and len(met):  # a pair belongs to the first set that it shares
            met = met[keys[k][(keys[met] == keys[k]).argmax(1)] == both.column("sid")[0].as_py()]
        if len(met):
            yield k, met


def _agreeing_pairs(both: pa.Table) -> pa.Table:
    node, a, b = both.column("node").to_numpy(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, met in _agreeing(both, both.column("label").to_numpy()):
        a.append(np.minimum(node[met], node[k]))
        b.append(np.maximum(node[met], node[k]))
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def _agreeing_nodes(both: pa.Table) -> pa.Table:
    """The rows of a block that agree with any."""
    some = np.zeros(both.num_rows, bool)
    for k, met in _agreeing(both, both.column("label").to_numpy()):
        some[k] = some[met] = True
    return both.select(["sid", "i", "j", "rest", "outer", "node", "label"]).filter(pa.array(some))


def _joining_links(both: pa.Table, frequent: Frequencies) -> pa.Table:
    """Of the pairs of a block that agree and are similar, as many as join its labels."""
    unpack, node, label = zstandard.ZstdDecompressor().decompress, both.column("node").to_numpy(), both.column("label").to_numpy().copy()
    sets = [shingles(unpack(z.as_py())) for z in both.column("z")]
    names, at = np.unique(np.concatenate([s for s, _ in sets]), return_inverse=True)
    ends = np.cumsum([0, *(len(s) for s, _ in sets)])
    at, weight = at.astype(np.int32), np.concatenate([frequent.weights(*x) for x in sets])
    total = np.add.reduceat(weight, ends[:-1])
    del sets
    mine, links = np.zeros(len(names)), []
    for k, met in _agreeing(both, label):
        own = at[ends[k] : ends[k + 1]]
        mine[own] = weight[ends[k] : ends[k + 1]]
        for m in met:
            if label[m] != label[k]:
                part = slice(ends[m], ends[m + 1])
                common = np.minimum(mine[at[part]], weight[part]).sum()
                alike = common / (total[k] + total[m] - common)
                if abs(alike - SIMILARITY) < 1e-9:  # on the border the order of the sums tells
                    alike = similarity(names[own], mine[own], names[at[part]], weight[part])
                if alike >= SIMILARITY:
                    links.append(sorted((int(node[k]), int(node[m]))))
                    label[label == label[m]] = label[k]
        mine[own] = 0
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _similar(pairs: DataFrame, rows: DataFrame, shared, scratch: Scratch, many: bool) -> DataFrame:
    """The pairs a, b that are similar: by their samples, then on their whole texts.

    Where there are ``many``, as many as texts, the joins are planned alike at every size.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, frequent = zstandard.ZstdDecompressor().decompress, shared.value
        recent: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()  # leaders come again and again

        def weighted(node: int, z: bytes) -> tuple[np.ndarray, np.ndarray]:
            if node in recent:
                recent.move_to_end(node)
                return recent[node]
            s, times = shingles(unpack(z))
            made = s, frequent.weights(s, times)
            if len(s) <= 10_000:
                recent[node] = made
                if len(recent) > 64:
                    recent.popitem(last=False)
            return made

        for b in parts(batches):
            ma, mb = (b.column(c).flatten().to_numpy().reshape(-1, SAMPLES) for c in ("ma", "mb"))
            at = np.flatnonzero((ma == mb).sum(1) >= AGREE)
            both = b.select(["a", "b", "za", "zb"]).take(pa.array(at)).to_pydict()
            near = [similarity(*weighted(x, zx), *weighted(y, zy)) >= SIMILARITY for x, y, zx, zy in zip(*both.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(at[near])), b.column("b").take(pa.array(at[near]))], ["a", "b"])

    end = lambda c: rows.select(F.col("row").alias(c), F.col("marks").alias(f"m{c}"), F.col("z").alias(f"z{c}"))
    hinted = lambda df: df.hint("merge") if many else df
    both = pairs.join(hinted(end("b")), "b").join(hinted(end("a")), "a").select("a", "b", "ma", "mb", "za", "zb")
    return scratch.written(both.mapInArrow(compare, "a long, b long"), "links")


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node of each connected component, by spreading minima.

    Every step takes the smallest label among a node's neighbours, then the label's own
    label, so that long chains shorten by half.
    """
    edges = scratch.written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    labels = scratch.written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).select(F.col("u").alias("node"), "label"), "labels")
    while True:
        around = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("other")).withColumnRenamed("u", "node")
        step = labels.join(around, "node").select("node", F.least("label", "other").alias("new"), F.col("label").alias("old"))
        own = labels.select(F.col("node").alias("new"), F.col("label").alias("next"))
        step = scratch.written(step.join(own, "new").select("node", F.least("new", "next").alias("label"), "old"), "labels")
        changed = not step.where("label != old").isEmpty()
        labels = step.select("node", "label")
        if not changed:
            return labels


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id; all columns stay."""
    gone = near_groups(docs, id_col, text_col).where("NOT kept").select(F.col(id_col).alias("_gone_id"), F.col("_h").alias("_gone_h")).distinct()
    h = F.unhex(F.md5(F.coalesce(docs[text_col], F.lit(""))))
    # columns of one side each, so that no name of the caller's is mistaken
    return docs.join(gone, (h == gone["_gone_h"]) & docs[id_col].eqNullSafe(gone["_gone_id"]), "left_anti")
