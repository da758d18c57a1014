"""Nearest neighbours from a stored index: cells by k-means, product-quantised codes, exact re-rank.

Vectors are scaled to length 1.  Cells and code books are fitted on a bounded sample on the
driver; every row is then given its nearest cell and, for each part of what it differs from
the cell's centre, the nearest entry of that part's book.  The table is stored by cell, so a
query reads the files of the cells that it probes, and of those only ids and codes; the
candidates are then compared by their true cosine.  How many cells to probe and how many
candidates to compare is measured on the sample, for a recall that is asked for: vectors in
clusters need few, vectors that lie anyhow need most.  An exact search compares all rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from stratalex.operators.retrieval import cosine

#: Vectors that cells and books are fitted on, at most; every vector is indexed.
SAMPLE = 50_000
ENTRIES, ROUNDS, SEED = 256, 12, 42
#: Sample vectors that are asked to measure the recall.
ASKED = 64
#: Blocks that many queries are compared with: how many, about, with how many rows at least and numbers in their vectors at most.
BLOCKS, LEAST_ROWS, BLOCK_NUMBERS = 64, 1024, 1 << 22
#: Rows whose distances from all centres are taken at once.
NEAREST = 1 << 10
#: Pairs in a matrix product, pairs compared truly at once, what a product's rounding may be, and tasks at most.
TILE, COMPARED, SLACK, MOST_TASKS = 1 << 21, 1 << 16, 1e-9, 4096


class Quantiser(NamedTuple):
    """``centres`` of the cells, for each part of a vector the ``books`` of what differs from a centre, and what a search takes.

    ``probes`` cells are read, and ``rerank`` times the wanted rows are compared truly.
    """

    centres: np.ndarray
    books: list[np.ndarray]
    probes: int = 1
    rerank: int = 1

    @property
    def cuts(self) -> list[slice]:
        ends = np.cumsum([0, *(b.shape[1] for b in self.books)])
        return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T).argmax(1)

    def codes(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest = x - self.centres[cells]
        return np.stack([_nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], 1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row of zeros stays."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out, sizes = np.zeros(len(x), np.int64), (centres**2).sum(1)
    for at in range(0, len(x), NEAREST):  # so that distances stay in the cache
        far = x[at : at + NEAREST] @ centres.T
        far *= -2
        far += sizes
        out[at : at + NEAREST] = far.argmin(1)
    return out


def _k_means(x: np.ndarray, k: int, scaled: bool, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(1) if scaled else _nearest(x, centres)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, column, len(centres)) for column in x.T], 1)
        empty = sizes == 0
        centres = np.where(empty[:, None], x[rng.integers(0, len(x), len(centres))], sums / np.maximum(sizes, 1)[:, None])
        if scaled:
            centres = unit(centres)
    return centres


def _measured(q: Quantiser, x: np.ndarray, k: int, recall: float) -> Quantiser:
    """``q`` with the least probes and re-ranked candidates that reach the recall of the k nearest in the sample."""
    asked, own = x[:ASKED], q.cells(x)
    k = max(min(k, len(x)), 1)
    true = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :k]
    order = np.argsort(-(asked @ q.centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each cell, in each query's order
    needed = np.sort(np.take_along_axis(place, own[true], 1).ravel()) + 1
    goal = (1 + recall) / 2  # cells and codes may each lose half of what may be lost
    probes = int(needed[min(int(np.ceil(goal * len(needed))), len(needed)) - 1])
    codes = q.codes(x, own)
    near = (asked @ q.centres.T)[:, own]
    for j, (c, book) in enumerate(zip(q.cuts, q.books, strict=True)):
        near += (asked[:, c] @ book.T)[:, codes[:, j]]
    near[np.take_along_axis(place, np.broadcast_to(own, near.shape), 1) >= probes] = -np.inf
    by_code = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
    behind = np.sort(np.take_along_axis(by_code, true, 1).ravel()) + 1
    last = int(behind[min(int(np.ceil(recall * len(behind))), len(behind)) - 1])
    return q._replace(probes=probes, rerank=max(-(-last // k), 1))


def fit(rows: DataFrame, vector: str, cells: int, parts: int = 16, k: int = 200, recall: float = 0.97) -> Quantiser:
    """A quantiser from the ``SAMPLE`` rows with the least hashes of their vector, which are the same on every run.

    The recall is that of the share of the sample that k rows are of the table.
    """
    known = rows.where(F.col(vector).isNotNull()).select(vector)
    n = known.count()
    sample = known.orderBy(F.xxhash64(vector)).limit(SAMPLE).toPandas()[vector]
    x = unit(np.array(sample.tolist(), float)) if len(sample) else np.zeros((1, 1))
    rng = np.random.default_rng(SEED)
    centres = _k_means(x, min(cells, len(x)), True, rng)
    rest = x - centres[(x @ centres.T).argmax(1)]
    cuts = np.array_split(np.arange(x.shape[1]), min(parts, x.shape[1]))
    q = Quantiser(centres, [_k_means(rest[:, c], min(ENTRIES, len(x)), False, rng) for c in cuts])
    return _measured(q, x, max(round(k * len(x) / max(n, 1)), 10), recall)


def write(rows: DataFrame, id_col: str, vector: str, path: str, cells: int = 64, parts: int = 16, k: int = 200, recall: float = 0.97) -> Quantiser:
    """Stores id, vector and codes by cell, in order of the id, and the quantiser beside them.

    A cell that holds a large share of all rows is written by several tasks.  Rows without a
    vector are left out.
    """
    q = fit(rows, vector, cells, parts, k, recall)
    shared = rows.sparkSession.sparkContext.broadcast(q)

    @F.pandas_udf("struct<cell:int,codes:array<short>>")
    def placed(vectors: pd.Series) -> pd.DataFrame:
        x = unit(np.array(vectors.tolist(), float).reshape(len(vectors), -1))
        own = shared.value.cells(x)
        return pd.DataFrame({"cell": own.astype(np.int32), "codes": list(shared.value.codes(x, own).astype(np.int16))})

    made = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("vector"), placed(vector).alias("p"))
    made = made.select("id", "vector", "p.codes", "p.cell").repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
    made.write.partitionBy("cell").parquet(f"{path}/rows")
    tables = [("takes", 0, np.array([[q.probes, q.rerank]])), ("centres", 0, q.centres), *(("book", i, b) for i, b in enumerate(q.books))]
    model = [(kind, part, i, [float(v) for v in row]) for kind, part, table in tables for i, row in enumerate(table)]
    rows.sparkSession.createDataFrame(model, "kind string, part int, i int, row array<double>").coalesce(1).write.parquet(f"{path}/quantiser")
    return q


def read_quantiser(spark: SparkSession, path: str) -> Quantiser:
    """The stored quantiser: a row for each cell and book entry."""
    model = spark.read.parquet(f"{path}/quantiser").toPandas().sort_values(["kind", "part", "i"])
    of = lambda kind, part: np.array(model[(model["kind"] == kind) & (model["part"] == part)]["row"].tolist())
    books = [of("book", p) for p in sorted(model[model["kind"] == "book"]["part"].unique())]
    return Quantiser(of("centres", 0), books, *map(int, of("takes", 0)[0]))


def _rows(spark: SparkSession, path: str, cells: Sequence[int] | None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/rows")
    return rows if cells is None else rows.where(F.col("cell").isin(*map(int, cells)))


def probed(q: Quantiser, query: Sequence[float], probes: int | None) -> list[int]:
    """The cells to look into, the nearest first."""
    order = np.argsort(-(q.centres @ np.asarray(query, float)), kind="stable")
    return [int(c) for c in order[: probes or q.probes]]


def search(spark: SparkSession, path: str, query: Sequence[float], k: int, probes: int | None = None, rerank: int | None = None, exact: bool = False) -> DataFrame:
    """id, cos of the k most similar rows of the ``probes`` nearest cells, the smaller id first where equal.

    The ``rerank`` times k best by their codes are compared by true cosine.  Both are the
    measured numbers unless given; an ``exact`` search compares all rows of all cells.
    """
    q = read_quantiser(spark, path)
    cells = probed(q, query, probes)
    rows = _rows(spark, path, None if exact else cells)
    if not exact:
        mine = unit(np.asarray(query, float)[None])[0]
        base = F.array(*[F.lit(float(v)) for v in q.centres @ mine])
        score = F.get(base, F.col("cell"))
        for j, (c, book) in enumerate(zip(q.cuts, q.books, strict=True)):
            score = score + F.get(F.array(*[F.lit(float(v)) for v in book @ mine[c]]), F.get("codes", j))
        best = rows.select("id", "cell", score.alias("_near")).orderBy(F.desc("_near"), "id").limit((rerank or q.rerank) * k)
        rows = rows.join(F.broadcast(best.select("id", "cell")), ["id", "cell"], "left_semi")  # rerank * k rows
    return rows.select("id", cosine(F.col("vector"), query).alias("cos")).orderBy(F.desc("cos"), "id").limit(k)


def _layout(sizes: dict[int, int], dim: int) -> dict[int, tuple[int, int]]:
    """The first block of each cell and how many it has: small cells share a block, large ones are split."""
    most = min(max(math.ceil(sum(sizes.values()) / BLOCKS), LEAST_ROWS), max(BLOCK_NUMBERS // max(dim, 1), 1))
    out: dict[int, tuple[int, int]] = {}
    block = held = 0
    for cell, n in sorted(sizes.items()):
        parts = -(-n // most)
        if held and held + n > most:
            block, held = block + 1, 0
        out[cell] = (block, parts)
        block, held = (block + parts, 0) if parts > 1 else (block, held + n)
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products of two tables' rows, added in the order of the columns."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _best(q: np.ndarray, x: np.ndarray, met: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in q and in x, and the cosine, of the k rows of x most like each row of q, the first ones where equal.

    ``met`` tells which pairs count (None: all).  A matrix product finds what may be among the
    k best, but for its rounding; that is compared by sums in a fixed order.  A vector whose
    length a product could lose is always compared so.
    """
    qq, xx = _dots(q, q), _dots(x, x)
    plain = lambda sq: (sq > 1e-100) & (sq < 1e100)
    scaled = lambda a, sq: np.divide(a, np.sqrt(sq)[:, None], out=np.zeros_like(a), where=plain(sq)[:, None])
    near_q, near_x, odd = scaled(q, qq), scaled(x, xx).T.copy(), ~plain(xx)
    found = []
    for at in range(0, len(q), step := max(TILE // len(x), 1)):
        tile = slice(at, at + step)
        near = near_q[tile] @ near_x
        if met is not None:
            near[~met[tile]] = -np.inf
        near[:, odd] = -np.inf
        least = np.partition(near, -k, axis=1)[:, -k] - SLACK if k < len(x) else np.full(len(near), -np.inf)
        take = (near >= least[:, None]) | odd | ~plain(qq[tile])[:, None]
        if met is not None:
            take &= met[tile]
        i, j = np.nonzero(take)
        cos = np.zeros(len(i))
        for c in range(0, len(i), COMPARED):
            some = slice(c, c + COMPARED)
            a, b = i[some] + at, j[some]
            size = np.sqrt(qq[a] * xx[b])
            cos[some] = np.divide(_dots(q[a], x[b]), size, out=np.zeros(len(a)), where=~(size <= 0))
        order = np.lexsort((j, np.where(np.isnan(cos), -np.inf, -cos), i))
        i, j, cos = i[order], j[order], cos[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((i[first] + at, j[first], cos[first]))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _table(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def search_many(queries: DataFrame, id_col: str, vector: str, path: str, k: int, probes: int | None = None) -> DataFrame:
    """query_id, id, cos, rank: the k most similar rows for each row of ``queries``, from the cells that it probes.

    Cells are dealt to blocks of a bounded size.  A query goes to the blocks of its cells, and
    each block is compared as matrices with a bounded part of its queries, in a task that
    returns k rows for each; so neither pairs nor whole tables pass anything.
    """
    spark = queries.sparkSession
    q = read_quantiser(spark, path)
    rows = _rows(spark, path, None).drop("codes")
    layout = _layout({r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}, q.centres.shape[1])  # a row for each cell
    shared = spark.sparkContext.broadcast((q, layout))

    @F.pandas_udf("array<struct<block:int,cells:array<int>>>")
    def blocks(vectors: pd.Series) -> pd.Series:
        q, layout = shared.value
        near = np.array(vectors.tolist(), float).reshape(len(vectors), -1) @ q.centres.T
        out = []
        for cells in np.argsort(-near, axis=1, kind="stable")[:, : probes or q.probes].tolist():
            of: dict[int, list[int]] = {}
            for c in cells:
                for b in range(layout[c][0], sum(layout[c])) if c in layout else ():
                    of.setdefault(b, []).append(c)
            out.append([{"block": b, "cells": v} for b, v in of.items()])
        return pd.Series(out)

    known = queries.where(F.col(vector).isNotNull())
    parts = max(-(-known.count() // max(BLOCK_NUMBERS // q.centres.shape[1], 1)), 1)
    asked = known.select(F.col(id_col).alias("query_id"), F.col(vector).alias("_q"), F.pmod(F.xxhash64(id_col, vector), F.lit(parts)).cast("int").alias("part"), F.explode(blocks(vector)).alias("b"))
    asked = asked.select("query_id", "_q", "part", "b.block", "b.cells")
    places = spark.createDataFrame([(c, *of) for c, of in layout.items()], "cell int, first int, n int")
    block = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("n"))).cast("int")
    dealt = rows.join(F.broadcast(places), "cell").select("id", "vector", "cell", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def compared(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(asked) or not len(rows):
            return schema.empty_table()
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")], null_placement="at_start"))
        own, at = np.unique(rows["cell"].to_numpy(), return_inverse=True)
        probe = np.array([np.isin(own, c) for c in asked["cells"].to_pylist()])
        i, j, cos = _best(_table(asked["_q"]), _table(rows["vector"]), None if probe.all() else probe[:, at], k)
        return pa.Table.from_arrays([asked["query_id"].take(pa.array(i)), rows["id"].take(pa.array(j)), pa.array(cos)], schema=schema)

    kinds = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField("id", rows.schema["id"].dataType), StructField("cos", DoubleType())])
    schema = to_arrow_schema(kinds)
    # a number of partitions of its own, as groups are small but take long
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4 * parts * max(map(sum, layout.values()), default=1), MOST_TASKS))
    asked, dealt = (d.repartition(n, "block", "part") for d in (asked, dealt))
    met = asked.groupBy("block", "part").cogroup(dealt.groupBy("block", "part")).applyInArrow(compared, kinds)
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cos"), "id"))).where(F.col("rank") <= k)


def files_read(spark: SparkSession, path: str, query: Sequence[float], probes: int | None = None) -> tuple[int, int]:
    """Files of the probed cells, and of all."""
    cells = probed(read_quantiser(spark, path), query, probes)
    every = _rows(spark, path, None).inputFiles()
    return sum(any(f"/cell={c}/" in f for c in cells) for f in every), len(every)

