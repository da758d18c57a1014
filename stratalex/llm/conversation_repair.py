"""Repair of the role structure of conversations, by Dial's shortest paths with small integer costs.

Valid conversations have the role initials ``(s?(ua)+)?``.  Each row is kept (K, cost 0),
given the other role (R, 1) or deleted (D, 2); empty rows can be inserted anywhere (I, 5); a
truncated row that stays costs 5 more; blank rows and duplicates must go.  Nodes are (place
among the rows that may stay, what stands before: nothing, s, u, a).  As all costs are small
integers, nodes wait in buckets by distance instead of a heap; distances to the end are
recorded, and from the start the tight arcs are walked, the least letter first, which gives
the least of the cheapest audits.  Rows that must go change no distance but by 2, and as D is
the least letter they go before anything is inserted at their place, so they are left out of
the graph.

A conversation of any length is cut into blocks of at most 2^BLOCK_BITS different rows.  For each
block the distances from its four entries to its four exits are found; a conversation of
several blocks has these chained, one small row for each block, from its end for the
distances behind a block and from its start for the state before it.  So no graph is larger
than a block.  Equal rows of one turn are summed up to one with a number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stratalex.llm.common import Scratch, written

BLOCK_BITS = 12
WHITE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: States by what stands before: nothing, system, user, assistant; and what may come next.
START, S, U, A = range(4)
NEXT = (U, U, A, U)
KEPT = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}, "o": {}}
#: Distances to a valid end: nothing is missing, both, an assistant, nothing.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
#: Patterns up to this length are looked up in a worker's memory.
SHORT = 24


def _arcs(symbol: str) -> list[list[tuple[str, int, int]]]:
    """For each state the letters, costs and next states of one row, the least letter first."""
    cut = TRUNCATED if symbol.isupper() else 0
    out = []
    for q in range(4):
        arcs = [("D", DELETE, q)]
        if q in KEPT[symbol.lower()]:
            arcs.append(("K", cut, KEPT[symbol.lower()][q]))
        arcs.append(("R", REROLE + cut, NEXT[q]))
        out.append(arcs)
    return out


ARCS = {c: _arcs(c) for c in "suaoSUAO"}


def distances(pattern: str, end: tuple[int, ...]) -> list[list[int]]:
    """Distance of each (place, state) to the end of ``pattern``, where a state has ``end`` still to go."""
    n = len(pattern)
    into: dict[str, list[list[tuple[int, int]]]] = {c: [[] for _ in range(4)] for c in set(pattern)}
    for c, by_state in into.items():
        for q, arcs in enumerate(ARCS[c]):
            for _, cost, to in arcs:
                by_state[to].append((cost, q))
    found = [[FAR] * 4 for _ in range(n + 1)]
    buckets: list[list[tuple[int, int]]] = []

    def reach(place: int, state: int, distance: int) -> None:
        if distance < found[place][state]:
            found[place][state] = distance
            while len(buckets) <= distance:
                buckets.append([])
            buckets[distance].append((place, state))

    for q in range(4):
        if end[q] < FAR:
            reach(n, q, end[q])
    now = 0
    while now < len(buckets):
        for place, state in buckets[now]:  # arcs of cost 0 add to the bucket that is read
            if found[place][state] != now:
                continue
            if place < n:
                for q in range(4):
                    if NEXT[q] == state:
                        reach(place, q, now + INSERT)
            if place:
                for cost, q in into[pattern[place - 1]][state]:
                    reach(place - 1, q, now + cost)
        buckets[now] = []
        now += 1
    return found


def walk(pattern: str, found: list[list[int]], state: int) -> tuple[list[str], int]:
    """The edits at each row of ``pattern`` on the least of the shortest paths, and the state behind it."""
    edits, place, inserted = [], 0, ""
    while place < len(pattern):
        togo = found[place][state]
        arcs = [*ARCS[pattern[place]][state], ("I", INSERT, NEXT[state])]
        for letter, cost, to in sorted(arcs):
            if togo == cost + found[place if letter == "I" else place + 1][to]:
                break
        state = to
        if letter == "I":
            inserted += "I"
        else:
            edits.append(inserted + letter)
            place, inserted = place + 1, ""
    return edits, state


def _solved(pattern: str, end: tuple[int, ...], entries: tuple[int, ...]) -> tuple[list[list[str]], list[int]]:
    live = pattern.replace("x", "")
    found = distances(live, end)
    ways = [walk(live, found, q) for q in entries]
    dealt = []
    for edits, _ in ways:
        each = iter(edits)
        dealt.append(["D" if c == "x" else next(each) for c in pattern])
    return dealt, [w[1] for w in ways]


_remembered = lru_cache(1 << 15)(_solved)


def solved(pattern: str, end: tuple[int, ...], entries: tuple[int, ...]) -> tuple[list[list[str]], list[int]]:
    """For each entry the edit of each row, of which x must go, and the state behind the pattern."""
    return (_remembered if len(pattern) <= SHORT else _solved)(pattern, end, entries)


def crossings(pattern: str) -> list[int]:
    """Distances from each state before ``pattern`` (16 values: by entry, then by exit)."""
    by_exit = [distances(pattern.replace("x", ""), tuple(0 if q == e else FAR for q in range(4)))[0] for e in range(4)]
    return [by_exit[e][q] for q in range(4) for e in range(4)]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that a hash of (conversation, turn) chooses; nulls count as one space.

    Of 20 hashes 0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it
    and 4 sets its role to user.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20).alias("h")
    text, role = F.col("text"), F.col("role")
    hurt = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), h).where("h <> 0")
    return hurt.select(
        "conv_id", "turn",
        F.when(F.col("h") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _cells(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for equal rows of a turn, in order, without the text.

    c, t, role, h (hash of the text), copies, kind (o, s, u, a by initial), fault (blank,
    duplicate, truncated or null, of the first copy), seq (ascending in order), block.
    """
    seen = F.rtrim(F.col("text"), F.lit(WHITE))
    each = rows.select(
        F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.coalesce("role", F.lit(" ")).alias("role"), _hash(F.coalesce("text", F.lit(" "))).alias("h"),
        F.coalesce(seen == "", F.lit(True)).alias("blank"), (~F.substring(seen, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    cells = each.groupBy("c", "t", "role", "h").agg(F.count("*").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    cells = scratch.written(cells, "cells")
    place = F.struct(F.col("t").isNotNull().alias("known"), F.col("t").alias("t"))  # nulls first
    firsts = cells.where("NOT blank").groupBy("c", "role", "h").agg(F.min(place).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    same = F.col("x.c").eqNullSafe(F.col("y.c")) & (F.col("x.role") == F.col("y.role")) & (F.col("x.h") == F.col("y.h"))
    both = cells.alias("x").join(firsts.alias("y"), same, "left")
    later = F.col("y.first").isNotNull() & (F.struct(F.col("x.t").isNotNull().alias("known"), F.col("x.t").alias("t")) > F.col("y.first"))
    fault = F.when(F.col("blank"), "blank").when(later, "duplicate").when(F.col("cut"), "truncated")
    initial = F.substring("x.role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    order = ["c", "t", "role", "h"]
    both = both.select(*[F.col(f"x.{k}").alias(k) for k in order], "copies", kind.alias("kind"), fault.alias("fault"))
    both = both.repartitionByRange(*order).sortWithinPartitions(*order)
    # ids ascend inside each range, and from range to range
    both = both.withColumn("seq", F.monotonically_increasing_id())
    return scratch.written(both.withColumn("block", F.shiftright("seq", BLOCK_BITS)), "order")


def _figures(cells: DataFrame) -> DataFrame:
    """c, gaps, blank, duplicate, truncated, illegal: pairs of neighbours are counted in blocks, then between them."""
    of = lambda f: F.col("fault").eqNullSafe(f)
    again = F.col("copies") - 1
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind"))), lambda x: x["kind"])
    blocks = cells.groupBy("c", "block").agg(
        kinds.alias("kinds"),
        F.sum(F.when(of("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(of("blank"), 0).when(of("duplicate"), F.col("copies")).otherwise(again)).alias("duplicate"),
        F.sum(of("truncated").cast("long")).alias("truncated"),
        F.sum(again).alias("again"),
    )
    bad = lambda a, b: ~F.concat(a, b).isin("su", "ua", "au")
    inside = F.size(F.filter(F.zip_with(F.slice("kinds", F.lit(1), F.size("kinds") - 1), F.slice("kinds", F.lit(2), F.size("kinds")), bad), lambda x: x))
    blocks = blocks.select("c", "block", "blank", "duplicate", "truncated", (F.col("again") + inside).alias("illegal"), F.get("kinds", 0).alias("first"), F.element_at("kinds", -1).alias("last"))
    seams = F.array_sort(F.collect_list(F.struct("block", "first", "last")))  # one for each 2^BLOCK_BITS rows
    whole = blocks.groupBy("c").agg(*[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated", "illegal")], seams.alias("seams"))
    between = F.size(F.filter(F.zip_with(F.slice("seams", F.lit(1), F.size("seams") - 1), F.slice("seams", F.lit(2), F.size("seams")), lambda a, b: bad(a["last"], b["first"])), lambda x: x))
    whole = whole.withColumn("illegal", F.col("illegal") + between).drop("seams")
    turns = cells.select("c", "t").distinct().groupBy("c").agg(F.coalesce(F.max("t") - F.min("t") + 1 - F.count("t"), F.lit(0)).cast("long").alias("gaps"))
    same = F.col("w.c").eqNullSafe(F.col("g.c"))
    return whole.alias("w").join(turns.alias("g"), same).select("w.*", "gaps")


def _ends(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For each block of a conversation the distances that its exits have still to go."""
    rows = rows.sort_values("block", ascending=False)
    out, end = [], list(END)
    for crossing in rows["crossing"]:
        out.append(list(end))
        end = [min(crossing[4 * q + e] + end[e] for e in range(4)) for q in range(4)]
    return pd.DataFrame({"c": rows["c"], "block": rows["block"], "togo": out})


def _entries(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For each block of a conversation the state before it."""
    rows = rows.sort_values("block")
    out, state = [], START
    for exits in rows["exits"]:
        out.append(state)
        state = exits[state]
    return pd.DataFrame({"c": rows["c"], "block": rows["block"], "entry": out})


def _edits(cells: DataFrame, scratch: Scratch) -> DataFrame:
    """c, t, role, h, copies, cut, edit: the edit of each cell's first copy; all others are deleted."""
    cell = F.struct("seq", "t", "role", "h", "copies", "kind", "fault")
    blocks = cells.groupBy("c", "block").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    gone, cut = (lambda x: x["fault"].isin("blank", "duplicate")), (lambda x: x["fault"] == "truncated")
    symbol = lambda x: F.when(gone(x), "x").when(cut(x), F.upper(x["kind"])).otherwise(x["kind"])
    blocks = blocks.withColumn("pattern", F.array_join(F.transform("cells", symbol), ""))
    blocks = scratch.written(blocks, "blocks")

    many = blocks.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c")
    parts = blocks.select("c", "block", "pattern").alias("b").join(many.alias("m"), F.col("b.c").eqNullSafe(F.col("m.c")), "left_semi")
    crossing = F.pandas_udf(lambda p: p.map(crossings), "array<long>")
    kind = cells.schema["c"].dataType.simpleString()
    togo = parts.withColumn("crossing", crossing("pattern")).drop("pattern").groupBy("c").applyInPandas(_ends, f"c {kind}, block long, togo array<long>")
    togo = scratch.written(togo, "togo")

    @F.pandas_udf("struct<edits:array<array<string>>,exits:array<int>>")
    def ways(pattern: pd.Series, togo: pd.Series) -> pd.DataFrame:
        made = [solved(p, END, (START,)) if g is None else solved(p, tuple(g), (START, S, U, A)) for p, g in zip(pattern, togo, strict=True)]
        return pd.DataFrame({"edits": [m[0] for m in made], "exits": [m[1] for m in made]})

    same = F.col("b.c").eqNullSafe(F.col("g.c")) & (F.col("b.block") == F.col("g.block"))
    made = blocks.alias("b").join(togo.alias("g"), same, "left").select("b.c", "b.block", "cells", ways("pattern", "togo").alias("ways"), F.col("togo").isNotNull().alias("part"))
    made = scratch.written(made, "ways")
    entry = made.where("part").select("c", "block", F.col("ways.exits").alias("exits")).groupBy("c").applyInPandas(_entries, f"c {kind}, block long, entry int")
    made = made.alias("b").join(scratch.written(entry, "entries").alias("g"), same, "left")
    own = F.get("ways.edits", F.coalesce("entry", F.lit(START)))
    rows = made.select("b.c", own.alias("edits"), F.posexplode("cells").alias("i", "x"))
    return rows.select("c", "x.t", "x.role", "x.h", "x.copies", F.coalesce(cut(F.col("x")), F.lit(False)).alias("cut"), F.get("edits", F.col("i")).alias("edit"))


def _in_order(rows: DataFrame, scratch: Scratch, cells: DataFrame) -> DataFrame:
    """The edit of each cell and behind it the texts that it stands for, a conversation's in order in one task.

    Only texts and edits pass through such a task, one after another, and none is kept.
    """
    first = _edits(cells, scratch).select("c", "t", "role", "h", F.lit(0).alias("part"), "copies", "cut", "edit", F.lit(None).cast("string").alias("text"))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    texts = rows.select(
        F.col("conv_id").alias("c"), F.col("turn").alias("t"), role.alias("role"), _hash(text).alias("h"), F.lit(1).alias("part"),
        F.lit(None).cast("long").alias("copies"), F.lit(None).cast("boolean").alias("cut"), F.lit(None).cast("string").alias("edit"), text.alias("text"),
    )
    return first.unionByName(texts).repartition("c").sortWithinPartitions("c", "t", "role", "h", "part").select("c", "role", "copies", "cut", "edit", "text")


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, letter, times, role, text, cost) in order, and letter None at each conversation's end."""
    now, last, pending = None, None, None
    for batch in batches:
        for c, role, copies, cut, edit, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if now is None or now[0] != c:
                if now is not None:
                    yield from _finish(now[0], last)
                now, last = (c,), ""
            if edit is not None:
                pending = edit, copies, cut
                continue
            if pending is None:
                continue  # a copy of a text that was seen
            edit, copies, cut = pending
            pending = None
            for letter in edit:
                due = "assistant" if last == "u" else "user"
                if letter == "I":
                    yield c, "I", 1, due, "", INSERT
                    last = due[0]
                elif letter == "D":
                    yield c, "D", 1, role, text, DELETE
                else:
                    stays = role if letter == "K" else due
                    yield c, letter, 1, stays, text, (REROLE if letter == "R" else 0) + (TRUNCATED if cut else 0)
                    last = stays[:1]
            if copies > 1:
                yield c, "D", copies - 1, role, text, DELETE * (copies - 1)
    if now is not None:
        yield from _finish(now[0], last)


def _finish(c: object, last: str) -> Iterator[tuple]:
    for due in {"s": ("user", "assistant"), "u": ("assistant",)}.get(last, ()):
        yield c, "I", 1, due, "", INSERT
    yield c, None, 0, None, None, 0


def _batched(rows: Iterator[tuple], schema: pa.Schema, most_rows: int = 2000, most_bytes: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most_rows or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit, times, role, text: the edited messages of each conversation in order.

    ``rows`` has conv_id, turn, role, text; other columns are ignored, null roles and texts
    count as one space.  Rows of one turn go by role and SHA-256 of the text, null turns
    first; a null conv_id is a conversation like others.  A role's initial is its first
    character, an empty role has none and can't be kept.  Deleted rows have edit D and
    their own role and text, ``times`` for equal ones of a turn.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbered() -> Iterator[tuple]:
            place = 0
            for c, letter, times, role, text, _ in _messages(batches):
                if letter is None:
                    place = 0
                else:
                    yield c, place, letter, times, role, text
                    place += 1

        return _batched(numbered(), out)

    kind = rows.schema["conv_id"].dataType
    fields = f"conv_id {kind.simpleString()}, place long, edit string, times long, role string, text string"
    out = to_arrow_schema(StructType.fromDDL(fields))
    with Scratch(rows.sparkSession, "repair") as scratch:
        return written(_in_order(rows, scratch, _cells(rows, scratch)).mapInArrow(told, fields), "repaired")


def report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation of ``rows``.

    Takes what ``repair`` takes.  The digest of a conversation is that of one string, so its
    texts pass through one task, in order; nothing else of a conversation does.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            audit, cost, sha, between = [], 0, hashlib.sha256(), ""
            for c, letter, times, role, text, paid in _messages(batches):
                if letter is None:
                    yield c, cost, "".join(audit), sha.hexdigest()
                    audit, cost, sha, between = [], 0, hashlib.sha256(), ""
                    continue
                audit.append(letter * times)
                cost += paid
                if letter != "D":
                    sha.update(f"{between}{role}:{text}".encode())
                    between = "\n"

        return _batched(each(), out)

    kind = rows.schema["conv_id"].dataType
    fields = f"c {kind.simpleString()}, cost long, audit string, repaired_sha256 string"
    out = to_arrow_schema(StructType.fromDDL(fields))
    with Scratch(rows.sparkSession, "repair") as scratch:
        cells = _cells(rows, scratch)
        made = _in_order(rows, scratch, cells).mapInArrow(digests, fields)
        both = made.alias("m").join(_figures(cells).alias("f"), F.col("m.c").eqNullSafe(F.col("f.c")))
        names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        return written(both.select(F.col("m.c").alias("conv_id"), *names), "report")


def report_damaged(conversations: DataFrame) -> DataFrame:
    """``report`` of the damaged rows, for every conv_id: zeros and empty strings where no row is left."""
    found = report(damaged(conversations)).alias("r")
    every = conversations.select("conv_id").distinct().alias("e")
    zero, empty = F.lit(0).cast("long"), F.sha2(F.lit("").cast("binary"), 256)
    default = {"audit": F.lit(""), "repaired_sha256": empty}
    out = every.join(found, F.col("e.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
    return out.select("e.conv_id", *[F.coalesce(f"r.{n}", default.get(n, zero)).alias(n) for n in found.columns if n != "conv_id"])
