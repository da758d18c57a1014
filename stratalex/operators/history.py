"""Chat history: sessions, messages, titles, last messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST, TITLE = 19, 18


def title_of(text: Column) -> Column:
    return F.trim(F.replace(F.substring(text, 1, TITLE), F.lit("\n"), F.lit(" ")))


def sessions(messages: DataFrame) -> DataFrame:
    """conv_id, title, messages, updated: the title is the first user message's start."""
    user = F.col("role") == "user"
    found = messages.groupBy("conv_id").agg(F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("first"), F.count("*").alias("messages"), F.max("turn").alias("updated"))
    return found.select("conv_id", F.coalesce(title_of(F.col("first")), F.lit("新对话")).alias("title"), "messages", "updated")


def session_page(table: DataFrame, owner: str, page: int, size: int, order: list[Column]) -> DataFrame:
    """One page of the newest sessions, then those of the owner: pages can be short."""
    cut = table.where(~F.col("deleted")).orderBy(*order).offset(page * size).limit(size)
    return cut.where(F.col("owner_sid") == owner)


def messages_of(messages: DataFrame, owned: DataFrame) -> DataFrame:
    return messages.join(owned.select("conv_id"), "conv_id", "left_semi").orderBy("conv_id", "turn")


def last_messages(messages: DataFrame, n: int = LAST) -> DataFrame:
    """The last n messages of each session; blank ones are dropped after the cut."""
    recent = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("_r", recent).where(F.col("_r") <= n).drop("_r").where(F.trim("text") != "")


def soft_delete(table: DataFrame, session: int, owner: str) -> DataFrame:
    mine = (F.col("conv_id") == session) & (F.col("owner_sid") == owner)
    return table.withColumn("deleted", F.when(mine, True).otherwise(F.col("deleted")))


def rename(table: DataFrame, session: int, owner: str, title: str) -> DataFrame:
    mine = (F.col("conv_id") == session) & (F.col("owner_sid") == owner)
    return table.withColumn("title", F.when(mine, F.lit(title)).otherwise(F.col("title")))


def prompt_messages(messages: DataFrame, system: str) -> DataFrame:
    """conv_id and the message list of a request: system first, roles in lower case."""
    m = F.struct(F.lower("role").alias("role"), F.col("text").alias("content"))
    lists = last_messages(messages).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", m.alias("m")))).alias("l"))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return lists.select("conv_id", F.to_json(F.concat(first, F.transform("l", lambda x: x["m"]))).alias("messages"))


def running_text(rows: DataFrame, key: str, order: str, piece: str) -> DataFrame:
    """Adds the concatenation of the pieces so far."""
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("full_content", F.array_join(F.collect_list(piece).over(so_far), ""))


# -- writes: each gives the table that takes the place of the old one ------------------------------


def insert_session(table: DataFrame, owner: str, now: int, title: str | None = None, stage: str | None = None, model: str | None = None) -> DataFrame:
    """Adds a session with the next number; title, stage and model have defaults."""
    last = table.agg(F.coalesce(F.max("conv_id"), F.lit(0)).alias("last"))
    values = {
        "conv_id": F.col("last") + 1, "title": F.lit(title or "新对话"), "stage": F.lit(stage or "junior"), "model": F.lit(model or ""),
        "owner_sid": F.lit(owner), "deleted": F.lit(False), "created": F.lit(now), "updated": F.lit(now),
    }
    kinds = dict(table.dtypes)
    return table.unionByName(last.select(*[values[c].cast(kinds[c]).alias(c) for c in table.columns]))


def append_messages(table: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages after new messages (conv_id, turn, role, text) came in.

    Their sessions are touched, and a title that is the default or null becomes that of the
    first user message.
    """
    every = messages.unionByName(new.select(*messages.columns))
    said = sessions(every.join(new.select("conv_id").distinct(), "conv_id", "left_semi")).select("conv_id", F.col("title").alias("_title"), F.col("updated").alias("_updated"))
    both = table.join(said, "conv_id", "left")
    fresh = F.col("_title").isNotNull() & F.coalesce(F.col("title") == "新对话", F.lit(True))
    touched = both.withColumns({"title": F.when(fresh, F.col("_title")).otherwise(F.col("title")), "updated": F.greatest("updated", "_updated")})
    return touched.select(*table.columns), every


def update_meta(table: DataFrame, session: int, stage: str | None = None, model: str | None = None) -> DataFrame:
    """Sets what isn't null."""
    new = {c: F.when(F.col("conv_id") == session, F.lit(v)).otherwise(F.col(c)) for c, v in (("stage", stage), ("model", model)) if v is not None}
    return table.withColumns(new) if new else table


def hard_delete(messages: DataFrame, session: int) -> DataFrame:
    return messages.where(~F.col("conv_id").eqNullSafe(F.lit(session)))


def live_sessions(table: DataFrame) -> DataFrame:
    return table.agg(F.count_if(~F.col("deleted")).alias("live"))


def request_messages(messages: DataFrame, stages: DataFrame, base: str, directives: dict[str, str], n: int = LAST) -> DataFrame:
    """conv_id, temperature, messages: what a request of each session sends.

    ``stages``: conv_id, stage, temperature, context; a null stage is junior, a null
    temperature the stage's.  The system message is the base text, the stage's directive
    and the context, and comes first; every role but the user's is the assistant's.
    """
    from stratalex.sources.tables import STAGES

    of = F.coalesce("stage", F.lit("junior"))
    usual, directive = F.lit(None).cast("double"), F.lit("")
    for name, _, degree, _ in STAGES:
        usual, directive = F.when(of == name, degree).otherwise(usual), F.when(of == name, directives.get(name, "")).otherwise(directive)
    system = stages.select("conv_id", F.coalesce("temperature", usual).alias("temperature"), F.concat(F.lit(base + "\n"), directive, F.coalesce("context", F.lit(""))).alias("system"))
    said = F.struct(F.when(F.lower("role") == "user", "user").otherwise("assistant").alias("role"), F.col("text").alias("content"))
    lists = last_messages(messages, n).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("m")))).alias("l"))
    first = F.array(F.struct(F.lit("system").alias("role"), F.col("system").alias("content")))
    said_before = F.coalesce(F.transform("l", lambda x: x["m"]), F.array().cast("array<struct<role:string,content:string>>"))
    return system.join(lists, "conv_id", "left").select("conv_id", "temperature", F.to_json(F.concat(first, said_before)).alias("messages"))
