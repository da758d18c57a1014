"""Progress of runs: counters of a batch job, and a table of what each micro-batch of a stream did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from stratalex.functions import text as T


def counted(rows: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """``rows``, and counters that are there once an action has read them: ``rows``, and how often each condition holds.

    They are summed up in the tasks of that action, so nothing is read twice.
    """
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counters.items()]), seen


class Progress(StreamingQueryListener):
    """Collects a row for each micro-batch: query, batch, rows in, rows so far, and counters that the stream observes."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, int, int, dict[str, int]]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        before = sum(r[2] for r in self.rows if r[0] == (p.name or str(p.id)))
        told = {f"{k}.{c}": int(v) for k, row in p.observedMetrics.items() for c, v in row.asDict().items() if isinstance(v, int)}
        self.rows.append((p.name or str(p.id), p.batchId, p.numInputRows, before + p.numInputRows, told))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession, total: int) -> DataFrame:
        """query, batch, rows, done, percent of ``total``, counters; one row for each micro-batch."""
        found = spark.createDataFrame(self.rows, "query string, batch long, rows long, done long, counters map<string,long>")
        return found.select("query", "batch", "rows", "done", F.least(T.progress(F.col("done"), F.lit(total)), F.lit(100)).alias("percent"), "counters")
