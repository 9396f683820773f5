"""Structured Streaming jobs: append finalised lines once, and rolling P90 alerts by arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from repairbench.operators.benchmarks import Ranks


def append_new(batch: DataFrame, known: DataFrame | None, key: str, order: str) -> DataFrame:
    """Rows of the batch whose key isn't known yet, the first of each key by `order`; null keys are left out."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    rows = batch.where(F.col(key).isNotNull()).withColumn("_first", first).where("_first = 1").drop("_first")
    return rows if known is None else rows.join(known.select(key), key, "left_anti")


def append_finalised(stream: DataFrame, history: str, checkpoint: str, key: str = "source_line_id", order: str = "ts") -> StreamingQuery:
    """Appends finalised lines to the Parquet table `history`, once for each source line.

    A replayed batch adds nothing: its lines are found in the table by the anti-join.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, _: int) -> None:
        append_new(batch, read_or_none(spark, history), key, order).write.mode("append").parquet(history)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.parquet(path) if there else None


ALERT = "item_id long, line_id long, cost long, history long, p90 long, late boolean"


def p90_alerts(stream: DataFrame, threshold: int = 10, least: int = 3, least_pence: int = 500) -> DataFrame:
    """stream(item_id, line_id, day date, cost pence) -> a row for each line judged above its item's P90.

    State of an item: its earlier prices with their counts, and the latest day. A line is judged by what arrived
    before it, then added; later arrivals never change a decision, and a line older than the latest day is `late`.
    The state is read once a batch into a tree of counts; each line then costs the logarithm of the item's prices. Lines
    without a price are judged by nothing and add nothing.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        prices, counts, latest = state.get if state.exists else ([], [], -(1 << 30))
        held = dict(zip(prices, counts, strict=True))
        for pdf in batches:
            out, costs = [], pdf["cost"].dropna().astype("int64")
            ranks = Ranks.counted(list(held), list(held.values()), costs[costs > 0].tolist())
            for line, day, cost in sorted(zip(pdf["line_id"], pd.to_datetime(pdf["day"]).to_numpy().astype("datetime64[D]").astype(int), pdf["cost"], strict=True), key=lambda r: (r[1], r[0])):
                if pd.isna(cost):
                    continue
                total = ranks.total
                if total >= max(1, least):
                    p90 = ranks.p90()
                    if cost - p90 >= least_pence and (cost - p90) * 100 > p90 * threshold:
                        out.append((key[0], line, int(cost), total, p90, bool(day < latest)))
                if cost > 0:
                    held[int(cost)] = held.get(int(cost), 0) + 1
                    ranks.add(int(cost))
                latest = max(latest, int(day))
            yield pd.DataFrame(out, columns=["item_id", "line_id", "cost", "history", "p90", "late"])
        state.update((list(held), list(held.values()), latest))

    return stream.groupBy("item_id").applyInPandasWithState(judge, ALERT, "prices array<long>, counts array<long>, latest long", "append", "NoTimeout")
