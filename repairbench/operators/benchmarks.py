"""Price benchmarks of groups, and rolling P90 exceptions against earlier invoices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from repairbench.functions.exact import div, half_even, half_up, money, pence, pounds
from repairbench.operators.carried import hot_keys
from repairbench.sources.shared import written

#: Rows of one key that one task judges; a larger key is cut into periods, each with the counts of all before.
BLOCK_ROWS = 50_000

#: Bits of a price (in pence) below its leading digits.
LEAD_BITS = 10


def observed_cost(total: Column, unit: Column) -> Column:
    """Line total, or the unit price when the total is null or zero."""
    return F.coalesce(F.nullif(total, F.lit(0)), F.nullif(unit, F.lit(0)))


def benchmark_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact statistics of positive costs (decimal pounds) per group; money as double of two digits.

    Percentiles interpolate between ranks. Ranks are found by the digits of a price: rows are summed by group and
    price before they shuffle, then by the price's leading digits; only the prices under the digits that hold a wanted
    rank are put in order. A window sees the leading digits of a group or the prices under one of them, never a group's
    rows. Null keys are a group.
    """
    rows = df.where(F.col(value) > 0).select(*keys, pence(F.col(value)).alias("v"))
    counts = rows.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    same = lambda a, b, more=(): [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in (*keys, *more)]
    fractions = {"p25": (1, 4), "p50": (1, 2), "p75": (3, 4), "p90": (9, 10)}

    def rank(num: int, den: int) -> tuple[Column, Column]:
        """The rank below the percentile, and how far (of den) it lies towards the next one."""
        pos = (F.col("n") - 1) * num
        return div(pos, F.lit(den)), pos % den

    def holds(k: Column) -> Column:
        return (F.col("before") <= k) & (k < F.col("before") + F.col("c"))

    def pick(num: int, den: int) -> Column:
        """The percentile times den: both neighbours, weighted by the whole parts of the rank."""
        low, part = rank(num, den)
        return F.sum(F.col("v") * (F.when(holds(low), den - part).otherwise(0) + F.when(holds(low + 1), part).otherwise(0)))

    group, lead = Window.partitionBy(*keys), F.shiftright("v", LEAD_BITS)
    leads = counts.groupBy(*keys, lead.alias("lead")).agg(F.sum("c").alias("c"))
    leads = leads.withColumn("before", F.sum("c").over(group.orderBy("lead")) - F.col("c")).withColumn("n", F.sum("c").over(group))
    wanted = F.lit(False)
    for f in fractions.values():
        low, part = rank(*f)
        wanted = wanted | holds(low) | (part > 0) & holds(low + 1)
    held = leads.where(wanted).select(*keys, "lead", F.col("before").alias("start"), "n")
    fine = counts.withColumn("lead", lead).alias("a").join(held.alias("b"), same("a", "b", ["lead"])).select("a.*", "b.start", "b.n")
    fine = fine.withColumn("before", F.col("start") + F.sum("c").over(Window.partitionBy(*keys, "lead").orderBy("v")) - F.col("c"))
    stats = fine.groupBy(*keys).agg(*[pick(*f).alias(name) for name, f in fractions.items()])
    # The most frequent price is unique if the largest and the smallest of that frequency are the same.
    whole = counts.groupBy(*keys).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum(F.col("v") * F.col("c")).alias("total"), F.sum("c").alias("n"),
        F.max(F.struct("c", "v")).alias("m"), F.max(F.struct("c", (-F.col("v")).alias("v"))).alias("m2"),
    )
    fenced = counts.alias("c").join(stats.alias("s"), same("c", "s"))
    # Fences are 2.5 p25 - 1.5 p75 and 2.5 p75 - 1.5 p25, here times 8.
    out_of = (8 * F.col("c.v") < 5 * F.col("s.p25") - 3 * F.col("s.p75")) | (8 * F.col("c.v") > 5 * F.col("s.p75") - 3 * F.col("s.p25"))
    outliers = fenced.groupBy(*[F.col(f"c.{k}").alias(k) for k in keys]).agg(F.sum(F.when(out_of, F.col("c.c")).otherwise(0)).alias("outlier_count"))
    joined = stats.alias("s").join(whole.alias("w"), same("s", "w")).join(outliers.alias("o"), same("s", "o"))
    unique = (F.col("w.m.c") > 1) & (F.col("w.m.v") == -F.col("w.m2.v"))
    return joined.select(
        *[F.col(f"s.{k}").alias(k) for k in keys],
        pounds(F.col("w.lo")).alias("minimum"), pounds(F.col("w.hi")).alias("maximum"),
        pounds(half_up(F.col("w.total"), F.col("w.n"))).alias("mean"), pounds(half_up(F.col("s.p50"), F.lit(2))).alias("median"),
        F.when(unique, pounds(F.col("w.m.v"))).alias("mode"),
        pounds(half_up(F.col("s.p25"), F.lit(4))).alias("percentile_25"), pounds(half_up(F.col("s.p75"), F.lit(4))).alias("percentile_75"),
        pounds(half_up(F.col("s.p90"), F.lit(10))).alias("percentile_90"), F.col("o.outlier_count").cast("long").alias("outlier_count"), F.col("w.n").alias("count"),
    )


class Ranks:
    """Counts of whole numbers from a fixed set, with the k-th smallest in log time (a Fenwick tree)."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.size = len(self.values)
        self.tree = [0] * (self.size + 1)
        self.top = 1 << max(0, self.size.bit_length() - 1)
        self.total = 0

    @classmethod
    def counted(cls, prices: list[int], times: list[int], more: list[int]) -> Ranks:
        """With the counts of prices, and room for more values; in one pass over the values."""
        out = cls(np.array([*prices, *more], np.int64))
        held = np.zeros(out.size + 1, np.int64)
        np.add.at(held, np.searchsorted(out.values, np.array(prices, np.int64)) + 1, np.array(times, np.int64))
        upto, i = np.cumsum(held), np.arange(out.size + 1)
        out.tree, out.total = (upto - upto[i & (i - 1)]).tolist(), int(upto[-1])
        out.tree[0] = 0
        return out

    def add(self, value: int, times: int = 1) -> None:
        i = int(np.searchsorted(self.values, value)) + 1
        self.total += times
        while i <= self.size:
            self.tree[i] += times
            i += i & -i

    def kth(self, k: int) -> int:
        at, step = 0, self.top
        while step:
            nxt = at + step
            if nxt <= self.size and self.tree[nxt] <= k:
                at, k = nxt, k - self.tree[nxt]
            step >>= 1
        return int(self.values[at])

    def p90(self) -> int:
        """Interpolated 90th percentile, half up to a whole number."""
        low, part = divmod((self.total - 1) * 9, 10)
        a = self.kth(low)
        b = self.kth(min(low + 1, self.total - 1)) if part else a
        return (2 * (a * 10 + (b - a) * part) + 10) // 20


def _judge(table: pa.Table, told: dict[str, str]) -> pa.Table:
    """Judges the rows of one key and period; rows with times are prices of earlier periods and how often they were."""
    past, own = table.filter(pc.is_valid(table["times"])), table.filter(pc.is_null(table["times"]))
    own = own.take(pc.sort_indices(own, sort_keys=[("invoice_date", "ascending"), ("invoice_ref", "ascending")], null_placement="at_start"))
    cost, days, refs = (own[c].to_pylist() for c in ("cost", "invoice_date", "invoice_ref"))
    ranks = Ranks.counted(past["cost"].to_pylist(), past["times"].to_pylist(), [c for c in cost if c is not None and c > 0])
    history: list[int] = []
    p90s: list[int | None] = []
    start = 0
    while start < len(cost):
        end = start
        while end < len(cost) and (days[end], refs[end]) == (days[start], refs[start]):
            end += 1
        n = ranks.total
        history += [n] * (end - start)
        p90s += [ranks.p90() if n else None] * (end - start)
        for c in cost[start:end]:
            if c is not None and c > 0:
                ranks.add(c)
        start = end
    found = {name: own[c] for name, c in told.items()}
    return pa.table(found | {"judged": own["cost"], "history": pa.array(history, pa.int64()), "p90": pa.array(p90s, pa.int64())})


def rolling_p90(obs: DataFrame, keys: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """line_id, history, p90 (pence): for each line the P90 of its key's earlier invoices' positive costs.

    obs(line_id, keys, invoice_date, invoice_ref, cost). Earlier means by (date, nulls first; invoice ref); lines of
    one invoice are judged together. cost is in pence and may be null. A key of more than `block_rows` lines (or prices, if
    it has more of these) is cut by date: each period is a group of its own and gets the counts of all earlier prices, not
    the rows, so that all periods together get no more rows than the key has.
    """
    return _rolled(obs, keys, block_rows, ["line_id"]).drop("judged")


def _rolled(obs: DataFrame, keys: list[str], block_rows: int, keep: list[str]) -> DataFrame:
    """Columns to keep, judged (the cost), history and p90 of each line; a line shuffles once."""
    used = [*keys, "invoice_date", "invoice_ref", "cost"]
    told = {c: c if c in used else f"kept_{c}" for c in keep}
    rows = obs.select(*keys, "invoice_date", "invoice_ref", F.col("cost").cast("long").alias("cost"), *[F.col(c).alias(k) for c, k in told.items() if c != k])
    kinds = StructType([StructField(c, rows.schema[k].dataType) for c, k in told.items()] + [StructField(c, LongType()) for c in ("judged", "history", "p90")])
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    hot = hot_keys(rows, keys, block_rows)
    if hot is None:
        own = rows.select("*", F.lit(0).alias("period"), none("times", "long"))
    else:
        # The keys that are cut are few, as each has many lines: they are broadcast, and lines don't shuffle to meet them.
        large = rows.alias("r").join(F.broadcast(hot.alias("s")), same("r", "s"), "left_semi")
        sizes = large.groupBy(*keys).agg(F.ceil(F.count("*") / F.greatest(F.lit(block_rows), F.approx_count_distinct("cost"))).cast("int").alias("parts"), F.min("invoice_date").alias("first"), F.datediff(F.max("invoice_date"), F.min("invoice_date")).alias("days"))
        sizes = written(sizes.where("parts > 1"), "sizes")
        age = F.datediff("r.invoice_date", F.col("s.first"))
        period = F.least(F.floor(age * F.col("s.parts") / (F.col("s.days") + 1)), F.col("s.parts") - 1).cast("int")
        period = F.coalesce(F.when(age.isNotNull(), period), F.lit(0))  # least() skips nulls, but lines without a date come first
        placed = rows.alias("r").join(F.broadcast(sizes.alias("s")), same("r", "s"), "left").select("r.*", period.alias("period"), F.coalesce("s.parts", F.lit(1)).alias("parts"))
        # What a price counts at the end of a period it brings to all periods up to the next that has it.
        counts = placed.where("parts > 1 AND cost > 0").groupBy(*keys, "period", "parts", "cost").agg(F.count("*").alias("n"))
        along = Window.partitionBy(*keys, "cost").orderBy("period")
        ends = counts.select(*keys, "cost", F.sum("n").over(along).alias("times"), F.col("period").alias("at"), F.coalesce(F.lead("period").over(along), F.col("parts") - 1).alias("until")).where("at < until")
        past = ends.select(*keys, F.explode(F.sequence(F.col("at") + 1, F.col("until"))).alias("period"), "cost", "times")
        own = placed.drop("parts").withColumn("times", F.lit(None).cast("long")).unionByName(past, allowMissingColumns=True)

    def judge(t: pa.Table) -> pa.Table:
        return _judge(t, told)

    return own.groupBy(*keys, "period").applyInArrow(judge, kinds)


def p90_exceptions(obs: DataFrame, keys: list[str], threshold: int = 10, least: int = 3, least_pence: int = 500, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """obs with history, p90, difference (pence) and percent_above (one digit, half even) of lines above both gates.

    The percent gate is strict and takes the unrounded percentage of the P90. Lines are judged with all their columns, so that
    exceptions needn't meet obs again; obs is read several times, so a table of few columns serves better than a plan of joins.
    """
    judged = _rolled(obs, keys, block_rows, obs.columns).withColumn("difference", F.col("judged") - F.col("p90")).drop("judged")
    over = (F.col("history") >= least) & (F.col("p90") > 0) & (F.col("difference") >= least_pence) & (F.col("difference") * 100 > F.col("p90") * threshold)
    return judged.where(over).withColumn("percent_above", half_even(F.col("difference") * 1000, F.col("p90")) / F.lit(10.0))


def labour_rate(explicit: Column, unit_price: Column, item_type: Column, unit: Column) -> Column:
    """The rate that was told, else the unit price of labour by the hour."""
    hourly = (item_type == "labour") & unit.isin("hour", "hours", "hr", "hrs")
    return F.coalesce(explicit, F.when(hourly, unit_price))


def benchmark_table(obs: DataFrame, keys: list[str], threshold: int = 10, min_count: int = 1) -> DataFrame:
    """Statistics of each group with its source rows, distinct invoices, exceptions, sample strength and latest date."""
    stats = benchmark_statistics(obs, keys, "price")
    extra = obs.groupBy(*keys).agg(F.count("*").alias("source_rows"), F.countDistinct("invoice_ref").alias("invoice_count"), F.max("invoice_date").alias("latest_date"))
    found = p90_exceptions(obs.select(*keys, "invoice_date", "invoice_ref", "cost"), keys, threshold).groupBy(*keys).agg(F.count("*").alias("exception_count"))
    strength = F.when(F.col("count") >= 10, "strong").when(F.col("count") >= 3, "usable").otherwise("weak")
    joined = stats.where(F.col("count") >= min_count).join(extra, keys).join(found, keys, "left")
    return joined.withColumn("exception_count", F.coalesce("exception_count", F.lit(0))).withColumn("sample_strength", strength)


def benchmark_sources(obs: DataFrame, key: str, limit: int) -> DataFrame:
    """The newest rows behind each benchmark, `limit` (1 to 250) of each item."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last("invoice_date"), F.desc("invoice_ref"), F.desc("line_id"))
    return obs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= min(250, max(1, limit)))


def category_averages(obs: DataFrame, key: str) -> DataFrame:
    """Mean cost and count of positive costs of each category."""
    rows = obs.where(F.col("cost") > 0).groupBy(key).agg(F.sum("cost").alias("s"), F.count("*").alias("observation_count"))
    return rows.select(key, pounds(half_up(F.col("s"), F.col("observation_count"))).alias("average_cost"), "observation_count")


def data_quality(obs: DataFrame) -> DataFrame:
    """Row, cost and class counts, coverage in percent (one digit) and the latest date."""
    told = obs.agg(
        F.count("*").alias("invoice_rows"), F.sum(F.when(F.col("cost") > 0, 1).otherwise(0)).alias("valid_costs"),
        F.sum(F.when(F.col("vehicle_label") == "Unclassified", 0).otherwise(1)).alias("classified"), F.max("invoice_date").alias("latest_date"),
    )
    coverage = half_up(1000 * F.col("classified"), F.greatest("invoice_rows", F.lit(1))) / F.lit(10.0)
    return told.select("invoice_rows", "valid_costs", (F.col("invoice_rows") - F.col("valid_costs")).alias("invalid_costs"), "classified", (F.col("invoice_rows") - F.col("classified")).alias("unclassified"), coverage.alias("coverage_percent"), "latest_date")


__all__ = ["money", "observed_cost", "benchmark_statistics", "rolling_p90", "p90_exceptions", "benchmark_table", "benchmark_sources", "category_averages", "data_quality"]
