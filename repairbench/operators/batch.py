"""Uploaded batches of one claim: P90 of earlier invoices by item or category, its dashboard; reviewed and changed summaries."""

from __future__ import annotations

from array import array
from bisect import bisect_right, insort
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repairbench.functions.exact import half_even, half_up
from repairbench.functions.text import repairer_key
from repairbench.operators.benchmarks import benchmark_statistics
from repairbench.operators.carried import State, carried
from repairbench.sources.shared import small, written


class _Batch(State):
    """The prices of a place (claim, shared, category) so far, in order.

    A place that isn't shared is one category with all lines of its items, or one item without a category: one set. The
    shared place of a claim keeps a set of each item, of each category and of each pair of both."""

    def __init__(self, key: tuple):
        super().__init__(key)
        self.prices: dict[tuple, array] = {}
        self.rank, self.waiting = None, []

    def _places(self, item, category) -> list[tuple[int, tuple]]:
        """Signed sets that hold each earlier line once: the item's and the category's, less those of both."""
        if not self.key[1]:
            return [(1, ())] if item is not None or category is not None else []
        places = [(1, ("item", item))] if item is not None else []
        places += [(1, ("category", category))] if category is not None else []
        return places + ([(-1, ("both", item, category))] if len(places) == 2 else [])

    @staticmethod
    def _kth(sets: list[tuple[int, array]], k: int) -> int:
        """The k-th smallest (from 0) of a signed union: the least price that more than k of it don't exceed."""
        if len(sets) == 1:
            return sets[0][1][k]
        low, high = min(p[0] for _, p in sets), max(p[-1] for _, p in sets)
        while low < high:
            middle = (low + high) // 2
            if sum(sign * bisect_right(p, middle) for sign, p in sets) > k:
                high = middle
            else:
                low = middle + 1
        return low

    def _enter(self) -> None:
        for item, category, cost in self.waiting:
            for _, place in self._places(item, category):
                insort(self.prices.setdefault(place, array("q")), cost)
        self.waiting = []

    def step(self, row: tuple):
        rank, item, category, cost = row
        if rank != self.rank:
            self._enter()
            self.rank = rank
        sets = [(sign, self.prices[p]) for sign, p in self._places(item, category) if p in self.prices]
        n, p90 = sum(sign * len(p) for sign, p in sets), None
        if n:
            at, part = divmod((n - 1) * 9, 10)
            low = self._kth(sets, at)
            high = self._kth(sets, min(at + 1, n - 1)) if part else low
            p90 = (2 * (low * 10 + (high - low) * part) + 10) // 20
        if cost is not None and cost > 0:
            self.waiting.append((item, category, cost))
        return [(cost, n, p90)]


def batch_p90(lines: DataFrame, threshold: int = 10, least: int = 3, least_pence: int = 500, keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """line_id, history, p90, difference, percent (tenths of a percent, half even), above_p90, challenged.

    lines(line_id, case_id, rank, item_key, category, cost): earlier invoices of the claim have a smaller rank. A prior line
    counts once if its item key or its category is the same. Rejected lines are left out before. Ordered passes, no pairs of
    lines, no list of a line's earlier prices: a category whose items have no lines outside it is a place of its own, and
    a task holds its prices, eight bytes each. Only the categories of a claim that share items go through one task together.
    Columns to `keep` go along, so that what is found needn't meet its lines again.
    """
    kept = {f"kept_{c}": c for c in keep}
    rows = lines.select("case_id", "rank", "item_key", "category", "cost", *[F.col(c).alias(k) for k, c in kept.items()])
    same = lambda keys: [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    spread = rows.where("item_key IS NOT NULL").groupBy("case_id", "item_key").agg(F.min("category").alias("low"), F.max("category").alias("high"), F.count("category").alias("named"), F.count("*").alias("n"))
    spread = written(spread.where("low <> high OR (named > 0 AND named < n)").select("case_id", "item_key"), "spread")
    if spread.isEmpty():
        rows = rows.withColumn("shared", F.lit(False))
    else:
        shared = rows.where("category IS NOT NULL").alias("r").join(spread.alias("s"), same(["case_id", "item_key"]), "left_semi").select("case_id", "category").distinct()
        named = rows.where("category IS NOT NULL").alias("r").join(shared.alias("s"), same(["case_id", "category"]), "left").select("r.*", F.col("s.category").isNotNull().alias("shared"))
        bare = rows.where("category IS NULL").alias("r").join(spread.alias("s"), same(["case_id", "item_key"]), "left").select("r.*", F.col("s.item_key").isNotNull().alias("shared"))
        rows = named.unionByName(bare)
    name = F.when(F.col("shared"), None).otherwise(F.coalesce(F.concat(F.lit("c"), F.col("category").cast("string")), F.concat(F.lit("i"), F.col("item_key").cast("string"))))
    rows = rows.select("case_id", "shared", name.alias("place"), "rank", "item_key", "category", F.col("cost").cast("long").alias("cost"), *kept)
    rows = carried(rows, ["case_id", "shared", "place"], ["rank"], "cost long, history long, p90 long", _Batch, tuple(kept))
    rows = rows.withColumn("p90", F.when((F.col("history") >= least) & (F.col("p90") > 0), F.col("p90")))
    rows = rows.withColumn("difference", F.greatest(F.col("cost") - F.col("p90"), F.lit(0))).withColumn("percent", half_even(F.col("difference") * 1000, F.col("p90")))
    known = F.col("p90").isNotNull()
    over = (F.col("difference") >= least_pence) & (F.col("percent") > 10 * threshold)
    return rows.select(*[F.col(k).alias(c) for k, c in kept.items()], "history", "p90", F.when(known, F.col("difference")).alias("difference"), F.when(known, F.col("percent")).alias("percent"), F.coalesce((F.col("difference") > 0) & known, F.lit(False)).alias("above_p90"), F.coalesce(over & known, F.lit(False)).alias("challenged"))


def _mean(total: Column, count: Column) -> Column:
    return F.when(count > 0, half_up(total, count))


def batch_dashboard(lines: DataFrame, judged: DataFrame, min_count: int = 1, vehicle_label: str | None = None, identity: str | None = None, date_from: date | None = None, date_to: date | None = None, only: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The dashboard of each claim's batch, all claims at once: benchmarks, sources, summary, categories, quality, repairers, repairer_items.

    lines(line_id, case_id, invoice_ref, invoice_date, sequence, identity, item, vehicle_label, repairer, kind, unit_cost, cost): what
    was not rejected, money in pence; identity is the item, or the category of a line without one. judged is `batch_p90` of
    the same lines; if it keeps what is told of exceptions, these don't meet their lines again. Filters hide lines and exceptions
    but change no P90. Groups of fewer than `min_count` lines go, with their exceptions, before anything is counted in them;
    quality and the P90s look at all lines. `only` names the tables that are wanted, if not all are; lines are judged once, and not
    at all if no wanted table tells of exceptions. Without sequence there are no sources, without repairer no repairers.
    """
    def told(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What is recorded, and what of it is shown."""
        records = rows.where("cost > 0").withColumn("vehicle_label", F.coalesce("vehicle_label", F.lit("Unclassified")))
        if "repairer" in rows.columns:
            records = records.withColumn("repairer", F.coalesce(F.nullif(F.trim("repairer"), F.lit("")), F.lit("Unknown repairer")))
        shown = records
        for column, value in (("vehicle_label", vehicle_label), ("identity", identity)):
            shown = shown if value is None else shown.where(F.col(column) == value)
        shown = shown if date_from is None else shown.where(F.col("invoice_date") >= F.lit(date_from))
        return records, shown if date_to is None else shown.where(F.col("invoice_date") <= F.lit(date_to))

    wants = lambda *names: only is None or bool(set(names) & set(only))
    records, shown = told(lines)
    keys = ["case_id", "identity", "item", "vehicle_label"]
    groups = shown.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("count"), F.sum("cost").alias("total")).where(F.col("count") >= max(1, min_count))
    if min_count > 1 and wants("benchmarks", "sources", "repairers", "repairer_items"):
        stays = small(written(groups.select(*keys), "groups"))
        held = lambda rows: rows.join(stays, keys, "left_semi")
    else:
        held = lambda rows: rows.dropna(subset=keys)
    pounds = lambda c: (F.col(c).cast("decimal(20,0)") / 100).cast("decimal(20,2)")
    hourly = (F.col("kind") == "labour") & (F.col("unit_cost") > 0)
    lasting = held(shown)
    priced = lasting.withColumn("price", pounds("cost")).withColumn("rate", F.when(hourly, pounds("unit_cost")))
    stats, labour = benchmark_statistics(priced, keys, "price"), benchmark_statistics(priced, keys, "rate")
    labour = labour.select(*keys, *[F.col(c).alias(f"labour_{c}") for c in labour.columns if c not in keys])
    whole = lasting.groupBy(*keys).agg(F.count("*").alias("source_count"), F.countDistinct("invoice_ref").alias("invoice_count"), F.max("invoice_date").alias("latest_date"), F.sum("cost").alias("total"))
    challenged = judged.where("challenged")
    if {*keys, "invoice_ref", "invoice_date", "cost", *({"repairer", "line_id"} & set(lines.columns))} <= set(judged.columns):
        found = told(challenged)[1]
    else:
        found = shown.join(challenged.select("line_id", "p90", "difference", "percent", "history"), "line_id")
    if wants("benchmarks", "repairers", "repairer_items"):
        found = written(held(found), "exceptions")
    over = found.groupBy(*keys).agg(F.count("*").alias("exception_count"), F.countDistinct("invoice_ref").alias("exception_invoice_count"))
    strength = F.when(F.col("count") >= 10, "strong").when(F.col("count") >= 3, "usable").otherwise("insufficient")
    rows = stats.join(whole, keys).join(labour, keys, "left").join(over, keys, "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("labour_count", "exception_count", "exception_invoice_count")}
    benchmarks = rows.withColumns(zero).withColumn("sample_strength", strength)
    order = Window.partitionBy(*keys).orderBy("invoice_date", "invoice_ref", "sequence")
    sources = lasting.withColumn("place", F.row_number().over(order)) if "sequence" in lines.columns else None
    totals = shown.groupBy("case_id").agg(F.sum("cost").alias("s"), F.count("*").alias("observation_count"), F.sum(F.when(hourly, F.col("unit_cost"))).alias("r"), F.sum(F.when(hourly, 1).otherwise(0)).alias("k"))
    ranked = groups.withColumn("m", _mean(F.col("total"), F.col("count")))
    tops = ranked.groupBy("case_id").agg(F.min_by("item", F.struct(-F.col("count"), "item")).alias("most_observed"), F.min_by("item", F.struct(-F.col("m"), -F.col("count"), "item")).alias("most_expensive"), F.max("m").alias("highest_mean"))
    summary = totals.join(tops, "case_id", "left").select("case_id", _mean(F.col("s"), F.col("observation_count")).alias("average_cost"), _mean(F.col("r"), F.col("k")).alias("average_labour_rate"), "most_observed", "observation_count", "most_expensive", "highest_mean")
    categories = shown.groupBy("case_id", "vehicle_label").agg(_mean(F.sum("cost"), F.count("*")).alias("average_cost"), F.count("*").alias("count"))
    named = F.sum(F.when(F.col("vehicle_label") != "Unclassified", 1).otherwise(0))
    quality = records.groupBy("case_id").agg(F.count("*").alias("line_count"), named.alias("classified"), F.max("invoice_date").alias("latest_date"))
    quality = quality.withColumn("coverage", half_even(F.col("classified") * 1000, F.col("line_count")))
    out = {"benchmarks": benchmarks.drop("total"), "sources": sources, "summary": summary, "categories": categories, "quality": quality}
    if "repairer" in lines.columns:
        kept = found.withColumn("repairer_key", repairer_key(F.col("repairer")))
        first = F.min_by("repairer", F.struct("invoice_ref", "line_id"))
        sums = [F.count("*").alias("challenge_count"), F.countDistinct("invoice_ref").alias("invoice_count"), F.sum("difference").alias("total_difference"), F.max("difference").alias("maximum_difference")]
        out["repairers"] = kept.groupBy("case_id", "repairer_key").agg(first.alias("repairer"), *sums, F.countDistinct("identity", "item").alias("item_count"))
        out["repairer_items"] = kept.groupBy("case_id", "repairer_key", "identity", "item").agg(*sums, F.max("percent").alias("maximum_percent"))
    return {name: table for name, table in out.items() if table is not None}


def reviewed_summary(challenges: DataFrame, key: str, final: bool) -> DataFrame:
    """Sums of what a review leaves: rejected challenges go; when final, only approved positive ones count.

    challenges(key, net, status, score). blocked: pending positive challenges, while final.
    """
    live = F.col("status") != "rejected"
    counted = live & (F.col("net") > 0) & ((F.col("status") == "approved") if final else F.lit(True))
    pending = (F.col("status") == "pending") & (F.col("net") > 0)
    return challenges.groupBy(key).agg(
        F.sum(F.when(counted, F.col("net")).otherwise(0)).alias("challenge_net"), F.sum(counted.cast("int")).alias("challenges"),
        half_up(F.sum(F.when(live, F.col("score"))), F.count(F.when(live, F.col("score")))).alias("mean_score"), (F.sum(pending.cast("int")) if final else F.sum(F.lit(0))).alias("blocked"),
    )


def summary_delta(before: DataFrame, after: DataFrame, key: str, values: list[str]) -> DataFrame:
    """key, measure, before, after, change of two runs; what a run lacks is null."""
    long = lambda df, name: df.select(key, F.expr(f"stack({len(values)}, {', '.join(f'{v!r}, CAST({v} AS BIGINT)' for v in values)}) AS (measure, {name})"))
    both = long(before, "before").join(long(after, "after"), [key, "measure"], "full_outer")
    return both.withColumn("change", F.col("after") - F.col("before"))
