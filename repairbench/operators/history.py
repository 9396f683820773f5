"""Past evidence of lines: counts, dates, lineages and weighted medians of what an item has been billed before a day.

Nothing here pairs lines with observations (but `past_history`, for lists of comparables). What a line may look back
on depends on its item and its date alone. Lines and observations are dealt by item once and put in order of days; one pass
tells each line what came before its day. Of an item with very many rows, observations are summed by day and price before
they shuffle, states are made for the days that lines ask for, and lines look their day's state up. The weight of an
observation halves with each half-life of its age; lines of all later days see the same proportions, so a running median
needs no age.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from repairbench.functions.exact import half_up
from repairbench.functions.rules import Policy
from repairbench.operators.carried import State, carried, hot_keys, values
from repairbench.sources.shared import written

#: Rows of one key that a task holds; of a larger key, as many day and price sums, and what has more is cut into periods.
BLOCK_ROWS = 200_000
REASONS = ["not_eligible", "estimate_or_non_invoice", "unit_incompatible", "quantity_scope_not_equivalent", "zero_comparability", "missing_comparable_line_total"]
_ANY_DAY = REASONS[:2]  # told before the date is looked at


def past_history(lines: DataFrame, obs: DataFrame) -> DataFrame:
    """Each line with every observation of its item dated strictly before it: as many rows as there are comparables.

    lines(line_id, item_id, as_of), obs(item_id, obs_id, observed_at, ...). Skewed items are split by AQE.
    """
    return lines.alias("l").join(obs.alias("o"), (F.col("l.item_id") == F.col("o.item_id")) & (F.col("o.observed_at") < F.col("l.as_of"))).drop(F.col("o.item_id"))


def is_invoice(kind: Column) -> Column:
    name = F.regexp_replace(F.lower(F.trim(kind)), "[- ]", "_")
    return ~F.regexp_like(name, F.lit("estimate|quote|quotation")) & F.contains(name, F.lit("invoice"))


def derived(obs: DataFrame) -> DataFrame:
    """obs with used_total and used_unit (pence): a missing total is unit price times quantity, a missing unit price total by quantity.

    obs(total, unit, quantity): quantity is a decimal of four digits. The columns are made one after the other, so that each is
    computed once.
    """
    ten = F.lit(10000)
    rows = obs.withColumn("quantity_10000", (F.col("quantity") * 10000).cast("long"))
    times = F.col("quantity_10000")
    rows = rows.withColumn("used_total", F.coalesce("total", F.when(times > 0, half_up(F.col("unit") * times, ten))))
    return rows.withColumn("used_unit", F.coalesce("unit", F.when(times > 0, half_up(F.col("used_total") * ten, times)))).drop("quantity_10000")


def exclusion_reason(any_invoice: bool = False) -> Column:
    """The first reason, apart from its date, why an observation (see `derived`) doesn't count, or null.

    any_invoice: whatever has "invoice" in its name counts as one, as in lists of comparables.
    """
    return F.coalesce(*[F.when(t, F.lit(r)) for t, r in zip(_exclusions(any_invoice), REASONS, strict=True)])


def _exclusions(any_invoice: bool = False) -> list[Column]:
    """The tests of REASONS."""
    kind, total = F.col("document_type"), F.col("used_total")
    invoice = F.contains(F.lower(F.trim(kind)), F.lit("invoice")) if any_invoice else is_invoice(kind)
    return [~F.col("eligible"), ~invoice, ~F.col("unit_compatible"), ~F.col("scope_equivalent"), F.coalesce("comparability", F.lit(0)) <= 0, total.isNull() | (total <= 0)]


def recency_weight(observed: Column, as_of: Column, policy: Policy = Policy()) -> Column:
    """Half for each half-life, with 18 digits: equal ages have equal weights, and sums are exact."""
    return F.pow(F.lit(0.5), F.datediff(as_of, observed) / F.lit(float(policy.half_life_days))).cast("decimal(20,18)")


def before(asks: DataFrame, facts: DataFrame, keys: list[str], told: dict[str, Column]) -> DataFrame:
    """asks(keys, as_of), each once, with aggregates over the facts(keys, day, ...) of strictly earlier days.

    Facts are few for a key (sums of a day), so a window over the key and its days is small however hot the key is.
    """
    rows = facts.withColumn("as_of", F.lit(None).cast("date")).unionByName(asks.withColumn("day", F.col("as_of")), allowMissingColumns=True)
    rows = rows.withColumn("on", F.unix_date("day"))
    earlier = Window.partitionBy(*keys).orderBy("on").rangeBetween(Window.unboundedPreceding, -1)
    return rows.select(*keys, "as_of", *[c.over(earlier).alias(n) for n, c in told.items()]).where("as_of IS NOT NULL")


class Median:
    """Weights by price in order, with the place where half of the weight is reached."""

    def __init__(self):
        self.prices, self.weights, self.whole = [], {}, 0
        self.at, self.below = 0, 0  # the middle price, and the weight of all smaller ones

    def add(self, price: int, weight: int) -> None:
        if price not in self.weights:
            insort(self.prices, price)
            self.weights[price] = 0
            if len(self.prices) > 1 and price < self.prices[self.at + (price <= self.prices[self.at])]:
                self.at += 1
        if price < self.prices[self.at]:
            self.below += weight
        self.weights[price] += weight
        self.whole += weight
        while 2 * self.below >= self.whole:
            self.at -= 1
            self.below -= self.weights[self.prices[self.at]]
        while 2 * (self.below + self.weights[self.prices[self.at]]) < self.whole:
            self.below += self.weights[self.prices[self.at]]
            self.at += 1

    def value(self) -> int | None:
        """At exactly half the mean with the next price, half up."""
        if not self.prices:
            return None
        price = self.prices[self.at]
        if 2 * (self.below + self.weights[price]) == self.whole and self.at + 1 < len(self.prices):
            return (price + self.prices[self.at + 1] + 1) // 2
        return price


class _Medians(State):
    """Running medians of line totals and of unit prices."""

    def __init__(self, key: tuple):
        super().__init__(key)
        self.line, self.unit = Median(), Median()

    def step(self, row: tuple):
        as_of, rank, line, unit, factor, share, earlier = row
        if rank == 1:
            return [(*self.key[:-1], as_of, self.line.value(), self.unit.value())]
        weight = int(earlier) if rank == 0 else factor * share
        if line:
            self.line.add(line, weight)
        if unit:
            self.unit.add(unit, weight)
        return ()


def running_medians(asks: DataFrame, sums: DataFrame, keys: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """keys, as_of, median_line, median_unit: of the weighted prices of strictly earlier days, for asks(keys, as_of), each once.

    sums(keys, day, line, unit, factor, share): two prices of one whole weight, factor * share; a null or zero is no price. One
    pass in order of days for a key. A key of more than `block_rows` sums (or prices, if it has more of these) is cut by days
    into periods; each begins with the weights of all earlier ones by price, so that all periods together begin with no
    more rows than the key has.
    """
    columns = [*keys, "period", "day", "rank", "line", "unit", "factor", "share", "earlier"]
    typed = {f.name: f.dataType.simpleString() for f in asks.schema}
    of = lambda df, rank: df.withColumn("rank", F.lit(rank))
    none = lambda kind: F.lit(None).cast(kind)
    whole = sums.groupBy(*keys).agg(F.count("*").alias("n"), F.greatest(F.approx_count_distinct("line") + F.approx_count_distinct("unit"), F.lit(block_rows)).alias("block")).where("n > block")
    if whole.isEmpty():
        own, begin = sums.withColumn("period", F.lit(0)), None
        asks = asks.select(*keys, F.col("as_of").alias("day"), F.lit(0).alias("period"))
    else:
        same = lambda a, b: [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys]
        days = sums.join(whole.drop("n"), keys).groupBy(*keys, "day", "block").agg(F.count("*").alias("n"))
        ordered = Window.partitionBy(*keys).orderBy("day")
        cut = days.withColumn("part", F.floor((F.sum("n").over(ordered) - F.col("n")) / F.col("block"))).groupBy(*keys, "part").agg(F.min("day").alias("first"))
        along = Window.partitionBy(*keys).orderBy("first")
        periods = cut.select(*keys, (F.row_number().over(along) - 1).alias("period"), "first", F.lead("first").over(along).alias("next"), (F.count("*").over(Window.partitionBy(*keys)) - 1).cast("int").alias("last"))
        inside = [*same("s", "p"), F.col("s.day") >= F.col("p.first"), F.col("p.next").isNull() | (F.col("s.day") < F.col("p.next"))]
        own = sums.alias("s").join(periods.alias("p"), inside, "left").select("s.*", F.coalesce("p.period", F.lit(0)).alias("period"), F.col("p.last").alias("last"))
        asked = [*same("s", "p"), F.col("s.as_of") > F.col("p.first"), F.col("p.next").isNull() | (F.col("s.as_of") <= F.col("p.next"))]
        asks = asks.alias("s").join(periods.alias("p"), asked, "left").select(*[F.col(f"s.{k}") for k in keys], F.col("s.as_of").alias("day"), F.coalesce("p.period", F.lit(0)).alias("period"))
        # What a price weighs at the end of a period it brings to all periods up to the next that has it.
        one = own.where("last > 0").select(*keys, "period", "last", (F.col("factor").cast("decimal(19,0)") * F.col("share").cast("decimal(18,0)")).cast("decimal(38,0)").alias("weight"), F.explode(F.array(F.struct("line", none("long").alias("unit")), F.struct(none("long").alias("line"), "unit"))).alias("m"))
        ends = one.where("m.line > 0 OR m.unit > 0").groupBy(*keys, "m.line", "m.unit", "period", "last").agg(F.sum("weight").cast("decimal(38,0)").alias("w"))
        price = Window.partitionBy(*keys, "line", "unit").orderBy("period")
        ends = ends.select(*keys, "line", "unit", F.sum("w").over(price).cast("decimal(38,0)").alias("earlier"), F.col("period").alias("at"), F.coalesce(F.lead("period").over(price), F.col("last")).alias("until")).where("at < until")
        begin = ends.select(*keys, "line", "unit", "earlier", F.explode(F.sequence(F.col("at") + 1, F.col("until"))).alias("period"), none("date").alias("day"), none("long").alias("factor"), none("long").alias("share"))
    rows = of(own.withColumn("earlier", none("decimal(38,0)")), 2).select(*columns)
    rows = rows.unionByName(of(asks, 1), allowMissingColumns=True).select(*columns)
    if begin is not None:
        rows = rows.unionByName(of(begin, 0).select(*columns))
    # Days go by as whole numbers, which are cheap to hand over.
    found = carried(rows.withColumn("day", F.unix_date("day")), [*keys, "period"], ["day", "rank"], ", ".join(f"`{k}` {typed[k]}" for k in keys) + ", as_of int, median_line long, median_unit long", _Medians)
    return found.withColumn("as_of", F.date_from_unix_date("as_of"))


def historical_statistics(lines: DataFrame, obs: DataFrame, policy: Policy = Policy(), keys: tuple[str, ...] = ("item_id",), block_rows: int = BLOCK_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each line of lines(line_id, keys, as_of, keep): what its item's history before that day says.

    obs(keys, observed_at, document_type, eligible, unit_compatible, scope_equivalent, comparability, total, unit, quantity,
    lineage), money in pence. A missing total is unit price times quantity, a missing unit price total by quantity. Returns
    line_id, eligible_count, excluded_count, excluded_reasons (array of reason and count, by reason; observations that
    aren't past count as not_past_observation), median_line, median_unit (weighted, in pence), weak_sample, preferred_count
    (totals as given), derived_count, observed_from, observed_to, lineages (sorted), and the columns to keep. A line without an
    item has no history.
    """
    keep = ("line_id", *keep)
    asked = lines.select(*keys, F.col("as_of").alias("day"), F.lit(True).alias("asked"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    rows = written(_observed(obs.where("observed_at IS NOT NULL"), keys).unionByName(asked, allowMissingColumns=True), "history")
    return _statistics(rows, F.col("day"), lambda df: df, policy, list(keys), block_rows, keep)


def own_statistics(rows: DataFrame, told: dict[str, Column], policy: Policy = Policy(), keys: tuple[str, ...] = ("item_id",), block_rows: int = BLOCK_ROWS, keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """`historical_statistics` where lines are observations themselves: those that are `asked`, as of the day they were observed.

    rows(keys, keep, ...); `told` makes an observation's columns and `asked` of a row, after the rows were dealt: each shuffles once,
    as it is. rows are read several times, so a table serves better than a plan of joins.
    """
    made = lambda df: _observed(df.select(*dict.fromkeys([*keys, *keep]), *[c.alias(n) for n, c in told.items()]), keys, ("asked",), keep)
    return _statistics(rows, told["observed_at"], made, policy, list(keys), block_rows, keep)


def _observed(obs: DataFrame, keys: tuple[str, ...], more: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Observations with their day, the number of the reason that leaves them out (0: none), prices and millionths of weight."""
    reason = F.coalesce(*[F.when(t, F.lit(i)) for i, t in enumerate(_exclusions(), 1)], F.lit(0)).cast("tinyint")
    return derived(obs).select(
        *keys, F.col("observed_at").alias("day"), reason.alias("reason"), F.col("total").isNotNull().alias("given"), "lineage",
        (F.least("comparability", F.lit(1)) * 1000000).cast("long").alias("share"), F.col("used_total").cast("long").alias("line"), F.col("used_unit").cast("long").alias("unit"),
        *more, *[F.col(c).alias(f"kept_{c}") for c in keep],
    )


def _statistics(rows: DataFrame, day: Column, made: Callable[[DataFrame], DataFrame], policy: Policy, keys: list[str], block_rows: int, keep: tuple[str, ...]) -> DataFrame:
    """made(rows): keys, day, reason, given, lineage, share, line, unit, asked, kept columns; observations have a reason, lines are asked."""
    kept = [f"kept_{c}" for c in keep]
    there = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, day.isNotNull())
    live = rows.where(there)
    # Weights are whole numbers: 2^62 on the table's last day, times millionths of the comparability.
    newest = made(live).where("reason = 0").agg(F.max("day")).first()[0]
    age = F.greatest(F.datediff(F.lit(newest), "day"), F.lit(0))
    factor = F.greatest((F.pow(F.lit(0.5), age / F.lit(float(policy.half_life_days))) * F.lit(float(1 << 62))).cast("long"), F.lit(1).cast("long"))
    hot = hot_keys(live, keys, block_rows)
    cold = live if hot is None else live.join(F.broadcast(hot), keys, "left_anti")
    told = _looked_back(made(cold.repartition(*keys)), keys, kept, factor)
    if hot is not None:
        told = told.unionByName(_looked_up(made(live.join(F.broadcast(hot), keys, "left_semi")), keys, kept, factor, block_rows))
    told = told.unionByName(made(rows.where(~there)).where("asked").select(*kept), allowMissingColumns=True)
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long")
    counts = {r: zero(r) for r in [*REASONS, "not_past_observation"]}
    found = F.filter(F.array(*[F.struct(F.lit(r).alias("reason"), c.alias("count")) for r, c in sorted(counts.items())]), lambda x: x["count"] > 0)
    return told.select(
        *[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], zero("ok").alias("eligible_count"), sum(counts.values(), F.lit(0).cast("long")).alias("excluded_count"), found.alias("excluded_reasons"), "median_line", "median_unit",
        (zero("ok") < policy.least_history).alias("weak_sample"), zero("given").alias("preferred_count"), (zero("ok") - zero("given")).alias("derived_count"), "observed_from", "observed_to", F.coalesce("lineages", F.array().cast("array<string>")).alias("lineages"),
    )


def _look_back(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, list[pa.Array]]:
    """The places of the lines in rows of whole keys, by day, and their counts, dates, medians and lineages of the observations of earlier days."""
    n = table.num_rows
    fresh = _starts(table, keys)
    day, reason = table["day"].to_numpy(), pc.fill_null(table["reason"], -1).to_numpy()
    starts, group, at = np.flatnonzero(fresh), np.cumsum(fresh) - 1, np.arange(n)
    new = fresh.copy()
    new[1:] |= day[1:] != day[:-1]
    asks = np.flatnonzero(pc.fill_null(table["asked"], False).to_numpy(zero_copy_only=False))
    whose = group[asks]
    first, end, upto = starts[whose], np.append(starts[1:], n)[whose], np.maximum.accumulate(np.where(new, at, 0))[asks]
    run = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    counts = [run(reason == i) for i in range(len(REASONS) + 1)]  # 0: they count
    past, whole = [c[upto] - c[first] for c in counts], [c[end] - c[first] for c in counts]
    shown = [whole[i] if r in _ANY_DAY else past[i] for i, r in enumerate(REASONS, 1)]
    later = sum(whole[i] - past[i] for i in range(len(REASONS) + 1) if not i or REASONS[i - 1] not in _ANY_DAY)
    good = np.flatnonzero(reason == 0)
    given = run((reason == 0) & pc.fill_null(table["given"], False).to_numpy(zero_copy_only=False))
    begin, until = counts[0][first], counts[0][upto]
    when = lambda i: pa.array(day[good[np.clip(i, 0, len(good) - 1)]] if len(good) else np.zeros(len(asks), np.int32), pa.int32(), mask=past[0] == 0)
    kept = table.take(pa.array(good))
    line, unit, share, factor, lineage = (values(kept[c].combine_chunks()) for c in ("line", "unit", "share", "factor", "lineage"))
    lines, units, sources, key = [], [], [], -1
    for k, i, j in zip(whose.tolist(), begin.tolist(), until.tolist(), strict=True):
        if k != key:
            key, here, known = k, i, []
            of_line, of_unit, typical, single = Median(), Median(), None, None
        if here < j:
            for x in range(here, j):
                if line[x]:
                    of_line.add(line[x], factor[x] * share[x])
                if unit[x]:
                    of_unit.add(unit[x], factor[x] * share[x])
                if lineage[x] is not None and lineage[x] not in known:
                    known = sorted([*known, lineage[x]])
            here, typical, single = j, of_line.value(), of_unit.value()
        lines.append(typical)
        units.append(single)
        sources.append(known)
    numbers = [past[0], given[upto] - given[first], *shown, later]
    return asks, [*[pa.array(x, pa.int64()) for x in numbers], when(begin), when(until - 1), pa.array(lines, pa.int64()), pa.array(units, pa.int64()), pa.array(sources, pa.list_(pa.string()))]


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a key begins at a row."""
    out = np.ones(table.num_rows, bool)
    out[1:] = False
    for k in keys:
        c = table[k]
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy()
    return out


def _looked_back(rows: DataFrame, keys: list[str], kept: list[str], factor: Column) -> DataFrame:
    """Lines with what their keys' observations say, in one pass over rows that are dealt by key; a task holds the rows of one key."""
    used = rows.sortWithinPartitions(*keys, "day").select(*keys, F.unix_date("day").alias("day"), "reason", "given", "lineage", "share", "line", "unit", "asked", factor.alias("factor"), *kept)
    numbers = ["ok", "given", *REASONS, "not_past_observation"]
    told = StructType.fromDDL(", ".join(f"{n} long" for n in numbers) + ", since int, last int, median_line long, median_unit long, lineages array<string>")
    kinds = StructType([rows.schema[c] for c in kept] + told.fields)

    def work(batches):
        def tell(table: pa.Table):
            table = table.combine_chunks()
            asks, made = _look_back(table, keys)
            if len(asks):
                lines = table.select(kept).take(pa.array(asks)).combine_chunks()
                yield pa.RecordBatch.from_arrays([*[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in lines.columns], *made], names=kinds.names)

        left = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            edges = np.flatnonzero(_starts(table, keys))
            if left and any(left[-1][k][-1] != table[k][0] for k in keys):
                yield from tell(pa.concat_tables(left))
                left = []
            if len(edges) > 1:
                cut = int(edges[-1])
                yield from tell(pa.concat_tables([*left, table.slice(0, cut)]))
                left = []
                table = table.slice(cut)
            left.append(table)
        if left:
            yield from tell(pa.concat_tables(left))

    found = used.mapInArrow(work, kinds)
    return found.withColumns({"observed_from": F.date_from_unix_date("since"), "observed_to": F.date_from_unix_date("last")}).drop("since", "last")


def _looked_up(rows: DataFrame, keys: list[str], kept: list[str], factor: Column, block_rows: int) -> DataFrame:
    """The same for keys of very many rows: states of the days that lines ask for, from sums by day and price."""
    lines = rows.where("asked").select(*keys, F.col("day").alias("as_of"), *kept)
    told = rows.where("reason IS NOT NULL")
    # Observations that are alike on a day count together; everything below rests on this table.
    told = written(told.groupBy(*keys, "day", "reason", "given", "lineage", "line", "unit").agg(F.count("*").alias("n"), F.sum("share").alias("share")), "sums")
    asks = lines.select(*keys, "as_of").distinct()
    good = told.where("reason = 0")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    right = F.col("reason") == 0
    facts = told.groupBy(*keys, "day").agg(*[count(F.col("reason") == i).alias(r) for i, r in enumerate(REASONS, 1)], count(right).alias("ok"), count(right & F.col("given")).alias("given"))
    sums = {n: F.sum(n) for n in [*REASONS, "ok", "given"]}
    dates = {"observed_from": F.min(F.when(F.col("ok") > 0, F.col("day"))), "observed_to": F.max(F.when(F.col("ok") > 0, F.col("day")))}
    past = before(asks, facts, keys, sums | dates)
    whole = facts.groupBy(*keys).agg(*[F.sum(n).alias(f"all_{n}") for n in [*REASONS, "ok"]])
    past = past.join(whole, keys, "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long")
    dated = [r for r in REASONS if r not in _ANY_DAY]
    later = sum((zero(f"all_{n}") - zero(n) for n in [*dated, "ok"]), F.lit(0).cast("long"))
    daily = good.groupBy(*keys, "day", "line", "unit").agg(F.sum("share").alias("share"))
    daily = daily.select(*keys, "day", "line", "unit", factor.alias("factor"), "share")
    medians = running_medians(asks, daily, keys, block_rows)
    sources = good.where("lineage IS NOT NULL").groupBy(*keys, "lineage").agg(F.min("day").alias("since")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lineage", "since"))).alias("sources"))
    state = past.select(*keys, "as_of", zero("ok").alias("ok"), zero("given").alias("given"), *[zero(f"all_{r}" if r in _ANY_DAY else r).alias(r) for r in REASONS], later.alias("not_past_observation"), "observed_from", "observed_to")
    state = state.join(medians, [*keys, "as_of"], "left").join(sources, keys, "left")
    known = F.transform(F.filter("sources", lambda s: s["since"] < F.col("as_of")), lambda s: s["lineage"])
    return lines.join(state.withColumn("lineages", known).drop("sources"), [*keys, "as_of"], "left").drop(*keys, "as_of")


def past_counts(lines: DataFrame, obs: DataFrame, keys: list[str]) -> DataFrame:
    """lines(line_id, keys, as_of) with earlier, latest: how many observations of its keys are older, and the newest of these."""
    facts = obs.groupBy(*keys, F.col("observed_at").alias("day")).agg(F.count("*").alias("n"))
    found = before(lines.select(*keys, "as_of").distinct(), facts, keys, {"earlier": F.sum("n"), "latest": F.max(F.when(F.col("n") > 0, F.col("day")))})
    return lines.join(found, [*keys, "as_of"], "left").withColumn("earlier", F.coalesce("earlier", F.lit(0)))


def category_level(lines: DataFrame, obs: DataFrame, levels: list[str], least: int = 3, key: str = "item_id") -> DataFrame:
    """lines with level, rows_used: the first level with `least` older observations of the line's own category, else all.

    lines(line_id, key, as_of, levels), obs(key, observed_at, levels): a level is a column of categories on both sides. A line
    without a category at a level doesn't take it.
    """
    rows = past_counts(lines, obs, [key]).withColumnRenamed("earlier", "n_all").drop("latest")
    for x in levels:
        rows = past_counts(rows, obs, [key, x]).withColumnRenamed("earlier", f"n_{x}").drop("latest")
    used = F.coalesce(*[F.when(F.col(f"n_{x}") >= least, F.lit(x)) for x in levels], F.lit("all"))
    rows = rows.withColumn("level", used)
    number = F.coalesce(*[F.when(F.col("level") == x, F.col(f"n_{x}")) for x in levels], F.col("n_all"))
    return rows.select(*lines.columns, "level", number.alias("rows_used"))


def category_statistics(lines: DataFrame, obs: DataFrame, levels: list[str], policy: Policy = Policy(), least: int = 3) -> DataFrame:
    """`historical_statistics` of each line over the history of its level (see `category_level`), with that level."""
    told = category_level(lines, obs, levels, least)
    out = None
    for x in [*levels, "all"]:
        keys = ("item_id",) if x == "all" else ("item_id", x)
        some = historical_statistics(told.where(F.col("level") == x), obs, policy, keys).withColumn("level", F.lit(x))
        out = some if out is None else out.unionByName(some)
    return out
