"""History without pairs against the pair-by-pair form, line by line, in plain Python."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal as D
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from repairbench.functions.rules import Policy
from repairbench.operators import history as H
from repairbench.operators.carried import State, carried, hot_keys
from repairbench.operators.compare import compare_lines, invoice_summary

OBS = "item_id long, obs_id long, observed_at date, document_type string, eligible boolean, unit_compatible boolean, scope_equivalent boolean, comparability decimal(10,4), total long, unit long, quantity decimal(20,4), lineage string, label string"
DAY = dt.date(2020, 1, 1)


def half_up(x: Fraction) -> int:
    return int((2 * x + 1) // 2)


def by_pairs(line, observations):
    """What one line's history says, from all observations of its item."""
    _, item, as_of = line[:3]
    reasons, kept = Counter(), []
    for o in (o for o in observations if o[0] == item and item is not None):
        _, key, day, kind, eligible, unit_ok, scope_ok, share, total, unit, quantity, lineage, _ = o
        derived = total if total is not None else half_up(unit * Fraction(quantity)) if unit is not None and quantity and quantity > 0 else None
        named = kind.strip().lower().replace("-", "_").replace(" ", "_")
        invoice = "invoice" in named and not any(w in named for w in ("estimate", "quote", "quotation"))
        tests = {"not_eligible": not eligible, "estimate_or_non_invoice": not invoice, "not_past_observation": day >= as_of, "unit_incompatible": not unit_ok, "quantity_scope_not_equivalent": not scope_ok, "zero_comparability": share <= 0, "missing_comparable_line_total": derived is None or derived <= 0}
        why = next((n for n, bad in tests.items() if bad), None)
        if why:
            reasons[why] += 1
            continue
        single = unit if unit is not None else half_up(derived / Fraction(quantity)) if quantity and quantity > 0 else None
        kept.append((derived, single, (as_of - day).days, min(share, D(1)), day, lineage, total is not None))

    def median(values):
        values = sorted(values)
        weight = [D("0.5") ** (D(age) / D("365.25")) * share for _, age, share in values]
        run = D(0)
        for k, (v, w) in enumerate(zip(values, weight, strict=True)):
            run += w
            if abs(2 * run - sum(weight)) < D("1e-20") and k + 1 < len(values):
                return half_up(Fraction(v[0] + values[k + 1][0], 2))
            if 2 * run >= sum(weight):
                return v[0]

    days = [k[4] for k in kept]
    given = sum(k[6] for k in kept)
    return (line[0], len(kept), sum(reasons.values()), sorted(reasons.items()), median([(k[0], k[2], k[3]) for k in kept]), median([(k[1], k[2], k[3]) for k in kept if k[1]]), len(kept) < 3, given, len(kept) - given, min(days, default=None), max(days, default=None), sorted({k[5] for k in kept if k[5]}))


def told(df):
    return sorted((r.line_id, r.eligible_count, r.excluded_count, [tuple(x) for x in r.excluded_reasons], r.median_line, r.median_unit, r.weak_sample, r.preferred_count, r.derived_count, r.observed_from, r.observed_to, r.lineages) for r in df.collect())


def tables(seed, items, n):
    random.seed(seed)
    kinds = ["invoice", "Repair Invoice", "invoice", "estimate", "Invoice quotation", " PRO-FORMA INVOICE "]
    observations = [
        (random.choice(items), i, DAY + dt.timedelta(days=random.choice([0, 1, 5, 400, 1461, 1500])), random.choice(kinds), random.random() < 0.9, random.random() < 0.9, random.random() < 0.9, D(random.choice(["1", "1", "0.5", "0", "1.5", "-1"])),
         random.choice([None, 0, 100, 250, 251, 9999]), random.choice([None, 0, 33, 50]), random.choice([None, D("0"), D("2.0000"), D("0.3333")]), random.choice([None, "a", "b"]), random.choice([None, "x", "y"]))
        for i in range(n)
    ]
    lines = [(i, random.choice([*items, None, 99]), DAY + dt.timedelta(days=random.choice([0, 1, 2, 401, 1461, 1500, 9000])), random.choice([None, "x", "y"])) for i in range(60)]
    return lines, observations


@pytest.mark.parametrize(("seed", "items", "block"), [(1, [1, 2, 3, 4, 5], 200_000), (2, [7], 10)])
def test_history_equals_its_pair_form(spark, seed, items, block):
    lines, observations = tables(seed, items, 220)
    l, o = spark.createDataFrame(lines, "line_id long, item_id long, as_of date, label string"), spark.createDataFrame(observations, OBS)
    want = sorted(by_pairs(x, observations) for x in lines)
    assert told(H.historical_statistics(l, o, block_rows=block)) == want
    assert told(H.historical_statistics(l, o.limit(0)))[0][1:5] == (0, 0, [], None)
    # Levels: the line's own label, where three older rows have it.
    past = lambda x, own: [y for y in observations if y[0] == x[1] and y[2] < x[2] and (not own or (x[3] and y[12] == x[3]))]
    levels = {x[0]: "label" if len(past(x, True)) >= 3 else "all" for x in lines}
    rows = H.category_level(l, o, ["label"]).collect()
    assert {r.line_id: (r.level, r.rows_used) for r in rows} == {x[0]: (levels[x[0]], len(past(x, levels[x[0]] == "label"))) for x in lines}
    want = sorted(by_pairs(x, [y for y in observations if levels[x[0]] == "all" or y[12] == x[3]]) for x in lines)
    assert told(H.category_statistics(l, o, ["label"])) == want


def test_no_join_of_an_item_with_itself(spark):
    """Rows grow with the observations, not with their pairs: ten thousand lines of one item look back on ten thousand."""
    o = spark.range(10000).selectExpr("1L AS item_id", "id AS obs_id", "date_add(DATE'2020-01-01', cast(id % 50 AS int)) AS observed_at", "'invoice' AS document_type", "true AS eligible", "true AS unit_compatible", "true AS scope_equivalent", "CAST(1 AS decimal(10,4)) AS comparability", "id % 7 + 1 AS total", "CAST(NULL AS long) AS unit", "CAST(1 AS decimal(20,4)) AS quantity", "CAST(NULL AS string) AS lineage")
    l = spark.range(10000).selectExpr("id AS line_id", "1L AS item_id", "date_add(DATE'2020-01-01', cast(id % 60 AS int)) AS as_of")
    rows = H.historical_statistics(l, o)
    assert rows.groupBy("eligible_count").count().count() == 51 and rows.where("median_line = 4 AND eligible_count = 10000").count() == 1660


def test_floor_score_and_lineage(spark):
    rows = [("a", 20000, True, 10000, "A", 12, 8000, ["B"], 0.99), ("b", 20000, True, 10000, "A", 2, 8000, ["A"], 0.5), ("c", 20000, False, None, None, 0, None, [], None)]
    df = spark.createDataFrame(rows, "line_id string, billed long, approved boolean, reference long, reference_lineage string, eligible_count long, median_line long, lineages array<string>, mapping_confidence double")
    df = df.selectExpr("*", "'v' AS invoice_ref", "CAST(1 AS decimal(20,4)) AS quantity", "'each' AS unit", "20 AS vat_rate", "true AS vatable", "'job' AS scope")
    out = {r.line_id: r for r in compare_lines(df, Policy(floor_pence=9500)).collect()}
    assert (out["a"].benchmark, out["a"].independent, float(out["a"].score), out["a"].score_label) == (9500, True, 95.25, "Very strong")  # 9200 by weights; 24.75 + 22.5 + 15 + 15 + 10 + 8
    assert (out["b"].source, out["b"].review_flags, float(out["b"].score)) == ("ontology", ["HISTORY_SAMPLE_WEAK", "SOURCE_LINEAGE_NOT_INDEPENDENT"], 63.0)
    assert (out["c"].benchmark, float(out["c"].score), out["c"].all_lineages) == (None, 38.75, [])
    row = invoice_summary(compare_lines(df)).first()
    assert (row.mean_score, row.label, row.percent) == (66, "Moderate", 3467)


def test_carried_state_over_batches_and_keys(spark):
    class Sum(State):
        def __init__(self, key):
            super().__init__(key)
            self.sum = 0

        def step(self, row):
            self.sum += row[0]
            return [(self.key[0], row[0], self.sum)]

        def end(self):
            return [(self.key[0], None, self.sum)]

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(100).selectExpr("id AS v", "if(id % 3 = 0, NULL, id % 3) AS k")
        got = carried(rows, ["k"], ["v"], "k long, v long, s long", Sum).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 103 and {r.k: r.s for r in got if r.v is None} == {None: 1683, 1: 1617, 2: 1650}


def test_values_of_a_batch_and_the_lines_of_a_history_joined_once(spark):
    import pyarrow as pa

    from repairbench.operators.carried import values
    from repairbench.plans.claim_queries import _compared

    big = (1 << 62) + 1
    for a in (pa.array([1, None, big]), pa.array([big, -1]), pa.array([None, None], pa.string()), pa.array(["a", None, ""]), pa.array([0.5, None]), pa.array([], pa.int64()), pa.array([True, None])):
        assert values(a) == a.to_pylist() and [type(x) for x in values(a)] == [type(x) for x in a.to_pylist()]
    plan = _compared(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan  # the tables are joined once, before anything reads the lines


def test_lines_that_are_observations_shuffle_once(spark):
    _, observations = tables(3, [1, 2, 3, None], 200)
    rows = spark.createDataFrame([(*o[:2], o[2] if o[1] % 50 else None, *o[3:]) for o in observations], OBS)
    names = ("observed_at", "document_type", "eligible", "unit_compatible", "scope_equivalent", "comparability", "total", "unit", "lineage")
    own = {n: F.col(n) for n in names} | {"asked": F.col("obs_id") % 3 != 0}
    lines = rows.where("obs_id % 3 <> 0").selectExpr("obs_id AS line_id", "item_id", "observed_at AS as_of")
    want = told(H.historical_statistics(lines, rows))
    for block in (200_000, 10):
        got = H.own_statistics(rows, own, keep=("obs_id", "quantity", "item_id"), block_rows=block).withColumnRenamed("obs_id", "line_id")
        assert told(got) == want and len(want) == 133
    got = H.own_statistics(rows, own, keep=("obs_id", "quantity")).withColumn("line_id", F.col("obs_id"))
    assert {r.line_id: r.quantity for r in got.collect()} == {o[1]: o[10] for o in observations if o[1] % 3}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_keys_of_many_rows(spark):
    rows = spark.range(100).selectExpr("IF(id < 60, 7, id) AS item_id")
    assert [r.item_id for r in hot_keys(rows, ["item_id"], 59).collect()] == [7] and hot_keys(rows, ["item_id"], 60) is None
