"""The batch P90 against its pair-by-pair form, with lines without an item or a category."""

import random

from repairbench.operators.batch import batch_dashboard, batch_p90


def test_batch_p90_equals_its_pair_form(spark):
    random.seed(4)
    rows = [(i, random.choice([1, 1, 1, 2, None]), random.randint(1, 40), random.choice([None, "a", "b", "c"]), random.choice([None, "x", "y"]), random.choice([None, 0, -5, 100, 900, 901, 5000, random.randint(1, 9999)])) for i in range(400)]
    df = spark.createDataFrame(rows, "line_id long, case_id long, rank long, item_key string, category string, cost long")
    got = {r.line_id: (r.history, r.p90, r.challenged) for r in batch_p90(df).collect()}
    for i, case, rank, item, category, cost in rows:
        prior = sorted(c for _, k, r, a, b, c in rows if k == case and r < rank and c and c > 0 and ((item and a == item) or (category and b == category)))
        p90 = None
        if len(prior) >= 3:
            at, part = divmod((len(prior) - 1) * 9, 10)
            p90 = (2 * (prior[at] * 10 + (prior[min(at + 1, len(prior) - 1)] - prior[at]) * part) + 10) // 20
        assert got[i][:2] == (len(prior), p90), i
        assert got[i][2] == bool(p90 and cost and cost - p90 >= 500 and round((cost - p90) * 1000 / p90) > 100)
    assert batch_p90(df.limit(0)).count() == 0


def test_dashboard_of_two_claims(spark):
    lines = [(f"{c}-{v}", c, v, None, v, "i1", "Pads", None, " Bob ", "labour" if v % 2 else "part", 50 * v, 1000 * v) for c in (1, 2) for v in range(1, 6)]
    df = spark.createDataFrame(lines, "line_id string, case_id long, invoice_ref long, invoice_date date, sequence long, identity string, item string, vehicle_label string, repairer string, kind string, unit_cost long, cost long")
    judged = batch_p90(df.selectExpr("line_id", "case_id", "invoice_ref AS rank", "identity AS item_key", "item AS category", "cost"))
    board = {n: d.where("case_id = 1").collect() for n, d in batch_dashboard(df, judged).items()}
    one = board["benchmarks"][0]
    assert (one["count"], one["mean"], one["labour_count"], one["labour_mean"], one["exception_count"], one["sample_strength"]) == (5, 30.0, 3, 1.5, 2, "usable")
    assert [r["line_id"] for r in sorted(board["sources"], key=lambda r: r["place"])] == [f"1-{v}" for v in range(1, 6)]
    assert (board["repairers"][0]["repairer"], board["repairers"][0]["challenge_count"], board["quality"][0]["coverage"]) == ("Bob", 2, 0)
    empty = batch_dashboard(df, judged, min_count=6)
    assert empty["benchmarks"].count() == empty["repairers"].count() == 0 and empty["summary"].count() == 2


def test_a_category_of_its_own_is_a_place_of_its_own(spark, monkeypatch):
    from repairbench.operators import batch

    seen = []
    deal = batch.carried
    monkeypatch.setattr(batch, "carried", lambda rows, keys, *more: (seen.append(rows.groupBy(*keys).count().collect()), deal(rows, keys, *more))[1])
    rows = [(n, 1, n, f"i{n % 8}", f"x{n % 4}", 100 + n) for n in range(80)] + [(80, 1, 80, "i0", "y", 500), (81, 1, 81, "i0", None, 500), (82, 1, 82, None, None, 9), (83, 1, 83, "solo", None, 9)]
    got = {r.line_id: r.history for r in batch.batch_p90(spark.createDataFrame(rows, "line_id long, case_id long, rank long, item_key string, category string, cost long")).collect()}
    assert sorted((r.place or "", r["count"]) for r in seen[0] if not r.shared) == [("", 1), ("cx1", 20), ("cx2", 20), ("cx3", 20), ("isolo", 1)]
    assert (got[79], got[80], got[81], got[82], got[83]) == (19, 10, 11, 0, 0)


def test_groups_that_go_are_not_counted_in_and_exceptions_do_not_meet_their_lines(spark, monkeypatch):
    from repairbench.operators import batch

    seen = []
    count = batch.benchmark_statistics
    monkeypatch.setattr(batch, "benchmark_statistics", lambda rows, *more: (seen.append(rows.count()), count(rows, *more))[1])
    rows = [(f"{n}", 1, n, None, f"i{n % 3}" if n < 30 else f"solo{n}", f"x{n % 3}" if n < 30 else f"y{n}", None, "Bob", "part", 50, 1000 * (1 + n % 20)) for n in range(60)]
    df = spark.createDataFrame(rows, "line_id string, case_id long, invoice_ref long, invoice_date date, identity string, item string, vehicle_label string, repairer string, kind string, unit_cost long, cost long")
    lines = df.selectExpr("*", "invoice_ref AS rank", "identity AS item_key", "item AS category")
    whole = batch.batch_p90(lines, keep=("line_id", "case_id", "invoice_ref", "invoice_date", "identity", "item", "vehicle_label", "repairer", "cost"))
    kept, joined = (batch.batch_dashboard(df, judged, min_count=3) for judged in (whole, batch.batch_p90(lines)))
    assert seen == [30] * 4  # prices and rates, twice
    for name in ("benchmarks", "repairers", "repairer_items"):
        got, want = (sorted(map(str, board[name].select(sorted(joined[name].columns)).collect())) for board in (kept, joined))
        assert got == want and got, name
    assert "sources" not in kept and "repairers" not in batch.batch_dashboard(df.drop("repairer"), whole, only=["benchmarks"])
