"""Engineers' assessments against invoices."""

from __future__ import annotations

from collections import deque
from functools import lru_cache, partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repairbench.functions.exact import half_up
from repairbench.functions.text import normalise_operation, registration_key, with_operation
from repairbench.operators.carried import State, carried


def pair_assessments(assessments: DataFrame, invoices: DataFrame) -> DataFrame:
    """assessment_id, invoice_id, score, status, reasons: the best invoice of the claim, if it scores .70 or more; ties go to the smaller invoice.

    assessments(assessment_id, case_id, registration, reference), invoices(invoice_id, case_id, registration, number). Equal
    registrations count 70, a reference that the invoice's number holds 25. Nothing pairs a claim's assessments with its
    invoices: a registration keeps its smallest invoice, and so does each part of a number that is as long as some
    reference; assessments look both up. Only those without an invoice of their registration look for their reference in
    the claim's other numbers. An unpaired assessment tells the score and the reasons of its best invoice.
    """
    key = lambda c: F.nullif(registration_key(F.col(c)), F.lit(""))
    a = assessments.select("assessment_id", "case_id", key("registration").alias("own"), F.nullif(F.upper("reference"), F.lit("")).alias("wanted"))
    i = invoices.select("invoice_id", "case_id", key("registration").alias("own"), F.upper("number").alias("number"))
    least = F.min("invoice_id").alias("least")
    first = i.where("own IS NOT NULL").groupBy("case_id", "own").agg(least)
    told = a.join(first, ["case_id", "own"], "left")
    lengths = a.agg(F.collect_set(F.length("wanted")).alias("lengths"))

    def parts(numbers: DataFrame, keys: list[str]) -> DataFrame:
        """The smallest invoice of each part of the numbers, as long as some reference."""
        rows = numbers.crossJoin(F.broadcast(lengths)).select(*keys, "invoice_id", "number", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("number"))
        rows = rows.select(*keys, "invoice_id", "number", "n", F.explode(F.sequence(F.lit(1), F.length("number") - F.col("n") + 1)).alias("at"))
        return rows.select(*keys, "invoice_id", F.substring("number", F.col("at"), F.col("n")).alias("wanted")).groupBy(*keys, "wanted").agg(least)

    same = told.where("least IS NOT NULL").join(parts(i.where("own IS NOT NULL"), ["case_id", "own"]).withColumnRenamed("least", "held"), ["case_id", "own", "wanted"], "left")
    rest = told.where("least IS NULL").drop("least")
    asked = rest.where("wanted IS NOT NULL").select("case_id").distinct()
    rest = rest.join(parts(i.join(asked, "case_id", "left_semi"), ["case_id"]).withColumnRenamed("least", "held"), ["case_id", "wanted"], "left")
    score = lambda base: F.when(F.col("held").isNotNull(), base + 25).otherwise(base)
    rows = same.select("assessment_id", F.coalesce("held", "least").alias("best"), score(70).alias("score")).unionByName(rest.select("assessment_id", F.col("held").alias("best"), score(0).alias("score")))
    paired = F.col("score") >= 70
    reasons = F.array_compact(F.array(F.when(paired, "registration exact match"), F.when(F.col("score").isin(25, 95), "claim reference found in invoice number"), F.when(F.col("score") == 0, "no safe identifier match")))
    return rows.select("assessment_id", F.when(paired, F.col("best")).alias("invoice_id"), "score", F.when(paired, "paired").otherwise("unpaired").alias("status"), reasons.alias("reasons"))


def match_score(left: Column, right: Column) -> Column:
    """Shared words over all words of two operations; 1 if they read the same."""
    return name_score(normalise_operation(left), normalise_operation(right))


def name_score(a: Column, b: Column) -> Column:
    """The score of two normalised operations."""
    x, y = F.filter(F.split(a, " "), lambda w: w != ""), F.filter(F.split(b, " "), lambda w: w != "")
    shared = F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0))
    return F.when(a == b, 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(shared)


@lru_cache(maxsize=1 << 16)
def _words(name: str) -> frozenset[str]:
    return frozenset(w for w in name.split(" ") if w)


class _Greedy(State):
    """The free lines of a group by their words, and the operation at hand."""

    def __init__(self, key: tuple, least: float):
        super().__init__(key)
        self.least, self.free, self.taken, self.lines, self.operation, self.wanted = least, {}, set(), 0, None, []

    def step(self, row: tuple):
        side, _, line, number, operation, name = row
        if not side:
            self.free.setdefault(_words(name), deque()).append((self.lines, line))
            self.lines += 1
            return ()
        out = ()
        if (number, operation) != self.operation:
            out, self.operation = self.end(), (number, operation)
        self.wanted.append(_words(name))
        return out

    def first(self, words: frozenset[str]) -> tuple | None:
        """Place and id of the first free line of these words; lines taken under other words are dropped on the way."""
        lines = self.free.get(words)
        while lines and lines[0][1] in self.taken:
            lines.popleft()
        if not lines:
            self.free.pop(words, None)
        return lines[0] if lines else None

    def end(self):
        best = None
        for wanted in set(self.wanted):
            # Lines of the very same words score 1, no others do.
            for words in [wanted] if self.first(wanted) else list(self.free):
                score = 1.0 if words == wanted else len(words & wanted) / len(words | wanted)
                if score >= self.least and (best is None or score >= best[0]) and (line := self.first(words)) and (best is None or (score, -line[0]) > (best[0], -best[1][0])):
                    best = (score, line)
        self.wanted = []
        if best is None:
            return ()
        self.taken.add(best[1][1])
        return [(self.key[0], self.operation[1], best[1][1], best[0])]


def match_operations(operations: DataFrame, lines: DataFrame, least: float = 0.34) -> DataFrame:
    """group_id, op_id, line_id, score: each operation in turn takes the best line that is left, ties to the first line.

    operations(group_id, op_id, op_no, description), lines(group_id, line_id, line_no, description): the numbers are
    the places in the assessment and on the invoice. Pairs below `least` never match, nor what has no description. See `match_sides`.
    """
    kind, other = dict(operations.dtypes), dict(lines.dtypes)
    none = lambda of, c: F.lit(None).cast(of[c]).alias(c)
    o = operations.select("group_id", F.lit(1).alias("side"), none(other, "line_no"), none(other, "line_id"), "op_no", "op_id", "description")
    i = lines.select("group_id", F.lit(0).alias("side"), "line_no", "line_id", none(kind, "op_no"), none(kind, "op_id"), "description")
    return match_sides(i.unionByName(o), least)


def match_sides(rows: DataFrame, least: float = 0.34) -> DataFrame:
    """`match_operations` of one table: rows(group_id, side, line_no, line_id, op_no, op_id, description), lines with side 0, operations with side 1.

    No pairs are formed: the lines of a group go by first, then its operations, in their order. A task holds the ids of
    a group's lines by the distinct words that they have, and an operation is scored against those that are left.
    """
    kind = dict(rows.dtypes)
    told = with_operation(rows.where("group_id IS NOT NULL AND description IS NOT NULL"), "description", "_name").select("group_id", "side", "line_no", "line_id", "op_no", "op_id", "_name")
    return carried(told, ["group_id"], ["side", "line_no", "line_id", "op_no", "op_id"], f"group_id {kind['group_id']}, op_id {kind['op_id']}, line_id {kind['line_id']}, score double", partial(_Greedy, least=least))


def assessment_variance(matches: DataFrame) -> DataFrame:
    """matches(assessed, billed) in pence with difference, percent of the assessed (hundredths) and threshold status."""
    gap = F.col("billed") - F.col("assessed")
    percent = F.when(F.col("assessed") != 0, half_up(gap * 10000, F.abs("assessed")))
    over = lambda p: (gap >= 500) & (gap * 100 > F.col("assessed") * p) & (F.col("assessed") > 0)
    status = F.when(over(10), "above_10_percent").when(over(5), "above_5_percent").otherwise("within_threshold")
    return matches.withColumn("difference", gap).withColumn("percent", percent).withColumn("threshold_status", status)
