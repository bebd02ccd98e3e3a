"""Ordered rewrite rules over a text column, with a log of what each rule changed."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    pattern: str
    replacement: str
    kind: str = "literal"  # or regex
    confidence: str = "medium"

    @property
    def regex(self) -> str:
        return self.pattern if self.kind == "regex" else rf"\Q{self.pattern}\E"

    def valid(self) -> bool:
        if self.kind != "regex":
            return True
        try:
            re.compile(self.pattern)
        except re.error:
            return False
        return True


def parse_glossary(text: Column) -> Column:
    """Lines `raw => normalized => confidence` as structs; comments and incomplete lines are left out, the confidence is medium by default."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: ~x.startswith("#") & x.contains("=>"))
    parts = F.transform(lines, lambda x: F.transform(F.split(x, "=>"), lambda y: F.trim(y)))
    good = F.filter(parts, lambda p: (p[0] != "") & (p[1] != ""))
    return F.transform(good, lambda p: F.struct(p[0].alias("raw"), p[1].alias("normalized"), F.when(F.get(p, F.lit(2)).isin("high", "medium", "low"), F.get(p, F.lit(2))).otherwise("medium").alias("confidence")))


def longest_first(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: -len(r.pattern))


def _entry(i: int, rule: Rule, found: Column):
    status = "auto_approved" if rule.confidence == "high" else "needs_review"

    def entry(raw: Column) -> Column:
        n = F.size(F.filter(found, lambda x: x == raw))
        return F.struct(F.lit(i).alias("rule"), raw.alias("raw"), F.lit(rule.replacement).alias("normalized"), n.alias("n"), F.lit(rule.confidence).alias("confidence"), F.lit(status).alias("status"))

    return entry


def apply_rules(rows: DataFrame, rules: list[Rule], text: str = "text", out: str = "normalized", log: str = "changes") -> DataFrame:
    """rows with the rewritten text and the log: an array of (rule, raw, normalized, n, confidence, status) in the rules' order.

    Each rule sees what those before it made. A rule logs each different match once, with its count; rules of high confidence
    approve themselves. Invalid patterns are skipped.
    """
    current, logs = F.col(text), []
    for i, rule in enumerate(rules):
        if not rule.valid():
            continue
        found = F.regexp_extract_all(current, F.lit(f"({rule.regex})"), 1)
        logs.append(F.transform(F.array_distinct(found), _entry(i, rule, found)))
        current = F.regexp_replace(current, rule.regex, re.sub(r"([\\$])", r"\\\1", rule.replacement) if rule.kind == "literal" else rule.replacement)
    return rows.withColumns({out: current, log: F.concat(*logs) if logs else F.array()})


def _match(i: int):
    return lambda raw: F.struct(F.lit(i).alias("rule"), raw.alias("raw"))


def change_log(rows: DataFrame, ids: list[str], rules: list[Rule], text: str = "text") -> DataFrame:
    """(ids, rule, raw, n, confidence, status): how often each rule changed each different match. Matches are counted per task before they are shuffled."""
    current, found = F.col(text), []
    for i, rule in enumerate(rules):
        if not rule.valid():
            continue
        matches = F.regexp_extract_all(current, F.lit(f"({rule.regex})"), 1)
        found.append(F.transform(matches, _match(i)))
        current = F.regexp_replace(current, rule.regex, re.sub(r"([\\$])", r"\\\1", rule.replacement) if rule.kind == "literal" else rule.replacement)
    counted = rows.select(*ids, F.explode(F.concat(*found)).alias("m")).groupBy(*ids, "m.rule", "m.raw").agg(F.count("*").alias("n"))
    confidence = F.element_at(F.array(*[F.lit(r.confidence) for r in rules]), F.col("rule") + 1)
    return counted.withColumn("confidence", confidence).withColumn("status", F.when(F.col("confidence") == "high", "auto_approved").otherwise("needs_review"))
