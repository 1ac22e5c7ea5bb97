"""False-positive rules that come as a table of (label, exact, patterns, valid, min_conf), as ``rule_table`` gives it.

A few rules become literals of the plan, so that each pattern is compiled once a task. More of them are joined
by lower-cased label: sorted, so that a label's pattern is compiled once a run, and cut down beforehand to the
labels that the candidates have.

All rules of a label count, whatever the case of its letters. Rules without a label are of no use, parts that are
null say nothing, and a candidate whose label, value or score is null is only rejected by what can be told.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from veilscan.functions.columns import trim_space
from veilscan.operators.false_positives import FalsePositiveRule, is_false_positive

#: Rules, and characters of them, that become literals of the plan at most.
PLAN_RULES, PLAN_CHARS = 200, 1 << 18

_LABEL, _PARTS = "_rule_label", ["_rule_exact", "_rule_pattern", "_rule_valid", "_rule_confidence"]


def judge_by_table(
    candidates: DataFrame,
    rules: DataFrame,
    out_col: str = "rejected",
    label_col: str = "label",
    value_col: str = "text",
    score_col: str = "score",
    plan_rules: int = PLAN_RULES,
) -> DataFrame:
    """All rows and columns of the candidates, and whether a rule of the table rejects them."""
    taken = {name.lower() for name in candidates.columns}
    for name in (out_col, _LABEL, *_PARTS):
        if name.lower() in taken:
            raise ValueError(f"there is a column {name} already")
    rules = _usable(rules)
    label, value = F.col(f"`{label_col}`"), F.col(f"`{value_col}`").cast("string")
    score = F.col(f"`{score_col}`").cast("float")
    chars = F.length(F.to_json(F.struct("label", "exact", "patterns", "valid")))
    size = rules.agg(F.count(F.lit(1)).alias("rules"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars")).first()
    if size.rules <= plan_rules and size.chars <= PLAN_CHARS:
        layers = _layers(rules.collect())
        parts = [F.coalesce(is_false_positive(label, value, score, layer), F.lit(False)) for layer in layers]
        return candidates.withColumn(out_col, reduce(or_, parts, F.lit(False)))
    rows = candidates.withColumn(_LABEL, F.lower(label))
    merged = _merged(rules).join(rows.select(_LABEL).distinct(), _LABEL, "left_semi")
    judged = rows.join(merged.hint("merge"), _LABEL, "left")
    kept = [F.col(f"`{name}`") for name in candidates.columns]
    return judged.select(*kept, _rejected(value, score).alias(out_col))


def _usable(rules: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    parts = [
        F.filter(F.coalesce(F.col(name), none), lambda x: x.isNotNull()).alias(name) for name in ("exact", "patterns")
    ]
    return rules.filter(F.col("label").isNotNull()).select(
        F.lower("label").alias("label"), *parts, "valid", F.col("min_conf").cast("float").alias("min_conf")
    )


def _layers(rows: Sequence[Row]) -> list[tuple[FalsePositiveRule, ...]]:
    """The rules, in layers that hold a label once."""
    layers: list[dict[str, FalsePositiveRule]] = []
    for row in rows:
        rule = FalsePositiveRule(row.label, tuple(row.exact), tuple(row.patterns), row.valid, row.min_conf)
        for layer in layers:
            if rule.label not in layer:
                layer[rule.label] = rule
                break
        else:
            layers.append({rule.label: rule})
    return [tuple(layer.values()) for layer in layers]


def _merged(rules: DataFrame) -> DataFrame:
    """One row a label: its stop words, one pattern for all that reject, the valid ones, the highest confidence."""
    one_of = F.transform(F.flatten(F.collect_list("patterns")), lambda p: F.concat(F.lit("(?:"), p, F.lit(")")))
    return rules.groupBy(F.col("label").alias(_LABEL)).agg(
        F.flatten(F.collect_list("exact")).alias(_PARTS[0]),
        F.when(F.size(one_of) > 0, F.concat(F.lit("(?d)"), F.array_join(one_of, "|"))).alias(_PARTS[1]),
        F.transform(F.collect_list("valid"), lambda p: F.concat(F.lit("(?d)"), p)).alias(_PARTS[2]),
        F.max("min_conf").alias(_PARTS[3]),
    )


def _rejected(value: Column, score: Column) -> Column:
    exact, pattern, valid, confidence = map(F.col, _PARTS)
    lowered = F.lower(trim_space(value))
    parts = [
        score < confidence,
        F.array_contains(exact, lowered),
        F.rlike(lowered, pattern),
        F.exists(valid, lambda p: ~F.rlike(value, p)),
    ]
    return reduce(or_, [F.coalesce(part, F.lit(False)) for part in parts])
