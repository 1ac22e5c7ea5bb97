"""Rules, by label, that tell a detected value is not what its label says."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions.columns import let, trim_space


@dataclass(frozen=True)
class FalsePositiveRule:
    """A value is rejected if one of the parts that are given says so.

    ``exact`` and ``patterns`` look at the trimmed lower-case value, ``valid`` at the value as it is.
    """

    label: str
    exact: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    valid: str | None = None
    min_confidence: float | None = None


# The rules. Patterns are Java regexes: `\z` is the very end of the text, `\p{Nd}` any
# decimal digit, and `(?d)` makes the dot stop at newlines only.
DEFAULT_RULES = (
    FalsePositiveRule(
        "password",
        exact=("password", "pwd", "passwd", "pass"),
        patterns=(r"^password\z", r"^pwd\z", r"password\p{Nd}*\z"),
    ),
    FalsePositiveRule(
        "email",
        exact=("email", "emailaddress", "useremail", "e-mail"),
        patterns=(r"^email\z", r"^.*email.*\z"),
        valid=r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z",
    ),
    FalsePositiveRule(
        "phone",
        exact=("phone", "phonenumber", "mobile", "tel", "telephone"),
        patterns=(r"^iphone\p{Nd}+\z", r"^phone\z", r"phone"),
        valid=r"(?:\p{Nd}[^\p{Nd}\n]*+){10}",
    ),
    FalsePositiveRule(
        "address",
        exact=(
            "address", "addr", "location", "phonenumber", "emailaddress", "emailaddressvalue",
        ),
        patterns=(r"^address\z", r"^.*address.*\z"),
    ),
    FalsePositiveRule(
        "credit card",
        exact=("card", "creditcard", "visa", "mastercard", "amex", "discover"),
        patterns=(r"^.*card.*\z", r"^visa\z", r"^mastercard\z"),
        valid=r"^\p{Nd}{13,19}\z",
    ),
    FalsePositiveRule(
        "ssn",
        exact=("ssn", "socialsecurity", "social"),
        patterns=(r"^[a-z]{1,5}\z", r"^[A-Z][a-z]+\z"),
        valid=r"^\p{Nd}{3}-?\p{Nd}{2}-?\p{Nd}{4}\z",
    ),
    FalsePositiveRule(
        "account number",
        patterns=(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z",),
        min_confidence=0.6,
    ),
    FalsePositiveRule(
        "ip address",
        exact=("prod", "staging", "dev"),
        patterns=(
            r"^[a-z]{2,3}-[a-z]+-\p{Nd}+\z", r"^prod-.*\z", r"^staging-.*\z", r"^dev-.*\z",
        ),
        valid=r"^\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\z",
    ),
    FalsePositiveRule(
        "username",
        exact=("username", "user", "userid", "user_id"),
        patterns=(r"^.*uuid\z", r"^.*_uuid\z", r"^.*Uuid\z"),
    ),
    FalsePositiveRule("date", min_confidence=0.7),
)


def rule_table(spark: SparkSession, rules: Sequence[FalsePositiveRule] = DEFAULT_RULES) -> DataFrame:
    """The rules as a dimension table."""
    rows = [(r.label, list(r.exact), list(r.patterns), r.valid, r.min_confidence) for r in rules]
    return spark.createDataFrame(
        rows,
        "label string, exact array<string>, patterns array<string>, valid string, min_conf float",
    )


def under_confidence(rule: FalsePositiveRule, score: Column) -> Column:
    if rule.min_confidence is None:
        return F.lit(False)
    return score < F.lit(rule.min_confidence).cast("float")


def is_stop_word(rule: FalsePositiveRule, lowered: Column) -> Column:
    return lowered.isin(list(rule.exact)) if rule.exact else F.lit(False)


def matches_reject(rule: FalsePositiveRule, lowered: Column) -> Column:
    if not rule.patterns:
        return F.lit(False)
    return lowered.rlike("(?d)" + "|".join(f"(?:{pattern})" for pattern in rule.patterns))


def fails_valid(rule: FalsePositiveRule, value: Column) -> Column:
    return F.lit(False) if rule.valid is None else ~value.rlike("(?d)" + rule.valid)


def by_label(
    label: Column,
    verdict: Callable[[FalsePositiveRule], Column],
    rules: Sequence[FalsePositiveRule],
) -> Column:
    """``verdict(rule)`` of the label's rule, false for a label without one."""
    chosen = F
    for rule in rules:
        chosen = chosen.when(F.lower(label) == rule.label, verdict(rule))
    return chosen.otherwise(False) if rules else F.lit(False)


def is_false_positive(
    label: Column,
    value: Column,
    score: Column,
    rules: Sequence[FalsePositiveRule] = DEFAULT_RULES,
) -> Column:
    def rejects(rule: FalsePositiveRule, lowered: Column) -> Column:
        parts = [
            rule.min_confidence is not None and under_confidence(rule, score),
            rule.exact and is_stop_word(rule, lowered),
            rule.patterns and matches_reject(rule, lowered),
            rule.valid is not None and fails_valid(rule, value),
        ]
        given = [part for part in parts if isinstance(part, Column)]
        return reduce(or_, given) if given else F.lit(False)

    # Rules are literals of the plan, so each pattern is compiled once per task.
    return let(
        F.lower(trim_space(value)),
        lambda lowered: by_label(label, lambda rule: rejects(rule, lowered), rules),
    )
