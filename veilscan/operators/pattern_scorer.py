"""A model-free scorer: PII-shaped runs of text become labelled tokens, the rest becomes ``O``.

Everything is a column expression, so scanning with it stays in the JVM and in one stage.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.columns import let, running_sum

OUTSIDE = "O"


# An unbounded repeat of a group that is not possessive.
_GROWING = re.compile(r"(?<!\\)\)(?:[*+]|\{[0-9]+,\})(?!\+)")


@dataclass(frozen=True)
class PatternRule:
    """Text matched by ``pattern`` is a token of ``label``; the label ``O`` shields text.

    Two hints make the search faster and must not change what it finds: every match begins with
    ``starts``, and only text that contains ``needs`` has a match.

    Groups that repeat without a bound have to be possessive: Java matches others by recursion, and
    a long text would overflow the stack of an executor.
    """

    label: str
    pattern: str
    score: float
    starts: str = ""
    needs: str = ""

    def __post_init__(self) -> None:
        if _GROWING.search(self.pattern):
            raise ValueError(f"Make the unbounded repeats of groups possessive in {self.pattern!r}")


_HEX = "[0-9a-fA-F]{8}"
_DIGIT = "[0-9]"
_ADDRESS_CHAR = "[A-Za-z0-9._%+-]"

# In order: the first rule that matches at a position wins. Possessive repeats keep the
# search linear on text without spaces. An e-mail address begins where its run of characters
# begins, or where the match before it ended.
DEFAULT_RULES = (
    PatternRule("url", r"https?://[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]+", 0.9, needs="://"),
    PatternRule(
        "email",
        rf"(?:\G|(?<!{_ADDRESS_CHAR})){_ADDRESS_CHAR}++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}",
        0.95,
        needs="@",
    ),
    PatternRule("phone", r"(?:\+[0-9]{1,3} )?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}", 0.8, "[+(]"),
    PatternRule(
        "account number",
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
        0.65,
        _HEX,
    ),
    PatternRule("token", r"[0-9a-f]{40}", 0.8, _HEX),
    PatternRule(OUTSIDE, r"[0-9]++(?:\.[0-9]++){4,}+", 1.0, _DIGIT),
    PatternRule("ip address", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", 0.85, _DIGIT),
    PatternRule("date", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", 0.75, _DIGIT),
    PatternRule("date", r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", 0.6, _DIGIT),
    PatternRule("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.9, _DIGIT),
    PatternRule("phone", r"[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}", 0.8, _DIGIT),
    PatternRule("phone", r"[0-9]{3}-[0-9]{4}", 0.45, _DIGIT),
    PatternRule("credit card", r"[0-9]{4}(?:[ -][0-9]{4}){3}", 0.7, _DIGIT),
    PatternRule(OUTSIDE, r"[0-9]{20,}", 1.0, _DIGIT),
    PatternRule("credit card", r"[0-9]{13,19}", 0.75, _DIGIT),
    PatternRule("account number", r"[0-9]{8,12}", 0.6, _DIGIT),
)


def search_pattern(rules: Sequence[PatternRule]) -> str:
    """One regex that finds the first rule to match.

    Neighbours with the same start share its test, and if all rules have one, a position where none
    of them holds is passed over at once.
    """
    groups = []
    for starts, group in groupby(rules, key=lambda rule: rule.starts):
        one_of = "|".join(f"(?:{rule.pattern})" for rule in group)
        groups.append(f"(?={starts})(?:{one_of})" if starts else one_of)
    pattern = "|".join(groups)
    if all(rule.starts for rule in rules):
        starts = "|".join(dict.fromkeys(rule.starts for rule in rules))
        return f"(?={starts})(?:{pattern})"
    return pattern


@dataclass(frozen=True)
class PatternScorer:
    rules: tuple[PatternRule, ...] = DEFAULT_RULES

    def __post_init__(self) -> None:
        object.__setattr__(self, "rules", tuple(self.rules))

    @property
    def vocabulary(self) -> list[str]:
        return list(dict.fromkeys(rule.label for rule in self.rules))

    def _rule_of(self, hit: Column) -> Column:
        """Number of the rule that found a match: the first that describes all of it."""
        found = F
        for number, rule in enumerate(self.rules):
            found = found.when(hit.rlike(rf"\A(?:{rule.pattern})\z"), number)
        return found

    def _search(self, text: Column, search: Callable[[str], Column]) -> Column:
        """Search for all rules, or only for those that the text can have a match of."""
        needs = sorted({rule.needs for rule in self.rules if rule.needs})
        always = [rule for rule in self.rules if not rule.needs]
        if not needs or not always:
            return search(search_pattern(self.rules))
        demanded = reduce(or_, [F.contains(text, F.lit(literal)) for literal in needs])
        return F.when(demanded, search(search_pattern(self.rules))).otherwise(
            search(search_pattern(always))
        )

    def tokens(self, text: Column) -> Column:
        """``array<struct<start, end, label, score>>`` over the whole text, in bytes.

        Matches and the stretches between them alternate, so the running sum of their lengths gives
        every offset. Text without a match is searched once and is a single ``O`` token.
        """

        labels = F.lit([rule.label for rule in self.rules])
        scores = F.lit([rule.score for rule in self.rules]).cast("array<float>")

        def placed(gaps: Column, hits: Column) -> Column:
            parts = F.zip_with(gaps, hits, lambda gap, hit: F.array(gap, hit))
            sizes = F.transform(F.flatten(parts), lambda part: F.octet_length(part))
            return let(
                running_sum(F.filter(sizes, lambda size: size.isNotNull())),
                lambda ends: F.filter(
                    F.flatten(
                        F.transform(
                            gaps, lambda _, k: F.array(gap_token(ends, k), hit_token(ends, hits, k))
                        )
                    ),
                    # No match follows the last gap.
                    lambda token: token.end.isNotNull(),
                ),
            )

        # Gap k ends the 2k-th stretch of the text, and hit k the one after it.
        def gap_token(ends: Column, k: Column) -> Column:
            return _token(F.coalesce(F.get(ends, k * 2 - 1), F.lit(0)), F.get(ends, k * 2))

        def hit_token(ends: Column, hits: Column, k: Column) -> Column:
            return let(
                self._rule_of(F.get(hits, k)),
                lambda n: _token(
                    F.get(ends, k * 2), F.get(ends, k * 2 + 1), F.get(labels, n), F.get(scores, n)
                ),
            )

        gaps = self._search(text, lambda pattern: F.split(text, pattern, -1))
        return let(
            self._search(text, lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))),
            lambda hits: F.when(
                F.size(hits) == 0, F.array(_token(F.lit(0), F.octet_length(text)))
            ).otherwise(let(gaps, lambda g: placed(g, hits))),
        )


def _token(
    start: Column, end: Column, label: Column | None = None, score: Column | None = None
) -> Column:
    return F.struct(
        start.alias("start"),
        end.alias("end"),
        (F.lit(OUTSIDE) if label is None else label).alias("label"),
        (F.lit(1.0).cast("float") if score is None else score).alias("score"),
    )
