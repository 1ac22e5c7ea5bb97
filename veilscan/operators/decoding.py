"""From scored tokens to entities.

Tokens are an ordered ``array<struct<start, end, label, score>>`` with byte offsets in their chunk.
Adjacent tokens of one label become one span. ``O`` and tokens under the threshold close the open
span; tokens of labels nobody asked for are looked through, as are tokens without a label or width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.columns import ascii_lower, let, utf8_slice
from veilscan.operators.false_positives import DEFAULT_RULES, FalsePositiveRule, is_false_positive
from veilscan.operators.pattern_scorer import OUTSIDE
from veilscan.settings import Settings


def best_label(scores: Column) -> Column:
    """``struct<idx, score>`` of the first maximum; NaN never wins.

    Without any number the index is 0 and the score the lowest 32-bit float.
    """
    lowest = F.lit(-3.4028234663852886e38).cast("float")
    best = F.coalesce(
        F.array_max(F.filter(scores, lambda score: ~F.isnan(score) & (score > lowest))), lowest
    )
    return let(
        best,
        lambda score: F.struct(
            F.greatest(F.array_position(scores, score).cast("int") - F.lit(1), F.lit(0)).alias("idx"),
            score.alias("score"),
        ),
    )


def label_name(idx: Column, vocabulary: Sequence[str]) -> Column:
    """Label of a vocabulary index, NULL outside the vocabulary."""
    return F.get(F.lit(list(vocabulary)), idx)


def label_allowed(label: Column, labels: Sequence[str]) -> Column:
    """Whether a label was asked for, ignoring the case of ASCII letters; no labels means all."""
    if not labels:
        return F.lit(True)
    wanted = sorted({name.translate(_ASCII_LOWER) for name in labels})
    return ascii_lower(label).isin(wanted)


_ASCII_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}


def is_weak(score: Column, threshold: float) -> Column:
    """Whether a score is under the threshold, compared as 32-bit floats."""
    return score < F.lit(threshold).cast("float")


def is_scored(token: Column) -> Column:
    """Whether a token has a width and a label of the vocabulary."""
    return (token.end > token.start) & token.label.isNotNull()


def merge_tokens(
    tokens: Column, labels: Sequence[str], threshold: float
) -> Column:
    """Spans of one chunk as ``array<struct<label, start, end, score>>``, linear in the tokens."""

    def is_hit(token: Column) -> Column:
        return (token.label != OUTSIDE) & ~is_weak(token.score, threshold)

    def spans(seen: Column) -> Column:
        def extends(token: Column, i: Column) -> Column:
            before = F.get(seen, i - F.lit(1))
            return F.coalesce(
                is_hit(token)
                & is_hit(before)
                & (before.label == token.label)
                & (before.end == token.start),
                F.lit(False),
            )

        # Index of every token that opens a span or is a breaker; a span reaches up to the next one.
        borders = F.filter(
            F.transform(seen, lambda token, i: F.when(~extends(token, i), i)),
            lambda i: i.isNotNull(),
        )

        def span(at: Column, first: Column, until: Column) -> Column:
            score = F.array_max(
                F.transform(F.slice(seen, at + F.lit(1), until - at), lambda token: token.score)
            )
            return F.struct(
                first.label.alias("label"),
                first.start.alias("start"),
                F.get(seen, until - F.lit(1)).end.alias("end"),
                score.alias("score"),
            )

        def span_or_null(borders: Column, at: Column, k: Column) -> Column:
            first = F.get(seen, at)
            until = F.coalesce(F.get(borders, k + F.lit(1)), F.size(seen))
            return F.when(is_hit(first), span(at, first, until))

        return let(
            borders,
            lambda b: F.filter(
                F.transform(b, lambda at, k: span_or_null(b, at, k)), lambda s: s.isNotNull()
            ),
        )

    seen = F.filter(
        tokens,
        lambda token: is_scored(token)
        & ((token.label == OUTSIDE) | label_allowed(token.label, labels)),
    )
    return let(seen, spans)


def distinct_entities(entities: Column) -> Column:
    """The first entity of each ``(start, end, label)``, in order."""

    def first_of_run(ranked: Column) -> Column:
        def repeats(row: Column, i: Column) -> Column:
            before = F.get(ranked, i - F.lit(1))
            return F.coalesce(
                (before.start == row.start)
                & (before.end == row.end)
                & (before.label == row.label),
                F.lit(False),
            )

        return F.filter(ranked, lambda row, i: ~repeats(row, i))

    ranked = F.sort_array(
        F.transform(
            entities,
            lambda e, i: F.struct(
                e.start.alias("start"), e.end.alias("end"), e.label.alias("label"), i.alias("i"),
                e.alias("entity"),
            ),
        )
    )
    in_order = F.sort_array(
        F.transform(
            let(ranked, first_of_run), lambda r: F.struct(r.i.alias("i"), r.entity.alias("entity"))
        )
    )
    # Tokens come in order as a rule, and entities whose starts rise have nothing to fold.
    falls = F.filter(
        entities, lambda e, i: F.get(entities, i - F.lit(1)).start >= e.start
    )
    return F.when(F.size(falls) == 0, entities).otherwise(
        F.transform(in_order, lambda r: r.entity)
    )


def chunk_entities(
    tokens: Column,
    text: Column,
    offset: Column,
    labels: Sequence[str],
    settings: Settings,
    filters: bool = True,
    rules: Sequence[FalsePositiveRule] = DEFAULT_RULES,
) -> Column:
    """Entities of one chunk with offsets in the document."""
    spans = merge_tokens(tokens, labels, settings.threshold)
    return span_entities(spans, text, offset, settings, filters, rules)


def span_entities(
    spans: Column,
    text: Column,
    offset: Column,
    settings: Settings,
    filters: bool = True,
    rules: Sequence[FalsePositiveRule] = DEFAULT_RULES,
) -> Column:
    """Entities of one chunk's spans.

    ``filters`` is the policy of the scanner: switched off, no setting of a request turns the
    false-positive filters on.
    """

    def sliced(spans: Column) -> Column:
        return let(
            text.cast("binary"),
            lambda data: F.transform(
                spans,
                lambda s: F.struct(
                    utf8_slice(data, s.start, s.end).alias("text"),
                    s.label.alias("label"),
                    s.score.alias("score"),
                    (s.start + offset).alias("start"),
                    (s.end + offset).alias("end"),
                ),
            ),
        )

    def kept(entities: Column) -> Column:
        if not (filters and settings.filter_false_positives):
            return entities
        return F.filter(
            entities, lambda e: ~is_false_positive(e.label, e.text, e.score, rules)
        )

    return let(spans, lambda s: let(kept(sliced(s)), distinct_entities))
