import math
import random

import pytest
from pyspark.sql import functions as F

from veilscan.functions.columns import running_sum
from veilscan.operators.decoding import (
    best_label,
    chunk_entities,
    distinct_entities,
    label_allowed,
    label_name,
    merge_tokens,
)
from veilscan.schemas import ENTITY, TOKEN
from veilscan.settings import Settings

TOKENS = f"tokens array<{TOKEN}>"


def imperative(tokens, labels, threshold):
    """The token automaton, one token after the other."""
    done, current = [], None
    for start, end, label, score in tokens:
        if end <= start or label is None:
            continue
        if label != "O" and labels and label.lower() not in {x.lower() for x in labels}:
            continue
        if label == "O" or score < threshold:
            if current:
                done.append(tuple(current))
            current = None
            continue
        if current and current[0] == label and current[2] == start:
            current[2], current[3] = end, max(current[3], score)
            continue
        if current:
            done.append(tuple(current))
        current = [label, start, end, score]
    return done + ([tuple(current)] if current else [])


def test_golden(evaluate):
    # Padding is dropped by the scorer, so its token is not part of the input.
    tokens = [
        (0, 0, "person", 0.9), (0, 4, "person", 0.9), (4, 6, "person", 0.5), (6, 7, "O", 0.8),
        (7, 10, "email", 0.4), (10, 11, "date", 0.9), (11, 14, "email", 0.9), (14, 16, "email", 0.1),
        (16, 18, "person", 0.3),
    ]
    text = "abcdefghijklmnopqrst"
    column = chunk_entities(
        F.col("tokens"), F.lit(text), F.lit(100), ["person", "email"],
        Settings(filter_false_positives=False),
    )
    (found,) = evaluate(column, [(tokens,)], TOKENS)
    assert [(e.text, e.label, e.start, e.end, round(e.score, 3)) for e in found] == [
        ("abcdef", "person", 100, 106, 0.9),
        ("hij", "email", 107, 110, 0.4),
        ("lmn", "email", 111, 114, 0.9),
        ("qr", "person", 116, 118, 0.3),
    ]


@pytest.mark.parametrize("labels", [[], ["Person", "email"]])
def test_random_tokens(evaluate, labels):
    rng = random.Random(7)
    rows = []
    for _ in range(400):
        tokens, at = [], 0
        for _ in range(rng.randrange(0, 30)):
            at += rng.choice([0, 0, 0, 1])
            end = at + rng.choice([0, 1, 2])
            label = rng.choice(["person", "person", "email", "date", "O", None])
            tokens.append((at, end, label, rng.choice([0.125, 0.25, 0.5, 0.75])))
            at = end
        rows.append((tokens,))
    found = evaluate(merge_tokens(F.col("tokens"), labels, 0.25), rows, TOKENS)
    assert [[tuple(s) for s in spans] for spans in found] == [
        imperative(tokens, labels, 0.25) for (tokens,) in rows
    ]


def test_policy_beats_setting(evaluate):
    tokens = [(0, 5, "email", 0.9)]

    def found(policy, setting):
        column = chunk_entities(
            F.col("tokens"), F.lit("EMAIL"), F.lit(0), [],
            Settings(filter_false_positives=setting), filters=policy,
        )
        return len(evaluate(column, [(tokens,)], TOKENS)[0])

    assert [found(True, True), found(True, False), found(False, True)] == [0, 1, 1]


def test_span_off_code_points_has_no_text(evaluate):
    tokens = [(0, 1, "person", 0.9), (2, 4, "email", 0.9), (3, 99, "person", 0.9)]
    column = chunk_entities(F.col("tokens"), F.lit("éab"), F.lit(0), [], Settings(), filters=False)
    (found,) = evaluate(column, [(tokens,)], TOKENS)
    assert [e.text for e in found] == ["", "ab", ""]


def test_distinct_entities(evaluate):
    entities = [
        ("b", "x", 0.5, 4, 6), ("a", "x", 0.4, 0, 2), ("a", "x", 0.9, 0, 2), ("a", "y", 0.9, 0, 2),
        ("b", "x", 0.6, 4, 6),
    ]
    (found,) = evaluate(distinct_entities(F.col("e")), [(entities,)], f"e array<{ENTITY}>")
    assert [(e.label, e.start, round(e.score, 2)) for e in found] == [
        ("x", 4, 0.5), ("x", 0, 0.4), ("y", 0, 0.9),
    ]


def test_best_label(evaluate):
    nan = math.nan
    rows = [([0.1, nan, 0.5],), ([0.5, 0.5, 0.1],), ([nan, nan],), ([],), ([-math.inf, -2.0],)]
    found = evaluate(best_label(F.col("s")), rows, "s array<float>")
    assert [b.idx for b in found] == [2, 0, 0, 0, 1]
    assert found[2].score == pytest.approx(-3.4028235e38)


def test_labels(evaluate):
    assert evaluate(label_name(F.col("i"), ["a", "b"]), [(0,), (1,), (2,)], "i int") == ["a", "b", None]
    rows = [("EMAIL",), ("ssn",), ("Key",)]  # the Kelvin sign is no ASCII letter
    assert evaluate(label_allowed(F.col("l"), ["Email", "key"]), rows, "l string") == [True, False, False]
    assert evaluate(label_allowed(F.col("l"), []), rows, "l string") == [True] * 3


def test_running_sum(evaluate):
    rows = [([],), ([5],), (list(range(200)),), ([1] * 64,), ([1] * 65,)]
    found = evaluate(running_sum(F.col("v")), rows, "v array<int>")
    assert found == [[sum(v[: i + 1]) for i in range(len(v))] for (v,) in rows]
