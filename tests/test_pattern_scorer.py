import dataclasses
import random
import re

from pyspark.sql import functions as F

from veilscan.operators.pattern_scorer import DEFAULT_RULES, PatternRule, PatternScorer


def tokens(evaluate, scorer, texts):
    found = evaluate(scorer.tokens(F.col("t")), [(t,) for t in texts], "t string")
    return [[(t.start, t.end, t.label, round(t.score, 3)) for t in row] for row in found]


def brute(text):
    """All tokens with a portable form of the rules and Python's own engine."""
    rules = [
        (r.label, r.pattern.replace(r"(?:\G|(?<![A-Za-z0-9._%+-]))", "").replace("++", "+"), r.score)
        for r in DEFAULT_RULES
    ]
    out, at = [], 0

    def add(piece, label, score):
        start = out[-1][1] if out else 0
        out.append((start, start + len(piece.encode()), label, score))

    for match in re.finditer("|".join(f"(?:{p})" for _, p, _ in rules), text):
        add(text[at : match.start()], "O", 1.0)
        label, _, score = next(r for r in rules if re.fullmatch(r[1], match.group()))
        add(match.group(), label, score)
        at = match.end()
    add(text[at:], "O", 1.0)
    return out


def test_shapes(evaluate):
    text = "é mail a.b@x.org, call +1 (293) 555-9179 or 555-9179; 10.0.0.1 1.2.3.4.5 4467920212765298"
    (found,) = tokens(evaluate, PatternScorer(), [text])
    data = text.encode()
    assert [(data[s:e].decode(), label) for s, e, label, _ in found if label != "O"] == [
        ("a.b@x.org", "email"),
        ("+1 (293) 555-9179", "phone"),
        ("555-9179", "phone"),
        ("10.0.0.1", "ip address"),
        ("4467920212765298", "credit card"),
    ]
    assert found[0][0] == 0 and found[-1][1] == len(data)
    assert all(a[1] == b[0] for a, b in zip(found, found[1:]))


def test_random_texts_match_brute_force(evaluate):
    rng = random.Random(3)
    parts = [
        "a@b.co", "x@", "@y.org", "1.2.3.4", ".5", "-", " ", "12345678", "555-1234", "(123) 456-7890",
        "123-45-6789", "2024-01-02", "deadbeef" * 5, "é", "\n", "_", "4444 4444 4444 4444", "https://a.b/c",
        "0f8fad5b-d9cb-469f-a165-70867728950e", "q", "99", "1/2/2024", "+1 ",
    ]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 15))) for _ in range(1500)]
    assert tokens(evaluate, PatternScorer(), texts) == [brute(text) for text in texts]


def test_hints_change_nothing(evaluate):
    plain = PatternScorer(tuple(dataclasses.replace(r, starts="", needs="") for r in DEFAULT_RULES))
    texts = ["no match", "a@b.org 12345678", "see https://x.y/z?1", "(123) 456-7890", ""]
    assert tokens(evaluate, plain, texts) == tokens(evaluate, PatternScorer(), texts)


def test_own_rules(evaluate):
    scorer = PatternScorer((PatternRule("order", "ORD-[0-9]+", 0.5, needs="ORD-"),))
    assert tokens(evaluate, scorer, ["ORD-1ORD-22", "none"]) == [
        [(0, 0, "O", 1.0), (0, 5, "order", 0.5), (5, 5, "O", 1.0), (5, 11, "order", 0.5), (11, 11, "O", 1.0)],
        [(0, 4, "O", 1.0)],
    ]
    assert scorer.vocabulary == ["order"]


def test_text_without_spaces_is_searched_in_linear_time(evaluate):
    texts = ["z" * 500_000, "g1" * 200_000 + "@", "1" * 300_000]
    found = tokens(evaluate, PatternScorer(), texts)
    assert [row[-1][1] for row in found] == [500_000, 400_001, 300_000]
