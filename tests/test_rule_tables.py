import pytest
from test_false_positives import GOLDEN

from veilscan.operators.false_positives import rule_table
from veilscan.operators.rule_tables import judge_by_table

SCHEMA = "label string, exact array<string>, patterns array<string>, valid string, min_conf float"
PATHS = pytest.mark.parametrize("plan_rules", [0, 200])


def judged(spark, rows, rules, plan_rules):
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], "k int, label string, text string, score float")
    found = judge_by_table(df, rules, plan_rules=plan_rules)
    assert found.columns == ["k", "label", "text", "score", "rejected"]
    return [row.rejected for row in sorted(found.collect(), key=lambda row: row.k)]


@PATHS
def test_rules_of_a_table_are_those_built_in(spark, plan_rules):
    found = judged(spark, [row[:3] for row in GOLDEN], rule_table(spark), plan_rules)
    assert found == [row[3] for row in GOLDEN]


@PATHS
def test_all_rules_of_a_label_count(spark, plan_rules):
    rules = spark.createDataFrame(
        [
            ("Person", ["acme"], None, None, None),
            ("person", None, ["^dr"], r"\p{L}", 0.5),
            ("PERSON", [], [None, r"\.\z"], "^[^0-9]", None),
            (None, ["bob"], ["b"], None, 1.0),
            ("place", None, None, None, None),
        ],
        SCHEMA,
    )
    rows = [
        ("person", "Acme", 0.9), ("PERSON", "Dr Who", 0.9), ("person", "a.", 0.9), ("person", "1a", 0.9), ("person", "--", 0.9),
        ("person", "bob", 0.4), ("person", "bob", 0.5), ("place", "acme", 0.1), (None, "acme", 0.1), ("person", None, 0.9),
        ("person", "bob", None), ("other", "acme", 0.1),
    ]
    want = [True] * 6 + [False] * 6
    assert judged(spark, rows, rules, plan_rules) == want


@PATHS
def test_empty_tables(spark, plan_rules):
    none = spark.createDataFrame([], SCHEMA)
    assert judged(spark, [("person", "acme", 0.1)] * 2, none, plan_rules) == [False, False]
    assert judged(spark, [], rule_table(spark), plan_rules) == []


def test_names_that_clash(spark):
    df = spark.createDataFrame([("a", "b", 0.5, 1)], "label string, text string, score float, Rejected int")
    with pytest.raises(ValueError, match="rejected"):
        judge_by_table(df, rule_table(spark))
    found = judge_by_table(df, rule_table(spark), out_col="wrong", plan_rules=0)
    assert found.columns == ["label", "text", "score", "Rejected", "wrong"]


def test_many_rules_are_joined(spark):
    """Above the number that a plan takes, and with labels of any case."""
    rows = [(f"Label {k}", [f"word{k}"], [f"^x{k}"], None, None) for k in range(300)]
    rules = spark.createDataFrame(rows, SCHEMA)
    found = judged(spark, [("label 7", "WORD7 ", 0.9), ("LABEL 299", "x299", 0.9), ("label 8", "word7", 0.9)], rules, 200)
    assert found == [True, True, False]
