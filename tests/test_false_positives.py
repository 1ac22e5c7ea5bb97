import pytest
from pyspark.sql import functions as F

from veilscan.operators.false_positives import (
    DEFAULT_RULES,
    FalsePositiveRule,
    is_false_positive,
    rule_table,
)

KEEP, REJECT = False, True

GOLDEN = [
    ("password", "hunter2", 0.9, KEEP),
    ("password", "password!", 0.9, KEEP),
    ("password", " PASSWORD ", 0.9, REJECT),
    ("password", "mypassword123", 0.9, REJECT),
    ("email", "el.00@mail8.example.com", 0.9, KEEP),
    ("email", "jane.email@x.com", 0.9, REJECT),
    ("email", "a@b.com\n", 0.9, REJECT),
    ("email", "EMAIL", 0.9, REJECT),
    ("EMAIL", "not-an-address", 0.9, REJECT),
    ("email address", "not-an-address", 0.9, KEEP),
    ("phone", "(293) 555-9179", 0.9, KEEP),
    ("phone", "555-9179", 0.9, REJECT),
    ("phone", "iphone15", 0.9, REJECT),
    ("phone", "12345\n67890", 0.9, REJECT),
    ("phone", "my phone 1234567890", 0.9, REJECT),
    ("address", "123 Main St", 0.9, KEEP),
    ("address", "mailing address", 0.9, REJECT),
    ("credit card", "4467920212765298", 0.9, KEEP),
    ("credit card", "4467 9202 1276 5298", 0.9, REJECT),
    ("ssn", "123-45-6789", 0.9, KEEP),
    ("ssn", "123456789", 0.9, KEEP),
    ("ssn", "123 45 6789", 0.9, REJECT),
    ("account number", "12345", 0.59, REJECT),
    ("account number", "12345", 0.6, KEEP),
    ("account number", "0f8fad5b-d9cb-469f-a165-70867728950e", 0.95, REJECT),
    ("ip address", "999.1.1.1", 0.9, KEEP),
    ("ip address", "::1", 0.9, REJECT),
    ("ip address", "us-east-1", 0.9, REJECT),
    ("username", "johnd", 0.9, KEEP),
    ("username", "user_id", 0.9, REJECT),
    ("username", "abc_uuid", 0.9, REJECT),
    ("date", "2024-01-01", 0.69, REJECT),
    ("date", "2024-01-01", 0.7, KEEP),
    ("person", "password", 0.31, KEEP),
    # Digits of any script count, and so does white space of any kind around a stop word.
    ("ssn", "١٢٣-٤٥-٦٧٨٩", 0.9, KEEP),
    ("password", " passwd ", 0.9, REJECT),
]


def verdicts(evaluate, rows, rules=DEFAULT_RULES):
    column = is_false_positive(F.col("label"), F.col("value"), F.col("score"), rules)
    return evaluate(column, rows, "label string, value string, score float")


def test_golden(evaluate):
    found = verdicts(evaluate, [row[:3] for row in GOLDEN])
    assert [(*row[:3], v) for row, v in zip(GOLDEN, found)] == GOLDEN


@pytest.mark.parametrize(
    "rules, expected",
    [
        ((), KEEP),
        ((FalsePositiveRule("person"),), KEEP),
        ((FalsePositiveRule("person", exact=("acme",)),), REJECT),
        ((FalsePositiveRule("Person", exact=("acme",)),), KEEP),
    ],
)
def test_own_rules(evaluate, rules, expected):
    assert verdicts(evaluate, [("PERSON", "Acme", 0.9)], rules) == [expected]


def test_long_values_are_searched_in_linear_time(evaluate):
    assert verdicts(evaluate, [("phone", "1 " * 4 + "a" * 200_000, 0.9)]) == [REJECT]


def test_rule_table(spark):
    rows = rule_table(spark).collect()
    assert len(rows) == 10
    assert {r.label for r in rows if r.min_conf is not None} == {"account number", "date"}
