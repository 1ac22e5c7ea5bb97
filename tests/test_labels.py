import pytest
from pyspark.sql import functions as F

from veilscan.functions.labels import (
    LABEL_PACKS,
    distinct_labels,
    find_profile,
    label_packs,
    profile_column,
    resolve_labels,
    unsupported_labels,
)
from veilscan.functions.parsing import parse_bool, parse_float, parse_int, parse_list
from veilscan.settings import Settings


def test_packs(spark):
    assert [len(labels) for labels in LABEL_PACKS.values()] == [13, 40, 13, 13]
    assert label_packs(spark).count() == 79


def test_profile(evaluate):
    names = [" Logs ", "private", "nope", "EXTENDED", None]
    expected = ["log_intelligence", "private_conversation", None, "extended", None]
    assert evaluate(profile_column(F.col("n")), [(n,) for n in names], "n string") == expected
    assert [find_profile(n) for n in names[:4]] == expected[:4]


def test_resolve():
    extended = resolve_labels(extended=True)
    assert len(extended) == 41 and extended[:13] == LABEL_PACKS["default"]
    assert len(resolve_labels(log=True)) == 25
    assert len(resolve_labels(extended=True, private=True, log=True)) == 66
    assert resolve_labels(["Email", "email", "ssn"], extended=True) == ["Email", "ssn"]
    with pytest.raises(ValueError):
        resolve_labels([])


def test_unknown_profile():
    with pytest.warns(UserWarning):
        assert resolve_labels(profile="nope") == LABEL_PACKS["default"]
    with pytest.raises(ValueError):
        resolve_labels(profile="nope", strict=True)


def test_distinct(evaluate):
    rows = [(["B", "a", "b", "A", "c"],), ([],)]
    assert evaluate(distinct_labels(F.col("l")), rows, "l array<string>") == [["B", "a", "c"], []]


def test_unsupported():
    assert unsupported_labels(["Email", "speaker"], ["email", "O"]) == ["speaker"]


def test_parsing(evaluate):
    texts = [(" Yes ",), ("on",), ("1",), ("y",), ("",)]
    assert evaluate(parse_bool(F.col("t")), texts, "t string") == [True, True, True, False, False]
    assert evaluate(parse_list(F.col("t")), [(" a, ,b,,C ",)], "t string") == [["a", "b", "C"]]
    numbers = [(" 12 ",), ("+3",), ("-3",), ("x",), ("1.5",)]
    assert evaluate(parse_int(F.col("t")), numbers, "t string") == [12, 3, None, None, None]
    assert evaluate(parse_float(F.col("t")), numbers, "t string") == [12.0, 3.0, -3.0, None, 1.5]


def test_settings():
    base = Settings()
    assert base == Settings(0.3, 8000, 8, 50.0, True)
    assert base.merged(threshold=0.5, batch_size=None) == Settings(threshold=0.5)
    assert base.merged(filter_false_positives=False).filter_false_positives is False
    for wrong in ({"max_chunk_size": 0}, {"batch_size": 0}):
        with pytest.raises(ValueError):
            base.merged(**wrong)


def test_size_limit_is_a_32_bit_comparison():
    import numpy as np

    for limit in (0.0, 0.001, 0.1, 1.0, 50.0, 333.3):
        edge = Settings(max_file_size_mb=limit).max_file_bytes
        mb = [np.float32(n) / np.float32(1024 * 1024) for n in (edge, edge + 1)]
        assert mb[0] <= np.float32(limit) < mb[1]
