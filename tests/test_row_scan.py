"""Scans in Arrow batches against the column expressions whose rules they follow."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import queries
from test_plans import SF_DIR, plan
from veilscan import ModelScorer, Scanner, Settings, entity_rows, scan_table
from veilscan.operators import row_scan
from veilscan.operators.chunking import chunk_starts
from veilscan.operators.decoding import distinct_entities
from veilscan.schemas import ENTITY


class Columns:
    """The piece scorer without its batches."""

    vocabulary = queries.PieceScorer.vocabulary
    tokens = queries.PieceScorer.tokens


def some_texts():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzAHOZ  \n.,-0é中😀İK\x01\x7f "
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 400))) for _ in range(120)]
    return texts + [None, "", " ", "\n", "a", "\nabc" * 60, "é" * 200, "abcdefg" * 90, "a b\n" * 100, " " + "x" * 70]


def rows_of(results):
    return sorted(map(tuple, results.collect()), key=repr)


@pytest.mark.parametrize("labels, size, threshold", [((), 50, 0.5), (("Person", "email"), 1000, 0.5), (("DATE",), 4, 0.0), (("O", "person"), 33, 0.9)])
def test_pieces_in_batches_are_those_of_columns(spark, monkeypatch, labels, size, threshold):
    monkeypatch.setattr(row_scan, "PART_BYTES", 500)
    texts = some_texts()
    # Ids come twice, and one is null.
    rows = [(None if k == 5 else k % 100, text) for k, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, t string").repartition(3)
    settings = Settings(max_chunk_size=size, threshold=threshold)
    both = [
        rows_of(scan_table(df, "t", "id", Scanner(labels=labels, settings=settings, scorer=scorer, filters=False)))
        for scorer in (Columns(), queries.PieceScorer())
    ]
    assert both[0] == both[1] and sum(row[3] for row in both[0]) > 100


def test_bytes_that_are_not_utf8(spark):
    rows = [(1, "abc \xff def".encode("latin-1")), (2, b"\xe4\xb8 ab" * 9), (3, b"ok words"), (4, b"\xc3")]
    df = spark.createDataFrame(rows, "id int, b binary").select("id", F.col("b").cast("string").alias("t")).coalesce(1)
    both = [
        scan_table(df, "t", "id", Scanner(labels=(), settings=Settings(max_chunk_size=7), scorer=scorer, filters=False))
        .select("id", "pii_count", "chunks_processed", F.transform("entities", lambda e: F.struct(F.hex(e.text), e.start, e.end)))
        for scorer in (Columns(), queries.PieceScorer())
    ]
    assert rows_of(both[0]) == rows_of(both[1])


def test_cuts(evaluate):
    texts = [text for text in some_texts() if text is not None]
    for size in (4, 7, 50):
        found = evaluate(chunk_starts(F.col("t"), size), [(t,) for t in texts], "t string")
        assert found == [row_scan.chunk_cuts(t.encode(), size) for t in texts]


def test_first_of_equal():
    rng = np.random.default_rng(5)
    for high, low in ((3, 0), (1 << 40, 0), (2, -2)):
        keys = [rng.integers(low, high, 300) // (high // 2 or 1) for _ in range(4)]
        seen, first = set(), []
        for row in zip(*keys):
            first.append(row not in seen)
            seen.add(row)
        assert row_scan.first_of_equal(*keys).tolist() == first
    assert row_scan.first_of_equal(np.empty(0, int), np.empty(0, int)).tolist() == []


@pytest.mark.parametrize("size", [1, 7, 10000])
def test_distinct_rows(spark, size):
    """Documents of any id, cut by batches of any size."""
    rng = random.Random(9)
    some = lambda *of: rng.choice(of)
    rows = [
        (some(1, 2, None), [(some("a", "b", None), some("x", "y", None), 0.5, some(0, 1, 2, None), some(3, 4, None)) for _ in range(rng.randrange(20))])
        for k in range(60)
    ] + [(60, None), (61, []), (62, [("a", "x", 0.5, -64, 0)] * 30 + [("b", "x", 0.25, 1 << 30, (1 << 31) - 1)] * 30)]
    df = spark.createDataFrame(rows, f"id int, entities array<{ENTITY}>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        found = rows_of(row_scan.distinct_rows(entity_rows(df, ["id"])))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == rows_of(entity_rows(df.select("id", distinct_entities(F.col("entities")).alias("entities")), ["id"]))


def odd_scorer(activation):
    """Windows that overlap, with offsets that are out of order, inside code points, or beyond the text."""

    def make_tokenizer():
        def tokenize(text):
            size = len(text.encode())
            at = [(k, k + 2) for k in range(0, size + 2, 2)]
            for begin in range(0, len(at), 5):
                own = [*at[begin : begin + 7], (0, 0)]
                yield [a % 9 for a, _ in own], [1] * (len(own) - 1) + [0], [a % 2 for a, _ in own], own

        return lambda text: list(tokenize(text))

    def make_model():
        def run(ids, mask, types):
            import numpy as np

            assert ids.shape == mask.shape and (types is None or types.shape == ids.shape)
            out = np.zeros((*ids.shape, 4), np.float32)
            out[..., 0] = 0.4
            out[..., 1] = (ids % 3) / 2
            out[..., 2] = np.where(ids == 4, np.nan, (ids % 4) / 3)
            return out

        return run

    return ModelScorer(make_tokenizer, make_model, ["O", "a", "b", "c"], activation)


@pytest.mark.parametrize("activation", ["none", "softmax"])
def test_models_in_batches_are_those_of_chunk_rows(spark, monkeypatch, activation):
    """Windows as lists; entities that come twice are folded."""
    monkeypatch.setattr(row_scan, "PART_BYTES", 300)
    df = spark.createDataFrame(list(enumerate(some_texts())), "id int, t string").repartition(2)
    scorer = odd_scorer(activation)
    both = [
        rows_of(scan_table(df, "t", "id", Scanner(labels=(), settings=Settings(max_chunk_size=40, threshold=0.2, batch_size=3), scorer=scorer, filters=False, spread_chunks=n)))
        for n in (3, None)
    ]
    assert both[0] == both[1] and sum(row[3] for row in both[0]) > 100


def test_windows_of_many_texts_are_those_of_each():
    tokenize = queries.toy_model().make_tokenizer()
    texts = ["", "abcd efg\n" * 60, "é中😀", "", "x", "A1b2" * 100, ""]
    ids, mask, types, spans, lengths, owner = tokenize.many(texts)
    at = 0
    found = [[] for _ in texts]
    for n, k in zip(lengths, owner):
        found[k].append((ids[at : at + n].tolist(), spans[at : at + n].tolist()))
        at += n
    assert found == [[(w[0].tolist(), w[3].tolist()) for w in tokenize(text)] for text in texts]
    assert at == len(ids) == len(mask) == len(types) and max(lengths) == 128
    pieces = found[1][0]
    assert pieces[0][:4] == [21 + ord("a") % 13, 7 + ord("d") % 13, 7 + ord(" ") % 13, 21 + ord("e") % 13]
    assert pieces[1][:3] == [[0, 3], [3, 4], [4, 5]]


@pytest.mark.parametrize("name", ["decode_spans", "dedupe_entities", "top10_per_label", "model_scan"])
def test_dense_tokens_stay_in_the_worker(spark, name):
    """No token or span is made by an interpreted expression, which cost some 1,000 CPU seconds on 0.1 GB."""
    text = plan(queries.all_queries()[name](spark, SF_DIR)).lower()
    assert "arrowevalpython" in text
    for word in ("regexp_extract_all", "is_valid_utf8", "isvalidutf8", "sequence(", "substring("):
        assert word not in text


def test_dense_entities_are_not_sorted_by_expressions(spark):
    text = plan(queries.q_dedupe_entities(spark, SF_DIR))
    assert "sort_array" not in text
    # Arrays of entities don't go to a worker: a batch of them took an executor over 3000 MB on 0.51 GB.
    assert text.split("\n\n")[0].count("ArrowEvalPython") == 1 and "MapInArrow" in text
