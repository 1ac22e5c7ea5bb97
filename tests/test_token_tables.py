import random

import pytest
from pyspark.sql import functions as F

from veilscan.operators.decoding import merge_tokens
from veilscan.operators.token_tables import merge_token_rows

SCHEMA = "doc string, idx int, place int, start int, end int, label string, score float"


def rows(seed, docs=4, tokens=60):
    r = random.Random(seed)
    out = []
    for doc in [None, *map(str, range(docs))]:
        for idx in range(2):
            at = 0
            for place in range(tokens):
                size = r.choice([0, 1, 1, 2, 3])
                gap = r.choice([0, 0, 0, 1])
                label = r.choices(["person", "Person", "email", "date", "O", None], [8, 1, 2, 1, 1, 1])[0]
                out.append((doc, idx, place, at + gap, at + gap + size, label, r.choice([0.2, 0.5, 0.9, float("nan")])))
                at += gap + size
    return out


def expected(spark, data, labels, threshold):
    df = spark.createDataFrame(data, SCHEMA)
    token = F.struct("place", "start", "end", "label", "score")
    chunks = df.groupBy("doc", "idx").agg(F.sort_array(F.collect_list(token)).alias("tokens"))
    spans = chunks.select("doc", "idx", F.explode(merge_tokens(F.col("tokens"), labels, threshold)).alias("s"))
    return sorted(map(str, spans.select("doc", "idx", "s.label", "s.start", "s.end", "s.score").collect()))


@pytest.mark.parametrize("partitions", [None, 1, 7, 40])
def test_spans_are_those_of_arrays(spark, partitions):
    for seed, labels in ((1, ()), (2, ("PERSON", "date"))):
        data = rows(seed)
        df = spark.createDataFrame(data, SCHEMA).repartition(5)
        got = merge_token_rows(df, ["doc", "idx"], "place", labels, 0.5, partitions)
        assert sorted(map(str, got.collect())) == expected(spark, data, labels, 0.5)


def test_one_span_over_many_ranges(spark):
    data = [("a", 0, k, k, k + 1, "person", 0.5 + k % 7 / 20) for k in range(500)] + [("b", 0, 0, 500, 501, "person", 0.9)]
    got = merge_token_rows(spark.createDataFrame(data, SCHEMA), ["doc", "idx"], "place", (), 0.5, 20)
    assert sorted(tuple(x)[:5] for x in got.collect()) == [("a", 0, "person", 0, 500), ("b", 0, "person", 500, 501)]


def test_a_chunk_uses_many_tasks(spark):
    data = [("a", 0, k, k, k + 1, "person" if k % 3 else "O", 0.9) for k in range(3000)]
    df = spark.createDataFrame(data, SCHEMA)
    ranges = df.repartitionByRange(8, "doc", "idx", "place").groupBy(F.spark_partition_id()).count().count()
    got = merge_token_rows(df, ["doc", "idx"], "place", (), 0.5, 8)
    assert ranges == 8 and got.count() == 1000


def test_empty_and_clash(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merge_token_rows(none, ["doc"], "place", (), 0.5).collect() == []
    with pytest.raises(ValueError, match="Rename"):
        merge_token_rows(none.withColumnRenamed("doc", "_hit"), ["_hit"], "place", (), 0.5)
