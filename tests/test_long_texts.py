import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilscan.operators.chunking import chunk_text
from veilscan.operators.long_texts import chunk_long_texts, next_cuts

PARTS = ["a", "bc", " ", "\n", "é", "中", "😀", "word ", "\n\n", "  ", "x" * 30, "é" * 20]


def texts(seed, n):
    r = random.Random(seed)
    out = ["".join(r.choices(PARTS, k=r.randrange(0, 400))) for _ in range(n)]
    return [*out, None, "", " ", "x" * 3000, "中" * 1000, "\n" * 500, " " * 700, "a\n" + "b" * 900 + "\n" + "c d" * 300]


def chunks(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("size,block", [(7, 7), (16, 50), (40, 41), (64, 1000), (9, 8192)])
def test_chunks_are_those_of_a_row(spark, size, block):
    values = texts(size, 60)
    rows = [(k % 50 if k % 9 else None, "b", text) for k, text in enumerate(values)] + [(3, "b", values[3])] * 2
    df = spark.createDataFrame(rows, "id int, kind string, t string").repartition(4)
    want = df.filter("t is not null").select("id", "kind", F.inline(chunk_text(F.col("t"), size)))
    assert chunks(chunk_long_texts(df, ["id", "kind"], "t", size, block)) == chunks(want)


def test_next_cut_of_every_byte():
    size, r = 11, random.Random(4)
    data = "".join(r.choices(PARTS, k=300)).encode()
    cuts = next_cuts(np.frombuffer(data, np.uint8), len(data), size, len(data))
    for at in range(len(data)):
        window = data[at : at + size]
        newline, space = window.rfind(b"\n") + 1, window.rfind(b" ") + 1
        end = at + size
        if len(data) - at <= size:
            end = len(data)
        elif newline > 1:
            end = at + newline
        elif newline == 0 and space > 1:
            end = at + space
        else:
            end = next((end - k for k in range(3) if data[end - k] & 0xC0 != 0x80), end - 3)
        assert cuts[at] == end


def test_one_text_uses_many_tasks(spark):
    text = "".join(random.Random(1).choices(PARTS, k=400_000))
    df = spark.createDataFrame([(1, text)], "id int, t string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # they are small here
    try:
        rows = chunk_long_texts(df, ["id"], "t", 2000, 1 << 16).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "".join(x.text for x in sorted(rows, key=lambda x: x.chunk_idx)) == text
    assert len({x.task for x in rows}) >= 4
    assert rows and sorted(x.chunk_idx for x in rows) == list(range(len(rows)))


def test_empty_and_arguments(spark):
    none = spark.createDataFrame([], "id int, t string")
    assert chunk_long_texts(none, ["id"], "t", 100).collect() == []
    with pytest.raises(ValueError, match="block"):
        chunk_long_texts(none, ["id"], "t", 100, 50)
    with pytest.raises(ValueError, match="Rename"):
        chunk_long_texts(none.withColumnRenamed("id", "_row"), ["_row"], "t", 100)
