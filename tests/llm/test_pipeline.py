from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.conftest import edited, messy_rows, prose
from tests.llm.test_jaccard_join import brute_force as near_groups
from tests.llm.test_line_dedup import brute_force as line_groups
from tests.llm.test_line_dedup import kept_lines
from veilscan.llm.secret_scan import find_secrets
from veilscan.llm.store import write_table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 70")
    spoken = write_table(P.identify_language(spark, docs, SF), "s")
    assert spoken.columns == docs.columns and spoken.count() == docs.count()
    lines = write_table(P.drop_repeated_lines(spark, spoken, SF), "s")
    rows = [(x.doc_id, x.text) for x in lines.collect()]
    find = line_groups([(x.doc_id, x.text) for x in spoken.collect()])
    assert lines.columns == docs.columns and set(kept_lines(rows, find).values()) == {1}
    near = write_table(P.drop_near_copies(spark, lines, SF), "s")
    assert near.columns == docs.columns
    assert {x.doc_id for x in near.collect()} == {c for _, _, c in near_groups(rows, 5, 80)}
    masked = write_table(P.mask_secrets(spark, near, SF), "s")
    before = {x.doc_id: x.text for x in near.collect()}
    for x in masked.collect():
        assert x.n_chars == len(x.text) and not find_secrets(x.text)
        assert bool(find_secrets(before[x.doc_id])) == (x.text != before[x.doc_id])
    pieces = P.pack_sequences(spark, masked, SF).collect()
    assert {x.doc_id for x in pieces} == set(before)


def test_one_row_of_each_group_of_messy_rows(spark):
    more = [(None, prose(21, 50)), (None, prose(22, 50)), (None, prose(22, 50)), (50, prose(23, 60)), (50, prose(24, 60)), (51, prose(24, 60)), (3, prose(25, 60)), (3, edited(prose(23, 60), 59))]
    rows = [x[:2] for x in messy_rows()] + more
    docs = spark.createDataFrame([(*x, None, "s", None) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    groups = {}
    for (k, _, c), (doc_id, text) in zip(sorted(near_groups([(k, x[1]) for k, x in enumerate(rows)], 5, 80)), rows, strict=True):
        groups.setdefault(c, []).append((doc_id is None, doc_id or 0))
    got = P.drop_near_copies(spark, docs, SF).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in got) == sorted(map(min, groups.values()))
    kept = near_groups([(k, x.text) for k, x in enumerate(got)], 5, 80)
    assert all(k == c for k, _, c in kept)


def test_copies_do_not_reach_packing(spark):
    text = prose(31, 80)
    docs = spark.createDataFrame([(k, text, "en", "s", None) for k in (1, 1, 2, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[:-1]:
        docs = write_table(stage(spark, docs, SF), "c")
    assert [x.text for x in docs.collect()] == [text]


def test_documents_stay_where_no_language_is_known(spark, messy):
    got = P.identify_language(spark, messy.withColumn("lang", F.lit(None).cast("string")), SF).collect()
    assert sorted(x.text for x in got) == sorted(x[1] for x in messy_rows() if any(map(str.isalpha, x[1] or "")))
    assert {x.lang for x in got} == {"und"} and all(x.n_chars == len(x.text) for x in got)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = write_table(stage(spark, docs, SF), "e")
    assert docs.count() == 0


def test_run(spark):
    assert P.run(spark, SF).count() > 100
