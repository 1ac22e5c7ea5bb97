"""Queries over the given tables, one per operator; each takes ``(spark, sf_dir)``."""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import oracle
from veilscan import (
    ModelScorer,
    Scanner,
    Settings,
    entity_rows,
    label_packs,
    merge_settings,
    report,
    report_rows,
    scan_directory,
    scan_stream,
    scan_table,
    summarise,
    write_response,
)
from veilscan.functions.columns import compute_once, is_blank, let, running_sum
from veilscan.functions.labels import (
    LABEL_PACKS,
    distinct_labels,
    profile_column,
    resolve_labels_column,
    unsupported_labels_column,
)
from veilscan.functions.parsing import parse_bool, parse_float, parse_int, parse_list
from veilscan.operators import false_positives as fp
from veilscan.operators.chunking import chunk_starts, chunk_text
from veilscan.operators.decoding import (
    best_label,
    is_scored,
    is_weak,
    label_allowed,
    label_name,
)
from veilscan.operators.gates import is_text_path
from veilscan.operators.long_texts import chunk_long_texts
from veilscan.operators.row_scan import Merger, distinct_rows
from veilscan.operators.rule_tables import judge_by_table
from veilscan.operators.token_tables import merge_token_rows
from veilscan.plans.report import confidence_band, count_labels, count_statuses
from veilscan.plans.scan import gate_table
from veilscan.sources.files import decode_bytes
from veilscan.sources.listing import absolute, write_file
from veilscan.sources.shared import shared_folder
from veilscan.sources.sinks import result_json

SCANNER = Scanner.for_request(log=True)
WHOLE_FILE = 2_000_000_000


class PieceScorer:
    """Scores short pieces of words by their letters, so that every decoding rule comes up."""

    vocabulary = ["person", "email", "date", "O"]

    def tokens(self, text: Column) -> Column:
        def scored(pieces: Column) -> Column:
            return let(
                running_sum(F.transform(pieces, F.octet_length)),
                lambda ends: F.transform(pieces, lambda p, i: token(p, F.get(ends, i))),
            )

        def token(piece: Column, end: Column) -> Column:
            return let(
                F.struct(
                    F.octet_length(piece).alias("size"), F.ascii(F.lower(piece)).alias("first")
                ),
                lambda p: F.struct(
                    (end - p.size).alias("start"),
                    end.alias("end"),
                    label(p.first, p.size).alias("label"),
                    F.get(scores, p.size).alias("score"),
                ),
            )

        def label(first: Column, size: Column) -> Column:
            return (
                F.when((first >= ord("a")) & (first <= ord("g")), "person")
                .when((first >= ord("h")) & (first <= ord("n")), "email")
                .when((first >= ord("o")) & (first <= ord("t")), "date")
                .when((first >= ord("!")) & (first <= ord("~")), "O")
                .when(size > 1, "person")
            )

        # By the size of a piece in bytes.
        scores = F.lit([0.0, 0.2, 0.55, 0.9, 0.9]).cast("array<float>")
        pieces = F.regexp_extract_all(text, F.lit("[A-Za-z]{1,3}|[^A-Za-z]"), F.lit(0))
        return let(pieces, scored)

    def finder(self, labels, settings):
        """The spans of the same tokens, of many chunks at a time."""
        vocabulary, labels, threshold = self.vocabulary, tuple(labels), settings.threshold

        def make_finder():
            import numpy as np

            merge = Merger(vocabulary, labels, threshold)
            letter = np.zeros(256, bool)
            label = np.full(256, -1, np.int8)  # by the first byte of a piece
            label[ord("!") : ord("~") + 1] = vocabulary.index("O")
            for name, letters in ("person", "abcdefg"), ("email", "hijklmn"), ("date", "opqrst"):
                label[[ord(c) for c in letters + letters.upper()]] = vocabulary.index(name)
            label[0x80:] = vocabulary.index("person")
            letter[[ord(c) for c in string.ascii_letters]] = True
            # Letters beyond ASCII that are one of it in lower case.
            lowered = [(c.encode(), label[ord(c.lower()[0])]) for c in "\u0130\u212a"]
            scores = np.array([0.0, 0.2, 0.55, 0.9, 0.9], np.float32)

            def find_some(data, begins):
                """Spans of the chunks that begin there."""
                own, begin = letter[data], begins[begins < len(data)]
                fresh = own.copy()
                fresh[1:] &= ~own[:-1]
                fresh[begin] = own[begin]
                place = np.arange(len(data), dtype=np.int32)
                since = place - np.maximum.accumulate(np.where(fresh, place, 0))
                start = np.flatnonzero(np.where(own, since % 3 == 0, (data & 0xC0) != 0x80))
                size = np.diff(start, append=len(data))
                first = data[start]
                idx = label[first]
                for code, kind in lowered:
                    at = np.flatnonzero(first == code[0])
                    same = size[at] == len(code)
                    for k in range(1, len(code)):
                        same &= data[start[at] + k] == code[k]
                    idx[at[same]] = kind
                count = np.diff(np.searchsorted(start, begins), append=len(start))
                chunk = np.repeat(np.arange(len(begins)), count)
                start = start - begins[chunk]
                return merge([start, start + size, idx, scores[size]], chunk)

            def find(data, bounds):
                at, last = 0, len(bounds) - 1
                while at < last:
                    until = min(max(at + 1, int(np.searchsorted(bounds, bounds[at] + (1 << 17)))), last)
                    found = find_some(data[bounds[at] : bounds[until]], bounds[at:until] - bounds[at])
                    yield [found[0] + at, *found[1:]]
                    at = until

            return find

        return make_finder


PIECES = Scanner(
    labels=("Person", "email"),
    settings=Settings(max_chunk_size=1000),
    scorer=PieceScorer(),
    filters=False,
)


def toy_model() -> ModelScorer:
    """A tokenizer and a model small enough to be stated in SQL, in the form of real ones."""

    def make_tokenizer():
        import numpy as np

        def many(texts: list[str]):
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            begins = np.cumsum([0, *map(len, texts)])
            letter = (points | 32) - np.uint32(ord("a")) < 26
            fresh = letter.copy()  # where a run of letters begins
            fresh[1:] &= ~letter[:-1]
            begin = begins[begins < len(points)]
            fresh[begin] = letter[begin]
            place = np.arange(len(points))
            since = place - np.maximum.accumulate(np.where(fresh, place, 0))
            first = np.flatnonzero(~letter | (since % 3 == 0))
            widths = np.ones(len(points), np.int64)
            for most in (0x7F, 0x7FF, 0xFFFF) if len(points) and points.max() > 0x7F else ():
                widths += points > most
            at = np.concatenate([[0], np.cumsum(widths)])
            start = at[first]
            size = np.diff(start, append=at[-1])
            # Tokens, windows and bytes by text.
            tokens = np.diff(np.searchsorted(first, begins))
            count = -(-tokens // 128)
            owner = np.repeat(np.arange(len(texts)), count)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            start = start - np.repeat(at[begins[:-1]], tokens)
            ids = size * 7 + points[first] % 13
            lengths = np.minimum(tokens[owner] - number * 128, 128)
            return ids, np.ones_like(ids), np.zeros_like(ids), np.stack([start, start + size], axis=1), lengths, owner

        def windows(text: str):
            *columns, lengths, _ = many([text])
            ends = np.cumsum(lengths)
            return [tuple(x[end - n : end] for x in columns) for end, n in zip(ends, lengths)]

        windows.many = many
        return windows

    def make_model():
        import numpy as np

        weights = np.array([3, 4, 5, 6])

        def run(ids, mask, types):
            return ((ids[:, :, None] * weights) % 11).astype(np.float32) / np.float32(11)

        return run

    return ModelScorer(make_tokenizer, make_model, ["O", "person", "email", "date"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _spread(spark, scanner):
    """Rows are dealt out over the cores, whatever the size of the table."""
    return replace(scanner, partitions=spark.sparkContext.defaultParallelism)


def _dealt(df):
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _scan_documents(spark, sf_dir, scanner=SCANNER):
    return scan_table(_documents(spark, sf_dir), "text", "doc_id", _spread(spark, scanner))


def _scan_pages(spark, sf_dir, scanner=SCANNER):
    return scan_table(table(spark, sf_dir, "pages"), "html", "page_id", _spread(spark, scanner))


def _orders(spark, sf_dir, **columns: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    derived = orders.select("o_orderkey", *[F.expr(e).alias(n) for n, e in columns.items()])
    return _dealt(derived)


def _flat(results: DataFrame, key: str) -> DataFrame:
    found = F.array_join(
        F.transform(
            "entities",
            lambda e: F.concat(
                e.label, F.lit(":"), e.start.cast("string"), F.lit("-"), e.end.cast("string"),
                F.lit(":"), e.text,
            ),
        ),
        "; ",
    )
    return results.select(
        key, "status", "pii_count", "file_size_bytes", "chunks_processed", found.alias("found")
    )


# Labels and settings of requests, which are derived from the orders


def q_label_packs(spark, sf_dir):
    counts = count_labels(_scan_documents(spark, sf_dir))
    # The counts have at most one row per label of the scorer.
    packs = label_packs(spark).join(F.broadcast(counts), "label", "left")
    return packs.select("profile", "pos", "label", F.coalesce("entities", F.lit(0)).alias("entities"))


def q_profile_lookup(spark, sf_dir):
    requests = _orders(spark, sf_dir, name=oracle.REQUEST_NAME)
    return requests.withColumn("profile", profile_column(F.col("name")))


def _label_requests(spark, sf_dir):
    requests = _orders(
        spark,
        sf_dir,
        name=oracle.REQUEST_NAME,
        custom=f"CASE WHEN o_orderkey % 7 = 0 THEN split({oracle.REQUEST_LIST}, ',') "
        "WHEN o_orderkey % 7 = 1 THEN CAST(array() AS ARRAY<STRING>) END",
        ext="o_orderkey % 2 = 0",
        priv="o_orderkey % 3 = 0",
        lg="o_orderkey % 5 = 0",
    )
    labels = resolve_labels_column(*map(F.col, ("custom", "name", "ext", "priv", "lg")))
    return compute_once(requests, resolved=labels)


def q_resolve_labels(spark, sf_dir):
    return _label_requests(spark, sf_dir).select(
        "o_orderkey",
        F.array_join("resolved", "|").alias("labels"),
        F.when(F.col("resolved").isNotNull(), F.size("resolved")).cast("bigint").alias("n_labels"),
    )


def q_dedupe_labels(spark, sf_dir):
    lists = _orders(spark, sf_dir, l=f"split({oracle.REQUEST_LIST}, ',')")
    return lists.select("o_orderkey", F.array_join(distinct_labels(F.col("l")), "|").alias("labels"))


def q_parse_label_list(spark, sf_dir):
    lists = _orders(spark, sf_dir, l=oracle.REQUEST_LIST)
    return lists.select("o_orderkey", F.array_join(parse_list(F.col("l")), "|").alias("labels"))


def q_parse_bool(spark, sf_dir):
    texts = _orders(spark, sf_dir, t=oracle.BOOL_TEXT)
    return texts.select("o_orderkey", parse_bool(F.col("t")).alias("flag"))


def q_parse_numbers(spark, sf_dir):
    texts = _orders(spark, sf_dir, t=oracle.NUMBER_TEXT)
    return texts.select(
        "o_orderkey",
        parse_int(F.col("t")).alias("whole"),
        parse_float(F.col("t")).cast("double").alias("number"),
    )


def q_settings_merge(spark, sf_dir):
    requests = _orders(
        spark,
        sf_dir,
        threshold="CASE WHEN o_orderkey % 3 = 0 THEN CAST((o_orderkey % 100) / 100 AS FLOAT) END",
        chunk_size="CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 5000 + 4 AS INT) END",
        batch_size="CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 64 + 1 AS INT) END",
        max_file_size="CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 200 AS FLOAT) END",
        filter_false_positives="CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 = 0 END",
    )
    merged = merge_settings(requests)
    return merged.select(
        "o_orderkey",
        F.round(F.col("threshold") * 100).cast("int").alias("threshold_pct"),
        "chunk_size",
        "batch_size",
        F.col("max_file_size").cast("double").alias("max_file_size"),
        "filter_false_positives",
    )


# Gates and bytes


def q_ext_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", is_text_path(F.col("url")).alias("is_text"))


def q_size_gate(spark, sf_dir):
    gated = gate_table(_documents(spark, sf_dir), "text", ["doc_id"], Settings(max_file_size_mb=0.002))
    return gated.select("doc_id", "status", "error")


def q_empty_gate(spark, sf_dir):
    lines = _documents(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("lines"))
    bare = F.transform("lines", lambda line: F.regexp_replace(line, "[A-Za-z.,]", ""))
    return lines.select(
        "doc_id",
        F.size("lines").cast("bigint").alias("lines"),
        F.size(F.filter(bare, is_blank)).cast("bigint").alias("blank_lines"),
    )


def q_decode_bytes(spark, sf_dir):
    text, kind = F.col("text"), F.col("doc_id") % 4
    latin = F.regexp_replace(text, r"[^\x{00}-\x{FF}]", "?")
    content = (
        F.when(kind == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
        .when(kind == 2, F.encode(latin, "ISO-8859-1"))
        .when(kind == 3, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))
        .otherwise(F.encode(text, "UTF-8"))
    )
    files = _documents(spark, sf_dir).select("doc_id", content.alias("content"))
    return files.select("doc_id", F.md5(decode_bytes(F.col("content"))).alias("text_md5"))


# Chunks, tokens, spans and entities


def _chunk_rows(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    return df.select(key, F.inline(chunk_text(F.col(text), size)))


def _chunk_digest(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(
        key,
        "chunk_idx",
        "offset",
        F.octet_length("text").alias("bytes"),
        F.md5("text").alias("text_md5"),
    )


def q_chunk_text(spark, sf_dir):
    return _chunk_digest(_chunk_rows(_documents(spark, sf_dir), "doc_id", "text", 512), "doc_id")


def q_chunk_pages(spark, sf_dir):
    return _chunk_digest(
        _chunk_rows(table(spark, sf_dir, "pages"), "page_id", "html", 8000), "page_id"
    )


def q_chunk_blocks(spark, sf_dir):
    """The chunks of chunk_pages, of which longer pages are cut in blocks by many tasks."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("body"))
    chunks = chunk_long_texts(pages.filter("body is not null"), ["page_id"], "body", 256, 512)
    return _chunk_digest(chunks, "page_id")


def q_chunk_count(spark, sf_dir):
    starts = chunk_starts(F.col("text"), 2000)
    return _documents(spark, sf_dir).select("doc_id", F.size(starts).alias("chunks"))


def q_tokenise(spark, sf_dir):
    chunks = _chunk_rows(_dealt(_documents(spark, sf_dir)), "doc_id", "text", 8000)
    tokens = chunks.select(
        "doc_id", "chunk_idx", "offset", F.inline(SCANNER.scorer.tokens(F.col("text")))
    )
    return tokens.select(
        "doc_id",
        "chunk_idx",
        (F.col("offset") + F.col("start")).alias("token_start"),
        (F.col("offset") + F.col("end")).alias("token_end"),
        "label",
        # As the decimal that the 32-bit score prints as.
        F.col("score").cast("string").cast("double").alias("score"),
    )


def _piece_tokens(spark, sf_dir) -> DataFrame:
    chunks = _chunk_rows(_dealt(_documents(spark, sf_dir)), "doc_id", "text", 1000)
    return compute_once(
        chunks.select("doc_id", "text"), tokens=PIECES.scorer.tokens(F.col("text"))
    ).select("doc_id", "tokens")


def _count_where(condition: Callable[[Column], Column]) -> Column:
    return F.sum(F.size(F.filter("tokens", condition)))


def q_token_validity(spark, sf_dir):
    return _piece_tokens(spark, sf_dir).groupBy("doc_id").agg(
        F.sum(F.size("tokens")).alias("tokens"), _count_where(is_scored).alias("scored")
    )


def q_label_allowed(spark, sf_dir):
    tokens = _piece_tokens(spark, sf_dir).select("doc_id", F.explode("tokens").alias("token"))
    label = F.col("token.label")
    return (
        tokens.filter(label.isNotNull())
        .groupBy("doc_id", label.alias("label"))
        .agg(
            F.count(F.lit(1)).alias("tokens"),
            F.count_if(label_allowed(label, ["PERSON", "Email"])).alias("allowed"),
        )
    )


def q_threshold(spark, sf_dir):
    return _piece_tokens(spark, sf_dir).groupBy("doc_id").agg(
        F.sum(F.size("tokens")).alias("tokens"),
        _count_where(lambda t: ~is_weak(t.score, 0.55)).alias("kept"),
        _count_where(lambda t: is_weak(t.score, 0.55)).alias("weak"),
    )


def q_argmax(spark, sf_dir):
    scores = F.transform("embedding", lambda x: F.when(x > 0.25, float("nan")).otherwise(x))
    scored = compute_once(
        table(spark, sf_dir, "embeddings").select("vec_id", scores.alias("scores")),
        best=best_label(F.col("scores").cast("array<float>")),
    )
    return scored.select(
        "vec_id",
        "best.idx",
        F.col("best.score").cast("double").alias("score"),
        label_name(F.col("best.idx"), LABEL_PACKS["default"]).alias("label"),
    )


def q_decode_spans(spark, sf_dir):
    rows = entity_rows(_scan_documents(spark, sf_dir, PIECES), ["doc_id"])
    return rows.select(
        "doc_id",
        "label",
        F.col("start").alias("span_start"),
        F.col("end").alias("span_end"),
        F.col("score").cast("string").cast("double").alias("score"),
    )


def q_token_spans(spark, sf_dir):
    """The spans of decode_spans, from a table of tokens."""
    chunks = _chunk_rows(_dealt(_documents(spark, sf_dir)), "doc_id", "text", 1000)
    scored = compute_once(chunks, tokens=PIECES.scorer.tokens(F.col("text")))
    tokens = scored.select("doc_id", "chunk_idx", "offset", F.posexplode("tokens").alias("place", "token"))
    tokens = tokens.select("doc_id", "chunk_idx", "offset", "place", "token.*")
    spans = merge_token_rows(tokens, ["doc_id", "chunk_idx", "offset"], "place", PIECES.labels, PIECES.settings.threshold)
    return spans.select(
        "doc_id",
        "label",
        (F.col("start") + F.col("offset")).alias("span_start"),
        (F.col("end") + F.col("offset")).alias("span_end"),
        F.col("score").cast("string").cast("double").alias("score"),
    )


def q_dedupe_entities(spark, sf_dir):
    start, end = F.col("start"), F.col("end")
    coarse = entity_rows(_scan_documents(spark, sf_dir, PIECES), ["doc_id"]).select(
        "doc_id",
        "ord",
        "label",
        (start - start % 64).alias("start"),
        (end - end % 64 + F.lit(64)).alias("end"),
        "text",
    )
    return distinct_rows(coarse).select(
        "doc_id",
        "label",
        F.col("start").alias("span_start"),
        F.col("end").alias("span_end"),
        "text",
        "ord",
    )


def q_entity_text(spark, sf_dir):
    return entity_rows(_scan_documents(spark, sf_dir), ["doc_id"]).select(
        "doc_id",
        "ord",
        "label",
        "text",
        F.col("start").alias("span_start"),
        F.col("end").alias("span_end"),
        F.round(F.col("score") * 100).cast("int").alias("score_pct"),
    )


# False positives; the candidates are derived from the orders


def _fp_query(verdict: Callable[[Column, Column, Column], Column]):
    def query(spark, sf_dir):
        candidates = _orders(
            spark,
            sf_dir,
            label=oracle.FP_LABEL,
            value=oracle.FP_VALUE,
            score=f"CAST({oracle.FP_SCORE} AS FLOAT)",
        )
        rejected = verdict(*map(F.col, ("label", "value", "score")))
        return candidates.select("o_orderkey", "label", "value", rejected.alias("rejected"))

    return query


def _fp_part(part: Callable[..., Column], of: Callable[[Column, Column], Column]):
    return _fp_query(
        lambda label, value, score: fp.by_label(
            label, lambda rule: part(rule, of(value, score)), fp.DEFAULT_RULES
        )
    )


def _lowered(value: Column, _: Column) -> Column:
    return F.lower(fp.trim_space(value))


def q_emit_test(spark, sf_dir):
    base = {"overrides": {"threshold": 0.6}, "log": True}
    kept = entity_rows(
        _scan_documents(spark, sf_dir, Scanner.for_request(filters=False, **base)), ["doc_id"]
    )
    rejected = fp.is_false_positive(F.col("label"), F.col("text"), F.col("score"))
    return kept.groupBy("doc_id", "label").agg(
        F.count(F.lit(1)).alias("found"), F.count_if(~rejected).alias("emitted")
    )


def q_fp_rule_table(spark, sf_dir):
    """The candidates of emit_test, judged by rules that are joined from a table."""
    base = {"overrides": {"threshold": 0.6}, "log": True}
    kept = entity_rows(
        _scan_documents(spark, sf_dir, Scanner.for_request(filters=False, **base)), ["doc_id"]
    )
    judged = judge_by_table(kept, fp.rule_table(spark), plan_rules=0)
    return judged.groupBy("doc_id", "label").agg(
        F.count(F.lit(1)).alias("found"), F.count_if(~F.col("rejected")).alias("emitted")
    )


# Scans


def q_scan_documents(spark, sf_dir):
    return _flat(_scan_documents(spark, sf_dir), "doc_id")


def q_scan_pages(spark, sf_dir):
    return _flat(_scan_pages(spark, sf_dir), "page_id")


def q_scan_conversations(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations")
    results = scan_table(messages, "text", ["conv_id", "turn"], SCANNER)
    return _flat(results.withColumn("message", F.concat_ws("/", "conv_id", "turn")), "message")


def q_scan_results(spark, sf_dir):
    return _scan_pages(spark, sf_dir).drop("entities")


def q_scan_summary(spark, sf_dir):
    return summarise(_scan_pages(spark, sf_dir))


def q_status_counts(spark, sf_dir):
    return count_statuses(gate_table(table(spark, sf_dir, "pages"), "html", ["page_id"]))


def q_by_label(spark, sf_dir):
    return count_labels(_scan_documents(spark, sf_dir))


def q_top10_per_label(spark, sf_dir):
    rows = report_rows(report(_scan_documents(spark, sf_dir, PIECES), "doc_id"), "doc_id")
    shown = F.array_join(
        F.transform("top", lambda e: F.concat_ws(" ", e.text, e.confidence, e.band)), "; "
    )
    return rows.select(
        "doc_id", "label", F.col("count").alias("entities"), shown.alias("top"), "more"
    )


def q_confidence_band(spark, sf_dir):
    rows = entity_rows(_scan_documents(spark, sf_dir, PIECES), ["doc_id"])
    band = confidence_band(F.col("score")).alias("band")
    return rows.groupBy("doc_id", band).agg(F.count(F.lit(1)).alias("entities"))


def q_visible_results(spark, sf_dir):
    return report(_scan_pages(spark, sf_dir), "page_id").select("page_id", "status")


def q_headline(spark, sf_dir):
    shown = report(_scan_pages(spark, sf_dir), "page_id", show_all=True)
    return shown.select("page_id", "headline")


def q_response_json(spark, sf_dir):
    results = _scan_documents(spark, sf_dir).withColumn("file", F.col("doc_id").cast("string"))
    columns = (
        "file", "status", "entities", "pii_count", "file_size_bytes", "chunks_processed", "error"
    )
    return results.select("doc_id", result_json(*columns).alias("json"))


def _written_results(spark, sf_dir, format):
    folder = shared_folder(spark)
    results = _scan_pages(spark, sf_dir)
    write_response(results, folder, format=format)
    return folder, results.schema


def q_write_results(spark, sf_dir):
    folder, schema = _written_results(spark, sf_dir, "json")
    return spark.read.schema(schema).json(f"{folder}/results").drop("entities")


def q_write_summary(spark, sf_dir):
    folder, _ = _written_results(spark, sf_dir, "parquet")
    return spark.read.parquet(f"{folder}/summary")


def q_unsupported_labels(spark, sf_dir):
    requests = _label_requests(spark, sf_dir)
    missing = unsupported_labels_column(F.col("resolved"), SCANNER.scorer.vocabulary)
    labels = requests.select(F.explode(missing).alias("label"))
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("requested"))


def q_model_scan(spark, sf_dir):
    scanner = Scanner(
        labels=("person", "email"),
        settings=Settings(max_chunk_size=1000),
        scorer=toy_model(),
        filters=False,
    )
    rows = entity_rows(_scan_documents(spark, sf_dir, scanner), ["doc_id"])
    return rows.select(
        "doc_id",
        "label",
        F.col("start").alias("span_start"),
        F.col("end").alias("span_end"),
        F.round(F.col("score") * 1000).cast("int").alias("score_mille"),
    )


def q_scan_path(spark, sf_dir):
    """Scan of a directory that holds the documents as text files, one directory per language.

    A file holds many documents, and no entity reaches over a newline. With chunks as large as a file
    no entity is cut, so the entities are those of the documents.
    """
    folder = shared_folder(spark)
    documents = _documents(spark, sf_dir).select("text", "lang")
    documents.write.partitionBy("lang").option("maxRecordsPerFile", 1000).text(folder)
    sizes = {"max_chunk_size": WHOLE_FILE, "max_file_size_mb": 2000.0}
    scanner = Scanner.for_request(log=True, overrides=sizes)
    return count_labels(scan_directory(spark, folder, scanner=scanner))


def _write_files(files: DataFrame, folder: str) -> str:
    """Write rows (name, content) as files of a folder, from the executors; a repeated task writes the same."""
    folder = absolute(files.sparkSession, folder)

    def write(batches):
        for batch in batches:
            for name, content in zip(batch["name"].to_pylist(), batch["content"].to_pylist(), strict=True):
                write_file(f"{folder}/{name}", content)
            yield batch.select(["name"])

    files.select("name", "content").mapInArrow(write, "name string").count()
    return folder


_landed: dict[tuple[str, str], str] = {}


def _as_files(spark, sf_dir) -> str:
    """The documents as files: hidden, nested, undecodable, without a byte, and with an extension that isn't scanned.

    They are written once in an application.
    """
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _landed:
        _landed[key] = _land(spark, sf_dir)
    return _landed[key]


def _land(spark, sf_dir) -> str:
    kind = F.col("doc_id") % 8
    name = (
        F.when(kind == 1, F.format_string("_%d.txt", "doc_id"))
        .when(kind == 2, F.format_string(".%d.env", "doc_id"))
        .when(kind == 3, F.format_string(".d%d/_e/%d.Json", F.col("doc_id") % 5, "doc_id"))
        .when(kind == 7, F.format_string("%d.bin", "doc_id"))
        .otherwise(F.format_string("%d.log", "doc_id"))
    )
    text = F.encode("text", "UTF-8")
    broken = F.concat(F.unhex(F.lit("FFFE00D8")), text)
    content = F.when(kind == 5, broken).when(kind == 6, F.lit(b"")).otherwise(text)
    return _write_files(
        _documents(spark, sf_dir).select(name.alias("name"), content.alias("content")), shared_folder(spark)
    )


def _file_rows(results: DataFrame) -> DataFrame:
    why = F.regexp_extract("error", "Empty file|Unable to [a-z]+ file", 0).alias("why")
    name = F.substring_index("file", "/", -1).alias("name")
    return results.select(name, "status", "pii_count", "file_size_bytes", "chunks_processed", why)


def q_scan_files(spark, sf_dir):
    return _file_rows(scan_directory(spark, _as_files(spark, sf_dir), scanner=SCANNER))


def q_scan_flat(spark, sf_dir):
    return _file_rows(scan_directory(spark, _as_files(spark, sf_dir), recursive=False, scanner=SCANNER))


def q_scan_stream(spark, sf_dir):
    """The same files as they come out of a stream, the entities too."""
    folder = shared_folder(spark)
    query = scan_stream(spark, _as_files(spark, sf_dir), f"{folder}/results", f"{folder}/checkpoint", SCANNER)
    query.awaitTermination()
    results = spark.read.parquet(f"{folder}/results")
    return _file_rows(results)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name[2:]: query for name, query in globals().items() if name.startswith("q_")}
    found["fp_min_conf"] = _fp_part(fp.under_confidence, lambda value, score: score)
    found["fp_exact"] = _fp_part(fp.is_stop_word, _lowered)
    found["fp_pattern"] = _fp_part(fp.matches_reject, _lowered)
    found["fp_valid"] = _fp_part(fp.fails_valid, lambda value, score: value)
    found["fp_filter"] = _fp_query(fp.is_false_positive)
    return found
