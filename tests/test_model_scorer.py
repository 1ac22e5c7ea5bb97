import numpy as np
import pytest
from pyspark.sql import functions as F

from veilscan import ModelScorer, Scanner, Settings, file_tokenizer, onnx_model, scan_table
from veilscan.operators.model_scorer import batches_by_length


def field(number, payload):
    """One field of a protocol buffer: bytes are nested messages, ints are varints."""

    def varint(value):
        out = bytearray()
        while True:
            out.append((value & 0x7F) | (0x80 if value > 0x7F else 0))
            value >>= 7
            if not value:
                return bytes(out)

    if isinstance(payload, int):
        return varint(number << 3) + varint(payload)
    payload = payload.encode() if isinstance(payload, str) else payload
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def lookup_model(table):
    """An ONNX model whose logits are rows of a table: ``logits = table[input_ids]``."""
    float32, int64 = 1, 7
    node = field(1, "table") + field(1, "input_ids") + field(2, "logits") + field(4, "Gather")
    values = (
        field(1, table.shape[0]) + field(1, table.shape[1]) + field(2, float32) + field(8, "table")
        + field(9, table.astype("<f4").tobytes())
    )

    def tensor(name, kind, *dims):
        shape = b"".join(field(1, field(2, d) if isinstance(d, str) else field(1, d)) for d in dims)
        return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))

    graph = (
        field(1, node) + field(2, "g") + field(5, values)
        + field(11, tensor("input_ids", int64, "b", "s"))
        + field(11, tensor("attention_mask", int64, "b", "s"))
        + field(12, tensor("logits", float32, "b", "s", table.shape[1]))
    )
    return field(1, 8) + field(7, graph) + field(8, field(2, 13))


@pytest.fixture(scope="module")
def artifacts(tmp_path_factory):
    from tokenizers import Tokenizer, models, pre_tokenizers

    folder = tmp_path_factory.mktemp("model")
    words = {"[PAD]": 0, "[UNK]": 1, "alice": 2, "bob": 3, "héllo": 4, "acme": 5}
    tokenizer = Tokenizer(models.WordLevel(words, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(folder / "tokenizer.json"))
    table = np.zeros((6, 3), dtype=np.float32)
    table[:, 0] = 1.0  # everything is O but the names
    table[[2, 3], 1] = [2.0, 4.0]
    table[5, 2] = 3.0
    table[2, 2] = np.nan
    (folder / "model.onnx").write_bytes(lookup_model(table))
    return str(folder / "tokenizer.json"), str(folder / "model.onnx")


def scorer(artifacts, max_length=8, activation="none"):
    tokenizer, model = artifacts
    return ModelScorer(
        file_tokenizer(tokenizer, max_length), onnx_model(model), ["O", "person", "organization"],
        activation,
    )


def test_onnx_scan(spark, artifacts):
    texts = ["héllo alice , bob works at acme", "nobody", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    scanner = Scanner(labels=("person", "organization"), scorer=scorer(artifacts))
    rows = {r.id: r for r in scan_table(df, "t", "id", scanner).collect()}
    assert [(e.text, e.label, e.start, e.end, e.score) for e in rows[0].entities] == [
        ("alice", "person", 7, 12, 2.0), ("bob", "person", 15, 18, 4.0),
        ("acme", "organization", 28, 32, 3.0),
    ]
    assert (rows[1].pii_count, rows[2].status) == (0, "skipped")


def test_text_over_the_length_of_the_model_is_scored(spark, artifacts):
    text = "héllo " * 50 + "alice " + "héllo " * 50 + "bob"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    scanner = Scanner(labels=(), scorer=scorer(artifacts), settings=Settings(batch_size=3))
    (row,) = scan_table(df, "t", "id", scanner).collect()
    data = text.encode()
    assert [data[e.start : e.end].decode() for e in row.entities] == ["alice", "bob"]


@pytest.mark.parametrize("batch_size", [1, 2, 64])
def test_batches_do_not_change_scores(evaluate, artifacts, batch_size):
    texts = ["alice " * n for n in range(1, 30)] + [None, "", "bob"]
    column = scorer(artifacts).tokens(F.col("t"), batch_size)
    found = evaluate(column, [(t,) for t in texts], "t string")
    assert [None if r is None else [t.label for t in r] for r in found] == (
        [["person"] * n for n in range(1, 30)] + [None, [], ["person"]]
    )


def test_activation(evaluate, artifacts):
    def score(activation):
        column = scorer(artifacts, activation=activation).tokens(F.col("t"), 8)
        return evaluate(column, [("bob",)], "t string")[0][0].score

    assert score("none") == 4.0
    assert score("sigmoid") == pytest.approx(1 / (1 + np.exp(-4)), abs=1e-6)
    assert score("softmax") == pytest.approx(np.exp(4) / (np.exp(4) + np.exp(1) + 1), abs=1e-6)


def test_index_outside_the_vocabulary_has_no_label(evaluate, artifacts):
    tokenizer, model = artifacts
    short = ModelScorer(file_tokenizer(tokenizer), onnx_model(model), ["O"])
    (tokens,) = evaluate(short.tokens(F.col("t"), 8), [("alice héllo",)], "t string")
    assert [t.label for t in tokens] == [None, "O"]


def test_arguments(artifacts):
    with pytest.raises(ValueError, match="vocabulary"):
        ModelScorer(lambda: None, lambda: None, [])
    with pytest.raises(ValueError, match="activation"):
        scorer(artifacts, activation="tanh")


def test_spans_in_the_row_are_those_of_chunk_rows(spark):
    """Also of models whose indices, scores and label names are odd."""
    from catalog.queries import toy_model

    texts = ["some words here, and more of them\n" * 40, "", " ", "x", None, "é中 ab" * 30, "abc" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    for names, labels, threshold in (
        (["O", "person", "email", "date"], (), 0.5),
        (["O", "Person", "email", "Person"], ("PERSON",), 0.9),
        (["person", "O"], ("email", "person"), 0.0),
        (["o", "a", "b", "O"], ("A", "o"), 0.3),
    ):
        toy = toy_model()
        model = ModelScorer(toy.make_tokenizer, toy.make_model, names)
        settings = Settings(max_chunk_size=50, threshold=threshold, batch_size=5)
        both = [
            scan_table(df, "t", "id", Scanner(labels=labels, settings=settings, scorer=model, filters=False, spread_chunks=n))
            for n in (None, 4)
        ]
        found = [sorted(map(tuple, x.collect())) for x in both]
        assert found[0] == found[1] and sum(x[3] for x in found[0]) > 0


def test_a_model_scan_does_not_shuffle(spark, artifacts):
    df = spark.createDataFrame([(1, "alice")], "id int, t string")
    plan = scan_table(df, "t", "id", Scanner(labels=(), scorer=scorer(artifacts)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_windows_of_like_length_share_runs():
    lengths = np.random.default_rng(1).integers(1, 129, 5000)

    def padding(batches):
        cells = sum(len(own) * max(lengths[own]) for own in batches)
        return 1 - lengths.sum() / cells

    sorted_runs = list(batches_by_length(lengths, 32))
    assert sorted(np.concatenate(sorted_runs)) == list(range(5000))
    assert padding(sorted_runs) < 0.02 < 0.4 < padding([np.arange(k, min(k + 32, 5000)) for k in range(0, 5000, 32)])
