import json

import pytest
from test_model_scorer import artifacts  # noqa: F401

from veilscan import Scanner, scan_table
from veilscan.operators.model_files import load_scorer, read_config


def config(folder, **told):
    path = folder / "config.json"
    path.write_text(json.dumps(told))
    return str(path)


def test_labels_and_length_come_from_the_files(spark, artifacts, tmp_path):  # noqa: F811
    tokenizer, model = artifacts
    told = config(tmp_path, labels=["O", "person", "organization"], max_length=8, model_name="names")
    scorer = load_scorer(model, tokenizer, told)
    assert scorer.vocabulary == ("O", "person", "organization")
    df = spark.createDataFrame([(0, "héllo alice , bob works at acme")], "id int, t string")
    (row,) = scan_table(df, "t", "id", Scanner(labels=("person", "organization"), scorer=scorer)).collect()
    assert [(e.text, e.label) for e in row.entities] == [("alice", "person"), ("bob", "person"), ("acme", "organization")]


def test_a_model_of_another_width_is_refused(artifacts, tmp_path):  # noqa: F811
    import numpy as np

    tokenizer, model = artifacts
    ids = np.array([[1, 2]])
    fit = load_scorer(model, tokenizer, config(tmp_path, labels=["O", "person", "organization"])).make_model()
    assert fit(ids, np.ones_like(ids), None).shape == (1, 2, 3)
    narrow = load_scorer(model, tokenizer, config(tmp_path, labels=["O", "person"])).make_model()
    with pytest.raises(ValueError, match="3 outputs a token, its configuration 2 labels"):
        narrow(ids, np.ones_like(ids), None)


def test_configurations(artifacts, tmp_path):  # noqa: F811
    assert read_config(config(tmp_path, labels=["O"])).max_length == 128
    for told in ({}, {"labels": []}, {"labels": [1]}, {"labels": "O"}, {"labels": ["O"], "max_length": 0}, {"labels": ["O"], "max_length": "8"}):
        with pytest.raises(ValueError):
            read_config(config(tmp_path, **told))
    (tmp_path / "broken.json").write_text("{")
    with pytest.raises(ValueError, match="no JSON"):
        read_config(str(tmp_path / "broken.json"))
    with pytest.raises(FileNotFoundError):
        load_scorer(artifacts[1], artifacts[0], str(tmp_path / "missing.json"))
