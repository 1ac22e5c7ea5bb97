"""A model scorer made from a model's own files: weights, tokenizer, and a configuration in JSON.

The configuration gives ``labels``, in the order of the model's outputs, and ``max_length`` (128 if it
isn't given). A model whose output has another width than there are labels is refused: with labels in the
wrong places every finding would bear a wrong name.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np

from veilscan.operators.model_scorer import ModelScorer, file_tokenizer, onnx_model

#: Fixed value: tokens of a window where a configuration doesn't say.
MAX_LENGTH = 128


@dataclass(frozen=True)
class ModelConfig:
    labels: tuple[str, ...]
    max_length: int = MAX_LENGTH
    model_name: str | None = None


def read_config(path: str) -> ModelConfig:
    try:
        told = json.loads(Path(path).read_text(encoding="utf-8"))
    except ValueError as error:
        raise ValueError(f"{path} is no JSON: {error}") from error
    if not isinstance(told, dict):
        raise ValueError(f"{path} holds no JSON object")
    labels, length = told.get("labels") or [], told.get("max_length", MAX_LENGTH)
    if not isinstance(labels, list) or not all(isinstance(x, str) for x in labels):
        raise ValueError(f"labels in {path} must be a list of names")
    if not labels:
        raise ValueError(f"{path} names no labels")
    if not isinstance(length, int) or isinstance(length, bool) or length < 1:
        raise ValueError(f"max_length in {path} must be a whole number of 1 or more")
    return ModelConfig(tuple(labels), length, told.get("model_name"))


def _of_width(make_model, width: int):
    """The model, refusing logits of another width."""

    def make():
        model = make_model()

        def run(ids, mask, types):
            logits = np.asarray(model(ids, mask, types))
            if logits.shape[-1] != width:
                raise ValueError(f"The model has {logits.shape[-1]} outputs a token, its configuration {width} labels")
            return logits

        return run

    return make


def load_scorer(
    model: str,
    tokenizer: str,
    config: str,
    activation: str = "none",
    providers: Sequence[str] = ("CPUExecutionProvider",),
) -> ModelScorer:
    """A scorer of three files. The configuration is read here, the others by every worker, which needs them too."""
    for path in (model, tokenizer, config):
        if not Path(path).is_file():
            raise FileNotFoundError(path)
    told = read_config(config)
    make_model = _of_width(onnx_model(model, providers), len(told.labels))
    return ModelScorer(file_tokenizer(tokenizer, told.max_length), make_model, told.labels, activation)
