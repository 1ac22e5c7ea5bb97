"""Scoring chunks with a token-classification model in Arrow batches.

A model is two factories that run once per Python worker:

* ``make_tokenizer()`` gives a function from a text to its windows. A window is one model input:
  token ids, attention mask, type ids, and byte offsets ``(start, end)`` of every token in the text.
  Together the windows cover the text, however long it is. The function may have an attribute ``many``, a function
  from a list of texts to the windows of all, end to end: token ids, attention masks and type ids as ``int64``,
  byte offsets ``[tokens, 2]``, and the length and the text's position of every window.
* ``make_model()`` gives a function from three ``int64`` arrays ``[batch, length]`` (the last is None
  if no type id is set) to logits ``[batch, length, labels]``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.columns import let
from veilscan.operators.row_scan import Finder, Merger
from veilscan.settings import Settings

Window = tuple[Sequence[int], Sequence[int], Sequence[int], Sequence[tuple[int, int]]]

_SPANS = "array<array<struct<label:int,start:int,end:int,score:float>>>"
#: Tokens of chunks that are held for common model runs, beside those of one chunk.
POOL_TOKENS = 1 << 18
_SCORED = "start array<int>, end array<int>, idx array<int>, score array<float>"
_ACTIVATIONS = ("none", "sigmoid", "softmax")


@dataclass(frozen=True)
class ModelScorer:
    make_tokenizer: Callable[[], Callable[[str], list[Window]]]
    make_model: Callable[[], Callable[..., np.ndarray]]
    vocabulary: Sequence[str]
    activation: str = "none"

    def __post_init__(self) -> None:
        object.__setattr__(self, "vocabulary", tuple(self.vocabulary))
        if not self.vocabulary:
            raise ValueError("A model scorer needs the label vocabulary of its model")
        if self.activation not in _ACTIVATIONS:
            raise ValueError(f"activation must be one of {_ACTIVATIONS}")

    def finder(self, labels: Sequence[str], settings: Settings) -> Callable[[], Finder]:
        """Factory of the spans of chunks, for ``scan_texts``."""
        make_tokenizer, make_model, activation = self.make_tokenizer, self.make_model, self.activation
        vocabulary, labels = list(self.vocabulary), tuple(labels)
        threshold, batch_size = settings.threshold, settings.batch_size

        def make_finder() -> Finder:
            tokenize, model = make_tokenizer(), make_model()
            merge = Merger(vocabulary, labels, threshold)

            def find(data: np.ndarray, bounds: np.ndarray) -> Iterator[list[np.ndarray]]:
                raw = data.tobytes()
                texts = (raw[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:]))
                return _chunk_spans(tokenize, model, merge, texts, activation, batch_size)

            return find

        return make_finder

    def spans(self, texts: Column, labels: Sequence[str], threshold: float, batch_size: int) -> Column:
        """``array<array<struct<label, start, end, score>>>``: the merged spans of each of a row's chunks.

        Tokens stay in the Python worker, and only spans come back. Rules are those of ``merge_tokens``.
        """
        find = _spans_udf(self, tuple(labels), threshold, batch_size)
        names = F.lit(list(self.vocabulary))

        def named(span: Column) -> Column:
            return F.struct(
                F.get(names, span.label).alias("label"),
                span.start.alias("start"),
                span.end.alias("end"),
                span.score.alias("score"),
            )

        return F.transform(find(texts), lambda spans: F.transform(spans, named))

    def tokens(self, text: Column, batch_size: int) -> Column:
        """``array<struct<start, end, label, score>>`` of each chunk; NULL text gives no tokens."""
        score = _scoring_udf(self.make_tokenizer, self.make_model, self.activation, batch_size)
        names = F.lit(list(self.vocabulary))
        return let(
            score(text),
            lambda scored: F.transform(
                scored.start,
                lambda start, i: F.struct(
                    start.alias("start"),
                    F.get(scored.end, i).alias("end"),
                    F.get(names, F.get(scored.idx, i)).alias("label"),
                    F.get(scored.score, i).alias("score"),
                ),
            ),
        )


def _padded(rows: Sequence[Sequence[int]]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows))), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _activated(logits: np.ndarray, activation: str) -> np.ndarray:
    if activation == "sigmoid":
        return 1.0 / (1.0 + np.exp(-logits))
    if activation == "softmax":
        powers = np.exp(logits - logits.max(axis=-1, keepdims=True))
        return powers / powers.sum(axis=-1, keepdims=True)
    return logits


def _best(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First maximum along the labels; NaN never wins."""
    none = np.isnan(logits)
    scores = np.where(none, np.finfo(np.float32).min, logits) if none.any() else logits
    scores = scores.astype(np.float32, copy=False)
    idx = scores.argmax(axis=-1)
    return idx, np.take_along_axis(scores, idx[..., None], axis=-1)[..., 0]


def _score_windows(model, windows: Sequence[Window], activation: str) -> Iterator[list[np.ndarray]]:
    """Start, end, index and score of the tokens of each window of one model run, without padding."""
    ids, masks, types, offsets = zip(*windows)
    type_ids = _padded(types)
    logits = model(_padded(ids), _padded(masks), type_ids if type_ids.any() else None)
    idx, score = _best(_activated(np.asarray(logits, dtype=np.float32), activation))
    for row, (mask, spans) in enumerate(zip(masks, offsets)):
        used = np.asarray(mask, dtype=bool)
        at = np.asarray(spans, dtype=np.int32).reshape(-1, 2)[used]
        here = slice(len(used))
        yield [at[:, 0], at[:, 1], idx[row, here][used], score[row, here][used]]


def batches_by_length(lengths: Sequence[int], batch_size: int) -> Iterator[np.ndarray]:
    """Positions of windows in model runs: windows of like length together, so that little is padded."""
    order = np.argsort(np.asarray(lengths), kind="stable")
    for at in range(0, len(order), batch_size):
        yield order[at : at + batch_size]


def _pools(tokenize, texts: Iterable[str | None]) -> Iterator[list[np.ndarray]]:
    """Windows of many chunks, as ``many`` gives them, with some POOL_TOKENS tokens; owners count the chunks."""
    if hasattr(tokenize, "many"):
        held: list[str] = []
        first = size = 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= POOL_TOKENS:
                *flat, owner = tokenize.many(held)
                yield [*flat, owner + first]
                first, held, size = first + len(held), [], 0
        if held:
            *flat, owner = tokenize.many(held)
            yield [*flat, owner + first]
        return

    windows: list[Window] = []
    owner: list[int] = []
    size = 0

    def flat() -> list[np.ndarray]:
        ids, masks, types, spans = zip(*windows)
        joined = [np.concatenate([np.asarray(x, np.int64) for x in column]) for column in (ids, masks, types)]
        at = np.concatenate([np.asarray(x, np.int32).reshape(-1, 2) for x in spans])
        return [*joined, at, np.array([len(x) for x in ids]), np.array(owner)]

    for k, text in enumerate(texts):
        for window in () if text is None else tokenize(text):
            windows.append(window)
            owner.append(k)
            size += len(window[0])
        if size >= POOL_TOKENS:
            yield flat()
            windows, owner, size = [], [], 0
    if windows:
        yield flat()


def _score_pool(
    model, ids: np.ndarray, mask: np.ndarray, types: np.ndarray, lengths: np.ndarray, activation: str, batch_size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Index and score of the tokens of many windows; runs hold windows of like length."""
    runs = list(batches_by_length(lengths, batch_size))
    order = np.concatenate(runs)
    sizes = lengths[order]
    ends = np.cumsum(sizes)
    # Tokens in the order of the runs.
    place = np.repeat((np.cumsum(lengths) - lengths)[order] - ends + sizes, sizes) + np.arange(ends[-1])
    inputs = [column[place] for column in (ids, mask, types)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[np.ndarray] = []
    at = window = numbers = 0
    for own in runs:
        own_sizes = sizes[window : window + len(own)]
        until, longest = int(ends[window + len(own) - 1]), int(own_sizes[-1])
        even = int(own_sizes[0]) == longest
        if even:
            padded = [column[at:until].reshape(len(own), longest) for column in inputs]
        else:
            filled = np.arange(longest) < own_sizes[:, None]
            padded = [np.zeros(filled.shape, np.int64) for _ in inputs]
            for out, column in zip(padded, inputs):
                out[filled] = column[at:until]
        logits = np.asarray(model(padded[0], padded[1], padded[2] if padded[2].any() else None), dtype=np.float32)
        held.append(logits.reshape(-1, logits.shape[-1]) if even else logits[filled])
        at, window = until, window + len(own)
        numbers += held[-1].size
        if numbers >= POOL_TOKENS or window == len(order):
            found.append(_best(_activated(np.concatenate(held), activation)))
            held, numbers = [], 0
    idx, score = np.empty(len(place), np.int64), np.empty(len(place), np.float32)
    idx[place] = np.concatenate([x[0] for x in found])
    score[place] = np.concatenate([x[1] for x in found])
    return idx, score


def _chunk_spans(
    tokenize, model, merge: Merger, texts: Iterable[str | None], activation: str, batch_size: int
) -> Iterator[list[np.ndarray]]:
    """Spans of chunks; windows of many chunks share model runs, as far as POOL_TOKENS."""
    for ids, mask, types, spans, lengths, owner in _pools(tokenize, texts):
        if len(ids):
            idx, score = _score_pool(model, ids, mask, types, lengths, activation, batch_size)
            used = mask != 0
            chunk = np.repeat(owner, lengths)
            yield merge([spans[used, 0], spans[used, 1], idx[used], score[used]], chunk[used])


def _spans_udf(scorer: ModelScorer, labels: tuple[str, ...], threshold: float, batch_size: int):
    make_tokenizer, make_model, activation = scorer.make_tokenizer, scorer.make_model, scorer.activation
    vocabulary = list(scorer.vocabulary)
    fields = [("label", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float32())]

    @F.arrow_udf(_SPANS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenize, model = make_tokenizer(), make_model()
        merge = Merger(vocabulary, labels, threshold)
        for rows in batches:
            texts = rows.flatten()  # the chunks of all rows; a null row has none
            parts = list(_chunk_spans(tokenize, model, merge, texts.to_pylist(), activation, batch_size))
            columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, int)] * 5
            spans = pa.StructArray.from_arrays(
                [pa.array(c, kind) for c, (_, kind) in zip(columns[1:], fields)], names=[name for name, _ in fields]
            )
            counts = np.bincount(columns[0], minlength=len(texts)) if len(texts) else np.empty(0, int)
            of_chunks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), spans)
            sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), of_chunks)

    return find


def _scoring_udf(make_tokenizer, make_model, activation: str, batch_size: int):
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenize, model = make_tokenizer(), make_model()
        for texts in batches:
            # Windows of neighbouring chunks share model runs. Only those of one run are held.
            found = [None if text is None else [] for text in texts]
            waiting: list[tuple[int, Window]] = []

            def run():
                if waiting:
                    rows, windows = zip(*waiting)
                    for row, columns in zip(rows, _score_windows(model, windows, activation)):
                        found[row].append(columns)
                    waiting.clear()

            for row, text in enumerate(texts):
                for window in () if text is None else tokenize(text):
                    waiting.append((row, window))
                    if len(waiting) == batch_size:
                        run()
            run()
            yield pd.DataFrame(
                {
                    name: [
                        None
                        if windows is None
                        else np.concatenate([w[i] for w in windows] or [np.empty(0, dtype)])
                        for windows in found
                    ]
                    for i, (name, dtype) in enumerate(
                        [("start", "i4"), ("end", "i4"), ("idx", "i4"), ("score", "f4")]
                    )
                }
            )

    return F.pandas_udf(score, _SCORED)


def onnx_model(path: str, providers: Sequence[str] = ("CPUExecutionProvider",)):
    """Factory of a model stored as an ONNX file that every worker can read."""

    def make_model():
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=list(providers))
        wanted = {value.name for value in session.get_inputs()}

        def run(ids, mask, types):
            feed = {"input_ids": ids, "attention_mask": mask}
            if types is not None:
                feed["token_type_ids"] = types
            return session.run(["logits"], {k: v for k, v in feed.items() if k in wanted})[0]

        return run

    return make_model


def file_tokenizer(path: str, max_length: int = 128):
    """Factory of a tokenizer stored as JSON; text over ``max_length`` tokens fills more windows."""

    def make_tokenizer():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.enable_padding(length=max_length, pad_id=0, pad_token="[PAD]")
        tokenizer.enable_truncation(max_length)

        def windows(text: str):
            points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            widths = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            at = np.concatenate([[0], np.cumsum(widths)])
            encoding = tokenizer.encode(text)
            return [
                (e.ids, e.attention_mask, e.type_ids, [(at[s], at[t]) for s, t in e.offsets])
                for e in [encoding, *encoding.overflowing]
            ]

        return windows

    return make_tokenizer
