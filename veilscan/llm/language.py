"""Language identification: known words by their log frequency in each language, other words by n-grams.

A model holds the most frequent words, and the most frequent character n-grams of each length, of a
bounded sample of labelled texts, with a log frequency for every language. A word of a text that the
model knows counts by its own frequencies. For an unseen word the longest n-grams that the model
knows count, by their mean; shorter ones are only looked at where it knows none of the longer ones.
The sums over all words of the whole text make the score of a language; the prediction is the
language with the largest (ties: the first by name), its score its share after a softmax.

Words are runs of letters, in lower case. Inputs: a null text, or one without a letter, is `und` with
score 0; so is every text if there is nothing to learn from. Rows are predicted one by one.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.llm import kernels as K

#: Labelled texts learnt from at most (about: rows are picked by a hash).
SAMPLE = 3_000
#: Words and n-grams of each length that a model keeps.
WORDS, GRAMS, LONGEST = 60_000, 20_000, 5
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def clean(word: str) -> str:
    """The letters of a word; it can hold numerals that aren't digits."""
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def grams(word: str, n: int) -> list[str]:
    word = f" {word} "
    return [word[k : k + n] for k in range(len(word) - n + 1)]


class Model:
    """Log frequencies of words and n-grams (arrays over languages)."""

    def __init__(self, langs: list[str], tables: list[dict[str, np.ndarray]]) -> None:
        self.langs, self.tables = langs, tables  # n-grams by length, and words at 0
        self.kept: dict[str, np.ndarray] = {}

    def word(self, word: str) -> np.ndarray:
        found = self.tables[0].get(word)
        if found is not None:
            return found
        for n in range(LONGEST, 0, -1):
            known = [x for x in map(self.tables[n].get, grams(word, n)) if x is not None]
            if known:
                return sum(known[1:], known[0]) / len(known)
        return np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(letter_words(text or ""))
        if not self.langs or not any(map(clean, counts)):
            return UNKNOWN, 0.0
        kept, total = self.kept, np.zeros(len(self.langs))
        if len(kept) > 300_000:
            kept.clear()
        rows = []
        for word in counts:
            row = kept.get(word)
            if row is None:
                own = clean(word)
                row = kept[word] = self.word(own) if own else np.zeros(len(self.langs))
            rows.append(row)
        total = np.fromiter(counts.values(), np.float64, len(counts)) @ np.array(rows)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def fit(rows: list[tuple[str, dict[str, int]]]) -> Model:
    """A model from counts of words by language."""
    langs = sorted({lang for lang, _ in rows})
    tables = []
    for n in range(LONGEST + 1):
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(langs)))
        for lang, words in rows:
            k = langs.index(lang)
            for word, count in words.items():
                for key in grams(word, n) if n else [word]:
                    counts[key][k] += count
        kept = sorted(counts, key=lambda x: (-counts[x].sum(), x))[: GRAMS if n else WORDS]
        totals = sum(counts.values(), np.zeros(len(langs))) + 0.5 * max(1, len(kept))
        tables.append({x: np.log((counts[x] + 0.5) / totals) for x in kept})
    return Model(langs, tables)


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on about sample of the rows with text and language. Counting is spread over the rows; counts of at most that many texts are gathered."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("text is not null and lang is not null")
    total = rows.select("lang").count()
    if total > sample:
        rows = rows.filter(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30)) < int(sample / total * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], int] = Counter()
        for batch in batches:
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                counts.update((lang, own) for word in letter_words(text) if (own := clean(word)))
        yield pa.record_batch(
            {
                "lang": pa.array([x[0] for x in counts], pa.string()),
                "word": pa.array([x[1] for x in counts], pa.string()),
                "n": pa.array(list(counts.values()), pa.int64()),
            }
        )

    counted = rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words: dict[str, dict[str, int]] = defaultdict(dict)
    for row in counted.toLocalIterator():
        words[row.lang][row.word] = row.n
    return fit(sorted(words.items()))


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text has a letter."""
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in K.slices(whole, position)):
            yield batch.filter(pa.array([any(map(str.isalpha, x or "")) for x in batch.column(position).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All rows and columns, and the predicted language and its score."""
    if {lang_col, score_col} & set(docs.columns):
        raise ValueError(f"there is a column {lang_col} or {score_col} already")
    position = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in K.slices(whole, position)):
            found = [sent.value.predict(x) for x in batch.column(position).to_pylist()]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, lang_col, score_col])

    fields = [T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
