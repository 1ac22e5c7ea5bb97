"""Token ids of texts, put together from the ids of their words, which are looked up once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

#: White space as the public tokenizers know it.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters, numbers and white space of Latin-1, for the faster patterns of texts that hold no others.
LATIN_LETTERS, LATIN_NUMBERS, LATIN_WHITE = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe", "\\t-\\r \\x85\\xa0"


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the ranges, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class _Codes(dict):
    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code


class WordIds:
    """Ids of words by a function of many words, kept until there are limit of them."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 300_000) -> None:
        self.encode_words, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.codes = _Codes()
        self.starts, self.lengths, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint16)

    def __call__(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Ids of texts given as lists of words."""
        if len(self.codes) > self.limit:
            self.clear()
        sizes = [len(words) for words in texts]
        find = self.codes.__getitem__
        codes = np.fromiter(map(find, chain.from_iterable(texts)), np.int64, sum(sizes))
        if self.codes.new:
            lengths, ids = self.encode_words(self.codes.new)
            self.codes.new = []
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids.astype(np.uint16)])
        each = self.lengths[codes]
        flat = self.ids[ranges(self.starts[codes], each)]
        ends = np.concatenate([[0], np.cumsum(each)])[np.cumsum(sizes, dtype=np.int64)] if sizes else []
        return np.split(flat, ends[:-1]) if sizes else []
