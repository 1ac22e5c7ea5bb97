"""Documents whose sets of word n-grams are alike, found by token-combination prefixes.

The tokens of a document are hashes of its distinct n-grams. All are put in one order: rare ones
first, then the frequent ones, both by rising estimated frequency. The estimate is a sketch of fixed
width over all documents; it steers the cost and never the result.

Let t be the least similarity and c the tokens that two linked documents of sizes n and n' share, so
c >= ceil(t n) and c >= ceil(t n'). The first n - ceil(t n) + s tokens of either document, its
s-prefix, hold the first s of the c shared tokens.

* If the first shared token is rare, it lies in both 1-prefixes: each rare token there is a signature.
* Else all shared tokens are frequent. These are dealt by hash over m classes. With s = m + 1 two
  shared tokens of both s-prefixes fall into one class: each pair of frequent tokens of one class in
  the s-prefix is a signature. Documents too small to share m + 1 tokens also index the frequent
  tokens of their 1-prefix singly. m grows with the size, so that a class holds few tokens; a
  document also indexes for the m of any size that it could link with.

Documents with equal sets are one item. Items that share a signature are verified on their whole
sets (see linkage), hence links are exact up to equal hashes of 64 bits (n-grams) and 128 (sets).

Inputs: null texts and texts without words have no set and link with nothing; their component is
their own id. Rows that repeat an id are documents of their own. A null id is returned as it is, and
is only a component's name where all its ids are null. Other columns are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm import kernels as K
from veilscan.llm.linkage import SKETCH_FIELDS, alike, linked_items, members, sketch_columns
from veilscan.llm.store import array_rows, bloom_of, in_bloom, sum_arrays, text_or_empty, write_table

#: Counters of the frequency sketch: 8 MiB, whatever the input.
SKETCH = 1 << 20
#: A token is frequent if it is counted more often than this over the mean of all counters.
FREQUENT = 40

_PAIRS = {k: np.triu_indices(k, 1) for k in range(2, 33)}


def ngram_set(words: np.ndarray, n: int) -> np.ndarray:
    return np.unique(K.shingle_hashes(words, n))


def _classes(size: int) -> int:
    """m, the number of classes of frequent tokens."""
    return max(1, (1 << (size.bit_length() - 1)) // 64)


def _least(size: int, percent: int) -> int:
    return -(-size * percent // 100)


def signatures(tokens: np.ndarray, counts: np.ndarray, frequent: float, percent: int) -> np.ndarray:
    """Signatures of a set; counts: the sketch."""
    n = len(tokens)
    count = counts[(tokens % K.U(SKETCH)).astype(np.int64)]
    often = count > frequent
    level = np.where(often, 100, 0) + np.log2(np.maximum(count, 1)).astype(np.int64)
    order = np.lexsort((tokens, level))
    tokens, often = tokens[order], often[order]
    shared = _least(n, percent)
    first, common = tokens[: n - shared + 1], often[: n - shared + 1]
    out = [first[~common]]
    if not common.any():
        return out[0]
    sizes = {_classes(k) for k in (shared, n, n * 100 // percent)}
    if shared < max(sizes) + 1:
        out.append(first[common])
    for m in sizes:
        if n < 2:
            break
        prefix = min(n, n - shared + m + 1)
        few = tokens[:prefix][often[:prefix]]
        kind = (K.mix(few) % K.U(m)).astype(np.int64)
        for k in np.unique(kind):
            own = few[kind == k]
            if len(own) > 1:
                i, j = _PAIRS[len(own)] if len(own) in _PAIRS else np.triu_indices(len(own), 1)
                out.append(K.mix(own[i] * K.U(3) + own[j] + K.U(m)))
    return np.concatenate(out)


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    for k, words in enumerate(K.words_of(batch["text"])):
        if len(words):
            yield k, ngram_set(words, n)


def similar_documents(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; component_id: the smallest id it is linked with."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty().alias("text"))
    kinds = f"doc_id long, n_shingles long, item binary, {SKETCH_FIELDS}, chunk int, data binary"
    words = pa.list_(pa.int64())
    arrow = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("item", pa.binary()), ("size", pa.int32()), ("sketch", words),
         ("wide", words), ("chunk", pa.int32()), ("data", pa.binary())]
    )

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.int64)
        for batch in (part for whole in batches for part in K.slices(whole, "text")):
            rows = batch.num_rows
            sets, spots, sizes = [np.empty(0, K.U)] * rows, [], np.zeros(rows, np.int64)
            high, low = np.zeros(rows, K.U), np.zeros(rows, K.U)
            for k, tokens in _sets(batch, n):
                sets[k], sizes[k] = tokens, len(tokens)
                high[k], low[k] = K.set_key(tokens)
                spots.append((tokens % K.U(SKETCH)).astype(np.int64))
            if spots:
                sketch += np.bincount(np.concatenate(spots), minlength=SKETCH)
            told = sketch_columns(sets)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes), K.binary_keys(high, low), told["size"], told["sketch"], told["wide"],
                 pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                schema=arrow,
            )
        for chunk, data in array_rows(sketch):
            parts = [pa.array([chunk], pa.int32()), pa.array([data], pa.binary())]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, field.type) for field in list(arrow)[:-2]], *parts], schema=arrow)

    both = write_table(docs.mapInArrow(survey, kinds), "survey")
    named = both.filter("chunk is null").select("doc_id", "n_shingles", "item")
    counts = sum_arrays(both.filter("chunk is not null"), SKETCH, "int64")
    frequent = FREQUENT + float(counts.sum()) / SKETCH
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(counts)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in K.slices(whole, "text")):
            done, sigs, high, low = set(), [], [], []
            for _, tokens in _sets(batch, n):
                key = K.set_key(tokens)
                if key not in done:
                    done.add(key)
                    sigs.append(signatures(tokens, sent.value, frequent, percent))
                    high.append(key[0]), low.append(key[1])
            each = [len(x) for x in sigs]
            if sum(each):
                yield pa.record_batch(
                    {
                        "sig": pa.array(np.concatenate(sigs).view(np.int64)),
                        "item": K.binary_keys(np.repeat(np.array(high, K.U), each), np.repeat(np.array(low, K.U), each)),
                    }
                )

    shared = members(docs.select("text").mapInArrow(sign, "sig long, item binary"))
    sketches = both.filter("n_shingles > 0").select("item", "size", "sketch", "wide")
    sketches = sketches.join(shared.select("item").distinct(), "item", "left_semi").dropDuplicates(["item"])

    def verify(pairs: DataFrame) -> DataFrame:
        """Only items of pairs that sketches leave have their sets made and shuffled."""
        pairs = write_table(pairs.select("a", "b"), "tested")
        items = pairs.select(F.col("a").alias("item")).union(pairs.select("b")).distinct()
        bloom = spark.sparkContext.broadcast(bloom_of(items))

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done: set[tuple[int, int]] = set()  # items of this task; forgotten where there are very many
            for batch in (part for whole in batches for part in K.slices(whole, "text")):
                found = {}
                for _, tokens in _sets(batch, n):
                    key = K.set_key(tokens)
                    if key not in done and in_bloom(bloom.value, np.array([key[0]], K.U))[0]:
                        done.add(key)
                        found[key] = tokens
                if len(done) > 200_000:
                    done.clear()
                if found:
                    high, low = np.array(list(found), K.U).T
                    tokens = pa.array([x.tobytes() for x in found.values()], pa.binary())
                    yield pa.record_batch({"item": K.binary_keys(high, low), "tokens": tokens})

        sets = docs.select("text").mapInArrow(gather, "item binary, tokens binary")
        own = write_table(sets.join(items, "item", "left_semi").dropDuplicates(["item"]), "sets")
        left, right = own.toDF("a", "x"), own.toDF("b", "y")
        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(
            lambda it: _verified(it, percent), "a binary, b binary"
        )

    roots = linked_items(shared, percent, write_table(sketches, "sketches"), verify)
    rows = named.join(roots, "item", "left").withColumn("root", F.coalesce("root", "item"))
    least = rows.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return (
        rows.join(least, "root", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for k, (x, y) in enumerate(zip(batch["x"], batch["y"], strict=True)):
            keep[k] = alike(np.frombuffer(x.as_buffer(), K.U), np.frombuffer(y.as_buffer(), K.U), percent)
        yield batch.select(["a", "b"]).filter(pa.array(keep))
