"""Groups of items that share a signature and pass an exact test, without all pairs of a group.

Each signature has one leader. Items are tested against their leaders; what links is joined into
components. Only pairs under one signature whose components still differ are then left to test, which makes the result complete:
two items that share a signature and would pass the test always end in one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.store import write_table


def _changed(array: pa.Array, before: object) -> pa.Array:
    """Where a value differs from the one before it."""
    first = pa.array([before is None or array[0].as_py() != before])
    if len(array) == 1:
        return first
    return pa.concat_arrays([first, pc.not_equal(array.slice(1), array.slice(0, len(array) - 1))])


def _shared(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The distinct rows of signatures with two items at least; rows come sorted."""
    sig = last = None
    held = None  # the first row of the run that goes on from batch to batch, and whether it is out
    out = False
    for batch in batches:
        if not batch.num_rows:
            continue
        new_sig = _changed(batch["sig"], sig)
        new = pc.or_(new_sig, _changed(batch["item"], last))
        sig, last = batch["sig"][-1].as_py(), batch["item"][-1].as_py()
        table = pa.Table.from_batches([batch])
        firsts = np.flatnonzero(new_sig.to_numpy(zero_copy_only=False))
        more = np.flatnonzero(pc.and_not(new, new_sig).to_numpy(zero_copy_only=False))
        if held is not None:  # the carried row is row 0
            table = pa.concat_tables([held, table])
            firsts, more = np.concatenate([[0], firsts + 1]), more + 1
        of = firsts[np.searchsorted(firsts, more, "right") - 1]
        begun = np.unique(of)
        if out and held is not None:
            begun = begun[begun > 0]
        rows = np.concatenate([begun, more])
        if len(rows):
            yield from table.take(rows).cast(schema).combine_chunks().to_batches()
        k = int(firsts[-1])
        out = bool(len(of) and of[-1] == k) or (out and k == 0 and held is not None)
        held = table.slice(k, 1).combine_chunks()


def members(signatures: DataFrame) -> DataFrame:
    """(sig, item) of all signatures that two items share."""
    kind = signatures.schema["item"].dataType.simpleString()
    schema = pa.schema([("sig", pa.int64()), ("item", pa.binary() if kind == "binary" else pa.int64())])
    rows = signatures.select("sig", "item").repartition("sig").sortWithinPartitions("sig", "item")
    return write_table(rows.mapInArrow(lambda it: _shared(it, schema), f"sig bigint, item {kind}"), "members")


def _followed(to: DataFrame) -> DataFrame:
    """Pointers (c, to) with twice the steps; a table of known size, so that small ones join without a shuffle."""
    return write_table(to.join(to.toDF("to", "next"), "to").select("c", F.col("next").alias("to")), "steps")


def components(links: DataFrame) -> DataFrame:
    """(item, root) of all ends of links (a, b): union-find as rounds of joins, over tables in the shared folder.

    In each round every component points to the neighbour that comes first in an order by hash, and follows
    the pointers for four steps. Links between components are renamed to what their ends point to,
    until none is left; the renamings, one after the other, give the roots.
    """
    links = write_table(links.select("a", "b").distinct(), "links")
    roots = links.select(F.col("a").alias("item")).union(links.select("b")).distinct().withColumn("root", F.col("item"))
    while not links.isEmpty():
        both = links.union(links.select("b", "a")).toDF("c", "other")
        order = F.struct(F.xxhash64("other").alias("o"), F.col("other").alias("c"))
        own = F.struct(F.xxhash64("c").alias("o"), F.col("c"))
        to = both.groupBy("c").agg(F.min(order).alias("best")).select("c", F.least("best", own)["c"].alias("to"))
        four = _followed(_followed(write_table(to, "steps")))
        roots = roots.join(four.toDF("root", "to"), "root", "left").select("item", F.coalesce("to", "root").alias("root"))
        ends = links.join(four.toDF("a", "x"), "a").join(four.toDF("b", "y"), "b").filter("x != y")
        links = write_table(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return write_table(roots, "roots")


#: 64-bit words of a sketch that goes with each signature.
SKETCH_WORDS = 4
SKETCH_FIELDS = "size int, sketch array<long>, wide array<long>"


def sketch(hashes: np.ndarray, words: int = SKETCH_WORDS) -> list[int]:
    """For a set of 64-bit hashes: for each bit whether an odd number of members has it, as signed 64-bit words.

    Two sets differ in as many members at least as their sketches in bits, which rules out pairs exactly.
    """
    odd = np.bincount((hashes & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def sketch_columns(sets: list[np.ndarray]) -> dict[str, pa.Array]:
    """SKETCH_FIELDS of sets; a wide sketch has two bits or more a member."""
    wide = [sketch(x, max(SKETCH_WORDS, 1 << (-(-len(x) // 32) - 1).bit_length())) for x in sets]
    words = pa.list_(pa.int64())
    return {
        "size": pa.array([len(x) for x in sets], pa.int32()),
        "sketch": pa.array([sketch(x) for x in sets], words),
        "wide": pa.array(wide, words),
    }


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets, not empty, have a Jaccard similarity of percent."""
    if min(len(x), len(y)) * 100 < max(len(x), len(y)) * percent:
        return False
    both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _near(percent: int, bits: F.Column) -> F.Column:
    """Whether sizes m, n and differing bits leave room for a Jaccard similarity of percent."""
    sizes = F.least("m", "n") * 100 >= F.greatest("m", "n") * percent
    return sizes & (bits * (100 + percent) <= (F.col("m") + F.col("n")) * (100 - percent))


def _bits(v: str = "v", w: str = "w", words: int = SKETCH_WORDS) -> F.Column:
    """Bits in which sketches v, w of so many words differ."""
    bits = [F.bit_count(F.col(v)[k].bitwiseXOR(F.col(w)[k])) for k in range(words)]
    return sum(bits[1:], bits[0])


def _wide_bits() -> F.Column:
    """Bits in which wide sketches v, w differ; the halves of one twice as long are laid on each other. Others aren't compared."""
    least = F.least(F.size("v"), F.size("w"))

    def word(name: str, k: F.Column) -> F.Column:
        return F.get(name, k).bitwiseXOR(F.coalesce(F.get(name, k + least), F.lit(0).cast("long")))

    count = F.aggregate(
        F.sequence(F.lit(0), least - 1), F.lit(0), lambda n, k: n + F.bit_count(word("v", k).bitwiseXOR(word("w", k)))
    )
    return F.when(F.greatest(F.size("v"), F.size("w")) <= 2 * least, count).otherwise(0)


def _closer(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that wide sketches don't rule out."""
    own = sketches.select("item", "size", "wide")
    both = pairs.join(own.toDF("a", "m", "v"), "a").join(own.toDF("b", "n", "w"), "b")
    return both.filter(_near(percent, _wide_bits())).select("a", "b")


def linked_items(shared: DataFrame, percent: int, sketches: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(item, root) of linked items. sketches: (item, SKETCH_FIELDS) of all of them. verify: keeps those of the pairs (a, b) that link.

    Pairs whose sizes or sketches rule out a similarity of percent are never tested. A signature's
    leader is the item that shares the most signatures with others: in a group of copies most likely
    the original.
    """
    narrow = sketches.select("item", "size", "sketch")
    counts = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    weights = shared.join(counts, "sig").groupBy("item").agg(F.sum("n").alias("weight"))
    led = F.max(F.struct("weight", "item")).alias("led")
    most = shared.join(weights, "item").groupBy("sig").agg(led).select("sig", F.col("led.item").alias("q"))
    led = shared.toDF("sig", "p").join(most, "sig").filter("p != q")
    led = led.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    led = led.join(narrow.toDF("a", "m", "v"), "a").join(narrow.toDF("b", "n", "w"), "b").filter(_near(percent, _bits()))
    pairs = write_table(led.select("a", "b"), "pairs")
    roots = components(verify(_closer(pairs, sketches, percent)))
    left = _open_pairs(_rooted(shared, roots), sketches, percent).join(pairs, ["a", "b"], "left_anti")
    left = write_table(left, "pairs")
    links = write_table(verify(_closer(left, sketches, percent)), "links")
    x, y = roots.toDF("a", "x"), roots.toDF("b", "y")
    between = links.join(x, "a", "left").join(y, "b", "left")
    merged = components(between.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    more = links.select(F.col("a").alias("item")).union(links.select("b")).distinct().join(roots, "item", "left_anti")
    roots = roots.union(more.select("item", F.col("item").alias("root")))
    roots = roots.join(merged.toDF("root", "to"), "root", "left").select("item", F.coalesce("to", "root").alias("root"))
    return write_table(roots, "roots")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "item", "left").withColumn("root", F.coalesce("root", "item"))


#: Words of the sketches that go with the rows of signatures, beside those of SKETCH_WORDS.
MIDDLE_WORDS = 16


def _middle() -> F.Column:
    """A wide sketch folded to MIDDLE_WORDS; null if it is shorter."""

    def word(k: F.Column) -> F.Column:
        along = F.sequence(k, F.size("wide") - 1, F.lit(MIDDLE_WORDS))
        return F.aggregate(along, F.lit(0).cast("long"), lambda a, j: a.bitwiseXOR(F.get("wide", j)))

    return F.when(F.size("wide") >= MIDDLE_WORDS, F.transform(F.sequence(F.lit(0), F.lit(MIDDLE_WORDS - 1)), word))


def _open_pairs(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with a < b under one signature whose roots differ and that both sketches leave open.

    Sketches are compared inside the join, in generated code, so that unlike items under one signature make no rows.
    """
    low, high = F.min("root").alias("low"), F.max("root").alias("high")
    mixed = rows.groupBy("sig").agg(low, high).filter("low != high").select("sig")
    told = sketches.select("item", "size", "sketch", _middle().alias("middle"))
    left = rows.select("sig", "root", "item").join(mixed, "sig").join(told, "item")
    left = write_table(left.select("sig", "root", "item", "size", "sketch", "middle"), "left")
    x, y = left.toDF("sig", "r", "p", "m", "v", "v_middle"), left.toDF("sig", "s", "q", "n", "w", "w_middle")
    middle = F.coalesce(_near(percent, _bits("v_middle", "w_middle", MIDDLE_WORDS)), F.lit(True))
    pairs = x.join(y, "sig").filter((F.col("r") < F.col("s")) & _near(percent, _bits()) & middle)
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
