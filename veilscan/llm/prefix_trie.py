"""The trie of the turns of conversations, rolled up by centroid decomposition.

A node is a sequence of first turns that some conversation has, known by a chained digest; the empty one
is the root. A turn is known by a digest of its role and text, so texts aren't shuffled. Counts of a
node's members are aggregates over (conversation, depth) rows, combined before the shuffle.

Sums over subtrees don't climb the trie level by level, which a conversation of a million turns would
make a million rounds. The parent edges are a forest of components, at first one. In each round every
large component is cut at its centroid, the deepest node with half of the component's weight at least
under it: the component's total under that node is added to the nodes on the path from it up to the
component's top, and what is left of the component and each child of the centroid go on as components of
half the weight at most. The rounds are as many as the binary logarithm of the weight. Components of
at most SMALL are finished by one task each, a batch of them at a time.

A node's weight is its number of members; what is under it then weighs as much as there are (member,
depth) rows at or under its depth, an aggregate as well, which only changes on the paths. Whether a node
is under the centroid is a lookup too: the node's first member tells which node it has one step deeper than the centroid.

Rows come in order of turn (null first), then digest. A null role or text is empty. Rows without a
conv_id take no part. Rows that repeat are turns of their own. Other columns are left out. A conversation's
digests are one task's sorted stream of short rows. Without conversations there is no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.store import write_table

#: Weight up to which one task finishes a component.
SMALL = 1 << 12
#: Ids of conversations in one row on their way to a node's digest.
CHUNK = 4096
ROOT = bytes(16)
_TURN = "conv_id long, depth long, bytes long, key binary, parent binary, below long"


def turn_digests(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, said, bytes) of rows (conv_id, turn, role, text): the digest of role and text, and the text's bytes."""
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    role, text = empty("role"), empty("text")
    said = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        said.alias("said"), F.octet_length(text).cast("long").alias("bytes"),
    )
    return rows.filter("conv_id is not null")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, said, bytes), places from 0."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "said")
    return turns.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("place"), "said", "bytes")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each conversation; its first row, with a null digest, stands for the root."""
    conv_id, key, depth = None, ROOT, 0
    for batch in batches:
        depths, keys, parents = [], [], []
        for conv, said in zip(batch["conv_id"].to_pylist(), batch["said"].to_pylist(), strict=True):
            if conv != conv_id:
                conv_id, key, depth = conv, ROOT, 0
            parents.append(key if said is not None else None)
            if said is not None:
                key, depth = hashlib.blake2b(key + said, digest_size=16).digest(), depth + 1
            depths.append(depth)
            keys.append(key)
        depths = pa.array(depths, pa.int64())
        below = np.asarray(batch["n"].to_numpy(zero_copy_only=False)) - depths.to_numpy()
        yield pa.record_batch(
            {
                "conv_id": batch["conv_id"], "depth": depths, "bytes": batch["bytes"], "key": pa.array(keys, pa.binary()),
                "parent": pa.array(parents, pa.binary()), "below": pa.array(below, pa.int64()),
            }
        )


def prefixes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, bytes, key, parent, below) of all first turns of conversations, a row for the root in each.

    turns: (conv_id, place, said, bytes). conversations: distinct conv_id, also of those without turns.
    below: how many turns the conversation has from this depth on, and one for its end.
    """
    roots = conversations.selectExpr("conv_id", "-1L as place", "cast(null as binary) as said", "0L as bytes")
    rows = turns.select("conv_id", "place", "said", "bytes").union(roots).repartition("conv_id")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    return rows.sortWithinPartitions("conv_id", "place").drop("place").mapInArrow(_chained, _TURN)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of sorted rows (key, conv_id), joined by commas, up to CHUNK of them in a row."""
    key, ids = None, []
    done: list[tuple] = []

    def take() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 3
        done.clear()
        kinds = (pa.binary(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "first", "ids"])

    for batch in batches:
        for own, conv in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if own != key or len(ids) == CHUNK:
                if ids:
                    done.append((key, ids[0], ",".join(map(str, ids))))
                key, ids = own, []
                if len(done) >= 1000:
                    yield take()
            ids.append(conv)
    if ids:
        done.append((key, ids[0], ",".join(map(str, ids))))
    yield take()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each key of sorted rows (key, ids)."""
    key, digest = None, None
    for batch in batches:
        keys, found = [], []
        for own, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if own == key:
                digest.update(b",")
            else:
                if key is not None:
                    keys.append(key), found.append(digest.hexdigest())
                key, digest = own, hashlib.sha256()
            digest.update(ids.encode())
        if keys:
            yield pa.record_batch({"key": pa.array(keys, pa.binary()), "ends_sha256": pa.array(found, pa.string())})
    if key is not None:
        yield pa.record_batch({"key": pa.array([key], pa.binary()), "ends_sha256": pa.array([digest.hexdigest()], pa.string())})


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of rows (key, conv_id): SHA-256 of the ids, ascending, joined by commas.

    Ids are joined in pieces by the task that has their range, so one task reads a common key's pieces, not its rows.
    """
    pieces = ends.repartitionByRange("conv_id").sortWithinPartitions("key", "conv_id").select("key", "conv_id")
    pieces = pieces.mapInArrow(_joined, "key binary, first long, ids string")
    ordered = pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "ids")
    return ordered.mapInArrow(_digests, "key binary, ends_sha256 string")


def _finished(names: list[str]):
    """Sums over the subtrees of components that come whole, deepest nodes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def finish(table: pa.Table) -> pa.RecordBatch:
            keys, parents = table["key"].to_pylist(), table["parent"].to_pylist()
            place = {key: k for k, key in enumerate(keys)}
            up = np.array([place.get(x, -1) for x in parents])
            depth = table["depth"].to_numpy()
            sums = [table[name].to_numpy().copy() for name in names]
            order = np.argsort(-depth, kind="stable")
            cuts = np.flatnonzero(np.diff(depth[order])) + 1
            for level in np.split(order, cuts):
                level = level[up[level] >= 0]
                for own in sums:
                    np.add.at(own, up[level], own[level])
            return pa.record_batch({"key": table["key"].combine_chunks(), **dict(zip(names, map(pa.array, sums), strict=True))})

        last = None
        for batch in batches:
            comps = batch["comp"].to_pylist()
            cut = 0
            for k, comp in enumerate(comps):
                if comp != last:
                    last = comp
                    if size + k - cut >= 4 * SMALL:  # a component begins here
                        held.append(batch.slice(cut, k - cut))
                        yield finish(pa.Table.from_batches(held))
                        held, size, cut = [], 0, k
            held.append(batch.slice(cut))
            size += len(comps) - cut
        if size:
            yield finish(pa.Table.from_batches(held))

    return run


def subtree_sums(nodes: DataFrame, paths: DataFrame, names: list[str], small: int = SMALL) -> DataFrame:
    """(key, names) of all nodes: the sums of columns over their subtrees.

    nodes: (key, parent, conv_id, depth, weight, names), conv_id the first member, weight what is under the node.
    paths: (conv_id, depth, key, parent) of all members.
    """
    sums = [F.sum(name).alias(name) for name in names]
    open_ = write_table(nodes.select("key", "parent", "conv_id", "depth", "weight", *names, F.lit(ROOT).alias("comp")), "component")
    added = []  # tables of (key, names)
    while True:
        totals = write_table(open_.groupBy("comp").agg(F.max("weight").alias("total"), F.min("depth").alias("top")), "totals")
        large = totals.filter(F.col("total") > small)
        done = open_.join(totals.filter(F.col("total") <= small).select("comp"), "comp", "left_semi")
        finished = done.select("comp", "key", "parent", "depth", *names).repartition("comp").sortWithinPartitions("comp")
        kinds = ", ".join(["key binary", *[f"{name} long" for name in names]])
        added.append(write_table(finished.mapInArrow(_finished(names), kinds), "sums"))
        if large.isEmpty():
            break
        active = open_.join(large, "comp")
        centre = F.max(F.struct("depth", "key", "conv_id", "weight")).alias("centre")
        centres = active.filter("2 * weight >= total").groupBy("comp", "top").agg(centre)
        centres = centres.select(
            "comp", "top", F.col("centre.key").alias("c_key"), F.col("centre.conv_id").alias("c_conv"),
            F.col("centre.depth").alias("c_depth"), F.col("centre.weight").alias("c_weight"),
        )
        centres = write_table(centres, "centroids")
        # the child of the centroid on each node's way up, if it is under the centroid
        placed = open_.join(centres.select("comp", "c_key", "c_depth", "c_weight"), "comp")
        step = paths.select(F.col("conv_id").alias("p_conv"), F.col("depth").alias("p_depth"), F.col("key").alias("child"), F.col("parent").alias("p_parent"))
        at = (F.col("conv_id") == F.col("p_conv")) & (F.col("c_depth") + 1 == F.col("p_depth")) & (F.col("depth") > F.col("c_depth")) & (F.col("p_parent") == F.col("c_key"))
        placed = placed.join(step, at, "left").drop("p_conv", "p_depth", "p_parent")
        placed = write_table(placed.withColumn("at", F.col("key") == F.col("c_key")), "placed")
        under = placed.filter("child is not null or at").groupBy("comp").agg(*sums)
        # from the centroid up to the component's top
        way = paths.select("conv_id", "depth", "key").join(
            centres.select(F.col("c_conv").alias("conv_id"), "comp", "top", "c_depth", "c_weight"), "conv_id"
        )
        way = write_table(way.filter("depth between top and c_depth").select("comp", "key", "c_weight"), "way")
        added.append(write_table(way.join(under, "comp").select("key", *names), "sums"))
        lighter = way.select(F.col("key"), F.col("c_weight").alias("less"))
        rest = placed.filter("child is null and not at").join(lighter, "key", "left")
        rest = rest.withColumn("weight", F.col("weight") - F.coalesce("less", F.lit(0)))
        own = ["key", "parent", "conv_id", "depth", "weight", *names]
        below = placed.filter("child is not null").select(*own, F.col("child").alias("comp"))
        open_ = write_table(rest.select(*own, "comp").unionByName(below), "component")
    both = added[0]
    for table in added[1:]:
        both = both.unionByName(table)
    return both.groupBy("key").agg(*sums)


def prefix_trie(turns: DataFrame, conversations: DataFrame, small: int = SMALL) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    conv_id: the smallest member; parent_conv_id: that of the parent, null for the root. n_leaves: nodes
    without children in the subtree. saved_tokens: over the subtree, bytes of a node's last text for each
    member but one. ends_sha256: of the members that end here. Arguments as for prefixes().
    """
    paths = write_table(prefixes(turns, conversations), "prefixes")
    nodes = paths.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("below").alias("weight"),
        F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("bytes").alias("bytes"),
    )
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes"))
    nodes = write_table(nodes.drop("bytes"), "nodes")
    names = ["n_leaves", "saved_tokens"]
    sums = subtree_sums(nodes, paths.select("conv_id", "depth", "key", "parent"), names, small)
    ends = end_digests(paths.filter("below = 1").select("key", "conv_id"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    rows = nodes.drop(*names).join(sums, "key").join(ends, "key", "left").join(parents, "parent", "left")
    none = F.lit(hashlib.sha256().hexdigest())
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def rebuilt(turns: DataFrame, ids: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, place, said, bytes): first turns of the conversation c - c % group, then a conversation's own ones.

    turns: (conv_id, place, said, bytes); ids: distinct conv_id. Of either, h = crc32(c) % most turns are changed.
    """
    head = lambda name: F.crc32(F.col(name).cast("string").cast("binary")) % most
    own = turns.filter((F.col("conv_id") % group == 0) | (F.col("place") >= head("conv_id")))
    heads = turns.filter((F.col("conv_id") % group == 0) & (F.col("place") < most - 1))
    takers = ids.filter(F.col("conv_id") % group != 0).select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    taken = heads.withColumnRenamed("conv_id", "base").join(takers, "base").filter(F.col("place") < head("conv_id"))
    return own.unionByName(taken.select("conv_id", "place", "said", "bytes"))
