"""Repair of the turns of conversations at least cost, by Viterbi with coalescing survivors.

A conversation's rows are kept, deleted or given another role, and rows without text are inserted, so
that its roles become an optional system turn and then user and assistant in turn, or nothing at all.
For each role that may stand last there is one survivor, the cheapest edits so far; of equal costs the
one whose edits' initials come first in ASCII. Survivors are leaves of a tree of backpointers. Each node
counts what refers to it and goes when nothing does; as soon as all survivors share an ancestor, the
edits up to it are put out and forgotten, so memory holds only what is still open. A tie is decided on
the whole open paths of both: where they part is found through skip pointers, in logarithmic time.

Faults: a row without a character but white space is blank, one whose role and text an earlier row has is
a duplicate, and one whose last such character ends no sentence is truncated; the first of these counts.
Blank rows and duplicates are always deleted.

Rows come in order of turn (null first), then role and text. Rows of a conversation are one task's
sorted stream, since its digest is; nothing of it is collected but what is open, and duplicates
are told by a window over (conversation, role, text).

Inputs: a null role or text is one space. Rows whose conv_id is null are one conversation. A conversation
without rows (all of them lost) has zeros, an empty audit and the digest of an empty text. Other columns are
left out. An empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
#: What an undeleted truncated row adds.
CUT_COST = 3
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)

#: Role that stands last: none yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Role that may come next, as (state, name), beside a system turn that was kept at the start.
_NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
_LEGAL_PAIRS = {"su", "ua", "au"}
_SPACE = "\\x20\\x09-\\x0D"

SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"


class _Node:
    """One edit of a path; row is what it puts out, None for a deletion."""

    __slots__ = ("parent", "edit", "row", "depth", "skip", "children", "held")

    def __init__(self, parent: _Node | None, edit: str, row: tuple[str, str] | None) -> None:
        self.parent, self.edit, self.row = parent, edit, row
        self.children: dict[str, _Node] = {}
        self.held = 0  # survivors that end here
        if parent is None:
            self.depth, self.skip = 0, self
        else:
            self.depth = parent.depth + 1
            near, far = parent.skip, parent.skip.skip
            self.skip = far if parent.depth - near.depth == near.depth - far.depth else parent

    def child(self, edit: str, row: tuple[str, str] | None) -> _Node:
        if edit not in self.children:
            self.children[edit] = _Node(self, edit, row)
        return self.children[edit]


def _raised(node: _Node, depth: int) -> _Node:
    """The ancestor at a depth."""
    while node.depth > depth:
        node = node.skip if node.skip.depth >= depth else node.parent
    return node


def _before(x: _Node, y: _Node) -> bool:
    """Whether the edits up to x come before those up to y in ASCII order."""
    depth = min(x.depth, y.depth)
    a, b = _raised(x, depth), _raised(y, depth)
    if a is b:
        return x.depth < y.depth
    while a.parent is not b.parent:
        a, b = (a.skip, b.skip) if a.skip is not b.skip and a.depth == b.depth and a.skip.depth == b.skip.depth else (a.parent, b.parent)
    return a.edit < b.edit


class Repair:
    """Cheapest edits of one conversation, given row by row; add() and finish() return the edits that are settled."""

    def __init__(self) -> None:
        self.root = _Node(None, "", None)
        self.alive: dict[int, tuple[int, _Node]] = {}
        self._put(self.alive, START, 0, self.root)
        self.open = 0  # most nodes that a path had open

    def _put(self, found: dict[int, tuple[int, _Node]], state: int, cost: int, node: _Node) -> None:
        node.held += 1
        known = found.get(state)
        found[state] = cost, node
        if known is not None:
            self._drop(known[1])

    def _drop(self, node: _Node) -> None:
        node.held -= 1
        self._free(node)

    def _free(self, node: _Node) -> None:
        while node.held == 0 and not node.children and node.parent is not None:
            parent, node.parent = node.parent, None
            del parent.children[node.edit]
            node = parent

    def _offer(self, found: dict[int, tuple[int, _Node]], state: int, cost: int, before: _Node, edit: str, row: tuple[str, str] | None) -> None:
        """Let an edit after a node survive if it is the cheapest, or of these the first, for its state."""
        known = found.get(state)
        if known is not None and known[0] < cost:
            return
        node = before.child(edit, row)
        if known is None or cost < known[0] or (node is not known[1] and _before(node, known[1])):
            self._put(found, state, cost, node)
        else:
            self._free(node)

    def _insert(self, found: dict[int, tuple[int, _Node]]) -> None:
        """Let inserted rows follow; two at most, since a third stands where the first did."""
        for _ in range(2):
            for state in list(found):
                cost, node = found[state]
                to, role = _NEXT[state]
                self._offer(found, to, cost + COSTS[INSERT], node, INSERT, (role, ""))

    def _prune(self, found: dict[int, tuple[int, _Node]]) -> None:
        """Drop survivors that another one beats whatever follows: it can do all they can, at most with one deletion more."""
        best = found.get(ASSISTANT, (1 << 62,))[0]
        for state, more in ((START, COSTS[DELETE]), (SYSTEM, 0)):
            if state in found and found[state][0] > best + more:
                self._drop(found.pop(state)[1])

    def add(self, role: str, text: str, fault: int) -> list[_Node]:
        self._insert(self.alive)
        found: dict[int, tuple[int, _Node]] = {}
        extra = CUT_COST if fault == TRUNCATED else 0
        for state, (cost, node) in self.alive.items():
            self._offer(found, state, cost + COSTS[DELETE], node, DELETE, None)
            if fault in (BLANK, DUPLICATE):
                continue
            to, name = _NEXT[state]
            self._offer(found, to, cost + COSTS[REROLE] + extra, node, REROLE, (name, text))
            if role[:1] == name[0]:
                self._offer(found, to, cost + extra, node, KEEP, (role, text))
            if state == START and role[:1] == "s":
                self._offer(found, SYSTEM, cost + extra, node, KEEP, (role, text))
        self._prune(found)
        old, self.alive = self.alive, found
        for _, node in old.values():
            self._drop(node)
        return self._settled()

    def _settled(self) -> list[_Node]:
        """Take the edits off that all survivors share."""
        out = []
        while not self.root.held and len(self.root.children) == 1:
            (child,) = self.root.children.values()
            self.root.children.clear()
            child.parent = None
            self.root = child
            out.append(child)
        if self.alive:
            self.open = max(self.open, max(node.depth for _, node in self.alive.values()) - self.root.depth)
        return out

    def finish(self) -> tuple[list[_Node], int]:
        """The last edits, and the cost of all."""
        found = self.alive
        self._insert(found)
        ends = [found[state] for state in (START, ASSISTANT) if state in found]
        cost, best = ends[0]
        for other, node in ends[1:]:
            if other < cost or (other == cost and _before(node, best)):
                cost, best = other, node
        out = []
        while best is not self.root:
            out.append(best)
            best = best.parent
        out.reverse()
        return out, cost


class _Conversation:
    """What is known of the conversation whose rows are coming."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.repair = conv_id, Repair()
        self.counts = [0, 0, 0, 0]
        self.first = self.last_turn = None
        self.turns = self.illegal = self.place = 0
        self.last_role: str | None = None
        self.audit: list[str] = []
        self.digest, self.begun = hashlib.sha256(), False

    def add(self, turn: int | None, role: str, text: str, fault: int) -> list[_Node]:
        self.counts[fault] += 1
        if turn is not None and turn != self.last_turn:
            self.first = turn if self.first is None else self.first
            self.last_turn, self.turns = turn, self.turns + 1
        if self.last_role is not None and self.last_role[:1] + role[:1] not in _LEGAL_PAIRS:
            self.illegal += 1
        self.last_role = role
        return self.repair.add(role, text, fault)

    def settle(self, nodes: list[_Node]) -> None:
        for node in nodes:
            self.audit.append(node.edit)
            if node.row is not None:
                self.digest.update((("\n" if self.begun else "") + f"{node.row[0]}:{node.row[1]}").encode())
                self.begun = True
            node.row = None
        if len(self.audit) > 4096:
            self.audit = ["".join(self.audit)]

    def summary(self, cost: int) -> tuple:
        gaps = 0 if self.first is None else self.last_turn - self.first + 1 - self.turns
        return (self.conv_id, gaps, *self.counts[1:], self.illegal, cost, "".join(self.audit), self.digest.hexdigest())


def marked_rows(rows: DataFrame, lost_col: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text, lost, fault) sorted by conversation and turn, a conversation in one partition."""
    text_or_space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    lost = F.coalesce(F.col(lost_col), F.lit(False)) if lost_col else F.lit(False)
    own = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        text_or_space("role"), text_or_space("text"), lost.alias("lost"),
    )
    own = own.withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    own = own.repartition("conv_id")
    # lost rows come last, so that they are no earlier rows; the same shuffle serves the window and the order of turns
    same = Window.partitionBy("conv_id", "said").orderBy(F.col("lost"), F.col("turn").asc_nulls_first())
    again = F.row_number().over(same) > 1
    fault = (
        F.when(~F.col("text").rlike(f"[^{_SPACE}]"), BLANK)
        .when(F.col("again"), DUPLICATE)
        .when(~F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1).isin(".", "!", "?"), TRUNCATED)
        .otherwise(NO_FAULT)
    )
    own = own.withColumn("again", again).withColumn("fault", fault)
    own = own.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "again")
    return own.drop("said", "again")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, list[_Node], int | None]]:
    """Settled edits as they come, and with the last of a conversation the cost of all."""
    own: _Conversation | None = None
    for batch in batches:
        for conv_id, turn, role, text, lost, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own is None or own.conv_id != conv_id:
                if own is not None:
                    yield own, *own.repair.finish()
                own = _Conversation(conv_id)
            if not lost:
                nodes = own.add(turn, role, text, fault)
                if nodes:
                    yield own, nodes, None
    if own is not None:
        yield own, *own.repair.finish()


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    for own, nodes, cost in _conversations(batches):
        own.settle(nodes)
        if cost is not None:
            done.append(own.summary(cost))
            if len(done) >= 2000:
                yield _columns(done, SUMMARY)
                done.clear()
    yield _columns(done, SUMMARY)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    size = 0
    for own, nodes, _ in _conversations(batches):
        for node in nodes:
            if node.row is not None:
                done.append((own.conv_id, own.place, node.edit, *node.row))
                own.place += 1
                size += 50 + len(node.row[1])
                node.row = None
        if size > 4_000_000:
            yield _columns(done, TURNS)
            done.clear()
            size = 0
    yield _columns(done, TURNS)


def audit_conversations(rows: DataFrame, lost_col: str | None = None) -> DataFrame:
    """SUMMARY of every conversation. lost_col: rows where it is true are gone, but their conversation is still there."""
    return marked_rows(rows, lost_col).mapInArrow(_summaries, SUMMARY)


def repair_conversations(rows: DataFrame, lost_col: str | None = None) -> DataFrame:
    """The repaired turns, numbered from 0 in each conversation, with the edit that each comes from (K, R or I)."""
    return marked_rows(rows, lost_col).mapInArrow(_turns, TURNS)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with faults put in by a hash of conversation and turn, and whether each is lost."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    copies = F.explode(F.array_repeat(F.lit(0), times))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("lost"), copies.alias("copy")).drop("copy")
