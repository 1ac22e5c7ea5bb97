"""Chat formatting: a small template language, compiled to closures, that marks what is generated.

A template holds text, `{{ expression }}` and `{% statement %}`; a `-` inside a bracket strips the
white space beside it. Statements: `for x in y`, `if`, `elif`, `else`, `set x = y`, `generation` and
their ends. Expressions: literals, names, `a.b`, `a['b']`, `+`, `==`, `!=`, `<`, `>`, `in`, `not`,
`and`, `or`, brackets, and the filters of FILTERS (`a | trim`). There are no calls, and names and
members are only looked up in the values given and in mappings and lists, never as attributes of
Python objects: a template can't reach anything else. Unknown names and members are empty.

compile_template() parses to a tree, computes the parts without names once, drops branches that they
decide, and joins neighbouring texts; what is left becomes one Python closure for each node.

The filter escape breaks each control string in a text by a mark after its first character and doubles
the mark's own character, so that a text never holds a control string, and unescape() gives it back.

format_conversations(): rows are turns; they are put in order by turn, role and text. Null texts and
roles are empty, and null turns come first; a null conv_id is a conversation of its own. Repeated rows
are repeated turns. Other columns aren't read. A formatted conversation is one value, and a task holds
one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "\\"
CONTROLS = ("<|turn|>", "<|text|>", "<|end|>", "</s>", "[INST]", "[/INST]")
#: One turn after another: its role, its text, and the text of an assistant as what is generated.
TEMPLATE = """\
{%- set sign = '<|' -%}
{%- for message in messages -%}
{{ sign + 'turn|>' }}{{ message.role | escape }}{{ '<|text|>' }}
{%- if message.role == 'assistant' -%}
{% generation %}{{ message.text | escape }}{% endgeneration %}
{%- else -%}
{{ message.text | escape }}
{%- endif -%}
<|end|>
{%- endfor -%}
"""


def control_pattern(controls: tuple[str, ...]) -> re.Pattern:
    """Checks control strings and finds them in texts."""
    for c in controls:
        if len(c) < 2 or MARK in c:
            raise ValueError(f"a control string has two characters at least and no {MARK}: {c!r}")
        for d in controls:  # else the end of a text and the control after it could look like another control
            if any(d.startswith(c[k:]) for k in range(1, len(c))):
                raise ValueError(f"{c!r} ends as {d!r} begins")
    return re.compile("|".join(map(re.escape, sorted(controls, key=len, reverse=True))))


def escaper(controls: tuple[str, ...] = CONTROLS) -> Callable[[Any], str]:
    found = re.compile(f"(?=(?:{control_pattern(controls).pattern}))(.)", re.S)
    return lambda text: found.sub(rf"\1{MARK}{MARK}-", str(text).replace(MARK, MARK * 2))


def unescape(text: str) -> str:
    return re.sub(r"\\([\\-])", lambda m: MARK if m[1] == MARK else "", text)


class Node(NamedTuple):
    """A node of the tree: its kind, and what it holds."""

    kind: str
    parts: tuple


_BRACKETS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKENS = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[-+<>().|,\[\]=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": lambda x: len(x) if hasattr(x, "__len__") else 0,
    "string": str,
}
_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "+": lambda a, b: a + b,
    "in": lambda a, b: a in b,
}


def _member(value: Any, key: Any) -> Any:
    if isinstance(value, Mapping):
        return value.get(key, "")
    if isinstance(value, (list, tuple, str)) and type(key) is int and -len(value) <= key < len(value):
        return value[key]
    return ""


class _Expression:
    """Parser of one expression."""

    def __init__(self, source: str) -> None:
        self.source, self.tokens, at = source, [], 0
        source = source.strip()
        while at < len(source):
            found = _TOKENS.match(source, at)
            if not found:
                raise SyntaxError(f"what is {source[at:]!r} in {source!r}?")
            kind = found.lastindex
            self.tokens.append((kind, found[kind]))
            at = found.end()

    def next(self, *values: str) -> str | None:
        """Take the next token if it is one of these signs or words."""
        if self.tokens and self.tokens[0][0] > 2 and self.tokens[0][1] in values:
            return self.tokens.pop(0)[1]
        return None

    def need(self, value: str) -> None:
        if not self.next(value):
            raise SyntaxError(f"{value!r} is missing in {self.source!r}")

    def name(self) -> str:
        if not self.tokens or self.tokens[0][0] != 3:
            raise SyntaxError(f"a name is missing in {self.source!r}")
        return self.tokens.pop(0)[1]

    def end(self) -> None:
        if self.tokens:
            raise SyntaxError(f"{self.tokens[0][1]!r} is too much in {self.source!r}")

    def either(self) -> Node:
        left = self.both()
        while self.next("or"):
            left = Node("or", (left, self.both()))
        return left

    def both(self) -> Node:
        left = self.negated()
        while self.next("and"):
            left = Node("and", (left, self.negated()))
        return left

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.next("not") else self.compared()

    def compared(self) -> Node:
        left = self.added()
        while sign := self.next("==", "!=", "<", ">", "in"):
            left = Node("binary", (sign, left, self.added()))
        return left

    def added(self) -> Node:
        left = self.filtered()
        while self.next("+"):
            left = Node("binary", ("+", left, self.filtered()))
        return left

    def filtered(self) -> Node:
        node = self.single()
        while True:
            if self.next("."):
                node = Node("member", (node, Node("value", (self.name(),))))
            elif self.next("["):
                node = Node("member", (node, self.either()))
                self.need("]")
            elif self.next("|"):
                node = Node("filter", (self.name(), node))
            else:
                return node

    def single(self) -> Node:
        if self.next("("):
            node = self.either()
            self.need(")")
            return node
        if not self.tokens:
            raise SyntaxError(f"{self.source!r} ends too soon")
        kind, text = self.tokens.pop(0)
        if kind == 1:
            return Node("value", (re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S),))
        if kind == 2:
            return Node("value", (int(text),))
        if kind == 3:
            constants = {"true": True, "false": False, "none": None}
            return Node("value", (constants[text],)) if text in constants else Node("name", (text,))
        raise SyntaxError(f"{text!r} stands wrong in {self.source!r}")


def parse(source: str) -> Node:
    """The tree of a template."""
    parts = _BRACKETS.split(source)
    for k in range(1, len(parts), 2):
        if parts[k][2] == "-":
            parts[k - 1] = parts[k - 1].rstrip()
        if parts[k][-3] == "-":
            parts[k + 1] = parts[k + 1].lstrip()
    pieces = [(k % 2 == 1, x) for k, x in enumerate(parts) if x and not x.startswith("{#")]

    def block(*ends: str) -> tuple[Node, str]:
        nodes = []
        while pieces:
            is_code, piece = pieces.pop(0)
            if not is_code:
                nodes.append(Node("text", (piece,)))
                continue
            words = _Expression(piece[2:-2].strip("-"))
            if piece[1] == "{":
                nodes.append(Node("print", (words.either(),)))
                words.end()
                continue
            word = words.name()
            if word in ends:
                if word == "elif":
                    pieces.insert(0, (True, "{% if " + piece[2:-2].strip("-").strip()[4:] + " %}"))
                else:
                    words.end()
                return Node("block", tuple(nodes)), word
            if word == "for":
                name = words.name()
                words.need("in")
                value = words.either()
                nodes.append(Node("for", (name, value, block("endfor")[0])))
            elif word == "if":
                test = words.either()
                yes, end = block("elif", "else", "endif")
                no = Node("block", ())
                if end == "else":
                    no, _ = block("endif")
                elif end == "elif":
                    no = chain()
                nodes.append(Node("if", (test, yes, no)))
            elif word == "set":
                name = words.name()
                words.need("=")
                nodes.append(Node("set", (name, words.either())))
            elif word == "generation":
                nodes.append(Node("generation", (block("endgeneration")[0],)))
            else:
                raise SyntaxError(f"what is {piece!r}?")
            words.end()
        if ends:
            raise SyntaxError(f"{ends[-1]} is missing")
        return Node("block", tuple(nodes)), ""

    def chain() -> Node:
        """An elif, which shares its end with the if before it."""
        words = _Expression(pieces.pop(0)[1][2:-2])
        words.name()
        test = words.either()
        words.end()
        yes, end = block("elif", "else", "endif")
        no = block("endif")[0] if end == "else" else chain() if end == "elif" else Node("block", ())
        return Node("if", (test, yes, no))

    return block()[0]


def fold(node: Node, filters: Mapping[str, Callable], known: Mapping[str, Any] | None = None) -> Node:
    """The tree with what is constant computed; known: values of names that are set once, to a constant."""
    known = known or {}
    kind, parts = node
    again = lambda x: fold(x, filters, known) if isinstance(x, Node) else x
    if kind == "name" and parts[0] in known:
        return Node("value", (known[parts[0]],))
    parts = tuple(map(again, parts))
    node = Node(kind, parts)
    if kind == "filter" and parts[0] not in filters:
        raise SyntaxError(f"there is no filter {parts[0]}")
    if kind in ("not", "and", "or", "binary", "member", "filter"):
        if all(x.kind == "value" for x in parts if isinstance(x, Node)):
            return Node("value", (_value(node, filters)({}),))
    elif kind == "print" and parts[0].kind == "value":
        return Node("text", (_shown(parts[0].parts[0]),))
    elif kind == "if" and parts[0].kind == "value":
        return parts[1] if parts[0].parts[0] else parts[2]
    elif kind == "block":
        flat: list[Node] = []
        for x in parts:
            for y in x.parts if x.kind == "block" else (x,):
                if y.kind == "text" and flat and flat[-1].kind == "text":
                    flat[-1] = Node("text", (flat[-1].parts[0] + y.parts[0],))
                elif y.kind != "text" or y.parts[0]:
                    flat.append(y)
        return Node("block", tuple(flat))
    return node


def _constants(tree: Node) -> dict[str, Any]:
    """Names that are set at the top of a template, before all else but text, to a literal, and nowhere else."""
    bound: list[str] = []

    def walk(node: Node) -> None:
        if node.kind in ("set", "for"):
            bound.append(node.parts[0])
        for x in node.parts:
            if isinstance(x, Node):
                walk(x)

    walk(tree)
    out = {}
    for node in tree.parts:
        if node.kind == "set" and node.parts[1].kind == "value" and bound.count(node.parts[0]) == 1:
            out[node.parts[0]] = node.parts[1].parts[0]
        elif node.kind != "text":
            break
    return out


def _shown(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _value(node: Node, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    """A closure that computes an expression from the names' values."""
    kind, parts = node
    if kind == "value":
        return lambda names, x=parts[0]: x
    if kind == "name":
        return lambda names, x=parts[0]: names.get(x, "")
    inner = [_value(x, filters) for x in parts if isinstance(x, Node)]
    if kind == "not":
        return lambda names, f=inner[0]: not f(names)
    if kind == "and":
        return lambda names, f=inner[0], g=inner[1]: f(names) and g(names)
    if kind == "or":
        return lambda names, f=inner[0], g=inner[1]: f(names) or g(names)
    if kind == "member":
        return lambda names, f=inner[0], g=inner[1]: _member(f(names), g(names))
    if kind == "filter":
        return lambda names, f=inner[0], do=filters[parts[0]]: do(f(names))
    return lambda names, f=inner[0], g=inner[1], do=_BINARY[parts[0]]: do(f(names), g(names))


class Output:
    """Text as it grows, its length in code points, and the spans that are generated."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


Run = Callable[[dict, Output], None]


def _run(node: Node, filters: Mapping[str, Callable]) -> Run:
    """A closure that puts out a statement."""
    kind, parts = node
    if kind == "text":
        return lambda names, out, x=parts[0]: out.write(x)
    if kind == "print":
        return lambda names, out, f=_value(parts[0], filters): out.write(_shown(f(names)))
    if kind == "block":
        steps = [_run(x, filters) for x in parts]

        def block(names: dict, out: Output) -> None:
            for step in steps:
                step(names, out)

        return block
    if kind == "set":
        return lambda names, out, x=parts[0], f=_value(parts[1], filters): names.__setitem__(x, f(names))
    if kind == "if":
        test, yes, no = _value(parts[0], filters), _run(parts[1], filters), _run(parts[2], filters)
        return lambda names, out: (yes if test(names) else no)(names, out)
    if kind == "generation":
        inner = _run(parts[0], filters)

        def generation(names: dict, out: Output) -> None:
            start = out.length
            inner(names, out)
            out.spans.append((start, out.length))

        return generation
    name, values, body = parts[0], _value(parts[1], filters), _run(parts[2], filters)

    def loop(names: dict, out: Output) -> None:
        rows = values(names)
        if not isinstance(rows, (list, tuple)):
            raise TypeError("for needs a list")
        for k, row in enumerate(rows):  # a loop's names end with it
            body({**names, name: row, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": k == len(rows) - 1}}, out)

    return loop


def compile_template(source: str, controls: tuple[str, ...] = CONTROLS) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from names' values to the text and its generated spans (code points, end exclusive)."""
    filters = FILTERS | {"escape": escaper(controls)}
    tree = fold(parse(source), filters)
    run = _run(fold(tree, filters, _constants(tree)), filters)

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run(dict(names), out)
        return "".join(out.parts), out.spans

    return render


def format_conversations(rows: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """(conv_id, formatted, generated: array of (start, end)) of each conversation of (conv_id, turn, role, text)."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, controls)
        done: list[tuple] = []
        held, turns, size = None, [], 0

        def finish() -> None:
            text, found = render({"messages": turns})
            done.append((held, text, [{"start": a, "end": b} for a, b in found]))

        def take() -> pa.RecordBatch:
            ids, texts, found = list(zip(*done, strict=True)) or [[], [], []]
            done.clear()
            return pa.record_batch({"conv_id": pa.array(ids, pa.int64()), "formatted": pa.array(texts, pa.string()), "generated": pa.array(found, spans)})

        for batch in batches:
            for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if turns and conv != held:
                    finish()
                    size += len(done[-1][1])
                    turns = []
                    if size > 4_000_000:
                        yield take()
                        size = 0
                held = conv
                turns.append({"role": role, "text": text})
        if turns:
            finish()
        if done:
            yield take()

    own = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    own = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return own.mapInArrow(run, "conv_id long, formatted string, generated array<struct<start:long,end:long>>")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a text that TEMPLATE formatted, unescaped."""
    out = []
    for turn in formatted.split("<|turn|>")[1:]:
        role, text = turn.split("<|text|>")
        out.append((unescape(role), unescape(text.removesuffix("<|end|>"))))
    return out
