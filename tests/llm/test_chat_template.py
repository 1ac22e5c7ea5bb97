import random

import duckdb
import pytest

from check import compare
from veilscan.llm import chat_template as C
from veilscan.llm import queries

SF = "/root/testdata/sf0.001"


def render(source, **names):
    return C.compile_template(source)(names)[0]


def test_language():
    assert render("a{{ 1 + 2 }}{{ 'x' + y | upper }}{# no #}", y="z") == "a3xZ"
    assert render("{% for x in xs %}{{ loop.index }}{{ x.a }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"a": 1}, {"a": None}]) == "11,2"
    source = "{% if a == 1 %}one{% elif a in [] %}no{% elif a == 2 %}two{% else %}more{% endif %}."
    with pytest.raises(SyntaxError):
        C.compile_template(source)
    source = source.replace("in []", "== 'b'")
    assert [render(source, a=a) for a in (1, 2, 3, "b")] == ["one.", "two.", "more.", "no."]
    assert render("{% set b = a['k'] %} {{- b | trim -}} !", a={"k": " v "}) == "v!"
    assert render("{{ a.b.c }}{{ a[0] }}{{ none }}", a="xy") == "x"
    assert render("{{ (a and b) or 'c' }}", a=True, b="") == "c"


def test_sandbox():
    assert render("{{ a.__class__ }}{{ a.upper }}{{ a['__class__'] }}", a="x") == ""
    for bad in ("{{ a() }}", "{{ a.b( }}", "{% import os %}", "{{ a | eval }}", "{% for x in %}{% endfor %}", "{% if a %}", "{{ 'a }}", "{% endif %}"):
        with pytest.raises(SyntaxError):
            C.compile_template(bad)


def test_folding():
    filters = C.FILTERS | {"escape": C.escaper()}
    tree = C.fold(C.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}no{{ x }}{% else %}yes{% endif %}{{ x }}"), filters)
    assert [n.kind for n in tree.parts] == ["text", "print"] and tree.parts[0].parts == ("abCyes",)


def test_generation_spans():
    text, spans = C.compile_template("é{% generation %}{{ x }}{% endgeneration %}-{% generation %}{% endgeneration %}")({"x": "ab"})
    assert (text, spans) == ("éab-", [(1, 3), (4, 4)])


def test_escapes_are_reversible():
    escape, find = C.escaper(), C.control_pattern(C.CONTROLS)
    parts = [*C.CONTROLS, "\\", "\\-", "-", "<", "|", "<|", "[", "/", "INST]", "x", "\n", "é"]
    for seed in range(3000):
        r = random.Random(seed)
        text = "".join(r.choice(parts) for _ in range(r.randrange(8)))
        assert C.unescape(escape(text)) == text and not find.search(escape(text))
    with pytest.raises(ValueError):
        C.control_pattern(("ab", "ba"))


def test_conversations(spark):
    rows = [(1, 1, "assistant", "<|end|>b"), (1, 0, "user", "a\\"), (2, 0, None, None), (None, 0, "assistant", "x"), (1, 1, "assistant", "<|end|>b"), (3, None, "<|turn|>", "</s>")]
    df = spark.createDataFrame([(*x, "more") for x in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    got = {x.conv_id: x for x in C.format_conversations(df).collect()}
    assert C.read_turns(got[1].formatted) == [("user", "a\\"), ("assistant", "<|end|>b"), ("assistant", "<|end|>b")]
    assert [C.unescape(got[1].formatted[s.start : s.end]) for s in got[1].generated] == ["<|end|>b"] * 2
    assert C.read_turns(got[2].formatted) == [("", "")] and not got[2].generated
    assert C.read_turns(got[3].formatted) == [("<|turn|>", "</s>")]
    assert C.read_turns(got[None].formatted) == [("assistant", "x")]
    assert C.format_conversations(df.filter("conv_id > 9")).collect() == []


def test_query_matches_statement(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    verdict = compare(spark, con, SF, "op2_chat_format", queries.op2_chat_format, queries.OP2_SQL)
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict
