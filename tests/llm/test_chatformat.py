import hashlib

import pytest
from quantloom.llm import chatformat as c


def text_of(template, env):
    return "".join(t for t, _ in c.compile_template(template)(env))


def test_language():
    t = "{% for m in ms %}{% if m.a == 'x' and not m.b %}X{{ m.a | upper }}{% elif m.b or m.c != 'q' %}[{{ 'p' + m.b }}]{% else %}-{% endif %}{% endfor %}!"
    assert text_of(t, {"ms": [{"a": "x"}, {"b": "<k"}, {"c": "q"}]}) == "XX[p<k]-!"
    assert list(c.compile_template("a{% generation %}b{{ x }}{% endgeneration %}c")({"x": "y"})) == [("a", False), ("b", True), ("y", True), ("c", False)]


def test_folding():
    folded = c.fold(c.parse("a{{ 'b' + 'c' | upper }}{% if 'x' == 'y' %}no{% else %}d{% endif %}e"))
    assert folded == c.Node("seq", parts=(c.Node("text", "abCde"),))


@pytest.mark.parametrize("bad", ["{% for x in y %}", "{{ a.__class__ }}", "{{ f() }}", "{{ a | unknown }}", "{% import os %}", "{{ 'a' 'b' }}", "{% if a %}x", "{{ _x }}"])
def test_sandbox_and_errors(bad):
    with pytest.raises(c.TemplateError):
        c.compile_template(bad)


def test_no_attribute_of_an_object():
    assert text_of("{{ a.upper }}{{ b.c.d }}", {"a": "x", "b": {"c": "y"}}) == ""


ROWS = [
    (1, 0, "user", "hi <s> \\[x]"), (1, 1, "assistant", "a\nb\\"), (1, 2, "assistant", None), (1, 3, "sys]tem[", "q"), (1, 4, "user", "[/INST]</s>"),
    (2, 0, "assistant", ""), (3, None, None, None), (3, None, "user", "x"), (None, 1, "user", "z"), (4, 1, "user", "b"), (4, 1, "user", "a"), (4, 1, "user", "a"),
]


def test_read_back(spark):
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "9 as seq")
    got = {r.conv_id: r for r in c.conversation_digests(c.format_conversations(turns)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        own = sorted(((t is not None, t or 0, role or "", x or "") for k, t, role, x in ROWS if k == conv))
        said = "".join(f"{role}\n{x}\n" for _, _, role, x in own)
        loss = "".join(x for _, _, role, x in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_segments_join_to_the_rendered_conversation(spark):
    turns = spark.createDataFrame(ROWS[:5], "conv_id long, turn long, role string, text string")
    got = sorted(c.format_conversations(turns).collect(), key=lambda r: r.seq)
    env = {"turns": [{"role": r[2] or "", "text": r[3] or ""} for r in ROWS[:5]]}
    pieces = list(c.compile_template(c.DEFAULT_TEMPLATE)(env))
    assert "".join(r.text for r in got) == "".join(t for t, _ in pieces)
    assert "".join(r.text[a:b] for r in got for a, b in zip(r.mask_start, r.mask_end, strict=True)) == "".join(t for t, g in pieces if g)


def test_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.conversation_digests(c.format_conversations(turns)).count() == 0
