"""Chat formatting by a small template compiler.

The template language has text, ``{{ expression }}``, ``{% for x in y %}``,
``{% if e %}`` with ``elif`` and ``else``, and ``{% generation %}``, each closed
by its ``end...``. Expressions are string literals, names, ``name.key``, ``+``,
``==``, ``!=``, ``and``, ``or``, ``not``, parentheses and filters after ``|``.
A template is parsed into a syntax tree, constants in it are folded, and the
tree becomes nested Python closures. It is sandboxed: names are looked up in the
given dictionaries only, there is no call, index or attribute of an object, and
filters come from a fixed table.

Rendering yields pieces (text, generated) one turn at a time, so a conversation
of any length passes through without being held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.columns import narrowed
from quantloom.shared import bound_arrow_batches

#: Characters that begin or end a control string; within texts each gets a backslash before it.
CONTROL = "\\<[]"
_ESCAPES = {ord(c): "\\" + c for c in CONTROL}
_ESCAPED = re.compile(r"\\(.)", re.S)

DEFAULT_TEMPLATE = (
    "<s>{% for turn in turns %}"
    "{% if turn.role == 'user' %}[INST] {{ turn.text | escape }} [/INST]"
    "{% elif turn.role == 'assistant' %}[ANS]{% generation %}{{ turn.text | escape }}{% endgeneration %}</s>"
    "{% else %}[ROLE {{ turn.role | escape }}]{{ turn.text | escape }}[/ROLE]{% endif %}"
    "{% endfor %}"
)


def escape(text: str) -> str:
    return text.translate(_ESCAPES)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """The template does not parse, or names something unknown."""


@dataclass(frozen=True)
class Node:
    """kind: text, out, for, if, gen, seq; lit, name, key, add, eq, ne, and, or, not, filter."""

    kind: str
    value: object = None
    parts: tuple[Node, ...] = field(default=())


_TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_LEX = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|[+|.()]))")


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            at = m.end()
            kind = "str" if m[1] is not None else "name" if m[2] is not None else "op"
            self.tokens.append((kind, m[1] or m[2] or m[3]))
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> bool:
        if self.peek()[0] != "str" and self.peek()[1] in wanted:
            self.at += 1
            return True
        return False

    def whole(self) -> Node:
        node = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", parts=(node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", parts=(node, self.negated()))
        return node

    def negated(self) -> Node:
        return Node("not", parts=(self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.sum()
        for op, kind in (("==", "eq"), ("!=", "ne")):
            if self.take(op):
                return Node(kind, parts=(node, self.sum()))
        return node

    def sum(self) -> Node:
        node = self.filtered()
        while self.take("+"):
            node = Node("add", parts=(node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.atom()
        while self.take("|"):
            kind, name = self.peek()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            self.at += 1
            node = Node("filter", name, (node,))
        return node

    def atom(self) -> Node:
        kind, value = self.peek()
        self.at += 1
        if kind == "str":
            return Node("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "op" and value == "(":
            node = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return node
        if kind != "name" or value.startswith("_"):
            raise TemplateError(f"unexpected {value!r}")
        node = Node("name", value)
        while self.take("."):
            kind, key = self.peek()
            if kind != "name" or key.startswith("_"):
                raise TemplateError(f"unexpected {key!r}")
            self.at += 1
            node = Node("key", key, (node,))
        return node


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    pieces = _TAGS.split(source)
    at = 0

    def block(*ends: str) -> tuple[Node, str]:
        nonlocal at
        out: list[Node] = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{{"):
                out.append(Node("out", parts=(_Expression(piece[2:-2]).whole(),)))
            elif piece.startswith("{%"):
                tag = piece[2:-2].strip()
                word = tag.split(None, 1)[0] if tag else ""
                if word in ends:
                    return Node("seq", parts=tuple(out)), tag
                out.append(statement(word, tag))
            elif piece:
                out.append(Node("text", piece))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return Node("seq", parts=tuple(out)), ""

    def statement(word: str, tag: str) -> Node:
        if word == "for":
            m = re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+(.+)", tag, re.S)
            if not m:
                raise TemplateError(f"bad {tag!r}")
            body, _ = block("endfor")
            return Node("for", m[1], (_Expression(m[2]).whole(), body))
        if word == "if":
            return condition(tag[2:])
        if word == "generation":
            return Node("gen", parts=(block("endgeneration")[0],))
        raise TemplateError(f"unknown tag {tag!r}")

    def condition(source: str) -> Node:
        test = _Expression(source).whole()
        body, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            return Node("if", parts=(test, body, condition(end[4:])))
        rest = block("endif")[0] if end == "else" else Node("seq")
        return Node("if", parts=(test, body, rest))

    return block()[0]


def fold(node: Node) -> Node:
    """The tree with constant expressions evaluated, settled branches chosen and neighbouring texts joined."""
    parts = tuple(fold(p) for p in node.parts)
    known = [p.value for p in parts if p.kind == "lit"]
    if node.kind in _OPERATORS and len(known) == len(parts):
        return Node("lit", _OPERATORS[node.kind](*known))
    if node.kind == "filter" and known and isinstance(known[0], str):
        return Node("lit", FILTERS[node.value](known[0]))
    if node.kind == "out" and known:
        return Node("text", _shown(known[0]))
    if node.kind == "if" and parts[0].kind == "lit":
        return parts[1] if parts[0].value else parts[2]
    if node.kind == "seq":
        flat: list[Node] = []
        for p in (q for p in parts for q in (p.parts if p.kind == "seq" else (p,))):
            if p.kind == "text" and flat and flat[-1].kind == "text":
                flat[-1] = Node("text", flat[-1].value + p.value)
            elif p.kind != "text" or p.value:
                flat.append(p)
        parts = tuple(flat)
    return replace(node, parts=parts)


_OPERATORS: dict[str, Callable] = {
    "add": lambda a, b: _shown(a) + _shown(b),
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
    "not": lambda a: not a,
}


def _shown(value: object) -> str:
    return "" if value is None or value is False else "true" if value is True else str(value)


def _expression(node: Node) -> Callable[[dict], object]:
    value, parts = node.value, [_expression(p) for p in node.parts]
    if node.kind == "lit":
        return lambda env: value
    if node.kind == "name":
        return lambda env: env.get(value)
    if node.kind == "key":

        def key(env: dict) -> object:
            of = parts[0](env)
            return of.get(value) if type(of) is dict else None

        return key
    if node.kind == "filter":
        change = FILTERS[value]
        return lambda env: change(_shown(parts[0](env)))
    if node.kind == "and":
        return lambda env: parts[0](env) and parts[1](env)
    if node.kind == "or":
        return lambda env: parts[0](env) or parts[1](env)
    do = _OPERATORS[node.kind]
    return lambda env: do(*[p(env) for p in parts])


Piece = tuple[str, bool]


def _statement(node: Node) -> Callable[[dict, bool], Iterator[Piece]]:
    if node.kind == "text":
        return lambda env, gen: iter(((node.value, gen),))
    if node.kind == "out":
        shown = _expression(node.parts[0])
        return lambda env, gen: iter(((_shown(shown(env)), gen),))
    if node.kind == "gen":
        inner = _statement(node.parts[0])
        return lambda env, gen: inner(env, True)
    if node.kind == "if":
        test, yes, no = _expression(node.parts[0]), _statement(node.parts[1]), _statement(node.parts[2])
        return lambda env, gen: (yes if test(env) else no)(env, gen)
    if node.kind == "for":
        each, body = _expression(node.parts[0]), _statement(node.parts[1])

        def loop(env: dict, gen: bool) -> Iterator[Piece]:
            for item in each(env) or ():
                yield from body({**env, node.value: item}, gen)

        return loop
    steps = [_statement(p) for p in node.parts]

    def sequence(env: dict, gen: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(env, gen)

    return sequence


def compile_template(source: str) -> Callable[[dict], Iterator[Piece]]:
    """A closure that renders an environment to pieces (text, generated)."""
    run = _statement(fold(parse(source)))
    return lambda env: run(env, False)


SEGMENTS = "conv_id long, seq long, text string, mask_start array<long>, mask_end array<long>"


def _segment_rows(template: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """One row for each turn: the pieces up to where the next turn is asked for."""
    render = compile_template(template)

    def incoming() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)

    rows = incoming()
    ahead = next(rows, None)
    while ahead is not None:
        conv, seq, held = ahead[0], 0, []
        asked: list[int] = []

        def turns(conv=conv, asked=asked) -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                turn = {"role": ahead[1] or "", "text": ahead[2] or ""}
                ahead = next(rows, None)
                asked.append(1)
                yield turn

        def row(pieces: list[Piece], conv=conv) -> tuple:
            at, start, end = 0, [], []
            for text, gen in pieces:
                if gen:
                    if end and end[-1] == at:
                        end[-1] += len(text)
                    else:
                        start.append(at)
                        end.append(at + len(text))
                at += len(text)
            return conv, seq, "".join(t for t, _ in pieces), start, end

        own = turns()
        for piece in render({"turns": own}):
            if len(asked) > seq + 1:
                yield row(held)
                seq, held = seq + 1, []
            held.append(piece)
        yield row(held)
        for _ in own:  # a template without a loop still uses up the conversation
            continue


def _batched(rows: Iterable[tuple], schema: pa.Schema, chars_at: int | None = None) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += len(r[chars_at]) if chars_at is not None else 1
        if len(held) >= 2000 or size > 8_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def format_conversations(turns: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """(conv_id, seq, text, mask_start, mask_end): the formatted conversations, a row for each turn.

    Joined in order of seq, the texts of a conv_id are its formatted form;
    [mask_start, mask_end) are the code points of a row's text that the
    template marks as generated. Rows go by turn (null first), then role, then
    text, so ties and repeated rows have one order and all count. Null role or
    text is empty; null conv_id is a conversation of its own. An empty table
    gives an empty result; other columns are ignored.
    """
    compile_template(template)
    bound_arrow_batches(turns.sparkSession, rows=2000)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    dealt = narrowed(turns, "conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*order)
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("text", pa.string()), ("mask_start", pa.list_(pa.int64())), ("mask_end", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(_segment_rows(template, batches), schema, 2)

    return dealt.select("conv_id", "role", "text").mapInArrow(run, SEGMENTS)


_TURN = re.compile(
    r"(?:<s>)?(?:\[INST\] (?P<user>(?:[^\\<\[\]]|\\.)*) \[/INST\]"
    r"|\[ANS\](?P<assistant>(?:[^\\<\[\]]|\\.)*)</s>"
    r"|\[ROLE (?P<role>(?:[^\\<\[\]]|\\.)*)\](?P<other>(?:[^\\<\[\]]|\\.)*)\[/ROLE\])",
    re.S,
)


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a row that DEFAULT_TEMPLATE has formatted."""
    m = _TURN.fullmatch(segment)
    if not m:
        raise ValueError("not a formatted turn")
    if m["user"] is not None:
        return "user", unescape(m["user"])
    if m["assistant"] is not None:
        return "assistant", unescape(m["assistant"])
    return unescape(m["role"]), unescape(m["other"])


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    now = None
    for batch in batches:
        for conv, seq, text, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seq", "text", "mask_start", "mask_end")), strict=True):
            if seq == 0:
                if now:
                    yield now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, said = read_turn(text)
            now[1] += 1
            now[2].update(f"{role}\n{said}\n".encode())
            for a, b in zip(start, end, strict=True):
                loss = unescape(text[a:b])
                now[3] += len(loss)
                now[4].update(loss.encode())
            now[5] += len(text)
    if now:
        yield now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]


def conversation_digests(segments: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read back from the rows of format_conversations.

    Takes them as that function deals and orders them, a conversation's rows
    one after another.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return segments.mapInArrow(lambda batches: _batched(_digest_rows(batches), schema), DIGESTS)
