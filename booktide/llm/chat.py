"""Chat formatting: a small sandboxed template language, compiled to Python closures."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

#: Turns of others are marked [INST], those of the assistant [OUT]; only the latter's text is under the loss mask.
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'assistant' %}<s>[OUT] {% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}<s>[INST] {{ m.role | escape | line }}\n{{ m.text | escape }} [/INST]{% endif %}"
    "{% endfor %}"
)

#: All marks start with one of these, which in a text stand behind a backslash.
_ESCAPED = re.compile(r"[\\<\[]")
_BACK = re.compile(r"\\(.)", re.S)
_INNER = r"[^\\<\[]*(?:\\.[^\\<\[]*)*"
_TURN = re.compile(rf"<s>(?:\[OUT\] (?P<out>{_INNER})</s>|\[INST\] (?P<role>(?:\\.|[^\\<\[\n])*)\n(?P<text>{_INNER}) \[/INST\])", re.S)


def escape(text: str) -> str:
    return _ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS: dict[str, Callable[[Any], Any]] = {"escape": escape, "line": lambda x: x.replace("\n", "\\n"), "trim": lambda x: x.strip(), "upper": lambda x: x.upper(), "lower": lambda x: x.lower(), "length": len}

_PARTS = re.compile(r"\{%-?\s*(?P<tag>.*?)\s*-?%\}|\{\{\s*(?P<out>.*?)\s*\}\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'[^']*'|\"[^\"]*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|().]))")


class TemplateError(ValueError):
    """The template is not of this language, or asks for what it may not have."""


class _Expression:
    """Parses one expression to a tree of tuples: ("const", x), ("name", n), ("get", tree, n), ("not", t), (operator, t, t), ("filter", t, f)."""

    LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "<=", ">="), ("+", "~"))

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too soon")
        self.at += 1
        return self.tokens[self.at - 1]

    def parse(self) -> tuple:
        tree = self.level(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"what is {self.tokens[self.at][1]!r}?")
        return tree

    def level(self, k: int) -> tuple:
        if k == len(self.LEVELS):
            return self.filtered()
        if k == 2 and self.peek() == "not":
            self.take()
            return ("not", self.level(2))
        tree = self.level(k + 1)
        while self.peek() in self.LEVELS[k]:
            tree = (self.take()[1], tree, self.level(k + 1))
        return tree

    def filtered(self) -> tuple:
        kind, text = self.take()
        if kind == "str":
            tree = ("const", text[1:-1])
        elif kind == "num":
            tree = ("const", int(text))
        elif text == "(":
            tree = self.level(0)
            if self.take()[1] != ")":
                raise TemplateError("a bracket stays open")
        elif kind == "name":
            tree = ("const", {"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else ("name", text)
        else:
            raise TemplateError(f"what is {text!r}?")
        while self.peek() in (".", "|"):
            mark, name = self.take()[1], self.take()[1]
            if mark == "|" and name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = ("get", tree, name) if mark == "." else ("filter", tree, name)
        return tree


_OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b, "+": lambda a, b: a + b, "~": lambda a, b: f"{a}{b}", "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}


def fold(tree: tuple) -> tuple:
    """The tree with all parts computed that hold no name."""
    kind, *parts = tree
    if kind in ("const", "name"):
        return tree
    parts = [fold(p) if isinstance(p, tuple) else p for p in parts]
    if all(p[0] == "const" for p in parts if isinstance(p, tuple)):
        values = [p[1] if isinstance(p, tuple) else p for p in parts]
        if kind == "not":
            return ("const", not values[0])
        if kind == "filter":
            return ("const", FILTERS[values[1]](values[0]))
        if kind in _OPERATORS:
            return ("const", _OPERATORS[kind](*values))
    return (kind, *parts)


def _value(tree: tuple) -> Callable[[dict], Any]:
    kind, *parts = tree
    if kind == "const":
        return lambda env, x=parts[0]: x
    if kind == "name":
        return lambda env, n=parts[0]: env[n]
    inner = _value(parts[0])
    if kind == "get":

        def get(env, n=parts[1]):
            of = inner(env)
            if not isinstance(of, dict):  # nothing of Python's own is ever reached
                raise TemplateError(f"no field {n!r}")
            return of.get(n)

        return get
    if kind == "filter":
        return lambda env, f=FILTERS[parts[1]]: f(inner(env))
    if kind == "not":
        return lambda env: not inner(env)
    other = _value(parts[1])
    if kind == "and":
        return lambda env: inner(env) and other(env)
    if kind == "or":
        return lambda env: inner(env) or other(env)
    return lambda env, f=_OPERATORS[kind]: f(inner(env), other(env))


class Output:
    """Takes the pieces of a rendered text and notes where generated parts begin and end."""

    def __init__(self):
        self.pieces: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def compile_template(source: str) -> Callable[[dict, Output], None]:
    """A function that renders the template, given the values of its names, into an Output."""
    items, at = [], 0
    for m in _PARTS.finditer(source):
        items += [("text", source[at : m.start()])] if m.start() > at else []
        items += [("tag", m["tag"])] if m["tag"] is not None else [("out", fold(_Expression(m["out"]).parse()))] if m["out"] is not None else []
        at = m.end()
    items += [("text", source[at:])] if at < len(source) else []
    tree, rest, end = _block(items, ())
    if end or rest:
        raise TemplateError(f"{end!r} stands alone")
    return _closure(tree)


def _block(items: list, ends: tuple[str, ...]) -> tuple[list, list, str]:
    """Statements up to one of ends: the tree, the items behind, and the tag that ended it."""
    tree: list[tuple] = []
    while items:
        (kind, x), items = items[0], items[1:]
        if kind == "out" and x[0] == "const":
            kind, x = "text", str(x[1])
        if kind != "tag":
            if kind == "text" and tree and tree[-1][0] == "text":
                tree[-1] = ("text", tree[-1][1] + x)
            elif x != "":
                tree.append((kind, x))
            continue
        word = x.split(None, 1)[0] if x else ""
        if word in ends:
            return tree, items, x
        if word == "for":
            m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", x, re.S)
            if not m:
                raise TemplateError(f"cannot read {x!r}")
            body, items, _ = _block(items, ("endfor",))
            tree.append(("for", m[1], fold(_Expression(m[2]).parse()), body))
        elif word == "if":
            branches, end = [], x
            while end.split(None, 1)[0] in ("if", "elif"):
                test = fold(_Expression(end.split(None, 1)[1]).parse())
                body, items, end = _block(items, ("elif", "else", "endif"))
                branches.append((test, body))
            if end == "else":
                body, items, end = _block(items, ("endif",))
                branches.append((("const", True), body))
            live = [b for b in branches if b[0][0] != "const" or b[0][1]]
            first = next((k for k, b in enumerate(live) if b[0][0] == "const"), len(live))
            tree += live[0][1] if first == 0 and live else [("if", live[: first + 1])] if live else []
        elif word == "generation":
            body, items, _ = _block(items, ("endgeneration",))
            tree.append(("generation", body))
        elif word == "set":
            m = re.fullmatch(r"set\s+([A-Za-z_]\w*)\s*=\s*(.+)", x, re.S)
            if not m:
                raise TemplateError(f"cannot read {x!r}")
            tree.append(("set", m[1], fold(_Expression(m[2]).parse())))
        else:
            raise TemplateError(f"what is {x!r}?")
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return tree, [], ""


def _closure(tree: list[tuple]) -> Callable[[dict, Output], None]:
    steps = [_step(x) for x in tree]

    def run(env: dict, out: Output) -> None:
        for step in steps:
            step(env, out)

    return steps[0] if len(steps) == 1 else run


def _step(node: tuple) -> Callable[[dict, Output], None]:
    kind, *parts = node
    if kind == "text":
        return lambda env, out, x=parts[0]: out.write(x)
    if kind == "out":
        value = _value(parts[0])
        return lambda env, out: out.write(str(value(env)))
    if kind == "set":
        value = _value(parts[1])
        return lambda env, out, n=parts[0]: env.__setitem__(n, value(env))
    if kind == "generation":
        body = _closure(parts[0])

        def generation(env: dict, out: Output) -> None:
            start = out.length
            body(env, out)
            out.spans.append((start, out.length))

        return generation
    if kind == "for":
        name, over, inside = parts[0], _value(parts[1]), _closure(parts[2])

        def loop(env: dict, out: Output) -> None:
            for k, x in enumerate(over(env)):
                inside(env | {name: x, "loop": {"index": k + 1, "first": k == 0}}, out)

        return loop
    branches = [(_value(test), _closure(body)) for test, body in parts[0]]

    def choose(env: dict, out: Output) -> None:
        for test, body in branches:
            if test(env):
                body(env, out)
                return

    return choose


def format_chats(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row for each conversation of turns (conv_id, turn, role, text): conv_id, formatted, mask (starts and ends of generated parts).

    Rows are put in order by turn, then role, then text. A null role or text is empty; rows with a null conv_id form one conversation of
    their own; repeated rows are turns of their own. Rows stream through a task in order, so that beside its own result no conversation
    is held. Further columns play no part.
    """
    compile_template(template)  # errors show here
    flat = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("mask", pa.list_(pa.int64()))])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template)
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
        done, size = [], 0
        for conv, own in itertools.groupby(rows, key=lambda r: r[0]):
            out = Output()
            run({"messages": ({"role": r, "text": t} for _, r, t in own)}, out)
            done.append((conv, "".join(out.pieces), [x for span in out.spans for x in span]))
            size += out.length
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done, size = [], 0
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    ordered = flat.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return mapped(ordered, render, "conv_id long, formatted string, mask array<long>")


def read_back(formatted: str) -> Iterable[tuple[str, str]]:
    """The turns (role, text) of a text that TEMPLATE formatted; an error if it is not such a text."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield ("assistant", unescape(m["out"])) if m["out"] is not None else (unescape(m["role"]), unescape(m["text"]))
        at = m.end()


def digests(chats: DataFrame) -> DataFrame:
    """From formatted chats, read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A null conv_id is carried along; without generated parts loss_chars is 0 and the hash that of the empty text; repeated rows each get a
    row, an empty table gives none. Texts of any length are read whole; other columns play no part.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "mask")), strict=True):
                turns, n = hashlib.sha256(), 0
                for role, said in read_back(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                loss = [unescape(text[a:b]) for a, b in zip(mask[::2], mask[1::2], strict=True)]
                rows.append((conv, n, turns.hexdigest(), sum(map(len, loss)), hashlib.sha256("".join(loss).encode()).hexdigest(), len(text)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return mapped(chats, digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
