"""A sandboxed template language for conversations, compiled to Python closures.

Syntax: text, ``{{ expression }}``, ``{% for x in expression %} .. {% endfor %}``, ``{% if %} .. {% elif %} .. {% else %}
.. {% endif %}`` and ``{% generation %} .. {% endgeneration %}`` around what a model is to learn.  Expressions have names,
string literals, ``a.field``, ``+``, ``==``, ``!=``, ``not``, ``and``, ``or``, brackets and the filters of ``FILTERS``.
Fields are looked up in mappings only and there are no calls, so a template reaches nothing but its variables.

``compile_template`` parses the source to a syntax tree, folds constants and returns a function that yields
(text, is learnt) pieces as it goes, so a conversation of any length is rendered in bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

Pieces = Iterator[tuple[str, bool]]

TURN_START, TURN_END, ESCAPE = "###", "</turn>", "\\"
TO_ESCAPE = re.compile("|".join(map(re.escape, (ESCAPE, TURN_START, TURN_END))))
TO_ESCAPE_IN_ROLE = re.compile(TO_ESCAPE.pattern + "|: ")
ESCAPED = re.compile(r"\\(\\|" + re.escape(TURN_START) + "|" + re.escape(TURN_END) + "|: )")


def escape(text: str) -> str:
    """Put the escape sign before each control string (and before itself)."""
    return TO_ESCAPE.sub(lambda m: ESCAPE + m[0], text)


def escape_role(text: str) -> str:
    return TO_ESCAPE_IN_ROLE.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_role": escape_role, "trim": str.strip, "upper": str.upper, "lower": str.lower}

#: Turns are marked by a heading and an end mark; only assistant texts are learnt.
DEFAULT_TEMPLATE = (
    "{% for m in messages %}### {% if m.role == 'assistant' %}Assistant: {% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{% if m.role == 'user' %}User{% elif m.role == 'system' %}System{% else %}={{ m.role | escape_role }}{% endif %}: {{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
ROLES = {"Assistant": "assistant", "User": "user", "System": "system"}


class TemplateError(ValueError):
    pass


@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Field:
    of: object
    name: str


@dataclass
class Unary:
    of: object


@dataclass
class Binary:
    op: str
    left: object
    right: object


@dataclass
class Filter:
    of: object
    name: str


@dataclass
class Text:
    text: str


@dataclass
class Show:
    of: object


@dataclass
class For:
    name: str
    of: object
    body: list


@dataclass
class If:
    branches: list
    otherwise: list = field(default_factory=list)


@dataclass
class Generation:
    body: list


BLOCK = re.compile(r"(\{%.*?%\}|\{\{.*?\}\})", re.S)
TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|[.|+()])|([A-Za-z_]\w*))")
ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class ExpressionParser:
    """Recursive descent: or, and, not, comparison, sum, filters, fields."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            literal, sign, word = m.groups()
            self.tokens.append(("literal", re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[0]), literal[1:-1], flags=re.S)) if literal else ("sign", sign) if sign else ("word", word))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, kind: str, text: str | None = None) -> str | None:
        found = self.peek()
        if found[0] != kind or text is not None and found[1] != text:
            return None
        self.at += 1
        return found[1]

    def need(self, kind: str, text: str | None = None) -> str:
        if (found := self.take(kind, text)) is None:
            raise TemplateError(f"expected {text or kind}, found {self.peek()[1] or 'the end'!r}")
        return found

    def whole(self):
        out = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return out

    def either(self):
        out = self.both()
        while self.take("word", "or"):
            out = Binary("or", out, self.both())
        return out

    def both(self):
        out = self.negated()
        while self.take("word", "and"):
            out = Binary("and", out, self.negated())
        return out

    def negated(self):
        return Unary(self.negated()) if self.take("word", "not") else self.compared()

    def compared(self):
        out = self.added()
        while op := self.take("sign", "==") or self.take("sign", "!="):
            out = Binary(op, out, self.added())
        return out

    def added(self):
        out = self.filtered()
        while self.take("sign", "+"):
            out = Binary("+", out, self.filtered())
        return out

    def filtered(self):
        out = self.primary()
        while True:
            if self.take("sign", "."):
                out = Field(out, self.need("word"))
            elif self.take("sign", "|"):
                name = self.need("word")
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                out = Filter(out, name)
            else:
                return out

    def primary(self):
        if (text := self.take("literal")) is not None:
            return Const(text)
        if self.take("sign", "("):
            out = self.either()
            self.need("sign", ")")
            return out
        return Name(self.need("word"))


def parse(source: str) -> list:
    """The syntax tree of a template: a list of nodes."""
    parts, at = [p for p in BLOCK.split(source) if p], 0

    def tag(part: str) -> str:
        return part[2:-2].strip() if part.startswith("{%") else ""

    def block(*ends: str) -> tuple[list, str]:
        nonlocal at
        out: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            words = tag(part).split(None, 1)
            if part.startswith("{{"):
                out.append(Show(ExpressionParser(part[2:-2]).whole()))
            elif not part.startswith("{%"):
                out.append(Text(part))
            elif not words:
                raise TemplateError("empty tag")
            elif words[0] in ends:
                return out, tag(part)
            elif words[0] == "for":
                if not (m := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", tag(part), re.S)):
                    raise TemplateError(f"can't read {tag(part)!r}")
                out.append(For(m[1], ExpressionParser(m[2]).whole(), block("endfor")[0]))
            elif words[0] == "if":
                branches, end, otherwise = [], tag(part), []
                while end.split(None, 1)[0] in ("if", "elif"):
                    test = ExpressionParser(end.split(None, 1)[1] if " " in end else "").whole()
                    body, end = block("elif", "else", "endif")
                    branches.append((test, body))
                if end == "else":
                    otherwise, _ = block("endif")
                out.append(If(branches, otherwise))
            elif words[0] == "generation":
                out.append(Generation(block("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown tag {words[0]!r}")
        if ends:
            raise TemplateError(f"expected {ends[-1]}")
        return out, ""

    return block()[0]


def fold(node):
    """Fold constant expressions, drop branches that can't be taken and join neighbouring text."""
    if isinstance(node, list):
        out: list = []
        for n in map(fold, node):
            for x in n if isinstance(n, list) else [n]:
                if isinstance(x, Show) and isinstance(x.of, Const):
                    x = Text(as_text(x.of.value))
                if isinstance(x, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + x.text)
                elif not (isinstance(x, Text) and not x.text):
                    out.append(x)
        return out
    if isinstance(node, Unary):
        of = fold(node.of)
        return Const(not of.value) if isinstance(of, Const) else Unary(of)
    if isinstance(node, Binary):
        left, right = fold(node.left), fold(node.right)
        if isinstance(left, Const) and isinstance(right, Const):
            return Const(evaluate(Binary(node.op, left, right))({}))
        return Binary(node.op, left, right)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](as_text(of.value))) if isinstance(of, Const) else Filter(of, node.name)
    if isinstance(node, Field):
        return Field(fold(node.of), node.name)
    if isinstance(node, Show):
        return Show(fold(node.of))
    if isinstance(node, For):
        return For(node.name, fold(node.of), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        branches = []
        for test, body in node.branches:
            test = fold(test)
            if isinstance(test, Const):
                if not test.value:
                    continue
                return If(branches, fold(body)) if branches else fold(body)
            branches.append((test, fold(body)))
        return If(branches, fold(node.otherwise)) if branches else fold(node.otherwise)
    return node


def as_text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def evaluate(node) -> Callable[[Mapping], object]:
    """A closure from variables to the value of an expression."""
    if isinstance(node, Const):
        return lambda v, x=node.value: x
    if isinstance(node, Name):
        return lambda v, n=node.name: v.get(n)
    if isinstance(node, Field):
        of, name = evaluate(node.of), node.name
        return lambda v: x.get(name) if isinstance(x := of(v), Mapping) else None
    if isinstance(node, Filter):
        of, f = evaluate(node.of), FILTERS[node.name]
        return lambda v: f(as_text(of(v)))
    if isinstance(node, Unary):
        of = evaluate(node.of)
        return lambda v: not of(v)
    left, right = evaluate(node.left), evaluate(node.right)
    return {
        "==": lambda v: left(v) == right(v),
        "!=": lambda v: left(v) != right(v),
        "+": lambda v: as_text(left(v)) + as_text(right(v)),
        "and": lambda v: left(v) and right(v),
        "or": lambda v: left(v) or right(v),
    }[node.op]


def renderer(nodes: list) -> Callable[[Mapping, bool], Pieces]:
    """A closure that yields the pieces of a list of nodes."""
    steps = [step(n) for n in nodes]

    def run(v: Mapping, learnt: bool) -> Pieces:
        for s in steps:
            yield from s(v, learnt)

    return run


def step(node) -> Callable[[Mapping, bool], Pieces]:
    if isinstance(node, Text):
        return lambda v, learnt, t=node.text: iter(((t, learnt),))
    if isinstance(node, Show):
        of = evaluate(node.of)
        return lambda v, learnt: iter(((as_text(of(v)), learnt),))
    if isinstance(node, Generation):
        body = renderer(node.body)
        return lambda v, learnt: body(v, True)
    if isinstance(node, If):
        branches, otherwise = [(evaluate(t), renderer(b)) for t, b in node.branches], renderer(node.otherwise)
        return lambda v, learnt: next((b for t, b in branches if t(v)), otherwise)(v, learnt)
    of, body, name = evaluate(node.of), renderer(node.body), node.name

    def loop(v: Mapping, learnt: bool) -> Pieces:
        for x in of(v) or ():
            yield from body({**v, name: x}, learnt)

    return loop


def compile_template(source: str) -> Callable[[Mapping], Pieces]:
    """Parse, fold and compile; the result yields (text, is learnt) pieces."""
    run = renderer(fold(parse(source)))
    return lambda variables: run(variables, False)


def read_turns(pieces: Pieces, on_turn: Callable[[str, str], None], on_learnt: Callable[[str], None]) -> int:
    """Read formatted output of the default marking back, as it comes: each turn's role and text, and each learnt
    text, all unescaped.  Returns the number of characters.  Work is linear in it."""
    n, open_text, learnt, at = 0, "", [], 0
    for text, is_learnt in pieces:
        n += len(text)
        if is_learnt:
            learnt.append(text)
        elif learnt:
            on_learnt(unescape("".join(learnt)))
            learnt = []
        open_text += text
        begin = 0
        while (end := open_text.find(TURN_END + "\n", at)) >= 0:
            at = end + 1
            if escapes_before(open_text, end) % 2:
                continue
            head, _, body = split_head(open_text[begin + len(TURN_START) + 1 : end])
            on_turn(head, unescape(body))
            begin = at = end + len(TURN_END) + 1
        # An end mark may be parted between pieces.
        open_text, at = open_text[begin:], max(at, len(open_text) - len(TURN_END)) - begin
    if learnt:
        on_learnt(unescape("".join(learnt)))
    return n


def escapes_before(text: str, at: int) -> int:
    """Length of the run of escape signs that ends at ``at``."""
    begin = at
    while begin and text[begin - 1] == ESCAPE:
        begin -= 1
    return at - begin


def split_head(turn: str) -> tuple[str, str, str]:
    """Role, separator and (escaped) text of a turn."""
    at = turn.find(": ")
    while turn.startswith("=") and escapes_before(turn, at) % 2:
        at = turn.find(": ", at + 1)
    head = turn[:at]
    return unescape(head[1:]) if head.startswith("=") else ROLES[head], ": ", turn[at + 2 :]
