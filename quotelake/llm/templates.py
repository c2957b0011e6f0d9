"""A small sandboxed template language: parsed to a syntax tree, constants folded, compiled to Python closures.

    {{ expression }}   {% for m in messages %} ... {% endfor %}   {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {% set name = expression %}   {% generation %} ... {% endgeneration %}   {# comment #}

Expressions: strings, integers, true, false, none, names, ``a.key`` and ``a['key']`` (dictionary keys and list places, nothing
else: no attributes, no calls), ``not and or``, ``== != < <= > >= in``, ``+`` and ``~`` (joins as text), ``x if c else y``, and the
filters trim, upper, lower, length, default(x) and escape. In a loop, ``loop`` has index0, index, first and last. A ``-`` at a
tag's end strips white space there. Rendering returns parts of text, each marked if it stands inside a generation block.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Env = dict
Parts = list
Expression = Callable[[Env], object]
Block = Callable[[Env, Parts, bool], None]

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?)(.*?)(-?)#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>|.\[\]()+~,=]))")
_UNESCAPED = {"n": "\n", "t": "\t", "r": "\r"}
_PLAIN = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    """The template isn't in the language, or reaches for what isn't there."""


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:].strip()[:30]!r}")
        kind, text = m.lastgroup, m[m.lastgroup]
        if kind == "str":
            text = re.sub(r"\\(.)", lambda e: _UNESCAPED.get(e[1], e[1]), text[1:-1], flags=re.S)
        out.append((kind, int(text) if kind == "int" else text))
        at = m.end()
    return out


class _Parser:
    """Tokens of one expression to a tree of tuples (operator, operands...)."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self, *what: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("name", "op") and self.tokens[self.at][1] in what

    def take(self, *what: str) -> bool:
        if self.peek(*what):
            self.at += 1
            return True
        return False

    def need(self, what: str) -> None:
        if not self.take(what):
            raise TemplateError(f"expected {what!r}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        tree = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def choice(self) -> tuple:
        tree = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return ("if", test, tree, self.choice())
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        tree = self.joined()
        while self.peek("==", "!=", "<", "<=", ">", ">=", "in"):
            self.at += 1
            tree = (self.tokens[self.at - 1][1], tree, self.joined())
        return tree

    def joined(self) -> tuple:
        tree = self.filtered()
        while self.peek("+", "~"):
            self.at += 1
            tree = (self.tokens[self.at - 1][1], tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.reached()
        while self.take("|"):
            name, more = self.name(), []
            if self.take("("):
                more.append(self.choice())
                self.need(")")
            tree = ("filter", name, tree, *more)
        return tree

    def reached(self) -> tuple:
        tree = self.atom()
        while True:
            if self.take("."):
                tree = ("key", tree, ("constant", self.name()))
            elif self.take("["):
                tree = ("key", tree, self.choice())
                self.need("]")
            else:
                return tree

    def atom(self) -> tuple:
        if self.take("("):
            tree = self.choice()
            self.need(")")
            return tree
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind in ("str", "int"):
            return ("constant", value)
        if kind == "name" and value in _PLAIN:
            return ("constant", _PLAIN[value])
        if kind == "name" and not value.startswith("_") and value not in ("if", "else", "in", "and", "or", "not"):
            return ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def _text(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


def _key(box: object, key: object) -> object:
    if isinstance(box, dict):
        return box.get(key)
    if isinstance(box, (list, str)) and isinstance(key, int) and not isinstance(key, bool):
        return box[key] if key < len(box) else None
    raise TemplateError(f"{key!r} can't be reached")


_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
    "~": lambda a, b: _text(a) + _text(b),
    "not": lambda a: not a,
    "key": _key,
}
FILTERS: dict[str, Callable] = {
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": len,
    "default": lambda x, y: y if x is None else x,
}


def fold(tree: tuple, filters: dict[str, Callable]) -> tuple:
    """The tree with every part that needs no name worked out."""
    op, *parts = tree
    if op in ("constant", "name"):
        return tree
    if op == "filter":
        if parts[0] not in filters:
            raise TemplateError(f"no filter {parts[0]!r}")
        inner = [fold(p, filters) for p in parts[1:]]
        return ("constant", filters[parts[0]](*(p[1] for p in inner))) if all(p[0] == "constant" for p in inner) else ("filter", parts[0], *inner)
    inner = [fold(p, filters) for p in parts]
    if op in ("if", "and", "or"):
        if inner[0][0] != "constant":
            return (op, *inner)
        if op == "if":
            return inner[1] if inner[0][1] else inner[2]
        return inner[1] if bool(inner[0][1]) == (op == "and") else inner[0]
    return ("constant", _OPS[op](*(p[1] for p in inner))) if all(p[0] == "constant" for p in inner) else (op, *inner)


def _expression(tree: tuple, filters: dict[str, Callable]) -> Expression:
    op, *parts = tree
    if op == "constant":
        value = parts[0]
        return lambda env: value
    if op == "name":
        name = parts[0]
        return lambda env: env.get(name)
    if op == "filter":
        f, inner = filters[parts[0]], [_expression(p, filters) for p in parts[1:]]
        return (lambda env, a=inner[0]: f(a(env))) if len(inner) == 1 else (lambda env: f(*(p(env) for p in inner)))
    inner = [_expression(p, filters) for p in parts]
    if op == "if":
        test, yes, no = inner
        return lambda env: yes(env) if test(env) else no(env)
    if op in ("and", "or"):
        a, b = inner
        return (lambda env: a(env) and b(env)) if op == "and" else (lambda env: a(env) or b(env))
    f = _OPS[op]
    if len(inner) == 1:
        return lambda env, a=inner[0]: f(a(env))
    return lambda env, a=inner[0], b=inner[1]: f(a(env), b(env))


def _pieces(source: str) -> list[tuple[str, str]]:
    """('text' | 'out' | 'tag', body) in order; comments and stripped white space are gone."""
    out: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        k = 1 if m[2] is not None else 4 if m[5] is not None else 7
        text = text.lstrip() if strip else text
        text = text.rstrip() if m[k] else text
        if text:
            out.append(("text", text))
        if k < 7:
            out.append(("out" if k == 1 else "tag", m[k + 1].strip()))
        at, strip = m.end(), bool(m[k + 2])
    rest = source[at:].lstrip() if strip else source[at:]
    return out + [("text", rest)] * bool(rest)


def parse(source: str, filters: dict[str, Callable]) -> list[tuple]:
    """The folded syntax tree: ('text', s), ('out', e), ('for', name, e, body), ('if', [(e, body)...], else), ('set', name, e), ('generation', body)."""
    pieces, at = _pieces(source), 0
    expression = lambda s: fold(_Parser(s).whole(), filters)

    def body(*ends: str) -> tuple[list[tuple], str]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(pieces):
            kind, text = pieces[at]
            at += 1
            if kind == "text":
                nodes.append(("text", text))
                continue
            if kind == "out":
                e = expression(text)
                nodes.append(("text", _text(e[1])) if e[0] == "constant" else ("out", e))
                continue
            word, _, rest = text.partition(" ")
            if word in ends:
                return nodes, text
            if word == "for":
                m = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"cannot read {text!r}")
                inner, _ = body("endfor")
                nodes.append(("for", m[1], expression(m[2]), inner))
            elif word == "if":
                cases, test, other = [], expression(rest), []
                while True:
                    inner, end = body("elif", "else", "endif")
                    cases.append((test, inner))
                    if end.startswith("elif"):
                        test = expression(end[4:])
                        continue
                    if end == "else":
                        other, _ = body("endif")
                    break
                # constant tests are settled now
                live = []
                for t, inner in cases:
                    if t[0] == "constant" and not t[1]:
                        continue
                    if t[0] == "constant":
                        other = inner
                        break
                    live.append((t, inner))
                nodes += [("if", live, other)] if live else other
            elif word == "set":
                m = re.fullmatch(r"\s*([A-Za-z]\w*)\s*=\s*(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"cannot read {text!r}")
                nodes.append(("set", m[1], expression(m[2])))
            elif word == "generation":
                inner, _ = body("endgeneration")
                nodes.append(("generation", inner))
            else:
                raise TemplateError(f"unknown tag {word!r}")
        if ends:
            raise TemplateError(f"no {ends[-1]}")
        return nodes, ""

    nodes, _ = body()
    return nodes


def _block(nodes: list[tuple], filters: dict[str, Callable]) -> Block:
    merged: list[tuple] = []
    for n in nodes:
        if n[0] == "text" and merged and merged[-1][0] == "text":
            merged[-1] = ("text", merged[-1][1] + n[1])
        else:
            merged.append(n)
    steps = [_node(n, filters) for n in merged]

    def run(env: Env, parts: Parts, marked: bool) -> None:
        for step in steps:
            step(env, parts, marked)

    return run


def _node(node: tuple, filters: dict[str, Callable]) -> Block:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda env, parts, marked: parts.append((text, marked))
    if kind == "out":
        e = _expression(node[1], filters)
        return lambda env, parts, marked: parts.append((_text(e(env)), marked))
    if kind == "set":
        name, e = node[1], _expression(node[2], filters)
        return lambda env, parts, marked: env.__setitem__(name, e(env))
    if kind == "generation":
        inner = _block(node[1], filters)
        return lambda env, parts, marked: inner(env, parts, True)
    if kind == "if":
        cases, other = [(_expression(t, filters), _block(b, filters)) for t, b in node[1]], _block(node[2], filters)

        def choose(env: Env, parts: Parts, marked: bool) -> None:
            for test, then in cases:
                if test(env):
                    return then(env, parts, marked)
            return other(env, parts, marked)

        return choose
    name, many, inner = node[1], _expression(node[2], filters), _block(node[3], filters)

    def loop(env: Env, parts: Parts, marked: bool) -> None:
        rows = many(env)
        if not isinstance(rows, list):
            raise TemplateError("only lists can be looped over")
        for i, row in enumerate(rows):
            own = dict(env)
            own[name] = row
            own["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(rows) - 1}
            inner(own, parts, marked)

    return loop


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[[Env], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to (text, spans of code points written in generation blocks; empty ones left out, touching ones apart)."""
    known = FILTERS | (filters or {})
    block = _block(parse(source, known), known)

    def render(env: Env) -> tuple[str, list[tuple[int, int]]]:
        parts: Parts = []
        block(dict(env), parts, False)
        spans, at = [], 0
        for text, marked in parts:
            if marked and text:
                spans.append((at, at + len(text)))
            at += len(text)
        return "".join(text for text, _ in parts), spans

    return render
