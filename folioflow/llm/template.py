"""A small sandboxed template language: source to syntax tree, constant folding, Python closures.

Text outside tags is copied. ``{{ expression }}`` writes a value; ``{% if %} {% elif %} {% else %} {% endif %}``,
``{% for x in list %} {% endfor %}`` (with ``loop.index``, ``index0``, ``first``, ``last``, ``length``), ``{% set x = expression %}`` and
``{% generation %} {% endgeneration %}`` control it; ``{# #}`` is a comment. Expressions have strings, integers, lists,
``true``, ``false`` and ``none``, names, ``a.b`` and ``a['b']``, ``+ ~ == != < <= > >= in and or not`` and filters ``a | f``. Templates can only read
what they are given: keys of mappings, items of lists and the filters named by the caller; there are no calls, no
attributes of objects and no loops but over given lists.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any


class TemplateError(ValueError):
    """The template is not in the language, or asks for what it may not have."""


_TAG = re.compile(r"\{\{(?P<out>(?:'[^']*'|\"[^\"]*\"|[^'\"])*?)\}\}|\{%-?(?P<stmt>(?:'[^']*'|\"[^\"]*\"|[^'\"])*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>|.,\[\]()=]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
_WORDS = {"true": True, "false": False, "none": None}


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
        kind = m.lastgroup or ""
        value: Any = m[kind]
        if kind == "str":
            value = re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), value[1:-1], flags=re.S)
        elif kind == "int":
            value = int(value)
        out.append((kind, value))
        at = m.end()
    return out


class _Parser:
    """Expressions by recursive descent; a node is a tuple that begins with its kind."""

    def __init__(self, source: str):
        self.tokens = _tokens(source)
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("expected a name")

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def expression(self) -> tuple:
        left = self.conjunction()
        while self.take("or"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.negation()
        while self.take("and"):
            left = ("and", left, self.negation())
        return left

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self) -> tuple:
        left = self.sum()
        for op in ("==", "!=", "<=", ">=", "<", ">", "in"):
            if self.take(op):
                return ("op", op, left, self.sum())
        return left

    def sum(self) -> tuple:
        left = self.postfix()
        while self.peek("+", "~"):
            op = self.tokens[self.at][1]
            self.at += 1
            left = ("op", op, left, self.postfix())
        return left

    def postfix(self) -> tuple:
        left = self.primary()
        while True:
            if self.take("."):
                left = ("get", left, ("const", self.name()))
            elif self.take("["):
                left = ("get", left, self.expression())
                self.need("]")
            elif self.take("|"):
                left = ("filter", self.name(), left)
            else:
                return left

    def primary(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends too early")
        kind, value = self.tokens[self.at]
        if kind in ("str", "int"):
            self.at += 1
            return ("const", value)
        if kind == "name":
            self.at += 1
            return ("const", _WORDS[value]) if value in _WORDS else ("name", value)
        if self.take("("):
            inner = self.expression()
            self.need(")")
            return inner
        if self.take("["):
            items = []
            while not self.peek("]"):
                items.append(self.expression())
                if not self.take(","):
                    break
            self.need("]")
            return ("list", items)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list[tuple]:
    """Syntax tree of a template: nodes text, out, if, for, set and generation."""
    stack: list[tuple[str, Any, list]] = [("", None, [])]
    at = 0

    def close(kind: str) -> tuple[str, Any, list]:
        if len(stack) < 2 or stack[-1][0] != kind:
            raise TemplateError(f"end of {kind} without its beginning")
        return stack.pop()

    for m in _TAG.finditer(source):
        if m.start() > at:
            stack[-1][2].append(("text", source[at : m.start()]))
        at = m.end()
        if m["out"] is not None:
            p = _Parser(m["out"])
            stack[-1][2].append(("out", p.expression()))
            p.end()
        elif m["stmt"] is not None:
            p = _Parser(m["stmt"])
            word = p.name()
            if word == "if":
                stack.append(("if", [(p.expression(), [])], []))
                stack[-1] = ("if", stack[-1][1], stack[-1][1][0][1])
            elif word in ("elif", "else"):
                if stack[-1][0] != "if" or stack[-1][1][-1][0] == ("const", True):
                    raise TemplateError(f"{word} without if")
                stack[-1][1].append((p.expression() if word == "elif" else ("const", True), []))
                stack[-1] = ("if", stack[-1][1], stack[-1][1][-1][1])
            elif word == "for":
                name = p.name()
                p.need("in")
                stack.append(("for", (name, p.expression()), []))
            elif word == "set":
                name = p.name()
                p.need("=")
                stack[-1][2].append(("set", name, p.expression()))
            elif word == "generation":
                stack.append(("generation", None, []))
            elif word == "endif":
                branches = close("if")[1]
                stack[-1][2].append(("if", branches))
            elif word == "endfor":
                _, head, body = close("for")
                stack[-1][2].append(("for", *head, body))
            elif word == "endgeneration":
                body = close("generation")[2]
                stack[-1][2].append(("generation", body))
            else:
                raise TemplateError(f"unknown statement {word!r}")
            p.end()
    if "{{" in source[at:] or "{%" in source[at:]:
        raise TemplateError("a tag is not closed")
    if at < len(source):
        stack[-1][2].append(("text", source[at:]))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} without its end")
    return stack[0][2]


def _string(x: Any) -> str:
    return "" if x is None else "true" if x is True else "false" if x is False else str(x)


_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "~": lambda a, b: _string(a) + _string(b), "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _string(a) + _string(b),
}


def _get(x: Any, key: Any) -> Any:
    if isinstance(x, dict):
        return x.get(key)
    if isinstance(x, list) and isinstance(key, int) and not isinstance(key, bool):
        return x[key] if -len(x) <= key < len(x) else None
    if x is None:
        return None
    raise TemplateError(f"{type(x).__name__} has no items to read")


def fold(node: tuple, filters: dict[str, Callable]) -> tuple:
    """An expression with its constant parts worked out."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "list":
        items = [fold(x, filters) for x in node[1]]
        return ("const", [x[1] for x in items]) if all(x[0] == "const" for x in items) else ("list", items)
    if kind == "not":
        x = fold(node[1], filters)
        return ("const", not x[1]) if x[0] == "const" else ("not", x)
    if kind in ("and", "or"):
        a, b = fold(node[1], filters), fold(node[2], filters)
        if a[0] == "const":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter {node[1]!r}")
        x = fold(node[2], filters)
        return ("const", filters[node[1]](x[1])) if x[0] == "const" else ("filter", node[1], x)
    parts = [fold(x, filters) if isinstance(x, tuple) else x for x in node[1:]]
    if all(x[0] == "const" for x in parts if isinstance(x, tuple)):
        return ("const", _OPS[parts[0]](parts[1][1], parts[2][1]) if kind == "op" else _get(parts[0][1], parts[1][1]))
    return (kind, *parts)


def fold_body(body: list[tuple], filters: dict[str, Callable]) -> list[tuple]:
    """Statements with constants folded: neighbouring texts are one, branches known beforehand are taken or dropped."""
    out: list[tuple] = []

    def text(s: str) -> None:
        if out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + s)
        elif s:
            out.append(("text", s))

    for node in body:
        if node[0] == "text":
            text(node[1])
        elif node[0] == "out":
            x = fold(node[1], filters)
            text(_string(x[1])) if x[0] == "const" else out.append(("out", x))
        elif node[0] == "set":
            out.append(("set", node[1], fold(node[2], filters)))
        elif node[0] == "for":
            out.append(("for", node[1], fold(node[2], filters), fold_body(node[3], filters)))
        elif node[0] == "generation":
            out.append(("generation", fold_body(node[1], filters)))
        else:
            branches = []
            for test, inner in node[1]:
                test = fold(test, filters)
                if test[0] == "const" and not test[1]:
                    continue
                branches.append((test, fold_body(inner, filters)))
                if test[0] == "const":
                    break
            if branches and branches[0][0][0] == "const":
                for x in branches[0][1]:
                    text(x[1]) if x[0] == "text" else out.append(x)
            elif branches:
                out.append(("if", branches))
    return out


class _Output:
    __slots__ = ("length", "parts", "spans")

    def __init__(self):
        self.parts, self.length, self.spans = [], 0, []

    def write(self, s: str) -> None:
        self.parts.append(s)
        self.length += len(s)


def _value(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        x = node[1]
        return lambda env: x
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name)
    if kind == "list":
        items = [_value(x, filters) for x in node[1]]
        return lambda env: [f(env) for f in items]
    if kind == "not":
        f = _value(node[1], filters)
        return lambda env: not f(env)
    if kind == "and":
        f, g = _value(node[1], filters), _value(node[2], filters)
        return lambda env: f(env) and g(env)
    if kind == "or":
        f, g = _value(node[1], filters), _value(node[2], filters)
        return lambda env: f(env) or g(env)
    if kind == "filter":
        change, f = filters[node[1]], _value(node[2], filters)
        return lambda env: change(f(env))
    if kind == "get":
        f, g = _value(node[1], filters), _value(node[2], filters)
        return lambda env: _get(f(env), g(env))
    op, f, g = _OPS[node[1]], _value(node[2], filters), _value(node[3], filters)
    return lambda env: op(f(env), g(env))


def _block(body: list[tuple], filters: dict[str, Callable]) -> Callable[[dict, _Output], None]:
    steps = [_statement(x, filters) for x in body]

    def run(env: dict, out: _Output) -> None:
        for step in steps:
            step(env, out)

    return run


def _statement(node: tuple, filters: dict[str, Callable]) -> Callable[[dict, _Output], None]:
    kind = node[0]
    if kind == "text":
        s = node[1]
        return lambda env, out: out.write(s)
    if kind == "out":
        f = _value(node[1], filters)
        return lambda env, out: out.write(_string(f(env)))
    if kind == "set":
        name, f = node[1], _value(node[2], filters)

        def assign(env: dict, out: _Output) -> None:
            env[name] = f(env)

        return assign
    if kind == "generation":
        inner = _block(node[1], filters)

        def generation(env: dict, out: _Output) -> None:
            begin = out.length
            inner(env, out)
            out.spans.append((begin, out.length))

        return generation
    if kind == "if":
        branches = [(_value(t, filters), _block(b, filters)) for t, b in node[1]]

        def choose(env: dict, out: _Output) -> None:
            for test, block in branches:
                if test(env):
                    return block(env, out)
            return None

        return choose
    name, source, block = node[1], _value(node[2], filters), _block(node[3], filters)

    def loop(env: dict, out: _Output) -> None:
        items = source(env) or []
        if not isinstance(items, list):
            raise TemplateError("only lists can be looped over")
        scope = dict(env)
        for i, x in enumerate(items):
            scope[name] = x
            scope["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}
            block(scope, out)

    return loop


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """Function from variables to the rendered string and the spans that ``generation`` blocks wrote."""
    filters = {"trim": lambda x: _string(x).strip(), "upper": lambda x: _string(x).upper(), "lower": lambda x: _string(x).lower(), "length": len} | (filters or {})
    body = _block(fold_body(parse(source), filters), filters)

    def render(variables: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        body(dict(variables), out)
        return "".join(out.parts), out.spans

    return render
