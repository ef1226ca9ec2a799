"""Chat templates as models ship them, turned into Column expressions.

The subset that such templates share: ``{% for message in messages %}``, ``{% if %}`` / ``elif`` / ``else``, ``{% set %}``, ``{{ }}`` output, blank control (``-``), strings, ``+`` and ``~``, comparison, ``and`` / ``or`` / ``not``, ``in``,
``message['role']`` or ``message.role``, ``messages[0]``, ``messages[1:]``, ``loop.first`` / ``last`` / ``index`` / ``index0``,
``add_generation_prompt``, special tokens, and the filters and methods ``trim``, ``strip``, ``upper``, ``lower``, ``length``, ``title``. A template becomes one
expression over an array of (role, content): the loop a ``transform``, a condition a ``CASE``. Anything else raises ``Unsupported``, and the
caller falls back to the plain renderer."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunedata.functions.strings import capitalize, py_strip

_TAG = re.compile(r"(\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#.*?#\})", re.S)


class Unsupported(ValueError):
    """The template uses something outside the subset."""


@dataclass
class _Node:
    kind: str  # text, out, for, if, set
    value: str = ""
    #: Body of a loop; (condition, body) pairs of an if, the last condition empty for else.
    parts: list = field(default_factory=list)


def _tokens(template: str) -> list[tuple[str, str]]:
    """``(text | % | {, content)`` with the blank control applied; a block tag also takes one line break after it,
    as the usual settings of chat templates (trim and strip of blocks) say."""
    out: list[tuple[str, str]] = []
    strip_next = cut_line = False
    for piece in _TAG.split(template):
        if not _TAG.fullmatch(piece):
            if strip_next:
                piece = piece.lstrip()
            elif cut_line and piece.startswith("\n"):
                piece = piece[1:]
            out.append(("text", piece))
            strip_next = cut_line = False
            continue
        if piece.startswith("{#"):
            cut_line = True
            continue
        left, right = piece[2] == "-", piece[-3] == "-"
        if out and out[-1][0] == "text":
            before = out[-1][1]
            if left:
                before = before.rstrip()
            elif piece[1] == "%":
                before = re.sub(r"(^|\n)[ \t]*$", r"\1", before)  # a block alone on its line leaves no indent
            out[-1] = ("text", before)
        out.append((piece[1], piece[3 if left else 2:-3 if right else -2].strip()))
        strip_next, cut_line = right, piece[1] == "%"
    return [(k, v) for k, v in out if k != "text" or v]


def _parse(tokens: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[list[_Node], int]:
    nodes: list[_Node] = []
    while at < len(tokens):
        kind, value = tokens[at]
        word = value.split(None, 1)[0] if value.split() else ""
        if kind == "text":
            nodes.append(_Node("text", value))
        elif kind == "{":
            nodes.append(_Node("out", value))
        elif word in ends:
            return nodes, at
        elif word == "for":
            body, at = _parse(tokens, at + 1, ("endfor",))
            nodes.append(_Node("for", value[3:].strip(), body))
        elif word == "if":
            parts, condition = [], value[2:].strip()
            while True:
                body, at = _parse(tokens, at + 1, ("elif", "else", "endif"))
                parts.append((condition, body))
                word, _, rest = tokens[at][1].partition(" ")
                if word == "endif":
                    break
                condition = rest.strip() if word == "elif" else ""
            nodes.append(_Node("if", "", parts))
        elif word == "set":
            nodes.append(_Node("set", value[3:].strip()))
        else:
            raise Unsupported(f"tag {value!r}")
        at += 1
    if ends:
        raise Unsupported(f"missing {ends[-1]}")
    return nodes, at


_METHODS: dict[str, Callable[[Column], Column]] = {
    "trim": py_strip, "strip": py_strip, "upper": F.upper, "lower": F.lower, "title": capitalize, "capitalize": capitalize}


class _Scope:
    """Names of a template: arrays of messages, one message, loop values, columns."""

    def __init__(self, names: dict[str, object]):
        self.names = names

    def inner(self, **more: object) -> _Scope:
        return _Scope({**self.names, **more})


def _expression(text: str) -> ast.expr:
    source = re.sub(r"\s~\s", " + ", text)
    for word, py in (("true", "True"), ("false", "False"), ("none", "None")):
        source = re.sub(rf"\b{word}\b(?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*$)", py, source)
    source = re.sub(r"\bis\s+not\s+defined\b", "== None", source)
    source = re.sub(r"\bis\s+defined\b", "!= None", source)
    try:
        return ast.parse(source, mode="eval").body
    except SyntaxError as e:
        raise Unsupported(f"expression {text!r}") from e


def _value(node: ast.expr, scope: _Scope) -> object:
    """A Column, a Python constant, or a marked object (messages, message, loop)."""
    if isinstance(node, ast.Constant):
        return node.value
    if isinstance(node, ast.Name):
        if node.id in scope.names:
            return scope.names[node.id]
        return None  # an undefined name is false and prints nothing
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr) and isinstance(node.right, ast.Name):
        return _method(node.right.id, _value(node.left, scope))
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Mod)):
        left, right = _value(node.left, scope), _value(node.right, scope)
        if isinstance(node.op, ast.Mod):
            return _Typed(_column(left) % _column(right), "number")
        if any(isinstance(v, int) or isinstance(v, _Typed) and v.kind == "number" for v in (left, right)):
            return _Typed(_column(left) + _column(right), "number")
        return F.concat(_text(left), _text(right))
    if isinstance(node, ast.Attribute):
        return _member(_value(node.value, scope), node.attr)
    if isinstance(node, ast.Subscript):
        return _subscript(_value(node.value, scope), node.slice, scope)
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and not node.args:
        return _method(node.func.attr, _value(node.func.value, scope))
    if isinstance(node, (ast.Compare, ast.BoolOp)) or isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return _Typed(_truth(node, scope), "boolean")
    if isinstance(node, ast.IfExp):
        return F.when(_truth(node.test, scope), _text(_value(node.body, scope))).otherwise(_text(_value(node.orelse, scope)))
    raise Unsupported(ast.dump(node)[:80])


@dataclass(frozen=True)
class _Typed:
    """A number or boolean; a plain Column is a string."""

    column: Column
    kind: str


@dataclass(frozen=True)
class _Messages:
    array: Column


@dataclass(frozen=True)
class _Message:
    struct: Column


@dataclass(frozen=True)
class _Loop:
    index: Column
    size: Column


def _member(of: object, name: str) -> object:
    if isinstance(of, _Message) and name in ("role", "content"):
        return of.struct[name]
    if isinstance(of, _Loop):
        found = {"first": _Typed(of.index == 0, "boolean"), "last": _Typed(of.index == of.size - 1, "boolean"),
                 "index0": _Typed(of.index, "number"), "index": _Typed(of.index + 1, "number")}
        if name in found:
            return found[name]
    raise Unsupported(f"member {name!r}")


def _subscript(of: object, at: ast.expr, scope: _Scope) -> object:
    if isinstance(of, _Messages):
        if isinstance(at, ast.Slice):
            low = at.lower.value if isinstance(at.lower, ast.Constant) else None
            if at.upper is None and at.step is None and isinstance(low, int) and low >= 0:
                return _Messages(F.slice(of.array, F.lit(low + 1), F.greatest(F.size(of.array) - low, F.lit(0))))
        elif isinstance(at, ast.Constant) and isinstance(at.value, int):
            return _Message(F.get(of.array, F.lit(at.value)))
        elif isinstance(at, ast.UnaryOp) and isinstance(at.op, ast.USub) and isinstance(at.operand, ast.Constant):
            return _Message(F.get(of.array, F.size(of.array) - at.operand.value))
        elif isinstance(at, ast.BinOp):
            raise Unsupported("computed index")
    if isinstance(of, _Message) and isinstance(at, ast.Constant):
        return _member(of, at.value)
    raise Unsupported("subscript")


def _method(name: str, of: object) -> object:
    if name in ("length", "count"):
        return _Typed(F.size(of.array) if isinstance(of, _Messages) else F.length(_text(of)), "number")
    if name not in _METHODS:
        raise Unsupported(f"filter {name!r}")
    return _METHODS[name](_text(of))


def _column(v: object) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, _Typed):
        return v.column
    if v is None or isinstance(v, (str, int, float, bool)):
        return F.lit(v)
    raise Unsupported("a list or message where a value is needed")


def _text(v: object) -> Column:
    return F.coalesce(_column(v).cast("string"), F.lit(""))


def _truth(node: ast.expr, scope: _Scope) -> Column:
    if isinstance(node, ast.BoolOp):
        parts = [_truth(v, scope) for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return out
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return ~_truth(node.operand, scope)
    if isinstance(node, ast.Compare) and len(node.ops) == 1:
        op, left = node.ops[0], _value(node.left, scope)
        if isinstance(op, (ast.In, ast.NotIn)):
            if isinstance(node.comparators[0], (ast.List, ast.Tuple)):
                found = _column(left).isin([e.value for e in node.comparators[0].elts if isinstance(e, ast.Constant)])
            else:
                found = _text(_value(node.comparators[0], scope)).contains(_text(left))
            found = F.coalesce(found, F.lit(False))
            return ~found if isinstance(op, ast.NotIn) else found
        right = _value(node.comparators[0], scope)
        a, b = _column(left), _column(right)
        made = {ast.Eq: lambda: a.eqNullSafe(b), ast.NotEq: lambda: ~a.eqNullSafe(b), ast.Gt: lambda: a > b, ast.Lt: lambda: a < b,
                ast.GtE: lambda: a >= b, ast.LtE: lambda: a <= b}.get(type(op))
        if made is None:
            raise Unsupported("comparison")
        return F.coalesce(made(), F.lit(False))
    value = _value(node, scope)
    if isinstance(value, _Messages):
        return F.size(value.array) > 0
    if isinstance(value, _Message):
        return value.struct.isNotNull()
    if value is None or isinstance(value, (bool, int, str)):
        return F.lit(bool(value))
    if isinstance(value, _Typed):
        return F.coalesce(value.column if value.kind == "boolean" else value.column != 0, F.lit(False))
    return F.coalesce(_column(value) != "", F.lit(False))


def _render(nodes: list[_Node], scope: _Scope) -> Column:
    parts = [F.lit("")]
    for n in nodes:
        if n.kind == "text":
            parts.append(F.lit(n.value))
        elif n.kind == "out":
            parts.append(_text(_value(_expression(n.value), scope)))
        elif n.kind == "set":
            scope = _assigned(n, scope)
        elif n.kind == "if":
            parts.append(_branches(n.parts, scope))
            scope = _chosen(n.parts, scope)
        else:
            m = re.fullmatch(r"(\w+)\s+in\s+(.+)", n.value)
            if not m:
                raise Unsupported(f"loop {n.value!r}")
            over = _value(_expression(m.group(2)), scope)
            if not isinstance(over, _Messages):
                raise Unsupported("a loop over something else than messages")
            body, name, array = n.parts, m.group(1), over.array
            parts.append(F.array_join(F.transform(array, lambda x, i: _render(
                body, scope.inner(**{name: _Message(x), "loop": _Loop(i, F.size(array))}))), ""))
    return F.concat(*parts)


def _assigned(node: _Node, scope: _Scope) -> _Scope:
    name, _, value = node.value.partition("=")
    if not name.strip().isidentifier():
        raise Unsupported(f"set {node.value!r}")
    return scope.inner(**{name.strip(): _value(_expression(value.strip()), scope)})


def _case(tests: list[Column | None], values: list[Column]) -> Column:
    """The value of the first test that holds; a test of None is the else."""
    out = None
    for test, value in zip(tests, values):
        if test is None:
            return value if out is None else out.otherwise(value)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def _branches(parts: list, scope: _Scope) -> Column:
    tests = [_truth(_expression(c), scope) if c else None for c, _ in parts]
    return _case([*tests, None], [*[_render(body, scope) for _, body in parts], F.lit("")])


def _chosen(parts: list, scope: _Scope) -> _Scope:
    """Names that the branches of a condition set, each as a CASE over the branches."""
    tests, ends = [], []
    for condition, body in parts:
        inner = scope
        for node in body:
            inner = _assigned(node, inner) if node.kind == "set" else inner
        tests.append(_truth(_expression(condition), scope) if condition else None)
        ends.append(inner)
    names = {node.value.partition("=")[0].strip() for _, body in parts for node in body if node.kind == "set"}
    if not names:
        return scope
    merged = {}
    for name in names:
        values = [e.names.get(name) for e in [*ends, scope]]
        lists = [v for v in values if isinstance(v, _Messages)]
        if lists:
            none = F.filter(lists[0].array, lambda x: F.lit(False))
            if any(v is not None and not isinstance(v, _Messages) for v in values):
                raise Unsupported(f"{name!r} is a list in one branch only")
            merged[name] = _Messages(_case([*tests, None], [v.array if v else none for v in values]))
        else:
            merged[name] = _case([*tests, None], [_text(v) for v in values])
    return scope.inner(**merged)


def compile_template(template: str, messages: Column, add_generation_prompt: bool = False, **tokens: str) -> Column:
    """The rendered text of ``messages`` (an array of role and content, without null elements; null contents print
    nothing). ``tokens`` are the model's special tokens, such as ``bos_token``."""
    nodes, _ = _parse(_tokens(template), 0, ())
    names = {"messages": _Messages(messages), "add_generation_prompt": add_generation_prompt, **tokens}
    return _render(nodes, _Scope(names))


def render_template(template: str, messages: Column, add_generation_prompt: bool = False, **tokens: str) -> Column:
    """``compile_template``, or the plain renderer's text where the template is outside the subset."""
    from tunedata.operators.formatters import render_messages

    try:
        return compile_template(template, messages, add_generation_prompt, **tokens)
    except Unsupported:
        return render_messages(messages)
