"""Python expressions over column names, as Spark columns.

An expression is parsed, never run: an allow-list of syntax and functions is translated, everything else is an error.
Arithmetic keeps Python's meaning: / is true division, // and % round and sign as Python's do, and + joins texts. Where
the meaning hangs on types, they are those of the DataFrame that the expression is for; without one, + of two columns is a
sum and // goes through a double.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The DataFrame that the expression being translated is for.
_FOR: ContextVar[DataFrame | None] = ContextVar("for", default=None)
_WHOLE = ("tinyint", "smallint", "int", "bigint")


class ExpressionError(ValueError):
    """The expression has something that isn't translated."""


def _kinds(*columns: Column) -> list[str] | None:
    """The types of columns over the DataFrame at hand; only the analyzer runs."""
    df = _FOR.get()
    return None if df is None else [k for _, k in df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).dtypes]


def _floor_mod(a: Column, b: Column) -> Column:
    rest = a % b
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def _floor_div(a: Column, b: Column) -> Column:
    kinds = _kinds(a, b)
    if kinds is None or any(k not in _WHOLE for k in kinds):
        return F.floor(a / b)
    rest = a % b
    down = (rest != 0) & ((rest < 0) != (b < 0))
    return F.call_function("div", a, b) - F.when(down, F.lit(1)).otherwise(F.lit(0)).cast("long")


def _add(a: Column, b: Column) -> Column:
    return F.concat(a, b) if (_kinds(a, b) or [""])[0] == "string" else a + b


def _bits(name: str) -> Callable[[Column, Column], Column]:
    return lambda a, b: getattr(a, name)(b)


_BINARY = {
    ast.Add: _add,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: a / b,
    ast.Mod: _floor_mod,
    ast.FloorDiv: _floor_div,
    ast.Pow: lambda a, b: F.pow(a, b),
    ast.BitAnd: _bits("bitwiseAND"),
    ast.BitOr: _bits("bitwiseOR"),
    ast.BitXor: _bits("bitwiseXOR"),
    ast.LShift: lambda a, b: F.call_function("shiftleft", a, b.cast("int")),
    ast.RShift: lambda a, b: F.call_function("shiftright", a, b.cast("int")),
}
_UNARY = {ast.Not: lambda a: ~a, ast.USub: lambda a: -a, ast.UAdd: lambda a: a, ast.Invert: F.bitwise_not}
_COMPARE = {
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Is: lambda a, b: a.eqNullSafe(b),
    ast.IsNot: lambda a, b: ~a.eqNullSafe(b),
}
_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs,
    "round": lambda a, n=None: F.bround(a, n) if n is not None else F.bround(a, 0).cast("long"),
    "len": F.length,
    "min": F.least,
    "max": F.greatest,
    "int": lambda a: F.when(a.cast("double") < 0, F.ceil(a.cast("double"))).otherwise(F.floor(a.cast("double"))),
    "float": lambda a: a.cast("double"),
    "str": lambda a: a.cast("string"),
    "hash": lambda a: F.hash(a),
    "sqrt": F.sqrt,
    "floor": F.floor,
    "ceil": F.ceil,
    "exp": F.exp,
    "log": lambda a: F.ln(a),
    "year": lambda a: F.year(a),
}
_METHODS: dict[str, Callable[..., Column]] = {
    "startswith": lambda s, x: F.startswith(s, x),
    "endswith": lambda s, x: F.endswith(s, x),
    "upper": F.upper,
    "lower": F.lower,
    "strip": F.trim,
    "lstrip": F.ltrim,
    "rstrip": F.rtrim,
    "replace": lambda s, a, b: F.replace(s, a, b),
}


def parse(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"not an expression: {text!r}") from e


def _constant(node: ast.expr):
    try:
        return ast.literal_eval(node)
    except ValueError:
        raise ExpressionError(f"not a literal: {ast.unparse(node)}") from None


def _is_text(node: ast.expr) -> bool:
    return isinstance(node, ast.Constant) and isinstance(node.value, str)


def to_column(node: ast.expr) -> Column:
    if isinstance(node, ast.Name):
        return F.col(f"`{node.id}`")
    if isinstance(node, ast.Constant):
        if node.value is not None and not isinstance(node.value, (bool, int, float, str)):
            raise ExpressionError(f"no literal of this kind: {node.value!r}")
        return F.lit(node.value)
    if isinstance(node, ast.BinOp):
        left, right = to_column(node.left), to_column(node.right)
        if isinstance(node.op, ast.Add) and (_is_text(node.left) or _is_text(node.right)):
            return F.concat(left, right)
        if type(node.op) in _BINARY:
            return _BINARY[type(node.op)](left, right)
    if isinstance(node, ast.UnaryOp):
        return _UNARY[type(node.op)](to_column(node.operand))
    if isinstance(node, ast.BoolOp):
        parts = [to_column(v) for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return out
    if isinstance(node, ast.Compare):
        return _compare(node)
    if isinstance(node, ast.IfExp):
        return F.when(to_column(node.test), to_column(node.body)).otherwise(to_column(node.orelse))
    if isinstance(node, ast.Call):
        return _call(node)
    if isinstance(node, ast.Subscript):
        return _subscript(node)
    raise ExpressionError(f"not translated: {ast.unparse(node)}")


def _compare(node: ast.Compare) -> Column:
    out, left = None, node.left
    for op, right in zip(node.ops, node.comparators):
        if isinstance(op, (ast.In, ast.NotIn)):
            if isinstance(right, (ast.List, ast.Tuple, ast.Set, ast.Dict)):
                one = to_column(left).isin(*_constant(right))
            else:
                one = F.contains(to_column(right), to_column(left))
            one = ~one if isinstance(op, ast.NotIn) else one
        else:
            one = _COMPARE[type(op)](to_column(left), to_column(right))
        out, left = one if out is None else out & one, right
    return out


def _call(node: ast.Call) -> Column:
    if node.keywords or any(isinstance(a, ast.Starred) for a in node.args):
        raise ExpressionError(f"not translated: {ast.unparse(node)}")
    if isinstance(node.func, ast.Attribute):
        owner, name = node.func.value, node.func.attr
        if isinstance(owner, ast.Name) and owner.id == "math" and name in _FUNCTIONS:
            return _FUNCTIONS[name](*map(to_column, node.args))
        if name in _METHODS:
            return _METHODS[name](to_column(owner), *map(to_column, node.args))
    elif isinstance(node.func, ast.Name) and node.func.id in _FUNCTIONS:
        if node.func.id == "round" and len(node.args) == 2:
            return _FUNCTIONS["round"](to_column(node.args[0]), int(_constant(node.args[1])))
        return _FUNCTIONS[node.func.id](*map(to_column, node.args))
    raise ExpressionError(f"no such function: {ast.unparse(node.func)}")


def _subscript(node: ast.Subscript) -> Column:
    text, at = to_column(node.value), node.slice
    if not isinstance(at, ast.Slice):
        i = int(_constant(at))
        return F.substring(text, i + 1 if i >= 0 else i, 1)
    if at.step is not None:
        raise ExpressionError("slices have no step")
    a, b = (None if x is None else int(_constant(x)) for x in (at.lower, at.upper))
    n = F.length(text)
    start = F.lit(0) if a is None else F.greatest(n + a, F.lit(0)) if a < 0 else F.lit(a)
    end = n if b is None else F.greatest(n + b, F.lit(0)) if b < 0 else F.lit(b)
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def column(expr: str | Column, df: DataFrame | None = None) -> Column:
    """The column that a Python expression describes, over df."""
    if isinstance(expr, Column):
        return expr
    with _over(df):
        return to_column(parse(expr))


@contextmanager
def _over(df: DataFrame | None):
    token = _FOR.set(df)
    try:
        yield
    finally:
        _FOR.reset(token)


def attributes(expr: str) -> set[str]:
    """The names of columns in an expression."""
    names = {n.id for n in ast.walk(parse(expr)) if isinstance(n, ast.Name)}
    called = {n.func.id for n in ast.walk(parse(expr)) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    return names - called - {"math"}


def conjuncts(expr: str) -> list[str]:
    """The parts of a conjunction, as text; an `and` below a `not` or an `or` is no part of its own."""

    def parts(node: ast.expr) -> list[ast.expr]:
        if isinstance(node, ast.BoolOp) and isinstance(node.op, ast.And):
            return [p for v in node.values for p in parts(v)]
        return [node]

    return [ast.unparse(p) for p in parts(parse(expr))]
