"""Arithmetic from text: a whitelist of operators, over constants or columns, or from a column of expressions."""

from __future__ import annotations

import ast
import operator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds that keep an expression from running away.
MOST_CHARS, MOST_DEPTH = 1000, 50


def _floor_div(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a, b))


def _floor_mod(a: Column, b: Column) -> Column:
    return a - b * _floor_div(a, b)


_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
    ast.FloorDiv: _floor_div,
    ast.Mod: _floor_mod,
    ast.Pow: F.pow,
}
_UNARY = {ast.UAdd: lambda a: a, ast.USub: lambda a: -a}


def compiled(expression: str, columns: dict[str, Column] | None = None) -> Column:
    """An expression as a column: numbers, ``+ - * / // % **``, signs, and the named columns.

    ``//`` floors and ``%`` takes the divisor's sign, as in Python; ``/`` is true division and ``**`` gives
    doubles. A division by zero is null. Anything else raises ValueError.
    """
    if len(expression) > MOST_CHARS:
        raise ValueError("the expression is too long")
    try:
        tree = ast.parse(expression.strip(), mode="eval").body
    except (SyntaxError, RecursionError, MemoryError) as e:
        raise ValueError("not an expression") from e

    def build(node: ast.AST, depth: int) -> Column:
        if depth > MOST_DEPTH:
            raise ValueError("the expression is too deep")
        match node:
            case ast.Constant(value=bool() | int() | float() as v):
                return F.lit(int(v) if isinstance(v, bool) else v)
            case ast.Name(id=name) if columns and name in columns:
                return columns[name]
            case ast.BinOp(left=a, op=o, right=b) if type(o) in _BINARY:
                return _BINARY[type(o)](build(a, depth + 1), build(b, depth + 1))
            case ast.UnaryOp(op=o, operand=a) if type(o) in _UNARY:
                return _UNARY[type(o)](build(a, depth + 1))
        raise ValueError("only numbers and arithmetic are allowed")

    return build(tree, 0)


# What an expression's result or its failing is called.
DIVISION, FORBIDDEN = "error: division by zero", "error: not allowed"
_ON_NUMBERS = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: operator.truediv,
    ast.FloorDiv: operator.floordiv,
    ast.Mod: operator.mod,
    ast.Pow: operator.pow,
    ast.UAdd: operator.pos,
    ast.USub: operator.neg,
}
#: Digits beyond which a power isn't worked out.
MOST_DIGITS = 4000


def _number(node: ast.AST, depth: int) -> int | float:
    if depth > MOST_DEPTH:
        raise ValueError
    match node:
        case ast.Constant(value=int() | float() as v):
            return v
        case ast.BinOp(left=a, op=o, right=b) if type(o) in _ON_NUMBERS:
            x, y = _number(a, depth + 1), _number(b, depth + 1)
            if type(o) is ast.Pow and isinstance(x, int) and isinstance(y, int) and y * abs(x).bit_length() > 3.32 * MOST_DIGITS:
                raise OverflowError
            return _ON_NUMBERS[type(o)](x, y)
        case ast.UnaryOp(op=o, operand=a) if type(o) in _ON_NUMBERS:
            return _ON_NUMBERS[type(o)](_number(a, depth + 1))
    raise ValueError


def answer(expression: str | None) -> str | None:
    """The result of one expression as text, or what is wrong with it; null for null."""
    if expression is None:
        return None
    try:
        if len(expression) > MOST_CHARS:
            return FORBIDDEN
        found = _number(ast.parse(expression.strip(), mode="eval").body, 0)
        return FORBIDDEN if isinstance(found, complex) else str(found)
    except ZeroDivisionError:
        return DIVISION
    except (SyntaxError, ValueError, TypeError, OverflowError, RecursionError, MemoryError):
        return FORBIDDEN


def answers(expression: Column) -> Column:
    """The result of each row's expression as text, as ``answer`` gives it. Integers have any number of digits."""

    @F.arrow_udf("string")
    def work_out(expressions: pa.Array) -> pa.Array:
        return pa.array([answer(e) for e in expressions.to_pylist()], pa.string())

    return work_out(expression)
