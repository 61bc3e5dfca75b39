"""Mathematical relations between literals, as Column expressions and as predicates of graph patterns.

A pattern (subject, math:name, object) computes the object from a bound subject, or tests both. Pair and list
relations take an array as their subject. What isn't a number has no result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "math:"


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _at(c: Column, k: int) -> Column:
    return F.get(c, k).try_cast("double")


def _items(c: Column) -> Column:
    return F.transform(c, lambda x: x.try_cast("double"))


UNARY: dict[str, Callable[[Column], Column]] = {
    "absoluteValue": F.abs,
    "cos": F.cos,
    "degrees": lambda x: x * math.pi / 180,  # degrees are taken to radians
    "equalTo": lambda x: x,
    "negation": lambda x: -x,
    "rounded": lambda x: F.floor(x).cast("double"),
    "sin": F.sin,
    "sinh": F.sinh,
    "tan": F.tan,
    "tanh": F.tanh,
}
#: The subjects of those that can be turned round.
REVERSE: dict[str, Callable[[Column], Column]] = {
    "cos": F.acos,
    "degrees": lambda x: x * 180 / math.pi,
    "equalTo": lambda x: x,
    "negation": lambda x: -x,
    "sin": F.asin,
    "sinh": F.asinh,
    "tan": F.atan,
    "tanh": F.atanh,
}
PAIR: dict[str, Callable[[Column, Column], Column]] = {
    "atan2": F.atan2,
    "difference": lambda a, b: a - b,
    "exponentiation": F.pow,
    "integerQuotient": lambda a, b: F.floor(F.try_divide(a, b)).cast("double"),
    "quotient": F.try_divide,
    "remainder": lambda a, b: F.when(b != 0, a % b),
}
LIST: dict[str, Callable[[Column], Column]] = {
    "sum": lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x),
    "product": lambda xs: F.aggregate(xs, F.lit(1.0), lambda a, x: a * x),
}
COMPARISON: dict[str, Callable[[Column, Column], Column]] = {
    "greaterThan": lambda a, b: a > b,
    "lessThan": lambda a, b: a < b,
    "notGreaterThan": lambda a, b: a <= b,
    "notLessThan": lambda a, b: a >= b,
    "notEqualTo": lambda a, b: a != b,
}
NAMES = (*UNARY, *PAIR, *LIST, *COMPARISON)


def value(name: str, subject: Column) -> Column:
    """The object that a relation gives a subject: a number, or an array for pairs and lists."""
    if name in UNARY:
        return UNARY[name](_number(subject))
    if name in PAIR:
        return PAIR[name](_at(subject, 0), _at(subject, 1))
    if name in LIST:
        return LIST[name](_items(subject))
    raise ValueError(f"{name} tests both sides")


def subject_of(name: str, obj: Column) -> Column:
    """The subject that a relation turned round gives an object."""
    if name not in REVERSE:
        raise ValueError(f"{name} can't be turned round")
    return REVERSE[name](_number(obj))


def holds(name: str, subject: Column, obj: Column) -> Column:
    """If the relation holds between both; false where one isn't a number."""
    if name in COMPARISON:
        return F.coalesce(COMPARISON[name](_number(subject), _number(obj)), F.lit(False))
    return F.coalesce(F.abs(value(name, subject) - _number(obj)) < 1e-9, F.lit(False))
