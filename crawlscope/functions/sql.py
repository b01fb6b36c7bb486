"""Columns that stay SQL text until a DataFrame uses them.

The extraction and the rules are expressions of several thousand nodes. Built one call at a time they cost seconds
on the driver before a job starts; as text the whole expression reaches Spark in one `expr` call. `F` has the
functions of `pyspark.sql.functions` under the same names and signatures, `Text` the operators of Column, and
both mix with ordinary Columns: as soon as one argument is not text, the pyspark function is used.
"""

from __future__ import annotations

import inspect
import itertools
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as P
from pyspark.sql.classic.column import Column as ClassicColumn
from pyspark.sql.types import DataType

_fresh = itertools.count()


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + "'"


def _name(path: str) -> str:
    return ".".join(p if p == "*" else f"`{p}`" for p in path.split("."))


def literal(v: Any) -> str:
    if isinstance(v, Text):
        return v._text
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return f"{v}L" if abs(v) > 2**31 - 1 else f"{v}" if v >= 0 else f"({v})"
    if isinstance(v, float):
        return f"{v!r}D" if v >= 0 else f"({v!r}D)"
    return _quote(v)


def _op(symbol: str, swap: bool = False):
    native = {"AND": "__and__", "OR": "__or__", "=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "+": "__add__", "-": "__sub__", "*": "__mul__", "/": "__truediv__", "%": "__mod__"}[symbol]
    if swap:
        native = native.replace("__", "__r", 1)

    def method(self, other):
        if isinstance(other, Column) and not isinstance(other, Text):
            return getattr(ClassicColumn, native)(self, other)
        a, b = self._text, literal(other)
        return Text(f"({b} {symbol} {a})" if swap else f"({a} {symbol} {b})")

    return method


class Text(ClassicColumn):
    def __init__(self, text: str, label: str | None = None):
        self.__dict__.update(_text=text, _label=label, _built=None)

    @property
    def _jc(self):
        if self.__dict__["_built"] is None:
            column = P.expr(self._text)
            self.__dict__["_built"] = (column.alias(self._label) if self._label else column)._jc
        return self.__dict__["_built"]

    __and__, __or__, __rand__, __ror__ = _op("AND"), _op("OR"), _op("AND", True), _op("OR", True)
    __eq__, __ne__, __lt__, __le__, __gt__, __ge__ = _op("="), _op("!="), _op("<"), _op("<="), _op(">"), _op(">=")
    __add__, __sub__, __mul__, __truediv__, __mod__ = _op("+"), _op("-"), _op("*"), _op("/"), _op("%")
    __radd__, __rsub__, __rmul__ = _op("+", True), _op("-", True), _op("*", True)
    __hash__ = ClassicColumn.__hash__

    def __invert__(self):
        return Text(f"(NOT {self._text})")

    def __neg__(self):
        return Text(f"(- {self._text})")

    def __getitem__(self, key):
        return Text(f"{self._text}[{literal(key)}]", key if isinstance(key, str) else None)

    def _call(self, name: str, *args):
        if any(isinstance(a, Column) and not isinstance(a, Text) for a in args):
            return getattr(ClassicColumn, name)(self, *args)
        return Text(f"{name}({', '.join([self._text, *map(literal, args)])})")

    def rlike(self, other):
        return Text(f"({self._text} RLIKE {literal(other)})")

    def contains(self, other):
        return self._call("contains", other)

    def startswith(self, other):
        return self._call("startswith", other)

    def endswith(self, other):
        return self._call("endswith", other)

    def isNull(self):
        return Text(f"({self._text} IS NULL)")

    def isNotNull(self):
        return Text(f"({self._text} IS NOT NULL)")

    def isin(self, *values):
        flat = values[0] if len(values) == 1 and isinstance(values[0], (list, set, tuple)) else values
        return Text(f"({self._text} IN ({', '.join(map(literal, flat))}))")

    def between(self, low, high):
        return Text(f"({self._text} BETWEEN {literal(low)} AND {literal(high)})")

    def cast(self, kind):
        return Text(f"CAST({self._text} AS {kind.simpleString() if isinstance(kind, DataType) else kind})", self._label)

    def try_cast(self, kind):
        return Text(f"TRY_CAST({self._text} AS {kind})", self._label)

    def alias(self, *names, **kwargs):
        if len(names) > 1 or kwargs:
            return ClassicColumn.alias(self, *names, **kwargs)
        return type(self)(self._text, names[0]) if type(self) is Text else Text(self._text, names[0])


class _When(Text):
    def __init__(self, branches: list[str], last: str | None = None):
        body = "CASE " + " ".join(branches) + (f" ELSE {last}" if last is not None else "") + " END"
        Text.__init__(self, body)
        self.__dict__["_branches"] = branches

    def when(self, cond, value):
        if _foreign(cond, value):
            return ClassicColumn.when(P.expr(self._text), cond, value)
        return _When([*self._branches, f"WHEN {cond._text} THEN {literal(value)}"])

    def otherwise(self, value):
        if _foreign(value):
            return _otherwise(self, value)
        return _When(self._branches, literal(value))


def _otherwise(case: _When, value: Column) -> Column:
    # An ordinary Column as last branch: test that no earlier branch applied.
    hit = P.expr("CASE " + " ".join(b.split(" THEN ", 1)[0] + " THEN true" for b in case._branches) + " ELSE false END")
    return P.when(hit, P.expr(case._text)).otherwise(value)


def _foreign(*args) -> bool:
    return any(isinstance(a, Column) and not isinstance(a, Text) for a in args)


# Arguments that pyspark takes as literals although they are strings; all other strings name columns.
_LITERAL = {
    "regexp_replace": (1, 2), "regexp_extract": (1,), "split": (1,), "array_join": (1, 2), "substring_index": (1,), "try_variant_get": (1, 2), "variant_get": (1, 2),
    "format_string": (0,), "concat_ws": (0,), "element_at": (1,), "array_contains": (1,), "array_position": (1,), "lpad": (2,), "decode": (1,), "encode": (1,), "instr": (1,),
    "date_format": (1,), "array_remove": (1,),
}
_DELEGATED = {"desc", "asc", "broadcast", "pandas_udf", "udf", "arrays_zip", "expr"}
_LAMBDA = {"transform", "filter", "exists", "forall", "aggregate", "array_sort"}


class _Functions:
    def __getattr__(self, name: str):
        native = getattr(P, name)
        if name in _DELEGATED:
            return native
        if name in _LAMBDA:
            return lambda *args: _with_lambda(name, native, args)
        fixed = _LITERAL.get(name, ())

        def call(*args):
            if _foreign(*args):
                return native(*args)
            parts = [literal(a) if not isinstance(a, str) or i in fixed else _name(a) for i, a in enumerate(args)]
            if name == "count_distinct":
                return Text(f"count(DISTINCT {', '.join(parts)})")
            return Text(f"{name}({', '.join(parts)})")

        return call

    def col(self, name: str) -> Text:
        return Text(_name(name), name.split(".")[-1] if name != "*" else None)

    def lit(self, value) -> Column:
        return value if isinstance(value, Column) else Text(literal(value))

    def when(self, cond, value):
        return P.when(cond, value) if _foreign(cond, value) else _When([f"WHEN {cond._text} THEN {literal(value)}"])

    def struct(self, *args):
        if _foreign(*args):
            return P.struct(*args)
        parts = []
        for i, a in enumerate(args):
            label, text = (a.split(".")[-1], _name(a)) if isinstance(a, str) else (a._label or f"col{i + 1}", a._text)
            parts.append(f"{_quote(label)}, {text}")
        return Text(f"named_struct({', '.join(parts)})")


def _lambda(fn) -> tuple[str, Any]:
    names = [f"v{next(_fresh)}_" for _ in inspect.signature(fn).parameters]
    body = fn(*[Text(n) for n in names])
    head = names[0] if len(names) == 1 else f"({', '.join(names)})"
    return head, body


def _with_lambda(name: str, native, args):
    parts = []
    for a in args:
        if callable(a) and not isinstance(a, Column):
            head, body = _lambda(a)
            if _foreign(body):
                return native(*args)
            parts.append(f"{head} -> {literal(body)}")
        elif _foreign(a):
            return native(*args)
        else:
            parts.append(_name(a) if isinstance(a, str) else literal(a))
    return Text(f"{name}({', '.join(parts)})")


F = _Functions()
