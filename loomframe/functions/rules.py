"""Row rules: a Column, SQL text, or the method syntax ``col('x').between(0, 1) & ...``.

The method syntax is read as a syntax tree and rebuilt node by node from lists of what is allowed;
nothing is evaluated as Python.
"""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = {
    "between", "isNull", "isNotNull", "isNaN", "isin", "like", "ilike", "rlike", "contains", "startswith", "endswith",
    "cast", "try_cast", "substr", "eqNullSafe", "getItem", "getField",
}
FUNCTIONS = {
    "lit", "length", "lower", "upper", "trim", "ltrim", "rtrim", "abs", "round", "floor", "ceil", "coalesce", "isnan", "isnull",
    "to_date", "to_timestamp", "try_to_date", "year", "month", "dayofmonth", "dayofweek", "hour", "datediff", "current_date",
    "current_timestamp", "regexp_replace", "regexp_extract", "size", "least", "greatest", "concat", "substring", "instr",
}
OPERATORS = {
    ast.BitAnd: operator.and_, ast.BitOr: operator.or_, ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul,
    ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt,
    ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge,
}


def _built(node: ast.AST):
    match node:
        case ast.Constant(value=v):
            return v
        case ast.List(elts=items) | ast.Tuple(elts=items):
            return [_built(x) for x in items]
        case ast.UnaryOp(op=ast.Invert(), operand=x):
            return ~_built(x)
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -_built(x)
        case ast.BinOp(left=a, op=op, right=b) if type(op) in OPERATORS:
            return OPERATORS[type(op)](_built(a), _built(b))
        case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in OPERATORS:
            return OPERATORS[type(op)](_built(a), _built(b))
        case ast.Call(func=ast.Name(id="col"), args=[ast.Constant(value=str(name))], keywords=[]):
            return F.col(name)
        case ast.Call(func=ast.Attribute(value=ast.Name(id="F"), attr=name), args=args, keywords=[]):
            if name == "col":
                return F.col(_built(args[0]))
            if name in FUNCTIONS:
                return getattr(F, name)(*map(_built, args))
        case ast.Call(func=ast.Attribute(value=target, attr=name), args=args, keywords=[]) if name in METHODS:
            subject = _built(target)
            if isinstance(subject, Column):
                return getattr(subject, name)(*map(_built, args))
    raise ValueError(f"not allowed in a rule: {ast.dump(node)[:80]}")


def compiled(name: str, rule: str | Column) -> Column:
    """The rule as a Boolean column; ValueError if its text can be read in neither syntax."""
    if isinstance(rule, Column):
        return rule
    if "col(" in rule:
        try:
            built = _built(ast.parse(rule.strip(), mode="eval").body)
            if isinstance(built, Column):
                return built
            raise ValueError("it is not a column expression")
        except Exception as e:
            raise ValueError(f"Could not evaluate rule {name!r} ({rule!r}): {e}") from e
    try:
        return F.expr(rule)
    except Exception as e:
        raise ValueError(f"Could not evaluate rule {name!r} ({rule!r}): {e}") from e
