"""Name templates such as ``<year>-<##month>_<###(index+1)>`` as columns.

Text outside ``<...>`` is literal.  A part inside is a Spark SQL expression over an
allow-list of variables and functions; Spark parses and runs it.  Only spelling that
Spark does not know is rewritten: ``##`` padding, ``tag.year``, ``name.upper()``,
``size[0]``, ``name[:3]`` and whole-number division.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .values import DATE_PARTS

PART = re.compile(r"<([^<>]+?)>")
_TOKEN = re.compile(
    r"\s*(?:(?P<str>'[^'\\]*'|\"[^\"\\]*\")|(?P<num>\d+(?:\.\d+)?)"
    r"|(?P<name>[A-Za-z]\w*)(?P<attr>\.[a-z]+)?(?P<call>\(\s*\))?(?P<index>\[\s*\d+\s*\])?"
    r"(?P<slice>\[\s*\d*\s*:\s*\d*\s*\])?"
    r"|(?P<op>\*\*|//|<=|>=|==|!=|[-+*/%(),]))"
)

# Functions a template may call, with their Spark SQL names.
FUNCTIONS = {
    "abs": "abs", "int": "bigint", "min": "least", "max": "greatest", "pow": "power",
    "str": "string", "chr": "chr", "lower": "lower", "upper": "upper", "title": "initcap",
    "sqrt": "sqrt", "floor": "floor", "ceil": "ceil", "exp": "exp", "log": "ln", "log10": "log10",
    "sin": "sin", "cos": "cos", "tan": "tan", "asin": "asin", "acos": "acos", "atan": "atan",
    "radians": "radians", "degrees": "degrees", "fabs": "abs", "round": "round",
    "random": "rand", "now": "current_timestamp",
}
CONSTANTS = {"True": "true", "False": "false", "pi": "pi()", "e": "e()"}
TEXT_METHODS = {"lower": "lower", "upper": "upper", "title": "initcap"}
RATIONAL_PARTS = {"numerator": 0, "denominator": 1}
TAG_NAME = re.compile(r"^(Exif|Iptc)_\w+$")


# Parts with one of these work with fractions; in others ``/`` divides whole numbers.
_FRACTIONS = re.compile(
    r"\d\.\d|\b(sqrt|sin|cos|tan|asin|acos|atan|log|log10|exp|radians|degrees|fabs|random|pi|e|aspect|gamma)\b")


class UnsafeTemplate(ValueError):
    """A template uses a name that is not allowed."""


def _tokens(expr: str):
    pos = 0
    while pos < len(expr):
        m = _TOKEN.match(expr, pos)
        if not m or m.end() == pos:
            if expr[pos:].strip() == "":
                return
            raise UnsafeTemplate(f"not understood: {expr[pos:]!r}")
        yield m
        pos = m.end()


def _sql_name(name: str, variables: set[str]) -> str:
    if name in variables:
        return f"`{name}`"
    if TAG_NAME.match(name) and "tags" in variables:
        return f"tags['{name}']"
    raise UnsafeTemplate(f"the following name is invalid: {name}")


def _rewrite(expr: str, variables: set[str]) -> str:
    """One template part in Spark SQL spelling; raises on any name outside the allow-list."""
    out = []
    divide = " / " if _FRACTIONS.search(expr) else " div "
    for m in _tokens(expr):
        name = m.group("name")
        if not name:
            op = m.group("op")
            if op == "**":
                raise UnsafeTemplate("write pow(a, b) for powers")
            number = m.group("num") or ""
            out.append({"//": " div ", "/": divide, "==": "="}.get(op, m.group(0)) + ("D" if "." in number else ""))
            continue
        attr, call, index = (m.group(k) for k in ("attr", "call", "index"))
        follows_paren = expr[m.end():].lstrip().startswith("(")
        if attr is None and (call or follows_paren):
            if name not in FUNCTIONS:
                raise UnsafeTemplate(f"the following name is invalid: {name}")
            out.append(" " + FUNCTIONS[name] + (call or ""))
            continue
        if attr is None and name in CONSTANTS and name not in variables:
            out.append(" " + CONSTANTS[name])
            continue
        if name == "size" and index and name not in variables:
            name, index = ("width", "height")[int(index.strip("[] "))], None
        sql = _sql_name(name, variables)
        if attr:
            part = attr[1:]
            if call and part in TEXT_METHODS:
                sql = f"{TEXT_METHODS[part]}({sql})"
            elif not call and part in DATE_PARTS:
                t = f"try_to_timestamp(cast({sql} as string), 'yyyy:MM:dd HH:mm:ss')"
                sql = DATE_PARTS[part].replace("(t", f"({t}")
            elif not call and part in RATIONAL_PARTS:
                sql = f"bigint(split({sql}, '/')[{RATIONAL_PARTS[part]}])"
            else:
                raise UnsafeTemplate(f"the following name is invalid: {name}{attr}")
        if index:
            sql = f"element_at(split({sql}, ' '), {int(index.strip('[] ')) + 1})"
        if m.group("slice"):
            first, last = (p.strip() for p in m.group("slice").strip("[] ").split(":"))
            first = int(first or 0)
            sql = f"substring({sql}, {first + 1}" + (f", {max(int(last) - first, 0)})" if last else ")")
        out.append(" " + sql)
    return "".join(out).strip()


def sql_of(expr: str, variables) -> str:
    """Spark SQL of one part, its ``###`` padding included."""
    expr = expr.strip()
    hashes = len(expr) - len(expr.lstrip("#"))
    body = expr[hashes:]
    if "#" in body:
        raise UnsafeTemplate("padding stands at the start of a part")
    sql = _rewrite(body, set(variables))
    if hashes:
        sql = f"format_string('%0{hashes}d', cast({sql} as bigint))"
    # least, greatest and format_string would pass over a missing value
    needed = [_sql_name(n, set(variables)) for n in sorted(required_vars(f"<{body}>"))]
    if needed and re.search(r"\b(min|max)\b", body) or needed and hashes:
        return f"CASE WHEN {' AND '.join(f'{n} IS NOT NULL' for n in needed)} THEN {sql} END"
    return sql


def check_template(text: str, variables) -> list[str]:
    """Messages for every part that is not allowed; empty when the template is safe."""
    bad = []
    for m in PART.finditer(text):
        try:
            sql_of(m.group(1), variables)
        except UnsafeTemplate as e:
            bad.append(str(e))
    return bad


def required_vars(text: str) -> set[str]:
    """Variables a template reads."""
    names = set()
    for part in PART.finditer(text):
        expr = part.group(1).lstrip("#")
        for m in _tokens(expr):
            name = m.group("name")
            called = m.group("attr") is None and (m.group("call") or expr[m.end():].lstrip().startswith("("))
            if name and not called and name not in CONSTANTS:
                names.update(("width", "height") if name == "size" else (name,))
    return names


def pieces(text: str):
    """(is expression, text) in order."""
    pos = 0
    for m in PART.finditer(text):
        if m.start() > pos:
            yield False, text[pos:m.start()]
        yield True, m.group(1)
        pos = m.end()
    if pos < len(text):
        yield False, text[pos:]


def template(text: str, variables) -> Column:
    """Text column.  NULL when a variable it reads is NULL, so that a missing tag never
    ends up as part of a name."""
    cols = [
        F.expr(sql_of(t, variables)).cast("string") if is_expr else F.lit(t)
        for is_expr, t in pieces(text)
    ]
    return F.concat(*cols) if cols else F.lit("")


def number(text: str, variables) -> Column:
    """Numeric column of a template that is one expression, such as ``<min(width,height)>``."""
    return template(text, variables).try_cast("double")
