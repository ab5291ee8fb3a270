"""Small helpers for SQL expression text.

The column functions take and return SQL expression text: a rule set of a few
hundred operators then reaches the JVM as a few parsed expressions instead of
one call per operator.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def q(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listed(values: Iterable[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def true(condition: str) -> str:
    """NULL counts as false."""
    return f"coalesce({condition}, false)"


def any_of(conditions: Iterable[str]) -> str:
    return "(" + " OR ".join(conditions) + ")"


def lookup(key: str, table: Mapping[object, object], default: str = "NULL") -> str:
    """Value of a small literal table, the default where the key is absent."""
    shown = lambda v: q(v) if isinstance(v, str) else str(v)
    cases = " ".join(f"WHEN {shown(k)} THEN {shown(v)}" for k, v in table.items())
    return f"CASE {key} {cases} ELSE {default} END"


def kept(texts: Iterable[str]) -> str:
    """Array of the non-NULL texts, in order.

    ``array_remove`` compiles into whole-stage code, unlike ``filter`` and
    ``array_compact``; right for short entries such as names and codes.
    """
    return "array_remove(array(" + ", ".join(f"coalesce({t}, '')" for t in texts) + "), '')"


def kept_long(texts: Iterable[str]) -> str:
    """The same for many composed texts.

    Their code would make one method too large for the JVM to optimise, so
    here ``filter`` is the better choice: it takes this projection, and only
    this one, out of whole-stage code.
    """
    return "filter(array(" + ", ".join(texts) + "), t -> t IS NOT NULL)"


def fill(template: str, **values: str) -> str:
    """A text template with its ``{name}`` places filled by expressions."""
    parts, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if head:
            parts.append(q(head))
        parts.append(values[name])
    if rest:
        parts.append(q(rest))
    return f"concat({', '.join(parts)})"


def settled(columns: Mapping[str, str]) -> str:
    """Computed columns as a generator of one row.

    A filter on a plain computed column is pushed below the projection with
    the whole expression copied in; nested ones grow exponentially. It stays
    above a generator and reads the value. Only for columns that decide, since
    a generator computes all of them.
    """
    return "inline(array(named_struct(" + ", ".join(f"{q(n)}, {e}" for n, e in columns.items()) + ")))"


def as_list(columns: Mapping[str, str]) -> list[str]:
    """``{name: expression}`` as arguments of ``selectExpr``."""
    return [f"{e} AS {n}" for n, e in columns.items()]
