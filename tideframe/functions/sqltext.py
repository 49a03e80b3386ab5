"""SQL text: quoting, tables of a statement, errors in one line, results compared."""

from __future__ import annotations

import math
import re


def identifier(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value) -> str:
    """A SQL literal of a plain value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def error_text(error: Exception) -> str:
    """The message without class names, error classes and plans."""
    text = str(getattr(error, "desc", None) or error).split("\n")[0]
    text = re.sub(r"^(?:[\w.$]+(?:Error|Exception):\s*)+", "", text)
    text = re.sub(r"^\[[A-Z0-9_.]+\]\s*", "", text)
    return re.sub(r"\s*SQLSTATE:.*$", "", text).strip()


def tables(spark, text: str) -> list[str]:
    """Names of the tables that one statement reads, without its own common table expressions."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    names, own, todo = [], set(), [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            names.append(node.multipartIdentifier().mkString("."))
        if kind == "UnresolvedWith":
            for i in range(node.cteRelations().size()):
                pair = node.cteRelations().apply(i)
                own.add(pair._1().lower())
                todo.append(pair._2())
        for group in (node.children(), node.innerChildren() if kind == "SubqueryAlias" else node.children().take(0)):
            todo += [group.apply(i) for i in range(group.size())]
    return sorted({n for n in names if n.lower() not in own})


def same_rows(got: list, want: list, tolerance: float = 1e-9) -> bool:
    """Whether results agree row by row, doubles within a relative tolerance."""

    def same(a, b) -> bool:
        if isinstance(a, float) and isinstance(b, float):
            return math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=tolerance)
        return a == b

    return len(got) == len(want) and all(len(a) == len(b) and all(map(same, a, b)) for a, b in zip(got, want))
