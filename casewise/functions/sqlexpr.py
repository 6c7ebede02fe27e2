"""Spark SQL expression text for large literal-heavy expressions.

Building a lexicon-sized expression from ``Column`` objects costs one JVM
round trip per node (thousands for the rule engine); the same expression as
one SQL string is parsed in a single call.  Only literals produced here are
embedded, always through ``lit``.
"""

from __future__ import annotations


def lit(s: str) -> str:
    """A Spark SQL string literal for any Python string.

    ``$`` is written as a unicode escape so SQL variable substitution
    (``${name}``) never rewrites literal text.
    """
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def strings(words) -> str:
    return "array(" + ", ".join(lit(w) for w in words) + ")"


def bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``: a column that a loop uses would else be computed in every turn,
    once the optimizer has put its expression in the column's place."""
    return f"transform(array({value}), {name} -> {body})[0]"


def any_contains(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(w)})" for w in words) + ")"


def count_contains(col: str, words: list[str]) -> str:
    """How many of ``words`` occur as substrings (compiled tests: a loop over a literal array would be interpreted)."""
    return "(" + " + ".join(f"CASE WHEN contains({col}, {lit(w)}) THEN 1 ELSE 0 END" for w in words) + ")" if words else "0"


def entities(col: str, vocab) -> str:
    """Entity labels whose vocabulary hits ``col`` as a substring, label order kept."""
    def needed(words):
        # A word that holds another word of its label adds no hit.
        return [w for w in dict.fromkeys(words) if not any(v != w and v in w for v in words)]

    rows = ", ".join(f"CASE WHEN {any_contains(col, needed(words))} THEN {lit(label)} END" for label, words in vocab)
    return f"array_compact(array({rows}))"
