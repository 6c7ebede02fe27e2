"""Word phrases of rule terms: patterns unfolded to the finite sets of texts they match.

A normalized text has one space between words.  ``word_text`` puts a mark in
place of every run of other characters and a space around everything, so a
phrase stands in a text between word borders exactly if ``" phrase "`` is a
substring of ``word_text``.

Matching takes one pass over the words: ``present`` are those (found by hash) in
the vocabulary, one word of every phrase.  A text holds few of them, so only the
phrases of these words are looked at, and only those of several words are searched
for.  No term is a regex any more.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for everything that is neither a word character nor a space.
MARK = "\x01"
NOT_WORDS = r"[^\p{L}\p{N}_ ]+"
#: Patterns with more texts than this stay regexes.
MOST = 256

_P = re._parser  # type: ignore[attr-defined]
_C = re._constants  # type: ignore[attr-defined]


def _is_space(items) -> bool:
    return len(items) == 1 and items[0][0] is _C.IN and list(items[0][1]) == [(_C.CATEGORY, _C.CATEGORY_SPACE)]


def _texts(items) -> list[str] | None:
    """All texts of a parsed pattern, one space for any white space; None if they are not finitely many."""
    found = [""]
    for op, arg in items:
        if op is _C.LITERAL:
            part = [chr(arg)]
        elif op is _C.SUBPATTERN:
            part = _texts(arg[3]) if not arg[1] and not arg[2] else None
        elif op is _C.BRANCH:
            parts = [_texts(b) for b in arg[1]]
            part = None if None in parts else [t for p in parts for t in p]
        elif op is _C.MAX_REPEAT:
            low, high, inner = arg
            if _is_space(inner):
                part = ([""] if low == 0 else []) + [" "] if low <= 1 else None
            else:
                one = _texts(inner)
                part = None if one is None or high > 3 else ["".join(c) for n in range(low, high + 1) for c in product(one, repeat=n)]
        elif _is_space([(op, arg)]):
            part = [" "]
        else:
            part = None
        if part is None or len(found) * len(part) > MOST:
            return None
        found = [a + b for a in found for b in part]
    return found


def unfold(pattern: str) -> list[str] | None:
    r"""The phrases that a pattern ``\b...\b`` matches in a normalized text; None if it has to stay a regex."""
    items = list(_P.parse(pattern))
    border = (_C.AT, _C.AT_BOUNDARY)
    if len(items) < 3 or items[0] != border or items[-1] != border:
        return None
    found = _texts(items[1:-1])
    if not found or not all(re.fullmatch(r"\w+( \w+)*", t) for t in found):
        return None
    return sorted(set(found))


def anchors(phrases: list[str]) -> dict[str, str]:
    """One word for each phrase: the longest of a phrase's words, but a word that is a phrase itself only if it is all of it."""
    alone = {p for p in phrases if " " not in p}
    return {p: p if p in alone else max(p.split(" "), key=lambda w: (w not in alone, len(w), w)) for p in phrases}


def present(words: Column, vocabulary: list[str]) -> Column:
    """The words of ``word_text`` that are in the vocabulary, as often as the text has them."""
    return F.filter(F.split(words, " "), lambda x: x.isin(vocabulary))


def word_text(normalized: Column) -> Column:
    """The words of a normalized text between spaces, ``MARK`` for what stands between them otherwise."""
    return F.concat(F.lit(" "), F.regexp_replace(normalized, NOT_WORDS, f" {MARK} "), F.lit(" "))
