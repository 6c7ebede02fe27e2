"""Text expressions: normalization, cleaning, tokens, stemming, word counts.

Every function takes and returns a ``Column`` so the whole chain compiles into
one projection (whole-stage codegen, no Python hop).  Regexes are written to
follow Python's ``re`` semantics on ``str``:

* whitespace is the set ``str.isspace()`` accepts (Java ``\\s`` is ASCII only);
* word characters are ``[\\p{L}\\p{N}_]`` (Python ``\\w`` on ``str``);
* digits are ``\\p{Nd}``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import CLEANING_STOPWORDS, ENTITY_VOCAB, PUNCTUATION

# Characters Python's str.isspace() accepts.
WS = (r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS_CLASS = "[" + WS + "]"
NON_WS_CLASS = "[^" + WS + "]"
# A run of white space that is more than one space; the look ahead passes over printable ASCII at once.
WS_RUN = "(?![!-~])(?: " + WS_CLASS + "+|[" + WS + "&&[^ ]]" + WS_CLASS + "*)"
WORD_CLASS = r"[\p{L}\p{N}_]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bind(value, body) -> Column:
    """Evaluate ``value`` once and return ``body(v)`` with ``v`` bound to it.

    Expressions referenced several times inside conditional branches (CASE,
    OR chains) are not shared by subexpression elimination; binding them to a
    lambda variable computes them once per row.
    """
    return F.transform(F.array(_c(value)), body)[0]


def py_strip(col) -> Column:
    """Python ``str.strip()``: drop leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), "^" + WS_CLASS + "+|" + WS_CLASS + "+$", "")


def normalize_text(col) -> Column:
    """lower-case, collapse whitespace runs to one space, strip; null -> ''."""
    collapsed = F.regexp_replace(F.lower(_c(col)), WS_RUN, " ")
    return F.coalesce(F.trim(collapsed), F.lit(""))


def clean_text(col) -> Column:
    """normalize, drop URLs, e-mail addresses and 'order/invoice/ticket #123', re-collapse.

    After ``normalize_text`` the only whitespace left is a single space, so
    Python's ``\\S`` becomes ``[^ ]`` and ``\\s*`` becomes `` *``.
    """
    t = normalize_text(col)
    # Each pattern needs one of these substrings, so texts without them are not searched.  An address is a whole
    # word: no match is tried inside one.
    for pattern, marks in ((r"https?://[^ ]+|www\.[^ ]+", ("http", "www.")), (r"(?<![^ ])[^ ]+@[^ ]+", ("@",)),
                           (r"\b(order|invoice|ticket) *#?\p{Nd}+\b", ("order", "invoice", "ticket"))):
        t = bind(t, lambda x: F.when(reduce(or_, [x.contains(m) for m in marks]), F.regexp_replace(x, pattern, " ")).otherwise(x))
    return F.trim(F.regexp_replace(t, "  +", " "))


def remove_punctuation(col) -> Column:
    """delete the 32 ASCII punctuation marks (no space inserted)."""
    return F.translate(_c(col), PUNCTUATION, "")


def tokenize(col) -> Column:
    """word tokens, Python ``\\b\\w+\\b``; '' -> []."""
    words = F.split(F.regexp_replace(_c(col), r"[^\p{L}\p{N}_ ]+", " "), " ")     # a plain space needs no regex
    return F.filter(words, lambda w: w != "")


def remove_stopwords(tokens, stopwords: list[str] | None = None) -> Column:
    """drop tokens whose lower-case form is a stopword."""
    words = list(stopwords or CLEANING_STOPWORDS)        # looked up by hash, not one after the other
    return F.filter(_c(tokens), lambda x: ~F.lower(x).isin(words))


def lemmatize(tokens) -> Column:
    """'ies' -> 'y' when longer than 4; else drop a final 's' when longer than 3 and not 'ss'."""
    def stem(x: Column) -> Column:
        n = F.length(x)
        return (F.when(x.endswith("ies") & (n > 4), F.concat(F.substring(x, F.lit(1), n - 3), F.lit("y")))
                 .when(x.endswith("s") & (n > 3) & ~x.endswith("ss"), F.substring(x, F.lit(1), n - 1))
                 .otherwise(x))
    return F.transform(_c(tokens), stem)


def preprocess_text(col, stopwords: list[str] | None = None) -> Column:
    """clean -> punctuation -> tokens -> stopwords -> stems -> join with spaces."""
    tokens = tokenize(remove_punctuation(clean_text(col)))
    return F.array_join(lemmatize(remove_stopwords(tokens, stopwords)), " ")


def word_count(col) -> Column:
    """number of whitespace-separated words (Python ``len(str.split())``); null -> 0.

    After ``normalize_text`` words are separated by single spaces, so the count
    is the number of spaces plus one (no array is built).
    """
    return bind(normalize_text(col), lambda n: F.when(n == "", F.lit(0)).otherwise(
        F.length(n) - F.length(F.replace(n, F.lit(" "), F.lit(""))) + 1))


def extract_entities(normalized) -> Column:
    """F8: entity labels whose vocabulary hits the text as a substring, label order kept."""
    def labels(t: Column) -> Column:
        hits = []
        for label, words in ENTITY_VOCAB:
            cond = None
            for w in words:
                c = t.contains(w)
                cond = c if cond is None else (cond | c)
            hits.append(F.when(cond, F.lit(label)))
        return F.array_compact(F.array(*hits))
    if isinstance(normalized, str):
        return labels(F.col(normalized))
    return bind(normalized, labels)


# Template signature (F14).  The order of masks is part of the behaviour:
# numbers are masked first, so the ticket and date masks only fire when
# ``fixed=True`` puts them first.
_NUM = r"\$?\b\p{Nd}+(?:\.\p{Nd}+)?\b"
_TICKET = r"\bcmp-\p{Nd}+\b"
_DATE = r"\b\p{Nd}{1,2} +[a-z]{3} +\p{Nd}{4}\b"
_SEGMENT = (r"\bi am a +(student|smb|enterprise|premium|standard) +customer and this feels +[a-z]+\b\.?")
_ESCALATE = r"please escalate this immediately\.?"


def template_group(col, fixed: bool = False) -> Column:
    """md5 of the text with numbers, tickets, dates, segment and escalation masked."""
    t = normalize_text(col)
    steps = [(_NUM, "<num>"), (_TICKET, "<ticket>"), (_DATE, "<date>")]
    if fixed:
        steps = [steps[1], steps[2], steps[0]]
    for pattern, repl in steps + [(_SEGMENT, "<segment>"), (_ESCALATE, "<escalate>")]:
        t = F.regexp_replace(t, pattern, repl)
    t = F.trim(F.regexp_replace(t, " +", " "))
    return F.md5(t)


def join_texts(text, finding, joiner: str = "\n\nImage findings: ") -> Column:
    """customer text and an extra finding; both stripped, whichever is non-empty."""
    pair = F.struct(F.coalesce(py_strip(text), F.lit("")).alias("a"),
                    F.coalesce(py_strip(finding), F.lit("")).alias("b"))
    return bind(pair, lambda p: F.when((p["a"] != "") & (p["b"] != ""), F.concat(p["a"], F.lit(joiner), p["b"]))
                                 .when(p["a"] != "", p["a"]).otherwise(p["b"]))
