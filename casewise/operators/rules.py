"""C1 rule triage: weighted keyword and pattern rules as one projection.

The lexicon is a plan-time constant (77 terms).  Keywords and patterns are
unfolded to the finite sets of word phrases that they match, the text is
rewritten once to words between spaces, and a term is a search for its phrases
in it (``functions.phrases``); a custom term that matches infinitely many
texts stays a guarded regex.  All of it is one projection: no shuffle, no
join, no Python, and the same expression works on a streaming DataFrame.
Scores are carried in half-points (keyword 1.5 -> 3) so sums, the arg-max and
its tie-break (first issue in lexicon order) are exact integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import lexicon as L
from ..functions.scores import clamp_milli, highest_priority, milli_to_double, reasoning
from ..functions import sqlexpr as X
from ..functions.phrases import anchors, present, unfold, word_text
from ..functions.text import normalize_text

_TMP = "_rt_"


def _when_chain(pairs, default):
    out = default
    for cond, val in reversed(pairs):
        out = F.when(cond, val).otherwise(out)
    return out


def urgency(t_name: str) -> list[Column]:
    """numbers of critical, high and medium urgency terms (substrings of column ``t_name``), and whether it has ``!!!``."""
    found = [F.expr(X.count_contains(X.ident(t_name), terms)).alias(_TMP + name) for name, terms in (
        ("crit", L.CRITICAL_PRIORITY_TERMS), ("high", L.HIGH_PRIORITY_TERMS), ("med", L.MEDIUM_PRIORITY_TERMS))]
    return found + [F.col(t_name).contains("!!!").alias(_TMP + "loud")]


def detect_priority(default_priority: Column):
    """columns of ``urgency`` -> (priority, factor in hundredths)."""
    crit, high, med, loud = (F.col(_TMP + name) for name in ("crit", "high", "med", "loud"))
    prio = _when_chain([
        (crit >= 1, F.lit("Critical")),
        (loud | (high >= 2), F.lit("High")),
        (high == 1, highest_priority(default_priority, F.lit("High"))),
        (med >= 1, highest_priority(default_priority, F.lit("Medium"))),
    ], default_priority)
    factor = _when_chain([
        (crit >= 1, F.lit(100)),
        (loud | (high >= 2), F.lit(98)),
        (high == 1, F.lit(90)),
        (med >= 1, F.lit(75)),
    ], F.when(default_priority == "Critical", F.lit(65)).otherwise(F.lit(60)))
    return prio, factor


def _texts(values) -> str:
    return "array(" + ", ".join(X.lit(v) for v in values) + ")"


def _numbers(values) -> str:
    return "array(" + ", ".join(map(str, values)) + ")"


def _guarded(t: str, term: L.Term) -> str:
    """``t rlike regex``, skipped when none of the term's required substrings occurs."""
    if not term.required:
        return f"({t} RLIKE {X.lit(term.regex)})"
    return f"(CASE WHEN {X.any_contains(t, term.required)} THEN {t} RLIKE {X.lit(term.regex)} ELSE false END)"


def with_hits(df: DataFrame, terms: list[L.Term]) -> DataFrame:
    """``df`` (column ``_rt_t``: normalized text) with ``_rt_hits``: the positions in ``terms`` of those that match, rising."""
    t, w, p = (X.ident(_TMP + c) for c in "twp")
    owners: dict[str, list[int]] = {}
    loose = []
    for at, term in enumerate(terms):
        phrases = unfold(term.regex)
        if not phrases:
            loose.append(f"CASE WHEN {_guarded(t, term)} THEN {at} END")
        for phrase in phrases or ():
            owners.setdefault(phrase, []).append(at)
    found = []
    if owners:
        anchor = anchors(sorted(owners))
        df = df.withColumn(_TMP + "w", word_text(F.col(_TMP + "t")))
        df = df.withColumn(_TMP + "p", present(F.col(_TMP + "w"), sorted(set(anchor.values()))))
        # Each word of the vocabulary gives its phrases: 's' is what to search for, nothing for the word itself.
        phrases_of: dict[str, list[str]] = {}
        for x in sorted(owners):
            s = X.lit("" if anchor[x] == x else f" {x} ")
            phrases_of.setdefault(anchor[x], []).append(f"named_struct('s', {s}, 'f', {_numbers(owners[x])})")
        table = f"map_from_arrays({_texts(phrases_of)}, array({', '.join(f'array({', '.join(rows)})' for rows in phrases_of.values())}))"
        said = X.bound(f"named_struct('p', {p}, 'w', {w})", "b", (
            f"filter(flatten(transform(b.p, x -> element_at({table}, x))), r -> contains(b.w, r.s))"))
        found.append(f"flatten(transform({said}, r -> r.f))")
    if loose:
        found.append(f"array_compact(array({', '.join(loose)}))")
    all_hits = f"concat({', '.join(found)})" if found else "CAST(array() AS ARRAY<INT>)"
    hits = f"array_sort(array_distinct({all_hits}))"
    return df.withColumn(_TMP + "hits", F.expr(f"CASE WHEN size({p}) = 0 THEN CAST(array() AS ARRAY<INT>) ELSE {hits} END"
                                               if owners and not loose else hits))


def _lit_array(values):
    return F.array(*[F.lit(v) for v in values])


def rule_triage(df: DataFrame, text_col: str = "complaint_text", out_col: str = "analysis",
                terms: list[L.Term] | None = None, keep_scores: bool = False) -> DataFrame:
    """Add the rule verdict struct ``out_col`` for every row of ``df``.

    ``terms`` defaults to the built-in lexicon; a caller can pass another list
    of ``Term`` (it is compiled into the plan, so it must stay lexicon-sized).
    With ``keep_scores`` the per-row best half-score and match count are kept.
    """
    terms = terms or L.rule_terms()
    t = F.col(_TMP + "t")
    tname, hits = X.ident(_TMP + "t"), X.ident(_TMP + "hits")
    step1 = with_hits(df.withColumn(_TMP + "t", normalize_text(F.col(text_col))), terms)
    issue_of, half_points = _numbers(term.issue_ord for term in terms), _numbers(int(round(term.weight * 2)) for term in terms)
    # Largest sum of half-points; of equals the first issue in lexicon order.
    best = X.bound(hits, "b", (
        f"array_max(transform(array_distinct(transform(b, o -> {issue_of}[o])), i -> named_struct('s', aggregate(b, 0, "
        f"(a, o) -> a + CASE WHEN {issue_of}[o] = i THEN {half_points}[o] ELSE 0 END), 'i', -i)))"))
    step2 = step1.withColumn(_TMP + "best", F.expr(best)) if terms else step1.withColumn(
        _TMP + "best", F.lit(None).cast("struct<s: int, i: int>"))
    top = F.col(_TMP + "best")
    evidence = F.expr(f"transform(slice({hits}, 1, 4), o -> {_texts(term.evidence for term in terms)}[o])" if terms
                      else "CAST(array() AS ARRAY<STRING>)")
    step3 = step2.select("*", F.greatest(F.coalesce(top["s"], F.lit(0)), F.lit(0)).alias(_TMP + "best2"),
                         F.coalesce(-top["i"], F.lit(0)).alias(_TMP + "ord"), F.size(_TMP + "hits").alias(_TMP + "nm"),
                         evidence.alias(_TMP + "ev"), F.expr(X.entities(tname, L.ENTITY_VOCAB)).alias(_TMP + "ent"),
                         *urgency(_TMP + "t"))
    b2, bo, nm = F.col(_TMP + "best2"), F.col(_TMP + "ord"), F.col(_TMP + "nm")
    matched = b2 > 0
    issue = F.element_at(_lit_array(L.ISSUE_NAMES), bo + 1)
    default_prio = F.when(matched, F.element_at(_lit_array([L.ISSUE_BASE_PRIORITY[i] for i in L.ISSUE_NAMES]), bo + 1)) \
                    .otherwise(F.lit("Low"))
    prio, f100 = detect_priority(default_prio)
    step4 = step3.select("*", prio.alias(_TMP + "prio"), f100.alias(_TMP + "f100"))
    prio, f100 = F.col(_TMP + "prio"), F.col(_TMP + "f100")

    empty = t == ""
    # (best + 0.8 f + 0.3 min(m, 4)) / 8 and 0.8 f / 3, rounded half-up to thousandths.
    matched_milli = F.floor((b2 * 125 + f100 * 2 + F.least(nm, F.lit(4)) * 75 + 1) / 2)
    manual_milli = F.floor((f100 * 16 + 3) / 6)
    milli = F.when(empty, F.lit(100)).when(matched, clamp_milli(matched_milli)).otherwise(clamp_milli(manual_milli))

    cs = F.lit("Customer Service")
    ent = F.col(_TMP + "ent")
    core = F.when(empty, F.lit(L.EMPTY_ISSUE)).when(matched, issue).otherwise(F.lit(L.NO_RULE_ISSUE))
    dept = F.when(empty | ~matched, cs).otherwise(
        F.element_at(_lit_array([L.ISSUE_DEPARTMENT[i] for i in L.ISSUE_NAMES]), bo + 1))
    priority = F.when(empty, F.lit("Low")).otherwise(prio)
    task = F.when(empty | ~matched, F.lit(L.DEPARTMENT_DEFAULT_TASKS["Customer Service"])).otherwise(
        F.element_at(_lit_array([L.ISSUE_TASK[i] for i in L.ISSUE_NAMES]), bo + 1))
    why = F.when(empty, F.lit(L.EMPTY_RULE_REASONING)).otherwise(reasoning(core, dept, priority, ent, L.MODE_RULE))
    ev = (F.when(empty, F.array(F.lit(L.EMPTY_RULE_EVIDENCE)))
           .when(~matched, F.array(F.lit(L.NO_RULE_EVIDENCE)))
           .when(F.size(F.col(_TMP + "ev")) == 0, F.array(F.lit(L.DEFAULT_RULE_EVIDENCE)))
           .otherwise(F.col(_TMP + "ev")))
    verdict = F.struct(
        core.alias("core_issue"), ent.alias("detected_entities"), dept.alias("department"),
        priority.alias("priority"), task.alias("actionable_task"),
        milli_to_double(milli).alias("confidence_score"), why.alias("reasoning"),
        F.lit(L.MODE_RULE).alias("analysis_mode"), ev.alias("supporting_evidence"),
        F.array().cast(schemas.RETRIEVED_EXAMPLES).alias("retrieved_examples"),
    )
    extra = []
    if keep_scores:
        extra = [(b2 / 2.0).alias("rule_best_score"), nm.alias("rule_matches")]
    out = step4.select(*df.columns, verdict.alias(out_col), *extra)
    return out
