"""DuckDB SQL for the correctness oracle.

Each function returns SQL text that DuckDB runs on the driver's parquet views
(``orders``, ``customer``, ...).  They restate the Spark jobs in plain SQL so
the driver can compare results; they are never executed by the engine itself.
Shared pieces (the complaint view ``C``, rule verdict columns) are CTE bodies.
"""

from __future__ import annotations

from ..functions import lexicon as L
from ..sources import complaints as CV

WS = CV_WS = (r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
              r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")


def q(s: str | None) -> str:
    """SQL string literal."""
    if s is None:
        return "NULL"
    if any(ch in s for ch in "\t\n\r"):
        parts = []
        for ch in s:
            parts.append(f"chr({ord(ch)})" if ch in "\t\n\r" else "'" + ch.replace("'", "''") + "'")
        return "(" + " || ".join(parts) + ")"
    return "'" + s.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(values, idx_sql: str) -> str:
    return f"{arr(values)}[({idx_sql}) + 1]"


def case_map(col: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {col} = {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    return f"CASE {whens} ELSE {default} END"


def normalize_sql(col: str) -> str:
    return f"coalesce(trim(regexp_replace(lower({col}), '[{WS}]+', ' ', 'g')), '')"


def py_strip_sql(col: str) -> str:
    return f"regexp_replace({col}, '^[{WS}]+|[{WS}]+$', '', 'g')"


# ---------------------------------------------------------------------------
# View C
# ---------------------------------------------------------------------------

def complaints_sql() -> str:
    issues = L.ISSUE_NAMES
    depts = [L.ISSUE_DEPARTMENT[i] for i in issues]
    prios = [L.ISSUE_BASE_PRIORITY[i] for i in issues]
    k = "o_orderkey"
    issue_ord = f"({k} % {len(issues)})"
    sentence = pick(CV.SENTENCES, f"{issue_ord} * {CV.SENTENCES_PER_ISSUE} + ({k} // 13) % {CV.SENTENCES_PER_ISSUE}")
    amount = f"CAST(({k} * 7) % 481 + 19 AS VARCHAR)"
    days = f"CAST({k} % 20 + 2 AS VARCHAR)"
    kstr = f"CAST({k} AS VARCHAR)"
    ticket = f"('CMP-' || lpad({kstr}, CAST(greatest(6, length({kstr})) AS INTEGER), '0'))"
    product = pick(CV.PRODUCTS, f"({k} // 39) % {len(CV.PRODUCTS)}")
    date_text = f"strftime(o_orderdate, '%d %b %Y')"
    region = "coalesce(r_name, 'UNKNOWN')"
    country = "coalesce(n_name, 'UNKNOWN')"
    filled = sentence
    for slot, val in [("{amount}", amount), ("{days}", days), ("{ticket}", ticket), ("{region}", region),
                      ("{country}", country), ("{date}", date_text), ("{product}", product)]:
        filled = f"replace({filled}, {q(slot)}, {val})"
    segment = f"coalesce({case_map('c_mktsegment', CV.MKT_SEGMENT)}, 'Standard')"
    sentiment = pick(CV.SENTIMENTS, f"({k} // 7) % {len(CV.SENTIMENTS)}")
    priority = pick(prios, issue_ord)
    escalate = f"({k} % 2 = 0 AND {priority} IN ('High', 'Critical'))"
    body = (f"({filled} || ' I am a ' || lower({segment}) || ' customer and this feels ' || lower({sentiment}) || '.' "
            f"|| CASE WHEN {escalate} THEN {q(CV.ESCALATION_SENTENCE)} ELSE '' END)")
    edge_whens = " ".join(f"WHEN {k} % {CV.EDGE_MOD} = {key} THEN {q(val)}" for key, val in CV.EDGE_TEXTS.items())
    text = f"CASE {edge_whens} ELSE {body} END"
    true_dept = pick(depts, issue_ord)
    noisy = pick(L.DEPARTMENTS, f"list_position({arr(L.DEPARTMENTS)}, {true_dept}) % {len(L.DEPARTMENTS)}")
    issue = pick(issues, issue_ord)
    sla = case_map(priority, CV.SLA_BY_PRIORITY)
    esc = case_map(priority, CV.ESCALATION_BY_PRIORITY)
    finding = (f"CASE WHEN {k} % 5 = 0 THEN NULL ELSE {pick(CV.FINDINGS, f'{k} % {len(CV.FINDINGS)}')} END")
    response = _responses_sql(k, issue, true_dept, priority)
    return f"""
SELECT {k} AS complaint_id,
       {text} AS complaint_text,
       CASE WHEN {k} % {CV.NOISE_MOD} = 0 THEN {noisy} ELSE {true_dept} END AS true_department,
       {priority} AS true_priority,
       {issue} AS true_core_issue,
       {pick(CV.CHANNELS, f'{k} % {len(CV.CHANNELS)}')} AS channel,
       {product} AS product_line,
       {segment} AS customer_segment,
       {region} AS region,
       {country} AS country,
       CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST({k} % 24 AS INTEGER)) AS created_at,
       CAST({k} % 120 + 1 AS INTEGER) AS customer_tenure_months,
       -CAST(({k} * 13) % 94 + 5 AS DOUBLE) / 100.0 AS sentiment_score,
       CAST({sla} AS INTEGER) AS expected_sla_hours,
       CAST({esc} AS INTEGER) AS escalation_level,
       {pick(CV.ORIGINS, f'{k} % {len(CV.ORIGINS)}')} AS case_origin,
       {pick(CV.COMPLEXITY, f'({k} // 3) % {len(CV.COMPLEXITY)}')} AS resolution_complexity,
       lower({issue}) AS task_signal,
       {finding} AS image_finding,
       {response} AS model_response
FROM orders
LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey) g
       ON c_nationkey = g.n_nationkey
"""


def _responses_sql(k, issue, dept, prio) -> str:
    kind = f"(({k} // 13) % 21)"

    def obj(core=issue, ents="'[\"billing\", \"product delivery\"]'", d=dept, p=prio, task="'Handle the case.'",
            conf="'0.72'", reason="'\"model says so\"'", drop_reason=False):
        parts = ["'{\"core_issue\": \"'", core, "'\", \"detected_entities\": '", ents,
                 "', \"department\": \"'", d, "'\", \"priority\": \"'", p,
                 "'\", \"actionable_task\": \"'", task, "'\", \"confidence_score\": '", conf]
        if not drop_reason:
            parts += ["', \"reasoning\": '", reason]
        parts.append("'}'")
        return "(" + " || ".join(parts) + ")"

    kind16_dept = f"(' ' || {dept} || ' ')"
    default_conf = f"('0.' || lpad(CAST({k} % 90 AS VARCHAR), 2, '0'))"
    return (f"CASE WHEN {kind} = 6 THEN '{{\"core_issue\": \"Refund delay\", ' "
            f"WHEN {kind} = 7 THEN '[\"Refund delay\"]' "
            f"WHEN {kind} = 8 THEN {obj(drop_reason=True)} "
            f"WHEN {kind} = 9 THEN {obj(d=q('Sales'))} "
            f"WHEN {kind} = 10 THEN {obj(p=q('urgent'))} "
            f"WHEN {kind} = 11 THEN {obj(conf=q(chr(34) + '0.7' + chr(34)))} "
            f"WHEN {kind} = 12 THEN {obj(conf=q(chr(34) + 'high' + chr(34)))} "
            f"WHEN {kind} = 13 THEN {obj(conf=q('-0.2'))} "
            f"WHEN {kind} = 14 THEN {obj(conf=q('1.7'))} "
            f"WHEN {kind} = 15 THEN {obj(ents=q(chr(34) + 'billing, logistics' + chr(34)))} "
            f"WHEN {kind} = 16 THEN {obj(d=kind16_dept, p=f'lower({prio})', reason=q(chr(34) * 2))} "
            f"WHEN {kind} = 17 THEN {obj()} || ' trailing text' "
            f"WHEN {kind} = 18 THEN replace({obj()}, {q(chr(34))}, {q(chr(39))}) "
            f"WHEN {kind} = 19 THEN {obj(conf=q(chr(34) + '0.5d' + chr(34)))} "
            f"WHEN {kind} = 20 THEN {obj(conf=q('true'))} "
            f"ELSE {obj(conf=default_conf)} END")


# ---------------------------------------------------------------------------
# Rule verdict columns
# ---------------------------------------------------------------------------

def entities_sql(t: str) -> str:
    items = []
    for label, words in L.ENTITY_VOCAB:
        cond = " OR ".join(f"contains({t}, {q(w)})" for w in words)
        items.append(f"CASE WHEN {cond} THEN {q(label)} END")
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def reasoning_sql(issue: str, dept: str, prio: str, ents: str, source: str) -> str:
    ent = f"CASE WHEN len({ents}) > 0 THEN array_to_string({ents}, ', ') ELSE {q(L.NO_ENTITIES_TEXT)} END"
    return (f"('The complaint signals ''' || {issue} || ''' through entities such as ' || {ent} || "
            f"'. This maps to the ' || {dept} || ' department. Priority is ' || {prio} || "
            f"' based on the severity and urgency cues identified by the {source} analysis stage.')")


def _rank(col: str) -> str:
    return f"CASE {col} WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 WHEN 'Critical' THEN 4 ELSE 0 END"


def _unrank(col: str) -> str:
    return f"CASE {col} WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' WHEN 4 THEN 'Critical' END"


def rule_verdict_sql(src: str, text_col: str = "complaint_text", keep: str = "*") -> str:
    """SELECT over ``src`` adding rule verdict columns r_* (flat)."""
    terms = L.rule_terms()
    hits = ",\n       ".join(f"regexp_matches(t, {q(term.regex)}) AS m{term.ord}" for term in terms)
    scores = []
    for i in range(len(L.ISSUE_NAMES)):
        parts = [f"CASE WHEN m{term.ord} THEN {int(round(term.weight * 2))} ELSE 0 END"
                 for term in terms if term.issue_ord == i]
        scores.append("(" + " + ".join(parts) + ")")
    s_list = "[" + ", ".join(scores) + "]"
    nm = " + ".join(f"CAST(m{term.ord} AS INTEGER)" for term in terms)
    ev = "list_filter([" + ", ".join(f"CASE WHEN m{term.ord} THEN {q(term.evidence)} END" for term in terms) + \
         "], lambda x: x IS NOT NULL)[1:4]"

    def hits_of(terms_):
        return "(" + " + ".join(f"CAST(contains(t, {q(x)}) AS INTEGER)" for x in terms_) + ")"
    crit, high, med = hits_of(L.CRITICAL_PRIORITY_TERMS), hits_of(L.HIGH_PRIORITY_TERMS), hits_of(L.MEDIUM_PRIORITY_TERMS)
    issues = arr(L.ISSUE_NAMES)
    base_prio = arr([L.ISSUE_BASE_PRIORITY[i] for i in L.ISSUE_NAMES])
    depts = arr([L.ISSUE_DEPARTMENT[i] for i in L.ISSUE_NAMES])
    tasks = arr([L.ISSUE_TASK[i] for i in L.ISSUE_NAMES])
    cs_task = q(L.DEPARTMENT_DEFAULT_TASKS["Customer Service"])
    return f"""
SELECT {keep},
       CASE WHEN t = '' THEN {q(L.EMPTY_ISSUE)} WHEN best2 > 0 THEN {issues}[best_ord + 1] ELSE {q(L.NO_RULE_ISSUE)} END AS r_issue,
       CASE WHEN t = '' OR best2 <= 0 THEN 'Customer Service' ELSE {depts}[best_ord + 1] END AS r_department,
       CASE WHEN t = '' THEN 'Low' ELSE prio END AS r_priority,
       CASE WHEN t = '' OR best2 <= 0 THEN {cs_task} ELSE {tasks}[best_ord + 1] END AS r_task,
       CASE WHEN t = '' THEN 100
            WHEN best2 > 0 THEN least(greatest((best2 * 125 + f100 * 2 + least(nm, 4) * 75 + 1) // 2, 0), 1000)
            ELSE least(greatest((f100 * 16 + 3) // 6, 0), 1000) END AS r_milli,
       r_entities,
       CASE WHEN t = '' THEN [{q(L.EMPTY_RULE_EVIDENCE)}]
            WHEN best2 <= 0 THEN [{q(L.NO_RULE_EVIDENCE)}]
            WHEN len(ev) = 0 THEN [{q(L.DEFAULT_RULE_EVIDENCE)}]
            ELSE ev END AS r_evidence,
       best2 AS r_best2, nm AS r_matches, t AS r_text
FROM (
  SELECT *,
         CASE WHEN crit >= 1 THEN 'Critical'
              WHEN contains(t, '!!!') OR high >= 2 THEN 'High'
              WHEN high = 1 THEN {_unrank(f"greatest({_rank('dprio')}, 3)")}
              WHEN med >= 1 THEN {_unrank(f"greatest({_rank('dprio')}, 2)")}
              ELSE dprio END AS prio,
         CASE WHEN crit >= 1 THEN 100
              WHEN contains(t, '!!!') OR high >= 2 THEN 98
              WHEN high = 1 THEN 90
              WHEN med >= 1 THEN 75
              WHEN dprio = 'Critical' THEN 65 ELSE 60 END AS f100
  FROM (
    SELECT *, CASE WHEN best2 > 0 THEN {base_prio}[best_ord + 1] ELSE 'Low' END AS dprio,
           {crit} AS crit, {high} AS high, {med} AS med
    FROM (
      SELECT *, list_max(s) AS best2, list_position(s, list_max(s)) - 1 AS best_ord,
             {nm} AS nm, {ev} AS ev, {entities_sql('t')} AS r_entities
      FROM (
        SELECT *, {s_list} AS s
        FROM (
          SELECT *,
       {hits}
          FROM (SELECT *, {normalize_sql(text_col)} AS t FROM {src}) n0
        ) n1
      ) n2
    ) n3
  ) n4
) n5
"""


def rule_rows_sql(src: str = "c", text_col: str = "complaint_text", keep: str = "*") -> str:
    """Rule verdict with reasoning, as a SELECT over ``src``."""
    why = reasoning_sql("r_issue", "r_department", "r_priority", "r_entities", L.MODE_RULE)
    return f"""
SELECT *, CASE WHEN r_text = '' THEN {q(L.EMPTY_RULE_REASONING)} ELSE {why} END AS r_reasoning
FROM ({rule_verdict_sql(src, text_col, keep)}) rv
"""


# ---------------------------------------------------------------------------
# Text functions
# ---------------------------------------------------------------------------

PUNCT_SQL = q(L.PUNCTUATION)


def clean_sql(col: str) -> str:
    t = normalize_sql(col)
    t = f"regexp_replace({t}, 'https?://[^ ]+|www\\.[^ ]+', ' ', 'g')"
    t = f"regexp_replace({t}, '[^ ]+@[^ ]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\b(order|invoice|ticket) *#?\\p{{Nd}}+\\b', ' ', 'g')"
    return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"


def preprocess_sql(col: str) -> str:
    from ..functions.lexicon import CLEANING_STOPWORDS
    toks = f"regexp_extract_all(translate({clean_sql(col)}, {PUNCT_SQL}, ''), '[\\p{{L}}\\p{{N}}_]+')"
    kept = f"list_filter({toks}, lambda x: NOT list_contains({arr(CLEANING_STOPWORDS)}, lower(x)))"
    stem = ("list_transform({k}, lambda x: CASE WHEN suffix(x, 'ies') AND length(x) > 4 "
            "THEN substr(x, 1, length(x) - 3) || 'y' "
            "WHEN suffix(x, 's') AND length(x) > 3 AND NOT suffix(x, 'ss') THEN substr(x, 1, length(x) - 1) "
            "ELSE x END)").format(k=kept)
    return f"array_to_string({stem}, ' ')"


def word_count_sql(col: str) -> str:
    runs = f"regexp_replace(coalesce({col}, ''), '[^{WS}]+', 'x', 'g')"
    return f"CAST(length(regexp_replace({runs}, '[{WS}]+', '', 'g')) AS BIGINT)"


def template_group_sql(col: str) -> str:
    t = normalize_sql(col)
    for pattern, repl in [(r"\$?\b\p{Nd}+(?:\.\p{Nd}+)?\b", "<num>"), (r"\bcmp-\p{Nd}+\b", "<ticket>"),
                          (r"\b\p{Nd}{1,2} +[a-z]{3} +\p{Nd}{4}\b", "<date>"),
                          (r"\bi am a +(student|smb|enterprise|premium|standard) +customer and this feels +[a-z]+\b\.?",
                           "<segment>"),
                          (r"please escalate this immediately\.?", "<escalate>")]:
        t = f"regexp_replace({t}, {q(pattern)}, {q(repl)}, 'g')"
    return f"md5(trim(regexp_replace({t}, ' +', ' ', 'g')))"


def join_texts_sql(text: str, finding: str) -> str:
    a = f"coalesce({py_strip_sql(text)}, '')"
    b = f"coalesce({py_strip_sql(finding)}, '')"
    return (f"CASE WHEN {a} <> '' AND {b} <> '' THEN {a} || {q(L.IMAGE_FINDINGS_JOINER)} || {b} "
            f"WHEN {a} <> '' THEN {a} ELSE {b} END")


# ---------------------------------------------------------------------------
# Split, hashed vectors, neighbours, retrieval verdict
# ---------------------------------------------------------------------------

def fmt_fixed_sql(units: str, decimals: int) -> str:
    scale = 10 ** decimals
    return (f"(CAST(({units}) // {scale} AS VARCHAR) || '.' || "
            f"lpad(CAST(({units}) % {scale} AS VARCHAR), {decimals}, '0'))")


def split_ctes(src: str = "c", test_size: float = 0.25, seed: int = 42) -> str:
    """CTEs g (groups) and split(complaint_id, evaluation_group, split)."""
    return f"""
g AS MATERIALIZED (SELECT complaint_id, evaluation_group, md5('{seed}:' || evaluation_group) AS skey
                   FROM (SELECT complaint_id, {template_group_sql('complaint_text')} AS evaluation_group FROM {src})),
cut AS (SELECT skey, row_number() OVER (ORDER BY skey) AS rn, count(*) OVER () AS total
        FROM (SELECT DISTINCT skey FROM g)),
split AS MATERIALIZED (
  SELECT g.complaint_id, g.evaluation_group,
         CASE WHEN cut.rn <= ceil({test_size} * cut.total) THEN 'test' ELSE 'train' END AS split
  FROM g JOIN cut USING (skey))"""


def vector_ctes(src: str = "c", id_col: str = "complaint_id", text_col: str = "complaint_text",
                width: int = L.HASH_WIDTH, prefix: str = "") -> str:
    """CTEs {prefix}vec(id, bucket, tf) and {prefix}norm(id, n2)."""
    return f"""
{prefix}vec AS MATERIALIZED (
  SELECT id, bucket, count(*) AS tf FROM (
    SELECT {id_col} AS id, (('0x' || substr(md5(tk), 1, 8))::BIGINT % {width}) AS bucket
    FROM (SELECT {id_col}, unnest(regexp_extract_all(lower(coalesce({text_col}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS tk
          FROM {src})) GROUP BY id, bucket),
{prefix}norm AS MATERIALIZED (SELECT id, sum(tf * tf) AS n2 FROM {prefix}vec GROUP BY id)"""


def knn_ctes(qvec: str, dvec: str, norm: str, k: int = L.DEFAULT_TOP_K, exclude_self: bool = False,
             name: str = "nn", dnorm: str | None = None) -> str:
    """CTE {name}(qid, did, score, rank): exact sparse cosine top-k, positive scores only."""
    self_cond = "AND qv.id <> dv.id" if exclude_self else ""
    return f"""
{name}_pairs AS (SELECT qv.id AS qid, dv.id AS did, sum(qv.tf * dv.tf) AS dot
                 FROM {qvec} qv JOIN {dvec} dv ON qv.bucket = dv.bucket {self_cond} GROUP BY 1, 2),
{name} AS MATERIALIZED (
  SELECT qid, did, score, rank FROM (
    SELECT qid, did, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did ASC) AS rank
    FROM (SELECT p.qid, p.did, CAST(p.dot AS DOUBLE) / sqrt(CAST(nq.n2 * nd.n2 AS DOUBLE)) AS score
          FROM {name}_pairs p JOIN {norm} nq ON nq.id = p.qid JOIN {dnorm or norm} nd ON nd.id = p.did
          WHERE p.dot > 0)) WHERE rank <= {k})"""


def retrieval_ctes(nn: str, corpus: str, queries_rules: str, name: str = "rag") -> str:
    """CTE {name}: retrieval verdict columns per query (left join keeps queries without neighbours).

    ``queries_rules`` must expose complaint_id and the r_* rule columns.
    """
    issues = arr(L.ISSUE_NAMES)
    tasks = arr([L.ISSUE_TASK[i] for i in L.ISSUE_NAMES])
    votes = []
    for field in ["core_issue", "department", "priority"]:
        votes.append(f"""
{name}_v_{field} AS (SELECT qid, v AS v_{field} FROM (
    SELECT qid, v, row_number() OVER (PARTITION BY qid ORDER BY w DESC, r ASC) AS rn FROM (
      SELECT qid, {field} AS v, sum(milli) AS w, min(rank) AS r FROM {name}_nb GROUP BY qid, {field})) WHERE rn = 1)""")
    ents = "list_sort(list_distinct(r_entities))"
    why = reasoning_sql("v_core_issue", "v_department", "v_priority", ents, "retrieval-augmented")
    n = "n_neigh"
    num = f"(7 * {n} * r_milli + 9 * {n} * max_milli + 7 * sum_milli + 1500 * {n} * strong)"
    milli = f"least(greatest((2 * {num} + 28 * {n}) // (56 * {n}), 0), 1000)"
    avg_centi = f"((2 * sum_milli + 10 * {n}) // (20 * {n}))"
    ev_extra = (f"['Retrieved ' || CAST({n} AS VARCHAR) || ' semantically similar complaints via FAISS.', "
                f"'Top retrieval similarity: ' || {fmt_fixed_sql('(max_milli + 5) // 10', 2)} || "
                f"'; average similarity: ' || {fmt_fixed_sql(avg_centi, 2)} || '.']")
    return f"""
{name}_nb AS MATERIALIZED (
  SELECT nn.qid, nn.did, nn.rank, CAST(floor(nn.score * 1000 + 0.5) AS BIGINT) AS milli,
         coalesce(d.true_department, 'Customer Service') AS department,
         coalesce(d.true_priority, 'Medium') AS priority,
         coalesce(d.true_core_issue, 'General complaint requiring manual triage') AS core_issue
  FROM {nn} nn JOIN {corpus} d ON d.complaint_id = nn.did),
{name}_s AS (SELECT qid, count(*) AS n_neigh, max(milli) AS max_milli, sum(milli) AS sum_milli,
                    count_if(rank <= 3 AND milli >= 600) AS strong FROM {name}_nb GROUP BY qid),
{",".join(votes)},
{name} AS MATERIALIZED (
  SELECT q.complaint_id,
         CASE WHEN s.qid IS NULL THEN r_issue ELSE v_core_issue END AS g_issue,
         CASE WHEN s.qid IS NULL THEN r_department ELSE v_department END AS g_department,
         CASE WHEN s.qid IS NULL THEN r_priority ELSE v_priority END AS g_priority,
         CASE WHEN s.qid IS NULL THEN r_task
              WHEN list_position({issues}, v_core_issue) > 0 THEN {tasks}[list_position({issues}, v_core_issue)]
              ELSE r_task END AS g_task,
         CASE WHEN s.qid IS NULL THEN r_milli ELSE {milli} END AS g_milli,
         CASE WHEN s.qid IS NULL THEN r_entities ELSE {ents} END AS g_entities,
         CASE WHEN s.qid IS NULL THEN r_evidence ELSE list_concat(r_evidence, {ev_extra}) END AS g_evidence,
         CASE WHEN s.qid IS NULL THEN r_reasoning ELSE {why} END AS g_reasoning,
         CAST(coalesce(n_neigh, 0) AS BIGINT) AS g_neighbours
  FROM {queries_rules} q
  LEFT JOIN {name}_s s ON s.qid = q.complaint_id
  LEFT JOIN {name}_v_core_issue vi ON vi.qid = q.complaint_id
  LEFT JOIN {name}_v_department vd ON vd.qid = q.complaint_id
  LEFT JOIN {name}_v_priority vp ON vp.qid = q.complaint_id)"""


def consensus_ctes(entries: str, name: str = "cons") -> str:
    """CTE {name}: consensus columns per complaint from an entries CTE
    (complaint_id, ord, name, issue, dept, prio, milli, task, evidence)."""
    leaders = []
    for key, col in [("li", "issue"), ("ld", "dept"), ("lp", "prio")]:
        leaders.append(f"""
{name}_{key} AS (SELECT complaint_id, v, w FROM (
    SELECT complaint_id, {col} AS v, sum(milli) AS w,
           row_number() OVER (PARTITION BY complaint_id ORDER BY sum(milli) DESC, min(ord) ASC) AS rn
    FROM {entries} GROUP BY complaint_id, {col}) WHERE rn = 1)""")
    return ",".join(leaders) + f""",
{name}_ag AS (
  SELECT e.*, li.v AS l_issue, ld.v AS l_dept, lp.v AS l_prio, li.w AS w_issue, ld.w AS w_dept, lp.w AS w_prio,
         (e.issue = li.v AND e.dept = ld.v AND e.prio = lp.v) AS agrees
  FROM {entries} e JOIN {name}_li li USING (complaint_id) JOIN {name}_ld ld USING (complaint_id)
  JOIN {name}_lp lp USING (complaint_id)),
{name}_n AS (SELECT complaint_id, count_if(agrees) AS n, sum(CASE WHEN agrees THEN milli ELSE 0 END) AS s,
                    coalesce(string_agg(CASE WHEN agrees THEN name END, ', ' ORDER BY ord), '') AS names
             FROM {name}_ag GROUP BY complaint_id),
{name}_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY complaint_id ORDER BY milli DESC, ord ASC) AS rn
                              FROM {name}_ag) WHERE rn = 1),
{name}_win AS (SELECT * FROM (
    SELECT a.*, row_number() OVER (PARTITION BY a.complaint_id ORDER BY a.milli DESC, a.ord ASC) AS rn2
    FROM {name}_ag a JOIN {name}_n n USING (complaint_id)
    WHERE (n.n >= 2 AND a.agrees) OR (n.n < 2)) WHERE rn2 = 1 AND (rn2 = 1)),
{name} AS MATERIALIZED (
  SELECT t.complaint_id,
         CASE WHEN n.n >= 2 THEN w.issue ELSE t.issue END AS c_issue,
         CASE WHEN n.n >= 2 THEN w.dept ELSE t.dept END AS c_dept,
         CASE WHEN n.n >= 2 THEN w.prio ELSE t.prio END AS c_prio,
         CASE WHEN n.n >= 2 THEN w.task ELSE t.task END AS c_task,
         CASE WHEN n.n >= 2 THEN least((2 * n.s + 100 * n.n * (n.n - 1) + n.n) // (2 * n.n), 1000)
              ELSE least(greatest((t.milli * 85 + 50) // 100, 200), 750) END AS c_milli,
         CASE WHEN n.n >= 2 THEN 'This final recommendation is based on model agreement. ' || n.names ||
                   ' aligned on ''' || t.l_issue || ''' for ' || t.l_dept || ' with ' || t.l_prio || ' priority.'
              ELSE 'The models did not reach strong consensus, so the dashboard is surfacing the highest-confidence result from '
                   || t.name || ' while flagging the disagreement for manual review.' END AS c_reasoning,
         CASE WHEN n.n >= 2 THEN list_concat(['Agreeing models: ' || n.names || '.',
                   'Consensus issue score: ' || {fmt_fixed_sql('t.w_issue', 3)} || '.',
                   'Consensus department score: ' || {fmt_fixed_sql('t.w_dept', 3)} || '.',
                   'Consensus priority score: ' || {fmt_fixed_sql('t.w_prio', 3)} || '.'], w.evidence)
              ELSE list_concat(['No multi-model consensus was found across issue, department, and priority.',
                   'Highest-confidence model: ' || t.name || ' (' || {fmt_fixed_sql('t.milli', 3)} || ').',
                   'Weighted issue leader: ' || t.l_issue || '.',
                   'Weighted department leader: ' || t.l_dept || '.'], t.evidence) END AS c_evidence,
         n.names AS c_models
  FROM {name}_top t JOIN {name}_n n USING (complaint_id) JOIN {name}_win w USING (complaint_id))"""


def issue_task_sql(issue: str) -> str:
    issues = arr(L.ISSUE_NAMES)
    tasks = arr([L.ISSUE_TASK[i] for i in L.ISSUE_NAMES])
    return (f"CASE WHEN list_position({issues}, {issue}) > 0 THEN {tasks}[list_position({issues}, {issue})] "
            f"ELSE {q(L.DEPARTMENT_DEFAULT_TASKS['Customer Service'])} END")


def bayes_ctes(queries: str, qvec: str, dvec: str, corpus: str, width: int = L.HASH_WIDTH) -> str:
    """CTE nb(complaint_id, n_issue, n_dept, n_prio, n_milli): integer naive Bayes fitted on ``corpus`` rows
    (a SELECT of complaint_id and labels) whose tokens are in ``dvec``."""
    out = [f"nbc AS MATERIALIZED ({corpus})"]
    for t, col in (("issue", "true_core_issue"), ("dept", "true_department"), ("prio", "true_priority")):
        out.append(f"""
nbn_{t} AS (SELECT {col} AS label, count(*) AS nd, sum(count(*)) OVER () AS total FROM nbc WHERE {col} IS NOT NULL GROUP BY 1),
nbk_{t} AS (SELECT d.{col} AS label, v.bucket, sum(v.tf) AS n FROM {dvec} v JOIN nbc d ON d.complaint_id = v.id
            WHERE d.{col} IS NOT NULL GROUP BY 1, 2),
nbw_{t} AS MATERIALIZED (
  SELECT a.label, b.bucket, CAST(round(1000 * ln((coalesce(k.n, 0) + 1.0::DOUBLE) / (coalesce(s.n, 0) + {width}.0::DOUBLE))) AS BIGINT) AS w
  FROM nbn_{t} a CROSS JOIN (SELECT unnest(range({width})) AS bucket) b
  LEFT JOIN nbk_{t} k ON k.label = a.label AND k.bucket = b.bucket
  LEFT JOIN (SELECT label, sum(n) AS n FROM nbk_{t} GROUP BY 1) s ON s.label = a.label),
nbs_{t} AS (SELECT q.complaint_id, a.label, CAST(round(1000 * ln(a.nd::DOUBLE / a.total::DOUBLE)) AS BIGINT) + coalesce(x.s, 0) AS score
            FROM {queries} q CROSS JOIN nbn_{t} a
            LEFT JOIN (SELECT v.id, w.label, sum(v.tf * w.w) AS s FROM {qvec} v JOIN nbw_{t} w USING (bucket) GROUP BY 1, 2) x
                   ON x.id = q.complaint_id AND x.label = a.label),
nbb_{t} AS (SELECT complaint_id, label, least(950, 400 + (score - coalesce(nxt, score - 20000)) // 20) AS milli FROM (
              SELECT *, row_number() OVER o AS rn, lead(score) OVER o AS nxt FROM nbs_{t}
              WINDOW o AS (PARTITION BY complaint_id ORDER BY score DESC, label)) WHERE rn = 1)""")
    out.append("""
nb AS MATERIALIZED (
  SELECT i.complaint_id, i.label AS n_issue, d.label AS n_dept, p.label AS n_prio,
         CAST((i.milli + d.milli + p.milli) // 3 AS BIGINT) AS n_milli
  FROM nbb_issue i JOIN nbb_dept d USING (complaint_id) JOIN nbb_prio p USING (complaint_id))""")
    return ",\n".join(out)


def metrics_sql(pred: str) -> str:
    """SELECT of rounded macro metrics per model from a pred CTE (model, y, p, milli)."""
    return f"""
SELECT o.model, CAST(o.n AS BIGINT) AS n, round(CAST(o.correct AS DOUBLE) / o.n, 4) AS accuracy,
       round(m.pr, 4) AS precision, round(m.rc, 4) AS recall, round(m.f1, 4) AS f1_score,
       round(CAST(o.ms AS DOUBLE) / (o.n * 1000.0), 4) AS avg_confidence, CAST(m.n_labels AS BIGINT) AS n_labels
FROM (SELECT model, count(*) AS n, sum(CASE WHEN y = p THEN 1 ELSE 0 END) AS correct, sum(milli) AS ms
      FROM {pred} GROUP BY model) o
JOIN (SELECT model, avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END) AS pr,
             avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END) AS rc,
             avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END) AS f1,
             count(*) AS n_labels
      FROM (SELECT model, label, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(fp) AS DOUBLE) AS fp,
                   CAST(sum(fn) AS DOUBLE) AS fn
            FROM (SELECT model, y AS label, CASE WHEN y = p THEN 1 ELSE 0 END AS tp, 0 AS fp,
                         CASE WHEN y <> p THEN 1 ELSE 0 END AS fn FROM {pred} WHERE y IS NOT NULL
                  UNION ALL
                  SELECT model, p, 0, CASE WHEN y <> p THEN 1 ELSE 0 END, 0 FROM {pred} WHERE p IS NOT NULL)
            GROUP BY model, label)
      GROUP BY model) m USING (model)"""


# ---------------------------------------------------------------------------
# Outside-model answers
# ---------------------------------------------------------------------------

def validate_sql(s: str) -> str:
    """SELECT-list fragment: v_ok, v_message and sanitized v_* fields from JSON string column ``s``."""
    raw = s
    s = f"(CASE WHEN json_valid({raw}) THEN {raw} END)"   # JSON functions only ever see valid input

    def get(key):
        return f"json_extract_string({s}, '$.{key}')"

    def as_text(x):
        return f"coalesce({x}, 'None')"
    missing = "NULL"
    for key in reversed(L.OUTPUT_KEYS):
        missing = f"CASE WHEN NOT list_contains(json_keys({s}), '{key}') THEN '{key}' ELSE {missing} END"
    ents_text = (f"CASE WHEN json_type({s}, '$.detected_entities') = 'ARRAY' "
                 f"THEN array_to_string(from_json(json_extract({s}, '$.detected_entities'), '[\"VARCHAR\"]'), ', ') "
                 f"ELSE {as_text(get('detected_entities'))} END")
    dept = py_strip_sql(as_text(get("department")))
    prio_low = f"lower({py_strip_sql(f'coalesce({get(chr(112) + "riority")}, {q("")})')})"
    prio = "CASE " + " ".join(f"WHEN {prio_low} = '{p.lower()}' THEN '{p}'" for p in L.PRIORITIES) + " END"
    conf = (f"(CASE WHEN json_type({s}, '$.confidence_score') = 'BOOLEAN' "
            f"THEN CASE WHEN {get('confidence_score')} = 'true' THEN 1.0 ELSE 0.0 END "
            f"ELSE TRY_CAST({py_strip_sql(get('confidence_score'))} AS DOUBLE) END)")
    core = py_strip_sql(as_text(get("core_issue")))
    task = py_strip_sql(as_text(get("actionable_task")))
    why = py_strip_sql(as_text(get("reasoning")))
    msg = (f"CASE WHEN {raw} IS NULL OR NOT json_valid({raw}) THEN 'Invalid JSON.' "
           f"WHEN json_type({s}) <> 'OBJECT' THEN 'JSON root must be an object.' "
           f"WHEN ({missing}) IS NOT NULL THEN 'Missing key: ' || ({missing}) "
           f"WHEN NOT list_contains({arr(L.DEPARTMENTS)}, {dept}) THEN 'Invalid department: ' || {dept} "
           f"WHEN ({prio}) IS NULL THEN 'Invalid priority: ' "
           f"WHEN ({conf}) IS NULL THEN 'confidence_score must be numeric.' "
           f"WHEN isnan({conf}) OR {conf} < 0.0 OR {conf} > 1.0 THEN 'confidence_score must be between 0 and 1.' "
           f"WHEN length({core}) < 1 OR length({core}) > 180 THEN 'Invalid verdict field: core_issue' "
           f"WHEN length({task}) < 1 OR length({task}) > 300 THEN 'Invalid verdict field: actionable_task' "
           f"ELSE 'valid' END")
    return (f"{msg} AS v_message, {core} AS v_core_issue, {entities_sql(normalize_sql(ents_text))} AS v_entities, "
            f"{dept} AS v_department, {prio} AS v_priority, {task} AS v_task, {why} AS v_reasoning, "
            f"round({conf}, 3) AS v_confidence")
