"""The complaint table ``C`` derived from the star schema (one complaint per order).

Every value is integer arithmetic on ``o_orderkey`` plus columns of the joined
customer / nation / region rows, so the same table can be written as plain
SQL for the DuckDB oracle (``casewise.plans.oracle``).  Sentences are our own;
issue labels, departments and priorities follow the routing lexicon.

Edge rows are chosen by ``o_orderkey % 97`` (empty, null, whitespace-only,
no-rule, tie, '!!!', two urgency terms, downgrade, critical term, medium
terms, URLs/e-mails/order numbers, stemmer edge words); every ``o_orderkey % 11
== 0`` row carries a noisy department label so metrics are not trivially 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import DEPARTMENTS, ISSUE_RULES
from ..functions import sqlexpr as X
from ..session import spread
from .tables import read_table

# Three sentences per issue, in lexicon issue order.  Slots: {amount} {days}
# {ticket} {region} {country} {date} {product}.
SENTENCES = [
    # Refund delay
    "My refund of ${amount} for the {product} plan is still missing after {days} days.",
    "The reimbursement promised on {date} never reached my bank in {country}.",
    "Ticket {ticket} says the money back was approved but nothing has arrived.",
    # Wrong charge
    "I was double charged ${amount} for my {product} order.",
    "An unauthorized charge of ${amount} appeared on my card on {date}.",
    "You billed the wrong amount on ticket {ticket} and nobody corrected it.",
    # Invoice error
    "For {region} the totals on my {product} invoice are wrong and the tax mismatch is plain.",
    "My billing statement lists ${amount} twice and does not match the contract.",
    "Payment failed on {date} although the bank in {country} confirms the transfer.",
    # Delivery delay
    "My {product} parcel is stuck in transit since {date}.",
    "The courier delayed my order for {days} days without any update.",
    "Package {ticket} has not arrived and tracking shows nothing.",
    # Damaged shipment
    "The {product} box arrived damaged and one corner was crushed.",
    "Half the contents of {ticket} were smashed, clearly courier damage.",
    "The parcel came with packaging damage and a torn label.",
    # Damaged product
    "The {product} came with shattered glass and is unsafe to use.",
    "I found a cracked screen on the device from ticket {ticket}.",
    "The item is physically damaged with a dented product casing.",
    # Wrong item delivered
    "I ordered a {product} but received different goods.",
    "The wrong item was delivered for ticket {ticket}.",
    "You shipped the wrong color and an incorrect product model.",
    # App or website failure
    "The {product} app crash happens every time I pay ${amount}.",
    "Your website error blocks checkout since {date}.",
    "The portal is not loading and shows a 500 error.",
    # Login or account access issue
    "Since {date} every attempt fails: cannot login, whatever {product} password I type.",
    "My account locked after the password reset on ticket {ticket}.",
    "The otp not received message keeps showing when I sign in.",
    # Device or integration issue
    "Our {product} sync failed again after the update.",
    "Every call returns an api error for ticket {ticket}.",
    "The device disconnected and the integration stopped for {days} days.",
    # Poor support experience
    "Your agent was rude and I kept waiting for {days} days.",
    "Support case {ticket} got no response from anyone.",
    "I feel ignored because the team is not responding to my emails.",
    # Cancellation or return issue
    "I want to cancel my {product} subscription but the system refuses.",
    "My return request from {date} has no pickup scheduled.",
    "The policy unclear page does not explain how to send back a ${amount} item.",
    # Security or fraud concern
    "My {product} account was hacked on {date}.",
    "There is a fraud payment of ${amount} on ticket {ticket}.",
    "I suspect a data leak exposed my card details in {country}.",
]
SENTENCES_PER_ISSUE = 3

PRODUCTS = ["Subscription", "Payments", "Marketplace", "Devices", "Mobile App", "Web Portal"]
CHANNELS = ["Email", "Phone", "Web", "Chat"]
ORIGINS = ["B2C", "B2B", "Partner"]
COMPLEXITY = ["Low", "Medium", "High"]

# FIXED VALUES: customer segments and sentiment words of the reproduced generator.
SEGMENTS = ["Student", "SMB", "Enterprise", "Premium", "Standard"]
SENTIMENTS = ["Frustrated", "Disappointed", "Concerned", "Angry", "Urgent"]
SLA_BY_PRIORITY = {"Medium": 48, "High": 24, "Critical": 4}
ESCALATION_BY_PRIORITY = {"Medium": 1, "High": 2, "Critical": 3}
ESCALATION_SENTENCE = " Please escalate this immediately."

# Market segment of the driver tables -> customer segment.
MKT_SEGMENT = {"AUTOMOBILE": "Student", "BUILDING": "SMB", "FURNITURE": "Enterprise",
               "HOUSEHOLD": "Premium", "MACHINERY": "Standard"}

EDGE_MOD = 97
# o_orderkey % 97 -> replacement text (None = SQL NULL).
EDGE_TEXTS = {
    1: "",
    2: None,
    3: " \t\n ",
    4: "Hello, I would like to share some general feedback about my last visit.",
    5: "Please cancel the invoice you sent me.",
    6: "My parcel is stuck in transit!!!",
    7: "The app crash is urgent and I am angry about it.",
    8: "Someone reported a breach of my profile, this is urgent and I am frustrated.",
    9: "I will take legal action because my refund is pending.",
    10: "My invoice is wrong, please follow up soon.",
    11: ("Order #12345 and invoice 778 are wrong, see https://example.com/a?b=1 "
         "or write to help@example.com, ticket#55 too."),
    12: "Tickets, deliveries and batteries: statuses of series ties.",
}
NOISE_MOD = 11

FINDINGS = ["", "Photo shows a cracked screen and a crushed box.", "Screenshot shows a 500 error page."]


def _arr(values) -> str:
    return "array(" + ", ".join(X.lit(v) for v in values) + ")"


def _pick(values, idx: str) -> str:
    return f"element_at({_arr(values)}, CAST(({idx}) + 1 AS INT))"


def _case(col: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {col} = {X.lit(k)} THEN {X.lit(v) if isinstance(v, str) else v}"
                     for k, v in mapping.items())
    return f"CASE {whens} ELSE {default} END"


def _responses_sql(k: str, issue: str, dept: str, prio: str) -> str:
    """A JSON answer per row from a hypothetical outside model, with every failure kind."""
    kind = f"pmod({k} div 13, 21)"

    def obj(core=issue, ents=X.lit('["billing", "product delivery"]'), d=dept, p=prio,
            task=X.lit("Handle the case."), conf=X.lit("0.72"), reason=X.lit('"model says so"'), drop_reason=False):
        parts = [X.lit('{"core_issue": "'), core, X.lit('", "detected_entities": '), ents,
                 X.lit(', "department": "'), d, X.lit('", "priority": "'), p,
                 X.lit('", "actionable_task": "'), task, X.lit('", "confidence_score": '), conf]
        if not drop_reason:
            parts += [X.lit(', "reasoning": '), reason]
        parts.append(X.lit("}"))
        return "concat(" + ", ".join(parts) + ")"

    default_conf = f"concat('0.', lpad(CAST(pmod({k}, 90) AS STRING), 2, '0'))"
    return (f"CASE WHEN {kind} = 6 THEN {X.lit(chr(123) + '"core_issue": "Refund delay", ')} "
            f"WHEN {kind} = 7 THEN {X.lit('["Refund delay"]')} "
            f"WHEN {kind} = 8 THEN {obj(drop_reason=True)} "
            f"WHEN {kind} = 9 THEN {obj(d=X.lit('Sales'))} "
            f"WHEN {kind} = 10 THEN {obj(p=X.lit('urgent'))} "
            f"WHEN {kind} = 11 THEN {obj(conf=X.lit(chr(34) + '0.7' + chr(34)))} "
            f"WHEN {kind} = 12 THEN {obj(conf=X.lit(chr(34) + 'high' + chr(34)))} "
            f"WHEN {kind} = 13 THEN {obj(conf=X.lit('-0.2'))} "
            f"WHEN {kind} = 14 THEN {obj(conf=X.lit('1.7'))} "
            f"WHEN {kind} = 15 THEN {obj(ents=X.lit(chr(34) + 'billing, logistics' + chr(34)))} "
            f"WHEN {kind} = 16 THEN {obj(d=f'concat(' + X.lit(' ') + f', {dept}, ' + X.lit(' ') + ')', p=f'lower({prio})', reason=X.lit(chr(34) * 2))} "
            f"WHEN {kind} = 17 THEN concat({obj()}, ' trailing text') "
            f"WHEN {kind} = 18 THEN replace({obj()}, {X.lit(chr(34))}, {X.lit(chr(39))}) "
            f"WHEN {kind} = 19 THEN {obj(conf=X.lit(chr(34) + '0.5d' + chr(34)))} "
            f"WHEN {kind} = 20 THEN {obj(conf=X.lit('true'))} "
            f"ELSE {obj(conf=default_conf)} END")


def complaint_columns() -> list[str]:
    """The select list of ``C`` as Spark SQL expressions over the joined star-schema row."""
    k = "o_orderkey"
    issues = [r_[0] for r_ in ISSUE_RULES]
    depts = [r_[1] for r_ in ISSUE_RULES]
    prios = [r_[2] for r_ in ISSUE_RULES]
    issue_ord = f"pmod({k}, {len(issues)})"
    sentence = _pick(SENTENCES, f"{issue_ord} * {SENTENCES_PER_ISSUE} + pmod({k} div 13, {SENTENCES_PER_ISSUE})")
    kstr = f"CAST({k} AS STRING)"
    slots = [("{amount}", f"CAST(pmod({k} * 7, 481) + 19 AS STRING)"),
             ("{days}", f"CAST(pmod({k}, 20) + 2 AS STRING)"),
             ("{ticket}", f"concat('CMP-', lpad({kstr}, greatest(6, length({kstr})), '0'))"),
             ("{region}", "coalesce(r_name, 'UNKNOWN')"),
             ("{country}", "coalesce(n_name, 'UNKNOWN')"),
             ("{date}", "date_format(o_orderdate, 'dd MMM yyyy')"),
             ("{product}", _pick(PRODUCTS, f"pmod({k} div 39, {len(PRODUCTS)})"))]
    filled = sentence
    for slot, val in slots:
        filled = f"replace({filled}, {X.lit(slot)}, {val})"
    segment = f"coalesce({_case('c_mktsegment', MKT_SEGMENT)}, 'Standard')"
    sentiment = _pick(SENTIMENTS, f"pmod({k} div 7, {len(SENTIMENTS)})")
    priority = _pick(prios, issue_ord)
    escalate = f"(pmod({k}, 2) = 0 AND {priority} IN ('High', 'Critical'))"
    body = (f"concat({filled}, ' I am a ', lower({segment}), ' customer and this feels ', lower({sentiment}), '.', "
            f"CASE WHEN {escalate} THEN {X.lit(ESCALATION_SENTENCE)} ELSE '' END)")
    edge = " ".join(f"WHEN pmod({k}, {EDGE_MOD}) = {key} THEN {X.lit(val) if val is not None else 'CAST(NULL AS STRING)'}"
                    for key, val in EDGE_TEXTS.items())
    true_dept = _pick(depts, issue_ord)
    noisy = _pick(DEPARTMENTS, f"pmod(array_position({_arr(DEPARTMENTS)}, {true_dept}), {len(DEPARTMENTS)})")
    issue = _pick(issues, issue_ord)
    finding = f"CASE WHEN pmod({k}, 5) = 0 THEN CAST(NULL AS STRING) ELSE {_pick(FINDINGS, f'pmod({k}, {len(FINDINGS)})')} END"
    return [
        f"{k} AS complaint_id",
        f"CASE {edge} ELSE {body} END AS complaint_text",
        f"CASE WHEN pmod({k}, {NOISE_MOD}) = 0 THEN {noisy} ELSE {true_dept} END AS true_department",
        f"{priority} AS true_priority",
        f"{issue} AS true_core_issue",
        f"{_pick(CHANNELS, f'pmod({k}, {len(CHANNELS)})')} AS channel",
        f"{_pick(PRODUCTS, f'pmod({k} div 39, {len(PRODUCTS)})')} AS product_line",
        f"{segment} AS customer_segment",
        "coalesce(r_name, 'UNKNOWN') AS region",
        "coalesce(n_name, 'UNKNOWN') AS country",
        f"timestampadd(HOUR, pmod({k}, 24), CAST(o_orderdate AS TIMESTAMP)) AS created_at",
        f"CAST(pmod({k}, 120) + 1 AS INT) AS customer_tenure_months",
        f"-CAST(pmod({k} * 13, 94) + 5 AS DOUBLE) / 100.0 AS sentiment_score",
        f"CAST({_case(priority, SLA_BY_PRIORITY)} AS INT) AS expected_sla_hours",
        f"CAST({_case(priority, ESCALATION_BY_PRIORITY)} AS INT) AS escalation_level",
        f"{_pick(ORIGINS, f'pmod({k}, {len(ORIGINS)})')} AS case_origin",
        f"{_pick(COMPLEXITY, f'pmod({k} div 3, {len(COMPLEXITY)})')} AS resolution_complexity",
        f"lower({issue}) AS task_signal",
        f"{finding} AS image_finding",
        f"{_responses_sql(k, issue, true_dept, priority)} AS model_response",
    ]


def complaint_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build ``C``: one complaint per order with labels, slots, edge rows and responses."""
    # Spread the orders scan (a plain file scan, so the partition check runs no job).
    o = spread(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # nation (25 rows) and region (5 rows) are fixed-size dimensions: broadcasting
    # them is bounded by definition.  orders x customer is a keyed join (AQE
    # picks shuffle-hash / sort-merge, or broadcast when customer is small).
    geo = n.join(r, n.n_regionkey == r.r_regionkey, "left")
    base = (o.join(c, o.o_custkey == c.c_custkey, "left")
             .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"), "left"))
    return base.selectExpr(*complaint_columns())
