"""Rule triage (C1): routing, priorities, branches, confidence formula."""

from casewise.operators.rules import rule_triage


def _triage(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, complaint_text string")
    rows = rule_triage(df).orderBy("id").select("analysis.*").collect()
    return rows


def test_security_case_routes_to_technical_support_critical(spark):
    r = _triage(spark, ["My account was hacked and there is suspicious payment activity on it."])[0]
    assert r.department == "Technical Support"
    assert r.priority == "Critical"
    assert r.core_issue == "Security or fraud concern"
    assert r.analysis_mode == "rule-based"
    # (5.5 + 0.8 * 1.0 + 0.3 * 2) / 8 = 0.8625 -> 0.863
    assert r.confidence_score == 0.863


def test_empty_null_and_whitespace_texts(spark):
    for r in _triage(spark, ["", None, " \t\n "]):
        assert r.core_issue == "Insufficient complaint details"
        assert (r.department, r.priority, r.confidence_score) == ("Customer Service", "Low", 0.1)
        assert r.supporting_evidence == ["No usable complaint text was provided."]


def test_no_rule_goes_to_manual_triage(spark):
    r = _triage(spark, ["Hello, I would like to share some feedback."])[0]
    assert r.core_issue == "General complaint requiring manual triage"
    assert r.priority == "Low"
    assert r.confidence_score == 0.16          # 0.8 * 0.6 / 3


def test_tie_goes_to_first_issue_in_lexicon_order(spark):
    r = _triage(spark, ["Please cancel the invoice you sent me."])[0]
    assert r.core_issue == "Invoice error"
    assert r.supporting_evidence[0] == "Matched keyword 'invoice' to Invoice error."


def test_two_high_terms_downgrade_critical_rule_to_high(spark):
    r = _triage(spark, ["Someone reported a breach of my profile, this is urgent and I am frustrated."])[0]
    assert r.core_issue == "Security or fraud concern"
    assert r.priority == "High"


def test_exclamations_and_medium_terms(spark):
    a, b = _triage(spark, ["My parcel is stuck in transit!!!", "My invoice is wrong, please follow up soon."])
    assert (a.core_issue, a.priority) == ("Delivery delay", "High")
    assert (b.core_issue, b.priority) == ("Invoice error", "Medium")


def test_entities_are_substring_matches_in_label_order(spark):
    r = _triage(spark, ["The app crashed and the package tracking shows an error."])[0]
    assert r.detected_entities == ["logistics", "technical"]


def test_evidence_keeps_four_items_keywords_first(spark):
    r = _triage(spark, ["refund reimbursement money back chargeback invoice fraud"])[0]
    assert len(r.supporting_evidence) == 4
    assert all(e.startswith("Matched keyword") for e in r.supporting_evidence)


def test_custom_terms_in_any_order(spark):
    from casewise.functions import lexicon as L
    from casewise.operators.rules import rule_triage
    df = spark.createDataFrame([(1, "I was double charged and my parcel arrived late")], "complaint_id long, complaint_text string")
    want = rule_triage(df).select("analysis.core_issue", "analysis.supporting_evidence").first()
    back = rule_triage(df, terms=L.rule_terms()[::-1]).select("analysis.core_issue", "analysis.supporting_evidence").first()
    assert back.core_issue == want.core_issue and set(back.supporting_evidence) <= set(x.evidence for x in L.rule_terms())
    some = [t for t in L.rule_terms() if t.issue_ord >= 3]
    rule_triage(df, terms=some).collect()


def test_substring_tests_are_compiled_and_words_looked_up_by_hash(spark):
    df = rule_triage(spark.createDataFrame([(1, "x")], "id long, complaint_text string")).select("analysis.*")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan and "array_intersect" not in plan


def test_phrases_need_their_words_in_order_and_none_between(spark):
    texts = ["double charged", "double, charged", "charged double", "double duplicate charge", "a double charge twice: charged twice"]
    rows = rule_triage(spark.createDataFrame(list(enumerate(texts)), "id long, complaint_text string")).orderBy("id").collect()
    assert [len([e for e in r["analysis"]["supporting_evidence"] if "Matched" in e]) for r in rows] == [2, 0, 0, 1, 2]
