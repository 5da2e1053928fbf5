"""Sections, facts and the answers by intent that use them, with the default rules and with others."""

import pytest

from siltstone.functions import fixed
from siltstone.operators import facts, grounded
from siltstone.operators.answer import REFUSAL
from siltstone.operators.facts import Fact, Overview, Section

LAW = "Chương I ... Luật số: 73/2021/QH14\n Luật này quy định về phòng, chống ma túy;  trách nhiệm; hợp tác quốc tế về phòng, chống ma túy. Điều 5. Các hành vi bị nghiêm cấm 1. Tàng trữ trái phép chất ma túy, tiền chất, thuốc gây nghiện. Điều 6. Sau. Chương II cuối"


@pytest.fixture
def docs(spark):
    rows = [(3, LAW, "luat-phong-chong-ma-tuy-2021.md", "legal"), (4, LAW.replace("73/", "74/"), "luat-phong-chong-ma-tuy-2021.md", "legal"), (1, "Ca sĩ bị bắt vì tàng trữ ma túy tại nhà riêng, công an khởi tố vụ án này.", "bao-1.md", "news"), (2, "Trời hôm nay đẹp.", "bao-2.md", "news"), (5, None, None, None), (6, "", "x", "legal")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, type string")


def test_sections(spark, docs):
    got = {(r["doc_id"], r["section"]): (r["at"], r["content"]) for r in facts.section_table(docs).collect()}
    start = LAW.index(fixed.ARTICLE_START)
    assert got == {(d, "prohibited_acts"): (start + 1, LAW[start : LAW.index("Điều 6.")].strip()) for d in (3, 4)}
    rules = [Section("near", "b", ["b", "c"]), Section("none", "zz", ["a"]), Section("open", "a", ["no end"])]
    texts = spark.createDataFrame([(1, "xx b c b 0123456789 c " + "y" * 7000), (2, "zz"), (3, None)], "doc_id long, text string")
    rows = {(r["doc_id"], r["section"]): r["content"] for r in facts.section_table(texts, rules).collect()}
    assert rows == {(1, "near"): "b c b 0123456789", (2, "none"): "zz"}
    assert len(facts.section_table(spark.createDataFrame([(1, "a" + "y" * 9000)], "doc_id long, text string"), rules[2:]).first()["content"]) == fixed.SECTION_MOST
    one = facts.first_sections(docs).collect()
    assert sorted((r["intent"], r["doc_id"]) for r in one) == [("prohibited", 3), ("storage", 3)]
    assert facts.section_table(docs.limit(0)).collect() == []


def test_facts_by_priority(spark):
    rules = [Fact("a", 2, r"second (\w+)", "2: {}"), Fact("a", 1, r"first (\w+)", "1: {}"), Fact("b", 1, r"(b+)")]
    texts = [(1, "second x\n first   y bb"), (2, "second x"), (3, "nothing"), (4, None), (5, "b")]
    docs = spark.createDataFrame([(i, t, "s" if i != 5 else None) for i, t in texts], "doc_id long, text string, source string")
    assert sorted(map(tuple, facts.fact_table(docs, rules).collect())) == [(1, "a", "1: y"), (1, "b", "bb"), (2, "a", "2: x"), (5, "b", "b")]
    made = {r["doc_id"]: (r["n_facts"], r["overview"]) for r in facts.fact_overview(docs, Overview("s", rules, "Lead", "End")).collect()}
    assert made == {1: (2, "Lead\n- 1: y [s]\n- bb [s]\nEnd"), 2: (1, "Lead\n- 2: x [s]\nEnd"), 5: (1, "Lead\n- b []\nEnd")}
    assert facts.fact_overview(docs.limit(0), Overview("s", rules, "Lead", "End")).collect() == []


def test_overview_comes_before_evidence(spark, docs):
    made = facts.overviews(docs)
    found = {r["intent"]: r["overview"] for r in made.collect()}
    assert set(found) == {"overview"} and "- 73/2021/QH14 [luat-phong-chong-ma-tuy-2021.md]" in found["overview"]
    q = spark.createDataFrame([(1, "Luật phòng, chống ma túy nói gì?"), (2, "Trời hôm nay ra sao?"), (3, "Luật phòng, chống ma túy?")], "query_id long, query string")
    results = docs.filter("doc_id in (1, 2, 3)").crossJoin(q.filter("query_id < 3")).selectExpr("*", "1.0D score", "doc_id rank")
    got = {r["query_id"]: r["answer"] for r in grounded.grounded_answer(q, results, overviews=made).collect()}
    assert got[1] == found["overview"] and got[2] != found["overview"] and got[3] == REFUSAL
    assert grounded.grounded_answer(q, results).filter("query_id = 1").first()["answer"] != found["overview"]


def test_rewriting(spark):
    q = spark.createDataFrame([(1, "Những hành vi bị nghiêm cấm?"), (2, "Ai bị khởi tố?"), (3, "Trời đẹp"), (4, None)], "query_id long, query string")
    got = {r["query_id"]: r["query"] for r in grounded.rewrite_queries(q).collect()}
    assert got == {1: fixed.REWRITTEN, 2: "Ai bị khởi tố? " + fixed.ADDED, 3: "Trời đẹp", 4: None}


def test_quota_answers(spark, docs):
    q = spark.createDataFrame([(1, "Tàng trữ ma túy bị xử ra sao?"), (2, "Trời hôm nay ra sao?"), (3, "Những hành vi bị nghiêm cấm?")], "query_id long, query string")
    by_rule = {r["query_id"]: r for r in grounded.generate_quota(docs, q, 4).collect()}
    assert {r["model"] for r in by_rule.values()} == {"offline_fallback"}
    assert by_rule[1]["answer"].startswith(grounded.LEAD) and "thuốc gây nghiện" in by_rule[1]["answer"] and "Ca sĩ" in by_rule[1]["answer"]
    assert by_rule[1]["sources"].split(",")[0] == "luat-phong-chong-ma-tuy-2021.md"  # the section comes first
    assert by_rule[3]["answer"].startswith(grounded.NEAREST) and "Điều 5. Các hành vi" in by_rule[3]["answer"]
    prompts = []

    def complete(batch):
        return [REFUSAL if "hôm nay ra sao" not in p.rpartition("Question:")[2] else f"{p.count('[Document')} documents" for p in batch]

    made = {r["query_id"]: (r["answer"], r["model"]) for r in grounded.generate_quota(docs, q, 4, complete).collect()}
    assert made[1] == (by_rule[1]["answer"], "offline_fallback") and made[3] == (by_rule[3]["answer"], "offline_fallback")
    assert made[2][1] == "model" and made[2][0].endswith("documents") and not prompts
    none = grounded.generate_quota(docs.limit(0), q, 3).collect()
    assert {r["answer"] for r in none} == {REFUSAL} and {r["sources"] for r in none} == {""}
