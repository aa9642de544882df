"""Rule tables against the compiled rule sets, and the literals that rules are found by."""

import random
import re

import pytest

from catalog import QUERIES, Tables
from catalog.q_text import pattern_table
from paperloom.functions import rules as ru
from paperloom.functions import zoning as zn

FOLDER = "/root/testdata/sf0.001"


def test_literals_are_necessary():
    assert ru.literals(r"^\s*general\s+provisions\b") == {"provisions"}
    assert ru.literals(r"(?:ABC|de)+x?") == {"abc", "de"}
    assert ru.literals(r"[ab]c*") == set() and ru.literals(r"a*|b") == set()
    for ruleset in zn.PART_PATTERNS:
        for _, _, _, pattern in zn.part_rules(ruleset):
            assert ru.literals(pattern), pattern


def test_first_rule_in_order_wins():
    rng = random.Random(2)
    words = ["general", "conditions", "of", "contract", "annex", "part", "x", "별표", "3"]
    rows = [(f"k{i}", False, r"\s+".join(rng.choices(words, k=rng.randint(1, 3)))) for i in range(300)] + [("any", True, r"^\S$"), ("end", False, "")]
    m = ru.Matcher(rows)
    for _ in range(2000):
        text = " ".join(rng.choices([*words, "ANNEX", "Part"], k=rng.randint(1, 6)))
        want = next(k for k, _, p in rows if re.search(p, text, ru.FLAGS))
        assert m.first(text) == want


def test_only_candidates_are_tried():
    rows = [(f"k{i}", False, rf"^\s*rule\s+number{i}x\b") for i in range(1000)]
    m = ru.Matcher(rows)
    assert m.first("rule number17x and more") == "k17" and m.first("nothing at all") is None
    assert m.tried == 1


def test_plan_does_not_grow_with_the_rules(spark):
    df = spark.createDataFrame([("General Provisions",), (None,), ("Annex 4",)], "heading string")
    plans = []
    for n in (50, 5000):
        table = spark.createDataFrame([(i, f"k{i}", False, f"word{i}") for i in range(n)] + [(n, "general", True, r"^general\b")], "priority int, key string, is_target boolean, pattern string")
        out = zn.classify_zones(df, "heading", "sections", ru.register_rules(table))
        plans.append(len(re.sub(r"\d+", "", out._jdf.queryExecution().optimizedPlan().toString())))
        assert {r["heading"]: r["zone_key"] for r in out.collect()}["General Provisions"] == "general_conditions"
    assert plans[0] == plans[1]


def test_odd_tables(spark, monkeypatch):
    schema = "priority int, key string, is_target boolean, pattern string"
    rows = [(None, "last", True, "a"), (2, "two", None, "a"), (1, None, True, "a"), (1, "one", False, None)]
    got = ru.register_rules(spark.createDataFrame(rows, schema))
    df = spark.createDataFrame([("xax",), (None,), ("b",)], "t string")
    assert [r[0] for r in df.select(got.key(df["t"])).collect()] == ["two", None, None]
    empty = ru.register_rules(spark.createDataFrame([], schema))
    assert [r[0] for r in df.select(empty.key(df["t"])).collect()] == [None] * 3
    with pytest.raises(re.error):
        ru.register_rules(spark.createDataFrame([(1, "k", True, "(")], schema))
    monkeypatch.setattr(ru, "MOST_RULES", 1)
    with pytest.raises(ValueError, match="more than 1 rules"):
        ru.register_rules(spark.createDataFrame(rows, schema))


def test_tables_give_what_the_chain_gives(spark):
    t = Tables(spark, FOLDER)
    assert pattern_table(t, "layout").count() == 1000
    for ruled, chained in (("register_rules_sections", "sc9_classify_zones_sections"), ("register_rules_layout", "sc9_classify_zones_layout"), ("register_rules_parts", "wn12_document_parts")):
        a, b = QUERIES[ruled](spark, FOLDER), QUERIES[chained](spark, FOLDER)
        assert a.select(b.columns).exceptAll(b).isEmpty() and b.exceptAll(a.select(b.columns)).isEmpty()
