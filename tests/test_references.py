"""Cross references and defined terms on worked examples."""

from pyspark.sql import functions as F

from paperloom.operators import references as rf


def clauses(spark, *texts, numbers=None):
    numbers = numbers or [str(i + 1) for i in range(len(texts))]
    rows = [(1, i, i, n, None, t) for i, (t, n) in enumerate(zip(texts, numbers))]
    return spark.createDataFrame(rows, "contract_id long, clause_id long, sort_order int, number string, zone_key string, text string")


def test_list_stops_at_keyword_switch(spark):
    df = clauses(spark, "Clauses 1 [GP], 18 [Ins], and Sub-Clauses 4.2 [PB], 4.2A [PCG] and 14.2 [AP] apply; Clause 9.")
    got = [(r.pattern_type, r.target_ref, r.matched_text) for r in rf.extract_list_refs(df).orderBy("offset_start").collect()]
    assert got == [
        ("clause", "1", "1 [GP]"),
        ("clause", "18", "18 [Ins]"),
        ("subclause", "4.2", "4.2 [PB]"),
        ("subclause", "4.2A", "4.2A [PCG]"),
        ("subclause", "14.2", "14.2 [AP]"),
    ]
    text = df.first().text
    assert all(text[r.offset_start : r.offset_end] == r.matched_text for r in rf.extract_list_refs(df).collect())


def test_list_form_wins_over_single(spark):
    df = clauses(spark, "Sub-Clauses 4.2 [PB] and 14.2 [AP]; see Sub-Clause 8.7 [Delay].")
    refs = rf.dedupe_refs(rf.extract_refs(df).unionByName(rf.extract_list_refs(df)))
    assert sorted((r.target_ref, r.is_list) for r in refs.collect()) == [("14.2", True), ("4.2", True), ("8.7", False)]


def test_ranges(spark):
    df = clauses(spark, "Under Sub-Clauses 9.5 [A] to 9.7 [B].", "x", "y", "z", "w", numbers=["1", "9.5", "9.6", "9.8", "9.7"])
    assert sorted(r.target_ref for r in rf.expand_ranges(df, df).collect()) == ["9.5", "9.6", "9.7"]
    df = clauses(spark, "Clauses 4.2A [A] to 4.2C [C]", "x", "y", numbers=["1", "4.2B", "4.2D"])
    assert [r.target_ref for r in rf.expand_ranges(df, df).collect()] == ["4.2B"]


def test_resolution_order(spark):
    df = clauses(spark, "Clause 8.7, Clause 4.2B, Clause 14, Clause 99, Clause 1", "a", "b", "c", "d", numbers=["1", "8.7", "4.2", "14.1.2", "14.1.1"])
    got = {r.target_ref: r.target_clause_id for r in rf.resolve_refs(rf.dedupe_refs(rf.extract_refs(df)), df).collect()}
    # the reference to the clause itself is dropped, 14 falls back to its first sub-clause
    assert got == {"8.7": 1, "4.2B": 2, "14": 3, "99": None}


def test_terms_and_usages(spark):
    df = clauses(
        spark,
        '"Owner", "Project Company" or "QNJSC" means the person. "day" means 24 hours.',
        "The Project Company pays the Owner's debts each day. Day one. Owners and co-Owner. A holiday.",
        numbers=["1.1.1", "2"],
    )
    terms = rf.extract_terms(rf.definition_clauses(df))
    assert sorted(r.term for r in terms.collect()) == ["Owner", "Project Company", "QNJSC", "day"]
    assert {r.term: r.aliases for r in rf.term_aliases(terms).collect()}["Owner"] == ["Project Company", "QNJSC"]
    none = rf.extract_refs(df.where("false"))
    used = rf.term_usages(df, rf.term_variants(terms), none).where("clause_id = 1").orderBy("offset_start").collect()
    assert [r.matched_text for r in used] == ["Project Company", "Owner's", "day", "Owners", "Owner"]
    counts = {r.term: r.usage_count for r in rf.usage_counts(terms, rf.term_usages(df, rf.term_variants(terms), none)).collect()}
    assert counts["QNJSC"] == 1


def test_control_characters_are_text(spark):
    df = clauses(spark, "a\u0002b see Clause 4.2 \u0002\u0003 and Clause 9", "x")
    got = [(r.target_ref, r.matched_text, r.offset_start) for r in rf.extract_refs(df).orderBy("offset_start").collect()]
    text = df.first().text
    assert got == [("4.2", "Clause 4.2", text.index("Clause 4.2")), ("9", "Clause 9", text.index("Clause 9"))]


def test_usage_at_a_line_start_is_a_sentence_start(spark):
    df = clauses(spark, '"day" means 24 hours.', "first line\nday one and a day", numbers=["1.1.1", "2"])
    terms = rf.extract_terms(rf.definition_clauses(df))
    used = rf.term_usages(df, rf.term_variants(terms), rf.extract_refs(df.where("false"))).where("clause_id = 1").collect()
    assert [r.offset_start for r in used] == [25]


def test_rebuild_replaces_exactly_the_given_contracts(spark, tmp_path):
    path = str(tmp_path / "refs")
    rows = [(c, c * 10 + i, i, str(i + 1), None, "see Clause 2 here" if i == 0 else "x") for c in range(8) for i in range(2)]
    df = spark.createDataFrame(rows, "contract_id long, clause_id long, sort_order int, number string, zone_key string, text string")
    rf.rebuild_contract_refs(df, path)
    count = lambda: {r.contract_id: r["count"] for r in rf.stored_refs(spark, path).groupBy("contract_id").count().collect()}
    assert count() == {c: 1 for c in range(8)}
    one = df.where("contract_id = 1").withColumn("text", F.lit("nothing"))
    for _ in range(2):
        rf.rebuild_contract_refs(one, path)
        assert count() == {c: 1 for c in range(8) if c != 1}
    rf.rebuild_contract_refs(df, path, df.where("contract_id = 1"))
    assert count() == {c: 1 for c in range(8)}


def test_rebuild_leaves_other_buckets_alone(spark, tmp_path):
    """Files of buckets without a given contract are the same files, untouched; a manifest without its end mark counts for nothing."""
    import os

    path = str(tmp_path / "refs")
    rows = [(c, c * 10, 0, "1", None, f"see Clause {c + 2} here") for c in range(40)]
    df = spark.createDataFrame(rows, "contract_id long, clause_id long, sort_order int, number string, zone_key string, text string")
    rf.rebuild_contract_refs(df, path, buckets=8)
    data = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{path}/data") for f in fs}
    rf.rebuild_contract_refs(df.where("contract_id = 3").withColumn("text", F.lit("Clause 7 and Article 9")), path, buckets=8)
    later = {f: t for f, t in data.items() if os.path.exists(f) and os.stat(f).st_mtime_ns == t}
    assert later == data
    assert len([d for d in os.listdir(f"{path}/data/version=2") if d.startswith("bucket=")]) == 1
    got = {r["contract_id"]: r["n"] for r in rf.stored_refs(spark, path).groupBy("contract_id").agg(F.count("*").alias("n")).collect()}
    assert got == {c: 2 if c == 3 else 1 for c in range(40)}
    os.makedirs(f"{path}/manifest/version=3")
    assert rf.stored_version(spark, path) == 2
    rf.rebuild_contract_refs(df.withColumn("text", F.lit("none")), path, buckets=8)
    assert rf.stored_refs(spark, path).count() == 0


def test_disjoint_as_the_walk():
    import random
    import time

    rng = random.Random(1)
    for _ in range(300):
        items = [(a := rng.randint(0, 60), a + rng.randint(1, 9)) for _ in range(rng.randint(0, 25))]
        taken = [(a := rng.randint(0, 60), a + rng.randint(1, 5)) for _ in range(rng.randint(0, 6))]
        busy, want = list(taken), []
        for i, (a, b) in enumerate(items):
            if not any(a < e and s < b for s, e in busy):
                busy.append((a, b))
                want.append(i)
        assert rf.disjoint([a for a, _ in items], [b for _, b in items], taken) == want
    starts = [rng.randint(0, 10_000_000) for _ in range(50_000)]
    began = time.time()
    rf.disjoint(starts, [a + 20 for a in starts], [(a + 5, a + 9) for a in starts[:1000]])
    assert time.time() - began < 5


def test_a_clause_of_many_references_ends_in_seconds(spark):
    import time

    refs = spark.range(50_000).selectExpr("1L as contract_id", "1L as clause_id", "'clause' as pattern_type", "cast(id as string) as target_ref", "'x' as matched_text", "cast(id * 7 as int) as offset_start", "cast(id * 7 + id % 13 + 1 as int) as offset_end", "id % 50 = 0 as is_list")
    began = time.time()
    kept = rf.dedupe_refs(refs).count()
    assert 25_000 < kept < 50_000 and time.time() - began < 30


def test_usage_plan_cuts_no_text_for_words(spark):
    df = clauses(spark, '"Owner" means x.', "The Owner", numbers=["1.1.1", "2"])
    variants = rf.term_variants(rf.extract_terms(rf.definition_clauses(df)))
    plan = rf.term_usages(df, variants, rf.extract_refs(df))._jdf.queryExecution().optimizedPlan().toString()
    assert "substring" not in plan.split("Generate explode(array_distinct(regexp_extract_all")[1].split("\n")[0]


def test_spans_are_those_of_the_pattern(spark):
    """Repeated, touching and near matches, and texts with the marker, against Python's own search; no copy of a whole text is marked up."""
    import re

    texts = [
        "Clause 1Clause 1 Clause 12 Clause 1, xClauses 1, 2 and Clauses 1, 2 Sub-Clause 1 [A] Clause 1 [A] to 2",
        "a\u0002Clause 7 \u0002 Clauses 7 and 8 \u0002\u0002Clause 7 제3조 제3조 제1항 (see 7.2)(see 7.2)",
        "Clauses 4.1 [A]\n to 4.3 [B] Clauses 4.1 [A] to 4.3",
        "",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for rx in [*rf.SINGLE.values(), rf.LIST, rf.RANGE, rf.NUM + rf.TITLE, rf.INLINE]:
        for r in df.select("text", rf.spans(F.col("text"), rx).alias("s")).collect():
            want = [(m.start(), m.end(), m.group()) for m in re.finditer(rx, r.text or "", re.A)]
            assert [tuple(x) for x in r.s or []] == want, rx
    plan = df.select(rf.spans(F.col("text"), rf.SINGLE["clause"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "translate" not in plan
