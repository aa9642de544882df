"""Worked examples."""

from pyspark.sql import functions as F

from paperloom.functions import headings as hd
from paperloom.functions import lines as ln
from paperloom.functions import numbering as nb
from paperloom.functions import text as tx
from paperloom.functions.vectors import cosine
from paperloom.operators import filters as fl
from paperloom.operators import layout as ly
from paperloom.operators import sections as se


def column(spark, values, expr, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_numbering(spark):
    texts = ["제3조 목적", "1. Definitions", "1.1 Scope", "SECTION 3.1 X", "(iv) x", "(b) x", "14 days after the start", "SCHEDULE of rates", "plain", "ARTICLE IV Y", "0012 x"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, v string")
    rows = nb.annotate_numbering(df, "v").orderBy("i").collect()
    got = [(r.hint.kind, r.hint.normalized, r.hint.level, r.hint.is_heading) if r.hint else None for r in rows]
    assert got == [
        ("article", "ARTICLE 3", 1, True),
        ("article", "ARTICLE 1", 1, True),
        ("decimal", "1.1", 4, True),
        ("section", "SECTION 3.1", 3, True),
        ("roman_paren", "(iv)", 6, False),
        ("alpha_paren", "(b)", 5, False),
        ("article", "ARTICLE 14", 1, True),
        ("schedule", "SCHEDULE of", 0, True),
        None,
        ("article", "ARTICLE 4", 1, True),
        ("article", "ARTICLE 12", 1, True),
    ]


def test_roman(spark):
    assert column(spark, ["iv", "XIV", "MCMXC", "IIII", "", "abc", "xlii"], nb.roman_to_int) == [4, 14, 1990, None, None, None, 42]


def test_heading_relations(spark):
    pairs = [("7 Equipment", "7.1 Manner"), ("ARTICLE 6 COMMENCEMENT", "6.1 Effectiveness"), ("7 A", "8.1 B"), ("A", "1.1 B")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    assert [r.o for r in df.select("i", nb.is_child(F.col("a"), F.col("b")).alias("o")).orderBy("i").collect()] == [True, True, False, False]
    near = [("1.1.1.19", "1.1.1.20"), ("1.1.1.19", "1.1.1.19.1"), ("1.1.1.19", "14.2"), ("1.1.1.19", "1.10"), ("7", "7.1"), ("1.1.1.19", "1.1.2")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(near)], "i int, a string, b string")
    got = [r.o for r in df.select("i", nb.is_sibling_or_child(F.col("a"), F.col("b")).alias("o")).orderBy("i").collect()]
    assert got == [True, True, False, False, True, True]


def test_page_numbers(spark):
    assert column(spark, ["12", "- 12 -", "p.12", "12/220", "Page 12"], lambda c: tx.is_page_number(c, "layout")) == [True] * 5
    assert column(spark, ["Page 12", "– 5 –", "Page 3 of 9", "twelve"], tx.is_page_number) == [False, True, True, False]


def test_unwrap(spark):
    df = spark.createDataFrame([("fourteen\n(14)\ncalendar days",)], "content string")
    assert ln.unwrap_lines(df).first().content == "fourteen (14) calendar days"


def test_reflow_keeps_list_items(spark):
    df = spark.createDataFrame([("The parties\nagree\n(a) first\nitem\n\nnext",)], "content string")
    assert ln.reflow_paragraphs(df).first().content == "The parties agree\n(a) first item\n\nnext"


def test_hyphens(spark):
    rows = [(1, 0, 0, "provi-"), (1, 0, 1, "sions"), (1, 0, 2, "Sub-"), (1, 0, 3, "Clause"), (1, 0, 4, "a--"), (1, 0, 5, "b"), (1, 1, 6, "c")]
    df = spark.createDataFrame(rows, "contract_id long, page int, ord long, text string")
    assert [r.text for r in ly.repair_hyphens(df).orderBy("ord").collect()] == ["provisions", "Sub-Clause", "a--", "b", "c"]


def test_safe_join(spark):
    df = spark.createDataFrame([(["provi-", "sions  of", "", "x-", "Éa", "1-", "b"],)], "a array<string>")
    assert df.select(tx.safe_join(F.col("a")).alias("o")).first().o == "provisions of x- Éa 1- b"


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), ([3.0, 4.0], [3.0, 4.0]), ([], [])], "a array<double>, b array<double>")
    assert [round(r.o, 6) for r in df.select(cosine(F.col("a"), F.col("b")).alias("o")).collect()] == [0.0, 0.0, 1.0, 0.0]


def test_exclude_wins(spark):
    zones = spark.createDataFrame([(1, False, None), (2, True, None), (3, True, None)], "zone_id long, is_analysis_target boolean, user_confirmed boolean")
    inc = spark.createDataFrame([(1,), (2,)], "zone_id long")
    exc = spark.createDataFrame([(2,)], "zone_id long")
    got = {r.zone_id: (r.is_analysis_target, r.user_confirmed) for r in fl.apply_zone_decisions(zones, inc, exc).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (True, None)}


def test_heading_lines(spark):
    yes = ["1. Title", "14.1.2 Title here", "ARTICLE 5 Payment", "제3조 목적", "II. SCOPE", "7 Equipment", '1.1.1.20 "Date" means the PPA.']
    no = ["14 days after receipt", "8.3 [Programme],", "20.1 [Claims] to:", "Clause 5.2:", "Article 6.7(h) of this", "lower case", '"Term" means', "A sentence.", "VND only]"]
    assert column(spark, yes, hd.heading_line) == [True] * len(yes)
    assert column(spark, no, hd.heading_line) == [False] * len(no)


def test_compound_heading(spark):
    df = spark.createDataFrame([(1, "6. COMMENCEMENT 6.1 Effectiveness of the Contract", 1, "body")], "id int, heading string, level int, content string")
    got = se.split_compound_headings(df).orderBy("sub").collect()
    assert [(r.heading, r.level, r.content) for r in got] == [("6. COMMENCEMENT", 1, ""), ("6.1 Effectiveness of the Contract", 2, "body")]


def test_definitions_split_into_two_clauses(spark):
    text = "1.1.1.1 Alpha means the first thing in this contract and nothing else at all, whatever else is said.\n" * 2
    text = text.strip().replace("\n1.1.1.1", "\n1.1.1.2")
    text += "\nas further described in the schedules that are attached to this contract"
    df = spark.createDataFrame([(1, "1.1 Definitions", text)], "id int, heading string, content string")
    assert [r.number for r in se.resplit_clauses(df).orderBy("sub").collect()] == ["1.1.1.1", "1.1.1.2"]


def test_control_characters_dont_split_clauses(spark):
    from paperloom.operators.clauses import split_clauses_text

    got = split_clauses_text(spark.createDataFrame([(1, "one \u0002 text\u0003 \u0001 here")], "doc_id long, text string")).collect()
    assert len(got) == 1 and got[0]["text"] == "one \u0002 text\u0003 \u0001 here"
