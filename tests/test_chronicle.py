"""Small fixtures for panels, selections and audits."""

from pyspark.sql import functions as F

from taleweave.operators import chronicle
from taleweave.operators.view import ViewState


def test_selections(spark):
    df = spark.createDataFrame([("1-3, 7",), ("3,9-8,x",), (None,), ("",)], "selection string")
    assert sorted(r.ch for r in chronicle.selected_chapters(df).collect()) == [1, 2, 3, 7]


def test_life_lists_stop_at_the_lock(spark):
    rows = [("a", f"e{i}", i, i) for i in range(1, 6)] + [("b", "e9", 9, 9)]
    df = spark.createDataFrame(rows, "char string, event string, ch int, ord long")
    got = {r.char: (r.total, r.shown, r.events) for r in chronicle.life_lists(df, ViewState(20, progress=4), most=2).collect()}
    assert got == {"a": (5, 4, ["e1", "e2"]), "b": (1, 0, [])}


def test_evidence_without_a_chapter_is_always_visible(spark):
    events = F.array(*[F.struct(F.lit(c).cast("int").alias("ch")) for c in (None, 3, 12)])
    out = spark.range(1).select(chronicle.evidence_within(events, ViewState(20, progress=5)).alias("e")).first().e
    assert [e.ch for e in out] == [None, 3]


def test_last_heading_counts(spark):
    lines = ["One", "Two", "One", "a", "Two", "b", "c"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "text_id long, nth int, line string")
    got = [r.heading for r in chronicle.main_text(df, "^(One|Two)$").orderBy("nth").collect()]
    assert got == [None, None, "One", "One", "Two", "Two", "Two"]


def test_citations_and_declarations(spark):
    schema = "item int, event string, ch int"
    cited = spark.createDataFrame([(1, "e1", 3), (1, "e2", 3), (1, "gone", 3)], schema)
    declared = spark.createDataFrame([(1, "e1", 3), (1, "e3", 3), (1, "e4", 3)], schema)
    chapters = spark.createDataFrame([("e1", 3), ("e2", 3), ("e3", 3), ("e4", 8)], "event string, event_ch int")
    got = {(r.event, r.finding) for r in chronicle.cited_and_declared(cited, declared, chapters).collect()}
    assert got == {("e2", "undeclared"), ("e3", "uncited"), ("e4", "uncited"), ("e4", "other chapter"), ("gone", "missing")}


def test_late_characters(spark):
    ec = spark.createDataFrame([("a", "e", 1, 1), ("a", "f", 9, 2), ("b", "e", 1, 1)], "char string, event string, ch int, ord long")
    firsts = spark.createDataFrame([("a", 10), ("b", 6)], "char string, first_ch int")
    assert [(r.char, r.n) for r in chronicle.late_characters(ec, firsts).collect()] == [("a", 1)]


def test_marks_words_and_spans(spark):
    df = spark.createDataFrame([(1, "**a** 「x」 Foo e-12 「「y」"), (2, "** odd"), (3, None)], "text_id long, text string")
    r = chronicle.bold_tally(df, "t").first()
    assert (r.n_texts, r.n_marks, r.n_unpaired) == (2, 3, 1)
    assert {r.word for r in chronicle.latin_words(df).collect()} == {"Foo", "odd"}
    assert [(r.nth, r.span) for r in chronicle.quoted_spans(df).orderBy("nth").collect()] == [(0, "x"), (1, "y")]


def test_name_ledger(spark):
    ledger = spark.createDataFrame([("A", "it is so in the text"), ("A", "it is so in the text"), ("al", "it is so in the text"), ("B", "it is so in the text"), ("zz", "no")], "name string, why string")
    names = spark.createDataFrame([("A",), ("B（大）",)], "name string")
    aliases = spark.createDataFrame([("al",)], "alias string")
    got = {(r.name, r.problem) for r in chronicle.name_ledger_problems(ledger, names, aliases).collect()}
    assert got == {("A", "repeated"), ("al", "alias"), ("B", "bracket left out"), ("zz", "no reason"), ("zz", "unknown")}
