"""Ledgers on small fixtures: each problem once."""

from taleweave.operators import ledgers

WHY = "as it is told there"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_first_chapters(spark):
    chars = spark.createDataFrame([("b", "a", 9), ("b", "c", 9), ("b", "d", None), ("b", "late", 9)], "book string, name string, first_ch int")
    entries = [
        ("b", "a", 9, 2, "early", WHY),
        ("b", "c", 8, 2, "early", WHY),  # the data has moved on
        ("b", "zz", 9, 2, "early", WHY),
        ("x", "a", 9, 2, "early", WHY),
        ("b", "a", 9, 4, "odd", " 太　短了 "),
        ("b", "d", None, 0, "early", WHY),
        (None, "a", 9, 2, "early", None),
    ]
    ledger = spark.createDataFrame(entries, "book string, name string, first_ch int, text_first int, kind string, why string")
    late = spark.createDataFrame([("b", "late"), ("b", "a")], "book string, name string")
    got = rows(ledgers.first_chapter_problems(ledger, chars, ("early",), late))
    assert got == sorted(
        [("b", "c", "chapter differs"), ("b", "zz", "nobody"), ("x", "a", "book unknown"), ("b", "a", "repeated"), ("b", "a", "kind unknown"), ("b", "a", "no reason"), ("b", "a", "not late"), ("b", "d", "first chapter illegal"), ("b", "d", "text chapter illegal"), (None, "a", "field missing"), (None, "a", "no reason"), ("b", "late", "unlisted")],
        key=repr,
    )
    assert "unlisted" not in {r[2] for r in rows(ledgers.first_chapter_problems(ledger, chars, ("early",)))}


def test_same_names(spark):
    chars = spark.createDataFrame([("b", "1", "王（甲）"), ("b", "2", "王（乙）"), ("b", "3", "李"), ("b", "4", "李(丁)"), ("b", "5", "张"), ("c", "1", "王（甲）"), ("c", "2", "王（乙）"), ("c", "6", "王（丙）")], "book string, id string, name string")
    ledger = spark.createDataFrame([("b", "王", ["2", "1"], WHY), ("c", "王", ["1", "9"], WHY), ("b", "张", ["5"], "short"), ("b", "李", None, WHY)], "book string, base string, members array<string>, why string")
    got = rows(ledgers.same_name_problems(ledger, chars))
    assert got == sorted([("c", "王", "outsider"), ("c", "王", "members differ"), ("b", "张", "stale"), ("b", "张", "no reason"), ("b", "李", "members differ"), ("b", "李", "no bracket")], key=repr)
    assert {r[2] for r in rows(ledgers.same_name_problems(ledger.limit(0), chars))} == {"unlisted", "no bracket"}


def test_cross_chapters(spark):
    items = spark.createDataFrame([("b", 1, ["e1", "e2"]), ("b", 2, ["e3"]), ("b", 3, None)], "book string, ch int, events array<string>")
    events = spark.createDataFrame([("b", "e1", 1), ("b", "e2", 4), ("b", "e3", 5), ("b", "e4", None)], "book string, event string, ch int")
    entries = [("b", 1, "e2", WHY), ("b", 1, "e1", WHY), ("b", 1, "e3", WHY), ("b", 3, "gone", WHY), ("b", 9, "e1", WHY), ("x", 1, "e1", WHY), ("b", 0, "e1", WHY), ("b", 2, "e4", "short"), ("b", 2, "e4", WHY)]
    ledger = spark.createDataFrame(entries, "book string, ch int, event string, why string")
    got = {(r.book, r.ch, r.event, r.problem) for r in ledgers.cross_chapter_problems(ledger, items, events).collect()}
    assert got == {("b", 1, "e1", "same chapter"), ("b", 1, "e3", "undeclared"), ("b", 3, "gone", "event unknown"), ("b", 9, "e1", "no annotation"), ("x", 1, "e1", "book unknown"), ("b", 0, "e1", "field missing"), ("b", 2, "e4", "no reason"), ("b", 2, "e4", "repeated"), ("b", 2, "e3", "unlisted")}


def test_name_forms_counts_and_rejected(spark):
    chars = spark.createDataFrame([("b", "甲", ["老甲"]), ("b", "乙", ["老甲", "小乙"])], "book string, name string, aliases array<string>")
    ledger = spark.createDataFrame([("b", "甲", WHY), ("b", "甲", ""), ("b", "老甲", WHY), ("b", "谁", WHY), ("b", None, WHY), ("x", "甲", WHY)], "book string, name string, why string")
    got = {tuple(r) for r in ledgers.name_form_problems(ledger, chars).collect()}
    assert got == {("b", "甲", "no reason", None), ("b", "甲", "repeated", None), ("b", "老甲", "alias", "乙"), ("b", "谁", "unknown", None), ("b", None, "blank name", None), ("x", "甲", "book unknown", None)}
    declared = spark.createDataFrame([("b", 5), ("c", 0), ("d", 2), ("e", None)], "book string, n int")
    assert rows(ledgers.declared_counts(declared, ledger.select("book"))) == [("d", 2, 0)]
    rejected = spark.createDataFrame([("b", "x", "no"), ("b", " ", None)], "book string, alt string, why string")
    assert rows(ledgers.rejected_problems(rejected)) == [("b", " ", "blank name"), ("b", " ", "no reason")]
