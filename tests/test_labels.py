"""Labels, folds, wordings and coverage on small fixtures worked out by hand."""

from pyspark.sql import functions as F

from taleweave.functions import labels


def values(df, column):
    return [r.v for r in df.select(column.alias("v")).collect()]


def test_colours(spark):
    df = spark.createDataFrame([("#1", 9), ("", None), (None, -1)], "color string, nth int").coalesce(1)
    assert values(df, labels.faction_color(F.col("color"), F.col("nth"))) == ["#1", labels.NO_COLOR, labels.NO_COLOR]
    assert values(df, labels.faction_color(F.col("color"), F.col("nth"), ("a", "b"))) == ["b", "a", "a"]
    chars = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "z")], "ord long, faction string")
    factions = spark.createDataFrame([("y", "Y", "#7", 0), ("w", "W", None, 1)], "key string, name string, color string, nth int")
    got = {(r.key, r.name, r.color) for r in labels.colored_factions(chars, factions).collect()}
    assert got == {("y", "Y", "#7"), ("w", "W", "#3498db"), ("x", "x", "#e74c3c"), ("z", "z", "#2ecc71")}


def test_names_fall_back(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    got = labels.named(df, "id", spark.createDataFrame([("a", "A"), ("b", "")], "id string, name string"), F.col("id"))
    assert {(r.id, r.label) for r in got.collect()} == {("a", "A"), ("b", "b"), (None, None)}


def test_folds(spark):
    df = spark.createDataFrame([(None, 5, 100), (25, 5, 100), (95, 5, 100), (0, 5, 30), (200, 5, 100), (None, 5, 3)], "asked int, first int, total int").coalesce(1)
    got = [tuple(x) for x in values(df, labels.fold(F.col("asked"), F.col("first"), F.col("total")))]
    assert got == [(5, False, False, "more", 20), (25, True, False, "more", 20), (95, True, False, "more", 5), (5, False, False, "all", 20), (100, True, True, "collapse", 0), (3, False, True, "collapse", 0)]


def test_basis_and_references(spark):
    df = spark.createDataFrame([("整理者推断（见前文）",), ("原文依据(x)",), (None,)], "b string").coalesce(1)
    assert [tuple(x) for x in values(df, labels.basis(F.col("b")))] == [(True, "见前文"), (False, "x"), (False, "")]
    texts = spark.createDataFrame([(1, "见e12与e-3a和e99"), (2, None)], "text_id int, text string")
    got = labels.references(texts, spark.createDataFrame([("e12",), ("e-3a",)], "id string"))
    assert {tuple(r) for r in got.collect()} == {(1, 0, "e12"), (1, 1, "e-3a")}


def test_wordings(spark):
    df = spark.createDataFrame([("零",), ("十二",), ("一百零五",), ("二百三十",), ("百",), ("x",)], "s string").coalesce(1)
    assert values(df, labels.chapter_numeral(F.col("s"))) == [0, 12, 105, 230, 100, 0]
    df = spark.createDataFrame([("叔侄（叔祖父与侄孙）",), ("曾叔祖父",), ("天祖父",), ("舅甥",), ("侄",), ("朋友",), (None,)], "s string").coalesce(1)
    assert values(df, labels.kin_generations(F.col("s"))) == [2, 2, 4, 1, 1, 0, 0]
    assert values(df, labels.kin_headword(F.col("s")))[::6] == ["叔侄", ""]


def test_fields(spark):
    source = spark.createDataFrame([("a", "x", [1], None), ("b", "", [], None)], "id string, note string, list array<int>, gone int")
    packs = [source.select("id", F.lit("").alias("note")), source.select("list", F.lit(1).alias("more"))]
    assert {tuple(r) for r in labels.field_problems(source, packs).collect()} == {("note", "lost"), ("more", "extra")}
    assert labels.field_problems(source, packs, ("note", "more")).isEmpty()
    assert {tuple(r) for r in labels.distribution(source, "note").collect()} == {("x", 1), ("", 1)}
