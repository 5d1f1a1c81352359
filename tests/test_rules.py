"""Small fixtures for the rules of books, kinship terms and ledgers; cases are worked out by hand."""

from pyspark.sql import functions as F

from taleweave.operators import kin, ledgers, rules, validate


def found(parts):
    parts = parts if isinstance(parts, list) else [parts]
    return {tuple(r)[:-3] + (r.kind, r.subject) for r in validate.report(parts).collect()}


def test_books(spark):
    schema = "book string, slug string, title string, type string, group_mode string, schema_version int, prophecy string, prophecy_source string"
    rows = [
        ("a", "a", "A", "叙事类", "generation", 2, None, None),
        ("b", None, " ", None, "both", 3, "x", ""),
        ("c", "c", "C", "作品集", "generation", None, "x", "y"),
        ("d", "d", "D", "理论类", None, 0, None, None),
    ]
    books = spark.createDataFrame(rows, schema)
    chars = spark.createDataFrame([("a", 1), ("a", 2), ("c", 1), ("c", 1)], "book string, generation int")
    assert found(rules.meta(books, chars)) == {
        ("b", "book without slug", "b"), ("b", "book without title", "b"), ("b", "type of book missing", "b"), ("b", "group mode illegal", "both"),
        ("b", "schema version", "b"), ("b", "prophecy without source", "b"), ("c", "type of book unsupported", "作品集"),
        ("c", "grouped by a single generation", "c"), ("c", "schema version", "c"), ("d", "schema version", "d"),
    }


def test_findings_are_counted_per_book(spark):
    chars = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")], "book string, id string")
    books = spark.createDataFrame([("a",), ("b",), ("c",)], "book string")
    parts = [validate.repeated(chars, "id", "error", "twice"), validate.empty_collection(chars, "characters", books)]
    assert {tuple(r) for r in validate.summary(validate.report(parts)).collect()} == {("a", "error", "twice", 1), ("c", "error", "characters empty", 1)}
    refs = spark.createDataFrame([("b", "x"), ("a", "y"), ("a", None)], "book string, ref string")
    assert found(validate.dangling(refs, "ref", chars, "id", "unknown")) == {("a", "unknown", "y")}


def test_many_relations_need_an_alias(spark):
    schema = "id string, name string, generation int, gender string, first_ch int, tier string, degree long"
    df = spark.createDataFrame([(i, i, 1, "m", 1, "main", 9) for i in "xy"], schema)
    aliases = spark.createDataFrame([("x",)], "id string")
    assert found(validate.characters(df, df, aliases=aliases)) == {("many relations, no alias", "y")}


def test_parents(spark):
    chars = spark.createDataFrame([("p", None), ("q", None), ("k", ["p", "q", "nobody"]), ("l", [])], "id string, parents array<string>")
    rels = spark.createDataFrame([("p", "k", "父子"), ("q", "k", "婆媳（无名的儿媳）"), ("q", "l", "母女"), ("gone", "l", "父女")], "src string, dst string, type string")
    expected = {("parent unknown", "nobody→k"), ("parent without relation", "q→k"), ("parent not declared", "q→l")}
    assert found(rules.parents(chars, rels)) == expected
    assert found(rules.parents(chars.withColumn("parents", F.lit(None).cast("array<string>")), rels)) == set()
    booked = lambda df: df.withColumn("book", F.lit("a"))
    assert found(rules.parents(booked(chars), booked(rels))) == {("a", *x) for x in expected}
    raw = spark.createDataFrame([("x", "[]"), ("y", '"x"'), ("z", None)], "id string, parents string")
    assert found(rules.not_a_list(raw, "parents", "not a list")) == {("not a list", "y")}


def test_histories(spark):
    schema = "id string, faction string, history array<struct<faction string, from_ch int>>"
    rows = [("a", "f", [("g", 1), ("f", 3)]), ("b", "f", [("f", 3), ("g", 1), ("f", 2)]), ("c", "f", []), ("d", "f", [("h", None), (None, 4)]), ("e", "f", None)]
    got = found(rules.faction_history(spark.createDataFrame(rows, schema), spark.createDataFrame([("f",), ("g",)], "faction string")))
    assert got == {("faction history empty", "c"), ("faction history not ascending", "b"), ("faction history without chapter", "d"), ("faction history unknown", "d"), ("last faction differs", "d")}
    lords = [("a", [("b", 1), (None, 2)]), ("b", [("b", 5), ("zz", 4)])]
    got = found(rules.lord_history(spark.createDataFrame(lords, "id string, history array<struct<lord string, from_ch int>>")))
    assert got == {("lord of oneself", "b"), ("lord unknown", "b"), ("lord history not ascending", "b")}


def test_repeats_with_a_gap_are_phases(spark):
    rows = [("a", "b", "t", 1, 3), ("b", "a", "t ", 3, None), ("a", "c", "t", 1, 3), ("a", "c", "t", 4, None), ("a", "d", "t", None, None), ("d", "a", "t", None, 0), ("a", "e", "t", 1, 2)]
    got = found(rules.contiguous_repeats(spark.createDataFrame(rows, "src string, dst string, type string, from_ch int, to_ch int")))
    assert got == {("relation repeated", "a↔b t"), ("relation repeated", "a↔d t")}


def test_places(spark):
    df = spark.createDataFrame([("p", "P", 1), ("p", "P", None), ("q", None, 1)], "id string, name string, first_ch int")
    cited = spark.createDataFrame([("p",), ("zz",), (None,), ("",)], "place string")
    got = found(rules.places(df, cited))
    assert got == {("place without id or name", "q"), ("place without chapter", "p"), ("place id repeated", "p"), ("place unknown", "zz")}


def test_summaries(spark):
    chars = spark.createDataFrame([("a", "曹操", ["丞相"]), ("b", "关羽（大）", ["丞相"]), ("c", "关羽（小）", None), ("d", "何塞", [])], "id string, name string, aliases array<string>")
    rows = [("e1", "曹操见关羽。", ["a", "c"]), ("e2", "丞相到了。关羽走了。", []), ("e3", "何塞·某人走了。", []), ("e4", None, None)]
    s = spark.createDataFrame(rows, "id string, summary string, chars array<string>")
    assert found(rules.unlisted_mentions(s, chars)) == {("named but not listed", "e2 关羽")}
    texts = spark.createDataFrame([("e1", "。他走了。曹操的父亲来了！母亲没来"), ("e2", "见到她"), ("e3", None)], "id string, text string")
    names = spark.createDataFrame([("曹操",)], "form string")
    assert found(rules.wording(texts, names)) == {("begins with a pronoun", "e1"), ("kin without a name", "e1 2")}


def test_collateral_terms(spark):
    cases = [
        (1, "m", "m", "m", "m", "伯", "叔侄（伯父与侄）"), (1, "m", "m", "m", "f", "伯叔", "伯叔侄（伯叔父与侄女）"), (2, "m", "m", "m", "f", "叔", "叔侄（叔祖父与侄孙女）"),
        (2, "f", "f", "m", "m", "伯叔", "舅甥（舅外祖父与甥孙）"), (3, "m", "f", "f", "f", "伯叔", "姑侄（曾姑祖母与甥曾女孙）"), (9, "f", "m", "f", "m", "叔", "姨甥（高祖姨母与侄来孙）"),
    ]
    df = spark.createDataFrame(cases, "gap int, q string, link string, elder string, younger string, o string, term string")
    got = df.select("term", kin.collateral_term(*[F.col(c) for c in ("gap", "q", "link", "elder", "younger", "o")]).alias("got")).collect()
    assert [r.got for r in got] == [r.term for r in got]


def test_connecting_ancestor_is_a_sibling_of_the_elder(spark):
    parents = spark.createDataFrame([("g", "e"), ("g", "m"), ("h", "f"), ("f", "y"), ("m", "y")], "parent string, child string")
    closed = kin.closure(parents)
    pairs = spark.createDataFrame([("e", "y", 1)], "elder string, younger string, gap int")
    assert [r.q for r in kin.connecting_ancestors(pairs, parents, closed).collect()] == ["m"]
    cousins = spark.createDataFrame([("y", "z"), ("y", "e")], "a string, b string")
    more = kin.closure(parents.unionByName(spark.createDataFrame([("e", "z")], "parent string, child string")))
    assert {(r.b, r.mark) for r in kin.cousin_mark(cousins, more).collect()} == {("z", "堂"), ("e", "表")}


def test_a_line_of_blood_beats_adoption(spark):
    rows = [("g", "p", False), ("g", "q", True), ("p", "x", False), ("q", "x", False), ("q", "y", False)]
    got = kin.adoptive_only(spark.createDataFrame(rows, "parent string, child string, adoptive boolean"))
    assert {tuple(r) for r in got.collect()} == {("q", "g"), ("y", "g")}


def test_kin_filled_and_worth_deriving(spark):
    df = spark.createDataFrame([("父子", None), ("父子", "无"), ("朋友", ""), (None, None), ("父子", " sworn ")], "type string, kin string")
    assert [r.k for r in df.select(kin.filled_kin(F.col("type"), F.col("kin")).alias("k")).collect()] == ["blood", "blood", None, None, "sworn"]
    df = spark.createDataFrame([("direct", 5), ("sibling", 0), ("collateral", 1), ("collateral", 2), ("unrelated", 0)], "kind string, gap int")
    assert [r.w for r in df.select(kin.worth_deriving(F.col("kind"), F.col("gap")).alias("w")).collect()] == [True, True, True, False, False]


def test_sibling_direction(spark):
    rows = [("a", "b", "兄妹", True), ("b", "a", "兄妹", True), ("a", "c", "养姐弟（义）", True), ("a", "b", "姐弟", False), ("a", "b", "姐妹", True)]
    ranks = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    got = kin.sibling_direction(spark.createDataFrame(rows, "src string, dst string, type string, derived boolean"), ranks)
    assert {(r.src, r.dst, r.finding) for r in got.collect()} == {("b", "a", "against the order"), ("a", "c", "order unknown")}


def test_ignored_names(spark):
    rows = [("甲乙", None, False), ("甲乙", None, False), ("_说明：", None, False), ("这是一句话。", None, False), ("曹操", "不是", True), ("许都", " ", True), ("_x", "y", True), (None, None, False), ("一二三四五六七八九十一二三", "w", True)]
    got = ledgers.ignored_problems(spark.createDataFrame(rows, "name string, why string, with_reason boolean"), spark.createDataFrame([("曹操",)], "name string"), spark.createDataFrame([("许都",)], "name string"))
    assert {(r.name, r.problem) for r in got.collect()} == {
        ("甲乙", "repeated"), ("这是一句话。", "prose"), ("曹操", "a person"), ("许都", "a place"), ("许都", "no reason"), ("_x", "hidden"), (None, "blank"), ("一二三四五六七八九十一二三", "prose"),
    }


def test_exemptions(spark):
    why = "it is so in the text"
    rows = [("a", "x", "y", why), ("a", "x", "x", why), ("a", "x", "zz", "no"), ("b", "x", "y", why), ("a", None, "y", why), ("a", "y", "x", why), ("a", "y", "x", why)]
    got = ledgers.exemption_problems(spark.createDataFrame(rows, "book string, src string, dst string, why string"), spark.createDataFrame([("a", "x"), ("a", "y")], "book string, id string"))
    assert {tuple(r) for r in got.collect()} == {
        ("a", "x", "x", "one person"), ("a", "x", "zz", "no reason"), ("a", "x", "zz", "nobody second"), ("b", "x", "y", "book unknown"), ("a", None, "y", "field missing"), ("a", "y", "x", "repeated"),
    }


def test_coverage_and_actors(spark):
    chars = spark.createDataFrame([("王五", ["五哥"]), ("阿大", None), ("阿二", [])], "name string, aliases array<string>")
    declared = spark.createDataFrame([("阿大",), ("王五",), ("五哥",), ("没有",), ("没有",)], "name string")
    got = ledgers.coverage_problems(declared, chars, "[王李].{1,2}")
    assert {tuple(r) for r in got.collect()} == {("阿二", "undeclared"), ("王五", "within reach"), ("五哥", "alias"), ("没有", "unknown"), ("没有", "repeated")}
    schema = "book string, src string, dst string, flag string"
    ledger = spark.createDataFrame([("a", "x", "y", "A", "it is so in the text"), ("a", "x", "z", "A", "no")], schema + ", why string")
    got = ledgers.actor_problems(ledger, spark.createDataFrame([("a", "x", "y", "B"), ("a", "y", "z", "A")], schema))
    assert {(r.src, r.dst, r.problem) for r in got.collect()} == {("x", "y", "differs"), ("x", "z", "stale"), ("x", "z", "no reason"), ("y", "z", "unlisted")}


def test_other_names(spark):
    chars = spark.createDataFrame([("A", ["x", "y"]), ("B", ["z"]), ("C", None)], "name string, alt_names array<string>")
    rows = [("A", ["x", "w", "w"], "s"), ("zz", ["q"], "t"), ("C", [], None), ("C", [" "], None)]
    got = ledgers.other_name_problems(spark.createDataFrame(rows, "person string, alts array<string>, source string"), chars, spark.createDataFrame([("s",)], "source string"))
    assert {tuple(r) for r in got.collect()} == {
        ("A", "name repeated", None), ("A", "unlisted", "y"), ("A", "stale", "w"), ("B", "no entry", None), ("zz", "nobody", None), ("zz", "source unknown", "t"),
        ("C", "repeated", None), ("C", "no names", None), ("C", "blank name", None),
    }
