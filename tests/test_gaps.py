"""Missing names, fragments, alias candidates and what can't be searched for."""

import random
import re

from pyspark.sql import functions as F

from taleweave.operators import gaps, matching

STOP = "^(?:王宫|李子)"
PATTERN = "[王李张][一-龥]{1,2}"


def named(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "name string")


def report(texts, known, settled, least=2, near=10):
    """The plain version, with places in the whole text: names are masked sign by sign."""
    norm = lambda s: re.sub(gaps.FILLERS and r"[\s·・．.,，。、\"'“”‘’()（）]", "", s).lower()
    forms = sorted({re.sub(r"（[^）]*）|\([^)]*\)", "", k).strip() for k in known if len(re.sub(r"（[^）]*）|\([^)]*\)", "", k).strip()) >= 2}, key=lambda f: (-len(f), f))
    count, spans = {}, {}
    for i, t in texts:
        t = t or ""
        spans[i] = [(m, m + len(f)) for f in forms for m in range(len(t)) if t.startswith(f, m)]
    close = lambda i, at: any(s - near <= at <= e + near for s, e in spans[i])
    for i, t in texts:
        rest = t or ""
        for f in forms:
            rest = rest.replace(f, "〇" * len(f))
        for m in re.finditer(PATTERN, rest):
            name = m[0]
            if re.search(STOP, name) or re.search(gaps.FILLERS, name) or norm(name) in map(norm, forms) or any(name in f or f in name for f in forms):
                continue
            c = count.setdefault(name, [0, 0])
            c[0] += 1
            c[1] += close(i, m.start())
    out = {}
    for name, (n, near_n) in count.items():
        if n < least or not near_n or name in settled:
            continue
        at = next(((t, k) for i, t in texts for k in range(len(t or "")) if t.startswith(name, k) and close(i, k)), None)
        snippet = re.sub(r"\s+", " ", at[0][max(0, at[1] - 30) : at[1] + len(name) + 36]) if at else ""
        k = snippet.find(name)
        out[name] = (n, near_n, snippet, k <= 0 or not re.search(gaps.PARTICLES, snippet[k - 1]))
    return out


def test_gap_report_matches_a_plain_version(spark):
    rng = random.Random(6)
    words = ["甲乙", "甲乙丙", "王五六", "李四", "张三丰", "王宫里", "的", "，", "走", "李子", " \n ", "张飞（大）", "天"]
    texts = [(-2, "甲乙在张四五"), (-1, "张四五，甲乙")] + [(i, "".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(40)] + [(90, None), (91, "")]
    known, settled = ["甲乙", "甲乙丙", "张飞（大）", "李", "张三丰收"], ["王五天"]
    df = spark.createDataFrame(texts, "text_id long, text string")
    got = {r.name: (r.n, r.near, r.snippet, r.plausible) for r in gaps.gap_report(df, named(spark, known), named(spark, settled), PATTERN, STOP, least=2, near=10).collect()}
    assert got == report(texts, known, settled) and len(got) > 3
    assert {v[3] for v in got.values()} == {True, False}
    assert gaps.gap_report(df.limit(0), named(spark, known), named(spark, settled), PATTERN, STOP).isEmpty()


def test_names_are_counted_in_one_pass_over_the_texts(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    texts = [(i, f"甲乙在张四五，{'走' * i}张四五，甲乙丙") for i in range(20)]
    df = spark.createDataFrame(texts, "text_id long, text string").mapInArrow(counted, "text_id long, text string")
    out = gaps.gap_report(df, named(spark, ["甲乙", "甲乙丙"]), named(spark, ["无"]), PATTERN, STOP, near=10)
    assert [tuple(r) for r in out.select("name", "n", "near").collect()] == [("张四五", 40, 40)]
    assert read.value == len(texts)


def test_known_names_may_be_more_than_an_automaton_takes(spark, monkeypatch):
    monkeypatch.setattr(matching, "MOST_FORMS", 2)
    texts = [(1, "甲乙在张四五，走走走走走走走走走走走走张四五"), (2, "王五天甲乙丙张四五"), (3, None), (4, "张四五")]
    known = ["甲乙", "甲乙丙", "天甲", "乙丙"]
    df = spark.createDataFrame(texts, "text_id long, text string")
    got = {r.name: (r.n, r.near, r.snippet, r.plausible) for r in gaps.gap_report(df, named(spark, known), named(spark, ["无"]), PATTERN, STOP, least=1).collect()}
    assert got == report(texts, known, [], least=1, near=gaps.NEAR) and got["张四五"][:2] == (4, 3)


def test_shown_gaps(spark):
    df = spark.createDataFrame([("a", 9, 1, True), ("b", 2, 5, True), ("c", 3, 5, True), ("d", 9, 9, False)], "name string, n long, near long, plausible boolean")
    assert [r.name for r in gaps.shown_gaps(df, 2).collect()] == ["c", "b"] and gaps.shown_gaps(df, 0).count() == 3


def test_fragments(spark):
    asked = ["荆州", "孔明曰", "吴主", "大来", "姜维", "孔明", None]
    got = {r.name: r.kind for r in gaps.fragment_kinds(named(spark, asked), named(spark, ["孔明", "吴主孙权", ""]), named(spark, ["荆州"])).collect()}
    assert got == {"荆州": "place", "孔明曰": "known and a sign", "吴主": "start of known", "大来": "ends in a particle", "姜维": "open", "孔明": "open", None: "open"}


def test_alias_candidates(spark):
    rows = [("a", 1, "何塞·A", "x", ["上校", "何塞a"]), ("b", 2, "上 校", "x", None), ("c", 3, "丙", "y", ["何塞A", "丙", "国王"]), ("d", 4, "国王", "z", []), ("e", 5, "何塞A", "y", ["上校"])]
    chars = spark.createDataFrame(rows, "id string, ord int, name string, faction string, aliases array<string>")
    got = {tuple(r) for r in gaps.alias_candidates(chars, "^国王$").collect()}
    assert got == {("b", "a", "上校", True), ("a", "c", "何塞A", False), ("b", "e", "上校", False)}


def test_search_audit(spark):
    chars = spark.createDataFrame([("a", "奥雷", None, None), ("b", "乙", ["奥雷里"], None), ("c", "奥雷", ["奥列"], None), ("d", "丁", [], ["x"])], "id string, name string, aliases array<string>, alt_names array<string>")
    rels = spark.createDataFrame([("a", "b"), ("a", "d"), ("a", "zz"), ("d", "d"), ("d", "b"), ("b", "zz")], "src string, dst string")
    pairs = spark.createDataFrame([("雷", "列"), ("雷", "雷")], "a string, b string")
    got = {tuple(r) for r in gaps.search_audit(chars, rels, pairs).collect()}
    assert got == {("no alias", "a", "3"), ("no alias", "d", "4"), ("variant missing", "a", "奥列"), ("variant missing", "b", "奥列里")}
