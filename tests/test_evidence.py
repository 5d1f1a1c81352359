"""Evidence, ledger quotes, lines of descent, wordings, lenient JSON, exports and filled positions on small fixtures."""

import json
import math

import pytest
from pyspark.sql import functions as F

from taleweave.functions import lenient
from taleweave.operators import evidence, kin, layout, ledgers
from taleweave.operators.view import ViewState
from taleweave.sources import exports


@pytest.fixture(scope="module")
def found(spark):
    chars = spark.createDataFrame(
        [("b", "a", "甲一", ["阿甲"]), ("b", "c", "丙三", None), ("b", "d", "丁四", None), ("b", "e", "甲一二", None), ("n", "a", "甲一", None), ("n", "c", "丙三", None)], "book string, id string, name string, aliases array<string>"
    )
    rels = spark.createDataFrame([("b", 1, "a", "c", "盟友"), ("b", 2, "a", "d", "兄弟（义）"), ("b", 3, "a", "e", "父子"), ("n", 1, "a", "c", "盟友")], "book string, rel int, src string, dst string, type string")
    told = [
        ("b", 1, 0, "甲一说「天色已晚」"),  # names an end, in the book
        ("b", 1, 1, "他说「天色已晚」"),  # a pronoun alone
        ("b", 1, 2, "甲一说「从未写过」"),  # not in the book
        ("b", 1, 3, "阿甲与丁四「天色已晚」"),  # a brother of an end
        ("b", 1, 4, "阿甲与甲一二「天色已晚」"),  # kin, but a namesake
        ("b", 1, 5, "他走了"),  # no quotation
        ("b", 1, 6, "由族谱推导"),
        ("b", 1, 7, " "),
        ("b", 1, 8, "甲一「挡」下"),  # one sign is an emphasis
        ("n", 1, 0, "他说「天色已晚」"),  # the book's text is missing
    ]
    ev = spark.createDataFrame([(*t, False) for t in told], "book string, rel int, nth int, text string, derived boolean")
    sources = spark.createDataFrame([("b", "那 日天色 已晚，众人散去"), ("n", None)], "book string, text string")
    return evidence.actor_findings(rels, ev, chars, sources)


def test_actors(found):
    got = {(r.book, r.nth): (r.nameless, r.third, r.missing, r.thirds) for r in found.collect()}
    assert got == {
        ("b", 0): (False, False, False, []),
        ("b", 1): (True, False, False, []),
        ("b", 2): (False, False, True, []),
        ("b", 3): (False, True, False, ["d"]),
        ("b", 4): (False, False, False, []),
        ("b", 5): (False, False, False, []),
        ("b", 8): (False, False, False, []),
        ("n", 0): (True, None, None, []),
    }


def test_flags_meet_their_ledger(spark, found):
    flags = evidence.relation_flags(found)
    assert {tuple(r) for r in flags.collect()} == {("b", "a", "c", "ABC"), ("n", "a", "c", "A")}
    ledger = spark.createDataFrame([("b", "a", "c", "AB", "read it in the source"), ("b", "a", "d", "A", "read it in the source")], "book string, src string, dst string, flag string, why string")
    got = {(r.book, r.dst, r.problem) for r in ledgers.actor_problems(ledger, flags).collect()}
    assert got == {("b", "c", "differs"), ("b", "d", "stale"), ("n", "c", "unlisted")}


def test_ledger_quotes(spark):
    rows = [
        ("b", 1, "原文「甲·一在此地」可证", ["甲·一（长安）"]),
        ("b", 2, "「甲·一不在此地」", ["甲·一"]),
        ("b", 3, "「钟邓结怨」是说法", ["甲·一"]),
        ("b", 4, "「甲·一…散去」「散去⋯甲·一」「甲·一…无此」", ["甲·一"]),
        ("n", 5, "「甲一在此」", ["甲一"]),
        ("b", 6, "「甲·一在此地」", []),
        ("b", 7, "没有引文", ["甲·一"]),
        ("b", 8, None, ["甲·一"]),
    ]
    ledger = spark.createDataFrame(rows, "book string, entry int, why string, subjects array<string>")
    sources = spark.createDataFrame([("b", "那日甲·一 在此\n地，众人散去"), ("n", None)], "book string, text string")
    got = {(r.entry, r.nth): r.verdict for r in evidence.ledger_quotes(ledger, sources).collect()}
    assert got == {(1, 0): "found", (2, 0): "missing", (3, 0): "aside", (4, 0): "elided", (4, 1): "elided, missing", (4, 2): "elided, missing", (5, 0): "not judged", (6, 0): "not judged"}


def test_lines_of_descent(spark):
    # two lines of two steps from g to c, and a longer one
    rows = [("g", "p", 5, "父子（亲生）"), ("g", "q", 1, "母子"), ("p", "c", 2, "父子"), ("q", "c", 3, "养父子"), ("g", "r", 0, "父子"), ("r", "q", 0, "师徒")]
    edges = spark.createDataFrame(rows, "parent string, child string, ord int, type string")
    closed = kin.closure(edges)
    lines = kin.witnesses(edges, closed)
    pairs = spark.createDataFrame([("c", "g"), ("q", "g"), ("c", "r"), ("g", "c")], "younger string, elder string")
    chained = kin.chains(pairs, lines)
    assert {(r.younger, r.elder): [tuple(s) for s in r.steps] for r in chained.collect()} == {("c", "g"): [("g", "p"), ("p", "c")], ("q", "g"): [("g", "q")], ("c", "r"): [("r", "q"), ("q", "c")]}
    chars = spark.createDataFrame([("g", "祖"), ("p", "父"), ("c", "子")], "id string, name string")
    told = {(r.younger, r.elder): r.chain for r in kin.chain_text(chained, edges.withColumnsRenamed({"parent": "src", "child": "dst"}), chars).collect()}
    assert told[("c", "g")] == "由 「祖 —父子→ 父」、「父 —父子→ 子」 推导"
    assert told[("c", "r")] == "由 「r —亲子→ q」、「q —养父子→ 子」 推导"


def test_wordings(spark):
    words = ["叔侄（叔祖父与侄孙）", "同母异父的兄弟", "外祖母与外孙", "养父子", "高祖孙", "兄妹／情人", "盟友", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: (r.head, r.family, r.gap) for r in df.select("w", kin.head_of(F.col("w")).alias("head"), kin.family_of(kin.head_of(F.col("w"))).alias("family"), kin.claimed_gap(F.col("w")).alias("gap")).collect()}
    assert got["叔侄（叔祖父与侄孙）"] == ("叔侄", "collateral", 2) and got["同母异父的兄弟"][1:] == ("sibling", 0)
    assert got["外祖母与外孙"][2] == 2 and got["养父子"] == ("父子", "direct", 1) and got["高祖孙"][2] == 4
    assert got["兄妹／情人"][:2] == ("兄妹", "sibling") and got["盟友"][1] == "?" and got[None][0] == ""


def test_books_of_thin_descent_are_not_judged(spark):
    chars = spark.createDataFrame([(b, f"{b}{i}") for b in ("on", "off") for i in range(20)], "book string, id string")
    parents = spark.createDataFrame([("on", "on9", f"on{i}") for i in range(3)] + [("off", "off9", f"off{i}") for i in range(2)], "book string, parent string, child string")
    books = kin.covered_books(chars, parents)
    assert {r.book: (r.covered, r.judged) for r in books.collect()} == {"on": (3, True), "off": (2, False)}
    rels = [(b, f"{b}0", f"{b}1", t, d) for b in ("on", "off") for t, d in (("叔侄", False), ("兄弟", False), ("祖孙", True), ("盟友", False), ("母女", False))]
    rels = spark.createDataFrame(rels, "book string, src string, dst string, type string, derived boolean")
    terms = spark.createDataFrame([(b, f"{b}0", f"{b}1", "半兄弟", 0) for b in ("on", "off")], "book string, a string, b string, term string, gap int")
    exempt = spark.createDataFrame([("on", "on0", "on1", "short")], "book string, src string, dst string, why string")
    assert {(r.book, r.type) for r in kin.term_findings(rels, terms, books, exempt).collect()} == {("on", "叔侄"), ("on", "母女")}
    allowed = exempt.withColumn("why", F.lit("it stands so in chapter 6"))
    assert kin.term_findings(rels, terms, books, allowed).isEmpty()


def mended(raw):
    """The plain version: the last bracket at which what is open can be closed."""
    if raw is None or "{" not in raw:
        return None
    body = raw[raw.index("{") :]
    try:
        json.loads(body[: body.rfind("}") + 1])
        return body[: body.rfind("}") + 1]
    except ValueError:
        pass
    marks, stack, quoted, escaped = [], [], False, False
    for i, c in enumerate(body):
        if quoted:
            quoted, escaped = (c != '"' or escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if stack:
                stack.pop()
            marks.append((i, "".join(reversed(stack))))
    for i, closing in reversed(marks):
        try:
            json.loads(body[: i + 1] + closing)
            return body[: i + 1] + closing
        except ValueError:
            pass
    return None


def test_truncated_json(spark):
    full = '{"a": [1, {"b": "x]\\"}"}], "c": {"d": [true, null, "e"], "f": 1.5}, "g": "h\\\\"}'
    texts = [full, f"so {full} then", *[full[:n] for n in range(0, len(full), 4)], "{]", "none", "", None, '{"a": 1', "[1, 2]", '{"a": 1} {']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.j for r in df.select("i", lenient.repair_json(F.col("t")).alias("j")).collect()}
    assert got == {i: mended(t) for i, t in enumerate(texts)} and sum(v is not None for v in got.values()) > 10


def test_json_in_answers(spark):
    texts = ['{"a": 1}', 'so\n```json\n{"a": 2}\n```\nthen', 'it is {"a": 3} then', '{"a": 4} {', "1],[2", "nothing", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.j for r in df.select(lenient.extract_json(F.col("t")).alias("j")).collect()] == ['{"a": 1}', '{"a": 2}', '{"a": 3}', '{"a": 4}', None, None, None, None]


def test_ledger_shapes(spark):
    texts = ['["a", "_note", {"name": "b"}, {"x": 1}, 3, "a"]', '{"_why": "x", "明细": ["c"]}', '{"a": 1}', '{"a"', "7", None, "[]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [None if r.j is None else (r.j.names, r.j.entries, r.j.error) for r in df.select(lenient.ledger_names(F.col("t")).alias("j")).collect()]
    assert got == [(["a", "b"], 3, None), (["c"], 1, None), ([], 0, "no list"), ([], 0, "no JSON"), ([], 0, "no list"), None, ([], 0, None)]


def test_standalone_book(spark):
    chars = spark.createDataFrame([("a", 1), ("b", 4), ("c", 9), ("d", None)], "id string, first_ch int")
    schema = "src string, dst string, ch int, from_ch int, to_ch int, style string, kin string, derived boolean, events array<struct<ch: int, place: string>>"
    rels = spark.createDataFrame(
        [("a", "b", 2, 1, None, "solid", None, False, [(2, "x"), (8, "y"), (None, None)]), ("a", "c", 2, 1, None, "solid", None, False, [(2, "z")]), ("a", "d", 2, 1, 4, "solid", None, False, []), ("b", "d", 5, 1, None, "solid", None, False, [(5, "y")])], schema
    )
    events = spark.createDataFrame([("e", 3, "w"), ("f", 9, "y"), ("g", None, None)], "id string, ch int, place string")
    places = spark.createDataFrame([(p,) for p in "wxyz"], "place string")
    out = exports.standalone(ViewState(20, progress=5), chars, rels, events, places)
    assert {r.id for r in out["characters"].collect()} == {"a", "b", "d"}
    assert {(r.src, r.dst): [e.ch for e in r.events] for r in out["relations"].collect()} == {("a", "b"): [2, None], ("a", "d"): [], ("b", "d"): [5]}
    assert {r.id for r in out["events"].collect()} == {"e", "g"} and {r.place for r in out["places"].collect()} == {"w", "x", "y"}
    back = exports.standalone(ViewState(20, progress=5, time_travel=True, chapter=4), chars, rels, events, places)
    assert {(r.src, r.dst): len(r.events) for r in back["relations"].collect()} == {("a", "b"): 2, ("b", "d"): 0}
    assert exports.export_note(ViewState(20)) == "whole book"


def test_packs_come_back(spark, tmp_path):
    chars = spark.createDataFrame([("x", "a", None), ("x", "b", ""), ("y", "a", "n"), (None, "c", "m")], "book string, id string, note string")
    rels = spark.createDataFrame([("x", "a", "b"), ("x", "a", "a"), ("x", "a", "c"), ("y", "a", "b")], "book string, src string, dst string")
    positions = spark.createDataFrame([("x", "gen-v", "a", 1.4, -2.6)], "book string, layout string, id string, x double, y double")
    packs = exports.pack_collections(chars, rels, positions)
    exports.write_packs(packs, str(tmp_path / "packs"))
    schemas = {"characters": "id string, note string, degree long", "relations": "src string, dst string", "layouts": "layout string, id string, x long, y long"}
    back = exports.read_packs(spark, str(tmp_path / "packs"), schemas)
    for name, rows in packs.items():
        assert sorted(map(tuple, back[name].select(rows.columns).collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    assert {(r.book, r.id): r.degree for r in back["characters"].where("book = 'x'").collect()} == {("x", "a"): 4, ("x", "b"): 1}
    assert back["layouts"].first()["x"] == 1 and back["layouts"].first()["y"] == -3


def test_books_fall_back_one_by_one(spark, tmp_path):
    files = {"a.json": '{"t": 1}', "a.graph.json": '{"t":\n 2\n}\n', "b.json": '{"t": 3}', "b.graph.json": "{broken", "c.json": '{"t": 4}', "d.json": "[]", "e.graph.json": '{"t": 5}', "a.missing-ok.json": "[]", "books.json": "{}", "first-ch-ok.json": "[]"}
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    assert {r.book: r.bytes for r in exports.catalog(spark, tmp_path.as_uri()).collect()} == {"a": 8, "b": 8, "c": 8, "d": 2}
    got = {r.book: (r.source, r.doc.t if r.doc else None) for r in exports.load_books(spark, tmp_path.as_uri(), "t int").collect()}
    assert got == {"a": ("graph", 2), "b": ("full", 3), "c": ("full", 4), "d": (None, None), "e": ("graph", 5)}


def test_positions_are_filled_as_one_by_one(spark):
    nodes = [(f"n{i}", i) for i in range(14)]
    placed = {"n0": (0.0, 0.0), "n5": (10.0, 4.0), "n9": (-6.0, 2.0)}
    edges = [("n1", "n0"), ("n1", "n5"), ("n2", "n1"), ("n2", "n1"), ("n2", "n9"), ("n3", "n7"), ("n4", "n3"), ("n7", "n8"), ("n8", "n13"), ("n10", "n10"), ("n12", "n11"), ("n13", "n12")]
    both = [(a, b) for x in edges for a, b in (x, x[::-1])]
    want, pos, alone = {}, dict(placed), 0
    cx, cy = (sum(p[k] for p in placed.values()) / 3 for k in (0, 1))
    for n, _ in nodes:
        if n in placed:
            continue
        near = [pos[b] for a, b in both if a == n and b in pos]
        if near:
            pos[n] = tuple(sum(p[k] for p in near) / len(near) for k in (0, 1))
        else:
            pos[n] = (cx + math.cos(alone * 2.399963) * 18 * math.sqrt(alone + 1), cy + math.sin(alone * 2.399963) * 18 * math.sqrt(alone + 1))
            alone += 1
        want[n] = pos[n]
    got = layout.fill_positions(
        spark.createDataFrame(nodes, "id string, ord long"), spark.createDataFrame([(k, *v) for k, v in placed.items()], "id string, x double, y double"), spark.createDataFrame(both, "at string, to string")
    )
    assert {r.id: (round(r.x, 6), round(r.y, 6)) for r in got.collect()} == {k: (round(x, 6), round(y, 6)) for k, (x, y) in want.items()}
