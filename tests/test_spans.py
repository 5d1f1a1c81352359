"""Spans of known forms, masks, swallowed names, dotted names and speakers against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from taleweave.operators import dotted, matching, textmine

TEXTS = [(1, "何塞·阿尔卡蒂奥到了，阿尔卡蒂奥走了"), (2, "aaa abab aabab"), (3, ""), (4, None), (5, "到阿尔卡蒂奥"), (6, "（第二代）何塞（第一代）")]
FORMS = ["阿尔卡蒂奥", "何塞·阿尔卡蒂奥", "何塞", "aa", "ab", "bab", "", None]


def frames(spark, texts=TEXTS, forms=FORMS):
    return spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame([(f,) for f in forms], "form string")


def spans_by_hand(texts, forms):
    return sorted((i, at, at + len(f), f) for i, t in texts for f in set(forms) if f and t for at in range(len(t)) if t.startswith(f, at))


@pytest.mark.parametrize("most", [50_000, 2])
def test_spans_overlap_and_nest(spark, monkeypatch, most):
    """With forms in one automaton, and in parts that each meet the texts."""
    monkeypatch.setattr(matching, "MOST_FORMS", most)
    got = sorted(tuple(r) for r in matching.spans(*frames(spark)).select("text_id", "start", "stop", "form").collect())
    assert got == spans_by_hand(TEXTS, FORMS) and len(got) > 10


@pytest.mark.parametrize("most", [50_000, 2])
def test_forms_in_texts(spark, monkeypatch, most):
    monkeypatch.setattr(matching, "MOST_FORMS", most)
    texts, forms = frames(spark)
    got = {(r.text_id, r.form): (r.n, r.alone) for r in matching.occurring(texts, forms).collect()}
    want = {(i, f): t.count(f) for i, t in TEXTS for f in FORMS if f and t and f in t}
    assert {k: n for k, (n, _) in got.items()} == want
    assert got[(1, "阿尔卡蒂奥")] == (2, True) and got[(1, "何塞")] == (1, False) and got[(6, "何塞")] == (1, False)


def test_nothing_to_find(spark):
    texts, forms = frames(spark)
    assert matching.spans(texts, forms.limit(0)).isEmpty() and matching.spans(texts.limit(0), forms).isEmpty()
    assert matching.occurring(texts.withColumn("n_more", F.lit(1)), forms.limit(0)).columns == ["text_id", "n_more", "form", "n", "alone"]


def test_no_text_is_broadcast(spark):
    texts, forms = frames(spark)
    plan = matching.occurring(texts, forms)._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "Generate" not in plan


def test_masks_are_those_of_longest_forms_first(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("ab·") for _ in range(rng.randrange(30)))) for i in range(60)]
    forms = ["a·b", "ab", "ba", "abab", "aab", "b·b", "aa"]
    df, fs = frames(spark, texts, forms)
    got = {r.text_id: r.text for r in matching.masked(df, matching.longest(matching.spans(df, fs))).collect()}
    for i, t in texts:
        for f in sorted(forms, key=lambda f: (-len(f), f)):
            t = t.replace(f, matching.MASK)
        assert got[i] == t


def test_near_spans(spark):
    places = spark.createDataFrame([(1, p) for p in (0, 9, 10, 20, 33, 34, 200)] + [(2, 20)], "text_id long, pos int")
    found = spark.createDataFrame([(1, 20, 23)], "text_id long, start int, stop int")
    assert sorted(r.pos for r in matching.near_spans(places, found, 10).collect()) == [10, 20, 33]


def test_first_occurrence_that_no_longer_form_swallows(spark):
    texts = spark.createDataFrame([(1, "左将军张布与张布"), (2, "大张布来"), (3, "张布"), (4, "天水"), (5, None)], "text_id long, text string")
    names = spark.createDataFrame([("p1", "张布"), ("p2", "天水"), ("p3", "nobody")], "char string, name string")
    entities = spark.createDataFrame([(f,) for f in ("张布", "将军张布", "大张布", "水", "大水")], "form string")
    own = spark.createDataFrame([("p1", "大张布")], "char string, form string")
    got = {r.char: (r.first_text, r.first_at, r.n_swallowed) for r in matching.first_clean(texts, names, entities, own).collect()}
    # the first is swallowed by a title and name of somebody else; the person's own alias swallows nothing
    assert got == {"p1": (1, 6, 1), "p2": (4, 0, 0)}
    nobody = matching.first_clean(texts, names, entities, own.limit(0)).where("char = 'p1'").first()
    assert (nobody.first_text, nobody.first_at) == (1, 6)


def interpolated(texts, known, settled, least):
    """The plain version: every extent at every dot, counted, the best taken, then the filters."""
    han = lambda c: "一" <= c <= "龥"
    dots, count = [], {}
    for _, t in texts:
        for i, c in enumerate(t or ""):
            if c != "·":
                continue
            lefts = [t[i - k : i] for k in range(2, 6) if i >= k and all(map(han, t[i - k : i]))]
            rights, buf, more = [], "", 0
            for ch in t[i + 1 :]:
                if han(ch):
                    buf += ch
                elif ch == "·" and more < 2:
                    more += 1
                    buf += ch
                else:
                    break
                n = len(buf.replace("·", ""))
                if n > 12:
                    break
                if not buf.endswith("·") and n >= 2:
                    rights.append(buf)
            names = [f"{a}·{b}" for a in lefts for b in rights]
            if names:
                dots.append((t, i, names))
            for name in names:
                count[name] = count.get(name, 0) + 1
    picked = {}
    for t, i, names in dots:
        best = max(names, key=lambda x: (count[x], len(x), -x.index("·")))
        follows = t[i + len(best) - best.index("·") :].startswith("·〇")
        picked.setdefault(best, [0, follows])[0] += 1
    plain = {k.replace("·", "") for k in known}
    rest = {n: c for n, (c, follows) in picked.items() if not follows and not (len(n.split("·")) <= 2 and any(s in plain for s in n.split("·")))}
    rest = {n: c for n, c in rest.items() if c >= least and not any(n in k or (k in n and len(n) - len(k) <= 3) for k in known)}
    return {n: c for n, c in rest.items() if not any(n != m and n in m for m in rest) and n not in settled}


def test_dotted_names_match_a_plain_version(spark):
    texts = ["她曾祖母佩德罗妮拉·伊瓜兰来", "会遇见佩德罗妮拉·伊瓜兰说", "阿利黎奥·诺格拉医生", "阿利黎奥·诺格拉医生的", "何塞·拉克尔·蒙卡达，何塞·拉克尔·蒙卡达走", "弗朗西斯·德雷克、弗朗西斯·德雷克", "约翰·〇·〇约翰·弥尔顿·〇", "·x·一", "", None, "胡里奥·甲乙和胡里奥·甲乙"]
    rng = random.Random(8)
    parts = ["安娜", "伊凡", "彼得罗夫", "娜塔莎", "罗季昂"]
    texts += ["".join(rng.choice(["，", "说", "在"]) + "·".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(6)) for _ in range(30)]
    rows = list(enumerate(texts))
    known, settled = ["阿利黎奥·诺格拉", "甲乙", "伊凡·安娜·彼得罗夫"], ["弗朗西斯·德雷克"]
    named = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    df = spark.createDataFrame(rows, "text_id long, text string")
    got = {r.name: r.n for r in dotted.unknown_names(df, named(known), named(settled)).collect()}
    assert got == interpolated(rows, known, settled, 2)
    assert got["佩德罗妮拉·伊瓜兰"] == 2 and "弗朗西斯·德雷克" not in got


def test_dotted_names_read_the_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(k, f"见安娜·伊凡，见安娜·伊凡说。彼得罗夫·娜塔莎{k}") for k in range(20)]
    texts = spark.createDataFrame(rows, "text_id long, text string").mapInArrow(counted, "text_id long, text string")
    named = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    assert {r.name for r in dotted.unknown_names(texts, named(["罗季昂"]), named(["无"])).collect()} == {"见安娜·伊凡", "彼得罗夫·娜塔莎"}
    assert read.value == len(rows)


def test_unseen_speakers(spark):
    texts = spark.createDataFrame([(1, "张飞大怒曰：某。张飞曰。孔明笑曰。大喜曰。左右曰。张飞走"), (2, "张飞"), (3, None)], "text_id long, text string")
    known = spark.createDataFrame([("孔明",)], "name string")
    signs = spark.createDataFrame([("张",), ("孔",), ("大",)], "sign string")
    got = [(r.name, r.said, r.n) for r in textmine.unseen_speakers(texts, known, signs, 2).collect()]
    assert got == [("张飞", 2, 4)]
    assert textmine.unseen_speakers(texts, known, signs, 5).isEmpty()


def test_books_in_slices_match_whole_texts(spark):
    draw = random.Random(3)
    turns = [(f"b{k % 2}", k, "".join(draw.choice("ab c") for _ in range(draw.randrange(0, 40)))) for k in range(60)]
    whole = {b: " ".join(t for c, _, t in turns if c == b).replace(" ", "") for b in ("b0", "b1")}
    forms = ["ab", "abcab", "ca", "a" * 5, whole["b0"][50:120], whole["b1"][:30] + "x"]
    asked = spark.createDataFrame([(f,) for f in forms], "form string")
    clean = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    want = sorted((b, f, i, i + len(f)) for b, t in whole.items() for f in forms for i in range(len(t)) if t.startswith(f, i))
    pieces, rows = spark.createDataFrame(turns, "book string, nth long, text string"), spark.createDataFrame(list(whole.items()), "book string, text string")
    for books in (pieces, rows):
        texts, width = matching.sliced(books, clean, asked, 7)
        assert max(len(r.text) for r in texts.collect()) <= 2 * width < 200
        assert sorted(map(tuple, matching.places(books, clean, asked).collect())) == want
        assert {tuple(r) for r in matching.held(books, clean, asked).collect()} == {w[:2] for w in want}
