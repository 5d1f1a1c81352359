"""Hard negatives against a search of everything."""

import math
import random

import pytest
from pyspark.sql import functions as F

from taleweave.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, bucket string, norm double, v string, id string"


def by_hand(rows):
    own = {}
    lengths = [len(v) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    size = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
    for i, v, y in rows:
        if i is None or y is None or not v or len(v) != size or any(x is None or not math.isfinite(x) for x in v):
            continue
        most = float(hard_negatives.LARGEST)
        q = [math.floor(max(min(256 * x, most), -most)) for x in v]
        own[i] = min(own.get(i, (y, q)), (y, q))
    own = {i: ((y + 1) % 10 if i % 7 == 0 else y, q) for i, (y, q) in own.items()}
    out = set()
    for a in (i for i in own if i % 10 == 0):
        score = {i: sum(x * z for x, z in zip(own[a][1], q)) for i, (_, q) in own.items() if i != a}
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if own[i][0] == own[a][0]][:5]:
            fit = [i for i in ranked if own[i][0] != own[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:5]
            out |= {(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit)}
    return out


def rows_of(rng, n):
    out = []
    for i in range(n):
        scale = rng.choice([0.01, 0.2, 1, 1, 3])
        out.append((i, [rng.gauss(0.4, 1) * scale for _ in range(6)], rng.choice([0, 0, 0, 1, 2, 9])))
    out += [(n + k, out[3][1], k % 3) for k in range(40)]  # one vector under many ids and labels
    out += [(5, [0.5] * 6, 1), (5, [0.5] * 6, 1), (n + 50, [0.0] * 6, 0), (n + 51, [0.0] * 6, 1), (10 * n, [0.0] * 6, 0)]
    out += [(n + 60, None, 1), (n + 61, [], 1), (n + 62, [1.0] * 5, 1), (n + 63, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (n + 64, [1.0] * 5 + [math.nan], 1), (n + 65, [1.0] * 5 + [math.inf], 1), (n + 66, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    return out


@pytest.mark.parametrize(("bucket", "block"), [(2048, 1024), (16, 3)])
def test_matches_a_search_of_everything(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(hard_negatives, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "STRIP", 2)
    rows = rows_of(random.Random(2), 150)
    df = spark.createDataFrame([(*r, "x", 0.0, "x", "x") for r in rows], SCHEMA)
    got = hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, F.col("id") % 7 == 0).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == by_hand(rows) and len(got) > 100


def test_large_components_stay_exact(spark):
    rows = [(i, [(1 + i) * 90000.5, -70000.25 * i, 1e9 if i == 7 else 0.0], i % 2) for i in range(20)]
    df = spark.createDataFrame([(*r, "x", 0.0, "x", "x") for r in rows], SCHEMA)
    assert set(map(tuple, hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, F.col("id") % 7 == 0).collect())) == by_hand(rows)


def test_bounds_rule_buckets_out(spark, monkeypatch):
    """Buckets of short vectors meet no anchor once better rows are known."""
    monkeypatch.setattr(hard_negatives, "BUCKET_ROWS", 10)
    met = []
    written = hard_negatives.written
    monkeypatch.setattr(hard_negatives, "written", lambda df, name: met.append((name, written(df, name))) or met[-1][1])
    rows = [(i, [4.0 if i < 40 else 0.01, 0.0], i % 2) for i in range(400)]
    df = spark.createDataFrame([(*r, "x", 0.0, "x", "x") for r in rows], SCHEMA)
    got = hard_negatives.hard_negatives(df, F.col("id") == 0, None).collect()
    assert {r.negative_id for r in got} == {1, 3, 5, 7, 9} and len(got) == 25
    best = [t for name, t in met if name == "norm-best"]
    assert max(r.id for t in best for r in t.collect()) < 40


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.hard_negatives(none, F.col("id") % 10 == 0).isEmpty()
    alone = spark.createDataFrame([(0, [1.0], 1, "x", 0.0, "x", "x")], SCHEMA)
    assert hard_negatives.hard_negatives(alone, F.col("id") % 10 == 0).isEmpty()
