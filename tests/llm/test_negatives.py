"""Operator 12 against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import negatives
from lotwise.llm.queries import QUERIES

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, every=100):
    """rows of (vec_id, label, whole numbers), one a vec_id."""
    out = []
    for a, label, q in rows:
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(q, v)) for i, _, v in rows if i != a}
        of = {i: own for i, own, _ in rows}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if of[i] == label][:5]:
            fit = [i for i in order if of[i] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:5]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(fit, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "r") for r in rows], "vec_id long, label long, v array<long>, score int, tile string").repartition(3)


@pytest.mark.parametrize("tile, kind", [(4096, "random"), (7, "random"), (7, "clusters"), (20, "copies"), (9, "lengths")])
def test_against_all_pairs(spark, monkeypatch, tile, kind):
    monkeypatch.setattr(negatives, "TILE", tile)
    rng = random.Random(3)
    rows = []
    for i in range(220):
        centre = [rng.randrange(-300, 300) for _ in range(6)] if kind != "clusters" else [400 * (i % 9 == j) for j in range(6)]
        if kind == "copies" and i % 3:
            centre = [50] * 6  # a third of the rows and more are one vector, of all labels
        rows.append((i, rng.randrange(4) if i % 2 else 0, [c + (0 if kind == "copies" else rng.randrange(-40, 40)) for c in centre][: rng.randrange(1, 7) if kind == "lengths" else 6]))
    assert got(negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)) == plain(rows, 10)


def test_brackets_leave_out_what_is_far(spark, monkeypatch):
    """Of well-parted groups only pairs of tiles that are near each other are multiplied."""
    monkeypatch.setattr(negatives, "TILE", 16)
    rng = np.random.default_rng(1)
    groups = [(i, int(i % 2), (np.eye(8)[i % 8] * 1000 + rng.integers(-20, 20, 8)).astype(int).tolist()) for i in range(640)]
    df = frame(spark, groups)
    seen, met = [], negatives.met

    def look(anchors, rows, same, parts, slack):
        out = met(anchors, rows, same, parts, slack)
        seen.append((out.count(), met(anchors.withColumn("reach", F.lit(1e18)).withColumn("near", F.lit(0.0)), rows, same, parts, slack).count()))
        return out

    monkeypatch.setattr(negatives, "met", look)
    assert got(negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)) == plain(groups, 10)
    assert seen[0][0] < seen[0][1] / 2


def test_brackets_hold():
    rng = np.random.default_rng(2)
    x = rng.integers(-200, 200, (300, 12))
    space = negatives.Space(x[:5], float((x**2).sum(1).max()))
    q = x[::7]
    score = negatives.products(q, x)
    i, j, s = negatives.survivors(space, q, space.of_queries(q), x, space.of_rows(x), space.distance(q, np.full(len(q), 90_000)), np.zeros(len(q)))
    assert set(zip(*np.nonzero(score >= 90_000), strict=True)) <= set(zip(i, j, strict=True)) and (s == score[i, j]).all()


def test_odd_rows(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [0.5, 0.25]), (0, 1, [0.5, 0.25]), (0, 2, [9.0, 9.0]), (1, 1, [0.5, 0.2]), (2, 1, None), (3, None, [1.0, 1.0]), (4, 1, [1.0, None]), (5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]), (None, 1, [1.0, 1.0]), (8, 2, [0.5, 0.15]), (9, 2, [0.5, 0.15]), (10, 3, []), (11, 2, [-1.0, -1.0]), (14, 9, [0.5, 0.1])]
    spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, label int, embedding array<float>, rank int").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    kept = [(0, 2, whole([0.5, 0.25])), (1, 1, whole([0.5, 0.2])), (8, 2, whole([0.5, 0.15])), (9, 2, whole([0.5, 0.15])), (10, 3, []), (11, 2, whole([-1.0, -1.0])), (14, 0, whole([0.5, 0.1]))]
    # of the three rows with vec_id 0 the one of least label counts, after the rule that moves its label from 1 to 2
    found = got(QUERIES["op12_negatives"](spark, str(tmp_path)))
    assert found == plain(kept) and {r[1] for r in found} == {8, 9}


def test_empty_and_huge(spark):
    df = frame(spark, [(0, 1, [1 << 40, 1]), (1, 1, [1 << 40, 3]), (2, 2, [1 << 40, 2]), (3, 2, [-(1 << 40), 2])])
    most = negatives.largest_component(2)
    assert got(negatives.hard_negatives(df, F.col("vec_id") == 0)) == [(0, 1, 1, 2, most * most + 3, most * most + 2)]
    assert got(negatives.hard_negatives(df.limit(0), F.col("vec_id") == 0)) == []
    assert got(negatives.hard_negatives(df, F.lit(False))) == []
    assert got(negatives.hard_negatives(df.filter("label = 1"), F.lit(True))) == []
