"""Boosted trees against boosting written out row by row."""

import math
import random

import pytest

from waypoint.operators import boosting

FEATURES = ["a", "b", "c"]
SCHEMA = "id long, a double, b double, c double, y double"


def made(n, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        a = rng.choice([None, 1.0, 2.0, 2.0, 3.0, float("nan")])
        b = rng.choice([None, float(rng.randrange(12))])
        c = float(rng.randrange(4))
        known = 0 if a is None or math.isnan(a) else a
        y = 3 * known + (5 if b is None else b * b / 9) + (c == 2) * 4 + rng.random()
        out.append((k, a, b, c, y))
    return out


def gone(x):
    return x is None or math.isnan(x)


def best_split(rows, min_rows):
    """Every feature, side and threshold; the first of equal gains."""
    def square(part):
        return sum(r for _, r in part) ** 2 / len(part) if part else 0.0

    best, found = 1e-9, None
    for f in range(3):
        missing = [r for r in rows if gone(r[0][f])]
        for side in (0, 1):
            for threshold in [*sorted({r[0][f] for r in rows if not gone(r[0][f])}), math.inf]:
                left = [r for r in rows if not gone(r[0][f]) and r[0][f] <= threshold] + (missing if side else [])
                right = [r for r in rows if not gone(r[0][f]) and r[0][f] > threshold] + ([] if side else missing)
                if len(left) < min_rows or len(right) < min_rows:
                    continue
                gain = square(left) + square(right) - square(rows)
                if gain > best + 1e-9:
                    goes_left = len(left) >= len(right) if not missing else side == 1
                    best, found = gain, (f, threshold, goes_left, left, right)
    return found


def grown(rows, depth, p):
    found = best_split(rows, p.min_rows) if depth else None
    if not found:
        return p.step * sum(r for _, r in rows) / len(rows)
    f, threshold, goes_left, left, right = found
    return f, threshold, goes_left, grown(left, depth - 1, p), grown(right, depth - 1, p)


def value(tree, x):
    while isinstance(tree, tuple):
        f, threshold, goes_left, left, right = tree
        tree = left if (goes_left if gone(x[f]) else x[f] <= threshold) else right
    return tree


def boosted(data, p):
    """Predictions after each tree."""
    xs, ys = [r[1:4] for r in data], [r[4] for r in data]
    done = [sum(ys) / len(ys)] * len(ys)
    stages = [done]
    for _ in range(p.iterations):
        tree = grown([(x, y - d) for x, y, d in zip(xs, ys, done, strict=True)], p.depth, p)
        done = [d + value(tree, x) for x, d in zip(xs, done, strict=True)]
        stages.append(done)
    return stages


@pytest.mark.parametrize("block_rows", [10_000, 150], ids=["one block", "several blocks"])
def test_trees_match_brute_force_tree_by_tree(rows, block_rows):
    data = made(400)
    p = boosting.Boosting(iterations=5, depth=3, step=0.3, block_rows=block_rows)
    df = rows(data, SCHEMA)
    model = boosting.fit(df.repartition(3), FEATURES, "y", ["id"], p)
    for t, want in enumerate(boosted(data, p)):
        part = boosting.Trees(model.nodes.where(f"tree <= {t}"), model.features)
        got = {r.id: r.p for r in df.select("id", part.score().alias("p")).collect()}
        assert all(abs(got[r[0]] - w) < 1e-9 for r, w in zip(data, want, strict=True)), t


def test_blocks_give_the_same_model_however_rows_are_dealt(rows):
    data = made(300, 4)
    p = boosting.Boosting(iterations=4, depth=4, block_rows=90)
    models = [boosting.fit(rows(d, SCHEMA).repartition(n), FEATURES, "y", ["id"], p) for d, n in ((data, 1), (data[::-1], 5))]
    a, b = (sorted(map(tuple, m.nodes.collect()), key=str) for m in models)
    assert a == b and len(a) > 20


def test_model_is_scored_alike_after_it_was_saved(spark, rows, tmp_path):
    df = rows(made(200, 2), SCHEMA)
    model = boosting.fit(df, FEATURES, "y", ["id"], boosting.Boosting(iterations=6))
    model.save(str(tmp_path / "m"))
    again = boosting.Trees.load(spark, str(tmp_path / "m"))
    both = df.select(model.score().alias("a"), again.score().alias("b")).collect()
    assert again.features == tuple(FEATURES) and all(r.a == r.b for r in both) and len({r.a for r in both}) > 10


def test_values_never_seen_and_rows_without_target(rows):
    data = [(k, float(k % 2), None, None, float(k % 2)) for k in range(100)] + [(200 + k, 1.0, 1.0, 1.0, None) for k in range(50)]
    model = boosting.fit(rows(data, SCHEMA), FEATURES, "y", ["id"], boosting.Boosting(iterations=60, step=0.2))
    out = rows([(1, 0.0, 9.0, None, None), (2, 1.0, None, 5.0, None), (3, None, None, None, None), (4, 7.0, None, None, None)], SCHEMA)
    got = {r.id: r.p for r in out.select("id", model.score().alias("p")).collect()}
    assert abs(got[1]) < 1e-3 and abs(got[2] - 1) < 1e-3 and abs(got[4] - 1) < 1e-3 and got[3] in (got[1], got[2])
    with pytest.raises(ValueError):
        boosting.fit(rows(data, SCHEMA).where("y is null"), FEATURES, "y", ["id"])


def test_rows_are_bounded_by_the_hash_of_their_key(rows):
    df = rows(made(500, 3), SCHEMA)
    p = boosting.Boosting(max_rows=100)
    (a, n), (b, m) = (boosting.sampled(x, ["id"], p) for x in (df, df.orderBy("y").repartition(4)))
    assert n == m and 60 < n < 140
    assert {r.id for r in a.collect()} == {r.id for r in b.collect()}


def test_several_blocks_grow_in_one_task_as_they_do_over_many(rows, monkeypatch):
    df = rows(made(400, 5), SCHEMA)
    many, one = (boosting.Boosting(iterations=4, depth=4, block_rows=90, in_task_rows=n) for n in (0, 400))
    a = boosting.fit(df, FEATURES, "y", ["id"], many)

    def refused(*_):
        raise AssertionError("a job per level for a sample that fits a task")

    monkeypatch.setattr(boosting, "_together", refused)
    b = boosting.fit(df, FEATURES, "y", ["id"], one)
    assert [r[:7] for r in sorted(map(tuple, a.nodes.collect()))] == [r[:7] for r in sorted(map(tuple, b.nodes.collect()))]
    both = df.select(a.score().alias("a"), b.score().alias("b")).collect()
    assert len({r.a for r in both}) > 10 and all(abs(r.a - r.b) < 1e-9 for r in both)


def test_scores_go_down_leaves_at_any_depth(rows):
    nodes = rows(
        [(0, 1, None, None, None, None, None, 1.0, 9), (2, 1, "b", 5.0, True, 2, 3, None, 9), (2, 2, None, None, None, None, None, 10.0, 4)]
        + [(2, 3, "a", 2.0, False, 6, 7, None, 5), (2, 6, None, None, None, None, None, 20.0, 2), (2, 7, None, None, None, None, None, 30.0, 3)],
        boosting.NODES,
    )
    data = [(1, 9.0, 5.0), (2, 2.0, 6.0), (3, 2.1, 6.0), (4, None, 6.0), (5, float("nan"), None), (6, 1.0, float("nan")), (7, float("inf"), float("inf"))]
    out = rows(data, "id long, a double, b double").select("id", boosting.Trees(nodes, ("a", "b")).score().alias("p"))
    assert {r.id: r.p for r in out.collect()} == {1: 11.0, 2: 21.0, 3: 31.0, 4: 31.0, 5: 11.0, 6: 11.0, 7: 31.0}
