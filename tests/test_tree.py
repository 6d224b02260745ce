"""The exact tree against one that plain Python grows."""

import math
import random

import pytest

from sievestone.operators import classify, tree


def bits(p, n):
    return sum(-(x / n) * math.log2(x / n) for x in (p, n - p) if x)


def plain(rows, depth, leaf):
    """Nested (feature, threshold, left, right) or (rows, positives) of rows (values, label)."""
    n, p = len(rows), sum(y for _, y in rows)
    best = None
    if depth and n >= 2 * leaf and 0 < p < n:
        for f in range(len(rows[0][0])):
            key = lambda x: math.inf if x is None or x != x else x
            values = sorted({key(x[f]) for x, _ in rows})
            for low, high in zip(values, values[1:], strict=False):
                left = [y for x, y in rows if key(x[f]) <= low]
                nl, pl = len(left), sum(left)
                gain = round(bits(p, n) - nl / n * bits(pl, nl) - (n - nl) / n * bits(p - pl, n - nl), 10)
                if nl >= leaf and n - nl >= leaf and gain > 0 and (best is None or gain > best[0]):
                    best = gain, f, low if math.isinf(high) else tree.halfway(low, high), low
    if best is None:
        return n, p
    _, f, threshold, low = best
    sides = [[r for r in rows if (r[0][f] is not None and r[0][f] == r[0][f] and r[0][f] <= low) == side] for side in (True, False)]
    return f, threshold, *(plain(s, depth - 1, leaf) for s in sides)


def nested(nodes, at=0):
    f, threshold, left, right, n, share = nodes[at]
    return (n, round(share * n)) if f is None else (f, threshold, nested(nodes, left), nested(nodes, right))


def made(seed, n, nulls=False):
    rng, out = random.Random(seed), []
    for _ in range(n):
        x = [rng.gauss(0, 1), float(rng.randrange(2)), float(rng.randrange(5)), 7.0, rng.random() ** 3]
        y = int((x[0] > 0.3) ^ (x[1] == 1 and x[2] > 2) if rng.random() < 0.85 else rng.random() < 0.5)
        if nulls:
            x = [None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else v for v in x]
        out.append((x, y))
    return out


def frame(spark, rows, split="train"):
    return spark.createDataFrame([(split, y, *x) for x, y in rows], "split string, label int, a double, b double, c double, d double, e double")


COLUMNS = list("abcde")


@pytest.mark.parametrize(("seed", "n", "depth", "leaf", "nulls"), [(1, 400, 4, 10, False), (2, 250, 6, 1, False), (3, 300, 3, 5, True), (4, 60, 2, 40, False)])
def test_it_is_the_tree_that_plain_python_grows(spark, seed, n, depth, leaf, nulls):
    rows = made(seed, n, nulls)
    df = frame(spark, rows).repartition(7)
    model = classify.fit_tree(df, COLUMNS, depth, leaf)
    want = plain(rows, depth, leaf)
    assert nested(model.nodes) == want
    scored = model.score(df.unionByName(frame(spark, made(9, 50, nulls), "test")))
    for r in scored.collect():
        at = want
        while len(at) == 4:
            v = r[COLUMNS[at[0]]]
            at = at[2] if v is not None and v == v and v <= at[1] else at[3]
        assert r.score == pytest.approx(at[1] / at[0])


def test_ties_go_to_the_first_column_and_the_smaller_value(spark):
    rows = [([float(i), float(i), 0.0, 0.0, -float(i)], int(2 <= i < 6)) for i in range(8)] * 3
    model = classify.fit_tree(frame(spark, rows), COLUMNS, 2, 1)
    assert nested(model.nodes) == plain(rows, 2, 1) and model.nodes[0][:2] == [0, 1.5]


def test_what_cannot_be_split(spark):
    assert classify.fit_tree(frame(spark, [([1.0] * 5, 1)] * 4), COLUMNS) is None
    assert classify.fit_tree(frame(spark, []), COLUMNS) is None
    flat = classify.fit_tree(frame(spark, [([1.0] * 5, i % 2) for i in range(10)]), COLUMNS, 3, 1)
    assert flat.nodes == [[None, None, None, None, 10, 0.5]]
    assert [r.score for r in flat.score(frame(spark, [([2.0] * 5, 1)])).collect()] == [0.5]


@pytest.mark.parametrize("few", [1 << 16, 6, 2])
def test_trees_side_by_side_are_those_grown_alone_in_the_passes_of_the_deepest(spark, monkeypatch, few):
    """Features with at most `few` values are counted by codes, the others by values."""
    rows, passes, by_codes = made(6, 300, True), [], tree._best_by_codes
    monkeypatch.setattr(tree, "FEW", few)
    monkeypatch.setattr(tree, "_best_by_codes", lambda *given: passes.append(1) or by_codes(*given))
    settings = ({"depth": 2, "leaf": 40}, {"depth": 4, "leaf": 20}, {"depth": 5, "leaf": 3})
    models = classify.fit_all("cart", frame(spark, rows).repartition(3), COLUMNS, settings)
    assert [nested(m.nodes) for m in models] == [plain(rows, s["depth"], s["leaf"]) for s in settings]
    assert len(passes) == 5


def test_many_cells_are_given_in_parts(spark, monkeypatch):
    rows = made(7, 400)
    for name, size in (("CHUNK", 64), ("DENSE", 8), ("HELD", 32)):
        monkeypatch.setattr(tree, name, size)
    assert nested(tree.grow(frame(spark, rows).repartition(2), COLUMNS, 3, 5)) == plain(rows, 3, 5)


def test_halfway_lies_between():
    a = 1.0
    b = math.nextafter(a, 2)
    assert tree.halfway(1.0, 2.0) == 1.5 and tree.halfway(a, b) == a and tree.halfway(-1e308, 1e308) < 1e308
