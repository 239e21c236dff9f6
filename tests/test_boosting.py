"""Boosted trees against a plain booster that tries every split of every value, row by row."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from boutframe.operators import boosting, models


def slow_fit(x, y, trees, depth, rate, ridge=1.0, least=1.0):
    """x: rows of values or None. Returns margins of the training rows."""
    margin = [math.log(sum(y) / (len(y) - sum(y)))] * len(y)
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [round((a - b) * boosting.UNIT) / boosting.UNIT for a, b in zip(p, y, strict=True)], [round(a * (1 - a) * boosting.UNIT) / boosting.UNIT for a in p]
        add = [0.0] * len(y)

        def grow(rows, left_depth):
            score = lambda r: sum(g[i] for i in r) ** 2 / (sum(h[i] for i in r) + ridge)
            best = None
            for f in range(len(x[0])) if left_depth else ():
                for cut in sorted({x[i][f] for i in rows if x[i][f] is not None}):
                    for missing_left in (True, False) if any(x[i][f] is None for i in rows) else (True,):
                        left = [i for i in rows if (missing_left if x[i][f] is None else x[i][f] <= cut)]
                        right = [i for i in rows if i not in set(left)]
                        if left and right and min(sum(h[i] for i in r) for r in (left, right)) >= least:
                            gain = score(left) + score(right) - score(rows)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                                best = (gain, left, right)
            if best is None:
                return [(rows, None)]
            out = []
            for part in best[1:]:
                below = grow(part, left_depth - 1)
                out += [(r, w if w is not None else rate * -sum(g[i] for i in r) / (sum(h[i] for i in r) + ridge)) for r, w in below]
            return out

        for rows, weight in grow(list(range(len(y))), depth):
            for i in rows:
                add[i] = weight or 0.0
        margin = [a + b for a, b in zip(margin, add, strict=True)]
    return margin


def rows_of(n, seed=3):
    rng, out = random.Random(seed), []
    for k in range(n):
        a, b, c = rng.randrange(12), rng.random(), rng.randrange(3)
        missing = rng.random() < 0.3
        out.append((k, None if missing else a, float("nan") if rng.random() < 0.1 else round(b, 1), c, 5.0, None, int(rng.random() < (0.85 if missing else 0.2 + 0.05 * a))))
    return out


SCHEMA = "fight_id long, a int, b double, c int, same double, none double, target int"
FEATURES = ["a", "b", "c", "same", "none"]


def test_margins_equal_a_plain_booster(spark):
    rows = rows_of(90)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    fitted = boosting.fit(df, FEATURES, trees=5, depth=2, rate=0.3, rows=1.1, columns=1.0)
    x = [[None if v is None or v != v else v for v in r[1:6]] for r in rows]
    want = slow_fit(x, [r[6] for r in rows], 5, 2, 0.3)
    got = fitted.margins(np.array([[math.nan if v is None else v for v in r] for r in x], float))
    assert np.allclose(got, want, atol=1e-5)
    assert any(not d for t in fitted.trees for f, d in zip(t.feature, t.left_default, strict=True) if f == 0)  # missing a goes with the large ones
    scored = {r.fight_id: r for r in fitted.score(df.withColumn("p0", F.lit("x"))).collect()}
    assert all(math.isclose(scored[k].p, 1 / (1 + math.exp(-m)), abs_tol=1e-6) and scored[k].p0 == "x" for k, m in enumerate(want))


def test_a_model_does_not_depend_on_the_partitions(spark):
    df = spark.createDataFrame(rows_of(300), SCHEMA)
    one, other = (boosting.fit(d, FEATURES, trees=boosting.KEEP + 2, depth=2, rate=0.2) for d in (df.coalesce(1), df.repartition(4, F.rand(1))))
    assert [(t.feature, t.cut, t.left_default, t.weight) for t in one.trees] == [(t.feature, t.cut, t.left_default, t.weight) for t in other.trees] and len(one.trees) == boosting.KEEP + 2


def test_tables_without_anything_to_learn(spark):
    df = spark.createDataFrame(rows_of(20), SCHEMA)
    assert boosting.fit(df.where("false"), FEATURES).trees == [] and boosting.fit(df.where("target = 1"), FEATURES).trees == []
    sure = models.predict(df.withColumns({f: F.col(f).cast("double") for f in FEATURES}), models.booster_model("v", df.where("target = 1"), FEATURES)).first()
    assert sure["fighter_a_win_probability"] > 0.999 and sure["feature_count"] == 5
    flat = boosting.fit(df, ["same", "none"], trees=2)
    assert all(t.feature == [-1] for t in flat.trees)


def test_a_histogram_is_a_row_a_node_and_feature_and_leaves_follow_from_tables(spark):
    """What a pass moves doesn't depend on the number of bins in use, and a tree is walked by its decisions of each bin."""
    rng = random.Random(7)
    bins = np.array([[rng.choice([*range(256), boosting.MISSING]) for _ in range(200)] for _ in range(3)], np.uint8)
    tree = boosting.Tree()
    for node, feature, bin_, left in ((0, 1, 90, False), (2, 0, 20, True), (4, 2, 254, False)):
        tree.split(node, feature, bin_, 0.0, left, (0.1, 0.2))

    def walk(row):
        node = 0
        while tree.feature[node] >= 0:
            value = row[tree.feature[node]]
            node = tree.left[node] + (not (tree.left_default[node] if value == boosting.MISSING else value <= tree.bin[node]))
        return node

    assert tree.nodes_of_bins(bins).tolist() == [walk(row) for row in bins.T]
    packed = boosting._packed({k: np.full((256, 3), k) for k in range(4)})
    assert packed.num_rows == 4
    (added,) = boosting._added(iter([packed, packed]))
    assert [np.frombuffer(x, np.int64).tolist() for x in added.column("sums").to_pylist()] == [[2 * k] * 768 for k in range(4)]
