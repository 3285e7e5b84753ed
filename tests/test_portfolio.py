"""Clustering and risk parity as joins, against naive loops: ties, several portfolios at once, names that never move."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from fathom.operators import portfolio
from fathom.plans import reports
from fathom.sources import synthetic

from .test_whole import naive_hrp


def pairs_of(dist: dict[tuple[str, str], float], names: list[str], of: str = "p") -> list[tuple]:
    return [(of, a, b, 0.0 if a == b else dist[a, b]) for i, a in enumerate(names) for b in names[i:]]


def kruskal(dist: dict[tuple[str, str], float], names: list[str]) -> tuple[set, list[str]]:
    """The tree's edges and the leaves: all pairs by length and names; the cluster made first stands left."""
    made = {n: (k, [n]) for k, n in enumerate(sorted(names))}
    tree, k = set(), len(names)
    for (a, b), _ in sorted(dist.items(), key=lambda e: (e[1], e[0])):
        x, y = sorted((made[a], made[b]), key=lambda c: c[0])
        if x[0] != y[0]:
            tree.add((a, b))
            for n in x[1] + y[1]:
                made[n] = (k, x[1] + y[1])
            k += 1
    return tree, made[names[0]][1]


@pytest.mark.parametrize("values", [(1.0,), (0.1, 0.2), tuple(x / 7 for x in range(7)), None])
def test_single_linkage_with_ties(spark, values):
    rng = random.Random(3)
    rows, want = [], {}
    for of, p in (("one", 1), ("two", 2), ("some", 5), ("many", 19)):
        names = [f"n{i:02}" for i in rng.sample(range(40), p)]
        names.sort()
        dist = {(a, b): rng.choice(values) if values else rng.random() for i, a in enumerate(names) for b in names[i + 1 :]}
        rows += pairs_of(dist, names, of)
        want[of] = kruskal(dist, names)
    table = spark.createDataFrame(rows, "portfolio string, a string, b string, dist double").repartition(5)
    trees: dict[str, set] = {of: set() for of in want}
    for r in portfolio.spanning_tree(table).collect():
        trees[r.portfolio].add((r.a, r.b))
    leaves: dict[str, dict] = {}
    for r in portfolio.leaf_order(table).collect():
        leaves.setdefault(r.portfolio, {})[r.pos] = r.name
    for of, (tree, order) in want.items():
        assert trees[of] == tree
        assert [leaves[of][k] for k in range(len(order))] == order


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 16, 21])
def test_halves(spark, n):
    order = spark.createDataFrame([("p", f"n{i}", i, n) for i in range(n)], "portfolio string, name string, pos int, names int")
    got: dict[int, dict[int, list[int]]] = {}
    for r in portfolio.halves(order).collect():
        got.setdefault(r.level, {}).setdefault(r.half, []).append(int(r.name[1:]))
    want: dict[int, dict[int, list[int]]] = {}

    def split(items, level):
        if len(items) > 1:
            for part in (items[: len(items) // 2], items[len(items) // 2 :]):
                want.setdefault(level, {})[part[0]] = part
                split(part, level + 1)

    split(list(range(n)), 0)
    assert {k: {h: sorted(x) for h, x in v.items()} for k, v in got.items()} == want


def test_portfolios_side_by_side(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(0, 0.01, (180, 6)) * np.arange(1, 7), rng.normal(0, 0.02, (90, 3))
    rows = [("x", f"S{j}", d, float(v)) for d, r in enumerate(x) for j, v in enumerate(r)] + [("y", f"S{j}", d, float(v)) for d, r in enumerate(y) for j, v in enumerate(r)]
    rows += [("still", n, d, 0.0 if n == "A" else float(d % 3)) for n in "AB" for d in range(30)] + [("lone", "A", d, None if d > 20 else 0.1 * d) for d in range(30)]
    got: dict[str, dict] = {}
    for r in portfolio.hrp_weights(spark.createDataFrame(rows, "portfolio string, ticker string, d_idx long, ret double")).collect():
        got.setdefault(r.portfolio, {})[r.ticker] = r.weight
    np.testing.assert_allclose([got["x"][f"S{j}"] for j in range(6)], naive_hrp(x), rtol=1e-9)
    np.testing.assert_allclose([got["y"][f"S{j}"] for j in range(3)], naive_hrp(y), rtol=1e-9)
    assert got["lone"] == {"A": 1.0} and sum(got["x"].values()) == pytest.approx(1)
    assert "still" not in got or all(math.isnan(w) or w >= 0 for w in got["still"].values())


def test_factor_mode(spark):
    """A report whose gates all passed puts its factor in charge; one gate that didn't leaves the baseline."""
    prices = synthetic.generate(spark, 14, 200, 5)
    gates = dict.fromkeys(["sharpe_positive", "beats_baseline_ci", "reality_check_significant", "deflated_sharpe_solid"], True)
    got = reports.build_portfolio(prices, verdict={"best_factor": "reversal_5d", "deployment_gates": gates})
    assert got.numbers["mode"] == "factor:reversal_5d" and 0 < got.numbers["positions"] <= 5
    held = {r.ticker for r in got.tables["current_portfolio"].collect()}
    whole = reports.build_portfolio(prices, verdict={"best_factor": "reversal_5d", "deployment_gates": {**gates, "beats_baseline_ci": False}})
    assert whole.numbers["mode"].startswith("baseline") and held <= {r.ticker for r in whole.tables["current_portfolio"].collect()}
