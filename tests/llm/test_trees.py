"""Boosted trees against a plain version that looks at the rows of each node themselves."""

import math

import numpy as np
import pytest

from lexvane.llm import classifier


def plain(x, y, cuts, rounds, depth):
    """(features, thresholds, values) of each round, in heap order; a node without a split sends all rows to the left."""
    share = (sum(y) + 0.5) / (len(y) + 1)
    total = [math.log(share / (1 - share))] * len(y)
    out = []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-t)) for t in total]
        g, h = [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p]
        feature, threshold, value = [0] * (2**depth - 1), [math.inf] * (2**depth - 1), [0.0] * 2**depth

        def score(rows, g=g, h=h):
            return sum(g[r] for r in rows) ** 2 / (sum(h[r] for r in rows) + classifier.L2)

        def grow(node, rows, g=g, h=h, feature=feature, threshold=threshold, value=value):
            if node >= len(feature):
                step = classifier.RATE * sum(g[r] for r in rows) / (sum(h[r] for r in rows) + classifier.L2)
                value[node - len(feature)] = step
                for r in rows:
                    total[r] += step
                return
            best = 1e-6
            for f, some in enumerate(cuts):
                for cut in some:
                    left, right = [r for r in rows if x[r][f] <= cut], [r for r in rows if x[r][f] > cut]
                    if min(sum(h[r] for r in left), sum(h[r] for r in right)) < classifier.LEAST_WEIGHT:
                        continue
                    gain = score(left) + score(right) - score(rows)
                    if gain > best + 1e-9:
                        best, feature[node], threshold[node] = gain, f, cut
            grow(2 * node + 1, [r for r in rows if x[r][feature[node]] <= threshold[node]])
            grow(2 * node + 2, [r for r in rows if x[r][feature[node]] > threshold[node]])

        grow(0, range(len(y)))
        out.append((feature, threshold, value))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_whole_trees_by_brute_force(monkeypatch, seed):
    rounds, depth, bins = 3, 3, 8
    for name, value in {"ROUNDS": rounds, "DEPTH": depth, "BINS": bins}.items():
        monkeypatch.setattr(classifier, name, value)
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=(240, 4)), rng.integers(0, 3, 240), np.ones(240)])  # few values, and one value
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.5, size=240) > 0).astype(float)
    trees = classifier.boost(x, y)
    cuts = [sorted(set(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]))) for c in x.T]
    want = plain(x.tolist(), y.tolist(), cuts, rounds, depth)
    assert len(trees.feature) == rounds
    for f, t, v, (feature, threshold, value) in zip(trees.feature, trees.threshold, trees.value, want, strict=True):
        assert f.tolist() == feature and t.tolist() == threshold and np.allclose(v, value)
    assert len({round(v, 9) for v in trees.value[0]}) > 4  # deeper levels do split
