"""The label model against a majority vote, where voters repeat each other."""

import numpy as np

from fenestra.llm import toxicity


def simulated(seed, n=3000):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    right = lambda p: np.where(rng.random(n) < p, y, 1 - y)
    quiet = lambda v, p: np.where(rng.random(n) < p, -1, v)
    base = right(0.6)  # six voters that all repeat one poor one
    copies = [np.where(rng.random(n) < 0.05, 1 - base, base) for _ in range(6)]
    good = [quiet(right(0.85), 0.2) for _ in range(3)]
    return y, np.stack(copies + good, axis=1), right(0.8)


def test_posterior_beats_a_majority_vote_and_the_marks():
    for seed in range(3):
        y, votes, marks = simulated(seed)
        post, weight = toxicity.label_model(votes, marks)
        score = np.where(votes >= 0, 2 * votes - 1, 0).sum(axis=1) + 2 * marks - 1
        found, majority = ((post > 0.5) == y).mean(), ((score > 0) == y).mean()
        assert found > majority + 0.15 and found > (marks == y).mean() + 0.02, (found, majority)
        assert weight[:6].mean() < weight[6:].mean()


def test_voters_that_go_together_are_tied():
    y, votes, marks = simulated(7)
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    parent, tie = toxicity.voter_tree(onehot, np.where(y == 1, 0.99, 0.01))
    assert sum(parent[j] in range(6) for j in range(6)) == 5 and all(parent[j] == -1 for j in (6, 7, 8))
    assert (tie[parent >= 0] > toxicity.LEAST_EVIDENCE).all()
