"""The quality classifier learns from all labelled rows and all their pairs."""

import numpy as np

from lithoscope.llm import quality_classifier as Q


def test_every_row_and_pair_counts(spark):
    draw = np.random.default_rng(3)
    d, y = len(Q.FEATURES), (np.arange(30_000) % 10 < 7).astype(int)  # more of a class than the former bound
    x = draw.normal(size=(len(y), d)) * 0.1 + 0.3
    x[:, 0] += 0.1 * y
    x[:, 1] -= 0.05 * y
    rows = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y)], "y int, x array<double>").repartition(4)
    model = Q.fit(rows)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0))
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    good, poor, gradient = z[y == 1], z[y == 0], np.zeros(d)
    for part in np.array_split(good, 40):  # the gradient over all pairs, none drawn
        less = 1 / (1 + np.exp((part @ model.weights)[:, None] - poor @ model.weights))
        gradient += less.sum(1) @ part - less.sum(0) @ poor
    assert np.abs(gradient / len(good) / len(poor) - 1e-3 * model.weights).max() < 2e-3
    assert abs(model.threshold - np.quantile(z @ model.weights, (y == 0).mean())) < 1e-6
