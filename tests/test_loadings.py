import numpy as np

from lithoscope.operators.models import pls_loadings


def test_loadings_equal_deflation_of_the_data():
    """Components by deflating the rows themselves, up to the sign."""
    random = np.random.default_rng(1)
    x = random.normal(size=(90, 4)) @ random.normal(size=(4, 4))
    y = np.column_stack([x[:, 0] - x[:, 2], x[:, 1]]) + random.normal(size=(90, 2))
    m = np.column_stack([np.ones(90), x, y])
    got = {(side, name, a): v for side, name, a, v in pls_loadings(m.T @ m, list("abcd"), ["u", "v"], 3)}
    e, f = (x - x.mean(0)) / x.std(0), (y - y.mean(0)) / y.std(0)
    for a in (1, 2, 3):
        w = np.linalg.svd(e.T @ f)[0][:, 0]
        t = e @ w
        p, q = e.T @ t / (t @ t), f.T @ t / (t @ t)
        e, f = e - np.outer(t, p), f - np.outer(t, q)
        sign = np.sign(p[np.abs(p).argmax()])
        assert np.allclose([got["x", c, a] for c in "abcd"], sign * p) and np.allclose([got["y", c, a] for c in "uv"], sign * q)
