"""Training of the log-bilinear model against its plain formulas, and what it costs beside them."""

import os
import subprocess
import sys
import time
from pathlib import Path

import numpy as np

from quarrykit.llm import lbl, lm_scoring


def logistic(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def summed(rows, at, places):
    out, width = np.zeros(places * rows.shape[1], dtype=np.float32), rows.shape[1]
    np.add.at(out, (at[:, None] * width + np.arange(width)).ravel(), rows.ravel())
    return out.reshape(places, width)


def plain_step(model, name, g, rate):
    state = model.squares[name]
    state += np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])
    getattr(model, name)[:] += g * (np.float32(rate) / np.sqrt(state))[:, None]


def plain_train(model, u, v, unit, slot, rng):
    """The gradients as they are written down: of both factors, row by row."""
    model.squares = {k: np.full(len(x), lbl.SQUARE) for k, x in model.tables.items()}
    noise_p, cumulative = np.log(model.unigram * lbl.NOISE).astype(np.float32), np.cumsum(model.unigram)
    for s in range(0, len(unit), lbl.BATCH):
        x, y, w = (a[s : s + lbl.BATCH] for a in (u, v, unit))
        k = np.minimum(np.searchsorted(cumulative, rng.random(lbl.NOISE)), len(cumulative) - 1)
        rx, ry, q, qk = model.r[x], model.r[y], model.q[w], model.q[k]
        p = np.concatenate([model.c[0] * rx + model.c[1] * ry, np.ones((len(w), 1), dtype=np.float32)], axis=1)
        dp, dn = 1 - logistic(np.einsum("ij,ij->i", p, q) - noise_p[w]), logistic(p @ qk.T - noise_p[k])
        gp, scale = (dp[:, None] * q - dn @ qk)[:, : lbl.DIM], np.float32(len(w) ** -0.5)
        plain_step(model, "q", summed(np.concatenate([(dp * scale)[:, None] * p, dn.T @ (p * -scale)]), np.concatenate([w, k]), len(model.q)), lbl.RATE)
        plain_step(model, "r", summed(np.concatenate([gp * (model.c[0] * scale), gp * (model.c[1] * scale)]), np.concatenate([x, y]), len(model.r)), lbl.RATE)
        plain_step(model, "c", np.stack([(gp * rx).sum(axis=0), (gp * ry).sum(axis=0)]) * scale, lbl.RATE)
    for at, a, b in model._classes(unit, slot):
        t, ratio = model.t[a:b], (lbl.CLASS_NOISE * model.share[a:b]).astype(np.float32)
        state, log_ratio = model.squares["t"][a:b], np.log(ratio)
        for s in range(0, len(at), lbl.CLASS_BATCH):
            k = at[s : s + lbl.CLASS_BATCH]
            rx, ry, own = model.r[u[k]], model.r[v[k]], (np.arange(len(k)), slot[k] - a)
            p = np.concatenate([model.d[0] * rx + model.d[1] * ry, np.ones((len(k), 1), dtype=np.float32)], axis=1)
            sure = logistic(p @ t.T - log_ratio)
            error = sure * -ratio
            error[own] += 1 - sure[own]
            gp, g = (error @ t)[:, : lbl.DIM], error.T @ p
            state += np.einsum("ij,ij->i", g, g) / np.float32(lbl.DIM + 1)
            t += (np.float32(lbl.CLASS_RATE) / np.sqrt(state))[:, None] * g
            plain_step(model, "d", np.stack([(gp * rx).sum(axis=0), (gp * ry).sum(axis=0)]) * np.float32(len(k) ** -0.5), lbl.RATE)


def case(n, heads=1000, classes=40, per=100):
    rng = np.random.default_rng(1)
    word = np.minimum(rng.zipf(1.2, n), heads + classes * per) - 1
    unit, slot = np.where(word < heads, word, heads + word % classes), np.where(word < heads, -1, word % classes * per + (word - heads) // classes)
    units, first = np.bincount(unit, minlength=heads + classes + 1).astype(float), np.arange(classes + 1) * per
    model = lbl.Model.fresh(units, first, np.bincount(slot[slot >= 0], minlength=classes * per).astype(float))
    start = len(units)
    two, one = np.concatenate([[start, start], unit[:-2]]), np.concatenate([[start], unit[:-1]])
    return model, (two, one, unit, slot)


def test_training_is_by_the_plain_formulas():
    model, tokens = case(30_000)
    plain = model.copy()
    plain_train(plain, *tokens, np.random.default_rng(5))
    model.train(*tokens, np.random.default_rng(5))
    start = case(30_000)[0]
    for name, x in plain.tables.items():
        moved = np.abs(x - start.tables[name]).max()
        assert moved > 0.01 and np.abs(model.tables[name] - x).max() < 1e-3 * moved, name
        assert np.allclose(model.squares[name], plain.squares[name], rtol=1e-3)


def cost():
    """CPU seconds of training by the plain formulas over those of the model's own: the best of a few runs."""
    model, tokens = case(150_000)
    times = []
    for _ in range(4):
        for train in (plain_train, lbl.Model.train):
            now, at = model.copy(), time.process_time()
            train(now, *tokens, np.random.default_rng(5))
            times.append(time.process_time() - at)
    return min(times[::2]) / min(times[1::2])


def test_training_costs_less_than_the_plain_formulas():
    env = os.environ | {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1", "PYTHONPATH": str(Path(__file__).parents[2])}
    out = subprocess.run([sys.executable, "-c", "from tests.llm.test_lm_training import cost; print(cost())"], env=env, capture_output=True, text=True, check=True, timeout=300)
    assert float(out.stdout) > 1.3


def test_a_shard_may_end_with_a_run():
    ids, first = lm_scoring._decoded([])
    two, one = lm_scoring._contexts(ids, first, 3)
    assert len(ids) == len(two) == len(one) == 0
    texts = [np.array(x, dtype=np.int32) for x in ([1, 70_000, 5], [5], [2, 1 << 30, 5])]
    ids, first = lm_scoring._decoded([lm_scoring._packed(x) for x in texts])
    assert ids.tolist() == np.concatenate(texts).tolist() and first.tolist() == [0, 3, 4, 7]
