"""Array kernels (NumPy only): total-variation tracks, hidden Markov blocks, local regression."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

import numpy as np


def tv_solve(y: np.ndarray, w: np.ndarray, lam: np.ndarray, pull: tuple[float, float] = (0.0, 0.0)) -> np.ndarray:
    """argmin of 1/2 sum w (y - x)^2 + sum lam |x[i+1] - x[i]| - pull[0] x[0] - pull[1] x[-1], exactly.

    Dynamic programming over the derivative of the forward message, which is
    piecewise linear and non-decreasing (Johnson 2013), with one penalty for each
    edge.  Zero weights count as 1e-12 of the median weight.
    """
    n = len(y)
    w = np.asarray(w, dtype=float)
    positive = w[w > 0]
    w = np.maximum(w, 1e-12 * (np.median(positive) if len(positive) else 1.0))
    drawn = w * np.asarray(y, float)
    drawn[0] += pull[0]
    drawn[-1] += pull[1]
    if n == 1:
        return drawn / w
    wys, ws, ls = drawn.tolist(), w.tolist(), np.asarray(lam, float).tolist()
    low, high = [0.0] * (n - 1), [0.0] * (n - 1)
    knots: deque[tuple[float, float, float]] = deque()  # place, change of slope, change of intercept
    slope, left, right = ws[0], -wys[0], -wys[0]
    sl = sr = slope
    for k in range(n - 1):
        lk = ls[k]
        while knots and sl * knots[0][0] + left < -lk:
            x, ds, di = knots.popleft()
            sl, left = sl + ds, left + di
        low[k] = (-lk - left) / sl
        cut_s, cut_i = sl, left
        while knots and sr * knots[-1][0] + right > lk:
            x, ds, di = knots.pop()
            sr, right = sr - ds, right - di
        high[k] = (lk - right) / sr
        knots.appendleft((low[k], cut_s, cut_i + lk))
        knots.append((high[k], -sr, lk - right))
        wk, iy = ws[k + 1], -wys[k + 1]
        sl, left, sr, right = wk, iy - lk, wk, iy + lk
    while knots and sl * knots[0][0] + left < 0:
        x, ds, di = knots.popleft()
        sl, left = sl + ds, left + di
    out = [0.0] * n
    out[-1] = value = -left / sl
    for k in range(n - 2, -1, -1):
        value = min(max(value, low[k]), high[k])
        out[k] = value
    return np.array(out)


def tv_bracket(y: np.ndarray, w: np.ndarray, lam: np.ndarray, ends: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the solution inside a longer chain, from a part of it.

    What lies beyond an end can pull on it with at most that edge's penalty (``ends``), and a stronger pull upwards never lowers
    any value; so the solutions under both extreme pulls hold the chain's own between them, and where they agree
    they are it.
    """
    return tv_solve(y, w, lam, (-ends[0], -ends[1])), tv_solve(y, w, lam, ends)


def debias(theta: np.ndarray, y: np.ndarray, w: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """Each constant segment's weighted mean of ``y``; a segment without weight keeps its mean level."""
    start = np.flatnonzero(np.append(True, np.abs(np.diff(theta)) > tol))
    size = np.diff(np.append(start, len(theta)))
    sw = np.add.reduceat(w, start)
    swy, plain = np.add.reduceat(w * y, start), np.add.reduceat(theta, start) / size
    return np.repeat(np.where(sw > 0, swy / np.where(sw > 0, sw, 1), plain), size)


def tv_denoise(y: np.ndarray, w: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """The de-biased piecewise-constant track."""
    return debias(tv_solve(y, w, lam), y, w)


def penalty(pos: np.ndarray, lam0: float, decay: float, w: np.ndarray, floor: float = 0.0) -> np.ndarray:
    """Edge penalties that fall with distance, scaled by the median positive weight."""
    positive = w[w > 0]
    scale = float(np.median(positive)) if len(positive) else 1.0
    return np.maximum(lam0 * scale * np.exp(-np.diff(pos) / decay), floor)


def segments(theta: np.ndarray, beta: np.ndarray, w: np.ndarray, min_probes: int, min_effect: float, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, effect, z) of the runs of constant ``theta`` with enough probes, weight and precision-weighted effect."""
    first = np.flatnonzero(np.append(True, np.abs(np.diff(theta)) > tol))
    n = np.diff(np.append(first, len(theta)))
    sw, swb = np.add.reduceat(w, first), np.add.reduceat(w * beta, first)
    effect = np.divide(swb, sw, out=np.zeros_like(sw), where=sw > 0)
    keep = (n >= min_probes) & (sw > 0) & (np.abs(effect) >= min_effect)
    first, n, effect, sw = first[keep], n[keep], effect[keep], sw[keep]
    return first, first + n - 1, effect, effect * np.sqrt(sw)


@dataclass
class BlockModel:
    """Three states; the neutral one has mean zero."""

    mu: np.ndarray
    sigma: np.ndarray
    pi: np.ndarray
    length_scale: float
    neutral: int = 1
    loglik: float = float("-inf")
    rounds: int = 0
    posterior: np.ndarray = field(default_factory=lambda: np.empty((0, 3)))


def transitions(distance: float, pi: np.ndarray, length_scale: float) -> np.ndarray:
    stay = np.exp(-distance / length_scale)
    return stay * np.eye(len(pi)) + (1 - stay) * np.tile(pi, (len(pi), 1))


def emissions(y: np.ndarray, se: np.ndarray, model: BlockModel) -> np.ndarray:
    """Densities of every cluster's effect under each state, floored."""
    var = model.sigma[None, :] ** 2 + se[:, None] ** 2
    return np.maximum(np.exp(-0.5 * (y[:, None] - model.mu) ** 2 / var) / np.sqrt(2 * np.pi * var), 1e-300)


def stays(gap: np.ndarray, length_scale: float) -> np.ndarray:
    """How surely the state goes on over each gap; 0 where there is no cluster before (a NaN gap), so that a chromosome begins at pi."""
    return np.where(np.isnan(gap), 0.0, np.exp(-np.nan_to_num(gap) / length_scale))


def _rows(b: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The steps of a piece as rows of about as many steps as there are rows; steps that do nothing fill the last one."""
    n = len(stay)
    wide = max(1, math.isqrt(n))
    k = -(-n // wide)
    full_b, full_s = np.ones((k * wide, b.shape[1])), np.ones(k * wide)
    full_b[:n], full_s[:n] = b, stay
    return full_b.reshape(k, wide, -1), full_s.reshape(k, wide)


def _row_products(b: np.ndarray, stay: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(product of each row's step operators, scaled to a largest entry of 1, the logarithm of the scale).

    A step maps a row vector a to (stay a + (1 - stay) sum(a) pi) b; all rows go one step at a time.
    """
    k, wide, states = b.shape
    out, scale = np.tile(np.eye(states), (k, 1, 1)), np.zeros(k)
    for t in range(wide):
        s = stay[:, t, None, None]
        out = (s * out + (1 - s) * out.sum(axis=2, keepdims=True) * pi) * b[:, t, None, :]
        top = out.max(axis=(1, 2), keepdims=True)
        out /= top
        scale += np.log(top[:, 0, 0])
    return out, scale


def piece_operator(b: np.ndarray, stay: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, float]:
    """The product of all step operators of a piece, scaled, and the logarithm of its scale: all that other pieces need of it."""
    rows, scale = _row_products(*_rows(b, stay), pi)
    total, log = np.eye(len(pi)), float(scale.sum())
    for m in rows:
        total = total @ m
        top = total.max()
        total, log = total / top, log + math.log(top)
    return total, log


def piece_posterior(b: np.ndarray, stay: np.ndarray, pi: np.ndarray, entering: np.ndarray, leaving: np.ndarray) -> tuple[np.ndarray, float]:
    """(posteriors, log likelihood) of a piece between the forward vector that enters it (sum 1) and the backward one of its end.

    Rows' products give what enters and leaves every row; then all rows go through their steps side by side.
    """
    n, rb, rs = len(stay), *_rows(b, stay)
    products, _ = _row_products(rb, rs, pi)
    k, wide, states = rb.shape
    into, out = np.empty((k, states)), np.empty((k, states))
    a, z = entering, leaving
    for i in range(k):
        into[i] = a
        a = a @ products[i]
        a = a / a.sum()
        out[k - 1 - i] = z
        z = products[k - 1 - i] @ z
        z = z / z.max()
    alpha, log = np.empty_like(rb), 0.0
    for t in range(wide):
        s = rs[:, t, None]
        into = (s * into + (1 - s) * into.sum(axis=1, keepdims=True) * pi) * rb[:, t]
        scale = into.sum(axis=1, keepdims=True)
        into = into / scale
        alpha[:, t] = into
        log += float(np.log(scale).sum())
    beta = np.empty_like(rb)
    for t in range(wide - 1, -1, -1):
        beta[:, t] = out
        v = rb[:, t] * out
        s = rs[:, t, None]
        out = s * v + (1 - s) * (v @ pi)[:, None]
        out = out / out.max(axis=1, keepdims=True)
    g = (alpha * beta).reshape(k * wide, states)[:n]
    return g / g.sum(axis=1, keepdims=True), log


def forward_backward(y: np.ndarray, se: np.ndarray, pos: np.ndarray, model: BlockModel) -> tuple[np.ndarray, float]:
    """Posterior of the states of one chromosome's clusters, and its log likelihood."""
    stay = stays(np.append(np.nan, np.diff(pos.astype(float))), model.length_scale)
    return piece_posterior(emissions(y, se, model), stay, model.pi, model.pi, np.ones(len(model.pi)))


def first_model(q05: float, spread: float, q95: float, length_scale: float) -> BlockModel:
    """Start values from the 5 % and 95 % quantiles and the spread."""
    wide = max(spread, 1e-3)
    return BlockModel(np.array([min(q05, -1e-3), 0.0, max(q95, 1e-3)]), np.array([wide, wide / 2, wide]), np.array([0.05, 0.90, 0.05]), length_scale)


def maximise(model: BlockModel, sums: np.ndarray) -> BlockModel:
    """New parameters from the sums of g, g*y, g*y^2 and g*se^2 (rows) for each state (columns)."""
    g, gy, gyy, gs = sums
    mu = np.where(g > 0, gy / np.maximum(g, 1e-300), model.mu)
    mu[model.neutral] = 0.0
    var = (gyy - 2 * mu * gy + mu**2 * g - gs) / np.maximum(g, 1e-300)
    pi = np.maximum(g / g.sum(), 1e-6)
    return BlockModel(mu, np.sqrt(np.maximum(var, 1e-8)), pi / pi.sum(), model.length_scale, model.neutral)


def sufficient(g: np.ndarray, y: np.ndarray, se: np.ndarray) -> np.ndarray:
    return np.stack([g.sum(axis=0), (g * y[:, None]).sum(axis=0), (g * y[:, None] ** 2).sum(axis=0), (g * se[:, None] ** 2).sum(axis=0)])


def settled(before: float, after: float, tol: float = 1e-5) -> bool:
    return np.isfinite(before) and abs(after - before) < tol * max(1.0, abs(before))


def ordered_states(model: BlockModel) -> tuple[BlockModel, np.ndarray]:
    """The model with states by rising mean, and the permutation."""
    order = np.argsort(model.mu, kind="stable")
    return BlockModel(model.mu[order], model.sigma[order], model.pi[order], model.length_scale, int(np.flatnonzero(order == model.neutral)[0]), model.loglik, model.rounds), order


def state_labels(neutral: int, states: int = 3) -> list[str]:
    """hypo, neutral, hyper by rising mean; states that share a side get their column's number."""
    side = ["hypo" if k < neutral else "neutral" if k == neutral else "hyper" for k in range(states)]
    return [s if side.count(s) == 1 else f"{s}_s{k}" for k, s in enumerate(side)]


def local_linear(pos: np.ndarray, y: np.ndarray, w: np.ndarray, span: float, pairs: int = 2_000_000) -> np.ndarray:
    """Tricube-weighted local linear fit at every position, of one series or of the columns of ``y``.

    All neighbours within ``span`` take part; ``pairs`` is how many (position,
    neighbour) pairs are worked on at a time, not a limit on them.
    """
    y = np.asarray(y, float)
    many = y if y.ndim == 2 else y[:, None]
    lo, hi = np.searchsorted(pos, pos - span), np.searchsorted(pos, pos + span, side="right")
    out, upto = np.empty_like(many), np.cumsum(hi - lo)
    at = 0
    while at < len(pos):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + pairs, side="right")))
        n = (hi - lo)[at:end]
        begin = np.cumsum(n) - n
        near = np.repeat(lo[at:end] - begin, n) + np.arange(int(n.sum()))
        d = (pos[near] - np.repeat(pos[at:end], n)).astype(float)
        k = np.clip(1 - (np.abs(d) / (span or 1)) ** 3, 0, None) ** 3 * w[near]
        s0, s1, s2 = (np.add.reduceat(v, begin) for v in (k, k * d, k * d * d))
        det = s0 * s2 - s1 * s1
        sound = det > 1e-9 * s0 * np.maximum(s2, 1e-300)
        for c in range(many.shape[1]):
            own = many[near, c]
            t0, t1 = np.add.reduceat(k * own, begin), np.add.reduceat(k * d * own, begin)
            line = (s2 * t0 - s1 * t1) / np.where(sound, det, 1)
            out[at:end, c] = np.where(s0 <= 0, many[at:end, c], np.where(sound, line, t0 / np.where(s0 > 0, s0, 1)))
        at = end
    return out if y.ndim == 2 else out[:, 0]


def nearest_windows(pos: np.ndarray, near: int) -> np.ndarray:
    """Where the ``near`` nearest points of every position begin, for rows of rising positions; of equally far ends the left one stays."""
    k, n = pos.shape
    at, row = np.tile(np.arange(n), (k, 1)), np.arange(k)[:, None]
    lo, hi = np.maximum(at - near + 1, 0), np.minimum(at, n - near)
    lo = np.minimum(lo, hi)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        right = (lo < hi) & (pos[row, np.minimum(mid + near, n - 1)] - pos < pos - pos[row, mid])
        lo, hi = np.where(right, mid + 1, lo), np.where(right | (lo >= hi), hi, mid)
    return lo


def lowess(pos: np.ndarray, y: np.ndarray, near: int, rounds: int = 3, pairs: int = 4_000_000) -> np.ndarray:
    """Robust local lines through the ``near`` nearest points of every position, for each column of ``y``.

    ``pos``: clusters of one size by positions (rising), ``y``: clusters by positions by series.  Weights are tricube in
    the distance over that of the farthest of the ``near`` points; then ``rounds`` times bisquare in the residual over six
    times the median absolute one, so that an outlier does not bend the line.  ``pairs`` bounds the work at a time.
    """
    k, n, series = y.shape
    if not k or not n:
        return y.astype(float)
    near = min(near, n)
    first = (nearest_windows(pos, near) + n * np.arange(k)[:, None]).ravel()
    flat, own = pos.astype(float).ravel(), y.astype(float).reshape(k * n, series)
    robust, fit = np.ones_like(own), np.empty_like(own)
    step = max(1, pairs // (near * series))
    for turn in range(rounds + 1):
        for a in range(0, k * n, step):
            at = first[a : a + step, None] + np.arange(near)
            d = flat[at] - flat[a : a + step, None]
            widest = np.abs(d).max(axis=1, keepdims=True)
            tri = np.where(widest > 0, np.clip(1 - np.abs(d / np.where(widest > 0, widest, 1)) ** 3, 0, None) ** 3, 1.0)
            w, v, dx = tri[..., None] * robust[at], own[at], d[..., None]
            s0, s1, s2 = w.sum(axis=1), (w * dx).sum(axis=1), (w * dx * dx).sum(axis=1)
            t0, t1 = (w * v).sum(axis=1), (w * dx * v).sum(axis=1)
            det = s0 * s2 - s1 * s1
            sound = det > 1e-9 * s0 * np.maximum(s2, 1e-300)
            line = (s2 * t0 - s1 * t1) / np.where(sound, det, 1)
            fit[a : a + step] = np.where(s0 <= 0, own[a : a + step], np.where(sound, line, t0 / np.where(s0 > 0, s0, 1)))
        if turn < rounds:
            left = np.abs(own - fit).reshape(k, n, series)
            scale = 6 * np.median(left, axis=1, keepdims=True)
            robust = np.where(scale > 1e-300, np.clip(1 - (left / np.where(scale > 1e-300, scale, 1)) ** 2, 0, None) ** 2, 1.0).reshape(k * n, series)
    return fit.reshape(k, n, series)


def span_of(pos: np.ndarray, reach: float, widest: float = 1.0) -> float:
    """The share of a cluster's points that ``reach`` base pairs hold at its median spacing, ``widest`` at most."""
    gap = float(np.median(np.diff(pos))) if len(pos) > 1 else 0.0
    return min(widest, reach / gap / len(pos)) if gap > 0 else widest


def background_signal(x: np.ndarray, mu: float, sigma: float, alpha: float) -> np.ndarray:
    """Expected signal of x = signal + noise, signal exponential with mean alpha, noise normal (mu, sigma)."""
    m = x - mu - sigma**2 / alpha
    z = m / sigma
    density = np.exp(-0.5 * z * z) / np.sqrt(2 * np.pi)
    tail = 0.5 * np.vectorize(math.erfc, otypes=[float])(-z / math.sqrt(2))
    return np.where(tail > 1e-300, m + sigma * density / np.maximum(tail, 1e-300), 1e-6)
