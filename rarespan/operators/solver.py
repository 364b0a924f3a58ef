"""Weighted least squares of the gamma model for many curves at once.

Curves are rows of padded matrices. Each round takes one Levenberg-Marquardt step of every curve that is still open, with
the model's exact derivatives; the steps are the solutions of 2 x 2 systems in closed form. A curve leaves the rounds when
its residuals are orthogonal to the derivatives or vanish; steps too small to help without that are a failure,
and so is a way out of the range of models.
"""

from __future__ import annotations

import numpy as np

from rarespan.functions import gamma

#: Cosines of residuals and derivatives below which a fit has converged, and below which one that no step improves is accepted.
#: Shapes and rates between which a model is looked for: logarithms of efforts are below 100, so that beyond these the model is flat or a step.
LEAST, MOST = 1e-6, 1e5
ORTHOGONAL, NEARLY = 1e-7, 1e-4


def padded(curves: list[np.ndarray], fill: float) -> np.ndarray:
    """A row for each curve, filled up to the longest."""
    out = np.full((len(curves), max(map(len, curves), default=0)), fill)
    for i, c in enumerate(curves):
        out[i, : len(c)] = c
    return out


class Curves:
    """Effort, coverage and the root of the weight of each point; weight 0 where a row is filled up."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        self.x, self.y, self.root = x, y, np.sqrt(w)
        self.scale = (w * y * y).sum(axis=1)

    def state(self, rows: np.ndarray, at: np.ndarray):
        """(residuals, derivatives by the logarithms of a and b, cost) of some curves."""
        a, b = np.exp(at[:, 0])[:, None], np.exp(at[:, 1])[:, None]
        z, by_a, by_b = gamma.model_slopes(self.x[rows], a, b)
        r = self.root[rows] * (self.y[rows] - z)
        j = -self.root[rows][:, :, None] * np.stack([by_a * a, by_b * b], axis=2)
        return r, j, (r * r).sum(axis=1)

    def cost(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        r = self.root[rows] * (self.y[rows] - gamma.model(self.x[rows], np.exp(at[:, 0])[:, None], np.exp(at[:, 1])[:, None]))
        return (r * r).sum(axis=1)


def solve(x: np.ndarray, y: np.ndarray, w: np.ndarray, inside: np.ndarray, start=(1.0, 0.1), rounds: int = 1024) -> np.ndarray:
    """(curves, 2): a and b, NaN where a curve has less than three points, weights that are not numbers, or does not converge."""
    usable = (inside.sum(axis=1) >= 3) & np.isfinite(np.where(inside, w, 0.0)).all(axis=1) & (np.where(inside, w, 0.0) > 0).any(axis=1)
    usable &= np.isfinite(np.where(inside, x + y, 0.0)).all(axis=1)
    seen = inside & usable[:, None]
    curves = Curves(np.where(seen, x, 1.0), np.where(seen, y, 0.0), np.where(seen, w, 0.0))
    at, damping = np.tile(np.log(np.array(start)), (len(x), 1)), np.full(len(x), 1e-3)
    out, open_ = np.full((len(x), 2), np.nan), np.flatnonzero(usable)
    for _ in range(rounds):
        if not len(open_):
            break
        r, j, cost = curves.state(open_, at[open_])
        g, h = np.einsum("npk,np->nk", j, r), np.einsum("npk,npl->nkl", j, j)
        slope = (np.abs(g) / (np.sqrt(np.einsum("nkk->nk", h) * cost[:, None]) + 1e-300)).max(axis=1)
        finite = np.isfinite(cost) & np.isfinite(slope)
        done = finite & ((slope < ORTHOGONAL) | (cost <= 1e-18 * curves.scale[open_]))
        out[open_[done]] = np.exp(at[open_[done]])
        left = finite & ~done
        rows, g, h, slope, cost = open_[left], g[left], h[left], slope[left], cost[left]
        moved = step_down(curves, rows, at, damping, g, h, cost)
        stuck = ~moved & (slope < NEARLY)
        out[rows[stuck]] = np.exp(at[rows[stuck]])
        within = (at[rows] > np.log(LEAST)).all(axis=1) & (at[rows] < np.log(MOST)).all(axis=1)
        open_ = rows[moved & within]
    return out


def step_down(curves: Curves, rows: np.ndarray, at: np.ndarray, damping: np.ndarray, g: np.ndarray, h: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Moves each curve by the least damped step that lowers its cost; which ones moved. Changes at and damping."""
    moved, trying = np.zeros(len(rows), bool), np.arange(len(rows))
    while len(trying):
        d = damping[rows[trying]]
        p, q, s = h[trying, 0, 0], h[trying, 1, 1], h[trying, 0, 1]
        p, q = p + d * (p + 1e-12), q + d * (q + 1e-12)
        det = p * q - s * s
        with np.errstate(divide="ignore", invalid="ignore"):
            step = -np.stack([q * g[trying, 0] - s * g[trying, 1], p * g[trying, 1] - s * g[trying, 0]], axis=1) / det[:, None]
        sound = np.isfinite(step).all(axis=1)
        new = at[rows[trying]] + np.clip(np.where(sound[:, None], step, 0.0), -0.5, 0.5)
        better = sound & (curves.cost(rows[trying], new) < cost[trying])
        won, lost = trying[better], trying[~better]
        at[rows[won]], moved[won] = new[better], True
        damping[rows[won]] = np.maximum(damping[rows[won]] / 10, 1e-12)
        damping[rows[lost]] *= 10
        trying = lost[damping[rows[lost]] < 1e12]
    return moved
