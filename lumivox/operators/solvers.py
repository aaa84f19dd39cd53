"""Linear models over blocks of rows: every function takes a (rows, n) matrix of right-hand sides.

Plain numpy inside tasks; Spark partitions the rows. Rows that have converged
leave the block, so a block costs as much as its slow rows need.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


SIDE_BY_SIDE = 256  # rows whose active sets are followed together


class Tikhonov:
    """min |M c - s|^2 + weights . c^2: one matrix, factored once."""

    def __init__(self, m: np.ndarray, weights: np.ndarray):
        self.inverse = np.linalg.solve(m.T @ m + np.diag(weights), m.T)

    def fit(self, s: np.ndarray) -> np.ndarray:
        return s @ self.inverse.T


@dataclass
class Lasso:
    """min |M c - s|^2 / (2 n) + alpha |c|_1 by accelerated proximal steps, with restarts per row."""

    m: np.ndarray
    max_iter: int = 1000
    tol: float = 1e-6
    positive: bool = False

    def __post_init__(self):
        n = len(self.m)
        self.gram, self.n = self.m.T @ self.m / n, n
        self.step = 1 / max(np.linalg.norm(self.m, 2) ** 2 / n, 1e-300)

    def alpha_max(self, s: np.ndarray) -> np.ndarray:
        """The least alpha of each row at which all coefficients are 0."""
        c = s @ self.m / self.n
        return np.max(c if self.positive else np.abs(c), axis=1).clip(min=0)

    def fit(self, s: np.ndarray, alpha: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and iterations of each row."""
        c = np.zeros((len(s), self.m.shape[1])) if start is None else start.copy()
        y, t, used, b = c.copy(), np.ones(len(s)), np.zeros(len(s), np.int32), s @ self.m / self.n
        live, cut = np.arange(len(s)), (np.broadcast_to(alpha, len(s)) * self.step)[:, None]
        for k in range(self.max_iter):
            v = y[live] - self.step * (y[live] @ self.gram - b[live])
            new = np.maximum(v - cut[live], 0) if self.positive else np.sign(v) * np.maximum(np.abs(v) - cut[live], 0)
            change = new - c[live]
            # momentum is dropped where it points away from the step just taken
            back = np.sum((y[live] - new) * change, axis=1) > 0
            t_new = np.where(back, 1.0, (1 + np.sqrt(1 + 4 * t[live] ** 2)) / 2)
            y[live] = new + np.where(back, 0, (t[live] - 1) / t_new)[:, None] * change
            c[live], t[live], used[live] = new, t_new, k + 1
            done = np.linalg.norm(change, axis=1) <= self.tol * np.maximum(np.linalg.norm(new, axis=1), 1e-12)
            live = live[~done]
            if not len(live):
                break
        return c, used


def log_path(top: np.ndarray, n: int = 20, eps: float = 1e-3) -> np.ndarray:
    """(rows, n) values from `top` down to eps times it, evenly spaced in the logarithm."""
    return np.asarray(top)[:, None] * np.exp(np.linspace(0, np.log(eps), n))[None]


def bic(rss: np.ndarray, n: int, k: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(rss, np.finfo(float).tiny) / n) + np.log(n) * k


def lasso_path(solver: Lasso, s: np.ndarray, n: int = 20, eps: float = 1e-3, rule: str = "bic", slack: float = 0.05, rss_l2: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Each row's pick along its path, warm-started from one alpha to the next.

    bic: the first least criterion, so ties go to the larger alpha. l2: the
    largest alpha whose residual is within 1 + slack of rss_l2's, or else the
    one of least residual. Rows of zeros get zeros.
    """
    top = solver.alpha_max(s)
    path, c = log_path(top, n, eps), np.zeros((len(s), solver.m.shape[1]))
    best = {k: np.full(len(s), np.inf) for k in ("score", "alpha", "bic", "rss")}
    coef, iterations, settled = np.zeros_like(c), np.zeros(len(s), np.int32), np.zeros(len(s), bool)
    for k in range(n):
        c, used = solver.fit(s, path[:, k], c)
        iterations += used
        rss = np.sum((s - c @ solver.m.T) ** 2, axis=1)
        criterion = bic(rss, solver.n, np.count_nonzero(c, axis=1))
        fits = rss <= (1 + slack) * rss_l2 if rule == "l2" else np.zeros(len(s), bool)
        take = ~settled & (fits | ((criterion if rule == "bic" else rss) < best["score"]))
        best["score"][take] = (criterion if rule == "bic" else rss)[take]
        for name, v in (("alpha", path[:, k]), ("bic", criterion), ("rss", rss)):
            best[name][take] = v[take]
        coef[take] = c[take]
        settled |= fits
    zero = top <= 0
    coef[zero] = 0
    return {"coef": coef, "alpha": np.where(zero, 0, best["alpha"]), "bic": best["bic"], "rss": best["rss"], "iterations": iterations}


class Inequality:
    """min |H x - b|^2 / 2 + ridge subject to C x >= 0, by active sets in the dual.

    All rows are solved without constraints at once; those that violate one get
    non-negative multipliers on the small dual problem, a constraint at a time.
    """

    def __init__(self, h: np.ndarray | None, c: np.ndarray, ridge: np.ndarray | float = 0.0, epsilon: float = 1e-10, max_iter: int = 200, tol: float = 1e-10, gram: np.ndarray | None = None):
        g = h.T @ h if gram is None else gram
        g = g + epsilon * np.eye(len(g)) + (np.diag(ridge) if np.ndim(ridge) else ridge * np.eye(len(g)))
        self.h, self.c, self.max_iter, self.tol = h, c, max_iter, tol
        self.inverse = np.linalg.inv(g)
        self.spread = self.inverse @ c.T  # what a multiplier adds to x
        self.dual = c @ self.spread

    def solve(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x, iterations and whether converged, by row of b."""
        return self.solve_moments(b @ self.h)

    def solve_moments(self, moments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same from the rows H' b."""
        x = moments @ self.inverse
        low = (x @ self.c.T).min(axis=1)
        used, ok = np.zeros(len(x), np.int32), np.ones(len(x), bool)
        hard = np.flatnonzero(low < -self.tol * np.maximum(1, np.abs(x).max(axis=1)))
        for some in (hard[at : at + SIDE_BY_SIDE] for at in range(0, len(hard), SIDE_BY_SIDE)):
            multipliers, used[some], ok[some] = self._multipliers(-(x[some] @ self.c.T))
            x[some] += multipliers @ self.spread.T
        return x, used, ok

    def _multipliers(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """min l' K l / 2 - q' l over l >= 0, by row of q.

        Rows go side by side, each through active sets of its own, and leave when they are done.
        """
        l, active = np.zeros(q.shape), np.zeros(q.shape, bool)
        used, ok = np.zeros(len(q), np.int32), np.zeros(len(q), bool)
        scale = np.maximum(1.0, np.abs(q).max(axis=1))
        going, settled = np.arange(len(q)), np.ones(len(q), bool)  # settled: l solves the active set, so a constraint may enter it
        while True:
            ask = going[settled[going]]
            slack = np.where(active[ask], -np.inf, q[ask] - l[ask] @ self.dual.T)
            worst = slack.argmax(axis=1)
            fine, spent = slack[np.arange(len(ask)), worst] <= self.tol * scale[ask], used[ask] >= self.max_iter
            ok[ask] = fine & ~spent
            more = ~(fine | spent)
            active[ask[more], worst[more]] = True
            used[ask] += more
            settled[ask[more]] = False
            going = going[~settled[going]]
            if not len(going):
                return l, used, ok
            row, of = np.nonzero(active[going])
            n = np.bincount(row, minlength=len(going))
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at, there = np.zeros((len(going), n.max()), np.int64), np.zeros((len(going), n.max()), bool)
            at[row, place], there[row, place] = of, True
            k_at = np.where(there[:, :, None] & there[:, None, :], self.dual[at[:, :, None], at[:, None, :]], 0.0)
            d = np.arange(n.max())
            k_at[:, d, d] = np.where(there, k_at[:, d, d] * (1 + 1e-11), 1.0)  # more constraints than unknowns may meet in a corner
            z = np.linalg.solve(k_at, np.where(there, q[going[:, None], at], 0.0)[:, :, None])[:, :, 0]
            bad, now = there & (z <= 0), l[going[:, None], at]
            done, gap = ~bad.any(axis=1), now - z
            t = np.where(bad & (gap > 0), now / np.where(gap > 0, gap, 1), np.inf).min(axis=1, initial=1.0)
            new = np.where(done[:, None], z, now - t[:, None] * gap)
            gone = bad & (new <= 1e-14 * scale[going, None])
            none = np.flatnonzero(~done & ~gone.any(axis=1))
            gone[none, np.where(there[none], z[none], np.inf).argmin(axis=1)] = True
            l[going[row], of] = np.where(gone, 0.0, new)[row, place]
            active[going[row], of] = ~gone[row, place]
            settled[going] = done | ~(there & ~gone).any(axis=1)


def soft_constrained(h: np.ndarray, b: np.ndarray, penalty: np.ndarray, threshold: float = 0.0, weight: float = 1.0, max_iter: int = 50, epsilon: float = 1e-10) -> tuple[np.ndarray, int]:
    """One row: amplitudes below the threshold are penalised until the set of those, or its size, repeats."""
    g, rhs = h.T @ h + epsilon * np.eye(h.shape[1]), h.T @ b
    x, before = np.linalg.solve(g, rhs), None
    for k in range(max_iter):
        low = penalty @ x < threshold
        if before is not None and ((low == before).all() or low.sum() == before.sum()):
            return x, k
        before = low
        x = np.linalg.solve(g + weight * penalty[low].T @ penalty[low], rhs)
    return x, max_iter


def weighted_ls(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of min sum w (y - X b)^2, and which have a positive definite system."""
    g = np.einsum("vn,ni,nj->vij", w, x, x)
    d = np.arange(x.shape[1])
    g[:, d, d] *= 1 + 1e-12
    rhs = np.einsum("vn,ni,vn->vi", w, x, y)
    top = g[:, d, d].max(axis=1)
    scale = 1 / np.sqrt(np.maximum(g[:, d, d], 1e-300))
    unit = g * scale[:, :, None] * scale[:, None, :]
    ok = (top > 0) & np.isfinite(unit).all(axis=(1, 2))
    ok[ok] = np.linalg.eigvalsh(unit[ok])[:, 0] > 1e-13
    out = np.zeros_like(rhs)
    out[ok] = np.linalg.solve(unit[ok], (rhs * scale)[ok][:, :, None])[:, :, 0] * scale[ok]
    return out, ok


def tensor_design(bvals: np.ndarray, g: np.ndarray) -> np.ndarray:
    x, y, z = g.T
    return np.stack([np.ones(len(g)), -bvals * x * x, -bvals * y * y, -bvals * z * z, -2 * bvals * x * y, -2 * bvals * x * z, -2 * bvals * y * z], axis=1)


def robust_tensor(s: np.ndarray, x: np.ndarray, max_iter: int = 50, tol: float = 1e-6, outlier: float = 0.04, least: float = 1e-6) -> dict[str, np.ndarray]:
    """Log-linear tensor fits with weights S^2, reweighted by Geman-McClure until the tensor settles.

    The noise level of a row is 1.4826 times the upper median of its absolute
    log residuals. A row without a definite system gets zeros. tensor: xx, xy, xz, yy, yz, zz.
    """
    s = np.maximum(s, least)
    y, w = np.log(s), s * s
    beta, ok = weighted_ls(x, y, w)
    used, done, robust = np.zeros(len(s), np.int32), np.zeros(len(s), bool), np.ones_like(s)
    live = np.flatnonzero(ok)
    for k in range(max_iter):
        if not len(live):
            break
        r = y[live] - beta[live] @ x.T
        sigma = np.maximum(1.4826 * np.sort(np.abs(r), axis=1)[:, s.shape[1] // 2], 1e-10)[:, None]
        robust[live] = (sigma**2 / (sigma**2 + r * r)) ** 2
        new, fine = weighted_ls(x, y[live], w[live] * robust[live])
        ok[live[~fine]] = False
        change = np.linalg.norm(new[:, 1:] - beta[live, 1:], axis=1) / np.maximum(np.linalg.norm(new[:, 1:], axis=1), 1e-12)
        beta[live], used[live] = new, k + 1
        done[live] = change < tol
        live = live[fine & ~done[live]]
    b = beta
    tensor = np.stack([b[:, 1], b[:, 4], b[:, 5], b[:, 2], b[:, 6], b[:, 3]], axis=1)
    values, vectors = np.linalg.eigh(tensor[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3))
    md = values.mean(axis=1)
    fa = np.sqrt(1.5 * ((values - md[:, None]) ** 2).sum(axis=1) / np.maximum((values**2).sum(axis=1), 1e-30)).clip(0, 1)
    out = {"s0": np.exp(b[:, 0]), "fa": fa, "md": md, "outlier_fraction": (robust < outlier).mean(axis=1), "tensor": tensor, "principal_dir": vectors[:, :, 2], "evals": values[:, ::-1], "iterations": used, "converged": done}
    for v in out.values():
        v[~ok] = 0
    return out
