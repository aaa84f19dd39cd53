"""Special functions and bases on the driver, in numpy: tables that plans are built from and broadcast."""

from __future__ import annotations

import math

import numpy as np


def factorial(n: int) -> float:
    return math.gamma(n + 1.0)


gamma = math.gamma


def binomial(a: float, k: int) -> float:
    """The generalised binomial coefficient of a real a and an integer k."""
    return math.prod((a - i) / (i + 1) for i in range(k))


def legendre(l: int, m: int, x: np.ndarray) -> np.ndarray:
    """Associated Legendre function with the Condon-Shortley phase, m from 0 to l."""
    x = np.asarray(x, dtype=float)
    p = (-1.0) ** m * math.prod(range(1, 2 * m, 2)) * (1 - x * x) ** (m / 2)
    if l == m:
        return p
    below, p = p, x * (2 * m + 1) * p
    for k in range(m + 2, l + 1):
        below, p = p, (x * (2 * k - 1) * p - (k + m - 1) * below) / (k - m)
    return p


def laguerre(n: int, a: float, x: np.ndarray) -> np.ndarray:
    """Generalised Laguerre polynomial."""
    x = np.asarray(x, dtype=float)
    below, p = np.zeros_like(x), np.ones_like(x)
    for k in range(n):
        below, p = p, ((2 * k + 1 + a - x) * p - (k + a) * below) / (k + 1)
    return p


def hyp2f1(a: float, b: float, c: float, z: float, terms: int = 200) -> float:
    """The Gauss series, ended where a numerator becomes 0, terms get negligible or after `terms`."""
    total = term = 1.0
    for k in range(terms):
        term *= (a + k) * (b + k) / ((c + k) * (k + 1)) * z
        total += term
        if term == 0 or abs(term) < 1e-17 * abs(total):
            break
    return total


def sphere_angles(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, azimuth and polar angle of each row; both angles are 0 for a zero vector."""
    r = np.linalg.norm(v, axis=-1)
    safe = np.where(r > 0, r, 1)
    return r, np.where(r > 0, np.arctan2(v[..., 1], v[..., 0]), 0), np.where(r > 0, np.arccos(np.clip(v[..., 2] / safe, -1, 1)), 0)


def gauss_legendre(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights on [0, 1]."""
    x, w = np.polynomial.legendre.leggauss(n)
    return (x + 1) / 2, w / 2


# spherical harmonics: the real, even basis with index l (l + 1) / 2 + m


def n_sh(lmax: int) -> int:
    return (lmax + 1) * (lmax + 2) // 2


def sh_index(l: int, m: int) -> int:
    return l * (l + 1) // 2 + m


def sh_matrix(directions: np.ndarray, lmax: int) -> np.ndarray:
    """Rows of the basis at unit directions: root-two sines for negative orders, root-two cosines for positive ones, orthonormal, without phase."""
    _, azimuth, polar = sphere_angles(np.asarray(directions, dtype=float))
    x, out = np.cos(polar), np.zeros((len(directions), n_sh(lmax)))
    for l in range(0, lmax + 1, 2):
        for m in range(l + 1):
            norm = math.sqrt((2 * l + 1) / (4 * math.pi) * factorial(l - m) / factorial(l + m))
            p = norm * (-1.0) ** m * legendre(l, m, x)
            if m == 0:
                out[:, sh_index(l, 0)] = p
            else:
                out[:, sh_index(l, m)] = math.sqrt(2) * p * np.cos(m * azimuth)
                out[:, sh_index(l, -m)] = math.sqrt(2) * p * np.sin(m * azimuth)
    return out


def sh_degrees(lmax: int) -> np.ndarray:
    return np.concatenate([np.full(2 * l + 1, l) for l in range(0, lmax + 1, 2)])


def zonal_factor(lmax: int) -> np.ndarray:
    """sqrt(4 pi / (2 l + 1)) for each coefficient: a zonal response's part in a convolution."""
    return np.sqrt(4 * np.pi / (2 * sh_degrees(lmax) + 1))


def hemisphere(frequency: int = 8) -> np.ndarray:
    """Directions of a geodesic icosahedron, one of each antipodal pair: 5 f^2 + 1, so 321 at frequency 8.

    The orientation is our own choice: the icosahedron has two vertices on the z axis.
    """
    z, r = 1 / math.sqrt(5), 2 / math.sqrt(5)
    ring = lambda h, shift: [(r * math.cos(2 * math.pi * k / 5 + shift), r * math.sin(2 * math.pi * k / 5 + shift), h) for k in range(5)]
    v = np.array([(0, 0, 1), *ring(z, 0), *ring(-z, math.pi / 5), (0, 0, -1)], dtype=float)
    edge = min(np.linalg.norm(v[0] - p) for p in v[1:])
    near = np.linalg.norm(v[:, None] - v[None], axis=2) < edge * 1.1
    faces = [(a, b, c) for a in range(12) for b in range(a + 1, 12) for c in range(b + 1, 12) if near[a, b] and near[b, c] and near[a, c]]
    points = [v[a] * i + v[b] * j + v[c] * (frequency - i - j) for a, b, c in faces for i in range(frequency + 1) for j in range(frequency + 1 - i)]
    p = np.array(points)
    p /= np.linalg.norm(p, axis=1)[:, None]
    first = p[np.arange(len(p)), np.argmax(np.abs(np.round(p[:, ::-1], 9)) > 0, axis=1) * -1 + 2]
    p = p * np.sign(first)[:, None]
    _, keep = np.unique(np.round(p, 7) + 0.0, axis=0, return_index=True)
    return p[np.sort(keep)]


def hemisphere_edges(frequency: int = 8) -> np.ndarray:
    """Pairs of neighbours among hemisphere(frequency)'s directions: the edges of the whole triangulated sphere, antipodes being one.

    So a lobe that crosses the rim isn't cut in two.
    """
    dirs = hemisphere(frequency)
    step = 1.3 * math.acos(min(1.0, float(np.sort(np.abs(dirs @ dirs.T) - 2 * np.eye(len(dirs)), axis=1)[:, -1].min())))
    cos = np.abs(dirs @ dirs.T)
    np.fill_diagonal(cos, -1)
    six = np.argsort(-cos, axis=1)[:, :6]
    # a corner of the icosahedron has five neighbours, its sixth nearest direction is farther off
    pairs = {(min(i, int(j)), max(i, int(j))) for i in range(len(dirs)) for j in six[i] if i in six[j] and cos[i, j] > math.cos(step)}
    return np.array(sorted(pairs))


def quadrature(directions: np.ndarray) -> np.ndarray:
    """Weights under which sums over half a sphere's directions are integrals over the whole sphere, exact for even series up to the largest order that the directions determine."""
    lmax = 0
    while n_sh(lmax + 2) <= len(directions):
        lmax += 2
    want = np.zeros(n_sh(lmax))
    want[0] = math.sqrt(4 * math.pi)
    return np.linalg.lstsq(sh_matrix(directions, lmax).T, want, rcond=None)[0]


class SpherePolynomial:
    """An even harmonic series as a homogeneous polynomial of degree lmax in x, y and z, which has as many terms: its derivatives know no poles."""

    def __init__(self, lmax: int):
        self.lmax = lmax
        self.powers = np.array([(i, j, lmax - i - j) for i in range(lmax + 1) for j in range(lmax + 1 - i)])
        d = hemisphere(max(4, lmax))
        self.of = np.linalg.lstsq(self._terms(d, (0, 0, 0)), sh_matrix(d, lmax), rcond=None)[0]

    def _terms(self, d: np.ndarray, by: tuple[int, int, int]) -> np.ndarray:
        """Each term's derivative of that order by x, y and z."""
        out = np.ones((len(d), len(self.powers)))
        for axis in range(3):
            e, factor = self.powers[:, axis].copy(), np.ones(len(self.powers))
            for _ in range(by[axis]):
                factor, e = factor * e, np.maximum(e - 1, 0)
            out *= factor * np.stack([d[:, axis] ** k for k in range(self.lmax + 1)], 1)[:, e]
        return out

    def derivatives(self, sh: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Value, gradient and Hessian of series sh (rows) at unit directions d, one each."""
        p, one = sh @ self.of.T, np.eye(3, dtype=int)
        along = lambda by: (self._terms(d, tuple(by)) * p).sum(1)
        gradient = np.stack([along(one[i]) for i in range(3)], 1)
        hessian = np.empty((len(d), 3, 3))
        for i in range(3):
            for j in range(i, 3):
                hessian[:, i, j] = hessian[:, j, i] = along(one[i] + one[j])
        return along((0, 0, 0)), gradient, hessian

    def tops(self, sh: np.ndarray, d: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
        """Directions and values of the maxima next to d, by Newton's steps on the sphere; a step that doesn't rise is halved, and where the surface isn't domed it goes uphill."""
        d = d / np.linalg.norm(d, axis=1)[:, None]
        value, gradient, hessian = self.derivatives(sh, d)
        reach = np.full(len(d), 0.1)
        for _ in range(rounds):
            flat = np.eye(3) - d[:, :, None] * d[:, None, :]
            slope = np.einsum("nij,nj->ni", flat, gradient)
            bend = flat @ hessian @ flat - (self.lmax * value)[:, None, None] * flat  # the value's part by Euler's rule
            w, v = np.linalg.eigh(bend)
            along = np.einsum("nij,ni->nj", v, slope)
            step = np.einsum("nij,nj->ni", v, np.where(np.abs(w) > 1e-9, along / np.maximum(np.abs(w), 1e-9), 0))
            step = np.einsum("nij,nj->ni", flat, step)
            size = np.linalg.norm(step, axis=1)
            step *= np.minimum(1, reach / np.maximum(size, 1e-300))[:, None]
            new = d + step
            new /= np.linalg.norm(new, axis=1)[:, None]
            v2, g2, h2 = self.derivatives(sh, new)
            up = v2 >= value
            d, value = np.where(up[:, None], new, d), np.where(up, v2, value)
            gradient, hessian = np.where(up[:, None], g2, gradient), np.where(up[:, None, None], h2, hessian)
            reach = np.where(up, reach, np.minimum(reach, size) / 2)
            if (np.minimum(size, reach) < 1e-9).all():
                break
        return d, value


def basins(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For rows of values at a sphere's directions the top to which each direction leads by its highest neighbours."""
    n = values.shape[1]
    near = [[i] for i in range(n)]
    for a, b in edges:
        near[a].append(b), near[b].append(a)
    most = max(map(len, near))
    table = np.array([k + [k[0]] * (most - len(k)) for k in near])
    up = table[np.arange(n), values[:, table].argmax(axis=2)]
    while True:
        higher = np.take_along_axis(up, up, axis=1)
        if (higher == up).all():
            return up
        up = higher


# q-space


def diffusion_time(big_delta: float, small_delta: float) -> float:
    return big_delta - small_delta / 3


def q_magnitude(b: np.ndarray, tau: float, b0_threshold: float = 50.0) -> np.ndarray:
    """1/mm from s/mm2; 0 for unweighted volumes."""
    return np.where(np.asarray(b) <= b0_threshold, 0.0, np.sqrt(np.maximum(b, 0) / (4 * np.pi**2 * tau)))


def guess_deltas(b_max: float, gradient_max: float = 0.08, gyromagnetic: float = 267.51532e6) -> tuple[float, float]:
    """Separation and duration, at three to one, that reach b_max (s/mm2) at the given gradient (T/m)."""
    # b = (gamma G delta)^2 (Delta - delta / 3) with Delta = 3 delta
    small = (b_max * 1e6 / ((gyromagnetic * gradient_max) ** 2 * (3 - 1 / 3))) ** (1 / 3)
    return 3 * small, small


def affine_rotation(affine: np.ndarray) -> np.ndarray:
    """The affine's 3 x 3 part with columns scaled to length one."""
    a = np.asarray(affine, dtype=float)[:3, :3]
    return a / np.linalg.norm(a, axis=0)


def rotate_directions(directions: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Directions turned and scaled to length one; zero ones stay zero."""
    d = np.asarray(directions, dtype=float) @ np.asarray(rotation).T
    n = np.linalg.norm(d, axis=1)
    return np.where(n[:, None] > 0, d / np.where(n > 0, n, 1)[:, None], 0)


def shells(bvals: list[float], tolerance: float = 50.0, b0_threshold: float = 50.0) -> list[tuple[float, list[int]]]:
    """Volumes grouped by b-value in the order they come: into the first group whose running mean is near enough; the b0 group has b = 0 and comes first, the rest by b."""
    b0 = [i for i, b in enumerate(bvals) if b <= b0_threshold]
    groups: list[list[int]] = []
    for i, b in enumerate(bvals):
        if b > b0_threshold:
            near = next((g for g in groups if abs(sum(bvals[k] for k in g) / len(g) - b) <= tolerance), None)
            groups.append([i]) if near is None else near.append(i)
    rest = sorted((sum(bvals[k] for k in g) / len(g), g) for g in groups)
    return ([(0.0, b0)] if b0 else []) + rest


def merge_small_shells(groups: list[tuple[float, list[int]]], least: int = 6) -> list[tuple[float, list[int]]]:
    """Shells with fewer than `least` volumes joined to the one nearest by b, the first smallest at a time; never to the b0 shell."""
    groups = [(b, list(g)) for b, g in groups]
    while True:
        weighted = [k for k, (b, _) in enumerate(groups) if b > 0]
        small = [k for k in weighted if len(groups[k][1]) < least]
        if not small or len(weighted) < 2:
            return groups
        k = min(small, key=lambda i: len(groups[i][1]))
        to = min((i for i in weighted if i != k), key=lambda i: abs(groups[i][0] - groups[k][0]))
        (b1, g1), (b2, g2) = groups[k], groups[to]
        groups[to] = ((b1 * len(g1) + b2 * len(g2)) / (len(g1) + len(g2)), sorted(g1 + g2))
        del groups[k]


def polynomial_terms(order: int) -> list[tuple[int, int, int]]:
    """Exponents of x, y and z with a sum of at most `order`, in lexicographic order: 20 at order 3."""
    return [(i, j, k) for i in range(order + 1) for j in range(order + 1 - i) for k in range(order + 1 - i - j)]


# the simple harmonic oscillator basis


def shore_indices(order: int) -> list[tuple[int, int, int]]:
    """(n, l, m) of each function: all n up to the order, even l up to n; 72 at order 6."""
    return [(n, l, m) for n in range(order + 1) for l in range(0, n + 1, 2) for m in range(-l, l + 1)]


def shore_radial(n: int, l: int, q: np.ndarray, zeta: float) -> np.ndarray:
    kappa = math.sqrt(2 * factorial(n - l) / (zeta**1.5 * gamma(n + 1.5)))
    x = np.asarray(q, dtype=float) ** 2 / zeta
    return kappa * x ** (l / 2) * np.exp(-x / 2) * laguerre(n - l, l + 0.5, x)


def shore_matrix(q: np.ndarray, order: int = 6, zeta: float = 700.0) -> np.ndarray:
    """Rows of the basis at q vectors (1/mm); the angular part is the real even basis above."""
    r, _, _ = sphere_angles(np.asarray(q, dtype=float))
    unit = np.where(r[:, None] > 0, q / np.where(r > 0, r, 1)[:, None], [0.0, 0.0, 1.0])
    y = sh_matrix(unit, order)
    return np.stack([shore_radial(n, l, r, zeta) * y[:, sh_index(l, m)] for n, l, m in shore_indices(order)], axis=1)


def shore_penalties(order: int) -> tuple[np.ndarray, np.ndarray]:
    """Diagonals (n (n + 1))^2 and (l (l + 1))^2."""
    i = np.array(shore_indices(order))
    return (i[:, 0] * (i[:, 0] + 1.0)) ** 2, (i[:, 1] * (i[:, 1] + 1.0)) ** 2


def shore_to_odf(order: int, zeta: float, lmax: int | None = None) -> np.ndarray:
    """Matrix from basis coefficients to the harmonic coefficients, up to lmax, of the signal's orientation density."""
    lmax = order - order % 2 if lmax is None else lmax
    out = np.zeros((n_sh(lmax), len(shore_indices(order))))
    for k, (n, l, m) in enumerate(shore_indices(order)):
        if l <= lmax:
            kappa = math.sqrt(2 * factorial(n - l) / (zeta**1.5 * gamma(n + 1.5)))
            integral = gamma(l / 2 + 1.5) * gamma(n + 1.5) / (gamma(l + 1.5) * factorial(n - l)) * 2 ** (l / 2 + 1.5)
            out[sh_index(l, m), k] = (-1.0) ** (n - l // 2) * kappa * integral * hyp2f1(l - n, l / 2 + 1.5, l + 1.5, 2.0)
    return out


def _l0(order: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the (n, 0, 0) coefficients, and their n."""
    at = [k for k, (_, l, _) in enumerate(shore_indices(order)) if l == 0]
    return np.array(at), np.array([shore_indices(order)[k][0] for k in at])


def scalar_weights(order: int, zeta: float) -> dict[str, np.ndarray]:
    """Weights over coefficients whose dot products give the signal at the origin (e0), and over it: return-to-origin probability, mean squared displacement and the integral of the signal times q squared."""
    at, ns = _l0(order)
    out = {k: np.zeros(len(shore_indices(order))) for k in ("e0", "rtop", "msd", "q2")}
    for k, n in zip(at, ns.tolist()):
        kappa = math.sqrt(2 * factorial(n) / (zeta**1.5 * gamma(n + 1.5)))
        moment = hyp2f1(-n, 2.5, 1.5, 2.0)
        out["e0"][k] = kappa * float(laguerre(n, 0.5, np.zeros(1))[0]) / math.sqrt(4 * math.pi)
        out["rtop"][k] = (-1.0) ** n * math.sqrt(16 * math.pi * zeta**1.5 * gamma(n + 1.5) / factorial(n))
        out["msd"][k] = (-1.0) ** n * math.sqrt(9 * gamma(n + 1.5) / (8 * math.pi**6 * zeta**3.5 * factorial(n))) * moment
        out["q2"][k] = 6 * math.sqrt(2 * math.pi) * zeta**2.5 * kappa * gamma(n + 1.5) / factorial(n) * moment
    return out


def axis_weights(order: int, zeta: float, plane: bool) -> np.ndarray:
    """By coefficient, what the harmonic at a direction is weighted with for the return-to-axis probability, or with `plane` for the return-to-plane one."""
    mu, out = 1 / (2 * math.pi * math.sqrt(zeta)), []
    for n, l, _ in shore_indices(order):
        j = n - l + 1
        alpha = (-1.0) ** (l // 2) * math.sqrt(2 * math.pi * zeta**1.5 * gamma(n + 1.5) / (2.0**l * factorial(n - l)))
        half = (l + 1) / 2
        total = sum((-1.0) ** k * binomial(j + l - 0.5, j - k - 1) * gamma(half + k) / (factorial(k) * 0.5 ** (half + k)) for k in range(j))
        lead = (-1.0) ** (l // 2) * 0.5 ** (l / 2) / math.sqrt(math.pi) if plane else 2 * (-1.0) ** (j - 1) * 2 ** (-(l + 3) / 2) / math.pi
        out.append(lead * total / alpha / (mu if plane else mu * mu))
    return np.array(out)
