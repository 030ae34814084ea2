"""The dynamic hedge (intercept and slope as random walks) as a scan of filtering elements over chunks.

An element describes what some rows do to the state before them: the state after them is normal with mean A m + b and
covariance C, and eta, J carry what the rows say about the state before. Elements of neighbouring rows combine
associatively, so a chunk is one element of fourteen numbers; the prior of the first chunk is folded through the elements,
and every chunk then runs the plain recursion from the state it begins with.
"""
from __future__ import annotations

from typing import Any

import numpy as np

from ..core.scan import Arrays, Machine

#: a00 a01 a10 a11, b0 b1, c00 c01 c11, e0 e1, j00 j01 j11
Element = tuple[np.ndarray, ...]


def elements(y: np.ndarray, x: np.ndarray, qa, qb, r) -> Element:
    """One element a row; the noise may have a further axis of cells."""
    x, y = x + 0 * qa, y + 0 * qa
    s = qa + x * x * qb + r
    k0, k1 = qa / s, x * qb / s
    zero = np.zeros_like(s)
    return (1 - k0, -k0 * x, -k1, 1 - k1 * x, k0 * y, k1 * y, qa - k0 * qa, -k0 * x * qb, qb - k1 * x * qb, y / s, x * y / s, 1 / s + zero, x / s, x * x / s)


def identity(shape) -> Element:
    one, zero = np.ones(shape), np.zeros(shape)
    return (one, zero, zero, one, *[zero] * 10)


def combine(i: Element, j: Element) -> Element:
    """The element of the rows of ``i`` followed by those of ``j``."""
    a00, a01, a10, a11, b0, b1, c00, c01, c11, e0, e1, j00, j01, j11 = i
    A00, A01, A10, A11, B0, B1, C00, C01, C11, E0, E1, J00, J01, J11 = j
    # m = (1 + C_i J_j)^-1
    m00, m01 = 1 + c00 * J00 + c01 * J01, c00 * J01 + c01 * J11
    m10, m11 = c01 * J00 + c11 * J01, 1 + c01 * J01 + c11 * J11
    det = m00 * m11 - m01 * m10
    m00, m01, m10, m11 = m11 / det, -m01 / det, -m10 / det, m00 / det
    # d = A_j m
    d00, d01 = A00 * m00 + A01 * m10, A00 * m01 + A01 * m11
    d10, d11 = A10 * m00 + A11 * m10, A10 * m01 + A11 * m11
    u0, u1 = b0 + c00 * E0 + c01 * E1, b1 + c01 * E0 + c11 * E1
    f00, f01 = d00 * c00 + d01 * c01, d00 * c01 + d01 * c11
    f10, f11 = d10 * c00 + d11 * c01, d10 * c01 + d11 * c11
    # g = A_i' m', as (1 + J_j C_i)^-1 is the transpose of m
    g00, g01 = a00 * m00 + a10 * m01, a00 * m10 + a10 * m11
    g10, g11 = a01 * m00 + a11 * m01, a01 * m10 + a11 * m11
    v0, v1 = E0 - J00 * b0 - J01 * b1, E1 - J01 * b0 - J11 * b1
    h00, h01 = g00 * J00 + g01 * J01, g00 * J01 + g01 * J11
    h10, h11 = g10 * J00 + g11 * J01, g10 * J01 + g11 * J11
    return (d00 * a00 + d01 * a10, d00 * a01 + d01 * a11, d10 * a00 + d11 * a10, d10 * a01 + d11 * a11,
            d00 * u0 + d01 * u1 + B0, d10 * u0 + d11 * u1 + B1,
            f00 * A00 + f01 * A01 + C00, f00 * A10 + f01 * A11 + C01, f10 * A10 + f11 * A11 + C11,
            g00 * v0 + g01 * v1 + e0, g10 * v0 + g11 * v1 + e1,
            h00 * a00 + h01 * a10 + j00, h00 * a01 + h01 * a11 + j01, h10 * a01 + h11 * a11 + j11)


def total(rows: Element) -> Element:
    """All rows combined in order, by halves."""
    while len(rows[0]) > 1:
        if len(rows[0]) % 2:
            rows = tuple(np.concatenate([v, w]) for v, w in zip(rows, identity((1, *rows[0].shape[1:]))))
        rows = combine(tuple(v[0::2] for v in rows), tuple(v[1::2] for v in rows))
    return tuple(v[0] for v in rows)


State = tuple  # mean of intercept and slope, their variances and covariance: a, b, p00, p01, p11


def apply(state: State, element: Element) -> State:
    a, b, p00, p01, p11 = state
    zero, of = np.zeros_like(element[0]), lambda v: v + 0 * element[0]
    done = combine((zero, zero, zero, zero, of(a), of(b), of(p00), of(p01), of(p11), zero, zero, zero, zero, zero), element)
    return done[4], done[5], done[6], done[7], done[8]


class FilterMachine(Machine):
    """Rows carry their key's noise and first state; the paths are made row by row."""

    columns = ("la", "lb", "q_alpha", "q_beta", "r", "state_a", "state_b", "p00", "p01", "p11")
    shown = ("alpha_t", "beta_t", "innovation", "var_alpha", "var_beta")
    makes = dict.fromkeys((*shown, "cov_ab"), "double")

    def first(self, a: Arrays) -> State:
        return tuple(float(a[n][0]) for n in ("state_a", "state_b", "p00", "p01", "p11"))

    def _noise(self, a: Arrays) -> tuple[float, float, float]:
        return tuple(float(a[n][0]) for n in ("q_alpha", "q_beta", "r"))

    def summary(self, a: Arrays) -> Element:
        qa, qb, r = self._noise(a)
        return total(elements(a["la"].astype(float), a["lb"].astype(float), np.float64(qa), qb, r))

    def advance(self, state: State, summary: Element) -> State:
        return tuple(float(v) for v in apply(state, summary))

    def rows(self, a: Arrays, state: State) -> dict[str, Any]:
        (qa, qb, r), (al, be, p00, p01, p11) = self._noise(a), state
        out = []
        for y, x in zip(a["la"].tolist(), a["lb"].tolist()):
            p00, p11 = p00 + qa, p11 + qb
            e = y - al - be * x
            h0, h1 = p00 + x * p01, p01 + x * p11
            s = h0 + x * h1 + r
            k0, k1 = (h0 / s, h1 / s) if np.isfinite(s) and s > 0 else (0.0, 0.0)
            al, be = al + k0 * e, be + k1 * e
            p00, p01, p11 = p00 - k0 * h0, p01 - k0 * h1, p11 - k1 * h1
            out.append((al, be, e, p00, p11, p01))
        return dict(zip(self.makes, np.array(out, dtype=float).reshape(-1, 6).T))


class GridMachine(Machine):
    """Negative log-likelihood of a chunk for every cell of a grid of log noises; the axes stand in the rows."""

    columns = ("la", "lb", "alpha_ols", "beta_ols", "_x_q_alpha", "_x_q_beta", "_x_r")
    makes = {"cell": "int", "nll": "double"}
    #: Cells whose elements are combined at a time.
    cells_at_once = 25

    def _cells(self, a: Arrays) -> list[np.ndarray]:
        axes = [np.asarray(a[n][0], dtype=float) for n in self.columns[4:]]
        return [np.exp(m.ravel()) for m in np.meshgrid(*axes, indexing="ij")]

    def first(self, a: Arrays) -> State:
        one = np.ones(len(self._cells(a)[0]))
        return (float(a["alpha_ols"][0]) * one, float(a["beta_ols"][0]) * one, one, 0 * one, one)

    def summary(self, a: Arrays) -> Element:
        y, x, cells = a["la"].astype(float)[:, None], a["lb"].astype(float)[:, None], self._cells(a)
        parts = [total(elements(y, x, *(v[k:k + self.cells_at_once] for v in cells))) for k in range(0, len(cells[0]), self.cells_at_once)]
        return tuple(np.concatenate(v) for v in zip(*parts))

    def advance(self, state: State, summary: Element) -> State:
        return apply(state, summary)

    def rows(self, a: Arrays, state: State) -> dict[str, Any]:
        (qa, qb, r), (al, be, p00, p01, p11) = self._cells(a), state
        nll = np.zeros(len(qa))
        for y, x in zip(a["la"].tolist(), a["lb"].tolist()):
            p00, p11 = p00 + qa, p11 + qb
            e = y - al - be * x
            h0, h1 = p00 + x * p01, p01 + x * p11
            s = h0 + x * h1 + r
            ok = np.isfinite(s) & (s > 0)
            safe = np.where(ok, s, 1.0)
            k0, k1 = np.where(ok, h0 / safe, 0.0), np.where(ok, h1 / safe, 0.0)
            nll += np.where(ok, 0.5 * (np.log(2 * np.pi * safe) + e * e / safe), 1e12)
            al, be = al + k0 * e, be + k1 * e
            p00, p01, p11 = p00 - k0 * h0, p01 - k0 * h1, p11 - k1 * h1
        return {"cell": np.arange(len(nll), dtype=np.int32), "nll": nll}
