"""Leading eigenpairs of a symmetric matrix by contour integration (FEAST).

``leading`` takes a matrix whose side is a vector's dimension, so its size does not follow
the number of rows.  An interval that holds the wanted eigenvalues is found by inertia
counts; the spectral projector of the interval is a contour integral of ``(z - A)^-1``,
applied to a block of vectors by quadrature; Rayleigh-Ritz on its range gives the pairs; and
the inertia counts at the interval's ends say how many there must be.
"""

from __future__ import annotations

import numpy as np

PIVOT = (1 + 17 ** 0.5) / 8
EPS = np.finfo(float).eps
#: least width of an interval, relative to the matrix
CLOSE = 1e-6


def count_above(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above ``shift``: the positive inertia of ``a - shift``.

    Symmetric elimination with pivots of one or two rows chosen by the largest entry; by
    Sylvester's law the signs of its pivots are those of the eigenvalues.  A pivot of two
    rows is taken only where it is indefinite, so it has one of each sign.
    """
    s = a - shift * np.eye(len(a))
    above = 0
    while len(s):
        size = np.abs(s)
        largest = size.max()
        if largest == 0:
            break
        r = int(size.diagonal().argmax())
        if size[r, r] >= PIVOT * largest:
            order, width = [r], 1
            above += s[r, r] > 0
        else:
            order, width = list(np.unravel_index(size.argmax(), s.shape)), 2
            above += 1
        order += [i for i in range(len(s)) if i not in order]
        s = s[np.ix_(order, order)]
        side = s[width:, :width]
        s = s[width:, width:] - side @ np.linalg.solve(s[:width, :width], side.T)
        s = (s + s.T) / 2
    return int(above)


def bracket(a: np.ndarray, wanted: int, spare: int = 4) -> tuple[float, float, int]:
    """(low, high, count): no eigenvalue above ``high``, ``count >= wanted`` above ``low``.

    At most ``spare`` more than wanted lie above ``low``, unless more eigenvalues are closer
    to each other than ``CLOSE``: they stay in one interval, which is never narrower.
    """
    radius = np.abs(a).sum(axis=1) - np.abs(a.diagonal())
    bottom = float((a.diagonal() - radius).min())
    top = float((a.diagonal() + radius).max())
    margin = 1e-3 * max(abs(top), abs(bottom))
    low, count, high = bottom - margin, len(a), top + margin
    over, close = high, CLOSE * max(abs(top), abs(bottom))
    while count > wanted + spare and over - low > close:
        middle = (low + over) / 2
        found = count_above(a, middle)
        if found >= wanted:
            low, count = middle, found
        else:
            over = middle
        if found == 0:
            high = middle
    if over - low <= close:
        low -= close
        count = count_above(a, low)
    under = low
    while high - under > 0.05 * (high - low):      # a tight circle converges faster
        middle = (under + high) / 2
        if count_above(a, middle):
            under = middle
        else:
            high = middle
    return low, high + close, count


def project(a: np.ndarray, block: np.ndarray, low: float, high: float, nodes: int) -> np.ndarray:
    """The block under the spectral projector of (low, high): Gauss nodes on a half circle.

    The matrix is real, so the lower half of the circle gives the conjugate.
    """
    place, weight = np.polynomial.legendre.leggauss(nodes)
    centre, radius = (low + high) / 2, (high - low) / 2
    turn = np.exp(0.5j * np.pi * (1 - place))
    eye, out = np.eye(len(a)), np.zeros_like(block)
    for w, t in zip(weight, turn):
        solved = np.linalg.solve((centre + radius * t) * eye - a, block.astype(complex))
        out += 0.5 * w * radius * (t * solved).real
    return out


def interval_pairs(a: np.ndarray, low: float, high: float, count: int, nodes: int = 16,
                   rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """All ``count`` eigenpairs in (low, high), by rising eigenvalue.

    Raises if after ``rounds`` the pairs that converged are not as many as the inertia says.
    """
    n = len(a)
    size = np.abs(a).sum(axis=1).max()
    block = np.random.default_rng(7).standard_normal((n, min(n, 2 * count + 8)))
    found = 0
    for _ in range(rounds):
        basis, _ = np.linalg.qr(project(a, block, low, high, nodes))
        values, turn = np.linalg.eigh(basis.T @ a @ basis)
        block = basis @ turn
        inside = (values > low) & (values <= high)
        off = np.linalg.norm(a @ block - block * values, axis=0)
        good = inside & (off <= 32 * n ** 0.5 * EPS * size)
        found = int(good.sum())
        if found == count == int(inside.sum()):
            return values[good], block[:, good]
    raise ArithmeticError(f"{found} eigenpairs converged in an interval that holds {count}")


def leading(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit vectors as columns.

    A vector's entry of largest size is positive, so results do not depend on the run.  A
    zero matrix has unit axes; no more pairs than rows are given.
    """
    wanted = min(wanted, len(a))
    if not wanted or not np.abs(a).max():
        return np.zeros(wanted), np.eye(len(a))[:, :wanted]
    scale = np.abs(a).max()
    for spare in (4, 9, 16):          # another end, should an eigenvalue lie on this one
        try:
            values, vectors = interval_pairs(a / scale, *bracket(a / scale, wanted, spare))
            break
        except ArithmeticError:
            if spare == 16:
                raise
    order = np.argsort(-values, kind="stable")[:wanted]
    values, vectors = values[order] * scale, vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)])
    return values, vectors * sign
