"""Small dense algebra on the cross-product matrix of one station's lagged variables.

Terms of the matrix, in order: constant, the K variables today, then the K
variables 1, 2, ... p days ago.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def lagged_terms(block: np.ndarray, lags: int) -> np.ndarray:
    """(rows, 1 + K*(lags+1)) design of the rows that have all their lags."""
    rows = len(block) - lags
    parts = [np.ones((rows, 1))] + [block[lags - i : lags - i + rows] for i in range(lags + 1)]
    return np.hstack(parts)


def today_products(block: np.ndarray, lags: int, days: int = 8) -> np.ndarray:
    """(lags + 1, K, K) sums of today's products with each lag.

    ``days`` days in a row and the days before them are one row of a product, so
    that a few wide products stand for many narrow ones; each lag is a sum over
    a diagonal of the result.
    """
    n, k = block.shape
    days = min(days, n - lags)
    whole = (n - lags) // days * days
    today = block[lags : lags + whole].reshape(-1, days * k)
    reach = np.lib.stride_tricks.sliding_window_view(block, days + lags, axis=0)[:whole:days]
    reach = reach.transpose(0, 2, 1).reshape(len(today), (days + lags) * k)
    sums = sum(
        part[:, k * i : k * (i + lags + 1)] for i, part in enumerate((today.T @ reach).reshape(days, k, -1))
    )
    rest = block[lags + whole :]
    out = sums.reshape(k, lags + 1, k).transpose(1, 0, 2)[::-1]
    return out + np.stack([rest.T @ block[lags + whole - j : n - j] for j in range(lags + 1)])


def cross_products(block: np.ndarray, lags: int) -> np.ndarray:
    """Cross-products of the lagged terms, from one product for each lag difference.

    The block of lags (i + 1, j + 1) covers the same days as (i, j), one day
    earlier: the product of the day that comes in is added and that of the day
    that goes out taken away. So only today's products with each lag are sums
    over all days, about n * lags * K^2 multiplications instead of n * (lags * K)^2,
    and no design matrix of all days is built.
    """
    n, k = block.shape
    rows, width = n - lags, k * (lags + 1)
    if rows <= 2 * lags:  # the corrections would cost more than the design
        z = lagged_terms(block, lags)
        return z.T @ z
    today = block[lags:]
    out = np.empty((1 + width, 1 + width))
    gram = np.empty((lags + 1, k, lags + 1, k))
    gram[0] = today_products(block, lags).transpose(1, 0, 2)
    incoming, outgoing = block[:lags][::-1], block[n - lags :][::-1]
    ends = np.stack([incoming.ravel(), outgoing.ravel()])
    change = ((ends * [[1.0], [-1.0]]).T @ ends).reshape(lags, k, lags, k)
    for i in range(lags):
        gram[i + 1, :, i + 1 :] = gram[i, :, i:lags] + change[i, :, i:]
    for i in range(1, lags + 1):
        gram[i, :, :i] = gram[:i, :, i].transpose(2, 0, 1)
    sums = today.sum(axis=0) + np.vstack([np.zeros(k), np.cumsum(incoming - outgoing, axis=0)])
    out[0, 0] = rows
    out[0, 1:] = out[1:, 0] = sums.ravel()
    out[1:, 1:] = gram.reshape(width, width)
    return out


@dataclass(frozen=True)
class Waves:
    """Random Fourier features of a window: cosines of random directions through it.

    Their inner products approach a Gaussian kernel of ``width`` window units, so
    a ridge regression on them follows bends that lags alone cannot. Directions
    and phases come from ``seed``, so a saved model needs the three numbers only.
    """

    count: int
    width: float
    seed: int

    def of(self, windows: np.ndarray) -> np.ndarray:
        """(..., count) features of (..., days * K) windows."""
        rng = np.random.default_rng(self.seed)
        directions = rng.standard_normal((windows.shape[-1], self.count)) / self.width
        phases = rng.uniform(0, 2 * np.pi, self.count)
        return np.sqrt(2.0 / self.count) * np.cos(windows @ directions + phases)


def wave_products(block: np.ndarray, lags: int, waves: Waves, days: int = 4096) -> np.ndarray:
    """Cross-products of the lagged terms and the features of the lags, ``days`` rows at a time."""
    k, total = block.shape[1], 0.0
    for at in range(0, len(block) - lags, days):
        z = lagged_terms(block[at : at + days + lags], lags)
        z = np.hstack([z, waves.of(z[:, 1 + k :])])
        total = total + z.T @ z
    return total


def upper(matrix: np.ndarray) -> np.ndarray:
    return matrix[np.triu_indices(len(matrix))]


def symmetric(values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = values
    return out + np.triu(out, 1).T


def least_squares(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Solve the normal equations; the pseudo-inverse where they are singular."""
    try:
        root = np.linalg.cholesky(xx)
        edge = np.abs(np.diag(root))
        if edge.min() > 1e-6 * edge.max():
            return np.linalg.solve(xx, xy)
    except np.linalg.LinAlgError:
        pass
    return np.linalg.pinv(xx, rcond=1e-12, hermitian=True) @ xy


def regress(gram: np.ndarray, k: int, p: int, ridge: float = 0.0, more: int = 0):
    """Coefficients (1 + K*p + more, K) of today on p lags, and the error cross-products.

    ``more`` terms follow the lags in the matrix. The ridge penalty spares the
    constant.
    """
    today, end = slice(1, 1 + k), 1 + k + p * k + more
    rows = np.delete(gram[:end, :end], today, axis=0)
    full, xy = np.delete(rows, today, axis=1), rows[:, today]
    xx = full
    if ridge:
        xx = full.copy()
        xx.flat[len(xx) + 1 :: len(xx) + 1] += ridge
    coef = least_squares(xx, xy)
    yy = gram[today, today]
    errors = yy - coef.T @ xy - xy.T @ coef + coef.T @ full @ coef
    return coef, errors


def nested_errors(gram: np.ndarray, k: int, maxlags: int) -> np.ndarray | None:
    """(maxlags + 1, K, K) error cross-products of every order, from one factorisation.

    With the terms in the order constant, lag 1, ..., lag maxlags, today, the
    Cholesky rows of today hold what each further lag explains: the errors of
    order p are today's products less those of its first 1 + K * p columns.
    None where the matrix is too close to singular for that.
    """
    order = np.r_[0, 1 + k : 1 + k + maxlags * k, 1 : 1 + k]
    scale = np.sqrt(np.diag(gram)[order])
    if not (scale > 0).all():
        return None
    try:
        root = np.linalg.cholesky(gram[np.ix_(order, order)] / np.outer(scale, scale))
    except np.linalg.LinAlgError:
        return None
    if np.diag(root).min() < 1e-6:
        return None
    now = root[-k:] * scale[-k:, None]
    left = now[:, -k:] @ now[:, -k:].T
    out = np.empty((maxlags + 1, k, k))
    for p in range(maxlags, -1, -1):
        out[p] = left
        explained = now[:, 1 + k * (p - 1) : 1 + k * p] if p else now[:, :1]
        left = left + explained @ explained.T
    return out


def _singular(errors: np.ndarray) -> bool:
    """Whether some mix of the errors is constant, up to rounding."""
    spread = np.sqrt(np.maximum(np.diag(errors), 0.0))
    if not (spread > 0).all():
        return True
    return np.linalg.eigvalsh(errors / np.outer(spread, spread))[0] < 1e-10


def criteria(gram: np.ndarray, rows: int, k: int, maxlags: int) -> np.ndarray:
    """(maxlags+1, 4): aic, bic, hqic, fpe of each order on the common sample."""
    out = np.full((maxlags + 1, 4), np.inf)
    nested = nested_errors(gram, k, maxlags)
    for p in range(maxlags + 1):
        errors = regress(gram, k, p)[1] if nested is None else nested[p]
        if rows <= k * p + 1 or _singular(errors):
            continue
        logdet = np.linalg.slogdet(errors / rows)[1]
        free = p * k * k + k
        width = k * p + 1
        out[p] = (
            logdet + 2.0 / rows * free,
            logdet + np.log(rows) / rows * free,
            logdet + 2.0 * np.log(np.log(rows)) / rows * free,
            ((rows + width) / (rows - width)) ** k * np.exp(logdet),
        )
    return out


CRITERIA = ("aic", "bic", "hqic", "fpe")


def refit_gram(gram: np.ndarray, head: np.ndarray, k: int, maxlags: int, p: int) -> np.ndarray:
    """Add the rows p..maxlags-1, which only orders below maxlags can use.

    Terms beyond lag p in these rows stay zero; order p does not read them.
    """
    if p >= maxlags:
        return gram
    z = lagged_terms(head, p)
    out = gram.copy()
    width = z.shape[1]
    out[:width, :width] += z.T @ z
    return out


def recurse(
    coef: np.ndarray, state: np.ndarray, horizon: int, waves: Waves | None = None
) -> np.ndarray:
    """(series, horizon, K) paths; coef (series, 1+K*p, K), state (series, p, K) oldest first.

    With ``waves`` their features of the window follow the lags in ``coef``.
    """
    n, width, k = coef.shape
    p = (width - 1 - (waves.count if waves else 0)) // k
    path = np.concatenate([state[:, state.shape[1] - p :], np.zeros((n, horizon, k))], axis=1)
    for t in range(p, p + horizon):
        recent = path[:, t - p : t][:, ::-1].reshape(n, p * k)
        if waves:
            recent = np.hstack([recent, waves.of(recent)])
        path[:, t] = coef[:, 0] + np.einsum("nr,nrk->nk", recent, coef[:, 1:])
    return path[:, p:]
