"""Walk-forward Gaussian hidden Markov models: one group for each key and fold, whose seeds are fitted in turn.

Fitting and filtering are recursions over at most a fold of rows, so they run in NumPy within a group; Spark fans the
rows out, scales them and deals the groups. States are filtered forward only: the probability of a day uses nothing
after it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import fan_out, number_rows

def _root(cov: np.ndarray) -> np.ndarray:
    """Lower Cholesky factor; the diagonal is raised, a hundredfold each time, until there is one."""
    for ridge in (1e-9, 1e-7, 1e-5, 1e-3, 1e-1):
        try:
            return np.linalg.cholesky(cov + ridge * np.eye(len(cov)))
        except np.linalg.LinAlgError:
            continue
    raise np.linalg.LinAlgError("covariance has no Cholesky factor")


def log_density(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """log N(x | mean, cov) for each row and state."""
    roots = [_root(c) for c in covs]
    white = [np.linalg.solve(r, (x - m).T) for r, m in zip(roots, means)]
    volume = np.array([np.log(np.diag(r)).sum() for r in roots]) + 0.5 * x.shape[1] * np.log(2 * np.pi)
    return -0.5 * np.stack([(w * w).sum(axis=0) for w in white], axis=1) - volume


def _forward(start: np.ndarray, move: np.ndarray, dens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward pass of several models (first axis): probabilities given the rows so far, the scale of each row, the densities over
    their largest, and the largest. A row that no state can have made leaves the prediction as it is."""
    top = dens.max(2, keepdims=True)
    like = np.exp(dens - np.where(np.isfinite(top), top, 0.0))
    alpha, scale = np.empty_like(like), np.empty(like.shape[:2])
    ahead = start
    for t in range(like.shape[1]):
        now = like[:, t] * ahead
        total = now.sum(1)
        lost = ~(total > 0)
        if lost.any():
            now[lost] = ahead[lost]
            norm = now.sum(1)
            scale[:, t] = np.where(lost, 1e-300, total)
        else:
            norm = scale[:, t] = total
        alpha[:, t] = now / norm[:, None]
        ahead = (alpha[:, t, :, None] * move).sum(1)
    return alpha, scale, like, top[:, :, 0]


def _posteriors(start: np.ndarray, move: np.ndarray, dens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several models: probabilities of the states of each row given all rows, expected moves, and log likelihoods."""
    alpha, scale, like, top = _forward(start, move, dens)
    beta = np.ones_like(alpha)
    for t in range(alpha.shape[1] - 2, -1, -1):
        beta[:, t] = (move * (like[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None])[:, None, :]).sum(2)
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(2, keepdims=True), 1e-300)
    later = like[:, 1:] * beta[:, 1:] / scale[:, 1:, None]
    xi = move * np.einsum("stk,stj->skj", alpha[:, :-1], later)
    return gamma, xi, (np.log(scale) + top).sum(1)


#: Forms of the states' covariances: any; no correlations; one for all states; one variance for all columns of a state.
FORMS = ("full", "diag", "tied", "spherical")


def _known(form: str) -> str:
    if form not in FORMS:
        raise ValueError(f"covariances are one of {', '.join(FORMS)}, not {form!r}")
    return form


def shaped(scatters: np.ndarray, weights: np.ndarray, form: str, ridge: float = 1e-3) -> np.ndarray:
    """Covariances (states x columns x columns) of a form from the states' weighted scatters about their means: those of the greatest likelihood, but for a
    ridge that is worth as much as `ridge` rows of variance one."""
    d = scatters.shape[1]
    if form == "tied":
        one = scatters.sum(0) + ridge * np.eye(d)
        return np.repeat(one[None] / weights.sum(), len(scatters), axis=0)
    covs = (scatters + ridge * np.eye(d)) / weights[:, None, None]
    if form == "full":
        return covs
    own = np.einsum("kii->ki", covs)
    if form == "spherical":
        own = np.repeat(own.mean(1, keepdims=True), d, axis=1)
    return own[:, :, None] * np.eye(d)


class GaussianHmm:
    """Fitted by expectation-maximisation from a seeded start; covariances of one of FORMS."""

    def __init__(self, start: np.ndarray, move: np.ndarray, means: np.ndarray, covs: np.ndarray, form: str = "full"):
        self.start, self.move, self.means, self.covs, self.form = start, move, means, covs, _known(form)
        self.log_likelihoods: list[float] = []

    @classmethod
    def fit(cls, x: np.ndarray, states: int = 2, seed: int = 0, rounds: int = 200, tolerance: float = 1e-2, form: str = "full") -> GaussianHmm:
        return cls.fit_all(x, states, [seed], rounds, tolerance, form)[0]

    @classmethod
    def _begin(cls, x: np.ndarray, states: int, seed: int, form: str = "full") -> GaussianHmm:
        rng, (n, d) = np.random.default_rng(seed), x.shape
        near = ((x[:, None, :] - x[rng.choice(n, states, replace=False)][None]) ** 2).sum(-1).argmin(1)
        for _ in range(20):
            centres = np.stack([x[near == k].mean(0) if (near == k).any() else x[rng.integers(n)] for k in range(states)])
            near = ((x[:, None, :] - centres[None]) ** 2).sum(-1).argmin(1)
        covs = np.stack([np.cov(x.T, ddof=0).reshape(d, d) + 1e-3 * np.eye(d)] * states)
        if form in ("diag", "spherical"):
            covs = shaped(covs, np.ones(states), form, 0.0)
        rest = 0.1 / max(1, states - 1)
        return cls(np.full(states, 1 / states), np.full((states, states), rest) + np.eye(states) * (0.9 - rest), centres, covs, form)

    @classmethod
    def fit_all(cls, x: np.ndarray, states: int, seeds: Sequence[int], rounds: int = 200, tolerance: float = 1e-2, form: str = "full") -> list[GaussianHmm]:
        """A model for each seed. Their recursions run side by side, so that a step of all costs little more than a step of one; a model
        that has settled is left as it is."""
        models = [cls._begin(x, states, s, _known(form)) for s in seeds]
        live = list(models)
        for _ in range(rounds):
            if not live:
                break
            dens = np.stack([log_density(x, m.means, m.covs) for m in live])
            gammas, moves, totals = _posteriors(np.stack([m.start for m in live]), np.stack([m.move for m in live]), dens)
            going = []
            for m, gamma, xi, total in zip(live, gammas, moves, totals.tolist()):
                settled = bool(m.log_likelihoods) and total - m.log_likelihoods[-1] < tolerance
                m.log_likelihoods.append(total)
                if not settled:
                    m._maximise(x, gamma, xi)
                    going.append(m)
            live = going
        return models

    def _maximise(self, x: np.ndarray, gamma: np.ndarray, xi: np.ndarray) -> None:
        weight = gamma.sum(0) + 1e-12
        self.start = gamma[0] / gamma[0].sum()
        self.move = xi / np.maximum(xi.sum(1, keepdims=True), 1e-300)
        self.means = gamma.T @ x / weight[:, None]
        gaps = [x - m for m in self.means]
        self.covs = shaped(np.stack([(gamma[:, k, None] * r).T @ r for k, r in enumerate(gaps)]), weight, self.form)

    def _logs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.log(np.clip(self.start, 1e-300, None)), np.log(np.clip(self.move, 1e-300, None))

    def filtered(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the states given the rows up to each: no backward pass."""
        return _forward(self.start[None], self.move[None], log_density(x, self.means, self.covs)[None])[0][0]

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        start, move = self._logs()
        dens = log_density(x, self.means, self.covs)
        best, back = start + dens[0], np.zeros(dens.shape, dtype=int)
        for t in range(1, len(x)):
            step = best[:, None] + move
            back[t] = step.argmax(0)
            best = dens[t] + step.max(0)
        path = np.empty(len(x), dtype=int)
        path[-1] = best.argmax()
        for t in range(len(x) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path


FAILURES = (np.linalg.LinAlgError, ValueError, FloatingPointError)


def stressed_state(states: np.ndarray, level: np.ndarray, n: int) -> int:
    """The state with the highest mean of the raw level; an empty one loses, of equal ones the first wins."""
    means = [level[states == k].mean() if (states == k).any() else -np.inf for k in range(n)]
    return int(np.argmax(means))


def _scaled(x: np.ndarray, fitted: np.ndarray) -> np.ndarray:
    std = fitted.std(0)
    return (x - fitted.mean(0)) / np.where(std > 0, std, 1.0)


def walk_forward(features: DataFrame, columns: Sequence[str], level: str, train: int = 756, test: int = 126, seeds: Sequence[int] = (42,), states: int = 2, rounds: int = 200, by: Sequence[str] = ("asset",), order: str = "d", form: str = "full") -> DataFrame:
    """(*by, seed, fold, d, stressed_prob, state, converged, error): filtered states of the test rows of each fold. The filter runs over the training rows
    first, so that it is warm; means and deviations are those of the training rows. A fold that can't be fitted gives one row with the
    error and no day; one that finds a single state is kept and says so."""
    _known(form)
    names = list(dict.fromkeys([*columns, level]))
    rows = fan_out(number_rows(features.select(*by, order, *names), by, order), train, test, by)
    keys = [*by, "fold"]
    kind = {c: rows.schema[c].dataType.simpleString() for c in [*keys, order]}

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        inside = (part["part"] == "train").to_numpy()
        x = part[list(columns)].to_numpy(float)
        head = {c: part[c].iloc[0] for c in keys}
        z = _scaled(x, x[inside])
        try:
            models = GaussianHmm.fit_all(z[inside], states, list(seeds), rounds, form=form)
        except FAILURES:  # one seed's start can fail where the others do not
            models = [None] * len(seeds)
        return pd.concat([told(part, inside, z, {"seed": int(s)} | head, m) for s, m in zip(seeds, models)], ignore_index=True)

    def told(part: pd.DataFrame, inside: np.ndarray, z: np.ndarray, head: dict, model: GaussianHmm | None) -> pd.DataFrame:
        try:
            model = model or GaussianHmm.fit(z[inside], states, head["seed"], rounds, form=form)
            path = model.viterbi(z[inside])
            stressed = stressed_state(path, part[level].to_numpy(float)[inside], states)
            prob = model.filtered(z)[:, stressed][~inside]
        except FAILURES as e:
            return pd.DataFrame([head | {order: None, "stressed_prob": None, "state": None, "converged": False, "error": f"{type(e).__name__}: {e}"[:200]}])
        out = pd.DataFrame({order: part[order].to_numpy()[~inside], "stressed_prob": prob})
        out["state"] = (out["stressed_prob"] >= 0.5).astype("int32")
        out["converged"] = len(model.log_likelihoods) < rounds
        out["error"] = "one state" if len(np.unique(path)) < 2 else None
        for c, v in head.items():
            out[c] = v
        return out[["seed", *keys, order, "stressed_prob", "state", "converged", "error"]]

    schema = "seed int, " + ", ".join(f"`{c}` {t}" for c, t in kind.items()) + ", stressed_prob double, state int, converged boolean, error string"
    return rows.groupBy(*keys).applyInPandas(fit, schema)


def in_sample(features: DataFrame, columns: Sequence[str], level: str, seed: int = 42, states: int = 2, rounds: int = 200, by: Sequence[str] = ("asset",), order: str = "d") -> DataFrame:
    """(*by, d, state): states of a fit to the whole series (most likely path). For comparison only: it sees the future."""
    names = list(dict.fromkeys([*columns, level]))
    rows = features.select(*by, order, *names)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        x = part[list(columns)].to_numpy(float)
        z = _scaled(x, x)
        path = GaussianHmm.fit(z, states, seed, rounds).viterbi(z)
        part["state"] = (path == stressed_state(path, part[level].to_numpy(float), states)).astype("int32")
        return part[[*by, order, "state"]]

    kind = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*by, order])
    return rows.groupBy(*by).applyInPandas(fit, f"{kind}, state int")
