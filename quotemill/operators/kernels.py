"""State kernels: plain Python classes with one ``step`` per row.

The batch adapter runs them inside ``applyInPandas``, the streaming adapter inside
``transformWithStateInPandas``; one kernel serves both, so batch and stream agree.
"""

from __future__ import annotations

import math
import zlib
from collections import deque
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np


def water_fill(weights: np.ndarray, cap: float) -> np.ndarray:
    """Weights summing to one, none above the cap; unchanged where the cap cannot hold."""
    return np.array(_filled(np.asarray(weights, dtype=float).tolist(), cap))


def _filled(w: list[float], cap: float) -> list[float]:
    n, total = len(w), sum(w)
    if not total > 0:
        return w
    w = [x / total for x in w]
    if n <= 1 or cap * n < 1:
        return w
    order = sorted(range(n), key=lambda i: -w[i])
    tails, tail = [0.0] * n, 0.0
    for m in reversed(range(n)):
        tails[m] = tail = tail + w[order[m]]
    k = next((m for m in range(n) if tails[m] > 0 and w[order[m]] * (1 - m * cap) / tails[m] <= cap + 1e-15), 0)
    if k:
        scale = (1 - k * cap) / tails[k]
        for m, i in enumerate(order):
            w[i] = cap if m < k else w[i] * scale
    return w


@dataclass
class Ema:
    alpha: float
    value: float | None = None

    def __post_init__(self) -> None:
        if not 0 < self.alpha <= 1:
            raise ValueError("alpha must be in (0, 1]")

    def step(self, x: float) -> float:
        self.value = x if self.value is None else self.alpha * x + (1 - self.alpha) * self.value
        return self.value


class Observation(NamedTuple):
    name: str
    value: float
    variance: float
    age_ms: float = 0.0
    valid: bool = True
    perp: bool = False


def live(observations: list[Observation], cutoff_ms: float) -> list[Observation]:
    return [o for o in observations if o.valid and math.isfinite(o.value) and math.isfinite(o.variance) and o.age_ms <= cutoff_ms]


@dataclass
class FusedKalman:
    """Random-walk filter on a capped inverse-variance fusion with per-venue reliability."""

    initial_variance: float = 25.0
    q_base: float = 0.05
    q_scale: float = 1.0
    r_floor: float = 0.01
    variance_floor: float = 1e-4
    disagreement: float = 1.0
    cutoff_ms: float = 750.0
    age_scale: float = 2.0
    move_alpha: float = 0.05
    cap: float = 0.75
    memory: float = 0.98
    severity: float = 1.0
    z2_clip: float = 25.0
    penalty_max: float = 20.0
    x: float | None = None
    p: float = 0.0
    at: float | None = None
    fused: float | None = None
    move: float = 0.0
    surprise: dict[str, float] = field(default_factory=dict)

    def _fuse(self, obs: list[Observation]):
        # a handful of venues: plain numbers, as arrays cost more than what they do here
        span = max(self.cutoff_ms, 1.0)
        base = [max(o.variance, self.variance_floor) * (1 + self.age_scale * (o.age_ms / span) ** 2) for o in obs]
        penalty = [min(max(1 + self.severity * max(self.surprise.get(o.name, 1.0) - 1, 0), 1), self.penalty_max) for o in obs]
        effective = [b * p for b, p in zip(base, penalty)]
        weights = _filled([1 / e for e in effective], self.cap)
        z = sum([w * o.value for w, o in zip(weights, obs)])
        r = max(self.r_floor, sum([w * w * e for w, e in zip(weights, effective)]) + self.disagreement * sum([w * (o.value - z) ** 2 for w, o in zip(weights, obs)]))
        return base, weights, z, r

    def step(self, at: float, observations: list[Observation]) -> dict | None:
        obs = live(observations, self.cutoff_ms)
        if not obs:
            return None
        base, weights, z, r = self._fuse(obs)
        if self.x is None:
            self.x, self.p, gain, q = z, self.initial_variance, 1.0, 0.0
        else:
            dt = max(at - self.at, 1e-3) if self.at is not None else 0.0
            if self.fused is not None:
                self.move = self.move_alpha * (z - self.fused) ** 2 / max(dt, 1e-3) + (1 - self.move_alpha) * self.move
            q = max(1e-8, (self.q_base + self.q_scale * self.move) * dt)
            prior, spread = self.x, self.p + q
            gain = spread / (spread + r)
            self.x, self.p = prior + gain * (z - prior), (1 - gain) * spread
            for o, b in zip(obs, base):
                z2 = min((o.value - prior) ** 2 / max(b + spread, 1e-12), self.z2_clip)
                self.surprise[o.name] = self.memory * self.surprise.get(o.name, 1.0) + (1 - self.memory) * z2
        self.at, self.fused = at, z
        return {"price": self.x, "fused": z, "gain": gain, "q": q, "r": r, "p": self.p, "weights": dict(zip([o.name for o in obs], weights))}


@dataclass
class BasisKalman:
    """Common price plus a mean-reverting basis for every venue but the anchor."""

    anchor: str
    order: tuple[str, ...] = ()
    perp_order: tuple[str, ...] = ()
    need_anchor: bool = True
    least_spot: int = 1
    q_common: float = 2.0
    q_basis: float = 0.01
    q_perp: float = 0.25
    rho: float = 0.98
    rho_perp: float = 0.995
    initial_common: float = 25.0
    initial_basis: float = 100.0
    cutoff_ms: float = 750.0
    variance_floor: float = 1e-4
    floor: float = 1e-10
    x: np.ndarray | None = None
    P: np.ndarray | None = None
    at: float | None = None
    spot: set[str] = field(default_factory=set)
    perp: set[str] = field(default_factory=set)
    index: dict[str, int] = field(default_factory=dict)
    shapes: dict[tuple[str, ...], np.ndarray] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"shapes": {}}

    def __post_init__(self) -> None:
        if not self.anchor or self.anchor in self.perp_order or self.least_spot < 1 or not (0 <= self.rho <= 1 and 0 <= self.rho_perp <= 1):
            raise ValueError("bad configuration")

    def _steady(self, m: np.ndarray, floor: float) -> np.ndarray:
        m = (m + m.T) / 2
        m.flat[:: len(m) + 1] = np.maximum(m.diagonal(), floor)
        return m

    def _layout(self, obs: list[Observation]) -> None:
        spot, perp = {o.name for o in obs if not o.perp}, {o.name for o in obs if o.perp}
        if self.index and spot <= self.spot | {self.anchor} and perp <= self.perp:
            return
        self.spot |= spot
        self.perp |= perp
        known = [v for v in self.order if v != self.anchor]
        names = known + sorted(self.spot - set(known) - {self.anchor})
        names += [*self.perp_order, *sorted(self.perp - set(self.perp_order))]
        new = {v: i + 1 for i, v in enumerate(names)}
        if self.x is not None:
            x, P = np.zeros(len(names) + 1), np.zeros((len(names) + 1,) * 2)
            moved = [(0, 0), *((old, new[v]) for v, old in self.index.items())]
            a, b = np.array([m[0] for m in moved]), np.array([m[1] for m in moved])
            x[b] = self.x[a]
            P[np.ix_(b, b)] = self.P[np.ix_(a, a)]
            for v, i in new.items():
                if v not in self.index:
                    P[i, i] = self.initial_basis
            self.x, self.P = x, self._steady(P, self.floor)
        self.index, self.shapes = new, {}

    def _shape(self, obs: list[Observation]) -> tuple[np.ndarray, ...]:
        """What venues these are in the state, and every state's decay and walk a second: made once for a layout."""
        names = tuple([o.name for o in obs])
        if names not in self.shapes:
            perp = np.array([False, *(v in self.perp or v in self.perp_order for v in self.index)])
            decay, walk = np.where(perp, self.rho_perp, self.rho), np.where(perp, self.q_perp, self.q_basis)
            decay[0], walk[0] = 1.0, self.q_common
            H = np.zeros((len(obs), len(perp)))
            H[:, 0] = 1
            for k, v in enumerate(names):
                if v in self.index:
                    H[k, self.index[v]] = 1
            self.shapes[names] = H, decay, walk, np.eye(len(perp))
        return self.shapes[names]

    def step(self, at: float, observations: list[Observation]) -> dict | None:
        obs = live(observations, self.cutoff_ms)
        if sum(not o.perp for o in obs) < self.least_spot:
            return None
        anchored = [o.value for o in obs if o.name == self.anchor]
        if self.x is None and self.need_anchor and not anchored:
            return None
        self._layout(obs)
        R = np.array([max(o.variance, 1e-8, self.variance_floor) for o in obs])
        y = np.array([o.value for o in obs])
        if self.x is None:
            self.x = np.zeros(len(self.index) + 1)
            self.x[0] = anchored[0] if anchored else float((y / R).sum() / (1 / R).sum())
            self.P = np.diag(np.maximum([self.initial_common, *[self.initial_basis] * len(self.index)], self.floor))
        dt = max(at - self.at, 1e-3) if self.at is not None else 0.0
        H, rates, walk, one = self._shape(obs)
        decay = rates**dt
        prior = decay * self.x
        P = decay[:, None] * self.P * decay
        P.flat[:: len(P) + 1] += np.maximum(walk * dt, self.floor)
        P = self._steady(P, self.floor)
        innovation = y - H @ prior
        HP = H @ P
        S = HP @ H.T
        S.flat[:: len(S) + 1] += R
        K = np.linalg.solve(self._steady(S, 1e-8), HP).T
        A = one - K @ H
        self.x, self.P, self.at = prior + K @ innovation, self._steady(A @ P @ A.T + (K * R) @ K.T, self.floor), at
        sd, x = np.sqrt(np.maximum(self.P.diagonal(), 0)).tolist(), self.x.tolist()
        return {"price": x[0], "stddev": sd[0], "trace": float(self.P.trace()), "basis": {self.anchor: 0.0, **{v: x[i] for v, i in self.index.items()}}, "basis_stddev": {self.anchor: 0.0, **{v: sd[i] for v, i in self.index.items()}}, "innovations": dict(zip([o.name for o in obs], innovation.tolist()))}


@dataclass
class BetaKalman:
    """Regression coefficients that walk at random: predict, score, then learn from the outcome."""

    n: int
    q: np.ndarray
    r: float
    beta: np.ndarray | None = None
    P: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.beta = np.zeros(self.n) if self.beta is None else self.beta
        self.P = np.eye(self.n) if self.P is None else self.P
        self._walk = np.diag(self.q)

    def predict(self, x: np.ndarray) -> float:
        return float(x @ self.beta)

    def learn(self, x: np.ndarray, y: float) -> None:
        P = self.P + self._walk
        k = P @ x / (x @ P @ x + self.r)
        self.beta = self.beta + k * (y - x @ self.beta)
        self.P = P - np.outer(k, x @ P)


class Book:
    """Price levels of one market: absolute sizes, zero deletes; optional depth and checksum."""

    def __init__(self, depth: int | None = None, sequenced: bool = False, checked: bool = False):
        self.depth, self.sequenced, self.checked = depth, sequenced, checked
        self.reset()

    def reset(self) -> None:
        self.sides: dict[str, dict] = {"buy": {}, "sell": {}}
        self.ready, self.last = False, None

    def _apply(self, levels: list[tuple]) -> None:
        for side, price, size, *text in levels:
            if size <= 0:
                self.sides[side].pop(price, None)
            else:
                self.sides[side][price] = (size, *text)
        if self.depth:
            for side in self.sides:
                keep = sorted(self.sides[side], reverse=side == "buy")[: self.depth]
                self.sides[side] = {p: self.sides[side][p] for p in keep}

    def checksum(self) -> int:
        """CRC32 over the ten best asks, then bids: digits of price and size, leading zeros off."""
        digits = lambda t: str(t).replace(".", "").lstrip("0") or "0"
        out = []
        for side in ("sell", "buy"):
            for price in sorted(self.sides[side], reverse=side == "buy")[:10]:
                size, *text = self.sides[side][price]
                p, s = text if text else (price, size)
                out.append(digits(p) + digits(s))
        return zlib.crc32("".join(out).encode())

    def step(self, kind: str, levels: list[tuple], sequence: int | None = None, checksum: int | None = None) -> str:
        """'ok', 'dropped' or 'resync'; a resync waits for the next snapshot."""
        if kind == "snapshot":
            self.reset()
            self._apply(levels)
            self.ready, self.last = True, sequence
        else:
            if not self.ready:
                return "dropped"
            if self.sequenced and sequence is not None:
                if self.last is None or sequence != self.last + 1:
                    self.reset()
                    return "resync"
                self.last = sequence
            self._apply(levels)
        if self.checked and checksum is not None and checksum != self.checksum():
            self.reset()
            return "resync"
        return "ok"

    def best(self) -> tuple:
        bid, ask = (max(self.sides["buy"], default=None), min(self.sides["sell"], default=None))
        return bid, self.sides["buy"][bid][0] if bid is not None else None, ask, self.sides["sell"][ask][0] if ask is not None else None


@dataclass
class DelayedBeta:
    """Coefficients that learn from outcomes only once a horizon has passed.

    ``step``: outcomes that are due by ``now`` are learned first, in order, as changes
    of the price since they were asked for; then the present features are scored and
    put in the queue. Features are centred and scaled as in calibration.
    """

    beta: BetaKalman
    mean: np.ndarray
    scale: np.ndarray
    horizon_ms: int
    waiting: deque = field(default_factory=deque)

    def standardised(self, features: list[float]) -> np.ndarray:
        return np.concatenate([[1.0], (np.asarray(features, dtype=float) - self.mean) / self.scale])

    def step(self, now: int, price: float, features: list[float]) -> float:
        while self.waiting and self.waiting[0][0] <= now:
            _, x, then = self.waiting.popleft()
            self.beta.learn(x, price - then)
        x = self.standardised(features)
        self.waiting.append((now + self.horizon_ms, x, price))
        return self.beta.predict(x)


#: Steps of the loose pass that are held at a time.
_CHUNK = 10_000


def calibrate(X: np.ndarray, y: np.ndarray, *, loose: float = 1e-4, bounds: tuple[float, float] = (1e-12, 1e2)) -> tuple[BetaKalman, np.ndarray, np.ndarray]:
    """Coefficients by least squares on standardised features, with the walk seen in a loose first pass; mean and scale.

    The walk of a coefficient is the variance of its changes after the first quarter
    (200 rows at most) of that pass; both passes start from unit uncertainty.
    """
    mean, scale = X.mean(axis=0), X.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    Z = np.column_stack([np.ones(len(y)), (X - mean) / scale])
    start = np.linalg.lstsq(Z, y, rcond=None)[0]
    r = float(np.var(y - Z @ start)) or 1.0
    kernel = BetaKalman(Z.shape[1], np.full(Z.shape[1], loose), r, start.copy())
    burn = min(200, len(y) // 4)
    n, centre, spread, last = 0, np.zeros(Z.shape[1]), np.zeros(Z.shape[1]), []
    for at in range(0, len(y), _CHUNK):  # the path is summed up as it goes: it is as long as the history
        path = []
        for x, v in zip(Z[at : at + _CHUNK], y[at : at + _CHUNK]):
            kernel.learn(x, v)
            path.append(kernel.beta)
        moves = np.diff(np.array([*last, *path[max(burn - at, 0) :]]).reshape(-1, Z.shape[1]), axis=0)
        last = path[-1:] if at + len(path) > burn else []
        if len(moves):
            total, off = n + len(moves), moves.mean(axis=0) - centre
            spread = spread + moves.var(axis=0) * len(moves) + off**2 * (n * len(moves) / total)
            n, centre = total, centre + off * (len(moves) / total)
    q = np.clip(spread / max(n, 1), *bounds)
    return BetaKalman(Z.shape[1], q, r, start.copy()), mean, scale
