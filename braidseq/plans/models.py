"""Hidden Markov models on the driver: at most a few hundred states, immutable, shipped to executors as they are."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Tolerance of sums, least variance, log-likelihood that stands for an impossible sequence.
EPS, LEAST_VARIANCE, PENALTY = 1e-8, 1e-4, -500.0


@dataclass(frozen=True)
class Model:
    """pi (n), a (classes, n, n), and emissions: b (n, m) for symbols, or c, mu, var (n, k) for Gaussian mixtures.

    A state whose emissions are all zero is silent. Order 1 and more widen b to (n, m ** (order + 1)), the row of a
    symbol being its history. labels number the states; fixed states keep their emissions in training; tied states
    share theirs. from_first: the path starts in state 0 before the first symbol, so pi is not used.
    """

    pi: np.ndarray
    a: np.ndarray
    b: np.ndarray | None = None
    c: np.ndarray | None = None
    mu: np.ndarray | None = None
    var: np.ndarray | None = None
    names: tuple = ()
    labels: tuple = ()
    fixed: tuple = ()
    tied: tuple = ()
    prior: float = 1.0
    order: int = 0
    from_first: bool = False
    cut: float | None = None
    extra: dict = field(default_factory=dict)

    @classmethod
    def of(cls, pi, a, b=None, **kw) -> Model:
        a = np.array(a, float)
        return cls(np.array(pi, float), a[None] if a.ndim == 2 else a, None if b is None else np.array(b, float), **{k: np.array(v, float) if k in ("c", "mu", "var") else v for k, v in kw.items()})

    @property
    def n(self) -> int:
        return len(self.pi)

    @property
    def symbols(self) -> int:
        return round(self.b.shape[1] ** (1 / (self.order + 1)))

    @property
    def silent(self) -> np.ndarray:
        return self.b.sum(axis=1) == 0 if self.b is not None else np.zeros(self.n, bool)

    def silent_order(self) -> list[int]:
        """Silent states in topological order of their transitions; those on a cycle come last, in order of number."""
        left, out = [int(s) for s in np.flatnonzero(self.silent)], []
        while left:
            free = [s for s in left if not any(self.a[0, p, s] > 0 for p in left if p != s)] or left[:1]
            out.append(free[0])
            left.remove(free[0])
        return out

    def problems(self) -> list[str]:
        """What is not stochastic."""
        out = [] if abs(self.pi.sum() - 1) <= EPS else ["pi"]
        out += [f"a[{k}] row {i}" for k in range(len(self.a)) for i in range(self.n) if self.a[k, i].sum() > 0 and abs(self.a[k, i].sum() - 1) > EPS]
        if self.b is not None:
            blocks = self.b.reshape(self.n, -1, self.symbols).sum(axis=2)
            out += [f"b row {i}" for i in range(self.n) if not self.silent[i] and np.any(np.abs(blocks[i][blocks[i] > 0] - 1) > EPS)]
        else:
            out += [f"c row {i}" for i in range(self.n) if abs(self.c[i].sum() - 1) > EPS]
            out += [f"var row {i}" for i in range(self.n) if np.any(self.var[i] <= 0)]
        return out

    def normalized(self) -> Model:
        def rows(x):
            s = x.sum(axis=-1, keepdims=True)
            return np.divide(x, s, out=np.zeros_like(x), where=s > 0)

        b = None if self.b is None else rows(self.b.reshape(self.n, -1, self.symbols)).reshape(self.b.shape)
        return replace(self, pi=rows(self.pi), a=rows(self.a), b=b)

    def with_noise(self, level: float, seed: int = 0) -> Model:
        rng = np.random.default_rng(seed)
        shake = lambda x: None if x is None else x * (1 - level + 2 * level * rng.random(x.shape))
        return replace(self, pi=shake(self.pi), a=shake(self.a), b=shake(self.b)).normalized()

    def with_background(self, background: np.ndarray, weight: float | np.ndarray) -> Model:
        w = np.broadcast_to(np.asarray(weight, float), (self.n,))[:, None]
        return replace(self, b=np.where(self.silent[:, None], self.b, (1 - w) * self.b + w * background))

    def with_duration(self, state: int, least: int) -> Model:
        """The state becomes a chain of `least` copies; the last of them has its loop and its ways out."""
        if self.silent.any():
            raise ValueError("a model with silent states can't take durations")
        n, m = self.n, self.n + least - 1
        a = np.zeros((len(self.a), m, m))
        a[:, :n, :n] = self.a
        chain = [state, *range(n, m)]
        a[:, chain[-1], :n] = self.a[:, state]
        a[:, chain[-1], chain[-1]] = self.a[:, state, state]
        if least > 1:
            a[:, chain[-1], state] = 0
            a[:, state, :] = 0
        for s, t in zip(chain[:-1], chain[1:]):
            a[:, s, t] = 1
        pi = np.concatenate([self.pi, np.zeros(least - 1)])
        return replace(self, pi=pi, a=a, b=np.concatenate([self.b, np.repeat(self.b[state : state + 1], least - 1, axis=0)]), names=(*self.names, *[f"{self.names[state]}_{i}" for i in range(1, least)]) if self.names else ())

    def without_silent(self) -> Model:
        """Every silent state replaced by edges from its sources to its targets; its loop's mass is shared among its targets."""
        a, pi, keep = self.a.copy(), self.pi.copy(), list(range(self.n))
        for s in np.flatnonzero(self.silent):
            out = a[:, s].copy()
            out[:, s] = 0
            total = out.sum(axis=1, keepdims=True)
            out = np.divide(out, total, out=np.zeros_like(out), where=total > 0)
            a = a + a[:, :, s][:, :, None] * out[:, None, :]
            pi = pi + pi[s] * out[0]
            a[:, :, s] = a[:, s, :] = 0
            pi[s] = 0
            keep.remove(int(s))
        pick = lambda t: tuple(t[i] for i in keep) if t else ()
        return replace(self, pi=pi[keep], a=a[:, keep][:, :, keep], b=self.b[keep], names=pick(self.names), labels=pick(self.labels), fixed=pick(self.fixed), tied=pick(self.tied)).normalized()

    def merged(self, other: Model, prefer_other: bool = False, least: float = 0.0) -> Model:
        """Full outer merge by state name, whatever its case; where both have a state one of them gives its emissions and edges."""
        mine, theirs = ({n.lower(): i for i, n in enumerate(m.names)} for m in (self, other))
        names = [*self.names, *[n for n in other.names if n.lower() not in mine]]
        at = {n.lower(): i for i, n in enumerate(names)}
        a, b, pi = np.zeros((1, len(names), len(names))), np.zeros((len(names), self.b.shape[1])), np.zeros(len(names))
        for n, i in at.items():
            use = (other, theirs) if n in theirs and (prefer_other or n not in mine) else (self, mine)
            b[i], pi[i] = use[0].b[use[1][n]], use[0].pi[use[1][n]]
            for t, p in zip(use[0].names, use[0].a[0, use[1][n]]):
                a[0, i, at[t.lower()]] = p if p > least else 0
        return Model(pi, a, b, names=tuple(names)).normalized()

    def edited(self, edges: dict | None = None, add: list | None = None, delete: list | None = None) -> Model:
        """add: (name, emissions); edges: {(source, target): p} by number or name; delete: names or numbers."""
        a, b, pi, names = self.a, self.b, self.pi, list(self.names or map(str, range(self.n)))
        for name, row in add or []:
            a = np.pad(a, ((0, 0), (0, 1), (0, 1)))
            b, pi = np.concatenate([b, np.array([row if row is not None else np.zeros(b.shape[1])])]), np.append(pi, 0)
            names.append(name)
        at = lambda x: x if isinstance(x, (int, np.integer)) else names.index(x)
        a = a.copy()
        for (s, t), p in (edges or {}).items():
            a[:, at(s), at(t)] = p
        keep = [i for i in range(len(names)) if i not in {at(x) for x in delete or []}]
        return replace(self, pi=pi[keep], a=a[:, keep][:, :, keep], b=b[keep], names=tuple(names[i] for i in keep))

    def compatible(self, other: Model) -> bool:
        return self.n == other.n and self.symbols == other.symbols and bool(((self.a > 0) == (other.a > 0)).all())

    def distance(self, other: Model) -> float:
        """Mean squared difference of all parameters."""
        parts = [(x - y).ravel() ** 2 for x, y in ((self.pi, other.pi), (self.a, other.a), (self.b, other.b))]
        return float(np.concatenate(parts).mean())

    def free_parameters(self) -> int:
        """Numbers that training can move."""
        n = int((self.pi > 0).sum()) - 1 + int((self.a > 0).sum()) - int((self.a.sum(axis=2) > 0).sum())
        if self.b is not None:
            return n + sum(int((self.b[i] > 0).sum()) - 1 for i in range(self.n) if not self.silent[i])
        return n + self.c.size - self.n + 2 * self.c.size


def left_right(symbols: list[int], m: int) -> Model:
    """A chain in which state i gives the i-th symbol."""
    n = len(symbols)
    return Model.of(np.eye(n)[0], np.eye(n, k=1), np.eye(m)[symbols])


def tables(spark: SparkSession, models: dict[int, Model]) -> dict[str, DataFrame]:
    """states, transitions, emissions (or components) of models by their ids."""
    states, edges, rows, parts = [], [], [], []
    for k, m in models.items():
        for i in range(m.n):
            states.append((k, i, m.names[i] if m.names else None, float(m.pi[i]), bool(m.silent[i]), m.labels[i] if m.labels else None))
            if m.b is not None:
                rows += [(k, i, j // m.symbols, j % m.symbols, float(p)) for j, p in enumerate(m.b[i])]
            else:
                parts += [(k, i, j, float(m.c[i, j]), float(m.mu[i, j]), float(m.var[i, j])) for j in range(m.c.shape[1])]
        edges += [(k, int(c), int(s), int(t), float(m.a[c, s, t])) for c, s, t in zip(*np.nonzero(m.a))]
    return {
        "states": spark.createDataFrame(states, "model_id int, state int, name string, pi double, silent boolean, label int"),
        "transitions": spark.createDataFrame(edges, "model_id int, class int, src int, dst int, p double"),
        "emissions": spark.createDataFrame(rows, "model_id int, state int, hist int, symbol int, p double"),
        "components": spark.createDataFrame(parts, "model_id int, state int, m int, c double, mue double, u double"),
    }


def from_tables(states: DataFrame, transitions: DataFrame, emissions: DataFrame, model_id: int) -> Model:
    """A model from its rows, which are as many as its parameters."""
    s = sorted(states.where(f"model_id = {int(model_id)}").collect(), key=lambda r: r["state"])
    n = len(s)
    a = np.zeros((1 + max((r[0] for r in transitions.where(f"model_id = {int(model_id)}").selectExpr("coalesce(max(class), 0)").collect()), default=0), n, n))
    for r in transitions.where(f"model_id = {int(model_id)}").collect():
        a[r["class"], r["src"], r["dst"]] = r["p"]
    e = emissions.where(f"model_id = {int(model_id)}").collect()
    m, h = 1 + max(r["symbol"] for r in e), 1 + max(r["hist"] for r in e)
    b = np.zeros((n, h * m))
    for r in e:
        b[r["state"], r["hist"] * m + r["symbol"]] = r["p"]
    order = round(np.log(h) / np.log(m)) if m > 1 else 0
    names = tuple(r["name"] for r in s) if all(r["name"] is not None for r in s) else ()
    return Model(np.array([r["pi"] for r in s]), a, b, names=names, order=order)


def normalized_transitions(transitions: DataFrame) -> DataFrame:
    """Rows of the transition table divided by the sum of their source: a window over (model, class, source)."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    total = F.sum("p").over(Window.partitionBy("model_id", "class", "src"))
    return transitions.withColumn("p", F.when(total > 0, F.col("p") / total).otherwise(0.0))
