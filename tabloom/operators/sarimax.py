"""Seasonal ARIMA with regressors for many series at once, by the exact likelihood of its state-space form.

The differenced series follows a linear regression on the differenced columns with errors from a multiplicative seasonal
ARMA process. A Kalman filter turns the series and every column into innovations; given the ARMA part, the coefficients and the
variance follow from their cross products, so only the ARMA part is searched for. Its partial autocorrelations are free
numbers behind a hyperbolic tangent, which keeps every trial stationary and invertible.

Series are cut into chunks of CHUNK rows, and a chunk is filtered without knowing the state it starts from: gains do not
depend on the data, and innovations and end state are linear in the start state. A chunk's summary is therefore a few
small matrices, and a series is the fold of its summaries in order, with the very result of one pass over the whole. Each step
of the search is one such pass for all series together: every trial point and its differences are filtered side by side.
A series of a single chunk takes all its steps in the task that holds the chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.ordering import framed, row_positions
from tabloom.session import checkpointed

CHUNK = 1 << 16
#: Most passes of a search, the change of the mean log-likelihood and the gradient at which it ends, the step of differences.
PASSES, ENOUGH, FLAT, STEP = 60, 1e-10, 1e-6, 1e-4


@dataclass(frozen=True)
class Spec:
    """Orders (p, d, q) and (P, D, Q, period), and the names of the regressors."""

    order: tuple[int, int, int]
    seasonal: tuple[int, int, int, int] = (0, 0, 0, 1)
    exog: tuple[str, ...] = ()

    @property
    def sizes(self) -> list[int]:
        return [self.order[0], self.order[2], self.seasonal[0], self.seasonal[2]]

    @property
    def constant(self) -> bool:
        """A constant is fitted where nothing is differenced, as a difference takes it out."""
        return self.order[1] + self.seasonal[1] == 0

    @property
    def differences(self) -> np.ndarray:
        """Weights of y(t), y(t - 1), ... in the differenced value."""
        out = np.ones(1)
        for times, lag in ((self.order[1], 1), (self.seasonal[1], self.seasonal[3])):
            for _ in range(times):
                out = np.convolve(out, np.eye(1, lag + 1)[0] - np.eye(1, lag + 1, lag)[0])
        return out

    def __str__(self) -> str:
        text = ",".join(map(str, self.order))
        return f"{text};{','.join(map(str, self.seasonal))}" if any(self.seasonal[:3]) else text


def stationary(free: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from free numbers, by the recursion over partial autocorrelations."""
    out = np.zeros(0)
    for r in np.tanh(free):
        out = np.append(out - r * out[::-1], r)
    return out


def coefficients(spec: Spec, free: np.ndarray) -> list[np.ndarray]:
    """ar, ma, seasonal ar, seasonal ma."""
    parts = np.split(free, np.cumsum(spec.sizes)[:-1])
    return [stationary(p) if i % 2 == 0 else -stationary(p) for i, p in enumerate(parts)]


def polynomials(spec: Spec, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of past values and of past shocks once the seasonal factors are multiplied out."""
    ar, ma, sar, sma = coefficients(spec, free)
    far = lambda c: np.append(1.0, np.kron(c, np.eye(1, spec.seasonal[3], spec.seasonal[3] - 1)[0])) if len(c) else np.ones(1)
    return -np.convolve(np.append(1.0, -ar), far(-sar))[1:], np.convolve(np.append(1.0, ma), far(sma))[1:]


class Filter:
    """Kalman filters of several trial points, side by side; gains go on from the start of the series."""

    def __init__(self, spec: Spec, points: np.ndarray) -> None:
        both = [polynomials(spec, p) for p in points]
        self.m = max(len(both[0][0]), len(both[0][1]) + 1)
        pad = lambda c, n: np.append(c, np.zeros(n - len(c)))
        self.ar = np.array([pad(a, self.m) for a, _ in both])
        self.shock = np.array([np.append(1.0, pad(b, self.m - 1)) for _, b in both])
        self.noise = self.shock[:, :, None] * self.shock[:, None, :]
        self.p = self._stationary()
        self.settled = False
        self.at = 0
        self._gain()

    def _moved(self, a: np.ndarray) -> np.ndarray:
        """Transition of (trials, m, columns): the first row times the weights, plus the rows below."""
        out = self.ar[:, :, None] * a[:, :1]
        out[:, :-1] += a[:, 1:]
        return out

    def _stationary(self) -> np.ndarray:
        """Covariance of the state before any observation, by doubling."""
        t = np.zeros((len(self.ar), self.m, self.m))
        t[:, :, 0] = self.ar
        t[:, np.arange(self.m - 1), np.arange(1, self.m)] += 1
        p = self.noise.copy()
        for _ in range(60):
            more = t @ p @ t.transpose(0, 2, 1)
            p = p + more
            if np.abs(more).max() <= 1e-15 * np.abs(p).max():
                break
            t = t @ t
        return p

    def _gain(self) -> None:
        self.f = self.p[:, 0, 0]
        self.k = self._moved(self.p[:, :, :1])[:, :, 0] / self.f[:, None]

    def advance(self) -> None:
        """The covariance and gain of the next row; they stay once they no longer change."""
        self.at += 1
        if self.settled:
            return
        moved = self._moved(self._moved(self.p).transpose(0, 2, 1)).transpose(0, 2, 1)
        new = moved + self.noise - self.k[:, :, None] * self.k[:, None, :] * self.f[:, None, None]
        self.settled = bool(np.abs(new - self.p).max() <= 1e-15 * np.abs(new).max())
        self.p = new
        self._gain()

    def summary(self, rows: np.ndarray, start: int) -> dict[str, np.ndarray]:
        """What a chunk of rows (n, columns) beginning at place `start` adds, as functions of the state before it.

        cross - bend' a - a' bend + a' turn a is the cross product of the innovations, end + map a the state behind it.
        """
        while self.at < start and not self.settled:
            self.advance()
        self.at = max(self.at, start)
        trials, columns = len(self.ar), rows.shape[1]
        a = np.zeros((trials, self.m, columns))
        known = start == 0  # the state before the series is zero
        map_ = np.zeros((trials, self.m, self.m)) if known else np.broadcast_to(np.eye(self.m), (trials, self.m, self.m)).copy()
        cross, log = np.zeros((trials, columns, columns)), np.zeros(trials)
        bend, turn = np.zeros((trials, self.m, columns)), np.zeros((trials, self.m, self.m))
        live = not known
        for row in rows:
            v = row - a[:, 0]
            cross += v[:, :, None] * v[:, None, :] / self.f[:, None, None]
            log += np.log(self.f)
            a = self._moved(a) + self.k[:, :, None] * v[:, None, :]
            if live:
                first = map_[:, 0]
                bend += first[:, :, None] * v[:, None, :] / self.f[:, None, None]
                turn += first[:, :, None] * first[:, None, :] / self.f[:, None, None]
                map_ = self._moved(map_) - self.k[:, :, None] * first[:, None, :]
                live = np.abs(map_).max() > 1e-200  # nothing of the start state is left
            self.advance()
        return {"cross": cross, "log": log, "bend": bend, "turn": turn, "map": map_ if live else np.zeros_like(map_), "end": a}


def fold(state: np.ndarray, cross: np.ndarray, part: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Add a chunk's cross products, given the state before it; the new state and sum."""
    t = state.transpose(0, 2, 1)
    bent = t @ part["bend"]
    cross = cross + part["cross"] - bent - bent.transpose(0, 2, 1) + t @ part["turn"] @ state
    return part["end"] + part["map"] @ state, cross


def likelihood(cross: np.ndarray, log: float, n: int) -> tuple[float, float, np.ndarray]:
    """Log-likelihood with coefficients and variance at their best, the variance, and the coefficients."""
    beta = np.linalg.lstsq(cross[1:, 1:], cross[1:, 0], rcond=None)[0] if len(cross) > 1 else np.zeros(0)
    rss = max(float(cross[0, 0] - cross[0, 1:] @ beta), 1e-300)
    return -0.5 * (n * (math.log(2 * math.pi * rss / n) + 1) + log), rss / n, beta


class Search:
    """Quasi-Newton search of one series; it asks for a point with its differences and takes their values."""

    def __init__(self, k: int, kept: list[float] | None = None) -> None:
        self.k = k
        flat = np.array(kept) if kept else np.zeros(0)
        if kept:
            self.value, self.scale, self.passes, self.done = float(flat[0]), float(flat[1]), int(flat[2]), bool(flat[3])
            self.at, self.slope, self.trial = flat[4 : 4 + 3 * k].reshape(3, k)
            self.inverse = flat[4 + 3 * k :].reshape(k, k)
        else:
            self.value, self.scale, self.passes, self.done = math.inf, 1.0, 0, False
            self.at, self.slope, self.trial = np.zeros((3, k))
            self.inverse = np.eye(k)

    def kept(self) -> list[float]:
        return [self.value, self.scale, float(self.passes), float(self.done), *self.at, *self.slope, *self.trial, *self.inverse.ravel()]

    def points(self) -> np.ndarray:
        """The trial point, and both neighbours along each axis; when done, the best point alone."""
        if self.done:
            return self.at[None, :]
        moves = STEP * np.eye(self.k)
        return np.concatenate([self.trial[None, :], self.trial + moves, self.trial - moves])

    def take(self, values: np.ndarray) -> None:
        self.passes += 1
        value, slope = float(values[0]), (values[1 : 1 + self.k] - values[1 + self.k :]) / (2 * STEP)
        step = self.trial - self.at
        if math.isinf(self.value) or value <= self.value + 1e-4 * float(self.slope @ step):
            gained, turn = self.value - value, slope - self.slope
            if not math.isinf(self.value) and step @ turn > 1e-12:
                rho = 1 / (step @ turn)
                if self.passes == 2:
                    self.inverse = self.inverse * (step @ turn) / (turn @ turn)
                left = np.eye(self.k) - rho * np.outer(step, turn)
                self.inverse = left @ self.inverse @ left.T + rho * np.outer(step, step)
            self.at, self.value, self.slope, self.scale = self.trial, value, slope, 1.0
            self.done = gained < ENOUGH or bool(np.abs(slope).max(initial=0) < FLAT)
        else:
            self.scale /= 4
            if self.scale < 1e-6:
                self.done = True
        way = -self.inverse @ self.slope
        if way @ self.slope >= 0:
            self.inverse, way = np.eye(self.k), -self.slope
        size = float(np.abs(way).max(initial=0))
        self.trial = self.at + self.scale * way * min(1.0, 1.0 / size if size else 1.0)
        self.done = self.done or self.passes >= PASSES


def chunked(df: DataFrame, keys: list[str], time: str, y: str, spec: Spec, size: int = CHUNK) -> DataFrame:
    """(keys..., chunk, start, rows): the differenced series and columns in blocks of at most `size` rows. Stored.

    Rows with a null in y or a regressor are left out before differencing.
    """
    names = [y, *spec.exog]
    whole = df.dropna(subset=names).select(*keys, time, *[F.col(c).cast("double").alias(c) for c in names])
    weights = spec.differences
    reach = len(weights) - 1
    if reach:
        used = [(j, float(w)) for j, w in enumerate(weights) if w]
        new = lambda w: {f"__{c}": sum((F.lit(x) * (F.lag(c, j).over(w) if j else F.col(c)) for j, x in used), F.lit(0.0)) for c in names}
        whole = framed(whole, keys, [time], reach, 0, new).where(F.col(f"__{y}").isNotNull())
        columns = [F.col(f"__{c}") for c in names]
    else:
        columns = [F.col(c) for c in names]
    row = F.array(columns[0], *([F.lit(1.0)] if spec.constant else []), *columns[1:])
    placed = row_positions(whole.select(*keys, time, row.alias("row")), keys, [time], "pos")
    cut = placed.withColumn("chunk", F.floor(F.col("pos") / size).cast("int"))
    blocks = cut.groupBy(*keys, "chunk").agg(F.min("pos").alias("start"), F.array_sort(F.collect_list(F.struct("pos", "row"))).alias("r"))
    return checkpointed(blocks.select(*keys, "chunk", "start", F.flatten(F.transform("r", lambda s: s["row"])).alias("rows")))


def _pass(chunks: DataFrame, states: DataFrame, keys: list[str], spec: Spec) -> DataFrame:
    """One step of every search that goes on: (keys..., search, found), `found` only once a search is done."""
    k = sum(spec.sizes)
    columns = 1 + spec.constant + len(spec.exog)
    parts = ("cross", "log", "bend", "turn", "map", "end")
    shape = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    key_schema = ", ".join(f"`{c}` {shape[c]}" for c in keys)
    ready = chunks.join(states.select(*[F.col(c).alias(f"_{c}") for c in keys], "search", "pieces"), _same_keys(keys)).drop(*[f"_{c}" for c in keys])

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                search = Search(k, one.column("search")[0].as_py())
                rows = one.column("rows").flatten().to_numpy(zero_copy_only=False).reshape(-1, columns)
                while one.column("pieces")[0].as_py() == 1 and not search.done:
                    part = Filter(spec, search.points()).summary(rows, 0)
                    search.take(np.array([-likelihood(c, x, len(rows))[0] / len(rows) for c, x in zip(part["cross"], part["log"])]))
                part = Filter(spec, search.points()).summary(rows, one.column("start")[0].as_py())
                flat = [np.concatenate([part[p].ravel() for p in parts]).tolist()]
                arrays = [*[one.column(c) for c in keys], one.column("chunk"), pa.array([search.kept()], pa.list_(pa.float64())), pa.array([len(rows)], pa.int64()), pa.array(flat, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "chunk", "search", "n", "part"])

    done = ready.mapInArrow(summaries, f"{key_schema}, chunk int, search array<double>, n long, part array<double>")
    order = [*keys, "chunk"]
    stream = done.repartition(*keys).sortWithinPartitions(*order)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        search = state = cross = log = n = None
        out: list[tuple] = []

        def closed() -> None:
            values = [likelihood(c, x, n) for c, x in zip(cross, log)]
            found = None
            if search.done:
                ll, variance, beta = values[0]
                own = state[0] @ np.append(1.0, -beta)
                found = [ll, variance, float(n), float(len(beta)), *beta, *own]
            else:
                search.take(np.array([-v[0] / n for v in values]))
            out.append((*now, search.kept(), found))

        for batch in batches:
            for row in batch.to_pylist():
                key = [row[c] for c in keys]
                if key != now:
                    if now is not None:
                        closed()
                    now, search, n = key, Search(k, row["search"]), 0
                    trials = len(search.points())
                    m = Filter(spec, search.points()[:1]).m
                    state, cross, log = np.zeros((trials, m, columns)), np.zeros((trials, columns, columns)), np.zeros(trials)
                shapes = [(trials, columns, columns), (trials,), (trials, m, columns), (trials, m, m), (trials, m, m), (trials, m, columns)]
                flat, part, at = np.array(row["part"]), {}, 0
                for name, s in zip(parts, shapes):
                    part[name] = flat[at : at + math.prod(s)].reshape(s)
                    at += math.prod(s)
                state, cross = fold(state, cross, part)
                log, n = log + part["log"], n + row["n"]
        if now is not None:
            closed()
        yield _batch(out, keys, batch_schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"{key_schema}, search array<double>, found array<double>"
    batch_schema = to_arrow_schema(_parse_datatype_string(schema))
    return stream.mapInArrow(folded, schema)


def _batch(rows: list[tuple], keys: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _same_keys(keys: list[str]):
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return on


def fit(df: DataFrame, keys: list[str], time: str, y: str, specs: Spec | list[Spec], size: int = CHUNK) -> DataFrame:
    """Per series the best of `specs` by AIC.

    (keys..., model, order, n, log_likelihood, aic, bic, sigma2, constant, exog, ar, ma, seasonal_ar, seasonal_ma, state);
    `model` is the number of the spec and `state` what forecasts start from. Series with fewer differenced rows than
    parameters are left out, as is any row with a null in y or a regressor. Columns fitted together are measured on their
    own differenced rows, so specs that differ in their differences have likelihoods of different data.
    """
    out = None
    for number, spec in enumerate([specs] if isinstance(specs, Spec) else specs):
        one = _fitted(chunked(df, keys, time, y, spec, size), keys, spec).withColumn("model", F.lit(number))
        out = one if out is None else out.unionByName(one)
    names = [c for c in out.columns if c not in keys]
    best = out.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct("aic", "model")).alias("s"))
    return best.select(*keys, "s.*")


def _fitted(chunks: DataFrame, keys: list[str], spec: Spec) -> DataFrame:
    k, columns = sum(spec.sizes), 1 + spec.constant + len(spec.exog)
    start = Search(k)
    start.done = k == 0
    sizes = chunks.groupBy(*keys).agg(F.sum(F.size("rows") / columns).alias("n"), F.count("*").alias("pieces"))
    sizes = checkpointed(sizes.where(F.col("n") > k + columns).drop("n"))
    states = sizes.select(*keys, F.array(*[F.lit(float(v)) for v in start.kept()]).alias("search"), "pieces")
    over = None
    while True:
        stepped = checkpointed(_pass(chunks, states, keys, spec))
        ended = stepped.where(F.col("found").isNotNull())
        over = ended if over is None else over.union(ended)
        states = stepped.where(F.col("found").isNull()).withColumn("pieces", F.lit(2))  # whole series are done after one pass
        if states.isEmpty():
            break
    schema = ("log_likelihood double, sigma2 double, n long, aic double, bic double, constant double, exog array<double>, ar array<double>, "
              "ma array<double>, seasonal_ar array<double>, seasonal_ma array<double>, state array<double>, free array<double>")

    @F.udf(schema)
    def told(search, found):
        free = Search(k, search).at
        ll, variance, n, b = found[0], found[1], int(found[2]), int(found[3])
        beta, parts = found[4 : 4 + b], [c.tolist() for c in coefficients(spec, free)]
        used = k + b + 1
        return (ll, variance, n, 2 * used - 2 * ll, math.log(n) * used - 2 * ll, beta[0] if spec.constant else 0.0, beta[int(spec.constant) :], *parts,
                found[4 + b :], free.tolist())

    told_ = over.withColumn("f", told("search", "found"))  # one row per series
    return checkpointed(told_.select(*keys, F.lit(str(spec)).alias("order"), "f.*"))


def forecast(df: DataFrame, keys: list[str], time: str, y: str, fits: DataFrame, specs: Spec | list[Spec], steps: int,
             future: DataFrame | None = None, alpha: float = 0.05) -> DataFrame:
    """(keys..., step, mean, lower, upper): `steps` rows ahead of the last row of every fitted series.

    `future` has the keys, `step` from 1 and the regressors; a fit with regressors forecasts no further than the steps
    for which all are known.
    """
    from tabloom.operators.forecast import _normal_quantile, _tail

    specs = [specs] if isinstance(specs, Spec) else list(specs)
    reach = max(1, max(len(s.differences) - 1 for s in specs))
    exog = sorted({c for s in specs for c in s.exog})
    last = _tail(df.dropna(subset=[y, *exog]), keys, time, [y, *exog], reach)
    ready = fits.join(last.select(*[F.col(c).alias(f"_{c}") for c in keys], "tail"), _same_keys(keys)).drop(*[f"_{c}" for c in keys])
    if exog:
        rows = future.where(F.col("step").between(1, steps)).dropna(subset=exog)
        ahead = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("step", *exog))).alias("ahead"))
        ready = ready.join(ahead.select(*[F.col(c).alias(f"_{c}") for c in keys], "ahead"), _same_keys(keys), "left").drop(*[f"_{c}" for c in keys])
    else:
        ready = ready.withColumn("ahead", F.lit(None).cast("array<struct<step:int>>"))
    width = _normal_quantile(1 - alpha / 2)

    @F.udf("array<struct<step:int,mean:double,lower:double,upper:double>>")
    def extended(model, free, state, sigma2, constant, beta, tail, ahead):
        spec = specs[model]
        ar, ma = polynomials(spec, np.array(free))
        weights = spec.differences
        past = [t[y] for t in tail]
        xs = {c: [t[c] for t in tail] for c in spec.exog}
        known = {a["step"]: a for a in ahead or []}
        a = np.array(state)
        full = -np.convolve(np.append(1.0, -ar), weights)[1:]  # weights of past values of y itself
        psi, spread, out = [1.0], 0.0, []
        for h in range(1, steps + 1):
            if spec.exog and h not in known:
                break
            w = a[0] + constant
            for c, b in zip(spec.exog, beta):
                xs[c].append(known[h][c])
                w += b * sum(g * xs[c][-1 - j] for j, g in enumerate(weights))
            past.append(w - sum(g * past[-j] for j, g in enumerate(weights) if j))
            spread += psi[h - 1] ** 2
            psi.append((ma[h - 1] if h <= len(ma) else 0.0) + sum(full[j] * psi[h - 1 - j] for j in range(min(h, len(full)))))
            error = width * math.sqrt(sigma2 * spread)
            out.append((h, float(past[-1]), float(past[-1] - error), float(past[-1] + error)))
            a = np.append(a[1:], 0.0) + np.append(ar, np.zeros(len(a) - len(ar))) * a[0]
        return out

    cells = extended("model", "free", "state", "sigma2", "constant", "exog", "tail", "ahead")
    return ready.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
