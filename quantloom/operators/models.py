"""Ridge and small neural models, fitted walk-forward by rebalance date."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import by_ticker


def moments(rows: DataFrame, columns: Sequence[str], target: str = "future_return") -> DataFrame:
    """Per label date: count, sums and cross products of the columns and the target: all that ridge needs of the rows."""
    xs = [*columns, target]
    terms = [F.count("*").cast("double").alias("n"), *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(xs)]]
    terms += [F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs) if i <= j]
    return rows.groupBy("label_available_date").agg(*terms)


def solve_ridge(n: float, sums: np.ndarray, products: np.ndarray, alpha: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(intercept, coefficients, means, deviations) of ridge on standardised columns, from moments; the last variable is the target."""
    mean = sums / n
    cov = products / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
    sd[sd <= 1e-12] = 1.0
    gram = n * cov[:-1, :-1] / np.outer(sd, sd) + alpha * np.eye(len(sd))
    beta = np.linalg.lstsq(gram, n * cov[:-1, -1] / sd, rcond=None)[0]
    return float(mean[-1]), beta, mean[:-1], sd


def ridge_models(rows: DataFrame, dates: DataFrame, columns: Sequence[str], alpha: float = 8.0, min_rows: int = 252) -> DataFrame:
    """(rebalance_date, train_rows, intercept, beta, mean, sd): one model a date, on labels known before its cutoff.

    ``dates``: rebalance_date and cutoff. Moments are summed over time by one
    window over label dates, so each model costs one small solve.
    """
    m = moments(rows, columns)
    names = [c for c in m.columns if c != "label_available_date"]
    w = Window.orderBy("d", "side").rowsBetween(Window.unboundedPreceding, 0)
    known = m.select(F.col("label_available_date").alias("d"), F.lit(1).alias("side"), F.lit(None).cast("date").alias("rebalance_date"), *names)
    asked = dates.select(F.col("cutoff").alias("d"), F.lit(0).alias("side"), "rebalance_date", *[F.lit(0.0).alias(c) for c in names])
    summed = known.unionByName(asked).select("side", "rebalance_date", *[F.sum(c).over(w).alias(c) for c in names]).where("side = 0").drop("side")
    k = len(columns) + 1

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            out = []
            for r in f.to_dict("records"):
                if not r["n"] >= min_rows:
                    continue
                p = np.zeros((k, k))
                for i in range(k):
                    for j in range(i, k):
                        p[i, j] = p[j, i] = r[f"p_{i}_{j}"]
                a, b, mean, sd = solve_ridge(r["n"], np.array([r[f"s_{i}"] for i in range(k)]), p, alpha)
                out.append((r["rebalance_date"], int(r["n"]), a, b.tolist(), mean.tolist(), sd.tolist()))
            yield pd.DataFrame(out, columns=["rebalance_date", "train_rows", "intercept", "beta", "mean", "sd"])

    return summed.mapInPandas(run, "rebalance_date date, train_rows long, intercept double, beta array<double>, mean array<double>, sd array<double>")


def predict_linear(frame: DataFrame, models: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of each model's rebalance date with predicted_return = intercept + sum of standardised values times beta."""
    x = F.zip_with(F.array(*[F.col(c) for c in columns]), F.arrays_zip("beta", "mean", "sd"), lambda v, m: (v - m["mean"]) / m["sd"] * m["beta"])
    joined = frame.join(F.broadcast(models), frame["date"] == models["rebalance_date"])
    return joined.withColumn("predicted_return", F.col("intercept") + F.aggregate(x, F.lit(0.0), lambda a, v: a + v)).drop("rebalance_date", "beta", "mean", "sd", "intercept")


def expanding_ridge(frame: DataFrame, dates: DataFrame, columns: Sequence[str], alpha: float = 8.0, min_rows: int = 252) -> DataFrame:
    """Candidates of each date with predicted_return and train_rows: a model on all labels known before the date, with no part kept back.

    ``frame``: the columns, future_return and label_available_date; rows without
    a label do not teach. Dates with fewer than ``min_rows`` labels have no model.
    """
    usable = frame.where("future_return is not null and label_available_date is not null")
    fitted = ridge_models(usable, dates.select(F.col("date").alias("rebalance_date"), F.col("date").alias("cutoff")), columns, alpha, min_rows)
    return predict_linear(frame, fitted, columns)


def sequences(frame: DataFrame, columns: Sequence[str], length: int) -> DataFrame:
    """Each row with ``sequence``: the vectors of its last ``length`` rows; rows without a whole one are left out."""
    w = by_ticker().rowsBetween(1 - length, 0)
    whole = F.forall(F.array(*[F.col(c) for c in columns]), lambda v: v.isNotNull() & ~F.isnan(v))
    vector = F.array(*[F.col(c).cast("float") for c in columns])
    out = frame.withColumn("sequence", F.collect_list(F.when(whole, vector)).over(w)).where(F.size("sequence") == length)
    return out


# --- small networks in numpy: one fit for each rebalance date ---------------


def _adam(params: list[np.ndarray], grads: list[np.ndarray], state: dict, rate: float) -> None:
    state["t"] = t = state.get("t", 0) + 1
    m, v = state.setdefault("m", [np.zeros_like(p) for p in params]), state.setdefault("v", [np.zeros_like(p) for p in params])
    for i, (p, g) in enumerate(zip(params, grads, strict=True)):
        m[i] = 0.9 * m[i] + 0.1 * g
        v[i] = 0.999 * v[i] + 0.001 * g * g
        p -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


class Mlp:
    """One tanh layer over the last vector of a sequence."""

    def __init__(self, shape: tuple[int, int], rng: np.random.Generator, hidden: int = 32) -> None:
        k = shape[1]
        self.params = [rng.normal(0, k**-0.5, (k, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def features(self, x: np.ndarray) -> np.ndarray:
        return x[:, -1]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        w, b, u, c = self.params
        f = self.features(x)
        h = np.tanh(f @ w + b)
        return h @ u + c[0], (f, h)

    def backward(self, d: np.ndarray, kept: tuple) -> list[np.ndarray]:
        f, h = kept
        z = np.outer(d, self.params[2]) * (1 - h * h)
        return [f.T @ z, z.sum(0), h.T @ d, np.array([d.sum()])]


class Tcn:
    """One tanh convolution over time, averaged, and a linear head."""

    def __init__(self, shape: tuple[int, int], rng: np.random.Generator, channels: int = 8, kernel: int = 5) -> None:
        self.kernel = min(kernel, shape[0])
        k = self.kernel * shape[1]
        self.params = [rng.normal(0, k**-0.5, (k, channels)), np.zeros(channels), rng.normal(0, channels**-0.5, channels), np.zeros(1)]

    def _windows(self, x: np.ndarray) -> np.ndarray:
        v = np.lib.stride_tricks.sliding_window_view(x, self.kernel, axis=1)
        return v.transpose(0, 1, 3, 2).reshape(len(x), -1, self.kernel * x.shape[2])

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        w, b, u, c = self.params
        f = self._windows(x)
        h = np.tanh(f @ w + b)
        pooled = h.mean(1)
        return pooled @ u + c[0], (f, h, pooled)

    def backward(self, d: np.ndarray, kept: tuple) -> list[np.ndarray]:
        f, h, pooled = kept
        z = d[:, None, None] * self.params[2] / h.shape[1] * (1 - h * h)
        return [np.einsum("ntk,ntc->kc", f, z), z.sum((0, 1)), pooled.T @ d, np.array([d.sum()])]


class Hybrid(Tcn):
    """The convolution beside a tanh layer over the last vector."""

    def __init__(self, shape: tuple[int, int], rng: np.random.Generator, channels: int = 8, kernel: int = 5, hidden: int = 16) -> None:
        super().__init__(shape, rng, channels, kernel)
        self.side = Mlp(shape, rng, hidden)
        self.params = [*self.params, *self.side.params]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        own, both = self.params[:4], self.params
        self.side.params = both[4:]
        self.params = own
        a, ka = super().forward(x)
        self.params = both
        b, kb = self.side.forward(x)
        return a + b, (ka, kb)

    def backward(self, d: np.ndarray, kept: tuple) -> list[np.ndarray]:
        both = self.params
        self.params = both[:4]
        a = super().backward(d, kept[0])
        self.params = both
        return [*a, *self.side.backward(d, kept[1])]


class Lstm:
    """One LSTM layer, read at its last step."""

    def __init__(self, shape: tuple[int, int], rng: np.random.Generator, hidden: int = 12) -> None:
        k = shape[1]
        self.h = hidden
        bias = np.zeros(4 * hidden)
        bias[hidden : 2 * hidden] = 1.0
        self.params = [rng.normal(0, k**-0.5, (k, 4 * hidden)), rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)), bias, rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        w, r, b, u, c = self.params
        h, s = np.zeros((len(x), self.h)), np.zeros((len(x), self.h))
        steps = []
        for t in range(x.shape[1]):
            g = x[:, t] @ w + h @ r + b
            i, f, o = (1 / (1 + np.exp(-np.clip(g[:, k * self.h : (k + 1) * self.h], -30, 30))) for k in (0, 1, 2))
            n = np.tanh(g[:, 3 * self.h :])
            s_new = f * s + i * n
            th = np.tanh(s_new)
            steps.append((x[:, t], h, s, i, f, o, n, th))
            h, s = o * th, s_new
        return h @ u + c[0], (steps, h)

    def backward(self, d: np.ndarray, kept: tuple) -> list[np.ndarray]:
        steps, last = kept
        w, r, _, u, _ = self.params
        gw, gr, gb = np.zeros_like(w), np.zeros_like(r), np.zeros(4 * self.h)
        dh, ds = np.outer(d, u), 0.0
        for x, h, s, i, f, o, n, th in reversed(steps):
            ds = ds + dh * o * (1 - th * th)
            z = np.concatenate([ds * n * i * (1 - i), ds * s * f * (1 - f), dh * th * o * (1 - o), ds * i * (1 - n * n)], axis=1)
            gw += x.T @ z
            gr += h.T @ z
            gb += z.sum(0)
            dh, ds = z @ r.T, ds * f
        return [gw, gr, gb, last.T @ d, np.array([d.sum()])]


class Attention:
    """Single-head attention of the last step over the sequence, with a linear head."""

    def __init__(self, shape: tuple[int, int], rng: np.random.Generator, dim: int = 4) -> None:
        k = shape[1]
        self.params = [*(rng.normal(0, k**-0.5, (k, dim)) for _ in range(3)), rng.normal(0, dim**-0.5, dim), np.zeros(1)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        wq, wk, wv, u, c = self.params
        q, k, v = x[:, -1] @ wq, x @ wk, x @ wv
        e = np.einsum("nd,ntd->nt", q, k) / np.sqrt(len(u))
        a = np.exp(e - e.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        z = np.einsum("nt,ntd->nd", a, v)
        return z @ u + c[0], (x, q, k, v, a, z)

    def backward(self, d: np.ndarray, kept: tuple) -> list[np.ndarray]:
        x, q, k, v, a, z = kept
        u = self.params[3]
        dz = np.outer(d, u)
        da = np.einsum("nd,ntd->nt", dz, v)
        de = a * (da - (a * da).sum(1, keepdims=True)) / np.sqrt(len(u))
        dq, dk, dv = np.einsum("nt,ntd->nd", de, k), de[:, :, None] * q[:, None, :], a[:, :, None] * dz[:, None, :]
        return [x[:, -1].T @ dq, np.einsum("ntk,ntd->kd", x, dk), np.einsum("ntk,ntd->kd", x, dv), z.T @ d, np.array([d.sum()])]


NETWORKS: dict[str, Callable] = {"mlp": Mlp, "tcn": Tcn, "hybrid": Hybrid, "lstm": Lstm, "transformer": Attention}


def fit_network(kind: str, x: np.ndarray, y: np.ndarray, xv: np.ndarray, yv: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 0.005, decay: float = 1e-4, patience: int = 12, clip: float | None = None, seed: int = 7) -> tuple[Callable[[np.ndarray], np.ndarray], float]:
    """A predictor with the parameters of the best validation epoch, and its error on raw validation targets.

    Inputs and targets are standardised on the training rows. ``clip``: share
    of training targets that stays unclipped in training and early stopping.
    """
    if clip is not None:
        low, high = np.quantile(y, [(1 - clip) / 2, 1 - (1 - clip) / 2])
        y, stop = np.clip(y, low, high), np.clip(yv, low, high)
    else:
        stop = yv
    flat = x.reshape(-1, x.shape[-1])
    mean, sd = flat.mean(0), flat.std(0)
    sd[sd == 0] = 1.0
    ym, ys = y.mean(), y.std() or 1.0
    scale = lambda a: (a - mean) / sd
    rng = np.random.default_rng(seed)
    net = NETWORKS[kind](x.shape[1:], rng)
    xs, ts, xvs, tvs = scale(x), (y - ym) / ys, scale(xv), (stop - ym) / ys
    best, kept, waited, state = np.inf, [p.copy() for p in net.params], 0, {}
    for _ in range(epochs):
        order = rng.permutation(len(xs))
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            out, memory = net.forward(xs[part])
            grads = net.backward(2 * (out - ts[part]) / len(part), memory)
            _adam(net.params, [g + decay * p for g, p in zip(grads, net.params, strict=True)], state, rate)
        error = float(np.mean((net.forward(xvs)[0] - tvs) ** 2))
        if error < best - 1e-9:
            best, kept, waited = error, [p.copy() for p in net.params], 0
        else:
            waited += 1
            if waited > patience:
                break
    net.params = kept

    def predict(a: np.ndarray) -> np.ndarray:
        return net.forward(scale(a))[0] * ys + ym

    return predict, float(np.mean((predict(xv) - yv) ** 2))


def network_predictions(rows: DataFrame, bounds: DataFrame, kind: str, live: DataFrame, max_rows: int = 200_000, **options: object) -> DataFrame:
    """(date, ticker, predicted_return, train_rows, validation_mse): one network for each usable rebalance date.

    ``rows``: sequence, future_return, date, label_available_date. Each date's
    rows train in one task, so a date with more than ``max_rows`` is an error
    rather than a silent sample.
    """
    asked = F.broadcast(bounds.where("usable").select("rebalance_date", "cutoff", "validation_start"))
    past = rows.join(asked, F.col("label_available_date") < F.col("cutoff"))
    known = past.select("rebalance_date", F.lit("").alias("ticker"), "sequence", "future_return", F.when(F.col("date") >= F.col("validation_start"), 1).otherwise(0).alias("part"))
    now = live.join(asked, live["date"] == asked["rebalance_date"]).select("rebalance_date", "ticker", "sequence", F.lit(0.0).alias("future_return"), F.lit(2).alias("part"))

    def run(f):
        import pandas as pd

        if len(f) > max_rows:
            raise ValueError("too many rows for one model")
        x = np.array([np.array([np.asarray(v, float) for v in s]) for s in f["sequence"]])
        y, part = f["future_return"].to_numpy(float), f["part"].to_numpy()
        if not (part == 2).any():
            return pd.DataFrame({"date": [], "ticker": [], "predicted_return": [], "train_rows": [], "validation_mse": []})
        predict, mse = fit_network(kind, x[part == 0], y[part == 0], x[part == 1], y[part == 1], **options)
        own = f[part == 2]
        return pd.DataFrame({"date": own["rebalance_date"], "ticker": own["ticker"], "predicted_return": predict(x[part == 2]), "train_rows": int((part == 0).sum()), "validation_mse": mse})

    return known.unionByName(now).groupBy("rebalance_date").applyInPandas(run, "date date, ticker string, predicted_return double, train_rows long, validation_mse double")
