"""Seeded random streams, price paths and Monte Carlo prices, dealt out by path with exact jumps ahead in one stream."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: The generator's shifts, multiplier and the state that a seed of 0 stands for (fixed values).
SHIFTS, MULTIPLIER, ZERO_SEED = (12, 25, 27), 0x2545F4914F6CDD1D, 0x853C49E6748FEA9B
MASK = (1 << 64) - 1


def _step(x: int) -> int:
    x ^= x >> SHIFTS[0]
    x = (x ^ (x << SHIFTS[1])) & MASK
    return x ^ (x >> SHIFTS[2])


@functools.cache
def _powers() -> list[list[int]]:
    """The state's change after 2 ** k steps, as images of the 64 bits: a step is linear over bits."""
    one = [_step(1 << b) for b in range(64)]
    out = [one]
    for _ in range(63):
        out.append([_apply(out[-1], x) for x in out[-1]])
    return out


def _apply(images: list[int], x: int) -> int:
    y, b = 0, 0
    while x:
        if x & 1:
            y ^= images[b]
        x >>= 1
        b += 1
    return y


def state_after(seed: int, steps: int) -> int:
    """The generator's state after so many numbers, without making them."""
    x, k = (seed & MASK) or ZERO_SEED, 0
    while steps:
        if steps & 1:
            x = _apply(_powers()[k], x)
        steps >>= 1
        k += 1
    return x


def uniforms(states: np.ndarray, n: int) -> np.ndarray:
    """n numbers in 0..1 of each state's stream: the top 53 bits."""
    x, out = states.astype(np.uint64), np.empty((len(states), n))
    a, b, c = map(np.uint64, SHIFTS)
    for k in range(n):
        x = x ^ (x >> a)
        x = x ^ (x << b)
        x = x ^ (x >> c)
        out[:, k] = ((x * np.uint64(MULTIPLIER)) >> np.uint64(11)) * (1.0 / (1 << 53))
    return out


def normals(states: np.ndarray, n: int) -> np.ndarray:
    """n standard normals of each stream, from two uniforms each (the cosine half only)."""
    u = uniforms(states, 2 * n)
    return np.sqrt(-2 * np.log(np.maximum(u[:, 0::2], np.finfo(float).eps))) * np.cos(2 * np.pi * u[:, 1::2])


def _by_path(spark: SparkSession, n_paths: int, draws: int, seed: int, make, schema: str) -> DataFrame:
    """make(path ids, normals) for chunks of paths; path k has the stream's numbers from k * 2 * draws on."""

    def run(batches):
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            for at in range(0, len(ids), 1024):
                part = ids[at : at + 1024]
                states = np.array([state_after(seed, 2 * draws * int(i)) for i in part], np.uint64)
                yield make(part, normals(states, draws))

    return spark.range(n_paths).mapInPandas(run, schema)


def normal_draws(spark: SparkSession, draws: int, n_paths: int, seed: int) -> DataFrame:
    """path_id, z: so many normals of each path."""
    return _by_path(spark, n_paths, draws, seed, lambda ids, z: pd.DataFrame({"path_id": ids, "z": z.tolist()}), "path_id long, z array<double>")


def gbm_paths(spark: SparkSession, s0: float, mu: float, sigma: float, t: float, n_steps: int, n_paths: int, seed: int) -> DataFrame:
    """path_id, step, value: exact steps of geometric Brownian motion. No steps: just the first values."""
    if s0 <= 0 or sigma < 0 or t <= 0 or n_paths < 1 or n_steps < 0:
        raise ValueError("bad parameters")

    def make(ids, z):
        dt = t / max(1, n_steps)
        logs = np.cumsum((mu - sigma * sigma / 2) * dt + sigma * math.sqrt(dt) * z, axis=1) if n_steps else np.zeros((len(ids), 0))
        values = s0 * np.exp(np.c_[np.zeros(len(ids)), logs])
        return pd.DataFrame({"path_id": np.repeat(ids, n_steps + 1), "step": np.tile(np.arange(n_steps + 1), len(ids)), "value": values.ravel()})

    return _by_path(spark, n_paths, n_steps, seed, make, "path_id long, step long, value double")


def brownian(spark: SparkSession, n: int, dt: float, n_paths: int, seed: int) -> DataFrame:
    def make(ids, z):
        w = np.c_[np.zeros(len(ids)), np.cumsum(math.sqrt(dt) * z, axis=1)]
        return pd.DataFrame({"path_id": np.repeat(ids, n + 1), "step": np.tile(np.arange(n + 1), len(ids)), "value": w.ravel()})

    return _by_path(spark, n_paths, n, seed, make, "path_id long, step long, value double")


def terminal(spark: SparkSession, s0: float, mu: float, sigma: float, t: float, n_paths: int, seed: int, antithetic: bool = False) -> DataFrame:
    """path_id, value at t; antithetic: a second row for each path, with the normal turned round."""

    def make(ids, z):
        z = np.c_[z, -z] if antithetic else z
        v = s0 * np.exp((mu - sigma * sigma / 2) * t + sigma * math.sqrt(t) * z)
        return pd.DataFrame({"path_id": np.repeat(ids, z.shape[1]), "value": v.ravel()})

    return _by_path(spark, n_paths, 1, seed, make, "path_id long, value double")


def mc_price(spark: SparkSession, s0: float, k: float, r: float, sigma: float, t: float, n_paths: int, seed: int, is_call: bool = True, antithetic: bool = False) -> DataFrame:
    """One row: price, std_error (payoffs counted as independent) and n."""
    if min(s0, k, t) <= 0 or sigma < 0 or n_paths < 1:
        raise ValueError("bad parameters")
    gain = F.greatest((F.col("value") - k) * (1 if is_call else -1), F.lit(0.0)) * math.exp(-r * t)
    d = terminal(spark, s0, r, sigma, t, n_paths, seed, antithetic).select(gain.alias("g"))
    return d.agg(F.avg("g").alias("price"), (F.coalesce(F.stddev_samp("g"), F.lit(0.0)) / F.sqrt(F.count("g"))).alias("std_error"), F.count("g").alias("n"))


def ci_half_width(std_error="std_error", z: float = 1.96) -> Column:
    return z * F.col(std_error)


def coverage(spark: SparkSession, s0: float, k: float, r: float, sigma: float, t: float, n_paths: int, seeds: list[int], z: float = 1.96) -> DataFrame:
    """seed, price, std_error, covered: whether the exact price of a call lies in the interval around a Monte Carlo price, for each seed.

    The trials are one table of seeds, dealt out to tasks; a trial's paths are worked on in its task.
    """
    if min(s0, k, t) <= 0 or sigma < 0 or n_paths < 1:
        raise ValueError("bad parameters")

    def run(batches):
        for pdf in batches:
            rows = []
            for seed in pdf["seed"]:
                u = normals(np.array([state_after(int(seed), 0)], np.uint64), n_paths)[0]
                g = np.maximum(s0 * np.exp((r - sigma * sigma / 2) * t + sigma * math.sqrt(t) * u) - k, 0) * math.exp(-r * t)
                rows.append((seed, g.mean(), g.std(ddof=1) / math.sqrt(n_paths) if n_paths > 1 else 0.0))
            yield pd.DataFrame(rows, columns=["seed", "price", "std_error"])

    from tidemark.functions import options

    d = spark.createDataFrame([(s,) for s in seeds], "seed long").repartition("seed").mapInPandas(run, "seed long, price double, std_error double")
    exact = options.call_price(*(F.lit(float(x)) for x in (s0, k, r, sigma, t)))
    return d.withColumn("covered", F.abs(F.col("price") - exact) <= ci_half_width("std_error", z))


def euler_terminal(spark: SparkSession, s0: float, mu: float, sigma: float, t: float, n_steps: int, n_paths: int, seed: int) -> DataFrame:
    """path_id, value at t by Euler's rule, which terminal makes exactly."""
    if s0 <= 0 or t <= 0 or n_steps < 1 or n_paths < 1:
        raise ValueError("bad parameters")
    dt = t / n_steps
    return _by_path(spark, n_paths, n_steps, seed, lambda ids, z: pd.DataFrame({"path_id": ids, "value": s0 * np.prod(1 + mu * dt + sigma * math.sqrt(dt) * z, axis=1)}), "path_id long, value double")


def ar2(spark: SparkSession, phi1: float, phi2: float, n: int, n_paths: int, seed: int) -> DataFrame:
    """path_id, idx, value: begun by two normals, then phi1 and phi2 times the last two values and a normal."""

    def make(ids, z):
        x = z.copy()
        for k in range(2, n):
            x[:, k] += phi1 * x[:, k - 1] + phi2 * x[:, k - 2]
        return pd.DataFrame({"path_id": np.repeat(ids, n), "idx": np.tile(np.arange(n), len(ids)), "value": x.ravel()})

    return _by_path(spark, n_paths, n, seed, make, "path_id long, idx long, value double")


def applicants(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """row_id, features (credit score, debt to income and income, scaled) and defaulted of made-up loan applicants.

    Each takes six numbers of the stream: three features, two for the normal in the odds of default, and one for the outcome.
    """

    def run(batches):
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            u = uniforms(np.array([state_after(seed, 6 * int(i)) for i in ids], np.uint64), 6)
            credit, dti, income = 300 + 500 * u[:, 0], 0.05 + 0.45 * u[:, 1], 20_000 + 80_000 * u[:, 2]
            z = np.sqrt(-2 * np.log(np.maximum(u[:, 3], np.finfo(float).eps))) * np.cos(2 * np.pi * u[:, 4])
            p = 1 / (1 + np.exp(-(-3 + 0.004 * (600 - credit) + 6 * (dti - 0.2) + 0.1 * z)))
            features = np.stack([(credit - 600) / 100, (dti - 0.25) / 0.15, (income - 50_000) / 30_000], 1)
            yield pd.DataFrame({"row_id": ids, "features": features.tolist(), "defaulted": u[:, 5] < p})

    return spark.range(n).mapInPandas(run, "row_id long, features array<double>, defaulted boolean")


def asian_call(spark: SparkSession, s0: float, k: float, r: float, sigma: float, t: float, n_steps: int, n_paths: int, seed: int) -> DataFrame:
    mean = gbm_paths(spark, s0, r, sigma, t, n_steps, n_paths, seed).where("step > 0").groupBy("path_id").agg(F.avg("value").alias("a"))
    gain = F.greatest(F.col("a") - k, F.lit(0.0)) * math.exp(-r * t)
    return mean.agg(F.avg(gain).alias("price"), (F.stddev_samp(gain) / F.sqrt(F.count("a"))).alias("std_error"), F.count("a").alias("n"))


def mc_call_control(spark: SparkSession, s0: float, k: float, r: float, sigma: float, t: float, n_paths: int, seed: int) -> DataFrame:
    """One row: price, std_error, n of a call with the final price as the control, whose mean is known. Deviations are the population's."""
    if min(s0, k, t) <= 0 or sigma < 0 or n_paths < 1:
        raise ValueError("bad parameters")
    p = F.greatest(F.col("value") - k, F.lit(0.0))
    g = terminal(spark, s0, r, sigma, t, n_paths, seed).agg(F.avg(p).alias("p"), F.avg("value").alias("s"), F.covar_pop(p, "value").alias("c"), F.var_pop("value").alias("v"), F.var_pop(p).alias("w"), F.count("*").alias("n"))
    beta, keep = F.when(F.col("v") > 0, F.col("c") / F.col("v")).otherwise(0.0), math.exp(-r * t)
    rest = F.greatest(F.col("w") - 2 * beta * F.col("c") + beta * beta * F.col("v"), F.lit(0.0))
    return g.select((keep * (F.col("p") - beta * (F.col("s") - s0 * math.exp(r * t)))).alias("price"), (keep * F.sqrt(rest / F.col("n"))).alias("std_error"), "n")


def heston_calls(spark: SparkSession, s0: float, r: float, v0: float, kappa: float, theta: float, xi: float, rho: float, t: float, strikes: list[float], n_steps: int, n_paths: int, seed: int) -> DataFrame:
    """strike, price, std_error, n of calls under a mean-reverting variance, which steps by Euler's rule and is cut at 0.

    The price's normal is correlated (rho) with the variance's, and steps with the variance after its step.
    """
    if min(s0, t) <= 0 or v0 < 0 or not -1 <= rho <= 1 or n_steps < 1 or n_paths < 1:
        raise ValueError("bad parameters")

    def make(ids, z):
        dt, x, v = t / n_steps, np.zeros(len(ids)), np.full(len(ids), float(v0))
        for k in range(n_steps):
            a = z[:, 2 * k]
            b = rho * a + math.sqrt(1 - rho * rho) * z[:, 2 * k + 1]
            v = np.maximum(v + kappa * (theta - v) * dt + xi * np.sqrt(v * dt) * a, 0.0)
            x += (r - v / 2) * dt + np.sqrt(v * dt) * b
        return pd.DataFrame({"path_id": ids, "value": s0 * np.exp(x)})

    ends = _by_path(spark, n_paths, 2 * n_steps, seed, make, "path_id long, value double")
    d = ends.select(F.explode(F.array(*[F.lit(float(k)) for k in strikes])).alias("strike"), "value")
    gain = F.greatest(F.col("value") - F.col("strike"), F.lit(0.0)) * math.exp(-r * t)
    return d.groupBy("strike").agg(F.avg(gain).alias("price"), (F.coalesce(F.stddev_samp(gain), F.lit(0.0)) / F.sqrt(F.count("*"))).alias("std_error"), F.count("*").alias("n"))


def poisson_arrivals(rate: float, t: float, seed: int) -> np.ndarray:
    """Times below t of a Poisson process, from one stream."""
    if rate <= 0 or t <= 0:
        raise ValueError("rate and time must be positive")
    out, now, state = [], 0.0, np.array([state_after(seed, 0)], np.uint64)
    while True:
        u = uniforms(state, 256)[0]
        eps = np.finfo(float).eps
        times = now + np.cumsum(-np.log(1 - np.clip(u, eps, 1 - eps)) / rate)
        out.append(times[times < t])
        if len(out[-1]) < len(times):
            return np.concatenate(out)
        now, state = times[-1], np.array([state_after(int(state[0]), 256)], np.uint64)


def poisson_paths(spark: SparkSession, rate: float, t: float, n_paths: int, seed: int) -> DataFrame:
    """path_id, arrival: a row for each arrival; each path has a seed of its own."""

    def run(batches):
        for pdf in batches:
            for i in pdf["id"]:
                a = poisson_arrivals(rate, t, seed + 0x9E3779B97F4A7C15 * (int(i) + 1))
                yield pd.DataFrame({"path_id": np.full(len(a), i), "arrival": a})

    return spark.range(n_paths).mapInPandas(run, "path_id long, arrival double")


def poisson_counts(spark: SparkSession, rate: float, t: float, n_paths: int, seed: int) -> DataFrame:
    """path_id, n: the arrivals of each path of poisson_paths, paths without one included."""
    n = poisson_paths(spark, rate, t, n_paths, seed).groupBy("path_id").agg(F.count("*").alias("n"))
    return spark.range(n_paths).withColumnRenamed("id", "path_id").join(n, "path_id", "left").fillna(0, ["n"])


def poisson_grid(spark: SparkSession, rate: float, t: float, n_steps: int, n_paths: int, seed: int) -> DataFrame:
    """path_id, step, n: arrivals up to each of n_steps equal times, from 0."""
    if n_steps < 1:
        raise ValueError("at least one step")
    steps = spark.range(n_paths).select(F.col("id").alias("path_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_steps).cast("long"))).alias("step"))
    at = poisson_paths(spark, rate, t, n_paths, seed).groupBy("path_id", F.ceil(F.col("arrival") * n_steps / t).alias("step")).agg(F.count("*").alias("_n"))
    w = W.Window.partitionBy("path_id").orderBy("step").rowsBetween(W.Window.unboundedPreceding, 0)
    return steps.join(at, ["path_id", "step"], "left").select("path_id", "step", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("n"))


def random_jumps(spark: SparkSession, s0: float, mu: float, sigma: float, jump_rate: float, jump_sd: float, t: float, n_steps: int, n_paths: int, seed: int) -> DataFrame:
    """path_id, step, value: geometric Brownian motion with normal log jumps, as many a step as the inverse of the Poisson distribution gives.

    How many numbers a path takes depends on its jumps, so that each path has a seed of its own, as in poisson_paths.
    """
    if s0 <= 0 or t <= 0 or n_steps < 1 or n_paths < 1 or jump_rate < 0:
        raise ValueError("bad parameters")
    dt = t / n_steps

    def run(batches):
        for pdf in batches:
            for i in pdf["id"]:
                draw = _numbers(seed + 0x9E3779B97F4A7C15 * (int(i) + 1))
                logs = np.zeros(n_steps + 1)
                for k in range(1, n_steps + 1):
                    logs[k] = (mu - sigma * sigma / 2) * dt + sigma * math.sqrt(dt) * _normal(draw)
                    logs[k] += sum(jump_sd * _normal(draw) for _ in range(_poisson_quantile(next(draw), jump_rate * dt)))
                yield pd.DataFrame({"path_id": np.full(n_steps + 1, i), "step": np.arange(n_steps + 1), "value": s0 * np.exp(np.cumsum(logs))})

    return spark.range(n_paths).mapInPandas(run, "path_id long, step long, value double")


def _numbers(seed: int):
    """The numbers of one stream, one after another."""
    state = state_after(seed, 0)
    while True:
        yield from uniforms(np.array([state], np.uint64), 256)[0]
        state = state_after(state, 256)


def _normal(draw) -> float:
    a, b = next(draw), next(draw)
    return math.sqrt(-2 * math.log(max(a, float(np.finfo(float).eps)))) * math.cos(2 * math.pi * b)


def _poisson_quantile(u: float, mean: float, most: int = 101) -> int:
    """The least count whose distribution function isn't below u."""
    n, p = 0, math.exp(-mean)
    total = p
    while u > total and n < most:
        n += 1
        p *= mean / n
        total += p
    return n


def jump_terminal(spark: SparkSession, s0: float, mu: float, sigma: float, jump_rate: float, jump_mean: float, t: float, n_paths: int, seed: int) -> DataFrame:
    """path_id, value at t of jump_diffusion in a single step."""
    return jump_diffusion(spark, s0, mu, sigma, jump_rate, jump_mean, t, 1, n_paths, seed).where("step = 1").select("path_id", "value")


def jump_diffusion(spark: SparkSession, s0: float, mu: float, sigma: float, jump_rate: float, jump_mean: float, t: float, n_steps: int, n_paths: int, seed: int) -> DataFrame:
    """path_id, step, value: geometric Brownian motion with factors exp(jump_mean) at Poisson times, and no compensation."""
    dt = t / n_steps
    jumps = poisson_paths(spark, jump_rate, t, n_paths, seed).groupBy("path_id", F.least(F.ceil(F.col("arrival") / dt), F.lit(n_steps)).alias("at")).agg(F.count("*").alias("n"))
    paths = gbm_paths(spark, s0, mu, sigma, t, n_steps, n_paths, seed)
    w = W.Window.partitionBy("path_id").orderBy("step").rowsBetween(W.Window.unboundedPreceding, 0)
    d = paths.join(jumps.withColumnRenamed("at", "step"), ["path_id", "step"], "left")
    return d.select("path_id", "step", (F.col("value") * F.exp(jump_mean * F.coalesce(F.sum("n").over(w), F.lit(0)))).alias("value"))
