"""Parts of SQL that several queries share: seeded number streams, least squares and eigenvectors, in plain SQL."""

from __future__ import annotations

from tidemark.operators.simulation import MULTIPLIER, SHIFTS, ZERO_SEED

_WRAP = 1 << 64


def states(seeds: list[int], n: int) -> str:
    """st(s, k, x): the states of the streams of some seeds after 0 to n numbers."""
    first = ", ".join(f"({i}, CAST('{(s % _WRAP) or ZERO_SEED}' AS UBIGINT))" for i, s in enumerate(seeds))
    a, b, c = SHIFTS
    return f"""st(s, k, x) AS (SELECT CAST(s AS BIGINT), CAST(0 AS BIGINT), x FROM (VALUES {first}) v(s, x) UNION ALL
    SELECT s, k + 1, xor(y, y >> {c}) FROM (SELECT s, k, xor(w, CAST(CAST(w AS HUGEINT) * {1 << b} % {_WRAP} AS UBIGINT)) AS y FROM (SELECT s, k, xor(x, x >> {a}) AS w FROM st WHERE k < {n})))"""


def uniforms(seeds: list[int], n: int) -> str:
    """u(s, k, u): n numbers in 0..1 of each stream, k from 0."""
    return f"{states(seeds, n)}, u AS (SELECT s, k - 1 AS k, CAST(CAST(CAST(x AS HUGEINT) * {MULTIPLIER} % {_WRAP} AS UBIGINT) >> 11 AS DOUBLE) / 9007199254740992.0 AS u FROM st WHERE k > 0)"


def normals(seeds: list[int], n: int) -> str:
    """z(s, i, z): n normals of each stream, i from 0, from two numbers each."""
    return f"""{uniforms(seeds, 2 * n)}, z AS (SELECT s, k // 2 AS i, sqrt(-2 * ln(greatest(max(CASE WHEN k % 2 = 0 THEN u END), 2.220446049250313e-16))) * cos(2 * pi() * max(CASE WHEN k % 2 = 1 THEN u END)) AS z FROM u GROUP BY 1, 2)"""


def gbm(seed: int, s0: float, mu: float, sigma: float, t: float, n_steps: int, n_paths: int) -> str:
    """g(path_id, step, value): paths of geometric Brownian motion."""
    dt = t / n_steps
    return f"""{normals([seed], n_steps * n_paths)}, l AS (SELECT i // {n_steps} AS path_id, i % {n_steps} + 1 AS step, ({mu!r} - {sigma!r} * {sigma!r} / 2) * {dt!r} + {sigma!r} * sqrt({dt!r}) * z AS x FROM z),
    g AS (SELECT path_id, step, {s0!r} * exp(sum(x) OVER (PARTITION BY path_id ORDER BY step)) AS value FROM l UNION ALL SELECT range AS path_id, 0 AS step, {s0!r} AS value FROM range({n_paths}))"""


def partial_slope(name: str, base: str, y: str, xs: list[str], target: str, constant: bool = True) -> str:
    """name(key, n, b, tt, sse): the coefficient of target in the regression of y on xs over the rows of base without nulls.

    y and target are freed of the other regressors one after another; tt is the rest of target's squares, sse of y's.
    """
    others, left, before = [x for x in xs if x != target], [y, *xs], f"{name}_0"
    free = (lambda v: f"{v} - avg({v}) OVER (PARTITION BY key) AS {v}") if constant else (lambda v: v)
    out = [f"{before} AS (SELECT key, {', '.join(map(free, left))} FROM {base} WHERE {' AND '.join(f'{v} IS NOT NULL' for v in left)})"]
    for k, o in enumerate(others, 1):
        left.remove(o)
        out.append(f"{name}_{k} AS (SELECT key, {', '.join(f'{v} - {o} * (sum({v} * {o}) OVER (PARTITION BY key) / sum({o} * {o}) OVER (PARTITION BY key)) AS {v}' for v in left)} FROM {before})")
        before = f"{name}_{k}"
    out.append(f"{name} AS (SELECT key, count(*) AS n, sum({y} * {target}) / sum({target} * {target}) AS b, sum({target} * {target}) AS tt, sum({y} * {y}) - sum({y} * {target}) * sum({y} * {target}) / sum({target} * {target}) AS sse FROM {before} GROUP BY key)")
    return ", ".join(out)


def least_squares(name: str, base: str, y: str, xs: list[str]) -> str:
    """name(key, n, a, b_..., sse, sst): the constant and coefficients of the regression of y on xs."""
    parts = [partial_slope(f"{name}_{x}", base, y, xs, x) for x in xs]
    good = " AND ".join(f"{v} IS NOT NULL" for v in [y, *xs])
    means = f"{name}_means AS (SELECT key, {', '.join(f'avg({v}) AS {v}' for v in [y, *xs])}, var_pop({y}) * count(*) AS sst FROM {base} WHERE {good} GROUP BY key)"
    joins = " ".join(f"JOIN {name}_{x} ON {name}_{x}.key = {name}_means.key" for x in xs)
    constant = f"{name}_means.{y}" + "".join(f" - {name}_{x}.b * {name}_means.{x}" for x in xs)
    one = f"{name} AS (SELECT {name}_means.key, {name}_{xs[0]}.n, {constant} AS a, {', '.join(f'{name}_{x}.b AS b_{x}' for x in xs)}, {name}_{xs[0]}.sse, {name}_means.sst FROM {name}_means {joins})"
    return ", ".join([*parts, means, one])


def wide(values: str = "r") -> str:
    """wide(idx, a1..a5): the panel's five assets by name, side by side."""
    return "named AS (SELECT *, dense_rank() OVER (ORDER BY asset) AS k FROM panel), wide AS (SELECT idx, 'all' AS key, " + ", ".join(f"max({values}) FILTER (k = {k}) AS a{k}" for k in range(1, 6)) + " FROM named GROUP BY idx)"


def components(n: int, rounds: int = 4000) -> str:
    """vec(c, k, v): the n leading eigenvectors of the panel's covariance (c from 0, asset k from 1), by powers and deflation."""
    names = [f"x{i}{j}" for i in range(1, 6) for j in range(1, 6)]
    out = [f"c0 AS (SELECT {', '.join(f'covar_samp(a{x[1]}, a{x[2]}) AS {x}' for x in names)} FROM wide)"]
    for c in range(n):
        image = ", ".join(f"x{i}1 * v1 + x{i}2 * v2 + x{i}3 * v3 + x{i}4 * v4 + x{i}5 * v5 AS w{i}" for i in range(1, 6))
        length = "sqrt(w1 * w1 + w2 * w2 + w3 * w3 + w4 * w4 + w5 * w5)"
        # Not quite equal entries, so that no eigenvector is at a right angle to the start.
        start = ", ".join(f"CAST({1 + 0.1 * i!r} AS DOUBLE) AS v{i}" for i in range(1, 6))
        out.append(f"p{c}(t, v1, v2, v3, v4, v5) AS (SELECT 0 AS t, {start} UNION ALL SELECT t + 1, {', '.join(f'w{i} / {length}' for i in range(1, 6))} FROM (SELECT t, {image} FROM p{c}, c{c} WHERE t < {rounds}))")
        sign = f"CASE WHEN (CASE WHEN abs(v1) > 1e-12 THEN v1 WHEN abs(v2) > 1e-12 THEN v2 WHEN abs(v3) > 1e-12 THEN v3 WHEN abs(v4) > 1e-12 THEN v4 ELSE v5 END) < 0 THEN -1.0 ELSE 1.0 END"
        out.append(f"e{c} AS (SELECT {', '.join(f'v{i} * {sign} AS v{i}' for i in range(1, 6))} FROM p{c} WHERE t = {rounds})")
        value = " + ".join(f"x{i}{j} * v{i} * v{j}" for i in range(1, 6) for j in range(1, 6))
        out.append(f"c{c + 1} AS (SELECT {', '.join(f'{x} - value * v{x[1]} * v{x[2]} AS {x}' for x in names)} FROM (SELECT *, {value} AS value FROM c{c}, e{c}))")
    rows = " UNION ALL ".join(f"SELECT {c} AS c, {k} AS k, v{k} AS v FROM e{c}" for c in range(n) for k in range(1, 6))
    return ", ".join([*out, f"vec AS ({rows})"])
