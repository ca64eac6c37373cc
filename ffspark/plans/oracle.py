"""DuckDB SQL of the network's steps in long form: one row per sample and node."""

from __future__ import annotations

from ffspark.plans.fixtures import SOURCE, SQL


def r6(expr: str) -> str:
    """Rounded alike in both engines: -0.0 becomes 0.0."""
    return f"round({expr}, 6) + 0.0"


def fixed_params(layers: list[int], tag: str = "0") -> list[str]:
    out = []
    for l in range(1, len(layers)):
        a, b = layers[l - 1], layers[l]
        out.append(f"w{l}_{tag} AS MATERIALIZED (SELECT i, j, ((31*i + 17*j + 7*{l}) % 21 - 10)::DOUBLE / 50 + sqrt(2 + i + 3*j + 5*{l}) / 97 AS v FROM range({a}) t(i), range({b}) u(j))")
        out.append(f"b{l}_{tag} AS MATERIALIZED (SELECT j, ((13*j + 5*{l}) % 11 - 5)::DOUBLE / 50 + sqrt(3 + j + 2*{l}) / 89 AS v FROM range({b}) u(j))")
    return out


def samples(name: str) -> list[str]:
    x, y = SQL[name]
    return [f"{SOURCE.get(name, '')}x AS MATERIALIZED ({x}), y AS MATERIALIZED ({y})"]


def forward(layers: list[int], tag: str = "0", x: str = "x", out: str = "") -> list[str]:
    """z<l> and a<l> tables, suffixed with ``tag``."""
    parts, before = [], x
    for l in range(1, len(layers)):
        z, a = f"z{l}_{out or tag}", f"a{l}_{out or tag}"
        parts.append(f"{z} AS MATERIALIZED (SELECT p.sid, w.j AS i, sum(p.v * w.v) + any_value(b.v) AS v FROM {before} p JOIN w{l}_{tag} w ON p.i = w.i JOIN b{l}_{tag} b ON b.j = w.j GROUP BY 1, 2)")
        act = "1 / (1 + exp(-v))" if l == len(layers) - 1 else "CASE WHEN v < 0 THEN 0.0 ELSE v END"
        parts.append(f"{a} AS MATERIALIZED (SELECT sid, i, {act} AS v FROM {z})")
        before = a
    return parts


def gradient(layers: list[int], tag: str = "0", x: str = "x", y: str = "y", mult: str = "") -> list[str]:
    """gw<l> and gb<l>: mean gradients over the samples of x, and cost_<tag>. ``mult`` names a table (sid, m)."""
    parts, depth = forward(layers, tag, x), len(layers) - 1
    parts.append(f"d{depth}_{tag} AS MATERIALIZED (SELECT a.sid, a.i AS j, a.v * (1 - a.v) * (a.v - t.v) AS v FROM a{depth}_{tag} a JOIN {y} t ON a.sid = t.sid AND a.i = t.j)")
    for l in range(depth - 1, 0, -1):
        parts.append(
            f"d{l}_{tag} AS MATERIALIZED (SELECT d.sid, w.i AS j, sum(w.v * d.v) * any_value(CASE WHEN z.v < 0 THEN 0.0 ELSE 1.0 END) AS v FROM d{l + 1}_{tag} d JOIN w{l + 1}_{tag} w ON d.j = w.j JOIN z{l}_{tag} z ON z.sid = d.sid AND z.i = w.i GROUP BY 1, 2)"
        )
    m = f"JOIN {mult} m ON m.sid = d.sid" if mult else ""
    weight, n = ("* m.m", f"(SELECT sum(m) FROM {mult})") if mult else ("", f"(SELECT count(DISTINCT sid) FROM {x})")
    for l in range(1, depth + 1):
        before = x if l == 1 else f"a{l - 1}_{tag}"
        parts.append(f"gw{l}_{tag} AS MATERIALIZED (SELECT p.i, d.j, sum(p.v * d.v {weight}) / {n} AS v FROM {before} p JOIN d{l}_{tag} d ON p.sid = d.sid {m} GROUP BY 1, 2)")
        parts.append(f"gb{l}_{tag} AS MATERIALIZED (SELECT d.j, sum(d.v {weight}) / {n} AS v FROM d{l}_{tag} d {m} GROUP BY 1)")
    parts.append(
        f"cost_{tag} AS MATERIALIZED (SELECT sum((t.v - d.v) * (t.v - d.v) {weight}) / {n} / {layers[-1]} AS v FROM a{depth}_{tag} d JOIN {y} t ON d.sid = t.sid AND d.i = t.j {m})"
    )
    return parts


def momentum(layers: list[int], k: int, eta: float = 0.005, gamma: float = 0.9) -> list[str]:
    """Parameters and deltas of iteration k + 1 from those of k and the gradients of k; and the mean rate rate_<k>."""
    parts, rates = [], []
    for l in range(1, len(layers)):
        old = f"{gamma} * coalesce((SELECT d.v FROM mw{l}_{k} d WHERE d.i = g.i AND d.j = g.j), 0)" if k else "0"
        old_b = f"{gamma} * coalesce((SELECT d.v FROM mb{l}_{k} d WHERE d.j = g.j), 0)" if k else "0"
        parts.append(f"mw{l}_{k + 1} AS MATERIALIZED (SELECT i, j, {eta}::DOUBLE * g.v + {old} AS v FROM gw{l}_{k} g)")
        parts.append(f"mb{l}_{k + 1} AS MATERIALIZED (SELECT j, {eta}::DOUBLE * g.v + {old_b} AS v FROM gb{l}_{k} g)")
        parts.append(f"w{l}_{k + 1} AS MATERIALIZED (SELECT p.i, p.j, p.v - m.v AS v FROM w{l}_{k} p JOIN mw{l}_{k + 1} m USING (i, j))")
        parts.append(f"b{l}_{k + 1} AS MATERIALIZED (SELECT p.j, p.v - m.v AS v FROM b{l}_{k} p JOIN mb{l}_{k + 1} m USING (j))")
        rates.append(f"(SELECT avg(({eta}::DOUBLE * g.v + {gamma}::DOUBLE * m.v) / (g.v + 1e-4::DOUBLE)) FROM gw{l}_{k} g JOIN mw{l}_{k + 1} m USING (i, j))")
    parts.append(f"rate_{k} AS MATERIALIZED (SELECT ({' + '.join(rates)}) / {len(rates)} AS v)")
    return parts


def rmsprop(layers: list[int], k: int, rate: float = 0.001, gamma: float = 0.9) -> list[str]:
    parts, rates = [], []
    for l in range(1, len(layers)):
        for kind, key in (("w", "i, j"), ("b", "j")):
            old = f"+ {gamma}::DOUBLE * r.v" if k else ""
            join = f"JOIN r{kind}{l}_{k} r USING ({key})" if k else ""
            parts.append(f"r{kind}{l}_{k + 1} AS MATERIALIZED (SELECT {key}, (1 - {gamma}::DOUBLE) * g.v * g.v {old} AS v FROM g{kind}{l}_{k} g {join})")
            parts.append(f"{kind}{l}_{k + 1} AS MATERIALIZED (SELECT {key}, p.v - {rate}::DOUBLE / (sqrt(r.v) + 0.001::DOUBLE) * g.v AS v FROM {kind}{l}_{k} p JOIN r{kind}{l}_{k + 1} r USING ({key}) JOIN g{kind}{l}_{k} g USING ({key}))")
        rates.append(f"(SELECT avg({rate}::DOUBLE / (sqrt(v) + 1e-5::DOUBLE)) FROM rw{l}_{k + 1})")
    parts.append(f"rate_{k} AS MATERIALIZED (SELECT ({' + '.join(rates)}) / {len(rates)} AS v)")
    return parts


def param_rows(layers: list[int], tag: str | int, prefix: str = "") -> str:
    """layer, kind, i, j, value of parameters, or of gradients with prefix g."""
    parts = []
    for l in range(1, len(layers)):
        parts.append(f"SELECT {l}::INT AS layer, 'w' AS kind, i::INT AS i, j::INT AS j, {r6('v')} AS value FROM {prefix}w{l}_{tag}")
        parts.append(f"SELECT {l}::INT AS layer, 'b' AS kind, 0::INT AS i, j::INT AS j, {r6('v')} AS value FROM {prefix}b{l}_{tag}")
    return " UNION ALL ".join(parts)


def drawn(n_sql: str, k: int, batch: int) -> str:
    """sid, m: the draws of iteration k by the rule that Spark is given too."""
    return f"m_{k} AS MATERIALIZED (SELECT (7919 * {k} + 104729 * t.k + 13) % {n_sql} AS sid, count(*) AS m FROM range({batch}) t(k) GROUP BY 1)"


def seeded(n_sql: str, k: int, batch: int, seed: int) -> str:
    """sid, m: the draws that the library makes for a seed."""
    return f"m_{k} AS MATERIALIZED (SELECT ('0x' || substr(md5('{seed}:' || t.k), 1, 15))::BIGINT % {n_sql} AS sid, count(*) AS m FROM range({k * batch}, {(k + 1) * batch}) t(k) GROUP BY 1)"


def drawn_samples(k: int) -> str:
    return f"x_{k} AS MATERIALIZED (SELECT x.* FROM x SEMI JOIN m_{k} m ON x.sid = m.sid), y_{k} AS MATERIALIZED (SELECT y.* FROM y SEMI JOIN m_{k} m ON y.sid = m.sid)"


def query(parts: list[str], select: str) -> str:
    return f"WITH {', '.join(parts)} {select}"
