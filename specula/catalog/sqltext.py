"""SQL texts shared by the comparisons: tails by quadrature, partial correlations, ranks."""

from __future__ import annotations

STEPS = 4000


def simpson(f: str, lo: str, hi: str) -> str:
    """Simpson's rule over a lambda body in ``u``."""
    body = f.replace("{u}", f"(({lo}) + i * ((({hi}) - ({lo})) / {STEPS}.0))")
    weight = f"CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(list_sum(list_transform(range(0, {STEPS + 1}), lambda i: ({weight}) * ({body}))) * ((({hi}) - ({lo})) / {STEPS}.0) / 3)"


def p_normal(z: str) -> str:
    return f"least(1.0, 2 * {simpson('exp(-{u} * {u} / 2) / sqrt(2 * pi())', f'abs({z})', f'abs({z}) + 14')})"


def p_chi2(x: str, df: str) -> str:
    f = f"2 * exp((({df}) - 1) * ln(greatest({{u}}, 1e-300)) - {{u}} * {{u}} / 2 - ({df}) / 2.0 * ln(2) - lgamma(({df}) / 2.0))"
    return f"least(1.0, {simpson(f, f'sqrt({x})', f'sqrt({x}) + 14')})"


def p_t(t: str, df: str) -> str:
    c = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi())"
    lo = f"atan(abs({t}) / sqrt({df}))"
    f = f"exp((({df}) - 1) * ln(greatest(cos({{u}}), 1e-300)))"
    return f"least(1.0, 2 * {c} * {simpson(f, lo, f'least(pi() / 2, {lo} + 14 / sqrt({df}))')})"


def p_f(x: str, d1: str, d2: str) -> str:
    lo = f"atan(sqrt(({d1}) * ({x}) / ({d2})))"
    f = (f"2 * exp((({d1}) - 1) * ln(greatest(sin({{u}}), 1e-300)) + (({d2}) - 1) * ln(greatest(cos({{u}}), 1e-300)) "
         f"- lgamma(({d1}) / 2.0) - lgamma(({d2}) / 2.0) + lgamma((({d1}) + ({d2})) / 2.0))")
    return f"least(1.0, {simpson(f, lo, f'least(pi() / 2, {lo} + 14 / sqrt({d2}))')})"


def p_ks(d: str, n1: str, n2: str) -> str:
    x2 = f"({d}) * ({d}) * ({n1}) * ({n2}) / (({n1}) + ({n2}))"
    return f"greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 200), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * {x2})))))"


def average_rank(value: str, partition: str = "") -> str:
    by = f"PARTITION BY {partition}" if partition else ""
    both = f"PARTITION BY {partition}, {value}" if partition else f"PARTITION BY {value}"
    return f"(rank() OVER ({by} ORDER BY {value}) + (count(*) OVER ({both}) - 1) / 2.0)"


def corr_cte(table: str, names: list[str]) -> str:
    """One row with c_i_j = corr(names[i], names[j])."""
    cells = [f"corr({names[i]}, {names[j]}) AS c_{i}_{j}" for i in range(len(names)) for j in range(i + 1, len(names))]
    return f"(SELECT count(*) AS n, {', '.join(cells)} FROM {table})"


def partial(i: int, j: int, given: tuple[int, ...]) -> str:
    if not given:
        return f"c_{min(i, j)}_{max(i, j)}"
    k, rest = given[-1], given[:-1]
    ij, ik, jk = partial(i, j, rest), partial(i, k, rest), partial(j, k, rest)
    return f"(({ij} - {ik} * {jk}) / sqrt((1 - {ik} * {ik}) * (1 - {jk} * {jk})))"


def r_squared(target: int, others: list[int]) -> str:
    parts = [f"(1 - pow({partial(target, x, tuple(others[:m]))}, 2))" for m, x in enumerate(others)]
    return f"(1 - {' * '.join(parts)})"


def quantile_edges(value: str, table: str, bins: int) -> str:
    probs = ", ".join(str(i / bins) for i in range(bins + 1))
    return f"(SELECT list_sort(list_distinct(quantile_cont({value}, [{probs}]))) FROM {table})"


def right_closed_bin(value: str, edges: str) -> str:
    return f"len(list_filter({edges}[2:len({edges}) - 1], lambda e: e < {value}))"
