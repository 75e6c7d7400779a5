"""Pieces of oracle SQL that several queries share."""

from __future__ import annotations


def norm_two_sided(z: str) -> str:
    """Two-sided normal p by the same five-term polynomial."""
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.3275911 * {x}))"
    poly = (f"(((((1.061405429 * {t} - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} "
            f"+ 0.254829592) * {t}")
    return f"least(1.0, 2 * (1 - 0.5 * (1 + (1.0 - ({poly}) * exp(-{x} * {x})))))"


def betainc(a: str, b: str, x: str, terms: int = 600) -> str:
    """Incomplete beta by its power series; the caller's x must stay clear of 1."""
    return (
        f"(exp(({a}) * ln({x}) + ({b}) * ln(1 - ({x})) + lgamma(({a}) + ({b})) - lgamma(({a}) + 1) - lgamma({b})) * "
        f"list_sum(list_transform(range(0, {terms}), lambda i: exp(lgamma(({a}) + ({b}) + i) - lgamma(({a}) + ({b})) "
        f"+ lgamma(({a}) + 1) - lgamma(({a}) + 1 + i) + i * ln({x})))))"
    )


def t_two_sided(t: str, df: str, terms: int = 600) -> str:
    """Two-sided Student tail: the series on whichever side of the split converges faster."""
    x = f"(({df}) / (({df}) + ({t}) * ({t})))"
    y = f"(({t}) * ({t}) / (({df}) + ({t}) * ({t})))"
    lo = betainc(f"({df}) / 2.0", "0.5", x, terms)
    hi = betainc("0.5", f"({df}) / 2.0", y, terms)
    return (f"CASE WHEN ({t}) = 0 THEN 1.0 WHEN {x} > (({df}) / 2.0 + 1) / (({df}) / 2.0 + 2.5) "
            f"THEN 1.0 - {hi} ELSE {lo} END")


def bh(src: str, p: str, out: str = "padj", family: str = "") -> str:
    """Rows of ``src`` with the adjusted p; ties share the value of their last rank."""
    part = f"PARTITION BY {family}" if family else ""
    return (
        f"SELECT * EXCLUDE (__raw), least(1.0, min(__raw) OVER ({part} ORDER BY {p} "
        f"RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {out} FROM ("
        f"SELECT *, {p} * count(*) OVER ({part}) / count(*) OVER ({part} ORDER BY {p} "
        f"RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS __raw FROM ({src}))"
    )


def midrank(keys: str, value: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    tie = f"PARTITION BY {keys}, {value}" if keys else f"PARTITION BY {value}"
    return f"(rank() OVER ({part} ORDER BY {value}) + (count(*) OVER ({tie}) - 1) / 2.0)"
