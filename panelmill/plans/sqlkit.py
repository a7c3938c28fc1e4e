"""Small builders for the SQL twins (DuckDB dialect)."""

from __future__ import annotations


def wins(*sizes: int, key: str = "symbol", order: str = "ts", extra: str = "") -> str:
    """WINDOW clause: w (whole order), cum, and wN for each N-row frame."""
    base = f"PARTITION BY {key} ORDER BY {order}"
    parts = [f"w AS ({base})", f"cum AS ({base} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"]
    parts += [f"w{n} AS ({base} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sorted(set(sizes))]
    return "WINDOW " + ", ".join(parts) + extra


def d(a: str, b: str) -> str:
    return f"(({a}) / NULLIF(({b}), 0))"


def fl(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def sg(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN 1 WHEN {x} < 0 THEN -1 ELSE 0 END"


def full(n: int, c: str, value: str) -> str:
    return f"CASE WHEN count({c}) OVER w{n} = {n} THEN {value} END"


def rsi(n: int, gain: str = "gain", loss: str = "loss") -> str:
    g, lo = f"avg({gain}) OVER w{n}", f"avg({loss}) OVER w{n}"
    return f"CASE WHEN {lo} = 0 THEN CASE WHEN {g} > 0 THEN 100.0 END ELSE 100 - 100 / (1 + {g} / {lo}) END"


def ema_chain(source: str, spec: dict[str, tuple[str, float]], out: str) -> str:
    """Recursive CTE adding name = ewm(span, adjust=False) of a column, for each (column, span)."""
    seed = ", ".join(f"CAST({c} AS DOUBLE) AS {n}" for n, (c, _) in spec.items())
    step = ", ".join(f"{2 / (s + 1)!r} * b.{c} + (1 - {2 / (s + 1)!r}) * p.{n}" for n, (c, s) in spec.items())
    cols = ", ".join(spec)
    return f"""
{out}_in AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn_ FROM {source}),
{out}_rec AS (
  SELECT symbol, rn_, {seed} FROM {out}_in WHERE rn_ = 1
  UNION ALL
  SELECT b.symbol, b.rn_, {step} FROM {out}_rec p JOIN {out}_in b ON b.symbol = p.symbol AND b.rn_ = p.rn_ + 1),
{out} AS (SELECT i.* EXCLUDE (rn_), {", ".join("r." + c for c in spec)} FROM {out}_in i JOIN {out}_rec r ON r.symbol = i.symbol AND r.rn_ = i.rn_)"""
