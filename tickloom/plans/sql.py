"""DuckDB counterparts of the adapters, as common table expressions, and small SQL helpers for the counterparts."""

from __future__ import annotations

TICKS = """ticks AS (SELECT event_type AS symbol, event_id, ts, epoch_us(ts)//1000 AS time_msc, user_id, 1.0::DOUBLE + value/1000.0 AS bid,
  1.0::DOUBLE + value/1000.0 + CAST(json_extract_string(props,'$.k') AS DOUBLE) * 1e-5 AS ask, CAST(json_extract_string(props,'$.k') AS DOUBLE) AS spread_points, 6 AS flags FROM events)"""

TRADES = """trades AS (SELECT o_orderkey AS trade_id, CAST(o_orderdate AS TIMESTAMP) AS signal_time, CASE WHEN o_custkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction,
  CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'TAKE_PROFIT' WHEN '2' THEN 'STOP_LOSS' ELSE 'MAX_HOLD' END AS exit_reason,
  CAST(o_orderkey * 7919 % 20001 - 10000 AS DOUBLE) / 100.0 AS net_pnl, CAST(o_orderkey % 41 AS DOUBLE) AS entry_spread_pts, CAST(o_orderkey * 7 % 37 AS DOUBLE) AS exit_spread_pts,
  CAST(o_custkey % 5 + 1 AS INT) AS holding_bars FROM orders)"""

EXO = """exo AS (SELECT CAST(o_orderdate AS DATE) AS d,
  CAST(sum(CASE WHEN o_orderstatus='F' THEN cents END) AS DOUBLE) / nullif(count(CASE WHEN o_orderstatus='F' THEN 1 END),0) / 1e7 AS us_2y,
  CAST(sum(CASE WHEN o_orderstatus='O' THEN cents END) AS DOUBLE) / nullif(count(CASE WHEN o_orderstatus='O' THEN 1 END),0) / 1e7 AS german_2y
  FROM (SELECT *, CAST(round(o_totalprice*100) AS BIGINT) AS cents FROM orders) x GROUP BY CAST(o_orderdate AS DATE))"""


def bars(seconds: int = 900, name: str = "bars") -> str:
    return f"""{name} AS (SELECT symbol, bar_key*{seconds} AS time, arg_min(bid,event_id) AS open, max(bid) AS high, min(bid) AS low, arg_max(bid,event_id) AS close,
  count(*) AS tick_volume, quantile_cont(spread_points,0.5) AS spread, CAST(0 AS BIGINT) AS real_volume
  FROM (SELECT *, CAST(floor(time_msc/{seconds}000.0) AS BIGINT) AS bar_key FROM ticks) t GROUP BY symbol, bar_key)"""


def preds(a: int = 37, b: int = 59, c: int = 83, name: str = "preds") -> str:
    return f"""{name} AS (SELECT event_id, ts, symbol, y_true, a/(a+b+c) AS p_short, b/(a+b+c) AS p_neutral, c/(a+b+c) AS p_long,
  CAST(CASE WHEN a>=b AND a>=c THEN -1 WHEN b>=c THEN 0 ELSE 1 END AS DOUBLE) AS y_pred
  FROM (SELECT event_id, ts, event_type AS symbol, CAST(event_id * 13 % 3 - 1 AS DOUBLE) AS y_true, CAST(event_id * {a} % 101 + 1 AS DOUBLE) AS a,
    CAST(event_id * {b} % 103 + 1 AS DOUBLE) AS b, CAST(event_id * {c} % 107 + 1 AS DOUBLE) AS c FROM events) q)"""


def bars_with(seconds: int = 900) -> str:
    return f"WITH {TICKS}, {bars(seconds)}"


W = "PARTITION BY symbol ORDER BY time"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({W})"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) OVER ({W})"


def roll(agg: str, x: str, n: int, least: int | None = None, shift: int = 0) -> str:
    frame = f"({W} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"
    return f"CASE WHEN count({x}) OVER {frame} >= {least or n} THEN {agg}({x}) OVER {frame} END"


def mean(x: str, n: int, least: int | None = None) -> str:
    return roll("avg", x, n, least)


def std(x: str, n: int, least: int | None = None) -> str:
    return roll("stddev_samp", x, n, least)


def rounded(columns: dict[str, str] | list[str], digits: int = 8) -> str:
    items = columns.items() if isinstance(columns, dict) else [(c, c) for c in columns]
    return ", ".join(f"round({x}, {digits}) + 0.0 AS {n}" for n, x in items)


def count_if(x: str) -> str:
    return f"CAST(count(CASE WHEN {x} THEN 1 END) AS BIGINT)"
