"""SQL text of the shared views, for the oracle only: one named CTE each, resolved by name."""
from __future__ import annotations

import re

LEVELS = 10

VIEWS: dict[str, str] = {}

VIEWS["v_trades"] = """
SELECT event_id AS trade_id, ts, 'S' || CAST(user_id % 8 AS VARCHAR) AS symbol,
       CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'signup' THEN 'buy'
                       WHEN 'error' THEN 'sell' WHEN 'view' THEN 'sell' ELSE '' END AS side,
       px_c, CAST(px_c AS DOUBLE) / 1e2 AS price,
       1 + (event_id * 7919) % 2000 AS amount,
       CAST(px_c * (1 + (event_id * 7919) % 2000) AS DOUBLE) / 1e2 AS notional
FROM (SELECT *, 10000 + 10 * (CAST(ROUND(value * 1e2) AS BIGINT) % 5)
             + CASE WHEN event_type IN ('purchase','signup') THEN 5
                    WHEN event_type IN ('error','view') THEN -5 ELSE 0 END AS px_c
      FROM events) e"""

VIEWS["v_book"] = (
    "SELECT event_id AS seq, ts, 'S' || CAST(user_id % 8 AS VARCHAR) AS symbol, "
    + ", ".join(
        f"CAST(mid_c - {5 + 10 * (i - 1)} AS DOUBLE) / 1e2 AS bid_px_{i}, 1 + (event_id * {30 + i}) % 97 AS bid_sz_{i}, "
        f"CAST(mid_c + {5 + 10 * (i - 1)} AS DOUBLE) / 1e2 AS ask_px_{i}, 1 + (event_id * {60 + i}) % 89 AS ask_sz_{i}"
        for i in range(1, LEVELS + 1))
    + " FROM (SELECT *, 10000 + 10 * (CAST(ROUND(value * 1e2) AS BIGINT) % 5) AS mid_c FROM events WHERE event_id % 2 = 0) b")

VIEWS["v_bars_1h"] = """
SELECT symbol, date_trunc('hour', ts) AS ts,
       CAST(min_by(px_c, trade_id) AS DOUBLE) / 1e2 AS open, CAST(max(px_c) AS DOUBLE) / 1e2 AS high,
       CAST(min(px_c) AS DOUBLE) / 1e2 AS low, CAST(max_by(px_c, trade_id) AS DOUBLE) / 1e2 AS close,
       CAST(sum(amount) AS DOUBLE) AS volume
FROM v_trades GROUP BY symbol, date_trunc('hour', ts)"""

VIEWS["v_legs"] = """
SELECT a.symbol || '_' || b.symbol AS pair, a.symbol AS sym_a, b.symbol AS sym_b, round(regr_slope(ln(a.close), ln(b.close)), 6) AS beta
FROM v_bars_1h a JOIN v_bars_1h b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY ALL"""

VIEWS["v_daily"] = """
SELECT s.symbol, s.ts, exp(46e-1 + CAST(sum(s.r) OVER (PARTITION BY s.symbol ORDER BY s.ts) + d.c AS DOUBLE) / 1e4) AS close,
       CAST(s.volume AS DOUBLE) AS volume
FROM (SELECT 'P' || CAST(l_suppkey % 12 AS VARCHAR) AS symbol, l_shipdate AS ts,
             sum(CAST(ROUND(l_extendedprice * 1e2) AS BIGINT) % 201 - 100) AS r,
             sum(CAST(l_quantity AS BIGINT)) AS volume
      FROM lineitem GROUP BY 'P' || CAST(l_suppkey % 12 AS VARCHAR), l_shipdate) s
JOIN (SELECT ts, sum(r) OVER (ORDER BY ts) AS c
      FROM (SELECT l_shipdate AS ts, sum(CAST(ROUND(l_extendedprice * 1e2) AS BIGINT) % 201 - 100) AS r
            FROM lineitem GROUP BY l_shipdate) x) d ON s.ts = d.ts"""

# complete-case daily panel on the calendar grid, i = days since 1970
VIEWS["v_panel"] = """
SELECT symbol, ts, epoch_us(ts) // 86400000000 AS i, close, ln(close) AS lp, volume_usdt FROM (
  SELECT *, count(close) OVER (PARTITION BY ts) AS n_ok FROM (
    SELECT s.symbol, g.ts, last_value(d.close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY g.ts) AS close,
           coalesce(d.close * d.volume, 0e0) AS volume_usdt
    FROM (SELECT DISTINCT symbol FROM v_daily) s
    CROSS JOIN (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM v_daily) g
    LEFT JOIN v_daily d ON d.symbol = s.symbol AND d.ts = g.ts))
WHERE n_ok = (SELECT count(DISTINCT symbol) FROM v_daily)"""

VIEWS["v_pair_rows"] = """
SELECT a.symbol || '_' || b.symbol AS pair, a.symbol AS sym_a, b.symbol AS sym_b, a.ts, a.i,
       a.close AS close_a, b.close AS close_b, a.lp AS la, b.lp AS lb,
       a.lp - lag(a.lp) OVER w AS ra, b.lp - lag(b.lp) OVER w AS rb,
       a.volume_usdt AS vol_a, b.volume_usdt AS vol_b
FROM v_panel a JOIN v_panel b ON a.ts = b.ts AND a.symbol < b.symbol
WINDOW w AS (PARTITION BY a.symbol, b.symbol ORDER BY a.i)"""

VIEWS["v_pair_fit"] = """
SELECT pair, sym_a, sym_b, corr(ra, rb) AS corr, regr_intercept(la, lb) AS alpha, regr_slope(la, lb) AS beta,
       sqrt(greatest(regr_syy(la, lb) - regr_sxy(la, lb) * regr_sxy(la, lb) / regr_sxx(la, lb), 0e0) / (count(*) - 1)) AS spread_vol,
       count(*) AS n
FROM v_pair_rows GROUP BY pair, sym_a, sym_b"""

VIEWS["v_pairs"] = "SELECT * FROM v_pair_fit WHERE corr >= 2e-1"

VIEWS["v_spread"] = """
SELECT r.pair, r.sym_a, r.sym_b, r.ts, r.i, r.close_a, r.close_b, r.la, r.lb, r.ra, r.rb, r.vol_a, r.vol_b,
       p.alpha, p.beta, r.la - (p.alpha + p.beta * r.lb) AS spread
FROM v_pair_rows r JOIN v_pairs p ON r.pair = p.pair"""


def resolve(body: str) -> str:
    """Prefix ``body`` with the CTEs it names, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in order and text is not VIEWS[name] and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n].strip()}\n)" for n in order)
    head = "WITH RECURSIVE " if re.match(r"\s*WITH RECURSIVE", body) else "WITH "
    rest = re.match(r"\s*WITH (?:RECURSIVE )?(.*)", body, re.S)
    return f"{head}{ctes},\n{rest.group(1)}" if rest else f"{head}{ctes}\n{body.strip()}"


VIEWS["v_tick"] = """
SELECT * EXCLUDE (sgn), CAST(coalesce(last_value(nullif(sgn, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, trade_id), 0) AS INTEGER) AS tick_sign
FROM (SELECT *, sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, trade_id)) AS sgn FROM v_trades)"""

VIEWS["v_signed"] = """
SELECT q.* EXCLUDE (quote_sign), quote_sign,
  CASE WHEN side = 'buy' THEN 1 WHEN side = 'sell' THEN -1 ELSE quote_sign END AS trade_sign,
  CASE WHEN side = 'buy' THEN 1 WHEN side = 'sell' THEN -1 ELSE quote_sign END * notional AS signed_notional,
  CASE WHEN notional < 1000 THEN 'retail' WHEN notional < 10000 THEN 'mid' WHEN notional < 100000 THEN 'large' ELSE 'institutional' END AS bucket
FROM (SELECT t.*, CASE WHEN t.price > b.mid THEN 1 WHEN t.price < b.mid THEN -1 ELSE t.tick_sign END AS quote_sign
      FROM v_tick t ASOF LEFT JOIN (SELECT symbol, ts, (bid_px_1 + ask_px_1) / 2e0 AS mid FROM v_book) b
      ON t.symbol = b.symbol AND t.ts >= b.ts) q"""

VIEWS["v_flow"] = """
SELECT *, CASE WHEN pbp IS NULL THEN 0e0 ELSE
    CASE WHEN bid_px_1 > pbp THEN bid_sz_1 WHEN bid_px_1 = pbp THEN bid_sz_1 - pbs ELSE -pbs END
  + CASE WHEN ask_px_1 < pap THEN -ask_sz_1 WHEN ask_px_1 = pap THEN pas - ask_sz_1 ELSE pas END END AS ofi,
  CASE WHEN bid_px_1 = pbp THEN greatest(pbs - bid_sz_1, 0) ELSE 0 END AS bid_dec,
  CASE WHEN ask_px_1 = pap THEN greatest(pas - ask_sz_1, 0) ELSE 0 END AS ask_dec
FROM (SELECT symbol, CAST(ts AS DATE) AS day, ts, seq, bid_px_1, bid_sz_1, ask_px_1, ask_sz_1,
        lag(bid_px_1) OVER w AS pbp, lag(bid_sz_1) OVER w AS pbs, lag(ask_px_1) OVER w AS pap, lag(ask_sz_1) OVER w AS pas
      FROM v_book WINDOW w AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, seq))"""

# last mid per minute on a dense grid of every symbol-day
VIEWS["v_minute"] = """
SELECT g.symbol, g.day, g.i, make_timestamp(g.i * 60000000) AS ts,
  last_value(l.mid IGNORE NULLS) OVER w AS mid, last_value(l.spr IGNORE NULLS) OVER w AS spr, last_value(l.imb IGNORE NULLS) OVER w AS imb
FROM (SELECT symbol, day, date_diff('day', DATE '1970-01-01', day) * 1440 + k AS i
      FROM (SELECT DISTINCT symbol, CAST(ts AS DATE) AS day FROM v_book), range(1440) r(k)) g
LEFT JOIN (SELECT symbol, epoch_us(ts) // 60000000 AS i, arg_max((bid_px_1 + ask_px_1) / 2e0, ts) AS mid,
             arg_max((ask_px_1 - bid_px_1) / ((bid_px_1 + ask_px_1) / 2e0), ts) AS spr,
             arg_max((bid_sz_1 - ask_sz_1) / (bid_sz_1 + ask_sz_1 + 1e-12), ts) AS imb
           FROM v_book GROUP BY ALL) l ON l.symbol = g.symbol AND l.i = g.i
WINDOW w AS (PARTITION BY g.symbol, g.day ORDER BY g.i)"""

VIEWS["v_bars15"] = """
SELECT symbol, ts, trade_count, trade_notional, buy_notional, sell_notional, signed_notional, s_ret, s_mid, s_lar, s_inst, ib, isl, rb, rs,
  last_value(microprice IGNORE NULLS) OVER w AS microprice, last_value(midprice IGNORE NULLS) OVER w AS midprice,
  last_value(spread_bps IGNORE NULLS) OVER w AS spread_bps, last_value(obi IGNORE NULLS) OVER w AS obi
FROM (SELECT coalesce(b.symbol, f.symbol) AS symbol, coalesce(b.ts, f.ts) AS ts, microprice, midprice, spread_bps, obi,
        coalesce(n, 0) AS trade_count, coalesce(tn, 0) AS trade_notional, coalesce(bn, 0) AS buy_notional, coalesce(sn, 0) AS sell_notional,
        coalesce(sg, 0) AS signed_notional, coalesce(f.s_ret, 0) AS s_ret, coalesce(f.s_mid, 0) AS s_mid, coalesce(f.s_lar, 0) AS s_lar,
        coalesce(f.s_inst, 0) AS s_inst, coalesce(f.ib, 0) AS ib, coalesce(f.isl, 0) AS isl, coalesce(f.rb, 0) AS rb, coalesce(f.rs, 0) AS rs
      FROM (SELECT symbol, make_timestamp((epoch_us(ts) + 899999999) // 900000000 * 900000000) AS ts,
              arg_max((bid_sz_1 * ask_px_1 + ask_sz_1 * bid_px_1) / (bid_sz_1 + ask_sz_1), ts) AS microprice,
              arg_max((bid_px_1 + ask_px_1) / 2e0, ts) AS midprice,
              arg_max((ask_px_1 - bid_px_1) / ((bid_px_1 + ask_px_1) / 2e0) * 1e4, ts) AS spread_bps,
              arg_max(CAST(bid_sz_1 + bid_sz_2 + bid_sz_3 + bid_sz_4 + bid_sz_5 - ask_sz_1 - ask_sz_2 - ask_sz_3 - ask_sz_4 - ask_sz_5 AS DOUBLE)
                / (bid_sz_1 + bid_sz_2 + bid_sz_3 + bid_sz_4 + bid_sz_5 + ask_sz_1 + ask_sz_2 + ask_sz_3 + ask_sz_4 + ask_sz_5), ts) AS obi
            FROM v_book GROUP BY ALL) b
      FULL JOIN (SELECT symbol, make_timestamp((epoch_us(ts) + 899999999) // 900000000 * 900000000) AS ts, count(*) AS n, sum(notional) AS tn,
              sum(notional) FILTER (trade_sign > 0) AS bn, sum(notional) FILTER (trade_sign < 0) AS sn, sum(signed_notional) AS sg,
              sum(signed_notional) FILTER (bucket = 'retail') AS s_ret, sum(signed_notional) FILTER (bucket = 'mid') AS s_mid,
              sum(signed_notional) FILTER (bucket = 'large') AS s_lar, sum(signed_notional) FILTER (bucket = 'institutional') AS s_inst,
              sum(notional) FILTER (bucket = 'institutional' AND trade_sign > 0) AS ib, sum(notional) FILTER (bucket = 'institutional' AND trade_sign < 0) AS isl,
              sum(notional) FILTER (bucket = 'retail' AND trade_sign > 0) AS rb, sum(notional) FILTER (bucket = 'retail' AND trade_sign < 0) AS rs
            FROM v_signed GROUP BY ALL) f ON b.symbol = f.symbol AND b.ts = f.ts)
WINDOW w AS (PARTITION BY symbol ORDER BY ts)
QUALIFY last_value(microprice IGNORE NULLS) OVER w IS NOT NULL"""

VIEWS["v_feat"] = """
SELECT s.*, m.lp - p.lp AS market_return_24 FROM (
SELECT *, CASE WHEN count(spread) OVER z >= 24 THEN (spread - avg(spread) OVER z) / nullif(stddev_samp(spread) OVER z, 0e0) END AS spread_z,
  spread - lag(spread, 1) OVER o AS spread_diff_1, spread - lag(spread, 4) OVER o AS spread_diff_4, spread - lag(spread, 24) OVER o AS spread_diff_24,
  CASE WHEN count(spread) OVER s >= 12 THEN stddev_samp(spread) OVER s END AS spread_vol_24,
  CASE WHEN count(spread) OVER z >= 24 THEN stddev_samp(spread) OVER z END AS spread_vol_z,
  vol_a / nullif(vol_b, 0e0) AS volume_ratio,
  CASE WHEN count(vol_a) OVER z >= 24 THEN (vol_a - avg(vol_a) OVER z) / nullif(stddev_samp(vol_a) OVER z, 0e0) END AS volume_z_a,
  CASE WHEN count(vol_b) OVER z >= 24 THEN (vol_b - avg(vol_b) OVER z) / nullif(stddev_samp(vol_b) OVER z, 0e0) END AS volume_z_b,
  vol_a + vol_b AS pair_volume_sum, sqrt(greatest(vol_a, 0e0) * greatest(vol_b, 0e0)) AS pair_volume_gmean,
  CASE WHEN count(ra + rb) OVER s >= 12 THEN covar_pop(ra, rb) OVER s / nullif(stddev_pop(CASE WHEN rb IS NOT NULL THEN ra END) OVER s * stddev_pop(CASE WHEN ra IS NOT NULL THEN rb END) OVER s, 0e0) END AS rolling_corr_24,
  CASE WHEN count(ra) OVER s >= 12 THEN stddev_samp(ra) OVER s END AS realized_vol_a_24,
  CASE WHEN count(rb) OVER s >= 12 THEN stddev_samp(rb) OVER s END AS realized_vol_b_24,
  lead(spread, 24) OVER o - spread AS target_change, abs(lead(spread, 24) OVER o) - abs(spread) AS target_abs_change,
  CAST(abs(lead(spread, 24) OVER o) < abs(spread) AS INTEGER) AS target_reversion
FROM v_spread
WINDOW o AS (PARTITION BY pair ORDER BY i), z AS (PARTITION BY pair ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
  s AS (PARTITION BY pair ORDER BY i ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) s
LEFT JOIN (SELECT i, lp FROM v_panel WHERE symbol = 'P0') m ON m.i = s.i LEFT JOIN (SELECT i + 24 AS i, lp FROM v_panel WHERE symbol = 'P0') p ON p.i = s.i"""

VIEWS["v_ready"] = """
SELECT *, row_number() OVER (PARTITION BY pair ORDER BY i) AS rn FROM v_feat
WHERE spread_z IS NOT NULL AND spread_diff_24 IS NOT NULL AND spread_vol_24 IS NOT NULL AND spread_vol_z IS NOT NULL AND volume_ratio IS NOT NULL
  AND volume_z_a IS NOT NULL AND volume_z_b IS NOT NULL AND market_return_24 IS NOT NULL AND rolling_corr_24 IS NOT NULL
  AND realized_vol_a_24 IS NOT NULL AND realized_vol_b_24 IS NOT NULL AND target_change IS NOT NULL"""

VIEWS["v_thr"] = """
SELECT pair, 5e-1 * CASE WHEN count(*) FILTER (ts < TIMESTAMP '1998-01-01') >= 32 THEN stddev_samp(chg) FILTER (ts < TIMESTAMP '1998-01-01') ELSE stddev_samp(chg) FILTER (rn <= 32) END AS threshold
FROM (SELECT *, abs(spread + target_change) - abs(spread) AS chg FROM v_ready) GROUP BY pair"""

VIEWS["v_samples"] = """
SELECT * FROM (SELECT r.*, t.threshold, avg(spread_z) OVER w AS mean_spread_z, min(spread_z) OVER w AS min_spread_z, max(spread_z) OVER w AS max_spread_z,
  regr_slope(spread, rn) OVER w AS spread_slope, avg(volume_ratio) OVER w AS mean_volume_ratio,
  CAST(coalesce(rn - max(CASE WHEN sc <= 0 THEN rn END) OVER (PARTITION BY r.pair ORDER BY rn ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) + 1, 32) AS DOUBLE) AS time_since_zero_crossing,
  avg(pair_volume_sum) OVER w AS mean_pair_volume_sum,
  CASE WHEN abs(spread + target_change) - abs(spread) < -threshold THEN 0 WHEN abs(spread + target_change) - abs(spread) > threshold THEN 2 ELSE 1 END AS y_class
FROM (SELECT *, sign(spread) * sign(lag(spread) OVER (PARTITION BY pair ORDER BY rn)) AS sc FROM v_ready) r JOIN v_thr t ON t.pair = r.pair
WINDOW w AS (PARTITION BY r.pair ORDER BY rn ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)) WHERE rn >= 32"""

# predictions with a deterministic class, for signals and P&L
VIEWS["v_preds"] = """
SELECT pair, sym_a, sym_b, ts, i, close_a, close_b, la, lb, beta, spread AS current_spread, spread_z AS latest_spread_z,
  CAST((i // 7) % 3 AS INTEGER) AS pred_class, row_number() OVER (PARTITION BY pair ORDER BY i) AS rn FROM v_feat WHERE spread_z IS NOT NULL"""

VIEWS["v_signal"] = """
SELECT *, coalesce(lag(signal) OVER (PARTITION BY pair ORDER BY i), 0e0) AS held, coalesce(close_a / lag(close_a) OVER (PARTITION BY pair ORDER BY i) - 1, 0e0) AS ret_a,
  coalesce(close_b / lag(close_b) OVER (PARTITION BY pair ORDER BY i) - 1, 0e0) AS ret_b FROM (
SELECT *, CASE WHEN sign(current_spread) = 0 THEN 0e0 WHEN pred_class = 0 THEN -sign(current_spread) WHEN pred_class = 2 THEN sign(current_spread) ELSE 0e0 END AS signal FROM v_preds)"""

VIEWS["v_pnl"] = """
SELECT *, abs(signal - held) * 1e4 * (1 + abs(beta)) AS turnover, abs(signal - held) * 1e4 * (1 + abs(beta)) * 7e0 / 1e4 AS cost,
  held * 1e4 * (ret_a - beta * ret_b) AS gross, held * 1e4 * (ret_a - beta * ret_b) - abs(signal - held) * 1e4 * (1 + abs(beta)) * 7e0 / 1e4 AS pnl FROM v_signal"""

# z hysteresis: exits numbered, first entry after each exit
VIEWS["v_hyst"] = """
SELECT *, coalesce(first_value(e IGNORE NULLS) OVER (PARTITION BY pair, g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0e0) AS position FROM (
SELECT *, sum(CASE WHEN x THEN 1 ELSE 0 END) OVER (PARTITION BY pair ORDER BY i) AS g,
  CASE WHEN x THEN NULL WHEN spread_z >= 2 THEN -1e0 WHEN spread_z <= -2 THEN 1e0 END AS e FROM (
SELECT pair, ts, i, la, lb, ra, rb, beta, spread, spread_z, (spread_z IS NULL OR abs(spread_z) <= 5e-1 OR abs(spread_z) >= 4) AS x FROM v_feat))"""

VIEWS["v_unit"] = """
SELECT *, held * sr AS gross, abs(position - held) AS dpos, held * sr - abs(position - held) * 2e0 * 15e0 / 1e4 AS net FROM (
SELECT *, coalesce(lag(position) OVER (PARTITION BY pair ORDER BY i), 0e0) AS held, coalesce(ra - rb, 0e0) AS sr FROM v_hyst)"""

VIEWS["v_port"] = "SELECT ts, i, avg(net) AS pnl, avg(gross) AS gross FROM v_unit GROUP BY ts, i"

VIEWS["v_tb"] = """
SELECT symbol, make_timestamp((epoch_us(ts) + 59999999) // 60000000 * 60000000) AS ts, count(*) AS trade_count, CAST(sum(amount) AS DOUBLE) AS volume_base, sum(notional) AS volume_quote,
 CAST(coalesce(sum(amount) FILTER (side = 'buy'), 0) AS DOUBLE) AS buy, CAST(coalesce(sum(amount) FILTER (side = 'sell'), 0) AS DOUBLE) AS sell,
 CAST(coalesce(sum(amount) FILTER (side = 'buy'), 0) - coalesce(sum(amount) FILTER (side = 'sell'), 0) AS DOUBLE) AS signed FROM v_trades GROUP BY 1, 2"""

VIEWS["v_cancel"] = """
SELECT *, buy - sell AS trade_ofi, greatest(bid_dec - sell, 0) AS bid_cancel, greatest(ask_dec - buy, 0) AS ask_cancel, greatest(bid_dec - sell, 0) - greatest(ask_dec - buy, 0) AS cancel_imb FROM (
SELECT coalesce(b.symbol, t.symbol) AS symbol, coalesce(b.day, t.day) AS day, coalesce(b.i, t.i) AS i, coalesce(book_ofi, 0) AS book_ofi, coalesce(bid_dec, 0) AS bid_dec, coalesce(ask_dec, 0) AS ask_dec,
  coalesce(buy, 0) AS buy, coalesce(sell, 0) AS sell FROM
 (SELECT symbol, day, epoch_us(ts) // 60000000 AS i, sum(ofi) AS book_ofi, sum(bid_dec) AS bid_dec, sum(ask_dec) AS ask_dec FROM v_flow GROUP BY 1, 2, 3) b FULL JOIN
 (SELECT symbol, CAST(ts AS DATE) AS day, epoch_us(ts) // 60000000 AS i, sum(amount) FILTER (side = 'buy') AS buy, sum(amount) FILTER (side = 'sell') AS sell FROM v_trades GROUP BY 1, 2, 3) t
 ON b.symbol = t.symbol AND b.day = t.day AND b.i = t.i)"""

VIEWS["v_dense"] = """
SELECT *, sum(book_ofi) OVER f AS bofi_tr, sum(trade_ofi) OVER f AS tofi_tr, sum(cancel_imb) OVER f AS cimb_tr, lm - lag(lm) OVER o AS ret, lead(lm, 1) OVER o - lm AS fwd1, lead(lm, 10) OVER o - lm AS fwd10 FROM (
SELECT m.symbol, m.day, m.i, ln(m.mid) AS lm, CAST(coalesce(book_ofi, 0) AS DOUBLE) AS book_ofi, CAST(coalesce(trade_ofi, 0) AS DOUBLE) AS trade_ofi, CAST(coalesce(cancel_imb, 0) AS DOUBLE) AS cancel_imb,
  coalesce(buy, 0) AS buy, coalesce(sell, 0) AS sell
FROM v_minute m LEFT JOIN v_cancel c ON c.symbol = m.symbol AND c.day = m.day AND c.i = m.i)
WINDOW o AS (PARTITION BY symbol, day ORDER BY i), f AS (PARTITION BY symbol, day ORDER BY i ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""

VIEWS["v_episodes"] = """
SELECT * EXCLUDE (run), greatest(exec_vol - max_disp, 0e0) AS hidden FROM (
SELECT symbol, day, side, run, min(px) FILTER (kind = 0) AS price, CAST(max(sz) AS DOUBLE) AS max_disp, CAST(coalesce(sum(amt) FILTER (kind = 1 AND abs(tpx - cpx) <= 1e-9 * cpx), 0) AS DOUBLE) AS exec_vol,
  min(ts) FILTER (kind = 0) AS start_ts, coalesce(lead(min(ts) FILTER (kind = 0)) OVER (PARTITION BY symbol, day, side ORDER BY run), max(ts) FILTER (kind = 1 AND abs(tpx - cpx) <= 1e-9 * cpx)) AS end_ts
FROM (SELECT *, sum(new) OVER w AS run, last_value(px IGNORE NULLS) OVER w AS cpx FROM (
  SELECT symbol, day, ts, side, 0 AS kind, seq AS ord, px, sz, NULL AS tpx, NULL AS amt, CASE WHEN pp IS NULL OR abs(px - pp) > 1e-9 * pp THEN 1 ELSE 0 END AS new FROM (
    SELECT *, lag(px) OVER (PARTITION BY symbol, day, side ORDER BY ts, seq) AS pp FROM (
      SELECT symbol, CAST(ts AS DATE) AS day, ts, seq, 'ask' AS side, ask_px_1 AS px, ask_sz_1 AS sz FROM v_book UNION ALL SELECT symbol, CAST(ts AS DATE), ts, seq, 'bid', bid_px_1, bid_sz_1 FROM v_book))
  UNION ALL SELECT symbol, CAST(ts AS DATE), ts, CASE WHEN side = 'buy' THEN 'ask' ELSE 'bid' END, 1, trade_id, NULL, NULL, price, amount, 0 FROM v_trades)
  WINDOW w AS (PARTITION BY symbol, day, side ORDER BY ts, kind, ord))
WHERE run > 0 GROUP BY symbol, day, side, run) WHERE exec_vol > 0"""

VIEWS["v_parents"] = """
SELECT g.*, b.* EXCLUDE (symbol, ts, seq), (b.bid_px_1 + b.ask_px_1) / 2e0 AS m0, CASE side WHEN 'buy' THEN 1e0 ELSE -1e0 END AS sgn,
  CASE side WHEN 'buy' THEN b.bid_px_1 ELSE b.ask_px_1 END AS post_px, CASE side WHEN 'buy' THEN b.bid_sz_1 ELSE b.ask_sz_1 END AS queue, CAST(notional AS DOUBLE) AS q
FROM (SELECT symbol, day, t0, make_timestamp(t0) AS ts, CASE WHEN substr(md5(symbol || '|' || t0 || '|7'), 1, 1) < '8' THEN 'buy' ELSE 'sell' END AS side, unnest([1e3, 2e4]) AS notional FROM (
  SELECT symbol, CAST(ts AS DATE) AS day, unnest(generate_series(epoch_us(min(ts)) + 60000000, epoch_us(max(ts)) - 70000000, 7200000000)) AS t0 FROM v_book GROUP BY 1, 2)) g
ASOF JOIN v_book b ON g.symbol = b.symbol AND g.ts >= b.ts"""

VIEWS["v_win"] = """
SELECT CAST(k AS INTEGER) AS split_id, make_timestamp((lo + k * 90) * 86400000000) AS train_start, make_timestamp((lo + k * 90 + 365) * 86400000000) AS train_end,
  make_timestamp((lo + k * 90 + 455) * 86400000000) AS test_end
FROM (SELECT epoch_us(min(ts)) // 86400000000 AS lo, (epoch_us(max(ts)) + 86399999999) // 86400000000 AS hi FROM v_panel), range(10000) r(k) WHERE lo + k * 90 + 455 <= hi"""

VIEWS["v_wfit"] = """
SELECT f.split_id, f.pair, any_value(f.sym_a) AS sym_a, any_value(f.sym_b) AS sym_b, any_value(f.alpha) AS alpha, any_value(f.beta) AS beta, any_value(f.n) AS n, any_value(f.sd) AS sd,
  regr_slope(x - p, p) AS b, sqrt(greatest(regr_syy(x - p, p) - regr_sxy(x - p, p) * regr_sxy(x - p, p) / regr_sxx(x - p, p), 0e0) / regr_count(x - p, p)) AS rsd
FROM (SELECT w.split_id, r.pair, r.i, r.la - f.alpha - f.beta * r.lb AS x, lag(r.la - f.alpha - f.beta * r.lb) OVER (PARTITION BY w.split_id, r.pair ORDER BY r.i) AS p, f.* EXCLUDE (split_id, pair)
  FROM v_pair_rows r JOIN v_win w ON r.ts >= w.train_start AND r.ts < w.train_end
  JOIN (SELECT w.split_id, r.pair, any_value(r.sym_a) AS sym_a, any_value(r.sym_b) AS sym_b, regr_intercept(la, lb) AS alpha, regr_slope(la, lb) AS beta, count(*) AS n,
      sqrt(greatest(regr_syy(la, lb) - regr_sxy(la, lb) * regr_sxy(la, lb) / regr_sxx(la, lb), 0e0) / count(*)) AS sd
    FROM v_pair_rows r JOIN v_win w ON r.ts >= w.train_start AND r.ts < w.train_end GROUP BY 1, 2) f ON f.split_id = w.split_id AND f.pair = r.pair) f
GROUP BY f.split_id, f.pair"""

VIEWS["v_ou"] = """
SELECT *, CAST(row_number() OVER (PARTITION BY split_id ORDER BY half_life, resid_ratio, pair) AS INTEGER) AS rank FROM (
SELECT *, -ln(2e0) / ln(1 + b) AS half_life, rsd / sd AS resid_ratio FROM v_wfit WHERE b > -1 AND b < 0 AND beta > 0 AND n >= 365 * 9e-1 AND rsd > 0 AND sd > 0)
WHERE half_life BETWEEN 2 AND 90 QUALIFY row_number() OVER (PARTITION BY split_id ORDER BY half_life, resid_ratio, pair) <= 5"""

VIEWS["v_walk"] = """
SELECT o.split_id, o.pair, o.half_life, r.ts, r.i, r.la, r.lb, r.la - o.alpha - o.beta * r.lb AS spread, (r.la - o.alpha - o.beta * r.lb) / o.sd AS z,
  coalesce(r.la - lag(r.la) OVER w - (r.lb - lag(r.lb) OVER w), 0e0) AS sr
FROM v_ou o JOIN v_win x ON x.split_id = o.split_id JOIN v_pair_rows r ON r.pair = o.pair AND r.ts >= x.train_end AND r.ts < x.test_end WINDOW w AS (PARTITION BY o.split_id, o.pair ORDER BY r.i)"""

VIEWS["v_wpos"] = """
SELECT *, coalesce(first_value(e IGNORE NULLS) OVER (PARTITION BY split_id, pair, g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0e0) AS position FROM (
SELECT *, sum(CASE WHEN x THEN 1 ELSE 0 END) OVER (PARTITION BY split_id, pair ORDER BY i) AS g, CASE WHEN x THEN NULL WHEN z >= 2 THEN -1e0 WHEN z <= -2 THEN 1e0 END AS e
FROM (SELECT *, (abs(z) <= 5e-1 OR abs(z) >= 4) AS x FROM v_walk))"""

VIEWS["v_wunit"] = """
SELECT *, held * sr AS gross, abs(position - held) AS dpos, held * sr - abs(position - held) * 2e0 * 15e0 / 1e4 AS net FROM (
SELECT *, coalesce(lag(position) OVER (PARTITION BY split_id, pair ORDER BY i), 0e0) AS held FROM v_wpos)"""

VIEWS["v_wport"] = "SELECT ts, i, split_id, avg(net) AS pnl, avg(gross) AS gross FROM v_wunit GROUP BY ts, i, split_id"
