"""Common table expressions of the lineitem and events mappings."""

from __future__ import annotations

from collections.abc import Sequence

from checks.base import DEPENDS, cte
from waferlake import fixtures as fx

R = "vehicle, step_id, lot_id"
W = f"{R}, wafer_id"
RI = f"{R}, item"
WI = f"{W}, item"
P = "vehicle, step_id"
PI = f"{P}, item"


def chain(name: str, deps: str, text: str) -> None:
    """A CTE and everything it needs, in order."""
    full: list[str] = []
    for d in deps.split():
        for x in [*DEPENDS.get(d, "").split(), d]:
            if x not in full:
                full.append(x)
    DEPENDS[name] = " ".join(full)
    cte(name, text)


def solved_sql(source: str, keep: str, n: int, names: Sequence[str], tables: str, deps: str | None = None) -> None:
    """Register common table expressions that solve a system m .. = v .. per row: elimination of the full matrix, pivot by pivot."""
    cell = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    full = [f"{cell(i, j)} AS a{i}{j}" for i in range(n) for j in range(n)] + [f"v{i} AS a{i}{n}" for i in range(n)]
    out = {f"{tables}0": f"SELECT {keep}, {', '.join(full)} FROM {source}"}
    for k in range(n):
        cols = []
        for i in range(n):
            for j in range(n + 1):
                cols.append(f"a{k}{j} / a{k}{k} AS a{k}{j}" if i == k else f"a{i}{j} - a{i}{k} * a{k}{j} / a{k}{k} AS a{i}{j}")
        out[f"{tables}{k + 1}"] = f"SELECT {keep}, {', '.join(cols)} FROM {tables}{k}"
    out[tables] = f"SELECT {keep}, {', '.join(f'a{i}{n} AS {names[i]}' for i in range(n))} FROM {tables}{n}"
    before = deps or source
    for name, text in out.items():
        chain(name, before, text)
        before = name


def robust(name: str, src: str, keys: str, value: str) -> None:
    """name(keys, n, median, std, spread, v_min, v_max) over a relation."""
    chain(f"{name}_m", src, f"""SELECT {keys}, count(*) AS n, median({value}) AS median, quantile_cont({value}, 0.25) AS q1,
 quantile_cont({value}, 0.75) AS q3, stddev_samp({value}) AS sd, min({value}) AS v_min, max({value}) AS v_max
 FROM {src} WHERE {value} IS NOT NULL GROUP BY {keys}""")
    chain(f"{name}_d", f"{src} {name}_m", f"""SELECT {keys}, median(abs(s.{value} - m.median)) AS mad
 FROM {src} s JOIN {name}_m m USING ({keys}) WHERE s.{value} IS NOT NULL GROUP BY {keys}""")
    chain(name, f"{name}_m {name}_d", f"""SELECT {keys}, n, median, coalesce(sd, 0) AS std, v_min, v_max,
 CASE WHEN 1.4826 * mad > 0 THEN 1.4826 * mad WHEN (q3 - q1) / 1.349 > 0 THEN (q3 - q1) / 1.349 WHEN sd > 0 THEN sd END AS spread
 FROM {name}_m JOIN {name}_d USING ({keys})""")


chain("rows_", "", """SELECT 'V' || l_linestatus AS vehicle, 'S' || l_returnflag AS step_id,
 'L' || lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(5, length(CAST(l_suppkey AS VARCHAR))) AS INT), '0') AS lot_id, 'R' || CAST(l_suppkey // 4 AS VARCHAR) AS root_lot_id,
 l_linenumber AS wafer_id, l_partkey % 13 AS chip_x, (l_partkey // 13) % 13 AS chip_y,
 CAST(date_trunc('quarter', l_shipdate) AS TIMESTAMP) AS tkout_time, l_shipdate AS raw_time,
 l_quantity AS QTY, l_extendedprice AS PRICE, l_discount AS DISC, l_tax AS TAX,
 row(l_shipdate, l_partkey, l_quantity, l_discount, l_tax) AS ord
 FROM lineitem""")
chain("wide", "rows_", f"""SELECT {W}, root_lot_id, chip_x, chip_y, tkout_time, arg_max(QTY, ord) AS QTY, arg_max(PRICE, ord) AS PRICE,
 arg_max(DISC, ord) AS DISC, arg_max(TAX, ord) AS TAX FROM rows_ GROUP BY {W}, root_lot_id, chip_x, chip_y, tkout_time""")
chain("shots", "wide", """SELECT *, PRICE / QTY AS UNIT, PRICE * (1 - DISC) AS NET,
 greatest(PRICE * (1 - DISC), PRICE / QTY) AS BEST, TAX AS PCHK_TAX FROM wide""")
chain("pts", "shots", """SELECT vehicle, step_id, lot_id, wafer_id, root_lot_id, chip_x, chip_y, tkout_time, item, value
 FROM (UNPIVOT shots ON QTY, PRICE, DISC, TAX, UNIT, NET, BEST, PCHK_TAX INTO NAME item VALUE value)""")


def literal(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def item_values(items) -> str:
    rows = ", ".join(
        f"({literal(i.alias)}, CAST({literal(i.report_order)} AS DOUBLE), CAST({literal(i.spec_low)} AS DOUBLE), "
        f"CAST({literal(i.spec_high)} AS DOUBLE), {literal(i.direction or 'BOTH')}, {literal(i.cat2)}, {n})"
        for n, i in enumerate(items)
    )
    return f"SELECT * FROM (VALUES {rows}) t(item, report_order, lo, hi, dir, cat2, decl_order)"


chain("items", "", item_values(fx.LI_ITEMS))
chain("ev_items", "", item_values(fx.EV_ITEMS))
robust("waf", "pts", WI, "value")
robust("wm", "waf", PI, "median")
chain("typ", "waf", f"SELECT {PI}, median(spread) AS typical FROM waf WHERE spread > 0 GROUP BY {PI}")
chain("base", "wm typ", f"""SELECT {PI}, wm.median AS center, wm.spread AS scatter, typical
 FROM wm LEFT JOIN typ USING ({PI})""")
chain("flag", "pts waf base items", f"""SELECT {WI}, count(*) FILTER (value < lo) AS n_below, count(*) FILTER (value > hi) AS n_above,
 count(*) FILTER (CASE dir WHEN 'UPPER' THEN (value - median) / typical > 3.5 OR (value - median) / typical < -7.0
  WHEN 'LOWER' THEN (value - median) / typical < -3.5 OR (value - median) / typical > 7.0
  ELSE abs((value - median) / typical) > 3.5 END) AS n_flier
 FROM pts JOIN waf USING ({WI}) JOIN base USING ({PI}) JOIN items USING (item) GROUP BY {WI}""")
chain("scored", "waf base flag items", f"""SELECT {WI}, n, median, std, spread, v_min, v_max, center, scatter, typical, lo, hi, dir, report_order, cat2,
 n_below, n_above, n_below + n_above AS n_out,
 CASE WHEN scatter > 0 THEN abs(median - center) / scatter END AS shift,
 CASE WHEN typical > 0 THEN spread / typical END AS ratio,
 CASE WHEN n >= 5 AND n_flier >= 1 THEN n_flier END AS flier_count,
 CASE WHEN n >= 5 AND n_flier >= 1 THEN CASE dir
   WHEN 'UPPER' THEN CASE WHEN v_max > median THEN v_max - median ELSE greatest(v_max - median, median - v_min) END
   WHEN 'LOWER' THEN CASE WHEN median > v_min THEN median - v_min ELSE greatest(v_max - median, median - v_min) END
   ELSE greatest(v_max - median, median - v_min) END / typical END AS flier_dev
 FROM waf JOIN base USING ({PI}) JOIN flag USING ({WI}) JOIN items USING (item)""")
chain("stats", "scored", f"""SELECT *, CASE WHEN n_out > 0 THEN 'CRITICAL' WHEN flier_wafer IS NOT NULL OR disp_ratio > 2.0 THEN 'WARNING' ELSE 'INFO' END AS severity,
 CASE WHEN n_out > 0 THEN 2 WHEN flier_wafer IS NOT NULL OR disp_ratio > 2.0 THEN 1 ELSE 0 END AS level,
 CASE WHEN typical > 0 THEN coalesce(rep_spread / typical, 0) ELSE 0 END AS rstd_ratio,
 (cat2 = 'PCHK' OR item LIKE '%PCHK%') AS is_check
 FROM (SELECT {RI}, sum(n) AS n, sum(n_out) AS n_out, sum(n_below) AS n_below, sum(n_above) AS n_above, max(n_out / n) AS max_ratio,
 count(*) FILTER (n_out > 0) AS out_wafers, coalesce(max(shift), 0) AS shift,
 arg_max(wafer_id, row(shift, -wafer_id)) FILTER (shift > 0) AS shift_wafer,
 coalesce(max(ratio), 0) AS disp_ratio, arg_max(wafer_id, row(ratio, -wafer_id)) FILTER (ratio > 0) AS disp_wafer,
 coalesce(max(flier_dev), 0) AS flier_dev, arg_max(wafer_id, row(flier_dev, -wafer_id)) FILTER (flier_dev > 0) AS flier_wafer,
 coalesce(arg_max(flier_count, row(flier_dev, -wafer_id)) FILTER (flier_dev > 0), 0) AS flier_count,
 median(median) AS rep_median, median(std) AS rep_std, median(spread) AS rep_spread, max(center) AS center, max(scatter) AS scatter,
 max(typical) AS typical, max(lo) AS spec_low, max(hi) AS spec_high, max(dir) AS direction, max(report_order) AS report_order, max(cat2) AS cat2
 FROM scored GROUP BY {RI})""")
chain("find", "stats", f"""SELECT *, CASE type WHEN 'FLIER' THEN flier_wafer WHEN 'DISPERSION' THEN disp_wafer END AS worst_wafer,
 CASE WHEN type <> 'SPEC_OUT' THEN NULL WHEN n_below > 0 AND n_above > 0 THEN 'outside spec range' WHEN n_below > 0 THEN 'below lower spec'
  WHEN n_above > 0 THEN 'above upper spec' END AS side,
 CASE type WHEN 'SPEC_OUT' THEN 20000 + 100 * max_ratio + out_wafers / 100.0 WHEN 'FLIER' THEN 10000 + 100 * flier_dev / 3.5
  ELSE 10000 + 100 * disp_ratio END AS p
 FROM (SELECT *, CASE WHEN n_out > 0 THEN 'SPEC_OUT' WHEN flier_wafer IS NOT NULL THEN 'FLIER' WHEN disp_ratio > 2.0 THEN 'DISPERSION' END AS type FROM stats)
 WHERE type IS NOT NULL""")
chain("ranked", "find", f"""SELECT *, round(p, 3) AS priority,
 row_number() OVER (PARTITION BY {R} ORDER BY p DESC, coalesce(report_order, 1e9), item, type) AS rank FROM find""")
robust("pop", "pts", PI, "value")
chain("tmed", "pts", f"SELECT {RI}, median(value) AS target_median FROM pts GROUP BY {RI}")
chain("outp", "pts items", "SELECT p.*, dir, cat2 FROM pts p JOIN items USING (item) WHERE value < lo OR value > hi")
chain("layout", "rows_", """SELECT vehicle, chip_x, chip_y, sqrt((12.0 * (chip_x - 6)) ** 2 + (15.0 * (chip_y - 6)) ** 2) AS radius
 FROM (SELECT DISTINCT vehicle, chip_x, chip_y FROM rows_)""")
chain("ev", "", """SELECT 'EV' AS vehicle, 'S1' AS step_id, 'E' || CAST(user_id % 25 AS VARCHAR) AS lot_id,
 'R' || CAST((user_id % 25) // 4 AS VARCHAR) AS root_lot_id, 1 + hour(ts) // 4 AS wafer_id,
 k % 10 AS chip_x, k // 10 AS chip_y, ts AS tkout_time, event_type AS item, value, event_id, k
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
chain("outw", "outp", f"SELECT {RI}, count(*) AS n_points, count(DISTINCT wafer_id) AS n_wafers FROM outp GROUP BY {RI}")
chain("sites", "outp", f"""SELECT {RI}, chip_x, chip_y, count(*) AS points, count(DISTINCT wafer_id) AS wafers
 FROM outp GROUP BY {RI}, chip_x, chip_y""")
chain("seqw", "pts items", f"""SELECT {WI}, chip_x, chip_y, tkout_time, CAST(coalesce(value < lo, false) OR coalesce(value > hi, false) AS INT) AS out_,
 row_number() OVER (PARTITION BY {WI} ORDER BY chip_y, chip_x, tkout_time) AS seq_no, count(*) OVER (PARTITION BY {WI}) AS n
 FROM pts JOIN items USING (item) WHERE lo IS NOT NULL OR hi IS NOT NULL""")
chain("island", "seqw", f"""SELECT *, seq_no - sum(out_) OVER (PARTITION BY {WI} ORDER BY seq_no) AS isl FROM seqw WHERE n >= 5""")
chain("runs", "island", f"""SELECT {WI}, n, isl, sum(out_) AS run, coalesce(sum(out_) FILTER (seq_no <= greatest(1, n // 2)), 0) AS front,
 coalesce(sum(out_) FILTER (seq_no > greatest(1, n // 2)), 0) AS back FROM island GROUP BY {WI}, n, isl""")
chain("seqwaf", "runs", f"""SELECT {WI}, n, max(run) AS run, sum(run) / n AS dead, sum(front) / greatest(1, n // 2) AS front,
 sum(back) / greatest(1, n - greatest(1, n // 2)) AS back FROM runs GROUP BY {WI}, n""")
chain("seq", "seqwaf", f"""SELECT {RI}, max(run) AS seq_run, max(dead) AS seq_dead, max(front) AS seq_front, min(back) AS seq_back
 FROM seqwaf GROUP BY {RI}""")
chain("shape0", "sites layout", f"""SELECT s.*, radius / r_max AS rn, chip_x - cx AS dx, chip_y - cy AS dy, n_all,
 sqrt((chip_x - cx) ** 2 + (chip_y - cy) ** 2) AS d
 FROM sites s JOIN layout USING (vehicle, chip_x, chip_y)
 JOIN (SELECT vehicle, avg(chip_x) AS cx, avg(chip_y) AS cy, count(*) AS n_all, max(radius) AS r_max FROM layout GROUP BY vehicle) USING (vehicle)""")
chain("shape1", "shape0", f"""SELECT {RI}, count(*) AS n_sites, round(count(*) / max(n_all), 3) AS share,
 count(DISTINCT chip_x) AS lanes_x, count(DISTINCT chip_y) AS lanes_y,
 round(avg(CAST(rn >= 0.0 AND rn < 0.45 AS INT)), 3) AS band_c, round(avg(CAST(rn >= 0.85 AND rn < 1.01 AS INT)), 3) AS band_e,
 round(avg(CAST(rn >= 0.45 AND rn < 0.85 AS INT)), 3) AS band_m,
 count(*) FILTER (rn >= 0.4 AND d > 0) AS far, avg(dx / d) FILTER (rn >= 0.4 AND d > 0) AS ux, avg(dy / d) FILTER (rn >= 0.4 AND d > 0) AS uy,
 count(*) FILTER (dx >= 0 AND dy >= 0) / count(*) AS ur, count(*) FILTER (dx < 0 AND dy >= 0) / count(*) AS ul,
 count(*) FILTER (dx < 0 AND dy < 0) / count(*) AS ll, count(*) FILTER (dx >= 0 AND dy < 0) / count(*) AS lr
 FROM shape0 GROUP BY {RI}""")
chain("shape", "shape1", f"""SELECT {RI}, n_sites, share AS metric_0, CAST(lanes_x AS DOUBLE) AS metric_1, CAST(lanes_y AS DOUBLE) AS metric_2,
 band_c AS metric_3, band_e AS metric_4, band_m AS metric_5,
 CASE WHEN far >= 3 AND far / n_sites >= 0.75 THEN round(sqrt(ux * ux + uy * uy), 3) END AS metric_6,
 greatest(ur, ul, ll, lr) AS quad, greatest(ur + ul, ll + lr, ur + lr, ul + ll) AS half, ux, uy FROM shape1""")
chain("verdict", "shape", f"""SELECT *, round(quad, 2) AS metric_7, round(half, 2) AS metric_8, CASE WHEN n_sites < 3 THEN 'few points' WHEN metric_0 >= 0.5 THEN 'whole wafer'
 WHEN n_sites >= 4 AND metric_1 <= 2 THEN 'vertical line' WHEN n_sites >= 4 AND metric_2 <= 2 THEN 'horizontal line'
 WHEN metric_3 >= 0.7 THEN 'center' WHEN metric_4 >= 0.7 THEN 'edge ring' WHEN metric_5 >= 0.7 THEN 'middle ring'
 WHEN metric_6 >= 0.92 THEN 'clock ' || CAST(CASE WHEN h = 0 THEN 12 ELSE h END AS VARCHAR)
 WHEN quad >= 0.7 THEN 'quadrant' WHEN half >= 0.75 THEN 'half' ELSE 'scattered' END AS verdict
 FROM (SELECT *, CAST(round_even(((degrees(atan2(ux, uy)) + 360.0) % 360.0) / 30.0, 0) AS INT) % 12 AS h FROM shape)""")
chain("pattern", "verdict outw", f"""SELECT {RI}, n_points, n_wafers, (n_wafers <= 2 AND n_points < 4) AS gated,
 CASE WHEN NOT (n_wafers <= 2 AND n_points < 4) THEN verdict END AS pattern FROM outw LEFT JOIN verdict USING ({RI})""")
chain("repeats", "sites pattern", f"""SELECT {RI}, n_sites, n_repeat, overlap,
 CASE WHEN n_wafers >= 3 AND coalesce(pattern, '') <> 'whole wafer' THEN CASE WHEN n_repeat > 0 THEN 'same site' WHEN overlap >= 0.5 THEN 'similar sites' END END AS repeat_kind
 FROM (SELECT {RI}, count(*) AS n_sites, count(*) FILTER (wafers >= 3) AS n_repeat, avg(CAST(wafers >= 2 AS INT)) AS overlap FROM sites GROUP BY {RI})
 JOIN pattern USING ({RI})""")
chain("zonec", "outp layout", f"""SELECT {RI}, CASE WHEN radius <= 60 THEN 'Center' WHEN radius <= 100 THEN 'Middle' ELSE 'Edge' END AS zone, count(*) AS n
 FROM outp JOIN layout USING (vehicle, chip_x, chip_y) GROUP BY ALL""")
chain("overs", "shots", """SELECT vehicle, step_id, lot_id, wafer_id, chip_x, chip_y, tkout_time, 'PCHK_TAX' AS item,
 list_filter([CASE WHEN QTY < 1 OR QTY > 50 THEN 'QTY' END, CASE WHEN PRICE > 104000 THEN 'PRICE' END, CASE WHEN DISC > 1 THEN 'DISC' END,
 CASE WHEN TAX > 1 THEN 'TAX' END, CASE WHEN UNIT > 90000 THEN 'UNIT' END], lambda x: x IS NOT NULL) AS with_items
 FROM shots WHERE PCHK_TAX > 0.07""")
chain("over", "overs", f"SELECT {RI}, count(*) AS overlap_shots FROM overs WHERE len(with_items) > 0 GROUP BY {RI}")
chain("pctile", "tmed pts", f"""SELECT {RI}, target_median,
 100.0 * avg(CAST(v < target_median AS INT)) AS pctile FROM tmed JOIN (SELECT {PI}, value AS v FROM pts) USING ({PI}) GROUP BY {RI}, target_median""")
