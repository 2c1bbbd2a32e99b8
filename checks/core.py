"""Statistics, detectors, ranking and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import query
from checks.common import PI, R, RI, W, WI
from waferlake import fixtures as fx
from waferlake.functions import ordered, robust
from waferlake.functions.formulas import add_formulas, row_values
from waferlake.operators import board, detect, order, overlap, rank, reshape, spatial, testlevel
from waferlake.plans.report import Report, basis_rows, severity_counts
from waferlake.schema import PRODUCT, REPORT, SHOT_KEY, SITE, WAFER, Limits


def li(spark, sf) -> Report:
    # the formulas of these items have no group statistics
    derived = [i.alias for i in fx.LI_ITEMS if i.formula]
    return Report(
        fx.li_shots(spark, sf), fx.LI_ITEMS, Limits(), row_columns=lambda df: add_formulas(df, fx.LI_ITEMS).frame, made=derived,
        row_values=lambda measured: row_values(measured, fx.LI_ITEMS), met=lambda keys: fx.li_shots_met(spark, sf, keys))


def pts(spark, sf, extra=("root_lot_id",)):
    return reshape.points(fx.li_shots(spark, sf), fx.LI_ALL, [*WAFER, *SITE, *extra])


def stored_pts(spark, sf, extra=("root_lot_id",)):
    """The same over stored shots, for plans that read them more than once."""
    return reshape.points(li(spark, sf).stored().shots, fx.LI_ALL, [*WAFER, *SITE, *extra])


KR = "vehicle step_id lot_id"
KW = f"{KR} wafer_id:i"
KRI, KWI = f"{KR} item", f"{KW} item"


@query(f"{KW} chip_x:i chip_y:i tkout_time:t QTY:d PRICE:d DISC:d TAX:d", "wide", "wide")
def long_to_wide(spark, sf):
    return reshape.last_value_pivot(fx.li_long(spark, sf), SHOT_KEY, fx.LI_MEASURED, "item_id", "value", "ord")


@query(f"{KW} item n:i total:f", f"(SELECT {WI}, count(*) AS n, sum(value) AS total FROM pts GROUP BY {WI})", "pts")
def wide_to_long(spark, sf):
    return pts(spark, sf).groupBy(*WAFER, "item").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"{KWI} n:i median:d std:f spread:d v_min:d v_max:d", "waf", "waf")
def wafer_robust_stats(spark, sf):
    return li(spark, sf).wafers()


@query(f"vehicle step_id item center:d scatter:d typical:d", "base", "base")
def product_wafer_baseline(spark, sf):
    return li(spark, sf).baseline()


@query("vehicle step_id item pop_median:d pop_spread:d",
       f"(SELECT {PI}, median AS pop_median, spread AS pop_spread FROM pop)", "pop")
def population_robust_stats(spark, sf):
    return li(spark, sf).population()


@query(f"{KWI} n_below:i n_above:i n_out:i shift:d ratio:d flier_count:i flier_dev:d", "scored", "scored")
def scored_wafers(spark, sf):
    return li(spark, sf).scored()


@query(f"{KRI} n_out:i max_ratio:d out_wafers:i out_text",
       f"""(SELECT {RI}, n_out, max_ratio, out_wafers, out_text FROM stats JOIN (
 SELECT {RI}, string_agg(n || 'pt, ' || n_out || 'pt out: ' || ws, ' / ' ORDER BY n, n_out) AS out_text FROM (
  SELECT {RI}, n, n_out, string_agg('#' || wafer_id, ', ' ORDER BY wafer_id) AS ws FROM scored WHERE n_out > 0 GROUP BY {RI}, n, n_out)
 GROUP BY {RI}) USING ({RI}))""", "stats")
def spec_out_by_wafer(spark, sf):
    sc = li(spark, sf).scored()
    agg = sc.where("n_out > 0").groupBy(*REPORT, "item").agg(
        F.sum("n_out").alias("n_out"), F.max(F.col("n_out") / F.col("n")).alias("max_ratio"), F.count("*").alias("out_wafers")
    )
    return agg.join(detect.out_text(sc), detect.REPORT_ITEM)


@query(f"{KRI} rep_median:d rep_std:f rep_spread:d rstd_ratio:d", "stats", "stats")
def representative_values(spark, sf):
    return li(spark, sf).items_scored()


@query(f"{KRI} shift:d shift_wafer:i disp_ratio:d disp_wafer:i flier_dev:d flier_wafer:i flier_count:i severity level:i is_check:b",
       "stats", "stats")
def worst_wafers_and_severity(spark, sf):
    return li(spark, sf).items_scored()


@query(f"{KRI} severity type worst_wafer:i side priority:d rank:i", "ranked", "ranked")
def ranked_findings(spark, sf):
    return li(spark, sf).ranked()


@query(f"{KR} critical:i warning:i",
       f"(SELECT {R}, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS warning FROM find GROUP BY {R})", "find")
def severity_totals(spark, sf):
    return severity_counts(li(spark, sf).findings())


@query(f"{KRI} rank:i total:i", f"(SELECT *, count(*) OVER (PARTITION BY {R}) AS total FROM ranked) WHERE rank <= 3", "ranked")
def top_findings(spark, sf):
    return rank.shown(li(spark, sf).ranked(), 3)


@query(f"{KRI} disp_ratio:d worst_wafer:i type", f"""(SELECT {RI}, disp_ratio, disp_wafer AS worst_wafer, 'DISPERSION' AS type FROM stats
 WHERE n_out = 0 AND disp_ratio > 2.0 AND (NOT (spec_low IS NOT NULL AND spec_high > spec_low) OR disp_ratio * typical >= 0.1 * (spec_high - spec_low)))""", "stats")
def dispersion_findings(spark, sf):
    """Dispersion alone: flier test off, absolute gate at a tenth of the spec width."""
    lim = Limits(flier_sigma=0.0, dispersion_spec_fraction=0.1)
    r = li(spark, sf)
    return Report(r.shots, r.items, lim).findings().where("type = 'DISPERSION'")


@query(f"{KRI} severity type n_out:i", f"""(SELECT {RI}, n_out, CASE WHEN n_out > 0 AND is_check THEN 'NOTICE' WHEN n_out > 0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
 CASE WHEN n_out > 0 AND is_check THEN 'MEAS_SUSPECT' ELSE type END AS type FROM find WHERE item NOT LIKE 'UNIT%' AND NOT (is_check AND n_out = 0))""", "find")
def excluded_items(spark, sf):
    """Excluded device items vanish; an excluded check item stays as a notice."""
    r = li(spark, sf)
    return Report(r.shots, r.items, Limits(exclude=("unit*", "*pchk*"))).findings()


@query(f"{KRI} target_median:d pctile:d", "pctile", "pctile")
def median_percentile(spark, sf):
    return li(spark, sf).target_percentile()


@query(f"{KWI} chip_x:i chip_y:i tkout_time:t out:i seq_no:i",
       "(SELECT *, out_ AS out FROM seqw)", "seqw")
def measurement_order(spark, sf):
    shots = fx.li_shots_met(spark, sf, WAFER)
    if shots is not None:
        return order.measurement_order_met(shots, fx.LI_ITEMS)
    return order.measurement_order(pts(spark, sf, ()), fx.li_items(spark))


@query(f"{KWI} n:i run:i dead:d front:d back:d", "seqwaf", "seqwaf")
def wafer_sequences(spark, sf):
    return order.wafer_sequences_wide(li(spark, sf).stored().shots, fx.LI_ITEMS, Limits())


@query(f"{KRI} seq_run:i seq_dead:d seq_front:d seq_back:d front_heavy:b",
       "(SELECT *, seq_front >= 0.6 AND seq_back <= 0.2 AS front_heavy FROM seq)", "seq")
def item_sequences(spark, sf):
    return li(spark, sf).sequence().withColumn("front_heavy", order.front_heavy("seq_front", "seq_back"))


def _out(spark, sf):
    return spatial.out_points(pts(spark, sf), fx.li_items(spark))


def _radius(spark, sf):
    return fx.li_layout(spark, sf).select(F.col("mask").alias("vehicle"), "chip_x", "chip_y", F.col("chip_radius").alias("radius"))


@query(f"{KWI} chip_x:i chip_y:i tkout_time:t value:d", "outp", "outp")
def spec_out_points(spark, sf):
    return _out(spark, sf)


@query(f"{KRI} zone n:i", "zonec", "zonec")
def spec_out_zones(spark, sf):
    return spatial.zone_counts(_out(spark, sf), _radius(spark, sf), Limits())


@query("vehicle chip_x:i chip_y:i radius:d",
       """(SELECT vehicle, chip_x, chip_y, avg(radius) AS radius FROM shots JOIN layout USING (vehicle, chip_x, chip_y) GROUP BY ALL)""", "shots layout")
def site_radius(spark, sf):
    return spatial.radius_map(reshape.place_on_layout(fx.li_shots(spark, sf), fx.li_layout(spark, sf)))


@query(f"{KRI} n_sites:i metric_0:d metric_1:d metric_2:d metric_3:d metric_4:d metric_5:d metric_6:d metric_7:d metric_8:d pattern",
       "(SELECT * RENAME (verdict AS pattern) FROM verdict)", "verdict")
def pattern_rules(spark, sf):
    """Every shape's metric and the first shape that passes."""
    sites = spatial.out_sites(_out(spark, sf))
    return spatial.verdict(spatial.shape_metrics(sites, _radius(spark, sf)))


@query(f"{KRI} n_points:i n_wafers:i gated:b pattern", "pattern", "pattern")
def gated_patterns(spark, sf):
    out = _out(spark, sf)
    v = spatial.verdict(spatial.shape_metrics(spatial.out_sites(out), _radius(spark, sf)))
    return spatial.gated(v, spatial.out_wafers(out), Limits())


@query(f"{KRI} n_sites:i n_repeat:i overlap:d repeat_kind repeat_sites", f"""(SELECT r.*, CASE WHEN repeat_kind = 'same site' THEN top END AS repeat_sites FROM repeats r LEFT JOIN (
 SELECT {RI}, string_agg('(' || chip_x || ',' || chip_y || ')x' || wafers, ', ' ORDER BY k) AS top FROM (
  SELECT *, row_number() OVER (PARTITION BY {RI} ORDER BY wafers DESC, chip_x, chip_y) AS k FROM sites WHERE wafers >= 3) WHERE k <= 3 GROUP BY {RI}) USING ({RI}))""", "repeats")
def repeated_sites(spark, sf):
    out = _out(spark, sf)
    sites = spatial.out_sites(out)
    v = spatial.gated(spatial.verdict(spatial.shape_metrics(sites, _radius(spark, sf))), spatial.out_wafers(out), Limits())
    return spatial.repeat_comment(sites, v, Limits())


@query(f"{KRI} wafer_id:i chip_x:i chip_y:i tkout_time:t rank:i total:i rest:i",
       f"""(SELECT *, greatest(total - 20, 0) AS rest FROM (SELECT *, row_number() OVER (PARTITION BY {RI} ORDER BY wafer_id, chip_y, chip_x, tkout_time) AS rank,
 count(*) OVER (PARTITION BY {RI}) AS total FROM outp) WHERE rank <= 20)""", "outp")
def sample_positions(spark, sf):
    return spatial.sample_positions(_out(spark, sf), Limits())


def _over(spark, sf):
    return overlap.shot_overlap(fx.li_shots(spark, sf), fx.LI_ITEMS)


@query(f"{KRI} overlap_shots:i", "over", "over")
def shot_overlap(spark, sf):
    return overlap.overlap_counts(_over(spark, sf))


@query(f"{KRI} with_item shots:i", f"""(SELECT {RI}, w AS with_item, count(*) AS shots
 FROM (SELECT {RI}, unnest(with_items) AS w FROM overs) GROUP BY {RI}, w)""", "overs")
def shot_overlap_items(spark, sf):
    return overlap.overlap_items(_over(spark, sf))


@query(f"{KRI} with_item shots:i", f"""(SELECT {RI}, w AS with_item, count(*) AS shots FROM (SELECT {RI}, unnest(with_items) AS w FROM overs)
 WHERE w IN ('PRICE', 'UNIT') GROUP BY {RI}, w)""", "overs")
def shot_overlap_scoped(spark, sf):
    """Check item limited to one category."""
    return overlap.overlap_items(overlap.shot_overlap(fx.li_shots(spark, sf), fx.LI_ITEMS, {"PCHK_TAX": ["MONEY"]}))


@query(f"{KW} item chip_x:i chip_y:i with_text rank:i", f"""(SELECT * FROM (SELECT *, array_to_string(with_items, ',') AS with_text,
 row_number() OVER (PARTITION BY {RI} ORDER BY wafer_id, chip_y, chip_x, tkout_time) AS rank FROM overs WHERE len(with_items) > 0) WHERE rank <= 5)""", "overs")
def shot_overlap_examples(spark, sf):
    return overlap.overlap_examples(_over(spark, sf)).withColumn("with_text", F.array_join("with_items", ","))


CTX_SQL = f"""(SELECT s.*, pop.median AS pop_median, pop.spread AS pop_spread, target_median, pctile,
 coalesce(seq_run, 0) AS seq_run, coalesce(seq_dead, 0) AS seq_dead, coalesce(seq_front, 0) AS seq_front, coalesce(seq_back, 1) AS seq_back,
 pattern, repeat_kind, coalesce(overlap_shots, 0) AS overlap_shots, zone_center, zone_middle, zone_edge
 FROM stats s JOIN pop USING ({PI}) JOIN pctile USING ({RI}) LEFT JOIN seq USING ({RI}) LEFT JOIN pattern USING ({RI}) LEFT JOIN repeats USING ({RI})
 LEFT JOIN over USING ({RI}) LEFT JOIN (SELECT {RI}, coalesce(sum(n) FILTER (zone = 'Center'), 0) / sum(n) AS zone_center,
  coalesce(sum(n) FILTER (zone = 'Middle'), 0) / sum(n) AS zone_middle, coalesce(sum(n) FILTER (zone = 'Edge'), 0) / sum(n) AS zone_edge
  FROM zonec GROUP BY {RI}) z USING ({RI}))"""
CTX = "stats pop pctile seq repeats pattern over zonec"


@query(f"{KRI} level:i n_out:i disp_ratio:d rep_median:d rep_std:f rstd_ratio:d pop_median:d pop_spread:d target_median:d pctile:d "
       "seq_run:i seq_dead:d seq_front:d seq_back:d pattern repeat_kind overlap_shots:i zone_center:d zone_middle:d zone_edge:d",
       CTX_SQL, CTX)
def item_context(spark, sf):
    return li(spark, sf).context(fx.li_layout(spark, sf))


@query(f"{KRI} severity is_check:b spec_out_total:i spec_out_max_wafer_ratio:d center:d scatter:d typical:d worst_median_dev_sigma:d "
       "worst_dispersion_ratio:d dispersion_gate_pass:b flier_points:i flier_max_dev_sigma:d",
       """(SELECT *, n_out AS spec_out_total, round(max_ratio, 4) AS spec_out_max_wafer_ratio, round(shift, 3) AS worst_median_dev_sigma,
 round(disp_ratio, 3) AS worst_dispersion_ratio, true AS dispersion_gate_pass, flier_count AS flier_points, round(flier_dev, 2) AS flier_max_dev_sigma FROM stats)""", "stats")
def basis_table(spark, sf):
    return basis_rows(li(spark, sf).items_scored())


@query(f"{KW} item pass_rate:d n:i", f"""(SELECT {WI}, avg(ok) * 100 AS pass_rate, count(*) AS n FROM (
 SELECT p.*, CASE dir WHEN 'UPPER' THEN CAST(coalesce(value <= hi, false) AS INT) WHEN 'LOWER' THEN CAST(coalesce(value >= lo, false) AS INT)
 ELSE CAST(coalesce(value >= lo, false) AND coalesce(value <= hi, false) AS INT) END AS ok FROM pts p JOIN items USING (item)) GROUP BY {WI})""", "pts items")
def pass_rates(spark, sf):
    return board.pass_rates_wide(fx.li_shots(spark, sf), fx.LI_ITEMS)


PASS = f"""(SELECT p.*, CASE dir WHEN 'UPPER' THEN CAST(coalesce(value <= hi, false) AS INT) WHEN 'LOWER' THEN CAST(coalesce(value >= lo, false) AS INT)
 ELSE CAST(coalesce(value >= lo, false) AND coalesce(value <= hi, false) AS INT) END AS ok FROM pts p JOIN items USING (item))"""


@query(f"{KRI} wafer_1:d wafer_2:d wafer_3:d wafer_4:d wafer_5:d wafer_6:d wafer_7:d",
       f"(SELECT {RI}, " + ", ".join(f"avg(ok) FILTER (wafer_id = {w}) * 100 AS wafer_{w}" for w in range(1, 8)) + f" FROM {PASS} GROUP BY {RI})", "pts items")
def pass_rate_board(spark, sf):
    return board.wafer_board(board.pass_rates_wide(fx.li_shots(spark, sf), fx.LI_ITEMS), range(1, 8))


@query("vehicle item lot_wafer pass_rate:d", f"(SELECT vehicle, item, lot_id || '_' || wafer_id AS lot_wafer, avg(ok) * 100 AS pass_rate FROM {PASS} GROUP BY ALL)", "pts items")
def pass_rates_by_lot_wafer(spark, sf):
    flags = board.pass_flags(pts(spark, sf), fx.li_items(spark))
    return board.pass_rates(flags, ["vehicle", "item", "lot_id", "wafer_id"]).withColumn("lot_wafer", F.concat_ws("_", "lot_id", "wafer_id"))


@query("vehicle step_id item band n:i", f"""(SELECT {PI}, CASE WHEN r >= 99 THEN '99' WHEN r >= 95 THEN '95' WHEN r >= 90 THEN '90' ELSE 'below' END AS band, count(*) AS n
 FROM (SELECT {WI}, avg(ok) * 100 AS r FROM {PASS} GROUP BY {WI}) GROUP BY ALL)""", "pts items")
def score_bands(spark, sf):
    return board.band_counts(board.pass_rates_wide(fx.li_shots(spark, sf), fx.LI_ITEMS))


@query(f"{KWI} index_value:d", f"""(SELECT {WI}, CASE dir WHEN 'UPPER' THEN quantile_cont(value, 0.9) WHEN 'LOWER' THEN quantile_cont(value, 0.1) ELSE median(value) END AS index_value
 FROM pts JOIN items USING (item) GROUP BY {WI}, dir)""", "pts items")
def index_values(spark, sf):
    return testlevel.index_values(stored_pts(spark, sf), fx.li_items(spark))


@query(f"{KWI} stat value:f", f"""(SELECT {WI}, unnest(CASE dir WHEN 'UPPER' THEN ['Max', 'P90', 'Med', 'P10'] WHEN 'LOWER' THEN ['P90', 'Med', 'P10', 'Min'] ELSE ['P90', 'Med', 'P10', 'Std'] END) AS stat,
 unnest(CASE dir WHEN 'UPPER' THEN [mx, p90, med, p10] WHEN 'LOWER' THEN [p90, med, p10, mn] ELSE [p90, med, p10, sd] END) AS value FROM (
 SELECT {WI}, dir, max(value) AS mx, min(value) AS mn, stddev_samp(value) AS sd, median(value) AS med, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.1) AS p10
 FROM pts JOIN items USING (item) GROUP BY {WI}, dir))""", "pts items")
def statistic_table(spark, sf):
    return testlevel.statistic_table(stored_pts(spark, sf), fx.li_items(spark))


METRICS_SQL = f"""(SELECT {RI}, median(value) AS target_median, stddev_samp(value) AS target_std,
 count(*) FILTER ((dir <> 'UPPER' AND value < lo) OR (dir <> 'LOWER' AND value > hi)) AS spec_out_count, pop_median, pop_std,
 CASE WHEN pop_std > 0 THEN round(abs(median(value) - pop_median) / pop_std, 2) ELSE 0 END AS deviation, cat2
 FROM pts JOIN items USING (item) JOIN (SELECT {PI}, median(value) AS pop_median, stddev_samp(value) AS pop_std FROM pts GROUP BY {PI}) USING ({PI})
 GROUP BY {RI}, pop_median, pop_std, cat2)"""


@query(f"{KRI} target_median:d target_std:f pop_median:d pop_std:f spec_out_count:i deviation:d", METRICS_SQL, "pts items")
def item_metrics(spark, sf):
    return testlevel.metrics_wide(li(spark, sf).stored().shots, fx.LI_ALL, fx.li_items(spark))


@query(f"{KW} root_lot_id tkout_time:t item value:f aggregated:b", f"""(SELECT {W}, root_lot_id, tkout_time, item, value, false AS aggregated FROM pts WHERE item NOT IN ('QTY', 'PRICE', 'NET')
 UNION ALL SELECT {W}, root_lot_id, tkout_time, item, CASE item WHEN 'QTY' THEN quantile_cont(value, 0.1) WHEN 'PRICE' THEN median(value) ELSE avg(value) END, true
 FROM pts WHERE item IN ('QTY', 'PRICE', 'NET') GROUP BY {W}, root_lot_id, tkout_time, item)""", "pts")
def per_test_aggregates(spark, sf):
    return testlevel.per_test(stored_pts(spark, sf), {"QTY": "P10", "PRICE": "MEDIAN", "NET": "MEAN"})


@query(f"{KWI} tkout_time:t n:i", f"""(SELECT {WI}, min(tkout_time) AS tkout_time, arg_min(n, tkout_time) AS n FROM (
 SELECT {WI}, tkout_time, count(*) AS n FROM pts GROUP BY {WI}, tkout_time) WHERE n >= 2 GROUP BY {WI})""", "pts")
def first_tests(spark, sf):
    return testlevel.first_tests(pts(spark, sf), 2)


@query(f"{KRI} stage:i position:i", f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {R} ORDER BY stage, o1, o2, item) AS position FROM (
 SELECT *, row_number() OVER (PARTITION BY {R}, cat2 ORDER BY stage, o1, o2, item) AS k FROM (
 SELECT {RI}, cat2, 1 AS stage, CAST(rank AS DOUBLE) AS o1, 0.0 AS o2 FROM ranked UNION ALL
 SELECT {RI}, cat2, 2, -spec_out_count, -deviation FROM {METRICS_SQL} WHERE spec_out_count > 0 OR deviation > 0.2)) WHERE k = 1) WHERE position <= 3)""", "ranked pts items")
def trend_items(spark, sf):
    r = li(spark, sf).stored()
    m = testlevel.metrics_wide(r.shots, r.names, r.item_dim).join(fx.li_items(spark).select(F.col("alias").alias("item"), "cat2"), "item")
    return board.trend_items(r.ranked(), m, 3, 0.2)


def _map_tests(spark, sf):
    return _out(spark, sf).groupBy(*WAFER, "item", "tkout_time").agg(F.count("*").alias("n_out"))


@query(f"{KRI} map_step map_lot map_wafer:i map_time:t own:b", f"""(WITH t AS (SELECT {WI}, tkout_time FROM outp GROUP BY {WI}, tkout_time),
 own_ AS (SELECT {RI}, count(*) AS n_own FROM t GROUP BY {RI}),
 recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle, item ORDER BY tkout_time DESC, step_id, lot_id, wafer_id) AS r FROM t) WHERE r <= 10),
 other AS (SELECT * FROM (SELECT o.*, r.step_id AS map_step, r.lot_id AS map_lot, r.wafer_id AS map_wafer, r.tkout_time AS map_time,
  row_number() OVER (PARTITION BY o.vehicle, o.step_id, o.lot_id, o.item ORDER BY r.tkout_time DESC, r.step_id, r.lot_id, r.wafer_id) AS k
  FROM own_ o JOIN recent r ON o.vehicle = r.vehicle AND o.item = r.item AND (o.lot_id <> r.lot_id OR o.step_id <> r.step_id)) WHERE k <= 10 - n_own)
 SELECT {RI}, step_id AS map_step, lot_id AS map_lot, wafer_id AS map_wafer, tkout_time AS map_time, true AS own FROM t
 UNION ALL SELECT {RI}, map_step, map_lot, map_wafer, map_time, false FROM other)""", "outp")
def map_selection(spark, sf):
    return board.map_selection(_map_tests(spark, sf), 10)
