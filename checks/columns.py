"""Scans, scalar columns, formulas, boards, counters, charts, inline, ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import query
from checks.common import PI, R, RI, W, WI, chain, robust, solved_sql
from checks.core import KR, KRI, KW, KWI, METRICS_SQL, pts, stored_pts
from waferlake import fixtures as fx
from waferlake.functions import formulas, ordered
from waferlake.functions import scalars as S
from waferlake.operators import board, charts, inline, ledger, reshape, testlevel
from waferlake.schema import PRODUCT, REPORT, SHOT_KEY, WAFER, Item, item_frame
from waferlake.session import local_frame
from waferlake.sources import dictionary, measurements

# ---------------------------------------------------------------- scans

SUB = """CASE WHEN k % 7 = 0 THEN 'AVG' WHEN k % 11 = 0 THEN 'Q1' WHEN k % 13 = 0 THEN 'STD' ELSE 'P1' END"""


def _ev_raw(spark, sf):
    ev = fx.ev_long(spark, sf)
    k = F.col("chip_y") * 10 + F.col("chip_x")
    return ev.withColumn("k", k).withColumn(
        "subitem_id", F.when(k % 7 == 0, "AVG").when(k % 11 == 0, "Q1").when(k % 13 == 0, "STD").otherwise("P1")
    ).withColumnRenamed("item", "item_id")


@query("event_id:i item_id value:d", f"""(SELECT event_id, item AS item_id, value, {SUB} AS sub FROM ev WHERE tkout_time >= TIMESTAMP '2024-01-05' AND tkout_time < TIMESTAMP '2024-01-20'
 AND item IN ('click', 'error', 'view') AND step_id LIKE 'S%') WHERE sub NOT LIKE 'Q%' AND sub NOT IN ('AVG', 'STD', 'MAX', 'MIN', 'RANGE')""", "ev")
def scan_measurements(spark, sf):
    return measurements.scan(_ev_raw(spark, sf), "2024-01-05", "2024-01-20", ["click", "error", "view"], "S%")


@query("window_from:t window_to:t n:i", """(SELECT w AS window_from, least(w + INTERVAL 90 DAY, d1) AS window_to,
 (SELECT count(*) FROM lineitem WHERE l_shipdate >= w AND l_shipdate < least(w + INTERVAL 90 DAY, d1)) AS n
 FROM (SELECT unnest(generate_series(d0, d1 - INTERVAL 1 DAY, INTERVAL 90 DAY)) AS w, d1 FROM (SELECT min(l_shipdate) AS d0, max(l_shipdate) + INTERVAL 1 DAY AS d1 FROM lineitem)))""")
def load_windows(spark, sf):
    """Half-open windows without a gap, and the rows each one loads."""
    li = fx.table(spark, sf, "lineitem")
    ends = li.agg(F.min("l_shipdate").cast("timestamp").alias("date_from"), (F.max("l_shipdate") + F.expr("INTERVAL 1 DAY")).cast("timestamp").alias("date_to"))
    windows = measurements.load_windows(ends, 90)
    slot = lambda c: F.floor(F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))).cast("long")
    days = li.groupBy(slot("l_shipdate").alias("d")).agg(F.count("*").alias("c"))
    # one row per loaded day, so the join is an equi-join on days
    span = windows.select("window_from", "window_to", F.explode(F.sequence(slot("window_from"), slot("window_to") - 1)).alias("d"))
    return span.join(days, "d", "left").groupBy("window_from", "window_to").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))


@query("event_id:i value:d tkout_time:t", """(SELECT event_id, CASE WHEN k % 17 = 0 THEN NULL ELSE value END AS value, CASE WHEN k % 19 = 0 THEN NULL ELSE date_trunc('second', tkout_time) END AS tkout_time FROM ev)""", "ev")
def typed_values(spark, sf):
    """Bad text becomes NULL, values become absolute."""
    ev = _ev_raw(spark, sf)
    v = F.when(F.col("k") % 17 == 0, "n/a").otherwise(F.when(F.col("k") % 5 == 0, -F.col("value")).otherwise(F.col("value")).cast("string"))
    t = F.when(F.col("k") % 19 == 0, "no time").otherwise(F.date_format("tkout_time", "yyyy-MM-dd HH:mm:ss"))
    return measurements.typed(ev.select("event_id", v.alias("value"), t.alias("tkout_time")))


SCALES = [Item("REAL", "Q_MM", "QTY", "0.5"), Item("REAL", "Q_TWICE", "QTY", "9"), Item("REAL", "PRICE_K", "PRICE", "0.001"), Item("REAL", "DISC", "DISC", "bad"), Item("REAL", "BLANK", "", "3")]


@query(f"{KW} item n:i total:f", f"""(SELECT {W}, CASE item_id WHEN 'QTY' THEN 'Q_MM' WHEN 'PRICE' THEN 'PRICE_K' ELSE item_id END AS item, count(*) AS n,
 sum(value * CASE item_id WHEN 'QTY' THEN 0.5 WHEN 'PRICE' THEN 0.001 ELSE 1 END) AS total
 FROM (UNPIVOT rows_ ON QTY, PRICE, DISC, TAX INTO NAME item_id VALUE value) GROUP BY ALL)""", "rows_")
def scale_and_alias(spark, sf):
    out = reshape.scale_and_rename(fx.li_long(spark, sf), item_frame(spark, SCALES))
    return out.groupBy(*WAFER, "item").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("vehicle item n:i total:f", """(SELECT vehicle, item_id AS item, count(*) AS n, sum(value * CASE WHEN vehicle = 'VF' AND item_id = 'QTY' THEN 2 WHEN vehicle = 'VO' AND item_id = 'QTY' THEN 3 ELSE 1 END) AS total
 FROM (UNPIVOT rows_ ON QTY, PRICE, DISC, TAX INTO NAME item_id VALUE value) GROUP BY ALL)""", "rows_")
def multi_vehicle_scan(spark, sf):
    """Every vehicle with its own dictionary."""
    long = fx.li_long(spark, sf).where(F.col("vehicle").isin("VF", "VO"))
    dims = local_frame(spark, [("VF", "QTY", 2.0), ("VO", "QTY", 3.0)], "vehicle string, item_id string, factor double")
    scaled = long.join(dims, ["vehicle", "item_id"], "left").withColumn("value", F.col("value") * F.coalesce("factor", F.lit(1.0)))
    return scaled.groupBy("vehicle", F.col("item_id").alias("item")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


DICT_SQL = """SELECT CASE WHEN p_size % 10 = 0 THEN 'OTHER' WHEN p_size % 2 = 1 THEN 'REAL' ELSE 'ADDP' END AS category,
 CASE WHEN p_size % 7 = 0 THEN ' ' ELSE p_brand || p_type || CAST(p_size AS VARCHAR) END AS item_id, CASE WHEN p_size % 4 = 0 THEN '' ELSE '{A}' END AS formula FROM part"""
chain("dict_", "", DICT_SQL)


@query("check_name passed:b offenders:i", """(SELECT *, offenders = 0 AS passed FROM (
 SELECT 'not empty' AS check_name, CAST(count(*) = 0 AS INT) AS offenders FROM dict_
 UNION ALL SELECT 'known category', count(*) FILTER (category NOT IN ('REAL', 'ADDP')) FROM dict_
 UNION ALL SELECT 'measured item has id', count(*) FILTER (category = 'REAL' AND trim(item_id) = '') FROM dict_
 UNION ALL SELECT 'derived item has formula', count(*) FILTER (category = 'ADDP' AND trim(formula) = '') FROM dict_
 UNION ALL SELECT 'item id unique', count(*) FROM (SELECT item_id FROM dict_ WHERE trim(item_id) <> '' GROUP BY item_id HAVING count(*) > 1)))""", "dict_")
def dictionary_checks(spark, sf):
    """Checks on a dictionary with one row per part."""
    p, size = fx.table(spark, sf, "part"), F.col("p_size")
    items = p.select(
        F.when(size % 10 == 0, "OTHER").when(size % 2 == 1, "REAL").otherwise("ADDP").alias("category"),
        F.when(size % 7 == 0, " ").otherwise(F.concat("p_brand", "p_type", size.cast("string"))).alias("item_id"),
        F.when(size % 4 == 0, "").otherwise("{A}").alias("formula"),
    )
    return dictionary.row_checks(items)


@query("vehicle chip_x:i chip_y:i", "layout WHERE chip_x <> 3", "layout")
def coordinate_sheet(spark, sf):
    """Names repaired, positions to integers, rows without a position dropped."""
    raw = fx.li_layout(spark, sf).select(
        F.col("mask").alias(" VEHICLE "), F.when(F.col("chip_x") == 3, "-").otherwise(F.concat("chip_x", F.lit(".0"))).alias("Chip X"), F.col("chip_y").cast("string").alias("CHIP_Y"))
    return measurements.coordinate_sheet(raw)


# ---------------------------------------------------------------- scalar columns

@query("match_key lot_wf search_key prime_key key_vehicle key_lot key_step lot_mark n:i", f"""(SELECT root_lot_id || '_' || step_id AS match_key, root_lot_id || '_' || wafer_id AS lot_wf, lot_id || '_' || step_id AS search_key,
 'X_' || vehicle || '_' || lot_id || '_' || step_id AS prime_key, 'X_' || vehicle AS key_vehicle, lot_id AS key_lot, step_id AS key_step, substr(lot_id, 1, 3) AS lot_mark, count(*) AS n FROM shots GROUP BY ALL)""", "shots")
def shot_keys(spark, sf):
    k = F.concat_ws("_", F.lit("X"), "vehicle", "lot_id", "step_id")
    v, lot, step = S.split_key("prime_key")
    mark = S.lot_prefix(F.regexp_replace("lot_id", "^(...)", "$1."), ".")
    return fx.li_shots(spark, sf).select(
        S.key("root_lot_id", "step_id").alias("match_key"), S.key("root_lot_id", "wafer_id").alias("lot_wf"),
        S.key("lot_id", "step_id").alias("search_key"), k.alias("prime_key"), mark.alias("lot_mark"),
    ).withColumns({"key_vehicle": v, "key_lot": lot, "key_step": step}).groupBy(
        "match_key", "lot_wf", "search_key", "prime_key", "key_vehicle", "key_lot", "key_step", "lot_mark").agg(F.count("*").alias("n"))


@query("p_partkey:i shown hidden:b", r"""(SELECT p_partkey, replace(replace(regexp_replace(regexp_replace(regexp_replace(p_name, '^small ', ''), '^red ', ''), ' bolt$', ''), 'blue', 'B'), ' ', '_') AS shown,
 regexp_matches(p_name, '(?i)^(.*gear|b.ue .*)$') AS hidden FROM part)""")
def display_names(spark, sf):
    """Prefixes, suffixes, replacements; wildcard exclusion."""
    p = fx.table(spark, sf, "part")
    return p.select("p_partkey", S.display_name("p_name", ["small ", "red "], [" bolt"], {"blue": "B", " ": "_"}).alias("shown"),
                    S.wildcard("p_name", ["*GEAR", "b?ue *"]).alias("hidden"))


@query("p_partkey:i t:i flag:b dir lo:d hi:d cells listed:b zone", """(SELECT p_partkey, CAST(round_even((p_size + 0.5) / 5, 0) * 5 AS INT) AS t, p_type IN ('SMALL', 'MEDIUM') AS flag,
 CASE WHEN p_type = 'SMALL' THEN 'UPPER' WHEN p_type = 'LARGE' THEN 'LOWER' ELSE 'BOTH' END AS dir,
 CASE WHEN p_type = 'SMALL' THEN NULL ELSE p_size END AS lo, CASE WHEN p_type = 'LARGE' THEN NULL ELSE p_size * 2 END AS hi,
 CASE WHEN p_size < 30 THEN p_size || ', 30' WHEN p_size = 30 THEN '30, 30' ELSE '30, ' || p_size END AS cells, p_size % 3 = 0 AS listed,
 CASE WHEN p_size * 3 <= 60 THEN 'Center' WHEN p_size * 3 <= 100 THEN 'Middle' ELSE 'Edge' END AS zone FROM part)""")
def scalar_columns(spark, sf):
    """Temperature to five, flags, directions, bounds, list cells, comma lists, zones."""
    p = fx.table(spark, sf, "part")
    typ = F.col("p_type")
    raw = F.when(typ == "SMALL", " upper").when(typ == "LARGE", "Lower").when(typ == "MEDIUM", "both").otherwise("?")
    lo, hi = S.effective_bounds(F.col("p_size"), F.col("p_size") * 2, "dir")
    return p.withColumn("dir", S.direction(raw)).select(
        "p_partkey", S.nearest_five(F.col("p_size") + 0.5).alias("t"), "dir", lo.alias("lo"), hi.alias("hi"),
        S.truthy(F.when(typ == "SMALL", "Y").when(typ == "MEDIUM", " 1.0").otherwise("no")).alias("flag"),
        S.list_cell(F.concat(F.lit("['30', '"), F.col("p_size"), F.lit("']"))).alias("cells"),
        S.in_comma_list(F.when(F.col("p_size") % 3 == 0, "v1, vf ,x").otherwise("v1,vfx"), F.lit("VF")).alias("listed"),
        S.zone(F.col("p_size") * 3).alias("zone"),
    )


LAYERS = [("SA", "METAL1", 0), ("SA", "VIA", 1), ("SN", "METAL2", 2)]


@query(f"{KR} layer label n:i", f"""(SELECT {R}, CASE step_id WHEN 'SA' THEN 'METAL1' WHEN 'SN' THEN 'METAL2' ELSE step_id END AS layer,
 root_lot_id || ' #' || wafer_id || ' (' || CASE step_id WHEN 'SA' THEN 'ME' WHEN 'SN' THEN 'ME' ELSE step_id END || ')' AS label, count(*) AS n FROM shots GROUP BY ALL)""", "shots")
def step_layers(spark, sf):
    layers = local_frame(spark, LAYERS, "step_id string, layer string, decl_order int")
    out = board.with_layer(fx.li_shots(spark, sf), layers)
    return out.withColumn("label", S.map_label("root_lot_id", "wafer_id", "layer")).groupBy(*REPORT, "layer", "label").agg(F.count("*").alias("n"))


@query("lot_id wafer_id:i tkout_time:t points:i dup_no:i label cleaned n:i", """(SELECT lot_id, wafer_id, tkout_time, points, dup_no, step_id || '(' || points || 'pt)_' || dup_no AS label,
 regexp_replace(step_id || '(' || points || 'pt)_' || dup_no, '_1(\\.0+)?$', '') AS cleaned, count(*) AS n FROM (
 SELECT *, dense_rank() OVER (PARTITION BY lot_id, wafer_id, step_id, points ORDER BY tkout_time) AS dup_no FROM (
  SELECT *, count(*) OVER (PARTITION BY lot_id, wafer_id, tkout_time) AS points FROM shots)) GROUP BY ALL)""", "shots")
def program_labels(spark, sf):
    """Points per test, repeat number of a test, and its label."""
    shots = board.test_points(fx.li_shots(spark, sf))
    keys = ["lot_id", "wafer_id", "step_id", "points"]
    dup = board.repeat_numbers(shots, keys)
    label = S.program_label("step_id", "points", "dup_no")
    out = shots.join(dup, [*keys, "tkout_time"]).withColumn("label", label).withColumn("cleaned", S.clean_label("label"))
    return out.groupBy("lot_id", "wafer_id", "tkout_time", "points", "dup_no", "label", "cleaned").agg(F.count("*").alias("n"))


@query(f"{KRI} programs", f"""(WITH c AS (SELECT *, count(*) OVER (PARTITION BY lot_id, wafer_id, tkout_time) AS points FROM shots),
 l AS (SELECT DISTINCT {W}, tkout_time, regexp_replace(step_id || '(' || points || 'pt)_' || d, '_1(\\.0+)?$', '') AS label FROM (
  SELECT *, dense_rank() OVER (PARTITION BY lot_id, wafer_id, step_id, points ORDER BY tkout_time) AS d FROM c))
 SELECT {RI}, string_agg(DISTINCT label, ';' ORDER BY label) AS programs FROM outp JOIN l USING ({W}, tkout_time) GROUP BY {RI})""", "shots outp")
def spec_out_programs(spark, sf):
    """Distinct cleaned program labels of the out points."""
    from checks.core import _out

    labels = board.test_labels(fx.li_shots(spark, sf))
    return board.out_programs(_out(spark, sf), labels).withColumn("programs", F.array_join("labels", ";"))


@query(f"{KR} device_values:i", f"(SELECT {R}, count(*) AS device_values FROM pts WHERE item NOT LIKE '%PCHK%' GROUP BY {R})", "pts")
def report_gate(spark, sf):
    return board.report_gate(pts(spark, sf), fx.li_items(spark))


@query("p_partkey:i item owner spec", """(SELECT p_partkey, item, CASE WHEN item = 'red_ring' OR item LIKE 'red\\_ring\\_%' ESCAPE '\\' THEN 'red_ring' WHEN item LIKE 'red\\_%' ESCAPE '\\' THEN 'red' WHEN item LIKE 'hot\\_%' ESCAPE '\\' THEN 'hot' END AS owner,
 CASE WHEN item = 'hot_bolt' THEN 'P95' WHEN item LIKE '%gear' THEN 'MEAN' WHEN item LIKE 'red\\_%' ESCAPE '\\' THEN 'MEDIAN' WHEN item LIKE '%window%' THEN 'P10' END AS spec
 FROM (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'x_Window' ELSE replace(p_name, ' ', '_') END AS item FROM part)
 ) s0""".replace("LIKE '%window%'", "ILIKE '%window%'"))
def derived_owners(spark, sf):
    """Owner alias of a derived column and its test-level aggregate."""
    p = fx.table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") % 10 == 0, "x_Window").otherwise(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("item"))
    out = board.alias_owner(p, ["red", "red_ring", "hot"])
    return out.withColumn("spec", testlevel.aggregate_spec_column("item", {"hot_bolt": "P95", "*gear": "MEAN", "red": "MEDIAN"}))


@query(f"{KW} chip_x:i chip_y:i tkout_time:t", "shots WHERE NOT (QTY < 25 AND PRICE < 50000)", "shots")
def drop_empty_shots(spark, sf):
    """Shots whose items are all missing after a filter on values."""
    s = fx.li_shots(spark, sf)
    s = s.withColumn("QTY", F.when(F.col("QTY") >= 25, F.col("QTY"))).withColumn("PRICE", F.when(F.col("PRICE") >= 50000, F.col("PRICE")))
    return reshape.drop_empty(s, ["QTY", "PRICE"])


# ---------------------------------------------------------------- formulas

FORMULAS = [
    Item("ADDP", "F_LOG", formula="LOG('A', {PRICE})"),
    Item("ADDP", "F_POW", formula="POWER({QTY}, 2) + sqrt({PRICE}) - ABS({DISC} - {TAX})"),
    Item("ADDP", "F_RANGE", scale_factor="2", formula="rmax({DISC}, {TAX}) - rmin({DISC}, {TAX})"),
    Item("ADDP", "F_DIV", formula="{PRICE} / {DISC}"),
    Item("ADDP", "F_ROOT", formula="sqrt({DISC} - {TAX})"),
    Item("ADDP", "F_NEXT", formula="{F_RANGE} * 10 + {F_DIV}"),
    Item("ADDP", "F_LOST", formula="{NOWHERE} + 1"),
]


@query(f"{KW} chip_x:i chip_y:i tkout_time:t F_LOG:d F_POW:d F_RANGE:d F_DIV:d F_ROOT:d F_NEXT:d", """(SELECT *, F_RANGE * 10 + F_DIV AS F_NEXT FROM (SELECT *, log10(abs(nullif(PRICE, 0))) AS F_LOG,
 pow(QTY, 2) + sqrt(PRICE) - abs(DISC - TAX) AS F_POW, 2 * (greatest(DISC, TAX) - least(DISC, TAX)) AS F_RANGE,
 CASE WHEN DISC <> 0 THEN PRICE / DISC END AS F_DIV, CASE WHEN DISC - TAX >= 0 THEN sqrt(DISC - TAX) END AS F_ROOT FROM wide))""", "wide")
def formula_functions(spark, sf):
    return formulas.add_formulas(fx.li_shots(spark, sf), FORMULAS).frame


@query(f"{KW} chip_x:i chip_y:i tkout_time:t G_STD:f G_AVG:f G_REL:f", """(SELECT *, G_AVG / QTY AS G_REL FROM (SELECT *, stddev_samp(PRICE) OVER w AS G_STD, avg(PRICE - NET) OVER w AS G_AVG FROM shots
 WINDOW w AS (PARTITION BY root_lot_id, wafer_id, tkout_time)))""", "shots")
def formula_group_statistics(spark, sf):
    items = [Item("ADDP", "G_STD", formula="STD({PRICE})"), Item("ADDP", "G_AVG", formula="AVG({PRICE} - {NET})"), Item("ADDP", "G_REL", formula="{G_AVG} / {QTY}")]
    return formulas.add_formulas(fx.li_shots(spark, sf), items).frame


# least squares of a parabola over x = -1, 0, 1, 2: a2 = (y1 - y2 - y3 + y4)/4 and so on
@query(f"{KW} chip_x:i chip_y:i tkout_time:t MW:d MW_minus_margin:d MW_plus_margin:d MW_ovl_index:d MW_new:d", """(SELECT *, plus - minus AS MW, minus AS MW_minus_margin, plus AS MW_plus_margin, -0.5 * (plus + minus) AS MW_ovl_index, least(abs(plus), abs(minus)) AS MW_new FROM (
 SELECT *, CASE WHEN a2 <= 0 THEN 6 WHEN dd < 0 THEN 0 ELSE least((-a1 + sqrt(dd)) / (2 * a2), 6) END AS plus,
  CASE WHEN a2 <= 0 THEN -6 WHEN dd < 0 THEN 0 ELSE greatest((-a1 - sqrt(dd)) / (2 * a2), -6) END AS minus FROM (
 SELECT *, a1 * a1 - 4 * a2 * (a0 - log10(500.0)) AS dd FROM (SELECT *, (y1 - y2 - y3 + y4) / 4 AS a2,
  (-11 * y1 + 3 * y2 + 7 * y3 + y4) / 20 AS a1, (3 * y1 + 11 * y2 + 9 * y3 - 3 * y4) / 20 AS a0 FROM (
 SELECT *, log10(PRICE + 1e-14) AS y1, log10(QTY + 1e-14) AS y2, log10(NET + 1e-14) AS y3, log10(UNIT + 1e-14) AS y4 FROM shots)))) )""", "shots")
def margin_window(spark, sf):
    item = Item("ADDP", "MW", formula="MA_Window([-1, 0, 1, 2], {PRICE}, {QTY}, {NET}, {UNIT}, 500, 6)")
    return formulas.add_formulas(fx.li_shots(spark, sf), [item]).frame


@query("alias leaf", """(WITH RECURSIVE e AS (SELECT 'P' || p_partkey AS alias, 'P' || (p_partkey // 3) AS ref FROM part WHERE p_partkey > 40 UNION SELECT 'P' || p_partkey, 'P' || (p_partkey % 41) FROM part WHERE p_partkey > 40),
 reach AS (SELECT alias, ref FROM e UNION SELECT r.alias, e.ref FROM reach r JOIN e ON e.alias = r.ref)
 SELECT DISTINCT alias, ref AS leaf FROM reach WHERE ref NOT IN (SELECT alias FROM e))""")
def formula_lineage(spark, sf):
    """Measured items below every formula of a dictionary with a row per part."""
    k = F.col("p_partkey")
    items = fx.table(spark, sf, "part").where(k > 40).select(
        F.concat(F.lit("P"), k.cast("string")).alias("alias"),
        F.concat(F.lit("{P"), F.floor(k / 3).cast("string"), F.lit("} + {P"), (k % 41).cast("string"), F.lit("}")).alias("formula"))
    return formulas.lineage(formulas.formula_edges(items))


# ---------------------------------------------------------------- joins and sets

@query("item report_order:d category", "(SELECT *, CASE WHEN item IN ('QTY', 'PRICE', 'DISC', 'TAX') THEN 'REAL' ELSE 'ADDP' END AS category FROM items) WHERE item IN (SELECT item FROM pts)", "items pts")
def measured_items(spark, sf):
    return reshape.measured_items(fx.li_items(spark), pts(spark, sf)).withColumnRenamed("alias", "item")


@query(f"{KR} item n:i missing:b", f"""(SELECT {R}, item, coalesce(n, 0) AS n, n IS NULL AS missing FROM (SELECT DISTINCT {R} FROM shots) CROSS JOIN items
 LEFT JOIN (SELECT {RI}, count(*) AS n FROM outp GROUP BY {RI}) USING ({RI}))""", "shots items outp")
def dictionary_board(spark, sf):
    """Every dictionary item of every report, measured out or not."""
    from checks.core import _out

    n = _out(spark, sf).groupBy(*REPORT, "item").agg(F.count("*").alias("n"))
    rows = fx.li_shots(spark, sf).select(*REPORT).distinct().withColumn("item", F.explode(F.array(*[F.lit(i) for i in fx.LI_ALL])))
    return rows.join(n, [*REPORT, "item"], "left").withColumn("missing", F.col("n").isNull()).withColumn("n", F.coalesce("n", F.lit(0)))


@query(f"{KR} root_lot_id n:i", f"(SELECT {R}, root_lot_id, count(*) AS n FROM shots WHERE root_lot_id = 'R1' AND step_id = 'SN' GROUP BY ALL)", "shots")
def target_scope(spark, sf):
    """Exact root and step; no fall-back to other steps."""
    return fx.li_shots(spark, sf).where("root_lot_id = 'R1' AND step_id = 'SN'").groupBy(*REPORT, "root_lot_id").agg(F.count("*").alias("n"))


@query("vehicle n:i n_price:i n_value:i", """(SELECT vehicle, count(*) AS n, count(PRICE) AS n_price, 0 AS n_value FROM wide GROUP BY vehicle
 UNION ALL SELECT 'EV', count(*), 0, count(value) FROM ev)""", "wide ev")
def union_of_vehicles(spark, sf):
    """Vehicles with unequal columns."""
    both = reshape.union_vehicles(fx.li_shots(spark, sf), fx.ev_long(spark, sf))
    return both.groupBy("vehicle").agg(F.count("*").alias("n"), F.count("PRICE").alias("n_price"), F.count("value").alias("n_value"))


@query(f"{KR} shared covers:b", f"""(SELECT {R}, array_to_string(list_sort(list_intersect(xs, ['PRICE', 'QTY', 'UNIT'])), ',') AS shared, len(list_intersect(['PCHK_TAX', 'UNIT'], xs)) = 2 AS covers
 FROM (SELECT {R}, list(DISTINCT item) AS xs FROM outp GROUP BY {R}))""", "outp")
def item_set_tests(spark, sf):
    from checks.core import _out

    sets = _out(spark, sf).groupBy(*REPORT).agg(F.collect_set("item").alias("xs"))
    want = F.array(F.lit("PCHK_TAX"), F.lit("UNIT"))
    return sets.select(*REPORT, F.array_join(F.array_sort(F.array_intersect("xs", F.array(F.lit("PRICE"), F.lit("QTY"), F.lit("UNIT")))), ",").alias("shared"),
                       (F.size(F.array_intersect("xs", want)) == 2).alias("covers"))


@query("p_partkey:i item", """(SELECT p_partkey, arg_min(item, pr) AS item FROM (SELECT p_partkey, item, pr FROM part JOIN (VALUES ('red ring', 'RR', 0), ('gear', 'GEAR', 1), ('hot', 'HOT', 2), ('ring', 'RING', 3)) f(form, item, pr)
 ON lower(p_name) = form OR lower(split_part(p_name, ' ', 2)) = form OR lower(split_part(p_name, ' ', 1)) = form) GROUP BY p_partkey)""")
def name_resolution(spark, sf):
    """Item by written or display name, ignoring case, first priority wins."""
    forms = local_frame(spark, [("red ring", "RR", 0), ("gear", "GEAR", 1), ("hot", "HOT", 2), ("ring", "RING", 3)], "form string, item string, pr int")
    p = fx.table(spark, sf, "part")
    words = p.select("p_partkey", F.explode(F.array_distinct(F.array(F.lower("p_name"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lower(F.split_part("p_name", F.lit(" "), F.lit(1)))))).alias("form"))
    return words.join(forms, "form").groupBy("p_partkey").agg(F.min_by("item", "pr").alias("item"))


@query("position:i lot_id wafer_id:i", "(SELECT *, row_number() OVER (ORDER BY lot_id <> 'L00007', lot_id, wafer_id) AS position FROM (SELECT DISTINCT lot_id, wafer_id FROM shots))", "shots")
def board_order(spark, sf):
    return board.board_order(fx.li_shots(spark, sf), "L00007")


# ---------------------------------------------------------------- charts

@query("vehicle item day p1:d med:d p99:d", """(SELECT vehicle, item, strftime(tkout_time, '%Y-%m-%d') AS day, quantile_cont(value, 0.01) AS p1, median(value) AS med, quantile_cont(value, 0.99) AS p99 FROM ev GROUP BY ALL)""", "ev")
def daily_band(spark, sf):
    return charts.daily_band(fx.ev_long(spark, sf)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("vehicle item day p1_roll:d med_roll:d p99_roll:d", """(SELECT vehicle, item, strftime(d, '%Y-%m-%d') AS day, avg(p1) OVER w AS p1_roll, avg(med) OVER w AS med_roll, avg(p99) OVER w AS p99_roll FROM (
 SELECT vehicle, item, CAST(tkout_time AS DATE) AS d, quantile_cont(value, 0.01) AS p1, median(value) AS med, quantile_cont(value, 0.99) AS p99 FROM ev GROUP BY ALL)
 WINDOW w AS (PARTITION BY vehicle, item ORDER BY d RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW))""", "ev")
def rolling_band(spark, sf):
    daily = charts.daily_band(fx.ev_long(spark, sf))
    return charts.rolling_band(daily).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"{KWI} q1:d med:d q3:d whisker_low:d whisker_high:d outliers:i", f"""(SELECT {WI}, q1, med, q3, min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
 max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high, count(*) FILTER (value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
 FROM ev JOIN (SELECT {WI}, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3 FROM ev GROUP BY {WI}) USING ({WI}) GROUP BY {WI}, q1, med, q3)""", "ev")
def box_numbers(spark, sf):
    return charts.box_numbers(fx.ev_long(spark, sf))


@query(f"{KWI} event_id:i value:d p:d", f"(SELECT *, CASE WHEN n = 1 THEN 1 ELSE (pos - 1) / (n - 1) END AS p FROM (SELECT *, row_number() OVER (PARTITION BY {WI} ORDER BY value, event_id) AS pos, count(*) OVER (PARTITION BY {WI}) AS n FROM ev))", "ev")
def empirical_cdf(spark, sf):
    return charts.empirical_cdf(fx.ev_long(spark, sf), ["event_id"])


@query("vehicle step_id item low:d mid:d high:d", f"""(SELECT {PI}, coalesce(e_lo, 2 * mid - e_hi, p1) AS low, mid, coalesce(e_hi, 2 * mid - e_lo, p99) AS high FROM (
 SELECT {PI}, CASE WHEN dir <> 'UPPER' THEN lo END AS e_lo, CASE WHEN dir <> 'LOWER' THEN hi END AS e_hi, quantile_cont(value, 0.01) AS p1, median(value) AS mid, quantile_cont(value, 0.99) AS p99
 FROM pts JOIN items USING (item) GROUP BY {PI}, dir, lo, hi))""", "pts items")
def colour_anchors(spark, sf):
    return charts.colour_anchors(pts(spark, sf), fx.li_items(spark))


@query(f"{KRI} y_low:d y_high:d", f"""(SELECT {RI}, lo2 - pad AS y_low, hi2 + pad AS y_high FROM (SELECT *, CASE WHEN hi2 > lo2 THEN (hi2 - lo2) * 0.08 ELSE abs(hi2) * 0.08 END AS pad FROM (
 SELECT {RI}, least(min(value), CASE WHEN dir <> 'UPPER' THEN lo END) AS lo2, greatest(max(value), CASE WHEN dir <> 'LOWER' THEN hi END) AS hi2 FROM pts JOIN items USING (item) GROUP BY {RI}, dir, lo, hi)))""", "pts items")
def trend_range(spark, sf):
    return charts.trend_range(pts(spark, sf), fx.li_items(spark))


@query("class item n:i total:f", """(SELECT CASE WHEN vehicle <> 'VF' THEN 'with vehicle' WHEN lot_id = 'L00005' THEN 'target' WHEN root_lot_id = 'R1' THEN 'sibling' ELSE 'other' END AS class, item, count(*) AS n, sum(value) AS total FROM pts GROUP BY ALL)""", "pts")
def trend_classes(spark, sf):
    out = charts.trend_classes(pts(spark, sf), "VF", "L00005", "R1")
    return out.groupBy("class", "item").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


chain("radial_z", "pts layout", f"""SELECT *, (r - avg(r) OVER w) / stddev_pop(r) OVER w AS z, count(*) OVER w AS n
 FROM (SELECT p.*, radius AS r FROM pts p JOIN layout USING (vehicle, chip_x, chip_y)) WINDOW w AS (PARTITION BY {WI})
 QUALIFY n >= 4 AND stddev_pop(r) OVER w > 0 AND len(list_distinct(list(r) OVER w)) >= 4""")
chain("radial_m", "radial_z", f"SELECT {WI}, n, " + ", ".join([f"sum(z ** {i + j}) AS m{i}{j}" for i in range(4) for j in range(i, 4)] + [f"sum(z ** {i} * value) AS v{i}" for i in range(4)]) + f" FROM radial_z GROUP BY {WI}, n")
solved_sql("radial_m", f"{WI}, n", 4, ["c0", "c1", "c2", "c3"], "radial_s")


@query(f"{KWI} n:i c0:f c1:f c2:f c3:f", "radial_s", "radial_s")
def radial_fits(spark, sf):
    """Cubic of value over radius per wafer and item, all items."""
    shots = fx.li_shots_met(spark, sf, WAFER)
    if shots is not None:
        return charts.radial_fits_met(shots, fx.LI_ALL, fx.li_layout(spark, sf))
    return charts.radial_fits(stored_pts(spark, sf), fx.li_layout(spark, sf))


TERMS = ["u * u", "v * v", "u", "v", "1.0"]
chain("circle_uv", "layout", "SELECT vehicle, radius AS r, avg(chip_x) OVER w AS mx, avg(chip_y) OVER w AS my, chip_x - mx AS u, chip_y - my AS v FROM layout WINDOW w AS (PARTITION BY vehicle)")
chain("circle_m", "circle_uv", "SELECT vehicle, mx, my, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1, max(sqrt(u * u + v * v)) AS far, count(*) AS n, "
      + ", ".join([f"sum({TERMS[i]} * {TERMS[j]}) AS m{i}{j}" for i in range(5) for j in range(i, 5)] + [f"sum({TERMS[i]} * r * r) AS w{i}" for i in range(5)]) + " FROM circle_uv GROUP BY vehicle, mx, my")
solved_sql("(SELECT * RENAME (v0 AS vlow, v1 AS vhigh, w0 AS v0, w1 AS v1, w2 AS v2, w3 AS v3, w4 AS v4) FROM circle_m)", "vehicle, mx, my, u0, u1, vlow, vhigh, far, n", 5, ["a", "b", "p", "q", "c"], "circle_s", "circle_m")


@query("mask cx:d cy:d pitch_x:d pitch_y:d semi_x:d semi_y:d aspect:d fitted:b", """(SELECT vehicle AS mask, mx + CASE WHEN ok THEN x ELSE 0 END AS cx, my + CASE WHEN ok THEN y ELSE 0 END AS cy, CASE WHEN ok THEN sqrt(a) END AS pitch_x, CASE WHEN ok THEN sqrt(b) END AS pitch_y,
 CASE WHEN ok THEN 150 / sqrt(a) ELSE 1.05 * far END AS semi_x, CASE WHEN ok THEN 150 / sqrt(b) ELSE 1.05 * far END AS semi_y, CASE WHEN ok THEN sqrt(b / a) ELSE 1 END AS aspect, ok AS fitted FROM (
 SELECT *, coalesce(n >= 6 AND a > 0 AND b > 0 AND b / a BETWEEN 0.01 AND 100 AND greatest(abs(u0 - x), abs(u1 - x)) <= 300 / sqrt(a) AND greatest(abs(vlow - y), abs(vhigh - y)) <= 300 / sqrt(b), false) AS ok FROM (
 SELECT *, -p / (2 * a) AS x, -q / (2 * b) AS y FROM circle_s)))""", "circle_s")
def wafer_circle(spark, sf):
    """Centre, pitch and axes of every vehicle's wafer from the radii of its sites."""
    return charts.wafer_circle(fx.li_layout(spark, sf))


@query("mask axis pitch:d", """(SELECT mask, axis, median(gap) AS pitch FROM (SELECT mask, axis, a - lag(a) OVER (PARTITION BY mask, axis ORDER BY a) AS gap FROM (
 SELECT DISTINCT vehicle AS mask, 'chip_x' AS axis, chip_x AS a FROM layout UNION SELECT DISTINCT vehicle, 'chip_y', chip_y FROM layout)) WHERE gap > 0 GROUP BY ALL)""", "layout")
def site_pitch(spark, sf):
    return charts.site_pitch(fx.li_layout(spark, sf))


@query("mask x_min:d x_max:d x_pad:d y_min:d y_max:d y_pad:d", """(SELECT vehicle AS mask, min(chip_x) AS x_min, max(chip_x) AS x_max, (max(chip_x) - min(chip_x)) / (count(DISTINCT chip_x) - 1) * 0.5 AS x_pad,
 min(chip_y) AS y_min, max(chip_y) AS y_max, (max(chip_y) - min(chip_y)) / (count(DISTINCT chip_y) - 1) * 0.5 AS y_pad FROM layout GROUP BY vehicle)""", "layout")
def layout_extent(spark, sf):
    return charts.layout_extent(fx.li_layout(spark, sf))


@query(f"{KWI} event_id:i value:d q:d first:b", f"(SELECT *, row_number() OVER (PARTITION BY {WI} ORDER BY event_id) = 1 AS first FROM ev JOIN (SELECT {WI}, quantile_cont(value, 0.1) AS q FROM ev GROUP BY {WI}) USING ({WI}))", "ev")
def quantile_broadcast(spark, sf):
    """A group quantile on every row, and the first row of the group."""
    ev = fx.ev_long(spark, sf)
    keys = [*WAFER, "item"]
    q = ordered.quantiles(ev, keys, "value", {"q": 0.1})
    head = ev.groupBy(*keys).agg(F.min("event_id").alias("_first"))
    return ev.join(q, keys).join(head, keys).withColumn("first", F.col("event_id") == F.col("_first"))


# ---------------------------------------------------------------- inline

MODULES = [("ST0", "ETCH", 0), ("ST1", "CMP", 1), ("ST1", "PHOTO", 2)]
chain("inl", "ev", """SELECT root_lot_id, wafer_id, 'ST' || (k % 3) AS step_desc, CASE item WHEN 'click' THEN 'CD1' ELSE 'THK_' || item END AS item_id, event_id,
 CASE WHEN item = 'click' THEN value * 1000 ELSE value END AS fab_value, CASE WHEN item = 'click' THEN 80000.0 ELSE 80.0 END AS ucl, CASE WHEN item = 'click' THEN 30000.0 ELSE 30.0 END AS target, 0.0 AS lcl
 FROM ev WHERE item NOT LIKE 'pur%' AND item NOT LIKE 'v%'""")


def _inline(spark, sf):
    ev = _ev_raw(spark, sf).where(~F.col("item_id").like("pur%") & ~F.col("item_id").like("v%"))
    raw = ev.select(
        "root_lot_id", "wafer_id", F.concat(F.lit("ST"), (F.col("k") % 3).cast("string")).alias("step_desc"), "event_id",
        F.when(F.col("item_id") == "click", "CD1").otherwise(F.concat(F.lit("THK_"), "item_id")).alias("item_id"),
        F.col("value").cast("string").alias("fab_value"), F.lit("80").alias("ucl"), F.lit("30").alias("target"), F.lit("-5").alias("lcl"))
    return inline.out_of_limit(inline.normalised(raw))


@query("event_id:i step_desc item_id fab_value:d ucl:d target:d lcl:d out:b module", """(SELECT *, fab_value > ucl OR fab_value < lcl AS out, CASE step_desc WHEN 'ST0' THEN 'ETCH' WHEN 'ST1' THEN 'PHOTO' END AS module FROM inl)""", "inl")
def inline_values(spark, sf):
    """Unit change, no negative limits, limit flag, module of the step."""
    settings = local_frame(spark, MODULES, "step_desc string, module string, decl_order int")
    return inline.with_settings(_inline(spark, sf), inline.last_module(settings))


@query("step_desc item_id ucl:d target:d lcl:d n_out:i", "(SELECT step_desc, item_id, avg(ucl) AS ucl, avg(target) AS target, avg(lcl) AS lcl, count(*) FILTER (fab_value > ucl OR fab_value < lcl) AS n_out FROM inl GROUP BY ALL)", "inl")
def inline_limits(spark, sf):
    return inline.item_limits(_inline(spark, sf))


@query("root_lot_id step_desc item_id " + " ".join(f"wafer_{w}:d" for w in range(1, 7)), "(SELECT root_lot_id, step_desc, item_id, " + ", ".join(f"avg(fab_value) FILTER (wafer_id = {w}) AS wafer_{w}" for w in range(1, 7)) + " FROM inl GROUP BY ALL)", "inl")
def inline_board(spark, sf):
    return inline.wafer_board(_inline(spark, sf), range(1, 7))


# ---------------------------------------------------------------- ledger

chain("wip_", "", """SELECT 'L' || lpad(CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR), CAST(greatest(5, length(CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR))) AS INT), '0') AS lot_id, 'S' || CAST(o_orderkey % 1000 AS VARCHAR) AS loc, o_orderdate AS d, o_orderkey FROM orders""")
chain("log_", "shots", "SELECT vehicle || '_' || lot_id || '_' || step_id AS prime_key, lot_id, list_sort(list(DISTINCT wafer_id)) AS wafers, max(tkout_time) AS t, count(DISTINCT tkout_time) AS sites FROM shots GROUP BY ALL")


def _tests(spark, sf):
    return fx.li_shots(spark, sf).withColumn("site_count", F.quarter("tkout_time"))


@query("lot_id current_step last_update_date:t lot_mark", "(SELECT lot_id, arg_max(loc, row(d, o_orderkey)) AS current_step, max(d) AS last_update_date, substr(lot_id, 1, 4) AS lot_mark FROM wip_ GROUP BY lot_id)", "wip_")
def latest_wip(spark, sf):
    return ledger.latest_wip(fx.wip(spark, sf)).withColumn("lot_mark", F.substring("lot_id", 1, 4))


@query("prime_key wafer_text site_text tkout_time:t", """(SELECT prime_key, array_to_string(list_sort(list(DISTINCT wafer_id)), ',') AS wafer_text, array_to_string(list_sort(list(DISTINCT quarter(tkout_time))), ',') AS site_text, max(tkout_time) AS tkout_time
 FROM (SELECT *, vehicle || '_' || lot_id || '_' || step_id AS prime_key FROM shots) GROUP BY prime_key)""", "shots")
def lot_log(spark, sf):
    """Log of early and late tests built apart and merged."""
    t = _tests(spark, sf)
    cut = F.lit("1998-06-01").cast("timestamp")
    merged = ledger.merge_logs(ledger.lot_log(t.where(F.col("tkout_time") < cut)), ledger.lot_log(t.where(F.col("tkout_time") >= cut)))
    return merged.withColumn("wafer_text", F.array_join("wafers", ",")).withColumn("site_text", F.array_join("site_counts", ","))


DONE_SQL = """(SELECT prime_key, lot_id, loc, t, moved AND t < TIMESTAMP '2001-10-01 01:00:00' - INTERVAL 90 MINUTE AS done, lot_id LIKE '%3' AS before FROM (
 SELECT l.*, w.loc, w.loc IS NULL OR substr(w.loc, 1, 2) <> 'S3' OR CAST(substr(w.loc, 2) AS INT) - 300 >= 100 AS moved FROM (SELECT replace(replace(replace(prime_key, '_SA', '_S300'), '_SN', '_S300'), '_SR', '_S300') AS prime_key, lot_id, max(t) AS t FROM log_ GROUP BY ALL) l
 LEFT JOIN (SELECT lot_id, arg_max(loc, row(d, o_orderkey)) AS loc FROM wip_ GROUP BY lot_id) w USING (lot_id)))"""


def _completion(spark, sf):
    log = ledger.lot_log(_tests(spark, sf).withColumn("step_id", F.lit("S300")))
    before = log.select("prime_key", F.element_at(F.split("prime_key", "_"), -2).endswith("3").alias("done"))
    return ledger.completion(log, fx.wip(spark, sf), before, "2001-10-01 01:00:00", 90)


@query("prime_key done:b newly_done:b", f"(SELECT prime_key, done OR before AS done, done AND NOT before AS newly_done FROM {DONE_SQL})", "log_ wip_")
def lot_completion(spark, sf):
    """Moved on or gone, silent for the delay; once done stays done."""
    return _completion(spark, sf)


@query("prime_key tkout_time:t", f"(SELECT prime_key, t AS tkout_time FROM {DONE_SQL} WHERE done AND NOT before AND lot_id NOT LIKE 'L00004%')", "log_ wip_")
def reportable_lots(spark, sf):
    layers = local_frame(spark, [("S300", "MFDC"), ("S301", "OTHER")], "step_id string, layer string")
    return ledger.reportable(_completion(spark, sf), "L00004", layers, "MFDC")


@query("prime_key t:t source", """(SELECT prime_key, CASE WHEN t >= TIMESTAMP '2001-07-01' THEN t + INTERVAL 1 HOUR ELSE t END AS t, CASE WHEN t >= TIMESTAMP '2001-07-01' THEN 'new' ELSE 'old' END AS source FROM log_)""", "log_")
def keep_last_log(spark, sf):
    log = ledger.lot_log(_tests(spark, sf)).select("prime_key", F.col("tkout_time").alias("t"))
    new = log.where(F.col("t") >= F.lit("2001-07-01").cast("timestamp")).select("prime_key", (F.col("t") + F.expr("INTERVAL 1 HOUR")).alias("t"), F.lit("new").alias("source"))
    return ledger.keep_last(log.withColumn("source", F.lit("old")), new)


@query("prime_key t:t", "(SELECT prime_key, t FROM log_ ORDER BY t DESC, prime_key LIMIT 20)", "log_")
def latest_logs(spark, sf):
    log = ledger.lot_log(_tests(spark, sf)).select("prime_key", F.col("tkout_time").alias("t"))
    return log.orderBy(F.desc("t"), "prime_key").limit(20)
