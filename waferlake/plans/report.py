"""The report plan: from wide shots to item context, rule trace and ranked findings."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waferlake.functions import ordered, robust, runs
from waferlake.operators import detect, order, overlap, rank, reshape, rules, spatial, testlevel
from waferlake.schema import PRODUCT, REPORT, SITE, WAFER, Item, Limits, item_frame
from waferlake.session import staged


@dataclass(frozen=True)
class Report:
    """All reports of the shots at once; lots are group keys, not a loop."""

    shots: DataFrame
    items: Sequence[Item]
    limits: Limits = Limits()
    #: whether the shots are a stored table already
    is_stored: bool = False
    #: adds columns that follow from their row alone, by name; these are not stored but made again from what is
    row_columns: Callable[[DataFrame], DataFrame] | None = None
    made: Sequence[str] = ()
    #: the values of one shot by item, from those measured on it, for rules on single shots; the plan itself uses ``row_columns``
    row_values: Callable[[Mapping[str, Column]], Mapping[str, Column]] = lambda measured: measured
    #: one row for each report, its shots an array; and the shots of reports too large for one
    packs: DataFrame | None = None
    rest: DataFrame | None = None
    #: the shots dealt so that those of a group of these keys (of a report or more) meet in one task, or None where a report is too
    #: large for an array
    met: Callable[[Sequence[str]], DataFrame | None] = lambda keys: None

    def stored(self) -> Report:
        """The same over shots that are computed once and stored, for plans that read them more than once."""
        if self.is_stored:
            return self
        if self.row_columns is None:
            return replace(self, shots=staged(self.shots, "shots"), is_stored=True)
        shots = self.row_columns(staged(self.shots.drop(*self.made), "shots"))
        return replace(self, shots=shots.select(*self.shots.columns), is_stored=True)

    def packed(self) -> Report:
        """The same with the shots of each report stored as one array too, so that what is counted of a report or of its wafers
        needs no shuffle of its own."""
        r = self.stored()
        if r.packs is not None or r.lim.aggregated:
            return r
        rows, large = ordered.packs(r.shots, REPORT, ["wafer_id", *order.ORDER, *r.measured])
        rest = None if large is None else ordered.joined(r.shots, large, REPORT, "left_semi")
        return replace(r, packs=staged(rows, "packs"), rest=rest)

    @property
    def measured(self) -> list[str]:
        return [n for n in self.names if n not in self.made]

    @property
    def in_order(self) -> DataFrame:
        """The shots that stand in packs, those of a report together and in measurement order within their wafers."""
        rows = self.packs.select(*REPORT, F.inline("_p"))
        return rows if self.row_columns is None else self.row_columns(rows)

    @property
    def names(self) -> list[str]:
        return [i.alias for i in self.items]

    @property
    def item_dim(self) -> DataFrame:
        return item_frame(self.shots.sparkSession, self.items)

    @property
    def points(self) -> DataFrame:
        table = self.lim.aggregated
        if not table:
            return reshape.points(self.shots, self.names, [*WAFER, *SITE])
        every = reshape.points(self.shots, self.names, [*WAFER, *SITE, "root_lot_id"])
        return testlevel.per_test(every, table).drop("aggregated", "root_lot_id")

    @property
    def lim(self) -> Limits:
        """The limits with every item that counts by one value per test, and its statistic, by its own name."""
        found = {n: testlevel.aggregate_spec(n, self.limits.aggregated) for n in self.names}
        return replace(self.limits, aggregated={n: spec for n, spec in found.items() if spec})

    def wafers(self) -> DataFrame:
        if self.lim.aggregated:
            return detect.wafer_stats(staged(self.points, "points"))
        if self.packs is not None:
            own = runs.profile(self.in_order, WAFER, self.names, values=True)
            return own if self.rest is None else own.unionByName(detect.wafer_stats_wide(self.rest, self.names))
        return detect.wafer_stats_wide(self.stored().shots, self.names)

    def baseline(self) -> DataFrame:
        """What each product item's wafers are scored against. The few figures of a wafer it needs are stored, so that no round over
        them makes the wafers again."""
        shots = None if self.is_stored or self.lim.aggregated else self.met(WAFER)
        if shots is not None:
            wafers = robust.profile_met(shots, WAFER, self.names)
        elif self.packs is not None and self.rest is None:
            wafers = runs.profile(self.in_order, WAFER, self.names)
        else:
            wafers = self.wafers()
        return detect.product_baseline(staged(wafers.select(*detect.PRODUCT_ITEM, "median", "spread"), "wafers"))

    def scored(self) -> DataFrame:
        r = self.stored()
        if r.packs is not None:
            # the wafers are made again from the packs where they are scored, so their values are not written
            return detect.score_wafers(r.wafers(), r.baseline(), r.item_dim, r.points, r.lim, whole=r.rest is None)
        w = staged(r.wafers(), "wafers")
        return detect.score_wafers(w, detect.product_baseline(w), r.item_dim, r.points, r.lim)

    def items_scored(self, scored: DataFrame | None = None) -> DataFrame:
        return detect.item_stats(self.scored() if scored is None else scored, self.lim)

    def out_points(self) -> DataFrame:
        if self.lim.aggregated:
            return spatial.out_points(self.points, self.item_dim)
        return spatial.out_points_wide(self.shots, self.items)

    def findings(self) -> DataFrame:
        return detect.findings(self.items_scored(), self.limits)

    def ranked(self) -> DataFrame:
        return rank.ranked(self.findings(), self.limits)

    def population(self) -> DataFrame:
        if self.lim.aggregated:
            per = robust.profile(self.points, [*PRODUCT, "item"], "value")
        else:
            per = robust.profile_wide(self.shots, PRODUCT, self.names)
        return per.select(*PRODUCT, "item", F.col("median").alias("pop_median"), F.col("spread").alias("pop_spread"))

    def target_percentile(self) -> DataFrame:
        r = self.stored()
        if r.lim.aggregated:
            return detect.target_percentile(r.points)
        if r.packs is not None:
            return detect.target_percentile_packed(r.shots, r.in_order, r.rest, r.names)
        return detect.target_percentile_wide(r.shots, r.names)

    def sequence(self, scored: DataFrame | None = None) -> DataFrame:
        """Longest runs and out shares in measurement order, over wafers.

        Where the direction drops a bound, only wafers out of the other are put in
        order. Any other wafer of five points has run, share and front zero and a
        back share of zero, which the minimum over wafers must still see.
        """
        if not self.limits.direction_aware:
            r = self.stored()
            if self.lim.aggregated:
                return order.item_sequence(order.wafer_sequences(r.points, r.item_dim, r.limits))
            if r.packs is None:
                return order.item_sequence(order.wafer_sequences_wide(r.shots, r.items, r.limits))
            checked = [i for i in r.items if i.spec_low is not None or i.spec_high is not None]
            own = runs.sequences(r.in_order, WAFER, checked, r.limits.min_wafer_points)
            return order.item_sequence(own if r.rest is None else own.unionByName(order.wafer_sequences_wide(r.rest, r.items, r.limits)))
        scored = self.scored() if scored is None else scored
        checked = (F.col("spec_low").isNotNull() | F.col("spec_high").isNotNull()) & (
            F.col("n") >= self.limits.min_wafer_points
        )
        wafers = scored.where(checked).select(*detect.WAFER_ITEM, "n_out")
        hit = wafers.where("n_out > 0").drop("n_out")
        seq = order.measurement_order(self.points.join(hit, detect.WAFER_ITEM, "left_semi"), self.item_dim)
        rows = order.wafer_sequence(seq, self.limits)
        zero = [F.lit(0).alias("run"), F.lit(0.0).alias("dead"), F.lit(0.0).alias("front"), F.lit(0.0).alias("back")]
        calm = wafers.where("n_out = 0").select(*detect.WAFER_ITEM, *zero)
        return order.item_sequence(rows.select(*detect.WAFER_ITEM, "run", "dead", "front", "back").unionByName(calm))

    def patterns(self, layout: DataFrame, out: DataFrame | None = None) -> DataFrame:
        """Spatial verdict, zones and repeats of every (report, item) with out points."""
        out = self.out_points() if out is None else out
        radius = layout.withColumnRenamed("mask", "vehicle").select(
            "vehicle", "chip_x", "chip_y", F.col("chip_radius").alias("radius")
        )
        sites = spatial.out_sites(out)
        shapes = spatial.gated(
            spatial.verdict(spatial.shape_metrics(sites, radius)), spatial.out_wafers(out), self.limits
        )
        zones = spatial.zone_counts(out, radius, self.limits).groupBy(*detect.REPORT_ITEM).agg(
            *[
                (F.coalesce(F.sum(F.when(F.col("zone") == z, F.col("n"))), F.lit(0)) / F.sum("n")).alias(f"zone_{z.lower()}")
                for z in ("Center", "Middle", "Edge")
            ]
        )
        repeats = spatial.repeat_comment(sites, shapes, self.limits).select(*detect.REPORT_ITEM, "repeat_kind")
        return shapes.select(*detect.REPORT_ITEM, "pattern").join(zones, detect.REPORT_ITEM, "left").join(
            repeats, detect.REPORT_ITEM, "left"
        )

    def context(self, layout: DataFrame) -> DataFrame:
        """One row per (report, item) with everything a rule may ask for.

        The shots and the few out points are each read by several branches, so
        each is computed once and stored; so are the scored wafers, where the
        direction drops a bound and they are read twice.
        """
        r = self.packed()
        scored, out = r.scored(), staged(r.out_points(), "out")
        if r.limits.direction_aware or r.packs is None:
            scored = staged(scored, "scored")
        key = detect.REPORT_ITEM
        over = overlap.overlap_counts(overlap.shot_overlap(r.shots, r.items))
        return (
            r.items_scored(scored)
            .join(r.population(), detect.PRODUCT_ITEM, "left")
            .join(r.target_percentile(), key, "left")
            .join(r.sequence(scored), key, "left")
            .join(r.patterns(layout, out), key, "left")
            .join(over, key, "left")
            .fillna({"seq_run": 0, "seq_dead": 0.0, "seq_front": 0.0, "seq_back": 1.0, "overlap_shots": 0})
        )

    def with_rules(self, ctx: DataFrame, rule_list: Sequence, find=lambda n: n) -> tuple[DataFrame, DataFrame]:
        """(ranked findings, trace): built-in findings after suppression plus rule findings."""
        ctx = staged(ctx, "context")
        trace = staged(rules.rule_trace(ctx, rule_list, find), "trace")
        built = rules.keep_if_ruled(
            rules.suppress_dispersion(detect.findings(ctx, self.limits), trace), trace, self.limits.exclude_unless_rule
        )
        every = built.unionByName(rules.rule_findings(trace).drop("result"), allowMissingColumns=True)
        return rank.ranked(every, self.limits), trace


def severity_counts(findings: DataFrame) -> DataFrame:
    """Critical and warning findings per report."""
    return findings.groupBy(*REPORT).agg(
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity") == "WARNING").alias("warning"),
    )


def basis_rows(ctx: DataFrame) -> DataFrame:
    """Audit row per (report, item): rounded numbers, no nested fields."""
    return ctx.select(
        *detect.REPORT_ITEM, "severity", "is_check", "spec_low", "spec_high", F.col("n_out").alias("spec_out_total"),
        F.round("max_ratio", 4).alias("spec_out_max_wafer_ratio"), F.col("out_wafers").alias("spec_out_wafer_count"),
        "center", "scatter", "typical", "shift_wafer", F.round("shift", 3).alias("worst_median_dev_sigma"),
        "disp_wafer", F.round("disp_ratio", 3).alias("worst_dispersion_ratio"), F.col("gate_ok").alias("dispersion_gate_pass"),
        "flier_wafer", F.col("flier_count").alias("flier_points"), F.round("flier_dev", 2).alias("flier_max_dev_sigma"),
    )
