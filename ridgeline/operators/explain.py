"""Accounts of a run from its result tables: what bound it, what its sites are good and weak at,
how the demands of experiments overlap, and what to try next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline import stages

#: The observable that shows how strong a component is.
EVIDENCE = {
    "solid_angle": "solid_angle_sr", "depth": "max_depth_gcm2", "distance": "mean_distance_m", "shower": "path_grammage_gcm2", "footprint": "altitude_m",
    "clearance": "best_clearance_ratio", "muon_shielding": "max_depth_gcm2", "nu_survival": "earth_chord_gcm2",
}
STRONG = 0.75
FRAGMENTED = 0.01


def stage_knob(stage: Column) -> Column:
    """The settings of a stage as text, null for a stage that none governs."""
    return F.coalesce(*[F.when(stage.startswith(name), F.lit(" / ".join(fields))) for name, fields in stages.SETTINGS.items()])


def binding_constraint(funnels: DataFrame) -> DataFrame:
    """`funnels(run, pos, stage, n)` to the stage of each run that kept the least of what reached it.
    A stage that keeps nothing is fatal, wins, and ends the account: later ones are not looked at."""
    w = Window.partitionBy("run").orderBy("pos")
    steps = funnels.withColumn("before", F.lag("n").over(w))
    skipped = reduce(lambda a, b: a | b, [F.col("stage").startswith(name) for name in stages.NOT_A_CUT])  # records may add a figure to the name
    steps = steps.where(~skipped & (F.col("before") > 0)).withColumn("kept", F.col("n") / F.col("before")).withColumn("fatal", F.col("n") == 0)
    earlier = F.coalesce(F.max(F.col("fatal").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = steps.withColumn("after_fatal", earlier).where("after_fatal = 0")
    order = F.struct((~F.col("fatal")).alias("f"), F.col("kept").alias("k"), F.col("pos").alias("p"))
    best = steps.groupBy("run").agg(F.min_by(F.struct("stage", "before", "n", "kept", "fatal"), order).alias("x")).select("run", "x.*")
    return best.withColumn("knob", stage_knob(F.col("stage")))


def split_selected(sites: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds is_selected: the sites' own flag where a run has any, else its first total_sites, else all."""
    flagged = F.max(F.col("selected").isNotNull().cast("int")).over(Window.partitionBy("run")) == 1
    k = F.row_number().over(Window.partitionBy("run").orderBy("pos"))
    rows = sites.join(totals, "run", "left").withColumn("flagged", flagged).withColumn("k", k)
    chosen = F.when(F.col("flagged"), F.coalesce("selected", F.lit(False))).otherwise(F.col("total_sites").isNull() | (F.col("k") <= F.col("total_sites")))
    return rows.withColumn("is_selected", chosen).drop("flagged", "k", "total_sites")


def closing_inflation(funnels: DataFrame, strides: DataFrame) -> DataFrame:
    """Pixels after gap closing over what the stage before stands for."""
    w = Window.partitionBy("run").orderBy("pos")
    steps = funnels.withColumn("before", F.lag("n").over(w)).where(F.col("stage").startswith(stages.CLOSED) & F.col("before").isNotNull())
    return steps.join(strides, "run").select("run", F.expr("try_divide(n, before * greatest(1, coalesce(stride, 1)))").alias("inflation"))


def component_scores(sites: DataFrame, statistic: str = "p50") -> DataFrame:
    """`sites(run, site_id, arrival_scan map)` to (run, site_id, component, score, evidence)."""
    suffix = f"_{statistic}"
    rows = sites.select("run", "site_id", "arrival_scan", F.explode("arrival_scan").alias("key", "score"))
    rows = rows.where(F.col("key").startswith("score_") & F.col("key").endswith(suffix) & (F.length("key") > len("score_") + len(suffix)))
    rows = rows.withColumn("component", F.expr(f"substring(key, 7, length(key) - {6 + len(suffix)})"))
    shown = F.coalesce(*[F.when(F.col("component") == c, F.lit(e + suffix)) for c, e in EVIDENCE.items()])
    return rows.select("run", "site_id", "component", "score", F.try_element_at("arrival_scan", shown).alias("evidence"))


def strengths(sites: DataFrame, threshold: float = STRONG) -> DataFrame:
    return component_scores(sites).where(F.col("score") >= threshold)


def weakest(sites: DataFrame) -> DataFrame:
    s = component_scores(sites).groupBy("run", "site_id").agg(F.min_by(F.struct("component", "score"), F.struct("score", "component")).alias("x"))
    return s.select("run", "site_id", "x.component", "x.score")


def common_weakness(sites: DataFrame) -> DataFrame:
    """For each run the component most sites are weakest at, and the share of sites."""
    n = weakest(sites).groupBy("run", "component").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("run").agg(F.min_by("component", F.struct(-F.col("n"), "component")).alias("component"), (F.max("n") / F.sum("n")).alias("share"))


def shared_strengths(sites: DataFrame, threshold: float = STRONG) -> DataFrame:
    """Components that are strong at every site of a run."""
    n = sites.groupBy("run").agg(F.count(F.lit(1)).alias("n_sites"))
    return strengths(sites, threshold).groupBy("run", "component").agg(F.count(F.lit(1)).alias("n")).join(n, "run").where("n = n_sites").select("run", "component")


def band_overlap(bands: DataFrame) -> DataFrame:
    """`bands(campaign, run, band, lo, hi)` to pairs of runs of one campaign with width and share of the
    narrower band. A campaign holds the handful of experiments that are compared. A band named aspect goes round the circle: from a larger to a smaller end it is two intervals."""
    wraps = (F.col("band") == "aspect") & (F.col("lo") > F.col("hi"))
    part = lambda lo, hi: F.struct(lo.alias("x0"), hi.alias("x1"))
    parts = F.when(wraps, F.array(part(F.col("lo"), F.lit(360.0)), part(F.lit(0.0), F.col("hi")))).otherwise(F.array(part(F.col("lo"), F.col("hi"))))
    width = F.when(wraps, 360.0 - F.col("lo") + F.col("hi")).otherwise(F.col("hi") - F.col("lo"))
    known = bands.where("lo is not null and hi is not null").withColumn("own", width).select("campaign", "run", "band", "own", F.inline(parts))
    a = known.select("campaign", "band", *[F.col(c).alias(f"{c}_a") for c in ("run", "own", "x0", "x1")])
    b = known.select("campaign", "band", *[F.col(c).alias(f"{c}_b") for c in ("run", "own", "x0", "x1")])
    common = F.greatest(F.least("x1_a", "x1_b") - F.greatest("x0_a", "x0_b"), F.lit(0.0))
    s = a.join(b, ["campaign", "band"]).where("run_a < run_b").groupBy("run_a", "run_b", "band").agg(F.sum(common).alias("width"), F.first(F.least("own_a", "own_b")).alias("narrower"))
    return s.select("run_a", "run_b", "band", "width", F.coalesce(F.expr("try_divide(width, narrower)"), F.lit(0.0)).alias("share_of_narrower"))


def headline(sites: DataFrame, targets: DataFrame) -> DataFrame:
    """`sites(run, site_id, area_km2, capacity_exact, is_selected)`: what each run found against its target."""
    on = F.col("is_selected")
    s = sites.groupBy("run").agg(
        F.count_if(on).alias("sites"), F.coalesce(F.sum(F.when(on, F.col("area_km2"))), F.lit(0.0)).alias("area_km2"),
        F.coalesce(F.sum(F.when(on, F.col("capacity_exact"))), F.lit(0)).alias("capacity"),
        F.min_by(F.when(on, F.col("site_id")), F.when(on, F.struct(-F.col("capacity_exact"), F.col("site_id")))).alias("largest_site"),
        F.coalesce(F.sum(F.when(~on, F.col("area_km2"))), F.lit(0.0)).alias("reserve_km2"))
    return targets.join(s, "run", "left").fillna(0, ["sites", "area_km2", "capacity", "reserve_km2"]).withColumn("shortfall", F.greatest(F.col("target") - F.col("capacity"), F.lit(0)))


def pass_rates(stats: DataFrame) -> DataFrame:
    """`stats(run, labelled, passed)`: share of labelled regions that pass, and whether ground is fragmented."""
    rate = F.expr("try_divide(passed, labelled)")
    return stats.select("run", rate.alias("pass_rate"), F.coalesce(rate < FRAGMENTED, F.lit(False)).alias("fragmented"))


def next_steps(runs: DataFrame, binding: DataFrame) -> DataFrame:
    """`runs(run, min_score, score_percentile, gap_close_km, stride, sites)` to (run, pos, step), from what each run did."""
    rules = [
        (F.col("knob").isNotNull(), F.concat(F.lit("sweep "), F.regexp_extract("knob", "^[^ /,]+", 0))),
        (F.col("min_score").isNotNull() & (F.col("min_score") != 0) & F.col("score_percentile").isNull(), F.lit("rank by percentile instead of an absolute score")),
        (F.col("gap_close_km").isNull() | (F.col("gap_close_km") != 0), F.lit("run without gap closing")),
        (F.coalesce("stride", F.lit(1)) > 1, F.lit("run with stride 1")),
        (F.coalesce("sites", F.lit(0)) == 0, F.lit("loosen the binding constraint first")),
    ]
    found = F.filter(F.array(*[F.when(t, F.struct(F.lit(k).alias("pos"), s.alias("step"))) for k, (t, s) in enumerate(rules)]), lambda x: x.isNotNull())
    return runs.join(binding.select("run", "knob"), "run", "left").select("run", F.inline(found))


def combination(shares: DataFrame, overlaps: DataFrame) -> DataFrame:
    """For each run of a combination its shared ground, and the band in which it agrees least with another."""
    both = overlaps.select(F.col("run_a").alias("run"), F.col("run_b").alias("other"), "band", "share_of_narrower").unionByName(
        overlaps.select(F.col("run_b").alias("run"), F.col("run_a").alias("other"), "band", "share_of_narrower"))
    tight = both.groupBy("run").agg(F.min_by(F.struct("band", "other", "share_of_narrower"), F.struct("share_of_narrower", "band", "other")).alias("x"))
    return shares.join(tight, "run", "left").select("run", "pixels", "joint_share", F.col("x.band").alias("tightest_band"), F.col("x.other").alias("with_run"), F.col("x.share_of_narrower").alias("band_share"))


def assumptions(runs: DataFrame) -> DataFrame:
    """`runs` as of next_steps to (run, pos, assumption): what the figures of a run rest on, from its own settings."""
    rules = [
        (F.col("min_score").isNull() & F.col("score_percentile").isNull(), F.lit("no score cut: any accepted direction makes a candidate count")),
        (F.col("score_percentile").isNotNull(), F.lit("a percentile cut keeps its share of candidates however good they are")),
        (F.col("gap_close_km").isNull(), F.lit("gaps are closed over the detector spacing, which was not measured")),
        (F.coalesce("stride", F.lit(1)) > 1, F.format_string("one pixel in %d stands for its neighbours", "stride")),
        (F.lit(True), F.lit("capacity is a lattice over the ground: slope and access between its points are not looked at")),
    ]
    found = F.filter(F.array(*[F.when(t, F.struct(F.lit(k).alias("pos"), s.alias("assumption"))) for k, (t, s) in enumerate(rules)]), lambda x: x.isNotNull())
    return runs.select("run", F.inline(found))


#: Sections of a report in the order of its lines.
SECTIONS = ["run", "headline", "funnel", "binding", "regions", "sites", "strengths", "aperture", "reading", "assumptions", "next"]


def report(head: DataFrame, funnels: DataFrame, binding: DataFrame, steps: DataFrame, runs: DataFrame | None = None, stats: DataFrame | None = None,
           sites: DataFrame | None = None, peaks: DataFrame | None = None) -> DataFrame:
    """(run, section_no, section, pos, line): a plain-text account by run. `runs` as of next_steps, `stats` as of
    pass_rates, `sites` with is_selected and arrival_scan, `peaks(run, energy_pev)`; what is not given has no section."""
    line = lambda df, section, pos, text: df.select("run", F.lit(SECTIONS.index(section)).alias("section_no"), F.lit(section).alias("section"), pos.cast("long").alias("pos"), text.alias("line"))
    none, percent = F.lit("none"), lambda x: F.format_string("%.1f%%", 100 * x)
    short = F.when(F.col("shortfall") > 0, F.format_string(", %d short of the target", "shortfall")).otherwise(", target met")
    parts = [
        line(head, "headline", F.lit(0), F.concat(F.format_string("%d sites of %.2f km2 hold %d detectors", "sites", "area_km2", "capacity"), short)),
        line(funnels, "funnel", F.col("pos"), F.format_string("%s: %d", "stage", "n")),
        line(binding, "binding", F.lit(0), F.format_string("%s kept %.3f%% (%s)", F.col("stage"), 100 * F.col("kept"), F.coalesce("knob", F.lit("no setting")))),
        line(steps, "next", F.col("pos"), F.col("step")),
    ]
    if runs is not None:
        text = lambda c: F.coalesce(F.col(c).cast("string"), none)
        parts.append(line(runs, "run", F.lit(0), F.concat(F.lit("stride "), text("stride"), F.lit(", gap closing km "), text("gap_close_km"), F.lit(", score at least "), text("min_score"),
                                                          F.lit(", best percent "), text("score_percentile"))))
        parts.append(line(assumptions(runs), "assumptions", F.col("pos"), F.col("assumption")))
        grown = closing_inflation(funnels, runs.select("run", "stride")).where("inflation is not null")
        parts.append(line(grown, "reading", F.lit(0), F.format_string("gap closing made %.2f times the ground that was found: areas and capacities count it", "inflation")))
    if stats is not None:
        rates = stats.join(pass_rates(stats), "run")
        broken = F.when(F.col("fragmented"), ": the ground is in fragments").otherwise("")
        parts.append(line(rates, "regions", F.lit(0), F.concat(F.format_string("%d of %d regions are large enough (", "passed", "labelled"), F.coalesce(percent(F.col("pass_rate")), none), F.lit(")"), broken)))
    if sites is not None:
        chosen = sites.where("is_selected")
        parts.append(line(chosen, "sites", F.col("site_id"), F.format_string("site %d: %.2f km2, %d detectors", "site_id", "area_km2", "capacity_exact")))
        best = strengths(chosen).groupBy("run", "site_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "component"))).alias("x"))  # components are few
        parts.append(line(best, "strengths", F.col("site_id"), F.concat(F.format_string("site %d is strong at ", "site_id"), F.array_join(F.transform("x", lambda x: x["component"]), ", "))))
        parts.append(line(common_weakness(chosen), "strengths", F.lit(-1), F.concat(percent(F.col("share")), F.lit(" of sites are weakest at "), F.col("component"))))
    if peaks is not None:
        parts.append(line(peaks, "aperture", F.lit(0), F.format_string("the aperture is largest near %.3g PeV", "energy_pev")))
    return reduce(DataFrame.unionByName, parts)


def compare_regions(runs: DataFrame, baseline: str) -> DataFrame:
    """`runs(region, dem_pixels, ...counts)`: every count per pixel relative to the baseline region's."""
    counts = [c for c in runs.columns if c not in ("region", "dem_pixels")]
    base = runs.where(F.col("region") == baseline).select(*[(F.col(c) / F.col("dem_pixels")).alias(f"base_{c}") for c in counts])
    rows = runs.join(F.broadcast(base.limit(1)))  # one row
    return rows.select("region", *[F.expr(f"try_divide(try_divide({c}, dem_pixels), base_{c})").alias(f"{c}_ratio") for c in counts])


#: The four sides of a box.
SIDES = ("south", "north", "west", "east")
#: Shares of the boxes that meet their partners, each in a task of its own.
PAIR_SHARES = 64


def box_overlaps(boxes: DataFrame) -> DataFrame:
    """Pairs of overlapping boxes (name, south, north, west, east) with the ground they share in km2. Equal boxes are compared
    once: different extents meet in the cells of a one-degree grid that they touch, a pair counting in its overlap's first cell, and
    names are joined to the pairs of extents found. A list of boxes is small in bytes, so it is dealt out by number of shares."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo).cast("int"), F.floor(hi).cast("int")))
    extents = boxes.select(*SIDES).distinct()
    placed = extents.withColumn("gy", cells(F.col("south"), F.col("north"))).withColumn("gx", cells(F.col("west"), F.col("east")))
    a, b = placed.alias("a"), placed.alias("b")
    south, north = F.greatest("a.south", "b.south"), F.least("a.north", "b.north")
    west, east = F.greatest("a.west", "b.west"), F.least("a.east", "b.east")
    km2 = (north - south) * 110.6 * (east - west) * 111.32 * F.cos(F.radians((north + south) / 2))
    first = (F.col("a.gy") == F.floor(south)) & (F.col("a.gx") == F.floor(west))
    found = a.join(b, (F.col("a.gy") == F.col("b.gy")) & (F.col("a.gx") == F.col("b.gx")) & first & (F.col("a.south") < F.col("b.north")) & (F.col("b.south") < F.col("a.north")) &
                   (F.col("a.west") < F.col("b.east")) & (F.col("b.west") < F.col("a.east"))).select(
        *[F.col(f"{x}.{s}").alias(f"{s}_{x}") for x in "ab" for s in SIDES], km2.alias("overlap_km2"))
    named = lambda x: boxes.select(F.col("name").alias(f"name_{x}"), *[F.col(s).alias(f"{s}_{x}") for s in SIDES])
    partners = found.join(named("a"), [f"{s}_a" for s in SIDES]).select("name_a", *[f"{s}_b" for s in SIDES], "overlap_km2").repartition(PAIR_SHARES, "name_a")
    return partners.join(named("b"), [f"{s}_b" for s in SIDES]).where("name_a < name_b").select("name_a", "name_b", "overlap_km2")


def run_summary(funnels: DataFrame) -> DataFrame:
    """accepted: after the score cut, else the directions accepted; acceptance: of what the stride kept."""
    at = lambda name: F.max(F.when(F.col("stage").startswith(name), F.col("n")))
    s = funnels.groupBy("run").agg(at(stages.DEM).alias("dem_pixels"), at(stages.STRIDE).alias("kept"), F.coalesce(at(stages.SCORE), at(stages.DIRECTIONS)).alias("accepted"),
                                   at(stages.PRUNED).alias("pruned"))
    return s.withColumn("acceptance", F.expr("try_divide(accepted, kept)"))


def sampling_control(runs: DataFrame) -> DataFrame:
    """`runs(region, stride, downsample, value)`: each setting's value over that of the costliest
    (the smallest of each knob) on the same ground."""
    finest = runs.groupBy("region").agg(F.min("stride").alias("s0"), F.min("downsample").alias("d0"))
    base = runs.join(finest, "region").where("stride = s0 and downsample = d0").select("region", F.col("value").alias("fine"))
    return runs.join(base, "region").select("region", "stride", "downsample", F.expr("try_divide(value, fine)").alias("ratio"))


def sweep(candidates: DataFrame, settings: DataFrame, tests: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One job for all settings (setting_id, param, value): a candidate counts for a setting if it
    passes the baseline tests with the swept parameter's test taken at the setting's value.
    `tests` are columns over the candidate and `value`; the settings table is a parameter list."""
    rows = candidates.join(F.broadcast(settings))
    passes = F.lit(True)
    for name, (base, swept) in tests.items():
        passes = passes & F.when(F.col("param") == name, swept).otherwise(base)
    counts = rows.groupBy("setting_id", "param", "value").agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.coalesce(passes, F.lit(False))).alias("accepted"))
    return counts.withColumn("acceptance", F.expr("try_divide(accepted, kept)"))


def relative(swept: DataFrame, count: str = "accepted", name: str = "ratio") -> DataFrame:
    """Adds the ratio of a count to the baseline setting's (param 'baseline')."""
    base = swept.where("param = 'baseline'").select(F.col(count).alias("base")).limit(1)
    return swept.join(F.broadcast(base)).withColumn(name, F.expr(f"try_divide({count}, base)")).drop("base")
