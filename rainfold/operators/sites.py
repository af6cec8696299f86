"""Where to collect: allowed cells, targets, scores, selection of sites that differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainfold.operators import blocks
from rainfold.operators.hydrology import with_receiver
from rainfold.operators.percentiles import exact_percentile
from rainfold.operators.raster import BOUNDS, with_bounds
from rainfold.plans.store import apart, cut


def allowed_cells(cells: DataFrame, setback_m: float = 0.0, max_slope: float = 8.0, border: int = 3) -> DataFrame:
    """cells (valid, land, water, edge_distance_m, slope_deg) that may hold a site, away from the grid's rim."""
    rim = (F.col("row") >= border) & (F.col("row") <= F.col("last_r__") - border) & (F.col("col") >= border) & (F.col("col") <= F.col("last_c__") - border)
    fine = F.col("valid") & F.col("land") & ~F.col("water") & (F.col("edge_distance_m") >= setback_m) & ~F.isnan("slope_deg") & (F.col("slope_deg") <= max_slope)
    return with_bounds(cells).where(fine & rim).drop(*BOUNDS)


def network_threshold(cells: DataFrame, share: float = 0.99) -> DataFrame:
    """(survey, network_threshold): the exact percentile of accumulation over valid cells, 3 at least."""
    made = exact_percentile(cells.where("valid"), "survey", "acc", share, "network_threshold")
    return made.withColumn("network_threshold", F.greatest(F.lit(3.0), "network_threshold"))


def outlet_nodes(cells: DataFrame, least_drop: float = 1e-6, share: float = 0.99) -> DataFrame:
    """Cells of the drainage network where lines meet or where its usable part ends; cells need z, fdir, acc, allowed, wet."""
    linked = with_receiver(cells) if "receiver" not in cells.columns else cells
    made = linked.join(network_threshold(linked, share), "survey").withColumn("network", F.col("valid") & (F.col("acc") >= F.col("network_threshold")))
    moving = F.col("receiver") != F.col("node")
    below = made.select("survey", F.col("node").alias("receiver"), F.col("z").alias("z_below"), F.col("network").alias("network_below"), F.col("allowed").alias("allowed_below"), F.col("wet").alias("wet_below"), (F.col("receiver") != F.col("node")).alias("moving_below"))
    joined = made.join(below, ["survey", "receiver"], "left").withColumn("supported", F.col("network") & F.col("allowed") & ~F.col("wet") & moving & (F.col("z") - F.col("z_below") > least_drop))
    incoming = made.where(F.col("network") & moving).groupBy("survey", F.col("receiver").alias("node")).agg(F.count(F.lit(1)).alias("incoming"))
    support = joined.where("supported").select("survey", F.col("node").alias("receiver"), F.lit(True).alias("goes_on"))
    ends = joined.join(support, ["survey", "receiver"], "left").join(incoming, ["survey", "node"], "left")
    return ends.where(F.col("supported") & ((F.coalesce("incoming", F.lit(0)) >= 2) | F.col("goes_on").isNull())).drop("goes_on", "z_below", "network_below", "allowed_below", "wet_below", "moving_below")


def depression_targets(wet: DataFrame, allowed: DataFrame) -> DataFrame:
    """(survey, component, node, cells, bottom): flat-lying depressions of three cells or more, wholly on land and dry of
    mapped water, with an allowed cell; the node is the deepest allowed one, of equals that with the most clearance.

    `wet` are the rows of hydrology.depressions with land, water and clearance (cells to the component's rim).
    """
    marked = wet.join(allowed.select("survey", "row", "col", F.lit(True).alias("allowed__")), ["survey", "row", "col"], "left").withColumn("allowed__", F.coalesce("allowed__", F.lit(False)))
    low = marked.groupBy("survey", "component").agg(F.min(F.when(F.col("allowed__"), F.col("z"))).alias("low__"))
    named = marked.join(low, ["survey", "component"])
    best = F.max_by("node", F.when(F.col("allowed__") & (F.col("z") <= F.col("low__") + 1e-6), F.struct("clearance", -F.col("node"))))
    kept = named.groupBy("survey", "component").agg(F.count(F.lit(1)).alias("cells"), F.bool_or("water").alias("w"), F.bool_and("land").alias("l"), F.bool_or("allowed__").alias("a"), (F.max("z_filled") - F.min("z_filled")).alias("r"), F.min("z").alias("bottom"), best.alias("node"))
    return kept.where((F.col("cells") >= 3) & ~F.col("w") & F.col("l") & F.col("a") & (F.col("r") <= 1e-5)).select("survey", "component", "node", "cells", "bottom")


def scored(targets: DataFrame, cell_m2: float, max_slope: float = 8.0, min_ha: float = 0.0, max_ha: float | None = None) -> DataFrame:
    """targets (survey, row, col, area_cells, local_slope_deg) within the area limits + drainage, slope and total score; low is good."""
    ha = F.col("area_cells") * cell_m2 / 1e4
    fits = targets.where((ha >= min_ha) & (ha <= max_ha if max_ha is not None else F.lit(True)))
    most = fits.groupBy(F.col("survey").alias("of__")).agg(F.max("area_cells").alias("most__"))
    drainage = 1 - F.log1p("area_cells") / F.log1p("most__")
    slope = F.least(F.col("local_slope_deg") / max_slope, F.lit(1.0))
    made = fits.join(most, F.col("survey").eqNullSafe(F.col("of__"))).withColumns({"drainage_score": drainage, "slope_score": slope}).drop("of__", "most__")
    return made.withColumn("score", 0.75 * F.col("drainage_score") + 0.25 * F.col("slope_score"))


def spans(toured: DataFrame, starts: DataFrame) -> DataFrame:
    """(survey, site, root, first, size): a site's catchment as intervals that are apart, one where its water leaves by one cell.

    `toured` is forest.tour, `starts` are (survey, node, site), many cells for a depression. Cells whose tree holds another of the same site's go.
    """
    links = starts.join(toured, ["survey", "node"]).select("survey", "site", "node", "root", "first", "size", "receiver").distinct()
    own = links.select("survey", "site", F.col("node").alias("receiver"), F.col("node").alias("below__"))
    exits = links.join(own, ["survey", "site", "receiver"], "left").where(F.col("below__").isNull() | (F.col("below__") == F.col("node")))
    before = Window.partitionBy("survey", "site", "root").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # the exits of one site
    reach = F.max(F.col("first") + F.col("size")).over(before)
    return exits.withColumn("reach__", reach).where(F.col("reach__").isNull() | (F.col("first") >= F.col("reach__"))).select("survey", "site", "root", "first", "size")


def span_sizes(spanned: DataFrame) -> DataFrame:
    """(survey, site, n): the cells of catchments given as intervals."""
    return spanned.groupBy("survey", "site").agg(F.sum("size").alias("n"))


def overlaps(spanned: DataFrame) -> DataFrame:
    """(survey, site_a, site_b, iou) of catchments (see `spans`) that share a cell.

    Intervals are nested or apart. They meet in blocks of numbers as long as the outer one, rounded up to a power of two, so an
    interval asks once for each such length and not for every other one.
    """
    level = F.length(F.bin(F.col("size") - 1))
    held = spanned.withColumn("level", level.cast("int")).withColumn("block", F.explode(F.expr("array_distinct(array(shiftright(first, level), shiftright(first + size - 1, level)))")))
    outer = held.select("survey", "root", "level", "block", F.col("site").alias("outer"), F.col("first").alias("f__"), F.col("size").alias("n__"))
    levels = held.select("survey", "root", "level").distinct()
    asks = spanned.join(levels, ["survey", "root"]).where(F.col("level") >= level).withColumn("block", F.expr("shiftright(first, level)"))
    met = asks.join(outer, ["survey", "root", "level", "block"])
    inside = (F.col("first") >= F.col("f__")) & (F.col("first") < F.col("f__") + F.col("n__"))
    once = (F.col("first") != F.col("f__")) | (F.col("site") < F.col("outer"))
    pairs = met.where((F.col("site") != F.col("outer")) & inside & once).select("survey", F.least("site", "outer").alias("site_a"), F.greatest("site", "outer").alias("site_b"), "size")
    common = pairs.groupBy("survey", "site_a", "site_b").agg(F.sum("size").alias("both"))
    sizes = span_sizes(spanned)
    sized = common.join(sizes.select("survey", F.col("site").alias("site_a"), F.col("n").alias("na")), ["survey", "site_a"]).join(sizes.select("survey", F.col("site").alias("site_b"), F.col("n").alias("nb")), ["survey", "site_b"])
    return sized.select("survey", "site_a", "site_b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("iou"))


def site_conflicts(sites: DataFrame, shared: DataFrame, resolution: float, min_distance_m: float = 100.0, limit: float = 0.8) -> DataFrame:
    """(survey, site, other): pairs nearer than the distance or with catchments that mostly agree; sites have row, col, site.

    Near pairs meet in buckets as wide as the distance, so only neighbours are compared.
    """
    side = max(1, int(min_distance_m / resolution) + 1)
    keyed = sites.select("survey", "site", "row", "col", F.floor(F.col("row") / side).alias("br"), F.floor(F.col("col") / side).alias("bc"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = keyed.select("survey", F.col("site").alias("other"), F.col("row").alias("r2"), F.col("col").alias("c2"), "br", "bc", around.alias("o")).select("survey", "other", "r2", "c2", (F.col("br") + F.col("o.i")).alias("br"), (F.col("bc") + F.col("o.j")).alias("bc"))
    near = keyed.join(asked, ["survey", "br", "bc"]).where((F.col("site") != F.col("other")) & (F.hypot(F.col("row") - F.col("r2"), F.col("col") - F.col("c2")) * resolution < min_distance_m)).select("survey", "site", "other")
    alike = shared.where(F.col("iou") >= limit)
    both = alike.select("survey", F.col("site_a").alias("site"), F.col("site_b").alias("other")).unionByName(alike.select("survey", F.col("site_b").alias("site"), F.col("site_a").alias("other")))
    return near.unionByName(both).distinct()


def select_sites(ranked: DataFrame, conflicts: DataFrame, k: int = 5) -> DataFrame:
    """The best k sites of each survey, none in conflict with a better one that was taken, with their rank from 1.

    In each of k rounds every survey takes its best site left, by an aggregation, and that site and those in conflict with
    it go. Ties of scores go to the larger area, then the smaller row, column and number.
    """
    order = F.struct("score", -F.col("area_cells"), "row", "col", "site")
    left, against, rounds = cut(ranked.select("survey", "site", order.alias("order__"))), cut(conflicts), []
    for rank in range(1, k + 1):
        best = cut(left.groupBy("survey").agg(F.min_by("site", "order__").alias("site")))
        if best.isEmpty():
            break
        rounds.append(best.withColumn("rank", F.lit(rank)))
        gone = best.unionByName(best.join(against, ["survey", "site"]).select("survey", F.col("other").alias("site")))
        left = cut(left.join(gone.distinct(), ["survey", "site"], "left_anti"))
    if not rounds:
        return ranked.withColumn("rank", F.lit(1)).limit(0)
    taken = rounds[0]
    for more in rounds[1:]:
        taken = taken.unionByName(more)
    return ranked.join(taken, ["survey", "site"])


def select_apart(ranked: DataFrame, spanned: DataFrame, resolution: float, min_distance_m: float = 100.0, limit: float = 0.8, k: int = 5) -> DataFrame:
    """`select_sites` for catchments given as intervals: each round compares the sites left with the one just taken, so no pairs are kept.

    Sites nearer than the distance go, and those whose intervals share at least `limit` of their union with the taken one's.
    """
    order = F.struct("score", -F.col("area_cells"), "row", "col", "site")
    sized = spanned.join(span_sizes(spanned), ["survey", "site"])
    left, sized, rounds = cut(ranked.select("survey", "site", order.alias("order__"))), cut(sized), []
    for rank in range(1, k + 1):
        best = cut(left.groupBy("survey").agg(F.min("order__").alias("b")).select("survey", F.col("b.site").alias("site"), F.col("b.row").alias("r__"), F.col("b.col").alias("c__")))
        if best.isEmpty():
            break
        rounds.append(best.select("survey", "site", F.lit(rank).alias("rank")))
        far = F.hypot(F.col("order__.row") - F.col("r__"), F.col("order__.col") - F.col("c__")) * resolution
        near = left.join(best.drop("site"), "survey").where(far < min_distance_m).select("survey", "site")
        of_best = best.join(sized, ["survey", "site"]).select("survey", "root", F.col("first").alias("f__"), F.col("size").alias("n__"), F.col("n").alias("all__"))
        others = left.join(sized, ["survey", "site"]).join(of_best, ["survey", "root"])
        shared = F.when((F.col("first") >= F.col("f__")) & (F.col("first") < F.col("f__") + F.col("n__")), F.col("size")).when((F.col("f__") >= F.col("first")) & (F.col("f__") < F.col("first") + F.col("size")), F.col("n__")).otherwise(0)
        both = others.groupBy("survey", "site", "n", "all__").agg(F.sum(shared).alias("both"))
        alike = both.where(F.col("both") / (F.col("n") + F.col("all__") - F.col("both")) >= limit).select("survey", "site")
        left = cut(left.join(near.unionByName(alike).unionByName(best.select("survey", "site")).distinct(), ["survey", "site"], "left_anti"))
    if not rounds:
        return ranked.withColumn("rank", F.lit(1)).limit(0)
    taken = rounds[0]
    for more in rounds[1:]:
        taken = taken.unionByName(more)
    return ranked.join(taken, ["survey", "site"])


def centre(sites: DataFrame) -> DataFrame:
    """One row: mean longitude and latitude of sites (lon, lat), where rain is asked for if no land is chosen; null without sites."""
    return sites.agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def assessment(filled: DataFrame, unfilled: DataFrame, cells: DataFrame, count: int | None = None) -> DataFrame:
    """(survey, site, ...): how a site's catchment depends on filling; both inputs are (survey, node, site), cells have z, z_filled, water, boundary. `count` is the number of cells, if it is known.

    Both catchments are dealt by cells as one table, grouped and joined with the cells where they lie.
    """
    count, at = cells.count() if count is None else count, ("survey", "node")
    a = filled.select(*at, "site", F.lit(True).alias("in_filled"), F.lit(False).alias("in_unfilled"))
    b = unfilled.select(*at, "site", F.lit(False).alias("in_filled"), F.lit(True).alias("in_unfilled"))
    each = blocks.keyed(a.unionByName(b), at, count).groupBy("at__", "site").agg(F.max("in_filled").alias("in_filled"), F.max("in_unfilled").alias("in_unfilled"))
    both = each.join(apart(blocks.keyed(cells.select(*at, "z", "z_filled", "water", "boundary"), at, count)), "at__").withColumn("survey", F.col("at__.survey"))
    inside, plain = F.col("in_filled"), F.col("in_unfilled")
    raised = F.col("z_filled") - F.col("z")
    n = F.count_if(inside)
    return both.groupBy("survey", "site").agg(
        n.alias("filled_cells"),
        (F.count_if(inside & (raised > 1e-6)) / n).alias("catchment_filled_fraction"),
        F.max(F.when(inside, raised)).alias("catchment_max_fill_m"),
        (F.count_if(inside & ~plain) / n).alias("additional_area_fraction"),
        (F.count_if(inside != plain) / n).alias("routing_sensitivity_fraction"),
        F.bool_or(inside & F.col("water")).alias("upstream_water_overlap"),
        (F.count_if(inside & F.col("water")) / n).alias("upstream_water_fraction"),
        F.bool_or(inside & F.col("boundary")).alias("boundary_truncated"),
    )
