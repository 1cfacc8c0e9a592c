"""Physical-cell-identity planning on the relation graph: confusions, collisions, blacklists."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from cellscape.functions import text
from cellscape.functions.scoring import clip, log1p_safe, ratio, severity_category
from cellscape.operators.checks import RELATIONS, require
from cellscape.operators.components import connected_components
from cellscape.operators.quantile import group_quantiles
from cellscape.params import PciPlan
from cellscape.session import cut_lineage

# Score parts of a collision by type and hop.
BASE_SCORE = {"exact": 0.35, "mod3": 0.05, "mod30": 0.0}
ONE_HOP_SCORE, TWO_HOP_EXACT_SCORE, TRAFFIC_SCORE, TWO_HOP_SEVERITY = 0.15, 0.10, 0.35, 0.25
GROUP = ["serving", "band", "pci"]
STEP_PIECE = 1_000


class Network(NamedTuple):
    """Edges with activity in both directions, and node attributes."""

    edges: DataFrame
    nodes: DataFrame


def clean_relations(relations: DataFrame, p: PciPlan = PciPlan()) -> DataFrame:
    """Normalised flags and numbers; no self or co-sector rows, identities in range."""
    out = relations.select(
        F.col("cell_name").cast("string").alias("serving"),
        F.col("to_cell_name").cast("string").alias("neighbour"),
        F.col("pci").cast("int").alias("pci"),
        F.col("to_pci").cast("int").alias("to_pci"),
        F.col("band").cast("string").alias("band"),
        F.col("to_band").cast("string").alias("to_band"),
        F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"),
        F.coalesce(F.col("distance").cast("double"), F.lit(0.0)).alias("distance"),
        text.yes_no(F.col("intra_site")).alias("intra_site"),
        text.yes_no(F.col("intra_cell")).alias("intra_cell"),
        (text.neighbour_relation(F.col("neighbor_relation")) if "neighbor_relation" in relations.columns else F.lit("N/A")).alias("relation"),
    )
    out = out.where((F.col("serving") != F.col("neighbour")) & (F.col("intra_cell") == "n"))
    if p.validate_range:
        out = out.where(
            text.pci_in_range(F.col("pci"), F.col("band")) & text.pci_in_range(F.col("to_pci"), F.col("to_band"))
        )
    return out


def co_sector_groups(relations: DataFrame) -> DataFrame:
    """Cells that share a sector (same site, flagged co-sector), as connected groups."""
    pairs = relations.where(text.yes_no(F.col("intra_cell")) == "y")
    edges = pairs.select(F.col("cell_name").alias("src"), F.col("to_cell_name").alias("dst"))
    return connected_components(edges).select(F.col("node").alias("cell_name"), F.col("component").alias("sector_group"))


def build_network(relations: DataFrame, p: PciPlan = PciPlan(), blacklist: DataFrame | None = None) -> Network:
    """Edge activity and shares, and one identity and band per cell.

    A cell's attributes come from its serving rows, else from rows where it is the neighbour.
    ``blacklist`` (serving, neighbour) takes relations out of shares and later steps.
    """
    require(relations, "identity planning", *RELATIONS, "pci", "to_pci", "band", "to_band")
    rows = clean_relations(relations, p)
    serving = rows.select(F.col("serving").alias("cell"), F.lit(0).alias("role"), "pci", "band")
    heard = rows.select(F.col("neighbour").alias("cell"), F.lit(1).alias("role"), F.col("to_pci").alias("pci"), F.col("to_band").alias("band"))
    nodes = serving.unionByName(heard).groupBy("cell").agg(F.min(F.struct("role", "pci", "band")).alias("_a"))
    nodes = nodes.select("cell", "_a.pci", "_a.band", text.site_from_cell(F.col("cell")).alias("site"))
    out = rows.groupBy("serving", "neighbour").agg(
        F.sum("weight").alias("out_ho"),
        F.min("distance").alias("distance"),
        F.max(F.col("intra_site") == "y").alias("intra_site"),
        F.max("relation").alias("relation"),
    )
    back = out.select(F.col("serving").alias("neighbour"), F.col("neighbour").alias("serving"), F.col("out_ho").alias("in_ho"))
    edges = out.join(back, ["serving", "neighbour"], "left").withColumn("in_ho", F.coalesce("in_ho", F.lit(0.0)))
    edges = edges.withColumn("act_ho", F.col("out_ho") + F.col("in_ho"))
    if blacklist is not None:
        edges = edges.join(blacklist.select("serving", "neighbour"), ["serving", "neighbour"], "left_anti")
    totals = edges.groupBy("serving").agg(
        F.sum("act_ho").alias("_total"), F.sum(F.when(F.col("act_ho") > 0, 1).otherwise(0)).alias("active_neighbours")
    )
    edges = edges.join(totals, "serving").withColumn("share", ratio(F.col("act_ho"), F.col("_total"))).drop("_total")
    return Network(cut_lineage(edges), cut_lineage(nodes))


def one_hop_pairs(net: Network, p: PciPlan = PciPlan()) -> DataFrame:
    """Undirected pairs (a < b) with a logarithmic handover weight."""
    near = net.edges.where(F.col("distance") <= p.max_distance_m)
    return near.groupBy(
        F.least("serving", "neighbour").alias("a"), F.greatest("serving", "neighbour").alias("b")
    ).agg(F.max(log1p_safe(F.col("act_ho"))).alias("w"))


def _steps(net: Network, direct: DataFrame, p: PciPlan) -> DataFrame:
    """Directed near edges (x, y) with the positive weight of their pair."""
    near = net.edges.where(F.col("distance") <= p.max_distance_m).select("serving", "neighbour")
    weight = direct.where(F.col("w") > 0)
    both = weight.select(F.col("a").alias("x"), F.col("b").alias("y"), "w").unionByName(
        weight.select(F.col("b").alias("x"), F.col("a").alias("y"), "w")
    )
    return near.toDF("x", "y").join(both, ["x", "y"])


def two_hop_pairs(net: Network, direct: DataFrame, p: PciPlan = PciPlan(), piece: int = STEP_PIECE) -> DataFrame:
    """Weights of all pairs linked through a common neighbour, without a limit on their number.

    Steps into and out of a cell are cut into pieces of about ``piece`` rows; a pair of
    pieces is a join key of its own, so no task holds all paths of a hub.
    """
    steps = cut_lineage(_steps(net, direct, p))

    def pieces(side: str, name: str) -> DataFrame:
        return steps.groupBy(F.col(side).alias("k")).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(piece))).cast("int").alias(name))

    sizes = cut_lineage(pieces("y", "_into").join(pieces("x", "_from"), "k"))
    first = steps.toDF("i", "k", "wi").join(sizes, "k").select(
        "i", "k", "wi", F.pmod(F.xxhash64("i"), "_into").cast("int").alias("_p"), F.explode(F.sequence(F.lit(0), F.col("_from") - 1)).alias("_q")
    )
    second = steps.toDF("k", "j", "wj").join(sizes, "k").select(
        "j", "k", "wj", F.explode(F.sequence(F.lit(0), F.col("_into") - 1)).alias("_p"), F.pmod(F.xxhash64("j"), "_from").cast("int").alias("_q")
    )
    paths = first.join(second, ["k", "_p", "_q"]).where(F.col("i") != F.col("j"))
    return paths.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(
        F.sum(p.two_hop_factor * F.least("wi", "wj")).alias("w")
    )


def colliding_two_hop_pairs(net: Network, direct: DataFrame, p: PciPlan = PciPlan()) -> DataFrame:
    """The rows of :func:`two_hop_pairs` whose pair can collide.

    Only pairs on one band with equal identities, or on one site with equal remainders,
    can, so that test is part of the join key: a hub does not pair all its neighbours,
    and every emitted path belongs to a reported pair.
    """
    steps = _steps(net, direct, p)
    nodes = net.nodes
    first = steps.toDF("i", "k", "wi").join(nodes.select(F.col("cell").alias("i"), "band", "pci", "site"), "i")
    second = steps.toDF("k", "j", "wj").join(
        nodes.select(F.col("cell").alias("j"), F.col("band").alias("jband"), F.col("pci").alias("jpci"), F.col("site").alias("jsite")), "j"
    )
    keep = ["i", "k", "j", "wi", "wj"]
    same_k = first["k"] == second["k"]
    same_band = first["band"] == second["jband"]
    exact = first.join(second, same_k & same_band & (first["pci"] == second["jpci"]))
    found = [exact.select("i", first["k"], "j", "wi", "wj")]
    flagged = net.edges.where("intra_site").select("serving", "neighbour")
    flagged = flagged.toDF("i", "j").unionByName(flagged.toDF("j", "i")).distinct()
    for modulus in [m for m, on in ((3, p.mod3), (30, p.mod30)) if on]:
        alike = (first["pci"] % modulus == second["jpci"] % modulus) & (first["pci"] != second["jpci"])
        on_site = first.join(second, same_k & same_band & (first["site"] == second["jsite"]) & alike)
        found.append(on_site.select("i", first["k"], "j", "wi", "wj"))
        by_flag = first.join(flagged, "i").join(second, ["k", "j"])
        found.append(
            by_flag.where((F.col("band") == F.col("jband")) & (F.col("pci") % modulus == F.col("jpci") % modulus) & (F.col("pci") != F.col("jpci"))).select(*keep)
        )
    paths = found[0]
    for more in found[1:]:
        paths = paths.unionByName(more)
    paths = paths.where(F.col("i") != F.col("j"))
    if len(found) > 1:
        paths = paths.distinct()
    return paths.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(
        F.sum(p.two_hop_factor * F.least("wi", "wj")).alias("w")
    )


def _summed(direct: DataFrame, two_hop: DataFrame | None) -> DataFrame:
    parts = direct if two_hop is None else direct.unionByName(two_hop)
    return parts.groupBy("a", "b").agg(F.sum("w").alias("pair_weight"))


def pair_weights(net: Network, p: PciPlan = PciPlan()) -> DataFrame:
    """All direct and two-hop pairs with the summed weight."""
    direct = one_hop_pairs(net, p)
    return _summed(direct, two_hop_pairs(net, direct, p) if p.two_hop_factor > 0 else None)


def collision_weights(net: Network, p: PciPlan = PciPlan()) -> DataFrame:
    """Weights that are whole for pairs that can collide.

    Other pairs are listed only if they are direct, with their direct weight alone; see
    :func:`pair_weights` for the whole table.
    """
    direct = one_hop_pairs(net, p)
    return _summed(direct, colliding_two_hop_pairs(net, direct, p) if p.two_hop_factor > 0 else None)


def _p95_scale(df: DataFrame, column: str, width: float) -> Column:
    """0.95 quantile of a column as a scalar, never zero."""
    top = group_quantiles(df, [], column, {"q": 0.95}, width).agg(F.max("q"))
    return F.greatest(top.scalar(), F.lit(1e-9))


def confusion_members(net: Network, ignore: list[int] | None = None) -> DataFrame:
    """Neighbours of a serving cell that share band and identity with another neighbour."""
    ends = net.nodes.select(F.col("cell").alias("neighbour"), "pci", "band")
    rows = net.edges.join(ends, "neighbour").where((F.col("pci") >= 0) & (F.col("band") != ""))
    if ignore:
        rows = rows.where(~F.col("pci").isin(ignore))
    groups = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") >= 2)
    return rows.join(groups, GROUP)


def score_confusions(members: DataFrame) -> DataFrame:
    """One scored row per confusion, without its members."""
    groups = members.groupBy(*GROUP, "group_size").agg(
        (F.sum("act_ho") - F.max("act_ho")).alias("severity_act_sum_excl_max"),
        F.min("act_ho").alias("min_act"),
        F.max("act_ho").alias("max_act"),
    )
    groups = cut_lineage(groups)
    bonus = clip((F.col("group_size") - 2) * 0.1, 0.0, 0.3)
    base = clip(F.col("severity_act_sum_excl_max") / _p95_scale(groups, "severity_act_sum_excl_max", 1.0))
    scored = groups.withColumn("severity_score", clip(base + bonus))
    return scored.withColumn("severity_category", severity_category(F.col("severity_score")))


def detect_confusions(net: Network, ignore: list[int] | None = None) -> DataFrame:
    """One row per confusion with the names of all its neighbours.

    :func:`confusion_members` has the neighbours as rows, :func:`score_confusions` no names.
    """
    members = confusion_members(net, ignore)
    names = members.groupBy(*GROUP).agg(F.array_join(F.array_sort(F.collect_list("neighbour")), ",").alias("neighbors"))
    return score_confusions(members).join(names, GROUP).withColumnRenamed("pci", "confusion_pci")


def intra_site_pairs(net: Network) -> DataFrame:
    """Pairs (a < b) joined by an edge flagged intra-site in either direction."""
    flagged = net.edges.where("intra_site")
    return flagged.select(F.least("serving", "neighbour").alias("a"), F.greatest("serving", "neighbour").alias("b")).distinct()


def detect_collisions(net: Network, p: PciPlan = PciPlan(), ignore: list[int] | None = None) -> DataFrame:
    """Related cells of one band with equal identities, or equal remainders on one site."""

    def node(side: str) -> DataFrame:
        return net.nodes.select(F.col("cell").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("pci", "band", "site")])

    pairs = collision_weights(net, p).join(node("a"), "a").join(node("b"), "b")
    pairs = pairs.where((F.col("band_a") == F.col("band_b")) & (F.col("pci_a") >= 0) & (F.col("pci_b") >= 0))
    if ignore:
        pairs = pairs.where(~F.col("pci_a").isin(ignore) & ~F.col("pci_b").isin(ignore))
    linked = net.edges.select(F.least("serving", "neighbour").alias("a"), F.greatest("serving", "neighbour").alias("b")).distinct()
    pairs = pairs.join(linked.withColumn("_direct", F.lit(True)), ["a", "b"], "left")
    pairs = pairs.join(intra_site_pairs(net).withColumn("_flag", F.lit(True)), ["a", "b"], "left")
    intra = F.coalesce("_flag", F.lit(False)) | (F.col("site_a") == F.col("site_b"))

    def alike(m: int) -> Column:
        return intra & (F.col("pci_a") % m == F.col("pci_b") % m)

    kind = F.when(F.col("pci_a") == F.col("pci_b"), "exact")
    if p.mod3:
        kind = kind.when(alike(3), "mod3")
    if p.mod30:
        kind = kind.when(alike(30), "mod30")
    one_hop = F.coalesce("_direct", F.lit(False))
    out = pairs.withColumn("conflict_type", kind).where(F.col("conflict_type").isNotNull())
    factor = text.choose(F.col("conflict_type"), {"exact": 1.0, "mod3": p.mod3_factor, "mod30": p.mod30_factor})
    out = out.select(
        F.col("a").alias("cell_a"),
        F.col("b").alias("cell_b"),
        "pci_a",
        "pci_b",
        F.col("band_a").alias("band"),
        "conflict_type",
        F.when(one_hop, "1-hop").otherwise("2-hop").alias("hop_type"),
        "pair_weight",
        (F.col("pair_weight") * factor * F.when(one_hop, 1.0).otherwise(TWO_HOP_SEVERITY)).alias("severity"),
        "site_a",
        "site_b",
        intra.alias("intra_site"),
    )
    out = cut_lineage(out)
    hop = F.when(F.col("hop_type") == "1-hop", ONE_HOP_SCORE).when(F.col("conflict_type") == "exact", TWO_HOP_EXACT_SCORE).otherwise(0.0)
    site = F.when(
        F.col("intra_site"),
        text.choose(F.col("conflict_type"), {"exact": p.exact_overlap_bonus, "mod3": p.mod3_bonus, "mod30": p.mod30_bonus}),
    ).otherwise(0.0)
    traffic = clip(F.col("severity") / _p95_scale(out, "severity", 0.05)) * TRAFFIC_SCORE
    score = clip(text.choose(F.col("conflict_type"), BASE_SCORE) + hop + site + traffic)
    out = out.withColumn("severity_score", score)
    return out.withColumn("severity_category", severity_category(F.col("severity_score")))


def actionable_collisions(collisions: DataFrame, everything: bool = False) -> DataFrame:
    """Exact collisions, and remainder-3 ones on a single site; all of them on request."""
    if everything:
        return collisions
    return collisions.where(
        (F.col("conflict_type") == "exact") | ((F.col("conflict_type") == "mod3") & F.col("intra_site"))
    )


def suggest_blacklist(net: Network, p: PciPlan = PciPlan(), ignore: list[int] | None = None) -> DataFrame:
    """A decision for every relation in a confusion, weakest first, until one member is left.

    Only dead relations are ever removed and they sort first, so whether a row comes after
    the stop follows from two figures of its group: how many dead relations it removes and
    the last of their names.  No group is ordered as a whole.
    """
    members = confusion_members(net, ignore)
    informed = net.edges.agg(F.max(F.col("relation") != "N/A")).scalar()
    left = F.col("active_neighbours") - F.when(F.col("act_ho") > 0, 1).otherwise(0)
    skipped = F.coalesce(informed, F.lit(False)) & (F.col("relation") != "Y")
    quiet = (
        (F.col("act_ho") <= p.max_low_activity)
        & (F.col("share") <= p.max_low_share)
        & (F.greatest("out_ho", "in_ho") <= p.max_single_activity)
    )
    reason = (
        F.when(F.col("intra_site"), "REJECT_INTRA_SITE")
        .when(skipped, F.lit(None))
        .when(left < p.keep_active, "REJECT_MIN_NEIGHBORS")
        .when((F.col("out_ho") == 0) & (F.col("in_ho") == 0), "AUTO_DEAD_RELATION")
        .when(quiet, "SUGGEST_LOW_ACTIVITY_REVIEW")
        .otherwise("REJECT_ACTIVE_RELATION")
    )
    judged = members.withColumns({"reason": reason, "remaining_active_neighbors_after": left})
    dead = F.col("reason") == "AUTO_DEAD_RELATION"
    groups = judged.groupBy(*GROUP).agg(
        F.sum(F.when(dead, 1).otherwise(0)).alias("_dead"),
        F.max(F.when(dead, F.col("neighbour"))).alias("_last"),
    )
    judged = judged.join(groups, GROUP)
    before_stop = (
        F.when(F.col("_dead") <= F.col("group_size") - 2, True)
        .when(F.col("_dead") == F.col("group_size"), F.col("neighbour") != F.col("_last"))
        .otherwise(dead | ((F.col("act_ho") == 0) & (F.col("neighbour") < F.col("_last"))))
    )
    return judged.where(before_stop & F.col("reason").isNotNull()).select(
        "serving",
        F.col("neighbour").alias("neighbor"),
        "reason",
        "out_ho",
        "in_ho",
        "act_ho",
        "share",
        F.col("pci").alias("confusion_pci"),
        F.col("group_size").alias("confusion_group_size_before"),
        "remaining_active_neighbors_after",
    )


def apply_blacklist(relations: DataFrame, decisions: DataFrame, p: PciPlan = PciPlan()) -> Network:
    """Network without the relations decided dead; shares are computed anew."""
    dead = decisions.where(F.col("reason") == "AUTO_DEAD_RELATION").select("serving", F.col("neighbor").alias("neighbour"))
    return build_network(relations, p, cut_lineage(dead.distinct()))


def planning_summary(confusions: DataFrame, collisions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Counts per kind of finding."""
    parts = [
        confusions.groupBy(F.lit("confusion").alias("kind"), F.col("severity_category").alias("detail")).count(),
        collisions.groupBy(F.concat_ws("_", F.lit("collision"), "conflict_type").alias("kind"), F.col("hop_type").alias("detail")).count(),
        decisions.groupBy(F.lit("blacklist").alias("kind"), F.col("reason").alias("detail")).count(),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
