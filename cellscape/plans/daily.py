"""A whole run: every detector over one set of inputs, with report tables and sinks."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from cellscape import params as P
from cellscape.operators import (
    combine, environment, feeders, gaps, hulls, interference, lowcoverage, overshoot, pci, reports, rootcause, undershoot,
)
from cellscape.session import cut_lineage
from cellscape.sources import writers


@dataclass
class Inputs:
    coverage: DataFrame
    gis: DataFrame
    relations: DataFrame | None = None
    hulls: DataFrame | None = None
    environment: DataFrame | None = None
    boundary: DataFrame | None = None


@dataclass
class Settings:
    """Parameters of all detectors; ``overshoot_classes`` None means one set for all cells."""

    overshoot: P.Overshoot = P.Overshoot()
    overshoot_classes: dict | None = field(default_factory=lambda: P.OVERSHOOT_BY_ENVIRONMENT)
    undershoot: P.Undershoot = P.Undershoot()
    undershoot_classes: dict | None = field(default_factory=lambda: P.UNDERSHOOT_BY_ENVIRONMENT)
    interference: P.Interference = P.Interference()
    root_cause: P.RootCause = P.RootCause()
    gaps: P.Gaps = P.Gaps()
    low_coverage: P.LowCoverage = P.LowCoverage()
    advice: P.Advice = P.Advice()
    pci: P.PciPlan = P.PciPlan()
    pci_overlap: P.PciOverlap = P.PciOverlap()
    carrier_aggregation: P.CarrierAggregation = P.CarrierAggregation()
    feeders: P.Feeders = P.Feeders()
    daily: P.DailyTable = P.DailyTable()


def run_detectors(inputs: Inputs, day: datetime.date, settings: Settings | None = None, only: list[str] | None = None) -> dict[str, DataFrame]:
    """Findings by name.  Detectors without their input are left out; ``only`` picks some."""
    s = settings or Settings()
    wanted = set(only) if only else None

    def on(name: str) -> bool:
        return wanted is None or name in wanted

    cov, gis, out = inputs.coverage, inputs.gis, {}
    env = cut_lineage(environment.choose_environment(gis, inputs.environment))
    out["environment"] = env
    if on("overshooting"):
        found = overshoot.detect_overshooting(cov, gis, s.overshoot, env, s.overshoot_classes)
        out["overshooting"], out["overshooting_bins"] = cut_lineage(found.cells), found.bins
    if on("undershooting"):
        found = undershoot.detect_undershooting(cov, gis, s.undershoot, env, s.undershoot_classes)
        out["undershooting"], out["undershooting_bins"] = cut_lineage(found.cells), found.bins
    if on("interference"):
        found = interference.detect_interference(cov, s.interference)
        causes = rootcause.analyse_root_causes(found.clusters, found.members, gis, s.root_cause)
        out["interference"], out["interference_cells"], out["interference_bins"] = causes.clusters, found.members, found.bins
        out["interference_tilt_advice"] = causes.tilt_advice
    if on("low_coverage"):
        found = lowcoverage.detect_low_coverage(cov, env, s.low_coverage, inputs.boundary)
        out["low_coverage"] = found.clusters
        out["low_coverage_advice"] = lowcoverage.recommend(found, gis, cov, env, s.advice)
    if inputs.hulls is not None:
        outlines = cut_lineage(hulls.enrich_hulls(hulls.valid_hulls(inputs.hulls), gis))
        if on("coverage_gaps"):
            out["coverage_gaps"] = gaps.detect_coverage_gaps(outlines, s.gaps, False, inputs.boundary).gaps
            out["coverage_gaps_by_band"] = gaps.detect_coverage_gaps(outlines, s.gaps, True, inputs.boundary).gaps
        if on("pci_overlaps"):
            out["pci_overlaps"] = hulls.detect_pci_overlaps(outlines, s.pci_overlap)
        if on("ca_imbalance"):
            out["ca_imbalance"] = hulls.detect_ca_imbalance(outlines, s.carrier_aggregation)
    if inputs.relations is not None:
        if on("pci"):
            net = pci.build_network(inputs.relations, s.pci)
            out["pci_confusions"] = pci.detect_confusions(net)
            every = cut_lineage(pci.detect_collisions(net, s.pci))
            out["pci_collisions"] = pci.actionable_collisions(every)
            out["pci_blacklist"] = cut_lineage(pci.suggest_blacklist(net, s.pci))
            members = cut_lineage(pci.confusion_members(net))
            facts = (inputs.relations, gis, day)
            out["pci_level1"] = reports.pci_level1(every, *facts)
            out["pci_blacklist_table"] = reports.pci_blacklist_table(out["pci_blacklist"], *facts)
            out["pci_level2"] = reports.pci_level2(every, members, out["pci_blacklist"], *facts)
            out["pci_combined"] = reports.pci_combined(every, members, out["pci_blacklist"], *facts)
        if on("crossed_feeders"):
            found = feeders.detect_crossed_feeders(inputs.relations, gis, s.feeders)
            out["crossed_feeders"], out["feeder_swaps"], out["feeder_sites"] = found
    if "overshooting" in out and "undershooting" in out:
        parts = (out["overshooting"], out["overshooting_bins"], out["undershooting"], out["undershooting_bins"], cov, gis, day, s.daily)
        out["daily_resolution"] = reports.daily_resolution(*parts)
        out["resolution_table"] = reports.resolution_table(*parts)
        if inputs.relations is not None:
            out["tier3_neighbours"] = reports.tier3_neighbours(out["overshooting"], out["overshooting_bins"], cov, inputs.relations, gis, day)
    return out


def summary(findings: dict[str, DataFrame]) -> DataFrame:
    return combine.detector_counts(**findings)


def write_findings(findings: dict[str, DataFrame], folder: str, kind: str = "csv") -> None:
    """Regions as GeoJSON lines and everything as tables; empty findings replace older ones."""
    for name, df in findings.items():
        if {"ring", "shape"} & set(df.columns):
            writers.write_geojson(df, f"{folder}/{name}_geojson")
        writers.write_table(df, f"{folder}/{name}", kind)
