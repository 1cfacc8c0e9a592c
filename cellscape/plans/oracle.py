"""DuckDB statements that compute each registered query independently."""

from __future__ import annotations

W, H = "(360.0/262144)", "(180.0/131072)"


def hav(a: str, b: str, c: str, d: str) -> str:
    h = (
        f"(pow(sin(radians(({c})-({a}))/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians(({d})-({b}))/2),2))"
    )
    return f"(2*6371000.0*atan2(sqrt({h}),sqrt(greatest(1-{h},0.0))))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    x = f"sin(radians(({d})-({b})))*cos(radians({c}))"
    y = f"cos(radians({a}))*sin(radians({c}))-sin(radians({a}))*cos(radians({c}))*cos(radians(({d})-({b})))"
    return wrap(f"degrees(atan2({x},{y}))")


def wrap(x: str) -> str:
    return f"(({x})-360.0*floor(({x})/360.0))"


def adiff(a: str, b: str) -> str:
    w = wrap(f"({a})-({b})")
    return f"least({w},360.0-{w})"


CTE: dict[str, tuple[list[str], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTE[name] = (list(needs), body)


def sql(final: str, *needs: str) -> str:
    """Final SELECT preceded by the named building blocks it needs, in dependency order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for m in CTE[n][0]:
            visit(m)
        order.append(n)

    for n in needs:
        visit(n)
    blocks = ",\n".join(f"{n} AS MATERIALIZED ({CTE[n][1]})" for n in order)
    return f"WITH {blocks}\n{final}" if order else final


G = "(s_suppkey//6)"
cte("gis", f"""
SELECT s_suppkey AS cell_key, 'S'||lpad(CAST({G} AS VARCHAR),4,'0') AS site,
  CASE WHEN (s_suppkey//3)%2=0 THEN 'L800' ELSE 'L1800' END AS band,
  'S'||lpad(CAST({G} AS VARCHAR),4,'0')||CASE WHEN (s_suppkey//3)%2=0 THEN 'L' ELSE 'H' END||CAST(s_suppkey%3+1 AS VARCHAR) AS cell_name,
  CAST((s_suppkey*17)%30 AS INTEGER) AS pci,
  51.90::DOUBLE+0.012::DOUBLE*({G}//4)+0.001::DOUBLE*(({G}*37)%7) AS latitude,
  -8.60::DOUBLE+0.018::DOUBLE*({G}%4)+0.001::DOUBLE*(({G}*13)%5) AS longitude,
  CAST(120*(s_suppkey%3)+({G}*7)%30 AS DOUBLE) AS bearing, 65.0::DOUBLE AS hbw,
  CAST((s_suppkey*5)%9 AS DOUBLE) AS tilt_elc, CAST((s_suppkey*3)%4 AS DOUBLE) AS tilt_mech,
  CAST(20+(s_suppkey*7)%26 AS DOUBLE) AS antenna_height, CAST(40+(s_suppkey*11)%7 AS DOUBLE) AS tx_power,
  CAST(s_nationkey%5 AS VARCHAR) AS market
FROM supplier""")
cte("cov0", f"""
SELECT l.*, c.cell_name, c.band, c.bearing, c.latitude AS clat, c.longitude AS clon,
  (ix+0.5)*{W}-180.0 AS longitude, (iy+0.5)*{H}-90.0 AS latitude
FROM (SELECT l_suppkey AS cell_key, CAST(124795+l_partkey%50 AS INTEGER) AS ix, CAST(103315+l_partkey//50 AS INTEGER) AS iy,
        CAST(sum(l_quantity) AS BIGINT) AS event_count, avg(l_discount) AS disc, avg(l_tax) AS tax, max(l_shipdate) AS ts
      FROM lineitem GROUP BY l_suppkey, l_partkey) l JOIN gis c ON l.cell_key=c.cell_key""", "gis")
cte("cov1", f"""SELECT *, round({hav('clat','clon','latitude','longitude')},1) AS distance_to_cell FROM cov0""", "cov0")
cte("cov", f"""
SELECT ix, iy, cell_key, cell_name, band,
  round(-70.0-21.0*log10(greatest(distance_to_cell,100.0)/100.0)-150.0*disc,2) AS avg_rsrp,
  round(-5.0-100.0*tax,2) AS avg_rsrq, round(15.0-400.0*tax,2) AS avg_sinr, event_count, distance_to_cell,
  latitude, longitude, round({adiff(bearing('clat','clon','latitude','longitude'),'bearing')},2) AS grid_bearing_diff, ts
FROM cov1""", "cov1")
cte("rel0", """
SELECT a, b, count(*) AS w, sum(l_quantity) AS traffic_data, sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS drops
FROM (SELECT l_suppkey AS a, l_suppkey+CASE WHEN l_linenumber%2=0 THEN l_orderkey%61-30 ELSE l_orderkey%13-6 END AS b, l_quantity, l_returnflag FROM lineitem)
WHERE a<>b GROUP BY a, b""")
cte("rel", f"""
SELECT x.cell_name, y.cell_name AS to_cell_name, x.pci, y.pci AS to_pci, x.band, y.band AS to_band,
  CAST(w AS DOUBLE) AS weight, round({hav('x.latitude','x.longitude','y.latitude','y.longitude')},1) AS distance,
  CASE WHEN x.site=y.site THEN 'y' ELSE 'n' END AS intra_site, 'n' AS intra_cell,
  CASE WHEN (a*7+b)%4=0 THEN 'N' ELSE 'Y' END AS neighbor_relation, traffic_data, CAST(drops AS DOUBLE) AS drops_voice
FROM rel0 JOIN gis x ON a=x.cell_key JOIN gis y ON b=y.cell_key""", "gis", "rel0")

ORACLE: dict[str, str] = {}
ORACLE["gis_adapter"] = sql("SELECT * FROM gis", "gis")
ORACLE["coverage_adapter"] = sql(
    "SELECT * REPLACE (round(latitude,6) AS latitude, round(longitude,6) AS longitude) FROM cov", "cov")
ORACLE["relations_adapter"] = sql("SELECT * FROM rel", "rel")


# --- lattice and geometry functions ---

B32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash7(ix: str, iy: str) -> str:
    out = []
    for c in range(7):
        bits = []
        for k in range(5):
            t = 5 * c + k
            src, sh = (ix, 17 - t // 2) if t % 2 == 0 else (iy, 16 - t // 2)
            bits.append(f"((({src} >> {sh}) & 1) << {4 - k})")
        out.append(f"substr('{B32}', CAST({'+'.join(bits)} + 1 AS BIGINT), 1)")
    return "||".join(out)


ORACLE["geohash_encode"] = sql(
    f"SELECT ix, iy, {geohash7('ix', 'iy')} AS grid, ix AS back_ix, iy AS back_iy FROM (SELECT DISTINCT ix, iy FROM cov)", "cov")
ORACLE["geohash_bounds"] = sql(
    f"""SELECT ix, iy, round(iy*{H}-90.0,8) AS min_lat, round((iy+1)*{H}-90.0,8) AS max_lat,
    round(ix*{W}-180.0,8) AS min_lon, round((ix+1)*{W}-180.0,8) AS max_lon FROM (SELECT DISTINCT ix, iy FROM cov)""", "cov")
ORACLE["geohash_neighbours"] = sql(
    """SELECT ix, iy, count(*) AS n, CAST(sum(ix+dx) AS BIGINT) AS sx, CAST(sum(iy+dy) AS BIGINT) AS sy FROM (SELECT DISTINCT ix, iy FROM cov),
    (SELECT unnest([-1,0,1]) AS dx) a, (SELECT unnest([-1,0,1]) AS dy) b WHERE dx<>0 OR dy<>0 GROUP BY ix, iy""", "cov")
cte("ends", """SELECT r.cell_name, r.to_cell_name, x.latitude AS lat, x.longitude AS lon, x.bearing, x.hbw, y.latitude AS to_lat, y.longitude AS to_lon
FROM rel r JOIN gis x ON r.cell_name=x.cell_name JOIN gis y ON r.to_cell_name=y.cell_name""", "rel", "gis")
ORACLE["haversine_bearing"] = sql(
    f"""SELECT cell_name, to_cell_name, round({hav('lat','lon','to_lat','to_lon')},4) AS distance_m,
    round({bearing('lat','lon','to_lat','to_lon')},4) AS bearing_deg FROM ends""", "ends")
ORACLE["sector_flag"] = sql(
    f"""SELECT cell_name, to_cell_name, {adiff('b','bearing')} <= hbw/2 AS inside
    FROM (SELECT *, round({bearing('lat','lon','to_lat','to_lon')},4) AS b FROM ends)""", "ends")


def dest(lat: str, lon: str, brg: str, d: str) -> tuple[str, str]:
    a = f"(({d})/6371000.0)"
    la = f"asin(sin(radians({lat}))*cos({a})+cos(radians({lat}))*sin({a})*cos(radians({brg})))"
    lo = f"radians({lon})+atan2(sin(radians({brg}))*sin({a})*cos(radians({lat})),cos({a})-sin(radians({lat}))*sin({la}))"
    return f"degrees({la})", f"degrees({lo})"


_la, _lo = dest("latitude", "longitude", wrap("bearing-hbw/2+hbw*i/8.0"), "500.0")
ORACLE["sector_polygon"] = sql(
    f"""SELECT cell_name, CAST(11 AS BIGINT) AS n_points, round(least(min(lo),min(longitude)),6) AS min_lon,
    round(greatest(max(lo),max(longitude)),6) AS max_lon, round(least(min(la),min(latitude)),6) AS min_lat,
    round(greatest(max(la),max(latitude)),6) AS max_lat
    FROM (SELECT cell_name, latitude, longitude, {_la} AS la, {_lo} AS lo FROM gis, range(9) t(i)) GROUP BY cell_name""", "gis")
_la, _lo = dest("latitude", "longitude", "bearing", "1000.0+cell_key")
ORACLE["destination_point"] = sql(f"SELECT cell_name, round({_lo},7) AS lon, round({_la},7) AS lat FROM gis", "gis")
ORACLE["name_normalisers"] = sql(
    r"""SELECT cell_name, band AS band_norm, 'N78' AS nr_norm, 'LTE' AS technology,
    substr(cell_name,1,length(cell_name)-2) AS site_by_suffix, substr(cell_name,1,5) AS site_by_prefix,
    regexp_extract(cell_name,'^(S\d+)[A-Z](\d)$',1) AS site, regexp_extract(cell_name,'^(S\d+)[A-Z](\d)$',2) AS sector,
    CASE WHEN cell_name LIKE '%L_' THEN 'L800' WHEN cell_name LIKE '%H_' THEN 'L1800' END AS band_from_name,
    CASE WHEN pci%2=0 THEN 'y' ELSE 'n' END AS flag,
    CASE WHEN pci%3=0 THEN 'N' WHEN pci%3=1 THEN 'Y' ELSE 'N/A' END AS relation, pci*40 BETWEEN 0 AND 503 AS pci_ok FROM gis""", "gis")

# --- enrichment ---

ORACLE["bin_aggregate"] = """
SELECT ix, iy, cell_name, round(r,4) AS avg_rsrp, round(q,4) AS avg_rsrq, event_count,
  CASE WHEN 50/pow(10,q/10)-1 > 0 THEN round(10*log10(1/(50/pow(10,q/10)-1))+45.0,4) END AS avg_sinr
FROM (SELECT CAST(124795+l_partkey%50 AS INTEGER) AS ix, CAST(103315+l_partkey//50 AS INTEGER) AS iy, 'C'||l_suppkey AS cell_name,
  sum((-70.0-400.0*l_discount)*l_quantity)/sum(l_quantity) AS r, sum((-5.0-100.0*l_tax)*l_quantity)/sum(l_quantity) AS q,
  sum(l_quantity) AS event_count FROM lineitem GROUP BY ALL)"""
_kpi = ["RRC_Interval_Sum_RSRP", "RRC_Interval_Sum_RSRQ", "RRC_Interval_Sum_SINR", "RRC_Interval_Coverage_Samples",
        "RRC_Interval_Quality_Samples", "RRC_Interval_SINR_Samples", "RRC_Sum_RSRP", "RRC_Sum_RSRQ", "RRC_Sum_SINR",
        "RRC_Coverage_Samples", "RRC_Quality_Samples", "RRC_SINR_Samples"]
_k = ", ".join(f"max(CASE WHEN k={i} THEN v END) AS k{i}" for i in range(12))
ORACLE["kpi_pivot"] = f"""
SELECT cell_name, grid, round(coalesce(k0/nullif(k3,0),k6/nullif(k9,0)),4) AS avg_rsrp, round(coalesce(k1/nullif(k4,0),k7/nullif(k10,0)),4) AS avg_rsrq,
  round(coalesce(k2/nullif(k5,0),k8/nullif(k11,0)),4) AS avg_sinr,
  {'+'.join(f'coalesce(k{i},0)' for i in (3, 4, 5, 9, 10, 11))} AS event_count
FROM (SELECT cell_name, grid, {_k} FROM (SELECT 'C'||(l_suppkey%50) AS cell_name, 'G'||(l_partkey%40) AS grid,
  (l_orderkey+l_linenumber)%14 AS k, l_quantity AS v FROM lineitem) WHERE k<12 GROUP BY cell_name, grid)"""
cte("tot", """
SELECT *, event_count/nullif(cell_event_count,0)::DOUBLE AS perc_cell_events, event_count/nullif(grid_event_count,0)::DOUBLE AS perc_grid_events FROM (
SELECT ix, iy, cell_name, event_count, avg_rsrp, avg_rsrq, avg_sinr, distance_to_cell,
  CAST(sum(event_count) OVER g AS BIGINT) AS grid_event_count, avg(avg_rsrp) OVER g AS avg_rsrp_grid, avg(avg_rsrq) OVER g AS avg_rsrq_grid,
  avg(avg_sinr) OVER g AS avg_sinr_grid, CAST(sum(event_count) OVER c AS BIGINT) AS cell_event_count, avg(avg_rsrp) OVER c AS avg_rsrp_cell,
  avg(avg_rsrq) OVER c AS avg_rsrq_cell, avg(avg_sinr) OVER c AS avg_sinr_cell
FROM cov WINDOW g AS (PARTITION BY ix, iy), c AS (PARTITION BY cell_name))""", "cov")
ORACLE["grid_cell_totals"] = sql("SELECT " + ", ".join(
    ["ix", "iy", "cell_name", "event_count", "grid_event_count", "cell_event_count"] +
    [f"round({c}+1e-9,6) AS {c}" for c in ("avg_rsrp", "avg_rsrq", "avg_sinr", "avg_rsrp_grid", "avg_rsrq_grid", "avg_sinr_grid",
     "avg_rsrp_cell", "avg_rsrq_cell", "avg_sinr_cell", "perc_cell_events", "perc_grid_events")]) + " FROM tot", "tot")
ORACLE["located_bins"] = sql(
    f"""SELECT ix, iy, cell_name, round(latitude,4) AS latitude, round(longitude,4) AS longitude, round(clat,4) AS cell_lat,
    round(clon,4) AS cell_lon, bearing, round(d,4) AS distance_to_cell, round(a,4) AS cell_angle_to_grid, round({adiff('a','bearing')},4) AS grid_bearing_diff
    FROM (SELECT *, {hav('clat','clon','latitude','longitude')} AS d, {bearing('clat','clon','latitude','longitude')} AS a FROM cov0)
    WHERE d <= 32000""", "cov0")
cte("dm", """SELECT *, distance_to_cell/cell_max_distance_to_cell AS perc_cell_max_dist FROM (SELECT ix, iy, cell_name, distance_to_cell,
  max(distance_to_cell) OVER (PARTITION BY ix, iy) AS grid_max_distance_to_cell, min(distance_to_cell) OVER (PARTITION BY ix, iy) AS grid_min_distance_to_cell,
  max(distance_to_cell) OVER (PARTITION BY cell_name) AS cell_max_distance_to_cell FROM cov)""", "cov")
ORACLE["distance_metrics"] = sql("SELECT * REPLACE (round(perc_cell_max_dist,6) AS perc_cell_max_dist) FROM dm", "dm")
ORACLE["rsrp_share"] = sql(
    """SELECT ix, iy, cell_name, round(avg_rsrp+1e-9,3) AS avg_rsrp, round(p+1e-9,3) AS perc_grid_events, round(sum(p*avg_rsrp) OVER (PARTITION BY ix,iy)+1e-9,3) AS avg_rsrp_grid,
    round(avg(avg_rsrp) OVER (PARTITION BY cell_name)+1e-9,3) AS avg_rsrp_cell
    FROM (SELECT *, round((150.0+avg_rsrp)/CAST(sum(CAST(150.0+avg_rsrp AS DECIMAL(20,6))) OVER (PARTITION BY ix,iy) AS DOUBLE),4) AS p FROM cov)""", "cov")
ORACLE["dominance_tiers"] = sql(
    """SELECT ix, iy, cell_name, CASE WHEN perc_grid_events>=.3 THEN 'dominant' WHEN perc_grid_events<=.02 THEN 'interferer' ELSE 'contributor' END AS dominance,
    CASE WHEN perc_cell_max_dist>=.95 THEN 'tier_4' WHEN perc_cell_max_dist>=.7 THEN 'tier_3' WHEN perc_cell_max_dist>=.35 THEN 'tier_2' ELSE 'tier_1' END AS tier
    FROM tot JOIN dm USING (ix, iy, cell_name)""", "tot", "dm")
ORACLE["same_pci_count"] = sql(
    """SELECT ix, iy, cell_name, pci, count(*) OVER (PARTITION BY ix, iy) AS cell_count, count(*) OVER (PARTITION BY ix, iy, pci) AS same_pci_cell_count
    FROM cov JOIN gis USING (cell_name)""", "cov", "gis")
ORACLE["clamp_metrics"] = sql(
    """SELECT *, max(distance_to_cell) OVER (PARTITION BY cell_name) AS cell_max_distance_to_cell FROM (
    SELECT ix, iy, cell_name, round(least(greatest(-abs(avg_rsrp*1.5),-144),-44),4) AS avg_rsrp, round(least(greatest(-abs(-avg_rsrq*2),-24),0),4) AS avg_rsrq,
    round(least(greatest(avg_sinr*3,-20),30),4) AS avg_sinr, distance_to_cell FROM cov WHERE distance_to_cell<=35000)""", "cov")


def att(theta: str, tilt: str) -> str:
    return f"least(12.0*pow((({theta})-({tilt}))/6.5,2),30.0)"


def att_change(d: str, tilt: str, h: str, delta: float) -> str:
    th = f"degrees(atan2({h},{d}))"
    return f"({att(th, f'({tilt})+({delta})')}-{att(th, tilt)})"


_m = ""
for _s, _d in (("1_dt", 1.0), ("2_dt", 2.0), ("1_ut", -1.0), ("2_ut", -2.0)):
    _x = f"d*pow(10.0,-{att_change('d', 'tilt_elc+tilt_mech', 'antenna_height', _d)}/35.0)"
    if _d < 0:
        _x = f"CASE WHEN tilt_elc+tilt_mech=0 THEN d ELSE {_x} END"
    _m += f", {_x} AS max_dist_{_s}"
_n = ", ".join(
    [f"greatest((d-max_dist_{s})/d*100,0.0) AS perc_dist_reduct_{s}" for s in ("1_dt", "2_dt")] +
    [f"greatest((max_dist_{s}-d)/max_dist_{s}*100,0.0) AS perc_dist_inc_{s}" for s in ("1_ut", "2_ut")])
cte("tdm", f"""SELECT *, {_n} FROM (SELECT *{_m} FROM (
  SELECT cell_name, max(distance_to_cell) AS dmax, quantile_cont(distance_to_cell,0.98) AS d, max(tilt_elc) AS tilt_elc, max(tilt_mech) AS tilt_mech,
  max(antenna_height) AS antenna_height FROM cov JOIN gis USING (cell_name) GROUP BY cell_name))""", "cov", "gis")
_pc = ["perc_dist_reduct_1_dt", "perc_dist_reduct_2_dt", "perc_dist_inc_1_ut", "perc_dist_inc_2_ut"]
ORACLE["tilt_distance_metrics"] = sql("SELECT cell_name, dmax AS cell_max_distance_to_cell_all_data, round(d,4) AS cell_max_distance_to_cell, tilt_elc, tilt_mech, antenna_height, " +
    ", ".join(f"round({c},4) AS {c}" for c in _pc + [f"max_dist_{s}" for s in ("1_dt", "2_dt", "1_ut", "2_ut")]) + " FROM tdm", "tdm")
_sc = ""
for _s, _d, _c, _o in (("1_dt", 1.0, _pc[0], "1_degree_downtilt"), ("2_dt", 2.0, _pc[1], "2_degree_downtilt"),
                       ("1_ut", -1.0, _pc[2], "1_degree_uptilt"), ("2_ut", -2.0, _pc[3], "2_degree_uptilt")):
    _v = f"CASE WHEN {_c}=0 THEN avg_rsrp ELSE avg_rsrp-{att_change('distance_to_cell', 'tilt_elc+tilt_mech', 'antenna_height', _d)} END"
    _sc += f", CASE WHEN distance_to_cell>0 AND distance_to_cell<=max_dist_{_s} THEN round(least(greatest({_v},-140.0),-44.0),4) END AS avg_rsrp_{_o}"
cte("scen", f"SELECT ix, iy, cell_name, distance_to_cell{_sc} FROM cov JOIN tdm USING (cell_name)", "cov", "tdm")
ORACLE["tilt_rsrp_scenarios"] = sql("SELECT * EXCLUDE (distance_to_cell) FROM scen", "scen")
ORACLE["tilt_scenario_tables"] = sql(" UNION ALL ".join(
    f"""SELECT 'avg_rsrp_{o}' AS scenario, cell_name, count(*) AS n, round(avg(avg_rsrp_{o}),3) AS mean_rsrp, max(distance_to_cell) AS reach
    FROM scen WHERE avg_rsrp_{o} IS NOT NULL GROUP BY cell_name""" for o in ("1_degree_downtilt", "2_degree_downtilt", "1_degree_uptilt", "2_degree_uptilt")), "scen")
cte("holes", """SELECT ix, iy, cell_name, latitude, longitude, CASE WHEN (cell_key+ix+iy)%5<>0 THEN avg_rsrp END AS avg_rsrp,
  greatest(distance_to_cell,1.0) AS rounded_d FROM cov""", "cov")
cte("holes_d", f"""SELECT h.ix, h.iy, h.cell_name, h.latitude, h.longitude, h.avg_rsrp,
  greatest({hav('h.latitude','h.longitude','g.latitude','g.longitude')},1.0) AS d, g.bearing AS az, g.latitude AS clat, g.longitude AS clon
  FROM holes h JOIN gis g USING (cell_name)""", "holes", "gis")
_w = f"pow(greatest({hav('t.latitude','t.longitude','b.latitude','b.longitude')},1.0),-2)"
ORACLE["rsrp_idw_fill"] = sql(
    f"""SELECT t.ix, t.iy, t.cell_name, round(CASE WHEN n>=3 THEN idw WHEN n>=2 AND a IS NOT NULL THEN a*log10(d)+b0 ELSE (SELECT regr_slope(avg_rsrp,log10(d)) FROM holes_d)*log10(d)+(SELECT regr_intercept(avg_rsrp,log10(d)) FROM holes_d) END,3) AS avg_rsrp,
    CASE WHEN n>=3 THEN 'same_cell_idw' WHEN n>=2 AND a IS NOT NULL THEN 'cell_model' ELSE 'global_model' END AS pred_source,
    CASE WHEN n>=2 THEN n ELSE 0 END AS n_bins_used
    FROM (SELECT t.ix, t.iy, t.cell_name, t.d, sum({_w}*b.avg_rsrp)/sum({_w}) AS idw, count(b.ix) AS n, regr_slope(b.avg_rsrp,log10(b.d)) AS a, regr_intercept(b.avg_rsrp,log10(b.d)) AS b0
      FROM holes_d t LEFT JOIN (SELECT * FROM holes_d WHERE avg_rsrp IS NOT NULL) b ON t.cell_name=b.cell_name WHERE t.avg_rsrp IS NULL GROUP BY t.ix, t.iy, t.cell_name, t.d) t
    UNION ALL SELECT ix, iy, cell_name, round(avg_rsrp,3), NULL, 0 FROM holes WHERE avg_rsrp IS NOT NULL""", "holes", "holes_d")

# --- relation enrichment ---

cte("tgis", "SELECT *, CASE WHEN cell_key%3=0 THEN 'nsa' ELSE 'lte' END AS tech FROM gis", "gis")
cte("imp", f"""SELECT *, CASE WHEN CAST(total AS DOUBLE)<>0 THEN round(traffic_data/total*100,2) ELSE 0 END AS pct FROM (
  SELECT r.cell_name, r.to_cell_name, CASE WHEN x.site=y.site THEN 'y' ELSE 'n' END AS co_site,
  CASE WHEN {adiff('x.bearing','y.bearing')}<=20 THEN 'y' ELSE 'n' END AS co_sectored, x.tech||'_'||x.band AS tech_band, y.tech||'_'||y.band AS impact_tech_band,
  y.tech AS impact_tech, r.traffic_data, sum(r.traffic_data) OVER (PARTITION BY r.cell_name) AS total, x.latitude AS a, x.longitude AS b, x.bearing AS xb,
  y.latitude AS c, y.longitude AS d, y.bearing AS yb
  FROM rel r JOIN tgis x ON r.cell_name=x.cell_name JOIN tgis y ON r.to_cell_name=y.cell_name)""", "rel", "tgis")
ORACLE["impact_enriched"] = sql(
    "SELECT cell_name, to_cell_name, co_site, co_sectored, tech_band, impact_tech_band, traffic_data, total AS total_cell_traffic_data, pct AS relation_impact_pct FROM imp", "imp")


def _share(cond: str) -> str:
    return f"round(coalesce(sum(CASE WHEN {cond} THEN traffic_data END),0)/sum(traffic_data)*100,2)"


ORACLE["impact_tech_shares"] = sql("SELECT cell_name, sum(traffic_data) AS total_cell_traffic_data, " + ", ".join(
    [f"{_share(f'impact_tech={t!r}')} AS total_{t}_impact_pct" for t in ("gsm", "umts", "lte", "nsa", "sa")] +
    [f"{_share(f'impact_tech_band={t!r}')} AS total_{t}_impact_pct" for t in ("lte_L800", "nsa_L1800")]) + " FROM imp GROUP BY cell_name", "imp")
ORACLE["neighbour_distances"] = sql(
    f"""WITH z AS (SELECT *, {hav('a','b','c','d')} AS dist, {bearing('a','b','c','d')} AS f, {bearing('c','d','a','b')} AS g FROM imp)
    SELECT cell_name, to_cell_name, round(dist,3) AS distance, round(f,3) AS angle_cell_to_impact, round(g,3) AS angle_impact_to_cell,
    round({adiff('f','xb')},3) AS cell_azimuth_diff, round({adiff('g','yb')},3) AS impact_azimuth_diff, round(m,3) AS max_neigh_distance, round(q,3) AS median_neigh_distance
    FROM z LEFT JOIN (SELECT cell_name, max(dist) AS m FROM z WHERE pct>=2 AND dist<=30000 GROUP BY 1) USING (cell_name)
    LEFT JOIN (SELECT cell_name, quantile_cont(dist,.5) AS q FROM z WHERE pct>=2 AND dist<=30000 AND co_site='n' GROUP BY 1) USING (cell_name)""".replace("WITH z AS (", "SELECT * FROM (WITH z AS (") + ")", "imp")
ORACLE["site_tech_bands"] = sql(
    "SELECT site, string_agg(DISTINCT tech||'_'||band, ',' ORDER BY tech||'_'||band) AS tech_bands FROM tgis GROUP BY site", "tgis")

# --- environment, competition, over- and undershooting ---

cte("sites", "SELECT round(latitude,6) AS y, round(longitude,6) AS x, min((latitude, longitude)) AS p FROM gis GROUP BY 1, 2", "gis")
cte("spacing", """SELECT y, x, avg(km) AS km FROM (SELECT y, x, km, row_number() OVER (PARTITION BY y, x ORDER BY km) AS n FROM (
  SELECT a.y, a.x, 111.0*sqrt(pow(b.y-a.y,2)+pow(b.x-a.x,2)) AS km,
    row_number() OVER (PARTITION BY a.y, a.x ORDER BY sqrt(pow(b.y-a.y,2)+pow(b.x-a.x,2))) AS r FROM sites a, sites b) WHERE r BETWEEN 2 AND 20 AND km>=0.1) WHERE n<=3 GROUP BY y, x""", "sites")
cte("env0", """SELECT cell_name, round(coalesce(km,2.0),3) AS intersite_distance_km, CASE WHEN coalesce(km,2.0)<=1 THEN 'URBAN' WHEN coalesce(km,2.0)<=3 THEN 'SUBURBAN' ELSE 'RURAL' END AS environment
  FROM gis LEFT JOIN spacing ON round(latitude,6)=y AND round(longitude,6)=x""", "gis", "spacing")
ORACLE["site_environment"] = sql("SELECT * FROM env0", "env0")
cte("env", """SELECT cell_name, round(coalesce(km,2.0),3) AS intersite_distance_km, CASE WHEN coalesce(km,2.0)<=1.25 THEN 'URBAN' WHEN coalesce(km,2.0)<=1.4 THEN 'SUBURBAN' ELSE 'RURAL' END AS environment
  FROM gis LEFT JOIN spacing ON round(latitude,6)=y AND round(longitude,6)=x""", "gis", "spacing")
cte("p90", "SELECT ix, iy, band, quantile_cont(avg_rsrp,0.9) AS p90, max(distance_to_cell) AS gmax FROM cov GROUP BY ix, iy, band", "cov")
cte("comp", """SELECT ix, iy, band, max(p90) AS p90, count(DISTINCT cell_name) AS total_cells, count(DISTINCT CASE WHEN round(p90-avg_rsrp,9)<=7.5 THEN cell_name END) AS competing_cells,
  count(CASE WHEN round(p90-avg_rsrp,9)<=7.5 THEN 1 END) AS competing_rows, CAST(sum(event_count) AS BIGINT) AS grid_total_traffic
  FROM cov JOIN p90 USING (ix, iy, band) GROUP BY ix, iy, band""", "cov", "p90")
ORACLE["competition_counts"] = sql("SELECT * REPLACE (round(p90,4) AS p90) FROM comp", "comp")
cte("covo", "SELECT * FROM cov WHERE avg_rsrp BETWEEN -140 AND -30", "cov")
cte("p90o", "SELECT ix, iy, band, quantile_cont(avg_rsrp,0.9) AS p90, max(distance_to_cell) AS gmax FROM covo GROUP BY ix, iy, band", "covo")
cte("beam", "SELECT *, distance_to_cell AS d FROM covo WHERE grid_bearing_diff<=90", "covo")
cte("edge", """SELECT b.*, e AS edge_distance_m FROM beam b JOIN (SELECT cell_name, round(quantile_cont(d,0.85),6) AS e FROM beam GROUP BY 1) USING (cell_name) WHERE d>=e""", "beam")
ORACLE["edge_bins"] = sql("SELECT ix, iy, cell_name, d AS distance_m, round(edge_distance_m,4) AS edge_distance_m FROM edge", "edge")


def over_metrics(name: str, edge: str) -> None:
    cte(name, f"""SELECT a.*, coalesce(edge_grids,0) AS edge_grids, coalesce(avg_edge_rsrp,-140.0) AS avg_edge_rsrp FROM
  (SELECT cell_name, max(distance_to_cell) AS max_distance_m, count(DISTINCT (ix,iy)) AS total_grids, quantile_cont(avg_rsrp,0.85) AS cell_max_rsrp FROM covo GROUP BY 1) a
  LEFT JOIN (SELECT cell_name, count(DISTINCT (ix,iy)) AS edge_grids, avg(avg_rsrp) AS avg_edge_rsrp FROM {edge} GROUP BY 1) USING (cell_name)""", "covo", edge)


over_metrics("om", "edge")
ORACLE["cell_metrics"] = sql("""SELECT cell_name, max_distance_m, total_grids, round(cell_max_rsrp+1e-9,3) AS cell_max_rsrp, edge_grids, round(avg_edge_rsrp+1e-9,3) AS avg_edge_rsrp FROM om""", "om")
cte("ob", """SELECT x.*, competing_cells, grid_total_traffic, event_count/grid_total_traffic::DOUBLE AS cell_traffic_pct, d/gmax AS relative_reach, cell_max_rsrp FROM
  (SELECT e.*, p90, gmax FROM edge e JOIN p90o USING (ix, iy, band)) x JOIN
  (SELECT ix, iy, band, count(DISTINCT CASE WHEN round(p90-avg_rsrp,9)<=7.5 THEN cell_name END) AS competing_cells, CAST(sum(event_count) AS BIGINT) AS grid_total_traffic
   FROM edge JOIN p90o USING (ix, iy, band) GROUP BY 1,2,3) USING (ix, iy, band) JOIN om USING (cell_name)
  WHERE competing_cells>=2 AND event_count/grid_total_traffic::DOUBLE<=0.25 AND d/gmax>=0.5 AND avg_rsrp<=round(cell_max_rsrp-10,6)""", "edge", "p90o", "om")
ORACLE["overshoot_bins"] = sql("""SELECT ix, iy, cell_name, competing_cells, grid_total_traffic, round(cell_traffic_pct,4) AS cell_traffic_pct,
  round(relative_reach,4) AS relative_reach, round(p90,4) AS p90_rsrp_in_grid FROM ob""", "ob")


def over_cells(tag: str, metrics: str, bins: str, where: str, thr: str = "7.5") -> str:
    """Building blocks from flagged bins to scored cells; returns the last name."""
    cte(f"oc{tag}", f"""SELECT m.*, coalesce(n,0) AS overshooting_grids, coalesce(n,0)/total_grids::DOUBLE AS percentage_overshooting, tilt_elc, tilt_mech, antenna_height
  FROM {metrics} m LEFT JOIN (SELECT cell_name, count(DISTINCT (ix,iy)) AS n FROM {bins} GROUP BY 1) USING (cell_name) JOIN gis USING (cell_name) WHERE {where}""", metrics, bins, "gis")

    def reach(n):
        return f"least(max_distance_m, max_distance_m*pow(10.0,-{att_change('max_distance_m','tilt_elc','antenna_height',n)}/35.0))"

    def after(d, n):
        return f"(avg_rsrp-greatest({att_change(d,'tilt_elc','antenna_height',n)},0.0))"

    cte(f"ot{tag}", f"""SELECT * FROM oc{tag} JOIN (SELECT cell_name, count(*) AS nb,
    count(CASE WHEN d>{reach(1.0)} OR p90-{after('d',1.0)}>{thr} THEN 1 END) AS grids_resolved_1deg,
    count(CASE WHEN d>{reach(2.0)} OR p90-{after('d',2.0)}>{thr} THEN 1 END) AS grids_resolved_2deg
    FROM (SELECT ix, iy, cell_name, d, avg_rsrp, p90 FROM {bins}) JOIN oc{tag} USING (cell_name) GROUP BY 1) USING (cell_name)
    JOIN (SELECT cell_name, coalesce(max(CASE WHEN {after('distance_to_cell',1.0)}>=-110 THEN distance_to_cell END),0) AS new_max_distance_1deg_m,
    coalesce(max(CASE WHEN {after('distance_to_cell',2.0)}>=-110 THEN distance_to_cell END),0) AS new_max_distance_2deg_m
    FROM covo JOIN oc{tag} USING (cell_name) GROUP BY 1) USING (cell_name)""", f"oc{tag}", bins, "covo")
    cte(f"os{tag}", f"""SELECT *, CASE WHEN recommended_tilt_change=1 THEN grids_resolved_1deg ELSE grids_resolved_2deg END AS removed_interference_grids,
    least(greatest(0.30*least(greatest((overshooting_grids-b5)/greatest(b95-b5,1e-9),0),1)+0.25*percentage_overshooting
    +0.20*least(greatest((max_distance_m-4000)/31000.0,0),1)+0.15*least(greatest((avg_edge_rsrp+70)/-50.0,0),1)
    +0.10*least(greatest((total_grids-t5)/greatest(t95-t5,1e-9),0),1),0),1) AS severity_score
    FROM (SELECT *, grids_resolved_1deg/nb::DOUBLE AS resolution_1deg_pct, grids_resolved_2deg/nb::DOUBLE AS resolution_2deg_pct,
      CAST(CASE WHEN grids_resolved_1deg/nb::DOUBLE>=0.5 THEN 1 ELSE 2 END AS BIGINT) AS recommended_tilt_change FROM ot{tag}),
    (SELECT quantile_cont(overshooting_grids,0.05) AS b5, quantile_cont(overshooting_grids,0.95) AS b95, quantile_cont(total_grids,0.05) AS t5,
      quantile_cont(total_grids,0.95) AS t95 FROM ot{tag})""", f"ot{tag}")
    return f"os{tag}"


def sev(x: str, op: str = ">=") -> str:
    return f"CASE WHEN {x}{op}0.8 THEN 'CRITICAL' WHEN {x}{op}0.6 THEN 'HIGH' WHEN {x}{op}0.4 THEN 'MEDIUM' WHEN {x}{op}0.2 THEN 'LOW' ELSE 'MINIMAL' END"


OVER_COLS = f"""cell_name, max_distance_m, total_grids, round(cell_max_rsrp+1e-9,3) AS cell_max_rsrp, edge_grids, round(avg_edge_rsrp+1e-9,3) AS avg_edge_rsrp,
  overshooting_grids, round(percentage_overshooting+1e-9,3) AS percentage_overshooting, tilt_mech, tilt_elc, antenna_height AS antenna_height_m,
  grids_resolved_1deg, grids_resolved_2deg, new_max_distance_1deg_m, new_max_distance_2deg_m, round(resolution_1deg_pct+1e-9,3) AS resolution_1deg_pct,
  round(resolution_2deg_pct+1e-9,3) AS resolution_2deg_pct, recommended_tilt_change, removed_interference_grids,
  overshooting_grids-removed_interference_grids AS new_interference_grids, round((overshooting_grids-removed_interference_grids)/total_grids::DOUBLE+1e-9,3) AS new_interference_pct,
  round(removed_interference_grids/overshooting_grids::DOUBLE*100+1e-9,3) AS interference_reduction_pct, round(severity_score+1e-9,3) AS severity_score,
  {sev('severity_score','>')} AS severity_category"""
_n = over_cells("s", "om", "ob", "max_distance_m>=4000 AND n>=5 AND n/total_grids::DOUBLE>=0.02")
ORACLE["overshoot_cells"] = sql(f"SELECT {OVER_COLS} FROM {_n}", _n)
# class limits: edge share, competing cells, traffic share, reach, cell distance
cte("lim", """SELECT * FROM (VALUES ('URBAN',0.88,3,0.25,0.70,1500.0),('SUBURBAN',0.85,2,0.28,0.68,3500.0),('RURAL',0.82,2,0.30,0.65,4000.0)) t(environment,eq,mc,mt,mr,md)""")
cte("edgee", """SELECT b.*, e AS edge_distance_m FROM beam b JOIN (SELECT cell_name, round(CASE environment WHEN 'URBAN' THEN quantile_cont(d,0.88) WHEN 'SUBURBAN' THEN quantile_cont(d,0.85) ELSE quantile_cont(d,0.82) END,6) AS e
  FROM beam JOIN env USING (cell_name) GROUP BY cell_name, environment) USING (cell_name) WHERE d>=e""", "beam", "env")
over_metrics("ome0", "edgee")
cte("ome", "SELECT * FROM ome0 JOIN env USING (cell_name) JOIN lim USING (environment)", "ome0", "env", "lim")
cte("obe", """SELECT x.*, environment, competing_cells, event_count/grid_total_traffic::DOUBLE AS cell_traffic_pct, d/gmax AS relative_reach FROM
  (SELECT e.*, p90, gmax FROM edgee e JOIN p90o USING (ix, iy, band)) x JOIN
  (SELECT ix, iy, band, count(DISTINCT CASE WHEN round(p90-avg_rsrp,9)<=8.5 THEN cell_name END) AS competing_cells, CAST(sum(event_count) AS BIGINT) AS grid_total_traffic
   FROM covo JOIN p90o USING (ix, iy, band) GROUP BY 1,2,3) USING (ix, iy, band) JOIN ome USING (cell_name)
  WHERE competing_cells>=mc AND event_count/grid_total_traffic::DOUBLE<=mt AND d/gmax>=mr AND avg_rsrp<=round(cell_max_rsrp-10,6)""", "edgee", "p90o", "covo", "ome")
ORACLE["overshoot_env_bins"] = sql("""SELECT ix, iy, cell_name, environment, competing_cells, round(cell_traffic_pct,4) AS cell_traffic_pct, round(relative_reach,4) AS relative_reach FROM obe""", "obe")
_n = over_cells("e", "ome", "obe", "max_distance_m>=md AND n>=5 AND n/total_grids::DOUBLE>=0.02")
ORACLE["overshoot_env_cells"] = sql(f"SELECT {OVER_COLS}, environment FROM {_n}", _n)

cte("ust", "SELECT cell_name, max(distance_to_cell) AS max_distance_m, CAST(sum(event_count) AS BIGINT) AS total_traffic, count(*) AS total_grids FROM cov WHERE distance_to_cell>0 GROUP BY 1", "cov")


def under(tag: str, max_d: str, max_n: str, max_i: str, cov1: str, d1: str, d2: str, n: str, keep: bool, env: bool) -> str:
    src = "ust JOIN env USING (cell_name)" if env else "ust"
    cte(f"ub{tag}", f"SELECT ix, iy, cell_name, competing_rows FROM (SELECT * FROM {src} WHERE max_distance_m<={max_d}) JOIN (SELECT ix, iy, band, cell_name FROM cov) USING (cell_name) JOIN comp USING (ix, iy, band) WHERE competing_rows>{max_n}",
        "ust", "comp", "cov", *(["env"] if env else []))
    cte(f"uc{tag}", f"SELECT *, interference_grids/total_grids::DOUBLE AS interference_percentage FROM (SELECT u.*, coalesce(k,0) AS interference_grids FROM (SELECT * FROM {src} WHERE max_distance_m<={max_d}) u LEFT JOIN (SELECT cell_name, count(*) AS k FROM ub{tag} GROUP BY 1) USING (cell_name))",
        f"ub{tag}", "ust", *(["env"] if env else []))

    def up(k):
        return f"CASE WHEN tilt<=0 THEN max_distance_m ELSE greatest(max_distance_m, max_distance_m*pow(10.0,-{att_change('max_distance_m','tilt','antenna_height',-k)}/(10.0*{n}))) END"

    keepc = " OR tilt<=0" if keep else ""
    w2 = f"((n2-max_distance_m)/max_distance_m>=0.10 AND n2-max_distance_m>={d2})"
    w1 = f"((n1-max_distance_m)/max_distance_m>={cov1} AND n1-max_distance_m>={d1})"
    cte(f"uu{tag}", f"""SELECT *, new_max_distance_m-max_distance_m AS distance_increase_m, CAST(round_even(total_grids*coverage_increase_percentage,0) AS BIGINT) AS new_coverage_grids FROM (
  SELECT *, CAST(CASE WHEN {w2} THEN 2 WHEN {w1} THEN 1 ELSE 0 END AS BIGINT) AS recommended_uptilt_deg, CASE WHEN {w2} THEN n2 WHEN {w1} THEN n1 ELSE max_distance_m END AS new_max_distance_m,
  CASE WHEN {w2} THEN (n2-max_distance_m)/max_distance_m WHEN {w1} THEN (n1-max_distance_m)/max_distance_m ELSE 0.0 END AS coverage_increase_percentage
  FROM (SELECT *, {up(1.0)} AS n1, {up(2.0)} AS n2 FROM (SELECT u.*, tilt_mech, tilt_elc, antenna_height, tilt_mech+tilt_elc AS tilt FROM uc{tag} u JOIN gis USING (cell_name)
    WHERE total_traffic>=200 AND interference_percentage<={max_i}))) WHERE recommended_uptilt_deg>0{keepc}""", f"uc{tag}", "gis")

    def sp(c, k):
        return f"CASE WHEN {k}95>{k}5 THEN least(greatest(({c}-{k}5)/({k}95-{k}5),0),1) ELSE 0.5 END"

    extra = ", environment, intersite_distance_km" if env else ""
    cte(f"us{tag}", f"""SELECT cell_name, max_distance_m, total_grids, interference_grids, round(interference_percentage,4) AS interference_percentage, total_traffic, tilt_mech, tilt_elc,
  recommended_uptilt_deg, round(new_max_distance_m,4) AS new_max_distance_m, round(coverage_increase_percentage,4) AS coverage_increase_percentage, total_grids AS current_coverage_grids,
  max_distance_m AS current_distance_m, round(distance_increase_m,4) AS distance_increase_m, new_coverage_grids, total_grids+new_coverage_grids AS total_coverage_after_uptilt,
  round(s,4) AS severity_score, {sev('s')} AS severity_category, CASE WHEN tilt<=0 THEN 'Cell at minimum tilt (0 deg) - investigate physical build' END AS physical_constraint_note{extra}
  FROM (SELECT *, least(greatest(0.30*least(greatest(coverage_increase_percentage/0.5,0),1)+0.25*{sp('new_coverage_grids','g')}+0.20*(1-interference_percentage)+0.15*{sp('distance_increase_m','d')}+0.10*{sp('total_grids','t')},0),1) AS s
  FROM uu{tag}, (SELECT quantile_cont(new_coverage_grids,0.05) AS g5, quantile_cont(new_coverage_grids,0.95) AS g95, quantile_cont(distance_increase_m,0.05) AS d5,
  quantile_cont(distance_increase_m,0.95) AS d95, quantile_cont(total_grids,0.05) AS t5, quantile_cont(total_grids,0.95) AS t95 FROM uu{tag}))""", f"uu{tag}")
    return f"us{tag}"


_u = under("s", "15000", "3", "0.9", "0.05", "50", "100", "3.5", False, False)
ORACLE["undershoot_candidates"] = sql("SELECT * REPLACE (round(interference_percentage,6) AS interference_percentage) FROM ucs", "ucs")
ORACLE["undershoot_bins"] = sql("SELECT * FROM ubs", "ubs")
ORACLE["undershoot_uptilt"] = sql(f"SELECT * FROM {_u}", _u)


def by_env(u, s, r) -> str:
    return f"(CASE environment WHEN 'URBAN' THEN {u} WHEN 'SUBURBAN' THEN {s} ELSE {r} END)"


_e = under("e", by_env(6500, 7000, 12000), by_env(4, 3, 2), "0.9", "0.05", by_env(25, 50, 100), by_env(50, 100, 200), by_env("4.0", "3.5", "3.0"), True, True)
ORACLE["undershoot_env"] = sql(f"SELECT * FROM {_e}", _e)
ORACLE["undershoot_compare"] = sql(f"""SELECT *, environment_aware-standard AS difference, CASE WHEN standard=0 THEN 0 ELSE round((environment_aware-standard)/standard::DOUBLE*100,4) END AS pct_change,
  round(standard/cells::DOUBLE*100,4) AS standard_rate_pct, round(environment_aware/cells::DOUBLE*100,4) AS environment_rate_pct FROM (
  SELECT coalesce(environment,'Total') AS environment, count(*) AS cells, count(s.cell_name) AS standard, count(e.cell_name) AS environment_aware
  FROM env LEFT JOIN (SELECT cell_name FROM {_u}) s USING (cell_name) LEFT JOIN (SELECT cell_name FROM {_e}) e USING (cell_name) GROUP BY GROUPING SETS ((environment),()))""", "env", _u, _e)

# --- identity planning and feeders ---

cte("reld", "SELECT * REPLACE (CASE WHEN weight<=4 AND pci+to_pci<40 THEN 0.0 ELSE weight END AS weight) FROM rel WHERE cell_name<>to_cell_name", "rel")


def network(tag: str, source: str) -> None:
    cte(f"e0{tag}", f"""SELECT a.cell_name AS s, a.to_cell_name AS n, a.weight AS out_ho, coalesce(b.weight,0.0) AS in_ho, a.weight+coalesce(b.weight,0.0) AS act,
  a.distance, a.intra_site='y' AS intra, a.neighbor_relation AS rl FROM reld a LEFT JOIN reld b ON a.cell_name=b.to_cell_name AND a.to_cell_name=b.cell_name {source}""", "reld", *(["dead"] if tag else []))
    cte(f"edges{tag}", f"""SELECT *, CASE WHEN tot>0 THEN act/tot ELSE 0 END AS share FROM (SELECT *, sum(act) OVER (PARTITION BY s) AS tot,
  CAST(sum(CASE WHEN act>0 THEN 1 ELSE 0 END) OVER (PARTITION BY s) AS BIGINT) AS nact FROM e0{tag})""", f"e0{tag}")


network("", "")
ORACLE["pci_edges"] = sql("SELECT s AS serving, n AS neighbour, out_ho, in_ho, act AS act_ho, round(share,6) AS share, nact AS active_neighbours FROM edges", "edges")
cte("w1", "SELECT least(s,n) AS a, greatest(s,n) AS b, max(ln(1+act)) AS w FROM edges WHERE distance<=30000 GROUP BY 1,2", "edges")
cte("stepx", "SELECT s AS x, n AS y, w FROM edges JOIN w1 ON a=least(s,n) AND b=greatest(s,n) WHERE distance<=30000 AND w>0", "edges", "w1")
cte("nodes", "SELECT cell_name AS c, pci, band, substr(cell_name,1,length(cell_name)-2) AS st FROM gis", "gis")
cte("flag", "SELECT DISTINCT least(s,n) AS a, greatest(s,n) AS b FROM edges WHERE intra", "edges")
cte("w2", """SELECT least(p.x,q.y) AS a, greatest(p.x,q.y) AS b, sum(0.25*least(p.w,q.w)) AS w FROM stepx p JOIN stepx q ON p.y=q.x JOIN nodes m ON m.c=p.x JOIN nodes o ON o.c=q.y
  LEFT JOIN flag f ON f.a=least(p.x,q.y) AND f.b=greatest(p.x,q.y)
  WHERE p.x<>q.y AND m.band=o.band AND (m.pci=o.pci OR (m.pci%3=o.pci%3 AND (m.st=o.st OR f.a IS NOT NULL))) GROUP BY 1,2""", "stepx", "nodes", "flag")
cte("pw", "SELECT a, b, sum(w) AS w FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2) GROUP BY 1,2", "w1", "w2")
ORACLE["pci_pairs"] = sql("SELECT a, b, round(w,4) AS pair_weight FROM pw", "pw")
cte("conf", """SELECT s AS serving, o.band, o.pci AS confusion_pci, count(*) AS group_size, sum(act)-max(act) AS severity_act_sum_excl_max, min(act) AS min_act, max(act) AS max_act,
  string_agg(n, ',' ORDER BY n) AS neighbors FROM edges JOIN nodes o ON o.c=n GROUP BY s, o.band, o.pci HAVING count(*)>=2""", "edges", "nodes")
cte("confs", f"""SELECT *, least(greatest(least(greatest(severity_act_sum_excl_max/greatest((SELECT quantile_cont(severity_act_sum_excl_max,0.95) FROM conf),1e-9),0),1)+least(greatest((group_size-2)*0.1,0),0.3),0),1) AS sc FROM conf""", "conf")
ORACLE["pci_confusions"] = sql(f"SELECT * EXCLUDE (sc), round(sc,4) AS severity_score, {sev('sc')} AS severity_category FROM confs", "confs")
cte("coll0", """SELECT pw.a AS cell_a, pw.b AS cell_b, m.pci AS pci_a, o.pci AS pci_b, m.band, CASE WHEN m.pci=o.pci THEN 'exact' ELSE 'mod3' END AS conflict_type,
  CASE WHEN d.a IS NOT NULL THEN '1-hop' ELSE '2-hop' END AS hop_type, pw.w AS pair_weight,
  pw.w*CASE WHEN m.pci=o.pci THEN 1.0 ELSE 0.5 END*CASE WHEN d.a IS NOT NULL THEN 1.0 ELSE 0.25 END AS severity, m.st AS site_a, o.st AS site_b, (m.st=o.st OR f.a IS NOT NULL) AS intra_site
  FROM pw JOIN nodes m ON m.c=pw.a JOIN nodes o ON o.c=pw.b LEFT JOIN (SELECT DISTINCT least(s,n) AS a, greatest(s,n) AS b FROM edges) d ON d.a=pw.a AND d.b=pw.b
  LEFT JOIN flag f ON f.a=pw.a AND f.b=pw.b WHERE m.band=o.band AND (m.pci=o.pci OR (m.pci%3=o.pci%3 AND (m.st=o.st OR f.a IS NOT NULL)))""", "pw", "nodes", "edges", "flag")
cte("coll", """SELECT *, least(greatest(CASE conflict_type WHEN 'exact' THEN 0.35 ELSE 0.05 END+CASE WHEN hop_type='1-hop' THEN 0.15 WHEN conflict_type='exact' THEN 0.10 ELSE 0 END
  +CASE WHEN intra_site THEN CASE conflict_type WHEN 'exact' THEN -0.10 ELSE 0.25 END ELSE 0 END
  +0.35*least(greatest(severity/greatest((SELECT quantile_cont(severity,0.95) FROM coll0),1e-9),0),1),0),1) AS sc FROM coll0""", "coll0")
ORACLE["pci_collisions"] = sql(f"SELECT * EXCLUDE (sc) REPLACE (round(pair_weight,4) AS pair_weight, round(severity,4) AS severity), round(sc,4) AS severity_score, {sev('sc')} AS severity_category FROM coll", "coll")
cte("judged", """SELECT *, row_number() OVER (PARTITION BY s, band, pci ORDER BY act, n) AS rn, coalesce(sum(CASE WHEN reason='AUTO_DEAD_RELATION' THEN 1 ELSE 0 END) OVER (PARTITION BY s, band, pci ORDER BY act, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS gone FROM (
  SELECT *, CASE WHEN intra THEN 'REJECT_INTRA_SITE' WHEN rl<>'Y' THEN NULL WHEN rem<2 THEN 'REJECT_MIN_NEIGHBORS' WHEN out_ho=0 AND in_ho=0 THEN 'AUTO_DEAD_RELATION'
   WHEN act<=8 AND share<=0.05 AND greatest(out_ho,in_ho)<=6 THEN 'SUGGEST_LOW_ACTIVITY_REVIEW' ELSE 'REJECT_ACTIVE_RELATION' END AS reason FROM (
  SELECT e.*, o.band, o.pci, count(*) OVER (PARTITION BY s, o.band, o.pci) AS gs, nact-CASE WHEN act>0 THEN 1 ELSE 0 END AS rem FROM edges e JOIN nodes o ON o.c=n) WHERE gs>=2)""", "edges", "nodes")
cte("dec", "SELECT * FROM judged WHERE reason IS NOT NULL AND gone<gs-1", "judged")
ORACLE["pci_blacklist"] = sql("SELECT s AS serving, n AS neighbor, reason, out_ho, in_ho, act AS act_ho, round(share,6) AS share, pci AS confusion_pci, gs AS confusion_group_size_before, rem AS remaining_active_neighbors_after FROM dec", "dec")
cte("dead", "SELECT DISTINCT s AS ds, n AS dn FROM dec WHERE reason='AUTO_DEAD_RELATION'", "dec")
network("b", "WHERE NOT EXISTS (SELECT 1 FROM dead WHERE ds=a.cell_name AND dn=a.to_cell_name)")
ORACLE["pci_blacklist_applied"] = sql("SELECT s AS serving, n AS neighbour, act AS act_ho, round(share,6) AS share, nact AS active_neighbours FROM edgesb", "edgesb")
ORACLE["pci_summary"] = sql(f"""SELECT 'confusion' AS kind, {sev('sc')} AS detail, count(*) AS count FROM confs GROUP BY 2 UNION ALL
  SELECT 'collision_'||conflict_type, hop_type, count(*) FROM coll GROUP BY 1,2 UNION ALL SELECT 'blacklist', reason, count(*) FROM dec GROUP BY 2""", "confs", "coll", "dec")
cte("fg", f"""SELECT *, angle_diff<=60 AS in_beam FROM (SELECT *, {adiff('bearing','ang')} AS angle_diff FROM (
  SELECT r.cell_name, r.to_cell_name, r.weight, r.distance, x.site, x.band, x.bearing, {bearing('x.latitude','x.longitude','y.latitude','y.longitude')} AS ang
  FROM rel r JOIN gis x ON r.cell_name=x.cell_name JOIN gis y ON r.to_cell_name=y.cell_name
  WHERE intra_site='n' AND distance>=500 AND distance<=CASE WHEN r.band='L800' THEN 30000 ELSE 25000 END))""", "rel", "gis")
ORACLE["feeder_geometry"] = sql("SELECT cell_name, to_cell_name, weight, distance, round(ang,4) AS angle_to_neighbor, round(angle_diff,4) AS angle_diff, in_beam FROM fg", "fg")
cte("fm", f"""SELECT *, o/t AS ratio, CASE WHEN o>0 THEN {wrap('degrees(atan2(sn,cs))')} END AS dir FROM (
  SELECT cell_name, site, band, bearing, sum(weight) AS t, sum(CASE WHEN in_beam THEN weight ELSE 0 END) AS i, sum(CASE WHEN in_beam THEN 0 ELSE weight END) AS o, count(*) AS nr,
  count(CASE WHEN NOT in_beam THEN 1 END) AS no, sum(CASE WHEN in_beam THEN 0 ELSE weight*sin(radians(ang)) END) AS sn, sum(CASE WHEN in_beam THEN 0 ELSE weight*cos(radians(ang)) END) AS cs
  FROM fg GROUP BY ALL)""", "fg")
cte("fp", f"""SELECT * FROM (SELECT a.site, a.band, a.cell_name AS cell_a, b.cell_name AS cell_b, a.bearing AS cell_a_azimuth, b.bearing AS cell_b_azimuth, a.dir AS cell_a_traffic_dir, b.dir AS cell_b_traffic_dir,
  {adiff('a.dir','b.bearing')} AS a_to_b_angle_diff, {adiff('b.dir','a.bearing')} AS b_to_a_angle_diff FROM fm a JOIN fm b ON a.site=b.site AND a.band=b.band AND a.cell_name<b.cell_name
  WHERE a.ratio>=0.3 AND a.nr>=3 AND a.no>=2 AND b.ratio>=0.3 AND b.nr>=3 AND b.no>=2) WHERE a_to_b_angle_diff<=60 AND b_to_a_angle_diff<=60""", "fm")
ORACLE["feeder_swaps"] = sql("SELECT site, band, cell_a, cell_b, cell_a_azimuth, cell_b_azimuth, " + ", ".join(f"round({c},3) AS {c}" for c in ("cell_a_traffic_dir", "cell_b_traffic_dir", "a_to_b_angle_diff", "b_to_a_angle_diff")) + " FROM fp", "fp")
cte("fc", """SELECT *, round(least(CASE lv WHEN 'HIGH_POTENTIAL_SWAP' THEN 0.9 WHEN 'POSSIBLE_SWAP' THEN 0.7 WHEN 'SINGLE_ANOMALY' THEN 0.5 WHEN 'REPAN' THEN 0.3 ELSE 0.0 END+least(ratio*0.1,0.1),1),4) AS sc FROM (
  SELECT *, CASE WHEN nb=1 AND odd THEN 'REPAN' WHEN nb=1 THEN 'NONE' WHEN swap_partner IS NOT NULL THEN 'HIGH_POTENTIAL_SWAP' WHEN odd AND nodd>=2 THEN 'POSSIBLE_SWAP' WHEN odd THEN 'SINGLE_ANOMALY' ELSE 'NONE' END AS lv FROM (
  SELECT *, CAST(sum(CASE WHEN odd THEN 1 ELSE 0 END) OVER (PARTITION BY site, band) AS BIGINT) AS nodd FROM (
  SELECT m.*, (ratio>=0.5 AND o>=5 AND nr>=5 AND no>=3) AS odd, nb, p.partner AS swap_partner FROM fm m JOIN (SELECT site, band, count(*) AS nb FROM gis GROUP BY 1,2) USING (site, band)
  LEFT JOIN (SELECT c, arg_max(p, (ca, cb, p)) AS partner FROM (SELECT cell_a AS c, cell_b AS p, cell_a AS ca, cell_b AS cb FROM fp UNION ALL SELECT cell_b, cell_a, cell_a, cell_b FROM fp) GROUP BY c) p ON p.c=m.cell_name)))""", "fm", "fp", "gis")
ORACLE["feeder_cells"] = sql(f"""SELECT cell_name, site, band, t AS total_weight, i AS in_beam_weight, o AS out_of_beam_weight, round(ratio,3) AS out_of_beam_ratio, nr AS total_relations, no AS out_of_beam_relations,
  round(dir,3) AS dominant_traffic_direction, lv AS confidence_level, swap_partner, round(sc,3) AS severity_score, {sev('sc')} AS severity_category FROM fc""", "fc")
cte("fs", """SELECT site, band, count(*) AS total_cells, count(CASE WHEN lv='HIGH_POTENTIAL_SWAP' THEN 1 END) AS high_confidence, count(CASE WHEN lv IN ('POSSIBLE_SWAP','SINGLE_ANOMALY') THEN 1 END) AS medium_confidence,
  count(CASE WHEN lv='REPAN' THEN 1 END) AS low_confidence, round(max(sc),3) AS severity_score FROM fc GROUP BY 1,2""", "fc")
ORACLE["feeder_sites"] = sql("""SELECT *, CASE WHEN high_confidence>0 THEN 'HIGH' WHEN medium_confidence>0 THEN 'MEDIUM' WHEN low_confidence>0 THEN 'LOW' ELSE 'MINIMAL' END AS severity_category,
  CASE WHEN high_confidence>0 THEN 'CROSSED FEEDER: '||high_confidence||' swap pair(s) detected' WHEN medium_confidence>0 THEN 'POSSIBLE ISSUE: '||medium_confidence||' cells with out-of-beam anomalies'
  WHEN low_confidence>0 THEN 'AZIMUTH REVIEW: '||low_confidence||' cell(s) may need azimuth adjustment' ELSE 'No issues detected' END AS classification FROM fs""", "fs")
cte("fsc0", f"""SELECT cell_site, cell_name, cell_band, sum(v) AS score, count(CASE WHEN v>0 THEN 1 END) AS scored_impacts FROM (SELECT i.cell_name, x.site AS cell_site, x.band AS cell_band,
  CASE WHEN dist<1000 OR coalesce(m,0)<1000 OR {adiff('f','xb')}<=60 THEN 0.0 ELSE pct*least(dist/m,1.0)*{adiff('f','xb')}/180 END AS v
  FROM (SELECT *, {hav('a','b','c','d')} AS dist, {bearing('a','b','c','d')} AS f, max(CASE WHEN pct>=2 AND {hav('a','b','c','d')}<=30000 THEN {hav('a','b','c','d')} END) OVER (PARTITION BY cell_name) AS m FROM imp) i
  JOIN gis x USING (cell_name)) GROUP BY 1,2,3""", "imp", "gis")
ORACLE["feeder_scored"] = sql("""SELECT cell_site, cell_name, cell_band, round(score,3) AS score, scored_impacts, cell_site||'_'||cell_band AS site_band, occ AS cell_occurrences, round(sum(score) OVER (PARTITION BY cell_site),3) AS site_score,
  CASE WHEN occ>=3 THEN 'High potential: All feeders swapped' WHEN occ=2 THEN 'High potential: 2 feeders swapped' ELSE 'Low potential: 1 feeder with high swapped score' END AS classification
  FROM (SELECT *, count(*) OVER (PARTITION BY cell_site, cell_band) AS occ FROM fsc0 WHERE round(score,6)>=round((SELECT quantile_cont(score,0.95) FROM fsc0),6))""", "fsc0")
cte("fos", """SELECT i.cell_name, i.to_cell_name, x.site AS cell_site, x.band AS cell_band, y.band AS impact_band, pct, round(x.bearing)=round(y.bearing) AS same FROM imp i JOIN gis x USING (cell_name)
  JOIN gis y ON y.cell_name=i.to_cell_name WHERE x.site=y.site AND x.band<>y.band""", "imp", "gis")
ORACLE["feeder_cosector"] = sql("""SELECT * REPLACE (round(diff,3) AS diff, round(combined_diff,3) AS combined_diff) FROM (
  SELECT *, count(*) OVER g AS cell_count, sum(diff) OVER g AS combined_diff FROM (
  SELECT cell_name, impact_band, cell_site, cell_band, co.to_cell_name AS co_sectored_impact_cell, co.pct AS co_pct, n.to_cell_name AS non_co_sectored_impact_cell, n.pct AS non_co_pct,
   100*(co.pct-n.pct)/(co.pct+n.pct) AS diff FROM (SELECT * FROM fos WHERE same) co JOIN (SELECT cell_name, impact_band, to_cell_name, pct FROM fos WHERE NOT same) n USING (cell_name, impact_band))
  WHERE (co_pct>0.5 OR non_co_pct>0.5) AND diff<-1 WINDOW g AS (PARTITION BY cell_site, cell_band, impact_band)) WHERE cell_count>1""", "fos")
ORACLE["feeder_bins"] = sql("SELECT cell_name, round(sum(perc_cell_events),5) AS behind_share FROM tot JOIN cov USING (ix,iy,cell_name) WHERE grid_bearing_diff>=90 GROUP BY 1", "tot", "cov")

# --- interference, low coverage ---

cte("ic0", "SELECT *, event_count/sum(event_count) OVER (PARTITION BY ix, iy)::DOUBLE AS share0 FROM cov", "cov")
cte("ic1", "SELECT *, share0/sum(share0) OVER (PARTITION BY band, ix, iy) AS share FROM ic0", "ic0")
cte("ic2", """SELECT * FROM (SELECT *, max(avg_rsrp) OVER (PARTITION BY band, ix, iy) AS mx FROM ic1 WHERE event_count>=2 AND round(share,9)>=0.05)
  WHERE round(mx-avg_rsrp,6)<=CASE WHEN band='L800' THEN 6 ELSE 5 END""", "ic1")
cte("ic3", "SELECT *, CASE WHEN round(mx-avg_rsrp,6)<=5 THEN 1 ELSE 2 END AS g FROM ic2", "ic2")
ORACLE["interference_groups"] = sql("SELECT band, ix, iy, cell_name, round(share+1e-9,6) AS perc_grid_events, round(mx-avg_rsrp+1e-9,6) AS rsrp_dist_max, CAST(g AS BIGINT) AS grid_cluster_no FROM ic3", "ic3")
cte("idom", """SELECT DISTINCT band, ix, iy FROM (SELECT band, ix, iy, max(mx) AS mx FROM ic2 GROUP BY 1,2,3) JOIN
  (SELECT band, ix, iy, max(CASE WHEN r=2 THEN avg_rsrp END) AS sec, max(share0) AS ms FROM (SELECT *, row_number() OVER (PARTITION BY band, ix, iy ORDER BY avg_rsrp DESC) AS r FROM ic0) GROUP BY 1,2,3) USING (band, ix, iy)
  WHERE round(mx-sec,6)>=CASE WHEN band='L800' THEN 6 ELSE 5 END AND ms>=0.12""", "ic2", "ic0")
ORACLE["interference_dominant"] = sql("SELECT * FROM idom", "idom")
cte("ib", """SELECT * FROM (SELECT i.*, count(*) OVER (PARTITION BY band, ix, iy, g) AS cnt FROM ic3 i ANTI JOIN idom USING (band, ix, iy)) WHERE cnt>=3""", "ic3", "idom")
ORACLE["interference_bins"] = sql("SELECT band, ix, iy, cell_name, avg_rsrp, cnt AS count FROM ib", "ib")
cte("ik", """SELECT a.band, a.ix, a.iy, count(*)-1 AS n FROM (SELECT DISTINCT band, ix, iy FROM ib) a JOIN (SELECT DISTINCT band, ix, iy FROM ib) b
  ON a.band=b.band AND b.ix BETWEEN a.ix-3 AND a.ix+3 AND b.iy BETWEEN a.iy-3 AND a.iy+3 GROUP BY 1,2,3 HAVING count(*)-1>49*0.2""", "ib")
ORACLE["interference_kring"] = sql("SELECT band, ix, iy, n AS interferers_within_3_steps FROM ik", "ik")
ORACLE["interference_cells"] = sql("""SELECT cell_name, count(*) AS n_bins, max(distance_to_cell) AS max_distance_m, round(avg(share),3) AS mean_share, round(sum(w),3) AS total_weight,
  round(quantile_cont(distance_to_cell,0.5),3) AS median_distance_m FROM (SELECT *, CASE WHEN hi>lo THEN least(greatest((avg_rsrp-lo)/(hi-lo),0),1) ELSE 0.5 END AS w FROM ib JOIN ik USING (band, ix, iy)
  JOIN (SELECT band, quantile_cont(avg_rsrp,0.02) AS lo, quantile_cont(avg_rsrp,0.98) AS hi FROM ib JOIN ik USING (band, ix, iy) GROUP BY 1) USING (band)) GROUP BY 1""", "ib", "ik")
cte("lr", """SELECT band, ix, iy, cell_name, avg_rsrp-20 AS r, environment, event_count FROM cov JOIN env USING (cell_name) WHERE avg_rsrp-20 BETWEEN -140 AND -30
  AND event_count>=CASE environment WHEN 'URBAN' THEN 10 WHEN 'SUBURBAN' THEN 5 ELSE 2 END""", "cov", "env")
cte("lb", """SELECT * FROM (SELECT band, ix, iy, max(r) AS best, CAST(min(CASE band WHEN 'L800' THEN CASE environment WHEN 'URBAN' THEN -110 WHEN 'SUBURBAN' THEN -115 ELSE -120 END
  ELSE CASE environment WHEN 'URBAN' THEN -115 WHEN 'SUBURBAN' THEN -120 ELSE -125 END END) AS DOUBLE) AS thr FROM lr GROUP BY 1,2,3) WHERE best<=thr""", "lr")
ORACLE["low_coverage_bins"] = sql("SELECT band, ix, iy, round(best,4) AS best_rsrp, thr AS rsrp_threshold FROM lb", "lb")
cte("lm", "SELECT band, ix, iy, max(CASE WHEN r>-115 THEN 1 ELSE 0 END) AS good FROM lr GROUP BY 1,2,3", "lr")
ORACLE["low_coverage_kring"] = sql("""SELECT band, ix, iy, best_rsrp, rsrp_threshold, CAST(m AS BIGINT) AS measured_neighbors, CAST(49-g AS BIGINT) AS problematic_neighbors, CAST(m-g AS BIGINT) AS low_rsrp_neighbors, CAST(49-m AS BIGINT) AS no_data_neighbors FROM (
  SELECT a.band, a.ix, a.iy, round(max(best),4) AS best_rsrp, max(thr) AS rsrp_threshold, count(*) AS m, sum(good) AS g FROM lb a JOIN lm b ON a.band=b.band AND b.ix BETWEEN a.ix-3 AND a.ix+3 AND b.iy BETWEEN a.iy-3 AND a.iy+3 GROUP BY 1,2,3)
  WHERE 49-g>=20 AND (m>=9 OR m-g>=2)""", "lb", "lm")
ORACLE["server_counts"] = sql("SELECT band, n_servers, count(*) AS bins FROM (SELECT band, ix, iy, count(DISTINCT cell_name) AS n_servers FROM cov GROUP BY 1,2,3) GROUP BY 1,2", "cov")

# --- reports, validation, combined views ---


def tier3(flagged: str, band: bool) -> str:
    cond = " AND c.band=f.band" if band else ""
    return f"""(SELECT f.cell_name, count(DISTINCT CASE WHEN c.cell_name<>f.cell_name{cond} THEN c.cell_name END) AS n3, CAST(sum(CASE WHEN c.cell_name=f.cell_name THEN c.event_count ELSE 0 END) AS BIGINT) AS t3
  FROM (SELECT DISTINCT x.cell_name, x.ix, x.iy, g.band FROM {flagged} x JOIN gis g USING (cell_name)) f JOIN cov c USING (ix, iy) GROUP BY 1)"""


def tilt_rows(cells: str, flagged: str, change: str, band: bool, cols: str) -> str:
    return f"""SELECT {cols}, coalesce(n3,0) AS tier_3_sectors_count, coalesce(n3,0) AS tier_3_cells_count, coalesce(t3,0) AS tier_3_traffic_total, CAST(0 AS BIGINT) AS tier_3_drops_total,
  coalesce(round(t3/tall::DOUBLE*100,2),0.0) AS tier3_traffic_perc, 0.0::DOUBLE AS tier3_drops_perc FROM (SELECT o.cell_name, {change} AS ch FROM {cells} o) JOIN gis g USING (cell_name)
  LEFT JOIN {tier3(flagged, band)} USING (cell_name) LEFT JOIN (SELECT cell_name, sum(event_count) AS tall FROM cov GROUP BY 1) USING (cell_name)"""


_d = "'2025-03-09' AS analysisdate, cell_name, CAST(cell_key+1000 AS VARCHAR) AS cilac, {p} AS parameter, '{c}' AS category, round(least(greatest({v},0.0),15.0),1) AS parameter_new_value, '2025-03-09' AS cycle_start_date, '' AS cycle_end_date, 'PENDING' AS cycle_status, 'AUTO_GENERATED' AS conditions, tilt_elc+tilt_mech AS current_tilt, 0.0::DOUBLE AS min_tilt, 15.0::DOUBLE AS max_tilt"
cte("obf", "SELECT ob.* FROM ob SEMI JOIN oss USING (cell_name)", "ob", "oss")
ORACLE["daily_resolution"] = sql(
    tilt_rows("oss", "obf", "recommended_tilt_change", True, _d.format(p="'Electrical_tilt'", c="overshooter", v="tilt_elc+ch")) + " UNION ALL " +
    tilt_rows("uss", "ubs", "recommended_uptilt_deg", True, _d.format(p="CASE WHEN tilt_elc<=0 THEN 'Manual_tilt' ELSE 'Electrical_tilt' END", c="undershooter", v="CASE WHEN tilt_elc<=0 THEN tilt_mech-ch ELSE tilt_elc-ch END")), "obf", "oss", "uss", "ubs", "cov", "gis")
_d = "'09/03/2025' AS analysisdate, cell_name, CAST(cell_key+1000 AS VARCHAR) AS cilac, 'Manual_tilt' AS parameter, '{c}' AS category, round(greatest(least({v},15.0),0.0),1) AS parameter_new_value, '09/03/2025' AS cycle_start_date, '09/03/2025' AS cycle_end_date, 'PENDING' AS cycle_status, 'AUTO_GENERATED' AS conditions, tilt_elc AS current_tilt, 0.0::DOUBLE AS min_tilt, 15.0::DOUBLE AS max_tilt"
ORACLE["resolution_table"] = sql(
    tilt_rows("oss", "obf", "recommended_tilt_change", False, _d.format(c="OverShooter", v="tilt_elc+ch")) + " UNION ALL " +
    tilt_rows("uss", "ubs", "recommended_uptilt_deg", False, _d.format(c="UnderShooter", v="tilt_elc-ch")), "obf", "oss", "uss", "ubs", "cov", "gis")
cte("t3n", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_name ORDER BY t DESC, toname) AS r FROM (SELECT f.cell_name, c.cell_name AS toname, sum(c.event_count) AS t
  FROM (SELECT DISTINCT cell_name, ix, iy FROM obf) f JOIN cov c USING (ix, iy) WHERE c.cell_name<>f.cell_name GROUP BY 1,2)) WHERE r<=5""", "obf", "cov")
ORACLE["tier3_neighbours"] = sql(f"""SELECT '09/03/2025' AS analysisdate, t.cell_name AS fromname, x.cell_key+1000 AS fromcilac, toname, y.cell_key+1000 AS tocilac, round({hav('x.latitude','x.longitude','y.latitude','y.longitude')},2) AS fromtodistance,
  t3 AS tier_3_traffic, CAST(0 AS INTEGER) AS tier_3_drops, round(t3/tall::DOUBLE*100,2) AS tier3_traffic_perc, 0.0::DOUBLE AS tier3_drops_perc, coalesce(f.neighbor_relation,b.neighbor_relation,'N/A') AS is_neighbored
  FROM t3n t JOIN gis x ON x.cell_name=t.cell_name JOIN gis y ON y.cell_name=toname LEFT JOIN {tier3('obf', False)} m ON m.cell_name=t.cell_name
  LEFT JOIN (SELECT cell_name, sum(event_count) AS tall FROM cov GROUP BY 1) a ON a.cell_name=t.cell_name LEFT JOIN rel f ON f.cell_name=t.cell_name AND f.to_cell_name=toname
  LEFT JOIN rel b ON b.cell_name=toname AND b.to_cell_name=t.cell_name""", "t3n", "gis", "rel", "cov", "obf")


def impact(pairs: str) -> str:
    """Pairs a, b with the looked-up relation."""
    return f"""(SELECT p.*, coalesce(f.traffic_data,r.traffic_data,0.0) AS it, coalesce(f.drops_voice,r.drops_voice,0.0) AS idr, coalesce(f.distance,r.distance,{hav('x.latitude','x.longitude','y.latitude','y.longitude')}) AS idist,
  coalesce(f.neighbor_relation,r.neighbor_relation,'N/A') AS irel, x.cell_key+1000 AS ka, y.cell_key+1000 AS kb FROM {pairs} p JOIN gis x ON x.cell_name=p.a JOIN gis y ON y.cell_name=p.b
  LEFT JOIN rel f ON f.cell_name=p.a AND f.to_cell_name=p.b LEFT JOIN rel r ON r.cell_name=p.b AND r.to_cell_name=p.a)"""


ORACLE["pci_level1"] = sql(f"""SELECT '09/03/2025' AS insertdatetime, idr AS sum_drops, it AS sum_impact, round(idist,2) AS distance, ka AS cilac, kb AS nextcilac, CASE WHEN irel='Y' THEN 1 ELSE 0 END AS neighbourindex,
  pci_a AS tosectorsc1, pci_b AS tosectorsc2 FROM {impact("(SELECT cell_a AS a, cell_b AS b, pci_a, pci_b FROM coll WHERE hop_type='1-hop')")}""", "coll", "rel", "gis")
ORACLE["pci_blacklist_table"] = sql(f"""SELECT '09/03/2025' AS insertdatetime, ka AS cilac, pci, 0 AS bl, 'Confusion' AS colision_type, it AS adj_weight, 0.0::DOUBLE AS other_adj_weight, b AS adjacency, 'blacklist' AS parameter,
  1 AS value, CAST(NULL AS INTEGER) AS sector_sc_other, 0.0::DOUBLE AS distancefrom, round(idist,2) AS distanceto FROM {impact("(SELECT s AS a, n AS b, pci FROM dec)")}""", "dec", "rel", "gis")
cte("mem", "SELECT s AS a, n AS b, o.band, o.pci FROM edges JOIN nodes o ON o.c=n QUALIFY count(*) OVER (PARTITION BY s, o.band, o.pci)>=2", "edges", "nodes")
cte("mpair", "SELECT * FROM (SELECT a, band, pci, b AS n1, lead(b) OVER (PARTITION BY a, band, pci ORDER BY b) AS n2 FROM mem) WHERE n2 IS NOT NULL", "mem")
ORACLE["pci_level2"] = sql(f"""SELECT '09/03/2025' AS insertdatetime, ka AS fromcilac, 0 AS shoa, pci_a AS tosectorsc1, it AS impact1, CASE WHEN irel='Y' THEN 1 ELSE 0 END AS neighbour1, 0 AS shob, pci_b AS tosectorsc2, 0.0::DOUBLE AS impact2, 0 AS neighbour2,
  round(idist,2) AS distancefrom, 0.0::DOUBLE AS distanceto, ka AS cilac, kb AS nextcilac, 0 AS neibour2sector, 0 AS totalsho, CAST(CASE WHEN a IN (SELECT s FROM dec) OR b IN (SELECT s FROM dec) THEN 1 ELSE 0 END AS INTEGER) AS l2_nr_bl_candidate
  FROM {impact("(SELECT cell_a AS a, cell_b AS b, pci_a, pci_b FROM coll WHERE hop_type='2-hop')")} UNION ALL
  SELECT '09/03/2025', p.ka, 0, p.pci, p.it, CASE WHEN p.irel='Y' THEN 1 ELSE 0 END, 0, p.pci, q.it, CASE WHEN q.irel='Y' THEN 1 ELSE 0 END, round(p.idist,2), round(q.idist,2), p.kb, q.kb,
  CASE WHEN p.irel='Y' AND q.irel='Y' THEN 1 ELSE 0 END, 0, CASE WHEN p.a IN (SELECT s FROM dec) THEN 1 ELSE 0 END
  FROM {impact("(SELECT a, n1 AS b, n2, band, pci FROM mpair)")} p JOIN {impact("(SELECT a, n2 AS b, n1, band, pci FROM mpair)")} q ON p.a=q.a AND p.band=q.band AND p.pci=q.pci AND p.b=q.n1 AND p.n2=q.b""", "coll", "dec", "mpair", "rel", "gis")
ORACLE["pci_combined"] = sql(f"""SELECT '09/03/2025' AS analysisdate, ka AS cilac, pci_b AS pci, it AS strongestsectorweight, CASE WHEN a IN (SELECT s FROM dec UNION ALL SELECT n FROM dec) THEN 1 ELSE 0 END AS bl, kb AS nearestcilac, kb AS strongestcilac,
  round(idist,2) AS distance_near, round(idist,2) AS distance_strong, it AS totalweight, CASE WHEN hop_type='1-hop' THEN 'Yes' ELSE 'No' END AS is_level1, 0 AS regionid
  FROM {impact("(SELECT cell_a AS a, cell_b AS b, pci_b, hop_type FROM coll)")} UNION ALL
  SELECT '09/03/2025', max(ka), pci, max(it), CASE WHEN a IN (SELECT s FROM dec) THEN 1 ELSE 0 END, arg_min(kb, (idist, b)), arg_min(CASE WHEN it>0 THEN kb END, (-it, b)), round(min(idist),2), round(arg_min(idist, (-it, b)),2), sum(it), 'No', 0
  FROM {impact("mem")} GROUP BY a, band, pci""", "coll", "dec", "mem", "rel", "gis")


def rules(source: str, items: list[tuple[str, str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT cell_name, '{s}' AS severity, '{r}' AS rule, round({v},4) AS actual_value FROM {source} WHERE {c}" for s, r, c, v in items)


_src = "(SELECT cell_name, (pci%6)/2.0::DOUBLE AS t, tilt_elc+tilt_mech+5+(pci%6)/2.0::DOUBLE AS nt, (pci-3)/30.0::DOUBLE AS l, bearing/10-1 AS r, antenna_height/40 AS s FROM gis)"
ORACLE["validate_overshoot"] = sql(rules(_src, [
    ("CRITICAL", "MAX_DOWNTILT", "t>2", "t"), ("WARNING", "HIGH_DOWNTILT", "t>1.5 AND t<=2", "t"), ("CRITICAL", "MAX_TOTAL_TILT", "nt>15", "nt"),
    ("CRITICAL", "NEGATIVE_COVERAGE_REDUCTION", "l<0", "l"), ("WARNING", "HIGH_COVERAGE_REDUCTION", "l>0.6", "l"), ("WARNING", "LOW_RSRP_REDUCTION", "r<0", "r"),
    ("CRITICAL", "EXCESSIVE_RSRP_REDUCTION", "r>25", "r"), ("CRITICAL", "INVALID_SEVERITY_SCORE", "s<0 OR s>1", "s")]), "gis")
_src = "(SELECT cell_name, (pci%6)/2.0::DOUBLE AS t, tilt_elc+tilt_mech-1-(pci%6)/2.0::DOUBLE AS nt, (pci-3)/20.0::DOUBLE AS l, (bearing-40)*20 AS r, (bearing-40)*20/(antenna_height*50) AS q, antenna_height/42 AS s FROM gis)"
ORACLE["validate_undershoot"] = sql("SELECT severity, rule, count(*) AS issues, count(DISTINCT cell_name) AS cells FROM (" + rules(_src, [
    ("CRITICAL", "MAX_UPTILT", "t>2", "t"), ("WARNING", "HIGH_UPTILT", "t>1.5 AND t<=2", "t"), ("CRITICAL", "NEGATIVE_TOTAL_TILT", "nt<0", "nt"),
    ("CRITICAL", "NEGATIVE_COVERAGE_INCREASE", "l<0", "l"), ("WARNING", "EXCESSIVE_COVERAGE_INCREASE", "l>1", "l"), ("CRITICAL", "NEGATIVE_DISTANCE_INCREASE", "r<0", "r"),
    ("WARNING", "EXCESSIVE_DISTANCE_INCREASE", "r>=0 AND q>1", "q"), ("CRITICAL", "INVALID_INTERFERENCE", "s<0 OR s>1", "s"), ("WARNING", "HIGH_INTERFERENCE", "s BETWEEN 0 AND 1 AND s>0.4", "s")]) + ") GROUP BY 1,2", "gis")
ORACLE["unified_cells"] = sql("""SELECT *, CAST((overshooting='Yes')::INT+(undershooting='Yes')::INT+(confusion='Yes')::INT+(feeders='Yes')::INT AS INTEGER) AS n_issues FROM (SELECT cell_name,
  CASE WHEN cell_name IN (SELECT cell_name FROM oss) THEN 'Yes' ELSE 'No' END AS overshooting, CASE WHEN cell_name IN (SELECT cell_name FROM uss) THEN 'Yes' ELSE 'No' END AS undershooting,
  CASE WHEN cell_name IN (SELECT a FROM mem) THEN 'Yes' ELSE 'No' END AS confusion, CASE WHEN cell_name IN (SELECT cell_name FROM fc WHERE lv<>'NONE') THEN 'Yes' ELSE 'No' END AS feeders FROM gis)""", "gis", "oss", "uss", "mem", "fc")
ORACLE["issue_overlap"] = sql("""SELECT *, round(CASE WHEN total=0 THEN 0 ELSE "both"/total::DOUBLE*100 END,2) AS both_pct FROM (SELECT count(*) AS total, count(CASE WHEN o.cell_name IS NOT NULL AND u.cell_name IS NOT NULL THEN 1 END) AS "both",
  count(CASE WHEN u.cell_name IS NULL THEN 1 END) AS only_a, count(CASE WHEN o.cell_name IS NULL THEN 1 END) AS only_b FROM (SELECT cell_name FROM oss) o FULL JOIN (SELECT cell_name FROM uss) u USING (cell_name))""", "oss", "uss")
cte("unif", f"SELECT {sev('severity_score','>')} AS severity_category, cell_name FROM oss UNION ALL SELECT severity_category, cell_name FROM uss", "oss", "uss")
ORACLE["issue_statistics"] = sql("""SELECT 'all' AS dimension, 'all' AS value, count(*) AS findings FROM unif UNION ALL SELECT 'severity_category', severity_category, count(*) FROM unif GROUP BY 2
  UNION ALL SELECT 'band', CASE WHEN cell_name LIKE '%L_' THEN 'L800' ELSE 'L1800' END, count(*) FROM unif GROUP BY 2""", "unif")
ORACLE["detector_counts"] = sql("""SELECT 'overshooting' AS detector, count(*) AS findings FROM oss UNION ALL SELECT 'overshooting_bins', count(*) FROM ob UNION ALL SELECT 'undershooting', count(*) FROM uss
  UNION ALL SELECT 'undershooting_bins', count(*) FROM ubs""", "oss", "ob", "uss", "ubs")
ORACLE["flagged_bins"] = sql("""SELECT c.cell_name, c.ix, c.iy, o.cell_name IS NOT NULL AS overshooting, u.cell_name IS NOT NULL AS interfering FROM cov c
  LEFT JOIN (SELECT DISTINCT cell_name, ix, iy FROM ob) o USING (cell_name, ix, iy) LEFT JOIN (SELECT DISTINCT cell_name, ix, iy FROM ubs) u USING (cell_name, ix, iy)""", "cov", "ob", "ubs")
ORACLE["market_contributors"] = sql(f"""SELECT cell_name, market, other_cell, other_market, round(d,3) AS distance_m FROM (SELECT x.cell_name, x.market, y.cell_name AS other_cell, y.market AS other_market,
  {hav('x.latitude','x.longitude','y.latitude','y.longitude')} AS d FROM gis x JOIN gis y ON x.market<>y.market) WHERE d<=3000""", "gis")
ORACLE["pci_collisions_output"] = f"""SELECT * FROM ({ORACLE["pci_collisions"]}) WHERE conflict_type='exact' OR (conflict_type='mod3' AND intra_site)"""

from cellscape.plans import oracle_regions  # noqa: E402, F401  (adds its statements to ORACLE)
