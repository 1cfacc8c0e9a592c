"""DuckDB statements for outlines, covers and regions of bins."""

from __future__ import annotations

import math

from cellscape.plans.oracle import ORACLE, H, W, adiff, bearing, cte, dest, hav, sev, sql

E2 = 1 / 298.257223563 * (2 - 1 / 298.257223563)
ECC = math.sqrt(E2)


def recursive(final: str, *needs: str) -> str:
    return sql(final, *needs).replace("WITH ", "WITH RECURSIVE ", 1)


def _zone(row: str) -> str:
    """Area in km2 between the equator and the lower edge of a row, per radian."""
    s = f"sin(radians(({row})*{H}-90.0))"
    return f"({6378.137**2 * (1 - E2)!r}*({s}/(2*(1-{E2!r}*{s}*{s}))+atanh({ECC!r}*{s})/{2 * ECC!r}))"


def band_area(lo: str, hi: str) -> str:
    return f"(({_zone(f'({hi})+1')}-{_zone(lo)})*{2 * math.pi / 2**18!r})"


def regions(name: str, source: str, keys: str, min_bins: int, link: int = 1) -> None:
    """Connected bins of ``source`` (keys, ix, iy): {name}b has every bin with cluster_id, {name}s figures per region."""
    on = " AND ".join(f"a.{k}=b.{k}" for k in keys.split(", ")) if keys else "true"
    k, ka = (f"{keys}, ", "".join(f"a.{x}, " for x in keys.split(", "))) if keys else ("", "")
    cte(f"{name}r", f"""SELECT {k}ix, min(iy) AS lo, max(iy) AS hi, CAST(ix AS BIGINT)*262144+min(iy) AS code FROM (
      SELECT *, iy-row_number() OVER (PARTITION BY {k}ix ORDER BY iy) AS run FROM (SELECT DISTINCT {k}ix, iy FROM {source})) GROUP BY {k}ix, run""", source)
    cte(f"{name}e", f"""SELECT {ka}a.code AS x, b.code AS y FROM {name}r a JOIN {name}r b ON {on} AND abs(a.ix-b.ix)<={link} AND a.lo<=b.hi+{link} AND b.lo<=a.hi+{link}""", f"{name}r")
    using = f"{on} AND a.y=b.x"
    cte(f"{name}c", f"SELECT {k}x, y FROM {name}e UNION SELECT {ka}a.x, b.y FROM {name}c a JOIN {name}e b ON {using}", f"{name}e")
    cte(f"{name}l", f"SELECT {k}y AS code, min(x) AS cluster_id FROM {name}c GROUP BY {k}y", f"{name}c")
    join = f"USING ({k}code)"
    cte(f"{name}p", f"SELECT * FROM {name}r JOIN {name}l {join}", f"{name}r", f"{name}l")
    cte(f"{name}g", f"SELECT {k}cluster_id FROM {name}p GROUP BY {k}cluster_id HAVING sum(hi-lo+1)>={min_bins}", f"{name}p")
    cte(f"{name}b", f"SELECT {k}cluster_id, ix, unnest(range(lo, hi+1)) AS iy FROM {name}p SEMI JOIN {name}g USING ({k}cluster_id)", f"{name}p", f"{name}g")
    cte(f"{name}s", f"""SELECT {k}cluster_id, CAST(count(*) AS BIGINT) AS n_points, avg((iy+0.5)*{H}-90.0) AS centroid_lat, avg((ix+0.5)*{W}-180.0) AS centroid_lon,
      round(sum({band_area('iy', 'iy')}),3) AS area_km2, round((max(ix)-min(ix))*{W},9) AS w, round((max(iy)-min(iy))*{H},9) AS h FROM {name}b GROUP BY {k}cluster_id""", f"{name}b")
    # corners by the 2 x 2 block round every lattice point: one or three covered bins make a corner, two in a diagonal make two
    cte(f"{name}v", f"""SELECT {k}cluster_id, CAST(sum(CASE WHEN n IN (1,3) THEN 1 WHEN n=2 AND d IN (6,9) THEN 2 ELSE 0 END) AS BIGINT) AS n_corners,
      CAST(sum(CASE WHEN n=1 THEN 1 WHEN n=3 THEN -1 WHEN n=2 AND d IN (6,9) THEN 2 ELSE 0 END)//4 AS BIGINT) AS parts_less_holes
      FROM (SELECT {k}cluster_id, ix+dx AS px, iy+dy AS py, count(*) AS n, sum(1<<(dx*2+dy)) AS d FROM {name}b, range(2) t(dx), range(2) u(dy) GROUP BY {k}cluster_id, px, py) GROUP BY {k}cluster_id""", f"{name}b")


def no_slivers(small: float, aspect: float, thin: float) -> str:
    return f"area_km2>={small} AND NOT ((least(w,h)<=0 OR greatest(w,h)>{aspect}*least(w,h)) AND least(w,h)<{thin})"


# --- sector outlines, their cover by bin centres ---

_la, _lo = dest("latitude", "longitude", "(bearing-32.5+65.0*i/8)", "300.0")
cte("wpt", f"""SELECT cell_name, band, site, 0 AS k, longitude AS lon, latitude AS lat FROM gis UNION ALL SELECT cell_name, band, site, 10, longitude, latitude FROM gis
  UNION ALL SELECT cell_name, band, site, i+1, {_lo}, {_la} FROM gis, range(9) t(i)""", "gis")


def cover(name: str, points: str, keys: str) -> None:
    """{name}: spans (keys, ix, lo, hi) of bins with their centre inside rings given by ordered points (keys, k, lon, lat)."""
    x = f"((ix+0.5)*{W}-180.0)"
    cte(name, f"""SELECT {keys}, ix, CAST(ceil((y+90.0)/{H}-0.5) AS INTEGER) AS lo, CAST(ceil((y2+90.0)/{H}-0.5)-1 AS INTEGER) AS hi FROM (
      SELECT {keys}, ix, y, lead(y) OVER w AS y2, row_number() OVER w AS n FROM (
        SELECT *, ay+(bly-ay)*({x}-ax)/(blx-ax) AS y FROM (
          SELECT *, unnest(range(CAST(floor((least(ax,blx)+180.0)/{W}) AS BIGINT)-1, CAST(floor((greatest(ax,blx)+180.0)/{W}) AS BIGINT)+2)) AS ix FROM (
            SELECT {keys}, lon AS ax, lat AS ay, lead(lon) OVER e AS blx, lead(lat) OVER e AS bly FROM {points} WINDOW e AS (PARTITION BY {keys} ORDER BY k)) WHERE blx IS NOT NULL)
        WHERE (ax<={x})<>(blx<={x})) WINDOW w AS (PARTITION BY {keys}, ix ORDER BY y)) WHERE n%2=1 AND ceil((y2+90.0)/{H}-0.5)>ceil((y+90.0)/{H}-0.5)""", points)


cover("wsp", "wpt", "cell_name, band")
cte("wbin", "SELECT DISTINCT cell_name, band, ix, unnest(range(lo, hi+1)) AS iy FROM wsp", "wsp")
ORACLE["single_server_bins"] = sql("SELECT band, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, min(cell_name) AS cell_name FROM wbin GROUP BY 1,2,3 HAVING count(DISTINCT cell_name)=1", "wbin")
ORACLE["outline_cover"] = sql("SELECT cell_name, band, CAST(ix AS INTEGER) AS ix, lo, hi FROM wsp", "wsp")
_t = "radians(-90.0)"
ORACLE["bearing_shift"] = sql(f"""SELECT cell_name, round(min(x),5) AS min_lon, round(max(x),5) AS max_lon, round(min(y),5) AS min_lat, round(max(y),5) AS max_lat FROM (
  SELECT cell_name, g.longitude+((p.lon-g.longitude)*cos(radians(g.latitude))*cos({_t})-(p.lat-g.latitude)*sin({_t}))/cos(radians(g.latitude)) AS x,
  g.latitude+(p.lon-g.longitude)*cos(radians(g.latitude))*sin({_t})+(p.lat-g.latitude)*cos({_t}) AS y FROM wpt p JOIN gis g USING (cell_name)) GROUP BY 1""", "wpt", "gis")

# --- density clusters of outlines and the gaps inside them ---

def centres(name: str, points: str) -> None:
    """{name}: area centre of every ring."""
    cte(name, f"""SELECT cell_name, band, x0+sum((ax*by_-bx*ay)*(ax+bx))/(3*sum(ax*by_-bx*ay)) AS lon, y0+sum((ax*by_-bx*ay)*(ay+by_))/(3*sum(ax*by_-bx*ay)) AS lat FROM (
  SELECT cell_name, band, x0, y0, lon-x0 AS ax, lat-y0 AS ay, lead(lon) OVER e-x0 AS bx, lead(lat) OVER e-y0 AS by_ FROM (
    SELECT *, first_value(lon) OVER s AS x0, first_value(lat) OVER s AS y0 FROM {points} WINDOW s AS (PARTITION BY cell_name ORDER BY k)) WINDOW e AS (PARTITION BY cell_name ORDER BY k)) WHERE bx IS NOT NULL
  GROUP BY cell_name, band, x0, y0""", points)


centres("wcen", "wpt")


def clusters(name: str, eps: float, keys: str, centre: str = "wcen") -> None:
    """{name}: (keys, cell_name, hull_cluster) by density of the outlines' centres, three outlines at least."""
    same = "a.band=b.band AND " if keys else ""  # a cell has one band
    cte(f"{name}n", f"SELECT a.cell_name AS x, b.cell_name AS y FROM {centre} a JOIN {centre} b ON {same}{hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}<={eps}", centre)
    cte(f"{name}k", f"SELECT x FROM {name}n GROUP BY x HAVING count(*)>=3", f"{name}n")
    cte(f"{name}d", f"SELECT x, y FROM {name}n WHERE x IN (SELECT x FROM {name}k) AND y IN (SELECT x FROM {name}k)", f"{name}n", f"{name}k")
    cte(f"{name}h", f"SELECT x, y FROM {name}d UNION SELECT a.x, b.y FROM {name}h a JOIN {name}d b ON a.y=b.x", f"{name}d")
    cte(f"{name}m", f"SELECT x, min(y) AS c FROM {name}h GROUP BY x", f"{name}h")
    cte(f"{name}o", f"SELECT x, c FROM {name}m UNION ALL SELECT n.x, min(c) FROM {name}n n JOIN {name}m m ON n.y=m.x WHERE n.x NOT IN (SELECT x FROM {name}m) GROUP BY n.x", f"{name}n", f"{name}m")
    cte(name, f"SELECT {'band, ' if keys else ''}x AS cell_name, c AS hull_cluster FROM {name}o JOIN {centre} ON x=cell_name", f"{name}o", centre)


def gap_regions(name: str, keys: str, points: str = "wpt", bins: str = "wbin", centre: str = "wcen", min_km2: float = 0.1, thin: float = 0.015) -> None:
    """Regions {name}b, {name}s of dense uncovered bins inside the clusters' hulls."""
    clusters(f"{name}q", 5000.0, keys, centre)
    k = "band, " if keys else ""
    own = f"{k}hull_cluster"
    cte(f"{name}pt", f"SELECT {'p.band, ' if keys else ''}hull_cluster, lon, lat FROM {points} p JOIN {name}q USING ({k}cell_name)", points, f"{name}q")
    # the hull over a column reaches from the lowest to the highest chord between a point to the left and one to the right
    x = f"((ix+0.5)*{W}-180.0)"
    cte(f"{name}col", f"SELECT {own}, unnest(range(CAST(floor((min(lon)+180.0)/{W}) AS BIGINT)-1, CAST(floor((max(lon)+180.0)/{W}) AS BIGINT)+2)) AS ix FROM {name}pt GROUP BY {own}", f"{name}pt")
    cte(f"{name}hul", f"""SELECT {', '.join('c.' + x for x in own.split(', '))}, ix, min(a.lat+(b.lat-a.lat)*({x}-a.lon)/(b.lon-a.lon)) AS y, max(a.lat+(b.lat-a.lat)*({x}-a.lon)/(b.lon-a.lon)) AS y2
      FROM {name}col c JOIN {name}pt a ON {' AND '.join(f'a.{x}=c.{x}' for x in own.split(', '))} AND a.lon<={x} JOIN {name}pt b ON {' AND '.join(f'b.{x}=c.{x}' for x in own.split(', '))} AND b.lon>{x} GROUP BY ALL""", f"{name}col", f"{name}pt")
    cte(f"{name}in", f"SELECT {own}, ix, unnest(range(CAST(ceil((y+90.0)/{H}-0.5) AS BIGINT), CAST(ceil((y2+90.0)/{H}-0.5) AS BIGINT))) AS iy FROM {name}hul", f"{name}hul")
    cte(f"{name}out", f"SELECT DISTINCT {own}, ix, iy FROM {bins} JOIN {name}q USING ({k}cell_name)", bins, f"{name}q")
    cte(f"{name}mis", f"SELECT DISTINCT {k}ix, iy FROM (SELECT * FROM {name}in ANTI JOIN {name}out USING ({own}, ix, iy))", f"{name}in", f"{name}out")
    cte(f"{name}den", f"""SELECT {'a.band, ' if keys else ''}a.ix, a.iy FROM {name}mis a JOIN {name}mis b ON {'a.band=b.band AND ' if keys else ''}b.ix BETWEEN a.ix-3 AND a.ix+3 AND b.iy BETWEEN a.iy-3 AND a.iy+3
      GROUP BY {'a.band, ' if keys else ''}a.ix, a.iy HAVING count(*)-1>=24""", f"{name}mis")
    regions(name, f"{name}den", keys, 6)
    cte(f"{name}f", f"SELECT * FROM {name}s JOIN {name}v USING ({k}cluster_id) WHERE {no_slivers(min_km2, 5.0, thin)}", f"{name}s", f"{name}v")


clusters("dbs", 1500.0, "")
ORACLE["hull_dbscan"] = recursive("SELECT cell_name, hull_cluster FROM dbs", "dbs")
gap_regions("ga", "")
gap_regions("gb", "band")
GAP_COLUMNS = "cluster_id, n_points, round(centroid_lat,4) AS centroid_lat, round(centroid_lon,4) AS centroid_lon, area_km2, n_corners, parts_less_holes"
ORACLE["coverage_gaps"] = recursive(f"SELECT {GAP_COLUMNS} FROM gaf", "gaf")
ORACLE["coverage_gaps_by_band"] = recursive(f"SELECT band, {GAP_COLUMNS} FROM gbf", "gbf")
ORACLE["gap_statistics"] = recursive("SELECT band, count(*) AS clusters, CAST(sum(n_points) AS BIGINT) AS points, round(sum(area_km2),3) AS area_km2 FROM gbf GROUP BY 1", "gbf")
ORACLE["uncovered_bins"] = recursive("SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy FROM gamis", "gamis")

# --- regions of interference and of low coverage ---

regions("ir", "ik", "band", 5)
cte("irow", """SELECT b.band, b.cluster_id, i.cell_name, i.avg_rsrp, i.avg_sinr, i.ix, i.iy FROM ib i JOIN irb b USING (band, ix, iy)""", "ib", "irb")
cte("iclu", """SELECT band, cluster_id, count(DISTINCT (ix,iy)) AS n_grids, count(DISTINCT cell_name) AS n_cells, avg((iy+0.5)*{H}-90.0) AS centroid_lat, avg((ix+0.5)*{W}-180.0) AS centroid_lon,
  avg(avg_rsrp) AS avg_rsrp, avg(avg_sinr) AS avg_sinr FROM irow GROUP BY 1,2""".format(H=H, W=W), "irow")
cte("iscore", """SELECT *, round(0.35*least(greatest(n_grids/100.0,0),1)+0.25*least(greatest(n_cells/10.0,0),1)+0.20*least(greatest(area_km2/5.0,0),1)+0.20*least(greatest((-80.0-avg_rsrp)/40.0,0),1),4) AS sc
  FROM iclu JOIN (SELECT band, cluster_id, area_km2 FROM irs) USING (band, cluster_id) JOIN irv USING (band, cluster_id)""", "iclu", "irs", "irv")
ORACLE["interference_clusters"] = recursive(f"""SELECT band||'_'||cluster_id AS cluster_id, band, n_grids, n_cells, round(centroid_lat+1e-9,4) AS centroid_lat, round(centroid_lon+1e-9,4) AS centroid_lon,
  round(avg_rsrp+1e-9,4) AS avg_rsrp, round(avg_sinr+1e-9,4) AS avg_sinr, area_km2, n_corners, parts_less_holes, sc AS severity_score, {sev('sc')} AS severity_category FROM iscore""", "iscore")
ORACLE["interference_members"] = recursive("SELECT DISTINCT band||'_'||cluster_id AS cluster_id, band, cell_name FROM irow", "irow")

cte("lden", """SELECT a.band, a.ix, a.iy FROM (SELECT a.band, a.ix, a.iy, count(*) AS m, sum(good) AS g FROM lb a JOIN lm b ON a.band=b.band AND b.ix BETWEEN a.ix-3 AND a.ix+3 AND b.iy BETWEEN a.iy-3 AND a.iy+3 GROUP BY 1,2,3) a
  WHERE 49-g>=20 AND (m>=9 OR m-g>=2)""", "lb", "lm")
regions("lo", "lden", "band", 6)
cte("lsrv", "SELECT band, cluster_id, cell_name, event_count, r FROM lr JOIN lob USING (band, ix, iy)", "lr", "lob")
cte("lreg", f"""SELECT s.*, n_serving_cells, total_samples FROM los s JOIN (SELECT band, cluster_id, count(DISTINCT cell_name) AS n_serving_cells, CAST(sum(event_count) AS BIGINT) AS total_samples FROM lsrv GROUP BY 1,2) USING (band, cluster_id)
  WHERE {no_slivers(0.1, 5.0, 0.015)} AND area_km2/n_points<=2.0""", "los", "lsrv")
cte("lmem", "SELECT DISTINCT band, cluster_id, cell_name FROM lsrv SEMI JOIN lreg USING (band, cluster_id)", "lsrv", "lreg")
cte("ldep", """SELECT band, cluster_id, sum(s)/sum(n) AS depth FROM lmem JOIN (SELECT band, cell_name, sum(r) AS s, count(*) AS n FROM lr WHERE r<=-115 GROUP BY 1,2) USING (band, cell_name) GROUP BY 1,2""", "lmem", "lr")
cte("lspr", """SELECT band, CASE WHEN count(*)>1 THEN quantile_cont(n_points,0.05) ELSE 0 END AS q0, CASE WHEN count(*)>1 THEN quantile_cont(n_points,0.95) ELSE max(n_points) END AS q1, greatest(max(n_serving_cells),1) AS most FROM lreg GROUP BY 1""", "lreg")
cte("lsev", """SELECT *, least(greatest(0.30*least(area_km2/5.0,1)+0.25*CASE WHEN q1>q0 THEN least(greatest((n_points-q0)/(q1-q0),0),1) ELSE 0.5 END
  +0.25*least(deficit/25.0,1)+0.20*(1-least(n_serving_cells/most,1)),0),1) AS sc FROM (SELECT r.*, coalesce(depth,-115.0) AS depth, greatest(-115.0-coalesce(depth,-115.0),0) AS deficit, q0, q1, most, total_samples/n_points AS per
  FROM lreg r LEFT JOIN ldep USING (band, cluster_id) JOIN lspr USING (band))""", "lreg", "ldep", "lspr")
cte("lnam", "SELECT band, cluster_id, string_agg(cell_name, ',' ORDER BY cell_name) AS serving_cells FROM (SELECT *, row_number() OVER (PARTITION BY band, cluster_id ORDER BY cell_name) AS n FROM lmem) WHERE n<=10 GROUP BY 1,2", "lmem")
ORACLE["low_coverage_clusters"] = recursive(f"""SELECT band, cluster_id, n_points, round(centroid_lat,4) AS centroid_lat, round(centroid_lon,4) AS centroid_lon, area_km2, n_corners, parts_less_holes, n_serving_cells, total_samples,
  round(per,1) AS avg_samples_per_geohash, round(CASE WHEN per>=20 THEN least(0.7+(per-20)/100,1.0) WHEN per>=5 THEN 0.4+(per-5)/50 ELSE greatest(per/12.5,0.1) END,3) AS confidence_score,
  CASE WHEN per>=20 THEN 'HIGH' WHEN per>=5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_category, round(depth,4) AS avg_rsrp_dbm, round(deficit,4) AS rsrp_deficit_db, round(sc,4) AS severity_score,
  {sev('sc')} AS severity_category, serving_cells FROM lsev JOIN lnam USING (band, cluster_id) JOIN lov USING (band, cluster_id)""", "lsev", "lnam", "lov")

# --- complete linkage of the gaps of a bin ---

cte("lk0", """SELECT band, ix, iy, list_transform(list_sort(list(DISTINCT round(mx-avg_rsrp,6))), lambda x: {'lo': x, 'hi': x}) AS g FROM ic2 GROUP BY 1,2,3""", "ic2")
cte("lk", """SELECT * FROM lk0 UNION ALL SELECT band, ix, iy, list_concat(list_concat(g[1:m.i-1], [{'lo': g[m.i].lo, 'hi': g[m.i+1].hi}]), g[m.i+2:len(g)]) AS g FROM (
  SELECT *, list_sort(list_transform(range(1, len(g)), lambda i: {'s': g[i+1].hi-g[i].lo, 'i': i}))[1] AS m FROM lk WHERE len(g)>1) WHERE m.s<1.2""", "lk0")
ORACLE["interference_linked"] = recursive("""SELECT band, ix, iy, cell_name, round(mx-avg_rsrp,6) AS rsrp_dist_max, CAST(len(list_filter(g, lambda x: x.lo<=round(mx-avg_rsrp,6))) AS BIGINT) AS grid_cluster_no
  FROM ic2 JOIN (SELECT band, ix, iy, arg_min(g, len(g)) AS g FROM lk GROUP BY 1,2,3) USING (band, ix, iy)""", "ic2", "lk")

# --- outlines measured from the coverage table ---

def measured(m: str, share: float) -> None:
    """{m}out: corners (cell_name, band, site, k, lon, lat) of the convex outline of each cell's closest bins and its site; {m}ring by cell."""
    cte(f"{m}q", f"SELECT cell_name, quantile_cont(distance_to_cell,{share}) AS q, count(*) AS n FROM cov GROUP BY 1", "cov")
    cte(f"{m}kept", f"""SELECT c.cell_name, ix, iy FROM cov c JOIN {m}q USING (cell_name)
  WHERE CASE WHEN round((n-1)*{share},9)=floor(round((n-1)*{share},9)) THEN round(distance_to_cell,6)<round(q,6) ELSE round(distance_to_cell,6)<=round(q,6) END""", "cov", f"{m}q")
    cte(f"{m}end", f"SELECT cell_name, ix, unnest([min(iy), max(iy)]) AS iy FROM {m}kept GROUP BY cell_name, ix", f"{m}kept")
    cte(f"{m}pt", f"SELECT DISTINCT cell_name, (ix+0.5)*{W}-180.0 AS lon, (iy+0.5)*{H}-90.0 AS lat FROM {m}end UNION SELECT cell_name, longitude, latitude FROM gis SEMI JOIN {m}q USING (cell_name)", f"{m}end", "gis", f"{m}q")
    # a point is pushed on the stack after those that make no left turn towards it have been taken off
    cte(f"{m}h0", f"SELECT cell_name, 0 AS side, list_sort(list({{'x': lon, 'y': lat}})) AS p FROM {m}pt GROUP BY 1 UNION ALL SELECT cell_name, 1, list_reverse_sort(list({{'x': lon, 'y': lat}})) FROM {m}pt GROUP BY 1", f"{m}pt")
    cte(f"{m}h", f"""SELECT cell_name, side, p, 1 AS i, p[1:0] AS st FROM {m}h0 UNION ALL
  SELECT cell_name, side, p, CASE WHEN pop THEN i ELSE i+1 END, CASE WHEN pop THEN st[1:len(st)-1] ELSE list_append(st, p[i]) END FROM (
    SELECT *, coalesce(len(st)>=2 AND (st[len(st)].x-st[len(st)-1].x)*(p[i].y-st[len(st)-1].y)-(st[len(st)].y-st[len(st)-1].y)*(p[i].x-st[len(st)-1].x)<=0, false) AS pop FROM {m}h WHERE i<=len(p))""", f"{m}h0")
    cte(f"{m}ring", f"""SELECT cell_name, list_concat(list_concat(a.st[1:len(a.st)-1], b.st[1:len(b.st)-1]), a.st[1:1]) AS r FROM (SELECT * FROM {m}h WHERE side=0 AND i>len(p)) a JOIN (SELECT * FROM {m}h WHERE side=1 AND i>len(p)) b USING (cell_name)
  WHERE len(a.st)+len(b.st)-2>=3""", f"{m}h")
    cte(f"{m}out", f"SELECT cell_name, g.band, g.site, unnest(range(1, len(r)+1)) AS k, unnest(r).x AS lon, unnest(r).y AS lat FROM {m}ring JOIN gis g USING (cell_name)", f"{m}ring", "gis")


measured("m", 0.98)
cover("msp", "mout", "cell_name, band")
cte("mbin", "SELECT DISTINCT cell_name, band, ix, unnest(range(lo, hi+1)) AS iy FROM msp", "msp")
cte("msole", "SELECT band, ix, iy, min(cell_name) AS cell_name FROM mbin GROUP BY 1,2,3 HAVING count(*)=1", "mbin")
ORACLE["single_server_measured"] = recursive("""SELECT band, CAST(ix AS INTEGER) AS ix, CAST(min(iy) AS INTEGER) AS lo, CAST(max(iy) AS INTEGER) AS hi, cell_name FROM (
  SELECT *, iy-row_number() OVER (PARTITION BY band, ix, cell_name ORDER BY iy) AS run FROM msole) GROUP BY band, ix, cell_name, run""", "msole")

# --- areas and overlaps in the projection of a zone ---

N3 = (1 / 298.257223563) / (2 - 1 / 298.257223563)
ALPHAS = (N3 / 2 - 2 * N3**2 / 3 + 5 * N3**3 / 16, 13 * N3**2 / 48 - 3 * N3**3 / 5, 61 * N3**3 / 240)
RECT = 0.9996 * 6378137.0 / (1 + N3) * (1 + N3**2 / 4 + N3**4 / 64)
EC = 2 * math.sqrt(N3) / (1 + N3)


def projected(name: str, points: str, keys: str, meridian: str) -> None:
    """{name}: points (keys, k, x, y) in metres; ``meridian`` is an expression of the points' columns."""
    t = f"sinh(atanh(sin(radians(lat)))-{EC!r}*atanh({EC!r}*sin(radians(lat))))"
    cte(f"{name}0", f"SELECT {keys}, k, {t} AS t, radians(lon-({meridian})) AS dl FROM {points}", points)
    cte(f"{name}1", f"SELECT {keys}, k, atan2(t, cos(dl)) AS xi, atanh(sin(dl)/sqrt(1+t*t)) AS eta FROM {name}0", f"{name}0")
    x = "+".join(["eta", *[f"{a!r}*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, a in enumerate(ALPHAS, 1)]])
    y = "+".join(["xi", *[f"{a!r}*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, a in enumerate(ALPHAS, 1)]])
    cte(name, f"SELECT {keys}, k, {RECT!r}*({x}) AS x, {RECT!r}*({y}) AS y FROM {name}1", f"{name}1")


def sides(name: str, points: str, keys: str) -> None:
    """{name}: sides (keys, ax, ay, bx, b_y) of closed rings, relative to their first point, with ox, oy."""
    cte(name, f"""SELECT {keys}, ox, oy, x-ox AS ax, y-oy AS ay, nx-ox AS bx, ny-oy AS b_y FROM (SELECT *, lead(x) OVER e AS nx, lead(y) OVER e AS ny, first_value(x) OVER e AS ox, first_value(y) OVER e AS oy
      FROM {points} WINDOW e AS (PARTITION BY {keys} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE nx IS NOT NULL""", points)


ZONE = "floor((m+180.0)/6.0)*6.0-177.0"
cte("mmean", "SELECT cell_name, avg(lon) AS m FROM mout JOIN (SELECT cell_name, max(k) AS last FROM mout GROUP BY 1) USING (cell_name) WHERE k<last GROUP BY 1", "mout")
cte("mz", f"SELECT o.*, {ZONE} AS zone FROM mout o JOIN mmean USING (cell_name)", "mout", "mmean")
projected("mxy", "mz", "cell_name", "zone")
sides("mside", "mxy", "cell_name")
cte("marea", "SELECT cell_name, abs(sum(ax*b_y-bx*ay))/2e6 AS km2, count(*) AS n_corners FROM mside GROUP BY 1", "mside")
ORACLE["hull_build"] = recursive("""SELECT cell_name, sample_count, round(km2,4) AS area_km2, g.band, g.pci, g.site, n_corners, round(min(lon),6) AS min_lon, round(max(lon),6) AS max_lon, round(min(lat),6) AS min_lat, round(max(lat),6) AS max_lat
  FROM mout JOIN marea USING (cell_name) JOIN gis g USING (cell_name) JOIN (SELECT cell_name, CAST(sum(event_count) AS BIGINT) AS sample_count FROM cov GROUP BY 1) USING (cell_name) GROUP BY ALL""", "mout", "marea", "gis", "cov")


def overlaps(name: str, pairs: str) -> None:
    """{name}: pairs (c1, c2) with areas, overlap and centre distance; the overlap by strips."""
    cte(f"{name}z", f"SELECT c1, c2, floor(((a.m+b.m)/2+180.0)/6.0)*6.0-177.0 AS zone FROM {pairs} JOIN mmean a ON a.cell_name=c1 JOIN mmean b ON b.cell_name=c2", pairs, "mmean")
    cte(f"{name}p", f"SELECT c1, c2, w, zone, o.k, o.lon, o.lat FROM (SELECT *, unnest([1,2]) AS w FROM {name}z) z JOIN mout o ON o.cell_name=CASE WHEN w=1 THEN c1 ELSE c2 END", f"{name}z", "mout")
    projected(f"{name}x", f"{name}p", "c1, c2, w", "zone")
    sides(f"{name}s", f"{name}x", "c1, c2, w")
    cte(f"{name}a", f"""SELECT c1, c2, w, abs(tw)/2 AS area, ox+sx/(3*tw) AS cx, oy+sy/(3*tw) AS cy FROM (SELECT c1, c2, w, ox, oy, sum(ax*b_y-bx*ay) AS tw, sum((ax*b_y-bx*ay)*(ax+bx)) AS sx, sum((ax*b_y-bx*ay)*(ay+b_y)) AS sy FROM {name}s GROUP BY ALL)""", f"{name}s")
    # strips between the abscissas of all corners and crossings
    cte(f"{name}e", f"SELECT c1, c2, w, least(ax,bx)+ox AS l, greatest(ax,bx)+ox AS r, CASE WHEN ax<bx THEN ay ELSE b_y END+oy AS yl, CASE WHEN ax<bx THEN b_y ELSE ay END+oy AS yr FROM {name}s WHERE ax<>bx", f"{name}s")
    at = lambda e, x: f"({e}.yl+({e}.yr-{e}.yl)*({x}-{e}.l)/({e}.r-{e}.l))"
    cte(f"{name}u", f"""SELECT c1, c2, l AS x FROM {name}e UNION SELECT c1, c2, r FROM {name}e UNION
      SELECT c1, c2, x FROM (SELECT e.c1, e.c2, greatest(e.l,f.l)+(least(e.r,f.r)-greatest(e.l,f.l))*d0/(d0-d1) AS x, d0, d1 FROM (SELECT e, f, {at('e', 'greatest(e.l,f.l)')}-{at('f', 'greatest(e.l,f.l)')} AS d0, {at('e', 'least(e.r,f.r)')}-{at('f', 'least(e.r,f.r)')} AS d1
        FROM {name}e e JOIN {name}e f ON e.c1=f.c1 AND e.c2=f.c2 AND e.w=1 AND f.w=2 AND e.l<f.r AND f.l<e.r)) WHERE d0*d1<0""", f"{name}e")
    cte(f"{name}t", f"SELECT c1, c2, x AS x0, lead(x) OVER (PARTITION BY c1, c2 ORDER BY x) AS x1 FROM {name}u", f"{name}u")
    # in a strip every outline is one interval of heights at the middle and the cut is linear, so the middle height times the width is exact
    cte(f"{name}h", f"""SELECT t.c1, t.c2, x0, x1, w, min({at('e', '(x0+x1)/2')}) AS low, max({at('e', '(x0+x1)/2')}) AS high FROM {name}t t JOIN {name}e e ON e.c1=t.c1 AND e.c2=t.c2 AND e.l<(x0+x1)/2 AND e.r>(x0+x1)/2 GROUP BY ALL""", f"{name}t", f"{name}e")
    cte(f"{name}o", f"SELECT a.c1, a.c2, sum((a.x1-a.x0)*greatest(least(a.high,b.high)-greatest(a.low,b.low),0)) AS m2 FROM {name}h a JOIN {name}h b ON a.c1=b.c1 AND a.c2=b.c2 AND a.x0=b.x0 AND a.w=1 AND b.w=2 GROUP BY 1,2", f"{name}h")
    cte(name, f"SELECT a.c1, a.c2, a.area AS area1, b.area AS area2, coalesce(m2,0) AS m2, sqrt(pow(a.cx-b.cx,2)+pow(a.cy-b.cy,2))/1000 AS km FROM {name}a a JOIN {name}a b ON a.c1=b.c1 AND a.c2=b.c2 AND a.w=1 AND b.w=2 LEFT JOIN {name}o o ON o.c1=a.c1 AND o.c2=a.c2", f"{name}a", f"{name}o")


cte("hcp", """SELECT a.cell_name AS c1, b.cell_name AS c2, a.band, a.pci AS pci1, b.pci AS pci2, t AS conflict_type FROM gis a JOIN gis b ON a.band=b.band AND a.cell_name<b.cell_name, (VALUES ('exact'),('mod3')) v(t)
  WHERE a.cell_name IN (SELECT cell_name FROM mring) AND b.cell_name IN (SELECT cell_name FROM mring) AND CASE WHEN t='exact' THEN a.pci=b.pci AND a.site<>b.site ELSE a.pci%3=b.pci%3 AND a.pci<>b.pci AND a.site=b.site END""", "gis", "mring")
cte("hcq", "SELECT DISTINCT c1, c2 FROM hcp", "hcp")
overlaps("hco", "hcq")
cte("hcs", """SELECT *, least(greatest(0.50*least(pct/100,1)+0.30*greatest(1-km/10,0)+0.20*CASE WHEN conflict_type='exact' THEN 1.0 ELSE 0.6 END,0),1) AS sc FROM (
  SELECT p.*, m2, km, CASE WHEN least(area1,area2)>0 THEN m2/least(area1,area2)*100 ELSE 0 END AS pct FROM hcp p JOIN hco USING (c1, c2) WHERE least(area1,area2)>0) WHERE pct>=CASE WHEN conflict_type='exact' THEN 10 ELSE 30 END OR m2/1e6>=0.0005""", "hcp", "hco")
ORACLE["hull_conflicts"] = recursive(f"""SELECT CASE WHEN conflict_type='exact' THEN 'PCI_COLLISION' ELSE 'PCI_MOD3_CONFLICT' END AS detector, conflict_type, band, pci1, pci2, c1 AS cell1_name, c2 AS cell2_name, round(pct,2) AS overlap_percentage,
  round(m2/1e6,6) AS overlap_area_km2, round(km,2) AS distance_km, round(sc,4) AS severity_score, {sev('sc')} AS severity_category FROM hcs""", "hcs")

cte("cap", """SELECT a.site||'_'||right(a.cell_name,1) AS site_sector, a.cell_name AS c1, b.cell_name AS c2 FROM gis a JOIN gis b ON a.site=b.site AND right(a.cell_name,1)=right(b.cell_name,1) AND a.band='L800' AND b.band='L1800'
  WHERE a.cell_name IN (SELECT cell_name FROM mring) AND b.cell_name IN (SELECT cell_name FROM mring)""", "gis", "mring")
overlaps("cao", "cap")
cte("car", "SELECT p.*, x.km2 AS low, y.km2 AS high, m2/1e6 AS inter, CASE WHEN x.km2>0 THEN m2/1e6/x.km2 ELSE 0 END AS ratio FROM cap p JOIN cao USING (c1, c2) JOIN marea x ON x.cell_name=c1 JOIN marea y ON y.cell_name=c2", "cap", "cao", "marea")
_sc = "round(least(greatest(1-ratio,0),1),4)"
ORACLE["ca_imbalance"] = recursive(f"""SELECT 'CA_IMBALANCE' AS detector, 'L800-L1800' AS ca_pair, 'L800' AS coverage_band, 'L1800' AS capacity_band, 'insufficient_capacity_coverage' AS issue_type, {_sc} AS severity_score, {sev(_sc)} AS severity_category,
  site_sector, c1 AS coverage_cell_name, c2 AS capacity_cell_name, round(low,2) AS coverage_area_km2, round(high,2) AS capacity_area_km2, round(inter,2) AS intersection_area_km2, round(ratio,3) AS coverage_ratio,
  round(ratio*100,1) AS coverage_percentage, 99.9::DOUBLE AS threshold_percentage FROM car WHERE ratio<0.999""", "car")

# --- relations and small tables ---

cte("w2all", "SELECT least(p.x,q.y) AS a, greatest(p.x,q.y) AS b, sum(0.25*least(p.w,q.w)) AS w FROM stepx p JOIN stepx q ON p.y=q.x WHERE p.x<>q.y GROUP BY 1,2", "stepx")
ORACLE["pci_all_pairs"] = sql("SELECT a, b, round(sum(w),4) AS pair_weight FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2all) GROUP BY 1,2", "w1", "w2all")
ORACLE["pci_confusion_members"] = sql("""SELECT s AS serving, band, pci AS confusion_pci, n AS neighbour, round(act,4) AS act_ho, group_size FROM (
  SELECT s, o.band, o.pci, n, act, count(*) OVER (PARTITION BY s, o.band, o.pci) AS group_size FROM edges JOIN nodes o ON o.c=n) WHERE group_size>=2""", "edges", "nodes")
cte("coe", "SELECT DISTINCT cell_name AS x, to_cell_name AS y FROM rel WHERE intra_site='y' AND band=to_band AND cell_name<>to_cell_name UNION SELECT to_cell_name, cell_name FROM rel WHERE intra_site='y' AND band=to_band AND cell_name<>to_cell_name", "rel")
cte("coc", "SELECT x, y FROM coe UNION SELECT a.x, b.y FROM coc a JOIN coe b ON a.y=b.x", "coe")
ORACLE["cosector_groups"] = recursive("SELECT x AS cell_name, min(y) AS sector_group FROM coc GROUP BY 1", "coc")
ORACLE["feeder_relation_texts"] = sql("""SELECT cell_name, coalesce(string_agg(CASE WHEN n<=5 THEN printf('%s (d=%dm, w=%.1f, angle=%.0f°)', to_cell_name, CAST(floor(distance) AS BIGINT), weight, ang) END, ' | ' ORDER BY n),'') AS top_suspicious_relations
  FROM (SELECT *, CASE WHEN NOT in_beam THEN row_number() OVER (PARTITION BY cell_name, in_beam ORDER BY weight DESC, to_cell_name) END AS n FROM fg) GROUP BY 1""", "fg")
ORACLE["coverage_quality"] = sql("SELECT count(*) AS rows, CAST(1 AS BIGINT) AS grid_lengths, CAST(7 AS INTEGER) AS shortest_grid, CAST(0 AS BIGINT) AS rejected_grids, CAST(max(ts) AS TIMESTAMP) AS newest, date_diff('day', CAST(max(ts) AS DATE), DATE '2025-03-09')>7 AS stale FROM cov", "cov")

# --- cells near a gap, growth of the sectors ---

cte("gnear", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY d, cell_name) AS n FROM (
  SELECT cluster_id, c.cell_name, min({hav('centroid_lat', 'centroid_lon', 'latitude', 'longitude')}) AS d, centroid_lat AS la, centroid_lon AS lo FROM gaf, cov c GROUP BY ALL)) WHERE n<=15""", "gaf", "cov")
cte("gaim", f"SELECT x.*, {adiff(bearing('g.latitude', 'g.longitude', 'la', 'lo'), 'g.bearing')}<=32.5 AS aimed FROM gnear x JOIN gis g USING (cell_name)", "gnear", "gis")
ORACLE["gap_cells"] = recursive("""SELECT cluster_id, coalesce(string_agg(CASE WHEN r<=5 THEN cell_name END, ',' ORDER BY n),'') AS nearby_cells, CAST(count(CASE WHEN NOT aimed THEN 1 END) AS BIGINT) AS cells_filtered_by_azimuth,
  round(avg(d),2) AS avg_distance_to_coverage_m, CAST(count(CASE WHEN r<=5 THEN 1 END) AS INTEGER) AS nearby_cell_count FROM (SELECT *, CASE WHEN aimed THEN row_number() OVER (PARTITION BY cluster_id, aimed ORDER BY n) END AS r FROM gaim) GROUP BY 1""", "gaim")


def touched(name: str, points: str, keys: str) -> None:
    """{name}: bins (keys, ix, iy) that convex rings touch."""
    x0, x1 = f"(ix*{W}-180.0)", f"((ix+1)*{W}-180.0)"
    at = lambda x: f"(ay+(bly-ay)*({x}-ax)/(blx-ax))"
    lo, hi = f"greatest(least(ax,blx),{x0})", f"least(greatest(ax,blx),{x1})"
    cte(name, f"""SELECT {keys}, ix, unnest(range(CAST(floor((min(y)+90.0)/{H}) AS BIGINT), CAST(floor((max(y)+90.0)/{H}) AS BIGINT)+1)) AS iy FROM (
      SELECT {keys}, ix, unnest(CASE WHEN ax=blx THEN [ay, bly] ELSE [{at(lo)}, {at(hi)}] END) AS y FROM (
        SELECT *, unnest(range(CAST(floor((least(ax,blx)+180.0)/{W}) AS BIGINT)-1, CAST(floor((greatest(ax,blx)+180.0)/{W}) AS BIGINT)+2)) AS ix FROM (
          SELECT {keys}, lon AS ax, lat AS ay, lead(lon) OVER e AS blx, lead(lat) OVER e AS bly FROM {points} WINDOW e AS (PARTITION BY {keys} ORDER BY k)) WHERE blx IS NOT NULL) WHERE {lo}<={hi}) GROUP BY {keys}, ix""", points)


cte("wfar", f"SELECT cell_name, max({hav('g.latitude', 'g.longitude', 'p.lat', 'p.lon')}) AS far FROM wpt p JOIN gis g USING (cell_name) GROUP BY 1", "wpt", "gis")
cte("wgrown", """SELECT cell_name, degree, k, g.longitude+(lon-g.longitude)*((far+300.0*degree)/far) AS lon, g.latitude+(lat-g.latitude)*((far+300.0*degree)/far) AS lat
  FROM wpt JOIN gis g USING (cell_name) JOIN wfar USING (cell_name), (VALUES (1),(2)) v(degree)""", "wpt", "gis", "wfar")
touched("wnow", "wpt", "cell_name")
touched("wwide", "wgrown", "cell_name, degree")
cte("wext", "SELECT * FROM wwide ANTI JOIN wnow USING (cell_name, ix, iy)", "wwide", "wnow")


def shares(name: str, most: int) -> None:
    cte(name, f"""SELECT cell_name, degree, count(*) AS extension_bins, CAST(count(CASE WHEN n>{most} THEN 1 END) AS BIGINT) AS interfering_bins, count(CASE WHEN n>{most} THEN 1 END)/count(*)::DOUBLE AS interference_share
      FROM wext JOIN (SELECT ix, iy, count(*) AS n FROM cov GROUP BY 1,2) USING (ix, iy) GROUP BY 1,2""", "wext", "cov")


shares("wsh", 2)
ORACLE["uptilt_extension"] = sql("SELECT * REPLACE (round(interference_share,4) AS interference_share) FROM wsh", "wsh")
shares("wsh2", 30)
ORACLE["uptilt_final_candidates"] = sql("""SELECT cell_name, round(least_share,4) AS least_share, most_bins, grid_count FROM (SELECT cell_name, min(interference_share) AS least_share, max(extension_bins) AS most_bins FROM wsh2 GROUP BY 1)
  JOIN (SELECT cell_name, count(*) AS grid_count FROM cov GROUP BY 1) USING (cell_name) WHERE least_share<=0.7 AND most_bins>=0.02*grid_count AND most_bins>=5""", "wsh2", "cov")

# --- gaps between outlines of the closest bins ---

measured("n", 0.1)
cover("nsp", "nout", "cell_name, band")
cte("nbin", "SELECT DISTINCT cell_name, band, ix, unnest(range(lo, hi+1)) AS iy FROM nsp", "nsp")
centres("ncen", "nout")
gap_regions("gm", "band", "nout", "nbin", "ncen", 0.05, 0.002)
ORACLE["coverage_gaps_measured"] = recursive(f"SELECT band, {GAP_COLUMNS} FROM gmf", "gmf")

# --- statistics and input quality ---

_parts = {
    "overshooting": (f"SELECT {sev('severity_score', '>')} AS s, NULL AS b, recommended_tilt_change AS c, NULL AS a FROM oss", True, False),
    "undershooting": ("SELECT severity_category AS s, NULL AS b, recommended_uptilt_deg AS c, NULL AS a FROM uss", True, False),
    "pci_confusions": (f"SELECT {sev('sc')} AS s, band AS b, NULL AS c, NULL AS a FROM confs", True, True),
    "pci_collisions": (f"SELECT {sev('sc')} AS s, band AS b, NULL AS c, NULL AS a FROM coll", True, True),
    "pci_blacklist": ("SELECT NULL AS s, NULL AS b, NULL AS c, NULL AS a FROM dec", False, False),
    "coverage_gaps": ("SELECT NULL AS s, band AS b, NULL AS c, area_km2 AS a FROM gbf", False, True),
}
_rows = []
for _name, (_from, _by_severity, _by_band) in _parts.items():
    for _dim, _value, _on in (("all", "'all'", True), ("severity_category", "s", _by_severity), ("band", "b", _by_band)):
        if _on:
            _rows.append(f"SELECT '{_name}' AS detector, '{_dim}' AS dimension, {_value} AS value, count(*) AS findings, round(avg(CAST(c AS DOUBLE)),3) AS mean_change, round(sum(CAST(a AS DOUBLE)),3) AS area_km2 FROM ({_from}) GROUP BY ALL")
ORACLE["detector_statistics"] = recursive(" UNION ALL ".join(_rows), "oss", "uss", "confs", "coll", "dec", "gbf")
ORACLE["unified_identities"] = sql(f"""SELECT 'pci_confusion' AS detector, serving AS cell_name, band, {sev('sc')} AS severity_category, round(sc,4) AS severity_score, 'separate '||group_size||' neighbours with identity '||confusion_pci AS action FROM confs
  UNION ALL SELECT 'pci_blacklist', s, CASE WHEN s LIKE '%L_' THEN 'L800' ELSE 'L1800' END, 'LOW', NULL, 'blacklist '||n||': '||reason FROM dec""", "confs", "dec")
ORACLE["tilt_per_cell"] = sql("""SELECT cell_name, CAST(arg_max(t, (sc, t)) AS INTEGER) AS tilt_change FROM (SELECT cell_name, severity_score AS sc, recommended_tilt_change AS t FROM oss UNION ALL
  SELECT cell_name, severity_score, -recommended_uptilt_deg FROM uss) GROUP BY 1""", "oss", "uss")
ORACLE["low_coverage_plain"] = sql("SELECT DISTINCT band, ix, iy FROM lr WHERE r<=-115", "lr")
ORACLE["hull_quality"] = recursive("""SELECT count(*) AS rows, CAST(0 AS BIGINT) AS without_polygon, CAST(0 AS BIGINT) AS duplicates, CAST(sum(CASE WHEN n<15000 THEN 1 ELSE 0 END) AS BIGINT) AS low_sample
  FROM mring JOIN (SELECT cell_name, sum(event_count) AS n FROM cov GROUP BY 1) USING (cell_name)""", "mring", "cov")
cte("gisq", "SELECT * FROM gis WHERE market<>'0'", "gis")
ORACLE["input_quality"] = recursive(r"""SELECT v."check", CAST(n AS BIGINT) AS rows, CAST(p AS BIGINT) AS problems, CASE WHEN v."check"='name_pattern' THEN n-p>=0.7*n ELSE n=0 OR p<n END AS ok FROM (
  SELECT 'signal_range' AS "check", count(*) AS n, count(CASE WHEN avg_rsrp NOT BETWEEN -140 AND -30 THEN 1 END) AS p FROM cov
  UNION ALL SELECT 'event_count', count(*), count(CASE WHEN event_count<=0 THEN 1 END) FROM cov UNION ALL SELECT 'distance', count(*), count(CASE WHEN distance_to_cell<0 THEN 1 END) FROM cov
  UNION ALL SELECT 'inventory_missing', count(*), count(CASE WHEN cell_name NOT IN (SELECT cell_name FROM gisq) THEN 1 END) FROM (SELECT DISTINCT cell_name FROM cov)
  UNION ALL SELECT 'position', count(*), count(CASE WHEN latitude IS NULL OR longitude IS NULL THEN 1 END) FROM gisq
  UNION ALL SELECT 'name_pattern', count(*), count(CASE WHEN NOT regexp_matches(cell_name,'^S\d+[LH][12]$') THEN 1 END) FROM gisq
  UNION ALL SELECT 'polygon_missing', count(*), 0 FROM mring UNION ALL SELECT 'polygon_area', count(*), count(CASE WHEN km2<=0 THEN 1 END) FROM marea UNION ALL SELECT 'polygon_repeated', count(*), 0 FROM mring) v""", "cov", "gisq", "mring", "marea")
