"""DuckDB SQL with the formulas written out, to compare the operators with."""

from __future__ import annotations

from .views import with_views

R = "CAST(6371008.8 AS DOUBLE)"


def d(x: float | str) -> str:
    return f"CAST({x} AS DOUBLE)"


def hav(a: str = "lon1", b: str = "lat1", c: str = "lon2", e: str = "lat2") -> str:
    s = f"(pow(sin(radians({e}-{b})/2),2)+cos(radians({b}))*cos(radians({e}))*pow(sin(radians({c}-{a})/2),2))"
    return f"(2*atan2(sqrt({s}),sqrt(1-{s}))*{R})"


def turn(x: str) -> str:
    """To [0, 360)."""
    return f"(CASE WHEN ({x})%360<0 THEN ({x})%360+360 ELSE ({x})%360 END)"


def lon180(x: str) -> str:
    return f"((({x})+540)%360-180)"


def brg(a: str = "lon1", b: str = "lat1", c: str = "lon2", e: str = "lat2") -> str:
    return turn(f"degrees(atan2(sin(radians({c}-{a}))*cos(radians({e})),cos(radians({b}))*sin(radians({e}))-sin(radians({b}))*cos(radians({e}))*cos(radians({c}-{a}))))")


def dest(lon: str, lat: str, bearing: str, meters: str) -> tuple[str, str]:
    """(lon, lat) in degrees."""
    angle = f"(({meters})/{R})"
    phi = f"asin(sin(radians({lat}))*cos({angle})+cos(radians({lat}))*sin({angle})*cos(radians({bearing})))"
    lam = f"radians({lon})+atan2(sin(radians({bearing}))*sin({angle})*cos(radians({lat})),cos({angle})-sin(radians({lat}))*sin({phi}))"
    return lon180(f"degrees({lam})"), f"degrees({phi})"


PSI = "ln(tan(radians(lat2)/2+pi()/4)/tan(radians(lat1)/2+pi()/4))"
SHORT = "(CASE WHEN abs(radians(lon2-lon1))>pi() THEN CASE WHEN lon2>lon1 THEN radians(lon2-lon1)-2*pi() ELSE radians(lon2-lon1)+2*pi() END ELSE radians(lon2-lon1) END)"


def at(lon: str, lat: str, digits: int = 6) -> str:
    return f"round({lon},{digits}) AS lon, round({lat},{digits}) AS lat"


PATHS = "p AS (SELECT * FROM geo_path WHERE fid IN (SELECT fid FROM geo_path GROUP BY fid HAVING count(*)>1))"
SEGS = f"{PATHS}, s AS (SELECT fid, ix, lag(lon) OVER w AS lon1, lag(lat) OVER w AS lat1, lon AS lon2, lat AS lat2 FROM p WINDOW w AS (PARTITION BY fid ORDER BY ix)), g AS (SELECT *, {hav()} AS m FROM s WHERE lon1 IS NOT NULL)"
#: The point a number of meters along each path.
_WALKED = dest("lon1", "lat1", brg(), "target-(upto-m)")


def walk(target: str) -> str:
    return f"""WITH {SEGS}, c AS (SELECT *, sum(m) OVER (PARTITION BY fid ORDER BY ix) AS upto, {target} AS target FROM g),
    f AS (SELECT fid, min(ix) AS ix FROM c WHERE upto>=target GROUP BY fid),
    hit AS (SELECT c.fid, {_WALKED[0]} AS lon, {_WALKED[1]} AS lat FROM c JOIN f USING (fid, ix)),
    e AS (SELECT fid, arg_max(lon, ix) AS lon, arg_max(lat, ix) AS lat FROM p GROUP BY fid)
    SELECT e.fid, {at("coalesce(hit.lon,e.lon)", "coalesce(hit.lat,e.lat)")} FROM e LEFT JOIN hit USING (fid)"""


#: Edges of the hexagons and of their copies moved by (9, 4).
HEX_EDGES = "h AS (SELECT nk, ix, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM geo_hex WINDOW w AS (PARTITION BY nk ORDER BY ix)), e AS (SELECT * FROM h WHERE x2 IS NOT NULL)"
INSIDE = f"""{HEX_EDGES}, pip AS (SELECT e.nk, p.id FROM geo_pts p JOIN e ON (e.y2>p.lat)<>(e.y1>p.lat) AND p.lon<(e.x1-e.x2)*(p.lat-e.y2)/(CASE WHEN e.y1=e.y2 THEN 1 ELSE e.y1-e.y2 END)+e.x2
    GROUP BY e.nk, p.id HAVING count(*)%2=1)"""
HEX_PLANE = f"""{HEX_EDGES}, c0 AS (SELECT nk, cos(radians(avg(lat))) AS c, avg(lat) AS lat0 FROM geo_hex GROUP BY nk),
    q AS (SELECT e.nk, c, {R}*radians(x1)*c AS ax, {R}*radians(y1) AS ay, {R}*radians(x2)*c AS bx, {R}*radians(y2) AS b_y FROM e JOIN c0 USING (nk)),
    a AS (SELECT nk, any_value(c) AS c, sum(ax*b_y-bx*ay)/2 AS s, sum((ax+bx)*(ax*b_y-bx*ay)) AS sx, sum((ay+b_y)*(ax*b_y-bx*ay)) AS sy FROM q GROUP BY nk)"""
MEAN = "m AS (SELECT nk, avg(lon) AS lon0, avg(lat) AS lat0 FROM geo_hex GROUP BY nk)"
PLANE = f"t AS (SELECT g.nk, g.ix, lon0, lat0, {R}*radians(g.lon-lon0)*cos(radians(lat0)) AS x, {R}*radians(g.lat-lat0) AS y FROM geo_hex g JOIN m USING (nk))"


def from_plane(x: str, y: str) -> str:
    return at(lon180(f"lon0+degrees(({x})/({R}*cos(radians(lat0))))"), f"lat0+degrees(({y})/{R})")


def hull_edges(points: str, by: str = "") -> str:
    """Common tables ending in ``edges``: the directed hull edges of distinct points (optionally in groups ``by``)."""
    same = lambda a, b: f"{a}.{by}={b}.{by} AND " if by else ""
    key = f"a.{by}," if by else ""
    return f"""pp AS (SELECT DISTINCT {by + "," if by else ""} lon, lat FROM {points}),
    edges AS (SELECT {key} a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2 FROM pp a JOIN pp b ON {same("a", "b")} (a.lon<>b.lon OR a.lat<>b.lat)
    WHERE NOT EXISTS (SELECT 1 FROM pp c WHERE {same("c", "a")} ((b.lon-a.lon)*(c.lat-a.lat)-(b.lat-a.lat)*(c.lon-a.lon)<0
      OR ((b.lon-a.lon)*(c.lat-a.lat)-(b.lat-a.lat)*(c.lon-a.lon)=0 AND ((c.lon-a.lon)*(c.lon-b.lon)+(c.lat-a.lat)*(c.lat-b.lat)>0)))))"""


def kmeans(k: int, rounds: int) -> str:
    """Rounds written out one after the other."""
    ctes = [f"n AS (SELECT count(*) AS n FROM geo_blobs), r AS (SELECT id, lon, lat, row_number() OVER (ORDER BY id)-1 AS rn FROM geo_blobs), c0 AS (SELECT i AS c, lon AS x, lat AS y FROM range({k}) t(i) JOIN r ON r.rn=i*(SELECT n FROM n)//{k})"]
    for t in range(rounds):
        ctes.append(f"l{t} AS MATERIALIZED (SELECT r.id, r.lon, r.lat, arg_min(c, {{'d': (lon-x)*(lon-x)+(lat-y)*(lat-y), 'c': c}}) AS cluster FROM r CROSS JOIN c{t} GROUP BY r.id, r.lon, r.lat)")
        ctes.append(f"c{t + 1} AS MATERIALIZED (SELECT c{t}.c, coalesce(avg(lon), any_value(x)) AS x, coalesce(avg(lat), any_value(y)) AS y FROM c{t} LEFT JOIN l{t} ON l{t}.cluster=c{t}.c GROUP BY c{t}.c)")
    return "WITH " + ", ".join(ctes) + f" SELECT id, cluster::BIGINT AS cluster FROM l{rounds - 1}"


_D = dest("lon1", "lat1", "bearing", "km*1000")
_STRAIGHT = f"(radians(lat1)+km*1000/{R}*cos(radians(bearing)))"
_PHI2 = f"(CASE WHEN abs({_STRAIGHT})>pi()/2 THEN CASE WHEN {_STRAIGHT}>0 THEN pi()-{_STRAIGHT} ELSE -pi()-{_STRAIGHT} END ELSE {_STRAIGHT} END)"
_MID = ("(cos(radians(lat2))*cos(radians(lon2-lon1)))", "(cos(radians(lat2))*sin(radians(lon2-lon1)))")
_CIRCLE = dest("lon1", "lat1", "k*360.0::DOUBLE/8", "km*1000")
_DOT = "greatest(-1.0::DOUBLE,least(1.0::DOUBLE,cos(radians(lat1))*cos(radians(lon1))*cos(radians(lat2))*cos(radians(lon2))+cos(radians(lat1))*sin(radians(lon1))*cos(radians(lat2))*sin(radians(lon2))+sin(radians(lat1))*sin(radians(lat2))))"
_BOX = "b AS (SELECT nk, min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM geo_hex GROUP BY nk)"
_CORNERS = "SELECT nk, k AS ix, CASE WHEN k IN (1,2) THEN x1 ELSE x0 END AS lon, CASE WHEN k IN (2,3) THEN y1 ELSE y0 END AS lat FROM b CROSS JOIN range(5) r(k)"
_RING = f"""ring AS (SELECT nk, k AS ix, {", ".join(f"{x} AS {n}" for x, n in zip(dest("lon0", "lat0", "k*360.0::DOUBLE/8", "rad"), ("lon", "lat")))} FROM far CROSS JOIN range(8) r(k))"""
_BLOB_NEAR = f"near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM geo_blobs a JOIN geo_blobs b ON {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')}<=20000)"
_MOVED = "i AS (SELECT nk, ix, lon+9 AS lon, lat+4 AS lat FROM geo_hex)"

_PATHS_OF_TWO = "SELECT * FROM geo_path WHERE fid IN (SELECT fid FROM geo_path GROUP BY fid HAVING count(*)>1)"
_DET, _T, _U = "((a.x2-a.x1)*(b.y2-b.y1)-(a.y2-a.y1)*(b.x2-b.x1))", "((b.x1-a.x1)*(b.y2-b.y1)-(b.y1-a.y1)*(b.x2-b.x1))", "((b.x1-a.x1)*(a.y2-a.y1)-(b.y1-a.y1)*(a.x2-a.x1))"
#: ``touching``: (kind, id, nk), hexagons and the hexagons moved by (9, 4) that they intersect, paths and the hexagons that they intersect; ``within``: those whose vertices lie inside.
_TOUCHING = f"""left_v AS (SELECT 'hexagon' AS kind, nk::BIGINT AS id, ix::BIGINT AS ix, lon, lat FROM geo_hex UNION ALL SELECT 'path', fid, ix, lon, lat FROM ({_PATHS_OF_TWO})),
    right_v AS (SELECT 'hexagon' AS kind, nk::BIGINT AS nk, ix, lon+9 AS lon, lat+4 AS lat FROM geo_hex UNION ALL SELECT 'path', nk, ix, lon, lat FROM geo_hex),
    left_e AS MATERIALIZED (SELECT * FROM (SELECT kind, id, ix, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM left_v WINDOW w AS (PARTITION BY kind, id ORDER BY ix)) WHERE x2 IS NOT NULL),
    right_e AS MATERIALIZED (SELECT * FROM (SELECT kind, nk, ix, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM right_v WINDOW w AS (PARTITION BY kind, nk ORDER BY ix)) WHERE x2 IS NOT NULL),
    within AS MATERIALIZED (SELECT p.kind, p.id, p.ix, e.nk FROM left_v p JOIN right_e e ON e.kind=p.kind AND (e.y2>p.lat)<>(e.y1>p.lat) AND p.lon<(e.x1-e.x2)*(p.lat-e.y2)/(CASE WHEN e.y1=e.y2 THEN 1 ELSE e.y1-e.y2 END)+e.x2 GROUP BY p.kind, p.id, p.ix, e.nk HAVING count(*)%2=1),
    within_other AS MATERIALIZED (SELECT p.kind, p.nk, p.ix, e.id FROM right_v p JOIN left_e e ON p.kind='hexagon' AND e.kind=p.kind AND (e.y2>p.lat)<>(e.y1>p.lat) AND p.lon<(e.x1-e.x2)*(p.lat-e.y2)/(CASE WHEN e.y1=e.y2 THEN 1 ELSE e.y1-e.y2 END)+e.x2 GROUP BY p.kind, p.nk, p.ix, e.id HAVING count(*)%2=1),
    touching AS MATERIALIZED (SELECT DISTINCT a.kind, a.id, b.nk FROM left_e a JOIN right_e b ON a.kind=b.kind AND abs({_DET})>=1e-14 AND {_T}/{_DET} BETWEEN -1e-10 AND 1+1e-10 AND {_U}/{_DET} BETWEEN -1e-10 AND 1+1e-10
        UNION SELECT kind, id, nk FROM within WHERE ix=(CASE kind WHEN 'path' THEN 1 ELSE 0 END) UNION SELECT kind, id, nk FROM within_other WHERE ix=0)"""



def ring(points: str, key: str, digits: int, middle: str = "") -> str:
    """Common tables ending in ``ring``: the edges, counter-clockwise, of the convex polygons whose corners are ``points`` (key, x, y) in any order; ``middle`` has a point inside each, else it is the mean corner."""
    inside = middle or f"SELECT {key}, avg(x) AS cx, avg(y) AS cy FROM rd GROUP BY {key}"
    return f"""rd AS (SELECT DISTINCT {key}, round(x,{digits}) AS x, round(y,{digits}) AS y FROM {points}), mid AS ({inside}),
    o AS (SELECT {key}, x, y, row_number() OVER (PARTITION BY {key} ORDER BY atan2(y-cy,x-cx)) AS i, count(*) OVER (PARTITION BY {key}) AS n FROM rd JOIN mid USING ({key})),
    ring AS (SELECT a.{key}, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM o a JOIN o b ON a.{key}=b.{key} AND b.i=a.i%a.n+1)"""


def _corners_in(a: str, b: str) -> str:
    """Corners of convex polygons inside the others."""
    return f"SELECT a.nk, a.x1 AS x, a.y1 AS y FROM {a} a JOIN {b} b USING (nk) GROUP BY a.nk, a.x1, a.y1 HAVING min((b.x2-b.x1)*(a.y1-b.y1)-(b.y2-b.y1)*(a.x1-b.x1))>=0"


#: What each hexagon shares with its copy moved by (9, 4): corners of one inside the other, and crossings of their edges.
_SHARED = f"""{HEX_EDGES}, f AS (SELECT nk, x1+9 AS x1, y1+4 AS y1, x2+9 AS x2, y2+4 AS y2 FROM e),
    sv AS ({_corners_in("e", "f")} UNION ALL {_corners_in("f", "e")} UNION ALL SELECT a.nk, a.x1+{_T}/{_DET}*(a.x2-a.x1), a.y1+{_T}/{_DET}*(a.y2-a.y1) FROM e a JOIN f b USING (nk) WHERE abs({_DET})>=1e-14 AND {_T}/{_DET} BETWEEN 0 AND 1 AND {_U}/{_DET} BETWEEN 0 AND 1),
    {ring("sv", "nk", 6)}"""


def _from(k: str, low: str, high: str) -> str:
    return f"CASE WHEN d{k}>0 THEN ({low}-{k})/d{k} WHEN d{k}<0 THEN ({high}-{k})/d{k} END"


#: Pieces of path segments in the middle half of the path's box; pieces that follow on one another make up a part.
_CLIPPED = f"""{PATHS}, w AS (SELECT fid, min(lon) AS a0, min(lat) AS a1, max(lon) AS a2, max(lat) AS a3 FROM p GROUP BY fid),
    b AS (SELECT fid, a0+(a2-a0)/4 AS bx0, a1+(a3-a1)/4 AS by0, a2+(a0-a2)/4 AS bx1, a3+(a1-a3)/4 AS by1 FROM w),
    s AS (SELECT fid, ix, lag(lon) OVER o AS x, lag(lat) OVER o AS y, lon-lag(lon) OVER o AS dx, lat-lag(lat) OVER o AS dy FROM p WINDOW o AS (PARTITION BY fid ORDER BY ix)),
    r AS (SELECT s.*, greatest({d(0)},{_from("x", "bx0", "bx1")},{_from("y", "by0", "by1")}) AS t0, least({d(1)},{_from("x", "bx1", "bx0")},{_from("y", "by1", "by0")}) AS t1 FROM s JOIN b USING (fid)
      WHERE x IS NOT NULL AND (dx<>0 OR x BETWEEN bx0 AND bx1) AND (dy<>0 OR y BETWEEN by0 AND by1)),
    i AS (SELECT fid, ix, x+t0*dx AS x1, y+t0*dy AS y1, x+t1*dx AS x2, y+t1*dy AS y2 FROM r WHERE t0<=t1),
    g AS (SELECT *, coalesce(lag(ix) OVER o=ix-1,false) AS follows, greatest(abs(lag(x2) OVER o-x1),abs(lag(y2) OVER o-y1))<=1e-10 AS meets FROM i WINDOW o AS (PARTITION BY fid ORDER BY ix)),
    c AS (SELECT *, sum(CASE WHEN follows AND meets THEN 0 ELSE 1 END) OVER (PARTITION BY fid ORDER BY ix) AS run FROM g),
    k AS (SELECT *, dense_rank() OVER (PARTITION BY fid ORDER BY run)-1 AS part FROM c WHERE NOT follows OR greatest(abs(x2-x1),abs(y2-y1))>1e-10),
    n AS (SELECT fid, max(part) AS most FROM k GROUP BY fid)"""
#: Vertices that stay: a range of vertices is cut at the one farthest from its chord, if that is beyond the tolerance.
_SIMPLER = f"""{PATHS}, q(fid, i, j) AS (SELECT fid, min(ix), max(ix) FROM p GROUP BY fid UNION ALL
    SELECT m.fid, CASE u.h WHEN 0 THEN m.i ELSE m.k END, CASE u.h WHEN 0 THEN m.k ELSE m.j END FROM (
      SELECT fid, i, j, arg_max(k, {{'away': away, 'back': -k}}) AS k FROM (
        SELECT fid, i, j, k, sqrt(pow(px-(ax+t*dx),2)+pow(py-(ay+t*dy),2)) AS away FROM (
          SELECT *, CASE WHEN abs(dx)<1e-15 AND abs(dy)<1e-15 THEN 0 ELSE least({d(1)},greatest({d(0)},((px-ax)*dx+(py-ay)*dy)/(dx*dx+dy*dy))) END AS t FROM (
            SELECT q.fid, q.i, q.j, v.ix AS k, v.lon AS px, v.lat AS py, a.lon AS ax, a.lat AS ay, z.lon-a.lon AS dx, z.lat-a.lat AS dy
            FROM q JOIN p a ON a.fid=q.fid AND a.ix=q.i JOIN p z ON z.fid=q.fid AND z.ix=q.j JOIN p v ON v.fid=q.fid AND v.ix>q.i AND v.ix<q.j)))
      GROUP BY fid, i, j HAVING max(away)>0.5) m CROSS JOIN (VALUES (0),(1)) u(h)),
    stay AS (SELECT fid, i AS ix FROM q UNION SELECT fid, j FROM q)"""
_IN_WORLD = "x BETWEEN -180-1e-9 AND 180+1e-9 AND y BETWEEN -90-1e-9 AND 90+1e-9"
#: Corners of the cells: where bisectors meet one another or the box, or the box's corners, if no other site is nearer.
_CELLS = f"""s AS (SELECT id, lon AS x, lat AS y FROM geo_sites),
    l AS MATERIALIZED (SELECT i.id, j.id AS j, j.x-i.x AS a, j.y-i.y AS b, (j.x*j.x+j.y*j.y-i.x*i.x-i.y*i.y)/2 AS c FROM s i JOIN s j ON i.id<>j.id),
    v AS (SELECT p.id, (p.c*q.b-q.c*p.b)/(p.a*q.b-q.a*p.b) AS x, (p.a*q.c-q.a*p.c)/(p.a*q.b-q.a*p.b) AS y FROM l p JOIN l q ON p.id=q.id AND p.j<q.j AND abs(p.a*q.b-q.a*p.b)>1e-12
      UNION ALL SELECT id, {d("w")}, (c-a*w)/b FROM l CROSS JOIN (VALUES (-180),(180)) t(w) WHERE b<>0 UNION ALL SELECT id, (c-b*w)/a, {d("w")} FROM l CROSS JOIN (VALUES (-90),(90)) t(w) WHERE a<>0
      UNION ALL SELECT id, {d("w")}, {d("h")} FROM s CROSS JOIN (VALUES (-180),(180)) t(w) CROSS JOIN (VALUES (-90),(90)) u(h)),
    k AS (SELECT m.* FROM (SELECT * FROM v WHERE {_IN_WORLD}) m WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.id=m.id AND l.a*m.x+l.b*m.y>l.c+1e-9)),
    {ring("k", "id", 4, "SELECT id, x AS cx, y AS cy FROM s")}"""

_ALL_PATHS = "p AS (SELECT * FROM geo_path)"
_BY_KEY = f"{PATHS}, k AS (SELECT fid%16 AS part, lon, lat FROM p)"
#: The paths' boxes as polygons, each with its area and middle in its own plane.
_BOXES_BY_KEY = f"""{PATHS}, b AS (SELECT fid, min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM p GROUP BY fid),
    q AS (SELECT *, fid%16 AS part, 3*y0+2*y1 AS lats, cos(radians((3*y0+2*y1)/5)) AS c FROM b),
    m AS (SELECT part, lats, {R}*{R}*radians(x1-x0)*c*radians(y1-y0) AS area, {R}*radians((x0+x1)/2)*c AS x, {R}*radians((y0+y1)/2) AS y FROM q),
    t AS (SELECT part, sum(area) AS area, sum(area*x)/sum(area) AS x, sum(area*y)/sum(area) AS y, sum(lats)/(5*count(*)) AS lat0 FROM m GROUP BY part)"""

_SQL: dict[str, tuple[list[str], str]] = {
    "intersect": (["geo_hex"], f"WITH {_SHARED} SELECT nk, 0::BIGINT AS ring, x1, y1, x2, y2 FROM ring"),
    "difference": (["geo_hex"], f"WITH {_SHARED} SELECT nk, 0::BIGINT AS ring, x1, y1, x2, y2 FROM e UNION ALL SELECT nk, 1, x2, y2, x1, y1 FROM ring"),
    "bboxClip": (["geo_path"], f"""WITH {_CLIPPED} SELECT b.fid, CASE most WHEN 0 THEN 'LineString' ELSE 'Multi' || CASE WHEN most>0 THEN 'LineString' END END AS type, part,
        round(x1,6) AS x1, round(y1,6) AS y1, round(x2,6) AS x2, round(y2,6) AS y2 FROM b LEFT JOIN n USING (fid) LEFT JOIN k USING (fid)"""),
    "simplify": (["geo_path"], f"WITH {_SIMPLER} SELECT fid, row_number() OVER (PARTITION BY fid ORDER BY ix)-1 AS ix, lon, lat FROM stay JOIN p USING (fid, ix)"),
    "voronoi": (["geo_sites"], f"WITH {_CELLS} SELECT id, x1, y1, x2, y2 FROM ring"),
    "alongRows": (["geo_path"], walk(d(100000)).replace(PATHS, _ALL_PATHS)),
    "lengthRows": (["geo_path"], f"WITH {SEGS.replace(PATHS, _ALL_PATHS)}, l AS (SELECT fid, sum(m) AS m FROM g GROUP BY fid) SELECT fid, round(coalesce(l.m,0)/1000,3) AS km FROM (SELECT DISTINCT fid FROM geo_path) LEFT JOIN l USING (fid)"),
    "pointOnPathRows": (["geo_path"], walk("sum(m) OVER (PARTITION BY fid)/2").replace(PATHS, _ALL_PATHS)),
    "areaByKey": (["geo_path"], f"WITH {_BOXES_BY_KEY} SELECT part, round(area/1000000,3) AS km2 FROM t"),
    "bboxByKey": (["geo_path"], f"WITH {_BY_KEY} SELECT part, min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM k GROUP BY part"),
    "centerByKey": (["geo_path"], f"WITH {_BY_KEY} SELECT part, {at('(min(lon)+max(lon))/2', '(min(lat)+max(lat))/2')} FROM k GROUP BY part"),
    "centerOfMassByKey": (["geo_path"], f"WITH {_BOXES_BY_KEY} SELECT part, {at(f'degrees(x/({R}*cos(radians(lat0))))', f'degrees(y/{R})')} FROM t"),
    "centroidByKey": (["geo_path"], f"WITH {_BY_KEY} SELECT part, {at('avg(lon)', 'avg(lat)', 8)} FROM k GROUP BY part"),
    "envelopeByKey": (["geo_path"], f"WITH {_BY_KEY}, b AS (SELECT part, min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM k GROUP BY part) {_CORNERS.replace('nk', 'part')}"),
    "along": (["geo_path"], walk(d(100000))),
    "area": (["geo_hex"], f"WITH {HEX_PLANE} SELECT nk, round(abs(s)/1000000,3) AS km2 FROM a"),
    "bbox": (["geo_path"], f"WITH {PATHS} SELECT fid, min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM p GROUP BY fid"),
    "bboxPolygon": (["geo_hex"], f"WITH {_BOX} {_CORNERS}"),
    "bearing": (["geo_pairs"], f"SELECT id, round({brg()},6) AS deg FROM geo_pairs"),
    "center": (["geo_path"], f"WITH {PATHS} SELECT fid, {at('(min(lon)+max(lon))/2', '(min(lat)+max(lat))/2')} FROM p GROUP BY fid"),
    "centerOfMass": (["geo_hex"], f"WITH {HEX_PLANE} SELECT nk, {at(f'degrees(sx/(6*s)/({R}*c))', f'degrees(sy/(6*s)/{R})')} FROM a"),
    "centroid": (["geo_path"], f"WITH {PATHS} SELECT fid, {at('avg(lon)', 'avg(lat)', 10)} FROM p GROUP BY fid"),
    "destination": (["geo_pairs"], f"SELECT id, {at(*_D)} FROM geo_pairs"),
    "distance": (["geo_pairs"], f"SELECT id, round({hav()},3) AS m FROM geo_pairs"),
    "envelope": (["geo_hex"], f"WITH {_BOX} {_CORNERS}"),
    "length": (["geo_path"], f"WITH {SEGS} SELECT fid, round(sum(m)/1000,3) AS km FROM g GROUP BY fid"),
    "midpoint": (["geo_pairs"], f"SELECT id, {at(lon180(f'degrees(radians(lon1)+atan2({_MID[1]},cos(radians(lat1))+{_MID[0]}))'), f'degrees(atan2(sin(radians(lat1))+sin(radians(lat2)),sqrt(pow(cos(radians(lat1))+{_MID[0]},2)+pow({_MID[1]},2))))')} FROM geo_pairs"),
    "pointOnFeature": (["geo_path"], walk("sum(m) OVER (PARTITION BY fid)/2")),
    "pointToLineDistance": (["geo_path"], f"""WITH {SEGS}, o AS (SELECT fid, avg(lon) AS lon, avg(lat) AS lat FROM p GROUP BY fid),
        z AS (SELECT fid, {R}*radians(lon1-lon)*cos(radians(lat)) AS ax, {R}*radians(lat1-lat) AS ay, {R}*radians(lon2-lon1)*cos(radians(lat)) AS dx, {R}*radians(lat2-lat1) AS dy FROM g JOIN o USING (fid)),
        y AS (SELECT *, CASE WHEN dx*dx+dy*dy<=1e-18 THEN 0 ELSE greatest(0,least(1,-(ax*dx+ay*dy)/(dx*dx+dy*dy))) END AS t FROM z)
        SELECT fid, round(min(sqrt(pow(ax+t*dx,2)+pow(ay+t*dy,2)))/1000,3) AS km FROM y GROUP BY fid"""),
    "rhumbBearing": (["geo_pairs"], f"SELECT id, round({turn(f'degrees(atan2({SHORT},{PSI}))')},6) AS deg FROM geo_pairs"),
    "rhumbDestination": (["geo_pairs"], f"""WITH z AS (SELECT *, {_PHI2} AS phi2, km*1000/{R} AS delta FROM geo_pairs),
        y AS (SELECT *, ln(tan(phi2/2+pi()/4)/tan(radians(lat1)/2+pi()/4)) AS psi FROM z),
        x AS (SELECT *, CASE WHEN abs(psi)>1e-12 THEN (phi2-radians(lat1))/psi ELSE cos(radians(lat1)) END AS q FROM y)
        SELECT id, {at(lon180('degrees(radians(lon1)+delta*sin(radians(bearing))/q)'), 'degrees(phi2)')} FROM x"""),
    "rhumbDistance": (["geo_pairs"], f"SELECT id, round({R}*sqrt(pow(radians(lat2-lat1),2)+pow(CASE WHEN abs({PSI})>1e-12 THEN (radians(lat2)-radians(lat1))/{PSI} ELSE cos(radians(lat1)) END*{SHORT},2)),3) AS m FROM geo_pairs"),
    "square": (["geo_hex"], f"WITH {_BOX} SELECT nk, (x0+x1)/2-greatest(x1-x0,y1-y0)/2 AS x0, (y0+y1)/2-greatest(x1-x0,y1-y0)/2 AS y0, (x0+x1)/2+greatest(x1-x0,y1-y0)/2 AS x1, (y0+y1)/2+greatest(x1-x0,y1-y0)/2 AS y1 FROM b"),
    "greatCircle": (["geo_pairs"], f"""WITH z AS (SELECT *, acos({_DOT}) AS om FROM geo_pairs), y AS (SELECT *, k, sin((1-k/4.0::DOUBLE)*om)/sin(om) AS a, sin(k/4.0::DOUBLE*om)/sin(om) AS b FROM z CROSS JOIN range(5) r(k)),
        x AS (SELECT id, k, lon1, lat1, lon2, lat2, a*cos(radians(lat1))*cos(radians(lon1))+b*cos(radians(lat2))*cos(radians(lon2)) AS x, a*cos(radians(lat1))*sin(radians(lon1))+b*cos(radians(lat2))*sin(radians(lon2)) AS y, a*sin(radians(lat1))+b*sin(radians(lat2)) AS z FROM y)
        SELECT id, k AS ix, CASE k WHEN 0 THEN round(lon1,6) WHEN 4 THEN round(lon2,6) ELSE round({lon180('degrees(atan2(y,x))')},6) END AS lon, CASE k WHEN 0 THEN round(lat1,6) WHEN 4 THEN round(lat2,6) ELSE round(degrees(atan2(z,sqrt(x*x+y*y))),6) END AS lat FROM x"""),
    "polygonTangents": (["geo_hex"], """WITH v AS (SELECT nk, ix, lon, lat, atan2(lat-CAST(0.5 AS DOUBLE), lon-CAST(0.25 AS DOUBLE)) AS a FROM geo_hex)
        SELECT nk, arg_min(lon, {'a': a, 'i': ix}) AS left_lon, arg_min(lat, {'a': a, 'i': ix}) AS left_lat, arg_max(lon, {'a': a, 'i': -ix}) AS right_lon, arg_max(lat, {'a': a, 'i': -ix}) AS right_lat FROM v GROUP BY nk"""),
    "booleanClockwise": (["geo_hex"], f"WITH {HEX_EDGES} SELECT nk, sum(x1*y2-x2*y1)<0 AS value FROM e GROUP BY nk"),
    "booleanContains": (["geo_hex", "geo_pts"], f"WITH {INSIDE} SELECT nk, id FROM pip"),
    "booleanWithin": (["geo_hex", "geo_pts"], f"WITH {INSIDE} SELECT nk, id FROM pip"),
    "booleanPointInPolygon": (["geo_hex", "geo_pts"], f"WITH {INSIDE} SELECT nk, id FROM pip"),
    "booleanCrosses": (["geo_path"], """WITH s AS (SELECT fid, ix, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2, count(*) OVER (PARTITION BY fid) AS n FROM geo_path WINDOW w AS (PARTITION BY fid ORDER BY ix)),
        f AS (SELECT DISTINCT fid FROM s WHERE n>1), g AS (SELECT * FROM s WHERE x2 IS NOT NULL),
        m AS (SELECT a.fid, (a.x2-a.x1)*(b.y2-b.y1)-(a.y2-a.y1)*(b.x2-b.x1) AS det, (b.x1-a.x1)*(b.y2-b.y1)-(b.y1-a.y1)*(b.x2-b.x1) AS t, (b.x1-a.x1)*(a.y2-a.y1)-(b.y1-a.y1)*(a.x2-a.x1) AS u FROM g a JOIN g b ON a.fid=b.fid AND a.ix<a.n//2 AND b.ix>b.n//2)
        SELECT f.fid, coalesce(bool_or(abs(det)>=1e-14 AND t/det>1e-10 AND t/det<1-1e-10 AND u/det>1e-10 AND u/det<1-1e-10),false) AS value FROM f LEFT JOIN m USING (fid) GROUP BY f.fid"""),
    "booleanDisjoint": (["geo_hex", "geo_pts", "geo_path"], f"""WITH {INSIDE}, {_TOUCHING}, x AS (SELECT 'point' AS kind, nk, count(*) AS n FROM pip GROUP BY nk UNION ALL SELECT 'path', nk, count(*) FROM touching WHERE kind='path' GROUP BY nk),
        w AS (SELECT 'point' AS kind, count(*) AS whole FROM geo_pts UNION ALL SELECT 'path', count(DISTINCT fid) FROM ({_PATHS_OF_TWO}))
        SELECT w.kind, h.nk, whole-coalesce(n,0) AS n FROM (SELECT DISTINCT nk FROM geo_hex) h CROSS JOIN w LEFT JOIN x ON x.nk=h.nk AND x.kind=w.kind"""),
    "booleanEqual": (["geo_hex", "geo_path"], """WITH v AS (SELECT 'hexagon' AS kind, nk::BIGINT AS id, ix::BIGINT AS ix, lon, lat FROM geo_hex UNION ALL SELECT 'path', fid, ix, lon, lat FROM geo_path),
        n AS (SELECT kind, id, count(*) AS n FROM v GROUP BY kind, id), m AS (SELECT a.kind, a.id AS a, b.id AS b, count(*) AS n FROM v a JOIN v b ON a.kind=b.kind AND a.ix=b.ix AND a.lon=b.lon AND a.lat=b.lat GROUP BY a.kind, a.id, b.id)
        SELECT m.kind, m.a, m.b FROM m JOIN n x ON x.kind=m.kind AND x.id=m.a JOIN n y ON y.kind=m.kind AND y.id=m.b WHERE m.n=x.n AND m.n=y.n AND m.n>1"""),
    "booleanParallel": (["geo_path"], f"""WITH {PATHS}, c AS (SELECT fid, arg_max(lon,ix)-arg_min(lon,ix) AS x, arg_max(lat,ix)-arg_min(lat,ix) AS y FROM p GROUP BY fid)
        SELECT a.fid, abs(a.x*b.y-a.y*b.x)/(sqrt(a.x*a.x+a.y*a.y)*sqrt(b.x*b.x+b.y*b.y))<1e-8 AS value FROM c a JOIN c b ON b.fid=a.fid+1"""),
    "booleanPointOnLine": (["geo_path"], f"""WITH {PATHS}, e AS (SELECT *, first_value(lon) OVER u AS xa, first_value(lat) OVER u AS ya, first_value(lon) OVER d AS xb, first_value(lat) OVER d AS yb FROM p WINDOW u AS (PARTITION BY fid ORDER BY ix), d AS (PARTITION BY fid ORDER BY ix DESC))
        SELECT fid, ix, NOT (abs(lon-xa)<1e-12 AND abs(lat-ya)<1e-12 OR abs(lon-xb)<1e-12 AND abs(lat-yb)<1e-12) AS value FROM e"""),
    "collect": (["geo_hex", "geo_pts"], f"WITH {INSIDE}, x AS (SELECT nk, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM pip GROUP BY nk) SELECT h.nk, coalesce(n,0)::BIGINT AS n, coalesce(ids,'') AS ids FROM (SELECT DISTINCT nk FROM geo_hex) h LEFT JOIN x USING (nk)"),
    "clustersDbscan": (["geo_blobs"], f"""WITH {_BLOB_NEAR}, core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*)>=4), ce AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
        reach AS (SELECT id, id AS root FROM core UNION SELECT ce.a, reach.root FROM reach JOIN ce ON ce.b=reach.id),
        roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id), nums AS (SELECT id, dense_rank() OVER (ORDER BY root)-1 AS cluster FROM roots),
        border AS (SELECT a AS id, min(cluster) AS cluster FROM near JOIN nums ON nums.id=near.b GROUP BY a)
        SELECT p.id, coalesce(nums.cluster, border.cluster, -1)::BIGINT AS cluster FROM geo_blobs p LEFT JOIN nums USING (id) LEFT JOIN border USING (id)"""),
    "clustersKmeans": (["geo_blobs"], kmeans(5, 100)),
    "nearestPoint": (["geo_sites", "geo_pts"], f"WITH m AS (SELECT p.id AS tid, s.id AS fid, {hav('p.lon', 'p.lat', 's.lon', 's.lat')} AS m FROM geo_pts p CROSS JOIN geo_sites s) SELECT tid, arg_min(fid, {{'m': m, 'f': fid}}) AS fid, round(min(m),3) AS meters FROM m GROUP BY tid"),
    "bezierSpline": (["geo_path"], f"""WITH {PATHS}, s AS (SELECT fid, ix, lon, lat, lead(lon) OVER w AS x, lead(lat) OVER w AS y, max(ix) OVER (PARTITION BY fid) AS n FROM p WINDOW w AS (PARTITION BY fid ORDER BY ix)),
        o AS (SELECT fid, 0 AS ix, lon, lat FROM s WHERE ix=1 UNION ALL SELECT fid, 2*ix-1, 0.75*lon+0.25*x, 0.75*lat+0.25*y FROM s WHERE ix<n UNION ALL SELECT fid, 2*ix, 0.25*lon+0.75*x, 0.25*lat+0.75*y FROM s WHERE ix<n UNION ALL SELECT fid, 2*n-1, lon, lat FROM s WHERE ix=n)
        SELECT fid, ix::BIGINT AS ix, {at('lon', 'lat')} FROM o"""),
    "buffer": (["geo_hex"], f"WITH {MEAN}, far AS (SELECT nk, any_value(lon0) AS lon0, any_value(lat0) AS lat0, max({hav('lon0', 'lat0', 'lon', 'lat')})+50000 AS rad FROM geo_hex JOIN m USING (nk) GROUP BY nk), {_RING} SELECT nk, ix::BIGINT AS ix, {at('lon', 'lat')} FROM ring"),
    "circle": (["geo_pairs"], f"SELECT id, k AS ix, {at(*_CIRCLE)} FROM geo_pairs CROSS JOIN range(8) r(k)"),
    "clone": (["geo_hex"], "SELECT nk, ix::BIGINT AS ix, lon, lat FROM geo_hex"),
    "convex": (["geo_sites"], f"WITH {hull_edges('geo_sites')} SELECT x1, y1, x2, y2 FROM edges"),
    "concave": (["geo_sites"], f"WITH {hull_edges('geo_sites')} SELECT x1, y1, x2, y2 FROM edges"),
    "dissolve": (["geo_hex"], f"WITH g AS (SELECT nk%5 AS k, lon, lat FROM geo_hex), {hull_edges('g', 'k')} SELECT k::VARCHAR AS key, x1, y1, x2, y2 FROM edges"),
    "union": (["geo_hex"], f"WITH {_MOVED}, g AS (SELECT nk, lon, lat FROM geo_hex UNION ALL SELECT nk, lon, lat FROM i), {hull_edges('g', 'nk')} SELECT nk, x1, y1, x2, y2 FROM edges"),
    "lineOffset": (["geo_path"], f"""WITH {PATHS}, o AS (SELECT fid, avg(lon) AS lon0, avg(lat) AS lat0 FROM p GROUP BY fid),
        f AS (SELECT fid, ix, lon0, lat0, {R}*radians(lon-lon0)*cos(radians(lat0)) AS x, {R}*radians(lat-lat0) AS y FROM p JOIN o USING (fid)),
        v AS (SELECT *, lead(x) OVER w-x AS dx, lead(y) OVER w-y AS dy FROM f WINDOW w AS (PARTITION BY fid ORDER BY ix)),
        u AS (SELECT *, -dy/sqrt(dx*dx+dy*dy) AS nx, dx/sqrt(dx*dx+dy*dy) AS ny FROM v),
        t AS (SELECT *, lag(nx) OVER w AS px, lag(ny) OVER w AS py FROM u WINDOW w AS (PARTITION BY fid ORDER BY ix)),
        r AS (SELECT *, CASE WHEN px IS NULL THEN nx WHEN nx IS NULL THEN px WHEN sqrt(pow(nx+px,2)+pow(ny+py,2))<=1e-12 THEN nx ELSE (nx+px)/sqrt(pow(nx+px,2)+pow(ny+py,2)) END AS ox, CASE WHEN px IS NULL THEN ny WHEN nx IS NULL THEN py WHEN sqrt(pow(nx+px,2)+pow(ny+py,2))<=1e-12 THEN ny ELSE (ny+py)/sqrt(pow(nx+px,2)+pow(ny+py,2)) END AS oy FROM t)
        SELECT fid, ix-1 AS ix, {from_plane('x+ox*50', 'y+oy*50')} FROM r"""),
    "tesselate": (["geo_hex"], "SELECT a.nk, b.ix::BIGINT-1 AS tri, a.lon AS x0, a.lat AS y0, b.lon AS x1, b.lat AS y1, c.lon AS x2, c.lat AS y2 FROM geo_hex a JOIN geo_hex b ON a.nk=b.nk AND a.ix=0 AND b.ix BETWEEN 1 AND 4 JOIN geo_hex c ON c.nk=b.nk AND c.ix=b.ix+1"),
    "transformRotate": (["geo_hex"], f"WITH {MEAN}, {PLANE} SELECT nk, ix::BIGINT AS ix, {from_plane('x*cos(radians(-30))-y*sin(radians(-30))', 'x*sin(radians(-30))+y*cos(radians(-30))')} FROM t"),
    "transformScale": (["geo_hex"], f"WITH {MEAN}, {PLANE} SELECT nk, ix::BIGINT AS ix, {from_plane('x*0.5', 'y*0.5')} FROM t"),
    "transformTranslate": (["geo_pairs"], f"SELECT id, {at(*_D)} FROM geo_pairs"),
    "booleanOverlap": (["geo_hex", "geo_path"], f"""WITH {_TOUCHING}, c AS (SELECT kind, id, nk, count(*) AS n FROM within GROUP BY kind, id, nk), s AS (SELECT kind, id, count(*) AS n FROM left_v GROUP BY kind, id),
        r AS (SELECT id, nk, count(*) AS n FROM within_other GROUP BY id, nk)
        SELECT t.kind, t.id AS a, t.nk AS b FROM touching t JOIN s ON s.kind=t.kind AND s.id=t.id LEFT JOIN c ON c.kind=t.kind AND c.id=t.id AND c.nk=t.nk LEFT JOIN r ON t.kind='hexagon' AND r.id=t.id AND r.nk=t.nk WHERE coalesce(c.n,0)<s.n AND coalesce(r.n,0)<7"""),
}

ORACLE_SQL: dict[str, str] = {name: with_views(views, body) for name, (views, body) in _SQL.items()}
