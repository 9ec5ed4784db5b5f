"""DuckDB SQL for the registered queries, over the driver's tables."""

from __future__ import annotations

import math

#: The fixtures: odometry o, poses p, scans s, world points w.
O = """o as (select user_id graph_id, row_number() over (partition by user_id order by ts, event_id) - 1 pose_id, ts, event_id, value,
 value / 100 dx, (json_extract_string(props, '$.k')::double - 50) * 0.02 dth, 1e-3 * (1 + json_extract_string(props, '$.k')::double / 100) var_t, 1e-4 * (1 + value / 500) var_r from events)"""
P = (
    O
    + """, pa as (select *, sum(dth) over (partition by graph_id order by pose_id) th from o),
pb as (select *, coalesce(lag(th) over (partition by graph_id order by pose_id), 0) thp from pa),
p as (select graph_id, pose_id, th, var_t, var_r, sum(dx * cos(thp)) over (partition by graph_id order by pose_id) x, sum(dx * sin(thp)) over (partition by graph_id order by pose_id) y from pb)"""
)
S = """v as (select label::bigint graph_id, row_number() over (partition by label order by vec_id) - 1 pose_id, embedding e from embeddings),
s0 as (select graph_id, pose_id, i obs_id, e[2 * i + 1]::double px, e[2 * i + 2]::double py from v, range(32) t(i)),
s as (select *, cos(atan2(py, px)) nx, sin(atan2(py, px)) ny from s0)"""
W = P + ", " + S + """, w as (select s.*, x, y, th, x + px * cos(th) - py * sin(th) wx, y + px * sin(th) + py * cos(th) wy, nx * cos(th) - ny * sin(th) wnx, nx * sin(th) + ny * cos(th) wny
from s join p using (graph_id, pose_id))"""


def rnd(x: str, digits: int = 6) -> str:
    return f"case when abs({x}) < {0.5 * 10**-digits:.12f} then 0.0 else round({x}, {digits}) end"


def cols(values: str, digits: int = 6) -> str:
    """``name=expression`` items, parted by semicolons, rounded."""
    items = [v.strip().split("=", 1) for v in values.split(";")]
    return ", ".join(f"{rnd(e.strip(), digits)} {n.strip()}" for n, e in items)


def wrap(a: str) -> str:
    return f"atan2(sin({a}), cos({a}))"


X0, Y0, X1, Y1 = "(-1.0)", "0.0", "1.0", "0.5"
NUM, DEN = f"((wx - {X0}) * ({X1} - {X0}) + (wy - {Y0}) * ({Y1} - {Y0}))", "4.25"


def seg(px: str, py: str, x0: str, y0: str, x1: str, y1: str) -> str:
    t = f"least(greatest((({px} - {x0}) * ({x1} - {x0}) + ({py} - {y0}) * ({y1} - {y0})) / (({x1} - {x0}) * ({x1} - {x0}) + ({y1} - {y0}) * ({y1} - {y0})), 0), 1)"
    return f"sqrt(power({px} - ({x0} + {t} * ({x1} - {x0})), 2) + power({py} - ({y0} + {t} * ({y1} - {y0})), 2))"


def draw(seed: int, part: int, *keys: str) -> str:
    """One of the three draws of a digest, as functions/draws.py makes it."""
    return f"(('0x' || substr(md5('{seed},' || {" || ',' || ".join(keys)}), {1 + 10 * part}, 10))::bigint / 1099511627776.0)"


def bell(seed: int, *keys: str) -> tuple[str, str]:
    u, v = draw(seed, 0, *keys), draw(seed, 1, *keys)
    return tuple(f"(sqrt(-2 * ln(1 - {u})) * {f}(2 * pi() * {v}))" for f in ("cos", "sin"))


IDS = "graph_id, pose_id"
IDO = "graph_id, pose_id, obs_id"
ITEM = ("l_orderkey", "l_linenumber")
#: The wall points of the fixtures.
WALLS = """wi as (select (l_suppkey % 4)::bigint graph_id, (l_linenumber % 7)::bigint seg_id, ((l_orderkey * 7919 + l_partkey * 31) % 9973) / 9973.0 t, ((l_partkey * 17 + l_orderkey) % 61 - 30) / 30.0 * 0.05 far from lineitem),
wa as (select *, seg_id * 2.3 x0, (graph_id * 2 + seg_id * 3) % 5 * 1.7 y0, seg_id * 0.9 + graph_id a from wi),
walls as (select graph_id, seg_id, -sin(a) nx, cos(a) ny, x0 + t * 3.0 * cos(a) - far * sin(a) wx, y0 + t * 3.0 * sin(a) + far * cos(a) wy from wa)"""
L = math.sqrt(4.25)
EDGES = P + """, e0 as (select graph_id, pose_id, x, y, th, lag(x) over q x0, lag(y) over q y0, lag(th) over q th0 from p window q as (partition by graph_id order by pose_id)),
e as (select *, (x - x0) * cos(th0) + (y - y0) * sin(th0) lx, (y - y0) * cos(th0) - (x - x0) * sin(th0) ly, th - th0 - 2 * pi() * round_even((th - th0) / (2 * pi()), 0) rotation from e0 where x0 is not null)"""

# two selections, and the rules for their overlap
SEL = W + f""", hit as (select 1 sel_id, graph_id, pose_id, {seg("wx", "wy", X0, Y0, X1, Y1)} d from w union all select 2, graph_id, pose_id, {seg("wx", "wy", "2.0", "(-1.0)", "3.5", "1.0")} from w),
sel as (select sel_id, graph_id, pose_id from hit where d < 0.25 group by all having count(*) > 2),
ab as (select graph_id, pose_id, max((sel_id = 1)::int) a, max((sel_id = 2)::int) b from sel group by all),
sz as (select graph_id, sum(a) na, sum(b) nb, sum(a * b) co from ab group by 1),
j as (select ab.*, na, nb, co, co = na and co = nb as whole from ab join sz using (graph_id)),
ov as (select graph_id, pose_id, 1::bigint sel_id, case when whole then 'full_overlap' else 'ok' end state from j where a = 1 and (b = 0 or whole or co = na)
 union all select graph_id, pose_id, 2, case when whole then 'full_overlap' else 'ok' end from j where b = 1 and (a = 0 or whole or (co = nb and co <> na)))"""


def moved(kind: int) -> str:
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = [(0.0, 0.0), (2.0, 0.2), (0.1, 0.5), (2.0, 1.1)]
    ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
    full = f"(acos(({ux * vx + uy * vy!r}) / ({math.hypot(ux, uy) * math.hypot(vx, vy)!r})) * {1 if ux * vy - uy * vx >= 0 else -1})"
    theta = f"({full} - pi() / 2)" if kind == 5 else full
    px, py = (ax + bx) / 2, (ay + by) / 2
    qx, qy = (cx + dx) / 2, (cy + dy) / 2
    if kind == 4:
        n = math.hypot(vx, vy)
        a = ((px - qx) * vx + (py - qy) * vy) / n
        qx, qy = qx + a * vx / n, qy + a * vy / n
    if kind in (5, 6):
        qx, qy = px, py
    return f"select *, {theta} dth, {qx!r} + (x - {px!r}) * cos({theta}) - (y - {py!r}) * sin({theta}) mx, {qy!r} + (x - {px!r}) * sin({theta}) + (y - {py!r}) * cos({theta}) my from p"


def deltas(kind: int) -> str:
    return f"with {P}, m as ({moved(kind)}) select {IDS}, {cols('dx=mx - x; dy=my - y; dth=dth', 5)} from m"


BACK = P + """, r as (select *, var_r / (sum(var_r) over (partition by graph_id) + 1e-4) wr, var_t / (sum(var_t) over (partition by graph_id) + 1e-3) wt,
 lead(x) over (partition by graph_id order by pose_id) - x ex, lead(y) over (partition by graph_id order by pose_id) - y ey from p where pose_id between 5 and 30),
d as (select *, 0.3 * sum(wr) over (partition by graph_id order by pose_id) dk from r),
e as (select *, ex * cos(dk) - ey * sin(dk) rx, ex * sin(dk) + ey * cos(dk) ry from d),
f as (select *, first_value(x) over q + coalesce(sum(rx) over (partition by graph_id order by pose_id rows between unbounded preceding and 1 preceding), 0) x1,
 first_value(y) over q + coalesce(sum(ry) over (partition by graph_id order by pose_id rows between unbounded preceding and 1 preceding), 0) y1,
 th + case when pose_id < 30 then dk else coalesce(lag(dk) over q, 0) end th1, coalesce(sum(wt) over (partition by graph_id order by pose_id rows between unbounded preceding and 1 preceding), 0) cw from e window q as (partition by graph_id order by pose_id)),
g as (select graph_id, coalesce(max(case when pose_id = 30 then x + 0.7 - x1 end), 0) tx, coalesce(max(case when pose_id = 30 then y - 0.4 - y1 end), 0) ty from f group by 1)"""

NEXT = W + """, nn as (select a.graph_id, a.pose_id, a.obs_id, b.obs_id to_obs, sqrt(power(a.wx - b.wx, 2) + power(a.wy - b.wy, 2)) d, abs(a.wnx * (b.wx - a.wx) + a.wny * (b.wy - a.wy)) dn, a.wnx * b.wnx + a.wny * b.wny nc
 from w a join w b on a.graph_id = b.graph_id and b.pose_id = a.pose_id + 1 where sqrt(power(a.wx - b.wx, 2) + power(a.wy - b.wy, 2)) < 0.25)"""
STF = W + f""", c as (select a.graph_id, a.pose_id, a.obs_id, b.pose_id to_pose, b.obs_id to_obs, a.wx qx, a.wy qy, b.wx tx, b.wy ty, b.wnx tnx, b.wny tny, abs(a.wnx * (b.wx - a.wx) + a.wny * (b.wy - a.wy)) dn
 from w a join w b on a.graph_id = b.graph_id and a.pose_id <> b.pose_id and abs(a.pose_id - b.pose_id) <= 60 and abs(a.wx - b.wx) < 0.4 and abs(a.wy - b.wy) < 0.4
 where sqrt(power(a.wx - b.wx, 2) + power(a.wy - b.wy, 2)) < 0.4 and a.wnx * b.wnx + a.wny * b.wny > {math.cos(math.radians(60))!r}),
k1 as (select *, row_number() over (partition by graph_id, pose_id, obs_id, to_pose order by dn, to_obs) k from c),
k2 as (select *, row_number() over (partition by graph_id, pose_id, obs_id order by to_pose) cap from k1 where k = 1),
m as (select *, count(*) over (partition by graph_id, pose_id, to_pose) n_matches from k2 where cap <= 5 qualify n_matches > 2)"""

WALL = "(px * 0.6 + py * 0.8 - 0.5)"
SEEN = f"case when (2.3 - px) * (-1.3 - px) + (-1.1 - py) * (1.6 - py) > 0 or -0.5 * {WALL} > 0 then 0.0 else {WALL} end"
PAIR = "(nx * (px - 0.1) + ny * (py - 0.2))"

SDF = S + """, ray as (select *, sqrt(px * px + py * py) len from s where px <> 0 or py <> 0),
cell as (select graph_id, pose_id, obs_id, px, py, len, ix, iy, (px * (px - ix * 0.25) + py * (py - iy * 0.25)) / len sdf, abs(px * (iy * 0.25 - py) - py * (ix * 0.25 - px)) / len off
 from (select *, unnest(range(floor((least(px, 0) - 1) / 0.25)::int, ceil((greatest(px, 0) + 1) / 0.25)::int + 1)) ix from ray) q, lateral (select unnest(range(floor((least(py, 0) - 1) / 0.25)::int, ceil((greatest(py, 0) + 1) / 0.25)::int + 1)) iy)),
hit as (select *, least(sdf, 0.2) v from cell where off < 0.25 * sqrt(2) / 2 and sdf >= -0.2 and sdf <= len + 1e-9),
wt as (select *, case when abs(v) <= 0.02 then 1.0 when sdf > 0.2 then 0.01 else exp(-30.0 * (v - 0.02) * (v - 0.02)) end k from hit),
g as (select graph_id, ix, iy, sum(k * v) / sum(k) value, sum(k) weight from wt group by all)"""

CONS = W + """, cl as (select distinct graph_id, pose_id, floor(wx / 0.25)::int ix, floor(wy / 0.25)::int iy from w), cn as (select graph_id, pose_id, count(*) n from cl group by all),
sh as (select a.graph_id, a.pose_id pose_a, b.pose_id pose_b, count(*) n from cl a join cl b using (graph_id, ix, iy) where a.pose_id < b.pose_id group by all),
co as (select p.graph_id, p.pose_id pose_a, q.pose_id pose_b, cp.n + cq.n - 2 * coalesce(sh.n, 0) n from p join p q on p.graph_id = q.graph_id and p.pose_id < q.pose_id and sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2)) < 10
 join cn cp on cp.graph_id = p.graph_id and cp.pose_id = p.pose_id join cn cq on cq.graph_id = q.graph_id and cq.pose_id = q.pose_id left join sh on sh.graph_id = p.graph_id and sh.pose_a = p.pose_id and sh.pose_b = q.pose_id)"""

COV = "count(*) n, avg((px - 0.3) * (px - 0.3)) cxx, avg((px - 0.3) * (py + 0.2)) cxy, avg((py + 0.2) * (py + 0.2)) cyy"

SEGS = S + """, en as (select graph_id, pose_id seg_id, max(case when obs_id = 0 then px end) x0, max(case when obs_id = 0 then py end) y0, max(case when obs_id = 31 then px end) x1, max(case when obs_id = 31 then py end) y1, 10.0 + pose_id % 7 mass from s group by graph_id, pose_id),
pr as (select n.graph_id, n.seg_id new_id, m.seg_id master_id, n.x0 nx0, n.y0 ny0, n.x1 nx1, n.y1 ny1, m.x0, m.y0, m.x1, m.y1,
 ((n.x0 - m.x0) * (m.x1 - m.x0) + (n.y0 - m.y0) * (m.y1 - m.y0)) / (power(m.x1 - m.x0, 2) + power(m.y1 - m.y0, 2)) t1, ((n.x1 - m.x0) * (m.x1 - m.x0) + (n.y1 - m.y0) * (m.y1 - m.y0)) / (power(m.x1 - m.x0, 2) + power(m.y1 - m.y0, 2)) t2
 from en n join en m on n.graph_id = m.graph_id and n.seg_id % 2 = 1 and m.seg_id % 2 = 0),
pc as (select *, (power(x0 + t1 * (x1 - x0) - nx0, 2) + power(y0 + t1 * (y1 - y0) - ny0, 2)) / (case when t1 < 0 then 0.002 when t1 > 1 then 0.003 else (1 - t1) * 0.002 + t1 * 0.003 end + 0.002) q1,
 (power(x0 + t2 * (x1 - x0) - nx1, 2) + power(y0 + t2 * (y1 - y0) - ny1, 2)) / (case when t2 < 0 then 0.002 when t2 > 1 then 0.003 else (1 - t2) * 0.002 + t2 * 0.003 end + 0.003) q2,
 abs(((x1 - x0) * (nx1 - nx0) + (y1 - y0) * (ny1 - ny0)) / sqrt((power(x1 - x0, 2) + power(y1 - y0, 2)) * (power(nx1 - nx0, 2) + power(ny1 - ny0, 2)))) dc from pr),
mt as (select * from pc where not ((t1 < 0 and t2 < 0) or (t1 > 1 and t2 > 1)) and q1 < 50 and q2 < 50 and dc > 0.5 qualify row_number() over (partition by graph_id, new_id order by master_id) = 1)"""

def _chi(t: str, end: int) -> str:
    s = {k: f"(case when {t} < 0 then m.c0{k} when {t} > 1 then m.c1{k} else (1 - {t}) * m.c0{k} + {t} * m.c1{k} end + n.c{end}{k})" for k in ("xx", "xy", "yy")}
    fx, fy = (f"(m.{k}0 + {t} * (m.{k}1 - m.{k}0) - n.{k}{end})" for k in "xy")
    return f"({s['yy']} * {fx} * {fx} - 2 * {s['xy']} * {fx} * {fy} + {s['xx']} * {fy} * {fy}) / ({s['xx']} * {s['yy']} - {s['xy']} * {s['xy']})"


def _lines(which: str, later: str = "") -> str:
    """The line map ln and its matches lm between n and m, as ``which`` says."""
    t = lambda e: f"((n.x{e} - m.x0) * (m.x1 - m.x0) + (n.y{e} - m.y0) * (m.y1 - m.y0)) / (power(m.x1 - m.x0, 2) + power(m.y1 - m.y0, 2))"
    return SEGS.split("""),
pr as""")[0] + f"""), ln as (select *, 0.002 + seg_id % 3 * 0.001 c0xx, 0.0005 c0xy, 0.003 c0yy, 0.003 c1xx, -0.0005 c1xy, 0.002 + seg_id % 3 * 0.001 c1yy, (x0 + x1) / 2 mx, (y0 + y1) / 2 my,
 power((x0 + x1) / 2, 2) + power(x1 - x0, 2) / 12 + 1e-4 sxx, (x0 + x1) / 2 * ((y0 + y1) / 2) + (x1 - x0) * (y1 - y0) / 12 sxy, power((y0 + y1) / 2, 2) + power(y1 - y0, 2) / 12 + 1e-4 syy from en),
lt as (select n.graph_id, n.seg_id new_id, m.seg_id master_id, {t(0)} t1, {t(1)} t2 from ln n join ln m on n.graph_id = m.graph_id and {which}),
lq as (select l.*, {_chi('t1', 0)} q1, {_chi('t2', 1)} q2, abs((m.x1 - m.x0) * (n.x1 - n.x0) + (m.y1 - m.y0) * (n.y1 - n.y0)) / sqrt((power(m.x1 - m.x0, 2) + power(m.y1 - m.y0, 2)) * (power(n.x1 - n.x0, 2) + power(n.y1 - n.y0, 2))) dc
 from lt l join ln n on n.graph_id = l.graph_id and n.seg_id = new_id join ln m on m.graph_id = l.graph_id and m.seg_id = master_id),
la as (select graph_id, new_id, master_id, t1, t2 from lq where not ((t1 < 0 and t2 < 0) or (t1 > 1 and t2 > 1)) and q1 < 50 and q2 < 50 and dc > 0.5 qualify row_number() over (partition by graph_id, new_id order by master_id) = 1),
lm as (select * from la {later})"""


_SUMS = ("c0xx", "c0yy", "c1xx", "c1yy", "mx", "my", "sxx", "sxy", "syy")
MERGED = f""", tk as (select lm.graph_id, master_id seg_id, least(0, min(t1), min(t2)) lo, greatest(1, max(t1), max(t2)) hi, sum(n.mass) nm, {', '.join(f'sum(n.mass * n.{k}) s_{k}' for k in _SUMS)} from lm join ln n on n.graph_id = lm.graph_id and n.seg_id = new_id group by 1, 2),
kept as (select ln.* from ln where not exists (select 1 from lm where lm.graph_id = ln.graph_id and lm.new_id = ln.seg_id)),
av as (select k.graph_id, k.seg_id, x0, y0, x1, y1, lo, hi, mass + nm mass, {', '.join(f'(mass * {k} + s_{k}) / (mass + nm) {k}' for k in _SUMS)} from kept k join tk using (graph_id, seg_id)),
ax as (select *, 0.5 * atan2(2 * (sxy - mx * my), sxx - mx * mx - syy + my * my) a, sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) len, ((x1 - x0) * (mx - x0) + (y1 - y0) * (my - y0)) / (power(x1 - x0, 2) + power(y1 - y0, 2)) t from av),
ay as (select *, case when cos(a) * (x1 - x0) + sin(a) * (y1 - y0) < 0 then -len else len end side from ax),
gr as (select graph_id, seg_id, mx + (lo - t) * side * cos(a) x0, my + (lo - t) * side * sin(a) y0, mx + (hi - t) * side * cos(a) x1, my + (hi - t) * side * sin(a) y1, mass, {', '.join(_SUMS)} from ay
 union all select graph_id, seg_id, x0, y0, x1, y1, mass, {', '.join(_SUMS)} from kept where not exists (select 1 from tk where tk.graph_id = kept.graph_id and tk.seg_id = kept.seg_id))
select graph_id, seg_id, {cols('; '.join(f'{k}={k}' for k in ('x0', 'y0', 'x1', 'y1', 'mass', *_SUMS)), 4)} from gr"""
ODD_EVEN = _lines("n.seg_id % 2 = 1 and m.seg_id % 2 = 0")
STAMPED = "a as (select user_id::bigint user_id, event_id::bigint event_id, ts, event_type, value from events)"

SUFFIX = f"""with {P}, m as ({moved(2)}), l as (select graph_id, x lx, y ly, mx lmx, my lmy from m where pose_id = 9),
k as (select m.*, lx, ly, lmx, lmy from m left join l using (graph_id))
select {IDS}, {cols('''x=case when pose_id between 5 and 9 then mx when pose_id > 9 and lx is not null then lmx + (x - lmx) * cos(dth) - (y - lmy) * sin(dth) + lmx - lx else x end;
y=case when pose_id between 5 and 9 then my when pose_id > 9 and lx is not null then lmy + (x - lmx) * sin(dth) + (y - lmy) * cos(dth) + lmy - ly else y end;
th=th + case when pose_id >= 5 and (pose_id <= 9 or lx is not null) then dth else 0 end''', 5)} from k"""

PICKS = ", ".join(f"({k}, {i}, {x + 0.25 * i!r}, {y - 0.4 * k!r})" for k, (x, y) in enumerate([(-1.0, 0.0), (2.0, -1.0), (12.0, 40.0)]) for i in range(4))
BINS = ", ".join(f"({b}, {0.01 * (b % 5) - 0.02!r})" for b in range(-30, 30) if b % 3)
DIR = math.atan2(0.6, 1.9)

#: What a trajectory's odometry gathers: world noise of every step, and its sum at a pose that lies (dx, dy) on.
COVS = ("c00", "c01", "c02", "c11", "c12", "c22")
NOISE = "n as (select graph_id, pose_id, x, y, var_r vr, var_t * (power(cos(thp), 2) + 2 * power(sin(thp), 2)) nxx, -var_t * cos(thp) * sin(thp) nxy, var_t * (power(sin(thp), 2) + 2 * power(cos(thp), 2)) nyy from (select *, th - dth thp from p join o using (graph_id, pose_id, var_t, var_r)))"
GATHERED = "sum(nxx + vr * {dy} * {dy}) c00, sum(nxy - vr * {dx} * {dy}) c01, -sum(vr * {dy}) c02, sum(nyy + vr * {dx} * {dx}) c11, sum(vr * {dx}) c12, sum(vr) c22"
CLOSEST = "k as (select k sel_id, i pick_id, 0.37 + 1.1 * k - 0.8 * i qx, -0.21 + 0.45 * k * (1 - 2 * i) qy from range(6) a(k), range(2) b(i) union all values (9, 0, 4000.0, -900.0), (9, 1, -5000.0, 70.0)), n as (select graph_id, sel_id::bigint sel_id, pick_id::bigint pick_id, pose_id, obs_id, wx, wy, sqrt(power(wx - qx::double, 2) + power(wy - qy::double, 2)) d from w, k qualify row_number() over (partition by graph_id, sel_id, pick_id order by d, pose_id, obs_id) = 1)"
#: Relative poses summed (ax, ay, ath) and composed (x, y, th), and points under both.
STEPS = f"""{O}, {S}, st as (select graph_id, pose_id, dx, dth / 4 dy, dth, sum(dx) over q ax, sum(dth / 4) over q ay, sum(dth) over q th from o window q as (partition by graph_id order by pose_id)),
mv as (select *, th - dth before, sum(dx * cos(th - dth) - dy * sin(th - dth)) over q x, sum(dx * sin(th - dth) + dy * cos(th - dth)) over q y from st window q as (partition by graph_id order by pose_id)),
l as (select s.graph_id, s.pose_id, s.obs_id, ax, ay, x, y, ax + px * cos(th) - py * sin(th) sx, ay + px * sin(th) + py * cos(th) sy, x + px * cos(th) - py * sin(th) gx, y + px * sin(th) + py * cos(th) gy from s join mv using (graph_id, pose_id))"""
OFF = "(0.8 * {x} + 0.6 * {y} - 1.2)"

SQL = {
    "odometry_prefix": f"with {P} select {IDS}, {cols('x=x; y=y; th=th', 5)} from p",
    "pose_edges": f"with {EDGES} select {IDS}, {cols('radial=sqrt(lx * lx + ly * ly); direction=case when sqrt(lx * lx + ly * ly) > 0 then atan2(ly, lx) end; rotation=rotation', 5)} from e",
    "world_points": f"with {W} select {IDO}, {cols('wx=wx; wy=wy', 5)} from w",
    "robot_frame": f"with {P} select {IDS}, {cols('px=(1 - x) * cos(th) + (2 - y) * sin(th); py=(2 - y) * cos(th) - (1 - x) * sin(th)', 5)} from p",
    "relative_pose": f"with {P}, z as (select graph_id, x x0, y y0, th th0 from p where pose_id = 0) select {IDS}, {cols('dx=(x - x0) * cos(th0) + (y - y0) * sin(th0); dy=(y - y0) * cos(th0) - (x - x0) * sin(th0); sin_dth=sin(th - th0); cos_dth=cos(th - th0)', 5)} from p join z using (graph_id)",
    "wrap_angles": f"with {O}, a as (select *, dth * 7 + 0.001 a from o) select {IDS}, {cols('modded=a - 2 * pi() * round_even(a / (2 * pi()), 0); wrapped=atan2(sin(a), cos(a)); positive=a - 2 * pi() * floor(a / (2 * pi())); apart=abs(a - 1 - 2 * pi() * round_even((a - 1) / (2 * pi()), 0))')} from a",
    "segment_distance": f"with {W} select {IDO}, {cols('d=' + seg('wx', 'wy', X0, Y0, X1, Y1), 5)} from w",
    "segment_distance_compat": f"with {W}, q as (select *, {NUM} / {L!r} t from w) select {IDO}, {cols(f'd=case when t < 0 then sqrt(power(wx + 1, 2) + power(wy, 2)) when t > 1 then sqrt(power(wx - 1, 2) + power(wy - 0.5, 2)) else abs(2 * wy - 0.5 * (wx + 1)) / {L!r} end', 5)} from q",
    "line_ops": f"""with {S}, q as (select *, nullif(px * 0.5 - py * 2.0, 0) dd from s), z as (select *, (-1.0 * 0.5 - 0.0 * 2.0) / dd t, (-1.0 * py - 0.0 * px) / dd u from q)
select {IDO}, {cols(f'off=(2 * py - 0.5 * (px + 1)) / {L!r}; t=((px + 1) * 2 + py * 0.5) / 4.25; len=sqrt(px * px + py * py); ix=case when t between 0 and 1 and u between 0 and 1 then t * px end; iy=case when t between 0 and 1 and u between 0 and 1 then t * py end')} from z""",
    "geom_ops": f"""with {S}, a as (select *, 2 * (3.0 * (py + 9.0) - 0.5 * px) dd, px * px + (py + 9.0) * (py + 9.0) c2, power(px + 20.0, 2) + py * py d2, px / 9 oy, py / 9 oz from s),
b as (select *, ((py + 9.0) * 9.25 - 0.5 * c2) / dd ux, (3.0 * c2 - px * 9.25) / dd uy, 1.5 * sqrt(d2 - 2.25) / d2 h, 81.0 - (81.0 + oy * oy + oz * oz - 4.0) disc from a)
select {IDO}, {cols('''angle=abs(atan2((px - 9) * (7 - 9) - (py - 9) * (-9 - 9), (px - 9) * (-9 - 9) + (py - 9) * (7 - 9))); cx=ux; cy=uy; radius=sqrt(ux * ux + uy * uy);
t0=2.25 / d2 * (px + 20.0) - h * py; t1=2.25 / d2 * py + h * (px + 20.0); hit=case when disc >= 0 then 9.0 - sqrt(disc) end; plane=(5.0 - px) / 2.0;
ramp=least(greatest((px + 1) / 2, 0), 1); bound=least(greatest(py, -0.75), 0.75);
mid=py + 0.5 * 0.3 * (px + 1 - px + 0.3 * (2 * px - 5 * py + 4 * (px + 1) - (py - 1) + 0.3 * (3 * (py - (px + 1)) + (py - 1) - px)))''', 5)} from b""",
    "scalar_ops": """select l_orderkey::bigint l_orderkey, l_linenumber::bigint l_linenumber, gcd(q, p)::bigint gcd, bit_count(q)::bigint bits, (case when q >= p then 1 else -1 end)::bigint sign, greatest(q, p)::bigint larger, (((-q) % p + p) % p)::bigint mod
from (select l_orderkey, l_linenumber, l_quantity::bigint q, (l_partkey % 97 + 1)::bigint p from lineitem)""",
    "pill_select": f"with {W} select {IDS}, count(*) n_inliers from w where {seg('wx', 'wy', X0, Y0, X1, Y1)} < 0.1 group by 1, 2 having count(*) > 5",
    "verify_points": f"with {W}, k(sel_id, pick_id, qx, qy) as (values {PICKS}) select sel_id::bigint sel_id, pick_id::bigint pick_id, exists (select 1 from w where sqrt(power(wx - qx, 2) + power(wy - qy, 2)) < 0.05) ok from k",
    "selection_overlap": f"with {SEL} select {IDS}, sel_id, state from ov",
    "order_bounds": f"""with {SEL}, q as (select graph_id, min(case when sel_id = 1 then pose_id end) a0, max(case when sel_id = 1 then pose_id end) a1, min(case when sel_id = 2 then pose_id end) b0, max(case when sel_id = 2 then pose_id end) b1, bool_or(state = 'full_overlap') fo from ov group by 1),
st as (select *, case when fo then 'full_overlap' when a0 is null or b0 is null then 'empty' when a0 > b1 or a1 < b0 then 'ok' else 'interleaved' end state from q)
select graph_id, state, (case when state = 'ok' then case when a0 > b1 then 1 else 2 end end)::bigint corrected_sel, (case when state = 'ok' then case when a0 > b1 then b1 + 1 else a1 + 1 end else -1 end)::bigint lo, (case when state = 'ok' then case when a0 > b1 then a0 - 1 else b0 - 1 end else -1 end)::bigint hi from st""",
    "contiguous_groups": f"""with {O}, i as (select {IDS}, pose_id - row_number() over (partition by graph_id order by pose_id) k from o where dx > 0.5),
c as (select graph_id, k, min(pose_id) first_pose, max(pose_id) last_pose, count(*) n from i group by 1, 2) select graph_id, row_number() over (partition by graph_id order by k) - 1 group_id, first_pose, last_pose, n from c""",
    "pose_runs": f"""with {O}, f as (select {IDS}, dx > 0.5 a, dth > 0 b from o), l as (select *, lag(a) over q la, lag(b) over q lb, row_number() over q rn from f window q as (partition by graph_id order by pose_id))
select {IDS}, (sum(case when rn > 1 and (a is distinct from la or b is distinct from lb) then 1 else 0 end) over (partition by graph_id order by pose_id))::bigint run_id from l""",
    "colocate": deltas(2),
    "collinear": deltas(4),
    "perpendicular": deltas(5),
    "parallel": deltas(6),
    "suffix_motion": SUFFIX,
    "constraint_targets": f"""with {P}, j as (select a.graph_id, a.pose_id anchor_id, b.pose_id constrained_id, b.x - a.x ex, b.y - a.y ey, a.th ath, b.th - a.th dt from p a join p b using (graph_id) where a.pose_id between 0 and 2 and b.pose_id between 20 and 22)
select graph_id, anchor_id, constrained_id, {cols(f'delta_parallel=ex * cos(ath) + ey * sin(ath); delta_perpendicular=ey * cos(ath) - ex * sin(ath); sin_da=sin(dt); cos_da=cos(dt); sin_pen=sin({DIR!r} - ath + pi() / 2); cos_pen=cos({DIR!r} - ath + pi() / 2)', 5)} from j""",
    "backprop": f"with {BACK} select f.graph_id, f.pose_id, {cols('x=x1 + cw * tx; y=y1 + cw * ty; th=th1', 5)} from f join g on f.graph_id = g.graph_id",
    "cov_scale": f"""with {P}, b as (select graph_id, 1 / (1 + var_r / 1e-4) br, 1 / (1 + var_t / 1e-3) bt from p where pose_id = 29),
q as (select {IDS}, var_t, var_r, case when pose_id between 5 and 29 then coalesce(br, 1) else 1 end br, case when pose_id between 5 and 29 then coalesce(bt, 1) else 1 end bt from p left join b using (graph_id))
select {IDS}, {cols('c00=var_t * bt * 1e4; c02=1e-4 * br * 1e4; c11=var_t * bt * 1e4; c12=2e-4 * br * 1e4; c22=var_r * br * 1e4')} from q""",
    "scan_normals_window": f"""with {S}, a as (select *, px - lag(px) over q bx, py - lag(py) over q by_, lead(px) over q - px ax, lead(py) over q - py ay from s window q as (partition by graph_id, pose_id order by obs_id)),
b as (select *, sqrt(bx * bx + by_ * by_) bl, sqrt(ax * ax + ay * ay) al from a),
c as (select {IDO}, case when bl < 0.25 and bl > 0 then -by_ / bl else 0 end + case when al < 0.25 and al > 0 then -ay / al else 0 end x, case when bl < 0.25 and bl > 0 then bx / bl else 0 end + case when al < 0.25 and al > 0 then ax / al else 0 end y from b)
select {IDO}, {cols('nx=x / sqrt(x * x + y * y); ny=y / sqrt(x * x + y * y)')} from c where sqrt(x * x + y * y) > 1e-12""",
    "nn_l2": f"with {NEXT} select {IDO}, to_obs, {rnd('d', 5)} d from nn qualify row_number() over (partition by {IDO} order by nn.d, to_obs) = 1",
    "nn_normal": f"with {NEXT} select {IDO}, to_obs, {rnd('dn', 5)} dn from nn qualify row_number() over (partition by {IDO} order by nn.dn, to_obs) = 1",
    "radius_search": f"with {NEXT} select {IDO}, count(*) n from nn group by all",
    "visual_odometry": f"with {NEXT} select {IDO}, to_obs, {rnd('d', 5)} d from nn where nc > {math.cos(math.radians(25.0))!r} qualify row_number() over (partition by {IDO} order by nn.d, to_obs) = 1",
    "stf_pairs": f"with {STF} select {IDO}, to_pose, to_obs, n_matches from m",
    "residual_rms": f"with {STF} select {IDS}, to_pose, count(*) n_matches, {rnd('sqrt(avg(power((tnx * (qx - tx) + tny * (qy - ty)) * 0.5 / 0.05, 2)))', 5)} rms from m group by all",
    "residual_pose": f"""with {EDGES}, q as (select *, sqrt(lx * lx + ly * ly) radial from e) select {IDS}, {cols('r0=(cos(0.1) * lx + sin(0.1) * ly - radial * 0.9) / 0.03; r1=(cos(0.1) * ly - sin(0.1) * lx) / 0.03; r2=' + wrap('th - th0 - (rotation + 0.05)') + ' / 0.01', 4)} from q""",
    "residual_human": f"with {O} select {IDS}, {cols('c0=0.5 - dx; c1=0.1 - var_t; c2=' + wrap('0.2 - dth') + '; l0=cos(0.7) * (0.5 - dx) + sin(0.7) * (0.1 - var_t); l1=' + wrap('0.2 - dth') + '; o0=' + wrap('0.3 - dth'))} from o",
    "residual_wall": f"with {S} select {IDO}, {cols(f'plain={WALL} / 0.05 * 0.5; front=case when -0.5 * {WALL} > 0 and abs({WALL}) >= 0.5 then 0.5 else {WALL} end / 0.05 * 0.5; seen=({SEEN}) * 0.5 / 0.05; pair={PAIR} * 0.5 / 0.05')} from s",
    "residual_glob": f"with {S} select {IDS}, {cols(f'line=sum(power({WALL} / 0.05, 2)); wall=sqrt(sum(power(({SEEN}) / 0.05, 2))); rms=sqrt(avg(power({PAIR} / 0.05, 2)))', 4)} from s group by 1, 2",
    "sdf_grid": f"with {SDF} select graph_id, ix::bigint ix, iy::bigint iy, {cols('value=value; weight=weight', 5)} from g",
    "sdf_merge": f"with {SDF}, q as (select graph_id % 2 map_id, ix, iy, sum(value * weight) / sum(weight) value, sum(weight) weight from g group by all) select map_id, ix::bigint ix, iy::bigint iy, {cols('value=value; weight=weight', 4)} from q",
    "consistency": f"with {CONS} select graph_id, pose_a, pose_b, n::bigint n from co",
    "consistency_hist": f"with {CONS}, t as (select graph_id, max(n) top from co group by 1) select graph_id, least(floor(n * 10 / top), 9)::bigint bin, count(*) n_pairs from co join t using (graph_id) where top > 0 group by all",
    "endpoint_cov": f"with {S}, q as (select {IDS}, {COV} from s group by 1, 2) select {IDS}, n, {cols('cxx=cxx; cxy=cxy; cyy=cyy')} from q",
    "scatter": f"with {S} select {IDS}, count(*) mass, {cols('mx=avg(px); my=avg(py); sxx=avg(px * px); sxy=avg(px * py); syy=avg(py * py)')} from s group by 1, 2",
    "cov_ellipse": f"with {S}, q as (select {IDS}, {COV} from s group by 1, 2), z as (select *, (cxx + cyy) / 2 mid, sqrt(power((cxx - cyy) / 2, 2) + cxy * cxy) off from q) select {IDS}, {cols('major=sqrt(5.991 * (mid + off)); minor=sqrt(5.991 * greatest(mid - off, 0)); angle=0.5 * atan2(2 * cxy, cxx - cyy)', 5)} from z",
    "segment_match": f"with {SEGS} select graph_id, new_id, master_id, {cols('t1=t1; t2=t2', 5)} from mt",
    "merge_segments": f"""with {SEGS}, tk as (select mt.graph_id, master_id seg_id, least(0, min(t1), min(t2)) lo, greatest(1, max(t1), max(t2)) hi, sum(n.mass) nm from mt join en n on n.graph_id = mt.graph_id and n.seg_id = mt.new_id group by 1, 2),
al as (select en.*, coalesce(lo, 0) lo, coalesce(hi, 1) hi, coalesce(nm, 0) nm from en left join tk using (graph_id, seg_id) where not exists (select 1 from mt where mt.graph_id = en.graph_id and mt.new_id = en.seg_id))
select graph_id, seg_id, {cols('x0=x0 + lo * (x1 - x0); y0=y0 + lo * (y1 - y0); x1=x0 + hi * (x1 - x0); y1=y0 + hi * (y1 - y0); mass=mass + nm; c0=0.002; c1=0.003', 5)} from (select graph_id, seg_id, x0, y0, x1, y1, lo, hi, mass, nm from al) al""",
    "match_lines": f"with {ODD_EVEN} select graph_id, new_id, master_id, {cols('t1=t1; t2=t2', 5)} from lm",
    "merge_lines": f"with {ODD_EVEN}{MERGED}",
    "self_merge_round": f"with {_lines('m.seg_id > n.seg_id', 'where not exists (select 1 from la o where o.graph_id = la.graph_id and o.new_id = la.master_id)')}{MERGED}",
    "screen_points": f"select event_id::bigint event_id, {cols('x=(value - 320) * 0.025 + 1.75; y=-((event_id % 480) - 240) * 0.025 - 1.5')} from events",
    "drawn_rectangles": f"select o_orderkey::bigint o_orderkey, {cols('x0=greatest(p * -20, -1000000); y0=greatest(p - 100000, -1000000); x1=least(p * 10, 1000000); y1=least(p / 3, 1000000)', 3)} from (select o_orderkey, o_totalprice::double p from orders)",
    "display_compiled": f"""with {STAMPED}, w as (select min(ts) + interval 1 day t from a), l as (select a.*, t from a, w where ts <= t qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
select user_id, event_id, {rnd('value')} as value from l where event_type = 'purchase' or epoch_us(t) - epoch_us(ts) < 7200000000""",
    "display_throttled": f"with {STAMPED} select event_type, event_id from a qualify row_number() over (partition by event_type, floor(epoch_us(ts) * 0.0009765625 / 1e6) order by ts, event_id) = 1",
    "motion_sd": f"with {EDGES}, q as (select *, sqrt(lx * lx + ly * ly) radial from e) select {IDS}, {cols('sd_radial=least(greatest(radial * 0.2, 0.01), 0.5); sd_tangential=least(greatest(radial * 0.2, 0.01), 0.5); sd_angular=least(greatest(abs(rotation) * 0.2, 0.005), 0.5)', 5)} from q",
    "polar_scan": f"""with a as (select vec_id::bigint vec_id, i beam, abs(embedding[i + 1]::double) * 4 r, -1.5 + i * (3.0 / 63) a from embeddings, range(64) t(i) where i between 2 and 61)
select vec_id, beam, {cols('range=r; px=0.15 + r * cos(a); py=r * sin(a)')} from a where r between 0.2 and 6.0""",
    "range_correction": f"with {S}, k(bin, delta) as (values {BINS}) select {IDO}, {rnd('sqrt(px * px + py * py) * (1 + coalesce(delta, 0))', 5)} range from s left join k on bin = floor(atan2(py, px) / 0.1)",
    "latest_per_publisher": f"select user_id::bigint user_id, event_id::bigint event_id, {rnd('value')} as value from events e qualify row_number() over (partition by user_id order by ts desc, e.event_id desc) = 1",
    "display_lines": f"""with {P}, a as (select *, lead(x) over q x2, lead(y) over q y2, x + 0.3 * cos(th) tx, y + 0.3 * sin(th) ty from p window q as (partition by graph_id order by pose_id)),
l as (select {IDS}, 'edge' kind, x x0, y y0, x2 x1, y2 y1 from a where x2 is not null union all select {IDS}, 'shaft', x, y, tx, ty from a where x2 is not null
 union all select {IDS}, 'barb', tx, ty, tx + 0.1 * cos(th + 2.5), ty + 0.1 * sin(th + 2.5) from a where x2 is not null union all select {IDS}, 'barb', tx, ty, tx + 0.1 * cos(th - 2.5), ty + 0.1 * sin(th - 2.5) from a where x2 is not null)
select {IDS}, kind, {cols('x0=x0; y0=y0; x1=x1; y1=y1', 5)} from l""",
    "adjacency": f"""with {O}, l as (select graph_id, pose_id - 1 i, pose_id j from o where pose_id > 0 union all select graph_id, 0, pose_id from o where pose_id % 10 = 9)
select distinct graph_id, i, j from (select * from l union all select graph_id, j, i from l)""",
    "raster": f"with {S} select graph_id, floor(px / 0.1)::bigint ix, floor(py / 0.1)::bigint iy, count(*) n from s group by all",
    "modifier_decode": "select event_id::bigint event_id, ((event_id % 16) & 7)::bigint as type from events",
    "scalar_more": """with a as (select l_orderkey::bigint l_orderkey, l_linenumber::bigint l_linenumber, l_quantity::bigint q, (l_partkey % 97 + 1)::bigint p from lineitem), b as (select *, q - p s, q - 25 r from a)
select l_orderkey, l_linenumber, (case when abs(s) > abs(r) then s else r end)::bigint abs_max, (case when abs(s) < abs(r) then s else r end)::bigint abs_min,
 (case greatest(q, p, s) when q then 0 when p then 1 else 2 end)::bigint max_idx, (case least(q, p, s) when q then 0 when p then 1 else 2 end)::bigint min_idx, least(q, p) as least, greatest(q, p) most, (q + p + s - greatest(q, p, s) - least(q, p, s))::bigint middle, (s * s * s)::bigint as cube,
 (s - floor(s / p) * p)::bigint floor_mod, lcm(q, p)::bigint as lcm, (case 30 when q then 0 when p then 1 when s then 2 else 3 end)::bigint found, q r0, 7::bigint r2,
 list_reduce([0, case when q > 10 then 1 else -1 end, case when p > 10 then 1 else -1 end, case when s > 0 then 1 else -1 end, case when r > 0 then 1 else -1 end], lambda x, y: least(greatest(x + y, 0), 2))::bigint held,
 s * r >= 0 sign_eq, p < q taken, p > q raised, not (q > 20) toggled, bit_count(q) = 1 one_bit, (q & 5) = 5 all_bits, (p & 6) <> 0 any_bits from b""",
    "pose_differences": f"with {P}, d as (select *, x - coalesce(lag(x) over q, 0) dx, y - coalesce(lag(y) over q, 0) dy, th - coalesce(lag(th) over q, 0) dth from p window q as (partition by graph_id order by pose_id)) select {IDS}, {cols('dx=dx; dy=dy; dth=dth; x=x; y=y; th=th', 4)} from d",
    "scan_bounds": f"with {S} select {IDS}, {cols('x_min=min(px); x_max=max(px); y_min=min(py); y_max=max(py); x_mean=avg(px); y_mean=avg(py); x_spread=var_pop(px) * count(*); y_spread=var_pop(py) * count(*)', 5)} from s group by 1, 2",
    "sdf_normalised": f"with {SDF}, t as (select *, max(value) over (partition by graph_id) mv, max(weight) over (partition by graph_id) mw from g) select graph_id, ix::bigint ix, iy::bigint iy, {cols('value=case when mv > 0 then value * 255 / mv else value end; weight=case when mw > 0 then weight * 255 / mw else weight end', 4)} from t",
    "message_window": "with l as (select * from (select *, min(ts) over (partition by user_id) t0 from events) where ts >= t0 + interval 3600 second) select user_id::bigint user_id, event_id::bigint event_id from l qualify row_number() over (partition by user_id order by ts, event_id) <= 40",
    "keyframe_poses": f"with {O} select {IDS} from o where (graph_id, ts) in (select (graph_id, ts) from o where dx > 1)",
    "motion_scan": f"with {P}, {NOISE}, q as (select a.graph_id, a.pose_id, a.x, a.y, a.th, {GATHERED.format(dx='(a.x - k.x)', dy='(a.y - k.y)')} from p a join n k on k.graph_id = a.graph_id and k.pose_id <= a.pose_id group by all) select {IDS}, {cols('x=x; y=y; th=th; ' + '; '.join(f'{c}={c}' for c in COVS[:-1]), 5)}, {rnd('c22', 9)} c22 from q",
    "loop_constraints": f"""with {P}, {NOISE}, q as (select a.graph_id, a.pose_id i, b.pose_id j, a.th ta, b.th - a.th turn, b.x - a.x wx, b.y - a.y wy, {GATHERED.format(dx='(b.x - k.x)', dy='(b.y - k.y)')}
 from p a join p b on b.graph_id = a.graph_id and b.pose_id = a.pose_id + 20 join n k on k.graph_id = a.graph_id and k.pose_id > a.pose_id and k.pose_id <= b.pose_id group by all),
t as (select graph_id, i, j, turn, cos(ta) c, sin(ta) s, sqrt(wx * wx + wy * wy) radial, cos(ta) * wx + sin(ta) * wy lx, cos(ta) * wy - sin(ta) * wx ly, {', '.join(COVS)} from q),
v as (select *, lx / radial ux, ly / radial uy, c * c * c00 + 2 * c * s * c01 + s * s * c11 m00, c * s * (c11 - c00) + (c * c - s * s) * c01 m01, s * s * c00 - 2 * c * s * c01 + c * c * c11 m11, c * c02 + s * c12 m02, c * c12 - s * c02 m12 from t)
select graph_id::bigint graph_id, i::bigint i, j::bigint j, {cols('radial=radial; sd_radial=least(greatest(sqrt(5.991 * (ux * ux * m00 + 2 * ux * uy * m01 + uy * uy * m11)), 0.05), 2.0); sd_tangential=least(greatest(sqrt(5.991 * (uy * uy * m00 - 2 * ux * uy * m01 + ux * ux * m11)), 0.05), 2.0); sd_angular=least(greatest(sqrt(c22), 0.01), 0.5); c00=m00; c01=m01; c02=m02; c11=m11; c12=m12', 5)}, {rnd('c22', 9)} c22 from v""",
    "seeded_draws": f"""with i as (select l_orderkey::bigint l_orderkey, l_linenumber::bigint l_linenumber, l_quantity::double q from lineitem)
select l_orderkey, l_linenumber, {cols(f'even={draw(1, 0, *ITEM)}; ranged=-2 + (q + 2) * {draw(2, 0, *ITEM)}; bell=q + 0.5 * {bell(3, *ITEM)[0]}')} from i""",
    "pose_draws": f"with {P}, d as (select *, {bell(5, 'graph_id', 'pose_id')[0]} a, {bell(5, 'graph_id', 'pose_id')[1]} b, 0.5 * atan2(0.3 * cos(th) * sin(th), 0.15 * (cos(th) * cos(th) - sin(th) * sin(th))) r from p) select {IDS}, {cols('dx=0.4 * a * cos(r) - 0.1 * b * sin(r); dy=0.4 * a * sin(r) + 0.1 * b * cos(r)', 5)} from d",
    "sensor_noise": f"""with {WALLS}, r as (select graph_id, seg_id, wx - 4 * (wx + nx) rx, wy - 4 * (wy + ny) ry from walls), q as (select *, rx * rx + ry * ry dd from r)
select graph_id, seg_id, count(*) n, {cols('qxx=1e3 * sum(4e-6 * ry * ry + 9e-4 * rx * rx / dd); qxy=1e3 * sum((9e-4 / dd - 4e-6) * rx * ry); qyy=1e3 * sum(4e-6 * rx * rx + 9e-4 * ry * ry / dd)', 4)} from q group by 1, 2""",
    "crowd_select": f"""with {W}, g as (select graph_id * 100000 + pose_id sel_id, lag(x) over q x0, lag(y) over q y0, x x1, y y1 from p window q as (partition by graph_id order by pose_id)),
d as (select w.graph_id, w.pose_id, sel_id, ((wx - x0) * (x1 - x0) + (wy - y0) * (y1 - y0)) / nullif(power(x1 - x0, 2) + power(y1 - y0, 2), 0) t, wx, wy, x0, y0, x1, y1 from w join g on wx between least(x0, x1) - 0.02 and greatest(x0, x1) + 0.02 and wy between least(y0, y1) - 0.02 and greatest(y0, y1) + 0.02),
h as (select *, least(greatest(coalesce(t, 0), 0), 1) u from d)
select {IDS}, count(*) n, min(sel_id)::bigint as first, max(sel_id)::bigint as last from h where sqrt(power(wx - x0 - u * (x1 - x0), 2) + power(wy - y0 - u * (y1 - y0), 2)) < 0.02 group by 1, 2""",
    "closest_observations": f"with {W}, {CLOSEST} select graph_id, sel_id, pick_id, pose_id::bigint pose_id, obs_id::bigint obs_id, {rnd('d', 4)} d from n",
    "closest_pair_motion": f"with {W}, {CLOSEST}, b as (select x.graph_id, x.sel_id, x.pose_id pa, y.pose_id pb, y.wx - x.wx dx, y.wy - x.wy dy, x.pose_id >= y.pose_id later from n x join n y on y.graph_id = x.graph_id and y.sel_id = x.sel_id and x.pick_id = 0 and y.pick_id = 1) select graph_id, sel_id, (case when later then pa else pb end)::bigint constrained_id, (case when later then pb else pa end)::bigint anchor_id, {cols('dx=case when later then dx else -dx end; dy=case when later then dy else -dy end', 4)} from b",
    "residual_relative": f"""with {STEPS}, r as (select graph_id, pose_id, {OFF.format(x='sx', y='sy')} * 10 r, {OFF.format(x='gx', y='gy')} * 0.5 g, {OFF.format(x='ax', y='ay')} o, (0 - sx) * (3 - sx) + (2 - sy) * (-2 - sy) > 0 beside from l)
select {IDS}, {cols('summed=sqrt(sum(r * r)); through=sqrt(sum(case when beside or o * r > 0 then 0 else r * r end)); composed=sqrt(sum(g * g))', 4)} from r group by 1, 2""",
    "relative_gradients": f"""with {STEPS}, r as (select graph_id, pose_id, {OFF.format(x='sx', y='sy')} * 0.25 r, {OFF.format(x='gx', y='gy')} * 0.25 g, 0.6 * (sx - ax) - 0.8 * (sy - ay) st, 0.6 * (gx - x) - 0.8 * (gy - y) gt from l),
e as (select graph_id, pose_id, sum(r) r, sum(r * st) rt, sum(g) g, sum(g * gt) gt from r group by 1, 2),
z as (select k.graph_id, k.pose_id, k.x, k.y, k.before, sum(e.r) r, sum(e.rt) rt, sum(e.g) g, sum(e.gt + e.g * (0.6 * (i.x - k.x) - 0.8 * (i.y - k.y))) gt from mv k join mv i on i.graph_id = k.graph_id and i.pose_id >= k.pose_id join e on e.graph_id = i.graph_id and e.pose_id = i.pose_id group by all),
f as (select mv.graph_id, mv.pose_id, coalesce(r, 0) r, coalesce(rt, 0) rt, coalesce(g, 0) g, coalesce(gt, 0) gt, mv.before from mv left join z using (graph_id, pose_id) where mv.graph_id in (select graph_id from s))
select {IDS}, {cols('gx=0.8 * r; gy=0.6 * r; gth=rt; tx=g * (0.8 * cos(before) + 0.6 * sin(before)); ty=g * (0.6 * cos(before) - 0.8 * sin(before)); tth=gt', 3)} from f""",
    "message_log": f"select 'user/' || event_type topic, event_id::bigint event_id, {rnd('value')} as value, 'user' frame_id, (2 * json_extract_string(props, '$.k')::int)::bigint twice_k, 0::bigint seq_off from events where event_type in ('purchase', 'view') and ts >= (select min(ts) from events) + interval 6 hour and ts < (select min(ts) from events) + interval 240 hour",
    "residual_object": f"with {W}, b as (select graph_id, x ox, y oy, th oth from p where pose_id = 10), q as (select w.graph_id, w.pose_id, obs_id, cos(oth) * (wx - ox) + sin(oth) * (wy - oy) lx, cos(oth) * (wy - oy) - sin(oth) * (wx - ox) ly from w join b using (graph_id)) select {IDO}, {rnd('(0.6 * lx - 0.8 * ly + 0.3) * 10', 4)} r from q",
    "drags": "select event_id::bigint event_id, sqrt(power(value / 50, 2) + 0.25) > 1.0 dragged from events",
    "residual_cumulative": f"with {P} select {IDS}, {cols('r0=(x - 1.0) / 0.05; r1=(y + 0.5) / 0.04; r2=(th - 0.25) / 0.02', 3)} from p",
    "argb_unpack": """select o_orderkey::bigint o_orderkey, ((v >> 24) & 255)::bigint alpha, ((v >> 16) & 255)::bigint red, ((v >> 8) & 255)::bigint green, (v & 255)::bigint blue from (select o_orderkey, ((o_orderkey::bigint * 2654435761) % 4294967296)::bigint v from orders)""",
    "event_windows": f"select epoch(date_trunc('hour', ts))::bigint start, user_id::bigint user_id, count(*) n, {rnd('sum(value)', 4)} total from events group by 1, 2",
    "vector_ops": f"""with {S}, a as (select *, sqrt(px * px + py * py) n, least(greatest(((px + 1) * 2 + py * 0.5) / 4.25, 0), 1) t, nullif(1.0 * 0.5 - 0.5 * 2.0, 0) dd from s)
select {IDO}, {cols('u=px * 0.6 + py * 0.8; v=0.6 * py - 0.8 * px; bx=case when n > 0.5 then px * 0.5 / n else px end; byy=case when n > 0.5 then py * 0.5 / n else py end; qx=-1 + t * 2; qy=t * 0.5;'
    + 'apart=least(' + seg('px', 'py', X0, Y0, X1, Y1) + ', ' + seg('(px + 1)', '(py + 0.5)', X0, Y0, X1, Y1) + ', ' + seg('(-1.0)', '0.0', 'px', 'py', '(px + 1)', '(py + 0.5)') + ', ' + seg('1.0', '0.5', 'px', 'py', '(px + 1)', '(py + 0.5)') + ')'
    + ' * (case when MEET then 0 else 1 end);'.replace('MEET', "((-1 - px) * 0.5 - (0 - py) * 2) / (1.0 * 0.5 - 0.5 * 2.0) between 0 and 1 and ((-1 - px) * 0.5 - (0 - py) * 1) / (1.0 * 0.5 - 0.5 * 2.0) between 0 and 1")
    + ' t=greatest(-((px - 0.2) * 1.5 + (py - 0.1) * 0.3) / 2.34, 0); c0=py * 2 + 1; c2=-px - py * 0.5; d3=0.5 * px - py + 2; r1=py * cos(0.4) - sin(0.4); r2=py * sin(0.4) + cos(0.4)', 5)} from a""",
    "cov_rotate": f"""with {P}, q as (select *, var_t * 1e3 a, var_r * 1e4 d, cos(th) k, sin(th) s, sqrt(x * x + y * y) n from p), w as (select *, coalesce(x / nullif(n, 0), 1) ux, coalesce(y / nullif(n, 0), 0) uy from q)
select {IDS}, {cols('r0=k * k * a - 2 * k * s * 0.2 + s * s * d; r1=k * s * a + (k * k - s * s) * 0.2 - k * s * d; r2=k * 0.1 - s * 0.3; r4=s * s * a + 2 * k * s * 0.2 + k * k * d; r5=s * 0.1 + k * 0.3; r8=2.0; xx=0.09 * ux * ux + 0.01 * uy * uy; xy=0.08 * ux * uy; yy=0.09 * uy * uy + 0.01 * ux * ux', 5)} from w""",
}
