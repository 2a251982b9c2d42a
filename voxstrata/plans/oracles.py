"""The same results in DuckDB SQL, written independently of the Spark plans."""

from __future__ import annotations

from ..functions.weights import direction_alpha, directions, line_weights

_VOL = """vol AS (
 SELECT CAST(a.i AS INT) AS z, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS x, CAST(coalesce(n, 0) AS DOUBLE) AS v
 FROM range(7) a(i), range(11) b(i), range(50) c(i)
 LEFT JOIN (SELECT CAST(l_linenumber - 1 AS INT) lz, CAST(round(l_discount * 100) AS INT) ly, CAST(l_quantity - 1 AS INT) lx, count(*) n FROM lineitem GROUP BY ALL) s
 ON lz = a.i AND ly = b.i AND lx = c.i),
t AS (SELECT CAST(ceil(avg(v)) AS DOUBLE) AS t FROM vol)"""
_EV = """kinds AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS k FROM (SELECT DISTINCT event_type FROM events)),
ev AS (
 SELECT CAST(d.i AS INT) AS c, CAST(a.i AS INT) AS z, CAST(b.i AS INT) AS y, CAST(e.i AS INT) AS x, CAST(coalesce(n, 0) AS DOUBLE) AS v
 FROM (SELECT unnest(range((SELECT greatest(5, count(*)) FROM kinds))) AS i) d, range(8) a(i), (SELECT unnest(range((SELECT greatest(30, max(day(ts))) FROM events))) AS i) b, range(24) e(i)
 LEFT JOIN (SELECT k, user_id % 8 lz, day(ts) - 1 ly, hour(ts) lx, count(*) n FROM events JOIN kinds USING (event_type) GROUP BY ALL) s
 ON k = d.i AND lz = a.i AND ly = b.i AND lx = e.i)"""
_COLS = "cols AS (SELECT z, y, x, CASE WHEN v >= t THEN CAST(floor(x / 10) AS INT) ELSE -1 END AS label FROM vol, t)"
_FACES = "(VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) m(dz, dy, dx)"


def _with(body: str, *ctes: str) -> str:
    return f"WITH {', '.join((_VOL, *ctes))} {body}"


def _f32(x: str) -> str:
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


def _window(radius: int, weight: str, digits: int) -> str:
    span = f"range({-radius}, {radius + 1})"
    return _with(f"""SELECT p.z, p.y, p.x, round({_f32('sum(q.v * w) / sum(w)')}, {digits}) AS v
 FROM vol p, (SELECT CAST(a.i AS INT) dz, CAST(b.i AS INT) dy, CAST(c.i AS INT) dx, {weight} AS w FROM {span} a(i), {span} b(i), {span} c(i)) o
 JOIN vol q ON q.z = least(greatest(p.z + dz, 0), 6) AND q.y = least(greatest(p.y + dy, 0), 10) AND q.x = least(greatest(p.x + dx, 0), 49)
 GROUP BY p.z, p.y, p.x""")


def _axis(source: str, axis: str, weights: list[float], name: str, last: int, keys: str = "z, y, x") -> str:
    """A CTE with one clamped pass over an axis, rounded to float32."""
    r = len(weights) // 2
    taps = ", ".join(f"({k - r}, CAST({w!r} AS DOUBLE))" for k, w in enumerate(weights))
    others = [k for k in keys.split(", ") if k != axis]
    same = " AND ".join(f"q.{k} = p.{k}" for k in others)
    chosen = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f"""{name} AS (SELECT {chosen}, {_f32('sum(q.v * w)')} AS v FROM {source} p, (VALUES {taps}) k(d, w)
 JOIN {source} q ON {same} AND q.{axis} = least(greatest(p.{axis} + d, 0), {last}) GROUP BY ALL)"""


def _extreme(how: str, near: str, source: str = "vol") -> str:
    return f"SELECT p.z, p.y, p.x, {how}(q.v) AS v FROM {source} p JOIN {source} q ON {near} GROUP BY p.z, p.y, p.x"


def _cube(r: int) -> str:
    return " AND ".join(f"q.{a} BETWEEN p.{a} - {r} AND p.{a} + {r}" for a in "zyx")


def _ball(r: int) -> str:
    return f"{_cube(r)} AND (q.z - p.z) ** 2 + (q.y - p.y) ** 2 + (q.x - p.x) ** 2 <= {r * r}"


def _components(foreground: str, steps: int, body: str, *ctes: str, key: str = "0") -> str:
    """Least-index roots of foreground(idx, z, y, x, g), joined within g up to ``steps`` axes apart."""
    return f"""WITH RECURSIVE {', '.join((_VOL, *ctes))},
fg AS (SELECT (z * 11 + y) * 50 + x AS idx, z, y, x, {key} AS g FROM {foreground}),
e AS (SELECT a.idx AS u, b.idx AS w FROM fg a JOIN fg b ON b.g = a.g AND b.z BETWEEN a.z - 1 AND a.z + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1
 AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) BETWEEN 1 AND {steps}),
cc(idx, root) USING KEY (idx) AS (
 SELECT idx, idx AS root FROM fg
 UNION
 SELECT e.u, min(cc.root) FROM cc JOIN e ON e.w = cc.idx JOIN recurring.cc r ON r.idx = e.u WHERE cc.root < r.root GROUP BY e.u)
{body}"""


def _labelled(least: int) -> str:
    return f""", sized AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS label FROM cc GROUP BY root HAVING count(*) >= {least})
SELECT z, y, x, CAST(coalesce(label, -1) AS INT) AS label FROM vol LEFT JOIN (SELECT idx, label FROM cc JOIN sized USING (root)) k ON k.idx = (z * 11 + y) * 50 + x"""


_SURFACE_CTES = (
    _axis("vol", "z", line_weights(1, False), "smooth_z", 6),
    "lagged AS (SELECT *, lag(v) OVER (PARTITION BY y, x ORDER BY z) AS p, t + 0.3 AS lv FROM smooth_z, t)",
    """crossing AS (SELECT y, x, min(z) FILTER (v > lv) AS fz, arg_min(v, z) FILTER (v > lv) AS fv, arg_min(p, z) FILTER (v > lv) AS fp, max(lv) AS lv FROM lagged GROUP BY y, x),
rough AS (SELECT 0 AS z, y, x, CAST(CAST(CASE WHEN fz IS NULL THEN 6.0 WHEN fz = 0 THEN 0.0 ELSE fz - 1.0 + (lv - fp) / (fv - fp) END AS FLOAT) AS DOUBLE) AS v FROM crossing)""",
    _axis("rough", "x", line_weights(1, False), "surf_x", 49),
    _axis("surf_x", "y", line_weights(1, False), "surf", 10),
)


def _lanczos(order: int, target: float) -> str:
    def sinc(t: str) -> str:
        return f"CASE WHEN abs({t}) < 1e-6 THEN 1.0 ELSE sin(pi() * ({t})) / (pi() * ({t})) END"

    return _with(
        f"SELECT CAST(oz AS INT) AS z, y, x, round({_f32('sum(v * w) / sum(w)')}, 3) AS v FROM (SELECT oz, iz, CASE WHEN abs(c - iz) < {order} THEN ({sinc('c - iz')}) * ({sinc(f'(c - iz) / {order}')}) ELSE 0 END AS w FROM taps) k JOIN vol ON vol.z = least(greatest(iz, 0), 6) GROUP BY oz, y, x",
        f"n AS (SELECT CAST(greatest(1, floor(7 * 2.0 / {target} + 0.5)) AS INT) AS n)",
        f"taps AS (SELECT oz, c, CAST(floor(c) AS INT) + k.i AS iz FROM (SELECT o.i AS oz, (o.i + 0.5) * (CAST(7 AS DOUBLE) / n) - 0.5 AS c FROM n, range(64) o(i) WHERE o.i < n) s, range({1 - order}, {order + 1}) k(i))",
    )


def _directional() -> tuple[str, ...]:
    vectors = directions(1)
    w = line_weights(1, False)
    rows = ", ".join(
        f"({d}, {k}, CAST({float(x * k)!r} AS DOUBLE), CAST({float(y * k)!r} AS DOUBLE), CAST({float(z * k)!r} AS DOUBLE), CAST({w[k + 1]!r} AS DOUBLE), CAST({float(a)!r} AS DOUBLE))"
        for d, ((x, y, z), a) in enumerate(zip(vectors, direction_alpha(vectors), strict=True))
        for k in (-1, 0, 1)
    )

    def at(axis: str, top: int) -> str:
        return f"least(greatest({axis} + d{axis}, 0), {top})"

    return (
        f"taps(d, k, dx, dy, dz, w, alpha) AS (VALUES {rows})",
        f"rays AS (SELECT z, y, x, d, alpha, w, {at('x', 49)} AS px, {at('y', 10)} AS py, {at('z', 6)} AS pz FROM vol, taps)",
        """hits AS (SELECT r.z, r.y, r.x, d, alpha, w * q.v * (1 - abs(px - q.x)) * (1 - abs(py - q.y)) * (1 - abs(pz - q.z)) AS s
 FROM rays r JOIN vol q ON q.x BETWEEN CAST(floor(px) AS INT) AND CAST(ceil(px) AS INT) AND q.y BETWEEN CAST(floor(py) AS INT) AND CAST(ceil(py) AS INT) AND q.z BETWEEN CAST(floor(pz) AS INT) AND CAST(ceil(pz) AS INT))""",
        "sums AS (SELECT z, y, x, d, alpha, sum(s) AS s FROM hits GROUP BY ALL)",
        "least_ AS (SELECT z, y, x, min(s) AS least, arg_min(alpha, s + d * 1e-9) AS alpha FROM sums GROUP BY z, y, x)",
    )


def _trilinear(points: str) -> str:
    """points(point_id, px, py, pz), clamped."""
    return f"""SELECT point_id, round(sum(q.v * (1 - abs(px - q.x)) * (1 - abs(py - q.y)) * (1 - abs(pz - q.z))), 6) AS v
 FROM ({points}) r JOIN vol q ON q.x BETWEEN CAST(floor(px) AS INT) AND CAST(ceil(px) AS INT) AND q.y BETWEEN CAST(floor(py) AS INT) AND CAST(ceil(py) AS INT) AND q.z BETWEEN CAST(floor(pz) AS INT) AND CAST(ceil(pz) AS INT) GROUP BY point_id"""


_MASKS = "a AS (SELECT z, y, x, CAST(v >= t + 2 AS INT) AS l FROM vol, t), b AS (SELECT z, y, x, CAST(v >= t + 3 AS INT) AS l FROM vol, t)"


def _hausdorff(side: str) -> str:
    return f"""s{side} AS (SELECT p.z, p.y, p.x FROM {side} p WHERE p.l = 1 AND (SELECT count(*) FROM {side} q WHERE q.l = 1 AND abs(q.z - p.z) + abs(q.y - p.y) + abs(q.x - p.x) = 1) < 6)"""


def _weights_table() -> str:
    return """SELECT CAST(r AS INT) AS radius, CAST(k.i AS INT) AS k, round(exp(-((k.i - r) * (k.i - r)) / (2 * s * s)) / sum(exp(-((k.i - r) * (k.i - r)) / (2 * s * s))) OVER (PARTITION BY r), 6) AS w
 FROM (SELECT r, 0.3 * (r - 1) + 0.8 AS s FROM (VALUES (0), (1), (2), (14)) v(r)) g, range(29) k(i) WHERE k.i <= 2 * r"""


def _thickness(top: int = 50, chunk: int = 4) -> str:
    """Twice the first radius whose opening, by balls of radius ``chunk`` at most, leaves at most half of the mask; else twice ``top``.

    A step is one ball's erosion or dilation of the whole mask, or the start of the next radius.
    """
    return _with(
        "SELECT CAST(2 * max(radius) AS INT) AS thickness FROM opened",
        "m AS (SELECT z, y, x, CAST(v >= t AS DOUBLE) AS v FROM vol, t)", "whole AS (SELECT sum(v) AS total FROM m)",
        f"ball AS (SELECT CAST(r.i AS INT) AS r, CAST(a.i AS INT) AS dz, CAST(b.i AS INT) AS dy, CAST(c.i AS INT) AS dx FROM range(1, {chunk + 1}) r(i), range({-chunk}, {chunk + 1}) a(i), range({-chunk}, {chunk + 1}) b(i), range({-chunk}, {chunk + 1}) c(i) WHERE a.i ** 2 + b.i ** 2 + c.i ** 2 <= r.i ** 2)",
        f"""opened AS (
 SELECT 1 AS radius, 1 AS erode, 1 AS dilate, z, y, x, v FROM m
 UNION ALL
 SELECT * FROM (
  SELECT p.radius, greatest(p.erode - {chunk}, 0) AS erode, CASE WHEN p.erode > 0 THEN p.dilate ELSE greatest(p.dilate - {chunk}, 0) END AS dilate, p.z, p.y, p.x, CASE WHEN p.erode > 0 THEN min(q.v) ELSE max(q.v) END AS v
  FROM opened p JOIN ball ON r = least(CASE WHEN p.erode > 0 THEN p.erode ELSE p.dilate END, {chunk}) JOIN opened q ON q.z = p.z + dz AND q.y = p.y + dy AND q.x = p.x + dx
  GROUP BY p.radius, p.erode, p.dilate, p.z, p.y, p.x
  UNION ALL
  SELECT s.radius + 1, s.radius + 1, s.radius + 1, m.z, m.y, m.x, m.v
  FROM (SELECT radius FROM opened, whole WHERE erode = 0 AND dilate = 0 AND radius < {top} GROUP BY radius, total HAVING sum(v) > total / 2) s, m))""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)


ORACLES: dict[str, str] = {
    "copy_channel": _with("SELECT z, y, x, v FROM vol"),
    "select_channel": f"WITH {_EV} SELECT z, y, x, v FROM ev WHERE c = 2",
    "embedding_plane": "SELECT CAST(vec_id % 25 AS INT) AS y, CAST(i - 1 AS INT) AS x, round(CAST(embedding[i] AS DOUBLE), 6) AS v FROM embeddings, range(1, 65) r(i) WHERE vec_id // 25 = 3",
    "window_level": _with("SELECT z, y, x, round(least(greatest((v - 1.0) * (1.0 / t), 0.0), 1.0), 6) AS v FROM vol, t"),
    "threshold_2d": _with("SELECT z, y, x, CAST(v >= t AS DOUBLE) AS v FROM vol, t"),
    "threshold_3d": _with("SELECT z, sum(CAST(v >= t AS DOUBLE)) AS foreground, count(*) AS voxels FROM vol, t GROUP BY z"),
    "crop_absolute": _with("SELECT z, y, x, CASE WHEN x < 2 OR x >= 48 OR y < 2 OR y >= 9 OR z < 1 OR z > 4 THEN 0.0 ELSE v END AS v FROM vol"),
    "crop_to_surface": _with("SELECT p.z, p.y, p.x, CASE WHEN p.z < h - 1 OR p.z > h + 2 THEN CAST(-1 AS DOUBLE) ELSE p.v END AS v FROM vol p JOIN (SELECT y, x, v % 3 + 0.5 AS h FROM vol WHERE z = 0) s USING (y, x)"),
    "exclude_labelled": _with("SELECT z, y, x, CASE WHEN v >= t THEN 0.0 ELSE v END AS v FROM vol, t"),
    "normalise_channels": f"WITH {_EV}, m AS (SELECT c, max(v) AS m FROM ev GROUP BY c) SELECT c, z, y, x, round(CASE WHEN m > 0 THEN v / m ELSE v END, 6) AS v FROM ev JOIN m USING (c)",
    "finite_check": "SELECT CAST(0 AS BIGINT) AS n_nan, CAST(0 AS BIGINT) AS n_infinite",
    "combine_masks": _with(
        "SELECT z, y, x, 'or' AS how, CAST(a OR b AS DOUBLE) AS v FROM m UNION ALL SELECT z, y, x, 'and', CAST(a AND b AS DOUBLE) FROM m UNION ALL SELECT z, y, x, 'differs', CAST(a <> b AS DOUBLE) FROM m UNION ALL SELECT z, y, x, 'subtract', CAST(a AS DOUBLE) - CAST(b AS DOUBLE) FROM m",
        "m AS (SELECT z, y, x, v >= t AS a, v >= t + 1 AS b FROM vol, t)",
    ),
    "elementwise_arithmetic": _with("SELECT z, y, x, 100.0 - greatest((CASE WHEN x BETWEEN 5 AND 20 AND y BETWEEN 2 AND 6 AND z BETWEEN 1 AND 3 THEN CAST(9 AS DOUBLE) ELSE v END) - 2.0, 0.0) AS v FROM vol"),
    "sub_volume": _with("SELECT z - 1 AS z, y - 2 AS y, x - 10 AS x, v FROM vol WHERE x BETWEEN 10 AND 29 AND y BETWEEN 2 AND 8 AND z BETWEEN 1 AND 5"),
    "intensity_profile": _with("SELECT x AS position, v FROM vol WHERE y = 5 AND z = 3"),
    "render_plane": _with("SELECT y, x, CAST(round(least(greatest(v / greatest(2 * t, 1e-6), 0.0), 1.0) * 255) AS INT) AS v FROM vol, t WHERE z = 2"),
    "smooth_mean": _window(1, "CAST(1 AS DOUBLE)", 3),
    "smooth_gaussian": _window(2, "exp(-(a.i * a.i + b.i * b.i + c.i * c.i) / 2.0)", 3),
    "convolve_axis": _with("SELECT z, y, x, round(v, 4) AS v FROM k1", _axis("vol", "x", line_weights(3, True), "k1", 49)),
    "dilate_cube": _with(_extreme("max", _cube(2))),
    "erode_cube": _with(_extreme("min", _cube(1))),
    "dilate_cube_wide": _with(_extreme("max", _cube(5))),
    "erode_cube_wide": _with(_extreme("min", _cube(7))),
    "dilate_sphere": _with(_extreme("max", _ball(2))),
    "erode_sphere": _with(_extreme("min", _ball(2))),
    "spherical_closing": _with(_extreme("min", _ball(1), "d"), f"d AS ({_extreme('max', _ball(1))})"),
    "chunked_opening": _with(_extreme("max", _ball(1), "d"), f"d AS ({_extreme('min', _ball(1))})"),
    "minimum_axis": _with(_extreme("min", "q.z = p.z AND q.x = p.x AND q.y BETWEEN p.y - 1 AND p.y + 1")),
    "adaptive_threshold_2d": _with("SELECT z, y, x, CASE WHEN vol.v > k2.v - 0.5 THEN CAST(0.8 AS DOUBLE) ELSE 0.0 END AS v FROM vol JOIN k2 USING (z, y, x)", _axis("vol", "x", line_weights(1, False), "k1", 49), _axis("k1", "y", line_weights(1, False), "k2", 10)),
    "adaptive_threshold_3d": _with(
        "SELECT z, y, x, CASE WHEN vol.v > k3.v - 0.5 THEN CAST(0.8 AS DOUBLE) ELSE 0.0 END AS v FROM vol JOIN k3 USING (z, y, x)", _axis("vol", "x", line_weights(1, False), "k1", 49), _axis("k1", "y", line_weights(1, False), "k2", 10), _axis("k2", "z", line_weights(1, False), "k3", 6)
    ),
    "trilinear_samples": _with(_trilinear("SELECT CAST((z * 11 + y) * 50 + x AS BIGINT) AS point_id, least(x + 0.75, 49) AS px, greatest(y - 0.25, 0) AS py, least(z + x / 16.0, 6) AS pz FROM vol WHERE z = 2")),
    "h_minima": f"""WITH RECURSIVE {_VOL},
r(n, z, y, x, i, v) AS (
 SELECT 0, z, y, x, v, v + 6 FROM vol
 UNION ALL
 SELECT p.n + 1, p.z, p.y, p.x, any_value(p.i), greatest(min(q.v), any_value(p.i)) FROM r p JOIN r q ON {_cube(1)} WHERE p.n < 100 GROUP BY p.n, p.z, p.y, p.x)
SELECT z, y, x, CASE WHEN v - i < 0.001 THEN CAST(0.8 AS DOUBLE) ELSE 0.0 END AS v FROM r WHERE n = 100""",
    "direction_counts": "SELECT CAST(l AS INT) AS level, CAST(5 * 4 ** l + 1 AS BIGINT) AS n FROM (VALUES (1), (2), (3)) v(l)",
    "line_weights": _weights_table(),
    "pass_schedule": "SELECT CAST(i AS INT) AS i, i * 0.25::DOUBLE AS c FROM range(5) r(i)",
    "sweep_schedule": "SELECT CAST(i AS INT) AS i, greatest(3.0 - i * 0.75, 0.5)::DOUBLE AS c FROM range(5) r(i)",
    "work_estimate": "SELECT CAST(3850 AS BIGINT) AS voxels, CAST(81 AS BIGINT) AS directions, CAST(4 * 6 AS BIGINT) AS line_samples, CAST(3850 * 81 * 24 AS BIGINT) AS work_items, CAST(3850 * 16 + 12 * 81 AS BIGINT) AS host_bytes, CAST(1 AS BIGINT) AS passes",
    "directional_threshold": _with("SELECT z, y, x, CASE WHEN v > least - (0.4 * (1 - alpha) + 0.2 * alpha) THEN CAST(0.8 AS DOUBLE) ELSE 0.0 END AS v FROM vol JOIN least_ USING (z, y, x)", *_directional()),
    "directional_response": _with("SELECT z, y, x, round(least, 2) AS least FROM least_", *_directional()),
    "threshold_sweep_final": _components(
        "(SELECT z, y, x FROM closed WHERE v <= 0.1 AND x BETWEEN 1 AND 48 AND y BETWEEN 1 AND 9 AND z BETWEEN 1 AND 5)", 1, _labelled(2),
        "m AS (SELECT z, y, x, CASE WHEN v >= t - 1 THEN 0.8 ELSE 0 END AS v FROM vol, t)", f"dil AS ({_extreme('max', _ball(1), 'm')})", f"closed AS ({_extreme('min', _ball(1), 'dil')})",
    ),
    "directional_segmentation_final": _components("(SELECT z, y, x FROM vol JOIN least_ USING (z, y, x) WHERE NOT v > least - (0.4 * (1 - alpha) + 0.2 * alpha))", 1, _labelled(3), *_directional()),
    "wall_thickness": _thickness(),
    "components_6": _components("(SELECT * FROM vol, t WHERE v >= t)", 1, _labelled(1)),
    "components_18": _components("(SELECT * FROM vol, t WHERE v >= t + 2)", 2, _labelled(2)),
    "components_26": _components("(SELECT * FROM vol, t WHERE v >= t + 3)", 3, _labelled(3)),
    "components_low": _components("(SELECT * FROM vol, t WHERE v <= t - 2 AND x % 7 <> 0)", 1, _labelled(3)),
    "component_table": _components(
        "(SELECT * FROM vol, t WHERE v >= t)", 1,
        """, sized AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS label FROM cc GROUP BY root)
SELECT CAST(label AS INT) AS label, count(*) AS size, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, round(avg(v), 6) AS mean FROM cc JOIN sized USING (root) JOIN vol ON (z * 11 + y) * 50 + x = cc.idx GROUP BY label""",
    ),
    "height_map": _with("SELECT y, x, round(v, 4) AS v FROM surf", *_SURFACE_CTES),
    "depth_map": _with("SELECT p.z, p.y, p.x, round(CASE WHEN p.z > h.v THEN sqrt(d) ELSE 0.0 END, 4) AS v FROM (SELECT p.z, p.y, p.x, min((p.x - s.x) ** 2 + (p.y - s.y) ** 2 + (p.z - s.v) ** 2) AS d FROM vol p, surf s GROUP BY p.z, p.y, p.x) p JOIN surf h ON h.y = p.y AND h.x = p.x", *_SURFACE_CTES),
    "projection_z": _with(
        "SELECT s.y, s.x, round(CASE WHEN coalesce(m, 0) < t - 2 THEN 0.0 ELSE coalesce(m, 0) END, 3) AS v FROM surf s LEFT JOIN best USING (y, x), t",
        *_SURFACE_CTES,
        "rays AS (SELECT y, x, v + 0.25 + k.i AS pz FROM surf, range(3) k(i))",
        "best AS (SELECT y, x, max(s) AS m FROM (SELECT r.y, r.x, pz, sum(q.v * (1 - abs(pz - q.z))) AS s FROM rays r JOIN vol q ON q.y = r.y AND q.x = r.x AND q.z BETWEEN CAST(floor(pz) AS INT) AND CAST(ceil(pz) AS INT) WHERE pz >= 0 AND pz <= 6 GROUP BY ALL) GROUP BY y, x)",
    ),
    "projection_normal": _with(
        "SELECT s.y, s.x, round(greatest(coalesce(m, 0), 0), 3) AS v FROM surf s LEFT JOIN best USING (y, x)",
        *_SURFACE_CTES,
        "near AS (SELECT *, lag(v) OVER rx AS l, lead(v) OVER rx AS r, lag(v) OVER cy AS u, lead(v) OVER cy AS d FROM surf WINDOW rx AS (PARTITION BY y ORDER BY x), cy AS (PARTITION BY x ORDER BY y))",
        """patch AS (SELECT y, x, v AS h,
 coalesce(CASE WHEN d IS NOT NULL THEN v - r END, 0) + coalesce(CASE WHEN d IS NOT NULL THEN l - v END, 0) + coalesce(CASE WHEN u IS NOT NULL THEN l - v END, 0) + coalesce(CASE WHEN u IS NOT NULL THEN r - v END, 0) AS sx,
 coalesce(CASE WHEN r IS NOT NULL THEN v - d END, 0) + coalesce(CASE WHEN l IS NOT NULL THEN v - d END, 0) + coalesce(CASE WHEN l IS NOT NULL THEN u - v END, 0) + coalesce(CASE WHEN r IS NOT NULL THEN u - v END, 0) AS sy,
 CAST((r IS NOT NULL AND d IS NOT NULL) AS INT) + CAST((l IS NOT NULL AND d IS NOT NULL) AS INT) + CAST((l IS NOT NULL AND u IS NOT NULL) AS INT) + CAST((r IS NOT NULL AND u IS NOT NULL) AS INT) AS sz FROM near)""",
        "rays AS (SELECT y, x, k.i AS step, x + sx / sqrt(sx * sx + sy * sy + sz * sz) * (k.i + 0.25) AS px, y + sy / sqrt(sx * sx + sy * sy + sz * sz) * (k.i + 0.25) AS py, h + sz / sqrt(sx * sx + sy * sy + sz * sz) * (k.i + 0.25) AS pz FROM patch, range(3) k(i))",
        "alive AS (SELECT *, max(CAST(px < 0 OR py < 0 OR pz < 0 OR px > 49 OR py > 10 OR pz > 6 AS INT)) OVER (PARTITION BY y, x ORDER BY step) AS ended FROM rays)",
        """best AS (SELECT y, x, max(s) AS m FROM (SELECT r.y, r.x, step, sum(q.v * (1 - abs(px - q.x)) * (1 - abs(py - q.y)) * (1 - abs(pz - q.z))) AS s FROM (SELECT * FROM alive WHERE ended = 0) r
 JOIN vol q ON q.x BETWEEN CAST(floor(px) AS INT) AND CAST(ceil(px) AS INT) AND q.y BETWEEN CAST(floor(py) AS INT) AND CAST(ceil(py) AS INT) AND q.z BETWEEN CAST(floor(pz) AS INT) AND CAST(ceil(pz) AS INT) GROUP BY ALL) GROUP BY y, x)""",
    ),
    "resample_area": _with(
        f"SELECT CAST(oz AS INT) AS z, y, x, round({_f32('sum(v * w) / sum(w)')}, 3) AS v FROM (SELECT o.i AS oz, p.i AS iz, least((o.i + 1) * s, p.i + 1.0) - greatest(o.i * s, p.i) AS w FROM (SELECT CAST(7 AS DOUBLE) / 11 AS s), range(11) o(i), range(7) p(i)) k JOIN vol ON z = iz WHERE w > 0 GROUP BY oz, y, x"
    ),
    "resample_lanczos2": _lanczos(2, 1.0),
    "resample_lanczos3": _lanczos(3, 3.0),
    "extract_xy": _with("SELECT y, x, v FROM vol WHERE z = 3"),
    "extract_yz": _with("SELECT y, z AS x, v FROM vol WHERE x = 20"),
    "extract_zx": _with("SELECT z AS y, x, v FROM vol WHERE y = 4"),
    "label_select": _with("SELECT DISTINCT label FROM cols WHERE label IN (0, 2, 9)", _COLS),
    "label_merge": _with("SELECT z, y, x, CASE WHEN label IN (1, 3, 4) THEN 3 ELSE label END AS label FROM cols", _COLS),
    "label_split": _components(
        "(SELECT * FROM cols WHERE label IN (0, 2))", 1,
        """, parts AS (SELECT g, root, row_number() OVER (PARTITION BY g ORDER BY root) AS k FROM (SELECT DISTINCT g, root FROM cc JOIN fg USING (idx))),
fresh AS (SELECT g, root, (SELECT max(label) FROM cols) + row_number() OVER (ORDER BY g, root) AS label FROM parts WHERE k > 1)
SELECT c.z, c.y, c.x, CAST(coalesce(f.label, c.label) AS INT) AS label FROM cols c LEFT JOIN (SELECT idx, label FROM cc JOIN fresh USING (root)) f ON f.idx = (c.z * 11 + c.y) * 50 + c.x""",
        _COLS, key="label",
    ),
    "label_dilate": _with(f"SELECT c.z, c.y, c.x, CASE WHEN c.label < 0 THEN coalesce(n, c.label) ELSE c.label END AS label FROM cols c LEFT JOIN (SELECT z + dz AS z, y + dy AS y, x + dx AS x, min(label) AS n FROM cols, {_FACES} WHERE label IN (1, 3) GROUP BY ALL) q USING (z, y, x)", _COLS),
    "label_erode": _with(
        f"SELECT c.z, c.y, c.x, CASE WHEN c.label IN (0, 2) AND coalesce(n, 0) < 6 THEN -1 ELSE c.label END AS label FROM cols c LEFT JOIN (SELECT a.z, a.y, a.x, count(*) AS n FROM cols a, {_FACES} JOIN cols b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx AND b.label = a.label GROUP BY ALL) q USING (z, y, x)", _COLS
    ),
    "label_crop": _with("SELECT c.z - lz AS z, c.y - ly AS y, c.x - lx AS x, CASE WHEN label IN (1, 2) THEN label ELSE -1 END AS label FROM cols c, (SELECT min(z) lz, max(z) hz, min(y) ly, max(y) hy, min(x) lx, max(x) hx FROM cols WHERE label IN (1, 2)) b WHERE c.z BETWEEN lz AND hz AND c.y BETWEEN ly AND hy AND c.x BETWEEN lx AND hx", _COLS),
    "label_select_by_mean": _with("SELECT label FROM cols JOIN vol USING (z, y, x), t WHERE label >= 0 GROUP BY label, t HAVING avg(v) >= t + 2", _COLS),
    "label_render": _with(
        "SELECT z, y, x, CAST(CASE WHEN label < 0 THEN 0 WHEN label = 2 THEN 255 ELSE (53 + label * 97) % 256 END AS INT) AS red, CAST(CASE WHEN label < 0 THEN 0 WHEN label = 2 THEN 218 ELSE (151 + label * 57) % 256 END AS INT) AS green, CAST(CASE WHEN label < 0 THEN 0 WHEN label = 2 THEN 74 ELSE (211 + label * 31) % 256 END AS INT) AS blue FROM cols", _COLS
    ),
    "metric_overlap": _with(
        "SELECT r AS reference_count, c AS candidate_count, k AS common, round(CASE WHEN r + c = 0 THEN 1.0 ELSE 2.0 * k / (r + c) END, 9) AS dice, round(CASE WHEN r > 0 THEN abs(c - r) / CAST(r AS DOUBLE) WHEN c = 0 THEN 0.0 ELSE 1.0 END, 9) AS volume_difference FROM (SELECT CAST(sum(a.l) AS BIGINT) AS r, CAST(sum(b.l) AS BIGINT) AS c, CAST(sum(a.l * b.l) AS BIGINT) AS k FROM a JOIN b USING (z, y, x))", _MASKS
    ),
    "metric_objects": _components("(SELECT * FROM vol, t WHERE v >= t + 2)", 3, "SELECT count(DISTINCT root) AS objects FROM cc"),
    "metric_hausdorff95": _with(
        "SELECT round(greatest((SELECT quantile_disc(d, 0.95) FROM ab), (SELECT quantile_disc(d, 0.95) FROM ba)), 9) AS hausdorff95", _MASKS, _hausdorff("a"), _hausdorff("b"),
        "ab AS (SELECT sqrt(min((p.z - q.z) ** 2 + (p.y - q.y) ** 2 + (p.x - q.x) ** 2)) AS d FROM sa p, sb q GROUP BY p.z, p.y, p.x)",
        "ba AS (SELECT sqrt(min((p.z - q.z) ** 2 + (p.y - q.y) ** 2 + (p.x - q.x) ** 2)) AS d FROM sb p, sa q GROUP BY p.z, p.y, p.x)",
    ),
    "label_select_at": _with("SELECT x, CASE WHEN label >= 0 THEN label ELSE -1 END AS label FROM cols WHERE y = 5 AND z = 3 AND x % 10 = 0", _COLS),
    "label_session_crop": _with(
        "SELECT z, y, x, CASE WHEN label IN (1, 3) THEN 1 ELSE -1 END AS label FROM cols, (SELECT min(z) lz, max(z) hz, min(y) ly, max(y) hy, min(x) lx, max(x) hx FROM cols WHERE label IN (1, 3)) WHERE z BETWEEN lz AND hz AND y BETWEEN ly AND hy AND x BETWEEN lx AND hx",
        _COLS,
    ),
    "label_session_undo": _with("SELECT z, y, x, CASE WHEN label IN (0, 2) THEN 2 ELSE label END AS label FROM cols", _COLS),
    "label_session_replace": _with("SELECT z, y, x, CASE WHEN label = 1 THEN -1 ELSE label END AS label, label IN (0, 4) AS selected FROM cols", _COLS),
    "label_ball_dilate": _with(f"SELECT p.z, p.y, p.x, CASE WHEN p.label < 0 THEN coalesce(min(q.label), p.label) ELSE p.label END AS label FROM cols p LEFT JOIN cols q ON q.label IN (1, 3) AND {_ball(2)} GROUP BY p.z, p.y, p.x, p.label", _COLS),
    "label_ball_erode": _with(f"SELECT p.z, p.y, p.x, CASE WHEN p.label IN (0, 2) AND bool_or(q.label <> p.label) THEN -1 ELSE p.label END AS label FROM cols p JOIN cols q ON {_ball(1)} GROUP BY p.z, p.y, p.x, p.label", _COLS),
    "copy_segments": _with("SELECT c.z, c.y, c.x, coalesce(m.label, c.label) AS label FROM cols c LEFT JOIN cols m ON m.label IN (0, 2) AND m.z = c.z AND m.y = c.y - 1 AND m.x = c.x - 5", _COLS),
    "overwrite_by_mask": _with("SELECT z, y, x, CASE WHEN v >= t + 1 THEN CAST(99 AS DOUBLE) ELSE v END AS v FROM vol, t"),
    "label_stack_round_trip": _with("SELECT z, y, x, label, CAST(16 AS INT) AS bits, CAST(1.75 AS DOUBLE) AS sz FROM cols", _COLS),
    "metric_report": _components(
        "(SELECT z, y, x FROM a WHERE l = 1 UNION ALL SELECT z + 100, y, x FROM b WHERE l = 1)", 3,
        """, n AS (SELECT (SELECT sum(l) FROM a) AS r, (SELECT sum(l) FROM b) AS c, (SELECT sum(a.l * b.l) FROM a JOIN b USING (z, y, x)) AS k,
 (SELECT count(DISTINCT root) FROM cc WHERE root < 50000) AS ro, (SELECT count(DISTINCT root) FROM cc WHERE root >= 50000) AS co,
 greatest((SELECT quantile_disc(d, 0.95) FROM ab), (SELECT quantile_disc(d, 0.95) FROM ba)) AS h),
f AS (SELECT *, 2.0 * k / (r + c) AS dice, abs(c - r) / CAST(r AS DOUBLE) AS difference FROM n)
SELECT CAST(r AS BIGINT) AS reference_count, CAST(c AS BIGINT) AS candidate_count, CAST(k AS BIGINT) AS common, round(dice, 9) AS dice, round(difference, 9) AS volume_difference, ro AS reference_objects, co AS candidate_objects,
 round(h, 9) AS hausdorff95, CAST(r AS DOUBLE) AS reference_volume, CAST(c AS DOUBLE) AS candidate_volume, 'voxel^3' AS unit,
 concat_ws(', ', CASE WHEN dice < 0.995 THEN 'dice' END, CASE WHEN ro <> co THEN 'object count' END, CASE WHEN difference > 0.005 THEN 'volume difference' END, CASE WHEN h > 1 THEN 'surface distance' END) AS failures,
 dice >= 0.995 AND ro = co AND difference <= 0.005 AND h <= 1 AS passed FROM f""",
        _MASKS, _hausdorff("a"), _hausdorff("b"),
        "ab AS (SELECT sqrt(min((p.z - q.z) ** 2 + (p.y - q.y) ** 2 + (p.x - q.x) ** 2)) AS d FROM sa p, sb q GROUP BY p.z, p.y, p.x)",
        "ba AS (SELECT sqrt(min((p.z - q.z) ** 2 + (p.y - q.y) ** 2 + (p.x - q.x) ** 2)) AS d FROM sb p, sa q GROUP BY p.z, p.y, p.x)",
    ),
    "synthetic_sphere": f"SELECT CAST(c.i AS INT) AS c, CAST(z.i AS INT) AS z, CAST(y.i AS INT) AS y, CAST(x.i AS INT) AS x, round({_f32('CASE WHEN (x.i - 11.5) ** 2 + (y.i - 9.5) ** 2 + ((z.i - 5.5) * 2) ** 2 <= 36 THEN 1 - c.i * 0.2 ELSE 0 END')}, 6) AS v FROM range(2) c(i), range(12) z(i), range(20) y(i), range(24) x(i)",
    "synthetic_ramp": f"SELECT CAST(z.i AS INT) AS z, CAST(y.i AS INT) AS y, CAST(x.i AS INT) AS x, round({_f32('(x.i + y.i + z.i) / CAST(27 AS DOUBLE)')}, 6) AS v FROM range(6) z(i), range(8) y(i), range(16) x(i)",
}


def _sweep(passes: int = 3, least: int = 3, area: float = 20.0, top: int = 1, radii: int = 4) -> str:
    """A threshold sweep pass by pass; a pass with nothing to wait for is the last.

    A component's closing: voxels whose ball of the radius lies in the union of
    the balls around the component.  Walls of up to 2 * ``radii`` are found.
    """
    ctes = ["lab0 AS (SELECT z, y, x, -1 AS label FROM vol)", "st0 AS (SELECT 0 AS known, 0 AS thick, true AS go, 0 AS passes)"]
    for p in range(passes):
        n, last = p + 1, p == passes - 1
        near = " AND (q.z - p.z) ** 2 + (q.y - p.y) ** 2 + (q.x - p.x) ** 2 <= r * r"
        ctes += [
            f"m{n} AS (SELECT z, y, x, CASE WHEN v >= t + {top - p} THEN 0.8 ELSE 0 END AS v FROM vol, t)",
            f"d{n} AS ({_extreme('max', _ball(1), f'm{n}')})",
            f"k{n} AS ({_extreme('min', _ball(1), f'd{n}')})",
            f"b{n} AS (SELECT z, y, x, label, CASE WHEN label >= 0 THEN 0 ELSE k.v END AS v FROM k{n} k JOIN lab{p} USING (z, y, x))",
        ]
        sums = []
        for r in range(1, radii + 1):
            ctes += [f"e{n}_{r} AS ({_extreme('min', _ball(r), f'b{n}')})", f"o{n}_{r} AS ({_extreme('max', _ball(r), f'e{n}_{r}')})"]
            sums.append(f"SELECT {r} AS r, sum(v) AS s FROM o{n}_{r}")
        ctes += [
            f"th{n} AS (SELECT 2 * min(r) AS thick FROM ({' UNION ALL '.join(sums)}), (SELECT sum(v) AS whole FROM b{n}), st{p} WHERE s <= whole / 2 AND r >= greatest(thick // 2, 1))",
            f"fg{n} AS (SELECT (z * 11 + y) * 50 + x AS idx, z, y, x FROM b{n} WHERE v <= 0.1 AND label < 0)",
            f"ed{n} AS (SELECT a.idx AS u, b.idx AS w FROM fg{n} a JOIN fg{n} b ON abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1)",
            f"""cc{n}(idx, root) USING KEY (idx) AS (
 SELECT idx, idx AS root FROM fg{n}
 UNION
 SELECT e.u, min(cc{n}.root) FROM cc{n} JOIN ed{n} e ON e.w = cc{n}.idx JOIN recurring.cc{n} r ON r.idx = e.u WHERE cc{n}.root < r.root GROUP BY e.u)""",
            f"cd{n} AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cand FROM cc{n} GROUP BY root HAVING count(*) > {least})",
            f"own{n} AS (SELECT z, y, x, cand FROM fg{n} JOIN cc{n} USING (idx) JOIN cd{n} USING (root))",
            f"wide{n} AS (SELECT DISTINCT p.cand, q.z, q.y, q.x FROM own{n} p, (SELECT thick // 2 AS r FROM th{n}) JOIN vol q ON {_cube(radii)}{near})",
            f"ball{n} AS (SELECT p.z, p.y, p.x, count(*) AS n FROM vol p, (SELECT thick // 2 AS r FROM th{n}) JOIN vol q ON {_cube(radii)}{near} GROUP BY ALL)",
            f"""shut{n} AS (SELECT p.cand, p.z, p.y, p.x, count(*) AS n FROM wide{n} p, (SELECT thick // 2 AS r FROM th{n}) JOIN wide{n} q ON q.cand = p.cand AND {_cube(radii)}{near} GROUP BY ALL)""",
            f"""bad{n} AS (SELECT s.cand, count(*) AS n FROM shut{n} s JOIN ball{n} f USING (z, y, x) JOIN lab{p} l USING (z, y, x) LEFT JOIN own{n} o USING (z, y, x) WHERE s.n = f.n AND o.cand IS NULL AND l.label < 0 GROUP BY s.cand)""",
            f"ok{n} AS (SELECT cand, {'true' if last else f'coalesce(b.n, 0) <= {area} * thick'} AS fine FROM cd{n} LEFT JOIN bad{n} b USING (cand), th{n})",
            f"id{n} AS (SELECT cand, row_number() OVER (ORDER BY cand) - 1 + known AS label FROM ok{n}, st{p} WHERE fine AND go)",
            f"lab{n} AS (SELECT l.z, l.y, l.x, coalesce(i.label, l.label) AS label FROM lab{p} l LEFT JOIN own{n} o USING (z, y, x) LEFT JOIN id{n} i ON i.cand = o.cand)",
            f"""st{n} AS (SELECT known + (SELECT count(*) FROM id{n}) AS known, CASE WHEN go THEN h.thick ELSE s.thick END AS thick,
 go AND (SELECT bool_or(NOT fine) FROM ok{n}) IS TRUE AS go, CASE WHEN go THEN {n} ELSE passes END AS passes FROM st{p} s, th{n} h)""",
        ]
    # each step is used more than once
    ctes = [c if c.startswith("cc") else c.replace(" AS (", " AS MATERIALIZED (", 1) for c in ctes]
    return f"""WITH RECURSIVE {_VOL}, {', '.join(ctes)}
SELECT z, y, x, CAST(label AS INT) AS label, CAST(passes AS INT) AS passes FROM lab{passes}, st{passes}"""


def _watershed(level: str, seeds: str, levels: int) -> str:
    """One step of growth, of opening or to the next level in each turn; the volume is the working table."""
    return f"""WITH RECURSIVE {_VOL},
flood(turn, z, y, x, lv, label, level, phase) AS (
 SELECT 0, z, y, x, CAST({level} AS INT), CASE WHEN {seeds} THEN x // 10 ELSE -1 END, 1, 0 FROM vol
 UNION ALL
 SELECT turn + 1, z, y, x, lv,
  CASE WHEN phase = 0 AND moves THEN grown WHEN phase = 0 THEN CASE WHEN label >= 0 AND differs THEN -1 ELSE label END ELSE grown END,
  CASE WHEN phase = 1 THEN level + 1 ELSE level END, CASE WHEN phase = 0 AND NOT moves THEN 1 ELSE 0 END
 FROM (
  SELECT *, bool_or(grown <> label) OVER () AS moves FROM (
   SELECT *, CASE WHEN label < 0 AND (phase = 1 OR lv <= level) THEN coalesce(CASE WHEN zl >= 0 THEN zl END, CASE WHEN xl >= 0 THEN xl END, CASE WHEN yl >= 0 THEN yl END, CASE WHEN xr >= 0 THEN xr END, CASE WHEN yr >= 0 THEN yr END, CASE WHEN zr >= 0 THEN zr END, label) ELSE label END AS grown,
    coalesce(zl <> label, false) OR coalesce(xl <> label, false) OR coalesce(yl <> label, false) OR coalesce(xr <> label, false) OR coalesce(yr <> label, false) OR coalesce(zr <> label, false) AS differs
   FROM (
    SELECT *, lag(label) OVER (PARTITION BY y, x ORDER BY z) AS zl, lead(label) OVER (PARTITION BY y, x ORDER BY z) AS zr, lag(label) OVER (PARTITION BY z, x ORDER BY y) AS yl, lead(label) OVER (PARTITION BY z, x ORDER BY y) AS yr,
     lag(label) OVER (PARTITION BY z, y ORDER BY x) AS xl, lead(label) OVER (PARTITION BY z, y ORDER BY x) AS xr
    FROM flood WHERE level <= {levels}))))
SELECT z, y, x, CAST(label AS INT) AS label FROM flood WHERE level = {levels + 1}"""

ORACLES["threshold_sweep"] = _sweep()
ORACLES["threshold_sweep_passes"] = ORACLES["threshold_sweep_tiles"] = _sweep(3, 30, 10.0, 3)
ORACLES["watershed"] = _watershed("v", "x % 10 = 5 AND y = 5 AND z = 3", 256)
ORACLES["watershed_blocks"] = ORACLES["watershed_tiles"] = _watershed("ceil(v / 8)", "abs(x % 10 - 5) <= 1 AND abs(y - 5) <= 1 AND abs(z - 3) <= 1", 8)
for _whole in ("h_minima", "components_26", "wall_thickness"):
    ORACLES[f"{_whole}_tiles"] = ORACLES[_whole]
