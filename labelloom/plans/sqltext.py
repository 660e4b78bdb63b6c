"""SQL fragments of the second engine, shared by the query twins."""

from __future__ import annotations

from labelloom.functions import taxonomy as T
from labelloom.sources.adapter import STAR_INNER, STAR_POINTS, with_tables

__all__ = ["with_tables", "canonical", "multiplier", "carbon", "match", "iou", "greedy", "anchors", "audit", "severity"]


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def canonical(col: str) -> str:
    spaced = f"trim(regexp_replace(lower(coalesce({col}, '')), '[\\s_\\-]+', ' ', 'g'))"
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.ALIASES.items())
    return f"(CASE {spaced} WHEN '' THEN '{T.BACKGROUND}' {whens} ELSE replace({spaced}, ' ', '_') END)"


def carbon(col: str) -> str:
    whens = " ".join(f"WHEN {col} IN ({_quoted(m)}) THEN '{n}'" for n, m in T.CARBON_MEMBERS.items())
    return f"(CASE {whens} ELSE 'ordinary_tree' END)"


def multiplier(col: str) -> str:
    whens = " ".join(
        f"WHEN {col} IN ({_quoted(m)}) THEN {T.CARBON_MULTIPLIERS[n]}::DOUBLE" for n, m in T.CARBON_MEMBERS.items())
    return f"(CASE {whens} ELSE 1.0::DOUBLE END)"


def match(a: str, b: str) -> str:
    fam = _quoted(T.TREE_FAMILY)
    return f"(CASE WHEN {a} = {b} OR ({a} IN ({fam}) AND {b} IN ({fam})) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def severity(col: str) -> str:
    toks = f"string_split(trim(regexp_replace(lower({col}), '[^a-z0-9]+', ' ', 'g')), ' ')"

    def has(words):
        return f"list_has_any({toks}, [{_quoted(words)}])"

    return (f"(CASE WHEN trim(regexp_replace(lower({col}), '[^a-z0-9]+', ' ', 'g')) = '' THEN 'none' "
            f"WHEN {has(T.MISSING_TOKENS)} AND {has(T.PROTECTIVE_TOKENS)} THEN 'high' "
            f"WHEN {has(T.FALL_TOKENS)} THEN 'high' WHEN {has(T.FIRE_TOKENS)} THEN 'critical' "
            f"WHEN {has(T.PROTECTIVE_TOKENS)} THEN 'medium' WHEN {has(T.LOW_TOKENS)} THEN 'low' ELSE 'medium' END)")


def iou(a: str, b: str) -> str:
    inter = (f"greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
             f" * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))")
    area = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
    return f"(({inter}) / ({area.format(a)} + {area.format(b)} - {inter}))"


def greedy(name: str, edges: str, group: list[str], drive: str = "truth") -> str:
    """CTEs ``{name}`` (group, gt, seq, iou): one-to-one matches over ``edges`` (group, gt, seq, iou)."""
    g = ", ".join(group)
    order = "gt, iou DESC, seq" if drive == "truth" else "seq, iou DESC, gt"
    on = " AND ".join(f"e.{c} = w.{c}" for c in group)
    return f"""{name}_e AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY {order}) AS k FROM {edges}),
{name}_w AS (
  SELECT {g}, k, gt, seq, iou, true AS taken, [gt] AS ug, [seq] AS up FROM {name}_e WHERE k = 1
  UNION ALL
  SELECT {', '.join('e.' + c for c in group)}, e.k, e.gt, e.seq, e.iou,
    NOT (list_contains(w.ug, e.gt) OR list_contains(w.up, e.seq)),
    CASE WHEN list_contains(w.ug, e.gt) OR list_contains(w.up, e.seq) THEN w.ug ELSE list_append(w.ug, e.gt) END,
    CASE WHEN list_contains(w.ug, e.gt) OR list_contains(w.up, e.seq) THEN w.up ELSE list_append(w.up, e.seq) END
  FROM {name}_w w JOIN {name}_e e ON {on} AND e.k = w.k + 1),
{name} AS (SELECT {g}, gt, seq, iou FROM {name}_w WHERE taken)"""


def anchors(name: str, rows: str, group: list[str], order: str, threshold: float, op: str = ">=") -> str:
    """CTE ``{name}``: ``rows`` plus ``k`` (position) and ``anchor`` (position of the covering anchor)."""
    g = ", ".join(group)
    on = " AND ".join(f"e.{c} = w.{c}" for c in group)
    hit = iou("a", "e")
    first = f"list_filter(w.held, lambda a: {hit} {op} {threshold})[1].k"
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY {order}) AS k FROM {rows}),
{name}_w AS (
  SELECT {g}, k, [{{'k': k, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS held, k AS anchor FROM {name}_o WHERE k = 1
  UNION ALL
  SELECT {', '.join('e.' + c for c in group)}, e.k,
    CASE WHEN {first} IS NULL THEN list_append(w.held, {{'k': e.k, 'x1': e.x1, 'y1': e.y1, 'x2': e.x2, 'y2': e.y2}})
         ELSE w.held END,
    coalesce({first}, e.k)
  FROM {name}_w w JOIN {name}_o e ON {on} AND e.k = w.k + 1),
{name} AS (SELECT o.*, w.anchor FROM {name}_o o JOIN {name}_w w USING ({g}, k))"""


STEP = 2 * 3.141592653589793 / STAR_POINTS
# Star outline in unit form: point i has radius 1 or STAR_INNER.
STAR_PERIMETER = f"""(SELECT sum(sqrt(
   power((x2 - x1) / 2 * ((CASE WHEN (i + 1) % 2 = 0 THEN 1.0 ELSE {STAR_INNER} END) * cos((i + 1) * {STEP}::DOUBLE)
       - (CASE WHEN i % 2 = 0 THEN 1.0 ELSE {STAR_INNER} END) * cos(i * {STEP}::DOUBLE)), 2)
 + power((y2 - y1) / 2 * ((CASE WHEN (i + 1) % 2 = 0 THEN 1.0 ELSE {STAR_INNER} END) * sin((i + 1) * {STEP}::DOUBLE)
       - (CASE WHEN i % 2 = 0 THEN 1.0 ELSE {STAR_INNER} END) * sin(i * {STEP}::DOUBLE)), 2)))
 FROM (SELECT unnest(range({STAR_POINTS})) AS i))"""
STAR_AREA = f"((x2 - x1) * (y2 - y1) / 4 * {STAR_POINTS} / 2 * {STAR_INNER} * sin({STEP}::DOUBLE))"
STAR_HULL = f"((x2 - x1) * (y2 - y1) / 4 * {STAR_POINTS // 2} / 2 * sin({2 * STEP}::DOUBLE))"
OCTA_AREA = "(0.82 * (x2 - x1) * (y2 - y1))"
OCTA_PERIMETER = ("(0.8 * (x2 - x1) + 0.8 * (y2 - y1)"
                  " + 4 * sqrt(power(0.3 * (x2 - x1), 2) + power(0.3 * (y2 - y1), 2)))")


def audit(name: str, rows: str, group: list[str]) -> str:
    """CTE ``{name}``: audit verdict per group, from the known outline shapes."""
    g = ", ".join(group)

    def pen(c):
        return (f"CASE WHEN {c} = 0 THEN 1.0 WHEN {c} / total > 0.08 OR (total <= 10 AND {c} >= 2) OR {c} >= 5 "
                f"THEN 0.0 ELSE greatest(0.0, power(1.0 - 5.0 * {c} / total, 2)) END")

    return f"""{name}_q AS (SELECT *, shape IN ('none', 'rect') AS is_box, shape = 'star' AS is_spiky,
  CASE shape WHEN 'octagon' THEN 4 * pi() * {OCTA_AREA} / power({OCTA_PERIMETER}, 2)
             WHEN 'star' THEN 4 * pi() * {STAR_AREA} / power({STAR_PERIMETER}, 2) END AS q,
  CASE shape WHEN 'octagon' THEN 1.0::DOUBLE WHEN 'star' THEN {STAR_AREA} / {STAR_HULL} END AS c FROM {rows}),
{name}_n AS (SELECT {g}, count(*) AS total, count(*) FILTER (is_box) AS box_count,
  count(*) FILTER (is_spiky) AS spiky_count, coalesce(avg(q), 0.70) AS mq, coalesce(avg(c), 0.85) AS mc
  FROM {name}_q GROUP BY ALL),
{name}_p AS (SELECT *, {pen('box_count')} AS bp, {pen('spiky_count')} AS sp FROM {name}_n),
{name} AS (SELECT *, round(bp * sp, 4) AS quality, round(bp * sp, 4) >= 0.70
    AND NOT (box_count > 0 AND bp = 0) AND NOT (spiky_count > 0 AND sp = 0) AS acceptable,
  nullif(concat_ws('; ',
    CASE WHEN box_count > 0 AND bp = 0 THEN 'box_gaming_detected: excessive_box_polygons (' || box_count || '/' || total
      || ' boxes, ' || printf('%.1f', box_count * 100.0 / total) || '%)' END,
    CASE WHEN spiky_count > 0 AND sp = 0 THEN 'spiky_erratic_polygons (' || spiky_count || '/' || total || ', '
      || printf('%.1f', spiky_count * 100.0 / total) || '%)' END), '') AS reason
  FROM {name}_p)"""


_OCTA_POINTS = ", ".join(f"{{'x': x1 + (x2 - x1) * {a}::DOUBLE, 'y': y1 + (y2 - y1) * {b}::DOUBLE}}" for a, b in (
    (0.3, 0.0), (0.7, 0.0), (1.0, 0.3), (1.0, 0.7), (0.7, 1.0), (0.3, 1.0), (0.0, 0.7), (0.0, 0.3)))
_RADIUS = f"(CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE {STAR_INNER}::DOUBLE END)"
# Points of an annotation's outline, and of a golden object's.
ANNOTATION_POINTS = f"""CASE shape WHEN 'rect' THEN [{{'x': x1, 'y': y1}}, {{'x': x2, 'y': y1}}, {{'x': x2, 'y': y2}}, {{'x': x1, 'y': y2}}]
  WHEN 'octagon' THEN [{_OCTA_POINTS}] WHEN 'star' THEN list_transform(range(0, {STAR_POINTS}), lambda i: {{
    'x': (x1 + x2) / 2 + (x2 - x1) / 2 * {_RADIUS} * cos(i * {STEP}::DOUBLE), 'y': (y1 + y2) / 2 + (y2 - y1) / 2 * {_RADIUS} * sin(i * {STEP}::DOUBLE)}}) END"""
GOLDEN_POINTS = f"CASE WHEN (item_id + gt) % 5 <> 4 THEN [{_OCTA_POINTS}] END"


def outline_overlap(name: str, pairs: str) -> str:
    """CTEs ``{name}``: ``pairs`` (pid, p, q: lists of points; ax1.. and bx1..: boxes) with iou by pixel centres.

    In every pixel row of the joint box the edges of both outlines are events at the first pixel beyond their crossing;
    between two events an outline covers where it has met an odd number of its own.
    """
    def edges(which: int, points: str) -> str:
        return f"""SELECT pid, {which} AS which, w, h, {points}[i].x - x0 AS px, {points}[i].y - y0 AS py, {points}[i % len({points}) + 1].x - x0 AS qx, {points}[i % len({points}) + 1].y - y0 AS qy
          FROM {name}_j, unnest(range(1, len({points}) + 1)) AS u(i) WHERE p IS NOT NULL AND q IS NOT NULL"""

    inter = "greatest(0.0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0.0, least(ay2, by2) - greatest(ay1, by1))"
    area = "(ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1)"
    return f"""{name}_j AS (SELECT *, least(ax1, bx1) AS x0, least(ay1, by1) AS y0, ceil(greatest(ax2, bx2) - least(ax1, bx1)) AS w, ceil(greatest(ay2, by2) - least(ay1, by1)) AS h FROM {pairs}),
{name}_e AS ({edges(0, 'p')} UNION ALL {edges(1, 'q')}),
{name}_c AS (SELECT pid, which, r, greatest(0, least(w, ceil(px + (r + 0.5 - py) * (qx - px) / (qy - py) - 0.5))) AS c FROM {name}_e,
  unnest(range(greatest(0, ceil(least(py, qy) - 0.5))::BIGINT, least(h, ceil(greatest(py, qy) - 0.5))::BIGINT)) AS u(r)),
{name}_n AS (SELECT pid, lead(c) OVER o - c AS len, sum((which = 0)::INT) OVER o % 2 = 1 AS a, sum((which = 1)::INT) OVER o % 2 = 1 AS b FROM {name}_c
  WINDOW o AS (PARTITION BY pid, r ORDER BY c, which ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name}_s AS (SELECT pid, sum(len) FILTER (a AND b) AS both_, sum(len) FILTER (a OR b) AS either_ FROM {name}_n GROUP BY pid),
{name} AS (SELECT j.*, CASE WHEN p IS NULL OR q IS NULL THEN {inter} / ({area} - {inter}) WHEN coalesce(either_, 0) = 0 THEN 0.0 ELSE coalesce(both_, 0) / either_ END AS iou
  FROM {name}_j j LEFT JOIN {name}_s s ON j.pid = s.pid)"""
