"""Queries over block fields, contexts and matrices, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.operators import fields, stencils, transforms
from tesselark.plans.grids import _CAUSAL, _DCT, _P, EMB, EVT, _token, _whole, r6, values_of
from tesselark.sources import planes
from tesselark.sources.planes import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_OPSIN = f"{EVT}, o AS MATERIALIZED (SELECT y, x, (value % 7 - 3.5) / 200 AS c0, value / 400 AS c1, value / 400 + ((y * 7 + x * 3) % 11 - 4) / 400::DOUBLE AS c2 FROM e)"


def _opsin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels made of the events' plane."""
    v = F.col("value")
    return planes.event_plane(spark, sf_dir).select("y", "x", ((v % 7 - 3.5) / 200).alias("c0"), (v / 400).alias("c1"), (v / 400 + ((F.col("y") * 7 + F.col("x") * 3) % 11 - 4) / F.lit(400.0)).alias("c2"))


def _slope(v: str) -> str:
    v = f"greatest({v}, 0.0::DOUBLE)"
    return f"(({fields.GAMMA_TOP!r} * {v} * {v} + 0.01) / ({fields.GAMMA_CUBE!r} * {v} * {v} * {v} + {fields.GAMMA_REST + fields.GAMMA_SMALL!r}))"


@query(f"""
    WITH {_OPSIN}, d AS (SELECT *, y // 8 AS "by", x // 8 AS bx, abs(c1 - lead(c1) OVER (PARTITION BY y, x // 8 ORDER BY x)) AS r, abs(c1 - lead(c1) OVER (PARTITION BY x, y // 8 ORDER BY y)) AS l FROM o),
    g AS (SELECT "by", bx, sum(least(0.0206::DOUBLE, coalesce(r, 0.0)) + least(0.0206::DOUBLE, coalesce(l, 0.0))) AS h, sum({_slope('c1 + 0.16 - c0')} + {_slope('c1 + 0.16 + c0')}) AS g,
          sum(greatest(0.0::DOUBLE, least(c2 - c1 - {fields.BLUE_OFFSET!r} - abs(c0), {fields.BLUE_LIMIT!r}::DOUBLE))) AS b FROM d GROUP BY "by", bx)
    SELECT "by", bx, round(h * -0.38 + 0.42, 9) + 0.0 AS high, round(log2(g / 128) * {fields.GAMMA_SLOPE!r}, 9) + 0.0 AS gamma,
           round(least(CASE WHEN b >= 32 * {fields.BLUE_LIMIT!r}::DOUBLE THEN 64 * {fields.BLUE_LIMIT!r}::DOUBLE - b ELSE b END, {fields.BLUE_MOST * fields.BLUE_LIMIT!r}::DOUBLE) * {fields.BLUE_SLOPE!r}, 9) + 0.0 AS blue FROM g
""")
def block_modulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded to nine places: the sums of steps are short decimals that end at the seventh."""
    m = fields.modulations(_opsin(spark, sf_dir))
    return m.withColumns({c: F.round(F.col(c), 9) + 0.0 for c in ("high", "gamma", "blue")})


@query(f"""
    WITH {_OPSIN}, n AS (SELECT a.c1, a.c2, greatest(abs(a.c0 - l.c0), abs(a.c0 - t.c0)) AS re, greatest(abs(a.c2 - a.c1 - l.c2 + l.c1), abs(a.c2 - a.c1 - t.c2 + t.c1)) AS be, abs(a.c2 - l.c2) + abs(a.c2 - t.c2) AS bs
          FROM o a JOIN o l ON l.y = a.y AND l.x = a.x - 1 JOIN o t ON t.y = a.y - 1 AND t.x = a.x),
    s AS (SELECT coalesce(max(re), 0.0) AS x_edge, coalesce(max(be), 0.0) AS b_edge, coalesce(max(greatest(0.0::DOUBLE, (c2 - 1.2 * c1) * bs)), 0.0) AS exposed_blue FROM n)
    SELECT round(x_edge, 6) + 0.0 AS x_edge, round(b_edge, 6) + 0.0 AS b_edge, round(exposed_blue, 6) + 0.0 AS exposed_blue,
      CAST(greatest(4, CASE WHEN x_edge >= 0.026 THEN 5 WHEN x_edge >= 0.022 THEN 4 WHEN x_edge >= 0.015 THEN 3 ELSE 2 END) AS INTEGER) AS x_scale,
      CAST(2 + CASE WHEN b_edge > 0.38 THEN 2 WHEN b_edge > 0.33 THEN 1 ELSE 0 END + CASE WHEN b_edge > 0.28 AND exposed_blue >= 0.13 THEN 1 ELSE 0 END AS INTEGER) AS b_scale FROM s
""")
def matrix_scale_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _opsin(spark, sf_dir)
    return r6(fields.matrix_scales(fields.edge_statistics(o, planes.extent(o)), 3.0), "x_edge", "b_edge", "exposed_blue")


_PROPS = f"""{_CAUSAL}, g AS (SELECT *, coalesce(lag(lf + tp - tl) OVER (PARTITION BY y ORDER BY x), 0) AS pg FROM n)"""


@query(f"WITH {_PROPS} SELECT 0::BIGINT AS channel, 0::BIGINT AS stream, y, x, abs(tp) AS top_size, abs(lf) AS left_size, tp AS top, lf AS left, lf - pg AS left_gradient_gap, lf + tp - tl AS slope, lf - tl AS left_step, tl - tp AS top_step, tp - tr AS right_step, tp - tt AS two_up_step, lf - ll AS two_left_step FROM g")
def context_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.properties(planes.integer_plane(planes.event_plane(spark, sf_dir))).select("p.*")


#: Five leaves (context, predictor) under questions on the slope, steps and the place.
TREE = ("slope", 5000, ("left_step", 0, ((0, "gradient"),), ("x", 49, ((1, "top"),), ((2, "average0"),))), ("left_gradient_gap", -100, ((3, "left"),), ((4, "select"),)))


def _by_leaf(*each: str) -> str:
    a, b, c, d, e = each
    return f"CASE WHEN lf + tp - tl > 5000 THEN CASE WHEN lf - tl > 0 THEN {a} WHEN x > 49 THEN {b} ELSE {c} END WHEN lf - pg > -100 THEN {d} ELSE {e} END"


@query(f"WITH {_PROPS} SELECT y, x, CAST({_by_leaf(*'01234')} AS BIGINT) AS context, {_by_leaf(*[_token(_P[k]) for k in ('gradient', 'top', 'average0', 'left', 'select')])} AS token FROM g")
def tree_context_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.leaf_tokens(planes.integer_plane(planes.event_plane(spark, sf_dir)), TREE)


_ORDER = values_of(list(enumerate(fields.ORDER_OF)), "strategy, family").replace("k(", "o(")
_CONTEXT = values_of(list(enumerate(fields.CONTEXT_OF)), "place, context")


@query(f"""
    WITH b AS (SELECT p_partkey, p_partkey % 27 AS strategy, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS r, (p_size > 10)::INT + (p_size > 20)::INT + (p_size > 40)::INT AS seg FROM part)
    SELECT p_partkey, CAST(k.context * 4 + seg AS INTEGER) AS context FROM b JOIN {_ORDER} USING (strategy) JOIN {_CONTEXT} ON k.place = r * 13 + o.family
""")
def block_context_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of 39 places, each cut into four by level."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", fields.block_context(key % 27, key % 3, F.col("p_size"), [10, 20, 40], [c * 4 + s for c in fields.CONTEXT_OF for s in range(4)]).alias("context"))


@query("""
    WITH a AS (SELECT event_id, user_id % 27 AS code, CAST(round(value) AS BIGINT) % 255 AS level, event_id // 1000 AS grp FROM events),
    p AS (SELECT *, coalesce(lag(code) OVER w, 0) AS c, coalesce(lag(level) OVER w, code) AS l FROM a WINDOW w AS (PARTITION BY grp ORDER BY event_id))
    SELECT event_id, CAST(CASE WHEN c > 11 THEN 7 WHEN c > 5 THEN 8 WHEN c > 3 THEN 9 ELSE 10 END AS BIGINT) AS code_context, 2 * code AS code_token,
           CAST(CASE WHEN l > 11 THEN 3 WHEN l > 5 THEN 4 WHEN l > 3 THEN 5 ELSE 6 END AS BIGINT) AS level_context, CASE WHEN level >= l THEN 2 * (level - l) ELSE 2 * (l - level) - 1 END AS level_token FROM p
""")
def block_metadata_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in order as anchors, a thousand to a group."""
    a = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 27).alias("code"), (F.round("value").cast("long") % 255).alias("level"), F.expr("event_id div 1000").alias("grp"))
    return fields.metadata_tokens(a, "grp", "event_id")


@query("""
    WITH b AS (SELECT event_id, event_id // 4 AS anchor, 1 + CAST(round(value) AS BIGINT) % 255 AS level, event_id % 8 AS sharpness FROM events),
    f AS (SELECT *, first(level) OVER (PARTITION BY anchor ORDER BY event_id) AS lv FROM b)
    SELECT event_id, round(1.0 / least(-1e-4::DOUBLE, 0.46::DOUBLE / (0.05 * lv * -1.1715728752538099) * sharpness / 7), 6) + 0.0 AS inverse_sigma FROM f
""")
def block_inverse_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms of four blocks in order of the events."""
    b = table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 4").alias("anchor"), (1 + F.round("value").cast("long") % 255).alias("level"), (F.col("event_id") % 8).alias("sharpness"))
    return r6(fields.inverse_sigma(b, "anchor", "event_id", 0.05).select("event_id", "inverse_sigma"), "inverse_sigma")


_M = fields.dequant_matrix(fields.BANDS[1])


@query(f"""
    WITH {_DCT}, s AS (SELECT d."by", d.bx, d.v, d.u, round(d.value, 9) / (k.weight * 40) AS c, k.weight FROM d JOIN {values_of(_M, 'v, u, weight')} ON k.v = d.v AND k.u = d.u),
    q AS (SELECT *, CASE WHEN abs(c) < 0.58 THEN 0 ELSE CAST(round_even(c, 0) AS BIGINT) END AS level FROM s)
    SELECT "by", bx, CAST(v AS INTEGER) AS v, CAST(u AS INTEGER) AS u, level, round(CASE WHEN level = 0 THEN 0.0 WHEN abs(level) = 1 THEN sign(level) * 0.93 ELSE level - 0.145 / level END * weight * 40, 6) + 0.0 AS value FROM q
""")
def dequantized_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of the plane's blocks, quantised by the middle channel's matrix and given back."""
    d = transforms.dct(_whole(spark, sf_dir)).withColumn("value", F.round("value", 9))
    q = fields.dequantize(fields.quantize_by_matrix(d, _M, 40.0), 40.0, 0.93, 0.145)
    return r6(q.select("by", "bx", "v", "u", "level", "value"), "value")


@query(f"WITH {EMB}, s AS (SELECT y // 2 AS y, x // 2 AS x, avg(value) AS m FROM p GROUP BY y // 2, x // 2) SELECT p.y, p.x, round(m, 6) + 0.0 AS value FROM p JOIN s ON s.y = p.y // 2 AND s.x = p.x // 2")
def expand_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The half-size plane, each of its samples as a 2x2 cell."""
    p = planes.embedding_plane(spark, sf_dir)
    return r6(fields.expand(stencils.subsample(p), planes.extent(p)), "value")
