"""Queries over planes: maps, stencils, block aggregations and transforms, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.functions import pointwise as pw
from tesselark.operators import blocks, prediction, stencils, transforms, wavefronts
from tesselark.sources import planes

EMB = "p AS MATERIALIZED (SELECT vec_id AS y, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS x, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
EVT = "e AS MATERIALIZED (SELECT event_id // 100 AS y, event_id % 100 AS x, CAST(value AS DOUBLE) AS value FROM events)"
INT = EVT + ", i AS (SELECT y, x, CAST(round(value * 100) AS BIGINT) AS value FROM e)"
#: Extents of both planes, for the mirrored joins.
SIZE = "s AS MATERIALIZED (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM {t})"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded to six places, as sums depend on their order."""
    return df.withColumns({c: F.round(F.col(c), 6) + 0.0 for c in columns})


def values_of(taps: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(repr(v) if isinstance(v, float) else str(v).upper() for v in t) + ')' for t in taps)}) AS k({names})"


def mirrored(at: str, n: str) -> str:
    return f"CASE WHEN {at} < 0 THEN -1 - ({at}) WHEN {at} >= {n} THEN 2 * {n} - 1 - ({at}) ELSE {at} END"


def pulled(table: str, taps: list[tuple], names: str, edge: str) -> str:
    """FROM clause of targets t with their taps k, joined with the sample q that each tap takes."""
    y, x = {
        "mirror": (mirrored("t.y + k.dy", "s.h"), mirrored("t.x + k.dx", "s.w")),
        "clamp": ("greatest(0, least(t.y + k.dy, s.h - 1))", "greatest(0, least(t.x + k.dx, s.w - 1))"),
        "drop": ("t.y + k.dy", "t.x + k.dx"),
    }[edge]
    return f"(SELECT t.*, k.*, {y} AS qy, {x} AS qx FROM {table} t CROSS JOIN s CROSS JOIN {values_of(taps, names)}) t JOIN {table} q ON q.y = t.qy AND q.x = t.qx"


# ---- pointwise maps


@query("""
    WITH u AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) - 5000 AS v FROM events),
    t AS (SELECT event_id, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS token FROM u),
    b AS (SELECT *, length(bin(token)) - 1 AS e FROM t)
    SELECT event_id, token,
           CASE WHEN token < 16 THEN token ELSE 16 + ((e - 4) * 4) + ((token - (1::BIGINT << e)) >> (e - 2)) END AS symbol,
           CASE WHEN token < 16 THEN 0 ELSE e - 2 END AS extra_count,
           CASE WHEN token < 16 THEN 0 ELSE token & ((1::BIGINT << (e - 2)) - 1) END AS extra
    FROM b
""")
def hybrid_uint_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = planes.table(spark, sf_dir, "events").select("event_id", (F.round(F.col("value") * 100).cast("long") - 5000).alias("v"))
    t = e.select("event_id", pw.pack_signed(F.col("v")).alias("token"))
    return t.select("event_id", "token", pw.hybrid_uint(F.col("token")).alias("h")).select("event_id", "token", "h.symbol", "h.extra_count", "h.extra")


@query(f"""
    WITH u AS (SELECT event_id, CAST(value AS DOUBLE) - 50 AS v, abs(CAST(value AS DOUBLE) - 50) / 10 AS d FROM events),
    m AS (SELECT *, greatest(d * {pw.MASK_SCALE!r}, 1e-3) AS v1 FROM u)
    SELECT event_id,
      round(CASE WHEN v >= 20 THEN (v - 20) * {pw.CLAMP_SLOPE!r} + 20 WHEN v < -20 THEN (v + 20) * {pw.CLAMP_SLOPE!r} - 20 ELSE v END, 6) + 0.0 AS clamped,
      round(CASE WHEN v > 5 THEN v - 5 WHEN v < -5 THEN v + 5 ELSE 0.0 END, 6) + 0.0 AS removed,
      round(CASE WHEN v > 5 THEN v + 5 WHEN v < -5 THEN v - 5 ELSE v + v END, 6) + 0.0 AS amplified,
      round(d * (46.0 / (v * v + 46.0) * {1 - pw.SUPPRESS_LEAST!r} + {pw.SUPPRESS_LEAST!r}), 6) + 0.0 AS suppressed,
      round(pow({1 / (pw.MASK_Y[0] * pw.INTENSITY)!r} * (1.0 + {pw.MASK_Y[1]!r} / ({pw.MASK_Y[2]!r} * d + {pw.MASK_Y[3]!r})), 2), 6) + 0.0 AS mask_y,
      round(pow({1 / (pw.MASK_DC_Y[0] * pw.INTENSITY)!r} * (1.0 + {pw.MASK_DC_Y[1]!r} / ({pw.MASK_DC_Y[2]!r} * d + {pw.MASK_DC_Y[3]!r})), 2), 6) + 0.0 AS mask_dc_y,
      round({pw.MASK_BASE!r} + {pw.MASK_TERMS[0]!r} / (v1 * v1 + {0.25 * pw.MASK_OFFSET_3!r}) + {pw.MASK_TERMS[1]!r} / (v1 + {pw.MASK_OFFSET_2!r}) + {pw.MASK_TERMS[2]!r} / (v1 * v1 + {pw.MASK_OFFSET_3!r}), 6) + 0.0 AS block_mask,
      round(0.25 * sqrt(d * {(pw.SQRT_SCALE * 1e8) ** 0.5!r} + {pw.SQRT_OFFSET!r}), 6) + 0.0 AS masking_sqrt
    FROM m
""")
def psychovisual_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value").cast("double") - 50
    e = planes.table(spark, sf_dir, "events").select("event_id", v.alias("v"), (F.abs(v) / 10).alias("d"))
    v, d = F.col("v"), F.col("d")
    out = {"clamped": pw.maximum_clamp(v, 20.0), "removed": pw.remove_range(v, 5.0), "amplified": pw.amplify_range(v, 5.0), "suppressed": pw.suppress_x_by_y(v, d), "mask_y": pw.rational_mask(d, pw.MASK_Y), "mask_dc_y": pw.rational_mask(d, pw.MASK_DC_Y), "block_mask": pw.block_mask(d), "masking_sqrt": pw.masking_sqrt(d)}
    return r6(e.select("event_id", *[c.alias(k) for k, c in out.items()]), *out)


@query("""
    WITH u AS (SELECT event_id, CAST(value AS DOUBLE) AS v, CAST(value AS DOUBLE) - 50 AS x, CAST(round(value) AS BIGINT) - 50 AS q, event_id % 256 AS byte FROM events)
    SELECT event_id,
      CAST(least(greatest(round(CASE WHEN x >= 2.6 THEN x - 2.6 WHEN x <= -2.6 THEN x + 2.6 ELSE 0.0 END), -128.0), 127.0) AS INTEGER) AS multiplier,
      round(CASE WHEN v / 60 < 0.5 THEN v / 60 * 2 WHEN v / 60 > 1 THEN v / 60 ELSE 1.0 END, 6) + 0.0 AS error_multiplier,
      round(CASE WHEN v >= 100 THEN 0.0 WHEN v >= 30 THEN 0.1 + (100 - v) * 0.09 ELSE 53.0 / 3000 * v * v - 23.0 / 20 * v + 25.0 END, 9) + 0.0 AS distance,
      round(CASE WHEN byte / 255.0 <= 0.04045 THEN byte / 255.0 / 12.92 ELSE pow((byte / 255.0 + 0.055) / 1.055, 2.4) END, 6) + 0.0 AS linear,
      round(CASE WHEN q = 0 THEN 0.0 WHEN abs(q) = 1 THEN sign(q) * 0.93 ELSE q - 0.145 / q END, 6) + 0.0 AS unbiased,
      CASE WHEN (event_id - 5000) % 194 >= 0 THEN (CASE WHEN (event_id - 5000) % 194 < 97 THEN (event_id - 5000) % 194 ELSE 193 - (event_id - 5000) % 194 END)
           ELSE (CASE WHEN (event_id - 5000) % 194 + 194 < 97 THEN (event_id - 5000) % 194 + 194 ELSE -1 - (event_id - 5000) % 194 END) END AS mirrored
    FROM u
""")
def scalar_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = planes.table(spark, sf_dir, "events").select("event_id", F.col("value").cast("double").alias("v"))
    v = F.col("v")
    q = F.round(v).cast("long") - 50
    out = {"error_multiplier": pw.error_multiplier(v / 60), "distance": pw.distance_from_quality(v), "linear": pw.srgb_to_linear(F.col("event_id") % 256), "unbiased": pw.adjust_quantization_bias(q, 0.93, 0.145)}
    df = e.select("event_id", pw.quantize_multiplier(v - 50).alias("multiplier"), *[c.alias(k) for k, c in out.items()], pw.mirror(F.col("event_id") - 5000, 97).alias("mirrored"))
    return r6(df, *(c for c in out if c != "distance")).withColumn("distance", F.round("distance", 9) + 0.0)


def _rct_sql(kind: int) -> str:
    p, t = divmod(kind, 7)
    s = ("a", "b", "c")
    a, b, c = s[p % 3], s[(p + 1 + p // 3) % 3], s[(p + 2 - p // 3) % 3]
    if t == 6:
        mid = f"({c} + (({a} - {c}) >> 1))"
        x, y, z = f"{mid} + (({b} - {mid}) >> 1)", f"{a} - {c}", f"{b} - {mid}"
    else:
        x, y, z = a, {0: b, 1: f"{b} - {a}", 2: f"{b} - (({a} + {c}) >> 1)"}[t // 2], f"{c} - {a}" if t & 1 else c
    return f"SELECT {kind} AS kind, CAST(sum({x}) AS BIGINT) AS s0, CAST(sum({y}) AS BIGINT) AS s1, CAST(sum({z}) AS BIGINT) AS s2, CAST(sum(abs({y}) + abs({z})) AS BIGINT) AS magnitude, 0::BIGINT AS wrong FROM n"


RCT_KINDS = range(42)


@query("WITH n AS (SELECT CAST(l_quantity AS BIGINT) AS a, l_partkey % 256 AS b, l_suppkey % 256 AS c FROM lineitem) " + " UNION ALL ".join(map(_rct_sql, RCT_KINDS)))
def rct_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of every colour transform's channels, and how many rows its inverse gets wrong."""
    n = planes.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("a"), (F.col("l_partkey") % 256).alias("b"), (F.col("l_suppkey") % 256).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    rows = []
    for k in RCT_KINDS:
        x, y, z = pw.forward_rct(a, b, c, k)
        back = pw.inverse_rct(x, y, z, k)
        wrong = F.count_if((back[0] != a) | (back[1] != b) | (back[2] != c))
        rows.append(F.struct(F.lit(k).alias("kind"), F.sum(x).alias("s0"), F.sum(y).alias("s1"), F.sum(z).alias("s2"), F.sum(F.abs(y) + F.abs(z)).alias("magnitude"), wrong.alias("wrong")))
    return n.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


# ---- blocks and reductions


@query(f"WITH {EMB} SELECT y // 8 AS by, x // 8 AS bx, round(1.2 * pow(avg(pow(value, 16)), 1 / 16.0), 6) + 0.0 AS norm FROM p GROUP BY ALL")
def block_p16_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(blocks.block_norm(planes.embedding_plane(spark, sf_dir)), "norm")


@query(f"WITH {EMB} SELECT min(value) AS least, max(value) AS greatest, max(abs(value)) AS magnitude FROM p")
def plane_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.extrema(planes.embedding_plane(spark, sf_dir))


@query("SELECT user_id, count(*) AS blocks, round(CASE WHEN count(*) <= 2 THEN max(value / 100) ELSE pow(avg(pow(value / 100, 16)), 1 / 16.0) END, 6) + 0.0 AS norm FROM events GROUP BY user_id")
def transform_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = planes.table(spark, sf_dir, "events").select("user_id", (F.col("value") / 100).alias("value"))
    return r6(blocks.quant_norm(e, "user_id"), "norm")


@query("SELECT event_id // 3 AS cell, count(*) AS blocks, round(max(value), 6) + 0.0 AS value FROM events GROUP BY ALL HAVING count(*) < 4 UNION ALL "
       f"SELECT -1 - user_id, count(*), round(CASE WHEN count(*) >= 4 THEN max(value) * {1 - (2.0 - 1.54138) * 0.56391!r} + avg(value) * {1 - (1 - (2.0 - 1.54138) * 0.56391)!r} ELSE max(value) END, 6) + 0.0 FROM events GROUP BY user_id")  # fmt: skip
def transform_max_mean_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small cells keep their maximum; users, with more values, get the mix."""
    e = planes.table(spark, sf_dir, "events")
    cells = e.select(F.expr("event_id div 3").alias("cell"), "value").unionByName(e.select((-1 - F.col("user_id")).alias("cell"), "value"))
    return r6(blocks.mean_max_mix(cells, "cell", 2.0), "value")


_W5 = {0: 0.25, 1: 0.08, 2: 0.05, 4: 0.03, 5: 0.01, 8: 0.0075}
_T5 = stencils.symmetric5(_W5)
_CONV = f"{EMB}, {SIZE.format(t='p')}, c AS MATERIALIZED (SELECT t.y, t.x, sum(q.value * t.wt) AS value FROM {pulled('p', _T5, 'dy, dx, wt', 'mirror')} GROUP BY t.y, t.x)"


@query(f"WITH {_CONV} SELECT y, x, round(value, 6) + 0.0 AS value FROM c")
def conv5_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planes.embedding_plane(spark, sf_dir)
    return r6(stencils.convolve(p, _T5, planes.extent(p)), "value")


@query(f"""
    WITH {_CONV}, d AS (SELECT p.y % 3 AS channel, p.y // 8 AS by, p.x // 8 AS bx, abs(p.value - c.value) / CASE p.y % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 2.0 END AS e FROM p JOIN c USING (y, x))
    SELECT CAST(channel AS INTEGER) AS channel, d.by, d.bx, round(max(e), 6) + 0.0 AS error FROM d GROUP BY GROUPING SETS ((channel, d.by, d.bx), (channel))
""")
def block_max_error_vs_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planes.embedding_plane(spark, sf_dir)
    blur = stencils.convolve(p, _T5, planes.extent(p)).withColumnRenamed("value", "b")
    pairs = p.withColumnRenamed("value", "a").join(blur, ["y", "x"]).withColumn("channel", (F.col("y") % 3).cast("int"))
    return r6(blocks.maximum_error(pairs, {0: 0.5, 1: 1.0, 2: 2.0}), "error")


@query(f"""
    WITH {EVT} SELECT y // 8 AS by, x // 8 AS bx,
      round(sum(CASE y % 3 WHEN 0 THEN 12.339445295782363 WHEN 1 THEN 1.0 ELSE 0.2 END * pow(1.0 / (1 + x % 5), 2) * pow(value - round(value), 2)), 6) + 0.0 AS error FROM e GROUP BY ALL
""")
def masked_block_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = planes.event_plane(spark, sf_dir)
    pairs = e.select("y", "x", (F.col("y") % 3).cast("int").alias("channel"), F.col("value").alias("a"), F.round("value").alias("b"), (1.0 / (1 + F.col("x") % 5)).alias("mask"))
    return r6(blocks.masked_error(pairs, {0: 12.339445295782363, 1: 1.0, 2: 0.2}), "error")


@query("SELECT event_type, user_id % 10 AS family, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type, user_id % 10), (event_type), (user_id % 10))")
def joint_and_margin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = planes.table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("family"))
    return blocks.cube_counts(e, "event_type", "family")


@query("SELECT CAST(CASE WHEN count(*) > 256 THEN 0 ELSE count(*) END AS BIGINT) AS tuples FROM (SELECT DISTINCT p_brand, p_size % 10 FROM part)")
def palette_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.distinct_tuples(planes.table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 10).alias("s")), ["p_brand", "s"])


@query(f"WITH {EMB}, q AS (SELECT y, x, CAST(round_even(value * 8, 0) AS BIGINT) AS value FROM p) SELECT y, count(*) AS nonzero, CAST(sum(value) AS BIGINT) AS total FROM q WHERE value <> 0 GROUP BY y")
def sparse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planes.embedding_plane(spark, sf_dir).withColumn("value", F.rint(F.col("value") * 8).cast("long"))
    return blocks.sparse(p).groupBy("y").agg(F.count("*").alias("nonzero"), F.sum("value").alias("total"))


# ---- stencils

_K = stencils.gaussian_kernel(1.5)
_R = len(_K) // 2


def _pass(source: str, name: str, taps: list[tuple]) -> str:
    return f"{name} AS (SELECT t.y, t.x, sum(q.value * t.wt) / sum(t.wt) AS value FROM {pulled(source, taps, 'dy, dx, wt', 'drop')} GROUP BY t.y, t.x)"


@query(f"WITH {EMB}, {SIZE.format(t='p')}, {_pass('p', 'a', [(0, d, k) for d, k in zip(range(-_R, _R + 1), _K, strict=True)])}, {_pass('a', 'b', [(d, 0, k) for d, k in zip(range(-_R, _R + 1), _K, strict=True)])} SELECT y, x, round(value, 6) + 0.0 AS value FROM b")
def gaussian_blur_renorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planes.embedding_plane(spark, sf_dir)
    return r6(stencils.separable(p, _K, planes.extent(p)), "value")


_G = [(dy, dx, (1.0, 0.115169525, 0.061248592)[abs(dy) + abs(dx)] / (1 + 4 * (0.115169525 + 0.061248592))) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


@query(f"WITH {EVT}, {SIZE.format(t='e')} SELECT t.y, t.x, round(sum(q.value * t.wt), 6) + 0.0 AS value FROM {pulled('e', _G, 'dy, dx, wt', 'mirror')} GROUP BY t.y, t.x")
def smooth3_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = planes.event_plane(spark, sf_dir)
    return r6(stencils.gaborish(e, 0.115169525, 0.061248592, planes.extent(e)), "value")


_N9 = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
_E = stencils.erosion_weights(1.2)


@query(f"""
    WITH {EVT}, {SIZE.format(t='e')}, n AS (SELECT t.y, t.x, list_sort(list(q.value)) AS l FROM {pulled('e', _N9, 'dy, dx', 'clamp')} GROUP BY t.y, t.x)
    SELECT y // 2 AS y, x // 2 AS x, round(sum({' + '.join(f'{w!r} * l[{i + 1}]' for i, w in enumerate(_E))}), 6) + 0.0 AS value FROM n GROUP BY y // 2, x // 2
""")
def fuzzy_erosion_4min(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = planes.event_plane(spark, sf_dir)
    return r6(stencils.fuzzy_erosion_half(e, 1.2, planes.extent(e)), "value")


_N3 = [(dy, dx) for dy in (-3, 0, 3) for dx in (-3, 0, 3)]


@query(f"""
    WITH {EVT}, {SIZE.format(t='e')}, v AS (SELECT t.y, t.x, q.value AS v FROM {pulled('e', _N3, 'dy, dx', 'drop')} UNION ALL SELECT y, x, 2 * value FROM e UNION ALL SELECT y, x, 2 * value FROM e),
    n AS (SELECT y, x, list_sort(list(v)) AS l FROM v GROUP BY y, x)
    SELECT y, x, round(0.45 * l[1] + 0.3 * l[2] + 0.25 * l[3], 6) + 0.0 AS value FROM n
""")
def fuzzy_erosion_3min(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = planes.event_plane(spark, sf_dir)
    return r6(stencils.fuzzy_erosion_wide(e, planes.extent(e)), "value")


_S9 = [(dy, dx, (1 - 4 * (stencils.SIDE + stencils.CORNER), stencils.SIDE, stencils.CORNER)[abs(dy) + abs(dx)]) for dy, dx in _N9]


@query(f"""
    WITH {EVT}, {SIZE.format(t='e')}, g AS (SELECT t.y, t.x, t.value AS c, count(*) AS n, sum(q.value * t.wt) AS s, sum(q.value * q.value / 100 * t.wt) AS s2 FROM {pulled('e', _S9, 'dy, dx, wt', 'drop')} GROUP BY t.y, t.x, t.value),
    f AS (SELECT *, c * c / 100 AS c2, greatest(0.0, 3 - 4 * greatest(0.5, abs((c - s) / 40.0), abs((c * c / 100 - s2) / 60.0))) AS factor FROM g)
    SELECT y, x, round(CASE WHEN n = 9 THEN (s - c) * factor + c ELSE c END, 6) + 0.0 AS c0, round(CASE WHEN n = 9 THEN (s2 - c2) * factor + c2 ELSE c2 END, 6) + 0.0 AS c1 FROM f
""")
def smooth_gap_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = planes.event_plane(spark, sf_dir)
    two = e.select("y", "x", F.col("value").alias("c0"), (F.col("value") * F.col("value") / 100).alias("c1"))
    return r6(stencils.smooth_dc(two, {"c0": 40.0, "c1": 60.0}, planes.extent(e)), "c0", "c1")


@query(f"WITH {EMB} SELECT y // 2 AS y, x // 2 AS x, round(avg(value), 6) + 0.0 AS value FROM p GROUP BY y // 2, x // 2")
def subsample_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stencils.subsample(planes.embedding_plane(spark, sf_dir)), "value")


@query(f"WITH {EVT} SELECT round(max(abs(a.value - l.value)), 6) + 0.0 AS horizontal, round(max(abs(a.value - t.value)), 6) + 0.0 AS vertical FROM e a LEFT JOIN e l ON l.y = a.y AND l.x = a.x - 1 LEFT JOIN e t ON t.x = a.x AND t.y = a.y - 1")
def edge_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = planes.event_plane(spark, sf_dir)
    return r6(stencils.edge_maxima(e, planes.extent(e)), "horizontal", "vertical")


@query(f"WITH {EMB} SELECT a.y // 8 AS by, a.x // 8 AS bx, round(sum(0.7 * pow(a.value - b.value, 2)), 6) + 0.0 AS l2 FROM p a JOIN p b ON b.y = a.y + 1 AND b.x = a.x GROUP BY ALL")
def weighted_l2_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted squared difference of two aligned planes: the plane and itself one row on."""
    p = planes.embedding_plane(spark, sf_dir)
    pair = p.join(p.select((F.col("y") - 1).alias("y"), "x", F.col("value").alias("b")), ["y", "x"])
    d = F.col("value") - F.col("b")
    return r6(pair.groupBy(*blocks.cell(8)).agg(F.sum(0.7 * d * d).alias("l2")), "l2")


_L = stencils.line_taps()


@query(f"""
    WITH {EVT}, {SIZE.format(t='e')}, l AS (SELECT t.y, t.x, t.line, sum(q.value) AS v FROM {pulled('e', _L, 'dy, dx, line', 'drop')} GROUP BY t.y, t.x, t.line)
    SELECT y, x, round(sum(v * v), 4) + 0.0 AS value FROM l GROUP BY y, x
""")
def line_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = planes.event_plane(spark, sf_dir)
    return stencils.line_energy(e, planes.extent(e)).withColumn("value", F.round("value", 4) + 0.0)


_D = [(dy, dx, i) for i, (dy, dx) in enumerate(stencils.DIAMOND)]
_AT = {d: i for i, d in enumerate(stencils.DIAMOND)}


def _weight_sql(d: tuple[int, int]) -> str:
    sad = " + ".join(f"abs(p{_AT[o]}c{c} - p{_AT[(d[0] + o[0], d[1] + o[1])]}c{c}) * {stencils.CHANNEL_SCALE[c]}::DOUBLE" for c in range(3) for o in stencils.PLUS)
    return f"greatest(0.0, ({sad}) * sigma * 1.65::DOUBLE * CASE WHEN y % 8 IN (0, 7) OR x % 8 IN (0, 7) THEN {stencils.EDGE_SCALE!r} ELSE 1.0 END + 1.0)"


@query(f"""
    WITH {EVT}, {SIZE.format(t='e')}, e3 AS MATERIALIZED (SELECT y, x, value / 1000 AS c0, value / 500 AS c1, (value % 7) / 10 AS c2 FROM e),
    n AS (SELECT t.y, t.x, {', '.join(f'max(q.c{c}) FILTER (t.i = {i}) AS p{i}c{c}' for i in range(len(_D)) for c in range(3))} FROM {pulled('e3', _D, 'dy, dx, i', 'mirror')} GROUP BY t.y, t.x),
    g AS (SELECT *, CASE WHEN (y // 8 + x // 8) % 5 = 4 THEN -5.0 ELSE -0.02::DOUBLE * (1 + (y // 8 + x // 8) % 5) END AS sigma FROM n),
    w AS (SELECT *, {', '.join(f'{_weight_sql(d)} AS w{i}' for i, d in enumerate(stencils.PLUS[1:], 1))} FROM g)
    SELECT y, x, {', '.join(f'round(CASE WHEN sigma < {stencils.LEAST_SIGMA!r} THEN p{_AT[(0, 0)]}c{c} ELSE (p{_AT[(0, 0)]}c{c} + ' + ' + '.join(f'w{i} * p{_AT[d]}c{c}' for i, d in enumerate(stencils.PLUS[1:], 1)) + f') / (1.0 + w1 + w2 + w3 + w4) END, 6) + 0.0 AS c{c}' for c in range(3))} FROM w
""")
def edge_preserving_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = planes.event_plane(spark, sf_dir)
    three = e.select("y", "x", (F.col("value") / 1000).alias("c0"), (F.col("value") / 500).alias("c1"), ((F.col("value") % 7) / 10).alias("c2"))
    block = (F.col("by") + F.col("bx")) % 5
    sigma = F.when(block == 4, -5.0).otherwise(-0.02 * (1 + block))
    return r6(stencils.edge_preserving(three, sigma, planes.extent(e)), "c0", "c1", "c2")


_O = [" + ".join(f"{m!r} * {c}" for m, c in zip(row, "rgb", strict=True)) + f" + {pw.OPSIN_BIAS!r}" for row in pw.OPSIN]


@query(f"""
    WITH u AS (SELECT event_id, value / 500 AS r, (event_id % 256) / 255.0::DOUBLE AS g, (user_id % 64) / 63.0::DOUBLE AS b FROM events),
    m AS (SELECT event_id, r, g, b, cbrt({_O[0]}) - {pw.OPSIN_BIAS ** (1 / 3)!r} AS p, cbrt({_O[1]}) - {pw.OPSIN_BIAS ** (1 / 3)!r} AS q, cbrt({_O[2]}) - {pw.OPSIN_BIAS ** (1 / 3)!r} AS s FROM u)
    SELECT event_id, round(0.5 * (p - q), 6) + 0.0 AS ox, round(0.5 * (p + q), 6) + 0.0 AS oy, round(s, 6) + 0.0 AS ob, round(r, 5) + 0.0 AS r, round(g, 5) + 0.0 AS g, round(b, 5) + 0.0 AS b FROM m
""")
def opponent_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opponent channels and the linear light that they give back."""
    e = planes.table(spark, sf_dir, "events").select("event_id", (F.col("value") / 500).alias("r"), ((F.col("event_id") % 256) / 255.0).alias("g"), ((F.col("user_id") % 64) / 63.0).alias("b"))
    x, y, s = pw.linear_to_opsin(F.col("r"), F.col("g"), F.col("b"))
    back = pw.opsin_to_linear(F.col("ox"), F.col("oy"), F.col("ob"))
    o = e.select("event_id", x.alias("ox"), y.alias("oy"), s.alias("ob")).select("*", *[c.alias(n) for c, n in zip(back, "rgb", strict=True)])
    o = r6(o, "ox", "oy", "ob")
    return o.withColumns({c: F.round(F.col(c), 5) + 0.0 for c in "rgb"})


# ---- prediction

_CAUSAL = f"""{INT}, u AS (SELECT *, lag(value) OVER c AS up, lag(value, 2) OVER c AS up2 FROM i WINDOW c AS (PARTITION BY x ORDER BY y)),
    v AS (SELECT *, lag(value) OVER r AS l, lag(value, 2) OVER r AS l2, lag(up) OVER r AS ul, lead(up) OVER r AS ur, lead(up, 2) OVER r AS ur2 FROM u WINDOW r AS (PARTITION BY y ORDER BY x)),
    n AS (SELECT y, x, value, coalesce(l, up, 0) AS lf, coalesce(up, l, 0) AS tp, coalesce(ul, l, up, 0) AS tl, coalesce(ur, up, l, 0) AS tr, coalesce(l2, l, up, 0) AS ll, coalesce(up2, up, l, 0) AS tt, coalesce(ur2, ur, up, l, 0) AS trr FROM v)"""
_P = {
    "zero": "0", "left": "lf", "top": "tp", "average0": "(lf + tp) // 2", "select": "CASE WHEN abs(tp - tl) < abs(lf - tl) THEN lf ELSE tp END",
    "gradient": "least(greatest(lf + tp - tl, least(lf, tp)), greatest(lf, tp))", "top_right": "tr", "top_left": "tl", "left_left": "ll",
    "average1": "(lf + tl) // 2", "average2": "(tl + tp) // 2", "average3": "(tp + tr) // 2", "average4": "(6 * tp - 2 * tt + 7 * lf + ll + trr + 3 * tr + 8) // 16",
}


def _token(p: str) -> str:
    return f"CASE WHEN value >= ({p}) THEN 2 * (value - ({p})) ELSE -2 * (value - ({p})) - 1 END"


@query(f"WITH {_CAUSAL} SELECT y, x, {_P['gradient']} AS prediction, {_token(_P['gradient'])} AS token FROM n")
def gradient_residual_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction.residuals(planes.integer_plane(planes.event_plane(spark, sf_dir)))


def _costs_sql(stride: int) -> str:
    each = " UNION ALL ".join(f"SELECT {i} AS ordinal, '{n}' AS predictor, CAST(sum(1 + CASE WHEN ({_token(p)}) = 0 THEN 0 ELSE length(bin({_token(p)})) END) AS BIGINT) AS cost FROM n WHERE (y * 100 + x) % {stride} = 0" for i, (n, p) in enumerate(_P.items()))
    return f"{_CAUSAL}, c AS ({each})"


@query(f"WITH {_costs_sql(1)} SELECT * FROM c")
def predictor_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction.predictor_costs(planes.integer_plane(planes.event_plane(spark, sf_dir)))


@query(f"WITH {_costs_sql(3)} SELECT predictor, cost FROM c ORDER BY cost, CASE WHEN predictor = 'gradient' THEN -1 ELSE ordinal END LIMIT 1")
def best_predictor_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A systematic sample, as the operator itself takes one: every third sample in raster order."""
    return prediction.best_predictor(prediction.predictor_costs(planes.integer_plane(planes.event_plane(spark, sf_dir)), 3))


@query()
def weighted_predictor_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes of 20 rows each are predicted independently."""
    p = planes.integer_plane(planes.event_plane(spark, sf_dir)).select(F.expr("y div 20").alias("plane"), (F.col("y") % 20).alias("y"), "x", "value")
    found = wavefronts.weighted_residuals(p)
    return found.select("plane", (F.col("plane") * 20 + F.col("y")).alias("y"), "x", "prediction", "token")


@query()
def weighted_context_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of three whole planes with the context of the predictor's error: the events' values, their sizes and their steps."""
    v = F.col("value")
    p = planes.integer_plane(planes.event_plane(spark, sf_dir), 20)
    each = F.posexplode(F.array(v, v.bitwiseXOR(F.lit(85)), F.expr("value div 7") - F.col("x")))
    return wavefronts.weighted_residuals(p.select("y", "x", each.alias("plane", "value")).withColumn("plane", F.col("plane").cast("long")))


@query()
def predicted_dc_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the events' three channels, rounded towards what the gradient predicts from levels."""
    e = planes.event_plane(spark, sf_dir).withColumn("plane", F.lit(0).cast("long"))
    v = F.col("value")
    rows = e.select("plane", "y", "x", (v % 7 / 2).alias("c0"), v.alias("c1"), (v + F.col("x") % 11).alias("c2"))
    return wavefronts.predicted_levels(rows, (0.25, 1.5, 0.75))


# ---- transforms

_B = [(k, i, math.sqrt((1 if k == 0 else 2) / 8) * math.cos(math.pi * k * (2 * i + 1) / 16)) for k in range(8) for i in range(8)]
_DCT = f"""{EMB}, b AS (SELECT * FROM {values_of(_B, 'f, i, w')}), n AS (SELECT max(y) + 1 AS h FROM p), g AS (SELECT unnest(range((h + 7) // 8 * 8)) AS gy, h FROM n), o AS (SELECT gy // 8 AS by, x // 8 AS bx, gy % 8 AS v, x % 8 AS u, value FROM g JOIN p ON p.y = least(gy, h - 1)), h AS (SELECT o."by", bx, v, b.f AS u, sum(value * w) AS value FROM o JOIN b ON o.u = b.i GROUP BY ALL), d AS (SELECT h."by", bx, u, b.f AS v, sum(value * w) AS value FROM h JOIN b ON h.v = b.i GROUP BY ALL)"""


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane in 8x8 blocks, its last row repeated to fill the last ones."""
    p = planes.embedding_plane(spark, sf_dir)
    return transforms.blocks(planes.padded(p, planes.extent(p), 8))


@query(f"""WITH {_DCT} SELECT d."by", bx, CAST(v AS INTEGER) AS v, CAST(u AS INTEGER) AS u, round(value, 6) + 0.0 AS value FROM d""")
def dct8_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(transforms.dct(_whole(spark, sf_dir)).select("by", "bx", "v", "u", "value"), "value")


@query(f"""WITH {_DCT} SELECT o."by", bx, CAST(v AS INTEGER) AS v, CAST(u AS INTEGER) AS u, round(value, 6) + 0.0 AS value FROM o""")
def dct8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(transforms.dct(transforms.dct(_whole(spark, sf_dir)), forward=False).select("by", "bx", "v", "u", "value"), "value")


def _rect_sql(n: int, m: int) -> str:
    """The transform of blocks of n rows and m columns, the plane's last row repeated to fill the last ones."""
    basis = {k: values_of([(f, i, math.sqrt((1 if f == 0 else 2) / k) * math.cos(math.pi * f * (2 * i + 1) / (2 * k))) for f in range(k) for i in range(k)], "f, i, w") for k in (n, m)}
    return f"""
        WITH {EMB}, s AS (SELECT max(y) + 1 AS h FROM p), g AS (SELECT unnest(range((h + {n - 1}) // {n} * {n})) AS gy, h FROM s),
        o AS (SELECT gy // {n} AS "by", x // {m} AS bx, gy % {n} AS v, x % {m} AS u, value FROM g JOIN p ON p.y = least(gy, h - 1)),
        a AS (SELECT o."by", bx, v, k.f AS u, sum(value * w) AS value FROM o JOIN {basis[m]} ON o.u = k.i GROUP BY ALL),
        d AS (SELECT a."by", bx, u, k.f AS v, sum(value * w) AS value FROM a JOIN {basis[n]} ON a.v = k.i GROUP BY ALL)
        SELECT d."by", bx, CAST(v AS INTEGER) AS v, CAST(u AS INTEGER) AS u, round(value, 6) + 0.0 AS value FROM d"""


def _rect(spark: SparkSession, sf_dir: str, n: int, m: int) -> DataFrame:
    p = planes.embedding_plane(spark, sf_dir)
    h, w = planes.extent(p)
    whole = transforms.blocks(planes.padded(p, (h, w), n).where(F.col("x") < w), n, m)
    return r6(transforms.dct(whole, n, wide=m).select("by", "bx", "v", "u", "value"), "value")


@query(_rect_sql(16, 16))
def dct16_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rect(spark, sf_dir, 16, 16)


@query(_rect_sql(32, 32))
def dct32_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rect(spark, sf_dir, 32, 32)


@query(_rect_sql(8, 16))
def dct8x16_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rect(spark, sf_dir, 8, 16)


@query(_rect_sql(32, 8))
def dct32x8_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rect(spark, sf_dir, 32, 8)


@query(f"""
    WITH {_DCT}, s AS (SELECT v, u, round(value, 9) / 0.05 AS c FROM d),
    q AS (SELECT *, CASE WHEN abs(c) < CASE WHEN v < 4 AND u < 4 THEN 0.56 WHEN v < 4 THEN 0.62 WHEN u < 4 THEN 0.62 ELSE 0.68 END THEN 0 ELSE CAST(round_even(c, 0) AS BIGINT) END AS level FROM s)
    SELECT CAST(v AS INTEGER) AS v, CAST(u AS INTEGER) AS u, CAST(sum(level) AS BIGINT) AS total, count(*) FILTER (level = 0) AS zeros FROM q GROUP BY v, u
""")
def deadzone_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = transforms.dct(_whole(spark, sf_dir)).withColumn("value", F.round("value", 9))
    q = d.withColumn("value", transforms.quadrant_quantize(F.col("value"), 0.05, (0.56, 0.62, 0.62, 0.68)))
    return q.groupBy("v", "u").agg(F.sum("value").alias("total"), F.count_if(F.col("value") == 0).alias("zeros"))


_TEND = """CASE WHEN b >= a AND a >= n THEN (SELECT CASE WHEN d2 + (d2 & 1) > 2 * (a - n) THEN 2 * (a - n) ELSE d2 END FROM (SELECT CASE WHEN d - (d & 1) > 2 * (b - a) THEN 2 * (b - a) + 1 ELSE d END AS d2 FROM (SELECT (4 * b - 3 * n - a + 6) // 12 AS d)))
        WHEN b <= a AND a <= n THEN (SELECT CASE WHEN d2 - (d2 & 1) < 2 * (a - n) THEN 2 * (a - n) ELSE d2 END FROM (SELECT CASE WHEN d + (d & 1) < 2 * (b - a) THEN 2 * (b - a) - 1 ELSE d END AS d2 FROM (SELECT (4 * b - 3 * n - a - 6) // 12 AS d))) ELSE 0 END"""


@query(f"""
    WITH {INT}, q AS (SELECT y AS line, x // 2 AS pos, max(value) FILTER (x % 2 = 0) AS p0, max(value) FILTER (x % 2 = 1) AS p1 FROM i GROUP BY ALL),
    g AS (SELECT *, CASE WHEN p1 IS NULL THEN p0 ELSE (p0 + p1 + CASE WHEN p0 > p1 THEN 1 ELSE 0 END) >> 1 END AS average FROM q),
    w AS (SELECT *, average AS a, coalesce(lag(p1) OVER o, average) AS b, coalesce(lead(average) OVER o, average) AS n FROM g WINDOW o AS (PARTITION BY line ORDER BY pos))
    SELECT line, pos, average, p0 - p1 - ({_TEND}) AS residual FROM w
""")
def squeeze_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = planes.integer_plane(planes.event_plane(spark, sf_dir)).select(F.col("y").alias("line"), F.col("x").alias("pos"), "value")
    return transforms.squeeze(lines)


@query(f"WITH {INT} SELECT y AS line, x AS pos, value FROM i")
def squeeze_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = planes.integer_plane(planes.event_plane(spark, sf_dir)).select(F.col("y").alias("line"), F.col("x").alias("pos"), "value")
    return transforms.unsqueeze(transforms.squeeze(lines))


@query("WITH d AS (SELECT p_brand, p_size % 10 AS s, row_number() OVER (ORDER BY p_brand, p_size % 10) - 1 AS index FROM part GROUP BY p_brand, p_size % 10) SELECT p_partkey, index FROM part JOIN d ON d.p_brand = part.p_brand AND d.s = part.p_size % 10 WHERE (SELECT count(*) FROM d) <= 256")
def palette_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planes.table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") % 10).alias("s"))
    return transforms.to_indices(rows, ["p_brand", "s"]).select("p_partkey", "index")
