"""Queries over symbol streams, intervals, low frequencies and plans of steps, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.operators import deadzones, fields, histograms, intervals, lowfrequencies, scans, sequences, streams, tilings
from tesselark.plans.grids import r6
from tesselark.plans.tilings import _MIXED, _mixed
from tesselark.plans.tokens import _CHARS
from tesselark.sources import planes
from tesselark.sources.planes import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
    WITH e AS MATERIALIZED (SELECT event_type AS grp, event_id AS pos, (user_id * 7 + CAST(round(value) AS BIGINT)) % 61 AS symbol FROM events),
    u AS MATERIALIZED (SELECT *, max(pos) OVER (PARTITION BY grp, symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e),
    a AS (SELECT u.grp, u.pos, count(DISTINCT v.symbol) AS rank FROM u LEFT JOIN e v ON v.grp = u.grp AND v.pos > u.last AND v.pos < u.pos WHERE u.last IS NOT NULL GROUP BY u.grp, u.pos),
    f AS (SELECT u.grp, u.pos, u.symbol + count(DISTINCT v.symbol) AS rank FROM u LEFT JOIN e v ON v.grp = u.grp AND v.pos < u.pos AND v.symbol > u.symbol WHERE u.last IS NULL GROUP BY u.grp, u.pos, u.symbol)
    SELECT e.grp, e.pos, e.symbol, r.rank FROM e JOIN (SELECT * FROM a UNION ALL SELECT * FROM f) r ON r.grp = e.grp AND r.pos = e.pos
""")
def move_to_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of a symbol made of each event, in a list of each type's."""
    symbol = (F.col("user_id") * 7 + F.round("value").cast("long")) % 61
    return streams.move_to_front(table(spark, sf_dir, "events").select(F.col("event_type").alias("grp"), F.col("event_id").alias("pos"), symbol.alias("symbol")))


@query("""
    WITH r AS (SELECT p_brand, min(p_retailprice) AS lo, CASE WHEN max(p_size) = 50 AND count(*) % 5 = 0 THEN NULL ELSE min(p_retailprice) + sqrt(count(*)) * 5 END AS hi FROM part GROUP BY p_brand),
    v AS (SELECT o_orderkey, o_totalprice % 2000 AS price FROM orders)
    SELECT o_orderkey, p_brand, price, lo, hi FROM v JOIN r ON price >= lo AND (hi IS NULL OR price < hi)
""")
def price_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the brands in whose range of prices they fall; some ranges have no end."""
    hi = F.when((F.max("p_size") == 50) & (F.count("*") % 5 == 0), None).otherwise(F.min("p_retailprice") + F.sqrt(F.count("*")) * 5)
    ranges = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), hi.alias("hi"))
    values = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") % 2000).alias("price"))
    return intervals.range_join(values, ranges, "price").select("o_orderkey", "p_brand", "price", "lo", "hi")


_SYMBOLS = f"""{_CHARS.replace('c AS (SELECT doc_id, generate', 'l AS (SELECT doc_id, generate').replace('FROM c)', 'FROM l)')}, b AS (SELECT context, value, n, CASE WHEN value > 0 THEN length(bin(value)) - 1 ELSE 0 END AS e FROM h),
    s AS (SELECT context, context % 3 AS cluster, n, CASE WHEN value < 16 THEN value ELSE 16 + (e - 4) * 4 + ((value - (1::BIGINT << e)) >> (e - 2)) END AS symbol, CASE WHEN value < 16 THEN 0 ELSE e - 2 END AS extra FROM b),
    c AS (SELECT cluster, symbol, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY cluster, symbol),
    t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY cluster) AS BIGINT) AS total, count(*) OVER (PARTITION BY cluster) AS kinds FROM c),
    w AS (SELECT cluster, symbol, CASE WHEN kinds = 1 THEN 0 ELSE greatest(1, length(bin((total - 1) // n))) END AS depth FROM t)"""


@query(f"WITH {_SYMBOLS} SELECT s.context, CAST(sum(s.n) AS BIGINT) AS tokens, CAST(sum(s.n * (depth + extra)) AS BIGINT) AS bits FROM s JOIN w ON w.cluster = s.cluster AND w.symbol = s.symbol GROUP BY s.context")
def character_code_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits that each context's characters take under the code of its cluster."""
    tokens, _ = streams_tokens(spark, sf_dir)
    mapping = spark.range(6).select(F.col("id").alias("context"), (F.col("id") % 3).alias("cluster"))
    code = streams.shannon_code(streams.symbol_counts(tokens, mapping), ["cluster"])
    sections = tokens.select("context", "value", "n", F.col("context").alias("section"))
    return streams.code_bits(sections, mapping, code, ["section"]).withColumnRenamed("section", "context")


def streams_tokens(spark: SparkSession, sf_dir: str):
    """The texts' characters as tokens, counted once and kept."""
    from tesselark.operators.running import Written

    return Written(spark).write(histograms.characters(table(spark, sf_dir, "documents")))


_LOW = "(VALUES " + ", ".join(f"('{n}', {v}, {u}, {y}, {x}, {w!r}::DOUBLE)" for n, v, u, y, x, w in lowfrequencies.resampling(False)) + ") AS k(shape, v, u, y, x, weight)"
_UNIT = "CASE shape " + " ".join(f"WHEN '{s.name}' THEN {8 * s.blocks**0.5!r}" for s in tilings.SHAPES) + " END"


@query(f"""
    WITH {_MIXED} SELECT d.ay + k.y AS "by", d.ax + k.x AS bx, round(sum(d.value / {_UNIT.replace('shape', 'd.shape')} * k.weight), 6) + 0.0 AS value
    FROM d JOIN {_LOW} ON k.shape = d.shape AND k.v = d.v AND k.u = d.u GROUP BY 1, 2
""")
def low_frequency_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block means that the low frequencies of the mixed tiling tell."""
    plane, tiling = _mixed(spark, sf_dir)
    return r6(lowfrequencies.block_means(lowfrequencies.mean_scaled(tilings.tiled_dct(plane, tiling))), "value")


@query(f"""
    WITH {_MIXED} SELECT ay, ax, d.shape, d.v, d.u, round(d.value / {_UNIT.replace('shape', 'd.shape')}, 6) + 0.0 AS value FROM d
    JOIN (SELECT DISTINCT shape, v, u FROM {_LOW}) l ON l.shape = d.shape AND l.v = d.v AND l.u = d.u
""")
def low_frequency_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low frequencies given back by the block means that they tell."""
    plane, tiling = _mixed(spark, sf_dir)
    means = lowfrequencies.block_means(lowfrequencies.mean_scaled(tilings.tiled_dct(plane, tiling)))
    return r6(lowfrequencies.low_frequencies(means, tiling), "value")


def _image(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[sequences.Channel]]:
    """The events as an image of four integer channels."""
    e = planes.event_plane(spark, sf_dir)
    h, w = planes.extent(e)
    v = F.round(F.col("value") * 10).cast("long")
    each = {"c0": v, "c1": v - F.col("x"), "c2": v % 97, "c3": v % 5}
    return sequences._stacked(e, each), [sequences.Channel(n, h, w) for n in each]


_PLAN = [sequences.Rct("c0", 13), sequences.Palette("c3", 1, 5), sequences.Squeeze("c0"), sequences.Squeeze("c0", along_x=False), sequences.Squeeze("c0-"), sequences.Squeeze("c1", along_x=False)]
_CHANNELS = "e AS (SELECT event_id // 100 AS y, event_id % 100 AS x, CAST(round(value * 10) AS BIGINT) AS v FROM events), i AS (SELECT y, x, unnest(['c0', 'c1', 'c2', 'c3']) AS channel, unnest([v, v - x, v % 97, v % 5]) AS value FROM e)"


@query(f"WITH {_CHANNELS} SELECT channel, y, x, value FROM i")
def transform_plan_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours, palette and squeezes along both ways, and all of it undone."""
    rows, channels = _image(spark, sf_dir)
    return sequences.inverse(sequences.forward(rows, channels, _PLAN), channels, _PLAN)


@query(f"""
    WITH {_CHANNELS}, p AS (SELECT y, x, max(value) FILTER (channel = 'c0') AS a, max(value) FILTER (channel = 'c1') AS b, max(value) FILTER (channel = 'c2') AS c, max(value) FILTER (channel = 'c3') AS d FROM i GROUP BY y, x),
    k AS (SELECT d AS colour, row_number() OVER (ORDER BY d) - 1 AS index FROM p GROUP BY d)
    SELECT 'c2' AS channel, y, x, c - a AS value FROM p UNION ALL SELECT 'c1', y, x, b FROM p UNION ALL SELECT 'c0', y, x, a FROM p
    UNION ALL SELECT 'c3', y, x, index FROM p JOIN k ON k.colour = p.d UNION ALL SELECT 'c3#', 0, index, colour FROM k
""")
def transform_plan_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channels after a colour transform and a palette."""
    rows, channels = _image(spark, sf_dir)
    return sequences.forward(rows, channels, [sequences.Rct("c0", 1), sequences.Palette("c3", 1, 5)])


#: What the plane counts in each channel, and the raw quants of anchors.
SHARES = (0.04, 0.5, 0.3)


@query()
def adjusted_quants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quant and dead zones of each shape of the mixed tiling, from three channels made of the plane."""
    plane, tiling = _mixed(spark, sf_dir)
    c = lowfrequencies.mean_scaled(tilings.tiled_dct(plane, tiling))
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("channel"), F.lit(f).alias("f")) for k, f in enumerate(SHARES)]))
    c = c.withColumn("e", each).select("e.channel", "ay", "ax", "shape", "v", "u", F.round(F.col("value") * F.col("e.f"), 9).alias("value"))
    field = tiling.where("by = ay and bx = ax").select("ay", "ax", (3 + (F.col("ay") * 3 + F.col("ax") * 7) % 20).alias("raw"))
    found = deadzones.choose(deadzones.statistics(c, field, 0.05))
    return r6(found, *[f"zone{k}" for k in range(4)])


_PARTS = "(VALUES " + ", ".join(f"('{s.name}', {max(s.rows, s.cols)}, {min(s.rows, s.cols)}, {str(scans.turned(s)).lower()}, {s.blocks}, {s.blocks.bit_length() - 1}, {fields.ORDER_OF[scans.STRATEGY[s.name]]})" for s in tilings.SHAPES) + ") AS s(shape, wide, high, turned, blocks, shift, family)"
_AT = lambda values, at: f"[{', '.join(map(str, values))}][CAST({at} AS BIGINT) + 1]"


@query(f"""
    WITH {_MIXED}, q AS MATERIALIZED (
        SELECT k.c AS channel, d.ay, d.ax, d.shape, s.wide, s.high, s.blocks, s.shift, s.family, CASE WHEN turned THEN u ELSE v END AS y, CASE WHEN turned THEN v ELSE u END AS x, CAST(round_even(round(value, 9) * k.f, 0) AS BIGINT) AS level
        FROM d JOIN {_PARTS} ON s.shape = d.shape CROSS JOIN (VALUES (0, 1.5::DOUBLE), (1, 6.0::DOUBLE), (2, 3.0::DOUBLE)) AS k(c, f)),
    z AS (SELECT *, x + y * (wide // high) AS dg, x < wide AND y < high AS low FROM q),
    w AS (SELECT *, CASE WHEN (CASE WHEN dg < 8 * wide THEN dg ELSE 16 * wide - 2 - dg END) % 2 = 0 THEN x ELSE y * (wide // high) END AS along FROM z),
    o2 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY channel, ay, ax ORDER BY low DESC, CASE WHEN low THEN y ELSE dg END, CASE WHEN low THEN x ELSE along END) - 1 AS scan FROM w),
    c AS MATERIALIZED (SELECT channel, ay, ax, shape, any_value(blocks) AS blocks, CAST(sum((level <> 0)::INT) AS BIGINT) AS n, any_value(family) AS family, 1 + (ay * 3 + ax * 5) % 30 AS raw FROM o2 WHERE scan >= blocks GROUP BY channel, ay, ax, shape),
    cb AS MATERIALIZED (SELECT *, {_AT(fields.CONTEXT_OF, '(CASE channel WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END) * 13 + family')} * 2 + (raw > 12)::INT AS block FROM c),
    bl AS (SELECT DISTINCT "by", bx, "by" - "by" % r AS ay, bx - bx % c AS ax FROM s),
    m AS (SELECT bl."by", bl.bx, cb.*, (n + blocks - 1) // blocks AS share FROM bl JOIN cb ON cb.ay = bl.ay AND cb.ax = bl.ax),
    l AS (SELECT *, lag(share) OVER (PARTITION BY channel, "by" // 32, bx // 32, "by" ORDER BY bx) AS lf, lag(share) OVER (PARTITION BY channel, "by" // 32, bx // 32, bx ORDER BY "by") AS tp FROM m),
    gg AS (SELECT *, coalesce((lf + tp + 1) // 2, lf, tp, 32) AS guess FROM l WHERE "by" = ay AND bx = ax),
    tt AS (SELECT o2.*, cb.n, cb.block, cb.n - coalesce(sum((level <> 0)::INT) OVER (PARTITION BY o2.channel, o2.ay, o2.ax ORDER BY scan ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
          coalesce(lag((level <> 0)::INT) OVER (PARTITION BY o2.channel, o2.ay, o2.ax ORDER BY scan), (cb.n <= o2.blocks * 4)::INT) AS previous
          FROM o2 JOIN cb ON cb.channel = o2.channel AND cb.ay = o2.ay AND cb.ax = o2.ax WHERE scan >= o2.blocks)
    SELECT channel, ay, ax, -1 AS scan, CAST(CASE WHEN guess < 8 THEN guess WHEN guess >= 64 THEN 36 ELSE 4 + guess // 2 END * 8 + block AS BIGINT) AS context, n AS token FROM gg
    UNION ALL SELECT channel, ay, ax, scan, CAST(8 * 37 + 458 * block + ({_AT(scans.LEFT_CONTEXT, '(CAST(remaining AS BIGINT) + blocks - 1) >> shift')} + {_AT(scans.PLACE_CONTEXT, 'scan >> shift')}) * 2 + previous AS BIGINT),
           CASE WHEN level >= 0 THEN 2 * level ELSE -2 * level - 1 END FROM tt WHERE remaining > 0
""")
def scan_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and levels of the mixed tiling's shapes, in scan order with their contexts."""
    plane, tiling = _mixed(spark, sf_dir)
    c = tilings.tiled_dct(plane, tiling).withColumn("value", F.round("value", 9))
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("channel"), F.lit(f).alias("f")) for k, f in enumerate((1.5, 6.0, 3.0))]))
    levels = c.withColumn("e", each).select("e.channel", "ay", "ax", "shape", "v", "u", F.rint(F.col("value") * F.col("e.f")).cast("long").alias("level"))
    field = tiling.where("by = ay and bx = ax").select("ay", "ax", (1 + (F.col("ay") * 3 + F.col("ax") * 5) % 30).alias("raw"))
    return scans.scan_tokens(levels, tiling, field, [12], [k * 2 + s for k in fields.CONTEXT_OF for s in (0, 1)])
