"""Queries over mixed tilings and wide stencils, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.operators import adaptive, halo, metric, stencils, tilings
from tesselark.plans.fields import _OPSIN, _opsin
from tesselark.plans.grids import EMB, EVT, SIZE, mirrored, pulled, r6, values_of
from tesselark.sources import planes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _basis_sql(n: int, name: str) -> str:
    rows = [(f, i, math.sqrt((1 if f == 0 else 2) / n) * math.cos(math.pi * f * (2 * i + 1) / (2 * n))) for f in range(n) for i in range(n)]
    return f"{name} AS MATERIALIZED (SELECT * FROM {values_of(rows, 'f, i, w')})"


_BASES = ", ".join(_basis_sql(n, f"b{n}") for n in (8, 16, 32))

# ---- tilings


#: Quadrants of 4x4 blocks take turns; those cut off below are single blocks.
_PATTERN = """
    CASE WHEN qy * 4 + 4 > h THEN '8x8' WHEN k = 0 THEN '32x32' WHEN k = 1 THEN '32x16' WHEN k = 2 THEN '16x32' WHEN k = 3 THEN '16x16'
         WHEN k = 4 THEN CASE WHEN bx % 4 < 2 THEN '16x8' ELSE '8x16' END ELSE '8x8' END"""
_SIDES = "CASE {shape} WHEN '32x32' THEN {a} WHEN '32x16' THEN {b} WHEN '16x32' THEN {c} WHEN '16x16' THEN {d} WHEN '16x8' THEN {e} WHEN '8x16' THEN {f} ELSE 1 END"
_ROWS = _SIDES.format(shape="shape", a=4, b=4, c=2, d=2, e=2, f=1)
_COLS = _SIDES.format(shape="shape", a=4, b=2, c=4, d=2, e=1, f=2)


def _tiling(blocks: DataFrame, height: int) -> DataFrame:
    """A tiling with every shape, for blocks (by, bx) of a plane of ``height`` block rows."""
    t = blocks.withColumn("qy", F.expr("by div 4")).withColumn("k", F.expr("((by div 4) + 3 * (bx div 4)) % 6")).withColumn("h", F.lit(height))
    t = t.withColumn("shape", F.expr(_PATTERN)).withColumn("rows", F.expr(_ROWS)).withColumn("cols", F.expr(_COLS))
    return t.select("by", "bx", "shape", F.expr("by - by % rows").alias("ay"), F.expr("bx - bx % cols").alias("ax"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = planes.embedding_plane(spark, sf_dir)
    h, w = planes.extent(p)
    whole = planes.padded(p, (h, w), 8)
    blocks = whole.where("y % 8 = 0 and x % 8 = 0").select(F.expr("y div 8").alias("by"), F.expr("x div 8").alias("bx"))
    return whole, _tiling(blocks, -(-h // 8))


_MIXED = f"""{EMB}, {_BASES}, n AS (SELECT (max(y) + 8) // 8 AS h, max(y) AS last FROM p),
    g AS MATERIALIZED (SELECT gy AS y, p.x, p.value, gy // 8 AS "by", p.x // 8 AS bx, h FROM (SELECT unnest(range(h * 8)) AS gy, h, last FROM n) JOIN p ON p.y = least(gy, last)),
    t AS MATERIALIZED (SELECT *, {_PATTERN.replace('by', '"by"')} AS shape FROM (SELECT *, "by" // 4 AS qy, (("by" // 4) + 3 * (bx // 4)) % 6 AS k FROM g)),
    s AS MATERIALIZED (SELECT *, {_ROWS} AS r, {_COLS} AS c FROM t),
    o AS MATERIALIZED (SELECT "by" - "by" % r AS ay, bx - bx % c AS ax, shape, r, c, y - ("by" - "by" % r) * 8 AS v, x - (bx - bx % c) * 8 AS u, y, x, value FROM s),
    a AS (SELECT ay, ax, shape, r, c, v, k.f AS u, sum(value * w) AS value FROM o JOIN (SELECT 1 AS c, * FROM b8 UNION ALL SELECT 2, * FROM b16 UNION ALL SELECT 4, * FROM b32) k USING (c) WHERE k.i = o.u GROUP BY ALL),
    d AS (SELECT ay, ax, shape, k.f AS v, u, sum(value * w) AS value FROM a JOIN (SELECT 1 AS r, * FROM b8 UNION ALL SELECT 2, * FROM b16 UNION ALL SELECT 4, * FROM b32) k USING (r) WHERE k.i = a.v GROUP BY ALL)"""


@query(f"WITH {_MIXED} SELECT ay, ax, shape, v, u, round(value, 6) + 0.0 AS value FROM d")
def mixed_tiling_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings' plane under a tiling with every shape."""
    plane, tiling = _mixed(spark, sf_dir)
    return r6(tilings.tiled_dct(plane, tiling), "value")


@query(f"WITH {_MIXED} SELECT y, x, round(value, 6) + 0.0 AS value FROM g")
def mixed_tiling_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane, tiling = _mixed(spark, sf_dir)
    return r6(tilings.tiled_idct(tilings.tiled_dct(plane, tiling), tiling), "value")


_WEIGHTS = [(s.name, v, u, float(w)) for s in tilings.SHAPES for (v, u), w in [(at, tilings.weights(s, 1)[at]) for at in [(v, u) for v in range(8 * s.rows) for u in range(8 * s.cols)]]]


def _quant(by: str, bx: str) -> str:
    return f"(4 + (({by}) * 3 + ({bx}) * 7) % 11 / 2.0)"


@query(f"""
    WITH {_MIXED}, m AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {v}, {u}, {w!r})" for n, v, u, w in _WEIGHTS)}) AS k(shape, v, u, weight)),
    q AS (SELECT ay, ax, shape, v, u, weight / {_quant('ay', 'ax')} AS unit, round(value, 9) AS value FROM d JOIN m USING (shape, v, u))
    SELECT ay, ax, shape, v, u, CAST(round_even(value / unit, 0) AS BIGINT) AS level, round(round_even(value / unit, 0) * unit, 6) + 0.0 AS restored FROM q
""")
def mixed_tiling_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the coefficients under each shape's own matrix of the middle channel."""
    plane, tiling = _mixed(spark, sf_dir)
    field = tiling.select("by", "bx", F.expr(_quant("by", "bx")).cast("double").alias("quant"))
    found = tilings.tiled_dct(plane, tiling).withColumn("value", F.round("value", 9))
    return r6(tilings.quantize_tiled(found, field, 1).select("ay", "ax", "shape", "v", "u", "level", "restored"), "restored")


# ---- costs and choice of shapes

TARGET = 1.3


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The events' three channels with a mask, in whole blocks, and a field of the blocks."""
    o = _opsin(spark, sf_dir).withColumn("mask", 2 + (F.col("y") * 3 + F.col("x") * 5) % 7 + F.lit(0.0))
    h, w = planes.extent(o)
    whole = o.select("y", "x", F.struct("c0", "c1", "c2", "mask").alias("value"))
    pixels = planes.padded(whole, (h, w), 8).select("y", "x", "value.*")
    blocks = pixels.where("y % 8 = 0 and x % 8 = 0").select(F.expr("y div 8").alias("by"), F.expr("x div 8").alias("bx"))
    factor = F.expr("((by div 8 + bx div 8) % 3 - 1) / 16.0D"), F.expr("1 - (bx div 8) % 2 / 8.0D")
    field = blocks.select("by", "bx", F.expr("0.5D + ((by * 3 + bx * 7) % 11) / 8.0D").alias("quant"), factor[0].alias("x_factor"), factor[1].alias("b_factor"))
    return pixels, field


def _costs_sql() -> str:
    ratio = (TARGET + tilings.COST_BIAS) / (1 + tilings.COST_BIAS)
    loss, zeros, magnitude = (a * ratio**b for a, b in (tilings.LOSS, tilings.ZEROS, tilings.MAGNITUDE))
    log2up = lambda n: f"CASE WHEN ({n}) = 1 THEN 0 ELSE length(bin(({n}) - 1)) END"
    parts = [
        f"""{_OPSIN}, {_BASES}, z AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM o),
        px AS MATERIALIZED (SELECT gy AS y, gx AS x, c0, c1, c2, 2.0 + (o.y * 3 + o.x * 5) % 7 AS mask
            FROM (SELECT unnest(range((h + 7) // 8 * 8)) AS gy, h, w FROM z) a, (SELECT unnest(range((w + 7) // 8 * 8)) AS gx FROM z) b JOIN o ON o.y = least(gy, h - 1) AND o.x = least(gx, w - 1)),
        ch AS MATERIALIZED (SELECT y, x, unnest([0, 1, 2]) AS c, unnest([c0, c1, c2]) AS value FROM px),
        bl AS MATERIALIZED (SELECT y // 8 AS "by", x // 8 AS bx, 0.5::DOUBLE + ((y // 8 * 3 + x // 8 * 7) % 11) / 8.0::DOUBLE AS quant FROM px WHERE y % 8 = 0 AND x % 8 = 0),
        sz AS (SELECT max("by") + 1 AS rows, max(bx) + 1 AS cols FROM bl)"""
    ]
    for s in tilings.SHAPES:
        n, h, w = s.name, 8 * s.rows, 8 * s.cols
        unit = math.sqrt(h * w)
        weights = [(c, v, u, float(x)) for c in range(3) for v in range(h) for u, x in enumerate(tilings.weights(s, c)[v])]
        norm = "max(q.quant)" if s.blocks <= 2 else "pow(avg(pow(q.quant, 16)), 1 / 16.0)"
        share = 1 + min(3, s.blocks / 8) if s.blocks > 1 else 1.0
        parts.append(f"""
        "a{n}" AS MATERIALIZED (SELECT a."by", a.bx, {norm} AS norm FROM bl a, sz JOIN bl q ON q."by" BETWEEN a."by" AND a."by" + {s.rows - 1} AND q.bx BETWEEN a.bx AND a.bx + {s.cols - 1}
            WHERE a."by" % 8 % {s.step} = 0 AND a.bx % 8 % {s.step} = 0 AND a."by" % 8 + {s.rows} <= 8 AND a.bx % 8 + {s.cols} <= 8 AND a."by" + {s.rows} <= rows AND a.bx + {s.cols} <= cols GROUP BY a."by", a.bx),
        "m{n}" AS MATERIALIZED (SELECT * FROM {values_of(weights, 'c, v, u, weight')}),
        "f{n}" AS MATERIALIZED (SELECT a."by", a.bx, p.c, p.y - a."by" * 8 AS v, k.f AS u, sum(p.value * k.w) AS value FROM "a{n}" a JOIN ch p ON p.y BETWEEN a."by" * 8 AND a."by" * 8 + {h - 1} AND p.x BETWEEN a.bx * 8 AND a.bx * 8 + {w - 1} JOIN b{w} k ON k.i = p.x - a.bx * 8 GROUP BY ALL),
        "g{n}" AS MATERIALIZED (SELECT f."by", f.bx, f.c, k.f AS v, f.u, sum(f.value * k.w) / {unit!r} AS value FROM "f{n}" f JOIN b{h} k ON k.i = f.v GROUP BY ALL),
        "q{n}" AS MATERIALIZED (SELECT g."by", g.bx, g.c, g.v, g.u, m.weight, norm, (g.value - y.value * CASE g.c WHEN 0 THEN ((g."by" // 8 + g.bx // 8) % 3 - 1) / 16.0::DOUBLE WHEN 1 THEN 0 ELSE 1 - (g.bx // 8) % 2 / 8.0::DOUBLE END) / m.weight * norm AS s
            FROM "g{n}" g JOIN "g{n}" y ON y."by" = g."by" AND y.bx = g.bx AND y.v = g.v AND y.u = g.u AND y.c = 1 JOIN "m{n}" m ON m.c = g.c AND m.v = g.v AND m.u = g.u JOIN "a{n}" a ON a."by" = g."by" AND a.bx = g.bx),
        "i{n}" AS MATERIALIZED (SELECT q."by", q.bx, c, v, k.i AS u, sum(weight * (s - round(s)) * k.w) AS value FROM "q{n}" q JOIN b{w} k ON k.f = q.u GROUP BY ALL),
        "j{n}" AS MATERIALIZED (SELECT i."by", i.bx, c, k.i AS v, u, {unit!r} * sum(value * k.w) AS value FROM "i{n}" i JOIN b{h} k ON k.f = i.v GROUP BY ALL),
        "l{n}" AS (SELECT j."by", j.bx, c, sum(pow((p.mask + CASE c WHEN 0 THEN {tilings.MASK_OFFSET[0]} WHEN 1 THEN {tilings.MASK_OFFSET[1]} ELSE {tilings.MASK_OFFSET[2]} END) * value, 8)) * CASE c WHEN 0 THEN {tilings.ERROR_WEIGHT[0]!r} WHEN 1 THEN 1.0 ELSE {tilings.ERROR_WEIGHT[2]!r} END AS lost
            FROM "j{n}" j JOIN px p ON p.y = j."by" * 8 + j.v AND p.x = j.bx * 8 + j.u GROUP BY j."by", j.bx, c),
        "e{n}" AS (SELECT "by", bx, c, max(norm) AS norm, sum(sqrt(abs(round(s)))) AS size, CAST(count(*) FILTER (round(s) <> 0) AS BIGINT) AS used FROM "q{n}" GROUP BY "by", bx, c),
        "t{n}" AS (SELECT *, {log2up('used + 1')} + 1 AS bits FROM "e{n}"),
        "c{n}" AS (SELECT t."by", t.bx, max(norm) AS norm, sum(({magnitude!r} * size + {zeros!r} * (bits + {log2up('bits + 17')})) * CASE c WHEN 0 THEN {share!r} ELSE 1 END) AS told, sum(lost * CASE c WHEN 0 THEN {share!r} ELSE 1 END) AS lost
            FROM "t{n}" t JOIN "l{n}" USING ("by", bx, c) GROUP BY t."by", t.bx)""")
    every = " UNION ALL ".join(f"""SELECT "by", bx, '{s.name}' AS shape, round(told * {s.multiplier!r} + {loss!r} * pow(lost / {s.blocks * 64}, 0.125) * {s.blocks * 64} / norm, 5) + 0.0 AS cost FROM "c{s.name}" """ for s in tilings.SHAPES)
    return f"WITH {', '.join(parts)} {every}"


@query(_costs_sql())
def shape_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each shape would cost at each anchor of the events' plane."""
    return tilings.shape_costs(*_inputs(spark, sf_dir), TARGET).withColumn("cost", F.round("cost", 5) + 0.0)


@query()
def placed_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiling of the events' plane that the search of each tile ends with."""
    return tilings.place_shapes(tilings.shape_costs(*_inputs(spark, sf_dir), TARGET), TARGET)


# ---- fields of quants


def _field_sql() -> str:
    """The first field step by step: differences, erosion of 4x4 cells, masks and modulations."""
    t, a = TARGET, adaptive
    from tesselark.functions import pointwise as pw
    from tesselark.operators import fields as f
    from tesselark.operators.stencils import erosion_weights

    gamma = lambda v: f"(({f.GAMMA_TOP!r} * pow(greatest({v}, 0), 2) + {f.GAMMA_SMALL}) / ({f.GAMMA_CUBE!r} * pow(greatest({v}, 0), 3) + {f.GAMMA_REST + f.GAMMA_SMALL!r}))"
    taps = [(dy, dx, a.MASK_TAPS[dy * dy + dx * dx]) for dy in range(-2, 3) for dx in range(-2, 3)]
    total = sum(k for _, _, k in taps)
    w = erosion_weights(t)
    scale = a.AC_QUANT / t
    near = values_of([(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)], "dy, dx")
    v = f"greatest(q * {pw.MASK_SCALE!r}, 1e-3)"
    k4, k2, k3 = pw.MASK_TERMS
    return f"""
        WITH {_OPSIN}, z AS (SELECT max(y) + 1 AS ph, max(x) + 1 AS pw FROM o),
        p AS MATERIALIZED (SELECT gy AS y, gx AS x, c0, c1, c2 FROM (SELECT unnest(range((ph + 7) // 8 * 8)) AS gy, ph, pw FROM z) a, (SELECT unnest(range((pw + 7) // 8 * 8)) AS gx FROM z) b JOIN o ON o.y = least(gy, ph - 1) AND o.x = least(gx, pw - 1)),
        s AS MATERIALIZED (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM p),
        d AS MATERIALIZED (SELECT t.y, t.x, (any_value(t.c1) - avg(q.c1)) / {gamma(f'any_value(t.c1) + {a.DIFFERENCE_OFFSET}')} AS d
            FROM p t CROSS JOIN s CROSS JOIN {values_of([(0, 1), (1, 0), (0, -1), (-1, 0)], 'dy, dx')} JOIN p q ON q.y = greatest(0, least(t.y + k.dy, h - 1)) AND q.x = greatest(0, least(t.x + k.dx, w - 1)) GROUP BY t.y, t.x),
        m AS MATERIALIZED (SELECT y, x, 1 / (ln(1 + abs(d)) + {a.MASK_LEAST}) AS m FROM d),
        b AS MATERIALIZED (SELECT t.y, t.x, sum(q.m * k.wt) / {total!r} AS mask FROM m t CROSS JOIN s CROSS JOIN {values_of(taps, 'dy, dx, wt')} JOIN m q ON q.y = {mirrored('t.y + k.dy', 's.h')} AND q.x = {mirrored('t.x + k.dx', 's.w')} GROUP BY t.y, t.x),
        c AS MATERIALIZED (SELECT y // 4 AS y, x // 4 AS x, sum(0.25 * sqrt(least(d * d, {a.DIFFERENCE_LIMIT}) * {(pw.SQRT_SCALE * 1e8) ** 0.5!r} + {pw.SQRT_OFFSET!r})) / 4 AS v FROM d GROUP BY y // 4, x // 4),
        er AS (SELECT t.y, t.x, list_sort(list(q.v)) AS l FROM c t CROSS JOIN s CROSS JOIN {near} JOIN c q ON q.y = greatest(0, least(t.y + k.dy, h // 4 - 1)) AND q.x = greatest(0, least(t.x + k.dx, w // 4 - 1)) GROUP BY t.y, t.x),
        f AS (SELECT y // 2 AS "by", x // 2 AS bx, sum({' + '.join(f'l[{i + 1}] * {x!r}' for i, x in enumerate(w))}) AS q FROM er GROUP BY y // 2, x // 2),
        n AS (SELECT *, y // 8 AS "by", x // 8 AS bx, abs(c1 - lead(c1) OVER (PARTITION BY y, x // 8 ORDER BY x)) AS r, abs(c1 - lead(c1) OVER (PARTITION BY x, y // 8 ORDER BY y)) AS l FROM p),
        g AS (SELECT "by", bx, sum(least({f.HIGH_LIMIT}, coalesce(r, 0)) + least({f.HIGH_LIMIT}, coalesce(l, 0))) * {f.HIGH_SLOPE} + {f.HIGH_OFFSET} AS high,
              {f.GAMMA_SLOPE!r} * log2(sum({gamma(f'c1 + {f.GAMMA_BIAS} - c0')} + {gamma(f'c1 + {f.GAMMA_BIAS} + c0')}) / 128) AS gamma, sum(greatest(0, least(c2 - c1 - {f.BLUE_OFFSET!r} - abs(c0), {f.BLUE_LIMIT!r}))) AS u FROM n GROUP BY "by", bx),
        u AS (SELECT *, least(CASE WHEN u >= {32 * f.BLUE_LIMIT!r} THEN {64 * f.BLUE_LIMIT!r} - u ELSE u END, {f.BLUE_MOST * f.BLUE_LIMIT!r}) * {f.BLUE_SLOPE!r} AS blue FROM g JOIN f USING ("by", bx)),
        v AS (SELECT *, {pw.MASK_BASE} + {k4!r} / (pow({v}, 2) + {0.25 * pw.MASK_OFFSET_3!r}) + {k2!r} / ({v} + {pw.MASK_OFFSET_2!r}) + {k3!r} / (pow({v}, 2) + {pw.MASK_OFFSET_3!r}) + gamma + least(high, blue) AS x FROM u)
        SELECT b.y, b.x, round(exp(v.x) * {scale!r}, 6) + 0.0 AS quant, round(1 / (q + 0.001), 6) + 0.0 AS strategy_mask, round(mask, 6) + 0.0 AS mask FROM b JOIN v ON v."by" = b.y // 8 AND v.bx = b.x // 8"""


@query(_field_sql())
def first_quant_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field, strategy mask and pixel mask that the events' three channels start with, tiles of 64 rows and columns."""
    return r6(adaptive.first_field(_inputs(spark, sf_dir)[0], TARGET, tile=64), "quant", "strategy_mask", "mask")


@query()
def adapted_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quants of the events' plane, each shape's, after two rounds of evaluation and change.

    Shapes are searched under the first field and mask; distances are those of
    the coded channels.
    """
    pixels, field = _inputs(spark, sf_dir)
    first, _ = adaptive.Written(spark).write(adaptive.first_field(pixels, TARGET))
    quants = first.where("y % 8 = 0 and x % 8 = 0").select(F.expr("y div 8").alias("by"), F.expr("x div 8").alias("bx"), "quant")
    masked = pixels.drop("mask").join(first.select("y", "x", "mask"), ["y", "x"])
    costs = tilings.shape_costs(masked, field.drop("quant").join(quants, ["by", "bx"]), TARGET)
    tiling, _ = adaptive.Written(spark).write(tilings.place_shapes(costs, TARGET))
    start = adaptive.adjusted(quants, tiling, TARGET)
    found, _ = adaptive.adapt(start, adaptive.coding_distance(pixels, 90.0), TARGET, rounds=2)
    return r6(found, "quant", "distance")


# ---- wide stencils


def _blur_sql(source: str, name: str, columns: list[str], sigma: float) -> str:
    """Two passes over columns of a plane (y, x), weighing what there is, or mirrored where five taps are enough."""
    r = halo.radius(sigma)
    taps = [(d, math.exp(-d * d / (2 * sigma * sigma))) for d in range(-r, r + 1)]
    out = []
    for at, (a, b) in enumerate(((source, f"{name}_h"), (f"{name}_h", name))):
        along, other = ("x", "y") if at == 0 else ("y", "x")
        sums = ", ".join(f"sum(q.{c} * k.w) / sum(k.w) AS {c}" for c in columns)
        place = f"t.{along} + k.d"
        if r == 2:
            place = mirrored(place, f"(SELECT max({along}) + 1 FROM {source})")
        out.append(f"{b} AS MATERIALIZED (SELECT t.y, t.x, {sums} FROM {a} t CROSS JOIN {values_of(taps, 'd, w')} JOIN {a} q ON q.{other} = t.{other} AND q.{along} = {place} GROUP BY t.y, t.x)")
    return ", ".join(out)


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' channels, widened to the range of the bands."""
    return _opsin(spark, sf_dir).select("y", "x", *[(F.col(c) * 90).alias(c) for c in ("c0", "c1", "c2")])


def _bands_sql() -> str:
    h = halo
    clamp = lambda v, m: f"CASE WHEN {v} >= {m} THEN ({v} - {m}) * {h.CLAMP_SLOPE} + {m} WHEN {v} < -{m} THEN ({v} + {m}) * {h.CLAMP_SLOPE} - {m} ELSE {v} END"
    removed = lambda v, m: f"CASE WHEN {v} > {m} THEN {v} - {m} WHEN {v} < -{m} THEN {v} + {m} ELSE 0.0 END"
    amplified = lambda v, m: f"CASE WHEN {v} > {m} THEN {v} + {m} WHEN {v} < -{m} THEN {v} - {m} ELSE {v} + {v} END"
    three = ["c0", "c1", "c2"]
    minus = ", ".join(f"a.{c} - b.{c} AS {c}" for c in three)
    low = f"{h.LOW_SCALE[0]} * l.c0 AS low_x, {h.LOW_SCALE[1]} * l.c1 AS low_y, {h.LOW_SCALE[2]} * (l.c2 + {h.LOW_Y_TO_B} * l.c1) AS low_b"
    medium = f"{removed('m.c0', h.MEDIUM_REMOVED)} AS medium_x, {amplified('m.c1', h.MEDIUM_AMPLIFIED)} AS medium_y, m.c2 AS medium_b"
    high = f"{removed('s.c0', h.HIGH_REMOVED)} AS high_x, {amplified(f's.k * {h.HIGH_SCALE}', h.HIGH_AMPLIFIED)} AS high_y"
    ultra = f"{removed('(g.c0 - s.c0)', h.ULTRA_REMOVED)} AS ultra_x, ({clamp('(g.c1 - s.k)', h.ULTRA_CLAMP)}) * {h.ULTRA_SCALE} AS ultra_y"
    rounded = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in h.BANDS)
    return f"""
        WITH {_OPSIN}, p AS MATERIALIZED (SELECT y, x, c0 * 90 AS c0, c1 * 90 AS c1, c2 * 90 AS c2 FROM o), {_blur_sql('p', 'l', three, h.LOW)},
        r AS MATERIALIZED (SELECT a.y, a.x, {minus} FROM p a JOIN l b USING (y, x)), {_blur_sql('r', 'm', three, h.HIGH)},
        d AS MATERIALIZED (SELECT a.y, a.x, {minus} FROM r a JOIN m b USING (y, x)),
        g AS MATERIALIZED (SELECT y, x, c0 * ({h.SUPPRESS} / (c1 * c1 + {h.SUPPRESS}) * {1 - h.SUPPRESS_LEAST!r} + {h.SUPPRESS_LEAST}) AS c0, c1 FROM d), {_blur_sql('g', 'sm', ['c0', 'c1'], h.ULTRA)},
        s AS (SELECT y, x, c0, {clamp('c1', h.HIGH_CLAMP)} AS k FROM sm)
        SELECT y, x, {rounded} FROM (SELECT y, x, {low}, {medium}, {high}, {ultra} FROM l JOIN m USING (y, x) JOIN g USING (y, x) JOIN s USING (y, x))"""


@query(_bands_sql())
def frequency_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four bands of three channels of the events' plane, tiles of 64 rows and columns."""
    return r6(halo.frequency_bands(_three(spark, sf_dir), tile=64), *halo.BANDS)


def _adapted_sql() -> str:
    h, names = halo, ("c0", "c1", "c2")
    mixed = lambda t, c: "(" + " + ".join(f"80 * {t}.{n} * {m}" for n, m in zip(names, h.MIX[c], strict=True)) + f" + {h.MIX_BIAS[c]})"
    seen = [f"greatest({mixed('a', c)} * greatest(({h.RESPONSE} * ln(greatest({mixed('b', c)}, {h.MIX_BIAS[c]}) + {h.RESPONSE_BIAS}) - {-h.RESPONSE_OFFSET}) / greatest({mixed('b', c)}, {h.MIX_BIAS[c]}), 1e-4), {h.MIX_BIAS[c]}) AS s{c}" for c in range(3)]
    return f"""
        WITH {_OPSIN}, p AS MATERIALIZED (SELECT y, x, c1 AS c0, c1 * 0.7 + 0.01 AS c1, abs(c2) AS c2 FROM o), {_blur_sql('p', 'b', list(names), h.ADAPT_BLUR)},
        s AS (SELECT a.y, a.x, {', '.join(seen)} FROM p a JOIN b USING (y, x))
        SELECT y, x, round(s0 - s1, 6) + 0.0 AS c0, round(s0 + s1, 6) + 0.0 AS c1, round(s2, 6) + 0.0 AS c2 FROM s"""


@query(_adapted_sql())
def adapted_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapted opponent colours of light made of the events' channels, tiles of 64 rows and columns."""
    light = _opsin(spark, sf_dir).select("y", "x", F.col("c1").alias("c0"), (F.col("c1") * 0.7 + 0.01).alias("c1"), F.abs("c2").alias("c2"))
    return r6(halo.adapted_colours(light, tile=64), "c0", "c1", "c2")


_SIGMA = "CASE WHEN (y // 8 + x // 8) % 5 = 4 THEN -5.0::DOUBLE ELSE -0.02::DOUBLE * (1 + (y // 8 + x // 8) % 5) END"


def _pass_sql(source: str, name: str, mixed: list, compared: list, scale: float, sigma: str = _SIGMA) -> str:
    """One pass: a sample's surroundings as columns, then weights, then means."""
    places = sorted({(dy + a, dx + b) for dy, dx in [*mixed, (0, 0)] for a, b in [*compared, (0, 0)]})
    p = {d: f"p{i}" for i, d in enumerate(places)}
    others = [d for d in mixed if d != (0, 0)]
    columns = ", ".join(f"max(q.c{c}) FILTER (t.i = {i}) AS p{i}c{c}" for i in range(len(places)) for c in range(3))
    unit = f"sigma * {halo.SIGMA_SCALE * scale!r} * CASE WHEN y % 8 IN (0, 7) OR x % 8 IN (0, 7) THEN {halo.EDGE_SCALE!r} ELSE 1.0 END"
    gaps = lambda d: " + ".join(f"abs({p[o]}c{c} - {p[d[0] + o[0], d[1] + o[1]]}c{c}) * {halo.CHANNEL_SCALE[c]}::DOUBLE" for c in range(3) for o in compared)
    weights = ", ".join(f"greatest(0.0, ({gaps(d)}) * {unit} + 1.0) AS w{i}" for i, d in enumerate(others))
    total = " + ".join(f"w{i}" for i in range(len(others)))
    means = ", ".join(f"CASE WHEN sigma < {halo.LEAST_SIGMA!r} THEN {p[0, 0]}c{c} ELSE ({p[0, 0]}c{c} + " + " + ".join(f"w{i} * {p[d]}c{c}" for i, d in enumerate(others)) + f") / (1.0 + {total}) END AS c{c}" for c in range(3))
    near = pulled(source, [(dy, dx, i) for i, (dy, dx) in enumerate(places)], "dy, dx, i", "mirror")
    return f"""{name}_n AS MATERIALIZED (SELECT t.y, t.x, {columns} FROM {near} GROUP BY t.y, t.x),
        {name}_g AS (SELECT *, {sigma} AS sigma FROM {name}_n), {name}_w AS (SELECT *, {weights} FROM {name}_g), {name} AS MATERIALIZED (SELECT y, x, {means} FROM {name}_w)"""


@query(f"""
    WITH {EVT}, {SIZE.format(t='e')}, e3 AS MATERIALIZED (SELECT y, x, value / 1000 AS c0, value / 500 AS c1, (value % 7) / 10 AS c2 FROM e),
    {', '.join(_pass_sql(('e3', 'f0', 'f1')[i], f'f{i}', *p) for i, p in enumerate(halo.PASSES))}
    SELECT y, x, round(c0, 6) + 0.0 AS c0, round(c1, 6) + 0.0 AS c1, round(c2, 6) + 0.0 AS c2 FROM f2
""")
def edge_preserving_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three passes of the filter over the events' plane, tiles of 64 rows and columns."""
    v, step = F.col("value"), (F.expr("y div 8") + F.expr("x div 8")) % 5
    sigma = F.when(step == 4, -5.0).otherwise(F.lit(-0.02) * (1 + step))
    e = planes.event_plane(spark, sf_dir).select("y", "x", (v / 1000).alias("c0"), (v / 500).alias("c1"), ((v % 7) / 10).alias("c2"), sigma.alias("sigma"))
    return r6(halo.edge_preserving(e, tile=64), "c0", "c1", "c2")


@query()
def visible_difference_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How different light made of the events' channels and its coarse steps look, over two scales."""
    light = _opsin(spark, sf_dir).select("y", "x", F.col("c1").alias("c0"), (F.col("c1") * 0.7 + 0.01).alias("c1"), F.abs("c2").alias("c2"))
    both = light.select("*", *[(F.rint(F.col(f"c{i}") * 24) / 24).alias(f"r{i}") for i in range(3)])
    return r6(metric.visible_difference(both, tile=128), "difference")


_LEVEL = "(0.1::DOUBLE + ((y // 8 * 3 + x // 8) % 7) / 4.0::DOUBLE)"
_WIDTH = f"1 / least({halo.SIGMA_LEAST!r}::DOUBLE, 0.46::DOUBLE / ({_LEVEL} * {halo.SIGMA_UNIT!r}) * {{s}} / 7)"
_PLAIN = max(halo.PLAIN_LEAST, halo.PLAIN_BASE**1.3)


@query(f"""
    WITH {EVT}, {SIZE.format(t='e')}, o3 AS MATERIALIZED (SELECT y, x, value / 1000 AS c0, value / 500 AS c1, (value % 7) / 10 AS c2 FROM e),
    e3 AS MATERIALIZED (SELECT y, x, round_even(c0 * 60, 0) / 60 AS c0, round_even(c1 * 60, 0) / 60 AS c1, round_even(c2 * 60, 0) / 60 AS c2 FROM o3),
    {', '.join(_pass_sql('e3', f'f{s}', *halo.PASSES[1], sigma=_WIDTH.format(s=s)) for s in halo.SHARPNESSES)},
    b AS (SELECT o.y // 8 AS "by", o.x // 8 AS bx, {', '.join(f'sum(pow(1 + (o.y + o.x) % 3, 2) * ({halo.BLOCK_ERROR[0]!r} * pow(o.c0 - f{s}.c0, 2) + pow(o.c1 - f{s}.c1, 2) + {halo.BLOCK_ERROR[2]!r} * pow(o.c2 - f{s}.c2, 2))) AS e{s}' for s in halo.SHARPNESSES)}
          FROM o3 o {' '.join(f'JOIN f{s} ON f{s}.y = o.y AND f{s}.x = o.x' for s in halo.SHARPNESSES)} GROUP BY 1, 2)
    SELECT "by", bx, CAST(CASE WHEN e7 < least(e0 * {_PLAIN!r}, e2) THEN 7 WHEN e2 < e0 * {_PLAIN!r} THEN 2 ELSE 0 END AS INTEGER) AS sharpness FROM b
""")
def sharpness_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sharpness of each block of the events' channels, coded in steps of a sixtieth, under one pass of the filter."""
    v = F.col("value")
    e = planes.event_plane(spark, sf_dir).select("y", "x", (v / 1000).alias("c0"), (v / 500).alias("c1"), ((v % 7) / 10).alias("c2"))
    level = 0.1 + ((F.expr("y div 8") * 3 + F.expr("x div 8")) % 7) / F.lit(4.0)
    rows = e.select("*", *[(F.rint(F.col(f"c{i}") * 60) / 60).alias(f"r{i}") for i in range(3)], (1 + (F.col("y") + F.col("x")) % 3 + F.lit(0.0)).alias("mask"), level.alias("level"))
    return halo.sharpness_search(rows, 1.3, iterations=1, tile=64)


@query(f"WITH {EVT}, {SIZE.format(t='e')} SELECT t.y, t.x, round(sum(q.value * t.wt), 6) + 0.0 AS value FROM {pulled('e', stencils.sharpening_taps(0.9), 'dy, dx, wt', 'mirror')} GROUP BY t.y, t.x")
def sharpened_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' plane under the inverse smoothing."""
    e = planes.event_plane(spark, sf_dir)
    return r6(stencils.gaborish_inverse(e, 0.9, planes.extent(e)), "value")
