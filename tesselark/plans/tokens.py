"""Queries over tables as tokens: orders, histograms, regressions and searches, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.functions import pointwise as pw
from tesselark.operators import blocks, histograms, orderstats, prediction, running, selection
from tesselark.plans.grids import EMB, _rect, _rect_sql, r6
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


# ---- order statistics


@query("""
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    m AS (SELECT event_type, value AS median, n FROM r WHERE k = n // 2 + 1),
    d AS (SELECT event_type, abs(value - median) AS dev, row_number() OVER (PARTITION BY event_type ORDER BY abs(value - median)) AS k FROM events JOIN m USING (event_type)),
    q AS (SELECT m.event_type, median, m.n, dev AS mad FROM m JOIN d ON d.event_type = m.event_type AND d.k = m.n // 2 + 1),
    s AS (SELECT *, CAST(floor(least(greatest(65536.0 * (median - mad) / 5, 1.0), 32768.0)) AS BIGINT) AS scale, CAST(floor(0.8 * 4096 * 1.6) AS BIGINT) AS most FROM q),
    g AS (SELECT *, CASE WHEN scale > most THEN greatest(1, most) ELSE scale END AS global_scale FROM s)
    SELECT event_type, median, n, mad, global_scale, CAST(floor(least(65536.0, 0.8 * (65536.0 / global_scale) + 0.5)) AS BIGINT) AS quant_dc FROM g
""")
def upper_median_mad_quantizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = orderstats.median_mad(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value")
    return orderstats.quantizer(stats, F.lit(0.8))


@query("""
    WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY p_brand ORDER BY p_size) AS upto, sum(n) OVER (PARTITION BY p_brand) AS total FROM c)
    SELECT p_brand, min(p_size) AS threshold, CAST(max(total) AS BIGINT) AS total FROM r WHERE upto > total // 2 GROUP BY p_brand HAVING max(total) >= 10 AND min(p_size) > 0
""")
def cumulative_median_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return orderstats.median_threshold(counts, ["p_brand"], "p_size", 10)


@query(f"""
    WITH {EMB}, z AS (SELECT x AS pos, count(*) FILTER (round_even(value * 4, 0) = 0) AS zeros, count(*) AS n FROM p GROUP BY x)
    SELECT pos, zeros, row_number() OVER (ORDER BY CASE WHEN pos < 4 THEN -1 ELSE floor(zeros / sqrt(n) + 0.1) END, pos) - 1 AS rank FROM z
""")
def zero_count_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planes.embedding_plane(spark, sf_dir).select(F.col("x").alias("pos"), F.rint(F.col("value") * 4).alias("value"))
    return orderstats.zero_count_order(blocks.zero_counts(p, ["pos"]), pinned=4)


@query(f"""
    WITH t AS ({_rect_sql(16, 32)}), c AS (SELECT DISTINCT v AS y, u AS x FROM t),
    d AS (SELECT y, x, x + 2 * y AS d, x < 4 AND y < 2 AS low FROM c),
    k AS (SELECT *, CASE WHEN (CASE WHEN d < 32 THEN d ELSE 62 - d END) % 2 = 0 THEN x ELSE 2 * y END AS along FROM d),
    r AS (SELECT y, x, row_number() OVER (ORDER BY low DESC, CASE WHEN low THEN y ELSE d END, CASE WHEN low THEN x ELSE along END) - 1 AS rank FROM k)
    SELECT t."by", t.bx, r.rank, t.value FROM t JOIN r ON r.y = t.v AND r.x = t.u
""")
def natural_scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane's coefficients in the scan order of a transform four blocks wide and two high."""
    order = F.broadcast(orderstats.natural_order(spark, 4, 2).withColumnsRenamed({"y": "v", "x": "u"}))  # 512 places
    return _rect(spark, sf_dir, 16, 32).join(order, ["v", "u"]).select("by", "bx", "rank", "value")


@query("""
    WITH s AS (SELECT event_type, user_id, count(*) AS size, count(*) % 2 AS custom FROM events GROUP BY ALL)
    SELECT event_type, arg_min(user_id, (size, custom, user_id)) AS user_id, min(size) AS size FROM s GROUP BY event_type
""")
def preferred_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group the candidate of least size, then without a custom order, then the first."""
    s = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("size"))
    key = F.struct("size", F.col("size") % 2, "user_id")
    return s.groupBy("event_type").agg(F.min_by("user_id", key).alias("user_id"), F.min("size").alias("size"))


@query("""
    WITH c AS (SELECT p_brand, p_size AS symbol, count(*) AS n FROM part GROUP BY ALL),
    s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY p_brand) AS BIGINT) AS total FROM c),
    f AS (SELECT *, greatest(1, n * 4096 // total) AS fl, n * 4096 % total AS rest FROM s),
    k AS (SELECT *, 4096 - CAST(sum(fl) OVER (PARTITION BY p_brand) AS BIGINT) AS missing, row_number() OVER (PARTITION BY p_brand ORDER BY rest DESC, symbol) AS k, count(*) OVER (PARTITION BY p_brand) AS kinds,
          CAST(sum(fl - 1) OVER (PARTITION BY p_brand ORDER BY fl DESC, symbol ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spare FROM f)
    SELECT p_brand, symbol, n, CASE WHEN missing >= 0 THEN fl + missing // kinds + CASE WHEN k <= missing % kinds THEN 1 ELSE 0 END ELSE fl - greatest(0, least(fl - 1, fl - 1 - missing - spare)) END AS frequency FROM k
""")
def largest_remainder_4096(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").alias("symbol")).agg(F.count("*").alias("n"))
    return orderstats.largest_remainder(counts, ["p_brand"])


@query("""
    WITH r AS (SELECT user_id AS grp, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS value FROM events)
    SELECT a.grp, a.pos, count(b.pos) AS code FROM r a LEFT JOIN r b ON b.grp = a.grp AND b.pos > a.pos AND b.value < a.value GROUP BY a.grp, a.pos
""")
def lehmer_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutation of each user's events by value; a user's events are the order's length."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), "event_id", "value")
    e = running.ranks(running.ranks(e, ["grp"], ["event_id"], "pos"), ["grp"], ["value", "event_id"], "place")
    p = e.select("grp", "pos", F.col("place").alias("value"))
    return orderstats.lehmer(p)


# ---- tokens


@query("""
    WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
    SELECT user_id, min(event_id) AS start, event_type AS value, count(*) AS length FROM e GROUP BY user_id, event_type, g
""")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction.run_lengths(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "event_id", "event_type", ["user_id"])


@query("WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, user_id, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY user_id) - n AS BIGINT) AS offset FROM c")
def exclusive_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return prediction.offsets(counts, ["event_type"], "user_id", "n")


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS rank FROM events")
def stable_family_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction.stable_rank(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id")


@query(f"""
    WITH {EMB}, b AS (SELECT y AS block, x AS pos, CAST(round_even(value * 4, 0) AS BIGINT) AS value FROM p),
    t AS (SELECT *, CAST(sum((value <> 0)::INT) OVER (PARTITION BY block) - coalesce(sum((value <> 0)::INT) OVER (PARTITION BY block ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS remaining,
          coalesce(lag((value <> 0)::INT) OVER (PARTITION BY block ORDER BY pos), 0) AS previous FROM b)
    SELECT block, pos, remaining, previous, CASE WHEN value >= 0 THEN 2 * value ELSE -2 * value - 1 END AS token FROM t WHERE remaining > 0
""")
def coefficient_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = planes.embedding_plane(spark, sf_dir).select(F.col("y").alias("block"), F.col("x").alias("pos"), F.rint(F.col("value") * 4).cast("long").alias("value"))
    return prediction.coefficient_tokens(b)


@query("SELECT p_partkey, CAST((p_size > 10)::INT + (p_size > 20)::INT + (p_size > 40)::INT AS BIGINT) AS segment FROM part")
def quant_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", prediction.segment(F.col("p_size"), [10, 20, 40]).alias("segment"))


# ---- histograms

_CHARS = """c AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS c FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS l FROM documents)),
    k AS (SELECT c, lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM c),
    h AS (SELECT CAST(CASE WHEN p IS NULL THEN 0 WHEN p IN (' ', chr(10)) THEN 1 WHEN regexp_matches(p, '^[a-z]$') THEN 2 WHEN regexp_matches(p, '^[A-Z]$') THEN 3 WHEN regexp_matches(p, '^[0-9]$') THEN 4 ELSE 5 END AS BIGINT) AS context, CAST(unicode(c) AS BIGINT) AS value, count(*) AS n FROM k GROUP BY ALL)"""


@query(f"WITH {_CHARS} SELECT context, value, n FROM h")
def context_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.characters(table(spark, sf_dir, "documents"))


@query(f"WITH {_CHARS} SELECT context % 3 AS cluster, value, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY ALL")
def context_cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.range(6).select(F.col("id").alias("context"), (F.col("id") % 3).alias("cluster"))
    return histograms.clustered(histograms.characters(table(spark, sf_dir, "documents")), mapping)


@query(f"WITH {_CHARS}, t AS (SELECT *, sum(n) OVER (PARTITION BY context) AS total FROM h) SELECT context, round(sum(-n * log2(n / total)), 3) + 0.0 AS bits, CAST(max(total) AS BIGINT) AS total, count(*) AS symbols FROM t GROUP BY context")
def shannon_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = histograms.shannon(histograms.characters(table(spark, sf_dir, "documents")), ["context"])
    return s.withColumn("bits", F.round("bits", 3) + 0.0)


@query("""
    WITH h AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY p_brand) AS total FROM h)
    SELECT p_brand, CAST(floor(round(sum(-n * log2(n / total)), 6)) AS BIGINT) AS bits FROM t GROUP BY p_brand
""")
def shannon_floor_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return histograms.shannon_floor(counts, ["p_brand"])


@query(f"""
    WITH {_CHARS}, t AS (SELECT context, CAST(sum(n) AS DOUBLE) AS total FROM h GROUP BY context),
    g AS (SELECT a.context AS l, b.context AS r, a.total AS lt, b.total AS rt FROM t a JOIN t b ON a.context < b.context),
    s AS (SELECT DISTINCT value FROM h)
    SELECT l AS "left", r AS "right", round(sum(abs(coalesce(x.n, 0) / lt - coalesce(y.n, 0) / rt)) * min(least(lt, rt)), 3) + 0.0 AS distance
    FROM g CROSS JOIN s LEFT JOIN h x ON x.context = l AND x.value = s.value LEFT JOIN h y ON y.context = r AND y.value = s.value GROUP BY l, r
""")
def shape_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = histograms.shape_distances(histograms.characters(table(spark, sf_dir, "documents")), "context")
    return d.withColumn("distance", F.round("distance", 3) + 0.0)


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("value")).agg(F.count("*").alias("n"))


@query()
def prefix_code_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.prefix_costs(_sizes(spark, sf_dir), "brand")



@query()
def histogram_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.cluster_histograms(_sizes(spark, sf_dir), "brand")


@query()
def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the 25 brands' cells after merging down to nine."""
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy("p_brand").limit(4097).collect()  # merge_smallest refuses more than 4096
    labels = histograms.merge_smallest([r["n"] for r in counts], 9)
    return spark.createDataFrame([(r["p_brand"], r["n"], k) for r, k in zip(counts, labels, strict=True)], "p_brand string, n long, label int")


# ---- regression and selection


@query(f"""
    WITH t AS (SELECT l_partkey % 64 AS tile, l_quantity / {selection.COLOR_FACTOR!r} AS a, 0.5 * l_quantity - l_extendedprice / 1000 AS b FROM lineitem),
    g AS (SELECT tile, -sum(a * b) / (sum(a * a) + count(*) * {selection.RIDGE!r} * 0.5) AS x FROM t GROUP BY tile)
    SELECT tile, round(x, 6) + 0.0 AS factor, CAST(least(greatest(round(CASE WHEN x >= 2.6 THEN x - 2.6 WHEN x <= -2.6 THEN x + 2.6 ELSE 0.0 END), -128.0), 127.0) AS INTEGER) AS quantized FROM g
""")
def tile_ridge_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 64).alias("tile"), F.col("l_quantity").alias("luma"), (F.col("l_extendedprice") / 1000).alias("chroma"))
    return r6(selection.ridge(rows, ["tile"], "luma", "chroma", 0.5), "factor")


@query()
def tile_newton_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile is 64 order keys, so tiles grow in number with the data, not in size."""
    rows = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 64").alias("tile"), F.col("l_quantity").alias("luma"), (F.col("l_extendedprice") / 1000).alias("chroma"))
    return r6(selection.newton(rows, ["tile"], "luma", "chroma", 0.5), "factor")


@query(f"""
    WITH {EMB}, d AS (SELECT y // 8 AS "by", x // 8 AS bx, k.c AS candidate, sum(pow(value - round_even(value * k.s, 0) / k.s, 2)) AS err FROM p CROSS JOIN (VALUES (0, 4.0), (1, 5.0), (2, 6.0)) AS k(c, s) GROUP BY y // 8, x // 8, k.c),
    f AS (SELECT "by", bx, candidate, round(err * CASE WHEN candidate = 0 THEN 0.98 ELSE 1.0 END, 9) AS err FROM d)
    SELECT "by", bx, CAST(arg_min(candidate, (err, candidate)) AS INTEGER) AS candidate FROM f GROUP BY "by", bx
""")
def block_argmin_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three quantisers, the one with the least block error."""
    p = planes.embedding_plane(spark, sf_dir).withColumn("k", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(s).alias("s")) for c, s in ((0, 4.0), (1, 5.0), (2, 6.0))])))
    gap = F.col("value") - F.rint(F.col("value") * F.col("k.s")) / F.col("k.s")
    e = p.groupBy(*blocks.cell(8), F.col("k.c").alias("candidate")).agg(F.sum(gap * gap).alias("error"))
    e = e.withColumn("error", F.round(F.col("error") * F.when(F.col("candidate") == 0, 0.98).otherwise(1.0), 9))
    return selection.argmin(e, ["by", "bx"])


@query("""
    WITH c AS (SELECT user_id, sum(value) FILTER (event_id % 3 = 0) AS s, sum(value) FILTER (event_id % 3 = 1) AS v, sum(value) FILTER (event_id % 3 = 2) AS h FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN round(s, 6) < round(v, 6) AND round(s, 6) < round(h, 6) THEN 'square' WHEN round(v, 6) < round(h, 6) THEN 'vertical' ELSE 'horizontal' END AS division FROM c
""")
def first_level_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.round(F.sum(F.when(F.col("event_id") % 3 == i, F.col("value"))), 6).alias(n) for i, n in enumerate("svh")]
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(*parts)
    return c.select("user_id", selection.division(F.col("s"), F.col("v"), F.col("h")).alias("division"))


@query(f"""
    WITH {_CHARS}, b AS (SELECT *, length(bin(value)) - 1 AS e FROM h),
    s AS (SELECT context, n, CASE WHEN value < 16 THEN value ELSE 16 + (e - 4) * 4 + ((value - (1::BIGINT << e)) >> (e - 2)) END AS symbol FROM b),
    g AS (SELECT context, min(symbol) AS lo, max(symbol) AS hi, sum(n) AS n FROM s GROUP BY context)
    SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS tokens, CASE WHEN coalesce(sum(n), 0) < 100 OR coalesce(bool_and(lo = hi), true) THEN 'prefix' ELSE 'ans' END AS mode FROM g
""")
def entropy_coding_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.coding_mode(histograms.characters(table(spark, sf_dir, "documents")))


@query("""
    WITH s AS (SELECT CAST(round(value * 100) AS BIGINT) - 5000 AS a, user_id - 40 AS b, (CAST(round(value * 100) AS BIGINT) * 7 + event_id) % 31 AS c0, (CAST(round(value * 100) AS BIGINT) + user_id * 3) % 37 AS c1 FROM events),
    m AS (SELECT CAST(trunc(sum(a) / count(*)) AS BIGINT) AS ma, CAST(trunc(sum(b) / count(*)) AS BIGINT) AS mb, least(sum(c0), sum(c1)) AS base FROM s),
    t AS (SELECT 0 AS i, 'a' AS property, 0::BIGINT AS threshold UNION ALL SELECT 1, 'a', ma FROM m UNION ALL SELECT 2, 'b', 0 UNION ALL SELECT 3, 'b', mb FROM m),
    c AS (SELECT i, property, threshold, least(sum(c0) FILTER (up), sum(c1) FILTER (up)) + least(sum(c0) FILTER (NOT up), sum(c1) FILTER (NOT up)) + 32 AS cost
          FROM (SELECT t.*, s.c0, s.c1, CASE property WHEN 'a' THEN a ELSE b END > threshold AS up FROM s CROSS JOIN t) GROUP BY i, property, threshold HAVING bool_or(up) AND bool_or(NOT up)),
    w AS (SELECT * FROM c, m WHERE cost < base ORDER BY cost, i LIMIT 1)
    SELECT w.property, w.threshold, CAST(coalesce(w.cost, m.base) AS BIGINT) AS cost FROM m LEFT JOIN w ON true
""")
def decision_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.round(F.col("value") * 100).cast("long")
    s = table(spark, sf_dir, "events").select((v - 5000).alias("a"), (F.col("user_id") - 40).alias("b"), ((v * 7 + F.col("event_id")) % 31).alias("c0"), ((v + F.col("user_id") * 3) % 37).alias("c1"))
    return selection.best_split(s, ["a", "b"], ["c0", "c1"])


def _feedback_sql() -> str:
    parts = ['r0 AS (SELECT y // 8 AS "by", x // 8 AS bx, value, 0.5::DOUBLE AS step, NULL::DOUBLE AS best FROM p)']
    for i in range(5):
        parts.append(f'e{i} AS (SELECT *, max(abs(value - round_even(value / step, 0) * step) / 0.1::DOUBLE) OVER (PARTITION BY "by", bx) AS e FROM r{i})')
        parts.append(f'r{i + 1} AS (SELECT "by", bx, value, step / greatest(CASE WHEN e < 0.5 THEN e * 2 WHEN e > 1 THEN e ELSE 1.0 END, 0.5) AS step, CASE WHEN e <= 1 THEN greatest(coalesce(best, 0.0), step) ELSE best END AS best FROM e{i})')
    return f'WITH {EMB}, {", ".join(parts)} SELECT "by", bx, round(max(step), 6) + 0.0 AS step, round(max(best), 6) + 0.0 AS best FROM r5 GROUP BY "by", bx'


@query(_feedback_sql())
def error_feedback_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planes.embedding_plane(spark, sf_dir).select(*blocks.cell(8), "value")
    return r6(selection.error_feedback(p, ["by", "bx"], 0.1, 0.5), "step", "best")


@query()
def target_size_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantiser step whose tokens take nearest below 60 % of the finest one's bits; one pass for all probes."""
    p = planes.embedding_plane(spark, sf_dir)

    def probe(steps: list[float]) -> list[int]:
        bits = [F.sum(1 + pw.bit_width(pw.pack_signed(F.rint(F.col("value") / s).cast("long")))) for s in steps]
        return [int(b or 0) for b in p.agg(*[b.alias(f"b{i}") for i, b in enumerate(bits)]).first()]

    sizes = selection.probe_sizes(probe, 0.01, 1.0)
    finest = sizes[0.01]
    step = selection.nearest_below(sizes, finest * 6 // 10)
    return spark.createDataFrame([(float(step), sizes[step], finest, len(sizes))], "step double, bits long, finest long, probes int")
