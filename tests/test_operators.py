"""Operators that SQL can't express, against plain Python and exact round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselark.functions import pointwise as pw
from tesselark.operators import histograms, orderstats, prediction, running, selection, stencils, transforms, wavefronts
from tesselark.sources import planes
from tesselark.streaming import populations


def grid(spark, a):
    return spark.createDataFrame([(y, x, a[y][x].item()) for y in range(a.shape[0]) for x in range(a.shape[1])], f"y long, x long, value {'long' if a.dtype.kind == 'i' else 'double'}")


def array(df, shape, column="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r[column]
    return out


def test_convolution_with_mirrored_edges(spark):
    a = np.random.default_rng(0).normal(size=(9, 7))
    w = {0: 0.3, 1: 0.1, 2: 0.05, 4: 0.02, 5: 0.01, 8: 0.0125}
    p = np.pad(a, 2, mode="symmetric")
    want = sum(w[dy * dy + dx * dx] * p[2 + dy : 11 + dy, 2 + dx : 9 + dx] for dy in range(-2, 3) for dx in range(-2, 3))
    assert np.allclose(array(stencils.convolve(grid(spark, a), stencils.symmetric5(w), a.shape), a.shape), want)


def test_separable_renormalises_at_edges(spark):
    a = np.random.default_rng(1).normal(size=(8, 11))
    k = stencils.gaussian_kernel(1.1)

    def one(v):
        r = len(k) // 2
        return np.array([sum(k[r + d] * v[i + d] for d in range(-r, r + 1) if 0 <= i + d < len(v)) / sum(k[r + d] for d in range(-r, r + 1) if 0 <= i + d < len(v)) for i in range(len(v))])

    want = np.apply_along_axis(one, 0, np.apply_along_axis(one, 1, a))
    assert np.allclose(array(stencils.separable(grid(spark, a), k, a.shape), a.shape), want)


def test_erosions(spark):
    a = np.random.default_rng(2).uniform(1, 9, size=(8, 8))
    w = stencils.erosion_weights(1.0)
    p = np.pad(a, 1, mode="edge")
    s = np.sort(np.stack([p[1 + dy : 9 + dy, 1 + dx : 9 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)]), 0)
    want = sum(w[i] * s[i] for i in range(4)).reshape(4, 2, 4, 2).sum((1, 3))
    assert np.allclose(array(stencils.fuzzy_erosion_half(grid(spark, a), 1.0, a.shape), (4, 4)), want)
    assert sum(stencils.erosion_weights(5.0)) == pytest.approx(0.29959705784054957)


def test_squeeze_round_trip_on_hard_lines(spark):
    rng = np.random.default_rng(3)
    lines = [rng.integers(-500, 500, n) for n in (1, 2, 3, 8, 33, 64)] + [np.arange(40) ** 2, -np.arange(31), np.zeros(6, int), np.array([7, 7, -7, -7, 100, -100, 5])]
    rows = [(k, i, int(v)) for k, line in enumerate(lines) for i, v in enumerate(line)]
    df = spark.createDataFrame(rows, "line long, pos long, value long")
    assert sorted(map(tuple, transforms.unsqueeze(transforms.squeeze(df)).collect())) == sorted(rows)


def test_every_colour_transform_is_reversible(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([tuple(map(int, r)) for r in rng.integers(-300, 300, (50, 3))], "a long, b long, c long")
    a, b, c = (F.col(n) for n in "abc")
    for kind in range(42):
        back = pw.inverse_rct(*pw.forward_rct(a, b, c, kind), kind)
        assert df.where((back[0] != a) | (back[1] != b) | (back[2] != c)).count() == 0, kind


def test_hybrid_uints_can_be_read_back(spark):
    values = [*range(70), 127, 128, 255, 256, 65535, 65536, 2**31 - 1, 2**32 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for split, msb, lsb in ((4, 2, 0), (4, 1, 1), (0, 0, 0), (7, 3, 2)):
        for r in df.select("v", pw.hybrid_uint(F.col("v"), split, msb, lsb).alias("h")).collect():
            s, n, e = r.h
            if s < 1 << split:
                assert s == r.v and n == 0
                continue
            s -= 1 << split
            low, high, exponent = s & ((1 << lsb) - 1), (s >> lsb) & ((1 << msb) - 1), (s >> (msb + lsb)) + split
            assert n == exponent - msb - lsb
            assert ((((1 << msb) | high) << n | e) << lsb | low) == r.v


def test_signed_values_and_mirrors(spark):
    df = spark.range(-9, 10).select("id", pw.pack_signed(F.col("id")).alias("u"), pw.mirror(F.col("id"), 4).alias("m"))
    for r in df.withColumn("back", pw.unpack_signed(F.col("u"))).collect():
        assert r.back == r.id and r.u == (2 * r.id if r.id >= 0 else -2 * r.id - 1)
        assert r.m == [0, 1, 2, 3, 3, 2, 1, 0][r.id % 8]


def test_upper_median_with_ties_and_even_counts(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 5.0), ("b", 5.0), ("b", 1.0), ("c", None)], "k string, v double")
    got = {r.k: (r.median, r.mad) for r in orderstats.median_mad(df, ["k"], "v").collect()}
    assert got == {"a": (3.0, 1.0), "b": (5.0, 0.0)}


def test_lehmer_and_remainders(spark):
    p = [3, 0, 4, 1, 2]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(p)], "grp long, pos long, value long")
    assert [r.code for r in orderstats.lehmer(df).orderBy("pos").collect()] == [3, 0, 2, 0, 0]
    counts = spark.createDataFrame([("k", 1, 1), ("k", 2, 1), ("k", 3, 1)], "k string, symbol int, n long")
    assert [r.frequency for r in orderstats.largest_remainder(counts, ["k"]).orderBy("symbol").collect()] == [1366, 1365, 1365]


def test_code_lengths_are_a_prefix_code():
    for counts in ([5, 9, 12, 13, 16, 45], [1] * 300, [2**i for i in range(30)], [0, 7, 0]):
        lengths = histograms.code_lengths(counts)
        assert max(lengths) <= 15 and all((n > 0) == (c > 0) for n, c in zip(lengths, counts))
        assert sum(2.0**-n for n in lengths if n) <= 1
    assert histograms.bit_cost([5, 9, 12, 13, 16, 45]) == 224 and histograms.bit_cost([0, 7]) == 0


def test_clusters_and_merges(spark):
    rows = [(c, v, 100) for c in (0, 1) for v in range(4)] + [(c, v, 100) for c in (2, 3) for v in range(50, 54)]
    got = {r.context: r.cluster for r in histograms.cluster_histograms(spark.createDataFrame(rows, "context long, value long, n long"), "context").collect()}
    assert got[0] == got[1] != got[2] == got[3]
    assert histograms.merge_smallest([5, 1, 9, 2], 2) == [0, 0, 1, 0]


def test_weighted_prediction_is_exact_on_flat_and_undone_on_any(spark):
    a = np.random.default_rng(5).integers(0, 99, (6, 7))
    df = grid(spark, a).withColumn("plane", F.lit(0).cast("long"))
    for r in wavefronts.weighted_residuals(df).collect():
        residual = r.token // 2 if r.token % 2 == 0 else -(r.token + 1) // 2
        assert r.prediction + residual == a[r.y, r.x]
    flat = grid(spark, np.full((4, 4), 7)).withColumn("plane", F.lit(1).cast("long"))
    assert wavefronts.weighted_residuals(flat).where("token <> 0").count() == 1


def test_newton_and_ridge_agree_where_nothing_is_gated(spark):
    rng = np.random.default_rng(6)
    luma = rng.uniform(1, 5, 200)
    df = spark.createDataFrame([(0, float(v), float(v * (0.3 + 11 / 84))) for v in luma], "tile long, luma double, chroma double")
    ridge = selection.ridge(df, ["tile"], "luma", "chroma", 0.3).first()
    assert ridge.factor == pytest.approx(11, abs=1e-4) and ridge.quantized == 8
    assert selection.newton(df, ["tile"], "luma", "chroma", 0.3, 200).first().factor == pytest.approx(11, abs=1.0)


def test_size_search_finds_the_nearest_fit():
    sizes = selection.probe_sizes(lambda steps: [int(1000 / x) for x in steps], 1.0, 64.0, 20)
    assert len(sizes) == 20 and 80 <= sizes[selection.nearest_below(sizes, 100)] <= 100
    # sizes that fit in the middle only
    sizes = selection.probe_sizes(lambda steps: [50 if 10 < x < 14 else 500 for x in steps], 1.0, 64.0, 20)
    best = selection.nearest_below(sizes, 100)
    assert 10 < best < 14 and sizes[best] == 50
    assert selection.nearest_below({1.0: 9, 2.0: 7, 3.0: 7}, 5) == 2.0


def test_causal_neighbours_across_strips(spark, monkeypatch):
    monkeypatch.setattr(stencils, "STRIP", 4)
    a = np.random.default_rng(9).integers(0, 99, (19, 6))
    for r in stencils.causal(grid(spark, a)).collect():
        y, x = r.y, r.x
        left = a[y, x - 1] if x else (a[y - 1, x] if y else 0)
        top = a[y - 1, x] if y else left
        right = a[y - 1, x + 1] if y and x + 1 < 6 else top
        want = (left, top, a[y - 1, x - 1] if x and y else left, right, a[y, x - 2] if x > 1 else left, a[y - 2, x] if y > 1 else top, a[y - 1, x + 2] if y and x + 2 < 6 else right)
        assert (r.left, r.top, r.top_left, r.top_right, r.left_left, r.top_top, r.top_right_right) == want


def test_no_column_window_spans_the_plane(spark):
    plan = stencils.causal(spark.createDataFrame([(0, 0, 1)], "y long, x long, value long"))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__strip#" in w.split("], [")[-2 if w.count("], [") > 1 else 0] or "[y#" in w for w in windows)


def test_rectangular_transforms_undo_themselves(spark):
    a = np.random.default_rng(10).normal(size=(32, 32))
    plane = grid(spark, a)
    for n, m in ((16, 16), (8, 32), (32, 16)):
        k = transforms.dct(transforms.blocks(plane, n, m), n, wide=m)
        assert k.count() == 1024
        first = {(r.by, r.bx): r.value for r in k.where("v = 0 and u = 0").collect()}
        assert all(np.isclose(v, a[i * n : i * n + n, j * m : j * m + m].mean() * (n * m) ** 0.5) for (i, j), v in first.items())
        back = transforms.dct(k, n, forward=False, wide=m).selectExpr(f"by * {n} + v as y", f"bx * {m} + u as x", "value")
        assert np.allclose(array(back, a.shape), a)


def test_merged_cells_against_a_plain_loop():
    rng = np.random.default_rng(11)
    for _ in range(50):
        cells = rng.integers(0, 6, rng.integers(1, 30)).tolist()
        n, order, into = list(cells), list(range(len(cells))), {}
        while len(order) > 4:
            order.sort(key=lambda c: -n[c])
            gone = order.pop()
            n[order[-1]] += n[gone]
            into[gone] = order[-1]
        roots = []
        for c in range(len(cells)):
            while c in into:
                c = into[c]
            roots.append(c)
        assert histograms.merge_smallest(cells, 4) == [list(dict.fromkeys(roots)).index(r) for r in roots]
    with pytest.raises(ValueError):
        histograms.merge_smallest([1] * 5000, 4)


def test_images_are_read_by_spark(spark, tmp_path):
    a = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    (tmp_path / "a.ppm").write_bytes(b"P6\n# note\n4 2\n255\n" + a.tobytes())
    assert (planes.parse_pnm((tmp_path / "a.ppm").read_bytes()) == a).all()
    wide = (np.arange(6).reshape(2, 3, 1) * 1000).astype(">u2")
    assert (planes.parse_pnm(b"P7\nWIDTH 3\nHEIGHT 2\nDEPTH 1\nMAXVAL 65535\nENDHDR\n" + wide.tobytes()) == wide).all()
    f = np.arange(6, dtype="<f4").reshape(2, 3)
    (tmp_path / "b.pfm").write_bytes(b"Pf\n3 2\n-1.0\n" + f[::-1].tobytes())
    rows = planes.read_images(spark, str(tmp_path), "pfm").collect()
    assert {(r.y, r.x): r.value for r in rows} == {(y, x): float(f[y, x]) for y in range(2) for x in range(3)}
    rows = planes.read_images(spark, str(tmp_path), "pnm").collect()
    assert {(r.y, r.x, r.channel): int(r.value) for r in rows} == {(y, x, c): int(a[y, x, c]) for y in range(2) for x in range(4) for c in range(3)}
    for bad in (b"P5\n2 2\n255\nabc", b"P5\n2 2\n255\nabcde"):
        with pytest.raises(ValueError):
            planes.parse_pnm(bad)


def test_texture_is_a_function_of_the_place(spark):
    a = {(r.y, r.x): (r.c0, r.c1, r.c2) for r in planes.synthetic_texture(spark, 9, 7).repartition(3).collect()}
    b = {(r.y, r.x): (r.c0, r.c1, r.c2) for r in planes.synthetic_texture(spark, 9, 7).collect()}
    assert a == b and set(a) == {(y, x) for y in range(7) for x in range(9)}
    assert all(0 < v < 1 for c in a.values() for v in c) and len(set(a.values())) == 63


def test_dct_of_whole_blocks_takes_one_shuffle(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(32, 48))
    rows = transforms.blocks(grid(spark, a).withColumn("value", F.col("value").cast("double")), 16, 8).repartition(5)
    found = transforms.dct(rows, 16, wide=8)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    basis = {n: np.array([[np.sqrt((1 if k == 0 else 2) / n) * np.cos(np.pi * k * (2 * i + 1) / (2 * n)) for i in range(n)] for k in range(n)]) for n in (8, 16)}
    want = {(by, bx): basis[16] @ a[16 * by : 16 * by + 16, 8 * bx : 8 * bx + 8] @ basis[8].T for by in range(2) for bx in range(6)}
    got = found.collect()
    assert len(got) == a.size and all(abs(r.value - want[r["by"], r.bx][r.v, r.u]) < 1e-9 for r in got)
    back = {(r["by"], r.bx, r.v, r.u): r.value for r in transforms.dct(found, 16, forward=False, wide=8).collect()}
    assert all(abs(back[y // 16, x // 8, y % 16, x % 8] - a[y, x]) < 1e-9 for y in range(32) for x in range(48))
    with pytest.raises(Exception, match="lacks samples"):
        transforms.dct(rows.where("v <> 3 or u <> 2"), 16, wide=8).collect()
    assert transforms.dct(rows.limit(0), 16, wide=8).count() == 0


@pytest.mark.parametrize("together", [1, 3, 7, 1 << 20])
def test_characters_of_texts_cut_into_pieces(monkeypatch, together):
    import pyarrow as pa

    monkeypatch.setattr(histograms, "TOGETHER", together)
    texts = ["", None, "aB3 \nç😀z", "x", "no\tend " * 5]
    want = {}
    for t in texts:
        before = 0
        for c in t or "":
            want[before, ord(c)] = want.get((before, ord(c)), 0) + 1
            before = 1 if c in " \n" else 2 if "a" <= c <= "z" else 3 if "A" <= c <= "Z" else 4 if "0" <= c <= "9" else 5
    got = {}
    for b in histograms._pair_counts(iter([pa.RecordBatch.from_arrays([pa.array(texts[:3])], ["t"]), pa.RecordBatch.from_arrays([pa.array(texts[3:])], ["t"])])):
        for c, v, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
            got[c, v] = got.get((c, v), 0) + n
    assert got == want


def test_running_counts_of_a_stream(spark, tmp_path):
    schema = "context long, value long"
    spark.createDataFrame([(0, 1), (0, 1), (1, 2)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(0, 1), (1, 3)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = populations.running_counts(stream).writeStream.outputMode("complete").format("memory").queryName("populations").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("populations").collect())) == [(0, 1, 3), (1, 2, 1), (1, 3, 1)]


def test_natural_order_is_the_zigzag(spark):
    """Walks the diagonals of the stretched square as written down for images."""
    for wide, high in ((1, 1), (2, 1), (2, 2), (4, 2)):
        w, stretch = 8 * wide, wide // high
        low = [(y, x) for y in range(high) for x in range(wide)]
        want, seen = list(low), set(low)
        for d in range(2 * w - 1):
            cells = [(d - x, x) for x in range(max(0, d - w + 1), min(d, w - 1) + 1)]
            flip = d % 2 != 0 if d < w else (2 * w - 2 - d) % 2 != 0
            for y, x in (cells[::-1] if flip else cells):
                if y % stretch == 0 and (y // stretch, x) not in seen:
                    want.append((y // stretch, x))
        got = [(r.y, r.x) for r in orderstats.natural_order(spark, wide, high).orderBy("rank").collect()]
        assert got == want


def test_remainders_of_skewed_counts_take_the_excess_from_the_largest(spark):
    groups = {"a": [100000] + [1] * 49, "b": [10000] + [1] * 9, "c": [5000, 5000] + [1] * 20, "d": [3] + [1] * 4}
    groups["e"] = [10**6] + [1] * 4094 + [2]
    rows = [(k, i, n) for k, counts in groups.items() for i, n in enumerate(counts)]
    got = {k: [0] * len(v) for k, v in groups.items()}
    for r in orderstats.largest_remainder(spark.createDataFrame(rows, "k string, symbol int, n long"), ["k"]).collect():
        got[r.k][r.symbol] = r.frequency
    for k, counts in groups.items():
        want = [max(1, n * 4096 // sum(counts)) for n in counts]
        rest = sorted(range(len(counts)), key=lambda i: (-(counts[i] * 4096 % sum(counts)), i))
        for i in range(4096 - sum(want)):
            want[rest[i % len(rest)]] += 1
        while sum(want) > 4096:
            i = max(range(len(want)), key=lambda i: (want[i], -i))
            want[i] -= min(sum(want) - 4096, want[i] - 1)
        assert got[k] == want, k
    with pytest.raises(Exception, match="more than 4096 symbols"):
        orderstats.largest_remainder(spark.createDataFrame([("k", i, 1) for i in range(4097)], "k string, symbol int, n long"), ["k"]).collect()


@pytest.fixture
def many_parts(spark):
    """Small tables keep their ranges apart."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_one_hot_group_is_ranked_and_counted_in_parts(spark, many_parts):
    rng = np.random.default_rng(8)
    sizes = {0: 3000, 1: 1, 2: 7}
    rows = [(g, i, int(v)) for g, n in sizes.items() for i, v in enumerate(rng.permutation(n))]
    df = spark.createDataFrame(rows, "grp long, pos long, value long")
    ranked = running.running(df.withColumn("one", F.lit(1)), ["grp"], ["value"], "one").collect()
    assert len(ranked) == len(rows) and all(r["__before"] == r.value and r["__total"] == sizes[r.grp] for r in ranked)
    codes = orderstats.lehmer(df)
    value = {g: [v for k, _, v in rows if k == g] for g in sizes}
    assert {(r.grp, r.pos): r.code for r in codes.collect()} == {(g, i): sum(w < v for w in value[g][i + 1 :]) for g in sizes for i, v in enumerate(value[g])}
    kept = running.checkpointed
    held = []
    try:
        running.checkpointed = lambda df: held.append(kept(df)) or held[-1]
        prediction.stable_rank(df.where("grp = 0"), "grp", "pos").collect()
        prediction.offsets(df.where("grp = 0"), ["grp"], "pos", "value").collect()
        orderstats.upper_median(df.where("grp = 0"), ["grp"], "value").collect()
    finally:
        running.checkpointed = kept
    for h in held:
        most = h.groupBy("grp", "__part").count().agg(F.max("count")).first()[0]
        assert most < 1500


def test_target_size_search_takes_all_its_probes(spark, sf_dir):
    from tesselark.plans import tokens

    r = tokens.target_size_search(spark, sf_dir).first()
    assert r.probes == 12 and 0.6 * r.finest - r.bits >= 0


def test_lehmer_moves_each_row_twice_and_counts_over_chunks(spark, monkeypatch):
    import random

    monkeypatch.setattr(orderstats, "CHUNK", 50)
    rng = random.Random(8)
    rows = [(g, 5 * i + 3, rng.randrange(w) - 9) for g, n, w in (("a", 700, 10**9), ("b", 3, 5), (None, 260, 40), ("c", 1, 1), ("d", 300, 1)) for i in range(n)]
    rng.shuffle(rows)
    got = orderstats.lehmer(spark.createDataFrame(rows, "grp string, pos long, value long"))
    want = {(g, p): sum(h == g and q > p and w < v for h, q, w in rows) for g, p, v in rows}
    assert {(r.grp, r.pos): r.code for r in got.collect()} == want and got.count() == len(rows)
    assert orderstats.lehmer(spark.createDataFrame([], "grp long, pos long, value long")).count() == 0


def test_lehmer_holds_a_row_once_however_long_its_group(spark, monkeypatch):
    held, kept = [], running.checkpointed
    for module in (running, orderstats):
        monkeypatch.setattr(module, "checkpointed", lambda df: held.append(kept(df)) or held[-1], raising=False)
    value = {g: [i * 613 % n for i in range(n)] for g, n in ((0, 1000), (1, 70), (2, 1))}
    rows = [(g, i, v) for g, vs in value.items() for i, v in enumerate(vs)]
    got = orderstats.lehmer(spark.createDataFrame(rows, "grp long, pos long, value long")).collect()
    assert {(r.grp, r.pos): r.code for r in got} == {(g, i): sum(w < v for w in value[g][i + 1 :]) for g, i, v in rows}
    assert sum(h.count() for h in held) == len(rows)
