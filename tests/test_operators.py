"""Operators against plain Python: layout, decoding, metrics, raster kernels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.functions import geometry as G
from inkspan.functions import text as T
from inkspan.operators import layout, metrics, raster, recognition, segment
from inkspan.plans.queries import QUERIES, _draw, _rasters


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_words(spark):
    t = F.lit("  “Hello, WORLD!”  it's -- a_b  3.5%\n")
    assert one(spark, T.normalised_words(t), T.tokens(t)) == (["hello", "world", "it's", "a_b", "3.5"], ["Hello", "WORLD", "its", "ab", "35"])
    assert one(spark, T.normalised_text(F.lit(" A\t\tb\n ")), T.output_name(F.lit("x/Y.PDF"), ".txt"), T.extension(F.lit("a.b/c")))[:2] == ("a b", "x/Y.txt")
    assert one(spark, T.human_size(F.lit(1023)), T.human_size(F.lit(1536)), T.human_size(F.lit(1572864))) == ("1023 B", "2 KB", "1.5 MB")
    assert one(spark, T.producer_chain(F.lit("Old"), F.lit("New")), T.producer_chain(F.lit(None).cast("string"), F.lit("New"))) == ("Old -> New", "New")
    assert one(spark, T.suppress_short(F.lit("ab")), T.suppress_short(F.lit("abc"))) == ("", "abc")
    assert one(spark, T.between_markers(F.lit("x START 1\n body \nEND y"), r"START \d", "END")) == ("body",)
    assert one(spark, T.is_cjk(F.lit("漢")), T.is_cjk(F.lit("a"))) == (True, False)


def test_rates(spark):
    r = lambda d, n, m: T.ratio(F.lit(d), F.lit(n), F.lit(m))
    assert one(spark, r(1, 4, 4), r(0, 0, 0), r(3, 0, 3)) == (0.25, 0.0, 1.0)
    s = lambda a, b: metrics.share_found(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))
    assert one(spark, s("aab", "a"), s("a", "bb")) == (pytest.approx(2 / 3), 0.0)


def table(a, b):
    d = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        d.append([i])
        for j, y in enumerate(b, 1):
            d[i].append(min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x != y)))
    return d[-1][-1]


def test_word_distance(spark, tiny):
    rand = random.Random(0)
    for _ in range(60):
        a, b = ([rand.choice("abc") for _ in range(rand.randint(0, 12))] for _ in range(2))
        assert metrics.edit_distance(a, b) == table(a, b)
    assert QUERIES["wer_pairs"](spark, tiny).where("word_distance < 0 or wer < 0").count() == 0


def test_ctc(spark):
    hot = lambda *k: [[1.0 if i == x else 0.0 for i in range(6)] for x in k]
    cases = {"": hot(0, 0), "aab": hot(0, 1, 0, 1, 1, 2), "ab": hot(1, 1, 0, 2), "a b": hot(1, 0, 4, 2), "a": hot(1, 5)}
    rows = [(k, i, s) for k, steps in cases.items() for i, s in enumerate(steps)] + [("tie", 0, [0.0, 1.0, 1.0, 0.0, 0.0, 0.0])]
    out = recognition.ctc_decode(spark.createDataFrame(rows, "line string, step int, scores array<float>"), ["line"], ["", "a", "b", "c", " "]).collect()
    assert {r.line: r.text for r in out} == {k: k for k in cases} | {"tie": "a"}


def test_lines_are_anchored(spark):
    rows = [(1, i, y, 10) for i, y in enumerate([0, 4, 8, 12])]
    out = layout.anchored_lines(spark.createDataFrame(rows, "page int, glyph int, y int, height int"), ["page"]).orderBy("glyph").collect()
    assert [r.line for r in out] == [0, 0, 1, 1]


def test_width_batches(spark):
    rows = [(1, i, w) for i, w in enumerate([10.0, 11.0, 12.0, 13.0, 14.0, 15.0, 16.0, 100.0, None])]
    out = layout.width_batches(spark.createDataFrame(rows, "page int, crop int, width double"), ["page"]).orderBy("crop").collect()
    assert [r.batch for r in out] == [0] * 6 + [1, 2, 2]


def test_geometry(spark):
    a = F.array(*map(F.lit, [3, 1, 2, 4]))
    assert one(spark, G.upper_median(a), G.upper_median(F.array().cast("array<int>"))) == (3, None)
    assert one(spark, G.detection_side(F.lit(1920), F.lit(1920)), G.recognition_width(F.lit(100), F.lit(20)), G.recognition_width(F.lit(1), F.lit(500))) == (960, 240, 4)
    b = G.bilinear(F.lit(0), F.lit(255), F.lit(255), F.lit(255), F.lit(0.5), F.lit(0.5))
    assert one(spark, b) == (191,)
    assert one(spark, G.flattened(F.lit(100), F.lit(0)), G.flattened(F.lit(200), F.lit(100)), G.flattened(F.lit(50), F.lit(100))) == (100, 255, 127)


def flood(on):
    out, n = np.zeros(on.shape, int), 0
    for y, x in zip(*np.nonzero(on)):
        if not out[y, x]:
            n += 1
            todo = [(y, x)]
            out[y, x] = n
            while todo:
                a, b = todo.pop()
                for c in range(max(0, a - 1), min(on.shape[0], a + 2)):
                    for d in range(max(0, b - 1), min(on.shape[1], b + 2)):
                        if on[c, d] and not out[c, d]:
                            out[c, d] = n
                            todo.append((c, d))
    return out


def test_labels():
    rng = np.random.default_rng(0)
    for p in (0.1, 0.4, 0.6, 1.0, 0.0):
        on = rng.random((40, 55)) < p
        assert (raster.label(on) == flood(on)).all()


def test_blur():
    img = np.zeros((7, 13), np.uint8)
    img[:, 7:] = 255
    assert raster.gaussian_blur(img, 0) is img
    out = raster.gaussian_blur(img, 0.8)
    assert out.shape == img.shape and 0 < out[3, 6] < 255 and out[3, 0] == 0 and out[3, 12] == 255
    for shape in ((1, 1), (2, 2)):
        assert raster.gaussian_blur(np.full(shape, 9, np.uint8), 10).shape == shape


def test_sampling():
    img = np.array([[0, 255], [255, 255]], np.uint8)
    at = lambda x, y: int(raster.bilinear(img, np.array([x]), np.array([y]))[0])
    assert (at(0, 0), at(0.5, 0.5)) == (0, 191) and at(0.99, 0.99) > 200
    rgb = np.zeros((50, 200, 3), np.uint8)
    assert raster.detection_input(rgb).shape == (3, 64, 192) and raster.recognition_input(rgb).shape == (3, 48, 192)
    assert raster.crop(rgb, 190, 40, 50, 50).shape[:2] == (10, 10) and raster.crop(rgb, 300, 0, 5, 5) is None
    assert raster.crop_oriented(rgb, np.array([[10.0, 10], [60, 10], [60, 30], [10, 30]])).shape == (20, 50, 3)
    assert raster.scale_background(rgb, 0.5, True).shape == (25, 100, 3) and raster.scale_background(rgb, 0.5, False) is rgb


def test_inpaint():
    gray = np.full((9, 9), 200)
    gray[2:7, 2:7] = 10
    out = raster.inpaint(gray, gray < 100, 3)
    assert (out[gray == 200] == 200).all() and (out[2:7, 2:7] == 200).all()
    assert raster.inpaint(gray, gray < 100, 1)[4, 4] == 255


def nearest_plainly(ink):
    """City-block distance to the nearest pixel that isn't ink, by looking at all of them."""
    ys, xs = np.nonzero(~ink)
    return np.array([[min((abs(y - a) + abs(x - b) for a, b in zip(ys, xs)), default=1 << 29) for x in range(ink.shape[1])] for y in range(ink.shape[0])])


def swept(gray, ink):
    """The two sweeps, pixel by pixel."""
    h, w = gray.shape
    d, c = np.where(ink, 1 << 29, 0), gray.copy()
    for ys, xs, step in ((range(h), range(w), -1), (range(h - 1, -1, -1), range(w - 1, -1, -1), 1)):
        for y in ys:
            for x in xs:
                if 0 <= y + step < h and d[y + step, x] + 1 < d[y, x]:
                    d[y, x], c[y, x] = d[y + step, x] + 1, c[y + step, x]
            for x in xs:
                if 0 <= x + step < w and d[y, x + step] + 1 < d[y, x]:
                    d[y, x], c[y, x] = d[y, x + step] + 1, c[y, x + step]
    return d, c


def test_nearest_background():
    rng = np.random.default_rng(1)
    for p in (0.2, 0.6, 0.95):
        gray = rng.integers(0, 256, (17, 23))
        ink = rng.random(gray.shape) < p
        d, c = raster.nearest_background(gray, ink)
        assert (d == nearest_plainly(ink)).all() and (d == swept(gray, ink)[0]).all() and (c == swept(gray, ink)[1]).all()


def test_segmented_pages(spark, tiny):
    """Threshold of the flattened page, applied to the raw one; nearly all ink is filled with something else."""
    pages = _rasters(spark, tiny)
    for r in raster.segment_pages(pages, "page").collect():
        gray = _draw(r.page)
        at = raster.otsu(raster.flatten_background(gray))
        d, c = swept(gray, gray <= at)
        assert (r.threshold, r.foreground) == (at, (gray <= at).sum()) and r.changed > 0.5
        assert r.background_sum == np.where(d == 0, gray, np.where(d > 3, 255, c)).sum()
    got = {(r.page, r.label): (r.area, r.min_x, r.min_y) for r in QUERIES["connected_components"](spark, tiny).where("page in (1, 2)").collect()}
    for p in (1, 2):
        found = flood(_draw(p) <= 90)
        for k in range(1, found.max() + 1):
            y, x = np.nonzero(found == k)
            assert got.pop((p, k)) == (len(x), x.min(), y.min())
    assert not got


def test_pages_without_ink_and_of_one_pixel(spark):
    pages = raster.draw_pages(spark.createDataFrame([(1,), (2,), (3,)], "page int"), "page", lambda k: np.full((1, 1), 255) if k == 1 else np.full((70, 3), 9 if k == 2 else 200))
    out = {r.page: r for r in raster.segment_pages(pages, "page").collect()}
    assert {k: r.threshold for k, r in out.items()} == {1: 0, 2: 0, 3: 0} and out[3].foreground == 0 and out[3].changed == 0.0
    assert raster.label_pages(pages, "page", 90).collect() == [(2, 1, 210, 0, 0)]


def test_colours():
    rgba = np.array([[[255, 0, 0, 255], [0, 255, 0, 0]]], np.uint8)
    assert raster.to_rgb(rgba).tolist() == [[[255, 0, 0], [0, 0, 0]]] and raster.to_rgb(rgba[..., 0]).shape == (1, 2)
    assert raster.to_gray(rgba).tolist() == [[76, 0]] and raster.to_gray(rgba[..., :1]).shape == (1, 2)


def test_reading_order_of_a_slanted_page(spark):
    """Each box is a little lower than the one before it: lines end where the first box is left behind."""
    rows = [(1, i, 100 - 10 * i, 4 * i, 8, 10) for i in range(6)]
    out = layout.reading_order(spark.createDataFrame(rows, "page int, box int, x int, y int, width int, height int"), ["page"])
    assert [r.box for r in out.orderBy("place").collect()] == [1, 0, 3, 2, 5, 4]


def test_sampled_words(spark):
    for pages in range(1, 25):
        for some in (0, 1, 61, 299):
            assert one(spark, T.sampled_words(F.lit(some), F.lit(pages)))[0] == (some if pages <= 10 else some * pages // 10)


def test_flags(spark):
    of = lambda s: one(spark, T.program_flags(F.lit(s)))[0]
    assert of("-p -s") == ["-p", "-s"] and of(" -b x -s  -b") == ["-s"] and of("-b -b -p") == ["-p"] and of("") == []


def test_one_valued_page_has_threshold_zero(spark):
    rows = spark.createDataFrame([(1, i, 0, 77) for i in range(20)], "page int, x int, y int, gray int")
    assert segment.otsu(rows, ["page"]).first().threshold == 0
    assert raster.otsu(np.full((3, 3), 77)) == 0


def test_component_axes_of_any_shape(spark):
    """Components with gaps, of one pixel, upright, slanted and scattered; extents against all of their pixels."""
    rand = random.Random(3)
    shapes = {"dot": {(7, 9)}, "bar": {(4, y) for y in range(12)}, "gaps": {(x, y) for x in range(0, 20, 3) for y in (1, 5)}, "slant": {(x, x // 2) for x in range(30)}}
    shapes["scattered"] = {(rand.randrange(40), rand.randrange(25)) for _ in range(200)}
    rows = spark.createDataFrame([(k, x, y) for k, places in shapes.items() for x, y in places] + [(None, 1, 1)], "component string, x long, y long")
    got = {r.component: r for r in recognition.component_axes(rows, ["component"]).collect()}
    assert got.keys() == shapes.keys() and abs(got["bar"].theta) == pytest.approx(np.pi / 2)
    for k, r in got.items():
        x, y = np.array(sorted(shapes[k])).T
        assert (r.cx, r.cy) == (pytest.approx(x.mean()), pytest.approx(y.mean()))
        assert (r.min_x, r.max_x, r.min_y, r.max_y) == (x.min(), x.max(), y.min(), y.max())
        if k != "bar":
            assert r.theta == pytest.approx(0.5 * np.arctan2(2 * np.cov(x, y, ddof=0)[0, 1], x.var() - y.var()), abs=1e-9)
        dx, dy, c, s = x - r.cx, y - r.cy, np.cos(r.theta), np.sin(r.theta)
        u, v = dx * c + dy * s, dy * c - dx * s
        assert (r.min_u, r.max_u, r.min_v, r.max_v) == tuple(pytest.approx(e, abs=1e-9) for e in (u.min(), u.max(), v.min(), v.max()))


def test_component_axis_broadcasts_no_pixels(spark, tiny):
    """Sizes estimated before the kernel ran let the planner send every pixel through the driver."""
    for name, each in (("component_axis", 20), ("oriented_polygons", 0)):
        out = QUERIES[name](spark, tiny)
        assert len(out.collect()) == each * spark.read.parquet(f"{tiny}/supplier.parquet").count()
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_oriented_polygons_of_wide_components(spark, tmp_path, monkeypatch):
    """No component of the tables is wide enough; with a lower bound on both sides there are some."""
    import duckdb

    from inkspan.plans.queries import ORACLE_SQL

    monkeypatch.setattr(recognition, "elongated", lambda w, h: w > 0.5 * h)
    spark.createDataFrame([(k,) for k in range(20)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    out = QUERIES["oriented_polygons"](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(out.columns)} from ({ORACLE_SQL['oriented_polygons'].replace('> 2 * (', '> 0.5 * (')})").fetchall()
    assert want and sorted(map(tuple, out.collect())) == sorted(want)


def test_component_axis_of_symmetric_components(spark, tmp_path):
    """Where the covariance is 0 but for rounding, right angles have the sign that the SQL gives them."""
    import duckdb

    from inkspan.plans.queries import ORACLE_SQL

    keys = [343, 440, 483, 587, 743, 760, 1040, 1088, 1360, 1760]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    out = QUERIES["component_axis"](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(out.columns)} from ({ORACLE_SQL['component_axis']})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want) and sum(r[2] == -1.570796 for r in want) == 10
