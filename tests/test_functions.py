import pytest
from pyspark.sql import functions as F

from evidence_surface.functions import climate, naming
from evidence_surface.functions.colour import hue_class, with_colour, with_hsv, with_pixel_class
from evidence_surface.operators.summary import class_stats, class_stats_text, raster_stats


def colours(spark, values, factor=1.0):
    rows = [(n, None if v is None else float(v)) for n, v in enumerate(values)]
    df = spark.createDataFrame(rows, "n int, value double")
    return [r for r in with_pixel_class(with_colour(df, factor)).orderBy("n").collect()]


def test_colour_anchors(spark):
    dry, middle, humid = colours(spark, [1, 2, 3])
    assert (dry.r, dry.g, dry.b, dry.pixel_class) == (234, 245, 29, "yellow")
    assert (middle.r, middle.g, middle.b, middle.pixel_class) == (10, 122, 24, "green")
    assert (humid.r, humid.g, humid.b, humid.pixel_class) == (7, 152, 219, "blue")


def test_values_outside_are_clipped_and_invalid_is_black(spark):
    low, high, nan, null = colours(spark, [-5, 9, "nan", None], 18.0)
    assert (low.r, high.b) == (234, 219)
    for bad in (nan, null):
        assert (bad.r, bad.g, bad.b, bad.pixel_class) == (0, 0, 0, "other")


def test_sharpening_moves_values_to_the_ends(spark):
    # 1.9 is 0.45 of the range; ten times as sharp it is 0
    assert [r.r for r in colours(spark, [1.9], 10.0)] == [234]


def test_no_valid_value_is_unclassified(spark):
    found = colours(spark, [1 + n / 500 for n in range(1001)])
    assert {r.pixel_class for r in found} == {"yellow", "green", "blue"}


@pytest.mark.parametrize(
    "rgb, hsv",
    [
        ((255, 0, 0), (0, 255, 255)),
        ((0, 255, 0), (60, 255, 255)),
        ((0, 0, 255), (120, 255, 255)),
        ((255, 0, 255), (150, 255, 255)),
        ((0, 0, 0), (0, 0, 0)),
        ((200, 200, 200), (0, 0, 200)),
    ],
)
def test_hsv(spark, rgb, hsv):
    df = spark.createDataFrame([rgb], "r int, g int, b int")
    got = with_hsv(df).first()
    assert (got.h8, got.s8, got.v8) == hsv


def test_hue_ranges_and_limits(spark):
    rows = [(19, 99, 99), (20, 50, 50), (34, 99, 99), (35, 99, 99), (89, 99, 99), (90, 99, 99), (130, 99, 99), (131, 99, 99), (25, 49, 99), (25, 99, 49)]
    df = spark.createDataFrame(rows, "h int, s int, v int")
    got = [r.c for r in df.select(hue_class(F.col("h"), F.col("s"), F.col("v")).alias("c")).collect()]
    assert got == ["other", "yellow", "yellow", "green", "green", "blue", "blue", "other", "other", "other"]


def test_class_codes(spark):
    df = spark.createDataFrame([("H",), ("S",), ("D",), ("h",), ("",), (None,)], "c string")
    got = df.select(climate.climate_value(F.col("c")).alias("v"), climate.climate_colour(F.col("c")).alias("k")).collect()
    assert [r.v for r in got] == [3.0, 2.0, 1.0, 2.0, 2.0, 2.0]
    assert [r.k for r in got] == ["#0798db", "#0a7a18", "#eaf51d", "gray", "gray", "gray"]


def test_fallback_texts(spark):
    df = spark.createDataFrame([("a",), ("",), (None,), ("0",), ("0.0",), ("110.0",)], "c string")
    got = df.select(climate.or_default(F.col("c")).alias("t"), climate.age_or_default(F.col("c")).alias("a")).collect()
    assert [r.t for r in got] == ["a", "N/A", "N/A", "0", "0.0", "110.0"]
    assert [r.a for r in got] == ["a", "N/A", "N/A", "N/A", "N/A", "110.0"]


def test_names(spark):
    df = spark.createDataFrame([("map_65_ma_x.html",), ("map.html",), ("a_7_ma_8_ma",)], "n string")
    got = df.select(naming.age_from_name(F.col("n")).alias("a"), naming.pdf_path(F.col("n")).alias("p")).collect()
    assert [r.a for r in got] == [65, 0, 7]
    assert got[0].p == "map_65_ma_x.pdf"
    assert naming.params_suffix(4, 18) == "_power4.0_gradient_sharp18.0"
    one = spark.createDataFrame([("65_ma",)], "base string").select(
        naming.output_path("OUT", F.col("base"), "idw", "_p").alias("o"), naming.title_label(F.col("base")).alias("t")
    ).first()
    assert (one.o, one.t) == ("OUT/map_65_ma_idw_p.html", "65 ma")


def test_shares(spark):
    rows = [(1, c) for c in ["yellow"] * 3 + ["green"] * 2 + ["blue"] * 1 + ["other"] * 2]
    stats = class_stats(spark.createDataFrame(rows, "map_id int, pixel_class string"))
    r = class_stats_text(stats).first()
    assert (r.total, r.dry, r.semi_arid, r.humid, r.classified, r.other) == (8, 3, 2, 1, 6, 2)
    assert r.pct_dry + r.pct_semi_arid + r.pct_humid + r.pct_other == pytest.approx(100)
    assert (r.dry_text, r.other_text) == ("37.50%", "25.00%")
    assert class_stats_text(stats, 1).first().humid_text == "12.5%"


def test_raster_stats_skip_invalid_cells(spark):
    rows = [(1, 0, 0, 1.0), (1, 0, 1, 3.0), (1, 1, 0, float("nan")), (1, 1, 1, None)]
    cells = spark.createDataFrame(rows, "map_id int, i int, j int, value double")
    r = raster_stats(with_colour(cells, 1.0)).first()
    assert (r.n_rows, r.n_cols, r.total, r.valid, r.min_value, r.max_value) == (2, 2, 4, 2, 1.0, 3.0)
    assert (r.min_r, r.max_r, r.min_b, r.max_b) == (7, 234, 29, 219)
