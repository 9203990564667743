"""Cell value -> colour -> hue class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Value range, ramp colours at the low, middle and high end, and
# 8-bit hue ranges (hue halved) with the least saturation and brightness.
LOW, HIGH = 1.0, 3.0
DRY_RGB = (234, 245, 29)
SEMI_ARID_RGB = (10, 122, 24)
HUMID_RGB = (7, 152, 219)
HUE_RANGES = {"yellow": (20, 34), "green": (35, 89), "blue": (90, 130)}
MIN_SATURATION = 50
MIN_BRIGHTNESS = 50


def is_valid(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def clip(value: Column, low: float, high: float) -> Column:
    """Null stays null, which `greatest` alone would skip."""
    inside = F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))
    return F.when(value.isNotNull(), inside)


def normalise(value: Column) -> Column:
    """Value clipped to its range and scaled to 0..1; invalid gives null."""
    scaled = (clip(value, LOW, HIGH) - LOW) / (HIGH - LOW)
    return F.when(is_valid(value), scaled)


def sharpen(share: Column, factor: float = 2.5) -> Column:
    return clip((share - 0.5) * float(factor) + 0.5, 0.0, 1.0)


def _channel(share: Column, dry: int, middle: int, humid: int) -> Column:
    lower = F.lit(float(dry)) + share * 2.0 * float(middle - dry)
    upper = F.lit(float(middle)) + (share - 0.5) * 2.0 * float(humid - middle)
    # single precision first, so that 9.9999999999 is 10 and not 9
    whole = F.when(share <= 0.5, lower).otherwise(upper).cast("float").cast("int")
    return F.coalesce(whole, F.lit(0))


def with_colour(cells: DataFrame, factor: float = 2.5) -> DataFrame:
    """Adds r, g, b (0..255). Invalid cells are black."""
    shares = cells.withColumn("_share", sharpen(normalise(F.col("value")), factor))
    channels = {
        name: _channel(F.col("_share"), *ends)
        for name, ends in zip("rgb", zip(DRY_RGB, SEMI_ARID_RGB, HUMID_RGB))
    }
    return shares.withColumns(channels).drop("_share")


def with_hsv(pixels: DataFrame) -> DataFrame:
    """Adds h8 (0..179), s8 and v8 (0..255) from r, g, b, as 8-bit image code has them:
    the reciprocals of the spread and the top are whole numbers of 1/4096."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    top, spread = F.col("_top"), F.col("_spread")
    sixth = F.when(top == r, g - b).when(top == g, b - r + 2 * spread).otherwise(r - g + 4 * spread)

    def fixed(part: Column, scale: float, whole: Column) -> Column:
        """part * scale / whole in 12-bit fixed point; 0 for nothing."""
        factor = F.coalesce(F.rint(F.try_divide(F.lit(scale * 4096), whole)), F.lit(0.0))
        return F.floor((part * factor + 2048) / 4096).cast("int")

    half_degrees = fixed(sixth, 30.0, spread)
    return (
        pixels.withColumn("_top", F.greatest(r, g, b))
        .withColumn("_spread", top - F.least(r, g, b))
        .withColumn("_hue", half_degrees)
        .withColumns(
            {
                "h8": F.when(F.col("_hue") < 0, F.col("_hue") + 180).otherwise(F.col("_hue")),
                "s8": fixed(spread, 255.0, top),
                "v8": top,
            }
        )
        .drop("_top", "_spread", "_hue")
    )


def hue_class(h8: Column, s8: Column, v8: Column) -> Column:
    vivid = (s8 >= MIN_SATURATION) & (v8 >= MIN_BRIGHTNESS)
    result = F
    for name, (first, last) in HUE_RANGES.items():
        result = result.when(vivid & h8.between(first, last), F.lit(name))
    return result.otherwise(F.lit("other"))


def with_pixel_class(pixels: DataFrame) -> DataFrame:
    """Adds pixel_class: yellow, green, blue or other."""
    named = hue_class(F.col("h8"), F.col("s8"), F.col("v8"))
    return with_hsv(pixels).withColumn("pixel_class", named).drop("h8", "s8", "v8")
