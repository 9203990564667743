"""Basins of locations as bitmaps over a dictionary of names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.climate import or_default
from ..session import BROADCAST_ROWS, counted_side, materialise, shuffle_partitions, shuffled_side

_AT = ("map_id", "lon", "lat")
_SALTS = 32

# the numbers of a location's names
_NUMBERS = """flatten(transform(words, w -> transform(
    filter(sequence(0, 63), b -> (shiftright(w.bits, b) & 1L) = 1L), b -> w.word * 64L + b)))"""


@dataclass(frozen=True)
class BasinIndex:
    """names: basin, number (from 0, in the order of the names). locations: map_id, lon, lat, n_points,
    words: array of (word, bits), where bit b of word w stands for number 64 w + b; only words
    with a bit, so a location's row follows its own names, not the dictionary."""

    names: DataFrame
    locations: DataFrame
    broadcast_rows: int


def _dictionary(basins: DataFrame) -> DataFrame:
    """basin, number: a sort in ranges and prefix sums over the ranges, a row each."""
    ranged = basins.distinct().repartitionByRange(shuffle_partitions(basins.sparkSession), "basin")
    ranged = ranged.sortWithinPartitions("basin").withColumn("place", F.monotonically_increasing_id())
    # place = range << 33 | row: written before use, as both sides of the join must see the same
    placed = materialise(ranged, "basin_names").withColumn("part", F.shiftright("place", 33))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    # one row with an element for each range
    ranges = sizes.agg(F.collect_list(F.struct("part", "n", "first")).alias("ranges"))
    earlier = F.filter("ranges", lambda r: r["part"] < F.col("own.part"))
    starts = ranges.withColumn("own", F.explode("ranges")).select(
        "own.part", "own.first", F.aggregate(earlier, F.lit(0).cast("bigint"), lambda n, r: n + r["n"]).alias("start")
    )
    number = F.col("start") + F.col("place") - F.col("first")
    return placed.join(F.broadcast(starts), "part").select("basin", number.alias("number"))


def basin_index(points: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> BasinIndex:
    """Written once, so that every selection after it reads narrow rows. Points without a basin
    are of `N/A`; those of one location and basin are reduced before they meet."""
    named = points.select(*_AT, or_default(F.col("basin")).alias("basin"))
    pairs = materialise(named.groupBy(*_AT, "basin").agg(F.count("*").alias("n")), "basin_pairs")
    names = materialise(_dictionary(pairs.select("basin")), "basin_numbers")
    # a basin may hold a large share of all locations: spread it, if the names are no small side
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64(*_AT), F.lit(_SALTS)).cast("int"))
    salts = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    small = names.count() <= broadcast_rows
    numbered = pairs.join(F.broadcast(names), "basin") if small else salted.join(shuffled_side(salts), ["basin", "salt"])
    locations = (
        numbered.selectExpr(*_AT, "n", "number div 64 AS word", "shiftleft(1L, int(number % 64)) AS bit")
        .groupBy(*_AT, "word")
        .agg(F.bit_or("bit").alias("bits"), F.sum("n").alias("n"))
        .groupBy(*_AT)
        .agg(F.sum("n").alias("n_points"), F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))
    )
    return BasinIndex(names, materialise(locations, "basin_bitmaps"), broadcast_rows)


def with_any(index: BasinIndex, names: Sequence[str] | None) -> DataFrame:
    """Locations with any selected basin, by AND of their words; None selects all, an empty list
    none, as does a name that no point has. What the driver reads is a number for each name of the list."""
    if names is None:
        return index.locations
    chosen: dict[int, int] = {}
    for row in index.names.where(F.col("basin").isin(list(names))).collect():
        chosen[row.number // 64] = chosen.get(row.number // 64, 0) | 1 << row.number % 64
    if not chosen:
        return index.locations.where("false")
    signed = {word: bits - (1 << 64) if bits >> 63 else bits for word, bits in chosen.items()}
    of_word = F.create_map(*[F.lit(x).cast("bigint") for pair in signed.items() for x in pair])
    return index.locations.where(
        F.exists("words", lambda w: F.coalesce(F.try_element_at(of_word, w["word"]).bitwiseAND(w["bits"]), F.lit(0)) != 0)
    )


def basins_of_maps(index: BasinIndex, locations: DataFrame) -> DataFrame:
    """map_id, basin: the names that some of a map's `locations` have; words are united before any name is read."""
    united = locations.select("map_id", F.explode("words").alias("w")).groupBy("map_id", "w.word").agg(
        F.bit_or("w.bits").alias("bits")
    )
    numbers = united.withColumn("words", F.array(F.struct("word", "bits"))).selectExpr(
        "map_id", f"explode({_NUMBERS}) AS number"
    )
    return numbers.join(_names(index), "number").select("map_id", "basin")


def named_locations(index: BasinIndex, locations: DataFrame) -> DataFrame:
    """map_id, lon, lat, n_points, basins: the names of each of `locations`, sorted, none twice."""
    numbers = locations.selectExpr(*_AT, "n_points", f"explode({_NUMBERS}) AS number")
    named = numbers.join(_names(index), "number")
    return named.groupBy(*_AT, "n_points").agg(F.array_sort(F.collect_list("basin")).alias("basins"))


def _names(index: BasinIndex) -> DataFrame:
    return counted_side(index.names, "names", index.broadcast_rows)
