"""Self-join of documents whose word-shingle sets have a Jaccard similarity of `least` or more,
by chosen paths.

1. Documents with equal shingle sets are one class. A class has a sketch of PLACES minima of
   random orders of its set.
2. A run gives each class two paths, each one sampled minimum; classes that share a token there
   share the node. A node of more than NODE_ROWS classes is split again, each class going on
   along two more sampled places of its sketch, to MOST_DEPTH at most. Nodes of one class end.
   A pair of similarity 0.8 survives a split with two children in more than 93 of 100 runs at
   any depth, and runs are repeated until the target recall.
3. Leaves are compared by brute force: by sketches, which drops classes without any likely
   partner, then by whole shingle sets, exactly. A leaf of more than BLOCK_ROWS classes, which
   no path can split, is compared block against block in many groups. A pair that
   meets in several leaves counts only in the fullest (by hash if equal), so pairs are never
   listed: a group returns, for each class, its links and a neighbour nearer the group's root.
4. Links are summed and components built over classes, then given to the documents.

Shingles are `shingle` consecutive words between ASCII white space, ASCII letters in lower
case; a shorter text is one shingle of all its words.

Defined results: texts without words (null, empty) link with nothing; rows that repeat an id
and a text are copies like any others, and share `kept`; null ids come last. Other columns do
not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidence_surface.llm.common import bounded_side, materialise
from evidence_surface.llm.components import components
from evidence_surface.llm.fuse import mix
from evidence_surface.llm.words import ragged, shingle_hashes, slices, words

PLACES = 64
CHILDREN = 2
NODE_ROWS = 100
BLOCK_ROWS = 1000
MOST_DEPTH = 3
MISS_PER_RUN = 0.0625  # root of q = (0.2 + 0.8 q)^2: chance that a run loses a pair at 0.8
LIKELY_SIGMAS = 4.5
PAIRS_AT_ONCE = 250_000


def runs_for(recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(MISS_PER_RUN)))


def likely_matches(least: float) -> int:
    """Equal places that a pair at the threshold has, but for LIKELY_SIGMAS deviations."""
    return math.floor(PLACES * least - LIKELY_SIGMAS * math.sqrt(PLACES * least * (1 - least)))


def _sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    hashes, first = shingle_hashes(words(texts), shingle)
    return [np.unique(hashes[a:b]) for a, b in zip(first, first[1:])]


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """PLACES minima of each set; no set is empty."""
    lengths = np.array([len(s) for s in sets])
    values, at = np.concatenate(sets), np.cumsum(lengths) - lengths
    factors = mix(np.arange(1, PLACES + 1, dtype=np.uint64)) | np.uint64(1)
    shifts = mix(np.arange(1001, PLACES + 1001, dtype=np.uint64))
    with np.errstate(over="ignore"):
        return np.stack([np.minimum.reduceat((values ^ s) * f, at) for f, s in zip(factors, shifts)], axis=1)


def _sketched(batches: Iterator[pa.RecordBatch], shingle: int, paths: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = _sets(batch.column("text"), shingle)
            held = [i for i, s in enumerate(sets) if len(s)]
            cls, sketch, first = ([None] * len(sets) for _ in range(3))
            if held:
                minima = _minima([sets[i] for i in held])
                nodes = mix(minima[:, :paths] + np.arange(paths, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                bytes_of = (mix(minima) & np.uint64(255)).astype(np.uint8)
            for k, i in enumerate(held):
                cls[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                sketch[i], first[i] = bytes_of[k].tobytes(), nodes[k].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(cls, pa.binary()),
                    pa.array(sketch, pa.binary()),
                    pa.array(first, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "cls", "sketch", "paths"],
            )


def _children(rows: DataFrame, paths: int) -> DataFrame:
    """The nodes below: `rows` has path, cls and sketch; places of the first paths are not taken again."""
    rest = PLACES - paths
    one = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(rest))
    two = F.pmod(one + 1 + F.pmod(F.xxhash64("path", F.lit(2)), F.lit(rest - 1)), F.lit(rest))
    below = [
        F.xxhash64("path", place, F.substring("sketch", (place + 1 + paths).cast("int"), F.lit(1))) for place in (one, two)
    ]
    return rows.select(F.explode(F.array(*below)).alias("path"), "cls")


def _leaves(classes: DataFrame, paths: int) -> DataFrame:
    """(path, n, cls, rank): nodes of 2 to NODE_ROWS classes, or any number at MOST_DEPTH."""
    rows, found = classes.select(F.explode("paths").alias("path"), "cls"), []
    for depth in range(1, MOST_DEPTH + 1):
        rows = materialise(rows, f"paths{depth}") if depth > 1 else rows
        counts = materialise(rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), f"nodes{depth}")
        shared = rows.join(counts, "path")
        if depth == MOST_DEPTH:
            found.append(shared)
            break
        found.append(shared.where(F.col("n") <= NODE_ROWS))
        if not counts.where(F.col("n") > NODE_ROWS).head(1):
            break
        rows = _children(shared.where(F.col("n") > NODE_ROWS).join(classes.select("cls", "sketch"), "cls"), paths)
    # fullest first, then by hash
    rank = (F.lit(1 << 20) - F.least("n", F.lit(1 << 20))) * F.lit(1 << 42) + F.pmod("path", F.lit(1 << 42))
    return reduce(DataFrame.union, [x.select("path", "n", "cls", rank.alias("rank")) for x in found])


def _blocked(leaves: DataFrame) -> DataFrame:
    """Leaves as groups (path, a, b) of two blocks of about BLOCK_ROWS classes, or one (a = b)."""
    blocks = F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).cast("int")
    own = F.pmod(F.xxhash64("cls", F.lit(7)), blocks).cast("int")
    rows = leaves.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.select(
        "path", "cls", "rank", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
        (F.col("own") > F.col("other")).alias("late"),
    )


_GROUP = ["path", "a", "b"]


def _whole_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of a partition sorted by group, cut between groups."""
    rest = None
    for frame in frames:
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        last = (frame[_GROUP] == frame[_GROUP].iloc[-1]).all(axis=1).to_numpy()
        upto = int(np.argmax(last))
        rest = frame.iloc[upto:]
        if upto:
            yield frame.iloc[:upto].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def _group_starts(frame: pd.DataFrame) -> np.ndarray:
    keys = frame[_GROUP].to_numpy()
    fresh = np.ones(len(frame) + 1, bool)
    fresh[1:-1] = (keys[1:] != keys[:-1]).any(axis=1)
    return np.flatnonzero(fresh)


def _pairs(starts: np.ndarray, late: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group; of two blocks, one of each. PAIRS_AT_ONCE, or one row's."""
    rows = np.arange(starts[-1])
    many = np.repeat(starts[1:], np.diff(starts)) - rows - 1
    total, at = np.cumsum(many), 0
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        i = np.repeat(rows[at:upto], many[at:upto])
        j = i + 1 + ragged(many[at:upto])
        held = ~cross[i] | (late[i] != late[j])
        yield i[held], j[held]
        at = upto


class _Ranks:
    """Leaves of each row, as numbers that order them: fullest first, then by hash."""

    def __init__(self, frame: pd.DataFrame):
        lists = frame["ranks"].to_list()
        self.table = np.full((len(lists), max(map(len, lists))), -1, np.int64)
        for row, own in zip(self.table, lists):
            row[: len(own)] = own
        self.own = frame["rank"].to_numpy()

    def here(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the pair's first common leaf is this one."""
        first = np.full(len(i), np.iinfo(np.int64).max)
        mine, others = self.table[i], self.table[j]
        for k in range(self.table.shape[1]):
            value = mine[:, k]
            common = (others == value[:, None]).any(axis=1) & (value >= 0)
            first = np.where(common & (value < first), value, first)
        return first == self.own[i]


def _likely(frames: Iterator[pd.DataFrame], matches: int) -> Iterator[pd.DataFrame]:
    """Rows that have a partner in their group whose sketch is near, and whose first leaf this is."""
    for frame in _whole_groups(frames):
        sketches = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(frame), PLACES)
        ranks, wanted = _Ranks(frame), np.zeros(len(frame), bool)
        late, cross = frame["late"].to_numpy(bool), (frame["a"] != frame["b"]).to_numpy()
        for i, j in _pairs(_group_starts(frame), late, cross):
            near = np.zeros(len(i), np.uint8)
            for k in range(PLACES):
                near += sketches[i, k] == sketches[j, k]
            held = near >= matches
            i, j = i[held], j[held]
            if len(i):
                here = ranks.here(i, j)
                wanted[i[here]] = wanted[j[here]] = True
        yield frame.loc[wanted, [*_GROUP, "late", "cls", "copies", "rank", "ranks"]]


def _verified(frames: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """For each class with links in its group: how many documents, and a class nearer the root."""
    for frame in _whole_groups(frames):
        sets = [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
        ranks, late = _Ranks(frame), frame["late"].to_numpy(bool)
        cross, copies = (frame["a"] != frame["b"]).to_numpy(), frame["copies"].to_numpy(np.int64)
        sizes = np.array([len(s) for s in sets])
        links, up = np.zeros(len(frame), np.int64), np.arange(len(frame))
        starts = _group_starts(frame)
        for a, b in zip(starts, starts[1:]):
            _, number = np.unique(np.concatenate(sets[a:b]), return_inverse=True)
            at = np.cumsum(sizes[a:b]) - sizes[a:b]
            marked = np.zeros(number.max() + 1, np.int64)
            for i in range(a, b - 1):
                own = number[at[i - a] : at[i - a] + sizes[i]]
                marked[own] = 1
                rest = number[at[i + 1 - a] :]
                shared = np.add.reduceat(marked[rest], at[i + 1 - a :] - at[i + 1 - a])
                marked[own] = 0
                ok = shared >= least * (sizes[i] + sizes[i + 1 : b] - shared) - 1e-9
                if cross[i]:
                    ok &= late[i + 1 : b] != late[i]
                j = np.flatnonzero(ok) + i + 1
                if len(j):
                    j = j[ranks.here(np.full(len(j), i), j)]
                    links[i] += copies[j].sum()
                    links[j] += copies[i]
                    _unite(up, i, j)
        held = np.flatnonzero(links)
        yield pd.DataFrame(
            {"cls": frame["cls"].to_numpy()[held], "root": frame["cls"].to_numpy()[_roots(up, held)], "links": links[held]}
        )


def _roots(up: np.ndarray, rows: np.ndarray) -> np.ndarray:
    while True:
        over = up[rows]
        if (over == up[over]).all():
            return over
        rows = over


def _unite(up: np.ndarray, i: int, js: np.ndarray) -> None:
    tops = np.unique(_roots(up, np.append(js, i)))
    up[tops] = tops[0]
    up[js] = tops[0]


def _shingles(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = [s.tobytes() for s in _sets(batch.column("text"), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(sets, pa.binary())], names=["cls", "shingles"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def jaccard_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    least: float = 0.8,
    recall: float = 0.9999,
) -> DataFrame:
    """One row per row of `docs`: doc_id, text_key, class_id (least id of all that links join,
    directly or not), n_links (other documents at `least` or more, equal ones included), kept
    (whether it is the class's first)."""
    if least < 0.8:
        raise ValueError("the runs are planned for a similarity of 0.8 or more")
    keyed = _keyed(docs, id_col, text_col)
    kind, paths = dict(keyed.dtypes)["doc_id"], CHILDREN * runs_for(recall)
    rows = materialise(
        keyed.mapInArrow(
            lambda b: _sketched(b, shingle, paths),
            f"doc_id {kind}, text_key long, cls binary, sketch binary, paths array<long>",
        ),
        "sketches",
    )
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    classes = materialise(
        rows.where("cls IS NOT NULL").groupBy("cls").agg(
            F.count("*").alias("copies"), F.min(rank).alias("first"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths")
        ),
        "classes",
    )
    leaves = materialise(_leaves(classes, paths), "leaves")
    # a class has a few leaves in each run
    ranked = leaves.groupBy("cls").agg(F.sort_array(F.collect_set("rank")).alias("ranks"))
    about = classes.select("cls", "copies", "sketch").join(ranked, "cls")
    groups = _blocked(leaves).join(about, "cls")
    likely = materialise(
        groups.repartition(*_GROUP)
        .sortWithinPartitions(*_GROUP)
        .mapInPandas(
            lambda f: _likely(f, likely_matches(least)),
            "path long, a int, b int, late boolean, cls binary, copies long, rank long, ranks array<long>",
        ),
        "likely",
    )
    wanted = materialise(likely.select("cls").distinct().join(classes.select("cls", "first"), "cls"), "wanted")
    firsts = wanted.select("cls", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"))
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    texts = keyed.join(bounded_side(firsts, firsts.count()), same).select("cls", "text")
    sets = materialise(
        texts.mapInArrow(lambda b: _shingles(b, shingle), "cls binary, shingles binary").dropDuplicates(["cls"]), "shingles"
    )
    links = materialise(
        likely.join(sets, "cls")
        .repartition(*_GROUP)
        .sortWithinPartitions(*_GROUP)
        .mapInPandas(lambda f: _verified(f, least), "cls binary, root binary, links long"),
        "links",
    )
    joined = components(links.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    per_class = (
        classes.select("cls", "copies", "first")
        .join(joined.withColumnRenamed("node", "cls"), "cls", "left")
        .join(links.groupBy("cls").agg(F.sum("links").alias("links")), "cls", "left")
        .select("cls", "copies", "first", F.coalesce("root", "cls").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    per_class = materialise(per_class, "per_class")
    heads = materialise(
        per_class.groupBy("root").agg(F.min("first").alias("head"), F.min("first.doc_id").alias("class_id")), "heads"
    )
    named = materialise(
        per_class.join(heads, "root").select("cls", "class_id", "head", (F.col("links") + F.col("copies") - 1).alias("n_links")), "named"
    )
    first = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & F.col("text_key").eqNullSafe(F.col("head.text_key"))
    return rows.select("doc_id", "text_key", "cls").join(named, "cls", "left").select(
        "doc_id",
        "text_key",
        F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        (F.col("n_links").isNull() | first).alias("kept"),
    )
