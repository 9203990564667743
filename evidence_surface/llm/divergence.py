"""How far the word use of a language's sources lies apart, on the terms kept by an iceberg.

Kept terms of a language are those that `least_docs` of its documents or more hold. They are
found by prefix refinement. A task gives per term the ids of up to `least_docs` of its
documents, which is all that a comparison with the threshold can need. Byte prefixes are then
extended level by level (to 2, 4, 8, ... bytes; a complete term ends with a byte of its own):
a prefix that fewer distinct documents hold goes, with all terms below it, until only complete
terms are left. Numbers of documents are settled from two bounds, which both add up in plain
partial aggregates: documents counted once per term, and bits of 64 that they set; the
few prefixes between them are counted distinctly. So no group of documents or terms is gathered.

With V kept terms of the language, `count` occurrences of a term in a group, and N their sum,
p = 1 + floor(10^9 (count + 1) / (N + V)). Against q of another source or of the whole language
a term weighs floor((p - q)^2 / q). All numbers are whole and exact.

Part `pair`: for each source of a language each other one, q its p, weights added up over all
kept terms. These sums are made in tiles: a bucket of terms against two blocks of sources.
Terms that neither source has weigh alike and are multiplied. Part `term`: the `most_terms`
terms of a source that weigh most against the language, of those it has and has more of.

Defined results: null text, language or source is the empty string. Each row is a document of
its own, also if rows repeat. A group without terms is compared like any other; if a language keeps no
term, its values are 0. An empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from evidence_surface.llm.common import bounded_side, materialise
from evidence_surface.llm.term_counts import END, group_counts, term_documents

LEAST_DOCS = 3
MOST_TERMS = 200
SCALE = 1_000_000_000
REWRITE = 0.7  # terms are written again once no more than this share of them goes on
TILE_TERMS = 8192
TILE_SOURCES = 64


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + 1) / (total + kept)); beyond 64 bits before the division."""
    high = (count + 1).cast("decimal(27,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", high, (total + kept).cast("decimal(20,0)")) + 1


def _weight(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(texts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang_id, term: the terms that at least `least_docs` rows of a language hold, from rows
    of lang_id long and text."""
    found = texts.mapInArrow(
        lambda b: term_documents(b, TaskContext.get().partitionId(), least_docs),
        "lang_id long, term binary, docs array<long>, seen long",
    )
    rows, kept, length = materialise(found, "term_documents"), None, 2
    held = rows.count()
    while True:
        prefix = F.substring("term", 1, length)
        levels = rows.groupBy("lang_id", prefix.alias("prefix")).agg(
            F.sum(F.size("docs")).alias("most"), F.bit_count(F.bit_or("seen")).alias("least"), F.count("*").alias("rows")
        )
        # a document is counted once for each of its terms below the prefix, so `most` of a complete term is exact
        levels = levels.where(F.col("most") >= least_docs).withColumn("ends", F.col("prefix").endswith(F.lit(END)))
        levels = materialise(levels, f"prefixes_{length}")
        sure = F.col("ends") | (F.col("least") >= least_docs)
        unsure = levels.where(~sure).select(F.col("lang_id").alias("of"), "prefix", "rows")
        alive = levels.where(sure & ~F.col("ends")).select(F.col("lang_id").alias("of"), "prefix", "rows")
        n_unsure = unsure.count()
        if n_unsure:
            same = (F.col("lang_id") == F.col("of")) & (prefix == F.col("prefix"))
            exact = rows.join(bounded_side(unsure, n_unsure), same).select("of", "prefix", "rows", F.explode("docs").alias("doc"))
            exact = exact.distinct().groupBy("of", "prefix", "rows").count().where(F.col("count") >= least_docs)
            alive = materialise(alive.unionByName(exact.drop("count")), f"alive_{length}")
        whole = levels.where("ends").select("lang_id", F.expr("cast(substring(prefix, 1, length(prefix) - 1) as string) term"))
        kept = whole if kept is None else kept.unionByName(whole)
        n, left = alive.agg(F.count("*"), F.sum("rows")).first()
        if not n:
            return materialise(kept, "kept_terms")
        rows = rows.where(F.length("term") > length)
        if left < REWRITE * held:  # what goes now would go at the next level too, as its extensions are no more frequent
            same = (F.col("lang_id") == F.col("of")) & (prefix == F.col("prefix"))
            rows, held = materialise(rows.join(bounded_side(alive, n), same, "left_semi"), f"longer_{length}"), left
        length *= 2


def _tile(key: tuple, table: pa.Table) -> pa.Table:
    """Of a bucket of terms and two blocks of sources: what the terms add, for each two sources
    (within a block, or one of each), to the weight of as many terms that neither has."""
    term = table.column("term").combine_chunks().dictionary_encode()
    group = table.column("group_id").to_numpy()
    heads = table.filter(pa.compute.is_null(table.column("term")))
    ids = heads.column("group_id").to_numpy()
    base, block = heads.column("base").to_numpy(), heads.column("block").to_numpy()
    order = np.argsort(ids)
    ids, base, block = ids[order], base[order], block[order]
    p = np.repeat(base[None, :], max(len(term.dictionary), 1), axis=0)[: len(term.dictionary)]
    has = np.flatnonzero(~np.asarray(term.is_null()))
    p[term.indices.to_numpy(zero_copy_only=False)[has].astype(np.int64), np.searchsorted(ids, group[has])] = table.column(
        "p"
    ).to_numpy()[has]
    one, other, total = [], [], []
    same = key[2].as_py() == key[3].as_py()
    for a in range(len(ids)):
        to = np.flatnonzero((ids != ids[a]) & ((block != block[a]) | same))
        q = p[:, to]
        gap = p[:, a][:, None] - q
        neither = (base[a] - base[to]) ** 2 // base[to]
        total.append((gap * gap // q).sum(axis=0) - len(p) * neither)
        one.append(np.full(len(to), ids[a]))
        other.append(ids[to])
    return pa.table(
        {"group_id": np.concatenate(one), "other_id": np.concatenate(other), "part": np.concatenate(total).astype(np.int64)}
    )


def _pairs(counts: DataFrame, groups: DataFrame, terms: int) -> DataFrame:
    """group_id, other_id, value for each two sources of a language."""
    sources = groups.groupBy("lang_id").count().agg(F.max("count")).first()[0] or 0
    buckets, blocks = max(1, -(-terms // TILE_TERMS)), max(1, -(-sources // TILE_SOURCES))
    block = F.pmod(F.xxhash64("group_id"), F.lit(blocks)).cast("int")
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    heads = groups.select(
        "lang_id", "group_id", block.alias("block"), every(buckets).alias("bucket"),
        F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("p"), "base",
    )
    held = counts.select(
        "lang_id", "group_id", block.alias("block"), bucket.alias("bucket"), "term", "p", F.lit(0).cast("long").alias("base")
    )
    tiles = heads.unionByName(held).withColumn("facing", every(blocks))
    tiles = tiles.withColumns({"x": F.least("block", "facing"), "y": F.greatest("block", "facing")})
    parts = tiles.groupBy("lang_id", "bucket", "x", "y").applyInArrow(
        _tile, "group_id long, other_id long, part long"
    )
    parts = parts.groupBy("group_id", "other_id").agg(F.sum("part").alias("part"))
    one = groups.select("group_id", "lang_id", "source", "kept", "base")
    two = groups.select(F.col("group_id").alias("other_id"), F.col("source").alias("item"), F.col("base").alias("other_base"))
    small = groups.count()
    rows = parts.join(bounded_side(one, small), "group_id").join(bounded_side(two, small), "other_id")
    neither = F.col("kept") * _weight(F.col("base"), F.col("other_base"))
    return rows.select("lang_id", "source", "item", (F.col("part") + neither).alias("value"))


def divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = LEAST_DOCS,
    most_terms: int = MOST_TERMS,
) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank; see above."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    docs = docs.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))
    groups = materialise(docs.groupBy("lang", "source").agg(F.count("*").alias("docs")), "groups")
    langs = groups.select("lang").distinct().select("lang", F.monotonically_increasing_id().alias("lang_id"))
    langs = materialise(langs, "languages")
    groups = materialise(
        groups.join(langs, "lang").select("lang", "source", "lang_id", F.monotonically_increasing_id().alias("group_id")),
        "group_ids",
    )
    n_groups, n_langs = groups.count(), langs.count()
    kept = kept_terms(docs.join(bounded_side(langs, n_langs), "lang").select("lang_id", "text"), least_docs)

    ids = bounded_side(groups, n_groups)
    texts = docs.join(ids, ["lang", "source"]).select("group_id", "text")
    counts = texts.mapInArrow(group_counts, "group_id long, term string, n long")
    counts = counts.groupBy("group_id", "term").agg(F.sum("n").alias("n"))
    counts = counts.join(bounded_side(groups.select("group_id", "lang_id"), n_groups), "group_id")
    by_term = Window.partitionBy("lang_id", "term")
    counts = counts.join(kept, ["lang_id", "term"]).withColumn("n_lang", F.sum("n").over(by_term))
    counts = materialise(counts, "counts")

    sums = groups.join(counts.groupBy("group_id").agg(F.sum("n").alias("total")), "group_id", "left").fillna(0, ["total"])
    per_lang = kept.groupBy("lang_id").agg(F.count("*").alias("kept"))
    lang_sums = sums.groupBy("lang_id").agg(F.sum("total").alias("lang_total"))
    sums = sums.join(lang_sums, "lang_id").join(per_lang, "lang_id", "left").fillna(0, ["kept"])
    nothing = F.col("kept") == 0  # then no p is asked for, and no value but 0
    base = F.when(nothing, F.lit(1).cast("long")).otherwise(_share(F.lit(0).cast("long"), F.col("total"), F.col("kept")))
    sums = materialise(sums.withColumn("base", base), "group_sums")

    own = counts.join(bounded_side(sums.select("group_id", "source", "total", "lang_total", "kept"), n_groups), "group_id")
    own = own.withColumns(
        {
            "p": _share(F.col("n"), F.col("total"), F.col("kept")),
            "q": _share(F.col("n_lang"), F.col("lang_total"), F.col("kept")),
        }
    )
    by_source = Window.partitionBy("lang_id", "source").orderBy(F.col("value").desc(), "item")
    terms = own.where("p > q").select("lang_id", "source", F.col("term").alias("item"), _weight(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_source)).where(F.col("rank") <= most_terms)
    most_kept = per_lang.agg(F.max("kept")).first()[0] or 0
    pairs = _pairs(own.select("lang_id", "group_id", "term", "p"), sums, most_kept)
    pairs = pairs.withColumn("rank", F.row_number().over(by_source))
    both = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return both.join(bounded_side(langs, n_langs), "lang_id").select("lang", "source", "part", "item", "value", "rank")
