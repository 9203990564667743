"""URL filters: allow and block rules, and gradient-boosted trees where no rule fits.

Everything is columns and aggregates. Trees are grown level by level: one aggregate over the
training rows gives the sums of gradients and curvatures by node, feature and bin, a few
hundred rows, from which the splits are chosen. Training rows are at most MOST_LABELLED
labelled urls (by hash order, the documented bound of the fit), reduced to distinct vectors of
bins before boosting. Scoring is one expression in the scan of all urls.

Features: lengths of url, host and path; depth; share of digits; entropy of the host's
characters; parameters; hyphens and labels of the host; and the smoothed share of blocked
urls among the labelled ones of the host's last label and of its last two.

Defined results: null urls, or without `://`, have an empty host and path and fit no rule; the
trees judge them by the same features. A score of 0.5 or less allows. Without labelled urls
all are allowed. Repeated rows are judged alike. Other columns do not matter.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evidence_surface.llm.common import bounded_sample, materialise

TREES = 10
DEPTH = 3
BINS = 16
RATE = 0.3
RIDGE = 1.0
SMOOTHING = 10.0
MOST_LABELLED = 20_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    host = F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none. `rules`: a short list of
    (host and path, verdict); a rule fits its host and subdomains if the path starts with its own."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text)
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    each = F.transform(F.array_distinct(letters), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(F.lit(0.0))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    digits = F.length(F.regexp_replace(url, r"[^0-9]", ""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    found = {
        "url_length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": _count(path, "/"),
        "digit_share": digits / F.greatest(F.length(url), F.lit(1)),
        "host_entropy": _entropy(host),
        "parameters": F.when(query == "", F.lit(0)).otherwise(_count(query, "&") + 1),
        "hyphens": _count(host, "-"),
        "labels": _count(host, "."),
    }
    return {k: v.cast("double") for k, v in found.items()}


def _suffixes(host: Column) -> dict[str, Column]:
    return {"last_label": F.substring_index(host, ".", -1), "last_two": F.substring_index(host, ".", -2)}


def _bin(value: Column, edges: Sequence[float]) -> Column:
    """Number of edges below the value."""
    return sum(((value > e).cast("int") for e in edges), F.lit(0))


def _tree_value(tree: dict[int, tuple], bins: Sequence[str], node: int = 1) -> Column:
    """`tree`: node -> (feature, bin) or (value,); rows of at most that bin go to node 2n."""
    at = tree[node]
    if len(at) == 1:
        return F.lit(float(at[0]))
    return F.when(F.col(bins[at[0]]) <= at[1], _tree_value(tree, bins, 2 * node)).otherwise(
        _tree_value(tree, bins, 2 * node + 1)
    )


def _node_of(tree: dict[int, tuple], bins: Sequence[str], node: int = 1) -> Column:
    at = tree.get(node)
    if at is None:
        return F.lit(node)
    if len(at) == 1:
        return F.lit(0)
    return F.when(F.col(bins[at[0]]) <= at[1], _node_of(tree, bins, 2 * node)).otherwise(_node_of(tree, bins, 2 * node + 1))


def _split(sums: dict[tuple[int, int], tuple[float, float]], features: int) -> tuple[float, tuple[int, int] | None, float]:
    """(gain, split, value of the node as a leaf) from the sums by feature and bin."""
    gradient = sum(g for (f, _), (g, _) in sums.items() if f == 0)
    curve = sum(h for (f, _), (_, h) in sums.items() if f == 0)
    best, at = 1e-6, None
    for f in range(features):
        left_g = left_h = 0.0
        for b in sorted(b for g, b in sums if g == f)[:-1]:
            g, h = sums[f, b]
            left_g, left_h = left_g + g, left_h + h
            right_g, right_h = gradient - left_g, curve - left_h
            gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - gradient**2 / (curve + RIDGE)
            if gain > best:
                best, at = gain, (f, b)
    return best, at, -gradient / (curve + RIDGE)


def _grow(rows: DataFrame, margin: Column, bins: Sequence[str]) -> dict[int, tuple]:
    """One tree on rows of bins, block (0 or 1) and weight."""
    tree: dict[int, tuple] = {}
    share = 1 / (1 + F.exp(-margin))
    by_feature = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(b).alias("b")) for f, b in enumerate(bins)]))
    for depth in range(DEPTH + 1):
        sums = (
            rows.coalesce(1)  # a bounded sample's vectors: no exchange for each level
            .withColumn("node", _node_of(tree, bins))
            .where("node > 0")
            .select("node", ((share - F.col("block")) * F.col("weight")).alias("g"), (share * (1 - share) * F.col("weight")).alias("h"), by_feature.alias("at"))
            .groupBy("node", "at.f", "at.b")
            .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            .collect()  # at most nodes x features x BINS rows
        )
        nodes: dict[int, dict] = {}
        for r in sums:
            nodes.setdefault(r["node"], {})[r["f"], r["b"]] = (round(r["g"], 9), round(r["h"], 9))
        for node, own in nodes.items():
            _, at, value = _split(own, len(bins))
            tree[node] = (RATE * value,) if at is None or depth == DEPTH else at
        if not nodes or all(len(tree[n]) == 1 for n in nodes):
            break
    return tree


class UrlModel:
    """Bin edges, suffix shares and trees; `score` is the probability of block as a column."""

    def __init__(self, features, edges, suffixes, prior, trees):
        self.features, self.edges, self.suffixes, self.prior, self.trees = features, edges, suffixes, prior, trees

    def binned(self, rows: DataFrame) -> DataFrame:
        """`rows` with a column b0, b1, ... for each feature."""
        out = rows
        for name, shares in self.suffixes.items():  # of the bounded sample's suffixes
            out = out.join(F.broadcast(shares), name, "left").withColumn(f"{name}_share", F.coalesce(f"{name}_share", F.lit(self.prior)))
        return out.withColumns({f"b{i}": _bin(F.col(f), self.edges[f]) for i, f in enumerate(self.features)})

    def margin(self) -> Column:
        bins = [f"b{i}" for i in range(len(self.features))]
        start = F.lit(math.log(self.prior / (1 - self.prior)))
        return sum((_tree_value(t, bins) for t in self.trees), start)

    def score(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def described(urls: DataFrame, url_col: str) -> DataFrame:
    """`urls` with host, path, suffixes and lexical features."""
    host, path = parts(F.col(url_col))
    out = urls.withColumn("host", host).withColumn("path", path)
    return out.withColumns(lexical(F.col(url_col), F.col("host"), F.col("path")) | _suffixes(F.col("host")))


def fit(labelled: DataFrame, url_col: str = "url", block_col: str = "block", trees: int = TREES) -> UrlModel:
    """Trains on at most MOST_LABELLED rows of `labelled`: a url and whether it is to be blocked."""
    sample = labelled.select(F.col(url_col).alias("url"), F.col(block_col).cast("double").alias("block"))
    sample = bounded_sample(sample.where("block IS NOT NULL"), MOST_LABELLED, "url", "block")
    rows = materialise(described(sample, "url").drop("url", "host", "path"), "labelled_urls")
    n, blocked = rows.agg(F.count("*"), F.coalesce(F.sum("block"), F.lit(0.0))).first()
    prior = (blocked + 0.01) / (n + 1)
    suffixes = {}
    for name in _suffixes(F.lit("")):
        share = (F.sum("block") + SMOOTHING * prior) / (F.count("*") + SMOOTHING)
        suffixes[name] = materialise(rows.groupBy(name).agg(share.alias(f"{name}_share")), name)
    features = [c for c in rows.columns if c not in ("block", *suffixes)] + [f"{name}_share" for name in suffixes]
    model = UrlModel(features, dict.fromkeys(features, []), suffixes, prior, [])
    shared = model.binned(rows)
    cuts = [i / BINS for i in range(1, BINS)]
    found = shared.agg(*[F.percentile_approx(f, cuts, 10_000).alias(f) for f in features]).first()
    model.edges = {f: sorted(set(found[f] or ())) for f in features}
    bins = [f"b{i}" for i in range(len(features))]
    vectors = materialise(model.binned(rows).groupBy(*bins, "block").agg(F.count("*").alias("weight")), "url_vectors")
    for _ in range(trees if 0 < blocked < n else 0):
        model.trees.append(_grow(vectors, model.margin(), bins))
    return model


def judge(
    urls: DataFrame, rules: Sequence[tuple[str, str]], model: UrlModel, url_col: str = "url", id_col: str = "page_id"
) -> DataFrame:
    """One row per row of `urls`: the id, host, path, rule, verdict, score."""
    rows = described(urls.select(F.col(id_col), F.col(url_col).alias("url")), "url")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    scored = model.binned(rows).withColumn("score", model.score())
    learnt = F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, learnt).alias("verdict"), "score")


def filter_urls(urls: DataFrame, rules: Sequence[tuple[str, str]], url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """Judges all urls; the urls that a rule fits are the labelled ones of the trees."""
    host, path = parts(F.col(url_col))
    _, verdict = fitting_rule(host, path, rules)
    labelled = urls.select(F.col(url_col).alias("url"), (verdict == "block").alias("block")).where("block IS NOT NULL")
    return judge(urls, rules, fit(labelled), url_col, id_col)
