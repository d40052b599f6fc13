"""URL filter: allow and block rules, then gradient-boosted trees on lexical features. DataFrame operations only.

A rule is (host, path prefix); it fits its host and all subdomains, and the longest that fits decides. Other
URLs are judged by boosted trees with logistic loss over binned features: length, depth, digit ratio, entropy,
counts of parameters, labels and hyphens, and the block rate and frequency of the host's suffix. Training
compresses the labelled URLs to their distinct binned rows; each level of a tree is one aggregation to sums by
node, feature and bin, of which only the (bounded) sums reach the driver. Trees become column expressions.

Suffixes that are rare among the labelled URLs count as unseen: they have the rate of all labelled URLs, and frequency 0.

Defined cases: a null URL, or one without ``://``, has an empty host and path and is judged on the features of
an empty string. Labels that are null are left out of training; with labels of one class or none, every
URL gets that class's (or the allow) verdict. An empty table gives no rows. Repeated rows are judged alike. URLs of any length are read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.common import durable

N_BINS, N_TREES, DEPTH, RATE, L2 = 16, 10, 3, 0.3, 1.0
#: Suffixes with at least 1/SUFFIX_SHARE of the labelled rows have statistics of their own, so there are SUFFIX_SHARE at most.
SUFFIX_SHARE = 1000


@dataclass(frozen=True)
class Rule:
    """A rule such as ``com/en/`` and its verdict."""

    pattern: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        own, _, rest = self.pattern.partition("/")
        return ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def by_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The pattern and verdict of the longest rule that fits, or nulls."""
    pattern, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = rule.fits(host, path)
        pattern, verdict = F.when(fits, F.lit(rule.pattern)).otherwise(pattern), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return pattern, verdict


def _count(c: Column, of: str) -> Column:
    """How many of c's characters are not removed by dropping the class ``of``."""
    return (F.length(c) - F.length(F.regexp_replace(c, of, ""))).cast("double")


def suffix(host: Column) -> Column:
    """The host's last label."""
    return F.substring_index(host, ".", -1)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    size = F.length(host).cast("double")
    share = lambda ch: (F.length(host) - F.length(F.replace(host, ch, F.lit("")))) / size
    letters = F.filter(F.array_distinct(F.split(host, "")), lambda ch: ch != "")
    entropy = F.aggregate(letters, F.lit(0.0), lambda acc, ch: acc - share(ch) * F.log2(share(ch)))
    return {
        "length": F.length(url).cast("double"),
        "host_length": size,
        "depth": _count(path, "/"),
        "digit_ratio": _count(url, "[0-9]") / n,
        "host_digits": _count(host, "[0-9]"),
        "entropy": F.round(entropy, 6),
        "parameters": _count(url, "[?&]"),
        "labels": _count(host, "[.]"),
        "hyphens": _count(host, "-"),
    }


class UrlModel:
    """Boosted trees; fit() makes them, score() gives the probability that a URL is to be blocked."""

    def __init__(self) -> None:
        self.cuts: list[list[float]] = []
        self.trees: list[dict[int, tuple[int, int] | float]] = []
        self.base, self.suffixes, self.rate = 0.0, None, 0.0

    def _prepared(self, urls: DataFrame, url_col: str) -> DataFrame:
        host, path = host_and_path(F.col(url_col))
        out = urls.withColumns({"_host": host, "_path": path})
        own = features(F.col(url_col), F.col("_host"), F.col("_path"))
        out = out.withColumns({f"_x_{k}": v for k, v in own.items()} | {"_suffix": suffix(F.col("_host"))})
        return out

    def _vector(self, df: DataFrame) -> DataFrame:
        """The features as one array, with the suffix's statistics from a table of SUFFIX_SHARE rows at most."""
        df = df.join(F.broadcast(self.suffixes), "_suffix", "left")
        names = [c for c in df.columns if c.startswith("_x_")]
        own = [F.coalesce(F.col("_suffix_rate"), F.lit(self.rate)), F.coalesce(F.col("_suffix_share"), F.lit(0.0))]
        return df.withColumn("_x", F.array(*names, *own))

    def _bins(self) -> Column:
        """For each feature the number of its cuts that are at most the value."""
        return F.array(*(sum((F.when(F.col("_x")[f] >= cut, 1).otherwise(0) for cut in cuts), F.lit(0)) for f, cuts in enumerate(self.cuts)))

    def fit(self, labelled: DataFrame, url_col: str = "url", label_col: str = "label") -> UrlModel:
        rows = self._prepared(labelled.where(F.col(label_col).isNotNull()).select(F.col(url_col), F.col(label_col).cast("double").alias("_y")), url_col)
        n, positive = rows.agg(F.count("*"), F.sum("_y")).first()
        self.rate = (positive or 0.0) / n if n else 0.0
        self.base = math.log((positive + 0.5) / (n - positive + 0.5)) if n else -1.0
        stats = rows.groupBy("_suffix").agg(((F.sum("_y") + 10 * F.lit(self.rate)) / (F.count("*") + 10)).alias("_suffix_rate"), (F.count("*") / F.lit(float(n or 1))).alias("_suffix_share"))
        self.suffixes = durable(stats.where(F.col("_suffix_share") * SUFFIX_SHARE >= 1))
        if not n or self.rate in (0.0, 1.0):
            return self
        rows = self._vector(rows)
        width = len([c for c in rows.columns if c.startswith("_x_")]) + 2
        at = [i / N_BINS for i in range(1, N_BINS)]
        found = rows.agg(*(F.percentile_approx(F.col("_x")[f], at, 10_000) for f in range(width))).first()
        # a cut is a value, and a row's bin counts the cuts that are at most its own value
        self.cuts = [sorted(set(c)) for c in found]
        # also the largest values, that rare positives may have, can be cut off
        top = rows.where("_y = 1").agg(*(F.percentile_approx(F.col("_x")[f], [0.1, 0.5], 10_000) for f in range(width))).first()
        self.cuts = [sorted({*c, *t}) for c, t in zip(self.cuts, top, strict=True)]
        train = durable(rows.select("_y", self._bins().alias("_b")).groupBy("_b", "_y").agg(F.count("*").cast("double").alias("_n")))
        for _ in range(N_TREES):
            self.trees.append(self._tree(train))
        return self

    def _tree(self, train: DataFrame) -> dict[int, tuple[int, int] | float]:
        """Nodes by number (children of k are 2k + 1 and 2k + 2): a feature and the least bin that goes right, or a leaf's value."""
        tree: dict[int, tuple[int, int] | float] = {0: 0.0}
        p = 1 / (1 + F.exp(-self._sum()))
        for level in range(DEPTH):
            node = self._node(tree)
            rows = train.select(node.alias("node"), ((p - F.col("_y")) * F.col("_n")).alias("g"), (p * (1 - p) * F.col("_n")).alias("h"), F.posexplode("_b").alias("f", "b"))
            sums = rows.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            by: dict[int, dict[int, list]] = {}
            for r in sums:
                by.setdefault(r.node, {}).setdefault(r.f, []).append((r.b, r.g, r.h))
            for k, of in by.items():
                if 2**level - 1 <= k < 2 ** (level + 1) - 1:
                    self._split(tree, k, of)
        return tree

    @staticmethod
    def _split(tree: dict, k: int, of: dict[int, list]) -> None:
        best = (1e-6, None, None, None, None)
        for f in sorted(of):
            g, h = (math.fsum(x[i] for x in of[f]) for i in (1, 2))
            left_g = left_h = 0.0
            bins = sorted(of[f])
            for (_, bg, bh), (b, _, _) in zip(bins, bins[1:]):
                left_g, left_h = left_g + bg, left_h + bh
                gain = left_g**2 / (left_h + L2) + (g - left_g) ** 2 / (h - left_h + L2) - g**2 / (h + L2)
                if gain > best[0] + 1e-9:
                    best = (gain, f, b, -left_g / (left_h + L2), -(g - left_g) / (h - left_h + L2))
        if best[1] is not None:
            tree[k], tree[2 * k + 1], tree[2 * k + 2] = (best[1], best[2]), RATE * best[3], RATE * best[4]
        elif k == 0:
            tree[k] = 0.0

    @staticmethod
    def _walk(tree: dict, k: int, leaf) -> Column:
        if isinstance(tree[k], tuple):
            f, b = tree[k]
            return F.when(F.col("_b")[f] >= b, UrlModel._walk(tree, 2 * k + 2, leaf)).otherwise(UrlModel._walk(tree, 2 * k + 1, leaf))
        return leaf(k)

    def _node(self, tree: dict) -> Column:
        return self._walk(tree, 0, F.lit)

    def _sum(self) -> Column:
        return reduce(lambda a, t: a + self._walk(t, 0, lambda k: F.lit(float(t[k]))), self.trees, F.lit(self.base))

    def score(self, urls: DataFrame, url_col: str = "url") -> DataFrame:
        """urls with host, path and block_probability."""
        keep = [F.col(c) for c in urls.columns]
        out = self._vector(self._prepared(urls.select(F.struct(*keep).alias("_row"), F.col(url_col)), url_col))
        out = out.withColumn("_b", self._bins() if self.cuts else F.array(F.lit(0)))
        p = 1 / (1 + F.exp(-self._sum()))
        return out.select("_row.*", F.col("_host").alias("host"), F.col("_path").alias("path"), p.alias("block_probability"))


def filter_urls(pages: DataFrame, rules: list[Rule], model: UrlModel, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each page: id, host, path, rule, verdict, block_probability."""
    out = model.score(pages.select(F.col(id_col), F.col(url_col)), url_col)
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("block_probability") >= threshold, "block").otherwise("allow")
    return out.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "block_probability")


def held_out(labelled: DataFrame, fold: int, folds: int = 4, url_col: str = "url", label_col: str = "label", threshold: float = 0.5) -> DataFrame:
    """How a model that saw no URL of the hosts whose crc32 leaves ``fold`` judges these: one row of n, positive, blocked and right (positive ones that are blocked)."""
    host, _ = host_and_path(F.col(url_col))
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("label"), (F.crc32(host.cast("binary")) % folds == fold).alias("held"))
    judged = UrlModel().fit(rows.where("not held")).score(rows.where("held"))
    blocked = F.col("block_probability") >= threshold
    return judged.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(blocked).alias("blocked"), F.count_if(blocked & (F.col("label") == 1)).alias("right"))
