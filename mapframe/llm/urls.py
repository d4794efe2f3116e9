"""URL filters: rules where they fit, else gradient-boosted trees on lexical features. DataFrame operations only.

Training rows are binned, and each level of a tree is one aggregation of gradients by node, feature and bin. Only those
sums, a few thousand at most, come to the driver to choose splits; trees are CASE expressions over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The rules of the filter.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
         ("net/fr/", "block")]
SAMPLE = 20_000  # labelled rows that trees are fit on, at most
BINS = 16
TREES, DEPTH, RATE = 8, 3, 0.4
RIDGE, LEAST_WEIGHT = 1.0, 1.0
PRIOR = 20.0  # rows that the overall share counts as in a suffix's share
FEATURES = ["url_length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens",
            "suffix_share"]


def rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.expr("substr(url, instr(url, '://') + 3)")), F.lit(""))


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path, rest); without ``://`` host and path are empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = pages.select("page_id", "url").withColumn("rest", rest(F.col("url")))
    return rows.select("page_id", "url",
                       F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), upper, upper.lower()).alias("host"),
                       F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"), "rest")


def rule_of(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; both NULL if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def suffix() -> Column:
    return F.substring_index("host", ".", -1)


def lexical(rows: DataFrame) -> DataFrame:
    """Length, depth, digits, entropy of the host's characters, parameters, labels, hyphens, and the suffix."""
    size = F.length("rest")
    signs = F.array_distinct(F.split("host", ""))
    n = F.greatest(F.length("host"), F.lit(1)).cast("double")

    def part(c):
        p = (F.length("host") - F.length(F.replace(F.col("host"), c, F.lit("")))) / n
        return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)

    query = F.regexp_extract("rest", r"\?([^#]*)", 1)
    return rows.select(
        "*", size.cast("double").alias("url_length"), F.length("host").cast("double").alias("host_length"),
        F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double").alias("depth"),
        (F.length(F.regexp_replace("rest", "[^0-9]", "")) / F.greatest(size, F.lit(1))).alias("digit_ratio"),
        F.aggregate(signs, F.lit(0.0), lambda total, c: total + part(c)).alias("entropy"),
        F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double").alias("parameters"),
        F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        F.regexp_count("host", F.lit("-")).cast("double").alias("hyphens"), suffix().alias("suffix"))


@dataclass
class Tree:
    """A split (feature, largest value that goes left) or a leaf."""

    value: float = 0.0
    split: tuple[str, float] | None = None
    sides: list[Tree] = field(default_factory=list)

    def column(self) -> Column:
        if self.split is None:
            return F.lit(self.value)
        name, most = self.split
        return F.when(F.col(name) <= most, self.sides[0].column()).otherwise(self.sides[1].column())

    def leaf_number(self, at: int = 1) -> Column:
        """Number of the leaf of a row: 1 for the root, 2k and 2k + 1 below k."""
        if self.split is None:
            return F.lit(at)
        name, most = self.split
        return F.when(F.col(name) <= most, self.sides[0].leaf_number(2 * at)) \
            .otherwise(self.sides[1].leaf_number(2 * at + 1))

    def leaves(self, at: int = 1) -> dict[int, Tree]:
        if self.split is None:
            return {at: self}
        return self.sides[0].leaves(2 * at) | self.sides[1].leaves(2 * at + 1)


@dataclass
class Model:
    """Boosted trees on top of a constant, with the suffix shares that they were fit with."""

    constant: float
    shares: DataFrame
    share: float
    trees: list[Tree]

    def margin(self) -> Column:
        total = F.lit(self.constant)
        for tree in self.trees:
            total = total + tree.column()
        return total

    def with_suffix(self, rows: DataFrame) -> DataFrame:
        """Suffix shares come from the bounded sample, so there are at most SAMPLE of them to broadcast."""
        known = self.shares.select(F.col("suffix").alias("_suffix"), "suffix_share")
        return rows.join(F.broadcast(known), F.col("suffix") == F.col("_suffix"), "left") \
            .withColumn("suffix_share", F.coalesce("suffix_share", F.lit(self.share)))


def fit(labelled: DataFrame) -> Model:
    """Trees from rows with features, suffix and ``blocked`` (0 or 1), at most SAMPLE of them.

    Without rows the model says 0 for everything; with one label only it is a constant.
    """
    spark = labelled.sparkSession
    sample = written(labelled.orderBy(F.xxhash64("page_id", "url"), "page_id", "url").limit(SAMPLE))
    n, blocked = sample.agg(F.count("*"), F.sum("blocked")).first()
    share = (blocked or 0) / n if n else 0.0
    own = (F.sum("blocked") + F.lit(PRIOR * share)) / (F.count("*") + F.lit(PRIOR))
    shares = written(sample.groupBy("suffix").agg(own.alias("suffix_share")))
    odds = min(max(share, 1e-3), 1 - 1e-3)
    model = Model(float(spark.range(1).select(F.log(F.lit(odds / (1 - odds)))).first()[0]) if n else -1.0, shares, share, [])
    if not n or share in (0.0, 1.0):
        return model
    rows = model.with_suffix(sample)
    cuts = rows.agg(*[F.percentile_approx(f, F.array(*[F.lit(i / BINS) for i in range(1, BINS)]), 1000).alias(f)
                      for f in FEATURES]).first()
    cuts = {f: sorted(set(cuts[f])) for f in FEATURES}
    bins = [F.struct(F.lit(f).alias("feature"),
                     sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)).alias("bin")) for f in FEATURES]
    rows = written(rows.select("blocked", *FEATURES, F.array(*bins).alias("bins")))
    for _ in range(TREES):
        model.trees.append(_grow(rows, model, cuts))
    return model


def _grow(rows: DataFrame, model: Model, cuts: dict[str, list[float]]) -> Tree:
    tree, p = Tree(), 1 / (1 + F.exp(-model.margin()))
    for depth in range(DEPTH + 1):
        sums = (rows.select(tree.leaf_number().alias("node"), (F.col("blocked") - p).alias("g"), (p * (1 - p)).alias("h"),
                            F.explode("bins").alias("b"))
                .groupBy("node", "b.feature", "b.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect())
        by_node: dict[int, dict[str, dict[int, tuple[float, float]]]] = {}
        for r in sorted(sums, key=lambda r: (r.node, r.feature, r.bin)):
            by_node.setdefault(r.node, {}).setdefault(r.feature, {})[r.bin] = (r.g, r.h)
        grown = False
        for node, leaf in tree.leaves().items():
            if node in by_node:
                leaf.value, best = _best_split(by_node[node], cuts)
                if best and depth < DEPTH:
                    leaf.split, leaf.sides, grown = best, [Tree(), Tree()], True
        if not grown:
            break
    return tree


def _best_split(features: dict[str, dict[int, tuple[float, float]]], cuts: dict[str, list[float]]):
    """Value of a leaf, and its best split if one gains anything."""
    g, h = (sum(x[i] for x in next(iter(features.values())).values()) for i in (0, 1))
    best, gain = None, 1e-6
    for name in FEATURES:
        left_g = left_h = 0.0
        for at, cut in enumerate(cuts[name]):
            dg, dh = features.get(name, {}).get(at, (0.0, 0.0))
            left_g, left_h = left_g + dg, left_h + dh
            if min(left_h, h - left_h) < LEAST_WEIGHT:
                continue
            better = (left_g ** 2 / (left_h + RIDGE) + (g - left_g) ** 2 / (h - left_h + RIDGE) - g * g / (h + RIDGE))
            if better > gain:
                best, gain = (name, cut), better
    return RATE * g / (h + RIDGE), best


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, margin) of every row of (page_id, url, ...).

    Rows that a rule fits have its verdict and are the labelled URLs; all others are blocked if the trees' margin is
    above 0. NULL urls and those without ``://`` have no host, no path and no rule. No rows give no rows.
    """
    name, verdict = rule_of(rules)
    rows = lexical(parsed(pages)).withColumn("rule", name).withColumn("by_rule", verdict)
    labelled = rows.where("rule IS NOT NULL").select(
        "page_id", "url", "suffix", *FEATURES[:-1], (F.col("by_rule") == "block").cast("int").alias("blocked"))
    model = fit(labelled)
    told = model.with_suffix(rows).withColumn("margin", model.margin())
    says = F.coalesce("by_rule", F.when(F.col("margin") > 0, "block").otherwise("allow"))
    return told.select("page_id", "host", "path", "rule", says.alias("verdict"), "margin")
