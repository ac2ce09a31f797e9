"""URL filters: host and path rules first, then gradient-boosted trees on lexical features, with DataFrame functions only.

The trees (Spark ML) are trained from labelled URLs. Features: lengths, depth, digit ratio, character entropy,
parameter counts, label counts and, per host suffix, the smoothed rate and count of blocked URLs among all labelled
ones. The trees are fitted to at most max_labelled labelled rows, chosen by hash of the url; everything else runs over
all rows.

A rule is an action on a host and a path: it fits its host and all subdomains if the url's path starts with the
rule's. The longest fitting rule wins.

Defined results: a null url, or one without ://, has an empty host and path and no rule, and is judged by the trees
on those empty parts; without labels of both kinds the verdict is that of the majority, `allow` if there is none;
repeated rows and null ids each give their own row; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

MAX_LABELLED, TREES, DEPTH, PRIOR = 20_000, 20, 3, 10.0


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))

FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "labels", "longest_label", "has_port", "percent_escapes", "suffix_rate", "suffix_count", "top_rate")


def parts(urls: DataFrame, url_col: str) -> DataFrame:
    """urls with host and path."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({_sql(url_col)}, instr({_sql(url_col)}, '://') + 3)")).otherwise("")
    urls = urls.withColumn("_rest", rest).withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    host = F.translate("_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^[^?#]*", 0)
    return urls.withColumn("host", host).withColumn("path", path).drop("_rest", "_host")


def _sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def rule_of(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(text, action) of the longest rule that fits (host, path); null if none does."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        text, action = F.when(fits, r.text).otherwise(text), F.when(fits, r.action).otherwise(action)
    return text, action


def features(urls: DataFrame, url_col: str) -> DataFrame:
    """urls with the lexical features that need no labels, and the suffixes that carry statistics."""
    u = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    n = F.length(u)
    share = lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(u, "")), F.lit(0.0), lambda s, c: s - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    labels = F.split("host", r"\.")
    return urls.withColumns(
        {
            "length": n.cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.regexp_count("path", F.lit("/")).cast("double"),
            "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / F.greatest(n, F.lit(1)),
            "entropy": F.when(n > 0, entropy).otherwise(0.0),
            "parameters": F.regexp_count(u, F.lit("[?&][^=&#]+=")).cast("double"),
            "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "labels": F.size(labels).cast("double"),
            "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double"),
            "has_port": F.col("host").rlike(":[0-9]+$").cast("double"),
            "percent_escapes": F.regexp_count(u, F.lit("%")).cast("double"),
            "_suffix": F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 2), 3), "."),
            "_top": F.element_at(labels, -1),
        }
    )


def _counts(train: DataFrame, by: str) -> DataFrame:
    return train.groupBy(by).agg(F.sum("label").alias(f"{by}_bad"), F.count("*").cast("double").alias(f"{by}_seen"))


@dataclass
class UrlModel:
    """Trees and suffix statistics; trees is None if the labels were all alike, and constant then decides."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame
    tops: DataFrame
    overall: float
    constant: str

    def with_statistics(self, rows: DataFrame, own: Column | None = None) -> DataFrame:
        """rows with the suffix features; own: the row's own label, which its statistics then leave out."""
        rows = rows.join(self.suffixes, "_suffix", "left").join(self.tops, "_top", "left")
        less, one = (own, F.lit(1.0)) if own is not None else (F.lit(0.0), F.lit(0.0))

        def rate(by: str) -> Column:
            bad, seen = F.coalesce(f"{by}_bad", less), F.coalesce(f"{by}_seen", one)
            return (bad - less + PRIOR * self.overall) / (seen - one + PRIOR)

        return rows.withColumns({"suffix_rate": rate("_suffix"), "suffix_count": F.coalesce("_suffix_seen", one) - one, "top_rate": rate("_top")})

    def verdict(self, rows: DataFrame) -> DataFrame:
        """rows (as from features) with method_verdict."""
        if self.trees is None:
            return rows.withColumn("method_verdict", F.lit(self.constant))
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(self.with_statistics(rows))
        return self.trees.transform(rows).withColumn("method_verdict", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", max_labelled: int = MAX_LABELLED, trees: int = TREES, depth: int = DEPTH) -> UrlModel:
    """Fit on (url, label: 1 block, 0 allow); rows without a url or label are left out."""
    every = labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("label")).dropna()
    hosts = features(parts(every, "url"), "url")
    suffixes, tops = written(_counts(hosts, "_suffix"), "url-suffixes"), written(_counts(hosts, "_top"), "url-tops")
    seen, blocked = tops.agg(F.coalesce(F.sum("_top_seen"), F.lit(0.0)), F.coalesce(F.sum("_top_bad"), F.lit(0.0))).first()
    overall = blocked / seen if seen else 0.0
    rows = every.orderBy(F.xxhash64("url"), "url", "label").limit(max_labelled)
    rows = written(features(parts(rows, "url"), "url").coalesce(1), "url-training")
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    model = UrlModel(None, suffixes, tops, overall, "block" if overall > 0.5 else "allow")
    if 0 < bad < n:
        data = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(model.with_statistics(rows, F.col("label"))).select("_features", "label", "url")
        data = data.coalesce(1).sortWithinPartitions(F.xxhash64("url"), "url", "label")
        model.trees = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=7).fit(data)
    return model


def url_filter(urls: DataFrame, labelled: DataFrame, url_col: str = "url", label_col: str = "label", rules: tuple[Rule, ...] = RULES, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """urls with host, path, rule and verdict (allow or block): the rule's if one fits, else the trees'. Columns of urls with one of these names are replaced."""
    columns = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    model = train(labelled, url_col, label_col, max_labelled)
    rows = parts(urls.select([F.col(c).alias(f"in_{i}") for i, c in enumerate(columns)]), f"in_{columns.index(url_col)}")
    rows = model.verdict(features(rows, f"in_{columns.index(url_col)}"))
    text, action = rule_of(rules)
    return rows.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(columns)), "host", "path", text.alias("rule"), F.coalesce(action, F.col("method_verdict")).alias("verdict"))


#: Host words (between dots and hyphens) that mark an unwanted site.
MARKS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "win")


def marked(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, label) of all urls: 1 if a word of the host is one of MARKS, else 0."""
    words = F.split("host", "[.:-]")
    return parts(urls.select(F.col(url_col).alias("url")).dropna(), "url").select("url", F.arrays_overlap(words, F.array(*map(F.lit, MARKS))).cast("int").alias("label"))


def op3(spark, sf_dir: str) -> DataFrame:
    """No table labels urls (`labels` is about documents, and no column links them to pages): the marks label the pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, marked(pages)).select("page_id", "host", "path", "rule", "verdict")
