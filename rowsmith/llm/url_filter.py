"""URL filter: explicit rules first, gradient-boosted trees on lexical features for all other URLs."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Words of hosts that label a URL as one to be blocked, where no labels are given. Fixed values.
SEEDS = ("ads", "adserver", "bet", "bets", "betting", "casino", "cheap", "crack", "escort", "free", "gambling", "jackpot", "keygen", "loan", "loans", "pills", "pharmacy", "poker", "porn", "replica", "slots", "track", "tracker", "viagra", "warez", "win", "xxx")
#: Labelled URLs that the trees are trained on, at most about so many, by the hash of the URL.
SAMPLE = 20_000
#: Folds that labelled URLs are in while the trees are trained.
FOLDS = 5
#: Suffixes and first path parts, fewer than so many of each, whose statistics are broadcast; the others are joined.
HOT = 1000
FEATURES = ["length", "depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens", "secure", "last_part_length", "suffix_rate", "part_rate"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path. Null url, or one without ://: both empty."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")).withColumn("rest", rest)
    p = p.withColumn("raw_host", F.regexp_extract("rest", r"\A[^/?#]*", 0))
    return p.select("page_id", "url", F.translate("raw_host", UPPER, LOWER).alias("host"), F.regexp_extract(F.expr("substring(rest, length(raw_host) + 1)"), r"\A[^?#]*", 0).alias("path"))


def ruled(pages: DataFrame) -> DataFrame:
    """parsed() with the longest fitting rule, and its verdict; null where none fits."""
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path) for _, host, path in rules]
    name = verdict = F.lit(None).cast("string")
    for fit, (v, host, path) in reversed(list(zip(fits, rules))):
        name, verdict = F.when(fit, F.lit(host + path)).otherwise(name), F.when(fit, F.lit(v)).otherwise(verdict)
    return parsed(pages).select("*", name.alias("rule"), verdict.alias("given"))


def _entropy(s: Column) -> Column:
    """Bits a character: from the lengths of the string without each of its distinct characters."""
    chars = F.filter(F.array_distinct(F.split(s, "")), lambda c: c != "")
    n = F.length(s).cast("double")
    share = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    return F.coalesce(F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c))), F.lit(0.0))


def _lexical(urls: DataFrame) -> DataFrame:
    u, host, path = F.col("url"), F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"\?[^#]*", 0)
    return urls.select(
        "*", F.length(u).cast("double").alias("length"), F.size(F.split(path, "/")).cast("double").alias("depth"),
        (F.length(F.regexp_replace(u, "[^0-9]", "")) / F.greatest(F.length(u), F.lit(1))).alias("digit_ratio"), _entropy(u).alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("parameters"), F.size(F.split(host, r"\.")).cast("double").alias("labels"),
        (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double").alias("hyphens"), u.startswith("https").cast("double").alias("secure"),
        F.length(F.element_at(F.split(path, "/"), -1)).cast("double").alias("last_part_length"), F.element_at(F.split(host, r"\."), -1).alias("suffix"), F.coalesce(F.get(F.split(path, "/"), F.lit(1)), F.lit("")).alias("part"),
    )


def _rates(labelled: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Labelled and blocked URLs by suffix or first path part: of the most frequent keys, and of all others."""
    counts = written(labelled.groupBy(key).agg(F.count("*").alias("n"), F.sum("label").alias("blocked")), f"{key}-rates")
    top = counts.orderBy(F.desc("n"), key).limit(HOT).agg(F.count("*").alias("rows"), F.min("n").alias("least")).first()
    # Where there are HOT keys or more, those no more frequent than the last of them are joined.
    least = top["least"] if top["rows"] == HOT else 0
    return counts.where(F.col("n") > least), counts.where(F.col("n") <= least)


def fold_of(url: str = "url") -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDS))


def _with_rates(urls: DataFrame, rates: list[tuple[str, DataFrame, DataFrame]], labelled: DataFrame | None = None) -> DataFrame:
    """urls with the smoothed share of blocked URLs by each key, 0.5 for one without labelled URLs.

    With labelled, urls are some of those that the rates count: each then has the rates of the other
    folds alone, so that no URL's own label is in its rates.
    """
    for key, hot, others in rates:
        urls = urls.join(F.broadcast(hot), key, "left")
        # Rows of hot keys have theirs; dealt by their URLs, they do not meet in one task.
        rest = others.select(F.col(key).alias("_key"), F.lit(0).cast("long").alias("_deal"), F.col("n").alias("_n"), F.col("blocked").alias("_blocked"))
        urls = urls.withColumn("_k", F.when(F.col("n").isNull(), F.col(key))).withColumn("_d", F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.xxhash64("url")))
        urls = urls.join(rest, (F.col("_k") == F.col("_key")) & (F.col("_d") == F.col("_deal")), "left")
        n, blocked = F.coalesce("n", "_n", F.lit(0)), F.coalesce("blocked", "_blocked", F.lit(0.0))
        if labelled is not None:
            fold = labelled.groupBy(F.col(key).alias("_key2"), fold_of().alias("_fold")).agg(F.count("*").alias("_own"), F.sum("label").alias("_own_blocked"))
            urls = urls.join(fold, (F.col(key) == F.col("_key2")) & (fold_of() == F.col("_fold")), "left")
            n, blocked = n - F.coalesce("_own", F.lit(0)), blocked - F.coalesce("_own_blocked", F.lit(0.0))
        urls = urls.withColumn(f"{key}_rate", (blocked + 1) / (n + 2)).drop("n", "blocked", "_k", "_d", "_key", "_deal", "_n", "_blocked", "_key2", "_fold", "_own", "_own_blocked")
    return urls


class Filter:
    """Trees trained from labelled URLs, and the statistics that their features need."""

    def __init__(self, labelled: DataFrame, most: int = SAMPLE):
        """labelled: url, host, path and label (1.0: to be blocked). Both labels have to occur."""
        features = _lexical(labelled)
        self.rates = [(k, *_rates(features, k)) for k in ("suffix", "part")]
        n = max(1, labelled.count())
        sample = features.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(min(1.0, most / n) * (1 << 30)))
        self.assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        train = written(_with_rates(sample.repartition(4, "url"), self.rates, features).select("label", *FEATURES), "urls")
        # Both labels weigh alike, however rare one of them is.
        share = train.agg(F.avg("label").alias("x")).first()["x"] or 0.0
        train = train.withColumn("weight", F.when(F.col("label") == 1, 0.5 / max(share, 1e-6)).otherwise(0.5 / max(1 - share, 1e-6)))
        self.model = GBTClassifier(maxIter=12, maxDepth=3, seed=11, featuresCol="features", labelCol="label", weightCol="weight").fit(self.assembler.transform(train))

    def judged(self, urls: DataFrame) -> DataFrame:
        """urls with the likelihood that they are to be blocked."""
        from pyspark.ml.functions import vector_to_array

        x = self.assembler.transform(_with_rates(_lexical(urls), self.rates))
        return self.model.transform(x).withColumn("blocked_likelihood", vector_to_array("probability")[1])


def seeded(urls: DataFrame) -> DataFrame:
    """urls with label: 1.0 where a word of the host is one of SEEDS, else 0.0.

    Weak labels: hosts of unwanted kinds often say so. The trees see no words, only the lexical features,
    and so judge hosts that name themselves otherwise by their likeness to these.
    """
    words = F.split(F.col("host"), "[^a-z0-9]+")
    return urls.withColumn("label", F.arrays_overlap(words, F.array(*map(F.lit, SEEDS))).cast("double"))


def verdicts(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict. labelled: url and label (1.0: to be blocked), else seeded() pages.

    If there are no labels of both kinds, URLs without a rule are allowed. Every row is judged by its url
    alone; rows with one page_id, or none, give a row each.
    """
    urls = ruled(pages)
    own = seeded(urls) if labelled is None else parsed(labelled.select(F.lit(None).cast("long").alias("page_id"), "url")).join(labelled.groupBy("url").agg(F.max("label").alias("label")), "url")
    own = own.where("url <> ''").select("url", "host", "path", "label")
    kinds = {r["label"] for r in own.select("label").distinct().collect()}  # two rows at most
    if len(kinds) < 2:
        return urls.select("page_id", "host", "path", "rule", F.coalesce("given", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("blocked_likelihood"))
    j = Filter(own).judged(urls)
    return j.select("page_id", "host", "path", "rule", F.coalesce("given", F.when(F.col("blocked_likelihood") >= 0.5, "block").otherwise("allow")).alias("verdict"), "blocked_likelihood")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "pages"))
