"""URL filter by association rules.

Fixed (host, path) rules judge first. For all other pages Spark's FP-growth
mines combinations of URL tokens that go with a label; rules with enough
support and confidence, and better than any of their parts, are matched
through an inverted index from token to rule.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedon.llm.graph import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) (fixed values).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Words of a host that label its pages as spam where no rule judges them (a seed list; any labels can be given instead).
SEEDS = ["adult", "ads", "bets", "casino", "pills", "spam"]
SUPPORT, CONFIDENCE = 0.002, 0.9
_LABEL = "label="


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what stands after the first '://' up to '/', '?' or '#', folded, and then up to '?' or '#'; both empty without '://'."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Sorted distinct tokens: words of the host, its last label, path segments (digits as '#'), query keys."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.split(host, r"[.-]"), lambda x: x != "")
    segments = F.filter(F.split(F.regexp_replace(path, r"\d+", "#"), "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^[^=]*", 0)), lambda x: x != "")
    tag = lambda a, t: F.transform(a, lambda x: F.concat(F.lit(t), x))
    top = F.when(F.size(labels) > 0, F.array(F.concat(F.lit("top:"), F.element_at(labels, -1)))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(tag(words, "word:"), top, tag(segments, "path:"), tag(keys, "query:"))))


def page_labels(pages: DataFrame, url_col: str = "url", seeds: list[str] = SEEDS, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(url, label) of the pages with a host: the fixed rule's verdict; without one, block if the host has a seed word, else allow."""
    host, path = split_url(F.col(url_col))
    seeded = F.arrays_overlap(F.split(host, r"[.-]"), F.array(*map(F.lit, seeds)))
    label = F.coalesce(fixed_rule(host, path, rules)[1], F.when(seeded, "block").otherwise("allow"))
    return pages.where(host != "").select(F.col(url_col).alias("url"), label.alias("label"))


def mine(labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule_id, tokens, verdict, confidence, support) mined from (url, label), for the verdict 'block'.

    Each distinct URL counts once for each of its labels. A rule of which a
    part is as confident is left out. All frequent tokens are mined; those that
    stand in the same URLs are mined as one, for two of them say no more than
    one, and stand for each other in the rules. Null URLs and labels, and URLs without a
    host, count for nothing; an empty table gives no rules.
    """
    host, path = split_url(F.col("url"))
    rows = labels.where((host != "") & F.col("label").isNotNull()).select("url", "label").distinct()
    schema = "rule_id long, tokens array<string>, verdict string, confidence double, support double"
    n = rows.count()
    if not n:
        return labels.sparkSession.createDataFrame([], schema)
    tokens = rows.select("url", "label", F.explode(url_tokens(host, path, F.col("url"))).alias("token"))
    # frequent tokens: as many as a URL has on average, over the support, at most
    mark = lambda *salt: F.sum(F.xxhash64(*salt, "url", "label").cast("decimal(38,0)"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), mark().alias("c"), mark(F.lit(1)).alias("d")).where(F.col("n") >= support * n)
    alike = durable(often.groupBy("n", "c", "d").agg(F.min("token").alias("token"), F.collect_set("token").alias("like")).select("token", "like"))
    mined = tokens.join(F.broadcast(alike.select("token")), "token").groupBy("url", "label").agg(F.collect_list("token").alias("mined"))
    items = rows.join(mined, ["url", "label"], "left").select(F.concat(F.coalesce("mined", F.array().cast("array<string>")), F.array(F.concat(F.lit(_LABEL), "label"))).alias("items"))
    items = durable(items)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(_LABEL + "block")))
    rules = durable(
        rules.where(~F.exists("antecedent", lambda x: x.startswith(_LABEL))).select(
            F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(_LABEL) + 1, 100).alias("verdict"), "confidence", "support"
        )
    )
    # a rule's parts with one token less
    parts = rules.withColumn("less", F.explode("tokens")).withColumn("part", F.array_remove("tokens", F.col("less"))).select("tokens", "verdict", "confidence", "part")
    whole = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("c"))
    worse = parts.join(whole, ["part", "verdict"]).where("c >= confidence").select("tokens", "verdict").distinct()
    kept = rules.join(worse, ["tokens", "verdict"], "left_anti")
    # each token of a rule may be any of those that it stands for
    each = kept.withColumn("token", F.explode("tokens")).join(F.broadcast(alike), "token").groupBy("tokens", "verdict", "confidence", "support").agg(F.collect_list("like").alias("likes"))
    every = F.aggregate("likes", F.array(F.array().cast("array<string>")), lambda sets, like: F.flatten(F.transform(sets, lambda t: F.transform(like, lambda x: F.concat(t, F.array(x))))))
    told = each.select(F.explode(every).alias("tokens"), "verdict", "confidence", "support").withColumn("tokens", F.array_sort("tokens"))
    return told.select(F.xxhash64("tokens", "verdict").alias("rule_id"), "tokens", "verdict", "confidence", "support")


def url_filter(pages: DataFrame, labels: DataFrame, page_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per row of ``pages``: (page_col, host, path, rule, verdict).

    A page without fixed rule is blocked if a mined rule for 'block' fits it
    and allowed otherwise. Null URLs and URLs without '://' have an empty host
    and path, which no rule fits. Repeated rows get equal verdicts. ``labels``
    (url, label) may be empty.
    """
    mined = mine(labels, support, confidence)
    index = mined.select("rule_id", F.explode("tokens").alias("token"), F.size("tokens").alias("size"), "verdict")
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(page_col).alias("_page"), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    text, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "_fixed": verdict, "_tokens": url_tokens(F.col("host"), F.col("path"), F.col("_url"))})
    # each set of tokens is looked up once, however many pages have it
    sets = rows.where("_fixed is null").select("_tokens").distinct()
    hits = sets.select("_tokens", F.explode("_tokens").alias("token")).join(index, "token")
    matched = hits.groupBy("_tokens", "rule_id", "size", "verdict").agg(F.count(F.lit(1)).alias("n")).where("n = size")
    best = matched.select("_tokens", F.col("verdict").alias("_mined")).distinct()
    return rows.join(best, "_tokens", "left").select(
        F.col("_page").alias(page_col), "host", "path", "rule", F.coalesce("_fixed", "_mined", F.lit("allow")).alias("verdict")
    )


