"""URL filters: explicit host and path rules, then association rules that FP-growth mines from labelled URLs.

Only DataFrame functions and Spark's own FP-growth.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import joined, sized, written


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: Least share of labelled URLs that hold a combination with the label, and least number of them; least confidence.
SUPPORT, LEAST, CONFIDENCE = 0.002, 20, 0.5

BAD = "label=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a URL; both empty for null or without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    tail = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(tail, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)


def explicit(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path in one) and its verdict; null without one. Of equal lengths the first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host) + len(r.path)):  # the last `when` is asked first
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, F.lit(r.host + r.path)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct sorted tokens: the host's labels and its last two and three together, words of the path, its ending, query keys."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    tail = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - (n - 1)), n), ".")
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    ending = F.regexp_extract(path, r"\.([A-Za-z]{1,5})$", 1)
    keys = F.regexp_extract_all(F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("")), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    parts = (
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
        F.when(F.size(labels) > 1, F.array(F.concat(F.lit("d:"), tail(2)))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(labels) > 2, F.array(F.concat(F.lit("s:"), tail(3)))).otherwise(F.array().cast("array<string>")),
        F.transform(steps, lambda x: F.concat(F.lit("p:"), x)),
        F.when(ending != "", F.array(F.concat(F.lit("e:"), ending))).otherwise(F.array().cast("array<string>")),
        F.transform(keys, lambda x: F.concat(F.lit("q:"), x)),
    )
    return F.array_sort(F.array_distinct(F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts))))


def mined(tokens: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """antecedent, confidence, lift, support of rules that imply a bad label (quality 0 or toxic 1).

    `tokens` (page_id, tokens) meets `labels` (doc_id, quality, toxic) by id; of several labels of an id, any bad one
    counts. A combination counts from `support` of all labelled URLs and from `least` of them, with the label. Rules that a
    part of their antecedent already implies with at least their confidence are dropped. Tokens that every URL has say
    nothing and are left out; of tokens that the same labelled URLs have the last by name stands for all, so that mining
    doesn't list every combination of them.
    """
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(bad).alias("bad"))
    rows = tokens.filter("page_id IS NOT NULL AND size(tokens) > 0").join(known, "page_id").select("tokens", "bad", F.monotonically_increasing_id().alias("u"))
    rows = written(rows, "labelled-urls")
    total = rows.count()
    if not total:
        return rows.sparkSession.createDataFrame([], "antecedent array<string>, confidence double, lift double, support double")
    support = max(support, least / total)
    same = (F.count("*").alias("n"), F.count_if("bad").alias("k"), F.bit_xor(F.xxhash64("u")).alias("x"), F.sum(F.xxhash64("u").bitwiseAND(F.lit((1 << 31) - 1))).alias("y"))
    single = rows.select(F.explode("tokens").alias("t"), "bad", "u").groupBy("t").agg(*same)
    useful = single.filter((F.col("k") >= support * total) & (F.col("n") < total)).groupBy("n", "k", "x", "y").agg(F.max("t").alias("t"))
    kept = rows.select("u", "bad", F.explode("tokens").alias("t")).join(sized(written(useful.select("t"), "url-tokens")), "t").groupBy("u", "bad").agg(F.collect_list("t").alias("items"))
    items = F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items"))
    one = F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))  # rows without a useful token count too
    kept = kept.select(items.alias("items")).unionByName(rows.join(kept.select("u"), "u", "left_anti").select(one.alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support), minConfidence=confidence).fit(kept)
    rules = model.associationRules.filter((F.size("consequent") == 1) & (F.get("consequent", F.lit(0)) == BAD))
    rules = written(rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "lift", "support"), "url-rules")
    less = rules.select(F.explode("antecedent").alias("t"), F.col("antecedent").alias("part"), F.col("confidence").alias("least"))
    more = rules.select(F.explode("antecedent").alias("t"), "antecedent", "confidence")
    worse = more.join(less, "t").filter("size(part) < size(antecedent) AND size(array_except(part, antecedent)) = 0 AND least >= confidence")
    return written(rules.join(worse.select("antecedent").distinct(), "antecedent", "left_anti"), "pruned-rules")


def matched(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens, association, confidence: the best rule whose tokens are all among the `tokens` of a distinct token set.

    An inverted index: each rule stands under its rarest token, so a row meets only the rules of its own tokens.
    """
    seen = rules.select(F.explode("antecedent").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    index = rules.withColumn("t", F.explode("antecedent")).join(seen, "t")
    index = index.groupBy("antecedent", "confidence").agg(F.min_by("t", F.struct("n", "t")).alias("t"))
    met = tokens.select("tokens", F.explode("tokens").alias("t")).join(sized(written(index, "rule-index")), "t")
    met = met.filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", F.array_join("antecedent", " ").alias("association")))
    return met.groupBy("tokens").agg(best.alias("b")).select("tokens", "b.*")


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """page_id, host, path, rule, verdict of each page, with the association rule and its confidence where one decided.

    An explicit rule fits its host and all subdomains if the path starts with its path; the longest wins. Else the
    page is blocked if a mined rule matches, and allowed if none does. `pages` has page_id and url, `labels` doc_id,
    quality and toxic; other columns aren't read. A null url or one without `://` has an empty host and path and no
    tokens, so it is allowed. Each row gives a row, repeated rows and null ids too. Without labels no rule is mined.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))
    rows = written(rows.select("page_id", "host", "path", "tokens"), "url-rows")
    kinds = rows.groupBy("tokens").agg(F.count("*").alias("n"))
    found = matched(kinds, mined(rows.select("page_id", "tokens"), labels, support, confidence, least)).join(kinds, "tokens")
    found = written(found, "matched-urls")
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    name, verdict = explicit(F.col("host"), F.col("path"), rules)
    out = joined(rows, found, ["tokens"], "left", total).select("page_id", "host", "path", name.alias("rule"), verdict.alias("v"), "association", "confidence")
    by_rule = F.col("v").isNotNull()
    own = F.when(F.col("association").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("v", own).alias("verdict"), *(F.when(~by_rule, F.col(c)).alias(c) for c in ("association", "confidence")))
