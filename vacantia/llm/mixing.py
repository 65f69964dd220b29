"""Mixing sources to target weights: budgets down a domain-language-source tree, then a token prefix of seeded epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import sized, written

LEVELS = ("domain", "lang", "source")
#: Hex digits of the order key that each histogram resolves, and histograms: 256 bins per leaf, then 256 in the last one.
DIGITS, HISTOGRAMS = 2, 3

TOKENS = r"[\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), TOKENS), "")).cast("long")


def _shares(nodes: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """`nodes` (weight, capacity, given: the parent's budget) with `budget`: the budget by weight, no node over its capacity.

    What a full node can't take goes to its siblings by their weights, and so on; it is filled in the order of capacity
    per weight: a node is full if the water level when it fills is within the budget. A parent never gets more than its
    children can hold, so a shortage stays among siblings before it reaches their ancestors.
    """
    by = [F.col("weight") <= 0, F.col("capacity") / F.when(F.col("weight") > 0, F.col("weight")), *order]
    before = Window.partitionBy(*parent).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*parent)
    out = nodes.withColumns({"_held": F.coalesce(F.sum("capacity").over(before), F.lit(0)), "_rest": F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    # The level at which a node is full, as tokens of the parent's budget.
    needs = F.col("_held") + F.try_divide(F.col("capacity").cast("double") * F.col("_rest"), F.col("weight"))
    out = out.withColumn("_full", (F.col("weight") > 0) & (needs <= F.col("given")))
    left = F.col("given") - F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(all_)
    open_ = F.sum(F.when(~F.col("_full"), F.col("weight")).otherwise(0)).over(all_)
    out = out.withColumns({"_left": left, "_exact": F.when(~F.col("_full") & (F.col("weight") > 0), F.try_divide(left.cast("double") * F.col("weight"), open_))})
    out = out.withColumn("_share", F.floor("_exact").cast("long"))
    # What flooring leaves over goes to the largest remainders.
    spare = F.col("_left") - F.sum("_share").over(all_)
    place = F.row_number().over(Window.partitionBy(*parent).orderBy((F.col("_exact") - F.col("_share")).desc_nulls_last(), *order))
    out = out.withColumns({"_spare": spare, "_place": place})
    share = F.col("_share") + F.when(F.col("_place") <= F.col("_spare"), 1).otherwise(0)
    budget = F.when(F.col("_full"), F.col("capacity")).when(F.col("weight") > 0, F.least("capacity", share)).otherwise(F.lit(0).cast("long"))
    return out.withColumn("budget", budget).drop("_held", "_rest", "_full", "_left", "_exact", "_share", "_spare", "_place")


def budgets(leaves: DataFrame, total: Column) -> DataFrame:
    """`leaves` (domain, lang, source, tokens, weight, capacity) with the token `budget` of each, at most its capacity.

    A leaf's weight is a whole number; an inner node's is the one given in domain_weight or lang_weight, where those columns
    are there and not null, else the sum of its leaves'. One window per level over the tree's nodes, which are few against
    the documents.
    """
    given = lambda c: F.coalesce(F.max(c), F.sum("weight")) if c in leaves.columns else F.sum("weight")
    d = leaves.groupBy("domain").agg(given("domain_weight").alias("weight"), F.sum("capacity").alias("capacity"))
    d = _shares(d.withColumn("given", total.cast("long")), [], ["domain"]).select("domain", F.col("budget").alias("given"))
    l = leaves.groupBy("domain", "lang").agg(given("lang_weight").alias("weight"), F.sum("capacity").alias("capacity")).join(d, "domain")
    l = _shares(l, ["domain"], ["lang"]).select("domain", "lang", F.col("budget").alias("given"))
    return _shares(leaves.join(l, ["domain", "lang"]), ["domain", "lang"], ["source"]).drop("given")


def keyed(docs: DataFrame, domain: Column, *more: Column) -> DataFrame:
    """doc_id, `_leaf` (domain, lang, source; null: empty name), `_n` tokens and the digest `_text` of each row of `docs`, and `more`."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    leaf = F.struct(F.coalesce(domain, F.lit("")).alias("domain"), name("lang").alias("lang"), name("source").alias("source"))
    return docs.select(F.col("doc_id").alias("doc_id"), leaf.alias("_leaf"), n_tokens(F.col("text")).alias("_n"), _digest().alias("_text"), *more)


def domain_of_source(groups: int = 4) -> Column:
    """The default domain of a source: its number modulo `groups`, as the given sources carry no domain of their own."""
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"(\d+)$", 1).try_cast("bigint")
    return F.concat(F.lit("domain"), (F.coalesce(number, F.lit(0)) % groups).cast("string"))


def leaf_plan(rows: DataFrame, share: float, epochs: int, power: float, weights: DataFrame | None = None) -> DataFrame:
    """Each leaf's tokens, weight, capacity and budget. rows: `_leaf`, `_n`.

    Weights: a table domain, lang, source, weight (whole numbers), or the leaf's tokens to the `power`, rounded. A row of the
    table without source weighs a language of its domain against the others, one without lang and source a domain. Leaves
    that the table lacks get 0, but below a weighed language or domain they get their default. The total is `share` of all
    tokens; a leaf can give its tokens `epochs` times.
    """
    sums = rows.groupBy("_leaf").agg(F.sum("_n").alias("tokens"), F.count("*").alias("docs")).select("_leaf.*", "tokens", "docs")
    flat = F.sqrt(F.col("tokens").cast("double")) if power == 0.5 else F.pow(F.col("tokens").cast("double"), F.lit(power))
    leaves = sums.withColumn("weight", F.round(flat * 1000).cast("long"))
    if weights is not None:
        own = lambda keys, name: weights.filter(" AND ".join(f"{c} IS {'NOT ' if c in keys else ''}NULL" for c in LEVELS)).groupBy(*keys).agg(F.sum(F.col("weight").cast("long")).alias(name))
        leaves = leaves.withColumnRenamed("weight", "_default")
        for k, name in ((1, "domain_weight"), (2, "lang_weight"), (3, "weight")):
            leaves = leaves.join(own(LEVELS[:k], name), list(LEVELS[:k]), "left")
        above = F.col("domain_weight").isNotNull() | F.col("lang_weight").isNotNull()
        leaves = leaves.withColumn("weight", F.coalesce("weight", F.when(above, F.col("_default")).otherwise(0))).drop("_default")
    leaves = written(leaves.withColumn("capacity", F.col("tokens") * epochs), "leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    plan = budgets(leaves, F.lit(int(total * share)))
    return written(plan.withColumns({"full_epochs": F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0), "rest": F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0)}), "leaf-plan")


def _prefix(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """leaf, key bound: rows (`_leaf`, `_key`, `_n`) of a leaf's last epoch are taken up to and without the key `stop`.

    Histograms by the key's leading digits find the bin in which the budget ends; only that bin's rows are put in
    order. Every sum is pre-aggregated, so no task ever holds the rows of a leaf.
    """
    leaf = [F.col("_leaf")[c].alias(c) for c in LEVELS]
    rest = plan.filter("rest > 0").select(F.struct(*LEVELS).alias("_leaf"), "rest")
    at = rest.withColumns({"_at": F.lit(""), "_left": F.col("rest")}).drop("rest")
    for level in range(1, HISTOGRAMS + 1):
        bins = rows.withColumn("_at", F.substring("_key", 1, DIGITS * (level - 1))).join(sized(at), ["_leaf", "_at"])
        bins = bins.groupBy("_leaf", "_left", F.substring("_key", 1, DIGITS * level).alias("_at")).agg(F.sum("_n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("_leaf").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
        over = bins.withColumn("upto", upto).filter("upto > _left")
        at = written(over.groupBy("_leaf").agg(F.min_by(F.struct("_at", (F.col("_left") - F.col("upto") + F.col("n")).alias("_left")), "_at").alias("x")).select("_leaf", "x.*"), "prefix-bins")
    order = Window.partitionBy("_leaf").orderBy("_key").rangeBetween(Window.unboundedPreceding, 0)
    last = rows.withColumn("_at", F.substring("_key", 1, HISTOGRAMS * DIGITS)).join(sized(at), ["_leaf", "_at"])
    stop = last.withColumn("upto", F.sum("_n").over(order)).filter("upto > _left").groupBy("_leaf").agg(F.min("_key").alias("stop"))
    return stop.select(*leaf, "stop")


def _placed(text: Column, seed: int) -> Column:
    """The place of a row in its leaf's last epoch: 32 hex digits, by doc_id and text digest."""
    parts = (F.lit(str(seed)), F.col("_full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def _digest() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def _copies(rows: DataFrame, slim: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """`rows` (as `keyed`) with `_budget` and `_copies`."""
    small = sized(plan.select(F.struct(*LEVELS).alias("_leaf"), F.col("full_epochs").alias("_full"), F.col("rest").alias("_rest"), F.col("budget").alias("_budget")))
    order = slim.join(small, "_leaf").filter("_rest > 0").select("_leaf", "_n", _placed(F.col("_text"), seed).alias("_key"))
    stop = written(_prefix(order, plan).select(F.struct(*LEVELS).alias("_leaf"), F.col("stop").alias("_stop")), "prefix-ends")
    out = rows.join(small, "_leaf").join(sized(stop), "_leaf", "left")
    extra = (F.col("_rest") > 0) & (_placed(F.col("_text"), seed) < F.col("_stop"))
    return out.withColumn("_copies", (F.col("_full") + F.coalesce(extra, F.lit(False)).cast("int")).cast("int"))


def _mix(docs: DataFrame, share: float, epochs: int, power: float, seed: int, weights: DataFrame | None, domain: Column | None):
    domain = domain_of_source() if domain is None else domain
    slim = written(keyed(docs, domain), "leaf-rows")
    return domain, slim, leaf_plan(slim, share, epochs, power, weights)


def mix_table(docs: DataFrame, share: float = 0.9, epochs: int = 4, power: float = 0.5, seed: int = 11, weights: DataFrame | None = None, domain: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, budget (of the leaf) and copies: how often the mix takes the row.

    A leaf gives its full epochs to every row, and one more to the rows whose tokens, in the seeded order of the next
    epoch, add up to no more than what remains. Rows that are equal in doc_id and text have the same place and are
    taken together or not at all. `docs` has doc_id and text, and lang and source where known; other columns aren't
    read. Null names form a leaf of their own. Texts without words cost nothing and go with their leaf's prefix. Each
    row gives a row, also with copies 0; an empty table gives no rows.
    """
    _, slim, plan = _mix(docs, share, epochs, power, seed, weights, domain)
    out = _copies(slim, slim, plan, seed)
    return out.select("doc_id", "_leaf.*", F.col("_n").alias("n_tokens"), F.col("_budget").alias("budget"), F.col("_copies").alias("copies"))


def mixed_documents(docs: DataFrame, share: float = 0.95, epochs: int = 1, power: float = 0.5, seed: int = 11, weights: DataFrame | None = None, domain: Column | None = None) -> DataFrame:
    """The rows of `docs`, with its own columns, as often as the mix takes them; see `mix_table`."""
    domain, slim, plan = _mix(docs, share, epochs, power, seed, weights, domain)
    rows = keyed(docs, domain, F.struct(*docs.columns).alias("row"))
    out = _copies(rows, slim, plan, seed).filter("_copies > 0")
    if epochs > 1:
        out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select("row.*")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, 'domain' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '(\d+)$', 1) AS BIGINT), 0) % 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n, md5(coalesce(text, '')) AS digest
  FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS tokens, CAST(round(sqrt(CAST(sum(n) AS DOUBLE)) * 1000) AS BIGINT) AS weight, CAST(sum(n) AS BIGINT) * 4 AS capacity FROM w GROUP BY ALL),
d0 AS (SELECT domain, sum(weight) AS weight, sum(capacity) AS capacity, (SELECT floor(sum(tokens) * 0.9::DOUBLE) FROM leaf) AS given FROM leaf GROUP BY domain),
""" + "".join(
    f"""{n}1 AS (SELECT *, coalesce(sum(capacity) OVER p, 0) AS held, sum(weight) OVER (PARTITION BY {part}) - coalesce(sum(weight) OVER p, 0) AS rest FROM {n}0
  WINDOW p AS (PARTITION BY {part} ORDER BY weight <= 0, CAST(capacity AS DOUBLE) / nullif(weight, 0), {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{n}2 AS (SELECT *, coalesce(weight > 0 AND held + CAST(capacity AS DOUBLE) * rest / nullif(weight, 0) <= given, false) AS is_full FROM {n}1),
{n}3 AS (SELECT *, given - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER (PARTITION BY {part}) AS remaining,
  sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {part}) AS open_weight FROM {n}2),
{n}4 AS (SELECT *, CASE WHEN NOT is_full AND weight > 0 THEN CAST(remaining AS DOUBLE) * weight / nullif(open_weight, 0) END AS exact FROM {n}3),
{n}5 AS (SELECT *, remaining - sum(floor(exact)) OVER (PARTITION BY {part}) AS spare, row_number() OVER (PARTITION BY {part} ORDER BY exact - floor(exact) DESC NULLS LAST, {own}) AS place FROM {n}4),
{n} AS (SELECT * EXCLUDE (given), CASE WHEN is_full THEN capacity WHEN weight > 0 THEN least(capacity, floor(exact) + CASE WHEN place <= spare THEN 1 ELSE 0 END) ELSE 0 END AS budget FROM {n}5),
{after}"""
    for n, part, own, after in (
        ("d", "1", "domain", "l0 AS (SELECT leaf.domain, leaf.lang, sum(leaf.weight) AS weight, sum(leaf.capacity) AS capacity, min(d.budget) AS given FROM leaf JOIN d ON leaf.domain = d.domain GROUP BY leaf.domain, leaf.lang),\n"),
        ("l", "domain", "lang", "s0 AS (SELECT leaf.*, l.budget AS given FROM leaf JOIN l ON leaf.domain = l.domain AND leaf.lang = l.lang),\n"),
        ("s", "domain, lang", "source", ""),
    )
) + r"""plan AS (SELECT domain, lang, source, CAST(budget AS BIGINT) AS budget, CASE WHEN tokens > 0 THEN CAST(budget AS BIGINT) // tokens ELSE 0 END AS full_epochs, CASE WHEN tokens > 0 THEN CAST(budget AS BIGINT) % tokens ELSE 0 END AS rest FROM s),
k AS (SELECT w.*, budget, full_epochs, rest, md5('11|' || full_epochs || '|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || digest) AS k FROM w JOIN plan ON w.domain = plan.domain AND w.lang = plan.lang AND w.source = plan.source),
c AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k)
SELECT doc_id, domain, lang, source, n AS n_tokens, budget, CAST(full_epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies FROM c
"""
