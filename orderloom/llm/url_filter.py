"""URL filter: fixed host and path rules, and rules mined from labelled URLs.

All of it is built-in Spark SQL and Spark ML. FP-growth finds token combinations that are
frequent among URLs labelled bad; each is kept if most of all labelled URLs with these tokens
are bad, by the lower end of a confidence interval. Tokens that occur in the same labelled URLs
say the same and are one item. Mined rules are indexed by their rarest item, so a URL meets
only rules whose rarest item it has.
"""

from __future__ import annotations

import string
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.session import staging_path

# The rules that hold whatever was mined, host and path against verdict.
RULES = {
    "net/": "block",
    "example.net/en/": "allow",
    "example.com/de/": "block",
    "org/fr/": "allow",
}
#: So many tokens of rules are sent to the tasks of the filter at most; with more, rules are joined.
VOCABULARY = 1000
NO_RULES = "rule_id bigint, items array<string>, anchor string, support bigint, confidence double"


def split_url(url: Column) -> dict[str, Column]:
    """``host``, A-Z lower-cased, and ``path``; both empty for null and without ``://``."""
    rest = F.when(
        F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url))
    ).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return {
        "host": F.translate(host, string.ascii_uppercase, string.ascii_lowercase),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    }


def fixed_rule(rules: Mapping[str, str]) -> Column:
    """The longest rule that fits columns ``host`` and ``path``, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        rule_host, slash, rest = rule.partition("/")
        fits = (F.col("host") == rule_host) | F.endswith("host", F.lit(f".{rule_host}"))
        found = F.when(fits & F.startswith("path", F.lit(slash + rest)), F.lit(rule)).otherwise(found)
    return found


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL, each marked with the part that it comes from.

    Scheme, host labels, path segments, file extension, query fields and fragment. Numbers
    in a path stand for one token. A null URL has none.
    """
    text = F.coalesce(url, F.lit(""))
    parts = split_url(url)

    def marked(mark: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(mark), v))

    segments = F.transform(
        F.split(F.regexp_replace(parts["path"], r"\.[A-Za-z0-9]{1,5}$", ""), "/", -1),
        lambda s: F.regexp_replace(s, r"^\d+$", "#"),
    )
    query = F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1)
    tokens = F.concat(
        marked("scheme:", F.array(F.regexp_extract(text, r"^([A-Za-z][\w+.-]*)://", 1))),
        marked("host:", F.split(parts["host"], r"\.", -1)),
        marked("path:", segments),
        marked("ext:", F.array(F.regexp_extract(parts["path"], r"\.([A-Za-z0-9]{1,5})$", 1))),
        marked("query:", F.split(query, "&", -1)),
        marked("fragment:", F.array(F.regexp_extract(text, r"#(.*)$", 1))),
    )
    return F.array_sort(F.array_distinct(tokens))


@dataclass(frozen=True)
class MinedRules:
    """``table`` has one row per rule; ``vocabulary`` are the tokens that rules use, or None if
    they are more than ``VOCABULARY``; ``members`` has the tokens of every item of a rule, any of
    which stands for it, or is None if each token is an item of its own."""

    table: DataFrame
    vocabulary: tuple[str, ...] | None
    members: DataFrame | None = None


def mine_rules(
    pages: DataFrame,
    labels: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    row_id: str = "doc_id",
    label: str = "quality",
    min_count: int = 5,
    min_confidence: float = 0.6,
    z: float = 1.96,
) -> MinedRules:
    """Token combinations that speak for a URL labelled 0.

    All labelled URLs count. ``min_count`` is the number of bad URLs that must hold the
    combination (all of them if there are fewer), whatever the number of bad URLs and of
    tokens. The share of bad ones among the labelled URLs that hold it is its confidence; the
    lower end of Wilson's interval around it, at ``z`` standard deviations, must reach
    ``min_confidence``: 6 bad URLs of 6 do (0.61), 5 of 6 (0.44) may be chance. A rule that adds
    items to another of at least its confidence is dropped. An item is a set of tokens that
    occur in the same labelled URLs, named by the first of them; one of them in a URL is enough.
    Pages without label, null ids and null labels are not learned from; no labels, no rules.
    """
    spark = pages.sparkSession
    one_each = (
        labels.where(F.col(row_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(row_id).alias("_id"))
        .agg((F.min(label) == 0).alias("_bad"))
    )
    rows = _stored(
        pages.select(F.col(page_id).alias("_id"), url_tokens(F.col(url)).alias("_tokens"))
        .join(one_each, "_id")
        .select("_tokens", "_bad"),
        "url-labelled",
    )
    # One row per distinct token set.
    labelled = _stored(
        rows.groupBy("_tokens").agg(F.count_if("_bad").alias("_bad"), F.count(F.lit(1)).alias("_rows")),
        "url-sets",
    )
    bad_rows = labelled.agg(F.coalesce(F.sum("_bad"), F.lit(0))).first()[0]
    if bad_rows == 0:
        return MinedRules(spark.createDataFrame([], NO_RULES), ())

    members = _stored(_items(labelled, min(min_count, bad_rows)), "url-items")
    labelled = _stored(_with_items(labelled, members), "url-sets")
    # Every bad URL is a transaction of its own; those of equal tokens are never put together.
    transactions = rows.where("_bad").select("_tokens").join(labelled, "_tokens").select("items")
    # FP-growth rounds share times rows up to a count; half a row less keeps that exact. The
    # rows with an item may be fewer than the bad ones.
    held = labelled.agg(F.sum("_bad")).first()[0] or 0
    if held == 0:
        return MinedRules(spark.createDataFrame([], NO_RULES), ())
    share = min(1.0, (min(min_count, bad_rows) - 0.5) / held)
    model = FPGrowth(itemsCol="items", minSupport=share).fit(transactions)
    sets = _stored(
        model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("support")),
        "url-itemsets",
    )

    # How common an item is among all labelled URLs decides where a rule is indexed.
    common = (
        labelled.select(F.explode("items").alias("item"), "_rows")
        .groupBy("item")
        .agg(F.sum("_rows").alias("uses"))
    )
    anchors = (
        sets.select("items", F.explode("items").alias("item"))
        .join(common, "item")
        .groupBy("items")
        .agg(F.min(F.struct("uses", "item"))["item"].alias("anchor"))
    )
    indexed = sets.join(anchors, "items")
    seen = (
        _matches(labelled.withColumnRenamed("items", "_items"), indexed.select("items", "anchor"))
        .groupBy("items")
        .agg(F.sum("_rows").alias("all_rows"))
    )
    scored = _stored(
        indexed.join(seen, "items")
        .withColumn("confidence", F.col("support") / F.col("all_rows"))
        .withColumn("_sure", wilson(F.col("support"), F.col("all_rows"), z) >= min_confidence),
        "url-scored",
    )
    rules = _stored(
        _without_redundant(scored).select(
            F.xxhash64("items").alias("rule_id"), "items", "anchor", "support", "confidence"
        ),
        "url-rules",
    )
    used = rules.select(F.explode("items").alias("item")).distinct()
    members = _stored(members.join(used, "item", "left_semi"), "url-items")
    words = sorted(r["token"] for r in members.select("token").limit(VOCABULARY + 1).collect())
    return MinedRules(rules, tuple(words) if len(words) <= VOCABULARY else None, members)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def wilson(hits: Column, tries: Column, z: float) -> Column:
    """Lower end of Wilson's interval around the share ``hits / tries``."""
    share, slack = hits / tries, z * z / tries
    spread = z * F.sqrt(share * (1 - share) / tries + slack / (4 * tries))
    return (share + slack / 2 - spread) / (1 + slack)


def _items(labelled: DataFrame, least: int) -> DataFrame:
    """``token, item`` of the tokens that ``least`` bad URLs have.

    Tokens are one item if they occur in the same token sets, which are known by their number
    and by 128 bits over all of them. The tokens of an item stand in one URL, so they are few.
    """
    tokens = (
        labelled.select(
            F.explode("_tokens").alias("token"), "_bad", "_rows",
            F.xxhash64("_tokens").alias("_a"), F.xxhash64("_tokens", F.lit("b")).alias("_b"),
        )
        .groupBy("token")
        .agg(
            F.sum("_bad").alias("_bad"), F.sum("_rows").alias("_rows"), F.count(F.lit(1)).alias("_sets"),
            F.bit_xor("_a").alias("_a"), F.bit_xor("_b").alias("_b"),
        )
        .where(F.col("_bad") >= least)
    )
    return tokens.groupBy("_bad", "_rows", "_sets", "_a", "_b").agg(
        F.array_sort(F.collect_list("token")).alias("_all")
    ).select(F.explode("_all").alias("token"), F.col("_all")[0].alias("item"))


def _with_items(sets: DataFrame, members: DataFrame) -> DataFrame:
    """Adds ``items``, those that the tokens of a row stand for; rows without one are left out."""
    found = (
        sets.select("_tokens", F.explode("_tokens").alias("token"))
        .join(members, "token")
        .groupBy("_tokens")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return sets.join(found, "_tokens")


def _matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of a row and a rule whose items are all in ``_items``, by the rule's rarest one."""
    return (
        rows.withColumn("anchor", F.explode("_items"))
        .join(rules, "anchor")
        .where(F.size(F.array_except("items", "_items")) == 0)
    )


def _without_redundant(scored: DataFrame) -> DataFrame:
    """The sure rules that no smaller, equally confident one makes needless.

    All subsets of a frequent set are frequent, so the best confidence inside a set is that of
    the sets with one item less and of what is inside those: one join of neighbouring sizes after
    the other, on whole sets, in place of a join of all with all.
    """
    sure = scored.where("_sure")
    longest = sure.agg(F.max(F.size("items"))).first()[0] or 0
    kept = sure.where(F.size("items") == 1)
    inside = scored.where(F.size("items") == 1).select("items", F.col("confidence").alias("_best"))
    for size in range(2, longest + 1):
        level = scored.where(F.size("items") == size)
        best = (
            level.select(
                F.col("items").alias("_items"),
                F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("items"),
            )
            .join(inside, "items")
            .groupBy(F.col("_items").alias("items"))
            .agg(F.max("_best").alias("_inside"))
        )
        level = _stored(level.join(best, "items"), "url-levels")
        kept = kept.unionByName(level.where("_sure AND confidence > _inside").drop("_inside"))
        inside = level.select("items", F.greatest("confidence", "_inside").alias("_best"))
    return kept


def filter_urls(
    pages: DataFrame,
    mined: MinedRules,
    rules: Mapping[str, str] = RULES,
    page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """Every page with ``host``, ``path``, ``rule``, ``verdict`` and the mined rule it meets.

    The longest fixed rule decides; else a mined rule blocks (``mined`` names the most
    confident one, ``confidence`` how sure it is); else the URL is allowed. A null URL and one
    without ``://`` have an empty host and path and meet no fixed rule. Repeated rows and
    null ids stay as they are; other columns are not read; an empty table gives none.
    """
    rows = pages.select(page_id, F.col(url).alias("_url")).withColumns(split_url(F.col("_url")))
    rows = rows.withColumn("rule", fixed_rule(rules))
    rows = rows.withColumn("_tokens", url_tokens(F.col("_url")))
    if mined.vocabulary is not None:
        # Only tokens that rules use are left, so distinct sets are few.
        known = F.array(*map(F.lit, mined.vocabulary)).cast("array<string>")
        rows = rows.withColumn("_tokens", F.array_intersect("_tokens", known))
    # Equal sets are matched once.
    sets = rows.select("_tokens").distinct()
    if mined.members is None:
        sets = sets.withColumn("items", F.col("_tokens"))
    else:
        sets = _with_items(sets, mined.members)
    found = (
        _matches(sets.withColumnRenamed("items", "_items"), mined.table)
        .groupBy("_tokens")
        .agg(F.max(F.struct("confidence", "support", "items")).alias("_best"))
    )
    chosen = F.coalesce(
        *[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()],
        F.when(F.col("_best").isNotNull(), F.lit("block")),
        F.lit("allow"),
    )
    return rows.join(found, "_tokens", "left").select(
        page_id, "host", "path", "rule", chosen.alias("verdict"),
        F.concat_ws(" & ", "_best.items").alias("mined"),
        F.col("_best.confidence").alias("confidence"),
    )
