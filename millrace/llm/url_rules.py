"""URL filtering with mined association rules.

FP-growth finds token combinations that are frequent among labelled urls; rules whose
consequent is the *bad* label and that pass support and confidence become block rules.
Rules are matched through an inverted index: a rule is filed under its rarest token, a url
looks only at the rules filed under its own tokens and keeps those it contains.
Lists of hosts and paths given by hand take precedence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import col, written

BAD = "label:bad"
TOKEN_SPLIT = r"[^a-z0-9]+"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, with A-Z lower-cased; empty where there is none."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(F.instr(url, "://") > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def url_path(url: Column) -> Column:
    """From behind the host up to ``? #`` or the end; empty where there is no ``://``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, path).otherwise("")


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host (``h:``), words of the path (``p:``), digits dropped."""
    words = lambda text, mark: F.transform(
        F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda w: (w != "") & ~w.rlike("^[0-9]+$")),
        lambda w: F.concat(F.lit(mark), w))
    return F.array_distinct(F.concat(words(host, "h:"), words(path, "p:")))


def list_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting entry of a list of ``(verdict, host, path)`` as a struct, else null.

    An entry fits its host and all subdomains where the path starts with the entry's.  The
    list is written into the plan, so it is for short lists; of equal lengths the first wins.
    """
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fitting = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in ordered
    ]
    return F.coalesce(*fitting, F.lit(None).cast("struct<rule:string,verdict:string>"))


def token_classes(rows: DataFrame, least: float) -> DataFrame:
    """``token, name``: tokens that at least ``least`` of the rows ``rid, tokens`` hold, named by the first token of the same rows.

    Sets of rows are told apart by their size and two 64-bit sums of hashes.
    """
    held = rows.select("rid", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("y"))
    # frequent tokens are few: each stands for at least that many rows
    return held.filter(F.col("n") >= least).select(
        "token", F.min("token").over(Window.partitionBy("n", "x", "y")).alias("name"))


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Block rules ``rule_id, tokens, confidence, support`` from rows ``tokens array<string>, bad boolean``.

    ``min_support`` is the least share of all labelled urls that hold the tokens and are bad.
    Of a rule and a shorter one inside it that is at least as confident, only the shorter
    stays; rules have any length.  Tokens that the same labelled urls hold are mined as one, so
    a deep path is not mined in all its combinations, and a rule stands for each choice
    of them.  No labelled urls, or none bad, give no rules.
    """
    if not labelled.filter("bad").limit(1).count():
        none = F.lit(None).cast("double")
        return labelled.limit(0).select(F.xxhash64("tokens").alias("rule_id"), "tokens", none.alias("confidence"), none.alias("support"))
    rows = written(labelled.select("tokens", "bad", F.monotonically_increasing_id().alias("rid")), "labelled-urls")
    total = rows.count()
    classes = written(token_classes(rows, min_support * total), "token-classes")
    named = rows.select("rid", F.explode("tokens").alias("token")).join(classes, "token").groupBy("rid").agg(
        F.collect_set("name").alias("names"))
    names = F.coalesce("names", F.array().cast("array<string>"))
    baskets = rows.select("rid", "bad").join(named, "rid", "left").select(
        F.when(F.col("bad"), F.concat(names, F.array(F.lit(BAD)))).otherwise(names).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    mined = written(model.associationRules.filter(
        F.element_at("consequent", 1) == BAD
    ).select(F.array_sort("antecedent").alias("names"), "confidence", "support"), "mined-rules")
    members = classes.groupBy("name").agg(F.array_sort(F.collect_list("token")).alias("members"))
    choices = mined.select("names", "confidence", "support", F.explode("names").alias("name")).join(members, "name")
    choices = choices.groupBy("names", "confidence", "support").agg(F.collect_list("members").alias("choices"))
    none = F.array(F.array().cast("array<string>"))
    rules = choices.select("confidence", "support", F.explode(F.aggregate(
        "choices", none, lambda done, more: F.flatten(F.transform(
            done, lambda d: F.transform(more, lambda m: F.concat(d, F.array(m))))))).alias("tokens"))
    rules = rules.select(F.array_sort("tokens").alias("tokens"), "confidence", "support")
    # rules are few: each stands for at least min_support of the labelled urls
    rules = written(rules.withColumn("rule_id", F.xxhash64("tokens")), "url-rules")
    shorter = rules.select(
        F.col("tokens").alias("s_tokens"), F.col("confidence").alias("s_confidence"),
        F.explode("tokens").alias("_t"))
    longer = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("_t"))
    implied = longer.join(shorter, "_t").filter(
        (F.size("s_tokens") < F.size("tokens")) & (F.col("s_confidence") >= F.col("confidence"))
        & (F.size(F.array_except("s_tokens", "tokens")) == 0)
    ).select("rule_id").distinct()
    return rules.join(implied, "rule_id", "left_anti").select("rule_id", "tokens", "confidence", "support")


def inverted_index(rules: DataFrame, token_counts: DataFrame) -> DataFrame:
    """``token, rule_id, tokens, confidence``: every rule once, under its rarest token."""
    spread = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token"))
    rarest = Window.partitionBy("rule_id").orderBy(F.coalesce("n", F.lit(0)), "token")
    return (
        spread.join(token_counts, "token", "left").withColumn("_r", F.row_number().over(rarest))
        .filter("_r = 1").select("token", "rule_id", "tokens", "confidence")
    )


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]], min_support: float = 0.002,
    min_confidence: float = 0.6, id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, matched_tokens, confidence``.

    ``labels`` has ``page_id, bad``; a page with several labels is bad if one says so, pages
    without a label are only judged.  A url that is null or has no ``://`` has an empty host
    and path and no tokens, and is allowed.  The verdict is that of the longest fitting list
    entry, else ``block`` where a mined rule matches, else ``allow``.  Repeated pages are
    judged alike, one row each.
    """
    urls = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"))
    parts = urls.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    parts = parts.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    parts = parts.withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    known = labels.select(col("page_id"), col("bad")).filter("page_id IS NOT NULL AND bad IS NOT NULL")
    labelled = parts.join(known.groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id").select("tokens", "bad")
    mined = mine_rules(labelled, min_support, min_confidence)
    # only tokens that rules use are counted, so the counts are as few as the rules
    used = mined.select(F.explode("tokens").alias("token")).distinct()
    counts = parts.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    index = inverted_index(mined, counts.join(used, "token", "left_semi"))
    # urls of equal tokens are matched once, so a hot host costs one match
    kinds = parts.select("tokens").distinct()
    # written, so that the join below may split the urls of a hot host
    hits = written(
        kinds.withColumn("token", F.explode("tokens"))
        .join(index.withColumnRenamed("tokens", "needed"), "token")
        .filter(F.size(F.array_except("needed", "tokens")) == 0)
        .groupBy("tokens").agg(F.max(F.struct("confidence", "needed")).alias("hit")), "url-hits")
    listed = parts.withColumn("listed", list_rule(F.col("host"), F.col("path"), rules))
    return listed.join(hits, "tokens", "left").select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", F.when(F.col("hit").isNotNull(), F.lit("block")), F.lit("allow")).alias("verdict"),
        F.col("hit.needed").alias("matched_tokens"), F.col("hit.confidence").alias("confidence"))
