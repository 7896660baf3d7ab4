"""URL filter: rules on hosts and paths first, then the likelihood ratio of two character language models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.shared import forget, stored, table

#: (verdict, rule): host, then path. A rule fits its host and all subdomains if the path starts with the rule's path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Characters of a window: seven of context and the one predicted. Signs are the characters as they are, so the model grows
#: with the URLs and is joined by shuffle.
ORDER = 8
#: Stands before and after a URL; a control character, which no valid URL has.
EDGE = "\x02"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first :// up to /, ? or #, A-Z lower-cased. Path: from there up to ? or #. Null or no ://: both empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def windows(url: Column) -> Column:
    """The windows of ORDER signs that end at each sign of a URL and at its end edge; scheme and host are lower-cased."""
    url = F.coalesce(url, F.lit(""))
    head = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    text = F.concat(F.lit(EDGE * (ORDER - 1)), F.lower(head), F.substring(url, F.length(head) + 1, F.length(url)), F.lit(EDGE))
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{ORDER}}}))."), 1)  # the last dot steps over whole code points


def ratios(grams: DataFrame, order: int = 4, signs: int = 32) -> DataFrame:
    """(gram, llr): log of P(sign | context) under accepted URLs over the same under rejected ones, in millionths.

    Witten-Bell smoothing: a context h with n(h) signs, T(h) of them distinct, gives (n(hc) + T(h) P'(c)) / (n(h) + T(h)),
    where P' is that of the context shortened by one; a context never seen gives P' itself. The shortest, without context,
    is smoothed by one for each of the signs. grams: (gram, accepted, rejected) for every window of order signs of the corpus.

    Each length is joined to the one before it by its last signs, so a key has at most as many rows as there are signs.
    """
    labels, level = ("accepted", "rejected"), None
    for k in range(1, order + 1):
        near = W.partitionBy(F.expr(f"left(gram, {k - 1})"))
        counts = grams.groupBy(F.expr(f"right(gram, {k})").alias("gram")).agg(*[F.sum(c).alias(c) for c in labels])
        counts = counts.select("gram", *[x for c in labels for x in (F.col(c), F.sum(c).over(near).alias(f"{c}_all"), F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).over(near).alias(f"{c}_kinds"))])
        if level is None:
            level = counts.select("gram", *[((F.col(c) + 1) / (F.col(f"{c}_all") + signs)).alias(f"{c}_p") for c in labels])
            continue
        shorter = level.select(F.col("gram").alias("last"), *[f"{c}_p" for c in labels])
        both = counts.withColumn("last", F.expr(f"right(gram, {k - 1})")).join(shorter, "last")
        p = lambda c: F.when(F.col(f"{c}_all") > 0, (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_p")) / (F.col(f"{c}_all") + F.col(f"{c}_kinds"))).otherwise(F.col(f"{c}_p")).alias(f"{c}_p")
        level = both.select("gram", *[p(c) for c in labels])
    return level.select("gram", F.round((F.log("accepted_p") - F.log("rejected_p")) * 1e6).cast("long").alias("llr"))


def calibrated(scored: DataFrame) -> float:
    """The threshold, on a grid of hundredths, where labelled URLs of the held-out fold are best told apart.

    Best: the largest sum of the shares of both that are judged right; ties go to the threshold nearest 0, then the lower
    one. Without held-out URLs of both kinds: 0.
    """
    bins = scored.filter("held AND label IS NOT NULL").groupBy(F.floor(F.col("score") * 100).alias("b")).agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("r"))
    # the logs of P are at least ORDER times those of 1 / (all + signs), so the grid has some ten thousands of bins at most
    upto, every = W.orderBy("b").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    found = (
        bins.select("b", F.coalesce(F.sum("r").over(upto), F.lit(0)).alias("below"), F.sum("a").over(every).alias("as"), F.sum("r").over(every).alias("rs"), F.coalesce(F.sum("a").over(upto), F.lit(0)).alias("lost"))
        .filter("as > 0 AND rs > 0")
        .orderBy(-(F.col("below") / F.col("rs") - F.col("lost") / F.col("as")), F.abs("b"), "b")
        .select("b")
        .first()
    )
    return found[0] / 100 if found else 0.0


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, label_col: str | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, held_out), one row per input row.

    The models learn from labelled URLs: by label_col (1 accepted, 0 rejected, anything else none) if it is given, else a
    URL that a rule allows is accepted, one that a rule blocks is rejected, and those without a rule have no label. No list
    of words takes part. Of the labelled URLs a fifth, by crc32 of the URL, only calibrates the threshold. Every window of
    every URL is scored, those seen under no label by their shorter contexts. score is the mean log-likelihood difference
    per sign; a URL without rule is allowed if it reaches the threshold. Null and empty URLs have an empty host and path
    and are scored as an empty string. Without labels all scores are 0 and all URLs without rule are allowed. Repeated rows
    give repeated results, extra columns are ignored. Empty table: no rows.
    """
    url = F.col(f"`{url_col}`")
    host, path = host_and_path(url)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = pages.select(F.col(f"`{id_col}`").alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"), (F.col(f"`{label_col}`") if label_col else F.lit(None)).cast("int").alias("given"))
    base = base.select("*", rule.alias("rule"), verdict.alias("said"), (F.crc32(F.coalesce("url", F.lit("")).cast("binary")) % 5 == 0).alias("held"))
    known = F.when(F.col("given").isin(0, 1), F.col("given")) if label_col else F.when(F.col("said") == "allow", 1).when(F.col("said") == "block", 0)
    urls = stored(base.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "held", known.alias("label")), "urls")
    spread = urls.select("row", "held", "label", F.explode(windows(F.col("url"))).alias("gram"))
    learns = ~F.col("held")
    grams = stored(spread.groupBy("gram").agg(*[F.sum(F.when(learns & (F.col("label") == v), 1).otherwise(0)).alias(c) for c, v in (("accepted", 1), ("rejected", 0))]), "grams")
    signs = grams.select(F.expr("right(gram, 1)")).distinct().count()
    model = stored(ratios(grams, ORDER, max(signs, 1)), "ratios")
    means = spread.select("row", "gram").join(model, "gram").groupBy("row").agg((F.sum("llr") / F.count("*") / 1e6).alias("score"))
    scored = stored(urls.join(means, "row").select("page_id", "url", "held", "label", "score"), "scores")
    least = calibrated(scored)
    forget(urls, grams, model)
    host, path = host_and_path(F.col("url"))
    out = scored.select("page_id", host.alias("host"), path.alias("path"), "score", "held")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= least, "allow").otherwise("block")).alias("verdict"), "score", F.col("held").alias("held_out"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))
