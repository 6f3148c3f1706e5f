"""URL filtering by listed rules and mined association rules, with DataFrame functions and Spark's FP-growth only.

Listed rules come first: a rule fits its host and all subdomains where the URL's path starts with the rule's, and the
longest wins. All other URLs are judged by mined rules: FP-growth finds combinations of URL tokens that go with the
label "bad"; a combination becomes a rule if its support and confidence suffice, its gain over the share of bad ones
does too (the lift, or a confidence halfway from that share to 1, which no share rules out), and no part of it is as sure. A URL is matched by an inverted index from each rule's rarest token.

Defined results: null URLs and URLs without ``://`` have an empty host and path, no tokens but one that says so, and are
allowed unless a mined rule says otherwise; without labels, or if all are bad, nothing is mined; repeated rows get a row each; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, session, written

#: (verdict, host, path)
LISTED = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SUPPORT, CONFIDENCE, LIFT = 0.002, 0.6, 1.5
#: A combination says nothing if fewer labelled bad URLs than this have it.
LEAST_ROWS = 20
BAD = "label=bad"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Scheme, words of the host, path segments (digits as 0), query keys, whether there is a fragment or a last slash.

    A host is the combination of its words: a token for it as a whole would only double every combination that it is in.
    """
    path = path_of(url)
    words = F.transform(F.regexp_extract_all(host_of(url), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)), lambda x: F.concat(F.lit("word="), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]", "0")))
    query = F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&")
    keys = F.transform(F.filter(F.transform(query, lambda x: F.substring_index(x, "=", 1)), lambda x: x != ""), lambda x: F.concat(F.lit("query="), x))
    rest = F.array(F.concat(F.lit("scheme="), ascii_lower(F.regexp_extract(url, r"^([^:/?#]*)://", 1))), F.when(F.contains(url, F.lit("#")), F.lit("fragment")), F.when(F.regexp_like(path, F.lit("/$")), F.lit("slash")))
    found = F.array_distinct(F.concat(words, parts, keys, F.filter(rest, lambda x: x.isNotNull())))
    return F.when(F.contains(F.coalesce(url, F.lit("")), F.lit("://")), found).otherwise(F.array(F.lit("no url")))


def document_of(url: Column) -> Column:
    """The number that a URL's path ends in, with or without a suffix or slash: the document that the page holds."""
    return F.regexp_extract(path_of(url), r"/(\d+)(?:\.\w+)?/?$", 1).try_cast("long")


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest listed rule that fits (of equal length, the first)."""
    rule = verdict = None
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, least: int = LEAST_ROWS) -> DataFrame:
    """(rule, tokens, confidence, support) from rows (tokens, bad): sure enough, and surer than each of their parts."""
    labelled = written(labelled, "url-labelled")
    n, bad = labelled.agg(F.count("*"), F.count_if("bad")).first()
    empty = labelled.sparkSession.createDataFrame([], "rule long, tokens array<string>, confidence double, support double")
    if not n or bad == n:  # where all are bad nothing is surer than the share
        return empty
    common = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= max(least, support * n))
    # a token that nearly all URLs have parts nothing; of others there are at most a URL's tokens / support, however many rows
    common = [r.token for r in common.where(F.col("count") <= 0.95 * n).select("token").orderBy("token").collect()]
    if not common:
        return empty
    none = F.array().cast("array<string>")
    baskets = labelled.select(F.concat(F.array_intersect("tokens", F.array(*map(F.lit, common))), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(none)).alias("items")).where(F.size("items") > 0)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / n)), minConfidence=confidence).fit(baskets)
    sure = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD) & ((F.col("lift") >= lift) | (F.col("confidence") >= (1 + bad / n) / 2)))
    sure = written(sure.select(F.xxhash64(F.sort_array("antecedent")).alias("rule"), F.sort_array("antecedent").alias("tokens"), "confidence", "support"), "url-rules")
    # pruned by parts: a rule goes if a rule over fewer of its tokens is as sure
    part = sure.select(F.col("tokens").alias("t"), F.col("confidence").alias("c"), F.element_at("tokens", 1).alias("key"))
    within = sure.select("rule", "tokens", "confidence", F.explode("tokens").alias("key")).join(part, "key").where((F.size("t") < F.size("tokens")) & (F.size(F.array_intersect("t", "tokens")) == F.size("t")) & (F.col("c") >= F.col("confidence")))
    return written(sure.join(within.select("rule").distinct(), "rule", "left_anti"), "url-pruned")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = LISTED, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST_ROWS, lift: float = LIFT, doc: Column | None = None) -> DataFrame:
    """A row a row of ``pages``: id, host, path, rule, verdict, mined (the tokens of the surest mined rule that fits, if one decided).

    A page's labels are the rows of ``labels`` with the document that it stands for, ``doc`` (its id by default); it is
    bad if one of them has quality 0 or toxic 1.
    """
    session(pages)
    # a null URL says what an empty one does
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(url_col, F.lit("")).alias("url"), (F.col(id_col) if doc is None else doc).alias("doc"))
    known = labels.select(F.col(label_id).alias("doc"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).where("doc is not null and bad is not null").groupBy("doc").agg(F.max("bad").alias("bad"))
    mined = mine(rows.join(known, "doc").select(tokens_of(F.col("url")).alias("tokens"), "bad"), support, confidence, lift, least)
    # each URL is judged once, however many pages have it
    urls = rows.select("url").distinct().withColumn("tokens", tokens_of(F.col("url")))
    counts = rows.select("url").distinct().select(F.explode(tokens_of(F.col("url"))).alias("token")).join(mined.select(F.explode("tokens").alias("token")).distinct(), "token").groupBy("token").count()
    index = mined.select("rule", "tokens", "confidence", F.explode("tokens").alias("token")).join(counts, "token").groupBy("rule").agg(F.min(F.struct("count", "token"))["token"].alias("token"), F.first("tokens").alias("needs"), F.first("confidence").alias("sure"))
    hits = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_intersect("tokens", "needs")) == F.size("needs"))
    judged = hits.groupBy(F.col("url").alias("hit_url")).agg(F.max(F.struct("sure", "needs"))["needs"].alias("needs"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    out = rows.join(judged, F.col("url") == F.col("hit_url"), "left").select("id", host.alias("host"), path.alias("path"), "needs")
    out = out.select("id", "host", "path", rule.alias("rule"), verdict.alias("listed"), "needs")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("listed", F.when(F.col("needs").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.when(F.col("listed").isNull(), F.array_join("needs", " ")).alias("mined"))
