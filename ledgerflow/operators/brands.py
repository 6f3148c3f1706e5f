"""Brands and merchant categories: containment, and fuzzy matching of distinct tokens with keywords."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.small import few, small
from ..functions.text import Parts, containing, jaro_winkler_col, similar_candidates, split_merchant


def brand_of(rows: DataFrame, brands: DataFrame, key: str = "msg_id", merchant: str = "merchant", body: str = "body") -> DataFrame:
    """Adds brand, brand_category and online: the first brand (token, brand, category, online, ord) whose token the merchant has, else the body.

    A dictionary of few bytes goes to all tasks, which look its tokens up in the texts where these are, so that no row is shuffled. With a larger
    one, different merchant texts and bodies look their tokens up in an index, once; both dictionary and texts may be of any size.
    """
    known = brands.select(F.lower("token").alias("token"), "brand", "category", "online", "ord")
    if few(known):
        # the first of equal tokens, and tokens in the order in which they win
        ranked = known.where(F.length("token") > 0).groupBy("token").agg(F.min(F.struct("ord", "brand", "category", "online")).alias("hit")).orderBy("hit", "token").select("token", "hit.brand", "hit.category", "hit.online")
        found = _first_hit(ranked)(F.lower(merchant), F.lower(body))
        return _with_hit(rows.select("*", found.alias("_hit")), rows.columns, F.col("_hit"))
    texts = rows.select(F.explode_outer(F.array(F.lower(merchant), F.lower(body))).alias("text")).where("text IS NOT NULL").distinct()
    hits = containing(texts, "text", known, "token").groupBy("text").agg(F.min(F.struct("ord", "brand", "category", "online")).alias("hit"))
    by_name, by_body = (hits.select(F.col("text").alias(f"_t{n}"), F.col("hit").alias(f"_{n}")) for n in ("name", "body"))
    out = rows.join(by_name, F.lower(merchant) == F.col("_tname"), "left").join(by_body, F.lower(body) == F.col("_tbody"), "left")
    return _with_hit(out, rows.columns, F.coalesce("_name", "_body"))


def _with_hit(rows: DataFrame, columns: list[str], hit: Column) -> DataFrame:
    return rows.select(*columns, hit["brand"].alias("brand"), hit["category"].alias("brand_category"), F.coalesce(hit["online"], F.lit(False)).alias("online"))


def _first_hit(ranked: DataFrame) -> Callable[[Column, Column], Column]:
    """A function of merchant and body: the row (brand, category, online) of the first of the tokens, in their order, that the merchant has, else the body."""
    table = ranked.toArrow()
    held = ranked.sparkSession.sparkContext.broadcast((Parts(table.column("token").to_pylist()), table.drop_columns("token").combine_chunks()))

    def hit(merchant: pa.Array, body: pa.Array) -> pa.Array:
        parts, values = held.value
        named = parts.first(merchant)
        rest = np.flatnonzero(named < 0)
        named[rest] = parts.first(body.take(pa.array(rest)))
        at = pa.array(named, mask=named < 0)
        return pa.StructArray.from_arrays([values.column(c).combine_chunks().take(at) for c in values.column_names], values.column_names, mask=pa.array(named < 0))

    return F.arrow_udf(hit, ranked.select("brand", "category", "online").schema)


def token_matches(tokens: DataFrame, keywords: DataFrame) -> DataFrame:
    """(token, keyword): what a token means, by one of three rules.

    A keyword of over 3 letters that the token contains; for tokens of over 4 letters the best by Jaro-Winkler, over
    0.9; for shorter ones the best by common substring, if that is as long as the keyword (one less, if the keyword has over
    4 letters). Of equal scores the last keyword wins. ``tokens`` are distinct, ``keywords`` (keyword, ord) a dictionary. All
    three are joins of equality: on runs of letters, on bounds of the similarity, and on substrings.
    """
    tokens, keys = tokens.select("token").distinct(), keywords.select("keyword", "ord")
    inside = containing(tokens, "token", keys.where(F.length("keyword") > 3).select("keyword").distinct(), "keyword", 4).select("token", "keyword")
    pairs = similar_candidates(tokens.where(F.length("token") > 4).select(F.col("token").alias("a")), keys.select(F.col("keyword").alias("b")))
    scored = pairs.withColumn("score", jaro_winkler_col("a", "b")).where("score > 0.9").join(keys, F.col("b") == F.col("keyword"))
    near = scored.groupBy(F.col("a").alias("token")).agg(F.max(F.struct("score", "ord", "keyword")).alias("m")).select("token", "m.keyword")
    # of the keywords with a substring only the last can win
    pieces = lambda c: F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.length(c), F.lit(4))), lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))))
    ends = keys.where(F.length("keyword") > 0).select("keyword", "ord", F.explode_outer(F.array_distinct(pieces(F.col("keyword")))).alias("piece")).groupBy("piece").agg(F.max(F.struct("ord", "keyword")).alias("last"))
    short = tokens.where((F.length("token") <= 4) & (F.length("token") > 0)).select("token", F.explode_outer(F.array_distinct(pieces(F.col("token")))).alias("piece"))
    best = short.join(ends, "piece").groupBy("token").agg(F.max(F.struct(F.length("piece").alias("score"), "last")).alias("m"))
    need = F.length("m.last.keyword") - F.when(F.length("m.last.keyword") > 4, 1).otherwise(0)
    short = best.where(F.col("m.score") >= need).select("token", F.col("m.last.keyword").alias("keyword"))
    return inside.union(near).union(short).distinct()


def fuzzy_category(rows: DataFrame, keywords: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, categories): sorted categories of all of a text's tokens; ``keywords`` has (keyword, category, ord)."""
    tokens = rows.select(key, F.explode(F.array_distinct(split_merchant(F.col(text)))).alias("token"))
    means = token_matches(tokens, keywords).join(small(keywords.select("keyword", "category")), "keyword").select("token", "category").distinct()
    return tokens.join(means, "token").groupBy(key).agg(F.array_sort(F.collect_set("category")).alias("categories"))
