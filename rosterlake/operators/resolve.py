"""Entity resolution: canonical identity, best-trust scalars, keyed merges.

Every step is an aggregate whose state is one row per key, so Spark combines
map-side and a canonical id that owns a third of all rows still reaches its
reducer as one partial row per map task.  Merged collections stay long (one
row per distinct item); ``fold`` turns them into arrays only where a caller
wants that at the edge.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls


def union_sources(*frames: DataFrame) -> DataFrame:
    """Union of source records by column name, missing columns as NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_canonical_id(df: DataFrame, out="cid") -> DataFrame:
    return df.withColumn(out, urls.canonical_id(
        F.col("name"), F.col("repo_url"), F.col("repo_owner"),
        F.transform("endpoints", lambda e: e["url"]), F.transform("tools", lambda t: t["name"])))


def split_anonymous(df: DataFrame, key="cid"):
    """(identified, anonymous): rows with neither URL, name nor fingerprint all
    share one id and must not be merged with each other."""
    nothing = F.sha2(F.lit(""), 256)
    return df.filter(F.col(key) != nothing), df.filter(F.col(key) == nothing)


def with_own_id(df: DataFrame, key="cid", seq="seq", source_url="source_url") -> DataFrame:
    """Gives every anonymous row an id of its own, from its source URL, if there
    is one, and its sequence; they are neither merged nor one hot key."""
    parts = ([F.col(source_url).cast("string")] if source_url in df.columns else []) + [F.col(seq).cast("string")]
    own = F.sha2(F.concat_ws("|", F.lit("anonymous"), *parts), 256)
    return df.withColumn(key, F.when(F.col(key) == F.sha2(F.lit(""), 256), own).otherwise(F.col(key)))


def _order(trust: str, seq: str) -> Column:
    return F.struct(F.col(trust).alias("trust"), (-F.col(seq)).alias("neg_seq"))


def best_rows(df: DataFrame, key="cid", trust="trust", seq="seq", columns=None, extras=()) -> DataFrame:
    """The highest-trust row per key, ties to the lowest ``seq``; ``extras`` are
    further named aggregates of the group, computed in the same pass."""
    cols = columns or [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*cols), _order(trust, seq))
    grouped = df.groupBy(key).agg(best.alias("b"), F.count("*").alias("members"), *extras)
    return grouped.select(*[c for c in grouped.columns if c != "b"], "b.*")


def merge_scalars(df: DataFrame, key="cid", trust="trust", seq="seq", scalars=(), first_seen="first_seen",
                  last_seen="last_seen", content="raw_content") -> DataFrame:
    """One row per key: scalars of the best row, first non-null ``first_seen``
    in trust order, latest ``last_seen``, best non-empty content.

    The aggregate reads ranks and times only and yields the winners' ``seq``;
    their wide columns are then fetched by (key, seq).
    """
    order = _order(trust, seq)
    has = lambda c: c in df.columns
    aggs = [F.max(order).alias("_best"), F.count("*").alias("members")]
    if has(first_seen):
        aggs.append(F.max_by(first_seen, F.when(F.col(first_seen).isNotNull(), order)).alias(first_seen))
    if has(last_seen):
        aggs.append(F.max(last_seen).alias(last_seen))
    if has(content):
        aggs.append(F.max(F.when(F.coalesce(F.col(content), F.lit("")) != "", order)).alias("_full"))
    times = [c for c in (first_seen, last_seen) if has(c)]
    won = df.groupBy(key).agg(*aggs)
    won = won.select(key, "members", *times, (-F.col("_best.neg_seq")).alias(seq),
                     *([(-F.col("_full.neg_seq")).alias("_full")] if has(content) else []))
    wide = [c for c in scalars if c not in times and c not in (key, seq, content)]
    rows = df.select(key, seq, *wide, *([F.col(content).alias("_own")] if has(content) else [])).join(won, [key, seq])
    if not has(content):
        return rows.select(key, "members", *wide, *times)
    # the best row's content nearly always is the best content; only the others are fetched
    elsewhere = won.filter(F.col("_full") != F.col(seq)).select(key, F.col("_full").alias(seq))
    other = df.select(key, seq, F.col(content).alias("_other")).join(elsewhere, [key, seq]).select(key, "_other")
    text = F.when(F.col("_full").isNotNull() & (F.col("_full") != F.col(seq)), F.col("_other")) \
            .when(F.col("_full").isNotNull(), F.col("_own"))
    return rows.join(other, key, "left").select(key, "members", *wide, *times, text.alias(content))


def merge_items(df: DataFrame, items: str, item_key, key="cid", trust="trust", seq="seq") -> DataFrame:
    """Distinct items of an array column per key; for equal item keys the one
    from the most trusted row wins.

    Result (key, rank_trust, rank_seq, position, item): sorting by the three
    rank columns gives the merged order.  The aggregation key is (key, item
    key), so one large group spreads over many reducers.
    """
    flat = df.select(key, trust, seq, F.posexplode(items).alias("position", "item"))
    order = F.struct(F.col(trust).alias("trust"), (-F.col(seq)).alias("neg_seq"),
                     (-F.col("position")).alias("neg_pos"))
    ikey = item_key(F.col("item")) if callable(item_key) else F.col("item")[item_key]
    best = flat.withColumn("item_key", ikey).groupBy(key, "item_key").agg(
        F.max_by("item", order).alias("item"), F.max(order).alias("o"))
    return best.select(key, "item_key", "item", F.col("o.trust").alias("rank_trust"),
                       (-F.col("o.neg_seq")).alias("rank_seq"), (-F.col("o.neg_pos")).alias("position"))


def merge_words(df: DataFrame, words: str, key="cid", trust="trust", seq="seq") -> DataFrame:
    """Distinct strings of an array column per key, in trust order."""
    return merge_items(df, words, lambda item: item, key, trust, seq)


def fold(merged: DataFrame, key="cid", out="items") -> DataFrame:
    """Merged items as one array per key, trust order.

    For entities whose merged list fits a row; keep the long form otherwise.
    """
    entry = F.struct((-F.col("rank_trust")).alias("t"), "rank_seq", "position", "item")
    return merged.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_l")) \
                 .select(key, F.transform("_l", lambda e: e["item"]).alias(out))


# list column -> how an item is identified inside an entity
LIST_KEYS = {
    "endpoints": lambda x: x["url"],
    "tools": lambda x: x["name"],
    "resources": lambda x: x["uri"],
    "prompts": lambda x: x["name"],
    "data_sources": lambda x: x["name"],
    "transport": lambda x: x,
    "sources": lambda x: F.concat_ws("|", x["source"], x["url"]),
}


def merge_lists(df: DataFrame, lists=None, key="cid", trust="trust", seq="seq") -> DataFrame:
    """All list columns of an entity merged at once: one row per key.

    The items of every list go through one long table, are reduced to distinct
    items on (key, list, item) first, and only those are put back into the row,
    in trust order.  What reaches one task is the merged list itself, which the
    entity row has to hold anyway, not the records it came from.
    """
    lists = {c: f for c, f in (lists or LIST_KEYS).items() if c in df.columns}
    kinds = dict(df.dtypes)

    def tagged(column, item_key):
        def one(x, i):
            payload = [(x if c == column else F.lit(None).cast(kinds[c][len("array<"):-1])).alias(c) for c in lists]
            return F.struct(F.lit(column).alias("list"), item_key(x).alias("item_key"), i.alias("position"), *payload)
        return F.transform(F.coalesce(F.col(column), F.array().cast(kinds[column])), one)

    flat = df.select(key, trust, seq, F.explode(F.concat(*[tagged(c, f) for c, f in lists.items()])).alias("x")) \
             .select(key, trust, seq, "x.*")
    order = F.struct(F.col(trust).alias("trust"), (-F.col(seq)).alias("neg_seq"), (-F.col("position")).alias("neg_pos"))
    items = flat.groupBy(key, "list", "item_key").agg(
        F.max_by(F.struct(*lists), order).alias("item"), F.max(order).alias("o"))
    entry = F.struct((-F.col("o.trust")).alias("t"), (-F.col("o.neg_seq")).alias("s"), (-F.col("o.neg_pos")).alias("p"),
                     "list", "item")
    folded = items.groupBy(key).agg(F.collect_list(entry).alias("_all"))
    in_order = F.array_sort("_all", lambda a, b: _compare(a, b))
    return folded.withColumn("_all", in_order).select(key, *[
        F.transform(F.filter("_all", lambda e: e["list"] == c), lambda e: e["item"][c]).alias(c) for c in lists])


def _compare(a, b):
    """Trust, then sequence, then position."""
    expr = F.lit(0)
    for f in ("p", "s", "t"):
        expr = F.when(a[f] < b[f], -1).when(a[f] > b[f], 1).otherwise(expr)
    return expr


def first_per_key(df: DataFrame, key, order, columns=None) -> DataFrame:
    """First row per key by an explicit order; deterministic, unlike
    ``dropDuplicates``."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = columns or [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select(*keys, "r.*")


def latest_per_key(df: DataFrame, key, order, columns=None) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    cols = columns or [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select(*keys, "r.*")


def mark_primary(sources: Column) -> Column:
    """Adds ``primary`` to an array of source references: true for the first."""
    return F.transform(sources, lambda s, i: F.struct(
        s["source"].alias("source"), s["url"].alias("url"), s["trust_score"].alias("trust_score"),
        (i == 0).alias("primary")))


def duplicate_report(df: DataFrame, key="cid") -> DataFrame:
    """Rows in, entities out, duplicates removed."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(F.sum("n").alias("rows_in"), F.count("*").alias("entities_out"),
                       (F.sum("n") - F.count("*")).alias("duplicates_removed"),
                       F.max("n").alias("largest_group"))


def collisions(df: DataFrame, column="slug", key="id") -> DataFrame:
    """Values that should be unique but are not."""
    return (df.groupBy(column).agg(F.count("*").alias("rows"), F.min(key).alias("first_id"))
            .filter(F.col("rows") > 1))


def disambiguate(df: DataFrame, column="slug", key="id", length=8) -> DataFrame:
    """Suffix colliding values with part of a hash of the id; the first id keeps
    the plain value."""
    dup = collisions(df, column, key)
    return (df.join(dup.drop("rows"), column, "left")
            .withColumn(column, F.when(
                F.col("first_id").isNotNull() & (F.col("first_id") != F.col(key)),
                F.concat_ws("-", F.nullif(F.col(column), F.lit("")),
                            F.left(F.sha2(F.col(key).cast("string"), 256), F.lit(length))))
                .otherwise(F.col(column)))
            .drop("first_id"))
