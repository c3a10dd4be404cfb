"""Landed submissions and comments to the posts table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import epoch_seconds
from tidemark.functions.text import SPACE
from tidemark.operators.slices import constant_strings, place_of
from tidemark.operators.top_rows import MAP_SIDE_ROWS, first_per_key, first_rows, top_per_group
from tidemark.schemas import POSTS
from tidemark.session import use_utc
from tidemark.settings import AssetQuery, PostSettings

MAX_BROADCAST_QUERIES = 100_000
#: Queries from which on keywords are looked up by their rarest piece, characters of a piece, and queries of one index.
INDEX_FROM = 200
GRAM = 3
INDEX_QUERIES = 50_000
#: Pieces of an index up to which a title's own are held against all of them at once.
INTERSECT_GRAMS = 2_000
QUERY = ("asset", "channel", "keyword")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def _author() -> Column:
    return F.when(F.length("author") > 0, F.col("author")).otherwise(F.lit("[deleted]"))


def _whole(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long"))


def normalize_posts(raw: DataFrame) -> DataFrame:
    """Submission records to post rows, plus the title the queries look at."""
    title, body = (F.coalesce(F.col(c), F.lit("")) for c in ("title", "body"))
    return raw.select(
        "channel",
        F.lit("submission").alias("source_type"),
        F.col("id").alias("source_id"),
        epoch_seconds(F.col("created_utc")).alias("created_utc"),
        _author().alias("author"),
        _whole("score").alias("score"),
        _whole("num_comments").alias("num_comments"),
        _stripped(F.concat(title, F.lit(" "), body)).alias("text"),
        title.alias("title"),
    )


def normalize_comments(raw: DataFrame) -> DataFrame:
    """Comment records to post rows, plus the post they belong to; empty comments drop out."""
    return raw.select(
        "post_id",
        F.lit("comment").alias("source_type"),
        F.col("id").alias("source_id"),
        epoch_seconds(F.col("created_utc")).alias("created_utc"),
        _author().alias("author"),
        _whole("score").alias("score"),
        F.lit(0).cast("long").alias("num_comments"),
        _stripped(F.coalesce(F.col("body"), F.lit(""))).alias("text"),
    ).where(F.length("text") > 0)


def query_table(spark: SparkSession, queries: Sequence[AssetQuery]) -> DataFrame:
    """(asset, channel, keyword, query_no): every combination, numbered in the order given."""
    config = spark.createDataFrame(
        [(i, q.asset, list(q.channels), list(q.keywords)) for i, q in enumerate(queries)],
        "position int, asset string, channels array<string>, keywords array<string>",
    )
    by_channel = config.select("position", "asset", "keywords", F.posexplode("channels").alias("c", "channel"))
    return by_channel.select(
        "asset", "channel", "position", "c", F.posexplode("keywords").alias("k", "keyword")
    ).select("asset", "channel", "keyword", F.struct("position", "c", "k").alias("query_no"))


def match_posts(posts: DataFrame, queries: Sequence[AssetQuery]) -> DataFrame:
    """One row per post and query whose channel is the post's and whose keyword its title holds.

    Letters match in either case. A post may meet several queries. The number of queries is
    known here, so the table of a few is broadcast and a busy channel is never shuffled. From
    ``INDEX_FROM`` queries on they are looked up inside the row, see :func:`match_by_grams`. The
    title, which the text repeats, is not carried on.
    """
    size = sum(len(q.channels) * len(q.keywords) for q in queries)
    if size >= INDEX_FROM:
        return match_by_grams(posts, queries)
    table = query_table(posts.sparkSession, queries).withColumn("_keyword", F.lower("keyword"))
    if size <= MAX_BROADCAST_QUERIES:
        table = F.broadcast(table)
    titled = posts.withColumn("_title", F.lower("title")).drop("title")
    return (
        titled.join(table, "channel")
        .where(F.contains("_title", "_keyword"))
        .drop("_title", "_keyword")
    )


def _grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(max(1, len(text) - GRAM + 1))}


def gram_index(keywords: Sequence[str]) -> dict[str, list[str]]:
    """Keywords by their rarest piece of ``GRAM`` characters, shorter keywords by themselves.

    Rare is what few keywords hold; ties go to the smaller piece. Each keyword stands under one piece, so
    that a title that holds it meets it once.
    """
    held: dict[str, int] = {}
    for word in keywords:
        for gram in _grams(word):
            held[gram] = held.get(gram, 0) + 1
    index: dict[str, list[str]] = {}
    for word in sorted(keywords):
        index.setdefault(min(_grams(word), key=lambda g: (held[g], g)), []).append(word)
    return index


def _title_grams(title: Column, lengths: Sequence[int]) -> Column:
    """The pieces of the given lengths: one native pass over the title for each length."""

    def cut(n: int) -> Column:
        # Looking ahead takes a piece from every place; each match is empty, so the next one is one place on.
        return F.regexp_extract_all(title, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) if n else F.array(F.lit(""))

    return F.concat(*[cut(n) for n in lengths])


def _held(title: Column, grams: Sequence[str]) -> Column:
    """The different pieces of the title that may be among ``grams``: for not too many of these, just those that are."""
    own = _title_grams(title, sorted({len(g) for g in grams}))
    return F.array_intersect(own, constant_strings(grams)) if len(grams) <= INTERSECT_GRAMS else F.array_distinct(own)


def match_by_grams(posts: DataFrame, queries: Sequence[AssetQuery]) -> DataFrame:
    """:func:`match_posts` for many queries: an inverted index from pieces of keywords, looked up inside the row.

    Of a title's pieces those of the index, a literal of the plan, are kept by hash and searched for by halving; only
    keywords under a piece that the title holds, and of its channel, are held against it. Nothing is
    shuffled or broadcast, and the work does not grow with the keywords but for the halving. More than
    ``INDEX_QUERIES`` queries are searched for in several indexes one after the other.
    """
    spark = posts.sparkSession
    rows = [(q.asset, c, k, i, ci, ki) for i, q in enumerate(queries) for ci, c in enumerate(q.channels) for ki, k in enumerate(q.keywords)]
    lowered = {}
    words = sorted({r[2] for r in rows})
    for r in spark.createDataFrame([(w,) for w in words], "word string").select("word", F.lower("word").alias("low")).collect():
        lowered[r["word"]] = r["low"]
    titled = posts.withColumn("_title", F.lower("title")).drop("title")
    out = None
    for start in range(0, len(rows), INDEX_QUERIES):
        part = rows[start : start + INDEX_QUERIES]
        asked: dict[str, list] = {}
        for row in part:
            asked.setdefault(lowered[row[2]], []).append(row)
        index = gram_index(list(asked))
        grams = sorted(index, key=lambda g: g.encode())
        entries, begins = [], [0]
        for gram in grams:
            entries += [(*row, word) for word in index[gram] for row in asked[word]]
            begins.append(len(entries))
        asset, channel, keyword, position, c, k, low = ([str(e[i]) for e in entries] for i in range(7))
        begin = constant_strings([str(b) for b in begins]).cast("array<int>")
        found = F.transform(_held(F.col("_title"), grams), lambda g: place_of(g, grams))
        near = F.flatten(F.transform(F.filter(found, lambda at: at >= 0), lambda at: F.sequence(F.get(begin, at), F.get(begin, at + 1) - 1)))
        met = F.filter(near, lambda e: (F.get(constant_strings(channel), e) == F.col("channel")) & F.contains(F.col("_title"), F.get(constant_strings(low), e)))
        numbers = [F.get(constant_strings(v).cast("array<int>"), F.col("_met")).alias(n) for v, n in ((position, "position"), (c, "c"), (k, "k"))]
        hits = titled.withColumn("_met", F.explode(met)).select(
            *[c for c in titled.columns if c != "_title"], F.get(constant_strings(asset), F.col("_met")).alias("asset"),
            F.get(constant_strings(keyword), F.col("_met")).alias("keyword"), F.struct(*numbers).alias("query_no"),
        )
        out = hits if out is None else out.unionByName(hits)
    return out


def cap_per_query(matched: DataFrame, n: int, newest: bool = False) -> DataFrame:
    """At most ``n`` posts per (asset, channel, keyword): the earliest, or the newest.

    Caps beyond ``MAP_SIDE_ROWS`` are found by a threshold, so that no query's posts are ever sorted.
    """
    at = F.col("created_utc").desc() if newest else F.col("created_utc").asc()
    # Repeated ids are settled by the remaining columns, so that a retried task keeps the same rows.
    rest = [F.col(c) for c in matched.columns if c not in (*QUERY, "created_utc", "source_id")]
    if n > MAP_SIDE_ROWS:
        micros = F.unix_micros("created_utc")
        timed = matched.withColumn("_at", -micros if newest else micros)
        return first_rows(timed, QUERY, ["_at", "source_id"], n, ties=rest).drop("_at")
    return top_per_group(matched, QUERY, [at, F.col("source_id"), *rest], n)


def cap_comments(raw: DataFrame, n: int) -> DataFrame:
    """The first ``n`` comments per post by their position."""
    rest = [F.col(c) for c in raw.columns if c not in ("post_id", "position", "id")]
    return top_per_group(raw, ["post_id"], [F.col("position"), F.col("id"), *rest], n)


def within(df: DataFrame, start: str, end: str, column: str = "created_utc") -> DataFrame:
    """Rows from ``start`` to ``end``, both included."""
    return df.where(F.col(column).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def within_months(df: DataFrame, start: str, end: str, column: str = "created_utc") -> DataFrame:
    """Rows of the calendar months from that of ``start``, up to ``end`` (excluded)."""
    first = F.date_trunc("month", F.lit(start).cast("timestamp"))
    return df.where((F.col(column) >= first) & (F.col(column) < F.lit(end).cast("timestamp")))


def first_matches(matched: DataFrame) -> DataFrame:
    """One row per (source_type, source_id, asset): the one of the earliest query."""
    return first_per_key(
        matched, ["source_type", "source_id", "asset"], [F.col("query_no"), F.col("created_utc")]
    ).select(*POSTS.names)


def collect_archive(
    raw: DataFrame, queries: Sequence[AssetQuery], start: str, end: str,
    settings: PostSettings = PostSettings(),
) -> DataFrame:
    """Posts of an archive dump: month range, match, earliest n per query, then one row per post."""
    use_utc(raw.sparkSession)
    posts = within_months(normalize_posts(raw), start, end)
    return first_matches(cap_per_query(match_posts(posts, queries), settings.max_posts_per_query))


def collect_search(
    raw: DataFrame, queries: Sequence[AssetQuery], start: str, end: str,
    comments: DataFrame | None = None, settings: PostSettings = PostSettings(),
) -> DataFrame:
    """Posts of a newest-first search: the cap comes before the date filter.

    With ``include_comments`` the first comments of every kept post follow it into its query.
    """
    use_utc(raw.sparkSession)
    capped = cap_per_query(
        match_posts(normalize_posts(raw), queries), settings.max_posts_per_query, newest=True
    )
    kept = within(capped, start, end)
    rows = kept
    if settings.include_comments and comments is not None:
        # Only comments of kept posts are ranked.
        wanted = comments.join(kept.select(F.col("source_id").alias("post_id")).distinct(), "post_id", "left_semi")
        replies = within(
            normalize_comments(cap_comments(wanted, settings.max_comments_per_post)), start, end
        )
        parents = kept.select(F.col("source_id").alias("post_id"), *QUERY, "query_no")
        rows = rows.unionByName(replies.join(parents, "post_id").drop("post_id"))
    return first_matches(rows)
