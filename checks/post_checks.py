"""Cleaning, scoring, weekly text features and the posts sources."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks.stand_ins import (
    BARS, CHANNELS, CLEAN, DOWN_WORDS, END, KEYWORDS, LEXICON, MATCHED, NEGATIONS, POSTS,
    QUERIES as ASKED, RAW_COMMENTS, RAW_POSTS, START, UP_WORDS,
    bars, dated, keyword_sum, num, posts, posts_of, raw_comments, raw_posts, rounded, table,
)
from checks.market_checks import TEXT_NUMBERS, TEXT_STATS, weekly_text
from tidemark.functions import clean_text, keyword_hits
from tidemark.functions.calendar import add_month_windows
from tidemark.operators import sentiment as S
from tidemark.operators import weekly_text as W
from tidemark.operators.slices import slice_bounds
from tidemark.operators.top_rows import first_rows
from tidemark.operators.weekly_text import author_sketches, authors_in_spans, clean_posts
from tidemark.session import fresh_folder, keep_table, use_utc
from tidemark.settings import AssetQuery, PostSettings
from tidemark.sources import posts as P
from tidemark.streaming.landing import land_volume, landed_volume
from tidemark.streaming.landing import weekly_volume as stream_volume


def cleaned_documents(spark, folder):
    docs = table(spark, folder, "documents")
    clean = docs.select("doc_id", F.explode(F.array(clean_text(F.col("text")))).alias("clean_text"))
    return clean.select("doc_id", "clean_text", F.length("clean_text").cast("long").alias("text_len")).where(
        F.col("text_len") >= 15
    )


def cleaned_pages(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select("page_id", clean_text(F.concat_ws(" ", "url", "html")).alias("clean_text"))


def keyword_hit_counts(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", keyword_hits(F.lower("text"), KEYWORDS).alias("hits"))


def weekly_text_stats(spark, folder):
    return rounded(dated(weekly_text(spark, folder)))


def weekly_text_concat(spark, folder):
    return dated(W.weekly_text(W.clean_posts(posts(spark, folder))))


def weekly_text_pieces(spark, folder):
    pieces = W.weekly_text_pieces(W.clean_posts(posts(spark, folder)), piece_chars=2000)
    return dated(pieces)


PIECES = f"""WITH {POSTS},
placed AS (
  SELECT *, (sum(length(clean_text) + 1) OVER w - length(clean_text) - 1) // 2000 AS piece
  FROM cleaned WINDOW w AS (PARTITION BY asset, week_start ORDER BY created_utc, source_id))
SELECT asset, week_start, CAST(piece AS BIGINT) AS piece,
  string_agg(clean_text, ' ' ORDER BY created_utc, source_id) AS piece_text, count(*) AS posts
FROM placed GROUP BY asset, week_start, piece"""


def channel_pivot(spark, folder):
    cleaned = W.clean_posts(posts(spark, folder))
    return dated(cleaned.groupBy(*W.CELL).agg(*W.channel_columns(CHANNELS)))


def channel_counts(spark, folder):
    return dated(W.channel_counts(W.clean_posts(posts(spark, folder))))


def post_polarity(spark, folder):
    rules = S.PolarityRules(up_words=UP_WORDS, down_words=DOWN_WORDS, negations=NEGATIONS)
    scored = S.with_lexicon_polarity(W.clean_posts(posts(spark, folder)), LEXICON, rules=rules)
    return rounded(scored.select("source_id", "lex_compound"))


def post_polarity_joined(spark, folder):
    """The same from a lexicon too large for a literal, with a repeated and two incomplete entries."""
    rules = S.PolarityRules(up_words=UP_WORDS, down_words=DOWN_WORDS, negations=NEGATIONS)
    first = next(iter(LEXICON))
    rows = [*LEXICON.items(), (first, LEXICON[first] + 1.0), (first, LEXICON[first] - 1.0), ("void", None), (None, 1.0)]
    lexicon = spark.createDataFrame(rows, "token string, valence double")
    scored = S.with_lexicon_polarity(W.clean_posts(posts(spark, folder)), lexicon, rules=rules, max_literal=2)
    return rounded(scored.select("source_id", "lex_compound"))


def _words(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _adjust(previous: str, word: str, damp: float) -> str:
    boosted = (
        f"({previous} + sign({previous}) * CASE WHEN {word} IN {_words(UP_WORDS)} THEN {S.BOOST * damp} "
        f"WHEN {word} IN {_words(DOWN_WORDS)} THEN {-S.BOOST * damp} ELSE 0 END)"
    )
    return f"{boosted} * CASE WHEN {word} IN {_words(NEGATIONS)} THEN {S.NEGATION} ELSE 1 END"


_LEXICON_ROWS = ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in LEXICON.items())
POLARITY = f"""WITH {POSTS},
lexicon(t, v) AS (VALUES {_LEXICON_ROWS}),
words AS (
  SELECT source_id, unnest(string_split(clean_text, ' ')) AS t,
         generate_subscripts(string_split(clean_text, ' '), 1) AS i FROM cleaned),
context AS (
  SELECT *, lag(t, 1) OVER w AS b1, lag(t, 2) OVER w AS b2, lag(t, 3) OVER w AS b3,
         min(CASE WHEN t = 'but' THEN i END) OVER (PARTITION BY source_id) AS turn
  FROM words WINDOW w AS (PARTITION BY source_id ORDER BY i)),
one AS (SELECT *, {_adjust('v', 'coalesce(b1, chr(0))', 1.0)} AS v1 FROM context JOIN lexicon USING (t)),
two AS (SELECT *, {_adjust('v1', 'coalesce(b2, chr(0))', 0.95)} AS v2 FROM one),
three AS (SELECT *, {_adjust('v2', 'coalesce(b3, chr(0))', 0.9)} AS v3 FROM two),
totals AS (
  SELECT source_id, sum(v3 * CASE WHEN turn IS NULL THEN 1 WHEN i < turn THEN 0.5 ELSE 1.5 END) AS s
  FROM three GROUP BY source_id)
SELECT source_id, {num('coalesce(s / sqrt(s * s + 15), 0)', 'lex_compound')}
FROM cleaned LEFT JOIN totals USING (source_id)"""


def _score_columns(prefix: str) -> list[str]:
    return [f"{prefix}_{k}" for k in ("mean", "std", "pos_share", "neg_share")]


def lexicon_sentiment(spark, folder):
    scored = S.with_lexicon_polarity(W.clean_posts(posts(spark, folder)), LEXICON, rules=S.PLAIN)
    weekly = W.weekly_stats(scored, KEYWORDS)
    return rounded(dated(weekly.select(*W.CELL, *_score_columns("post_lex_sentiment"))))


def _stats_sql(score: str, prefix: str) -> str:
    return ", ".join((
        num(f"avg({score})", f"{prefix}_mean"), num(f"coalesce(stddev_samp({score}), 0)", f"{prefix}_std"),
        num(f"avg(CASE WHEN {score} > 0.05 THEN 1.0::DOUBLE ELSE 0 END)", f"{prefix}_pos_share"),
        num(f"avg(CASE WHEN {score} < -0.05 THEN 1.0::DOUBLE ELSE 0 END)", f"{prefix}_neg_share"),
    ))


LEXICON_SENTIMENT = f"""WITH {POSTS},
lexicon(t, v) AS (VALUES {_LEXICON_ROWS}),
words AS (SELECT source_id, unnest(string_split(clean_text, ' ')) AS t FROM cleaned),
totals AS (SELECT source_id, sum(v) AS s FROM words JOIN lexicon USING (t) GROUP BY source_id),
scored AS (
  SELECT asset, week_start, coalesce(s / sqrt(s * s + 15), 0) AS score
  FROM cleaned LEFT JOIN totals USING (source_id))
SELECT asset, week_start, {_stats_sql('score', 'post_lex_sentiment')} FROM scored GROUP BY ALL"""


def length_model():
    """Factory of a stand-in model whose probabilities come from the text length.

    Nested, so that it travels to the workers by value.
    """

    def factory():
        def predict(texts):
            sizes = np.array([len(t) for t in texts])
            positive, negative = (sizes % 7) / 14.0, (sizes % 5) / 10.0
            return np.stack([1.0 - positive - negative, positive, negative], axis=1)

        return ("Neutral", "Positive", "Negative"), predict

    return factory


def model_sentiment(spark, folder):
    cleaned = W.clean_posts(posts(spark, folder))
    weekly = W.weekly_stats(S.with_model_sentiment(cleaned, length_model(), batch_size=64), KEYWORDS)
    means = [f"post_model_{k}_mean" for k in ("positive", "negative", "neutral")]
    return rounded(dated(weekly.select(*W.CELL, *means, *_score_columns("post_model_sentiment"))))


MODEL_SENTIMENT = f"""WITH {POSTS},
scored AS (SELECT *, (length(clean_text) % 7) / 14.0::DOUBLE AS pos, (length(clean_text) % 5) / 10.0::DOUBLE AS neg FROM cleaned)
SELECT asset, week_start, {num('avg(pos)', 'post_model_positive_mean')}, {num('avg(neg)', 'post_model_negative_mean')},
  {num('avg(1 - pos - neg)', 'post_model_neutral_mean')}, {_stats_sql('(pos - neg)', 'post_model_sentiment')}
FROM scored GROUP BY ALL"""


POST_COLUMNS = ("source_type", "source_id", "created_utc", "author", "score", "num_comments", "text")


def normal_posts(spark, folder):
    return P.normalize_posts(raw_posts(spark, folder)).select("channel", *POST_COLUMNS)


def normal_posts_fraction(spark, folder):
    """Epochs with a fraction of a second, as some dumps carry them."""
    raw = raw_posts(spark, folder).withColumn("created_utc", F.col("created_utc") + F.lit(0.25))
    return P.normalize_posts(raw).select("channel", *POST_COLUMNS)


def normal_comments(spark, folder):
    return P.normalize_comments(raw_comments(spark, folder))


def _matched(spark, folder):
    return P.match_posts(P.normalize_posts(raw_posts(spark, folder)), ASKED)


def match_posts(spark, folder):
    return _matched(spark, folder).select("source_id", *P.QUERY)


def cap_earliest(spark, folder):
    return P.cap_per_query(_matched(spark, folder), 40).select("source_id", *P.QUERY, "created_utc")


def cap_newest(spark, folder):
    return P.cap_per_query(_matched(spark, folder), 40, newest=True).select("source_id", *P.QUERY, "created_utc")


MANY = tuple(
    AssetQuery(f"asset{i % 9}", CHANNELS[i % 4 : i % 4 + 2], tuple(f"{a}{b}" for b in ("er", "TION", "la ", "que", "x")))
    for i, a in enumerate(x + y for x in "abdeilnorstuÉ" for y in "aeionrst ")
)


def match_many(spark, folder):
    """Over 900 queries, found by the pieces of their keywords."""
    return P.match_posts(P.normalize_posts(raw_posts(spark, folder)), MANY).select("source_id", *P.QUERY)


_MANY_ROWS = ", ".join(f"('{q.asset}', '{c}', '{k}')" for q in MANY for c in q.channels for k in q.keywords)
MATCH_MANY = f"""WITH {RAW_POSTS}, asked(asset, channel, keyword) AS (VALUES {_MANY_ROWS})
SELECT source_id, asset, channel, keyword FROM normal JOIN asked USING (channel) WHERE contains(lower(title), lower(keyword))"""


def first_events(spark, folder):
    """The first 1,200 events of each type, by a threshold over small slices."""
    events = table(spark, folder, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    bounds = slice_bounds(events, ["event_type", "at", "event_id"], 1_000)
    return first_rows(events, ["event_type"], ["at", "event_id"], 1_200, bounds=bounds).select("event_type", "event_id")


def author_spans(spark, folder):
    """Different authors per asset and quarter, merged from weekly sketches; so few that the estimate is exact."""
    sketches = keep_table(author_sketches(clean_posts(posts(spark, folder))))
    found = authors_in_spans(sketches, F.to_date(F.trunc("week_start", "quarter")))
    return found.withColumnRenamed("span", "quarter")


def weekly_volume_stream(spark, folder):
    """Weekly post counts by a stream over the documents' files."""
    schema = use_utc(spark).read.parquet(f"{folder}/documents.parquet").schema
    # A stream reads a folder; the pattern names the table in it, be it a file or a folder of files.
    docs = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{folder}/documents.parque[t]")
    found = posts_of(docs)
    place = fresh_folder(spark)
    land_volume(stream_volume(found, "3650 days"), f"{place}/volume", f"{place}/state").awaitTermination()
    return dated(landed_volume(spark, f"{place}/volume"))


def _cap_sql(direction: str) -> str:
    return f"""WITH {MATCHED}
SELECT source_id, asset, channel, keyword, created_utc FROM matched
QUALIFY row_number() OVER (PARTITION BY asset, channel, keyword ORDER BY created_utc {direction}, source_id) <= 40"""


def cap_comments(spark, folder):
    return P.cap_comments(raw_comments(spark, folder), 2).select("post_id", "id", "position")


def dedup_first(spark, folder):
    return P.first_matches(_matched(spark, folder)).select("source_type", "source_id", "asset", "channel", "keyword")


DEDUP = f"""WITH {MATCHED}
SELECT source_type, source_id, asset, channel, keyword FROM matched
QUALIFY row_number() OVER (PARTITION BY source_type, source_id, asset ORDER BY query_no, created_utc) = 1"""

COLLECTED = ("asset", "channel", "source_type", "source_id", "created_utc", "author", "score", "num_comments", "keyword")


def collect_archive(spark, folder):
    raw = raw_posts(spark, folder)
    return P.collect_archive(raw, ASKED, START, END, PostSettings(max_posts_per_query=60)).select(*COLLECTED)


ARCHIVE = f"""WITH {MATCHED},
capped AS (
  SELECT * FROM matched WHERE created_utc >= date_trunc('month', DATE '{START}') AND created_utc < DATE '{END}'
  QUALIFY row_number() OVER (PARTITION BY asset, channel, keyword ORDER BY created_utc, source_id) <= 60)
SELECT {', '.join(COLLECTED)} FROM capped
QUALIFY row_number() OVER (PARTITION BY source_type, source_id, asset ORDER BY query_no, created_utc) = 1"""


def collect_search(spark, folder):
    settings = PostSettings(max_posts_per_query=60, include_comments=True, max_comments_per_post=3)
    return P.collect_search(
        raw_posts(spark, folder), ASKED, START, END, raw_comments(spark, folder), settings
    ).select(*COLLECTED)


SEARCH = f"""WITH {MATCHED}, {RAW_COMMENTS},
capped AS (
  SELECT * FROM matched
  QUALIFY row_number() OVER (PARTITION BY asset, channel, keyword ORDER BY created_utc DESC, source_id) <= 60),
kept AS (SELECT * FROM capped WHERE created_utc BETWEEN DATE '{START}' AND DATE '{END}'),
first_talk AS (SELECT * FROM talk QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY position, id) <= 3),
replies AS (
  SELECT k.asset, k.channel, 'comment' AS source_type, t.id AS source_id, t.created_utc, t.author, t.score,
         0 AS num_comments, k.keyword, k.query_no
  FROM first_talk t JOIN kept k ON t.post_id = k.source_id
  WHERE regexp_replace(t.body, '^\\s+|\\s+$', '', 'g') != '' AND t.created_utc BETWEEN DATE '{START}' AND DATE '{END}'),
rows AS (SELECT {', '.join(COLLECTED)}, query_no FROM kept UNION ALL SELECT * FROM replies)
SELECT {', '.join(COLLECTED)} FROM rows
QUALIFY row_number() OVER (PARTITION BY source_type, source_id, asset ORDER BY query_no, created_utc) = 1"""


def month_windows(spark, folder):
    spans = bars(spark, folder).groupBy("asset").agg(
        F.min("date").alias("first"), F.max("date").alias("last")
    )
    return add_month_windows(spans, "first", "last")


MONTHS = f"""WITH {BARS},
spans AS (SELECT asset, min(date) AS first, max(date) AS last FROM bars GROUP BY asset),
months AS (
  SELECT asset, last, unnest(generate_series(date_trunc('month', first)::TIMESTAMP, last::TIMESTAMP, INTERVAL 1 MONTH)) AS m
  FROM spans)
SELECT asset, m AS window_start, least(m + INTERVAL 1 MONTH, last::TIMESTAMP) AS window_end FROM months WHERE m < last"""


QUERIES = {
    "clean_text": cleaned_documents,
    "clean_text_urls": cleaned_pages,
    "keyword_hits": keyword_hit_counts,
    "weekly_text_stats": weekly_text_stats,
    "weekly_text_concat": weekly_text_concat,
    "weekly_text_pieces": weekly_text_pieces,
    "source_pivot": channel_pivot,
    "channel_counts": channel_counts,
    "post_polarity": post_polarity,
    "post_polarity_joined": post_polarity_joined,
    "lexicon_sentiment": lexicon_sentiment,
    "model_sentiment": model_sentiment,
    "normalize_posts": normal_posts,
    "normalize_posts_fraction": normal_posts_fraction,
    "normalize_comments": normal_comments,
    "match_posts": match_posts,
    "cap_per_query": cap_earliest,
    "cap_per_query_newest": cap_newest,
    "cap_comments": cap_comments,
    "dedup_first": dedup_first,
    "collect_archive": collect_archive,
    "collect_search": collect_search,
    "month_windows": month_windows,
    "match_many": match_many,
    "first_events": first_events,
    "author_spans": author_spans,
    "weekly_volume_stream": weekly_volume_stream,
}

ORACLES = {
    "match_many": MATCH_MANY,
    "first_events": "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 1200",
    "author_spans": f"""WITH {POSTS} SELECT asset, CAST(date_trunc('quarter', week_start) AS DATE) AS quarter, count(DISTINCT coalesce(author, '[unknown]')) AS authors
FROM cleaned GROUP BY ALL""",
    "weekly_volume_stream": f"""WITH {POSTS} SELECT CAST(date_trunc('week', created_utc) AS DATE) AS week_start, asset, count(*) AS posts FROM posts GROUP BY ALL""",
    "clean_text": f"""WITH c AS (SELECT doc_id, {CLEAN} AS clean_text FROM documents)
SELECT doc_id, clean_text, length(clean_text) AS text_len FROM c WHERE length(clean_text) >= 15""",
    "clean_text_urls": f"""WITH c AS (SELECT page_id, url || ' ' || html AS text FROM pages)
SELECT page_id, {CLEAN} AS clean_text FROM c""",
    "keyword_hits": f"""WITH c AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, {keyword_sum('t')} AS hits FROM c""",
    "weekly_text_stats": f"""WITH {TEXT_STATS}
SELECT asset, week_start, {', '.join(num(c, c) for c in TEXT_NUMBERS)} FROM stats""",
    "weekly_text_concat": f"""WITH {POSTS}
SELECT asset, week_start, string_agg(clean_text, ' ' ORDER BY created_utc, source_id) AS weekly_text
FROM cleaned GROUP BY ALL""",
    "weekly_text_pieces": PIECES,
    "source_pivot": f"""WITH {TEXT_STATS}
SELECT asset, week_start, {', '.join(f'post_channel_{c}_count' for c in CHANNELS)} FROM stats""",
    "channel_counts": f"""WITH {POSTS}
SELECT asset, week_start, channel, CAST(count(*) AS DOUBLE) AS posts FROM cleaned GROUP BY ALL""",
    "post_polarity": POLARITY,
    "post_polarity_joined": POLARITY,
    "lexicon_sentiment": LEXICON_SENTIMENT,
    "model_sentiment": MODEL_SENTIMENT,
    "normalize_posts": f"WITH {RAW_POSTS} SELECT channel, {', '.join(POST_COLUMNS)} FROM normal",
    "normalize_posts_fraction": f"""WITH {RAW_POSTS}
SELECT channel, {', '.join("created_utc + INTERVAL 250 MILLISECONDS AS created_utc" if c == 'created_utc' else c for c in POST_COLUMNS)} FROM normal""",
    "normalize_comments": f"""WITH {RAW_COMMENTS},
c AS (SELECT *, regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS text FROM talk)
SELECT post_id, 'comment' AS source_type, id AS source_id, created_utc, author, score,
  CAST(0 AS BIGINT) AS num_comments, text FROM c WHERE text != ''""",
    "match_posts": f"WITH {MATCHED} SELECT source_id, asset, channel, keyword FROM matched",
    "cap_per_query": _cap_sql("ASC"),
    "cap_per_query_newest": _cap_sql("DESC"),
    "cap_comments": f"""WITH {RAW_COMMENTS}
SELECT post_id, id, position FROM talk QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY position, id) <= 2""",
    "dedup_first": DEDUP,
    "collect_archive": ARCHIVE,
    "collect_search": SEARCH,
    "month_windows": MONTHS,
}
