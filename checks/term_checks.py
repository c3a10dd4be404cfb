"""Term counts, vocabulary, TF-IDF, medians and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.market_checks import RETURNS, market_panel
from checks.stand_ins import POSTS, WEEKLY, dated, num, posts, rounded
from tidemark.operators import terms as T
from tidemark.operators.numeric_prep import exact_medians, fit_numeric
from tidemark.operators.weekly_text import clean_posts
from tidemark.session import keep_table


def _cleaned(spark, folder):
    """Every text is cleaned once; terms, slice bounds and the cell count read the narrow result."""
    return keep_table(clean_posts(posts(spark, folder)).select(*T.CELL, "created_utc", "source_id", "clean_text"))


def term_counts(spark, folder):
    return dated(T.post_terms(_cleaned(spark, folder)))


TERMS = f"""{POSTS},
texts AS (
  SELECT asset, week_start, string_agg(clean_text, ' ' ORDER BY created_utc, source_id) AS weekly_text
  FROM cleaned GROUP BY ALL),
lists AS (SELECT asset, week_start, regexp_extract_all(weekly_text, '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM texts),
every AS (
  SELECT asset, week_start, unnest(w) AS term FROM lists
  UNION ALL
  SELECT asset, week_start, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM lists
  WHERE len(w) > 1),
terms AS (SELECT asset, week_start, term, count(*) AS n FROM every GROUP BY ALL)"""



def long_term_counts(spark, folder):
    """Runs of one to four words, also across posts."""
    counts = T.post_terms(_cleaned(spark, folder), (1, 4), listed=True)
    # A list is summed up where it was made; only such rows are grouped.
    most = F.array_max(F.arrays_zip("n", "term"))
    lists = counts.select(*T.CELL, "width", F.size("term").alias("terms"), F.aggregate("n", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n"), F.array_min("term").alias("first_term"), most.alias("most"))
    return dated(lists.groupBy(*T.CELL, "width").agg(F.sum("terms").alias("terms"), F.sum("n").alias("n"), F.min("first_term").alias("first_term"), F.max("most")["term"].alias("most")))


_RUNS = " UNION ALL ".join(
    f"SELECT asset, week_start, {k} AS width, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i : i + {k - 1}], ' '))) AS term FROM lists WHERE len(w) >= {k}"
    for k in range(1, 5)
)
LONG_TERMS = f"""WITH {TERMS},
runs AS (SELECT asset, week_start, width, term, count(*) AS n FROM ({_RUNS}) GROUP BY ALL)
SELECT asset, week_start, width::INTEGER AS width, count(*) AS terms, sum(n)::BIGINT AS n, min(term) AS first_term, arg_max(term, (n, term)) AS most
FROM runs GROUP BY asset, week_start, width"""

VOCABULARY = f"""{TERMS},
docs AS (SELECT count(*) AS n_docs FROM texts),
kept AS (
  SELECT term, count(*) AS df, sum(n) AS cf FROM terms GROUP BY term HAVING count(*) >= 2
  ORDER BY cf DESC, term LIMIT 8000),
vocab AS (
  SELECT row_number() OVER (ORDER BY term) - 1 AS idx, term, df, ln((n_docs + 1.0) / (df + 1.0)) + 1.0 AS idf
  FROM kept, docs)"""


def _vocabulary(spark, folder, again=False):
    cleaned = _cleaned(spark, folder)
    # A term that a single cell holds is in no vocabulary; most pairs are such terms.
    terms = T.shared_terms(T.post_terms(cleaned), tasks=T.term_tasks(T.text_size(cleaned)))
    terms = keep_table(terms) if again else terms
    return terms, T.vocabulary(terms, cleaned.select(*T.CELL).distinct().count())


def vocabulary(spark, folder):
    _, out = _vocabulary(spark, folder)
    return rounded(out.withColumn("idx", F.col("idx").cast("long")))


def tfidf(spark, folder):
    terms, vocab = _vocabulary(spark, folder, again=True)
    weights = T.tfidf_weights(terms, vocab)
    return rounded(dated(weights.select(*T.CELL, "term", "weight")))


TFIDF = f"""WITH {VOCABULARY},
raw AS (SELECT asset, week_start, term, n * idf AS raw FROM terms JOIN vocab USING (term))
SELECT asset, week_start, term, {num('raw / sqrt(sum(raw * raw) OVER (PARTITION BY asset, week_start))', 'weight')}
FROM raw"""

NUMBERS = (*RETURNS, "mkt_volume", "mkt_close", "mkt_volatility_1w")


def median_by_asset(spark, folder):
    return rounded(exact_medians(market_panel(spark, folder), NUMBERS, ["asset"]))


MEDIANS = f"""WITH {WEEKLY},
long AS (UNPIVOT (SELECT asset, {', '.join(NUMBERS)} FROM panel) ON {', '.join(NUMBERS)} INTO NAME column_name VALUE value)
SELECT asset, column_name, {num('median(value)', 'median')} FROM long GROUP BY ALL"""


def standardize(spark, folder):
    panel = market_panel(spark, folder)
    prep = fit_numeric(panel, NUMBERS)
    scaled = prep.transform(panel).select("asset", "week_start", *[f"std_{c}" for c in NUMBERS])
    return rounded(dated(scaled))


def standardize_small(spark, folder):
    """The way that training takes for a small block, with NaN in place of null."""
    panel = market_panel(spark, folder)
    panel = panel.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in NUMBERS})
    scaled = fit_numeric(panel, NUMBERS, n_train=1).transform(panel).select("asset", "week_start", *[f"std_{c}" for c in NUMBERS])
    return rounded(dated(scaled))


STANDARDIZE = f"""WITH {WEEKLY},
filled AS (SELECT asset, week_start, {', '.join(f'coalesce({c}, (SELECT median({c}) FROM panel)) AS {c}' for c in NUMBERS)} FROM panel)
SELECT asset, week_start,
  {', '.join(num(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()', f'std_{c}') for c in NUMBERS)}
FROM filled"""


QUERIES = {
    "term_counts": term_counts,
    "long_term_counts": long_term_counts,
    "vocabulary": vocabulary,
    "tfidf": tfidf,
    "median_impute": median_by_asset,
    "standardize": standardize,
    "standardize_small": standardize_small,
}

ORACLES = {
    "term_counts": f"WITH {TERMS} SELECT asset, week_start, term, n FROM terms",
    "long_term_counts": LONG_TERMS,
    "vocabulary": f"WITH {VOCABULARY} SELECT idx, term, df, {num('idf', 'idf')} FROM vocab",
    "tfidf": TFIDF,
    "median_impute": MEDIANS,
    "standardize": STANDARDIZE,
    "standardize_small": STANDARDIZE,
}
