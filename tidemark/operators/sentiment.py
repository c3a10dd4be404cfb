"""Text polarity: a lexicon rule set as column expressions, and a batched model."""

from __future__ import annotations

import json
import warnings
import zlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LEXICON = 20_000

# Published rule constants of the valence-lexicon method (Hutto & Gilbert 2014). Four of
# its rules are here: degree words, negation, the "but" shift and the normalisation. Its rules for
# "least", "never so", "without doubt", fixed phrases, capitals and punctuation are not.
BOOST = 0.293
NEGATION = -0.74
DISTANCE_DAMPING = (1.0, 0.95, 0.9)
BUT_BEFORE, BUT_AFTER = 0.5, 1.5
ALPHA = 15.0

# Degree words and negations as they read after cleaning (no apostrophes).
UP_WORDS = (
    "absolutely", "amazingly", "completely", "considerably", "deeply", "enormously", "entirely",
    "especially", "exceptionally", "extremely", "fully", "greatly", "highly", "hugely",
    "incredibly", "intensely", "more", "most", "particularly", "quite", "really", "remarkably",
    "so", "substantially", "thoroughly", "totally", "tremendously", "unbelievably", "utterly", "very",
)
DOWN_WORDS = (
    "almost", "barely", "hardly", "less", "little", "marginally", "occasionally", "partly",
    "scarcely", "slightly", "somewhat",
)
NEGATIONS = (
    "aint", "arent", "cannot", "cant", "couldnt", "didnt", "doesnt", "dont", "hadnt", "hasnt",
    "havent", "isnt", "neither", "never", "no", "none", "nope", "nor", "not", "nothing", "nowhere",
    "rarely", "seldom", "shouldnt", "wasnt", "werent", "without", "wont", "wouldnt",
)

# A small sample so that the operator runs; bring a full lexicon as a table.
SAMPLE_LEXICON: dict[str, float] = {
    "bad": -2.5, "bear": -1.0, "bearish": -1.8, "bull": 1.0, "bullish": 1.8, "buy": 0.8,
    "crash": -2.2, "dump": -1.6, "fear": -2.2, "gain": 2.0, "good": 1.9, "great": 3.1,
    "loss": -1.3, "moon": 1.2, "panic": -2.3, "pump": 0.6, "rally": 1.5, "risk": -1.1,
    "scam": -2.6, "sell": -0.8, "strong": 2.3, "weak": -1.9, "win": 2.8, "worst": -3.1,
}


@dataclass(frozen=True)
class PolarityRules:
    up_words: tuple[str, ...] = UP_WORDS
    down_words: tuple[str, ...] = DOWN_WORDS
    negations: tuple[str, ...] = NEGATIONS
    boost: float = BOOST
    negation: float = NEGATION
    damping: tuple[float, ...] = DISTANCE_DAMPING
    but_before: float = BUT_BEFORE
    but_after: float = BUT_AFTER
    alpha: float = ALPHA


PLAIN = PolarityRules(up_words=(), down_words=(), negations=(), but_before=1.0, but_after=1.0)


def _isin(word: Column, words: Sequence[str]) -> Column:
    return word.isin(*words) if words else F.lit(False)


def _adjusted(hit: Column, rules: PolarityRules) -> Column:
    """Valence of one token after the degree words and negations in the three tokens before it."""
    valence = hit["v"]
    for distance, damp in enumerate(rules.damping, start=1):
        word = hit[f"b{distance}"]
        step = F.when(_isin(word, rules.up_words), F.lit(rules.boost * damp)).when(
            _isin(word, rules.down_words), F.lit(-rules.boost * damp)
        )
        valence = valence + F.signum(valence) * F.coalesce(step, F.lit(0.0))
        valence = F.when(_isin(word, rules.negations), valence * F.lit(rules.negation)).otherwise(valence)
    return valence


def _compound(hits: Column, rules: PolarityRules) -> Column:
    """Fold the hits of one text, in order; a hit without valence is a "but"."""

    def state(before: Column, after: Column, turned: Column) -> Column:
        return F.struct(before.alias("before"), after.alias("after"), turned.alias("turned"))

    def step(acc: Column, hit: Column) -> Column:
        value = _adjusted(hit, rules)
        return (
            F.when(hit["v"].isNull(), state(acc["before"], acc["after"], F.lit(True)))
            .when(acc["turned"], state(acc["before"], acc["after"] + value, F.lit(True)))
            .otherwise(state(acc["before"] + value, acc["after"], F.lit(False)))
        )

    def finish(acc: Column) -> Column:
        return F.when(
            acc["turned"], acc["before"] * F.lit(rules.but_before) + acc["after"] * F.lit(rules.but_after)
        ).otherwise(acc["before"])

    total = F.aggregate(hits, state(F.lit(0.0), F.lit(0.0), F.lit(False)), step, finish)
    return F.transform(
        F.array(total), lambda s: s / F.sqrt(s * s + F.lit(rules.alpha))
    )[0]


def _with_neighbours(token: Column, index: Column, valence: Column) -> Column:
    before = [F.get(F.col("_tokens"), index - k).alias(f"b{k}") for k in (1, 2, 3)]
    return F.struct(index.alias("i"), valence.alias("v"), *before)


def _inside_row(df: DataFrame, text: str, lexicon: Mapping[str, float], rules: PolarityRules) -> DataFrame:
    """Score without join or shuffle.

    The lexicon is one literal, an array of small maps picked by the token's checksum,
    because a lookup in a single map would scan all its keys.
    """
    slots = 1 << max(1, len(lexicon).bit_length())
    table: list[dict[str, float]] = [{} for _ in range(slots)]
    for word, valence in lexicon.items():
        if word != "but":
            table[zlib.crc32(word.encode("utf-8")) % slots][word] = float(valence)
    literal = F.from_json(F.lit(json.dumps(table)), "array<map<string,double>>")

    def lookup(token: Column) -> Column:
        slot = F.crc32(F.encode(token, "utf-8")) % F.lit(slots)
        return F.element_at(literal, (slot + 1).cast("int"))[token]

    def hit(token: Column, index: Column) -> Column:
        valence = lookup(token)
        return F.when(
            valence.isNotNull() | (token == "but"), _with_neighbours(token, index, valence)
        )

    hits = F.filter(F.transform(F.col("_tokens"), hit), lambda s: s.isNotNull())
    return (
        df.withColumn("_tokens", F.split(F.coalesce(F.col(text), F.lit("")), " "))
        .withColumn("lex_compound", _compound(hits, rules))
        .drop("_tokens")
    )


def lexicon_entries(lexicon: DataFrame) -> DataFrame:
    """(token, valence), one row per token: rows without either drop out, repeats count by their mean."""
    known = lexicon.select("token", F.col("valence").cast("double").alias("valence")).dropna()
    return known.groupBy("token").agg(F.avg("valence").alias("valence"))


def _by_join(df: DataFrame, text: str, lexicon: DataFrame, rules: PolarityRules) -> DataFrame:
    """Score against a lexicon too large for a literal: tokens are joined to it.

    A score depends on the text alone, so each distinct text is scored once and found again by its
    checksum: rows need no key of their own. Tokens carry their neighbours, and the frequent "but" is
    never joined.
    """
    words = lexicon.where(F.col("token") != "but").select(F.col("token").alias("_token"), F.col("valence").alias("_v"))
    key = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    texts = df.select(F.coalesce(F.col(text), F.lit("")).alias("_text")).distinct()
    parts = texts.select(F.sha2(F.col("_text").cast("binary"), 256).alias("_key"), F.split("_text", " ").alias("_tokens"))

    def place(token: Column, index: Column) -> Column:
        return F.struct(token.alias("token"), _with_neighbours(token, index, F.lit(None).cast("double")).alias("hit"))

    tokens = parts.select("_key", F.explode(F.transform("_tokens", place)).alias("_t")).select("_key", F.col("_t.token").alias("_token"), F.col("_t.hit").alias("_hit"))
    turns = tokens.where(F.col("_token") == "but").select("_key", "_hit")
    found = tokens.join(words, "_token").select("_key", F.col("_hit").withField("v", F.col("_v")).alias("_hit"))
    hits = found.unionByName(turns).groupBy("_key").agg(F.sort_array(F.collect_list("_hit")).alias("_hits"))
    scored = hits.select("_key", _compound(F.col("_hits"), rules).alias("lex_compound"))
    return (
        df.withColumn("_key", key).join(scored, "_key", "left").drop("_key")
        .withColumn("lex_compound", F.coalesce("lex_compound", F.lit(0.0)))
    )


def with_lexicon_polarity(
    df: DataFrame,
    lexicon: Mapping[str, float] | DataFrame,
    text: str = "clean_text",
    rules: PolarityRules = PolarityRules(),
    max_literal: int = MAX_LEXICON,
) -> DataFrame:
    """Adds ``lex_compound``, the polarity of a cleaned text in [-1, 1]; a null text scores 0.

    A lexicon of up to ``max_literal`` entries becomes a literal in the plan, a larger one is joined;
    both give the same scores. Entries without token or valence are left out, and a token listed
    more than once has the mean of its valences.
    """
    if not isinstance(lexicon, DataFrame):
        entries = {token: float(v) for token, v in lexicon.items() if token is not None and v is not None}
        if len(entries) <= max_literal:
            return _inside_row(df, text, entries, rules)
        lexicon = df.sparkSession.createDataFrame(list(entries.items()), "token string, valence double")
    table = lexicon_entries(lexicon)
    rows = table.limit(max_literal + 1).collect()
    if len(rows) > max_literal:
        return _by_join(df, text, table, rules)
    return _inside_row(df, text, {row["token"]: row["valence"] for row in rows}, rules)


Predictor = Callable[[np.ndarray], np.ndarray]
PredictorFactory = Callable[[], tuple[Sequence[str], Predictor]]

MODEL_SCORES = T.StructType([
    T.StructField(name, T.DoubleType())
    for name in ("model_positive", "model_negative", "model_neutral", "model_sentiment")
])


def with_model_sentiment(
    df: DataFrame, factory: PredictorFactory, text: str = "clean_text", batch_size: int = 16
) -> DataFrame:
    """Adds the model's three probabilities and ``model_sentiment`` = positive - negative.

    ``factory`` is called once per Python worker and gives the label names, in the model's
    order, and a function from an array of texts to a (texts, labels) array of
    probabilities. A label the model lacks scores 0; a blank text is scored as "[empty]".
    """

    def load():
        labels, predict = factory()
        place = {str(label).lower(): column for column, label in enumerate(labels)}

        def score(texts: np.ndarray) -> dict[str, np.ndarray]:
            filled = np.array([t if t and t.strip() else "[empty]" for t in texts], dtype=object)
            probabilities = np.asarray(predict(filled), dtype=float)
            nothing = np.zeros(len(filled))
            positive, negative, neutral = (
                probabilities[:, place[label]] if label in place else nothing
                for label in ("positive", "negative", "neutral")
            )
            return {
                "model_positive": positive, "model_negative": negative, "model_neutral": neutral,
                "model_sentiment": positive - negative,
            }

        return score

    scorer = predict_batch_udf(load, return_type=MODEL_SCORES, batch_size=batch_size)
    return df.withColumn("_scores", scorer(F.col(text))).select(
        *df.columns, *[F.col(f"_scores.{name}").alias(name) for name in MODEL_SCORES.names]
    )


BACKENDS = ("lexicon", "model", "hybrid")


def with_sentiment(
    df: DataFrame,
    backend: str = "lexicon",
    lexicon: Mapping[str, float] | DataFrame | None = None,
    factory: PredictorFactory | None = None,
    batch_size: int = 16,
    rules: PolarityRules = PolarityRules(),
) -> DataFrame:
    """Adds the score columns of the chosen backend.

    ``hybrid`` takes both, and goes on with the lexicon alone, with a warning, where the
    model cannot be loaded; ``model`` raises there.
    """
    backend = backend.lower().strip()
    if backend not in BACKENDS:
        raise ValueError(f"sentiment backend has to be one of {BACKENDS}, not {backend!r}")
    if backend in ("lexicon", "hybrid"):
        df = with_lexicon_polarity(df, SAMPLE_LEXICON if lexicon is None else lexicon, rules=rules)
    if backend in ("model", "hybrid"):
        try:
            if factory is None:
                raise ImportError("no sentiment model was given")
            factory()
        except ImportError as missing:
            if backend == "model":
                raise
            warnings.warn(f"no sentiment model ({missing}); lexicon scores only", stacklevel=2)
        else:
            df = with_model_sentiment(df, factory, batch_size=batch_size)
    return df
