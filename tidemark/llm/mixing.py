"""Mix sources to target weights with hash thresholds: no sort, no Python, texts read once.

Every source gets a word target. A source takes whole passes over its documents while they fit, and
for the rest of its target the documents whose hash lies below a threshold. The threshold is found
from histograms: words are summed by source and the leading bits of the hash, the bucket in which the
budget runs out is the boundary bucket, and only that one is cut again by the next bits. Budgets are
nested: a larger target keeps every document of a smaller one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import fresh, keep, pick

#: Fixed values of the operation: weights of the sources in order, and how often a source may be taken.
WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: The hash has 60 bits, read as digits of 12 bits: a source's histogram has at most 4,096 bars.
DIGIT_BITS, DIGITS = 12, 5


def word_count(text: Column) -> Column:
    """Number of words between white space (U+0020, U+0009 to U+000D); null and blank texts have none."""
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.when(text.isNull() | (trimmed == ""), 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def document_hash(*columns: Column) -> Column:
    """60 bits of md5, which other engines can compute as well."""
    parts = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns])
    return F.conv(F.substring(F.md5(parts), 1, 15), 16, 10).cast("long")


def _hash_of(doc_id: Column, source: Column, text: Column) -> Column:
    """Rows with an id are told apart by id and source, rows without one by their text and source."""
    nameless = F.concat(F.lit("\x00"), F.coalesce(text.cast("string"), F.lit("\x00")))
    return document_hash(F.coalesce(doc_id.cast("string"), nameless), source)


def _numbered(sources: DataFrame) -> DataFrame:
    """Place of every source by code point, null last, without bringing all sources into one task."""
    ranged = keep(
        sources.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("at", F.monotonically_increasing_id()),
        "sources",
    )
    block, inside = F.shiftrightunsigned("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per block: as many as there are partitions.
    sizes = ranged.groupBy(block.alias("block")).agg(F.count("*").alias("rows"))
    before = sizes.select("block", (F.sum("rows").over(Window.orderBy("block")) - F.col("rows")).alias("before"))
    return ranged.withColumn("block", block).join(before, "block").select("source", "source_size", (F.col("before") + inside).alias("place"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """(source, source_size, target): weighted shares of all words, capped, the excess reshared until none is above.

    Only sums travel to the driver, one row a round; a round caps at least one more source.
    """
    table = keep(
        _numbered(sizes).select(
            "source", "source_size", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).alias("weight")
        ),
        "weights",
    )
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    # A source is capped when its share at the water level reaches most * size: level = rest / weight left.
    rest, left = total, None
    capped = F.lit(False)
    while True:
        row = table.filter(~capped).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
        full = table.filter(capped).agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s")).first()
        now = total - most * full["s"]
        if left == row["w"] or not row["w"]:
            break
        rest, left = now, row["w"]
        capped = F.col("weight").cast("decimal(38,0)") * F.lit(rest).cast("decimal(38,0)") > F.lit(most * left).cast("decimal(38,0)") * F.col("source_size")
    share = F.lit(0.0) if not left else F.col("weight") * F.lit(rest).cast("long") / F.lit(left).cast("double")
    return table.select("source", "source_size", F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def _digit(level: int) -> Column:
    return F.shiftright("hash", DIGIT_BITS * (DIGITS - 1 - level)).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))


def _thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, below): documents with a smaller hash come as near to the rest of the target as whole hash values allow."""
    # ``prefix`` is the boundary bucket so far, ``budget`` what is left for it.
    state = plan.select("source", F.lit(0).cast("long").alias("prefix"), F.col("rest").alias("budget"))
    for level in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - level)
        inside = rows.join(state, rows["source"].eqNullSafe(state["source"])).where(F.shiftright("hash", shift) == F.col("prefix"))
        bars = inside.groupBy(state["source"], "prefix", "budget", _digit(level).alias("bar")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("bar")
        sums = bars.withColumn("sum", F.sum("words").over(running))
        crossed = F.col("sum") > F.col("budget")
        nearer = F.col("over") - F.col("budget") < F.col("budget") - F.coalesce("filled", F.lit(0))
        state = keep(
            sums.groupBy("source", "prefix")
            .agg(
                F.min(F.when(crossed, F.col("bar"))).alias("bar"),
                F.max(F.when(~crossed, F.col("sum"))).alias("filled"),
                F.min(F.when(crossed, F.col("sum"))).alias("over"),
                F.max("budget").alias("budget"),
            )
            .select(
                "source",
                # No bar crosses: everything inside fits, the next prefix is past the last bar.
                # The last digit names single hash values: the one that crosses is taken where that comes nearer.
                (
                    F.shiftleft("prefix", DIGIT_BITS)
                    + F.coalesce(
                        F.col("bar") + (F.when(nearer, 1).otherwise(0) if level == DIGITS - 1 else F.lit(0)),
                        F.lit(1 << DIGIT_BITS),
                    )
                ).alias("prefix"),
                (F.col("budget") - F.coalesce("filled", F.lit(0))).alias("budget"),
            ),
            f"level{level}",
        )
    return state.select("source", F.col("prefix").alias("below"))


def _measured(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """(doc_id, source, size, hash): all that the mix needs to know of a document, written once."""
    rows = pick(docs, doc_id=id_column, source=source_column, text=text_column)
    return keep(
        rows.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), _hash_of(F.col("doc_id"), F.col("source"), F.col("text")).alias("hash")),
        "sizes",
    )


def mix_plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """(name, source_size, target, passes, below): one row per source."""
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0)).cast("long")
    plan = keep(targets.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "plan")
    below = _thresholds(rows.where("size > 0"), plan.where("passes < %d and source_size > 0" % most))
    return plan.join(below, plan["source"].eqNullSafe(below["source"]), "left").select(plan["source"].alias("name"), "source_size", "target", "passes", "below")


def _copies(hashed: Column, passes: Column, below: Column) -> Column:
    return (passes + F.when(hashed < F.coalesce(below, F.lit(0)), 1).otherwise(0)).cast("long")


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_PASSES,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words with repeats) and copies.

    A null text has size 0; a null source is a source of its own, the last one. Rows repeated with
    the same id and source, or without id the same text and source, share one hash and are taken together. A document of size 0 is taken as
    often as others but adds no words. An empty table gives an empty result, other columns are ignored.
    """
    rows = _measured(docs, id_column, text_column, source_column)
    plan = mix_plan(rows, weights, most)
    return rows.join(plan, rows["source"].eqNullSafe(plan["name"])).withColumn("copies", _copies(F.col("hash"), F.col("passes"), F.col("below"))).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def take_mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_PASSES,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns. Texts meet only the small plan."""
    plan = mix_plan(_measured(docs, id_column, text_column, source_column), weights, most)
    copy = fresh(docs, "mix_copy")
    source = docs[source_column].cast("string")
    copies = _copies(_hash_of(docs[id_column], source, docs[text_column]), plan["passes"], plan["below"])
    joined = docs.join(plan, source.eqNullSafe(plan["name"]))
    repeated = joined.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias(copy))
    return repeated.select(*docs.columns)
