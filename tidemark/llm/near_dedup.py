"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

A document is its set of word shingles. Equal sets are one class, found by a fingerprint, and only
classes go on. Each class has a signature of ``COORDINATES`` minima; linked classes agree in at least
``MATCHES`` of them but for a probability below 1e-5 at similarity 0.8. Classes are posted under their
coordinate-value pairs. Two signatures that agree in that many places share one of the
COORDINATES - MATCHES + 1 rarest pairs of either (prefix merging), and a pair that only one class has
cannot be shared, so classes with fewer live pairs than matches wanted are skipped at once.

Large groups never make all pairs. Round one compares each class with the smallest class of its
posting lists only, and joins what is linked; further turns try other members. Round two looks at lists
that still hold several components and compares members of different components inside bounded blocks,
without making rows of pairs. Links are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.components import components
from tidemark.llm.shared import NOT_SPACE, STEPWISE, U64, Words, as_bytes, keep, mix, pick, pieces, rolling, seeds, settings, small

COORDINATES, MATCHES = 32, 15
#: Further coordinates, one byte each, settle most pairs before their full sets are fetched: of all 128
#: at least this many agree (4.7 standard deviations below the mean at similarity 0.8).
MORE, MATCHES_OF_ALL = 96, 81
#: Turns in which each member outside the largest component of its lists is tried against one of it.
EARLY_TURNS = 3
#: Rows of a block of a cell.
BLOCK = 1024


def shingle_sets(body: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, row after row, and the row of each."""
    words = Words(body, bounds, NOT_SPACE)
    hashes = words.hashes(lower=True)
    grams = rolling(hashes, width)
    whole = words.row[: len(grams)] == words.row[width - 1 :] if len(grams) else np.zeros(0, bool)
    rows, values = [words.row[: len(grams)][whole]], [grams[whole]]
    # Rows with fewer words: the whole sequence is the one shingle, apart from longer ones by its length.
    for count in range(1, width):
        short = np.flatnonzero(words.counts == count)
        if len(short):
            rows.append(short)
            values.append(rolling(hashes, count, stream=100 + count)[words.first[:-1][short]])
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[fresh], value[fresh]


def _node(value: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A fingerprint of each set of shingle hashes, given where the sets start and how large they are; none is empty."""
    one = np.add.reduceat(mix(value), starts)
    two = np.add.reduceat(mix(value ^ U64(0x5851F42D4C957F2D)), starts)
    return mix(one ^ (two << U64(1)) ^ sizes.astype(U64)).view(np.int64)


def _signer(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = seeds(COORDINATES + MORE, 11) | U64(1), seeds(COORDINATES + MORE, 12)
        for batch in small(batches):
            body, bounds = as_bytes(batch.column(1))
            for first, last in pieces(bounds):
                row, value = shingle_sets(body[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], width)
                sizes = np.bincount(row, minlength=last - first)
                full = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[full]
                node = np.zeros(last - first, dtype=np.int64)
                signature = np.zeros((last - first, COORDINATES), dtype=np.int32)
                further = np.zeros((last - first, MORE), dtype=np.int8)
                if len(full):
                    node[full] = _node(value, starts, sizes[full])
                    for j in range(COORDINATES + MORE):
                        low = np.minimum.reduceat(((value * factors[j] + shifts[j]) >> U64(32)).astype(np.uint32), starts)
                        if j < COORDINATES:
                            signature[full, j] = low.view(np.int32)
                        else:
                            further[full, j - COORDINATES] = low.astype(np.uint8).view(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(node, mask=sizes == 0),
                        pa.FixedSizeListArray.from_arrays(pa.array(signature.ravel()), COORDINATES).cast(pa.list_(pa.int32())),
                        pa.FixedSizeListArray.from_arrays(pa.array(further.ravel()), MORE).cast(pa.list_(pa.int8())),
                    ],
                    ["doc_id", "n_shingles", "node", "signature", "further"],
                )

    return sign


def _sets_maker(width: int):
    """Sets of the asked nodes; a text under the same id that is not of the node is passed over."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            body, bounds = as_bytes(batch.column(1))
            for first, last in pieces(bounds):
                row, value = shingle_sets(body[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], width)
                sizes = np.bincount(row, minlength=last - first)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                asked = batch.column(0).slice(first, last - first)
                made = pa.RecordBatch.from_arrays([asked, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value.view(np.int64)))], ["node", "shingles"])
                full = np.flatnonzero(sizes)
                right = np.zeros(last - first, bool)
                if len(full):
                    right[full] = _node(value, ends[full], sizes[full]) == asked.to_numpy()[full]
                yield made if right.all() else made.filter(pa.array(right))

    return make


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    sized = pairs.join(left, "a").join(right, "b")
    return sized.withColumn("shared", shared).where(
        F.lit(100) * F.col("shared") >= F.lit(percent) * (F.size("sa") + F.size("sb") - F.col("shared"))
    ).select("a", "b")


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _prefixes(classes: DataFrame) -> DataFrame:
    """(pair, node, n): the rarest coordinate-value pairs of each class, those of one class alone left out."""
    posted = classes.select("node", "n_shingles", F.posexplode("signature").alias("place", "value")).select(
        (F.shiftleft(F.col("place").cast("long"), 32) + F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("pair"), "node", F.col("n_shingles").alias("n")
    )
    often = posted.groupBy("pair").agg(F.count("*").alias("often")).where("often > 1")
    live = posted.join(often, "pair").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("often", "pair"))).alias("pairs"))
    # The dead pairs are the rarest of all, so they take the first places of the prefix.
    wanted = F.size("pairs") - F.lit(MATCHES - 1)
    return live.where(wanted > 0).select("node", "n", F.explode(F.expr(f"slice(pairs, 1, size(pairs) - {MATCHES - 1})")).alias("p")).select("p.pair", "node", "n")


_CELL = "cell long, i int, j int, role int, node long, part long"


def _gathered(rows: DataFrame) -> DataFrame:
    """Rows of a cell's block one after another in one partition."""
    return rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "role", "node")


def _cells(open_lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of every block (i, j) of a cell: askers (role 0, block i) meet all its members (role 1, block j)."""
    members = open_lists.select(F.col("main").alias("cell"), "node", F.col("component").alias("part")).distinct()
    asking = (F.col("part") != F.col("cell")).cast("long")
    sizes = members.groupBy("cell").agg(F.ceil(F.sum(asking) / BLOCK).alias("rows"), F.ceil(F.count("*") / BLOCK).alias("columns"))
    dealt = members.join(sizes, "cell")

    def own(blocks: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(blocks))

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int")))

    askers = dealt.where("part != cell").select("cell", own("rows").cast("int").alias("i"), every("columns").alias("j"), F.lit(0).alias("role"), "node", "part")
    met = dealt.select("cell", every("rows").alias("i"), own("columns").cast("int").alias("j"), F.lit(1).alias("role"), "node", "part")
    rows = askers.union(met).join(classes.select("node", "n_shingles", "signature", "further"), "node")
    return _gathered(rows.select("cell", "i", "j", "role", "node", "part", "n_shingles", "signature", "further"))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table per block of a cell; a block has a bounded number of rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            part = batch.slice(a, b - a)
            if held and any(held[-1].column(k)[0] != part.column(k)[0] for k in range(3)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _near(percent: int):
    """Rows of a block that have a partner of similar size and signature in another component."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.Table] = []
        for block in _by_block(batches):
            asks = int((block["role"].to_numpy() == 0).sum())
            if not asks or asks == len(block):
                continue
            part, n = block["part"].to_numpy(), block["n_shingles"].to_numpy()
            first = block["signature"].combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
            more = block["further"].combine_chunks().flatten().to_numpy().reshape(-1, MORE)
            used = np.zeros(len(block), bool)
            for a in range(asks):
                fits = (part[asks:] != part[a]) & (100 * np.minimum(n[asks:], n[a]) >= percent * np.maximum(n[asks:], n[a]))
                at = np.flatnonzero(fits) + asks
                agree = (first[at] == first[a]).sum(axis=1)
                at, agree = at[agree >= MATCHES], agree[agree >= MATCHES]
                at = at[agree + (more[at] == more[a]).sum(axis=1) >= MATCHES_OF_ALL]
                if len(at):
                    used[a] = True
                    used[at] = True
            if used.any():
                out.append(block.select(["cell", "i", "j", "role", "node", "part"]).filter(pa.array(used)))
            if len(out) >= 500:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out = []
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return find


def _solve(percent: int):
    """One link (a, b) for every asker and every other component that holds a similar enough set."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _by_block(batches):
            asks = int((block["role"].to_numpy() == 0).sum())
            if not asks or asks == len(block):
                continue
            part, node = block["part"].to_numpy(), block["node"].to_numpy()
            sets = block["shingles"].combine_chunks()
            sizes = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values, begin = sets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
            # Postings of the members' shingles.
            owner = np.repeat(np.arange(len(block) - asks), sizes[asks:])
            order = np.argsort(values[begin[asks] :], kind="stable")
            sorted_values, owner = values[begin[asks] :][order], owner[order]
            a_out, b_out = [], []
            for a in range(asks):
                own = values[begin[a] : begin[a + 1]]
                low, high = np.searchsorted(sorted_values, own, "left"), np.searchsorted(sorted_values, own, "right")
                each = high - low
                at = np.repeat(low, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                shared = np.bincount(owner[at], minlength=len(block) - asks)
                good = np.flatnonzero((100 * shared >= percent * (sizes[a] + sizes[asks:] - shared)) & (part[asks:] != part[a]))
                _, one = np.unique(part[asks:][good], return_index=True)
                b_out += node[asks:][good[one]].tolist()
                a_out += [int(node[a])] * len(one)
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return solve


def _settled(rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: the signed rows, and (node, component_id) of the classes that are linked or have copies."""
    signed = keep(rows.mapInArrow(_signer(width), "doc_id long, n_shingles long, node long, signature array<int>, further array<tinyint>"), "signed")
    classes = keep(
        signed.where("node is not null and doc_id is not null")
        .groupBy("node").agg(F.min("doc_id").alias("smallest"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("further").alias("further"), F.count("*").alias("copies")),
        "classes",
    )
    posted = keep(_prefixes(classes), "posted")
    lists = posted.groupBy("pair").agg(F.min("node").alias("leader"), F.count("*").alias("members")).where("members > 1")
    active = keep(posted.join(lists, "pair"), "active")

    def sets_of(pairs: DataFrame, name: str, known: DataFrame | None = None) -> DataFrame:
        """Full sets of all classes in some pairs, made anew from the text of one document each."""
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        if known is not None:
            wanted = wanted.join(known, "node", "left_anti")
        texts = rows.join(classes.join(wanted, "node").select("node", F.col("smallest").alias("doc_id")), "doc_id")
        made = texts.select("node", "text").mapInArrow(_sets_maker(width), "node long, shingles array<bigint>")
        # A repeated row brings its node once more.
        return keep(made.dropDuplicates(["node"]), name)

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs whose signatures agree in enough places: (a, b, agree)."""
        both = pairs
        for side in ("a", "b"):
            both = both.join(classes.select(F.col("node").alias(side), F.col("signature").alias(f"s{side}"), F.col("further").alias(f"f{side}")), side)
        first = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same))
        more = F.size(F.filter(F.zip_with("fa", "fb", lambda x, y: x == y), lambda same: same))
        return both.withColumn("first", first).where(F.col("first") >= MATCHES).withColumn("agree", F.col("first") + more).where(F.col("agree") >= MATCHES_OF_ALL).select("a", "b", "agree")

    # Round one: the leader with which a class shares most lists.
    led = active.where("node != leader").groupBy("node", "leader").agg(F.count("*").alias("often"))
    best = led.groupBy("node").agg(F.max(F.struct("often", "leader")).alias("best"))
    pairs = keep(close(best.select(F.col("node").alias("a"), F.col("best.leader").alias("b"))), "pairs1")
    sets = sets_of(pairs, "sets1")
    links = keep(_linked(pairs, sets, percent), "links1")
    joined = keep(components(links), "joined")

    # Members of lists, known where their full set is at hand.
    members = keep(active.select("pair", "node", "n").join(sets.select("node", F.lit(True).alias("known")), "node", "left"), "members")

    def open_lists(parts: DataFrame) -> DataFrame:
        """Members of lists that hold several components, each list with its largest component."""
        placed = members.join(parts, "node", "left").select("pair", "node", "n", "known", F.coalesce("component", "node").alias("component"))
        counted = placed.groupBy("pair", "component").agg(F.count("*").alias("size"))
        mixed = counted.groupBy("pair").agg(F.max(F.struct("size", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        return keep(placed.join(mixed.select("pair", F.col("main.component").alias("main")), "pair"), "open")

    def join_more(parts: DataFrame, links: DataFrame) -> DataFrame:
        """Components after further links: what is joined already goes in as stars."""
        return keep(components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)), "joined")

    # Further turns: members outside the largest component of their lists meet one member of it per
    # list, another one each turn, and the best of them is tried. So large groups grow together by as
    # many pairs as they have members.
    still = open_lists(joined)
    for turn in range(EARLY_TURNS):
        partner = still.where("component = main").groupBy("pair").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "n", "known")).alias("p"))
        asked = still.where("component != main and known").join(partner.where("p.known"), "pair").where(_similar_sizes(F.col("n"), F.col("p.n"), percent))
        asked = asked.select(F.col("node").alias("a"), F.col("p.node").alias("b")).distinct()
        best = close(asked).groupBy("a").agg(F.max(F.struct("agree", "b")).alias("best")).select("a", "best.b")
        links = keep(_linked(best, sets, percent), f"early{turn}")
        if not links.isEmpty():
            joined = join_more(joined, links)
            still = open_lists(joined)

    # Round two settles what is left in lists that still hold several components. Members outside a
    # list's largest component are attached to it, and compared inside a cell with it and each other.
    # Cells are cut into blocks; pairs never become rows: a first pass over signatures names the classes
    # with a partner in reach, a second one over their full sets gives one link per component met.
    near = keep(_cells(still, classes).mapInArrow(_near(percent), _CELL), "near")
    whole = joined
    if not near.isEmpty():
        sets = sets.union(sets_of(near.select(F.col("node").alias("a"), F.col("node").alias("b")), "sets2", sets))
        solved = _gathered(near.join(sets, "node").select("cell", "i", "j", "role", "node", "part", "shingles")).mapInArrow(_solve(percent), "a long, b long")
        links = keep(solved.distinct(), "links2")
        if not links.isEmpty():
            whole = join_more(joined, links)

    named = classes.join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = named.groupBy("component").agg(F.min("smallest").alias("component_id"), F.count("*").alias("parts"), F.sum("copies").alias("copies"))
    linked = keep(named.join(firsts.where("parts > 1 or copies > 1").select("component", "component_id"), "component").select("node", "component_id"), "linked")
    return signed, linked


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document; a link needs 100 * shared >= percent * union.

    Words are runs without white space, A-Z lower-cased. A text with fewer than ``width`` words is one
    shingle; null and blank texts have an empty set, link with nothing and stay. component_id is the
    smallest id reachable over links, kept tells doc_id = component_id. Rows repeated
    with one id and text share a decision; of several texts under one id each has its own set and component. A row without id takes no part, stays, and has a null
    component. Other columns are ignored; an empty table gives an empty result.
    """
    rows = pick(docs, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with settings(rows.sparkSession, STEPWISE):
        signed, linked = _settled(rows, width, percent)
    found = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(linked, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
