"""SentencePiece encoding as a relational lattice, and decoding.

The best segmentation of a text is the one whose pieces have the largest sum of scores. Pieces that
lose against a split of their own characters are left aside. Texts are cut into units wherever no
piece holds the two characters side by side, and each distinct unit is segmented once for the whole corpus:

* units are counted; their substrings up to the longest piece are exploded and equi-joined to the
  piece table (broadcast: its size is that of the model file);
* the matches are the edges of the unit's lattice; they are grouped by unit, and Viterbi's rule settles the ends of
  many units at once in arrays; the best paths are walked back likewise.

To put documents together again, the ``COMMON`` most frequent units are broadcast as arrays of hashes
and ids. The units beyond them are joined by value and gathered by document, once, and brought to the documents by key,
one slice of these after the other.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import POWERS, STEPWISE, U64, keep, mix, pick, pieces, settings, small

#: Most units that are looked up from a broadcast table.
COMMON = 1 << 18
#: Rows of a batch that are unpacked at once.
ROWS = 256
#: Longer units (in characters) are cut into parts of this size while their substrings are exploded.
LONG = 256
#: Characters of units whose lattices one task groups in memory, without sorting their edges.
TASK_CHARACTERS = 1 << 19
#: Characters of text whose units are counted together, about.
COUNTED = 1 << 23
#: Edges whose best paths one task settles at once.
EDGES = 1 << 19
#: Documents are put together with their rare units in this many slices, so that only one slice's texts lie in shuffle files.
SLICES = 4
#: Edges of a task are grouped by hash throughout.
SETTINGS = STEPWISE | {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str((1 << 31) - 1)}
SPACE = "▁"
#: The penalty below the smallest score for a character without piece, a fixed value of the format.
UNKNOWN_PENALTY = 10.0


class Model:
    """The piece table of a model file: normal pieces with scores, byte pieces and the unknown piece."""

    def __init__(self, path: str) -> None:
        # Only the driver reads the file, so only it loads the library.
        from sentencepiece import sentencepiece_model_pb2 as model_files

        proto = model_files.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        self.dummy_prefix = proto.normalizer_spec.add_dummy_prefix
        kinds = model_files.ModelProto.SentencePiece
        self.normal = [(p.piece, i, float(p.score)) for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN), -1)
        self.unknown_score = min(s for _, _, s in self.normal) - UNKNOWN_PENALTY
        self.useful = self._undominated()
        self.longest = max(len(p) for p, _, _ in self.useful)
        self.length = {i: len(p) for p, i, _ in self.normal}
        self.surface = [b""] * len(proto.pieces)
        for piece, i, _ in self.normal:
            self.surface[i] = piece.replace(SPACE, " ").encode()
        for byte, i in self.bytes.items():
            self.surface[i] = bytes([byte])
        if 0 <= self.unknown:
            self.surface[self.unknown] = " ⁇ ".encode()

    def _undominated(self) -> list[tuple[str, int, float]]:
        """The pieces that a best path can hold.

        A piece whose characters have a better sum when split never stands on a best path, wherever it
        occurs. Leaving such pieces out changes no result, and makes units shorter and fewer.
        """
        score = {p: s for p, _, s in self.normal}
        reach = max(map(len, score))
        out = []
        for piece, i, own in self.normal:
            best = [0.0]
            for end in range(1, len(piece) + 1):
                best.append(max(
                    best[start] + score.get(piece[start:end], self.unknown_score if end - start == 1 else -np.inf)
                    for start in range(max(0, end - reach), end) if end - start < len(piece)
                ) if end < len(piece) or len(piece) > 1 else own)
            if len(piece) == 1 or own >= best[-1]:
                out.append((piece, i, own))
        return out

    def for_tasks(self) -> Model:
        """What tasks need to write ids: byte pieces, the unknown piece, and the lengths of pieces."""
        slim = Model.__new__(Model)
        slim.bytes, slim.unknown, slim.length = self.bytes, self.unknown, self.length
        return slim

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.useful, "piece string, id int, score double")


class Cutter:
    """Cuts texts into units: between neighbouring characters that no piece holds side by side."""

    def __init__(self, model: Model) -> None:
        joined = sorted({pair for piece, _, _ in model.useful for pair in zip(piece, piece[1:])})
        number = {c: i + 1 for i, c in enumerate(sorted({c for pair in joined for c in pair}))}
        self.letter = np.zeros(0x110000, dtype=np.uint16)
        self.wide = len(number) + 1
        for c, i in number.items():
            self.letter[ord(c)] = i
        self.joins = np.zeros((len(number) + 1, len(number) + 1), dtype=bool)
        for a, b in joined:
            self.joins[number[a], number[b]] = True
        self.prefix = SPACE if model.dummy_prefix else ""

    def cut(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """The prepared text of all rows, the start of each unit and the end of the last, unit hashes, and each row's first unit."""
        rows = [(self.prefix + t.replace(" ", SPACE)) if t else "" for t in texts]
        whole = "".join(rows)
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        codes = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        ids, starts = self.letter[codes], np.ones(len(codes), dtype=bool)
        starts[1:] = ~self.joins.ravel().take(ids[:-1].astype(np.int64) * self.wide + ids[1:])
        starts[bounds[bounds < len(codes)]] = True
        edges = np.append(np.flatnonzero(starts), len(codes))
        return whole, edges, code_hashes(codes, edges), np.searchsorted(edges[:-1], bounds)


@cache
def _code_values() -> np.ndarray:
    """A number for every character, a table that each process makes once."""
    return mix(np.arange(0x110000, dtype=U64) + U64(77))


def code_hashes(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the characters between neighbouring edges."""
    values = _code_values()
    at = edges[:-1]
    hashes = np.zeros(len(at), dtype=U64)
    first, step = 0, 1 << 18
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + step, side="right")) - 1)
        low = edges[first]
        up, down = POWERS.upto(int(edges[last] - low))
        terms = values.take(codes[low : edges[last]])
        terms *= up[: len(terms)]
        hashes[first:last] = np.add.reduceat(terms, at[first:last] - low) * down[at[first:last] - low]
        first = last
    return mix(hashes ^ np.diff(edges).astype(U64))


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, a place of each (any one), and how often each occurs."""
    order = np.argsort(hashes)
    ranked = hashes[order]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    return ranked[heads], order[heads], np.diff(np.append(heads, len(ranked)))


def _give_back() -> None:
    """Returns freed memory of a worker to the system; idle workers stay alive beside the executor's own heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _some_rows(column: pa.Array, limit: int = 300_000) -> Iterator[tuple[int, list[str]]]:
    sizes = np.concatenate([[0], np.cumsum(np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False)))]).astype(np.int64)
    for first, last in pieces(sizes, limit):
        yield first, [t or "" for t in column.slice(first, last - first).to_pylist()]


def count_units(texts: DataFrame, cutter: Cutter) -> DataFrame:
    """(unit, n) over all texts."""

    def counted(texts: list[str], found: list[tuple]) -> pa.RecordBatch:
        """The units of some texts, each once."""
        own, n, text, begin, end = map(np.concatenate, zip(*found))
        _, first, which = np.unique(own, return_index=True, return_inverse=True)
        units = [texts[k][a:b] for k, a, b in zip(text[first].tolist(), begin[first].tolist(), end[first].tolist())]
        total = np.bincount(which, n, len(first)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(total)], ["unit", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1 << 12):
            texts, found = [], []
            for _, rows in _some_rows(batch.column(0)):
                whole, edges, hashes, _ = cutter.cut(rows)
                own, first, n = _distinct(hashes)
                found.append((own, n, np.full(len(own), len(texts)), edges[first], edges[first + 1]))
                texts.append(whole)
                if sum(map(len, texts)) >= COUNTED:
                    yield counted(texts, found)
                    texts, found = [], []
            if texts:
                yield counted(texts, found)
            _give_back()

    return texts.mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def _units_of_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """(keys, parts, counts, sizes, edges) of whole units, from rows (key, part, n, edge) where a unit's edges lie one after another and its first has the part."""
    held: list[pa.RecordBatch] = []
    rows, last, ended = 0, None, set()

    def whole() -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column(0).to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        first = table.take(pa.array(heads))
        if len(again := set(key[heads].tolist())) < len(heads) or again & ended or first.column(1).null_count:
            raise ValueError("edges of a unit do not lie together")
        ended.update(again)
        return *(first.column(k).combine_chunks() for k in range(3)), np.diff(np.append(heads, len(key))), table.column(3).to_numpy()

    for batch in batches:
        if not batch.num_rows:
            continue
        if rows >= EDGES:
            # What belongs to the unit that the rows before end with still goes to them.
            key = batch.column(0).to_numpy()
            cut = int(np.argmax(key != last)) if (key != last).any() else len(key)
            held.append(batch.slice(0, cut))
            batch = batch.slice(cut)
            if batch.num_rows:
                yield whole()
                held, rows = [], 0
        if batch.num_rows:
            held.append(batch)
            rows, last = rows + batch.num_rows, batch.column(0)[-1].as_py()
    if held:
        yield whole()


def _segment(parts: DataFrame, model: Model, tasks: int, together: bool) -> DataFrame:
    """(key, part, n, ids) of units given in parts: key, n, part, base (where the part begins) and left (characters from there on).

    A part covers the places of its first ``LONG`` characters and holds what pieces from there may reach;
    of several parts any one is returned. ``together`` tells that each key, a long, has one part, so that its edges stay together as they are made.
    """
    spark = parts.sparkSession
    table = F.broadcast(model.table(spark).select("piece", "id"))  # as many rows as the model file has pieces
    # Lengths worth trying from a place: those of the pieces that begin with its three characters, else one and two.
    reach: dict[str, set[int]] = {}
    for piece, _, _ in model.useful:
        if len(piece) >= 3:
            reach.setdefault(piece[:3], {1, 2}).add(len(piece))
    ahead = F.broadcast(spark.createDataFrame([(k, sorted(v)) for k, v in reach.items()], "ahead string, lengths array<int>"))
    places = F.sequence(F.lit(0), F.least(F.col("left"), F.lit(LONG)) - 1)
    begun = parts.repartition(tasks, "key").select("*", F.explode(places).alias("at"))
    begun = begun.withColumn("ahead", F.expr("substring(part, at + 1, 3)")).join(ahead, "ahead", "left")
    lengths = F.coalesce("lengths", F.array(F.lit(1), F.lit(2)))
    spans = begun.select("key", "n", "part", "base", "left", "at", F.explode(lengths).alias("long")).where(F.col("long") <= F.col("left") - F.col("at"))
    keyed = spans.withColumn("piece", F.expr("substring(part, at + 1, long)"))
    edges = keyed.join(table, "piece", "left").where("id is not null or long = 1")
    # An edge is one number: its end, what its length lacks to 255, and its id from 1 (0: no piece), so that sorting
    # brings edges in the order of Viterbi's rule, by end and then by start, and rows of numbers are small to group.
    end = (F.col("base") + F.col("at") + F.col("long")).cast("long")
    edge = end * (1 << 32) + (255 - F.col("long")).cast("long") * (1 << 24) + F.coalesce(F.col("id") + 1, F.lit(0))
    if together:
        grouped = edges.select("key", F.when((F.col("at") == 0) & (F.col("long") == 1), F.col("part")).alias("part"), "n", edge.alias("edge"))
    else:
        grouped = edges.groupBy("key").agg(F.first("part").alias("part"), F.first("n").alias("n"), F.collect_list(edge).alias("edges"))
    # Scores by id from 1.
    by_id = np.full(max((i for _, i, _ in model.useful), default=-1) + 2, model.unknown_score)
    for _, i, own in model.useful:
        by_id[i + 1] = own
    scores = spark.sparkContext.broadcast(by_id)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, pa.Array, np.ndarray, np.ndarray]]:
        for batch in small(batches, 1 << 13):
            sizes = batch.column(3).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last in pieces(np.concatenate([[0], np.cumsum(sizes)]), EDGES):
                part = batch.slice(first, last - first)
                yield *part.columns[:3], sizes[first:last], part.column(3).flatten().to_numpy(zero_copy_only=False)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *columns, sizes, edges in (_units_of_edges if together else lists)(batches):
            counts, ids = best_paths(sizes, edges, scores.value)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], ["key", "part", "n", "ids"])
        _give_back()

    schema = grouped.select("key", "part", "n", F.array().cast("array<int>").alias("ids")).schema
    return grouped.mapInArrow(fold, schema)


def best_paths(sizes: np.ndarray, edges: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the best path of each unit: how many, and the ids one after another; ``sizes`` tells how many edges belong to each.

    Ends are settled from left to right, for all units at once. Of equal sums the longest last piece wins.
    """
    unit = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((edges, unit))
    edges = edges[order]  # the units stay where they are
    end, long, id_ = edges >> 32, 255 - ((edges >> 24) & 255), edges & ((1 << 24) - 1)
    lengths = np.zeros(len(sizes), np.int64)
    np.maximum.at(lengths, unit, end)
    begin = np.cumsum(lengths + 1) - lengths - 1
    place = begin[unit] + end
    # Edges of one end of one unit are a group; groups are settled by end.
    heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    many = np.diff(np.append(heads, len(place)))
    turn = np.argsort(end[heads], kind="stable")
    cuts = np.searchsorted(end[heads][turn], np.arange(1, int(end.max(initial=0)) + 2))
    gain, top, way = scores[id_], np.zeros(int((lengths + 1).sum())), np.zeros(int((lengths + 1).sum()), np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        some = turn[a:b]
        each = many[some]
        starts = np.cumsum(each) - each
        at = np.repeat(heads[some] - starts, each) + np.arange(int(each.sum()))
        total = top[place[at] - long[at]] + gain[at]
        best = np.maximum.reduceat(total, starts)
        hit = np.flatnonzero(total == np.repeat(best, each))
        group = np.repeat(np.arange(len(some)), each)[hit]
        chosen = at[hit[np.concatenate([[True], group[1:] != group[:-1]])]]
        top[place[chosen]], way[place[chosen]] = best, chosen
    # From the last ends back to the beginnings.
    left, at, walked, whose = np.flatnonzero(lengths), lengths.copy(), [], []
    while len(left):
        taken = way[begin[left] + at[left]]
        walked.append(taken)
        whose.append(left)
        at[left] -= long[taken]
        left = left[at[left] > 0]
    if not walked:
        return np.zeros(len(sizes), np.int64), np.zeros(0, np.int32)
    path = np.sort(np.concatenate(walked))  # edges lie by unit and end
    return np.bincount(np.concatenate(whose), minlength=len(sizes)), (id_[path] - 1).astype(np.int32)


def lattice(units: DataFrame, model: Model) -> DataFrame:
    """(unit, n, ids): the best segmentation of each distinct unit of a stored table; -1 stands for a character without piece.

    Of equal sums the one whose last piece is longest wins, at every end. Units are numbered, so that edges are
    grouped by a number. Rows of units longer than ``LONG`` characters carry a digest and a part of the unit; the
    unit itself comes back by a join.
    """
    if model.longest > 255:
        raise ValueError("pieces are longer than 255 characters")
    size = F.length("unit")
    total, longest = units.agg(F.sum(F.length("unit")), F.max(F.length("unit"))).first()
    tasks = 1 + (total or 0) // TASK_CHARACTERS
    usual = units.where(size <= LONG).select(F.monotonically_increasing_id().alias("key"), "n", F.col("unit").alias("part"), F.lit(0).alias("base"), size.alias("left"))
    segmented = _segment(usual, model, tasks, True).select(F.col("part").alias("unit"), "n", "ids")
    if (longest or 0) <= LONG:
        return segmented
    large = units.where(size > LONG).withColumn("key", F.sha2(F.col("unit").cast("binary"), 256))
    parts = large.select("key", "n", "unit", F.explode(F.sequence(F.lit(0), size - 1, F.lit(LONG))).alias("base")).select(
        "key", "n", F.expr(f"substring(unit, base + 1, {LONG + model.longest})").alias("part"), "base", (size - F.col("base")).alias("left")
    )
    return segmented.unionByName(_segment(parts, model, tasks, False).select("key", "ids").join(large, "key").select("unit", "n", "ids"))


class Common:
    """The frequent units as sorted hashes with their ids one after another."""

    buckets: np.ndarray | None = None

    def __init__(self, model: Model, units: list[str], ids: list[list[int]]) -> None:
        hashes = np.concatenate([unit_hashes(units[i : i + 50_000]) for i in range(0, len(units), 50_000)] or [np.zeros(0, U64)])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        full = [with_bytes(model, units[i], ids[i]) for i in order.tolist()]
        self.ends = np.cumsum([0, *[len(x) for x in full]]).astype(np.int64)
        self.ids = np.fromiter((v for x in full for v in x), dtype=np.int32, count=int(self.ends[-1]))

    @classmethod
    def of(cls, model: Model, units: pa.Array, ids: pa.ListArray, rows: int = 1 << 13) -> Common:
        """The same from columns, where units may repeat, with few units as Python objects at a time."""
        hashes, sizes, flat = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for first in range(0, len(units), rows):
            names, own = units.slice(first, rows).to_pylist(), ids.slice(first, rows)
            each, values = own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), own.flatten().to_numpy(zero_copy_only=False)
            bare = np.unique(np.repeat(np.arange(len(names)), each)[values < 0])
            if len(bare):  # units with a character without piece
                begin = np.cumsum(each) - each
                full = [with_bytes(model, names[k], values[begin[k] : begin[k] + each[k]].tolist()) for k in bare.tolist()]
                kept = np.ones(len(names), bool)
                kept[bare] = False
                values = np.concatenate([values[np.repeat(kept, each)], *full]).astype(np.int32)
                order = np.concatenate([np.flatnonzero(kept), bare])
                each = np.concatenate([each[kept], [len(x) for x in full]])
                names = [names[k] for k in order.tolist()]
            hashes.append(unit_hashes(names))
            sizes.append(each)
            flat.append(values)
        hashes, sizes, flat = map(np.concatenate, (hashes, sizes, flat))
        out, begin = cls(model, [], []), np.cumsum(sizes) - sizes
        out.hashes, order = np.unique(hashes, return_index=True)
        out.ends = np.concatenate([[0], np.cumsum(sizes[order])]).astype(np.int64)
        out.ids = flat[np.arange(out.ends[-1]) + np.repeat(begin[order] - out.ends[:-1], sizes[order])]
        return out


def unit_hashes(units: list[str]) -> np.ndarray:
    """Hashes of single units, as ``Cutter.cut`` gives them."""
    codes = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32)
    return code_hashes(codes, np.concatenate([[0], np.cumsum([len(u) for u in units])]).astype(np.int64))


def with_bytes(model: Model, unit: str, ids: list[int]) -> list[int]:
    """Ids of a unit with byte pieces, or the unknown piece, for characters without piece."""
    if -1 not in ids:
        return list(ids)
    out, at = [], 0
    for i in ids:
        if i >= 0:
            out.append(i)
            at += model.length[i]
        else:
            out += [model.bytes[b] for b in unit[at].encode()] if model.bytes else [model.unknown]
            at += 1
    return out


def _lookup(common: Common, distinct: np.ndarray) -> np.ndarray:
    """Place of each hash among the frequent units, -1 for others."""
    out = np.full(len(distinct), -1)
    if not len(common.hashes):
        return out
    bits = max(1, len(common.hashes).bit_length())
    if common.buckets is None:  # where the hashes of each leading number begin
        common.buckets = np.searchsorted(common.hashes, np.arange(1 << bits, dtype=U64) << U64(64 - bits))
        common.buckets = np.append(common.buckets, len(common.hashes)).astype(np.int32)
    lead = (distinct >> U64(64 - bits)).view(np.int64)
    at, end, left = common.buckets[lead], common.buckets[lead + 1], np.flatnonzero(common.buckets[lead] < common.buckets[lead + 1])
    while len(left):
        here = at[left]
        same = common.hashes[here] == distinct[left]
        out[left[same]] = here[same]
        left = left[~same]
        at[left] += 1
        left = left[at[left] < end[left]]
    return out


def encode(docs: DataFrame, model_path: str, common: int = COMMON, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids) per row: piece ids of the whole text, the segmentation with the largest sum of scores.

    A null or empty text has no ids. A character without piece becomes its bytes. Repeated rows and
    rows without id are encoded like others and returned as often as given; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    model = Model(model_path)
    cutter = Cutter(model)
    rows = pick(docs, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with settings(spark, SETTINGS):
        found = keep(lattice(keep(count_units(rows.select("text"), cutter), "units"), model), "segmented", codec="zstd")
    # The frequent ones: bounded by ``common`` rows. Ties at the edge go by the unit.
    total = found.count()
    if total > common:
        least = found.select("n", F.xxhash64("unit").alias("place"), "unit", "ids").orderBy(F.desc("n"), "unit").limit(common)
    else:
        least = found
    shown = least.select("unit", "ids").toArrow()
    table = spark.sparkContext.broadcast(Common.of(model, shown["unit"].combine_chunks(), shown["ids"].combine_chunks()))
    del shown
    _give_back()
    tools = spark.sparkContext.broadcast((cutter, model.for_tasks()))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, known = tools.value[0], table.value
        for batch in small(batches):
            for first, texts in _some_rows(batch.column(1)):
                whole, edges, hashes, begins = cutter.cut(texts)
                row = np.repeat(np.arange(len(texts)), np.diff(begins))
                left = np.flatnonzero(_lookup(known, hashes) < 0)
                _, once, _ = _distinct(mix(hashes[left]) ^ row[left].astype(U64))
                left = left[once]
                units = [whole[a:b] for a, b in zip(edges[left].tolist(), edges[left + 1].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + row[left])), pa.array(units, pa.string())], ["key", "unit"])
            _give_back()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for part in small(batches, ROWS):
            packed = [None if t is None else len(b := t.encode()).to_bytes(8, "little") + codec.compress(b, asbytes=True) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], ["key", "doc_id", "packed"])
        _give_back()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (cutter, model), known, codec = tools.value, table.value, pa.Codec("zstd")
        for batch in small(batches, ROWS):
            texts = [None if p is None else codec.decompress(p[8:], int.from_bytes(p[:8], "little"), asbytes=True).decode() if p[:8] != bytes(8) else "" for p in batch.column(1).to_pylist()]
            for first, part in _some_rows(pa.array(texts, pa.large_string())):
                _, _, hashes, begins = cutter.cut(part)
                place = _lookup(known, hashes)
                extra = batch.column(2).slice(first, len(part)).flatten()
                more = Common.of(model, extra.field("unit"), extra.field("ids"))
                beyond = place < 0
                other = _lookup(more, hashes[beyond])
                if (other < 0).any():
                    raise ValueError("a unit was not segmented")
                start, each = known.ends[place], known.ends[place + 1] - known.ends[place]
                start[beyond], each[beyond] = len(known.ids) + more.ends[other], more.ends[other + 1] - more.ends[other]
                at = np.arange(each.sum()) + np.repeat(start - np.cumsum(each) + each, each)
                far = np.flatnonzero(at >= len(known.ids))
                flat = known.ids.take(at, mode="clip") if len(known.ids) else np.zeros(len(at), np.int32)
                flat[far] = more.ids[at[far] - len(known.ids)]
                ends = np.concatenate([[0], np.cumsum(each)])[begins]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], ["doc_id", "ids"])
            _give_back()

    keyed = rows.select(F.coalesce("doc_id", F.xxhash64("text")).alias("key"), "doc_id", "text")
    if total <= common:
        packed = keyed.mapInArrow(pack, "key long, doc_id long, packed binary").select("doc_id", "packed", F.lit(None).cast("array<struct<unit:string,ids:array<int>>>").alias("extra"))
        return keep(packed.mapInArrow(write, "doc_id long, ids array<int>"), "encoded", codec="zstd")
    with settings(spark, SETTINGS):
        asked = keyed.select("key", "text").mapInArrow(rare, "key long, unit string")
        extra = keep(asked.join(found.select("unit", "ids"), "unit").groupBy("key").agg(F.collect_list(F.struct("unit", "ids")).alias("extra")), "extra", codec="zstd")
    # Every document is in one slice, all rows of an id in the same.
    encoded, own = None, F.pmod(F.xxhash64("key"), F.lit(SLICES))
    for number in range(SLICES):
        # Written here, so that no task runs this step's worker beside one of the next step.
        with settings(spark, SETTINGS):
            packed = keyed.where(own == number).mapInArrow(pack, "key long, doc_id long, packed binary")
            joined = packed.join(extra.where(own == number), "key", "left").select("doc_id", "packed", "extra")
            written = keep(joined.mapInArrow(write, "doc_id long, ids array<int>"), "encoded", codec="zstd")
        encoded = written if encoded is None else encoded.unionByName(written)
    return encoded


def decode(encoded: DataFrame, model_path: str, ids_column: str = "ids") -> DataFrame:
    """The same rows with a column ``text`` for the ids; null ids give a null text, bytes that are no UTF-8 become U+FFFD."""
    model = Model(model_path)
    prefix = model.dummy_prefix
    body = np.frombuffer(b"".join(model.surface), dtype=np.uint8)
    size = np.array([len(x) for x in model.surface], dtype=np.int64)
    begin = np.cumsum(size) - size
    rest = encoded.drop("text")
    schema = rest.withColumn("text", F.lit("")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids_column))
            texts = []
            for at in range(0, len(column), 256):
                part = column.slice(at, 256)
                ids = part.flatten().to_numpy(zero_copy_only=False)
                each = size[ids]
                inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                whole = body[np.repeat(begin[ids], each) + inside].tobytes()
                tokens = np.concatenate([[0], np.cumsum(part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(each)])[tokens].tolist()
                for a, b, given in zip(ends, ends[1:], part.is_valid().to_pylist()):
                    first = a + 1 if prefix and whole[a : a + 1] == b" " and b > a else a
                    texts.append(whole[first:b].decode("utf-8", "replace") if given else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])
        _give_back()

    return rest.mapInArrow(read, schema)
