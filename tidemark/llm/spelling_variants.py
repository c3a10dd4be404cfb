"""Spelling variants by finite-state composition: vocabulary acceptor, one-edit transducer, vocabulary acceptor.

Two words of the vocabulary A are near if the composition A o E o A, E the transducer of exactly one inserted,
deleted or replaced character, accepts the pair. The composition is cut at its initial states. A pair with
shorter length n either has its edit behind the first n // 2 characters, then both words share that
beginning, or before, then they share the other end of n - n // 2 characters. So each word goes, once as the
shorter and once as the longer word, to the state its beginning leads to in the acceptor, and to the state its end
leads to in the acceptor of reversed words. What lies behind such an initial state is a partition of its own,
and every near pair is found in exactly one.

A task minimises the acceptors of many initial states at once (equal right languages become one state) and
enumerates the composed machine level by level in numpy: equal steps, one edit, equal steps. A word's index is
the sum of skipped words along its path, as in a minimal perfect hash. A pair of states without common lengths
left is dropped at once. Initial states with more than ``STATE_WORDS`` words are not enumerated in one task:
there the state behind each possible edit becomes a row (what stands before and behind it), and rows meet in
joins whose groups are bounded by the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import keep, pick

#: Fixed values of the word rule: letters are A-Z, a-z and U+00C0 to U+00FF.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most words behind an initial state that one task enumerates, words of one machine, and rows of a frontier.
STATE_WORDS = 50_000
MACHINE_WORDS = 50_000
FRONTIER = 1 << 18
#: What has been read behind an initial state, where no symbol: nothing yet, several symbols, or it does not matter.
EMPTY, MIXED, FREE = -1, -2, -3


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, damage: int | None = 31, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): lowered runs of letters with at least ``least_length`` characters and ``least_count`` occurrences.

    With ``damage`` d, a run whose crc32 of ``doc_id:run`` d divides loses the character at crc32 modulo its
    length (a null id counts as empty). Null texts have no words.
    """
    # A run that is too short stays too short.
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{LETTERS}{{{least_length},}}"), 0)
    rows = pick(docs, doc_id=id_column, text=text_column).select("doc_id", F.explode(runs).alias("run"))
    word = F.translate("run", UPPER, LOWER)
    if damage is not None:
        rows = rows.select(word.alias("run"), F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), word).cast("binary")).alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.expr("left(run, cast(h % length(run) as int))"), F.substr("run", at + 2))
        word = F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run"))
    words = rows.select(word.alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _initial_states(words: DataFrame) -> DataFrame:
    """(state, short, rest, word, n): each word behind its initial states, ``rest`` in the direction of reading.

    ``short`` is the length of the shorter word's rest.
    """
    length, parts = F.length("word"), []
    for longer in (0, 1):
        short = length - longer
        half = F.floor(short / 2).cast("int")
        ahead = (F.lit("f"), F.expr(f"left(word, cast(floor((length(word) - {longer}) / 2) as int))"), F.substr("word", half + 1), short - half)
        back = (F.lit("b"), F.reverse(F.substr("word", half + 1 + longer)), F.reverse(F.expr(f"left(word, cast(floor((length(word) - {longer}) / 2) as int) + {longer})")), half)
        for way, start, rest, left in (ahead, back):
            parts.append(F.struct(F.concat_ws(":", way, short.cast("string"), start).alias("state"), left.cast("int").alias("short"), rest.alias("rest")))
    rows = words.where(F.col("word").rlike(r"^[\x00-\xFF]+$")).select("word", "n", F.explode(F.array(*parts)).alias("at"))
    return rows.select("word", "n", "at.*").select("state", "short", F.encode("rest", "ISO-8859-1").alias("rest"), "word", "n")


class Machine:
    """The minimal acceptors of many initial states, from rows sorted by (state, rest).

    ``start`` is the minimal state of each initial one. A state's arcs are sorted by symbol; ``skip`` is the
    number of words that the state accepts before those through the arc. ``low`` and ``high`` are the
    lengths of the shortest and longest word it accepts.
    """

    def __init__(self, group: np.ndarray, body: np.ndarray, bounds: np.ndarray) -> None:
        sizes = np.diff(bounds)
        words, first = len(sizes), bounds[:-1]
        shared = np.full(words, -1, np.int64)  # characters shared with the word before
        same = np.flatnonzero(group[1:] == group[:-1]) + 1
        depth = 0
        while len(same):
            shared[same] = depth
            same = same[(sizes[same] > depth) & (sizes[same - 1] > depth)]
            same = same[body[first[same] + depth] == body[first[same - 1] + depth]]
            depth += 1
        # The trie: words open one state for each character they do not share.
        here, nodes = np.arange(words), 0
        levels, parents, symbols, final = [], [], [], []
        state = np.zeros(words, np.int64)
        depth = 0
        while len(here):
            opened = shared[here] < depth
            number = nodes + np.cumsum(opened) - 1
            if depth:
                parents.append(state[here][opened])
                symbols.append(body[first[here[opened]] + depth - 1].astype(np.int64))
            state[here] = number
            levels.append(np.arange(nodes, nodes + int(opened.sum())))
            nodes += int(opened.sum())
            final.append(number[sizes[here] == depth])
            here = here[sizes[here] > depth]
            depth += 1
        roots = len(levels[0])
        parent = np.concatenate(parents) if parents else np.zeros(0, np.int64)
        symbol = np.concatenate(symbols) if symbols else np.zeros(0, np.int64)
        ends = np.zeros(nodes, bool)
        ends[np.concatenate(final)] = True
        # Height, number of accepted words, shortest and longest word, from the leaves up.
        height = np.zeros(nodes, np.int64)
        count = ends.astype(np.int64)
        low = np.where(ends, 0, np.iinfo(np.int32).max).astype(np.int64)
        high = np.where(ends, 0, -1).astype(np.int64)
        for level in reversed(levels[1:]):
            up = parent[level - roots]
            np.maximum.at(height, up, height[level] + 1)
            np.add.at(count, up, count[level])
            np.minimum.at(low, up, low[level] + 1)
            np.maximum.at(high, up, high[level] + 1)
        # Arcs in the order of (parent, symbol): children of a state are opened in that order.
        arcs = np.argsort(parent, kind="stable")
        arc_from, arc_symbol, arc_to = parent[arcs], symbol[arcs], arcs + roots
        at = np.searchsorted(arc_from, np.arange(nodes + 1))
        degree = np.diff(at)
        # Minimise: states of one height are equal if they end alike and have the same arcs to the same classes.
        kind, classes = np.zeros(nodes, np.int64), 0
        order = np.argsort(height, kind="stable")
        cuts = np.searchsorted(height[order], np.arange(int(height.max(initial=0)) + 2))
        for h in range(len(cuts) - 1):
            some = order[cuts[h] : cuts[h + 1]]
            code = ends[some].astype(np.int64)
            base, place = 2, 0
            while True:
                more = np.flatnonzero(degree[some] > place)
                if not len(more):
                    break
                arc = at[some[more]] + place
                _, which = np.unique((code[more] * 256 + arc_symbol[arc]) * (classes + 1) + kind[arc_to[arc]], return_inverse=True)
                code[more] = base + which
                base += int(which.max()) + 1
                place += 1
            _, which = np.unique(code, return_inverse=True)
            kind[some] = classes + which
            classes += int(which.max(initial=-1)) + 1
        model = np.zeros(classes, np.int64)  # one trie state of each class
        model[kind] = np.arange(nodes)
        self.start = kind[:roots]
        self.base = np.flatnonzero(shared < 0)  # the first word of each initial state
        self.low, self.high = low[model], high[model]
        # The arcs of the minimal machine.
        self.degree = degree[model]
        self.at = np.concatenate([[0], np.cumsum(self.degree)])
        source = np.repeat(at[model] - self.at[:-1], self.degree) + np.arange(int(self.at[-1]))
        self.symbol, self.to = arc_symbol[source], kind[arc_to[source]]
        passed = count[arc_to[source]]
        before = np.cumsum(passed) - passed
        owner = np.repeat(np.arange(classes), self.degree)
        self.skip = before - before[self.at[:-1][owner]] + ends[model][owner]
        self.key = owner * 256 + self.symbol

    def arcs(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All arcs of the given states: the place in ``states`` each comes from, and its number."""
        degree = self.degree[states]
        before = np.cumsum(degree) - degree
        return np.repeat(np.arange(len(states)), degree), np.arange(int(degree.sum())) + np.repeat(self.at[states] - before, degree)

    def accepts(self, state: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether words of that length remain; behind an initial state only two neighbouring lengths do."""
        return (self.low[state] == length) | (self.high[state] == length)

    def pairs(self, short: np.ndarray, back: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indices of near words; ``short`` is the shorter word's length behind each initial state.

        Where ``back``, the state is one of reversed words. A character that could as well be deleted in front of
        all others there leaves the first halves alike, so the state of their beginning finds that pair.
        """
        state, word, left = self.start, self.base, short.astype(np.int64)
        run = np.where(back, EMPTY, FREE)
        while len(state):
            # Cut by the pairs of arcs a state can bring, so that memory is bounded.
            work = np.cumsum(self.degree[state] ** 2 + 1)
            first = 0
            while first < len(state):
                last = max(first + 1, int(np.searchsorted(work, (work[first - 1] if first else 0) + FRONTIER, side="right")))
                yield from self._edited(state[first:last], word[first:last], left[first:last], run[first:last])
                first = last
            owner, arc = self.arcs(state)
            run, symbol = run[owner], self.symbol[arc]
            run = np.where(run == FREE, FREE, np.where((run == EMPTY) | (run == symbol), symbol, MIXED))
            state, word, left = self.to[arc], word[owner] + self.skip[arc], left[owner] - 1

    def _edited(self, state: np.ndarray, word: np.ndarray, left: np.ndarray, run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """One edit at the given states, then equal steps to the end."""
        owner, arc = self.arcs(state)
        target, index, remain = self.to[arc], word[owner] + self.skip[arc], left[owner]
        # Replaced: two arcs of one state, each with the shorter length behind it.
        fit = np.flatnonzero(self.accepts(target, remain - 1) & (remain > 0))
        sizes = np.bincount(owner[fit], minlength=len(state))
        group_end = np.cumsum(sizes)[owner[fit]]
        follow = group_end - np.arange(len(fit)) - 1
        one = np.repeat(np.arange(len(fit)), follow)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(follow) - follow, follow)
        one, two = fit[one], fit[two]
        none = np.full(len(one), -1)
        # Deleted: the longer word takes an arc, the shorter one stays. It must go on with another symbol, or the
        # edit lies further on and is found there.
        elsewhere = (run[owner] == EMPTY) | (run[owner] == self.symbol[arc])
        gone = np.flatnonzero(self.accepts(target, remain) & self.accepts(state[owner], remain) & ~elsewhere)
        yield from self._finished(
            np.concatenate([target[one], target[gone]]), np.concatenate([index[one], index[gone]]),
            np.concatenate([target[two], state[owner[gone]]]), np.concatenate([index[two], word[owner[gone]]]),
            np.concatenate([remain[one] - 1, remain[gone]]), np.concatenate([none, self.symbol[arc[gone]]]),
        )

    def _finished(self, p, i, q, j, left, barred) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while len(p):
            over = left == 0
            if over.any():
                # Words that end here are the first of their states.
                yield i[over], j[over]
                p, i, q, j, left, barred = (x[~over] for x in (p, i, q, j, left, barred))
            owner, arc = self.arcs(q)
            allowed = self.symbol[arc] != barred[owner]
            owner, arc = owner[allowed], arc[allowed]
            asked = p[owner] * 256 + self.symbol[arc]
            place = np.minimum(np.searchsorted(self.key, asked), max(len(self.key) - 1, 0))
            found = self.key[place] == asked if len(self.key) else np.zeros(0, bool)
            owner, arc, place = owner[found], arc[found], place[found]
            p2, q2, left2 = self.to[place], self.to[arc], left[owner] - 1
            good = self.accepts(p2, left2) & self.accepts(q2, left2)
            owner, arc, place = owner[good], arc[good], place[good]
            p, i, q, j = p2[good], i[owner] + self.skip[place], q2[good], j[owner] + self.skip[arc]
            left, barred = left2[good], np.full(len(owner), -1)


def _near_words(rows: pa.Table) -> pa.RecordBatch:
    """(word, n_near, best_n, best) of the words of whole initial states, sorted by (state, rest)."""
    state = pc.dictionary_encode(rows.column("state").combine_chunks()).indices.to_numpy()
    rest = rows.column("rest").combine_chunks().cast(pa.large_binary())
    _, offsets, data = rest.buffers()
    bounds = np.frombuffer(offsets, np.int64)[rest.offset : rest.offset + len(rest) + 1]
    body = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    machine = Machine(state, body, bounds - bounds[0])
    # Most frequent first, then by code points: a smaller rank is the better form.
    order = pc.sort_indices(rows, sort_keys=[("n", "descending"), ("word", "ascending")]).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    near, best = np.zeros(len(order), np.int64), np.full(len(order), len(order), np.int64)
    back = pc.starts_with(rows.column("state"), "b").to_numpy()
    for i, j in machine.pairs(rows.column("short").to_numpy()[machine.base], back[machine.base]):
        for a, b in ((i, j), (j, i)):
            near += np.bincount(a, minlength=len(near))
            np.minimum.at(best, a, rank[b])
    some = np.flatnonzero(near)
    chosen = pa.array(order[best[some]])
    return pa.RecordBatch.from_arrays(
        [rows.column("word").take(pa.array(some)).combine_chunks(), pa.array(near[some]),
         rows.column("n").take(chosen).combine_chunks(), rows.column("word").take(chosen).combine_chunks()],
        ["word", "n_near", "best_n", "best"],
    )


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of sorted rows; machines are cut between initial states."""
    held: list[pa.RecordBatch] = []
    count, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        states = batch.column("state")
        if count >= MACHINE_WORDS:
            changed = np.flatnonzero(pc.not_equal(states, pa.scalar(last, states.type)).to_numpy(zero_copy_only=False))
            if len(changed):
                cut = int(changed[0])
                yield _near_words(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, count, batch = [], 0, batch.slice(cut)
        held.append(batch)
        count += batch.num_rows
        last = batch.column("state")[batch.num_rows - 1].as_py()
    if held:
        yield _near_words(pa.Table.from_batches(held))


def _composed(rows: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) within each initial state."""
    return rows.repartition("state").sortWithinPartitions("state", "rest").mapInArrow(_enumerate, "word string, n_near long, best_n long, best string")


def _behind_edits(rows: DataFrame) -> DataFrame:
    """The same for initial states with many words: one row for each state behind a possible edit, joined on it."""
    rows = rows.withColumn("rest", F.decode("rest", "ISO-8859-1"))
    spots = F.sequence(F.lit(1), F.length("rest"))
    cut = rows.select("state", "short", "word", "n", F.length("rest").alias("size"), "rest", F.posexplode(spots).alias("before", "spot"))
    without = cut.select("state", "short", "word", "n", "size", "before", "rest", F.substring("rest", F.col("spot"), F.lit(1)).alias("symbol"),
                         F.concat(F.expr("left(rest, before)"), F.substr("rest", F.col("spot") + 1)).alias("others"))
    replaced = without.where("size = short").select("state", "before", "others", "word", "n")
    a, b = replaced, replaced.select("state", "before", "others", F.col("word").alias("best"), F.col("n").alias("best_n"))
    pairs = a.join(b, ["state", "before", "others"]).where("word != best").select("word", "n", "best", "best_n")
    # The last place of a run of equal symbols stands for all places of the run.
    next_one = F.substring("others", F.col("before") + 1, F.lit(1))
    uniform = F.replace(F.expr("left(rest, before + 1)"), F.col("symbol"), F.lit("")) == ""
    deleted = without.where("size = short + 1").where((next_one != F.col("symbol")) & ~(F.col("state").startswith("b") & uniform)).select("state", "others", "word", "n")
    shorter = rows.where("length(rest) = short").select("state", F.col("rest").alias("others"), F.col("word").alias("best"), F.col("n").alias("best_n"))
    longer = deleted.join(shorter, ["state", "others"]).select("word", "n", "best", "best_n")
    pairs = pairs.union(longer).union(longer.select(F.col("best").alias("word"), F.col("best_n").alias("n"), F.col("word").alias("best"), F.col("n").alias("best_n")))
    return pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("top")).select(
        "word", "n_near", (-F.col("top.less")).alias("best_n"), "top.best"
    )


def near_words(words: DataFrame, state_words: int = STATE_WORDS) -> DataFrame:
    """(word, n, n_near, best, best_n) for a table of distinct (word, n): how many words are near, and the most frequent of them.

    Ties of n go to the smallest word in code-point order; without near words ``best`` is null.
    """
    rows = _initial_states(words)
    sizes = keep(rows.groupBy("state").agg(F.count("*").alias("many")).where(F.col("many") > state_words).select("state"), "hot")
    if sizes.isEmpty():
        found = _composed(rows)
    else:
        found = _composed(rows.join(sizes, "state", "left_anti").select(*rows.columns)).union(_behind_edits(rows.join(sizes, "state", "left_semi").select(*rows.columns)))
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    both = own.unionByName(found.withColumn("n", F.lit(None).cast("long")))
    # A smaller struct is the better form; null ones do not count.
    top = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))))
    return both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), top.alias("top")).select(
        "word", "n", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms are at least ten times as frequent, so that chains are short. Each round doubles the steps."""
    now = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = keep(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def spelling_variants(words: DataFrame, times: int = 10, state_words: int = STATE_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n for a table of distinct (word, n).

    Words are near if one inserted, deleted or replaced character tells them apart. A word's form is its near word
    of largest n (ties: smallest in code-point order) if that is at least ``times`` the word's n, else null; its
    root is where forms lead, the word itself without one. Only letters up to U+00FF take part. Words may
    be of any length; an empty table gives an empty result.
    """
    if times < 2:
        raise ValueError("a form has to be more frequent than its variants, so that chains end")
    near = near_words(words, state_words)
    good = F.col("best_n") >= times * F.col("n")
    found = keep(near.select("word", F.when(good, F.col("best")).alias("form"), "n", "n_near", F.when(good, F.col("best_n")).alias("form_n")), "near")
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, least_length: int = 7, least_count: int = 2, times: int = 10, damage: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """:func:`spelling_variants` of the words of whole texts."""
    return spelling_variants(keep(word_counts(docs, least_length, least_count, damage, id_column, text_column), "words"), times)
