"""Conversation structure repair by weighted CYK parsing over intervals of turns.

The language of good conversations, role initials ``(s?(ua)+)?``, is read by an automaton with the states START,
SYSTEM, USER, ASSISTANT. The repair grammar in Chomsky normal form has one nonterminal N[p,q] for each pair
of states: what takes the automaton from p to q.

    N[p,q] -> N[p,r] N[r,q]                  two neighbouring intervals
    N[p,q] -> row                            kept, given another role, or deleted (p = q)
    N[p,q] -> nothing                        inserted turns, closed under repetition

An interval's chart cell holds for each N[p,q] the smallest (cost, audit). The closure of insertions is applied
to both ends of each row, so longer intervals only need the binary rule. As each N[p,q] passes some state at
every inner border, one border per interval is enough: intervals are combined bottom-up, lengths 1, 2, 4 and so
on, which takes as many steps as a conversation has turns and keeps a logarithm of open cells. The order
on (cost, audit) carries over to joined intervals, because audits of one interval with equal cost have as
many letters of each kind of cost, and so none is the beginning of another.

Spark shuffles twice by conversation. The first time narrow codes of the rows come sorted by place, are parsed
and give one audit. The second time the texts come in the same order behind their audit, and the repaired rows
are written and hashed as they pass. Both passes stream: memory holds the open cells, one audit and a batch
of rows, however long a conversation is. A digest of a whole conversation is sequential by nature, so
the rows of one conversation do meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import keep, pick

START, SYSTEM, USER, ASSISTANT = range(4)
#: The automaton of good conversations: (state, role initial) to state. It ends in START (nothing) or ASSISTANT.
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows whose cell is looked up by their codes instead of being parsed again, and how many such cells are held.
MEMO_ROWS, MEMO_CELLS = 8, 4_000

Cell = dict[tuple[int, int], tuple[int, str]]


def _better(cell: Cell, at: tuple[int, int], value: tuple[int, str]) -> None:
    if at not in cell or value < cell[at]:
        cell[at] = value


def joined(left: Cell, right: Cell) -> Cell:
    """N[p,q] -> N[p,r] N[r,q] for two neighbouring intervals."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for (s, q), (more, rest) in right.items():
            if r == s:
                _better(out, (p, q), (cost + more, audit + rest))
    return out


def insertions() -> Cell:
    """N[p,q] -> nothing: the cheapest inserted user and assistant turns from p to q, none where p = q."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    while True:
        more = dict(cell)
        for (p, r), (cost, audit) in cell.items():
            for (state, role), q in STEPS.items():
                if state == r and role != "s":
                    _better(more, (p, q), (cost + INSERT, audit + "I"))
        if more == cell:
            return cell
        cell = more


_CLOSED = insertions()


@lru_cache(maxsize=64)
def row_cell(initial: str, fault: str) -> Cell:
    """The cell of one row: its edits, between closed insertions. ``fault`` is "" or b(lank), d(uplicate), t(runcated)."""
    edits: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if fault not in ("b", "d"):
        extra = TRUNCATED if fault == "t" else 0
        for (p, role), q in STEPS.items():
            if role != "s":
                _better(edits, (p, q), (REROLE + extra, "R"))
            if role == initial:
                _better(edits, (p, q), (KEEP + extra, "K"))
    return joined(joined(_CLOSED, edits), _CLOSED)


@lru_cache(maxsize=MEMO_CELLS)
def _few(codes: tuple[tuple[str, str], ...]) -> Cell:
    if len(codes) == 1:
        return row_cell(*codes[0])
    half = len(codes) // 2
    return joined(_few(codes[:half]), _few(codes[half:]))


class Chart:
    """Cells of growing intervals: neighbours of equal length are joined as soon as both are there."""

    def __init__(self) -> None:
        self.codes: list[tuple[str, str]] = []
        self.open: list[tuple[int, Cell]] = []

    def add(self, initial: str, fault: str) -> None:
        self.codes.append((initial, fault))
        if len(self.codes) == MEMO_ROWS:
            self._close()

    def _close(self) -> None:
        length, cell = len(self.codes), _few(tuple(self.codes))
        self.codes = []
        while self.open and self.open[-1][0] == length:
            length, cell = 2 * length, joined(self.open.pop()[1], cell)
        self.open.append((length, cell))

    def best(self) -> tuple[int, str]:
        """(cost, audit) of the cheapest repair."""
        if self.codes:
            self._close()
        whole = None
        for _, cell in reversed(self.open):
            whole = cell if whole is None else joined(cell, whole)
        return (0, "") if whole is None else min(whole[START, end] for end in ENDS if (START, end) in whole)


def _conversations(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """Rows of sorted batches as tuples, with whether another conversation begins."""
    before: tuple | None = None
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            part = batch.slice(low, 512)
            for row in zip(*(part.column(c).to_pylist() for c in columns)):
                yield (row[0],) != before, row
                before = (row[0],)


def _parsed(kind: pa.DataType) -> Callable:
    """One row per conversation from its sorted row codes."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    kinds = [kind, *[pa.int64()] * 6, pa.string()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now = None

        def end() -> None:
            if now is not None:
                cost, audit = now["chart"].best()
                gaps = now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
                done.append((now["id"], gaps, now["b"], now["d"], now["t"], now["illegal"], cost, audit))

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in done], kinds[i]) for i in range(len(names))]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        size = 0
        for new, (conv, turn, initial, fault, there) in _conversations(batches, ["conv_id", "turn", "initial", "fault", "there"]):
            if new:
                end()
                size += len(done[-1][-1]) + 64 if done else 0
                if size > 1 << 20:
                    yield flush()
                    size = 0
                now = {"id": conv, "chart": Chart(), "low": None, "high": None, "turns": 0, "before": None, "b": 0, "d": 0, "t": 0, "illegal": 0}
            if not there:
                continue
            if turn is not None and turn != now["high"]:
                now["low"] = turn if now["low"] is None else now["low"]
                now["high"], now["turns"] = turn, now["turns"] + 1
            if now["before"] is not None and now["before"] + initial not in ("su", "ua", "au"):
                now["illegal"] += 1
            now["before"] = initial
            if fault:
                now[fault] += 1
            now["chart"].add(initial, fault)
        end()
        if done:
            yield flush()

    return parse


class _Writer:
    """Writes a repaired conversation row by row along its audit; ``emit`` gets (role, text) of each row that stays."""

    def __init__(self, audit: str, emit: Callable[[str, str], None]) -> None:
        self.audit, self.at, self.emit = audit, 0, emit
        self.written, self.system = 0, (len(audit) - audit.count("D")) % 2

    def _role(self) -> str:
        return "assistant" if (self.written - self.system) % 2 else "user"

    def insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.emit(self._role(), "")
            self.written, self.at = self.written + 1, self.at + 1

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.emit(role if edit == "K" else self._role(), text)
            self.written += 1


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    """Rows of a conversation together in a task, in their order: turn (nulls first), role, digest of the text, copy."""
    return rows.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), *first, F.col("turn").asc_nulls_first(), "role", "mark", "copy"
    )


def _numbered(turns: DataFrame) -> DataFrame:
    """Own columns with defaults: null roles and texts are one space; ``copy`` tells equal rows apart."""
    return turns.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))}).withColumn("mark", F.md5(F.col("text").cast("binary")))


def _codes(rows: DataFrame) -> DataFrame:
    """Narrow codes of the rows: role initial (~ for none and for those no edit may keep) and their own fault."""
    letters = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    own = F.when(F.length(letters) == 0, "b").when(~F.substring(letters, -1, 1).isin(".", "!", "?"), "t").otherwise("")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("~")
    return rows.select("conv_id", "turn", "role", "mark", "copy", "there", initial.alias("initial"), own.alias("own"))


def repair_conversations(
    turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text",
    there_column: str | None = None,
) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 per conversation.

    Rows are taken by turn (nulls first), rows of one turn by role and digest of the text. Null roles and texts
    are one space. A row's first fault counts: blank, a role and text seen earlier in the conversation,
    or a last character other than ``.!?``. ``audit`` names the cheapest edits (Keep, Rerole, Delete, Insert)
    after which the role initials are ``(s?(ua)+)?``, ties by the ASCII-least. An empty role has no initial and is
    never kept. Rows without conversation id are one conversation. Rows where ``there_column`` is false only
    name their conversation; one without other rows has zeros, an empty audit and the digest of nothing.
    Very long conversations and texts stream; an empty table gives an empty result.
    """
    rows = _source(turns, conv_column, turn_column, role_column, text_column, there_column)
    kind = pa.int64() if dict(rows.dtypes)["conv_id"] == "bigint" else pa.string()
    audits = keep(_audits(rows, kind), "audits")
    conv = rows.schema["conv_id"].dataType.simpleString()
    return _with_texts(rows, audits).mapInArrow(
        _hashed(kind), f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    )


def repaired_turns(
    turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text",
    there_column: str | None = None,
) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations themselves, places from 0, by the same rules."""
    rows = _source(turns, conv_column, turn_column, role_column, text_column, there_column)
    kind = pa.int64() if dict(rows.dtypes)["conv_id"] == "bigint" else pa.string()
    conv = rows.schema["conv_id"].dataType.simpleString()
    return _with_texts(rows, keep(_audits(rows, kind), "audits")).mapInArrow(_written(kind), f"conv_id {conv}, place long, role string, text string")


def _source(turns: DataFrame, conv: str, turn: str, role: str, text: str, there: str | None) -> DataFrame:
    rows = pick(turns, conv_id=conv, turn=turn, role=role, text=text, **({"there": there} if there else {}))
    if dict(rows.dtypes)["conv_id"] in ("int", "smallint", "tinyint"):
        rows = rows.withColumn("conv_id", F.col("conv_id").cast("long"))
    elif dict(rows.dtypes)["conv_id"] != "bigint":
        rows = rows.withColumn("conv_id", F.col("conv_id").cast("string"))
    rows = rows.withColumns({"turn": F.col("turn").cast("long"), "role": F.col("role").cast("string"), "text": F.col("text").cast("string")})
    if there is None:
        rows = rows.withColumn("there", F.lit(True))
    return _numbered(rows).withColumn("copy", F.lit(0))


def _audits(rows: DataFrame, kind: pa.DataType) -> DataFrame:
    codes = _codes(rows).repartition("conv_id")
    # Equal rows of one turn have no order among them, so any of them may be the first.
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "mark", "there").orderBy(F.col("turn").asc_nulls_first())) > 1
    codes = codes.withColumn("fault", F.when(F.col("own") == "b", "b").when(seen, "d").otherwise(F.col("own")))
    # Of equal rows in one turn, the one that counts as first has to come first.
    codes = codes.withColumn("copy", F.when(F.col("fault") == "d", 1).otherwise(0))
    conv = rows.schema["conv_id"].dataType.simpleString()
    ordered = codes.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "mark", "copy")
    return ordered.select("conv_id", "turn", "initial", "fault", "there").mapInArrow(
        _parsed(kind), f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    )


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _with_texts(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows of each conversation behind the row with its audit."""
    texts = rows.where("there").select("conv_id", F.lit(1).alias("first"), "turn", "role", "mark", "copy", "text", F.lit(None).cast("struct<gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string>").alias("about"))
    heads = audits.select("conv_id", F.lit(0).alias("first"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("mark"), F.lit(0).alias("copy"),
                          F.lit(None).cast("string").alias("text"), F.struct(*_COUNTS).alias("about"))
    return _ordered(texts.unionByName(heads), "first").select("conv_id", "first", "role", "text", "about")


def _hashed(kind: pa.DataType) -> Callable:
    names = ["conv_id", *_COUNTS, "repaired_sha256"]
    kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        writer = digest = head = None
        size = 0

        def emit(role: str, text: str) -> None:
            digest.update((f"\n{role}:" if writer.written else f"{role}:").encode())
            digest.update(text.encode())

        def end() -> None:
            writer.insert()
            done.append((*head, digest.hexdigest()))

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in done], kinds[i]) for i in range(len(names))]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for new, (conv, first, role, text, about) in _conversations(batches, ["conv_id", "first", "role", "text", "about"]):
            if new:
                if writer is not None:
                    end()
                    size += len(head[-1]) + 128
                    if size > 1 << 20:
                        yield flush()
                        size = 0
                head, digest = (conv, *(about[c] for c in _COUNTS)), hashlib.sha256()
                writer = _Writer(about["audit"], emit)
            else:
                writer.row(role, text)
        if writer is not None:
            end()
            yield flush()

    return run


def _written(kind: pa.DataType) -> Callable:
    names, kinds = ["conv_id", "place", "role", "text"], [kind, pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        writer = now = None

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in out], kinds[i]) for i in range(len(names))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        def emit(role: str, text: str) -> None:
            out.append((now, writer.written, role, text))

        for new, (conv, first, role, text, about) in _conversations(batches, ["conv_id", "first", "role", "text", "about"]):
            if new:
                if writer is not None:
                    writer.insert()
                now, writer = conv, _Writer(about["audit"], emit)
            else:
                writer.row(role, text)
            if len(out) >= 512:
                yield flush()
        if writer is not None:
            writer.insert()
            yield flush()

    return run


def damaged(turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """conv_id, turn, role, text and ``there``: the rows after one of five damages drawn by crc32 of ``conv_id:turn``, nulls as one space.

    Of 20 remainders 0 drops a row (``there`` is false, so that its conversation stays known), 1 empties its
    text, 2 takes out ``.!?``, 3 repeats it, 4 makes it the user's; the others leave it.
    """
    rows = pick(turns, conv_id=conv_column, turn=turn_column, role=role_column, text=text_column)

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    role = F.when(draw == 4, "user").otherwise(shown("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (draw != 0).alias("there"), F.explode(F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("time"))
    return out.drop("time")
