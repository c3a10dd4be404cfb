"""Spelling variants, benchmark decontamination and conversation repair: against brute force, and on edge rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGE, SMALL
from tidemark.llm import decontamination
from tidemark.llm import spelling_variants as variants
from tidemark.llm.conversation_repair import Chart, damaged, repair_conversations, repaired_turns
from tidemark.llm.decontamination import decontaminate, item_windows, scan_contamination
from tidemark.llm.queries import op11_spelling_variants, op12_benchmark_decontamination, op13_conversation_repair
from tidemark.llm.shared import Words, as_bytes
from tidemark.llm.spelling_variants import near_words, spelling_groups, spelling_variants, word_counts

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# Spelling variants -------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def expected_variants(counts, times=10):
    """All pairs of words, then forms and roots by the rule."""
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[word] = best if best is not None and counts[best] >= times * counts[word] else None
    out = {}
    for word in counts:
        root = word
        while form[root] is not None:
            root = form[root]
        out[word] = (form[word], root, counts[word], len(near[word]), counts[form[word]] if form[word] else None)
    return out


def found_variants(table):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in table.collect()}


def damaged_counts(rows, least_length=7, least_count=2):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least_count}


def test_variants_of_the_documents(spark, small):
    counts = damaged_counts([(r["doc_id"], r["text"]) for r in small("documents").collect()])
    assert found_variants(op11_spelling_variants(spark, SMALL)) == expected_variants(counts)


#: Runs of one letter, edits at both ends and in the middle, ties, a chain of forms, short and non-ASCII words.
WORDS = {
    "aaaaaaa": 3, "aaaaaaaa": 400, "aaaaaaaaa": 40, "baaaaaaa": 5, "aaaaaaab": 50, "abaaaaaa": 50, "aab": 2, "ab": 30, "b": 300, "a": 7,
    "colour": 50, "color": 600, "colours": 4, "colo": 5, "cölour": 2, "kolour": 5, "colouÿ": 5, "olour": 50, "col": 1, "cl": 1, "abab": 9, "baba": 99, "aba": 9, "bab": 990,
}


@pytest.mark.parametrize("state_words", [50_000, 1])
def test_edits_everywhere_by_machine_and_by_joins(spark, state_words):
    table = spark.createDataFrame(list(WORDS.items()), "word string, n long")
    assert found_variants(spelling_variants(table, state_words=state_words)) == expected_variants(WORDS)


@pytest.mark.parametrize("state_words", [50_000, 3])
def test_every_word_over_two_letters(spark, monkeypatch, state_words):
    """A dense vocabulary: all near pairs exactly once, also where machines and frontiers are cut."""
    monkeypatch.setattr(variants, "FRONTIER", 16)
    words = {"".join(w): 1 + i for size in range(1, 8) for i, w in enumerate(product("ab", repeat=size))}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: r["n_near"] for r in near_words(table, state_words).collect()}
    assert got == {w: sum(one_edit(w, v) for v in words if abs(len(v) - len(w)) < 2) for w in words}


def test_words_of_edge_texts(make, spark):
    long_word = "x" * 3_000
    rows = [*EDGE, (9, f"{long_word} {long_word} {long_word}y {long_word}y Straße STRASSE straßen", None, None, 0), (10, "×÷×÷×÷× " * 2, None, None, 0)]
    docs = make(rows)
    counts = damaged_counts([r[:2] for r in rows], 4)
    assert {r["word"]: r["n"] for r in word_counts(docs, 4).collect()} == counts
    assert found_variants(spelling_groups(docs, 4, damage=31)) == expected_variants(counts)
    assert spelling_groups(make([])).collect() == []


# Benchmark decontamination -----------------------------------------------------------------------


def expected_hits(docs, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        words = re.findall(WORD, lowered(text))
        for i in range(max(1, len(words) - width + 1) if words else 0):
            windows[tuple(words[i : i + width])].add(item)
    out = []
    for doc_id, text in docs:
        words, hit, held = re.findall(WORD, lowered(text)), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                found = windows.get(tuple(words[i : i + size]))
                if found is not None:
                    hit |= set(range(i, i + size))
                    held |= {str(x) for x in found if x is not None}
        out.append((doc_id, len(words), len(hit), tuple(sorted(held)), bool(hit)))
    return Counter(out)


def found_hits(table):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in table.collect())


def test_leaks_of_the_documents(spark, small):
    docs, items = small("documents"), small("benchmark")
    expected = expected_hits([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert found_hits(scan_contamination(docs, items)) == expected
    assert any(row[4] for row in expected) and not all(row[4] for row in expected)
    rows = {(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in op12_benchmark_decontamination(spark, SMALL).collect()}
    assert rows == {(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), c) for d, n, h, i, c in expected}


ITEMS = [
    (1, "One two three FOUR five six seven eight nine ten eleven twelve"), (2, "two, three. four-five six seven eight nine ten eleven"),
    (3, "short item"), (4, None), (5, "?!"), (6, ""), (3, "short item"), (None, "nameless item here"), (7, "Été naïve"), (10, "word word word word word word word word word word"), (8, "東京"),
]
LEAKY = [
    *EDGE, (20, "zero one two three four five six seven eight nine ten eleven twelve thirteen", None, None, 0), (21, "a Short\nITEM and a nameless item here, short item", None, None, 0),
    (22, "short", None, None, 0), (23, "item short été—naïve 東京", None, None, 0), (24, "one two three four five six seven eight nine", None, None, 0),
]


@pytest.mark.parametrize("block_pairs", [1 << 19, 3])
def test_leaks_in_awkward_texts_with_one_block_and_several(spark, make, block_pairs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("window", F.lit("clash"))
    assert found_hits(scan_contamination(make(LEAKY), items, block_pairs=block_pairs)) == expected_hits([r[:2] for r in LEAKY], ITEMS)
    assert not any(r["contaminated"] for r in scan_contamination(make(LEAKY), items.where("false")).collect())
    assert scan_contamination(make([]), items).collect() == []


def test_equal_hashes_are_told_apart_by_their_words(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "rolling", lambda hashes, width, stream: hashes[: max(0, len(hashes) - width + 1)] * 0)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    index = decontamination.Index(item_windows(items).toArrow())
    texts = [r[1] for r in LEAKY]
    body, bounds = as_bytes(pa.array(texts, pa.string()))
    words = Words(body, bounds, decontamination.IS_WORD)
    held = defaultdict(set)
    for _, at, which, sets in index.find(words, words.hashes(lower=True)):
        for row, one in zip(words.row[at].tolist(), which.tolist()):
            held[row] |= set(sets[one])
    expected = {i: set(items) for (i, _, _, items, _) in expected_hits(list(enumerate(texts)), ITEMS) if items}
    assert {k: v for k, v in held.items() if v} == expected


def test_passages_are_cut_or_documents_left_out(spark, make):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = make(LEAKY)
    cut = {r["doc_id"]: r["text"] for r in decontaminate(docs, items).collect()}
    assert decontaminate(docs, items).columns == docs.columns
    assert cut[20] == "zero  thirteen" and cut[21] == "a  and a " and cut[22] == "short" and cut[2] is None and cut[23] == "item short été—naïve "
    kept = {r["doc_id"] for r in decontaminate(docs, items, by="documents").collect()}
    assert kept == {1, 2, 3, 4, None, 6, 8, 22, 24}
    assert 7 in {r["doc_id"] for r in decontaminate(docs, items, by="documents", most_hit_share=0.5).collect()}
    with pytest.raises(ValueError):
        decontaminate(docs, items, by="words")


# Conversation repair -----------------------------------------------------------------------------

MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def expected_repair(rows):
    """Cheapest edits by growing prefixes with whole texts, from the rule's states."""
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\f\r")
        faults.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    now = {"": (0, "", ())}
    for place in range(len(rows) + 1):
        changed = True
        while changed:
            changed = False
            for state, (cost, audit, out) in list(now.items()):
                for role in ("user", "assistant"):
                    to, made = MOVES.get((state, role[0])), (cost + 2, audit + "I", (*out, f"{role}:"))
                    if to and (to not in now or made[:2] < now[to][:2]):
                        now[to], changed = made, True
        if place == len(rows):
            break
        _, role, text = rows[place]
        more = {}
        for state, (cost, audit, out) in now.items():
            ways = [(state, 3, "D", out)]
            if faults[place] in ("", "t"):
                extra = faults[place] == "t"
                ways.append((MOVES.get((state, role[:1])), extra, "K", (*out, f"{role}:{text}")))
                ways += [(MOVES.get((state, r[0])), 2 + extra, "R", (*out, f"{r}:{text}")) for r in ("user", "assistant")]
            for to, price, letter, made in ways:
                if to is not None and (to not in more or (cost + price, audit + letter) < more[to][:2]):
                    more[to] = (cost + price, audit + letter, made)
        now = more
    cost, audit, out = min((now[s] for s in ("", "a") if s in now), key=lambda x: x[:2])
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), list(out)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def found_repairs(table):
    return {r[0]: tuple(r)[1:] for r in table.collect()}


def test_repairs_of_the_conversations(spark, small):
    rows = defaultdict(list)
    for r in small("conversations").collect():
        conv, draw = rows[r["conv_id"]], zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        role, text = "user" if draw == 4 else r["role"], "" if draw == 1 else re.sub("[.!?]", "", r["text"]) if draw == 2 else r["text"]
        conv += [(r["turn"], role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    expected = {conv: expected_repair(in_order(found)) for conv, found in rows.items()}
    assert found_repairs(op13_conversation_repair(spark, SMALL)) == {conv: found for conv, (found, _) in expected.items()}
    turns = damaged(small("conversations"))
    written = defaultdict(dict)
    for r in repaired_turns(turns, there_column="there").collect():
        written[r["conv_id"]][r["place"]] = f"{r['role']}:{r['text']}"
    assert {c: [w[i] for i in range(len(w))] for c, w in written.items()} == {c: out for c, (_, out) in expected.items() if out}


#: Nulls in every column, one turn twice, unknown and empty roles, only system rows, blank and repeated rows, no fault at all.
TALKS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello!"), (1, 5, "user", "Bye"), (1, 6, "assistant", "See you."),
    (2, 0, "assistant", "First."), (2, 1, "system", "Late."), (2, 1, "user", "Same turn."), (2, 1, "assistant", "Same turn."), (2, 3, "tool", "Out."),
    (3, 0, "system", "Only rules."), (3, 1, "system", "Only rules."), (4, None, "user", "When?"), (4, None, "user", "When?"), (4, 2, None, "Who?"), (4, 3, "assistant", None),
    (5, 0, "", "No role."), (5, 1, "user", " \t\n"), (5, 2, "assistant", "ok"), (None, 0, "user", "Whose?"), (None, 1, "assistant", "Nobody's."), (6, 7, "user", "x" * 50_000 + "\n"),
    (7, 0, "user", "é "), (7, 1, "assistant", "…"), (7, 2, "user", "a.\r\n"), (8, 3, "assistant", "A."), (8, 4, "assistant", "B."), (8, 5, "assistant", "A."), (9, 0, None, None),
]


def test_repairs_of_awkward_conversations(spark):
    turns = spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string").withColumns({"fault": F.lit("clash"), "mark": F.lit("clash"), "first": F.lit(3)})
    rows = defaultdict(list)
    for conv, turn, role, text in TALKS:
        rows[conv].append((turn, " " if role is None else role, " " if text is None else text))
    assert found_repairs(repair_conversations(turns)) == {conv: expected_repair(in_order(found))[0] for conv, found in rows.items()}
    assert repair_conversations(turns.where("false")).collect() == []
    nothing = hashlib.sha256(b"").hexdigest()
    gone = repair_conversations(turns.withColumn("there", F.col("conv_id") != 1), there_column="there")
    assert found_repairs(gone)[1] == (0, 0, 0, 0, 0, 0, "", nothing)


def test_damage_of_rows_with_nulls(spark):
    turns = spark.createDataFrame([(c, t, r, x) for c in (None, 1, 2) for t in (None, *range(30)) for r, x in ((None, "a.b!"), ("assistant", None))], "conv_id long, turn long, role string, text string")
    expected = Counter()
    for c, t, r, x in (tuple(row) for row in turns.collect()):
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", x or " ") if draw == 2 else x or " "
        expected[(c, t, "user" if draw == 4 else r or " ", text, draw != 0)] += 2 if draw == 3 else 1
    assert Counter(tuple(r) for r in damaged(turns).collect()) == expected


def test_a_long_conversation_is_parsed_in_growing_intervals(spark):
    roles = ["user", "assistant", "system", "user", "user", "assistant", "tool"]
    rows = [(i, roles[i * i % 7], f"Turn {i % 900}{'.' if i % 3 else ''}") for i in range(2_000)]
    turns = spark.createDataFrame([("c", *r) for r in rows], "conv_id string, turn int, role string, text string").repartition(5)
    assert found_repairs(repair_conversations(turns)) == {"c": expected_repair(rows)[0]}
    chart = Chart()
    for i in range(10_000):
        chart.add("ua"[i % 2], "")
    assert len(chart.open) < 15 and chart.best() == (0, "K" * 10_000)
