"""Searches over vectors, conversations, pieces, components and the pipeline."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGE, SMALL
from tidemark.llm import ann_search, topk_search
from tidemark.llm.ann_search import nearest
from tidemark.llm.components import components
from tidemark.llm import pieces
from tidemark.llm.pieces import Model, decode, encode
from tidemark.llm.preference_format import END, HEAD, NECK, format_preferences, neighbour_pairs
from tidemark.llm.queries import PIECES
from tidemark.llm.topk_search import top_products

VECTORS = "vec_id long, embedding array<float>, score string, vector string"


def products(rows, k, every, scale=256):
    data = [(i, np.floor(scale * np.array(v, np.float32).astype(float))) for i, v in rows]
    out = {}
    for i, q in data:
        if i % every == 0:
            scores = sorted((-int(q @ x), j) for j, x in data if j != i)[:k]
            out[i] = [(j, -s) for s, j in scores]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_products_with_many_units_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "UNIT_QUERIES", 7)
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(5, 4)) * 3
    rows = [(i, (centre[i % 5] + rng.normal(size=4) * 0.2).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)]  # equal vectors: ties by id
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)
    assert answers(top_products(df, k=5, every=10)) == products(rows, 5, 10)


def test_products_with_repeated_query_ids(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "UNIT_QUERIES", 1)
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(3)
    sphere = lambda: (lambda v: v / np.linalg.norm(v))(rng.normal(size=4))
    ids = [r["id"] for r in spark.range(1, 3000).orderBy(F.xxhash64("id")).collect()]
    hot = [i for i in ids if i % 10 == 0][:3]  # their copies are pivots, as pivots are chosen by the ids' hashes
    other = [i for i in ids[ids.index(hot[-1]) + 1 :] if i % 10][:600]
    rows = [(i, sphere().astype(np.float32).tolist()) for i in other]
    rows += [(i, v) for i in hot for v in [(sphere() * 1.01).astype(np.float32).tolist()] for _ in range(8)]
    rows += [(5000, [0.01 * j, 0.5, 0.5, 0.5]) for j in range(30)]  # copies that differ: the smallest asks
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)
    data = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows]
    want = {}
    for q in {i for i, _ in data if i % 10 == 0}:
        asks = np.array(min(tuple(x) for i, x in data if i == q))
        want[q] = [(j, -s) for s, j in sorted((-int(asks @ x), j) for j, x in data if j != q)[:5]]
    assert answers(top_products(df, k=5, every=10)) == want


def test_vector_edge_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]),
        (5, [0.5]), (6, [0.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, []),
    ]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)
    found = answers(top_products(df, k=10, every=50))
    assert found == {0: [(7, 65536), (7, 65536), (5, 32768), (6, 0), (8, 0)]}
    near = answers(nearest(df, k=10, every=100))
    assert [(i, round(s, 6)) for i, s in near[0]] == [(7, 0.0), (7, 0.0), (5, 0.5)]
    empty = df.limit(0)
    assert top_products(empty).count() == 0 and nearest(empty).count() == 0
    only = df.where("vec_id = 0")
    assert top_products(only).count() == 0 and nearest(only).count() == 0


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann_search, "CHUNK", 200)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[100:140] = x[99]
    df = spark.createDataFrame([(i, v.tolist(), "x", "y") for i, v in enumerate(x)], VECTORS)
    found = answers(nearest(df, k=10, every=100))
    hits = 0
    for q, got in found.items():
        far = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        far[q] = np.inf
        assert all(abs(far[i] - s) < 1e-9 for i, s in got) and len(got) == 10
        hits += len({i for i, _ in got} & set(np.lexsort((np.arange(3000), far))[:10].tolist()))
    assert hits / (10 * len(found)) >= 0.9
    assert [i for i, _ in found[100]] == [99, *range(101, 110)]


def test_recall_on_the_table(spark, small):
    table = small("embeddings")
    ids = np.array([r["vec_id"] for r in table.collect()])
    x = np.array([r["embedding"] for r in table.collect()], dtype=float)
    hits = total = 0
    for q, got in answers(nearest(table)).items():
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        hits += len({i for i, _ in got} & set(ids[np.lexsort((ids, far))[:10]].tolist()))
        total += 10
    assert hits / total >= 0.9


# Conversations -----------------------------------------------------------------------------------

PAIRS = "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string, a string, b string"


def test_preference_pairs(spark):
    hello, one, two = ("user", "Hallo 東京"), ("assistant", "eins"), ("assistant", "zwei drei")
    rows = [(1, [hello, one], [hello, two]), (2, [hello, one], [hello, one]), (3, [one], []), (4, None, [hello]), (5, [hello, one, hello], [hello])]
    out = {r["pair_id"]: r for r in format_preferences(spark.createDataFrame([(*r, "p", "a", "b") for r in rows], PAIRS)).collect()}
    assert [out[i]["n_common"] for i in range(1, 6)] == [1, 2, 0, 0, 1]
    assert out[1]["prompt"] == f"{HEAD}user{NECK}Hallo 東京<|end|>\n"
    for r in out.values():
        for side in ("chosen", "rejected"):
            text, head = r[side], f"{HEAD}assistant{NECK}"
            assert len(r[f"{side}_spans"]) == text.count(head)
            for s in r[f"{side}_spans"]:
                assert text[: s["start"]].endswith(head) and text[s["start"] : s["end"]].count(END) == 1 and text[: s["end"]].endswith(END)
    assert out[2]["chosen"] == out[2]["rejected"] == "" and out[2]["chosen_spans"] == []
    assert out[4]["chosen"] == "" and out[4]["rejected"].startswith(HEAD + "user")


def test_conversation_edge_rows(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, "late"), (2, 0, "assistant", "x"), (None, 0, "user", "lost"), (4, 0, "user", "")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    out = {r["pair_id"]: r for r in format_preferences(neighbour_pairs(turns)).collect()}
    assert sorted(out) == [1, 2, 4]
    assert out[1]["n_common"] == 2 and out[1]["rejected"] == f"{HEAD}assistant{NECK}x<|end|>\n"
    assert out[4]["prompt"] == "" and out[4]["rejected"] == ""
    assert format_preferences(neighbour_pairs(turns.limit(0))).count() == 0


# Pieces ------------------------------------------------------------------------------------------


def best_score(model, text):
    """Largest sum of scores over the whole prepared text, without cutting it."""
    table = {p: s for p, _, s in model.normal}
    whole = "▁" + text.replace(" ", "▁")
    best = [0.0] + [-np.inf] * len(whole)
    for end in range(1, len(whole) + 1):
        best[end] = best[end - 1] + table.get(whole[end - 1], model.unknown_score)
        for start in range(max(0, end - model.longest), end - 1):
            if (score := table.get(whole[start:end])) is not None:
                best[end] = max(best[end], best[start] + score)
    return best[-1]


@pytest.mark.parametrize("common", [1 << 20, 50])
def test_pieces_are_the_best_and_decode_to_the_text(spark, make, small, common):
    model = Model(PIECES)
    rows = [(r["doc_id"], r["text"], None, None, 0) for r in small("documents").limit(40).collect()]
    rows += [(1000, "a  b   c\n\n\td ", None, None, 0), (1001, "😀 naïve ▁ 東京\u0000", None, None, 0), (1002, "", None, None, 0), (1003, None, None, None, 0), (None, "no id", None, None, 0), (1004, "x" * 20_000, None, None, 0)]
    encoded = encode(make(rows), PIECES, common=common)
    texts = {r[0]: r[1] for r in rows}
    scores = {i: s for _, i, s in model.normal}
    out = decode(encoded, PIECES).collect()
    assert len(out) == len(rows)
    for r in out:
        text = texts[r["doc_id"]]
        assert r["text"] == (text or "").replace("▁", " ")
        if not text:
            assert r["ids"] == []
        elif len(text) < 5000 and all(i in scores for i in r["ids"]):
            assert sum(scores[i] for i in r["ids"]) == pytest.approx(best_score(model, text), abs=1e-3)


def test_words_agree_with_the_library(make):
    """The library's own list of best segmentations, with the model read as one of scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as files

    proto = files.ModelProto()
    with open(PIECES, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = files.TrainerSpec.UNIGRAM
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    words = ["the", "segmentation", "Straße", "naïve", "international", "querying", "x1y2", "Überraschung", "répondre", "niñez"]
    scores = {i: p.score for i, p in enumerate(proto.pieces)}
    out = encode(make([(i, w, None, None, 0) for i, w in enumerate(words)]), PIECES).collect()
    for r in out:
        best = library.nbest_encode_as_ids(words[r["doc_id"]], 4)[0]
        assert sum(scores[i] for i in r["ids"]) == pytest.approx(sum(scores[i] for i in best))


def test_long_units_reach_the_best_sum(make):
    """Runs without a place to cut, longer than a part: every part border lies inside a unit."""
    model = Model(PIECES)
    scores = {i: s for _, i, s in model.normal}
    texts = ["-" * 255, "-" * 257, "=" * 1000, "-" * 20_000, "international" * 400, "ab-" * 300 + "é" * 600]
    out = decode(encode(make([(i, t, None, None, 0) for i, t in enumerate(texts)]), PIECES), PIECES).collect()
    assert len(out) == len(texts)
    for r in out:
        text = texts[r["doc_id"]]
        assert r["text"] == text
        assert all(i in scores for i in r["ids"])
        assert sum(scores[i] for i in r["ids"]) == pytest.approx(best_score(model, text), abs=1e-3)


def test_piece_edge_rows(make):
    assert encode(make(EDGE), PIECES).count() == len(EDGE)
    assert decode(encode(make([]), PIECES), PIECES).count() == 0


# Components and the pipeline ---------------------------------------------------------------------


def test_components_of_chains_stars_and_cycles(spark):
    rng = np.random.default_rng(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, j) for j in range(501, 560)] + [(1, 2), (2, 3), (3, 1), (7, 7), (9, 8)]
    links = [links[i] for i in rng.permutation(len(links))] + [(None, 4), (5, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)} | {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, small):
    import corpus_pipeline as pipeline
    from tests.llm.test_documents import base, classes

    docs = small("documents").union(spark.createDataFrame([(9001, "", None, None, 0), (9002, "?? 12 !!", "en", None, 8)], small("documents").schema)).cache()
    tables = [docs]
    for name, stage in pipeline.STAGES:
        out = stage(spark, tables[-1], SMALL)
        tables.append(pipeline.keep(out, "stage"))
    rows = [t.collect() for t in tables]
    assert [t.columns for t in tables[1:5]] == [list(pipeline.COLUMNS)] * 4
    # Letterless texts go, the others stay.
    assert {r["doc_id"] for r in rows[0]} - {r["doc_id"] for r in rows[1]} == {9001, 9002}
    want = classes([(r["doc_id"], r["text"]) for r in rows[1]], 5, 80)
    assert {r["doc_id"] for r in rows[2]} == {doc for doc, (_, least) in want.items() if doc == least}
    assert {r["doc_id"] for r in rows[3]} == {r["doc_id"] for r in rows[2]} and not any(base(r["text"]) for r in rows[3])
    assert sorted(r["doc_id"] for r in rows[4]) == sorted(r["doc_id"] for r in rows[5])
    back = {r["doc_id"]: r["text"] for r in decode(tables[5], PIECES).collect()}
    assert back == {r["doc_id"]: r["text"] for r in rows[4]}
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
        assert empty.count() == 0
    docs.unpersist()


def test_one_row_of_repeated_ids_and_of_copies_without_id_stays(spark, make):
    import corpus_pipeline as pipeline

    text = lambda name: " ".join(f"{name}{i}" for i in range(30))
    rows = [(1, text("a"), "en", "s", 9)] * 3 + [(2, text("b"), "en", "s", 9), (3, text("b"), "en", "s", 9), (3, text("b"), "en", "s", 9)]
    rows += [(None, text("c"), "en", "s", 9)] * 4 + [(None, text("a"), "en", "s", 9), (None, text("d"), "en", "s", 9), (None, text("d") + " more", "en", "s", 9)]
    rows += [(5, text("e"), "en", "s", 9), (None, "", None, None, 0), (None, "", None, None, 0), (None, None, None, None, None)]
    out = pipeline.drop_near_duplicates(spark, make(rows), SMALL)
    assert out.columns == list(pipeline.COLUMNS)
    got = sorted((r["doc_id"] or 0, (r["text"] or "")[:1]) for r in out.collect())
    assert got == [(0, "")] * 3 + [(0, "c"), (0, "d"), (1, "a"), (2, "b"), (5, "e")]


def test_no_step_of_the_encoder_shuffles_all_texts(spark, make, small, monkeypatch):
    """Documents are put together in slices, and shuffle files go after each; the session's settings come back."""
    steps, own = [], pieces.keep

    def keep(df, name, **how):
        stored = own(df, name, **how)
        steps.append((name, stored.count(), [spark.conf.get(x) for x in pieces.SETTINGS]))
        return stored

    monkeypatch.setattr(pieces, "keep", keep)
    before = [spark.conf.get(x) for x in pieces.SETTINGS]
    rows = [tuple(r) for r in small("documents").select("doc_id", "text", "lang", "source", "n_chars").limit(200).collect()]
    assert encode(make(rows), PIECES, common=1).count() == len(rows)
    counts = [n for name, n, _ in steps if name == "encoded"]
    assert sum(counts) == len(rows) and max(counts) < len(rows) / 2
    assert all(values == list(pieces.SETTINGS.values()) for _, _, values in steps)
    assert [spark.conf.get(x) for x in pieces.SETTINGS] == before


def test_the_last_stage_decodes_what_it_encodes(spark, make):
    import corpus_pipeline as pipeline

    texts = {1: "a  b naïve 東京", 2: "😀 word\n\tword", 3: ""}
    out = pipeline.encode_pieces(spark, make([(i, t, None, None, 0) for i, t in texts.items()]), SMALL)
    assert {r["doc_id"]: r["decoded_sha256"] for r in out.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def test_rows_of_the_pipeline_table_keep_their_types(small):
    assert dict(small("documents").select(F.col("doc_id")).dtypes) == {"doc_id": "bigint"}
