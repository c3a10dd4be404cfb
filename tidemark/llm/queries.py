"""Registered queries of the operators over the given tables, and the SQL that has to agree with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.ann_search import nearest
from tidemark.llm.conversation_repair import damaged, repair_conversations
from tidemark.llm.decontamination import items_digest, scan_contamination
from tidemark.llm.language_id import held_out, identify_language
from tidemark.llm.language_id import train as train_language
from tidemark.llm.license_scan import scan_licenses
from tidemark.llm.mixing import mix_sources
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.pieces import decode, encode
from tidemark.llm.preference_format import format_preferences, neighbour_pairs
from tidemark.llm.secret_scan import KINDS, find_secrets, joined_spans
from tidemark.llm.spelling_variants import spelling_groups
from tidemark.llm.substring_dedup import remove_repeats
from tidemark.llm.topk_search import top_products

#: Where the public tokenizers lie; a parameter of the operator.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents")).drop("matches")


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return identify_language(docs, train_language(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), width=2, percent=80)


def op4_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return top_products(table(spark, folder, "embeddings"), k=5, every=50)


def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    encoded = encode(table(spark, folder, "documents"), PIECES)
    return decode(encoded, PIECES).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op7_preference_format(spark: SparkSession, folder: str) -> DataFrame:
    shown = format_preferences(neighbour_pairs(table(spark, folder, "conversations")))

    def text(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(spans)

    return shown.select("pair_id", "n_common", "prompt", "chosen", "rejected", text("chosen_spans"), text("rejected_spans"))


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS[:3])]
    base = joined_spans(F.filter("spans", lambda s: s["kind"] < 3))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


def op9_ann_search(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), k=10, every=100)


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"), width=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_groups(table(spark, folder, "documents"), least_length=7, least_count=2, times=10, damage=31)


def op12_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items_digest().alias("items_sha256"), "contaminated")


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, folder, "conversations")), there_column="there")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_language_id": op2_language_id,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_topk_search": op4_topk_search,
    "op5_mix_sources": op5_mix_sources,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_preference_format": op7_preference_format,
    "op8_secret_scan": op8_secret_scan,
    "op9_ann_search": op9_ann_search,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_benchmark_decontamination": op12_benchmark_decontamination,
    "op13_conversation_repair": op13_conversation_repair,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

ORACLES = {
    "op3_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws
        ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
           FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
         WHERE 100 * c >= 80 * (na.n + nb.n - c)),
step AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, t.b FROM reach r JOIN step t ON t.a = r.b)
SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a""",
    "op5_mix_sources": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS size,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0) || coalesce(text, chr(0))) || chr(31) || coalesce(source, chr(0))), 1, 15))::BIGINT AS hash
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
o AS (SELECT *, sum(source_size) OVER () AS total,
        coalesce(sum(source_size) OVER p, 0) AS size_before, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS weight_left,
        row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place
      FROM s WINDOW p AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(place) AS place FROM o WHERE weight * (total - 3 * size_before) <= 3 * source_size * weight_left),
l AS (SELECT o.place AS first_free, o.total - 3 * o.size_before AS rest, o.weight_left AS free_weight FROM o JOIN f USING (place)),
t AS (SELECT source, source_size, CASE WHEN place < first_free THEN (3 * source_size)::DOUBLE
        ELSE (weight * rest)::DOUBLE / free_weight END AS target FROM o, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS passes FROM t),
h AS (SELECT source, hash, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) AS upto, sum(size) AS own
      FROM d WHERE size > 0 GROUP BY source, hash),
m AS (SELECT h.source, h.hash FROM h JOIN p ON h.source IS NOT DISTINCT FROM p.source
      WHERE passes < 3 AND (upto <= target - passes * source_size
        OR (upto - own <= target - passes * source_size
            AND upto - (target - passes * source_size) < (target - passes * source_size) - (upto - own))))
SELECT d.doc_id, d.size, p.source_size, p.target, ((p.passes + (m.hash IS NOT NULL)::BIGINT) * d.size)::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN m ON m.source IS NOT DISTINCT FROM d.source AND m.hash = d.hash""",
    "op4_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_preference_format": r"""
WITH c AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, '')) AS t
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
a AS (SELECT conv_id, t, (SELECT max(i) FROM unnest(range(1, len(t) + 1)) AS u(i) WHERE t[i].role = 'assistant') AS answer FROM c),
p AS (SELECT a.conv_id AS pair_id, a.t AS x,
        a.t[1 : coalesce(a.answer, 1) - 1] || (CASE WHEN b.answer IS NULL THEN [] ELSE [b.t[b.answer]] END) AS y
      FROM a LEFT JOIN a b ON b.conv_id = a.conv_id + 1),
n AS (SELECT *, coalesce((SELECT min(i) FROM unnest(range(1, least(len(x), len(y)) + 1)) AS u(i) WHERE x[i] <> y[i]) - 1, least(len(x), len(y))) AS n_common FROM p),
s AS (SELECT pair_id, n_common, x[1 : n_common] AS z, x[n_common + 1 :] AS x, y[n_common + 1 :] AS y FROM n),
l AS (SELECT *, list_transform(x, lambda t: length(t.role) + length(t.text) + 13) AS lx, list_transform(y, lambda t: length(t.role) + length(t.text) + 13) AS ly FROM s)
SELECT pair_id, n_common::INTEGER AS n_common,
  coalesce(array_to_string(list_transform(z, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(x, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(y, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS rejected,
  coalesce((SELECT string_agg((coalesce(list_sum(lx[1 : i]), 0) - length(x[i].text) - 8)::BIGINT || ':' || list_sum(lx[1 : i])::BIGINT, ',' ORDER BY i)
            FROM unnest(range(1, len(x) + 1)) AS u(i) WHERE x[i].role = 'assistant'), '') AS chosen_spans,
  coalesce((SELECT string_agg((coalesce(list_sum(ly[1 : i]), 0) - length(y[i].text) - 8)::BIGINT || ':' || list_sum(ly[1 : i])::BIGINT, ',' ORDER BY i)
            FROM unnest(range(1, len(y) + 1)) AS u(i) WHERE y[i].role = 'assistant'), '') AS rejected_spans
FROM l""",
    "op10_substring_dedup": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(ws[i : i + 19], ' ')) ORDER BY doc_id, i) > 1 AS again FROM x),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
c AS (SELECT e.doc_id, e.word, e.i, max(coalesce(k.again, false)) OVER (PARTITION BY e.doc_id ORDER BY e.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
      FROM e LEFT JOIN k ON k.doc_id = e.doc_id AND k.i = e.i),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g ON g.doc_id = w.doc_id""",
}


# CRC-32 of text: the table of the reflected polynomial, then one look-up per byte.
_CRC_TABLE = """crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t
        FROM range(256) r(i))"""


def _crc(text: str) -> str:
    """The value for a text column, where the table ``crc`` is joined."""
    octets = f"list_transform(range(1, 2 * octet_length(encode({text})) + 1, 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295)"


_ITEM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
ORACLES |= {
    "op11_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
o AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, {_crc("named")} AS h FROM o, crc),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM v, unnest(range(length(word)::INT)) u(i)),
p AS (SELECT a.word, b.word AS other FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.rest UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.rest),
m AS (SELECT p.word, count(*) AS n_near, min({{'less': -v.n, 'other': p.other}}) AS top FROM p JOIN v ON v.word = p.other GROUP BY p.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.less >= 10 * v.n THEN top.other END AS form,
        CASE WHEN -top.less >= 10 * v.n THEN -top.less END AS form_n FROM v LEFT JOIN m USING (word)),
c(word, root) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near::BIGINT AS n_near, f.form_n
FROM f JOIN c ON c.word = f.word JOIN f e ON e.word = c.root WHERE e.form IS NULL""",
    "op12_benchmark_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, regexp_extract_all({_LOWER}, {_ITEM_WORDS}) AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, {_ITEM_WORDS}) AS ws FROM benchmark),
n AS (SELECT DISTINCT item, least(len(ws), 10) AS width, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i : i + 9], ' '))) AS window_text
      FROM b WHERE len(ws) > 0),
x AS (SELECT place, width, i, array_to_string(ws[i : i + width - 1], ' ') AS window_text
      FROM d, (SELECT DISTINCT width FROM n) k, unnest(range(1, len(ws) - width + 2)) u(i)),
h AS (SELECT x.place, x.width, x.i, n.item FROM x JOIN n USING (width, window_text)),
c AS (SELECT place, count(DISTINCT word) AS n_hit FROM (SELECT place, unnest(range(i, i + width)) AS word FROM (SELECT DISTINCT place, width, i FROM h)) GROUP BY place),
i AS (SELECT place, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY place)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (place) LEFT JOIN i USING (place)""",
    "op13_conversation_repair": rf"""
WITH {_CRC_TABLE},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS named FROM conversations),
h AS (SELECT * EXCLUDE (named), {_crc("named")} % 20 AS draw FROM o, crc),
g AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS again
      FROM h WHERE draw <> 0),
e AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) > 1 AS seen FROM g),
s AS (SELECT conv_id, turn, role, text, again, substr(role, 1, 1) AS initial,
        CASE WHEN ended = '' THEN 'b' WHEN seen THEN 'd' WHEN right(ended, 1) IN ('.', '!', '?') THEN '' ELSE 't' END AS fault FROM e),
l AS (SELECT conv_id, list({{'role': role, 'text': text, 'initial': initial, 'fault': fault}} ORDER BY turn NULLS FIRST, role, md5(text), again) AS rows,
        coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
        count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated FROM s GROUP BY conv_id),
-- The best (cost, audit) in each state after each row: start, system, user, assistant.
k AS (SELECT *, list_reduce(
        list_transform(rows, lambda r: {{'i': r.initial, 'f': r.fault, 's': NULL::STRUCT(c BIGINT, a VARCHAR)[]}}),
        lambda z, r: {{'i': '', 'f': '', 's': list_transform([list_transform([z.s], lambda y: list_transform([
            [{{'c': y[1].c + 3, 'a': y[1].a || 'D'}}],
            [{{'c': y[2].c + 3, 'a': y[2].a || 'D'}}] || CASE WHEN r.f NOT IN ('b', 'd') AND r.i = 's' THEN [{{'c': y[1].c + (r.f = 't')::BIGINT, 'a': y[1].a || 'K'}}] ELSE [] END,
            [{{'c': y[3].c + 3, 'a': y[3].a || 'D'}}] || CASE WHEN r.f IN ('b', 'd') THEN []
              ELSE list_transform([1, 2, 4], lambda j: {{'c': y[j].c + (r.f = 't')::BIGINT + CASE WHEN r.i = 'u' THEN 0 ELSE 2 END, 'a': y[j].a || CASE WHEN r.i = 'u' THEN 'K' ELSE 'R' END}}) END,
            [{{'c': y[4].c + 3, 'a': y[4].a || 'D'}}] || CASE WHEN r.f IN ('b', 'd') THEN []
              ELSE [{{'c': y[3].c + (r.f = 't')::BIGINT + CASE WHEN r.i = 'a' THEN 0 ELSE 2 END, 'a': y[3].a || CASE WHEN r.i = 'a' THEN 'K' ELSE 'R' END}}] END
          ], lambda q: list_sort(q)[1]))[1]], lambda m: [
            m[1], m[2],
            list_sort([m[3], {{'c': m[1].c + 2, 'a': m[1].a || 'I'}}, {{'c': m[2].c + 2, 'a': m[2].a || 'I'}}, {{'c': m[4].c + 2, 'a': m[4].a || 'I'}}])[1],
            list_sort([m[4], {{'c': m[3].c + 2, 'a': m[3].a || 'I'}}, {{'c': m[1].c + 4, 'a': m[1].a || 'II'}}, {{'c': m[2].c + 4, 'a': m[2].a || 'II'}}])[1]])[1]}},
        {{'i': '', 'f': '', 's': [{{'c': 0::BIGINT, 'a': ''}}, {{'c': 1000000::BIGINT, 'a': ''}}, {{'c': 2::BIGINT, 'a': 'I'}}, {{'c': 4::BIGINT, 'a': 'II'}}]}}).s AS ends FROM l),
a AS (SELECT *, list_sort([ends[1], ends[4]])[1].c AS cost, list_sort([ends[1], ends[4]])[1].a AS audit,
        (SELECT count(*) FROM unnest(range(1, len(rows))) u(i) WHERE rows[i].initial || rows[i + 1].initial NOT IN ('su', 'ua', 'au')) AS illegal FROM k),
x AS (SELECT conv_id, (SELECT string_agg(CASE letter WHEN 'K' THEN rows[row_no].role || ':' || rows[row_no].text
            ELSE CASE WHEN (written - length(replace(audit, 'D', '')) % 2) % 2 = 1 THEN 'user:' ELSE 'assistant:' END || CASE letter WHEN 'R' THEN rows[row_no].text ELSE '' END END, chr(10) ORDER BY i)
          FROM (SELECT i, letter, count(*) FILTER (letter <> 'I') OVER (ORDER BY i) AS row_no, count(*) FILTER (letter <> 'D') OVER (ORDER BY i) AS written
                FROM (SELECT i, substr(audit, i, 1) AS letter FROM unnest(range(1, length(audit) + 1)) u(i))) WHERE letter <> 'D') AS repaired FROM a)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
