"""Language of documents by a linear-chain conditional random field over their words.

Every word has a score per language from its letters: n-grams of two to four bytes inside the word,
those at its ends with the edge marked (affixes), and membership in lexicons of frequent words. Learned
transitions say how readily the language changes from one word to the next, so code-switched text is
labelled word by word. Forward-backward gives each word's probabilities; a document's language is the
one with the largest sum. The field is fitted on a bounded sample of labelled rows (``PER_LANGUAGE``
documents of each language, chosen by hash), cut and spliced into mixed sequences, which teaches the
transitions. All words of a batch are scored at once: words are cut into stretches whose transfer
matrices are multiplied side by side, then chained per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import U64, Words, as_bytes, fresh, mix, pick, pieces, seeds, small, word_table

#: Most labelled documents of a language, and most words of each, that the fit takes (documented bounds).
PER_LANGUAGE, WORDS_EACH = 150, 160
BUCKET_BITS, GRAMS = 16, (2, 3, 4)
LEXICON = 200
STRETCH = 32
UNKNOWN = "und"

_LETTER = word_table([b for b in range(128) if not chr(b).isalpha()])
_FOLD = np.where(_LETTER, np.arange(256), 0).astype(np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_GRAM_VALUES = seeds(8, 21) | U64(1)


class Letters:
    """Words of some rows as letter runs, with the n-gram buckets that score them."""

    def __init__(self, body: np.ndarray, bounds: np.ndarray) -> None:
        words = Words(body, bounds, _LETTER)
        self.counts, self.first, self.row = words.counts, words.first, words.row
        self.hashes = words.hashes(lower=True)
        # Letters of all words in a row, each word behind one edge mark, and an edge at the end.
        length = words.ends - words.starts
        place = np.cumsum(length + 1) - length
        total = int(length.sum() + len(length)) + max(GRAMS)
        self.codes = np.zeros(total, dtype=np.uint8)
        inside = np.repeat(place - words.starts, length) + (at := np.flatnonzero(self._mask(body, words)))
        self.codes[inside] = _FOLD[body[at]]
        self.heads = place - 1
        self.left = np.zeros(total - max(GRAMS), dtype=np.int32)
        if len(length):
            self.left = np.repeat(place + length + 1, length + 1).astype(np.int32) - np.arange(len(self.left), dtype=np.int32)

    @staticmethod
    def _mask(body: np.ndarray, words: Words) -> np.ndarray:
        return _LETTER[body]

    def buckets(self, size: int) -> np.ndarray:
        """Bucket of the n-gram from each place; bucket 0 where it would leave the word."""
        n = len(self.left)
        key = np.zeros(n, dtype=U64)
        for j in range(size):
            key += (self.codes[j : j + n].astype(U64) + U64(1)) * _GRAM_VALUES[j]
        key = mix(key + U64(size))
        return np.where(self.left >= size, (key >> U64(64 - BUCKET_BITS)) | U64(1), 0).astype(np.int32)


class Field:
    """Weights of the random field; ``languages`` in the order of its columns."""

    def __init__(self, languages: list[str]) -> None:
        k = len(languages)
        self.languages = languages
        self.weights = np.zeros((1 << BUCKET_BITS, k), dtype=np.float32)
        self.bias = np.zeros(k, dtype=np.float32)
        self.change = np.eye(k, dtype=np.float32) * 2
        self.lexicon, self.member = np.zeros(0, dtype=U64), np.zeros((0, k), dtype=np.float32)
        self.member_weight = np.ones(k, dtype=np.float32)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Row of the lexicon for each word, -1 for none."""
        if not len(self.lexicon):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, at, -1)

    def scores(self, letters: Letters) -> np.ndarray:
        k = len(self.languages)
        total = np.zeros((len(letters.left), k), dtype=np.float32)
        for size in GRAMS:
            total += self.weights[letters.buckets(size)]
        out = np.add.reduceat(total, letters.heads, axis=0) if len(letters.heads) else np.zeros((0, k), np.float32)
        row = self.known(letters.hashes)
        listed = row >= 0
        out[listed] += self.member[row[listed]] * self.member_weight
        return out + self.bias

    def marginals(self, scores: np.ndarray, counts: np.ndarray, pairs: bool = False):
        """Probabilities of every word's languages; with ``pairs`` also the expected changes, summed."""
        k = len(self.languages)
        step = np.exp(self.change - self.change.max()).astype(np.float64)
        seen = np.exp(np.clip(scores - scores.max(axis=1, keepdims=True), -60, 0)).astype(np.float64) if len(scores) else np.zeros((0, k))
        cuts = -(-counts // STRETCH)
        total = int(cuts.sum())
        begin = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(counts)), cuts)
        number = np.arange(total) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = begin[owner] + number * STRETCH
        size = np.minimum(STRETCH, counts[owner] - number * STRETCH)
        grid = start[:, None] + np.arange(STRETCH)
        real = np.arange(STRETCH) < size[:, None]
        block = np.where(real[..., None], seen[np.where(real, grid, 0)], 1.0) if total else np.zeros((0, STRETCH, k))
        # Transfer of each stretch; places beyond its end leave it alone.
        move = np.broadcast_to(np.eye(k), (total, k, k)).copy()
        for t in range(STRETCH):
            live = real[:, t]
            if not live.any():
                break
            moved = (move[live] @ step) * block[live, t][:, None, :]
            move[live] = moved / moved.sum(axis=(1, 2), keepdims=True)
        ahead, behind = np.full((total, k), 1.0 / k), np.full((total, k), 1.0)
        offset = np.cumsum(cuts) - cuts
        for s in range(1, int(cuts.max()) if total else 0):
            at = offset[cuts > s] + s
            v = (ahead[at - 1][:, None, :] @ move[at - 1])[:, 0]
            ahead[at] = v / v.sum(axis=1, keepdims=True)
            at = (offset + cuts)[cuts > s] - s - 1
            v = (move[at + 1] @ behind[at + 1][:, :, None])[:, :, 0]
            behind[at] = v / v.sum(axis=1, keepdims=True)
        forward, backward = np.zeros((total, STRETCH, k)), np.zeros((total, STRETCH, k))
        before = ahead
        entered = np.zeros((total, STRETCH, k)) if pairs else None
        for t in range(STRETCH):
            if pairs:
                entered[:, t] = before
            v = (before @ step) * block[:, t]
            before = np.where(real[:, t, None], v / v.sum(axis=1, keepdims=True), before)
            forward[:, t] = before
        after = behind
        for t in reversed(range(STRETCH)):
            backward[:, t] = after
            v = (block[:, t] * after) @ step.T
            after = np.where(real[:, t, None], v / v.sum(axis=1, keepdims=True), after)
        both = forward * backward
        both /= both.sum(axis=2, keepdims=True)
        out = both[real]
        if not pairs:
            return out
        joint = entered[..., :, None] * step * (block * backward)[..., None, :]
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        return out, joint[real].sum(axis=0)


def _splice(sample: list[tuple[str, list[str]]], languages: list[str], seed: int = 5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Mixed sequences: stretches of 5 to 40 words of random documents, two to four in a row."""
    rng = np.random.default_rng(seed)
    chunks = []
    for lang, words in sample:
        at = 0
        while at < len(words):
            size = int(rng.integers(5, 41))
            chunks.append((languages.index(lang), words[at : at + size]))
            at += size
    order, texts, labels, counts = rng.permutation(len(chunks)), [], [], []
    while len(order):
        take = int(rng.integers(2, 5))
        picked, order = order[:take], order[take:]
        part = [w for i in picked for w in chunks[i][1]]
        texts.append(" ".join(part))
        labels += [chunks[i][0] for i in picked for _ in chunks[i][1]]
        counts.append(len(part))
    return texts, np.array(labels), np.array(counts)


def fit(sample: list[tuple[str, list[str]]], epochs: int = 30, rate: float = 0.3, seed: int = 5) -> Field | None:
    """Fit on (language, words) rows by AdaGrad on the likelihood of the spliced sequences."""
    sample = [(lang, words) for lang, words in sample if words]
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    field = Field(languages)
    texts, labels, counts = _splice(sample, languages, seed)
    letters = Letters(*as_bytes(pa.array(texts, pa.large_string())))
    if len(letters.hashes) != len(labels):
        raise ValueError("training words must be letter runs")
    k = len(languages)
    truth = np.eye(k)[labels]
    # Lexicon: the most frequent words of each language, with its share of a word's occurrences.
    names, inverse = np.unique(letters.hashes, return_inverse=True)
    often = np.stack([np.bincount(inverse, weights=truth[:, j], minlength=len(names)) for j in range(k)], axis=1)
    chosen = np.unique(np.concatenate([np.argsort(-often[:, j], kind="stable")[:LEXICON] for j in range(k)]))
    field.lexicon, field.member = names[chosen], (often[chosen] / np.maximum(often[chosen].sum(axis=1, keepdims=True), 1)).astype(np.float32)
    row = field.known(letters.hashes)
    buckets = [letters.buckets(size) for size in GRAMS]
    word = np.repeat(np.arange(len(letters.heads)), np.diff(np.append(letters.heads, len(letters.left))))
    first = np.zeros(len(labels), bool)
    first[np.cumsum(counts) - counts] = True
    seen_change = np.zeros((k, k))
    np.add.at(seen_change, (labels[:-1][~first[1:]], labels[1:][~first[1:]]), 1)
    power = {"weights": np.full_like(field.weights, 1e-3), "bias": np.full(k, 1e-3), "change": np.full((k, k), 1e-3), "member": np.full(k, 1e-3)}
    size = max(1, len(labels))
    for _ in range(epochs):
        expected, pairs = field.marginals(field.scores(letters), counts, pairs=True)
        slope = (truth - expected) / size
        grad = np.zeros_like(field.weights)
        for b in buckets:
            for j in range(k):
                grad[:, j] += np.bincount(b, weights=slope[word, j], minlength=len(grad)).astype(np.float32)
        grad[0] = 0
        grad -= 1e-6 * field.weights
        listed = row >= 0
        steps = {
            "weights": grad, "bias": slope.sum(axis=0),
            "change": (seen_change - pairs) / size - 1e-4 * field.change,
            "member": (field.member[row[listed]] * slope[listed]).sum(axis=0),
        }
        for name, value in steps.items():
            power[name] += value * value
            target = "member_weight" if name == "member" else name
            setattr(field, target, (getattr(field, target) + rate * value / np.sqrt(power[name])).astype(np.float32))
    return field


def _label(field: Field | None):
    names = np.array((field.languages if field else []) + [UNKNOWN], dtype=object)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            body, bounds = as_bytes(batch.column(1))
            lettered = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            for first, last in pieces(bounds, 600_000):
                rows = last - first
                best, score = np.full(rows, len(names) - 1), np.zeros(rows)
                sums = np.zeros((rows, len(names) - 1))
                if field is not None:
                    letters = Letters(body[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
                    chance = field.marginals(field.scores(letters), letters.counts)
                    for j in range(len(names) - 1):
                        sums[:, j] = np.bincount(letters.row, weights=chance[:, j], minlength=rows)
                    some = (letters.counts > 0) & lettered[first:last]
                    best[some] = sums[some].argmax(axis=1)
                    score[some] = (sums[some] / letters.counts[some, None]).max(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.array(names[best].tolist(), pa.string()), pa.array(np.minimum(score, 1.0))],
                    ["doc_id", "lang_pred", "score"],
                )

    return label


def held_out(doc_id: Column) -> Column:
    """Documents that no fit may see: a quarter, by crc32 of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Field | None:
    """Fit on at most ``PER_LANGUAGE`` documents of each language; held-out rows and null languages never enter."""
    rows = pick(docs, doc_id=id_column, text=text_column, lang=lang_column).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    # A hash threshold per language leaves about twice PER_LANGUAGE rows of each; no group is sorted.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 2 * PER_LANGUAGE / n) * (1 << 30)))])
    few = rows.select("doc_id", "lang", "text", place.alias("place")).where(F.col("place") < F.element_at(share, F.col("lang")))
    # A stretch from the middle of the document, where headers and footers are rare.
    words = F.array_remove(F.split("text", r"[^A-Za-z\x{80}-\x{10FFFF}]+"), "")
    cut = F.slice("words", (F.greatest(F.size("words") - F.lit(WORDS_EACH), F.lit(0)) / 2).cast("int") + 1, WORDS_EACH)
    sample = few.select("doc_id", "lang", "place", words.alias("words")).where("size(words) > 0").select("doc_id", "lang", "place", cut.alias("words"))
    taken: dict[str, list[list[str]]] = {}
    for r in sample.orderBy("place", "doc_id", "lang").limit(4 * PER_LANGUAGE * len(counts)).collect():
        taken.setdefault(r["lang"], []).append(list(r["words"]))
    return fit([(lang, words) for lang in sorted(taken) for words in taken[lang][:PER_LANGUAGE]])


def identify_language(docs: DataFrame, field: Field | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row: the language with most word probability, and its mean.

    Null texts, and texts without a letter, give ``und`` and 0; so does every text when there was
    nothing to learn from. Repeated rows and rows without id are labelled like others; other columns
    are ignored; an empty table gives an empty result. Ties go to the language first in the alphabet.
    """
    rows = pick(docs, doc_id=id_column, text=text_column).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("text").cast("string").rlike(r"\p{L}").alias("lettered")
    )
    return rows.mapInArrow(_label(field), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, field: Field | None, least: float = 0.0, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows with a language, a null one filled in with the most probable; same columns.

    Rows are rejected when they are ``und``: without a letter, or where no language was learned. A mixed
    text without a majority and a short one of which the field is unsure score low and stay; only a
    ``least`` above 0 rejects by score. Texts stay where they are.
    """
    label, place, lang = _label(field), docs.columns.index(text_column), docs.columns.index(lang_column)
    width = len(docs.columns)
    asked = docs.select("*", F.coalesce(F.col(text_column).rlike(r"\p{L}"), F.lit(False)).alias(fresh(docs, "lettered")))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 256):
            numbers = pa.array(np.arange(batch.num_rows))
            one = pa.RecordBatch.from_arrays([numbers, batch.column(place), batch.column(width)], ["doc_id", "text", "lettered"])
            parts = list(label(iter([one])))
            found = pa.concat_arrays([x.column(1) for x in parts]) if parts else pa.array([], pa.string())
            score = pa.concat_arrays([x.column(2) for x in parts]) if parts else pa.array([], pa.float64())
            good = pc.and_(pc.not_equal(found, UNKNOWN), pc.greater_equal(score, least))
            columns = batch.columns[:width]
            columns[lang] = pc.coalesce(columns[lang], found.cast(columns[lang].type))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width]).filter(good)

    return asked.mapInArrow(choose, docs.schema)
