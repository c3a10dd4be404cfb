"""Find secrets: three base rules over every text, and a character network over every other candidate.

A candidate is every token (run of ASCII letters, digits and ``+ / _ -``) of at least ``LEAST_CANDIDATE``
characters, with digits or without, unless it touches a secret of a base rule or lies in such a rule's
span. The network sees the characters
around its start as small integers, and for a token longer than that window also those around its end
(what lies further from both is not seen). Shorter tokens are no candidates.

A convolutional network learns from every text, with the base rules' spans as labels: tasks take steps over their
own documents, and after each round their networks are averaged. Of each kind of stretch (``FOUND`` to
``WORD``) a document's rows weigh one together. Findings have few shapes (often one
alphabet behind one announcing word), so they are varied as well: cuts and other cases of real ones, and runs drawn
from other alphabets, with or without a short prefix, in the surroundings of ordinary words. Ordinary words are varied likewise into names,
paths and numbers, as examples of what is no secret; every document with ordinary words adds one of each. The words that announce a secret are
blanked in half of the examples, so that it has to look at the token too, and a candidate gets the best
score of its looks. A candidate that the rules missed may well be a secret: such rows count little in the
first pass over the table, and those that its network takes for secrets are left out of the second. A quarter of the
documents is kept out of training; outputs are calibrated on all rows of these, and the threshold is even odds, or less if that would
not find the wanted share of the labelled and varied findings there. A last pass adds the candidates above it to the base spans.
Of equal tables split otherwise the networks differ, as their steps do.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Words, as_bytes, keep, pick, pieces, small, word_table

#: Fixed values of the base rules, in the order of the kinds.
KINDS = ("assign", "access", "hex", "network")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
HEX = re.compile(rb"[0-9a-f]{%d,}" % LEAST_HEX)
_HEX = word_table([b for b in range(256) if chr(b) not in "0123456789abcdef"])
_TOKEN = word_table([b for b in range(256) if not (b < 128 and (chr(b).isalnum() or chr(b) in "+/_-"))])

#: Shortest candidate (as the base rule's shortest value), and the context: characters before its start and after it.
LEAST_CANDIDATE, BEFORE, AFTER = 8, 24, 40
WIDTH = BEFORE + AFTER
#: Kinds of stretches: secrets of the base rules, candidates with a digit, those without, shorter words (examples
#: only), and candidates that reach into a base rule's announcing word (scored, no examples).
FOUND, DIGITS, PLAIN, WORD, BESIDE = 1, 0, 2, -1, 3
#: Kinds of examples made from those: varied findings, and ordinary words varied into names, paths and numbers.
VARIED, NAME = 4, 5
#: Rounds of the first pass and of the second (or of a pass again): shares of the documents (of ``SHARES``, by hash). Early rounds are
#: short, so that the networks of the tasks are averaged before they grow apart.
SHARES, FIRST, SECOND = 64, ((0, 4), (4, 16), (16, 64)), ((0, 16), (16, 64))
#: Documents of a step, and how many documents a pass should see: those of a smaller table come several times, up to
#: ``MOST_FIRST`` and ``MOST_SECOND``, and up to ``IN_ROUND`` of these between two averages.
STEP, SEEN, MOST_FIRST, MOST_SECOND, IN_ROUND = 16, 40_000, 12, 12, 2
#: Windows whose answers are held at once, and whose gradients, so that they stay in a core's cache.
HELD, STEPPED = 128, 64
#: A row whose probability is this close to its label gives no gradient.
FLAT = 0.02
RECALL = 0.95

#: Characters as symbols: 0 outside, letters without case, digits, then signs; capitals are a second input.
_SYMBOL = np.full(256, 39, dtype=np.uint8)
for _code in range(256):
    _c = chr(_code)
    if "a" <= _c.lower() <= "z" and _code < 128:
        _SYMBOL[_code] = 1 + ord(_c.lower()) - ord("a")
    elif "0" <= _c <= "9":
        _SYMBOL[_code] = 27
    elif _c in " \t\r\n":
        _SYMBOL[_code] = 28
    elif _code < 128:
        _SYMBOL[_code] = 29 + _code % 9
    elif _code >= 128:
        _SYMBOL[_code] = 38
SYMBOLS = 40
_CAPITAL = np.zeros(256, dtype=np.uint8)
_CAPITAL[ord("A") : ord("Z") + 1] = 64
_LOOKS = _SYMBOL + _CAPITAL


def base_spans(body: bytes, text: str | None = None) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, start of the secret in it) in bytes of ``body`` for the rules assign and access; hex runs come from the arrays."""
    found = []
    low = body.lower()
    if any(word in low for word in KEYWORDS):
        text = body.decode("utf-8", "replace") if text is None else text
        at = done = 0
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_ASSIGN:
                done += len(text[at : m.start()].encode())
                at = m.start()
                end = done + len(m[0].encode())
                found.append((done, end, 0, end - len(m[2])))
    if b"AKIA" in body:
        found += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(body) if len(m[0]) >= LEAST_ACCESS]
    return found


def _windows(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Copies of the windows that begin at some places of an array of codes."""
    return np.lib.stride_tricks.sliding_window_view(codes, WIDTH)[places]


def _rows_with_hex(part: np.ndarray, edges: np.ndarray) -> list[int]:
    """Rows that may hold a hex run: one of ``LEAST_HEX`` bytes holds whole steps of half as many, so few bytes tell where none is."""
    step = LEAST_HEX // 2
    at = np.arange(0, max(0, len(part) - step + 1), step)
    for beyond in (0, step - 1, *range(1, step - 1)):
        at = at[_HEX[part[at + beyond]]]
    return np.unique(np.searchsorted(edges, at, side="right") - 1).tolist()


def _rows_with_words(raw: bytes, edges: np.ndarray) -> list[int]:
    """Rows that may hold a span of the rules assign and access, as they hold one of their words; each row is sought through up to its first."""
    ends, rows, low = edges[1:].tolist(), set(), raw.lower()
    for text, word in [(low, word) for word in KEYWORDS] + [(raw, b"AKIA")]:
        at = text.find(word)
        while at >= 0:
            rows.add(row := bisect_right(ends, at))
            at = text.find(word, ends[row])
    return sorted(rows)


def _overlaps(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which stretches touch one of the spans."""
    if not spans or not len(starts):
        return np.zeros(len(starts), bool)
    lows = np.array(sorted(s for s, _ in spans))
    highs = np.array(sorted(e for _, e in spans))
    return np.searchsorted(lows, ends, side="left") > np.searchsorted(highs, starts, side="right")


def _characters(body: bytes, places: list[int]) -> dict[int, int]:
    """Code points before each byte place."""
    out, at, count = {}, 0, 0
    for place in sorted(set(places)):
        count += len(body[at:place].decode("utf-8", "replace"))
        at = place
        out[place] = count
    return out


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())])
SUMS = "part int, value long, documents long"
MARGINS = "positive boolean, weight double, z double"


class Scan:
    """What a piece of some rows holds: base spans of each row, and stretches to look at, in bytes.

    A stretch is a token with its ``kind``, seen from ``look``: its start or, again for a long one,
    ``AFTER`` bytes before its end.
    """

    def __init__(self, part: np.ndarray, edges: np.ndarray) -> None:
        self.part, self.edges, self.raw = part, edges, part.tobytes()
        # Zeros before and after each row, so that no window reaches from one into another.
        self.codes = np.zeros(BEFORE + len(part) + AFTER * (len(edges) - 1), np.uint8)
        for row, (low, high) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            at = BEFORE + AFTER * row
            _LOOKS.take(part[low:high], out=self.codes[at + low : at + high], mode="clip")
        tokens = Words(part, edges, _TOKEN)
        self.spans: dict[int, list] = {}
        for row in _rows_with_hex(part, edges):
            for m in HEX.finditer(self.raw, int(edges[row]), int(edges[row + 1])):
                start, end = m.start() - int(edges[row]), m.end() - int(edges[row])
                self.spans.setdefault(row, []).append((start, end, 2, start))
        for row in _rows_with_words(self.raw, edges):
            if more := base_spans(self.raw[edges[row] : edges[row + 1]]):
                self.spans.setdefault(row, []).extend(more)
        length = tokens.ends - tokens.starts
        chosen = np.flatnonzero(length >= LEAST_CANDIDATE)
        long = np.flatnonzero(length > AFTER)
        # One ordinary word of a row, its middle one, shows the network what running text looks like.
        filled = np.flatnonzero(tokens.counts)
        words = tokens.first[:-1][filled] + tokens.counts[filled] // 2
        words = words[length[words] < LEAST_CANDIDATE]
        at = np.concatenate([chosen, long, words])
        self.starts, self.ends, self.row = tokens.starts[at], tokens.ends[at], tokens.row[at]
        self.look = np.concatenate([tokens.starts[chosen], tokens.ends[long] - AFTER, tokens.starts[words]])
        digit = np.concatenate([np.zeros(1, np.int32), np.cumsum((part >= 48) & (part <= 57), dtype=np.int32)])
        self.kind = np.where(digit[self.ends] > digit[self.starts], DIGITS, PLAIN)
        self.kind[len(chosen) + len(long) :] = WORD
        whole = [(int(edges[row]) + s, int(edges[row]) + e) for row, spans in self.spans.items() for s, e, _, _ in spans]
        inner = [(int(edges[row]) + s, int(edges[row]) + e) for row, spans in self.spans.items() for _, e, _, s in spans]
        touched = _overlaps(self.starts, self.ends, whole)
        self.kind[touched] = BESIDE
        seen = np.minimum(self.look + AFTER, self.ends)
        found = _overlaps(self.look, seen, inner)
        self.kind[found] = FOUND
        # What touches a secret or lies in a rule's span is found already; only looks at secrets are examples of it.
        secret = _overlaps(self.starts, self.ends, inner)
        covered = np.zeros(len(at), bool)
        for k in np.flatnonzero(touched).tolist():
            base = int(edges[self.row[k]])
            covered[k] = any(base + s <= self.starts[k] and self.ends[k] <= base + e for s, e, _, _ in self.spans[int(self.row[k])])
        dropped = ~found & (covered | secret | (touched & (np.arange(len(at)) >= len(chosen) + len(long))))
        for name in ("starts", "ends", "row", "look", "kind"):
            setattr(self, name, getattr(self, name)[~dropped])
        #: Where the windows begin in ``codes``.
        self.place = self.look + AFTER * self.row

    def windows(self, at: np.ndarray) -> np.ndarray:
        return _windows(self.codes, self.place[at])


def _scans(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Scan]]:
    body, bounds = as_bytes(batch.column(1))
    for first, last in pieces(bounds):
        yield first, last, Scan(body[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])


#: The window codes that occur, and the number of each.
_CODES = np.unique(_SYMBOL + _CAPITAL)
_CODES = np.concatenate([[0], _CODES[_CODES > 0]]).astype(np.int64)
_CODE_OF = np.searchsorted(_CODES, np.arange(256)).astype(np.int64)


#: Alphabets of varied findings.
_HEX_DIGITS, _LOWERS, _UPPERS, _TENS = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (_HEX_DIGITS, _HEX_DIGITS.upper(), _LOWERS + _TENS, _UPPERS + _TENS, _LOWERS + _UPPERS + _TENS, _LOWERS + _UPPERS + _TENS + "+/", _LOWERS + _UPPERS + _TENS + "-_")
#: Lengths of varied findings; longer ones fill the window.
SHORTEST_VARIED, LONGEST_VARIED = 16, 48


def _codes(text: str) -> np.ndarray:
    return _LOOKS[np.frombuffer(text.encode(), dtype=np.uint8)]


#: The codes of what variations draw from.
_ALPHABET_CODES = [_codes(a) for a in ALPHABETS]
_LOWER_CODES, _TEN_CODES, _SPACE_CODE = _codes(_LOWERS), _codes(_TENS), _codes(" ")
_JOIN_CODES = [_codes(c) for c in "_-/"]
_NO_CODES = np.zeros(0, np.uint8)


def _drawn(rng: np.random.Generator, codes: np.ndarray, size: int) -> np.ndarray:
    return codes[rng.integers(0, len(codes), size)]


class Variations:
    """Windows of varied findings and of varied ordinary words, in surroundings taken from ordinary windows."""

    def __init__(self, ordinary: np.ndarray, findings: np.ndarray, seed: int = 9) -> None:
        self.rng, self.ordinary = np.random.default_rng(seed), ordinary
        self.words = [w & 63 for w in self._runs(ordinary, 26) if 2 <= len(w) < AFTER]
        self.secrets = [w for w in self._runs(findings, 27) if len(w) >= LEAST_CANDIDATE]

    @staticmethod
    def _runs(windows: np.ndarray, last: int) -> list[np.ndarray]:
        """What stands at the token's place up to the first symbol that is no letter (up to 26) or digit (27)."""
        symbol = windows[:, BEFORE:] & 63
        stop = np.where((symbol < 1) | (symbol > last), np.arange(AFTER), AFTER).min(axis=1)
        return [row[BEFORE : BEFORE + n] for row, n in zip(windows, stop.tolist())]

    def _placed(self, token: np.ndarray) -> np.ndarray:
        """The token in a window, between what stands before two ordinary tokens."""
        before, after, more = self.ordinary[self.rng.integers(0, len(self.ordinary), 3)]
        out, at = np.empty(WIDTH + BEFORE, np.uint8), BEFORE + (size := min(len(token), AFTER))
        out[:BEFORE], out[BEFORE:at] = before[:BEFORE], token[:size]
        if at < WIDTH:
            out[at], out[at + 1 : at + 1 + BEFORE] = _SPACE_CODE[0], after[:BEFORE]
        if at + 1 + BEFORE < WIDTH:
            out[at + 1 + BEFORE : WIDTH] = more[: WIDTH - at - 1 - BEFORE]
        return out[:WIDTH]

    def finding(self) -> np.ndarray:
        """In half of the cases a cut of a real finding, in its own case or another; else drawn from an alphabet."""
        rng = self.rng
        if self.secrets and rng.random() < 0.5:
            own = self.secrets[rng.integers(len(self.secrets))]
            size = rng.integers(LEAST_CANDIDATE, len(own) + 1)
            cut = own[(first := rng.integers(0, len(own) - size + 1)) : first + size]
            letter = (cut & 63) <= 26
            # Letters alone keep their case: in one case they would be told from words by nothing but rarity.
            looks = (cut, np.where(letter, cut | 64, cut), np.where(letter, cut & 63, cut))
            return self._placed(looks[0 if letter.all() else rng.integers(3)].astype(np.uint8))
        alphabet = _ALPHABET_CODES[rng.integers(len(ALPHABETS))]
        token = _drawn(rng, alphabet, rng.integers(SHORTEST_VARIED, LONGEST_VARIED + 1))
        if rng.random() < 0.25:
            token = np.concatenate([_drawn(rng, _LOWER_CODES, rng.integers(2, 5)), _JOIN_CODES[rng.integers(2)], token])
        return self._placed(token)

    def ordinary_name(self) -> np.ndarray:
        rng = self.rng
        kind = rng.integers(6)
        number = _drawn(rng, _TEN_CODES, rng.integers(1, 5) if kind else rng.integers(8, 25))
        if kind == 0 or not self.words:
            return self._placed(number)
        words = [self.words[i] for i in rng.integers(0, len(self.words), rng.integers(1, 5))]
        if kind in (1, 2):
            words = [np.concatenate([w[:1] | 64, w[1:] | (64 if kind == 2 else 0)]) for w in words]
        between = _JOIN_CODES[rng.integers(3)] if kind > 1 else _NO_CODES
        token = np.concatenate([x for w in words for x in (w, between)][: 2 * len(words) - 1])
        return self._placed(np.concatenate([token, number]) if kind in (1, 3, 5) else token)


class Network:
    """Two convolutions wide of five and three characters, the largest answer of each filter, and a dense layer."""

    FILTERS, REACH, SIZE = 24, 5, 10

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        f, r, e = self.FILTERS, self.REACH, self.SIZE
        self.parts = {
            "symbols": rng.normal(0, 0.3, (SYMBOLS, e)),
            "conv": rng.normal(0, (2 / (r * (e + 2))) ** 0.5, (r * (e + 2), f)),
            "conv_bias": np.zeros(f),
            "dense": rng.normal(0, 0.2, (3 * f,)),
            "dense_bias": np.zeros(1),
        }
        self.slope, self.shift, self.threshold = 1.0, 0.0, 2.0

    def values(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.parts.values()])

    def with_values(self, values: np.ndarray) -> Network:
        """A network of the same form with other numbers in it."""
        out, at = Network(), 0
        for name, own in self.parts.items():
            out.parts[name] = values[at : at + own.size].reshape(own.shape).copy()
            at += own.size
        return out

    def _inputs(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbol = windows & 63
        place = np.broadcast_to((np.arange(WIDTH) >= BEFORE).astype(float), windows.shape)
        x = np.concatenate([self.parts["symbols"][symbol], (windows >> 6)[..., None].astype(float), place[..., None]], axis=2)
        n, w, e = x.shape
        stacked = np.lib.stride_tricks.sliding_window_view(x, self.REACH, axis=1).transpose(0, 1, 3, 2)
        return symbol, np.ascontiguousarray(stacked).reshape(n, w - self.REACH + 1, self.REACH * e)

    #: Filters are pooled over three stretches: before the token, its first characters, the rest.
    CUTS = (0, BEFORE - 2, BEFORE + 16, WIDTH - REACH + 1)

    def _forward(self, windows: np.ndarray):
        symbol, x = self._inputs(windows)
        out = np.maximum(x @ self.parts["conv"] + self.parts["conv_bias"], 0)
        best = [out[:, a:b].argmax(axis=1) + a for a, b in zip(self.CUTS, self.CUTS[1:])]
        pooled = np.concatenate([np.take_along_axis(out, b[:, None, :], 1)[:, 0] for b in best], axis=1)
        return symbol, x, best, pooled, np.einsum("ij,j->i", pooled, self.parts["dense"]) + self.parts["dense_bias"][0]

    def _tables(self) -> tuple:
        """The first convolution as look-ups: what two, two and one neighbouring codes add, and what the place does."""
        f, r, e = self.FILTERS, self.REACH, self.SIZE
        conv = self.parts["conv"].reshape(r, e + 2, f)
        one = np.einsum("ce,ref->rcf", self.parts["symbols"][_CODES & 63], conv[:, :e]) + (_CODES >> 6)[None, :, None] * conv[:, e][:, None, :]
        first, second = (np.add(one[k][:, None], one[k + 1][None], out=np.empty((len(_CODES), len(_CODES), f), np.float32), casting="same_kind").reshape(-1, f) for k in (0, 2))
        after = np.arange(WIDTH - r + 1)[:, None] + np.arange(r) >= BEFORE
        place = after.astype(float) @ conv[:, e + 1] + self.parts["conv_bias"]
        return first, second, one[4].astype(np.float32), place.astype(np.float32)

    def margins(self, codes: np.ndarray, places: np.ndarray, tables: tuple | None = None) -> np.ndarray:
        """The larger of two looks at the windows at some places: with the characters before the token, and without them."""
        answers, (*_, place) = _Answers(tables := tables or self._tables()), tables
        dense, reach, low, middle = self.parts["dense"], BEFORE - self.REACH + 1, self.CUTS[1], self.CUTS[2]
        # Without the characters before it, a window differs only up to the last place that reaches back.
        blank = (answers.of(np.zeros((BEFORE, 1), np.int64)) + place[:reach, None]).max(axis=0)
        looks = np.empty((2, min(256, len(places)), 3 * self.FILTERS), np.float32)
        out = [np.zeros(0)]
        for i in range(0, len(places), 256):
            own = places[i : i + 256]
            for k in range(0, len(own), HELD):
                code = _CODE_OF.take(_windows(codes, own[k : k + HELD]).T)
                # Places come first, so that the largest answers are taken over whole rows of windows and filters. From one that reaches into the
                # token on, and before, a place adds the same to all answers, so it is added to the largest.
                seen = answers.of(code)
                rest = seen[middle:].max(axis=0) + place[BEFORE]
                near = seen[BEFORE:middle].max(axis=0) + place[BEFORE]
                seen[reach:BEFORE] += place[reach:BEFORE, None]
                before = np.maximum(seen[:reach].max(axis=0) + place[0], seen[reach:low].max(axis=0))
                token = np.maximum(near, seen[low:BEFORE].max(axis=0))
                edge = code[reach : BEFORE + self.REACH - 1]
                edge[: BEFORE - reach] = 0
                alone = answers.of(edge)
                alone += place[reach:BEFORE, None]
                looks[0, k : k + HELD][: len(rest)] = np.concatenate([before, token, rest], axis=1)
                looks[1, k : k + HELD][: len(rest)] = np.concatenate([np.maximum(blank, alone[: low - reach].max(axis=0)), np.maximum(near, alone[low - reach :].max(axis=0)), rest], axis=1)
            out.append(np.maximum(*[np.maximum(look[: len(own)], 0) @ dense for look in looks]) + self.parts["dense_bias"][0])
        return np.concatenate(out)

    def margin(self, windows: np.ndarray) -> np.ndarray:
        return self.margins(windows.ravel(), np.arange(len(windows)) * WIDTH)

    def look(self, codes: np.ndarray, places: np.ndarray, hidden: np.ndarray) -> np.ndarray:
        """The margin of the windows at some places, of those marked hidden without the characters before the token."""
        answers, (*_, place) = _Answers(tables := self._tables()), tables
        reach, low, middle = BEFORE - self.REACH + 1, self.CUTS[1], self.CUTS[2]
        out = [np.zeros(0)]
        for i in range(0, len(places), HELD):
            windows = _windows(codes, places[i : i + HELD])
            windows[hidden[i : i + HELD], :BEFORE] = 0
            seen = answers.of(_CODE_OF.take(windows.T))
            rest = seen[middle:].max(axis=0) + place[BEFORE]
            near = seen[BEFORE:middle].max(axis=0) + place[BEFORE]
            seen[reach:BEFORE] += place[reach:BEFORE, None]
            before = np.maximum(seen[:reach].max(axis=0) + place[0], seen[reach:low].max(axis=0))
            best = np.concatenate([before, np.maximum(near, seen[low:BEFORE].max(axis=0)), rest], axis=1)
            out.append(np.einsum("ij,j->i", np.maximum(best, 0), self.parts["dense"]) + self.parts["dense_bias"][0])
        return np.concatenate(out)

    def chance(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))

    def probability(self, windows: np.ndarray) -> np.ndarray:
        return self.chance(self.margin(windows))

    def fit(self, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, epochs: int = 12, rate: float = 0.01, seed: int = 8) -> None:
        rng, state = np.random.default_rng(seed), Descent(self, rate)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), 128):
                at = order[i : i + 128]
                state.step(half_blanked(windows[at], rng), labels[at], (1.0 if weights is None else weights[at]) / len(at))


class _Answers:
    """What the look-ups of the first convolution give, without what the place adds, in memory that is used again."""

    def __init__(self, tables: tuple) -> None:
        self.tables, self.held = tables[:3], np.empty((2, (WIDTH - Network.REACH + 1) * HELD * Network.FILTERS), np.float32)

    def of(self, code: np.ndarray) -> np.ndarray:
        """Answers (place, window, filter) for codes (place, window)."""
        first, second, last = self.tables
        n = len(code) - Network.REACH + 1
        pair = code[:-1] * len(_CODES) + code[1:]
        shape = (n, code.shape[1], Network.FILTERS)
        out, more = (held[: shape[0] * shape[1] * shape[2]].reshape(shape) for held in (self.held if n > Network.REACH else np.empty((2, n * code.shape[1] * Network.FILTERS), np.float32)))
        first.take(pair[:n], axis=0, out=out, mode="clip")
        out += second.take(pair[2 : n + 2], axis=0, out=more, mode="clip")
        out += last.take(code[4:], axis=0, out=more, mode="clip")
        return out


def half_blanked(windows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The windows, half of them without the characters before the token."""
    shown = windows.copy()
    shown[np.ix_(rng.random(len(shown)) < 0.5, np.arange(BEFORE))] = 0
    return shown


class Descent:
    """Steps of a network along its gradient, with moments (Adam)."""

    def __init__(self, network: Network, rate: float) -> None:
        self.network, self.rate, self.count = network, rate, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.parts.items()}

    def step(self, shown: np.ndarray, labels: np.ndarray, weights: np.ndarray | float) -> None:
        network, f, e = self.network, Network.FILTERS, Network.SIZE
        weights = np.broadcast_to(weights, len(shown))
        # Some windows at a time, whose arrays stay in a core's cache; sums go on from one to the next in the same order.
        products, bias = np.zeros((min(STEPPED, len(shown)) + 1, Network.REACH * (e + 2), f)), np.zeros((1, f))
        symbols = np.zeros((Network.REACH, e, SYMBOLS))
        numbers, pools, offs = np.arange(SYMBOLS), [], []
        for low in range(0, len(shown), STEPPED):
            symbol, x, best, pooled, z = network._forward(shown[low : low + STEPPED])
            dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[low : low + STEPPED]) * weights[low : low + STEPPED]
            pools.append(pooled)
            offs.append(dz)
            dout = np.zeros((len(x), x.shape[1], f))
            dpool = dz[:, None] * network.parts["dense"][None, :] * (pooled > 0)
            for part, b in enumerate(best):
                np.put_along_axis(dout, b[:, None, :], dpool[:, None, part * f : (part + 1) * f], 1)
            # Products of one window each, and none of BLAS beyond them, start no threads beside the other tasks.
            np.matmul(x.transpose(0, 2, 1), dout, out=products[1 : len(x) + 1])
            products[0] = products[: len(x) + 1].sum(0)
            bias = np.concatenate([bias, dout.reshape(-1, f)]).sum(0, keepdims=True)
            dx = (dout @ network.parts["conv"].T).reshape(len(x), x.shape[1], Network.REACH, e + 2)[..., :e]
            at = np.nonzero(dout.any(axis=2))  # elsewhere nothing is added
            dx = np.ascontiguousarray(dx[at].transpose(1, 2, 0))
            for r in range(Network.REACH):
                flat = np.concatenate([numbers, symbol[at[0], at[1] + r]])
                for j in range(e):
                    symbols[r, j] = np.bincount(flat, np.concatenate([symbols[r, j], dx[r, j]]), SYMBOLS)
        pooled, dz = np.concatenate(pools), np.concatenate(offs)
        grad = {"dense": np.einsum("ij,i->j", pooled, dz), "dense_bias": np.array([dz.sum()]), "conv": products[0], "conv_bias": bias[0]}
        grad["symbols"] = np.zeros_like(network.parts["symbols"])
        for r in range(Network.REACH):
            grad["symbols"] += symbols[r].T
        self.count += 1
        for k, g in grad.items():
            m, v = self.moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            network.parts[k] -= self.rate * (m / (1 - 0.9**self.count)) / (np.sqrt(v / (1 - 0.999**self.count)) + 1e-8)


class Examples:
    """All rows of a scan to learn from, by document: its stretches, one varied finding and one varied name."""

    def __init__(self, scan: Scan) -> None:
        self.scan = scan
        at = np.flatnonzero(scan.kind != BESIDE)
        self.at = at[np.argsort(scan.row[at], kind="stable")]
        row, kind = scan.row[self.at], scan.kind[self.at]
        _, group, sizes = np.unique(row * 8 + kind + 1, return_inverse=True, return_counts=True)
        self.weight, self.kind = 1.0 / sizes[group], kind
        self.rows, self.first = np.unique(row, return_index=True)
        self.first = np.append(self.first, len(row))
        # A shorter word and a longer one of each document are what is varied.
        usual = np.flatnonzero((kind == PLAIN) | (kind == WORD))
        _, some = np.unique(row[usual] * 2 + (kind[usual] == WORD), return_index=True)
        usual = usual[some]
        self.varied = self.named = np.zeros((0, WIDTH), np.uint8)
        if len(usual):
            draw = Variations(scan.windows(self.at[usual]), scan.windows(self.at[kind == FOUND]), zlib.crc32(scan.raw))
            n = len(np.unique(row[usual]))
            self.varied, self.named = (np.array([one() for _ in range(n)]) for one in (draw.finding, draw.ordinary_name))

    def of(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(codes, places of the windows in them, kinds, weights) of the documents from ``low`` to ``high``, of those with rows."""
        part = slice(self.first[low], self.first[min(high, len(self.rows))])
        varied, named = self.varied[low:high], self.named[low:high]
        made, own = len(varied) + len(named), self.scan.place[self.at[part]]
        begin, end = own.min(), own.max() + WIDTH
        codes = np.concatenate([self.scan.codes[begin:end], varied.ravel(), named.ravel()])
        places = np.concatenate([own - begin, end - begin + WIDTH * np.arange(made)])
        kinds = np.concatenate([self.kind[part], np.full(len(varied), VARIED), np.full(len(named), NAME)])
        return codes, places, kinds, np.concatenate([self.weight[part], np.ones(made)])


def _learner(begin: Network, first_pass: Network | None, turns: int, rate: float):
    """Sums over tasks of the network's numbers (in 2^-24, times documents) after steps over all rows; parts -1 and -2 count findings and other rows."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, documents, counts = begin.with_values(begin.values()), 0, [0, 0]
        state = Descent(network, rate)
        asking = None if first_pass is None else first_pass._tables()
        for batch in small(batches):
            for _, _, scan in _scans(batch):
                examples = Examples(scan)
                rng = np.random.default_rng(zlib.crc32(scan.raw))
                documents += len(examples.rows)
                counts[0] += int((examples.kind == FOUND).sum())
                counts[1] += int((examples.kind != FOUND).sum())
                steps = range(0, len(examples.rows), STEP)
                for low in (low for _ in range(turns) for low in rng.permutation(steps).tolist()):
                    codes, places, kinds, weights = examples.of(low, low + STEP)
                    unsure, labels = (kinds == DIGITS) | (kinds == PLAIN), ((kinds == FOUND) | (kinds == VARIED)).astype(float)
                    if first_pass is None:
                        weights = np.where(unsure, 0.1, 1.0) * weights
                    hidden = rng.random(len(places)) < 0.5
                    error = np.abs(1 / (1 + np.exp(-np.clip(network.look(codes, places, hidden), -30, 30))) - labels)
                    use = error > FLAT
                    if first_pass is not None:
                        asked = np.flatnonzero(use & unsure)
                        use[asked[first_pass.margins(codes, places[asked], asking) >= 0]] = False
                    if use.any():
                        shown = _windows(codes, places[use])
                        shown[hidden[use], :BEFORE] = 0
                        state.step(shown, labels[use], weights[use] / weights.sum())
        if documents:
            values = np.round(network.values() * (1 << 24)).astype(np.int64) * documents
            part = np.concatenate([np.arange(len(values)), [-1, -2]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.concatenate([values, counts])), pa.array(np.full(len(part), documents))], ["part", "value", "documents"])

    return learn


def _measurer(network: Network, first_pass: Network):
    """(positive, weight, z) of all rows, but unsure ones that the first pass and the network take for secrets."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for _, _, scan in _scans(batch):
                examples = Examples(scan)
                for low in range(0, len(examples.rows), 8 * STEP):
                    codes, places, kinds, weights = examples.of(low, low + 8 * STEP)
                    z = network.margins(codes, places)
                    unsure = ((kinds == DIGITS) | (kinds == PLAIN)) & (1 / (1 + np.exp(-np.clip(z, -30, 30))) > FLAT)
                    clear, asked = np.ones(len(z), bool), np.flatnonzero(unsure)
                    clear[asked[first_pass.margins(codes, places[asked]) >= 0]] = False
                    positive = (kinds == FOUND) | (kinds == VARIED)
                    yield pa.RecordBatch.from_arrays([pa.array(x[clear]) for x in (positive, weights, z)], ["positive", "weight", "z"])

    return measure


def _calibrate(network: Network, margins: DataFrame, recall: float) -> None:
    """Platt's line through all margins by Newton's steps, then a threshold that keeps the wanted recall."""
    sides = {r["positive"]: (r["n"], r["w"]) for r in margins.groupBy("positive").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    n, above = sides.get(True, (0, 0.0))
    target = F.when(F.col("positive"), (above + 1) / (above + 2)).otherwise(1 / (sides.get(False, (0, 0.0))[1] + 2))

    def sums(a: float, b: float) -> list[float]:
        line = F.col("z") * a + b
        p = 1 / (1 + F.exp(-line))
        # log(1 + e^line) - target * line, without overflow
        loss = F.greatest(line, F.lit(0.0)) + F.log1p(F.exp(-F.abs(line))) - target * line
        off, bend = p - target, p * (1 - p)
        return list(margins.agg(*[F.sum(F.col("weight") * x) for x in (loss, off * F.col("z"), off, bend * F.col("z") ** 2, bend * F.col("z"), bend)]).first())

    line, least = np.array([1.0, 0.0]), None
    move = np.zeros(2)
    for _ in range(20):
        loss, *rest = sums(*(line + move).tolist())
        if least is not None and loss > least:
            move = move / 2
            continue
        done = least is not None and least - loss <= 1e-6 * least
        line, least = line + move, loss
        if done:
            break
        ga, gb, aa, ab, bb = rest
        move = -np.linalg.solve(np.array([[aa, ab], [ab, bb]]) + 1e-9 * (1 + aa + bb) * np.eye(2), [ga, gb])
    network.slope, network.shift = line.tolist()
    if n:
        # Even odds, or lower where that would miss more of the labelled findings than allowed.
        cut = _ranked(margins.where("positive").select("z"), int(np.floor((1 - recall) * n)))
        network.threshold = min(0.5, float(1 / (1 + np.exp(-np.clip(network.slope * cut + network.shift, -30, 30)))))


def _ranked(values: DataFrame, rank: int) -> float:
    """The value ``z`` at a place (from 0) in their order, to 2^-24, by counts in ever smaller bins."""
    for scale in (1 << 4, 1 << 14, 1 << 24):
        place = F.floor(F.col("z") * scale)
        for at, count in sorted(tuple(r) for r in values.groupBy(place.alias("at")).count().collect()):
            if rank < count:
                break
            rank -= count
        values = values.where(place == at)
    return float(values.agg(F.min("z")).first()[0])


def train(rows: DataFrame, recall: float = RECALL) -> Network | None:
    """Fit on all (doc_id, text) rows; None where the rules find nothing in them, or nothing else is there."""
    total = rows.count()
    if not total:
        return None
    turns = max(1, round(SEEN / total))
    rounds = []
    for most, second in ((MOST_FIRST, False), (MOST_SECOND, True)):
        often = min(turns, most)
        for cycle in range(-(-often // IN_ROUND)):
            rounds += [(*part, min(often, IN_ROUND), second) for part in (SECOND if second or cycle else FIRST)]
    slot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(4 * SHARES))
    held, share = F.pmod(slot, F.lit(4)) == 0, F.floor(slot / 4)
    if total < 4 * SHARES:  # too few to keep some out, or to go by shares
        held, share = F.lit(True), F.lit(SHARES - 1)
    network, first_pass, counts = Network(), None, np.zeros(2)
    for number, (low, high, often, second) in enumerate(rounds):
        if second and first_pass is None:
            first_pass = network
        some = rows.where(share.between(low, high - 1))
        if total >= 4 * SHARES:
            some = some.where(~held)
        learn = _learner(network, first_pass, often, 0.003 if number == len(rounds) - 1 else 0.01)
        sums = some.mapInArrow(learn, SUMS).groupBy("part").agg(F.sum("value").alias("value"), F.sum("documents").alias("documents")).orderBy("part").collect()
        if sums:
            if not second:
                counts += [sums[1]["value"], sums[0]["value"]]
            network = network.with_values(np.array([r["value"] / r["documents"] / (1 << 24) for r in sums[2:]]))
    margins = keep(rows.where(held).mapInArrow(_measurer(network, first_pass), MARGINS), "margins")
    if not counts.all():
        return None
    _calibrate(network, margins, recall)
    return network


def _scorer(network: Network | None):
    """(doc_id, spans) of (doc_id, text) rows: base spans and the candidates that the network takes for secrets."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for first, last, scan in _scans(batch):
                found: dict[int, dict] = {}
                asked = np.flatnonzero((scan.kind == DIGITS) | (scan.kind == PLAIN) | (scan.kind == BESIDE))
                for at in range(0, len(asked) if network is not None else 0, 8192):
                    part = asked[at : at + 8192]
                    chance = network.chance(network.margins(scan.codes, scan.place[part]))
                    for k in np.flatnonzero(chance >= network.threshold).tolist():
                        row, own = int(scan.row[part[k]]), int(scan.edges[scan.row[part[k]]])
                        span = int(scan.starts[part[k]]) - own, int(scan.ends[part[k]]) - own
                        spans = found.setdefault(row, {})
                        spans[span] = max(spans.get(span, 0.0), float(chance[k]))
                out = []
                for row in range(last - first):
                    spans = [(s, e, kind, 1.0) for s, e, kind, _ in scan.spans.get(row, [])]
                    spans += [(s, e, 3, chance) for (s, e), chance in found.get(row, {}).items()]
                    place = _characters(scan.raw[scan.edges[row] : scan.edges[row + 1]], [p for s in spans for p in s[:2]]) if spans else {}
                    out.append([{"start": place[s], "end": place[e], "kind": kind, "score": chance} for s, e, kind, chance in sorted(spans, key=lambda x: (x[0], x[2]))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(out, pa.list_(pa.struct([*_SPAN, ("score", pa.float64())])))],
                    ["doc_id", "spans"],
                )

    return score


SPANS = "doc_id long, spans array<struct<start:bigint,end:bigint,kind:int,score:double>>"


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return pick(docs, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def find_secrets(docs: DataFrame, recall: float = RECALL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, spans) per row: start and end in code points, kind as its place in ``KINDS``, score.

    A null text counts as empty and has no spans; repeated rows and rows without id are scanned like
    all others and returned as often as given. Other columns are ignored. Where the base rules find
    nothing in the documents to learn from, no span is added. Texts are read for the count, for every round of
    training (a share each), for calibration (a quarter) and for the scan, and never shuffled.
    """
    rows = _rows(docs, id_column, text_column)
    return rows.mapInArrow(_scorer(train(rows, recall=recall)), SPANS)


def joined_spans(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The same rows and columns with every secret in the text replaced; overlapping spans become one mark.

    Texts are read for training, as in ``find_secrets``, and once to write, and never shuffled.
    """
    network = train(_rows(docs, id_column, text_column))
    place = docs.columns.index(text_column)
    score = _scorer(network)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 256):
            text = batch.column(place)
            numbers = pa.array(np.arange(len(text)))
            found = [x for part in score(iter([pa.RecordBatch.from_arrays([numbers, text], ["doc_id", "text"])])) for x in part.column(1).to_pylist()]
            out = text.to_pylist()
            for k, spans in enumerate(found):
                if spans:
                    kept, at = [], 0
                    for s in spans:
                        if s["start"] >= at:
                            kept += [out[k][at : s["start"]], mark]
                        at = max(at, s["end"])
                    out[k] = "".join([*kept, out[k][at:]])
            columns = list(batch.columns)
            columns[place] = pa.array(out, text.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(rewrite, docs.schema)
