"""Personal data in texts: base patterns, and a semi-Markov conditional random field that adds spans.

The field reads the surroundings of digits, at signs and spelled-out addresses as tokens.  Whole-span features (shape,
digit groups, checksums, neighbours, words around) score every candidate segment of at most ``LONGEST`` tokens; a dynamic
programme over segments chooses boundaries and kinds together.  It is trained on texts with planted data
(``pii_plants``): invented data, in forms that the base patterns know and in forms that they miss, between words of at
most ``most_docs`` documents of the corpus.  The fit runs on the driver, the search on all documents.  A segment is added
where the segmentation with it beats the one without it by ``MARGIN``; it never overlaps a base span.  Beside the four
base kinds the field knows ``secret``: keys, tokens and passwords.

All candidates of many texts are measured at once by numpy, in blocks, so that time and memory are in proportion to the
length of a text, whatever its words and numbers are.

A null or empty text has no spans.  Documents are independent: repeated rows give repeated results.  Other columns are
ignored (``mask`` keeps them); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.llm.pii_plants import example
from skillweave.llm.shared import small_batches

#: The base kinds, and what only the field finds.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
# The base patterns.  An address can only begin where a run of digits does.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Tokens of a segment at most; characters that are read on either side of a digit or sign.
LONGEST, REACH = 20, 64
MOST_DIGITS, MOST_CHARS = 24, 140
EXAMPLES, EPOCHS, RATE, DECAY, BATCH = 3_000, 8, 0.25, 2e-5, 100
MARGIN = 1.5
BITS, WIDTH = 14, 17
#: Tokens whose candidates are measured at once.
BLOCK = 12_000

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start and kind."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:  # the local part is the run before the sign, from the end of the match before
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if any_digit(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if 14 <= m.end() - m.start():
                digits = _digits(m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    found.sort()
    return found


any_digit = re.compile("[0-9]").search
TOKEN = re.compile(r"[^\W_]+|[^\s]")
TRIGGER = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]|\bat \w+ dot\b", re.ASCII | re.IGNORECASE)


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text around what may belong to personal data: ``REACH`` characters on either side, joined where they meet."""
    low, high, size = -1, -1, len(text)
    m = TRIGGER.search(text)
    while m is not None:
        if low >= 0 and m.start() - REACH > high:
            yield low, high
            low = -1
        if low < 0:
            low = max(0, m.start() - REACH)
        high = min(size, m.end() + REACH)
        m = TRIGGER.search(text, m.end())
    if low >= 0:
        yield low, high


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * MULTIPLIER
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


DIGITS, LETTERS, MIXED, MARK = range(4)
HEXADECIMAL = frozenset("0123456789abcdefABCDEF")


class Tokens:
    """Tokens of many regions end to end, as arrays."""

    def __init__(self):
        #: Places in the text, kind, hash of the word, gap before, digits, whether a value below 256, style of the word, first character.
        self.start, self.end, self.kind, self.word, self.gap, self.digits, self.small, self.style, self.char = (array("q") for _ in range(9))
        self.numbers = bytearray()
        self.sizes: list[int] = []

    def add(self, text: str, low: int, high: int) -> None:
        before, begin = low, len(self.start)
        for m in TOKEN.finditer(text, low, high):
            a, b = m.span()
            said = m[0]
            digits = style = small = 0
            if said.isdigit() and said.isascii():
                kind, digits, small = DIGITS, b - a, int(len(said) <= 3 and int(said) < 256)
                self.numbers += said.encode()
            elif said.isalpha():
                kind, style = LETTERS, (1 if said.islower() else 2 if said.isupper() else 3)
            elif said.isalnum():
                kind, digits = MIXED, sum(map(said.count, "0123456789"))
                style = 4 + (HEXADECIMAL.issuperset(said)) + 2 * (said.lower() == said) + 4 * min((b - a) // 8, 7)
            else:
                kind = MARK
            self.start.append(a)
            self.end.append(b)
            self.kind.append(kind)
            self.word.append(zlib.crc32(said[:24].lower().encode("utf-8", "replace")) if kind != DIGITS else min(digits, 9))
            self.gap.append(0 if a == before else 1 if a - before == 1 and text[before] == " " else 2)
            self.digits.append(digits)
            self.small.append(small)
            self.style.append(style)
            self.char.append(ord(said[0]))
            before = b
        self.sizes.append(len(self.start) - begin)


def _numbers(values: array) -> np.ndarray:
    return np.frombuffer(values, np.int64) if len(values) else np.zeros(0, np.int64)


AT, OPEN, CLOSE, DOT = ord("@"), ord("("), ord(")"), ord(".")


class Segments:
    """Candidate segments of all regions, by region and start, and their hashed features.

    With a ``field`` only those candidates are kept that can lead, with their emissions in place of features.
    """

    def __init__(self, tokens: Tokens, texts: list[str], blocked: np.ndarray | None = None, field: Field | None = None):
        """``texts``: of each region; ``blocked``: tokens that no segment may hold."""
        n = len(tokens.start)
        self.sizes = np.array(tokens.sizes, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        region = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.start, self.end, kind, word, gap, digits, small, style, char = (
            _numbers(x) for x in (tokens.start, tokens.end, tokens.kind, tokens.word, tokens.gap, tokens.digits, tokens.small, tokens.style, tokens.char)
        )
        word = word.astype(np.uint64)
        blocked = np.zeros(n, bool) if blocked is None else blocked
        at_word = (word == np.uint64(zlib.crc32(b"at"))) & (kind == LETTERS)
        sums = {name: np.concatenate([np.zeros(1, np.int32), np.cumsum(x, dtype=np.int32)]) for name, x in (
            ("digits", digits), ("letters", kind == LETTERS), ("mixed", kind == MIXED), ("at", char == AT), ("at_word", at_word), ("dots", char == DOT), ("numbers", kind == DIGITS),
            ("small", small), ("open", char == OPEN), ("close", char == CLOSE), ("wide", gap == 2), ("blocked", blocked), ("spaces", gap > 0), ("marks", kind == MARK),
        )}
        luhn_sums = self._luhn_sums(tokens.numbers)
        number_at = np.concatenate([[0], np.cumsum(np.where(kind == DIGITS, digits, 0))])
        base = int(MULTIPLIER) | 1
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([[1], np.full(LONGEST + 1, base, np.uint64)]).astype(np.uint64))
        code = np.where(kind == MARK, char, kind).astype(np.uint64) * np.uint64(4) + np.minimum(gap, 2).astype(np.uint64)
        groups = code + np.where(kind == DIGITS, np.minimum(digits, 9) << 24, 0).astype(np.uint64)
        rolling = {name: self._rolling(_spread(x + np.uint64(1)), base) for name, x in (("shape", code), ("groups", groups))}
        left, right = self._around(texts, region)
        told = np.where(kind == MARK, np.uint64(0), word)
        said = self._last_word(told, kind, self.first, region)
        starts, ends, rows = [], [], []
        opens = ((kind != MARK) | (char == ord("+")) | (char == OPEN)) & ~blocked
        closes = (kind != MARK) & ~blocked
        limit = self.first[region + 1] if n else np.zeros(0, np.int64)
        for low in range(0, n, BLOCK):
            i = np.arange(low, min(low + BLOCK, n))
            i = np.repeat(i[opens[i]], LONGEST)
            j = i + np.tile(np.arange(1, LONGEST + 1), len(i) // LONGEST)
            fits = j <= limit[i]
            i, j = i[fits], j[fits]
            many = sums["digits"][j] - sums["digits"][i]
            signs = (sums["at"][j] - sums["at"][i]) + (sums["at_word"][j] - sums["at_word"][i])
            fits = closes[j - 1] & (sums["wide"][j] == sums["wide"][i + 1]) & (sums["blocked"][j] == sums["blocked"][i]) & (self.end[j - 1] - self.start[i] <= MOST_CHARS)
            fits &= ((many >= 4) & ((many <= MOST_DIGITS) | (j - i <= 5))) | (signs > 0)
            i, j = i[fits], j[fits]
            row = self._features(i, j, sums, rolling, power, luhn_sums, number_at, kind, char, style, gap, word, said, left, right, region)
            if field is not None:
                row = field.emissions(row)
                live = (row + field.slack() > 0).any(1)
                i, j, row = i[live], j[live], row[live]
            starts.append(i)
            ends.append(j)
            rows.append(row)
        self.i, self.j = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (starts, ends))
        self.features = np.concatenate(rows) if rows else np.zeros((0, WIDTH if field is None else len(KINDS)), np.int32)
        self.of = region[self.i] if n else np.zeros(0, np.int64)

    @staticmethod
    def _luhn_sums(numbers: bytearray) -> np.ndarray:
        """Prefix sums of digits, plain and doubled, at even and at odd places: a checksum is then four look-ups."""
        raw = np.frombuffer(bytes(numbers), np.int8) - np.int8(48)
        double = np.where(raw > 4, 2 * raw - 9, 2 * raw).astype(np.int8)
        out = np.zeros((2, len(raw) + 1), np.int32)
        for odd in (0, 1):
            mixed = raw.copy()
            mixed[1 - odd :: 2] = double[1 - odd :: 2]
            np.cumsum(mixed, out=out[odd, 1:])
        return out

    @staticmethod
    def _rolling(x: np.ndarray, base: int) -> np.ndarray:
        """Prefix hashes h[k + 1] = h[k] * base + x[k], modulo 2**64, by prefix sums of x / base**k."""
        with np.errstate(over="ignore"):
            inverse = np.cumprod(np.concatenate([[1], np.full(len(x), pow(base, -1, 1 << 64), np.uint64)]).astype(np.uint64))
            forward = np.cumprod(np.concatenate([[1], np.full(len(x), base, np.uint64)]).astype(np.uint64))
            return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * inverse[1:], dtype=np.uint64)]) * forward

    def _around(self, texts: list[str], region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A class of the character before and after each token."""
        left, right = np.zeros(len(region), np.int64), np.zeros(len(region), np.int64)
        for k in range(len(region)):
            text, a, b = texts[region[k]], int(self.start[k]), int(self.end[k])
            if a and not (c := text[a - 1]).isspace():
                left[k] = 2 if c.isalnum() else 3 + ord(c)
            if b < len(text) and not (c := text[b]).isspace():
                right[k] = 2 if c.isalnum() else 3 + ord(c)
        return left, right

    @staticmethod
    def _last_word(told: np.ndarray, kind: np.ndarray, first: np.ndarray, region: np.ndarray) -> np.ndarray:
        """For each place the last word token before it in its region (0: none), and at n+place the next one from it."""
        n = len(kind)
        place = np.where(kind == LETTERS, np.arange(n), -1)
        back = np.concatenate([[-1], np.maximum.accumulate(place)]) if n else np.full(1, -1)
        inside = back[:-1] >= first[region] if n else np.zeros(0, bool)
        return np.where(inside, told[np.maximum(back[:-1], 0)], np.uint64(0)) if n else np.zeros(0, np.uint64)

    def _features(self, i, j, sums, rolling, power, luhn_sums, number_at, kind, char, style, gap, word, said, left, right, region) -> np.ndarray:
        def within(name: str) -> np.ndarray:
            return sums[name][j] - sums[name][i]

        digits, letters, mixed = within("digits"), within("letters"), within("mixed")
        d0, d1 = number_at[i], number_at[j]
        count = d1 - d0
        parity = (d1 - 1) % 2
        check = (luhn_sums[parity, d1] - luhn_sums[parity, d0]) % 10 == 0
        pure = (letters + mixed == 0) & (count >= 14) & (count <= 19)
        with np.errstate(over="ignore"):
            shape = rolling["shape"][j] - rolling["shape"][i] * power[j - i]
            groups = rolling["groups"][j] - rolling["groups"][i] * power[j - i]
        numbers, dots = within("numbers"), within("dots")
        address = (numbers == 4) & (within("small") == 4)
        last = np.where(kind[j - 1] == LETTERS, word[j - 1], np.uint64(0))
        one = np.where((j - i == 1) | (mixed > 0), style[j - 1] + 1, 0)
        nothing = np.zeros(len(i), np.int64)
        columns = [
            nothing,
            np.minimum(digits, 24),
            shape,
            groups,
            np.minimum(letters, 3) * 16 + np.minimum(mixed, 3) * 4 + np.minimum(within("at") + 2 * within("at_word"), 3),
            np.minimum(dots, 5) * 2 + (letters > 0),
            np.where(pure, 1 + check, 0) * 32 + np.where(pure, count, 0),
            address * 8 + np.minimum(numbers, 7),
            left[i],
            right[j - 1],
            said[i],
            np.where(kind[i] == MARK, char[i], kind[i]) * 1_000 + np.where(kind[j - 1] == MARK, char[j - 1], kind[j - 1]),
            (within("open") == within("close")) * 2 + (within("open") > 0),
            one,
            np.minimum(j - i, 20) * 8 + np.minimum(within("spaces") - (gap[i] > 0), 7),
            last,
            said[i] ^ (np.minimum(digits, 24).astype(np.uint64) << np.uint64(40)),
        ]
        out = np.empty((len(i), WIDTH), np.int32)
        for k, column in enumerate(columns):
            salt = np.uint64((k + 1) << 56)
            out[:, k] = (_spread(np.asarray(column).astype(np.uint64) ^ salt) >> np.uint64(64 - BITS)).astype(np.int32)
        return out


def segments_of(texts: list[str]) -> Segments:
    """Candidates in ``texts``, each taken as one region."""
    tokens = Tokens()
    for text in texts:
        tokens.add(text, 0, len(text))
    return Segments(tokens, texts)


class Field:
    """Weights of segment features by kind, and of the kind that follows another (0: plain text, which scores nothing)."""

    def __init__(self):
        self.weights = np.zeros((1 << BITS, len(KINDS)), np.float32)
        self.follow = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), len(KINDS)))
        for k in range(WIDTH):
            out += self.weights[features[:, k]]
        return out

    def slack(self) -> np.ndarray:
        """By kind: the most that a segment can gain from what stands beside it, over plain text in its place."""
        f = self.follow
        return (f[:, 1:] - f[:, :1]).max(0) + np.maximum((f[1:, :] - f[0]).max(1), 0.0)

    def best(self, i: np.ndarray, j: np.ndarray, emissions: np.ndarray, end: int) -> list[tuple[int, int, float]]:
        """(segment, kind, lead over plain text in its place) of the best segmentation of one region, which ends at ``end``.

        The programme goes by the segments' ends.  Plain text between two of them costs nothing, so only the places where
        one ends have to be kept.
        """
        follow, slack = self.follow, self.slack()
        if not len(i):
            return []
        live = np.lexsort((i, j))
        n_states = len(KINDS) + 1
        ended: dict[int, list] = {}  # place -> by kind: (value, step)
        places, values, steps = [-1], [0.0], [None]  # plain text from a place on: the best so far
        for s in live.tolist():
            low, high, own = int(i[s]), int(j[s]), emissions[s]
            k = bisect_left(places, low) - 1
            plain, plain_step = values[k], steps[k]
            here = ended.get(low)
            row = ended.setdefault(high, [None] * n_states)
            for kind in (np.flatnonzero(own + slack > 0) + 1).tolist():  # the others can't lead, whatever stands beside them
                value, step, state = plain + follow[0, kind], plain_step, 0
                if here is not None:
                    for before in range(1, n_states):
                        if here[before] is not None and here[before][0] + follow[before, kind] > value:
                            value, step, state = here[before][0] + follow[before, kind], here[before][1], before
                value += own[kind - 1]
                if row[kind] is None or value > row[kind][0]:
                    row[kind] = (value, (s, kind, state, step))
            top = max(((r[0] + follow[k, 0], k) for k, r in enumerate(row) if r is not None), default=(-1e9, 0))
            if places[-1] == high:
                if top[0] > values[-1]:
                    values[-1], steps[-1] = top[0], row[top[1]][1]
            elif top[0] > values[-1]:
                places.append(high)
                values.append(top[0])
                steps.append(row[top[1]][1])
        k = bisect_left(places, end) - 1
        finals = [(values[k], steps[k])] + [(r[0], r[1]) for r in ended.get(end, [])[1:] if r is not None]
        step, out, after = max(finals, key=lambda x: x[0])[1], [], 0
        last_start = None
        while step is not None:
            s, kind, state, before = step
            beside = after if last_start == int(j[s]) else 0
            behind = 0.0 if int(j[s]) == end else follow[kind, beside] - follow[0, beside]
            out.append((s, kind - 1, float(emissions[s, kind - 1] + follow[state, kind] - follow[state, 0] + behind)))
            after, last_start, step = kind, int(i[s]), before
        return out[::-1]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Trainer:
    """Gradients of the log-likelihood of labelled segmentations, for many regions at once."""

    def __init__(self, found: Segments, gold: list[list[Span]]):
        self.found = found
        n = len(found.sizes)
        self.base = found.first[:-1] + np.arange(n)  # a region of n tokens has n + 1 places
        self.local = found.i - found.first[found.of]
        self.span = found.j - found.i
        by_end = {}
        for k, (r, a, b) in enumerate(zip(found.of.tolist(), found.start[found.i].tolist(), found.end[found.j - 1].tolist(), strict=True)):
            by_end[r, a, b] = k
        self.gold = [[(by_end[r, s, e], kind) for s, kind, e in spans if (r, s, e) in by_end] for r, spans in enumerate(gold)]
        #: Regions whose data are candidates at all; only these are learnt from.
        self.whole = [r for r, spans in enumerate(gold) if len(spans) == len(self.gold[r])]
        self.cuts = np.searchsorted(found.of, np.arange(n + 1))

    def gradient(self, field: Field, regions_: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments, the difference of gold and expected counts for each, and the same of the transitions."""
        found, states = self.found, len(KINDS) + 1
        seg = np.concatenate([np.arange(self.cuts[r], self.cuts[r + 1]) for r in regions_])
        sizes = found.sizes[regions_]
        base = np.concatenate([[0], np.cumsum(sizes + 1)])
        of = np.repeat(np.arange(len(regions_)), [self.cuts[r + 1] - self.cuts[r] for r in regions_])
        a = base[of] + self.local[seg]
        b = a + self.span[seg]
        e = field.emissions(found.features[seg])
        follow = field.follow
        total = int(base[-1])
        turn = np.arange(total) - np.repeat(base[:-1], sizes + 1)
        alpha, beta = np.full((total, states), -1e9), np.full((total, states), -1e9)
        alpha[base[:-1], 0] = 0.0
        longest = int(sizes.max())
        by_turn = np.argsort(turn, kind="stable")
        turns = np.searchsorted(turn[by_turn], np.arange(longest + 2))
        end_order = np.lexsort((b, turn[b]))
        end_cut = np.searchsorted(turn[b][end_order], np.arange(longest + 2))
        for t in range(1, longest + 1):
            at = by_turn[turns[t] : turns[t + 1]]
            alpha[at, 0] = _lse(alpha[at - 1] + follow[:, 0], 1)
            k = end_order[end_cut[t] : end_cut[t + 1]]
            if len(k):
                x = _lse(alpha[a[k]][:, :, None] + follow[None, :, 1:], 1) + e[k]
                to, cut = np.unique(b[k], return_index=True)
                alpha[to, 1:] = _lse_groups(x, cut)
        ends = base[1:] - 1
        beta[ends] = 0.0
        start_order = np.lexsort((a, turn[a]))
        start_cut = np.searchsorted(turn[a][start_order], np.arange(longest + 2))
        for t in range(longest - 1, -1, -1):
            at = by_turn[turns[t] : turns[t + 1]]
            at = at[~np.isin(at, ends)]
            beta[at] = follow[:, 0] + beta[at + 1, :1]
            k = start_order[start_cut[t] : start_cut[t + 1]]
            if len(k):
                to, cut = np.unique(a[k], return_index=True)
                out = _lse_groups(e[k] + beta[b[k], 1:], cut)
                beta[to] = np.logaddexp(beta[to], _lse(follow[None, :, 1:] + out[:, None, :], 2))
        z = _lse(alpha[ends], 1)
        step = alpha[a][:, :, None] + follow[None, :, 1:] + (e + beta[b, 1:] - z[of][:, None])[:, None, :]
        share = np.exp(np.minimum(step, 0.0))  # probability of each segment, by the state before and its kind
        moves = np.zeros((states, states))
        moves[:, 1:] -= share.sum(0)
        inner = np.flatnonzero(~np.isin(np.arange(total), ends))
        region = np.repeat(np.arange(len(regions_)), sizes + 1)
        moves[:, 0] -= np.exp(np.minimum(alpha[inner] + follow[:, 0] + beta[inner + 1, :1] - z[region[inner]][:, None], 0.0)).sum(0)
        change = -share.sum(1)
        where = np.full(len(found.i), -1)
        where[seg] = np.arange(len(seg))
        for n, r in enumerate(regions_):
            upto, state = 0, 0
            for k, kind in sorted(self.gold[r], key=lambda g: self.local[g[0]]):
                change[where[k], kind] += 1.0
                low = int(self.local[k])
                if low > upto:
                    moves[state, 0] += 1
                    moves[0, 0] += low - upto - 1
                    state = 0
                moves[state, kind + 1] += 1
                state, upto = kind + 1, low + int(self.span[k])
            if upto < sizes[n]:
                moves[state, 0] += 1
                moves[0, 0] += sizes[n] - upto - 1
        moves[0, 0] = 0.0
        return seg, change, moves


def _lse_groups(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(x, cut)
    sizes = np.diff(np.append(cut, len(x)))
    return top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, sizes, axis=0)), cut))


def fit(texts: list[str], spans: list[list[Span]], epochs: int = EPOCHS, seed: int = 5) -> Field:
    """A field fitted to labelled texts, by scaled gradient steps over small batches."""
    field = Field()
    own = Trainer(segments_of(texts), spans)
    rng = random.Random(seed)
    seen, seen_moves = np.full(field.weights.shape, 1e-6), np.full(field.follow.shape, 1e-6)
    order = list(own.whole)
    for _ in range(epochs):
        rng.shuffle(order)
        for low in range(0, len(order), BATCH):
            part = order[low : low + BATCH]
            seg, change, moves = own.gradient(field, part)
            grad = np.zeros(field.weights.shape)
            busy = np.abs(change).max(1) > 1e-6 if len(change) else np.zeros(0, bool)
            for k in range(WIDTH):
                np.add.at(grad, own.found.features[seg[busy], k], change[busy])
            grad = grad / len(part) - DECAY * field.weights
            moves /= len(part)
            seen += grad**2
            seen_moves += moves**2
            field.weights += (RATE * grad / np.sqrt(seen)).astype(np.float32)
            field.follow += RATE * moves / np.sqrt(seen_moves)
            field.follow[0, 0] = 0.0
    return field


def train(docs: DataFrame, most_docs: int = 1_500, examples: int = EXAMPLES, most_chars: int = 4_000) -> Field:
    """A field fitted to ``examples`` texts with planted data.

    The words around the plants are those of at most ``most_docs`` documents, of lowest hash of doc_id and text, and of
    each of these the words of a stretch of ``most_chars`` characters at a hashed place: a bounded sample, to learn
    surroundings from.  The search reads whole texts.
    """
    text = F.col("text").cast("string")
    hashed = docs.select(F.xxhash64(F.col("doc_id").cast("string"), text).alias("h"), text.alias("text")).filter("text is not null")
    lowest = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(most_docs).collect()]  # numbers only
    begin = F.pmod("h", F.greatest(F.length("text") - most_chars + 1, F.lit(1))).cast("int") + 1
    picked = hashed.filter(F.col("h") <= (lowest[-1] if lowest else 0)).select("h", F.substring("text", begin, F.lit(most_chars)).alias("text"))
    rows = picked.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect()
    words = [w for r in rows for w in r.text.split() if not TRIGGER.search(w)] or ["the"]
    rng = random.Random(11)
    made = [example(rng, words, KINDS) for _ in range(examples)]
    return fit([t for t, _ in made], [s for _, s in made])


def added_spans(texts: list[str], base: list[list[Span]], field: Field) -> list[list[Span]]:
    """For each text the segments that the field finds beside its base spans."""
    out: list[list[Span]] = [[] for _ in texts]
    tokens, of, blocked = Tokens(), [], bytearray()

    def search() -> None:
        nonlocal tokens, of, blocked
        if of:
            found = Segments(tokens, [texts[d] for d in of], np.frombuffer(blocked, np.uint8).astype(bool), field)
            emissions = found.features
            live = np.unique(found.of)
            cuts = np.searchsorted(found.of, np.stack([live, live + 1]))
            for r, low, high in zip(live.tolist(), *cuts.tolist(), strict=True):
                for s, kind, lead in field.best(found.i[low:high], found.j[low:high], emissions[low:high], int(found.first[r + 1])):
                    if lead >= MARGIN:
                        out[of[r]].append((int(found.start[found.i[low + s]]), kind, int(found.end[found.j[low + s] - 1])))
        tokens, of, blocked = Tokens(), [], bytearray()

    for d, text in enumerate(texts):
        spans = sorted((s, e) for s, _, e in base[d])
        k = 0
        for low, high in regions(text):
            begin = len(tokens.start)
            tokens.add(text, low, high)
            of.append(d)
            for a, b in zip(tokens.start[begin:], tokens.end[begin:], strict=True):
                while k < len(spans) and spans[k][1] <= a:
                    k += 1
                blocked.append(any(s < b and e > a for s, e in spans[k : k + 3]))
        if len(tokens.start) >= BLOCK:
            search()
    search()
    return out


def listed(spans: list[Span]) -> str:
    """kind:start:end of each span, by start, then kind as ``KINDS`` lists it."""
    return ",".join([f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans)])


#: Characters of texts that are searched at once, about.
TOGETHER = 2_000_000


def _searched(column: pa.Array, field: Field) -> Iterator[tuple[list[str | None], list[list[Span]], list[list[Span]]]]:
    """Texts of a column in groups, their base spans and the added ones."""
    group, room = [], TOGETHER
    for n, value in enumerate(column):
        text = value.as_py()
        group.append(text)
        room -= len(text or "")
        if room <= 0 or n == len(column) - 1:
            said = [t or "" for t in group]
            base = [base_spans(t) for t in said]
            yield group, base, added_spans(said, base, field)
            group, room = [], TOGETHER


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, all spans, and how many they are, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans, totals = [[] for _ in BASE_KINDS], [], [], []
            for _, found, more in _searched(batch.column(1), field):
                for base, added in zip(found, more, strict=True):
                    for kind, column in enumerate(counts):
                        column.append(sum(1 for s in base if s[1] == kind))
                    digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                    spans.append(listed(base + added))
                    totals.append(len(base) + len(added))
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans", "n_spans"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; where spans overlap, the first one goes and the rest with it."""
    parts, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def mask(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and ``n_chars``, if there, counted anew.

    Texts without personal data don't come back from Python.
    """
    small_batches(docs.sparkSession)
    own = train(docs) if field is None else field

    @F.arrow_udf("string")
    def changed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            for texts, found, more in _searched(column, own):
                out += [masked(t, b + a) if b or a else None for t, b, a in zip(texts, found, more, strict=True)]
            yield pa.array(out, pa.string())

    kind = docs.schema["text"].dataType
    out = docs.withColumn("text", F.coalesce(changed(F.col("text").cast("string")).cast(kind), F.col("text")))
    out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
    return out.select(docs.columns)


def personal_data(docs: DataFrame) -> DataFrame:
    return find(docs, train(docs))
