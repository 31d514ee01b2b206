"""Periodic runs of words, found online by catchers over completed dyadic blocks.

A run is a stretch of words with smallest period q, at least EXPONENT periods and LEAST_WORDS words long, that
no neighbouring word extends. Periods are dealt out to levels (1 to 16, 17 to 32, 33 to 64, ...). As words are
appended, every aligned block of a level's size (a power of two) that is complete gets a catcher, which
waits for the block's words to come again at a distance among the level's periods: each appended word ends
one suffix of the block's length, whose fingerprint is compared with the catchers that wait for it. The
block size is chosen so that any run of the level holds a whole block that comes again one period later, so
no run is missed. A hit is a square in the making: it is stretched backwards and forwards as far as words one
period apart are equal, squares of one stretch merge, and a stretch that reaches the last word stays open
and goes on with the next words. A hit inside a stretch of a smaller period is a multiple of it and is
passed over.

Fingerprints are polynomial hashes of two primes over prefix sums, so that any stretch is compared in a step,
and all words of one append in one numpy operation; every run is checked word by word before it is
reported. Documents of a batch are one stream: a separator that occurs once ends each, so no run crosses it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import map_batches

LEAST_WORDS, EXPONENT = 24, 3
#: Largest period of the first level, and words that are appended to a stream at a time.
FIRST_PERIODS, APPEND = 16, 1 << 16
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1664525753)


def _powers(base: int, prime: int, count: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    while len(out) < count:
        out = np.r_[out, out * pow(base, len(out), prime) % prime]
    return out[:count]


class Fingerprints:
    """Words of a stream as numbers, and hashes of any of its stretches."""

    def __init__(self):
        self.size = 0
        self.words = np.empty(0, np.int64)
        self.prefix = [np.zeros(1, np.int64) for _ in PRIMES]
        self.power, self.inverse = ([np.empty(0, np.int64) for _ in PRIMES] for _ in range(2))

    def reserve(self, size: int) -> None:
        if size <= len(self.words):
            return
        room = max(size, 2 * len(self.words))
        self.words = np.r_[self.words, np.zeros(room - len(self.words), np.int64)]
        self.prefix = [np.r_[p, np.zeros(room + 1 - len(p), np.int64)] for p in self.prefix]
        self.power = [_powers(b, p, room) for b, p in zip(BASES, PRIMES, strict=True)]
        self.inverse = [_powers(pow(b, -1, p), p, room) for b, p in zip(BASES, PRIMES, strict=True)]

    def append(self, words: np.ndarray) -> None:
        start, end = self.size, self.size + len(words)
        self.reserve(end)
        self.words[start:end] = words
        mixed = words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        for i, prime in enumerate(PRIMES):
            part = ((mixed >> np.uint64(32 * i)).astype(np.int64) & 0x7FFFFFFF) % prime
            self.prefix[i][start + 1 : end + 1] = (self.prefix[i][start] + np.cumsum(part * self.power[i][start:end] % prime)) % prime
        self.size = end

    def span(self, first: int, end: int, length: int) -> np.ndarray:
        """Hashes of the stretches of one length that start at first to end - 1."""
        parts = []
        for i, prime in enumerate(PRIMES):
            g = self.prefix[i]
            parts.append((g[first + length : end + length] - g[first:end] + prime) * self.inverse[i][first:end] % prime)
        return parts[0] << 31 | parts[1]

    def equal(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the stretches of one length that start at a and at b are the same."""
        same = np.ones(len(a), bool)
        for i, prime in enumerate(PRIMES):
            g, inverse = self.prefix[i], self.inverse[i]
            same &= (g[a + length] - g[a] + prime) * inverse[a] % prime == (g[b + length] - g[b] + prime) * inverse[b] % prime
        return same

    def reach(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, back: bool = False) -> np.ndarray:
        """Up to limit, how many words from a and from b on are equal (back: how many before them)."""
        done = np.zeros(len(a), np.int64)
        step = 1 << int(limit.max(initial=0)).bit_length()
        while step:
            at = np.flatnonzero(done + step <= limit)
            if len(at):
                shift = -done[at] - step if back else done[at]
                at = at[self.equal(a[at] + shift, b[at] + shift, step)]
                done[at] += step
            step >>= 1
        return done


class SquareCatcher:
    """Reports the runs of a stream of numbers as they end."""

    def __init__(self, max_period: int | None = None, least: int = LEAST_WORDS, exponent: int = EXPONENT):
        if exponent < 2:
            raise ValueError("runs have two periods at least")
        self.text, self.least, self.exponent, self.max_period = Fingerprints(), least, exponent, max_period
        # for each level the fingerprints of its completed blocks, and the start of the first suffix that is still to come
        self.blocks: list[np.ndarray] = []
        self.seen: list[int] = []
        self.open = np.empty((0, 3), np.int64)  # start, end, period
        self.found: list[np.ndarray] = []

    def level(self, number: int) -> tuple[int, int, int]:
        """(block size, smallest period, largest period + 1) of a level."""
        low, high = (1, FIRST_PERIODS + 1) if not number else ((FIRST_PERIODS << number - 1) + 1, (FIRST_PERIODS << number) + 1)
        turn = self.least // self.exponent
        # words one period apart are equal over this many places at least in any run of the level
        places = min(max(self.least - q, (self.exponent - 1) * q) for q in {low, high - 1, *(min(max(t, low), high - 1) for t in (turn, turn + 1))})
        return 1 << ((places + 1) // 2).bit_length() - 1, low, high

    def append(self, words: np.ndarray) -> None:
        before = self.text.size
        self.text.append(words)
        n = self.text.size
        live = self.stretch_on(before)
        number = 0
        while True:
            block, low, high = self.level(number)
            if low * self.exponent > n or (self.max_period is not None and low > self.max_period):
                break
            if number == len(self.blocks):
                self.blocks.append(np.empty(0, np.int64))
                self.seen.append(0)
            hits = self.caught(number, block, low, high)
            if len(hits):
                hits = hits[~self.inside(hits, block, live)]
            if len(hits):
                live = np.r_[live, self.stretched(hits, block)]
            number += 1
        ended = live[:, 1] < n
        self.report(live[ended])
        self.open = live[~ended]

    def stretch_on(self, before: int) -> np.ndarray:
        """The open stretches as far as the new words reach; the sorted, distinct ones."""
        start, end, period = self.open.T
        more = self.text.reach(end - period, end, np.full(len(end), self.text.size - before))
        return np.c_[start, end + more, period]

    def caught(self, number: int, block: int, low: int, high: int) -> np.ndarray:
        """(block start, distance) of new suffixes that are equal to a waiting block."""
        done, first, last = len(self.blocks[number]) * block, self.seen[number], self.text.size - block + 1
        if last <= first:
            return np.empty((0, 2), np.int64)
        keys = self.text.span(first, last, block)
        own = np.arange(done, last, block)
        self.blocks[number] = np.r_[self.blocks[number], keys[own - first]]
        self.seen[number] = last
        at = np.arange(first, last)
        hits = []
        for turn in range(-(-(high - low) // block)):
            k = (at - low) // block - turn
            ok = np.flatnonzero(k >= 0)
            ok = ok[self.blocks[number][k[ok]] == keys[ok]]
            q = at[ok] - k[ok] * block
            hits.append(np.c_[k[ok] * block, q][q < high])
        return np.concatenate(hits)

    def inside(self, hits: np.ndarray, block: int, live: np.ndarray) -> np.ndarray:
        """Hits within a stretch of a period up to the block size: their distance is a multiple of a smaller period."""
        small = live[live[:, 2] <= block]
        own = np.zeros(len(hits), bool)
        if len(small):
            small = small[np.argsort(small[:, 0], kind="stable")]
            furthest = np.maximum.accumulate(small[:, 1])
            at = np.searchsorted(small[:, 0], hits[:, 0], "right") - 1
            own = (at >= 0) & (furthest[at] >= hits.sum(1) + block) & (hits[:, 1] > block)
        # and hits of a stretch that is known with the same period
        order = np.lexsort((live[:, 0], live[:, 2]))
        known = live[order]
        n = self.text.size + 1
        at = np.searchsorted(known[:, 2] * n + known[:, 0], hits[:, 1] * n + hits[:, 0], "right") - 1
        if len(known):
            own |= (at >= 0) & (known[at, 2] == hits[:, 1]) & (known[at, 1] >= hits.sum(1) + block)
        return own

    def stretched(self, hits: np.ndarray, block: int) -> np.ndarray:
        """Distinct (start, end, period) of the stretches around the hits."""
        s, q = hits.T
        back = self.text.reach(s, s + q, s, back=True)
        on = self.text.reach(s + block, s + q + block, self.text.size - s - q - block)
        return np.unique(np.c_[s - back, s + block + on + q, q], axis=0)

    def report(self, stretches: np.ndarray) -> None:
        length = stretches[:, 1] - stretches[:, 0]
        self.found.append(stretches[length >= np.maximum(self.least, self.exponent * stretches[:, 2])])

    def finish(self) -> np.ndarray:
        """start, length, period of every run, by start, then period."""
        self.report(self.open)
        self.open = np.empty((0, 3), np.int64)
        runs = np.unique(np.concatenate(self.found), axis=0) if self.found else self.open
        # a stretch that is periodic with several of its multiples is one run, with the smallest
        runs = runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(1)][: len(runs)]]
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        words, n = self.text.words, self.text.size
        for start, end, q in runs.tolist():
            whole = np.array_equal(words[start : end - q], words[start + q : end])
            if not whole or (start and words[start - 1] == words[start + q - 1]) or (end < n and words[end] == words[end - q]):
                raise RuntimeError("two different stretches have equal fingerprints")
        return np.c_[runs[:, 0], runs[:, 1] - runs[:, 0], runs[:, 2]]


def runs_of(documents: list[list[bytes]], least: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each document, by start, then period."""
    number: dict[bytes, int] = {}
    longest = max(map(len, documents), default=0)
    catcher = SquareCatcher(longest // exponent, least, exponent)
    starts = np.cumsum([0, *[len(words) + 1 for words in documents]])
    stream = np.empty(starts[-1], np.int64)
    for i, words in enumerate(documents):
        stream[starts[i] : starts[i + 1] - 1] = [number.setdefault(w, len(number)) for w in words]
        stream[starts[i + 1] - 1] = -1 - i
    catcher.text.reserve(len(stream))
    for i in range(0, len(stream), APPEND):
        catcher.append(stream[i : i + APPEND])
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    runs = catcher.finish()
    for doc, (start, length, period) in zip((np.searchsorted(starts, runs[:, 0], "right") - 1).tolist(), runs.tolist(), strict=True):
        out[doc].append((start - int(starts[doc]), length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    turn = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        turn[start + period] += 1
        turn[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(turn[:-1]) == 0)]


Words, Runs = list[bytes], list[tuple[int, int, int]]


def scan(
    docs: DataFrame, emit: Callable[[list[Words], list[Runs]], list[pa.Array]], fields: dict[str, str], prepare: Callable[[object, Words], Words] | None = None, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The id and the fields that emit(words, runs) makes for every batch of documents; prepare changes a document's words first."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            # ASCII whitespace alone parts words, as bytes.split has it
            words = [(x.as_py() or "").encode("utf-8").split() for x in batch.column(1)]
            if prepare:
                words = [prepare(i, w) for i, w in zip(ids, words, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *emit(words, runs_of(words))], ["id", *fields])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = ", ".join(f"{name} {of}" for name, of in {"id": kind, **fields}.items())
    return rows.transform(map_batches, scanned, schema).withColumnRenamed("id", id_col)


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run: the id, start (word number), length, period.

    Null and empty texts, and texts without runs, give no rows; null and repeated ids are documents like any
    other; texts of any length are read whole; other columns are not looked at, whatever their names.
    """

    def emit(words: list[Words], runs: list[Runs]) -> list[pa.Array]:
        return [pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))]

    found = docs.transform(scan, emit, {"runs": "array<struct<start:bigint,length:bigint,period:bigint>>"}, id_col=id_col, text_col=text_col)
    return found.select(id_col, F.inline("runs"))


def collapse_text(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_runs and the text with each run cut to its first period: kept words joined by one space; cases as in find_runs, but every document has its row."""

    def emit(words: list[Words], runs: list[Runs]) -> list[pa.Array]:
        texts = [b" ".join(collapsed(w, r)).decode("utf-8") for w, r in zip(words, runs, strict=True)]
        return [pa.array(list(map(len, runs)), pa.int64()), pa.array(texts, pa.string())]

    return docs.transform(scan, emit, {"n_runs": "long", "collapsed": "string"}, id_col=id_col, text_col=text_col)


def with_planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a periodic end in about a tenth of the documents, by the checksum of the id; none where the id is null."""
    n = len(words)
    checksum = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if checksum % 10 or not n:
        return words
    g = checksum // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    return words[:start] + (words[start : start + period] * (-(-(n - start) // period)))[: n - start]


def run_report(docs: DataFrame) -> DataFrame:
    """One row per document, over words with planted periods: n_runs, the run of the greatest exponent, digests of all runs and of the collapsed text.

    Null and empty texts have no words and no runs; a null id plants nothing; repeated ids are rows like any
    other; an empty table gives no rows.
    """

    def emit(words: list[Words], runs: list[Runs]) -> list[pa.Array]:
        best = [max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if own else None for own in runs]
        columns = [[b and b[i] for b in best] for i in range(3)] + [[b and 1000 * b[1] // b[2] for b in best]]
        lists = [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest() for own in runs]
        texts = [hashlib.sha256(b" ".join(collapsed(w, r))).hexdigest() for w, r in zip(words, runs, strict=True)]
        return [pa.array(list(map(len, runs)), pa.int64()), *[pa.array(c, pa.int64()) for c in columns], pa.array(lists, pa.string()), pa.array(texts, pa.string())]

    numbers = dict.fromkeys(["n_runs", "start", "length", "period", "exponent_milli"], "long")
    return docs.transform(scan, emit, {**numbers, "runs_sha256": "string", "collapsed_sha256": "string"}, with_planted_period)
