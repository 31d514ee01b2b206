"""Token ids on disk: an adaptive context-mixing range coder over independent, checksummed blocks.

Documents are written in ascending order of their ids as segments, rows of a Parquet table: a segment holds
whole documents and is cut into blocks of BLOCK_IDS ids. Every block starts from a fresh model and has its
own checksum, so that each can be read alone and a damaged one is found.

For every id the model has three predictions: the id that followed the last two ids (order 2) and the one
that followed the last (order 1) when they came before, each with a count of how often it was right lately,
and the frequencies of all ids so far (order 0). How sure each order is of the guess, the id that the highest
order predicts, is learned by the order's state; a logistic mixer, whose weights learn, joins the three. What
is left goes to ids seen before, by frequency, and to new ids. The range coder then takes the interval of what
came. Predictions are renewed with every id; probabilities, weights and frequencies every RENEW ids at most,
so that in between the encoder looks them up for many steps at once. All of it is whole-number arithmetic, so
that any machine reads what another wrote. numpy works on many blocks in step: one id of every block at a time.
"""

from __future__ import annotations

import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchloom.llm.common import map_batches, scratch_root

END_ID = 2
BLOCK_IDS = 2048
#: Blocks that are coded in step, and so the ids of a segment (more only in one document).
LANES = 2048
SEGMENT_IDS = BLOCK_IDS * LANES
MAGIC, HEAD, BLOCK = b"CMX2", struct.Struct("<4sIII"), struct.Struct("<IIII")
#: Pieces of texts that one worker keeps.
PIECES = 1 << 20
#: Bytes of text that are cut into pieces together (more only in one batch).
TEXT_BYTES = 1 << 24
#: Groups of contexts by the last id in a block, and contexts in a group; frequencies that a block tells apart.
GROUPS, GROUP, COUNTS = 512, 8, 1024
#: Steps between renewals at most, half as many in a block's first 2 * RENEW; counts of right predictions end at MOST_RIGHT.
RENEW, MOST_RIGHT = 256, 7
ONE, HALF_WORD, WORD = 1 << 16, np.uint64(16), np.uint64(32)
LOW_MASK = (1 << 32) - 1
LOW_WORD = np.uint64(LOW_MASK)
#: The mixer's rate (a shift) and bounds of its weights, where 4096 is one.
LEARN, LEAST_WEIGHT, MOST_WEIGHT = 16, 512, 6144
#: Steps that the encoder looks up together.
STRIDE = 16

#: States of orders 2 (times right), 1 (times right, and whether its prediction is the guess) and 0 (level of the guess's frequency).
ORDERS = np.array([8, 16, 8])
STATES = int(ORDERS.sum())
#: How sure a state is before anything came, of 256, and as many tries this counts.
PRIOR_TRIES = np.full(STATES, 24, np.int64)
PRIOR_SURE = np.array([12, 70, 140, 200, 230, 240, 250, 254, *[14, 14, 20, 100, 27, 140, 40, 200, 30, 225, 20, 235, 20, 245, 20, 250], 30, 40, 40, 40, 40, 40, 40, 48], np.int64)
_STRETCH = np.array([max(-2047, min(2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)], np.int64)
_SQUASH = np.array([max(32, min(ONE - 1024, round(ONE / (1 + math.exp((2048 - i) / 256))))) for i in range(4096)], np.int64)


class Model:
    """What `lanes` blocks know so far. Nothing but `follows` changes between two calls of renew, so that both sides can look up what it says."""

    def __init__(self, lanes: int):
        self.lanes = np.arange(lanes, dtype=np.int64)
        # one order-1 prediction and GROUP - 1 of order 2 lie side by side: (id + 1) << 3 | times right, 0 where there is none
        self.follows = np.zeros((lanes * GROUPS + 1) * GROUP, np.int32)
        self.follows = self.follows[-(self.follows.ctypes.data // 4) % GROUP :]
        self.row = self.lanes * (GROUPS * GROUP)
        self.counts, self.count_row = np.zeros(lanes * COUNTS, np.int16), self.lanes * COUNTS
        # how often a guess came and was right, by the state of each order
        self.tries, self.rights = np.tile(PRIOR_TRIES, (lanes, 1)), np.tile(PRIOR_TRIES * PRIOR_SURE >> 8, (lanes, 1))
        self.state_rows = self.lanes * STATES + (np.cumsum(ORDERS) - ORDERS)[:, None]
        self.weights = np.full((3, lanes), 1400, np.int64)
        self.news, self.misses = np.full(lanes, 3, np.int64), np.full(lanes, 4, np.int64)
        self.new = np.full(lanes, ONE, np.int64)  # before the first renewal every id is new
        self.weigh()

    def weigh(self) -> None:
        """What every state of every order says, in the logistic domain, and that times the order's weight."""
        self.say = _STRETCH.take(self.rights * 4095 // self.tries).astype(np.int32)
        self.said = (self.say * np.repeat(self.weights.T, ORDERS, axis=1)).astype(np.int32).ravel()

    def places(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Places of both orders' contexts, from the scattered last two ids."""
        at = np.empty((2, *last.shape), np.int64)
        np.bitwise_and(last, GROUPS - 1, out=at[1])
        at[1] *= GROUP
        at[1] += self.row
        np.multiply(before, GROUP - 1, out=at[0])
        at[0] >>= 20
        at[0] += 1
        at[0] += at[1]
        return at

    def guesses(self, entries: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For entries of both orders: the guessed id + 1 and the share of ONE that it gets. states: gets the state of the three orders."""
        two, one = entries
        entry = np.where(two > 0, two, one)
        guess = entry >> 3
        np.bitwise_and(two, 7, out=states[0])
        one_state = (one & 7) << 1
        one_state += one >> 3 == guess
        states[1] = one_state
        place = scattered(guess)
        place &= COUNTS - 1
        place += self.count_row
        np.minimum(self.counts[place], 7, out=states[2])
        for own, row in zip(states, self.state_rows, strict=True):
            own += row
        said = self.said[states]
        dot = said[0] + said[1]
        dot += said[2]
        dot >>= 12
        dot += 2048
        share = _SQUASH.take(dot, mode="clip")
        share *= guess > 0
        return guess, share

    def learn(self, at: np.ndarray, entries: np.ndarray, named: np.ndarray) -> None:
        """Take in the ids + 1 that came after the contexts at the places `at` (of both orders, end to end)."""
        self.follows[at] = np.where(entries >> 3 == named, np.minimum(entries + 1, entries | MOST_RIGHT), named << 3 | 1).ravel()

    def renew(self, ids: np.ndarray, share: np.ndarray, states: np.ndarray, hit: np.ndarray, new: np.ndarray) -> None:
        """Learn from the ids + 1 since the last renewal (by step and lane): frequencies; from every second step all else."""
        miss = hit * np.int32(ONE) - share.astype(np.int32)
        miss *= share > 0
        miss >>= 5
        for order, own in enumerate(states):
            found = np.bincount((own << 1 | hit).ravel(), minlength=2 * self.tries.size).reshape(*self.tries.shape, 2)
            self.tries += found[:, :, 0] + found[:, :, 1]
            self.rights += found[:, :, 1]
            step = np.einsum("kl,kl->l", miss, self.say.take(own)) >> LEARN
            self.weights[order] = np.minimum(np.maximum(self.weights[order] + step, LEAST_WEIGHT), MOST_WEIGHT)
        np.add.at(self.counts, ((scattered(ids) & (COUNTS - 1)) + self.count_row).ravel(), np.int16(1))
        # what lies further back counts less
        self.news = (self.news >> 1) + np.count_nonzero(new, axis=0)
        self.misses = (self.misses >> 1) + 1 + len(hit) - np.count_nonzero(hit, axis=0)
        self.new = np.minimum(np.maximum(self.news * ONE // self.misses, ONE // 16), ONE * 15 // 16)
        self.weigh()


class Kept:
    """What a model learns from at its next renewal, of every second step."""

    def __init__(self, steps: int, lanes: int):
        size = ((steps + 1) // 2, lanes)
        self.share, self.states = np.empty(size, np.int64), np.empty((3, *size), np.int64)
        self.hit, self.new = np.empty(size, bool), np.empty(size, bool)

    def put(self, at: int | slice, share: np.ndarray, states: np.ndarray, hit: np.ndarray, new: np.ndarray) -> None:
        self.share[at], self.states[:, at], self.hit[at], self.new[at] = share, states, hit, new


def scattered(ids: np.ndarray) -> np.ndarray:
    """Numbers of 20 bits, spread evenly."""
    mixed = ids * np.int64(0x9E3779B1)
    mixed &= LOW_MASK
    mixed >>= 12
    return mixed


def spans(size: int) -> Iterator[tuple[int, int]]:
    """First and last step between renewals."""
    start = 0
    while start < size:
        end = min(size, max(16, min(start * 2, start + RENEW // (1 if start >= 2 * RENEW else 2))))
        yield start, end
        start = end


def ranked(grid: np.ndarray) -> tuple[np.ndarray, int]:
    """By lane and step: the number of smaller different ids of the lane's whole block; and the most different ids of a lane."""
    lanes, size = grid.shape
    order = grid.astype(np.uint32) << np.uint32(11)
    order |= np.arange(size, dtype=np.uint32)
    order.sort(axis=1)
    out, most = np.empty((lanes, size), np.int32), 0
    for lane in range(lanes):
        own = order[lane]
        rank = np.zeros(size, np.int32)
        np.cumsum((own[1:] ^ own[:-1]) >= np.uint32(BLOCK_IDS), out=rank[1:])
        out[lane][own & np.uint32(BLOCK_IDS - 1)] = rank
        most = max(most, int(rank[-1]))
    return out, most + 1


def encode_blocks(ids: np.ndarray, vocabulary: int) -> list[bytes]:
    """One stream for every BLOCK_IDS ids (all below vocabulary)."""
    lanes = -(-len(ids) // BLOCK_IDS)
    if not lanes:
        return []
    if vocabulary > 1 << 21:
        raise ValueError("a new id must fit the least share that it can get")
    bits = (vocabulary - 1).bit_length()
    size = min(BLOCK_IDS, len(ids))
    short = len(ids) - (lanes - 1) * BLOCK_IDS
    # the last block may be shorter: its lane goes on with zeros, but its stream ends before them
    grid = np.zeros((lanes, size), np.int32)
    grid.ravel()[: len(ids)] = ids
    rank, width = ranked(grid)
    counts, ends = np.zeros((lanes, width), np.int32), np.zeros((lanes, width), np.int32)
    rank_row = np.arange(lanes) * width
    model = Model(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    out, used = np.empty(lanes * (2 * size + 4), np.uint32), np.arange(lanes) * (2 * size + 4)
    last_stream = b""

    def flush(lane: int) -> bytes:
        return np.r_[out[lane * (2 * size + 4) : used[lane]], np.array([int(low[lane]) >> 32, int(low[lane]) & LOW_MASK], np.uint32)].astype("<u4").tobytes()

    mixed = np.zeros((2, lanes), np.int64)
    for start, end in spans(size):
        steps = end - start
        named = np.ascontiguousarray(grid[:, start:end].T) + np.int32(1)
        kept = Kept(steps, lanes)
        spots = np.add(rank[:, start:end].T, rank_row, order="C")
        for first in range(0, steps, STRIDE):
            own = slice(first, min(steps, first + STRIDE))
            ids_own = named[own]
            mixed = np.concatenate([mixed[-2:], scattered(ids_own)])
            at = model.places(mixed[1:-1], mixed[:-2])
            at = at.transpose(1, 0, 2).reshape(-1, 2 * lanes)
            entries = np.empty(at.shape, np.int32)
            for k, name in enumerate(ids_own):
                entries[k] = found = model.follows[at[k]]
                model.learn(at[k], found.reshape(2, -1), name)
            states = np.empty((3, *ids_own.shape), np.int64)
            guess, share = model.guesses(entries.reshape(-1, 2, lanes).transpose(1, 0, 2), states)
            hit = guess == ids_own
            count = counts.take(spots[own])
            begin = ends.take(spots[own]) - count
            new = count == 0
            new &= ~hit
            seen = ~(hit | new)
            left = ONE - share
            fresh = left * model.new >> 16
            # of the span's 2^16 parts those before, and the id's; of these units again those before, and the id's
            before = share + seen * fresh
            before *= ~hit
            parts = np.where(hit, share, np.where(new, fresh, left - fresh)).view(np.uint64)
            ahead = np.where(new, ids_own - 1, seen * begin).astype(np.uint64)
            wide = np.where(seen, count, 1).astype(np.uint64)
            units = np.where(new, 1 << bits, np.where(seen, max(start, 1), 1)).view(np.uint64)
            before = before.view(np.uint64)
            kept.put(slice(first // 2, (own.stop + 1) // 2), share[::2], states[:, ::2], hit[::2], new[::2])
            for k in range(len(ids_own)):
                if start + first + k == short:
                    last_stream = flush(lanes - 1)
                part = span >> HALF_WORD
                add = part * before[k]
                part *= parts[k]
                part //= units[k]
                add += part * ahead[k]
                low += add
                span = part
                span *= wide[k]
                over = np.flatnonzero(low < add)
                place = used[over] - 1
                while len(over):
                    out[place] += np.uint32(1)
                    on = out[place] == 0
                    over, place = over[on], place[on] - 1
                go = np.flatnonzero(span <= LOW_WORD)
                a = low[go]
                place = used[go]
                out[place] = a >> WORD
                used[go] = place + 1
                low[go] = a << WORD
                span[go] <<= WORD
        model.renew(named, kept.share, kept.states, kept.hit, kept.new)
        np.add.at(counts.ravel(), spots.ravel(), np.int32(1))
        np.cumsum(counts, axis=1, out=ends)
    streams = [flush(i) for i in range(lanes)]
    if short < size:
        streams[-1] = last_stream
    return streams


def decode_blocks(streams: list[bytes], sizes: list[int], vocabulary: int) -> np.ndarray:
    """The ids of blocks, of which all but the last have one size."""
    lanes = len(streams)
    if not lanes:
        return np.empty(0, np.int64)
    size, short = sizes[0], sizes[-1]
    if len(set(sizes[:-1])) > 1 or short > size:
        raise ValueError("blocks are of one size, but for a shorter last one")
    bits = np.uint64((vocabulary - 1).bit_length())
    most = max(map(len, streams)) // 4 + 1
    words = np.zeros((lanes, most), np.uint32)
    for i, stream in enumerate(streams):
        words[i, : len(stream) // 4] = np.frombuffer(stream, "<u4")
    words = words.ravel().astype(np.uint64)
    model = Model(lanes)
    # code: from the low end of the span
    span, place = np.full(lanes, 2**64 - 1, np.uint64), np.arange(lanes, dtype=np.int64) * most
    code = words[place] << WORD | words[place + 1]
    place += 2
    # ids by step, and by lane, these sorted up to the last renewal
    grid, sorted_ids = np.zeros((size, lanes), np.int32), np.zeros((lanes, size), np.uint16 if bits <= 16 else np.int32)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for start, end in spans(size):
        if start:
            change = np.ones((lanes, start), np.int8)
            np.not_equal(sorted_ids[:, 1:start], sorted_ids[:, : start - 1], out=change[:, 1:].view(bool))
            runs = np.append(np.flatnonzero(change), lanes * start)
            run_of, slots = np.cumsum(change.ravel(), dtype=np.int32), sorted_ids[:, :start].ravel()
        steps = end - start
        kept, states, is_new = Kept(steps, lanes), np.empty((3, lanes), np.int64), np.zeros(lanes, bool)
        total = np.uint64(max(start, 1))
        for k in range(steps):
            at = model.places(last, before).ravel()
            entries = model.follows[at].reshape(2, -1)
            named, share = model.guesses(entries, states)
            part = span >> HALF_WORD
            span = part * share.view(np.uint64)
            hit = code < span
            miss = np.flatnonzero(~hit)
            p, left = part[miss], ONE - share[miss]
            rest = code[miss] - span[miss]
            fresh = left * model.new[miss] >> 16
            edge = p * fresh.view(np.uint64)
            new = rest < edge
            n = np.flatnonzero(new)
            own, unit = miss[n], edge[n] >> bits
            ahead = rest[n]
            value = ahead // unit
            named[own], code[own], span[own] = value + np.uint64(1), ahead - value * unit, unit
            if k % 2 == 0:
                is_new[:] = False
                is_new[own] = True
                kept.put(k // 2, share, states, hit, is_new)
            if start:
                n = np.flatnonzero(~new)
                own, rest, unit = miss[n], rest[n] - edge[n], p[n] * (left[n] - fresh[n]).view(np.uint64) // total
                row = own * start
                slot = np.minimum(rest // unit, total - np.uint64(1)).view(np.int64) + row
                run = run_of[slot]
                begin = runs[run - 1]
                named[own] = slots[slot].astype(np.int32) + 1
                code[own] = rest - (begin - row).view(np.uint64) * unit
                span[own] = (runs[run] - begin).view(np.uint64) * unit
            go = np.flatnonzero(span <= LOW_WORD)
            spot = place[go]
            code[go] = code[go] << WORD | words.take(spot, mode="clip")
            place[go] = spot + 1
            span[go] <<= WORD
            grid[start + k] = named
            model.learn(at, entries, named)
            before, last = last, scattered(named)
        model.renew(grid[start:end], kept.share, kept.states, kept.hit, kept.new)
        sorted_ids[:, start:end] = grid[start:end].T - 1
        sorted_ids[:, :end].sort(axis=1)
    return np.ascontiguousarray(grid.T).ravel()[: (lanes - 1) * size + short] - 1


def pack_segment(ids: np.ndarray, vocabulary: int) -> bytes:
    """A segment's bytes: head; ids, bytes, checksums of ids and of the stream for every block; streams."""
    streams: list[bytes] = []
    for i in range(0, len(ids), SEGMENT_IDS):
        streams += encode_blocks(ids[i : i + SEGMENT_IDS], vocabulary)
    blocks = [ids[i : i + BLOCK_IDS].astype("<u4") for i in range(0, len(ids), BLOCK_IDS)]
    table = b"".join(BLOCK.pack(len(b), len(s), zlib.crc32(b.tobytes()), zlib.crc32(s)) for b, s in zip(blocks, streams, strict=True))
    return HEAD.pack(MAGIC, vocabulary, BLOCK_IDS, len(streams)) + table + b"".join(streams)


def unpack_segment(data: bytes) -> np.ndarray:
    """The ids of a segment (uint32); raises ValueError where a block's checksum is not its own."""
    magic, vocabulary, _, count = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of token blocks")
    table = [BLOCK.unpack_from(data, HEAD.size + i * BLOCK.size) for i in range(count)]
    at, parts = HEAD.size + count * BLOCK.size, []
    for i in range(0, count, LANES):
        own, streams = table[i : i + LANES], []
        for number, (_, n, _, checksum) in enumerate(own, i):
            streams.append(data[at : at + n])
            at += n
            if zlib.crc32(streams[-1]) != checksum:
                raise ValueError(f"block {number} of a segment is damaged")
        parts.append(decode_blocks(streams, [block[0] for block in own], vocabulary).astype("<u4"))
    ids = np.concatenate(parts) if parts else np.empty(0, "<u4")
    start = 0
    for number, (n, _, checksum, _) in enumerate(table):
        if zlib.crc32(ids[start : start + n].tobytes()) != checksum:
            raise ValueError(f"block {number} of a segment is not what was written")
        start += n
    return ids


#: Kinds of characters, as far as their bytes tell them for certain: NOT_SPACE and UNSURE are what is left.
NOT_SPACE, LETTER, DIGIT, OTHER, QUOTE, UNSURE, SPACE, BLANK, GOES_ON = range(9)


def _kinds() -> bytes:
    """The kind of each first byte of a character; of these only ASCII, Latin, Cyrillic and the older CJK letters are told apart."""
    kinds = np.full(256, UNSURE, np.uint8)
    kinds[33:127] = OTHER
    for first, last, kind in ((48, 57, DIGIT), (65, 90, LETTER), (97, 122, LETTER), (9, 13, BLANK), (32, 32, SPACE), (39, 39, QUOTE), (0x80, 0xBF, GOES_ON), (0xC3, 0xF4, NOT_SPACE), (0xE1, 0xE3, UNSURE)):
        kinds[first : last + 1] = kind
    kinds[[*range(0xC3, 0xCA), 0xD0, 0xD1, *range(0xE5, 0xE9)]] = LETTER
    return kinds.tobytes()


def _cuts() -> bytes:
    """For the kinds of two neighbours, 9 times the first plus the second: 1 where a pre-token always ends between them, 2 between two blanks."""
    cuts = np.zeros(256, np.uint8)
    for a in range(9):
        for b in range(9):
            if a in (SPACE, BLANK) and b in (SPACE, BLANK):
                cuts[9 * a + b] = 2
            elif a <= QUOTE and b in (SPACE, BLANK) or a == BLANK and b <= QUOTE:
                cuts[9 * a + b] = 1  # one space goes with what follows it, other blanks do not
            elif LETTER <= a <= QUOTE and LETTER <= b <= QUOTE and min(a, OTHER) != min(b, OTHER) and (a, b) != (QUOTE, LETTER):
                cuts[9 * a + b] = 1
    return cuts.tobytes()


_KINDS, _CUTS = _kinds(), _cuts()


class TextEncoder:
    """Ids of whole texts by the library. Texts are cut where a pre-token ends for certain, and the library encodes every different piece once."""

    _shared: tuple[bytes, TextEncoder] | None = None

    @classmethod
    def shared(cls, spec: bytes) -> TextEncoder:
        """The encoder of this worker process: tasks that follow each other in it find its pieces."""
        if cls._shared is None or cls._shared[0] != spec:
            cls._shared = (spec, cls(spec))
        return cls._shared[1]

    def __init__(self, spec: bytes):
        """spec: the content of a byte-level vocabulary file with the public pre-token pattern."""
        self.library = Tokenizer.from_buffer(spec)
        added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.added = regex.compile(b"|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        names = self.library.get_vocab(with_added_tokens=True)
        self.vocabulary = max(names.values()) + 1
        self.spaced = np.zeros(self.vocabulary, bool)
        self.spaced[[i for name, i in names.items() if name[:1] == "\u0120"]] = True  # the byte alphabet's space
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.flat = np.zeros(1, np.int64), np.empty(0, np.int32)

    def learn(self, new: list[bytes]) -> np.ndarray:
        """Numbers of new pieces. Pieces that begin with their only space are encoded end to end, and told apart by ids that begin with a space."""
        texts = [p.decode() for p in new]
        joined = [i for i, (p, t) in enumerate(zip(new, texts, strict=True)) if p[:1] == b" " and not t[-1].isspace() and p.rfind(b" ") == 0]
        ids = np.array([i for e in self.encoded(["".join(map(texts.__getitem__, joined[i : i + 4096])) for i in range(0, len(joined), 4096)]) for i in e], np.int32)
        begins = np.flatnonzero(self.spaced[ids])
        if len(begins) != len(joined) or len(ids) and begins[0]:
            joined, ids, begins = [], ids[:0], begins[:0]  # never seen: a vocabulary that does not keep a space in front
        rest = sorted({*range(len(new))}.difference(joined))
        found = self.encoded([texts[i] for i in rest])
        numbers = np.empty(len(new), np.int64)
        numbers[[*joined, *rest]] = np.arange(len(self.known), len(self.known) + len(new))
        self.known.update(zip(new, numbers.tolist(), strict=True))
        ends = np.append(begins[1:], len(ids)) if len(begins) else begins
        ends = np.append(ends, len(ids) + np.cumsum([len(f) for f in found], dtype=np.int64))
        self.starts = np.append(self.starts, self.starts[-1] + ends)
        self.flat = np.concatenate([self.flat, ids, np.fromiter(chain.from_iterable(found), np.int32)])
        return numbers

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, data: bytes, ends: np.ndarray) -> np.ndarray:
        """Where the pieces of texts that lie end to end (not empty) begin; ends: of the texts."""
        kinds = np.frombuffer(bytearray(data.translate(_KINDS)), np.uint8)
        signs = np.frombuffer(data, np.uint8)
        if not data.isascii():
            odd = np.flatnonzero(signs == 0xC3)
            kinds[odd[(signs[odd + 1] == 0x97) | (signs[odd + 1] == 0xB7)]] = NOT_SPACE  # the signs of multiplication and division
            for _ in range(3):
                on = np.flatnonzero(kinds == GOES_ON)
                kinds[on] = kinds[on - 1]
        cuts = np.frombuffer((kinds[:-1] * np.uint8(9) + kinds[1:]).tobytes().translate(_CUTS), np.uint8)
        cut = np.zeros(len(signs) + 1, bool)
        np.equal(cuts, 1, out=cut[1:-1])
        # the last of several blanks is cut off where something follows
        cut[1:-2] |= (cuts[:-1] == 2) & (kinds[2:] <= QUOTE)
        hard = [ends]
        if self.added:
            at = 0
            while found := self.added.search(data, at):
                start, end = found.span()
                if np.searchsorted(ends, start, "right") == np.searchsorted(ends, end, "left"):
                    cut[start:end] = False
                    hard.append(np.array([start, end]))
                    at = end
                else:  # it lies across two texts
                    at = start + 1
        hard = np.concatenate(hard)
        before = hard[hard > 1] - 1
        cut[before[cuts[before - 1] == 2]] = False
        cut[hard] = True
        cut[0], cut[-1] = True, False
        return np.flatnonzero(cut)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and where each text's end."""
        if len(self.known) > PIECES:
            self.forget()
        texts = texts.fill_null("").cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or bounds[-1] == bounds[0]:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        data = texts.buffers()[2][int(bounds[0]) : int(bounds[-1])].to_pybytes()
        ends = bounds[1:] - bounds[0]
        begins = self.pieces(data, ends)
        own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(data)).astype(np.int64)), pa.py_buffer(data)])
        coded = own.dictionary_encode()
        stops = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1].tolist()
        text = coded.dictionary.buffers()[2].to_pybytes()
        names = list(map(text.__getitem__, map(slice, stops[:-1], stops[1:])))
        at = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self.learn([names[i] for i in new.tolist()])
        first, sizes = self.starts[at], self.starts[at + 1] - self.starts[at]
        which = coded.indices.to_numpy()
        size = sizes.take(which)
        stop = np.cumsum(size)
        ids = self.flat.take(np.repeat(first.take(which) - stop + size, size) + np.arange(stop[-1]))
        return ids, np.append(0, stop).take(np.searchsorted(begins, ends))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, ends[:-1]) if len(ends) else []


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Both columns of batches, joined to about TEXT_BYTES: the more texts meet, the fewer pieces are looked up."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > TEXT_BYTES:
            yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in range(2))
            held, size = [], 0
        if len(batch):
            held.append(batch)
            size += batch.nbytes
    if held:
        yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in range(2))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts, each with end_id after it, in ascending order of the documents' ids.

    The table has shard, segment, n_ids, doc_ids, doc_tokens (with the end) and payload (see pack_segment);
    shards follow each other, and segments within a shard. Null ids come first; rows of one id come in the
    order of their texts' hashes, and may lie in several shards. Null and empty texts have the end id alone;
    texts of any length are written whole; an empty table gives a table without rows; other columns are not
    looked at. The vocabulary file is read on the driver and sent along with the tasks.
    """
    with open(tokenizer_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        encoder = TextEncoder.shared(shared.value)
        shard, segment = TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(held)
            columns = [
                pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([names], pa.list_(kind)),
                pa.array([[len(h) for h in held]], pa.list_(pa.int64())), pa.array([pack_segment(ids, max(encoder.vocabulary, end_id + 1))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["shard", "segment", "n_ids", "doc_ids", "doc_tokens", "payload"])

        for own, texts in gathered(batches):
            kind = own.type
            coded, ends = encoder.encode_column(texts)
            for name, ids in zip(own.to_pylist(), np.split(coded, ends[:-1]), strict=True):
                if held and size + len(ids) >= SEGMENT_IDS:
                    yield block()
                    segment, size = segment + 1, 0
                    names, held = [], []
                names.append(name)
                held.append(np.append(ids, np.int32(end_id)))
                size += len(ids) + 1
        if held:
            yield block()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # rows of one id, even wholly equal ones, can be dealt out to several shards
    keyed = rows.withColumn("h", F.xxhash64("text")).withColumn("n", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange("id", "h", "n").sortWithinPartitions("id", "h", "n").select("id", "text")
    id_type = docs.schema[id_col].dataType.simpleString()
    ordered.transform(map_batches, written, f"shard int, segment int, n_ids long, doc_ids array<{id_type}>, doc_tokens array<long>, payload binary").write.parquet(path)


def read_documents(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """One row per written document: doc_id, start (ids before it), n_tokens, ids_crc32, and with_ids the ids themselves.

    Blocks are decoded where they are read. The only windows are over counts: one row per segment within its
    shard, and one per shard over all.
    """
    blocks = spark.read.parquet(path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids = unpack_segment(batch.column(4)[i].as_py())
                names, sizes = batch.column(2)[i].values, batch.column(3)[i].values.to_numpy()
                ends = np.cumsum(sizes)
                if not len(ends) or ends[-1] != len(ids):
                    raise ValueError("a segment's documents do not add up to its ids")
                own = [ids[end - n : end] for n, end in zip(sizes, ends, strict=True)]
                columns = [
                    pa.array(np.full(len(own), batch.column(0)[i].as_py(), np.int32)), pa.array(np.full(len(own), batch.column(1)[i].as_py(), np.int32)), names,
                    pa.array(ends - sizes), pa.array(sizes), pa.array([zlib.crc32(o.tobytes()) for o in own], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([o.astype(np.int32) for o in own], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["shard", "segment", "doc_id", "inner", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    found = blocks.select("shard", "segment", "doc_ids", "doc_tokens", "payload").transform(
        map_batches, decoded, f"shard int, segment int, doc_id {kind}, inner long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    )
    earlier = (Window.unboundedPreceding, -1)
    counts = blocks.select("shard", "segment", "n_ids")
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(*earlier)), F.lit(0))
    shards = counts.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    shards = shards.select("shard", F.coalesce(F.sum("shard_ids").over(Window.orderBy("shard").rowsBetween(*earlier)), F.lit(0)).alias("ahead"))
    starts = counts.withColumn("within", within).join(shards, "shard").select("shard", "segment", (F.col("within") + F.col("ahead")).alias("before"))
    placed = found.join(starts, ["shard", "segment"])
    return placed.select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_file_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write all documents and read them back: doc_id, start, n_tokens, ids_crc32; cases as in write_tokens."""
    path = f"{scratch_root(docs.sparkSession)}/token-blocks-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path)
    return read_documents(docs.sparkSession, path)
