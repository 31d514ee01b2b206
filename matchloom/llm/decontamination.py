"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-case words with single spaces. An item of m characters may have
k = floor(ERROR_RATE * m) edits; it is split into k + 1 pieces, so a passage within k edits holds at
least one piece unchanged. One Aho-Corasick automaton finds every piece hit in a whole document; the
windows around the hits are verified with Myers' bit-parallel edit distance.

Items travel to the tasks in blocks of at most BLOCK_CHARS characters; a larger benchmark takes more
passes over the documents, never a larger broadcast.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import batch_predicate, map_batches

ERROR_RATE = 0.06
BLOCK_CHARS = 4_000_000

_words = re.compile(r"\w+").findall


def normal_text(text: str | None) -> str:
    return " ".join(_words((text or "").lower()))


class Pattern:
    """One item as a Myers pattern: the best semi-global edit distance in a text, and where it ends."""

    def __init__(self, item_id: int, text: str, error_rate: float):
        self.item_id, self.size = item_id, len(text)
        self.budget = int(len(text) * error_rate)
        self.masks: dict[str, int] = defaultdict(int)
        for i, char in enumerate(text):
            self.masks[char] |= 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end) of the closest passage; the first end among equals."""
        full, last = (1 << self.size) - 1, 1 << (self.size - 1)
        above, below, distance = full, 0, self.size
        best, end = self.size, 0
        get = self.masks.get
        for at, char in enumerate(text, 1):
            same = get(char, 0)
            vertical = same | below
            across = (((same & above) + above) ^ above) | same
            rises = below | (full & ~(across | above))
            falls = above & across
            if rises & last:
                distance += 1
            elif falls & last:
                distance -= 1
                if distance < best:
                    best, end = distance, at
            rises, falls = (rises << 1) & full, (falls << 1) & full
            above, below = falls | (full & ~(vertical | rises)), rises & vertical
        return best, end


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE):
        self.patterns = [Pattern(i, t, error_rate) for i, t in items]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, (pattern, (_, text)) in enumerate(zip(self.patterns, items, strict=True)):
            parts = pattern.budget + 1
            for p in range(parts):
                start = p * pattern.size // parts
                pieces[text[start : (p + 1) * pattern.size // parts]].append((number, start))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each item the stretches of the text around its piece hits, overlapping ones joined."""
        found: dict[int, list[list[int]]] = defaultdict(list)
        if not len(self.automaton):
            return found
        for end, (length, places) in self.automaton.iter(text):
            for number, offset in places:
                pattern = self.patterns[number]
                start = end + 1 - length - offset
                found[number].append([max(0, start - pattern.budget), start + pattern.size + pattern.budget])
        for number, spans in found.items():
            spans.sort()
            joined = [spans[0]]
            for span in spans[1:]:
                if span[0] <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], span[1])
                else:
                    joined.append(span)
            found[number] = joined
        return found

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, end, length) of every item within its budget: the closest, then first passage."""
        out = []
        for number, spans in sorted(self.windows(text).items()):
            pattern = self.patterns[number]
            distance, end = min((d, start + e) for start, stop in spans for d, e in [pattern.best(text[start:stop])])
            if distance <= pattern.budget:
                out.append((pattern.item_id, distance, end, pattern.size))
        return out


def item_blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Normalised items (id, text) in blocks that end with the item that fills them; null and empty items are left out.

    Rows are dealt out evenly, whatever ids repeat, and come to the driver one part at a time: it holds no more
    than a block and a part. An item longer than a block is a block, as it must be searched whole.
    """
    usable = items.where("item_id is not null and text is not null").select("item_id", "text")
    total = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // block_chars)
    rows = usable.collect() if parts == 1 else usable.repartition(parts).toLocalIterator() if parts else []
    block, chars = [], 0
    for row in rows:
        block.append((row["item_id"], normal_text(row["text"])))
        chars += len(row["text"])
        if chars >= block_chars:
            yield sorted(x for x in block if x[1])
            block, chars = [], 0
    if block:
        yield sorted(x for x in block if x[1])


def find_leaks(docs: DataFrame, items: DataFrame, *, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, distance, end_char, item_chars.

    Positions count characters of the normalised text. Null and empty texts hold nothing; repeated rows
    and repeated items match one by one; without items, or documents, there are no rows; other columns are
    not looked at, whatever their names. An item of few letters has no error budget and matches inside words.
    """
    spark = docs.sparkSession
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, distance int, end_char long, item_chars int"
    found = spark.createDataFrame([], out)
    for block in item_blocks(items, block_chars):
        shared = spark.sparkContext.broadcast((block, error_rate))

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*shared.value)
            for batch in batches:
                rows = [(i, *m) for i, text in enumerate(batch.column(1)) for m in matcher.matches(normal_text(text.as_py()))]
                at, item, distance, end, size = ([r[c] for r in rows] for c in range(5))
                ids = batch.column(0).take(pa.array(at, pa.int64()))
                columns = [ids, pa.array(item, pa.int64()), pa.array(distance, pa.int32()), pa.array(end, pa.int64()), pa.array(size, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "distance", "end_char", "item_chars"])

        found = found.unionByName(docs.select("doc_id", "text").transform(map_batches, searched, out))
    return found


def drop_leaks(docs: DataFrame, items: DataFrame, *, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents without a benchmark passage, with their own columns, whatever their names; one pass for each block of items."""
    for block in item_blocks(items, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast((block, error_rate))

        def kept(columns: Iterator[pa.Array], shared=shared) -> Iterator[pa.Array]:
            matcher = Matcher(*shared.value)
            for texts in columns:
                yield pa.array([not matcher.matches(normal_text(t.as_py())) for t in texts], pa.bool_())

        docs = docs.where(batch_predicate(docs.sparkSession, kept)("text"))
    return docs
