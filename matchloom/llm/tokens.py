"""Token counts of a byte-level BPE by rank-synchronous array merging.

Pre-tokens of a batch lie end to end in one int32 array. In each round every sequence looks up the
ranks of its adjacent pairs, takes its own lowest rank, and merges all occurrences of that pair, left
to right, in the same numpy step; sequences without a known pair are done. What survives is the count.
Counts of pre-tokens are kept per worker, since words repeat.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import map_batches

#: The public pre-token pattern and byte alphabet of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]

LIMIT = 512
#: Characters of text that are split at a time, and pre-token counts kept by one worker.
CHUNK_CHARS = 1 << 21
CACHE_SIZE = 1 << 19
NO_RANK = np.int32(2**31 - 1)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: printable bytes for themselves, others from 256 up."""
    others = [b for b in range(256) if b not in set(PRINTABLE_BYTES)]
    return {chr(b): b for b in PRINTABLE_BYTES} | {chr(256 + i): b for i, b in enumerate(others)}


class MergeTable:
    """Merge ranks of a vocabulary file as sorted pair keys; its special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.width = max(vocab.values()) + 1
        alphabet = byte_alphabet()
        self.byte_ids = np.zeros(256, np.int32)
        for char, byte in alphabet.items():
            self.byte_ids[byte] = vocab[char]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)


def merge_counts(table: MergeTable, words: list[bytes]) -> np.ndarray:
    """Symbols that survive in each word (none empty) when its lowest-rank pairs are merged round by round."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts = lengths.copy()
    symbols = table.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), lengths)
    while len(symbols) > 1:
        rank = table.rank(symbols[:-1], symbols[1:])
        rank[owner[:-1] != owner[1:]] = NO_RANK
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lowest = np.minimum.reduceat(np.r_[rank, NO_RANK], starts)
        sizes = np.diff(np.r_[starts, len(symbols)])
        live = lowest != NO_RANK
        hit = np.flatnonzero((rank != NO_RANK) & (rank == np.repeat(lowest, sizes)[:-1]))
        if not len(hit):
            break
        # in a run of overlapping hits (a a a) every second one counts, from the left
        run = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
        place = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
        hit = hit[place % 2 == 0]
        symbols = symbols.copy()
        symbols[hit] = table.made[rank[hit]]
        stays = np.repeat(live, sizes)
        gone = np.zeros(len(symbols), bool)
        gone[hit + 1] = True
        counts -= np.bincount(owner[hit + 1], minlength=len(words))
        symbols, owner = symbols[stays & ~gone], owner[stays & ~gone]
    return counts


class TokenCounter:
    """Counts tokens of texts; whole pre-tokens are merged once and remembered."""

    def __init__(self, table: MergeTable):
        self.table, self.known = table, {}
        self.find = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(table.special, key=len, reverse=True)))) if table.special else None

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if new:
            self.known.update(zip(new, merge_counts(self.table, [w.encode("utf-8") for w in new]).tolist(), strict=True))

    def count_all(self, texts: Iterator[str | None]) -> list[int]:
        """Tokens of each text. Pre-tokens are gathered over about CHUNK_CHARS of text, and the new ones merged together."""
        counts: list[int] = []
        held: list[tuple[int, list[str]]] = []
        size = 0
        for row, text in enumerate(texts):
            parts = self.special.split(text or "") if self.special else [text or ""]
            counts.append(len(parts) - 1)
            for part in parts:
                for piece in stretches(part):
                    held.append((row, self.find(piece)))
                    size += len(piece)
                    if size >= CHUNK_CHARS:
                        self.settle(held, counts)
                        held, size = [], 0
        self.settle(held, counts)
        return counts

    def settle(self, held: list[tuple[int, list[str]]], counts: list[int]) -> None:
        if len(self.known) > CACHE_SIZE:
            self.known.clear()
        self.learn(set().union(*[words for _, words in held]))
        for row, words in held:
            counts[row] += sum(map(self.known.__getitem__, words))


def stretches(text: str) -> Iterator[str]:
    """Cut a long text between a letter and a following single space before a letter: no pre-token crosses that."""
    start = 0
    cut = regex.compile(r"\p{L}(?= \p{L})")
    while len(text) - start > CHUNK_CHARS:
        match = cut.search(text, start + CHUNK_CHARS // 2)
        if not match:
            break
        yield text[start : match.end()]
        start = match.end()
    yield text[start:]


def count_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_tokens (long). Null and empty texts have none; special strings count as one token each.

    The vocabulary file is read once on the driver and sent along with the tasks.
    """
    table = docs.sparkSession.sparkContext.broadcast(MergeTable(tokenizer_path))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(table.value)
        for batch in batches:
            counts = counter.count_all(x.as_py() for x in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), batch.column(2)], ["id", "n_tokens", "n_bytes"])

    kind = docs.schema[id_col].dataType.simpleString()
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), size.alias("n_bytes"))
    return rows.transform(map_batches, counted, f"id {kind}, n_tokens long, n_bytes long").withColumnRenamed("id", id_col)


def token_report(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens; null and repeated ids are rows like any other; texts of
    any length are counted whole; an empty table gives no rows; other columns are not looked at, whatever
    their names.
    """
    counts = count_tokens(docs, tokenizer_path)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
