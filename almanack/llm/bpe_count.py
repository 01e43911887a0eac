"""Counts of byte-level BPE tokens by heap-and-linked-list merging, without ids."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from almanack.llm.textkit import text_slices, worker_state

#: Distinct pieces of text whose counts a worker remembers at once.
CACHE_ENTRIES = 1_500_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_rules(path: str) -> tuple[dict[tuple[int, int], tuple[int, int]], list[str]]:
    """Merge rules as {(left, right): (rank, symbol)} over symbols 0 to 255 for bytes and 256 + rank
    for the merged, and the special strings, of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    number = byte_symbols()
    rules = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        made = number.setdefault(left + right, 256 + rank)
        rules[number[left], number[right]] = (rank, made)
    return rules, [t["content"] for t in spec["added_tokens"]]


def count_merged(piece: bytes, rules: dict) -> int:
    """Symbols left of a piece: initial symbols minus merges.

    The heap holds (rank, place, left, right) of adjacent pairs; neighbours are linked by two
    lists. The pair of lowest rank, leftmost first, is merged; entries whose symbols have changed
    since are skipped when popped. O(n log n) for any piece.
    """
    n = len(piece)
    if n < 2:
        return n
    symbols: list[int] = list(piece)
    heap = [(r[0], i, symbols[i], symbols[i + 1], r[1]) for i in range(n - 1) if (r := rules.get((symbols[i], symbols[i + 1])))]
    heapq.heapify(heap)
    following, preceding, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    while heap:
        _, i, left, right, made = heapq.heappop(heap)
        j = following[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue
        merges += 1
        symbols[i], symbols[j] = made, -1
        k = following[i] = following[j]
        if k < n:
            preceding[k] = i
            if r := rules.get((made, symbols[k])):
                heapq.heappush(heap, (r[0], i, made, symbols[k], r[1]))
        if (h := preceding[i]) >= 0 and (r := rules.get((symbols[h], made))):
            heapq.heappush(heap, (r[0], h, symbols[h], made, r[1]))
    return n - merges


def make_counter(path: str, pattern: str) -> Callable[[str], int]:
    """A function from a text to its number of tokens."""

    class Counts(dict):
        def __missing__(self, piece: str) -> int:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = n = count_merged(piece.encode(), rules)
            return n

    rules, special = load_rules(path)
    split, counts = regex.compile(pattern).findall, Counts()
    # longest first, so that no special string hides behind its own prefix
    cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def count(text: str) -> int:
        if not cut:
            return sum(map(counts.__getitem__, split(text)))
        parts = cut.split(text)
        return len(parts) - 1 + sum(sum(map(counts.__getitem__, split(part))) for part in parts)

    return count


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text under a byte-level BPE vocabulary.

    Returns doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit), a row for each row of docs
    in one narrow pass without a shuffle. Null and empty texts have 0 bytes and 0 tokens; null ids
    stay; equal rows each get their row; other columns are not read. A special string inside a text
    is one token. path is that of the vocabulary and must be readable where the tasks run.
    """

    def run(batches):
        state, key = worker_state(), ("bpe_count", path, pattern)
        if key not in state:
            state[key] = make_counter(path, pattern)
        count = state[key]
        for batch, _, off in text_slices(batches, keep=key):
            tokens = np.fromiter((count(t) if t else 0 for t in batch.column("text").to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(off)), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(docs.dtypes)[id_col]
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
