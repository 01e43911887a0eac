"""Hierarchical multi-length packing of tokenised documents."""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from struct import pack as pack_ints

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from almanack.llm.textkit import text_slices, worker_state

#: Distinct pieces of texts that a worker remembers, at the end of a block, before it lets go of those not met
#: since; one block's are always held.
CACHE_ENTRIES = 500_000
#: Documents packed together at once; also bounds a task's memory beside one text.
PACK_BYTES = 8 << 20
#: Texts of characters below this one (Latin, phonetic) are cut into pieces here. They hold no combining
#: marks and no letters that are new or of unlike classes in other versions of the library's tables.
LATIN_END = 0x250


#: Control characters but for white space.
_CONTROL = bytes([*range(9), *range(14, 32), 127])


def _latin_class(kind: str) -> str:
    """A character class of all letters (L) or numbers (N) below LATIN_END."""
    return "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == kind)


class _Known(dict):
    """Bytes of the ids of each piece; a new one is encoded when it is first asked for."""

    def __init__(self, tokenizer: Tokenizer):
        self.encode, self.older = tokenizer.encode, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            ids = self.encode(piece, add_special_tokens=False).ids
            found = pack_ints(f"<{len(ids)}I", *ids)
        self[piece] = found
        return found

    def age(self) -> None:
        if len(self) > CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()


class PieceEncoder:
    """Ids of whole texts, from the library's ids of remembered pieces.

    Right for vocabularies that lower-case, drop white space and cut a text into the endings below, runs
    of letters, single digits and runs of other characters, each encoded alone. Latin texts are cut here
    and each distinct piece is encoded once. All others are cut at white space only, across which nothing
    joins, and so are texts with control characters or with strings that may be special tokens.
    """

    def __init__(self, path: str):
        self.known = _Known(Tokenizer.from_file(path))
        letters, numbers = _latin_class("L"), _latin_class("N")
        # the vocabulary file's own cut, for lower-case Latin text
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+").findall
        self.ascii_pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall
        self.odd = re.compile(f"[\x00-\x08\x0e-\x1f\x7f-\x9f{chr(LATIN_END)}-\U0010ffff]|<\\|").search

    def cut(self, raw: bytes) -> list[str]:
        if raw.isascii():
            if b"<|" not in raw and len(raw.translate(None, _CONTROL)) == len(raw):
                return self.ascii_pieces(raw.decode("ascii").lower())
        else:
            low = raw.decode("utf-8", "replace").lower()
            if not self.odd(low):
                return self.pieces(low)
        return [chunk.decode("utf-8", "replace") for chunk in raw.split()]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        get = self.known.__getitem__
        out = [b"".join(map(get, self.cut(t))) for t in texts]
        self.known.age()
        return out


def plan(lengths: list[int], top: int, low: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length), for documents of >= 1 tokens.

    Whole windows of `top` are cut off each document. What remains goes to the tier of the least
    power of two that holds it; each tier's pieces, longest first, open windows of that size, whose
    gaps are filled by the longest shorter pieces that fit, then by the head of a shorter piece.
    Windows of size `low` and what is left without filling are joined and cut at powers of two.
    """
    sequences, rest = [], []
    for doc, n in enumerate(lengths):
        whole = n // top * top
        sequences += [[(doc, s, top)] for s in range(0, whole, top)]
        if n > whole:
            rest.append((n - whole, doc, whole))
    rest.sort()
    while rest:
        size, doc, start = rest.pop()
        tier = 1 << (size - 1).bit_length()
        if tier <= low:
            rest.append((size, doc, start))
            break
        window, gap = [(doc, start, size)], tier - size
        while gap and rest:
            at = bisect_left(rest, (gap + 1, -1, -1))
            if at:
                length, doc, start = rest.pop(at - 1)
                window.append((doc, start, length))
                gap -= length
            else:  # all pieces are longer: take the head of the shortest
                length, doc, start = rest.pop(0)
                window.append((doc, start, gap))
                insort(rest, (length - gap, doc, start + gap))
                gap = 0
        if gap:  # nothing is left to fill with
            rest = [(length, doc, start) for doc, start, length in window]
            break
        sequences.append(window)
    left = sum(length for length, _, _ in rest)
    rest.sort(reverse=True)
    while left:
        room = min(top, 1 << (left.bit_length() - 1))
        left -= room
        window = []
        while room:
            length, doc, start = rest.pop()
            take = min(room, length)
            window.append((doc, start, take))
            room -= take
            if take < length:
                rest.append((length - take, doc, start + take))
        sequences.append(window)
    return sequences


def step_groups(sizes: list[int], target: int) -> list[int]:
    """A group for each sequence: longest first to the group with the fewest tokens."""
    heap = [(0, g) for g in range(max(1, round(sum(sizes) / target)))]
    groups = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n, g = heapq.heappop(heap)
        groups[i] = g
        heapq.heappush(heap, (n + sizes[i], g))
    return groups


def pack(docs: DataFrame, path: str, top: int = 2048, low: int = 64, end_id: int = 1, step_tokens: int = 1 << 17, tokens: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most `top` tokens, each a power of two long.

    A document is its ids under the vocabulary file (one that drops white space), then end_id.
    Blocks of documents are packed where they are read, without a shuffle; each block leaves a few
    short sequences, of powers of two, instead of padding. Returns a row for each piece: doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset, and seq_length and step_group (about
    step_tokens tokens each); with tokens=True also ids. sequence_id and step_group hold the number
    of the partition in their upper bits.

    Null text is empty: its document is end_id alone. Null ids stay; equal rows are packed each;
    an empty table gives no rows; other columns are not read. Very long texts are one block.
    """
    from pyspark.sql import types as T

    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "seq_length", "step_group"]

    def run(batches):
        state, key = worker_state(), ("packing", path)
        if key not in state:
            state[key] = PieceEncoder(path)
        encoder, base = state[key], TaskContext.get().partitionId() << 40
        end, n_sequences, n_groups = np.array([end_id], "<u4").tobytes(), 0, 0
        for batch, raw, off in text_slices(batches, limit=PACK_BYTES, keep=key):
            whole = raw.tobytes()
            ids = [x + end for x in encoder.encode([whole[a:b] for a, b in zip(off[:-1], off[1:])])]
            lengths = [len(x) // 4 for x in ids]
            sequences = plan(lengths, top, low)
            sizes = [sum(length for _, _, length in s) for s in sequences]
            groups = step_groups(sizes, step_tokens)
            rows = []
            for q, (pieces, size, group) in enumerate(zip(sequences, sizes, groups)):
                at = 0
                for doc, start, length in pieces:
                    rows.append((doc, start, length, zlib.crc32(ids[doc][4 * start : 4 * (start + length)]), lengths[doc], base + n_sequences + q, at, size, base + n_groups + group))
                    at += length
            columns = [np.array(c, np.int64) for c in zip(*rows)]
            arrays = [batch.column("doc_id").take(pa.array(columns[0])), *map(pa.array, columns[1:])]
            if tokens:
                arrays.append(pa.array([np.frombuffer(ids[d], "<u4")[s : s + n].astype(np.int32) for d, s, n in zip(*columns[:3])], pa.list_(pa.int32())))
            n_sequences, n_groups = n_sequences + len(sequences), n_groups + max(groups) + 1
            yield pa.RecordBatch.from_arrays(arrays, [*fields, "ids"] if tokens else fields)

    source = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), *(T.StructField(f, T.LongType()) for f in fields[1:])])
    if tokens:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return source.mapInArrow(run, schema)
