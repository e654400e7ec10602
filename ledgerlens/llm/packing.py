"""Cost-balanced packing of documents into token sequences.

A task tokenises its rows as they come and packs one window of them at a time: documents go, longest first, to the
sequence of the lowest estimated cost that still has room; what fits nowhere whole is cut to fill the rest. Every
sequence of a window is filled exactly, and what is left over begins the next window, so only the end of a task's input
is not full. That end is cut at powers of two, which need no padding. No row is shuffled and no text is kept beyond
its window, whatever the size or skew of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import rows

WINDOW_TOKENS = 1 << 19  # tokens that a task packs at once
REMEMBERED = 300_000  # words (with what touches them) whose ids a task remembers; forgetting costs time only
#: Fixed value: how the byte-level vocabulary cuts a text before it merges bytes.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Uneven(Exception):
    """A text whose spaces do not stand singly between words."""


class Chunks(dict):
    """Text between two spaces to the ids, as bytes, of that text after one space; remembered up to a number."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise Uneven
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[chunk] = np.array(self.encode(" " + chunk), "<u4").tobytes()
        return value


class Encoder:
    """Token ids of texts by the vocabulary of a byte-level ``tokenizers`` file, the special strings in it included.

    Where one space stands between two other characters, the vocabulary's pattern cuts before the space, and merges
    never cross a cut; so ids are remembered for what stands between spaces. Other texts are encoded whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Bytes stand in the file as printable characters; a merge's rank is its id.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.encode = tiktoken.Encoding("own", pat_str=WORD, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.chunks = Chunks(self.encode)

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        first, *chunks = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise Uneven
            head = np.array(self.encode(first), "<u4").tobytes()
            return np.frombuffer(head + b"".join(map(self.chunks.__getitem__, chunks)), "<u4")
        except Uneven:
            return np.array(self.encode(text), np.uint32)


def cost(tokens: int, linear: float, quadratic: float) -> float:
    """Estimated cost of a piece: linear work, and attention within the piece."""
    return linear * tokens + quadratic * tokens * tokens


def pack(lengths: list[int], size: int, linear: float = 1.0, quadratic: float = 1.0 / 512) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full sequences and the rest; each a list of pieces (document, start in it, length), in order.

    ``sum(lengths) // size`` sequences are filled exactly. Longest first (ties: earlier first), a document goes to the
    sequence of the lowest cost with room for all of it (ties: lower number). Documents longer than a sequence first
    give off full ones. A document that fits nowhere is cut to fill what room is left, cheapest sequence first.
    """
    total = sum(lengths) // size
    full: list[list[tuple[int, int, int]]] = []
    parts = []
    for d, n in enumerate(lengths):
        whole = n // size
        full += [[(d, size * k, size)] for k in range(whole)]
        if n % size:
            parts.append((d, size * whole, n % size))
    bins = total - len(full)
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(bins)]
    spent, room, rest = np.zeros(bins), np.full(bins, size), []

    def cheapest(least_room: int) -> int:
        """The sequence of the lowest cost with so much room, or -1."""
        fits = np.where(room >= least_room, spent, np.inf)
        k = int(fits.argmin()) if bins else -1
        return k if bins and fits[k] < np.inf else -1

    def put(k: int, d: int, start: int, n: int) -> None:
        held[k].append((d, start, n))
        room[k] -= n
        spent[k] += cost(n, linear, quadratic)

    over = []
    for d, start, n in sorted(parts, key=lambda p: (-p[2], p[0])):
        k = cheapest(n)
        if k < 0:
            over.append((d, start, n))
        else:
            put(k, d, start, n)
    for d, start, n in over:
        while n and (k := cheapest(1)) >= 0:
            take = min(n, int(room[k]))
            put(k, d, start, take)
            start, n = start + take, n - take
        if n:
            rest.append((d, start, n))
    return full + held, sorted(rest)


def tail(rest: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The rest as sequences whose lengths are powers of two, longest first."""
    left, out = sum(p[2] for p in rest), []
    queue = list(rest)[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        now = []
        while room:
            d, start, n = queue.pop()
            take = min(n, room)
            now.append((d, start, take))
            room -= take
            if take < n:
                queue.append((d, start + take, n - take))
        out.append(now)
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1.0 / 512, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Every row of ``docs`` is packed, also repeated ones and ones without doc_id; a null or empty text is just the end
    id. A piece's ids lie at ``offset`` of the sequence without gaps. Sequences hold ``size`` tokens, except that the
    last ones of a task hold a power of two. An empty table gives no pieces. Other columns are ignored. ``tokenizer``
    is the path of a byte-level ``tokenizers`` file, present on every machine. Sequence numbers depend on how the
    input is split into tasks; they are unique, and a task that is run again gives the same ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # (doc_id, first token's place in the document, tokens of the document, ids)

        def out(sequences: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
            nonlocal sequence
            cols: list[list] = [[] for _ in range(7 + with_ids)]
            for pieces in sequences:
                offset = 0
                for d, start, n in pieces:
                    doc_id, first, tokens, ids = held[d]
                    own = ids[start : start + n]
                    row = [doc_id, first + start, n, zlib.crc32(own.astype("<u4").tobytes()), tokens, sequence, offset]
                    for c, v in zip(cols, row + [own.astype(np.int64).tolist()] * with_ids):
                        c.append(v)
                    offset += n
                sequence += 1
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in schema.split(", ")])

        waiting = 0
        for ids, texts in rows(batches):
            for doc_id, text in zip(ids, texts):
                tokens = np.append(encoder.ids(text or ""), np.uint32(end_id))
                held.append((doc_id, 0, len(tokens), tokens))
                waiting += len(tokens)
                if waiting >= WINDOW_TOKENS:
                    sequences, rest = pack([len(h[3]) for h in held], size, linear, quadratic)
                    yield out(sequences)
                    held = [(held[d][0], held[d][1] + start, held[d][2], held[d][3][start : start + n].copy()) for d, start, n in rest]
                    waiting = sum(len(h[3]) for h in held)
        sequences, rest = pack([len(h[3]) for h in held], size, linear, quadratic)
        yield out(sequences + tail(rest))

    schema = SCHEMA + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
