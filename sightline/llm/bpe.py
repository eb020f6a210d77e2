"""Byte-level BPE encoding and decoding with the tokenizers library.

The rank file gives bytes and ranks; the library wants texts and merges. Each
byte stands as one printable character (the usual byte-to-character table), and
every way to halve a token into two others is a merge, ordered by the token's
rank. Pieces come from the pattern; distinct pieces of an Arrow batch are encoded
once and kept in a bounded cache.

Decoding takes the whole sequence of ids: their tokens' characters in a row go back
through the table, a byte each, so characters split over tokens come back whole.
Offsets follow from the tokens' lengths and the bytes that begin a character.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import os

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from .frames import arrow_map

#: Pieces that a worker's cache keeps between batches (about 100 MB).
CACHE_PIECES = 400_000
#: Tokens decoded at once.
CHUNK = 1 << 16


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable in
    Latin-1, else the next free one from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count[i]`` numbers from ``first[i]`` on, one run after another."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def decimal(ids: np.ndarray) -> bytes:
    """The ids as decimal numbers with commas between."""
    if not len(ids):
        return b""
    width = len(str(int(ids.max())))
    shown = np.empty((len(ids), width + 1), np.uint8)
    shown[:, width] = 44
    keep = np.ones(shown.shape, bool)
    rest = ids
    for k in range(width - 1, -1, -1):
        keep[:, k] = (rest > 0) | (k == width - 1)
        rest, shown[:, k] = rest // 10, rest % 10 + 48
    return shown[keep].tobytes()[:-1]


class _Numbers(dict):
    """A number for each piece, given at its first look-up; ``new`` has those pieces."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = n = len(self)
        return n


class ByteBPE:
    """Encoder and decoder over a rank file; a worker builds it once."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        table = byte_characters()
        self.byte_of = np.zeros(max(map(ord, table)) + 1, np.uint8)
        self.byte_of[list(map(ord, table))] = np.arange(256)
        shown = {token: "".join(table[b] for b in token) for token in self.ranks}
        # The tokens' characters in a row, and where each begins and how long it is;
        # an id that the file lacks has length 0.
        size = max(self.ranks.values()) + 1
        self.sizes, self.starts = np.zeros(size, np.int64), np.zeros(size, np.int64)
        ordered = sorted(self.ranks, key=self.ranks.__getitem__)
        at = [self.ranks[t] for t in ordered]
        self.sizes[at] = [len(t) for t in ordered]
        self.starts[at] = np.cumsum([0, *self.sizes[at][:-1]])
        self.characters = np.frombuffer("".join(shown[t] for t in ordered).encode("utf-16-le"), np.uint16)
        halves = sorted((rank, self.ranks[token[:i]], shown[token[:i]], shown[token[i:]]) for token, rank in self.ranks.items() for i in range(1, len(token)) if token[:i] in self.ranks and token[i:] in self.ranks)
        self.tokenizer = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in self.ranks.items()}, merges=[(a, b) for _, _, a, b in halves], ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        # Pieces by number; of each, where its ids begin in the pool and how many.
        self.numbers = _Numbers()
        self.pool, self.first, self.count = (np.zeros(0, np.int32), *np.zeros((2, 0), np.int64))

    def pieces(self, text: str) -> list[str]:
        return self.split.findall(text)

    def encoded(self, pieces: list[list[str]]) -> list[np.ndarray]:
        """The ids of texts, each as its pieces. Pieces that the cache lacks are encoded
        together; a full cache starts anew."""
        if len(self.numbers) > CACHE_PIECES:
            self._forget()
        n = sum(map(len, pieces))
        at = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(pieces)), np.int64, n)
        if new := self.numbers.new:
            got = [x.ids for x in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            count = np.fromiter(map(len, got), np.int64, len(got))
            self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.pool = np.concatenate([self.pool, np.fromiter(itertools.chain.from_iterable(got), np.int32, count.sum())])
            new.clear()
        out, low = [], 0
        for some in pieces:
            own = at[low : low + len(some)]
            out.append(self.pool[_runs(self.first[own], self.count[own])])
            low += len(some)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encoded([self.pieces(text)])[0].tolist()

    def decode(self, ids) -> bytes:
        """Tokens to characters to bytes; an unknown id raises KeyError."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and not (0 <= ids.min() <= ids.max() < len(self.sizes) and self.sizes[ids].all()):
            raise KeyError("an id that the rank file lacks")
        parts = (ids[low : low + CHUNK] for low in range(0, len(ids), CHUNK))
        return b"".join(self.byte_of[self.characters[_runs(self.starts[x], self.sizes[x])]].tobytes() for x in parts)

    def spans(self, ids, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and end in characters of each id of the text ``raw``; a token that
        holds part of a character spans the whole of it, so neighbours may overlap
        there."""
        sizes = self.sizes[np.asarray(ids, np.int64)]
        ends = np.cumsum(sizes)
        at = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, dtype=np.int32)
        return at[ends - sizes] - 1, at[ends - 1]

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Character span of each token."""
        starts, ends = self.spans(self.encode(text), text.encode())
        return list(zip(starts.tolist(), ends.tolist(), strict=True))


@functools.lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBPE:
    # A task has one core; the library's threads would take others' cores.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ByteBPE(path, pattern)


def _texts(column) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _digests(path: str, pattern: str):
    def make():
        bpe = coder(path, pattern)

        def step(batch):
            counts, ids_sha, out_sha, spans_sha = [], [], [], []
            for ids in bpe.encoded([bpe.pieces(t) for t in _texts(batch.column(1))]):
                raw = bpe.decode(ids)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(decimal(ids)).hexdigest())
                out_sha.append(hashlib.sha256(raw).hexdigest())
                spans_sha.append(hashlib.sha256(np.stack(bpe.spans(ids, raw), axis=1).astype("<i4").tobytes()).hexdigest())
            return batch.column(0), counts, ids_sha, out_sha, spans_sha

        return step

    return make


def _tokens(path: str, pattern: str):
    def make():
        bpe = coder(path, pattern)

        def step(batch):
            ids = bpe.encoded([bpe.pieces(t) for t in _texts(batch.column(1))])
            return batch.column(0), ids, [len(x) for x in ids]

        return step

    return make


def _decoded(path: str, pattern: str):
    def make():
        bpe = coder(path, pattern)

        def step(batch):
            return batch.column(0), [bpe.decode(x or ()) for x in batch.column(1).to_pylist()]

        return step

    return make


def _spans(path: str, pattern: str):
    def make():
        bpe = coder(path, pattern)

        def step(batch):
            spans = [bpe.spans(bpe.encode(t), t.encode()) for t in _texts(batch.column(1))]
            return batch.column(0), [a for a, _ in spans], [b for _, b in spans]

        return step

    return make


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>, n_tokens)``, a row for each row; null text: no ids."""
    return arrow_map(docs, {"doc_id": F.col(doc_id).cast("long"), "text": F.col(text)}, _tokens(path, pattern), "doc_id long, ids array<int>, n_tokens long")


def offsets(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, starts, ends)``: the character span of each token."""
    return arrow_map(docs, {"doc_id": F.col(doc_id).cast("long"), "text": F.col(text)}, _spans(path, pattern), "doc_id long, starts array<int>, ends array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(doc_id, decoded binary)``; null ids: no bytes; an unknown id raises."""
    return arrow_map(tokens, {"doc_id": F.col(doc_id).cast("long"), "ids": F.col(ids)}, _decoded(path, pattern), "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of the ids, of the bytes decoded from them and of each token's span
    (start and end in characters, 32-bit little-endian), a row for each row of
    ``docs``; null and empty texts have no tokens; repeated rows each return; an
    empty table gives no rows."""
    return arrow_map(docs, {"doc_id": F.col(doc_id).cast("long"), "text": F.col(text)}, _digests(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string", batch_rows=500)
