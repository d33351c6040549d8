"""Byte-level BPE encoding and decoding of whole texts.

A text is split at the added tokens, then into pieces by the tokenizer's
pattern; each piece is merged by rank.  A short piece is a contiguous array
of part boundaries beside an array of the ranks of adjacent parts: the lowest
rank is searched for again and again, its right boundary is deleted, and the
two neighbouring ranks are looked up anew.  Long pieces keep the same pairs in
a heap, so that a text without a break costs n log n, not n squared.

Nulls: a null text counts as empty and has no ids.  A null doc_id is kept.
Repeated rows each give a row.  Other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json

import numpy as np
from pyspark.sql import DataFrame

from quarry.llm.common import map_texts

#: Pieces of more bytes than this are merged with a heap.
SHORT = 96
#: Pieces kept with their ids in a worker; beyond that, the store starts anew.
KEPT = 200_000
#: The split pattern of the byte-level tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.start = [vocab[c] for c in letters]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.bytes_of = {i: bytes(of_letter[c] for c in token) for token, i in vocab.items() if all(c in of_letter for c in token)}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: text.encode() for text, i in self.added.items()}
        self.split_added = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pieces = regex.compile(PATTERN).findall
        self.known: dict[str, bytes] = {}

    def merge_short(self, ids: list[int]) -> list[int]:
        """Merge by scanning the array of adjacent ranks for its minimum."""
        pairs, none = self.pairs, (NEVER, -1)
        at = [pairs.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while at:
            low = min(at)
            if low[0] == NEVER:
                break
            k = at.index(low)
            ids[k] = low[1]
            del ids[k + 1], at[k]
            if k:
                at[k - 1] = pairs.get((ids[k - 1], ids[k]), none)
            if k < len(at):
                at[k] = pairs.get((ids[k], ids[k + 1]), none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges with a heap over a linked list of parts."""
        pairs, n = self.pairs, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*found, k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if (found := pairs.get(p))]
        heap = [(rank, k, made, ids[k], ids[k + 1]) for rank, made, k in heap]
        heapq.heapify(heap)
        while heap:
            _, k, made, left, right = heapq.heappop(heap)
            j = after[k] if ids[k] == left else n
            if j >= n or ids[j] != right:
                continue
            ids[k], ids[j] = made, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if found := pairs.get((made, ids[after[k]])):
                    heapq.heappush(heap, (found[0], k, found[1], made, ids[after[k]]))
            if before[k] >= 0 and (found := pairs.get((ids[before[k]], made))):
                heapq.heappush(heap, (found[0], before[k], found[1], ids[before[k]], made))
        return [i for i in ids if i >= 0]

    def piece(self, piece: str) -> bytes:
        """The ids of one piece as little-endian unsigned 32-bit integers."""
        ids = [self.start[b] for b in piece.encode("utf-8", "surrogatepass")]
        return np.array(self.merge_short(ids) if len(ids) <= SHORT else self.merge_long(ids), dtype="<u4").tobytes()

    def plain(self, text: str) -> bytes:
        out, known = [], self.known
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.piece(piece)
                if len(piece) <= SHORT:
                    if len(known) >= KEPT:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        if self.split_added is None or not any(x in text for x in self.added):
            return self.plain(text)
        parts = self.split_added.split(text)
        return b"".join(np.array([self.added[x]], dtype="<u4").tobytes() if i % 2 else self.plain(x) for i, x in enumerate(parts))

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 bytes of the text; bytes that are no UTF-8 are replaced."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec for a worker process; its store of pieces serves all its tasks."""
    return Codec(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of each row."""

    def run(own: Codec, ids, texts):
        coded = [own.encode(t or "") for t in texts]
        return [ids, [np.frombuffer(x, dtype="<u4").astype("i4") for x in coded], [own.decode(x).decode() for x in coded]]

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_texts(docs.select(doc_id, text), run, f"doc_id {kind}, ids array<int>, decoded string", lambda: codec(path))


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what encode() gives, hashed where it is made."""

    def run(own: Codec, ids, texts):
        coded = [own.encode(t or "") for t in texts]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return [ids, [len(x) // 4 for x in coded], [sha(x) for x in coded], [sha(own.decode(x)) for x in coded]]

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_texts(docs.select(doc_id, text), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: codec(path))
