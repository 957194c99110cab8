"""Token ids of whole texts with public tokenizer files, for use inside Arrow map tasks."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Chunks that a worker remembers; then those not met again until as many others were leave. Bounds a worker's memory.
CACHE_CHUNKS = 450_000
#: Bytes of text that are looked up together, so that new chunks are learnt many per call.
LOOKUP_BYTES = 1 << 20
#: Lower-case Latin letters, then ASCII punctuation without apostrophe: the two pieces that every letter-run
#: pre-tokenizer makes of such a chunk, unchanged by NFC and lower-casing.
SIMPLE = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Kinds of bytes: 1 punctuation as above, 2 white space, 0 all others.
KIND = np.zeros(256, np.uint8)
KIND[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = 1
KIND[[9, 10, 11, 12, 13, 32]] = 2


def part_endings(texts: list[bytes], free: np.ndarray) -> list[bytes]:
    """``texts`` with a blank between a lower-case Latin letter and ASCII punctuation that ends a chunk, where ``free``.

    Such punctuation is a piece of its own, so the ids stay the same, and a word is looked up as one chunk whatever
    follows it."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    kind = KIND[raw]
    edge = np.diff((kind == 1).view(np.int8), prepend=np.int8(0))
    first, behind = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # a line feed ends every text
    last = raw[first - 1]
    letter = ((last >= 97) & (last <= 122)) | ((last >= 0x9F) & (last <= 0xBF) & (last != 0xB7) & (raw[first - 2] == 0xC3))
    at = first[letter & (first > 0) & (kind[behind] == 2)]
    text = np.searchsorted(ends, at, "right")
    at, text = at[free[text]], text[free[text]]
    wide = np.insert(raw, at, 32).tobytes()
    ends = ends + np.cumsum(np.bincount(text, minlength=len(texts)))
    return [wide[a:b - 1] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as it is, the others from
    U+0100 on in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizers file. ``by_chunk``: its pre-tokenizer drops white space, so the ids of a text are those of its
    white-space separated chunks one after the other and each distinct chunk is encoded once per worker."""

    path: str
    by_chunk: bool = False


def word_vocabulary() -> Vocabulary:
    import public_tokenizers
    return Vocabulary(public_tokenizers.path("word_bpe_49k.json"), by_chunk=True)


class Encoder:
    """Encodes texts to little-endian id arrays of the smallest width that holds the vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary.path)
        self.by_chunk = vocabulary.by_chunk
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):  # chunks are kept here, the model need not keep them again
            self.model._resize_cache(0)
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _pack(self, ids: Sequence[int]) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        found = self.cache.get(raw)
        if found is None:
            shown = raw.decode("latin-1").translate(self.letters)
            self.cache[raw] = found = array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()
        return found

    def _learn(self, chunks: Iterable[bytes]) -> None:
        """Ids of new chunks: plain words piece by piece from the model, all others through the whole tokenizer."""
        rest = []
        for chunk in chunks:
            known = self.older.get(chunk)
            if known is not None:
                self.cache[chunk] = known
                continue
            m = SIMPLE.fullmatch(chunk.decode())
            if m is None:
                rest.append(chunk)
            elif m[2]:
                self.cache[chunk] = self._piece(m[1]) + self._piece(m[2])
            else:
                self._piece(m[1])
        texts = [c.decode() for c in rest]
        for c, e in zip(rest, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            self.cache[c] = self._pack(e.ids)

    def _encode_chunks(self, texts: list[bytes]) -> Iterable[np.ndarray]:
        if len(self.cache) > CACHE_CHUNKS:
            self.cache, self.older = {}, self.cache
        get = self.cache.get
        found = [(chunks, list(map(get, chunks))) for chunks in map(bytes.split, texts)]
        gaps = [[i for i, x in enumerate(ids) if x is None] if None in ids else [] for _, ids in found]
        self._learn({chunks[i] for (chunks, _), gap in zip(found, gaps) for i in gap})
        for (chunks, ids), gap in zip(found, gaps):
            for i in gap:
                ids[i] = get(chunks[i])
            yield np.frombuffer(b"".join(ids), dtype=self.dtype)

    def encode(self, texts: Iterable[str | None]) -> Iterable[np.ndarray]:
        """Ids per text, in order; None counts as the empty text."""
        held: list[bytes] = []
        free: list[bool] = []
        size = 0
        for text in texts:
            raw = (text or "").encode()
            # folding ASCII first is safe unless a combining mark may follow or a special token is spelt out
            free.append(b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw)
            held.append(raw.lower() if self.by_chunk and free[-1] else raw)
            size += len(raw)
            if size > LOOKUP_BYTES:
                yield from self._encode_held(held, free)
                held, free, size = [], [], 0
        if held:
            yield from self._encode_held(held, free)

    def _encode_held(self, held: list[bytes], free: list[bool]) -> Iterable[np.ndarray]:
        if self.by_chunk:
            return self._encode_chunks(part_endings(held, np.asarray(free)))
        found = self.tokenizer.encode_batch_fast([b.decode() for b in held], add_special_tokens=False)
        return (np.asarray(e.ids, dtype=self.dtype) for e in found)


@lru_cache(maxsize=2)
def encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder per worker process, shared by its tasks."""
    return Encoder(vocabulary)


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
