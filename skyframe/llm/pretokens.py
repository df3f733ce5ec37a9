"""Byte-level BPE ids of whole texts with the tokenizers library, one call per distinct piece.

Byte-level vocabularies split a text into pieces before merging, and merges never cross a piece. The split is computed
for a whole Arrow buffer with numpy; pieces are identified by 64-bit hashes; the library encodes each distinct piece
once and a bounded cache keeps its ids. Texts that hold a special token's string go to the library whole, unless special
strings are to count as plain text.

:class:`PrefixedEncoder` does the same for sentencepiece models whose pieces hold white space in front only.

Fixed values of the split, in order of preference:
    's  't  're  've  'm  'll  'd
    an optional space and letters; an optional space and numbers; an optional space and other characters
    spaces before a space or the end; spaces
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from skyframe.llm.bpe_tables import byte_letters
from skyframe.llm.textkernel import byte_range_hashes, chunks

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Characters of the class \s.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
MAX_CACHED = 700_000


UNKNOWN = 255
_CLASSES = np.full(0x110000, UNKNOWN, np.uint8)
_CLASSES[SPACES] = SPACE


def char_classes(chars: np.ndarray) -> np.ndarray:
    """Classes of code points; each is looked up in the Unicode tables once."""
    kind = _CLASSES[chars]
    if (kind == UNKNOWN).any():
        for c in np.unique(chars[kind == UNKNOWN]).tolist():
            _CLASSES[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
        kind = _CLASSES[chars]
    return kind


def piece_starts(chars: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where pieces start, as a mask over the code points of documents that begin at ``doc_starts``."""
    n = len(chars)
    kind = char_classes(chars)
    fresh = np.zeros(n + 1, bool)
    fresh[doc_starts] = True
    fresh[n] = True
    start = fresh[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    follows = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~fresh[1:n])
    start[follows] = True
    start[follows[chars[follows] == 32] + 1] = False
    quotes = np.flatnonzero((chars == 39) & start)
    quotes = quotes[quotes + 1 < n]
    if len(quotes):
        one = np.where(fresh[quotes + 1], 0, chars[quotes + 1])
        second = np.minimum(quotes + 2, n - 1)
        two = np.where(fresh[np.minimum(quotes + 2, n)] | fresh[quotes + 1], 0, chars[second])
        o, short = ord, np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == o("r")) & (two == o("e"))) | ((one == o("v")) & (two == o("e"))) | ((one == o("l")) & (two == o("l")))
        for which, size in ((quotes[short], 2), (quotes[long], 3)):
            start[which + 1] = False
            end = which + size
            start[end[end < n]] = True
    return start


class PieceEncoder:
    """Encodes Arrow string arrays; keep one per Python worker."""

    def __init__(self, vocabulary: str, plain_special: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(vocabulary)
        self.tok.no_truncation()
        self.tok.no_padding()
        # Pieces go to the merge model itself, which the library offers as tokenizer.model: same ids, no split to redo.
        self.model, self.letters = self.tok.model, dict(byte_letters())
        self.special = [] if plain_special else [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.clear()

    def starts(self, chars: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
        """Where pieces start, as a mask over code points."""
        return piece_starts(chars, doc_starts)

    def tokens(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces by the library."""
        tokenize, letters = self.model.tokenize, self.letters
        return [[t.id for t in tokenize(p.decode("latin-1").translate(letters))] for p in pieces]

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.used = np.empty(1 << 20, np.int32), 0
        self.offs, self.lens, self.n = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int32), 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.int32)

    def _learn(self, hashes: list[int], pieces: list[bytes]) -> list[int]:
        """Remember the ids of new pieces; returns the pieces' places in the cache."""
        found = self.tokens(pieces)
        lens = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int32, int(lens.sum()))
        if self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(flat)))
        if self.n + len(lens) > len(self.offs):
            self.offs, self.lens = np.resize(self.offs, 2 * (self.n + len(lens))), np.resize(self.lens, 2 * (self.n + len(lens)))
        new = slice(self.n, self.n + len(lens))
        self.flat[self.used : self.used + len(flat)] = flat
        self.offs[new], self.lens[new] = self.used + np.cumsum(lens) - lens, lens
        places = list(range(self.n, self.n + len(lens)))
        self.known.update(zip(hashes, places, strict=True))
        self.used, self.n = self.used + len(flat), self.n + len(lens)
        return places

    def encode(self, column: pa.Array):
        """Yields (first row, ids of these rows one after another, offsets)."""
        for first, _, data, offsets in chunks(column):
            yield first, *self._chunk(data, offsets)

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            docs = [self._whole(raw[a:b].decode()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.concatenate(docs) if docs else np.empty(0, np.int32), np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        char_at = np.flatnonzero((data & 0xC0) != 0x80)
        chars = data if len(char_at) == len(data) else np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        begins = np.searchsorted(char_at, offsets[:-1])
        starts = char_at[self.starts(chars, begins[begins < len(chars)])]
        ends = np.append(starts[1:], len(data))
        hashes, at, inverse = np.unique(byte_range_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if self.n + len(hashes) > MAX_CACHED:
            self.clear()
        keys, get = hashes.tolist(), self.known.get
        places = [get(k, -1) for k in keys]
        new = [i for i, p in enumerate(places) if p < 0]
        if new:
            spans = at[new]
            pieces = [raw[a:b] for a, b in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True)]
            for i, p in zip(new, self._learn([keys[i] for i in new], pieces), strict=True):
                places[i] = p
        place = np.array(places, np.int64)[inverse]
        lens = self.lens[place].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(lens)])
        ids = self.flat[np.repeat(self.offs[place] - total[:-1], lens) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]


class PrefixedEncoder(PieceEncoder):
    """Ids of texts that begin with the space which a sentencepiece model puts in front of its input.

    Such a model writes a space as U+2581. Where no piece of it has that mark behind another character, no merge crosses
    from a character to the space after it, so what lies between two such places is encoded on its own. A single space
    at the end stays with the word before it: by itself it would be the space in front of nothing. U+2581 in a text
    counts as a space, and stays with the spaces after it.
    """

    def __init__(self, model: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        self.names = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.separable = not any("\u2581" in name.lstrip("\u2581") for name in self.names)
        self.special = []
        self.clear()

    def starts(self, chars: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
        start = np.zeros(len(chars), bool)
        if self.separable:
            space = chars == 32
            start[1:] = space[1:] & ~(space | (chars == 0x2581))[:-1]
            last = np.append(doc_starts[1:], len(chars)) - 1
            start[last[space[last]]] = False
        start[doc_starts] = True
        return start

    def tokens(self, pieces: list[bytes]) -> list[list[int]]:
        return self.processor.encode([p[1:].decode() for p in pieces], num_threads=1)


@lru_cache(maxsize=1)
def worker_encoder(vocabulary: str) -> PieceEncoder:
    """The encoder of this Python worker."""
    return PieceEncoder(vocabulary)
