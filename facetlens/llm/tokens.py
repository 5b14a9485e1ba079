"""Token ids of whole texts by a public word-level BPE, with a word cache.

The tokenizer drops white space and never merges across it, so a text's ids
are the concatenated ids of its white-space separated chunks. Chunks repeat
heavily, so each is encoded once per Python worker and looked up afterwards.
Chunks outside plain Latin letters, special-token strings and the separators
that only Python treats as white space go through the library unchanged.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array

import numpy as np

WORD_BPE = "word_bpe_49k.json"
END_ID = 2
_PYTHON_ONLY_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f")


def _byte_letters() -> dict[int, str]:
    """Latin-1 code point -> printable stand-in, as byte-level BPE spells bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkIds:
    """Ids of distinct chunks, appended to one array; ``codes`` maps a chunk to its number.

    A missing chunk is encoded by ``encode_chunk`` on first use. ``trim`` starts
    over once more than ``most`` chunks, or chunks of 32 characters each on
    average, are held: long chunks count for their length.
    """

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        store = self

        class Codes(dict):
            def __missing__(self, chunk):
                code = self[chunk] = store.add(*store.encode_chunk(chunk))
                store.chars += len(chunk)
                return code

        self.codes, self.chars = Codes(), 0
        self.flat, self.start, self.length, self.score = array("H"), array("q"), array("q"), array("d")

    def encode_chunk(self, chunk: str) -> tuple[list[int], float]:
        raise NotImplementedError

    def trim(self) -> None:
        if len(self.codes) > self.most or self.chars > 32 * self.most:
            self.clear()

    def add(self, ids: list[int], score: float = 0.0) -> int:
        self.start.append(len(self.flat))
        self.length.append(len(ids))
        self.score.append(score)
        self.flat.extend(ids)
        return len(self.start) - 1

    def gather(self, codes: list[int], chunks: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all codes in a row; ids and score of each text (``chunks``: codes per text)."""
        code = np.array(codes, np.int64)
        length = np.frombuffer(self.length, np.int64)[code] if codes else np.zeros(0, np.int64)
        start = np.frombuffer(self.start, np.int64)[code] if codes else length
        score = np.frombuffer(self.score, np.float64)[code] if codes else np.zeros(0)
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(start - (ends - length), length)
        at += np.arange(total)
        flat = np.frombuffer(self.flat, np.uint16)[at] if total else np.zeros(0, np.uint16)
        cuts = np.concatenate([[0], np.cumsum(np.array(chunks, np.int64))]).astype(np.int64)
        before = np.concatenate([[0], ends])
        scores = np.concatenate([[0.0], np.cumsum(score)])
        return flat, np.diff(before[cuts]), np.diff(scores[cuts])


class WordEncoder(ChunkIds):
    """Encodes lists of texts; caches at most ``max_words`` chunks."""

    def __init__(self, path: str, max_words: int = 700_000):
        import os

        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the tokenizer's own splitting pattern (fixed value)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.spell = _byte_letters()
        super().__init__(max_words)

    def clear(self) -> None:
        super().clear()
        self.pieces: dict[str, bytes] = {}   # ids as 16-bit values: a seventh of the room of lists
        self.end = self.add([END_ID])

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode_chunk(self, word: str) -> tuple[array | list[int], float]:
        if word.isascii():
            if "<|" in word:
                return self._library(word), 0.0
            low = word if word.islower() else word.lower()
        elif max(word) < "ɐ":
            low = unicodedata.normalize("NFC", word).lower()
        else:
            return self._library(word), 0.0
        ids = array("H")
        if low.isascii():   # a word, perhaps with one closing mark, needs no pattern
            pieces = ([low] if low.isalpha() else [low[:-1], low[-1]] if low[-1] in ".,;:!?" and low[:-1].isalpha()
                      else self.split(low))
        else:
            pieces = self.split(low)
        for piece in pieces:
            got = self.pieces.get(piece)
            if got is None:
                spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.spell)
                got = self.pieces[piece] = array("H", [t.id for t in self.model.tokenize(spelt)]).tobytes()
            ids.frombytes(got)
        return ids, 0.0

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint16, each document closed by the end id) and ids per document."""
        self.trim()
        look, codes, chunks = self.codes.__getitem__, [], []
        for text in texts:
            text = text or ""
            before = len(codes)
            if any(c in text for c in _PYTHON_ONLY_SPACES):
                codes.append(self.add(self._library(text)))
                self.chars += len(text)
            else:
                codes.extend(map(look, text.split()))
            codes.append(self.end)
            chunks.append(len(codes) - before)
        flat, per, _ = self.gather(codes, chunks)
        return flat, per


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(name: str = WORD_BPE, max_words: int = 700_000) -> WordEncoder:
    """The worker's encoder for a public tokenizer file (kept between tasks)."""
    import public_tokenizers

    key = (name, max_words)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(public_tokenizers.path(name), max_words)
    return _ENCODERS[key]


def groups_by_size(doc_ids: list, texts: list, chars: int = 4_000_000):
    """Cut a batch into runs of about ``chars`` characters, at least one text each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= chars or i + 1 == len(texts):
            yield doc_ids[start:i + 1], texts[start:i + 1]
            start, size = i + 1, 0


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids written as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
