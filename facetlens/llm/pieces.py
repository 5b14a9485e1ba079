"""Operator 1: piece encoding and decoding with a SentencePiece model.

An Aho-Corasick automaton over the model's pieces reads a text once; at every
position its output links give the pieces that end there, longest first, and
each relaxes the best score of that position (Viterbi). Pieces hold the space
mark only at their start, so the best path of a text is the concatenation of
the best paths of its space-separated chunks; each distinct chunk is searched
once per Python worker.

A character that is no piece becomes its UTF-8 byte pieces at the cost of the
worst piece less ten. Ties go to the longer last piece. The model file's scores
are used as they are. Spaces are written as the space mark, with one in front.

Defined results: a null text has null ids; the empty text has no ids; a text
that holds the space mark itself decodes it as a space; a null ``doc_id`` is
kept; rows are coded one by one, so repeated rows and further columns change
nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready
from .tokens import ChunkIds, groups_by_size

PIECES = "piece_bpe_32k.model"
MARK = "▁"
_NEVER = float("-inf")


class PieceCoder(ChunkIds):
    """Encoder and decoder of one model; caches at most ``max_chunks`` chunks."""

    def __init__(self, path: str, max_chunks: int = 300_000):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        self.single: set[str] = set()
        worst, letters, whole_start, after_letter = 0.0, set(), True, set()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.automaton.add_word(piece, (i, len(piece), model.get_score(i)))
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                letters.update(piece)
                after_letter.update(b for a, b in zip(piece, piece[1:]) if a.isalpha())
                whole_start &= MARK not in piece.lstrip(MARK)
                worst = min(worst, model.get_score(i))
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown = worst - 10
        # a line break that no piece holds separates chunks as well
        cut = "" if "\n" in letters else r"\n"
        self.chunks = re.compile(f"{MARK}*[^{MARK}{cut}]+|{MARK}+" + (f"|{cut}" if cut else "")).findall
        if not whole_start:
            self.chunks = lambda text: [text] if text else []
        self.by_space = whole_start and bool(cut)
        # marks that follow a letter in no piece: the best path is cut between them
        self.closing = frozenset(c for c in ".,;:!?|" if c not in after_letter)
        super().__init__(max_chunks)

    def clear(self) -> None:
        super().clear()
        self.words: dict[str, tuple[list[int], float]] = {}

    def encode_chunk(self, chunk: str) -> tuple[list[int], float]:
        """``chunk``: a word after a space, a word after a line break, or, after NUL, a chunk as it is."""
        first = chunk[:1]
        chunk = chunk[1:] if first == "\0" else chunk if first == "\n" else MARK + chunk
        if len(chunk) > 2 and chunk[-1] in self.closing and chunk[-2].isalpha():
            (a, x), (b, y) = self._word(chunk[:-1]), self._word(chunk[-1])
            return a + b, x + y
        return self._word(chunk)

    def _word(self, chunk: str) -> tuple[list[int], float]:
        got = self.words.get(chunk)
        if got is None:
            got = self.words[chunk] = self.best_path(chunk)
        return got

    def best_path(self, chunk: str) -> tuple[list[int], float]:
        """Ids and score of the best segmentation."""
        if not self.single.issuperset(chunk):
            return self._best_path_with_bytes(chunk)
        best = [0.0] + [_NEVER] * len(chunk)
        back: list = [None] * len(best)
        # matches come end by end, at every end along the output links
        for end, (i, size, score) in self.automaton.iter(chunk):
            end += 1
            score += best[end - size]
            if score > best[end]:
                best[end] = score
                back[end] = (end - size, i)
        ids, e = [], len(chunk)
        while e:
            e, i = back[e]
            ids.append(i)
        ids.reverse()
        return ids, best[-1]

    def _best_path_with_bytes(self, chunk: str) -> tuple[list[int], float]:
        """The same where a character that is no piece may be crossed as bytes."""
        n = len(chunk)
        best = [0.0] + [_NEVER] * n
        back: list = [None] * (n + 1)
        matches: list = [[] for _ in range(n)]
        for end, found in self.automaton.iter(chunk):
            matches[end].append(found)
        for end in range(1, n + 1):
            if chunk[end - 1] not in self.single:
                best[end], back[end] = best[end - 1] + self.unknown, (end - 1, -1)
            for i, size, score in matches[end - 1]:
                got = best[end - size] + score
                if got > best[end]:
                    best[end], back[end] = got, (end - size, i)
        ids, e = [], n
        while e:
            s, i = back[e]
            if i < 0:
                ids.extend(self.byte_ids[b] for b in reversed(chunk[s:e].encode("utf-8", "replace")))
            else:
                ids.append(i)
            e = s
        return ids[::-1], best[n]

    def encode(self, texts: list[str | None]) -> list[tuple[bytes | None, float | None]]:
        """Ids (little-endian u16) and score of every text."""
        self.trim()
        look, codes, chunks = self.codes.__getitem__, [], []
        for text in texts:
            before = len(codes)
            if text and self.by_space and MARK not in text and "\0" not in text and "  " not in text and text[0] != " ":
                # a word that starts a line keeps the break in place of the space
                codes.extend(map(look, text.replace("\n", " \n").split(" ")))
            elif text:
                codes.extend([look("\0" + c) for c in self.chunks(MARK + text.replace(" ", MARK))])
            chunks.append(len(codes) - before)
        flat, per, score = self.gather(codes, chunks)
        raw, ends = flat.astype("<u2"), np.cumsum(per)
        return [(None, None) if t is None else (raw[e - n:e].tobytes(), float(s))
                for t, n, e, s in zip(texts, per.tolist(), ends.tolist(), score)]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u2").tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_CODERS: dict[str, PieceCoder] = {}


def coder(name: str = PIECES) -> PieceCoder:
    import public_tokenizers

    if name not in _CODERS:
        _CODERS[name] = PieceCoder(public_tokenizers.path(name))
    return _CODERS[name]


def encode_pieces(docs: DataFrame, model: str = PIECES) -> DataFrame:
    """doc_id, ids (binary, little-endian u16), n_pieces, score of every document."""
    python_ready(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        c = coder(model)
        for b in batches:
            for ids, texts in groups_by_size(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = c.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([g for g, _ in got], pa.binary()),
                     pa.array([None if g is None else len(g) // 2 for g, _ in got], pa.int64()),
                     pa.array([s for _, s in got], pa.float64())], names=["doc_id", "ids", "n_pieces", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, ids binary, n_pieces bigint, score double")


def decode_pieces(coded: DataFrame, model: str = PIECES) -> DataFrame:
    """doc_id, text of every row of (doc_id, ids)."""
    python_ready(coded.sparkSession)

    def run(batches):
        import pyarrow as pa

        c = coder(model)
        for b in batches:
            texts = [None if g is None else c.decode(g) for g in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def piece_round_trip(docs: DataFrame, model: str = PIECES) -> DataFrame:
    """doc_id, n_pieces, score, ids_crc32, round_trip: encodes, decodes and compares every text."""
    python_ready(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        c = coder(model)
        for b in batches:
            for ids, texts in groups_by_size(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = c.encode(texts)
                same = [None if t is None else c.decode(g) == t.replace(MARK, " ") for t, (g, _) in zip(texts, got)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([None if g is None else len(g) // 2 for g, _ in got], pa.int64()),
                     pa.array([s for _, s in got], pa.float64()),
                     pa.array([None if g is None else zlib.crc32(g) for g, _ in got], pa.int64()),
                     pa.array(same, pa.bool_())],
                    names=["doc_id", "n_pieces", "score", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, n_pieces bigint, score double, ids_crc32 bigint, round_trip boolean")
