"""Operator 6: cost-balanced packing of documents into training sequences.

Every document is tokenised; whole sequences are cut from long documents, and
the rests are packed window by window inside each partition: pieces go in
descending order to the sequence with the lowest estimated attention cost
``linear * n + quadratic * n^2`` that still has room, and are cut where no
sequence has room for the whole piece. What a window leaves over moves to the
next; the last rest of a partition fills sequences of power-of-two lengths,
which need no padding. Nothing is shuffled.

Defined results: null and empty texts are the end id alone; a null ``doc_id``
stays null; repeated rows are packed once per row; further columns of the
input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import python_ready
from .tokens import crc32_of, encoder, groups_by_size

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


def assign(lengths, room, linear: float, quadratic: float):
    """Descending pieces to the cheapest sequence with room; cut where none has enough.

    ``room``: free tokens per sequence (changed in place). Returns placements
    (piece, start, length, sequence) and the tokens of each piece left over.
    """
    cost = np.zeros(len(room))
    placed, left = [], np.array(lengths, np.int64)
    for i in np.argsort(-left, kind="stable"):
        at = 0
        while left[i]:
            fits = room >= left[i]
            if not fits.any():
                fits = room > 0
                if not fits.any():
                    break
            s = int(np.argmin(np.where(fits, cost, np.inf)))
            n = int(min(left[i], room[s]))
            placed.append((int(i), at, n, s))
            cost[s] += linear * n + quadratic * n * n
            room[s] -= n
            left[i] -= n
            at += n
    return placed, left


def power_sizes(total: int, cap: int) -> np.ndarray:
    """Sequence lengths for exactly ``total`` tokens: whole ones, then falling powers of two."""
    sizes = [cap] * (total // cap)
    rest = total % cap
    sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return np.array(sizes, np.int64)


class _Packer:
    def __init__(self, cap, window, linear, quadratic, first_id):
        self.cap, self.window, self.linear, self.quadratic = cap, window, linear, quadratic
        self.next_id, self.rows, self.open, self.held = first_id, [], [], 0

    def _row(self, piece, at, n, seq, offset):
        doc, start, ids, total = piece
        self.rows.append((doc, start + at, n, crc32_of(ids[at:at + n]), total, seq, offset))

    def add(self, doc, ids):
        total, whole = len(ids), len(ids) // self.cap * self.cap
        for at in range(0, whole, self.cap):
            self._row((doc, 0, ids, total), at, self.cap, self.next_id, 0)
            self.next_id += 1
        if whole < total:
            self.open.append((doc, whole, ids[whole:].copy(), total))
            self.held += total - whole
        if self.held >= self.window:
            self.close(np.full(self.held // self.cap, self.cap, np.int64))

    def close(self, sizes):
        room = sizes.copy()
        placed, left = assign([len(p[2]) for p in self.open], room, self.linear, self.quadratic)
        filled = np.zeros(len(sizes), np.int64)
        for i, at, n, s in placed:
            self._row(self.open[i], at, n, self.next_id + s, int(filled[s]))
            filled[s] += n
        self.next_id += len(sizes)
        rest = [(d, s + len(ids) - n, ids[len(ids) - n:], t) for (d, s, ids, t), n in zip(self.open, left) if n]
        self.open, self.held = rest, int(left.sum())

    def take(self):
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, cap: int = 4096, tokenizer: str = "word_bpe_49k.json", window: int = 1 << 20,
         linear: float = 1.0, quadratic: float = 1.0 / 4096, max_words: int = 700_000, chars: int = 4_000_000) -> DataFrame:
    """Pack ``docs`` (doc_id, text); one row per piece (see ``SCHEMA``).

    ``window``: tokens of rests that are balanced against each other at once.
    ``max_words``: chunks whose ids a worker holds; ``chars``: text that is encoded at once.
    """
    python_ready(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        enc = encoder(tokenizer, max_words)
        p = _Packer(cap, window, linear, quadratic, TaskContext.get().partitionId() << 33)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = pa.schema([(n, pa.int64()) for n in names])

        def out():
            rows = p.take()
            cols = list(zip(*rows)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=kinds)

        for b in batches:
            for ids, texts in groups_by_size(b.column(0).to_pylist(), b.column(1).to_pylist(), chars):
                flat, per = enc.encode(texts)
                ends = np.cumsum(per)
                for doc, a, e in zip(ids, ends - per, ends):
                    p.add(doc, flat[a:e])
                yield out()
        p.close(power_sizes(p.held, cap))
        yield out()

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, SCHEMA)
