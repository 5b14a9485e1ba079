"""Operator 3: token ids in compressed binary frames (static interleaved rANS).

Documents are range-partitioned and sorted by ``doc_id``, tokenised, and
written as frames of whole documents. A frame holds one frequency table that
all its blocks share; each block is an independent range-ANS stream of
interleaved lanes, with the lane states saved at checkpoints so that decoding
can start in the middle of a block. Frames carry a crc32 and are rows of a
Parquet table (columns part, frame_no, n_tokens, n_docs, frame), so Spark reads
and writes them on any store and decodes them in parallel.

Frame layout (little endian): magic ``FLRA``, u32 crc32 of the rest, u32
header length, zlib-compressed header (counts, document ids and lengths,
frequency table, block directory with checkpoints), u32 words of all blocks.

Defined results: null text equals the empty text (the end id alone); rows of
equal ``doc_id`` follow each other in the order of a text hash; null ids come
first; further columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import python_ready
from .tokens import crc32_of, encoder, groups_by_size

MAGIC = b"FLRA"
BITS = 18            # frequencies sum to 2**BITS
LANES = 128
BLOCK = 1 << 16      # tokens of a block
EVERY = 256          # steps between checkpoints (LANES tokens a step)
LOW = np.uint64(1 << 31)
STORE = "part int, frame_no int, n_tokens bigint, n_docs bigint, frame binary"


def scaled_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur and their frequencies, at least 1 each, summing to 2**BITS."""
    symbols, counts = np.unique(ids, return_counts=True)
    freq = np.maximum(1, np.floor(counts * ((1 << BITS) / max(1, counts.sum())))).astype(np.int64)
    over = int(freq.sum()) - (1 << BITS)
    order = np.argsort(-freq, kind="stable")
    if over < 0:
        freq[order[0]] -= over
    while over > 0:
        cut = np.minimum(np.maximum(freq[order] // 2, 0), np.maximum(freq[order] - 1, 0))
        take = np.minimum(cut, np.maximum(0, over - (np.cumsum(cut) - cut)))
        freq[order] -= take
        over -= int(take.sum())
    return symbols.astype(np.uint32), freq


def encode_blocks(ids: np.ndarray, symbols: np.ndarray, freq: np.ndarray):
    """Words per block and, per checkpoint, the word position and lane states of each block.

    Token ``i`` of a block belongs to step ``i // LANES``, lane ``i % LANES``;
    short blocks are padded with the table's first symbol.
    """
    n_blocks = max(1, -(-len(ids) // BLOCK))
    steps = BLOCK // LANES if n_blocks > 1 else max(1, -(-len(ids) // LANES))
    index = np.searchsorted(symbols, ids)
    grid = np.zeros(n_blocks * steps * LANES, np.int64)
    grid[:len(ids)] = index
    grid = grid.reshape(n_blocks, steps, LANES)
    base = np.cumsum(freq) - freq
    freq64, base64 = freq.astype(np.uint64), base.astype(np.uint64)
    limit = freq64 << np.uint64(63 - BITS)
    x = np.full((n_blocks, LANES), LOW, np.uint64)
    words = np.empty((n_blocks, steps * LANES), np.uint32)
    pos = np.full(n_blocks, steps * LANES, np.int64)
    rows = np.repeat(np.arange(n_blocks), LANES).reshape(n_blocks, LANES)
    saved = []
    for t in range(steps - 1, -1, -1):
        s = grid[:, t, :]
        spill = x >= limit[s]
        n = spill.sum(axis=1)
        at = (pos - n)[:, None] + np.cumsum(spill, axis=1) - 1
        words[rows[spill], at[spill]] = (x[spill] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        x[spill] >>= np.uint64(32)
        pos -= n
        f = freq64[s]
        q = x // f
        x = (q << np.uint64(BITS)) + (x - q * f) + base64[s]
        if t % EVERY == 0:
            saved.append((t, pos.copy(), x.copy()))
    first = pos
    out = [words[b, first[b]:] for b in range(n_blocks)]
    marks = [(t, p - first, state) for t, p, state in reversed(saved)]
    return steps, out, marks


def decode_blocks(words: list[np.ndarray], steps: int, mark, until: int, symbols, freq) -> np.ndarray:
    """Symbols (blocks, steps, lanes) from a checkpoint ``mark`` up to step ``until``."""
    t0, pos, x = mark
    n_blocks = len(words)
    # a step reads at most LANES words; the tail lets masked lanes index safely
    flat = np.concatenate([*words, np.zeros(LANES + 1, np.uint32)])
    start = np.cumsum([0] + [len(w) for w in words[:-1]])
    at, x = start + pos, x.copy()
    slot = np.repeat(np.arange(len(freq)), freq).astype(np.uint16 if len(freq) <= 1 << 16 else np.int64)
    freq64 = freq.astype(np.uint64)
    base64 = (np.cumsum(freq) - freq).astype(np.uint64)
    out = np.empty((n_blocks, until - t0, LANES), symbols.dtype)
    mask = np.uint64((1 << BITS) - 1)
    for t in range(until - t0):
        low = x & mask
        s = slot[low]
        out[:, t, :] = symbols[s]
        x = freq64[s] * (x >> np.uint64(BITS)) + low - base64[s]
        need = x < LOW
        where = at[:, None] + np.cumsum(need, axis=1) - 1
        x[need] = (x[need] << np.uint64(32)) | flat[where[need]]
        at += need.sum(axis=1)
    return out


def _put(buf: io.BytesIO, a: np.ndarray, kind: str) -> None:
    raw = a.astype(kind).tobytes()
    buf.write(struct.pack("<Q", len(raw)))
    buf.write(raw)


def _get(buf: io.BytesIO, kind: str) -> np.ndarray:
    (n,) = struct.unpack("<Q", buf.read(8))
    return np.frombuffer(buf.read(n), kind)


def write_frame(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    symbols, freq = scaled_table(ids)
    steps, words, marks = encode_blocks(ids, symbols, freq)
    head = io.BytesIO()
    head.write(struct.pack("<QQQQ", len(ids), len(words), steps, len(marks)))
    _put(head, np.array([d is None for d in doc_ids]), "u1")
    _put(head, np.array([d or 0 for d in doc_ids], np.int64), "<i8")
    _put(head, lengths, "<i8")
    _put(head, np.diff(symbols.astype(np.int64), prepend=0), "<u4")
    _put(head, freq, "<u4")
    _put(head, np.array([len(w) for w in words]), "<i8")
    for t, pos, state in marks:
        head.write(struct.pack("<Q", t))
        _put(head, pos, "<i8")
        _put(head, state, "<u8")
    header = zlib.compress(head.getvalue(), 1)
    body = struct.pack("<I", len(header)) + header + b"".join(w.tobytes() for w in words)
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


class Frame:
    """A parsed frame; ``ids()`` decodes all of it, ``block(b, t)`` from a checkpoint on."""

    def __init__(self, raw: bytes):
        crc, size = struct.unpack("<II", raw[4:12])
        if raw[:4] != MAGIC or zlib.crc32(raw[8:]) != crc:
            raise ValueError("damaged frame")
        head = io.BytesIO(zlib.decompress(raw[12:12 + size]))
        self.n, n_blocks, self.steps, n_marks = struct.unpack("<QQQQ", head.read(32))
        none = _get(head, "u1")
        self.doc_ids = [None if z else int(d) for z, d in zip(none, _get(head, "<i8"))]
        self.lengths = _get(head, "<i8")
        self.symbols = np.cumsum(_get(head, "<u4").astype(np.int64)).astype(np.uint32)
        self.freq = _get(head, "<u4").astype(np.int64)
        sizes = _get(head, "<i8")
        self.marks = []
        for _ in range(n_marks):
            (t,) = struct.unpack("<Q", head.read(8))
            self.marks.append((t, _get(head, "<i8"), _get(head, "<u8").reshape(n_blocks, LANES)))
        words = np.frombuffer(raw, "<u4", offset=12 + size) if (12 + size) % 4 == 0 else np.frombuffer(
            raw[12 + size:], "<u4")
        cuts = np.cumsum(sizes)[:-1]
        self.words = np.split(words, cuts)

    def ids(self) -> np.ndarray:
        grid = decode_blocks(self.words, self.steps, self.marks[0], self.steps, self.symbols, self.freq)
        return grid.reshape(-1)[:self.n]

    def block(self, b: int, mark: int) -> np.ndarray:
        """Ids of block ``b`` from checkpoint ``mark`` to the next one (or the block's end)."""
        t, pos, state = self.marks[mark]
        until = self.marks[mark + 1][0] if mark + 1 < len(self.marks) else self.steps
        got = decode_blocks(self.words[b:b + 1], self.steps, (t, pos[b:b + 1], state[b:b + 1]), until,
                            self.symbols, self.freq).reshape(-1)
        first = b * self.steps * LANES + t * LANES
        return got[:max(0, self.n - first)]


def write_store(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json",
                frame_tokens: int = 1 << 22) -> None:
    """Tokenise ``docs`` (doc_id, text) and write frames in ascending doc_id order to ``path``."""
    python_ready(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        enc, part, frame_no = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held, ids_held, n = [], [], 0

        def out():
            ids = np.concatenate(held)
            names = [d for d, _ in ids_held]
            lengths = np.array([k for _, k in ids_held], np.int64)
            frame = write_frame(names, lengths, ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([frame_no], pa.int32()), pa.array([len(ids)], pa.int64()),
                 pa.array([len(names)], pa.int64()), pa.array([frame], pa.binary())],
                names=["part", "frame_no", "n_tokens", "n_docs", "frame"])

        for b in batches:
            for doc_ids, texts in groups_by_size(b.column(0).to_pylist(), b.column(1).to_pylist()):
                flat, per = enc.encode(texts)
                held.append(flat)
                ids_held += zip(doc_ids, per.tolist())
                n += len(flat)
                if n >= frame_tokens:
                    yield out()
                    held, ids_held, n, frame_no = [], [], 0, frame_no + 1
        if ids_held:
            yield out()

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = keyed.withColumn("h", F.xxhash64("text"))
    (keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
     .select("doc_id", "text").mapInArrow(run, STORE).write.mode("overwrite").parquet(path))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Decode a store: doc_id, start, n_tokens, ids_crc32 of every document."""
    python_ready(spark)
    frames = spark.read.schema(STORE).parquet(path)
    # tokens before each frame; one row per frame, four numbers each
    parts = frames.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before_part = parts.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("base"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for raw, part, no in zip(b.column("frame"), b.column("part").to_pylist(), b.column("frame_no").to_pylist()):
                f = Frame(raw.as_py())
                ids, ends = f.ids(), np.cumsum(f.lengths)
                starts = ends - f.lengths
                crc = [crc32_of(ids[a:e]) for a, e in zip(starts, ends)]
                k = len(f.doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * k, pa.int32()), pa.array([no] * k, pa.int32()),
                     pa.array(f.doc_ids, pa.int64()), pa.array(starts), pa.array(f.lengths),
                     pa.array(crc, pa.int64())],
                    names=["part", "frame_no", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = frames.select("part", "frame_no", "frame").mapInArrow(
        run, "part int, frame_no int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    in_part = Window.partitionBy("part").orderBy("frame_no")
    before = (frames.select("part", "frame_no", (F.sum("n_tokens").over(in_part) - F.col("n_tokens")).alias("in_part"))
              .join(before_part, "part").select("part", "frame_no", (F.col("base") + F.col("in_part")).alias("base")))
    return (docs.join(before, ["part", "frame_no"])
            .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))
