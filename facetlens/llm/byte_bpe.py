"""Operator 12: byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts are read as arrays of code-point classes. Where a pre-token may begin is
decided by a small automaton over those classes (is a letter run open, does an
apostrophe begin a contraction, ...). Every class is a function from state to
state; composition of such functions is associative, and only a few dozen
different ones arise, so they are numbered with a composition table and the
automaton runs as a prefix scan over whole batches: columns of many chunks at
once, then the chunks among each other, then the states inside each chunk. No
regular expression is used. The slices between the boundaries are looked up in
a cache of merged pieces; the new ones of a batch are merged together, row by
row the pair of lowest rank first.

The end of every token in the UTF-8 text is kept beside the ids, so any token
range is decoded, or traced to its text, without the tokens before it.

Defined results: null and empty texts have no tokens; special-token strings are
ordinary text; bytes that are not UTF-8 are read as U+FFFD; a null ``doc_id`` is
kept; every row is encoded for itself, so ties, repeated rows and further
columns change nothing. Long texts are cut where a pre-token must end, in front
of white space; a single run without white space is scanned whole.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready, small_batches
from .tokens import ChunkIds

RANKS = "byte_bpe_50k.tiktoken"
SEGMENT = 1_000_000     # characters of a long text that are scanned at once
LONG = 64               # bytes; longer pieces are merged one by one with a queue
MERGED_ROWS = 16_384    # pieces merged at once

# classes of code points, and the start of a text
START, SPACE, BLANK, LETTER, NUMBER, OTHER, QUOTE, ONE, L, V, R, E = range(12)
# states after a character: text start, space, other white space, letter run, number run, run of other
# characters, apostrophe that begins a match, it and l / v / r, end of a contraction
BEGIN, SPC, WSP, LET, NUM, OTH, QST, QL, QV, QR, END = range(11)
#: White space, and the letters that close a contraction after an apostrophe.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
SINGLE = "sdmt"


def class_table() -> np.ndarray:
    """Class of every code point."""
    by_category = {"L": LETTER, "N": NUMBER}
    table = np.array([by_category.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    for chars, code in ((WHITE, BLANK), (" ", SPACE), ("'", QUOTE), (SINGLE, ONE), ("l", L), ("v", V), ("r", R), ("e", E)):
        table[[ord(c) for c in chars]] = code
    return table


def step(state: int, code: int) -> int:
    if code in (START, SPACE, BLANK, NUMBER, OTHER):
        return {START: BEGIN, SPACE: SPC, BLANK: WSP, NUMBER: NUM, OTHER: OTH}[code]
    if code == QUOTE:
        return OTH if state in (OTH, QST, SPC) else QST
    if state == QST:
        return {ONE: END, L: QL, V: QV, R: QR}.get(code, LET)
    return END if (state, code) in ((QL, L), (QV, E), (QR, E)) else LET


class Scanner:
    """The classes' transition functions, closed under composition; element k < 12 is class k."""

    def __init__(self):
        self.table = class_table()
        functions = [tuple(step(s, c) for s in range(11)) for c in range(12)]
        number = {}
        for f in functions:     # classes that act alike share their first number in compositions
            number.setdefault(f, len(number))
        known, first = list(dict.fromkeys(functions)), [number[f] for f in functions]
        rows = []
        for f in known:         # grows while new compositions turn up
            row = []
            for g in functions:
                both = tuple(g[s] for s in f)
                if both not in number:
                    number[both] = len(known)
                    known.append(both)
                row.append(number[both])
            rows.append(row)
        self.first = np.array(first, np.int32)
        self.apply = np.array(known, np.uint8)                    # element x state
        self.then = np.array(rows, np.int32).reshape(-1)          # element x class -> element
        self.compose = np.array([[number[tuple(g[s] for s in f)] for g in known] for f in known], np.int32)
        self.step = np.array(functions, np.uint8).reshape(-1)     # class x state
        # does a pre-token begin at this character: state before x state after, for characters that are not white space
        begins = np.ones((11, 11), bool)
        begins[SPC] = begins[LET, LET] = begins[NUM, NUM] = False
        begins[[OTH, QST], OTH] = begins[QST, END] = False
        begins[[QL, QV, QR]] &= ~np.isin(np.arange(11), (LET, END))
        self.begins = begins.reshape(-1)

    def states(self, codes: np.ndarray, width: int = 256) -> np.ndarray:
        """State after every character; ``codes`` begins with START."""
        n, rows = len(codes), -(-len(codes) // width)
        padded = np.full(rows * width, START, np.uint8)
        padded[:n] = codes
        columns = np.ascontiguousarray(padded.reshape(rows, width).T)
        whole = self.first[columns[0]]
        for c in columns[1:]:
            whole = self.then[whole * 12 + c]
        shift = 1
        while shift < rows:     # prefix scan of the chunks' functions
            whole[shift:] = self.compose[whole[:-shift], whole[shift:]]
            shift *= 2
        state = np.concatenate([[BEGIN], self.apply[whole[:-1], BEGIN]]).astype(np.int32)
        out = np.empty((width, rows), np.uint8)
        for j, c in enumerate(columns):
            state = self.step[c * np.int32(11) + state]
            out[j] = state
        return out.T.reshape(-1)[:n]

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin, and the STARTs, in ascending order."""
        after = self.states(codes)
        white = (after == SPC) | (after == WSP)
        begins = np.ones(len(codes), bool)
        begins[1:] = self.begins[after[:-1].astype(np.int16) * 11 + after[1:]]
        # l, v or r after an apostrophe belongs to it only if the contraction is completed
        half = np.flatnonzero((after >= QL) & (after <= QR))
        begins[half] = after[np.minimum(half + 1, len(codes) - 1)] != END
        # white space: a run begins a pre-token, and so does its last character before other text
        at = np.flatnonzero(white)
        follows = np.append(codes, START)[at + 1]
        begins[at] = ~white[at - 1] | ((follows != SPACE) & (follows != BLANK) & (follows != START))
        begins |= codes == START
        begins[1:] |= codes[:-1] == START
        return np.flatnonzero(begins)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairMerger:
    """Merges the bytes of many pre-tokens at once: one row each, one merge a row and step.

    In every row the adjacent pair of lowest rank is merged, the left one of
    equals; a row without a pair that forms a token is done and leaves the matrix.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        joins = {a << 16 | b: whole for token, whole in ranks.items() for i in range(1, len(token))
                 if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None}
        self.pairs = np.array(sorted(joins), np.uint32)       # left id << 16 | right id
        self.forms = np.array([joins[k] for k in self.pairs.tolist()], np.int32)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def form(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id (which is the rank) of the token that each pair forms, or NONE; -1 stands behind a row's end."""
        key = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32) & np.uint32(0xFFFF)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (right >= 0) & (left >= 0), self.forms[at], self.NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, none empty, and ids per piece; rows are as wide as the longest piece."""
        sizes = np.array([len(p) for p in pieces])
        width = int(sizes.max()) + 1                          # a column behind every row's end
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.form(ids[:, :-1], ids[:, 1:])
        row, out, columns = np.arange(len(pieces)), np.full_like(ids, -1), np.arange(width)
        while len(row):
            at = rank.argmin(1)
            least = rank[np.arange(len(row)), at]
            open_ = least != self.NONE
            if not open_.all():
                out[row[~open_]] = ids[~open_]
                row, ids, rank, at, least = row[open_], ids[open_], rank[open_], at[open_], least[open_]
                if not len(row):
                    break
            here = np.arange(len(row))
            ids[:, :-1] = np.where(columns[:-1] > at[:, None], ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[here, at] = least
            rank[:, :-1] = np.where(columns[:-2] >= at[:, None], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = self.NONE
            rank[here, at] = self.form(least, ids[here, at + 1])
            inner = np.flatnonzero(at)
            rank[inner, at[inner] - 1] = self.form(ids[inner, at[inner] - 1], least[inner])
        return out[out >= 0], (out >= 0).sum(1)


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a queue of pairs over linked parts, for pieces of any length."""
    n = len(piece)
    end, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))   # of the part that begins at i
    queue = []

    def offer(i):
        j = end[i]
        if j < n:
            rank = ranks.get(piece[i:end[j]])
            if rank is not None:
                heapq.heappush(queue, (rank, i, end[j]))

    for i in range(n):
        offer(i)
    gone = bytearray(n)
    while queue:
        _, i, upto = heapq.heappop(queue)
        if gone[i] or end[i] >= n or end[end[i]] != upto or end[i] == upto:
            continue
        gone[end[i]] = 1
        end[i] = upto
        if upto < n:
            before[upto] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class ByteDecoder:
    """Bytes of token ids."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, k in ranks.items():
            self.tokens[k] = t

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class ByteEncoder(ChunkIds):
    """Encodes lists of texts; caches ids of at most ``max_pieces`` pre-tokens."""

    def __init__(self, path: str, max_pieces: int = 250_000):
        self.ranks = read_ranks(path)
        if max(self.ranks.values()) >= 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.merger = PairMerger(self.ranks)
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.sizes[list(self.ranks.values())] = [len(t) for t in self.ranks]
        self.scanner = Scanner()
        super().__init__(max_pieces)

    def encode_chunk(self, chunk: str) -> tuple[list[int], float]:
        """A single piece of any length."""
        piece = chunk.encode("utf-8", "replace")
        whole = self.ranks.get(piece)
        return ([whole] if whole is not None else _merged_long(piece, self.ranks)), 0.0

    def learn(self, chunks: list[str]) -> None:
        """Add new pieces to the cache, those of similar lengths merged together."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        known: list[tuple[str, int]] = []
        for chunk in chunks:
            piece = chunk.encode("utf-8", "replace")
            whole = self.ranks.get(piece)
            if whole is not None:
                known.append((chunk, whole))
            elif len(piece) <= LONG:
                by_width.setdefault(-(-len(piece) // 4), []).append((chunk, piece))
            else:
                self.codes[chunk]
        self.put([c for c, _ in known], np.array([i for _, i in known]), np.ones(len(known), np.int64))
        for pairs in by_width.values():
            for at in range(0, len(pairs), MERGED_ROWS):
                part = pairs[at:at + MERGED_ROWS]
                self.put([c for c, _ in part], *self.merger.merge([p for _, p in part]))

    def put(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Cache the ids of chunks, ``sizes`` of them each."""
        first = len(self.start)
        self.start.frombytes((len(self.flat) + np.cumsum(sizes) - sizes).astype(np.int64).tobytes())
        self.length.frombytes(sizes.astype(np.int64).tobytes())
        self.score.frombytes(bytes(8 * len(chunks)))
        self.flat.frombytes(ids.astype(np.uint16).tobytes())
        self.codes.update(zip(chunks, range(first, first + len(chunks))))
        self.chars += sum(map(len, chunks))

    def trim(self) -> None:
        # long pieces, too, count against the room of the cache
        if len(self.codes) > self.most or len(self.flat) > 8 * self.most:
            self.clear()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint16), and ids per text."""
        parts, per = [], []
        for group in self._segments(texts):
            flat, n = self._encode([t for _, t in group])
            parts.append(flat)
            per += zip((i for i, _ in group), n.tolist())
        sizes = np.zeros(len(texts), np.int64)
        for i, n in per:
            sizes[i] += n
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint16)), sizes

    @staticmethod
    def _segments(texts: list[str]):
        """Runs of (number of the text, text or a part of a long one), about SEGMENT characters each."""
        group, size = [], 0
        for i, text in enumerate(texts):
            at = 0
            while at < len(text) or not at:
                to = len(text)
                if to - at > SEGMENT:
                    to = at + SEGMENT     # on to the next space behind text: a pre-token ends there
                    while 0 < (to := text.find(" ", to)) and text[to - 1] in WHITE:
                        to += 1
                    to = to if to > 0 else len(text)
                group.append((i, text[at:to]))
                size += to - at
                at = max(to, 1)
                if size >= SEGMENT:
                    yield group
                    group, size = [], 0
        if group:
            yield group

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.trim()
        joined = "\0" + "\0".join(texts)      # one character before each text, its place is known
        codes = self.scanner.table[np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")]
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        codes[starts] = START
        cuts = self.scanner.cuts(codes)
        ends = np.append(cuts[1:], len(codes))
        mine = codes[cuts] != START
        per_text = np.diff(np.searchsorted(cuts[mine], np.append(starts, len(codes))))
        pieces = [joined[a:b] for a, b in zip(cuts[mine].tolist(), ends[mine].tolist())]
        self.learn([p for p in set(pieces) if p not in self.codes])
        found = list(map(self.codes.__getitem__, pieces))
        flat, per, _ = self.gather(found, per_text.tolist())
        return flat, per

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Where each token ends in the text's UTF-8 bytes."""
        return np.cumsum(self.sizes[ids])


_KEPT: dict[tuple[str, type], ByteEncoder | ByteDecoder] = {}


def _kept(name: str, kind: type):
    """The worker's encoder or decoder for a public ranks file (kept between tasks)."""
    import public_tokenizers

    if (name, kind) not in _KEPT:
        _KEPT[name, kind] = kind(public_tokenizers.path(name))
    return _KEPT[name, kind]


def encoder(name: str = RANKS) -> ByteEncoder:
    return _kept(name, ByteEncoder)


def decoder(name: str = RANKS) -> ByteDecoder:
    return _kept(name, ByteDecoder)


def slices(batch, column: int, size: int = 4_000_000):
    """Parts of an Arrow batch with about ``size`` bytes in a binary column each, at least one row."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    for upto in [*(np.flatnonzero(np.diff(np.cumsum(lengths) // size)) + 1).tolist(), len(lengths)]:
        if upto > at:
            yield batch.slice(at, upto - at)
            at = upto


def encode_texts(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit), ends (byte offset behind each token, 64-bit)."""
    python_ready(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        enc = encoder(ranks)
        for b in batches:
            for part in slices(b, 1):
                texts = [(t or b"").decode("utf-8", "replace") for t in part.column(1).to_pylist()]
                flat, per = enc.encode(texts)
                ids = np.split(flat, np.cumsum(per)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(per, pa.int64()),
                     pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                     pa.array([enc.ends(x).astype("<i8").tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "n_tokens", "ids", "ends"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")
                       ).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, ends binary")


def decode_ids(encoded: DataFrame, ranks: str = RANKS, first: int = 0, upto: int | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of tokens ``first`` to ``upto`` of every row, and their ``offset`` in the text."""
    python_ready(encoded.sparkSession)
    small_batches(encoded.sparkSession)

    def run(batches):
        import pyarrow as pa

        dec = decoder(ranks)
        for b in (part for whole in batches for part in slices(whole, whole.schema.get_field_index("ends"))):
            texts, offsets = [], []
            for ids, ends in zip(b.column("ids"), b.column("ends")):
                texts.append(dec.decode(np.frombuffer(ids.as_buffer(), "<u4")[first:upto]))
                ends = np.frombuffer(ends.as_buffer(), "<i8")
                offsets.append(int(ends[min(first, len(ends)) - 1]) if first and len(ends) else 0)
            yield b.append_column("decoded", pa.array(texts, pa.binary())).append_column("offset", pa.array(offsets, pa.int64()))

    return encoded.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in encoded.dtypes) + ", decoded binary, offset bigint")
