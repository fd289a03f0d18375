"""SentencePiece encoding and decoding by suffix-array matching.

Text is cut where a blank begins (no piece goes on after one), and the distinct cuts of a batch are
joined and indexed by a suffix array. Every piece of the vocabulary is found in it by binary search;
its occurrences are edges of a lattice over the text, sorted by where they end, and relaxed from left
to right: a prefix ends in the one piece that the merge rules leave standing beside the piece before
it. Characters outside the vocabulary become bytes. Results equal those of merging pair by pair.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixloom.llm.frame import append_columns
from pixloom.llm.registry import query, table
from pixloom.llm.text import BYTE_VALUES, Stretch, U, chunks, joined, ragged

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
MOST_KNOWN = 400_000  # cuts whose pieces a worker remembers, and pairs of pieces
BLOCK = 1 << 18  # characters indexed at once
TEXT_CHUNK = 1 << 20


class Pieces:
    """A vocabulary: pieces in order of their ids with scores, and what is needed to apply it."""

    def __init__(self, pieces: list[str], scores: list[float], first_byte: int, n_special: int):
        self.pieces, self.first_byte = pieces, first_byte
        normal = range(max(first_byte + 256, n_special), len(pieces))
        self.ids = {pieces[i]: i for i in normal}
        self.scores = {pieces[i]: scores[i] for i in normal}
        chars = sorted({c for p in self.ids for c in p})
        self.symbols = np.zeros(0x110000, np.uint16)  # of code points; 0: in no piece
        self.symbols[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.lengths = np.array([len(p) for p in pieces] + [0, 1], np.int64)  # then the start, an unknown character
        self.start, self.unknown = len(pieces), len(pieces) + 1
        sought = [i for p, i in self.ids.items() if BLANK not in p[1:]]
        self.sought = np.array(sought, np.int64)
        grid = np.zeros((len(sought), 16), np.uint64)
        for row, i in enumerate(sought):
            grid[row, : len(pieces[i])] = self.symbols[[ord(c) for c in pieces[i]]]
        least = self.packed(grid)
        grid[np.arange(16) >= self.lengths[self.sought][:, None]] = 0xFFFF
        self.low, self.high = least, self.packed(grid)
        raw = [p.replace(BLANK, " ").encode() for p in pieces]
        for b in range(256):
            raw[first_byte + b] = bytes([b])
        for i in range(first_byte):
            raw[i] = b""
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_lengths = np.array([len(r) for r in raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_lengths) - self.raw_lengths
        self.beside: dict[int, bool] = {}
        self.forget()

    @staticmethod
    def packed(grid: np.ndarray) -> list[np.ndarray]:
        return [
            grid[:, k] << U(48) | grid[:, k + 1] << U(32) | grid[:, k + 2] << U(16) | grid[:, k + 3] for k in (0, 4, 8, 12)
        ]

    def forget(self) -> None:
        self.known = np.zeros(0, U)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def merged(self, text: str) -> list[int]:
        """Pieces of a short text by merging: the best pair first, of equals the leftmost. Unknown: -1 - code point."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (both := parts[i] + parts[j]) in self.scores:
                heapq.heappush(heap, (-self.scores[both], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [self.ids.get(p, -1 - ord(p[0])) for p in parts if p is not None]

    def stands(self, pair: int) -> bool:
        """Whether two pieces stand side by side, neither merged across nor cut otherwise."""
        left, right = divmod(pair, self.unknown + 1)
        if right == self.unknown:
            return True
        if left >= self.start:
            return self.merged(self.pieces[right]) == [right]
        return self.merged(self.pieces[left] + self.pieces[right]) == [left, right]

    def edges(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and id of every occurrence of a piece: binary search in the suffix array."""
        n = len(symbols)
        s = np.concatenate([symbols.astype(U), np.zeros(16, U)])
        key = s[: n + 12] << U(48) | s[1 : n + 13] << U(32) | s[2 : n + 14] << U(16) | s[3 : n + 15]
        keys = [key[k : k + n] for k in (0, 4, 8, 12)]
        order = np.lexsort(keys[::-1])

        def bound(sought: list[np.ndarray], beyond: bool) -> np.ndarray:
            low, high = np.zeros(len(sought[0]), np.int64), np.full(len(sought[0]), n)
            while (live := low < high).any():
                middle = (low + high) // 2
                at = order[np.minimum(middle, n - 1)]
                less, same = np.zeros(len(low), bool), np.ones(len(low), bool)
                for mine, theirs in zip(keys, sought, strict=True):
                    value = mine[at]
                    less |= same & (value < theirs)
                    same &= value == theirs
                go = live & (less | (same & beyond))
                low = np.where(go, middle + 1, low)
                high = np.where(live & ~go, middle, high)
            return low

        first, last = bound(self.low, False), bound(self.high, True)
        count = last - first
        return order[ragged(first, count)], np.repeat(self.sought, count)

    def relax(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of cuts (code points with one stop after each), flat, and how many each has."""
        symbols = self.symbols[points].astype(np.int64)
        symbols[end] = 0
        inside = np.ones(len(points), bool)
        inside[end] = False
        start, piece = self.edges(symbols)
        lost = np.flatnonzero((symbols == 0) & inside)
        start, piece = np.concatenate([start, lost]), np.concatenate([piece, np.full(len(lost), self.unknown)])
        stop = start + self.lengths[piece]
        cut = np.searchsorted(begin, start, "right") - 1
        offset = stop - begin[cut]
        order = np.argsort(offset, kind="stable")
        start, piece, stop = start[order], piece[order], stop[order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(offset))]) if len(offset) else np.zeros(1, np.int64)
        last = np.full(len(points) + 1, -1, np.int64)  # piece that ends before each position
        last[begin] = self.start
        base = self.unknown + 1
        for a, b in zip(bounds[1:-1], bounds[2:], strict=True):
            left = last[start[a:b]]
            some = np.flatnonzero(left >= 0) + a
            pair, of = np.unique(last[start[some]] * base + piece[some], return_inverse=True)
            good = np.fromiter((self.stands_known(p) for p in pair.tolist()), bool, len(pair))[of]
            last[stop[some[good]]] = piece[some[good]]
        # read back from the ends
        where, out_cut, out_piece, out_at = end.copy(), [], [], []
        live = np.flatnonzero(where > begin)
        while len(live):
            token = last[where[live]]
            if (token < 0).any():
                raise ValueError("a text has no path")
            where[live] -= self.lengths[token]
            out_cut.append(live)
            out_piece.append(token)
            out_at.append(where[live])
            live = live[where[live] > begin[live]]
        cuts, tokens, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_cut, out_piece, out_at))
        order = np.lexsort((at, cuts))
        cuts, tokens, at = cuts[order], tokens[order], at[order]
        # an unknown character becomes the bytes of its UTF-8
        code = points[at].astype(np.int64)
        size = np.where(tokens == self.unknown, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
        row = np.repeat(np.arange(len(tokens)), size)
        nth = ragged(np.zeros(len(size), np.int64), size)
        n, c = size[row], code[row]
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
        byte = np.where(nth == 0, lead[n] | c >> 6 * (n - 1), 0x80 | (c >> 6 * np.maximum(0, n - 1 - nth) & 0x3F))
        flat = np.where(tokens[row] == self.unknown, self.first_byte + byte, tokens[row])
        return flat.astype(np.int32), np.bincount(cuts[row], minlength=len(begin))

    def stands_known(self, pair: int) -> bool:
        known = self.beside.get(pair)
        if known is None:
            known = self.beside[pair] = self.stands(pair)
        return known

    def learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        """Encode new cuts and remember their pieces."""
        if len(self.known) + len(hashes) > MOST_KNOWN:
            self.forget()
        if len(self.beside) > MOST_KNOWN:
            self.beside.clear()
        sizes = end - start
        several = sizes > 1
        several[several] = (data[start[several]] == 32) & (data[start[several] + 1] == 32)
        flats, counts, order = [self.flat], [], []
        for i in np.flatnonzero(several).tolist():  # more than one blank: merged one by one
            ids = []
            for x in self.merged(data[start[i] : end[i]].tobytes().decode().replace(" ", BLANK)):
                ids += [x] if x >= 0 else [self.first_byte + b for b in chr(-1 - x).encode()]
            flats.append(np.array(ids, np.int32))
            counts.append([len(ids)])
            order.append([i])
        rest = np.flatnonzero(~several)
        total = np.cumsum(sizes[rest])
        for part in np.split(rest, np.searchsorted(total, np.arange(BLOCK, total[-1], BLOCK))) if len(rest) else []:
            if not len(part):
                continue
            raw = np.full(int((sizes[part] + 1).sum()), 10, np.uint8)  # a stop after each
            stop = np.cumsum(sizes[part] + 1) - 1
            raw[np.delete(np.arange(len(raw)), stop)] = data[ragged(start[part], sizes[part])]
            first = (raw & 0xC0) != 0x80
            points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
            stop = np.cumsum(first)[stop] - 1
            begin = np.concatenate([[0], stop[:-1] + 1])
            points[points == 32] = ord(BLANK)
            flat, count = self.relax(points, begin, stop)
            flats.append(flat)
            counts.append(count)
            order.append(part)
        count, order = np.concatenate(counts).astype(np.int64), np.concatenate(order)
        at = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate(flats)
        known = np.concatenate([self.known, hashes[order]])
        by = np.argsort(known, kind="stable")
        self.known, self.at, self.size = known[by], np.concatenate([self.at, at])[by], np.concatenate([self.size, count])[by]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts, flat, and how many each has."""
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        if not len(full):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        begin = offsets[:-1][full]
        data = np.insert(data, begin, 32)  # each text begins with a blank
        begin = begin + np.arange(len(full))
        blank = data == 32
        edge = blank.copy()
        edge[1:] &= ~blank[:-1]
        edge[begin] = True
        start = np.flatnonzero(edge)
        end = np.append(start[1:], len(data))
        hashes = Stretch(BYTE_VALUES[data]).of(start, end)
        distinct, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self.known, assume_unique=True)
        if new.any():
            if len(self.known) + new.sum() > MOST_KNOWN:
                self.forget()
                new[:] = True
            self.learn(data, start[first[new]], end[first[new]], distinct[new])
        at = np.searchsorted(self.known, distinct)
        size = self.size[at][of]
        flat = self.flat[ragged(self.at[at][of], size)]
        counts = np.zeros(len(offsets) - 1, np.int64)
        which = np.searchsorted(begin, start, "right") - 1
        np.add.at(counts, full[which], size)
        return flat, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of consecutive lists of ids, and the offsets of each; a leading blank goes."""
        size = self.raw_lengths[ids]
        out = self.raw[ragged(self.raw_starts[ids], size)]
        offsets = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        full = offsets[1:] > offsets[:-1]
        first = offsets[:-1][full]
        gone = first[out[first] == 32]
        keep = np.ones(len(out), bool)
        keep[gone] = False
        left = np.concatenate([[0], np.cumsum(keep)])
        return out[keep], left[offsets]


_loaded: dict[int, Pieces] = {}


class Model:
    """What the tasks get: the vocabulary of a model file, read by the driver."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        self.scores = [m.get_score(i) for i in range(n)]
        self.first_byte = next(i for i in range(n) if m.is_byte(i))
        self.n_special = sum(m.is_control(i) or m.is_unknown(i) for i in range(n))
        self.key = hash((path, n, tuple(self.pieces[-50:])))

    def ready(self) -> Pieces:
        if self.key not in _loaded:
            _loaded[self.key] = Pieces(self.pieces, self.scores, self.first_byte, self.n_special)
        return _loaded[self.key]


def ids_of(column: pa.Array, vocabulary: Pieces) -> pa.Array:
    """Ids of each text of a column."""
    data, offsets = joined(column)
    if BLANK.encode() in data.tobytes():
        data, offsets = joined(pa.array([x and x.replace(BLANK, " ") for x in column.to_pylist()], pa.string()))
    flats, counts = [], []
    for a, b in chunks(offsets, TEXT_CHUNK):
        flat, count = vocabulary.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        flats.append(flat)
        counts.append(count)
    where = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    values = pa.array(np.concatenate(flats), pa.int32())
    missing = np.append(np.asarray(column.is_null()), False)
    return pa.ListArray.from_arrays(pa.array(where, pa.int32(), mask=missing), values)


def texts_of(column: pa.Array, vocabulary: Pieces) -> pa.Array:
    """Text of each list of ids of a column."""
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    data, offsets = vocabulary.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data))]
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), buffers)
    try:
        out = raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        out = pa.array([x.as_py().decode(errors="replace") for x in raw], pa.string())
    return pa.compute.if_else(column.is_null(), pa.scalar(None, pa.string()), out) if column.null_count else out


def encode(df: DataFrame, model: Model, *, text: str = "text", ids: str = "ids", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the ids of each text's pieces; those of a null text are null, of an empty one none.

    The character of the vocabulary that stands for a blank is one. Repeated rows get equal ids; a
    column of the result's name is replaced.
    """

    field = T.StructField(ids, T.ArrayType(T.IntegerType()))
    return append_columns(df, [field], lambda batch: [ids_of(batch.column(text), model.ready())], drop)


def decode(df: DataFrame, model: Model, *, ids: str = "ids", decoded: str = "decoded", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the text of each list of ids; null for null. Bytes that are not UTF-8 become U+FFFD."""

    field = T.StructField(decoded, T.StringType())
    return append_columns(df, [field], lambda batch: [texts_of(batch.column(ids), model.ready())], drop)


def encode_and_decode(df: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Add both ``ids`` and the text they give, ``decoded``, in one pass."""

    def make(batch):
        found = ids_of(batch.column(text), model.ready())
        return [found, texts_of(found, model.ready())]

    return append_columns(df, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())], make)


def round_trip(df: DataFrame, model: Model) -> DataFrame:
    """For each text the number of pieces, a hash of the ids, and what decoding them gives."""
    both = encode_and_decode(df, model)
    return both.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.translate("text", BLANK, " ")).alias("same"),
    )


@query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), Model())
