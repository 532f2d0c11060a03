"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

An agenda holds the candidate merges of a segment, best score first, then leftmost. A candidate taken from the
agenda is skipped when a hash keyed by seed, row id, place of the segment in its text, and candidate (place and
pieces) falls under the dropout rate; it returns only as a new candidate, when a neighbour changes. Rate 0 gives the
plain encoding.

No piece has a space mark after another character, so a text is cut before each run of space marks and around
characters that no piece holds, and segments are encoded alone. A batch encodes each distinct segment once without
skips and notes the candidates taken. Every occurrence draws for these candidates under its own key: where it skips
none, the plain encoding is its encoding; the others run their own agenda, all of them together: one round takes the
best candidate of every segment. Long segments use a heap.

Lossless for every text: characters outside the vocabulary, and space marks (U+2581) of the text itself, become
byte pieces. Defined results: a null or empty text has no ids and decodes to the empty text; rows with a null id
use 0 in the hash; repeated rows (same id, same text) give the same ids; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import ids_and_text, sliced, strings
from tickloom.llm.texthash import mix

_U = np.uint64
MARK = "▁"
NONE = -(1 << 40)
WIDE = 64
#: Cells of one block of segments that are merged together.
CELLS = 1 << 19


class Pieces:
    """Vocabulary of a BPE model file: pieces, scores, and the merges that give a piece."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(size)]
        self.id = {p: i for i, p in enumerate(self.text) if plain[i]}
        score = np.array([model.get_score(i) for i in range(size)])
        self.rank = np.full(size, NONE, dtype=np.int64)  # higher is better; equal scores share a rank
        self.rank[:] = np.unique(score, return_inverse=True)[1]
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else (p.replace(MARK, " ").encode() if plain[i] else b"") for i, p in enumerate(self.text)]
        self.char = np.full(0x110000, -1, dtype=np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        pairs = {(self.id[p[:k]] << 20) | self.id[p[k:]]: i for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id}
        self._hash_table(np.array(list(pairs), dtype=np.int64), np.array(list(pairs.values()), dtype=np.int64))

    def _hash_table(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            at = slot[left]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]  # the last of those that meet wins
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that two pieces make, -1 if none. A negative symbol makes none."""
        bad = (left < 0) | (right < 0)
        keys = np.where(bad, -2, (left << 20) | right)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found != -1) & ~bad)
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


def candidate(place: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of each candidate in its segment."""
    return mix((place.astype(np.uint64) << _U(40)) ^ (left.astype(np.uint64) << _U(20)) ^ right.astype(np.uint64))


def skipped(key: np.ndarray, candidates: np.ndarray, rate: float) -> np.ndarray:
    return (mix(key ^ candidates) >> _U(11)).astype(np.float64) * 2.0**-53 < rate


def dropped(key: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, rate: float) -> np.ndarray:
    """Whether the keyed hash skips each candidate."""
    if rate <= 0:
        return np.zeros(len(key), dtype=bool)
    return skipped(key, candidate(place, left, right), rate)


def merge_block(symbols: np.ndarray, keys: np.ndarray, pieces: Pieces, rate: float, taken: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs the agenda of many segments (rows, padded with -1 on the right). Symbols, and which of them are left.

    `taken` gets, for each round, the rows and the hashes of the candidates that they took from the agenda.
    """
    rows, width = symbols.shape
    symbols = symbols.astype(np.int64)
    alive = np.ones((rows, width), dtype=bool)
    if width < 2:
        return symbols, alive
    after = np.tile(np.arange(1, width + 1), (rows, 1))
    before = np.tile(np.arange(-1, width - 1), (rows, 1))
    made = np.full((rows, width), -1, dtype=np.int64)
    made[:, :-1] = pieces.merged(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(rows, width - 1)
    score = np.where(made >= 0, pieces.rank[made], NONE)
    active = np.arange(rows)
    while True:
        best = score[active].argmax(axis=1)  # the leftmost of equal ones
        some = score[active, best] > NONE
        active, best = active[some], best[some]
        if not len(active):
            return symbols, alive
        right = after[active, best]
        if taken is not None:
            taken.append((active, candidate(best, symbols[active, best], symbols[active, right])))
        skip = dropped(keys[active], best, symbols[active, best], symbols[active, right], rate)
        score[active[skip], best[skip]] = NONE
        row, at, gone = active[~skip], best[~skip], right[~skip]
        symbols[row, at] = made[row, at]
        alive[row, gone] = False
        score[row, gone] = NONE
        beyond = after[row, gone]
        after[row, at] = beyond
        inner = beyond < width
        before[row[inner], beyond[inner]] = at[inner]
        new = np.full(len(row), -1, dtype=np.int64)
        new[inner] = pieces.merged(symbols[row[inner], at[inner]], symbols[row[inner], beyond[inner]])
        made[row, at] = new
        score[row, at] = np.where(new >= 0, pieces.rank[new], NONE)
        front = before[row, at]
        has = front >= 0
        r, f, a = row[has], front[has], at[has]
        new = pieces.merged(symbols[r, f], symbols[r, a])
        made[r, f] = new
        score[r, f] = np.where(new >= 0, pieces.rank[new], NONE)


def merge_long(symbols: np.ndarray, key: int, pieces: Pieces, rate: float) -> np.ndarray:
    """The same for one segment of any length, with a heap."""
    s = symbols.astype(np.int64).tolist()
    n = len(s)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    first = pieces.merged(symbols[:-1].astype(np.int64), symbols[1:].astype(np.int64))
    heap = [(-int(pieces.rank[m]), i, s[i], s[i + 1], m) for i, m in enumerate(first.tolist()) if m >= 0]
    heapq.heapify(heap)
    one = lambda x: np.array([x], dtype=np.int64)
    keyed = np.array([key], dtype=np.uint64)

    def offer(i: int) -> None:
        j = after[i]
        if i >= 0 and j < n and (m := int(pieces.merged(one(s[i]), one(s[j]))[0])) >= 0:
            heapq.heappush(heap, (-int(pieces.rank[m]), i, s[i], s[j], m))

    while heap:
        _, i, left, right, m = heapq.heappop(heap)
        j = after[i]
        if s[i] != left or j >= n or s[j] != right:
            continue
        if dropped(keyed, one(i), one(left), one(right), rate)[0]:
            continue
        s[i], s[j] = m, -1 << 30
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(s[i])
        i = after[i]
    return np.array(out, dtype=np.int64)


class Encoder:
    """Encodes batches of texts. Callers may still give `variants`; it has no effect, as every occurrence draws for itself."""

    def __init__(self, path: str, rate: float, seed: int, variants: int = 0) -> None:
        self.pieces, self.rate = Pieces(path), rate
        self.seed = int(mix(np.array([seed & (2**64 - 1)], dtype=np.uint64))[0])
        with np.errstate(over="ignore"):
            self.letter = mix(np.arange(1, 0x110001, dtype=np.uint64))

    def encode(self, texts: list[str], row_ids: list[int | None]) -> list[np.ndarray]:
        p = self.pieces
        # a space mark at the front, one text after another
        flat = "".join(" " + t if t else "" for t in texts)
        code = np.frombuffer(flat.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        n = len(code)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        if not n:
            return [np.zeros(0, dtype=np.int64) for _ in texts]
        symbol = p.char[code].astype(np.int64)
        space = code == 0x20
        symbol[space] = p.id[MARK]
        symbol[code == ord(MARK)] = -1
        unknown = symbol < 0
        symbol[unknown] = -2 - code[unknown]
        cut = np.zeros(n, dtype=bool)
        cut[1:] = (space[1:] & ~space[:-1]) | unknown[1:] | unknown[:-1]
        cut[0] = True
        cut[(ends - sizes)[sizes > 0]] = True
        start = np.flatnonzero(cut)
        length = np.diff(np.concatenate([start, [n]]))
        owner = np.searchsorted(ends, start, side="right")
        place = start - (ends - sizes)[owner]
        powers = _powers_of(int(length.max()))
        within = np.arange(n) - np.repeat(start, length)
        letters = mix(np.add.reduceat(self.letter[code] * powers[within], start) + length.astype(np.uint64))
        ids = np.array([(i or 0) & (2**64 - 1) for i in row_ids], dtype=np.uint64)
        key = mix(mix(ids ^ _U(self.seed))[owner] + place.astype(np.uint64))
        own = length > WIDE if self.rate > 0 else np.zeros(len(start), dtype=bool)  # nearly every long one skips something
        shared = np.flatnonzero(~own)
        _, first, which = np.unique(letters[shared], return_index=True, return_inverse=True)
        # segments of one hash whose characters differ go alone, so that the hash decides nothing
        twin = start[shared[first]][which]
        at = np.repeat(start[shared], length[shared]) + (step := np.arange(int(length[shared].sum())) - np.repeat(np.cumsum(length[shared]) - length[shared], length[shared]))
        odd = code[at] != code[np.minimum(np.repeat(twin, length[shared]) + step, n - 1)]
        other = (length[shared[first]][which] != length[shared]) | (np.bincount(np.repeat(np.arange(len(shared)), length[shared]), weights=odd, minlength=len(shared)) > 0)
        if other.any():
            own[shared[other]] = True
            shared = np.flatnonzero(~own)
            _, first, which = np.unique(letters[shared], return_index=True, return_inverse=True)
        taken: list | None = [] if self.rate > 0 else None
        some = shared[first]
        flat_ids, begin, size = self._segments(symbol, start[some], length[some], key[some], 0.0, taken)
        out_start, out_length = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        out_start[shared], out_length[shared] = begin[which], size[which]
        if taken is not None:
            own[shared] = self._skips(key[shared], which, len(some), taken)
        some = np.flatnonzero(own)
        if len(some):
            more, begin, size = self._segments(symbol, start[some], length[some], key[some], self.rate)
            out_start[some], out_length[some] = begin + len(flat_ids), size
            flat_ids = np.concatenate([flat_ids, more])
        # put the segments of each text in order
        count = out_length
        total = np.cumsum(count)
        source = np.repeat(out_start - (total - count), count) + np.arange(int(total[-1]))
        stream = flat_ids[source]
        per_text = np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)
        return np.split(stream, np.cumsum(per_text)[:-1])

    def _skips(self, key: np.ndarray, which: np.ndarray, kinds: int, taken: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Which occurrences (of segment `which` of `kinds`) skip any of the candidates that the plain agenda takes."""
        out = np.zeros(len(key), dtype=bool)
        if not taken:
            return out
        segment, candidates = (np.concatenate(x) for x in zip(*taken, strict=True))
        candidates = candidates[np.argsort(segment, kind="stable")]
        count = np.bincount(segment, minlength=kinds)
        begin = np.cumsum(count) - count
        for at in range(0, len(key), CELLS // 8):
            some = which[at : at + CELLS // 8]
            n = count[some]
            row = np.repeat(np.arange(len(some)), n)
            place = np.arange(len(row)) + np.repeat(begin[some] - (np.cumsum(n) - n), n)
            out[at + row[skipped(key[at + row], candidates[place], self.rate)]] = True
        return out

    def _segments(
        self, symbol: np.ndarray, start: np.ndarray, length: np.ndarray, key: np.ndarray, rate: float, taken: list | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of segments: one array, and where each segment's are. `taken` as in merge_block, by segment."""
        if not len(start):
            return (np.zeros(0, dtype=np.int64),) * 3
        chunks: list[np.ndarray] = []
        size = np.zeros(len(start), dtype=np.int64)
        order: list[np.ndarray] = []
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 32), (32, WIDE)):
            those = np.flatnonzero((length > low) & (length <= high))
            step = max(1, CELLS // high)
            for at in range(0, len(those), step):
                some = those[at : at + step]
                where = start[some][:, None] + np.arange(high)
                pad = np.arange(high) >= length[some][:, None]
                block = symbol[np.minimum(where, len(symbol) - 1)]
                block[pad] = -1
                rounds: list | None = None if taken is None else []
                done, alive = merge_block(block, key[some], self.pieces, rate, rounds)
                if taken is not None:
                    taken += [(some[row], c) for row, c in rounds]
                alive &= ~pad
                chunks.append(done[alive])
                size[some] = alive.sum(axis=1)
                order.append(some)
        for i in np.flatnonzero(length > WIDE).tolist():
            done = merge_long(symbol[start[i] : start[i] + length[i]], int(key[i]), self.pieces, rate)
            chunks.append(done)
            size[i] = len(done)
            order.append(np.array([i]))
        flat = np.concatenate(chunks)
        ordered = np.concatenate(order)
        # symbols outside the vocabulary become their UTF-8 bytes
        unknown = np.flatnonzero(flat < -1)
        if len(unknown):
            raw = [list(chr(-2 - int(c)).encode()) for c in flat[unknown]]
            widths = np.ones(len(flat), dtype=np.int64)
            widths[unknown] = [len(b) for b in raw]
            grown = np.repeat(flat, widths)
            grown[grown < -1] = self.pieces.byte[np.array([b for r in raw for b in r], dtype=np.int64)]
            bounds = np.concatenate([[0], np.cumsum(size[ordered])])
            wide = np.concatenate([[0], np.cumsum(widths)])
            size[ordered] = wide[bounds[1:]] - wide[bounds[:-1]]
            flat = grown
        begin = np.zeros(len(start), dtype=np.int64)
        begin[ordered] = np.cumsum(size[ordered]) - size[ordered]
        return flat, begin, size


def _powers_of(n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = _U(0x9E3779B97F4A7C15)
    return np.cumprod(out)


def encode(df: DataFrame, path: str, rate: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, as little-endian 32-bit numbers in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, rate, seed)
        for batch in sliced(batches, "text", 2_000_000):
            found = encoder.encode(strings(batch.column("text")), batch.column("doc_id").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())], ["doc_id", "ids"])

    return ids_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(df: DataFrame, path: str) -> DataFrame:
    """Adds the column `decoded` to rows with ids as `encode` gives them; other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces(path).bytes
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = []
                for raw in part.column("ids").to_pylist():
                    text = b"".join([table[i] for i in np.frombuffer(raw or b"", dtype="<u4").tolist()]).decode()
                    texts.append(text[1:])  # the space mark that encoding put at the front
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, decoded string")
