"""Periodic runs of words: maximal stretches that repeat with a period, and texts without the repetition.

A run is a stretch of words with smallest period q and at least max(LEAST_WORDS, LEAST_PERIODS * q) words that no
neighbouring word extends keeping the period. Harmonic grids enumerate them: for each period q, a run holds at least
one place x of the grid of steps max(LEAST_WORDS, LEAST_PERIODS * q) - q where words x and x + q are equal, and how far
they agree onwards and backwards gives the run. That is n log n places for n words.

How far two places agree is the longest common extension. A difference cover modulo COVER_SIZE lists suffixes such that
any two places reach two listed ones after the same few words: these words are compared, then the listed suffixes give
the rest. Only they are sorted, by doubling over blocks of COVER_SIZE words; a sparse table over what neighbours share
answers in two reads. The words backwards do the same with the sequence reversed. Block names come from 64-bit hashes
that are verified; a collision falls back on naming word by word, so all results are exact.

Texts are dealt in slices (one long text is a slice of its own), so any number of documents is spread over tasks without
a shuffle. A slice needs about 150 bytes a word.

Defined results: words are `[^\\x20\\x09-\\x0D]+` of the UTF-8 text, compared byte by byte; a null text is empty (no words,
no runs, an empty collapsed text); each row gives one row, also with a null or repeated id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ids_and_text, sliced
from tickloom.llm.texthash import mix

LEAST_WORDS, LEAST_PERIODS = 24, 3
#: A perfect difference set: each difference modulo 57 is that of two members.
COVER_SIZE, COVER = 57, np.array([0, 1, 3, 13, 32, 36, 43, 52])
#: Pairs of places that one NumPy step holds.
PAIRS = 1 << 20


def _shifts() -> np.ndarray:
    """After how many words places with the given remainders both meet the cover."""
    member = np.isin(np.arange(2 * COVER_SIZE) % COVER_SIZE, COVER)
    out = np.full((COVER_SIZE, COVER_SIZE), -1)
    for d in range(COVER_SIZE - 1, -1, -1):
        both = np.ix_(member[d : d + COVER_SIZE], member[d : d + COVER_SIZE])
        out[both] = d
    return out


SHIFTS = _shifts()
_RANK = np.searchsorted(COVER, np.arange(COVER_SIZE))


def _agree(w: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from i and from j on are equal, up to `most`; the last word of w is like no other."""
    n = np.zeros(len(i), dtype=np.int64)
    live, t = np.flatnonzero(most > 0), 0
    while len(live):
        live = live[w[i[live] + t] == w[j[live] + t]]
        n[live] += 1
        t += 1
        live = live[most[live] > t]
    return n


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of rows, in the order of the first column, then the second."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


class Extensions:
    """Longest common extensions of places in w, whose last word is like no other."""

    def __init__(self, w: np.ndarray) -> None:
        self.w = w
        n = len(w)
        at = (np.arange(0, n, COVER_SIZE)[:, None] + COVER).ravel()
        self.size = len(at)
        # beyond the end, words that are like no others
        self.padded = np.concatenate([w, w.max(initial=0) + 1 + np.arange(2 * COVER_SIZE)])
        rank = self._names(at)
        self.ranks = [rank]
        step = len(COVER)
        while step < self.size and rank.max(initial=0) + 1 < self.size:
            after = np.full(self.size, -1, dtype=np.int64)
            after[:-step] = rank[step:]
            rank = _numbered(rank, after)
            self.ranks.append(rank)
            step *= 2
        order = np.argsort(rank, kind="stable")
        self.place = np.empty(self.size, dtype=np.int64)
        self.place[order] = np.arange(self.size)
        # blocks that neighbours in the order share, by descending powers of two
        shared = np.zeros(self.size, dtype=np.int64)
        a, b = order[:-1].copy(), order[1:].copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            inside = (a < self.size) & (b < self.size)
            same = np.zeros(len(a), dtype=bool)
            same[inside] = self.ranks[k][a[inside]] == self.ranks[k][b[inside]]
            shared[1:][same] += 1 << k
            a[same] += len(COVER) << k
            b[same] += len(COVER) << k
        self.ranks = []
        self.least = [shared.astype(np.int32)]  # least[k][i] = min of shared[i : i + 2^k]
        while 2 << (len(self.least) - 1) <= self.size:
            before, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(before[:-half], before[half:]))

    def _names(self, at: np.ndarray) -> np.ndarray:
        """Numbers of the blocks of COVER_SIZE words at the given places; equal blocks have equal ones."""
        h = np.zeros(len(at), dtype=np.uint64)
        for t in range(COVER_SIZE):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + self.padded[np.minimum(at + t, len(self.padded) - 1)].astype(np.uint64) + np.uint64(1))
        # places in the padding are never asked for, but need names of their own
        h = np.where(at < len(self.w), h, mix(at.astype(np.uint64) + np.uint64(1 << 40)))
        names = _numbered(h)
        order = np.argsort(names, kind="stable")
        a, b = order[:-1], order[1:]
        same = (names[a] == names[b]) & (at[a] < len(self.w)) & (at[b] < len(self.w))
        a, b = at[a[same]], at[b[same]]
        if all(np.array_equal(self.padded[a + t], self.padded[b + t]) for t in range(COVER_SIZE)):
            return names
        names = np.where(at < len(self.w), 0, at)
        for t in range(COVER_SIZE):
            names = _numbered(names, self.padded[np.minimum(at + t, len(self.padded) - 1)])
        return names

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal (i differs from j)."""
        shift = SHIFTS[i % COVER_SIZE, j % COVER_SIZE]
        out = _agree(self.w, i, j, shift)
        far = np.flatnonzero(out == shift)
        a, b = i[far] + shift[far], j[far] + shift[far]
        p, q = (self.place[x // COVER_SIZE * len(COVER) + _RANK[x % COVER_SIZE]] for x in (a, b))
        low, high = np.minimum(p, q) + 1, np.maximum(p, q) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        blocks = np.empty(len(far), dtype=np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            blocks[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << k)])
        a, b = a + blocks * COVER_SIZE, b + blocks * COVER_SIZE
        out[far] = shift[far] + blocks * COVER_SIZE + _agree(self.w, a, b, np.full(len(far), COVER_SIZE))
        return out


class _Slice:
    """Word numbers of several texts, the longest first, between words that are like no others."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.counts = counts
        self.starts = np.cumsum(counts + 1) - counts  # place of each text's first word
        self.w = np.empty(int(counts.sum()) + len(counts) + 1, dtype=np.int64)
        marks = np.concatenate([[0], self.starts + counts])
        word = np.ones(len(self.w), dtype=bool)
        word[marks] = False
        self.w[word] = ids
        self.w[marks] = int(ids.max(initial=-1)) + 1 + np.arange(len(marks))
        self.held: np.ndarray | None = None

    def part(self, texts: np.ndarray) -> _Slice:
        rows = np.concatenate([self.w[self.starts[t] : self.starts[t] + self.counts[t]] for t in texts.tolist()])
        return _Slice(rows, self.counts[texts])

    def extensions(self, x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far words q apart agree from x on, and before x; both structures cover only texts that were asked for."""
        text = np.searchsorted(self.starts, x, side="right") - 1
        asked = np.unique(text)
        if self.held is None or not np.isin(asked, self.held).all():
            self.held = asked if self.held is None else np.union1d(asked, self.held)
            self.some = self.part(self.held)
            self.onwards, self.back = Extensions(self.some.w), Extensions(self.some.w[::-1].copy())
        y = x - self.starts[text] + self.some.starts[np.searchsorted(self.held, text)]
        last = len(self.some.w) - 1
        return self.onwards.of(y, y + q), self.back.of(last - (y - 1), last - (y + q - 1))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start (in w), end and smallest period of each run, by start and period."""
        found: list[np.ndarray] = []
        xs: list[np.ndarray] = []
        qs: list[np.ndarray] = []
        held = 0
        longest = int(self.counts.max(initial=0))
        for q in range(1, longest // LEAST_PERIODS + 1):
            least = max(LEAST_WORDS, LEAST_PERIODS * q)
            n = int(np.searchsorted(-self.counts, -least, side="right"))  # texts long enough
            if not n:
                break
            end, step = int(self.starts[n - 1] + self.counts[n - 1]), least - q
            x = np.flatnonzero(self.w[1 : end - q : step] == self.w[1 + q : end : step]) * step + 1
            if len(x):
                xs.append(x)
                qs.append(np.full(len(x), q, dtype=np.int64))
                held += len(x)
            if held > PAIRS:
                found.append(self._runs_at(np.concatenate(xs), np.concatenate(qs)))
                xs, qs, held = [], [], 0
        if held:
            found.append(self._runs_at(np.concatenate(xs), np.concatenate(qs)))
        if not found:
            return (np.zeros(0, dtype=np.int64),) * 3
        start, end, q = np.concatenate(found, axis=1)
        order = np.lexsort((q, end, start))  # a stretch found by several periods: the smallest is its own
        start, end, q = start[order], end[order], q[order]
        first = np.ones(len(start), dtype=bool)
        first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, q = start[first], end[first], q[first]
        order = np.lexsort((q, start))
        return start[order], end[order], q[order]

    def _runs_at(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Runs that hold the words x and x + q, which are equal."""
        most = np.full(len(x), COVER_SIZE)
        onwards = _agree(self.w, x, x + q, most)
        last = len(self.w) - 1
        back = _agree(self.w[::-1], last - (x - 1), last - (x + q - 1), most)
        far = np.flatnonzero((onwards == COVER_SIZE) | (back == COVER_SIZE))
        if len(far):
            onwards[far], back[far] = self.extensions(x[far], q[far])
        keep = onwards + back + q >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        return np.unique(np.stack([(x - back)[keep], (x + onwards + q)[keep], q[keep]]), axis=1)


_RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _found(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column("text").to_pylist()]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(-counts, kind="stable")
    flat = pa.array([w for i in order.tolist() for w in words[i]], pa.large_binary()).dictionary_encode()
    made = _Slice(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts[order])
    start, end, q = made.runs()
    # a word goes if some run holds it after its first period
    edges = np.bincount(start + q, minlength=len(made.w) + 1) - np.bincount(end, minlength=len(made.w) + 1)
    gone = np.cumsum(edges) > 0
    text = np.searchsorted(made.starts, start, side="right") - 1
    runs_of = np.split(np.arange(len(start)), np.searchsorted(text, np.arange(1, len(counts))))
    runs, collapsed = [None] * len(words), [b""] * len(words)
    for k, i in enumerate(order.tolist()):
        some, at = runs_of[k], int(made.starts[k])
        runs[i] = [{"start": int(start[r]) - at, "length": int(end[r] - start[r]), "period": int(q[r])} for r in some.tolist()]
        kept = words[i] if not len(some) else [w for w, g in zip(words[i], gone[at : at + counts[i]].tolist(), strict=True) if not g]
        collapsed[i] = b" ".join(kept)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    arrays = [batch.column("doc_id"), pa.array(counts), pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed (kept words joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            yield _found(batch)

    return ids_and_text(df, id_col, text_col).mapInArrow(run, f"doc_id bigint, n_words bigint, runs array<{_RUN}>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period; of equal ones the first. Null without runs."""
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))


def planted(df: DataFrame) -> DataFrame:
    """doc_id, text: documents whose id has a checksum (CRC-32 of its decimal digits) divisible by ten repeat a stretch of their words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    marked = df.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g")).withColumn("words", F.when((F.col("h") % 10 == 0), words))
    n = F.size("words")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    sized = marked.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    repeated = F.array_join(F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p")))), " ")
    return sized.select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text"))
