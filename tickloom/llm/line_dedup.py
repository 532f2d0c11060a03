"""Near-duplicate lines by a segment-partition edit join.

Lines of at least `least_chars` code points that lie within `most_edits` edits of each other are linked, shorter
lines only if they are equal (two edits would make any two short lines alike). Of each class (lines that links reach)
the first occurrence stays, by document id and line number. Blank lines stay.

Each line is cut into most_edits + 1 segments; two lines within that many edits share a segment whose place has
moved by no more than the edits allow. A line gives its own segments as index entries, and the substrings that
could equal a segment of a partner of the same or a shorter length as probes: hashes of content, segment number
and partner length. Rows are sorted by hash and met in one pass. Candidates differ little in a sketch of character
counts; a banded bit-parallel edit distance on the texts then decides.

A meeting of more than `run_rows` lines is not compared: it is dealt anew. The shared segment is taken out of each of
its lines, and what remains, again within the edits, is cut into most_edits + 1 segments of about equal information
(where a bounded sample of the meeting's lines differ; the sample steers only where the cuts lie, and any cuts give
the same links). This goes on until meetings are small, or no more than SHORT code points remain; then lines meet by
what remains with up to `most_edits` places deleted or masked, where a meeting proves the links with its first line.

Defined results: null and empty texts have no lines to lose; lines of rows with a null id are left alone; rows
that repeat an id and text count once and lose the same lines; other columns are not read or stay as they are. A
document whose every line goes is dropped by `drop_repeated_lines`.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import hot_join, ids_and_text, maybe_in, parts, sliced, small_batches, store, strings
from tickloom.llm.components import components
from tickloom.llm.texthash import _powers, mix

MOST_EDITS = 2
LEAST_CHARS = 20
#: Rows of a meeting that are compared where they meet; larger meetings are dealt anew.
RUN_ROWS = 1024
#: The same for meetings that have been dealt anew.
DEALT_ROWS = 128
#: Lines of a meeting that steer its cuts, about.
SAMPLE_ROWS = 48
#: What remains of a line is cut no further from this number of code points on.
SHORT = 8
#: Stands for a segment that has been taken out of a line; no line holds it.
HOLE = "\n"
#: Meetings up to this size are compared side by side, many at a time.
FEW_ROWS = 64
_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_NIBBLES = 16
#: Code points of white space.
_BLANK = np.array([*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)


class Lines:
    """Lines of a batch of texts as one array of code points."""

    def __init__(self, texts: list[str]) -> None:
        flat = self.flat = "\n".join([*texts, ""])
        self.code = np.frombuffer(flat.encode("utf-32-le"), dtype=np.uint32)
        ends = np.flatnonzero(self.code == 10)
        self.start = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
        self.length = (ends - self.start).astype(np.int64)
        per_text = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(texts)), per_text)
        self.number = np.arange(len(ends)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        self.total = self.down = None

    def hash(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Rolling hash of each substring, for probes: what they find is verified."""
        if self.total is None:  # made for probes only
            letters = mix(self.code.astype(np.uint64) + _U(0x632BE59BD9B4E019))
            self.down = _powers(len(self.code) + 1, _INVERSE)
            self.total = np.zeros(len(self.code) + 1, dtype=np.uint64)
            np.cumsum(letters * _powers(len(self.code), _BASE), out=self.total[1:])
        return mix((self.total[start + length] - self.total[start]) * self.down[start] + length.astype(np.uint64))

    def ids(self) -> np.ndarray:
        """Identity of each line, from its bytes: repetitive lines don't meet as they may in rolling hashes."""
        lines = self.flat.encode("utf-8", "surrogatepass").split(b"\n")[:-1]
        return np.fromiter(map(xxhash.xxh3_64_intdigest, lines), dtype=np.uint64, count=len(lines))

    def filled(self) -> np.ndarray:
        """Places of the lines that are not blank."""
        filled = (self.length > 0) & ~np.isin(self.code[self.start], _BLANK)
        for k in np.flatnonzero(~filled & (self.length > 1)).tolist():  # lines that begin with a blank
            filled[k] = not np.isin(self.code[self.start[k] : self.start[k] + self.length[k]], _BLANK).all()
        return np.flatnonzero(filled)

    def sketch(self, some: np.ndarray) -> np.ndarray:
        """Counts of 16 kinds of characters modulo 16, in 64 bits, of some lines."""
        owner = np.repeat(np.arange(len(some)), self.length[some])
        at = np.repeat(self.start[some] - (np.cumsum(self.length[some]) - self.length[some]), self.length[some]) + np.arange(len(owner))
        code = self.code[at].astype(np.uint64)
        # digits, in which lines of one template differ, have kinds of their own
        kind = np.where((code >= 48) & (code < 58), code & _U(15), mix(code) >> _U(60)).astype(np.int64)
        counts = np.bincount(owner * _NIBBLES + kind, minlength=len(some) * _NIBBLES).reshape(-1, _NIBBLES) & 15
        return (counts.astype(np.uint64) << (np.arange(_NIBBLES, dtype=np.uint64) * _U(4))).sum(axis=1, dtype=np.uint64)


def sketch_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of circular differences of the 16 counts; an edit changes it by at most 2."""
    low = _U(0x0F0F0F0F0F0F0F0F)
    total = np.zeros(len(a), dtype=np.int64)
    for shift in (_U(0), _U(4)):
        x, y = ((a >> shift) & low).view(np.uint8), ((b >> shift) & low).view(np.uint8)
        d = (x - y) & 15
        total += np.minimum(d, 16 - d).reshape(-1, 8).sum(axis=1, dtype=np.int64)
    return total


def segment(length: np.ndarray, number: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of a segment in lines of some length; the last ones are the longer ones."""
    base, extra = length // (edits + 1), length % (edits + 1)
    short = edits + 1 - extra
    return number * base + np.maximum(0, number - short), base + (number >= short)


def _tag(value: np.ndarray, number: int, length: np.ndarray) -> np.ndarray:
    return mix(value ^ mix(length.astype(np.uint64) * _U(64) + _U(number)))


def ways(edits: int) -> list[tuple[int, int, int]]:
    """Segment number, how much shorter the partner is, and move, of the index entries (the first edits + 1) and the probes.

    An index entry is its own probe for partners of the same length without a move.
    """
    probes = [(i, shorter, move) for i in range(edits + 1) for shorter in range(edits + 1) for move in range(-i, i + 1) if abs(move - shorter) <= edits - i and (shorter or move)]
    return [(i, 0, 0) for i in range(edits + 1)] + probes


def entries(lines: Lines, some: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Key, line (place in `some`) and number of the way, of all index entries and probes of some lines."""
    start, length = lines.start[some], lines.length[some]
    every = np.arange(len(some))
    for way, (i, shorter, move) in enumerate(ways(edits)):
        partner = length - shorter
        at, size = segment(partner, i, edits)
        begin = at + move
        ok = (begin >= 0) & (begin + size <= length) & (size > 0)
        yield _tag(lines.hash(start[ok] + begin[ok], size[ok]), i, partner[ok]), every[ok], way


def occurrences(docs: DataFrame) -> DataFrame:
    """line_id, doc_id, line, n_chars of each line that is not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1_500_000):
            lines = Lines(strings(batch.column("text")))
            some = lines.filled()
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[lines.owner[some]]
            yield pa.RecordBatch.from_arrays([pa.array(lines.ids()[some].astype(np.int64)), pa.array(ids), pa.array(lines.number[some].astype(np.int32)), pa.array(lines.length[some].astype(np.int32))], ["line_id", "doc_id", "line", "n_chars"])

    return docs.mapInArrow(run, "line_id long, doc_id long, line int, n_chars int")


#: Lines that a task remembers, so that it gives the entries of a line that repeats only once in so many.
REMEMBERED = 1 << 19


def keys(docs: DataFrame, edits: int, least_chars: int) -> DataFrame:
    """key, line_id, sketch, way: index entries and probes of the lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, recent = np.zeros(0, np.uint64), []
        for batch in sliced(batches, "text", 1_000_000):
            lines = Lines(strings(batch.column("text")))
            ids = lines.ids()
            long_ = lines.filled()
            long_ = long_[lines.length[long_] >= least_chars]
            some = long_[np.unique(ids[long_], return_index=True)[1]]
            if len(seen):
                some = some[seen[np.minimum(np.searchsorted(seen, ids[some]), len(seen) - 1)] != ids[some]]
            if not len(some):
                continue
            recent.append(ids[some])
            if sum(map(len, recent)) * 8 > max(len(seen), 1 << 14):
                seen = np.sort(np.concatenate([seen, *recent]) if len(seen) < REMEMBERED else np.concatenate(recent))
                recent = []
            made = list(entries(lines, some, edits))
            who = np.concatenate([w for _, w, _ in made])
            way = np.concatenate([np.full(len(w), number, dtype=np.int8) for _, w, number in made])
            key = np.concatenate([k for k, _, _ in made])
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(ids[some][who].astype(np.int64)), pa.array(lines.sketch(some)[who].astype(np.int64)), pa.array(way)], ["key", "line_id", "sketch", "way"])

    return docs.mapInArrow(run, "key long, line_id long, sketch long, way byte")


MET = "again boolean, key long, line_id long, way byte"


def near(line: np.ndarray, sketch: np.ndarray, indexed: np.ndarray, i: np.ndarray, j: np.ndarray, edits: int) -> np.ndarray:
    """Which of the pairs (i, j) of rows are candidates."""
    ok = (line[i] != line[j]) & (indexed[i] | indexed[j])
    i, j, place = i[ok], j[ok], np.flatnonzero(ok)
    return place[sketch_distance(sketch[i], sketch[j]) <= 2 * edits]


def meet(rows: DataFrame, edits: int, run_rows: int) -> DataFrame:
    """Candidates (again false: key and line_id hold the two lines), and the rows of large meetings (again true)."""
    count = parts(rows)
    dealt = rows.select("key", "line_id", "sketch", "way").repartition(count, "key").sortWithinPartitions("key", "line_id", "way")

    def again(key: np.ndarray, line: np.ndarray, sketch: np.ndarray, way: np.ndarray) -> pa.RecordBatch:
        return _met(True, key, line, way)

    def pairs_of(line: np.ndarray, sketch: np.ndarray, indexed: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch | None:
        ok = near(line, sketch, indexed, i, j, edits)
        if not len(ok):
            return None
        a, b = np.minimum(line[i[ok]], line[j[ok]]), np.maximum(line[i[ok]], line[j[ok]])
        both = np.unique(np.stack([a, b]), axis=1)
        return _met(False, both[0], both[1], np.zeros(both.shape[1], np.int8))

    def blocks(line: np.ndarray, sketch: np.ndarray, indexed: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = np.flatnonzero(indexed)
        rows = np.concatenate([own, np.flatnonzero(~indexed)])  # row k meets the index entries before it
        step = max(1, 250_000 // max(1, len(own)))
        for at in range(0, len(rows), step):
            some = np.arange(at, min(at + step, len(rows)))
            i, j = np.repeat(some, len(own)), np.tile(np.arange(len(own)), len(some))
            before = j < i
            if (found := pairs_of(line, sketch, indexed, rows[i[before]], own[j[before]])) is not None:
                yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64)] * 3 + [np.zeros(0, np.int8)]
        large = None  # key of a meeting that has been found large and may go on
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "line_id", "sketch", "way")]
            new = [n.view(np.uint64) if n.dtype == np.int64 else n for n in new]
            if large is not None:
                n = int(np.searchsorted(new[0].view(np.int64), large, side="right"))
                if n:
                    yield again(*(x[:n] for x in new))
                new = [x[n:] for x in new]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(held[0]):
                continue
            copy = np.zeros(len(held[0]), dtype=bool)  # rows of lines that several tasks hold
            copy[1:] = (held[0][1:] == held[0][:-1]) & (held[1][1:] == held[1][:-1]) & (held[3][1:] == held[3][:-1])
            held = [x[~copy] for x in held]
            signed = held[0].view(np.int64)
            begin = int(np.searchsorted(signed, signed[-1]))  # the last meeting may go on
            yield from settle(*(x[:begin] for x in held))
            held = [x[begin:] for x in held]
            large = None
            if len(held[0]) > run_rows:
                large = held[0].view(np.int64)[0]
                yield again(*held)
                held = [x[:0] for x in held]
        yield from settle(*held)

    def settle(key: np.ndarray, line: np.ndarray, sketch: np.ndarray, way: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key) < 2:
            return
        indexed = way <= edits
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))
        large = size > min(FEW_ROWS, run_rows)
        for f, n in zip(first[large].tolist(), size[large].tolist(), strict=True):
            if n <= run_rows:
                yield from blocks(*(x[f : f + n] for x in (line, sketch, indexed)))
            else:
                yield again(*(x[f : f + n] for x in (key, line, sketch, way)))
        small = np.repeat(~large & (size > 1), size)
        key, line, sketch, indexed = key[small], line[small], sketch[small], indexed[small]
        i = np.arange(len(key) - 1)
        for step in range(1, FEW_ROWS):
            i = i[i + step < len(key)]
            i = i[key[i] == key[i + step]]
            if not len(i):
                return
            if (found := pairs_of(line, sketch, indexed, i, i + step)) is not None:
                yield found

    return dealt.mapInArrow(run, MET)


def _met(again: bool, key: np.ndarray, line: np.ndarray, way: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), again)), pa.array(key.astype(np.int64)), pa.array(line.astype(np.int64)), pa.array(way)], ["again", "key", "line_id", "way"])


def remaining(content: str, way: int, path: bytes, edits: int) -> tuple[str, int | None, list[tuple[int, int]]]:
    """What remains of a line in a meeting, how much shorter its partners are (None for an index entry), and the cut-outs.

    A HOLE stands for each cut-out, so that an alignment cannot cross it. `path` holds start and length of each segment that has been taken out, as 32-bit numbers; before the first deal it is
    empty and `way` tells the segment. After that `way` is 0 for an index entry, else edits + 1 and the shortness.
    """
    if path:
        numbers = struct.unpack(f"<{len(path) // 4}i", path)
        taken = list(zip(numbers[::2], numbers[1::2], strict=True))
        shorter = way - edits - 1
    else:
        i, shorter, move = ways(edits)[way]
        base, extra = divmod(len(content) - shorter, edits + 1)
        short = edits + 1 - extra  # as in `segment`
        taken = [(i * base + max(0, i - short) + move, base + (i >= short))]
    rest = content
    for begin, size in taken:
        rest = rest[:begin] + HOLE + rest[begin + size :]
    return rest, None if way <= edits else shorter, taken


def cuts_of(rests: list[str], edits: int) -> list[int]:
    """Places that part what remains into edits + 1 segments of about equal information, from index entries of one meeting.

    Each segment has a code point beside holes. Only the length, if no more than SHORT code points remain.
    """
    size = len(rests[0])
    code = np.frombuffer("".join(r for r in rests if len(r) == size).encode("utf-32-le"), dtype=np.uint32).reshape(-1, size)
    places = np.flatnonzero(code[0] != ord(HOLE))  # the same in all of them
    if len(places) <= max(SHORT, edits):
        return [size]
    code = code[:, places]
    steps = range(1, min(9, len(code)))
    equal = sum(((code[k:] == code[:-k]).sum(axis=0) for k in steps), np.zeros(len(places)))
    tries = sum(len(code) - k for k in steps)
    information = np.cumsum(-np.log2((equal + 0.25) / (tries + 0.25)))
    if information[-1] <= 1e-9:
        information = np.arange(1.0, len(places) + 1)
    cuts = [int(np.searchsorted(information, information[-1] * k / (edits + 1) - 1e-9)) + 1 for k in range(1, edits + 1)]
    for k in range(edits):
        cuts[k] = max(cuts[k], cuts[k - 1] + 1 if k else 1)
    for k in range(edits - 1, -1, -1):
        cuts[k] = min(cuts[k], len(places) - (edits - k))
    return [0, *(int(places[c]) for c in cuts), size]


def variants(text: str, deleted: int, masked: int) -> set[str]:
    """The text with some code points deleted and as many of the others as there are, up to `masked`, masked; holes stay."""
    out = set()
    for gone in combinations([k for k, c in enumerate(text) if c != HOLE], deleted):
        left = [c for k, c in enumerate(text) if k not in gone]
        real = [k for k, c in enumerate(left) if c != HOLE]
        for hidden in combinations(real, min(masked, len(real))):
            out.add(f"{hidden}{''.join(c for k, c in enumerate(left) if k not in hidden)}")
    return out


def dealt_keys(key: int, rest: str, shorter: int | None, cuts: list[int], edits: int) -> Iterator[tuple[bool, int, bool, tuple[int, int]]]:
    """Whether a meeting proves links, new key, whether the row is an index entry, and the cut-out, for one row of a large meeting.

    `shorter` is None for an index entry, which is a probe for partners of the same length as well.
    """

    def named(number: int, text: str) -> int:
        value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), (key * 31 + number) & (2**64 - 1))
        return value - (1 << 64) if value >> 63 else value

    if len(cuts) == 1:
        # d deletions here, i in the partner, and masks for the other edits: those who meet are within the edits of the index entry
        for less in range(edits + 1) if shorter is None else (shorter,):
            for i in range((edits - less) // 2 + 1):
                masked = edits - less - 2 * i
                for text in variants(rest, i if shorter is None else i + less, masked):
                    yield True, named(64 + 8 * less + i, text), shorter is None, (0, 0)
        return
    for i in range(edits + 1):
        at, size = cuts[i], cuts[i + 1] - cuts[i]
        for move in range(-i, i + 1):
            begin = at + move
            if abs(move - (shorter or 0)) <= edits - i and begin >= 0 and begin + size <= len(rest):
                yield False, named(i, rest[begin : begin + size]), shorter is None and move == 0, (begin, size)


DEALT = "proof boolean, key long, line_id long, sketch long, way byte, path binary"


def dealt_anew(hot: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Rows (DEALT) of the next deal of large meetings. `hot` has key, line_id, way, path; `texts` the contents of its lines."""
    place = F.struct("key", "way", "path")
    is_index = F.col("way") <= edits
    sizes = store(hot.groupBy("key").agg(F.count("*").alias("n"), F.count(F.when(is_index, 1)).alias("n_index"), F.min(F.when(is_index, F.col("line_id"))).alias("low")).filter("n_index > 0"))
    total = hot.count()
    chance = F.pmod(F.xxhash64("line_id", "key"), F.lit(1 << 20)) * F.col("n_index") < (SAMPLE_ROWS << 20)
    some = hot_join(hot.filter(is_index), sizes, "key", "n", total).filter((F.col("line_id") == F.col("low")) | chance)

    def remains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p["key"], remaining(text, p["way"], p["path"], edits)[0]) for text, places in zip(batch.column("content").to_pylist(), batch.column("places").to_pylist(), strict=True) for p in places]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([r for _, r in found], pa.string())], ["key", "rest"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [cuts_of(r, edits) for r in batch.column("rests").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(made, pa.list_(pa.int32()))], ["key", "cuts"])

    per_line = some.groupBy("line_id").agg(F.collect_list(place).alias("places"))  # a line has a few dozen entries
    rests = texts.join(per_line, "line_id").select("content", "places").mapInArrow(remains, "key long, rest string")
    # about SAMPLE_ROWS texts a key; array_sort makes the cuts the same when a task runs again
    cuts = rests.groupBy("key").agg(F.array_sort(F.collect_list("rest")).alias("rests")).mapInArrow(choose, "key long, cuts array<int>")
    known = store(cuts.join(sizes.select("key", "n"), "key"))
    mine = hot_join(hot, known, "key", "n", total).groupBy("line_id").agg(F.collect_list(F.struct("key", "way", "path", "cuts")).alias("places"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "content"):
            lines = Lines(batch.column("content").to_pylist())
            sketches = lines.sketch(np.arange(batch.num_rows)).astype(np.int64)
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                rows = set()
                for line, text, sketch, places in zip(*(some.column(c).to_pylist() for c in ("line_id", "content")), sketches[at : at + 200].tolist(), some.column("places").to_pylist(), strict=True):
                    for p in places:
                        rest, shorter, taken = remaining(text, p["way"], p["path"], edits)
                        for proof, key, index, out in dealt_keys(p["key"], rest, shorter, p["cuts"], edits):
                            way = 0 if index else edits + 1 + (shorter or 0)
                            path = b"" if proof else struct.pack(f"<{2 * len(taken) + 2}i", *(x for pair in (*taken, out) for x in pair))
                            rows.add((proof, key, line, sketch, way, path))
                columns = list(zip(*sorted(rows), strict=True)) or [()] * 6
                kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["proof", "key", "line_id", "sketch", "way", "path"])

    # little data and much work, so the number of tasks is not left to the data's size
    return texts.join(mine, "line_id").select("line_id", "content", "places").repartition(parts(texts), "line_id").mapInArrow(deal, DEALT)


def proven(rows: DataFrame, edits: int) -> DataFrame:
    """Links (a, b) of each line with the first index entry of its meeting."""
    low = rows.groupBy("key").agg(F.min(F.when(F.col("way") <= edits, F.col("line_id"))).alias("low"), F.count("*").alias("n"))
    return hot_join(rows, low.filter("low is not null"), "key", "n", rows.count()).filter("line_id != low").select(F.col("low").alias("a"), F.col("line_id").alias("b"))


def candidates(docs: DataFrame, firsts: DataFrame, edits: int, least_chars: int, run_rows: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that may be links, and pairs that are."""
    dealt_rows = min(run_rows, DEALT_ROWS)
    met = store(meet(keys(docs, edits, least_chars), edits, run_rows))
    pair = (F.col("key").alias("a"), F.col("line_id").alias("b"))
    maybe, sure = met.filter("not again").select(*pair), met.limit(0).select(*pair)
    hot = met.filter("again").select("key", "line_id", "way", F.lit(b"").alias("path")).distinct()
    if hot.isEmpty():
        return maybe, sure
    hot = store(hot)
    places = hot.select("line_id").distinct().join(firsts, "line_id").select("line_id", "first.doc_id", "first.line")
    texts = store(contents(docs, store(places)))
    while not hot.isEmpty():  # each deal takes a segment out of what remains of the lines
        rows = store(dealt_anew(hot, texts, edits))
        sure = sure.unionByName(proven(rows.filter("proof"), edits))
        rows = rows.filter("not proof")
        large = store(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > dealt_rows))
        total = rows.count()
        maybe = maybe.unionByName(meet(rows.join(large, "key", "left_anti"), edits, dealt_rows).select(*pair))
        hot = store(hot_join(rows, large, "key", "n", total).select("key", "line_id", "way", "path"))
    return maybe, sure


def common_front(a: str, b: str) -> int:
    """Length of the common prefix, by bisection."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most `edits`: bit-parallel columns of a band of 2 * edits + 1 diagonals."""
    if abs(len(a) - len(b)) > edits:
        return False
    if len(a) < len(b):
        a, b = b, a  # a is the longer: columns run over b
    low = common_front(a, b)
    a, b = a[low:], b[low:]
    high = common_front(a[::-1], b[::-1])
    a, b = a[: len(a) - high], b[: len(b) - high]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    width = 2 * edits + 1
    mask = (1 << width) - 1
    # bit k of column j stands for row j - edits + k; the middle bit is the main diagonal
    up, down = mask & ~((1 << edits) - 1), 0
    # the value on the diagonal that ends in the last cell
    target = 1 << (edits + len(a) - len(b))
    score = len(a) - len(b)
    for j, c in enumerate(b):
        shift = j - edits
        match = at.get(c, 0)
        match = (match >> shift if shift >= 0 else match << -shift) & mask
        diagonal = ((((match & up) + up) ^ up) | match | down) & mask
        right, left = (down | ~(diagonal | up)) & mask, diagonal & up
        if not diagonal & target:
            score += 1
            if score > edits:
                return False
        moved = diagonal >> 1
        up = (left | ~(moved | right)) & mask
        down = moved & right
    return score <= edits


def verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b) whose texts (line_id, content) are within the edits."""
    both = pairs.join(texts.select(F.col("line_id").alias("a"), F.col("content").alias("x")), "a").join(texts.select(F.col("line_id").alias("b"), F.col("content").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [within(x, y, edits) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def contents(docs: DataFrame, places: DataFrame) -> DataFrame:
    """line_id, content of lines at the given places (line_id, doc_id, line)."""
    wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("line", "line_id")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = strings(batch.column("text"))
            ids, found = [], []
            lines = Lines(texts)
            hashes = lines.ids().astype(np.int64)
            first = np.searchsorted(lines.owner, np.arange(len(texts)))
            for k, (text, want) in enumerate(zip(texts, batch.column("wanted").to_pylist(), strict=True)):
                split = text.split("\n")
                for w in want:
                    if w["line"] < len(split) and int(hashes[first[k] + w["line"]]) == w["line_id"]:
                        ids.append(w["line_id"])
                        found.append(split[w["line"]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["line_id", "content"])

    return maybe_in(docs, places, "doc_id").join(wanted, "doc_id").select("text", "wanted").mapInArrow(run, "line_id long, content string").dropDuplicates(["line_id"])


def repeated_lines(docs: DataFrame, edits: int = MOST_EDITS, least_chars: int = LEAST_CHARS, run_rows: int = RUN_ROWS) -> tuple[DataFrame, DataFrame]:
    """All lines that are not blank (line_id, doc_id, line, n_chars), and those of them that go (doc_id, line, line_id)."""
    if least_chars < 3 * (edits + 1):
        raise ValueError("lines of so few characters cannot be cut into segments")
    docs = docs.filter("doc_id is not null")
    seen = store(occurrences(docs))
    firsts = store(seen.groupBy("line_id").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n")))
    maybe, sure = candidates(docs, firsts, edits, least_chars, run_rows)
    pairs = store(maybe.distinct())
    involved = pairs.select(F.col("a").alias("line_id")).union(pairs.select("b")).distinct()
    places = store(involved.join(firsts, "line_id").select("line_id", "first.doc_id", "first.line"))
    texts = store(contents(docs, places))
    classes = components(verified(pairs, texts, edits).unionByName(sure))
    members = store(firsts.join(classes, F.col("line_id") == F.col("node")).select("line_id", "first", F.col("component").alias("class")))
    stays = members.groupBy("class").agg(F.min("first").alias("kept"), F.count("*").alias("m"))
    kept = hot_join(members, stays, "class", "m", members.count()).select("line_id", "kept")
    repeated = firsts.join(kept, "line_id", "left").withColumn("kept", F.coalesce("kept", "first")).filter((F.col("n") > 1) | (F.col("kept") != F.col("first")))
    repeated = store(repeated.select("line_id", "kept", "n"))
    gone = hot_join(seen, repeated, "line_id", "n", seen.count()).filter(F.struct("doc_id", "line") != F.col("kept")).select("doc_id", "line", "line_id").distinct()
    return seen, gone


def line_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = MOST_EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Per document with an id: doc_id, n_lines, n_filled (not blank), n_dropped, dropped (line numbers from 0, comma-joined), n_chars_dropped."""
    docs = ids_and_text(df, id_col, text_col)
    seen, gone = repeated_lines(docs, edits, least_chars)
    filled = seen.select("doc_id", "line", "line_id", "n_chars").distinct()
    marked = filled.join(gone.withColumn("gone", F.lit(True)), ["doc_id", "line", "line_id"], "left")
    per = marked.groupBy("doc_id").agg(
        F.count("*").alias("n_filled"),
        F.count("gone").alias("n_dropped"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("line")))), ",").alias("dropped"),
        F.coalesce(F.sum(F.when(F.col("gone"), F.col("n_chars"))), F.lit(0)).cast("long").alias("n_chars_dropped"),
    )
    size = F.octet_length("text")
    n_lines = F.when(size > 0, size - F.octet_length(F.replace("text", F.lit("\n"))) + 1).otherwise(0)
    sizes = docs.filter("doc_id is not null").select("doc_id", n_lines.cast("long").alias("n_lines")).groupBy("doc_id").agg(F.max("n_lines").alias("n_lines"))
    empty = {"n_filled": 0, "n_dropped": 0, "dropped": "", "n_chars_dropped": 0}
    return sizes.join(per, "doc_id", "left").fillna(empty).select("doc_id", "n_lines", *empty)


def drop_repeated_lines(df: DataFrame, edits: int = MOST_EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The rows of `df` (with doc_id, text, and n_chars if there) without the lines that go; see the module."""
    small_batches(df.sparkSession)
    _, gone = repeated_lines(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), edits, least_chars)
    doc_name, lost_name = (f"{n}_{uuid.uuid4().hex}" for n in ("doc", "lost"))  # no name of the table's
    lost = gone.groupBy(F.col("doc_id").alias(doc_name)).agg(F.collect_list(F.struct("line", "line_id")).alias(lost_name))
    joined = df.join(lost, F.col("doc_id") == F.col(doc_name), "left").drop(doc_name)
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            lost = batch.column(lost_name).to_pylist()
            texts = batch.column("text").to_pylist()
            lines = Lines([t or "" for t in texts])
            hashes = lines.ids().astype(np.int64)
            first = np.searchsorted(lines.owner, np.arange(len(texts)))
            keep = []
            for k, (text, want) in enumerate(zip(texts, lost, strict=True)):
                keep.append(True)
                if want:
                    split = text.split("\n")
                    out = {w["line"] for w in want if w["line"] < len(split) and int(hashes[first[k] + w["line"]]) == w["line_id"]}
                    left = [x for i, x in enumerate(split) if i not in out]
                    keep[-1] = any(x.strip() for x in left)
                    texts[k] = "\n".join(left)
            names = batch.schema.names
            columns = dict(zip(names, batch.columns, strict=True))
            columns["text"] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in columns:
                sizes = [None if t is None else len(t) for t in texts]
                columns["n_chars"] = pa.array([s if w else n for s, w, n in zip(sizes, lost, columns["n_chars"].to_pylist(), strict=True)], batch.schema.field("n_chars").type)
            order = [n for n in names if n != lost_name]
            yield pa.RecordBatch.from_arrays([columns[n] for n in order], order).filter(pa.array(keep))

    return joined.mapInArrow(run, schema)
