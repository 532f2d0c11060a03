"""N-gram Jaccard self-join with set-relation skipping.

Each text is the set of its distinct word shingles (64-bit hashes). Equal sets are one set from the start. A
global order puts shingles that are frequent in the corpus last and the others by hash; any order gives the same
links. The prefixes of the sets form inverted lists, whose entries lie in two blocks by position: a set's leading
entries, where the first common shingle of a linked pair must lie in the smaller set, and the rest. Lists without
leading entries, and rest entries whose size no leading entry can match, are skipped.

Each list has a pivot, its smallest set; every linked pair shares a list, so it shares a pivot. Counts of a set's
shingles by hash range bound its difference from another from below; sets of one pivot that the bounds tie together
get a common head, and the others go. The members of a head are compared through their differences from it: for
sets y and z with differences Dy and Dz, the symmetric difference of y and z is that of Dy and Dz. So a set's
answers come from those of the similar head, and cost the edits rather than the sets. Members beyond `group_rows`
are dealt into pairs of blocks. A group gives a spanning forest of its links, not its pairs; components follow.

Defined results: null, empty and blank texts have no shingles and link with nothing; a row with a null id is
counted, has a null component and links with nothing; repeated rows are copies; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import hot_join, ids_and_text, kth_largest, maybe_in, packed, parts, sliced, store, texts_of, unpacked
from tickloom.llm.components import components
from tickloom.llm.texthash import WordHasher, mix, shingles

#: Frequent shingles that the global order puts last, at most. They are broadcast (8 bytes each).
MOST_FREQUENT = 1 << 18
#: Bytes of text that are counted together, and the least count there that makes a shingle a candidate.
COUNT_BYTES, LEAST_COUNT = 12_000_000, 4
#: Hash ranges of the counts that bound differences.
RANGES = 64
#: Shingles of the sets that one cell holds, about.
CELL_SHINGLES = 8_000_000
_U = np.uint64


def text_sets(hasher: WordHasher, column: pa.Array, width: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending."""
    words, counts = hasher.words(*texts_of(column))
    made, per = shingles(words, counts, width)
    return [np.unique(x) for x in np.split(made, np.cumsum(per)[:-1])] if len(per) else []


def set_hash(values: np.ndarray) -> int:
    """Signed 64-bit hash of a set; with the set's size it stands for the set."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(values ^ _U(0x5851F42D4C957F2D)), dtype=np.uint64) + _U(len(values))
    return int(mix(np.array([total], dtype=np.uint64)).astype(np.int64)[0])


def sets_of(df: DataFrame, width: int) -> DataFrame:
    """doc_id, set_id, n, counts of each row; counts are by hash range, one byte each, at most 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in sliced(batches, "text"):
            sets = text_sets(hasher, batch.column("text"), width)
            counts = [np.minimum(np.bincount((s >> _U(58)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(counts, pa.binary())], ["doc_id", "set_id", "n", "counts"])

    return df.mapInArrow(run, "doc_id long, set_id long, n long, counts binary")


def frequent(df: DataFrame, width: int, most: int = MOST_FREQUENT) -> np.ndarray:
    """Shingles that are frequent in the corpus, ascending; at most `most` of them (the most frequent).

    They steer the order only, so that approximate counts do: each window of COUNT_BYTES of text reports shingles
    that LEAST_COUNT of its different sets hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def report() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= LEAST_COUNT
            return pa.RecordBatch.from_arrays([pa.array(values[keep].astype(np.int64)), pa.array(counts[keep].astype(np.int64))], ["token", "n"])

        for batch in sliced(batches, "text"):
            for s in text_sets(hasher, batch.column("text"), width):
                if len(s) and (h := set_hash(s)) not in seen:
                    seen.add(h)
                    held.append(s)
                    size += len(s)
            if size * 6 > COUNT_BYTES:
                yield report()
                held, size = [], 0
                seen.clear()
        if held:
            yield report()

    rows = store(df.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    least = kth_largest(rows, "n", most + 1)  # fewer than `most` lie above, all where there are no more
    top = (rows if least is None else rows.filter(F.col("n") > least)).select("token").toPandas()["token"]
    return np.sort(top.to_numpy(dtype=np.int64).astype(np.uint64))


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """Entries of a set of n shingles in the lists, and how many of them are leading.

    The first common shingle of a linked pair is a leading entry of the smaller set and an entry of the larger.
    """
    least_of_smaller = -(-n * percent // 100)  # overlap with any set it links to
    least_of_larger = -(-2 * n * percent // (100 + percent))  # overlap with a set that is no smaller
    return n - least_of_smaller + 1, n - least_of_larger + 1


def postings(df: DataFrame, width: int, percent: int, last: np.ndarray) -> DataFrame:
    """token, set_id, n, leading: the inverted lists."""
    handle = df.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, late = WordHasher(), handle.value
        for batch in sliced(batches, "text"):
            seen: set[tuple[int, int]] = set()
            tokens, ids, sizes, leads = [], [], [], []
            sets = text_sets(hasher, batch.column("text"), width)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            if len(late) and len(flat):
                at = np.minimum(np.searchsorted(late, flat), len(late) - 1)
                is_late = late[at] == flat
            else:
                is_late = np.zeros(len(flat), dtype=bool)
            end = 0
            for s in sets:
                begin, end = end, end + len(s)
                if not len(s) or (key := (set_hash(s), len(s))) in seen:
                    continue
                seen.add(key)
                entries, lead = prefix_lengths(len(s), percent)
                flag = is_late[begin:end]
                early = s[~flag][:entries]
                tokens.append(early if len(early) == entries else np.concatenate([early, s[flag][: entries - len(early)]]))
                ids.append(np.full(entries, key[0], dtype=np.int64))
                sizes.append(np.full(entries, len(s), dtype=np.int32))
                leads.append(np.arange(entries) < lead)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).astype(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(leads))], ["token", "set_id", "n", "leading"])

    return df.mapInArrow(run, "token long, set_id long, n int, leading boolean")


def pivots(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct (pivot_id, pivot_n, set_id, n): which sets meet at which pivot, among them each pivot itself.

    A list is read in ascending size, leading entries first. It falls into blocks where the size jumps beyond what
    can link. An entry of the rest is skipped unless a leading entry before it is large enough. The first entry
    that is not skipped is the block's pivot, so a list streams through its task whatever its length.
    """
    dealt = lists.repartition(parts(lists), "token").sortWithinPartitions("token", "n", F.desc("leading"), "set_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the last entry: token, size; of the open block: size of the last leading entry, pivot
        token, size, lead, pivot = None, 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            t, i, n, leads = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "set_id", "n", "leading"))
            n = n.astype(np.int64)
            new = np.ones(len(t), dtype=bool)
            new[1:] = (t[1:] != t[:-1]) | (100 * n[:-1] < percent * n[1:])
            new[0] = t[0] != token or 100 * size < percent * n[0]
            block = np.cumsum(new)  # 0: the block that was open
            first = np.searchsorted(block, block)
            last_lead = np.maximum.accumulate(np.where(leads, np.arange(len(t)), -1))
            lead_n = np.where(last_lead >= first, n[last_lead], np.where(block == 0, lead, 0))
            keep = leads | (100 * lead_n >= percent * n)
            at = np.flatnonzero(keep)
            pivot_id, pivot_n = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            head = np.searchsorted(block[at], block[at])
            pivot_id[:], pivot_n[:] = i[at][head], n[at][head]
            if pivot is not None:
                pivot_id[block[at] == 0], pivot_n[block[at] == 0] = pivot
            met = (pivot_id != i[at]) | (pivot_n != n[at])
            if met.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[met]) for x in (pivot_id, pivot_n, i[at], n[at])], ["pivot_id", "pivot_n", "set_id", "n"])
            open_ = block[at] == block[-1]
            pivot = (pivot_id[open_][0], pivot_n[open_][0]) if open_.any() else (pivot if block[-1] == 0 else None)
            token, size, lead = t[-1], n[-1], int(lead_n[-1])

    met = dealt.mapInArrow(run, "pivot_id long, pivot_n long, set_id long, n long").distinct()
    return met.unionByName(met.select("pivot_id", "pivot_n", F.col("pivot_id").alias("set_id"), F.col("pivot_n").alias("n")).distinct())


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


def group_links(sets: list[np.ndarray], pivot: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among sets (places in the list), through their differences from the pivot."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    deltas = [np.setxor1d(s, pivot, assume_unique=True) for s in sets]
    width = np.array([len(d) for d in deltas], dtype=np.int64)
    order = np.argsort(width, kind="stable")
    tokens, which = np.unique(np.concatenate([deltas[i] for i in order]) if n else np.zeros(0, np.uint64), return_inverse=True)
    # entries by token, in the order in which sets are taken
    owner = np.repeat(np.arange(n), width[order])
    by_token = np.argsort(which, kind="stable")
    entry_owner = owner[by_token]
    begin = np.searchsorted(which[by_token], np.arange(len(tokens)))
    reach = begin.copy()  # end of the entries of sets taken so far
    forest = Forest(n)
    ends = np.cumsum(width[order])
    w, m = width[order], sizes[order]
    for k in range(n):
        mine = which[ends[k] - w[k] : ends[k]]
        if k:
            length = reach[mine] - begin[mine]
            some = length > 0
            starts, length = begin[mine][some], length[some]
            total = int(length.sum())
            common = np.zeros(k, dtype=np.int64)
            if total:
                at = np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(total)
                common = np.bincount(entry_owner[at], minlength=k)
            apart = w[:k] + w[k] - 2 * common
            both = m[:k] + m[k]
            # 100 * intersection >= percent * union, both doubled
            for j in np.flatnonzero(100 * (both - apart) >= percent * (both + apart)).tolist():
                forest.join(k, j)
        reach[mine] += 1
    return [(int(order[k]), int(order[forest.root(k)])) for k in range(n) if forest.root(k) != k]


def in_cells(members: DataFrame, group_rows: int) -> DataFrame:
    """Members (pivot_id, pivot_n, set_id, n, ...) in cells (i, j): two of one pivot share a cell, the pivot is in all.

    A pivot with up to group_rows / 2 members and half of CELL_SHINGLES has one cell; of a larger one, each cell holds two blocks.
    """
    pivot = F.struct("pivot_id", "pivot_n")
    blocks = members.groupBy(pivot.alias("pivot")).agg(F.count("*").alias("members"), F.greatest(F.ceil(2 * F.count("*") / group_rows), F.ceil(2 * F.sum("n") / CELL_SHINGLES)).cast("int").alias("k"))
    is_pivot = (F.col("set_id") == F.col("pivot_id")) & (F.col("n") == F.col("pivot_n"))
    mine = F.pmod(F.xxhash64("set_id"), F.col("k")).cast("int")
    numbers = F.sequence(F.lit(0), F.col("k") - 1)
    every = F.flatten(F.transform(numbers, lambda i: F.transform(F.sequence(i, F.col("k") - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    own = F.transform(numbers, lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    known = hot_join(members.withColumn("pivot", pivot), blocks, "pivot", "members", members.count())
    spread = known.withColumn("is_pivot", is_pivot).withColumn("cell", F.explode(F.when(is_pivot, every).otherwise(own)))
    return spread.select(*members.columns, "is_pivot", "cell.i", "cell.j")


CELL = ["pivot_id", "pivot_n", "i", "j"]


def tied(counts: np.ndarray, sizes: np.ndarray, percent: int) -> list[np.ndarray]:
    """Groups (places, two at least) of sets that chains of possible links tie together."""
    table = counts.astype(np.int16)
    left = np.arange(len(sizes))
    groups = []
    while len(left):
        group, front, left = [left[:1]], left[:1], left[1:]
        while len(front) and len(left):
            some, front = front[:16], front[16:]
            apart = np.abs(table[some][:, None, :] - table[left][None, :, :]).sum(axis=2, dtype=np.int64)
            a, b = sizes[some][:, None], sizes[left][None, :]
            ok = ((100 + percent) * apart <= (100 - percent) * (a + b)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
            hit = ok.any(axis=0)
            group.append(left[hit])
            front = np.concatenate([front, left[hit]])
            left = left[~hit]
        if sum(map(len, group)) > 1:
            groups.append(np.concatenate(group))
    return groups


def heads(pairs: DataFrame, sets: DataFrame, percent: int, group_rows: int) -> DataFrame:
    """Members (pivot_id, pivot_n, set_id, n, rep) that may link, the head of their tied group being the new pivot."""
    reps = sets.groupBy("set_id", "n").agg(F.min("doc_id").alias("rep"), F.first("counts").alias("counts"))
    rows = in_cells(pairs, group_rows).join(reps, ["set_id", "n"])
    dealt = rows.repartition(parts(pairs), *CELL).sortWithinPartitions(*CELL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            counts = np.frombuffer(b"".join(h[3] for h in held), dtype=np.uint8).reshape(-1, RANGES)
            for group in tied(counts, np.array([h[1] for h in held], dtype=np.int64), percent):
                some = [held[k] for k in group.tolist()]
                head = min(some)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(some), pa.int64()) for x in head[:2]] + [pa.array([h[k] for h in some], pa.int64()) for k in range(3)], ["pivot_id", "pivot_n", "set_id", "n", "rep"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*CELL, "set_id", "n", "rep", "counts")]
            for *now, set_id, n, rep, counts in zip(*columns, strict=True):
                if now != cell:
                    if len(held) > 1:
                        yield from finish()
                    cell, held = now, []
                held.append((set_id, n, rep, counts))
        if len(held) > 1:
            yield from finish()

    wanted = dealt.select(*CELL, "set_id", "n", "rep", "counts")
    return wanted.mapInArrow(run, "pivot_id long, pivot_n long, set_id long, n long, rep long").distinct()


def links(df: DataFrame, members: DataFrame, width: int, percent: int, group_rows: int) -> DataFrame:
    """Edges (a, b) between the first documents of different sets."""
    wanted = in_cells(members, group_rows).select(F.col("rep").alias("doc_id"), "set_id", "is_pivot", *CELL)
    # texts are smaller than sets, so texts travel, compressed, and sets are made where they are compared
    some = packed(maybe_in(df, members.select(F.col("rep").alias("doc_id")), "doc_id"))
    dealt = some.join(wanted, "doc_id").repartition(parts(df), *CELL).sortWithinPartitions(*CELL, F.desc("is_pivot"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        cell, pivot, held, reps = None, None, [], []

        def finish() -> pa.RecordBatch:
            found = group_links(held, held[0] if pivot is None else pivot, percent)
            return pa.RecordBatch.from_arrays([pa.array([reps[a] for a, _ in found], pa.int64()), pa.array([reps[b] for _, b in found], pa.int64())], ["a", "b"])

        for batch in unpacked(batches):
            found = text_sets(hasher, batch.column("text"), width)
            columns = [batch.column(c).to_pylist() for c in (*CELL, "is_pivot", "doc_id", "set_id")]
            for (*now, first, rep, set_id), values in zip(zip(*columns, strict=True), found, strict=True):
                if now != cell:
                    if len(held) > 1:
                        yield finish()
                    cell, pivot, held, reps = now, None, [], []
                if set_hash(values) != set_id:
                    continue  # an id may stand for several texts
                if first:
                    pivot = values
                held.append(values)
                reps.append(rep)
        if len(held) > 1:
            yield finish()

    return dealt.select("doc_id", "text", "set_id", "is_pivot", *CELL).mapInArrow(compare, "a long, b long")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90, group_rows: int = 8_000) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    docs = ids_and_text(df, id_col, text_col)
    sets = store(sets_of(docs, width))
    linked = docs.filter("doc_id is not null")
    pairs = store(pivots(postings(linked, width, percent, frequent(linked, width)), percent))
    first = sets.filter("doc_id is not null and n > 0").groupBy("set_id", "n").agg(F.min("doc_id").alias("rep"))
    members = store(heads(pairs, sets.filter("doc_id is not null"), percent, group_rows))
    edges = links(linked, members, width, percent, group_rows)
    found = components(edges)
    named = first.join(found, F.col("rep") == F.col("node"), "left").select("set_id", "n", F.coalesce("component", "rep").alias("component"))
    out = sets.drop("counts").join(named, ["set_id", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_first(df: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """The rows of `df` (with doc_id and text) without those that link to a smaller id; all columns stay.

    Of repeated ids the rows stay or go together.
    """
    gone = f"gone_{uuid.uuid4().hex}"  # no name of the table's
    drop = jaccard_components(df, width=width, percent=percent).filter("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return df.join(drop, F.col("doc_id") == F.col(gone), "left_anti")
