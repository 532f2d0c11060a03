"""Hard negatives of anchors: rows of other labels whose scores lie in a window below a positive's score.

A score is the inner product of whole-number vectors. An anchor's positives are its best rows of the same label; for
each, the negatives are the best rows of other labels with scores between two shares of the positive's.

Anchors are a stated query set, dealt into groups of similar ones (by the signs of their first components) of bounded
size; a minimum spanning tree joins the anchors of a group. Rows meet groups in cells of bounded size, one cell a task:
all rows at the first anchor, then along the tree. A score at a parent plus or minus the edge's length times the row's
norm bounds the score at the child; where the parent's own score is only bounded, the bounds widen. Only rows whose
bounds reach the child's windows, and the worst of what the cell already holds for them, are scored there. Cells give
the best few for each anchor (and positive), which one more step ranks; no step holds all rows of anything.

Copies: each row goes to each group of anchors (number of anchors / GROUP), each anchor to each chunk of rows.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part; of rows that
share an id the one with the smallest label, then vector, stands for all; a shorter vector counts as one with zeros;
an empty vector scores 0; ties go to the smaller id; an anchor without positives, or a positive without negatives in its
window (always so below zero), gives no row; scores beyond the range of long are cut to it; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import parts, store

#: Anchors of a group, about; twice as many at most.
GROUP = 2048
#: Rows of a cell, about: as many where all tasks have work, as few at least.
CELL_ROWS, LEAST_CELL_ROWS = 100_000, 1024
#: Rows that one NumPy step takes; it holds two bounds for each of them and each anchor of the group.
BLOCK_ROWS = 1024
#: Components whose signs deal the anchors.
SIGNS = 12
_LONG = (-(1 << 63), (1 << 63) - 1)


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; doubles beyond 2^52 are whole numbers already."""
    made = lambda x: x.cast("double") * F.lit(float(scale))
    return F.transform(vector, lambda x: F.when(F.abs(made(x)) < 2.0**52, F.floor(made(x)).cast("double")).otherwise(made(x)))


def rows_of(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, c (whole numbers) of the rows that take part, one for each id."""
    x = F.col(vector_col)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    some = df.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & F.coalesce(sound, F.lit(False)))
    some = some.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), whole(x).alias("c"))
    return some.groupBy("vec_id").agg(F.min(F.struct("label", "c")).alias("row")).select("vec_id", "row.label", "row.c")


def _grouped(anchors: DataFrame) -> tuple[DataFrame, int]:
    """Adds `group`, and gives the number of groups; collects one count for each pattern of signs (2^SIGNS at most)."""
    code = sum((F.coalesce(F.get("c", F.lit(k)) < 0, F.lit(False)).cast("int") * (1 << k) for k in range(SIGNS)), F.lit(0))
    coded = anchors.withColumn("code", code)
    deal, before = [], 0
    for r in sorted(coded.groupBy("code").count().collect()):
        n = -(-r["count"] // (2 * GROUP))
        deal.append((r["code"], before // GROUP, n))
        before += max(r["count"], (n - 1) * GROUP + 1)
    table = F.broadcast(anchors.sparkSession.createDataFrame(deal, "code int, first int, n int"))
    out = coded.join(table, "code").withColumn("group", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("n"))).cast("int"))
    return out.drop("code", "first", "n"), max((first + n for _, first, n in deal), default=0)


def _matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Vectors as rows, with zeros up to the longest (or to `width`)."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), max(width, int(lengths.max(initial=0)))))
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def _tree(key: tuple, table: pa.Table) -> pa.Table:
    """Minimum spanning tree of a group, grown from its first anchor; parents come before children."""
    a = _matrix(table.column("c"))
    n = len(a)
    near, parent = np.full(n, np.inf), np.full(n, -1)
    order, where, edges, parents = [], np.full(n, -1), [], []
    at = int(np.argmin(table.column("vec_id").to_numpy()))
    near[at] = 0.0
    for k in range(n):
        at = int(np.argmin(np.where(where < 0, near, np.inf)))
        where[at] = k
        order.append(at)
        edges.append(float(near[at]))
        parents.append(int(where[parent[at]]) if k else -1)
        far = np.sqrt(((a - a[at]) ** 2).sum(1))
        closer = (where < 0) & (far < near)
        near[closer], parent[closer] = far[closer], at
    some = table.select(["group", "vec_id", "label", "c"]).take(pa.array(order))
    for name, values, kind in (("place", range(n), pa.int32()), ("parent", parents, pa.int32()), ("edge", edges, pa.float64())):
        some = some.append_column(name, pa.array(list(values), kind))
    return some


def _sweep(rows: pa.Table, anchors: pa.Table, wanted: Callable, found: Callable) -> None:
    """For each block of rows and each anchor k: scores the rows that wanted(k, labels, low, high) marks, and tells found(k, ids, scores)."""
    width = max(pc.max(pc.list_value_length(t.column("c"))).as_py() or 0 for t in (rows, anchors))
    a = _matrix(anchors.column("c"), width)
    parent, edge = anchors.column("parent").to_numpy(), anchors.column("edge").to_numpy()
    for start in range(0, len(rows), BLOCK_ROWS):
        block = rows.slice(start, BLOCK_ROWS)
        c, ids, labels = _matrix(block.column("c"), width), block.column("vec_id").to_numpy(), block.column("label").to_numpy()
        exact = float(np.abs(a).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(width, 1) < 2.0**53
        # sums and roots are rounded; a part in 10^9 more than makes up for it
        norm = np.sqrt((c**2).sum(1)) * (1 + 1e-9) + 1e-9
        low, high = np.full((len(a), len(c)), -np.inf), np.full((len(a), len(c)), np.inf)
        for k in range(len(a)):
            if parent[k] >= 0 and exact:
                reach = edge[k] * (1 + 1e-9) * norm
                low[k], high[k] = low[parent[k]] - reach, high[parent[k]] + reach
            at = np.flatnonzero(wanted(k, labels, low[k], high[k]) if k and exact else np.ones(len(c), dtype=bool))
            if not len(at):
                continue
            if exact:
                scores = (c if len(at) == len(c) else c[at]) @ a[k]
                low[k][at] = high[k][at] = scores
                scores = scores.astype(np.int64)
            else:  # whole numbers of any size
                scores = np.array([min(max(sum(int(x) * int(y) for x, y in zip(v, a[k], strict=True)), _LONG[0]), _LONG[1]) for v in c[at]], dtype=np.int64)
            found(k, ids[at], labels[at], scores)


def _best(ids: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, ~scores))[:most]  # ~ turns the order around, for all longs
    return ids[order], scores[order]


class _Held:
    """The best few of each list, over blocks."""

    def __init__(self, n: int, most: int) -> None:
        self.most = most
        self.ids = [np.zeros(0, dtype=np.int64)] * n
        self.scores = [np.zeros(0, dtype=np.int64)] * n

    def worst(self, k: int) -> float:
        """A score below this cannot enter list k any more."""
        return float(self.scores[k][-1]) if len(self.ids[k]) == self.most else -np.inf

    def add(self, k: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(self.ids[k]) == self.most:
            keep = scores >= self.scores[k][-1]
            ids, scores = ids[keep], scores[keep]
        if len(ids):
            self.ids[k], self.scores[k] = _best(np.concatenate([self.ids[k], ids]), np.concatenate([self.scores[k], scores]), self.most)


def _positives(most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def cell(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        names, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        held = _Held(len(names), most)

        def found(k: int, ids: np.ndarray, other: np.ndarray, scores: np.ndarray) -> None:
            mine = (other == labels[k]) & (ids != names[k])
            held.add(k, ids[mine], scores[mine])

        _sweep(rows, anchors, lambda k, other, low, high: (other == labels[k]) & (high >= held.worst(k)), found)
        sizes = [len(x) for x in held.ids]
        return pa.table({"anchor_id": np.repeat(names, sizes), "positive_id": np.concatenate([*held.ids, np.zeros(0, np.int64)]), "score": np.concatenate([*held.scores, np.zeros(0, np.int64)])})

    return cell


def _negatives(most: int, percent: tuple[int, int]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def cell(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        names, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        windows: list[tuple[int, int, int, int, int]] = []  # anchor, positive, its score, bounds
        of: list[list[int]] = [[] for _ in names]
        for k, (ids, scores) in enumerate(zip(anchors.column("positives").to_pylist(), anchors.column("scores").to_pylist(), strict=True)):
            for i, s in zip(ids or [], scores or [], strict=True):
                if (least := -(-percent[0] * s // 100)) <= (greatest := percent[1] * s // 100):
                    of[k].append(len(windows))
                    windows.append((k, i, s, least, greatest))
        held = _Held(len(windows), most)

        def wanted(k: int, other: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            reached = np.zeros(len(other), dtype=bool)
            for w in of[k]:
                reached |= (high >= max(windows[w][3], held.worst(w))) & (low <= windows[w][4])
            return reached & (other != labels[k])

        def found(k: int, ids: np.ndarray, other: np.ndarray, scores: np.ndarray) -> None:
            for w in of[k]:
                inside = (scores >= windows[w][3]) & (scores <= windows[w][4]) & (other != labels[k])
                held.add(w, ids[inside], scores[inside])

        _sweep(rows, anchors, wanted, found)
        sizes = [len(x) for x in held.ids]
        each = lambda at: np.repeat(np.array([w[at] for w in windows], dtype=np.int64), sizes)
        return pa.table({"anchor_id": np.repeat(names[[w[0] for w in windows]] if windows else np.zeros(0, np.int64), sizes), "positive_id": each(1), "positive_score": each(2), "negative_id": np.concatenate([*held.ids, np.zeros(0, np.int64)]), "score": np.concatenate([*held.scores, np.zeros(0, np.int64)])})

    return cell


def mine(rows: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 10, percent: tuple[int, int] = (30, 90)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; `rows` as of `rows_of`, `anchors` marks the query set."""
    rows = store(rows)
    queries, groups = _grouped(rows.filter(anchors))
    trees = store(queries.groupBy("group").applyInArrow(_tree, "group int, vec_id bigint, label bigint, c array<double>, place int, parent int, edge double"))
    total = rows.count()
    chunks = max(1, -(-total // CELL_ROWS), min(parts(rows), -(-total // LEAST_CELL_ROWS)))
    chunk = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks)).cast("int")
    copies = rows.withColumn("chunk", chunk).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(max(groups - 1, 0)))))

    def cells(some: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        right = some.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return work(left, right.sort_by("place"))

        return copies.groupBy("group", "chunk").cogroup(right.groupBy("group", "chunk")).applyInArrow(run, schema)

    best = cells(trees, _positives(n_positives), "anchor_id bigint, positive_id bigint, score bigint")
    by_score = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    best = best.withColumn("r", F.row_number().over(by_score)).filter(F.col("r") <= n_positives)
    listed = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("r", "positive_id", "score"))).alias("p"))
    asked = store(trees.join(listed.select("vec_id", F.col("p.positive_id").alias("positives"), F.col("p.score").alias("scores")), "vec_id", "left"))
    some = cells(asked, _negatives(n_negatives, percent), "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, score bigint")
    by_score = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "negative_id")
    ranked = some.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))


#: The same result in DuckDB, by all scores.
ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.c, b.c) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, vec_id) AS rank, vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
