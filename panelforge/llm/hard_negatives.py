"""Hard negatives of anchor vectors by inner product, with a pivot table.

Every vector x gets one more component, sqrt(M^2 - |x|^2), where M is the largest norm; an
anchor gets 0 there.  Then |a - x|^2 = |a|^2 + M^2 - 2 a.x: the largest inner product is the
least distance.  The pivot table stores each row's distances to a few pivots (rows of a
bounded sample, far from one another); by the triangle inequality they bracket its distance
to every anchor, hence its score.  Rows are laid out by nearest pivot and distance to it, so a
block of rows has narrow brackets too: a block is tried first, then its rows one pivot after
another, and what may still count is checked exactly, in whole numbers.

Two passes over the table for each block of anchors: the first finds the positives, the
second, their scores known, the negatives inside each positive's window of scores.  A task
returns a few best rows an anchor, which are merged by anchor.  Nothing is paired by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm import shared

#: Components are floor(SCALE * x).
SCALE = 256
#: Pivots, the rows they are picked from, anchors that are sent to all tasks at a time, and rows of a block.
PIVOTS, SAMPLE, ANCHORS, BLOCK = 12, 1024, 16384, 2048
#: Anchors that one matrix of scores holds at a time.
STRIP = 512
_LOW = -(2**62)
_EMPTY = 2**63 - 1


def whole_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id, label, q`` (array<long>) of the rows that take part: a label and only finite components.

    Components beyond 2^40 are cut to it.
    """
    v = F.col(vector_col)
    fit = F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    q = F.transform(v, lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-float(2**40))), F.lit(float(2**40)))).cast("long"))
    return vectors.where(fit).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), q.alias("q"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Integer vectors as rows of a matrix; shorter ones end in zeros."""
    out = np.zeros((len(column), dims), dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows: by floating point where that is exact, else in 64-bit integers (which wrap beyond 2^63)."""
    if not len(a) or not len(b) or not a.shape[1]:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


@dataclass
class Pivots:
    """The pivots of a table: whole vectors, their last component, and the largest squared norm M^2."""

    q: np.ndarray
    last: np.ndarray
    most: float

    @classmethod
    def of(cls, sample: np.ndarray, most: float, n: int) -> Pivots:
        """Farthest-first among the rows of ``sample``."""
        last = np.sqrt(np.maximum(most - (sample.astype(float) ** 2).sum(axis=1), 0))
        x = np.column_stack([sample.astype(float), last])
        picked, near = [], np.full(len(x), np.inf)
        at = int(np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))) if len(x) else -1
        while at >= 0 and len(picked) < n:
            picked.append(at)
            near = np.minimum(near, ((x - x[at]) ** 2).sum(axis=1))
            at = int(near.argmax()) if near.max() > 0 else -1
        return cls(sample[picked], last[picked], most)

    def of_rows(self, q: np.ndarray) -> np.ndarray:
        """Distances of table rows to all pivots, one column a pivot."""
        x = q.astype(float)
        last = np.sqrt(np.maximum(self.most - (x**2).sum(axis=1), 0))
        return np.sqrt(np.maximum(2 * self.most - 2 * (x @ self.q.T.astype(float) + np.outer(last, self.last)), 0))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        x = q.astype(float)
        return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + self.most - 2 * (x @ self.q.T.astype(float)), 0))


def reach(squared: np.ndarray, most: float, score: np.ndarray) -> np.ndarray:
    """The distance at which an anchor of squared norm ``squared`` has ``score``; a little more, for rounding."""
    return np.sqrt(np.maximum(squared + most - 2 * score.astype(float), 0)) * (1 + 1e-9) + 1e-5 * np.sqrt(most + 1)


class Anchors:
    """A block of anchors inside a task: distances to pivots and squared norms."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, pivots: Pivots):
        self.ids, self.labels, self.q, self.pivots = ids, labels, q, pivots
        self.squared = (q.astype(float) ** 2).sum(axis=1)
        self.d = pivots.of_anchors(q)

    def candidates(self, d: np.ndarray, near: np.ndarray, far: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which (anchor, row) pairs can lie within ``near`` and not inside ``far``: brackets by one pivot after another.

        ``near``: the largest distance that counts; ``far``: the least one.  Pivots go on while they rule pairs out.
        """
        alive = np.ones((len(at), len(d)), dtype=bool)
        left = alive.size
        for p in range(d.shape[1]):
            a, x = self.d[at, p][:, None], d[:, p][None, :]
            alive &= (np.abs(a - x) <= near[:, None]) & (a + x >= far[:, None])
            now = int(alive.sum())
            if now > 0.98 * left and p >= 2 or not now:
                break
            left = now
        return alive

    def blocks(self, low: np.ndarray, high: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Anchors for which a block, whose rows are ``low`` to ``high`` away from each pivot, may hold a row that counts."""
        gap = np.maximum(np.maximum(low[None, :] - self.d, self.d - high[None, :]), 0).max(axis=1)
        return np.flatnonzero((gap <= near) & ((self.d + high[None, :]).min(axis=1) >= far))


def best(score: np.ndarray, ids: np.ndarray, fit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best (score, id) of each row of a matrix among those that ``fit``; columns come by rising id."""
    n = score.shape[1]
    value = np.where(fit, score, _LOW)
    k = min(k, n)
    if np.abs(score).max(initial=0) < 2**62 // max(n, 1) - n:  # score and place in one number, so ties go to the smaller id
        place = np.where(fit, value * n + (n - 1 - np.arange(n))[None, :], _LOW)
        part = np.argpartition(-place, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(score), 1))
        part = np.take_along_axis(part, np.argsort(-np.take_along_axis(place, part, axis=1), axis=1, kind="stable"), axis=1)
    else:
        part = np.argsort(-value, axis=1, kind="stable")[:, :k]
    got = np.take_along_axis(value, part, axis=1)
    return got, np.where(got == _LOW, _EMPTY, ids[part])


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    score, ids = np.concatenate([a[0], b[0]], axis=1), np.concatenate([a[1], b[1]], axis=1)
    part = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, part, axis=1), np.take_along_axis(ids, part, axis=1)


def empty(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, k), _LOW, dtype=np.int64), np.full((n, k), _EMPTY, dtype=np.int64)


def pivot_table(rows: DataFrame, pivots: Pivots, dims: int) -> DataFrame:
    """``block, low, high, ids, labels, q, d``: one row a block of rows, laid out by nearest pivot and distance to it.

    Ids and labels are little-endian 64-bit integers, ``q`` a matrix of such, ``d`` one of 64-bit floats; null ids are the largest.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = pivots.of_rows(matrix(batch.column(2), dims))
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=["id", "label", "q", "cell", "away"])

    laid = rows.mapInArrow(measured, "id long, label long, q array<bigint>, cell int, away double")
    # dealt by (cell, distance, id): a vector that many rows share is cut by id
    laid = shared.cut(laid).repartitionByRange(shared.partitions(rows.sparkSession), "cell", "away", "id").sortWithinPartitions("cell", "away", "id")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids = part.column(0).fill_null(_EMPTY - 1).to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                q = matrix(part.column(2), dims)[order]
                d = pivots.of_rows(q)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(d.min(axis=0)[None]), pa.list_(pa.float64())), pa.array(list(d.max(axis=0)[None]), pa.list_(pa.float64())), *(pa.array([x.tobytes()], pa.binary()) for x in (ids[order].astype("<i8"), part.column(1).to_numpy()[order].astype("<i8"), q.astype("<i8"), d))],
                    names=["low", "high", "ids", "labels", "q", "d"],
                )

    return shared.cut(laid.select("id", "label", "q").mapInArrow(packed, "low array<double>, high array<double>, ids binary, labels binary, q binary, d binary"))


def unpacked(batches: Iterator[pa.RecordBatch], dims: int, n_pivots: int):
    """The blocks of a pivot table: low, high, ids, labels, vectors, distances."""
    for batch in batches:
        for k in range(batch.num_rows):
            low, high = (batch.column(c)[k].values.to_numpy() for c in (0, 1))
            ids, labels, q, d = (memoryview(batch.column(c)[k].as_buffer()) for c in range(2, 6))
            yield low, high, np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), np.frombuffer(q, "<i8").reshape(-1, dims), np.frombuffer(d, float).reshape(-1, n_pivots)


def mine(vectors: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, relabel: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchors_at_a_time: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor``: condition over ``id`` that says which rows are anchors.  ``relabel``: labels to use instead, an expression
    over ``id`` and ``label``.  An anchor's positives are its ``positives`` best rows of its label; for each, the
    ``negatives`` best rows of another label whose score is ``least`` to ``most`` per cent of the positive's.
    Scores fall, ties go to the smaller id.

    Rows without a label or with a null or non-finite component take no part.  Repeated ids: every row counts, but
    none is a partner of an anchor of its own id; repeated rows give their candidates as often as they occur.
    Null ids are no anchors and come last in ties.  Vectors of unequal length end in zeros, empty ones score 0.
    Anchors without positives, positives without negatives and empty tables give no rows; other columns are not read.

    Each block of anchors (their bounded number, their vectors and few numbers each) is sent to all tasks; the table is
    stored once.  Memory is a block of rows by STRIP anchors.
    """
    rows = whole_vectors(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col)
    if relabel is not None:
        rows = rows.withColumn("label", relabel.cast("long"))
    spark = vectors.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    size = rows.agg(F.max(F.size("q")), F.max(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    if size[0] is None:
        return spark.createDataFrame([], result)
    dims = max(int(size[0]), 1)
    by_hash = [F.xxhash64("id", "label"), F.col("id")]
    sample = rows.orderBy(*by_hash).limit(SAMPLE).toArrow().combine_chunks()  # bounded; it places the pivots and gives first thresholds, no more
    sampled = (sample.column("id").combine_chunks().fill_null(_EMPTY - 1).to_numpy(zero_copy_only=False), sample.column("label").combine_chunks().to_numpy(zero_copy_only=False), matrix(sample.column("q").combine_chunks(), dims))
    pivots = Pivots.of(sampled[2], float(size[1]), PIVOTS)
    n_pivots = len(pivots.q)
    table = pivot_table(rows, pivots, dims)
    chosen = rows.where(is_anchor & F.col("id").isNotNull())
    every = shared.cut(chosen.withColumn("part", F.floor(F.pmod(F.xxhash64("id"), F.lit(1 << 40)))).select("part", "id", "label", "q"))
    total = every.count()
    cells = max(1, -(-total // anchors_at_a_time))
    out = None
    for cell in range(cells):
        # about so many of them: the hash of the id deals them out
        block = every.where((F.col("part") % cells) == cell).select("id", "label", "q").toArrow().combine_chunks()
        if not block.num_rows:
            continue
        own = tuple(block.column(c).combine_chunks() for c in ("id", "label", "q"))
        anchors = (own[0].to_numpy(zero_copy_only=False), own[1].to_numpy(zero_copy_only=False), matrix(own[2], dims))
        found = _mine_block(table, anchors, sampled, pivots, dims, n_pivots, positives, negatives, least, most)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], result)


def _mine_block(table, anchors, sampled, pivots, dims, n_pivots, positives, negatives, least, most) -> DataFrame:
    sc = table.sparkSession.sparkContext
    sent = sc.broadcast((*anchors, *sampled))  # a block of anchors and the sample: bounded by ANCHORS and SAMPLE

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best rows of each anchor's label among a task's blocks."""
        ids, labels, q, s_ids, s_labels, s_q = sent.value
        a = Anchors(ids, labels, q, pivots)
        top = empty(len(ids), positives)
        floor = np.full(len(ids), _LOW)  # what the sample's rows reach: the true rows are no worse
        for lo in range(0, len(ids), STRIP):
            at = slice(lo, lo + STRIP)
            fit = (labels[at, None] == s_labels[None, :]) & (ids[at, None] != s_ids[None, :])
            order = np.argsort(s_ids, kind="stable")
            floor[at] = empty_to(best(products(q[at], s_q[order]), s_ids[order], fit[:, order], positives)[0], positives)[:, -1]
        for low, high, r_ids, r_labels, r_q, r_d in unpacked(batches, dims, n_pivots):
            near = reach(a.squared, pivots.most, np.maximum(np.maximum(floor, top[0][:, -1]), _LOW // 2))
            far = np.zeros(len(ids))
            may = a.blocks(low, high, near, far)
            for lo in range(0, len(may), STRIP):
                at = may[lo : lo + STRIP]
                fit = (labels[at, None] == r_labels[None, :]) & (ids[at, None] != r_ids[None, :])
                fit &= a.candidates(r_d, near[at], far[at], at)
                if fit.any():
                    hit = best(products(q[at], r_q), r_ids, fit, positives)
                    top[0][at], top[1][at] = merged((top[0][at], top[1][at]), hit, positives)
        yield _rows(top, np.arange(len(ids)), None)

    schema = "anchor int, positive int, score array<bigint>, id array<bigint>"
    # a row an anchor and task: merged pairwise lists of a few entries
    best_of = table.mapInArrow(first, schema).groupBy("anchor").agg(F.flatten(F.collect_list(F.arrays_zip("score", "id"))).alias("all"))
    ranked = best_of.select("anchor", F.slice(F.array_sort("all", lambda x, y: _worse(x, y)), 1, positives).alias("top")).toArrow()
    n = len(anchors[0])
    pos = empty(n, positives)
    for k, row in zip(ranked.column("anchor").to_pylist(), ranked.column("top").to_pylist()):
        for j, hit in enumerate(row):
            pos[0][k, j], pos[1][k, j] = hit["score"], hit["id"]
    known = sc.broadcast(pos)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best rows of other labels in every positive's window among a task's blocks."""
        ids, labels, q, *_ = sent.value
        p_score, p_id = known.value
        a = Anchors(ids, labels, q, pivots)
        real = (p_id != _EMPTY) & (p_score >= 0)  # below 0 the window is empty
        under, over = -((-least * p_score) // 100), (most * p_score) // 100
        top = [empty(len(ids), negatives) for _ in range(positives)]
        some = real.any(axis=1)
        lowest = np.where(real, under, _EMPTY // 4).min(axis=1)
        highest = np.where(real, over, _LOW).max(axis=1)
        for low, high, r_ids, r_labels, r_q, r_d in unpacked(batches, dims, n_pivots):
            full = np.stack([np.where(real[:, j], np.maximum(under[:, j], top[j][0][:, -1]), _EMPTY // 4) for j in range(positives)], axis=1).min(axis=1)
            near = reach(a.squared, pivots.most, np.maximum(lowest, np.minimum(full, _EMPTY // 8)))
            far = np.maximum(np.sqrt(np.maximum(a.squared + pivots.most - 2 * np.maximum(highest, 0).astype(float), 0)) * (1 - 1e-9) - 1e-5 * np.sqrt(pivots.most + 1), 0)
            may = a.blocks(low, high, near, far)
            may = may[some[may]]
            for lo in range(0, len(may), STRIP):
                at = may[lo : lo + STRIP]
                fit = (labels[at, None] != r_labels[None, :]) & (ids[at, None] != r_ids[None, :])
                fit &= a.candidates(r_d, near[at], far[at], at)
                if not fit.any():
                    continue
                score = products(q[at], r_q)
                for j in range(positives):
                    inside = fit & (score >= np.maximum(under[at, j], top[j][0][at, -1])[:, None]) & (score <= over[at, j][:, None]) & real[at, j][:, None]
                    some_rows = np.flatnonzero(inside.any(axis=1))
                    if len(some_rows):
                        hit = best(score[some_rows], r_ids, inside[some_rows], negatives)
                        to = at[some_rows]
                        top[j][0][to], top[j][1][to] = merged((top[j][0][to], top[j][1][to]), hit, negatives)
        for j in range(positives):
            yield _rows(top[j], np.flatnonzero((top[j][1] != _EMPTY).any(axis=1)), j)

    windows = table.mapInArrow(second, schema).groupBy("anchor", "positive").agg(F.flatten(F.collect_list(F.arrays_zip("score", "id"))).alias("all"))
    windows = windows.select("anchor", "positive", F.posexplode(F.slice(F.array_sort("all", lambda x, y: _worse(x, y)), 1, negatives)).alias("k", "hit"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, (p_score, p_id) = sent.value[0], known.value
        for batch in batches:
            a, j = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(p_id[a, j], mask=p_id[a, j] == _EMPTY - 1), batch.column(2), batch.column(3), pa.array(p_score[a, j]), batch.column(4)], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    flat = windows.select("anchor", "positive", (F.col("k") + 1).cast("int").alias("rank"), F.nullif(F.col("hit.id"), F.lit(_EMPTY - 1)).alias("negative_id"), F.col("hit.score").alias("negative_score"))
    return flat.mapInArrow(named, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def empty_to(score: np.ndarray, k: int) -> np.ndarray:
    """Scores with so many columns that there are ``k``."""
    return score if score.shape[1] >= k else np.concatenate([score, np.full((len(score), k - score.shape[1]), _LOW)], axis=1)


def _worse(x: Column, y: Column) -> Column:
    """Order of hits: falling score, rising id."""
    return F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0)


def _rows(top: tuple[np.ndarray, np.ndarray], at: np.ndarray, j: int | None) -> pa.RecordBatch:
    """Lists of (score, id) of some anchors, without the empty ones."""
    held = top[1][at] != _EMPTY
    offs = np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(offs), pa.array(x[at][held])) for x in top]
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), j or 0, np.int32)), *lists], names=["anchor", "positive", "score", "id"])
