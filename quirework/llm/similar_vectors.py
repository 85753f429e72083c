"""The k most similar vectors of every vector, by shifted space-filling curves.

Vectors are projected onto their main axes (fitted on a bounded sample), turned
and shifted anew for each of several Hilbert curves, and range-partitioned by
their place on the curve. Every vector is compared with all those in the
windows before and after it: by their projections first, then the nearest of
them by all dimensions. The borders of the partitions come from the places of
the same sample, and the vectors about a quarter of a window beyond a border are
copied across it. The lists of all curves are merged. Vectors that a curve
tears apart are mostly joined by others between them: the merged lists are a
graph, in which the smallest number of a neighbourhood is handed on for some
rounds, and the vectors in the order of these numbers are one more curve, on
which they are compared once more. The lists of all are ranked by vectors of one
byte for each dimension, so that scores closer than that can change places.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.plans.storage import materialize

DIMENSIONS = 1024
K = 5
#: About so many vectors, chosen by the hash of their ids, are the sample that the main axes are fitted on.
SAMPLE = 4000
CURVES, AXES, TURNED, BITS = 4, 32, 16, 4
#: Vectors before and after each that it is compared with, at least, and as a share of all vectors: recall follows the share.
WINDOW, WINDOW_SHARE = 16_384, 1 / 400
#: Main axes by which a window is looked through, and how many of it are then compared by all dimensions.
LOOK_AXES, LOOKED_AT = 64, 32
#: Vectors that one task takes in at a time, and about how many a partition of a curve has (four windows at least).
CHUNK, ROWS_PER_TASK = 4096, 65_536
#: Part of a window that is copied across the borders of partitions.
REACH = 1 / 16
#: Scores that are held at a time.
SCORES = 1 << 22
#: Points of the sample that lie between two borders at least, which bounds the number of partitions.
POINTS_PER_PART = 4
#: Standard deviations that the curve's cube spans on either side.
SPREAD = 3.2
#: A vector is linked with those of its list whose score is at least so much of the best; rounds in which numbers are handed on along the links.
LINKED, ROUNDS = 0.6, 3
#: Vectors before and after each in the order of these numbers, and how many may have one number; more keep that of the first round.
LABEL_WINDOW, LABEL_MOST = 512, 4096
#: Vectors whose numbers travel at a time (eight bytes each), and about how many a task has in their order.
LABELS_SENT, LABELLED_ROWS = 1 << 22, 16_384
#: Columns of which the best is looked up first.
COLUMNS = 16

_POINT = "part int, key binary, own boolean, edit_id string, vector binary"
_NEAR = "edit_id string, others array<string>, scores array<float>"


def hilbert_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each cell (rows of coordinates below 2**bits)."""
    x = cells.astype(np.uint32).T.copy()
    side = 1 << (bits - 1)
    while side > 1:  # undo the turns of the larger cubes
        below = np.uint32(side - 1)
        for axis in range(len(x)):
            inverted = (x[axis] & side) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[axis]) & below).astype(np.uint32)
            x[0] = np.where(inverted, x[0] ^ below, x[0] ^ swap)
            if axis:
                x[axis] ^= swap
        side >>= 1
    for axis in range(1, len(x)):  # Gray code over the axes
        x[axis] ^= x[axis - 1]
    turn, side = np.zeros(x.shape[1], dtype=np.uint32), 1 << (bits - 1)
    while side > 1:
        turn = np.where((x[-1] & side) != 0, turn ^ np.uint32(side - 1), turn).astype(np.uint32)
        side >>= 1
    x ^= turn
    place = np.zeros(x.shape[1], dtype=np.uint64)
    for bit in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            place = (place << np.uint64(1)) | ((x[axis] >> np.uint32(bit)) & np.uint32(1)).astype(np.uint64)
    return place


def _stacked(batch: pd.DataFrame) -> tuple[pd.Series, np.ndarray]:
    """edit_id and unit vector of the usable rows."""
    rows = np.stack(batch["embedding"].to_numpy()).astype(np.float32) if len(batch) else np.zeros((0, DIMENSIONS), np.float32)
    norms = np.linalg.norm(rows.astype(np.float64), axis=1)
    usable = np.isfinite(norms) & (norms > 0)
    return batch["edit_id"][usable], (rows[usable] / norms[usable, None]).astype(np.float32)


def main_axes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, main axes and the deviation along each, of the sampled unit vectors."""
    if not len(rows):
        return np.zeros(DIMENSIONS, np.float32), np.zeros((DIMENSIONS, LOOK_AXES), np.float32), np.ones(LOOK_AXES, np.float32)
    mean = rows.mean(axis=0)
    _, axes = np.linalg.eigh((rows - mean).T @ (rows - mean))
    axes = np.ascontiguousarray(axes[:, ::-1][:, :LOOK_AXES])
    return mean, axes, ((rows - mean) @ axes).std(axis=0)


def curve_shapes(deviations: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(turn, shift) of each curve; the turn also scales its axes to unit deviation."""
    shapes = []
    for curve in range(CURVES):
        draw = np.random.default_rng(100 + curve)
        turn = np.linalg.qr(draw.normal(size=(AXES, AXES)))[0][:, :TURNED]
        scale = np.sqrt((turn**2 * deviations[:, None] ** 2).sum(axis=0))
        shapes.append(((turn / np.maximum(scale, 1e-12)).astype(np.float32), draw.uniform(-0.5, 0.5, size=TURNED).astype(np.float32)))
    return shapes


def _keys(places: np.ndarray, ids: pd.Series) -> np.ndarray:
    """Place and a hash of the id, as bytes in their order: a cell that many vectors share can be cut too."""
    salts = np.array([xxhash.xxh64_intdigest(i) for i in ids], dtype=np.uint64)
    return np.stack([places, salts], axis=1).astype(">u8").view("S16").ravel()


class Curve:
    """One Hilbert curve, with the borders of its partitions and how far beyond them vectors are copied."""

    def __init__(self, turn: np.ndarray, shift: np.ndarray) -> None:
        self.turn, self.shift = turn, shift
        self.borders = self.below = self.above = np.zeros(0, "S16")

    def keys(self, projected: np.ndarray, ids: pd.Series) -> np.ndarray:
        cells = (projected @ self.turn + self.shift + SPREAD) / (2 * SPREAD) * (1 << BITS)
        return _keys(hilbert_places(np.clip(cells, 0, (1 << BITS) - 1), BITS), ids)

    def cut(self, sample: np.ndarray, parts: int, reach: float) -> None:
        """Borders at the quantiles of the sample's keys; ``reach`` is a window's length in points of the sample."""
        points = [int.from_bytes(key.ljust(16, b"\0"), "big") for key in np.sort(sample).tolist()]

        def at(place: float) -> bytes:
            place = min(max(place, 0.0), len(points) - 1.0)
            low = int(place)
            step = points[min(low + 1, len(points) - 1)] - points[low]
            return (points[low] + int((place - low) * (1 << 32)) * step // (1 << 32)).to_bytes(16, "big")

        middles = [len(points) * part / parts for part in range(1, parts)]
        self.borders, self.below, self.above = (np.array([at(m + d) for m in middles], "S16") for d in (0, -reach, reach))

    def parts(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(rows, their partitions, whether they are its own) of the keys: own rows, then the copies for the next and the last partition."""
        part = np.searchsorted(self.borders, keys, side="right")
        yield np.arange(len(keys)), part, True
        for edges, border, step in ((self.below, part, 1), (self.above, part - 1, -1)):
            inner = np.flatnonzero((border >= 0) & (border < len(self.borders)))
            near = keys[inner] >= edges[border[inner]] if step > 0 else keys[inner] < edges[border[inner]]
            yield inner[near], part[inner[near]] + step, False


def _sample(vectors: DataFrame, count: int) -> tuple[pd.Series, np.ndarray]:
    share = min(1.0, SAMPLE / max(count, 1))
    return _stacked(vectors.where(F.pmod(F.xxhash64("edit_id"), F.lit(1 << 32)) < int(share * (1 << 32))).toPandas())


def _coarse(rows: np.ndarray) -> np.ndarray:
    """Vectors with one byte for each dimension, as bytes."""
    return np.array([row.tobytes() for row in np.rint(rows * (127 / np.abs(rows).max(axis=1))[:, None]).astype(np.int8)], dtype=object)


def _lists(vectors: DataFrame, count: int, window: int, ids: pd.Series, rows: np.ndarray) -> DataFrame:
    """edit_id, others, scores: the nearest of every vector on each curve; ``ids`` and ``rows`` are the sample.

    Every vector goes, in one byte per dimension, to its partition of each curve
    and to those whose windows reach it.
    """
    mean, look_axes, deviations = main_axes(rows)
    axes = np.ascontiguousarray(look_axes[:, :AXES])
    parts = max(1, min(-(-count // max(ROWS_PER_TASK, 4 * window)), len(ids) // POINTS_PER_PART))
    curves = [Curve(*shape) for shape in curve_shapes(deviations[:AXES])]
    for curve in curves if len(ids) else ():
        curve.cut(curve.keys((rows - mean) @ axes, ids), parts, REACH * window * len(ids) / count)

    def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, rows = _stacked(batch)
            if not len(ids):
                continue
            names, packed = ids.to_numpy(), _coarse(rows)
            projected = (rows - mean) @ axes
            for n, curve in enumerate(curves):
                keys = curve.keys(projected, ids)
                whole = np.array([key.ljust(16, b"\0") for key in keys.tolist()], dtype=object)
                for at, part, own in curve.parts(keys):
                    if len(at):
                        yield pd.DataFrame({"part": (n * parts + part).astype(np.int32), "key": whole[at], "own": own, "edit_id": names[at], "vector": packed[at]})

    return _compared(vectors.mapInPandas(points, _POINT), len(curves) * parts, window, mean, look_axes)


def _compared(points: DataFrame, parts: int, window: int, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    return points.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", "edit_id").mapInArrow(_near(window, mean, axes), _NEAR)


def _merged(lists: DataFrame) -> DataFrame:
    """edit_id, others, scores: the K best of all lists of each vector."""
    pairs = lists.select("edit_id", F.arrays_zip("others", "scores").alias("near")).groupBy("edit_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    by_score = F.transform("near", lambda p: F.struct((-p["scores"]).alias("minus"), p["others"].alias("other_id")))
    # the same pair can differ in the last bit between curves: keep its first place in the order only
    ranked = pairs.select("edit_id", F.array_sort(by_score).alias("near"))
    others = F.slice(F.array_distinct(F.transform("near", lambda p: p["other_id"])), 1, K)
    best = ranked.select("edit_id", "near", others.alias("others"))
    return best.select("edit_id", "others", F.expr("transform(others, o -> -element_at(filter(near, p -> p.other_id = o), 1).minus)").alias("scores"))


def _node(column: str) -> Column:
    """Number of an id; two with one number only come to stand together."""
    return F.hash(column)


def neighbourhoods(merged: DataFrame) -> DataFrame:
    """node, label: the smallest number of each vector's neighbourhood in the graph of the lists."""
    near = F.filter(F.arrays_zip("others", "scores"), lambda p: p["scores"] >= LINKED * F.col("scores")[0])
    links = merged.select(_node("edit_id").alias("node"), F.explode(F.transform(near, lambda p: p["others"])).alias("other")).select("node", _node("other").alias("other"))
    both = links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other")))
    graph = both.groupBy("node").agg(F.collect_set("other").alias("others"))
    first = F.least("node", F.array_min("others"))
    graph = materialize(graph.select("node", "others", first.alias("first"), first.alias("label")))
    for _ in range(ROUNDS - 1):
        handed = graph.select(F.explode("others").alias("node"), "label").groupBy("node").agg(F.min("label").alias("handed"))
        graph = materialize(graph.join(handed, "node").select("node", "others", "first", F.least("label", "handed").alias("label")))
    many = F.count("*").over(Window.partitionBy("label")) > LABEL_MOST
    return graph.select("node", F.when(many, F.col("first")).otherwise(F.col("label")).alias("label"))


def _by_neighbourhood(vectors: DataFrame, count: int, labels: DataFrame, window: int, rows: np.ndarray) -> DataFrame:
    """edit_id, others, scores: the nearest of every vector in the order of the labels; ``rows`` are the sample.

    The labels of LABELS_SENT vectors at a time travel as a table; each such
    block is one pass over the vectors that it has the labels of.
    """
    mean, axes, _ = main_axes(rows)
    parts, blocks = max(1, -(-count // LABELLED_ROWS)), max(1, -(-count // LABELS_SENT))
    labels = materialize(labels)
    numbered = vectors.withColumn("node", _node("edit_id"))
    block_of = F.pmod(F.col("node"), F.lit(blocks))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"part": [np.stack([batch["node"].to_numpy(np.int32), batch["label"].to_numpy(np.int32)]).tobytes()]})

    def block(n: int) -> DataFrame:
        packed = labels.where(block_of == n).select("node", "label").mapInPandas(pack, "part binary").collect()
        table = np.concatenate([np.zeros((2, 0), np.int32), *(np.frombuffer(row.part, np.int32).reshape(2, -1) for row in packed)], axis=1)
        shared = vectors.sparkSession.sparkContext.broadcast(table[:, np.argsort(table[0], kind="stable")])

        def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            nodes, known = shared.value
            for batch in batches:
                ids, rows = _stacked(batch)
                if not len(ids):
                    continue
                own = batch["node"].loc[ids.index].to_numpy(np.int32)
                if len(nodes):
                    at = np.minimum(np.searchsorted(nodes, own), len(nodes) - 1)
                    own = np.where(nodes[at] == own, known[at], own)
                keys = own.astype(">i4")
                part = (pd.util.hash_array(own) % np.uint64(parts)).astype(np.int32)
                yield pd.DataFrame({"part": part, "key": [key.tobytes() for key in keys], "own": True, "edit_id": ids.to_numpy(), "vector": _coarse(rows)})

        return numbered.where(block_of == n).select("edit_id", "embedding", "node").mapInPandas(points, _POINT)

    return _compared(functools.reduce(DataFrame.unionByName, map(block, range(blocks))), parts, window, mean, axes)


class Strip:
    """Points of a partition in their order on the curve, as far as the window has come."""

    def __init__(self) -> None:
        self.ids, self.own = np.zeros(0, dtype=object), np.zeros(0, dtype=bool)
        self.rows, self.norms = np.zeros((0, DIMENSIONS), np.int8), np.zeros(0, np.float32)
        self.looks = np.zeros((0, LOOK_AXES), np.float32)

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.ids, self.own, self.rows, self.norms, self.looks

    def take(self, *more: np.ndarray) -> None:
        self.ids, self.own, self.rows, self.norms, self.looks = (np.concatenate(both) for both in zip(self.parts(), more))

    def drop(self, n: int) -> None:
        self.ids, self.own, self.rows, self.norms, self.looks = (part[n:] for part in self.parts())

    def cosines(self, of: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Cosine of each row with each of its others."""
        result = np.empty(others.shape, np.float32)
        for start in range(0, len(of), 32):
            some = slice(start, start + 32)
            mine = self.rows[of[some]].astype(np.float32)[:, :, None]
            dots = (self.rows[others[some]].astype(np.float32) @ mine)[:, :, 0]
            result[some] = dots / (self.norms[of[some], None] * self.norms[others[some]])
        return result

    def ranked(self, first: int, last: int, window: int) -> Iterator[tuple[str, list[str], list[float]]]:
        """The K nearest of each own row of rows first..last-1 among the windows around them."""
        squares = (self.looks**2).sum(axis=1)
        block = max(16, min(512, SCORES // (2 * window)))
        for start in range(first, last, block):
            stop = min(start + block, last)
            own = np.flatnonzero(self.own[start:stop]) + start
            low, high = max(0, start - window), min(len(self.ids), stop + window)
            few = min(LOOKED_AT, high - low - 1)
            if not len(own) or few <= 0:
                continue
            near = 2 * (self.looks[own] @ self.looks[low:high].T) - squares[low:high]
            near[np.arange(len(own)), own - low] = -np.inf
            best = _largest(near, few) + low
            for i, others, scores in zip(own, best, self.cosines(own, best)):
                top = sorted(zip((-scores).tolist(), self.ids[others].tolist()))[:K]
                yield self.ids[i], [other for _, other in top], [-score for score, _ in top]


def _largest(values: np.ndarray, few: int) -> np.ndarray:
    """Columns of the largest of each row. They stand where the largest of every COLUMNS values are among the largest of these."""
    n, width = values.shape
    groups = width // COLUMNS
    if groups <= 2 * few:
        return np.argpartition(values, -few, axis=1)[:, -few:]
    best = np.argpartition(values[:, : groups * COLUMNS].reshape(n, COLUMNS, groups).max(axis=1), -few, axis=1)[:, -few:]
    rest = np.broadcast_to(np.arange(groups * COLUMNS, width), (n, width - groups * COLUMNS))
    columns = np.concatenate([(best[:, None, :] + groups * np.arange(COLUMNS)[:, None]).reshape(n, -1), rest], axis=1)
    return np.take_along_axis(columns, np.argpartition(np.take_along_axis(values, columns, axis=1), -few, axis=1)[:, -few:], axis=1)


def _near(window: int, mean: np.ndarray, axes: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams sorted points through a sliding window, one partition of a curve after the other."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip, done, current = Strip(), 0, None

        def flush(ahead: int) -> pa.RecordBatch | None:
            nonlocal done
            last = len(strip.ids) - ahead
            if last <= done:
                return None
            found = list(strip.ranked(done, last, window))
            kept = max(0, last - window)
            strip.drop(kept)
            done = last - kept
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.string())), pa.array([f[2] for f in found], pa.list_(pa.float32()))], ["edit_id", "others", "scores"]) if found else None

        for batch in batches:
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            keys = np.array(batch.column("edit_id").to_pylist(), dtype=object)
            owned = batch.column("own").to_numpy(zero_copy_only=False)
            vectors = batch.column("vector").to_pylist()
            for part in np.unique(parts):
                if part != current:
                    if (out := flush(0)) is not None:
                        yield out
                    strip, done, current = Strip(), 0, part
                these = np.flatnonzero(parts == part)
                before = np.concatenate([strip.ids[-1:], keys[these]])[-len(these) - 1 : -1] if len(strip.ids) else np.concatenate([[None], keys[these][:-1]])
                these = these[keys[these] != before]  # rows delivered twice are neighbours
                if len(these):
                    rows = np.frombuffer(b"".join(vectors[i] for i in these), dtype=np.int8).reshape(len(these), DIMENSIONS)
                    units = rows.astype(np.float32)
                    norms = np.linalg.norm(units, axis=1)
                    strip.take(keys[these], owned[these], rows, norms, (units / norms[:, None] - mean) @ axes)
                if len(strip.ids) - done >= CHUNK + window and (out := flush(window)) is not None:
                    yield out
        if (out := flush(0)) is not None:
            yield out

    return near


def _fingerprints(vectors: DataFrame) -> DataFrame:
    """edit_id and a hash of each usable vector's direction."""

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, rows = _stacked(batch)
            yield pd.DataFrame({"edit_id": ids.to_numpy(), "print": [xxhash.xxh3_128_hexdigest(row.tobytes()) for row in rows]})

    return vectors.mapInPandas(hashes, "edit_id string, print string")


def nearest_vectors(store: DataFrame, window: int | None = None) -> DataFrame:
    """edit_id, rank, other_id, score: the five most similar vectors of every usable vector.

    A vector is usable if it has 1024 elements, none of them null or NaN, that
    are not all zero. Equal scores are ranked by id; rows delivered twice are
    one; extra columns are ignored. Of more than six equal vectors only the six
    with the smallest ids are searched; the others have the first five of them,
    which no search could better, so that copies never crowd a window.
    ``window`` is how many vectors before and after it each is compared with on
    every curve; left out, it is WINDOW or a WINDOW_SHARE of the vectors, if more.
    """
    vectors = store.select("edit_id", "embedding").where("edit_id is not null and size(embedding) = 1024")
    prints = materialize(_fingerprints(vectors).distinct())
    order = Window.partitionBy("print").orderBy("edit_id")
    crowds = prints.groupBy("print").agg(F.count("*").alias("n")).where(F.col("n") > K + 1).select("print")
    followers = None
    if not crowds.isEmpty():
        crowded = prints.join(crowds, "print")
        leaders = materialize(crowded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K + 1))
        followers = materialize(crowded.join(leaders.select("edit_id"), "edit_id", "left_anti"))
        vectors = vectors.join(followers.select("edit_id"), "edit_id", "left_anti")
        first = leaders.where(F.col("rank") <= K).select("print", F.col("edit_id").alias("other_id"), "rank")
        copies = followers.join(first, "print").select("edit_id", "rank", "other_id", F.lit(1.0).cast("float").alias("score"))
    count = prints.count()
    window = window or max(WINDOW, int(count * WINDOW_SHARE))
    ids, rows = _sample(vectors, count)
    merged = materialize(_merged(_lists(vectors, count, window, ids, rows)))
    again = _by_neighbourhood(vectors, count, neighbourhoods(merged), min(window, LABEL_WINDOW), rows)
    best = _merged(merged.unionByName(again)).select("edit_id", F.posexplode(F.arrays_zip("others", "scores")).alias("rank", "near"))
    result = best.select("edit_id", (F.col("rank") + 1).alias("rank"), F.col("near.others").alias("other_id"), F.col("near.scores").alias("score"))
    return result if followers is None else result.unionByName(copies)


def found(store: DataFrame) -> DataFrame:
    """The pairs of which one is among the five most similar of the other."""
    pairs = nearest_vectors(store)
    return pairs.select(F.least("edit_id", "other_id").alias("edit_id_a"), F.greatest("edit_id", "other_id").alias("edit_id_b")).distinct()
