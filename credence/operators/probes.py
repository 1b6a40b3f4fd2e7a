"""Leak probes: cross-validated models of many groups, folds and shuffled targets, fitted at once.

A probe predicts a target from features that should not tell it. Its lift is its cross-validated accuracy
over the share of the most common target. Two models can be asked: a logistic regression on all
features, and gradient-boosted trees on the most frequent ones, which see features act together.

Rows of a group with the same features and fold are one cell with the number of rows of each target, a
vector over all shuffles of the targets. Cells are stored packed, some thousands of a group in a row of
arrays, in as many parts as their rows and shuffles are worth. All models of all groups are then fitted side by side: a step
(a level of one tree of every model, or one gradient of every model) is one pass over the cells, whose
partial sums are added up where the cells are and then by group and block of shuffles. Rows never leave
the executors; the driver sees splits and weights, whose number does not depend on the rows.

Shuffled targets keep their counts and move no row: the targets of a group, sorted, fill its places in
turn, and a shuffle is a permutation of the places that can be computed from the place alone (the
swap-or-not permutation of Hoang, Morris and Rogaway). A row's place is its rank by digest, so a group
with most of the rows is ranked by many tasks.

Folds deal the places round. Ties of gains, margins and counts go to the first in order, after rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from credence.functions.draws import digest
from credence.operators.construction import LIFT_FAIL, LIFT_TEST, lift_gate
from credence.operators.sampling import seeded_rank
from credence.session import checkpointed, ship_code

MODELS = ("logistic", "boosting")
FOLDS, PERMUTATIONS = 5, 200
#: Columns that the trees see, the most frequent ones of the group.
COLUMNS = 256
#: Trees of a class, their levels, learning rate, least rows of a leaf, penalty of leaves.
ROUNDS, DEPTH, RATE, LEAST, PENALTY = 12, 2, 0.4, 20.0, 1.0
#: Gradients of the logistic regression, and its penalty (half the sum of squares).
STEPS, RIDGE = 30, 1.0
#: Shuffles of one block of sums; rows computed at a time; trees applied before margins are stored.
BLOCK, SLICE, KEEP = 25, 1024, 4
#: Rounds of the permutation, and cells a task holds before it sends them on.
SWAPS, HELD = 24, 20_000
#: Cells packed in a row, from and to, and the numbers that one array of them, and the sums of a task, may have.
FEWEST, PACKED, NUMBERS, SUMMED = 16, 4096, 1 << 20, 1 << 24
#: Rows times shuffles that are worth a task.
SHARE = 100_000


# --- shuffles ------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of unsigned numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def permuted(places: np.ndarray, n: int, shuffles: np.ndarray) -> np.ndarray:
    """``[shuffle, place]``: where each shuffle puts the places of 0 to n - 1; shuffle 0 moves nothing."""
    x = np.repeat(places[None, :].astype(np.int64), len(shuffles), axis=0)
    moved = np.asarray(shuffles, dtype=np.uint64)[:, None]
    for r in range(SWAPS):
        key = _mixed(_mixed(moved + np.uint64(1)) + np.uint64(r))
        other = ((key % np.uint64(n)).astype(np.int64) - x) % n
        swap = _mixed(np.maximum(x, other).astype(np.uint64) + key) >> np.uint64(63) == 1
        x = np.where(swap & (moved > 0), other, x)
    return x


# --- rows and cells ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Group:
    """What the driver knows of a group: one small record, whatever the rows."""

    n: int
    targets: tuple[str, ...]
    counts: tuple[int, ...]
    columns: int
    widest: int
    frequency: tuple[int, ...]

    @property
    def majority(self) -> float:
        return max(self.counts) / self.n


def prepared(rows: DataFrame, by: list[str], target: str, seed: str = "probe") -> tuple[DataFrame, dict[str, Group]]:
    """``(g, place, y, x)``: group, place, number of the target and numbers of the features (by frequency, then
    name), and the groups. ``rows`` has record_id and features; rows without target or key are left out."""
    g = F.concat_ws("/", *[F.col(c).cast("string") for c in by])
    keyed = rows.select(g.alias("g"), "record_id", F.array_distinct("features").alias("features"), F.col(target).cast("string").alias("t")).where("t is not null and record_id is not null")
    ranked = checkpointed(seeded_rank(keyed, ["g"], digest(f"{seed}:place", F.col("record_id")), "place").withColumn("place", F.col("place") - 1))
    from pyspark.sql import Window

    each = ranked.select("g", "place", F.explode("features").alias("feature"))
    order = Window.partitionBy("g").orderBy(F.desc("n"), "feature")  # as many rows as distinct features
    names = checkpointed(each.groupBy("g", "feature").agg(F.count("*").alias("n")).withColumn("j", (F.row_number().over(order) - 1)))
    counts = ranked.groupBy("g", "t").agg(F.count("*").alias("n")).orderBy("g", "t").collect()  # a row a group and target
    columns = {r["g"]: r["f"] for r in names.orderBy("g", "j").groupBy("g").agg(F.sort_array(F.collect_list(F.struct("j", "n"))).alias("f")).collect()}
    x = each.join(names.drop("n"), ["g", "feature"]).groupBy("g", "place").agg(F.sort_array(F.collect_list("j")).alias("x"))
    table = ranked.select("g", "place", "t").join(x, ["g", "place"], "left").withColumn("x", F.coalesce("x", F.array().cast("array<int>")))
    of: dict[str, list] = {}
    for r in counts:
        of.setdefault(r["g"], []).append((r["t"], r["n"]))
    numbers = [(g, t, y) for g, ts in of.items() for y, (t, _) in enumerate(ts)]
    numbered = F.broadcast(rows.sparkSession.createDataFrame(numbers, "g string, t string, y int"))
    table = checkpointed(table.join(numbered, ["g", "t"]).select("g", "place", "y", "x"))
    widest = {r["g"]: r["w"] for r in table.groupBy("g").agg(F.max(F.size("x")).alias("w")).collect()}
    groups = {}
    for name, ts in of.items():
        f = columns.get(name) or []
        groups[name] = Group(sum(n for _, n in ts), tuple(t for t, _ in ts), tuple(n for _, n in ts), len(f), widest[name], tuple(p["n"] for p in f))
    return table, groups


_CELL = pa.schema([("g", pa.string()), ("fold", pa.int32()), ("x", pa.binary()), ("counts", pa.binary())])
_PACK = pa.schema([("g", pa.string()), ("folds", pa.binary()), ("sizes", pa.binary()), ("x", pa.binary()), ("counts", pa.binary())])
_STATE = _PACK.append(pa.field("margins", pa.binary()))
_SUM = pa.schema([("g", pa.string()), ("block", pa.int32()), ("sums", pa.binary())])
_SPLIT = pa.schema([("g", pa.string()), ("block", pa.int32()), ("split", pa.binary()), ("value", pa.binary())])
_HIT = pa.schema([("g", pa.string()), ("b", pa.int32()), ("hits", pa.int64())])


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.types, strict=True)], schema=schema)


def _mapped(df: DataFrame, run: Callable, schema: pa.Schema) -> DataFrame:
    return df.mapInArrow(run, from_arrow_schema(schema))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists without nulls, one after the other, and where each list begins and the last ends."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy()[at[0] : at[-1]].astype(np.int32), at - at[0]


def _pack_size(group: Group, n_shuffles: int, columns: int | None, folds: int) -> int:
    width = group.columns if columns is None else min(group.columns, columns)
    return max(FEWEST, min(PACKED, NUMBERS // max(width + 1, n_shuffles * folds * len(group.targets))))


def cells(table: DataFrame, groups: dict[str, Group], shuffles: list[int], columns: int | None, folds: int = FOLDS) -> DataFrame:
    """Rows with the same features (of the first ``columns``) and fold as one, with ``counts`` of each shuffle
    and target. Equal cells meet by key after a partial sum where the rows are. A row of the result is
    many cells of one group: their folds, numbers of features and features, and ``[cell, shuffle, target]``."""
    b = np.asarray(shuffles)
    known = {name: (group.n, np.cumsum(group.counts)) for name, group in groups.items()}
    packed = {name: _pack_size(group, len(shuffles), columns, folds) for name, group in groups.items()}

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[dict, list]] = {}  # of a group: the number of each cell, and arrays of counts
        slots = np.arange(len(b))

        def summed() -> Iterator[pa.RecordBatch]:
            for g, (index, counts) in held.items():
                fold, x = zip(*index, strict=True)
                yield _batch([[g] * len(x), fold, x, [c.tobytes() for c in counts[0][: len(x)]]], _CELL)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                names = part.column(0).dictionary_encode()
                codes = names.indices.to_numpy()
                places, ys = (part.column(i).to_numpy() for i in (1, 2))
                values, begins = _lists(part.column(3))
                if columns is not None:
                    kept = values < columns
                    values, begins = values[kept], np.concatenate([[0], np.cumsum(kept)])[begins]
                raw, begins = values.tobytes(), (begins * 4).tolist()
                for code, g in enumerate(names.dictionary.to_pylist()):
                    some = np.flatnonzero(codes == code)
                    n, upto = known[g]
                    place = places[some].astype(np.int64)
                    labels = np.searchsorted(upto, permuted(place, n, b), side="right")
                    labels[b == 0] = ys[some]
                    if g not in held:
                        held[g] = {}, [np.zeros((SLICE, len(b), len(upto)), dtype=np.int64)]
                    index, counts = held[g]
                    mine = np.array([index.setdefault((f, raw[begins[i] : begins[i + 1]]), len(index)) for f, i in zip((place % folds).tolist(), some.tolist(), strict=True)])
                    if len(index) > len(counts[0]):
                        counts[0] = np.concatenate([counts[0], np.zeros_like(counts[0])])
                    np.add.at(counts[0], (mine[None, :], slots[:, None], labels), 1)
                if sum(len(index) for index, _ in held.values()) >= HELD:
                    yield from summed()
                    held.clear()
        yield from summed()

    def wholly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, out = None, None, []  # out: cells of one group

        def pack() -> pa.RecordBatch:
            _, fold, x, counts = zip(*out, strict=True)
            arrays = np.array(fold, dtype=np.int32), np.array([len(v) // 4 for v in x], dtype=np.int32)
            row = _batch([[now[0]], *[[v.tobytes()] for v in arrays], [b"".join(x)], [b"".join(c.tobytes() for c in counts)]], _PACK)
            out.clear()
            return row

        for batch in batches:
            for *key, c in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = np.frombuffer(c, dtype=np.int64)
                if key == now:
                    total = total + c
                    continue
                if now:
                    out.append((*now, total))
                    if key[0] != now[0] or len(out) >= packed[now[0]]:
                        yield pack()
                now, total = key, c
        if now:
            out.append((*now, total))
            yield pack()

    ship_code(table.sparkSession)
    part = _mapped(table.where(F.col("g").isin(*groups)), partly, _CELL)
    width = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = max(1, min(width, -(-sum(group.n for group in groups.values()) * len(b) // SHARE)))  # a pass has so many tasks
    return checkpointed(_mapped(part.repartition(width, "g", "fold", "x").sortWithinPartitions("g", "fold", "x"), wholly, _PACK))


# --- sums over cells ----------------------------------------------------------------------------------


def _pieces(batch: pa.RecordBatch, groups: dict[str, Group], n_shuffles: int, columns: int | None) -> Iterator[tuple]:
    """(group, folds, presence matrix, counts [shuffle, cell, target], margins [model, cell, target], row) of
    the cells of one row at a time."""
    for at in range(batch.num_rows):
        row = [c[at] for c in batch.columns]
        g, arrays = row[0].as_py(), [np.frombuffer(v.as_buffer(), dtype=t) if v.is_valid and len(v.as_buffer()) else np.zeros(0, dtype=t) for v, t in zip(row[1:], ("i4", "i4", "i4", "i8", "f8"), strict=False)]
        group, (fold, sizes, values, counts) = groups[g], arrays[:4]
        width = group.columns if columns is None else min(group.columns, columns)
        x = np.zeros((len(fold), width + 1))
        x[np.repeat(np.arange(len(fold)), sizes), values] = 1
        counts = counts.reshape(len(fold), n_shuffles, -1).transpose(1, 0, 2).astype(float)
        margins = arrays[4].reshape(len(fold), -1, counts.shape[2]).transpose(1, 0, 2) if len(arrays) > 4 and len(arrays[4]) else None
        yield g, fold, x, counts, margins, row


def _blocks(n: int) -> list[slice]:
    return [slice(a, min(a + BLOCK, n)) for a in range(0, n, BLOCK)]


def _trained(counts: np.ndarray, fold: np.ndarray, folds: int) -> np.ndarray:
    """``[model, cell, target]``: the rows a model is fitted on, models by shuffle and then fold."""
    inside = (fold[None, :] != np.arange(folds)[:, None]).astype(float)
    return (counts[:, None] * inside[None, :, :, None]).reshape(-1, *counts.shape[1:])


def _softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _summed(terms: Iterator[tuple[str, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The sum of each group and block where the cells are. They lie by group there, so one group is held at
    a time, and no more than ``SUMMED`` numbers of it."""
    held: dict[tuple, np.ndarray] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (g, block), sums in held.items():
            yield _batch([[g], [block], [sums.tobytes()]], _SUM)
        held.clear()

    for g, block, sums in terms:
        if (g, block) in held:
            held[g, block] += sums
            continue
        if held and (next(iter(held))[0] != g or sums.size * (len(held) + 1) > SUMMED):
            yield from sent()
        held[g, block] = sums
    yield from sent()


def _added_up(parts: DataFrame, then: Callable[[str, int, np.ndarray], list[bytes]], out: pa.Schema) -> list:
    """The sums of each group and block in one task each, and what ``then`` makes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for g, block, sums in zip(*batch.columns, strict=True):
                key, sums = (g.as_py(), block.as_py()), np.frombuffer(sums.as_buffer(), dtype=float)
                if key == now:
                    total = total + sums
                else:
                    if now:
                        yield _batch([[v] for v in (*now, *then(*now, total))], out)
                    now, total = key, sums.copy()
        if now:
            yield _batch([[v] for v in (*now, *then(*now, total))], out)

    return _mapped(parts.repartition("g", "block").sortWithinPartitions("g", "block"), run, out).collect()


def _hits(table: DataFrame, groups: dict[str, Group], shuffles: list[int], margins: Callable, columns: int | None, folds: int) -> DataFrame:
    """``(g, b, hits)``: rows whose target is the one with the greatest margin in the model not fitted on them."""
    blocks = _blocks(len(shuffles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, fold, x, counts, held, _ in _pieces(batch, groups, len(shuffles), columns):
                out = []
                for block, part in enumerate(blocks):
                    m = margins(g, block, x, held, part)  # [model, cell, target]
                    m = m.reshape(-1, folds, *m.shape[1:])[:, fold, np.arange(len(fold))]
                    best = np.argmax(np.round(m, 9), axis=-1)
                    hits = np.take_along_axis(counts[part], best[..., None], axis=-1).sum(axis=(1, 2))
                    out += [(g, shuffles[part.start + i], int(h)) for i, h in enumerate(hits)]
                yield _batch(list(zip(*out, strict=True)), _HIT)

    return _mapped(table, run, _HIT).groupBy("g", "b").agg(F.sum("hits").alias("hits"))


# --- boosted trees -------------------------------------------------------------------------------------


def _walked(levels: list[np.ndarray], x: np.ndarray, shape: tuple) -> np.ndarray:
    """``[model, cell, target]``: the nodes where cells are after some levels of splits ``[model, node, target]``."""
    node = np.zeros(shape, dtype=np.int64)
    cell = np.arange(shape[1])[None, :, None]
    for split in levels:
        feature = np.take_along_axis(split, node, axis=1)
        node = 2 * node + (x[cell, feature] > 0)  # -1, no split, is the column that no cell has
    return node


def _grown(trees: list[tuple], x: np.ndarray, shape: tuple) -> np.ndarray:
    out = np.zeros(shape)
    for levels, leaves in trees:
        out += np.take_along_axis(leaves, _walked(levels, x, shape), axis=1)
    return out


def best_splits(sums: np.ndarray, least: float, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """From sums ``[model, node, target, (gradient, curvature, rows), column]``, the last column all rows of
    the node: the split column (-1: none) and the values of both sides."""
    total, right = sums[..., -1:], sums[..., :-1]
    left = total - right
    score = lambda s: s[..., 0, :] ** 2 / (s[..., 1, :] + penalty)
    gain = np.round(score(left) + score(right) - score(total), 6)
    gain[(left[..., 2, :] < least) | (right[..., 2, :] < least)] = 0
    if not gain.shape[-1]:
        split = np.full(gain.shape[:-1], -1)
    else:
        split = np.where(gain.max(axis=-1) > 0, gain.argmax(axis=-1), -1)
    there = np.take_along_axis(sums, split[..., None, None] % sums.shape[-1], axis=-1)
    none = (split < 0)[..., None, None]
    sides = np.concatenate([np.where(none, total, total - there), np.where(none, 0, there)], axis=-1)
    return split, -sides[..., 0, :] / (sides[..., 1, :] + penalty)


def boosted(table: DataFrame, groups: dict[str, Group], shuffles: list[int], folds: int = FOLDS, rounds: int = ROUNDS, depth: int = DEPTH) -> DataFrame:
    """``(g, b, hits)`` of gradient-boosted trees, one a class and round, on cells of the first ``COLUMNS``."""
    spark, n_shuffles, blocks = table.sparkSession, len(shuffles), _blocks(len(shuffles))
    state = table.withColumn("margins", F.lit(None).cast("binary"))
    trees: dict[tuple, list] = {(g, k): [] for g in groups for k in range(len(blocks))}  # not yet in the margins

    def margins_of(known):
        def margins(g, block, x, held, part):
            shape = (part.stop - part.start) * folds, len(x), len(groups[g].targets)
            out = _grown(known[g, block], x, shape)
            if held is not None:
                out += held[part.start * folds : part.stop * folds]
            return out

        return margins

    for r in range(rounds):
        now: dict[tuple, list] = {key: [] for key in trees}
        leaves: dict[tuple, np.ndarray] = {}
        for level in range(depth):
            shared = spark.sparkContext.broadcast((trees, now))

            def terms(batches: Iterator[pa.RecordBatch], shared=shared, level=level) -> Iterator[tuple]:
                margins = margins_of(shared.value[0])
                for batch in batches:
                    for g, fold, x, counts, held, _ in _pieces(batch, groups, n_shuffles, COLUMNS):
                        for block, part in enumerate(blocks):
                            rows = _trained(counts[part], fold, folds)
                            p, many = _softmax(margins(g, block, x, held, part)), rows.sum(axis=-1, keepdims=True)
                            slopes = many * p - rows, many * p * (1 - p), np.broadcast_to(many, p.shape)
                            node = _walked(shared.value[1][g, block], x, p.shape)
                            sums = np.zeros((len(p), 2**level, p.shape[2], 3, x.shape[1]))
                            for j in range(2**level):
                                for k in range(p.shape[2]):
                                    here = node[:, :, k] == j
                                    for i, term in enumerate(slopes):
                                        own = term[:, :, k] * here
                                        sums[:, j, k, i, :-1] = own @ x[:, :-1]
                                        sums[:, j, k, i, -1] = own.sum(axis=1)
                            yield g, block, sums

            def partly(batches: Iterator[pa.RecordBatch], terms=terms) -> Iterator[pa.RecordBatch]:
                return _summed(terms(batches))

            def then(g: str, block: int, sums: np.ndarray, level=level) -> list[bytes]:
                width = min(groups[g].columns, COLUMNS) + 1
                split, value = best_splits(sums.reshape(-1, 2**level, len(groups[g].targets), 3, width), LEAST, PENALTY)
                return [split.astype(np.int64).tobytes(), (RATE * value).tobytes()]

            for row in _added_up(_mapped(state, partly, _SUM), then, _SPLIT):
                key, k = (row["g"], row["block"]), len(groups[row["g"]].targets)
                now[key].append(np.frombuffer(row["split"], dtype=np.int64).reshape(-1, 2**level, k))
                value = np.frombuffer(row["value"], dtype=float).reshape(-1, 2**level, k, 2)
                leaves[key] = value.transpose(0, 1, 3, 2).reshape(-1, 2 ** (level + 1), k)
        for key in trees:
            trees[key].append((now[key], leaves[key]))
        if (r + 1) % KEEP == 0 and r + 1 < rounds:
            shared = spark.sparkContext.broadcast(trees)

            def updated(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                margins = margins_of(shared.value)
                for batch in batches:
                    for g, _, x, _, held, row in _pieces(batch, groups, n_shuffles, COLUMNS):
                        each = np.concatenate([margins(g, k, x, held, part) for k, part in enumerate(blocks)])
                        yield _batch([[v] for v in (*row[:5], each.transpose(1, 0, 2).tobytes())], _STATE)

            state = checkpointed(_mapped(state, updated, _STATE))
            trees = {key: [] for key in trees}
    return _hits(state, groups, shuffles, margins_of(trees), COLUMNS, folds)


# --- logistic regression -------------------------------------------------------------------------------


def logistic(table: DataFrame, groups: dict[str, Group], shuffles: list[int], folds: int = FOLDS, steps: int = STEPS) -> DataFrame:
    """``(g, b, hits)`` of penalised multinomial regressions on all features and a constant, by accelerated
    gradients. A weight's step comes from its column's frequency and the most features of a row, which
    bound the curvature. The weights of a group are features times targets times models."""
    spark, blocks = table.sparkSession, _blocks(len(shuffles))
    keys = [(g, k) for g in groups for k in range(len(blocks))]
    zeros = {(g, k): np.zeros((groups[g].columns + 1, (blocks[k].stop - blocks[k].start) * folds, len(groups[g].targets))) for g, k in keys}
    weights, before = zeros, zeros
    pace = {g: 1 / (0.5 * (group.widest + 1) * np.array([*group.frequency, group.n]) + RIDGE) for g, group in groups.items()}

    def margins_of(known):
        def margins(g, block, x, held, part):
            w = known[g, block]
            out = np.einsum("cf,fmk->mck", x[:, :-1], w[:-1], optimize=True) if len(w) > 1 else np.zeros((w.shape[1], len(x), w.shape[2]))
            return out + w[-1][:, None, :]

        return margins

    for t in range(steps):
        ahead = {key: w + t / (t + 3) * (w - before[key]) for key, w in weights.items()}
        shared = spark.sparkContext.broadcast(ahead)

        def terms(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[tuple]:
            margins = margins_of(shared.value)
            for batch in batches:
                for g, fold, x, counts, held, _ in _pieces(batch, groups, len(shuffles), None):
                    for block, part in enumerate(blocks):
                        rows = _trained(counts[part], fold, folds)
                        off = rows.sum(axis=-1, keepdims=True) * _softmax(margins(g, block, x, held, part)) - rows
                        yield g, block, np.concatenate([np.einsum("cf,mck->fmk", x[:, :-1], off, optimize=True), off.sum(axis=1)[None]])

        def partly(batches: Iterator[pa.RecordBatch], terms=terms) -> Iterator[pa.RecordBatch]:
            return _summed(terms(batches))

        got = _added_up(_mapped(table, partly, _SUM), lambda g, block, sums: [sums.tobytes()], _SUM)
        slopes = {(r["g"], r["block"]): np.frombuffer(r["sums"], dtype=float).reshape(ahead[r["g"], r["block"]].shape) for r in got}
        before, weights = weights, {key: w - pace[key[0]][:, None, None] * (slopes[key] + RIDGE * w) for key, w in ahead.items()}
        shared.unpersist()
    return _hits(table, groups, shuffles, margins_of(weights), None, folds)


# --- the probes ----------------------------------------------------------------------------------------


def _lifts(spark: SparkSession, table: DataFrame, groups: dict[str, Group], models: tuple[str, ...], shuffles: list[int], folds: int) -> DataFrame:
    out, made = None, {}
    for model in models:
        fit, columns = (boosted, COLUMNS) if model == "boosting" else (logistic, None)
        if all(x.columns <= COLUMNS for x in groups.values()):
            columns = None  # the same cells for both models
        if columns not in made:
            made[columns] = cells(table, groups, shuffles, columns, folds)
        got = fit(made[columns], groups, shuffles, folds).withColumn("model", F.lit(model))
        out = got if out is None else out.unionByName(got)
    known = F.broadcast(spark.createDataFrame([(g, x.n, x.majority) for g, x in groups.items()], "g string, n long, majority double"))
    lifts = out.join(known, "g").withColumn("accuracy", F.col("hits") / F.col("n"))
    return lifts.select("g", "model", "b", "n", "majority", "accuracy", F.round(F.col("accuracy") - F.col("majority"), 9).alias("lift"))


def probe_lifts(rows: DataFrame, by: list[str], target: str, models: tuple[str, ...] = MODELS, folds: int = FOLDS, shuffles: list[int] | None = None, seed: str = "probe") -> DataFrame:
    """``(g, model, b, n, majority, accuracy, lift)`` of each group and shuffle; shuffle 0 is the targets as they are."""
    table, groups = prepared(rows, by, target, seed)
    return _lifts(rows.sparkSession, table, groups, models, shuffles or [0], folds)


def gated_probes(rows: DataFrame, by: list[str], target: str, models: tuple[str, ...] = MODELS, folds: int = FOLDS, permutations: int = PERMUTATIONS, min_n: int = 2, seed: str = "probe") -> DataFrame:
    """Lift of each group and model with the gate's verdict. Groups of fewer than ``min_n`` rows or one target
    are left out. Only lifts between the gate's two limits are held against ``permutations`` refits on
    shuffled targets: beyond the hard limit a probe fails without, and below the soft one it passes."""
    spark = rows.sparkSession
    table, groups = prepared(rows, by, target, seed)
    groups = {g: x for g, x in groups.items() if x.n >= min_n and len(x.targets) > 1}
    schema = "g string, model string, b int, n long, majority double, accuracy double, lift double"
    if not groups:
        return lift_gate(spark.createDataFrame([], schema), spark.createDataFrame([], schema), ["g", "model", "n", "majority", "accuracy"])
    seen = _lifts(spark, table, groups, models, [0], folds).collect()  # a row a group and model
    null = spark.createDataFrame([], schema)
    for model in models:
        flagged = {r["g"] for r in seen if r["model"] == model and LIFT_TEST < r["lift"] <= LIFT_FAIL}
        if flagged:
            null = null.unionByName(_lifts(spark, table, {g: groups[g] for g in flagged}, (model,), list(range(1, permutations + 1)), folds))
    found = spark.createDataFrame(seen, schema)
    gate = lift_gate(found, null, ["g", "model"])
    return found.drop("b", "lift").join(gate, ["g", "model"]).withColumn("p_value", F.when((F.col("lift") > LIFT_TEST) & (F.col("lift") <= LIFT_FAIL), F.col("p_value")))
