"""All pairs of labelled digests, block against block, by matrices.

Rows are dealt evenly into blocks, and a block is written once, as one row. The blocks' table is
joined with itself by reading it again (a Cartesian product of its files), so that no row is shuffled
or copied for a comparison, nothing is broadcast and two blocks are compared at a time.
``similarities`` returns the pairs themselves; ``histogram`` and ``means`` return sums of a block, so
that pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.session import materialize

#: Rows of one side of a comparison whose pairs are counted, and of one whose pairs are returned.
BLOCK, PAIRS_BLOCK = 4_096, 1_024
#: Rows compared in one step, so that its matrices stay in cache; rows for which more than one block is worth a task.
STEP, LEAST = 64, 256
#: Slots are compared one by one if more than one in so many would be equal.
DENSE = 16


@dataclass(frozen=True)
class Slots:
    """Equal slots of two signatures, none if either is all zeros; ValueError for different lengths."""

    def form(self, rows: np.ndarray) -> np.ndarray:
        return rows.astype(np.uint32) if rows.size and 0 <= rows.min() and rows.max() < 1 << 32 else rows

    def other(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Columns, which of these are all zeros, and for slots of 32 bits: slots with their place in order, where each begins, and whose they are."""
        y = np.ascontiguousarray(rows.T)
        if y.dtype != np.uint32:
            return y, ~y.any(0)
        key = self._placed(rows).ravel()
        order = np.argsort(key)
        key = key[order]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        return y, ~y.any(0), key[begin], np.r_[begin, len(key)], order // max(rows.shape[1], 1)

    def _placed(self, rows: np.ndarray) -> np.ndarray:
        return rows.astype(np.uint64) | (np.arange(rows.shape[1], dtype=np.uint64) << np.uint64(32))

    def compare(self, x: np.ndarray, other: tuple[np.ndarray, ...]) -> np.ndarray:
        y, zeros, *placed = other
        equal = self._by_place(x, y, *placed) if placed and placed[0].size else None
        if equal is None:
            equal = np.zeros((len(x), y.shape[1]), np.uint8 if len(y) < 256 else np.int64)
            for s in range(len(y)):
                equal += x[:, s, None] == y[s]
        equal[~x.any(1)] = 0
        equal[:, zeros] = 0
        return equal

    def _by_place(self, x: np.ndarray, y: np.ndarray, keys: np.ndarray, begin: np.ndarray, owner: np.ndarray) -> np.ndarray | None:
        """Equal slots by looking each one up, for few of them are equal; None if they are many."""
        own = self._placed(x).ravel()
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        met = np.flatnonzero(keys[at] == own)
        low = begin[at[met]]
        n = begin[at[met] + 1] - low
        total = int(n.sum())
        if total * DENSE > x.size * y.shape[1]:
            return None
        # each slot that is met makes n pairs, with the owners from ``low`` on
        owners = owner[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(total)]
        cells = np.repeat(met // x.shape[1] * y.shape[1], n) + owners
        return np.bincount(cells, minlength=len(x) * y.shape[1]).reshape(len(x), y.shape[1])

    def most(self, width: int) -> int:
        return width


@dataclass(frozen=True)
class Bits:
    """Equal bits of two rows of 64-bit words that are padded by zeros behind ``n_bits``."""

    n_bits: int

    def form(self, rows: np.ndarray) -> np.ndarray:
        packed = np.ascontiguousarray(rows.astype(np.int64)).view(np.uint8)
        return 2 * np.unpackbits(packed, axis=1).astype(np.float32) - 1

    def other(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows.T)

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        differ = (len(y) - (x @ y).astype(np.int32)) >> 1  # whole numbers, exact in single precision
        return self.n_bits - differ

    def most(self, width: int) -> int:
        return self.n_bits


@dataclass(frozen=True)
class Dot:
    """Dot products; sums run over dimensions in order, unless only their means are wanted."""

    in_order: bool = True

    def form(self, rows: np.ndarray) -> np.ndarray:
        return rows.astype(np.float64)

    def other(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows.T)

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not self.in_order:
            return x @ y
        sums = np.zeros((len(x), y.shape[1]))
        for d in range(len(y)):
            sums += x[:, d, None] * y[d]
        return sums

    def most(self, width: int) -> None:
        return None


Kernel = Slots | Bits | Dot


def _blocks(digests: DataFrame, block: int) -> DataFrame:
    """``place, rows``: ``id, label, digest`` of the rows of each block as an Arrow stream."""
    rows = materialize(digests.select("id", "label", "digest").where("id is not null"), "digests")
    n = rows.count()
    many = max(-(-n // block), min(8, -(-n // LEAST)), 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                for batch in held:
                    out.write_batch(batch)
            yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])

    packed = rows.repartition(many).mapInArrow(pack, "rows binary").select(F.spark_partition_id().alias("place"), "rows")
    return materialize(packed, "blocks")


def _by_blocks(digests: DataFrame, block: int, run: Callable[[pa.Table], Iterator[pa.Table]], schema: str) -> DataFrame:
    """What ``run`` returns for each pair of blocks, and for each block by itself: a table of ``id, label, digest, second``.

    Both orders of a pair are made by tasks of their own, so the sum of places tells which one is taken, and tasks have equal shares.
    """
    blocks = _blocks(digests, block)
    x, y = (blocks.select(F.col("place").alias(at), F.col("rows").alias(rows)) for at, rows in (("i", "x"), ("j", "y")))
    taken = (F.col("i") == F.col("j")) | ((F.col("i") < F.col("j")) == ((F.col("i") + F.col("j")) % 2 == 0))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, first, j, other in zip(*(batch.column(c) for c in ("i", "x", "j", "y")), strict=True):
                sides = [pa.ipc.open_stream(side.as_buffer()).read_all() for side in ([first] if i == j else [first, other])]
                table = pa.concat_tables(side.append_column("second", pa.array(np.full(len(side), bool(k)))) for k, side in enumerate(sides))
                for found in run(table):
                    yield from found.to_batches()

    return x.hint("shuffle_replicate_nl").join(y, taken).mapInArrow(compared, schema)


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of a column of arrays, padded by zeros, and the length of each; -1 for null and for arrays with a null."""
    column = column.combine_chunks()
    length = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, owner = column.flatten(), np.repeat(np.arange(len(length)), length)
    known = pc.is_null(column).to_numpy(zero_copy_only=False)
    size = np.where(known, -1, length)
    if flat.null_count:
        size[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
        flat = flat.fill_null(0)
    values, width = flat.to_numpy(zero_copy_only=False), int(length.max(initial=0))
    if (length == width).all():
        return values.reshape(len(length), width), size
    out = np.zeros((len(length), width), values.dtype)
    out[owner, np.arange(len(values)) - np.repeat(np.cumsum(length) - length, length)] = values
    return out, size


def _read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are of the second block, ids, labels as numbers, digests and their lengths."""
    label = pc.dictionary_encode(table.column("label").combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return table.column("second").to_numpy(), table.column("id").to_numpy(), label, *_numbers(table.column("digest"))


def _compared(table: pa.Table, kernel: Kernel) -> Iterator[tuple]:
    """For some rows of one block at a time: ids and those of the other, pairs to take (None: all), results, nulls (None: none), equal labels."""
    second, ids, label, rows, size = _read(table)
    if isinstance(kernel, Slots) and len(set(size[size >= 0].tolist())) > 1:
        raise ValueError("digests of different lengths")
    rows = kernel.form(rows)
    one = not second.any()
    x, y = (np.arange(len(ids)),) * 2 if one else (np.flatnonzero(~second), np.flatnonzero(second))
    right, plain = kernel.other(rows[y]), size.min() >= 0 and size.min() == size.max()
    repeated = not one and bool(np.isin(ids[x], ids[y]).any())
    for at in range(0, len(x), STEP):
        own = x[at : at + STEP]
        take = ids[own][:, None] < ids[y][None, :] if one else ids[own][:, None] != ids[y][None, :] if repeated else None
        null = None if plain else (size[own][:, None] != size[y][None, :]) | (size[own] < 0)[:, None]
        yield ids[own], ids[y], take, kernel.compare(rows[own], right), null, label[own][:, None] == label[y][None, :], kernel.most(rows.shape[1])


def _dot_sums(table: pa.Table) -> tuple[int, float, int, float] | None:
    """Pairs of different labels and the sum of their dot products, and those of equal labels, from sums of vectors by label.

    The dot products of all pairs of two sets add up to that of the sets' sums. None if a pair is to be left out.
    """
    second, ids, label, rows, size = _read(table)
    if size.min() < 0 or size.min() != size.max() or len(np.unique(ids)) < len(ids) or not np.isfinite(rows).all():
        return None
    sums, n = np.zeros((2, label.max() + 1, rows.shape[1])), np.zeros((2, label.max() + 1), np.int64)
    np.add.at(sums, (second.astype(int), label), rows)
    np.add.at(n, (second.astype(int), label), 1)
    (s, t), (p, q) = sums, n
    if second.any():
        intra, total = float((s * t).sum()), float(s.sum(0) @ t.sum(0))
        return int(p.sum() * q.sum() - (p * q).sum()), total - intra, int((p * q).sum()), intra
    own = float((rows * rows).sum())
    intra, total = (float((s * s).sum()) - own) / 2, (float(s.sum(0) @ s.sum(0)) - own) / 2
    n_intra = int((p * (p - 1) // 2).sum())
    return int(p.sum() * (p.sum() - 1) // 2) - n_intra, total - intra, n_intra, intra


def similarities(digests: DataFrame, kernel: Kernel) -> DataFrame:
    """``a, b, sim, is_intra`` of all unordered pairs of ``id, label, digest``; rows of one id make no pair, a null id none."""
    kind = digests.schema["id"].dataType.simpleString()

    def run(table: pa.Table) -> Iterator[pa.Table]:
        for left, right, take, found, null, intra, most in _compared(table, kernel):
            p, q = np.nonzero(np.ones(found.shape, bool) if take is None else take)
            a, b, sim = left[p], right[q], found[p, q]
            swap = a > b
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            sim = sim if most is None else sim / most if most else np.zeros(len(sim))
            yield pa.table({"a": pa.array(a, id_type), "b": pa.array(b, id_type), "sim": pa.array(sim, pa.float64(), mask=None if null is None else null[p, q]), "is_intra": pa.array(intra[p, q], pa.bool_())})

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(digests.schema["id"].dataType)
    return _by_blocks(digests, PAIRS_BLOCK, run, f"a {kind}, b {kind}, sim double, is_intra boolean")


def histogram(digests: DataFrame, kernel: Slots | Bits) -> DataFrame:
    """``sim, intra, inter``: all pairs by similarity, as ``evaluate.histogram`` counts them."""

    def run(table: pa.Table) -> Iterator[pa.Table]:
        counts, most = np.zeros((2, 1), np.int64), 0
        for _, _, take, found, null, intra, most in _compared(table, kernel):
            if len(counts[0]) != most + 2:
                counts = np.zeros((2, most + 2), np.int64)
            place = found.astype(np.int64)
            if null is not None:
                place[null] = most + 1
            place += intra * (most + 2)
            counts += np.bincount((place if take is None else place[take]).ravel(), minlength=2 * (most + 2)).reshape(2, -1)
        at = np.flatnonzero(counts.any(0))
        sim = pa.array(at / max(most, 1), pa.float64(), mask=at == most + 1)
        yield pa.table({"sim": sim, "intra": pa.array(counts[1, at]), "inter": pa.array(counts[0, at])})

    blocks = _by_blocks(digests, BLOCK, run, "sim double, intra long, inter long")
    return blocks.groupBy("sim").agg(F.sum("intra").alias("intra"), F.sum("inter").alias("inter"))


def means(digests: DataFrame, kernel: Kernel) -> DataFrame:
    """One row ``mean_intra, mean_inter``: mean similarities of pairs of equal and of different labels; null if there are none."""

    def run(table: pa.Table) -> Iterator[pa.Table]:
        if isinstance(kernel, Dot) and (quick := _dot_sums(table)) is not None:
            yield pa.table({"n_inter": [quick[0]], "inter": [quick[1]], "n_intra": [quick[2]], "intra": [quick[3]]})
            return
        n, total = [0, 0], [0.0, 0.0]
        for _, _, take, found, null, intra, most in _compared(table, kernel):
            found = found if most is None else found / max(most, 1)
            valid = np.ones(found.shape, bool) if take is None else take
            valid = valid if null is None else valid & ~null
            for k in (0, 1):
                chosen = valid & (intra == bool(k))
                n[k] += int(np.count_nonzero(chosen))
                part = float(found.ravel() @ chosen.ravel().astype(np.float64))  # much faster than to gather the chosen ones
                total[k] += part if np.isfinite(part) else float(found[chosen].sum())
        yield pa.table({"n_inter": [n[0]], "inter": [total[0]], "n_intra": [n[1]], "intra": [total[1]]})

    blocks = _by_blocks(digests, BLOCK, run, "n_inter long, inter double, n_intra long, intra double")
    mean: Callable = lambda kind: F.when(F.sum(f"n_{kind}") > 0, F.sum(kind) / F.sum(f"n_{kind}")).alias(f"mean_{kind}")
    return blocks.agg(mean("intra"), mean("inter"))
