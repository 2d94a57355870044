"""Null draws and what a value is worth against them."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.functions.scalars import N_JOINT
from dyadflow.operators import motifs

#: Symbols of drawn sequences that are worked on at once, and groups whose draws are compared at once.
CELLS, GROUPS = 1 << 16, 500


def shuffled(steps: DataFrame, by: tuple[str, ...], draws: int, x: str = "x", at: str = "at", seed: int = 0) -> DataFrame:
    """by, draw (from 0), at and x: each group's symbols in `draws` orders. An order is that of md5 over seed, group, draw and
    position, so any engine, partitioning or retry gives the same; base rates stay as they are. Groups are dealt once; the
    draws are made behind that, and what goes on by group and draw needs no other exchange."""
    group = F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in by), F.col("draw").cast("string"), F.col(at).cast("string"))
    d = steps.select(*by, at, x).repartition(*by).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    w = Window.partitionBy(*by, "draw")
    place = (F.row_number().over(w.orderBy(F.md5(group.cast("binary")), at)) - 1).cast("long")
    return d.withColumn(at, place + F.min(at).over(w))


def markov_surrogates(steps: DataFrame, by: tuple[str, ...], draws: int, x: str = "x", at: str = "at", seed: int = 0) -> DataFrame:
    """by, draw, at, x: chains of each group's length that start by its base rates and follow its transitions; a symbol that
    nothing follows is followed by any of the group's, all alike. The random numbers depend on seed, group and draw."""
    fields = ", ".join(f"`{c}` {steps.schema[c].dataType.simpleString()}" for c in by)
    kept = steps.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("i"), F.col(x).alias("v")))), lambda s: s["v"]).alias("__xs"), F.xxhash64(F.lit(seed), *by).alias("__h"))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                xs = np.asarray(row["__xs"])
                states, place = np.unique(xs, return_inverse=True)
                k, n = len(states), len(xs)
                follow = np.zeros((k, k))
                np.add.at(follow, (place[:-1], place[1:]), 1)
                follow[follow.sum(1) == 0] = 1
                ladder = np.cumsum(follow / follow.sum(1, keepdims=True), axis=1)
                base = np.cumsum(np.bincount(place, minlength=k) / n)
                u = np.random.default_rng(row["__h"] & (2**63 - 1)).random((n, draws))
                out = np.zeros((n, draws), np.int64)
                out[0] = np.minimum(np.searchsorted(base, u[0], "right"), k - 1)
                for i in range(1, n):  # all draws a step at a time
                    out[i] = np.minimum((u[i][:, None] >= ladder[out[i - 1]]).sum(1), k - 1)
                yield pd.DataFrame({**{c: row[c] for c in by}, "draw": np.tile(np.arange(draws), n), at: np.repeat(np.arange(n), draws), x: states[out.ravel()]})

    return kept.mapInPandas(each, f"{fields}, draw int, `{at}` long, `{x}` {steps.schema[x].dataType.simpleString()}")


def against_nulls(value: Column, null: Column) -> dict[str, Column]:
    """Aggregates over rows that hold a value and one draw each: z (population deviation, 0 where that is 0) and the empirical
    p-values above, below and two-sided; null without draws."""
    v, n = F.first(value), F.count(null)
    spread = F.stddev_pop(null)
    up = (1 + F.sum((null >= value).cast("int"))) / (n + 1)
    down = (1 + F.sum((null <= value).cast("int"))) / (n + 1)
    some = lambda c: F.when(n > 0, c)
    return {"z": some(F.when(spread > 1e-12, (v - F.avg(null)) / F.nullif(spread, F.lit(0.0))).otherwise(0.0)), "p_hi": some(up), "p_lo": some(down), "p_two": some(F.least(F.lit(1.0), 2 * F.least(up, down)))}


def compared(observed: DataFrame, draws: DataFrame, by: tuple[str, ...], metrics: tuple[str, ...], suffix: str) -> DataFrame:
    """observed with {metric}_{z,p_hi,p_lo,p_two}_{suffix} from draws(by, draw, metrics); null where a group has no draws."""
    null = draws.select(*by, *(F.col(m).alias(f"__{m}") for m in metrics))
    joined = observed.select(*by, *metrics).join(null, list(by))
    stats = {f"{m}_{k}_{suffix}": c for m in metrics for k, c in against_nulls(F.col(m), F.col(f"__{m}")).items()}
    return observed.join(joined.groupBy(*by).agg(*(c.alias(k) for k, c in stats.items())), list(by), "left")


_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]])
_SINES = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]


def _first_words(words: list[np.ndarray | None]) -> np.ndarray:
    """The first four bytes of md5, as a number that sorts like them, of messages of one block: words has its 16 little-endian
    words, arrays that fit each other, None for 0. Nothing after step 61 changes those bytes."""
    start = [np.full((1, 1), v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = start
    for i in range(61):
        r = i // 16
        f = d ^ (b & (c ^ d)) if r == 0 else c ^ (d & (b ^ c)) if r == 1 else b ^ c ^ d if r == 2 else c ^ (b | ~d)
        m = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[r] % 16]
        t = a + f
        t += _SINES[i]
        if m is not None:
            t = t + m  # m may be the wider
        high = t >> np.uint32(32 - _TURNS[r][i % 4])
        t <<= np.uint32(_TURNS[r][i % 4])
        t |= high
        t += b
        a, b, c, d = d, t, b, c
    return (b + start[0]).byteswap()


class Md5Orders:
    """Orders of the places of `at` by md5 over head|draw|at, then at, for heads of `size` bytes: what all heads share is made
    once."""

    def __init__(self, size: int, draws: range, at: np.ndarray) -> None:
        self.draws, self.at = len(draws), at.tolist()
        self.tails = [b"|%d|%d" % (j, q) for j in draws for q in self.at]
        ends = size + np.fromiter(map(len, self.tails), np.int64, len(self.tails))
        self.one_block = ends.max() <= 55
        if self.one_block:
            block = np.zeros((len(ends), 64), np.uint8)
            block[:, size : ends.max()] = np.array(self.tails).view(np.uint8).reshape(len(ends), -1)
            block[np.arange(len(ends)), ends] = 0x80
            block.view("<u4")[:, 14] = ends * 8
            self.words = [w[None] if w.any() else None for w in np.ascontiguousarray(block.view("<u4").T)]

    def whole(self, head: bytes, draw: int) -> list[int]:
        n = len(self.at)
        return sorted(range(n), key=lambda i: (hashlib.md5(head + self.tails[draw * n + i]).digest(), self.at[i]))

    def of(self, heads: list[bytes]) -> np.ndarray:
        """(heads, draws, len(at))."""
        shape = len(heads), self.draws, len(self.at)
        if not self.one_block:
            return np.array([[self.whole(h, j) for j in range(self.draws)] for h in heads])
        own = np.frombuffer(b"".join(h.ljust(64, b"\0") for h in heads), "<u4").reshape(len(heads), 16)
        words = []
        for j, tail in enumerate(self.words):
            head = own[:, j, None] if own[:, j].any() else None
            words.append(tail if head is None else head if tail is None else tail | head)
        keys = np.broadcast_to(_first_words(words), (len(heads), len(self.tails))).reshape(shape).astype(np.uint64)
        keys <<= np.uint64(32)
        keys |= np.arange(shape[2], dtype=np.uint64)
        keys.sort(axis=2)
        order = (keys & np.uint64(2**32 - 1)).view(np.int64)
        keys >>= np.uint64(32)
        for g, j in np.argwhere((keys[..., 1:] == keys[..., :-1]).any(2)).tolist():  # the same four bytes twice
            order[g, j] = self.whole(heads[g], j)
        return order


def _nine(x: np.ndarray) -> np.ndarray:
    """Values from 0 on at nine decimals, so that equal counts are equal whatever order their logarithms are summed in."""
    return np.floor(x * 1e9 + 0.5) / 1e9


def _against(values: np.ndarray, null: np.ndarray) -> np.ndarray:
    """against_nulls() of (groups, metrics) and (groups, draws, metrics), where draws that are NaN don't count: (groups,
    metrics, 4), NaN without draws."""
    there = ~np.isnan(null)
    n = there.sum(1)
    some = np.maximum(n, 1)
    mean = np.where(there, null, 0.0).sum(1) / some
    spread = np.sqrt((np.where(there, null - mean[:, None], 0.0) ** 2).sum(1) / some)
    up, down = ((1 + (side(null, values[:, None]) & there).sum(1)) / (n + 1) for side in (np.greater_equal, np.less_equal))
    z = np.where(spread > 1e-12, (values - mean) / np.where(spread > 1e-12, spread, 1.0), 0.0)
    return np.where(n[..., None] > 0, np.stack([z, up, down, np.minimum(1.0, 2 * np.minimum(up, down))], axis=2), np.nan)


def motifs_against_shuffles(steps: DataFrame, by: tuple[str, ...], k: int, draws: int, x: str = "x", at: str = "at", seed: int = 0, top_n: int = 5, base: int = N_JOINT) -> DataFrame:
    """by, motifs.METRICS of each group and {metric}_{z,p_hi,p_lo,p_two}_shuffle, against the metrics of as many draws in the orders
    of shuffled(), both at nine decimals; null where no draw has a window. Groups without windows have no row. Groups are
    dealt once, as arrays, and must fit a task; draws are made, measured and compared there, some at a time, so that no
    drawn row is moved, sorted or stored outside it."""
    tasks = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, long work: not to be put together by size
    dealt = steps.select(*by, F.col(at).cast("long").alias("__i"), F.col(x).cast("long").alias("__v")).repartition(tasks, *by)
    kept = dealt.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__i", "__v"))).alias("__s"))
    key = F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in by))
    kept = kept.select(*by, key.cast("binary").alias("__key"), F.transform("__s", lambda s: s["__i"]).alias("__at"), F.transform("__s", lambda s: s["__v"]).alias("__xs"))
    names = [*motifs.METRICS, *(f"{m}_{s}_shuffle" for m in motifs.METRICS for s in ("z", "p_hi", "p_lo", "p_two"))]

    def results(heads: list[bytes], place: np.ndarray, xs: np.ndarray, gone: np.ndarray | None) -> np.ndarray:
        """Of groups with keys of one length and the same positions."""
        g, n = xs.shape
        measured = lambda v, w: motifs.metrics_of_many(v.reshape(-1, n), k, None if w is None else w.reshape(-1, n), top_n, base)
        null = np.empty((g, draws, len(motifs.METRICS)))
        many = max(1, CELLS // n)
        for a in range(0, draws, many):
            some = range(a, min(a + many, draws))
            orders = Md5Orders(len(heads[0]), some, place)
            together = max(1, CELLS // (n * len(some)))
            for b in range(0, g, together):
                own = slice(b, b + together)
                order = orders.of(heads[own])
                drawn = [None if v is None else np.take_along_axis(v[own, None], order, 2) for v in (xs, gone)]
                null[own, a : some.stop] = measured(*drawn).reshape(-1, len(some), len(motifs.METRICS))
        own = measured(xs, gone)
        return np.concatenate([own, _against(_nine(own), _nine(null)).reshape(g, -1)], axis=1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = batch.column("__key").to_pylist()
            places, symbols = ([np.split(c.flatten().fill_null(0).to_numpy(zero_copy_only=False), np.cumsum(c.value_lengths().to_numpy())[:-1]) for c in map(batch.column, ("__at", "__xs"))])
            flat = batch.column("__xs").flatten()
            gone = np.split(flat.is_null().to_numpy(zero_copy_only=False), np.cumsum([len(v) for v in symbols])[:-1]) if flat.null_count else None
            alike = defaultdict(list)
            for i, (h, p) in enumerate(zip(heads, places, strict=True)):
                alike[len(h), p.tobytes()].append(i)
            out = np.empty((batch.num_rows, len(names)))
            for rows in alike.values():
                for a in range(0, len(rows), GROUPS):
                    own = rows[a : a + GROUPS]
                    out[own] = results([heads[i] for i in own], places[own[0]], np.stack([symbols[i] for i in own]), None if gone is None else np.stack([gone[i] for i in own]))
            some = ~np.isnan(out[:, 0])
            columns = [pa.array(out[some, j], pa.float64(), from_pandas=True) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(pa.array(some)) for c in by), *columns], names=[*by, *names])

    fields = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in by)
    return kept.mapInArrow(each, f"{fields}, {', '.join(f'{c} double' for c in names)}")
