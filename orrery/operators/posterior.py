"""Linear posteriors of arms as of every step: decayed sums of earlier credits without the reader's own context."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from orrery.operators.stats import placed
from orrery.session import staged

BLOCK = 1 << 16  # rows that one task scans at once
WIDEST = 600.0  # exponent up to which decayed sums are scaled within a chunk


def _chunks(keys: np.ndarray, steps: np.ndarray, zeta: float):
    """Bounds of stretches with one key and steps that are not further apart than the decay can be scaled."""
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    reach = WIDEST / -np.log(zeta) if zeta < 1 else np.inf
    for a, b in zip(cuts, cuts[1:]):
        first = a
        while first < b:
            last = int(np.searchsorted(steps[first:b], steps[first] + reach, side="right")) + first
            yield first, last, first == a
            first = last


def decayed_before(keys: np.ndarray, steps: np.ndarray, values: np.ndarray, zeta: float, carry=None):
    """(sums before each row, (key, step, sum) at the end).

    Rows are sorted by key and step; a row's sum is that of the rows of its key above
    it, each times zeta to the number of steps since.  ``carry`` is the (key, step, sum) at which the rows go on.
    """
    out = np.zeros_like(values)
    key, ref, held = carry if carry is not None else (None, 0, np.zeros(values.shape[1]))
    for a, b, new in _chunks(keys, steps, zeta):
        if new and keys[a] != key:
            key, ref, held = keys[a], steps[a], np.zeros(values.shape[1])
        age = (steps[a:b] - steps[a]).astype(np.float64)
        sums = np.cumsum(values[a:b] * np.power(zeta, -age)[:, None], axis=0)
        out[a + 1 : b] = sums[:-1] * np.power(zeta, age[1:])[:, None]
        out[a:b] += held * np.power(zeta, (steps[a:b] - ref).astype(np.float64))[:, None]
        held = sums[-1] * zeta ** age[-1] + held * zeta ** float(steps[b - 1] - ref)
        ref = steps[b - 1]
    return out, (key, ref, held)


def _arrays(t: pa.Table, width: int):
    values = t.column("_x").combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    return np.array(t.column("_key").to_pylist(), dtype=object), t.column("_step").to_numpy(), values.flatten().to_numpy().reshape(-1, width)


def _scanned(rows: DataFrame, by: list[str], width: int, zeta: float) -> DataFrame:
    """read, sums for the rows of ``rows`` (by, _step, read, _x) that have a read: what was written before them.

    All rows are put in one order and cut into blocks of ``BLOCK``.  A block gives the sum at
    its end; these, one row for each block, are carried on, and each block is
    scanned from what is carried to it.
    """
    key = F.md5(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}))
    keyed = rows.select(key.alias("_key"), "_step", F.col("read").isNull().alias("_write"), "read", "_x")
    # Reads come before writes of their step.
    ordered = placed(keyed, [], ["_key", "_step", "_write"], "_n")
    blocks = staged(ordered.withColumn("_block", F.floor((F.col("_n") - 1) / BLOCK)).drop("_write"), "blocks")
    end = "_block long, _key string, _step long, _whole boolean, _x array<double>"

    def ends(t: pa.Table) -> pa.Table:
        t = t.sort_by("_n")
        keys, steps, values = _arrays(t, width)
        _, (key, ref, held) = decayed_before(keys, steps, values, zeta)
        return pa.table({"_block": [t.column("_block")[0].as_py()], "_key": [key], "_step": pa.array([int(ref)], pa.int64()), "_whole": [bool((keys == key).all())], "_x": [held.tolist()]})

    def carried(t: pa.Table) -> pa.Table:
        t = t.sort_by("_block")
        out, before = [], None
        for block, key, step, whole, x in zip(*(t.column(c).to_pylist() for c in ("_block", "_key", "_step", "_whole", "_x"))):
            if before is not None:
                out.append((block, *before))
            held = np.array(x)
            if whole and before is not None and before[0] == key:
                held = held + np.array(before[2]) * zeta ** float(step - before[1])
            before = (key, step, held.tolist())
        columns = list(zip(*out)) or [()] * 4
        return pa.table({name: pa.array(list(c), kind) for name, c, kind in zip(("block", "key", "step", "x"), columns, (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float64())))})

    each = blocks.groupBy("_block").applyInArrow(ends, end)  # a row for each block
    carry = staged(each.groupBy(F.lit("all").alias("all")).applyInArrow(carried, "block long, key string, step long, x array<double>"), "carry")

    def scan(t: pa.Table, c: pa.Table) -> pa.Table:
        t = t.sort_by("_n")
        keys, steps, values = _arrays(t, width)
        held = (c.column("key")[0].as_py(), c.column("step")[0].as_py(), np.array(c.column("x")[0].as_py())) if c.num_rows else None
        sums, _ = decayed_before(keys, steps, values, zeta, held)
        asked = pc.is_valid(t.column("read")).to_numpy()
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (int(asked.sum()) + 1) * width, width, dtype=np.int32)), pa.array(sums[asked].reshape(-1)))
        return pa.table({"read": t.column("read").filter(pa.array(asked)), "sums": flat})

    kind = rows.schema["read"].dataType.simpleString()
    return blocks.groupBy("_block").cogroup(carry.groupBy("block")).applyInArrow(scan, f"read {kind}, sums array<double>")


def posterior_states(writes: DataFrame, reads: DataFrame, features: int, zeta: float, ridge: float = 1.0) -> DataFrame:
    """read, a (rows of the matrix one after the other), b, mean of the posterior that each read finds.

    ``writes``: arm, step, context, psi (``features`` numbers), reward; ``reads``: read (a
    name of its own), arm, step, context.  A read at step S finds a = ridge times the unit
    matrix plus the sum of zeta^(S - s) psi psi', and b, the sum of zeta^(S - s) reward psi,
    over the writes of its arm at earlier steps s from other contexts; mean is a's
    inverse times b.  That is the decayed sum over the arm less the one over the
    arm and the context, each from one ordered scan that carries sums over blocks, so
    neither an arm nor a context has to fit a task.  Null contexts are one context.
    """
    width = features * (features + 1)
    psi = F.col("psi").cast("array<double>")
    outer = F.flatten(F.transform(psi, lambda x: F.transform(psi, lambda y: x * y)))
    x = F.concat(outer, F.transform(psi, lambda y: y * F.col("reward").cast("double")))
    kind = reads.schema["read"].dataType
    step, context = F.col("step").cast("long").alias("_step"), F.col("context").cast("string").alias("context")
    both = writes.select("arm", context, step, F.lit(None).cast(kind).alias("read"), x.alias("_x")).unionByName(reads.select("arm", context, step, "read", F.array_repeat(F.lit(0.0), width).alias("_x")))
    both = staged(both, "credits")
    arm = _scanned(both, ["arm"], width, zeta)
    own = _scanned(both, ["arm", "context"], width, zeta).withColumnRenamed("sums", "own")
    rest = arm.join(own, "read").select("read", F.zip_with("sums", "own", lambda p, q: p - q).alias("x"))

    def solved(batches):
        eye = (ridge * np.eye(features)).reshape(-1)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, width)
            a, b = x[:, : features * features] + eye, x[:, features * features :]
            mean = np.linalg.solve(a.reshape(-1, features, features), b[:, :, None])[:, :, 0]
            offsets = lambda n: pa.array(np.arange(0, (len(x) + 1) * n, n, dtype=np.int32))
            columns = [pa.ListArray.from_arrays(offsets(m.shape[1]), pa.array(np.ascontiguousarray(m).reshape(-1))) for m in (a, b, mean)]
            yield pa.RecordBatch.from_arrays([batch.column("read"), *columns], names=["read", "a", "b", "mean"])

    return rest.mapInArrow(solved, f"read {kind.simpleString()}, a array<double>, b array<double>, mean array<double>")
