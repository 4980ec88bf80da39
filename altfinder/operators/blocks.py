"""All against all by packed blocks: every block of one side meets every block of
the other, and no side is sent or written once per block of the other.

Rows are dealt into partitions, and a partition's rows are packed into a block: a
row that holds the values of each column as bytes. The second side's blocks are
written once; a task takes a block of the first side past all of them and keeps
what its rows need. So disk grows with the rows and only CPU time with the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from altfinder.session import materialize

BLOCK_BYTES = 16 << 20              # a block of wide rows ends earlier
NO_ID = np.iinfo(np.int64).min      # stands for a null number


def _dtype(kind: T.DataType) -> str:
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    return {"bigint": "<i8", "int": "<i4", "float": "<f4", "double": "<f8", "binary": "u1"}[kind.simpleString()]


def _bytes(col: pa.Array) -> bytes:
    if pa.types.is_list(col.type):
        return np.ascontiguousarray(col.flatten().to_numpy(zero_copy_only=False)).tobytes()
    if pa.types.is_binary(col.type):
        return b"".join(col.to_pylist())
    if col.type == pa.int64():
        col = col.fill_null(NO_ID)
    return col.to_numpy(zero_copy_only=False).tobytes()


def packed(rows: DataFrame, side: str, most: int, whole: str | None = None) -> DataFrame:
    """Each partition's rows as blocks of at most ``most`` rows: a row with the
    number of rows and, as bytes, the values of each column (numbers; lists or
    bytes of one length). Rows that follow each other with the same ``whole``
    (a number) stay in one block."""
    names = rows.columns
    schema = T.StructType([T.StructField(f"{side}_block", T.LongType()), T.StructField(f"{side}_rows", T.LongType()),
                           *[T.StructField(f"{side}_{c}", T.BinaryType()) for c in names]])
    arrow = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.binary()) for f in schema])

    def run(batches):
        part, done, held = TaskContext.get().partitionId() << 32, 0, []

        def block(parts):
            nonlocal done
            values = [[part + done], [sum(b.num_rows for b in parts)], *[[b"".join(_bytes(b.column(c)) for b in parts)] for c in names]]
            done += 1
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow)], schema=arrow)

        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                held.append(batch.slice(lo, most))
                if sum(b.num_rows for b in held) < most and sum(b.nbytes for b in held) < BLOCK_BYTES:
                    continue
                end = held[-1].num_rows
                if whole:  # the last one's rows may go on
                    key = held[-1].column(whole).to_numpy(zero_copy_only=False)
                    end = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
                if end or not whole:
                    yield block([*held[:-1], held[-1].slice(0, end)])
                    held = [held[-1].slice(end)] if end < held[-1].num_rows else []
        if held:
            yield block(held)
    return rows.mapInArrow(run, schema)


def met(first: DataFrame, second: DataFrame, sizes: tuple[int, int], begin: Callable, ready: Callable, schema: str,
        most: int, whole: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """Blocks of ``first`` (its partitions) go past the blocks of ``second``, one
    after another in one task. Where there are fewer blocks of ``first`` than
    cores, several tasks share the blocks of ``second``. ``sizes``: partitions of
    each, dealt by hash, so a partition is mostly one block of up to ``most`` rows.

    ``begin`` makes of a block of ``first`` (column: values) what keeps its
    answer, ``ready`` of a block of ``second`` what that one's ``meet`` takes. Its
    ``pairs`` are the answer's columns (``schema``; NO_ID is null)."""
    cores = first.sparkSession.sparkContext.defaultParallelism
    kept = materialize(packed(second, "v", most, whole[1]))
    parts = min(math.ceil(2 * cores / sizes[0]), sizes[1])
    both = kept.coalesce(parts).crossJoin(packed(first, "q", most, whole[0]).hint("shuffle_replicate_nl"))
    kinds = {side: {f.name: _dtype(f.dataType) for f in rows.schema} for side, rows in (("q", first), ("v", second))}
    wide = {f.name for rows in (first, second) for f in rows.schema if isinstance(f.dataType, T.ArrayType | T.BinaryType)}
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        def block(batch: pa.RecordBatch, i: int, side: str) -> dict[str, np.ndarray]:
            n = batch.column(f"{side}_rows")[i].as_py()
            flat = {c: np.frombuffer(batch.column(f"{side}_{c}")[i].as_buffer(), dtype=d) for c, d in kinds[side].items()}
            return {c: x.reshape(n, -1) if c in wide else x for c, x in flat.items()}
        held, last, there = {}, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                at, to = batch.column("q_block")[i].as_py(), batch.column("v_block")[i].as_py()
                if at not in held:
                    held[at] = begin(block(batch, i, "q"))
                if to != last:
                    last, there = to, ready(block(batch, i, "v"))
                held[at].meet(*there)
        for one in held.values():
            columns = [pa.array(x, mask=x == NO_ID) if x.dtype == np.int64 else pa.array(x) for x in one.pairs()]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return both.mapInArrow(run, schema)
