"""Arrow batch plumbing for the few operators that have to run Python per row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from dossierflow.session import reach_workers

#: Output rows per Arrow batch; keeps a batch of long texts small.
FLUSH_ROWS = 4096
#: Rows that are packed together.
PACKED_ROWS = 1 << 16


def map_rows(df: DataFrame, rows: Callable[..., Iterator[tuple]], schema: str | StructType, setup: Callable[[], object] | None = None) -> DataFrame:
    """Runs `rows(value, ...)` for each input row and emits the tuples it yields.

    `setup()` is called once per task; what it returns is passed as the first
    argument. Nothing is collected: batches stream through the Python worker.
    """
    reach_workers(df.sparkSession)
    out = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        buffer: list[tuple] = []
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                buffer.extend(rows(state, *values) if setup else rows(*values))
                if len(buffer) >= FLUSH_ROWS:
                    yield to_batch(buffer, target)
                    buffer = []
        if buffer:
            yield to_batch(buffer, target)

    return df.mapInArrow(run, out)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, for work that costs far more than reading.

    Only a scan of fewer partitions than cores is moved; a large one has many
    and stays as it is, and so does what comes out of a shuffle.
    """
    run = df._jdf.queryExecution()
    if "AdaptiveSparkPlan" in run.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if run.toRdd().getNumPartitions() < cores else df


def to_batch(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def packed(tables: Iterator[tuple[bool, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Batches (flag, packed) for `mapInArrow`: the rows of each flag as compressed tables, equal values once in each."""
    held: dict[bool, list[pa.RecordBatch]] = {True: [], False: []}

    def pack(flag: bool) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held[flag]).combine_chunks()
        whole = pa.table([c.dictionary_encode() for c in whole.columns], names=whole.column_names)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(whole)
        held[flag] = []
        return pa.RecordBatch.from_arrays([pa.array([flag]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["back", "packed"])

    for flag, b in tables:
        if b.num_rows:
            held[flag].append(b)
        if sum(x.num_rows for x in held[flag]) >= PACKED_ROWS:
            yield pack(flag)
    for flag in held:
        if held[flag]:
            yield pack(flag)


def unpacked(df: DataFrame, column: str, schema: StructType) -> DataFrame:
    """The rows that `packed` put into the tables of a column."""
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0):
                for part in pa.ipc.open_stream(p.as_buffer()).read_all().to_batches(max_chunksize=FLUSH_ROWS):
                    yield pa.RecordBatch.from_arrays([c.dictionary_decode().cast(f.type) for c, f in zip(part.columns, target)], schema=target)

    reach_workers(df.sparkSession)
    return df.select(column).mapInArrow(run, schema)
