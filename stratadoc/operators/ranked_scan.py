"""Exact per-question top-k over a table too large to join.

A join would emit every question-item pair. Here each task scans its own items against a block of
questions and emits at most ``k`` rows per question, so the shuffle carries
``tasks * questions * k`` narrow rows and no pair is ever written.

Two ways, chosen by the measured size of the question side:

* up to ``broadcast_bytes``: the questions are broadcast, the items are read in place, no item moves;
* beyond it: both sides are packed, a thousand rows to a compressed Arrow message, the items once for all, and
  cut into blocks of bounded size. Every (question block, item block) cell reads the messages of both; it holds
  the questions of one block and one message of items at a time. Packs are dealt to blocks by hash of the first
  row's unique id, so no value of any other column can make one cell large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from stratadoc.session import durable

BROADCAST_BYTES = 64 * 1024 * 1024
#: Rows of a block at most; copies of either side in the shuffle are as many as the other side's blocks.
QUESTION_BLOCK = 131_072
ITEM_BLOCK = 524_288
#: More cells than the rows ask for keep all cores busy, down to this size.
ITEM_BLOCK_LEAST = 65_536
PACK_ROWS = 1_024
#: Cells a core has to do at least, so that cores end together.
CELLS_PER_CORE = 4


def _result(kernel, schema: pa.Schema) -> pa.RecordBatch:
    qids, iids, scores = kernel.best()
    arrays = [pa.array(v, type=f.type) for v, f in zip((qids, iids, scores), schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _packed(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``first, rows, message``: consecutive rows as compressed Arrow messages, named by their first key."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                    writer.write_batch(part)
                columns = [part.column(key).slice(0, 1), pa.array([part.num_rows], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["first", "rows", "message"])

    kind = df.schema[key].dataType.simpleString()
    return df.mapInArrow(pack, f"first {kind}, rows int, message binary")


def _unpacked(packs: pa.Table) -> Iterator[pa.Table]:
    for message in packs.column("message"):
        yield pa.ipc.open_stream(message.as_buffer()).read_all()


def _keys_of_tasks(spark: SparkSession, tasks: int) -> list[int]:
    """For each of so many tasks a number that Spark's hash deals to it, so that groups so named meet in no task."""
    numbers = spark.range(32 * tasks).select(F.col("id").cast("int").alias("key"))
    dealt = numbers.select("key", F.pmod(F.hash("key"), F.lit(tasks)).alias("task")).groupBy("task").agg(F.min("key").alias("key"))
    found = {r["task"]: r["key"] for r in dealt.collect()}
    spare = iter(range(32 * tasks, 33 * tasks))
    return [found[t] if t in found else next(spare) for t in range(tasks)]


def scan_topk(
    questions: DataFrame,
    items: DataFrame,
    make_kernel: Callable,
    *,
    question_id: str,
    item_id: str,
    k: int,
    question_rows: int,
    question_bytes: int,
    broadcast_bytes: int = BROADCAST_BYTES,
    question_block: int = QUESTION_BLOCK,
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """Rows ``(question_id, item_id, score, rank)``, ordered by score desc, item id asc.

    ``make_kernel(question_table)`` builds an object with ``update(record_batch)`` and ``best()``.
    ``question_rows`` and ``question_bytes`` are the measured size of the question side.
    """
    spark = items.sparkSession
    qtype = questions.schema[question_id].dataType
    itype = items.schema[item_id].dataType
    out = T.StructType(
        [
            T.StructField(question_id, qtype),
            T.StructField(item_id, itype),
            T.StructField("score", T.DoubleType()),
        ]
    )
    arrow_types = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}
    out_arrow = pa.schema(
        [(question_id, arrow_types[qtype]), (item_id, arrow_types[itype]), ("score", pa.float64())]
    )

    if question_bytes <= broadcast_bytes:
        shared = spark.sparkContext.broadcast(questions.toArrow())

        def scan(batches):
            kernel = None
            for batch in batches:
                if kernel is None:
                    kernel = make_kernel(shared.value)
                kernel.update(batch)
            if kernel is not None:
                yield _result(kernel, out_arrow)

        local = items.mapInArrow(scan, out)
    else:
        stored = durable(_packed(items, item_id, min(PACK_ROWS, item_block)))
        item_rows = stored.agg(F.sum("rows").alias("n")).first()["n"] or 0
        q_blocks = max(1, -(-question_rows // question_block))
        wanted = CELLS_PER_CORE * spark.sparkContext.defaultParallelism // q_blocks
        i_blocks = max(1, -(-item_rows // item_block), min(wanted, -(-item_rows // ITEM_BLOCK_LEAST)))
        cells = q_blocks * i_blocks
        names = F.array(*map(F.lit, _keys_of_tasks(spark, cells)))

        def blocked(packs, own, own_n, other, other_n):
            out = packs.select("message", F.pmod(F.xxhash64("first"), F.lit(own_n)).cast("int").alias(own))
            out = out.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))
            # A given number, since rows are few and their work is not: one cell a task, and none are put together by size.
            out = out.select("message", F.element_at(names, F.col("_qb") * F.lit(i_blocks) + F.col("_ib") + 1).alias("_cell"))
            return out.repartition(cells, "_cell").groupBy("_cell")

        left = blocked(_packed(questions, question_id, min(PACK_ROWS, question_block)), "_qb", q_blocks, "_ib", i_blocks)
        right = blocked(stored, "_ib", i_blocks, "_qb", q_blocks)

        def cell(qs: pa.Table, its: pa.Table) -> pa.Table:
            if not qs.num_rows or not its.num_rows:
                return out_arrow.empty_table()
            kernel = make_kernel(pa.concat_tables(_unpacked(qs)))
            for pack in _unpacked(its):
                kernel.update(pack)
            return pa.Table.from_batches([_result(kernel, out_arrow)])

        local = left.cogroup(right).applyInArrow(cell, out)

    # The rank filter lets Spark prune to k rows per question before the shuffle as well.
    best_first = Window.partitionBy(question_id).orderBy(F.desc("score"), F.asc(item_id))
    return local.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
