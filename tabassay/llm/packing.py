"""Best-fit packing by minimum bin slack.

Documents become token ids plus a separator and are cut only where one is longer than a sequence. Rows
of a few numbers (and the ids, if wanted) are dealt to packing tasks, whose number follows from the bytes of all texts
and from no setting of the session; each task fills one sequence after another: a
subset-sum bitset over the lengths still available finds the fullest feasible combination, which is
then removed. Tasks pack on their own, so the cost of splitting is one part-filled sequence per task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tabassay.llm import bpe
from tabassay.llm.common import by_bytes

#: Bytes of text to a packing task: some ten million tokens, five thousand sequences.
TASK_BYTES = 1 << 25
#: Pieces, and bytes of ids beside them, that one packing run holds at most; a task with more does several runs.
RUN_PIECES, RUN_BYTES = 1 << 17, 1 << 28
#: Pieces are dealt by a running number modulo this, so no key can gather them in one task.
DEALS = 1 << 16

_memos: dict[str, bpe.Memo] = {}



def cut_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int, separator: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    memo = _memos.get(path)
    if memo is None:
        memo = _memos[path] = bpe.Memo(path, bpe.id_bytes)
    end = np.uint32(separator).tobytes()
    deal, step = 0, 4 * capacity
    for batch in by_bytes(batches, 1):
        rows, piece, start, length, crc, dealt, ids = [], [], [], [], [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            data = b"".join(memo.of(text or "")) + end
            for k, at in enumerate(range(0, len(data), step)):
                part = data[at : at + step]
                rows.append(row)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                dealt.append(deal % DEALS)
                deal += 1
                if with_ids:
                    ids.append(part)
        columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(dealt, pa.int32())]
        names = ["key", "piece", "start", "length", "ids_crc32", "deal"]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)


class Lengths:
    """A multiset of piece lengths, its distinct lengths in ascending order."""

    def __init__(self, lengths: np.ndarray):
        values, counts = np.unique(lengths, return_counts=True)
        self.sorted, self.count = values.tolist(), dict(zip(values.tolist(), counts.tolist(), strict=True))

    def take(self, length: int) -> None:
        self.count[length] -= 1
        if not self.count[length]:
            del self.sorted[bisect_left(self.sorted, length)]
            del self.count[length]


def fullest(lengths: Lengths, room: int) -> list[int]:
    """The lengths of a combination that leaves the least of ``room``.

    Bit s of ``reach`` says that some combination of the lengths seen so far sums to s. ``steps`` keeps
    the bitset before each length, from which the combination is read back.
    """
    reach, goal, mask, steps = 1, 1 << room, (2 << room) - 1, []
    at = bisect_left(lengths.sorted, room + 1)
    for length in reversed(lengths.sorted[:at]):
        for _ in range(min(lengths.count[length], room // length)):
            wider = (reach | reach << length) & mask
            if wider == reach:
                break
            steps.append((length, reach))
            reach = wider
        if reach & goal:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> total & 1:
            chosen.append(length)
            total -= length
    return chosen


def minimum_bin_slack(lengths: np.ndarray, capacity: int) -> Iterator[list[int]]:
    """Sequences as lists of lengths, the longest piece first and then the fullest combination beside it."""
    left = Lengths(lengths)
    while left.sorted:
        first = left.sorted[-1]
        left.take(first)
        rest = fullest(left, capacity - first) if first < capacity else []
        for length in rest:
            left.take(length)
        yield [first, *rest]


def pack_run(table: pa.Table, capacity: int, base: int) -> tuple[pa.Table, int]:
    """One packing run: adds sequence_id from ``base`` on and offset."""
    length = table["length"].to_numpy()
    order = np.lexsort((table["ids_crc32"].to_numpy(), table["start"].to_numpy(), length))
    values, first = np.unique(length[order], return_index=True)
    following = dict(zip(values.tolist(), first.tolist(), strict=True))
    sequence, offset, n = np.empty(len(length), np.int64), np.empty(len(length), np.int64), 0
    for n, combination in enumerate(minimum_bin_slack(length, capacity), 1):
        at = 0
        for one in combination:
            row = order[following[one]]
            following[one] += 1
            sequence[row], offset[row] = base + n - 1, at
            at += one
    return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)), base + n


def pack_batches(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    base, held, rows, size = TaskContext.get().partitionId() << 40, [], 0, 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
        if rows >= RUN_PIECES or size >= RUN_BYTES:
            packed, base = pack_run(pa.Table.from_batches(held), capacity, base)
            yield from packed.to_batches(4096)
            held, rows, size = [], 0, 0
    if rows:
        packed, base = pack_run(pa.Table.from_batches(held), capacity, base)
        yield from packed.to_batches(4096)


def packing_tasks(docs: DataFrame, text: str = "text", each: int = TASK_BYTES) -> int:
    """How many packing tasks a table takes: its texts' bytes in parts of ``each``, counted by one sum."""
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0]
    return max(-(-(total or 0) // each), 1)


def pack_documents(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", capacity: int = 2048, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """``key, piece, start, length, ids_crc32, sequence_id, offset`` per piece; ``with_ids`` adds the ids (little-endian unsigned 32-bit).

    Null and empty texts become the separator alone. Repeated rows and null keys are packed as often as
    they come; ties between equal lengths go by start and checksum. An empty table gives no rows. Other columns of
    ``docs`` are not read. Sequences hold ``capacity`` tokens at most, offsets are gapless from 0.
    """
    kind = docs.schema[key].dataType.simpleString()
    columns = f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, deal int" + ", ids binary" * with_ids
    cut = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(lambda it: cut_batches(it, path, capacity, separator, with_ids), columns)
    packed = cut.repartition(packing_tasks(docs, text), "deal").mapInArrow(lambda it: pack_batches(it, capacity), columns + ", sequence_id bigint, offset bigint")
    return packed.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
