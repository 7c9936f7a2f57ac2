"""Packing by best-fit decreasing: a segment tree over remaining capacities finds the tightest open window."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bound_batches, text_of
from .tokens import encoder

PIECES_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Capacities:
    """How many open windows have each remaining capacity 0..size; the least capacity >= need in log2(size) steps."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._change(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window with room for ``need``, no longer open; None if there is none."""
        i = need + self.leaves
        while not self.count[i]:
            while i & 1:  # a right child: nothing further right below this parent
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._change(capacity, -1)
        return capacity, self.windows[capacity].pop()

    def _change(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1


def pack(lengths: list[int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) of every piece; documents are numbered as given, windows from 0.

    Documents over ``size`` are first cut into full windows. What is left goes, longest first, into the tightest open
    window. Then the emptiest windows are cut up to fill the gaps of the fullest, so that all but one window are full.
    """
    bins: list[list[tuple[int, int, int]]] = []
    rests = []
    for doc, n in enumerate(lengths):
        full = n // size
        bins += [[(doc, k * size, size)] for k in range(full)]
        if n % size:
            rests.append((n % size, doc, full * size))
    rests.sort(key=lambda r: (-r[0], r[1]))
    room, first = Capacities(size), len(bins)
    for n, doc, start in rests:
        capacity, window = room.take(n) or (size, len(bins))
        if window == len(bins):
            bins.append([])
        bins[window].append((doc, start, n))
        if capacity > n:
            room.add(capacity - n, window)
    fill = lambda w: sum(p[2] for p in w)
    open_ = sorted((w for w in bins[first:] if fill(w) < size), key=lambda w: -fill(w))
    low, high = 0, len(open_) - 1
    gap = size - fill(open_[0]) if open_ else 0
    while low < high:
        if not open_[high]:
            high -= 1
            continue
        doc, start, n = open_[high].pop()
        cut = min(gap, n)
        open_[low].append((doc, start, cut))
        if cut < n:
            open_[high].append((doc, start + cut, n - cut))
        gap -= cut
        if not gap:
            low += 1
            gap = size - fill(open_[low])
    out, number = [], 0
    for w in bins:
        if w:
            at = 0
            for doc, start, n in w:
                out.append((doc, start, n, number, at))
                at += n
            number += 1
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0, group_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text (null: empty) and ``end_id``, so an empty text is one id. Every id lies in one
    piece; the pieces of a sequence follow one another from offset 0. A task packs what it reads in groups of about
    ``group_tokens`` ids, its bound of memory besides one document; at most one sequence of a group is not full. Nothing is
    shuffled: any set of documents packs well, so the order of rows and hot keys do not matter. sequence_id is the task's
    partition and a running number. Repeated rows and ids are packed as they come, each row a document of its own; ids of any
    type come back as they are, null ones too; an empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(docs[id_col].alias("doc_id"), text_of(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType, True), *T.StructType.fromDDL(PIECES_SCHEMA).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import array

        from pyspark import TaskContext

        encode, sequence, arrow = encoder(tokenizer_path), TaskContext.get().partitionId() << 33, to_arrow_schema(schema)
        end = array.array("I", [end_id]).tobytes()
        ids: list[bytes] = []
        names: list[pa.Array] = []  # the ids of the rows in hand, never as Python values
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held
            pieces = pack([len(x) // 4 for x in ids], size)
            columns = zip(*((s, n, zlib.crc32(ids[d][4 * s : 4 * (s + n)]), len(ids[d]) // 4, sequence + w, at) for d, s, n, w, at in pieces), strict=True)
            own = pa.concat_arrays(names).take(pa.array([p[0] for p in pieces], pa.int64()))
            sequence += pieces[-1][3] + 1
            ids.clear(), names.clear()
            held = 0
            return pa.RecordBatch.from_arrays([own.cast(arrow[0].type), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

        for b in batches:
            begin = 0
            for k, text in enumerate(b.column("text").to_pylist()):
                ids.append(encode(text) + end)
                held += len(ids[-1]) // 4
                if held >= group_tokens:
                    names.append(b.column("doc_id").slice(begin, k + 1 - begin))
                    begin = k + 1
                    yield flush()
            names.append(b.column("doc_id").slice(begin))
        if ids:
            yield flush()

    bound_batches(docs.sparkSession)
    return rows.mapInArrow(run, schema)
