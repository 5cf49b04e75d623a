"""Packing documents into fixed-length token sequences by multiway differencing.

Every task packs the documents of its own partition in groups of bounded size, so
nothing is shuffled and a lost executor costs one task. In a group, stretches of
a full window become sequences at once; the remainders are items for the
Karmarkar-Karp multiway differencing method: partial partitions are merged so that
the fullest windows of one meet the emptiest of the other, always the two with the
largest imbalance. The window count starts at the least possible one and rises
while any window exceeds the capacity. The near-equal windows are then filled up
exactly by cutting pieces off the emptiest ones; what is left of the last joins the
next group, and at the end of the partition it is cut into sequences whose lengths
are powers of two, which need no padding.

Defined cases: a null text is empty and still gives its end id. Repeated rows are
packed each on their own. Columns beyond the named ones are ignored. An empty
table gives no sequence. A text of any length is packed whole.
"""

from __future__ import annotations

import heapq
import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.bpe import encoder
from riskspark.llm.common import id_text, ship, to_arrow

WINDOW = 2048
GROUP_DOCS = 256           # documents whose remainders are differenced together
SEQUENCES_PER_TASK = 1 << 40


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp multiway differencing: item numbers per window.

    A partial partition is a list of (sum, items), largest first, without its empty
    windows. Merging puts the largest window of one onto the smallest of the other."""
    order = count()
    heap = [(-s, next(order), [(s, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        clash = len(a) + len(b) - windows
        if clash > 0:
            low = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[len(a) - clash:], reversed(b[len(b) - clash:]))]
            merged = a[:len(a) - clash] + b[:len(b) - clash] + low
        else:
            merged = a + b
        merged.sort(key=lambda w: -w[0])
        least = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (least - merged[0][0], next(order), merged))
    return [list(items) for _, items in heap[0][2]] if heap else []


def balanced_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; their count rises until all fit.

    Items are at most ``capacity`` long, so one item per window always fits."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        out = differencing(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in out):
            return out
        windows += 1


def fill_up(windows: list[list[tuple]], capacity: int) -> tuple[list[list[tuple]], list[tuple]]:
    """Fill windows exactly by cutting pieces off the emptiest ones. Pieces are
    ``(doc, start, length)``. Returns full windows and the pieces of a last one."""
    rows = sorted(([sum(p[2] for p in w), w] for w in windows), key=lambda r: -r[0])
    full, lo, hi = [], 0, len(rows) - 1
    while lo < hi:
        total, w = rows[lo]
        while total < capacity and lo < hi:
            donor = rows[hi]
            doc, start, length = donor[1].pop()
            take = min(length, capacity - total)
            w.append((doc, start, take))
            total += take
            donor[0] -= take
            if take < length:
                donor[1].append((doc, start + take, length - take))
            if not donor[0]:
                hi -= 1
        rows[lo][0] = total
        if total == capacity:
            full.append(w)
            lo += 1
    left = rows[lo][1] if lo <= hi and lo < len(rows) else []
    if left and rows[lo][0] == capacity:
        full.append(left)
        left = []
    return full, left


def power_tails(pieces: list[tuple]) -> list[list[tuple]]:
    """Cut the last pieces into sequences whose lengths are powers of two."""
    pieces, out = list(pieces), []
    total = sum(p[2] for p in pieces)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        seq = []
        while room:
            doc, start, length = pieces.pop()
            take = min(length, room)
            seq.append((doc, start, take))
            room -= take
            if take < length:
                pieces.append((doc, start + take, length - take))
        out.append(seq)
    return out


def pack_group(lengths: list[int], carried: list[tuple], capacity: int) -> tuple[list[list[tuple]], list[tuple]]:
    """Sequences of one group and the pieces to carry on. ``lengths``: tokens of
    documents 0, 1, ...; ``carried``: pieces of earlier documents (other keys)."""
    full, items = [], list(carried)
    for doc, n in enumerate(lengths):
        whole = n // capacity * capacity
        full += [[(doc, s, capacity)] for s in range(0, whole, capacity)]
        if n > whole:
            items.append((doc, whole, n - whole))
    if not items:
        return full, []
    windows = balanced_windows([p[2] for p in items], capacity)
    exact, left = fill_up([[items[i] for i in w] for w in windows], capacity)
    return full + exact, left


SCHEMA = "doc_id {0}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW,
                   id_col: str = "doc_id", text_col: str = "text", group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    d = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    ddl = SCHEMA.format(dict(d.dtypes)["doc_id"])
    ship(docs.sparkSession)
    schema = to_arrow(ddl)

    def run(batches):
        enc = encoder(tokenizer_path)
        first = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        numbers = count(first)
        kept: dict = {}      # piece key -> (doc_id, ids, doc_tokens) of carried pieces
        carried: list[tuple] = []

        def rows(sequences, docs_of):
            cols = [[] for _ in schema]
            for seq in sequences:
                number, offset = next(numbers), 0
                for doc, start, length in seq:
                    doc_id, ids = docs_of(doc)
                    crc = zlib.crc32(np.ascontiguousarray(ids[start:start + length], "<u4").tobytes())
                    for c, v in zip(cols, (doc_id, start, length, crc, len(ids), number, offset)):
                        c.append(v)
                    offset += length
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        serial = count()
        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(texts), group_docs):
                group = [np.append(x, np.uint32(end_id)) for x in enc.encode_many(texts[at:at + group_docs])]
                sequences, left = pack_group([len(x) for x in group], carried, window)

                def find(doc, group=group, at=at):
                    return (doc_ids[at + doc], group[doc]) if isinstance(doc, int) else kept[doc]

                if sequences:
                    yield rows(sequences, find)
                moved = {}
                carried = []
                for doc, start, length in left:
                    key = doc if isinstance(doc, tuple) else ("kept", next(serial), doc)
                    moved[key] = find(doc)
                    carried.append((key, start, length))
                kept = moved
        if carried:
            yield rows(power_tails(carried), kept.__getitem__)

    return d.mapInArrow(run, ddl)
