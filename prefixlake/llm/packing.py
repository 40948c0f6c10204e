"""Packing in order: dynamic programming with a monotone queue chooses where sequences are cut."""

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.bpe import checked_path, encoder
from prefixlake.llm.spans import Texts, slices

LIMIT = 1024
#: Costs in tokens of padding: of a cut between sentences of a document, and of one inside a sentence.
SENTENCE_CUT, INNER_CUT = 4, 32
#: Where no sentence ends for longer than this, every INNER_STEP tokens can be a cut; near the end of a block every token.
INNER_GAP, INNER_STEP, TAIL = 64, 32, 2048
SENTENCE_ENDS = (0x0A, 0x2E, 0x21, 0x3F, 0x3002, 0xFF01, 0xFF1F)


def choose_cuts(places: np.ndarray, costs: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Indices into `places` (rising, from 0, steps of at most `limit`) at which to cut, the last one included.

    A sequence between two cuts costs its padding up to `limit`, or nothing if its length is a power of two; each cut
    costs `costs`. Least total: f[j] = costs[j] + min over i of f[i] + places[i], over places within `limit`, kept in a
    monotone queue; and over the places that are a power of two before j.
    """
    n = len(places)
    exact: dict[int, list[int]] = {}
    k = 1
    while k <= limit:
        i = np.minimum(np.searchsorted(places, places - k), n - 1)
        for j in np.flatnonzero(places[i] == places - k).tolist():
            exact.setdefault(j, []).append(int(i[j]))
        k *= 2
    at, cost = places.tolist(), costs.tolist()
    best, came = [0] * n, [0] * n
    queue = deque([(0, 0, 0)])
    for j in range(1, n):
        p = at[j]
        while queue[0][1] < p - limit:
            queue.popleft()
        low, _, i = queue[0]
        low += limit - p
        for x in exact.get(j, ()):
            if best[x] < low:
                low, i = best[x], x
        best[j], came[j] = low + cost[j], i
        key = best[j] + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    cuts = []
    j = n - 1
    while j:
        cuts.append(j)
        j = came[j]
    return np.array(cuts[::-1], np.int64)


def cut_places(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Places where a block of `total` tokens may be cut, with their costs."""
    cost = np.full(total + 1, -1, np.int64)
    cost[0] = 0
    cost[sentence_ends] = SENTENCE_CUT
    cost[doc_ends] = 0
    held = np.flatnonzero(cost >= 0)
    step = min(INNER_STEP, limit)
    gaps = np.flatnonzero(np.diff(held) > min(INNER_GAP, limit))
    for a, b in zip(held[gaps].tolist(), held[gaps + 1].tolist(), strict=True):
        cost[a + step : b : step] = INNER_CUT
    tail = cost[max(0, total - min(TAIL, 2 * limit)) :]
    tail[tail < 0] = INNER_CUT
    places = np.flatnonzero(cost >= 0)
    return places, cost[places]


def pack(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every row of `docs`, packed in the order that they come in into sequences of at most `limit` tokens.

    A document is its ids and then `end_id`; each id lies in exactly one piece. Columns: id, start (ids of the document
    before the piece), length, ids (unsigned little-endian 32-bit), doc_tokens, sequence_id, offset (in the sequence).
    A null or empty text is `end_id` alone; a text of any length is cut as often as needed. Each task packs its own rows
    in blocks of some million code points: no shuffle, and a lost task is simply run again.
    """
    path = checked_path(vocabulary)

    def packed(batches):
        sequence = TaskContext.get().partitionId() << 36
        for rows, texts in slices(batches):
            t = Texts(texts)
            starts, size, ids, bounds = encoder(path).encode(t)
            count = np.diff(bounds) + 1
            ends = np.cumsum(count)
            total = int(ends[-1])
            flat = np.full(total, end_id, np.uint32)
            own = np.ones(total, bool)
            own[ends - 1] = False
            flat[own] = ids
            before = np.cumsum(size) - size + t.owner(starts)
            ended = np.isin(t.cps[starts - 1], SENTENCE_ENDS) & (starts > 0)
            places, costs = cut_places(total, ends, before[ended], limit)
            cuts = places[choose_cuts(places, costs, limit)]
            edges = np.union1d(cuts, ends)
            begins = np.concatenate(([0], edges[:-1]))
            doc = np.searchsorted(ends, begins, "right")
            window = np.searchsorted(cuts, begins, "right")
            first = np.concatenate(([0], cuts[:-1]))
            data = pa.py_buffer(flat.tobytes())
            if 4 * total >= 1 << 31:
                raise ValueError("a text of over half a billion tokens")
            offsets = pa.py_buffer((np.concatenate((begins, [total])) * 4).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").take(pa.array(doc)),
                    pa.array(begins - (ends - count)[doc]),
                    pa.array(edges - begins),
                    pa.Array.from_buffers(pa.binary(), len(begins), [None, offsets, data]),
                    pa.array(count[doc]),
                    pa.array(sequence + window),
                    pa.array(begins - first[window]),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += len(cuts)

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(packed, schema).withColumnRenamed("doc_id", id_col)
