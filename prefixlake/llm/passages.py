"""Passages that repeat, by sparse suffix arrays: suffixes at minimiser positions are sorted, neighbours compared, matches extended both ways."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.shared import join_counted, split_by, written
from prefixlake.llm.spans import Texts, mixed, plain_words, slices, windows

#: Words that a passage has at least.
MIN_WORDS = 50
#: Words of a seed. Of each MIN_WORDS words in a row at least one seed is retained, the one with the least hash.
SEED_WORDS = 8
#: Bytes of a word's hash in a suffix.
WORD_BYTES = 3
#: Words of a suffix by which ranges are drawn; at least a seed's.
RANGE_WORDS = 12
#: Suffixes that are compared at once.
CHUNK = 16_384
_SUFFIX = "doc_id long, key long, place int, after binary, before binary, least int, most int"
_NAMES = ["doc_id", "key", "place", "after", "before", "least", "most"]
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width], by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def minimisers(hashes: np.ndarray, bounds: np.ndarray, seed_words: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the retained seeds among the words of all texts, and the seeds' hashes.

    Of every min_words words in a row the seed with the least hash is retained, and all that equal it. bounds: text i has the words bounds[i]:bounds[i + 1].
    """
    n = len(hashes)
    width = min_words - seed_words + 1
    if n < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    seeds = windows(hashes, seed_words)
    seeds[owner[seed_words - 1 :] != owner[: len(seeds)]] = _TOP
    least = _sliding(seeds, width, np.minimum)
    least[owner[min_words - 1 :] != owner[: len(least)]] = 0
    around = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    around[width - 1 : width - 1 + len(least)] = least
    taken = (_sliding(around, width, np.maximum) == seeds) & (seeds != _TOP)
    at = np.flatnonzero(taken)
    return at, seeds[at]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), key.alias("key"), F.col(text_col).alias("text"))


def _seeds(rows: DataFrame, min_words: int) -> DataFrame:
    """(seed, doc_id, key, place): retained seeds of every text, place counted in words."""

    def select(batches):
        for part, texts in slices(batches):
            t = Texts(texts)
            starts, _, words = plain_words(t)
            bounds = t.bounds(starts)
            at, seeds = minimisers(words, bounds, SEED_WORDS, min_words)
            doc = np.searchsorted(bounds[1:], at, "right")
            own = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), part.column("doc_id").take(own), part.column("key").take(own), pa.array((at - bounds[doc]).astype(np.int32))], ["seed", "doc_id", "key", "place"])

    return rows.mapInArrow(select, "seed long, doc_id long, key long, place int")


def _suffixes(rows: DataFrame, places: DataFrame, min_words: int) -> DataFrame:
    """For each retained place: after (hashes of min_words words from there on) and before (of those before it, the nearest first), 0 where the text ends.

    Of the windows of min_words words around a seed, those whose first least seed it is are its own: they have `least` to `most`
    words from the seed on. So each window of a text is the work of one seed, and of the same one wherever it stands.
    """

    def cut(batches):
        back = min_words - SEED_WORDS
        for part, texts in slices(batches):
            t = Texts(texts)
            starts, _, words = plain_words(t)
            bounds = t.bounds(starts)
            held = part.column("places")
            count = np.diff(np.asarray(held.offsets))
            doc = np.repeat(np.arange(len(texts)), count)
            place = np.asarray(held.flatten())
            seeds = np.append(windows(words, SEED_WORDS), np.full(min(len(words), SEED_WORDS - 1), _TOP))
            if len(texts) > 1:
                owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
                ahead = np.minimum(np.arange(len(words)) + SEED_WORDS - 1, len(words) - 1)
                seeds[owner[ahead] != owner] = _TOP
            short = words.astype(np.uint32) & np.uint32((1 << 8 * WORD_BYTES) - 1)
            short[short == 0] = 1
            for low in range(0, len(place), 1 << 14):
                at, own = place[low : low + (1 << 14)].astype(np.int64), doc[low : low + (1 << 14)]
                here = bounds[own] + at
                sides = []
                for steps in (np.arange(min_words), -1 - np.arange(back)):
                    where = here[:, None] + steps
                    inside = (where >= bounds[own][:, None]) & (where < bounds[own + 1][:, None])
                    found = np.where(inside, short[np.clip(where, 0, len(short) - 1)], 0).astype(">u4")
                    packed = np.ascontiguousarray(found.view(np.uint8).reshape(len(at), len(steps), 4)[:, :, 4 - WORD_BYTES :])
                    sides.append(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1, dtype=np.int32) * len(steps) * WORD_BYTES).tobytes()), pa.py_buffer(packed.tobytes())]))
                mine, near = seeds[here][:, None], []
                for steps, better in ((-1 - np.arange(back), np.less_equal), (1 + np.arange(back), np.less)):
                    where = here[:, None] + steps
                    inside = (where >= bounds[own][:, None]) & (where < bounds[own + 1][:, None])
                    beaten = better(np.where(inside, seeds[np.clip(where, 0, len(seeds) - 1)], _TOP), mine) & inside
                    near.append(np.where(beaten.any(axis=1), beaten.argmax(axis=1), back))
                least, most = min_words - near[0], SEED_WORDS + near[1]
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("key").take(take), pa.array(at.astype(np.int32)), *sides, pa.array(least.astype(np.int32)), pa.array(most.astype(np.int32))], _NAMES)

    may = split_by(rows, places, ["doc_id", "key"])[0]
    return may.join(places.hint("merge"), ["doc_id", "key"]).select("doc_id", "key", "text", "places").mapInArrow(cut, _SUFFIX)


def _words(column, n_words: int) -> np.ndarray:
    """Words of a column of suffixes, as a matrix of numbers; 0 beyond the text."""
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, n_words, WORD_BYTES).astype(np.uint64)
    out = packed[:, :, 0]
    for k in range(1, WORD_BYTES):
        out = out << np.uint64(8) | packed[:, :, k]
    return out


def _prefixes(words: np.ndarray) -> np.ndarray:
    """Hash of the first 0, 1, 2, ... words of each row."""
    out = np.zeros((len(words), words.shape[1] + 1), np.uint64)
    for k in range(words.shape[1]):
        out[:, k + 1] = (out[:, k] + words[:, k] + np.uint64(1)) * _BASE
        out[:, k + 1] ^= out[:, k + 1] >> np.uint64(31)
    return out


def matched_words(after: np.ndarray, before: np.ndarray, least: np.ndarray, most: np.ndarray, min_words: int, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, int]]]:
    """For rows in order of their places: how far each one's repeated words go to the left and right of its seed (0, 0: none); and the open windows.

    A row is put beside its neighbours for each share of min_words words between left and right: sorted by those words,
    equal rows stand together, and all but the first of them repeat it. So a row's words are the union of all windows
    of min_words words around its seed, `least` to `most` of them from the seed on, that an earlier row of these has too. Of `cut` rows the windows that no earlier row
    of these has are open: (rows, hashes of the windows, words to the right).
    """
    n = len(after)
    right, left, still = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    ahead, behind = _prefixes(after), _prefixes(before)
    for j in range(SEED_WORDS, min_words + 1):
        k = min_words - j
        held = (after[:, j - 1] != 0) & (least <= j) & (j <= most)
        if k:
            held &= before[:, k - 1] != 0
        rows = np.flatnonzero(held)
        found = mixed(ahead[rows, j] + behind[rows, k] * _BASE)
        order = np.argsort(found, kind="stable")
        again = np.zeros(len(rows), bool)
        again[1:] = found[order][1:] == found[order][:-1]
        later = rows[order[again]]
        left[later] = np.maximum(left[later], k)
        right[later] = np.maximum(right[later], j)
        lone = order[~again]
        lone = lone[cut[rows[lone]]]
        if len(lone):
            still.append((rows[lone], mixed(found[lone] + np.uint64(j)), j))
    return left, right, still


_FOUND = "doc_id long, key long, place int, low int, high int, window long"


def _compared(suffixes: DataFrame, min_words: int) -> DataFrame:
    """Of `suffixes`, which come sorted within their partitions: words that an earlier place repeats (low to high), and open windows, with their hash in `window`.

    The rows of a seed are compared at once, CHUNK of them at most. If others may lie elsewhere (a partition's first and last
    seed, and seeds of over CHUNK rows), each window that no earlier row here has is open.
    """
    back = min_words - SEED_WORDS
    seed_bytes = SEED_WORDS * WORD_BYTES

    def settle(table: pa.Table, cut: np.ndarray):
        after, before = _words(table.column("after"), min_words), _words(table.column("before"), back)
        doc, key, place, least, most = (table.column(c).to_numpy() for c in ("doc_id", "key", "place", "least", "most"))
        order = np.lexsort((place, key, doc))
        doc, key, place = doc[order], key[order], place[order]
        left, right, still = matched_words(after[order], before[order], least[order], most[order], min_words, cut[order])

        def batch(rows, low, high, window):
            columns = [pa.array(doc[rows]), pa.array(key[rows]), pa.array(place[rows]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), window]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "place", "low", "high", "window"])

        rows = np.flatnonzero(right)
        if len(rows):
            yield batch(rows, place[rows] - left[rows], place[rows] + right[rows], pa.nulls(len(rows), pa.int64()))
        for rows, hashes, j in still:
            yield batch(rows, place[rows] - (min_words - j), place[rows] + j, pa.array(hashes.view(np.int64)))

    def compare(batches):
        held, first_seed = None, None
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b]).select(_NAMES)
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows > CHUNK:
                seeds = np.array([x[:seed_bytes] for x in held.column("after").slice(0, CHUNK + 1).to_pylist()], object)
                if first_seed is None:
                    first_seed = seeds[0]
                whole = CHUNK
                while whole and seeds[whole] == seeds[whole - 1]:
                    whole -= 1
                cut = seeds[: whole or CHUNK] == first_seed if whole else np.ones(CHUNK, bool)
                yield from settle(held.slice(0, whole or CHUNK), cut)
                if not whole:
                    first_seed = seeds[0]
                held = held.slice(whole or CHUNK)
        if held is not None and held.num_rows:
            seeds = np.array([x[:seed_bytes] for x in held.column("after").to_pylist()], object)
            yield from settle(held, (seeds == (seeds[0] if first_seed is None else first_seed)) | (seeds == seeds[-1]))

    return suffixes.mapInArrow(compare, _FOUND)


def _repeats(suffixes: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, key, low, high): words that an earlier place has.

    What chunks and partitions leave open meets by the hash of each window, where the least place keeps it.
    """
    order = ["after", "before", "doc_id", "key", "place"]
    # Ranges go by few words and the place: Spark draws them from a sample of these columns on the driver.
    ranged = suffixes.repartitionByRange(F.substring("after", 1, RANGE_WORDS * WORD_BYTES), "key", "place").sortWithinPartitions(*order)
    found = written(_compared(ranged, min_words))
    still = found.filter("window IS NOT NULL")
    least = F.min(F.struct("doc_id", "key", "place")).alias("least")
    groups = written(still.groupBy("window").agg(least, F.count(F.lit(1)).alias("n")).filter("n > 1"))
    later = join_counted(still, groups, "window", "n").filter(F.struct("doc_id", "key", "place") != F.col("least"))
    later = later.groupBy("doc_id", "key", "place").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("place")
    return found.filter("window IS NULL").select("doc_id", "key", "low", "high").union(later)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, spans) for each text of `docs` in which passages of `min_words` words or more repeat that an earlier place has.

    Words are as in near_dedup. Of places with one passage, that of the least id (null least), and there the first, keeps it;
    the others are in spans, an array of (start, end) in words, in order and apart. key is a hash of the text; with the id it
    names a text: rows that repeat both are one text. Texts with fewer than `min_words` words, empty or null have no passages.
    Seeds that occur once are dropped; the other suffixes are sorted by range over their words and places, so that a passage
    that a third of all documents share is spread over tasks like any other. Its rows meet in chunks; what a chunk leaves open
    meets window by window.
    """
    rows = _keyed(docs, id_col, text_col)
    seeds = written(_seeds(rows, min_words))
    counts = written(seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = join_counted(seeds, counts, "seed", "n")
    places = written(shared.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("place")).alias("places")))
    later = _repeats(_suffixes(rows, places, min_words), min_words)
    ranges = later.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("ranges"))
    joined_up = F.aggregate(
        "ranges",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, r: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= r["low"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], r["high"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(F.struct(r["low"].alias("start"), r["high"].alias("end"))))),
    )
    return ranges.select(F.when(F.col("doc_id") != -(2**63), F.col("doc_id")).alias(id_col), "key", joined_up.alias("spans"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the spans of repeated_passages cut out of their texts; other rows and columns are as they are, null texts too.

    From the first to the last word of a span all goes; what stands around it stays. A document is never dropped.
    """
    least = F.lit(-(2**63))
    spans = repeated_passages(docs, min_words, id_col, text_col).select(F.coalesce(F.col(id_col), least).alias("__id"), F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    keyed = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), least)).withColumn("__key", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    spans = written(spans)
    may, rest = split_by(keyed, spans, ["__id", "__key"])
    joined = may.join(spans.hint("merge"), ["__id", "__key"], "left").drop("__id", "__key")
    names = joined.columns

    def cut(batches):
        for part, texts in slices(batches, text_col):
            held = part.column("__spans").to_pylist()
            if any(held):
                t = Texts(texts)
                starts, ends, _ = plain_words(t)
                bounds = t.bounds(starts)
                column = part.column(text_col).to_pylist()
                for i, own in enumerate(held):
                    if own:
                        kept, last = [], 0
                        for s in own:
                            low = int(starts[bounds[i] + s["start"]] - t.starts[i])
                            kept.append(texts[i][last:low])
                            last = int(ends[bounds[i] + s["end"] - 1] - t.starts[i])
                        column[i] = "".join([*kept, texts[i][last:]])
                part = part.set_column(names.index(text_col), text_col, pa.array(column, pa.string()))
            yield part.drop_columns(["__spans"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return joined.select(*docs.columns, "__spans").mapInArrow(cut, schema).unionByName(rest.select(*docs.columns))
