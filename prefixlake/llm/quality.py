"""Quality rules: counts by text, and an isolation forest over them whose threshold labelled rows set."""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.shared import without, written
from prefixlake.llm.spans import Texts, slices, span_hashes, windows

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("symbol_share", "dup_line_share", "repeat_share", "mean_word", "upper_share", "digit_share", "mark_share", "words_by_line", "distinct_share")
TREES, DEPTH = 150, 10
#: Scores are given in steps of 1 / STEPS, so that labelled rows can be counted by score.
STEPS = 1 << 16
#: What is 1 in the forest: of mean_word and words_by_line; the other shares are 0 to 1 as they are.
TOPS = {"mean_word": 20.0, "words_by_line": 10.0}
#: Of labelled good rows, at most this share may be rejected by the threshold.
GOOD_LOSS = 0.005
#: Labelled good rows from which on the threshold is set by held-out ones.
HELD_OUT = 400
SEED = 8


@lru_cache(1)
def _classes() -> np.ndarray:
    """Bits by code point: 1 blank, 2 symbol, 4 upper case, 8 digit, 16 other ASCII mark."""
    kind = np.zeros(0x110000, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] |= 1
    kind[[ord(c) for c in SYMBOLS]] |= 2
    kind[0x30:0x3A] |= 8
    for a, b in ((0x21, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x7F)):
        kind[a:b] |= 16
    for c in range(0x41, 0x2100):
        if chr(c).isupper():
            kind[c] |= 4
    return kind


def _sums(flags: np.ndarray, t: Texts) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[t.ends] - total[t.starts]


def _again(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: does an equal one of the same owner stand before it; is there any other equal one."""
    order = np.lexsort((hashes, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    later, shared = np.zeros(len(order), bool), np.zeros(len(order), bool)
    later[order[1:]] = same
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    return later, shared


def count_texts(texts: list[str]) -> dict[str, np.ndarray]:
    """COUNTS and SHARES of whole texts."""
    t = Texts(texts)
    kind = _classes()[t.cps]
    starts, ends = t.runs((kind & 1) == 0)
    bounds = t.bounds(starts)
    n_words = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), n_words)
    hashes = span_hashes(t.cps, starts, ends)
    out = {"n_words": n_words, "word_chars": _sums((kind & 1) == 0, t), "n_symbols": _sums(kind & 2 != 0, t)}
    out["word_chars"] = np.bincount(owner, ends - starts, len(texts)).astype(np.int64)

    line_starts, line_ends = t.runs(t.cps != 0x0A)
    words_before = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    full = words_before[1] > words_before[0]
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_owner = t.owner(line_starts)
    later, _ = _again(line_owner, span_hashes(t.cps, line_starts, line_ends))
    n_lines = np.bincount(line_owner, minlength=len(texts))
    out["n_dup_lines"] = np.bincount(line_owner, later, len(texts)).astype(np.int64)

    within = np.zeros(len(hashes), bool)
    if len(hashes) >= 3:
        threes = windows(hashes, 3)
        whole = owner[2:] == owner[:-2]
        at = np.flatnonzero(whole)
        _, shared = _again(owner[at], threes[at])
        for k in range(3):
            within[at[shared] + k] = True
    out["n_repeat_words"] = np.bincount(owner, within, len(texts)).astype(np.int64)

    words, chars = np.maximum(n_words, 1), np.maximum(out["word_chars"], 1)
    first, _ = _again(owner, hashes)
    out |= {
        "symbol_share": out["n_symbols"] / chars,
        "dup_line_share": out["n_dup_lines"] / np.maximum(n_lines, 1),
        "repeat_share": out["n_repeat_words"] / words,
        "mean_word": out["word_chars"] / words,
        "upper_share": _sums(kind & 4 != 0, t) / chars,
        "digit_share": _sums(kind & 8 != 0, t) / chars,
        "mark_share": _sums(kind & 16 != 0, t) / chars,
        "words_by_line": np.log1p(n_words / np.maximum(n_lines, 1)),
        "distinct_share": 1 - np.bincount(owner, first, len(texts)) / words / np.log2(words + 2),
    }
    return out


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, COUNTS (long), SHARES (double) and base_failed of every row of `docs`; a null text has no words.

    Words are runs without ASCII white space; other columns are not read; a text of any length is counted whole.
    """

    def count(batches):
        for rows, texts in slices(batches):
            found = count_texts(texts)
            columns = [rows.column("doc_id")] + [pa.array(found[c].astype(np.int64)) for c in COUNTS] + [pa.array(found[c].astype(np.float64)) for c in SHARES]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, *SHARES])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in SHARES)])
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumnRenamed("doc_id", id_col)


class IsolationForest:
    """Trees of random splits over rows with columns from 0 to 1; odd rows end on short paths. Arrays only, so that it goes to tasks as it is.

    Splits are drawn from the whole of a node's box, not from the reach of its rows: so all trees can be drawn before any row is
    seen, and are fitted by counting, over all rows, how many pass each node (`passed`, which adds up over tasks). What lies far
    outside the rows is parted from them early, and a column in which all rows are alike still counts.
    """

    def __init__(self, columns: int = len(SHARES), trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.depth, self.norm = depth, 0.0
        self.column = rng.integers(columns, size=(trees, 1 << depth)).astype(np.int8)
        self.cut = np.zeros(self.column.shape, np.float32)
        self.length = np.zeros((trees, 2 << depth), np.float32)
        at = np.arange(trees)
        low, high = {1: np.zeros((trees, columns))}, {1: np.ones((trees, columns))}
        for node in range(1, 1 << depth):
            below, above, c = low.pop(node), high.pop(node), self.column[:, node]
            cut = self.cut[:, node] = rng.uniform(below[at, c], above[at, c])
            low[2 * node], high[2 * node + 1] = below, above
            low[2 * node + 1], high[2 * node] = below.copy(), above.copy()
            low[2 * node + 1][at, c] = high[2 * node][at, c] = cut

    def _leaves(self, rows: np.ndarray):
        """By tree: the node of the last level that each row ends in."""
        at = np.arange(len(rows))
        for column, cut in zip(self.column, self.cut, strict=True):
            node = np.ones(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (rows[at, column[node]] >= cut[node])
            yield node

    def passed(self, rows: np.ndarray) -> np.ndarray:
        """How many rows end in each node of the last level: [tree, node]."""
        return np.array([np.bincount(leaf - (1 << self.depth), minlength=1 << self.depth) for leaf in self._leaves(rows)], np.int64)

    def fit(self, counts: np.ndarray) -> "IsolationForest":
        """Set path lengths by `passed` of all rows: to the first node that none of them passes, or the last level and what a tree would go on with."""
        self.norm = _mean_path(int(counts[0].sum()))
        size = 1 << self.depth
        self.length[:, size:] = self.depth + np.where(counts > 1, _mean_paths(np.maximum(counts, 2)), 0)
        for level in range(self.depth - 1, -1, -1):
            held = counts.reshape(len(counts), 1 << level, -1).sum(2) == 0
            wide = np.repeat(held, size >> level, 1)
            self.length[:, size:][wide] = level
        return self

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1, in steps of 1 / STEPS; the higher, the odder."""
        total = np.zeros(len(rows))
        for leaf, length in zip(self._leaves(rows), self.length, strict=True):
            total += length[leaf]
        return np.round(2.0 ** (-total / len(self.column) / max(self.norm, 1e-9)) * STEPS) / STEPS


def scaled(values: np.ndarray) -> np.ndarray:
    """Columns SHARES, cut to 0 to 1."""
    return np.clip(values / np.array([TOPS.get(c, 1.0) for c in SHARES]), 0, 1).astype(np.float32)


def _mean_paths(n: np.ndarray) -> np.ndarray:
    return np.where(n == 2, 1.0, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / n)


def _mean_path(n: int) -> float:
    return 0.0 if n < 2 else float(_mean_paths(np.array(n)))


def calibrated(scores: np.ndarray, good: np.ndarray, bad: np.ndarray, good_loss: float = GOOD_LOSS) -> float:
    """The score above which a row is rejected: the cut with the most bad less good rows beyond it that rejects at most `good_loss` of the good ones. `good` and `bad` count the rows of each of the distinct `scores`."""
    order = np.argsort(-scores)
    bad_beyond, good_beyond = np.cumsum(bad[order]), np.cumsum(good[order])
    gain = np.where(good_beyond <= good_loss * good.sum(), bad_beyond / max(bad.sum(), 1) - good_beyond / max(good.sum(), 1), 0)
    if not len(gain) or gain.max() <= 0:
        return float("inf")
    k = int(gain.argmax())
    return float((scores[order][k] + (scores[order][k + 1] if k + 1 < len(order) else scores[order][k] - 1e-9)) / 2)


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return scaled(np.column_stack([batch.column(c).to_numpy() for c in SHARES]) if batch.num_rows else np.zeros((0, len(SHARES))))


def fit(statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> tuple[IsolationForest | None, float]:
    """A forest over labelled good rows, and its threshold, set by labelled rows that the forest was not fitted to.

    Every labelled row counts: a hash of its id says for which of the two (under HELD_OUT good rows all are for both). Only
    counts come to the driver, by node and by score, however many rows there are; without labelled good rows there is no forest.
    """
    marked = labels.filter("quality IS NOT NULL").groupBy(id_col).agg((F.max("quality") == 1).alias("__good"))
    half = F.pmod(F.xxhash64(id_col), F.lit(2)) == 0
    labelled = written(statistics.filter("NOT base_failed").join(marked, id_col).select(*SHARES, "__good", half.alias("__first")))
    n = labelled.filter("__good").count()
    if n < 2:
        return None, float("inf")
    first, rest = ("__first", "NOT __first") if n >= HELD_OUT else ("true", "true")
    drawn = IsolationForest()

    def count(batches):
        total = np.zeros((TREES, 1 << DEPTH), np.int64)
        for b in batches:
            total += drawn.passed(_values(b))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["node", "n"])

    found = labelled.filter(f"__good AND {first}").select(*SHARES).mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(TREES << DEPTH, np.int64)
    counts[found.column("node").to_numpy()] = found.column("n").to_numpy()
    forest = drawn.fit(counts.reshape(TREES, -1))

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest.scores(_values(b))), b.column("__good")], ["score", "good"])

    by_score = labelled.filter(rest).select(*SHARES, "__good").mapInArrow(score, "score double, good boolean").groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toArrow()
    return forest, calibrated(*(by_score.column(c).to_numpy() for c in ("score", "good", "bad")))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of every row with score and kept: false if base_failed, else if the forest's score is over the threshold.

    Where no labelled row exists, base_failed alone decides and scores are null. Rows that repeat an id each get a row.
    """
    statistics = written(rule_statistics(docs, id_col, text_col))
    forest, threshold = fit(statistics, labels, id_col)
    if forest is None:
        return statistics.withColumn("score", F.lit(None).cast("double")).withColumn("kept", ~F.col("base_failed"))
    names = statistics.columns

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.scores(_values(b)))], [*names, "score"])

    schema = ", ".join([f"`{c}` {t}" for c, t in statistics.dtypes] + ["score double"])
    return statistics.mapInArrow(score, schema).withColumn("kept", ~F.col("base_failed") & (F.col("score") <= threshold))


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, with all their columns. Rows that share an id stay if any of them is kept."""
    rejected = judge(docs, labels, id_col, text_col).groupBy(id_col).agg(F.max("kept").alias("kept")).filter("NOT kept").select(F.col(id_col).alias("__id"))
    return without(docs.withColumn("__id", F.col(id_col).cast("long")), written(rejected), ["__id"]).drop("__id")
