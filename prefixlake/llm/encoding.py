"""BPE through a table of distinct words: split in Spark, encode each word once, put ids back by position; decode by pieces."""

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.llm.bpe import checked_path, vocabulary
from prefixlake.llm.spans import Texts, ragged, slices

#: Code points whose distinct words are kept together; a longer text is a block of its own.
BLOCK = 1 << 24
#: A word's position in all blocks: block * MOST_WORDS + place in the block. A text, of 2^31 bytes at most, has fewer words.
MOST_WORDS = 1 << 31
#: Blocks of a task at most, 2^31 / BLOCK_NUMBERS tasks at most.
BLOCK_NUMBERS = 1 << 12
#: Ids of one text at most: Spark holds no longer binary value.
MOST_IDS = (1 << 29) - 1
#: Words that a task groups by block before it sends their ids back.
GROUPED = 1 << 20
#: Pre-tokens in a batch of results.
BATCH_WORDS = 1 << 19
#: Starts the name of an added token among the words; no pre-token has both this and a letter.
ADDED = "\x00id"


#: Names of the tables of blocks start so.
BLOCKS = "word_blocks_"


def drop_blocks(spark: SparkSession) -> None:
    """Drop this session's tables of blocks; call it when what `encode` returned has been read."""
    for t in spark.catalog.listTables(pattern=f"{BLOCKS}*"):
        spark.sql(f"DROP TABLE IF EXISTS {t.name}")


class _Block:
    """The documents of a block: each pre-token as the number of its word, each distinct word once."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)
        self.numbers = np.zeros(0, np.int64)
        self.words: list[str] = []
        self.which: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.size = 0

    def add(self, ids: list[int | None], t: Texts, vocab) -> None:
        starts, which, keys, first, last, special = vocab.distinct(t)
        where = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        near = where < len(self.keys)
        new[near] = self.keys[where[near]] != keys[near]
        fresh = np.arange(len(self.words), len(self.words) + int(new.sum()))
        rows = zip(first[new].tolist(), last[new].tolist(), special[new].tolist(), strict=True)
        self.words += [t.text[a:b] if i < 0 else f"{ADDED}{i}" for a, b, i in rows]
        self.keys = np.insert(self.keys, where[new], keys[new])
        self.numbers = np.insert(self.numbers, where[new], fresh)
        self.which.append(self.numbers[np.searchsorted(self.keys, keys)][which].astype(np.uint32))
        self.ids += ids
        self.counts += np.diff(t.bounds(starts)).tolist()
        self.size += len(t.cps)

    def row(self, number: int) -> pa.RecordBatch:
        """Words by rough frequency and then in order of the alphabet, and numbers in planes of bytes: both pack well."""
        which = np.concatenate(self.which)
        rough = np.log2(np.bincount(which, minlength=len(self.words))).astype(int).tolist()
        order = sorted(range(len(self.words)), key=lambda i: (-rough[i], self.words[i]))
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([self.ids], pa.list_(pa.int64())),
                pa.array([self.counts], pa.list_(pa.int64())),
                pa.array([[self.words[i] for i in order]], pa.list_(pa.string())),
                pa.array([_pack(rank[which])], pa.binary()),
            ],
            ["block", "ids", "counts", "words", "which"],
        )


def _pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte planes apart, compressed."""
    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


_BLOCK_SCHEMA = "block long, ids array<long>, counts array<long>, words array<string>, which binary"


def split_words(docs: DataFrame, path: str) -> DataFrame:
    """`docs` (doc_id, text) as blocks, in a table of the shared warehouse that is bucketed by block, so that ids come to it and it does not move."""
    spark = docs.sparkSession

    def split(batches):
        vocab = vocabulary(path)
        number, block = TaskContext.get().partitionId() * BLOCK_NUMBERS, _Block()
        for rows, texts in slices(batches):
            block.add(rows.column("doc_id").to_pylist(), Texts(texts), vocab)
            if block.size >= BLOCK:
                yield block.row(number)
                number, block = number + 1, _Block()
                if number % BLOCK_NUMBERS == 0:
                    raise ValueError("a task of over 64 billion code points: split the input in more partitions")
        if block.ids:
            yield block.row(number)

    name = f"{BLOCKS}{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs.mapInArrow(split, _BLOCK_SCHEMA).write.option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(name)
    return spark.table(name)


def encode(docs: DataFrame, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, n_tokens, ids) of every row: ids as the tokenizers library gives them without special tokens around, packed as unsigned little-endian 32-bit.

    Null texts are empty (no ids); whole texts of any length; rows that repeat an id each get a row; other columns are not
    read. A text may have any number of distinct words and up to MOST_IDS ids, which is what a binary value of Spark can hold.
    Each distinct word is merged once: words of all blocks meet by word, a word at most once from each block, so
    that no word is hot; its ids go back to their block by position. With `decoded` each row also has what `decode` adds,
    made in the same tasks.
    """
    path = checked_path(vocabulary_path)
    blocks = split_words(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), path)
    found = blocks.select("block", F.posexplode("words").alias("place", "word")).select((F.col("block") * MOST_WORDS + F.col("place")).alias("at"), "word")

    def merge(batches):
        merge_word, last, ids = vocabulary(path).merge, None, []
        places, sizes, flat = [], [], []
        for b in batches:
            places.append(b.column("at").to_numpy())
            for word in b.column("word").to_pylist():
                if word != last:
                    last = word
                    ids = [int(word[len(ADDED) :])] if word.startswith(ADDED) else merge_word(word)
                sizes.append(len(ids))
                flat += ids
            if len(sizes) >= GROUPED:
                yield from _by_block(places, sizes, flat)
                places, sizes, flat = [], [], []
        yield from _by_block(places, sizes, flat)

    merged = found.repartition("word").sortWithinPartitions("word", "at").mapInArrow(merge, "block long, packed array<binary>")
    by_block = merged.groupBy("block").agg(F.collect_list("packed").alias("merged"))
    whole = blocks.select("block", F.col("ids").alias("doc_ids"), "counts", "which").hint("merge").join(by_block.hint("merge"), "block", "left")

    def assemble(batches):
        for b in batches:
            for row in range(b.num_rows):
                yield from _assembled(b.slice(row, 1))

    def assemble_and_decode(batches):
        return _decoded(assemble(batches), path, "ids")

    schema = "doc_id long, n_tokens long, ids binary"
    if decoded:
        return whole.drop("block").mapInArrow(assemble_and_decode, f"{schema}, decoded string").withColumnRenamed("doc_id", id_col)
    return whole.drop("block").mapInArrow(assemble, schema).withColumnRenamed("doc_id", id_col)


def _by_block(places: list[np.ndarray], sizes: list[int], flat: list[int]):
    """Places, numbers of ids and ids of merged words, packed for each block."""
    if not sizes:
        return
    at, size, ids = np.concatenate(places), np.array(sizes, np.int64), np.array(flat, np.uint32)
    starts = np.cumsum(size) - size
    order = np.argsort(at)
    block = at[order] // MOST_WORDS
    first = np.flatnonzero(np.diff(block, prepend=-1))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        rows = order[a:b]
        place = at[rows] % MOST_WORDS
        parts = [_pack(np.diff(place, prepend=0)), _pack(size[rows]), _pack(ids[ragged(starts[rows], size[rows])])]
        yield pa.RecordBatch.from_arrays([pa.array([block[a]], pa.int64()), pa.array([parts], pa.list_(pa.binary()))], ["block", "packed"])


def _assembled(row: pa.RecordBatch):
    doc_ids, counts = row.column("doc_ids").flatten(), row.column("counts").flatten().to_numpy()
    parts = [[_unpack(x) for x in p] for p in row.column("merged")[0].as_py() or []]
    place, size, flat = (np.concatenate([np.zeros(0, np.uint32), *(p[k] if k else np.cumsum(p[k]) for p in parts)]).astype(np.int64 if k < 2 else "<u4") for k in range(3))
    starts, sizes = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    starts[place], sizes[place] = np.cumsum(size) - size, size
    which = _unpack(row.column("which")[0].as_py())
    first = np.concatenate(([0], np.cumsum(counts)))
    step = 0
    while step < len(counts):
        end = max(step + 1, int(np.searchsorted(first, first[step] + BATCH_WORDS, "right")) - 1)
        words = which[first[step] : first[end]]
        own = sizes[words]
        sums = np.concatenate(([0], np.cumsum(own)))[first[step : end + 1] - first[step]]
        data = flat[ragged(starts[words], own)]
        if len(data) > MOST_IDS:
            raise ValueError("a text of over half a billion tokens")
        ids = pa.Array.from_buffers(pa.binary(), end - step, [None, pa.py_buffer((sums * 4).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
        yield pa.RecordBatch.from_arrays([doc_ids.slice(step, end - step), pa.array(np.diff(sums)), ids], ["doc_id", "n_tokens", "ids"])
        step = end


def _decoded(batches, path: str, ids_col: str):
    vocab = vocabulary(path)
    for b in batches:
        text = [None if x is None else vocab.decode_bytes(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in b.column(ids_col).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, "decoded"])


def decode(encoded: DataFrame, vocabulary_path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """`encoded` with decoded (string): the pieces of its packed ids in a row, as UTF-8 with replacement marks for broken parts.

    The table from id to piece has as many rows as the vocabulary file, whatever the input; every task holds it as arrays
    and joins by position. Null ids give a null; an id that the vocabulary lacks fails the job.
    """
    path = checked_path(vocabulary_path)
    schema = ", ".join([f"`{c}` {t}" for c, t in encoded.dtypes] + ["decoded string"])
    return encoded.mapInArrow(lambda batches: _decoded(batches, path, ids_col), schema)
