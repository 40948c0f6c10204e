"""Near-duplicate documents: improved consistent weighted sampling of TF-IDF word shingles, in bands, then verified."""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.llm.shared import join_counted, split_by, without, written
from prefixlake.llm.spans import Texts, mixed, plain_words, powers, slices

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
#: Weights run from 1 (a shingle in every document) to 1 + IDF_SPAN (in one of COMMON documents or fewer).
IDF_SPAN = 0.25
#: IDF tells apart the shingles that stand in more than one of so many documents; those in fewer all have the greatest weight.
COMMON = 1000
#: Shingles that a task counts at once, in one array of 8 bytes each; ranges of them that are packed at once; and hash ranges by shuffle partition in which counts meet.
COUNTED, PACKED, RANGES = 1 << 22, 64, 8
#: Code points in a slice of texts while shingles are counted and signed: what a slice takes besides is some 100 bytes for each.
SLICE = 1 << 18
#: Of a bucket: members that meet the leaders in one block, leaders held at once, and leaders of the first round, and how many times as many each later one has.
BLOCK, HELD, LEADERS, MORE = 500, 64, 16, 8
#: Ranges of sizes between that of a text and that of the smallest one which may link to it.
CELLS = 4
MAX_ROUNDS = 100


def _digests(words: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    ends = bounds.tolist()
    return [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() if b > a else b"" for a, b in zip(ends[:-1], ends[1:], strict=True)]


def word_digests(texts: list[str]) -> list[bytes]:
    """A digest of the words of each text; empty if it has none."""
    t = Texts(texts)
    starts, _, words = plain_words(t)
    return _digests(words, t.bounds(starts))


def shingle_sets(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Distinct shingles of all texts, by text: owner, hash and count; and a digest of each text's words (empty if it has none).

    A text of fewer than WIDTH words is one shingle.
    """
    starts, _, words = plain_words(t)
    bounds = t.bounds(starts)
    n_words = np.diff(bounds)
    digests = _digests(words, bounds)
    owner = np.repeat(np.arange(len(n_words), dtype=np.int64), n_words)
    n = len(words) - WIDTH + 1
    if n > 0:
        base, rolled = powers(WIDTH + 1)[0][1], np.zeros(n, np.uint64)
        for k in range(WIDTH):
            rolled = rolled * base + words[k : k + n]
        whole = owner[WIDTH - 1 :] == owner[:n]
        shingles, owners = mixed(rolled[whole]), owner[:n][whole]
    else:
        shingles, owners = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < WIDTH))
    if len(short):
        own = np.array([int.from_bytes(digests[i][:8], "little") for i in short.tolist()], np.uint64)
        shingles, owners = np.concatenate((shingles, own)), np.concatenate((owners, short))
    order = np.argsort(shingles)
    order = order[np.argsort(owners[order].astype(np.uint16 if len(n_words) < 1 << 16 else np.int64), kind="stable")]
    shingles, owners = shingles[order], owners[order]
    new = np.ones(len(order), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owners[1:] != owners[:-1])
    first = np.flatnonzero(new)
    return owners[first], shingles[first], np.diff(np.append(first, len(order))), digests


def _packed_counts(shingles: np.ndarray, bits: int):
    """Distinct shingles and their counts, by the range that their first `bits` name: gaps as byte planes, compressed; counts where one is over 1.

    `shingles` is sorted where it is, and only one range of it is copied at a time.
    """
    shingles.sort()
    pack = zstandard.ZstdCompressor(1).compress
    names, gaps, numbers = [], [], []

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(gaps, pa.binary()), pa.array(numbers, pa.binary())], ["range", "gaps", "counts"])

    i = 0
    while i < len(shingles):
        name = int(shingles[i]) >> (64 - bits)
        last = np.uint64(((name + 1) << (64 - bits)) - 1)
        j = i + int(np.searchsorted(shingles[i:], last, "right"))
        first = np.flatnonzero(np.append(True, shingles[i + 1 : j] != shingles[i : j - 1]))
        counts = np.diff(first, append=j - i)
        names.append(name)
        gaps.append(pack(np.ascontiguousarray(np.diff(shingles[i:j][first], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()))
        numbers.append(pack(counts.astype("<u4").tobytes()) if len(first) < j - i else b"")
        i = j
        if len(names) == PACKED:
            yield rows()
            names, gaps, numbers = [], [], []
    if names:
        yield rows()


def _unpacked_counts(gaps: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    planes = np.frombuffer(unpack(gaps), np.uint8).reshape(8, -1)
    keys = np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)
    return keys, np.frombuffer(unpack(counts), "<u4").astype(np.int64) if counts else np.ones(len(keys), np.int64)


def document_frequencies(docs: DataFrame, least: int) -> DataFrame:
    """(shingle, df): in how many rows of `docs` (text) each shingle stands that stands in `least` or more, exactly, over all rows and whole texts.

    Tasks count COUNTED shingles at a time before the shuffle, so no shingle is hot; counts meet by range of the hash, and
    there are RANGES ranges for each shuffle partition.
    """
    bits = max(1, (RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())

    def count(batches):
        held, size = np.empty(COUNTED, np.uint64), 0
        for _, texts in slices(batches, limit=SLICE):
            found = shingle_sets(Texts(texts))[1]
            while len(found):
                some = found[: COUNTED - size]
                held[size : size + len(some)] = some
                size, found = size + len(some), found[len(some) :]
                if size == COUNTED:
                    yield from _packed_counts(held, bits)
                    size = 0
        if size:
            yield from _packed_counts(held[:size], bits)

    def add(batches):
        name, keys, counts = None, [], []

        def total():
            order = np.argsort(every := np.concatenate(keys), kind="stable")
            every = every[order]
            first = np.flatnonzero(np.diff(every, prepend=~every[0]))
            sums = np.add.reduceat(np.concatenate(counts)[order], first)
            often = sums >= least
            return pa.RecordBatch.from_arrays([pa.array(every[first][often].view(np.int64)), pa.array(sums[often])], ["shingle", "df"])

        for b in batches:
            for row in range(b.num_rows):
                if (found := b.column("range")[row].as_py()) != name:
                    if keys:
                        yield total()
                    name, keys, counts = found, [], []
                more = _unpacked_counts(b.column("gaps")[row].as_py(), b.column("counts")[row].as_py())
                keys.append(more[0])
                counts.append(more[1])
        if keys:
            yield total()

    packed = docs.select("text").mapInArrow(count, "range long, gaps binary, counts binary")
    return packed.repartition("range").sortWithinPartitions("range").mapInArrow(add, "shingle long, df long")


class Weights:
    """Weight of every shingle: 1 + IDF_SPAN * ln(n / df) / ln(n / cut), where a df below cut counts as cut = n / COMMON. Arrays only, so that it goes to tasks as it is.

    The span is narrow on purpose: with the plain logarithm the common part of a large group of near copies would weigh so
    little that its own members fell below the threshold. The cut makes weights the same at every size of the corpus.
    """

    def __init__(self, shingles: np.ndarray, df: np.ndarray, n_docs: int, cut: float):
        order = np.argsort(shingles)
        self.keys = shingles[order]
        span = max(np.log(max(n_docs, 1) / cut), 1e-9)
        own = 1 + IDF_SPAN * np.log(max(n_docs, 1) / np.maximum(df, cut)) / span
        self.values = np.append(own[order], 1 + IDF_SPAN).astype(np.float32)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(shingles), self.values[-1])
        at = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
        at[self.keys[at] != shingles] = len(self.keys)
        return self.values[at]


def idf_weights(docs: DataFrame) -> Weights:
    """Weights by document frequency among the rows of `docs` (text).

    Only shingles in more than one of COMMON rows come to the driver, 12 bytes each: their number is at most COMMON times the shingles
    of a mean document, whatever the number of documents. None is left out.
    """
    n_docs = docs.count()
    cut = max(n_docs / COMMON, 1.0)
    rows = document_frequencies(docs, int(cut) + 1).toArrow()
    return Weights(rows.column("shingle").to_numpy().view(np.uint64), rows.column("df").to_numpy(), n_docs, cut)


def weighted_samples(owner: np.ndarray, shingles: np.ndarray, weights: Weights, n_texts: int, count: int) -> np.ndarray:
    """`count` consistent samples of each text's weighted shingles, as hashes of (shingle, level): [text, sample]; 0 for texts without any.

    For sample k a shingle s draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash; with t = floor(ln w / r + b) the shingle
    with the least ln c - r (t - b) - r is taken, at level t. Two texts take the same with a chance of their weighted Jaccard.
    """
    out = np.zeros((n_texts, count), np.uint64)
    if not len(owner):
        return out
    log_w = np.log(weights.astype(np.float32))
    new = np.ones(len(owner), bool)
    new[1:] = owner[1:] != owner[:-1]
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(owner)))
    texts = owner[first]
    tiny = np.float32(2.0**-33)
    mask = np.uint64((1 << 21) - 1)
    for k in range(count):
        x = (shingles ^ mixed(np.array([k + 1], np.uint64))[0]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        y = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        u = ((x >> np.uint64(43)).astype(np.float32) + np.float32(0.5)) * (((x >> np.uint64(22)) & mask).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-42)
        r = -np.log(u)
        b = (x & mask).astype(np.float32) * np.float32(2.0**-21)
        v = ((y >> np.uint64(32)).astype(np.float32) * np.float32(2.0**-32) + tiny) * ((y & np.uint64(0xFFFFFFFF)).astype(np.float32) * np.float32(2.0**-32) + tiny)
        level = np.floor(log_w / r + b)
        value = np.log(-np.log(np.minimum(v, np.float32(1 - 2.0**-20)))) - r * (level - b) - r
        least = np.repeat(np.minimum.reduceat(value, first), sizes)
        hit = np.flatnonzero(value == least)
        hit_text = owner[hit]
        keep = np.ones(len(hit), bool)
        keep[1:] = hit_text[1:] != hit_text[:-1]
        at = hit[keep]
        out[texts, k] = mixed(shingles[at] ^ mixed(level[at].astype(np.int64).astype(np.uint64) + np.uint64(977)))
    return out


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, digest, bands) for each row of `docs`: one key for each band."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # COMMON times the shingles of a mean document at most

    def sign(batches):
        for rows, texts in slices(batches, limit=SLICE):
            owner, shingles, count, digests = shingle_sets(Texts(texts))
            found = weighted_samples(owner, shingles, sent.value.of(shingles) * count, len(texts), BANDS * ROWS)
            keys = np.zeros((len(texts), BANDS), np.uint64)
            for k in range(ROWS):
                keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + found[:, k::ROWS])
            keys = mixed(keys + np.arange(1, BANDS + 1, dtype=np.uint64))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(digests, pa.binary()), bands], ["doc_id", "digest", "bands"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, digest binary, bands array<long>")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that links lead to, for every node of `links` (a, b).

    Rounds of taking the least label among neighbours and then the label's own label, each written to the shared folder;
    labels move at least twice as far each round, so star-like groups take one or two. The rounds end when no neighbour has
    a lesser label: then each component has one, its least node. A node with many links, and a label with many nodes, are
    met by broadcast.
    """
    ways = F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    edges = written(links.select(ways.alias("way")).select("way.a", "way.b").distinct())
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"), F.count(F.lit(1)).alias("n")))
    for _ in range(MAX_ROUNDS):
        near = join_counted(edges, labels.withColumnRenamed("node", "b"), "b", "n").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = written(labels.join(near.hint("merge"), "node").select("node", "label", "n", F.least("label", "near").alias("low")))
        if step.filter("low <> label").isEmpty():
            return labels.select("node", "label")
        jump = step.groupBy("low").agg(F.count(F.lit(1)).alias("rows")).join(step.select(F.col("node").alias("low"), F.col("low").alias("far")).hint("merge"), "low")
        labels = written(join_counted(step, written(jump), "low", "rows").select("node", F.col("far").alias("label"), "n"))
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, class_id (the least id of its class), class_size, kept (true for one row of each class).

    Words are runs of ASCII letters, in lower case, and digits, and all beyond ASCII; shingles are WIDTH words. Two texts link
    when their weighted Jaccard similarity is `threshold` or more; classes are what links join. Texts of equal words are one
    from the start; of a bucket, each text is compared with the bucket's least and with LEADERS leaders. Those that then lie in
    buckets of several classes are dealt anew by the rare shingles that no two linked texts have none of in common, and compared,
    round by round, until every two texts that share one are of one class or have been compared. A text without words (null, empty)
    is a class of its own; a null id counts as the least number. Rows that repeat an id and a text: one is kept.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col(text_col).alias("text"))
    weights = idf_weights(rows)
    signed = written(signatures(rows, weights).withColumn("row", F.monotonically_increasing_id()))
    wordless = signed.filter(F.length("digest") == 0)
    worded = signed.filter(F.length("digest") > 0)
    texts = written(worded.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")).select("digest", "copies", "bands", F.col("least.row").alias("rep"), F.col("least.doc_id").alias("rep_id")))
    classes = components(_links(rows, worded, texts, weights, threshold))
    named = texts.select("digest", "copies", "rep", "rep_id").join(classes.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("digest", "copies", "rep", "rep_id", F.coalesce("label", "rep").alias("label"))
    named = written(named)
    heads = named.groupBy("label").agg(F.min(F.struct("rep_id", "rep")).alias("head"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("members"))
    heads = written(heads.select("label", "class_size", "members", F.col("head.rep_id").alias("class_id"), F.col("head.rep").alias("head")))
    by_text = written(join_counted(named, heads, "label", "members").select("digest", "copies", "class_id", "class_size", "head"))
    out = join_counted(worded.select("doc_id", "row", "digest"), by_text, "digest", "copies").select("doc_id", "class_id", "class_size", (F.col("row") == F.col("head")).alias("kept"))
    alone = wordless.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    least = F.lit(-(2**63))
    return out.unionByName(alone).select(*(F.when(F.col(c) != least, F.col(c)).alias(n) for c, n in (("doc_id", id_col), ("class_id", "class_id"))), "class_size", "kept")


def _links(rows: DataFrame, signed: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """Verified links (a, b) between texts, named by the row number of one of their documents."""
    keys = written(texts.select("rep", F.explode("bands").alias("key")))
    buckets = written(keys.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = written(join_counted(keys.join(buckets.select("key"), "key", "left_semi"), buckets, "key", "n"))
    led = written(members.filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct())
    named = texts.select("rep", "rep_id", "digest")
    wanted = led.select(F.col("a").alias("rep")).union(led.select("b")).distinct()
    needed = written(_texts_of(rows, named.join(wanted.hint("merge"), "rep", "left_semi")))
    links = new = written(_compared(_led_units(led), needed, weights, threshold))
    fame = members.groupBy("rep").agg(F.sum("n").alias("fame"))
    left = members.filter("rep <> leader").select("key", "rep").join(fame.hint("merge"), "rep")
    left, width, by_bucket = written(_unsettled(left.withColumn("label", F.col("rep")), new)), LEADERS, True
    while not left.isEmpty():
        leaders = written(_leaders(left, links, width))
        new = written(_compared(_units(left, leaders), needed, weights, threshold).distinct())
        links = links.union(new)
        left = written(_unsettled(left, new, leaders))
        if by_bucket:
            left, by_bucket = written(_by_size(_mixed(_by_prefix(left, needed, weights, threshold)), threshold)), False
        else:
            width *= MORE
    return links


def _by_prefix(left: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """The texts of `left` (rep, fame, label) with a row for each shingle of their prefix as key, their size (the sum of their weights), and the most that the size of a text may be that links to them and shares no earlier shingle.

    Shingles have one order for all texts, the rarest first; a text's prefix ends where what follows weighs less than `threshold`
    of the text. Of two texts without a common shingle in their prefixes, all that they share follows the prefix of one of them,
    and so weighs less than `threshold` of it: they do not link. So no link is lost, and large buckets of texts that only share
    what is common come apart. Texts of sizes x and y link if they share `threshold / (1 + threshold)` of x + y; if a shingle is
    the first that they share, all that they share lies from there on. That bounds y by what x has from there on.
    """
    sent = left.sparkSession.sparkContext.broadcast(weights)

    def prefixes(batches):
        for rows, texts in slices(batches):
            owner, shingles, count, _ = shingle_sets(Texts(texts))
            single = sent.value.of(shingles)
            order = np.lexsort((shingles, -single, owner))
            owner, shingles, weight = owner[order], shingles[order], single[order].astype(np.float64) * count[order]
            total = np.bincount(owner, weight, len(texts))
            done = np.cumsum(weight) - weight
            within = done - done[np.searchsorted(owner, owner)]
            lead = np.flatnonzero(total[owner] - within >= (threshold - 1e-6) * total[owner])
            size = total[owner[lead]]
            most = (size - within[lead]) * (1 + threshold) / threshold - size + 1e-5 * size
            at = pa.array(owner[lead])
            yield pa.RecordBatch.from_arrays([pa.array(shingles[lead].view(np.int64)), *(rows.column(c).take(at) for c in ("rep", "fame", "label")), pa.array(size), pa.array(most)], ["key", "rep", "fame", "label", "size", "most"])

    full = left.select("rep", "fame", "label").distinct().join(texts.hint("merge"), "rep")
    return full.mapInArrow(prefixes, "key long, rep long, fame long, label long, size double, most double")


def _by_size(left: DataFrame, threshold: float) -> DataFrame:
    """`left` of `_by_prefix` with the keys of over HELD rows parted by size: two texts meet under a key and their two ranges of sizes if each has a size that the other allows.

    Where many texts share most of their words and differ in the rest, those whose first common shingle leaves too little to link meet no more.
    """
    step = float(-np.log(threshold) / CELLS)
    cell = lambda size: F.floor(F.log(size) / step)
    few = left.filter(F.col("n") <= HELD).select("key", "rep", "fame", "label", F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("other"))
    many = left.filter(F.col("n") > HELD).withColumn("cell", cell("size")).withColumn("other", F.explode(F.sequence(cell(F.col("size") * (threshold - 1e-6)), cell("most"))))
    many = many.select(F.xxhash64("key", F.least("cell", "other"), F.greatest("cell", "other")).alias("key"), "rep", "fame", "label", "cell", "other")
    parted = written(few.union(many))
    sides = parted.groupBy("key").agg(F.min("cell").alias("least"), F.max("cell").alias("most"), F.bool_or(F.col("cell") == F.col("other")).alias("same"), F.count(F.lit(1)).alias("n"))
    both = written(sides.filter("same OR least < most").select("key", "n"))
    return _mixed(join_counted(parted, both, "key", "n").drop("cell", "other", "n"))


def _led_units(led: DataFrame) -> DataFrame:
    """(unit, lead, rep, label): each leader `a` with BLOCK of its rows `b`, all with labels of their own."""
    sizes = written(led.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    unit = F.xxhash64("a", "salt").alias("unit")
    salts = F.ceil(F.col("n") / BLOCK)
    rows = join_counted(led, sizes, "a", "n").withColumn("salt", F.pmod(F.xxhash64("b"), salts))
    rows = rows.select(unit, F.lit(False).alias("lead"), F.col("b").alias("rep"), F.col("b").alias("label"))
    heads = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).select(unit, F.lit(True).alias("lead"), F.col("a").alias("rep"), F.col("a").alias("label"))
    return rows.union(heads)


def _unsettled(left: DataFrame, new: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """`left` (key, rep, fame, label) with labels joined by the `new` links, without the rows that have met all others of their bucket (`done`), and without
    the buckets whose rows have one label: none of their pairs can join more. `salts` is the number of blocks of a bucket of `n` rows."""
    if not new.isEmpty():
        names = left.select("rep", "label").distinct()
        at = lambda c: names.select(F.col("rep").alias(c), F.col("label").alias(f"of_{c}")).hint("merge")
        # A bucket's first leader may be left in no bucket; then its label is its own number still.
        tag = lambda c: F.coalesce(f"of_{c}", c)
        joined = new.join(at("a"), "a", "left").join(at("b"), "b", "left").select(tag("a").alias("a"), tag("b").alias("b")).filter("a <> b")
        left = left.join(components(joined).select(F.col("node").alias("label"), F.col("label").alias("now")), "label", "left").select("key", "rep", "fame", F.coalesce("now", "label").alias("label"))
    if done is not None:
        left = left.join(done.select("key", "rep").hint("merge"), ["key", "rep"], "left_anti")
    return _mixed(left)


def _mixed(left: DataFrame) -> DataFrame:
    """`left` (key, rep, fame, label and others) without the keys whose rows have one label, and with `n` and `salts`."""
    left = written(left.drop("n", "salts"))
    mixed_up = written(left.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high"))
    return join_counted(left, mixed_up, "key", "n").select(*left.columns, "n", F.ceil(F.col("n") / BLOCK).alias("salts"))


def _leaders(left: DataFrame, links: DataFrame, width: int) -> DataFrame:
    """(key, rep, label, salts, block): `width` rows of each bucket, half those in the largest buckets and with most links (as an original among its copies), half those of the bucket's smallest classes.

    The first of each salt are found first, so that no task ranks a whole bucket.
    """
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("degree"))
    sizes = left.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
    top = left.join(degree.hint("merge"), "rep", "left").join(sizes, ["key", "label"]).withColumn("salt", F.pmod(F.xxhash64("rep"), "salts"))
    last = (F.desc("fame"), F.desc_nulls_last("degree"), F.xxhash64("rep"), "rep")
    for by in (("key", "salt"), ("key",)):
        near = Window.partitionBy(*by)
        ranks = {"known": F.row_number().over(near.orderBy(*last)), "rare": F.row_number().over(near.orderBy("size", *last))}
        top = top.withColumns(ranks).filter((F.col("known") <= width // 2) | (F.col("rare") <= width // 2))
    held = F.count(F.lit(1)).over(Window.partitionBy("key"))
    return top.withColumn("held", held).select("key", "rep", "label", "salts", F.pmod(F.xxhash64("rep"), F.ceil(F.col("held") / HELD)).alias("block"))


def _units(left: DataFrame, leaders: DataFrame) -> DataFrame:
    """(unit, lead, rep, label): the leaders of a block with each salt of their bucket, and the rows of that salt that have another label than some of them."""
    blocks = leaders.groupBy("key", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    unit = F.xxhash64("key", "block", "salt").alias("unit")
    heads = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select(unit, F.lit(True).alias("lead"), "rep", "label")
    rows = left.join(blocks, "key").filter("label <> low OR label <> high").withColumn("salt", F.pmod(F.xxhash64("rep"), "salts"))
    return rows.select(unit, F.lit(False).alias("lead"), "rep", "label").union(heads)


def _compared(units: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """Verified links (a, b) of the leaders of each unit with its rows of other labels."""
    sent = units.sparkSession.sparkContext.broadcast(weights)

    def compare(batches):
        unit, held, known, heads = None, [], None, []
        for rows, texts in slices(batches):
            owner, shingles, count, _ = shingle_sets(Texts(texts))
            weight = sent.value.of(shingles).astype(np.float64) * count
            units, reps, labels = (rows.column(c).to_numpy() for c in ("unit", "rep", "label"))
            lead = rows.column("lead").to_numpy(zero_copy_only=False)
            ends = np.searchsorted(owner, np.arange(len(reps) + 1))
            cuts = np.flatnonzero((units[1:] != units[:-1]) | (lead[1:] != lead[:-1])) + 1
            left, right = [], []
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(reps)], strict=True):
                if units[i] != unit:
                    unit, held, known = units[i], [], None
                if lead[i]:
                    held += [(reps[k], labels[k], shingles[ends[k] : ends[k + 1]], weight[ends[k] : ends[k + 1]]) for k in range(i, j)]
                    continue
                if known is None:
                    known = np.unique(np.concatenate([h[2] for h in held]))
                    heads = [(rep, label, np.searchsorted(known, s), w) for rep, label, s, w in held]
                own = slice(ends[i], ends[j])
                at = np.minimum(np.searchsorted(known, shingles[own]), len(known) - 1)
                at[known[at] != shingles[own]] = len(known)
                whose = owner[own] - i
                totals = np.bincount(whose, weight[own], j - i)
                for rep, label, places, w in heads:
                    if not (labels[i:j] != label).any():
                        continue
                    full = np.zeros(len(known) + 1)
                    full[places] = w
                    both = np.bincount(whose, np.minimum(weight[own], full[at]), j - i)
                    near = (both / np.maximum(totals + w.sum() - both, 1e-12) >= threshold) & (labels[i:j] != label)
                    left += [rep] * int(near.sum())
                    right += reps[i:j][near].tolist()
            pairs = np.array([left, right], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(0)), pa.array(pairs.max(0))], ["a", "b"])

    full = units.join(texts.hint("merge"), "rep").select("unit", "lead", "rep", "label", "text")
    return full.repartition("unit").sortWithinPartitions("unit", F.desc("lead")).mapInArrow(compare, "a long, b long")


def _texts_of(rows: DataFrame, named: DataFrame) -> DataFrame:
    """(rep, text) of the named texts: found by id, and by digest where an id has several texts."""

    def digest(batches):
        for part, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("digest"), pa.array(word_digests(texts), pa.binary()), part.column("text")], ["rep", "digest", "found", "text"])

    named = written(named.withColumnRenamed("rep_id", "doc_id"))
    joined = split_by(rows, named, ["doc_id"])[0].join(named.hint("merge"), "doc_id").select("rep", "digest", "text")
    found = joined.mapInArrow(digest, "rep long, digest binary, found binary, text string").filter("digest = found")
    return found.dropDuplicates(["rep"]).select("rep", "text")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, with all their columns. Rows that share an id with a kept row and have its words count as that row: the first stays."""
    dropped = near_duplicates(docs, threshold, id_col, text_col).groupBy(id_col).agg(F.max("kept").alias("kept")).filter("NOT kept").select(F.col(id_col).alias("__id"))
    return without(docs.withColumn("__id", F.col(id_col).cast("long")), written(dropped), ["__id"]).drop("__id")
