"""Near-duplicate documents: MinHash bands find candidates, odd sketches sift them, whole shingle sets confirm them.

Documents with equal shingle sets are one node. Nodes whose MinHash bands agree meet in a bucket. Pairs are not made
within buckets: each member is held against the first and last node of the bucket only, or of a share of it where the
bucket is large, and the shares' first and last nodes against one another in the same way, so that no node is in many
pairs. What those links join is one component; then only members of different components that share a bucket are paired, if their odd sketches allow the
similarity. An odd sketch is a bitmap into which samples are folded by parity: the bits in which two differ count the
samples in which the sets differ, and tell high similarities precisely. A node has two: one of the MinHash samples, and
one of the shingles with the least hashes (small sets: of all), which is the sharper for small sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

SHINGLE = 5
BANDS, ROWS = 40, 5
SKETCH_WORDS = 8
BITS = 64 * SKETCH_WORDS
#: A pair goes on if the bits that differ are at most so many deviations more than a pair at the limit has on average.
DEVIATIONS = 5
#: The second sketch folds the shingles whose hash ends in so many zero bits that about this many are left.
SAMPLED = 256

#: Members of a bucket that are held against the same two nodes, at most.
FAN = 64

_K = BANDS * ROWS
_A = (common.mix(np.arange(1, _K + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = common.mix(np.arange(_K + 1, 2 * _K + 1, dtype=np.uint64)).astype(np.uint32)
_SALT = common.mix(np.arange(3 * _K, 4 * _K, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after another, and the n + 1 places where they begin.

    A text with fewer words than a shingle has all its words as one shingle; one without words has none.
    """
    h, at = common.words(data, offsets, lower=True)
    g = common.grams(h, SHINGLE)
    parts = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= SHINGLE:
            parts.append(np.unique(g[a : b - SHINGLE + 1]))
        else:
            parts.append(common.grams(h[a:b], int(b - a)) if b > a else h[:0])
    return np.concatenate(parts) if parts else h[:0], np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)


def signatures(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each non-empty set its band keys and its odd sketch, as 64-bit integers."""
    begin = at[:-1][np.diff(at) > 0]
    n = len(begin)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    least, spare = np.empty((_K, n), np.uint32), np.empty_like(x)
    for k in range(_K):
        np.multiply(x, _A[k], out=spare)
        spare += _B[k]
        least[k] = np.minimum.reduceat(spare, begin)
    salted = common.mix(least.astype(np.uint64) ^ _SALT[:, None])
    sketch = _folded(salted.T.ravel(), np.repeat(np.arange(n), _K), n)
    size = np.diff(at)[np.diff(at) > 0]
    level = np.maximum(0, np.ceil(np.log2(size / SAMPLED))).astype(np.int64)
    owner = np.repeat(np.arange(n), size)
    some = sets & ((np.uint64(1) << level[owner].astype(np.uint64)) - np.uint64(1)) == 0
    second = _folded(sets[some] >> np.uint64(40), owner[some], n)
    sketch = np.c_[sketch, second, level, size]
    bands = salted[0::ROWS].copy()
    for k in range(1, ROWS):
        bands *= np.uint64(0x9E3779B97F4A7C15)
        bands += salted[k::ROWS]
    return common.mix(bands).T.view(np.int64), sketch


def _folded(samples: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The parity bitmap of each owner's samples."""
    where = (samples & np.uint64(BITS - 1)).astype(np.int64) + BITS * owner
    parity = (np.bincount(where, minlength=n * BITS) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(n, BITS), axis=1).view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, copy (a digest of the text), n_shingles, node (a digest of the set; null without words), bands and sketch."""

    def run(batches):
        common.release("words")
        for batch in batches:
            data, offsets = common.utf8(batch.column(2))
            size, node, bands, sketches = [], [], [], []
            for a, b in common.slices(offsets):
                sets, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                keys, odd = signatures(sets, at) if len(sets) else (np.zeros((0, BANDS), np.int64), np.zeros((0, 2 * SKETCH_WORDS + 2), np.int64))
                k = 0
                for i in range(b - a):
                    own = sets[at[i] : at[i + 1]]
                    size.append(len(own))
                    if len(own):
                        node.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                        bands.append(keys[k])
                        sketches.append(odd[k])
                        k += 1
                    else:
                        node.append(None)
                        bands.append(None)
                        sketches.append(None)
            columns = [*batch.columns[:2], pa.array(size, pa.int64()), pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "n_shingles", "node", "bands", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _copy(), "text").mapInArrow(run, f"doc_id {kind}, copy binary, n_shingles long, node binary, bands array<long>, sketch array<long>")


def _copy(text: Column | None = None) -> Column:
    return F.unhex(F.md5((F.col("text") if text is None else text).cast("binary"))).alias("copy")


def _most_bits(differing: Column, fixed: Column, spread: Column) -> Column:
    """How many bits two sketches may differ in, where so many samples differ on average.

    A bit differs with probability p = (1 - exp(-2 * differing / BITS)) / 2. fixed: whether just so many differ;
    spread: the variance of their number otherwise.
    """
    p = (1 - F.exp(-2 * differing / BITS)) / 2
    slope = F.exp(-4 * differing / BITS)
    own = F.greatest(F.lit(0.0), BITS * p * (1 - p) - differing * slope)
    return BITS * p + DEVIATIONS * F.sqrt(own + F.when(fixed, F.lit(0.0)).otherwise(spread * slope) + 1)


def _close(a: str, b: str, percent: int) -> Column:
    """Whether the sketches of two sets allow a similarity of percent: sizes, then either odd sketch."""
    x, y = F.col(a), F.col(b)
    differ = [sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(at, at + SKETCH_WORDS)), F.lit(0)) for at in (0, SKETCH_WORDS)]
    level, size = 2 * SKETCH_WORDS, 2 * SKETCH_WORDS + 1
    far = 1 - percent / 100
    minhash = differ[0] <= _most_bits(F.lit(2.0 * _K * far), F.lit(False), F.lit(4 * _K * far * (1 - far)))
    apart = (x[size] + y[size]) * ((100 - percent) / (100 + percent)) / F.pow(F.lit(2.0), x[level])
    second = (x[level] != y[level]) | (differ[1] <= _most_bits(apart, x[level] == 0, apart))
    return (100 * F.least(x[size], y[size]) >= percent * F.greatest(x[size], y[size])) & minhash & second


def _linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b, copy_a, copy_b) whose whole sets have 100 * intersection >= percent * union."""
    left = texts.select(F.col("copy").alias("copy_a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("copy").alias("copy_b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "copy_a").join(right, "copy_b").select("a", "b", "text_a", "text_b")

    def run(batches):
        common.release("words")
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            key = [batch.column(k).to_pylist() for k in range(2)]
            for k in range(2):
                new = {}
                for i, x in enumerate(key[k]):
                    if x not in known:
                        new.setdefault(x, i)
                data, offsets = common.utf8(batch.column(2 + k).take(pa.array(list(new.values()), pa.int64())))
                for a, b in common.slices(offsets):
                    sets, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    for j, x in enumerate(list(new)[a:b]):
                        known[x] = sets[at[j] : at[j + 1]].copy()
            yes = []
            for x, y in zip(*key, strict=True):
                s, t = known[x], known[y]
                small, large = min(len(s), len(t)), max(len(s), len(t))
                if 100 * small < percent * large:
                    yes.append(False)
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                yes.append(100 * both >= percent * (len(s) + len(t) - both))
            if sum(map(len, known.values())) > 2_000_000:
                known.clear()
            yield batch.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def _held_together(members: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (x, y) of nodes that hold buckets together, and the tables that they are read from; members has band, node and n, the bucket's size.

    Every member meets the first and the last node of its share; the first and last nodes of a bucket's shares are the members of the
    next round, until a bucket is one share.
    """
    out, tables = None, []
    while True:
        shared = members.withColumn("shares", F.when(F.col("n") <= FAN, F.lit(1)).otherwise(F.ceil(F.col("n") * 4 / F.lit(FAN))).cast("long"))
        shared = shared.withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares")))
        ends = common.written(shared.groupBy("band", "shares", "share").agg(F.min("node").alias("low"), F.max("node").alias("high")))
        tables.append(ends)
        met = shared.join(ends.where("low <> high"), ["band", "shares", "share"])
        pairs = met.select(F.col("node").alias("x"), F.explode(F.array("low", "high")).alias("y"))
        out = pairs if out is None else out.unionByName(pairs)
        members = ends.where("shares > 1").select("band", (2 * F.col("shares")).alias("n"), F.explode(F.array_distinct(F.array("low", "high"))).alias("node"))
        if members.isEmpty():
            return out, tables


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node that it reaches) of every node of the edges (a, b).

    Rounds of large and small stars, in which each node's neighbours move to the least of them, until nothing moves.
    """
    e = common.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = common.written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = common.written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        done = (e, least, large, low)
        e = common.written(small.where("u <> v").distinct())
        common.discard(*done)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def link(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text).

    Sets are linked if 100 * intersection >= percent * union; component_id is the least doc_id that links reach, and kept says
    that it is the row's own. A null, empty or blank text has no shingles and is linked with nothing. Rows that repeat an
    id and a text get the same result. A row without an id has no say in component_id, and is kept if no row it is
    linked with has an id. Columns beside doc_id and text don't matter.
    """
    return _link(docs, percent).drop("copy")


def _link(docs: DataFrame, percent: int) -> DataFrame:
    docs = docs.select("doc_id", "text")
    signed = common.written(_signed(docs))
    some = signed.where("node is not null")
    nodes = common.written(some.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min_by(F.struct("copy", "bands", "sketch"), "copy").alias("one")).select("node", "first_id", "one.*"))
    texts = docs.where("text is not null").groupBy(_copy()).agg(F.min("text").alias("text"))
    banded = nodes.select("node", F.explode("bands").alias("band"))
    buckets = common.written(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    members = common.written(banded.join(buckets, "band"))
    held = nodes.select("node", "copy", "sketch")

    def sifted(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) whose sketches allow the similarity, with the copies that hold their texts."""
        a = held.select(F.col("node").alias("a"), F.col("copy").alias("copy_a"), F.col("sketch").alias("sketch_a"))
        b = held.select(F.col("node").alias("b"), F.col("copy").alias("copy_b"), F.col("sketch").alias("sketch_b"))
        return pairs.join(a, "a").join(b, "b").where(_close("sketch_a", "sketch_b", percent)).select("a", "b", "copy_a", "copy_b")

    together, done = _held_together(members)
    first = together.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    first = common.written(sifted(first.distinct()))
    edges = common.written(_linked(first, texts, percent))
    roots = common.written(components(edges))

    # Buckets that still hold several components: their members, one by one across components, unless already held together.
    rooted = members.select("band", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_buckets = common.written(rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band"))
    open_members = common.written(rooted.join(open_buckets, "band").join(nodes.select("node", "sketch", "bands"), "node"))
    # Sizes of linked sets differ by a factor of 100 / percent at most: by less than one class, or two neighbouring ones.
    kind = F.floor(F.ln(F.col("sketch")[2 * SKETCH_WORDS + 1].cast("double")) / F.ln(F.lit(100.0 / percent * 1.001))) if percent < 100 else F.lit(0)
    sized = open_members.withColumn("kind", kind)
    x, y = (sized.select("band", "kind", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "root", "sketch", "bands"))) for k in "ab")
    y = y.withColumn("kind", F.explode(F.array(F.col("kind") - 1, F.col("kind"), F.col("kind") + 1)))
    # A pair is made in the first bucket that both share.
    first_shared = F.element_at(F.array_intersect("bands_a", "bands_b"), 1)
    apart = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & _close("sketch_a", "sketch_b", percent)
    across = x.join(y, (x["band"] == y["band"]) & (x["kind"] == y["kind"]) & apart & (first_shared == x["band"])).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    rest = common.written(across.join(first.select("a", "b"), ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = common.written(_linked(sifted(rest), texts, percent))
        if not more.isEmpty():
            edges = edges.unionByName(more)
            roots = common.written(components(edges))

    rooted = nodes.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = common.written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    known = common.written(rooted.select("node", "root").join(least, "root").select("node", "component_id"))
    common.discard(*done, nodes, buckets, members, first, open_buckets, open_members, rest, least)
    out = signed.select("doc_id", "copy", "n_shingles", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "copy", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Of each group of linked documents the one with the least id, with all its columns; see link.

    Of rows that repeat an id and a text, one stays.
    """
    stay = common.written(_link(docs, percent).where("kept").select(F.col("doc_id").alias("stays"), F.col("copy").alias("as")).distinct())
    same = docs["doc_id"].eqNullSafe(stay["stays"]) & _copy(docs["text"]).eqNullSafe(stay["as"])
    return docs.join(stay, same, "left_semi").dropDuplicates(["doc_id", "text"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(common.read(spark, sf_dir, "documents"))
