"""Near-duplicate detection: banded MinHash proposes pairs, odd sketches sift them, full sets confirm them.

Of each document the set of its distinct word shingles is hashed (64 bits a shingle); SAMPLES minimum hashes are drawn from it, grouped
into bands of ROWS, and folded into an odd sketch: a bitmap of SKETCH bits in which each (sample, minimum) pair flips one bit. The XOR of
two sketches is the sketch of the symmetric difference, so its population count p estimates that difference as -SKETCH/2 ln(1 - 2p/SKETCH)
and with it the similarity, most precisely where that is high. A pair goes on if the estimate is at least FLOOR: at a similarity of 0.8 the
estimate's standard deviation is 0.024, so 4.6 of these below the threshold.

Documents with equal sets are one class, named by the set's 128-bit hash. Each bucket of a band has a center, the class that shares most
buckets with others (in a family of near copies, the least edited one); classes are paired with the centers of their buckets, and pairs that
hold join components. Buckets with classes in different components go through rounds, in which full sets are compared with the center's. Two
classes of a center's star have in common at most what the center shares with the one that has less of it, and what the two share beside the
center. So the sizes of a pair and of what its classes have of the center (above 400 rounded to a quarter of a percent, so that the need is
never overstated) say how many shingles beside the center it `needs` to link. Pairs that need none are compared; others are found by an index of the shingles beside the center, whose lists of at most LISTED classes give
pairs. A class outside the center's component with fewer shingles in longer lists than any pair needs has then met all that it can link with
in the bucket, and leaves it. What stays, if still in different components, gets its next centers, twice as many as before, until no bucket
is left. No link between classes that share a bucket is lost, and classes of one component are not paired with each other.
Components come from joins (smallest neighbour, pointer jumping). At a similarity of 0.8 a pair shares no band with probability
(1 - 0.8^ROWS)^BANDS, about 2e-7; more alike pairs are found more surely.

Defined cases: a document of fewer words than a shingle has one shingle of all its words; one without words has an empty set and links
with nothing; a null doc_id links with nothing and is kept; rows that share a doc_id are judged by their own texts, and those alike in both
get equal results; an empty table gives no rows; a text of any length is worked on whole, in parts of 128 shingles; of classes with equal
weight the one whose hash sorts last is the center. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import columns, mapped, materialize, small

SHINGLE, SIMILAR = 5, 80
ROWS, BANDS, SKETCH = 6, 50, 2048
SAMPLES = ROWS * BANDS
FLOOR = 0.69
SEED = 7
#: Classes of a list that are paired at once; longer lists wait for centers of their own.
LISTED = 64

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Words to 64-bit hashes; keeps up to a bound of characters."""

    size = 0

    def __missing__(self, w: bytes) -> int:
        self.size += len(w) + 100
        if self.size > 40_000_000:
            self.clear()
            self.size = 0
        v = self[w] = xxhash.xxh3_64_intdigest(w)
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def split_words(text: str, lower: bool = False) -> list[bytes]:
    """Runs of anything but space and U+0009 to U+000D, in UTF-8, of which bytes.split() and bytes.lower() know just the ASCII part."""
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def shingles(words: list[bytes], hashes: Words, n: int = SHINGLE) -> np.ndarray:
    """The sorted set of shingle hashes."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    k = max(1, len(words) - n + 1)
    x = np.full(k, np.uint64(min(n, len(words))), np.uint64)
    for j in range(min(n, len(words))):
        x = mixed(x * M1 + h[j : j + k])
    return np.unique(x)


def constants() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers for the samples, and salts."""
    r = np.random.default_rng(SEED)
    draw = lambda: r.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(), draw()


def minima(s: np.ndarray, a: np.ndarray) -> np.ndarray:
    """SAMPLES minimum hashes, one for each multiplier (the set's hashes are mixed already); large sets in parts that stay in cache."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 128):
        np.minimum(out, np.multiply.outer(s[i : i + 128], a).min(axis=0), out=out)
    return out


def lists(parts: list[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit numbers as a list column."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.empty(0, np.int64)]).astype(np.int64, copy=False)))


def signature(docs: DataFrame, lower: bool = True, n: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_hash, bands, sketch) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, c) = Words(), constants()
        empty, none = xxhash.xxh3_128_digest(b""), np.empty(0, np.int64)
        for batch in batches:
            sizes, digests, bands, sketches = [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(split_words(t, lower), hashes, n) if t else np.empty(0, np.uint64)
                sizes.append(len(s))
                if not len(s):
                    digests.append(empty), bands.append(none), sketches.append(none)
                    continue
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                m = minima(s, a)
                key = np.zeros(BANDS, np.uint64)
                for col in m.reshape(BANDS, ROWS).T:
                    key = mixed(key * M1 + col)
                bands.append((key ^ c[:BANDS]).view(np.int64))
                bits = np.bincount((mixed(m ^ c) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
                sketches.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists(bands), lists(sketches)], ["doc_id", "n_shingles", "set_hash", "bands", "sketch"])

    return mapped(columns(docs, ["doc_id", "text"], ["long", "string"]), run, "doc_id long, n_shingles long, set_hash binary, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, classes: DataFrame, lower: bool = True, n: int = SHINGLE) -> DataFrame:
    """(rep, shingles): the whole set of each of the classes (rep, doc_id), as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Words()
        for batch in batches:
            sets = [shingles(split_words(t, lower), hashes, n) for t in batch.column(1).to_pylist()]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), lists([s.view(np.int64) for s in sets])], ["rep", "shingles"])

    classes = small(classes)
    texts = columns(docs, ["doc_id", "text"], ["long", "string"]).where("text is not null").join(classes, "doc_id", "left_semi")
    sets = mapped(texts, run, "rep binary, shingles array<long>")
    return materialize(sets.join(classes, "rep", "left_semi").dropDuplicates(["rep"]), "sets")


def estimate(x, y):
    """The similarity that two odd sketches speak for."""
    p = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
    differ = F.when(2 * p >= SKETCH, F.lit(float("inf"))).otherwise(-SKETCH / 2 * F.log(1 - 2 * p / SKETCH))
    return 1 - differ / (2 * SAMPLES)


def compared(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """(a, b, n_b, common, own, linked): the sizes of b's set, of what it has of a's and, as a list, what it has besides."""
    x, y = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(x, "a").join(y, "b").withColumns({"own": F.array_except("y", "x"), "n_a": F.size("x"), "n_b": F.size("y")})
    both = both.withColumn("common", F.col("n_b") - F.size("own"))
    return both.select("a", "b", "n_b", "common", "own", (100 * F.col("common") >= similar * (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("linked"))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of a link. Each round takes the smallest label of all neighbours, then
    that label's own label; rounds grow with the logarithm of a chain's length in practice."""
    edges = materialize(links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*").distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnsRenamed({"node": "v", "label": "lv"}), "v").groupBy(F.col("u").alias("node")).agg(F.min("lv").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        # A label hears of what its members found, and its members of that.
        roots = stepped.groupBy(F.col("was").alias("root")).agg(F.min("label").alias("best"))
        jumped = stepped.join(roots, F.col("label") == F.col("root"), "left").select("node", "was", F.least("label", F.coalesce("best", "label")).alias("label"))
        jumped = materialize(jumped, "labels")
        if jumped.where("label < was").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.drop("was")


def hubs(members: DataFrame, width: int = 1) -> DataFrame:
    """(band, key, center): of each bucket the member with the most weight, or one of each of `width` parts of it."""
    part = F.pmod(F.xxhash64("rep"), F.lit(width))
    best = members.groupBy("band", "key", part.alias("part")).agg(F.max(F.struct("weight", "rep")).alias("m"))
    return materialize(best.select("band", "key", F.col("m.rep").alias("center")), "centers")


def stars(centers: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): each center with the other members of its buckets."""
    pairs = members.select("band", "key", "rep").join(centers, ["band", "key"]).where("rep <> center")
    return pairs.select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, key, rep, weight, label): those members whose buckets have members of different components."""
    placed = members.join(labels.withColumnRenamed("node", "rep"), "rep")
    several = placed.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band", "key")
    return materialize(placed.join(several, ["band", "key"]).select("band", "key", "rep", "weight", "label"), "active")


def beside_center(diffs: DataFrame, labels: DataFrame, similar: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) pairs of different components, both in the star of one center, that may be similar; and (center, rep): classes that can link with
    nothing in that star but by those pairs and the one with the center."""
    named = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    posted = diffs.select(F.col("a").alias("center"), F.col("b").alias("rep"), F.explode("own").alias("x"))
    lengths = posted.groupBy("center", "x").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    posted = materialize(posted.join(lengths, ["center", "x"]), "posted")
    far = posted.where(F.col("n") > LISTED).groupBy("center", "rep").agg(F.count(F.lit(1)).alias("long"))
    rows = diffs.select(F.col("a").alias("center"), F.col("b").alias("rep"), F.col("n_b").alias("n"), F.col("common").alias("i"))
    rows = rows.join(far, ["center", "rep"], "left").join(named("center"), "center").join(named("rep"), "rep")
    step = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) / 400))  # noqa: E731  sizes are put together in steps of a quarter of a percent
    rows = rows.withColumns({"long": F.coalesce("long", F.lit(0)), "n_low": F.floor(F.col("n") / step("n")) * step("n"), "i_high": F.ceil(F.col("i") / step("i")) * step("i")})
    rows = materialize(rows.withColumnRenamed("rep_label", "label"), "star")
    need = lambda n, m, i, j: F.ceil(similar * (n + m) / (100 + similar)) - F.least(i, j)

    # Kinds of classes, by rounded sizes, tell which pairs need none: there are few of them, however many classes are alike.
    lone, alike = rows.where("label <> center_label"), ["center", "n_low", "i_high"]
    kinds = materialize(rows.groupBy(*alike).agg(F.max((F.col("label") != F.col("center_label")).cast("int")).alias("lone")), "kinds")
    met = kinds.where("lone = 1").drop("lone").join(kinds.select("center", F.col("n_low").alias("m"), F.col("i_high").alias("j")), "center")
    fit = lambda n, m: 100 * F.col(m) >= similar * (F.col(n) - 2 * step(n))
    met = met.where(fit("n_low", "m") & fit("m", "n_low")).withColumn("need", need(F.col("n_low"), F.col("m"), F.col("i_high"), F.col("j")))
    met = materialize(met, "met")
    done = lone.join(met.where("need > 0").groupBy(*alike).agg(F.min("need").alias("need")), alike, "left").where("need is null or long < need").select("center", "rep")
    other = rows.select("center", F.col("n_low").alias("m"), F.col("i_high").alias("j"), F.col("rep").alias("b"), F.col("label").alias("b_label"))
    free = lone.join(met.where("need <= 0").drop("need"), alike).join(other, ["center", "m", "j"]).where("label <> b_label").select(F.col("rep").alias("a"), "b")

    near = posted.where(F.col("n") <= LISTED).select("center", "x", "rep")
    one = near.join(lone.select("center", "rep", "n", "i", "long", "label"), ["center", "rep"])
    two = near.join(rows.select("center", "rep", F.col("n").alias("n_b"), F.col("i").alias("i_b"), F.col("long").alias("long_b"), F.col("label").alias("b_label")), ["center", "rep"]).withColumnRenamed("rep", "b")
    shared = one.join(two, ["center", "x"]).where("label <> b_label").groupBy("center", "rep", "b", "n", "i", "long", "n_b", "i_b", "long_b").agg(F.count(F.lit(1)).alias("k"))
    shared = shared.where(F.col("k") + F.least("long", "long_b") >= need(F.col("n"), F.col("n_b"), F.col("i"), F.col("i_b"))).select(F.col("rep").alias("a"), "b")
    pairs = free.unionByName(shared).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return materialize(pairs, "beside"), done


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, label), with components joined that a link (a, b) connects."""
    one = labels.select(F.col("node").alias("a"), F.col("label").alias("l_a"))
    two = labels.select(F.col("node").alias("b"), F.col("label").alias("l_b"))
    across = materialize(links.join(one, "a").join(two, "b").where("l_a <> l_b").select(F.col("l_a").alias("a"), F.col("l_b").alias("b")).distinct(), "across")
    if across.isEmpty():
        return labels
    joined = components(across).select(F.col("node").alias("label"), F.col("label").alias("into"))
    return materialize(labels.join(joined, "label", "left").select("node", F.coalesce("into", "label").alias("label")), "labels")


def near_duplicates(docs: DataFrame, similar: int = SIMILAR, lower: bool = True, n: int = SHINGLE) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept."""
    sig = materialize(signature(docs, lower, n), "signatures")
    some = sig.where("n_shingles > 0 and doc_id is not null")
    reps = some.groupBy(F.col("set_hash").alias("rep")).agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")))
    reps = materialize(reps, "reps")
    banded = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    crowded = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(banded.join(crowded, ["band", "key"]), "shared")
    weights = shared.groupBy("rep").agg(F.sum(F.col("n") - 1).alias("weight"))
    members = materialize(shared.drop("n").join(weights, "rep"), "members")

    def sifted(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that the sizes and the sketches allow."""
        x, y = (reps.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "ab")
        both = pairs.join(x, "a").join(y, "b").where(100 * F.least("n_a", "n_b") >= similar * F.greatest("n_a", "n_b"))
        return both.where(estimate(F.col("s_a"), F.col("s_b")) >= FLOOR - (SIMILAR - similar) / 100).select("a", "b")

    def sets_of(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
        return full_sets(docs, materialize(reps.select("rep", "doc_id").join(nodes, "rep", "left_semi"), "nodes"), lower, n)

    centers = hubs(members)
    pairs = materialize(sifted(stars(centers, members)), "pairs")
    links = compared(pairs, sets_of(pairs), similar).where("linked").select("a", "b")
    labels = merged(materialize(weights.select(F.col("rep").alias("node"), F.col("rep").alias("label")), "labels"), materialize(links, "links"))
    active, sets, width = unsettled(members, labels), None, 1
    while not active.isEmpty():
        pairs = materialize(stars(centers, active), "pairs")
        sets = sets or sets_of(pairs)
        diffs = materialize(compared(pairs, sets, similar), "compared")
        labels = merged(labels, diffs.where("linked").select("a", "b"))
        beside, met = beside_center(diffs, labels, similar)
        labels = merged(labels, compared(beside, sets, similar).where("linked").select("a", "b"))
        gone = centers.join(met, "center").select("band", "key", "rep")
        gone = materialize(gone.unionByName(centers.withColumnRenamed("center", "rep")).distinct(), "gone")
        active = unsettled(active.drop("label").join(gone, ["band", "key", "rep"], "left_anti"), labels)
        # The next centers are of components that have none in the bucket, if there are such.
        had = centers.join(labels, centers["center"] == labels["node"]).groupBy("band", "key").agg(F.collect_set("label").alias("had"))
        fresh = active.join(had, ["band", "key"]).withColumn("weight", F.struct(~F.array_contains("had", F.col("label")), "weight"))
        width *= 2
        centers = hubs(fresh, width)
    named = reps.select("rep", "doc_id").join(labels, reps["rep"] == labels["node"], "left").select("rep", "doc_id", F.coalesce("label", "rep").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    known = named.join(least, "label").select(F.col("rep").alias("class"), "component_id")
    out = sig.select("doc_id", "n_shingles", "set_hash").join(known, F.col("doc_id").isNotNull() & (F.col("set_hash") == F.col("class")), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
