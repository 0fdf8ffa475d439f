"""Substring dedup: recurring passages are confirmed, compiled into sharded automata, and located in every document.

A window is `window` consecutive words. Words are hashed to 64 bits, all of a slice of documents at once over its bytes, windows to 96.
1 The text is written once in batches (runs of rows of an input split, of about BATCH_BYTES of text, named by a number), so later passes
  read the same batches, and what a batch is compared with does not grow with the split.
2 Each window has a seed, the least hash of its runs of GRAM words: windows that are equal have equal seeds. A batch gives each of its
  distinct seeds once, and whether it stands in two places there. Seeds with two rows or that mark are recurring.
3 Of windows with a recurring seed, a batch gives each distinct hash once, with the same mark. Hashes with two rows or the mark are
  confirmed: that word sequence starts in two places.
4 Runs of confirmed windows are recurring passages. Of each, windows that just cover it become phrases, as text; the phrases of the whole
  corpus, each once, are dealt to the batches that have their window, whichever document they came from.
5 A batch's phrases, SHARD_PHRASES at a time, are compiled into Aho-Corasick automata with pyahocorasick, and all the batch's documents
  stream through all of these. A word is written there as two of 64 letters, by 12 bits of its hash, so that a node has few children, among
  which the library looks one by one; a match counts if its text is that of a phrase. These matches alone say which words go.
What a batch gives to a shuffle holds a hash once, so a passage that a third of all rows have gives at most a row a batch, and no step
gathers a group of texts. Recurring seeds, confirmed hashes and phrases go back to their batches in files by group of batches, sorted by batch, of which
a task reads its own batch's.

Defined cases: a null text has no words; a text of fewer words than a window keeps all; windows overlap and may recur in one document;
rows that repeat in full are occurrences of each other; kept_sha256 of no words is that of the empty text; an empty table gives no rows; a
text of any length is worked on whole. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.neardup import mixed
from tessera.llm.shared import columns, mapped, materialize, new_path
from tessera.llm.tokens import target

WINDOW, GRAM = 35, 8
SHARD_PHRASES = 24_000
CHUNK_WORDS = 4_000_000  # words of documents that a task holds as numbers
BATCH_BYTES = 16 << 20  # text of a batch
GROUP = 64  # batches a folder
TABLE = 1 << 22  # powers that a worker keeps, two numbers each
PIECE = 8_000  # phrases that are turned into letters at a time
BUFFER = 1_000_000  # windows that a task holds before it gives their distinct hashes
A, B = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD1342543DE82EF95)


def rolling(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes, modulo 2^64, of all runs of k of h, mixed."""
    n = len(h) - k + 1
    x, step, at, left = h.copy(), 1, np.zeros(max(0, n), np.uint64), k
    # Binary powers: x[i] is the hash of `step` words from i on; the bits of k choose what at[] takes up.
    power, offset = base, 0
    while left:
        if left & 1:
            at = at * power + x[offset : offset + n]
            offset += step
        left >>= 1
        if left:
            x = x[: len(x) - step] * power + x[step:]
            with np.errstate(over="ignore"):
                power = power * power
            step *= 2
    return mixed(at)


def least(x: np.ndarray, k: int) -> np.ndarray:
    """The minimum of every run of k, by doubling."""
    step = 1
    while step * 2 <= k:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (k - step)], x[k - step :]) if k > step else x


def seeds(h: np.ndarray, window: int = WINDOW, gram: int = GRAM, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The seed of every window, and the hashes at all places that are the seed of some window; of those in `whole` alone, if given."""
    g = rolling(h, gram, A)
    span = window - gram + 1
    m = least(g, span)
    pad = np.concatenate([np.zeros(span - 1, np.uint64), m if whole is None else np.where(whole, m, np.uint64(0)), np.zeros(span - 1, np.uint64)])
    return m, g[~least(~pad, span) == g]


def window_hashes(h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    return rolling(h, window, A), rolling(h, window, B) >> np.uint64(33)



def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2^64, and their inverses: the start of one table, but for very long slices."""
    return tuple(x[:n] for x in (power_table(TABLE) if n <= TABLE else power_table.__wrapped__(n)))


@functools.lru_cache(1)
def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, A, np.uint64)
    down = np.full(n, np.uint64(pow(int(A), -1, 2**64)), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Slice:
    """The words of some documents one after another: hashes h, where in `raw` they begin and end, words of each document (sizes); `whole` tells
    which windows lie in one document."""

    def __init__(self, texts: list[str | None], window: int):
        parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.raw = b"\n".join([*parts, b""]) or b"\n"
        x = np.frombuffer(self.raw, np.uint8)
        self.blank = (x == 32) | (x - np.uint8(9) <= 4)
        change = np.flatnonzero(self.blank[1:] != self.blank[:-1]) + 1  # the last byte is blank
        change = change if self.blank[0] else np.concatenate([[0], change])
        self.first, self.last = change[0::2], change[1::2]
        up, down = powers(len(x))
        upto = np.zeros(len(x) + 1, np.uint64)
        y = upto[1:]
        y[:] = x
        y += np.uint64(1)  # so that no byte is 0
        y *= up
        np.cumsum(y, out=y)
        self.h = mixed((upto[self.last] - upto[self.first]) * down[self.first])
        ends = np.searchsorted(self.first, np.cumsum([len(p) + 1 for p in parts]))
        self.sizes = np.diff(ends, prepend=0)
        stop = np.repeat(ends, self.sizes)
        self.whole = (np.arange(len(self.h)) + window <= stop)[: max(0, len(self.h) - window + 1)]

    def texts(self, starts: np.ndarray, window: int) -> list[bytes]:
        """The words of each window, joined by a space: as they stand where single spaces part them."""
        x = np.frombuffer(self.raw, np.uint8)
        odd = np.concatenate([[0], np.cumsum((self.first[1:] - self.last[:-1] != 1) | (x[self.last[:-1]] != 32))])
        ends = starts + window - 1
        spans = zip(self.first[starts].tolist(), self.last[ends].tolist(), (odd[ends] > odd[starts]).tolist(), strict=True)
        return [b" ".join(self.raw[a:b].split()) if mend else self.raw[a:b] for a, b, mend in spans]

    def left(self, gone: np.ndarray) -> tuple[list[bytes], list[int]]:
        """Of each document the words that are not gone, joined by a space, and how many words are gone."""
        x = np.frombuffer(self.raw, np.uint8).copy()
        x[self.last] = 32
        keep = ~self.blank
        keep[self.last] = True
        lost = np.flatnonzero(gone)
        if len(lost):
            # A word goes with the blank after it.
            edge = np.zeros(len(x) + 1, np.int8)
            edge[self.first[lost]] += 1
            edge[self.last[lost] + 1] -= 1
            keep &= np.cumsum(edge[:-1], dtype=np.int8) == 0
        size = np.where(gone, 0, self.last - self.first + 1)
        ends = np.cumsum(self.sizes)
        at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])].tolist()
        took = np.diff(np.concatenate([[0], np.cumsum(gone)])[np.concatenate([[0], ends])]).tolist()
        out = x[keep].tobytes()
        return [out[i : max(i, j - 1)] for i, j in itertools.pairwise(at)], took

    def letters(self) -> str:
        """Two characters for each word, one of 64 each."""
        c = np.empty(2 * len(self.h), "<u4")
        c[0::2], c[1::2] = 256 + (self.h >> np.uint64(8) & np.uint64(63)), 320 + (self.h >> np.uint64(14) & np.uint64(63))
        return c.tobytes().decode("utf-32-le")


def distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, n = np.unique(np.concatenate(parts), return_counts=True)
    return u, n > 1


def distinct_pairs(h: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, and whether it was there twice."""
    order = np.argsort(h, kind="stable")
    h, i = h[order], i[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (i[1:] != i[:-1])]))
    return h[first], i[first], np.diff(np.append(first, len(h))) > 1


def packed(df: DataFrame, name: str) -> str:
    """(batch, v) to a table in folders of GROUP batches, sorted by batch; its path. Row groups are small, so a reader of one batch reads little
    else."""
    path = new_path(df.sparkSession, name)
    rows = df.withColumn("grp", F.floor(F.col("batch") / GROUP).cast("int")).repartition("batch").sortWithinPartitions("grp", "batch")
    rows.write.partitionBy("grp").option("parquet.block.size", 1 << 20).option("compression", "zstd").parquet(path)
    return path


def own_rows(path: str, batch: int) -> pa.ChunkedArray | list:
    """What packed() has for a batch."""
    fs, base = target(path)
    folder = f"{base}/grp={batch // GROUP}"
    if fs.get_file_info(folder).type.name == "NotFound":
        return []
    return pads.dataset(folder, filesystem=fs, format="parquet").to_table(columns=["v"], filter=pads.field("batch") == batch)["v"]


def own_hashes(path: str, batch: int) -> np.ndarray:
    return np.sort(np.asarray(own_rows(path, batch), dtype=np.int64).view(np.uint64))


def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of one batch each; the batch's number is the last column."""
    for b in batches:
        n = np.asarray(b.column(b.num_columns - 1))
        at = [0, *(np.flatnonzero(np.diff(n)) + 1).tolist(), len(n)]
        for i, j in itertools.pairwise(at):
            if i < j:
                yield int(n[i]), b.slice(i, j - i)


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each of x is in the sorted known."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def batches_of(docs: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """docs, written once, with the number of the batch that each row is in: as many rows of a split as have, on average, `most` bytes of text.
    Numbers that meet, of a split with more than GROUP batches, make one batch with pieces in two places."""
    rows = columns(docs, ["doc_id", "text"], ["long", "string"])
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    run = max(1, found.n * most // max(1, found.size or 0))
    at = F.monotonically_increasing_id()
    batch = F.shiftright(at, 33) * GROUP + F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(run)) % GROUP
    return materialize(rows.withColumn("batch", batch.cast("int")), "batches")


def recurring(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key has two rows or the mark `twice`, in one shuffle: a key has at most a row for each batch, or BUFFER hashes of it."""
    w = Window.partitionBy(*key)
    return rows.withColumns({"n": F.count(F.lit(1)).over(w), "two": F.max("twice").over(w)}).where("n > 1 or two")


def recurring_seeds(batched: DataFrame, window: int = WINDOW) -> DataFrame:
    """(batch, v): the seeds of each batch that stand in two places of the corpus."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, batch = [], 0, 0

        def give() -> pa.RecordBatch:
            u, twice = distinct(held)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.full(len(u), batch, np.int32)), pa.array(twice)], ["h", "batch", "twice"])

        for n, own in by_batch(parts):
            if held and (n != batch or size > BUFFER):
                yield give()
                held, size = [], 0
            batch, x = n, Slice(own.column(0).to_pylist(), window)
            if len(x.whole):
                held.append(seeds(x.h, window, whole=x.whole)[1])
                size += len(held[-1])
        if held:
            yield give()

    return recurring(mapped(batched.select("text", "batch"), run, "h long, batch int, twice boolean"), ["h"]).select("batch", F.col("h").alias("v"))


def confirmed_windows(batched: DataFrame, seed_path: str, window: int = WINDOW) -> DataFrame:
    """(batch, h): the windows of each batch whose word sequence starts in two places of the corpus."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, batch, known = [], 0, None, np.empty(0, np.uint64)

        def give() -> pa.RecordBatch:
            h, i, twice = distinct_pairs(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(i.astype(np.int32)), pa.array(np.full(len(h), batch, np.int32)), pa.array(twice)], ["h", "i", "batch", "twice"])

        for n, own in by_batch(parts):
            if held and (n != batch or size > BUFFER):
                yield give()
                held, size = [], 0
            if n != batch:
                batch, known = n, own_hashes(seed_path, n)
            x = Slice(own.column(0).to_pylist(), window)
            if len(x.whole) and (some := among(seeds(x.h, window)[0], known) & x.whole).any():
                h, i = window_hashes(x.h, window)
                held.append((h[some], i[some]))
                size += int(some.sum())
        if held:
            yield give()

    rows = recurring(mapped(batched.select("text", "batch"), run, "h long, i int, batch int, twice boolean"), ["h", "i"])
    return materialize(rows.select("batch", "h", "i"), "confirmed")


def phrases(batched: DataFrame, seed_path: str, window_path: str, window: int = WINDOW) -> DataFrame:
    """(h, i, phrase): windows that cover the recurring passages of all documents, each window once."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, known, marks, seen = None, None, None, set()
        for n, own in by_batch(parts):
            if n != batch:
                batch, known, marks, seen = n, own_hashes(seed_path, n), own_hashes(window_path, n), set()
            x = Slice(own.column(0).to_pylist(), window)
            if not len(marks) or not len(x.whole) or not (some := among(seeds(x.h, window)[0], known) & x.whole).any():
                continue
            h, i = window_hashes(x.h, window)
            starts = np.flatnonzero(some)
            starts = starts[among(h[starts] ^ (i[starts] << np.uint64(20)), marks)]
            # A window over two documents is not whole, so runs end with their document.
            starts = np.array([s for s in covering(starts, window).tolist() if (int(h[s]), int(i[s])) not in seen], np.int64)
            if not len(starts):
                continue
            seen |= {(int(h[s]), int(i[s])) for s in starts}
            if len(seen) > BUFFER // 4:
                seen = set()
            text = pa.array(x.texts(starts, window), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(h[starts].view(np.int64)), pa.array(i[starts].astype(np.int32)), text], ["h", "i", "phrase"])

    found = mapped(batched.select("text", "batch"), run, "h long, i int, phrase binary")
    return found.groupBy("h", "i").agg(F.min("phrase").alias("phrase"))


def covering(starts: np.ndarray, window: int) -> np.ndarray:
    """Of ascending starts of confirmed windows: the fewest, run by run, whose windows cover the same words."""
    if not len(starts):
        return starts
    out = []
    for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
        first, last = int(run[0]), int(run[-1])
        out += [*range(first, last, window), last]
    return np.array(out, np.int64)


def shards_of(found: list[bytes], window: int, shard: int) -> Iterator[tuple[object, list[set[bytes]]]]:
    """Automata of at most `shard` phrases each, whose values say which phrases a match may be."""
    import ahocorasick

    for j in range(0, len(found), shard):
        part = found[j : j + shard]
        pieces = (part[k : k + PIECE] for k in range(0, len(part), PIECE))
        letters = "".join(Slice([p.decode("utf-8", "surrogatepass") for p in piece], window).letters() for piece in pieces)
        automaton, texts, at = ahocorasick.Automaton(ahocorasick.STORE_INTS), [], {}
        for i, p in enumerate(part):
            key = letters[2 * window * i : 2 * window * (i + 1)]
            if key not in at:
                at[key] = len(texts)
                texts.append(set())
                automaton.add_word(key, at[key])
            texts[at[key]].add(p)
        automaton.make_automaton()
        yield automaton, texts


def locate(found: list[bytes], slices: list[list[str | None]], window: int, shard: int = SHARD_PHRASES) -> Iterator[tuple[Slice, np.ndarray]]:
    """Each slice of documents, and which of its words an occurrence of one of the phrases covers."""
    covers: list[np.ndarray | None] = [None] * len(slices)
    shards = -(-len(found) // shard)
    for done, (automaton, phrases) in enumerate(shards_of(found, window, shard), 1):
        for k, texts in enumerate(slices):
            x = Slice(texts, window)
            if covers[k] is None:
                covers[k] = np.zeros(len(x.h) + 1, np.int32)
            hits = list(automaton.iter(x.letters()))
            if hits:
                ends, v = np.array(hits, np.int64).T
                at = (ends - 2 * window + 1) // 2
                at, v = at[x.whole[at]], v[x.whole[at]]
                same = [t in phrases[i] for t, i in zip(x.texts(at, window), v.tolist(), strict=True)]
                at = at[np.array(same, bool)]
                np.add.at(covers[k], at, 1)
                np.add.at(covers[k], at + window, -1)
            if done == shards:
                yield x, np.cumsum(covers[k][:-1]) > 0
                covers[k] = None
    if not shards:
        for texts in slices:
            x = Slice(texts, window)
            yield x, np.zeros(len(x.h), bool)


def remove(docs: DataFrame, window: int = WINDOW, chunk_words: int = CHUNK_WORDS, shard: int = SHARD_PHRASES, keep_text: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text."""
    batched = batches_of(docs)
    seed_path = packed(recurring_seeds(batched, window), "recurring-seeds")
    confirmed = confirmed_windows(batched, seed_path, window)
    window_path = packed(confirmed.select("batch", F.col("h").bitwiseXOR(F.shiftleft(F.col("i").cast("long"), 20)).alias("v")), "confirmed-windows")
    found = phrases(batched, seed_path, window_path, window)
    phrase_path = packed(confirmed.join(found, ["h", "i"]).select("batch", F.col("phrase").alias("v")), "phrases")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, found, held, size = None, [], [], 0

        def give() -> Iterator[pa.RecordBatch]:
            slices = [t.to_pylist() for _, t in held]
            for (ids, _), (x, gone) in zip(held, locate(found, slices, window, shard), strict=True):
                kept, took = x.left(gone)
                sums = [hashlib.sha256(k).hexdigest() for k in kept]
                texts = pa.array(kept, pa.binary()) if keep_text else pa.nulls(len(kept), pa.binary())
                made = [pa.array(x.sizes, pa.int64()), pa.array(took, pa.int64()), pa.array(sums, pa.string()), texts]
                yield pa.RecordBatch.from_arrays([ids, *made], ["doc_id", "n_words", "n_removed", "kept_sha256", "text"])

        for n, own in by_batch(parts):
            if held and (n != batch or size > chunk_words):
                yield from give()
                held, size = [], 0
            if n != batch:
                batch, found = n, own_rows(phrase_path, n)
                found = found.to_pylist() if len(found) else []
            held.append((own.column(0), own.column(1)))
            size += own.column(1).nbytes // 6
        if held:
            yield from give()

    out = mapped(batched, run, "doc_id long, n_words long, n_removed long, kept_sha256 string, text binary")
    return out.withColumn("text", F.col("text").cast("string")) if keep_text else out.drop("text")
