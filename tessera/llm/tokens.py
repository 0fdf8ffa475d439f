"""Token-id output: flat unsigned integer files with 64-bit document offsets, written by shard and read back memory-mapped.

A data set is a folder with, for each shard N in ascending document order,
  tokens-N.bin   token ids, little-endian unsigned 16-bit if the vocabulary fits, else 32-bit, document after document
  offsets-N.bin  n + 1 little-endian signed 64-bit: where each document starts in tokens-N.bin, and its end
  ids-N.bin      n little-endian signed 64-bit document ids, and nulls-N.bin a byte each that is 1 where the id was null
Shards hold ranges of doc_id; a shard's base in the whole corpus is the prefix sum of the token counts before it. Files get their
names by rename once they are complete, so a task that runs again replaces them with the same bytes.

The tokenizers library does the encoding. Where a tokenizer's own description shows the normalizer, pre-tokenizer and kind of model whose
rules are stated below, words are parted by these and each distinct one is given to the model once; with any other description whole texts go
through the tokenizer.

Defined cases: a null text is empty and gives the end id alone; null ids come first; rows with equal ids follow by text; an empty table
gives no rows; a text of any length is encoded whole. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import columns, mapped, new_path

END_ID = 1
#: Bytes of ids (with 150 and its characters for each piece) that an encoder keeps in each of two generations, and of text that it gets at a time.
CACHE_BYTES = 40_000_000
BATCH_BYTES = 8_000_000

# What a tokenizer file says of itself if the rules below hold.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}

#: Words whose pieces cannot be told apart here: with anything but printable ASCII, less the apostrophe, and Latin letters.
ODD = r"[^!-&(-~\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]|<\|"
#: A piece of any other word, in lower case.
PIECE = r"([a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+|[0-9]|[!-&(-/:-@\[-`{-~]+)"


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Texts to the packed ids of each; keeps the pieces of words that it has encoded, up to a bound.

    White space parts pieces and is dropped, so a text's ids are those of its words one after another, and a word's those of its pieces.
    A batch parts each of its distinct words once, and each distinct piece that is not kept goes to the tokenizer's own model, in bulk; an
    odd word is one piece, which goes through the whole tokenizer. Pieces not met again for a generation are dropped."""

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.whole, self.dtype = Tokenizer.from_file(path), dtype
        said = json.loads(self.whole.to_str())
        about = {k: v for k, v in said["model"].items() if k not in ("vocab", "merges")}
        special = [t["content"] for t in said["added_tokens"]]
        self.known = said["normalizer"] == NORMALIZER and said["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLITTER, BYTES]} and about == MODEL
        self.known = self.known and all(t.startswith("<|") for t in special) and not any(t["lstrip"] or t["rstrip"] for t in said["added_tokens"])
        self.kept, self.older, self.size = {"": b""}, {}, 0
        if not self.known:
            return
        self.letters = {b: c for b, c in byte_letters().items() if b not in (10, 32)}
        self.model = self.whole.model

    def learn(self, new: list[str]) -> None:
        is_odd = pc.match_substring_regex(pa.array(new, pa.string()), ODD).to_pylist()
        for w in compress(new, is_odd):
            self.kept[w] = np.array(self.whole.encode(w, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        plain = [p for p, odd in zip(new, is_odd, strict=True) if not odd]
        for i in range(0, len(plain), 20_000):
            part = plain[i : i + 20_000]
            written = [p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in part]
            each = [[t.id for t in found] for found in map(self.model.tokenize, written)]
            raw = np.fromiter(chain.from_iterable(each), dtype=self.dtype).tobytes()
            at = (np.cumsum(list(map(len, each))) * np.dtype(self.dtype).itemsize).tolist()
            self.kept.update(zip(part, map(raw.__getitem__, map(slice, [0, *at[:-1]], at)), strict=True))

    def coded(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, all distinct."""
        missing = [p for p in pieces if p not in self.kept]
        again = {p: v for p, v in zip(missing, map(self.older.get, missing), strict=True) if v is not None}
        self.kept.update(again)
        self.learn([p for p in missing if p not in again])
        found = list(map(self.kept.__getitem__, pieces))
        self.size += sum(len(p) + len(self.kept[p]) + 150 for p in missing)
        if self.size > CACHE_BYTES:
            self.kept, self.older, self.size = {"": b""}, self.kept, 0
        return found

    def words(self, words: pa.Array) -> pa.Array:
        """The ids of each word, as large binary."""
        spaced = pc.replace_substring_regex(pc.utf8_lower(words), PIECE, r"\1 ")
        parted = pc.split_pattern(pc.if_else(pc.match_substring_regex(words, ODD), words, spaced), " ")
        pieces = pc.dictionary_encode(parted.flatten())
        coded = pa.array(self.coded(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pieces.indices)
        starts = np.asarray(parted.offsets)
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends_of(coded)[starts]), coded.buffers()[2]])

    def texts(self, texts: pa.Array, end: bytes = b"") -> tuple[pa.Buffer | bytes, np.ndarray]:
        """The packed ids of all texts, each followed by end, and the byte at which each one stops; a null text is empty."""
        texts = pc.fill_null(texts, "")
        if not self.known:
            found = self.whole.encode_batch(texts.to_pylist(), add_special_tokens=False)
            each = [np.array(e.ids, dtype=self.dtype).tobytes() + end for e in found]
            return b"".join(each), np.cumsum([len(v) for v in each])
        split = pc.ascii_split_whitespace(texts)
        words = pc.dictionary_encode(split.flatten())
        stops = np.asarray(split.offsets)[1:]
        order = np.insert(np.asarray(words.indices), stops, len(words.dictionary))
        coded = pa.concat_arrays([self.words(words.dictionary), pa.array([end], pa.large_binary())]).take(pa.array(order))
        ends = ends_of(coded)[stops + np.arange(1, len(stops) + 1)]
        return coded.buffers()[2] or b"", ends


def ends_of(coded: pa.Array) -> np.ndarray:
    """The len(coded) + 1 offsets of a new large binary array."""
    return np.frombuffer(coded.buffers()[1], np.int64)[: len(coded) + 1]


@lru_cache(maxsize=1)
def encoder_of(path: str, dtype: str, *version: int) -> Encoder:
    return Encoder(path, dtype)


def encoder(path: str, dtype: str) -> Encoder:
    """The worker's encoder, kept from one task to the next, with what it has encoded, while the file stays the same."""
    file = os.stat(path)
    return encoder_of(path, dtype, file.st_mtime_ns, file.st_size, file.st_ino)


def parts_of(texts: pa.Array) -> Iterator[pa.Array]:
    """texts in runs of about BATCH_BYTES."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        stop = int(np.searchsorted(sizes, BATCH_BYTES + (sizes[at - 1] if at else 0))) + 1
        yield texts[at:stop]
        at = stop


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches one after another, joined to about BATCH_BYTES where they are smaller."""
    some, size = [], 0
    for b in batches:
        some.append(b)
        size += b.nbytes
        if size >= BATCH_BYTES:
            yield pa.concat_batches(some)
            some, size = [], 0
    if some:
        yield pa.concat_batches(some)


def target(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), re.sub("^file:", "", uri))


def renamed(fs: pafs.FileSystem, part: str, name: str) -> None:
    """Renames part to name, also where that does not replace a file that an earlier attempt left."""
    if not isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(name).type != pafs.FileType.NotFound:
        fs.delete_file(name)
    fs.move(part, name)


def publish(fs: pafs.FileSystem, name: str, write) -> None:
    """Runs write(stream) into a new file and renames that to name."""
    part = f"{name}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        write(out)
    renamed(fs, part, name)


def width_for(tokenizer: str) -> int:
    """16 bits where all ids fit, else 32."""
    from tokenizers import Tokenizer

    return 16 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 32


def write_shards(docs: DataFrame, folder: str, tokenizer: str, shards: int, width: int = 32, end_id: int = END_ID) -> list[tuple[int, int, int]]:
    """Writes the files; (shard, documents, tokens) of each, in order. The text is shuffled once, by ranges of doc_id."""
    dtype = f"<u{width // 8}"

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, fs, base, n, at = None, None, None, 0, 0
        ids, nulls, ends, stream, part = [], [], [], None, ""
        end = np.array([end_id], dtype=dtype).tobytes()
        for b in gathered(batches):
            if not b.num_rows:
                continue
            if stream is None:
                encode, n = encoder(tokenizer, dtype), b.column(2)[0].as_py()
                fs, base = target(folder)
                fs.create_dir(base, recursive=True)
                part = f"{base}/tokens-{n:06d}.bin.{uuid.uuid4().hex}.part"
                stream = fs.open_output_stream(part)
            nulls.append(np.asarray(b.column(0).is_null()).astype(np.uint8))
            ids.append(np.asarray(pc.fill_null(b.column(0), 0)))
            for texts in parts_of(b.column(1)):
                coded, stops = encode.texts(texts, end)
                stream.write(coded)
                ends += (at + stops * 8 // width).tolist()
                at = ends[-1]
        if stream is None:
            return
        stream.close()
        name = lambda kind: f"{base}/{kind}-{n:06d}.bin"
        renamed(fs, part, name("tokens"))
        publish(fs, name("offsets"), lambda o: o.write(np.array([0, *ends], "<i8").tobytes()))
        publish(fs, name("ids"), lambda o: o.write(np.concatenate(ids).astype("<i8").tobytes()))
        publish(fs, name("nulls"), lambda o: o.write(np.concatenate(nulls).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([len(ends)], pa.int64()), pa.array([at], pa.int64())], ["shard", "docs", "tokens"])

    rows = columns(docs, ["doc_id", "text"], ["long", "string"])
    dealt = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.md5(F.col("text").cast("binary")))
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").withColumn("shard", F.spark_partition_id())
    done = mapped(dealt, shard, "shard int, docs long, tokens long").collect()  # a row a shard
    return sorted((r.shard, r.docs, r.tokens) for r in done)


def map_file(uri: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the file system is local, else read whole (a shard's size bounds it)."""
    fs, path = target(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    with fs.open_input_stream(path) as s:
        return np.frombuffer(s.read(), dtype=dtype)


def read_shards(spark: SparkSession, folder: str, manifest: list[tuple[int, int, int]], width: int = 32) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files; start counts from the corpus's first token."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    bases = np.cumsum([0, *(t for _, _, t in manifest)])[:-1]
    shards = [(int(n), int(base)) for (n, _, _), base in zip(manifest, bases, strict=True)]
    dtype = f"<u{width // 8}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens, offsets, ids, nulls = (map_file(f"{folder}/{k}-{n:06d}.bin", t) for k, t in (("tokens", dtype), ("offsets", "<i8"), ("ids", "<i8"), ("nulls", "u1")))
                for i in range(0, len(ids), 20_000):
                    at = np.array(offsets[i : i + 20_001])
                    crc = [zlib.crc32(tokens[s:e].astype("<u4").tobytes()) for s, e in zip(at[:-1], at[1:], strict=True)]
                    some = pa.array(np.array(ids[i : i + 20_000]), mask=np.array(nulls[i : i + 20_000]) == 1)
                    yield pa.RecordBatch.from_arrays([some, pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    if not shards:
        return spark.createDataFrame([], schema)
    parts = max(1, min(len(shards), 100_000))
    return mapped(spark.createDataFrame(shards, "shard int, base long").repartition(parts, "shard"), read, schema)


def encode_corpus(docs: DataFrame, tokenizer: str, folder: str | None = None, shards: int | None = None, width: int | None = None) -> DataFrame:
    """Writes docs to a folder (by default one in the shared folder), with the least width that holds all ids, and returns what the files say of each document."""
    spark = docs.sparkSession
    folder, width = folder or new_path(spark, "tokens"), width or width_for(tokenizer)
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    return read_shards(spark, folder, write_shards(docs, folder, tokenizer, shards, width), width)
