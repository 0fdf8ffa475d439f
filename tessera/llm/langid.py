"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy by backpropagation through time.

A text, lower-cased and in UTF-8 with one space for white space, is a sequence of bytes. The network reads it in both directions, its state
carried over words, in spans of SPAN bytes with CONTEXT bytes more on either side, and gives every position a distribution over the
languages; a document's probabilities are the mean over all its positions, each counted once, in the span that it lies in. So the work and
the memory of a step do not depend on a text's length. Gates and candidates use x / (1 + |x|), moved to 0..1 for gates, in place of the
logistic function and the hyperbolic tangent, which cost several times as much.

Training uses a bounded sample: every labelled language, at most `per_lang` documents of each and `sample_docs` in all (but 20 of each
language), drawn by a seeded hash of doc_id, and at most SLICES slices of SLICE characters of each. These are cut into pieces of PIECE bytes; of a
document's at most `doc_pieces` are drawn, and of all those at most `pieces`. Prediction reads every text whole.

Defined cases: a null text, or one without a letter, is `und` with score 0; a null lang teaches nothing; a null doc_id is neither held out
nor learned from; without any labelled row every text is `und`; ties go to the language that sorts first; rows that repeat get equal results;
an empty table gives no rows; a text of any length is read whole. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessera.llm.shared import columns, mapped, small

HIDDEN, SPAN, CONTEXT, SEED = 12, 160, 16, 11
SAMPLE_DOCS, PER_LANG = 4_000, 400
DOC_PIECES, PIECES, PIECE = 30, 20_000, 64
SLICES, SLICE = 4, 400
EPOCHS, BATCH, RATE = 4, 256, 0.015
#: Spans that are read side by side.
ROWS = 1_024
LETTER = re.compile(r"[^\W\d_]")


def soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


class Network:
    """Two GRUs, one for each direction, and a softmax over both states at each position."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = SEED):
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
        self.langs, self.h = langs, hidden
        self.w = {}
        for d in "fb":  # z: update gate, r: reset gate, c: candidate; of each what a byte adds, and what the state does
            self.w |= {f"x{g}{d}": draw(256, hidden) for g in "zrc"} | {f"h{g}{d}": draw(hidden, hidden) for g in "zrc"}
        self.w |= {"o": draw(2 * hidden, len(langs)), "ob": np.zeros(len(langs), np.float32)}

    def direction(self, d: str, x: np.ndarray, keep: bool = False):
        """States after each byte of the runs x (bytes, runs); for "b" from the end. A 0 is no byte: the state there is 0. With keep also what
        the gradient needs."""
        t, n = x.shape
        kind = self.w["o"].dtype
        h, hs, saved = np.zeros((n, self.h), kind), np.empty((t, n, self.h), kind), []
        (xz, xr, xc), (hz, hr, hc) = ([self.w[f"{a}{g}{d}"] for g in "zrc"] for a in "xh")
        there = (x != 0).astype(kind)[:, :, None]
        full = there.all(axis=(1, 2))
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z, r, c = xz.take(x[i], 0), xr.take(x[i], 0), xc.take(x[i], 0)
            z += h @ hz
            r += h @ hr
            z, r = soft(z), soft(r)
            for g in (z, r):
                g += 1
                g *= 0.5
            c += (r * h) @ hc
            c = soft(c)
            if keep:
                saved.append((i, h, z, r, c))
            if full[i]:
                h = np.add(h, z * (c - h), out=hs[i])
            else:
                h = np.multiply(h + z * (c - h), there[i], out=hs[i])
        return hs, saved

    def labels(self, x: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Distributions (languages, positions) at the positions from lo to hi of the runs x (bytes, runs), position by position."""
        k = self.h
        e = self.direction("f", x)[0][lo:hi].reshape(-1, k) @ self.w["o"][:k]
        e += self.direction("b", x)[0][lo:hi].reshape(-1, k) @ self.w["o"][k:]
        e += self.w["ob"]
        e = np.ascontiguousarray(e.T)
        e -= e.max(axis=0)
        np.exp(e, out=e)
        e /= e.sum(axis=0)
        return e

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean cross-entropy over all positions of the runs x (bytes, runs), and its gradients."""
        t, n = x.shape
        k, kind = self.h, self.w["o"].dtype
        there = (x != 0)[:, :, None].astype(kind)
        runs = {d: self.direction(d, x, keep=True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        e = both @ self.w["o"] + self.w["ob"]
        e = np.exp(e - e.max(axis=2, keepdims=True))
        p = e / e.sum(axis=2, keepdims=True)
        loss = float((-np.log(p[:, np.arange(n), y] + 1e-9) * there[:, :, 0]).sum() / there.sum())
        p[:, np.arange(n), y] -= 1
        p *= there / there.sum()
        g = {"o": both.reshape(-1, 2 * k).T @ p.reshape(-1, p.shape[2]), "ob": p.sum(axis=(0, 1))}
        back, flat = p @ self.w["o"].T, x.ravel()
        for d, part in (("f", back[:, :, :k]), ("b", back[:, :, k:])):
            hz, hr, hc = (self.w[f"h{a}{d}"] for a in "zrc")
            gz, gr, gc = np.zeros_like(hz), np.zeros_like(hr), np.zeros_like(hc)
            pre = np.zeros((3, t, n, k), kind)  # gradients of what goes into the gates and the candidate
            dh = np.zeros((n, k), kind)
            for i, h, z, r, c in reversed(runs[d][1]):
                dh = (dh + part[i]) * there[i]
                dc = dh * z * (1 - np.abs(c)) ** 2
                dz = dh * (c - h) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                drh = dc @ hc.T
                dr = drh * h * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                gc += (r * h).T @ dc
                gz += h.T @ dz
                gr += h.T @ dr
                pre[:, i] = dz, dr, dc
                dh = dh * (1 - z) + drh * r + dz @ hz.T + dr @ hr.T
            g |= {f"hz{d}": gz, f"hr{d}": gr, f"hc{d}": gc}
            for a, gate in zip("zrc", pre.reshape(3, -1, k), strict=True):
                g[f"x{a}{d}"] = np.stack([np.bincount(flat, gate[:, j], 256) for j in range(k)], axis=1)
        return loss, g

    def train(self, runs: list[bytes], y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Network:
        """Adam over batches of runs, in a seeded order; shorter ones are filled up with 0."""
        r, width = np.random.default_rng(seed), max(map(len, runs), default=0)
        x = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in runs), np.uint8).reshape(len(runs), width)
        m, v, step = {k: np.zeros_like(w) for k, w in self.w.items()}, {k: np.zeros_like(w) for k, w in self.w.items()}, 0
        for epoch in range(epochs):
            order, lr = r.permutation(len(runs)), rate * (1 - epoch / epochs)
            for j in range(0, len(order), BATCH):
                own = order[j : j + BATCH]
                _, g = self.gradients(np.ascontiguousarray(x[own].T), y[own])
                step += 1
                for k, w in self.w.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                    w -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Each text's probabilities: the mean of its positions' distributions."""
        sums = np.zeros((len(texts), len(self.langs)))
        spans, owners = [], []
        for k, t in enumerate(texts):
            for i in range(0, len(t), SPAN):
                spans.append(t[max(0, i - CONTEXT) : i + SPAN + CONTEXT].rjust(min(len(t), i + SPAN + CONTEXT) - i + CONTEXT, b"\0").ljust(SPAN + 2 * CONTEXT, b"\0"))
                owners.append(k)
                if len(spans) == ROWS:
                    self.pool(spans, owners, sums)
                    spans, owners = [], []
        if spans:
            self.pool(spans, owners, sums)
        return sums / np.maximum(1, [[len(t)] for t in texts])

    def pool(self, spans: list[bytes], owners: list[int], sums: np.ndarray) -> None:
        """Adds the distributions at the spans' own positions to their owners' sums."""
        x = np.ascontiguousarray(np.frombuffer(b"".join(spans), np.uint8).reshape(len(spans), -1).T)
        p = self.labels(x, CONTEXT, CONTEXT + SPAN).reshape(len(self.langs), SPAN, len(spans))
        p *= x[CONTEXT : CONTEXT + SPAN] != 0
        np.add.at(sums, owners, p.sum(axis=1).T)


def read_as(text: str) -> bytes:
    """The bytes that the network reads."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").replace(b"\0", b" ").split())


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, per_lang: int = PER_LANG, doc_pieces: int = DOC_PIECES, pieces: int = PIECES) -> Network | None:
    """A network trained on a bounded sample of the rows that have a lang and are not held out.

    doc_pieces bounds the pieces (of up to PIECE bytes) drawn from one document's slices, pieces those of all documents together."""
    docs = columns(docs, ["doc_id", "text", "lang"], ["long", "string", "string"])
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return None
    n = max(20, min(per_lang, sample_docs // len(counts)))
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1_000_000_007)) / 1_000_000_007.0
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.5 * n / r["count"])) for r in counts], "lang string, rate double")
    size = F.length("text")
    slices = [F.expr(f"substring(text, cast(floor(length(text) * {i} / {SLICES}) as int) + 1, {SLICE})") for i in range(SLICES)]
    text = F.when(size <= SLICES * SLICE, F.col("text")).otherwise(F.concat_ws(" ", *slices))
    rows = known.join(small(rates), "lang").withColumn("draw", draw).where("draw < rate").select("lang", "draw", text.alias("text")).orderBy("draw").limit(2 * max(sample_docs, n * len(counts))).collect()
    langs = sorted(r["lang"] for r in counts)
    place, seen, random = {x: i for i, x in enumerate(langs)}, dict.fromkeys(langs, 0), np.random.default_rng(SEED)
    runs, y = [], []
    for r in rows:
        if seen[r["lang"]] < n:
            seen[r["lang"]] += 1
            whole = read_as(r["text"])
            own = [whole[i : i + PIECE] for i in range(0, len(whole), PIECE)]
            if len(own) > doc_pieces:
                own = [own[i] for i in random.permutation(len(own))[:doc_pieces]]
            runs += own
            y += [place[r["lang"]]] * len(own)
    take = np.random.default_rng(SEED).permutation(len(runs))[:pieces]
    return Network(langs).train([runs[i] for i in take], np.array(y, np.int64)[take])


def predict(docs: DataFrame, net: Network | None, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the two columns `into`; every column of docs stays."""
    text = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(into[0], StringType()), StructField(into[1], DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text).to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            some = [i for i, t in enumerate(texts) if net and t and LETTER.search(t)]
            for i, p in zip(some, net.documents([read_as(texts[i]) for i in some]) if some else [], strict=True):
                k = int(np.argmax(p))
                langs[i], scores[i] = net.langs[k], float(min(1.0, p[k]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, *into])

    return mapped(docs, run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, lang_pred, score."""
    net = learn(docs)
    rows = columns(docs, ["doc_id", "text"], ["long", "string"])
    return predict(rows, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
