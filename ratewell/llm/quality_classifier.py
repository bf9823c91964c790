"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network on top.

Every word, and every form a word takes (its case, whether it repeats the word before it, its punctuation), has a
sparse random index vector that its hash gives. A word's vector is the sum of the index vectors around its occurrences
in the whole corpus: tasks add them up, blocks of the table are summed by a shuffle, and the table has a fixed size,
since words share 2^15 rows by hash. A document is the mean of its words' vectors, of its forms' and of its
punctuation's. The network learns from a bounded sample of labelled documents and a temperature, fitted on rows it has
not learned from, makes its outputs probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratewell.llm.common import settle, text_of

WORDS, FORMS, MARKS, WIDTH, NONZERO = 1 << 15, 16, 256, 32, 4
ROWS = WORDS + FORMS + MARKS
#: One more row, all zero, stands between documents.
PAD = ROWS
_PART = 512
_BLOCK = 1024
#: Partial sums that one task adds, and how often: FAN ** (LEVELS + 1) tasks may read the corpus.
FAN, LEVELS = 64, 2
#: Hash buckets of which as many are learned from as the sample needs.
BUCKETS = 1 << 16


class _Forms(dict):
    """word -> word row | form << 16 | mark << 24; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        text = word.decode()
        core = text.rstrip("!?.,;:|&%$#*<>\"')")
        mark = text[len(core) :]
        case = 0 if not core else 1 if core.islower() else 2 if core.isupper() and len(core) > 1 else 3 if core.istitle() else 4 if core.isdigit() else 5
        row = xxhash.xxh3_64_intdigest(core.lower().encode()) % WORDS
        found = self[word] = row | case << 16 | (xxhash.xxh3_64_intdigest(mark.encode()) % (MARKS - 1) + 1 if mark else 0) << 24
        return found


_forms = _Forms()


def index_vectors() -> np.ndarray:
    """The sparse random vectors, from a fixed seed; the padding's is zero."""
    draw = np.random.default_rng(20240229)
    out = np.zeros((ROWS + 1, WIDTH), np.int8)
    for k in range(NONZERO):
        out[np.arange(ROWS), (draw.integers(0, WIDTH // NONZERO, ROWS) + k * (WIDTH // NONZERO))] = draw.choice(np.array([-1, 1], np.int8), ROWS)
    return out


def _rows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of words, forms and marks of texts one after the other, with a PAD before each text and at the end; where texts start."""
    words = [(t or "").encode().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    n = int(sizes.sum()) + len(texts) + 1
    packed = np.full(n, -1, np.int64)
    for w, s in zip(words, starts, strict=True):
        packed[s : s + len(w)] = np.fromiter(map(_forms.__getitem__, w), np.int64, len(w))
    pad = packed < 0
    again = np.zeros(n, np.int64)
    again[1:] = (packed[1:] == packed[:-1]) & ~pad[1:]
    word = np.where(pad, PAD, packed & 0xFFFF).astype(np.uint16)
    form = np.where(pad, PAD, WORDS + (packed >> 16 & 7) + 8 * again).astype(np.uint16)
    mark = np.where(pad, PAD, WORDS + FORMS + (packed >> 24 & 0xFF)).astype(np.uint16)
    return word, form, mark, np.append(starts, n)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of index vectors around each row's occurrences in a task, by blocks of the table."""
    index = index_vectors()
    total = np.zeros((ROWS + 1, WIDTH), np.int32)
    for batch in batches:
        texts = batch["text"].to_pylist()
        for k in range(0, len(texts), _PART):
            word, form, mark, _ = _rows(texts[k : k + _PART])
            near = index[word].astype(np.int16)
            shape = index[form].astype(np.int16) + index[mark]
            around = shape.copy()
            around[1:] += near[:-1] + shape[:-1]
            around[:-1] += near[1:] + shape[1:]
            for rows in (word, form, mark):
                order = np.argsort(rows, kind="stable")
                ordered = rows[order]
                first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                total[ordered[first]] += np.add.reduceat(around[order], first, axis=0, dtype=np.int32)
    blocks = [b for b in range(0, ROWS, _BLOCK) if total[b : b + _BLOCK].any()]
    yield pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.int32()), "sums": pa.array([total[b : min(b + _BLOCK, ROWS)].astype(np.int64).tobytes() for b in blocks], pa.binary())})


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table["sums"].combine_chunks())
    return pa.table({"block": table["block"].slice(0, 1), "salt": table["salt"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors, of unit length: ROWS by WIDTH, whatever the size of docs."""
    texts = docs.select(text_of().alias("text"))
    # a block's partial sums are added in levels, so that no task receives more than FAN of them
    form = "block int, salt int, sums binary"
    sums = texts.mapInArrow(_contexts, "block int, sums binary").select("block", F.spark_partition_id().alias("salt"), "sums")
    for _ in range(LEVELS):
        sums = sums.withColumn("salt", F.floor(F.col("salt") / FAN).cast("int")).groupBy("block", "salt").applyInArrow(_added, form)
    sums = settle(sums, "vectors").groupBy("block").applyInArrow(_added, form)
    out = np.zeros((ROWS + 1, WIDTH), np.float32)
    for r in sums.collect():  # ROWS / _BLOCK rows
        part = np.frombuffer(r["sums"], np.int64).reshape(-1, WIDTH)
        out[r["block"] : r["block"] + len(part)] = part / np.maximum(1, np.sqrt((part.astype(float) ** 2).sum(1, keepdims=True)))
    return out


def _pooling(vectors) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vectors.value
        for batch in batches:
            for k in range(0, batch.num_rows, _PART):
                part = batch.slice(k, _PART)
                *kinds, starts = _rows(part["text"].to_pylist())
                size = np.maximum(1, np.diff(starts) - 1)[:, None]
                # a document's stretch ends with a PAD, which adds nothing
                pooled = np.concatenate([np.add.reduceat(table[rows], starts[:-1], axis=0) / size for rows in kinds] + [np.log1p(size) / 10], 1).astype(np.float32)
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "pooled": pa.array([x.tobytes() for x in pooled], pa.binary())})

    return run


@dataclass(frozen=True)
class Network:
    """tanh(x A + a) B + b over standardised inputs, divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, batch: int = 256, rate: float = 0.004, decay: float = 1e-4, seed: int = 7) -> Network:
    """Fits the network with Adam on four fifths of the rows and the temperature on the rest.

    With labels of one kind only, or none, every score is the share of label 1, smoothed.
    """
    width = x.shape[1] if len(x) else 3 * WIDTH + 1
    if len(set(y.tolist())) < 2:
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x[used].mean(0), x[used].std(0) + 1e-6
    z = (x - mean) / scale
    p = [draw.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), draw.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        mixed = draw.permutation(used)
        for k in range(0, len(mixed), batch):
            rows = mixed[k : k + batch]
            h = np.tanh(z[rows] @ p[0] + p[1])
            out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50)))
            d = (out - y[rows]) / len(rows)
            back = d[:, None] * p[2] * (1 - h * h)
            step += 1
            for j, g in enumerate((z[rows].T @ back + decay * p[0], back.sum(0), h.T @ d + decay * p[2], np.array([d.sum()]))):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                p[j] = p[j] - rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    found = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(held):
        logit, sign = found.logits(x[held]), 2 * y[held] - 1
        loss = lambda t: float(np.logaddexp(0, -sign * logit / t).mean())
        found = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), min(np.geomspace(0.25, 8, 60).tolist(), key=loss))
    return found


def _scoring(network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.frombuffer(b.as_buffer(), np.float32) for b in batch["pooled"]]) if batch.num_rows else np.zeros((0, 3 * WIDTH + 1))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": network.scores(x.astype(float))})

    return run


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, sample: int = 20_000, cut: float = 0.3) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (probability of quality 1) and predicted (score >= cut).

    labels: doc_id, quality. The network learns from the first `sample` labelled rows in order of hash buckets that are
    not held out; null labels and ids are left out, and of repeated labels the least counts. Only texts are inputs: a null text
    is empty and has the score of no words. Repeated rows are scored alike. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", text_of().alias("text"))
    vectors = spark.sparkContext.broadcast(word_vectors(docs))  # a table of fixed size: 4 MB
    pooled = settle(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pooling(vectors), "doc_id long, pooled binary"), "pooled")
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    usable = known.where(~held_out()).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    # buckets in order until they hold the sample: only their rows are read and sent on
    counts = usable.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy("bucket")) - F.col("n")
    last = counts.select("bucket", before.alias("before")).where(F.col("before") < sample).agg(F.max("bucket")).first()[0]
    chosen = pooled.join(usable.where(F.col("bucket") <= (-1 if last is None else last)), "doc_id")
    rows = chosen.orderBy("bucket", "doc_id", "pooled").limit(sample).select("pooled", "quality").toPandas()
    x = np.stack([np.frombuffer(b, np.float32) for b in rows["pooled"]]).astype(float) if len(rows) else np.zeros((0, 3 * WIDTH + 1))
    network = train(x, rows["quality"].to_numpy(float) if len(rows) else pd.Series(dtype=float).to_numpy())
    scored = pooled.mapInArrow(_scoring(network), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
