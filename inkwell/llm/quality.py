"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its word occurrences, hashed into ``2**word_bits`` columns with weight ``WORD_SCALE / words``,
and one indicator per structure statistic (the statistic's bin). The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i (v_if x_i)**2),

the sum-of-squares form of all pairwise interactions, so scoring takes time linear in the words.

Defined results: a null text counts as empty; an empty text has statistics but no words and still gets a score.
Labels other than 0 and 1 are ignored; of several labels of one document the smallest holds, of several texts of one
labelled document the smallest. Without any usable label,
or with one class only, every score is the share of label 1 (0.5 without labels). Repeated rows are scored alike.
Columns besides ``text`` never reach the model, so language, source and identifiers cannot influence a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import U64, Words, column_blocks
from .frames import small_batches

#: A text's words together weigh this much.
WORD_SCALE = 6.0
STATISTICS = ("words", "bytes", "word_length", "symbols", "capitals", "digits", "spaces", "distinct", "repeats", "line_words", "bars")
BINS = 24


@dataclass(frozen=True)
class Settings:
    """``train_rows`` bounds the labelled sample that is fitted on the driver (the rows of smallest id hash)."""

    train_rows: int = 6000
    word_bits: int = 14
    rank: int = 6
    epochs: int = 12
    batch: int = 128
    rate: float = 0.02
    decay: float = 1e-5
    seed: int = 7


class Features:
    """Features of the texts of one block."""

    def __init__(self, block, word_bits: int):
        words = Words(block)
        count = np.diff(words.offs)
        size = np.diff(block.offs)
        kinds = np.zeros(256, dtype=np.uint8)  # 1 symbol, 2 capital, 3 digit, 4 space, 5 bar
        kinds[33:127] = 1
        kinds[48:58], kinds[65:91], kinds[97:123], kinds[[9, 10, 13, 32]], kinds[124] = 3, 2, 0, 4, 5
        seen = kinds[block.data]

        def per_doc(flags: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
            return total[block.offs[1:]] - total[block.offs[:-1]]

        lengths = np.concatenate(([0], np.cumsum(words.end - words.start)))
        same = np.zeros(len(words.hash) + 1, dtype=np.int64)
        same[2:] = np.cumsum(words.hash[1:] == words.hash[:-1]) if len(words.hash) > 1 else 0
        repeats = np.where(count > 1, same[words.offs[1:]] - same[np.minimum(words.offs[:-1] + 1, len(words.hash))], 0)
        distinct = np.array([len(np.unique(words.hash[a:b])) for a, b in zip(words.offs[:-1], words.offs[1:], strict=True)], dtype=np.float64)
        n, b = np.maximum(count, 1), np.maximum(size, 1)
        self.stats = np.stack([
            np.log1p(count) / 10, np.log1p(size) / 12, (lengths[words.offs[1:]] - lengths[words.offs[:-1]]) / n / 16,
            4 * per_doc(seen == 1) / b, per_doc(seen == 2) / b, 4 * per_doc(seen == 3) / b, 2 * per_doc(seen == 4) / b,
            distinct / n, repeats / n, np.log1p(count / (per_doc(block.data == 10) + 1)) / 8, 8 * per_doc(seen == 5) / b,
        ], axis=1)
        self.word = (words.hash & U64((1 << word_bits) - 1)).astype(np.int64)
        self.offs = words.offs
        # square roots spread the bins where most texts are
        bins = np.minimum((np.sqrt(np.clip(self.stats, 0, 1)) * BINS).astype(np.int64), BINS - 1)
        self.bin = bins + np.arange(len(STATISTICS)) * BINS + (1 << word_bits)


def columns(word_bits: int) -> int:
    return (1 << word_bits) + BINS * len(STATISTICS)


@dataclass
class Model:
    """``bias``, linear weights ``w`` and interaction factors ``v``; ``constant`` replaces them where nothing could be fitted."""

    settings: Settings
    bias: float = 0.0
    w: np.ndarray | None = None
    v: np.ndarray | None = None
    constant: float | None = None

    def score(self, x: Features) -> np.ndarray:
        n = len(x.offs) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        weight = WORD_SCALE / np.maximum(np.diff(x.offs), 1)

        def summed(values: np.ndarray) -> np.ndarray:
            total = np.concatenate((np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)))
            return total[x.offs[1:]] - total[x.offs[:-1]]

        rows = np.column_stack((self.w, self.v, (self.v**2).sum(axis=1))).astype(np.float32)
        words, bins = summed(rows[x.word]), rows[x.bin].sum(axis=1, dtype=np.float64)
        linear = words[:, 0] * weight + bins[:, 0]
        factor = words[:, 1:-1] * weight[:, None] + bins[:, 1:-1]
        squares = words[:, -1] * weight**2 + bins[:, -1]
        z = self.bias + linear + 0.5 * ((factor**2).sum(axis=1) - squares)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], settings: Settings) -> Model:
    """Fit by Adam on log loss. A row: label, distinct word columns, their weights, statistic columns."""
    labels = np.array([r[0] for r in rows], dtype=np.float64)
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(settings, constant=float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(settings.seed)
    d, k = columns(settings.word_bits), settings.rank
    theta = np.concatenate((np.zeros((d, 1)), rng.normal(0, 0.05, (d, k))), axis=1)
    share = labels.mean()
    bias, m, s, mb, sb, step = float(np.log(share / (1 - share))), np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0, 0
    for _ in range(settings.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), settings.batch):
            part = [rows[i] for i in order[at : at + settings.batch]]
            col = np.concatenate([np.concatenate((r[1], r[3])) for r in part])
            val = np.concatenate([np.concatenate((r[2], np.ones(len(r[3])))) for r in part])
            size = np.array([len(r[1]) + len(r[3]) for r in part])
            cut = np.concatenate(([0], np.cumsum(size)[:-1]))
            doc = np.repeat(np.arange(len(part)), size)
            vx = theta[col] * val[:, None]
            total = np.add.reduceat(vx, cut, axis=0)
            z = bias + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(1) - np.add.reduceat((vx[:, 1:] ** 2).sum(1), cut))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - np.array([r[0] for r in part])) / len(part)
            own = np.concatenate((np.ones((len(col), 1)), total[doc][:, 1:] - vx[:, 1:]), axis=1) * (g[doc] * val)[:, None]
            grad = np.stack([np.bincount(col, own[:, f], minlength=d) for f in range(k + 1)], axis=1) + settings.decay * theta
            step += 1
            m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
            mb, sb = 0.9 * mb + 0.1 * g.sum(), 0.999 * sb + 0.001 * g.sum() ** 2
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            theta -= settings.rate * fix * m / (np.sqrt(s) + 1e-8)
            bias -= settings.rate * fix * mb / (np.sqrt(sb) + 1e-8)
    return Model(settings, bias, theta[:, 0].astype(np.float32), theta[:, 1:].astype(np.float32))


def held_out(doc_id) -> F.Column:
    """Fold of a document: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(documents: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "quality") -> Model:
    """Fit on the ``settings.train_rows`` labelled documents of smallest id hash outside the held-out fold."""
    small_batches(documents.sparkSession)
    marked = labels.select(F.col("doc_id").alias("key"), F.col(label).cast("int").alias("label")).where("key IS NOT NULL AND label IN (0, 1)")
    marked = marked.where(~held_out(F.col("key"))).groupBy("key").agg(F.min("label").alias("label"))
    sample = marked.orderBy(F.xxhash64("key"), "key").limit(settings.train_rows)
    texts = documents.select(F.col("doc_id").alias("key"), F.col("text").alias("body"))
    # the sample is bounded by train_rows, and so may be broadcast at any size of the corpus
    chosen = texts.join(F.broadcast(sample), "key").groupBy("key").agg(F.min(F.coalesce("body", F.lit(""))).alias("body"), F.min("label").alias("label"))

    def featured(batches):
        for batch in batches:
            labels_, out = batch.column(2).to_numpy(zero_copy_only=False), []
            keys = batch.column(0).to_pylist()
            for block in column_blocks(batch.column(1)):
                x = Features(block, settings.word_bits)
                for i, row in enumerate(block.ids):
                    col, n = np.unique(x.word[x.offs[i] : x.offs[i + 1]], return_counts=True)
                    weight = n * WORD_SCALE / max(1, n.sum())
                    out.append((keys[row], int(labels_[row]), col.astype(np.int32).tobytes(), weight.astype(np.float32).tobytes(), x.bin[i].astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "label", "col", "weight", "bin"), r, strict=True)) for r in out], schema=pa.schema([("key", pa.int64()), ("label", pa.int32()), ("col", pa.binary()), ("weight", pa.binary()), ("bin", pa.binary())]))

    found = chosen.mapInArrow(featured, "key long, label int, col binary, weight binary, bin binary").toArrow().to_pylist()
    found.sort(key=lambda r: (r["key"], r["col"]))
    rows = [(r["label"], np.frombuffer(r["col"], np.int32).astype(np.int64), np.frombuffer(r["weight"], np.float32).astype(np.float64), np.frombuffer(r["bin"], np.int32).astype(np.int64)) for r in found]
    return fit(rows, settings)


def with_score(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``documents`` with the score of each text under ``name`` (a column of that name is replaced); other columns stay outside Python."""
    small_batches(documents.sparkSession)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text))
        for block in column_blocks(text):
            out[block.ids] = model.score(Features(block, model.settings.word_bits))
        return pa.array(out)

    # not deterministic for Spark: it then neither evaluates the score twice nor moves it below joins
    return documents.withColumn(name, score.asNondeterministic()(documents["text"]))
