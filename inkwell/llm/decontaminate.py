"""Benchmark decontamination by spaced-seed hashing.

Fixed masks ignore some word places each. The words a mask keeps are hashed at every place of every benchmark item and
document; the hashes of test and training texts are joined, and equal ones are hits. Around a hit the item
is laid along the document and the best run is found, a word alike adding 1 and a word changed taking away 2. The
run is an overlap when at least ``min_same`` words in it are alike, or the whole item is. Items of fewer words than
``min_same`` must stand in the document whole and unchanged; items under ``min_item`` words take no part. The masks
hit 99.8 of 100 overlaps of items with 5 to 30 of 100 words changed at random (a test holds that against brute force).

Words are runs of letters and digits, in lower case (Spark's, for items and documents alike). Defined results: null or empty texts and items have no
overlap; a repeated item is reported under each of its ids; a null item id is ignored; repeated documents are
judged alike; overlaps are ordered by item. Benchmark items are used in blocks of at most ``block_items`` items and ``block_bytes`` bytes, each a
broadcast index of bounded size; a single longer item is a block alone. Of several blocks one at a time is in memory, and its hits are written.
Columns of the input are kept, but one with the name of the new column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import U64, Words, column_blocks, mix, stream
from .frames import small_batches, written

#: Fixed masks: 1 keeps the word at that place.
MASKS = ("11111111", "1110100111", "1100111011", "11011111", "1101010111", "101101111", "110011111")
MATCH = "array<struct<item_id:long,start:int,words:int,same:int>>"
_PLACES = stream(31, 16) | U64(1)


@dataclass(frozen=True)
class Settings:
    min_same: int = 10
    min_item: int = 5
    block_items: int = 20_000
    block_bytes: int = 16_000_000


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the kept words at every start where the mask fits."""
    n = len(words) - len(mask) + 1
    out = np.zeros(max(n, 0), dtype=U64)
    if n > 0:
        for j, keep in enumerate(mask):
            if keep == "1":
                out += words[j : j + n] * _PLACES[j]
    return mix(out ^ U64(MASKS.index(mask) * 0x9FB21C651E98DF25 & (1 << 64) - 1) if mask in MASKS else out ^ U64(len(mask)))


class Index:
    """The seeds of a block of items: for each mask sorted hashes with item and place."""

    def __init__(self, ids: list[int], texts: list[str], settings: Settings):
        self.settings = settings
        self.items: list[tuple[int, np.ndarray]] = []
        for item, text in zip(ids, texts, strict=True):
            hashes = np.concatenate([np.zeros(0, U64), *[Words(b, "alnum").hash for b in column_blocks(pa.array([text or ""]))]])
            if item is not None and len(hashes) >= settings.min_item:
                self.items.append((item, hashes))
        short = {len(h) for _, h in self.items if len(h) < settings.min_same}
        self.tables = []
        for mask in [*MASKS, *("1" * n for n in sorted(short) if n != len(MASKS[0]))]:
            found = [(seeds(h, mask), i) for i, (_, h) in enumerate(self.items) if mask in MASKS or len(h) == len(mask)]
            if total := sum(len(s) for s, _ in found):
                key = np.concatenate([s for s, _ in found])
                item = np.concatenate([np.full(len(s), i) for s, i in found])
                place = np.concatenate([np.arange(len(s)) for s, _ in found])
                order = np.argsort(key, kind="stable")
                sieve = np.zeros(1 << max(16, (8 * total).bit_length()), dtype=bool)
                bits = U64(64 - (len(sieve).bit_length() - 1))
                sieve[(key >> bits).astype(np.int64)] = True
                self.tables.append((mask, key[order], item[order], place[order], sieve, bits))

    def search(self, hashes: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
        """Overlaps of each document of a block."""
        out: list[dict[int, tuple[int, int, int]]] = [{} for _ in range(len(offs) - 1)]
        tried: set[tuple[int, int, int]] = set()
        for mask, key, item, place, sieve, bits in self.tables:
            h = seeds(hashes, mask)
            at = np.flatnonzero(sieve[(h >> bits).astype(np.int64)])
            doc = np.searchsorted(offs, at, side="right") - 1
            fits = at + len(mask) <= offs[doc + 1]
            at, doc = at[fits], doc[fits]
            lo, hi = np.searchsorted(key, h[at]), np.searchsorted(key, h[at], side="right")
            # the pairs of a place and an item's place, a bounded number at a time
            ends = np.cumsum(hi - lo)
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 18), side="right")))
                n = (hi - lo)[a:b]
                j = np.repeat(lo[a:b] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                lines = np.unique(np.stack((np.repeat(doc[a:b], n), item[j], np.repeat(at[a:b], n) - place[j])), axis=1)
                for line in zip(*lines.tolist(), strict=True):
                    d, i, _ = line
                    # an item that was found whole cannot be found better
                    if line not in tried and out[d].get(i, (0, 0, 0))[2] < len(self.items[i][1]):
                        tried.add(line)
                        self._verify(hashes, int(offs[d]), int(offs[d + 1]), line, out[d])
                a = b
        return [[(self.items[i][0], *run) for i, run in sorted(found.items())] for found in out]

    def _verify(self, hashes: np.ndarray, a: int, b: int, line: tuple[int, int, int], found: dict) -> None:
        _, i, shift = line
        own = self.items[i][1]
        first, last = max(0, a - shift), min(len(own), b - shift)
        same = own[first:last] == hashes[shift + first : shift + last]
        total = np.concatenate(([0], np.cumsum(np.where(same, 1, -2))))
        low = np.minimum.accumulate(total)
        end = int(np.argmax(total - low))
        start = int(np.argmin(total[: end + 1]))
        alike = int(same[start:end].sum())
        need = self.settings.min_same
        if (alike >= need if len(own) >= need else alike == len(own)) and alike > found.get(i, (0, 0, 0))[2]:
            found[i] = (shift + first + start - a, end - start, alike)


def blocks_of(benchmark: DataFrame, settings: Settings):
    """The benchmark as blocks of bounded size, one at a time on the driver."""
    rows = benchmark.select("item_id", F.lower("text").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct().sortWithinPartitions("item_id", "text")
    block, size = [], 0
    for row in rows.toLocalIterator():
        n = len(row["text"].encode())
        if block and (len(block) >= settings.block_items or size + n > settings.block_bytes):
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += n
    yield block


ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("words", pa.int32()), ("same", pa.int32())]))


def searcher(items, settings: Settings):
    """A function of an Arrow column of lower-case texts that gives its overlaps; the index of the broadcast ``items`` is built once a worker."""
    kept: dict = {}

    def overlaps(text: pa.Array) -> pa.Array:
        if "index" not in kept:
            kept["index"] = Index([i for i, _ in items.value], [t for _, t in items.value], settings)
        out: list = [[]] * len(text)
        for part in column_blocks(text):
            words = Words(part, "alnum")
            for row, runs in zip(part.ids, kept["index"].search(words.hash, words.offs), strict=True):
                out[row] = [dict(zip(("item_id", "start", "words", "same"), r, strict=True)) for r in runs]
        return pa.array(out, type=ARROW)

    return overlaps


def with_overlaps(documents: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), name: str = "overlaps") -> DataFrame:
    """``documents`` with the array of its overlaps: item_id, first word, words of the run, words alike."""
    spark = documents.sparkSession
    small_batches(spark)
    none = F.array().cast(MATCH)
    blocks = blocks_of(benchmark, settings)
    first, second = next(blocks), next(blocks, None)
    send = spark.sparkContext.broadcast
    if second is None:
        search = searcher(send(first), settings)

        @F.arrow_udf(MATCH)
        def overlaps(text: pa.Array) -> pa.Array:
            return search(text)

        # not deterministic for Spark: it then neither evaluates the search twice nor moves it below joins
        return documents.withColumn(name, F.coalesce(F.array_sort(overlaps.asNondeterministic()(F.lower(documents["text"]))), none))

    marks = lambda text: (F.xxhash64(text), F.xxhash64(F.lit(577), text))
    text = documents["text"]
    plain = documents.where(F.length(text) > 0).select(*[m.alias(n) for m, n in zip(marks(text), ("m1", "m2"), strict=True)], F.lower(text).alias("low"))
    found = None
    for block in chain((first, second), blocks):
        items = send(block)
        search = searcher(items, settings)

        def hits(batches, search=search):
            for batch in batches:
                own = search(batch.column(2))
                some = pa.array([len(x) > 0 for x in own], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(some), batch.column(1).filter(some), own.filter(some)], names=["m1", "m2", "own"])

        part = written(plain.mapInArrow(hits, f"m1 long, m2 long, own {MATCH}").dropDuplicates(["m1", "m2"]), "overlaps")
        found = part if found is None else found.union(part)
        items.destroy()
    every = written(found.groupBy("m1", "m2").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("every")), "overlaps-all")
    own = [c for c in documents.columns if c != name]
    row = documents.select(F.struct(F.lit(0).alias("__"), *[documents[c] for c in own]).alias("row"), *[m.alias(n) for m, n in zip(marks(text), ("m1", "m2"), strict=True)])
    joined = row.join(every, ["m1", "m2"], "left")
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in own], F.coalesce("every", none).alias(name))
