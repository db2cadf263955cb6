"""N-gram Jaccard join by universe-partition pigeonhole, and the classes of near duplicates that its links make.

A document's set holds its distinct shingles. Two sets whose sizes add up to s can only be similar if they differ in
at most ``s (1 - t) / (1 + t)`` shingles. Sizes fall into bands; each band hashes the universe of shingles into more
segments than sets of the band may differ by, so two similar sets agree on some whole segment. Indexed are the
subsets of a set in the segments of its own band and of the band below, where smaller partners are. In small bands
also every subset with one shingle deleted is indexed: a segment of two shingles or more then stands for two
differences. Costs decide what a segment is allotted: an empty one, or one whose subset is shared by more than
``frequent`` different texts of different classes, is worth nothing. A document whose other segments are too few for
the pigeonhole shares such a frequent subset with each partner it may have missed: the members of these groups, and they
alone, are indexed again with their universe cut ``finer`` times finer, so that what is frequent falls into segments of its own
and the rest of a set is worth more. Documents that still have too few are compared with those members, in blocks; those whose
segments were too few from the start (very few) with all documents.

Exact copies (equal sets) meet first, by a 128-bit fingerprint. Candidates are checked against counts of shingles by
hash cell, which bound the difference from below, then verified on the whole texts. Candidates within a group are
not paired with each other: first each is verified against the group's smallest document; classes are formed; only
members of different classes are then paired, in groups up to ``frequent``.

Defined results: null and empty texts, and texts without words, have an empty set and no links. Documents under
``size`` words have one shingle. Rows with a null id are no one's partner: they have the size of their set and a null class. Repeated rows of one
id are one document. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import U64, Words, blocks, distinct, grouped, mapped, mix, shingles, stream
from .components import components
from .frames import buckets, small_batches, written

_SALT = stream(41, 8) | U64(1)


@dataclass(frozen=True)
class Settings:
    """``size`` words a shingle; similarity of at least ``percent`` / 100; ``cut`` times as many segments as the bands need."""

    size: int = 5
    percent: int = 80
    small_band: int = 40
    frequent: int = 32
    flush_keys: int = 1_500_000
    block_shingles: int = 2_000_000
    finer: tuple[int, ...] = (4, 16)
    cut: int = 1

    def differ(self, total):
        """Most differences of two similar sets whose sizes add up to ``total``."""
        return total * (100 - self.percent) // (100 + self.percent)

    @property
    def least(self) -> int:
        """Smallest set that can be similar to a different set."""
        n = 1
        while self.differ(n + n * 100 // self.percent) < 1:
            n += 1
        return n


@lru_cache(maxsize=8)
def bands(settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowest size, highest size and segments of every band."""
    low, high, segments, at = [], [], [], settings.least
    ratio = (100 / settings.percent) ** 2
    while at < 1 << 31:
        top = max(at, int(np.ceil(ratio * at)) - 1)
        low.append(at)
        high.append(top)
        segments.append((settings.differ(top + top * 100 // settings.percent) + 1 + max(3, top // 25)) * settings.cut)
        at = top + 1
    return np.array(low), np.array(high), np.array(segments)


def sets(block, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    values, offs = shingles(Words(block, "space"), settings.size)
    return distinct(values, offs)


def summed(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of each document's values, modulo 2**64."""
    total = np.concatenate((np.zeros(1, U64), np.cumsum(values, dtype=U64)))
    return total[offs[1:]] - total[offs[:-1]]


def cells(n: int) -> int:
    """Cells of the counts of a set of size n: a power of two, about a quarter of n."""
    return 1 << max(4, int(n // 4).bit_length())


def counts_of(values: np.ndarray) -> bytes:
    k = cells(len(values))
    at = (mix(values ^ _SALT[0]) >> U64(64 - (k.bit_length() - 1))).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=k), 65535).astype(np.uint16).tobytes() if len(values) > 4095 else np.bincount(at, minlength=k).astype(np.uint8).tobytes()


def read_counts(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if n > 4095 else np.uint8).astype(np.int64)


def may_be_similar(a: bytes, n_a: int, b: bytes, n_b: int, settings: Settings) -> bool:
    """False only where the counts prove that the sets differ too much."""
    most = settings.differ(n_a + n_b)
    if abs(n_a - n_b) > most:
        return False
    x, y = read_counts(a, n_a), read_counts(b, n_b)
    k = min(len(x), len(y))
    return int(np.abs(x.reshape(k, -1).sum(1) - y.reshape(k, -1).sum(1)).sum()) <= most


def profiles(documents: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, n, f1, f2, counts, spare, spare_below): size, fingerprint, cell counts, and segments beyond those needed."""

    def made(batches):
        for block in blocks(batches):
            values, offs = sets(block, settings)
            n = np.diff(offs)
            f1, f2 = summed(mix(values ^ _SALT[1]), offs), summed(mix(values ^ _SALT[2]), offs)
            count = [counts_of(values[a:b]) if b - a >= settings.least else None for a, b in zip(offs[:-1], offs[1:], strict=True)]
            spare = np.full((2, len(n)), 1 << 30)
            docs = np.flatnonzero(n >= settings.least)
            for i, (chosen, band) in enumerate(schemes(n[docs], settings)):
                if chosen.any():
                    worth = keys(values, offs, docs[chosen], band, settings, False)[2]
                    spare[i, docs[chosen]] = worth - need(n[docs[chosen]], band, settings)
            yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(count, pa.binary()), pa.array(spare[0].astype(np.int32)), pa.array(spare[1].astype(np.int32))], names=["doc_id", "n", "f1", "f2", "counts", "spare", "spare_below"])

    return documents.where("doc_id IS NOT NULL").mapInArrow(mapped(made), "doc_id long, n long, f1 long, f2 long, counts binary, spare int, spare_below int")


def keys(values: np.ndarray, offs: np.ndarray, docs: np.ndarray, band: np.ndarray, settings: Settings, made: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index keys of the chosen documents, each in the band given for it: key, document, and what its segments are worth."""
    high, segments = bands(settings)[1:]
    n, m = offs[docs + 1] - offs[docs], segments[band]
    base = np.concatenate(([0], np.cumsum(m)))
    row = np.repeat(np.arange(len(docs)), n)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    token = values[np.repeat(offs[docs] - first, n) + np.arange(int(n.sum()))]
    part = ((mix(token ^ _SALT[3]) >> U64(33)) * m[row].astype(U64) >> U64(31)).astype(np.int64)
    at = base[row] + part
    own = mix(token ^ _SALT[4])
    count = np.bincount(at, minlength=base[-1])
    held = np.flatnonzero(count)
    size = count[held]
    doc = np.searchsorted(base, held, side="right") - 1
    small = high[band[doc]] <= settings.small_band
    worth = np.bincount(doc, 1 + (small & (size > 1)), minlength=len(docs)).astype(np.int64)
    if not made:
        return size, doc, worth
    order = np.argsort(at, kind="stable")
    total = np.add.reduceat(own[order], np.cumsum(size) - size) if len(held) else np.zeros(0, U64)
    place = (held - base[doc]).astype(U64) * _SALT[5] + band[doc].astype(U64) * _SALT[6]
    key = [mix(total + place)]
    who = [doc]
    group = np.repeat(np.arange(len(held)), size)
    cut = (small & (size > 1))[group]
    if cut.any():
        g = group[cut]
        key.append(mix(total[g] - own[order][cut] + place[g]))
        who.append(doc[g])
    return np.concatenate(key), np.concatenate(who), worth


def band_of(n: np.ndarray, settings: Settings) -> np.ndarray:
    return np.searchsorted(bands(settings)[0], n, side="right") - 1


def need(n, band, settings: Settings):
    """Segments a set of size n must have left in a band, to find all partners of at most its size there."""
    return settings.differ(np.minimum(bands(settings)[1][band], n) + n) + 1


def schemes(n: np.ndarray, settings: Settings):
    """The band of each set and, where smaller partners can be in it, the band below: (which sets, their bands)."""
    own = band_of(n, settings)
    below = (own > 0) & (np.ceil(n * settings.percent / 100) <= bands(settings)[1][np.maximum(own - 1, 0)])
    return (np.ones(len(n), dtype=bool), own), (below, own[below] - 1)


INDEX = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("slots", pa.binary()), ("ids", pa.binary())])


def index_rows(documents: DataFrame, settings: Settings, n_buckets: int) -> DataFrame:
    """Packed index entries by bucket."""

    def flushed(kept: list, ids: list):
        key, slot, doc_ids = np.concatenate([k for k, _ in kept]), np.concatenate([s for _, s in kept]), np.concatenate(ids)
        bucket = (key % U64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        out = []
        for b in range(n_buckets):
            some = order[cuts[b] : cuts[b + 1]]
            if len(some):
                used, local = np.unique(slot[some], return_inverse=True)
                raw = np.ascontiguousarray((key[some] // U64(n_buckets)).view(np.uint8).reshape(-1, 8)[:, :6])
                ids_ = doc_ids[used >> 8]
                low = int(ids_.min())
                narrow = int(ids_.max()) - low < 1 << 32
                head = np.array([len(used), low, narrow], np.int64).tobytes()
                packed_ids = (ids_ - low).astype(np.uint32).tobytes() if narrow else ids_.tobytes()
                out.append((b, raw.tobytes(), local.astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes(), head + packed_ids + (used & 255).astype(np.uint8).tobytes()))
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, INDEX, strict=True)], schema=INDEX)

    def made(batches):
        kept, ids, n_docs, n_keys = [], [], 0, 0
        seen: set[tuple[int, int]] = set()
        for block in blocks(batches):
            values, offs = sets(block, settings)
            n = np.diff(offs)
            f1, f2 = summed(mix(values ^ _SALT[1]), offs), summed(mix(values ^ _SALT[2]), offs)
            fresh = []
            for i in np.flatnonzero(n >= settings.least).tolist():  # exact copies among these documents are indexed once
                mark = (int(f1[i]), int(f2[i]))
                if mark not in seen:
                    seen.add(mark)
                    fresh.append(i)
            docs = np.array(fresh, dtype=np.int64)
            if not len(docs):
                continue
            for chosen, band in schemes(n[docs], settings):
                if chosen.any():
                    key, who, _ = keys(values, offs, docs[chosen], band, settings)
                    kept.append((key, (np.flatnonzero(chosen)[who] + n_docs) << 8 | band[who]))
                    n_keys += len(key)
            ids.append(block.ids[docs])
            n_docs += len(docs)
            if n_keys >= settings.flush_keys:
                yield flushed(kept, ids)
                kept, ids, n_docs, n_keys = [], [], 0, 0
                seen = set()
        if kept:
            yield flushed(kept, ids)

    return documents.where("doc_id IS NOT NULL").mapInArrow(mapped(made), "bucket int, keys binary, slots binary, ids binary")


GROUP_DDL = "gid long, band int, members array<long>, weight long"


def groups(index: DataFrame) -> DataFrame:
    """(gid, band, members, weight): documents that share a key, smallest first, and how many keys have just these members."""

    def shared(table: pa.Table) -> pa.Table:
        schema = pa.schema([("gid", pa.int64()), ("band", pa.int32()), ("members", pa.list_(pa.int64())), ("weight", pa.int64())])
        key, doc, band = [], [], []
        for k, s, i in zip(table.column("keys").to_pylist(), table.column("slots").to_pylist(), table.column("ids").to_pylist(), strict=True):
            n_used, low, narrow = np.frombuffer(i, np.int64, 3).tolist()
            ids = np.frombuffer(i, np.uint32, n_used, 24).astype(np.int64) + low if narrow else np.frombuffer(i, np.int64, n_used, 24)
            own = np.frombuffer(i, np.uint8, n_used, 24 + (4 if narrow else 8) * n_used)
            local = np.frombuffer(s, np.uint16 if n_used < 65536 else np.uint32)
            wide = np.zeros((len(local), 8), np.uint8)
            wide[:, :6] = np.frombuffer(k, np.uint8).reshape(-1, 6)
            key.append(wide.view(U64).ravel())
            doc.append(ids[local])
            band.append(own[local])
        key, doc, band = np.concatenate(key), np.concatenate(doc), np.concatenate(band)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        order = order[np.append(same, False) | np.append(False, same)]  # keys that stand alone find no one
        order = order[np.lexsort((doc[order], key[order]))]
        key, doc, band = key[order], doc[order], band[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))[: len(key)]
        key, doc, band = key[fresh], doc[fresh], band[fresh]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        size = np.diff(np.append(start, len(key)))
        start, size = start[size > 1], size[size > 1]
        if not len(start):
            return pa.table([pa.array([], f.type) for f in schema], schema=schema)
        total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(doc.view(U64) ^ _SALT[7]), dtype=U64)))
        mark = mix(total[start + size] - total[start] + size.astype(U64)) ^ band[start].astype(U64)
        _, kept, weight = np.unique(mark, return_index=True, return_counts=True)
        start, size = start[kept], size[kept]
        ends = np.concatenate(([0], np.cumsum(size)))
        flat = doc[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        gid = mix(np.arange(len(start), dtype=U64) + (U64(table.column("bucket")[0].as_py()) << U64(40)))
        return pa.table([pa.array(gid.view(np.int64)), pa.array(band[start].astype(np.int32)), lists, pa.array(weight)], schema=schema)

    return index.groupBy("bucket").applyInArrow(grouped(shared), GROUP_DDL)


def packed_texts(documents: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, packed, and what else is given): texts compressed for the shuffle."""

    @F.arrow_udf("binary")
    def pack(text: pa.Array) -> pa.Array:
        tool = zstandard.ZstdCompressor(level=3)
        return pa.array([tool.compress((t.as_py() or "").encode()) for t in text], pa.binary())

    return documents.select("doc_id", pack("text").alias("packed"), *more)


def unpack(column: pa.Array) -> pa.Array:
    tool = zstandard.ZstdDecompressor()
    return pa.array([tool.decompress(x.as_py()) for x in column], pa.binary())


#: Lists of ids up to so many rows are broadcast; longer ones meet the texts in a shuffle.
BROADCAST_IDS = 200_000


def of_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` with the given distinct ids, once each."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


class Forest:
    """Which documents are joined already; only links that join two trees are worth sending on."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def verified(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) that are similar, by their whole texts. A document's partners are dealt out in parts of 128."""
    spread = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 128).cast("int").alias("parts"))
    member = pairs.join(spread, "a").select(F.col("b").alias("doc_id"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    centre = spread.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    dealt = texts.join(member.union(centre), "doc_id").select("doc_id", "a", "part", "role", "packed")
    dealt = dealt.repartition(buckets(pairs.sparkSession), "a", "part").sortWithinPartitions("a", "part", "role")

    def compared(batches):
        held, own = None, None
        for batch in batches:
            a, b, role = batch.column(1).to_pylist(), [], batch.column(3).to_pylist()
            left: list[int] = []
            flat = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), unpack(batch.column(4))], names=["i", "t"])
            ids = batch.column(0).to_pylist()
            for block in blocks([flat]):
                values, offs = sets(block, settings)
                for j, i in enumerate(block.ids.tolist()):
                    mine = values[offs[j] : offs[j + 1]]
                    if role[i] == 0:
                        held, own = a[i], mine
                    elif held == a[i] and len(mine) and len(own):
                        at = np.searchsorted(own, mine)
                        both = int((own[np.minimum(at, len(own) - 1)] == mine).sum())
                        if 100 * both >= settings.percent * (len(own) + len(mine) - both):
                            left.append(a[i])
                            b.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

    return dealt.mapInArrow(mapped(compared), "u long, v long")


def possible(pairs: DataFrame, profile: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose sizes and cell counts do not rule out similarity."""
    side = lambda x: profile.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("counts").alias(f"counts_{x}"))

    @F.arrow_udf("boolean")
    def may(a: pa.Array, n_a: pa.Array, b: pa.Array, n_b: pa.Array) -> pa.Array:
        rows = zip(a.to_pylist(), n_a.to_pylist(), b.to_pylist(), n_b.to_pylist(), strict=True)
        return pa.array([x is not None and y is not None and may_be_similar(x, n, y, k, settings) for x, n, y, k in rows], pa.bool_())

    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * settings.percent)
    return sized.where(may("counts_a", "n_a", "counts_b", "n_b")).select("a", "b")


def against_all(rest: DataFrame, documents: DataFrame, others: DataFrame, settings: Settings) -> DataFrame:
    """Links (u, v) of the documents in ``rest`` with all of ``others``, by an inverted index of one block of them at a time.

    Every one of the others is compared with every block; of the links that a task finds those that join nothing new stay behind.
    """
    spark = documents.sparkSession
    chosen = of_ids(documents, rest.distinct())
    held, size = [], 0
    out = spark.createDataFrame([], "u long, v long")

    def scan(part: list) -> DataFrame:
        packed = spark.sparkContext.broadcast(part)

        def made(batches):
            ids = np.array([i for i, _ in packed.value], dtype=np.int64)
            own = [np.frombuffer(x, U64) for _, x in packed.value]
            token, who, n_own = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own]), np.array([len(x) for x in own])
            order = np.argsort(token, kind="stable")
            token, who = token[order], who[order]
            forest = Forest()
            for block in blocks(batches):
                values, offs = sets(block, settings)
                u, v = [], []
                for j, doc in enumerate(block.ids.tolist()):
                    mine = values[offs[j] : offs[j + 1]]
                    lo, hi = np.searchsorted(token, mine), np.searchsorted(token, mine, side="right")
                    n = hi - lo
                    hits = who[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))] if n.sum() else np.zeros(0, np.int64)
                    both = np.bincount(hits, minlength=len(own))
                    for k in np.flatnonzero((both > 0) & (100 * both >= settings.percent * (n_own + len(mine) - both))).tolist():
                        if forest.join(int(ids[k]), doc):
                            u.append(int(ids[k]))
                            v.append(doc)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        links = written(others.where("doc_id IS NOT NULL").mapInArrow(mapped(made), "u long, v long"), "near-rest")
        packed.destroy()
        return links

    def as_sets(batches):
        for block in blocks(batches):
            values, offs = sets(block, settings)
            yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array([values[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.binary())], names=["doc_id", "shingles"])

    for row in written(chosen.mapInArrow(mapped(as_sets), "doc_id long, shingles binary"), "near-rest-sets").toLocalIterator():
        held.append((row["doc_id"], bytes(row["shingles"])))
        size += len(row["shingles"]) // 8
        if size >= settings.block_shingles:
            out = out.union(scan(held))
            held, size = [], 0
    return out.union(scan(held)) if held else out


def links(documents: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Profiles with ``rep`` (smallest document of an equal set), and links (u, v) between reps that join every class."""
    spark = documents.sparkSession
    small_batches(spark)
    documents = documents.select(documents["doc_id"], documents["text"])
    profile = written(profiles(documents, settings), "near-profiles")
    # written, so that the join below is one that Spark can split where copies of one text fill a partition
    rep = profile.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    rep = written(rep.where("copies > 1").drop("copies"), "near-copies", True)
    named = written(profile.join(rep, ["n", "f1", "f2"], "left").select("doc_id", "n", "counts", "spare", "spare_below", F.coalesce("rep", "doc_id").alias("rep")), "near-reps")
    alone = named.dropDuplicates(["doc_id"])

    every, left, pool = indexed(documents, alone, settings)
    few = written(alone.where("spare < 0 OR spare_below < 0").select("doc_id").distinct(), "near-rest-ids", True)
    if not few.isEmpty():
        every = every.union(against_all(few, documents, documents, settings))
    if not left.isEmpty():
        some = written(of_ids(documents, pool), "near-pool")
        for cut in settings.finer:
            # one pass over the members costs less than another index, as long as what is left fits into one block
            if (left.join(alone.select("doc_id", "n"), "doc_id").agg(F.sum("n")).first()[0] or 0) <= settings.block_shingles:
                every = every.union(against_all(left, documents, some, settings))
                break
            own = replace(settings, cut=cut)
            fine = written(profiles(some, own).withColumn("rep", F.col("doc_id")), "near-profiles")
            more, lost, _ = indexed(some, fine, own)
            every = every.union(more)
            short = lost.union(fine.where("spare < 0 OR spare_below < 0").select("doc_id")).distinct()
            left = written(left.join(short, "doc_id", "left_semi"), "near-rest-ids", True)
            if left.isEmpty():
                break
        else:
            every = every.union(against_all(left, documents, some, settings))
    return named, every


def indexed(documents: DataFrame, alone: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the index of ``documents`` finds: links (u, v) between reps; the ids of documents that lost too many segments to
    frequent groups; and the members of those groups. ``alone`` has one row a document."""
    spark = documents.sparkSession
    # an index takes about six bytes a shingle
    size = 6 * settings.cut * (alone.agg(F.sum("n")).first()[0] or 0)
    found = written(groups(index_rows(documents, settings, buckets(spark, size))), "near-groups")
    star = found.select(F.element_at("members", 1).alias("c"), F.explode(F.slice("members", 2, 1 << 30)).alias("x"), "weight").groupBy("c", "x").agg(F.sum("weight").alias("weight"))
    to_rep = alone.select("doc_id", "rep")
    star = star.join(to_rep.select(F.col("doc_id").alias("c"), F.col("rep").alias("rc")), "c").join(to_rep.select(F.col("doc_id").alias("x"), F.col("rep").alias("rx")), "x").where("rc <> rx")
    star = written(star.select("c", "x", F.least("rc", "rx").alias("a"), F.greatest("rc", "rx").alias("b"), "weight"), "near-stars")

    ahead = written(possible(star.select("a", "b").distinct(), alone, settings), "near-pairs")
    needed = ahead.select(F.col("a").alias("doc_id")).union(ahead.select("b")).distinct()
    texts = written(of_ids(packed_texts(documents), written(needed, "near-needed", True)), "near-texts")

    # first every document against the partner it shares most keys with
    best = star.groupBy("a", "b").agg(F.sum("weight").alias("w")).join(ahead, ["a", "b"], "left_semi").groupBy("b").agg(F.max_by("a", F.struct(F.col("w"), -F.col("a"))).alias("a"))
    best = written(best.select("a", "b"), "near-first", True)
    sure = written(verified(best, texts, settings), "near-links", True)
    named_class = written(components(sure), "near-classes", True)

    def classed(df: DataFrame, name: str) -> DataFrame:
        return df.join(named_class.select(F.col("node").alias(name), F.col("component").alias(f"k_{name}")), name, "left").withColumn(f"k_{name}", F.coalesce(f"k_{name}", name))

    # then members of different classes that share a key
    open_ = written(classed(classed(star, "a"), "b").where("k_a <> k_b"), "near-open", True)
    again = open_.select("a", "b").distinct().join(ahead, ["a", "b"], "left_semi")
    centres = open_.select("c").distinct()
    mixed = found.where(F.size("members") > 2).join(centres, F.element_at("members", 1) == F.col("c"), "left_semi")
    member = mixed.select("gid", "band", "weight", F.explode("members").alias("doc_id")).join(to_rep, "doc_id").select("gid", "band", "weight", F.col("rep").alias("m")).distinct()
    member = written(classed(member, "m"), "near-members")
    size = member.groupBy("gid").agg(F.count(F.lit(1)).alias("size"), F.min("k_m").alias("k1"), F.max("k_m").alias("k2")).where("k1 <> k2").select("gid", "size")
    few = member.join(size.where(F.col("size") <= settings.frequent), "gid", "left_semi").select("gid", "m", "k_m")
    cross = few.alias("l").join(few.alias("r"), (F.col("l.gid") == F.col("r.gid")) & (F.col("l.m") < F.col("r.m")) & (F.col("l.k_m") != F.col("r.k_m"))).select(F.col("l.m").alias("a"), F.col("r.m").alias("b")).distinct()
    more = possible(cross.join(ahead, ["a", "b"], "left_anti"), alone, settings)
    pairs = written(again.union(more).distinct().join(best, ["a", "b"], "left_anti"), "near-second")
    second_texts = texts
    extra = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct().join(texts.select("doc_id"), "doc_id", "left_anti"), "near-needed", True)
    if not extra.isEmpty():
        second_texts = texts.union(of_ids(packed_texts(documents), extra))
    also = verified(pairs, second_texts, settings)

    # documents that lost too many segments to frequent groups, and who is in these groups with them
    hot = written(member.join(size.where(F.col("size") > settings.frequent), "gid", "left_semi").select("gid", "band", "weight", F.col("m").alias("doc_id")), "near-hot")
    lost = hot.groupBy("doc_id", "band").agg(F.sum("weight").alias("lost"))
    high = F.lit(bands(settings)[1].tolist())
    lost = lost.withColumn("lost", F.col("lost") * F.when(F.get(high, F.col("band")) <= settings.small_band, 2).otherwise(1)).groupBy("doc_id").agg(F.max_by("lost", "band").alias("upper"), F.min_by("lost", "band").alias("lower"), F.max("band").alias("top"), F.min("band").alias("low"))
    rest = written(lacking(lost, alone, settings).distinct(), "near-lost", True)
    theirs = hot.join(rest, "doc_id", "left_semi").select("gid").distinct()
    pool = written(hot.join(theirs, "gid", "left_semi").select("doc_id").distinct(), "near-pool-ids", True)
    return sure.union(also), rest, pool


def lacking(lost: DataFrame, alone: DataFrame, settings: Settings) -> DataFrame:
    """Ids of documents whose segments are too few for the pigeonhole once those of frequent groups are worth nothing."""
    low = F.lit(bands(settings)[0].tolist())
    own = F.size(F.filter(low, lambda x: x <= F.col("n"))) - 1
    held = lost.join(alone.where("doc_id = rep"), "doc_id").withColumn("own", own)
    gone = F.when(F.col("top") == F.col("own"), F.col("upper")).otherwise(0)
    below = F.when(F.col("low") < F.col("own"), F.col("lower")).otherwise(0)
    return held.where((gone > F.col("spare")) | (below > F.col("spare_below"))).select("doc_id")


def classes(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id): each row's set size and the smallest document its links reach."""
    named, found = links(documents, settings)
    joined = components(found)
    out = named.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n", "rep", F.coalesce("component", "rep").alias("component_id"))
    # repeated rows of one id are one document: the smallest class any of them reaches
    least = out.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = out.select("doc_id", "n").join(least, "doc_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")

    def sizes(batches):
        for block in blocks(batches):
            n = np.diff(sets(block, settings)[1])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(n), pa.nulls(len(n), pa.int64())], names=["doc_id", "n_shingles", "component_id"])

    nameless = documents.where("doc_id IS NULL").select(F.lit(0).alias("row"), "text").mapInArrow(mapped(sizes), "doc_id long, n_shingles long, component_id long")
    return out.union(nameless)
