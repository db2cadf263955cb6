"""Removal of byte strings that also start in an earlier document, by bucket-pointer refinement.

Every place of a text belongs to the bucket of its first ``q`` bytes. A longer string is told apart by refining that
bucket with the bucket identifiers of later places: 40 bytes by the identifiers at 0 and 20, 50 bytes by the refined
identifiers at 0 and 10, each refinement reusing the last; longer ones by the identifiers of all their places. All places
cannot be sorted by shuffle, so only those are refined that can matter:

1. Of every window of ``size`` bytes the place with the smallest q-gram identifier is its anchor; windows in a row
   with one anchor form a run. Equal windows have equal anchors. Anchors meet in their initial bucket; a bucket with
   one document is final. Within a bucket runs are sorted by their refined identifier, which joins the bucket identifiers
   of all their places: a run whose bytes a smaller document has too is covered whole.
2. Runs left in a bucket with other documents (the ends of repeats) are refined window by window: their bytes go to the
   bucket of their anchor, where each window's identifier is refined to ``size`` bytes as above, and sorted with those of
   the other documents. A run's bytes, compressed, take about a sixth of what identifiers of all its windows would.

Documents are dealt into shares by a hash of id and text; each step takes a share whole, in one order, so that a bucket answers
with codes in the order in which its entries were sent, without ids. What repeats within a share is settled there: only the
smallest document's entry goes to the bucket, so that of a string which very many documents have, a bucket receives one entry
a share. The numbers of buckets and of shares follow the counted bytes.

A window is removed when a smaller doc_id holds the same bytes; strings are judged on the input. Identity is by two hashes with
different byte values: of runs 56 bits and the 40 bits of their anchor besides the bucket, of windows 64 bits each.
Defined results: a null or empty text has 0 bytes and nothing removed; rows with a null id are not compared; rows with one id are not
compared with each other, whatever their texts; repeated rows get the same result each; columns besides the two used
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import U64, Block, blocks, cogrouped, grouped, mix, prefix, prefix_of, span_hash, window_hash
from .frames import buckets, let_go, small_batches, text_bytes, written
from .near import packed_texts

_A = U64(0x9E3779B97F4A7C15)
LOW = U64((1 << 32) - 1)


@dataclass(frozen=True)
class Settings:
    size: int = 50
    q: int = 20
    flush: int = 1_500_000

    def refinements(self) -> list[int]:
        """Offsets at which identifiers are joined, from q to size bytes."""
        out, have = [], self.q
        while have < self.size:
            step = min(have, self.size - have)
            out.append(step)
            have += step
        return out


class Runs:
    """Runs of windows of a block: ``anchor`` and ``span`` identifiers, ``first`` window, ``count`` of windows, ``doc``."""

    def __init__(self, block: Block, settings: Settings):
        self.block, self.settings = block, settings
        pre = prefix(block.data)
        self.bucket = window_hash(pre, settings.q) if len(pre) > settings.q else np.zeros(0, U64)
        width = settings.size - settings.q + 1
        n = len(block.data) - settings.size + 1
        starts = np.zeros(0, dtype=np.int64)
        if n > 0:
            q = self.bucket
            least, step = q & ~LOW | np.arange(len(q), dtype=U64), 1
            while 2 * step <= width:
                least = np.minimum(least[:-step], least[step:])
                step *= 2
            least = np.minimum(least[:n], least[width - step : width - step + n])
            place = (least & LOW).astype(np.int64)
            doc = np.repeat(np.arange(len(block)), np.diff(block.offs))[:n]
            inside = np.arange(n) + settings.size <= block.offs[doc + 1]
            new = np.append(True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))[:n]
            starts = np.flatnonzero(new & inside)
            total = np.concatenate(([0], np.cumsum(inside)))
            ends = np.append(starts[1:], n)
            self.count = total[ends] - total[starts]
            self.doc = doc[starts]
            self.anchor = q[place[starts]]
            # the bucket identifiers of all places at which a q-gram of the run starts
            self.span = span_hash(prefix_of(q), starts, starts + self.count + settings.size - settings.q)
        else:
            self.count = self.doc = starts
            self.anchor = self.span = np.zeros(0, U64)
        self.first = starts


def refined(data: np.ndarray, place: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Identifier of the windows at the given places, refined from the bucket identifiers, and their second hash."""

    def identifier(at: np.ndarray, level: int) -> np.ndarray:
        if level == 0:
            return bucket[at]
        step = steps[level - 1]
        return mix(identifier(at, level - 1) * _A + identifier(at + step, level - 1))

    bucket, steps = window_hash(prefix(data), settings.q), settings.refinements()
    return identifier(place, len(steps)), span_hash(prefix(data, 13), place, place + settings.size)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of each, count of them, in a row."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def distinct_rows(doc: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each distinct (doc, keys) in sorted order, and for each row the number of its distinct one."""
    order = np.lexsort((*keys[::-1], doc))
    if not len(order):
        return order, order
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for x in (doc, *keys):
        new[1:] |= x[order][1:] != x[order][:-1]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def low_bytes(x: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(x.astype(U64).view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def from_low(data: bytes, n: int) -> np.ndarray:
    wide = np.zeros((len(data) // n, 8), np.uint8)
    wide[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return wide.view(U64).ravel()


def packed_ints(x: np.ndarray) -> bytes:
    """Whole numbers as offsets from the least, in as few bytes each as the largest needs."""
    low, high = int(x.min()), int(x.max())
    width = next(w for w in (1, 2, 4, 8) if high - low < 1 << 8 * w)
    return np.array([low, width], np.int64).tobytes() + (x.astype(np.int64) - low).astype(f"u{width}").tobytes()


def unpacked_ints(data: bytes) -> np.ndarray:
    low, width = np.frombuffer(data, np.int64, 2).tolist()
    return np.frombuffer(data, f"u{width}", offset=16).astype(np.int64) + low


def packed_rising(x: np.ndarray) -> bytes:
    """Rising whole numbers by their gaps."""
    return x[:1].astype(np.int64).tobytes() + (packed_ints(np.diff(x)) if len(x) > 1 else b"")


def unpacked_rising(data: bytes) -> np.ndarray:
    return np.cumsum(np.append(np.frombuffer(data, np.int64, 1), unpacked_ints(data[8:]) if len(data) > 8 else []).astype(np.int64))


def packed_bytes(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype(np.uint8).tobytes())


def unpacked_bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


SENT = pa.schema([("share", pa.int32()), ("bucket", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("spans", pa.binary())])
SENT_DDL = "share int, bucket int, ids binary, sizes binary, keys binary, spans binary"
#: ``codes`` of the entries of a share in a bucket, in the order sent; a bucket without a code other than 0 sends none.
JUDGED = pa.schema([("share", pa.int32()), ("bucket", pa.int32()), ("codes", pa.binary())])
JUDGED_DDL = "share int, bucket int, codes binary"
DONE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])
DONE_DDL = "doc_id long, n_bytes long, spans array<array<long>>, kept binary"


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Share:
    """The documents of a share by id and text, their runs, and their entries: the distinct runs of each document, by document.

    ``first``, ``count`` and ``entry`` of each run, ``doc``, ``key``, ``span`` and ``run`` of each entry; places are those of ``data``.
    """

    def __init__(self, table: pa.Table, n_buckets: int, settings: Settings):
        self.n, self.settings = n_buckets, settings
        self.number = table["share"][0].as_py()
        tool = zstandard.ZstdDecompressor()
        docs = sorted(zip(table["doc_id"].to_pylist(), map(tool.decompress, table["packed"].to_pylist()), strict=True))
        self.ids = np.array([i for i, _ in docs], np.int64)
        self.data = np.frombuffer(b"".join(t for _, t in docs), np.uint8)
        self.offs = np.concatenate(([0], np.cumsum([len(t) for _, t in docs])))
        batch = pa.RecordBatch.from_arrays([pa.array(self.ids), pa.array([t for _, t in docs], pa.large_binary())], names=["i", "t"])
        del docs
        parts = []
        runs_before = entries_before = 0
        for block in blocks([batch]):
            runs = Runs(block, settings)
            rows, number = distinct_rows(runs.doc, runs.anchor, runs.span)
            small = (x.astype(np.int32) for x in (runs.count, number + entries_before, runs.doc[rows] + block.first, rows + runs_before))
            parts.append((runs.first + self.offs[block.first], *small, runs.anchor[rows], runs.span[rows]))
            runs_before += len(runs.first)
            entries_before += len(rows)
        self.first, self.count, self.entry, self.doc, self.run, self.key, self.span = (np.concatenate(x) for x in zip(*parts, strict=True))

    def covered(self) -> np.ndarray:
        """Whether a smaller document of this share has the entry too: such an entry is removed for certain, and not sent."""
        order = np.lexsort((self.span, self.key))  # stable: the smallest document first
        new = np.append(True, (self.key[order][1:] != self.key[order][:-1]) | (self.span[order][1:] != self.span[order][:-1]))[: len(order)]
        out = np.empty(len(order), dtype=bool)
        ids = self.ids[self.doc[order]]
        out[order] = ids > ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        return out

    def by_bucket(self, some: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """The given entries by bucket, in the order in which they are sent and answered."""
        bucket = (self.key[some] % U64(self.n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        start = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])[: len(order)])
        return [(int(bucket[x[0]]), some[x]) for x in np.split(order, start[1:])] if len(order) else []

    def sent(self, bucket: int, some: np.ndarray, key_bytes: int, spans: bytes) -> tuple:
        ids = self.ids[self.doc[some]]
        start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        return (self.number, bucket, packed_rising(ids[start]), packed_ints(np.diff(np.append(start, len(some)))), low_bytes(self.key[some] // U64(self.n), key_bytes), spans)

    def send_runs(self) -> pa.Table:
        covered = self.covered()
        out = [self.sent(b, some, RUN_BYTES[0], low_bytes(self.span[some], RUN_BYTES[1])) for b, some in self.by_bucket(np.flatnonzero(~covered))]
        if covered.any():
            # handed on under the bucket -1
            out.append((self.number, self.number % self.n, None, None, None, packed_bytes(np.packbits(covered))))
        return table_of(out, SENT)

    def codes(self, verdicts: pa.Table) -> np.ndarray:
        """Of each entry, 1: covered; 2: refine its windows; 0: final."""
        found = dict(zip(verdicts["bucket"].to_pylist(), verdicts["codes"].to_pylist(), strict=True))
        out = np.zeros(len(self.key), dtype=np.uint8)
        if -1 in found:
            out[:] = np.unpackbits(unpacked_bytes(found[-1]), count=len(out))
        for b, some in self.by_bucket(np.flatnonzero(out == 0)):
            if b in found:
                out[some] = unpacked_bytes(found[b])
        return out

    def send_windows(self, codes: np.ndarray) -> pa.Table:
        """The bytes of the runs to refine, with the number of their windows."""
        out = []
        for b, some in self.by_bucket(np.flatnonzero(codes == 2)):
            run = self.run[some]
            count = self.count[run]
            text = self.data[ranges(self.first[run], count + self.settings.size - 1)]
            counts = packed_ints(count)
            out.append(self.sent(b, some, SALT_BYTES, np.int64(len(counts)).tobytes() + counts + packed_bytes(text)))
        return table_of(out, SENT)

    def cut(self, codes: np.ndarray, verdicts: pa.Table) -> pa.Table:
        """What is removed, and what is left of each document."""
        found = dict(zip(verdicts["bucket"].to_pylist(), verdicts["codes"].to_pylist(), strict=True))
        size, mark = self.settings.size, np.zeros(len(self.data) + 1, dtype=np.int32)
        whole = np.flatnonzero(codes[self.entry] == 1)
        np.add.at(mark, self.first[whole], 1)
        np.add.at(mark, self.first[whole] + self.count[whole] + size - 1, -1)
        # for each entry the place of its windows in gone
        at, gone, n = np.full(len(codes), -1), [np.zeros(0, np.uint8)], 0
        for b, some in self.by_bucket(np.flatnonzero(codes == 2)):
            if b in found:
                count = self.count[self.run[some]]
                at[some] = n + np.cumsum(count) - count
                gone.append(np.unpackbits(unpacked_bytes(found[b]), count=int(count.sum())))
                n += len(gone[-1])
        runs = np.flatnonzero(at[self.entry] >= 0)
        hit = np.concatenate(gone)[ranges(at[self.entry[runs]], self.count[runs])] == 1
        place = ranges(self.first[runs], self.count[runs])[hit]
        np.add.at(mark, place, 1)
        np.add.at(mark, place + size, -1)
        out = np.cumsum(mark, out=mark)[:-1] > 0
        rows = []
        for i, a, b in zip(self.ids.tolist(), self.offs[:-1].tolist(), self.offs[1:].tolist(), strict=True):
            edge = np.diff(np.concatenate(([0], out[a:b].astype(np.int8), [0])))
            rows.append((i, b - a, np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)), axis=1).tolist(), self.data[a:b][~out[a:b]].tobytes()))
        return table_of(rows, DONE)


def received(table: pa.Table) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """The rows of a bucket that hold entries, the number of entries of each, and the document of each entry."""
    sent = [r for r in table.to_pylist() if r["keys"] is not None]
    sizes = [unpacked_ints(r["sizes"]) for r in sent]
    docs = [np.repeat(unpacked_rising(r["ids"]), n) for r, n in zip(sent, sizes, strict=True)]
    return sent, np.array([len(d) for d in docs], np.int64), np.concatenate([np.zeros(0, np.int64), *docs])


def judged_runs(table: pa.Table) -> pa.Table:
    out = [(r["share"], -1, r["spans"]) for r in table.to_pylist() if r["keys"] is None]
    sent, sizes, doc = received(table)
    if sent:
        key, span = (np.concatenate([from_low(r[c], n) for r in sent]) for c, n in zip(("keys", "spans"), RUN_BYTES, strict=True))
        codes = np.split(judge_runs(key, span, doc), np.cumsum(sizes)[:-1])
        out += [(r["share"], r["bucket"], packed_bytes(c)) for r, c in zip(sent, codes, strict=True) if c.any()]
    return table_of(out, JUDGED)


#: Windows sorted at once in a bucket. Anchors are told apart by their salt; the windows of one salt that exceed this go in several passes.
WINDOWS = 1 << 20


def judged_windows(table: pa.Table, settings: Settings, most: int = WINDOWS) -> pa.Table:
    """Of each window sent, whether a smaller document has it too, as bits."""
    sent, sizes, doc = received(table)
    if not sent:
        return table_of([], JUDGED)
    cut = [8 + int(np.frombuffer(r["spans"], np.int64, 1)[0]) for r in sent]
    count = np.concatenate([unpacked_ints(r["spans"][8:c]) for r, c in zip(sent, cut, strict=True)])
    data = np.concatenate([unpacked_bytes(r["spans"][c:]) for r, c in zip(sent, cut, strict=True)])
    salt = np.concatenate([from_low(r["keys"], SALT_BYTES) for r in sent])
    long = count + settings.size - 1
    start = np.cumsum(long) - long
    bit = np.cumsum(count) - count
    gone = np.zeros(int(count.sum()), dtype=bool)
    order = np.lexsort((doc, salt))
    new = np.append(True, salt[order][1:] != salt[order][:-1])
    # slices of whole salts, of about so many windows; what one salt has beyond goes by residue of the identifier
    before = (np.cumsum(count[order]) - count[order])[np.flatnonzero(new)][np.cumsum(new) - 1]
    for some in np.split(order, np.flatnonzero(np.diff(before // most)) + 1):
        some = some[np.argsort(doc[some], kind="stable")]
        passes = -(-int(count[some].sum()) // (2 * most))
        step = max(1, (1 << 18) // settings.size)
        for p in range(passes):
            found = []
            for i in range(0, len(some), step):
                x = some[i : i + step]
                text = data[ranges(start[x], long[x])]
                key, second = refined(text, ranges(np.cumsum(long[x]) - long[x], count[x]), settings)
                own = (key, second, np.repeat(doc[x], count[x]), ranges(bit[x], count[x]))
                found.append(own if passes == 1 else tuple(c[key % U64(passes) == p] for c in own))
            key, second, d, at = (np.concatenate(c) for c in zip(*found, strict=True))
            gone[at] = judge_windows(key, second, d)
    out, ends = [], np.cumsum(sizes)
    edges = np.concatenate(([0], np.cumsum(count)))
    for r, a, b in zip(sent, edges[ends - sizes].tolist(), edges[ends].tolist(), strict=True):
        if gone[a:b].any():
            out.append((r["share"], r["bucket"], packed_bytes(np.packbits(gone[a:b]))))
    return table_of(out, JUDGED)


def judge_runs(key: np.ndarray, span: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """1: a smaller document has the whole run; 2: refine its windows; 0: final."""
    order = np.lexsort((doc, span, key))
    k, s, d = key[order], span[order], doc[order]
    new_key = np.append(True, k[1:] != k[:-1])[: len(k)]
    new_span = new_key | np.append(True, s[1:] != s[:-1])[: len(k)]
    start = np.flatnonzero(new_key)
    group = np.cumsum(new_key) - 1
    smallest = d[np.flatnonzero(new_span)][np.cumsum(new_span) - 1]
    several = (np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start))[group] & (np.add.reduceat(new_span.astype(np.int64), start) > 1)[group]
    out = np.zeros(len(k), dtype=np.int64)
    out[order] = np.where(d > smallest, 1, np.where(several, 2, 0))
    return out


def judge_windows(key: np.ndarray, second: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the window; documents rise."""
    order = np.argsort(key, kind="stable")
    k, s = key[order], second[order]
    same = k[1:] == k[:-1]
    if (s[1:] != s[:-1])[same].any():  # two windows with one identifier
        order = np.lexsort((second, key))
        k, s = key[order], second[order]
        same = (k[1:] == k[:-1]) & (s[1:] == s[:-1])
    new = np.append(True, ~same)[: len(k)]
    d = doc[order]
    out = np.zeros(len(k), dtype=bool)
    out[order] = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


#: Bytes sent of the identifiers of runs (anchor, run), and of the anchor where the run's bytes go along.
RUN_BYTES, SALT_BYTES = (5, 7), 2
#: About so many bytes of text make one entry.
ENTRY = 16


def removed(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed [start, end) byte spans and the remaining bytes of every document."""
    spark = documents.sparkSession
    small_batches(spark)
    documents = documents.select(documents["doc_id"].cast("long"), documents["text"])
    keyed = documents.where("doc_id IS NOT NULL")
    size = text_bytes(keyed)
    n_buckets, n_shares = buckets(spark, size), buckets(spark, size, ENTRY * settings.flush)
    shares = packed_texts(keyed, F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(n_shares)).cast("int").alias("share")).groupBy("share")

    def refine(share: pa.Table, verdicts: pa.Table) -> pa.Table:
        if not share.num_rows:
            return table_of([], SENT)
        own = Share(share, n_buckets, settings)
        return own.send_windows(own.codes(verdicts))

    def cut(share: pa.Table, verdicts: pa.Table) -> pa.Table:
        if not share.num_rows:
            return table_of([], DONE)
        own = Share(share, n_buckets, settings)
        first = verdicts["step"].to_numpy() == 1
        return own.cut(own.codes(verdicts.filter(pa.array(first))), verdicts.filter(pa.array(~first)))

    sent = shares.applyInArrow(grouped(lambda t: Share(t, n_buckets, settings).send_runs()), SENT_DDL)
    first = written(sent.groupBy("bucket").applyInArrow(grouped(judged_runs), JUDGED_DDL), "repeat-runs", True)
    let_go(spark)
    sent = shares.cogroup(first.groupBy("share")).applyInArrow(cogrouped(refine), SENT_DDL)
    second = written(sent.groupBy("bucket").applyInArrow(grouped(lambda t: judged_windows(t, settings)), JUDGED_DDL), "repeat-windows", True)
    let_go(spark)
    verdicts = first.withColumn("step", F.lit(1)).union(second.withColumn("step", F.lit(2)))
    done = shares.cogroup(verdicts.groupBy("share")).applyInArrow(cogrouped(cut), DONE_DDL)
    text = F.coalesce("text", F.lit("")).cast("binary")
    alone = documents.where("doc_id IS NULL").select("doc_id", F.length(text).cast("long").alias("n_bytes"), F.array().cast("array<array<long>>").alias("spans"), text.alias("kept"))
    return done.union(alone)
