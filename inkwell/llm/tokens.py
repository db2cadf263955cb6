"""Token counts without token ids.

Texts are cut into pre-tokens. Each chunk of documents (about ``chunk_bytes`` of text) keeps its distinct pre-tokens
and, for each document, which of them it has and how often. The distinct pre-tokens of all chunks meet by hash
bucket (as many as the counted bytes ask for), where the library counts the pieces of each one once; the counts go back to the chunks, and a document's
total is the sum of frequency times count. Ids are never made, and what is shuffled is one entry for each distinct
pre-token of a chunk, however often the corpus repeats it.

Special strings inside a text follow the library's default: each is one token and separates what stands around it.
Defined results: a null text counts as empty, an empty text has 0 bytes and 0 tokens; repeated rows are counted
each; null ids stay null; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import grouped, mapped
from .frames import buckets, small_batches, text_bytes, written

#: Fixed pattern of byte-level pre-tokenisation, with white space as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@dataclass(frozen=True)
class Settings:
    """``path``: tokenizer file of the ``tokenizers`` library, found on every worker; ``limit``: tokens of a context."""

    path: str = ""
    limit: int = 1024
    chunk_bytes: int = 12_000_000

    @property
    def file(self) -> str:
        return self.path or default_tokenizer()


class Cutter:
    """Pre-tokens and special strings of a text."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level tokenizers without a normaliser are supported")
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.find = regex.compile(PATTERN).findall

    def __call__(self, text: str) -> tuple[list[str], int]:
        if self.special is None or not self.special.search(text):
            return self.find(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.find(part)], len(parts) - 1


def packed(texts: list[str]) -> bytes:
    raw = [t.encode() for t in texts]
    return np.array([len(raw), *map(len, raw)], dtype=np.uint32).tobytes() + b"".join(raw)


def unpacked(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64) + 4 * (n + 1)
    out, at = [], 4 * (n + 1)
    for e in ends.tolist():
        out.append(data[at:e])
        at = e
    return out


CHUNK = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("specials", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])
CHUNK_DDL = "kind string, chunk long, bucket int, data binary, doc_ids array<long>, n_bytes array<long>, specials array<long>, sizes array<int>"


class Chunk:
    """Distinct pre-tokens of some documents, and the frequencies of each document."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.ids, self.n_bytes, self.specials, self.sizes = [], [], [], []
        self.index, self.freq = [], []
        self.total = 0

    def add(self, doc_id, text: str | None, cut: Cutter) -> None:
        pieces, special = cut(text or "")
        count, known = Counter(pieces), self.known
        for p in count:
            if p not in known:
                known[p] = len(known)
        size = len((text or "").encode())
        self.ids.append(doc_id)
        self.n_bytes.append(size)
        self.specials.append(special)
        self.sizes.append(len(count))
        self.index.append(np.fromiter((known[p] for p in count), np.uint32, len(count)))
        self.freq.append(np.fromiter(count.values(), np.uint32, len(count)))
        self.total += size + 64

    def rows(self, number: int, n_buckets: int) -> pa.RecordBatch:
        words = list(self.known)
        at = np.fromiter((zlib.crc32(w.encode()) % n_buckets for w in words), np.int32, len(words))
        index = np.concatenate([np.zeros(0, np.uint32), *self.index])
        freq = np.concatenate([np.zeros(0, np.uint32), *self.freq])
        order = np.lexsort((index, np.repeat(np.arange(len(self.sizes)), self.sizes)))
        index, freq = index[order], freq[order]
        head = np.array([len(words), len(index)], np.uint32)
        out = [{"kind": "docs", "chunk": number, "bucket": -1, "data": zlib.compress(head.tobytes() + at.tobytes() + np.diff(index, prepend=np.uint32(0)).tobytes() + freq.tobytes(), 1), "doc_ids": self.ids, "n_bytes": self.n_bytes, "specials": self.specials, "sizes": self.sizes}]
        by = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[by], np.arange(n_buckets + 1))
        for b in range(n_buckets):
            if cuts[b] < cuts[b + 1]:
                out.append({"kind": "pieces", "chunk": number, "bucket": b, "data": packed([words[i] for i in by[cuts[b] : cuts[b + 1]]])})
        return pa.RecordBatch.from_pylist(out, schema=CHUNK)


def chunks(documents: DataFrame, settings: Settings, n_buckets: int) -> DataFrame:
    path = settings.file

    def made(batches):
        cut, chunk, number = Cutter(path), Chunk(), (TaskContext.get().partitionId() << 24)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                chunk.add(doc_id, text.as_py(), cut)
                if chunk.total >= settings.chunk_bytes:
                    yield chunk.rows(number, n_buckets)
                    chunk, number = Chunk(), number + 1
        if chunk.ids:
            yield chunk.rows(number, n_buckets)

    return documents.select(documents["doc_id"], documents["text"]).mapInArrow(mapped(made), CHUNK_DDL)


def piece_counts(pieces: DataFrame, settings: Settings) -> DataFrame:
    """(chunk, bucket, counts): the pieces of each of the chunk's pre-tokens, every distinct one counted once."""
    path = settings.file

    def counted(table: pa.Table) -> pa.Table:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer, known, lists = Tokenizer.from_file(path), {}, []
        for data in table.column("data"):
            words = unpacked(data.as_py())
            lists.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        words = list(known)
        counts = np.zeros(len(words), np.uint32)
        for a in range(0, len(words), 4096):
            some = tokenizer.encode_batch_fast([w.decode() for w in words[a : a + 4096]], add_special_tokens=False)
            counts[a : a + 4096] = [len(e) for e in some]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "counts": pa.array([counts[x].tobytes() for x in lists], pa.binary())})

    return pieces.select("chunk", "bucket", "data").groupBy("bucket").applyInArrow(grouped(counted), "chunk long, bucket int, counts binary")


def summed(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every document of every chunk."""

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        data = zlib.decompress(row["data"])
        n_words, n_index = np.frombuffer(data, np.uint32, 2).tolist()
        at = np.frombuffer(data, np.int32, n_words, 8)
        index = np.cumsum(np.frombuffer(data, np.uint32, n_index, 8 + 4 * n_words), dtype=np.uint32)
        freq = np.frombuffer(data, np.uint32, n_index, 8 + 4 * n_words + 4 * n_index)
        each = np.zeros(n_words, np.int64)
        by = np.argsort(at, kind="stable")
        sorted_at = at[by]
        for bucket, counts_ in zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist(), strict=True):
            got = np.frombuffer(counts_, np.uint32)
            lo = int(np.searchsorted(sorted_at, bucket))
            each[by[lo : lo + len(got)]] = got
        sums = np.concatenate(([0], np.cumsum(each[index] * freq.astype(np.int64))))
        ends = np.concatenate(([0], np.cumsum(np.array(row["sizes"], dtype=np.int64))))
        tokens = sums[ends[1:]] - sums[ends[:-1]] + np.array(row["specials"], dtype=np.int64)
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_bytes": pa.array(row["n_bytes"], pa.int64()), "n_tokens": pa.array(tokens, pa.int64())})

    return docs.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(total, "doc_id long, n_bytes long, n_tokens long")


def token_counts(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""
    spark = documents.sparkSession
    small_batches(spark)
    # distinct pre-tokens of the chunks take about a third of the bytes of their texts
    kept = written(chunks(documents, settings, buckets(spark, text_bytes(documents) // 3)), "token-chunks")
    counts = piece_counts(kept.where("kind = 'pieces'"), settings)
    docs = kept.where("kind = 'docs'").select("chunk", "data", "doc_ids", "n_bytes", "specials", "sizes")
    return summed(docs, counts).withColumn("over_limit", F.col("n_tokens") > settings.limit)
