"""Token ids in training order, as binary shards of fixed stride.

All texts, each closed by an end token, form one stream of tokens in the order of the
input's splits, cut into sequences of `length` tokens. A keyed Feistel permutation with
cycle-walking gives every sequence a global slot; shard s holds slots s * per_shard and
on, in order, each as one record of `stride` bytes (little-endian 16-bit ids and a line
feed). A reader can start at any slot: its shard and its place there are divisions.

The tokens are never shuffled twice nor kept: a first pass counts each split's tokens,
a second makes the pieces of sequences with their slots, and one shuffle brings each
shard's pieces together. A split that counts differently in the second pass fails the
job instead of writing overlapping sequences.
"""
from __future__ import annotations

import base64
import re
import uuid
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reqlens.llm import bytewords as bw
from reqlens.llm.common import stored
from reqlens.session import checkpoint_root

#: The file's ids are below 50,256, which is free for the end of a text;
#: and the pattern that its texts are split by.
END = 50_256
AHEAD = r"|\s+(?!\S)"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+" + AHEAD + r"|\s+"


@dataclass(frozen=True)
class TokenShards:
    ranks_file: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    length: int = 512        # tokens of a sequence
    per_shard: int = 32_768  # sequences of a shard
    key: int = 20_240_607    # of the permutation
    rounds: int = 6

    @property
    def stride(self) -> int:
        return 2 * self.length + 1


def permute(x: np.ndarray, n: int, opts: TokenShards, inverse: bool = False) -> np.ndarray:
    """The slots of sequence numbers below n (or back): a Feistel network on the least
    even number of bits that holds n, walked on until it falls below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = bw.mix64(np.arange(1, opts.rounds + 1, dtype=np.uint64) + np.uint64(opts.key * 1_000_003 % (1 << 63)))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for key in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (bw.mix64(left + key) & mask), left
            else:
                left, right = right, left ^ (bw.mix64(right + key) & mask)
        return (left << shift) | right
    out = np.asarray(x).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = once(out[todo])
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@lru_cache(maxsize=2)
def encoder(ranks_file: str) -> Callable[[str], list[int]]:
    """A text's ids, its end not included. Kept by a worker for its next tasks.

    The pattern's look-ahead matters only where white space follows white space; without
    it the library splits texts faster.
    """
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    exact, plain = (tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
                    for pattern in (PATTERN, PATTERN.replace(AHEAD, "")))
    doubled = re.compile(r"\s\s").search
    return lambda text: (exact if doubled(text) else plain).encode_ordinary(text)


def _split_counts(docs: DataFrame, opts: TokenShards) -> DataFrame:
    """(split, tokens): a row for each split of docs that has rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(opts.ranks_file)
        split, total = None, 0
        for batch in batches:
            for text in batch.column("text"):
                total += len(encode(text.as_py() or "")) + 1
            if len(batch):
                split = batch.column("split")[0].as_py()
        if split is not None:
            yield pa.RecordBatch.from_arrays([pa.array([split], pa.int32()), pa.array([total], pa.int64())],
                                             names=["split", "tokens"])
    return docs.mapInArrow(run, "split int, tokens long")


def _pieces(docs: DataFrame, n: int, opts: TokenShards) -> DataFrame:
    """(shard, slot, at, ids): the tokens of each sequence that stand in one split."""
    length = opts.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(opts.ranks_file)
        at, end = None, 0
        kept: list[np.ndarray] = []
        held = 0

        def cut(final: bool) -> pa.RecordBatch | None:
            """Pieces of all held tokens up to the last sequence's end (or all, at last)."""
            nonlocal at, kept, held
            ids = np.concatenate(kept) if kept else np.zeros(0, np.uint16)
            use = len(ids) if final else (at + len(ids)) // length * length - at
            if use <= 0:
                kept = [ids]
                return None
            first, last = at // length, (at + use - 1) // length
            numbers = np.arange(first, last + 1)
            starts = np.maximum(numbers * length, at) - at
            ends = np.minimum((numbers + 1) * length, at + use) - at
            slots = permute(numbers, n, opts)
            raw = ids[:use].tobytes()
            out = pa.RecordBatch.from_arrays([
                pa.array((slots // opts.per_shard).astype(np.int32)), pa.array(slots),
                pa.array(((at + starts) % length).astype(np.int32)),
                pa.array([raw[2 * a:2 * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())],
                names=["shard", "slot", "at", "ids"])
            kept, at, held = [ids[use:]], at + use, len(ids) - use
            return out

        for batch in batches:
            if at is None and len(batch):
                at, end = batch.column("base")[0].as_py(), batch.column("end")[0].as_py()
            for text in batch.column("text"):
                ids = encode(text.as_py() or "")
                ids.append(END)
                kept.append(np.frombuffer(array("H", ids), np.uint16))
                held += len(ids)
                if held >= 1 << 20:
                    out = cut(False)
                    if out is not None:
                        yield out
        if at is not None:
            out = cut(True)
            if out is not None:
                yield out
            if at != end:
                raise RuntimeError(f"a split ended at token {at}, not {end}: the input changed between passes")
    return docs.mapInArrow(run, "shard int, slot long, at int, ids binary")


def _records(pieces: DataFrame, opts: TokenShards) -> DataFrame:
    """Sorted pieces to one record a sequence; the stream's last one is filled up with
    end tokens."""
    size = 2 * opts.length
    fill = np.full(opts.length, END, np.uint16).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, parts = None, []
        for batch in batches:
            out = []
            for s, ids in zip(batch.column("slot").to_pylist(), batch.column("ids").to_pylist()):
                if s != slot:
                    if slot is not None:
                        out.append((b"".join(parts) + fill)[:size])
                    slot, parts = s, []
                parts.append(ids)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
        if slot is not None:
            yield pa.RecordBatch.from_arrays([pa.array([(b"".join(parts) + fill)[:size]], pa.binary())],
                                             names=["record"])
    return pieces.select("slot", "ids").mapInArrow(run, "record binary")


def write_shards(docs: DataFrame, path: str, opts: TokenShards = TokenShards()) -> int:
    """Writes the shards of docs' texts to path; returns the number of sequences.

    A null text is an empty one, and has its end token only; repeated rows are written
    as often as they stand. An empty table writes no record.
    """
    rows = docs.select(F.spark_partition_id().alias("split"), F.col("text").cast("string").alias("text"))
    counts = stored(_split_counts(rows, opts), "token-splits")
    total = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    n = -(-total // opts.length)
    if not n:
        docs.sparkSession.createDataFrame([], "record string").write.text(path)
        return 0
    end = F.sum("tokens").over(W.orderBy("split"))  # a row per input split
    bases = counts.withColumn("end", end).select(
        F.col("split").alias("_split"), (F.col("end") - F.col("tokens")).alias("base"), "end")
    placed = rows.join(F.broadcast(bases), F.col("split") == F.col("_split")).select("base", "end", "text")
    pieces = _pieces(placed, n, opts).repartitionById(-(-n // opts.per_shard), F.col("shard"))
    records = _records(pieces.sortWithinPartitions("slot", "at"), opts)
    # The text writer puts a string's bytes down as they are, and a line feed.
    records.select(F.col("record").cast("string")).write.text(path)
    return n


def read_slots(spark: SparkSession, path: str, opts: TokenShards = TokenShards(), start: int = 0,
               stop: int | None = None) -> DataFrame:
    """The sequences of slots start to stop: slot, shard, offset (of its record in the
    shard, in bytes), ids (binary). Only shards with such slots are opened."""
    shards = "*" if stop is None else "{" + ",".join(
        f"{s:05d}" for s in range(start // opts.per_shard, -(-stop // opts.per_shard))) + "}"
    files = spark.read.format("binaryFile").load(f"{path}/part-{shards}-*")
    shard = F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("long")
    files = files.select(shard.alias("shard"), "content", F.floor(F.col("length") / opts.stride).alias("n"))
    rows = files.filter("n > 0").select("shard", "content", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    out = rows.select((F.col("shard") * opts.per_shard + F.col("k")).alias("slot"), "shard",
                      (F.col("k") * opts.stride).alias("offset"),
                      F.substring("content", (F.col("k") * opts.stride + 1).cast("int"), F.lit(2 * opts.length)).alias("ids"))
    out = out.filter(F.col("slot") >= start)
    return out if stop is None else out.filter(F.col("slot") < stop)


def token_shards(docs: DataFrame, opts: TokenShards = TokenShards()) -> DataFrame:
    """Writes docs' shards to the shared folder and returns what they hold: slot, shard,
    offset, n_tokens, crc of each record, as read back."""
    spark = docs.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/llm/shards-{uuid.uuid4().hex}"
    if not write_shards(docs, path, opts):
        return spark.createDataFrame([], "slot long, shard long, offset long, n_tokens int, crc long")
    return read_slots(spark, path, opts).select(
        "slot", "shard", "offset", (F.octet_length("ids") / 2).cast("int").alias("n_tokens"),
        F.crc32("ids").alias("crc"))
