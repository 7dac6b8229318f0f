"""MinHash near-dedup by an inverted join over signature coordinates.

Documents are sets of 5-word shingles. Equal sets become one class, and everything
below is between classes. A class has COORDINATES minima, each under its own hash
function; a (coordinate, value) pair that two or more classes hold is a posting list.
Two classes with Jaccard similarity 0.85 agree in 54 of 64 coordinates on average.
matches(percent) is the number in fewer of which a link at the threshold agrees with a
probability below MISSED = 1e-8: 36 at 0.85, 31 at 0.8.

* Skip: pairs held by one class make no posting; a class with fewer than matches
  shared pairs has no partner and is dropped.
* Prefix: two classes that agree in matches coordinates share a pair among the first
  COORDINATES - matches + 1 of each when pairs are ordered by rarity. Only those are
  posted, so that passages that many documents hold fall out of the lists.
* Stars instead of all pairs: every list's members are first compared with one centre,
  the member whose coordinates are the commonest (in a group of edited copies, the
  text closest to all); a pair whose signatures agree in fewer than matches coordinates
  isn't compared. Lists whose members are then in one component are done. The members
  of all others go through the same prefix join once more, over their full sets, for
  links between different components: see cross_pairs. So no link between components is
  lost, and a group of copies costs as many comparisons as it has members.
* Every candidate is confirmed on the full sets.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.llm import bytewords as bw
from reqlens.llm.common import packed, row_key, stored
from reqlens.llm.components import components

COORDINATES, MISSED = 64, 1e-8
_U = np.uint64
_FACTORS = bw.mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | _U(1)
_SHIFTS = bw.mix64(np.arange(1001, 1001 + COORDINATES, dtype=np.uint64))
_PLACES = bw.mix64(np.arange(2001, 2033, dtype=np.uint64)) | _U(1)


@dataclass(frozen=True)
class NearDup:
    shingle: int = 5        # words
    percent: int = 85       # least 100 * intersection / union of a link


def matches(percent: int) -> int:
    """The most coordinates of which a link at the threshold agrees in fewer with a
    probability below MISSED."""
    p, below = percent / 100, 0.0
    for m in range(COORDINATES):
        below += math.comb(COORDINATES, m) * p ** m * (1 - p) ** (COORDINATES - m)
        if below >= MISSED:
            if not m:
                raise ValueError(f"{COORDINATES} coordinates can't find links at {percent} percent")
            return m
    return COORDINATES


def shingle_sets(texts: bw.Texts, width: int) -> list[np.ndarray]:
    """Per text its sorted distinct shingle hashes. A text with fewer words than a
    shingle has one, of all its words; a text without words has none."""
    starts, ends, text = texts.words(bw.NOT_SPACE)
    words = texts.hashes(starts, ends)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    n = len(words) - width + 1
    whole = np.zeros(max(0, n), np.uint64)
    for j in range(width):
        whole += words[j:j + len(whole)] * _PLACES[j]
    whole = bw.mix64(whole)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(whole[a:b - width + 1]))
        elif b > a:
            part = np.append(words[a:b], _U(b - a)) * np.append(_PLACES[:b - a], _PLACES[31])
            out.append(bw.mix64(part.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The top 32 bits of each coordinate's least hash."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 2048):
        block = shingles[at:at + 2048, None] * _FACTORS + _SHIFTS
        np.minimum(least, block.min(axis=0), out=least)
    return (least >> _U(32)).astype(np.int64)


def nibbles(sig: np.ndarray) -> np.ndarray:
    """4 bits of each coordinate, packed into COORDINATES / 16 longs."""
    bits = (sig.astype(np.uint64) & _U(15)).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * _U(4))
    return np.bitwise_or.reduce(bits, axis=1).view(np.int64)


FEATURES = ("doc_id {id}, key long, n_shingles long, class binary, sig array<long>, "
            "bits array<long>")


def features(docs: DataFrame, opts: NearDup) -> DataFrame:
    """One row per row of docs: doc_id, key (of its text), n_shingles, class (128 bits
    of its set; null without words), sig and bits (of its signature)."""
    width = opts.shingle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in bw.chunks(batch.column("text")):
                sets = shingle_sets(texts, width)
                full = [s for s in sets if len(s)]
                sigs = [signature(s) for s in full]
                has = np.array([len(s) > 0 for s in sets], bool)
                flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
                part = batch.slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                             pa.binary()),
                    bw.list_array(flat, has * COORDINATES, pa.int64()),
                    bw.list_array(np.concatenate([nibbles(s) for s in sigs]) if sigs else flat,
                                  has * (COORDINATES // 16), pa.int64()),
                ], names=["doc_id", "key", "n_shingles", "class", "sig", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key().alias("key"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, FEATURES.format(id=kind))


def classes(found: DataFrame) -> DataFrame:
    """Per class: class, least doc_id, one of its rows (row_id, row_key), n_shingles, sig, bits."""
    one = F.min_by(F.struct("doc_id", "key", "n_shingles", "sig", "bits"), F.struct(
        F.col("doc_id").isNull(), "doc_id", "key"))
    rows = found.filter(F.col("class").isNotNull()).groupBy("class").agg(one.alias("one"))
    return rows.select("class", F.col("one.doc_id").alias("row_id"), F.col("one.key").alias("row_key"),
                       "one.n_shingles", "one.sig", "one.bits")


def postings(nodes: DataFrame, opts: NearDup) -> DataFrame:
    """The posted pairs: pair, class, n_shingles, bits, weight (how common the class's
    coordinates are)."""
    least = matches(opts.percent)
    pairs = nodes.select("class", F.posexplode("sig").alias("place", "value")).select(
        "class", (F.col("place").cast("long") * (1 << 32) + F.col("value")).alias("pair"))
    shared = stored(pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"),
                    "minhash-shared")
    held = pairs.join(shared, "pair").groupBy("class").agg(
        F.collect_list(F.struct("held", "pair")).alias("pairs"))  # at most COORDINATES
    held = held.filter(F.size("pairs") >= least)
    # Pairs of no other class come first in the order of rarity, and take up the prefix.
    length = F.size("pairs") - (least - 1)
    held = held.select("class", F.slice(F.array_sort("pairs"), F.lit(1), length).alias("prefix"),
                       F.aggregate("pairs", F.lit(0.0), lambda a, p: a + F.log2(p["held"])).alias("weight"))
    rows = held.join(nodes, "class").select(
        "class", "n_shingles", "bits", "weight", "row_id", "row_key", F.transform(
            "prefix", lambda p: p["pair"]).alias("prefix"))
    return stored(rows, "minhash-postings")


def _agree(a: Column, b: Column) -> Column:
    """Coordinates whose 4 bits agree."""
    def apart(i: int) -> Column:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(
            F.shiftrightunsigned(x, 3))
        return F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))
    out = F.lit(COORDINATES)
    for i in range(COORDINATES // 16):
        out = out - apart(i)
    return out


def _alike(a: DataFrame, b: DataFrame, opts: NearDup) -> Column:
    """Sizes and signatures allow a link."""
    return ((a["n_shingles"] * 100 >= b["n_shingles"] * opts.percent)
            & (b["n_shingles"] * 100 >= a["n_shingles"] * opts.percent)
            & (_agree(a["bits"], b["bits"]) >= matches(opts.percent)))


def confirmed(pairs: DataFrame, texts: DataFrame, opts: NearDup) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. texts: class, text."""
    width, percent = opts.shingle, opts.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, at = [], 0
            right = list(_sets(batch.column("text_b"), width))
            for left, other in zip(_sets(batch.column("text_a"), width), right):
                both = len(np.intersect1d(left, other, assume_unique=True))
                if both * 100 >= percent * (len(left) + len(other) - both):
                    keep.append(at)
                at += 1
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    left = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return stored(both.mapInArrow(run, "a binary, b binary"), "minhash-links")


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for texts in bw.chunks(column):
        yield from shingle_sets(texts, width)


def cross_pairs(unsettled: DataFrame, opts: NearDup) -> DataFrame:
    """(a, b): pairs of different components that may be links. unsettled: class,
    class_component, text.

    The lists again, but of the full sets: shingles that stand in one component only
    can't be shared by such a pair, so they come first in the order of rarity; behind
    them come the others, the rarest first. A link has its first common shingle within
    the prefix of both sets, with enough left behind it. A text with a few changes of its
    own has used up its prefix, however many near relatives it has. In each list the
    members of the largest component aren't paired with each other.
    """
    width, percent = opts.shingle, opts.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in bw.chunks(batch.column("text")):
                sets = shingle_sets(texts, width)
                part = batch.slice(at, len(sets))
                at += len(sets)
                sizes = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column("class"), part.column("class_component"), pa.array(sizes),
                    bw.list_array(np.concatenate(sets).view(np.int64), sizes, pa.int64())],
                    names=["class", "component", "n", "shingles"])

    sets = stored(unsettled.select("class", "class_component", "text").mapInArrow(
        run, "class binary, component binary, n long, shingles array<long>"), "minhash-sets")
    each = sets.select("class", "component", "n", F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("held"), F.min("component").alias("lo"),
                                         F.max("component").alias("hi"))
    shared = stored(shared.filter("lo <> hi").select("shingle", "held"), "minhash-common")
    held = each.join(shared, "shingle").groupBy("class", "component", "n").agg(
        F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("common"))  # at most n
    own = (F.col("n") - F.size("common")).cast("int")
    prefix = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    held = held.withColumn("own", own).filter(prefix > own)
    posts = held.select("class", "component", "n", "own", F.posexplode(F.slice(
        "common", F.lit(1), prefix - F.col("own"))).alias("k", "s"))
    posts = stored(posts.select("class", "component", "n", (F.col("n") - F.col("own") - F.col("k")).alias("left"),
                                F.col("s.shingle").alias("shingle")), "minhash-prefixes")
    most = posts.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("held")).groupBy("shingle").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("component", F.struct("held", "component")).alias("main"))
    most = stored(most.filter("n > 1").select("shingle", "main"), "minhash-main")
    posts = stored(posts.join(most, "shingle").withColumn("rest", F.col("component") != F.col("main")).drop("main"),
                   "minhash-mixed")
    x, y = ({c: F.col(f"{name}.{c}") for c in posts.columns} for name in ("x", "y"))
    enough = F.least(x["left"], y["left"]) * (100 + percent) >= (x["n"] + y["n"]) * percent
    pairs = posts.filter("rest").alias("x").join(posts.alias("y"), (x["shingle"] == y["shingle"]) & enough
                                                 & (x["component"] != y["component"])
                                                 & (~y["rest"] | (x["class"] < y["class"])))
    return pairs.select(x["class"].alias("a"), y["class"].alias("b")).distinct()


def near_duplicates(docs: DataFrame, opts: NearDup = NearDup()) -> DataFrame:
    """One row per row of docs: doc_id, key, n_shingles, component_id, component, kept.

    component is the least class of the row's component, null without words; component_id is the least doc_id reachable over links, the row's own included.
    Rows without words are linked with nothing. A row without doc_id takes part by its
    text; its component_id is the least doc_id of those it reaches, null if none has
    one, and it is kept only then. Repeated rows share their component. An empty table
    gives an empty one.
    """
    found = stored(features(docs, opts), "minhash-features")
    nodes = stored(classes(found), "minhash-classes")
    posted = postings(nodes, opts)
    # Texts of the classes that may have partners, once each.
    keyed = docs.select("doc_id", row_key().alias("key"), F.col("text").cast("string").alias("text"))
    wanted = posted.select("class", "row_id", "row_key")
    texts = keyed.join(wanted, keyed["doc_id"].eqNullSafe(wanted["row_id"])
                       & (keyed["key"] == wanted["row_key"])).select("class", "text")
    texts = stored(texts.dropDuplicates(["class"]), "minhash-texts")

    lists = posted.select("class", "n_shingles", "bits", "weight", F.explode("prefix").alias("pair"))
    centres = stored(lists.groupBy("pair").agg(F.max_by(
        F.struct("class", "n_shingles", "bits"), F.struct("weight", "class")).alias("one")).select(
        "pair", F.col("one.class").alias("centre"), "one.n_shingles", "one.bits"), "minhash-centres")
    near = lists.join(centres, (lists["pair"] == centres["pair"]) & (lists["class"] != centres["centre"])
                      & _alike(lists, centres, opts))
    star = near.select(F.col("class").alias("a"), F.col("centre").alias("b")).distinct()
    links = confirmed(stored(star, "minhash-star"), texts, opts)
    joined = components(links)

    # The rest: members that their list's centre didn't reach, against other components.
    def with_component(df: DataFrame, name: str) -> DataFrame:
        c = joined.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        out = df.join(c, df[name] == c["_n"], "left")
        return out.withColumn(f"{name}_component", F.coalesce("_c", name)).drop("_n", "_c")
    placed = with_component(posted.select("class", "n_shingles", "bits", "prefix"), "class")
    placed = placed.select("class", "n_shingles", "bits", "class_component", F.explode("prefix").alias("pair"))
    middle = with_component(centres.select("pair", "centre"), "centre").select(
        F.col("pair").alias("_pair"), "centre_component")
    placed = placed.join(stored(middle, "minhash-middle"), F.col("pair") == F.col("_pair")).drop("_pair")
    placed = stored(placed.withColumn("rest", F.col("class_component") != F.col("centre_component")),
                    "minhash-placed")
    open_lists = stored(placed.groupBy("pair").agg(F.max("rest").alias("rest")).filter("rest").select("pair"),
                        "minhash-open")
    unsettled = placed.join(open_lists, "pair").select("class", "class_component").distinct()
    cross = stored(cross_pairs(unsettled.join(texts, "class"), opts), "minhash-cross")
    more = confirmed(cross, texts, opts)
    if not more.isEmpty():
        joined = components(links.unionByName(more))

    # Classes to the least doc_id of their component, and rows to their class.
    member = nodes.select("class", "row_id").join(
        joined.withColumnRenamed("node", "class"), "class", "left").select(
        "class", "row_id", F.coalesce("component", "class").alias("component"))
    least = member.groupBy("component").agg(F.min("row_id").alias("component_id"))
    ids = stored(member.join(least, "component").select(F.col("class").alias("_class"), "component", "component_id"),
                 "minhash-ids")
    rows = found.select("doc_id", "key", "n_shingles", "class")
    rows = rows.join(ids, F.col("class") == F.col("_class"), "left")
    rows = rows.withColumn("component_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(
        F.col("component_id")))
    return rows.select("doc_id", "key", "n_shingles", "component_id", "component",
                       F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, opts: NearDup = NearDup()) -> DataFrame:
    """docs with one row of each component. Columns stay as they are. Of rows without
    words, one of each (doc_id, text) stays."""
    kept = near_duplicates(docs, opts).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_k"), "component")
    # A doc_id, or none, that stands on several texts of a component is kept with one of them.
    kept = kept.groupBy("component", "_id", F.when(F.col("component").isNull(), F.col("_k")).alias("_empty")).agg(
        F.min("_k").alias("_k"))
    rows = packed(docs)
    out = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_id"]) & (rows["key"] == kept["_k"]), "left_semi")
    return out.dropDuplicates(["doc_id", "key"]).select("row.*")
