"""Line dedup by winnowing over line hashes.

A line is a physical line, wrapped at ends of sentences so that a passage inside a
paragraph is seen. Hashed are shingles: from each line on, the fewest lines with half of
`min_words`. Of the shingles inside each window of `min_words` words the least hash is a
fingerprint, so every run of so many words holds one, and equal runs hold equal ones.

Only fingerprints are posted, and only those that stand more than once go on. Windows that
hold one of these are keyed by all their lines and joined with the first place of the same
key, so a line that also stands elsewhere can't mislead. A match is extended both ways over
the lines that are equal in both documents; the later run is deleted, the first never is.

Nothing is missed: a run of at least `min_words` words that stood before has each of its
lines in a window inside it (the fewest lines from the line on, or up to it), each window is
such a run itself, and so holds a fingerprint that stands more than once.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.llm import bytewords as bw
from reqlens.llm.common import packed, row_key, stored

_END = np.zeros(256, bool)
_END[list(b".!?")] = True


@dataclass(frozen=True)
class LineDedup:
    min_words: int = 30  # of a run that is deleted


def winnow(hashes: np.ndarray, doc: np.ndarray, window: int | np.ndarray) -> np.ndarray:
    """Places of the window minima, the last of equal ones. A window is so many places from
    each on; a document with fewer is one window. Or an array: the size from each place on,
    0 where no window starts."""
    n = len(hashes)
    if isinstance(window, int):
        last = np.searchsorted(doc, doc, side="right")  # end of the document
        first = np.searchsorted(doc, doc, side="left")
        full = (np.arange(n) + window <= last) | (np.arange(n) == first)
        window = np.where(full, np.minimum(window, last - np.arange(n)), 0)
    best = np.arange(n)
    for j in range(1, int(window.max(initial=0))):
        at = np.flatnonzero(window > j)
        take = at[hashes[at + j] <= hashes[best[at]]]
        best[take] = take + j
    return np.unique(best[window > 0])


def _run_hashes(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the lines a to b of each run."""
    size = b - a
    out = size.astype(np.uint64)
    for j in range(int(size.max(initial=0))):
        long = np.flatnonzero(size > j)
        out[long] += hashes[a[long] + j] * (bw.mix64(np.array([j + 1], np.uint64)) | np.uint64(1))
    return bw.mix64(out)


def _ends(words: np.ndarray, least: int) -> np.ndarray:
    """End of the fewest lines from each line on with `least` words; beyond the last line if
    there are too few. Ends may lie in a later document."""
    sums = np.append(0, np.cumsum(words, dtype=np.int64))
    return np.searchsorted(sums, sums[:-1] + least)


def fingerprints(hashes: np.ndarray, words: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines whose shingle is the least of some window of `least` words, and its hash."""
    n = len(hashes)
    short, end = _ends(words, max(1, least // 2)), _ends(words, least)
    whole = end <= n
    whole[whole] &= doc[end[whole] - 1] == doc[np.flatnonzero(whole)]
    # Shingles inside the window: their ends grow with their lines.
    size = np.where(whole, np.searchsorted(short, end, side="right") - np.arange(n), 0)
    inside = np.flatnonzero(short <= n)
    shingles = np.zeros(n, np.uint64)
    shingles[inside] = _run_hashes(hashes, inside, short[inside])
    at = winnow(shingles, doc, size)
    return at, shingles[at]


def word_windows(hashes: np.ndarray, words: np.ndarray, doc: np.ndarray, least: int):
    """Hash, first line and end (lines) of the windows, in the order of their lines: per
    line the fewest lines from it on, and the fewest up to it, that have `least` words."""
    n = len(hashes)
    sums = np.append(0, np.cumsum(words, dtype=np.int64))
    at = np.arange(n)
    to = _ends(words, least)  # from each line on
    back = np.searchsorted(sums, sums[1:] - least, side="right") - 1  # up to each line
    a, b = np.append(at, back), np.append(to, at + 1)
    inside = (a >= 0) & (b <= n)
    a, b = a[inside], b[inside]
    inside = doc[a] == doc[b - 1]
    pair = np.unique(a[inside] * (n + 1) + b[inside])
    a, b = pair // (n + 1), pair % (n + 1)
    return _run_hashes(hashes, a, b), a, b


def _lines(texts: bw.Texts):
    """Hash, words, start and end (bytes) and text of each line that has a word."""
    starts, ends, text = texts.words(bw.NOT_SPACE)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, ends, text
    words = texts.hashes(starts, ends, np.arange(256, dtype=np.uint8))
    physical = np.cumsum(texts.data == 10)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (text[1:] != text[:-1]) | (physical[1:] != physical[:-1]) | _END[texts.data[ends[:-1] - 1]]
    at = np.flatnonzero(new)
    to = np.append(at[1:], len(starts))
    places = bw.mix64(np.arange(1, len(starts) + 1, dtype=np.uint64)) | np.uint64(1)
    rank = np.arange(len(starts)) - np.repeat(at, to - at)
    sums = np.append(np.uint64(0), np.cumsum(words * places[rank], dtype=np.uint64))
    return bw.mix64(sums[to] - sums[at]), to - at, starts[at], ends[to - 1], text[at]


def lines(docs: DataFrame, opts: LineDedup) -> DataFrame:
    """One row per row of docs: doc_id, key, hashes, words, start and end (code points) of its
    lines, and prints and at: hash and line of its fingerprints."""
    least = max(1, opts.min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in bw.chunks(batch.column("text")):
                hashes, words, start, end, doc = _lines(texts)
                chars = bw.code_points(texts.data)
                base = chars[texts.offsets[doc]]
                counts = np.bincount(doc, minlength=len(texts))
                first = np.append(0, np.cumsum(counts))
                at, prints = fingerprints(hashes, words, doc, least)
                held = np.bincount(doc[at], minlength=len(texts))
                part = batch.slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("key"),
                    bw.list_array(hashes.view(np.int64), counts, pa.int64()),
                    bw.list_array(words.astype(np.int32), counts, pa.int32()),
                    bw.list_array((chars[start] - base).astype(np.int32), counts, pa.int32()),
                    bw.list_array((chars[end] - base).astype(np.int32), counts, pa.int32()),
                    bw.list_array(prints.view(np.int64), held, pa.int64()),
                    bw.list_array((at - first[doc[at]]).astype(np.int32), held, pa.int32()),
                ], names=["doc_id", "key", "hashes", "words", "start", "end", "prints", "at"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key().alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, key long, hashes array<long>, words array<int>, start array<int>, end array<int>, "
             "prints array<long>, at array<int>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of a list column's rows, and its values."""
    return column.offsets.to_numpy() - column.offsets[0].as_py(), column.flatten().to_numpy()


def _pairs_array(rows: list[list[tuple[int, int]]], first: str, second: str) -> pa.Array:
    """A list column of structs of two ints."""
    counts = np.array([len(r) for r in rows], np.int64)
    flat = np.array([p for r in rows for p in r], np.int32).reshape(-1, 2)
    values = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], [first, second])
    offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _windows(bodies: DataFrame, opts: LineDedup) -> DataFrame:
    """Of documents with the lines (at) of their repeated fingerprints: a row for each window
    that holds one, with its print, first line a and end b."""
    least = max(1, opts.min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (offsets, hashes), (_, words) = _flat(batch.column("hashes")), _flat(batch.column("words"))
            held, marks = _flat(batch.column("at"))
            doc = np.repeat(np.arange(len(batch)), np.diff(offsets))
            marks = np.unique(marks + np.repeat(offsets[:-1], np.diff(held)))
            prints, a, b = word_windows(hashes.view(np.uint64), words, doc, least)
            # The next repeated shingle from the window's start on, and its end.
            short = np.append(_ends(words, max(1, least // 2))[marks], len(words) + 1)
            keep = short[np.searchsorted(marks, a)] <= b
            prints, a, b = prints[keep], a[keep], b[keep]
            of = doc[a]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(of)), batch.column("key").take(pa.array(of)),
                pa.array(prints.view(np.int64)), pa.array((a - offsets[of]).astype(np.int32)),
                pa.array((b - offsets[of]).astype(np.int32))], names=["doc_id", "key", "print", "a", "b"])
    kind = bodies.schema["doc_id"].dataType.simpleString()
    return bodies.select("doc_id", "key", "hashes", "words", "at").mapInArrow(
        run, f"doc_id {kind}, key long, print long, a int, b int")


def _equal(x: np.ndarray, y: np.ndarray) -> int:
    """How many first items of x and y are equal."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n:
        apart = np.flatnonzero(x[at:min(n, at + step)] != y[at:min(n, at + step)])
        if len(apart):
            return at + int(apart[0])
        at, step = at + step, 2 * step
    return n


def extended(mine: np.ndarray, theirs: np.ndarray, seeds: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of lines of mine around seeds (a, b: lines of mine, at: the match's first line in
    theirs), extended both ways while lines are equal. What is covered isn't extended again."""
    out, end = [], 0
    for a, b, at in sorted(seeds):
        if b <= end:
            continue
        left = _equal(mine[max(0, min(end, a)):a][::-1], theirs[:at][::-1])
        right = _equal(mine[b:], theirs[at + b - a:])
        out.append((a - left, b + right))
        end = b + right
    return out


def _extended(pairs: DataFrame) -> DataFrame:
    """(doc_id, key, mine, theirs, seeds) to (doc_id, key, cuts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (m, mine), (t, theirs) = _flat(batch.column("mine")), _flat(batch.column("theirs"))
            seeds = batch.column("seeds").to_pylist()
            cuts = [extended(mine[m[i]:m[i + 1]], theirs[t[i]:t[i + 1]], [(s["a"], s["b"], s["at"]) for s in seeds[i]])
                    for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), _pairs_array(cuts, "a", "b")],
                                             names=["doc_id", "key", "cuts"])
    kind = pairs.schema["doc_id"].dataType.simpleString()
    return pairs.select("doc_id", "key", "mine", "theirs", "seeds").mapInArrow(
        run, f"doc_id {kind}, key long, cuts array<struct<a:int,b:int>>")


def _deleted(rows: DataFrame) -> DataFrame:
    """(doc_id, key, cuts, words, start, end) to the deleted spans, in code points, and their sizes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, words = _flat(batch.column("words"))
            start, end = (batch.column(c).flatten().to_numpy() for c in ("start", "end"))
            n = batch.column("cuts").offsets.to_numpy()
            pairs = batch.column("cuts").flatten()
            base = np.repeat(at[:-1], np.diff(n))
            covered = (np.bincount(pairs.field("a").to_numpy() + base, minlength=len(words) + 1)
                       - np.bincount(pairs.field("b").to_numpy() + base, minlength=len(words) + 1))
            inside = np.cumsum(covered) > 0
            sums = np.append(0, np.cumsum(words))
            spans, n_lines, n_words = [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                edges = np.flatnonzero(np.diff(inside[a:b].astype(np.int8), prepend=0, append=0)) + a
                runs = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
                spans.append([(start[x], end[y - 1]) for x, y in runs])
                n_lines.append(sum(y - x for x, y in runs))
                n_words.append(int(sum(sums[y] - sums[x] for x, y in runs)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), _pairs_array(spans, "start", "end"),
                 pa.array(n_lines, pa.int64()), pa.array(n_words, pa.int64())],
                names=["doc_id", "key", "deleted", "deleted_lines", "deleted_words"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "key", "cuts", "words", "start", "end").mapInArrow(
        run, f"doc_id {kind}, key long, deleted array<struct<start:int,end:int>>, deleted_lines long, deleted_words long")


def _with(left: DataFrame, right: DataFrame, how: str = "inner", on: tuple[str, str] = ("doc_id", "key")) -> DataFrame:
    """left joined with right (doc_id, key, ...) on its columns of the names in `on`; ids may be null."""
    right = right.withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    match = left[on[0]].eqNullSafe(right["_id"]) & (left[on[1]] == right["_key"])
    return left.join(right, match, how).drop("_id", "_key")


def repeated_runs(docs: DataFrame, opts: LineDedup = LineDedup()) -> DataFrame:
    """One row per row of docs: doc_id, key, n_lines, deleted (spans in code points),
    deleted_lines, deleted_words.

    Documents are ordered by doc_id (nulls last), then by their text's hash; repeated
    rows are one document. Deleted are all lines of the runs of at least min_words words
    that stood before as a whole, in an earlier document or earlier in the same one; such
    runs may overlap. A null, empty or blank text has no lines. Lines are compared
    word by word, whatever white space stands between. An empty table gives no rows.
    """
    found = stored(lines(docs, opts), "line-hashes")
    # Only hashes at first: most fingerprints stand once, and go no further.
    again = found.select(F.explode("prints").alias("print")).groupBy("print").agg(F.count(F.lit(1)).alias("n"))
    again = stored(again.filter("n > 1").select("print"), "line-repeated")
    posted = found.select("doc_id", "key", F.explode(F.arrays_zip("prints", "at")).alias("p")).select(
        "doc_id", "key", F.col("p.prints").alias("print"), F.col("p.at").alias("at"))
    marked = posted.join(again, "print").groupBy("doc_id", "key").agg(F.collect_set("at").alias("at"))
    # The documents that hold one, each once.
    columns = ["hashes", "words", "start", "end", "at"]
    bodies = _with(found.drop("prints", "at"), marked).groupBy("doc_id", "key").agg(
        F.any_value(F.struct(*columns)).alias("body")).select("doc_id", "key", "body.*")
    bodies = stored(bodies, "line-bodies")

    windows = stored(_windows(bodies, opts), "line-windows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "a", "b")
    first = windows.groupBy("print").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    first = stored(first.filter("n > 1").drop("n"), "line-first")
    matches = windows.join(first, "print").filter(place > F.col("first"))
    pairs = matches.groupBy("doc_id", "key", F.col("first.doc_id").alias("of"), F.col("first.key").alias("of_key")).agg(
        F.collect_list(F.struct("a", "b", F.col("first.a").alias("at"))).alias("seeds"))
    pairs = stored(pairs, "line-matches")
    both = _with(pairs, bodies.select("doc_id", "key", F.col("hashes").alias("mine")))
    both = _with(both, bodies.select("doc_id", "key", F.col("hashes").alias("theirs")), on=("of", "of_key"))
    cuts = stored(_extended(both).groupBy("doc_id", "key").agg(F.flatten(F.collect_list("cuts")).alias("cuts")), "line-cuts")

    cut = _deleted(_with(cuts, bodies)).filter("deleted_lines > 0")
    rows = _with(found.select("doc_id", "key", F.size("words").cast("long").alias("n_lines")), cut, "left")
    zero = F.lit(0).cast("long")
    return rows.select(
        "doc_id", "key", "n_lines", F.coalesce("deleted", F.array().cast(
            "array<struct<start:int,end:int>>")).alias("deleted"),
        F.coalesce("deleted_lines", zero).alias("deleted_lines"),
        F.coalesce("deleted_words", zero).alias("deleted_words"))


def delete_repeats(docs: DataFrame, opts: LineDedup = LineDedup()) -> DataFrame:
    """docs with the repeated runs cut out of text. Other columns stay as they are."""
    cut = repeated_runs(docs, opts).filter("deleted_lines > 0").dropDuplicates(["doc_id", "key"]).select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_k"), "deleted")
    rows = packed(docs)
    out = rows.join(cut, rows["doc_id"].eqNullSafe(cut["_id"]) & (rows["key"] == cut["_k"]), "left")
    text = F.col("row.text")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    rest = F.aggregate("deleted", start, lambda acc, s: F.struct(
        s["end"].alias("at"), F.concat(acc["parts"], F.array(F.substring(
            text, acc["at"] + 1, s["start"] - acc["at"]))).alias("parts")),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(
            text, acc["at"] + 1, F.length(text))))
    return out.withColumn("row", F.col("row").withField(
        "text", F.when(F.col("deleted").isNull(), text).otherwise(rest))).select("row.*")
