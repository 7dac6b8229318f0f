"""Toxic spans by a linear-chain conditional random field, and scores by document.

Labels are given by document, so tokens are labelled from them first: in toxic rows of
the training sample a token is toxic if its word, or its first letters, are far more
frequent in toxic rows than in others. A two-label chain over the words of each line
learns these tags from word and word-beginning features; its forward-backward
marginals, summed and at their highest, give the document's score through a logistic
curve fitted on the same rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.llm import bytewords as bw
from reqlens.llm import chain as ch
from reqlens.llm.common import draw_rate, place_of

HELD_OUT_PARTS = 5  # rows with crc32(doc_id) mod 5 = 0 are never learned from


@dataclass(frozen=True)
class Toxicity:
    # Most training rows that are toxic, and that aren't: the bound of what is collected.
    toxic_rows: int = 1000
    other_rows: int = 3000
    clean_lines: int = 2000  # without a toxic token: this many, or as many as have one, up to twice that
    beginnings: tuple = (4, 5)  # bytes of a word's beginning, as features
    # Log-likelihood ratio (G2) for a word's tokens to be toxic: in all rows, and then in
    # the toxic rows that have no such token yet.
    min_evidence: tuple = (27.0, 15.0)
    min_ratio: float = 20.0     # of its frequency in toxic rows to that in others
    floor: float = 0.2          # least marginal that counts towards the score
    span_at: float = 0.5        # least marginal of an offending token


@dataclass
class Model:
    chain: ch.Chain
    curve: np.ndarray  # intercept, and weights of log(1 + sum) and highest marginal


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % HELD_OUT_PARTS == 0, F.lit(False))


def _tokens(texts: bw.Texts, opts: Toxicity):
    """Starts, ends and texts of words, their feature slots, and bounds of lines."""
    starts, ends, text = texts.words(bw.LETTER)
    of = texts.hasher()
    slots = [of(starts, ends)]
    for n in opts.beginnings:
        h = of(starts, np.minimum(starts + n, ends)) + np.uint64(n)
        slots.append(np.where(ends - starts >= n, h, np.uint64(0)))
    lines = np.cumsum(texts.data == 10)
    line = lines[starts] if len(starts) else starts
    new = np.ones(len(starts), bool)
    new[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1])
    return starts, ends, text, slots, np.append(np.flatnonzero(new), len(starts))


def training_rows(docs: DataFrame, labels: DataFrame, opts: Toxicity) -> list[tuple[str, int]]:
    """(text, toxic) of a bounded sample of rows, of the least hashes of doc_id. Held-out rows, and rows without id, label or text, are left out."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = rows.withColumn("_h", F.xxhash64("doc_id"))
    wanted = {0: opts.other_rows, 1: opts.toxic_rows}
    counts = {r["toxic"]: r["count"] for r in rows.filter(F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}
    part = [rows.filter((F.col("toxic") == y) & (place_of("_h") < draw_rate(n, counts.get(y, 0))))
            .orderBy(place_of("_h"), "_h", "doc_id").limit(n) for y, n in wanted.items()]
    chosen = part[0].unionByName(part[1]).select(F.col("doc_id").alias("_id"), "toxic")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    texts = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # bounded above
    got = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    return [(r["text"], r["toxic"]) for r in got.orderBy("doc_id").collect()]


def _label_tokens(text: np.ndarray, slots: list[np.ndarray], toxic: np.ndarray, opts: Toxicity) -> np.ndarray:
    out = np.zeros(len(text), bool)
    for least in opts.min_evidence:
        explained = np.zeros(len(toxic), bool)
        explained[text[out]] = True
        rows_bad, rows_good = int((toxic * ~explained).sum()), int((1 - toxic).sum())
        if not rows_bad or not rows_good:
            break
        use = ~explained[text]
        more = np.zeros(len(text), bool)
        for hashes in slots:
            # Once for each word and row.
            pairs = bw.mix64(hashes[use] + bw.mix64(text[use].astype(np.uint64)))
            once = np.unique(pairs, return_index=True)[1]
            words, inverse = np.unique(hashes[use][once], return_inverse=True)
            bad = np.bincount(inverse, toxic[text[use][once]], len(words))
            good = np.bincount(inverse, minlength=len(words)) - bad
            ratio = (bad / rows_bad) / ((good + 0.5) / rows_good)
            share = rows_bad / (rows_bad + rows_good)
            evidence = 2 * (bad * np.log(np.maximum(bad, 1) / ((bad + good) * share))
                            + good * np.log(np.maximum(good, 1) / ((bad + good) * (1 - share))))
            mark = words[(evidence >= least) & (ratio >= opts.min_ratio) & (words != 0)]
            more |= np.isin(hashes, mark)
        out |= more & use & (toxic[text] > 0)
    return out


def _document(p: np.ndarray, text: np.ndarray, n: int, floor: float) -> np.ndarray:
    """Per text: 1, log(1 + summed marginal), highest marginal. Marginals below the floor
    aren't summed: the many near-zero ones of a long text are no evidence."""
    out = np.zeros((n, 3))
    out[:, 0] = 1
    out[:, 1] = np.log1p(np.bincount(text, np.where(p >= floor, p, 0.0), n))
    np.maximum.at(out[:, 2], text, p)
    return out


def train(rows: list[tuple[str, int]], opts: Toxicity = Toxicity()) -> Model:
    """A model of the rows; without rows of both labels, one that scores their share."""
    toxic = np.array([y for _, y in rows], np.int64)
    if len(set(toxic.tolist())) < 2:
        empty = ch.Chain(np.zeros(0, np.uint64), np.zeros((0, 2)), np.zeros((2, 2)), np.zeros(2))
        share = 0.99 if toxic.sum() else 0.01
        return Model(empty, np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    column = pa.array([t for t, _ in rows], pa.string())
    text, line, slots, lines = [], [], [], 0
    for texts in bw.chunks(column):
        _, _, t, s, bounds = _tokens(texts, opts)
        text.append(t + texts.first)
        line.append(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) + lines)
        slots.append(s)
        lines += len(bounds) - 1
    text, line = np.concatenate(text), np.concatenate(line)
    slots = [np.concatenate(x) for x in zip(*slots)]
    tags = _label_tokens(text, slots, toxic, opts)
    # All lines with a toxic token, and others spread over the sample.
    has = np.zeros(lines, bool)
    has[line[tags]] = True
    others = np.flatnonzero(~has)
    has[others[::max(1, len(others) // max(opts.clean_lines, int(has.sum())))]] = True
    use = has[line]
    lengths = np.bincount(line[use], minlength=lines)[has]
    chain = ch.fit([s[use] for s in slots], tags[use].astype(np.int64), np.append(0, np.cumsum(lengths)), 2)
    del slots
    parts = []
    for texts in bw.chunks(column):
        _, _, t, s, bounds = _tokens(texts, opts)
        p = ch.marginals(chain, chain.unary(s), bounds)[0][:, 1]
        parts.append(_document(p, t, len(texts), opts.floor))
    x = np.concatenate(parts)
    curve = np.zeros(3)
    for _ in range(50):  # Newton's method with a small penalty
        q = 1 / (1 + np.exp(-x @ curve))
        hess = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3)
        curve = curve + np.linalg.solve(hess, x.T @ (toxic - q) - 0.1 * curve)
    return Model(chain, curve)


def score(docs: DataFrame, model: Model, opts: Toxicity = Toxicity()) -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1), n_spans, spans (start:end of
    offending words in code points, comma-joined). A null or empty text has no words
    and gets the score of a text without any toxic word. Repeated rows get the same score
    each, texts that tie too; an empty table gives an empty one; other columns are ignored,
    whatever their names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in bw.chunks(batch.column("text")):
                starts, ends, text, slots, bounds = _tokens(texts, opts)
                p = ch.marginals(model.chain, model.chain.unary(slots), bounds)[0][:, 1]
                value = 1 / (1 + np.exp(-_document(p, text, len(texts), opts.floor) @ model.curve))
                at = np.flatnonzero(p >= opts.span_at)
                chars = bw.code_points(texts.data)
                spans: list[list[str]] = [[] for _ in range(len(texts))]
                for t, a, b in zip(text[at].tolist(), starts[at].tolist(), ends[at].tolist()):
                    base = chars[texts.offsets[t]]
                    spans[t].append(f"{chars[a] - base}:{chars[b] - base}")
                yield pa.RecordBatch.from_arrays([
                    batch.slice(texts.first, len(texts)).column("doc_id"), pa.array(value, pa.float64()),
                    pa.array([len(s) for s in spans], pa.int64()),
                    pa.array([",".join(s) for s in spans], pa.string())],
                    names=["doc_id", "score", "n_spans", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double, n_spans long, spans string")
