"""Languages of words and documents by a linear-chain conditional random field.

The field labels the words of each line with a language, so text that switches between
languages is labelled word by word. Features of a word are the word itself, its beginnings
and ends, the letter sequences inside it, and the language a lexicon gives it; transitions
are learned from the lines of the training rows and from lines joined across languages.
Forward-backward gives each word its marginals. A document's language is the one with the
highest sum of marginals over all its words, and its score is that sum's share.

Feature hashes are over UTF-8 bytes, A-Z taken as a-z. Words repeat, so features are looked
up once per distinct word of a piece of a batch.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reqlens.llm import bytewords as bw
from reqlens.llm import chain as ch
from reqlens.llm.common import draw_rate, place_of, row_key

PARTS, HELD_OUT = 3, 1  # rows with crc32(doc_id) mod 3 = 1 are never learned from
UNKNOWN = "und"


@dataclass(frozen=True)
class LangId:
    # The labelled sample, shared evenly among languages: the bound of what is collected. A
    # text longer than an eighth of a language's bytes isn't in it.
    rows: int = 2000
    bytes: int = 1_000_000
    prefixes: tuple = (1, 2, 3)
    suffixes: tuple = (1, 2, 3, 4)
    grams: tuple = (2, 3)
    least: int = 3                 # words that a feature stands in
    lexicon_least: int = 4         # times that a word of the lexicon stands in its language
    lexicon_share: float = 0.9     # of its frequency over all languages
    joined_every: int = 10         # of so many lines one is joined with one of another language
    rounds: int = 30


@dataclass
class Model:
    langs: list[str]
    chain: ch.Chain
    lexicon: np.ndarray         # sorted hashes of words
    lexicon_langs: np.ndarray   # their languages


def held_out(column: str = "doc_id"):
    remainder = F.crc32(F.col(column).cast("string").cast("binary")) % PARTS
    return F.coalesce(remainder == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, opts: LangId = LangId()) -> list[tuple[str, str]]:
    """(text, lang) of the bounded sample: the rows of least hashes of each language.
    Held-out rows, and rows without id, lang or text, are left out; copies of a row count once."""
    every = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    every = every.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    keyed = every.withColumn("_key", row_key()).withColumn("_h", F.xxhash64("doc_id", "_key"))
    counts = {r["lang"]: r["count"] for r in every.groupBy("lang").count().collect()}
    if not counts:
        return []
    rows, size = max(1, opts.rows // len(counts)), max(1, opts.bytes // len(counts))
    rates = docs.sparkSession.createDataFrame([(k, draw_rate(rows, n)) for k, n in counts.items()], "lang string, _rate double")
    drawn = keyed.select("doc_id", "lang", "_key", "_h", F.octet_length("text").alias("_bytes")).join(F.broadcast(rates), "lang")
    drawn = drawn.filter((place_of("_h") < F.col("_rate")) & (F.col("_bytes") <= size // 8)).drop("_rate").distinct()
    order = Window.partitionBy("lang").orderBy(place_of("_h"), "_h", "doc_id")
    drawn = drawn.withColumn("_n", F.row_number().over(order)).withColumn("_sum", F.sum("_bytes").over(order))
    chosen = drawn.filter((F.col("_n") <= rows) & (F.col("_sum") <= size)).select(
        F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), F.col("lang").alias("_lang"))
    got = keyed.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_k"))
                     & (F.col("lang") == F.col("_lang")))  # bounded above
    got = got.groupBy("_h", "doc_id", "lang").agg(F.min("text").alias("text"))
    return [(r["text"], r["lang"]) for r in sorted(got.collect(), key=lambda r: (r["_h"], str(r["doc_id"]), r["lang"]))]


@dataclass
class _Words:
    """Words of a piece of text by distinct word: features are flat (word, hash) pairs."""
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    line: np.ndarray      # number of each word's line
    which: np.ndarray     # each word's distinct word
    hashes: np.ndarray    # of the distinct words
    word: np.ndarray
    feature: np.ndarray


def _words(texts: bw.Texts, opts: LangId) -> _Words:
    starts, ends, text = texts.words(bw.LETTER)
    of = texts.hasher()
    hashes, first, which = np.unique(of(starts, ends), return_index=True, return_inverse=True)
    a, b = starts[first], ends[first]
    n = len(hashes)
    words, features = [np.arange(n)], [hashes]
    for tag, sizes in ((1, opts.prefixes), (2, opts.suffixes)):
        for k in sizes:
            long = np.flatnonzero(b - a >= k)
            h = of(a[long], a[long] + k) if tag == 1 else of(b[long] - k, b[long])
            words.append(long)
            features.append(bw.mix64(h + np.uint64(16 * k + tag)))
    for k in opts.grams:
        counts = np.maximum(0, b - a - k + 1)
        at = np.repeat(a - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum()) if n else a
        words.append(np.repeat(np.arange(n), counts))
        features.append(bw.mix64(of(at, at + k) + np.uint64(16 * k + 3)))
    physical = np.cumsum(texts.data == 10)[starts] if len(starts) else starts
    new = np.ones(len(starts), bool)
    new[1:] = (text[1:] != text[:-1]) | (physical[1:] != physical[:-1])
    return _Words(starts, ends, text, np.cumsum(new) - 1, which.reshape(-1), hashes, np.concatenate(words), np.concatenate(features))


def _listed(words: _Words, lexicon: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lexicon features of the distinct words: (word, hash)."""
    place = np.searchsorted(lexicon, words.hashes)
    place[place == len(lexicon)] = 0
    found = np.flatnonzero(lexicon[place] == words.hashes) if len(lexicon) else np.zeros(0, int)
    return found, bw.mix64(langs[place[found]].astype(np.uint64) * np.uint64(16) + np.uint64(4))


def _unary(chain: ch.Chain, n: int, word: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Scores of the labels of each distinct word: the sums of its features' weights."""
    out = np.zeros((n, chain.weights.shape[1]))
    if not len(chain.features):
        return out
    place = np.searchsorted(chain.features, feature)
    place[place == len(chain.features)] = 0
    found = np.flatnonzero(chain.features[place] == feature)
    for y in range(out.shape[1]):
        out[:, y] = np.bincount(word[found], chain.weights[place[found], y], n)
    return out


def _empty(langs: list[str]) -> Model:
    n = len(langs)
    none = np.zeros(0, np.uint64)
    return Model(langs, ch.Chain(none, np.zeros((0, n)), np.zeros((n, n)), np.zeros(n)), none, np.zeros(0, np.int64))


def _lexicon(words: _Words, lang: np.ndarray, n_langs: int, opts: LangId) -> tuple[np.ndarray, np.ndarray]:
    counts = np.zeros((len(words.hashes), n_langs))
    np.add.at(counts, (words.which, lang), 1)
    share = counts / np.maximum(1, counts.sum(axis=0))
    best = share.argmax(axis=1)
    at = np.arange(len(best))
    take = (counts[at, best] >= opts.lexicon_least) & (share[at, best] >= opts.lexicon_share * share.sum(axis=1))
    return words.hashes[take], best[take]


def _sequences(line: np.ndarray, lang: np.ndarray, opts: LangId) -> tuple[np.ndarray, np.ndarray]:
    """Items in training order, and bounds of the sequences: lines, some of them joined
    with the next chosen line of another language."""
    n = int(line[-1]) + 1
    bounds = np.searchsorted(line, np.arange(n + 1))
    of = lang[bounds[:-1]]
    waiting: dict[int, list[int]] = {}
    groups: list[list[int]] = []
    for i in range(n):
        if i % opts.joined_every:
            groups.append([i])
            continue
        partner = next((y for y in waiting if y != of[i] and waiting[y]), None)
        if partner is None:
            waiting.setdefault(int(of[i]), []).append(i)
        else:
            j = waiting[partner].pop()
            groups.append([j, i] if i // opts.joined_every % 2 else [i, j])
    groups += [[i] for rest in waiting.values() for i in rest]
    order = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for g in groups for i in g])
    return order, np.append(0, np.cumsum([sum(bounds[i + 1] - bounds[i] for i in g) for g in groups]))


def train(rows: list[tuple[str, str]], opts: LangId = LangId()) -> Model:
    """The model of (text, lang) rows. Without a word to learn from, it knows the languages only."""
    langs = sorted({y for _, y in rows})
    column = pa.array([t for t, _ in rows], pa.string())
    if not rows or not column.buffers()[2]:
        return _empty(langs)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[:len(rows) + 1].astype(np.int64)
    words = _words(bw.Texts(np.frombuffer(column.buffers()[2], np.uint8)[:offsets[-1]], offsets, 0), opts)
    if not len(words.starts):
        return _empty(langs)
    lang = np.array([langs.index(y) for _, y in rows])[words.text]
    lexicon, lexicon_langs = _lexicon(words, lang, len(langs), opts)
    more_words, more = _listed(words, lexicon, lexicon_langs)
    word, feature = np.append(words.word, more_words), np.append(words.feature, more)
    seen = np.bincount(words.which, minlength=len(words.hashes))
    every, place = np.unique(feature, return_inverse=True)
    common = np.bincount(place.reshape(-1), seen[word]) >= opts.least
    use = common[place.reshape(-1)]
    every, place, word = every[common], (np.cumsum(common) - 1)[place.reshape(-1)][use], word[use]

    order, bounds = _sequences(words.line, lang, opts)
    which, lang = words.which[order], lang[order]
    k, n = len(langs), len(order)
    truth = np.zeros((n, k))
    truth[np.arange(n), lang] = 1
    heads = bounds[:-1]
    inner = np.ones(n, bool)
    inner[heads] = False
    here = np.flatnonzero(inner)
    steps = np.zeros((k, k))
    np.add.at(steps, (lang[here - 1], lang[here]), 1)
    chain = ch.Chain(every, np.zeros((len(every), k)), np.zeros((k, k)), np.zeros(k))
    sums = [np.full_like(x, 1e-8) for x in (chain.weights, chain.transitions, chain.start)]
    for _ in range(opts.rounds):  # Adagrad over all items, as in chain.fit
        table = np.stack([np.bincount(word, chain.weights[place, y], len(words.hashes)) for y in range(k)], axis=1)
        p, pairs, _z = ch.marginals(chain, table[which], bounds)
        gap = truth - p
        by_word = np.stack([np.bincount(which, gap[:, y], len(words.hashes)) for y in range(k)], axis=1)
        grads = [np.stack([np.bincount(place, by_word[word, y], len(every)) for y in range(k)], axis=1),
                 steps - pairs, gap[heads].sum(axis=0)]
        for x, g, s in zip((chain.weights, chain.transitions, chain.start), grads, sums):
            g = g / n - 1e-3 / n * x
            s += g * g
            x += 0.2 * g / np.sqrt(s)
    return Model(langs, chain, lexicon, lexicon_langs)


def label_words(texts: bw.Texts, model: Model, opts: LangId = LangId()) -> tuple[_Words, np.ndarray]:
    """Words, and the marginals of their languages."""
    words = _words(texts, opts)
    if not model.langs:
        return words, np.zeros((len(words.starts), 0))
    more_words, more = _listed(words, model.lexicon, model.lexicon_langs)
    table = _unary(model.chain, len(words.hashes), np.append(words.word, more_words), np.append(words.feature, more))
    lines = int(words.line[-1]) + 1 if len(words.line) else 0
    return words, ch.marginals(model.chain, table[words.which], np.searchsorted(words.line, np.arange(lines + 1)))[0]


def identify(docs: DataFrame, model: Model, opts: LangId = LangId()) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (0 to 1), n_words, segments
    (lang:start:end of the runs of words of one language, in code points, comma-joined).

    A null text, and one without a letter, is `und` with score 0 and no segment; so is every
    text if no language was learned. Of languages with equal sums the first in code point
    order counts. Repeated rows are each scored. An empty table gives no rows. Only doc_id
    and text are read.
    """
    langs = np.array(model.langs, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in bw.chunks(batch.column("text")):
                part = batch.slice(texts.first, len(texts))
                words, p = label_words(texts, model, opts)
                n = len(texts)
                total = np.stack([np.bincount(words.text, p[:, y], n) for y in range(len(langs))], axis=1) if len(langs) else np.zeros((n, 1))
                best, size = total.argmax(axis=1), total.sum(axis=1)
                known = part.column("letters").to_numpy(zero_copy_only=False) & (size > 0)
                score = np.where(known, np.minimum(1.0, total[np.arange(n), best] / np.where(size > 0, size, 1)), 0.0)
                label = p.argmax(axis=1) if len(langs) else np.zeros(len(words.text), int)
                new = np.ones(len(label), bool)
                new[1:] = (label[1:] != label[:-1]) | (words.text[1:] != words.text[:-1])
                at = np.flatnonzero(new & known[words.text])
                edges = np.append(np.flatnonzero(new), len(label))
                to = edges[np.searchsorted(edges, at, side="right")] - 1 if len(at) else at
                chars = bw.code_points(texts.data)
                base = chars[texts.offsets]
                runs: list[list[str]] = [[] for _ in range(n)]
                for t, y, a, b in zip(words.text[at].tolist(), label[at].tolist(), chars[words.starts[at]].tolist(),
                                      chars[words.ends[to]].tolist()):
                    runs[t].append(f"{langs[y]}:{a - base[t]}:{b - base[t]}")
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([langs[y] if k else UNKNOWN for y, k in zip(best, known)], pa.string()),
                    pa.array(score, pa.float64()), pa.array(np.bincount(words.text, minlength=n), pa.int64()),
                    pa.array([",".join(r) for r in runs], pa.string())],
                    names=["doc_id", "lang_pred", "score", "n_words", "segments"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, n_words long, segments string")
