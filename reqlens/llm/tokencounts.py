"""Token counts of a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton lists the vocabulary's pieces at every place of a word, and
dynamic programming carries the best score and its number of pieces. Ties: of equally
good ways to reach a place the one whose last piece starts first, that is the longest
last piece, wins. A character that no piece covers costs the least score less 10 and
counts as its UTF-8 bytes.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"  # stands before each word
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class TokenCounts:
    model_file: str = "/opt/tokenizers/piece_bpe_32k.model"
    cached_words: int = 400_000  # per worker; then the cache starts over


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """(piece, log probability) of the file's ordinary pieces. The file ranks its pieces;
    their probabilities follow Zipf's law of the rank."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(p, -math.log(rank + 2.0)) for rank, p in enumerate(pieces)]


class Counter:
    """Pieces of a text: words are independent, so each is worked out once."""

    def __init__(self, pieces: list[tuple[str, float]], cached: int):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}
        self.cached = cached

    def word(self, word: str) -> int:
        n = len(word)
        best = [-math.inf] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        at, single = -1, False

        def close(end: int, single: bool) -> None:
            """After all pieces that end before `end`: its last character alone."""
            if not single:
                score = best[end - 1] + self.unknown
                if score > best[end]:
                    best[end], count[end] = score, count[end - 1] + len(word[end - 1].encode())
        done = 0
        for last, (length, score) in self.automaton.iter(word):
            if last != at:
                if at >= 0:
                    close(at + 1, single)
                    done = at + 1
                for end in range(done + 1, last + 1):
                    close(end, False)
                at, single, done = last, False, last
            start = last + 1 - length
            single = single or length == 1
            total = best[start] + score
            if total > best[last + 1]:
                best[last + 1], count[last + 1] = total, count[start] + 1
        if at >= 0:
            close(at + 1, single)
            done = at + 1
        for end in range(done + 1, n + 1):
            close(end, False)
        return count[n]

    def text(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        total, cache = 0, self.cache
        for word in (text[1:] if text[0] == SPACE else text).split(SPACE):
            n = cache.get(word)
            if n is None:
                if len(cache) >= self.cached:
                    cache.clear()
                n = cache[word] = self.word(SPACE + word)
            total += n
        return total


@lru_cache(maxsize=2)
def counter_of(model_file: str, cached: int) -> Counter:
    """Kept by a worker, with its words, for its next tasks."""
    return Counter(vocabulary(model_file), cached)


def count_tokens(docs: DataFrame, opts: TokenCounts = TokenCounts()) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_chars. A null or empty text has none;
    repeated rows get the same counts each; an empty table gives an empty one; other columns
    are ignored, whatever their names. Of ways that tie, the library's rule takes one.
    The vocabulary file must be at its path on every node; it is read once per worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(opts.model_file, opts.cached_words)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([counter.text(t) for t in texts], pa.int64()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["doc_id", "n_tokens", "n_chars"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, n_chars long")
