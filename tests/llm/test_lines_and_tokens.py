import os
import random

import brute
import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from reqlens.llm import linededup as ld
from reqlens.llm import tokenbinary as tb
from reqlens.llm import tokencounts as tc

TOKENIZERS = "/opt/tokenizers"
needs_files = pytest.mark.skipif(not os.path.exists(TOKENIZERS), reason="no tokenizer files")


# ── line dedup ───────────────────────────────────────────────────────────────

def brute_runs(docs, min_words=30):
    """Of documents in order: deleted spans, if every line were a fingerprint and every
    earlier place were compared. What winnowing finds is part of it."""
    found = [(d, brute.lines(t)) for d, t in docs]
    seen, out = set(), {}
    for d, ls in found:
        covered = []
        for words, _, _ in ls:
            covered.append(words in seen)
            seen.add(words)
        out[d] = {i for i, c in enumerate(covered) if c}
    return found, out


def test_winnow_has_a_print_in_every_window():
    rng = np.random.default_rng(2)
    doc = np.sort(rng.integers(0, 40, 300))
    hashes = rng.integers(0, 50, 300).astype(np.uint64)
    picks = set(ld.winnow(hashes, doc, 3).tolist())
    for d in range(40):
        own = np.flatnonzero(doc == d)
        for i in range(max(1, len(own) - 2) if len(own) else 0):
            window = own[i:i + 3]
            least = [j for j in window if hashes[j] == hashes[window].min()]
            assert least[-1] in picks
    # Equal windows pick equal places, wherever they stand.
    both = ld.winnow(np.tile(hashes[:20], 2), np.repeat([0, 1], 20), 3)
    assert (both[both < 20] + 20).tolist() == both[both >= 20].tolist()


def test_passages_go_and_first_places_stay(spark):
    rng = random.Random(11)
    passage = prose(rng, 80)
    docs = []
    for i in range(30):
        text = prose(rng, 70).rstrip() + ".\n"
        if i % 3 == 0:
            text += passage.rstrip() + ".\n" + prose(rng, 70)
        docs.append((i, text))
    docs += [(40, docs[1][1]), (41, docs[1][1]), (42, "Header line.\n" + docs[2][1]), (43, "Header line.\n" + prose(rng, 50))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in ld.repeated_runs(df).collect()}
    found, covered = brute_runs(docs)
    for d, ls in found:
        spans = [(s["start"], s["end"]) for s in got[d]["deleted"]]
        inside = {i for i, (_, a, b) in enumerate(ls) if any(s <= a and b <= e for s, e in spans)}
        assert inside <= covered[d]                      # only what was there before
        assert got[d]["deleted_lines"] == len(inside) and got[d]["n_lines"] == len(ls)
        assert got[d]["deleted_words"] == sum(len(ls[i][0]) for i in inside)
    for i in range(3, 30, 3):                            # every later passage, as a whole
        assert got[i]["deleted_words"] >= 70
    assert not got[0]["deleted"] and not got[1]["deleted"]
    assert got[40]["deleted_lines"] == got[40]["n_lines"] and got[41]["deleted_lines"] == got[41]["n_lines"]
    assert got[42]["deleted_words"] > 60 and not got[43]["deleted"]
    left = {r["doc_id"]: r["text"] for r in ld.delete_repeats(df).collect()}
    assert left[0] == docs[0][1] and left[40].strip() == ""
    assert sum(passage[:200] in t for t in left.values()) == 1
    assert len(brute.WORD.findall(left[3])) == len(brute.WORD.findall(docs[3][1])) - got[3]["deleted_words"]


def brute_repeats(docs, min_words=30):
    """Of documents in order: the lines of all runs of min_words words and more that
    stood before as a whole, by all pairs of places."""
    seen, out = set(), {}
    for d, t in docs:
        ls = [w for w, _, _ in brute.lines(t)]
        out[d] = set()
        for b in range(1, len(ls) + 1):  # by end, so that runs before this one are known
            for a in range(b):
                run = tuple(ls[a:b])
                if sum(map(len, run)) >= min_words:
                    if run in seen:
                        out[d] |= set(range(a, b))
                    seen.add(run)
    return out


def test_no_repeated_run_stays(spark):
    """Passages of one to five lines, whose middle line also stands alone in an earlier
    document, with ends that join neighbouring text, and runs just under the limit."""
    rng = random.Random(23)
    line = lambda n: " ".join(prose(rng, 1).strip(".\n") for _ in range(n))
    docs, alone, later = [], [], []
    for k in (1, 2, 3, 4, 5):
        for size in (6, 10, 15, 29, 30, 50):
            passage = [line(size) for _ in range(k)]
            alone.append(passage[k // 2])
            for joined in (False, True):
                both = [line(8) + " " * joined + ".\n" * (not joined) + ".\n".join(passage) + " " * joined
                        + ".\n" * (not joined) + line(8) + "." for _ in range(2)]
                later += both
    docs = [line(12) + ".\n" + s + ".\n" + line(12) + "." for s in alone]
    rng.shuffle(later)
    docs += later
    docs.append(docs[-1].replace("\n", " \n ") + "\n" + docs[-2])  # other white space, two passages
    docs.append(("twenty words " * 10 + ".\n") * 4)  # overlaps itself
    rows = list(enumerate(docs))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in ld.repeated_runs(df).collect()}
    want = brute_repeats(rows)
    for d, t in rows:
        ls = brute.lines(t)
        spans = [(s["start"], s["end"]) for s in got[d]["deleted"]]
        inside = {i for i, (_, a, b) in enumerate(ls) if any(s <= a and b <= e for s, e in spans)}
        assert inside == want[d], d
        assert got[d]["deleted_lines"] == len(inside)
        assert got[d]["deleted_words"] == sum(len(ls[i][0]) for i in inside)
    assert sum(map(bool, want.values())) > 40


def test_line_dedup_of_odd_rows(odd_docs, odd_rows, no_docs):
    rows = ld.repeated_runs(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    want = sorted((str(r[0]), len(brute.lines(r[1]))) for r in odd_rows)
    assert sorted((str(r["doc_id"]), r["n_lines"]) for r in rows) == want
    by = {r["doc_id"]: r for r in rows}
    assert by[100]["deleted_lines"] == by[100]["n_lines"] and not by[101]["deleted"]
    assert by[14]["deleted_lines"] == 8  # a line nine times: the first stays
    out = ld.delete_repeats(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == len(odd_rows)
    assert ld.repeated_runs(no_docs).count() == 0


# ── token counts ─────────────────────────────────────────────────────────────

def reference(pieces):
    """The same vocabulary in a public library. Its list starts with the unknown piece
    and the 256 bytes."""
    from tokenizers import Tokenizer, models, pre_tokenizers
    byte = [(f"<0x{i:02X}>", -99.0) for i in range(256)]
    # Byte pieces must not win: they only stand for what no piece covers.
    t = Tokenizer(models.Unigram([("<unk>", -99.0), *byte, *pieces], 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


@needs_files
def test_counts_equal_the_library(odd_docs, odd_rows):
    opts = tc.TokenCounts()
    pieces = tc.vocabulary(opts.model_file)
    library = reference(pieces)
    # The library takes its penalty from its own least score.
    counter = tc.Counter(pieces, 1000)
    counter.unknown = -99.0 - tc.UNKNOWN_PENALTY
    rng = random.Random(4)
    texts = [r[1] for r in odd_rows if r[1]] + [
        "".join(rng.choice("ab eé 汉▁\n\t.ß9\U0001F600") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for text in texts:
        assert counter.text(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text[:80])
    got = {str(r["doc_id"]): r["n_tokens"] for r in tc.count_tokens(odd_docs).collect()}
    plain = tc.Counter(pieces, 10)
    assert got == {str(r[0]): plain.text(r[1] or "") for r in odd_rows}


def test_ties_take_the_longest_last_piece():
    # Both ways to "▁abc" score the same: "▁a" + "bc" has the longer last piece.
    counter = tc.Counter([("▁a", -1.0), ("bc", -2.0), ("▁ab", -1.0), ("c", -2.0), ("▁", -9.0)], 9)
    assert counter.word("▁abc") == 2
    same = tc.Counter([("▁ab", -3.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0)], 9)
    assert same.word("▁ab") == 1  # three pieces score as much, but start later
    assert same.word("▁é") == 3 and same.text("") == 0


# ── token shards ─────────────────────────────────────────────────────────────

def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        slots = tb.permute(np.arange(n), n, tb.TokenShards())
        assert sorted(slots.tolist()) == list(range(n))
        assert tb.permute(slots, n, tb.TokenShards(), inverse=True).tolist() == list(range(n))
    a, b = (tb.permute(np.arange(1000), 1000, tb.TokenShards(key=k)) for k in (1, 2))
    assert (a != b).sum() > 900 and (np.diff(a) == 1).sum() < 20


@needs_files
def test_round_trip(spark, odd_docs, odd_rows, no_docs, tmp_path):
    opts = tb.TokenShards(length=16, per_shard=40)
    path = str(tmp_path / "shards")
    n = tb.write_shards(odd_docs, path, opts)
    rows = sorted(tb.read_slots(spark, path, opts).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(n))
    assert all(r["shard"] == r["slot"] // 40 and r["offset"] == r["slot"] % 40 * opts.stride for r in rows)
    order = tb.permute(np.arange(n), n, opts)
    stream = np.concatenate([np.frombuffer(rows[s]["ids"], "<u2") for s in order])
    encode = tb.encoder(opts.ranks_file)
    texts = sorted(tuple(encode(r[1] or "")) for r in odd_rows)
    parts, own = [], []
    for t in stream.tolist():
        if t == tb.END:
            parts.append(tuple(own))
            own = []
        else:
            own.append(t)
    total = sum(len(t) + 1 for t in texts)
    assert n == -(-total // 16) and sorted(parts[:len(texts)]) == texts and not own
    assert all(p == () for p in parts[len(texts):])
    some = tb.read_slots(spark, path, opts, 35, 90).collect()
    assert sorted(r["slot"] for r in some) == list(range(35, 90))
    assert tb.token_shards(no_docs, opts).count() == 0


@needs_files
def test_encoder_equals_the_library(odd_rows):
    import base64

    import tiktoken
    path = tb.TokenShards().ranks_file
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("x", pat_str=tb.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(13)
    texts = [r[1] or "" for r in odd_rows] + [
        "".join(rng.choice("ab 1\n\t'ts\u00a0\u2003\x1c.é") for _ in range(40)) for _ in range(500)]
    assert all(tb.encoder(path)(t) == library.encode_ordinary(t) for t in texts)
    assert max(max(library.encode_ordinary(t), default=0) for t in texts) < tb.END


@needs_files
def test_split_that_changes_fails(spark):
    opts = tb.TokenShards(length=4)
    rows = spark.createDataFrame([(0, 99, "some text")], "base long, end long, text string")
    with pytest.raises(Exception, match="changed between passes"):
        tb._pieces(rows, 30, opts).count()


def test_fingerprints_are_few_and_in_every_run():
    """Every run of min_words words holds a whole shingle that is posted; fewer than half as
    many are posted as there are windows."""
    rng = np.random.default_rng(31)
    doc = np.sort(rng.integers(0, 30, 3000))
    hashes = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    words = rng.integers(1, 22, 3000)
    at, prints = ld.fingerprints(hashes, words, doc, 30)
    _, a, b = ld.word_windows(hashes, words, doc, 30)
    ends = ld._ends(words, 15)
    for x, y in zip(a, b):
        assert any(x <= s and ends[s] <= y for s in at[np.searchsorted(at, x):np.searchsorted(at, y)])
    assert len(at) < len(a) / 2
    again, same = ld.fingerprints(np.tile(hashes, 2), np.tile(words, 2), np.append(doc, doc + 100), 30)
    assert again.tolist() == [*at, *(at + 3000)] and same.tolist() == [*prints, *prints]


def test_extension_goes_both_ways_and_stops_where_lines_differ():
    theirs = np.array([9, 1, 2, 3, 4, 5, 8])
    mine = np.array([7, 1, 2, 3, 4, 5, 6, 1, 2])
    assert ld.extended(mine, theirs, [(2, 4, 2)]) == [(1, 6)]
    assert ld.extended(mine, theirs, [(2, 4, 2), (3, 5, 3), (7, 9, 1)]) == [(1, 6), (7, 9)]
    same = np.zeros(1000, int)
    assert ld.extended(same, same, [(i, i + 3, 0) for i in range(1, 998)]) == [(1, 1000)]
