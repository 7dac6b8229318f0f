"""Personal data: exact patterns, and a linear-chain conditional random field.

The field tags the words of each line as other, email, ip, card or phone by the shapes
of the word and its neighbours (letters, digits and marks, not their values; a few cue
words count as themselves), and is decoded by Viterbi. It is trained from two labelled
tables: lines with forms that the patterns miss, marked by hand (numbers without +,
dotted cards, name at host dot org, ...) beside look-alikes that are none, and at most
`sample_rows` texts of the corpus whose words the patterns label. What it tags beyond the
patterns' spans is added if the kind allows the form (`allowed`): the form alone doesn't
decide, 030 901 8200 is a phone or an order by the words around it.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.llm import bytewords as bw
from reqlens.llm import chain as ch
from reqlens.llm.common import draw_rate, place_of

# Kinds in the order in which they are listed, and their patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
_COMPILED = {kind: re.compile(p) for kind, p in PATTERNS.items()}
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Words near personal data, or near numbers that are none.
CUES = ("at dot call phone tel telephone mobile cell fax dial ring text sms whatsapp telefon handy anrufen téléphone "
        "teléfono llamar card visa mastercard amex credit debit karte carte tarjeta mail email e-mail contact write "
        "correo courriel ip host server address gateway login from order invoice isbn page pages room date year born "
        "total price version item number ticket serial population").split()

# The labelled table: lines by rule from words before, forms, and words behind. A form's
# digits and letters stand for any others, as only shapes are seen.
_BEFORE = {
    "email": ("mail", "write to", "contact:", "email", "reach me by mail:", "e-mail", "send it to", "or", "ask"),
    "ip": ("server", "host", "ip", "login from", "gateway address", "from", "address:", "ip:"),
    "card": ("card", "visa", "my credit card is", "paid with card", "mastercard:", "card number", "karte", "carte"),
    "phone": ("call", "phone", "tel", "tel:", "my phone number is", "mobile", "fax", "ring me on", "text", "telefon",
              "dial", "call me at", "phone:"),
    "": ("order", "invoice", "isbn", "order number", "pages", "total", "ticket", "serial", "item", "version", "price",
         "population", "in", "the", "of", "date", "on"),
}
_FORMS = {
    "email": ("jane at host dot org", "jane.roe at mail dot host dot org", "jane[at]host[.]org", "jane(at)host(dot)org",
              "jane [at] host [dot] org", "jane (at) host (dot) org", "jr7@host[.]org", "jane_roe at host-x dot com",
              "j.roe[at]host[.]org", "j.roe(at)mail(.)host(.)org", "jane[at]host.org", "jane(at)host.org", "roe at post dot com"),
    "ip": ("10[.]0[.]12[.]7", "192[.]168[.]0[.]1", "10 dot 0 dot 12 dot 7", "192(.)168(.)10(.)12", "172[dot]16[dot]0[dot]9"),
    "card": ("4111.1111.1111.1111", "4111/1111/1111/1111", "4111_1111_1111_1111", "4111 - 1111 - 1111 - 1111"),
    "phone": ("030 901 8200", "(030) 901-8200", "(212) 555-0199", "212-555-0199", "212.555.0199", "0171 2345678",
              "0049 30 901820", "1 (212) 555-0199", "2125550199", "1-212-555-0199", "030/9018200", "555 0199 22"),
    "": ("2021-03-04", "04.03.2021", "2125550199", "212-555-0199", "030 901 8200", "978-3-16-148410-0", "12 345 678",
         "1.000.000", "20210304", "4111", "10.4.2", "555 0199 22", "10 dot 4", "at noon", "at the dot", "1200-1300",
         "0171 2345678", "030/9018200", "4111.1111", "1111_2222_3333", "3.14"),
}
_BEHIND = ("", "today", "please, and then", ". Then the")


def labelled_lines() -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Lines with their marked spans."""
    out = []
    for kind, forms in _FORMS.items():
        for i, form in enumerate(forms):
            for j, before in enumerate(_BEFORE[kind]):
                head = ("and so " if (i + j) % 2 else "") + before + " "
                tail = _BEHIND[(i + j) % len(_BEHIND)]
                line = head + form + (tail if tail.startswith(".") else f" {tail}")
                out.append((line, [(kind, len(head), len(head) + len(form))] if kind else []))
    return out


#: Shapes of bytes: A, a, 0, one for characters beyond ASCII, and marks as they are.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[48:58], SHAPE[128:] = 65, 97, 48, 128
_SAME = np.arange(256, dtype=np.uint8)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


@dataclass(frozen=True)
class Pii:
    sample_rows: int = 1500  # most texts that the patterns label: the bound of what is collected
    other_lines: int = 1000  # lines without personal data to train on, or as many as lines with some


def passes(kind: str, found: str) -> bool:
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        # Lengths first: a part may have any number of digits.
        parts = found.split(".")
        return len(parts) == 4 and all(
            x.isascii() and x.isdigit() and len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in parts)
    if kind == "card":
        if not 16 <= len(digits) <= 19:
            return False
        doubled = [(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[d] for d in digits[-2::-2]]
        return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0
    if kind == "phone":
        return 8 <= len(digits) <= 15
    return "@" in found[1:-1]


_AT = re.compile(r"\x20?[\[({](?:at|@)[\])}]\x20?|\x20at\x20", re.I)
_DOT = re.compile(r"\x20?[\[({](?:dot|\.)[\])}]\x20?|\x20dot\x20", re.I)
_CARD = re.compile(r"[0-9]+(?:(?:[./_]|\x20?-\x20?|\x20)[0-9]+)*")
_PHONE = re.compile(r"\(?[0-9]+(?:[\x20().\-/]{1,2}[0-9]+)*")
_SPELT = re.compile(r"[\[({](?:at|@|dot|\.)[\])}]|\x20at\x20\S+\x20dot\x20|[0-9]\x20dot\x20[0-9]", re.I)


def allowed(kind: str, found: str) -> bool:
    """Whether a run of words can be of the kind: the pattern's check, after spelt marks
    are read as marks, and digit groups with other marks between them."""
    if kind == "email":
        return bool(re.fullmatch(PATTERNS["email"], _DOT.sub(".", _AT.sub("@", found, count=1))))
    if kind == "ip":
        return passes(kind, _DOT.sub(".", found))
    return bool((_CARD if kind == "card" else _PHONE).fullmatch(found)) and passes(kind, found)


def emails(text: str) -> list[tuple[int, int]]:
    """What the pattern finds, looked for from each @ outwards: the pattern itself would
    try every word of the text."""
    out, least, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            least = domain.end()
        at = text.find("@", max(at + 1, least))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind that pass its check."""
    out: dict[str, list[tuple[int, int]]] = {"email": emails(text)}
    for kind in KINDS[1:]:
        out[kind] = [m.span() for m in _COMPILED[kind].finditer(text) if passes(kind, m[0])]
    return out


def _cue_hashes(cues) -> np.ndarray:
    data = [c.encode() for c in cues]
    ends = np.cumsum([len(d) for d in data])
    return np.sort(bw.Texts(np.frombuffer(b"".join(data), np.uint8), np.append(0, ends), 0).hashes(
        np.append(0, ends[:-1]), ends))


_CUE_HASHES, _MARK_HASHES = _cue_hashes(CUES), _cue_hashes(("at", "dot"))
_TRAILING = np.zeros(256, bool)
_TRAILING[list(b":,.;")] = True


def _cues(texts: bw.Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that are cues, but for one mark behind them, and their hashes."""
    short = np.flatnonzero(ends - starts <= 12)
    a, b = starts[short], ends[short]
    b = b - ((b - a > 1) & _TRAILING[texts.data[b - 1]])
    hashes = texts.hashes(a, b)
    place = np.searchsorted(_CUE_HASHES, hashes)
    place[place == len(_CUE_HASHES)] = 0
    found = _CUE_HASHES[place] == hashes
    return short[found], hashes[found]


CUE_REACH = 4  # words between a cue and what it speaks of, at most


def _tokens(texts: bw.Texts):
    """Starts, ends and texts of words, their feature slots, and bounds of lines."""
    starts, ends, text = texts.words(bw.NOT_SPACE)
    full = texts.hashes(starts, ends, SHAPE)
    shape = SHAPE[texts.data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    place = np.append(0, np.cumsum(keep))
    short = bw.Texts(shape[keep], place[texts.offsets], 0)
    brief = short.hashes(place[starts], place[ends], _SAME)
    cue, cue_hash = _cues(texts, starts, ends)
    spoken = brief.copy()
    spoken[cue] = cue_hash
    lines = np.cumsum(texts.data == 10)
    line = lines[starts] if len(starts) else starts
    new = np.ones(len(starts), bool)
    new[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1])
    before, after = np.zeros_like(brief), np.zeros_like(brief)
    before[1:] = np.where(new[1:], np.uint64(0), spoken[:-1] ^ np.uint64(1))
    after[:-1] = np.where(new[1:], np.uint64(0), spoken[1:] ^ np.uint64(2))
    heads = np.flatnonzero(new)
    # The last cue before the word in its line, with the word's own shape. Spelt marks
    # speak of their neighbours only.
    near = np.zeros_like(brief)
    far = ~np.isin(cue_hash, _MARK_HASHES)
    cue, cue_hash = cue[far], cue_hash[far]
    if len(cue):
        at = np.arange(len(starts))
        last = np.searchsorted(cue, at) - 1
        where = cue[np.maximum(last, 0)]
        head = heads[np.searchsorted(heads, at, side="right") - 1]
        near = np.where((last >= 0) & (where >= head) & (at - where <= CUE_REACH),
                        bw.mix64(cue_hash[np.maximum(last, 0)] + spoken), np.uint64(0))
    return (starts, ends, text, [full, spoken ^ np.uint64(3), before, after, near],
            np.append(heads, len(starts)))


def labelled_table(docs: DataFrame, opts: Pii) -> list[str]:
    """At most sample_rows distinct texts of least hashes: half with a digit or @ in
    such places as personal data has, half without. Two scans, and one row per text."""
    rows = docs.select(F.col("text").cast("string").alias("text")).filter("length(text) > 0").select(
        "text", F.col("text").rlike(r"@|\+[0-9]|[0-9]{4}|[0-9]\.[0-9]").alias("some"), F.xxhash64("text").alias("_h"))
    half = opts.sample_rows // 2
    rates = {r["some"]: draw_rate(half, r["count"]) for r in rows.groupBy("some").count().collect()}
    rate = F.when(F.col("some"), rates.get(True, 1.0)).otherwise(rates.get(False, 1.0))
    drawn = rows.filter(place_of("_h") < rate).groupBy("some", "_h").agg(F.min("text").alias("text"))
    drawn = sorted(drawn.collect(), key=lambda r: (r["_h"] % (1 << 32), r["_h"]))
    return [r["text"] for y in (True, False) for r in [r for r in drawn if r["some"] == y][:half]]


def _unsure(row: str) -> list[tuple[int, int]]:
    """Where a kind may stand in a form that no pattern matches: the patterns' silence
    there is no label."""
    out = [m.span() for m in _SPELT.finditer(row)]
    for kind, form in (("card", _CARD), ("phone", _PHONE)):
        out += [m.span() for m in form.finditer(row) if passes(kind, m[0])]
    return out


def train(rows: list[str], opts: Pii = Pii()) -> ch.Chain:
    """The chain of the texts that the patterns label, but for lines where their silence
    is no label, and of the lines marked by hand; without any text, a chain that tags
    nothing."""
    n = len(KINDS) + 1
    if not rows:
        return ch.Chain(np.zeros(0, np.uint64), np.zeros((0, n)), np.zeros((n, n)), -np.arange(n, dtype=float))
    marked = [(row, [(k, *span) for k, spans in base_spans(row).items() for span in spans]) for row in rows]
    marked += labelled_lines()
    texts = next(_all_texts(pa.array([row for row, _ in marked], pa.string())))
    starts, ends, text, slots, bounds = _tokens(texts)
    chars = bw.code_points(texts.data)
    base = chars[texts.offsets]
    labels = np.zeros(len(starts), np.int64)
    unsure = np.zeros(len(starts), bool)
    first = np.searchsorted(text, np.arange(len(marked) + 1))
    for i, (row, spans) in enumerate(marked):
        a, b = first[i], first[i + 1]
        word_from, word_to = chars[starts[a:b]] - base[i], chars[ends[a:b]] - base[i]
        for kind, s, e in spans:
            labels[a:b][(word_from < e) & (word_to > s)] = KINDS.index(kind) + 1
        for s, e in _unsure(row) if i < len(rows) else ():
            unsure[a:b] |= (word_from < e) & (word_to > s) & (labels[a:b] == 0)
    line = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    has = np.zeros(len(bounds) - 1, bool)
    has[line[labels > 0]] = True
    has[line[text >= len(rows)]] = True  # look-alikes too
    silent = np.zeros_like(has)
    silent[line[unsure]] = True
    has &= ~silent
    others = np.flatnonzero(~has & ~silent)
    has[others[::max(1, len(others) // max(opts.other_lines, int(has.sum())))]] = True
    use = has[line]
    return ch.fit([s[use] for s in slots], labels[use], np.append(0, np.cumsum(np.diff(bounds)[has])), n)


def _all_texts(column: pa.Array) -> Iterator[bw.Texts]:
    data = column.buffers()[2]
    yield bw.Texts(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8),
                   np.frombuffer(column.buffers()[1], np.int32)[:len(column) + 1].astype(np.int64), 0)


def _added(text: str, tags: list[tuple[int, int, int]], base: dict) -> list[tuple[str, int, int]]:
    """Runs of equally tagged words of a line, trimmed to the kind's characters, that
    touch no base span and that the kind allows."""
    runs: list[list[int]] = []
    for label, a, b in tags:
        if runs and runs[-1][0] == label and text[runs[-1][2]:a] == " ":
            runs[-1][2] = b
        else:
            runs.append([label, a, b])
    out = []
    for label, a, b in runs:
        kind = KINDS[label - 1]
        while a < b and not (text[a].isalnum() or kind == "phone" and text[a] == "("):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a < b and text[a] == "(" and ")" not in text[a:b]:
            a += 1
        clear = all(e <= a or b <= s for spans in base.values() for s, e in spans)
        if a < b and clear and allowed(kind, text[a:b]):
            out.append((kind, a, b))
    return out


def find_pii(docs: DataFrame, chain: ch.Chain) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone and base (of the
    patterns' spans), spans (all). Spans are kind:start:end by kind, then start, in code
    points, comma-joined. A null or empty text has none; repeated rows get the same spans
    each; an empty table gives an empty one; other columns are ignored, whatever their name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for texts in bw.chunks(column):
                counts, base_out, all_out = [], [], []
                starts, ends, text, slots, bounds = _tokens(texts)
                labels = ch.viterbi(chain, chain.unary(slots), bounds)
                at = np.flatnonzero(labels)
                chars = bw.code_points(texts.data) if len(at) else None
                tags: dict[int, list] = {}
                for i in at.tolist():
                    t = int(text[i])
                    o = chars[texts.offsets[t]]
                    tags.setdefault(t, []).append((int(labels[i]), int(chars[starts[i]] - o), int(chars[ends[i]] - o)))
                # Texts that no pattern can match needn't become strings.
                some = np.zeros(len(texts), bool)
                hot = np.flatnonzero(_DIGIT[texts.data] | (texts.data == 64))
                some[np.searchsorted(texts.offsets, hot, side="right") - 1] = True
                for t in range(len(texts)):
                    base, more = {k: [] for k in KINDS}, []
                    if some[t] or t in tags:
                        row = texts.data[texts.offsets[t]:texts.offsets[t + 1]].tobytes().decode("utf-8", "replace")
                        base = base_spans(row)
                        more = _added(row, tags.get(t, []), base)
                    spans = [(k, a, b) for k in KINDS for a, b in base[k]]
                    counts.append([len(base[k]) for k in KINDS])
                    base_out.append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
                    spans = sorted(set(spans + more), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
                    all_out.append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
                table = np.array(counts, np.int64).reshape(-1, len(KINDS))
                yield pa.RecordBatch.from_arrays(
                    [batch.slice(texts.first, len(texts)).column("doc_id"),
                     *[pa.array(table[:, k], pa.int64()) for k in range(len(KINDS))],
                     pa.array(base_out, pa.string()), pa.array(all_out, pa.string())],
                    names=["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, {counts}, base string, spans string")
