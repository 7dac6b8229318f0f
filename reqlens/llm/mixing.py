"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in a shuffled order, form one stream of words, cut into
blocks of equal length. Slot t of the mix takes the van der Corput point of t; the
point falls into one source's share of the cumulative weights, and the k-th slot of a
source takes the k-th block of its stream, starting over at its end.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reqlens.llm.common import n_words, packed, row_key, stored, text_of, words_of

WEIGHTS = (5, 2, 1)  # of the sources in code-point order, repeating
BITS = 52            # of a point: what a double holds exactly


@dataclass(frozen=True)
class Mix:
    max_passes: int = 3        # how often a document may be taken
    block_words: int = 4096    # longest block
    slots_per_source: int = 256  # fewest slots of a source, so that its share comes near
    chunk_slots: int = 65_536  # slots ranked together
    bucket_rows: int = 2_000  # documents of a source ordered together
    seed: str = "mix"


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per source: source, source_size, weight, target (words).

    Sources share the words of all in proportion to their weights; no target exceeds
    max_passes times its source. The level at which every share is min(cap, level *
    weight) is found by rounds of sums over the table of sources: each round caps the
    sources above their caps and reshares. The table of sources is the only thing
    ranked in one task; it has a row per source, whatever the number of documents.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    s = stored(s.withColumn("weight", F.element_at(
        weights, (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)), "mix-sources")
    cap, w = F.col("source_size") * mix.max_passes, F.col("weight")
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = 0.0
    while True:
        free = F.lit(level) * w < cap
        row = s.agg(F.sum(F.when(free, w)).alias("w"), F.sum(F.when(~free, cap)).alias("c")).first()
        if not row["w"]:
            break
        new = (total - (row["c"] or 0)) / row["w"]
        if new <= level:
            break
        level = new
    return s.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * w))


def _plan(sources: DataFrame, mix: Mix) -> DataFrame:
    """Per source with words: its block length and count, and its slots [lo, hi) of
    the cumulative schedule as shares of 1, with all slots in `slots`."""
    s = sources.filter((F.col("source_size") > 0) & (F.col("target") > 0))
    per = F.floor(F.col("target") / mix.slots_per_source)
    s = s.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(mix.block_words), per)).cast("long"))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    s = s.withColumn("share", F.col("target") / F.col("block"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumns({"_hi": F.sum("share").over(order), "_all": F.sum("share").over(W.partitionBy())})
    lo = F.coalesce(F.lag("_hi").over(order), F.lit(0.0))
    return s.withColumn("_lo", lo).select(
        "source", "source_size", "target", "block", "blocks", (F.col("_lo") / F.col("_all")).alias("lo"),
        (F.col("_hi") / F.col("_all")).alias("hi"), F.round("_all").cast("long").alias("slots"))


def point(slot: Column) -> Column:
    """Van der Corput: the binary digits of the slot, mirrored behind the point."""
    digits = F.rpad(F.reverse(F.bin(slot)), BITS, "0")
    return F.conv(digits, 2, 10).cast("double") / float(2 ** BITS)


def schedule(sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix, one row per slot: slot, source, rank (of the slot in its source),
    block (of the source's stream). A source stops after max_passes over its stream."""
    spark = sources.sparkSession
    plan = stored(_plan(sources, mix), "mix-plan")
    head = plan.agg(F.max("slots"), F.count(F.lit(1))).first()
    n, count = head[0] or 0, head[1]
    cells = 1 << max(10, count.bit_length())  # of the unit interval: a few sources in each
    cell = lambda x: F.least(F.lit(cells - 1), F.floor(x * cells)).cast("int")
    shares = plan.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    slots = spark.range(n).select(F.col("id").alias("slot"), point(F.col("id")).alias("u"))
    slots = slots.withColumn("cell", cell(F.col("u")))
    inside = slots.join(shares, "cell").filter(
        (F.col("u") >= F.col("lo")) & ((F.col("u") < F.col("hi")) | (F.col("hi") >= 1.0)))
    placed = inside.select("slot", "source", "block", "blocks", F.floor(
        F.col("slot") / mix.chunk_slots).alias("chunk"))
    # The rank of a slot: slots of its source in earlier chunks, and before it in its own.
    per = placed.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = per.select(F.col("source").alias("_source"), F.col("chunk").alias("_chunk"), F.coalesce(
        F.sum("_n").over(W.partitionBy("source").orderBy("chunk").rowsBetween(
            W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = placed.withColumn("_own", own)
    ranked = ranked.join(before, ranked["source"].eqNullSafe(before["_source"])
                         & (ranked["chunk"] == before["_chunk"]))
    ranked = ranked.withColumn("rank", F.col("_before") + F.col("_own"))
    return ranked.filter(F.col("rank") < F.col("blocks") * mix.max_passes).select(
        "slot", "source", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def streams(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """sizes (doc_id, key, source, size) with _order, the document's hash, and _from,
    its first word's place in its source's shuffled stream.

    Places are running sums inside buckets of the hash plus the sums of the buckets
    before: a source with a third of all rows is spread over many tasks.
    """
    text = F.concat_ws(":", F.lit(mix.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
                       F.col("size").cast("string"))
    rows = sizes.withColumn("_order", F.md5(text.cast("binary")))
    count = rows.count()
    digits = 1
    while count > mix.bucket_rows * 16 ** digits:
        digits += 1
    rows = rows.withColumn("_bucket", F.substring("_order", 1, digits))
    per = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = per.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(
        F.sum("_sum").over(W.partitionBy("source").orderBy("_bucket").rowsBetween(
            W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = W.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "key")
    rows = rows.withColumns({"_own": F.sum("size").over(own.rowsBetween(W.unboundedPreceding, 0)),
                             "_nth": F.row_number().over(own)})
    rows = rows.join(before, rows["source"].eqNullSafe(before["_s"])
                     & (rows["_bucket"] == before["_b"]))
    return rows.withColumn("_from", F.col("_before") + F.col("_own") - F.col("size")).drop(
        "_own", "_before", "_s", "_b")


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per row of docs: doc_id, key, source, size, source_size, target, taken,
    and passes (how often the mix takes the whole document; taken - passes * size more
    words are its first ones).

    A null text has size 0 and takes nothing; null is a source of its own, the last;
    repeated rows are documents of their own; an empty table gives an empty one.
    """
    sizes = stored(docs.select(
        "doc_id", row_key().alias("key"), F.col("source").cast("string").alias("source"),
        n_words(text_of()).alias("size")), "mix-sizes")
    sources = stored(targets(sizes, mix), "mix-targets")
    plan = _plan(sources, mix).select(F.col("source").alias("_source"), "block", "blocks")
    uses = stored(schedule(sources, mix).groupBy("source", "block").agg(
        F.count(F.lit(1)).alias("uses")), "mix-uses")
    rows = streams(sizes, mix)
    known = sources.select(F.col("source").alias("_src"), "source_size", "target")
    rows = rows.join(known, rows["source"].eqNullSafe(known["_src"])).drop("_src")
    rows = stored(rows.join(plan, rows["source"].eqNullSafe(plan["_source"]), "left").drop("_source"),
                  "mix-streams")
    # A document's pieces: its overlap with each block that it reaches into.
    last = F.greatest(F.col("_from"), F.col("_from") + F.col("size") - 1)
    pieces = rows.filter(F.col("size") > 0).withColumn("_at", F.explode(F.sequence(
        F.floor(F.col("_from") / F.col("block")), F.floor(last / F.col("block")))))
    words = (F.least(F.col("_from") + F.col("size"), (F.col("_at") + 1) * F.col("block"))
             - F.greatest(F.col("_from"), F.col("_at") * F.col("block")))
    pieces = pieces.select("source", "_bucket", "_nth", "_at", words.alias("_words"))
    used = uses.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "uses")
    taken = pieces.join(used, pieces["source"].eqNullSafe(used["_s"]) & (pieces["_at"] == used["_b"]), "left")
    taken = taken.groupBy("source", "_bucket", "_nth").agg(
        F.sum(F.col("_words") * F.coalesce("uses", F.lit(0))).alias("taken"),
        F.min(F.coalesce("uses", F.lit(0))).alias("passes"))
    taken = taken.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"),
                         F.col("_nth").alias("_k"), "taken", "passes")
    out = rows.join(taken, rows["source"].eqNullSafe(taken["_s"]) & (rows["_bucket"] == taken["_b"])
                    & (rows["_nth"] == taken["_k"]), "left")
    return out.select("doc_id", "key", "source", "size", "source_size", "target",
                      F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                      F.coalesce("passes", F.lit(0)).cast("long").alias("passes"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """docs as the mix takes them: a document once for each whole pass, and, where a
    source's last pass ends inside it, its first words once more. Columns stay as they
    are; n_chars, where there is one, follows the text."""
    takes = mix_documents(docs, mix).filter(F.col("taken") > 0).select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_k"), F.col("source").alias("_s"), F.array_repeat(
            F.lit(-1).cast("long"), F.col("passes").cast("int")).alias("_whole"),
        (F.col("taken") - F.col("passes") * F.col("size")).alias("_part"))
    takes = takes.groupBy("_id", "_k", "_s").agg(F.flatten(F.collect_list(F.concat(
        "_whole", F.when(F.col("_part") > 0, F.array("_part")).otherwise(
            F.array().cast("array<bigint>"))))).alias("_takes"))
    # Repeated rows share one line of takes, so only one of them carries it.
    d = packed(docs).withColumn("source", F.col("row.source").cast("string"))
    d = d.dropDuplicates(["doc_id", "key", "source"])
    out = d.join(takes, d["doc_id"].eqNullSafe(takes["_id"]) & (d["key"] == takes["_k"])
                 & d["source"].eqNullSafe(takes["_s"])).select("row", F.explode("_takes").alias("take"))
    text = F.when(F.col("take") < 0, F.col("row.text")).otherwise(F.array_join(F.slice(
        words_of(F.col("row.text")), F.lit(1), F.greatest(F.lit(1), F.col("take").cast("int"))), " "))
    out = out.withColumn("row", F.col("row").withField("text", text))
    if "n_chars" in docs.columns:
        out = out.withColumn("row", F.col("row").withField(
            "n_chars", F.length("row.text").cast(docs.schema["n_chars"].dataType)))
    return out.select("row.*")
