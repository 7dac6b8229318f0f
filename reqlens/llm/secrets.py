"""Secret scans: candidate spans, and who else in the corpus owns the same value.

A value that many owners, or many repositories, hold is a copied example; one that few
hold looks live.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.llm.common import let, prefix_sums, row_key, stored, text_of

# The base kinds, in the order in which they are listed.
ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
          r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# The added kind: long runs with a letter and a digit that no base span touches.
TOKEN = (r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}")
KINDS = ("assign", "access", "hex", "token")
SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint,hash:string>"


def _spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches of which the group has so many characters."""
    none = F.array().cast(f"array<{SPAN}>")

    def of(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.zip_with(found, gaps, lambda m, g: (F.length(m) + F.length(g)).cast("long"))
        # gaps has one more: the text after the last match.
        ends = prefix_sums(F.slice(steps, F.lit(1), F.size(found)))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        spans = F.transform(
            F.arrays_zip(found.alias("m"), ends.alias("e"), values.alias("v")), lambda z: F.struct(
                (z["e"] - F.length(z["m"])).alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
                F.lit(kind).alias("kind"), z["e"].alias("end"),
                F.when(F.length(z["v"]) >= least, F.sha2(z["v"], 256)).alias("hash")))
        return F.when(F.size(found) == 0, none).otherwise(
            F.filter(spans, lambda s: s["hash"].isNotNull()))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of).cast(f"array<{SPAN}>")


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, key, owner, repo, base and added (spans; an added one
    overlaps no base one and has a letter and a digit). hash is the value's SHA-256:
    values themselves go nowhere. A null text counts as an empty one."""
    d = docs.select("doc_id", row_key().alias("key"), F.col(owner).cast("string").alias("owner"),
                    F.col(repository).cast("string").alias("repo"), text_of().alias("_text"))
    t = F.col("_text")
    d = d.withColumns({"_assign": _spans(t, ASSIGN, "assign", 2, 6), "_access": _spans(t, ACCESS, "access"),
                       "_hex": _spans(t, HEX, "hex"), "_token": _spans(t, TOKEN, "token")})
    d = d.withColumn("base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    clear = F.filter("_token", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return d.select("doc_id", "key", "owner", "repo", "base", clear.alias("added"))


def ownership(found: DataFrame) -> DataFrame:
    """Per value: hash, owners, repositories, occurrences over the whole corpus.

    Occurrences are summed per (value, owner, repository) before any shuffle, then per
    (value, owner), so an example key in a third of all documents stays small.
    A missing owner or repository counts as one of its own.
    """
    each = found.select(F.explode(F.concat("base", "added")).alias("s"), "owner", "repo")
    per_repo = each.groupBy(F.col("s.hash").alias("hash"), "owner", "repo").agg(
        F.count(F.lit(1)).alias("n"))
    per_owner = per_repo.groupBy("hash", "owner").agg(
        F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return per_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repositories"),
        F.sum("n").alias("occurrences"))


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id",
                 max_owners: int = 2, max_repositories: int = 10) -> DataFrame:
    """One row per row of docs: doc_id, base (spans), spans (base, and the added ones
    that look live), n_live (spans whose value has at most max_owners owners and
    max_repositories repositories) and n_copied (the others). An example in many
    documents of a single owner is copied, too. Rows without spans have empty lists;
    repeated rows each get the same result and count as further occurrences of one
    repository. Columns other than doc_id, text, owner and repository are not read."""
    found = stored(candidates(docs, owner, repository), "secret-spans")
    freq = stored(ownership(found), "secret-owners").select("hash", "owners", "repositories")
    each = found.filter(F.size("base") + F.size("added") > 0).select(
        "doc_id", "key", F.explode(F.concat("base", "added")).alias("s")
    ).withColumn("hash", F.col("s.hash"))
    judged = each.join(freq, "hash").withColumn(
        "live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))
    judged = judged.groupBy("doc_id", "key").agg(F.collect_set(F.struct("s", "live")).alias("all"))
    judged = judged.select(
        "doc_id", "key", F.size(F.filter("all", lambda x: x["live"])).alias("n_live"),
        F.size(F.filter("all", lambda x: ~x["live"])).alias("n_copied"),
        F.transform(F.filter("all", lambda x: x["live"] | (x["s"]["kind"] != "token")),
                    lambda x: x["s"]).alias("spans"))
    rows = found.alias("f").join(judged.alias("j"), (F.col("f.doc_id").eqNullSafe(F.col("j.doc_id")))
                                 & (F.col("f.key") == F.col("j.key")), "left")
    return rows.select(
        "f.doc_id", "base", F.array_sort(F.coalesce("spans", F.array().cast(f"array<{SPAN}>"))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
