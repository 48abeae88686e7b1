"""Exact duplicates by progressive refinement.

Rows are grouped by length, then by the hash of a prefix, and only rows whose
group still has a second member have their whole text hashed.  What is shuffled
is never text: lengths, prefix hashes and digests only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.llm.common import fresh, single_spaced
from shopcast.sources import stage

#: Surviving (length, prefix) keys that are sent to every task; about 16 bytes each.
BROADCAST_KEYS = 500_000
#: Groups that are sent to every task, the largest; about 150 bytes each.  Any other holds less than
#: one row in as many.
BROADCAST_GROUPS = 100_000


def _with_groups(survivors: DataFrame, groups: DataFrame) -> DataFrame:
    """Each survivor with its group; the largest groups are sent to the rows, not the rows to them."""
    keys = ["size", "digest"]
    if groups.count() <= BROADCAST_GROUPS:
        return survivors.join(F.broadcast(groups), keys)
    largest = groups.orderBy(F.col("group_size").desc(), *keys).limit(BROADCAST_GROUPS)
    largest = F.broadcast(stage(largest, "dedup-largest"))
    others = survivors.join(largest, keys, "left_anti")
    return survivors.join(largest, keys).unionByName(others.join(groups, keys))


def _refined(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, all_digests: bool):
    """Rows alone in their group, with a digest if all are asked for, and decisions on the others."""
    text = single_spaced(F.col(text_col))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id",
        "text",
        F.length("text").alias("size"),
        F.xxhash64(F.substring("text", 1, prefix_chars)).alias("head"),
    )
    # First pass over the texts: what each row is compared by, a few bytes a row.
    narrow = stage(keyed.drop("text"), "dedup-keys")
    sizes = stage(narrow.groupBy("size").count().where("count > 1").select("size"), "dedup-sizes")
    if sizes.count() <= BROADCAST_KEYS:
        # Few different lengths: a frequent one does not gather its rows in one task.
        sizes = F.broadcast(sizes)
    alive = narrow.join(sizes, "size", "left_semi")
    heads = stage(
        alive.groupBy("size", "head").count().where("count > 1").select("size", "head"), "dedup-heads"
    )
    # Second pass: survivors are hashed whole; where every digest is asked for, the others too.
    digest = F.sha2("text", 256).alias("digest")
    met = heads.withColumn("met", F.lit(True)) if all_digests else heads
    how = "left" if all_digests else "left_semi"
    if heads.count() <= BROADCAST_KEYS:
        # The keys go to the texts.
        passed = keyed.join(F.broadcast(met), ["size", "head"], how).withColumn("digest", digest)
    else:
        # Too many keys to send: the digest, not the text, goes through the join.
        passed = keyed.withColumn("digest", digest).drop("text").join(met, ["size", "head"], how)
    hashed = stage(
        passed.drop("text", "head").withColumn("row", F.monotonically_increasing_id()), "dedup-hashed"
    )
    survivors = hashed.where("met") if all_digests else hashed
    groups = stage(
        survivors.groupBy("size", "digest").agg(
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"),
            F.count("*").alias("group_size"),
        ),
        "dedup-groups",
    )
    decided = _with_groups(survivors, groups).select(
        "id",
        "digest",
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
    )
    if all_digests:
        return hashed.where("met is null"), decided
    return narrow.join(heads, ["size", "head"], "left_anti"), decided


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 256,
    all_digests: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, and digest if ``all_digests``.

    Texts are equal when they are identical after each run of ASCII white space
    is written as one space; a null text counts as empty.  Of equal texts the
    row with the smallest id stays, null ids last; of rows repeated with that
    very id one stays.  An empty table gives an empty result.  Other columns
    are not looked at.  Digests of all rows (SHA-256 of the text so written, in
    hexadecimal) mean that every text is hashed whole, not survivors only.
    """
    alone, decided = _refined(docs, id_col, text_col, prefix_chars, all_digests)
    single = alone.select(
        F.col("id").alias(id_col),
        *(["digest"] if all_digests else []),
        F.col("id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
    )
    decided = decided.withColumnRenamed("id", id_col)
    return single.unionByName(decided if all_digests else decided.drop("digest"))


def drop_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256
) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    Looked up are only the (id, digest) pairs that lose rows.  Rows with the
    same id and equal texts leave one of them.
    """
    _, decided = _refined(docs, id_col, text_col, prefix_chars, False)
    marked = stage(
        decided.groupBy("id", "digest")
        .agg(F.count("*").alias("n"), F.count(F.when(F.col("kept"), 1)).alias("stay"))
        .where("n > stay")
        .select("id", "digest", (F.col("stay") > 0).alias("repeated")),
        "dedup-marks",
    )
    of, met, digest, repeated = fresh(docs, "of", "met", "digest", "repeated")
    marks = marked.toDF(of, digest, repeated)
    ids = marked.select(F.col("id").alias(of), F.lit(True).alias(met)).distinct()
    if marked.count() <= BROADCAST_GROUPS:
        # Few enough pairs to send: no text is moved.
        marks, ids = F.broadcast(marks), F.broadcast(ids)
    # Only texts of rows whose id has lost a row are hashed.
    hashed = docs.join(ids, docs[id_col].eqNullSafe(ids[of]), "left").drop(of)
    hashed = hashed.withColumn(digest, F.when(F.col(met), F.sha2(single_spaced(F.col(text_col)), 256)))
    losing = hashed[id_col].eqNullSafe(marks[of]) & (hashed[digest] == marks[digest])
    kept = hashed.join(marks, losing, "left_anti")
    if not marked.where("repeated").isEmpty():
        again = hashed.join(marks.where(F.col(repeated)), losing, "left_semi")
        kept = kept.unionByName(again.dropDuplicates([id_col, digest]))
    return kept.drop(met, digest)
