"""Reproducible exact-size samples, splits and hold-outs.

Rows are ordered by a hash of their key.  An exact cut of that order is found
in narrow scans: the row count gives the number of hash buckets, counts per
bucket say which one holds the cut, and only that one is ranked to get the hash
at the cut.  The rows themselves are
then labelled by one comparison with that hash: no shuffle of wide rows, and no
task ever sorts a whole stratum, however large one stratum is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shopcast.functions.hashing import bucket_digits, hash_bucket, hash_order
from shopcast.sources import stage

SEED = 112


def _cut_hashes(
    df: DataFrame,
    strata: Sequence[str],
    order: Column,
    positions: Callable[[Column], list[Column]],
) -> DataFrame:
    """Per stratum the hash of the row at each position, as columns cut_0, cut_1, ...

    ``positions`` maps the stratum size to cumulative row counts.  A position
    of 0 gives null.
    """
    bucket = hash_bucket(order, bucket_digits(df.count()))
    narrow = df.select(*strata, order.alias("h"), bucket.alias("b"))
    counts = narrow.groupBy(*strata, "b").agg(F.count(F.lit(1)).alias("cnt"))
    whole = Window.partitionBy(*strata)
    upto = whole.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = counts.withColumns({"n": F.sum("cnt").over(whole), "upto": F.sum("cnt").over(upto)})
    wanted = [p.cast("bigint").alias(f"position_{i}") for i, p in enumerate(positions(F.col("n")))]
    sized = sized.select("*", *wanted)
    cuts = F.filter(
        F.array(
            *[
                F.struct(F.lit(i).alias("i"), F.col(f"position_{i}").alias("position"))
                for i in range(len(wanted))
            ]
        ),
        lambda c: (c["position"] <= F.col("upto")) & (c["position"] > F.col("upto") - F.col("cnt")),
    )
    hit = sized.select(
        *[F.col(s).alias(f"_{s}") for s in strata],
        F.col("b").alias("_b"),
        F.explode(cuts).alias("cut"),
        (F.col("upto") - F.col("cnt")).alias("before"),
    )
    same = F.col("b") == F.col("_b")
    for s in strata:
        same = same & F.col(s).eqNullSafe(F.col(f"_{s}"))
    ranked = narrow.join(hit, same).withColumn(
        "rank",
        F.row_number().over(Window.partitionBy(*strata, "b", F.col("cut.i")).orderBy("h"))
        + F.col("before"),
    )
    return (
        ranked.where(F.col("rank") == F.col("cut.position"))
        .groupBy(*strata)
        .agg(
            *[
                F.max(F.when(F.col("cut.i") == i, F.col("h"))).alias(f"cut_{i}")
                for i in range(len(wanted))
            ]
        )
    )


def label_segments(
    df: DataFrame,
    key_cols: Sequence[str],
    strata: Sequence[str],
    positions: Callable[[Column], list[Column]],
    seed: int | str,
    label: str = "segment",
    where: Column | None = None,
) -> DataFrame:
    """Add ``label``: how many of the cuts lie before the row, within its stratum.

    ``where`` limits the ranked rows; other rows get a null label.
    """
    order = hash_order(key_cols, seed)
    ranked = df if where is None else df.where(where)
    cuts = _cut_hashes(ranked, strata, order, positions)
    names = [c for c in cuts.columns if c.startswith("cut_")]

    def past(hashes: list[Column]) -> Column:
        total = F.lit(0)
        for h in hashes:
            total = total + F.coalesce((order > h).cast("int"), F.lit(1))
        return total if where is None else F.when(where, total)

    if not strata:
        both = cuts.select(F.struct(*names).alias("cuts")).scalar()
        return df.withColumn(label, past([both[n] for n in names]))
    # One row per stratum, staged so that the planner knows its true size.
    table = stage(
        cuts.select(*[F.col(s).alias(f"_{s}") for s in strata], *names), "stratum-cuts"
    )
    same = F.lit(True)
    for s in strata:
        same = same & F.col(s).eqNullSafe(F.col(f"_{s}"))
    return df.join(table, same, "left").select(
        *df.columns, past([F.col(n) for n in names]).alias(label)
    )


def sample_rows(df: DataFrame, n: int, key_cols: Sequence[str], seed: int | str = 42) -> DataFrame:
    """Exactly ``n`` rows (all when fewer)."""
    part = label_segments(df, key_cols, [], lambda size: [F.least(size, F.lit(n))], seed, "_part")
    return part.where("_part = 0").drop("_part")


def sample_fraction(
    df: DataFrame, fraction: float, key_cols: Sequence[str], seed: int | str = 42
) -> DataFrame:
    """``fraction`` of the rows by hash value: about that share, in one scan."""
    edge = F.lit(int(fraction * 16**8))
    value = F.conv(F.substring(hash_order(key_cols, seed), 1, 8), 16, 10).cast("bigint")
    return df.where(value < edge)


def stratified_sample(
    df: DataFrame, n: int, strata: Sequence[str], key_cols: Sequence[str], seed: int | str = SEED
) -> DataFrame:
    """Per stratum ``round(share * n)`` rows, half-even, at most all of them."""
    total = df.agg(F.count(F.lit(1))).scalar()
    part = label_segments(
        df,
        key_cols,
        strata,
        lambda size: [F.least(size, F.bround(size / total * n).cast("bigint"))],
        seed,
        "_part",
    )
    return part.where("_part = 0").drop("_part")


def resample_by_outcome(
    df: DataFrame,
    outcome_col: str,
    key_cols: Sequence[str],
    negative_per_positive: float = 1.0,
    seed: int | str = SEED,
    strata: Sequence[str] = (),
) -> DataFrame:
    """All positive rows and a fixed ratio of negative rows, by one filter.

    Rows whose outcome is neither 0 nor 1 are left out.  If fewer negatives
    exist than wanted, all of them are kept.
    """
    if outcome_col not in df.columns:
        raise ValueError(f"outcome column not found: {outcome_col}")
    positive, negative = F.col(outcome_col) == 1, F.col(outcome_col) == 0
    totals = df.agg(
        F.struct(
            F.count(F.when(positive, 1)).alias("pos"), F.count(F.when(negative, 1)).alias("neg")
        ).alias("t")
    ).scalar()
    wanted = F.floor(F.lit(negative_per_positive) * totals["pos"])

    def positions(size: Column) -> list[Column]:
        if strata:
            share = F.least(size, F.bround(size / totals["neg"] * wanted).cast("bigint"))
        else:
            share = wanted
        return [F.when(wanted > totals["neg"], size).otherwise(share)]

    part = label_segments(df, key_cols, list(strata), positions, seed, "_part", where=negative)
    return part.where(positive | (F.col("_part") == 0)).drop("_part")


def two_way_split(
    df: DataFrame,
    share: float,
    strata: Sequence[str],
    key_cols: Sequence[str],
    seed: int | str = SEED,
    drop_tiny_strata: bool = False,
) -> DataFrame:
    """Add ``part``: ``first`` for ``round(size * share)`` rows per stratum, else ``second``.

    With ``drop_tiny_strata`` a stratum whose first side is empty is left out.
    """
    labelled = label_segments(
        df,
        key_cols,
        strata,
        lambda size: [F.bround(size * F.lit(share)).cast("bigint")],
        seed,
        "_part",
    )
    part = F.when(F.col("_part") == 0, F.lit("first")).otherwise(F.lit("second"))
    out = labelled.withColumn("part", part).drop("_part")
    if drop_tiny_strata:
        sizes = out.groupBy(*[F.col(s).alias(f"_{s}") for s in strata]).agg(
            F.count(F.when(F.col("part") == "first", 1)).alias("_first")
        )
        same = F.lit(True)
        for s in strata:
            same = same & F.col(s).eqNullSafe(F.col(f"_{s}"))
        kept = sizes.where("_first > 0")
        out = out.join(kept, same, "left_semi")
    return out


def train_valid_test(
    df: DataFrame,
    key_cols: Sequence[str],
    train_size: float = 0.6,
    valid_size: float = 0.2,
    test_size: float = 0.2,
    strata: Sequence[str] = ("treatment_name",),
    seed: int | str = SEED,
) -> DataFrame:
    """Add ``split``: train, valid or test, disjoint and complete per stratum."""
    sizes = (train_size, valid_size, test_size)
    if abs(sum(sizes) - 1.0) >= 1e-6:
        raise ValueError(f"split sizes must sum to 1, got {sum(sizes)}")
    if min(sizes) <= 0:
        raise ValueError("all split sizes must be positive")
    absent = [c for c in strata if c not in df.columns]
    if absent:
        raise ValueError(f"stratify columns not found: {absent}")
    valid_share = valid_size / (valid_size + test_size)

    def positions(size: Column) -> list[Column]:
        train = F.bround(size * F.lit(train_size)).cast("bigint")
        valid = F.bround((size - train) * F.lit(valid_share)).cast("bigint")
        return [train, F.when(valid > 0, train + valid).otherwise(train)]

    labelled = label_segments(df, key_cols, strata, positions, seed, "_part")
    split = (
        F.when(F.col("_part") == 0, F.lit("train"))
        .when(F.col("_part") == 1, F.lit("valid"))
        .otherwise(F.lit("test"))
    )
    return labelled.withColumn("split", split).drop("_part")


def stratum_shares(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Rows per stratum and share of all rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (
        df.groupBy(*strata)
        .agg(F.count(F.lit(1)).alias("cnt"))
        .withColumn("share", F.col("cnt") / total)
    )


def split_check(
    labelled: DataFrame, strata: Sequence[str], split_col: str = "split", tolerance: float = 0.05
) -> DataFrame:
    """Stratum shares of the whole and of each split, marking deviations."""
    per_split = labelled.groupBy(split_col, *strata).agg(F.count(F.lit(1)).alias("cnt"))
    totals = labelled.groupBy(split_col).agg(F.count(F.lit(1)).alias("split_n"))
    shares = (
        per_split.join(totals, split_col)
        .select(
            *[F.col(s).alias(f"_{s}") for s in strata],
            F.col(split_col).alias("_split"),
            (F.col("cnt") / F.col("split_n")).alias("split_share"),
        )
    )
    splits = labelled.agg(F.collect_set(split_col)).scalar()
    whole = stratum_shares(labelled, strata).select(
        *strata, F.col("share").alias("original_share"), F.explode(splits).alias(split_col)
    )
    same = F.col(split_col) == F.col("_split")
    for s in strata:
        same = same & F.col(s).eqNullSafe(F.col(f"_{s}"))
    return (
        whole.join(shares, same, "full")
        .select(
            F.coalesce(split_col, "_split").alias(split_col),
            *[F.coalesce(F.col(s), F.col(f"_{s}")).alias(s) for s in strata],
            F.coalesce("original_share", F.lit(0.0)).alias("original_share"),
            F.coalesce("split_share", F.lit(0.0)).alias("split_share"),
        )
        .withColumn(
            "deviates", F.abs(F.col("original_share") - F.col("split_share")) > F.lit(tolerance)
        )
    )


def hold_out(
    df: DataFrame, n: int, key_cols: Sequence[str], seed: int | str = 42
) -> DataFrame:
    """Add ``role``: ``infer`` for exactly ``n`` rows, ``reference`` for the rest."""
    part = label_segments(df, key_cols, [], lambda size: [F.least(size, F.lit(n))], seed, "_part")
    role = F.when(F.col("_part") == 0, F.lit("infer")).otherwise(F.lit("reference"))
    return part.withColumn("role", role).drop("_part")


def shuffled(df: DataFrame, key_cols: Sequence[str], seed: int | str = SEED) -> DataFrame:
    """Rows in hash order; meaningful only right before a sink."""
    return df.orderBy(hash_order(key_cols, seed))
