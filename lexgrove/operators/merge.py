"""Keyed merges, de-duplication, retention. Results are new DataFrames.

First/last-wins choices are grouped aggregates (``min_by``/``max_by`` with an
explicit order), which combine on the map side; a key with very many copies is
reduced before the shuffle and never gathered.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.records import stored
from lexgrove.functions.text import blank_to_null


def _order(columns: list[str]) -> Column:
    return F.struct(*columns)


def _one_per_key(df, keys: list[str], order: list[str], choose, columns) -> DataFrame:
    columns = columns or df.columns
    rest = [c for c in columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct().select(*columns)
    picked = df.groupBy(*keys).agg(choose(F.struct(*rest), _order(order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*columns)


def first_by(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None
) -> DataFrame:
    """First row per key; ``order`` must be unique per key. ``columns`` limits the result."""
    return _one_per_key(df, keys, order, F.min_by, columns)


def last_by(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None
) -> DataFrame:
    """Last row per key; ``order`` must be unique per key. ``columns`` limits the result."""
    return _one_per_key(df, keys, order, F.max_by, columns)


def dedupe_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per non-blank key; rows without a key are all kept.

    Rows without a key are told apart by the order columns, so one pass over the
    table does both.
    """
    keyed = F.coalesce(blank_to_null(F.col(key)).isNotNull(), F.lit(False))
    marked = df.withColumn("_alone", F.when(~keyed, _order(order)))
    return first_by(marked, [key, "_alone"], order, [*df.columns, "_alone"]).drop("_alone")


def _paired(target: DataFrame, source: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Full outer join with both sides as structs ``t`` and ``s``."""
    rest = [c for c in target.columns if c not in keys]
    t = target.select(*keys, F.struct(*rest).alias("t"))
    s = source.select(*keys, F.struct(*rest).alias("s"))
    return t.join(s, keys, "full_outer"), rest


def merge_overwrite(
    target: DataFrame, source: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """Upsert: a source row replaces the whole target row; the latest source row wins."""
    latest = last_by(source, keys, order, target.columns)
    pairs, _ = _paired(target, latest, keys)
    return pairs.select(*keys, F.coalesce("s", "t").alias("r")).select(*keys, "r.*").select(
        *target.columns
    )


def latest_values(source: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key and column, the latest non-null value."""
    rest = [c for c in source.columns if c not in keys]
    return source.groupBy(*keys).agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), _order(order))).alias(c)
            for c in rest
        ]
    )


def merge_coalesce(
    target: DataFrame, source: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """Upsert in which only non-null source values overwrite."""
    latest = latest_values(source, keys, order).select(*target.columns)
    pairs, rest = _paired(target, latest, keys)
    return pairs.select(
        *keys, *[F.coalesce(F.col("s")[c], F.col("t")[c]).alias(c) for c in rest]
    ).select(*target.columns)


def bridge(df: DataFrame, key: str, items: str, item: str) -> DataFrame:
    """Distinct ``(key, item)`` links of an array column."""
    return df.select(key, F.explode(items).alias(item)).distinct()


def extend_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-if-absent; existing links stay."""
    return links.unionByName(new).distinct()


def dimension(links: DataFrame, item: str) -> DataFrame:
    """Distinct items of a bridge: get-or-create of the dimension rows."""
    return links.select(item).distinct()


def classes_of(links: DataFrame, key: str, item: str) -> DataFrame:
    """Sorted item list per key; bounded by the number of distinct items."""
    return links.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias(item + "s"))


def unexpired(df: DataFrame, expires: str, now: Column) -> DataFrame:
    """Retention: rows whose time is not yet over; rows without a time stay."""
    return df.where(F.col(expires).isNull() | (F.col(expires) >= now))


def expired_count(df: DataFrame, expires: str, now: Column) -> DataFrame:
    return df.agg(F.count_if(F.col(expires) < now).alias("removed"))


def not_yet_done(
    work: DataFrame, done: DataFrame, key: str, by_prefix: int | None = None
) -> DataFrame:
    """Work items that are not done; with ``by_prefix`` also none of their prefixes is."""
    left = work.join(done.select(key), key, "left_anti")
    if by_prefix is None:
        return left
    covered = (
        left.select(
            key,
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.least(F.length(key) - 1, F.lit(by_prefix))),
                    lambda n: F.substring(F.col(key), F.lit(1), n),
                )
            ).alias("_prefix"),
        )
        .where(F.length(key) > 1)
        .join(done.select(F.col(key).alias("_prefix")), "_prefix", "left_semi")
    )
    return left.join(covered.select(key), key, "left_anti")


def cascade_delete(
    parents: DataFrame, children: DataFrame, gone: DataFrame, key: str
) -> tuple[DataFrame, DataFrame]:
    """Remove parents named in ``gone`` and all their children."""
    return tuple(df.join(gone.select(key), key, "left_anti") for df in (parents, children))


TRADEMARK_FIELDS = [
    "brand_name", "brand_name_lower", "st13", "registration_number", "application_number",
    "status", "status_date", "ip_office", "feature", "ipr_type", "country_of_filing",
    "registration_date", "application_date", "expiry_date", "owner_name", "owner_country",
    "crawled_at",
]


def valid_records(records: DataFrame, order: str) -> DataFrame:
    """Ingest form of raw records: named and keyed ones, blanks as null."""
    present = [c for c in TRADEMARK_FIELDS if c in records.columns]
    tidy = records.select(
        order,
        *[stored(F.col(c)).alias(c) for c in present if c != "brand_name_lower"],
    )
    missing = [c for c in TRADEMARK_FIELDS if c not in tidy.columns]
    tidy = tidy.withColumns({c: F.lit(None).cast("string") for c in missing})
    return (
        tidy.withColumn("brand_name_lower", F.lower("brand_name"))
        .where(F.col("brand_name").isNotNull())
        .where(F.coalesce("st13", "registration_number").isNotNull())
        .select(order, *TRADEMARK_FIELDS)
    )


def trademark_upsert(
    target: DataFrame, records: DataFrame, order: str
) -> tuple[DataFrame, DataFrame]:
    """Merge trademark records; returns ``(merged, ambiguous registration numbers)``.

    Records with an st13 replace the row with the same st13. Records without one
    update the non-null fields of a row with the same registration number. If
    several rows carry that number, the one with the lowest st13 is updated and
    the number is reported.
    """
    records = valid_records(records, order)
    with_st13 = F.col("st13").isNotNull()
    keyed = merge_overwrite(target.where(with_st13), records.where(with_st13), ["st13"], [order])
    base = keyed.select(*TRADEMARK_FIELDS).unionByName(
        target.where(~with_st13).select(*TRADEMARK_FIELDS)
    )
    number = "registration_number"
    loose = latest_values(records.where(~with_st13), [number], [order])
    owners = base.where(F.col(number).isNotNull()).groupBy(number).agg(
        F.min(F.struct(F.col("st13").isNull().alias("last"), "st13")).alias("_owner"),
        F.count(F.lit(1)).alias("_owners"),
    )
    owns = F.col("_owner").isNotNull() & F.col("st13").eqNullSafe(F.col("_owner.st13"))
    marked = base.join(owners, number, "left").withColumn("_owns", owns)
    rest = [c for c in TRADEMARK_FIELDS if c not in (number, "st13")]
    patches = loose.select(number, F.lit(True).alias("_owns"), F.struct(*rest).alias("_patch"))
    # one join updates the owning rows and adds the numbers nobody carries; rows without a
    # number have no partner and stay out of it, where they would all be one key
    numbered = F.col(number).isNotNull()
    merged = marked.where(numbered).join(patches.where(numbered), [number, "_owns"], "full_outer").select(
        *[
            F.col(c) if c in (number, "st13") else F.coalesce(F.col("_patch")[c], F.col(c)).alias(c)
            for c in TRADEMARK_FIELDS
        ]
    )
    alone = loose.where(~numbered).withColumn("st13", F.lit(None).cast(base.schema["st13"].dataType))
    for rows in (base.where(~numbered), alone):
        merged = merged.unionByName(rows.select(*TRADEMARK_FIELDS))
    ambiguous = owners.where(F.col("_owners") > 1).join(loose, number, "left_semi")
    return merged, ambiguous.select(number, F.col("_owners").alias("rows"))
