"""Labels, indexes, pairs, lists, splits and negatives for training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tessela.functions.ordering import global_numbers, position_in_group
from tessela.functions.quantiles import exact_quantiles
from tessela.roles import Roles
from tessela.session import materialize

# Label columns in order of preference.
LABEL_NAMES = ("label", "target", "rating", "click")


def pick_label(df: DataFrame) -> str:
    """The first well-known label column, else the last numeric column."""
    for name in LABEL_NAMES:
        if name in df.columns:
            return name
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    if not numeric:
        raise ValueError("no numeric column can serve as a label")
    return numeric[-1]


def with_label(df: DataFrame, column: str | None = None) -> DataFrame:
    return df.withColumn("label", (F.col(column or pick_label(df)) > 0).cast("double"))


def category_index(df: DataFrame, column: str, ts: str) -> DataFrame:
    """(value, index): distinct values numbered from 1 by first appearance, then by value."""
    seen = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(ts).alias("__first"))
    return global_numbers(seen, ["__first", column], "index").select(column, "index")


def index_categories(df: DataFrame, columns: Sequence[str], ts: str) -> DataFrame:
    """Add ``<column>_index`` for every given column; nulls get 0."""
    result = df
    for c in columns:
        mapping = category_index(df, c, ts).withColumnRenamed("index", f"{c}_index")
        result = result.join(mapping, c, "left").withColumn(f"{c}_index", F.coalesce(f"{c}_index", F.lit(0)))
    return result


def dense_vector(columns: Sequence[str]) -> Column:
    """Numeric columns as one float array with null as 0."""
    return F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in columns])


def preference_pairs(df: DataFrame, roles: Roles) -> DataFrame:
    """(user, pair_no, pos_item, neg_item, pos_signal, neg_signal): above the median against the rest, per user.

    The n-th newest positive of a user meets the n-th newest negative; the longer side keeps its surplus out.
    """
    # the rows are needed for the median, the counts and both sides
    df = materialize(df.select(*dict.fromkeys([roles.user, roles.item, roles.signal, roles.ts, *roles.tiebreak])), "preferences")
    median = exact_quantiles(df, F.col(roles.signal), [0.5])[0]
    side = df.withColumn("__positive", F.col(roles.signal) > F.lit(median))
    tiebreak = [roles.item, *[c for c in roles.tiebreak if c != roles.item]]
    placed = position_in_group(side, [roles.user, "__positive"], roles.ts, tiebreak, "pair_no", descending=True)
    keyed = placed.select(roles.user, "pair_no", "__positive", roles.item, roles.signal)
    positive = keyed.where(F.col("__positive")).select(
        roles.user, "pair_no", F.col(roles.item).alias("pos_item"), F.col(roles.signal).alias("pos_signal"))
    negative = keyed.where(~F.col("__positive")).select(
        roles.user, "pair_no", F.col(roles.item).alias("neg_item"), F.col(roles.signal).alias("neg_signal"))
    return positive.join(negative, [roles.user, "pair_no"])


def listwise_groups(df: DataFrame, roles: Roles, list_size: int = 10) -> DataFrame:
    """Blocks of ``list_size`` consecutive rows of a user in time order; an incomplete last block leaves."""
    placed = position_in_group(df, [roles.user], roles.ts, roles.tiebreak, "__pos")
    totals = df.groupBy(roles.user).agg(F.count(roles.ts).alias("__total"))
    block = F.floor((F.col("__pos") - 1) / list_size).cast("long")
    return (
        placed.join(totals, roles.user).withColumn("list_no", block)
        .where((F.col("list_no") + 1) * list_size <= F.col("__total"))
        .withColumn("list_pos", F.col("__pos") - F.col("list_no") * list_size)
        .drop("__pos", "__total")
    )


def temporal_split(df: DataFrame, roles: Roles, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Add ``split``: the oldest share is train, the next validation, the newest test, cut at exact time quantiles."""
    micros = F.unix_micros(F.col(roles.ts).cast("timestamp"))
    first, second = exact_quantiles(df, micros, [train, train + validation])
    if first is None:
        return df.withColumn("split", F.lit(None).cast("string"))
    return df.withColumn(
        "split", F.when(micros <= first, "train").when(micros <= second, "validation").otherwise("test")
    )


def _draw(parts: Sequence[Column | str], salt: Column) -> Column:
    """A number from 0 to 2^32 - 1 that depends on the parts and the salt alone."""
    text = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts],
                       salt.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


UNSEEN_BUCKET = 4096


def negative_samples(df: DataFrame, roles: Roles, ratio: int = 4) -> DataFrame:
    """(user, item, draw, negative_item): per interacted pair ``ratio`` drawn items the user never touched.

    Items are numbered without gaps. A draw names a rank among the user's unseen items, so no draw is lost and all unseen
    items are equally likely; only a user who has seen every item gets none. The r-th unseen item is item r + k, where k
    seen items stand before it: of the seen items in order, those whose number less their own rank is at most r. Seen
    items and draws of a user meet in ranges of ``UNSEEN_BUCKET`` numbers, with counts of the ranges before.
    """
    user, item = roles.user, roles.item
    pairs = df.select(user, item).where(F.col(user).isNotNull() & F.col(item).isNotNull()).distinct()
    numbers = materialize(global_numbers(pairs.select(item).distinct(), [item], "number", first=0), "item-numbers")
    total = numbers.count()
    seen = pairs.join(numbers, item).select(user, "number")
    width = F.lit(UNSEEN_BUCKET)

    def earlier(rows: DataFrame, count: Column) -> DataFrame:
        """(user, range, before): the summed ``count`` of the user's ranges before each range."""
        sums = rows.groupBy(user, "range").agg(F.sum(count).alias("n"))
        before = Window.partitionBy(user).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        return sums.select(user, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    ranged = seen.withColumn("range", F.floor(F.col("number") / width))
    inside = Window.partitionBy(user, "range").orderBy("number")
    placed = ranged.join(earlier(ranged, F.lit(1)), [user, "range"]).select(
        user, (F.col("number") - F.col("before") - F.row_number().over(inside) + 1).alias("key"))
    history = seen.groupBy(user).agg(F.count(F.lit(1)).alias("__seen")).where(F.col("__seen") < total)
    drawn = pairs.join(history, user).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(ratio))))
    salt = F.concat(F.lit("n"), F.col("draw").cast("string"))
    drawn = drawn.select(user, item, "draw", F.pmod(_draw([user, item], salt), F.lit(total) - F.col("__seen")).alias("key"))
    both = placed.select(user, F.lit(None).cast(df.schema[item].dataType).alias(item), F.lit(0).alias("draw"), "key").unionByName(drawn)
    both = both.withColumn("range", F.floor(F.col("key") / width))
    is_seen = (F.col("draw") == 0).cast("long")
    upto = Window.partitionBy(user, "range").orderBy("key", "draw", item).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.join(earlier(both, is_seen), [user, "range"]).withColumn("k", F.col("before") + F.sum(is_seen).over(upto))
    chosen = found.where(F.col("draw") > 0).select(user, item, "draw", (F.col("key") + F.col("k")).alias("number"))
    return chosen.join(numbers.withColumnRenamed(item, "negative_item"), "number").select(user, item, "draw", "negative_item")


def positive_pairs(df: DataFrame, roles: Roles, user_table: DataFrame, item_table: DataFrame) -> DataFrame:
    """Each interaction with the features of its user and of its item."""
    return df.join(user_table, roles.user, "left").join(item_table, roles.item, "left")
