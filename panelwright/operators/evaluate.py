"""Metrics at a capacity of k units, capacity lists, and what can be evaluated at all.

The capacity row of each k is found in two levels: the sums of range pieces say which piece holds the k-th unit, and only such pieces are put
in order. Of their rows, each k picks one, by conditional maxima of one hash aggregate, so many k cost what one does and no row is repeated per k.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.sizing import broadcast_if_small
from panelwright.operators import ranking
from panelwright.operators.prefix import PIECE
from panelwright.operators.ranking import GROUP
from panelwright.session import durable

# Published capacity shares.
CAPACITY_SHARES = [0.01, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5]
CURVE_METRICS = [
    "precision_all",
    "precision_upper_bound",
    "precision_lower_bound",
    "recall_all",
    "recall_of_0_all",
    "recall_imputed_1",
    "recall_upper_bound",
    "recall_lower_bound",
]
FILLS = ["_no_impute", "_imputed_1", "_imputed_0", "_upper_bound", "_lower_bound"]
CELLS = ["true_negative", "false_positive", "false_negative", "true_positive"]

_AT = ["row_number", "c_l0", "c_l1", "c_flip", "c_missing", "p_l0", "p_l1"]
_AT_KNOWN = ["known_row", "c_l0", "p_l0"]
_END = {"row_number": "t_rows", "c_l0": "t_l0", "c_l1": "t_l1", "c_flip": "t_flip", "c_missing": "t_missing"}


def _reaches(k: Column, before: Column, upto: Column, first: Column, last: Column) -> Column:
    """Whether the units of an order first reach k behind ``before`` and by ``upto``; all of them where they fall short, none where k is not above 0.

    A k that is null is never reached.
    """
    limit = F.coalesce(k, F.lit((1 << 63) - 1))
    return ((limit > before) | first) & ((limit <= upto) | last)


def _pieces_with(ks: Sequence[Column]) -> Column:
    """Range pieces that hold a capacity row, in the order of all rows or of the known ones."""
    every = F.lit(False)
    known_before, known = F.col("_b_rows") - F.col("_b_c_missing"), F.col("_n") - F.col("_s_c_missing")
    for k in ks:
        units, held = F.col("_b_num_units_so_far"), F.col("_s_num_units_so_far")
        every |= _reaches(k, units, units + held, F.col("_b_rows") == 0, F.col("_b_rows") + F.col("_n") == F.col("t_rows"))
        units, held = F.col("_b_known_units_so_far"), F.col("_s_known_units_so_far")
        last = known_before + known == F.col("t_rows") - F.col("t_missing")
        every |= (known > 0) & _reaches(k, units, units + held, known_before == 0, last)
    return every


def _rows_at(ranked: DataFrame, label: str, group: Sequence[str], units: str, ks: Mapping[str, Column]) -> DataFrame:
    """Per group and k, the running values at the capacity row (at_*) and at the last row (end_*).

    ``p_*`` are the sums before the row itself. The known_* forms are over rows with a known label: both
    orders are one order, so a known row stands at row_number - c_missing among the known rows.
    """
    fills = ranking.label_fills(label)
    rows = ranked.select(
        *group,
        *ks.values(),
        *_AT[:5],
        *_END.values(),
        (F.col("c_l0") - fills["l0"]).alias("p_l0"),
        (F.col("c_l1") - fills["l1"]).alias("p_l1"),
        fills["missing"].alias("missing"),
        (F.col("row_number") - F.col("c_missing")).alias("known_row"),
        (F.col("t_rows") - F.col("t_missing")).alias("known_rows"),
        F.coalesce(F.col(units).cast("long"), F.lit(0).cast("long")).alias("held"),
        F.col("num_units_so_far").alias("upto"),
        F.col("known_units_so_far").alias("known_upto"),
    )

    def reached(k: Column) -> Column:
        return _reaches(k, F.col("upto") - F.col("held"), F.col("upto"), F.col("row_number") == 1, F.col("row_number") == F.col("t_rows"))

    def reached_known(k: Column) -> Column:
        before, last = F.col("known_upto") - F.col("held"), F.col("known_row") == F.col("known_rows")
        return (F.col("missing") == 0) & _reaches(k, before, F.col("known_upto"), F.col("known_row") == 1, last)

    # One row or two per group and k are left; only these are put beside each k.
    names = [k for k in rows.columns if k.startswith("_k")]
    chosen = reduce(lambda a, b: a | b, [reached(F.col(k)) | reached_known(F.col(k)) for k in names])
    kept = rows.where(chosen)
    long = kept.unpivot([c for c in kept.columns if c not in names], names, "_name", "top_k")
    long = long.withColumns({"hit": reached(F.col("top_k")), "hit_known": reached_known(F.col("top_k"))})
    at = [F.max(F.when(F.col("hit"), F.col(x))).alias(f"at_{x}") for x in _AT]
    at += [F.max(F.when(F.col("hit_known"), F.col(x))).alias(f"at_known_{x}") for x in _AT_KNOWN]
    end = [F.max(t).alias(f"end_{x}") for x, t in _END.items()]
    known = F.max(F.when(F.col("known_rows") > 0, F.col("known_rows"))).alias("end_known_known_row")
    known_l0 = F.max(F.when(F.col("known_rows") > 0, F.col("t_l0"))).alias("end_known_c_l0")
    return long.groupBy(*group, "_name", "top_k").agg(*at, *end, known, known_l0).drop("_name")


def _capacities(k) -> dict[str, Column]:
    """Each k under a name of its own: from a list of numbers, one number, or a column of one number per group."""
    every = k if isinstance(k, (list, tuple)) else [k]
    return {f"_k{i}": x if isinstance(x, Column) else F.lit(x).cast("long") for i, x in enumerate(dict.fromkeys(every) if not isinstance(k, Column) else every)}


def metrics_at_k(
    df: DataFrame,
    label: str,
    k,
    group: Sequence[str] = GROUP,
    score: str = "score",
    units: str = "units",
    entity: str = "entity_id",
    inclusive: bool = False,
    bounded: bool = False,
) -> DataFrame:
    """Precision, recall, bounds and confusion counts per group and capacity k.

    Predicted positives stop before the capacity row; inclusive=True counts that row too. Precision and
    recall are always read at the capacity row. A column k must be constant within a group.
    """
    rows, order_group = df, list(group)
    if isinstance(k, Column):
        # One number per group: as a part of the group it is known wherever the group is.
        rows, order_group = df.withColumn("_own_k", k.cast("long")), [*group, "_own_k"]
        k = F.col("_own_k")
    ks = {name: x.alias(name) for name, x in _capacities(k).items()}
    in_pieces = {name: F.col(f"{PIECE}._own_k") if "_own_k" in order_group else x for name, x in ks.items()}
    ranked = ranking.ranked_rows(rows, label, order_group, score, units, entity, (), bounded, _pieces_with(list(in_pieces.values())))
    state = _rows_at(ranked, label, group, units, ks)
    c = {x: F.col(f"at_c_{x}") for x in ("l0", "l1", "flip", "missing")}
    t = {x: F.col(f"end_c_{x}") for x in ("l0", "l1", "flip")}
    curve = ranking.bounds(F.col("at_row_number"), c, t)
    return state.select(
        *group,
        "top_k",
        F.try_divide("end_known_c_l0", "end_known_known_row").alias("precision_baseline"),
        F.try_divide("at_known_c_l0", "at_known_known_row").alias("precision_no_imputed"),
        F.try_divide("at_known_c_l0", "end_known_c_l0").alias("recall_not_imputed"),
        *[curve[m].alias(m) for m in CURVE_METRICS],
        *[cell for fill in FILLS for cell in _confusion(fill, inclusive)],
    )


def _confusion(fill: str, inclusive: bool) -> list[Column]:
    """Four counts under one label fill, from the running sums at the capacity row and the totals."""
    known = fill == "_no_impute"
    at, end = ("at_known_", "end_known_") if known else ("at_", "end_")
    number = "known_row" if known else "row_number"
    chosen, rows = F.col(at + number), F.col(end + number)
    # The bounds fill unknown labels one way up to the capacity row and the other way behind it.
    upto = "l1" if fill in ("_imputed_1", "_upper_bound") else "l0"
    behind = {"_upper_bound": "l0", "_lower_bound": "l1"}.get(fill, upto)
    positives = F.col(f"{at}c_{upto}") + F.col(f"{end}c_{behind}") - F.col(f"{at}c_{behind}")
    hits = F.col(f"{at}c_{upto}") if inclusive else F.col(f"{at}p_{upto}")
    chosen = chosen if inclusive else chosen - 1
    counts = {
        "true_negative": rows - chosen - (positives - hits),
        "false_positive": chosen - hits,
        "false_negative": positives - hits,
        "true_positive": hits,
    }
    return [counts[cell].cast("long").alias(f"confusion_{cell}{fill}") for cell in CELLS]


def metric_rows(wide: DataFrame, group: Sequence[str] = GROUP, test_matrix: str | Column = "test") -> DataFrame:
    """Wide metrics to evaluation rows (metric, parameters, value, test_matrix_name, top_k)."""
    names = [c for c in wide.columns if c not in group and c != "top_k"]
    doubles = wide.select(*group, F.col("top_k").cast("string").alias("top_k"), *[F.col(n).cast("double").alias(n) for n in names])
    long = doubles.unpivot([*group, "top_k"], names, "metric", "value")
    matrix = F.lit(test_matrix) if isinstance(test_matrix, str) else test_matrix
    return long.select(
        *group, "metric", F.lit("NotApplicable").alias("parameters"), "value", matrix.alias("test_matrix_name"), "top_k"
    )


# --- what can be evaluated, and at which k -----------------------------------------------------------


def labelled_per_month(test: DataFrame, label: str, month: str = "month_start") -> DataFrame:
    """Rows with a known label per month, months without any included."""
    return test.groupBy(month).agg(F.count(label).alias("labelled"))


def months_without_labels(test: DataFrame, label: str, month: str = "month_start") -> DataFrame:
    return labelled_per_month(test, label, month).where(F.col("labelled") == 0).select(month)


def drop_unlabelled_months(test: DataFrame, label: str, month: str = "month_start") -> DataFrame:
    """Keep the months that have a known label."""
    # Stored and counted, so that test rows are filtered in place instead of shuffled on the month.
    skipped = broadcast_if_small(durable(months_without_labels(test, label, month)))
    return test.join(skipped, month, "left_anti")


def capacity_list(
    test: DataFrame, label: str, units: str, shares: Sequence[float] = CAPACITY_SHARES, month: str = "month_start"
) -> DataFrame:
    """k at each share of the mean units behind known labels per month, rounded half to even."""
    per_month = test.where(F.col(label).isNotNull()).groupBy(month).agg(F.sum(units).alias("units"))
    mean = per_month.agg(F.avg("units").alias("mean_units")).where(F.col("mean_units").isNotNull())
    picked = mean.select("mean_units", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return picked.select("share", F.bround(F.col("share") * F.col("mean_units")).cast("long").alias("top_k"))


def half_of_visited(visited: DataFrame, units: str = "units_canvassed") -> DataFrame:
    """Capacity per month: half of the units visited that month, rounded down."""
    return visited.withColumn("top_k", F.floor(F.col(units) / 2).cast("long"))


def with_units(test: DataFrame, entities: DataFrame, entity: str = "address_id", units: str = "internal_units_static",
               target: str | None = None, min_units: int = 6) -> DataFrame:
    """Left-join unit counts of (target-area) entities with enough units, as one column ``units``."""
    kept = entities.where(F.col(units).cast("int") >= min_units)
    if target is not None:
        kept = kept.where(F.col(target) == 1)
    side = kept.select(entity, F.col(units).cast("int").alias("units"))
    return test.drop("units").join(side, entity, "left")


def score_histogram(df: DataFrame, bins: int = 20, group: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Counts of scores in equal bins on [0, 1]; a score of 1 falls into the last bin."""
    numbered = F.least(F.width_bucket(F.col(score), F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins))
    return df.groupBy(*group, numbered.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, truth: str, predicted: str, group: Sequence[str] = ()) -> DataFrame:
    """Confusion counts of two 0/1 columns; rows where either is null count nowhere."""
    y, p = F.col(truth), F.col(predicted)
    return df.groupBy(*group).agg(
        F.count_if((y == 0) & (p == 0)).alias("true_negative"),
        F.count_if((y == 0) & (p == 1)).alias("false_positive"),
        F.count_if((y == 1) & (p == 0)).alias("false_negative"),
        F.count_if((y == 1) & (p == 1)).alias("true_positive"),
    )


def baseline_precision(df: DataFrame, label: str, group: Sequence[str] = GROUP) -> DataFrame:
    return df.groupBy(*group).agg(F.avg(label).alias("precision_baseline"))
