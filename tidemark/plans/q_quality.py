"""Registered validation / projection / filter / IO queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quality as qa
from tidemark.plans.catalog import register
from tidemark.plans.oracle import rounded, with_fixtures
from tidemark.plans.q_labels import POL
from tidemark.session import scratch_path
from tidemark.sources import cohort as co
from tidemark.sources import tables as tb

NUM = ["price", "acctbal", "qty", "n_lines", "disc"]


@register("check_table", with_fixtures(
    """select 'required' as "check", 'missing_col' as item, 'missing column' as detail, cast(null as bigint) as count
       union all select 'type', 'segment', 'expected numeric, got string', null
       union all select 'no_nulls', c, 'null values', n from (
         select 'price' as c, count(*) filter (where price is null) as n from T union all
         select 'acctbal', count(*) filter (where acctbal is null) from T union all
         select 'status', count(*) filter (where status is null) from T union all
         select 'priority', count(*) filter (where priority is null) from T) x where n > 0""", "T"))
def q_check_table(spark, sf):
    t = tb.tabular(spark, sf)
    return qa.check_table(t, required=["row_id", "price", "missing_col"], types={"price": "numeric", "segment": "numeric"},
                          no_nulls=["price", "acctbal", "status", "priority"])


@register("check_numeric_column", with_fixtures(
    """select * from (
         select 'nulls' as "check", 'qty' as item, 'null or NaN values' as detail, count(*) filter (where qty is null or isnan(qty)) as count from T
         union all select 'min_value', 'qty', 'values below 10.0', count(*) filter (where qty < 10.0) from T
         union all select 'max_value', 'qty', 'values above 300.0', count(*) filter (where qty > 300.0) from T) x
       where count > 0""", "T"))
def q_check_numeric(spark, sf):
    return qa.check_numeric_column(tb.tabular(spark, sf), "qty", min_value=10.0, max_value=300.0)


@register("check_probabilities", with_fixtures(
    """select * from (
         select 'nulls' as "check", 'p' as item, 'null or NaN probabilities' as detail,
                count(*) filter (where p is null or isnan(p)) as count from P
         union all select 'range', 'p', 'outside [0, 1]', count(*) filter (where p < 0 or p > 1) from P
         union all select 'row_sum', 'row_id', 'row sums differ from 1 by more than 1e-05',
                (select count(*) from (select row_id from P group by row_id having abs(sum(p) - 1.0) > 1e-05) s)) x
       where count > 0""", "P"))
def q_check_proba(spark, sf):
    return qa.check_probabilities(tb.scored_multiclass(spark, sf))


@register("check_feature_names", with_fixtures(
    """select 'forbidden' as "check", 'label' as item, 'forbidden name' as detail, cast(null as bigint) as count
       union all select 'required', 'age', 'missing required name', null""", "T"))
def q_check_names(spark, sf):
    return qa.check_feature_names(tb.tabular(spark, sf), forbidden=["label"], required=["price", "age"])


@register("check_scoring_input", with_fixtures(
    """select 'missing' as "check", 'age' as item, 'expected column absent' as detail, cast(null as bigint) as count
       union all select 'extra', 'row_id', 'unexpected column', null
       union all select 'extra', 'status', 'unexpected column', null
       union all select 'extra', 'priority', 'unexpected column', null
       union all select 'extra', 'segment', 'unexpected column', null
       union all select 'extra', 'label', 'unexpected column', null""", "T"))
def q_check_scoring(spark, sf):
    return qa.check_scoring_input(tb.tabular(spark, sf), NUM + ["age"])


@register("check_weights", with_fixtures(
    """select 'class_weight' as "check", cast(cls as varchar) as item, 'weight out of bounds' as detail,
              cast(null as bigint) as count from (select distinct label as cls from T) c
       where case cls """ + " ".join(f"when {c} then {POL.weight(c)}" for c in POL.classes) + """ end > 7.5""", "T"))
def q_check_weights(spark, sf):
    """Policy weights of the classes present in T, bounded to [0, 7.5]."""
    present = tb.tabular(spark, sf).select(F.col("label").cast("long").alias("cls")).distinct()
    pol = POL.to_df(spark).join(present, "cls", "left_semi")
    return qa.check_weights(pol, 0.0, 7.5)


@register("select_numeric", rounded(with_fixtures("select row_id, price, acctbal, qty, n_lines, disc, label from T",
                                                  "T"), NUM))
def q_select_numeric(spark, sf):
    return qa.select_numeric(tb.tabular(spark, sf), "label")


@register("select_categorical", with_fixtures("select status, priority, segment from T", "T"))
def q_select_cat(spark, sf):
    return qa.select_categorical(tb.tabular(spark, sf))


@register("align_features", rounded(with_fixtures("select disc, qty, price from T", "T"), ["disc", "qty", "price"]))
def q_align(spark, sf):
    return qa.align_features(tb.tabular(spark, sf), ["disc", "qty", "price"])


@register("filter_date_range", rounded(with_fixtures(
    """select event_id, ts, user_id, event_type, value from events
       where ts >= timestamp '2024-01-05 00:00:00' and ts <= timestamp '2024-01-09 23:59:59.999999'"""), ["value"]))
def q_date_range(spark, sf):
    e = tb.read_table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return qa.filter_date_range(e, "ts", "2024-01-05", "2024-01-09")


@register("filter_entity", rounded(with_fixtures(
    "select * from L where patient_id in (select distinct patient_id from L order by patient_id limit 10)", "L"),
    tb.SYMPTOMS_L))
def q_filter_entity(spark, sf):
    """First 10 entities in id order (top-n ids semi-joined back)."""
    return qa.filter_entity(tb.longitudinal(spark, sf), "patient_id", first_n=10)


@register("filter_above_threshold", rounded(with_fixtures("select * from B where score >= 0.3", "B"), ["score"]))
def q_filter_above(spark, sf):
    return qa.filter_above_threshold(tb.scored_binary(spark, sf), "score", 0.3)


@register("filter_events", rounded(with_fixtures("select * from B where y_true = 1", "B"), ["score"]))
def q_filter_events(spark, sf):
    return qa.filter_events(tb.scored_binary(spark, sf), "y_true")


@register("dataset_profile", rounded(with_fixtures(
    """select count(*) as rows, cast(10 as bigint) as columns, cast(7 as bigint) as numeric_columns,
              cast(3 as bigint) as text_columns,
              cast(count(*) filter (where price is null) + count(*) filter (where acctbal is null)
                 + count(*) filter (where qty is null) + count(*) filter (where n_lines is null)
                 + count(*) filter (where disc is null) + count(*) filter (where status is null) as bigint) as null_cells,
              (count(*) filter (where price is null) + count(*) filter (where acctbal is null)
                 + count(*) filter (where qty is null) + count(*) filter (where n_lines is null)
                 + count(*) filter (where disc is null) + count(*) filter (where status is null)) * 100.0
                 / (count(*) * 10) as null_percent from T""", "T"), ["null_percent"]))
def q_profile(spark, sf):
    return qa.dataset_profile(tb.tabular(spark, sf))[0]


@register("target_value_counts", with_fixtures(
    """select 'M6_Rem' as target, M6_Rem as value, count(*) as count from O group by 2
       union all select 'Y1_Rem', Y1_Rem, count(*) from O group by 2
       union all select 'Y1_Rem_6', Y1_Rem_6, count(*) from O group by 2""", "O"))
def q_target_counts(spark, sf):
    """Null-inclusive value counts of the outcome columns."""
    return qa.dataset_profile(tb.outcomes(spark, sf), ["M6_Rem", "Y1_Rem", "Y1_Rem_6"])[1]


@register("read_cohort_csv", with_fixtures(
    """select patient_id, M6_Rem, Y1_Rem, Y1_Rem_6 from O""", "O"))
def q_read_cohort(spark, sf):
    """Round trip: O written as CSV (nulls as the text None) to the shared folder, read back
    with the NA-string reader."""
    path = scratch_path(spark, "cohort-csv-")
    o = tb.outcomes(spark, sf)
    o.fillna("None").write.mode("overwrite").option("header", True).csv(path)
    schema = "patient_id bigint, M6_Rem string, Y1_Rem string, Y1_Rem_6 string"
    return co.read_cohort(spark, path, schema)


#: Each coded item holds price x its number in the list, so that a wrong or swapped name shows.
_RENAMED = {f"{code}: {name}": n for n, (code, name) in enumerate(co.ITEM_NAMES.items(), 1)}


@register("rename_items", rounded(with_fixtures(
    "select row_id, " + ", ".join(f'price * {n} as "{name}"' for name, n in _RENAMED.items()) + " from T", "T"),
    list(_RENAMED)))
def q_rename(spark, sf):
    """All 30 coded items of a wide table get their descriptive names."""
    t = tb.tabular(spark, sf).select("row_id", *[(F.col("price") * n).alias(f"M0_PANSS_{code}")
                                                 for n, code in enumerate(co.ITEM_NAMES, 1)])
    return co.rename_items(t)


@register("write_table")
def q_write_table(spark, sf):
    """Parquet sink round trip of the early-warning table, partitioned by alert score."""
    from tidemark.operators.longitudinal import early_warning_features
    path = scratch_path(spark, "ew-")
    ew = early_warning_features(tb.longitudinal(spark, sf), "patient_id", "t", tb.SYMPTOMS_L, tb.WARNING_SIGNS_L, 1.5)
    co.write_table(ew, path, "parquet", partition_by=["early_warning_score"])
    return spark.read.parquet(path)
