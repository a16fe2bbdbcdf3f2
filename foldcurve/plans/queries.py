"""The registered queries: each operator over the given tables, with its SQL where SQL can say it.

Three sources of predictions are derived by projection: E from `events`, O from
`orders` and D from `customer`. Each has a row key, a label, a score and a fold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcurve.operators import align, folds, fuzzy, importance, neighbors, ranking, roc, scale, sparse, symbolic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FOLDS = 10


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


# Sources -----------------------------------------------------------------

E_COLUMNS = [
    "'E' as model",
    "event_id as row_id",
    "int(event_id % 10) as fold_id",
    "int(event_type = 'purchase') as y",
    "value / 500 as p",
]
O_COLUMNS = [
    "'O' as model",
    "o_orderkey as row_id",
    "int(o_orderkey % 10) as fold_id",
    "int(o_orderstatus = 'F') as y",
    "o_totalprice / 500000 as p",
]


def source_e(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*E_COLUMNS)


def source_o(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(*O_COLUMNS)


def source_eo(spark: SparkSession, folder: str) -> DataFrame:
    return source_e(spark, folder).unionByName(source_o(spark, folder))


def three_models(spark: SparkSession, folder: str) -> DataFrame:
    """Three models on the events: the value, its distance from the middle, and the hour of day."""
    rows = table(spark, folder, "events").selectExpr(
        "event_id as row_id",
        "int(event_id % 10) as fold_id",
        "int(event_type = 'purchase') as y",
        "inline(array(struct('VALUE' as model, value / 500 as p),"
        " struct('MIDDLE' as model, abs(value / 500 - 0.5d) as p),"
        " struct('HOUR' as model, hour(ts) / 24d as p)))",
    )
    return rows.withColumn("yhat", F.expr("int(p > 0.5d)"))


MODELS = ["VALUE", "MIDDLE", "HOUR"]

SQL_E = """
select 'E' as model, event_id as row_id, cast(event_id % 10 as integer) as fold_id,
       case when event_type = 'purchase' then 1 else 0 end as y, value / 500 as p from events
"""
SQL_O = """
select 'O' as model, o_orderkey as row_id, cast(o_orderkey % 10 as integer) as fold_id,
       case when o_orderstatus = 'F' then 1 else 0 end as y, o_totalprice / 500000 as p from orders
"""
SQL_EO = f"({SQL_E}) union all ({SQL_O})"
SQL_THREE = """
select event_id as row_id, cast(event_id % 10 as integer) as fold_id,
       case when event_type = 'purchase' then 1 else 0 end as y, 'VALUE' as model, value / 500 as p from events
union all
select event_id, cast(event_id % 10 as integer), case when event_type = 'purchase' then 1 else 0 end,
       'MIDDLE', abs(value / 500 - cast(0.5 as double)) from events
union all
select event_id, cast(event_id % 10 as integer), case when event_type = 'purchase' then 1 else 0 end,
       'HOUR', hour(ts) / cast(24 as double) from events
"""


def sql_points(source: str, keys: str = "model") -> str:
    """Common tables of a curve: every distinct score with running counts, after the origin."""
    return f"""
with preds as ({source}),
counts as (select {keys}, p as threshold, sum(y) as pos, sum(1 - y) as neg from preds group by {keys}, p),
swept as (
  select {keys}, threshold, pos, neg,
         sum(pos) over (partition by {keys} order by threshold desc) as tp,
         sum(neg) over (partition by {keys} order by threshold desc) as fp,
         sum(pos) over (partition by {keys}) as positives,
         sum(neg) over (partition by {keys}) as negatives
  from counts),
origin as (
  select {keys}, cast('inf' as double) as threshold, 0 as pos, 0 as neg, 0 as tp, 0 as fp,
         sum(pos) as positives, sum(neg) as negatives from counts group by {keys}),
points as (
  select *, cast(tp as double) / positives as tpr, cast(fp as double) / negatives as fpr
  from (select * from swept union all by name select * from origin)),
areas as (
  select {keys}, max(positives) as positives, max(negatives) as negatives,
         cast(sum(neg * (2 * tp - pos)) as double) / (2.0 * max(positives) * max(negatives)) as auc
  from points group by {keys}),
cutoffs as (
  select {keys}, tpr as sensitivity, 1 - fpr as specificity, threshold, distance,
         positives, negatives
  from (select *, row_number() over (partition by {keys} order by distance, threshold desc) as place
        from (select *, sqrt((1 - tpr) * (1 - tpr) + fpr * fpr) as distance from points))
  where place = 1)
"""


def sql_level(level: float) -> str:
    x = f"cast({1 - level!r} as double)"
    x0, y0 = "(cast(fp - neg as double) / negatives)", "(cast(tp - pos as double) / positives)"
    return (
        f"max(case when neg > 0 and {x0} <= {x} and fpr > {x}"
        f" then (tpr - {y0}) / (fpr - {x0}) * ({x} - {x0}) + {y0} end)"
    )


SQL_SE = """
sqrt((auc * (1 - auc) + (positives - 1) * (auc / (2 - auc) - auc * auc)
      + (negatives - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (cast(positives as double) * negatives))
"""
SQL_Z = "cast(1.959963984540054 as double)"


def sql_share(share: str, rows: str, sign: str) -> str:
    return f"{share} {sign} 1.96 * sqrt({share} * (1 - {share}) / {rows})"


# ROC statistics ----------------------------------------------------------


@query(
    "roc_points",
    sql_points(SQL_E)
    + """
select model, threshold, cast(pos as bigint) as pos, cast(neg as bigint) as neg, cast(tp as bigint) as tp,
       cast(fp as bigint) as fp, cast(positives as bigint) as positives, cast(negatives as bigint) as negatives,
       round(tpr, 9) as tpr, round(fpr, 9) as fpr
from points""",
)
def roc_points(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(roc.roc_points(source_e(spark, folder)), "tpr", "fpr", digits=9)


SQL_AREAS = "cast(positives as bigint) as positives, cast(negatives as bigint) as negatives, round(auc, 9) as auc"


@query("auc_pooled", sql_points(SQL_EO) + f"select model, {SQL_AREAS} from areas")
def auc_pooled(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(roc.auc(source_eo(spark, folder)), "auc", digits=9)


@query("auc_per_fold", sql_points(SQL_EO, "model, fold_id") + f"select model, fold_id, {SQL_AREAS} from areas")
def auc_per_fold(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(roc.auc(source_eo(spark, folder), ["model", "fold_id"]), "auc", digits=9)


@query(
    "auc_lineitem",
    sql_points(
        "select l_linestatus as model, case when l_returnflag = 'R' then 1 else 0 end as y, l_extendedprice as p from lineitem"
    )
    + f"select model, {SQL_AREAS} from areas",
)
def auc_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """The largest table: hardly any equal scores, two long curves."""
    rows = table(spark, folder, "lineitem").selectExpr(
        "l_linestatus as model", "int(l_returnflag = 'R') as y", "l_extendedprice as p"
    )
    return rounded(roc.auc(rows), "auc", digits=9)


@query(
    "auc_rank_sum",
    f"""
with preds as ({SQL_O}),
ranked as (
  select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as r from preds),
sums as (select sum(y) as positives, sum(1 - y) as negatives, sum(case when y = 1 then r end) as ranks from ranked)
select 'O' as model, {SQL_AREAS.replace('round(auc, 9)', 'round(cast(ranks - positives * (positives + 1) / 2.0 as double) / (positives * negatives), 9)')}
from sums""",
)
def auc_rank_sum(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(roc.auc_rank_sum(source_o(spark, folder)), "auc", digits=9)


@query(
    "sens_at_spec",
    sql_points(SQL_EO)
    + f'select model, round({sql_level(0.90)}, 9) as "SensLevel0", round({sql_level(0.75)}, 9) as "SensLevel1" from points group by model',
)
def sens_at_spec(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(roc.sensitivity_at_specificity(source_eo(spark, folder)), "SensLevel0", "SensLevel1", digits=9)


@query(
    "optimal_cutoff",
    sql_points(SQL_EO)
    + """
select model, cast(positives as bigint) as positives, cast(negatives as bigint) as negatives,
       round(sensitivity, 9) as sensitivity, round(specificity, 9) as specificity,
       round(threshold, 9) as threshold, round(distance, 9) as distance
from cutoffs""",
)
def optimal_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    cut = roc.optimal_cutoff(source_eo(spark, folder))
    return rounded(cut, "sensitivity", "specificity", "threshold", "distance", digits=9)


@query(
    "auc_se_ci",
    sql_points(SQL_EO)
    + f"""
, rated as (select *, {SQL_SE} as se from areas)
select model, {SQL_AREAS}, round(se, 9) as "SE",
       round(auc - {SQL_Z} * se, 9) as "AucCI_lo", round(auc + {SQL_Z} * se, 9) as "AucCI_hi"
from rated""",
)
def auc_se_ci(spark: SparkSession, folder: str) -> DataFrame:
    rated = roc.auc_interval(roc.auc(source_eo(spark, folder)))
    return rounded(rated, "auc", "SE", "AucCI_lo", "AucCI_hi", digits=9)


@query(
    "sens_spec_ci",
    sql_points(SQL_EO)
    + f"""
select model, round({sql_share('sensitivity', 'positives', '-')}, 9) as "SenCI_lo",
       round({sql_share('sensitivity', 'positives', '+')}, 9) as "SenCI_hi",
       round({sql_share('specificity', 'negatives', '-')}, 9) as "SpeCI_lo",
       round({sql_share('specificity', 'negatives', '+')}, 9) as "SpeCI_hi"
from cutoffs""",
)
def sens_spec_ci(spark: SparkSession, folder: str) -> DataFrame:
    limits = ["SenCI_lo", "SenCI_hi", "SpeCI_lo", "SpeCI_hi"]
    cut = roc.share_intervals(roc.optimal_cutoff(source_eo(spark, folder)))
    return rounded(cut.select("model", *limits), *limits, digits=9)


REPORT = ["SensLevel0", "SensLevel1", "AUC", "AucCI_lo", "AucCI_hi", "SE", "OpSen", "SenCI_lo", "SenCI_hi", "OpSpe", "SpeCI_lo", "SpeCI_hi"]


def sql_report(source: str, keys: str = "model") -> str:
    return (
        sql_points(source, keys)
        + f"""
, rated as (select *, {SQL_SE} as se from areas),
levels as (select {keys}, {sql_level(0.90)} as l0, {sql_level(0.75)} as l1 from points group by {keys})
select {keys}, round(l0, 9) as "SensLevel0", round(l1, 9) as "SensLevel1", round(auc, 9) as "AUC",
       round(auc - {SQL_Z} * se, 9) as "AucCI_lo", round(auc + {SQL_Z} * se, 9) as "AucCI_hi", round(se, 9) as "SE",
       round(sensitivity, 9) as "OpSen",
       round({sql_share('sensitivity', 'rated.positives', '-')}, 9) as "SenCI_lo",
       round({sql_share('sensitivity', 'rated.positives', '+')}, 9) as "SenCI_hi",
       round(specificity, 9) as "OpSpe",
       round({sql_share('specificity', 'rated.negatives', '-')}, 9) as "SpeCI_lo",
       round({sql_share('specificity', 'rated.negatives', '+')}, 9) as "SpeCI_hi"
from rated join levels using ({keys}) join cutoffs using ({keys})"""
    )


@query("roc_report", sql_report(SQL_EO))
def roc_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(roc.roc_report(source_eo(spark, folder)), *REPORT, digits=9)


@query("roc_report_per_fold", sql_report(SQL_EO, "model, fold_id"))
def roc_report_per_fold(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(roc.roc_report(source_eo(spark, folder), ["model", "fold_id"]), *REPORT, digits=9)


# Folds and scaling -------------------------------------------------------


def orders_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey as row_id",
        "int(o_orderkey % 10) as part",
        "int(o_orderstatus = 'F') as y",
        "o_totalprice as price",
        "double(year(o_orderdate)) as year",
    )


SQL_ORDERS = """
select o_orderkey as row_id, cast(o_orderkey % 10 as integer) as part,
       case when o_orderstatus = 'F' then 1 else 0 end as y, o_totalprice as price,
       cast(year(o_orderdate) as double) as year from orders
"""


@query(
    "stratified_folds",
    """
select doc_id as row_id, quality as y,
       cast((row_number() over (order by quality, doc_id) - 1) % 10 as integer) as part from labels""",
)
def stratified_folds(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels").selectExpr("doc_id as row_id", "quality as y")
    return folds.stratified_folds(rows, FOLDS, seed=None)


@query(
    "stratified_fold_sizes",
    f"""
with c as (select y, count(*) as n from ({SQL_ORDERS}) group by y),
s as (select y, n, coalesce(sum(n) over (order by y rows between unbounded preceding and 1 preceding), 0) as start from c)
select y, cast(f as integer) as part, cast(n // 10 + case when (f + 10 - start % 10) % 10 < n % 10 then 1 else 0 end as bigint) as n
from s, range(10) as r(f)""",
)
def stratified_fold_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Folds dealt in hash order: shares of classes and totals of folds are kept to within one row."""
    rows = folds.stratified_folds(orders_rows(spark, folder), FOLDS)
    return rows.groupBy("y", "part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fold_roles",
    f"""
select row_id, part, cast(f as integer) as fold_id,
       case when part = f then 'test' when part = (f + 1) % 10 then 'valid' else 'train' end as role
from ({SQL_ORDERS}), range(10) as r(f)""",
)
def fold_roles(spark: SparkSession, folder: str) -> DataFrame:
    return folds.fold_roles(orders_rows(spark, folder).select("row_id", "part"), FOLDS)


@query(
    "fold_masks",
    f"""
with rows_ as (select *, row_number() over (order by row_id) - 1 as position from ({SQL_ORDERS}))
select cast(f as integer) as fold_id,
       case when part = f then 'test' else 'train' end as role,
       cast(count(*) as bigint) as n, cast(sum(position) as bigint) as positions, cast(sum(y) as bigint) as positives
from rows_, range(10) as r(f) group by all""",
)
def fold_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Roles joined to rows by position, with validation rows counted as training rows."""
    rows = align.with_position(orders_rows(spark, folder), None, "row_id")
    table_of_folds = folds.fold_roles(rows.select("position", "part"), FOLDS).drop("part")
    merged = folds.merge_valid(folds.with_roles(rows, table_of_folds, "position"))
    every = folds.in_role(merged, folds.TRAIN, folds.TEST)
    return every.groupBy("fold_id", "role").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("position") - 1).alias("positions"),
        F.sum("y").alias("positives"),
    )


SQL_MOMENTS = f"""
select cast(f as integer) as fold_id, 'price' as "column", count(*) as n, avg(price) as mean, stddev_pop(price) as std
from ({SQL_ORDERS}), range(10) as r(f) where part <> f group by f
union all
select cast(f as integer), 'year', count(*), avg(year), stddev_pop(year)
from ({SQL_ORDERS}), range(10) as r(f) where part <> f group by f
"""


@query(
    "training_moments",
    f'select fold_id, "column", n, round(mean, 5) as mean, round(std, 5) as std from ({SQL_MOMENTS})',
)
def training_moments(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(folds.training_moments(orders_rows(spark, folder), ["price", "year"]), "mean", "std", digits=5)


@query(
    "standardize",
    f"""
with m as ({SQL_MOMENTS}), a as (select * from m where "column" = 'price'), b as (select * from m where "column" = 'year')
select row_id, part, y, round((price - a.mean) / a.std, 6) as price, round((year - b.mean) / b.std, 6) as year
from ({SQL_ORDERS}) o join a on o.part = a.fold_id join b on o.part = b.fold_id""",
)
def standardize(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scale.standardize(orders_rows(spark, folder), ["price", "year"]), "price", "year")


# Fuzzy memberships -------------------------------------------------------


def part_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr(
        "p_partkey as row_id", "int(p_partkey % 10) as part", "p_retailprice", "p_size", "int(p_size > 25) as y"
    )


def customer_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        "c_custkey as row_id", "int(c_custkey % 10) as part", "c_acctbal", "c_mktsegment"
    )


SQL_RANGES = """
select cast(f as integer) as fold_id, min({c}) as lo, max({c}) as hi from {t}, range(10) as r(f)
where {k} % 10 <> f group by f
"""


def sql_ranges(column: str, source: str, key: str) -> str:
    return SQL_RANGES.format(c=column, t=source, k=key)


@query(
    "fuzzy_domain",
    f"""
with d as (
  select fold_id, 'c_acctbal' as "column", 'real' as kind, lo, hi, null as n_categories
  from ({sql_ranges('c_acctbal', 'customer', 'c_custkey')})
  union all
  select cast(f as integer), 'c_mktsegment', 'categorical', null, null, (select count(distinct c_mktsegment) from customer)
  from range(10) as r(f))
select fold_id, "column", kind, lo, hi, cast(n_categories as integer) as n_categories from d""",
)
def fuzzy_domain(spark: SparkSession, folder: str) -> DataFrame:
    return fuzzy.fuzzy_domain(customer_rows(spark, folder), ["c_acctbal", "c_mktsegment"])


def sql_sets(column: str, n: int, lo: str = "lo", hi: str = "hi") -> str:
    """Triangles with their feet at the neighbouring peaks."""
    out = []
    for k in range(n):
        width = f"(({hi} - {lo}) / {n - 1})"
        peak = f"({lo} + {k} * {width})"
        rise, fall = f"({column} - {peak} + {width}) / {width}", f"({peak} + {width} - {column}) / {width}"
        out.append(
            f"round(case when {column} <= {lo} then {1.0 if k == 0 else 0.0}"
            f" when {column} >= {hi} then {1.0 if k == n - 1 else 0.0}"
            f" else greatest(0.0, least({rise}, {fall})) end::double, 6) as \"{column}-{k}\""
        )
    return ", ".join(out)


def sql_fuzzified(n: int) -> str:
    return f"""
with d as ({sql_ranges('c_acctbal', 'customer', 'c_custkey')})
select c_custkey as row_id, {sql_sets('c_acctbal', n)}
from customer join d on c_custkey % 10 = fold_id"""


def fuzzified(spark: SparkSession, folder: str, n: int) -> DataFrame:
    rows = customer_rows(spark, folder)
    domain = fuzzy.fuzzy_domain(rows, ["c_acctbal"])
    out = fuzzy.fuzzify(rows, ["c_acctbal"], domain, n, keep=["row_id"])
    return rounded(out, *[f"c_acctbal-{k}" for k in range(n)])


@query("fuzzify_n3", sql_fuzzified(3))
def fuzzify_n3(spark: SparkSession, folder: str) -> DataFrame:
    return fuzzified(spark, folder, 3)


@query("fuzzify_n5", sql_fuzzified(5))
def fuzzify_n5(spark: SparkSession, folder: str) -> DataFrame:
    return fuzzified(spark, folder, 5)


@query(
    "fuzzify_array",
    f"""
with price as ({sql_ranges('p_retailprice', 'part', 'p_partkey')}),
size as ({sql_ranges('p_size', 'part', 'p_partkey')})
select p_partkey as row_id, {sql_sets('p_retailprice', 2, 'price.lo', 'price.hi')}, {sql_sets('p_size', 4, 'size.lo', 'size.hi')}
from part join price on p_partkey % 10 = price.fold_id join size on p_partkey % 10 = size.fold_id""",
)
def fuzzify_array(spark: SparkSession, folder: str) -> DataFrame:
    """A number of sets per column; the whole-number size is declared real."""
    rows, columns = part_rows(spark, folder), ["p_retailprice", "p_size"]
    domain = fuzzy.fuzzy_domain(rows, columns, kinds={"p_size": fuzzy.REAL})
    out = fuzzy.fuzzify(rows, columns, domain, [2, 4], keep=["row_id"])
    return rounded(out, *[c for c in out.columns if c != "row_id"])


@query(
    "one_hot",
    """
with c as (select c_mktsegment as s, row_number() over (order by c_mktsegment) - 1 as k from (select distinct c_mktsegment from customer))
select c_custkey as row_id, """
    + ", ".join(f'case when k = {k} then 1.0 else 0.0 end::double as "c_mktsegment-{k}"' for k in range(5))
    + " from customer join c on c_mktsegment = s",
)
def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    rows = customer_rows(spark, folder)
    return fuzzy.fuzzify(rows, ["c_mktsegment"], fuzzy.fuzzy_domain(rows, ["c_mktsegment"]), keep=["row_id"])


@query(
    "column_kinds",
    """
select unnest(['c_acctbal', 'c_custkey', 'c_mktsegment', 'c_name', 'c_nationkey']) as "column",
       unnest(['real', 'categorical', 'categorical', 'categorical', 'categorical']) as kind,
       (select count(*) from customer) as n_rows""",
)
def column_kinds(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer")
    kinds = sorted(fuzzy.column_kinds(rows, rows.columns).items())
    listed = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind")) for c, k in kinds])
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.inline(listed), "n_rows")


SQL_HOLES = "select event_id, case when event_id % 89 = 0 then null else nullif(value, 6.55) end as value, case when event_id % 97 = 0 then null else user_id end as user_id from events"


def with_holes(spark: SparkSession, folder: str) -> DataFrame:
    """Events with some values set to null or NaN, and some users to null."""
    return table(spark, folder, "events").selectExpr(
        "event_id", "if(event_id % 89 = 0, double('NaN'), nullif(value, 6.55d)) as value", "if(event_id % 97 = 0, null, user_id) as user_id"
    )


@query(
    "drop_null_report",
    f"""
select event_id, concat_ws(',', case when value is null then 'value' end, case when user_id is null then 'user_id' end) as missing
from ({SQL_HOLES}) where value is null or user_id is null""",
)
def drop_null_report(spark: SparkSession, folder: str) -> DataFrame:
    dropped = fuzzy.dropped_rows(with_holes(spark, folder), ["value", "user_id"], "event_id")
    return dropped.withColumn("missing", F.concat_ws(",", "missing"))


@query(
    "complete_rows",
    f"""
select 'kept' as rows, count(*) as n, round(sum(value), 2) as total from ({SQL_HOLES}) where value is not null and user_id is not null
union all
select 'kept by key', count(*), round(sum(value), 2) from ({SQL_HOLES}) where value is not null and user_id is not null
union all
select 'dropped', count(*), null from ({SQL_HOLES}) where value is null or user_id is null""",
)
def complete_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of kept and dropped rows; keeping by the null test and by the list of dropped keys agree."""
    rows, columns = with_holes(spark, folder), ["value", "user_id"]
    gone = fuzzy.dropped_rows(rows, columns, "event_id")

    def sized(df: DataFrame, name: str, total: F.Column) -> DataFrame:
        return df.agg(F.lit(name).alias("rows"), F.count(F.lit(1)).alias("n"), F.round(total, 2).alias("total"))

    return align.pool(
        sized(fuzzy.complete_rows(rows, columns), "kept", F.sum("value")),
        sized(fuzzy.without_keys(rows, gone, "event_id"), "kept by key", F.sum("value")),
        sized(gone, "dropped", F.max(F.lit(None).cast("double"))),
    )


# Expressions -------------------------------------------------------------

PART_COLUMNS = ["price", "size"]


def scaled_parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr(
        "p_partkey as row_id", "p_retailprice / 1000 as price", "p_size / 25 - 1 as size", "int(p_size > 25) as y"
    )


SQL_PARTS = """
select p_partkey as row_id, p_retailprice / 1000 as price, p_size / cast(25 as double) - 1 as size,
       case when p_size > 25 then 1 else 0 end as y from part
"""

# One expression per function, with the same in SQL.
EXPRESSIONS = {
    "add": (("add", "price", "size"), "price + size"),
    "sub": (("sub", "price", ("mul", "size", 0.3)), "price - size * 0.3::double"),
    "mul": (("mul", "price", "size"), "price * size"),
    "div": (("div", "price", "size"), "case when abs(size) > 0.001 then price / size else 1 end"),
    "sqrt": (("sqrt", "size"), "sqrt(abs(size))"),
    "neg": (("neg", "size"), "-size"),
    "abs": (("abs", "size"), "abs(size)"),
    "wa": (("WA", "price", "size", 0.25), "0.25::double * price + 0.75::double * size"),
    "owa": (("OWA", "price", "size", 0.25), "0.25::double * greatest(price, size) + 0.75::double * least(price, size)"),
    "min": (("min", "price", "size"), "least(price, size)"),
    "max": (("max", "price", "size"), "greatest(price, size)"),
    "dilator": (("dilator", "price"), "price ** 0.5::double"),
    "concentrator": (("concentrator", "size"), "size * size"),
}


@query(
    "expr_scores",
    "select row_id, "
    + ", ".join(f"round(1 / (1 + exp(-({sql}))), 6) as p_{name}" for name, (_, sql) in EXPRESSIONS.items())
    + f" from ({SQL_PARTS})",
)
def expr_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = scaled_parts(spark, folder)
    scores = {
        f"p_{name}": F.round(symbolic.logistic(symbolic.compile_expr(tree, PART_COLUMNS)), 6)
        for name, (tree, _) in EXPRESSIONS.items()
    }
    return rows.select("row_id", *[c.alias(n) for n, c in scores.items()])


POPULATION = ["add", "sub", "mul", "abs", "owa"]


@query(
    "population_auc",
    sql_points(
        " union all ".join(
            f"select {i} as candidate, y, {EXPRESSIONS[name][1]} as p from ({SQL_PARTS})" for i, name in enumerate(POPULATION)
        ),
        "candidate",
    )
    + "select cast(candidate as integer) as candidate, round(auc, 9) as fitness from areas",
)
def population_auc(spark: SparkSession, folder: str) -> DataFrame:
    trees = [EXPRESSIONS[name][0] for name in POPULATION]
    return rounded(symbolic.population_auc(scaled_parts(spark, folder), trees, PART_COLUMNS), "fitness", digits=9)


@query("probability_pair", f"select row_id, round(1 - p, 9) as p0, round(p, 9) as p1 from ({SQL_O})")
def probability_pair(spark: SparkSession, folder: str) -> DataFrame:
    pairs = source_o(spark, folder).select("row_id", symbolic.probability_pair(F.col("p")).alias("pair"))
    return pairs.select("row_id", F.round(F.col("pair")[0], 9).alias("p0"), F.round(F.col("pair")[1], 9).alias("p1"))


# Neighbours --------------------------------------------------------------


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").selectExpr(
        "vec_id as row_id", "int(vec_id % 5) as part", "cast(embedding as array<double>) as features", "int(label < 5) as y"
    )


SQL_NEAREST = """
with v as (select vec_id as id, vec_id % 5 as part, embedding::double[] as x, case when label < 5 then 1 else 0 end as y from embeddings),
pairs as (
  select a.id, b.id as neighbor, b.y,
         list_sum(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2]))) as distance
  from v a join v b on a.part <> b.part),
ranked as (select *, row_number() over (partition by id order by distance, neighbor) as place from pairs),
nearest as (select * from ranked where place <= 5)
"""


@query(
    "knn_manhattan",
    SQL_NEAREST
    + """
, same as (select id, count(*) filter (where distance = 0) as n0, avg(y) filter (where distance = 0) as y0,
                  sum(y / distance) filter (where distance > 0) / sum(1 / distance) filter (where distance > 0) as y1
           from nearest group by id),
scored as (select id as row_id, case when n0 > 0 then y0 else y1 end as p from same)
select row_id, round(p, 6) as p, case when p > 0.5 then 1 else 0 end as yhat from scored""",
)
def knn_manhattan(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector scored by its 5 nearest vectors of the other folds."""
    rows = vectors(spark, folder)
    return rounded(neighbors.knn_scores(rows, rows, 5, part="part"), "p")


@query(
    "nearest_neighbors",
    SQL_NEAREST + "select id as row_id, neighbor, round(distance, 6) as distance, cast(y as double) as y, cast(place as integer) as rank from nearest",
)
def nearest_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder)
    return rounded(neighbors.nearest_neighbors(rows, rows, 5, part="part"), "distance")


# Alignment and correctness -----------------------------------------------


def sql_wide(value: str) -> str:
    return ", ".join(f"max(case when model = '{m}' then {value} end) as \"{m}\"" for m in MODELS)


@query(
    "align_models",
    f"""
select fold_id, row_id, {', '.join(f'''round(max(case when model = '{m}' then p end), 9) as "{m}"''' for m in MODELS)},
       max(y)::double as class
from ({SQL_THREE}) group by fold_id, row_id""",
)
def align_models(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(align.result_table(three_models(spark, folder), MODELS), *MODELS, digits=9)


@query("class_table", f"select fold_id, row_id, {sql_wide('y::double')} from ({SQL_THREE}) group by fold_id, row_id")
def class_table(spark: SparkSession, folder: str) -> DataFrame:
    return align.class_table(three_models(spark, folder), MODELS)


SQL_CORRECT = f"select *, case when y = case when p > 0.5 then 1 else 0 end then 1.0 else 0.0 end::double as correct from ({SQL_THREE})"


@query("correctness", f"select fold_id, row_id, {sql_wide('correct')} from ({SQL_CORRECT}) group by fold_id, row_id")
def correctness(spark: SparkSession, folder: str) -> DataFrame:
    return align.correctness_table(three_models(spark, folder), MODELS)


@query(
    "accuracy",
    f"""
select model, fold_id, cast(sum(correct) as bigint) as n_correct, count(*) as n, round(avg(correct), 9) as accuracy
from ({SQL_CORRECT}) group by model, fold_id""",
)
def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(align.accuracy(three_models(spark, folder), ["model", "fold_id"]), "accuracy", digits=9)


@query(
    "attach_baseline",
    f"""
with results as (select *, row_number() over (order by fold_id, row_id) as position from ({SQL_E})),
baseline as (select user_id as baseline, row_number() over (order by event_id) as position from events)
select position, model, row_id, fold_id, y, round(p, 9) as p, baseline from results join baseline using (position)""",
)
def attach_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """A baseline column joined to pooled results by position, not by key."""
    baseline = table(spark, folder, "events").selectExpr("event_id", "user_id as baseline")
    out = align.attach_by_position(source_e(spark, folder), baseline, ["baseline"], "fold_id", "row_id", "event_id")
    return rounded(out, "p", digits=9)


@query("result_replay", sql_report(SQL_THREE))
def result_replay(spark: SparkSession, folder: str) -> DataFrame:
    """The report made from the wide score table instead of the long predictions."""
    wide = align.result_table(three_models(spark, folder), MODELS)
    return rounded(roc.roc_report(align.to_long(wide, MODELS)), *REPORT, digits=9)


# Grids and rankings ------------------------------------------------------

GRID = {"scale": [1, 2], "center": [100000, 200000, 300000]}
SQL_GRID = " union all ".join(
    f"select {i} as cell, cast(o_orderkey % 10 as integer) as fold_id,"
    f" case when o_orderstatus = 'F' then 1 else 0 end as y,"
    f" {a} * abs(o_totalprice - {b}) as p from orders"
    for i, (a, b) in enumerate((a, b) for a in GRID["scale"] for b in GRID["center"])
)


def grid_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The distance of an order's price from a center, for every cell of a small grid; scored by fold."""
    cells = ranking.grid_cells(GRID)
    rows = table(spark, folder, "orders").select(
        F.expr("int(o_orderkey % 10) as fold_id"),
        F.expr("int(o_orderstatus = 'F') as y"),
        F.posexplode(F.array(*[c["scale"] * F.abs(F.col("o_totalprice") - c["center"]) for c in cells])).alias("cell", "p"),
    )
    return roc.auc(rows, ["fold_id", "cell"])


@query(
    "grid_mean_scores",
    sql_points(SQL_GRID, "fold_id, cell") + "select cast(cell as integer) as cell, round(avg(auc), 9) as mean_score from areas group by cell",
)
def grid_mean_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ranking.mean_scores(grid_scores(spark, folder), keys=[]), "mean_score", digits=9)


@query(
    "best_cell",
    sql_points(SQL_GRID, "fold_id, cell")
    + """
, best as (select *, row_number() over (partition by fold_id order by auc desc, cell) as place from areas)
select fold_id, cast(cell as integer) as cell, round(auc, 9) as auc from best where place = 1""",
)
def best_cell(spark: SparkSession, folder: str) -> DataFrame:
    """The best cell of each fold. Cells that differ in scale only tie, so the first of them wins."""
    return rounded(ranking.best_cell(grid_scores(spark, folder), keys=["fold_id"], score="auc"), "auc", digits=9)


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
SQL_IMPORTANCE = " union all ".join(
    f"select {i} as index, '{c}' as feature, abs(corr({c}, case when l_returnflag = 'R' then 1.0 else 0.0 end)) as value from lineitem"
    for i, c in enumerate(FEATURES)
)
SQL_RANKED = f"""
with i as ({SQL_IMPORTANCE}),
ranked as (select *, row_number() over (order by value desc, index desc) as rank, avg(value) over () as mean_value from i)
"""


def importances(spark: SparkSession, folder: str) -> DataFrame:
    """Absolute correlation of each feature with the label, from one pass."""
    y = F.expr("double(l_returnflag = 'R')")
    row = table(spark, folder, "lineitem").agg(*[F.abs(F.corr(F.col(c), y)).alias(c) for c in FEATURES])
    listed = [F.struct(F.lit(i).alias("index"), F.lit(c).alias("feature"), F.col(c).alias("value")) for i, c in enumerate(FEATURES)]
    return row.select(F.inline(F.array(*listed)))


@query(
    "importance_rank",
    SQL_RANKED
    + """
select cast(index as integer) as index, feature, round(value, 9) as value, cast(rank as integer) as rank,
       round(mean_value, 9) as mean_value, value >= mean_value as selected from ranked""",
)
def importance_rank(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ranking.importance_rank(importances(spark, folder)), "value", "mean_value", digits=9)


@query(
    "selected_features",
    SQL_RANKED + "select string_agg(index::varchar, ', ' order by index) as text from ranked where value >= mean_value",
)
def selected_features(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.selected_features(ranking.importance_rank(importances(spark, folder))).select("text")


# Roles, masks, parameters, fitness, text ---------------------------------

SQL_FEW = "select p_partkey as row_id, p_retailprice / 1000.0 as a, cast(p_size as double) as b, case when p_size > 25 then 1 else 0 end as y from part"


def few_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr(
        "p_partkey as row_id", "p_retailprice / 1000d as a", "double(p_size) as b", "int(p_size > 25) as y"
    )


@query(
    "masks_to_rows",
    """
select cast(f as integer) as fold_id, n_nationkey as row_id,
       case when n_nationkey % 5 = f then 'test' when n_nationkey % 5 = (f + 1) % 5 then 'valid' else 'train' end as role
from nation, range(5) as r(f)""",
)
def masks_to_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Masks by position, gathered over the nations, and back to rows."""
    each = folds.fold_roles(table(spark, folder, "nation").selectExpr("n_nationkey as row_id", "int(n_nationkey % 5) as part"), 5)
    masks = each.groupBy("fold_id").agg(
        *[
            F.transform(F.sort_array(F.collect_list(F.struct("row_id", (F.col("role") == r).cast("int").alias("m")))), lambda x: x["m"]).alias(r)
            for r in (folds.TRAIN, folds.VALID, folds.TEST)
        ]
    )
    return folds.masks_to_rows(masks)


SQL_ROLES = """
select fold_id, row_id, role from (
  select cast(f as integer) as fold_id, o_orderkey as row_id,
    case when o_orderkey % 7 = f or o_orderkey % 7 = f + 3 then 'test' when o_orderkey % 7 = 6 then null
         when o_orderkey % 7 = f + 1 then 'valid' else 'train' end as role
  from orders, range(3) as r(f)) where role is not null
"""


@query(
    "external_fold_rows",
    f"""
select fold_id, tested, count(*) as n, round(sum(o_totalprice), 2) as total from (
  select fold_id, row_id, cast(max(case when role = 'test' then 1 else 0 end) as integer) as tested from ({SQL_ROLES}) group by fold_id, row_id)
join orders on o_orderkey = row_id group by fold_id, tested""",
)
def external_fold_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that each fold of a role table trains on and tests: some rows are in no role, some are tested twice."""
    from foldcurve.plans.evaluate import TESTED, fold_rows

    orders = table(spark, folder, "orders")
    role = F.expr(
        "case when row_id % 7 = fold_id or row_id % 7 = fold_id + 3 then 'test' when row_id % 7 = 6 then null"
        " when row_id % 7 = fold_id + 1 then 'valid' else 'train' end"
    )
    given = orders.selectExpr("o_orderkey as row_id", "explode(array(0, 1, 2)) as fold_id").withColumn("role", role).where("role is not null")
    rows = orders.selectExpr("o_orderkey as row_id", "o_totalprice")
    parts = [fold_rows(rows, i, given).withColumn("fold_id", F.lit(i)) for i in range(3)]
    return align.pool(*parts).groupBy("fold_id", F.col(TESTED).alias("tested")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("fold_bitmaps", SQL_ROLES)
def fold_bitmaps(spark: SparkSession, folder: str) -> DataFrame:
    """Roles of all orders as bitmaps by block, made from two halves of the orders, and back to rows."""
    role = F.expr(
        "case when row_id % 7 = fold_id or row_id % 7 = fold_id + 3 then 'test' when row_id % 7 = 6 then null"
        " when row_id % 7 = fold_id + 1 then 'valid' else 'train' end"
    )
    given = table(spark, folder, "orders").selectExpr("o_orderkey as row_id", "explode(array(0, 1, 2)) as fold_id").withColumn("role", role).where("role is not null")
    halves = [folds.rows_to_bitmaps(given.where(F.col("row_id") % 2 == i)) for i in (0, 1)]
    return folds.bitmaps_to_rows(folds.union_bitmaps(halves[0].unionByName(halves[1])))


@query(
    "positioned_rows",
    "select row_number() over () - 1 as row_id, o_totalprice, cast(o_orderstatus = 'F' as integer) as y from orders",
)
def positioned_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders without their key, numbered by their place in the file."""
    from foldcurve.sources.tables import by_position

    return by_position(table(spark, folder, "orders")).selectExpr("__row as row_id", "o_totalprice", "int(o_orderstatus = 'F') as y")


TEXTS = ["sub(b, mul(a, 13))", "add(div(a, b), -0.5)", "max(a, neg(b))"]


@query(
    "expression_text",
    f"""
with r as ({SQL_FEW}), v as (
  select row_id, 0 as n, b - a * 13 as x from r union all
  select row_id, 1, case when abs(b) > 0.001 then a / b else 1 end - 0.5 from r union all
  select row_id, 2, greatest(a, -b) from r)
select row_id, n, round(1 / (1 + exp(-x)), 9) as p from v""",
)
def expression_text(spark: SparkSession, folder: str) -> DataFrame:
    """Stored expression texts, read and scored."""
    rows = few_rows(spark, folder)
    scored = [symbolic.score_expr(rows, symbolic.from_text(t), ["a", "b"]).select("row_id", F.lit(i).alias("n"), "p") for i, t in enumerate(TEXTS)]
    return rounded(align.pool(*scored), "p", digits=9)


@query(
    "population_accuracy",
    f"""
with r as ({SQL_FEW}), v as (
  select y, 0 as candidate, b - a * 13 as x from r union all
  select y, 1, case when abs(b) > 0.001 then a / b else 1 end - 0.5 from r union all
  select y, 2, greatest(a, -b) from r)
select cast(candidate as integer) as candidate, round(avg(case when (x > 0) = (y = 1) then 1.0 else 0.0 end), 9) as fitness from v group by candidate""",
)
def population_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Another fitness than the area: the share of rows on the right side of zero."""

    def accuracy(scored: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
        right = (F.col(score) > 0) == (F.col(label) == 1)
        return scored.groupBy(*keys).agg(F.avg(right.cast("double")).alias("fitness"))

    trees = [symbolic.from_text(t) for t in TEXTS]
    return rounded(symbolic.population_auc(few_rows(spark, folder), trees, ["a", "b"], fitness=accuracy), "fitness", digits=9)


@query(
    "one_hot_sparse",
    """
with v as (select v, row_number() over (order by v) - 1 as k from (select distinct cast(c_name as varchar) as v from customer))
select c_custkey as row_id, 'c_name' as "column", k as index from customer join v on c_name = v""",
)
def one_hot_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """As many categories as customers, numbered without a list of them."""
    return fuzzy.one_hot_sparse(table(spark, folder, "customer").selectExpr("c_custkey as row_id", "c_name"), ["c_name"], "row_id")


SQL_ORDER_VALUES = """
with r as (select case when o_orderstatus = 'F' then 1 else 0 end as y, unnest(['o_custkey', 'o_orderpriority']) as "column", unnest([cast(o_custkey as varchar), cast(o_orderpriority as varchar)]) as value from orders),
"""


@query(
    "sparse_categories",
    SQL_ORDER_VALUES
    + """g as (select "column", value, count(*) as n_rows, cast(sum(y) as bigint) as n_ones from r group by all)
select "column", value, cast(row_number() over (order by "column", value) - 1 as integer) as index, n_rows, n_ones, cast(count(*) over () as integer) as size from g""",
)
def sparse_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Categories of customers and priorities as sparse vectors, counted by class from the vectors and named by the dictionary."""
    rows = table(spark, folder, "orders").selectExpr("o_orderkey as row_id", "o_custkey", "o_orderpriority", "int(o_orderstatus = 'F') as y")
    columns = ["o_custkey", "o_orderpriority"]
    dictionary = sparse.category_dictionary(rows, columns)
    vectors = sparse.sparse_features(rows, columns, dictionary, keep=["y"])
    counted = vectors.select("y", F.explode(sparse.active("features")).alias("index")).groupBy("index")
    return counted.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("y").alias("n_ones")).join(dictionary, "index")


@query("fuzzy_label", "select o_orderkey as row_id, case when o_orderstatus = 'F' then 0.0::double else 1.0::double end as \"y-0\", case when o_orderstatus = 'F' then 1.0::double else 0.0::double end as \"y-1\" from orders")
def fuzzy_label(spark: SparkSession, folder: str) -> DataFrame:
    """The label of every order as memberships of its two classes."""
    return fuzzy.fuzzy_label(table(spark, folder, "orders").selectExpr("o_orderkey as row_id", "int(o_orderstatus = 'F') as y"))



# What a column means to a score -------------------------------------------

SQL_CONSTRUCTED = """
with r as (select o_orderkey as row_id, case when o_orderstatus = 'F' then 1 else 0 end as y, o_totalprice / 100000.0 as a, o_orderkey % 11 as b, o_orderkey % 3 as c from orders),
d as (select *, lead(a, 1, first_a) over w as da, lead(b, 1, first_b) over w as db, lead(c, 1, first_c) over w as dc
  from (select *, first(a) over v as first_a, first(b) over v as first_b, first(c) over v as first_c from r window v as (order by row_id)) window w as (order by row_id)),
s as (select y, unnest(['', 'a', 'b', 'c']) as feature, unnest([a - b * 0.1, da - b * 0.1, a - db * 0.1, a - b * 0.1]) as p from d),
k as (select feature, y, rank() over (partition by feature order by p) + (count(*) over (partition by feature, p) - 1) / 2.0 as r from s),
g as (select feature, (sum(r) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) as auc from k group by feature)
select 'made' as model, 'sub(a, mul(b, 0.1))' as text, 5 as length, 2 as depth, feature, round(auc, 9) as auc, round((select auc from g where feature = '') - auc, 9) as importance
from g where feature <> ''
"""


@query("constructed_importance", SQL_CONSTRUCTED)
def constructed_importance(spark: SparkSession, folder: str) -> DataFrame:
    """A constructed feature, and what is lost when each column is taken from the next order; it does not use c."""
    rows = table(spark, folder, "orders").selectExpr(
        "o_orderkey as row_id", "int(o_orderstatus = 'F') as y", "o_totalprice / 100000d as a", "double(o_orderkey % 11) as b", "double(o_orderkey % 3) as c"
    )
    tree = symbolic.from_text("sub(a, mul(b, 0.1))")
    return rounded(importance.constructed_importance(rows, {"made": tree}, ["a", "b", "c"], seed=None), "auc", "importance", digits=9)
