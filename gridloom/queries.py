"""The registered queries of the cube engine over the given tables, and the same results as SQL.

Cubes: Qty, QtyA, QtyN, Sales [Part, Month], SalesFlag [Flag, Month], RetailPrice [Part], AcctBal [Supplier],
NationOf [Part, Month] (member of Nation), EventValue [EventType, Day].  Part, Supplier, Nation and the like are tables; Month is the
calendar from START, Day is January 2024.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.model import Model

# First year and months of the calendar, days of the event month.
START, MONTHS, DAYS = 1995, 84, 31
CALENDAR = [f"{START + k // 12}-{k % 12 + 1:02d}" for k in range(MONTHS)]


def tables(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


_models: dict[tuple, tuple[tuple, Model]] = {}


def base(spark: SparkSession, sf_dir: str, exact: bool = True) -> Model:
    """A fork of the model of the given tables, which a Spark application builds once for a folder, and again if its tables are rewritten.  It holds plans, no data:
    nothing is read until a metric is, and then from the files."""
    key, now = (sf_dir, exact), _written(spark, sf_dir)
    if key not in _models or _models[key][0] != now:
        _models[key] = (now, _base(spark, sf_dir, exact))
    return _models[key][1].fork()


def _written(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells that a model's plans still hold: the application, and the names and times of the folder's tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return (spark.sparkContext.applicationId, *sorted((f.getPath().getName(), f.getModificationTime()) for f in files))


def _base(spark: SparkSession, sf_dir: str, exact: bool) -> Model:
    t, m = tables(spark, sf_dir), Model(spark, exact=exact)
    part, supplier, nation = t("part"), t("supplier"), t("nation")
    m.add_dimension("Part", part.select("p_partkey"))
    m.add_dimension("Brand", part.select("p_brand").distinct())
    m.add_dimension("PType", part.select("p_type").distinct())
    m.add_dimension("Supplier", supplier.select("s_suppkey"))
    m.add_dimension("Nation", nation.select("n_nationkey"))
    m.add_dimension("Region", t("region").select("r_regionkey"))
    m.add_dimension("Month", CALENDAR, ordered=True)
    m.add_dimension("Flag", ["A", "N", "R"])
    m.add_dimension("EventType", t("events").select("event_type").distinct())
    m.add_dimension("Day", [f"{d + 1:02d}" for d in range(DAYS)], ordered=True)
    m.add_property("Part", "Brand", "Brand", part.select("p_partkey", "p_brand"))
    m.add_property("Part", "Type", "PType", part.select("p_partkey", "p_type"))
    m.add_property("Supplier", "Nation", "Nation", supplier.select("s_suppkey", "s_nationkey"))
    m.add_property("Nation", "Region", "Region", nation.select("n_nationkey", "n_regionkey"))
    li = t("lineitem").withColumn("Month", ((F.year("l_shipdate") - START) * 12 + F.month("l_shipdate") - 1).cast("int")).where(F.col("Month").between(0, MONTHS - 1)).withColumnRenamed("l_partkey", "Part")
    cells = lambda keys, v, df=li: df.groupBy(*keys).agg(v.alias("v"))
    pm = ["Part", "Month"]
    put = lambda name, dims, df, kind="number": m.add_input(name, dims, df, kind, unique=False)  # noqa: E731  unique by grouping
    put("Qty", pm, cells(pm, F.sum("l_quantity")))
    put("QtyA", pm, cells(pm, F.sum("l_quantity"), li.where("l_returnflag = 'A'")))
    put("QtyN", pm, cells(pm, F.sum("l_quantity"), li.where("l_returnflag = 'N'")))
    put("Sales", pm, cells(pm, F.sum("l_extendedprice")))
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    put("SalesFlag", ["Flag", "Month"], cells(["Flag", "Month"], F.sum("l_extendedprice"), li.withColumn("Flag", flag)))
    put("RetailPrice", ["Part"], part.select(F.col("p_partkey").alias("Part"), F.col("p_retailprice").alias("v")))
    put("AcctBal", ["Supplier"], supplier.select(F.col("s_suppkey").alias("Supplier"), F.col("s_acctbal").alias("v")))
    first = cells(pm, F.min("l_suppkey")).withColumnRenamed("v", "s_suppkey").join(supplier, "s_suppkey").select(*pm, F.col("s_nationkey").alias("v"))
    put("NationOf", pm, first, "member:Nation")
    ev = t("events").where("year(ts) = 2024 and month(ts) = 1").select(F.col("event_type").alias("EventType"), (F.dayofmonth("ts") - 1).alias("Day"), "value")
    put("EventValue", ["EventType", "Day"], cells(["EventType", "Day"], F.sum("value"), ev))
    m.add_input("Cutoff", [], {(): "1998-06"}, kind="member:Month")
    m.add_formula("BA", ["Brand", "Month"], "QtyA[BY SUM: Part.Brand]")
    m.add_formula("BTotal", ["Brand"], "Qty[REMOVE SUM: Month][BY SUM: Part.Brand]")
    m.add_formula("NSales", ["Nation", "Month"], "Sales[BY SUM: Part.NationOf]")
    return m


# The cubes of base() as SQL.
PRELUDE = f"""WITH li AS (SELECT * FROM (SELECT l_partkey AS part, (year(l_shipdate) - {START}) * 12 + month(l_shipdate) - 1 AS month, l_quantity, l_extendedprice, l_suppkey, l_returnflag FROM lineitem) WHERE month BETWEEN 0 AND {MONTHS - 1}),
qty AS (SELECT part, month, fsum(l_quantity) AS v FROM li GROUP BY part, month), qa AS (SELECT part, month, fsum(l_quantity) AS v FROM li WHERE l_returnflag = 'A' GROUP BY part, month),
qn AS (SELECT part, month, fsum(l_quantity) AS v FROM li WHERE l_returnflag = 'N' GROUP BY part, month), sales AS (SELECT part, month, fsum(l_extendedprice) AS v FROM li GROUP BY part, month),
sf AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag, month, fsum(l_extendedprice) AS v FROM li GROUP BY 1, 2),
nof AS (SELECT x.part, x.month, s_nationkey AS nation FROM (SELECT part, month, min(l_suppkey) AS s FROM li GROUP BY part, month) x JOIN supplier ON s_suppkey = x.s),
ba AS (SELECT p_brand AS brand, month, fsum(v) AS v FROM qa JOIN part ON p_partkey = part GROUP BY 1, 2), bt AS (SELECT p_brand AS brand, fsum(v) AS v FROM qty JOIN part ON p_partkey = part GROUP BY 1),
ns AS (SELECT nation, sales.month AS month, fsum(v) AS v FROM sales JOIN nof USING (part, month) GROUP BY 1, 2), months AS (SELECT unnest(generate_series(0, {MONTHS - 1})) AS month), brands AS (SELECT DISTINCT p_brand AS brand FROM part)
"""


@dataclass(frozen=True)
class Spec:
    """A formula over base(): dimensions, kind, decimals of the result, and the SELECT with the same rows (after PRELUDE)."""

    dims: str
    formula: str
    sql: str
    kind: str = "number"
    decimals: int = 4


PM, BM = "part, month", "brand, month"
ROW = "ba_rows AS (SELECT DISTINCT brand FROM ba), grid AS (SELECT brand, month, ba.v AS x FROM ba_rows CROSS JOIN months LEFT JOIN ba USING (brand, month))"
_both = "qa FULL JOIN qn USING (part, month)"


def _fold(step: str, lags: int) -> str:
    """A recursive query over the periods of each brand; step gives the new value v from x and the values p1, p2, ... before."""
    names = ", ".join(f"p{k}" for k in range(1, lags + 1))
    start = re.sub(r"\bp\d\b", "CAST(NULL AS DOUBLE)", step)
    shifted = ", ".join(["r.v", *(f"r.p{k}" for k in range(1, lags))])
    again = re.sub(r"\b(p\d|x)\b", lambda m: {"x": "g.x", "p1": "r.v"}.get(m[0]) or f"r.p{int(m[0][1:]) - 1}", step)
    return f"""{PRELUDE.replace("WITH li", "WITH RECURSIVE li", 1)}, {ROW}, r(brand, month, v, {names}) AS (SELECT brand, month, {start}, {", ".join(["CAST(NULL AS DOUBLE)"] * lags)} FROM grid WHERE month = 0
UNION ALL SELECT g.brand, g.month, {again}, {shifted} FROM r JOIN grid g ON g.brand = r.brand AND g.month = r.month + 1) SELECT brand, month, round(v, 4) AS v FROM r WHERE v IS NOT NULL"""


def _sum(*terms: str) -> str:
    """A sum in which a blank counts as 0 and all blank is blank."""
    return f"CASE WHEN {' OR '.join(f'{t} IS NOT NULL' for t in terms)} THEN {' + '.join(f'coalesce({t}, 0.0)' for t in terms)} END"


SPECS = {
    "mul_join": Spec("Part Month", "Qty * RetailPrice", "SELECT part, month, round(v * p_retailprice, 4) AS v FROM qty JOIN part ON p_partkey = part"),
    "add_union": Spec("Part Month", "QtyA + QtyN", f"SELECT part, month, round(coalesce(qa.v, 0) + coalesce(qn.v, 0), 4) AS v FROM {_both}"),
    "sub_union": Spec("Part Month", "QtyA - QtyN", f"SELECT part, month, round(coalesce(qa.v, 0) - coalesce(qn.v, 0), 4) AS v FROM {_both}"),
    "div_blank": Spec("Part Month", "QtyA / (QtyN - QtyA)", "SELECT part, month, round(qa.v / (coalesce(qn.v, 0) - qa.v), 4) AS v FROM qa LEFT JOIN qn USING (part, month) WHERE coalesce(qn.v, 0) - qa.v <> 0"),
    "cmp_gt": Spec("Part Month", "QtyA > QtyN", "SELECT part, month, qa.v > qn.v AS v FROM qa JOIN qn USING (part, month)", "boolean"),
    "cmp_eq_fused": Spec("Part Month", "QtyA * 2 = QtyA + QtyA", "SELECT part, month, true AS v FROM qa", "boolean"),
    "and_kleene": Spec("Part Month", "QtyA > 30 AND QtyN > 30", f"SELECT * FROM (SELECT part, month, qa.v > 30 AND qn.v > 30 AS v FROM {_both}) WHERE v IS NOT NULL", "boolean"),
    "or_kleene": Spec("Part Month", "QtyA > 30 OR QtyN > 30", f"SELECT * FROM (SELECT part, month, qa.v > 30 OR qn.v > 30 AS v FROM {_both}) WHERE v IS NOT NULL", "boolean"),
    "not_flag": Spec("Part Month", "NOT QtyA > 30", "SELECT part, month, NOT v > 30 AS v FROM qa", "boolean"),
    "neg_chain": Spec("Part Month", "-QtyA * 3 + QtyA / 2", "SELECT part, month, round(-v * 3 + v / 2, 4) AS v FROM qa"),
    "if_else": Spec("Part Month", "IF(QtyA > 30, QtyN, 0)", "SELECT part, month, CASE WHEN qa.v > 30 THEN qn.v ELSE 0.0 END AS v FROM qa LEFT JOIN qn USING (part, month) WHERE NOT (qa.v > 30 AND qn.v IS NULL)"),
    "if_no_else": Spec("Part Month", "IF(QtyA > 30, QtyA * 2)", "SELECT part, month, v * 2 AS v FROM qa WHERE v > 30"),
    "if_branch_dims": Spec("Brand Flag Month", "IF(BTotal > 0, SalesFlag[FILTER: SalesFlag > 0], 0)", "SELECT brand, flag, month, round(sf.v, 4) AS v FROM bt CROSS JOIN sf WHERE bt.v > 0 AND sf.v > 0 UNION ALL SELECT brand, flag, month, 0.0 FROM (SELECT brand FROM bt WHERE NOT v > 0) CROSS JOIN (SELECT unnest([0, 1, 2]) AS flag) CROSS JOIN months"),
    "filter_cond": Spec("Part Month", "QtyA[FILTER: QtyN > 30]", "SELECT part, month, qa.v AS v FROM qa JOIN qn USING (part, month) WHERE qn.v > 30"),
    "filter_lower_grain": Spec("Part Month", "QtyA[FILTER: RetailPrice > 950]", "SELECT part, month, v FROM qa JOIN part ON p_partkey = part WHERE p_retailprice > 950"),
    "on_support": Spec("Part Month", "RetailPrice[ON: QtyA]", "SELECT part, month, round(p_retailprice, 4) AS v FROM qa JOIN part ON p_partkey = part"),
    "expand_dim": Spec("Brand Flag", "BTotal[EXPAND: Flag]", "SELECT brand, flag, round(v, 4) AS v FROM bt CROSS JOIN (SELECT unnest([0, 1, 2]) AS flag)"),
    "ifblank_dense": Spec("Brand Month", "IFBLANK(BA, 0)", "SELECT brand, month, round(coalesce(v, 0.0), 4) AS v FROM brands CROSS JOIN months LEFT JOIN ba USING (brand, month)"),
    "isblank_dense": Spec("Brand Month", "ISBLANK(BA)", "SELECT brand, month, v IS NULL AS v FROM brands CROSS JOIN months LEFT JOIN ba USING (brand, month)", "boolean"),
    "const_densify": Spec("Brand Month", "BA + 1", "SELECT brand, month, round(coalesce(v, 0.0) + 1, 4) AS v FROM brands CROSS JOIN months LEFT JOIN ba USING (brand, month)"),
    "dim_number": Spec("Brand Month", "BA[FILTER: Month < Month.\"1996-01\"]", "SELECT brand, month, round(v, 4) AS v FROM ba WHERE month < 12"),
    "select_member": Spec("Part", "Qty[SELECT: Month.\"1996-01\"]", "SELECT part, round(v, 4) AS v FROM qty WHERE month = 12"),
    "shift_prev": Spec("Brand Month", "BA[SELECT: Month - 1]", f"SELECT brand, month + 1 AS month, round(v, 4) AS v FROM ba WHERE month + 1 < {MONTHS}"),
    "shift_next": Spec("Brand Month", "BA[SELECT: Month + 2]", "SELECT brand, month - 2 AS month, round(v, 4) AS v FROM ba WHERE month >= 2"),
    "growth_on_previous": Spec("Brand Month", "BA / BA[SELECT: Month - 12] - 1[EXPAND: Brand, Month]", "SELECT brand, month, round(coalesce(a.v / b.v, 0.0) - 1, 7) AS v FROM brands CROSS JOIN months LEFT JOIN ba a USING (brand, month) LEFT JOIN (SELECT brand, month + 12 AS month, v FROM ba) b USING (brand, month)", decimals=7),
    "remove_sum": Spec("Part", "Sales[REMOVE SUM: Month]", "SELECT part, round(fsum(v), 2) AS v FROM sales GROUP BY part", decimals=2),
    "remove_avg": Spec("Part", "Qty[REMOVE AVG: Month]", "SELECT part, round(avg(v), 4) AS v FROM qty GROUP BY part"),
    "remove_min": Spec("Part", "Sales[REMOVE MIN: Month]", "SELECT part, round(min(v), 2) AS v FROM sales GROUP BY part", decimals=2),
    "remove_max": Spec("Part", "Sales[REMOVE MAX: Month]", "SELECT part, round(max(v), 2) AS v FROM sales GROUP BY part", decimals=2),
    "remove_count": Spec("Part", "NationOf[REMOVE COUNT: Month]", "SELECT part, CAST(count(*) AS DOUBLE) AS v FROM nof GROUP BY part"),
    "remove_multi_dim": Spec("", "Sales[REMOVE SUM: Part, Month]", "SELECT round(fsum(l_extendedprice), 2) AS v FROM li", decimals=2),
    "exact_sum": Spec("Month", "Sales[REMOVE SUM: Part]", "SELECT month, round(fsum(v), 2) AS v FROM sales GROUP BY month", decimals=2),
    "exact_avg": Spec("Flag", "SalesFlag[REMOVE AVG: Month]", "SELECT flag, round(fsum(v) / count(*), 2) AS v FROM sf GROUP BY flag", decimals=2),
    "by_sum_property": Spec("Brand Month", "Sales[BY SUM: Part.Brand]", "SELECT p_brand AS brand, month, round(fsum(v), 2) AS v FROM sales JOIN part ON p_partkey = part GROUP BY 1, 2", decimals=2),
    "by_count_property": Spec("PType Month", "Qty[BY COUNT: Part.Type]", "SELECT p_type AS ptype, month, CAST(count(*) AS DOUBLE) AS v FROM qty JOIN part ON p_partkey = part GROUP BY 1, 2"),
    "by_two_levels": Spec("Region", "AcctBal[BY SUM: Supplier.Nation, Nation.Region]", "SELECT n_regionkey AS region, round(fsum(s_acctbal), 2) AS v FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1", decimals=2),
    "by_lookup_property": Spec("Part Month", "Qty / BTotal[BY: Part.Brand]", "SELECT part, month, round(qty.v / bt.v, 4) AS v FROM qty JOIN part ON p_partkey = part JOIN bt ON brand = p_brand WHERE bt.v <> 0"),
    "by_metric_sum": Spec("Nation Month", "Sales[BY SUM: Part.NationOf]", "SELECT nation, month, round(v, 2) AS v FROM ns", decimals=2),
    "by_metric_count": Spec("Nation Month", "Sales[BY COUNT: Part.NationOf]", "SELECT nation, month, CAST(count(*) AS DOUBLE) AS v FROM sales JOIN nof USING (part, month) GROUP BY 1, 2"),
    "by_metric_lookup": Spec("Part Month", "NSales[BY: Part.NationOf]", "SELECT part, nof.month AS month, round(ns.v, 2) AS v FROM nof JOIN ns ON ns.nation = nof.nation AND ns.month = nof.month", decimals=2),
    "member_compare_cutoff": Spec("Part Month", "IF(Month <= Cutoff, QtyA, QtyN)", "SELECT part, month, v FROM qa WHERE month <= 41 UNION ALL SELECT part, month, v FROM qn WHERE month > 41"),
    "scan_cumsum": Spec("Brand Month", "PREVIOUS(Month) + BA", f", {ROW} SELECT brand, month, round(v, 4) AS v FROM (SELECT brand, month, sum(x) OVER (PARTITION BY brand ORDER BY month) AS v FROM grid) WHERE v IS NOT NULL"),
    "scan_decay": Spec("Brand Month", "PREVIOUS(Month) * 0.5 + BA", _fold(_sum("p1 * 0.5", "x"), 1)),
    "scan_two_lags": Spec("Brand Month", "PREVIOUS(Month, 2) * 0.5 + PREVIOUS(Month, 3) * 0.25 + BA", _fold(_sum("p2 * 0.5", "p3 * 0.25", "x"), 3)),
    "scan_conditional": Spec("Brand Month", "IF(IFBLANK(PREVIOUS(Month), 0) > 1000, 0, PREVIOUS(Month) + IFBLANK(BA, 0))", f"""{PRELUDE.replace("WITH li", "WITH RECURSIVE li", 1)}, grid AS (SELECT brand, month, coalesce(ba.v, 0.0) AS x FROM brands CROSS JOIN months LEFT JOIN ba USING (brand, month)), r(brand, month, v) AS (SELECT brand, month, x FROM grid WHERE month = 0
UNION ALL SELECT g.brand, g.month, CASE WHEN r.v > 1000 THEN 0.0 ELSE r.v + g.x END FROM r JOIN grid g ON g.brand = r.brand AND g.month = r.month + 1) SELECT brand, month, round(v, 4) AS v FROM r"""),
    "event_running": Spec("EventType Day", "PREVIOUS(Day) + EventValue", f"SELECT eventtype, day, round(v, 2) AS v FROM (SELECT eventtype, day, sum(x) OVER (PARTITION BY eventtype ORDER BY day) AS v FROM (SELECT eventtype, day, e.v AS x FROM (SELECT DISTINCT event_type AS eventtype FROM events WHERE year(ts) = 2024 AND month(ts) = 1) CROSS JOIN (SELECT unnest(generate_series(0, {DAYS - 1})) AS day) LEFT JOIN (SELECT event_type AS eventtype, day(ts) - 1 AS day, fsum(value) AS v FROM events WHERE year(ts) = 2024 AND month(ts) = 1 GROUP BY 1, 2) e USING (eventtype, day))) WHERE v IS NOT NULL", decimals=2),
}


def shown(m: Model, df: DataFrame, decimals: int | None) -> DataFrame:
    """Lower-case columns, whole numbers as long, values rounded."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        c = c.cast("long") if kind in ("int", "bigint", "smallint") else F.round(c, decimals) if kind == "double" and decimals is not None else c
        cols.append(c.alias(name.lower()))
    return df.select(*cols)


def _spec(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = SPECS[name]
        m = base(spark, sf_dir)
        m.add_formula("Result", s.dims.split(), s.formula, s.kind)
        return shown(m, m.cube("Result"), s.decimals)

    run.__doc__ = f"{SPECS[name].formula} over [{SPECS[name].dims}]."
    return run


def scan_mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening and closing balances that refer to each other."""
    m = base(spark, sf_dir)
    m.add_formula("Opening", ["Brand", "Month"], "BA * 0")
    m.add_formula("Closing", ["Brand", "Month"], "Opening + BA")
    m.add_formula("Opening", ["Brand", "Month"], "Closing[SELECT: Month - 1] * 0.9")
    return shown(m, m.cube("Closing"), 4)


def coalesce_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides of a formula's first period."""
    m = base(spark, sf_dir)
    m.add_formula("Plan", ["Brand", "Month"], "BA * 2", overridable=True)
    m.write_many("Plan", spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("Brand")).distinct().select("Brand", F.lit(0).alias("Month"), F.lit(7.0).alias("v")))
    return shown(m, m.cube("Plan"), 4)


def override_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on an overridden formula."""
    m = base(spark, sf_dir)
    m.add_formula("Plan", ["Flag", "Month"], "SalesFlag", overridable=True)
    m.add_formula("Total", ["Month"], "Plan[REMOVE SUM: Flag]")
    m.set_cell("Plan", 1.0, Flag="A", Month=CALENDAR[0])
    return shown(m, m.cube("Total"), 2)


def _spread(how: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = base(spark, sf_dir)
        m.add_input("Budget", ["Flag", "Month"], m.cube("SalesFlag"), unique=False)
        m.spread("Budget", 1000.0, {"Month": CALENDAR[12:24]}, how=how)
        return shown(m, m.cube("Budget"), 4)

    run.__doc__ = f"1,000 spread over a year of a metric, {how}."
    return run


def write_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric after a bulk write that changes, blanks and adds cells."""
    m = base(spark, sf_dir)
    m.add_input("Budget", ["Brand", "Month"], m.cube("BA"), unique=False)
    edits = m.cube("BA").where("Month < 12").withColumn("v", F.when(F.col("Month") < 6, F.col("v") * 2))
    m.write_many("Budget", edits)
    return shown(m, m.cube("Budget"), 4)


def _edited(spark: SparkSession, sf_dir: str) -> Model:
    m, bm = base(spark, sf_dir), ["Brand", "Month"]
    m.keep("BA")  # else each reader of Plan, and the edit, sums the items again
    m.add_input("Plan", bm, m.cube("BA"), unique=False)
    m.add_formula("Half", bm, "Plan * 0.5")
    m.add_formula("Total", ["Month"], "Plan[REMOVE SUM: Brand]")
    m.add_formula("Late", bm, "Half[SELECT: Month - 12]")
    m.add_formula("ToDate", bm, "PREVIOUS(Month) + Half")
    m.recalc()
    m.write_many("Plan", m.cube("BA").where("Month in (3, 40)").withColumn("v", F.when(F.col("Month") == 3, F.col("v") * 10)))
    return m


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept results of four formulas after an edit of two months: only the regions that it reaches are evaluated again."""
    m = _edited(spark, sf_dir)
    m.recalc()
    parts = [shown(m, m.cube(name), 4).withColumn("metric", F.lit(name)) for name in ("Half", "Total", "Late", "ToDate")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select("metric", "brand", "month", "v")


def exact_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums in which large terms cancel: 1e17 + quantity - 1e17 is the quantity only if the sum is exact."""
    m = base(spark, sf_dir)
    term = lambda k, v: F.struct(F.lit(k).alias("Flag"), v.alias("v"))
    # the three terms of a cell from one reading of it
    terms = m.cube("Qty").select("Part", "Month", F.inline(F.array(term(0, F.lit(1e17)), term(1, F.col("v")), term(2, F.lit(-1e17)))))
    m.add_input("Terms", ["Part", "Month", "Flag"], terms, unique=False)
    m.add_formula("Rest", ["Part", "Month"], "Terms[REMOVE SUM: Flag]")
    return shown(m, m.cube("Rest"), None)


def scan_through_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursion through an aggregation: a seventh of the quarter's total before, for all flags, and the quarter's own."""
    m = base(spark, sf_dir)
    m.add_dimension("Quarter", [f"q{k}" for k in range(6)], ordered=True)
    quarters = m.cube("SalesFlag").where("Month < 18").select("Flag", F.floor(F.col("Month") / 3).cast("int").alias("Quarter"), "v").groupBy("Flag", "Quarter").agg(F.max("v").alias("v"))
    m.add_input("Peak", ["Flag", "Quarter"], quarters, unique=False)
    m.add_formula("Result", ["Flag", "Quarter"], "PREVIOUS(Quarter)[REMOVE SUM: Flag][EXPAND: Flag] / 7 + Peak")
    return shown(m, m.cube("Result"), 4)


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = base(spark, sf_dir)
        return shown(m, m.sql(text), 3)

    run.__doc__ = text
    return run


def rows_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of cells in display order."""
    m = base(spark, sf_dir)
    return shown(m, m.rows("SalesFlag", {"Flag": ["R", "A"]}, offset=20, limit=100)[0], 2)


def semi_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of a metric, aggregated."""
    m = base(spark, sf_dir)
    return shown(m, m.summarize("Sales", ["Month"], "sum", {"Month": CALENDAR[:24]}), 2)


def pivot_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several metrics by month; one lacks it."""
    m = base(spark, sf_dir)
    return shown(m, m.pivot(["SalesFlag", "BA", "AcctBal"], ["Month"]), 2).select("metric", "month", "value")


def fpa_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small plan: revenue, a scenario switch, shares, running totals and growth by brand."""
    m = base(spark, sf_dir)
    bm = ["Brand", "Month"]
    m.add_formula("IsActual", ["Month"], "Month <= Cutoff", "boolean")
    m.add_formula("Units", ["Part", "Month"], "IF(IsActual, Qty, QtyN * 1.1)")
    m.add_formula("Revenue", ["Part", "Month"], "Units * RetailPrice")
    m.add_formula("ByBrand", bm, "Revenue[BY SUM: Part.Brand]")
    m.add_formula("Total", ["Month"], "ByBrand[REMOVE SUM: Brand]")
    m.add_formula("Share", bm, "ByBrand / Total")
    m.add_formula("ToDate", bm, "PREVIOUS(Month) + ByBrand")
    m.keep("ByBrand")
    out = m.cube("ByBrand", "revenue").join(m.cube("Share", "share"), bm, "full_outer").join(m.cube("ToDate", "to_date"), bm, "full_outer")
    return shown(m, out, 2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _spec(name) for name in SPECS} | {
    "scan_mutual": scan_mutual, "coalesce_override": coalesce_override, "override_downstream": override_downstream, "spread_proportional": _spread("proportional"), "spread_even": _spread("even"), "write_bulk": write_bulk,
    "incremental": incremental, "exact_cancel": exact_cancel, "scan_through_sum": scan_through_sum, "sql_group_order_limit": _sql("SELECT Month, SUM(SalesFlag) AS s, AVG(SalesFlag) AS a FROM model WHERE Flag IN ('A', 'R') GROUP BY Month ORDER BY s DESC, Month LIMIT 20"),
    "sql_outer_join_aggs": _sql("SELECT Month, SUM(SalesFlag) AS s, MAX(BA) AS b, COUNT(QtyA) AS n FROM model GROUP BY Month"), "sql_no_group": _sql("SELECT SUM(SalesFlag) AS s, COUNT(BA) AS n, MIN(AcctBal) AS least FROM model"),
    "rows_page": rows_page, "topk": _sql("SELECT Part, SUM(Sales) AS s FROM model GROUP BY Part ORDER BY 2 DESC LIMIT 100"), "semi_range": semi_range, "pivot_query": pivot_query, "fpa_plan": fpa_plan,
}

_name = f"CAST({START} + month // 12 AS VARCHAR) || '-' || lpad(CAST(month % 12 + 1 AS VARCHAR), 2, '0')"
_year = "month BETWEEN 12 AND 23"
ORACLES: dict[str, str] = {name: s.sql if s.sql.startswith("WITH") else PRELUDE + s.sql for name, s in SPECS.items()} | {
    "scan_mutual": _fold(_sum("p1 * 0.9", "x"), 1),
    "coalesce_override": PRELUDE + "SELECT brand, month, round(v * 2, 4) AS v FROM ba WHERE month > 0 UNION ALL SELECT brand, 0, 7.0 FROM brands",
    "override_downstream": PRELUDE + "SELECT month, round(fsum(CASE WHEN flag = 0 AND month = 0 THEN 1.0 ELSE v END), 2) AS v FROM sf GROUP BY month",
    "spread_proportional": PRELUDE + f"SELECT flag, month, round(CASE WHEN {_year} THEN 1000 * v / (SELECT fsum(v) FROM sf WHERE {_year}) ELSE v END, 4) AS v FROM sf",
    "spread_even": PRELUDE + f"SELECT flag, month, round(CASE WHEN {_year} THEN 1000.0 / (SELECT count(*) FROM sf WHERE {_year}) ELSE v END, 4) AS v FROM sf",
    "write_bulk": PRELUDE + "SELECT brand, month, round(CASE WHEN month < 6 THEN v * 2 ELSE v END, 4) AS v FROM ba WHERE month < 6 OR month >= 12",
    "incremental": PRELUDE + """, plan AS (SELECT brand, month, CASE WHEN month = 3 THEN v * 10 ELSE v END AS v FROM ba WHERE month <> 40), rows_ AS (SELECT DISTINCT brand FROM plan)
SELECT 'Half' AS metric, brand, month, round(v * 0.5, 4) AS v FROM plan UNION ALL SELECT 'Total', NULL, month, round(fsum(v), 4) FROM plan GROUP BY month UNION ALL SELECT 'Late', brand, month + 12, round(v * 0.5, 4) FROM plan WHERE month + 12 < """ + str(MONTHS) + """
UNION ALL SELECT 'ToDate', brand, month, round(s, 4) FROM (SELECT brand, month, sum(v * 0.5) OVER (PARTITION BY brand ORDER BY month) AS s FROM rows_ CROSS JOIN months LEFT JOIN plan USING (brand, month)) WHERE s IS NOT NULL""",
    "exact_cancel": PRELUDE + "SELECT part, month, v FROM qty",
    "scan_through_sum": PRELUDE.replace("WITH li", "WITH RECURSIVE li", 1) + """, peak AS (SELECT flag, month // 3 AS quarter, max(v) AS v FROM sf WHERE month < 18 GROUP BY 1, 2), f AS (SELECT unnest([0, 1, 2]) AS flag), r(flag, quarter, v) AS (SELECT f.flag, 0, peak.v FROM f LEFT JOIN peak ON peak.flag = f.flag AND quarter = 0
UNION ALL SELECT f.flag, t.q, CASE WHEN t.s IS NULL THEN peak.v ELSE t.s / 7 + coalesce(peak.v, 0) END FROM (SELECT quarter + 1 AS q, sum(v) AS s FROM r WHERE quarter < 5 GROUP BY quarter) t CROSS JOIN f LEFT JOIN peak ON peak.flag = f.flag AND peak.quarter = t.q) SELECT flag, quarter, round(v, 4) AS v FROM r WHERE v IS NOT NULL""",
    "sql_group_order_limit": PRELUDE + f"SELECT {_name} AS month, round(s, 3) AS s, round(a, 3) AS a FROM (SELECT month, fsum(v) AS s, fsum(v) / count(*) AS a FROM sf WHERE flag IN (0, 2) GROUP BY month ORDER BY s DESC, month LIMIT 20)",
    "sql_outer_join_aggs": PRELUDE + f"SELECT {_name} AS month, round(s, 3) AS s, round(b, 3) AS b, coalesce(n, 0.0) AS n FROM (SELECT month, fsum(v) AS s FROM sf GROUP BY month) FULL JOIN (SELECT month, max(v) AS b FROM ba GROUP BY month) USING (month) FULL JOIN (SELECT month, CAST(count(*) AS DOUBLE) AS n FROM qa GROUP BY month) USING (month)",
    "sql_no_group": PRELUDE + "SELECT (SELECT round(fsum(v), 3) FROM sf) AS s, (SELECT CAST(count(*) AS DOUBLE) FROM ba) AS n, (SELECT round(min(s_acctbal), 3) FROM supplier) AS least",
    "rows_page": PRELUDE + f"SELECT CASE flag WHEN 0 THEN 'A' ELSE 'R' END AS flag, {_name} AS month, round(v, 2) AS v FROM (SELECT * FROM sf WHERE flag IN (0, 2) ORDER BY flag, month LIMIT 100 OFFSET 20)",
    "topk": PRELUDE + "SELECT CAST(part AS VARCHAR) AS part, round(s, 3) AS s FROM (SELECT part, fsum(v) AS s FROM sales GROUP BY part ORDER BY s DESC, part LIMIT 100)",
    "semi_range": PRELUDE + "SELECT month, round(fsum(v), 2) AS v FROM sales WHERE month < 24 GROUP BY month",
    "pivot_query": PRELUDE + "SELECT 'SalesFlag' AS metric, month, round(fsum(v), 2) AS value FROM sf GROUP BY month UNION ALL SELECT 'BA', month, round(fsum(v), 2) FROM ba GROUP BY month UNION ALL SELECT 'AcctBal', NULL, round(fsum(s_acctbal), 2) FROM supplier",
    "fpa_plan": PRELUDE + f""", units AS (SELECT part, month, v FROM qty WHERE month <= 41 UNION ALL SELECT part, month, v * 1.1 FROM qn WHERE month > 41),
bb AS (SELECT p_brand AS brand, month, fsum(v * p_retailprice) AS v FROM units JOIN part ON p_partkey = part GROUP BY 1, 2), tot AS (SELECT month, fsum(v) AS t FROM bb GROUP BY month), bbrows AS (SELECT DISTINCT brand FROM bb),
td AS (SELECT brand, month, sum(v) OVER (PARTITION BY brand ORDER BY month) AS to_date FROM bbrows CROSS JOIN months LEFT JOIN bb USING (brand, month))
SELECT brand, month, round(bb.v, 2) AS revenue, round(bb.v / t, 2) AS share, round(to_date, 2) AS to_date FROM (SELECT * FROM td WHERE to_date IS NOT NULL) LEFT JOIN bb USING (brand, month) LEFT JOIN tot USING (month)""",
}
