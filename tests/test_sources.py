"""Parquet, saved models, change logs, followers, Arrow and CSV."""

import pyarrow as pa
import pytest

from gridloom.plans.model import Model
from gridloom.sources.store import ChangeLog, arrow_stream, load, read_cells, read_csv, save, to_arrow, write_cells
from gridloom.streaming.follower import Follower


@pytest.fixture
def model(spark):
    m = Model(spark)
    m.add_dimension("Product", ["A", "B", "C"])
    m.add_dimension("Month", ["Jan", "Feb"], ordered=True)
    m.add_dimension("Line", ["x", "y"])
    m.add_property("Product", "Line", "Line", {"A": "x", "B": "x", "C": "y"})
    m.add_input("V", ["Product", "Month"], {("A", "Jan"): 1, ("B", "Jan"): 2, ("C", "Feb"): 3})
    m.add_formula("L", ["Line", "Month"], "V[BY SUM: Product.Line]", overridable=True)
    return m


def test_save_and_load(spark, model, tmp_path):
    model.set_cell("L", 9, Line="y", Month="Jan")
    save(model, f"file://{tmp_path}/m")
    again = load(spark, f"file://{tmp_path}/m")
    assert again.value("L") == model.value("L") == {("x", "Jan"): 3, ("y", "Feb"): 3, ("y", "Jan"): 9}
    again.add_formula("T", [], "L[REMOVE SUM: Line, Month]")
    assert again.value("T") == {(): 15}


def test_parquet(spark, model, tmp_path):
    write_cells(model, "V", f"file://{tmp_path}/v", partition="Month")
    read_cells(model, "W", ["Product", "Month"], f"file://{tmp_path}/v")
    assert model.value("W") == model.value("V")
    spark.createDataFrame([(7, 0, 1.0)], "Product int, Month int, v double").write.parquet(f"file://{tmp_path}/bad")
    with pytest.raises(ValueError):
        read_cells(model, "Bad", ["Product", "Month"], f"file://{tmp_path}/bad")


def test_duplicate_keys(spark, model):
    with pytest.raises(ValueError):
        model.add_input("D", ["Product"], spark.createDataFrame([(0, 1.0), (0, 2.0)], "Product int, v double"))


def test_arrow_and_csv(spark, model, tmp_path):
    table = to_arrow(model, "V")
    assert pa.types.is_dictionary(table.schema.field("Product").type) and table.num_rows == 3
    assert pa.ipc.open_stream(arrow_stream(table)).read_all().equals(table)
    (tmp_path / "v.csv").write_text("Product,Month,v\nA,Feb,5\nB,Jan,2.5\n")
    read_csv(model, "C", ["Product", "Month"], f"file://{tmp_path}/v.csv")
    assert model.value("C") == {("A", "Feb"): 5, ("B", "Jan"): 2.5}


def test_change_log_and_follower(spark, model, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    start = model.fork()
    with model.transaction(user="u", journal=log) as t:
        t.set_cell("V", 10, Product="A", Month="Jan")
    with model.transaction(user="w", journal=log, client_op_id="k") as t:
        t.set_cell("V", 20, Product="A", Month="Jan")
        t.add_member("Product", "D", properties={"Line": "y"})
        t.set_cell("V", 4, Product="D", Month="Feb")
    copy = log.replay(start.fork())
    assert copy.value("L") == model.value("L") == {("x", "Jan"): 22, ("y", "Feb"): 7}
    assert copy.version == 2 and "k" in copy.outcomes
    assert [(r["user"], r["old"], r["new"]) for r in log.history("V", ["A", "Jan"]).orderBy("version").collect()] == [("u", "1.0", "10"), ("w", "10.0", "20")]
    f = Follower(start, log)
    f.start(f"file://{tmp_path}/ck", once=True).awaitTermination(60)
    assert f.model.value("L") == model.value("L")
    with model.transaction(journal=log) as t:
        t.set_cell("V", None, Product="D", Month="Feb")
    f.start(f"file://{tmp_path}/ck", once=True).awaitTermination(60)
    assert f.model.version == 3 and f.model.value("L") == {("x", "Jan"): 22, ("y", "Feb"): 3}


def test_log_replays_everything(spark, tmp_path):
    """A log alone gives the model again: definitions over tables, bulk writes, spreads, members, formulas as trees."""
    from pyspark.sql import functions as F

    log, m = ChangeLog(spark, f"file://{tmp_path}/log"), Model(spark)
    with log.grouped():
        with m.transaction(user="a", journal=log) as t:
            t.add_dimension("Item", spark.range(40).select(F.col("id").cast("int").alias("k")))
            t.add_dimension("Kind", ["x", "y"])
            t.add_dimension("Day", ["d1", "d2", "d3"], ordered=True)
            t.add_property("Item", "Kind", "Kind", spark.range(40).selectExpr("cast(id as int) src", "cast(id % 2 as int) dst"))
            t.add_input("Sold", ["Item", "Day"], spark.range(80).selectExpr("cast(id % 40 as int) Item", "cast(id / 40 as int) Day", "cast(id as double) v"))
            t.add_formula("ByKind", ["Kind", "Day"], "Sold[BY SUM: Item.Kind]")
        with m.transaction(user="b", journal=log) as t:
            t.write_many("Sold", spark.createDataFrame([(3, 0, 100.0), (4, 0, None), (5, 2, 7.0)], "Item int, Day int, v double"))
        with m.transaction(user="c", journal=log) as t:
            t.spread("Sold", 900.0, {"Day": "d2"})
    assert log.records().count() == 3
    log.snapshot(m)
    with m.transaction(user="d", journal=log) as t:
        t.set_cell("Sold", 5, Item=3, Day="d1")
        t.add_input("Pick", ["Day"], {("d1",): "y", ("d3",): "x"}, kind="member:Kind")
        t.add_member("Kind", "z")
    for again in (log.replay(Model(spark)), log.restore(), log.restore(Model(spark))):
        assert again.version == 4
        for name in ("Sold", "ByKind", "Pick"):
            assert again.value(name) == m.value(name)
    old = log.restore(upto=3)
    assert old.version == 3 and old.get("Sold", Item=3, Day="d1") == 100 and "Pick" not in old.metric_ids
    assert [(r["user"], float(r["old"] or "nan"), float(r["new"])) for r in log.history("Sold", ["3", "d1"], m).orderBy("version").collect()] == [("b", 3.0, 100.0), ("d", 100.0, 5.0)]
    assert [(r["user"], float(r["old"])) for r in log.history("Sold", ["6", "d2"], m).collect()] == [("c", 46.0)]
    f = Follower(Model(spark), log)
    f.start(f"file://{tmp_path}/ck", once=True).awaitTermination(60)
    assert f.model.version == 4 and f.model.value("ByKind") == m.value("ByKind")


def test_sql_results(spark, model):
    from gridloom.errors import FormulaError
    from gridloom.plans import sqlread

    t = sqlread.to_arrow(model, "SELECT Month, SUM(V), AVG(V), MAX(V), COUNT(V) FROM model GROUP BY Month ORDER BY 1 DESC")
    assert t.column("Month").chunk(0).dictionary.to_pylist() == ["Jan", "Feb"] and t.to_pylist()[1] == {"Month": "Jan", "sum(V)": 3, "avg(V)": 1.5, "max(V)": 2, "count(V)": 2}
    assert sqlread.to_json(model.sql("SELECT SUM(V) AS s FROM model")) == {"columns": ["s"], "rows": [[6.0]]}
    for call in (lambda: sqlread.to_arrow(model, "SELECT Product, SUM(V) FROM model GROUP BY Product", 5), lambda: sqlread.to_json(model.sql("SELECT Product, SUM(V) FROM model GROUP BY Product"), 5), lambda: model.sql("SELECT Product, SUM(V) FROM model GROUP BY Product", 5)):
        with pytest.raises(FormulaError) as e:
            call()
        assert e.value.code == "sql_too_large"
