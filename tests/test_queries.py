"""Every query with SQL against DuckDB on the smallest tables; windows, plans and the command line."""

import glob
import math
import os

import duckdb
import pytest

from patternlens import cli, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    r = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in r.description]
    want = r.fetchall()
    assert sorted(df.columns) == sorted(names)
    got = [tuple(row[c] for c in names) for row in df.collect()]
    assert sorted(map(repr, map(plain, got))) == sorted(map(repr, map(plain, want)))


def test_plans(spark):
    plan = queries.q01_template_counts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") <= 1
    plan = queries.q02_where_text(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan and "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan


def test_stream(spark, tmp_path):
    from patternlens.streaming.templates import template_counts

    rows = spark.sql("select timestamp'2024-01-01 10:00:00' + make_interval(0,0,0,0,0,id,0) as ts, concat('user ', id) as line from range(90)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = template_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.pattern, r.n) for r in spark.table("counts").collect()) == [("user <NUM>", 30), ("user <NUM>", 60)]


def test_command_line(spark, tmp_path, capsys):
    f = tmp_path / "app.log"
    f.write_text("a 1\na 2\n")
    assert cli.main(["patterns", str(f)], spark) == 0 and "a <NUM>" in capsys.readouterr().out
    assert cli.main(["--discover", str(f), "-o", str(tmp_path / "out.md")], spark) == 0 and "slot[1]" in (tmp_path / "out.md").read_text()
    assert cli.main(["--cost-preview", str(f)], spark) == 0 and cli.main([str(tmp_path / "none.log")], spark) == 1 and cli.main(["patterns"], spark) == 1
