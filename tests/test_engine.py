"""Statements end to end: definitions, changes, queries, errors."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from tessel.cli import answer, started
from tessel.plans import Engine
from tessel.plans.engine import split_top, to_spark, tokens
from tessel.streaming import insert_stream
from tessel.sources import TableExists, TableMissing, format_table, read_config


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "tables"))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_cycle(engine):
    assert engine.execute("CREATE TABLE sales (id INT NOT NULL, category VARCHAR(10), amount DOUBLE);").message == "CREATE TABLE"
    with pytest.raises(TableExists):
        engine.execute("CREATE TABLE Sales (id INT)")
    for i, (c, a) in enumerate([("A", 10.5), ("B", 20.0), ("A", 15.5), ("B", 25.0), ("A", 5.0)], 1):
        assert engine.execute(f"INSERT INTO sales VALUES ({i}, '{c}', {a})").affected_rows == 1
    total = "SELECT count(*) AS n, sum(amount) AS s, avg(amount) AS a, min(amount) AS lo, max(amount) AS hi FROM sales"
    assert rows(engine.execute(total)) == [(5, 76.0, 15.2, 5.0, 25.0)]
    by = "SELECT category, sum(amount) AS s, count(*) AS n FROM sales GROUP BY category HAVING count(*) > 1 ORDER BY category"
    assert rows(engine.execute(by)) == [("A", 31.0, 3), ("B", 45.0, 2)]
    assert engine.execute("UPDATE sales SET amount = amount + 1, category = 'C' WHERE id < 3").affected_rows == 2
    assert rows(engine.execute("SELECT id, category, amount FROM sales WHERE category = 'C' ORDER BY id")) == [(1, "C", 11.5), (2, "C", 21.0)]
    assert engine.execute("DELETE FROM sales WHERE amount > 20").affected_rows == 2
    assert rows(engine.execute("SELECT id FROM sales ORDER BY id")) == [(1,), (3,), (5,)]
    assert engine.warehouse.tables() == ["sales"] and "sales" in engine.tables()
    engine.execute("DROP TABLE sales")
    with pytest.raises(TableMissing):
        engine.execute("DROP TABLE sales")
    assert engine.execute("DROP TABLE IF EXISTS sales").message == "no such table"


def test_insert_honours_columns_and_constraints(engine):
    engine.execute("CREATE TABLE t (id INT NOT NULL, name TEXT, ok BOOL)")
    engine.execute("INSERT INTO t (name, id) VALUES ('x', -5)")
    assert rows(engine.execute("SELECT * FROM t")) == [(-5, "x", None)]
    with pytest.raises(Exception, match="must not be null"):
        engine.execute("INSERT INTO t VALUES (NULL, 'y', true)")
    with pytest.raises(ValueError, match="2 values for 3"):
        engine.execute("INSERT INTO t VALUES (1, 'y')")
    with pytest.raises(Exception, match="must not be null"):
        engine.execute("UPDATE t SET id = NULL")
    assert rows(engine.execute("SELECT id FROM t")) == [(-5,)]


def test_null_predicates_change_nothing(engine):
    engine.execute("CREATE TABLE t (k INT, v INT)")
    engine.execute("INSERT INTO t VALUES (1, NULL), (2, 3)")
    assert engine.execute("UPDATE t SET v = v + k WHERE v > 1").affected_rows == 1
    assert engine.execute("DELETE FROM t WHERE v < 100").affected_rows == 1
    assert rows(engine.execute("SELECT * FROM t")) == [(1, None)]


def test_tables_outlive_an_engine(engine, spark):
    engine.execute("CREATE TABLE kept (id INT, data VARCHAR)")
    engine.execute("INSERT INTO kept VALUES " + ", ".join(f"({i}, 'data_{i}')" for i in range(50)))
    again = Engine(spark, engine.warehouse.root)
    assert rows(again.execute("SELECT count(*), max(data) FROM kept")) == [(50, "data_9")]


def test_nulls_sort_greatest(engine):
    base = "SELECT * FROM VALUES (1, 2), (2, NULL), (3, 1) AS t(k, v)"
    assert [r[0] for r in rows(engine.query(base + " ORDER BY v"))] == [3, 1, 2]
    assert [r[0] for r in rows(engine.query(base + " ORDER BY v DESC"))] == [2, 1, 3]
    assert [r[0] for r in rows(engine.query(base + " ORDER BY v NULLS FIRST LIMIT 1"))] == [2]


def test_three_valued_logic(engine):
    values = ["true", "false", "CAST(NULL AS BOOLEAN)"]
    table = ", ".join(f"({a}, {b})" for a in values for b in values)
    for a, b, both, some, no in rows(engine.query(f"SELECT a, b, a AND b, a OR b, NOT a FROM VALUES {table} AS t(a, b)")):
        assert both is (False if False in (a, b) else None if None in (a, b) else True)
        assert some is (True if True in (a, b) else None if None in (a, b) else False)
        assert no is (None if a is None else not a)


@pytest.mark.parametrize(
    ("expression", "value"),
    [
        ("CASE WHEN 85 >= 90 THEN 'A' WHEN 85 >= 80 THEN 'B' ELSE 'C' END", "B"), ("2 IN (1, 2, 3)", True), ("5 NOT IN (1, 2, 3)", True), ("1 NOT IN (2, NULL)", None),
        ("50 BETWEEN 10 AND 100", True), ("5 NOT BETWEEN 10 AND 100", True), ("'Alice' LIKE 'A%'", True), ("'Bob' LIKE '_ob'", True), ("'Bob' NOT LIKE 'A%'", True),
        ("coalesce(NULL, NULL, 42)", 42), ("nullif(10, 10)", None), ("nullif(10, 20)", 10), ("length('hello')", 5), ("'a' || 'b'", "ab"), ("7 % 4", 3),
        ("mod(7, 0)", None), ("7 / 2", 3.5), ("7 / 0", None), ("7 % 0", None), ("8 / 2 / 2 + 1", 3.0), ("2 * (3 + 4) / -7", -2.0), ("CAST(7 AS INT) / CAST(2 AS INT)", 3.0), ("CASE WHEN 4 / 2 > 1 THEN 6 / 4 END / 3", 0.5), ("'a/b' || '%'", "a/b%"), ("mod(7, 1)", 0), ("trim('\t x ')", "x"), ("substring('hello', 2, 3)", "ell"), ("substring('hello', 0, 3)", None), ("round(2.5)", 3.0), ("upper('a')", "A"),
    ],
)
def test_expressions(engine, expression, value):
    assert rows(engine.query(f"SELECT {expression} AS v # a comment")) == [(value,)]


def test_rewriting_leaves_strings_alone():
    assert to_spark("SELECT 'ORDER BY x # trim(a)' AS s -- gone\n") == "SELECT 'ORDER BY x # trim(a)' AS s"
    assert to_spark("SELECT rank() OVER (ORDER BY a DESC, b) FROM t") == "SELECT rank() OVER (ORDER BY a DESC NULLS FIRST, b NULLS LAST ) FROM t"
    assert ["".join(p) for p in split_top(tokens("a,f(b,c),d"))] == ["a", "f(b,c)", "d"]


def test_quotients_in_statements(engine):
    engine.execute("CREATE TABLE q (a INT, b INT, x DOUBLE)")
    engine.execute("INSERT INTO q VALUES (7, 2, 7), (-7, 2, 1), (5, 0, 2)")
    assert rows(engine.query("SELECT q.a / q.b, x/b, a*1, count(*) OVER () FROM q ORDER BY a")) == [(-3.0, 0.5, -7, 3), (None, None, 5, 3), (3.0, 3.5, 7, 3)]
    assert rows(engine.query("SELECT sum(x) / count(*) AS m, sum(a) / 0 AS z FROM q")) == [(10 / 3, None)]
    assert engine.execute("UPDATE q SET x = a / b WHERE x / b > 1").affected_rows == 1
    assert rows(engine.query("SELECT * FROM q ORDER BY a LIMIT 1 OFFSET 2")) == [(7, 2, 3.0)]


@pytest.mark.parametrize(
    ("expression", "value"),
    [
        ('"a/b # c"', "a/b # c"), (r"'a\b' || 'c\n'", r"a\bc\n"), (r"'x\y' LIKE '%\y'", True), (r"'50%' LIKE '50\%'", False), ("'50%' LIKE '50!%' ESCAPE '!'", True), ("'a/b' LIKE '%' || '/' || 'b' AND true", True), (r"'ab\' NOT LIKE concat('a', '_\')", False), ("trim(both 'x' from 'xax')", "a"),
        ("concat('a', NULL, 1, true)", "a1true"), ("concat(CAST(NULL AS STRING), NULL)", None), ("concat('', NULL)", ""), ("7::int / 2::int", 3.0), ("array(9, 4)[0] / abs(2)", 4.0),
        ("sum(5) OVER (PARTITION BY 1) / 2", 2.5), ("count (*) / 4", 0.25), ("aggregate(transform(array(8, 6), x -> x / 2), 0D, (s, x) -> s + x)", 7.0), ("CAST(7 AS INT) / CAST(2 AS INT) / CAST(2 AS INT)", 1.5),
        ("(CAST(7 AS INT) / CAST(2 AS INT) + 1) / 8", 0.5), ("rand(3) / rand(3) IS NULL", False), ("8 / -2", -4.0), ("1e3 / 4", 250.0), ("substring('hello' from 2 for 2)", "el"),
    ],
)
def test_rewritten_expressions(engine, expression, value):
    assert rows(engine.query(f"SELECT {expression} AS v")) == [(value,)]


def test_quotients_are_written_once():
    short, long = (len(to_spark("SELECT " + " / ".join(f"abs(c{i})" for i in range(n)))) for n in (2, 12))
    assert long < 5 * short
    assert to_spark("SELECT rand() / c FROM t").count("rand()") == 1


def test_writers_lose_nothing(engine, spark):
    engine.execute("CREATE TABLE t (k INT, v INT)")
    engine.execute("INSERT INTO t SELECT CAST(id AS INT), 0 FROM range(20)")
    before = engine.query("SELECT count(*) AS n, sum(v) AS s FROM t")
    other = Engine(spark, engine.warehouse.root)
    works = [lambda i=i: (engine, other)[i % 2].warehouse.insert("t", spark.range(1).selectExpr(f"cast({100 + i} as int) k", "0 v")) for i in range(4)]
    works += [lambda i=i: (engine, other)[i % 2].warehouse.update("t", {"v": "v + 1"}, "k < 20") for i in range(4)]
    with ThreadPoolExecutor(8) as pool:
        done = [f.result() for f in [pool.submit(w) for w in works]]
    assert done == [1] * 4 + [20] * 4
    assert rows(engine.query("SELECT count(*), sum(v) FROM t")) == [(24, 80)]
    assert rows(before) == [(20, 0)]  # a version that was read before stays readable
    assert engine.warehouse.vacuum("t", 0) > 0 and rows(engine.query("SELECT count(*), sum(v) FROM t")) == [(24, 80)]


def test_changes_rewrite_only_files_with_rows_met(engine, spark):
    engine.execute("CREATE TABLE t (k INT)")
    for i in range(3):
        engine.warehouse.insert("t", spark.range(5).selectExpr(f"cast(id + {10 * i} as int) k").coalesce(1))
    files = set(engine.warehouse._manifest("t")["files"])
    assert engine.execute("DELETE FROM t WHERE k = 12").affected_rows == 1
    assert len(files & set(engine.warehouse._manifest("t")["files"])) == len(files) - 1
    assert engine.execute("UPDATE t SET k = 0 WHERE k > 1000").affected_rows == 0
    assert engine.warehouse.compact("t") and len(engine.warehouse._manifest("t")["files"]) == 1
    assert rows(engine.query("SELECT count(*), sum(k) FROM t")) == [(14, 30 + 150 - 12)]


def test_streams_are_inserted_once(engine, spark, tmp_path):
    engine.execute("CREATE TABLE t (id BIGINT NOT NULL, v DOUBLE)")
    source = str(tmp_path / "source")
    for i in range(2):
        spark.range(10 * i, 10 * i + 10).selectExpr("id", "id / 2 AS v").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, v double").parquet(source)
        insert_stream(stream, engine.warehouse, "t", str(tmp_path / "checkpoint")).awaitTermination()
        assert rows(engine.query("SELECT count(*), sum(id) FROM t")) == [(10 * i + 10, sum(range(10 * i + 10)))]
    again = spark.range(5).selectExpr("id", "0D AS v")
    assert engine.warehouse.insert("t", again, ("stream", 3)) == 5
    assert engine.warehouse.insert("t", again, ("stream", 3)) == engine.warehouse.insert("t", again, ("stream", 2)) == 0
    assert engine.warehouse.insert("t", again, ("stream", 4)) == 5 and rows(engine.query("SELECT count(*) FROM t")) == [(30,)]


def test_prompt_uses_its_configuration(spark, tmp_path):
    conf = tmp_path / "my.conf"
    conf.write_text(f"data_directory = {tmp_path}/kept\nspark.sql.session.timeZone = UTC\nbuffer_pool_size = 9\n")
    engine = started(["--config", str(conf)])
    assert engine.warehouse.root == f"{tmp_path}/kept" and started([str(tmp_path / "x"), "--config", str(conf)]).warehouse.root == f"{tmp_path}/x"
    assert "(1500 rows)" in answer(engine, "SELECT * FROM range(1500)")


def test_errors(engine):
    for bad in ("CREATE TABLE t (a SMALLINT)", "CREATE TABLE t", "SELECT nothing FROM nowhere", "DROP INDEX x"):
        with pytest.raises(Exception):  # noqa: B017
            engine.execute(bad)
    with pytest.raises(ValueError, match="unknown columns"):
        engine.execute("CREATE TABLE t (a INT)")
        engine.execute("UPDATE t SET b = 1")


def test_prompt(engine):
    assert answer(engine, "\\q") is None
    assert answer(engine, "\\dt") == "no tables" or "t" in answer(engine, "\\dt")
    assert answer(engine, "CREATE TABLE p (a INT)") == "CREATE TABLE"
    assert answer(engine, "INSERT INTO p VALUES (7)") == "INSERT 1"
    assert "7" in answer(engine, "SELECT a FROM p") and "(1 row)" in answer(engine, "SELECT a FROM p")
    assert answer(engine, "SELECT b FROM p").startswith("ERROR")


def test_display(spark):
    df = spark.createDataFrame([(1, "ab"), (None, None)], "n int, s string")
    assert format_table(df) == "+------+------+\n| n    | s    |\n+------+------+\n| 1    | ab   |\n| NULL | NULL |\n+------+------+\n(2 rows)"
    assert format_table(df.where("false")).endswith("(0 rows)")
    assert format_table(spark.range(9), 4).endswith("(first 4 of 9 rows)")


def test_config(tmp_path):
    path = tmp_path / "x.conf"
    path.write_text("# head\na = 1\n b=two # tail\n\na = 3\n")
    assert read_config(str(path)) == {"a": "3", "b": "two"}
    path.write_text("nothing\n")
    with pytest.raises(ValueError, match="key = value"):
        read_config(str(path))
