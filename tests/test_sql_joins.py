"""Joins on spatial predicates in SQL text against the same SQL as Spark runs it by itself."""

import pytest
from pyspark.sql import functions as F

from mapframe.errors import BadRequest
from mapframe.functions import spatial
from mapframe.operators import joins, sqltext

FORMS = [
    "SELECT p.id, b.id AS box FROM sp p JOIN sb b ON ST_Intersects(p.geometry, b.geometry)",
    "SELECT p.id, b.id AS box FROM sp p JOIN sb b ON ST_Intersects(b.geometry, p.geometry) AND p.id % 2 = 0 AND p.id > b.id",
    "SELECT p.id, b.id AS box FROM sp p, sb b WHERE ST_Within(p.geometry, b.geometry) AND b.kind = 'a'",
    "SELECT b.id, p.id AS pid FROM sb b JOIN sp p ON ST_Within(p.geometry, b.geometry)",
    "SELECT p.id, q.id AS near FROM sp p JOIN sp q ON ST_Distance(p.geometry, q.geometry) <= 0.75 AND p.id < q.id",
    "SELECT p.id, q.id AS near FROM sp p, sp q WHERE 3 * 0.25 >= ST_Distance(p.geometry, q.geometry)",
    "SELECT b.kind, count(*) AS n FROM sp p JOIN sb b ON ST_Intersects(p.geometry, ST_Buffer(b.geometry, 0.2)) GROUP BY b.kind",
    "SELECT p.id, b.id AS one, c.id AS two FROM sp p JOIN sb b ON ST_Within(p.geometry, b.geometry) JOIN sb c ON c.kind = b.kind "
    "AND ST_Intersects(b.geometry, c.geometry) WHERE p.id < 40",
    "SELECT a.id, b.id AS other, p.id AS pid FROM sb a, sb b, sp p WHERE ST_Intersects(a.geometry, b.geometry) "
    "AND ST_Within(p.geometry, b.geometry) AND a.id <= 10",
    "WITH t AS (SELECT * FROM sb WHERE id < 20) SELECT t.id, u.id AS other FROM t JOIN t u ON ST_Intersects(t.geometry, u.geometry)",
    "SELECT n, count(*) AS k FROM (SELECT p.id, count(*) AS n FROM sp p JOIN sb b ON ST_Intersects(p.geometry, b.geometry) "
    "GROUP BY p.id) GROUP BY n",
    "SELECT p.id, b.id AS box FROM sp p LEFT JOIN sb b ON ST_Within(p.geometry, b.geometry) WHERE p.id < 60",
    "SELECT p.id, b.id AS box FROM sb b RIGHT JOIN sp p ON ST_Intersects(p.geometry, b.geometry)",
    "SELECT ST_Area(geometry) AS area, id FROM sb WHERE ST_Intersects(geometry, ST_Point(5, 5))",
]


@pytest.fixture(scope="module")
def views(spark):
    x, y = (F.col("id") * 37 % 200) / 10, (F.col("id") * 91 % 170) / 10
    spark.range(150).select("id", F.when(F.col("id") % 10 != 3, spatial.st_point(x, y)).alias("geometry")) \
        .createOrReplaceTempView("sp")
    spark.range(40).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"),
                           spatial.st_makeenvelope(x, y, x + 1 + F.col("id") % 3, y + 1.5).alias("geometry")) \
        .createOrReplaceTempView("sb")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sql", FORMS)
def test_same_rows_as_the_cross_join(spark, views, sql):
    found = sqltext.query(spark, sql)
    assert found.columns == spark.sql(sql).columns
    # Spark refuses a Python predicate in ON of an outer join, so that form is said with plain numbers
    plain = sql
    if " LEFT JOIN " in sql or " RIGHT JOIN " in sql:
        on = "b.id IS NOT NULL AND ST_" + ("Within" if "Within" in sql else "Intersects") + "(p.geometry, b.geometry)"
        hits = f"SELECT p.id, b.id AS box FROM sp p CROSS JOIN sb b WHERE {on}"
        some = "WHERE id < 60" if "60" in sql else ""
        plain = f"SELECT p.id, h.box FROM (SELECT * FROM sp {some}) p LEFT JOIN ({hits}) h ON p.id = h.id"
    assert rows(found) == rows(spark.sql(plain))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("sql", [
    "SELECT 1 FROM sp p JOIN sb b ON ST_Intersects(p.geometry, b.geometry) OR p.id = 1",
    "SELECT 1 FROM sp p, sb b WHERE ST_Area(ST_Difference(b.geometry, p.geometry)) > 1",
    "SELECT 1 FROM sp p LEFT JOIN sb b ON ST_Intersects(p.geometry, b.geometry) AND p.id > 3",
    "SELECT 1 FROM sp p FULL JOIN sb b ON ST_Intersects(p.geometry, b.geometry)",
    "SELECT 1 FROM sp p JOIN sb b ON ST_Distance(p.geometry, b.geometry) <= p.id",
])
def test_unsupported_forms_raise(spark, views, sql):
    with pytest.raises(BadRequest):
        sqltext.query(spark, sql)


def test_other_joins_stay(spark, views):
    found = sqltext.query(spark, "SELECT p.id, m.top FROM sp p CROSS JOIN (SELECT max(id) AS top FROM sb) m WHERE p.id = m.top")
    assert rows(found) == [(39, 39)]
    keyed = sqltext.query(spark, "SELECT count(*) FROM sp p JOIN sb b ON p.id = b.id AND ST_Distance(p.geometry, b.geometry) >= 0")
    assert keyed.head()[0] == 36


def test_shuffled(spark, views, monkeypatch):
    """With nothing broadcast, and cells cut into blocks of a few rows."""
    monkeypatch.setattr(joins.spatial_join, "__defaults__", (*joins.spatial_join.__defaults__[:-1], 0))
    monkeypatch.setattr(joins, "CROWD", 3)
    assert rows(sqltext.query(spark, FORMS[0])) == rows(spark.sql(FORMS[0]))
