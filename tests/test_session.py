import os
from types import SimpleNamespace

import pytest

from dissimap import session


def test_clean_removes_the_tables_of_cut(spark):
    kept = session.cut(spark.range(3))
    path = kept._cut_path
    assert kept.count() == 3 and path in session._made[spark.sparkContext.applicationId]
    session.drop(session.cut(spark.range(2), None))
    assert session.clean(spark) >= 1 and session.clean(spark) == 0
    assert not os.path.exists(path.replace("file:", "", 1).replace("//", "/"))


def test_a_cluster_without_a_shared_folder_raises():
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError):
        session.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=context))
    assert session.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: "s3://x/"))) == "s3://x"


def test_statements_are_logged(spark, caplog):
    with caplog.at_level("DEBUG", logger="dissimap.session"):
        assert session.sql(spark, "SELECT :k + 1 AS n", args={"k": 2}).first().n == 3
    assert "SELECT :k + 1 AS n" in caplog.text and "Physical Plan" in caplog.text


def test_tables_of_a_database(spark, tmp_path):
    from dissimap.sources.matrix_csv import read_jdbc

    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.createDataFrame([(1, 2.5), (2, None)], "id bigint, v double").write.format("jdbc").options(url=url, dbtable="t", driver=driver).save()
    assert sorted(map(str, read_jdbc(spark, url, "t", driver=driver).toDF("id", "v").collect())) == ["Row(id=1, v=2.5)", "Row(id=2, v=None)"]
