from tidemark import session as S


def test_written_tables(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    paths: list[str] = []
    t = S.materialize(df, "t", paths)
    assert t.count() == 10 and t.columns == df.columns
    assert paths[0].startswith(S.shared_dir(spark)) and spark.conf.get(S.CHECKPOINT_KEY)
    S.discard(spark, paths)
    assert paths == [] and S.materialize(df.limit(0), "empty").count() == 0
    S.discard(spark, [f"{S.shared_dir(spark)}/tidemark/none"])


def test_written_table_leaves_settings_alone(spark):
    from tidemark.session import SHUFFLE_CLEANUP_KEY, materialize

    before = spark.conf.get(SHUFFLE_CLEANUP_KEY)
    kept = []
    assert materialize(spark.range(100).repartition(3, "id"), "t", kept).count() == 100 and len(kept) == 1
    assert spark.conf.get(SHUFFLE_CLEANUP_KEY) == before


def test_shared_folder_must_be_set_off_local():
    from types import SimpleNamespace

    import pytest

    from tidemark.session import shared_dir

    unset = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: unset)))
