from pathlib import Path
from types import SimpleNamespace

import pytest

from rankloom import lineage


def session(setting, master):
    conf = SimpleNamespace(get=lambda key, default=None: setting if key == "spark.checkpoint.dir" and setting else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_named_folder_wins():
    assert lineage.checkpoint_root(session("hdfs://x/ckpt", "spark://h")) == "hdfs://x/ckpt"


def test_own_folder_only_in_local_mode():
    own = lineage.checkpoint_root(session(None, "local[2]"))
    assert own and own == lineage.checkpoint_root(session(None, "local[4]"))
    with pytest.raises(RuntimeError):
        lineage.checkpoint_root(session(None, "yarn"))


def test_cut_keeps_rows_and_schema(spark):
    df = spark.range(5).selectExpr("id", "struct(id as a, cast(id as string) as b) as s")
    kept = lineage.cut(df)
    assert kept.schema.simpleString() == df.schema.simpleString() and kept.count() == 5 and kept.inputFiles()


def test_clean_removes_the_run_folder(spark, monkeypatch):
    monkeypatch.setattr(lineage, "_run_name", lambda application: "own-run")
    kept = lineage.cut(spark.range(3))
    folder = Path(lineage.run_folder(spark))
    assert kept.count() == 3 and list(folder.iterdir())
    lineage.clean(spark)
    assert not folder.exists()
