"""What the jobs hold on disk: shuffle files and stored tables go as soon as nothing needs them."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from rankloom import lineage
from rankloom.llm import line_dedup


def _shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getPath() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def _bytes(folder: str) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_cut_leaves_no_shuffle_files(spark):
    setting = lineage._TIDY_SETTING
    before, own = _shuffle_files(spark), spark.conf.get(setting)
    stored = lineage.cut(spark.range(1000).groupBy(F.expr("id % 7").alias("k")).count())
    for _ in range(50):  # they are removed after the write returns
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert _shuffle_files(spark) <= before and stored.count() == 7 and spark.conf.get(setting) == own
    lineage.drop(stored)
    with pytest.raises(Exception):
        stored.count()


def test_line_dedup_of_long_lines_keeps_one_small_table(spark):
    """Lines of 40 to 160 words in groups of near copies, some just beyond 4/5: equal to a look at all pairs, and only the removed lines are still stored."""
    rng = random.Random(11)
    docs = []
    for group in range(30):
        line = [f"g{group}w{i}" if i % 3 else f"w{rng.randint(0, 200)}" for i in range(rng.randint(40, 160))]
        for copy in range(4):
            near = list(line)
            for at in rng.sample(range(len(near)), rng.randint(0, len(near) // 7)):
                near[at] = f"x{rng.randint(0, 10**6)}"
            docs.append((4 * group + copy, " ".join(near)))
    want, seen = {}, []
    for d, text in docs:
        s = frozenset(text.split())
        want[d] = "" if any(5 * len(s & o) >= 4 * len(s | o) for o in seen) else text
        seen.append(s)
    assert 10 < sum(not x for x in want.values()) < 110
    folder = lineage.run_folder(spark)
    before = _bytes(folder)
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert _bytes(folder) - before < 20_000
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
