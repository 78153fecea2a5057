import glob
import time

import pytest
from pyspark.sql import functions as F

from kinweave.session import FREE_SHUFFLES, _own_folder, materialise, materialise_dealt, spread


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _own_folder(master)


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4]"])
def test_a_local_session_has_its_own(master):
    assert _own_folder(master)


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {path for folder in blocks.localDirs() for path in glob.glob(f"{folder}/*/shuffle_*.data")}


@pytest.mark.parametrize("keep", [materialise, materialise_dealt])
def test_a_checkpoint_leaves_no_shuffle_files(spark, keep):
    before = shuffle_files(spark)
    df = spread(spark.range(10_000).withColumn("k", F.col("id") % 100), "k").groupBy("k").count()
    kept = keep(df)
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert sorted(map(tuple, kept.collect())) == [(k, 100) for k in range(100)]
    assert spark.conf.get(FREE_SHUFFLES) == "false" and spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_dealt_rows_are_joined_in_place(spark):
    dealt = materialise_dealt(spread(spark.range(100).toDF("end"), "end").groupBy("end").count())
    asked = spark.range(50).select((F.col("id") * 2).alias("end")).join(dealt.hint("shuffle_hash"), "end")
    assert asked._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert asked.count() == 50
