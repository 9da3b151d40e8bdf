"""The corpus pipeline, stage by stage."""

import corpus_pipeline
import pytest
from compare import DATA
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    """Clean texts, a copy, a near copy, rejects, a secret, nulls, extra columns."""
    import random

    rng = random.Random(4)
    line = lambda: " ".join(rng.choice(["river", "stone", "light", "walks", "under", "green", "hill", "a", "the", "of", "quiet", "door"]) + rng.choice(["", "", "s"]) for _ in range(14)).capitalize() + "."
    clean = ["\n".join(line() for _ in range(12)) for _ in range(5)]
    rows = [(k, t) for k, t in enumerate(clean)]
    rows += [(10, clean[0]), (11, clean[1].replace("walks", "walked", 1)), (12, " | ".join(["menu"] * 200)), (13, None), (14, ""), (15, clean[2] + "\nMy password = \"hunter2hunter2hunter2\" is here now and stays in this text for good."), (0, clean[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), "count": F.lit(1), "id": F.lit("x")})
    return df.unionByName(df.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))


def test_stages(spark, docs):
    out, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = spark.createDataFrame(out.collect(), out.schema)
        out = stage(spark, out, DATA)
        seen[name] = out.toPandas()
        if name != "best_fit_packing":
            assert out.columns == docs.columns
    ids = lambda name: set(seen[name].doc_id.dropna().astype(int))
    assert ids("quality_rules") == {0, 1, 2, 3, 4, 10, 11, 15}
    assert ids("quality_classifier") >= {0, 1, 2, 3, 4}
    assert ids("near_dedup") & {0, 10} == {0} and ids("near_dedup") & {1, 11} == {1}
    assert (seen["near_dedup"].doc_id == 0).sum() == 1
    assert not seen["secret_scan"].text.str.contains("hunter2").any()
    assert (seen["secret_scan"].n_chars == seen["secret_scan"].text.str.len()).all()
    assert ids("best_fit_packing") == ids("secret_scan")


def test_empty_input(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_run_on_the_smallest_tables(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
