import os

import pytest
from pyspark.sql import functions as F

from wavedeck.llm import katz, scratch


def test_scratch_goes(spark, documents):
    scratch.drop_scratch(spark)
    found, _ = katz.score_documents(documents.limit(20), F.lit(True))
    assert found.count() == 20
    base = scratch.shared_dir(spark).removeprefix("file:") + "/wavedeck"
    assert os.listdir(base) and [t.name for t in spark.catalog.listTables() if t.name.startswith("wavedeck_ngrams_")]
    scratch.drop_scratch(spark)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("wavedeck_ngrams_")]
    assert not [p for p in os.listdir(base) if p.startswith(("ngrams", "histories", "wavedeck_ngrams"))]


def test_turns_go_as_the_next_comes(spark):
    base = scratch.shared_dir(spark).removeprefix("file:") + "/wavedeck"
    df, rows = spark.range(100), []
    for k, part in enumerate(scratch.in_turns(df, "turns", F.col("id") % 7, 8)):  # the last has no row
        rows.append([r.id for r in part.orderBy("id").collect()])
        (there,) = [p for p in os.listdir(base) if p.startswith("turns-")]
        assert sorted(p for p in os.listdir(f"{base}/{there}") if "=" in p) == [f"turn={i}" for i in range(k, 7)]
    assert rows == [[i for i in range(100) if i % 7 == k] for k in range(8)]
    both = scratch.stored(iter([df, df.where("id < 3")]), "turns")
    assert both.count() == 103


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        scratch.shared_dir(Session())
