import pytest

from tests.conftest import SF, same_rows
from tessera.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert same_rows(QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df())


def test_registered():
    import __spark_entry__

    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())


def test_pipeline_stages(spark):
    """Each stage against what its operator says of its own input."""
    import corpus_pipeline
    from tessera.llm import decontam, jaccard, mixing
    from tessera.llm.common import stored, table

    given = table(spark, SF, "documents")
    seen = [given]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], SF)))
    ids = [[r.doc_id for r in x.select("doc_id").collect()] for x in seen]
    assert all(x.columns == given.columns for x in seen[:-1])
    assert set(ids[1]) <= set(ids[0]) and len(ids[1]) > 0.95 * len(ids[0])
    joined = jaccard.join(seen[1]).toPandas()
    assert sorted(ids[2]) == sorted(joined["component_id"].unique())
    marked = decontam.report(seen[2], table(spark, SF, "benchmark")).toPandas()
    assert sorted(ids[3]) == sorted(marked["doc_id"][~marked["contaminated"]])
    times = {r.doc_id: r.times for r in mixing.mix(seen[3], table(spark, SF, "labels")).collect()}
    assert sorted(ids[4]) == sorted(i for i, n in times.items() for _ in range(n))
    assert sorted(ids[5]) == sorted(ids[4])


def test_pipeline_with_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and columns of any name pass through every stage."""
    import corpus_pipeline
    from pyspark.sql import functions as F
    from tessera.llm.common import stored, table

    names = "score lang_pred guess one row d k hits id of words times n at part root".split()
    given = table(spark, SF, "documents").limit(60)
    odd = [(None, None, None, None), (901, None, "en", "a"), (902, "", None, None), (903, " \n 12", "en", "a"), (904, "a text in the year of the mouse " * 5000, None, None), (905, "the same row twice and again", "en", "b"), (905, "the same row twice and again", "en", "b"), (None, "a row without an id in it", "en", "b")]
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast(given.schema["n_chars"].dataType))
    docs = stored(given.unionByName(more.select(*given.columns)).withColumns({c: F.lit(f"{c}!") for c in names}))
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], SF)))
    assert all(x.columns == docs.columns and (x.count() == 0 or [x.first()[c] for c in names] == [f"{c}!" for c in names]) for x in seen[:-1])
    ids = [[r.doc_id for r in x.select("doc_id").collect()] for x in seen]
    assert not {901, 902, 903} & set(ids[1]) and ids[1].count(905) == 2 and None in ids[1] and 904 in ids[1]
    assert ids[2].count(905) == 1 and ids[2].count(None) == 1
    assert sorted(map(str, ids[5])) == sorted(map(str, ids[4]))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
