"""Word hits cost one pass over the text, and a rank correlation computes its rows once."""

from pyspark.sql import functions as F

from panelspark.functions import ranking, text
from panelspark.operators import articles, inference


def test_hits_are_those_of_the_set_of_words_in_one_pass(spark):
    rows = spark.createDataFrame([("The end, of the day.",), (" .,",), ("",), (None,), ("theof the\x85OF. in",)], "w string")
    vocabulary = ("the", "of", "day")
    got = rows.select(text.hits(text.words(F.col("w")), vocabulary).alias("a"), text.hits(text.word_set(F.col("w")), vocabulary).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and [r["a"] for r in got][:3] == [3, 0, 0] and got[4]["a"] == 2
    plan = rows.select(articles.lexicon_sign(F.col("w"), vocabulary, ("in",)))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "regexp_replace" not in plan


def test_ranked_rows_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(100, numPartitions=2).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    for direct in (1000, 5):
        seen.value = 0
        curve = inference.decile_curve(rows.mapInArrow(look, rows.schema), "x", "y", ("x",), direct_rows=direct).collect()
        assert sum(r["n"] for r in curve) == 100 and seen.value == 100
        seen.value = 0
        out = ranking.rank_correlation(rows.mapInArrow(look, rows.schema), [], "x", "y", direct_rows=direct).collect()
        assert out[0]["n"] == 100 and seen.value == 100
