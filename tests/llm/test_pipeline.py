"""The pipeline on the smallest tables: each stage's decision is the operator's, and takes effect."""

import os

import pytest

import corpus_pipeline as pipeline

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")


def test_stages(spark):
    docs = pipeline.documents(spark, FOLDER)
    columns, sizes = docs.columns, [docs.count()]
    odd = spark.createDataFrame([(None, "plain words stand here one after the other without any harm done to them", "en", "s", 1), (10**9, None, None, None, None)], docs.schema)
    docs = docs.union(odd)
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[-1] > sizes[0] // 2 and sizes == sorted(sizes, reverse=True)
    groups = pipeline.jaccard.jaccard_components(docs).where("n_shingles > 0 and doc_id is not null")
    assert groups.count() == groups.select("component_id").distinct().count()
    assert pipeline.encode(spark, docs, FOLDER).count() == sizes[-1]


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    """Missing and repeated ids: only the leaking row goes, different texts of one id stay, copies do not."""
    item = "Every keeper of the old lamp counts 12 ships before the morning fog comes in"
    one, two = (" ".join(f"{w}{i}" for i in range(40)) for w in ("north", "south"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, f"they say {item}"), (None, one), (None, one), (5, two), (5, two + " more"), (5, " ".join(reversed(one.split()))), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = sorted(map(tuple, pipeline.decontamination(spark, docs, str(tmp_path)).collect()), key=str)
    assert clean == sorted(rows[1:], key=str)
    left = pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "").split(" ")[0]) for r in left) == sorted(
        [("None", "they"), ("None", "north0"), ("5", "south0"), ("5", "north39"), ("6", "")])


def test_columns_named_like_the_pipelines_own(spark):
    """Extra columns called _row, _text, n or text_ come back as they were; an empty table gives an empty one."""
    docs = pipeline.documents(spark, FOLDER)
    more = docs.selectExpr("*", "cast(doc_id * 7 as string) AS _row", "doc_id + 1 AS _row_", "'t' AS _text", "1 AS n", "true AS kept")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, more, FOLDER)
        assert out.columns == more.columns
        assert out.where("_row <> cast(doc_id * 7 as string) or _row_ <> doc_id + 1 or _text <> 't' or n <> 1 or not kept").count() == 0
        assert 0 < out.count() <= more.count()
        assert stage(spark, more.where("false"), FOLDER).count() == 0, name


def test_judging_stages_shuffle_no_text(spark, tmp_path):
    """Toxicity's and quality's verdicts travel with their rows: what each keeps is the operator's, without an exchange."""
    docs = pipeline.documents(spark, FOLDER)
    model = pipeline.string_kernel.fit(pipeline.queries.labelled(spark, FOLDER, docs))
    for judge, keep in ((lambda rows, key: pipeline.compression.compression_bands(rows, key), "kept"),
                        (lambda rows, key: pipeline.string_kernel.score_toxicity(rows, model, key), "predicted = 0")):
        kept = pipeline._judged(docs, lambda rows, key: judge(rows, key).where(keep))
        assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
        want = judge(docs, "doc_id").where(keep).select("doc_id").collect()
        assert kept.schema == docs.schema
        assert sorted(kept.collect()) == sorted(docs.where(pipeline.F.col("doc_id").isin([r[0] for r in want])).collect())


def test_a_worker_holds_one_stages_memo():
    from panelspark.llm import common
    common._STATE.clear()
    first = common.worker_state("one", dict)
    assert common.worker_state("one", dict) is first
    common.worker_state("two", list)
    assert list(common._STATE) == ["two"]
    learnt = []
    memo = common.ChunkMemo(lambda c: [c], lambda pre: learnt.extend(pre) or [p.encode() for p in pre], b"".join, str.encode, limit=200)
    for k in range(20):
        text = " ".join(["a", "used", *(f"w{k}x{i}" for i in range(50))])
        assert b"".join(next(memo.values([text]))) == text.encode()
        assert len(memo.pre) + len(memo.before) <= 300
    assert learnt.count(" used") == 1


@pytest.mark.parametrize("maps", [8192, 0])
def test_dropped_rows_are_exact(spark, monkeypatch, maps):
    """Numbers at the borders of bitmaps and parts, columns of odd names, with bitmaps and by a join."""
    monkeypatch.setattr(pipeline, "MAPS", maps)
    numbers = [part * 2**33 + i for part in (0, 1, 5) for i in (0, 1, 2, 7, 8, 9, 32767, 32768, 32769, 65536, 65537)]
    rows = spark.createDataFrame([(n, f"t{n}", None if n % 2 else n) for n in numbers], "_row_ long, `_map` string, `a.b` long")
    for bad in (numbers[::3], numbers[1::2], [], numbers):
        kept = pipeline._without(rows, "_row_", spark.createDataFrame([(n,) for n in bad], "_row_ long"))
        assert kept.columns == ["_map", "a.b"]
        assert sorted(r["_map"] for r in kept.collect()) == sorted(f"t{n}" for n in set(numbers) - set(bad))


@pytest.mark.parametrize("stage", [pipeline.near_duplicates, pipeline.decontamination])
def test_dropping_stages_shuffle_no_text(spark, stage):
    """Whatever Spark takes for small, rows meet the verdicts where they are stored."""
    docs = pipeline.documents(spark, FOLDER)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = stage(spark, docs, FOLDER)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "text" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning" in x)
        assert 0 < kept.count() < docs.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
