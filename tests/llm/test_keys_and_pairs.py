"""Keys of any type, pairs ruled out by sketches, and pairs of a node in stretches."""

from decimal import Decimal

import numpy as np
import public_tokenizers as P
import pytest
import zstandard
from pyspark.sql import functions as F

from panelspark.llm import gated_lm, jaccard, templates, token_blocks
from panelspark.llm.common import held_out

TEXT = "the quick brown fox number {} jumps over one lazy dog and runs away from the old house by the river"


@pytest.mark.parametrize("kind,cast", [("smallint", int), ("decimal(12,0)", Decimal), ("string", str)])
def test_keys_of_any_type(spark, kind, cast):
    rows = spark.createDataFrame([(i, TEXT.format(i // 2)) for i in range(8)], "id int, text string")
    docs = rows.select(F.col("id").cast(kind).alias("doc_id"), "text")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert got == {cast(i): cast(i - i % 2) for i in range(8)}
    bench = spark.createDataFrame([(1, TEXT.format(5))], "item_id long, text string")
    assert dict(templates.contaminated(docs, bench).dtypes)["doc_id"] == kind
    assert {r["doc_id"] for r in templates.contaminated(docs, bench).select("doc_id").collect()} == set(got)
    read = token_blocks.read_tokens(spark, token_blocks.write_tokens(docs, P.path("byte_bpe_50k.json")), kind=kind).collect()
    assert {r["doc_id"] for r in read} == set(got)
    assert {r["doc_id"] for r in gated_lm.language_model(docs, held_out(7, 2)).collect()} == set(got)


def test_sketches_rule_out_no_link(spark):
    """Every pair that links passes; pairs of different texts of usual length do not."""
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(40):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(10, 300)), dtype=np.uint64))
        sets += [a, np.unique(np.concatenate([a[len(a) // 12:], rng.integers(0, 1 << 63, len(a) // 30, dtype=np.uint64)]))]
    sketches = spark.createDataFrame([(i, len(s), jaccard.sketch(s)) for i, s in enumerate(sets)], "node long, n long, sketch binary")
    every = [(i, j) for i in range(len(sets)) for j in range(i)]
    got = {tuple(r) for r in jaccard.possible(spark.createDataFrame(every, "a long, b long"), sketches).collect()}
    both = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i, j in every}
    links = {(i, j) for (i, j), n in both.items() if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n)}
    assert len(links) > 30 and links <= got and len(got) < len(every) // 10


def test_pairs_of_one_node_in_stretches(spark):
    """A node with more pairs than a stretch holds meets all of them."""
    press = zstandard.ZstdCompressor()
    words = TEXT.split() * 3
    texts = [" ".join([*words, f"w{i}"] if i % 3 else [f"x{i}y{k}" for k in range(30)]).encode() for i in range(700)]
    table = spark.createDataFrame([(i, press.compress(t)) for i, t in enumerate(texts)], "node long, packed binary")
    pairs = spark.createDataFrame([(1, i) for i in range(700) if i != 1], "a long, b long")
    got = {r["b"] for r in jaccard.verified(pairs, table).collect()}
    assert got == {i for i in range(700) if i % 3 and i != 1}
