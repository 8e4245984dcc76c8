"""Byte network, filter audit and Orchard clusters: against brute force, by definition, and on odd tables."""

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from panelspark.llm import byte_network, centroids, filter_audit

DOCS = "doc_id long, text string, source string, n_words string, _row int, mask string, A int"
LABELS = "doc_id long, quality int, toxic int"


# ---- filter audit -------------------------------------------------------------------------------------------------

def audit_by_hand(docs, labels):
    """Runs every order on every part, document by document."""
    quality, toxic = {}, {}
    for d, q, t in labels:
        if d is not None:
            quality[d], toxic[d] = quality.get(d, False) or q == 1, toxic.get(d, False) or t == 1
    first = {}
    for d, t, *_ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))

    def fails(d, text):
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
        return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text),
                "E": d is not None and d > first[text]}

    rows = [((s or ""), fails(d, t or ""), quality.get(d, False), toxic.get(d, False)) for d, t, s, *_ in docs]
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(r[1][f] for r in own) - len(gone),
                    sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    shapley = {}
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + v[1]
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def run_audit(spark, docs, labels):
    rows, fails = filter_audit.failing_relations(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    return {(r["part"], r["filter_order"], r["step"]): [r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"],
                                                        r["toxic_lost"], r["shapley"]] for r in filter_audit.audit(rows, fails).collect()}


def test_audit_against_every_order_by_hand(spark):
    spin = np.random.default_rng(3)
    pool = ["w%d" % i for i in range(300)] + ["Ab", "X", "cost$", "a|b", "é", " "]
    texts = [None, "", " \t\x0b", "x" * 20_000, "ÄÖ Z", "same words"]
    texts += [" ".join(spin.choice(pool[:k], size=int(n))) for n, k in zip(spin.integers(1, 420, 40), spin.integers(3, len(pool), 40))]
    docs = [(i, texts[int(spin.integers(len(texts)))], ["s1", "s2", None, ""][i % 4], "n", 1, "m", 2) for i in range(160)]
    docs += [(None, "same words", "s1", None, None, None, None)] * 3 + [(7, "same words", "s2", None, 0, "", 0), (7, "same words", "s2", None, 0, "", 0)]
    labels = [(i, int(spin.integers(2)), int(spin.integers(2))) for i in range(0, 160, 2)] + [(4, 1, 1), (None, 1, 1), (9, None, None), (9999, 1, 1)]
    assert run_audit(spark, docs, labels) == audit_by_hand(docs, labels)


def test_audit_of_one_text_and_of_nothing(spark):
    docs = [(i, "one and the same", "s", "", 0, "", 0) for i in range(300)]
    found = run_audit(spark, docs, [])
    assert found == audit_by_hand(docs, [])
    assert found["s", "ABCDE", 1][1] == 300 and found["s", "EABCD", 1][:2] == [1, 299]
    assert run_audit(spark, [], [(1, 1, 1)]) == {}


def test_heavy_groups_of_copies_join_like_the_others(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i, i % 7) for i in range(100)] + [(100 + i, None, 3) for i in range(5)], "_row long, _key long, _digest int")
    want = sorted(range(7, 100))
    for heavy in (2, 1000):
        monkeypatch.setattr(filter_audit, "HEAVY_GROUPS", heavy)
        assert sorted(r[0] for r in filter_audit.later_copies(rows).collect()) == want


# ---- Orchard clusters ---------------------------------------------------------------------------------------------

def clusters_by_hand(rows, k, rounds, size):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and np.isfinite(x) and abs(x) <= 524288 for x in v):
            kept.append((i, [int(np.floor(256 * float(x))) for x in v]))
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "",
                                        np.array(r[1], "<i4").tobytes()))
    c = [v for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)) for i, v in kept]
    inner = {j: sum(d for _, d, a in found if a == j) for j in range(len(c))}
    name = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return sorted(((i is None, i or 0, a, d, inner[a], sum(inner.values()), name[a]) for i, d, a in found))


def run_clusters(spark, rows, k, rounds, size, kind="float"):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string")
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"])
                  for r in centroids.cluster_vectors(df, k=k, rounds=rounds, size=size).collect())


def test_clusters_against_brute_force(spark):
    spin = np.random.default_rng(1)
    rows = [(i, np.float32(spin.normal(size=4) + spin.integers(-3, 3)).tolist()) for i in range(400)]
    rows += [(i, rows[5][1]) for i in range(400, 520)] + [(7, rows[7][1])] * 3 + [(None, rows[9][1])] * 2  # copies, repeated and missing ids
    rows += [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0] * 5), (904, [1.0, None, 1.0, 1.0]), (905, [float("nan")] * 4),
             (906, [float("inf"), 0.0, 0.0, 0.0]), (907, [600000.0] * 4), (908, [3e38] * 4), (909, [524288.0, -524288.0, 0.0, 0.0])]
    assert run_clusters(spark, rows, 12, 3, 4) == clusters_by_hand(rows, 12, 3, 4)


def test_few_vectors_equal_vectors_and_none(spark):
    rows = [(i, [0.5, -0.5]) for i in range(5)] + [(9, [1.0, 2.0])]
    assert run_clusters(spark, rows, 40, 2, 2) == clusters_by_hand(rows, 40, 2, 2)
    assert run_clusters(spark, [(1, [0.25, 1.0])], 40, 2, 2, "double") == clusters_by_hand([(1, [0.25, 1.0])], 40, 2, 2)
    assert run_clusters(spark, [(1, None)], 40, 2, 2) == []


@pytest.mark.parametrize("spread", [3, 1 << 26])
def test_search_is_exact_with_ties_and_measures_less(spread):
    spin = np.random.default_rng(spread)
    x, c = spin.integers(-spread, spread, (500, 3)), spin.integers(-spread, spread, (40, 3))
    tree = centroids.Orchard(c)
    now, best = tree.nearest(x)
    gap = ((x[:, None].astype(object) - c[None]) ** 2).sum(axis=2)
    assert now.tolist() == [min(range(40), key=lambda j: (row[j], j)) for row in gap]
    assert best.tolist() == [min(row) for row in gap]
    assert tree.measured < x.shape[0] * len(c)


def test_no_vector_is_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.list_(pa.float32()))], names=["a", "b"])
    assert [b.num_rows for b in centroids.quantise(iter([batch]), 4)] == [0]


# ---- byte network -------------------------------------------------------------------------------------------------

def probability_by_hand(net, text):
    """The forward pass window by window, from the definition."""
    w = byte_network
    symbols = list(text) + [w.PAD] * (w.WIDTH + w.BLOCK)
    blocks = -(-(len(text) + w.WIDTH - 1) // w.BLOCK)
    top = []
    for b in range(blocks):
        best = np.full(w.FILTERS, w.NEVER)
        for p in range(b * w.BLOCK, min((b + 1) * w.BLOCK, len(text))):
            best = np.maximum(best, sum(net.filters[k, symbols[p + k]].astype(float) for k in range(w.WIDTH)))
        top.append(best)
    hidden = []
    for b in range(max(1, blocks - 1)):
        high = np.maximum(top[b], top[min(b + 1, blocks - 1)])
        size = min(len(text), (b + 2) * w.BLOCK) - b * w.BLOCK
        x = np.concatenate([np.maximum(high + net.bias, 0), [np.log2(1 + size) / 9]])
        hidden.append(np.maximum(x @ net.w1 + net.b1, 0))
    pooled = np.concatenate([np.max(hidden, axis=0), np.mean(hidden, axis=0)])
    margin = net.scale[0] * (pooled @ net.w2 + net.b2[0]) + net.scale[1]
    return 1 / (1 + np.exp(-margin))


def made_texts(n, seed=0):
    spin = np.random.default_rng(seed)
    parts = ["the", "an", "ing", "er", "ou", "tion", "st", "re", "nd", "ha"]
    texts, labels = [], []
    for i in range(n):
        words = ["".join(spin.choice(parts, 2)) for _ in range(int(spin.integers(20, 200)))]
        bad = i % 2
        if bad:
            at = int(spin.integers(len(words) - 10))
            words[at:at + 10] = [w + "$%" for w in words[at:at + 10]]
        texts.append(" ".join(words).encode())
        labels.append(1 - bad)
    return texts, np.array(labels)


def test_forward_pass_and_gradients_by_definition():
    net = byte_network.ByteNetwork(3)
    texts = [b"", b"a", bytes(range(256)) * 3, b"word " * 400, b"x" * 256, b"y" * 257]
    assert np.allclose(net.probability(texts), [probability_by_hand(net, t) for t in texts], atol=2e-6)
    goal, weight = np.array([1, 0, 1, 0, 1, 0.0]), np.array([1, 2, 1, 1, 0.5, 1.0])
    found, _ = net.gradients(texts, goal, weight)
    spin = np.random.default_rng(0)
    for name in ("filters", "bias", "w1", "b1", "w2", "b2"):
        whole, strongest = getattr(net, name), np.argsort(-np.abs(found[name].ravel()))[:6]
        for cell in [*strongest, *spin.integers(0, whole.size, 2)]:
            at = np.unravel_index(cell, whole.shape)
            if name == "filters" and at[1] == byte_network.PAD:
                continue
            old, size = whole[at], 1e-3
            whole[at] = old + size
            up = net.gradients(texts, goal, weight)[1]
            whole[at] = old - size
            down = net.gradients(texts, goal, weight)[1]
            whole[at] = old
            assert abs((up - down) / (2 * size) - found[name][at]) < 2e-3


def test_network_finds_a_passage_anywhere(spark):
    texts, labels = made_texts(400)
    net = byte_network.train(texts, labels, steps=400)
    held, want = made_texts(100, 1)
    assert ((net.probability(held) >= 0.7) == (want == 1)).mean() > 0.95
    # behind a very long clean text the passage still counts: nothing is cut off
    clean = b" ".join(t for t, y in zip(*made_texts(600, 2)) if y == 1)
    assert len(clean) > 100_000
    bad = clean + b" " + held[1]
    assert net.probability([bad])[0] < net.probability([clean])[0]
    docs = [(i, t.decode(), 0) for i, t in enumerate(held)] + [(None, None, 1), (1, "", 2), (1, "", 3), (5, clean.decode(), 4)]
    rows = byte_network.score_quality(spark.createDataFrame(docs, "doc_id int, text string, score int").repartition(3), net).collect()
    assert len(rows) == len(docs)
    by_id = {r["doc_id"]: r["score"] for r in rows if r["doc_id"] not in (None, 1, 5)}
    assert all(abs(by_id[i] - net.probability([held[i]])[0]) < 1e-9 for i in by_id)
    empty = [r["score"] for r in rows if r["doc_id"] is None or (r["doc_id"] == 1)]
    assert sum(abs(s - net.probability([b""])[0]) < 1e-9 for s in empty) == 3
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert byte_network.score_quality(spark.createDataFrame([], "doc_id decimal(10,0), text string"), net).collect() == []


def test_one_class_or_no_text():
    assert byte_network.train([], np.array([])).probability([b"x", b""]).tolist() == [0.5, 0.5]
    assert byte_network.train([b"a", b"b"], np.array([1, 1])).probability([b"x"])[0] == 0.75


def test_sample_draws_only_ids_with_documents(spark, tmp_path):
    from panelspark.llm.queries import quality_sample
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(3, "another"), (None, "none"), (50, None)], "doc_id long, text string")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 4000)] + [(3, 0, 0), (None, 1, 0), (50, 1, 1), (8, None, 0)],
                          LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    import zlib
    found = sorted((r["label"], r["text"]) for r in quality_sample(spark, str(tmp_path), docs, 100).collect())
    learned = [i for i in [*range(40), 50] if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(found) == len(learned) and {t for _, t in found if t} <= {f"text {i}" for i in learned} | {"another"}
    assert all(lab == (0 if t in ("another", "text 3") else int(t.split()[1]) % 2) for lab, t in found if t)


def test_schema_types(spark):
    df = spark.createDataFrame([], T.StructType([T.StructField("vec_id", T.ShortType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]))
    assert dict(centroids.cluster_vectors(df).dtypes) == {"vec_id": "smallint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint",
                                                          "inertia": "bigint", "centroid_sha256": "string"}


@pytest.mark.parametrize("many", [900, 5000])
def test_no_class_is_lost_without_ids(spark, many):
    """Rows without an id, or all with one id, are drawn by their texts; equal rows are one draw."""
    from panelspark.llm.common import bounded_sample
    for key in (None, 7):
        rows = [(key, f"text {i}", "en") for i in range(many)] + [(key, f"texte {i}", "fr") for i in range(500)] + [(key, "gleich", "de")] * 3000
        found = bounded_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang", 200).collect()
        count = {x: sum(r["lang"] == x for r in found) for x in ("en", "fr", "de")}
        assert count["en"] == count["fr"] == 200 and count["de"] == 1
        assert len({(r["lang"], r["text"]) for r in found}) == len(found)
