"""The corpus operators against brute force, the public libraries and exact round trips, with every odd row."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import zstandard
from pyspark.sql import functions as F

from panelspark.llm import (bpe, compression, external_shuffle, gated_lm, jaccard, language, string_kernel, templates, token_blocks,
                            token_counts)
from panelspark.llm.common import held_out

LONG = "lorem ipsum dolor sit amet, " * 9000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, _text string, score double, key int"


@pytest.fixture(scope="module")
def docs(spark):
    """Missing, empty and blank texts, ties, repeated rows, a missing id, a very long text, clashing columns."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeßé"), rng.integers(1, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 120))) for _ in range(60)]
    base = texts[0].split() * 3
    near = [" ".join([*base[:k], "changed", *base[k + 1:]]) for k in range(20, 44)]
    texts += near + [" ".join(base), " ".join(base), texts[3], "", None, " \t\n", "a", "one two three", LONG, "  two  blanks\n\n here ",
                     "tab\tand\nline", "<|endoftext|> inside", "emoji 🙂🙂 and 漢字 текст", "x" * 5000, "\x1codd\x85space "]
    rows = [(i, t, "en", "s", 1, 7, "clash", 0.5, 1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def counted(rows):
    return Counter(map(tuple, rows))


def test_token_blocks(spark, docs, plain):
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    where = token_blocks.write_tokens(docs, path, part_tokens=20_000)
    got = token_blocks.read_tokens(spark, where, keep_ids=True).collect()
    t = Tokenizer.from_file(path)
    want = counted((i, tuple(t.encode(x, add_special_tokens=False).ids) + (0,)) for i, x in plain)
    assert counted((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    ordered, at = sorted(got, key=lambda r: r["start"]), 0
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in ordered if r["doc_id"] is not None]
    assert ids == sorted(ids)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 131072, 400_001])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 999)
    table = token_blocks.Table.from_counts(np.bincount(ids, minlength=1000))
    block = token_blocks.write_block(ids, table)
    assert (token_blocks.read_block(block, table) == ids).all()
    if n > 1000:
        with pytest.raises(ValueError):
            token_blocks.read_block(token_blocks.Block(block.n_tokens, block.rows, block.checksum ^ 1, block.states, block.at, block.words), table)


def slow_repeats(words):
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i:i + 5])].append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)})


def test_compression_bands(docs, plain):
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"], r["base_failed"], round(r["ratio"], 9))
           for r in compression.compression_bands(docs).collect()}
    press = zstandard.ZstdCompressor(level=3)
    want = set()
    for i, x in plain:
        w = x.encode().split()
        lines = [y for y in x.split("\n") if y.encode().split()]
        rep = slow_repeats(w)
        ratio = len(press.compress(x.encode())) / len(x.encode()) if x else 0.0
        want.add((i, len(w), sum(len(y.decode()) for y in w), rep, len(lines) - len(set(lines)), len(w) < 10 or 100 * rep > 20 * len(w), round(ratio, 9)))
    assert got == want


def test_bands_reject_both_ends():
    press, bands = zstandard.ZstdCompressor(level=3), compression.Bands()
    noise = hashlib.sha512(b"x").hexdigest().encode() + bytes(np.random.default_rng(1).integers(33, 127, 4000).astype(np.uint8))
    assert not compression.compression_verdict(b"again and again " * 400, press, bands)[2]
    assert not compression.compression_verdict(noise, press, bands)[2]


def test_every_byte_is_in_a_chunk():
    press, bands, rng = zstandard.ZstdCompressor(level=3), compression.Bands(), np.random.default_rng(0)
    syllables = ["".join(rng.choice(list("bcdfglmnprst")) + rng.choice(list("aeiou")) for _ in range(2)) for _ in range(300)]
    prose = " ".join("".join(rng.choice(syllables, rng.integers(1, 3))) for _ in range(1000)).encode()
    noise = b" ".join(bytes(rng.integers(33, 127, 7).astype(np.uint8)) for _ in range(257))
    for text, share in ((prose[:1900] + noise[:2052], 0.5), (prose[:2200] + noise[:1896], 0.5), (prose[:3952], 0.0), (prose[:2048], 0.0), (prose[:1000], 0.0)):
        ratio, got, kept = compression.compression_verdict(text, press, bands)
        low, high = bands.of(len(text))
        assert low <= ratio <= high and (got, kept) == (share, share == 0), (len(text), ratio, got)


def test_bpe(docs, plain):
    import tiktoken
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, x in plain:
        ids = enc.encode_ordinary(x)
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest())] += 1
    assert counted(bpe.bpe_columns(docs, ranks, P.PATTERN).collect()) == want


def test_perfect_hash():
    table = {f"k{i}".encode(): i for i in range(3000)}
    ph = bpe.PerfectHash.build(table)
    assert len(ph.keys) == len(table) and None not in ph.keys
    assert all(ph.get(k) == v for k, v in table.items()) and ph.get(b"absent") is None
    assert bpe.PerfectHash.build({}).get(b"a") is None


def test_token_counts(docs, plain):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter((i, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 512) for i, x in plain)
    assert counted(token_counts.token_counts(docs, P.path("byte_bpe_50k.json")).collect()) == want


def slow_components(plain):
    sets = {}
    for i, x in plain:
        w = x.encode().lower().split()
        sets.setdefault(i, frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    least = {i: i for i in sets}
    for _ in sets:
        before = dict(least)
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = min(least[a], least[b])
        if least == before:
            break
    return sets, least


def test_jaccard(docs, plain):
    got = jaccard.jaccard_components(docs).collect()
    assert len(got) == len(plain)
    sets, least = slow_components([p for p in plain if p[0] is not None])
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), least[r["doc_id"]]), r
    assert len({r["component_id"] for r in got}) < len(sets) - 20


@pytest.mark.parametrize("size", [4, 5, 9, 17, 40, 120])
def test_signatures_meet(size):
    """Pairs at the limit share a bucket that the larger set probes, also when most shingles are frequent."""
    rng = np.random.default_rng(size)
    for _ in range(150):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        drop = int(rng.integers(0, size // 5 + 1))
        kept = np.delete(a, rng.choice(len(a), drop, replace=False))
        b = np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, max(0, (len(a) - drop) // 9 - drop), dtype=np.uint64)]))
        small, large = sorted((a, b), key=len)
        both = len(np.intersect1d(a, b))
        if len(small) < 4 or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        frequent = rng.random() * 1.2
        cost = lambda s: np.where((s >> np.uint64(3)) % np.uint64(1000) < np.uint64(1000 * min(frequent, 1)), 50, 0)
        band = jaccard.band_of(len(small))
        index, _ = jaccard.signature(small, cost(small), band, True)
        own = jaccard.band_of(len(large)) == band
        keys, probes = jaccard.signature(large, cost(large), band, own)
        assert own or jaccard.band_below(len(large)) == band
        assert set(keys[probes].tolist()) & set(index.tolist())


def test_open_buckets_are_cut_into_blocks(spark, monkeypatch):
    """All pairs with a probing row are found, whatever the blocks, and no block holds a large part of the bucket."""
    monkeypatch.setattr(jaccard, "BLOCK", 40)
    rng = np.random.default_rng(6)
    rows = [(1, i, bool(rng.random() < 0.1), int(rng.integers(5)), int(rng.integers(20, 40)), bytes(64)) for i in range(600)]
    rows += [(2, 700, False, 1, 20, bytes(64)), (2, 701, True, 2, 20, bytes(64))]
    table = spark.createDataFrame(rows, "key long, node long, probe boolean, component long, n long, sketch binary").repartition(3)
    got = jaccard.second_pairs(table.select("key", "node", "probe"), table.select("node", "component"), table.select("node", "n", "sketch"))
    want = {(a[1], b[1]) for i, a in enumerate(rows) for b in rows[i + 1:] if a[0] == b[0] and (a[2] or b[2]) and a[3] != b[3]
            and 100 * min(a[4], b[4]) >= 80 * max(a[4], b[4])}
    assert counted(got.collect()) == Counter(want)
    held = jaccard.in_blocks(table.where("key = 1").withColumn("size", F.lit(600)), 40).where("not asks").groupBy("place").count().collect()
    assert len(held) == 15 and max(r["count"] for r in held) < 80


def test_shuffle(docs, plain):
    path, rows = external_shuffle.external_shuffle(docs, shards=5, bucket_bytes=20_000)
    got = rows.collect()
    assert counted((r["doc_id"], r["text"] or "") for r in got) == counted(plain)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[k]) for k in range(5)]
    assert max(sizes) - min(sizes) <= 1
    again = external_shuffle.external_shuffle(docs.repartition(7), shards=5, bucket_bytes=20_000)[1]
    key = lambda r: (r["shard"], r["slot"], r["text"])
    assert sorted(map(key, got), key=str) == sorted(map(key, again.collect()), key=str)


def test_shuffle_bounds_its_buckets(spark):
    """Rows of one key, of none, and equal rows are spread over the buckets."""
    rows = [(None, f"text {i} " * 5) for i in range(3000)] + [(7, f"other {i} " * 5) for i in range(3000)] + [(8, "same again " * 5)] * 6000 + [(None, None)] * 6000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt, counts = external_shuffle.scatter(docs, "doc_id", 1, 20_000)
    held = {r["_bucket"]: (r["n"], r["b"]) for r in dealt.groupBy("_bucket").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    assert all(counts[b] == n for b, (n, _) in held.items()) and counts.sum() == len(rows)
    assert max(b for _, b in held.values()) < 2 * 20_000
    got = external_shuffle.external_shuffle(docs, shards=5, bucket_bytes=20_000)[1].collect()
    assert counted((r["doc_id"], r["text"]) for r in got) == counted(rows)


def test_language(spark):
    rng = np.random.default_rng(2)
    stems = {"en": "th er ing and on", "de": "ch sch ung ein ß", "fr": "eau eux que è la", "es": "ción ñ ar los que"}
    rows = [(i, " ".join("".join(rng.choice(stems[lang].split(), 2)) for _ in range(30)), lang) for i, lang in enumerate(list(stems) * 60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(table.where(~held_out(5, 0)), per_class=40)
    got = {r["doc_id"]: r for r in language.identify(table.union(spark.createDataFrame([(900, None, None), (901, "12 ..", None)], table.schema)), model).collect()}
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.fit(table.limit(0)).predict([b"abc"]) == [("und", 0.0)]


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    usual = ["".join(rng.choice(["th", "er", "an", "ou", "st", "ion", "ble"], rng.integers(2, 5))) for _ in range(500)]
    bad = ["muckwit", "zorgbag", "fizgob"]
    texts, toxic = [], []
    for i in range(600):
        w = list(rng.choice(usual, 60))
        if i % 3 == 0:
            w[int(rng.integers(60))] = bad[i % 9 // 3]
        texts.append(" ".join(w) + ".")
        toxic.append(int(i % 3 == 0))
    model = string_kernel.fit_texts(texts[:400], toxic[:400])
    score = string_kernel.WordScores(model)
    p = model.document(score.margins([t.encode() for t in texts[400:]]))
    assert np.mean((p >= 0.7) == np.array(toxic[400:])) > 0.97
    odd = model.document(score.margins([b"theran muck.wit stion", b"m u c k w i t theran", b"theran ouster"]))
    assert odd[0] > 0.7 and odd[1] > 0.7 and odd[2] < 0.3
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (None, texts[0])], "doc_id long, text string")
    got = string_kernel.score_toxicity(rows, model).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)


def test_kernel_by_definition():
    def slow(a, b):
        from itertools import combinations
        f = [Counter(), Counter()]
        for k, w in enumerate((a, b)):
            for i in combinations(range(len(w)), 3):
                f[k]["".join(w[x] for x in i)] += string_kernel.LAMBDA ** (i[2] - i[0] + 1)
        dot = lambda x, y: sum(v * y[s] for s, v in x.items())
        return dot(f[0], f[1]) / np.sqrt(dot(f[0], f[0]) * dot(f[1], f[1]))
    marks = ["banana", "stupid"]
    table = string_kernel.landmark_table(marks)
    got = string_kernel.rows_of(["stxpid", "banan", "nanana"], table)
    np.testing.assert_allclose(got, [[slow(w, m) for m in marks] for w in ("stxpid", "banan", "nanana")], atol=1e-5)


def test_templates(spark, docs):
    item = "A train leaves the old station at 12 km per hour and Maria walks behind it for 30 minutes before it stops"
    other = item.replace("12", "45").replace("Maria", "Peter").replace("30", "50")
    torn = "12 apples and 12 pears cost the same as 12 plums in the market near the old river bridge today"
    bench = spark.createDataFrame([(1, item), (2, torn), (3, ""), (4, None)], "item_id long, text string")
    texts = [(1000, f"some words before it {item} and after"), (1001, f"other words here {other} and more"),
             (1002, torn.replace("12", "7")), (1003, "7 apples and 8 pears cost the same as 9 plums in the market near the old river bridge today"),
             (1004, "A train leaves the old station and nothing else happens in this text"), (1005, None)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in templates.contaminated(table, bench).collect()}
    assert got == {(1000, 1): False, (1001, 1): True, (1002, 2): True}
    assert templates.contaminated(table, bench.limit(0)).count() == 0 and templates.contaminated(table.limit(0), bench).count() == 0


def test_templates_of_short_and_dense_items(spark):
    bench = spark.createDataFrame([(1, "What is the capital of France"), (2, "Which river crosses every old town in Spain"), (3, "Yes"),
                                   (4, "12 kg 13 kg 14 kg 15 kg 16 kg 17 kg 18 kg"), (5, "Anna Berta 5 km")], "item_id long, text string")
    texts = [(1, "some said What is the capital of France and left"), (2, "they ask: what is the capital of Norway today"),
             (3, "tell me Which river crosses every old town in Peru first"), (4, "they said yes and Yes again"),
             (5, "a list of 12 kg 13 kg 14 kg 15 kg 16 kg 17 kg 18 kg stands here"), (6, "a list of 22 kg 23 kg 24 kg 25 kg 26 kg 27 kg 28 kg stands here"),
             (7, "so Anna Berta 5 km ran"), (8, "so Anna Berta 6 km ran"), (9, "what is the main city of France")]
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in
           templates.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1): False, (2, 1): True, (3, 2): True, (4, 3): False, (5, 4): False, (7, 5): False}


def test_templates_discount_torn_windows(spark):
    tail = "and nobody in the quiet valley below the mountain ever heard why the keeper had left the lamp burning all night long"
    rest = "they share all of them fairly and then walk home along the narrow path behind the old mill before it gets dark"
    bench = spark.createDataFrame([(1, f"The keeper Maria saw 12 ships {tail} when Maria came down"), (2, f"Tom has 5 apples for 5 friends and {rest}")],
                                  "item_id long, text string")
    texts = [(1, f"The keeper Maria saw 12 ships {tail} when Petra came down"), (2, f"Tom has 7 apples for 4 friends and {rest}"),
             (3, f"The keeper Maria saw 12 ships {tail} when Maria came down"), (4, "Tom has 7 apples for 4 friends and they share all of them fairly")]
    got = {(r["doc_id"], r["item_id"]): (r["n_slots"], r["reparameterised"]) for r in
           templates.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1): (1, True), (2, 2): (0, True), (3, 1): (2, False)}


def test_templates_look_at_each_row(spark):
    """Rows without an id or with the same one: parts of an item in several texts are no copy, and two copies are not torn."""
    item = "Every keeper of the old lamp counts 12 ships before the morning fog comes in"
    words = item.split()
    bench = spark.createDataFrame([(1, item), (None, "this item of the benchmark has no number of its own but is one")], "item_id long, text string")
    texts = [(None, " ".join(words[:9]) + " and"), (None, "x x x x " + " ".join(words[4:13])), (7, item), (7, item.replace("12", "40")),
             (8, "it says this item of the benchmark has no number of its own but is one")]
    got = {(r["doc_id"], r["item_id"]) for r in templates.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert got == {(7, 1), (8, None)}


@pytest.mark.parametrize("heavy", [gated_lm.HEAVY, 60])
def test_language_model(spark, docs, plain, heavy, monkeypatch):
    """With all words heavy, and with most of them joined to their counts."""
    monkeypatch.setattr(gated_lm, "HEAVY", heavy)
    got = gated_lm.language_model(docs, held_out(7, 2), rounds=2).collect()
    assert len(got) == len(plain)
    train = [x for i, x in plain if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = lambda x: [*x.encode().lower().split(), b"\n"]
    c = Counter(w for x in train for w in tokens(x))
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(tokens(x)), sum(c[w] > 0 for w in tokens(x)), round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tokens(x)), 4)) for i, x in plain)
    assert counted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)


@pytest.mark.parametrize("sizes", [[1], [20, 21, 1, 1], [900, *range(1, 60)], [3] * 1500])
def test_lanes_hold_each_document_once(sizes):
    """A document's windows follow each other in one lane, begin with the end word and hold every target."""
    rng = np.random.default_rng(len(sizes))
    texts = [rng.integers(0, 900, n).astype(np.int16) for n in sizes]
    goals, inputs, lane_of = defaultdict(list), defaultdict(list), {}
    for lanes, group, fresh, ids, goal in gated_lm.in_streams(texts, 901):
        assert len(lanes) <= gated_lm.STREAMS and len(set(group.tolist())) == len(group)
        for k, (lane, d) in enumerate(zip(lanes.tolist(), group.tolist())):
            assert fresh[k] == (d not in lane_of) and lane_of.setdefault(d, lane) == lane
            kept = goal[:, k] >= 0
            goals[d] += goal[kept, k].tolist()
            inputs[d] += ids[kept, k].tolist()
    for d, text in enumerate(texts):
        assert goals[d] == text.tolist() and inputs[d] == [901, *text[:-1].tolist()]


def test_softmax_parts_do_not_overflow():
    logits = np.array([[500.0, 499.0], [-500.0, -499.0]], np.float32)
    value, _ = gated_lm.softmax_parts(logits, np.array([0, 1]), False)
    np.testing.assert_allclose(value, -np.log1p(np.exp(-1.0)), rtol=1e-5)


def test_gradient_by_differences():
    lex = gated_lm.Lexicon(tuple(f"w{i}".encode() for i in range(40)), np.arange(80, 40, -1), 4000, 900, np.full(16, 20), np.full(16, 5))
    w = gated_lm.Weights.start(lex)
    rng = np.random.default_rng(0)
    w.flat += rng.standard_normal(len(w.flat)).astype(np.float32) * 0.3
    ids, goal = rng.integers(0, 40, (6, 3)), rng.integers(0, 40, (6, 3))
    goal[4:, 2], goal[1, 1] = -1, gated_lm.HEAD + 3
    state = np.zeros((3, gated_lm.HIDDEN), np.float32)
    loss = lambda: -float(np.where(goal >= 0, gated_lm.Network(w).window(ids, goal, state)[0], 0).sum()) / (goal >= 0).sum()
    net = gated_lm.Network(w)
    g = net.gradient(net.window(ids, goal, state)[2])
    for i in np.argsort(-np.abs(g))[::40][:25]:
        old = w.flat[i]
        w.flat[i] = old + 5e-3
        up = loss()
        w.flat[i] = old - 5e-3
        down = loss()
        w.flat[i] = old
        assert abs((up - down) / 1e-2 - g[i]) < 2e-3 + 0.05 * abs(g[i])


@pytest.mark.parametrize("make", [
    lambda s, d: compression.compression_bands(d), lambda s, d: token_counts.token_counts(d, P.path("byte_bpe_50k.json")),
    lambda s, d: external_shuffle.external_shuffle(d)[1], lambda s, d: jaccard.jaccard_components(d),
    lambda s, d: gated_lm.language_model(d, held_out(7, 2)),
    lambda s, d: token_blocks.read_tokens(s, token_blocks.write_tokens(d, P.path("byte_bpe_50k.json")))])
def test_empty_table(spark, docs, make):
    assert make(spark, docs.limit(0)).count() == 0


def test_language_model_does_not_depend_on_layout(spark):
    """Two and eleven partitions, equal rows and rows without a key among them: the same scores."""
    rows = [(i if i % 9 else None, " ".join(f"w{(i * j) % 50}" for j in range(i % 40)) + (f" rare{i}" if i % 3 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows + [(7, "the same row again")] * 60, "doc_id long, text string")
    found = []
    for n in (2, 11):
        scored = gated_lm.language_model(docs.repartition(n), held_out(7, 2)).collect()
        found.append(sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in scored))
    assert len(found[0]) == len(found[1]) == 360
    for a, b in zip(*found):
        assert a[:3] == b[:3]
        np.testing.assert_allclose(a[3:], b[3:], rtol=1e-4)


def test_token_counts_make_no_ids_of_irregular_white_space():
    """Every joint of blanks, line ends and marks is cut into pre-tokens; the library sees whole texts for special strings only."""
    path = P.path("byte_bpe_50k.json")
    counts = token_counts.PieceCounts(path)
    rng = np.random.default_rng(5)
    bits = [" ", "  ", "\n", " \n", "\n ", "\t", "a", "Wort", "don't", "'s", "12", "é", "中文", "!", "..", "\x1c", "\x85", "\r\n", "́", "word.", "😀"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 14))) for _ in range(6000)] + [f"x {chr(k)} y{chr(k)}" for k in range(1, 0x3100)]
    want = [len(e) for e in counts.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    seen = []
    encode = counts.tokenizer.encode_batch_fast

    class Watched:
        pre_tokenizer = counts.tokenizer.pre_tokenizer

        def encode_batch_fast(self, pieces, add_special_tokens):
            seen.extend(pieces)
            return encode(pieces, add_special_tokens=add_special_tokens)

    counts.tokenizer = Watched()
    doc, pre, times = counts.frequencies(texts)
    assert len(set(zip(doc.tolist(), pre.tolist()))) == len(doc)
    assert len(seen) == len(set(seen)) == len(counts.number)
    assert np.bincount(doc, weights=times * counts.pieces[pre], minlength=len(texts)).astype(int).tolist() == want
