"""Registered corpus queries against SQL, loops and round trips; rows that are odd in ids, names or ties."""

import glob
import hashlib
import math
import os
import random
import time
import unicodedata
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import ann, chat, jaccard, mixing, pii, quality, queries, tokens, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.fixture(scope="module")
def results(spark):
    return {name: query(spark, SF) for name, query in queries.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(results, con, name):
    rows = [r.asDict() for r in results[name].collect()]
    q = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(results[name].columns)
    assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(q.fetchall())


def test_registered_queries_keep_their_contracts(spark, results, con):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    near = results["op1_nearest_neighbours"].collect()
    ids = [r[0] for r in con.execute("select vec_id from embeddings").fetchall()]
    assert {r["query_id"] for r in near} == {i for i in ids if i % 20 == 0}
    assert Counter(r["query_id"] for r in near) == {i: min(20, len(ids) - 1) for i in ids if i % 20 == 0}
    for name in ("op2_masked_likelihood", "op3_ngram_jaccard", "op4_token_counts", "op5_pii_spans", "op7_toxicity", "op9_quality_rules"):
        assert sorted(r["doc_id"] for r in results[name].collect()) == sorted(docs), name
    for r in results["op4_token_counts"].collect():
        counts = tokens.unpack_counts(r["prefix_tokens"])
        assert len(counts) == len(docs[r["doc_id"]] or "") and r["n_tokens"] == (counts[-1] if len(counts) else 0) and r["over_limit"] == (r["n_tokens"] > 2048)
    for r in results["op7_toxicity"].collect():
        import zlib

        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    packed = results["op6_best_fit_packing"].collect()
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert {r["doc_id"] for r in packed} == set(docs) and max(fill.values()) <= 2048
    planted = [r for r in results["op10_chat_format"].collect() if r["conv_id"] == -1][0]
    text = "</s>[INST] ok [/INST]"
    assert planted["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and planted["n_turns"] == 2 and planted["valid"]
    assert planted["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    mixed = results["op8_mixing"].collect()
    assert {r["doc_id"] for r in mixed} == set(docs)


# ---- op1
def test_small_tables_give_all_candidates(spark):
    rng = np.random.default_rng(5)
    for n in (2, 5, 12, 21, 30):
        rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((n, 8)))]
        got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.lit(True)).groupBy("query_id").count().collect()
        assert {r["query_id"]: r["count"] for r in got} == {i: min(20, n - 1) for i in range(n)}


def test_queries_far_from_all_others_are_complete(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((600, 16)) * 0.05 + 3, -rng.standard_normal((3, 16)) * 0.05 - 3])
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(t, F.col("vec_id") >= 595).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    assert all(len(v) == 20 for v in got.values()) and len(got) == 8
    score = x @ x[600]
    score[600] = -np.inf
    assert [v for _, v in sorted(got[600])][:2] == np.argsort(-score)[:2].tolist()


# ---- op3
def test_rows_without_ids_link_and_copies_go(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(30)) for p in "abc")
    rows = [(None, a, "x"), (None, a, "w"), (7, a + " more", "x"), (None, b, "x"), (None, c, "x"), (None, c.upper(), "x"), (9, a, "x"), (9, b + " " + c, "x"), (9, a, "x"), (4, "", "x"), (None, None, "x")]
    t = spark.createDataFrame(rows, "doc_id long, text string, key_id string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(t).collect())
    assert got == {(None, 27, 7): 2, (7, 28, 7): 1, (9, 27, 7): 2, (None, 27, None): 3, (9, 57, 9): 1, (4, 0, 4): 1, (None, 0, None): 1}
    kept = jaccard.one_per_component(t, width=4, num=85).collect()
    assert kept[0].asDict().keys() == {"doc_id", "text", "key_id"}
    assert Counter((r["doc_id"], r["text"]) for r in kept)[(7, a + " more")] == 1
    texts = Counter(r["text"] for r in kept)
    assert texts[b] == 1 and texts[b + " " + c] == 1 and texts[c] + texts[c.upper()] == 1 and texts[a] == 0 and texts[""] == 1 and texts[None] == 1


# ---- op4
def test_words_that_are_not_normal_walk_like_the_library():
    counter = tokens.PrefixCounter("word_bpe_49k.json")
    rng = random.Random(11)
    marks = ["\u0301", "\u0308", "\u0327", "\u0323"]
    pools = [["e", "a", "o", *marks], ["\u1100", "\u1161", "\u11a8", "x"], ["'", "s", "r", "e", "l", "v", "é", "\u0301"], ["1", "a", "-", "'", "t", "\u0302", "E"], ["<|endoftext|>", "a", "<|", "'s", "\u0301", "<|startoftext|>"], ["\u0b47", "\u0b3e", "\u212b", "K"]]
    for k in range(600):
        word = "".join(rng.choice(pools[k % len(pools)]) for _ in range(rng.randrange(1, 14)))
        want = [len(e.ids) for e in counter.library.encode_batch([word[:i] for i in range(1, len(word) + 1)], add_special_tokens=False)]
        assert counter.text_counts(word).tolist() == want, ascii(word)
        packed = tokens.pack_counts(np.array(want, np.int32))
        assert tokens.unpack_counts(packed).tolist() == want
    assert tokens.unpack_counts(tokens.pack_counts(np.array([5, 900, 3], np.int32))).tolist() == [5, 900, 3]


def test_long_words_that_are_not_normal_take_seconds():
    counter = tokens.PrefixCounter("word_bpe_49k.json")
    for word in ("e\u0301" * 20_000, "<|endoftext|>x" * 3000, "n\u0303 " * 9_000 + "o\u0308" * 10_000):
        began = time.time()
        counts = counter.text_counts(word)
        assert time.time() - began < 20 and not unicodedata.is_normalized("NFC", word) or "<|" in word
        assert counts[-1] == len(counter.library.encode(word, add_special_tokens=False).ids)


# ---- op5
def test_labelers_and_classifier_again(spark):
    """EM and naive Bayes by loops over the same candidates."""
    texts = ["call (555) 123-4567 now", "mail bob [at] site [dot] org", 'token = "1beb58b8af68854f0e01b4ad40cdbb6a"', "x@y.zz and 10.0.0.7", "version 1.2.3.4 of", "card 4111 1111 1111 1111", "path aa/bb-cc/dd/ee1/ffff", "IP fedc:abcd:abcd:abcd:abcd:abcd:abcd:abcd ok"] * 3
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found, model = pii.fit_pii(d)
    row = model.first()
    cands = [c for r in found.collect() for c in r["cands"]]
    assert any(c["kind"] == 1 and not c["base"] for c in cands)  # an address of letters alone
    prior, accuracy = [0.5] * 5, [0.8] * 5
    logit = lambda p: math.log(p / (1 - p))
    post = lambda c: 1 / (1 + math.exp(-(logit(min(max(prior[c["kind"]], 0.01), 0.99)) + sum(v * logit(a) for v, a in zip(c["votes"], accuracy, strict=True)))))
    for _ in range(pii.ROUNDS):
        q = [post(c) for c in cands]
        own = [[p for p, c in zip(q, cands, strict=True) if c["kind"] == k] for k in range(5)]
        right = [sum(p if c["votes"][j] > 0 else 1 - p for p, c in zip(q, cands, strict=True) if c["votes"][j]) for j in range(5)]
        voted = [sum(c["votes"][j] != 0 for c in cands) for j in range(5)]
        prior = [(sum(o) + 1) / (len(o) + 2) for o in own]
        accuracy = [min(max((r + 8) / (n + 10), 0.55), 0.99) for r, n in zip(right, voted, strict=True)]
    assert row["model"]["prior"] == pytest.approx(prior) and row["model"]["accuracy"] == pytest.approx(accuracy)
    q = [round(post(c), 6) for c in cands]
    yes, n, whole = defaultdict(float), Counter(), defaultdict(list)
    for p, c in zip(q, cands, strict=True):
        whole[c["kind"]].append(p)
        for f in c["features"]:
            yes[c["kind"], f] += p
            n[c["kind"], f] += 1
    rate = {k: (sum(v) + 1) / (len(v) + 2) for k, v in whole.items()}
    want = {f: math.log((yes[k, f] + rate[k]) / (n[k, f] - yes[k, f] + 1 - rate[k])) for k, f in n} | {f"kind {k}": logit(r) for k, r in rate.items()}
    assert row["odds"].keys() == want.keys() and all(row["odds"][f] == pytest.approx(v, abs=1e-4) for f, v in want.items())
    spans = {r["doc_id"]: r for r in pii.find_pii(d).collect()}
    assert all(r["n_spans"] == len([s for s in r["spans"].split(",") if s]) for r in spans.values())


# ---- op7
def test_toxicity_scores_by_loops(spark):
    rng = random.Random(12)
    texts = [" ".join([f"p{rng.randrange(60)}" for _ in range(25)] + (["vile", f"q{rng.randrange(6)}"] if i % 4 == 0 else [])) for i in range(160)]
    texts[3] = texts[3] + " tail" * 9000  # a long example teaches too
    labels = [(i, 1, int(i % 4 == 0)) for i in range(160)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")  # noqa: E741
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(d, l, F.col("doc_id") < 120).collect()}
    model = toxicity.fit_toxicity(d, l, F.col("doc_id") < 120)
    assert 3 in model.ids

    def bag(t):
        words = t.split()
        return Counter(words) + Counter("head " + w[:5] for w in words)

    bags = {i: bag(t) for i, t in enumerate(texts)}
    learn = range(120)
    used = set().union(*(bags[i] for i in learn))
    df = Counter(w for b in bags.values() for w in b)

    def g2(w):
        a, b = sum(w in bags[i] for i in learn if i % 4 == 0), sum(w in bags[i] for i in learn if i % 4)
        p, total = (a + b) / 120, 0.0
        for x, n in ((a, 30), (b, 90)):
            for seen, r in ((x, p), (n - x, 1 - p)):
                total += 2 * seen * math.log(seen / (n * r)) if seen else 0
        return total

    idf = {w: (math.log(161 / (1 + df[w])) + 1) * (1 if g2(w) >= toxicity.MIN_G2 else toxicity.FLOOR) for w in used}

    def vector(b):
        v = {"": 1.0} | {w: (1 + math.log(n)) * idf[w] for w, n in b.items() if w in used}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = {i: vector(b) for i, b in bags.items()}

    def vote(i):
        sims = sorted(((sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()), j) for j in learn if j != i), key=lambda s: -s[0])
        edge = sims[toxicity.K - 1][0] - 1e-6
        near = [(s, j) for s, j in sims if s >= edge]
        return sum(s**4 * (j % 4 == 0) for s, j in near) / sum(s**4 for s, _ in near)

    own = [vote(i) for i in learn]
    knots, values = toxicity.isotonic(np.array(own), np.array([float(i % 4 == 0) for i in learn]), np.ones(120))
    for i in range(120, 160):
        assert got[i]["score"] == pytest.approx(float(np.interp(vote(i), knots, values)), abs=0.05), i


# ---- op8
def test_mixing_plan_by_loops(spark):
    """Every source gives whole epochs and the first part of one more, in its order, up to its quota."""
    rng = random.Random(13)
    rows = [(i, "w " * rng.randrange(1, 9), rng.choice(["a", "a", "a", "b", "", None])) for i in range(400)]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mixing_plan(t, max_repeats=1.5).collect()
    assert {r["source"] for r in plan} == {"a", "b", "", None}  # an empty name is not a missing one
    size = Counter()
    for _, text, s in rows:
        size[s] += len(text.split()) + 1
    weight = {r["source"]: r["weight"] for r in plan}
    total = max(size[s] / weight[s] for s in size)
    for s in size:
        quota, placed = weight[s] * total, sorted((r["mix_key"], r["epoch"], r["doc_id"], r["n_tokens"]) for r in plan if r["source"] == s)
        at = 0
        for key, epoch, _, n in placed:
            assert key == pytest.approx(at / quota) and epoch == at // size[s]
            at += n
        assert quota - 1e-6 <= at < quota + 10
        for e in range(int(quota / size[s] + 1e-9)):
            assert sorted(d for _, k, d, _ in placed if k == e) == sorted(i for i, _, x in rows if x == s)


def test_mixing_of_equal_rows_is_the_same_every_time(spark):
    rows = [(1, "same text", "a", n) for n in range(6)] + [(None, "none", "a", n) for n in range(5)] + [(i, "w " * 40, "b", 0) for i in range(10, 30)]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string, uses int")
    out = mixing.mix_documents(t, max_repeats=1.2, budget=600.0)
    again = mixing.mix_documents(t.repartition(7), max_repeats=1.2, budget=600.0)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert out.columns == t.columns and key(out) == key(again) and out.count() == mixing.mixing_plan(t, max_repeats=1.2, budget=600.0).count()


# ---- op9
def test_empty_and_rare_strata(spark, monkeypatch):
    rng = random.Random(14)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" + ("%%%" if i % 6 == 0 else "") for _ in range(30)), ("", None, "en")[i % 3 if i % 7 else 1]) for i in range(9000)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(9000)], "doc_id long, quality int, toxic int")
    apart = quality.quality_verdicts(t, labels)
    strata = lambda df: {r["stratum"] for r in df.select("stratum").distinct().collect()}
    assert strata(apart) == {"=", "", "=en"} and apart.where("kept").count() == 7500
    monkeypatch.setattr(quality, "MAX_STRATA", 1)
    pooled = quality.quality_verdicts(t, labels)
    assert len(strata(pooled)) == 2 and "" in strata(pooled) and pooled.where("kept").count() == 7500


# ---- op10
def test_loss_digest_follows_the_mask_and_roles_come_back(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "us\ner", "x"), (2, 1, "&nl;", "y"), (2, 2, "<|end|>\n", "z")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(t)
    got = {r["conv_id"]: r for r in chat.chat_digests(formatted).collect()}
    whole = "".join(f"{r}\n{x}\n" for c, _, r, x in rows if c == 2)
    assert got[2]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    back = formatted.where("conv_id = 2").select(chat.read_back(F.col("formatted")).alias("t")).first()["t"]
    assert [(x["role"], x["text"]) for x in back] == [(r, x) for c, _, r, x in rows if c == 2]
    wrong = formatted.withColumn("segments", F.transform("segments", lambda s: F.struct(s["text"].alias("text"), (~s["loss"]).alias("loss"))))
    flipped = {r["conv_id"]: r for r in chat.chat_digests(wrong).collect()}
    assert flipped[1]["loss_sha256"] != got[1]["loss_sha256"] and flipped[1]["turns_sha256"] == got[1]["turns_sha256"]


# ---- columns whose names clash with those used inside
def test_stages_take_clashing_columns(spark):
    import corpus_pipeline as cp

    names = ["odds", "uses", "row", "id", "hash", "key_id", "key_hash", "rows", "copy", "times", "all", "own", "block", "cell", "shown", "th", "stratum"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0
        assert out.where(F.col("odds") != "odds").count() == 0
