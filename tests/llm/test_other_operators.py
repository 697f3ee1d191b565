import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factgrid.llm import chat, langid, pitman_yor, reshard
from tests.llm.conftest import prose


def test_flow_is_cheapest_and_full():
    assert reshard.transfers([50, 10, 0], [20, 20, 20]) == {(0, 0): 20, (1, 1): 10, (0, 1): 10, (0, 2): 20}
    rng = random.Random(3)
    for _ in range(20):
        old = [rng.randint(0, 90) for _ in range(5)]
        new = [sum(old) // 8 + (j < sum(old) % 8) for j in range(8)]
        x = reshard.transfers(old, new)
        assert all(sum(v for (a, _), v in x.items() if a == i) == s for i, s in enumerate(old)) and all(sum(v for (_, b), v in x.items() if b == j) == s for j, s in enumerate(new))
        assert sum(v for (a, b), v in x.items() if a == b) == sum(min(a, b) for a, b in zip(old, new, strict=False))


def test_shards(with_nulls, rows, empty):
    got = reshard.sharded(with_nulls).toPandas()
    assert len(got) == len(rows) + 2 and (got.law == "bytes").all() and got["shard"].between(0, 39).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all((s, c) == (len(text[d]) + 16, zlib.crc32(text[d])) for d, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True) if d == d)
    assert reshard.sharded(empty).count() == 0


def test_shards_of_many_documents_are_near_equal(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(k, "x" * min(30_000, int(rng.paretovariate(1.5) * 200)), "hot" if k % 3 else f"s{k % 7}") for k in range(3000)], "doc_id long, text string, source string")
    size = reshard.sharded(df).groupBy("shard").agg(F.sum("size").alias("n")).toPandas().n
    assert len(size) == 40 and size.max() - size.min() <= 0.01 * size.mean()


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, valid string")


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "a\\b\\", "", None, "[AN", "<s>\\[/ANS]", "[/TURN][TURN]x[/NAME]", "é\n\n", "\\" * 5 + "</s>"]
    rows = [(c, k, ["user", "assistant", "system", "tool [/NAME]", None][(c + k) % 5], said[(3 * c + k) % len(said)], "x") for c in range(12) for k in range(c % 6 + 1)]
    rows += [(None, 0, "user", "q", "x"), (None, None, "assistant", "a", "x"), (40, 1, "user", "same", "x"), (40, 1, "user", "same", "x")]
    out = chat.formatted(turns(spark, rows))
    got = {r["conv_id"]: r for r in chat.digests(out).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((r[1] is None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        named = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), hashlib.sha256(named.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in out.collect():
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"] and len(r["formatted"]) == got[r["conv_id"]]["formatted_chars"]


@pytest.mark.parametrize("roles, at", [(["system", "user", "assistant"], None), (["user"], None), (["assistant"], 0), (["user", "user"], 1), (["system"], 1), ([], 0), (["user", "assistant", "system"], 2)])
def test_turn_order(roles, at):
    assert chat.fault(roles) == at


def test_languages(spark, with_nulls, empty):
    rng = random.Random(1)
    make = {"en": ["the", "thing", "with", "and", "then"], "de": ["der", "über", "schön", "und", "zeit"], "fr": ["été", "que", "leau", "dans", "où"]}
    rows = [(k, " ".join(rng.choice(make[x]) for _ in range(rng.randint(5, 60))), x) for k, x in enumerate(sorted(make) * 60)]
    rows += [(900, None, "en"), (901, "12 34", "en"), (902, "the thing with", None)]
    out = {r["doc_id"]: r for r in langid.evaluated(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[k]["lang_pred"] == x for k, _, x in rows[:-3]) and out[902]["lang_pred"] == "en" and {out[k]["lang_pred"] for k in (900, 901)} == {"und"}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for k, r in out.items())
    assert any(r["held_out"] for r in out.values())
    assert langid.evaluated(with_nulls).count() == with_nulls.count() and langid.evaluated(empty).count() == 0
    nothing = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.evaluated(nothing).first()["lang_pred"] == "und"


def test_kneser_ney_sums_to_one():
    texts = ["abab abba baab", "aabb abab"]
    models = langid.Models(["x"], [langid.fitted(texts)])
    contexts = langid.characters("abab ab")
    total = 0.0
    for c in [*map(chr, range(32, 32 + langid.ALPHABET))]:
        chars = langid.np.append(contexts, langid.characters(f"q{c}q" if c.strip() else "q q")[langid.ORDER])
        if c == c.lower() and (c == " " or not c.isspace()):
            total += float(langid.np.exp(models._log_p(langid.ORDER, chars, langid.np.array([len(chars) - 1]))[0, 0]))
    assert 0.9 < total <= 1.05


def test_scores_of_the_corpus(with_nulls, rows, empty):
    docs = [*((r[0], r[1]) for r in rows), (None, "a document without a name, of more than twenty characters"), (None, None)]
    words = [(d, (t or "").encode().lower().split() + [b" end"]) for d, t in docs]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, ws in words if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for d, ws in words)
    out = pitman_yor.evaluated(with_nulls).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out) == want
    assert all(r["score"] < 0 for r in out) and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert pitman_yor.evaluated(empty).count() == 0


def test_tables_of_a_restaurant():
    rng = pitman_yor.np.random.default_rng(1)
    customers = pitman_yor.np.array([0, 1, 2, 50, 5000] * 200, dtype=float)
    few, many = (pitman_yor.seated(customers, pitman_yor.np.full(1000, a), 0.75, rng) for a in (1e-9, 1e9))
    assert (few == pitman_yor.np.minimum(customers, 1)).all() and (many >= customers * 0.99).all() and prose(random.Random(1), 3)


def test_little_moves_and_untouched_shards_stay(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(k, "x" * rng.randint(100, 900), f"s{k % 50}") for k in range(4000)], "doc_id long, text string, source string")
    placed = reshard.resharded(df, F.col("source"))
    m = reshard.moved_bytes(placed).first()
    assert m["least"] <= m["moved"] <= m["least"] + 0.08 * m["total"] and m["moved"] < 0.5 * m["total"]
    same = spark.createDataFrame([(k, "x" * 100, f"s{k:02d}") for k in range(40)], "doc_id long, text string, source string")
    assert reshard.resharded(same, F.col("source")).where("_fg_touched").count() == 0
    got = reshard.sharded(same).toPandas()
    assert sorted(got["shard"]) == list(range(40)) and (got["shard"] == got["old_shard"]).all() and (got.slot == 0).all()


def test_many_old_shards_and_null(spark, monkeypatch):
    monkeypatch.setattr(reshard, "MAX_OLD", 8)
    df = spark.createDataFrame([(k, "x" * 50, f"s{k}" if k % 5 else None) for k in range(300)], "doc_id long, text string, source string")
    placed = reshard.resharded(df, F.col("source"))
    of_null = {r["_fg_old"] for r in placed.where("source is null").collect()}
    assert len(of_null) == 1 and not of_null & {r["_fg_old"] for r in placed.where("source is not null").collect()}
    got = reshard.sharded(df).toPandas()
    assert sorted(got.doc_id) == list(range(300)) and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_many_languages_keep_to_the_bytes(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {x: ["".join(rng.choices(rng.sample(letters, 6), k=rng.randint(3, 8))) for _ in range(40)] for x in range(230)}
    rows = [(10 * x + k, " ".join(rng.choices(words[x], k=60)), f"l{x:03d}") for x in words for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    def size(m):
        return sum(x.nbytes for a in (m.gamma, m.p) for x in a) + sum(h.keys.nbytes for a in (m.contexts, m.grams) for h in a)

    models = langid.learnt(df)
    assert len(models.languages) == 230 and size(models) <= langid.MAX_MODEL_BYTES
    assert sum(models.predict(t)[0] == x for _, t, x in rows) > 0.95 * len(rows)
    assert models.predict(" ".join(rng.choices(words[7], k=50_000)))[0] == "l007"
    few = langid.learnt(df, max_bytes=80 << 20)  # a sample so small learns little, but all languages and within the bytes
    assert few.languages == models.languages and size(few) <= 80 << 20
