"""Leaks, mixing and sentences."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from biblyst.llm.leaks import HammingIndex, SizedIndex, hashed_letters, leaks, similar_passages, simhash
from biblyst.llm.mixing import entropy, entropy_weights, mix_sources, pieces, temperature_weights, tilted_weights
from biblyst.llm.sentences import closing, emitted, events, lex, scan, scan_back, sentences, split_text, transitions

U = np.uint64


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**31), st.integers(0, 5))
def test_all_prints_within_the_radius(seed, radius):
    rng = np.random.default_rng(seed)
    p = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    q = p[rng.integers(0, 60, 40)].copy()
    for i in range(40):
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            q[i] ^= U(1) << U(b)
    want = {(i, j) for i in range(40) for j in range(60) if int(q[i] ^ p[j]).bit_count() <= radius}
    assert set(zip(*map(np.ndarray.tolist, HammingIndex(p, radius).search(q)))) == want


def test_simhash_is_the_majority():
    u = np.random.default_rng(0).integers(0, 1 << 63, 20, dtype=np.uint64)
    for i, h in enumerate(simhash(u, 5)):
        want = sum(1 << b for b in range(64) if sum(int(x) >> b & 1 for x in u[i : i + 5]) > 2)
        assert int(h) == want
    assert len(simhash(u[:3], 5)) == 0


def test_leaks(spark):
    rng = random.Random(4)
    item = [f"w{rng.randrange(500)}" for _ in range(60)]
    zh = "该报告写道公共保险过高企业无力承担这一看法并不普遍教师为何偏好长期税收下降了"
    other = lambda n: [f"x{rng.randrange(500)}" for _ in range(n)]
    docs = [
        (1, " ".join(other(20) + item[10:23] + other(5))),
        (2, " ".join(other(20) + item[10:22] + other(5))),
        (3, "; ".join(w.upper() for w in item)),
        (4, zh[5:30] + "x"),
        (5, zh[5:29] + "x"),
        (6, "，".join(zh)),
        (7, None),
        (8, ""),
        (9, " ".join(other(100_000) + item[:13])),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("lang", F.lit("en"))
    i = spark.createDataFrame([(100, "EN ", " ".join(item)), (101, "zh", zh), (102, "en", "too short"), (103, None, None)], "item_id long, lang string, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks(d, i).collect()) == [(1, 100), (3, 100), (4, 101), (6, 101), (9, 100)]
    near = leaks(d, i, least=0.6, radius=10)
    assert near.where("doc_id = 2 and similarity < 1").count() == 1
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0
    assert hashed_letters([None, "a1，b"])[1].tolist() == [0, 0, 3]


def test_similar_passages(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(2000)}"
    items = [[word() for _ in range(n)] for n in (15, 40, 90)]
    edited = list(items[2])
    edited[20] = "other"
    twice = [*edited[:70], "another", *edited[71:]]  # 76 of 96 runs of five words in common: below 0.8
    half = items[1][:20] + [word() for _ in range(20)]
    docs = [(1, " ".join([word() for _ in range(30)] + edited + [word() for _ in range(9)])), (2, " ".join(items[0]).upper()), (3, " ".join(half)), (4, None), (5, ""), (6, " ".join(items[1][:39])), (7, " ".join(twice))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("similarity", F.lit("clash"))
    i = spark.createDataFrame([(k, "en", " ".join(x)) for k, x in enumerate(items)] + [(8, "en", "too short"), (9, None, None)], "item_id long, lang string, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in similar_passages(d, i).collect()}
    assert set(got) == {(1, 2), (2, 0)} and got[2, 0] == 1 > got[1, 2] >= 0.8
    assert similar_passages(d.limit(0), i).count() == 0 == similar_passages(d, i.limit(0)).count()


def test_recall_of_edited_items_is_at_least_nine_tenths():
    rng = random.Random(2)
    items = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 80))] for _ in range(40)]
    ix = SizedIndex(list(range(40)), [" ".join(x) for x in items], 5, False, 10)
    docs, true = [], set()
    for k in range(200):
        w = list(items[k % 40])
        at = rng.randrange(len(w))
        w[at : at + 1] = rng.choice([["edit"], ["edit", "more"], []])
        docs.append(" ".join(f"x{rng.randrange(900)}" for _ in range(25)) + " " + " ".join(w) + " tail" * 9)
        a, b = ix.shingles(ix.items[k % 40][1]), None
        units = hashed(w)
        b = ix.shingles(units)
        if sum(v for x, v in a.items() if x in b) >= 0.85 * sum({**a, **b}.values()):
            true.add((k, k % 40))
    d, i, _ = ix.find(docs, 0.8)
    assert len(true) > 50 and len(true & set(zip(d.tolist(), i.tolist()))) >= 0.9 * len(true)


def hashed(words):
    from biblyst.llm.text import hashed_words

    return hashed_words([" ".join(words)])[0]


def test_running_sums_equal_separate_ones():
    g = np.random.default_rng(1)
    ix = SizedIndex([1], [" ".join(f"w{k}" for k in range(30))], 5, False, 3)
    u = g.integers(0, 1 << 63, 70_000, dtype=np.uint64)
    every = ix.prints(u, [13, 30])
    assert len(every[13]) == 70_000 - 12
    for n in (13, 30):
        for at in (0, 65_530, 65_536, 70_000 - n):
            assert ix.prints(u[at : at + n], [n])[n][0] == every[n][at]


def test_entropy_of_a_mix_meets_its_limits():
    w, a = entropy_weights([800, 150, 50], 1.0, [9, 9, 9], 500)
    assert abs(entropy(w) - 1.0) < 1e-6 and a < 1
    # the smallest source may not be repeated: the exponent moves back towards the natural shares
    v, b = entropy_weights([800, 150, 50], 1.0, [9, 9, 1], 900)
    assert a < b < 1 and v[2] * 900 <= 50 * (1 + 1e-6) and abs(sum(v) - 1) < 1e-9


def test_weights():
    w, a = temperature_weights([0.7, 0.2, 0.1], 1.0)
    assert abs(entropy(w) - 1.0) < 1e-6 and 0 < a < 1
    assert tilted_weights([100, 100], [0.5, 0.5], [1, 1], 200) == ([0.5, 0.5], 1.0)
    w, a = tilted_weights([1000, 10], [0.5, 0.5], [1, 4], 400)
    assert 0 < a < 1 and abs(w[1] * 400 - 40) < 1e-3 and abs(sum(w) - 1) < 1e-9
    assert tilted_weights([0, 10], [0.5, 0.5], [1, 1], 10)[0] == [0.0, 1.0]


def test_mix(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randrange(5, 60)))
    docs = [(k, text(), "Big " if k % 2 else "big") for k in range(600)] + [(1000 + k, text(), "small") for k in range(60)] + [(2000, "x", None), (2001, None, "small"), (2002, "", "big"), (2003, "y", "unknown")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit(1)).withColumn("repeats", F.lit(1))
    t = spark.createDataFrame([("big", 0.6, 1), ("Small", 0.4, 3), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    plan, report = mix_sources(d, t)
    r = {x["source"]: x for x in report.collect()}
    used = {x["source"]: (x["n"], x["m"]) for x in plan.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("n"), F.max("repeats").alias("m")).collect()}
    assert used["small"][1] <= 3 and used["big"][1] <= 1 and r["small"]["used_tokens"] == used["small"][0]
    assert abs(r["big"]["actual_share"] - 0.6) < 0.01 and abs(r["small"]["actual_share"] - 0.4) < 0.01
    assert r[None]["docs"] == 2 and r["none"]["actual_share"] == 0
    plan, report = mix_sources(d, t, total=sum(x["tokens"] for x in report.where("source is not null").collect()))
    r = {x["source"]: x for x in report.collect()}
    assert r["small"]["most_repeats"] == 3 and r["small"]["actual_share"] < 0.4
    assert mix_sources(d.limit(0), t)[0].count() == 0 and mix_sources(d, t.limit(0))[0].count() == 0
    assert "".join(pieces("a bc " * 1000, 100)) == "a bc " * 1000


GOLD = [
    ("The council wrote: \"Wait for prices to settle! Then act.\" Trade matters. No. 8 on the list, i.e. rates, was dropped in Feb. 1991.", 3),
    ("Nothing is known for the U.K. Using data. 1998 saw 16 rules. Trading closed at 8 p.m. Did it? \"Is that all?\" asked the mayor.", 6),
    ("areas are flexible.When bonds tighten, rents fall by 19.6 points. This ends here.2018 saw more.", 4),
    ("3. Results\n\nWelfare rose. (Boards are left to Sec. 4.) Next one.\n\n4.1 Robustness checks\n\nDone.", 6),
    ("„Ohne Kontrollen keine Quote. Das wissen alle“, sagte Prof. Dal. Im 19. Jahrhundert galt das z. B. nie. Am 4. März 1972 usw. gleichermaßen!", 3),
    ("该报告写道：“保险过高。企业无力承担。”这一看法并不普遍。逐渐减弱……但并未消失。高额意料！", 3),
    ("「高い。もう払えない」と述べた。なぜ銀行か？驚き！", 3),
    ("« Les loyers montent. Personne ne l'ignore », écrit Dalov (cf. p. 43). Quelle surprise ! Les prix d'env. 13,8 % baissent-ils ?", 3),
    ("«Где льготы? Их нет», — пишут учителя за 2006 г. По данным на рис. 9, т. е. тут. В 1982 г. общие 27,5 млн. руб. и т. д. растут.", 3),
    ("डॉ. मेलोर के अनुसार बचत है। क्या बैंक पड़ता है? नहीं थी!", 3),
    ("¿Cómo responden los bancos? ¡No esperaban nada! Véase la fig. 8 del cap. 4, pág. 49, según el Dr. Doridan.", 3),
    ("งานวิจัยนี้ศึกษาผล ข้อมูลนี้แสดงว่า", 2),
    ("", 0),
    ("  \n ", 0),
]


@pytest.mark.parametrize("n", range(len(GOLD)))
def test_boundaries(n):
    text, want = GOLD[n]
    got = split_text(text)
    assert len(got) == want, [text[a:b] for a, b in got]
    left = "".join(text[:a] if not i else text[got[i - 1][1] : a] for i, (a, _) in enumerate(got)) + (text[got[-1][1] :] if got else text)
    assert not left.strip()


def test_scan_equals_one_piece():
    text = " ".join(t for t, _ in GOLD if t.strip()) * 5
    pos, sym = lex(text)
    whole = emitted(pos, sym, 0)
    cuts = list(range(0, len(text), 97))
    # the closing marks still to come are what the backward scan hands to each chunk
    later = scan_back([closing(events(text, a, min(a + 97, len(text)))) for a in cuts])
    parts = [lex(text, a, min(a + 97, len(text)), m) for a, m in zip(cuts, later)]
    starts = scan(np.array([transitions(s) for _, s in parts]))
    assert [p for (ps, ss), s in zip(parts, starts) for p in emitted(ps, ss, int(s))] == whole


@pytest.mark.parametrize(("a", "b"), [("“", "”"), ("«", "»"), ("„", "“"), ('"', '"'), ("(", ")"), ("「", "」")])
def test_quotations_of_any_length(a, b):
    said = " ".join(f"Sentence number {k} is said here." for k in range(60))
    text = f"He wrote {a}{said}{b} and left. Then came the rest."
    assert len(said) > 1500
    for chunk in (64, 512, 1 << 20):
        assert [text[x:y][-10:] for x, y in split_text(text, chunk)] == [" and left.", " the rest."]
    # without the closing mark, or with it behind an empty line, it opens nothing
    for broken in (f"He wrote {a}{said}", f"He wrote {a}{said}\n\nMore.{b}"):
        assert len(split_text(broken, 64)) >= 60


def test_a_closing_mark_alone_closes_nothing():
    assert len(split_text('He is 6\'2" tall. She is not. They left.')) == 3


def test_every_chunk_size_gives_the_same_sentences():
    text = "\n\n".join(t.strip() for t, _ in GOLD if t.strip()) * 3
    assert all(split_text(text, n) == split_text(text, 1 << 20) for n in (40, 97, 512))


def test_backward_functions_compose():
    rng = random.Random(1)
    f = [(rng.random() < 0.7, rng.randrange(16)) for _ in range(50)]
    later, want = 0, []
    for keep, add in reversed(f):
        want.append(later)
        later = add | (later if keep else 0)
    assert scan_back(f) == want[::-1]


def test_chunked_documents(spark):
    text = "\n\n".join(t.strip() for t, _ in GOLD if t.strip()) * 6
    df = spark.createDataFrame([(1, text), (2, None), (3, "One. Two."), (4, "")], "doc_id long, text string").withColumn("sent_no", F.lit(0))
    want = [(1, n, a, b) for n, (a, b) in enumerate(split_text(text), 1)] + [(3, 1, 0, 4), (3, 2, 5, 9)]
    for chunk in (500, 1 << 16):
        assert sorted(tuple(r) for r in sentences(df, "doc_id", "text", chunk).collect()) == want
    assert sentences(df.limit(0), "doc_id", "text").count() == 0


def test_entropy_of_equal_shares():
    assert abs(entropy([0.25] * 4) - math.log(4)) < 1e-12


def test_sources_that_may_not_be_used_leave_the_plan_whole(spark):
    d = spark.createDataFrame([(i, "one two three four", "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    for m in (0, -1):
        t = spark.createDataFrame([("a", 0.5, m), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
        plan, report = mix_sources(d, t)
        r = {x["source"]: x for x in report.collect()}
        assert {(x["source"], x["repeats"]) for x in plan.collect()} == {("b", 2)} and plan.count() == 100
        assert r["a"]["used_tokens"] == 0 and r["a"]["max_repeats"] == m and r["b"]["actual_share"] == 1


def test_leaks_of_latin_passages_in_letter_items(spark):
    latin = "panel data from forty seven regions 1998"
    items = spark.createDataFrame([(1, "zh", f"该报告写道{latin}公共保险过高"), (2, "ja", "物価は上昇を続けたが賃金は横ばいであり家計の負担は増している")], "item_id long, lang string, text string")
    docs = spark.createDataFrame([(1, f"We use {latin} here."), (2, "Nothing of it"), (3, "物価は上昇を続けたが賃金は横ばいであり家計の負担は増している。")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks(docs, items).collect()) == [(1, 1), (3, 2)]
