"""Names and record matching."""

import random

import numpy as np
from pyspark.sql import functions as F

from biblyst.llm.matching import alike, bare_doi, calibrate, compare, flip_patterns, hit_rate, journal_words, match_records, plan_tables, title_relation, title_words
from biblyst.llm.names import average_linkage, edits, given_similarity, grams, link_names, readings, similar_strings


def test_readings():
    assert readings("Lee, Ann B.") == (("lee", "ann", "b"),)
    assert ("lee", "ann", "") in readings("Dr. Ann Lee, Jr.") or ("lee", "ann", "") in readings("Dr. Ann Lee Jr.")
    assert ("muller", "j", "p") in readings("J.P. Müller") and ("muller", "j", "") in readings("Mueller, J")
    assert ("pelav", "jose", "") in readings("Pelav José") and readings("Madonna") == () and readings("") == ()


def test_edits_and_given_names():
    assert [edits(a, b) for a, b in (("ab", "ba"), ("abc", "abd"), ("abc", "xyz"), ("", ""))] == [1, 1, 3, 0]
    assert given_similarity("bob", "robert") == 1 == given_similarity("becky", "rebecca") and given_similarity("jose", "jonas") == 0


def test_average_linkage():
    s = np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]])
    g = average_linkage(s, 0.5)
    assert g[0] == g[1] != g[2]
    assert len(set(average_linkage(s, 0.1).tolist())) == 1 and average_linkage(np.zeros((0, 0)), 0.5).tolist() == []


def test_similar_strings_exact_above_threshold(spark):
    a = ["galastorano", "galastroano", "velindor", "coraklin", "zzz"]
    b = ["galastorano", "galaltanoja", "velindorstrom", "coraklinelli", "coraklin"]
    df = {}
    for s in [*a, *b]:
        for g in grams(s):
            df[g] = df.get(g, 0) + 1
    w = lambda s: {g: np.sqrt(np.log(1 + 10 / df[g])) for g in grams(s)}
    cos = lambda x, y: sum(x[g] * y[g] for g in x if g in y) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    want = {(x, y) for x in a for y in b if cos(w(x), w(y)) >= 0.42}
    got = similar_strings(spark.createDataFrame([(x,) for x in a], "s string"), spark.createDataFrame([(x,) for x in b], "s string"))
    assert {(r["a"], r["b"]) for r in got.collect()} == want


def test_link_names(spark):
    people = spark.createDataFrame(
        [("p1", "José", "Oltvisnak", "José D. Oltvisnak"), ("p2", "Jonas", "Oltvisnak", "Jonas Oltvisnak"), ("p3", "Rebecca", "Goromrik", "Rebecca Goromrik"), ("p4", None, None, "GOROMRIK, R."), ("p5", None, None, None), ("p6", "Tamar", "Velindor", None), ("p6", "Tamar", "Velindor", None)],
        "sid string, first string, last string, full string",
    )
    names = ["José D. Oltvisnak", "Oltvisnak, Jonas", "J. Oltvisnak", "Becky Goromrik", "Goromirk, Rebecca", "R. Goromrik", "Tamar Velindro", "Anna Velindor", "Centre of Trade", "", None, "tamar velindor", "José D. Oltvisnak"]
    v = spark.createDataFrame([(f"h{k}", 1, n) for k, n in enumerate(names)], "handle string, author_pos int, author_name string").withColumn("sid", F.lit("clash"))
    listed = spark.createDataFrame([("p2", "h2"), ("p2", "h2"), (None, "h3")], "sid string, handle string")
    got = {}
    for r in link_names(v, "author_name", ["handle", "author_pos"], people, listed, "handle").collect():
        got.setdefault(r["handle"], set()).add(r["sid"])
    assert got["h0"] == {"p1"} == got["h12"] and got["h1"] == {"p2"} == got["h2"]
    assert got["h3"] == {"p3", "p4"} == got["h5"] and "p3" in got["h4"]
    assert got["h6"] == {"p6"} == got["h11"] and not {"h7", "h8", "h9", "h10"} & set(got)
    assert link_names(v.limit(0), "author_name", ["handle", "author_pos"], people).count() == 0
    assert link_names(v, "author_name", ["handle", "author_pos"], people.limit(0)).count() == 0


def test_titles():
    r = lambda a, b: title_relation(title_words(a), title_words(b))[0]
    t = "Heat pumps and the digital response of nurses: evidence from Falagkheim"
    assert r(t, "<i>" + t.upper() + "</i>.") == "same" == r(t, "Evidence from Falagkheim: Heat pumps &amp; the digital response of nurses")
    assert r(t, t.replace("digital", "digtial").replace("nurses", "nursse")) == "same" == r(t, t + " [Working paper]")
    assert r(t, "Heat pumps and the digital response of nur") == "part" == r(t, t.replace("digital ", ""))
    assert r(t, t.replace("Falagkheim", "Maremkania")) == "other" and r(t, None) == "none"


def test_compare():
    t = "Heat pumps and the digital response of nurses"
    a = (t, 2010, "jou tra gro cor", None)
    ok = lambda b, known=False: compare(a, b, known)[1]
    assert ok((t, 2012, "jou tra gro cor", None)) and not ok((t, 2019, a[2], None))
    assert not ok((t, 2010, "tax qua nor", None), True) and ok((t, 2010, "ope arc x", None))
    # a dropped subtitle or a cut end is a part, another place is not
    assert compare((t + ": evidence from Falagkheim", 2010, None, None), (t, 2010, "ope arc x", None), False)[1]
    assert not compare((t + ": evidence from Falagkheim", 2010, "j", None), (t + ": evidence from Maremkania", 2010, "j", None), True)[1]
    assert compare(("A", 2010, "j", "10.1234/x"), (None, None, None, "10.1234/x"), False)[1]
    # the features do not know the identifier
    assert compare(("A b", 2010, "j", "10.1/x"), ("A b", 2010, "j", "10.1/y"), False)[2] == compare(("A b", 2010, "j", None), ("A b", 2010, "j", None), False)[2]


def test_keys(spark):
    rows = [("doi:10.1234/Ab,", "Journal of Trade & Growth (COR)"), ("10.1234%2Fab", "Jou. Tra. Gro. (Cor.)"), ("none", ""), (None, None)]
    got = spark.createDataFrame(rows, "d string, j string").select(bare_doi(F.col("d")), journal_words(F.col("j"))).collect()
    assert [tuple(r) for r in got] == [("10.1234/ab", "jou tra gro cor"), ("10.1234/ab", "jou tra gro cor"), (None, ""), (None, None)]


def test_probing_plan():
    f = flip_patterns()
    assert not f[0].any() and len({tuple(x) for x in f}) == len(f)
    assert hit_rate(14, 0, 0.001) > 0.99 > hit_rate(14, 0, 20) > hit_rate(14, 0, 40) and hit_rate(19, 2, 20) < hit_rate(17, 0, 20)
    small, large = plan_tables(100), plan_tables(10_000_000)
    assert small.bits < large.bits and small.fixed == 0 < large.fixed and small.whole < large.whole


def test_alike_masks():
    m = lambda *bits: np.array([sum(1 << b for b in bits)], np.uint64)
    # one bit of a short mask may lack, and a part of a long one
    assert alike(m(1), m(2), 0.4, 1)[0] and not alike(m(1, 2, 3), m(1, 5, 6, 7), 0.0, 1)[0] and alike(m(1, 2, 3), m(1, 5, 6, 7), 0.4, 1)[0]


def test_calibration_rises():
    c = np.linspace(0, 1, 200)
    slope, offset = calibrate(c[:, None], (c > 0.6).astype(float))
    assert slope > 5 and -offset / slope < 0.8


def test_match_records(spark):
    name = lambda k: "".join(chr(97 + (k * 7919 + 13) // 26**i % 26) for i in range(4)) + "or"
    title = lambda k: f"Heat {name(k)} pumps and the {name(k + 101)} response of {name(k + 211)} in {name(k + 307)}land and {name(k + 409)}"
    left = [(f"h{k}", title(k), 2000 + k % 20, f"Journal of Field{k % 5} Growth", f"10.1234/{k}" if k % 2 else None) for k in range(60)] + [("n", None, None, None, None)]
    # enough other records that a word of two records is a rare one
    left += [(f"o{k}", title(1000 + k), 2000 + k % 20, "Other", None) for k in range(3000)]
    right = [(f"w{k}", t.upper() if k % 3 else t[:-2], y + k % 2 if k % 7 else None, j if k % 5 else None, d) for k, (_, t, y, j, d) in enumerate(left[:40])] + [("x", "Quite another title of no article here", 2005, None, None), ("y", None, None, None, None)]
    right.append(("twin", *right[1][1:]))  # alike in everything
    ldf = spark.createDataFrame(left + left[:3], "id string, title string, year int, journal string, doi string").withColumn("cosine", F.lit(1))
    rdf = spark.createDataFrame(right + right[:3], "id string, title string, year int, journal string, doi string")
    got = {r["right_id"]: r for r in match_records(ldf, rdf).collect()}
    assert got["w1"]["left_id"] == "h1" and got["twin"]["left_id"] == "h1"
    hits = sum(got[f"w{k}"]["left_id"] == f"h{k}" for k in range(40) if f"w{k}" in got)
    assert hits >= 36 and not {"x", "y"} & set(got) and all(0 <= r["confidence"] <= 1 for r in got.values())
    # many records of one title and journal: each right one meets its own year
    many = [(f"e{k}", "Erratum", 1900 + k % 100, f"Journal of Field{k % 5} Growth", None) for k in range(500)]
    mdf = spark.createDataFrame(many, "id string, title string, year int, journal string, doi string")
    hit = {r["right_id"]: r["left_id"] for r in match_records(mdf, mdf.where("id < 'e2'")).collect()}
    year = {i: (y, j) for i, _, y, j, _ in many}
    assert len(hit) >= 100 and all(year[a] == year[b] for a, b in hit.items())
    assert match_records(ldf.limit(0), rdf).count() == 0 and match_records(ldf, rdf.limit(0)).count() == 0


def test_calibration_sees_every_rejected_best_candidate(spark, monkeypatch):
    from biblyst.llm import matching

    seen = []
    monkeypatch.setattr(matching, "calibrate", lambda c, y: seen.append(y) or calibrate(c, y))
    name = lambda k: "".join(chr(97 + (k * 7919 + 13) // 26**i % 26) for i in range(4)) + "or"
    title = lambda k: f"Heat {name(k)} pumps and the {name(k + 101)} response of {name(k + 211)} in {name(k + 307)}land and {name(k + 409)}"
    journals = ["Annals of Alpine Growth", "Review of Boreal Trade"]
    left = [(f"h{k}", title(k), 2000 + k % 20, journals[k % 2], f"10.1234/{k}") for k in range(60)]
    # 40 works of the same title in another journal with another identifier, 20 true ones
    right = [(f"w{k}", t, y, journals[(k + 1) % 2] if k < 40 else j, f"10.9999/{k}" if k < 40 else d) for k, (_, t, y, j, d) in enumerate(left)]
    schema = "id string, title string, year int, journal string, doi string"
    got = {r["right_id"] for r in match_records(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()}
    assert got == {f"w{k}" for k in range(40, 60)}
    assert len(seen[0]) == 60 and (seen[0] == 0).sum() == 40


def test_identifier_of_many_records_still_joins(spark):
    # so many short words slip that only the identifier, which 250 records carry, brings the pair together
    def title(k, slip=False):
        g = random.Random(k)
        w = ["".join(g.choices("abcdefghijklmnop", k=n)) for n in [12] * 4 + [5] * 8]
        return " ".join(x[0] + "q" + x[2] + "q" + x[4] if slip and len(x) == 5 else x for x in w)

    left = [(f"h{k}", title(k), 2005, "Journal of Trade Growth", "10.1234/copied") for k in range(250)]
    right = [("w", title(7, True), 2005, "Journal of Trade Growth", "10.1234/copied"), ("late", title(7, True), 2019, "Journal of Trade Growth", "10.1234/copied")]
    schema = "id string, title string, year int, journal string, doi string"
    got = match_records(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()
    assert [(r["left_id"], r["right_id"]) for r in got] == [("h7", "w")]
