"""Problems 1 and 5 against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import boilerplate, neardup

D = "document_id string, source string, created_at timestamp_ntz, text string"
C = "chunk_id string, document_id string, text string, source string"


def frames(spark, documents, chunks):
    made = spark.createDataFrame([(d, s, "other") for d, s in documents], "document_id string, source string, text string").withColumn("created_at", F.lit("2021-01-01").cast("timestamp_ntz"))
    return spark.createDataFrame([(c, d, t, "clash") for c, d, t in chunks], C), made


def test_repeated_lines_rule(spark):
    documents = [(f"d{i}", "s") for i in range(6)] + [("x", None), ("e", "t")]
    chunks = [(f"c{i}", f"d{i}", f"Body number {i} here\n© 20{i}: All Rights Reserved!\nshort\n") for i in range(4)]
    chunks += [("c0", "d0", chunks[0][2]), ("n", "d4", None), ("z", "x", "all rights reserved"), ("q", None, "all rights reserved"), ("m", "d5", "Other text\r")]
    c, d = frames(spark, documents, chunks)
    lines, counts = boilerplate.repeated_lines(c, d)
    assert {(r.chunk_id, r.line_no) for r in lines.collect()} == {(f"c{i}", k) for i in range(4) for k in (0, 1)}
    row = [r for r in counts.collect() if r.n_documents == 4][0]
    assert row.source_documents == 6
    assert boilerplate.repeated_lines(c.where("false"), d)[0].count() == 0
    assert boilerplate.repeated_lines(c, d.where("false"))[0].count() == 0


def test_clusters_and_dates_are_made_only_for_a_rule_that_reads_them(spark):
    c, d = frames(spark, [(f"d{i}", "s") for i in range(4)], [(f"c{i}", f"d{i}", f"one of the notices\nwords of text {letters(i)}") for i in range(4)])
    plans = []
    for rule in ({}, {"min_clusters": 2}, {"min_dates": 1}):
        lines, counts = boilerplate.repeated_lines(c, d, **rule)
        assert ("n_clusters" in counts.columns) == ("min_clusters" in rule)
        assert {(r.chunk_id, r.line_no) for r in lines.collect()} == {(f"c{i}", 0) for i in range(4)}
        plans.append(lines._jdf.queryExecution().optimizedPlan().toString())
    assert ["bit_xor" in p for p in plans] == [False, True, False]
    assert ["published" in p for p in plans] == [False, False, True]


def test_a_document_of_two_dates_counts_once(spark):
    c, d = frames(spark, [("d0", "s"), ("d1", "s")], [(f"c{i}", f"d{i}", "one of the notices") for i in range(2)])
    later = d.where("document_id = 'd1'").withColumn("created_at", F.lit("2022-01-01").cast("timestamp_ntz"))
    assert boilerplate.repeated_lines(c, d.unionByName(later))[0].count() == 0


def test_copies_of_one_document_are_kept(spark):
    documents = [(f"d{i}", "s") for i in range(5)]
    chunks = [(f"c{i}", f"d{i}", "the very same sentence\nof a copied document") for i in range(5)]
    c, d = frames(spark, documents, chunks)
    assert boilerplate.repeated_lines(c, d)[0].count() == 10
    assert {r.n_removed for r in boilerplate.without_repeated_lines(c, d).collect()} == {0}


def letters(i):
    return "".join(chr(97 + int(d)) for d in f"{i:04}")


def test_copies_do_not_make_the_share(spark):
    copied = "the very same sentence\nof a copied document"
    bodies = [copied] * 20 + [f"the very same sentence\nwords of text {letters(i)}" for i in (1, 2)] + [f"words of text {letters(i)}\nshared by many here" for i in range(3, 40)]
    documents = [(f"d{i}", "s") for i in range(len(bodies))]
    c, d = frames(spark, documents, [(f"c{i}", f"d{i}", b) for i, b in enumerate(bodies)])
    assert boilerplate.repeated_lines(c, d)[0].where("chunk_id in ('c0', 'c20')").count() == 3
    out = {r.chunk_id: r.text for r in boilerplate.without_repeated_lines(c, d).collect()}
    assert out["c0"] == copied and out["c20"] == bodies[20]
    assert out["c30"] == bodies[30].split("\n")[0]


def test_edited_uploads_of_one_day_are_kept(spark, tmp_path):
    from lectern.llm.queries import queries

    bodies = [f"the very same sentence\nedited on upload {letters(i)}" for i in range(3)] + [f"words of text {letters(i)}\nshared by many here" for i in range(3, 8)]
    c, d = frames(spark, [(f"d{i}", "s") for i in range(len(bodies))], [(f"c{i}", f"d{i}", b) for i, b in enumerate(bodies)])
    day = F.regexp_extract("document_id", r"\d+", 0).cast("int")
    d = d.withColumn("created_at", F.date_add(F.lit("2021-01-01").cast("date"), F.when(day < 3, 0).otherwise(day)).cast("timestamp_ntz"))
    for name, made in (("chunks", c), ("documents", d)):
        made.write.parquet(f"{tmp_path}/{name}.parquet")
    out = {r.chunk_id: r.text for r in queries()["p1_clean"](spark, str(tmp_path)).collect()}
    assert [out[f"c{i}"] for i in range(3)] == bodies[:3]
    assert [out[f"c{i}"] for i in range(3, 8)] == [b.split("\n")[0] for b in bodies[3:]]


def test_an_article_reprinted_with_edits_keeps_its_lines(spark):
    article = ["the harbour was quiet in the early morning", "ships waited for the tide outside the wall", "the pilot counted lamps along the quay", "rain moved slowly over the western hills", "nobody spoke until the bell had rung"]
    reprints = ["\n".join([*article, f"this edition was revised by printer {letters(i)}"]) for i in range(4)]
    notice = "subscribe to receive our weekly bulletin"
    others = [f"{letters(10 * i + 1)} wrote about the garden wall {letters(i)}\nanother thought on matter {letters(700 + i)}\n{notice if i < 4 else letters(i) * 3}" for i in range(8)]
    bodies = reprints + others
    c, d = frames(spark, [(f"d{i}", "s") for i in range(12)], [(f"c{i}", f"d{i}", b) for i, b in enumerate(bodies)])
    d = d.withColumn("created_at", F.date_add(F.lit("2021-01-01").cast("date"), F.regexp_extract("document_id", r"\d+", 0).cast("int")).cast("timestamp_ntz"))
    for rule in ({}, {"min_dates": 3}):
        out = {r.chunk_id: r.text for r in boilerplate.without_repeated_lines(c, d, **rule).collect()}
        assert [out[f"c{i}"] for i in range(4)] == reprints
        assert [out[f"c{i}"] for i in range(4, 8)] == [b.removesuffix("\n" + notice) for b in others[:4]]
        assert [out[f"c{i}"] for i in range(8, 12)] == others[4:]


def test_a_hot_band_gives_no_pairs(spark):
    forms = spark.createDataFrame([("s", k, f) for k in range(2000) for f in (30 << 54, (20 << 54) + k)], "source string, class long, form long")
    out = boilerplate.similar_classes(forms).collect()
    assert len(out) == 2000 and len({r.cluster for r in out}) > 1900


def test_lines_are_taken_out_and_others_unchanged(spark):
    documents = [(f"d{i}", "s") for i in range(4)]
    bodies = ["alpha beta  gamma ", "delta\tepsilon zeta", "eta theta iota kappa", "lambda mu nu xi omicron"]
    chunks = [(f"c{i}", f"d{i}", f"{b}\nShare this with friends [{i}]\n\n{b}") for i, b in enumerate(bodies)] + [("n", "d0", None), ("e", "d1", "")]
    c, d = frames(spark, documents, chunks)
    out = {r.chunk_id: (r.text, r.n_removed) for r in boilerplate.without_repeated_lines(c, d).collect()}
    assert all(out[f"c{i}"] == (f"{b}\n\n{b}", 1) for i, b in enumerate(bodies))
    assert out["n"] == (None, 0) and out["e"] == ("", 0)


def records(spark, rows):
    return spark.createDataFrame(rows, "item_table string, id string, text string")


def brute(rows, threshold):
    once = {(t, i): x for t, i, x in rows if x and i}
    out = set()
    for (t, a), x in once.items():
        for (u, b), y in once.items():
            if t == u and a < b and len(neardup.words(x)) >= 15 and len(neardup.words(y)) >= 15 and neardup.jaccard(x, y) >= threshold:
                out.add((t, a, b))
    return out


def test_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["naïve", "Äpfel", "x_y"]
    rows = []
    for i in range(60):
        words = rng.choices(vocabulary, k=40)
        rows.append(("chunks", f"a{i:03}", " ".join(words)))
        edited = list(words)
        for _ in range(rng.randrange(0, 6)):
            edited[rng.randrange(40)] = rng.choice(vocabulary)
        rows.append((rng.choice(["chunks", "exam_questions"]), f"b{i:03}", " ".join(edited)))
    rows += [("chunks", "short", "too few words"), ("chunks", "null", None), (None, "t", rows[0][2]), ("chunks", None, rows[0][2]), rows[0], ("chunks", "copy", rows[0][2].upper())]
    found = neardup.pairs(*neardup.links(records(spark, rows)))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute([r for r in rows if r[0]], 0.6)


def test_groups_without_pairs_of_copies(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [("chunks", f"c{i}", text) for i in range(50)] + [("chunks", "near", text + " more"), ("chunks", "far", " ".join(f"other{i}" for i in range(30)))]
    membership, linked = neardup.links(records(spark, rows))
    out = {r.id: r for r in neardup.groups(records(spark, rows)).collect()}
    assert len(out) == 52 and linked.count() == 1
    assert out["c0"].group_id == out["near"].group_id == out["c49"].group_id != out["far"].group_id
    assert neardup.pairs(membership, linked).count() == 50 * 49 // 2 + 50


def test_empty_records(spark):
    made = records(spark, [("chunks", "a", "x")])
    membership, linked = neardup.links(made)
    assert membership.count() == 0 and neardup.pairs(membership, linked).count() == 0 and neardup.groups(made).count() == 0


def parted(rows):
    """The sets of ids that hang together over pairs or copies, by brute force."""
    of = {(t, i): (t, i) for t, i, x in rows if len(neardup.words(x)) >= 15}

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for t, a, b in brute(rows, 0.6):
        of[top((t, a))] = top((t, b))
    out = {}
    for x in of:
        out.setdefault(top(x), set()).add(x)
    return sorted(map(sorted, out.values()))


def test_groups_equal_the_components_of_all_pairs(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for family in range(6):  # chains of edits: the ends of a family are no pair
        words = rng.choices(vocabulary, k=40)
        for i in range(25):
            words = list(words)
            words[rng.randrange(40)] = rng.choice(vocabulary)
            rows.append(("chunks", f"f{family}-{i:02}", " ".join(words)))
    for paired in (2, 16):
        out = {}
        for r in neardup.groups(records(spark, rows), paired=paired).collect():
            out.setdefault(r.group_id, set()).add((r.item_table, r.id))
        assert sorted(map(sorted, out.values())) == parted(rows)


def test_thousands_of_edited_copies_of_one_text(spark):
    words = [f"word{i}" for i in range(60)]
    rows = [("chunks", f"c{i:04}", " ".join([*words[: i % 55], f"edit{i}", *words[i % 55 + 1 :]])) for i in range(5000)]
    out = neardup.groups(records(spark, rows)).collect()
    assert len(out) == 5000 and len({r["class"] for r in out}) == 5000 and len({r.group_id for r in out}) == 1


def test_chance_agreement_is_corrected():
    random_ = np.random.default_rng(4)
    for n, m, common in ((20, 20, 0), (500, 60, 30), (200, 200, 150)):
        agreeing = []
        for _ in range(200):
            hashes = random_.integers(0, 2**63, n + m - common, dtype=np.uint64) * np.uint64(2) + random_.integers(0, 2, n + m - common, dtype=np.uint64)
            both = np.concatenate([hashes[:n], hashes[n - common :]])
            a, b = neardup.registers(both, np.array([0, n]), neardup.REGISTERS)
            agreeing.append((a == b).mean())
        chance = neardup.agree_by_chance(np.array([float(n), float(m)]))[0, 1]
        assert 0 < chance < 0.01
        assert abs((np.mean(agreeing) - chance) / (1 - chance) - common / (n + m - common)) < 0.02
    least = neardup.least_agreeing(0.6)
    assert all(20 < x < neardup.REGISTERS for row in least for x in row)
