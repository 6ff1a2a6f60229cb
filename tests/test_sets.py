"""Loaders, evaluation, clusters, duplicate rates, streaming, command line."""

import inspect
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import siftmark
from siftmark import cli, session
from siftmark.functions import lexical, shingling
from siftmark.operators import cluster, corpus, evaluate, pairs, perturb, vectors
from siftmark.operators.numbering import with_index
from siftmark.sources import loaders
from siftmark.streaming import digests as stream

SF = "/root/testdata/sf0.001"


def values(df):
    return [r.text for r in df.collect()]


def test_loaders(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" one \n\n\x1c\ntwo\r\nthree", encoding="utf-8")
    assert values(loaders.load_texts(spark, str(tmp_path / "a.txt"))) == ["one", "two", "three"]
    assert values(loaders.load_texts(spark, str(tmp_path / "a.txt"), limit=2)) == ["one", "two"]
    assert len(values(loaders.load_texts(spark, str(tmp_path / "a.txt"), limit=0))) == 3
    (tmp_path / "b.csv").write_text('text,label\n"a ""q"", b\nc",x\n,y\n  ,z\nlast, w \n', encoding="utf-8")
    assert values(loaders.load_texts(spark, str(tmp_path / "b.csv"))) == ['a "q", b\nc', "last"]
    assert values(loaders.load_texts(spark, str(tmp_path / "b.csv"), "label")) == ["x", "y", "z", "w"]
    assert loaders.load_labelled(spark, str(tmp_path / "b.csv")).count() == 4
    assert [tuple(r) for r in loaders.load_labelled_flexible(spark, str(tmp_path / "b.csv")).collect()] == [('a "q", b\nc', "x"), ("last", "w")]
    assert [tuple(r) for r in loaders.load_labelled_flexible(spark, str(tmp_path / "b.csv"), "label", "text", 1).collect()] == [("x", 'a "q", b\nc')]
    spark.createDataFrame([(1, "p"), (None, "q")], "n int, t string").coalesce(1).write.parquet(str(tmp_path / "c.parquet"))
    assert values(loaders.load_texts(spark, str(tmp_path / "c.parquet"))) == ["1"]
    assert values(loaders.load_texts(spark, str(tmp_path / "c.parquet"), "t")) == ["p", "q"]


def test_first_texts_are_in_the_order_of_files(spark, tmp_path):
    """Spark reads large files first; the limit must not."""
    for name, lines in (("a", ["a0", "a1"]), ("b", [f"b{i}" for i in range(5000)]), ("c", ["c0"])):
        (tmp_path / f"{name}.txt").write_text("\n".join(lines))
    assert values(loaders.load_texts(spark, str(tmp_path), limit=1)) == ["a0"]
    assert values(loaders.load_texts(spark, str(tmp_path), limit=4)) == ["a0", "a1", "b0", "b1"]
    assert values(loaders.first_texts(spark.createDataFrame([("x",), ("y",)], "text string").coalesce(1), 1)) == ["x"]
    (tmp_path / "csv").mkdir()
    for name in "zy":
        (tmp_path / "csv" / f"{name}.csv").write_text(f"text,label\n{name}1,l\n{name}2,m\n")
    assert [r.text for r in loaders.load_labelled_flexible(spark, str(tmp_path / "csv"), limit=3).collect()] == ["y1", "y2", "z1"]


def plain_pairs(rows):
    digests = [(siftmark.digest(t), label) for t, label in rows]
    return [(siftmark.similarity(a, b), x == y) for i, (a, x) in enumerate(digests) for b, y in digests[i + 1 :]]


def plain_metrics(pairs, t):
    tp, fp = (sum(s >= t for s, y in pairs if y is z) for z in (True, False))
    fn, tn = (sum(s < t for s, y in pairs if y is z) for z in (True, False))
    p, r = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
    return (t, p, r, 2 * p * r / (p + r) if p + r else 0.0, tp, fp, fn, tn)


@pytest.mark.parametrize("rows,golden", [(loaders.LEXICAL_FAMILIES, (12, 18, 48, 0.6879340277777778, 0.0, 1.0, 0.01)), (loaders.SEMANTIC_FAMILIES, (8, 12, 16, 0.0, 0.0, 0.6, 0.0)), ([("x", "A"), ("x", "A"), ("quite other words", "B")], (3, 1, 2, 1.0, 0.0, 1.0, 0.01))])
def test_evaluation(spark, rows, golden):
    pairs = evaluate.lexical_pairs(loaders.fixture(spark, rows))
    hist = evaluate.histogram(pairs)
    s, b = evaluate.family_summary(hist).first(), evaluate.best_threshold(hist).first()
    assert (s.n_items, s.n_pairs_intra, s.n_pairs_inter, s.mean_intra, s.mean_inter, b.f1, b.threshold) == golden
    want = plain_pairs(rows)
    assert sorted((r.sim, r.is_intra) for r in pairs.collect()) == sorted(want)
    assert [tuple(r) for r in evaluate.threshold_curve(hist, 20).orderBy("threshold").collect()] == [plain_metrics(want, i / 20) for i in range(21)]
    assert evaluate.family_count(loaders.fixture(spark, rows)).first()[0] == len({x for _, x in rows})


def test_evaluation_of_nothing(spark):
    none = spark.createDataFrame([], "id long, text string, label string")
    hist = evaluate.histogram(evaluate.lexical_pairs(none))
    s = evaluate.family_summary(hist, 0).first()
    assert (s.n_items, s.mean_intra, s.mean_inter, s.separation) == (0, 0.0, 0.0, 0.0)
    assert evaluate.best_threshold(hist).first().f1 == 0.0
    with pytest.raises(ValueError):
        evaluate.lexical_pairs(loaders.fixture(spark, loaders.LEXICAL_FAMILIES), max_items=3)


def plain_clusters(unique, bands):
    signatures = [siftmark.LexicalHasher().signature(t) for t in unique]
    root = list(range(len(unique)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    rows = 128 // bands
    for b in range(bands):
        buckets = defaultdict(list)
        for i, s in enumerate(signatures):
            buckets[tuple(s[b * rows : (b + 1) * rows])].append(i)
        for members in buckets.values():
            for i in members[1:]:
                p, q = sorted((top(members[0]), top(i)))
                root[q] = p
    return {i: top(i) for i in range(len(unique))}


@pytest.mark.parametrize("bands", [16, 5, 128])
def test_clusters_equal_plain_union_find(spark, bands):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    signed = cluster.signed(cluster.unique_texts(docs))
    unique = sorted({t for r in docs.collect() if (t := shingling.normalized_text(r.text))})
    assert [r.text for r in signed.orderBy("id").collect()] == unique
    got = {r.id: r.cluster_id for r in cluster.clusters(signed, bands).collect()}
    assert got == plain_clusters(unique, bands)


def plain_bands(texts):
    """Band number and key to the places of texts."""
    hasher, found = lexical.LexicalHasher(), defaultdict(set)
    for i, t in enumerate(texts):
        signature = hasher.signature(t)
        for b in range(16):
            found[b, ":".join(map(str, signature[b * 8 : b * 8 + 8]))].add(i)
    return found


def test_band_queries_cover_all_documents(spark):
    queries, docs = __spark_entry__.queries(), spark.read.parquet(f"{SF}/documents.parquet").collect()
    texts = lambda keep: sorted({t for r in docs if keep(r.doc_id) and (t := shingling.normalized_text(r.text))})
    buckets = plain_bands(texts(lambda d: True))
    got = [tuple(r) for r in queries["lsh_bands_documents"](spark, SF).select("id", "band", "key").collect()]
    assert sorted(got) == sorted((i, b, k) for (b, k), ids in buckets.items() for i in ids)
    got = [tuple(r) for r in queries["lsh_band_collisions_documents"](spark, SF).select("src", "dst").collect()]
    assert got and sorted(got) == sorted({(i, min(ids)) for ids in buckets.values() for i in ids if i != min(ids)})
    even, odd = texts(lambda d: d % 2 == 0), plain_bands(texts(lambda d: d % 2))
    hit = {i for key, ids in plain_bands(even).items() if key in odd for i in ids}
    assert hit and tuple(queries["cross_corpus_lsh_documents"](spark, SF).first()) == (len(even), len(hit), 100 * len(hit) / len(even))


def test_cluster_reports(spark):
    found = __spark_entry__.queries()["lsh_clusters"](spark, SF)
    s = cluster.cluster_stats(found).first()
    assert (s.n_unique, s.n_clusters, s.n_multi, s.n_in_multi) == (189, 176, 13, 26)
    top = __spark_entry__.queries()["top_clusters"](spark, SF).collect()
    assert len({r.cluster_id for r in top}) == 3 and len(top) == 6 and all(len(r.snippet) <= 100 for r in top)
    for bands in (0, 129):
        with pytest.raises(ValueError):
            cluster.lsh_bands(cluster.signed(cluster.unique_texts(spark.read.parquet(f"{SF}/documents.parquet"))), bands)
    empty = cluster.cluster_stats(spark.createDataFrame([], "id long, cluster_id long")).first()
    assert tuple(empty) == (0, 0, 0, 0, 0.0)


def test_duplicate_rates(spark):
    rows = spark.createDataFrame([("A b",), ("a, B!",), ("🔥",), (None,), ("c",)], "text string")
    assert tuple(corpus.exact_dup_rate(rows).first()) == (5, 2, 60.0)
    assert tuple(corpus.exact_dup_rate(rows.limit(0)).first()) == (0, 0, 0.0)
    assert tuple(corpus.cross_exact(rows, rows.where("text = 'c'")).first()) == (2, 1, 50.0)


def test_numbering(spark):
    words = [f"{random.Random(i).random()}" for i in range(500)] + ["z", "z"]
    got = with_index(spark.createDataFrame([(w,) for w in words], "t string").repartition(7), "t").collect()
    assert [r.t for r in sorted(got, key=lambda r: r.id)] == sorted(words) and sorted(r.id for r in got) == list(range(502))
    assert with_index(spark.createDataFrame([], "t string"), "t").count() == 0


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.5])], "id long, v array<double>")
    got = rows.select("id", vectors.unit(F.col("v")).alias("u"), vectors.quantised(F.col("v")).alias("q")).orderBy("id").collect()
    assert got[0].u == [0.6, 0.8] and got[0].q == [95.0, 127.0] and got[1].u == got[1].q == [0.0, 0.0] and got[2].q == [-127.0, 64.0]
    best = {r.query: r.nearest for r in vectors.nearest(rows.select("id", F.col("v").alias("vector"))).collect()}
    assert best == {1: 2, 2: 1, 3: 2}
    rng = random.Random(1)
    data = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(90)] + [(90, None)]  # with ties and equal vectors
    score = lambda x, y: round(sum(p * q for p, q in zip(x, y, strict=True)), 9)
    want = {i: min(((-score(x, y), j) for j, y in data[:90] if i != j))[::-1] for i, x in data[:90]}
    for block in (10, 1000):
        got = vectors.nearest(spark.createDataFrame(data, "id long, vector array<double>"), block).collect()
        assert {r.query: (r.nearest, -r.sim) for r in got} == want
    one = spark.createDataFrame(data[:1], "id long, vector array<double>")
    assert vectors.nearest(one).count() == vectors.nearest(one.limit(0)).count() == 0


def test_perturbation(spark):
    words = F.array(*(F.lit(x) for x in "a b c d e f".split()))
    row = spark.range(1).select(*(perturb.edited(words, k).alias(k) for k in perturb.KINDS)).first()
    assert row.insert == ["a", "b", "c", "d", "e", "zze", "f"] and row.delete == ["a", "b", "c", "d", "f"] and row.substitute == ["a", "b", "c", "d", "zze", "f"] and row.reorder == list("fedcba")
    got = {(r.edit, r.num_perm, r.shingle_size): r.mean_sim for r in perturb.sweep(spark.read.parquet(f"{SF}/benchmark.parquet").select("text")).collect()}
    assert len(got) == 16 and got["reorder", 128, 3] < 0.1 < got["substitute", 128, 3] < got["substitute", 128, 2]


def test_stream(spark, tmp_path):
    got = {(r.conv_id, r.turn): r.digest for r in __spark_entry__.queries()["stream_digest"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        assert got[r.conv_id, r.turn] == siftmark.digest(r.text)


def test_stream_first_seen(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "a b c"), ("2024-01-01 00:10:00", "A, b c"), ("2024-01-01 00:20:00", "other")], "at string, text string").select(F.to_timestamp("at").alias("at"), "text")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = stream.with_digest(stream.read_stream(spark, str(tmp_path / "in"), rows.schema))
    stream.write_stream(stream.first_seen(source, "at"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect())[-1] == "other" and spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["digest", "a b c"]) == 0 and capsys.readouterr().out == siftmark.digest("a b c") + "\n"
    cli.main(["compare", "a b c d", "a b c d"])
    cli.main(["compare-digests", siftmark.digest("x"), siftmark.digest("y")])
    assert capsys.readouterr().out == "1.0000\n0.0000\n"
    (tmp_path / "t.txt").write_text("\n".join(["Some text to look at", "some TEXT to look at!", "another line of words", "x"]))
    code, lines = cli.cluster_report(spark, str(tmp_path / "t.txt"), None, None, 16)
    assert code == 0 and lines[0].endswith(": 4") and "3  (75.0%)" in lines[1] and lines[2].endswith("25.0%")
    (tmp_path / "e.txt").write_text("\n \n")
    assert cli.cluster_report(spark, str(tmp_path / "e.txt"), None, None, 16) == (1, ["no prompts loaded"])
    hasher = siftmark.SemanticHasher(lambda t: [float(len(t)), 1.0, -2.0], 32, 1)
    lines = cli.family_report(spark, "set", loaders.fixture(spark, loaders.LEXICAL_FAMILIES), hasher)
    assert "12 prompts, 3 families" in lines[0] and "intra 0.688" in lines[1] and lines[2].strip().startswith("semantic")


def test_command_line_evaluates(spark, tmp_path, capsys):
    assert cli.main(["evaluate"]) == 0
    out = capsys.readouterr().out
    assert "lexical families  (12 prompts, 3 families)" in out and "intra 0.688" in out and "semantic families  (8 prompts, 2 families)" in out
    path = tmp_path / "set.csv"
    path.write_text("text,label,other\nred fox runs,a,x\nred fox runs,a,\nblue owl sleeps,b,y\n , ,z\n")
    assert cli.main(["evaluate", "--corpus", str(path)]) == 0
    assert "prompts, " in capsys.readouterr().out
    assert cli.main(["families", str(path), "--text-col", "text", "--label-col", "other"]) == 0
    assert "(2 prompts, 2 families)" in capsys.readouterr().out  # empty labels go
    assert cli.main(["families", str(path), "--limit", "2"]) == 0
    assert "(2 prompts, 1 families)" in capsys.readouterr().out
    assert cli.main(["cluster", str(path), "--column", "text", "--limit", "3"]) == 0
    assert "exact-duplicate rate  : 33.3%" in capsys.readouterr().out


def test_first_members_are_cut_before_the_shuffle(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(50)], "id long, cluster_id long").repartition(4)
    ranked = cluster._first_members(rows, 3)
    assert ranked.count() == 6 and "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()


def test_lookup_of_hot_keys_equals_a_join(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "id long, key string")
    found = session.materialize(spark.createDataFrame([("hot", 1), ("k3", 2), ("zz", 3)], "key string, v int"), "found")
    for most in (10, 0):
        monkeypatch.setattr(session, "BROADCAST_ROWS", most)
        for how, n in (("inner", 201), ("left", 300)):
            got = session.lookup(rows, found, ["key"], ["id"], how)
            assert got.columns == ["key", "id", "v"] and got.count() == n and got.where("v = 1").count() == 200


def test_scratch_needs_a_shared_folder_on_a_cluster():
    context = type("C", (), {"applicationId": "app-x", "master": "spark://host", "getConf": lambda s: {}, "getCheckpointDir": lambda s: None})()
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.scratch_dir(type("S", (), {"sparkContext": context})())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 189
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert math.isclose(lexical.similarity(siftmark.digest("a"), siftmark.digest("a")), 1.0)


def test_wide_rows_are_not_broadcast(spark):
    # a few kilobytes of Parquet, 40 MB in the driver
    wide = session.materialize(spark.range(40).select("id", F.repeat(F.lit("x"), F.lit(1_000_000)).alias("text")), "wide")
    narrow = session.materialize(spark.range(40), "narrow")
    assert not session._is_small(wide) and session._is_small(narrow)


def test_evaluation_has_no_limit_by_default():
    for f in (evaluate.lexical_pairs, evaluate.pair_similarities):
        assert inspect.signature(f).parameters["max_items"].default is None


@pytest.mark.parametrize("kernel", [pairs.Slots(), pairs.Bits(70), pairs.Dot()], ids=str)
def test_blocks_of_pairs_equal_a_loop(spark, monkeypatch, kernel):
    for name, size in (("BLOCK", 7), ("PAIRS_BLOCK", 5), ("STEP", 2), ("LEAST", 9)):
        monkeypatch.setattr(pairs, name, size)
    draw = random.Random(5)
    value = (lambda: draw.choice([0.0, -1.5, 0.3])) if kernel == pairs.Dot() else lambda: draw.choice([0, 3, 1 << 40])
    rows = [(i, draw.choice(["p", "q", None]), [value(), value()]) for i in range(40)]
    rows += [(40, "p", None), (41, "q", [None, value()]), (42, "p", [0 * value()] * 2), (7, "q", [value(), value()]), (None, "p", [value(), value()])]
    if isinstance(kernel, pairs.Bits):
        rows = [(i, label, d and [d[0], d[1] and (d[1] & 3) << 62]) for i, label, d in rows]

    def sim(x, y):
        if x is None or y is None or None in x + y:
            return None
        if kernel == pairs.Dot():
            return 0.0 + x[0] * y[0] + x[1] * y[1]
        if kernel == pairs.Slots():
            return sum(p == q for p, q in zip(x, y, strict=True)) / 2 if any(x) and any(y) else 0.0
        return (70 - sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x, y, strict=True))) / 70

    if isinstance(kernel, pairs.Bits):
        rows = [(i, label, d and [d[0], d[1] - (1 << 64) if d[1] and d[1] >= 1 << 63 else d[1]]) for i, label, d in rows]
    df = spark.createDataFrame(rows, "id long, label string, digest array<%s>" % ("double" if kernel == pairs.Dot() else "long"))
    known = [r for r in rows if r[0] is not None]
    want = [(a[0], b[0], sim(a[2], b[2]), a[1] == b[1]) for a in known for b in known if a[0] < b[0]]
    found = evaluate.pair_similarities(df, kernel)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    if kernel != pairs.Dot():
        assert sorted(map(tuple, pairs.histogram(df, kernel).collect()), key=repr) == sorted(map(tuple, evaluate.histogram(found).collect()), key=repr)
    if kernel == pairs.Dot():  # sums of vectors give what the pairs do
        whole = df.where("id < 40 and id <> 7")
        monkeypatch.setattr(pairs, "BLOCK", 1_000)
        some = [(s, intra) for a, b, s, intra in want if b < 40 and 7 not in (a, b)]
        mean, by_blocks = (pairs.means(x, kernel).first() for x in (whole.repartition(2), df.where("id < 40 and id <> 7").unionByName(df.where("id = 40"))))
        for k, kind in ((0, True), (1, False)):
            own = [s for s, intra in some if intra is kind]
            assert mean[k] == pytest.approx(sum(own) / len(own)) == by_blocks[k]
    mean = pairs.means(df, kernel).first()
    for got, kind in ((mean.mean_intra, True), (mean.mean_inter, False)):
        some = [s for _, _, s, intra in want if intra is kind and s is not None]
        assert got == pytest.approx(sum(some) / len(some))


@pytest.mark.parametrize("words", [3, 30_000])
def test_slots_looked_up_equal_slots_compared(words):
    draw = np.random.default_rng(words)
    slots, wide = draw.integers(0, words, (90, 128)), pairs.Slots()
    slots[7] = slots[60] = 0
    slots[80], slots[81, :64] = slots[3], slots[4, :64]
    slots[5] = (1 << 32) - 1
    x, y = slots[:40], slots[30:]
    want = [[int((p == q).sum()) if p.any() and q.any() else 0 for q in y] for p in x]
    assert wide.compare(wide.form(x), wide.other(wide.form(y))).tolist() == want
    assert (wide._by_place(wide.form(x), *(o for k, o in enumerate(wide.other(wide.form(y))) if k != 1)) is None) == (words == 3)


@pytest.mark.parametrize("of", [lambda df: pairs.histogram(df, pairs.Slots()), lambda df: pairs.similarities(df, pairs.Slots()), lambda df: pairs.means(df, pairs.Slots())])
def test_no_row_is_copied_for_the_blocks_it_meets(spark, monkeypatch, of):
    for name in ("BLOCK", "PAIRS_BLOCK", "LEAST"):
        monkeypatch.setattr(pairs, name, 10)
    made, write = [], pairs.materialize
    monkeypatch.setattr(pairs, "materialize", lambda df, name: made.append((name, out := write(df, name))) or out)
    found = of(spark.range(200).select("id", F.lit("p").alias("label"), F.array("id", F.lit(1)).alias("digest")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "FlatMapGroups" not in plan  # a row for each of its 20 blocks, shuffled
    assert [(name, df.count()) for name, df in made] == [("digests", 200), ("blocks", 20)]


def test_fast_rounding_is_that_of_spark(spark):
    values = [0.0, -0.0, 1.0, -1.0, 0.0000005, -0.0000005, 0.1234565, 0.12345649999, -0.9999995, 0.3, 1e-17, 12345.6789012345, math.nan, math.inf, None]
    draw = random.Random(3)
    rows = spark.createDataFrame([(x,) for x in values + [draw.uniform(-1, 1) for _ in range(2000)]], "x double")
    assert rows.where(~vectors.rounded(F.col("x"), 6).eqNullSafe(F.round("x", 6))).count() == 0
