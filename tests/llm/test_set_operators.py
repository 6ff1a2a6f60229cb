"""Operators over sets of rows against brute force: line dedup, URL rules, near-duplicates, decontamination."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmark import session
from siftmark.llm import decontaminate, line_dedup, minhash, queries, url_rules
from siftmark.operators import numbering
from siftmark.operators.components import connected_components

SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, lang string, n_words int, mark string, line int, id string, component string, _id int, _mark int, _hash int, DROP int, _drop int, gone int, _gone int, bad_id int, _bad_id int, bad_mark int, _bad_mark int, dropped string, `a.b` int"


def frame(spark, rows):
    """Documents with columns whose names operators use inside."""
    return spark.createDataFrame([(*r, *OTHERS) for r in rows], CLASH)


OTHERS = ("en", 1, "m", 2, "i", "c", *range(11), "d", 12)


def carried(row):
    """Whether a row still has the other columns it came with."""
    return tuple(row)[2:21] == OTHERS


# line dedup


def line_words(line):
    return [w for w in re.split(r"[ \t\x0b\f\r]+", line.lower()) if w]


def edits(a, b):
    """Levenshtein distance over words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute_lines(rows, exact=line_dedup.EXACT_WORDS, near=line_dedup.EDIT_WORDS):
    """Rows (doc_id, text) with distinct doc_ids to texts without duplicate lines."""
    seen, out = [], {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        if text is None:
            out[doc] = None
            continue
        kept = []
        for line in text.split("\n"):
            w = line_words(line)
            dup = len(w) >= exact and any(w == o or len(w) >= near and len(o) >= near and abs(len(w) - len(o)) < 2 and edits(w, o) <= 1 for o in seen)
            if len(w) >= exact:
                seen.append(w)
            if not dup:
                kept.append(line)
        out[doc] = "\n".join(kept)
    return out


def random_lines(seed, n=70):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.choice([3, 5, 8, 9, 10, 11, 12, 25]))] for _ in range(12)]
    rows = []
    for doc in range(n):
        lines = []
        for _ in range(rng.randint(0, 4)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i = rng.randrange(len(w) + 1)
                kind = rng.random()
                if kind < 0.4:
                    w[i : i + 1] = [rng.choice("xyz")]
                elif kind < 0.7:
                    w[i:i] = [rng.choice("xyzab")]
                else:
                    w[i : i + 1] = []
            line = (" " if rng.random() < 0.8 else "  ").join(w)
            lines.append(line.upper() if rng.random() < 0.2 else line)
        rows.append((doc * 3 - 40, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_equals_brute_force(spark, seed):
    rows = random_lines(seed)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (None, "one two three four five"), (3, "one two three four five\nshort"), (4, long), (5, long.replace("w1500 ", "")), (6, long.replace("w7 ", "w7 new ")), (7, "a b c d e\n\na b c d e"), (7, "a b c d e\n\na b c d e")]
    out = line_dedup.dedup_lines(frame(spark, rows), counted="n_dropped")
    assert out.columns == [*frame(spark, rows).columns, "n_dropped"] and all(map(carried, out.collect()))
    assert line_dedup.dedup_lines(frame(spark, rows)).columns == frame(spark, rows).columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == Counter([(1, None), (2, ""), (None, "one two three four five"), (3, "short"), (4, long), (5, ""), (6, ""), (7, "a b c d e\n"), (7, "a b c d e\n")])
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def plans_of(monkeypatch, module, run):
    """Plans of everything that an operator writes on its way, and of its result."""
    plans, write = [], session.materialize

    def noted(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *rest)

    for place in (module, numbering):
        if hasattr(place, "materialize"):
            monkeypatch.setattr(place, "materialize", noted)
    plans.append(run()._jdf.queryExecution().executedPlan().toString())
    return plans


def test_line_dedup_is_native(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plans = plans_of(monkeypatch, line_dedup, lambda: line_dedup.dedup_lines(docs))
    assert len(plans) > 8 and not any(re.search("Python|Pandas|Arrow", p) for p in plans)


def test_url_rules_are_native(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    plans = plans_of(monkeypatch, url_rules, lambda: url_rules.judge(pages, queries.HOST_RULES))
    assert len(plans) > 4 and not any(re.search("Python|Pandas|Arrow", p) for p in plans)


def test_one_edit(spark):
    pairs = [("a b c", "a b c"), ("a b c", "a c"), ("a c", "a b c"), ("a b c", "a x c"), ("a b c", "b c d"), ("a b c d", "a b"), ("a b c", "x a b c"), ("a b c", "a b c x"), ("a b", "b a")]
    rows = spark.createDataFrame([(x.split(), y.split()) for x, y in pairs], "x array<string>, y array<string>")
    assert [r[0] for r in rows.select(line_dedup.one_edit(F.col("x"), F.col("y"))).collect()] == [edits(x.split(), y.split()) <= 1 for x, y in pairs]


# URL rules


def brute_url(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, h, p in (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = verdict, h + p
    return host, path, best


URLS = [None, "", "nothing", "http://", "https://EXAMPLE.com/en/7x?y#z", "http://a.b.com/en/", "http://xcom/en/", "http://example.net/de/81", "http://net/de/", "x://q.org/es/1://com/en/", "http://É.COM/EN/", "http://com?/en/", "a b\nc://d.com/en/\nx#y", "://org/es/"]


def test_url_rules_fit(spark):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS + URLS[:5])], "page_id long, url string, host string, verdict string")
    for r in url_rules.judge(pages, queries.HOST_RULES).collect():
        host, path, best = brute_url((URLS + URLS[:5])[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")
    assert url_rules.judge(pages.limit(0), queries.HOST_RULES).count() == 0


def test_url_query(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = queries.op8_url_rules(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, best = brute_url(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]) and (best is None or r.verdict == best[0])


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        items = sorted(set(rng.choices("abcdef", k=3)))
        rows.append((items, "block" if {"a", "b"} <= set(items) or rng.random() < 0.05 else "allow"))
    got = {(r.tokens, r.verdict): (r.confidence, r.support) for r in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02, 0.8)}
    want = {}
    for n in (1, 2, 3):
        for body in itertools.combinations("abcdef", n):
            inside = [v for i, v in rows if set(body) <= set(i)]
            for verdict in ("allow", "block"):
                k = inside.count(verdict)
                if k >= 0.02 * len(rows) and k / len(inside) >= 0.8:
                    want[body, verdict] = (k / len(inside), k)
    pruned = {}
    for (body, verdict), (c, k) in want.items():
        if not any(v == verdict and set(b) < set(body) and d >= c for (b, v), (d, _) in want.items()):
            pruned[body, verdict] = (c, k)
    assert got == pruned and (("a", "b"), "block") in got
    rules = [url_rules.MinedRule(*k, *v) for k, v in got.items()]
    out = spark.createDataFrame(rows, "tokens array<string>, verdict string").select("tokens", url_rules.mined_verdict(F.col("tokens"), rules).alias("v")).collect()
    for r in out:
        fits = sorted((-x.confidence, -x.support, x.verdict != "block", x.tokens, x.verdict) for x in rules if set(x.tokens) <= set(r.tokens))
        assert r.v == (fits[0][-1] if fits else None)


def test_frequent_template_hides_no_mined_rule(spark, monkeypatch):
    """A template of 14 constant tokens has 16,383 combinations of confidence 1; a rule of 0.9 stays beside them."""
    same = [f"t{i}" for i in range(14)]
    rows = [(same, "allow")] * 50 + [(["spam", f"u{i}"], "block" if i else "allow") for i in range(10)]
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = {(r.tokens, r.verdict): (r.confidence, r.support) for r in url_rules.mine(labelled, 0.05, 0.8)}
    assert got == {((t,), "allow"): (1.0, 50) for t in same} | {(("spam",), "block"): (0.9, 9)}
    asked = spark.createDataFrame([(["spam", "x"],), (["t3"],), (["t3", "spam"],), (["x"],), ([],), (["t3"],)], "tokens array<string>")
    want = Counter([("spam x", "block"), ("t3", "allow"), ("t3", "allow"), ("t3 spam", "allow"), ("x", None), ("", None)])
    table = url_rules.mine_table(labelled, 0.05, 0.8)
    for literal in (200, 0):
        monkeypatch.setattr(url_rules, "LITERAL_RULES", literal)
        assert Counter((" ".join(r.tokens), r.mined) for r in url_rules.with_mined_verdict(asked, table).collect()) == want


def url_tokens(url):
    """Tokens of a URL, read anew."""
    host, path, _ = brute_url(url)
    found = {f"h{i}:{x}" for i, x in enumerate(host.split(".")[::-1])}
    found |= {f"p{i}:" + re.sub("[0-9]+", "0", x.lower()) for i, x in enumerate([x for x in path.split("/") if x])}
    return found | {f"q:{x}" for x in re.findall("[?&]([^=&#]+)=", url or "")}


def brute_verdicts(urls, min_support=0.005, min_confidence=0.8):
    """Verdicts of URLs by every combination of tokens that the URLs judged by hand have."""
    labelled = [(frozenset(url_tokens(u)), best[0]) for u in urls if (best := brute_url(u)[2])]
    times = Counter((frozenset(c), v) for found, v in labelled for n in range(1, len(found) + 1) for c in itertools.combinations(sorted(found), n))
    seen = Counter()
    for (body, _), k in times.items():
        seen[body] += k
    passed = {(body, v): (k / seen[body], k) for (body, v), k in times.items() if k >= min_support * len(labelled)}
    parts = lambda body: (frozenset(c) for n in range(1, len(body)) for c in itertools.combinations(body, n))
    kept = [(-c, -k, v != "block", v, body) for (body, v), (c, k) in passed.items() if c >= min_confidence and not any(passed.get((part, v), (0,))[0] >= c for part in parts(body))]
    ranked, out = sorted(kept, key=lambda r: r[:4]), []
    for u in urls:
        host, _, best = brute_url(u)
        own = next((v for _, _, _, v, body in ranked if body <= url_tokens(u)), None) if host else None
        out.append(best[0] if best else own or "allow")
    return out


def test_url_verdicts_equal_brute_force(spark):
    rng = random.Random(7)
    urls = [f"http://{rng.choice(['a.', 'b.', ''])}{rng.choice(['example.com', 'shop.com', 'x.net', 'y.org', 'z.io'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.choice(['spam', 'news', '7', '81'])}{rng.choice(['', '?id=3', '?ref=1&id=2'])}" for _ in range(400)] + URLS
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for support in (0.005, 0.05):
        got = [r.verdict for r in url_rules.judge(pages, queries.HOST_RULES, min_support=support).orderBy("page_id").collect()]
        assert got == brute_verdicts(urls, support)


def test_url_query_verdicts_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    pages = sorted((r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect())
    got = [(r.page_id, r.verdict) for r in queries.op8_url_rules(spark, sf).orderBy("page_id").collect()]
    assert got == list(zip([p for p, _ in pages], brute_verdicts([u for _, u in pages]), strict=True))


def test_every_part_of_a_url_is_a_token(spark):
    url = "http://a.b.c.d.e.f.g.com/1/2/3/4/5/6/7/last?" + "&".join(f"k{i}=1" for i in range(8))
    found = spark.createDataFrame([(url,)], "url string").select(url_rules.tokens(F.col("url"), *url_rules.split_url(F.col("url")))).first()[0]
    assert {"h7:a", "p7:last", "q:k7"} <= set(found)


# near-duplicates


def word_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_components(rows, percent):
    sets = {d: word_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= percent * len(sets[a] | sets[b]):
            p, q = sorted((top(a), top(b)))
            root[q] = p
    return {d: (len(sets[d]), top(d)) for d in sets}


def random_docs(seed, n=160):
    rng = random.Random(seed)
    base = [[f"{rng.choice('abcdefghij')}{rng.randint(0, 40)}" for _ in range(rng.choice([2, 4, 5, 40, 90, 200]))] for _ in range(8)]
    rows = []
    for doc in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3]) if len(w) > 5 else 0):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 9)}"
        rows.append((doc * 7 % 1009, " ".join(w).upper() if rng.random() < 0.1 else "\n ".join(w)))
    return rows


@pytest.mark.parametrize("seed,percent", [(0, 85), (1, 80), (2, 85), (3, 70)])
def test_near_duplicates_equal_brute_force(spark, seed, percent):
    rows = random_docs(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows), percent, 48).collect()}
    assert got == brute_components(rows, percent)


def test_blocks_of_a_hot_bucket_lose_no_link(spark):
    """A chain of edits: the hub links with few; blocks of three members must find the rest."""
    rng = random.Random(4)
    w, rows = [f"w{i}" for i in range(120)], []
    for doc in range(60):
        rows.append((doc, " ".join(w)))
        w[rng.randrange(120)] = f"new{doc}"
    docs = frame(spark, rows)
    signed = minhash.materialize(minhash.signatures(docs, 48), "signed")
    classes, found = minhash.links(docs, signed, 85, block=3)
    own = {r.id: r.component for r in found.collect()}
    want = brute_components(rows, 85)
    assert {d: own.get(d, d) for d, _ in rows} == {d: c for d, (_, c) in want.items()}


def test_near_duplicate_edge_cases(spark):
    same = "one two three four five six seven eight"
    rows = [(9, same), (4, same), (4, same), (None, same), (5, None), (6, ""), (7, " \n"), (8, "Hi there"), (2, "hi  there"), (10, "hi there you"), (11, "x " * 30000)]
    got = Counter(map(tuple, minhash.near_duplicates(frame(spark, rows), 85, 24).collect()))
    assert got == Counter([(9, 4, 4, False), (4, 4, 4, True), (4, 4, 4, True), (None, 4, None, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 2, False), (2, 1, 2, True), (10, 1, 10, True), (11, 1, 11, True)])
    kept = minhash.keep_one(frame(spark, rows))
    assert all(map(carried, kept.collect()))
    assert kept.columns == frame(spark, rows).columns and Counter(r.doc_id for r in kept.collect()) == Counter([4, 4, None, 5, 6, 7, 2, 10, 11])
    assert minhash.near_duplicates(frame(spark, []), 85, 24).count() == 0


def test_circulant_signature_estimates_similarity():
    rng, errors = np.random.default_rng(5), []
    for _ in range(200):
        a = rng.integers(0, 2**63, 300).astype(np.uint64)
        b = a.copy()
        b[:60] = rng.integers(0, 2**63, 60).astype(np.uint64)
        errors.append((minhash.signature(a, 160) == minhash.signature(b, 160)).mean() - 240 / 360)
    assert abs(np.mean(errors)) < 0.01


def test_bands_of_circulant_signatures_find_similar_sets():
    """Coordinates of one signature depend on each other, so the recall is measured: pairs at the threshold that share no band."""
    rng, missed = np.random.default_rng(9), 0
    for percent, bands in ((85, 24), (80, 32)):
        for _ in range(1500):
            n = int(rng.integers(40, 400))
            k = int(np.ceil(2 * n * percent / (100 + percent)))  # shared by two sets of n
            both = rng.integers(0, 2**63, 2 * n - k).astype(np.uint64)
            a, b = both[:n], both[n - k :]
            missed += not any(x == y for x, y in zip(minhash.band_values(a, bands), minhash.band_values(b, bands), strict=True))
    assert missed <= 6  # of 3,000: a recall of 0.998


def test_rows_of_one_id_link_by_each_text(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "xy")
    rows = [(7, one), (7, two), (3, one + " more"), (9, two + " more"), (5, "something else"), (8, two), (2, "alone here")]
    got = Counter(map(tuple, minhash.near_duplicates(frame(spark, rows), 85, 48).collect()))
    assert got == Counter([(7, 26, 3, False), (7, 26, 3, False), (3, 27, 3, True), (9, 27, 3, False), (5, 1, 5, True), (8, 26, 3, False), (2, 1, 2, True)])


@pytest.fixture
def nothing_is_small(spark, monkeypatch):
    """As on large inputs: no side is broadcast, and every hub is dealt over tasks."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    monkeypatch.setattr(session, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(minhash, "HOT", 3)
    monkeypatch.setattr(line_dedup, "BROADCAST_DOCUMENTS", -1)
    monkeypatch.setattr(decontaminate, "broadcast_if_small", lambda df, *_: df)
    yield
    spark.conf.set(key, old)


def test_operators_without_broadcasts(spark, nothing_is_small):
    rows = random_lines(11)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()} == brute_lines(rows)
    rows = random_docs(11)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows), 85, 48).collect()} == brute_components(rows, 85)
    docs, items = contaminated(11)
    found = decontaminate.matches(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert "BroadcastHashJoin" not in plan and hits_of(got) == brute_hits(docs, items) and near_of(got) == brute_near(docs, items)


def written(spark):
    """Bytes that shuffles have written so far."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_only_texts_that_are_asked_for_are_shuffled(spark, nothing_is_small):
    rng = random.Random(12)
    line = lambda: " ".join(f"{rng.getrandbits(60):x}" for _ in range(400))
    texts = [(i, line()) for i in range(1_000)]
    texts += [(10_000 + i, texts[i][1] + " more") for i in range(4)]
    docs = session.materialize(frame(spark, texts), "docs")
    before = written(spark)
    found = line_dedup.duplicate_lines(docs).collect()
    assert {(r.doc_id, *r.drop) for r in found} == {(10_000 + i, 0) for i in range(4)}
    assert written(spark) - before < sum(len(t) for _, t in texts) / 2


def test_join_of_texts_equals_a_plain_join(spark, monkeypatch):
    texts = spark.createDataFrame([(i if i % 9 else None, i % 5, f"t{i}") for i in range(200)], "doc_id long, mark long, text string")
    found = session.materialize(spark.createDataFrame([(i if i % 9 else None, i % 5, i) for i in range(0, 400, 3)] + [(7, None, 0)], "_id long, _mark long, v long"), "found")
    want = sorted(map(repr, texts.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).collect()))
    for most, words in ((1000, 64), (-1, 64), (-1, 1)):  # the last map is full
        monkeypatch.setattr(session, "MAP_WORDS", words)
        assert sorted(map(repr, session.join_texts(texts, found, most).collect())) == want and len(want) > 60
    assert session.join_texts(texts, session.materialize(found.where("v < 0"), "none"), -1).count() == 0


def test_only_hot_rows_of_a_counted_table_are_copied(spark, monkeypatch):
    monkeypatch.setattr(session, "HOT_ROWS", 50)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "id long, key string")
    found = session.materialize(rows.groupBy("key").agg(F.count("id").alias("n"), F.min("id").alias("v")).where("key <> 'k3'"), "found")
    monkeypatch.setattr(session, "HOT_KEYS", 100)
    for how, n in (("inner", 299), ("left", 300)):
        got = session.lookup(rows, found, ["key"], ["id"], how, counts="n")
        assert got.columns == ["key", "id", "v"] and got.count() == n and got.where("v = 1").count() == 200


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2100)] + [(5000, 5000), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for start in sorted(near):
        if start not in want:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = start
                    todo += near[x]
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# decontamination


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = terms(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = terms(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= x
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def contaminated(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "Éa", "x1", "straße", "İx", "K9", "be", *"abcdefghijklmno"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 5, 9, 10, 11, 30])))) for i in range(25)]
    docs = []
    for d in range(60):
        w = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            own = terms(rng.choice(items)[1])
            cut = rng.randrange(len(own) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = own[cut:] if rng.random() < 0.5 else own
        docs.append((d, (", " if rng.random() < 0.5 else "\n").join(w).swapcase()))
    return docs, [*items, (3, "another text of item three"), (99, None), (98, "...")]


def brute_near(docs, items, size=10, slop=decontaminate.SLOP):
    """Ids of items with a window whose words all are in place but for a shift of 0 to ``slop``."""
    windows = {(item, tuple(w[i : i + size])) for item, text in items if (w := terms(text)) for i in range(max(1, len(w) - size + 1))}
    out = []
    for doc, text in docs:
        at = defaultdict(list)
        w = terms(text)
        for i, word in enumerate(w):
            at[word].append(i)
        found = {item for item, x in windows if any(all(any(b + o <= p <= b + o + slop for p in at[t]) for o, t in enumerate(x)) for b in range(-slop, len(w)))}
        out.append((doc, sorted(str(x) for x in found if x is not None)))
    return Counter((d, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()) for d, ids in out)


def hits_of(found):
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found)


def near_of(found):
    return Counter((r.doc_id, r.n_near_items, r.near_items_sha256) for r in found)


@pytest.mark.parametrize("seed", range(3))
def test_decontamination_equals_brute_force(spark, seed):
    docs, items = contaminated(seed)
    benchmark = spark.createDataFrame([(*x, "t") for x in items], "item_id long, text string, term string")
    got = decontaminate.matches(frame(spark, docs), benchmark).collect()
    assert hits_of(got) == brute_hits(docs, items) and near_of(got) == brute_near(docs, items)


def test_decontamination_edge_cases(spark):
    docs = [(1, None), (2, ""), (None, "alpha beta"), (3, "alpha beta"), (3, "alpha beta"), (4, "alpha " * 5000 + "beta"), (5, "beta alpha")]
    items = [(7, "Alpha, BETA!"), (10, "alpha beta")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(frame(spark, docs), benchmark).collect()
    assert hits_of(got) == brute_hits(docs, items) and near_of(got) == brute_near(docs, items)
    kept = decontaminate.clean(frame(spark, docs), benchmark)
    assert kept.columns == frame(spark, docs).columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 5])
    assert all(map(carried, kept.collect()))
    assert decontaminate.matches(frame(spark, docs), benchmark.limit(0)).where("contaminated").count() == 0
    assert decontaminate.matches(frame(spark, []), benchmark).count() == 0


def test_decontamination_folds_a_word_alike_wherever_it_is(spark):
    """A capital sigma's lower case hangs on characters beyond the word; equal words must stay equal."""
    item = "one two three four five six seven eight ΟΔΟΣ ΕΝΑ"
    docs = [(1, item), (2, item.replace("ΟΔΟΣ ", "ΟΔΟΣ.")), (3, item.replace("ΟΔΟΣ ", "ΟΔΟΣ'")), (4, item.replace("Σ", "ς")), (5, item.lower())]
    got = decontaminate.matches(frame(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert hits_of(got) == brute_hits(docs, [(1, item)]) and [r.n_hit for r in sorted(got)] == [10, 10, 10, 0, 0]


@pytest.mark.parametrize("seed", range(2))
def test_decontamination_of_cased_letters(spark, seed):
    """Cased letters beyond ASCII with ASCII punctuation between and inside words."""
    rng = random.Random(seed)
    letters = "ΣσςΑαİıIiKkÅåǅßẞŉΐΪ\u0307\u0301éÉ"
    made = ["".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(30)]
    glue = lambda: rng.choice([" ", ".", ":", "'", "-", ". ", "\n"])
    items = [(i, "".join(w + glue() for w in rng.choices(made, k=rng.choice([2, 4, 12])))) for i in range(12)]
    docs = []
    for d in range(60):
        w = terms(rng.choice(items)[1])
        w = [x.upper() if rng.random() < 0.05 else x for x in rng.choices(made, k=3) + w + rng.choices(made, k=3)]
        docs.append((d, "".join(x + glue() for x in w)))
    got = decontaminate.matches(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert hits_of(got) == brute_hits(docs, items) and near_of(got) == brute_near(docs, items)


def test_proximity(spark):
    items = [(1, "red fox green owl")]
    docs = [(1, "a red fox sees one green owl"), (2, "red fox green owl"), (3, "owl green fox red " + "z " * 20 + "red"), (4, "red " + "z " * 30 + "fox green owl"), (5, "fox red green owl"), (6, "red owl"), (7, "red fox cat owl")]
    found = decontaminate.matches(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), rarest=4, slop=3).collect()
    assert near_of(found) == brute_near(docs, items, slop=3)
    assert {r.doc_id for r in found if r.n_near_items} == {1, 2, 5} and {r.doc_id for r in found if r.n_items} == {2}


def test_decontamination_is_native(spark, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    plans = plans_of(monkeypatch, decontaminate, lambda: decontaminate.matches(docs, benchmark))
    assert len(plans) > 6 and not any(re.search("Python|Pandas|Arrow", p) for p in plans)
