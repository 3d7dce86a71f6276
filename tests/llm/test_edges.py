"""Null ids, odd rows, empty tables and the small cases that each operator's docstring defines."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from draftlens.llm import ann, bpe, decontaminate, jaccard, licenses, queries, secrets, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BIG = 2**53 + 1
IDS = [BIG, None, -BIG, 7, None, 0]


def frame(spark, rows, parts=2):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(parts)


def ids_of(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda i: (i is None, i or 0))


def test_ids_pass_through_workers_unharmed(spark):
    """A null beside it, a size beyond 2^53 and a sign change no id."""
    want = sorted(IDS, key=lambda i: (i is None, i or 0))
    docs = frame(spark, [(i, f"some words in text {k}") for k, i in enumerate(IDS)], 1)
    path, pattern = queries.vocabulary("byte_bpe_50k.json")
    assert ids_of(bpe.token_counts(docs, path, pattern)) == want
    assert ids_of(bpe.encode_digests(docs, *queries.vocabulary("byte_bpe_multi_50k.tiktoken"))) == want
    assert ids_of(jaccard.join(docs)) == want
    assert ids_of(toxicity.score(docs, toxicity.Model({}))) == want
    assert ids_of(secrets.digests(docs)) == want
    assert ids_of(licenses.scan(docs)) == want
    items = spark.createDataFrame([(1, "words in text")], "item_id long, text string")
    assert ids_of(decontaminate.find(docs, items)) == want
    vectors = spark.createDataFrame([(i, [1.0, float(k)]) for k, i in enumerate(IDS)], "vec_id long, embedding array<float>")
    got = ann.search(vectors, vectors).collect()
    assert {r["query_id"] for r in got} == {r["vec_id"] for r in got} == {BIG, -BIG, 7, 0}


def test_empty_tables(spark):
    docs = frame(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 0
    assert decontaminate.find(docs, items).count() == 0
    assert bpe.encode_digests(docs, *queries.vocabulary("byte_bpe_multi_50k.tiktoken")).count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert licenses.scan(docs).count() == secrets.digests(docs).count() == jaccard.join(docs).count() == jaccard.one_of_each(docs).count() == 0


def test_toxicity_without_both_labels_scores_their_share(spark):
    docs = frame(spark, [(i, "plain words here") for i in range(20)] + [(30, None), (31, "")])
    for toxic, most in ((0, 0.01), (1, None)):
        labels = spark.createDataFrame([(i, toxic) for i in range(20)], "doc_id long, toxic int")
        got = [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()]
        assert len(got) == 22 and len(set(got)) == 1
        assert got[0] <= most if most else got[0] > 0.9


def plain_model(texts, labels):
    """The log-odds, worked out without Spark."""
    counts, total = defaultdict(lambda: [0, 0]), [0, 0]
    for text, toxic in {t: max(y for u, y in zip(texts, labels, strict=True) if u == t) for t in texts}.items():
        words = set(re.findall(r"[^\W\d_]+", text.lower()))
        for w in words | {x[:k] + "*" for x in words for k in toxicity.BEGINNINGS if len(x) > k}:
            counts[w][0] += toxic
            counts[w][1] += 1
            total[0] += toxic
            total[1] += 1
    out = {}
    for w, (a, n) in counts.items():
        al, a_all, b_all = toxicity.PRIOR * n, total[0] + toxicity.PRIOR * total[1], total[1] - total[0] + toxicity.PRIOR * total[1]
        a, b = a + al, n - a + al
        delta = np.log(a / (a_all - a)) - np.log(b / (b_all - b))
        sure = abs(delta) - toxicity.SIGMAS * np.sqrt(1 / a + 1 / b)
        if sure > 0:
            out[w] = np.sign(delta) * sure
    return out


def test_toxicity_model_against_plain_python(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([f"{a}{b}word" for a in "abcd" for b in "efgh"], 12)) + (" vile rotten" if i % 3 == 0 else " kind") for i in range(90)]
    labels = [int(i % 3 == 0) for i in range(90)]
    model = toxicity.fit(frame(spark, list(enumerate(texts))), spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    keep = [i for i in range(90) if zlib.crc32(str(i).encode()) % 5]
    want = plain_model([texts[i] for i in keep], [labels[i] for i in keep])
    assert set(model.odds) == set(want) and "vile" in want and "kind" in want and want["kind"] < 0
    assert all(abs(model.odds[w] - want[w]) < 1e-9 for w in want)
    # The scanned rows follow from the model alone.
    for r in toxicity.score(frame(spark, list(enumerate([*texts, "", None]))), model).collect():
        text = [*texts, "", None][r["doc_id"]]
        scores = toxicity.scores_of(text, model)
        x = toxicity.significance(len(scores), toxicity.segments(scores), model)
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -60, 60)))) < 1e-9
        if text and "vile" in text:
            assert r["predicted"] == 1 and any(s["odds"] > 1 for s in r["segments"])
        else:
            assert r["predicted"] == 0


def test_neighbours_of_few_rows_are_all_candidates(spark):
    rng = np.random.default_rng(1)
    four = [(i, rng.normal(size=64).tolist()) for i in range(4)]
    v = spark.createDataFrame(four, "vec_id long, embedding array<double>")
    assert sorted(r["vec_id"] for r in ann.search(v, v.where("vec_id = 0")).collect()) == [1, 2, 3]
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in ann.search(v, v.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 0.0), (2, -1.0)]


def test_neighbours_of_repeated_queries_and_equal_vectors(spark):
    rows = [(0, [1.0, 0.1])] * 2 + [(i, [1.0, 0.0]) for i in range(1, 40)] + [(0, [0.0, 1.0]), (50, [0.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"]) for r in ann.search(v, v.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 50), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_neighbours_share_of_candidates(spark):
    """At sf0.1, 2,000 unrelated vectors, queries meet a part of the rows only and still find the nearest."""
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    v = np.array([r[1] for r in rows], float)
    ids, unit = np.array([r[0] for r in rows]), v / np.linalg.norm(v, axis=1)[:, None]
    index = ann.CrossPolytope(v.shape[1], len(v))
    codes, asked = index.codes(unit), np.flatnonzero(ids % 50 == 0)
    probes = index.probes(unit[asked], ann.PROBES)
    met = hits = 0
    for i, q in enumerate(asked):
        near = np.zeros(len(v), bool)
        for t in range(index.tables):
            near |= np.isin(codes[t], probes[t, i])
        near[q] = False
        score = unit @ unit[q]
        score[q] = -2
        met += near.sum()
        hits += near[np.lexsort((ids, -score))[:5]].sum()
    print("share", met / len(asked) / len(v), "recall", hits / 5 / len(asked))
    assert met <= 0.6 * len(asked) * len(v) and hits >= 0.9 * 5 * len(asked)


def test_licences_in_the_usual_wrapping(spark):
    import textwrap

    known = licenses.KNOWN
    wrapped = {k: "\n\n".join(textwrap.fill(p, 72) for p in t.split("\n")) for k, t in known.items()}
    texts = [
        "MIT License\n\nCopyright (c) 2020 Some One\n\n" + wrapped["MIT"],
        "The MIT License (MIT)\n\nCopyright © 2011-2020 Some One. All rights reserved.\n\n" + wrapped["MIT"],
        "ISC License\n\nCopyright 2019, Some One <a@b.c>\n\n" + wrapped["ISC"].replace("and this permission notice", "and this permission notice"),
        "Copyright (c) 2020, Some One\nAll rights reserved.\n\n" + wrapped["BSD-3-Clause"],
        "\n".join("# " + line for line in ("Copyright 2021 Some One\n\n" + wrapped["Apache-2.0-header"]).split("\n")),
        "Our license is MIT.\n" + wrapped["MIT"] + "\nand more",
        "", None, "MIT License",
    ]
    got = [r["license_id"] for r in licenses.scan(frame(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert got == ["MIT", "MIT", "ISC", "BSD-3-Clause", "Apache-2.0-header", None, None, None, None]
    every = {r["doc_id"]: r["license_id"] for r in licenses.scan(frame(spark, list(enumerate(wrapped.values())))).collect()}
    assert every == dict(enumerate(known))


def test_licences_ties_and_tables(spark):
    table = spark.createDataFrame([("b", "Same Words"), ("a", "same words!"), ("c", None), ("d", " ")], "license_id string, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(frame(spark, [(1, "SAME words"), (1, "same  words."), (2, None), (3, "x" * 100_000)]), table).collect()}
    assert got == {1: "a", 2: None, 3: None}


def test_links_are_resolved_and_pass_on_blocks(spark):
    canonical, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "https://a.com/dir/x", canonical.format("/z")), (2, "https://A.com/z#top", ""), (3, "https://a.com/z", refresh.format("http://bad.net/?a=1&amp;b=2")),
        (4, "https://b.com/", canonical.format("/z")), (5, "https://b.com/z", None), (6, "https://c.com/a/b", canonical.format("../q/./r")), (7, "https://c.com/q/r", canonical.format("//d.org/fr/") + refresh.format("http://e.net/")),
        (8, "https://c.com/q/r?x", ""), (None, "https://a.com/z", ""), (9, None, canonical.format("/z")), (10, "http://f.com/", canonical.format("mailto:x@y.net")), (11, "http://g.com", canonical.format("http://h.net")), (12, "http://g.com/", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "block", None: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "block", 12: "block"}


def test_links_around_a_hub_with_redirects(spark):
    pages = spark.createDataFrame([(i, f"http://p{i}.com/", '<link rel=canonical href="http://hub.com/">') for i in range(300)] + [(1000, "http://far.com/", "")], "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://hub.com", "http://x.net/"), ("http://far.com/", "http://p7.com/")], "src string, dst string")
    got = urls.judge(pages, redirects=redirects)
    assert got.where("verdict = 'block'").count() == 301
    assert urls.judge(pages, [*urls.RULES, ("allow", "p5.com", "/")], redirects).where("verdict = 'allow'").count() == 301


def test_many_rules_are_joined(spark, monkeypatch):
    hosts = ["net", "a.net", "b.a.net", "com", "x.com", ""]
    rules = [(("block", "allow")[(i + j) % 2], h, p) for i, h in enumerate(hosts) for j, p in enumerate(["/", "/d", "/d/e/"])]
    pages = spark.createDataFrame([(i, f"http://{h}{p}", "") for i, (h, p) in enumerate((h, p) for h in ["c.b.a.net", "A.net", "xa.net", "x.com", "y.org", ""] for p in ["", "/", "/d", "/d/e/f?q", "/D"])], "page_id long, url string, html string")
    one = sorted(map(tuple, urls.judge(pages, rules).collect()))
    monkeypatch.setattr(urls, "MAX_RULES", 2)
    assert one == sorted(map(tuple, urls.judge(pages, rules).collect()))


@pytest.mark.parametrize(
    "text,secret",
    [
        ("key 9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B2B0B822CD15D6C15B0F00A08 end", "9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B2B0B822CD15D6C15B0F00A08"),
        ("bare q7Rt2LmX9ZbK4vWc8NdP here", "q7Rt2LmX9ZbK4vWc8NdP"),
        ("letters kQzXvBnMwTrYpLsDfGhJcKaZxQeRt end", "kQzXvBnMwTrYpLsDfGhJcKaZxQeRt"),
        ("uuid 123e4567-e89b-12d3-a456-426614174000 end", None),
        ("word thenationalinstitutionalised end", None),
        ("a GetInternationalisationServiceFactoryBean end", None),
        ("snake some_long_variable_name_in_code_here end", None),
        ("number 1234567890-1234567890-12345 end", None),
    ],
)
def test_entropy_classes(spark, text, secret):
    row = secrets.digests(frame(spark, [(1, text)])).first()
    want = "" if secret is None else f"entropy:{text.index(secret)}:{text.index(secret) + len(secret)}"
    assert row["spans"] == want


def test_decontamination_finds_verbatim_items_at_every_offset(spark):
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(400)]
    items = [(n, " ".join(rng.choice(vocab, n))) for n in range(1, 61)]
    index = decontaminate.Index(items, 0.8)
    symbol = index.vocab.get
    for n, text in items:
        docs = [[*map(str, range(o)), *text.split(), "after"] for o in range(9)]
        got = index.find([[symbol(w, 0) for w in d] for d in docs])
        assert [(d, i, e, p) for d, i, e, p in got if i == n] == [(o, n, 0, o) for o in range(9)]


def test_decontamination_recall_at_the_most_edits():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocab, 3 + i % 58))) for i in range(174)]
    index, hits, total = decontaminate.Index(items, 0.8), 0, 0
    for i, text in items:
        for _ in range(3):
            w = text.split()
            for _ in range(int(len(w) * 0.2 + 1e-9)):
                at, kind = int(rng.integers(0, len(w))), int(rng.integers(0, 3))
                w[at : at + (kind != 1)] = [f"n{rng.integers(9)}"] * (kind != 2)
            doc = [*rng.choice(vocab, 50), *w, *rng.choice(vocab, 50)]
            hits += any(f[1] == i for f in index.find([[index.vocab.get(x, 0) for x in doc]]))
            total += 1
    print("recall", hits / total)
    assert hits >= 0.95 * total


def test_decontamination_odd_rows_and_blocks(spark, monkeypatch):
    items = [(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (2, ""), (None, "zeta"), (3, None), (4, "One, two -- THREE!")]
    rows = [(1, "x ALPHA beta, gamma delta epsilon y"), (1, "x ALPHA beta, gamma delta epsilon y"), (2, None), (3, ""), (4, "one two three"), (5, "alpha beta other delta epsilon"), (6, "one two four"), (None, "one two three")]
    docs, bench = frame(spark, rows).withColumn("found", F.lit(1)).withColumn("item_id", F.lit(2)), spark.createDataFrame(items, "item_id long, text string")
    want = [(None, 4, 0, 0), (1, 1, 0, 1), (1, 1, 0, 1), (4, 4, 0, 0), (5, 1, 1, 0)]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, decontaminate.find(docs, bench).collect()), key=key) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    assert sorted(map(tuple, decontaminate.find(docs, bench).collect()), key=key) == want


def links(texts):
    sets = [frozenset(tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return root


def test_near_copies_with_null_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda *at: " ".join("e" if i in at else w for i, w in enumerate(base))
    rows = [(9, near()), (None, near(0)), (1, near(0, 59)), (5, near(59)), (5, "quite other words than these are"), (5, near(59)), (None, None), (4, ""), (4, ""), (None, "lone words of a null id")]
    root, ids = links([t for _, t in rows]), [i for i, _ in rows]
    want = sorted((i or -1, min((ids[k] for k in range(len(rows)) if root[k] == root[n] and ids[k] is not None), default=None) or -1) for n, i in enumerate(ids))
    got = jaccard.join(frame(spark, rows).withColumn("component", F.lit("x")).withColumn("h", F.lit("y"))).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == want
    left = sorted(((r["doc_id"] or -1, r["text"]) for r in jaccard.one_of_each(frame(spark, rows)).collect()), key=repr)
    assert left == sorted([(1, near(0, 59)), (5, "quite other words than these are"), (-1, None), (4, ""), (4, ""), (-1, "lone words of a null id")], key=repr)


def stage_docs(spark):
    return frame(spark, [(i, t) for i, t in [(1, "fine words of every kind"), (2, "you vile rotten thing"), (2, "other clean words"), (None, "so vile and rotten"), (None, "clean again"), (3, None), (4, "")]])


def test_stage_toxicity(spark, monkeypatch):
    model = toxicity.Model({"vile": 5.0, "rotten": 5.0}, 1.0, 0.1, 1.0, -3.0)
    monkeypatch.setattr(toxicity, "fit", lambda *_: model)
    kept = corpus_pipeline.drop_toxic(spark, stage_docs(spark), "/root/testdata/sf0.001")
    assert kept.columns == corpus_pipeline.COLUMNS
    assert sorted((r["text"] or "" for r in kept.collect())) == ["", "", "clean again", "fine words of every kind", "other clean words"]


def test_stage_decontamination(spark, monkeypatch):
    items = spark.createDataFrame([(1, "vile rotten thing"), (2, "vile and rotten")], "item_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: items)
    kept = corpus_pipeline.drop_benchmark_leaks(spark, stage_docs(spark), "")
    assert kept.columns == corpus_pipeline.COLUMNS
    assert sorted((r["text"] or "" for r in kept.collect())) == ["", "", "clean again", "fine words of every kind", "other clean words"]


def test_stages_of_secrets_and_bpe(spark):
    docs = frame(spark, [(None, "password = abcdefghijkl1"), (1, "clean"), (1, "clean"), (2, None)])
    kept = corpus_pipeline.redact_secrets(spark, docs, "")
    assert kept.columns == corpus_pipeline.COLUMNS
    assert sorted((r["doc_id"] or -1, r["text"], r["n_chars"]) for r in kept.collect()) == [(-1, "[assign]", 8), (1, "clean", 5), (1, "clean", 5), (2, "", 0)]
    coded = corpus_pipeline.encode(spark, kept, "").collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"] == len(r["ids"]) // 4) for r in coded) == [(-1, True), (1, True), (1, True), (2, True)]
