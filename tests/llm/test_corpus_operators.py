"""Models, joins, media and archives on small tables."""

import glob
import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm import components, language_model, media, prefix_join, quality, registry, shared, toxicity, warc
from tests.llm.helpers import awkward, frame

SPACE = b" \t\n\x0b\x0c\r"


def shingle_set(text):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = lower.translate(bytes(32 if b in SPACE else b for b in range(256))).split(b" ")
    words = [w for w in words if w]
    return frozenset(tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))) if words else frozenset()


def brute_components(rows):
    """Union-find over all pairs; component = smallest id."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    low = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)].append(i)
    return Counter((i, len(sets[k]), min(low[find(k)], default=None)) for k, (i, _) in enumerate(rows))


def test_prefix_join_equals_brute_force(spark):
    rnd = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    passage = [f"p{k}" for k in range(40)]
    rows, n = [], 0
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.randrange(5, 90))] + (passage if rnd.random() < 0.5 else [])
        chain = list(base)
        for _ in range(10):
            copy = list(rnd.choice((base, chain)))
            for _ in range(rnd.randrange(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words + [f"new{n}"])
            chain = copy
            rows.append((n, " ".join(copy).upper() if rnd.random() < 0.2 else "  ".join(copy)))
            n += 1
    rows += [(1000 + k, t) for k, t in enumerate(["", None, "one", "One", "one two", "one two", " \n", "a b c", "c b a"])]
    rows += [rows[0], (None, rows[0][1]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gid", F.lit(1)).withColumn("sid", F.lit("x")).repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in prefix_join.near_duplicates(df, sketch_bits=17).collect())
    assert got == brute_components(rows)
    assert prefix_join.near_duplicates(df.where("false"), sketch_bits=17).count() == 0


def test_prefix_join_awkward_table(spark):
    rows = awkward()
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in prefix_join.near_duplicates(frame(spark, rows), sketch_bits=17).collect())
    assert got == brute_components([(r[0], r[1]) for r in rows])


def test_components_of_paths_and_loops(spark):
    rnd = random.Random(12)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100), (200, 201), (201, 200), (None, 3), (300, None)] + [(400 + rnd.randrange(30), 400 + rnd.randrange(30)) for _ in range(20)]
    rnd.shuffle(edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    parent = {}

    def find(k):
        parent.setdefault(k, k)
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {k: find(k) for k in parent}
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_components_of_stars_take_no_round_and_rounds_leave_no_shuffles(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(components, "cut", lambda df, keep=components.cut: cuts.append(1) or keep(df))
    stars = [(k - k % 5, k) for k in range(100) if k % 5]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(stars + [(b, a) for a, b in stars], "a int, b int")).collect()}
    assert got == {k: k - k % 5 for k in range(100)} and len(cuts) == 1  # the distinct edges alone

    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    path = spark.createDataFrame([(k, k + 1) for k in range(64)], "a int, b int").repartition(8)
    shared.release(spark)
    time.sleep(2)
    before, cuts[:] = disk.getAllFiles().size(), []
    found = components.components(path)
    until = time.time() + 20  # the cleaner is a thread of its own
    while len(cuts) > 2 and disk.getAllFiles().size() > before + 40 and time.time() < until:
        time.sleep(0.2)
    assert len(cuts) > 2 and disk.getAllFiles().size() <= before + 40  # of the last look at the edges; a round writes many more
    assert {r.component for r in found.collect()} == {0}


def labelled(seed=5, n=500):
    """Documents with a toxic word or a broken layout now and then, and their labels."""
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("ar", "be", "co", "du") for b in ("la", "mi", "no", "pu", "ra")]
    docs, labels = [], []
    for k in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randrange(20, 120))]
        toxic, bad = int(rnd.random() < 0.25), int(rnd.random() < 0.25)
        if toxic:
            for _ in range(4):
                text[rnd.randrange(len(text))] = "vilest" + rnd.choice(["", "a", "er", "ing"])
        out = " | ".join(t + "$$" for t in text) if bad else ". ".join(" ".join(text[i : i + 9]).capitalize() for i in range(0, len(text), 9)) + "."
        docs.append((k, out, "en", f"src{k % 4}", len(out)))
        labels.append((k, 1 - bad, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def corpus(spark):
    docs, labels = labelled()
    return frame(spark, docs), spark.createDataFrame(labels + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


def test_toxicity_on_held_out_rows(spark, corpus):
    docs, labels, truth = corpus
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model, score_col="score").withColumn("held", toxicity.held_out()).collect()
    assert {r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out} == {True}
    held = [r for r in out if r.held]
    right = sum((r.score >= 0.5) == bool(truth[r.doc_id][1]) for r in held)
    assert right >= 0.95 * len(held) and all(r.gid == "kept" for r in out)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, flipped)
    assert np.array_equal(model.weight, again.weight) and np.array_equal(model.index, again.index)  # held-out labels are never read


def test_toxicity_awkward_table(spark, corpus):
    model = toxicity.fit(*corpus[:2])
    rows = awkward()
    out = toxicity.score(frame(spark, rows), model, score_col="s").collect()
    assert len(out) == len(rows) and all(0 <= r.s <= 1 for r in out)
    assert toxicity.score(frame(spark, rows).where("false"), model).count() == 0
    none = toxicity.fit(frame(spark, rows), corpus[1].where("false"))
    assert {r.score for r in toxicity.score(frame(spark, rows), none).collect()} == {0.5}
    one = toxicity.fit(corpus[0], corpus[1].where("toxic = 0"))
    assert all(r.score < 0.5 for r in toxicity.score(corpus[0], one).collect())


def splitmix(v):
    v = ((v ^ (v >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    v = ((v ^ (v >> 27)) * 0x94D049BB133111EB) % 2**64
    return v ^ (v >> 31)


def plain_ftrl(docs, truth):
    """Per-coordinate FTRL over dictionaries, and the calibrated logits of all documents."""
    import re

    def features(text):
        ws = re.findall(r"[a-z0-9]+", text.lower())
        out = {("w", w) for w in ws} | {("b", x, y) for x, y in zip(ws, ws[1:])} | {("s", x, y) for x, y in zip(ws, ws[2:])}
        return out | {("p", w[:k]) for w in ws for k in toxicity.PREFIXES if len(w) > k}

    z, n, bz, bn = defaultdict(float), defaultdict(float), 0.0, 0.0
    alpha, beta, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    rows = sorted(((splitmix(i), features(t), truth[i][1]) for i, t, *_ in docs if zlib.crc32(str(i).encode()) % 5), key=lambda r: r[0])
    for _ in range(toxicity.EPOCHS):
        for k, (_, f, y) in enumerate(rows):
            if k % toxicity.CALIBRATION:
                w, b = {i: weight(i) for i in f}, -bz * alpha / (beta + math.sqrt(bn))
                g = 1 / (1 + math.exp(-sum(w.values()) - b)) - y
                for i in f:
                    z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                    n[i] += g * g
                bz, bn = bz + g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha * b, bn + g * g
    logit = lambda f: sum(map(weight, f)) - bz * alpha / (beta + math.sqrt(bn))
    kept = [(logit(f), y) for _, f, y in rows[:: toxicity.CALIBRATION]]
    a, b = toxicity.platt(np.array([x for x, _ in kept]), np.array([y for _, y in kept]))
    return {i: a * logit(features(t)) + b for i, t, *_ in docs}


def test_toxicity_equals_plain_ftrl(spark, corpus):
    docs, labels, truth = corpus
    want = plain_ftrl(labelled()[0], truth)
    for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(-want[r.doc_id])), abs=2e-3)


def test_unequal_label_limits_do_not_shift_scores(spark, corpus):
    docs, labels, _ = corpus
    y = np.array([1] * 900 + [0] * 900)
    w = toxicity.class_weights(y, {1: 1.0, 0: 9.0})
    assert w[y == 0].sum() == pytest.approx(9 * w[y == 1].sum()) and w.sum() == pytest.approx(1800)
    x = np.random.default_rng(1).normal(y, 1)
    a, b = toxicity.platt(x, y, weight=w)
    assert (toxicity.sigmoid(a * x + b) * w).sum() / w.sum() == pytest.approx(0.1, abs=0.03)
    _, stands_for = toxicity.label_sample(labels, "toxic", {1: 20, 0: 10_000})
    positives = labels.where("toxic = 1").where(~toxicity.held_out()).select("doc_id").distinct().count()
    assert stands_for == {1: positives / 20, 0: 1.0}


def plain_co_training(rows, truth, listed):
    """Co-training over lists in memory: (calibrated logits of both views, combination) of every row."""
    n_content = quality.WIDE[0]
    sample = sorted((i for i in truth if zlib.crc32(str(i).encode()) % 5 and i in rows), key=splitmix)
    y = np.array([truth[i][0] for i in sample], float)
    rate = (y.sum() + 1) / (len(y) + 2)

    def origin(i, column):
        own = 1 if i in sample else 0
        value = rows[i][1 + column]
        good = sum(truth[j][0] for j in sample if rows[j][1 + column] == value) - own * truth.get(i, (0, 0))[0]
        bad = sum(1 - truth[j][0] for j in sample if rows[j][1 + column] == value) - own * (1 - truth.get(i, (1, 0))[0])
        return math.log((good + 2 * rate) / rate) - math.log((bad + 2 * (1 - rate)) / (1 - rate))

    def both(i):
        v = rows[i][0]
        return v[:n_content], np.array([*v[n_content:], origin(i, 0), origin(i, 1)])

    def expand(x, c, s):
        z = np.clip((x - c) / s, -5, 5)
        return np.concatenate([np.ones((len(z), 1)), z[:, 1:], z[:, 1:] ** 2 / 5], axis=1)

    xs = [np.array([both(i)[v] for i in sample]) for v in (0, 1)]
    free = [i for i in rows if i not in listed]
    us = [np.array([both(i)[v] for i in free]) for v in (0, 1)]
    fit_ = np.arange(len(y)) % quality.CALIBRATION != 0
    frames = [(x[fit_].mean(axis=0), x[fit_].std(axis=0) + 1e-6) for x in xs]
    xe, ue = [expand(x, *f) for x, f in zip(xs, frames)], [expand(u, *f) for u, f in zip(us, frames)]
    p = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    def step(x, t, w, theta, ridge=1.0):
        pen = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
        h = (x * (w * p(x @ theta) * (1 - p(x @ theta)))[:, None]).T @ x + pen
        return np.clip(np.linalg.solve(h, x.T @ (w * (p(x @ theta) - t)) + pen @ theta), -2, 2)

    def logistic(x, t, w, ridge=1.0):
        theta = np.zeros(x.shape[1])
        for _ in range(30):
            s = step(x, t, w, theta, ridge)
            theta = theta - s
            if abs(s).max() < 1e-6:
                break
        return theta

    theta = [logistic(x[fit_], y[fit_], np.ones(fit_.sum())) for x in xe]
    for r in range(1, quality.ROUNDS + 1):
        given = []
        for v in (0, 1):
            bins = quality.bin_of(ue[v] @ theta[v])
            room, share, marks = r * quality.PER_ROUND * len(free), y[fit_].mean(), np.full(len(free), -1)
            for label, order, sure, want in ((1, sorted(set(bins), reverse=True), bins > quality.bin_of(np.log(9.0) * np.ones(1))[0], room * share), (0, sorted(set(bins)), bins < quality.bin_of(-np.log(9.0) * np.ones(1))[0], room * (1 - share))):
                taken = 0
                for b in order:
                    if taken < want:
                        marks[(bins == b) & sure] = label
                        taken += (bins == b).sum()
            given.append(marks)
        for _ in range(quality.STEPS):
            new = []
            for v in (0, 1):
                k = given[1 - v] >= 0
                w = np.concatenate([np.ones(fit_.sum()), np.full(k.sum(), quality.TAUGHT * fit_.sum() / max(k.sum(), 1))])
                new.append(theta[v] - step(np.concatenate([xe[v][fit_], ue[v][k]]), np.concatenate([y[fit_], given[1 - v][k]]), w, theta[v]))
            theta = new
    cal = [quality.platt(x[~fit_] @ t, y[~fit_]) for x, t in zip(xe, theta)]
    own = [np.clip(a * (x[~fit_] @ t) + b, -12, 12) for x, t, (a, b) in zip(xe, theta, cal)]
    mix = logistic(np.stack([np.ones(len(own[0])), *own], axis=1), y[~fit_], np.ones(len(own[0])), 0.5)
    sources = [[{rows[j][1 + c]: None for j in sample}, c] for c in (0, 1)]
    out = {}
    for i in rows:  # scoring counts every labelled page of an origin
        v, odds = rows[i][0], []
        for seen, c in sources:
            value = rows[i][1 + c]
            good, bad = (sum(truth[j][0] for j in sample if rows[j][1 + c] == value), sum(1 - truth[j][0] for j in sample if rows[j][1 + c] == value)) if value in seen and value is not None else (0, 0)
            odds.append(math.log((good + 2 * rate) / rate) - math.log((bad + 2 * (1 - rate)) / (1 - rate)))
        zs = [float(np.clip(a * (expand(x[None, :], *f) @ t)[0] + b, -12, 12)) for x, f, t, (a, b) in zip((v[:n_content], np.array([*v[n_content:], *odds])), frames, theta, cal)]
        out[i] = (*zs, mix[0] + mix[1] * zs[0] + mix[2] * zs[1])
    return out


def test_quality_equals_plain_co_training(spark, corpus):
    docs, labels, truth = corpus
    half = labels.where("doc_id % 2 = 0")
    known = {i: t for i, t in truth.items() if i % 2 == 0}
    rows = {r.doc_id: (np.frombuffer(r.views, "<f4").astype(float), r.lang, r.source) for r in quality.view_rows(docs, "doc_id", "text", "lang", "source").collect()}
    want = plain_co_training(rows, known, {*known, 3})  # document 3 is listed without a label
    for r in quality.score(docs, quality.fit(docs, half.unionByName(labels.where("doc_id = 3 and quality is null")))).collect():
        for got, z in zip((r.content_score, r.metadata_score, r.score), want[r.doc_id]):
            assert got == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3)


def test_quality_on_held_out_rows(spark, corpus):
    docs, labels, truth = corpus
    model = quality.fit(docs, labels)
    out = quality.score(docs, model).withColumn("held", toxicity.held_out()).collect()
    held = [r for r in out if r.held]
    assert sum((r.score >= 0.5) == bool(truth[r.doc_id][0]) for r in held) >= 0.95 * len(held)
    rows = awkward()
    strange = quality.score(frame(spark, rows), model).collect()
    assert len(strange) == len(rows) and all(0 <= r.score <= 1 for r in strange)
    bare = quality.score(frame(spark, rows).drop("lang", "source"), model).count()
    assert bare == len(rows) and quality.score(frame(spark, rows).where("false"), model).count() == 0
    assert quality.fit(docs, labels.where("false")).constant is not None
    mixed = frame(spark, rows, ("row_id", "views", "picked_id", "row")).unionByName(docs.select("doc_id", "text", "lang", "source", "n_chars"), allowMissingColumns=True)
    assert quality.fit(mixed.where("doc_id is null or doc_id >= 0"), labels).constant is None


def test_images_are_lossless_and_checked():
    for raw in (b"", b"x" * 576, bytes(range(256)) * 9):
        payload = media.payload_of(raw)
        stored = media.encode_image(payload)
        assert media.decode_image(stored).tobytes() == payload and len(payload) % 576 == 0
        assert media.image_feature(media.decode_image(stored)) == media.image_feature(media.decode_image(media.encode_image(payload)))
    broken = bytearray(stored)
    broken[-30] ^= 1
    with pytest.raises(ValueError):
        media.decode_image(bytes(broken))


def test_interleaving_keeps_order_and_captions(spark):
    html = "<html><head><title>no</title><style>no</style></head><body><p>first <b>text</b><figure><img src='sha256:aa' alt='x'><figcaption>cap &amp; tion</figcaption></figure>second<img src='sha256:bb' alt='alone'><script>no</script><p>third"
    items = media.interleave(html)
    assert [(i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == [("text", "first text", None, None), ("media", None, "aa", "cap & tion"), ("text", "second", None, None), ("media", None, "bb", "alone"), ("text", "third", None, None)]
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (1, html)], "page_id long, html string")
    store = spark.createDataFrame([("aa", 5)], "digest string, size int")
    parsed = media.parse_pages(pages)
    assert sorted((r.page_id, len(r["items"])) for r in parsed.collect()) == [(1, 5), (1, 5), (2, 0), (3, 0)]
    for whole in (r["items"] for r in media.assemble(media.resolve(parsed, store)).collect()):
        assert [i["position"] for i in whole] == [0, 1, 2, 3, 4] and whole[1]["size"] == 5 and whole[3]["size"] is None


def captions(html):
    return [(i["digest"] or i["url"], i["caption"]) for i in media.interleave(html) if i["kind"] == "media"]


def texts(html):
    return [i["text"] for i in media.interleave(html) if i["kind"] == "text"]


def test_captions_stay_with_their_own_figure():
    one, two, three = (f'<img src="sha256:{d}" alt="alt {d}">' for d in "abc")
    assert captions(f"{one}<figcaption>stray</figcaption>{two}") == [("a", "alt a"), ("b", "alt b")]
    assert texts(f"{one}<figcaption>stray</figcaption>{two}") == ["stray"]
    assert captions(f"<figure><figcaption>before</figcaption>{one}</figure>{two}") == [("a", "before"), ("b", "alt b")]
    assert captions(f"<figure>{one}<figcaption>both</figcaption>{two}</figure>{three}") == [("a", "both"), ("b", "both"), ("c", "alt c")]
    assert captions(f"<figure>{one}<figure>{two}<figcaption>inner</figcaption></figure><figcaption>outer</figcaption></figure>") == [("a", "outer"), ("b", "inner")]
    assert captions(f"<figure>{one}<figcaption>never closed") == [("a", "never closed")]
    assert captions(f"<figure>{one}</figure><figcaption>late</figcaption>") == [("a", "alt a")]
    assert captions('<img src="https://x/y.png"><img src=""><img>') == [("https://x/y.png", None)]


def test_unclosed_parts_do_not_silence_a_page():
    assert texts("<noscript>no</head><body><p>yes</p>") == ["yes"]
    assert texts("<title>no</title><p>yes <b>and</b> on</p>") == ["yes and on"]
    assert texts("<p>a<template>no</template>b</p>") == ["ab"]
    assert texts("<p>a</p><noscript>no</noscript><p>b") == ["a", "b"]


@pytest.mark.parametrize("hot", [1000, 5])
def test_pages_with_many_images_come_back_whole(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(media, "HOT_REFERENCES", hot)
    bodies = ["", "one", "two " * 500, "three"]
    texts_ = spark.createDataFrame([(k, t) for k, t in enumerate(bodies)], "doc_id long, text string")
    media.write_store(texts_, f"{tmp_path}/store")
    names = [hashlib.sha256(media.payload_of(t.encode())).hexdigest() for t in bodies]
    html = "".join(f'<p>before {k}</p><figure><figcaption>caption {k}</figcaption><img src="sha256:{d}"></figure>' for k, d in enumerate([*names, names[1], "0" * 64]))
    pages = spark.createDataFrame([(k, html) for k in range(20)], "page_id long, html string").repartition(4)
    store = media.describe_store(spark.read.parquet(f"{tmp_path}/store"))
    for r in media.assemble(media.resolve(media.parse_pages(pages), store)).collect():
        assert [i["position"] for i in r["items"]] == list(range(12))
        assert [i["text"] for i in r["items"][::2]] == [f"before {k}" for k in range(6)]
        assert [(i["digest"], i["caption"]) for i in r["items"][1::2]] == [(d, f"caption {k}") for k, d in enumerate([*names, names[1], "0" * 64])]
        assert [i["payload_sha256"] for i in r["items"][1::2]] == [*names, names[1], None]


def test_document_media_awkward_table(spark):
    rows = awkward()
    out = media.document_media(frame(spark, rows)).collect()
    want = Counter()
    for i, t, *_ in rows:
        raw = (t or "").encode()
        p = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        want[(i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    by = defaultdict(set)
    for r in out:
        by[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by.values())
    assert media.document_media(frame(spark, rows).where("false")).count() == 0


def test_records_round_trip(spark):
    df = spark.createDataFrame([(1, "http://a", "<p>é\r\n\r\n</p>"), (2, "", "")], "page_id long, url string, html string")
    data = b"".join(bytes(r.w) for r in df.orderBy("page_id").select(warc.record(F.col("url"), F.col("html"), F.col("page_id").cast("string")).alias("w")).collect())
    got = [(f["WARC-Target-URI"], b.decode()) for _, f, b in warc.read_records(data)]
    assert got == [("http://a", "<p>é\r\n\r\n</p>"), ("", "")]
    with pytest.raises(ValueError):
        list(warc.read_records(data[:-3]))


def plain_audit(rows, copy):
    """Multiset difference of (id, record) rows of two archives, with offsets in the order of (id, hash)."""
    sides = []
    for side in (rows, copy):
        out, at = [], 0
        made = []
        for i, url, body in side:
            url, body = url or "", body or ""
            block = body.encode()
            head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:{'' if i is None else i}>\r\nWARC-Target-URI: {url}\r\nWARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}\r\nContent-Type: text/html\r\nContent-Length: {len(block)}\r\n\r\n"
            r = head.encode() + block + b"\r\n\r\n"
            made.append((i, hashlib.sha256(r).hexdigest(), len(r)))
        for i, h, n in sorted(made, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
            out.append((i, h, n, at))
            at += n
        sides.append(out)
    left = Counter((i, h) for i, h, *_ in sides[0]) - Counter((i, h) for i, h, *_ in sides[1])
    right = Counter((i, h) for i, h, *_ in sides[1]) - Counter((i, h) for i, h, *_ in sides[0])
    return left, right, sides


def test_audit_finds_exactly_the_damage(spark):
    rnd = random.Random(14)
    rows = [(k, f"u{k}", "x" * rnd.randrange(0, 50) + str(k)) for k in range(400)] + [(7, "u7", "again"), (7, "u7", "again"), (None, None, None)]
    make = lambda r: spark.createDataFrame(r, "page_id long, url string, html string").withColumn("hash", F.lit(1)).repartition(3)
    cases = {
        "intact": rows,
        "torn": [(i, u, {17: "other", 299: ""}.get(i, b)) for i, u, b in rows],
        "lost": [r for r in rows if r[0] not in (0, 250, 251, 399)],
        "extra": [*rows, (-5, "n", "n"), (100, "u100", "second"), (1000, None, "end"), (None, "x", "x")],
        "one of three lost": [r for k, r in enumerate(rows) if k != 400],
        "all at once": [(i, u, "torn" if i == 30 else b) for i, u, b in rows if i != 200] + [(77, "u", "new")],
        "shifted": [(i, u, b + "longer" if i == 0 else b) for i, u, b in rows],
        "none": [],
        "another archive": [(k, "v", "y") for k in range(50)],
    }
    for name, copy in cases.items():
        out = warc.fixity(make(rows), make(copy), fanout=4).collect()
        left, right, sides = plain_audit(rows, copy)
        assert Counter((r.page_id, r.expected_sha256) for r in out if r.expected_sha256) == left, name
        assert Counter((r.page_id, r.found_sha256) for r in out if r.found_sha256) == right, name
        assert all((r.page_id, r.expected_sha256, r.length, r.archive_offset) in sides[0] for r in out if r.expected_sha256), name
        assert all((r.page_id, r.found_sha256, r.replica_offset) in {(i, h, o) for i, h, _, o in sides[1]} for r in out if r.found_sha256), name
    assert warc.fixity(make([]), make([])).count() == 0 and warc.fixity(make([]), make(rows[:9])).count() == 9


def test_damage_touches_few_nodes(spark):
    rows = [(k, "u", f"body {k}") for k in range(5000)]
    make = lambda r: warc.hashed(spark.createDataFrame(r, "page_id long, url string, html string"))
    bounds = [1000, 2000, 3000]
    trees = [warc.tree(warc.layout(make(r), bounds, 8)).cache() for r in (rows, [r for r in rows if r[0] != 1234])]
    torn = warc.differing(*trees).collect()
    assert 1 <= len(torn) <= 2 and {r.file for r in torn} == {1}
    assert warc.differing(trees[0], trees[0]).count() == 0


def test_audit_equals_sql(spark, smoke):
    c = duckdb.connect()
    for f in glob.glob(f"{smoke}/pages.parquet"):
        c.execute(f"create view pages as select * from '{f}'")
    want = sorted(c.execute(registry.ORACLES["op7_merkle_audit"]).fetchall())
    assert sorted(map(tuple, registry.QUERIES["op7_merkle_audit"](spark, smoke).collect())) == want


def plain_components(rows, width, per_cent):
    """``component`` of each position: union-find over all pairs of shingle sets."""
    sets = []
    for _, t in rows:
        lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
        ws = [w for w in lower.translate(bytes(32 if b in SPACE else b for b in range(256))).split(b" ") if w]
        sets.append(frozenset(tuple(ws[k : k + width]) for k in range(max(1, len(ws) - width + 1))) if ws else frozenset())
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            small, big = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= per_cent * big and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(rows))]


def test_pipeline_stages(spark, smoke):
    docs = registry.table(spark, smoke, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]
    extra = docs.withColumn("m", F.create_map(F.lit("a"), "doc_id"))
    for c in ("score", "gid", "picked_id", "gone_id", "twice_id", "other_id", "row", "views", "row_id"):
        extra = extra.withColumn(c, F.lit("kept"))
    extra = extra.unionByName(extra.limit(5))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, smoke)
        assert out.columns == extra.columns and 0 < out.count() <= extra.count()
        assert stage(spark, extra.where("false"), smoke).count() == 0
    kept = corpus_pipeline.drop_near_duplicates(spark, docs.unionByName(docs.limit(5)), smoke)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({rows[k][0] for k in plain_components(rows, 5, 80)})
    rows = corpus_pipeline.run(spark, smoke).collect()
    by = defaultdict(int)
    for r in rows:
        by[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    assert all(by[r.doc_id] == r.doc_tokens for r in rows)


def test_pipeline_stages_bear_awkward_rows(spark, smoke):
    rows = awkward()
    docs = frame(spark, rows, ("score", "gid", "gone_id", "other_id"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, smoke)
        assert name == "packing" or out.columns == docs.columns
        assert out.count() > 0
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, smoke).select("doc_id", "text").collect()
    assert Counter(r.doc_id for r in kept if r.text is None) == Counter({None: 1, 60: 1})
    assert max(Counter(r.doc_id for r in kept if r.doc_id is not None).values()) == 1


def test_pipeline_equals_its_stages_one_by_one(spark, smoke, tmp_path):
    """The run is each stage over all rows that the one before kept, by plain means where one stage can be put plainly."""
    docs = registry.table(spark, smoke, "documents")
    clean = corpus_pipeline.drop_toxic(spark, docs, smoke)
    clean.write.parquet(f"{tmp_path}/clean")
    good = corpus_pipeline.keep_quality(spark, spark.read.parquet(f"{tmp_path}/clean"), smoke)
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    want = {rows[k][0] for k in plain_components(rows, 5, 80)}
    assert {r.doc_id for r in corpus_pipeline.run(spark, smoke).select("doc_id").distinct().collect()} == want


@pytest.mark.parametrize("cells", [1, 256])
def test_prefix_join_with_hot_tokens(spark, monkeypatch, cells):
    """Thresholds so low that shared tokens are hot, and cells joined by bands: the links stay the same."""
    monkeypatch.setattr(prefix_join, "HOT_ENTRIES", 2)
    monkeypatch.setattr(prefix_join, "CELLS", cells)
    rnd = random.Random(31)
    words, passage = [f"w{k}" for k in range(200)], [f"p{k}" for k in range(30)]
    rows = []
    for k in range(120):
        text = passage + [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 40]))]
        rows.append((k, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in prefix_join.near_duplicates(df, sketch_bits=17).collect())
    assert got == brute_components(rows)


def test_pipeline_removes_near_copies_of_five_word_shingles(spark, smoke):
    words = [f"w{k}" for k in range(200)]
    texts = [words, words[:100] + [f"x{k}" for k in range(10)] + words[110:], words[:170], words[:150], ["one", "two", "three", "four"], ["one", "two", "three", "four"], ["one", "two", "three", "five"]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, smoke).collect())
    assert kept == [0, 4, 6]  # 182 of 210, 166 of 196; document 3 has 146 of 166 with document 2
    shared_ = {r.doc_id: (r.n_shingles, r.component_id) for r in prefix_join.near_duplicates(docs, threshold=80, width=5, sketch_bits=17).collect()}
    assert shared_ == {0: (196, 0), 1: (196, 0), 2: (166, 0), 3: (146, 0), 4: (1, 4), 5: (1, 4), 6: (1, 6)}
    strict = {r.doc_id: r.component_id for r in prefix_join.near_duplicates(docs, sketch_bits=17).collect()}
    assert strict == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6}


@pytest.mark.parametrize("lanes", [512, 3])
def test_language_model_keeps_all_words_of_the_corpus(spark, monkeypatch, lanes):
    """Slices ask ranges directly, or in bundles where there are many ranges."""
    monkeypatch.setattr(language_model, "LANES", lanes)
    monkeypatch.setattr(language_model, "SLICE_BYTES", 1 << 16)
    monkeypatch.setattr(language_model, "RANGE_BYTES", 1 << 17)
    rows = [(k, " ".join(f"w{(k * 700 + j) % 70000}" for j in range(1000))) for k in range(100)] + [(100, None), (101, "--"), (102, "w1 w2 w1 w2 new"), (None, "w1 w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gid", F.lit(1)).repartition(3)
    targets = spark.createDataFrame([(k,) for k in range(0, 100, 3)] + [(3,), (102,), (None,)], "doc_id long")
    out = {r.doc_id: r for r in language_model.score_corpus(df, targets, prior=5.0).collect()}
    words = {k: (t or "").replace("--", "").split() for k, t in rows}
    chosen = {*range(0, 100, 3), 102}
    total = len({w for ws in words.values() for w in ws})
    counts = {}
    for name, ids in (("target", chosen), ("background", set(words))):
        counts[name] = Counter(w for k in ids for w in words[k]), Counter(a for k in ids for a in ["^", *words[k]][: len(words[k])]), Counter(p for k in ids for p in zip(["^", *words[k]], words[k]))
    for k, ws in words.items():
        assert out[k].n_tokens == len(ws) and out[k].is_target == (k in chosen) and out[k].gid == 1
        for name in ("target", "background"):
            got = out[k][f"{name}_loss"]
            if not ws:
                assert got is None
                continue
            inside = name == "background" or k in chosen
            own = (Counter(ws), Counter(["^", *ws][: len(ws)]), Counter(zip(["^", *ws], ws))) if inside else (Counter(),) * 3
            single, context, pair = counts[name]
            n = sum(single.values()) - inside * len(ws)
            want = sum(-math.log((pair[p] - own[2][p] + 5.0 * (single[p[1]] - own[0][p[1]] + 1) / (n + total + 1)) / (context[p[0]] - own[1][p[0]] + 5.0)) for p in zip(["^", *ws], ws)) / len(ws)
            assert got == pytest.approx(want, rel=1e-9)
    assert language_model.score_corpus(df.where("false"), targets).count() == 0


def test_language_model_awkward_table(spark):
    rows = awkward()
    targets = spark.createDataFrame([(1,), (None,)], "doc_id long")
    odd = frame(spark, rows, ("words_of", "counted", "slice", "keys", "target_id", "__text", "__slice", "lane"))
    out = language_model.score_corpus(odd, targets)
    assert out.count() == len(rows) and out.where("words_of = 'kept' and counted = 'kept' and slice = 'kept' and lane = 'kept'").count() == len(rows)
    assert out.where("n_tokens = 0 and difference is null").count() == sum(not (r[1] or "").strip() or r[1] in ("--",) for r in rows)
