"""Systematic mixing, cross-tokenizer alignment and hard negatives against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from panelforge.llm import alignment, hard_negatives, mixing, registry

from .helpers import awkward, frame

public_tokenizers = pytest.importorskip("public_tokenizers")


# mixing ---------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    """Share, stop, share the excess anew, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = Fraction(sum(sizes.values())), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if share * weight[s] > cap * sizes[s]]
        if not above:
            return out | {s: share * weight[s] for s in open_}
        for s in above:
            out[s] = Fraction(cap * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def sizes_of(rows):
    out = Counter()
    for r in rows:
        out[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    return out


@pytest.mark.parametrize("tilt", [False, True])
def test_mix_meets_targets(spark, tilt):
    rows = awkward(5, 120)
    if tilt:  # a few sources too small for their weight
        rows = [(r[0], r[1], r[2], "tiny" if k % 29 == 0 and r[3] else r[3], r[4]) for k, r in enumerate(rows)]
    out = mixing.mix_documents(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes, want = sizes_of(rows), plain_targets(sizes_of(rows))
    taken, largest = Counter(), Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], float(want[r["source"]]), rel_tol=1e-12)
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    again = mixing.mix_documents(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mix_emits_and_passes_columns(spark):
    rows = awkward(6)
    docs = frame(spark, rows, clash=("copies", "target", "held", "range", "place", "c0"))
    sized = docs.withColumn("n", mixing.words(F.col("text"))).drop("text")
    mixed = mixing.mix(sized, size="n")
    assert set(sized.columns) - {"copies", "target"} < set(mixed.columns) and mixed.where("held = 'kept' and c0 = 'kept'").count() == len(rows)
    assert mixing.emit(mixed).count() == mixed.agg(F.sum("copies")).first()[0]


def test_mix_of_nothing_and_of_one_repeated_row(spark):
    assert mixing.mix_documents(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
    same = [(None, None, None)] * 50 + [(1, "a", "")]
    out = mixing.mix_documents(spark.createDataFrame(same, "doc_id long, source string, text string")).collect()
    assert len(out) == 51 and all(r["taken"] == 0 and r["target"] == 0 for r in out)
    copies = spark.createDataFrame([(7, "a", "x y")] * 90 + [(8, "b", "z")] * 10, "doc_id long, source string, text string")
    out = mixing.mix_documents(copies).collect()
    taken = Counter()
    for r in out:
        taken[r["source"]] += r["taken"]
    want = plain_targets({"a": 180, "b": 10})
    assert abs(taken["a"] - want["a"]) <= 2 and abs(taken["b"] - want["b"]) <= 1 and want["b"] == 30


# alignment ------------------------------------------------------------------------------------


def plain_alignment(texts):
    """Both libraries, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    from panelforge.llm.bpe import byte_symbols

    a_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = {c: k for k, c in enumerate(byte_symbols())}
    grouped = []
    for t in texts:
        groups = []
        if t:
            a = [(i, len(bytes(back[c] for c in a_tok.id_to_token(i)))) for i in a_tok.encode(" " + t, add_special_tokens=False).ids]
            pieces = [(i, bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()) for i in b_tok.encode(t) for p in [b_tok.id_to_piece(i)]]
            if b"".join(p for _, p in pieces) == (" " + t).encode():
                at_a = at_b = 0
                b = iter([(i, len(p)) for i, p in pieces])
                own_a, own_b = [], []
                for i, n in a:
                    own_a.append(i)
                    at_a += n
                    while at_b < at_a:
                        j, m = next(b)
                        own_b.append(j)
                        at_b += m
                    if at_a == at_b:
                        groups.append((own_a, own_b))
                        own_a, own_b = [], []
        grouped.append(groups)
    count = Counter()
    for groups in grouped:
        count.update({(i, j) for a, b in groups for i in a for j in b})
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for groups in grouped:
        links = [(i, j) for a, b in groups for i in a for j in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else "", text))
    return out


def aligned(spark, docs, monkeypatch=None):
    return alignment.align_documents(docs, registry.vocabulary(registry.BYTE_VOCABULARY), registry.piece_model(registry.PIECE_MODEL), written=True).collect()


EDGES = [" ", "  a  b ", "a\n\n b\t", "\n", " \n ", "▁x", "<s> </s> <unk> <0x41> <|endoftext|>", "日本　é ﬁ 東京タワー", "a\x00b", "abc   ", "é Å ​", "the " * 400, "🙂🙂 x", "Ω" * 300]


def test_alignment_equals_libraries(spark):
    rows = awkward(9, 40) + [(500 + k, t, "en", "src0", 0) for k, t in enumerate(EDGES)]
    want = sorted(((r[0] is None, r[0] or 0), w) for r, w in zip(rows, plain_alignment([r[1] for r in rows])))
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), tuple(r)[1:]) for r in aligned(spark, frame(spark, rows)))
    assert got == want


def test_alignment_of_documents_and_of_nothing(spark, smoke):
    docs = registry.table(spark, smoke, "documents")
    rows = docs.orderBy("doc_id").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in aligned(spark, docs)}
    assert got == {r["doc_id"]: w for r, w in zip(rows, plain_alignment([r["text"] for r in rows]))}
    assert aligned(spark, docs.limit(0)) == []


def test_wide_groups_are_paired_by_distinct_ids(spark, monkeypatch):
    import numpy as np

    x = object.__new__(alignment.Aligned)
    rng = np.random.default_rng(3)
    x.n, x.width = 2, 50
    x.a, x.b = rng.integers(0, 40, 300), rng.integers(0, 50, 200)
    x.first_a, x.first_b = np.array([0, 120, 300]), np.array([0, 150, 200])
    x.n_a, x.n_b, x.doc = np.diff(x.first_a), np.diff(x.first_b), np.array([0, 1])
    x.doc_a = np.repeat([0, 1], [120, 180])
    want = Counter((g, i, j) for g in range(2) for i in x.a[x.first_a[g] : x.first_a[g + 1]].tolist() for j in x.b[x.first_b[g] : x.first_b[g + 1]].tolist())
    for wide, links in ((1, 64), (10**6, 1000)):
        monkeypatch.setattr(alignment, "WIDE", wide)
        monkeypatch.setattr(alignment, "LINKS", links)
        keys, n = x.links()
        top = alignment.Aligned._top
        assert {(k // (top * 50), k // 50 % top, k % 50): m for k, m in zip(keys.tolist(), n.tolist())} == want


# hard negatives -------------------------------------------------------------------------------


def plain_negatives(rows, positives=5, negatives=10):
    ok = [(i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, [math.floor(256 * x) for x in v]) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    late = lambda i: (i is None, i or 0)
    out = []
    for i, y, q in ok:
        if i is None or i % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, p)), late(j), j, z == y) for j, z, p in ok if j != i), key=lambda t: t[:2])
        for s, _, j, _ in [t for t in scored if t[3]][:positives]:
            hits = [t for t in scored if not t[3] and -30 * s <= -100 * t[0] <= -90 * s][:negatives]
            out += [(i, j, k + 1, t[2], -s, -t[0]) for k, t in enumerate(hits)]
    return sorted(map(str, out))


def mined(df, **more):
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(str(tuple(r)) for r in hard_negatives.mine(df, F.col("id") % 100 == 0, relabel=label, **more).collect())


SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed=0, n=700, dims=8):
    import numpy as np

    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dims))
    rows = [(k, (0.4 * rng.normal(size=dims) + centre[k % 6]).astype("float32").tolist(), int(rng.integers(0, 4))) for k in range(n)]
    rows += [(n + k, rows[100][1], k % 3) for k in range(150)]  # one hot vector: ties go by id
    rows += [(2000, None, 1), (2100, [1.0] * dims, None), (2200, [1.0, None] * (dims // 2), 1), (2300, [float("nan")] * dims, 1), (2400, [float("inf")] * dims, 1), (2500, [0.0] * dims, 2), (2600, [], 2), (2700, [1.0, 1.0], 3), (None, rows[3][1], 1), (None, rows[100][1], 2)]
    return rows


def test_negatives_equal_all_pairs(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("kept")).withColumn("score", F.lit("kept")).repartition(3)
    want = plain_negatives(rows)
    assert len(want) > 100 and mined(df) == want
    assert mined(df, anchors_at_a_time=3) == want
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 40)
    assert mined(df) == want


def test_negatives_of_large_values_and_of_nothing(spark):
    rows = [(k, [float(3 ** (k % 11)) * 50, 5.0 * k - 900, 1e4], k % 2) for k in range(220)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(df) == plain_negatives(rows)
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id % 100 <> 0")) == []
    assert mined(df.where("vec_id = 100")) == []


def test_brackets_rule_rows_out():
    """On rows that lie in clusters most pairs never reach the exact check, and none that counts is lost."""
    import numpy as np

    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 16)) * 600
    q = np.round(centre[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * 12).astype(np.int64)
    pivots = hard_negatives.Pivots.of(q[:200], float((q.astype(float) ** 2).sum(axis=1).max()), 12)
    a = hard_negatives.Anchors(np.arange(40), np.zeros(40), q[:40], pivots)
    score = hard_negatives.products(q[:40], q)
    fifth = np.sort(score, axis=1)[:, -5]
    near = hard_negatives.reach(a.squared, pivots.most, fifth)
    alive = a.candidates(pivots.of_rows(q), near, np.zeros(40), np.arange(40))
    assert alive[score >= fifth[:, None]].all() and alive.mean() < 0.5
