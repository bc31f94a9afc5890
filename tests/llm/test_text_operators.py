"""Tokenizing, packing, counts and fingerprints against the libraries and plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm import chunking, packing, registry, shared, spans, textbytes, token_tree, transcode
from panelforge.llm.bpe import WINDOW, Merges, StreamingDecoder, StreamingEncoder, TextEncoder
from tests.llm.helpers import awkward, frame


@pytest.fixture(scope="module")
def byte_json():
    return registry.vocabulary(registry.BYTE_VOCABULARY)


@pytest.fixture(scope="module")
def merges(byte_json):
    return Merges(byte_json)


@pytest.fixture(scope="module")
def library(byte_json):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(byte_json)


@pytest.fixture(scope="module")
def classes():
    return spans.library_classes()


@pytest.fixture(scope="module")
def encoder(merges, classes):
    return TextEncoder(merges, classes)


def encode(encoder, texts, most=50_000):
    out = []
    for a, b, buf, offs in textbytes.slices(pa.array(texts, pa.string()), most):
        ids, f = encoder.encode(buf, offs)
        out += [ids[f[k] : f[k + 1]].tolist() for k in range(b - a)]
    return out


def streamed(encoder, text):
    return [i for ids in encoder.stream(np.frombuffer(text.encode(), dtype=np.uint8)) for i in ids.tolist()]


def any_characters(rnd, n):
    """Characters of all planes among ordinary ones."""
    codes = [rnd.randrange(0x80, 0x30000) for _ in range(n)]
    return "".join(chr(c) if rnd.random() < 0.4 and not 0xD800 <= c < 0xE000 else rnd.choice("ab 's\n'1.é日 ") for c in codes)


ENGLISH = ["don't", "I'll", "we've", "the", "THE", " ", "  ", "\n", "'", "''", "'s", "'re", " 's", "😀", "é", "É", "Σ", "İ", "J\u030c", "e\u0301", "<|endoftext|>", "<|startoftext|>", "x<|endof", "\u3000", "12", "日本語", "z" * 30]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abthe IQ.é'É1 \n\t-ñ日😀\x85　<|>")), max_size=200), min_size=1, max_size=5))
def test_encoder_equals_library(encoder, library, texts):
    assert encode(encoder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoders_equal_library_on_mixed_text(merges, library, classes):
    from tokenizers import Tokenizer

    vocabulary = registry.vocabulary(registry.WORD_VOCABULARY)
    words, rnd = Tokenizer.from_str(vocabulary), random.Random(21)
    texts = ["".join(rnd.choice(ENGLISH) for _ in range(rnd.randrange(300))) for _ in range(150)] + [any_characters(rnd, 300) for _ in range(300)]
    texts += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000)) for _ in range(20)]
    assert encode(TextEncoder(merges, classes), texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode(packing.WordEncoder(vocabulary, classes), texts) == [words.encode(t, add_special_tokens=False).ids for t in texts]


def test_characters_are_filed_as_the_library_files_them(classes, library):
    own, rnd = spans.Classes(classes), random.Random(22)
    for c in [*range(1, 0x3000), *(rnd.randrange(0x3000, 0x110000) for _ in range(20000))]:
        if not 0xD800 <= c < 0xE000 and c != 0x20:
            begins = {at for _, (at, _) in library.pre_tokenizer.pre_tokenize_str(f"a{chr(c)}1-{chr(c)}-")}
            want = spans.LETTER if 1 not in begins else spans.NUMBER if 2 not in begins else spans.OTHER if 4 not in begins else spans.WHITE
            assert own.table[c] == want, hex(c)


def test_small_table_resets_and_stays_bounded(merges, library, classes):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 12))) + " " for _ in range(400)] + ["-" * 9000, "=-" * 4000, "a" * 7000, " " * 5000 + "x", "<|endoftext|>" * 3]
    encoder = TextEncoder(merges, classes, most=64)
    assert encode(encoder, texts, 100) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    for most in (64, 1024):  # whole texts, long words and apostrophes never fill the table
        encoder = TextEncoder(merges, classes, most=most)
        for k in range(60):
            encode(encoder, [f"it's {chr(0x4E00 + k)}{'日' * 500} {'w' * 900}{k} can't {k * 7919}"])
            assert encoder.n <= most and encoder.used <= 16 * most and len(encoder.slots) == 1 << max(8, most.bit_length())


@pytest.mark.parametrize("size", [97, 5000])
def test_blocks_of_a_long_text_give_the_same_ids(merges, library, classes, size):
    encoder, rnd = TextEncoder(merges, classes), random.Random(23)
    encoder.SLICE = size
    texts = ["z" * 50000, " " * 20000 + "x", "'" * 9000 + "s", "a'" * 9000, "日本" * 9000 + "。" * 9000, "<|endoftext|>" * 2000, "1" * 30000, " \n" * 8000 + "\u3000" * 9000 + "e", "-=- " * 4000 + "''s" * 3000]
    texts += ["".join(rnd.choice(ENGLISH) for _ in range(200)) for _ in range(60)] + [any_characters(rnd, 2000)]
    for t in texts:
        assert streamed(encoder, t) == library.encode(t, add_special_tokens=False).ids


def test_lookahead_makes_streams_exact(merges, library):
    k = merges.sufficient_lookahead()
    assert 0 < k < WINDOW
    rnd = random.Random(2)
    texts = [(piece * 6000)[: 5000 + rnd.randrange(500)] for piece in ("-", "=", "a", "ab", "the", "-=-")]
    texts += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000)) for _ in range(30)]
    for text in texts:
        raw, stream, ids, at = text.encode(), StreamingEncoder(merges, k), [], 0
        while at < len(raw):
            n = rnd.randrange(1, 700)
            ids += stream.feed(raw[at : at + n])
            assert len(stream.held) < WINDOW
            at += n
        ids += stream.finish()
        assert ids == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=60), st.integers(1, 7))
def test_decoder_equals_library(merges, library, ids, step):
    d = StreamingDecoder(merges)
    text = "".join(d.feed(ids[k : k + step]) for k in range(0, len(ids), step)) + d.finish()
    assert text == library.decode(ids, skip_special_tokens=False)


def test_transcode_awkward_table(spark, byte_json, library):
    rows = awkward()
    out = transcode.digests(transcode.transcode_documents(frame(spark, rows), byte_json)).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in out) == want
    assert transcode.transcode_documents(frame(spark, rows).where("false"), byte_json).count() == 0


def test_packing_awkward_table(spark):
    from tokenizers import Tokenizer

    vocabulary = registry.vocabulary(registry.WORD_VOCABULARY)
    tok, rows = Tokenizer.from_str(vocabulary), awkward()
    out = packing.pack_documents(frame(spark, rows), vocabulary).collect()
    assert len({r.sequence_id for r in out}) == len(out)
    whole = Counter()
    for i, t, *_ in rows:
        whole[(i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1]))] += 1
    pieces = Counter()
    for r in out:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.length == 1 << r.bucket and r.offset == 0
        pieces[(r.doc_id, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.doc_tokens)] += 1
    want = Counter()
    for (i, ids), n in whole.items():
        at = 0
        for size in packing.piece_lengths(len(ids)):
            want[(i, at, ids[at : at + size], len(ids))] += n
            at += size
        assert at == len(ids)
    assert pieces == want
    r = packing.digests(packing.pack_documents(frame(spark, rows), vocabulary)).first()
    assert 0 <= r.ids_crc32 < 2**32
    assert packing.piece_lengths(4096 + 5) == [2048, 2048, 4, 1]
    with pytest.raises(ValueError):
        packing.pack_documents(frame(spark, rows), vocabulary, seq_len=1000)


def grown(encoder, text):
    buf = np.frombuffer(text.encode(), dtype=np.uint8)
    _, chars, sizes, tokens = (x.tolist() for x in token_tree.leaves_of(encoder, buf, np.array([0, len(buf)])))
    cuts = np.cumsum([0, *chars]).tolist()
    return token_tree.DocumentTree([text[i:j] for i, j in zip(cuts, cuts[1:])], sizes, tokens)


def test_token_tree_follows_edits(encoder, library):
    library.encode_special_tokens = True
    rnd = random.Random(3)

    def make(m):
        return "".join(rnd.choice(["a", "the", "  ", " ", "'", "s", "re", "'ll", "\n", "é", "日", "1", "!!", "ing "]) for _ in range(m))

    def count(t):
        return len(library.encode(t, add_special_tokens=False).ids)

    for k in range(160):
        text = make(rnd.randrange(0, 600))
        tree = grown(encoder, text)
        assert tree.total == count(text) and tree.text == text
        for _ in range(6):
            n = tree.chars.total
            s = rnd.randrange(0, n + 1)
            e, new = min(n, s + rnd.choice([0, 3, 9, 200])), make(rnd.choice([0, 1, 4, 300 if k % 7 == 0 else 4]))
            want = tree.text[:s] + new + tree.text[e:]
            tree.settle(encoder.counts_of([w.encode() for w in tree.edit(s, e, new, encoder.pretoken_pattern)]).tolist())
            assert tree.text == want and tree.total == count(want)
            assert tree.chars.total == len(want) and sum(tree.sizes) == len(encoder.pretoken_pattern.findall(want))
    library.encode_special_tokens = False


def test_counts_while_the_table_grows(merges, classes, library):
    text = " ".join(f"w{k * 7919 % 100003}" for k in range(40000))
    library.encode_special_tokens = True
    assert grown(TextEncoder(merges, classes), text).total == len(library.encode(text, add_special_tokens=False).ids)
    fresh = TextEncoder(merges, classes)
    assert encode(fresh, [text], 10**6)[0] == library.encode(text, add_special_tokens=False).ids
    library.encode_special_tokens = False


def test_an_edit_encodes_its_surroundings_only(encoder):
    tree = grown(encoder, "some words of a long text " * 5000)
    tree.settle(encoder.counts_of([w.encode() for w in tree.edit(60000, 60005, "it's", encoder.pretoken_pattern)]).tolist())
    assert tree.encoded <= 6 * token_tree.BLOCK and tree.touched <= 6 * 13


def test_edit_counts_awkward_table(spark, byte_json, library):
    rows = awkward()
    docs = frame(spark, rows).withColumn("edits", F.lit(1)).withColumn("leaf_chars", F.lit("kept"))
    out = token_tree.count_edits(docs, token_tree.revision(F.coalesce(F.col("text"), F.lit(""))), byte_json).collect()
    library.encode_special_tokens = True
    want = Counter()
    for i, t, *_ in rows:
        u = t = t or ""
        edits = [(len(t) // 4, 7, ""), (len(t) // 2, 5, "it's re-worded,"), (len(t) * 3 // 4, 0, "\n\nAn added sentence of 2026. ")]
        for at, n, new in sorted(edits, key=lambda e: -e[0]):  # each to the text as the one before left it
            u = u[:at] + new + u[at + n :]
        want[(i, len(library.encode(t, add_special_tokens=False).ids), len(library.encode(u, add_special_tokens=False).ids), hashlib.sha256(u.encode()).hexdigest())] += 1
    library.encode_special_tokens = False
    assert Counter((r.doc_id, r.n_tokens, r.n_tokens_after, r.edited_sha256) for r in out) == want
    assert token_tree.count_edits(docs.where("false"), F.lit(None).cast("array<struct<start:int,length:int,text:string>>"), byte_json).count() == 0


def test_trees_are_kept_and_edited_again(spark, byte_json, library, tmp_path):
    docs = spark.createDataFrame([(k, f"Document {k} isn't long. " * (k + 1)) for k in range(30)], "doc_id long, text string")
    token_tree.grow_trees(docs, byte_json).write.parquet(f"{tmp_path}/trees")
    edits = F.array(F.struct(F.lit(3).alias("start"), F.lit(4).alias("length"), F.lit("'ll").alias("text")))
    once = token_tree.edit_trees(spark.read.parquet(f"{tmp_path}/trees"), edits, byte_json)
    once.write.parquet(f"{tmp_path}/again")
    for r in token_tree.edit_trees(spark.read.parquet(f"{tmp_path}/again"), edits, byte_json).collect():
        t = f"Document {r.doc_id} isn't long. " * (r.doc_id + 1)
        for _ in range(2):
            t = t[:3] + "'ll" + t[7:]
        assert r.text == t and sum(r.leaf_tokens) == len(library.encode(t, add_special_tokens=False).ids)


def test_chunks_resist_shifts():
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdefghij \n") for _ in range(6000)).encode()
    a, b, c = chunking.chunk_sets([text, b"a few bytes more" + text, text])
    assert (a == c).all() and chunking.containment(a, b) > 0.97
    other = chunking.chunk_sets(["".join(rnd.choice("abcdefghij \n") for _ in range(6000)).encode()])[0]
    assert chunking.containment(a, other) < 0.05
    alone = [chunking.chunk_sets([t])[0] for t in (text, b"", b"xy")]
    together = chunking.chunk_sets([text, b"", b"xy"])
    assert all((x == y).all() for x, y in zip(alone, together)) and len(alone[1]) == 0
    sizes = alone[0] & np.uint64(255)
    assert sizes.max() <= chunking.MOST
    assert chunking.containment(alone[1], alone[1]) == 1.0 and chunking.containment(alone[1], a) == 0.0


def plain_chunks(raw):
    """Chunks by the definition: a hash of the last 16 bytes, byte by byte."""
    gear, out, begin = chunking._GEAR.tolist(), [], 0
    for i in range(len(raw)):
        size = i + 1 - begin
        h = sum(gear[raw[i - k]] << k for k in range(16) if i - k >= 0) % 2**32
        lenient, strict = h >> 22 & 0b1111 == 0, h >> 22 & 0b111111 == 0
        if size >= chunking.LEAST and (strict or size >= chunking.NORMAL and lenient) or size == chunking.MOST:
            out.append(raw[begin : i + 1])
            begin = i + 1
    return [*out, raw[begin:]] if begin < len(raw) else out


def test_chunks_equal_plain_chunks():
    rnd = random.Random(41)
    texts = ["", "a", "z" * 700, "é" * 90, *("".join(rnd.choice(["word ", "other ", "é", "\n", "12 "]) for _ in range(rnd.randrange(300))) for _ in range(40))]
    texts += [t[: len(t) // 2] + "edited" + t[len(t) // 2 :] for t in texts]
    sets, named = chunking.chunk_sets([t.encode() for t in texts]), {}
    plain = [set(plain_chunks(t.encode())) for t in texts]
    for own, chunks in zip(sets, plain):
        assert sorted((own & np.uint64(255)).tolist()) == sorted(len(c) for c in chunks)
        for c in chunks:  # one digest for one chunk, wherever it occurs
            digest = chunking.chunk_sets([c])[0]
            if len(digest) == 1 and plain_chunks(c) == [c]:
                assert named.setdefault(c, digest[0]) == digest[0] and digest[0] in own
    assert len(set(named.values())) == len(named)
    for _ in range(300):
        a, b = rnd.randrange(len(texts)), rnd.randrange(len(texts))
        total = sum(map(len, plain[a]))
        want = sum(len(c) for c in plain[a] & plain[b]) / total if total else float(not plain[b])
        assert chunking.containment(sets[a], sets[b]) == pytest.approx(want)


def test_fingerprints_awkward_table(spark):
    rows = awkward()
    out = chunking.fingerprint_documents(frame(spark, rows)).collect()
    order = sorted(((i if i is not None else -(2**63), t or "", i) for i, t, *_ in rows), key=lambda r: (-r[0], r[1].encode()))
    want = Counter()
    for k, (_, t, i) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        e = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        own, changed, following = chunking.chunk_sets([t.encode(), e.encode(), order[(k + 1) % len(order)][1].encode()])
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), chunking.text_of(own), chunking.text_of(changed), chunking.containment(own, changed), chunking.containment(own, following))] += 1
    assert Counter(tuple(r) for r in out) == want
    assert chunking.fingerprint_documents(frame(spark, rows).where("false")).count() == 0
    one = chunking.fingerprint_documents(frame(spark, rows[:1])).first()
    assert one.near_next == 1.0
    assert zlib.crc32(b"") == 0


def test_a_text_is_sent_to_the_worker_once(spark):
    """A string column that passes through is read there; any other text is cast and sent beside it."""
    docs = spark.createDataFrame([(1, "one"), (2, None), (3, "")], "doc_id long, text string")
    types = {"n": T.IntegerType()}

    def sizes(text):
        return {"n": np.concatenate([np.empty(0, np.int32), *(np.diff(offs).astype(np.int32) for *_, offs in textbytes.slices(text))])}

    out = shared.append_columns(docs, "text", sizes, types)
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "one", 3), (2, None, 0), (3, "", 0)]
    assert "input_" not in out._jdf.queryExecution().analyzed().toString()
    number = shared.append_columns(docs.select("doc_id", F.col("doc_id").alias("text")), "text", sizes, types)
    assert [tuple(r) for r in number.orderBy("doc_id").collect()] == [(1, 1, 1), (2, 2, 1), (3, 3, 1)]
