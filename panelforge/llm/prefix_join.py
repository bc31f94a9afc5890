"""N-gram Jaccard self-join by grouped prefixes, with the components of its links.

Exact, in five steps that never enumerate the pairs of a group of copies:

1. Classes.  Each text's set of word shingles (64-bit hashes) is formed in one
   pass; texts with equal sets are one class and only the class goes on.
2. Order.  Tokens are ordered by an estimate of their frequency over all texts
   (one fixed-size array of counts, merged over partitions), then by hash.  Any
   order is correct; rare tokens first makes prefixes selective.
3. Groups.  Classes with the same prefix and size form one group; a prefix
   holds the first n - ceil(t*n) + 3 of n tokens, so linked sets share three
   tokens (or all, if they must share fewer) in both prefixes.
4. Stars.  Every group that shares a prefix token with others is paired with that
   token's most central group (the one where the token comes first), and members
   of a group with their leader.  Verified links give first components.
5. The rest.  Prefix entries are summarised in cells (token, size, position,
   range of components).  Pairs of cells survive if their sizes and positions
   allow the threshold and they are not known to be one component; only these are
   expanded to groups, then to members, and verified.

Every pair of linked classes is verified in 4 or 5, or is already in one
component when 5 runs, so components are exact.  Verification first compares
512-bit parity signatures: they differ in at most as many bits as the sets differ
in tokens, so a pair beyond the allowed difference goes without its sets being
moved.  The sets of the rest are recomputed from texts (a Bloom filter sized by how
many are wanted thins the scan, the join that follows is exact).

Set and group ids have 128 bits.  Tokens that very many groups share are joined by
broadcasting them (there are at most HOT_TOKENS of them), so their entries stay where
they are and no task gathers one token's entries.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import shared, sketch, textbytes
from panelforge.llm.components import components
from panelforge.llm.shared import cut, release

THRESHOLD = 90  # per cent
#: Words of a shingle.
WIDTH = 3
#: 2**SKETCH_BITS frequency counts; a fixed 16 MB.
SKETCH_BITS = 22
#: A filter has 16 bits for each wanted set, 2**20 to 2**28 (32 MB) in all; fuller ones let more sets through to the exact join.
BLOOM_LEAST, BLOOM_MOST = 20, 28
#: A token is hot if it has more than this share of all entries (1 / HOT_TOKENS) and more than HOT_ENTRIES.
HOT_TOKENS, HOT_ENTRIES = 2000, 1000
#: A token's cells up to this many are paired at once; those of more are dealt by bands of sizes first.
CELLS = 256
#: The one band of all cells of a token that are paired at once; bands of sizes begin at -1.
UNBANDED = -2
#: Prefix tokens that linked sets have in common.
SHARED = 3


def _documents(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, buf, offs in textbytes.slices(batch.column(1)):
        h, begin = textbytes.document_shingles(buf, offs, width)
        yield a, b, h, begin


def _group_id(prefix: np.ndarray, n: int) -> bytes:
    """128 bits of a prefix and the size of its set."""
    return hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=16).digest()


def _set_id(s: np.ndarray) -> bytes:
    """128 bits that depend on the set alone."""
    with np.errstate(over="ignore"):
        return np.array([textbytes.mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(), textbytes.mix(s + np.uint64(0x1234567)).sum(), len(s)], dtype="<u8").tobytes()[:20]


def token_counts(docs: DataFrame, bits: int = SKETCH_BITS, width: int = WIDTH) -> np.ndarray:
    """Counts of all shingles of all texts in 2**bits buckets of their hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.ENGINES.clear()
        total = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            for _, _, h, _ in _documents(batch, width):
                key, n = np.unique((h >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                total[key] += n.astype(np.uint32)
        yield from sketch.blocks(total)
        del total
        shared.tidy()

    return sketch.summed(docs.mapInArrow(count, sketch.SCHEMA), 1 << bits)


def _signature(s: np.ndarray) -> np.ndarray:
    """Parities of the tokens that fall on each of 512 bits, as eight longs."""
    odd = np.bincount((textbytes.mix(s ^ np.uint64(0x3C3C3C3C)) & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame, counts, threshold: int, bits: int, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_shingles, sid, sig, prefix, gid`` of every row; the last four are null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            for a, b, h, begin in _documents(batch, width):
                size, sids, sigs, prefixes, gids = [], [], [], [], []
                for k in range(b - a):
                    s = np.unique(h[begin[k] : begin[k + 1]])
                    n = len(s)
                    size.append(n)
                    if not n:
                        for x in (sids, sigs, prefixes, gids):
                            x.append(None)
                        continue
                    keep = min(n, n - (threshold * n + 99) // 100 + SHARED)
                    order = np.argsort(table[(s >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")[:keep]
                    sids.append(_set_id(s))
                    sigs.append(_signature(s))
                    prefixes.append(s[order].view(np.int64))
                    gids.append(_group_id(prefixes[-1], n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(size, pa.int64()), pa.array(sids, pa.binary()), pa.array(sigs, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64())), pa.array(gids, pa.binary())],
                    names=["doc_id", "n_shingles", "sid", "sig", "prefix", "gid"],
                )
        shared.tidy()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, sid binary, sig array<bigint>, prefix array<bigint>, gid binary")


def _bloom_places(sids: list[bytes], bits: int) -> np.ndarray:
    """The three bits of each sid, one row a sid."""
    words = np.frombuffer(b"".join(s[:16] for s in sids), dtype="<u8").reshape(-1, 2)
    with np.errstate(over="ignore"):
        return np.stack([(words[:, 0] + np.uint64(k) * (words[:, 1] | np.uint64(1))) >> np.uint64(64 - bits) for k in range(3)], axis=1).astype(np.int64)


def _bloom(sids: DataFrame, bits: int) -> np.ndarray:
    """A filter that holds all sids; partitions send their set bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << (bits - 3), dtype=np.uint8)
        for batch in batches:
            at = _bloom_places(batch.column(0).to_pylist(), bits).reshape(-1)
            np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield from sketch.blocks(held)

    return sketch.summed(sids.mapInArrow(run, sketch.SCHEMA), 1 << (bits - 3), np.uint8, np.bitwise_or)


def _sets(docs: DataFrame, sids: DataFrame, width: int) -> DataFrame:
    """``sid, tokens`` of the classes named by ``sids`` (and a few more)."""
    bits = min(max((16 * sids.count()).bit_length(), BLOOM_LEAST), BLOOM_MOST)
    held = docs.sparkSession.sparkContext.broadcast(_bloom(sids, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            for a, b, h, begin in _documents(batch, width):
                own: dict[bytes, np.ndarray] = {}
                for k in range(b - a):
                    s = np.unique(h[begin[k] : begin[k + 1]])
                    if len(s):
                        own.setdefault(_set_id(s), s.view(np.int64))
                if not own:
                    continue
                names = list(own)
                at = _bloom_places(names, bits)
                wanted = (table[at >> 3] >> (at & 7) & 1).all(axis=1)
                out = {name: own[name] for name, w in zip(names, wanted.tolist()) if w}
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.list_(pa.int64()))], names=["sid", "tokens"])
        shared.tidy()

    return docs.mapInArrow(run, "sid binary, tokens array<bigint>").join(sids, "sid", "left_semi").groupBy("sid").agg(F.first("tokens").alias("tokens"))


def _by_token(entries: DataFrame, tokens: DataFrame, hot: DataFrame) -> DataFrame:
    """``entries`` joined with one row a token; entries of hot tokens are not moved.

    ``hot`` has at most HOT_TOKENS tokens: fewer entries than HOT_TOKENS times a hot token's exist.
    """
    hot = F.broadcast(hot.select("token"))
    few = F.broadcast(tokens.join(hot, "token", "left_semi"))
    return entries.join(hot, "token", "left_anti").join(tokens, "token").unionByName(entries.join(few, "token"))


def _close(x, n, y, m, threshold: int):
    """Whether signatures x and y of sets of n and m tokens allow the threshold."""
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, k: t + k)
    return (100 + threshold) * apart <= (100 - threshold) * (n + m)


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, threshold: int, width: int) -> DataFrame:
    """The distinct pairs (a, b) of sids whose sets reach the threshold."""
    x, y = (classes.select(F.col("sid").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"sig{k}")) for k in "ab")
    pairs = pairs.distinct().join(x, "a").join(y, "b").where(_close(F.col("siga"), F.col("na"), F.col("sigb"), F.col("nb"), threshold))
    pairs = cut(pairs.select("a", "b"))
    release(docs.sparkSession)
    ends = cut(pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct())
    sets = cut(_sets(docs, ends, width))
    release(docs.sparkSession)
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("tokens").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return cut(both.where((100 + threshold) * common >= threshold * (F.size("x") + F.size("y"))).select("a", "b"))


def _possible(i, n, j, m, threshold: int):
    """Whether sets of n and m tokens, one of whose first SHARED common ones is at i and j (from 0), can reach the threshold."""
    return (100 + threshold) * (F.least(n - i, m - j) + (SHARED - 1)) >= threshold * (n + m)


def _band(n, threshold: int):
    """Bands of sizes, each as wide as the threshold allows linked sizes to differ; a little wider, for rounding."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(100 / threshold) * 1.0001 + 1e-9)).cast("int") if threshold < 100 else n.cast("int") * 2


def _candidates(pairs: DataFrame, heads: DataFrame, threshold: int) -> DataFrame:
    """Group pairs (g, h), one row a shared token, that share enough tokens and whose leaders' signatures allow it if alone.

    A group of several classes keeps its pairs: its members' signatures differ.
    """
    x, y = (heads.select(F.col("gid").alias(k), F.col("n").alias(f"n{k}"), F.col("lead.sig").alias(f"sig{k}"), F.col("lead.sid").alias(f"sid{k}"), F.col("members").alias(f"m{k}")) for k in "gh")
    least = F.least(F.lit(SHARED), *(F.floor((threshold * F.col(f"n{k}") + 99) / 100) for k in "gh"))
    counted = pairs.groupBy("g", "h").agg(F.count("*").alias("tokens"))
    both = counted.join(x, "g").join(y, "h").where(F.col("tokens") >= least)
    return both.where((F.col("mg") > 1) | (F.col("mh") > 1) | _close(F.col("sigg"), F.col("ng"), F.col("sigh"), F.col("nh"), threshold))


def near_duplicates(docs: DataFrame, *, threshold: int = THRESHOLD, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Two rows link when 100 * |intersection| >= threshold * |union| of their
    sets of ``width``-word shingles; ``component_id`` is the smallest document id that links reach,
    the row's own included.

    Null, empty or blank text: no shingles, linked with nothing.  Null document
    id: its row keeps a null component unless linked rows have ids.  Repeated
    rows and equal texts: one class.  Empty table: no rows.  Other columns are
    not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_column(docs, text_col).alias("text"))
    counts = docs.sparkSession.sparkContext.broadcast(token_counts(docs, sketch_bits, width))
    rows = cut(shingle_sets(docs, counts, threshold, sketch_bits, width))
    known = rows.where("sid is not null")
    classes = cut(known.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("gid").alias("gid")))
    heads = cut(classes.groupBy("gid").agg(F.first("n").alias("n"), F.min(F.struct("sid", "sig")).alias("lead"), F.count("*").alias("members")))
    prefixes = cut(known.groupBy("gid").agg(F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix")))
    entries = prefixes.select("gid", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    again = cut(entries.groupBy("token").agg(F.count("*").alias("entries")).where("entries > 1"))
    total = again.agg(F.sum("entries")).first()[0] or 0
    release(docs.sparkSession)
    hot = cut(again.where(F.col("entries") > max(HOT_ENTRIES, total // HOT_TOKENS)).select("token"))
    entries = cut(_by_token(entries, again.select("token"), hot).select("token", "gid", "n", "pos"))
    release(docs.sparkSession)

    # stars: each group's leader with the pivots of its tokens, each member with its leader
    pivots = entries.groupBy("token").agg(F.min(F.struct("pos", "n", "gid")).alias("pivot"))
    near = _by_token(entries, pivots, hot).where("gid <> pivot.gid").where(_possible(F.col("pos"), F.col("n"), F.col("pivot.pos"), F.col("pivot.n"), threshold))
    near = _candidates(near.select(F.least("gid", "pivot.gid").alias("g"), F.greatest("gid", "pivot.gid").alias("h")), heads, threshold)
    own = classes.join(heads.where("members > 1").select("gid", F.col("lead.sid").alias("leader")), "gid").where("sid <> leader")
    stars = near.select(F.least("sidg", "sidh").alias("a"), F.greatest("sidg", "sidh").alias("b")).unionByName(own.select(F.least("sid", "leader").alias("a"), F.greatest("sid", "leader").alias("b")))
    links = _verify(stars, classes, docs, threshold, width)

    # the rest: what may still join two components
    first = cut(components(links))
    member = classes.select("gid", "sid").join(first.withColumnRenamed("node", "sid"), "sid", "left").select("gid", "sid", F.coalesce("component", "sid").alias("component"))
    member = cut(member)
    spread = member.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    entries = cut(entries.join(spread, "gid"))
    cells = entries.groupBy("token", "n", "pos").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    torn = cells.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("many")).where("low <> high").select("token", "many")
    cells = cut(cells.join(torn, "token"))
    release(docs.sparkSession)
    apart = ~((F.col("low1") == F.col("high1")) & (F.col("low2") == F.col("high2")) & (F.col("low1") == F.col("low2")))

    # pairs of cells of one token, all or those of sizes that the threshold lets link: a size's band and the one above
    x, y = (cells.select("token", "many", *(F.col(c).alias(f"{c}{k}") for c in ("n", "pos", "low", "high"))) for k in (1, 2))
    few = F.col("many") <= CELLS
    x = x.withColumn("band", F.when(few, UNBANDED).otherwise(_band(F.col("n1"), threshold))).drop("many")
    y = y.withColumn("band", F.explode(F.when(few, F.array(F.lit(UNBANDED))).otherwise(F.array(_band(F.col("n2"), threshold), _band(F.col("n2"), threshold) - 1)))).drop("many")
    cell_pairs = x.join(y, ["token", "band"]).where("n1 < n2 or n1 = n2 and pos1 <= pos2").where(apart)
    cell_pairs = cell_pairs.where(_possible(F.col("pos1"), F.col("n1"), F.col("pos2"), F.col("n2"), threshold)).select("token", "n1", "pos1", "n2", "pos2")
    e1, e2 = (entries.select("token", *(F.col(c).alias(f"{c}{k}") for c in ("n", "pos", "gid", "low", "high"))) for k in (1, 2))
    group_pairs = cell_pairs.join(e1, ["token", "n1", "pos1"]).join(e2, ["token", "n2", "pos2"]).where(apart).where("n1 <> n2 or pos1 <> pos2 or gid1 < gid2").select(F.least("gid1", "gid2").alias("g"), F.greatest("gid1", "gid2").alias("h"))
    m1, m2 = (member.select(*(F.col(c).alias(f"{c}{k}") for c in ("gid", "sid", "component"))) for k in (1, 2))
    split = spread.where("low <> high").select(F.col("gid").alias("g"), F.col("gid").alias("h"))  # pairs inside a group
    found = _candidates(group_pairs, heads, threshold).select("g", "h").unionByName(split)
    rest = found.join(m1, F.col("g") == F.col("gid1")).join(m2, F.col("h") == F.col("gid2")).where("component1 <> component2 and (g <> h or sid1 < sid2)")
    more = _verify(rest.select(F.least("sid1", "sid2").alias("a"), F.greatest("sid1", "sid2").alias("b")), classes, docs, threshold, width)
    bridges = more.join(member.select(F.col("sid").alias("a"), F.col("component").alias("ca")), "a").join(member.select(F.col("sid").alias("b"), F.col("component").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = components(bridges)
    member = member.join(merged.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left").select("sid", F.coalesce("root", "component").alias("root"))
    lowest = member.join(classes.select("sid", "doc_id"), "sid").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    final = member.join(lowest, "root").select("sid", "component_id")
    return rows.select("doc_id", "n_shingles", "sid").join(final, "sid", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
