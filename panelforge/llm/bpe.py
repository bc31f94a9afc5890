"""A streaming byte-pair transducer and its inverse (NumPy only, no Spark).

Encoding.  Merges are applied by rank, leftmost first, inside a pre-token.  A
token at the front of a pre-token is *stable* once no further input can change
it.  ``sufficient_lookahead`` derives from the merge list alone how many bytes
after a token decide it; a window of a token and that many bytes is therefore
enough, and no more than WINDOW bytes of a pre-token are worked on at a time
however long it is.

The bound.  A token's right boundary can only fall to a rule (u, x) where u is
on the token's right edge.  Whether x stands there at that rank depends on rules
of *smaller* rank that cross x's own right boundary, so influence travels right
over a chain of rules of strictly falling rank, each adding the length of its
right part.  The longest such chain is found in one pass over the merges.

Throughput.  ``Merges.transduce`` drives many pre-tokens, each a stream, at a time:
a round shows every stream its next window, ``encode_symbols`` applies the merges to
all windows, and each stream emits its stable tokens and moves on.  In
``encode_symbols`` column c of row-major state holds the c-th symbol of every
window, and one step applies the lowest-ranked pair of each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import regex

from panelforge.llm import spans, textbytes
from panelforge.llm.spans import SpanEncoder

_NONE = np.int32(2**31 - 1)
#: Bytes of a pre-token that are looked at at a time; a power of two, and rank * WINDOW fits in 31 bits.
WINDOW = 2048
_BITS = np.int32(WINDOW.bit_length() - 1)
#: Fewer strings than this are merged one by one.
_FEW = 24
#: Bytes of windows that one round works on.
_ROUND = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class Merges:
    """Vocabulary and merges of a byte-level tokenizer file, as arrays."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        symbols = byte_symbols()
        self.byte_id = np.array([vocab[s] for s in symbols], dtype=np.int32)
        self.last_id = np.array([vocab[s + self.suffix] for s in symbols], dtype=np.int32)
        back = {s: b for b, s in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        names = vocab | self.special
        self.size = max(names.values()) + 1
        self.token_bytes: list[bytes] = [b""] * self.size
        for s, i in names.items():
            s = s.removesuffix(self.suffix) if self.suffix else s
            self.token_bytes[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        self.left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.token_size = np.fromiter(map(len, self.token_bytes), np.int64, self.size)
        self._index()

    def _index(self) -> None:
        """An open-addressing table from a pair to its rank."""
        bits = max(10, int(len(self.left) * 6).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, _NONE, dtype=np.int32)
        key = self.left * self.size + self.right
        at = self._slot(key)
        todo = np.arange(len(key))
        while len(todo):
            free = self.keys[at[todo]] == -1
            slot, first = np.unique(at[todo][free], return_index=True)
            won = todo[free][first]  # the earliest rank of those that want a slot
            self.keys[slot], self.ranks[slot] = key[won], won
            todo = np.setdiff1d(todo, won, assume_unique=True)
            todo = todo[self.keys[at[todo]] != key[todo]]  # a repeated rule keeps its first rank
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; _NONE where no rule joins them."""
        key = a.astype(np.int64) * self.size + b
        at = self._slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.ranks[at], _NONE)
        todo = np.flatnonzero((held != key) & (held != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            held = self.keys[at[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        return out

    def sufficient_lookahead(self) -> int:
        """Bytes after a token that are enough to decide it, from the merge list alone."""
        best = [0] * self.size  # the longest chain that begins with a rule whose left part is this token
        edge: list[tuple[int, ...]] = [(i,) for i in range(self.size)]  # a token's right edge, itself included
        length = [len(b) for b in self.token_bytes]
        for u, x, m in zip(self.left.tolist(), self.right.tolist(), self.merged.tolist()):
            reach = length[x] + max(best[y] for y in edge[x])
            if reach > best[u]:
                best[u] = reach
            if len(edge[m]) == 1:
                edge[m] = (m, *edge[x])
        return max(best)

    def encode_symbols(self, data: np.ndarray, offs: np.ndarray, closed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the byte strings ``data[offs[k]:offs[k + 1]]`` (1 to WINDOW bytes each), and where each begins.

        ``closed``: which strings end a word (they take the end-of-word symbol); all, if not given.
        """
        n = np.diff(offs)
        order = np.argsort(n, kind="stable")
        counts = np.zeros(len(n), dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(order):
            wide = int(n[order[at]])
            top = max(wide + 1, wide + wide // 4)
            end = min(int(np.searchsorted(n[order], top, side="right")), at + max(256, 400_000 // top))
            rows = order[at:end]
            at = end
            if len(rows) < _FEW and wide > 64:  # too few for array steps to pay
                ids = [self._one(data[offs[k] : offs[k + 1]], closed is None or bool(closed[k])) for k in rows.tolist()]
                counts[rows] = [len(i) for i in ids]
                done.append((rows, np.concatenate(ids)))
                continue
            done.append((rows, self._run(data, offs[rows], n[rows], None if closed is None else closed[rows], counts, rows)))
        begin = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(begin[-1], dtype=np.int32)
        for rows, ids in done:
            k = counts[rows]
            out[np.repeat(begin[rows] - (np.cumsum(k) - k), k) + np.arange(len(ids))] = ids
        return out, begin

    @cached_property
    def _rank_of(self) -> dict[int, int]:
        key = (self.left * self.size + self.right).tolist()
        return {k: r for r, k in zip(range(len(key) - 1, -1, -1), reversed(key))}  # a repeated rule keeps its first rank

    def _one(self, data: np.ndarray, closed: bool) -> np.ndarray:
        """The same merges for one string: a heap of (rank, place) over a linked list."""
        sym = self.byte_id[data].tolist()
        if self.suffix and closed:
            sym[-1] = int(self.last_id[data[-1]])
        n, size, rank = len(sym), self.size, self._rank_of
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(sym[i] * size + sym[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = nxt[i]
            if sym[i] < 0 or j >= n or rank.get(sym[i] * size + sym[j]) != r:
                continue  # one of the two is gone
            sym[i], sym[j] = int(self.merged[r]), -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (r := rank.get(sym[i] * size + sym[k])) is not None:
                    heappush(heap, (r, i))
            if (k := prv[i]) >= 0 and (r := rank.get(sym[k] * size + sym[i])) is not None:
                heappush(heap, (r, k))
        return np.array([s for s in sym if s >= 0], dtype=np.int32)

    def _run(self, data, first, n, closed, counts, rows) -> np.ndarray:
        wide, m = int(n.max()), len(n)
        cols = np.arange(wide, dtype=np.int64)[:, None]
        real = cols < n[None, :]
        sym = np.full((wide + 1, m), -1, dtype=np.int32)
        sym[:-1][real] = self.byte_id[data[(first[None, :] + cols)[real]]]
        if self.suffix:
            close = np.arange(m) if closed is None else np.flatnonzero(closed)
            sym[n[close] - 1, close] = self.last_id[data[first[close] + n[close] - 1]]
        key = np.full((wide + 1, m), _NONE, dtype=np.int32)
        pair = real.copy()
        pair[:-1] &= real[1:]
        pair[-1] = False
        pc, pr = np.nonzero(pair)
        r = self.rank(sym[pc, pr], sym[pc + 1, pr])
        key[pc, pr] = np.where(r == _NONE, _NONE, r * WINDOW + pc.astype(np.int32))
        nxt = np.repeat(np.arange(1, wide + 2, dtype=np.int32)[:, None], m, axis=1)
        prv = np.repeat(np.arange(-1, wide, dtype=np.int32)[:, None], m, axis=1)
        live = np.arange(m)
        sf, kf, nf, pf = sym.reshape(-1), key.reshape(-1), nxt.reshape(-1), prv.reshape(-1)
        low = key.min(axis=0)
        live = np.flatnonzero(low != _NONE)
        low = low[live]
        while len(live):
            c = (low & np.int32(WINDOW - 1)).astype(np.int64)
            here = c * m + live
            q = nf[here].astype(np.int64)
            gone = q * m + live
            new = self.merged[low >> _BITS]
            sf[here] = new
            sf[gone] = -1
            kf[gone] = _NONE
            after = nf[gone].astype(np.int64)
            nf[here] = after
            has = after < n[live]
            k = np.full(len(live), _NONE, dtype=np.int32)
            a = np.flatnonzero(has)
            if len(a):
                nb = after[a] * m + live[a]
                pf[nb] = c[a]
                r = self.rank(new[a], sf[nb])
                k[a] = np.where(r == _NONE, _NONE, r * WINDOW + c[a].astype(np.int32))
            kf[here] = k
            before = pf[here].astype(np.int64)
            a = np.flatnonzero(before >= 0)
            if len(a):
                pb = before[a] * m + live[a]
                r = self.rank(sf[pb], new[a])
                kf[pb] = np.where(r == _NONE, _NONE, r * WINDOW + before[a].astype(np.int32))
            low = key[:, live].min(axis=0) if len(live) < m else key.min(axis=0)
            keep = low != _NONE
            live, low = live[keep], low[keep]
        t = sym[:-1].T
        alive = t >= 0
        counts[rows] = alive.sum(axis=1)
        return t[alive]


    def transduce(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lookahead: int, final: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stable tokens of the streams ``data[starts[k]:ends[k]]``: ids, how many each has, and bytes used of each.

        With ``final`` the streams end there and all their tokens are stable.
        """
        at, counts = starts.astype(np.int64), np.zeros(len(starts), dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # streams, tokens of each in this round, ids
        live = np.flatnonzero(ends > at)
        while len(live):
            going: list[np.ndarray] = []
            size = np.minimum(ends[live] - at[live], WINDOW)
            cuts = np.searchsorted(np.cumsum(size), np.arange(_ROUND, int(size.sum()) + _ROUND, _ROUND), side="right")
            for lo, hi in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
                s, n = live[lo:hi], size[lo:hi]
                if not len(s):
                    continue
                to = np.cumsum(n)
                window = data[np.repeat(at[s] - (to - n), n) + np.arange(to[-1])]
                closed = (at[s] + n == ends[s]) & final
                ids, begin = self.encode_symbols(window, np.concatenate([[0], to]), closed)
                k = np.diff(begin)
                upto = np.cumsum(self.token_size[ids])
                upto -= np.repeat(to - n, k)  # bytes of the window that each token reaches
                stable = np.repeat(closed, k) | (upto + lookahead <= np.repeat(n, k))
                k = np.add.reduceat(stable, begin[:-1], dtype=np.int64)  # stable tokens come first
                used = np.where(k > 0, upto[np.maximum(begin[:-1] + k - 1, 0)], 0)
                counts[s] += k
                at[s] += used
                done.append((s, k, ids[stable]))
                going.append(s[(at[s] < ends[s]) & (used > 0)])
            live = np.concatenate(going)
        first = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), dtype=np.uint32)
        for s, k, ids in done:
            out[np.repeat(first[s] - (np.cumsum(k) - k), k) + np.arange(len(ids))] = ids
            first[s] += k
        return out, counts, at - starts


class StreamingEncoder:
    """Feeds bytes of ONE pre-token and emits stable tokens; less than WINDOW bytes are held between calls."""

    def __init__(self, merges: Merges, lookahead: int):
        if lookahead + max(map(len, merges.token_bytes)) > WINDOW:
            raise ValueError(f"this merge list needs {lookahead} bytes of lookahead; the window holds {WINDOW}")
        self.merges, self.lookahead, self.held = merges, lookahead, b""

    def _emit(self, final: bool) -> list[int]:
        data = np.frombuffer(self.held, dtype=np.uint8)
        ids, _, used = self.merges.transduce(data, np.array([0]), np.array([len(data)]), self.lookahead, final)
        self.held = self.held[int(used[0]) :]
        return ids.tolist()

    def feed(self, data: bytes) -> Iterator[int]:
        for k in range(0, len(data), WINDOW):
            self.held += data[k : k + WINDOW]
            if len(self.held) >= WINDOW:
                yield from self._emit(False)

    def finish(self) -> Iterator[int]:
        yield from self._emit(True)


class StreamingDecoder:
    """Token ids to text; between calls only the bytes of an unfinished character (three at most) are held."""

    def __init__(self, merges: Merges):
        self.held = b""
        self.lens = np.fromiter(map(len, merges.token_bytes), np.int64, merges.size)
        self.start = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(merges.token_bytes), dtype=np.uint8)

    def _bytes(self, ids) -> bytes:
        ids = np.asarray(ids, dtype=np.int64)
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        where = np.repeat(self.start[ids] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[where].tobytes()

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that is not complete."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return back if back < need else 0
        return 0

    def feed(self, ids) -> str:
        data = self.held + self._bytes(ids)
        cut = len(data) - self._unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


class TextEncoder(SpanEncoder):
    """Ids of whole texts by the transducer; memory has a fixed bound but for a slice's own ids."""

    #: Bytes of text that are looked at at a time.
    SLICE = textbytes.SLICE

    def __init__(self, merges: Merges, classes: bytes | None = None, most: int = 1 << 19):
        super().__init__(most)
        self.merges, self.classes = merges, spans.Classes(classes or spans.library_classes())
        self.lookahead = merges.sufficient_lookahead()
        if self.lookahead + int(merges.token_size.max()) > WINDOW:
            raise ValueError(f"this merge list needs {self.lookahead} bytes of lookahead; the window holds {WINDOW}")
        self.special = [s.encode() for s in sorted(merges.special, key=len, reverse=True)]
        self.pattern = re.compile(b"|".join(map(re.escape, self.special)))
        self.special_ids = {s.encode(): i for s, i in merges.special.items()}
        for s in self.special:
            if len(np.unique(self.classes.of(np.frombuffer(s, dtype=np.uint8)))) < 2:
                raise ValueError(f"the special string {s!r} would also be a pre-token")

    def specials(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray | None:
        raw = buf.tobytes()
        return spans.find_special(raw, offs, self.pattern) if any(s in raw for s in self.special) else None

    def new_spans(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lens)
        ids, counts, _ = self.merges.transduce(np.frombuffer(b"".join(raw), dtype=np.uint8), ends - lens, ends, self.lookahead)
        named = [k for k, r in enumerate(raw) if r in self.special_ids]
        if named:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in named:
                parts[k], counts[k] = np.array([self.special_ids[raw[k]]], dtype=np.uint32), 1
            ids = np.concatenate(parts)
        return ids, counts

    def long_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans beyond the table, each a stream that is never copied."""
        named = {}
        if self.special:
            sizes = {len(s) for s in self.special}
            for k in np.flatnonzero(np.isin(ends - starts, list(sizes))).tolist():
                if (i := self.special_ids.get(data[starts[k] : ends[k]].tobytes())) is not None:
                    named[k] = i
        ids, counts, _ = self.merges.transduce(data, starts, ends, self.lookahead)
        if named:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k, i in named.items():
                parts[k], counts[k] = np.array([i], dtype=np.uint32), 1
            ids = np.concatenate(parts)
        return ids, counts

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after another, where each document's begin)."""
        buf, offs = spans.valid(buf, offs)
        starts, ends, first = spans.spaced(buf, offs, self.classes, self.specials(buf, offs))
        ids, lens = self.span_ids(buf, starts, ends)
        return ids, np.concatenate([[0], np.cumsum(lens)])[first]

    def stream(self, buf: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of one text in blocks, each as soon as it is stable; what is held does not grow with the text."""
        for at, looked, end in spans.pieces(buf, self.classes, self.SLICE, self.special):
            own = buf[at:looked]
            offs = np.array([0, looked - at])
            starts, ends, _ = spans.spaced(own, offs, self.classes, self.specials(own, offs))
            if end > looked:  # the last pre-token goes on: its windows are read from the text itself
                ids, _ = self.span_ids(own, starts[:-1], ends[:-1])
                yield ids
                yield self.long_spans(buf, starts[-1:] + at, np.array([end]))[0]
            else:
                yield self.span_ids(own, starts, ends)[0]

    @cached_property
    def pretoken_pattern(self):
        """The same cutting as a regular expression, for the surroundings of an edit."""
        return regex.compile(_pretokens(self.classes))


def _pretokens(classes: spans.Classes) -> str:
    """Character sets are those of the regex module less and plus the code points that ``classes`` files elsewhere."""
    codes = [c for c in range(len(classes.table)) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, codes))
    own = classes.table[codes]

    def written(at: np.ndarray) -> str:
        runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []
        return "".join(f"\\U{codes[r[0]]:08x}-\\U{codes[r[-1]]:08x}" for r in runs)

    sets = {}
    for name, kind in ((r"\p{L}", spans.LETTER), (r"\p{N}", spans.NUMBER)):
        theirs = np.zeros(len(codes), dtype=bool)
        for m in regex.finditer(f"{name}+", text):
            theirs[m.start() : m.end()] = True
        less, more = written(np.flatnonzero(theirs & (own != kind))), written(np.flatnonzero(~theirs & (own == kind)))
        base = f"[{name}--[{less}]]" if less else name
        sets[kind] = f"[{base}||[{more}]]" if more else f"[{base}]"
    white = f"[{written(np.flatnonzero(own == spans.WHITE))}]"
    letter, number = sets[spans.LETTER], sets[spans.NUMBER]
    other = f"[^{white}{letter}{number}]"
    return rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|{white}+(?![^{white}])|{white}+"
