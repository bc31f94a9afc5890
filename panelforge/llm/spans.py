"""Pre-tokens as byte spans, and a bounded table of their encodings (NumPy only).

Every text is cut by one set of array expressions over its UTF-8 bytes: each
character has one of four classes (letter, number, white space, other), runs of a
class are found, and the rules for spaces, contractions and special strings move
the marks.  The classes are those of the tokenizers library itself, asked once by
the driver (:func:`library_classes`).

The encodings of spans of up to 16 bytes are kept in an open-addressing table
whose keys are the bytes themselves (two words and the length), so a hit is
exact.  An entry has at most 16 ids and the table is emptied when it is full:
its size has a fixed bound.  Longer spans are encoded each time they occur.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import regex

OTHER, LETTER, NUMBER, WHITE = range(4)
_U = np.uint64
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)  # the first k bytes of a word
_SHORT = 16
_TOP = 0x110000


def library_classes() -> bytes:
    """Ranges of code points of one class, (first, class) pairs of 32-bit integers, as the library cuts text.

    Two tables of different Unicode versions are at hand; the library is asked
    about every character that they file differently.
    """
    from tokenizers import pre_tokenizers

    codes = np.array([c for c in range(_TOP) if not 0xD800 <= c < 0xE000])
    text, kind = "".join(map(chr, codes.tolist())), np.zeros(len(codes), dtype=np.uint8)
    for name, k in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
        for m in regex.finditer(name, text):
            kind[m.start() : m.end()] = k
    named = np.flatnonzero(kind % WHITE)
    unlike = named[[unicodedata.category(text[i])[0] != "OLN"[kind[i]] for i in named.tolist()]]
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for part in np.array_split(unlike, max(1, len(unlike) // 256)):
        probe = "".join(f"a{text[i]}1-{text[i]}-\n" for i in part.tolist())  # a run holds together where the class is the neighbour's
        begins = np.zeros(len(probe) + 1, dtype=bool)
        begins[[at for _, (at, _) in cut.pre_tokenize_str(probe)]] = True
        at = 7 * np.arange(len(part))
        kind[part] = np.where(~begins[at + 1], LETTER, np.where(~begins[at + 2], NUMBER, np.where(~begins[at + 4], OTHER, WHITE)))
    table = np.zeros(_TOP, dtype=np.uint8)
    table[codes] = kind
    return _ranges(table)


def unknown_characters() -> bytes:
    """Ranges like those of :func:`library_classes`: 1 where the interpreter's Unicode tables lack a character that newer ones have."""
    text, table = "".join(map(chr, (c for c in range(_TOP) if not 0xD800 <= c < 0xE000))), np.zeros(_TOP, dtype=np.uint8)
    for m in regex.finditer(r"[^\p{Cn}\p{Co}]+", text):
        table[[ord(c) for c in m[0] if unicodedata.category(c) == "Cn"]] = 1
    return _ranges(table)


def _ranges(table: np.ndarray) -> bytes:
    first = np.flatnonzero(np.diff(table, prepend=np.uint8(255)))
    return np.stack([first, table[first]], axis=1).astype("<i4").tobytes()


class Classes:
    """The class of every character of UTF-8 bytes."""

    def __init__(self, ranges: bytes):
        r = np.frombuffer(ranges, dtype="<i4").reshape(-1, 2)
        self.table = np.repeat(r[:, 1].astype(np.uint8), np.diff(np.append(r[:, 0], _TOP)))
        self.single = np.where(np.arange(256) < 128, self.table[:256], OTHER).astype(np.uint8)

    def of(self, buf: np.ndarray) -> np.ndarray:
        """Each byte's class, that of the character it belongs to."""
        kind = self.single[buf]
        lead = np.flatnonzero(buf >= 0xC0)
        if len(lead):
            wide = np.concatenate([buf, np.zeros(3, np.uint8)])
            b0, b1, b2, b3 = (wide[lead + k].astype(np.int32) for k in range(4))
            three, four = b0 >= 0xE0, b0 >= 0xF0
            code = np.where(four, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | (b3 & 63), np.where(three, (b0 & 15) << 12 | (b1 & 63) << 6 | (b2 & 63), (b0 & 31) << 6 | (b1 & 63)))
            k = self.table[np.minimum(code, _TOP - 1)]
            kind[lead] = k
            for back, has in ((1, slice(None)), (2, three), (3, four)):
                at = lead[has] + back
                ok = at < len(buf)
                kind[at[ok]] = k[has][ok]
        return kind


def _edges(kind: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where a run of one class begins; one more entry than bytes, the last true."""
    edge = np.zeros(len(kind) + 1, dtype=bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offs] = True
    return edge


def _contractions(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, inner: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of apostrophes that begin 's 't 're 've 'm 'll 'd, and where these end.

    The apostrophe is a run by itself; where white space is kept it must not follow
    the one space that it would take.
    """
    at = begin[(end - begin == 1) & (buf[begin] == 0x27)]
    if spaced and len(at):
        at = at[~((at > 0) & inner[at] & (buf[np.maximum(at - 1, 0)] == 0x20))]
    at = at[(at + 1 < len(buf)) & inner[np.minimum(at + 1, len(buf))]]
    if not len(at):
        return at, at
    one = buf[at + 1]
    short = (one == 0x73) | (one == 0x74) | (one == 0x6D) | (one == 0x64)
    more = (at + 2 < len(buf)) & inner[np.minimum(at + 2, len(buf))]
    two = buf[np.minimum(at + 2, len(buf) - 1)]
    long = more & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
    at, size = at[short | long], np.where(short, 2, 3)[short | long]
    return at, at + size


def spaced(buf: np.ndarray, offs: np.ndarray, classes: Classes, special: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens that keep white space: starts, ends, and the first of each document.

    A run takes the one space before it; of other white space the last character
    stands alone before what follows.  ``special``: (start, end) of special strings, spans of their own.
    """
    if len(buf) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    kind = classes.of(buf)
    parts = offs if special is None else np.concatenate([offs, special.reshape(-1)])
    edge = _edges(kind, parts)
    begin = np.flatnonzero(edge[:-1])
    end = np.append(begin[1:], len(buf))
    white = kind[begin] == WHITE
    inner = np.ones(len(buf) + 1, dtype=bool)
    inner[parts] = False  # true where a byte is not a part's first
    followed = white & (end < len(buf)) & inner[end]
    taken = followed & (buf[end - 1] == 0x20)
    mark = np.zeros(len(buf) + 1, dtype=bool)
    mark[begin] = True
    mark[end[taken]] = False
    last = end[followed] - 1  # the last white character goes with what follows, or stands alone
    for _ in range(2):
        last = last - ((buf[last] & 0xC0) == 0x80)
    mark[last] = True
    at, stop = _contractions(buf, begin, end, inner, True)
    mark[at + 1] = False
    mark[stop] = True
    if special is not None:
        for a, b in special.tolist():
            mark[a:b] = False
    mark[parts] = True
    mark[-1] = False
    starts = np.flatnonzero(mark)
    return starts, np.append(starts[1:], len(buf)), np.searchsorted(starts, offs)


def unspaced(buf: np.ndarray, offs: np.ndarray, classes: Classes, special: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens without white space, each number's character by itself: starts, ends, first of each document."""
    if len(buf) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    kind = classes.of(buf)
    parts = offs if special is None else np.concatenate([offs, special.reshape(-1)])
    edge = _edges(kind, parts)
    begin = np.flatnonzero(edge[:-1])
    end = np.append(begin[1:], len(buf))
    inner = np.ones(len(buf) + 1, dtype=bool)
    inner[parts] = False
    at, stop = _contractions(buf, begin, end, inner, False)
    edge[at + 1] = False
    edge[stop] = True
    edge[:-1] |= (kind == NUMBER) & ((buf & 0xC0) != 0x80)
    inside = kind != WHITE
    if special is not None:
        for a, b in special.tolist():
            edge[a + 1 : b] = False
            inside[a:b] = True
    begin = np.flatnonzero(edge[:-1])
    end = np.append(begin[1:], len(buf))
    keep = inside[begin]
    starts = begin[keep]
    return starts, end[keep], np.searchsorted(starts, offs)


def find_special(raw: bytes, offs: np.ndarray, pattern) -> np.ndarray | None:
    """(start, end) of the special strings that ``pattern`` matches inside one document, leftmost first; None without any."""
    out, at = [], 0
    while m := pattern.search(raw, at):
        k = int(np.searchsorted(offs, m.start(), side="right"))
        inside = m.end() <= offs[k]
        if inside:
            out.append((m.start(), m.end()))
        at = m.end() if inside else m.start() + 1
    return np.array(out, dtype=np.int64) if out else None


def pieces(buf: np.ndarray, classes: Classes, most: int, special: list[bytes] = ()) -> Iterator[tuple[int, int, int]]:
    """Cut one text where its pre-tokens (with white space) surely do not cross: (start, end of what is looked at, end).

    At most ``most`` bytes are looked at at a time, however long the text or a
    pre-token is; where the ends differ the last pre-token goes on to the second.
    """
    at, n = 0, len(buf)
    while at < n:
        stop = min(n, at + most)
        while stop < n and (buf[stop] & 0xC0) == 0x80:
            stop -= 1
        if stop == n:
            yield at, n, n
            return
        kind, part = classes.of(buf[at:stop]), buf[at:stop]
        edge = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[:-1] != WHITE) & (part[:-1] != 0x27)) + 1
        cut = max((part.tobytes().rfind(s) + len(s) for s in special if s in part.tobytes()), default=0)  # a special string's end is a cut too
        for p in edge[::-1].tolist():
            if p <= cut:
                break
            if not any(s in buf[max(at, at + p - len(s) + 1) : at + p + len(s) - 1].tobytes() for s in special):
                cut = p
                break
        if cut:
            yield at, at + cut, at + cut
            at += cut
            continue
        end = stop  # one run goes on
        while end < n:
            upto = min(n, end + most)
            while upto < n and (buf[upto] & 0xC0) == 0x80:
                upto -= 1
            other = np.flatnonzero(classes.of(buf[end:upto]) != kind[-1])
            if len(other):
                end += int(other[0])
                break
            end = upto
        if kind[-1] == WHITE and end < n:
            end -= 1
            while (buf[end] & 0xC0) == 0x80:
                end -= 1
        yield at, min(stop, end), end
        at = end


class SpanEncoder:
    """Ids of spans through a bounded table; subclasses say how new spans are encoded."""

    def __init__(self, most: int):
        self.bits = max(8, int(most).bit_length())  # at most half full
        self.most = most
        self.reset()

    def new_spans(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the spans one after another, and how many each has."""
        raise NotImplementedError

    def long_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def reset(self) -> None:
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.low, self.high = np.empty(1 << 14, dtype=np.uint64), np.empty(1 << 14, dtype=np.uint64)
        self.size = np.empty(1 << 14, dtype=np.uint8)
        self.start, self.length = np.empty(1 << 14, dtype=np.int32), np.empty(1 << 14, dtype=np.int32)
        self.pool = np.empty(1 << 16, dtype=np.uint32)
        self.n = self.used = 0

    def _store(self, ids: np.ndarray, lens: np.ndarray, keys: tuple[np.ndarray, np.ndarray, np.ndarray]) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while self.n + len(lens) > len(self.start):
            for name in ("low", "high", "size", "start", "length"):
                x = getattr(self, name)
                setattr(self, name, np.concatenate([x, np.empty_like(x)]))
        a, b = self.n, self.n + len(lens)
        self.pool[self.used : self.used + len(ids)] = ids
        self.low[a:b], self.high[a:b], self.size[a:b] = keys
        self.length[a:b] = lens
        self.start[a:b] = self.used + np.cumsum(lens) - lens
        self.used += len(ids)
        self.n = b
        return a

    @staticmethod
    def _keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first eight bytes, the last eight if there are more, and the length: all bytes of up to 16."""
        wide = np.concatenate([data, np.zeros(8, np.uint8)])
        view = np.ndarray((len(data) + 1,), dtype="<u8", buffer=wide.data, strides=(1,))
        n = ends - starts
        low = view[starts] & _KEEP[np.minimum(n, 8)]
        high = np.zeros(len(n), dtype=np.uint64)
        more = np.flatnonzero(n > 8)
        high[more] = view[ends[more] - 8]
        return low, high, n.astype(np.uint8)

    def _first(self, keys) -> np.ndarray:
        low, high, n = keys
        with np.errstate(over="ignore"):
            h = (low ^ (high * _U(0x9E3779B97F4A7C15)) ^ n.astype(np.uint64)) * _U(0xD6E8FEB86659FD93)
            h = (h ^ (h >> _U(32))) * _U(0xE7037ED1A0B428DB)
        return (h >> _U(64 - self.bits)).astype(np.int64)

    def _same(self, entry: np.ndarray, keys, k) -> np.ndarray:
        return (self.low[entry] == keys[0][k]) & (self.high[entry] == keys[1][k]) & (self.size[entry] == keys[2][k])

    def _find(self, keys) -> np.ndarray:
        """Entries of the keys; -1 where there is none."""
        mask, at = (1 << self.bits) - 1, self._first(keys)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & ~self._same(np.maximum(out, 0), keys, slice(None)))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            entry = self.slots[at[todo]]
            out[todo] = entry
            todo = todo[(entry >= 0) & ~self._same(np.maximum(entry, 0), keys, todo)]
        return out

    def _insert(self, keys, first: int) -> None:
        mask, at = (1 << self.bits) - 1, self._first(keys)
        todo = np.arange(len(at))
        while len(todo):
            free = self.slots[at[todo]] < 0
            slot, pick = np.unique(at[todo][free], return_index=True)
            won = todo[free][pick]
            self.slots[slot] = first + won
            rest = np.ones(len(at), dtype=bool)
            rest[won] = False
            todo = todo[rest[todo]]
            at[todo] = (at[todo] + 1) & mask

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entries of spans of at most 16 bytes, new ones encoded first; earlier entries may no longer hold."""
        keys = self._keys(data, starts, ends)
        found = self._find(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            order = missing[np.lexsort([k[missing] for k in keys])]
            new = np.ones(len(order), dtype=bool)
            new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
            pick = order[new]
            if self.n + len(pick) > self.most:
                if self.n:
                    self.reset()
                    return self.lookup(data, starts, ends)
                raise ValueError("a slice has more distinct spans than the table may hold")
            raw = data.tobytes()
            ids, lens = self.new_spans([raw[a:b] for a, b in zip(starts[pick].tolist(), ends[pick].tolist())])
            self._insert(tuple(k[pick] for k in keys), self._store(ids, lens, tuple(k[pick] for k in keys)))
            found[missing] = self._find(tuple(k[missing] for k in keys))
        return found

    def span_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans one after another, and how many each has."""
        short = ends - starts <= _SHORT
        whole = bool(short.all())
        s = slice(None) if whole else np.flatnonzero(short)
        found = self.lookup(data, starts[s], ends[s])
        if whole:
            lens, begin = self.length[found].astype(np.int64), self.start[found]
            to = np.cumsum(lens)
            return self.pool[np.repeat(begin - (to - lens), lens) + np.arange(int(to[-1]) if len(to) else 0)], lens
        lens = np.empty(len(starts), dtype=np.int64)
        lens[s] = self.length[found]
        rest = np.flatnonzero(~short)
        extra, lens[rest] = self.long_spans(data, starts[rest], ends[rest])
        to = np.cumsum(lens)
        out = np.empty(int(to[-1]), dtype=np.uint32)
        begin = to - lens
        for which, source, at in ((s, self.pool, self.start[found]), (rest, extra, np.cumsum(lens[rest]) - lens[rest])):
            k = lens[which]
            step = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            out[np.repeat(begin[which], k) + step] = source[np.repeat(at, k) + step]
        return out, lens

    def span_counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each span."""
        short = ends - starts <= _SHORT
        out = np.empty(len(starts), dtype=np.int64)
        found = self.lookup(data, starts[short], ends[short])  # before the arrays are read: it may make them longer
        out[short] = self.length[found]
        if not short.all():
            out[~short] = self.long_spans(data, starts[~short], ends[~short])[1]
        return out

    def counts_of(self, strings: list[bytes]) -> np.ndarray:
        """Tokens of each string, every one a span by itself."""
        if not strings:
            return np.empty(0, np.int64)
        ends = np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))
        return self.span_counts(np.frombuffer(b"".join(strings), dtype=np.uint8), np.concatenate([[0], ends[:-1]]), ends)


def valid(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same bytes, or with replacement characters where they are no UTF-8."""
    raw = buf.tobytes()
    try:
        raw.decode()
        return buf, offs
    except UnicodeDecodeError:
        fixed = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        return np.frombuffer(b"".join(fixed), dtype=np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, fixed), np.int64, len(fixed)))])


__all__ = ["Classes", "SpanEncoder", "find_special", "library_classes", "pieces", "spaced", "unknown_characters", "unspaced", "valid"]
