"""Texts cut off before their end, by prefix self-joins over the whole corpus.

A cut text is a strict prefix of a longer one: of a longer copy of itself, or,
where its own original is gone, its closing segment (what follows the last end
of a sentence or line) is a strict prefix of longer segments of other texts.
Values of three sizes are joined by prefix with all longer ones:

* Whole texts: all distinct texts are sorted (range-partitioned, so hot openings
  spread), and the texts that the current one goes on from are kept on a stack.
  Only texts whose extensions run over a partition's edge are joined with them.
* Segments: every prefix of every segment of the corpus has a hash (a polynomial
  of its tokens, the last one possibly a fragment of a word), and the closing
  segments are looked up among them: how often segments go on from there (in
  the word, or after it), and how often one ends there.
* Runs: where hardly any segment starts like the closing one, its last one to
  four tokens are looked up in the same way among all runs of the corpus.

Each text is tokenised once; packs of token numbers are written to the shared
folder, and what follows is array arithmetic on them. Counted are only keys that
some ending has: a bit filter of 16 bits per distinct key is sent to the
counters, in as many rounds as its largest size (FILTER_BITS) asks for.

Marks of cutting are learned, not known: a tail is a mark if it recurs in
MARK_MIN texts and one of MARK_RATE, after tokens of many kinds, hardly ever
elsewhere than at the end of a text, and mostly after runs that go on. What
stands before a mark is judged like an end.

``reason`` is the first way that holds: ``copy`` (a longer copy goes on inside
the word or sentence), ``segment``, ``run`` (see above), ``mark``,
``open_block`` (inside an open code block, where a line's end is none, the
run never ends a text) and ``limit`` (a length at which the source has far more
texts than around it, and an ending that is likelier as a cut than as an end).

Repeated texts are judged once and support no one but others; a run counts as often as it occurs. Nulls, empty and
blank texts are no cases. Sources compare ignoring case and spaces around them;
a null source has no limit. Texts are read whole whatever their length. A text
of under MIN_TOKENS tokens is too short for the evidence of others that merely
begin alike: only a fragment of a word makes it a case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, norm_source
from ..runtime import materialize

RUN = 4  # tokens of the longest run
SEGMENT = RUN + 1  # the level of closing segments
EVIDENCE = 4  # other runs or segments that a level needs
MIN_TOKENS = 4
FLUSH = 1 << 18  # tokens of a pack, and counts held back
WIDTH = 1 << 16  # tokens worked on at a time
TAIL = 16  # tokens of the longest mark
MARK_MIN, MARK_RATE, END_SHARE = 3, 10_000, 0.8
RARE, LIKELY = 0.03, 0.2  # shares of ends
LIMIT_MIN, LIMIT_TIMES, LIMIT_LONGER, NEAR = 6, 5, 0.35, 25  # texts of a length limit, against those up to NEAR characters from it, and longer ones
NATURAL = 0.005  # share of a mark's first tokens in what follows a token
FILTER_BITS = 1 << 28  # 32 MB

#: Written without spaces: each character is a token, and none is part of a word or hash.
CJK = "々-〇぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ𠀀-𳑿"
TOKEN = re.compile(rf"```|(?<![^\W_{CJK}])(?=[0-9a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{{3,}}(?![^\W_{CJK}])|[{CJK}]|[^\W\d_{CJK}]+|\d+|\s*\n\s*|[^\S\n]+|.", re.S)
CJK_STOPS = frozenset("。？！")
STOPS = frozenset(".?!…") | CJK_STOPS
END, BEGIN = "\x03", "\x02"


def _class(x: str) -> str:
    if len(x) >= 3 and x.isalnum() and not x.isalpha() and not x.isdigit():
        return "#"  # a hash
    if x.isdigit():
        return "0"
    if "\n" in x:
        return "\n"
    if x.isalpha():
        return x.lower()
    return " " if x.isspace() else x


def tokens(text: str) -> list[str]:
    return [_class(x) for x in TOKEN.findall(text)]


def stops(last: str, n1: str, n2: str) -> bool:
    """A sentence, line or text ends between last and n1 (n2 follows n1)."""
    if n1 in (END, "\n") or last in CJK_STOPS:
        return True
    if last in STOPS:
        return n1 == " "
    return n1 in CJK_STOPS or (n1 in STOPS and n2 in (END, " ", "\n"))


def ending(text: str) -> list[str]:
    """The text's tokens after BEGIN, without white space at its end."""
    kept = text.rstrip()
    toks = [BEGIN, *tokens(kept)]
    # One space after a word that ends nothing belongs to the ending: the next word was to come.
    if text == kept + " " and toks[-1] not in STOPS:
        toks.append(" ")
    return toks


# A run's hash is a polynomial of its tokens' hashes, mixed with its level.
# Constants are odd numbers, the last two those of a public mixer.
_WORD = (1 << 64) - 1
_BASE, _LENGTH, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
_INVERSE = pow(_BASE, -1, 1 << 64)


def _token_hash(token: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "replace"))


def _mixed(g: np.ndarray, level: int) -> np.ndarray:
    """Keys of runs from their polynomials."""
    h = g + np.uint64(level * _LENGTH & _WORD)
    for m in (_MIX1, _MIX2):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
    return h ^ (h >> np.uint64(33))

PACK_DDL = "kind string, tkeys array<binary>, chars array<int>, sizes array<int>, voc array<string>, ids binary, tail bigint, head bigint, prev bigint, n bigint"
_PACK_NAMES = [f.split(" ")[0] for f in PACK_DDL.split(", ")]
_PACK_TYPES = [pa.string(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.binary(), *[pa.int64()] * 4]


class Vocabulary:
    """Numbers of a task's distinct tokens."""

    def __init__(self) -> None:
        self.raw: dict[str, int] = {}
        self.ids: dict[str, int] = {}
        self.tokens: list[str] = []
        self.begin, self.space = self.of(BEGIN), self.of(" ")

    def of(self, token: str) -> int:
        i = self.ids.get(token)
        if i is None:
            i = self.ids[token] = len(self.tokens)
            self.tokens.append(token)
        return i

    def encode(self, text: str) -> np.ndarray:
        """The numbers of ending()."""
        kept, raw = text.rstrip(), self.raw
        found = TOKEN.findall(kept)
        for x in set(found).difference(raw):
            raw[x] = self.of(_class(x))
        out = [self.begin, *map(raw.__getitem__, found)]
        if text == kept + " " and self.tokens[out[-1]] not in STOPS:
            out.append(self.space)
        return np.array(out, dtype=np.int32)


@dataclass
class Tails:
    """Tails that recur: sorted keys, how many texts end with each, and whether it is hardly ever elsewhere."""

    keys: np.ndarray
    often: np.ndarray
    last: np.ndarray


class Pack:
    """Some texts as one array of token numbers (each text after a BEGIN), with what is looked up of it."""

    STOP, CJK_STOP, SPACE, LINE, FENCE, WORD, ALPHA, BEGIN = 1, 2, 4, 8, 16, 32, 64, 128

    def __init__(self, voc: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.voc, self.ids = voc, ids
        self.hashes = np.array([_token_hash(t) for t in voc], dtype=np.uint64)
        self.kinds = np.array([self._kind(t) for t in voc], dtype=np.uint8)
        self.sizes = sizes.astype(np.int64)
        self.ends = np.cumsum(self.sizes) - 1  # place of each text's last token
        self.pos = np.arange(len(ids)) - np.repeat(self.ends - self.sizes + 1, self.sizes)

    @classmethod
    def _kind(cls, t: str) -> int:
        return (
            (t in STOPS) * cls.STOP | (t in CJK_STOPS) * cls.CJK_STOP | (t == " ") * cls.SPACE | (t == "\n") * cls.LINE | (t == "```") * cls.FENCE
            | (t[:1].isalnum() or t == "#") * cls.WORD | t.isalpha() * cls.ALPHA | (t == BEGIN) * cls.BEGIN
        )

    def tails(self) -> tuple[np.ndarray, ...]:
        """(text, length, tail, head, prev): the tails that may be marks, keys of the whole one and of its first run, the hash of the token before it.

        A tail leaves a token of its text before it and starts with a space, a line feed or a symbol, but is neither the
        end of a sentence only nor one word: runs tell what that is.
        """
        h, kind, rows = self.hashes, self.kinds, []
        g, power = np.zeros(len(self.ends), np.uint64), np.uint64(1)
        stop = np.array([t in STOPS and t != "…" for t in self.voc])
        every = np.arange(len(self.ends))
        for k in range(1, TAIL + 1):
            every = every[self.sizes[every] > k + 1]
            at = self.ends[every] - k + 1
            first = self.ids[at]
            with np.errstate(over="ignore"):
                g[every] += h[first] * power
                power *= np.uint64(_BASE)
            use = kind[first] & self.WORD == 0
            if k == 1:
                use &= ~stop[first]
            if k == 2:
                use &= kind[self.ids[at + 1]] & self.ALPHA == 0
            sel, at = every[use], at[use]
            head = np.zeros(len(sel), np.uint64)
            for j in range(min(k, RUN)):
                head = head * np.uint64(_BASE) + h[self.ids[at + j]]
            rows.append((sel, np.full(len(sel), k), _mixed(g[sel], 100 + k), _mixed(head, min(k, RUN)), h[self.ids[at - 1]]))
        return tuple(np.concatenate(c) for c in zip(*rows))

    def ends_before(self, tails: Tails) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, length, tail) of the given tails that texts have, without those that are another one, twice as frequent, after some word."""
        text, k, tail, _, _ = self.tails()
        has = np.flatnonzero(np.isin(tail, tails.keys))
        i = np.searchsorted(tails.keys, tail[has])
        words = np.cumsum(self.kinds[self.ids] & self.WORD != 0)
        shorter: dict[int, list[tuple[int, int]]] = {}
        kept = []
        for j, t, n, last in zip(has.tolist(), text[has].tolist(), tails.often[i].tolist(), tails.last[i].tolist()):  # shorter ones come first
            at = self.ends[t] - k[j]
            inner = shorter.setdefault(t, [])
            if last and not any(m >= 2 * n and words[end] > words[at] for end, m in inner):
                kept.append(j)
            inner.append((at, n))
        return text[kept], k[kept], tail[kept]

    def stretches(self, width: int) -> Iterator["Stretch"]:
        poly, closed = np.uint64(0), True
        for a in range(0, len(self.ids), width):
            s = Stretch(self, a, min(len(self.ids), a + width), poly, closed)
            yield s
            poly, closed = s.poly, s.closed


class Stretch:
    """Tokens a to b of a pack: where sentences, lines and texts end, and the polynomials of the runs and segments up to each token."""

    def __init__(self, pack: Pack, a: int, b: int, poly: np.uint64, closed: bool) -> None:
        """poly: of the segment that a may go on with; closed: whether none is open."""
        self.pack, self.a, self.b, self._poly, self._closed = pack, a, b, poly, closed
        self.ids, self.pos = pack.ids[a:b], pack.pos[a:b]
        kind = np.append(pack.kinds[pack.ids[a : b + 2]], np.full(2, Pack.BEGIN, np.uint8))
        self.kind, n1, n2 = kind[: b - a], kind[1 : b - a + 1], kind[2 : b - a + 2]
        is_ = lambda k, what: (k & what) != 0
        self.last = is_(n1, Pack.BEGIN)  # of its text
        before_stop = is_(n1, Pack.CJK_STOP) | is_(n1, Pack.STOP) & is_(n2, Pack.BEGIN | Pack.SPACE | Pack.LINE)
        self.stops = self.last | is_(n1, Pack.LINE) | is_(self.kind, Pack.CJK_STOP) | np.where(is_(self.kind, Pack.STOP), is_(n1, Pack.SPACE), before_stop)
        self.own = ~is_(self.kind, Pack.BEGIN)

    def runs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(level, polynomials, those of all tokens but the last, whether there is such a run) for runs of each length, then for segments."""
        lo = max(0, self.a - RUN + 1)
        h = self.pack.hashes[self.pack.ids[lo : self.b]]
        g, skip = np.zeros(len(h), np.uint64), self.a - lo
        for n in range(1, RUN + 1):
            before = np.concatenate([np.zeros(1, np.uint64), g[:-1]]) if n > 1 else g
            g = before * np.uint64(_BASE) + h
            yield n, g[skip:], before[skip:], self.own & (self.pos >= n - 1)
        yield SEGMENT, *self._segments(h[skip:])

    def _segments(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = self.b - self.a
        word = (self.kind & (Pack.SPACE | Pack.LINE | Pack.STOP | Pack.BEGIN)) == 0
        ended = np.concatenate([[0], np.cumsum(self.stops)])  # before each token
        at = np.flatnonzero(word)
        opens = np.zeros(m, bool)
        if len(at):
            opens[at] = np.diff(ended[at], prepend=-1 if self._closed else 0) > 0
        places = np.arange(m)
        start = np.maximum.accumulate(np.where(opens, places, -1))
        # Sum of h[j] B^(i-j) over the segment, as a difference of running sums of h[j] B^-j.
        up, down = np.full(m, _BASE, np.uint64), np.full(m, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        q = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down)])
        g = (q[1:] - q[np.maximum(start, 0)]) * up
        going = start < 0
        g[going] += self._poly * up[going] * np.uint64(_BASE)
        before = np.concatenate([np.full(1, self._poly), g[:-1]])
        before[opens] = 0
        open_at = ended[:-1] == ended[np.maximum(start, 0)]
        if self._closed:
            open_at &= start >= 0
        last_word = at[-1] if len(at) else -1
        self.closed = bool(self.stops[max(last_word, 0) :].any()) or (last_word < 0 and self._closed)
        self.poly = g[-1]
        return g, before, open_at & self.own


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to packs, and the tails of each pack's texts with their counts."""
    voc = Vocabulary()
    keys, chars, held, size = [], [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal keys, chars, held, size
        ids = np.concatenate(held)
        used = np.zeros(len(voc.tokens), bool)
        used[ids] = True
        small = (np.cumsum(used) - 1).astype(np.int32)[ids]
        sizes = np.array([len(x) for x in held], dtype=np.int32)
        words = [voc.tokens[i] for i in np.flatnonzero(used)]
        _, _, tail, head, prev = Pack(words, small, sizes).tails()
        both = np.stack([tail, prev], axis=1)
        _, first, n = np.unique(both, axis=0, return_index=True, return_counts=True) if len(both) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
        num = lambda x: [None, *x[first].view(np.int64).tolist()]
        none = [None] * len(first)
        cols = [["pack"] + ["tail"] * len(first), [keys, *none], [chars, *none], [sizes, *none], [words, *none], [small.tobytes(), *none], num(tail), num(head), num(prev), [None, *n.tolist()]]
        keys, chars, held, size = [], [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PACK_TYPES)], names=_PACK_NAMES)

    for b in batches:
        for tkey, text in zip(b["tkey"].to_pylist(), b["text"].to_pylist()):
            ids = voc.encode(text)
            keys.append(tkey)
            chars.append(len(text))
            held.append(ids)
            size += len(ids)
            if size >= FLUSH:
                yield flush()
            if len(voc.raw) > FLUSH:  # the numbers of held texts are the old table's
                if held:
                    yield flush()
                voc = Vocabulary()
    if held:
        yield flush()


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Pack]]:
    for b in batches:
        for i in range(b.num_rows):  # one at a time: a pack is megabytes
            row = b.slice(i, 1).to_pylist()[0]
            yield row, Pack(row["voc"], np.frombuffer(row["ids"], dtype=np.int32), np.array(row["sizes"]))


READINGS_DDL = "tkey binary, tail_size int, tail bigint, size int, n_tokens int, open_block boolean, keys array<bigint>"


def _readings(tails: Tails):
    """Each text as it ends, and as it ends before each of the tails that it has.

    keys has those of its last runs by length, of its closing segment and, before a tail, of the run that its last
    token and the tail's first two make.
    """
    names = [f.split(" ")[0] for f in READINGS_DDL.split(", ")]
    types = [pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, pack in _packs(batches):
            n = len(pack.ends)
            text, k, tail = (np.concatenate([x, y]) for x, y in zip((np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.uint64)), pack.ends_before(tails)))
            place = pack.ends[text] - k
            step, h = np.minimum(k, 2), pack.hashes
            on = h[pack.ids[place]]
            for j in (1, 2):
                on = np.where(step >= j, on * np.uint64(_BASE) + h[pack.ids[np.minimum(place + j, len(pack.ids) - 1)]], on)
            on = np.where(step == 2, _mixed(on, 3), _mixed(on, 2)).view(np.int64)
            fences = np.cumsum(pack.kinds[pack.ids] & Pack.FENCE != 0)
            open_block = (fences[place] - fences[pack.ends[text] - pack.sizes[text] + 1]) % 2 == 1
            for s in pack.stretches(WIDTH):
                r = np.flatnonzero((place >= s.a) & (place < s.b))
                at = place[r] - s.a
                keys = [[x if v else None for x, v in zip(_mixed(g[at], level).view(np.int64).tolist(), ok[at])] for level, g, _, ok in s.runs()]
                t, marked = text[r], k[r] > 0
                keys.append([x if v else None for x, v in zip(on[r].tolist(), marked)])
                cols = [
                    [row["tkeys"][i] for i in t], k[r], pa.array(tail[r].view(np.int64), mask=~marked), np.array(row["chars"])[t], s.pos[at], open_block[r],
                    list(zip(*keys)),
                ]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, ty) for c, ty in zip(cols, types)], names=names)

    return run


@dataclass
class Filter:
    """A set of keys with false hits: the bits that they hash to. Keys of other rounds than its own aren't in it."""

    bits: np.ndarray
    round: int = 0
    rounds: int = 1
    exact: np.ndarray | None = None  # the keys themselves, sorted, where they are few

    @classmethod
    def of(cls, keys: np.ndarray) -> "Filter":
        size = max(1 << 15, 1 << (16 * max(1, len(keys)) - 1).bit_length())
        on = np.zeros(size, np.uint8)
        on[(keys & np.uint64(size - 1)).astype(np.int64)] = 1
        return cls(np.packbits(on, bitorder="little"), exact=np.sort(keys))

    def has(self, keys: np.ndarray) -> np.ndarray:
        p = keys & np.uint64(len(self.bits) * 8 - 1)
        hit = (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        if self.exact is not None:
            at = np.flatnonzero(hit)
            hit[at] = np.isin(keys[at], self.exact)
        return hit if self.rounds == 1 else hit & ((keys >> np.uint64(40)) % np.uint64(self.rounds) == np.uint64(self.round))


def _sum_up(keys: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    coded = pa.array(keys.view(np.int64)).dictionary_encode()
    at, size = coded.indices.to_numpy(), len(coded.dictionary)
    return pa.RecordBatch.from_arrays([coded.dictionary, *(pa.array(np.bincount(at, weights=v, minlength=size).astype(np.int64)) for v in values)], names=["key", "n", "e", "x", "p"])


def _beginnings(token: str) -> np.ndarray:
    import xxhash

    h, out = xxhash.xxh3_64(), []
    for ch in token[:-1]:  # one pass, however long the token
        h.update(ch.encode("utf-8", "replace"))
        out.append(h.intdigest())
    return np.array(out, dtype=np.uint64)


COUNTS_DDL = "key bigint, n bigint, e bigint, x bigint, p bigint"


def _counter(wanted, words=None, tails: Tails | None = None):
    """Counts of the wanted runs and segments: all (n), those at the end of a sentence or line (e), of a text (x), and those of which they are a strict prefix inside the last word (p).

    words is a filter of all runs of one token; without it no beginnings of words are counted. What stands before one
    of the tails at the end of its text isn't counted, as it may have been cut there.
    """

    def by_token(pack: Pack, use: np.ndarray, stops: np.ndarray, last: np.ndarray, want: Filter, frag: np.ndarray, lens: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Runs of one token are the vocabulary."""
        at = np.flatnonzero(use & (pack.pos > 0))
        ids, size = pack.ids[at], len(pack.voc)
        n, e, x = (np.bincount(ids, weights=w, minlength=size) for w in (None, stops[at], last[at]))
        keys = _mixed(pack.hashes, 1)
        hit = np.flatnonzero(want.has(keys) & (n > 0))
        zero = np.zeros(len(hit))
        rep = np.repeat(n, lens)
        begun = _mixed(frag, 1)
        sub = np.flatnonzero(want.has(begun) & (rep > 0))
        none = np.zeros(len(sub))
        return [(keys[hit], n[hit], e[hit], x[hit], zero), (begun[sub], none, none, none, rep[sub])]

    def by_place(s: Stretch, use: np.ndarray, want: Filter, frag: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        some = lens[s.ids] > 0
        for level, g, before, ok in s.runs():
            if level == 1:
                continue
            ok &= use
            at = np.flatnonzero(ok)
            keys = _mixed(g[at], level)
            hit = want.has(keys)
            sel = at[hit]
            yield keys[hit], np.ones(len(sel)), s.stops[sel], s.last[sel], np.zeros(len(sel))
            # Beginnings of each word after the tokens before it.
            at = np.flatnonzero(ok & some)
            k = lens[s.ids[at]]
            rep = np.repeat(at, k)
            inner = np.arange(len(rep)) - np.repeat(np.cumsum(k) - k, k)
            keys = _mixed(before[rep] * np.uint64(_BASE) + frag[starts[s.ids[rep]] + inner], level)
            keys = keys[want.has(keys)]
            zero = np.zeros(len(keys))
            yield keys, zero, zero, zero, np.ones(len(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, some = wanted.value, words.value if words else None
        known: dict[str, np.ndarray] = {}
        none = np.zeros(0, np.uint64)
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for _, pack in _packs(batches):
            per = []
            for t, kind in zip(pack.voc, pack.kinds.tolist()):
                if some is None or len(t) < 2 or not kind & Pack.ALPHA:
                    per.append(none)
                    continue
                f = known.get(t)
                if f is None:
                    f = _beginnings(t)
                    f = f[some.has(_mixed(f, 1))]
                    if len(t) < 40 and len(known) < FLUSH:
                        known[t] = f
                per.append(f)
            frag, lens = np.concatenate([none, *per]), np.array([len(x) for x in per], dtype=np.int64)
            starts = np.cumsum(lens) - lens
            use = np.ones(len(pack.ids), bool)
            if tails:
                text, k, _ = pack.ends_before(tails)
                use[pack.ends[text] - k] = False
            stops, last = [], []
            for s in pack.stretches(WIDTH):
                for part in by_place(s, use[s.a : s.b], want, frag, starts, lens):
                    if len(part[0]):
                        parts.append(part)
                        held += len(part[0])
                stops.append(s.stops)
                last.append(s.last)
            parts += by_token(pack, use, np.concatenate(stops), np.concatenate(last), want, frag, lens)
            if held >= 4 * FLUSH:
                yield _sum_up(*[np.concatenate(c) for c in zip(*parts)])
                parts, held = [], 0
        if parts:
            yield _sum_up(*[np.concatenate(c) for c in zip(*parts)])

    return run


def filter_of(keys: DataFrame, n: int, round: int = 0, rounds: int = 1) -> Filter:
    """A filter of one round's keys (column key), of 16 bits for each of n keys, at most FILTER_BITS."""
    size = max(1 << 15, min(FILTER_BITS, 1 << (16 * max(1, n) // rounds - 1).bit_length()))
    mine = F.pmod(F.shiftrightunsigned("key", 40), F.lit(rounds)) == round
    pos = F.col("key").bitwiseAND(F.lit(size - 1)) + 1
    rows = keys.where(mine).select(pos.alias("pos")).groupBy(F.bitmap_bucket_number("pos").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("bits")).collect()
    out = np.zeros(size // 8, dtype=np.uint8)
    for r in rows:  # at most FILTER_BITS / 32768 of 4 KB each
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, dtype=np.uint8)
    return Filter(out, round, rounds)


def find_tails(packed: DataFrame, n_texts: int) -> Tails:
    """The tails that recur after tokens of many kinds.

    A text has at most TAIL of them, and each is in one of MARK_RATE texts, so there are at most TAIL * MARK_RATE.
    """
    spark = packed.sparkSession
    pairs = packed.where("kind = 'tail'").groupBy("tail", "prev").agg(F.sum("n").alias("n"), F.first("head").alias("head"))
    often = pairs.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.max("n").alias("top"), F.first("head").alias("head"))
    rows = often.where(F.col("n") >= max(MARK_MIN, n_texts / MARK_RATE)).where("kinds >= 3 and 3 * top <= n").select("tail", "head", "n").collect()
    rows.sort(key=lambda r: r.tail & _WORD)
    ints = lambda x: np.array(x, dtype=np.int64)
    heads = np.unique(ints([r.head for r in rows]))
    sent = spark.sparkContext.broadcast(Filter.of(heads.view(np.uint64)))
    seen = packed.where("kind = 'pack'").mapInArrow(_counter(sent), COUNTS_DDL).groupBy("key").agg(F.sum("n").alias("n"))
    every = {r.key: r.n for r in seen.collect()} if rows else {}  # of the heads alone
    return Tails(ints([r.tail for r in rows]).view(np.uint64), ints([r.n for r in rows]), np.array([r.n >= END_SHARE * every.get(r.head, 0) for r in rows], dtype=bool))


def score_readings(packed: DataFrame, readings: DataFrame, tails: Tails, n_keys: int) -> DataFrame:
    """(sig, run, seg, last_n, so) of the distinct readings; readings: sig, own, keys.

    run has the counts of its longest last run with EVIDENCE elsewhere, seg those of its closing segment, null for none;
    last_n and so count its last token, and that with the first two of the tail after it.
    """
    spark = packed.sparkSession
    by_key = lambda r: r.select(*r.drop("keys").columns, F.posexplode("keys").alias("level", "key")).where("key is not null").withColumn("level", F.col("level") + 1)
    every = by_key(readings.select("keys"))
    keys = by_key(readings.groupBy("sig", "own").agg(F.first("keys").alias("keys")))
    rounds = max(1, -(-16 * n_keys // FILTER_BITS))
    words = spark.sparkContext.broadcast(filter_of(every.where("level = 1"), n_keys)) if rounds > 1 else None
    counts = None
    for i in range(rounds):
        sent = spark.sparkContext.broadcast(filter_of(every, n_keys, i, rounds))
        part = packed.where("kind = 'pack'").mapInArrow(_counter(sent, words or sent, tails), COUNTS_DDL)
        counts = part if counts is None else counts.unionByName(part)
    hits = counts.groupBy("key").agg(*[F.sum(c).alias(c) for c in "nexp"])
    got = keys.join(hits, "key").select("sig", "level", *[(F.col(c) - F.when(F.col("level") <= SEGMENT, F.col("own")).otherwise(0)).alias(c) for c in "nex"], "p")
    level, c = F.col("level"), F.struct(F.col("level").alias("len"), *"nexp")
    return got.groupBy("sig").agg(
        F.max(F.when((level <= RUN) & (F.col("n") + F.col("p") >= EVIDENCE), c)).alias("run"), F.max(F.when(level == SEGMENT, c)).alias("seg"),
        F.max(F.when(level == 1, F.col("n"))).alias("last_n"), F.max(F.when(level > SEGMENT, F.col("n"))).alias("so"),
    )


COPY_DDL = "tkey binary, part int, first_text string, open_text string, inside_word boolean, inside_sentence boolean"
GOES_ON = 40  # characters looked at on each side of the place where a prefix stops


def goes_on(text: str, longer: str) -> tuple[bool, bool]:
    """Whether the longer text goes on inside a word, or inside a sentence, where text stops."""
    rest = longer[len(text) : len(text) + GOES_ON]
    inside_word = len(TOKEN.findall(text[-1:] + rest[:1])) == 1 and text[-1:].isalpha() and rest[:1].isalpha()
    before, after = tokens(text[-GOES_ON:]), tokens(rest)
    n1 = after[0] if after else END
    n2 = after[1] if len(after) > 1 else END
    inside = not stops(before[-1], n1, n2) and not (n1 == " " and n2 in ("(", "#")) and n1 not in (",", "(")
    return inside_word, inside_word or inside


class _Prefix:
    """A text of the sorted scan while longer ones may follow, and how those seen so far go on (None: none seen)."""

    __slots__ = ("tkey", "text", "inside_word", "inside_sentence", "rest")

    def __init__(self, tkey: bytes, text: str) -> None:
        self.tkey, self.text = tkey, text
        self.inside_word = self.inside_sentence = self.rest = None

    def extend(self, longer: str) -> bool:
        """Takes one more extension; whether no other can change the result."""
        rest = longer[len(self.text) : len(self.text) + GOES_ON]
        if rest != self.rest:  # neighbours often go on alike
            word, sentence = goes_on(self.text, longer)
            self.inside_word, self.inside_sentence, self.rest = bool(self.inside_word or word), bool(self.inside_sentence or sentence), rest
        return bool(self.inside_word and self.inside_sentence)


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of the texts of one sorted partition. Rows with open_text may go on in the partitions after it."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    types = [pa.binary(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
    names = ["tkey", "part", "first_text", "open_text", "inside_word", "inside_sentence"]
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    first = last = None
    stack: list[_Prefix] = []  # each a prefix of the next one
    for b in batches:
        rows = []
        for tkey, text in zip(b["tkey"].to_pylist(), b["text"].to_pylist()):
            if first is None:
                first = text
            if text == last:
                continue
            last = text
            while stack and not text.startswith(stack[-1].text):
                e = stack.pop()
                if e.rest is not None:
                    rows.append((e.tkey, part, None, None, e.inside_word, e.inside_sentence))
            still = []
            for e in stack:
                if e.extend(text):
                    rows.append((e.tkey, part, None, None, True, True))
                else:
                    still.append(e)
            stack = [*still, _Prefix(tkey, text)]
        if rows:
            yield make(rows)
    if first is not None:
        yield make([(e.tkey, part, first, e.text, e.inside_word, e.inside_sentence) for e in stack])


def prefix_copies(texts: DataFrame) -> DataFrame:
    """(tkey, inside_word, inside_sentence) of every distinct text that is a strict prefix of another.

    The flags hold if any of its extensions goes on so. A text whose extensions
    run over the end of its partition, at most a few per partition, meets all
    of them again by the shortest such text's length of characters.
    """
    ordered = texts.select("tkey", "text").repartitionByRange("text").sortWithinPartitions("text")
    got = materialize(ordered.mapInArrow(_extended, COPY_DDL), "copies")
    flags = got.where("inside_word is not null").select("tkey", "inside_word", "inside_sentence")
    # One number per partition of the sort meets in a task; the texts are joined to it.
    parts = got.where("open_text is not null").select("part", "first_text").distinct()
    after = parts.select("part", F.lead("part").over(Window.partitionBy(F.lit(0)).orderBy("part")).alias("after"))
    nexts = after.join(parts.select(F.col("part").alias("after"), F.col("first_text").alias("next")), "after").select("part", "next")
    crossing = materialize(got.where("open_text is not null").join(nexts, "part").where(F.startswith("next", "open_text")).select("tkey", "open_text"), "crossing")
    shortest = crossing.agg(F.min(F.char_length("open_text")).alias("n")).first().n
    if shortest is not None:
        key = lambda c: F.substring(c, 1, shortest)
        o = crossing.select("tkey", "open_text", key("open_text").alias("k"))
        later = texts.select("text", key("text").alias("k")).join(o, "k").where(F.startswith("text", "open_text") & (F.char_length("text") > F.char_length("open_text")))
        n = F.lit(GOES_ON)
        ways = later.select("tkey", F.right("open_text", n).alias("before"), F.substr("text", F.char_length("open_text") + 1, n).alias("rest")).distinct()

        @F.pandas_udf("inside_word boolean, inside_sentence boolean")
        def on(a, b):
            import pandas as pd

            return pd.DataFrame([goes_on(x, x + y) for x, y in zip(a, b)], columns=["inside_word", "inside_sentence"])

        flags = flags.unionByName(ways.select("tkey", on("before", "rest").alias("g")).select("tkey", "g.*"))
    return flags.groupBy("tkey").agg(F.bool_or("inside_word").alias("inside_word"), F.bool_or("inside_sentence").alias("inside_sentence"))


def length_limits(sized: DataFrame) -> DataFrame:
    """(source, size, at, around): lengths at which a source has far more distinct texts than around them."""
    per = sized.where("source is not null").groupBy("source", "size").agg(F.count_distinct("tkey").alias("at"))
    near = Window.partitionBy("source").orderBy("size").rangeBetween(-NEAR, NEAR)
    longer = Window.partitionBy("source").orderBy("size").rangeBetween(1, Window.unboundedFollowing)
    every = Window.partitionBy("source")
    spread = per.select(
        "source", "size", "at", ((F.sum("at").over(near) - F.col("at")) / F.lit(2.0 * NEAR)).alias("around"),
        (F.coalesce(F.sum("at").over(longer), F.lit(0)) / F.sum("at").over(every)).alias("longer"),
    )
    return spread.where((F.col("at") >= LIMIT_MIN) & (F.col("at") >= LIMIT_TIMES * (F.col("around") + 0.5)) & (F.col("longer") < LIMIT_LONGER)).select("source", "size", "at", "around")




def keyed_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tkey, size) of the documents that aren't blank; (tkey, text) of their distinct texts."""
    rows = docs.select("doc_id", norm_source(F.col("source")).alias("source"), "text").where(~is_blank(F.col("text")))
    keyed = rows.select("doc_id", "source", F.unhex(F.md5("text")).alias("tkey"), F.char_length("text").alias("size"))
    return keyed, materialize(rows.select("text").distinct().select(F.unhex(F.md5("text")).alias("tkey"), "text"), "texts")


def read_endings(texts: DataFrame) -> tuple[DataFrame, int, int]:
    """Every reading of every text with its scores; tokens and texts of the corpus."""
    total = {"tokens": F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)), "texts": F.sum(F.when(F.col("kind") == "pack", F.size("sizes")))}
    packed = materialize(texts.mapInArrow(_tokenise, PACK_DDL), "packs", partition_by=["kind"], counts=total)
    n_tokens, n_texts = (int(packed._logloom_counts.get(c) or 0) for c in ("tokens", "texts"))
    tails = find_tails(packed, n_texts)
    found = packed.where("kind = 'pack'").mapInArrow(_readings(tails), READINGS_DDL)
    sig = found.withColumn("own", F.when(F.col("tail_size") == 0, 1).otherwise(0))  # before a tail a text isn't counted
    readings = materialize(sig.withColumn("sig", F.xxhash64("keys", "own")), "readings", counts={"keys": F.sum(F.size("keys"))})
    scores = score_readings(packed, readings.select("sig", "own", "keys"), tails, int(readings._logloom_counts.get("keys") or 0))
    return readings.drop("keys", "own").join(scores, "sig", "left"), n_tokens, n_texts


def share(c: str, of: str) -> Column:
    """The share of a count in all that a run or segment is found with."""
    return F.try_divide(F.col(f"{of}.{c}"), F.col(f"{of}.n") + F.col(f"{of}.p"))


def learned_marks(readings: DataFrame) -> DataFrame:
    """(tail): tails before which runs hardly ever end, and hardly ever go on with the tail."""
    p = share("e", "run")
    stat = readings.where("tail_size > 0").groupBy("tail").agg(
        F.count(p).alias("judged"), F.count_if(p < RARE).alias("open"), F.sum(F.col("so") - 1).alias("so"), F.sum("last_n").alias("last_n")
    )
    return stat.where((F.col("judged") >= MARK_MIN) & (F.col("open") >= END_SHARE * F.col("judged")) & (F.col("so") <= NATURAL * F.coalesce("last_n", F.lit(0)))).select("tail")


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, source, reason, ways): reason is the first way that holds, null for whole texts; blank texts have no row."""
    keyed, texts = keyed_rows(docs)
    endings, n_tokens, n_texts = read_endings(texts)
    readings = materialize(endings, "endings")
    marked = (
        readings.where("tail_size > 0").join(learned_marks(readings), "tail", "left_semi")
        .where("run is not null").select("tkey").distinct().withColumn("marked", F.lit(True))
    )
    one = readings.where("tail_size = 0").join(prefix_copies(texts), "tkey", "left").join(marked, "tkey", "left")
    p, x, seg = share("e", "run"), share("x", "run"), share("e", "seg")
    goes_on = lambda limit: F.coalesce(p < limit, F.lit(True))
    told = (F.col("n_tokens") >= MIN_TOKENS) | (F.coalesce(F.greatest("run.p", "seg.p"), F.lit(0)) > 0)
    unmarked = F.col("marked").isNull()
    ways = {
        "copy": unmarked & (F.col("inside_word") & goes_on(0.3) | F.col("inside_sentence") & told & (p < LIKELY)),
        "segment": unmarked & told & (seg < RARE) & (F.col("seg.n") + F.col("seg.p") >= 2) & goes_on(LIKELY),
        # One or two tokens only tell a fragment.
        "run": unmarked & told & (p < RARE) & ((F.col("run.len") > 2) | (share("p", "run") >= 0.9)),
        "mark": F.col("marked"),
        "open_block": unmarked & F.col("open_block") & (x < RARE),
    }
    verdict = one.select(
        "tkey", p.alias("p"), *[F.coalesce(F.col(f"run.{c}"), F.lit(0)).alias(f"r{c}") for c in "nxp"],
        F.filter(F.array(*[F.when(w, F.lit(name)) for name, w in ways.items()]), lambda w: w.isNotNull()).alias("ways"),
    )
    # Of the texts at a limit: cut there by chance, or an end that happens to be there. Without evidence the lengths decide.
    as_cut = F.col("at") * (F.col("rn") - F.col("rx") + F.col("rp")) / F.lit(float(max(1, n_tokens)))
    as_end = (F.col("around") + 0.1) * (F.col("rx") + 0.5) / F.lit(float(max(1, n_texts)))
    limit = F.when(F.col("p").isNull(), F.col("at") > F.col("around")).otherwise(as_cut > as_end)
    every = F.when(F.coalesce(limit, F.lit(False)), F.array_append("ways", F.lit("limit"))).otherwise(F.col("ways"))
    return keyed.join(verdict, "tkey").join(length_limits(keyed), ["source", "size"], "left").select("doc_id", "source", F.get(every, F.lit(0)).alias("reason"), every.alias("ways"))


def find_cut(docs: DataFrame) -> DataFrame:
    """Rows of p10_found: doc_id."""
    return judge(docs).where("reason is not null").select("doc_id").distinct()


WAYS = ("copy", "segment", "run", "mark", "open_block", "limit")


def cut_rates(docs: DataFrame) -> DataFrame:
    """Per source: documents with text, cut ones by each way that holds (a text may count in several), and the rate."""
    j = judge(docs)
    return j.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(
        F.count("*").alias("n_docs"), F.count("reason").alias("n_cut"), *[F.count_if(F.array_contains("ways", w)).alias(f"n_{w}") for w in WAYS],
        F.round(F.count("reason") / F.count("*"), 6).alias("cut_rate"),
    )
