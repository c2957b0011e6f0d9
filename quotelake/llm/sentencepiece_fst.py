"""SentencePiece encoding and decoding by weighted finite-state transduction.

The model is compiled to machines given by their arcs: the normaliser (a trie of its character map, longest path first), the
pieces (a trie whose paths write a piece at a weight), byte fallback (a character that is no piece is read as its bytes), and
for a merge model the acceptor of neighbours. The normaliser and byte fallback have exactly one path for each input and no weights, so
composing them with the rest changes no path's weight: the normaliser is run before the search, and bytes are written after it. The pieces and the acceptor
are composed with the normalised input on the fly, and the encoding is the shortest path in the tropical semiring.

* Unigram models: a piece weighs its negated score; a character without a piece costs the model's lowest score less 10.
* Merge (BPE) models: scores order merges and don't add up, so pieces weigh 0 and the borders decide. A sequence of pieces is the
  model's encoding exactly if each piece merges up by itself and each two neighbours, merged anew, stay apart: merges inside two
  neighbours happen in the same order as in the whole text, so a merge across their border would happen there too. The
  acceptor gives a border weight 0 if its pieces stay apart, and infinity if not. Each prefix then has one path of finite weight.

No piece crosses from another character to a white space mark, or from a letter to a punctuation sign that the model never
joins to one, and some characters are in no longer piece; paths therefore split there. Of a slice of texts each different
stretch is worked out once, many together by array operations.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.common import give_back, slices, utf8

codecs.register_error("sp_bytes", lambda e: ("\ufffd" * (e.end - e.start), e.end))
#: A public merge model with byte fallback; any path of a SentencePiece model can be given.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "\u2581"
# Fixed values of the model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: A worker remembers so many borders at most.
_REMEMBERED = 100_000
#: Longer stretches are walked alone.
_SHORT = 64
#: So many stretches are worked out together, of texts of about so many bytes.
_TOGETHER, _TEXTS = 1 << 13, 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message: integers, four or eight bytes, or length-delimited bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value, at, shift = value | (b & 127) << shift, at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            n = {1: 8, 5: 4}.get(kind)
            if n is None:
                n, at = varint(at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def _character_map(blob: bytes) -> dict[bytes, bytes]:
    """The normaliser's rules: the strings of its double-array trie and what they turn into."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
    values = blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 1 << 9) >> 6)
    rules: dict[bytes, bytes] = {}
    stack = [(offset(units[0]), b"")]
    while stack:
        base, prefix = stack.pop()
        for label in range(1, 256):
            at = base ^ label
            if at < len(units) and units[at] & 0x800000FF == label:
                below, key = at ^ offset(units[at]), prefix + bytes([label])
                if units[at] >> 8 & 1:
                    start = units[below] & 0x7FFFFFFF
                    rules[key] = values[start : values.index(b"\0", start)]
                stack.append((below, key))
    return rules


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    rules: dict[bytes, bytes] | None = None
    dummy_prefix: bool = True
    trim: bool = True
    mark_spaces: bool = True


def read_model(data: bytes) -> Model:
    """A model file's pieces, kind and normaliser."""
    m = Model([])
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            m.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
        elif number == 2:
            f = dict(_fields(value))
            m.kind, m.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            if f.get(24):
                raise ValueError("white space marks as suffixes aren't supported")
        elif number == 3:
            f = dict(_fields(value))
            m.rules = _character_map(f.get(2, b""))
            m.dummy_prefix, m.trim, m.mark_spaces = bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
    if m.kind not in (UNIGRAM, BPE) or any(kind == USER_DEFINED for _, _, kind in m.pieces):
        raise ValueError("only unigram and merge models without user-defined symbols are supported")
    return m


def _trie(paths: Iterable[tuple]) -> dict:
    """Arcs of a machine that reads each key and writes its value."""
    root: dict = {}
    for key, value in paths:
        node = root
        for sign in key:
            node = node.setdefault(sign, {})
        node[None] = value
    return root


class _Remembered(dict):
    """What ``work`` makes of a key, remembered: once ``most`` are held, those not asked for lately go. Long keys aren't kept."""

    def __init__(self, work: Callable, most: int):
        super().__init__()
        self.work, self.most, self.older = work, most // 2, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.work(key)
        if len(key) <= _SHORT:
            self.make_room()
            self[key] = found
        return found

    def make_room(self) -> None:
        """Half of what may be held is full: it becomes the older half."""
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()


class _Table:
    """A hash table from 64-bit keys to numbers as two arrays, asked for many keys at once; -1 for those it doesn't hold."""

    def __init__(self, entries: dict[int, int]):
        keys, values = (np.fromiter(x, np.int64, len(entries)) for x in (entries.keys(), entries.values()))
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            placed = self.keys[at] == keys
            self.values[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], self._next(at[~placed])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        todo = np.flatnonzero((held != keys) & (held != -1))
        at = at[todo]
        while len(todo):
            at = self._next(at)
            held, own = self.keys[at], keys[todo]
            hit = held == own
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (held != -1)
            todo, at = todo[on], at[on]
        return out


class _MergeArcs:
    """A merge model's machines as arrays, composed with many stretches at once by the search of ``Transducer._shortest``: each stretch goes on from where it
    is by the longest arc whose border has a finite weight, and back where there is none."""

    def __init__(self, t: Transducer):
        self.t = t
        singles = sorted({c for p in t.scores for c in p})
        self.symbols = [*t.scores, *(c for c in singles if c not in t.scores)]
        number = {p: i for i, p in enumerate(self.symbols)}
        self.other = len(self.symbols)  # any character that is in no piece
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in singles]] = np.arange(1, len(singles) + 1)
        self.cuts = np.zeros(0x110000, np.uint8)
        for mark, signs in ((3, t.alone), (1, MARK), (2, t.signs)):
            self.cuts[[ord(c) for c in signs]] = mark
        self.single = np.array([self.other, *(number[c] for c in singles)], np.int64)
        self.width = len(singles) + 1
        place = {c: i for i, c in enumerate(singles, 1)}
        # the trie: transitions by (state, class), and the symbol that a state writes
        steps: dict[int, int] = {}
        writes = [-1]
        stack = [(t.reading, 0)]
        while stack:
            node, state = stack.pop()
            for sign, below in node.items():
                if sign is None:
                    writes[state] = number[below]
                else:
                    steps[state * self.width + place[sign]] = len(writes)
                    stack.append((below, len(writes)))
                    writes.append(-1)
        self.steps, self.writes = _Table(steps), np.array(writes, np.int64)
        # merges: when a symbol is made (-1: from the start) and of what, and when two neighbours merge
        n = self.other + 1
        when = {s: i for i, s in enumerate(sorted(set(t.scores.values()), reverse=True))}
        self.made, self.left, self.right, self.astray = (np.full(n, -1, np.int64) for _ in range(4))
        joins: dict[int, int] = {}
        for p, s in t.scores.items():
            i = number[p]
            self.astray[i] = p in t.astray
            if p in t.parts:
                self.made[i], (self.left[i], self.right[i]) = when[s], (number[x] for x in t.parts[p])
            for k in range(1, len(p)):
                a, b = number.get(p[:k]), number.get(p[k:])
                if a is not None and b is not None:
                    joins[a * n + b] = when[s]
        self.joins, self.n = _Table(joins), n
        self.id_of = np.array([t.ids[p][0] if p in t.ids else -1 for p in self.symbols] + [-1], np.int64)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``Transducer._apart`` for many borders."""
        out = np.ones(len(a), bool)
        odd = (self.astray[a] == 1) | (self.astray[b] == 1)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.t.borders[tuple(self.symbols[k] if k != self.other else "\ufffe" for k in (a[i], b[i]))]
        live = np.flatnonzero(~odd)
        a, b = a[live], b[live]
        used_a = used_b = np.full(len(live), np.iinfo(np.int64).max)
        while len(live):
            joined = self.joins.get(a * self.n + b)
            across = (joined >= 0) & (joined < used_a) & (joined <= used_b)
            out[live[across]] = False
            on = ~across & ((self.made[a] >= 0) | (self.made[b] >= 0))
            live, a, b, used_a, used_b = (x[on] for x in (live, a, b, used_a, used_b))
            made_a, made_b = self.made[a], self.made[b]
            later = made_a > made_b
            used_a, used_b = np.where(later, made_a, used_a), np.where(later, used_b, made_b)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out

    def written(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many are each text's): ``Transducer._written`` for many texts that aren't empty. Each has a place of its own after its last character."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat = "\0".join([*texts, ""])
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size + 1) - 1
        starts, total = ends - size, len(flat)
        kind = self.classes[np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)]
        limit = np.repeat(ends, size + 1)
        # arcs: the trie is walked from all places together; a character that is no piece is read as itself
        alive = np.flatnonzero(np.arange(total) < limit)
        state, read = np.zeros(len(alive), np.int64), []
        while len(alive):
            state = self.steps.get(state * self.width + kind[alive + len(read)])
            column = np.full(total, -1, np.int32)
            column[alive] = np.where(state >= 0, self.writes[state], -1)
            if not read:
                column[alive] = np.where(column[alive] >= 0, column[alive], self.single[kind[alive]])
            read.append(column)
            on = (state >= 0) & (alive + len(read) < limit[alive])
            alive, state = alive[on], state[on]
        table = np.stack(read[::-1], axis=1)
        begin, column = np.nonzero(table >= 0)
        piece, reached = table[begin, column].astype(np.int64), begin + len(read) - column
        first = np.zeros(total + 1, np.int64)
        np.cumsum(np.bincount(begin, minlength=total), out=first[1:])
        # the search: for each text its place and the next arc to try there; for each place the arc it was reached by
        came = np.full(total, -1, np.int64)
        open_, place, arc = np.arange(len(texts)), starts.copy(), first[starts]
        while len(open_):
            none = arc[open_] >= first[place[open_] + 1]
            back, ahead = open_[none], open_[~none]
            last = came[place[back]]
            place[back], arc[back] = begin[last], last + 1
            k, at = arc[ahead], place[ahead]
            fits = at == starts[ahead]
            inner = np.flatnonzero(~fits)
            fits[inner] = self.apart(piece[came[at[inner]]], piece[k[inner]])
            arc[ahead[~fits]] += 1
            go, k = ahead[fits], k[fits]
            came[reached[k]] = k
            place[go] = reached[k]
            on = go[reached[k] < ends[go]]
            arc[on] = first[place[on]]
            open_ = np.concatenate([back, ahead[~fits], on])
        # arcs on the paths, from the ends back; sorted they are in order
        path, at, owner = [], ends, np.arange(len(texts))
        while len(at):
            k = came[at]
            path.append(k)
            at, owner = begin[k], owner
            on = at > starts[owner]
            at, owner = at[on], owner[on]
        path = np.sort(np.concatenate(path)) if path else np.zeros(0, np.int64)
        ids, bounds = self.id_of[piece[path]], np.searchsorted(begin[path], [*starts.tolist(), total])
        counts = np.diff(bounds)
        spelled = np.flatnonzero(np.add.reduceat(np.append(ids < 0, False), bounds[:-1]) > 0)
        if not len(spelled):
            return ids, counts
        parts, done = [], 0
        for i in spelled.tolist():
            own = path[bounds[i] : bounds[i + 1]]
            fresh = self.t.write([flat[a:b] for a, b in zip(begin[own].tolist(), reached[own].tolist(), strict=True)])
            parts += [ids[done : bounds[i]], np.array(fresh, np.int64)]
            counts[i], done = len(fresh), bounds[i + 1]
        return np.concatenate([*parts, ids[done:]]), counts


class Transducer:
    """The compiled model: the machines' arcs. Made from ``Model`` in each Python worker (the model is broadcast).

    A machine is a trie of dictionaries: a node's arcs by their sign, and under ``None`` what the path from the root to it writes.
    """

    def __init__(self, model: Model):
        self.model = model
        self.merges = model.kind == BPE
        self.scores = {p: s for p, s, kind in model.pieces if kind == NORMAL}
        self.rewriting = _trie((k, v) for k, v in (model.rules or {}).items())
        # weights: a constant for each character keeps them from being negative and adds the same to every path
        lift = 0.0 if self.merges else max(0.0, max(self.scores.values(), default=0.0))
        self.weight = {p: 0.0 if self.merges else lift * len(p) - s for p, s in self.scores.items()}
        self.lowest = 0.0 if self.merges else lift + 10 - min(self.scores.values(), default=0.0)
        self.parts = self._parts() if self.merges else {}
        self.formed = {p: self.scores[p] if len(p) > 1 else float("inf") for p in self.scores}
        # pieces with a merge that scores no worse than one before it: for the others time runs along the scores
        self.astray: set[str] = set()
        for p in sorted(self.parts, key=len):
            if any(x in self.astray or self.formed[p] >= self.formed.get(x, float("inf")) for x in self.parts[p]):
                self.astray.add(p)
        self.joined = {a + b for p in self.scores for a, b in zip(p, p[1:], strict=False)}
        self.longest = max(map(len, self.scores), default=1)
        self.reading = _trie((p, p) for p in self.scores if not self.merges or len(p) == 1 or p in self.parts)
        # what is written for a piece: its id; for a character that is none: its bytes' ids, or the unknown piece
        self.ids = {p: (i,) for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
        self.borders = _Remembered(self._apart, _REMEMBERED)
        self.stretches = self._stretches()
        self.arcs = _MergeArcs(self) if self.merges and self.stretches is not None else None
        spoken = {NORMAL: lambda p: p.replace(MARK, " ").encode(), UNUSED: lambda p: p.replace(MARK, " ").encode(), BYTE: lambda p: bytes([int(p[3:5], 16)]), UNKNOWN: lambda p: " \u2047 ".encode()}
        self.sounds = [spoken.get(kind, lambda p: b"")(p) for p, _, kind in model.pieces]

    def _stretches(self) -> re.Pattern | None:
        """Where every path may be cut: no piece crosses these borders. None if the model's pieces cross white space marks."""
        long = {c for p in self.scores if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\r\t0123456789" if c not in long)
        # signs that in no piece follow another character than a mark or a sign: a stretch ends before them
        signs = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
        while crossed := [c for c in signs if any(b == c and a != MARK and a not in signs for a, b in self.joined)]:
            signs = "".join(c for c in signs if c not in crossed)
        self.alone, self.signs = alone, signs
        other = f"[^{MARK}{re.escape(alone + signs)}]"
        options = [f"{MARK}+[{re.escape(signs)}]*{other}*", f"[{re.escape(signs)}]+{other}*"] if signs else [f"{MARK}+{other}*"]
        if any(MARK in p.lstrip(MARK) for p in self.scores) or not self.model.byte_fallback:
            return None
        return re.compile("|".join([*([f"[{re.escape(alone)}]"] if alone else []), *options, f"{other}+"]))

    def normalise(self, text: str) -> str:
        """The normaliser's output: at each place the longest path of its rules, else the character itself; then white space."""
        if self.model.rules:
            data, out, at = text.encode(), [], 0
            while at < len(data):
                b = data[at]
                node, end, best = self.rewriting, at, (1 if b < 128 else 2 if b < 224 else 3 if b < 240 else 4, None)
                while end < len(data) and (node := node.get(data[end])) is not None:
                    end += 1
                    if None in node:
                        best = end - at, node[None]
                out.append(data[at : at + best[0]] if best[1] is None else best[1])
                at += best[0]
            text = b"".join(out).decode("utf-8", "replace")
        if self.model.trim:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.model.mark_spaces else text

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """What merging alone makes of a short text (the best-scored pair first, the leftmost of equals), and the last pair that merged."""
        parts, last = list(text), None
        while True:
            best = None
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best[0]):
                    best = (score, i)
            if best is None:
                return parts, last
            i = best[1]
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _parts(self) -> dict[str, tuple[str, str]]:
        """The two parts of each longer piece's last merge; a piece that doesn't merge up by itself is left out: it is on no path."""
        found = {}
        for p in self.scores:
            if len(p) > 1:
                made, last = self._merged(p)
                if made == [p]:
                    found[p] = last
        return found

    def _apart(self, pair: tuple[str, str]) -> bool:
        """The acceptor of neighbours: is the border's weight 0 (else infinity)? Time runs back through the merges on both sides of the
        border; pieces stay apart unless two that stood there at one time merge before either is used up."""
        a, b = pair
        if a in self.astray or b in self.astray:
            return self._merged(a + b)[0] == [a, b]
        scores, formed, always = self.scores.get, self.formed.get, float("inf")
        used_a = used_b = -always
        while True:
            score = scores(a + b)
            if score is not None and score > used_a and score >= used_b:
                return False
            made_a, made_b = formed(a, always), formed(b, always)
            if made_a == made_b == always:
                return True
            if made_a < made_b:
                a, used_a = self.parts[a][1], made_a
            else:
                b, used_b = self.parts[b][0], made_b

    def _shortest(self, text: str) -> list[str]:
        """The pieces on the shortest path of the input composed with the machines; single characters may be none.

        Best first, and of equals the furthest first. A place of the input is one state of the composition: for unigram models nothing
        else is remembered, and for merge models only one path of finite weight reaches it, whose last piece is the state of the
        acceptor of neighbours. A border's weight is looked up when its arc is taken.
        """
        n, came = len(text), [None] * (len(text) + 1)
        borders, weight, merges, reading = self.borders, self.weight, self.merges, self.reading
        # where no arc weighs anything the order doesn't matter, and a stack does
        push, pop = (list.append, list.pop) if merges else (heappush, heappop)
        waiting = [(0.0, 0, 0, "")]
        while True:
            cost, at, begin, piece = pop(waiting)
            at = -at
            if came[at] is not None or merges and begin and not borders[came[begin][1], piece]:
                continue
            came[at] = begin, piece
            if at == n:
                break
            node, end = reading, at
            if text[at] not in weight:
                push(waiting, (cost + self.lowest, -at - 1, at, text[at]))
            for sign in text[at : at + self.longest]:
                if sign not in node:
                    break
                node = node[sign]
                end += 1
                if None in node:
                    read = node[None]
                    push(waiting, (cost + weight[read], -end, at, read))
        out, at = [], n
        while at:
            at, piece = came[at]
            out.append(piece)
        return out[::-1]

    def write(self, pieces: list[str]) -> tuple[int, ...]:
        """The ids that a path writes."""
        out: list[int] = []
        for p in pieces:
            own = self.ids.get(p)
            if own is None and self.model.byte_fallback and self.bytes:
                own = tuple(self.bytes[b] for b in p.encode())
            if own is not None:
                out += own
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return tuple(out)

    def _written(self, text: str) -> tuple[int, ...]:
        return self.write(self._shortest(text))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin, and the end). Each different stretch is worked out once, many together; long ones alone."""
        whole = [self.normalise(t) for t in texts]
        if self.arcs is None:
            lists = [list(chain.from_iterable(map(self._written, self.stretches.findall(t) if self.stretches else [t]))) if t else [] for t in whole]
            return np.array(list(chain.from_iterable(lists)), np.int64), np.cumsum([0, *map(len, lists)])
        flat = "".join(whole)
        first = np.cumsum([0, *map(len, whole)])
        codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        # where stretches begin, by what stands there and before
        kind = self.arcs.cuts[codes]
        new = np.zeros(len(codes) + 1, bool)
        new[1:-1] = (kind[1:] == 3) | (kind[:-1] == 3) | (kind[1:] == 1) & (kind[:-1] != 1) | (kind[1:] == 2) & (kind[:-1] == 0)
        new[first] = True
        edges = np.flatnonzero(new)
        start, length = edges[:-1], np.diff(edges)
        short = np.flatnonzero(length <= _SHORT)
        hashes, at = length[short].astype(np.uint64), np.arange(len(short))
        for k in range(_SHORT):
            at = at[length[short[at]] > k]
            if not len(at):
                break
            hashes[at] = hashes[at] * np.uint64(0x9E3779B97F4A7C15) + (codes[start[short[at]] + k].astype(np.uint64) ^ np.uint64(0x5851F42D))
        _, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        # stretches of one hash are one text only if they are; others are worked out alone
        like, same, at = short[where][inverse], length[short] == length[short[where][inverse]], np.flatnonzero(where[inverse] != np.arange(len(short)))
        for k in range(_SHORT):
            at = at[length[short[at]] > k]
            if not len(at):
                break
            same[at] &= codes[start[short[at]] + k] == codes[np.minimum(start[like[at]] + k, len(codes) - 1)]
        words = [flat[a : a + n] for a, n in zip(start[short[where]].tolist(), length[short[where]].tolist(), strict=True)]
        long = np.concatenate([np.flatnonzero(length > _SHORT), short[~same]])
        alone = [self._written(flat[a : a + n]) for a, n in zip(start[long].tolist(), length[long].tolist(), strict=True)]
        found = [self.arcs.written(words[k : k + _TOGETHER]) for k in range(0, len(words), _TOGETHER)]
        ids = np.concatenate([*(f[0] for f in found), *(np.array(x, np.int64) for x in alone)] or [np.zeros(0, np.int64)])
        counts = np.concatenate([*(f[1] for f in found), np.array([len(x) for x in alone], np.int64)])
        which = np.zeros(len(start), np.int64)
        which[short], which[long] = inverse, len(words) + np.arange(len(long))
        begins, own = np.cumsum(counts) - counts, counts[which]
        ends = np.cumsum(own)
        every = ids[np.repeat(begins[which] - (ends - own), own) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return every, np.append(0, ends)[np.searchsorted(start, first)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: marks become spaces, bytes join to characters (one U+FFFD for each that doesn't), the dummy prefix goes."""
        ids = list(ids)
        data = b"".join(map(self.sounds.__getitem__, ids))
        first = next((i for i in ids if self.sounds[i]), None)
        if self.model.dummy_prefix and first is not None and self.model.pieces[first][0].startswith(MARK):
            data = data[1:]
        return data.decode("utf-8", "sp_bytes")


def _encode_batches(model):
    """A task compiles the model for itself: workers that wait for a task hold none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Transducer(read_model(model.value))
        spoken, marked = pa.array(t.sounds, pa.binary()), [t.model.dummy_prefix and p.startswith(MARK) for p, *_ in t.model.pieces]
        for part in slices(batches, "__text", _TEXTS):
            bodies = [body or b"" for body in part.column("__text").to_pylist()]
            texts = [body.decode("utf-8", "replace") for body in bodies]
            ids, offsets = t.encode_all(texts)
            ids = ids.astype(np.int32)
            # read back: what the ids say stands one after the other in one buffer
            said = spoken.take(pa.array(ids))
            ends, data = np.frombuffer(said.buffers()[1], np.int32), memoryview(said.buffers()[2] or b"")
            sha, same = [], []
            for body, text, a, b in zip(bodies, texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                back = bytes(data[ends[a] + (a < b and marked[ids[a]]) : ends[b]])
                if back != body:
                    back = back.decode("utf-8", "sp_bytes")
                    same.append(back == text)
                    back = back.encode()
                else:
                    same.append(True)
                sha.append(hashlib.sha256(back).hexdigest())
            lists = pa.ListArray.from_arrays(offsets.astype(np.int32), ids)
            names = [c for c in part.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in names), pa.array(np.diff(offsets)), lists, pa.array(sha, pa.string()), pa.array(same)], [*names, "n_tokens", "ids", "decoded_sha256", "lossless"]
            )
        del t, spoken, marked
        gc.collect()  # its machines refer to each other
        give_back()

    return run


def encode_documents(spark: SparkSession, docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """Every document's doc_id with n_tokens, ids (as the model encodes the whole text), decoded_sha256 (of the ids read back, UTF-8) and
    lossless (the text came back unchanged: always, but for texts that hold the mark U+2581 itself).

    Null and empty texts have no ids. Rows are independent: repeated rows, null ids and very long texts need no care; other columns
    are ignored; an empty table gives an empty table. The model file is broadcast as it is; its size doesn't follow the data.
    """
    with open(model_path, "rb") as f:
        data = f.read()
    rows = docs.select("doc_id", utf8().alias("__text"))
    return rows.mapInArrow(_encode_batches(spark.sparkContext.broadcast(data)), "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string, lossless boolean")
