"""SentencePiece encoding and decoding by a max-plus parallel scan.

The model is byte-fallback BPE. A sequence of pieces is a text's encoding exactly if every two
neighbours are compatible, that is if encoding the two joined gives the two back. So encoding
is the best path of a lattice whose edges weigh 0 (compatible) or minus infinity, and a cut in
the text has as states the pieces that cover the character before it, each with its overhang.

Texts of more than `chunk` characters are split. Every chunk yields the max-plus matrix from
the states of its left cut to those of its right cut; the matrices of a text are combined
associatively, which fixes the state at each cut, and each chunk is then backtraced alone.
Within a chunk, no piece spans a word start or a character outside the vocabulary, so the
lattice falls apart there, and the parts are remembered by their text. Short parts that are new in
a batch of texts are merged all at once, by rounds over an array of their symbols.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Remembered pairs, at most, in a worker.
REMEMBERED = 100_000
#: Remembered parts in each of two generations: the older one is forgotten when the newer one is full.
PARTS = 100_000
#: Characters of parts, at most, that are merged many at once.
SHORT = 48
DEAD = -np.inf
#: Symbols: ids of pieces, and from here on code points of characters that are none.
OUTSIDE = 1 << 20
EMPTY = -1
NEVER = np.int32((1 << 31) - 1)
#: Slots of the table of merges, as a power of two, at least; keys are spread over them by this odd factor.
SLOTS, SPREAD = 18, np.uint64(0x9E3779B97F4A7C15)
#: A slot without a key.
FREE = -2


def read_pieces(path: str) -> tuple[dict[str, tuple[int, float]], list[bytes | str]]:
    """Ordinary pieces with id and score, and what each id stands for."""
    import sentencepiece

    if not os.path.exists(path):
        raise FileNotFoundError(f"no SentencePiece model at {path}; encode() and decode() take its path")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    vocabulary, stands = {}, []
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            stands.append(bytes([int(p[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
            stands.append("")
        else:
            vocabulary[p] = (i, m.get_score(i))
            stands.append(p)
    return vocabulary, stands


class Lattice:
    """Encodes escaped text (spaces as SPACE, one put before the text)."""

    def __init__(self, vocabulary: dict[str, tuple[int, float]], stands: list[bytes | str]):
        self.vocabulary, self.stands = vocabulary, stands
        self.longest = max(map(len, vocabulary), default=1)
        self.bytes = {s[0]: i for i, s in enumerate(stands) if isinstance(s, bytes)}
        self.texts = [s.decode("latin1") if isinstance(s, bytes) else s.replace(SPACE, " ") for s in stands]
        #: Ids of bytes that are no character by themselves.
        self.high = {i for b, i in self.bytes.items() if b > 127}
        if any(SPACE in p.lstrip(SPACE) for p in vocabulary):
            raise ValueError("a piece spans a word start")
        self.letters = {c for p in vocabulary for c in p}
        self.numbers = {p: i for p, (i, _) in vocabulary.items()}
        #: The longest piece that begins with these three characters; 2 if there is none.
        self.reach: dict[str, int] = {}
        for p in vocabulary:
            self.reach[p[:3]] = max(len(p), self.reach.get(p[:3], 2))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.joined: dict[int, bool] = {}
        self.parts: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        #: Neighbouring characters of some piece. Others part a text: nothing is merged across them.
        self.inner = {p[i : i + 2] for p in vocabulary for i in range(len(p) - 1)}
        self._number_merges()
        self.breaks = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def merge(self, s: str) -> list[str]:
        """BPE of a short string: the best pair is merged, the leftmost of equals, till none is left."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.vocabulary.get(parts[i] + parts[i + 1])
                if found and (best is None or found[1] > best):
                    best, at = found[1], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _number_merges(self) -> None:
        """A hash table of pairs of symbols that make a piece: its place in the order of merging, times 64, and its id. A symbol is a piece or a character outside."""
        ranks = {score: r for r, score in enumerate(sorted({score for _, score in self.vocabulary.values()}, reverse=True))}
        found = []
        for p, (number, score) in self.vocabulary.items():
            for i in range(1, len(p)):
                a, b = (self.numbers.get(x, ord(x) + OUTSIDE if len(x) == 1 else -1) for x in (p[:i], p[i:]))
                if a >= 0 and b >= 0:
                    found.append((a << 22 | b, ranks[score], number))
        keys, order, made = np.array(found, np.int64).reshape(-1, 3).T
        bits = max(SLOTS, len(keys).bit_length() + 2)
        #: What is left of a key's product is its slot.
        self.shift = np.uint64(64 - bits)
        self.merge_keys = np.full(1 << bits, FREE, np.int64)
        self.merge_ranks, self.merge_ids = np.full(1 << bits, NEVER, np.int32), np.zeros(1 << bits, np.int32)
        slot, left = self._home(keys), np.arange(len(keys))
        while len(left):
            at, first = np.unique(slot[left], return_index=True)
            free = self.merge_keys[at] == FREE
            at, put = at[free], left[first[free]]
            self.merge_keys[at], self.merge_ranks[at], self.merge_ids[at] = keys[put], order[put] << 6, made[put]
            left = np.setdiff1d(left, put)
            slot[left] = slot[left] + 1 & len(self.merge_keys) - 1
        #: The symbol of each code point.
        self.symbols = np.arange(OUTSIDE, OUTSIDE + 0x110000, dtype=np.int32)
        for c in self.numbers:
            if len(c) == 1:
                self.symbols[ord(c)] = self.numbers[c]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        """The slot where a search for these keys begins."""
        return (keys.astype(np.uint64) * SPREAD >> self.shift).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of symbols, their ranks times 64 and what they make; a symbol may be EMPTY."""
        key = a.astype(np.int64) << 22 | b
        slot = self._home(key)
        met = self.merge_keys.take(slot)
        on = np.flatnonzero((met != key) & (met != FREE))
        while len(on):
            slot[on] = at = slot[on] + 1 & len(self.merge_keys) - 1
            met = self.merge_keys.take(at)
            on = on[(met != key[on]) & (met != FREE)]
        return self.merge_ranks.take(slot), self.merge_ids.take(slot)

    def merge_all(self, words: list[str]) -> list[bytes]:
        """Ids of parts of 1 to SHORT characters, as merge() has them: in each round one merge in every part that has any.

        Symbol c of part w is at c * n + w; each part's symbols and an empty one, the last, are linked in a ring.
        """
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        symbols = self.symbols.take(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32))
        wide, row = int(size.max()), np.repeat(np.arange(n), size)
        column = np.repeat(np.arange(wide + 1, dtype=np.int32), n)
        place = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)) * n + row
        s, end = np.full((wide + 1) * n, EMPTY, np.int32), wide * n + np.arange(n)
        s[place] = symbols
        after, before = np.arange(n, (wide + 2) * n), np.arange(-n, wide * n)
        after[(size - 1) * n + np.arange(n)] = end
        before[:n] = end
        rank, made = np.full((wide + 1) * n, NEVER, np.int32), np.zeros((wide + 1) * n, np.int32)
        pair = np.flatnonzero(row[1:] == row[:-1])
        at = place[pair]
        found, made[at] = self._ranks(symbols[pair], symbols[pair + 1])
        rank[at] = found | column.take(at)  # of equals the leftmost is least; NEVER stays
        while True:
            best = rank.reshape(-1, n).min(0)
            which = np.flatnonzero(best != NEVER)
            if not len(which):
                break
            i = (best.take(which) & 63) * np.int64(n) + which
            new, gone, left = made.take(i), after.take(i), before.take(i)
            right = after.take(gone)
            s[i], s[gone], rank[gone] = new, EMPTY, NEVER
            after[i], before[right] = right, i
            at = np.concatenate([left, i])
            found, made[at] = self._ranks(np.concatenate([s.take(left), new]), np.concatenate([new, s.take(right)]))
            rank[at] = found | column.take(at)
        out = np.ascontiguousarray(s.reshape(-1, n).T)
        kept = out != EMPTY
        flat = out[kept]
        outside = (flat >= OUTSIDE).any() and (out >= OUTSIDE).any(1)
        ends, whole = (4 * np.cumsum(kept.sum(1))).tolist(), flat.astype("<i4").tobytes()
        found = [whole[a:b] for a, b in zip([0, *ends], ends)]
        for i in np.flatnonzero(outside).tolist():
            ids = [x for t in out[i][kept[i]].tolist() for x in ([t] if t < OUTSIDE else [self.bytes[b] for b in chr(t - OUTSIDE).encode()])]
            found[i] = np.array(ids, "<i4").tobytes()
        return found

    def learn(self, parts: set[str]) -> None:
        """Remember the short ones of these in the newer generation."""
        if len(self.parts) > PARTS:
            self.older, self.parts = self.parts, {"": b""}
        new = parts.difference(self.parts)
        known = list(self.older.keys() & new)
        self.parts.update(zip(known, map(self.older.__getitem__, known)))
        new.difference_update(known)
        new = sorted((p for p in new if len(p) <= SHORT), key=len)
        for at in range(0, len(new), 4096):
            self.parts.update(zip(new[at : at + 4096], self.merge_all(new[at : at + 4096])))

    def compatible(self, a: str, b: str) -> bool:
        """a may be empty: then, whether b is an encoding at all."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return found

    def ends_at(self, s: str, i: int, low: int = 0) -> Iterator[str]:
        """Pieces, and single characters, of s[low:i] that end at i."""
        for n in range(1, min(self.longest, i - low) + 1):
            t = s[i - n : i]
            if n == 1 or t in self.vocabulary:
                yield t

    def solve(self, s: str) -> tuple[int, ...]:
        """Encoding of a whole part: depth first through the lattice, the longest pieces first.

        A place is left behind for good once no path goes on from it: the pieces that lead to a
        place are the only encoding of what comes before, so it is never reached otherwise.
        """
        n, i, k = len(s), 0, 0
        numbers, pairs, reach = self.numbers, self.joined, self.reach
        path, last, dead = [], -1, set()
        while i < n:
            k = k or min(n - i, reach.get(s[i : i + 3], 2))
            while k:
                t = numbers.get(s[i : i + k])
                if t is None and k == 1:
                    t = ord(s[i]) + (1 << 20)
                if t is not None and i + k not in dead:
                    key = last << 21 | t
                    good = pairs.get(key)
                    if good is None:
                        if len(pairs) > REMEMBERED:
                            pairs.clear()
                        before, this = s[i - path[-1][0] : i] if path else "", s[i : i + k]
                        good = pairs[key] = self.merge(before + this) == ([before, this] if path else [this])
                    if good:
                        break
                k -= 1
            if k:
                path.append((k, t, last))
                i, last, k = i + k, t, 0
            else:
                dead.add(i)
                size, _, last = path.pop()
                i, k = i - size, size - 1
                if not k:  # one character, and none shorter: this place fails as well
                    while not k:
                        dead.add(i)
                        size, _, last = path.pop()
                        i, k = i - size, size - 1
        out = []
        for size, t, _ in path:
            out += [t] if t < 1 << 20 else [self.bytes[b] for b in chr(t - (1 << 20)).encode()]
        return tuple(out)

    def ids(self, pieces: Iterator[str]) -> tuple[int, ...]:
        out = []
        for p in pieces:
            found = self.vocabulary.get(p)
            out += [found[0]] if found else [self.bytes[b] for b in p.encode()]
        return tuple(out)

    def part(self, s: str) -> bytes:
        """Ids of a part as 32-bit numbers."""
        found = self.parts.get(s)
        if found is None:
            found = self.older.get(s)
            if found is None:
                inner = self.inner
                cuts = [i for i in range(1, len(s)) if s[i - 1 : i + 1] not in inner]
                if cuts:
                    found = b"".join([self.part(s[i:j]) for i, j in zip([0, *cuts], [*cuts, len(s)])])
                else:
                    found = np.array(self.solve(s), "<i4").tobytes()
            if len(self.parts) > PARTS:
                self.older, self.parts = self.parts, {"": b""}
            self.parts[s] = found
        return found

    def split(self, s: str) -> list[str]:
        """Parts that no piece spans."""
        out = []
        for word in self.breaks.findall(s):
            out += [word] if self.letters.issuperset(word) else self._known(word)
        return out

    def _known(self, word: str) -> list[str]:
        out, at = [], 0
        for i, c in enumerate(word):
            if c not in self.letters:
                out += [word[at:i], c] if i > at else [c]
                at = i + 1
        return [*out, word[at:]] if at < len(word) else out

    def parts_of(self, text: str) -> list[str]:
        """The parts of a text that isn't empty."""
        if "  " in text or SPACE in text or text[0] == " ":
            return self.split(SPACE + text.replace(" ", SPACE))
        return self._spaced(SPACE + text.replace(" ", " " + SPACE))

    def parts_within(self, s: str) -> list[str]:
        """The parts of escaped text."""
        return self.split(s) if SPACE + SPACE in s else self._spaced(s.replace(SPACE, " " + SPACE))

    def _spaced(self, s: str) -> list[str]:
        """As split(), faster, of escaped text with a space put before each word start; a line break is outside the vocabulary or has its own part."""
        if "\n" in s and "\n" not in self.letters:
            s = s.replace("\n", " \n ")
        return s.split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of texts as 32-bit numbers."""
        cut = [self.parts_of(t) if t else [] for t in texts]
        self.learn(set().union(*cut))
        return [None if t is None else self._joined(parts) for t, parts in zip(texts, cut)]

    def _joined(self, parts: list[str]) -> bytes:
        """Ids of parts, most of which are remembered."""
        try:
            return b"".join(map(self.parts.__getitem__, parts))
        except KeyError:
            return b"".join(map(self.part, parts))

    def decode(self, ids: list[int]) -> str:
        if not self.high.isdisjoint(ids):
            raw = b"".join(s if isinstance(s, bytes) else s.replace(SPACE, " ").encode() for s in map(self.stands.__getitem__, ids))
            text = raw.decode("utf-8", "replace")
        else:
            text = "".join(map(self.texts.__getitem__, ids))
        return text[1:] if text[:1] == " " else text

    # -- cuts and chunks: s has `left` characters of context before the chunk and the rest after it

    def states(self, s: str, cut: int) -> list[tuple[str, int]]:
        """(piece, overhang) for all pieces that cover s[cut - 1]; one empty state at an end of the text."""
        if cut == 0 or cut == len(s):
            return [("", 0)]
        out = []
        for over in range(min(self.longest, len(s) - cut + 1)):
            out += [(t, over) for t in self.ends_at(s, cut + over) if len(t) > over and self.compatible("", t)]
        return out

    def walk(self, s: str, entries: list[tuple[str, int]], left: int, right: int) -> dict[int, dict[str, int]]:
        """For each end position, the last pieces and, as a bit mask, the entries that reach them.

        Only pieces that begin before `right` are taken."""
        alive: dict[int, dict[str, int]] = defaultdict(dict)
        for k, (t, over) in enumerate(entries):
            alive[left + over][t] = alive[left + over].get(t, 0) | 1 << k
        for i in range(left + 1, min(len(s), right + self.longest - 1) + 1):
            for t in self.ends_at(s, i, left):
                if i - len(t) >= right:
                    continue
                mask = 0
                for before, m in alive[i - len(t)].items():
                    if self.compatible(before, t):
                        mask |= m
                if mask:
                    alive[i][t] = alive[i].get(t, 0) | mask
        return alive

    def middle(self, s: str, left: int, right: int) -> tuple[int, int] | None:
        """First and last place strictly within the chunk where no piece spans."""
        letters = self.letters

        def spot(i: int) -> bool:
            return s[i] == SPACE != s[i - 1] or s[i] not in letters or s[i - 1] not in letters

        first = next(filter(spot, range(left + 1, right)), None)
        return None if first is None else (first, next(filter(spot, range(right - 1, left, -1))))

    def matrix(self, s: str, left: int, right: int) -> np.ndarray:
        """Max-plus matrix from the states at `left` to those at `right`."""
        a, b = self.states(s, left), self.states(s, right)
        out = np.full((len(a), len(b)), DEAD)
        spots = self.middle(s, left, right)
        if spots is None:
            alive = self.walk(s, a, left, right)
            for j, (t, over) in enumerate(b):
                mask = alive[right + over].get(t, 0) if t else self._any(alive[right])
                out[[k for k in range(len(a)) if mask >> k & 1], j] = 0
            return out
        head = self._any(self.walk(s, a, left, spots[0])[spots[0]])
        tail = self.walk(s, [("", 0)], spots[1], right)
        for j, (t, over) in enumerate(b):
            if (t and t in tail[right + over]) or (not t and tail[right]):
                out[[k for k in range(len(a)) if head >> k & 1], j] = 0
        return out

    @staticmethod
    def _any(at: dict[str, int]) -> int:
        mask = 0
        for m in at.values():
            mask |= m
        return mask

    def backtrace(self, s: str, left: int, right: int, entry: int, exit: int) -> bytes:
        """Ids, as 32-bit numbers, of the pieces that begin within the chunk, given the states at both cuts."""
        a, b = self.states(s, left)[entry], self.states(s, right)[exit]
        spots = self.middle(s, left, right)
        end = right + b[1]
        if spots is None:
            return np.array(self.ids(self._back(s, [a], left, right, end, b[0])), "<i4").tobytes()
        head = self._back(s, [a], left, spots[0], spots[0], "")
        tail = self._back(s, [("", 0)], spots[1], right, end, b[0])
        parts = self.parts_within(s[spots[0] : spots[1]])
        self.learn(set(parts))
        head, tail = (np.array(self.ids(x), "<i4").tobytes() for x in (head, tail))
        return head + self._joined(parts) + tail

    def _back(self, s: str, entries: list[tuple[str, int]], left: int, right: int, end: int, last: str) -> list[str]:
        alive = self.walk(s, entries, left, right)
        first = left + entries[0][1]
        if end <= first:
            return []
        if not last:
            last = next(iter(alive[end]))
        out, i = [], end
        while i > first:
            out.append(last)
            i -= len(last)
            if i > first:
                last = next(t for t in alive[i] if self.compatible(t, out[-1]))
            elif i < first:
                raise AssertionError("the entry piece was cut")
        return out[::-1]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1) if a.shape[1] else np.full((a.shape[0], b.shape[1]), DEAD)


def cut_states(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(state at the left cut, state at the right cut) of each chunk on the best path.

    Prefix and suffix products, each by doubling; a state is on the path if both reach it.
    """
    n = len(matrices)

    def prefixes(ms: list[np.ndarray], join) -> list[np.ndarray]:
        out, step = list(ms), 1
        while step < n:
            out = [out[i] if i < step else join(out[i - step], out[i]) for i in range(n)]
            step *= 2
        return out

    ahead = prefixes(matrices, combine)
    behind = prefixes(matrices[::-1], lambda late, early: combine(early, late))[::-1]
    at = [0]
    for i in range(1, n):
        at.append(int((ahead[i - 1].max(0) + behind[i].max(1)).argmax()))
    return [(at[i], at[i + 1] if i + 1 < n else 0) for i in range(n)]


_LATTICES: dict[int, Lattice] = {}


def _lattice(sent) -> Lattice:
    """One for a worker, so that what it remembers serves all its tasks."""
    vocabulary, stands = sent.value
    key = hash(tuple(stands))
    if key not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[key] = Lattice(vocabulary, stands)
    return _LATTICES[key]


def cut(s: str, chunk: int, longest: int) -> Iterator[tuple[int, int, str, int, int]]:
    """(number, of how many, text with context, left, right) of the chunks of an escaped text.

    Cuts are at multiples of chunk; at the ends of the text there is no context.
    """
    n = -(-len(s) // chunk)
    for k in range(n):
        a, b = k * chunk, min(len(s), (k + 1) * chunk)
        low, high = max(0, a - longest), min(len(s), b + longest)
        yield k, n, s[low:high], a - low, b - low


def encode(docs: DataFrame, path: str = MODEL, chunk: int = 1 << 15) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip (whether decoding ids gives the text).

    The ids are those of the model's own BPE encoder. A null text has null ids; an empty one has none.
    A text with U+2581 in it decodes to spaces there, so round_trip is false. Repeated rows and null
    doc_ids stay; texts of any length are encoded whole; other columns are ignored. An empty table gives an empty
    result. path: a byte-fallback BPE model, on the driver's disk alone.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(read_pieces(path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>, n_tokens int, round_trip boolean"
    rows = docs.select("doc_id", "text")
    long = F.length("text") >= chunk

    def lists(found: list[bytes | None]) -> pa.ListArray:
        ends = np.cumsum([0, *(len(x) // 4 if x else 0 for x in found)])
        values = np.frombuffer(b"".join(x for x in found if x), "<i4")
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values), mask=pa.array([x is None for x in found], pa.bool_()))

    def finish(ids: pa.Array, found: list[bytes | None], texts: list[str | None], m: Lattice) -> pa.RecordBatch:
        made = lists(found)
        flat, ends, same = made.values.to_numpy().tolist(), made.offsets.to_pylist(), []
        for start, end, text in zip(ends, ends[1:], texts):
            same.append(None if text is None else m.decode(flat[start:end]) == text)
        return pa.RecordBatch.from_arrays([ids, made, made.value_lengths(), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _lattice(sent)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                texts = b.column(1).to_pylist()
                yield finish(b.column(0), m.encode(texts), texts, m)

    short = rows.where(F.col("text").isNull() | ~long).mapInArrow(small, schema)

    keyed = rows.where(long).withColumns({"k": F.xxhash64("text"), "l": F.xxhash64(F.lit(1), "text")})

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _lattice(sent)
        for batch in batches:
            for k, l, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for row in cut(SPACE + text.replace(" ", SPACE), chunk, m.longest):
                    yield pa.RecordBatch.from_pylist([{"k": k, "l": l, "c": row[0], "n": row[1], "s": row[2], "a": row[3], "b": row[4]}])

    pieces = keyed.select("k", "l", "text").dropDuplicates(["k", "l"]).mapInArrow(chunks, "k bigint, l bigint, c bigint, n bigint, s string, a bigint, b bigint").repartition("k", "l", "c")

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _lattice(sent)
        for batch in batches:
            found = [m.matrix(s, a, b) for s, a, b in zip(*(batch.column(i).to_pylist() for i in (4, 5, 6)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([x.shape[1] for x in found], pa.int64()), pa.array([(x == 0).tobytes() for x in found], pa.binary())], ["k", "l", "c", "w", "m"])

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("c")
        matrices = [np.where(np.frombuffer(x, bool).reshape(-1, w), 0.0, DEAD) for x, w in zip(group.m, group.w)]
        at = cut_states(matrices)
        return pd.DataFrame({"k": group.k, "l": group.l, "c": group.c, "x": [a for a, _ in at], "y": [b for _, b in at]})

    cuts = pieces.mapInArrow(transfer, "k bigint, l bigint, c bigint, w bigint, m binary").groupBy("k", "l").applyInPandas(scan, "k bigint, l bigint, c bigint, x bigint, y bigint")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _lattice(sent)
        for batch in batches:
            ids = [m.backtrace(*row) for row in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 6, 7)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists(ids)], ["k", "l", "c", "ids"])

    traced = pieces.join(cuts, ["k", "l", "c"]).select("k", "l", "c", "s", "a", "b", "x", "y").mapInArrow(trace, "k bigint, l bigint, c bigint, ids array<int>")
    whole = traced.groupBy("k", "l").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("c", "ids"))), lambda x: x["ids"])).alias("ids"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _lattice(sent)
        for batch in batches:
            ids = [x.values.to_numpy().astype("<i4").tobytes() for x in batch.column(2)]
            yield finish(batch.column(0), ids, batch.column(1).to_pylist(), m)

    giant = keyed.join(whole, ["k", "l"]).select("doc_id", "text", "ids").mapInArrow(check, schema)
    return short.unionByName(giant)


def decode(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows of doc_id, ids. Null ids have a null text; bytes that are no UTF-8 become U+FFFD."""
    sent = rows.sparkSession.sparkContext.broadcast(read_pieces(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _lattice(sent)
        for batch in batches:
            texts = [None if x is None else m.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
