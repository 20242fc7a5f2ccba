"""Compiled automata of a tokenizer with a split pattern of words, single digits and runs of marks, and merges with word ends.

Two deterministic transducers follow each other. The splitter reads classes of characters; its transitions say where
segments begin, also some characters back where a contraction or a literal turned out not to be one. The counter reads the
bytes of a segment, the last one as an end; it is the weighted subset construction of the automaton of correct token
sequences, in which a sequence is correct if each two neighbours are, so exactly one path stays. Its transitions say how
many tokens became certain. Its states are built when text first needs them.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from lodestone.llm.bpe import char_of_byte

#: Positions of a lane of the parallel scan, and steps after which lanes whose entry states have met go on alone.
LANE, MEET = 256, 24
#: States and remembered segments of the counter, per Python worker; beyond, it starts anew.
MOST_STATES, MOST_SEGMENTS = 250_000, 300_000
SPECIAL = 0x110000


class Splitter:
    """Classes of characters, transitions and the segments they begin.

    States: S outside, L in letters, P in a run of marks, C after a segment that is complete, and one state for each proper
    beginning of a literal (a contraction after an apostrophe), which a following character may turn out to break.
    """

    def __init__(self, contractions: list[str]):
        letters = sorted({c for x in contractions for c in x[1:]})
        # classes: space, number, special string, other mark, other letter, then the characters of the literals
        self.classes = ["space", "number", "special", "mark", "letter", "'", *letters]
        self.at = {c: i for i, c in enumerate(self.classes)}
        self.plain = {ord(c): self.at[c] for c in ["'", *letters]}
        beginnings = sorted({x[:i] for x in contractions for i in range(1, len(x))})
        self.states = ["S", "L", "P", "C", *beginnings]
        number = {s: i for i, s in enumerate(self.states)}
        n, m = len(self.states), len(self.classes)
        self.next = np.zeros((n, 2 * m), dtype=np.uint8)
        self.begins = np.zeros((n, 2 * m), dtype=bool)  # a segment begins at the character read
        self.back = np.zeros((n, 2 * m), dtype=np.uint8)  # one began so many characters before it

        def fresh(c: str) -> tuple[str, bool]:
            return {"space": "S", "number": "C", "special": "C", "mark": "P", "'": "'"}.get(c, "L"), True

        for s in self.states:
            for c in self.classes:
                letter = c == "letter" or c in letters
                back = 0
                if s in ("S", "C"):
                    to, begins = fresh(c)
                elif s == "L":
                    to, begins = ("L", False) if letter else fresh(c)
                elif s == "P":
                    to, begins = ("P", False) if c in ("mark", "'") else fresh(c)
                else:  # a beginning of a contraction
                    longer = s + c
                    if longer in contractions:
                        to, begins = "C", False
                    elif longer in number:
                        to, begins = longer, False
                    elif len(s) == 1:  # the apostrophe is a mark by itself
                        to, begins = ("P", False) if c in ("mark", "'") else fresh(c)
                    else:  # its letters are a word of their own
                        back = len(s) - 1
                        to, begins = ("L", False) if letter else fresh(c)
                i, j = number[s], self.at[c]
                self.next[i, j], self.begins[i, j], self.back[i, j] = number[to], begins, back
                # the first character of a text: whatever was before is over
                to, _ = fresh(c)
                self.next[i, m + j], self.begins[i, m + j], self.back[i, m + j] = number[to], True, max(len(s) - 1, 0) if s[0] == "'" else 0

    def run(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state before each symbol, from S, and the state map of the whole.

        Symbols are cut into lanes. All lanes step at once, each from every state, until its states have met; the lanes' maps
        compose by a prefix scan of doublings, which gives each lane's entry state; a second pass keeps the states.
        """
        n, width = self.next.shape
        count = len(symbols)
        lanes = max(1, -(-count // LANE))
        step = np.zeros(lanes * LANE, dtype=np.uint8)
        step[:count] = symbols
        step = np.ascontiguousarray(step.reshape(lanes, LANE).T).astype(np.uint16)
        flat = self.next.ravel().astype(np.uint16)
        maps = np.tile(np.arange(n, dtype=np.uint16), (lanes, 1))
        for t in range(MEET):
            maps = flat[maps * width + step[t][:, None]]
        met = (maps == maps[:, :1]).all(axis=1)
        one, many = np.flatnonzero(met), np.flatnonzero(~met)
        alone, rest = maps[one, 0], maps[many]
        for t in range(MEET, LANE):
            alone = flat[alone * width + step[t][one]]
            if len(many):
                rest = flat[rest * width + step[t][many][:, None]]
        maps[one], maps[many] = alone[:, None], rest
        shift, upto = 1, maps.copy()
        while shift < lanes:
            both = upto.copy()
            both[shift:] = np.take_along_axis(upto[shift:], upto[:-shift].astype(np.int64), axis=1)
            upto, shift = both, 2 * shift
        state = np.append(np.uint16(0), upto[:-1, 0]).astype(np.uint16)
        out = np.empty((LANE, lanes), dtype=np.uint8)
        for t in range(LANE):
            out[t] = state
            state = flat[state * width + step[t]]
        return out.T.ravel()[:count], upto[-1]

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """Where segments begin. The last symbol should be one that ends what is open."""
        before, _ = self.run(symbols)
        begins = self.begins[before, symbols]
        late = np.flatnonzero(self.back[before, symbols])
        begins[late - self.back[before[late], symbols[late]]] = True
        return begins

    def settled(self, symbols: list[int]) -> int:
        """The first place from which all entry states agree and a segment begins; -1 if there is none."""
        states = set(range(len(self.states)))
        for i, c in enumerate(symbols):
            if len(states) == 1 and self.begins[next(iter(states)), c]:
                return i
            states = {int(self.next[s, c]) for s in states}
        return -1


class Counter:
    """Tokens of a segment, by a transducer over its bytes. A state is a set of (place among the tokens' beginnings, last whole
    token, tokens more than the fewest): the ways in which the bytes read can still become correct tokens."""

    def __init__(self, merges: list[tuple[str, str]], ends: str):
        chars = char_of_byte()
        plain = {c: b for b, c in enumerate(chars)} | {c + ends: 256 + b for b, c in enumerate(chars)}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}  # pair: rank and token made
        self.rank, self.halves = [-1] * 512, [(-1, -1)] * 512
        number = dict(plain)
        self.spelled: list[tuple[int, ...]] = [(i,) for i in range(512)]
        for rank, (a, b) in enumerate(merges):
            x, y = number[a], number[b]
            if (new := number.get(a + b)) is None:
                new = number[a + b] = len(self.spelled)
                self.spelled.append(self.spelled[x] + self.spelled[y])
                self.rank.append(rank)
                self.halves.append((x, y))
            self.merge[x, y] = (rank, new)
        self.child: dict[int, int] = {}  # node * 512 + symbol
        self.token = [-1]
        for t, symbols in enumerate(self.spelled):
            node = 0
            for s in symbols:
                key = node * 512 + s
                if (to := self.child.get(key)) is None:
                    to = self.child[key] = len(self.token)
                    self.token.append(-1)
                node = to
            self.token[node] = t
        self.pairs: dict[int, bool] = {}
        # Where each token has one merge, after those of its halves, merges can be undone instead of made again.
        self.ordered = len(self.merge) == len(self.spelled) - 512 and all(r > max(self.rank[x], self.rank[y]) for r, (x, y) in zip(self.rank[512:], self.halves[512:]))
        self.alone = [True] * 512  # tokens that the merges make of their own symbols
        for r, (x, y) in zip(self.rank[512:], self.halves[512:]):
            self.alone.append(self.ordered and self.alone[x] and self.alone[y] and self.apart(x, y, r))
        self.forget()

    def apart(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge before rank ``limit`` joins the last symbols of ``a`` to the first of ``b``, while both are made. The merges are
        undone, the latest first; of equal ranks the left one is made first."""
        rank, halves, merge = self.rank, self.halves, self.merge
        while True:
            across = merge.get((a, b))
            if across is not None and across[0] < limit:
                return False
            if rank[a] > rank[b]:
                limit = rank[a]
                a = halves[a][1]
            elif rank[b] >= 0:
                limit = rank[b] + 1
                b = halves[b][0]
            else:
                return True

    def forget(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}  # state * 512 + symbol: state after, tokens that became certain
        self.ends: dict[int, int] = {}
        self.known: dict[bytes, int] = {}

    def merged(self, symbols: list[int]) -> list[int]:
        """The merges, lowest rank first, leftmost first."""
        while len(symbols) > 1:
            low, i = min((self.merge.get(p, (1 << 60,))[0], i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if low == 1 << 60:
                break
            symbols[i : i + 2] = [self.merge[symbols[i], symbols[i + 1]][1]]
        return symbols

    def correct(self, a: int, b: int) -> bool:
        """Whether two neighbours (or one token, a < 0) are what the merges make of their symbols."""
        key = (a + 1) << 20 | b
        if (found := self.pairs.get(key)) is None:
            if len(self.pairs) > 4 * MOST_STATES:
                self.pairs.clear()
            if self.ordered:
                found = self.alone[b] and (a < 0 or self.alone[a] and self.apart(a, b, 1 << 60))
            else:
                found = self.merged([*(self.spelled[a] if a >= 0 else ()), *self.spelled[b]]) == ([a, b] if a >= 0 else [b])
            self.pairs[key] = found
        return found

    def extended(self, state: int, symbol: int) -> tuple[list[tuple[int, int, int]], tuple[int, int] | None]:
        """The ways that go on, and the token that ends here with its number of tokens before."""
        ways, whole = [], None
        for node, last, more in self.states[state]:  # longest beginnings come first
            to = self.child.get(node * 512 + symbol)
            if to is not None:
                ways.append((to, last, more))
                if whole is None and (t := self.token[to]) >= 0 and self.correct(last, t):
                    whole = (t, more + 1)
        return ways, whole

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        ways, (token, more) = self.extended(state, symbol)
        ways.append((0, token, more))
        least = min(w[2] for w in ways)
        after = tuple((n, t, m - least) for n, t, m in ways)
        if (to := self.number.get(after)) is None:
            to = self.number[after] = len(self.states)
            self.states.append(after)
        self.moves[state * 512 + symbol] = to, least
        return to, least

    def end(self, state: int, symbol: int) -> int:
        _, (_, more) = self.extended(state, 256 + symbol)
        self.ends[state * 512 + symbol] = more
        return more

    def count(self, segment: bytes) -> int:
        """Tokens of a segment of at least one byte."""
        if (found := self.known.get(segment)) is not None:
            return found
        if len(self.states) > MOST_STATES or len(self.known) > MOST_SEGMENTS:
            self.forget()
        state = total = 0
        moves = self.moves
        for symbol in segment[:-1]:
            if (to := moves.get(state * 512 + symbol)) is None:
                to = self.move(state, symbol)
            state = to[0]
            total += to[1]
        last = state * 512 + segment[-1]
        total += self.ends[last] if last in self.ends else self.end(state, segment[-1])
        if len(segment) <= 64:
            self.known[segment] = total
        return total


class Compiled:
    """The library's normaliser, classes and merges of one vocabulary file, as tables and transducers."""

    # The split pattern that is compiled, and its contractions.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]

    def __init__(self, path: str):
        from tokenizers import Regex, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["pattern"]["Regex"] != self.PATTERN or not split["invert"] or model["continuing_subword_prefix"] or model["ignore_merges"]:
            raise ValueError(f"{path} is not of the form that is compiled here")
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.splitter = Splitter(self.CONTRACTIONS)
        self.counter = Counter([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])
        self.nfc, self.lowercase = normalizers.NFC(), normalizers.Lowercase()
        one = lambda p: pre_tokenizers.Split(Regex(p), "removed")
        self.tests = {"letter": one(r"[\p{L}]"), "number": one(r"[\p{N}]"), "space": one(r"\s")}
        size = SPECIAL + 1
        self.odd = np.full(size, 2, dtype=np.uint8)  # 0 composes with nothing and has one lower-case character, 1 does not, 2 not looked at
        self.lower = np.arange(size, dtype=np.uint32)
        self.kind = np.zeros(size, dtype=np.uint8)
        self.odd[SPECIAL], self.kind[SPECIAL] = 0, self.splitter.at["special"]

    def look(self, points: np.ndarray) -> None:
        """Fill the tables for characters that were not met before, by the library itself."""
        for p in points.tolist():
            c = chr(p)
            low = self.lowercase.normalize_str(c)
            jamo = 0x1100 <= p <= 0x11FF or 0xA960 <= p <= 0xA97F or 0xD7B0 <= p <= 0xD7FF
            self.odd[p] = len(low) != 1 or jamo or unicodedata.category(c)[0] in "M" or unicodedata.category(c) == "Cn" or self.nfc.normalize_str(c) != c
            for x in {c, *low}:
                found = next((k for k, t in self.tests.items() if not t.pre_tokenize_str(x)), "mark")
                self.kind[ord(x)] = self.splitter.plain.get(ord(x), self.splitter.at[found])
            self.lower[p] = ord(low) if len(low) == 1 else p

    def meet(self, points: np.ndarray) -> None:
        if len(new := np.unique(points[self.odd[points] == 2])):
            self.look(new)

    def points(self, text: str, normal: bool = False) -> np.ndarray:
        """Code points of a text, its special strings as one each; with ``normal`` composed and lower-cased by the library."""
        parts, at = [], 0
        cuts = []
        if any(s in text for s in self.specials):
            import regex

            cuts = [m.span() for m in regex.finditer("|".join(map(regex.escape, self.specials)), text)]
        for a, b in [*cuts, (len(text), len(text))]:
            part = text[at:a]
            if normal:
                part = self.lowercase.normalize_str(self.nfc.normalize_str(part))
            parts.append(np.frombuffer(part.encode("utf-32-le"), dtype="<u4"))
            if b > a:
                parts.append(np.array([SPECIAL], dtype="<u4"))
            at = b
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lower-cased code points of all texts and the place where each begins, with the end."""
        whole = "".join(texts)
        if any(s in whole for s in self.specials):
            each = [self.points(t) for t in texts]
            points, sizes = np.concatenate(each) if each else np.zeros(0, "<u4"), [len(x) for x in each]
        else:
            points, sizes = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4"), [len(t) for t in texts]
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.meet(points)
        odd = self.odd[points]
        if odd.any():
            rows = np.unique(np.searchsorted(ends, np.flatnonzero(odd), side="right") - 1).tolist()
            each = np.split(points, ends[1:-1])
            for i in rows:
                each[i] = self.points(texts[i], normal=True)
            points = np.concatenate(each)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
            self.meet(points)
            plain = np.ones(len(texts), dtype=bool)
            plain[rows] = False
            keep = np.repeat(~plain, np.diff(ends))  # the library has lower-cased these
            return np.where(keep, points, self.lower[points]), ends
        return self.lower[points], ends

    def segments(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where segments begin, and each one's tokens (none for white space)."""
        if not len(points):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        width = len(self.splitter.classes)
        symbols = np.append(self.kind[points], np.uint8(self.splitter.at["space"]))  # the last one ends the last text
        first = ends[:-1][np.diff(ends) > 0]
        symbols[first] += width
        symbols[-1] += width
        begins = self.splitter.starts(symbols)[:-1]
        starts = np.flatnonzero(begins)
        special = points == SPECIAL
        said = np.where(special, np.uint32(120), points) if special.any() else points
        data = said.astype("<u4").tobytes().decode("utf-32-le").encode()
        sizes = 1 + (said >= 0x80).astype(np.int64) + (said >= 0x800) + (said >= 0x10000)
        at = np.cumsum(sizes) - sizes
        offsets = np.append(at[starts], len(data)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]).dictionary_encode()
        count = self.counter.count
        tokens = np.array([count(w) for w in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        kinds = symbols[starts] % width
        tokens[kinds == self.splitter.at["space"]] = 0
        tokens[kinds == self.splitter.at["special"]] = 1
        return starts, tokens


@lru_cache(maxsize=2)
def compiled(path: str) -> Compiled:
    """One set of tables and transducers per Python worker and file; kept between tasks."""
    return Compiled(path)
