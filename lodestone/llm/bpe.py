"""Byte-level BPE by the ``tokenizers`` and ``tiktoken`` libraries over Arrow batches.

Where a vocabulary's merge list and the ranks of its tokens provably give the same ids, a text of the usual characters goes
to the rank coder, which merges short words faster than they can be looked up. All others go the following way.

A text is cut before each space or line break that a non-space character follows. The public split pattern leaves the
last character of a run of white space to what follows, so a match always ends there, whatever stands before; the ids of
the parts are the ids of the whole, and a part seen before is looked up instead of encoded. Where more white space
follows, the parts stay together as one run.
"""

from __future__ import annotations

import base64
import contextlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Parts kept per Python worker in each of two generations.
CACHE_PARTS = 350_000
#: Longer parts are encoded each time and never kept.
CACHE_CHARS = 64
#: Words that go to the library in one list.
JOINED_WORDS = 1000
#: Marks that are cut off the end of a word and looked up apart; parts that are empty or begin with white space, beside one line break (fixed values).
HELD = r"^\n?$|^\n?[\x09-\x0d\x1c-\x20\x{85}\pZ]"
TAIL = ".,;:!?%&$#*|"
#: The same with the white space that ends most runs of parts.
RUN_TAIL = TAIL + " \n"
#: The byte-level split pattern without its look-ahead, for texts whose longer runs of white space are cut out; characters whose classes are the same in all versions of Unicode, two characters of white space among them, and where a long text may be cut (fixed values).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
UNUSUAL = r"[^\x00-\x{24f}\x{2010}-\x{2027}\x{20ac}]"
GAP = r"[\t-\r \x{85}\x{a0}]{2}"
GAPS = re.compile("[\t-\r \x85\xa0]{2,}")
CUT = re.compile(r"[ \n](?=\S)")
#: Characters that the rank coder gets at a time.
SPAN_CHARS = 500_000


@lru_cache(maxsize=1)
def byte_table() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def char_of_byte() -> list[str]:
    back = {b: c for c, b in byte_table().items()}
    return [back[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every pair of tokens whose concatenation is a token, by the rank of the result.

    Rank files allow a merge of any neighbours that join to a token, the leftmost first; a merge list has one place per
    pair. Two pairs of one result meet only where they overlap, as x+y and y+z with x+y == y+z; then the pair that
    starts to the left must come first, which is the one whose second part is the border of the result.
    """
    out = []
    for token, rank in ranks.items():
        if len(token) == 1:
            continue
        cuts = [k for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
        n = len(token)
        # a cut that leaves a border at the right goes before its mirror image, which has that border at the left
        first = sorted(cuts, key=lambda k: (0 if 2 * (n - k) < n and token.startswith(token[k:]) else 1, k))
        out += [(rank, i, token[:k], token[k:]) for i, k in enumerate(first)]
    out.sort()
    return [(a, b) for _, _, a, b in out]


def periodic_tokens(ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens of three or more equal blocks that can be split off at either end: the only results for which no order of a merge list equals leftmost-first."""
    out = []
    for t in ranks:
        n = len(t)
        for p in range(1, n // 3 + 1):
            if n % p == 0 and t == t[:p] * (n // p):
                if any(2 * k != n and t[:k] in ranks and t[k:] in ranks and t[: n - k] in ranks and t[n - k :] in ranks for k in range(p, n, p)):
                    out.append(t)
                break
    return out


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Leftmost lowest-rank merging of one piece, for pieces with periodic tokens."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        found = [ranks.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        low = min(found)
        if low == 1 << 60:
            break
        i = found.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def ranks_of(path: str, bare) -> dict[bytes, int] | None:
    """Tokens of a tokenizers JSON file by id, if merging by the rank of the result gives the ids of its merge list; else None.

    Two conditions make them equal: each result has one pair, and ids rise along the list; and each token is what its own
    bytes are merged to. Bytes between two token borders are merged as if they stood alone, so two neighbours that join
    to a token are the listed pair: any other pair would be what the token's bytes had become.
    """
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, split, table = whole["model"], whole["pre_tokenizer"] or {}, byte_table()
    vocab = model.get("vocab") or {}
    plain = model["type"] == "BPE" and whole["normalizer"] is None and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    own = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    if not plain or not own or not all(x["special"] for x in whole["added_tokens"]) or not table.keys() <= vocab.keys():
        return None
    ids = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    merged = [t for t in vocab if len(t) > 1]
    if ids != sorted(set(ids)) or len(ids) != len(merged) or not all(c in table for t in vocab for c in t):
        return None
    if bare.encode_batch_fast([merged], is_pretokenized=True, add_special_tokens=False)[0].ids != [vocab[t] for t in merged]:
        return None
    return {bytes(table[c] for c in t): i for t, i in vocab.items()}


def spans(text: str, gaps: bool) -> Iterator[str]:
    """A text of usual characters in parts that PATTERN splits as the whole pattern splits the text. With ``gaps``, of a run of
    white space all but the last character stand alone, or all of it at the text's end."""
    at = 0
    while at < len(text):
        cut = CUT.search(text, at + SPAN_CHARS) if len(text) - at > SPAN_CHARS else None
        end = cut.start() if cut else len(text)
        for m in GAPS.finditer(text, at, end) if gaps else ():
            stop = m.end() - (m.end() < end)
            yield text[at : m.start()]
            yield text[m.start() : stop]
            at = stop
        yield text[at:end]
        at = end


def trim() -> None:
    """Give freed memory back, where the C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Coder:
    """Encoder and decoder of one vocabulary: a tokenizers JSON file, or a rank file with its split pattern."""

    def __init__(self, path: str, pattern: str | None = None):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        self.ranks: dict[bytes, int] | None = None
        self.periodic = self.by_rank = None
        if path.endswith(".tiktoken"):
            self.ranks = read_ranks(path)
            chars = char_of_byte()
            say = lambda b: "".join(chars[x] for x in b)
            self.inner = Tokenizer(models.BPE(vocab={say(b): i for b, i in self.ranks.items()}, merges=[(say(a), say(b)) for a, b in merges_of(self.ranks)], ignore_merges=True, cache_capacity=0))
            self.inner.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.bytes_of = {i: b for b, i in self.ranks.items()}
            if found := periodic_tokens(self.ranks):
                import regex

                self.pattern = regex.compile(pattern)
                self.periodic = regex.compile(b"|".join(regex.escape(t) for t in sorted(found, key=lambda t: (len(t), t)) if not any(s != t and s in t for s in found)))
        else:
            self.inner = Tokenizer.from_file(path)
            table = byte_table()
            self.bytes_of = {i: bytes(table[c] for c in t) if all(c in table for c in t) else t.encode() for t, i in self.inner.get_vocab().items()}
        self.inner.encode_special_tokens = True
        self.bare = Tokenizer(self.inner.model)
        if self.ranks is None and (ranks := ranks_of(path, self.bare)):
            import tiktoken

            self.by_rank = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.by_id = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.alphabet = {i: c for i, c in enumerate(char_of_byte())}
        self.space = char_of_byte()[32]
        self.newline = array("I", self._raw(["\n"])[0]).tobytes()
        self.break_char = char_of_byte()[10]
        (self.break_id,) = self._raw(["\n"])[0]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.most = CACHE_PARTS

    def release(self) -> None:
        """Drop what is cached and hand the memory back to the system."""
        for kept in (self.young, self.old, self.tails, self.runs):
            kept.clear()
        trim()

    def _raw(self, texts: list[str]) -> list[list[int]]:
        out = [x.ids for x in self.inner.encode_batch_fast(texts, add_special_tokens=False)]
        if self.periodic is not None:
            for i, t in enumerate(texts):
                if self.periodic.search(t.encode()):
                    out[i] = self._pieces(t)
        return out

    def _pieces(self, text: str) -> list[int]:
        ids: list[int] = []
        for m in self.pattern.findall(text):
            b = m.encode()
            ids += encode_piece(b, self.ranks) if self.periodic.search(b) else [i for x in self.inner.encode_batch_fast([m], add_special_tokens=False) for i in x.ids]
        return ids

    def _merge(self, mapped: list[str]) -> list[bytes]:
        """Packed ids of words in the byte-level alphabet, many in one call: before each stands a line break, whose id no word of letters holds."""
        out: list[bytes] = []
        lists = []
        for a in range(0, len(mapped), JOINED_WORDS):
            some = mapped[a : a + JOINED_WORDS]
            lists.append([self.break_char] * (2 * len(some)))
            lists[-1][1::2] = some
        for x in self.bare.encode_batch_fast(lists, is_pretokenized=True, add_special_tokens=False):
            ids = np.array(x.ids, dtype=np.uint32)
            at = (4 * np.flatnonzero(ids == self.break_id)).tolist()
            data = ids.tobytes()
            out += [data[a + 4 : b] for a, b in zip(at, [*at[1:], len(data)])]
        return out

    def _encode_new(self, words: list[str]) -> list[bytes]:
        """Packed ids of words. A word of letters is one match of the split pattern, so its bytes go to the merges as they
        are, written in the byte-level alphabet; other words go through the whole library."""
        out: list[bytes | None] = [None] * len(words)
        plain, mapped, other = [], [], []
        for i, w in enumerate(words):
            body = w[1:] if w[0] == "\n" else w
            if body.isalpha() and (body.isascii() or max(body) < "\u0250"):
                plain.append(i)
                if not body.isascii():
                    body = body.encode().decode("latin-1").translate(self.alphabet)
                mapped.append(body if w[0] == "\n" else self.space + body)
            else:
                other.append(i)
        if self.periodic is not None and plain and self.periodic.search("\n".join(words[i] for i in plain).encode()):
            odd = {i for i in plain if self.periodic.search(words[i].encode())}
            mapped = [m for i, m in zip(plain, mapped) if i not in odd]
            plain = [i for i in plain if i not in odd]
            other += odd
        for i, ids in zip(plain, self._merge(mapped)):
            out[i] = self.newline + ids if words[i][0] == "\n" else ids
        for i, x in zip(other, self._raw([words[i] if words[i][0] == "\n" else " " + words[i] for i in other])):
            out[i] = array("I", x).tobytes()
        return out

    def _tail(self, tail: str) -> bytes:
        if (ids := self.tails.get(tail)) is None:
            if len(self.tails) > self.most:
                self.tails.clear()
            ids = self.tails[tail] = array("I", self._raw([tail])[0]).tobytes()
        return ids

    def _lookup(self, words: list[str]) -> list[bytes]:
        """Packed ids of each distinct word; what no cache has is encoded in one call of the library."""
        if len(self.young) > self.most:  # two generations: what is still in use moves to the young one
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        found = list(map(young.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if old and missing:
            for i in missing:
                if (ids := old.get(words[i])) is not None:
                    young[words[i]] = found[i] = ids
            missing = [i for i in missing if found[i] is None]
        bodies, new = [], {}
        for i in missing:
            w = words[i]
            body = w.rstrip(TAIL)
            # a letter that a punctuation mark follows always ends a match of the split pattern
            if not body or not ("a" <= body[-1] <= "z" or "A" <= body[-1] <= "Z"):
                body = w
            bodies.append(body)
            if body not in young and body not in new:
                new[body] = None
        for w, ids in zip(new, self._encode_new(list(new))):
            new[w] = ids
            if len(w) <= CACHE_CHARS:
                young[w] = ids
        for i, body in zip(missing, bodies):
            w = words[i]
            found[i] = ids = (new.get(body) or young[body]) + (self._tail(w[len(body) :]) if len(body) != len(w) else b"")
            if len(w) <= CACHE_CHARS:
                young[w] = ids
        return found

    def _lookup_runs(self, runs: list[str]) -> list[bytes]:
        """Packed ids of each distinct run of parts; a leading line break is an id of its own. A run that is one word, then marks
        and white space, is the word's ids and theirs, as a letter before them always ends a match of the split pattern."""
        if len(self.runs) > self.most:
            self.runs.clear()
        found = list(map(self.runs.get, runs))
        missing = [i for i, ids in enumerate(found) if ids is None]
        alone, bodies, whole = [], [], []
        for i in missing:
            body = runs[i].rstrip(RUN_TAIL)
            core = body[1:] if body[:1] == "\n" else body
            if core.split() == [core] and ("a" <= core[-1] <= "z" or "A" <= core[-1] <= "Z"):
                alone.append(i)
                bodies.append(body)
            else:
                whole.append(i)
        names = list(dict.fromkeys(bodies))
        ids_of = dict(zip(names, self._lookup(names)))
        for i, body in zip(alone, bodies):
            found[i] = ids_of[body] + self._tail(runs[i][len(body) :])
        for i, x in zip(whole, self._raw([runs[i][1:] if runs[i][0] == "\n" else " " + runs[i] for i in whole])):
            found[i] = (self.newline if runs[i][0] == "\n" else b"") + array("I", x).tobytes()
        for i in missing:
            if len(runs[i]) <= CACHE_CHARS:
                self.runs[runs[i]] = found[i]
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.by_rank is None:
            return self._encode_parts(texts)
        column = pa.array(texts, pa.large_string())
        unusual, gaps = (pc.match_substring_regex(column, x).to_pylist() for x in (UNUSUAL, GAP))
        del column
        others = iter(self._encode_parts([t for t, x in zip(texts, unusual) if x]))
        return [next(others) if x else self._encode_by_rank(t, g) for t, x, g in zip(texts, unusual, gaps)]

    def _encode_by_rank(self, text: str, gaps: bool) -> np.ndarray:
        ids = array("I")
        for s in spans(text, gaps):
            ids.extend(array("I", self.by_rank.encode_ordinary(s)))
        return np.frombuffer(ids, dtype=np.uint32)

    def _encode_parts(self, texts: list[str]) -> list[np.ndarray]:
        """The same by the parts of texts, each looked up or given to the library."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return []
        lines = pc.replace_substring(pa.array(["\n" + t for t in texts], pa.large_string()), "\n", " \n")
        parts = pc.split_pattern(pc.utf8_slice_codeunits(lines, 1), " ")
        del lines
        coded = parts.values.dictionary_encode() if isinstance(parts, pa.LargeListArray) else parts.flatten().dictionary_encode()
        ends = parts.offsets.to_numpy(zero_copy_only=False)
        ends = ends - ends[0]
        del parts
        words = coded.dictionary.to_pylist()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        held = pc.match_substring_regex(coded.dictionary, HELD).to_numpy(zero_copy_only=False).astype(bool)
        joined = held[index]
        first = np.zeros(len(index), dtype=bool)
        first[ends[:-1]] = True
        # runs: a part with the held ones after it; a text's first part always begins one
        begins = np.flatnonzero(~joined | first)
        stops = np.append(begins[1:], len(index))
        runs: dict[str, int] = {}
        blank = len(words)
        use = index.copy()
        use[joined] = blank
        for s, e in zip(*(x[(stops - begins > 1) | joined[begins]].tolist() for x in (begins, stops))):
            at = index[s:e].tolist()
            run = words[at[0]] + "".join(w if w[:1] == "\n" else " " + w for w in map(words.__getitem__, at[1:]))
            use[s] = runs.setdefault(run, blank + 1 + len(runs))
        packed = [b""] * blank
        good = np.flatnonzero(np.bincount(use, minlength=blank)[:blank]).tolist()
        for i, ids in zip(good, self._lookup([words[i] for i in good])):
            packed[i] = ids
        packed.append(b"")
        packed += self._lookup_runs(list(runs))
        sizes = np.fromiter(map(len, packed), dtype=np.int32, count=len(packed)) // 4
        place = np.cumsum(sizes, dtype=np.int32) - sizes
        pool = np.frombuffer(b"".join(packed), dtype="<u4")
        del packed, words, coded
        count = sizes[use]
        upto = np.zeros(len(use) + 1, dtype=np.int32)  # a chunk has far fewer ids than 2**31
        np.cumsum(count, out=upto[1:])
        from_ = np.repeat(place[use] - upto[:-1], count)
        at = upto[ends]
        del use, upto, count
        from_ += np.arange(len(from_), dtype=np.int32)
        ids = pool[from_]
        return [ids[a + 1 : b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]  # less the line break put before each text

    def decode(self, ids) -> bytes:
        """The bytes of the ids; characters split between tokens come together again."""
        return b"".join(map(self.by_id.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))

    def starts(self, ids: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Byte and code-point offset at which each id starts; a token inside a character has that character's offset."""
        sizes = np.fromiter((len(self.bytes_of[i]) for i in ids.tolist()), dtype=np.int64, count=len(ids))
        at = np.cumsum(sizes) - sizes
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return at, char[at] if len(raw) else at


@lru_cache(maxsize=4)
def coder(path: str, pattern: str | None = None) -> Coder:
    """One coder per Python worker and vocabulary; it is built on first use and kept between tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Coder(path, pattern)
