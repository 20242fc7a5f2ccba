"""Operator 8: secret scans with assignment-aware lexing.

Besides the three base patterns, source and configuration syntax is read into pairs of a name and a value: ``name = v``,
``name: v``, ``name := v``, ``name => v``, ``name: Type = v``, ``"name": v``, ``table["name"] = v``, ``--name=v``,
``#define name v`` and ``<name>v</name>``. A value is a literal, a name bound earlier in the text, or several of these
joined (``+``, ``..``, ``||``, neighbouring strings, over line ends too); a list gives its name to each item; strings may
hold names (``${name}``, ``{name}``). Bound names stand for what they were bound to: a value keeps its length and links to its
parts, never a copy of them, and lengths and counts are numbers of a fixed size, so time and memory are linear in the text
however names are doubled. A literal is scored by its target name, or the name of the section around it, and by how random the whole value looks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.session import table
from lodestone.plans.shared import text_batches

KINDS = ("assign", "access", "hex", "literal")
# The base patterns, the stems of sensitive names with their weights, and placeholders.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
STEMS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "secret": 1.0, "credential": 0.9, "token": 0.9, "apikey": 0.9, "accesskey": 0.9, "privatekey": 1.0, "authkey": 0.8, "signingkey": 0.8, "pwd": 0.7}
PLACEHOLDERS = re.compile(r"(?i)^(x+|\*+|\.+|changeme|example|placeholder|your[-_ ].*|<.*>|none|null|true|false|undefined|test|dummy|redacted|secret|password|token)$")
NAME = r"[A-Za-z_][A-Za-z0-9_.-]*+"
PAIR = re.compile(rf"""(?:["'](?P<key>{NAME})["'][ \t]*+\]?|\#define[ \t]++(?P<macro>{NAME})(?=[ \t])|<(?P<tag>{NAME})>|(?<![\w.-])-{{0,2}}(?P<name>{NAME}))(?(macro)|(?(tag)|[ \t]*+(?P<op>:=|=>|[:=](?![:=/]))))(?(op)(?:(?<=:)[ \t]*+[&*]?[A-Za-z_][\w.:<>\[\]|?]*+[ \t]++=(?!=))?)[ \t]*+""")
STRING = r"""(?P<q>["'`])(?P<s>(?:\\.|(?!(?P=q))[^\n\\])*+)(?P=q)"""
PART = re.compile(rf"""[ \t]*+(?:{STRING}|(?P<w>[A-Za-z0-9_][A-Za-z0-9+/_.=-]*+)(?![(\[]))""")
OPEN = re.compile(r"[ \t]*+(?:\\?\r?\n[ \t]*+)?[(\[]\s*+")
PLUS = re.compile(r"""[ \t]*+(?:\\?\r?\n[ \t]*+)?(?:\+|\.\.|\|\|)[ \t]*+(?:\\?\r?\n[ \t]*+)?|(?<=["'`])[ \t]*+(?:\\?\r?\n[ \t]*+)?(?=["'`](?!["'`]?[ \t]*[:=]))""")
COMMA = re.compile(r"\s*+,\s*+")
INNER = re.compile(r"\$?\{([A-Za-z_]\w*+)\}|\$([A-Za-z_]\w*+)")
CHAIN = re.compile(r"[A-Za-z_]+(?:\.[A-Za-z_]+)+\.?$")
THRESHOLD = 0.6
#: Weight of a sensitive section's name for the names inside it.
INSIDE = 0.9
HEAD = 64
#: Sizes up to which bytes are counted in whole numbers, and the largest size that is told apart.
EXACT, LARGEST = 2**53, 1e250
HEX_BYTES = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
#: What names hold besides letters; a text without these still has every stem that a name in it has.
JOINTS = dict.fromkeys(map(ord, "_.-0123456789"))


class Value:
    """A bound value: its first characters, last one, length, size in bytes, own spans, and the values it is made of. Counts of bytes
    are made when a sensitive name asks for them, once for each value; they are whole numbers up to EXACT bytes, and floats beyond,
    which never outgrow a fixed size."""

    __slots__ = ("head", "last", "length", "size", "said", "made", "spans", "parts")

    def __init__(self, head: str, last: str, length: float, size: float, said: bytes | None, spans: tuple, parts: tuple):
        self.head, self.last, self.length, self.size, self.said, self.spans, self.parts = head, last, length, size, said, spans, parts
        self.made: dict[int, float] | None = None

    @classmethod
    def literal(cls, text: str, span: tuple[int, int]) -> Value:
        said = text.encode("utf-8", "surrogatepass")
        return cls(text[:HEAD], text[-1:], len(text), len(said), said, (span,), ())

    @classmethod
    def joined(cls, parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        head = parts[0].head
        for p in parts[1:]:
            if len(head) >= HEAD:
                break
            head = (head + p.head)[:HEAD]
        length, size = (min(sum(getattr(p, k) for p in parts), LARGEST) for k in ("length", "size"))
        made = cls(head, next((p.last for p in reversed(parts) if p.last), ""), length, size, None, (), tuple(parts))
        if len(set(map(id, parts))) == 1 and length > EXACT:
            # a long value joined with itself has the shares and the spans that it had
            made.made, made.parts = parts[0].counts, (parts[0],) if parts[0].spans or len(parts[0].parts) != 1 else parts[0].parts
        return made

    @property
    def counts(self) -> dict[int, float]:
        stack = [self]
        while stack:
            v = stack[-1]
            if v.made is None and v.said is not None:
                v.made = dict(Counter(v.said))
            elif v.made is None and (missing := [p for p in v.parts if p.made is None]):
                stack += missing
                continue
            elif v.made is None:
                v.made = v._summed()
            stack.pop()
        return self.made

    def _summed(self) -> dict[int, float]:
        out: dict[int, float] = {}
        for p in self.parts:
            n = sum(p.made.values())
            # beyond EXACT bytes counts are kept as shares of the size
            times = p.size / n if n and self.size > EXACT else 1
            for b, c in p.made.items():
                out[b] = out.get(b, 0) + c * times
        if self.size > EXACT:
            n = sum(out.values())
            out = {b: c / n for b, c in out.items()}
        return out

    def placeholder(self) -> bool:
        if self.length <= HEAD:
            return bool(PLACEHOLDERS.match(self.head))
        alike = len(self.counts) == 1 or set(self.counts) == set(b"xX")
        return alike and self.head[0] in "xX*." or bool(re.match(r"(?i)your[-_ ]", self.head)) or self.head[0] == "<" and self.last == ">"

    def randomness(self) -> float:
        """0 to 1: entropy of the bytes against that of 16 distinct ones, for values of 8 or more characters."""
        if self.length < 8 or self.placeholder():
            return 0.0
        n = sum(self.counts.values())
        entropy = -sum(c / n * math.log2(c / n) for c in self.counts.values() if c / n > 0)
        kinds = {1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 for b in self.counts}
        return min(1.0, entropy / 4) * (1.0 if len(kinds) >= 2 else 0.7)


def sensitivity(name: str) -> float:
    """The largest weight of a stem in the name, whatever its case and separators."""
    plain = re.sub(r"[^a-z]", "", name.lower())
    return max((w for s, w in STEMS.items() if s in plain), default=0.0)


def expression(text: str, at: int, bound: dict[str, Value]) -> tuple[Value | None, int]:
    """The value that starts at ``at`` and the place after it."""
    parts: list[Value] = []
    while part := PART.match(text, at):
        word, end = part["w"], part.end()
        if word is None:
            own, inner = part["s"], []
            if "{" in own or "$" in own:
                inner = [bound[n] for n in (m[1] or m[2] for m in INNER.finditer(own)) if n in bound]
                own = INNER.sub(lambda m: "" if (m[1] or m[2]) in bound else m[0], own)
            parts.append(Value.joined([*([Value.literal(own, part.span("s"))] if own or not inner else []), *inner]))
        else:
            name = word.partition("+")[0]
            if name in bound and name != word:
                word, end = name, part.start("w") + len(name)
            if word in bound:
                parts.append(bound[word])
            elif not parts and not CHAIN.match(word):
                parts.append(Value.literal(word, (part.start("w"), end)))
            else:
                break
        at = end
        if not (plus := PLUS.match(text, at)):
            break
        at = plus.end()
    return (Value.joined(parts) if parts else None), at


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of literals whose value reaches a sensitive name with a score of THRESHOLD or more."""
    bound: dict[str, Value] = {}
    sections: list[tuple[int, float]] = []  # indentation and weight of the sections around a pair
    reached: list[Value] = []
    at = line = 0
    while m := PAIR.search(text, at):
        name = m["key"] or m["macro"] or m["tag"] or m["name"]
        line = max(line, text.rfind("\n", at, m.start()) + 1)
        indent = m.start() - line
        while sections and sections[-1][0] >= indent:
            sections.pop()
        weight = max(sensitivity(name), max((w for _, w in sections), default=0.0) * INSIDE)
        at = m.end()
        listed = None if m["tag"] else OPEN.match(text, at)
        values = []
        if m["tag"]:
            close = text.find("<", at)
            if close >= 0 and text.startswith(f"</{name}>", close) and (inner := text[at:close]).strip():
                values, at = [Value.literal(inner, (at, close))], close
        elif listed:
            at = listed.end()
            while True:
                value, at = expression(text, at, bound)
                if value is None:
                    break
                values.append(value)
                if not (comma := COMMA.match(text, at)):
                    break
                at = comma.end()
        else:
            value, at = expression(text, at, bound)
            values = [] if value is None else [value]
        if values:
            bound[name] = Value.joined(values)
            reached += [v for v in values if weight and weight * v.randomness() >= THRESHOLD]
        elif weight and not m["tag"]:
            sections.append((indent, sensitivity(name) or weight))
    out: set[tuple[int, int]] = set()
    seen: set[int] = set()
    while reached:
        v = reached.pop()
        if id(v) not in seen:
            seen.add(id(v))
            out.update(s for s in v.spans if s[1] > s[0])
            reached += v.parts
    return sorted(out)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans, in order of start and kind."""
    low = text.lower()
    out: list[tuple[int, int, int]] = []
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if b"h" * 32 in text.encode("utf-8", "surrogatepass").translate(HEX_BYTES):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    if ("=" in text or ":" in text or "<" in text or "#" in text) and any(s in plain for plain in (low, low.translate(JOINTS)) for s in STEMS):
        out += [(a, 3, b) for a, b in lexed(text)]
    return sorted(out)


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end in code points, end exclusive) of every row; null counts as the empty text, which has none."""
    text_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": e} for a, k, e in scan(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "spans"])

    return _thin(docs).mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def _thin(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """The digest columns of find_secrets, made in the same pass over the texts."""
    text_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = scan(t)
                base = [s for s in spans if s[1] < 3]
                rows.append((doc, *(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(said(base).encode()).hexdigest(), said(spans)))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return _thin(docs).mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each stretch of secret spans replaced by ``mark``; other columns stay, but for n_chars of a changed text. Null texts stay null."""
    schema = docs.schema
    text_batches(docs.sparkSession)

    def clean(t: str | None) -> str | None:
        if t is None or not (spans := scan(t)):
            return t
        out, at = [], 0
        for a, _, b in spans:
            if a >= at:
                out += [t[at:a], mark]
            at = max(at, b)
        return "".join([*out, t[at:]])

    def run(batches):
        for b in batches:
            i, n = b.schema.get_field_index("text"), b.schema.get_field_index("n_chars")
            old = b.column(i).to_pylist()
            new = [clean(t) for t in old]
            if n >= 0:
                sizes = [c if t == o else len(t) for c, t, o in zip(b.column(n).to_pylist(), new, old)]
                b = b.set_column(n, b.schema.field(n), pa.array(sizes, b.schema.field(n).type))
            yield b.set_column(i, b.schema.field(i), pa.array(new, b.schema.field(i).type))

    return docs.mapInArrow(run, schema)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
