"""Secret scans: fixed patterns, and assignment-aware lexing of source and configuration syntax.

The lexer turns `name = "literal"`, `name: literal`, `"name" => 'a' + "b"` and `name = other_name` into
name-literal pairs, carries constants from the names they were given to the names that use them, and
scores each literal by how sensitive the names are that it reaches and by how random it looks. A separator after
`name: type` counts for the name as well. Blanks, names, literals and concatenations are read to their real end.
Literals may have a prefix (f, r, b, u), three quotes, or be an indented block after `name: |`; the text of an element
`<name>`, and the value beside a `key` or `name` attribute, count as assigned. A name holds what it was last given (a
call or an unknown name clears it); a name that has no value yet takes its first later one. A literal of several
words counts only as a passphrase: under a name that ends in a word for one, and without words of messages.

Defined results: a null text is the empty text and has no spans; rows with a null id stay; repeated rows give
repeated results; other columns are not read. Spans count code points, the end is exclusive. Every text is
scanned whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ids_and_text, sliced, small_batches, strings

#: Fixed values of the query contract: kind, pattern, group that is measured, least length.
BASE_PATTERNS = (
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
KINDS = ("assign", "access", "hex", "literal")

#: Words that make a name sensitive, with their weight.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "private": 0.6, "auth": 0.6, "bearer": 0.8, "signing": 0.5,
    "cred": 0.7, "creds": 0.7, "access": 0.4, "encryption": 0.5, "api": 0.3, "key": 0.5, "pin": 0.4, "cookie": 0.4, "session": 0.4,
}
#: Whole words, and runs of marks, of values that stand for a secret without being one.
_PLACEHOLDER = re.compile(r"(?<![^\W_])(?:changeme|example|placeholder|redacted|your|dummy|sample|none|null|true|false|x{3,})(?![^\W_])|\*{3}|\.{3}|\A\s*[$#%]?\{[^{}]*\}\s*\Z|\A\s*<[^<>]*>\s*\Z", re.I)
#: Last words of names that may hold several words, and words that make such a value a message.
_PASSPHRASE = frozenset("passphrase password passwd pwd secret".split())
_MESSAGE = re.compile(r"\b(?:enter|please|must|invalid|required|incorrect|wrong|forgot|reset|missing|is|are|not|should|cannot|the|for|to)\b|[?!.:]\s*\Z", re.I)
#: A literal of at least this score is reported.
LEAST_SCORE = 1.2

SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"
# for the text backwards: a quoted or a bare name that ends at a separator
_NAME_BEFORE = re.compile(r"\s*+(?:[\"'`]([\w.\- ]*+)[\"'`]|([\w.\-]*+\$?))", re.A)
_NOT_FIRST = re.compile(r"[^A-Za-z_$]*")
_TYPE = re.compile(r"[ \t]*+(?=[^\n]*?[A-Za-z])[\w \t.,&*?!|<>()\[\]']++", re.A)
_SEPARATOR = re.compile(r":=|=>|[:=]")
_QUOTED = re.compile(r"\s*+(?:[A-Za-z]{0,2}(?:\"\"\"(.*?)\"\"\"|'''(.*?)'''|\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)')|`([^`\n]*+)`)", re.S)
_BLOCK = re.compile(r"[ \t]*+[|>][-+0-9]*+[ \t]*+\n")
_LINE = re.compile(r"([ \t]*+)([^\n]*+)(?:\n|\Z)")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]*+)(?:\s[^<>]*+)?>\s*+([^<>]*[^<>\s])\s*+</")
_ATTRIBUTES = re.compile(r"<[A-Za-z_][\w.\-]*+\s[^<>]*?\b(?:key|name)\s*=\s*[\"']([\w.\- ]++)[\"'][^<>]*+>([^<>]*+)")
_VALUE = re.compile(r"\bvalue\s*=\s*(?:\"([^\"<>]++)\"|'([^'<>]++)')")
_BARE = re.compile(r"\s*+([^\s\"'`,;(){}\[\]<>])")
_BARE_END = re.compile(r"[\s\"'`,;(){}\[\]<>]|\Z")
_JOIN = re.compile(r"\s*+[+.]\s*+(?=[\"'`A-Za-z_$])|\s++(?=[\"'])")
_PIECES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w.]*\Z", re.A)


def name_weight(name: str) -> float:
    """How sensitive a name is, from its words: api_key, apiKey and API-KEY count alike."""
    words = [w.lower() for w in _PIECES.findall(name)]
    joined = "".join(words)
    return max([sum(SENSITIVE.get(w, 0.0) for w in dict.fromkeys(words)), *(v for k, v in SENSITIVE.items() if v >= 0.8 and k in joined)], default=0.0)


def _random(bits: float, kinds: int) -> float:
    return min(1.0, bits / 80) * (0.4 + 0.2 * kinds)


def randomness(value: str) -> float:
    """0 to 1: bits of entropy over the whole value, with credit for mixed character classes."""
    n = len(value)
    if n < 6:
        return 0.0
    bits = -sum(v * math.log2(v / n) for v in Counter(value).values())
    return _random(bits, sum(bool(re.search(p, value)) for p in _CLASSES))


_CLASSES = (r"[a-z]", r"[A-Z]", r"\d", r"[^\w\s]")


class Tails:
    """What literal_spans asks of values that end where one bare run ends, from one pass over a long run."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.start, self.end = start, end
        self.score: list[float] = []
        counts: Counter[str] = Counter()
        logs, kinds = 0.0, [False] * 4
        tests = [re.compile(p).match for p in _CLASSES]
        for n, c in enumerate(reversed(text[start:end]), 1):
            v = counts[c] = counts[c] + 1
            if v == 1:
                kinds = [k or bool(t(c)) for k, t in zip(kinds, tests, strict=True)]
            else:
                logs += v * math.log2(v) - (v - 1) * math.log2(v - 1)
            self.score.append(_random(n * math.log2(n) - logs, sum(kinds)) if n >= 6 else 0.0)
        self.placeholder = max((m.start() for m in _PLACEHOLDER.finditer(text, start, end)), default=-1)

    def of(self, start: int) -> float | None:
        """Randomness of the value, None for a placeholder."""
        return None if self.placeholder >= start else self.score[self.end - start - 1]


def base_spans(text: str) -> list[tuple[str, int, int, float]]:
    """Leftmost non-overlapping matches of each base pattern whose measured group is long enough."""
    out = []
    for (kind, _, group, least), pattern in zip(BASE_PATTERNS, _compiled(), strict=True):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((kind, m.start(), m.end(), 1.0))
    return out


def _compiled() -> tuple[re.Pattern, ...]:
    # {n,} in place of a later length test gives the same matches where the class alone decides the end
    return re.compile(BASE_PATTERNS[0][1], re.I | re.A), re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")


class Value:
    """Literals of an assignment (start, end), and the values of the names that it refers to."""

    __slots__ = ("parts", "used")

    def __init__(self, parts: list[tuple[int, int]], used: list[Value]) -> None:
        self.parts, self.used = parts, used

    def literals(self) -> list[tuple[int, int]]:
        """All literals that it reaches, each once, own ones first."""
        out: dict[tuple[int, int], None] = {}
        seen, stack = {id(self)}, [self]
        while stack:
            value = stack.pop()
            out.update(dict.fromkeys(value.parts))
            for u in reversed(value.used):
                if id(u) not in seen:
                    seen.add(id(u))
                    stack.append(u)
        return list(out)


def _mixed(text: str, start: int, end: int) -> bool:
    """Whether a bare word changes between cases and digits too often for a name."""
    return end - start >= 12 and text[end : end + 1] != "(" and 3 * len(_PIECES.findall(text, start, end)) >= end - start and any(c.isdigit() for c in text[start:end])


def block_after(text: str, separator: int, start: int) -> tuple[int, int]:
    """Span of the lines from `start` that are indented more than the line of the separator."""
    line = text.rfind("\n", 0, separator) + 1
    indent = len(text[line:separator]) - len(text[line:separator].lstrip())
    first, last, at = -1, -1, start
    while at < len(text):
        m = _LINE.match(text, at)
        if m.group(2).strip():
            if len(m.group(1)) <= indent:
                break
            first, last = (m.start(2) if first < 0 else first), m.start(2) + len(m.group(2).rstrip())
        at = m.end()
    return first, last


def markup(text: str) -> Iterator[tuple[list[str], list[tuple[int, int]], list[str], bool]]:
    """The same as `assignments` for elements and attributes."""
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            yield [m.group(1)], [m.span(2)], [], False
    if "<" in text and ("key" in text or "name" in text):
        for m in _ATTRIBUTES.finditer(text):
            if v := _VALUE.search(text, m.start(), m.end()):
                yield [m.group(1)], [v.span(v.lastindex)], [], False
            elif m.group(2).strip():
                start = m.start(2) + len(m.group(2)) - len(m.group(2).lstrip())
                yield [m.group(1)], [(start, start + len(m.group(2).strip()))], [], False


def assignments(text: str) -> Iterator[tuple[list[str], list[tuple[int, int]], list[str], bool]]:
    """Names, literal parts (start, end) and referred names of each assignment, and whether names lose what they held; in text order."""
    if "=" not in text and ":" not in text:
        return
    back = text[::-1]
    bare_end = -1
    declared, after = "", -1  # name before the last colon, and the colon's end
    for m in _SEPARATOR.finditer(text):
        found = _NAME_BEFORE.match(back, len(text) - m.start())
        name = (found.group(1) or found.group(2) or "")[::-1]
        if found.group(1) is None:
            name = name[_NOT_FIRST.match(name).end() :]
        elif name[:1].isdigit() or name[:1] in ".- ":
            name = ""
        owners = [name.lstrip("$")] if name else []
        if m.group() in ("=", ":=") and declared and _TYPE.fullmatch(text, after, m.start()):
            owners.append(declared)
        declared, after = (owners[0] if m.group() == ":" and name else ""), m.end()
        if not owners:
            continue
        parts: list[tuple[int, int]] = []
        names: list[str] = []
        at = m.end()
        if m.group() == ":" and (b := _BLOCK.match(text, at)):
            span = block_after(text, m.start(), b.end())
            if span[0] >= 0:
                yield owners, [span], [], True
            continue
        while True:  # parts of one concatenation
            if q := _QUOTED.match(text, at):
                g = q.lastindex
                if g and q.end(g) > q.start(g):
                    parts.append(q.span(g))
                at = q.end()
            elif q := _BARE.match(text, at):
                start = q.start(1)
                if start >= bare_end:  # else within the run that was read last
                    bare_end = _BARE_END.search(text, start).start()
                if _IDENTIFIER.match(text, start, bare_end) and not (not parts and not names and _mixed(text, start, bare_end)):
                    names.append(text[start:bare_end].lstrip("$"))
                elif not parts and not names:
                    parts.append((start, bare_end))
                else:
                    break
                at = bare_end
            else:
                break
            more = _JOIN.match(text, at)
            if not more:
                break
            at = more.end()
        compared = text[m.end() : m.end() + 1] == "=" or text[m.start() - 1 : m.start()] in ("=", "!", "<", ">", "+")
        yield owners, parts, names, m.group() != ":" and not compared


#: Bare values longer than this share one pass with the other values that end there.
LONG = 4096


def _passes(name: str, value: str) -> bool:
    """Whether a value of several words may be a secret under the name."""
    lines = [x.split() for x in value.split("\n") if x.strip()]
    if all(len(x) == 1 for x in lines) or value.lstrip().startswith("-----BEGIN "):
        return True
    words = _PIECES.findall(name)
    return bool(words) and words[-1].lower() in _PASSPHRASE and len(lines) == 1 and len(lines[0]) <= 12 and not _MESSAGE.search(value)


def literal_spans(text: str) -> list[tuple[str, int, int, float]]:
    """Literals that reach a sensitive name, directly or through constants."""
    known: dict[str, Value] = {}
    waiting: dict[str, list[Value]] = {}  # values that use a name before it has one
    sensitive: list[tuple[float, str, Value]] = []
    for owners, parts, names, replaces in chain(assignments(text), markup(text)):
        used = [known[n] for n in names if n in known]
        if not parts and not names and not replaces:
            continue
        if not parts and len(used) == 1 == len(names):
            value = used[0]
        else:
            value = Value(parts, used)
            for n in names:
                if n not in known and n not in owners:
                    waiting.setdefault(n, []).append(value)
        if parts or used or replaces:
            for o in owners:
                known[o] = value
                if parts or used:
                    for w in waiting.pop(o, ()):
                        w.used.append(value)
        weight, name = max((name_weight(o), o) for o in owners)
        if weight >= 0.4:
            sensitive.append((weight, name, value))
    best: dict[tuple[int, int], float] = {}
    tails: Tails | None = None
    for weight, name, value in sensitive:
        spans = value.literals()
        if not spans:
            continue
        if len(spans) == 1 and spans[0][1] - spans[0][0] > LONG and (text[spans[0][0] - 1] not in "\"'`\n >"):
            start, end = spans[0]
            if tails is None or tails.end != end or start < tails.start:
                tails = Tails(text, start, end)
            random = tails.of(start)
        else:
            whole = "".join(text[a:b] for a, b in spans)
            if len(whole) < 6 or not _passes(name, whole):
                continue
            random = None if _PLACEHOLDER.search(whole) else randomness(whole)
        if random is None:
            continue
        score = min(weight, 1.2) + random
        if score >= LEAST_SCORE:
            for span in spans:
                best[span] = max(score, best.get(span, 0.0))
    return [("literal", s, e, score) for (s, e), score in best.items()]


def find_secrets(text: str) -> list[tuple[str, int, int, float]]:
    """All spans: the base ones, and literals that no base span covers; by start, then kind."""
    base = sorted(base_spans(text), key=lambda b: b[1])
    starts, ends = [b[1] for b in base], list(accumulate((b[2] for b in base), max))
    more = [x for x in literal_spans(text) if not (k := bisect_right(starts, x[1])) or ends[k - 1] < x[2]]
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and its spans (kind, start, end, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in sliced(batches, "text"):
            found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_secrets(t)] for t in strings(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return ids_and_text(df, id_col, text_col).mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span of `text_col` replaced by `mark`; a null text stays null.

    A column n_chars, if there, gets the new length of each text that changes.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            old = columns[text_col].to_pylist()
            new = [None if t is None else cover(t, find_secrets(t), mark) for t in old]
            columns[text_col] = pa.array(new, columns[text_col].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([n if a == b else len(b) for a, b, n in zip(old, new, columns["n_chars"].to_pylist(), strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return df.mapInArrow(run, df.schema)


def cover(text: str, spans: list[tuple[str, int, int, float]], mark: str) -> str:
    out, at = [], 0
    for _, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if spans else text


def digest(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
