"""Finds and repairs text that was decoded with the wrong character encoding.

A hidden Markov model labels the characters of a text. One state is clean; every pair of an encoding the bytes were in and one they were
read as has a state of its own. A state emits a text with the probability that a character model of clean text gives to the text after
the state's inverse transform, and it can emit only what its encoding pair can have produced. So all emissions come from one model, which
is trained on the collection itself: first on all texts, then again on the characters labelled clean. Viterbi decoding runs on spans: a
span that a pair can have produced is one step, all else between spans is the same in every state.

Most texts are clean, and their runs of characters beyond ASCII recur. So the gains of a run under all pairs are worked out once and kept,
and only a text whose gains add up to what a state costs is decoded; for all others the clean state is known to be the best path.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.plans.workspace import Workspace

# Cost in nats of entering or leaving a state, by how common its kind of mistake is: UTF-8 read as something else, another script read
# as Latin or between two encodings of one script, Latin read as Latin.
SWITCH, SWITCH_SCRIPT, SWITCH_LATIN = 3.5, 8.0, 16.0
_LOST = "�"


def _byte_chars(encoding: str) -> list[str]:
    """The character of each byte; bytes without one are read as the control character of that number, as browsers do."""
    return [bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256)]


@dataclass(frozen=True)
class Pair:
    """Text in the encoding `true` that was read as `read`. read 'latin' stands for cp1252 and latin-1 alike."""

    true: str
    read: str
    times: int = 1

    @property
    def name(self) -> str:
        return f"{self.true} read as {self.read}" + " twice" * (self.times == 2)

    @property
    def cost(self) -> float:
        if self.true == "utf-8":
            return SWITCH if not self.wide_carrier else SWITCH_SCRIPT
        return SWITCH_LATIN if self.true in ("cp1250", "cp1252", "iso8859-2", "cp437", "cp850", "mac-roman") else SWITCH_SCRIPT

    @cached_property
    def to_byte(self) -> dict[str, int]:
        sources = [_byte_chars("cp1252"), _byte_chars("latin-1")] if self.read == "latin" else [_byte_chars(self.read)]
        out: dict[str, int] = {}
        for chars in sources:
            for b in range(255, -1, -1):
                out.setdefault(chars[b], b)
        return {c: b for c, b in out.items() if b < 128 <= ord(c) or b >= 128 or ord(c) == b}

    @cached_property
    def pattern(self) -> re.Pattern:
        """What this pair can have produced, beyond plain ASCII."""
        if self.wide_carrier:
            return re.compile(r"[^\x00-\x7f]{2,}")
        by = lambda lo, hi: "".join(re.escape(c) for c, b in self.to_byte.items() if lo <= b <= hi)
        if self.true == "utf-8":
            cont = by(0x80, 0xBF) + ("?" + _LOST if self.read == "latin" else "")
            return re.compile(f"(?:[{by(0xC2, 0xDF)}][{cont}]|[{by(0xE0, 0xEF)}][{cont}]{{2}}|[{by(0xF0, 0xF4)}][{cont}]{{3}})+")
        if self.true in ("gbk", "big5", "cp932", "euc_jp"):
            lead = by(0x81, 0xFE)
            return re.compile(f"(?:[{lead}][{by(0x40, 0x7E)}{by(0x80, 0xFE)}])+")
        return re.compile(f"[{by(0x80, 0xFF)}]+")

    @property
    def wide_carrier(self) -> bool:
        return self.read in ("gbk", "cp932", "big5")

    def restore(self, s: str, score) -> str | None:
        """The text before the wrong decoding, or None. Bytes lost as a question mark become what score likes best."""
        for _ in range(self.times):
            if s is not None:
                s = self._once(s, score)
        return s

    def _once(self, s: str, score) -> str | None:
        if self.wide_carrier:
            try:
                return s.encode(self.read).decode(self.true)
            except UnicodeError:
                return None
        raw, holes = bytearray(), []
        for c in s:
            b = self.to_byte.get(c)
            if c in ("?", _LOST) and self.true == "utf-8":
                holes.append(len(raw))
                b = 0x81
            if b is None:
                return None
            raw.append(b)
        best = None
        try:
            best = raw.decode(self.true)
        except UnicodeError:
            if self.true != "utf-8" and len(raw) > 2:
                return None
            if not holes:
                return None
        for at in holes:
            options = []
            for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D):
                raw[at] = b
                try:
                    options.append((score(raw.decode(self.true)), b))
                except UnicodeError:
                    continue
            if not options:
                return None
            raw[at] = max(options)[1]
            best = raw.decode(self.true)
        return best


PAIRS = tuple(
    [Pair("utf-8", r) for r in ("latin", "cp1250", "cp1251", "cp1254", "iso8859-15", "iso8859-2", "koi8-r", "cp437", "cp850", "cp866", "mac-roman", "gbk", "cp932")]
    + [Pair("utf-8", "latin", 2)]
    + [Pair(t, "latin") for t in ("cp1251", "koi8-r", "cp866", "iso8859-5", "gbk", "big5", "cp932", "euc_jp", "cp1250", "iso8859-2")]
    + [Pair("koi8-r", "cp1251"), Pair("cp1251", "koi8-r"), Pair("cp866", "cp1251"), Pair("cp1251", "cp866"), Pair("cp1252", "cp437"), Pair("cp1252", "cp850"), Pair("cp437", "latin"), Pair("cp850", "latin"),
       Pair("mac-roman", "latin"), Pair("cp1252", "mac-roman"), Pair("cp1252", "cp1251"), Pair("cp1252", "cp1250"), Pair("cp1250", "cp1251")]
)

_WIDE = re.compile("[぀-ヿ㐀-鿿가-힣豈-﫿＀-￯]")


@cache
def _class(c: str) -> str:
    """The context class of a character: itself, or its kind for ASCII and for the large scripts."""
    o = ord(c)
    if o < 128:
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else " " if c.isspace() else "."
    if o >= 0x3040 and _WIDE.match(c):
        return "K" if o < 0x3100 else "H" if 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00 else "G" if o < 0xE000 else "W"
    return c if o < 0x10000 else "E"


_RUN = re.compile(r"([^\x00-\x7f]+)")
_FRAMED = re.compile(r"(?:[\x00-\x7f])?[^\x00-\x7f]+[\x00-\x7f]?")
_ASCII_CLASSES = bytes(ord(_class(chr(i))) if i < 128 else 0 for i in range(256))


def _counts(texts: Iterable[str]) -> Counter:
    """Counts of class pairs, each at least partly beyond ASCII or a start of such, and of characters."""
    framed: Counter = Counter()
    plain: Counter = Counter()
    for text in texts:
        text = f" {text} "
        framed.update(_FRAMED.findall(text))
        kinds = text.encode("ascii", "ignore").translate(_ASCII_CLASSES)
        for k in b"aA0 .":
            plain[chr(k)] += kinds.count(k)
    out: Counter = Counter()
    for s, n in framed.items():
        cls = [_class(c) for c in s]
        for pair in zip(cls, cls[1:]):
            out[pair] += n
        for c in s:
            if ord(c) > 127:
                out["", c] += n
    for k, n in plain.items():
        if n:
            out[k, "*"] += n
    return out


class CharacterModel:
    """log P(character | character before) as P(class | class before) times P(character | class)."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        pair, self.char, before = {}, {}, Counter()
        members: Counter = Counter()
        kinds: Counter = Counter()
        for a, b, n in rows:
            if a == "":
                self.char[b] = n
                members[_class(b)] += n
                kinds[_class(b)] += 1
            elif b == "*":
                before[a] += n
            else:
                pair[a, b] = n
                if ord(a[0]) > 127 or a in "KHGWE":
                    before[a] += n
        self.pair, self.before, self.members, self.kinds = pair, before, members, kinds
        self.total = sum(before.values()) + 1
        self.known: dict = {}

    def _step(self, a: str, c: str) -> float:
        b = _class(c)
        base = (self.members[b] + 0.05) / self.total if ord(c) > 127 else 0.1
        n = self.before[a]
        p = (self.pair.get((a, b), 0) + 3 * base) / (n + 3) if (ord(c) > 127 or len(a) and (ord(a) > 127 or a in "KHGWE")) else 0.2
        if ord(c) > 127 and b != c:
            p *= (self.char.get(c, 0) + 0.02) / (self.members[b] + 0.02 * 20000)
        return math.log(p)

    def score(self, s: str, left: str = " ", right: str = " ") -> float:
        total, a, known = 0.0, _class(left), self.known
        for c in s + right:
            key = (a, c)
            v = known.get(key)
            if v is None:
                if len(known) > 200_000:
                    known.clear()
                v = known[key] = self._step(a, c)
            total += v
            a = _class(c)
        return total


_PURPOSE = re.compile(r"mojibake|on purpose|decod|encoding|charset|garbl|unicode|U\+[0-9A-F]{4}|escap|looks like|shows? up as|turns? into|appears? as|reads? as|expected", re.I)
_LOST_PURPOSE = re.compile(r"U\+FFFD|replacement character|on purpose", re.I)


def _quoted(line: str, at: int) -> bool:
    """Whether a place of a line stands between quotation or code marks."""
    head, tail = line[:at], line[at:]
    if any(head.count(q) % 2 and q in tail for q in ("`", '"')):
        return True
    return any(head.rfind(a) > head.rfind(b) and b in tail for a, b in (("“", "”"), ("«", "»"), ("「", "」")))


def _on_purpose(text: str, lo: int, hi: int, restored: str | None = None) -> bool:
    """Whether the characters are an example: quoted, in a line that speaks of wrong characters or has the right ones as well. A single
    replacement character is one too where the words beside it name it."""
    start, end = text.rfind("\n", 0, lo) + 1, text.find("\n", hi)
    line = text[start : end if end >= 0 else len(text)]
    if text[lo:hi] == _LOST and _LOST_PURPOSE.search(text[max(start, lo - 60) : hi + 60].split("\n")[0]):
        return True
    if not _quoted(line, lo - start):
        return False
    if _PURPOSE.search(line[max(0, lo - start - 80) : hi - start + 80]):
        return True
    if not restored:
        return False
    mark = r"[^\s`\"«»“”]*"
    return re.search(mark + "$", line[: lo - start]).group() + restored + re.match(mark, line[hi - start :]).group() in line


_LATIN_CARRIED = [k for k, p in enumerate(PAIRS) if p.true in ("gbk", "big5", "cp932", "euc_jp")]  # their trail bytes may be ASCII
_HOLED = [k for k, p in enumerate(PAIRS) if p.true == "utf-8" and p.read == "latin"]  # a question mark may stand for a lost byte
_INSIDE = [k for k in range(len(PAIRS)) if k not in _LATIN_CARRIED]  # what they produce lies within a run beyond ASCII, but for holes
_HOLE = re.compile(r"[^\x00-\x7f]\?")
_KEPT = 100_000


class Decoder:
    """Labels and restores one text at a time."""

    def __init__(self, model: CharacterModel):
        self.model, self.gains = model, {}
        mapped = {c for k in _INSIDE if not PAIRS[k].wide_carrier for c, b in PAIRS[k].to_byte.items() if b > 127}
        self.mapped = re.compile("[" + "".join(map(re.escape, sorted(mapped))) + "]")
        self.carried = re.compile(f"({PAIRS[_LATIN_CARRIED[0]].pattern.pattern})")
        self.wide = [k for k in _INSIDE if PAIRS[k].wide_carrier]
        self.runs: dict[tuple[str, str, str], dict[int, float]] = {}
        self.pieces: dict[tuple[str, str, str], dict[int, float]] = {}

    def _gains_of(self, key: tuple[str, str, str], pairs: list[int]) -> dict[int, float]:
        """By pair the sum of the positive gains of the spans in key's middle, where it is above 0."""
        left, s, right = key
        left, right, got = left or " ", right or " ", {}
        for k in pairs:
            total = 0.0
            for m in PAIRS[k].pattern.finditer(s):
                lo, hi = m.span()
                total += max(0.0, self._gain(k, m.group(), s[lo - 1] if lo else left, s[hi] if hi < len(s) else right)[1])
            if total > 0:
                got[k] = total
        return got

    def promising(self, text: str) -> list[int]:
        """The pairs whose gains in the text are more than entering and leaving their state costs."""
        total: dict[int, float] = {}
        for known, parts, latin in ((self.runs, _RUN.split(text), False), (self.pieces, self.carried.split(text), True)):
            for i in range(1, len(parts), 2):
                key = parts[i - 1][-1:], parts[i], parts[i + 1][:1]
                gains = known.get(key)
                if gains is None:
                    if len(known) > _KEPT:
                        known.clear()
                    pairs = _LATIN_CARRIED if latin else _INSIDE if self.mapped.search(key[1]) else self.wide
                    gains = known[key] = self._gains_of(key, pairs)
                if gains:
                    for k, gain in gains.items():
                        total[k] = total.get(k, 0.0) + gain
        found = {k for k, gain in total.items() if gain > 2 * PAIRS[k].cost}
        if _HOLE.search(text):
            found |= set(_HOLED)
        return sorted(found)

    def spans(self, text: str) -> list[tuple[int, int, int, float, str]]:
        """Labelled spans of one pass: start, end, number of the pair, gain in nats, restored text."""
        found = []
        for k in self.promising(text):
            pair, own = PAIRS[k], []
            for m in pair.pattern.finditer(text):
                lo, hi = m.span()
                restored, gain = self._gain(k, m.group(), text[lo - 1] if lo else " ", text[hi] if hi < len(text) else " ")
                if restored is not None:
                    own.append((lo, hi, k, gain, restored))
            if sum(x[3] for x in own if x[3] > 0) > 2 * pair.cost:
                found += own
        return self._viterbi(text, found) if found else []

    def _gain(self, k: int, s: str, left: str, right: str) -> tuple[str | None, float]:
        key = (k, s, left, right)
        got = self.gains.get(key)
        if got is None:
            score = self.model.score
            restored = PAIRS[k].restore(s, score)
            got = (None, 0.0) if restored is None or restored == s else (restored, score(restored, left, right) - score(s, left, right))
            if len(self.gains) > 200_000:
                self.gains.clear()
            self.gains[key] = got
        return got

    def _viterbi(self, text: str, found: list) -> list:
        """The best sequence of states. Steps are the intervals between the borders of spans; a state other than clean pays for
        characters beyond ASCII that it can't have produced."""
        states = sorted({x[2] for x in found})
        borders = sorted({0, len(text), *(x[0] for x in found), *(x[1] for x in found)})
        place = {b: i for i, b in enumerate(borders)}
        steps = len(borders) - 1
        before = np.concatenate([[0], np.cumsum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) > 127)])
        foreign = np.diff(before[borders]).tolist()
        number = {k: j for j, k in enumerate(states)}
        gains = [[-8.0 * n] * len(states) for n in foreign]
        for lo, hi, k, gain, _ in found:
            j, rate = number[k], gain / (hi - lo)
            for i in range(place[lo], place[hi]):
                gains[i][j] = rate * (borders[i + 1] - borders[i])
        cost = [PAIRS[k].cost for k in states]
        clean, best = 0.0, [-c for c in cost]
        back = []
        every = range(len(states))
        for row in gains:
            leave, top, entered = -math.inf, -1, 0
            for j in every:
                b, c = best[j], cost[j]
                if b - c > leave:
                    leave, top = b - c, j
                if b < clean - c:
                    b = clean - c
                    entered |= 1 << j
                best[j] = b + row[j]
            if clean >= leave:
                top = -1
            else:
                clean = leave
            back.append((top, entered))
        leave, top = max((b - c, -j) for j, (b, c) in enumerate(zip(best, cost)))
        state = -1 if clean >= leave else -top
        labels = [None] * steps
        for i in range(steps - 1, -1, -1):
            labels[i] = None if state < 0 else states[state]
            came, entered = back[i]
            state = came if state < 0 else -1 if entered >> state & 1 else state
        out = []
        for x in found:
            if all(labels[i] == x[2] for i in range(place[x[0]], place[x[1]])):
                out.append(x)
        return sorted(out)

    def __call__(self, text: str) -> tuple[bool, str, bool, list[str]]:
        """Garbled, restored text, whether all of it could be restored, the encoding pairs."""
        names: list[str] = []
        fixed = text
        for _ in range(4):
            if fixed.isascii():
                break
            spans = [x for x in self.spans(fixed) if not _on_purpose(fixed, x[0], x[1], x[4])]
            if not spans:
                break
            names += [n for n in dict.fromkeys(PAIRS[x[2]].name for x in spans) if n not in names]
            out, at = [], 0
            for lo, hi, _, _, restored in spans:
                out += [fixed[at:lo], restored]
                at = hi
            fixed = "".join([*out, fixed[at:]])
        lost = any(not _on_purpose(fixed, m.start(), m.end()) for m in re.finditer(_LOST, fixed)) or bool(_lost_letters(fixed))
        if lost:
            names.append("lost characters")
        return bool(names), fixed, not lost, names


_MARKS = re.compile(r"\?+")


def _lost_letters(text: str) -> list[str]:
    """Words with question marks in the place of letters; at least two such words make a case."""
    if sum(text[m.start() - 1 : m.start()].isalpha() and text[m.end() : m.end() + 1].isalpha() for m in _MARKS.finditer(text)) < 2:
        return []
    words = [w for w in re.findall(r"(?<![\w?/&.=`(])[^\W\d_]+(?:\?{1,3}[^\W\d_]+)+(?![\w?/.=:(`])", text)]
    return words if len(words) > 1 else []


def _entries(counts: Counter) -> pa.RecordBatch:
    rows = [(a, b, n) for (a, b), n in counts.items() if n]
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["a", "b", "n"])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for b in batches:
        total.update(_counts(b.column(0).to_pylist()))
    yield _entries(total)


def _summed(counts: DataFrame) -> Counter:
    """Counts added map-side and by key. There is an entry per pair of character classes that occurs; these and the characters are bounded
    by Unicode, not by the collection."""
    return Counter({(r.a, r.b): r.n for r in counts.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n <> 0").collect()})


def _model(counts: Counter) -> CharacterModel:
    return CharacterModel([(a, b, n) for (a, b), n in counts.items() if n > 0])


def repair_encoding(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each garbled text: the id, restored (the text with what could be restored), complete (nothing was lost) and pairs.

    The second model is that of all texts as the first one repairs them; as only repaired texts change, their counts before are taken off
    and those after added. Other columns are ignored; null, empty and pure ASCII texts are never garbled; repeated rows give repeated
    results. Characters quoted on purpose are left as they are.
    """
    ws = Workspace(documents.sparkSession, "encoding")
    kind = documents.schema[id_col].dataType
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("octet_length(text) <> length(text) or text rlike '[A-Za-z][?]+[A-Za-z]'")
    counts = _summed(texts.select("text").mapInArrow(_count_batches, "a string, b string, n long"))
    first = _model(counts)

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(first)
        total: Counter = Counter()
        for b in batches:
            pairs = [(text, decoder(text)[1]) for text in b.column(0).to_pylist()]
            changed = [(x, y) for x, y in pairs if x != y]
            total.update(_counts(y for _, y in changed))
            total.subtract(_counts(x for x, _ in changed))
        yield _entries(total)

    counts.update(_summed(texts.select("text").mapInArrow(changes, "a string, b string, n long")))
    second = _model(counts)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(second)
        for b in batches:
            results = [decoder(t) for t in b.column(1).to_pylist()]
            bad = [r for r in results if r[0]]
            columns = [pa.array([r[1] for r in bad], pa.string()), pa.array([r[2] for r in bad], pa.bool_()), pa.array([r[3] for r in bad], pa.list_(pa.string()))]
            yield pa.record_batch([b.column(0).filter(pa.array([r[0] for r in results], pa.bool_())), *columns], names=["id", "restored", "complete", "pairs"])

    done = texts.mapInArrow(label, f"id {kind.simpleString()}, restored string, complete boolean, pairs array<string>")
    return ws.write(done, "repaired").withColumnRenamed("id", id_col)
