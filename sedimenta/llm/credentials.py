"""Finds and redacts credentials in source and configuration.

Candidates are literals, bare values of configuration, passwords in URLs and private key blocks. Each is scored by a logistic regression
on the likelihood ratio of two character Markov models (random secrets, other literals), on the identifier it is bound to, on its form and
on the file's path. The training labels are weak: patterns of known key formats and of credential-like names with random values are
positive, placeholders, references, hashes, ids and plain words negative; what no pattern decides is left to the model. Scores are
calibrated on rows held out from the fit.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.source_files import language_of
from sedimenta.plans.workspace import Workspace

SAMPLE = 30_000  # labelled candidates that the regression is fitted on, at most

# Words of identifiers and forms of values.
_CREDENTIAL = re.compile(
    r"pass(?:w(?:or)?d|phrase|code|_?phrase)?(?![a-z])|passw|pwd|(?:^|[_\W])pw(?![a-z])|pass_|secret|token|api[_-]?key|credential|(?:access|private|signing|signature|encryption|encrypt|license|deploy|auth|client|service|account|admin|master|ssh|tls|storage|session|webhook|consumer|shared|root|db|hmac|jwt|crypt\w*|api|app|aes|host|server|user|bot|refresh|bearer|cookie|write|read|vault|backup|smtp|ftp|svc|pat|personal|publish|push|upload|subscription|instance|integration|broker|queue|cache|login|security)[_-]?(?:key|pw|pass|pin|cred|creds|identity)(?![a-z])|ssh[_-]?identity|auth[_-]?header|authorization|bearer|creds?(?![a-z])|login|signer|(?:^|_)pin$|_key$|(?:^|[_.-])auth$",
    re.I,
)
_BENIGN = re.compile(
    r"sha\d*|digest|checksum|integrity|hash|etag|(?:^|[_-])rev(?:ision)?(?![a-z])|commit|fingerprint|uuid|guid|(?:^|[_a-z-])id$|(?:^|[_-])ids?(?![a-z])|Id(?![a-z])|trace|nonce|version|label|field|column|(?:^|_|-)name$|Name$|placeholder|prompt|hint|_ref$|Ref$|_env$|_path$|_file$|Path$|File$|public|cert|thumbprint|serial|build|cursor|schema|title|message|type$|format|policy|header_name|_url_template|example|md5|crc|signature_alg|resolved|cache_key|partition|sort_?key|primary_?key|foreign_?key|key_?column|key_?name|lookup|index|count|limit|expiry|ttl|length|min|max",
    re.I,
)
_FORMAT = re.compile(
    r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_\w{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abprs]-[\w-]{10,}|(?:sk|pk|rk)[_-](?:live|test|prod|proj)[_-]\w{10,}|sk-\w{20,}|AIza[\w-]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|npm_\w{30,}|pypi-\w{16,}|dop_v1_\w{20,}|hv[sb]\.\w{20,}"
    r"|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}|[a-z]{2,10}_(?:pat|sk|tok|token|key|live|test|secret|api)_[A-Za-z0-9]{16,}|[a-z]{2,10}_(?=[A-Za-z0-9]*\d)(?=[A-Za-z0-9]*[A-Z])(?=[A-Za-z0-9]*[a-z])[A-Za-z0-9]{18,}"
)
_PLACEHOLDER = re.compile(
    r"(?:x{3,}|X{3,}|\*{3,}|\.{3,}|_{3,}|-{3,}|#{3,}|0{6,}|(?:1234)\w*|abc123\w*|todo|tbd|fixme|none|null|nil|undefined|true|false|n/?a|redacted|masked|hidden|removed|example|sample|dummy|fake|placeholder|change[-_ ]?me\w*|replace[-_ ]?\w*|insert[-_ ]?\w*|enter[-_ ]?.*|put[-_ ]?your.*|your[-_ ].*|my[-_ ]?(?:secret|password|token|api|key)\w*|some[-_]?(?:secret|password|token|key)\w*|<.*>|\[.*\]|test(?:ing)?|foo|bar|secret|password|passwd|pass|token|key|api[-_]?key|user(?:name)?|login|admin|default|empty)",
    re.I,
)
_REFERENCE = re.compile(
    r"\$\{?[\w.:-]+\}?.*|%\(?\w*\)?[sd]|\{\{?.*\}?\}|<[^>]*>|@@?\w+@?@?|(?:env|vault|ssm|secret|secrets|aws|gcp|sops|op|kms|file|arn|ref|keyring|keychain|param|config|k8s|azure|secretsmanager|keyvault)(?::|://|/)\S*|(?:process\.env|os\.environ|os\.getenv|System\.getenv|secrets|env|vars|config|settings|ENV)[.\[(].*|ENC\[.*|!\w+.*|#\{.*",
    re.I,
)
_UUID = re.compile(r"[\da-f]{8}(?:-[\da-f]{4}){3}-[\da-f]{12}", re.I)
_HEX = re.compile(r"[\da-f]{16,}", re.I)
_HASHED = re.compile(r"data:[\w/+.;=-]+,.*|(?:sha\d+|md5)[-:].*|\$(?:2[aby]|argon2\w*|[156]|pbkdf2\w*|scrypt)\$.*", re.I)
_LETTERS = re.compile(r"[A-Za-z]+(?:[ _./:-][A-Za-z]+)*")
_PUBLIC = re.compile(r"ssh-(?:rsa|ed25519|dss) |ecdsa-sha2|AAAA[BCE]3Nza|MII[A-Z]")

_QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"
_LITERALS = re.compile(rf"(?:{_QUOTED})(?:(?:[ \t]*(?:\+|\.\.)\s*|[ \t]+(?:\\\n[ \t]*)?)(?:{_QUOTED}))*|r#\"[^\"\n]*\"#")
_ONE = re.compile(_QUOTED)
_BINDING = re.compile(r"(?:^|[^\w.-])([A-Za-z_$][\w.$-]*)[\"'`]?\]?\s*(?::\s*[&\w<>\[\]'. |]+?)?\s*(?:=>|:=|==|[:=])\s*(?:[brfu]{0,2}|new\s+\w+\(|String\.from\(|\[\]byte\()?$")
_BARE = re.compile(r"(?im)(?:^|[\s;,({])(?:export\s+)?([A-Za-z_][\w.-]*)[ \t]*(?:=|:[ \t])[ \t]*((?:(?:bearer|basic|token|digest|[\w-]*(?:key|token|auth\w*|secret)[\w-]*:)[ \t]+){1,2})?([^\s\"'`#;,(){}<>|\\][^\s\"'`;,()<>|\\]{4,})(?=[\s;,)]|$)")
_URL_LOGIN = re.compile(r"://([^\s:/@\"'`]*):([^\s/@\"'`]+(?:@[^\s/@\"'`]+)??)@([\w.${}<>\[\]-]+)")
_SCHEME_CHARS = frozenset("+.-_0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SCHEME = re.compile(r"(?:(?:proxy-)?authorization\s*[:=]\s*)?(bearer|basic|token|apikey|digest)\s+(\S{6,})$|([\w-]*(?:key|token|auth|secret|password)[\w-]*)\s*:\s*(\S{6,})$", re.I)
_BLOCK = re.compile(r"-----BEGIN (?:((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)|[A-Z0-9 ]+)-----")
_END = re.compile(r"-----END [A-Z0-9 ]+-----")
_BODY = re.compile(r"(?:\\[nr]|[\s\"'`#*/+,;|>()\\-]|[A-Za-z0-9+/=]{16,}(?!\w)|(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash):[^\n\\]*)*+")
_BASE64_LINE = re.compile(r"[A-Za-z0-9+/=]{16,}")
# in a comment: a word for a credential, then what may be one
_REMARK = re.compile(r"(?im)^[ \t]*(#|//|/?\*|--|<!--|;|>)[^\n]*?\b((?:[\w-]+ )?(?:password|passwd|passphrase|pwd|pw|token|secret|key|login|credentials?|creds|pass)s?)\b(?:[ \t]*(?:is|was|:|=|/|->|-|for \w+|to \w+)[ \t]*|[ \t]+)([^\s\"'`,;()<>{}]{8,})")
_COMMENT_SIGNS = frozenset("#/*-<;>")
_LOGIN = re.compile(r"(?:\s|^)(?:-u|--user|--proxy-user)[ =]$")  # what a command has before a login
_LINE_END = re.compile(r"\n")
_COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|--|<!--|;|>)")


@dataclass
class Candidate:
    start: int
    spans: list[tuple[int, int]]
    name: str
    value: str
    kind: str  # literal, bare, url, header, pem
    comment: bool = False


class _Lines:
    """The lines of a text and where in each a comment begins."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in _LINE_END.finditer(text))]
        self.comments: dict[int, int] = {}

    def start(self, at: int) -> int:
        return self.starts[bisect_right(self.starts, at) - 1]

    def in_comment(self, at: int) -> bool:
        start = self.start(at)
        begins = self.comments.get(start)
        if begins is None:
            end = self.text.find("\n", start)
            end = end if end >= 0 else len(self.text)
            m = _COMMENT.match(self.text, start, end)
            marks = [m.end()] if m else [x + 3 for x in (self.text.find(mark, start, end) for mark in (" # ", " // ")) if x >= 0]
            begins = self.comments[start] = min(marks, default=len(self.text) + 1)
        return begins <= at

    def commented(self) -> list[tuple[int, int]]:
        """The lines that hold a comment."""
        out, at = [], 0
        for line in self.text.split("\n"):
            end = at + len(line)
            if (line.lstrip()[:1] in _COMMENT_SIGNS or " # " in line or " // " in line) and self.in_comment(end):
                out.append((at, end))
            at = end + 1
        return out

    def bound_name(self, at: int, since: int = 0) -> str:
        """The identifier that what stands at a place is bound to. A binding holds no literal but the quoted name itself, so it begins
        no earlier than since, the start of the literal before."""
        head = self.text[max(self.start(at), since) : at].rstrip("\"'`")
        m = _BINDING.search(head)
        if not m:
            return ""
        return "login " * bool(_LOGIN.search(head, 0, m.start(1))) + m.group(1)


def candidates(text: str, language: str | None, path: str = "") -> list[Candidate]:
    """Places of a text that may hold a credential, by start."""
    lines = _Lines(text)
    out: list[Candidate] = []
    taken: list[tuple[int, int]] = []
    pem: list[tuple[int, int]] = []
    for m in _BLOCK.finditer(text) if "-----BEGIN" in text else ():
        end, over = _block_end(text, m.end())
        body = list(_BASE64_LINE.finditer(text, m.end(), end))
        if m.group(1) and sum(len(x.group()) for x in body) >= 32:
            out.append(Candidate(m.start(), [x.span() for x in body], lines.bound_name(m.start()), text[m.end() : end], "pem"))
        pem.append((m.start(), over))
    for lo, m in _url_logins(text):
        out.append(Candidate(lo, [m.span(2)], lines.bound_name(lo), m.group(2), "url", lines.in_comment(lo)))
        taken.append((lo, m.end()))
    last = before = 0
    for m in _LITERALS.finditer(text):
        lo, hi = m.span()
        before, last = last, lo
        if hi - lo < 8:
            continue
        raw = m.group()
        parts = [(lo + x.start() + 1, lo + x.end() - 1) for x in _ONE.finditer(raw)] if raw[0] != "r" else [(lo + 3, hi - 2)]
        value = "".join(text[a:b] for a, b in parts)
        if len(value) < 6 or _inside(taken, lo, hi) or _inside(pem, lo, hi):
            continue
        spaced = " " in value or "\t" in value
        scheme = _SCHEME.search(value) if spaced or ":" in value else None
        if scheme and (scheme.group(2) or scheme.group(4)):
            g = 2 if scheme.group(2) else 4
            a = parts[-1][1] - len(scheme.group(g))
            out.append(Candidate(lo, [(a, parts[-1][1])], lines.bound_name(lo, before) + " " + (scheme.group(1) or scheme.group(3)), scheme.group(g), "header", lines.in_comment(lo)))
        elif not spaced and "{" not in value[:2] + value[-1:]:
            if len(parts) > 1 and not raw.count("+") and len(value) < 16:
                continue
            out.append(Candidate(lo, parts, lines.bound_name(lo, before), value, "literal", lines.in_comment(lo)))
    loose = language not in ("python", "javascript", "typescript", "go", "java", "rust", "json")
    parts = [(0, len(text))] if loose else lines.commented()
    for begin, end in parts:
        for m in _BARE.finditer(text, begin, end):
            lo = m.start(3)
            comment = lines.in_comment(lo)
            if (loose or comment) and not _inside(taken, lo, m.end(3)) and not _inside(pem, lo, m.end(3)):
                name, value = m.group(1), m.group(3)
                inner = re.match(r"([A-Za-z_][\w.-]*)[=:](?=[^=:/])", value)
                if inner and len(value) > inner.end() + 4:
                    name, value, lo = inner.group(1), value[inner.end() :], lo + inner.end()
                if comment:
                    name = " ".join([*re.findall(r"[\w-]+", text[lines.start(m.start(1)) : m.start(1)])[-2:], name])
                kind = "header" if m.group(2) else "bare"
                out.append(Candidate(lo, [(lo, m.end(3))], (name + " " + (m.group(2) or "")).strip(" :\t"), value, kind, comment))
    for m in _REMARK.finditer(text):
        if _words(m.group(3)) or "://" in m.group(3) or not re.search(r"\d|[a-z][A-Z]|[^\w.]", m.group(3)):
            continue
        lo, hi = m.span(3)
        if not _inside(pem, lo, hi) and not _inside(taken, lo, hi) and not _inside([(c.spans[0][0], c.spans[-1][1]) for c in out if c.spans], lo, hi):
            out.append(Candidate(lo, [(lo, hi)], m.group(2), m.group(3), "bare", True))
    low = text.lower()
    headed = ":" in text and (not text.isascii() or any(x in low for x in ("authorization", "api-key", "token", "secret")))
    for m in re.finditer(r"(?i)\b(?:authorization|[\w-]*(?:api-key|token|secret))\s*:\s*(?:(?:bearer|basic|token)\s+)?([\w+/=.~-]{12,})", text) if headed else ():
        lo, hi = m.span(1)
        if not _inside([(c.spans[0][0], c.spans[-1][1]) for c in out if c.spans], lo, hi) and not _inside(pem, lo, hi):
            out.append(Candidate(lo, [(lo, hi)], m.group().split(":")[0], m.group(1), "header", lines.in_comment(lo)))
    return sorted(out, key=lambda c: c.start)


def _url_logins(text: str) -> Iterator[tuple[int, re.Match]]:
    """Start and match of each login in a URL; the scheme is what stands before the colon."""
    at = done = 0
    while (at := text.find("://", at)) >= 0:
        m = _URL_LOGIN.match(text, at)
        lo = at
        while lo > done and (text[lo - 1] in _SCHEME_CHARS or text[lo - 1].isalnum()):
            lo -= 1
        while lo < at and not ("a" <= text[lo] <= "z" or "A" <= text[lo] <= "Z"):
            lo += 1
        if m and lo < at:
            yield lo, m
            at = done = m.end()
        else:
            at += 3


def _block_end(text: str, at: int) -> tuple[int, int]:
    """Where the body of a block that begins at a place ends, and where its END line does. A block without END ends with the last line
    that may belong to it."""
    end, begin = text.find("-----END", at), text.find("-----BEGIN", at)
    if end >= 0 and (begin < 0 or end < begin):
        m = _END.match(text, end)
        return end, m.end() if m else end
    end = _BODY.match(text, at, begin if begin >= 0 else len(text)).end()
    return end, end


def _inside(spans: list[tuple[int, int]], lo: int, hi: int) -> bool:
    return bool(spans) and any(lo < b and a < hi for a, b in spans)


_DAMP = {"literal": 0, "bare": 1, "url": 2, "header": 3, "pem": 4}


def _class(c: str) -> str:
    return "0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c if ord(c) < 128 else "w"


_BEYOND = re.compile(r"[^\x20-\x7e]")


def bigrams(value: str) -> list[str]:
    """The pairs of characters; those beyond printable ASCII count as one."""
    if not value.isascii() or not value.isprintable():
        value = _BEYOND.sub("\x7f", value)
    return [a + b for a, b in zip("^" + value, value)]


class Markov:
    """Log likelihood ratio per character of random secrets against other literals."""

    def __init__(self, counts: list[tuple[int, str, int]]):
        self.table: dict[str, float] = {}
        by = [Counter(), Counter()]
        start = [Counter(), Counter()]
        for label, pair, n in counts:
            by[label][pair] += n
            start[label][pair[0]] += n
        for pair in by[0] | by[1]:
            p = [math.log((by[k][pair] + 0.5) / (start[k][pair[0]] + 40)) for k in (0, 1)]
            self.table[pair] = max(-4.0, min(4.0, p[1] - p[0]))

    def __call__(self, value: str) -> float:
        get = self.table.get
        pairs = bigrams(value)
        return sum([get(p, 0.0) for p in pairs]) / max(1, len(pairs))


def _words(value: str) -> bool:
    """Whether a value is made of words: of letters in pieces of at least three on average."""
    if not _LETTERS.fullmatch(value):
        return False
    pieces = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", value)
    return sum(map(len, pieces)) >= 3 * len(pieces)


def _entropy(value: str) -> float:
    n = len(value)
    return -sum([k / n * math.log2(k / n) for k in Counter(value).values()]) if n else 0.0


def weak_label(c: Candidate) -> int | None:
    """1 a credential, 0 none, None undecided."""
    v, name = c.value, c.name
    if c.kind == "pem":
        return 1
    if _REFERENCE.fullmatch(v) or _PLACEHOLDER.fullmatch(v) or len(set(v)) < 4 or _HASHED.fullmatch(v) or _PUBLIC.match(v):
        return 0
    if _FORMAT.fullmatch(v):
        return 1
    credential, benign = bool(_CREDENTIAL.search(name)), bool(_BENIGN.search(name))
    if c.kind == "url":
        return 1 if re.search(r"\d|[^\w]", v) else None
    if _words(v):
        return 0
    if benign and not credential:
        return 0
    if not credential and (_HEX.fullmatch(v) or _UUID.fullmatch(v) or "/" in v and "." in v or v.startswith(("http", "/", "./", "../", "@"))):
        return 0
    if credential and not benign and len(v) >= 8 and re.search(r"\d", v) and re.search(r"[A-Za-z]", v):
        return 1
    return None if credential or len(v) >= 20 else 0


def _path_kinds(path: str) -> tuple[bool, bool, bool]:
    """Whether a path is one of configuration, of locks, of tests or examples."""
    low = path.lower()
    return ".env" in low or "config" in low or "secret" in low, "lock" in low, "test" in low or "example" in low


def features(c: Candidate, markov: Markov, path: str, language: str | None) -> list[float]:
    v, name = c.value, c.name
    n = len(v)
    formed = bool(_FORMAT.search(v))
    credential, benign = bool(_CREDENTIAL.search(name)), bool(_BENIGN.search(name)) and not formed
    llr = markov(v) if c.kind != "pem" else 1.0
    used = set(v)
    classes = len({_class(x) for x in used if x.isalnum()})
    uuid, hexed = bool(_UUID.fullmatch(v)), bool(_HEX.fullmatch(v))
    return [
        1.0, llr, min(4.0, math.log(n + 1)) - 3, _entropy(v) / 4 - 0.8, float(classes == 3), float(classes == 1), sum(map(str.isdigit, v)) / n,
        float(credential), float(benign), float(credential and not benign), float(credential) * llr, float(not name), float(uuid), float(hexed), float((uuid or hexed) and not credential),
        float(formed), float(bool(_PLACEHOLDER.fullmatch(v))), float(bool(_REFERENCE.fullmatch(v))), float(bool(_HASHED.fullmatch(v) or _PUBLIC.match(v))), float(bool(_words(v))),
        float(len(used) < 4), float("/" in v and c.kind == "literal"), float(v.startswith(("http", "/", ".", "@", "-", "data:"))), float(c.comment),
        *(float(_DAMP[c.kind] == k) for k in range(5)), *map(float, _path_kinds(path)), float(language in ("json", "yaml", "plaintext", None)),
    ]


class Model:
    """Logistic regression by Newton steps with a ridge, calibrated on held-out rows by Platt's scaling. Each row counts with its weight
    in both."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, markov: Markov):
        self.markov = markov
        held = np.arange(len(y)) % 5 == 0
        self.w = self._fit(x[~held], y[~held], weight[~held], 1.0)
        z = np.c_[np.ones(held.sum()), x[held] @ self.w]
        self.scale = self._fit(z, y[held], weight[held], 1.0) if 0 < y[held].sum() < held.sum() else np.array([0.0, 1.0])

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
        w = np.zeros(x.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
            step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return w

    def score(self, c: Candidate, path: str, language: str | None) -> float:
        z = float(np.dot(features(c, self.markov, path, language), self.w))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.scale[0] + self.scale[1] * z))))


CANDIDATES = "chunk_id string, line int, kind string, name string, value string, comment boolean, path string, language string, starts array<int>, ends array<int>, label int"


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for chunk_id, path, text, language, first in b[["chunk_id", "rel_path", "content", "language", "start_line"]].itertuples(index=False):
            line, at = int(first), 0
            for c in candidates(text, language, path or ""):
                line += text.count("\n", at, c.start)
                at = c.start
                rows.append((chunk_id, line, c.kind, c.name, c.value, c.comment, path, language, [x for x, _ in c.spans], [x for _, x in c.spans], weak_label(c)))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in CANDIDATES.split(", ")]).astype({"label": "Int32"})


def extract(chunks: DataFrame) -> DataFrame:
    """The candidates of chunks (chunk_id, rel_path, content, language, start_line), each with its line in the file, the places of its
    parts in the content and its weak label. Null content has none; a null start_line counts as 1; a null language is told by the
    extension, else stays null. A map without shuffle."""
    usable = chunks.where("content is not null").select(
        "chunk_id", "rel_path", "content", F.coalesce("language", language_of(F.col("rel_path"))).alias("language"), F.coalesce("start_line", F.lit(1)).alias("start_line")
    )
    return usable.mapInPandas(_extract, CANDIDATES)


def told_by_other_rows(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """found without the candidates of rows of unknown language whose chunk has another row that tells it. Only these are joined."""
    unknown = found.where("language is null")
    if unknown.isEmpty():
        return found
    told = chunks.where("language is not null and content is not null").select("chunk_id").distinct()
    return found.where("language is not null").unionByName(unknown.join(told, "chunk_id", "left_anti"))


def train(found: DataFrame, sample: int | None = SAMPLE) -> Model:
    """Fits the scorer: character counts over all labelled candidates, the regression on at most sample rows (None: all), half of each
    label, chosen by hash. A row weighs as much as the rows of its label that it stands for, so the rates of the labels, and with them the
    calibration, don't depend on the sample. Executors send counts of an alphabet's pairs and the features of the sample, no values."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("value")), lambda i: F.substring(F.concat(F.lit("^"), F.col("value")), i, F.lit(2)))
    labelled = found.where("label is not null")
    counted = labelled.where("kind <> 'pem' and length(value) > 0").select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").count()
    counted = counted.groupBy("label", F.regexp_replace("pair", "[^ -~]", "\x7f").alias("pair")).agg(F.sum("count").alias("n"))
    markov = Markov([tuple(r) for r in counted.collect()])  # at most 96 x 96 pairs for each label
    amounts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(amounts) < 2:
        return Model(np.zeros((10, len(features(Candidate(0, [], "", "x", "literal"), markov, "", None)))), np.zeros(10), np.ones(10), markov)
    part = F.pmod(F.xxhash64("chunk_id", "line", "value", "name"), F.lit(1_000_000_000))
    share = {label: 1e9 if sample is None else 1e9 * 0.95 * sample / 2 / n for label, n in amounts.items()}
    rows = labelled.withColumn("part", part).where(" or ".join(f"(label = {label} and part < {s})" for label, s in share.items()))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [
                np.array(features(Candidate(0, [], name, value, kind, comment), markov, path or "", language), "float32").tobytes()
                for name, value, kind, comment, path, language in b[["name", "value", "kind", "comment", "path", "language"]].itertuples(index=False)
            ]
            yield pd.DataFrame({"part": b["part"], "label": b["label"], "x": x})

    picked = sorted(map(tuple, rows.mapInPandas(measure, "part long, label int, x binary").collect()))
    y = np.array([label for _, label, _ in picked], float)
    taken = Counter(y.tolist())
    weight = np.array([amounts[int(v)] / taken[v] for v in y.tolist()])
    return Model(np.stack([np.frombuffer(x, "float32") for _, _, x in picked]).astype(float), y, weight, markov)


def redacted(text: str, found: list[Candidate]) -> str:
    """The text with the found credentials replaced; quotes, line ends and everything else stay. The body of a private key keeps its
    form, each of its characters becomes X."""
    out, at = [], 0
    for a, b, pem in sorted({(a, b, c.kind == "pem") for c in found for a, b in c.spans}):
        if a < at:
            continue
        out += [text[at:a], "X" * (b - a) if pem else "REDACTED"]
        at = b
    return "".join([*out, text[at:]])


def scored(found: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The candidates whose calibrated score reaches the threshold, with it."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, float] = {}
        for b in batches:
            scores = []
            for name, value, kind, comment, path, language in b[["name", "value", "kind", "comment", "path", "language"]].itertuples(index=False):
                key = (name, value, kind, comment, _path_kinds(path or ""), language)
                score = known.get(key)
                if score is None:
                    c = Candidate(0, [], name, value, kind, comment)
                    score = model.score(c, path or "", language) if _possible(c) else 0.0
                    if len(known) > 50_000:
                        known.clear()
                    known[key] = score
                scores.append(score)
            yield b.assign(score=scores)[[x >= threshold for x in scores]]

    return found.mapInPandas(go, CANDIDATES + ", score double")


def _possible(c: Candidate) -> bool:
    """What can't be a usable credential whatever its score: references, placeholders and public material."""
    return c.kind == "pem" or not (_REFERENCE.fullmatch(c.value) or _PLACEHOLDER.fullmatch(c.value) or _HASHED.fullmatch(c.value) or _PUBLIC.match(c.value))


def scan(chunks: DataFrame, threshold: float = 0.5, sample: int | None = SAMPLE) -> DataFrame:
    """The credentials of chunks: chunk_id, line, kind, name, starts, ends (places in the content), score. The candidates are written
    once; the scorer is trained on them and applied to them. Repeated rows give repeated results."""
    found = Workspace(chunks.sparkSession, "credentials").write(extract(chunks), "candidates")
    found = told_by_other_rows(found, chunks)
    return scored(found, train(found, sample), threshold).select("chunk_id", "line", "kind", "name", "starts", "ends", "score")


def redact(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """chunk_id, redacted of the chunks that hold a credential of found (scan of the same chunks, one row per chunk_id)."""
    spots = found.groupBy("chunk_id").agg(F.collect_set(F.struct("kind", "starts", "ends")).alias("spots"))

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [
                redacted(text, [Candidate(0, list(zip(s["starts"], s["ends"], strict=True)), "", "", s["kind"]) for s in own])
                for text, own in zip(b["content"], b["spots"], strict=True)
            ]
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "redacted": texts})

    return chunks.select("chunk_id", "content").join(spots, "chunk_id").mapInPandas(go, "chunk_id string, redacted string")
