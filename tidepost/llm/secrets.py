"""Secrets in texts: fixed patterns, and literals that reach a name that says they are secret.

The fixed patterns find what looks like a secret by itself. The lexer reads assignments of source code and
configuration (``name = "..."``, ``name: ...``, ``"name": "..."``, ``NAME=...``, ``name => '...'``, ``let name: Type = ...``,
``table["name"] = ...``, ``<name>...</name>``, ``name="..."`` in tags and calls, key and value entries, ``--name value``)
as pairs of a name and an expression: literals, references to other names, and both put together by ``+``, ``.``,
interpolation or a call around them. A reference stands for what its name was last given before; so a literal given to a
plain name counts for every name that it reaches. Names are scored by their words, literals by their look, a
literal by the best name it reaches; those of ``THRESHOLD`` or more are spans of kind ``literal``, unless a
fixed pattern covers them already.

Every text is one row's own work, in time linear in its length but for matching; nothing is shuffled.

Defined cases: null and empty texts have no spans; equal texts have equal spans; texts are read whole. Of several
texts under one id each has its row. A literal that is named twice is one span, with its best name. Positions are
code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepost.llm.store import ship

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.5

# The base patterns with the least lengths of what they find.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MIN_ASSIGN, _MIN_ACCESS = 6, 20

# Words of names, and how much each says that the value is secret; the second table says that it is not.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "secrets": 0.9,
             "token": 0.9, "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "accesskey": 0.9, "privatekey": 1.0,
             "secretkey": 1.0, "authkey": 0.9, "auth": 0.6, "authorization": 0.8, "bearer": 0.8, "signature": 0.5, "salt": 0.5,
             "pin": 0.5, "otp": 0.6, "jwt": 0.8, "cookie": 0.5, "webhook": 0.5, "dsn": 0.5}
SENSITIVE_PAIRS = {("api", "key"): 1.0, ("access", "key"): 0.9, ("private", "key"): 1.0, ("secret", "key"): 1.0,
                   ("signing", "key"): 0.9, ("encryption", "key"): 0.9, ("auth", "key"): 0.9, ("master", "key"): 0.9,
                   ("account", "key"): 0.8, ("storage", "key"): 0.8, ("connection", "string"): 0.7, ("pass", "word"): 1.0}
HARMLESS = {"public", "name", "id", "file", "path", "url", "uri", "length", "len", "size", "count", "max", "min", "type", "field",
            "label", "hint", "placeholder", "prompt", "regex", "pattern", "policy", "expires", "expiry", "ttl", "timeout",
            "enabled", "required", "header", "column", "index", "error", "message", "text", "title", "description", "limit",
            "version", "hash", "algorithm", "format", "prefix", "suffix", "number", "tokens", "tokenizer"}
_NO_VALUE = re.compile(
    r"(?:change_?me|replace_?me|todo|fixme|none|null|nil|true|false|undefined|example|sample|dummy|default|test(?:ing)?|"
    r"password|passwd|secret|token|string|value|foo(?:bar)?|redacted|removed|hidden|yes|no|(.)\1*|"
    r"(?:your|my|the|some|enter|insert)[-_ ].*|[<\[{(].*[>\]})]|%.*%|\$.*|\*+.*)\Z", re.I | re.S)

_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
# Names start at words and are taken whole (atomic), so that a long run of letters is read once.
_NAME = r"(?>(?<![A-Za-z0-9_])[$@]?[A-Za-z_][A-Za-z0-9_]*+(?:(?:\.|->|::|-)[A-Za-z_][A-Za-z0-9_]*+){0,8}+)"
# A name, perhaps quoted or an index, perhaps with a type, and the sign that gives it a value.
_STATEMENT = re.compile(
    r"(?P<tag><(?P<tagged>[A-Za-z_][\w.:-]*)>(?P<inner>[^<>\n]+)</(?P=tagged)>)"
    r"|(?P<flag>(?<![\w-])--(?P<flagged>[A-Za-z][\w-]*)[ =](?![-\s]))"
    r"|(?P<url>\b[a-z][a-z0-9+]{1,20}://[^\s/:@\"'<>]*:(?P<in_url>[^\s/@\"'<>]+)@)"
    rf"|(?:\[\s*(?P<q>[\"'])(?P<index>[^\"'\n\]]{{1,200}})(?P=q)\s*\]|(?P<r>[\"'])(?P<quoted>[A-Za-z_][\w .-]{{0,200}})(?P=r)|(?P<plain>{_NAME}))"
    r"(?:[ \t]*:[ \t]*[A-Za-z_][\w.<>\[\]?&' ]{0,60}?(?=[ \t]*=[^=>])|[ \t]+string(?=[ \t]*=))?"
    r"[ \t]*(?P<sign>=>|:=|\?=|\+=|=(?![=~])|:(?![:/]))[ \t]*", re.A)
_STRING = re.compile(
    r"(?:[rRbBuUfF]{1,2}|@|\$)?(?:\"\"\"(?P<a>(?:[^\\]|\\.)*?)\"\"\"|'''(?P<b>(?:[^\\]|\\.)*?)'''"
    r"|\"(?P<c>(?:[^\"\\\n]|\\.)*)\"|'(?P<d>(?:[^'\\\n]|\\.)*)'|`(?P<e>(?:[^`\\]|\\.)*)`)", re.S)
_REFERENCE = re.compile(_NAME, re.A)
_BARE = re.compile(r"[^\s,;#\"'`()\[\]{}<>|&]+")
_CALL = re.compile(r"[ \t]*\(\s*")
_JOIN = re.compile(r"\s*(?:\+|\.\.|\.(?=\s*[\"'$])|,|\|\||\?\?|\\\n)?\s*")
_HOLE = re.compile(r"\$\{(\w+)(?::-[^}]*)?\}|\$(\w+)|#\{(\w+)\}|%\((\w+)\)s|\{(\w+)\}", re.A)
_SCHEME = re.compile(r"(?:Bearer|Basic|Token|bearer|basic|token)\s+(?=\S+\Z)")
# Operands of one expression that are read; longer chains are data, whose literals name nothing.
_OPERANDS = 64


@dataclass(frozen=True)
class Literal:
    start: int
    end: int
    text: str
    quoted: bool
    # What it is judged by: with its neighbours where it is a part of a longer string.
    look: str


def name_words(name: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(name)]


def name_score(name: str) -> float:
    """How far a name says that its value is secret, 0 to 1."""
    words = name_words(name)
    best = max([SENSITIVE.get(w, 0.0) for w in words] + [SENSITIVE_PAIRS.get(p, 0.0) for p in zip(words, words[1:])]
               + [SENSITIVE.get(x + y, 0.0) for x, y in zip(words, words[1:])], default=0.0)
    # What a name is about stands at its end: token_url is an address, url_token a token.
    return best * (0.3 if words and words[-1] in HARMLESS else 1.0)


def literal_score(text: str, quoted: bool) -> float:
    """How far a literal looks like a secret, 0 to 1: long enough, no placeholder, no prose, varied."""
    if len(text) < 6 or len(text) > 4096 or _NO_VALUE.match(text) or any(c.isspace() for c in text):
        return 0.0
    if "://" in text or text.startswith(("/", "./", "../")):
        return 0.2
    counts = Counter(text)
    entropy = -sum(n / len(text) * math.log2(n / len(text)) for n in counts.values())
    classes = (any(c.islower() for c in text) + any(c.isupper() for c in text) + any(c.isdigit() for c in text)
               + any(not c.isalnum() for c in text))
    varied = min(entropy / 3.0, 1.0)
    if not quoted and classes < 3 and not any(c.isdigit() for c in text):
        return 0.3 * varied  # a bare word
    if classes == 1 and not any(c.isdigit() for c in text):
        return 0.65 * varied
    return varied


class _Reader:
    """Assignments of one text, in order, as a graph from names to literals."""

    def __init__(self, text: str):
        self.text = text
        self.literals: list[Literal] = []
        # A node is a list of earlier nodes and of literals (as ~index); scores flow from later nodes to earlier ones.
        self.nodes: list[list[int]] = []
        self.wanted: list[tuple[float, str]] = []
        self.names: dict[str, int] = {}

    def literal(self, start: int, end: int, quoted: bool) -> int:
        scheme = _SCHEME.match(self.text[start:end])
        if scheme:
            start += scheme.end()
        own = self.text[start:end]
        self.literals.append(Literal(start, end, own, quoted, own))
        return ~(len(self.literals) - 1)

    def holes(self, text: str) -> list[int]:
        """What the names inside an interpolated string stand for."""
        found = [next(g for g in m.groups() if g) for m in _HOLE.finditer(text)]
        return [self.names[n.lower()] for n in found if n.lower() in self.names]

    def operand(self, at: int, end: int, bare: bool) -> tuple[int, list[int]] | None:
        """(end, parts) of the operand at ``at``."""
        text = self.text
        string = _STRING.match(text, at, end)
        if string:
            group = string.lastgroup
            start, stop = string.span(group)
            holes = self.holes(string.group(group)) if "{" in string.group(group) or "$" in string.group(group) else []
            return string.end(), holes or [self.literal(start, stop, True)]
        dollar = _HOLE.match(text, at, end)
        if dollar and text[at] == "$":
            name = next(g for g in dollar.groups() if g).lower()
            return dollar.end(), [self.names[name]] if name in self.names else []
        name = _REFERENCE.match(text, at, end)
        if name:
            call = _CALL.match(text, name.end(), end)
            if call:
                return call.end(), []
            key = self.key(name.group())
            if key in self.names and (name.end() >= end or not re.match(r"[\w/+=@!#$%^&*~-]", text[name.end()])):
                return name.end(), [self.names[key]]
        if bare:
            word = _BARE.match(text, at, end)
            if word:
                stop = word.end() - len(word.group()) + len(word.group().rstrip(".:"))
                return word.end(), [self.literal(at, stop, False)] if stop > at else []
        return None

    def expression(self, at: int) -> tuple[int, list[int]]:
        """(end, parts) of the expression at ``at``. Literals put together are judged by the whole."""
        end, parts = self.operands(at)
        if len(parts) > 1 and all(p < 0 for p in parts) and not self.text[at:end].rstrip().endswith(("(", ")")) \
                and "(" not in self.text[at:self.literals[~parts[0]].start]:
            whole = "".join(self.literals[~p].text for p in parts)
            for p in parts:
                self.literals[~p] = replace(self.literals[~p], look=whole)
        return end, parts

    def operands(self, at: int) -> tuple[int, list[int]]:
        """(end, parts) of the operands from ``at`` on; what cannot be read ends them."""
        text, parts, end = self.text, [], len(self.text)
        opened = 0
        for _ in range(_OPERANDS):
            got = self.operand(at, end, not parts)
            if got is None:
                return at, parts
            stop, own = got
            parts += own
            if stop == at:
                return at, parts
            called = text[at:stop].rstrip().endswith("(")
            opened += called
            at = stop
            if called:
                continue
            join = _JOIN.match(text, at, end)
            glue = join.group()
            # Without a joining sign only strings side by side on one line belong together; commas only inside calls.
            if not glue.strip() and ("\n" in glue or join.end() >= end or text[join.end()] not in "\"'"):
                return at, parts
            if glue.strip() == "," and not opened:
                return at, parts
            at = join.end()
        return at, parts

    @staticmethod
    def key(name: str) -> str:
        """The last part of a dotted name: ``self.token`` and ``token`` are one."""
        return re.split(r"\.|->|::", name.lstrip("$@"))[-1].lower()

    def give(self, name: str, parts: list[int], add: bool = False) -> None:
        key = self.key(name)
        if add and key in self.names:
            parts = [self.names[key], *parts]
        if parts:
            self.nodes.append(parts)
            self.wanted.append((name_score(name), name))
            self.names[key] = len(self.nodes) - 1

    def read(self) -> None:
        text, at = self.text, 0
        pending = ""
        while (m := _STATEMENT.search(text, at)) is not None:
            at = m.end()
            if m.group("tag"):
                start, stop = m.span("inner")
                own = text[start:stop]
                start, stop = start + len(own) - len(own.lstrip()), stop - len(own) + len(own.rstrip())
                if stop > start:
                    self.give(m.group("tagged"), [self.literal(start, stop, True)])
                continue
            if m.group("url"):
                self.give("password", [self.literal(*m.span("in_url"), True)])
                continue
            name = m.group("flagged") or m.group("index") or m.group("quoted") or m.group("plain")
            ends, parts = self.expression(at)
            # The value of an entry like {name: X, value: Y} is given to X.
            word = self.key(name)
            if word in ("name", "key") and parts and parts[0] < 0:
                pending = self.literals[~parts[0]].text if len(parts) == 1 else ""
            elif word == "value" and pending:
                name, pending = pending, ""
            self.give(name, parts, m.group("sign") == "+=")
            # A call's arguments are statements themselves; strings are passed over.
            at = max(at, ends) if not text[at:ends].rstrip().endswith("(") else at

    def scores(self) -> dict[int, tuple[float, str]]:
        """Per literal the best (score, name) of the names it reaches."""
        best = list(self.wanted)
        out: dict[int, tuple[float, str]] = {}
        for i in range(len(self.nodes) - 1, -1, -1):
            score = best[i]
            for part in self.nodes[i]:
                if part >= 0:
                    best[part] = max(best[part], score)
                elif score[0] > out.get(~part, (-1.0, ""))[0]:
                    out[~part] = score
        return out


def named_literals(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, best name, score) of the literals of a text's assignments, by start."""
    if not ("=" in text or ":" in text or "--" in text or "</" in text):
        return []
    reader = _Reader(text)
    reader.read()
    found: dict[tuple[int, int], tuple[float, str]] = {}
    for i, (weight, name) in reader.scores().items():
        own = reader.literals[i]
        score = weight * literal_score(own.look, own.quoted) if weight else 0.0
        if score > found.get((own.start, own.end), (-1.0, ""))[0]:
            found[own.start, own.end] = (score, name)
    return sorted((start, end, name, round(score, 6)) for (start, end), (score, name) in found.items())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the fixed patterns, sorted."""
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _MIN_ASSIGN]
    spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _MIN_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def secrets(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, str, float]]]:
    """(base spans, all spans with the name and score of named literals, '' and 1.0 for the others)."""
    if not text:
        return [], []
    base = base_spans(text)
    spans = [(start, kind, end, "", 1.0) for start, kind, end in base]
    reach = [0]
    for _, _, end in base:
        reach.append(max(reach[-1], end))
    at = 0
    for start, end, name, score in named_literals(text):
        while at < len(base) and base[at][0] <= start:
            at += 1
        # Base spans that begin at or before the literal reach so far; beyond its end, they cover it.
        if score >= THRESHOLD and reach[at] < end:
            spans.append((start, 3, end, name, score))
    return base, sorted(spans)


def _listed(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, *_ in spans)


def scan(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, found) per row.

    ``spans`` lists all spans as kind:start:end, ``base_sha256`` is the digest of such a list of the base
    spans, and ``found`` has all spans with their name, score and text.
    """
    ship(df.sparkSession)
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()),
                        ("score", pa.float64()), ("text", pa.string())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in range(6)]
            for own in batch.column(1).to_pylist():
                base, spans = secrets(own)
                for column, kind in zip(columns, range(3)):
                    column.append(sum(k == kind for _, k, _ in base))
                columns[3].append(hashlib.sha256(_listed(base).encode()).hexdigest())
                columns[4].append(_listed(spans))
                columns[5].append([{"kind": KINDS[kind], "start": start, "end": end, "name": name, "score": score,
                                    "text": own[start:end]} for start, kind, end, name, score in spans])
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(struct)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                             ["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    schema = (f"key {dict(df.dtypes)[key]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
              "found array<struct<kind: string, start: long, end: long, name: string, score: double, text: string>>")
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(scanned, schema)
