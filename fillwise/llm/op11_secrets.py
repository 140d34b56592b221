"""Secrets by assignment-aware lexing: which literals reach names that call for a secret.

Three patterns find the plain cases (the base kinds). For the others a text is lexed as source or configuration: names,
quoted literals, operators. Every assignment, key of a mapping, keyword, subscript, setter, flag, element, name-value
entry and connection string gives a target name and an expression of literals and earlier names. Sensitivity flows back from targets through the
constants that they are made of; a literal that a sensitive name gets is scored by that name and by its own randomness.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.llm.common import texts_of

# Fixed values of the base kinds: patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN = 6
#: Kinds in the order in which spans of one start are listed; the last is the method's own.
KINDS = ("assign", "access", "hex", "literal")

#: Without one of these no name is sensitive.
STEM = re.compile(r"pass|pwd|secret|token|cred|auth|jwt|key|mnemonic", re.IGNORECASE)
SECRET_WORDS = {
    "password", "passwd", "passphrase", "passcode", "pass", "pwd", "pw", "secret", "secrets", "token", "tokens", "apikey", "credential",
    "credentials", "cred", "creds", "authorization", "jwt", "mnemonic", "privatekey", "secretkey", "accesskey", "authkey",
}
GLUED = re.compile(r"password|passwd|passphrase|passcode|secret|token|apikey|accesskey|privatekey|credential")
KEY_WORDS = {
    "api", "access", "private", "secret", "auth", "encryption", "signing", "client", "master", "service", "account", "shared", "storage",
    "ssh", "session", "deploy", "license", "app",
}
#: Words that make a name one about a secret instead of one that holds it.
ABOUT_WORDS = {
    "name", "names", "id", "ids", "url", "uri", "path", "file", "filename", "dir", "field", "label", "hint", "prompt", "length", "len", "size",
    "type", "types", "count", "expiry", "expires", "expiration", "ttl", "regex", "pattern", "header", "policy", "min", "max", "format", "class",
    "index", "env", "var", "param", "column", "error", "message", "msg", "text", "title", "placeholder", "help", "description", "endpoint",
    "limit", "version", "algorithm", "issuer", "audience", "scope", "address",
}
PUBLIC_WORDS = {"public", "pub", "is", "has", "num", "max", "min", "no", "not"}
PHRASES = {"passphrase", "mnemonic"}
THRESHOLD, QUOTED_BITS, BARE_BITS, MIN_LITERAL = 0.5, 24.0, 40.0, 6

PLACEHOLDER = re.compile(
    r"""(?ix) x{3,} | \*+ | \.+ | -+ | <.*> | \[.*\] | \(.*\) | .*\$[({].* | \$\w+ | %\w+%? | .*%\(.* | .*\{.*\}.* | (your|my|the|some|insert|enter|put|add)[-_.\s].* | .*(change|replace|fill|update)[-_]?(me|this|it|in).*
    | .*(example|placeholder|redacted|sample|dummy|todo|fixme|tbd).* | (none|null|nil|true|false|undefined|default|password|passwd|secret|token|test|testing|string|str|optional|required|unknown|empty)[\d_]*
    | [a-z][a-z0-9+.-]*://[^@]* | [./~]?(/[\w.-]+)+/? | [\w-]+(\.[\w-]+)*\.(json|ya?ml|txt|pem|key|crt|env|ini|toml|conf|cfg|py|js|ts|java|html?|com|org|net|io) | [\w.+-]+@[\w-]+(\.[\w-]+)+ """
)
SCHEME = re.compile(r"(bearer|basic|token|digest)\x20+", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

LEX = re.compile(
    r"""(?x) (?P<long>\"\"\"|'''|`) | (?P<quote>["']) | (?P<word>[^\W\d][\w$]*(?:-[^\W\d][\w$]*)*) | (?P<number>\d[\w.]*)
    | (?P<other>[=!<>]==?|[-+*/%&|^]\x20?=(?==)|--+) | (?P<assign>:=|=>|\?=|\|\|=|\+=|=|:(?!:|//)) | (?P<dot>\.(?!\.)|::|->) | (?P<join>\+|\.\.|&|\|\|)
    | (?P<open>[(\[]) | (?P<close>[)\]]) | (?P<comma>,) | (?P<line>\n) | (?P<end>[;{}<>\#|]|//) | (?P<rest>[^\s]) """
)
SINGLE, DOUBLE = (re.compile(rf"(?:[^\\\n{q}]|\\.)*+") for q in "'\"")
BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]+")
ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*)[^<>]*>([^<>\s]+)</")
INSIDE = re.compile(r"([A-Za-z_][\w-]*)=([^\s;&\"'`<>,]+)")
FLAG = re.compile(r"--([A-Za-z][\w-]*)(?:\x20+|=)([\"']?)([^\s\"'`,;<>-][^\s\"'`,;<>]*)")
GETTERS = {"getenv", "get", "env", "config", "getproperty", "environ", "getorelse", "getordefault", "option", "lookup"}
WRAPPERS = {"str", "string", "bytes", "secret", "secretstr", "b64decode", "decode", "encode", "quote", "unquote", "atob", "btoa", "of", "from"}
SETTERS = {"set", "put", "add", "setproperty", "setenv", "header", "setheader", "addheader", "append", "setitem", "define"}


@dataclass
class Pair:
    """What a target gets: literals (start, end, quoted), the earlier pairs that it names, and how sensitive it is."""

    name: str
    weight: float
    literals: list[tuple[int, int, bool]] = field(default_factory=list)
    refs: list[int] = field(default_factory=list)


#: Tokens that do not exist stand before the first and behind the last one, as far as the parser looks.
MARGIN = 6


def lex(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """(kinds, places) of the tokens, in one pass; a string's place is what its quotes hold.

    A quote after a letter, or without a partner in its line, is no quote; the line keeps none of its sort then.
    """
    kinds, places = [""] * MARGIN, [(0, 0)] * MARGIN
    at, n, closed = 0, len(text), {}
    while m := LEX.search(text, at):
        kind, start = m.lastgroup, m.start()
        at = m.end()
        if kind in ("quote", "long"):
            mark = m.group()
            prefixed = kinds[-1] == "word" and places[-1][1] == start and start - places[-1][0] <= 2
            if start < closed.get(mark, 0) or kind == "quote" and start and text[start - 1].isalnum() and not prefixed:
                continue
            end = _closing(text, mark, at, n)
            if end < 0:
                stop = text.find("\n", at)
                closed[mark] = n if kind == "long" or stop < 0 else stop
                continue
            kinds.append("string")
            places.append((at, end))
            at = end + len(mark)
        elif kind != "rest":
            kinds.append(kind)
            places.append((start, at))
    return kinds + [""] * MARGIN, places + [(n, n)] * MARGIN


def _closing(text: str, mark: str, at: int, n: int) -> int:
    """Where the string that begins at ``at`` ends, or -1."""
    if len(mark) == 3 or mark == "`":
        return text.find(mark, at)
    m = (SINGLE if mark == "'" else DOUBLE).match(text, at)
    return m.end() if m.end() < n and text[m.end()] == mark else -1


@lru_cache(maxsize=1 << 14)
def name_weight(name: str) -> float:
    """How much a name calls for a secret, 0 to 1."""
    words = [w.lower() for w in WORDS.findall(name)]
    if not words:
        return 0.0
    near = set(words[-4:])
    weight = 0.0
    if near & SECRET_WORDS or GLUED.search("".join(words[-4:])):
        weight = 1.0
    elif "key" in near or "keys" in near:
        weight = 0.9 if near & KEY_WORDS else 0.3
    elif "auth" in near:
        weight = 0.6
    if words[-1] in ABOUT_WORDS or near & PUBLIC_WORDS:
        weight *= 0.2
    return weight


def strength(text: str, quoted: bool, phrase: bool = False) -> float:
    """How much a literal looks like a secret, 0 to 1: its bits by its own letters, less where it has only one sort of them."""
    text = SCHEME.sub("", text, count=1) if SCHEME.match(text) else text
    if len(text) < MIN_LITERAL or PLACEHOLDER.fullmatch(text) or len(set(text)) < 4:
        return 0.0
    if any(c.isspace() for c in text) and not phrase:
        return 0.0
    n = len(text)
    bits = -sum(k * math.log2(k / n) for k in Counter(text).values())
    sorts = sum((any(map(str.islower, text)), any(map(str.isupper, text)), any(map(str.isdigit, text)), not text.isalnum()))
    plain = text.replace("_", "").replace("-", "").replace(".", "").isalpha()
    return min(1.0, bits / (QUOTED_BITS if quoted else BARE_BITS)) * ((0.6 if quoted else 0.2) if plain or sorts == 1 and not text.isdigit() else 1.0)


class Parser:
    """Pairs of a lexed text, in its order."""

    def __init__(self, text: str):
        self.text, (self.kinds, self.places) = text, lex(text)
        self.pairs: list[Pair] = []
        self.known: dict[str, int] = {}

    def value(self, i: int) -> str:
        start, end = self.places[i]
        return self.text[start:end]

    def add(self, name: str, literals: list, refs: Iterable[int] = (), weight: float | None = None, known: bool = True) -> int:
        self.pairs.append(Pair(name, name_weight(name) if weight is None else weight, literals, list(refs)))
        if known:
            self.known[name] = len(self.pairs) - 1
        return len(self.pairs) - 1

    def literal(self, i: int) -> tuple[int, int, bool]:
        return (*self.places[i], True)

    def path_before(self, i: int) -> str:
        """The dotted name that ends at token i; what an object calls itself is left out."""
        first = i
        while self.kinds[first - 1] == "dot" and self.kinds[first - 2] == "word":
            first -= 2
        if first < i and self.value(first) in ("self", "this"):
            first += 2
        return self.text[self.places[first][0] : self.places[i][1]]

    def target(self, op: int) -> str | None:
        """The name left of an assignment."""
        before = self.kinds[op - 1]
        if before == "word":
            return self.path_before(op - 1)
        if before == "string":
            return self.value(op - 1)
        if before == "close" and self.kinds[op - 2] in ("string", "word") and self.kinds[op - 3] == "open":
            return self.value(op - 2)
        return None

    def operand(self, i: int, literals: list, refs: list, first: bool) -> int:
        """Takes one operand from token i on; the token behind it, or -1 where there is none."""
        kind = self.kinds[i]
        if kind == "word" and self.kinds[i + 1] == "string" and self.places[i][1] == self.places[i + 1][0] - 1:
            kind, i = "string", i + 1  # prefixes such as b"..."
        if kind == "string":
            literals.append(self.literal(i))
            return i + 1
        if kind == "word":
            last = i
            while self.kinds[last + 1] == "dot" and self.kinds[last + 2] == "word":
                last += 2
            if self.kinds[last + 1] == "open":
                return self.call(last, literals)
            name = self.path_before(last)
            if name in self.known:
                refs.append(self.known[name])
                return last + 1
        if first and kind not in ("line", "end", "comma", "open", "close"):
            return self.bare(i, literals)
        return -1

    def bare(self, i: int, literals: list) -> int:
        """An unquoted value of a configuration line."""
        m = BARE.match(self.text, self.places[i][0])
        if not m:
            return -1
        literals.append((*m.span(), False))
        while self.kinds[i] and self.places[i][0] < m.end():
            i += 1
        return i

    def call(self, name: int, literals: list) -> int:
        """wrapper("literal") and getter("NAME", "literal"); the token behind it, or -1."""
        callee, a, kinds = self.value(name).lower(), name + 2, self.kinds
        if kinds[a] != "string":
            return -1
        if kinds[a + 1] == "close" and callee in WRAPPERS:
            literals.append(self.literal(a))
            return a + 2
        if callee in GETTERS and kinds[a + 1] == "comma" and kinds[a + 2] == "string" and kinds[a + 3] == "close":
            literals.append(self.literal(a + 2))
            self.add(self.value(a), [self.literal(a + 2)], known=False)
            return a + 4
        return -1

    def run(self) -> list[Pair]:
        chained: list[str] = []
        #: the last name that a key or name entry gave, and a name that waits for its value behind a type, with its depth
        entry = typed = None
        depth = 0
        for i in range(MARGIN, len(self.kinds) - MARGIN):
            kind = self.kinds[i]
            if kind == "open":
                depth += 1
                self.arguments(i)
            elif kind == "close":
                depth -= 1
            if typed and (kind in ("line", "end") or kind == "comma" and depth <= typed[1]):
                typed = None
            if kind != "assign" or not (name := self.target(i) or (typed and typed[0])):
                continue
            sign = self.value(i)
            if sign == "=" and self.kinds[i + 1] == "word" and self.kinds[i + 2] == "assign" and self.value(i + 2) == "=":
                chained.append(name)  # a = b = value
                continue
            literals, refs = [], []
            at = self.operand(i + 1, literals, refs, True)
            while at > 0 and self.kinds[at] in ("join", "dot", "string"):
                step = at if self.kinds[at] == "string" else at + 1
                while self.kinds[step] == "line":
                    step += 1
                at = self.operand(step, literals, refs, False)
            others = [*chained, *([typed[0]] if typed and sign == "=" else [])]
            # key = "NAME" value = "literal", name: NAME and value: literal
            last = name.rpartition(".")[2].lower()
            if last == "value" and entry:
                others.append(entry)
            entry = self.text[literals[0][0] : literals[0][1]] if last in ("key", "name") and len(literals) == 1 else None
            if sign == "+=" and name in self.known:
                refs.append(self.known[name])
            pair = self.add(max([name, *others], key=name_weight), literals, refs)
            self.known.update((other, pair) for other in (name, *others))
            chained = []
            typed = (name, depth) if sign == ":" else None
        for m in ELEMENT.finditer(self.text):
            self.add(m[1], [(*m.span(2), False)], known=False)
        for m in FLAG.finditer(self.text):
            self.add(m[1], [(*m.span(3), bool(m[2]))], known=False)
        for kind, (start, end) in zip(self.kinds, self.places, strict=True):
            if kind == "string" and end - start > 8 and STEM.search(self.text, start, end):
                for m in INSIDE.finditer(self.text, start, end):
                    self.add(m[1], [(*m.span(2), False)], known=False)
        return self.pairs

    def arguments(self, i: int) -> None:
        """setSecret("literal"), .secret("literal") and set("secret", "literal")."""
        kinds = self.kinds
        if kinds[i - 1] != "word" or kinds[i + 1] != "string":
            return
        callee = self.value(i - 1)
        if kinds[i + 2] == "close" and callee.lower() not in GETTERS | WRAPPERS and (kinds[i - 2] == "dot" or callee.startswith(("set", "with"))):
            self.add(callee, [self.literal(i + 1)], known=False)
        if callee.lower() in SETTERS and kinds[i + 2] == "comma" and kinds[i + 3] == "string":
            self.add(self.value(i + 1), [self.literal(i + 3)], known=False)


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of the literals that sensitive names get, by start; a literal once, with its best name."""
    if not STEM.search(text):
        return []
    pairs = Parser(text).run()
    source = list(range(len(pairs)))
    # pairs name earlier ones only, so one walk back hands every weight on
    for k in range(len(pairs) - 1, -1, -1):
        for r in pairs[k].refs:
            if r != k and pairs[k].weight > pairs[r].weight:
                pairs[r].weight, source[r] = pairs[k].weight, source[k]
    best: dict = {}
    for k, pair in enumerate(pairs):
        if pair.weight < threshold:
            continue
        name = pairs[source[k]].name
        phrase = bool({w.lower() for w in WORDS.findall(name)} & PHRASES)
        whole = strength("".join(text[a:b] for a, b, _ in pair.literals), all(q for *_, q in pair.literals), phrase) if pair.literals else 0.0
        for a, b, quoted in pair.literals:
            score = pair.weight * (whole if len(pair.literals) > 1 else strength(text[a:b], quoted, phrase))
            if score >= threshold and b > a and score > best.get((a, b), (0.0, ""))[0]:
                best[a, b] = score, name
    return [(a, b, name, score) for (a, b), (score, name) in sorted(best.items())]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds."""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


def spans_of(text: str | None, threshold: float = THRESHOLD) -> list[dict]:
    """All spans by start, kind and end. A literal inside a base span is not told again."""
    text = text or ""
    base = base_spans(text)
    out = [{"kind": kind, "start": a, "end": b, "name": None, "score": None} for a, kind, b in base]
    edges, reach = sorted((a, b) for a, _, b in base), []
    for a, b in edges:  # furthest end of the base spans that start here or before
        reach.append(max(b, reach[-1]) if reach else b)
    at = 0
    for a, b, name, score in literal_spans(text, threshold):
        while at < len(edges) and edges[at][0] <= a:
            at += 1
        if not at or reach[at - 1] < b:
            out.append({"kind": "literal", "start": a, "end": b, "name": name, "score": score})
    return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))


SPANS = "array<struct<kind:string,start:int,end:int,name:string,score:double>>"


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans): kind, start and end in code points (end exclusive) of every secret, one row for each input row.

    Spans are sorted by start, kind (in the order of KINDS) and end. Kinds assign, access and hex are the base patterns, of
    which ``name`` and ``score`` are null; ``literal`` has the sensitive name that gets the literal, and its score. Null and
    empty texts have no spans. Texts are read whole, in time that grows with their length. Ids may be null or repeat. An
    empty table stays empty. Other columns are ignored; their names don't matter. Names mean the constant that was last
    assigned before; scopes are not told apart.
    """

    @F.pandas_udf(SPANS)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([spans_of(text, threshold) for text in some])

    return texts_of(docs).select(F.col(id_col).alias("doc_id"), found(F.col(text_col)).alias("spans"))


def _listed(spans: Column, kinds: Iterable[str]) -> Column:
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, KINDS[:3]), F.sha2(_listed(F.col("spans"), KINDS[:3]), 256).alias("base_sha256"), _listed(F.col("spans"), KINDS).alias("spans")
    )
