"""Secret scans: base patterns plus assignment-aware lexing.

A lexer cuts a text into strings (quoted, triple-quoted, back-quoted, with prefixes), names, bare values, operators, brackets and
line ends; a machine over these tokens reads the syntax of source and configuration files into name-literal pairs:
``name = "value"``, ``name: type = "value"``, ``a = b = "value"``, ``name: value``, ``"name": 'value'``, ``name => "value"``, ``d["name"] = value``,
``f(name="value")``, ``set("name", "value")``, ``getenv("X", "default")`` (the default only), lists, sums and adjacent strings over several lines in
brackets or after a backslash, block scalars (``name: |`` and the deeper lines below it) and elements (``<name>value</name>``). Members of a map
belong to their own keys. Comments are read like code, as keys are commented out. Literals that are added up or stand side by side are judged as one
as well, so a secret in short parts is found.
A name that was bound to literals stands for them when it is assigned or concatenated later (its last binding before); every literal that reaches a
sensitive target name is judged: a strong name
(password, token, ...) takes any literal of ``LEAST_LITERAL`` characters that is no placeholder or
reference, a weaker one those whose entropy is high enough. Names that say how many or where (``max_tokens``, ``password_file``) are none.

Defined results: a null or empty text has no spans; texts are scanned whole; equal starts
sort by kind in the order of ``KINDS``, then end; repeated rows each get their own result; an
empty table gives an empty table; a column named like the output is replaced.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrove.llm.common import free_name, parts, small_batches

#: The base kinds, in their order, and the kind that the lexer adds.
KINDS = ("assign", "access", "hex", "literal")
#: The base patterns and least lengths (of group 2, of the match, of the match).
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
LEAST_ASSIGN = 6

#: How strongly a word of a target name says that its value is a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0, "jwt": 1.0, "pw": 1.0,
    "credential": 0.8, "credentials": 0.8, "bearer": 0.8, "pass": 0.8, "pat": 0.8, "auth": 0.6, "key": 0.6, "private": 0.6, "access": 0.4, "client": 0.2,
}
#: Words that, last in a name, say that its value is something about a secret, and words that anywhere in it say that it is a number.
ABOUT = {
    "count", "counts", "file", "files", "filename", "path", "paths", "dir", "directory", "folder", "url", "uri", "endpoint", "length", "len", "size", "type", "field", "format", "policy",
    "prompt", "label", "hint", "regex", "pattern", "expiry", "expires", "timeout", "ttl", "enabled", "required", "limit", "budget",
}
NUMBER = {"max", "min", "num", "total"}
#: Words that make a literal a placeholder if all its other words are of the second kind.
PLACEHOLDERS = {"example", "changeme", "change", "placeholder", "your", "todo", "insert", "dummy", "sample", "redacted", "xxx"}
FILLERS = {"my", "me", "the", "a", "an", "here", "this", "password", "passwd", "pass", "secret", "token", "key", "api", "apikey", "value", "user", "test", "goes", "with", "real", "x"}
MASK = re.compile(r"[xX*.#_•-]+")
#: Placeholders if there is nothing else, or after "todo" anything.
NOTHING = re.compile(r"\W*(?:todo\b.*|(?:none|null|true|false)(?:\W+(?:none|null|true|false))*\W*)", re.S)
#: Names of other values, as templates and shells write them.
REFERENCE = re.compile(r"\$[A-Za-z_][A-Za-z0-9_]*|\$?\{.*\}|\$\(.*\)|<.*>", re.S)
LEAST_LITERAL = 6
#: A name of this weight says by itself that its value is a secret.
STRONG = 1.0
#: Under a weaker name a literal is a secret from this product of name weight and literal weight on.
LEAST_SCORE = 0.5
#: Bits of a literal (entropy a character times length) that count as fully random.
FULL_BITS = 60.0

def name_weight(name: str) -> float:
    """The largest weight of the name's words, plurals too; "api key", "access key" and "private key" count in full."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
    if parts and (parts[-1] in ABOUT or NUMBER & set(parts)):
        return 0.0
    weight = max((SENSITIVE.get(p, SENSITIVE.get(p.removesuffix("s"), 0.0)) for p in parts), default=0.0)
    if "pass" in parts and len(parts) > 1:
        weight = 1.0  # db_pass; alone it is a word of prose as well
    if "key" in parts and {"api", "access", "private", "secret", "signing", "encryption"} & set(parts):
        weight = 1.0
    return max(weight, *(v for k, v in SENSITIVE.items() if len(k) > 5 and k in name.lower()), 0.0) if name else 0.0


def candidate(value: str) -> bool:
    """Whether a literal can be a secret: neither short nor white nor a placeholder nor a reference."""
    words = set(re.findall("[a-z]+", value.lower()))
    stands_for = words & PLACEHOLDERS and words <= PLACEHOLDERS | FILLERS
    return len(value) >= LEAST_LITERAL and not value.isspace() and not stands_for and not MASK.fullmatch(value) and not NOTHING.fullmatch(value.lower()) and not REFERENCE.fullmatch(value)


def literal_weight(value: str) -> float:
    """0 for prose; else its bits over ``FULL_BITS``, 1 at most."""
    if " " in value:
        return 0.0
    n = len(value)
    bits = -sum(c * math.log2(c / n) for c in Counter(value).values())
    variety = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, bits / FULL_BITS) * (1.0 if variety > 1 else 0.6)


def is_secret(weight: float, value: str) -> bool:
    """Under a strong name every candidate, whatever its entropy; under a weaker one what scores enough."""
    return weight > 0 and candidate(value) and (weight >= STRONG or weight * literal_weight(value) >= LEAST_SCORE)


#: Tokens of the lexer; what matches none of them only separates.
TOKEN = re.compile(
    r"""(?P<string>(?<![A-Za-z0-9_$])[rRbBuUfF]{0,2}(?:\"{3}(?:[^\\]|\\.)*?\"{3}|'{3}(?:[^\\]|\\.)*?'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|(?<!`)`(?!`)(?:[^`\\\n]|\\.)*`(?!`)))
    |(?P<name>[A-Za-z_$][A-Za-z0-9_.$-]*)|(?P<number>[0-9][A-Za-z0-9+/_.$=-]*)|(?P<line>\n)|(?P<next>\\\r?\n)
    |(?P<compare>[=!<>]=+|=>|->|=~)|(?P<glue>\|\||\?\?|&&|[-+.%|&:=?])|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<end>[,;])""",
    re.S | re.X,
)
#: What makes the token before it a key, the closing bracket of an index included; blanks around the operator are told.
BOUND = re.compile(r"[ \t]*(\])?([ \t]*)(:=|=>|=(?![=~>])|:(?![:/=]))")
#: A value without quotes.
BARE = re.compile(r"[A-Za-z0-9_$][A-Za-z0-9+/_.$=-]*")
PLAIN = re.compile(r"[A-Za-z_$]+(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*")
STRING = re.compile(r"[rRbBuUfF]{0,2}(\"{3}|'{3}|[\"'`])")
#: Calls whose first argument names what is looked up.
LOOKUP = re.compile(r"(?:.*[._])?(?:get_?env|environ\.get|get|env|lookup|fetch|config|var)", re.I)
NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$ -]*")
#: The start of a block scalar after its key, the indent of a line, and an element that holds text only.
BLOCK, INDENT = re.compile(r"[ \t]*[|>][+-]?[0-9]?[ \t]*\r?\n"), re.compile(r"[ \t]*(?:- )?[ \t]*")
ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*)(?:\s[^<>]*)?>\s*([^<>\s](?:[^<>]*[^<>\s])?)\s*</\1\s*>")
CLOSES = {")": "(", "]": "[", "}": "{"}


class Value:
    """What names are bound to: its own literals (value, start, end, number of the run that they are added up in), the values it is made of, and what the names stood for before."""

    __slots__ = ("weight", "named", "own", "made_of", "before")

    def __init__(self) -> None:
        self.weight = self.named = 0.0
        self.own: list[tuple[str, int, int, int]] = []
        self.made_of: list[Value] = []
        self.before: dict[str, Value | None] = {}


class Frame:
    """An open bracket: what literals in it belong to, and where in a value the lexer is."""

    __slots__ = ("kind", "base", "target", "state", "code", "first", "skip", "choice", "run")

    def __init__(self, kind: str, base: Value | None = None, skip: bool = False) -> None:
        self.kind, self.base, self.target = kind, base, base
        #: "" between values, "bound" after a name's operator, "broken" the same after a line end, "open" where a value goes on, "string" and "atom" after one.
        self.state = "open" if base else ""
        self.code, self.first, self.skip, self.choice, self.run = True, None, skip, False, 0


def block_scalar(text: str, key: int, at: int, target: Value) -> int:
    """Binds the lines from ``at`` on that are indented deeper than the line of the key at ``key``, each stripped; returns their end."""
    line = text.rfind("\n", 0, key) + 1
    indent = INDENT.match(text, line).end() - line
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        held = text[at:end].rstrip()
        own = held.lstrip()
        if own:
            if len(held) - len(own) <= indent:
                break
            target.own.append((own, at + len(held) - len(own), at + len(held), len(target.own)))
        at = end
    return at


def elements(text: str) -> list[Value]:
    """Values of elements that hold text only, ``<name>value</name>``."""
    out = []
    for m in ELEMENT.finditer(text):
        value = Value()
        value.named = name_weight(m[1])
        value.own.append((m[2], m.start(2), m.end(2), 0))
        out.append(value)
    return out


def bindings(text: str) -> list[Value]:
    """All values that names are bound to in a text, in one pass over its tokens."""
    known: dict[str, Value] = {}
    values: list[Value] = []
    stack = [Frame("")]
    at, call = 0, ""

    def bind(frame: Frame, name: str, code: bool) -> None:
        if frame.target is frame.base or frame.state != "bound":
            frame.target = Value()
            values.append(frame.target)
        frame.target.before.setdefault(name, known.get(name))
        known[name] = frame.target
        frame.target.named = max(frame.target.named, name_weight(name))
        frame.state, frame.code, frame.run = "bound", code, frame.run + 1

    def done(frame: Frame) -> None:
        frame.run += 1
        frame.target, frame.state = frame.base, "open" if frame.base else ""

    while m := TOKEN.search(text, at):
        kind, start, at, frame = m.lastgroup, m.start(), m.end(), stack[-1]
        called, call = call, ""
        if kind in ("string", "name", "number"):
            if kind == "string":
                quote = STRING.match(text, start)
                low, high = quote.end(), at - len(quote[1])
            else:
                bare = BARE.match(text, start)
                if frame.state == "bound" and not (BOUND.match(text, at) and text[at] in " \t:") and not (bare[0][-1] == "=" and text[bare.end() : bare.end() + 1] in ("'", '"', "`")):
                    at = bare.end()
                low, high = start, at
            value = text[low:high]
            bound = BOUND.match(text, at) if kind != "number" else None
            if frame.choice and bound and bound[3] == ":":
                bound, frame.choice = None, False
            if bound:
                if bound[1]:
                    if frame.kind != "[" or kind != "string":
                        bound = None
                    else:
                        stack.pop()
                        frame = stack[-1]
                if bound:
                    spaced = bool(bound[2]) and bound[3] in ("=", ":=")
                    bind(frame, value, spaced or frame.kind == "(")
                    at = bound.end()
                    if bound[3] == ":" and (block := BLOCK.match(text, at)):
                        at = block_scalar(text, start, block.end(), frame.target)
                        done(frame)
                    continue
            if kind == "name" and value in ("or", "and", "if", "else", "await", "new", "return") and frame.state in ("atom", "string", "open"):
                frame.state = "open"
                continue
            if kind != "string" and text[at : at + 1] == "(":
                call = value
                continue
            if frame.kind == "(" and frame.first is None:
                frame.first = value if kind == "string" else ""
                if frame.skip:
                    frame.state = "atom"
                    continue
            if frame.target is None or not frame.state:
                continue
            if frame.state == "atom" or (frame.state, kind) not in (("string", "string"), ("broken", "string")) and frame.state not in ("bound", "open"):
                done(frame)
                if frame.state != "open" or frame.kind == "":
                    continue
            if kind != "string" and value in known:
                meant = known[value] if known[value] is not frame.target else frame.target.before[value]
                frame.target.made_of += [meant] if meant else []
            elif kind == "string" or not (PLAIN.fullmatch(value) and (frame.code or "." in value)):
                frame.target.own.append((value, low, high, frame.run))
            frame.state = "string" if kind == "string" else "atom"
        elif kind == "open":
            inner = frame.target if frame.state and m[0] != "{" else None
            stack.append(Frame(m[0], inner, bool(called and LOOKUP.fullmatch(called))))
            if frame.target is not None:
                frame.state = "atom"
        elif kind == "close":
            if frame.kind == CLOSES[m[0]]:
                stack.pop()
        elif kind == "end":
            done(frame)
            if m[0] == "," and frame.kind == "(" and frame.first and frame.base is None and NAME.fullmatch(frame.first):
                bind(frame, frame.first, True)
                frame.state = "open"
            if frame.kind == "(":
                frame.first = ""
        elif kind == "line":
            if frame.kind in ("", "{") and frame.target is not None:
                if frame.state == "bound":
                    frame.state = "broken"
                elif frame.state != "open":
                    done(frame)
        elif kind == "compare":
            done(frame)
        elif kind == "glue" and frame.state in ("atom", "string"):
            if m[0] == "=" and frame.target is not None:
                frame.target.own.clear()  # what stood before was a type
            frame.state, frame.choice = "open", m[0] == "?"
            frame.run += m[0] not in "+.&"
    return values


#: What every sensitive name holds.
STEMS = ("pass", "pw", "jwt", "pat", "secret", "token", "key", "credential", "bearer", "auth", "private", "access", "client")
#: What follows the stem of a name that is bound: the rest of a bare name (or of a bare value that turns out to be a name) and an
#: operator, the rest of a call's first string and its quote, or, for any other string, somewhere later a quote and an operator.
RUN, WIDE, OPERATOR = re.compile(r"[A-Za-z0-9_.$-]*"), re.compile(r"[A-Za-z0-9+/_.$=-]*"), re.compile(r"[ \t]*[:=]")
FIRST, QUOTES = re.compile(r"[A-Za-z0-9_.$ -]*"), ('"', "'", "`")
CLOSED = re.compile(r"""["'`][ \t]*\]?[ \t]*[:=]""")


def may_bind(text: str) -> bool:
    """False only if ``bindings`` can bind no sensitive name, so that no literal of the text is a secret. Linear: each stem's names are gone through once."""
    low = text.lower()
    first, element = len(low), "</" in low
    for stem in STEMS:
        at, run, wide, rest = low.find(stem), -1, -1, -1
        first = min(first, at) if at >= 0 else first
        while at >= 0:
            end = at + len(stem)
            if run < end:
                run = RUN.match(low, end).end()
                if OPERATOR.match(low, run):
                    return True
                if wide < end:
                    wide = WIDE.match(low, run).end()
                    if OPERATOR.match(low, wide):
                        return True
            if element:
                return True
            if rest < end:
                rest = FIRST.match(low, end).end()
                if low.startswith(QUOTES, rest):
                    return True
            at = low.find(stem, end)
    return CLOSED.search(low, first) is not None


class Scanner:
    def __init__(self) -> None:
        self.assign = re.compile(ASSIGN, re.I | re.A).finditer
        self.access = re.compile(ACCESS).finditer
        self.hex = re.compile(HEX).finditer

    def literals(self, text: str) -> set[tuple[int, int]]:
        """(start, end) of the literals that are secrets, constants followed; offsets are of the literal itself.

        A value is gone through again only for a stronger name, so chains of constants are followed whole in linear time.
        """
        out: set[tuple[int, int]] = set()
        for value in [*bindings(text), *(elements(text) if "</" in text else [])]:
            weight, todo = value.named, [value]
            while todo:
                value = todo.pop()
                if value.weight < weight:
                    value.weight = weight
                    for _, run in groupby(value.own, key=lambda x: x[3]):
                        run = list(run)
                        whole = len(run) > 1 and is_secret(weight, "".join(x[0] for x in run))
                        out.update((start, end) for v, start, end, _ in run if end > start and (whole or is_secret(weight, v)))
                    todo += value.made_of
        return out

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        out = []
        if ":" in text or "=" in text:
            out += [("assign", *m.span()) for m in self.assign(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
        if may_bind(text):
            out += [("literal", start, end) for start, end in self.literals(text)]
        if "AKIA" in text:
            out += [("access", *m.span()) for m in self.access(text)]
        out += [("hex", *m.span()) for m in self.hex(text)]
        return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with each maximal run of spans replaced by ``mark``."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def scan(df: DataFrame, text: str = "text", out: str = "secrets", mark: str = "[SECRET]") -> DataFrame:
    """Adds ``out``: struct(spans array of (kind, start, end) in code points, redacted text)."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    kind = pa.struct([("spans", pa.list_(span)), ("redacted", pa.string())])

    @F.arrow_udf("spans array<struct<kind:string,start:long,end:long>>, redacted string")
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner()
        for batch in parts(texts):
            rows = [x.as_py() for x in batch]
            spans = [scanner(x) if x else [] for x in rows]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], pa.list_(span)),
                    pa.array([None if x is None else redacted(x, s, mark) for x, s in zip(rows, spans)], pa.string()),
                ],
                fields=list(kind),
            )

    return small_batches(df).withColumn(out, found(F.col(text)))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = scan(docs).select("doc_id", F.col("secrets.spans").alias("s"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("s", lambda x: x["kind"] != "literal")
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")
    return done.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced; none is dropped. n_chars follows the text."""
    found = free_name(docs, "secrets")
    done = scan(docs, out=found)
    new = {"text": F.col(found)["redacted"], "n_chars": F.length(F.col(found)["redacted"]).cast("long")}
    return done.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))
