"""Secret scans: fixed patterns, and assignment-aware lexing on top.

The patterns give the base spans (kinds assign, access, hex). The lexer cuts a text into comments, strings, words and marks
and reads the assignments of source and configuration syntax among them into pairs of a name and the literals it comes to:
name = value with := and => as well, with a type on either side of the name or after a colon, "name": value, name: value
with the value on the same line or the next, deeper one, map["name"] = value, set("name", value), <name>value</name>. A
value is a sum of literals and names, also over the ends of lines, adjacent literals, or a bare word. Names of earlier
assignments are followed, also in templates, in the scope of their braces. Each literal is scored by how sensitive the name
is that it ends up in and how much it looks like a secret. Literals over the threshold that no base span touches are added
(kind named), at the place where they are written. Comments and the insides of strings are not code. Spans are code
points, of the whole match, end exclusive.

Edge cases: a null text is empty and has no span; the sha256 is then that of the empty string; rows that repeat are
scanned one by one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame

from quayside.llm.common import map_texts

KINDS = ("assign", "access", "hex", "named")
#: The base patterns and the least lengths of what they must hold.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12
#: Without one of these in lower case, ASSIGN can't match.
WORDS = ("passw", "secret", "token", "apikey", "api_key")

#: What the lexer stops at: strings, comments, words, marks, ends of lines.
TOKEN = re.compile(r"""(?P<long>\"{3}|'{3})|(?P<string>"(?:[^"\\\n]|\\.)*"|(?<!\w)'(?:[^'\\\n]|\\.)*'|(?<=\b[rbfuRBFU])'(?:[^'\\\n]|\\.)*'|`[^`]*`)|(?P<block>/\*|<!--)|(?P<line>(?<![^\s;])\#|(?<![:\w/])//)|(?P<element><[A-Za-z_][\w.:-]*>)|(?P<word>[A-Za-z_$][\w$-]*(?:\.[A-Za-z_$][\w$-]*)*)|(?P<mark>:=|=>|[=!<>~+*/%|&^-]=+|[=:+.,;(){}\[\]])|(?P<end>\n)""", re.A)
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
SPACES, NEXT_LINE = re.compile(r"[ \t]*"), re.compile(r"[ \t]*[|>]?[+-]?[ \t]*\r?(\n?)")
NAME = re.compile(r"[\w.$ -]+", re.A)
TEMPLATE = re.compile(r"\$?\{([A-Za-z_$][\w.$-]*)\}", re.A)
TYPED = re.compile(r"""[\w.&*?|<>,\[\] '-]*""", re.A)  #: a type between a colon and =
#: Words before the name of a declaration; after the first ones a type may follow the name.
NAME_FIRST, MODIFIERS = {"var", "let", "const", "val", "mut"}, {"var", "let", "const", "val", "mut", "final", "static", "private", "public", "protected", "internal", "export", "local", "my", "our", "set", "declare", "readonly", "volatile"}
SETTERS = re.compile(r"(?:^|\.)(?:set|put|add|with|append|insert|header|property|define|setenv)(?![a-z])", re.A)
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: How sensitive a name is by the words in it; pairs are words that follow each other.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "secret": 1.0, "token": 0.9, "apikey": 0.9, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.7, "signature": 0.6}
SENSITIVE_PAIRS = {("api", "key"): 0.9, ("access", "key"): 0.9, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("signing", "key"): 0.9, ("encryption", "key"): 0.9, ("connection", "string"): 0.7}
HINT = re.compile(r"pass|pwd|secret|token|key|cred|bearer|auth|signature|connection")
#: Values that stand for another one; only if that is all they hold.
PLACEHOLDER = re.compile(r"(?:\$\{.*\}|\$\(.*\)|\$\w+|%\w+%|<[^<>]*>|\{\{.*\}\}|(?:your|my|enter|insert|change|replace)[_-][\w-]*|(?:example|changeme|placeholder|dummy|redacted|sample|password|secret|token|true|false|none|null)[_-]?\d*|(.)\1*|[xX*.-]+)", re.I | re.S)
LEAST_SCORE = 0.5


def sensitivity(name: str) -> float:
    words = [w.lower() for w in NAME_PART.findall(name)]
    return max([0.0, *(SENSITIVE.get(w, 0.0) for w in words), *(SENSITIVE_PAIRS.get(p, 0.0) for p in zip(words, words[1:]))])


def likeness(literal: str, quoted: bool) -> float:
    """0 to 1: whether a literal looks like a secret rather than a word, a path or a placeholder."""
    if len(literal) < 8 or re.search(r"\s", literal) or PLACEHOLDER.fullmatch(literal):
        return 0.0
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if not quoted and not (re.search("[0-9]", literal) and re.search("[A-Za-z]", literal)):
        return 0.0
    variety = len(set(literal)) / min(len(literal), 16)
    return min(1.0, 0.25 * kinds + 0.5 * variety)


class Tails:
    """likeness of the ends of one word without quotes: where each of its characters stands last is looked up once, so many
    ends of a long word cost no more than the word. PLACEHOLDER can't pass the = or : that stands between two such ends."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text, self.start, self.end = text, start, end
        last = {text[i]: i for i in range(start, end)}
        self.last = sorted(last.values())
        where = lambda ok: max((i for x, i in last.items() if ok(x)), default=-1)
        lower, upper, digit = (where(lambda x, a=a, b=b: a <= x <= b) for a, b in ("az", "AZ", "09"))
        self.kinds = (lower, upper, digit, where(lambda x: not (x.isascii() and x.isalnum())))
        self.mixed = min(digit, max(lower, upper))  #: from there on, digit or letter lacks

    def likeness(self, at: int) -> float:
        if self.end - at < 8 or at > self.mixed or PLACEHOLDER.fullmatch(self.text, at, self.end):
            return 0.0
        variety = (len(self.last) - bisect_left(self.last, at)) / min(self.end - at, 16)
        return min(1.0, 0.25 * sum(at <= i for i in self.kinds) + 0.5 * variety)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end)"""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    lower = text.lower()
    if any(w in lower for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    return sorted(found)


Part = tuple[int, int, bool] | int  #: start and end of a literal and whether it is quoted; or an earlier assignment's number


def lexed(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of strings (without quotes), words, marks, elements and ends of lines; comments are left out."""
    out, at, missing = [], 0, set()

    def closed(mark: str, start: int) -> int:
        """Where a mark stands next, or -1; looked for once only where there is none."""
        found = -1 if mark in missing else text.find(mark, start)
        if found < 0:
            missing.add(mark)
        return found

    while m := TOKEN.search(text, at):
        kind, at = m.lastgroup, m.end()
        if kind == "long":
            end = closed(m[0], at)
            if end >= 0:
                out.append(("string", at, end))
                at = end + 3
        elif kind == "string":
            out.append(("string", m.start() + 1, at - 1))
        elif kind == "block":
            mark = "*/" if m[0] == "/*" else "-->"
            end = closed(mark, at)
            at = end + len(mark) if end >= 0 else at
        elif kind == "line":
            end = closed("\n", at)
            at = end if end >= 0 else len(text)
        else:
            out.append((kind, m.start(), at))
    return out


class Assignments:
    """Reads the tokens of a text from left to right."""

    def __init__(self, text: str) -> None:
        self.text, self.tokens = text, lexed(text)
        self.scopes: list[list[str]] = [[]]  #: names given a value in each open scope
        self.names: dict[str, list[int]] = {}  #: and the assignments that gave it, the innermost last
        self.starts = [t[1] for t in self.tokens]
        self.run = (0, 0)  #: the bare word that was read last
        self.found: list[tuple[str, list[Part]]] = []
        self.read()

    def is_mark(self, i: int, *marks: str) -> bool:
        return i < len(self.tokens) and self.tokens[i][0] == "mark" and self.text[slice(*self.tokens[i][1:])] in marks

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def known(self, name: str) -> list[int]:
        return self.names.get(name, [])[-1:]

    def literal(self, i: int) -> list[Part]:
        """A string, and what the names in it stand for."""
        _, start, end = self.tokens[i]
        return [(start, end, True), *[p for m in TEMPLATE.finditer(self.text, start, end) for p in self.known(m[1])]]

    def value(self, i: int, open_: bool = False) -> list[Part]:
        """The literals of the value that starts at a token: terms with + or . between, or strings side by side."""
        parts: list[Part] = []
        while i < len(self.tokens):
            while self.kind(i) == "end" and open_:
                i += 1
            if self.is_mark(i, "("):
                i, open_ = i + 1, True
                continue
            if self.kind(i) == "string":
                parts += self.literal(i)
                i += 1
            elif self.kind(i) == "word":
                start, end = self.tokens[i][1:]
                name = self.text[start:end]
                if self.kind(i + 1) == "string" and self.tokens[i + 1][1] == end + 1 and len(name) <= 2:  # a prefix of a literal
                    i += 1
                    continue
                if self.is_mark(i + 1, "(") and self.tokens[i + 1][1] == end:
                    break  # what a call gives is not known
                if found := self.known(name):
                    parts += found
                else:
                    parts += (word := self.bare(start))
                    end = word[0][1]
                i = bisect_left(self.starts, end, i)
            else:
                break
            ahead = i
            while self.kind(ahead) == "end" and (open_ or self.is_mark(ahead + 1, "+")):
                ahead += 1
            if self.is_mark(ahead, "+", "."):
                i = ahead + 1
                while self.kind(i) == "end":
                    i += 1
            elif self.kind(ahead) == "string" and self.kind(ahead - 1) in ("string", "end"):
                i = ahead
            else:
                break
        return list(dict.fromkeys(parts))

    def config(self, i: int) -> list[Part]:
        """The value of a key of configuration syntax: on its line, else bare or quoted on the next one if that is deeper."""
        after = self.tokens[i - 1][2]
        rest = NEXT_LINE.match(self.text, after)
        if rest[1]:
            line = self.text.rfind("\n", 0, after) + 1
            deep = lambda at: SPACES.match(self.text, at).end() - at
            if deep(rest.end()) <= deep(line):
                return []
            i += self.kind(i) == "end"
        if self.kind(i) in ("string", "word") and not self.text[rest.end() : self.tokens[i][1]].strip(" \t\"'`"):
            return self.value(i)
        return self.bare(rest.end())

    def bare(self, at: int) -> list[Part]:
        """The word without quotes that starts at a place, spaces before it left out."""
        at = SPACES.match(self.text, at).end()
        if not self.run[0] <= at < self.run[1]:
            word = BARE.match(self.text, at)
            self.run = word.span() if word else (0, 0)
        return [(at, self.run[1], False)] if self.run[0] <= at < self.run[1] else []

    def declared(self, i: int) -> str:
        """The name that a word before = gives a value to: the word, or where it is a type, the one before."""
        name, first = self.text[slice(*self.tokens[i][1:])], i
        while self.kind(first - 1) == "word":
            first -= 1
            if i - first == 4:
                break
        words = [self.text[slice(*t[1:])] for t in self.tokens[first : i + 1]]
        if len(words) >= 3 and words[-3] in NAME_FIRST and words[-2] not in MODIFIERS:
            return words[-2]
        return name

    def assigned(self, i: int) -> tuple[str, list[Part]] | None:
        """The name and literals of the assignment that has its name at a token."""
        kind, start, end = self.tokens[i]
        name = self.text[start:end]
        if kind == "element":
            close = self.text.find("<", end)
            inner = self.text[end:close] if close >= 0 and self.text.startswith("</" + name[1:], close) else ""
            cut = len(inner) - len(inner.lstrip())
            return (name[1:-1], [(end + cut, end + len(inner.rstrip()), True)]) if inner.strip() else None
        if kind == "string":
            if not NAME.fullmatch(name):
                return None
            if self.is_mark(i - 1, "[") and self.is_mark(i + 1, "]") and self.is_mark(i + 2, "=", ":="):
                return name, self.value(i + 3)
            if self.is_mark(i + 1, ":"):
                return name, self.config(i + 2)
            if self.is_mark(i + 1, "=>", "=", ":="):
                return name, self.value(i + 2)
            if self.is_mark(i - 1, "(") and self.is_mark(i + 1, ",") and self.kind(i - 2) == "word" and SETTERS.search(self.text[slice(*self.tokens[i - 2][1:])]):
                return name, self.value(i + 2)
            return None
        if self.is_mark(i + 1, "=", ":=", "=>"):
            return self.declared(i), self.value(i + 2) or self.bare(self.tokens[i + 1][2])
        if self.is_mark(i + 1, ":"):
            typed = TYPED.match(self.text, self.tokens[i + 1][2])
            if self.text[typed.end() : typed.end() + 1] == "=" and typed[0].strip() and self.text[typed.end() + 1 : typed.end() + 2] not in "=>~":
                j = i + 2
                while j < len(self.tokens) and self.tokens[j][1] < typed.end():
                    j += 1
                if self.is_mark(j, "="):
                    return name, self.value(j + 1)
            return name, self.config(i + 2)
        return None

    def read(self) -> None:
        for i, (kind, start, end) in enumerate(self.tokens):
            if kind == "mark":
                mark = self.text[start:end]
                if mark == "{":
                    self.scopes.append([])
                elif mark == "}" and len(self.scopes) > 1:
                    for name in self.scopes.pop():
                        self.names[name].pop()
            elif kind in ("word", "string", "element") and (pair := self.assigned(i)) and pair[1]:
                self.scopes[-1].append(pair[0])
                self.names.setdefault(pair[0], []).append(len(self.found))
                self.found.append(pair)

    def literals(self) -> Iterator[tuple[int, int, bool, float]]:
        """(start, end, quoted) of each literal, and how sensitive a name is that it ends up in."""
        most = [sensitivity(name) for name, _ in self.found]
        for i in range(len(most) - 1, -1, -1):  # what is referred to stands before
            for p in self.found[i][1]:
                if isinstance(p, int):
                    most[p] = max(most[p], most[i])
                elif most[i]:
                    yield (*p, most[i])


def named_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not HINT.search(text.lower()):
        return []
    most: dict[tuple[int, int, bool], float] = {}
    for start, end, quoted, s in Assignments(text).literals():
        most[start, end, quoted] = max(s, most.get((start, end, quoted), 0.0))
    best: dict[tuple[int, int], float] = {}
    tails = None
    for (start, end, quoted), s in sorted(most.items()):
        if quoted:
            like = likeness(text[start:end], True)
        else:
            if tails is None or tails.end != end or start < tails.start:
                tails = Tails(text, start, end)
            like = tails.likeness(start)
        best[start, end] = max(s * like, best.get((start, end), 0.0))
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    touched = lambda a, b: (i := bisect_left(starts, b)) > 0 and reach[i - 1] > a
    return [(a, 3, b) for (a, b), score in best.items() if score >= LEAST_SCORE and not touched(a, b)]


def scan_text(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text or "")
    return base, sorted(base + named_spans(text or "", base))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_named)"""

    def each(texts: list[str | None]) -> list[tuple]:
        rows = []
        for text in texts:
            base, every = scan_text(text)
            counts = [sum(k == i for _, k, _ in every) for i in range(4)]
            rows.append((*counts[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), counts[3]))
        return rows

    return map_texts(docs, lambda: each, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_named bigint")
