r"""Secret scans with assignment-aware lexing.

Base spans, leftmost and non-overlapping in each kind:

* ``assign``: a sensitive name, an optional quote, ``:`` or ``=``, an optional
  quote, and a value of 6 or more characters;
* ``access``: ``AKIA`` and capitals or digits, 20 or more characters in all;
* ``hex``: 24 or more of ``0-9a-f``.

The lexer then reads every text as source or configuration:

1. Pairs.  Each assignment sign (``=``, ``:``, ``:=``, ``=>``, ``+=``) gives the
   name before it (plain, quoted, subscripted, or annotated with a type) and the
   value after it; ``<name>value</name>``, ``call("name", "value")`` and ``name:
   X`` beside ``value: Y`` are pairs too.
2. Values.  Quoted literals with escapes, prefixes and continuation lines, triple
   quotes, back-quotes, escaped quotes of nested texts, bare words, YAML block
   scalars, lists, call arguments, and terms joined by ``+``, ``.``, ``||`` and so
   on, with comments between them.  ``${NAME}``, ``{NAME}`` and the like inside a
   literal refer to constants; so do bare identifiers that the text assigns.
3. Constants.  A use reaches the assignments of that name in the innermost scope
   (function, class or section) that has any, before or behind it; names flow
   through any number of constants to a fixed point.
4. Scores.  A literal has the best score of all names that it reaches and that
   of its own form.  From ``THRESHOLD`` on it is a span of kind ``lexed``.

Nothing has a longest form or a largest number.  A sign within a literal or a
comment is read no further than that, so time stays linear in the text.

Base spans always stay.  Spans are sorted by start, then kind in the order of
``KINDS``, then end, so ties have one order; a repeated row is scanned again.
Offsets are code points, the end exclusive.  A null text is the empty text.
Rows without a doc_id are left out; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .storage import documents, read_table, small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones never hide a longer one
KINDS = ("assign", "access", "hex", "lexed")
#: Score from which a literal is a secret.
THRESHOLD = 1.0
#: The most that :func:`form_score` adds.
BEST_FORM = 0.4

#: What the words of a name say about its value.
NAME_WORDS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "secrets": 1.0, "token": 1.0, "apikey": 1.0,
    "credential": 1.0, "credentials": 1.0, "private": 0.6, "access": 0.4, "api": 0.4, "auth": 0.6, "key": 0.6, "signing": 0.4,
    "encryption": 0.4, "client": 0.2, "bearer": 0.8, "cert": 0.4, "salt": 0.6, "session": 0.3,
    "public": -1.0, "length": -1.0, "count": -1.0, "policy": -1.0, "hint": -1.0, "url": -0.6, "name": -0.6, "path": -0.6, "file": -0.6, "limit": -1.0,
}
#: Calls whose first argument says where to look, not what was found.
LOOKUPS = {"getenv", "env", "environ", "get", "getproperty", "config", "input", "prompt", "getpass", "open", "fetch", "lookup"}

_NAME_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-"
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_SIGN = re.compile(r"[=:]+>?")
_TAG = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*+)>\s*+(?:<!\[CDATA\[(?P<data>[^<>]*+)\]\]>\s*+|(?P<body>[^<>]*+))</\1>")
_NAMED_ARGUMENT = re.compile(r"""\(\s*+(["'])([A-Za-z_][A-Za-z0-9_.-]*+)\1\s*+,""")
_TYPE = re.compile(r"\s*+[A-Za-z_][\w.]*+(?:[\[<][\w\s.,|\[\]<>]*+)?[?!]?\s*+\Z")
_BARE = re.compile(r"""(?:[^\s"'`,;:()\[\]{}<>|\\$]|:(?=[^\s"'`,;()\[\]{}<>|\\])|\$(?![{(]))++""")
_REFERENCE = re.compile(r"\$?\{\{?\s*+(?P<braced>[A-Za-z_][\w.]*+)(?::?[-=?+](?P<default>[^{}$\n]*+))?\s*+\}\}?|\$\((?P<round>[A-Za-z_]\w*+)\)|%\((?P<percent>[A-Za-z_][\w.]*+)\)s|\$(?P<plain>[A-Za-z_]\w*+)")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+\Z", re.ASCII)
_WORD = re.compile(r"[A-Za-z_][\w.]*+")
_OPEN = re.compile(r"""(?P<prefix>[fFbBuUrR]{1,2}(?=["'])|[@$]{1,2}(?=["]))?(?P<slashes>\\*+)(?P<quote>\"\"\"|'''|["'`])""")
_CONTENT = {
    '"': re.compile(r'(?:[^"\\\n]|\\.)*+(?=")', re.DOTALL),
    "'": re.compile(r"(?:[^'\\\n]|\\.)*+(?=')", re.DOTALL),
    "`": re.compile(r"(?:[^`\\]|\\.)*+(?=`)", re.DOTALL),
}
_RAW = {'"': re.compile(r'[^"\n]*+(?=")'), "'": re.compile(r"[^'\n]*+(?=')")}
_JOIN = re.compile(r"\+|\.{1,2}(?=\s|[\"'])|&(?!&)|\|\||\?\?|<<|or\b")
_BLOCK = re.compile(r"[ \t]*+[|>][0-9+-]*+[ \t]*+(?:#[^\n]*+)?\n")
_LINE = re.compile(r"[^\n]*+\n?")
_SCOPE = re.compile(r"^(?P<indent>[ \t]*+)(?:(?P<closer>[})\]]+[;,]?[ \t]*$)|(?P<section>\[[^\[\]\n]+\][ \t]*$)|(?P<header>(?:(?:async|export|public|private|protected|static|final)\s++)*+(?:def|class|function|func|fn|sub|proc)\b)|(?=\S))", re.MULTILINE)
_PLACEHOLDER = re.compile(r"(?:x+|\*+|\.+|none|null|true|false|todo|changeme|example|your[_-].*|<.*>)\Z", re.IGNORECASE | re.ASCII)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


@functools.lru_cache(maxsize=1 << 14)
def name_score(name: str) -> float:
    return sum(NAME_WORDS.get(w.lower(), 0.0) for w in _NAME_PARTS.findall(name))


def form_score(value: str) -> float:
    """What a literal's own form says: long and mixed values look like secrets."""
    if len(value) < 6 or _PLACEHOLDER.match(value) or any(map(str.isspace, value)):
        return -2.0
    kinds = sum(any(map(t, value)) for t in (str.islower, str.isupper, str.isdigit))
    return min(0.2, (len(value) - 6) / 100) + 0.1 * (kinds - 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            out.append((m.start(), m.end(), "assign"))
    if "AKIA" in text:
        out.extend((m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20)
    out.extend((m.start(), m.end(), "hex") for m in HEX.finditer(text))
    return out


@dataclass
class Pair:
    """An assignment: its name, where its value begins, and what the value holds."""

    name: str
    sign: str
    at: int  #: of the sign
    begin: int  #: of the value
    literals: list[tuple[int, int, str]] = field(default_factory=list)  #: start, end, value without escapes and references
    uses: list[str] = field(default_factory=list)


def _name_before(head: str) -> str:
    """The name at the end of ``head``, the text between two signs; empty if there is none."""
    head = head.rstrip(" \t")
    if head[-1:] in ("'", '"', "`"):
        body = head[:-1]
        inner = body.rstrip("\\")
        mark = "\\" * (len(body) - len(inner)) + head[-1]
        opened = inner.rfind(mark)
        if opened >= 0 and "\n" not in inner[opened:]:
            return inner[opened + len(mark) :]
        head = inner
    elif head[-1:] == "]":
        opened = head.rfind("[")
        key = head[opened + 1 : -1].strip() if opened >= 0 else ""
        if len(key) > 2 and key[0] in "'\"" and key[-1] == key[0]:
            return key[1:-1]
        head = head[: max(opened, 0)].rstrip(" \t")
    return head[len(head.rstrip(_NAME_CHARS)) :].lstrip("0123456789.-")


def find_pairs(text: str) -> list[Pair]:
    """Names and signs of all assignments, in the order of the text; values are not read yet."""
    pairs: list[Pair] = []
    done = 0
    last: Pair | None = None  # the pair of the sign before
    for m in _SIGN.finditer(text):
        sign, at = m[0], m.start()
        if sign in ("=", ":", ":=", "=>") and not (sign == "=" and text[at - 1 : at] in ("!", "<", ">") and at):
            head = text[done:at]
            if sign == "=" and last is not None and last.sign == ":" and _TYPE.match(head) and "\n" not in head:
                last.sign, last.begin = "=", m.end()  # name: type = value
            else:
                name = _name_before(head.rstrip("+?|") if sign == "=" else head)
                if name and head.endswith("${" + name):
                    name = ""  # ${NAME:-default} is a reference
                last = Pair(name, sign, at, m.end()) if name else None
                if last is not None:
                    pairs.append(last)
        else:
            last = None
        done = m.end()
    if "<" in text:
        for m in _TAG.finditer(text):
            part = "body" if m["body"] is not None else "data"
            pair = Pair(m[1], "<", m.start(), m.end())
            value = m[part].strip()
            if value:
                begin = m.start(part) + m[part].index(value)
                pair.literals.append((begin, begin + len(value), value))
            pairs.append(pair)
    if "(" in text:
        pairs.extend(Pair(m[2], ",", m.start(2), m.end()) for m in _NAMED_ARGUMENT.finditer(text))
    pairs.sort(key=lambda p: (p.at, p.begin))
    return pairs


class _Reader:
    """Reads the values of pairs in turn; ``known`` names are assigned somewhere in the text."""

    def __init__(self, text: str, known: set[str]) -> None:
        self.text, self.known = text, known
        self.fences: deque[tuple[int, int]] = deque()  # literals and comments that were passed
        self.found: dict[str, int] = {}  # where a text is found next

    def next(self, what: str, at: int) -> int:
        """The first place of ``what`` from ``at`` on; the end of the text if there is none."""
        place = self.found.get(what, -1)
        if place < at:
            place = self.text.find(what, at)
            self.found[what] = place = len(self.text) if place < 0 else place
        return place

    def skip(self, at: int, end: int, lines: bool) -> int:
        """Behind blanks and comments, over line ends only if ``lines``."""
        text = self.text
        while at < end:
            c = text[at]
            if c in " \t" or (lines and c in "\r\n"):
                at += 1
            elif c == "\\" and text[at + 1 : at + 2] == "\n":
                at += 2
            elif c == "/" and text.startswith("/*", at) or c == "/" and lines and text.startswith("//", at) or c == "#" and lines and text[at - 1 : at].isspace():
                close = self.next("*/", at + 2) + 2 if text.startswith("/*", at) else self.next("\n", at)
                close = min(close, end)
                self.passed.append((at, close))
                at = close
            else:
                break
        return at

    def literal(self, at: int, end: int, pair: Pair) -> int:
        """Read a quoted literal at ``at`` into the pair; its end, or -1 if there is none."""
        text = self.text
        m = _OPEN.match(text, at, end)
        if m is None:
            return -1
        begin, quote, slashes, prefix = m.end(), m["quote"], m["slashes"], m["prefix"] or ""
        if slashes:
            mark = slashes + quote
            close = text.find(mark, begin, min(end, self.next("\n", begin)))
            while close > begin and text[close - 1] == "\\":
                close = text.find(mark, close + len(mark), min(end, self.next("\n", begin)))
            after = close + len(mark)
        elif len(quote) == 3:
            close = self.next(quote, begin)
            close = -1 if close + 3 > end else close
            after = close + 3
        else:
            content = (_RAW if quote != "`" and ("r" in prefix.lower() or "@" in prefix) else _CONTENT)[quote].match(text, begin, end)
            close = content.end() if content else -1
            if close >= 0 and close >= end:
                close = -1
            after = close + 1
        if close < 0:
            return -1
        self.keep(begin, close, pair, braces="f" in prefix.lower() or "$" in prefix or quote == "`")
        self.passed.append((begin, close))
        return after

    def keep(self, begin: int, end: int, pair: Pair, braces: bool = False) -> None:
        """Note a literal and what it refers to."""
        value = self.text[begin:end]
        if "$" in value or "{" in value or "%(" in value:
            rest, done = [], 0
            for m in _REFERENCE.finditer(value):
                name = m[m.lastgroup] if m.lastgroup != "default" else m["braced"]
                sure = m["plain"] is None and (value[m.start()] in "$%" or m[0].startswith("{{") or braces)
                if not sure and name not in self.known:
                    continue  # a part of the literal itself
                pair.uses.append(name)
                if m["default"]:
                    a, b = m.span("default")
                    pair.literals.append((begin + a, begin + b, m["default"]))
                rest.append(value[done : m.start()])
                done = m.end()
            if done:
                value = "".join([*rest, value[done:]])
        if "\n" in value:  # lines of one value, without the frames of key files
            value = "".join(x for x in map(str.strip, value.splitlines()) if not x.startswith("-----"))
        value = _ESCAPE.sub(r"\1", value)
        if value:
            pair.literals.append((begin, end, value))

    def block(self, at: int, pair: Pair) -> int:
        """A YAML block scalar: the lines that stand further in than the name's."""
        text = self.text
        top = text.rfind("\n", 0, pair.at) + 1
        indent = len(text[top : pair.at]) - len(text[top : pair.at].lstrip(" -"))
        begin, last = None, at
        while at < len(text):
            line = _LINE.match(text, at)[0]
            if line.strip():
                if len(line) - len(line.lstrip(" ")) <= indent:
                    break
                if begin is None:
                    begin = at + len(line) - len(line.lstrip())
                last = at + len(line.rstrip())
            at += len(line)
        if begin is not None:
            self.keep(begin, last, pair)
            self.passed.append((begin, last))
        return at

    def inside(self, at: int, end: int, pair: Pair, skip_first: bool) -> int:
        """Literals and constants of a bracket that was opened before ``at``; stops at a sign."""
        text, depth = self.text, 1
        while depth and at < end:
            at = self.skip(at, end, lines=True)
            if at >= end or text[at] in "=:;":
                break
            held, used = len(pair.literals), len(pair.uses)
            after = self.literal(at, end, pair)
            if after >= 0:
                follows = self.skip(after, end, lines=True)
                if skip_first or text[follows : follows + 1] in (":", "="):  # a key
                    del pair.literals[held:], pair.uses[used:]
                skip_first, at = False, follows
                continue
            word = _WORD.match(text, at, end)
            if word:
                at = self.skip(word.end(), end, lines=True)
                if text[at : at + 1] in ("=", ":"):
                    break
                self.use(word[0], pair)
                continue
            c = text[at]
            depth += (c in "([{") - (c in ")]}")
            at += 1
        return at

    def use(self, name: str, pair: Pair) -> bool:
        if name in self.known or name.rpartition(".")[2] in self.known:
            pair.uses.append(name)
            return True
        return False

    def term(self, at: int, end: int, pair: Pair, first: bool) -> int:
        """One term of a value; its end, or -1 if there is none."""
        text = self.text
        after = self.literal(at, end, pair)
        if after >= 0:
            return after
        if text[at : at + 1] in ("(", "[", "{"):
            m = _REFERENCE.match(text, at, end)
            if m is None:
                return self.inside(at + 1, end, pair, skip_first=False)
        m = _REFERENCE.match(text, at, end)
        if m is not None and m["plain"] is None:
            self.keep(at, m.end(), pair, braces=True)
            more = _BARE.match(text, m.end(), end)  # ${A}rest
            if more:
                self.keep(m.end(), more.end(), pair)
            return more.end() if more else m.end()
        if text[at : at + 1] in ("'", '"', "`"):
            at += 1  # never closed: what follows stands bare
        m = _BARE.match(text, at, end)
        if m is None:
            return -1
        stop, word = m.end(), m[0]
        follows = text[stop : stop + 1] if stop < end else ""
        if follows == "(":
            return self.inside(stop + 1, end, pair, skip_first=word.rpartition(".")[2].lower() in LOOKUPS)
        if follows == "[":
            return -1  # a look-up
        if _IDENTIFIER.match(word):
            if self.use(word, pair):
                return stop
            if not first or _JOIN.match(text, self.skip(stop, end, lines=False), end):
                return stop  # a constant from elsewhere
        self.keep(at, stop, pair)
        signs = [s.start() for s in _SIGN.finditer(text, at, stop)]  # each is read to the next one
        self.passed.extend(zip(signs, [*signs, stop][1:], strict=True))
        return stop

    def read(self, pair: Pair) -> None:
        """Read the value of a pair; pairs come in the order of the text."""
        text = self.text
        while self.fences and self.fences[0][1] <= pair.at:
            self.fences.popleft()
        end = self.fences[0][1] if self.fences and self.fences[0][0] <= pair.at else len(text)
        self.passed: list[tuple[int, int]] = []
        if pair.sign == ":" and (m := _BLOCK.match(text, pair.begin, end)):
            self.block(m.end(), pair)
        elif pair.sign != "<":
            at = self.skip(pair.begin, end, lines=False)
            beyond = self.skip(at, end, lines=True)
            if beyond > at:  # on a line of its own only if quoted, and no name itself
                after = self.literal(beyond, end, pair)
                if after >= 0 and text[self.skip(after, end, lines=False) :][:1] in (":", "="):
                    pair.literals, pair.uses, after = [], [], -1
                at = after
            else:
                at = self.term(at, end, pair, first=True)
            while 0 <= at < end:
                here = self.skip(at, end, lines=False)
                m = _JOIN.match(text, here, end) or _JOIN.match(text, here := self.skip(here, end, lines=True), end)
                if m is None:
                    break
                at = self.term(self.skip(m.end(), end, lines=True), end, pair, first=False)
        self.passed.sort()
        inner = self.passed
        while self.fences and inner and self.fences[0][0] < inner[-1][1] and self.fences[0][0] > pair.at:
            self.fences.popleft()  # read again as part of this value
        self.fences.extendleft(reversed(inner))


def _scopes(text: str) -> tuple[list[int], list[int], list[int]]:
    """Where each scope of the text takes over, which one, and each scope's parent."""
    begin, owner, parent = [0], [0], [-1]
    stack = [(-2, 0)]  # indents and scopes
    for m in _SCOPE.finditer(text):
        indent = len(m["indent"])
        if m["section"]:
            stack = [stack[0]]
        elif not m["closer"]:
            while stack[-1][0] >= indent:
                stack.pop()
        if stack[-1][1] != owner[-1]:
            begin.append(m.start())
            owner.append(stack[-1][1])
        if m["section"] or m["header"]:
            parent.append(stack[-1][1])
            stack.append((-1 if m["section"] else indent, len(parent) - 1))
            line = text.find("\n", m.end())
            begin.append(len(text) if line < 0 else line)  # its own line is outside
            owner.append(len(parent) - 1)
    return begin, owner, parent


def best_scores(text: str, pairs: list[Pair]) -> list[float]:
    """Of each pair, the best score of its own name and all that its value reaches."""
    own = [name_score(p.name) for p in pairs]
    if not any(p.uses for p in pairs):
        return own
    begin, owner, parent = _scopes(text)
    scope = [owner[bisect_right(begin, p.at) - 1] for p in pairs]
    held: dict[tuple[int, str], list[int]] = {}  # assignments by scope and name; -1 is any scope
    for k, p in enumerate(pairs):
        for name in {p.name, p.name.rpartition(".")[2]}:
            held.setdefault((scope[k], name), []).append(k)
            held.setdefault((-1, name), []).append(k)

    def meant(k: int, name: str) -> tuple[int, str]:
        for n in (name, name.rpartition(".")[2]):
            s = scope[k]
            while s >= 0:
                if (s, n) in held:
                    return s, n
                s = parent[s]
        return -1, name if (-1, name) in held else name.rpartition(".")[2]

    best: list[float | None] = [None] * len(pairs)
    passed: set[tuple[int, str]] = set()
    for k in sorted(range(len(pairs)), key=own.__getitem__, reverse=True):  # what is reached first is reached best
        if best[k] is not None:
            continue
        best[k], queue = own[k], [k]
        while queue:
            j = queue.pop()
            for name in pairs[j].uses:
                node = meant(j, name)
                if node not in passed:
                    passed.add(node)
                    fresh = [i for i in held.get(node, ()) if best[i] is None]
                    for i in fresh:
                        best[i] = own[k]
                    queue.extend(fresh)
    return best


def _named_values(text: str, pairs: list[Pair]) -> None:
    """Give ``name: X`` beside ``value: Y`` the name X."""
    for one, two in zip(pairs, pairs[1:], strict=False):
        if two.name.lower() in ("value", "default") and one.name.lower() in ("name", "key") and len(one.literals) == 1:
            begin, end, value = one.literals[0]
            if end <= two.at and not text[end : two.at].strip(" \t\r\n\"',;").removesuffix(two.name).strip(" \t\r\n\"',;-"):
                two.name = value


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name, directly or through constants."""
    pairs = find_pairs(text)
    if not pairs:
        return []
    indirect = any(p.name.lower() in ("value", "default") for p in pairs)
    if not indirect and max(name_score(p.name) for p in pairs) + BEST_FORM < THRESHOLD:
        return []  # no literal can reach the threshold
    names = {p.name for p in pairs}
    reader = _Reader(text, names | {n.rpartition(".")[2] for n in names})
    for pair in pairs:
        reader.read(pair)
    if indirect:
        _named_values(text, pairs)
    score: dict[tuple[int, int], float] = {}
    for pair, best in zip(pairs, best_scores(text, pairs), strict=True):
        for begin, end, value in pair.literals:
            if best + BEST_FORM >= THRESHOLD:
                score[begin, end] = max(score.get((begin, end), -9.0), best + form_score(value))
    return [(a, b, "lexed") for (a, b), s in sorted(score.items()) if s >= THRESHOLD - 1e-9]


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """All spans as (start, end, kind), by start, then kind, then end."""
    return sorted(base_spans(text) + lexed_spans(text), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b} for a, b, k in find_spans(t or "")] for t in batch.column("text").to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)`` with the kind, start and end of every span."""
    return documents(docs).mapInArrow(_span_rows, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def redact(text: str | None, mask: str = "[secret]") -> str | None:
    """The text with each stretch of spans replaced by the mask."""
    if not text:
        return text
    out, done = [], 0
    for a, b, _ in find_spans(text):
        if a >= done:
            out.extend((text[done:a], mask))
        done = max(done, b)
    return "".join([*out, text[done:]]) if out else text


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[], [], []]
        digests, joined = [], []
        for text in batch.column("text").to_pylist():
            spans = find_spans(text or "")
            names = [f"{k}:{a}:{b}" for a, b, k in spans]
            base = [x for x, s in zip(names, spans, strict=True) if s[2] != "lexed"]
            for k in range(3):
                counts[k].append(sum(s[2] == KINDS[k] for s in spans))
            digests.append(hashlib.sha256(",".join(base).encode()).hexdigest())
            joined.append(",".join(names))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(joined, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return documents(read_table(spark, sf_dir, "documents")).mapInArrow(_digest_rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
