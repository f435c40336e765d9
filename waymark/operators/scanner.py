"""Tags of code in many languages: one scanner, driven by the rows of ``languages``.

A text is split into tokens by an automaton whose states are code and template
(strings and comments are single tokens that run to their end or the end of the
line or text, so nothing in them is taken for code).  A stack of open brackets
carries the scopes: a brace that belongs to a declaration opens its scope, the
matching one closes it; a closing bracket closes what stands open above its
partner, and one without a partner is passed over.  Every token is looked at a
bounded number of times, so time is linear in the text, whatever its lines and
brackets are like.

Names are told by their surroundings, not by a grammar.  Known limits: types of
values are seen where the rules name them (TypeScript after a colon, Go after a
name, ``*``, ``]`` or before a brace); function values without braces open no
scope; code within templates counts, code within other interpolated strings does
not; and macros and conditional compilation are read as they stand.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from waymark.operators.languages import Language, Rule

_PAIRS = {")": "(", "]": "[", "}": "{"}
#: What may stand before a pattern of a script, apart from words.
_BEFORE_PATTERN = set("(,=:[!&|?{};+-*%~^<>")
_CLASSES = {"class", "interface", "enum", "record", "struct", "trait", "object", "contract", "library", "union", "impl", "namespace", "mod"}


@dataclass(slots=True)
class Token:
    text: str
    kind: str  # id, text (a literal), number or sign
    line: int
    start: int
    #: Of a bracket: the token of its partner, -1 without one.
    other: int = -1


@lru_cache(maxsize=64)
def _patterns(language: Language) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Tokens of code, the rest of a template, and a script's pattern."""
    block = r"/\*" if language.nested_comments else r"/\*(?:.*?\*/|.*+)"
    parts = [
        r"(?P<space>\s++)",
        f"(?P<comment>{'|'.join([*language.comments, block])})",
        f"(?P<text>{'|'.join(language.literals)})",
        r"(?P<number>\d(?:\w|\.\d)*+)",
        r"(?P<id>[$@]?[^\W\d][\w$]*+)" if language.name == "php" else r"(?P<id>(?:[^\W\d]|\$)[\w$]*+)",
        r"(?P<sign>=>|->|::|:=|\?\.|\.\.\.|==+|!=+|<=|>=|&&|\|\||.)",
    ]
    return re.compile("|".join(parts), re.S), re.compile(r"(?:[^`\\$]++|\\.?|\$(?!\{))*+(`|\$\{|\Z)", re.S), re.compile(r"/(?![*/])(?:[^/\\\[\n]++|\\[^\n]|\[(?:[^\]\\\n]++|\\[^\n])*+\])++/\w*+")


_COMMENT_ENDS = re.compile(r"/\*|\*/")


def _nested_end(code: str, at: int) -> int:
    """Where the comment that opens at ``at`` ends, comments within it included."""
    depth = 0
    for m in _COMMENT_ENDS.finditer(code, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(code)


def tokens(code: str, language: Language) -> list[Token]:
    """The tokens of a text without space and comments, brackets with their partners."""
    plain, template, pattern = _patterns(language)
    keywords = set(language.keywords.split())
    out: list[Token] = []
    at, line, counted, no_pattern = 0, 1, 0, 0
    templates: list[int] = []  # open braces within each template's code
    in_template = False
    while at < len(code):
        if in_template:
            m = template.match(code, at)
            at, in_template = m.end(), False
            if m[1] == "${":
                templates.append(0)
            continue
        m = plain.match(code, at)
        kind, text, start = m.lastgroup, m[0], at
        at = m.end()
        if kind == "comment":
            if language.nested_comments and text == "/*":
                at = _nested_end(code, start)
            continue
        if kind == "space":
            continue
        if kind not in ("id", "number", "sign"):
            kind = "text"
        elif kind == "sign" and language.script:
            if text == "`":
                in_template, kind = True, "text"
            elif text == "/" and start >= no_pattern:
                before = out[-1] if out else None
                if before is None or (before.text in keywords if before.kind == "id" else before.kind == "sign" and (before.text[-1] in _BEFORE_PATTERN)):
                    found = pattern.match(code, start)
                    if found:
                        at, kind = found.end(), "text"
                    else:
                        # nothing on this line closes a pattern
                        no_pattern = code.find("\n", start) % (len(code) + 1)
            elif templates and text == "{":
                templates[-1] += 1
            elif templates and text == "}":
                if not templates[-1]:
                    templates.pop()
                    in_template = True
                    continue
                templates[-1] -= 1
        line += code.count("\n", counted, start)
        counted = start
        out.append(Token(text, kind, line, start))
    _pair(out)
    return out


def _pair(out: list[Token]) -> None:
    open_: list[int] = []
    count = dict.fromkeys("([{", 0)
    for i, token in enumerate(out):
        if token.kind != "sign":
            continue
        if token.text in count:
            open_.append(i)
            count[token.text] += 1
        elif token.text in _PAIRS and count[_PAIRS[token.text]]:
            while True:
                j = open_.pop()
                count[out[j].text] -= 1
                if out[j].text == _PAIRS[token.text]:
                    out[j].other, token.other = i, j
                    break


@dataclass
class Scope:
    name: str
    line: int


@dataclass(slots=True)
class Open:
    """An open bracket: its token, the scope it opens, and what it is the body of."""

    at: int
    scope: Scope | None = None
    body: str = ""
    questions: int = 0


@dataclass
class Pending:
    """A declaration whose body has not come yet."""

    rule: Rule
    scope: Scope | None
    depth: int
    tags: list[tuple[int, str]] = field(default_factory=list)
    header: str | None = None
    angles: int = 0
    trait: int = -1
    target: int = -1


class _Reader:
    """One pass over the tokens of a text."""

    def __init__(self, code: str, language: Language, enclosing: bool):
        self.language, self.enclosing = language, enclosing
        self.t = tokens(code, language)
        self.rules = {r.word: r for r in language.rules}
        self.keywords = set(language.keywords.split()) | self.rules.keys()
        self.headers = {(a, b): c for a, b, c in language.headers}
        self.creators = language.creators.split() if language.created else []
        self.open: list[Open] = []
        self.scopes: list[Scope] = []
        self.bodies: dict[int, tuple[Scope, str]] = {}
        self.pending: Pending | None = None
        self.taken: set[int] = set()
        self.out: list[dict] = []

    # -- tokens --

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "id" and self.t[i].text not in self.keywords

    def closing(self, i: int) -> int:
        """The token after the bracket that closes the one at ``i``; past the end without one."""
        return self.t[i].other + 1 if 0 <= i < len(self.t) and self.t[i].other >= 0 else len(self.t)

    # -- results --

    def tag(self, i: int, kind: str, node_type: str) -> None:
        if kind == "def" or self.enclosing:
            owner = self.scopes[-1] if self.scopes else None
        else:
            owner = self.scopes[-2] if len(self.scopes) > 1 else None
        self.out.append({"line": self.t[i].line, "name": self.t[i].text, "kind": kind, "node_type": node_type, "parent_name": owner.name if owner else None, "parent_line": owner.line if owner else None, "signature": None, "fields": None})

    def scope_of(self, i: int) -> Scope:
        return Scope(self.t[i].text, self.t[i].line)

    def read(self) -> list[dict]:
        for i, token in enumerate(self.t):
            if token.kind == "sign":
                self.sign(i, token.text)
            elif token.kind == "id":
                self.word(i, token.text)
        return self.out

    # -- signs --

    def sign(self, i: int, text: str) -> None:
        pending = self.pending
        here = pending is not None and pending.depth == len(self.open)
        if text in "([{":
            entry = Open(i)
            if text == "{":
                if i in self.bodies:
                    entry.scope, entry.body = self.bodies.pop(i)
                elif here and self.is_body(i, pending):
                    self.finish(pending)
                    entry.scope, entry.body = pending.scope if pending.rule.scope else None, pending.rule.word
                    self.pending = None
            self.open.append(entry)
            if entry.scope:
                self.scopes.append(entry.scope)
        elif text in _PAIRS:
            if self.t[i].other >= 0:
                while True:
                    entry = self.open.pop()
                    if entry.scope:
                        self.scopes.pop()
                    if entry.at == self.t[i].other:
                        break
                if pending and pending.depth > len(self.open):
                    self.pending = None
        elif text == "?" and self.open:
            self.open[-1].questions += self.text(i + 1) not in (":", ",", ")", ".", ";")
        elif text == ":":
            self.colon(i, here)
        elif here and text in ("<", ">"):
            pending.angles += 1 if text == "<" else -1
        elif here and text in (";", "=", "=>"):
            if text == "=" and pending.rule.scope and self.text(i + 1) == "{":
                self.bodies[i + 1] = (pending.scope, pending.rule.word)
            self.pending = None

    def is_body(self, i: int, pending: Pending) -> bool:
        before = self.text(i - 1)
        if pending.rule.word == "type":
            return before in ("struct", "interface")
        return not (pending.rule.word in ("func", "function", "fn") and before in (":", "|", "struct", "interface"))

    def finish(self, pending: Pending) -> None:
        """A declaration has its body."""
        for i, node_type in pending.tags:
            self.tag(i, "def", node_type)
        if pending.rule.word == "impl":
            self.implementation(pending)

    def colon(self, i: int, here: bool) -> None:
        if here and (self.pending.rule.word, ":") in self.headers:
            self.pending.header = self.headers[self.pending.rule.word, ":"]
        if self.open and self.open[-1].questions:
            self.open[-1].questions -= 1
        elif self.language.types == "annotated" and self.is_name(i + 1) and self.annotates(i) and self.text(i + 1) not in ("string", "number", "boolean", "any", "void", "unknown", "never", "object", "symbol", "bigint", "undefined", "null"):
            self.tag(i + 1, "ref", "type")

    def annotates(self, i: int) -> bool:
        """A colon before a type: after a list of parameters, in one, in a class or after a declared variable."""
        before = self.text(i - 1)
        if before == ")":
            return True
        entry = self.open[-1] if self.open else None
        if entry and self.text(entry.at) == "(":
            after = self.text(self.closing(entry.at))
            return after in ("{", ":", "=>", ";")
        return bool(entry and entry.body in ("class", "interface")) or self.text(i - 2) in ("let", "const", "var")

    # -- words --

    def word(self, i: int, text: str) -> None:
        before = self.text(i - 1)
        member = before in (".", "?.", "->", "::")
        pending = self.pending if self.pending and self.pending.depth == len(self.open) else None
        if pending and (pending.rule.word, text) in self.headers:
            pending.header = self.headers[pending.rule.word, text]
            return
        if text in self.rules and not member and self.declares(i, self.rules[text]):
            return
        if pending and pending.rule.word == "impl":
            self.in_impl(i, text, pending)
            return
        if text in self.creators and self.is_name(i + 1) and self.text(i + 2) not in (".", "::"):
            self.tag(i + 1, "ref", self.language.created)
            self.taken.add(i + 1)
            return
        if i in self.taken or text in self.keywords:
            return
        if pending and pending.header and not pending.angles and not member and self.text(i + 1) not in ("<", ".", "::"):
            self.tag(i, "ref", pending.header)
            return
        if self.language.script and self.function_value(i):
            return
        after = self.text(i + 1)
        if after == "(":
            if not self.method(i, member):
                self.call(i, before, member)
        elif after == "!" and self.language.name == "rust" and self.text(i + 2) in ("(", "[", "{"):
            self.tag(i, "ref", self.language.calls)
        elif self.language.types == "placed":
            self.placed_type(i, before, after)

    def declares(self, i: int, rule: Rule) -> bool:
        """``word name``; True if that is a declaration."""
        j = i + 1
        kinds = rule.kinds
        if self.text(i) == "func" and self.text(j) == "(":
            j, kinds = self.closing(j), ("method",)
        elif self.text(j) in ("*", "!"):
            j += 1
        if rule.word in ("enum", "record", "class") and self.text(j) in ("class", "struct"):
            j += 1
        if rule.word == "impl":
            self.pending = Pending(rule, None, len(self.open))
            return True
        if rule.word in ("var", "const", "type") and self.language.types == "placed":
            return self.declared_values(j, rule)
        if not self.is_name(j) or (rule.word in ("type", "module", "namespace") and self.language.script and self.text(j + 1) not in ("=", "<", "{", ".")):
            return False
        self.taken.add(j)
        if rule.word == "fn" and self.open and self.open[-1].body in ("impl", "trait", "mod"):
            kinds = ("method", *kinds)
        if rule.body:
            tags = [(j, k) for k in kinds]
        else:
            tags = []
            for k in kinds:
                self.tag(j, "def", k)
        # a function without braces, or one of a head such as "struct A *f()", has no body
        self.pending = Pending(rule, self.scope_of(j), len(self.open), tags)
        return True

    def declared_values(self, j: int, rule: Rule) -> bool:
        """Names after ``var``, ``const`` and ``type``, single or in brackets, one a line."""
        group = self.text(j) == "("
        end = self.closing(j) if group else len(self.t)
        k = j + 1 if group else j
        first = True
        while k < end and self.is_name(k) and (first or self.t[k].line != self.t[k - 1].line):
            first = False
            while True:
                self.value(k, rule)
                if self.text(k + 1) != "," or rule.word == "type" or not self.is_name(k + 2):
                    break
                k += 2
            if not group:
                break
            # on to the next line that is not within brackets
            line = self.t[k].line
            while k < end - 1 and (self.t[k].line == line or self.t[k].kind == "sign" and self.t[k].text in "([{"):
                if self.t[k].kind == "sign" and self.t[k].text in "([{":
                    k = self.closing(k) - 1
                    line = self.t[k].line if k < len(self.t) else line
                k += 1
        return True

    def value(self, k: int, rule: Rule) -> None:
        self.taken.add(k)
        if rule.word != "type":
            self.tag(k, "def", rule.kinds[0])
            return
        kind = {"struct": "class", "interface": "interface"}.get(self.text(k + 1))
        self.tag(k, "def", "type")
        if kind:
            self.tag(k, "def", kind)
            if self.text(k + 2) == "{":
                self.bodies[k + 2] = (self.scope_of(k), "type")
        self.tag(k, "ref", "type")

    def in_impl(self, i: int, text: str, pending: Pending) -> None:
        if pending.angles:
            return
        if text == "for":
            pending.trait, pending.target = pending.target, -1
        elif text == "where":
            pending.header = "where"
        elif pending.header is None and text not in ("dyn", "mut", "const", "unsafe"):
            pending.target = i

    def implementation(self, pending: Pending) -> None:
        found = pending.target if pending.trait < 0 else pending.trait
        if found >= 0 and self.text(found - 1) != "::" and self.text(found + 1) != "<":
            self.tag(found, "ref", "implementation")
        if pending.target >= 0:
            pending.scope = self.scope_of(pending.target)

    def function_value(self, i: int) -> bool:
        """``name = function``, ``name: (...) =>`` and the like."""
        if self.text(i + 1) not in ("=", ":"):
            return False
        j = i + 2
        j += self.text(j) == "async"
        if self.text(j) == "function":
            j += 1
            j += self.text(j) == "*"
            j += self.is_name(j)
            body = self.closing(j) if self.text(j) == "(" else len(self.t)
        else:
            j = self.closing(j) if self.text(j) == "(" else j + 1 if self.is_name(j) else len(self.t)
            if self.text(j) != "=>":
                return False
            body = j + 1
        if self.language.name == "javascript":
            self.tag(i, "def", "function")
        if self.text(body) == "{":
            self.bodies[body] = (self.scope_of(i), "function")
        return True

    def method(self, i: int, member: bool) -> bool:
        """A method or function that no word declares."""
        style = self.language.methods
        entry = self.open[-1] if self.open else None
        after = self.closing(i + 1)
        if style == "braced" and not member and self.text(i - 1) != "new":
            in_class = entry is not None and entry.body in ("class", "interface")
            if self.text(after) == "{" or (in_class and self.text(after) in (":", ";") and self.text(i - 1) != "="):
                if self.text(i) not in self.language.not_methods:
                    self.tag(i, "def", "method")
                if self.text(after) == "{":
                    self.bodies[after] = (self.scope_of(i), "method")
                elif self.text(after) == ":":
                    self.pending = Pending(Rule("method"), self.scope_of(i), len(self.open))
                return True
        elif style in ("typed", "declared"):
            before = self.t[i - 1] if i else None
            typed = before is not None and (before.text in (">", "]", "*", "&", "?") or before.kind == "id" and before.text not in ("return", "new", "else", "throw", "case", "goto", "delete", "await", "yield", "public", "private", "protected", "static", "final", "abstract", "override", "virtual", "explicit", "inline"))
            in_class = entry is not None and entry.body in _CLASSES
            if style == "typed" and in_class and entry.scope and entry.scope.name == self.text(i) and self.text(i - 1) != "new":
                if self.text(after) == "{":  # a constructor
                    self.bodies[after] = (self.scope_of(i), "method")
                return True
            kinds = self.language.method_kinds
            if style == "typed":
                found = in_class and entry.body not in ("namespace",) and typed and not member
            else:
                if member and self.text(i - 1) == "::":
                    kinds = ("method",)
                    typed = self.is_name(i - 2) and (i > 2 and (self.t[i - 3].kind == "id" or self.t[i - 3].text in (">", "*", "&")) or self.text(after) in ("{", ":"))
                elif in_class and entry.body != "namespace":
                    typed = typed or self.text(i - 1) in ("{", "}", ";", "explicit", "inline") or (self.text(i - 1) == ":" and self.text(i - 2) in ("public", "private", "protected"))
                found = (entry is None or in_class) and not (self.pending and self.pending.depth == len(self.open)) and typed and self.text(after) in ("{", ";", "const", "noexcept", "override", ":", "=", "->")
            if found:
                for kind in kinds:
                    self.tag(i, "def", kind)
                if self.text(after) == "{":
                    self.bodies[after] = (self.scope_of(i), "method")
                elif self.text(after) != ";":
                    self.pending = Pending(Rule("method"), self.scope_of(i), len(self.open))
                return True
        return False

    def call(self, i: int, before: str, member: bool) -> None:
        kind = self.language.member_calls if member else self.language.calls
        if not kind or before in ("@", "function") or (before == "::" and self.language.name == "rust") or (self.open and self.open[-1].body == "type"):
            return
        if self.language.name == "rust" and (before == "let" or self.text(self.closing(i + 1)) in ("=>", "=", "|")):
            return  # a pattern
        self.tag(i, "ref", kind)

    def placed_type(self, i: int, before: str, after: str) -> None:
        """Go: a name is a type after a name or ``]``, after ``*`` set like one, as a map's key, as a result, and before a brace."""
        t = self.t
        if i and t[i - 1].line != t[i].line and before not in ("(", ",", "]"):
            return
        close = i and t[i - 1].start + len(before) == t[i].start
        pending = self.pending
        if self.is_name(i - 1) or (before == "]" and close) or (before == "*" and close and t[i - 2].start + len(t[i - 2].text) < t[i - 1].start or before == "*" and self.text(i - 2) in ("(", "]", ",", "*")):
            found = True
        elif before == "[" and self.text(i - 2) == "map":
            found = True
        elif before == ")" and self.open and self.open[-1].body == "type":
            found = True
        elif before in (")", "(", ",") and pending and pending.rule.word == "func":
            # the result, or results in brackets
            inner = self.open[-1].at if self.open else -1
            found = before == ")" or (inner > 0 and self.text(inner - 1) == ")" and after in (",", ")", "."))
        else:
            found = after == "{" and before in ("&", "=", ":=", "(", ",", "return", "[", ":", "{")
        if found and after == "." and self.is_name(i + 2):
            self.taken.add(i + 2)
            self.tag(i + 2, "ref", "type")
        elif found:
            self.tag(i, "ref", "type")


def code_tags(code: str, language: Language, enclosing: bool = False) -> list[dict]:
    """Tags of one text, in its order; ``enclosing`` as for Python."""
    return _Reader(code, language, enclosing).read()
