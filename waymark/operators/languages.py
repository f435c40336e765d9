"""Rules of languages, as rows: how their text splits into tokens, and which tokens declare or refer to names."""

from __future__ import annotations

from dataclasses import dataclass

#: A string on one line with backslash escapes, closed or not.
_QUOTED = r'"(?:[^"\\\n]++|\\.)*+"?'
_SINGLE = r"'(?:[^'\\\n]++|\\.)*+'?"


@dataclass(frozen=True)
class Rule:
    """``word name`` declares a name of these node types; its braces are a scope, and with ``body`` it counts only if it has them."""

    word: str
    kinds: tuple[str, ...] = ()
    scope: bool = True
    body: bool = False


@dataclass(frozen=True)
class Language:
    """One language.

    ``headers`` tells, by declaring word and word or sign within its head, as what
    the names that follow are referred to.  ``calls`` and ``member_calls`` are
    the node types of ``name(`` and ``.name(``.  ``methods`` says how methods
    without a declaring word look: ``braced`` as ``name(...) {``, ``typed`` as
    ``type name(...)`` within a class, ``declared`` as the same outside of
    functions.
    """

    name: str
    suffixes: tuple[str, ...]
    rules: tuple[Rule, ...] = ()
    keywords: str = ""
    calls: str | None = None
    member_calls: str | None = None
    created: str | None = None
    creators: str = "new"
    headers: tuple[tuple[str, str, str], ...] = ()
    methods: str | None = None
    method_kinds: tuple[str, ...] = ("method",)
    not_methods: tuple[str, ...] = ()
    #: ``name = function`` and ``name: (...) =>`` define functions, a slash may start a pattern, a backtick a template.
    script: bool = False
    #: How types are told: ``annotated`` by a colon, ``placed`` by their place after a name.
    types: str | None = None
    literals: tuple[str, ...] = (_QUOTED, _SINGLE)
    comments: tuple[str, ...] = (r"//[^\n]*+",)
    nested_comments: bool = False


_SCRIPT_WORDS = "if for while switch catch with return typeof case in of delete void throw new else do await yield super import export default instanceof function class extends const let var try finally async static get set"
_C_WORDS = "if for while switch return sizeof do else case goto break continue typedef struct union enum static inline extern const volatile unsigned signed register"
_CPP_WORDS = _C_WORDS + " catch throw new delete namespace class public private protected virtual override using template typename operator explicit friend constexpr noexcept decltype alignof static_assert try default"
_JAVA_WORDS = "if for while switch catch return new throw else do try finally synchronized assert case instanceof super this import package public private protected static final abstract native default void int long double float boolean char byte short extends implements throws class interface enum record"
_GO_WORDS = "if for switch select case default return go defer range func type struct interface map chan var const package import else break continue goto fallthrough"
_RUST_WORDS = "if for while match loop return let mut in as else move ref fn struct enum union trait impl mod use pub crate self super where unsafe async await const static type dyn extern break continue"
_KOTLIN_WORDS = "if for while when return throw try catch finally else do is in as fun val var class object interface import package this super null constructor init"
_CS_WORDS = _JAVA_WORDS + " namespace using foreach lock using out ref in is as string object decimal var get set where async await override virtual sealed readonly partial internal struct bool nameof typeof base"
_SOLIDITY_WORDS = "if for while return returns emit require revert assert new mapping function modifier event constructor contract interface library struct enum is public private internal external view pure payable memory storage calldata import using else do"
_SCALA_WORDS = "if for while match case def val var class object trait enum extends with new import package return yield else do try catch finally given type this super throw override private protected final lazy implicit"
_PHP_WORDS = "if for foreach while switch catch return new echo print isset unset empty list array match fn function class interface trait namespace use extends implements public private protected static final abstract else elseif do try finally throw case instanceof exit die"

# Node types of definitions and references, by language.
LANGUAGES = (
    Language(
        "javascript", (".js", ".jsx", ".mjs", ".cjs"), (Rule("class", ("class",)), Rule("function", ("function",))), _SCRIPT_WORDS + " require",
        calls="call", member_calls="call", created="class", methods="braced", not_methods=("constructor",), script=True,
    ),
    Language(
        "typescript", (".ts", ".tsx"),
        (Rule("class", ("class",)), Rule("function", ("function",)), Rule("interface", ("interface", "class")), Rule("enum", ("enum",)), Rule("type", ("type",), scope=False), Rule("namespace", ("module",)), Rule("module", ("module",))),
        _SCRIPT_WORDS + " implements", created="class", methods="braced", script=True, types="annotated",
    ),
    Language(
        "go", (".go",), (Rule("func", ("function",)), Rule("type", ("type",)), Rule("package", ("module",), scope=False), Rule("var", ("variable",), scope=False), Rule("const", ("constant",), scope=False)), _GO_WORDS,
        calls="call", member_calls="call", types="placed", literals=(_QUOTED, r"'(?:[^'\\\n]++|\\.)*+'?", r"`[^`]*+`?"),
    ),
    Language(
        "java", (".java",), (Rule("class", ("class",)), Rule("interface", ("interface",)), Rule("enum"), Rule("record")), _JAVA_WORDS,
        calls="method", member_calls="method", created="class", methods="typed", literals=(r'"""(?:(?:[^\\]|\\.)*?"""|.*+)', _QUOTED, _SINGLE),
        headers=(("class", "extends", "class"), ("class", "implements", "interface"), ("interface", "extends", "interface"), ("enum", "implements", "interface"), ("record", "implements", "interface")),
    ),
    Language(
        "rust", (".rs",),
        (Rule("fn", ("function",), body=True), Rule("struct", ("class",)), Rule("enum", ("class",)), Rule("union", ("class",)), Rule("type", ("class",), scope=False), Rule("trait", ("interface",)), Rule("mod", ("module",)), Rule("macro_rules", ("macro",), scope=False), Rule("impl")),
        _RUST_WORDS, calls="call", member_calls="call", literals=(r'b?r(?P<hashes>\#*)"(?:.*?"(?P=hashes)|.*+)', _QUOTED.replace(r"\n", ""), r"'(?:\\(?:u\{[0-9a-fA-F_]*\}|x..|.)|[^'\\\n])'"), nested_comments=True,
    ),
    Language("c", (".c", ".h"), (Rule("struct", ("class",), body=True), Rule("union", ("class",), body=True), Rule("enum", ("type",), scope=False)), _C_WORDS, methods="declared", method_kinds=("function",), comments=(r"//[^\n]*+", r"\#(?:[^\n\\]++|\\.)*+")),
    Language(
        "cpp", (".cc", ".cpp", ".cxx", ".hpp", ".hh", ".ino"), (Rule("struct", ("class",), body=True), Rule("class", ("class",)), Rule("union", ("class",), body=True), Rule("enum", ("type",), scope=False), Rule("namespace")), _CPP_WORDS,
        methods="declared", method_kinds=("function",), literals=(r'R"(?P<mark>[^()\\\s]{0,16})\((?:.*?\)(?P=mark)"|.*+)', _QUOTED, _SINGLE), comments=(r"//[^\n]*+", r"\#(?:[^\n\\]++|\\.)*+"),
    ),
    Language(
        "csharp", (".cs",), (Rule("class", ("class",)), Rule("interface", ("interface",)), Rule("namespace", ("module",)), Rule("struct"), Rule("enum"), Rule("record")), _CS_WORDS,
        member_calls="send", created="class", methods="typed", headers=(("class", ":", "class"), ("interface", ":", "interface")), literals=(r'[$@]*@[$@]*"(?:[^"]|"")*+"?', r'"""(?:.*?"""|.*+)', _QUOTED, _SINGLE), comments=(r"//[^\n]*+", r"\#[^\n]*+"),
    ),
    Language(
        "kotlin", (".kt", ".kts"), (Rule("class", ("class",)), Rule("interface", ("class",)), Rule("object", ("object",)), Rule("fun", ("function",))), _KOTLIN_WORDS,
        calls="call", member_calls="call", headers=(("class", ":", "type"), ("interface", ":", "type"), ("object", ":", "type")), literals=(r'"""(?:.*?"""|.*+)', _QUOTED, _SINGLE), nested_comments=True,
    ),
    Language(
        "solidity", (".sol",), (Rule("contract", ("class",)), Rule("interface", ("interface",)), Rule("library", ("class",)), Rule("struct", ("class",)), Rule("enum", ("class",), scope=False), Rule("event", ("class",), scope=False), Rule("function", ("function",))), _SOLIDITY_WORDS,
        calls="call", member_calls="method", created="class", creators="new emit", headers=(("contract", "is", "class"), ("interface", "is", "class")),
    ),
    Language(
        "scala", (".scala", ".sc"), (Rule("class", ("class",)), Rule("trait", ("interface",)), Rule("object", ("object",)), Rule("enum", ("enum",)), Rule("def", ("function",)), Rule("val", ("variable",), scope=False), Rule("var", ("variable",), scope=False), Rule("type", ("type",), scope=False)), _SCALA_WORDS,
        calls="call", headers=(("class", "extends", "class"), ("object", "extends", "class"), ("trait", "extends", "class")), literals=(r'"""(?:.*?"""|.*+)', _QUOTED, r"'(?:[^'\\\n]|\\.)'"), nested_comments=True,
    ),
    Language(
        "php", (".php",), (Rule("class", ("class",)), Rule("interface"), Rule("trait"), Rule("function", ("function",))), _PHP_WORDS, calls="call", member_calls="call", created="class",
        literals=(_QUOTED.replace(r"\n", ""), _SINGLE.replace(r"\n", "")), comments=(r"//[^\n]*+", r"\#(?!\[)[^\n]*+"),
    ),
)

BY_SUFFIX = {suffix: language for language in LANGUAGES for suffix in language.suffixes}
BY_NAME = {language.name: language for language in LANGUAGES}
