"""The scanner: languages beyond the rendered samples, odd texts, and linear time on hostile ones."""

import random
import time

import pytest

from waymark.operators import extract
from waymark.operators.languages import BY_NAME, LANGUAGES
from waymark.operators.scanner import code_tags, tokens
from waymark.sources import files


def short(name, code):
    return [(t["line"], t["kind"], t["node_type"], t["name"], t["parent_name"]) for t in code_tags(code, BY_NAME[name], enclosing=True)]


def test_c_and_cpp():
    assert short("c", '#define F(x) int g(x) { }\nstruct p { int x; };\nstatic int add(int a) {\n return sub(a);\n}\nchar *name(void);\nenum color { RED };\nstruct p q;') == [
        (2, "def", "class", "p", None), (3, "def", "function", "add", None), (6, "def", "function", "name", None), (7, "def", "type", "color", None)]
    assert short("cpp", 'namespace n { class A : public B { public: A(int x) : y(x) { f(); } int get() const { return R"q(int no() { )q"; } }; }\nint A::go(int q) { return 1; }') == [
        (1, "def", "class", "A", "n"), (1, "def", "function", "A", "A"), (1, "def", "function", "get", "A"), (2, "def", "method", "go", None)]


def test_other_brace_languages():
    assert short("csharp", 'namespace N {\nclass A : B, IC {\n public int F(int x) => this.G(x);\n void H() { var q = new Z(@"a"" { "); a.Send(); } } }') == [
        (1, "def", "module", "N", None), (2, "def", "class", "A", "N"), (2, "ref", "class", "B", "N"), (2, "ref", "class", "IC", "N"), (3, "def", "method", "F", "A"), (3, "ref", "send", "G", "A"), (4, "def", "method", "H", "A"), (4, "ref", "class", "Z", "H"), (4, "ref", "send", "Send", "H")]
    assert short("kotlin", "class A(val x: Int) : B(), C {\n fun f(y: Int): Int { return g(y).h() } }\nobject O { }") == [
        (1, "def", "class", "A", None), (1, "ref", "type", "B", None), (1, "ref", "type", "C", None), (2, "def", "function", "f", "A"), (2, "ref", "call", "g", "f"), (2, "ref", "call", "h", "f"), (3, "def", "object", "O", None)]
    assert short("solidity", "contract A is B { event E(uint x);\n function f(uint a) public returns (uint) { emit E(a); return g(a); } }") == [
        (1, "def", "class", "A", None), (1, "ref", "class", "B", None), (1, "def", "class", "E", "A"), (2, "def", "function", "f", "A"), (2, "ref", "class", "E", "f"), (2, "ref", "call", "g", "f")]
    assert short("scala", "class A extends B { def f(x: Int): Int = { g(x) }\n val y = 1 }\nobject O") == [
        (1, "def", "class", "A", None), (1, "ref", "class", "B", None), (1, "def", "function", "f", "A"), (1, "ref", "call", "g", "f"), (2, "def", "variable", "y", "A"), (3, "def", "object", "O", None)]
    assert short("php", "<?php class A { function f($x) { return g($x)->h(new B()); } } # c { \nfunction top() {}") == [
        (1, "def", "class", "A", None), (1, "def", "function", "f", "A"), (1, "ref", "call", "g", "f"), (1, "ref", "call", "h", "f"), (1, "ref", "class", "B", "f"), (2, "def", "function", "top", None)]


def test_unbalanced_brackets():
    """What is closed twice or never closes hides no later definition, and scopes end with what encloses them."""
    assert short("javascript", "function a() { if (x { b(); }\n}\n} )\nfunction c() { d(] ); }\nfunction e() { (") == [
        (1, "def", "function", "a", None), (1, "ref", "call", "b", "a"), (4, "def", "function", "c", None), (4, "ref", "call", "d", "c"), (5, "def", "function", "e", None)]
    assert short("java", "class A { void f() { g(; }\n class B {") == [(1, "def", "class", "A", None), (1, "def", "method", "f", "A"), (1, "ref", "method", "g", "f"), (2, "def", "class", "B", "A")]


def test_literals_and_comments_that_never_close():
    assert short("javascript", 'a("x\nb(); /* c() ') == [(1, "ref", "call", "a", None), (2, "ref", "call", "b", None)]
    assert short("javascript", "a(); `x ${b()} y ${c(`${d()}`)} e() ` + f() + `g()") == [(1, "ref", "call", n, None) for n in "abcdf"]
    assert short("javascript", "`\\") == [] and short("rust", "/* /* */ fn a() {}") == []
    assert short("go", "func a() { b(`c()") == [(1, "def", "function", "a", None), (1, "ref", "call", "b", "a")]


@pytest.mark.parametrize("language", LANGUAGES, ids=lambda l: l.name)
def test_any_text_is_read(language):
    """Nothing crashes, tokens lie in order, and lines are those of the text."""
    rnd = random.Random(7)
    pieces = ["class", "function", "fn", "func", "type", "impl", "for", "new", "A", "b", "(", ")", "{", "}", "[", "]", "<", ">", ":", "::", ";", ",", "=", "=>", "?", ".", "*", "/", "//", "/*", "*/", '"', "'", "`", "${", "\\", "\n", " ", "#", "é", "1", "!", "var", "const", "r#\"", "enum", "interface", "extends", "where", "@", "$"]
    for _ in range(150):
        code = "".join(rnd.choice(pieces) + rnd.choice(["", " "]) for _ in range(rnd.randrange(60)))
        found = tokens(code, language)
        assert [t.start for t in found] == sorted({t.start for t in found})
        assert all(code.startswith(t.text, t.start) and t.line == code.count("\n", 0, t.start) + 1 for t in found)
        assert all(found[t.other].other == i for i, t in enumerate(found) if t.other >= 0)
        code_tags(code, language)


@pytest.mark.parametrize("name", ["javascript", "typescript", "go", "java", "rust", "cpp"])
@pytest.mark.parametrize("piece", ["f(a){g(b);}", "(", "}", "class A ", "= / [ ", "/*", '"', "a<", "impl ", "`${", "x = (", "const (", "r#\"", "x:", "func ("])
def test_time_on_hostile_lines(name, piece):
    """Four times the text takes at most some times as long, not sixteen times."""
    took = []
    for size in (1 << 14, 1 << 16):
        code = piece * (size // len(piece))
        began = time.process_time()
        code_tags(code, BY_NAME[name])
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5, took


def test_one_line_of_a_megabyte():
    code = "function f(a) { g(b[1], `x ${h(c)}`); } " * 27_000
    found = code_tags(code, BY_NAME["javascript"])
    assert len(code) > 1_000_000 and len(found) == 3 * 27_000 and {t["line"] for t in found} == {1}


def test_suffixes(spark):
    rows = spark.createDataFrame([("a.js",), ("b.TSX",), ("c.rs",), ("d.py",), ("e.md",), ("f.zig",), ("Makefile",), (".go",)], "path string")
    assert [r.l for r in rows.select(files.language().alias("l")).collect()][:7] == ["javascript", "typescript", "rust", "python", "markdown", None, None]
    assert extract.text_tags("x/y.GO", "package p") and not extract.text_tags("x.go/readme", "package p") and not extract.text_tags("a.zig", "fn f() {}")


def test_references_belong_to_the_outer_scope_by_default(spark):
    df = spark.createDataFrame([("a.js", None, "class A { m() { f(); } }"), ("b.js", None, None), ("c.js", None, "")], "path string, rel string, text string")
    assert [(r.name, r.parent_name) for r in extract.tags(df).collect()] == [("A", None), ("m", "A"), ("f", "A")]
    assert [(r.name, r.parent_name) for r in extract.tags(df, enclosing=True).collect()] == [("A", None), ("m", "A"), ("f", "m")]
