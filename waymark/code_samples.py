"""Code rendered from rows: texts in several languages, and the tags that they hold, for queries over whole tables.

``{k}`` is the row's key.  Each sample lists its tags by hand as ``line, kind,
node type, name, parent name, parent line``, parents being the nearest scopes.
"""

from __future__ import annotations

Tag = tuple[int, str, str, str, str | None, int | None]

JAVASCRIPT = """// class Hidden{k} { no() {} }
class Part{k} extends Item {
  constructor(a) { this.a = a }
  price(qty) {
    const s = "function nope() { call(1) }";
    return rate{k}(qty) / 2 / parts.find(/[/"]x(/g);
  }
}
function make_{k}(x) {
  if (x) { return new Part{k}(`{${load(x)}}`); }
  const inner = (a) => { go_{k}(a); };
  return { run: function () { stop(); }, key(v) { return v; } };
}
"""
JAVASCRIPT_TAGS: list[Tag] = [
    (2, "def", "class", "Part{k}", None, None), (4, "def", "method", "price", "Part{k}", 2), (6, "ref", "call", "rate{k}", "price", 4), (6, "ref", "call", "find", "price", 4),
    (9, "def", "function", "make_{k}", None, None), (10, "ref", "class", "Part{k}", "make_{k}", 9), (10, "ref", "call", "load", "make_{k}", 9), (11, "def", "function", "inner", "make_{k}", 9), (11, "ref", "call", "go_{k}", "inner", 11),
    (12, "def", "function", "run", "make_{k}", 9), (12, "ref", "call", "stop", "run", 12), (12, "def", "method", "key", "make_{k}", 9),
]

TYPESCRIPT = """interface Shape{k} { area(): number; label: Name; }
/* enum Gone { A }
*/
export abstract class Sq{k} implements Shape{k} {
  side: Length = 1;
  constructor(private base: Base{k}) { }
  area(): Money { return new Calc(this.a ? b : C).go('}'); }
}
type Alias{k} = string | Base{k};
namespace Space{k} { function use(a: Bar, b?: string): Baz { return a; } }
"""
TYPESCRIPT_TAGS: list[Tag] = [
    (1, "def", "interface", "Shape{k}", None, None), (1, "def", "class", "Shape{k}", None, None), (1, "def", "method", "area", "Shape{k}", 1), (1, "ref", "type", "Name", "Shape{k}", 1),
    (4, "def", "class", "Sq{k}", None, None), (5, "ref", "type", "Length", "Sq{k}", 4), (6, "def", "method", "constructor", "Sq{k}", 4), (6, "ref", "type", "Base{k}", "Sq{k}", 4),
    (7, "def", "method", "area", "Sq{k}", 4), (7, "ref", "type", "Money", "Sq{k}", 4), (7, "ref", "class", "Calc", "area", 7), (9, "def", "type", "Alias{k}", None, None),
    (10, "def", "module", "Space{k}", None, None), (10, "def", "function", "use", "Space{k}", 10), (10, "ref", "type", "Bar", "Space{k}", 10), (10, "ref", "type", "Baz", "Space{k}", 10),
]

GO = """package pkg{k}

type Part{k} struct {
	name Label
	next *Part{k}
}

const (
	First{k} = 1
	Second = "func no() {"
)

func (p *Part{k}) Price(q Count) (Money, error) {
	raw := `type X struct { call() }`
	return Money{q}, rate.Of(raw)
}

func make_{k}(a pkg.Kind) *Part{k} {
	go run_{k}(a)
	return &Part{k}{name: "x"}
}
"""
GO_TAGS: list[Tag] = [
    (1, "def", "module", "pkg{k}", None, None), (3, "def", "type", "Part{k}", None, None), (3, "def", "class", "Part{k}", None, None), (3, "ref", "type", "Part{k}", None, None), (4, "ref", "type", "Label", "Part{k}", 3), (5, "ref", "type", "Part{k}", "Part{k}", 3),
    (9, "def", "constant", "First{k}", None, None), (10, "def", "constant", "Second", None, None), (13, "def", "method", "Price", None, None), (13, "ref", "type", "Part{k}", None, None), (13, "ref", "type", "Count", None, None),
    (13, "ref", "type", "Money", None, None), (13, "ref", "type", "error", None, None), (15, "ref", "type", "Money", "Price", 13), (15, "ref", "call", "Of", "Price", 13),
    (18, "def", "function", "make_{k}", None, None), (18, "ref", "type", "Kind", None, None), (18, "ref", "type", "Part{k}", None, None), (19, "ref", "call", "run_{k}", "make_{k}", 18), (20, "ref", "type", "Part{k}", "make_{k}", 18),
]

JAVA = """package parts;
/* class Gone { void no() {} } */
public class Part{k} extends Item implements Priced, Named<Long>, Sold {
  private int x = calc{k}(1);
  public Part{k}(int a) { super(a); setup(a); }
  @Override public List<String> names(int q) throws IOException {
    String s = "class No { } // ";
    return new ArrayList(q).stream(helper{k}(q));
  }
  interface Inner extends Base { void run(); }
}
enum Kind{k} { A, B; int code() { return 1; } }
"""
JAVA_TAGS: list[Tag] = [
    (3, "def", "class", "Part{k}", None, None), (3, "ref", "class", "Item", None, None), (3, "ref", "interface", "Priced", None, None), (3, "ref", "interface", "Sold", None, None), (4, "ref", "method", "calc{k}", "Part{k}", 3), (5, "ref", "method", "setup", "Part{k}", 5),
    (6, "def", "method", "names", "Part{k}", 3), (8, "ref", "class", "ArrayList", "names", 6), (8, "ref", "method", "stream", "names", 6), (8, "ref", "method", "helper{k}", "names", 6),
    (10, "def", "interface", "Inner", "Part{k}", 3), (10, "ref", "interface", "Base", "Part{k}", 3), (10, "def", "method", "run", "Inner", 10), (12, "def", "method", "code", "Kind{k}", 12),
]

RUST = """/* a /* fn no() {} */ still */
struct Part{k}<'a> { name: &'a str }
trait Priced { fn price(&self) -> f64; fn twice(&self) -> f64 { self.price() * 2.0 } }
impl<'a> Priced for Part{k}<'a> {
    fn price(&self) -> f64 { rate_{k}(self.name, 'c', "fn x() {", r#"fn "y" {"#) }
}
impl Kind{k} {
    pub fn make(a: A) -> Self where A: B { println!("{}", lib::build(a)); Kind{k} {} }
}
mod inner { fn deep() {} }
fn main_{k}() { match x { Some(y) => go_{k}(y), _ => {} } }
"""
RUST_TAGS: list[Tag] = [
    (2, "def", "class", "Part{k}", None, None), (3, "def", "interface", "Priced", None, None), (3, "def", "method", "twice", "Priced", 3), (3, "def", "function", "twice", "Priced", 3), (3, "ref", "call", "price", "twice", 3),
    (4, "ref", "implementation", "Priced", None, None), (5, "def", "method", "price", "Part{k}", 4), (5, "def", "function", "price", "Part{k}", 4), (5, "ref", "call", "rate_{k}", "price", 5),
    (7, "ref", "implementation", "Kind{k}", None, None), (8, "def", "method", "make", "Kind{k}", 7), (8, "def", "function", "make", "Kind{k}", 7), (8, "ref", "call", "println", "make", 8),
    (10, "def", "module", "inner", None, None), (10, "def", "method", "deep", "inner", 10), (10, "def", "function", "deep", "inner", 10), (11, "def", "function", "main_{k}", None, None), (11, "ref", "call", "go_{k}", "main_{k}", 11),
]

#: Suffix, text and tags; a row's sample is that of its key modulo their number.
SAMPLES = [(".js", JAVASCRIPT, JAVASCRIPT_TAGS), (".ts", TYPESCRIPT, TYPESCRIPT_TAGS), (".go", GO, GO_TAGS), (".java", JAVA, JAVA_TAGS), (".rs", RUST, RUST_TAGS)]

#: Files that refer to what the others define: a customer's file calls what is made for the part of the same number.
CALLER = """function order_{k}(q) {
  make_{k}(q);
  return rate{k}(q) + main_{k}(q);
}
"""
CALLER_TAGS: list[Tag] = [(1, "def", "function", "order_{k}", None, None), (2, "ref", "call", "make_{k}", "order_{k}", 1), (3, "ref", "call", "rate{k}", "order_{k}", 1), (3, "ref", "call", "main_{k}", "order_{k}", 1)]


def values(samples: list[tuple[str, str, list[Tag]]]) -> str:
    """The tags as rows of SQL: ``sample, suffix, line, kind, node_type, name, parent, parent_line``."""
    quoted = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"
    return ", ".join(f"({i}, '{suffix}', {', '.join(map(quoted, tag))})" for i, (suffix, _, tags) in enumerate(samples) for tag in tags)
