import pytest

from chronodex.operators import symbols as sy

RUST = '''/// A point.
#[derive(Debug)]
pub struct Point { x: f64 }
struct Unit;
struct Pair(u8, u8);
pub enum Shape { A, B { x: u8 } }
pub(crate) trait Area { fn area(&self) -> f64; fn twice(&self) -> f64 { 2.0 * self.area() } }
impl Area for Point { fn area(&self) -> f64 { 1.0 } }
impl<T: Clone> Holder<T> where T: Copy { pub async fn get(&self) -> T { fn inner() {} self.v } }
mod tests { fn hidden() {} }
macro_rules! m { () => { fn no() {} } }
/// Runs.
/// Twice.
pub fn run() -> impl Iterator<Item = u8> { let s = "fn x() {"; vec![].into_iter() }
'''
SCRIPT = '''/** A store. */
export class Store<T> extends Base {
  #items = [];
  constructor(a) { super(a); }
  /** Adds. */
  async add(x: number): Promise<{a: number}> { if (x) { return f(x); } }
  get size() { return 1; }
  handler = (e) => { this.x(e); };
}
interface Shape { area(): number; }
export default async function main(args: string[]): { a: number } { function inner() {} return {a: 1}; }
const f = () => { function nested() { } };
const o = { run(x) { return x; }, go: function () { } };
var legacy = require("x");
var other = 3
if (a) { b(c); }
function overload(x: number): string;
function* gen() { yield 1; }
export abstract class Abs { abstract go(): void; stay(): void { } }
'''
PYTHON = '''import os
@dec
class A(B):
    """Doc of A."""
    x = 1
    @property
    def f(self):
        """Doc f."""
        def inner(): pass
    class C:
        def g(self): pass
if os:
    async def h(): return "é"
else:
    def k(): pass
'''

EXPECTED = {
    "rust": [
        ("Point", "Class", 3, None), ("Unit", "Class", 4, None), ("Pair", "Class", 5, None), ("Shape", "Enum", 6, None), ("Area", "Interface", 7, None), ("twice", "Function", 7, "Area"),
        ("impl Point", "Class", 8, None), ("area", "Function", 8, "impl Point"), ("impl Holder", "Class", 9, None), ("get", "Function", 9, "impl Holder"), ("tests", "Module", 10, None), ("run", "Function", 14, None),
    ],
    "js": [
        ("Store", "Class", 2, None), ("constructor", "Method", 4, "Store"), ("add", "Method", 6, "Store"), ("size", "Method", 7, "Store"), ("Shape", "Interface", 10, None), ("main", "Function", 11, None),
        ("nested", "Function", 12, None), ("run", "Function", 13, None), ("legacy", "Variable", 14, None), ("other", "Variable", 15, None), ("gen", "Function", 18, None), ("Abs", "Class", 19, None), ("stay", "Method", 19, "Abs"),
    ],
    "python": [("A", "Class", 3, None), ("f", "Method", 7, "A"), ("C", "Class", 10, "A"), ("g", "Method", 11, "C"), ("h", "Function", 13, None), ("k", "Function", 15, None)],
}
TEXTS = {"rust": RUST, "js": SCRIPT, "python": PYTHON}


@pytest.mark.parametrize("language", sorted(TEXTS))
def test_symbols_of_a_text(spark, language):
    schema = "file_id string, content string, language string, error int"
    rows = [("f", TEXTS[language], language, 1), ("null", None, language, 1), ("empty", "", language, 1), ("other", "x", "go", 1)]
    got = sy.extract_symbols(spark.createDataFrame(rows, schema)).collect()
    names = {r.id: r.name for r in got}
    assert [(r.name, r.kind, r.start_line, names.get(r.parent_id)) for r in got] == EXPECTED[language]
    assert {r.file_id for r in got} == {"f"} and all(r.error is None for r in got)
    docs = {r.name: r.doc_comment for r in got if r.doc_comment}
    assert docs == {"rust": {"Point": "A point.", "run": "Runs.\nTwice."}, "js": {"Store": "A store.", "add": "Adds."}, "python": {"A": "Doc of A.", "f": "Doc f."}}[language]
    code = {r.name: r.code for r in got}
    assert code[{"rust": "get", "js": "stay", "python": "h"}[language]] == {"rust": "pub async fn get(&self) -> T { fn inner() {} self.v }", "js": "stay(): void { }", "python": 'async def h(): return "é"'}[language]


@pytest.mark.parametrize("language, text", [("rust", 'fn a() { "x'), ("js", "function a() { `x"), ("python", "def a(:"), ("js", "a = ]"), ("rust", "fn a() {} /* x"), ("python", "x = 1\0")])
def test_broken_texts_give_an_error_and_no_symbols(spark, language, text):
    got = sy.extract_symbols(spark.createDataFrame([("f", text, language)], "file_id string, content string, language string")).collect()
    assert len(got) == 1 and got[0].id is None and got[0].error.startswith("syntax error")


@pytest.mark.parametrize("language", sorted(TEXTS))
def test_texts_cut_anywhere_do_not_crash(language):
    for end in range(len(TEXTS[language])):
        list(sy._rows("f", TEXTS[language][:end], language))
