import pytest

from chronodex.llm import functions_docs as fd

DOC = "Reads all rows of the store and keeps the new ones."


def found(text, language):
    return [(n, a) for n, a, b, code, doc in fd.functions_of(text, language) if fd.is_meaningful(doc, n)]


def test_rust():
    src = f'''//! Module text that is long enough to count here.
use std::io;

/// {DOC}
#[inline]
#[cfg(feature = "x")]
pub(crate) async fn read_rows<'a>(x: &'a str) -> Vec<String> where String: Clone {{
    let s = "}} fn fake() {{";
    let r = r#"fn other() {{ "q" }}"#;
    let c = '{{';
    /* nested /* }} */ fn gone() {{ }} */
    vec![]
}}

// {DOC}
fn plain() {{}}

/** {DOC} */
fn block() {{}}

/// {DOC}
struct S;

/// {DOC}
trait T {{ /// {DOC}
    fn no_body(&self); }}

/* /// {DOC}
fn commented() {{}} */
/// {DOC}

fn far() {{}}
'''
    assert found(src, "rust") == [("read_rows", 7), ("block", 19)]


def test_javascript():
    src = f'''/** {DOC} */
export default async function load(items: string[], {{ strict }} = {{}}): Promise<void> {{
  const re = /[{{}}]/g;
  const t = `${{items.map((x) => {{ return `${{x}} }}`; }})}} /** {DOC} */ function fake() {{}}`;
}}

/** {DOC} */
const walk = (items) => {{ return items; }};
/** {DOC} */
export const short = x => x + 1;
/** {DOC} */
let make = function inner(a) {{ }};
/** {DOC} */
const LIMIT = 100;

class A {{
  /** {DOC} */
  @log("x")
  static async run(items, limit = 10): number {{ if (items) {{ }} return 1; }}

  /* {DOC} */
  plain() {{ }}

  /** {DOC} */
  get size(): {{ a: number }} {{ return {{ a: 1 }}; }}
}}
interface B {{
  /** {DOC} */
  key(items: string[]): string;
}}
'''
    assert found(src, "js") == [("load", 2), ("walk", 8), ("short", 10), ("make", 12), ("run", 19), ("size", 25)]


def test_python():
    src = f'''"""{DOC}"""
import os

class A:
    """{DOC}"""
    @cached
    async def first(
        self, items: dict[str, int] = {{"a": 1}},
    ) -> int:
        # a comment before
        r\'\'\'{DOC}\'\'\'
        text = "def fake(): pass"

    def second(self): "{DOC}"

    def third(self):
        x = """{DOC}"""

    def fourth(self):
        f"""{DOC}"""
# def gone():
#     """{DOC}"""
s = """
def inside():
    '{DOC}'
"""
def nested():
    def inner():
        """{DOC}"""
'''
    assert found(src, "python") == [("first", 7), ("second", 14), ("inner", 28)]


@pytest.mark.parametrize("doc, name, good", [
    (DOC, "read_rows", True), ("Read rows function.", "read_rows", False), ("TODO: write documentation for this function before the release", "f", False), ("Placeholder: description will be added later by the author", "f", False),
    (DOC + "\nTODO: measure this again.", "f", True), ("@param items rows to read from the store\n@returns the total of all the rows", "f", False), (DOC + "\n\n@param x y", "f", True), ("Auto-generated stub, do not edit by hand.", "f", False), ("@inheritdoc", "f", False), ("", "f", False),
    ("One two three four", "f", False), ("One two three four five", "f", True), ("Args:\n    items: all the rows that are there to read", "f", False), ("# Examples\n```\nfn main() { demo(); here; are; words; enough; }\n```", "f", False), ("Renvoie les lignes modifiées depuis la lecture.", "f", True),
])
def test_meaning(doc, name, good):
    assert fd.is_meaningful(fd.clean_doc([doc]), name) is good


@pytest.mark.parametrize("text", ["", "fn", "fn x", "/** open", "'''", "`${", "{", "def f(", "class {", "fn f() {", "const a = (", '"' * 7])
@pytest.mark.parametrize("language", ["rust", "js", "python"])
def test_broken_sources_do_not_fail(text, language):
    list(fd.functions_of(text, language))
    list(fd.functions_of(text * 300, language))


def test_line_ends_and_frame(spark):
    src = f"/// {DOC}\r\nfn a() {{}}\r\n"
    df = spark.createDataFrame([("f1", src, "rust", 1), ("f2", src, "cobol", 2), ("f3", None, "rust", 3), ("f4", "", None, 4), ("f5", src.replace("\r\n", "\r"), "rust", 5)], "file_id string, content string, language string, code int")
    assert {(r.file_id, r.name, r.start_line, r.end_line) for r in fd.function_docs(df).collect()} == {("f1", "a", 2, 2), ("f5", "a", 2, 2)}


SOURCES = {
    "js": "/** Adds two numbers and says so. */\nexport const add = (a, b) => { return `${a /* x */ + `${b}`} \\` ${'}'}`; };\nclass K { /** Does a thing that is well described here. */ m(x) { return /[/}]/.test(x); } }\n",
    "rust": "/// Reads all of the rows of a table at once.\npub fn read<T>(r: &'static str) -> T where T: X { /* a /* b */ c */ let s = r#\"}\"#; '}' }\n",
    "python": 'def f(a=")", *, b: int = 3) -> str:\n    """Gives the text of a row back to the caller."""\n    return f"{a!r:>{b}}" + \'\'\'x\ny\'\'\'\n',
}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_files_cut_at_any_place(language):
    text = SOURCES[language]
    for n in range(len(text) + 1):
        for tail in ("", "${ /* open", "`", '"', "/*", "{"):
            list(fd.functions_of(text[:n] + tail, language))


def test_deep_templates_and_open_comments():
    list(fd.functions_of("const a = `${ /* open", "js"))
    list(fd.functions_of("const a = " + "`${" * 20_000, "js"))
    list(fd.functions_of("const a = " + "`${" * 3_000 + "1" + "}`" * 3_000 + ";", "js"))
