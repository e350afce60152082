import pytest

from vetra.sources import lexer
from vetra.sources.syntax import table_rows


def rows(lang, text):
    return table_rows("x", lang, text)


def kinds(lang, text, kind):
    return [r[6] for r in rows(lang, text) if r[5] == kind]


#: Everyday texts with brackets and quotes where a flat reading goes wrong, and the calls in them.
VALID = [
    ("rust", "fn f<'a>(x: &'a str) -> &'a str { go(x) }", ["go"]),
    ("rust", "fn f() { let s = r#\"a \" ( { b\"#; go(s); let c = '('; let d = '\\''; 'out: loop { break 'out; } }", ["go"]),
    ("rust", "fn f() { /* a /* b ( */ c */ go(br##\"x\"#( \"##); let t = b'{'; let u = '\\u{1F600}'; let w = \"two\nlines (\"; }", ["go"]),
    ("javascript", "const a = s.replace(/\\(/g, '');", ["s.replace"]),
    ("javascript", "if (/[{/]/.test(a)) /x}/.exec(b); const c = a / b / d; let e = (a) / 2; i++ / 2;", ["test", "exec"]),
    ("javascript", "const t = `a ${`b ${go(`}`)} )`} {`; more(t);", ["go", "more"]),
    ("javascript", "return `${xs.map(x => `<i>${esc(x)}</i>`).join('')}`", ["xs.map", "esc", "join"]),
    ("javascript", "export const App = () => <main>Don't <b>{go(1)}</b></main>;\n", ["go"]),
    ("java", "class A { String s = \"\"\"\n  { \"x\" (\n  \"\"\"; char c = '\"'; void f() { go('('); } }", ["go"]),
    ("kotlin", "fun f() { val s = \"a ${go(\"}\")} b\"; val t = \"\"\"raw ${h(1)} \" ( \"\"\"\" }", ["go", "h"]),
    ("csharp", "class A { string s = @\"c:\\(\"\"\"; string t = $\"{{ {go(\"}\")} \"; string u = \"\"\"\n \" ( \n\"\"\"; }", ["go"]),
    ("cpp", "#define OPEN {\nint f() { auto s = R\"x( \" )\" ) )x\"; int n = 1'000'000; char c = '{'; return go(s); }", ["go"]),
    ("swift", "func f() { let s = \"a \\(go(\"(\")) b\"; let t = #\"raw \\( \" \"#; let u = \"\"\"\n ( \" \n\"\"\" }", ["go"]),
    ("dart", "void f() { var s = 'a ${go('}')} b'; var t = r'\\'; var u = '''\n ' ( '''; }", ["go"]),
    ("php", "<p>Don't ( </p><?php $s = <<<EOT\n it's ( \" \n  EOT; go($s); // end ( ?> text { <?php more(); # ( \n", ["go", "more"]),
    ("php", "<?php echo \"a {$b['k']} {$c->d(\"}\")} e\"; go('x');", ["go"]),
    ("go", "package a\nfunc F() { s := `a \" (`; r := '{'; Go(s, r) }", ["Go"]),
    ("scala", "def f(x: Int) = { val s = s\"a ${go(\"}\")}\"; val t = \"\"\"(\"\"\"; val c = '('; h('sym) }", ["go", "h"]),
    ("zig", "fn f() void { const s = \\\\ a \" (\n \\\\ b {\n ; go(s); }", ["go"]),
    ("solidity", "contract A { function f() public { bytes memory b = hex\"00\"; go(b, '('); } }", ["go"]),
]


@pytest.mark.parametrize(("lang", "text", "calls"), VALID)
def test_valid_text_parses_and_its_calls_are_found(lang, text, calls):
    got = rows(lang, text)
    assert not [r for r in got if r[5] == "error"], got
    assert set(calls) <= set(kinds(lang, text, "call"))


@pytest.mark.parametrize(("lang", "text"), [("rust", "fn broken(\n"), ("javascript", "const a = `x ${ `;"), ("go", "func F() { s := `open }"), ("java", "class A { /* open }"), ("kotlin", "val s = \"\"\"open"), ("javascript", "f(]")])
def test_invalid_text_is_an_error(lang, text):
    assert [r[5] for r in rows(lang, text)] == ["error"]


@pytest.mark.parametrize("lang", sorted(set(lexer.STRINGS) - {"zig"}))  # zig has no block comments
def test_tokens_cover_their_text_in_order(lang):
    text = "<?php " * (lang == "php") + "a(b[1], \"c\") { /* d */ e = \"f\" } // g\nh"
    toks = lexer.tokens(text, lang)
    assert all(t == text[a:b] for _, t, a, b, _ in toks)
    assert [t[1] for t in toks] == ["a", "(", "b", "[", "1", "]", ",", '"c"', ")", "{", "e", "=", '"f"', "}", "h"]
    assert toks[-1][4] == 2


def test_a_quote_that_nothing_closes_is_a_mark():
    assert [t[1] for t in lexer.tokens("<p>it's (x)</p>\ny", "javascript")][:6] == ["<", "p", ">", "it", "'", "s"]


def depth(lang, text, name):
    return [r[12] for r in rows(lang, text) if r[5] == "call" and r[6] == name]


def test_comprehensions_are_loops():
    assert depth("python", "r = [requests.get(u) for u in us]", "requests.get") == [1]
    assert depth("python", "r = {k: f(k) for k in g(x)}\ns = {f(k) for k in x}\nt = sum(f(k) for k in x if h(k))", "f") == [1, 1, 1]
    assert depth("python", "t = sum(f(k) for k in g(x) if h(k))", "h") == depth("python", "t = sum(f(k) for k in g(x) if h(k))", "g") == [1]
    assert depth("python", "r = [[f(y) for y in x] for x in xs]", "f") == [2]
    assert depth("python", "r = [f(y) for x in xs for y in x]", "f") == [1]
    assert depth("python", "for x in xs:\n    r = [f(y) for y in x]\n", "f") == [2]


def test_branches_and_loops_of_braces():
    n = lambda lang, text, kind: sum(r[5] == kind for r in rows(lang, text))
    assert n("go", "func F(x int) { switch x { case 1: a()\ncase 2: b() } }", "branch") == 0
    assert n("javascript", "function f(x) { switch (x) { case 1: a(); case 2: b(); } }", "branch") == 2
    assert n("java", "class A { void f() { do { go(); } while (x); } }", "loop") == 1
    assert n("java", "class A { void f() { do { go(); } while (x); } }", "branch") == 1
    assert n("c", "int f(int a) { return a ? g(a) : 0; }", "branch") == 1
    assert n("csharp", "class A { int? B; int F(int? a) { return a ?? 1; } }", "branch") == 0
    assert depth("cpp", "void f() { do { for (;;) { go(); } } while (1); }", "go") == [2]


@pytest.mark.parametrize(
    ("lang", "text", "name", "arguments"),
    [
        ("java", "class A { public static int run(int[] values, final Map<String, B> m) throws E, F { return go(values); } }", "run", "values,String,m"), ("java", "class A { A(int x) { go(x); } }", "A", "x"), ("csharp", "class A { async Task<int> Run(int a = 1) { go(a); } }", "Run", "a"),
        ("c", "int run(const char *p, int n) { return go(p); }", "run", "p,n"), ("cpp", "int A::run(int a) const noexcept { return go(a); }", "run", "a"), ("dart", "Future<int> run(int a) async { return go(a); }", "run", "a"),
    ],
)
def test_functions_of_typed_languages(lang, text, name, arguments):
    got = [(r[6], r[7]) for r in rows(lang, text) if r[5] == "function"]
    assert got == [(name, arguments)] and kinds(lang, text, "call") == ["go"]


@pytest.mark.parametrize(("lang", "text"), [("java", "class A { void f() { synchronized (x) { go(); } if (a) { } Runnable r = new B() { }; } }"), ("csharp", "class A { void F() { using (var x = y()) { go(); } lock (z) { } } }"), ("c", "void f() { switch (g()) { } while (h()) { } }")])
def test_statements_are_no_functions(lang, text):
    assert len(kinds(lang, text, "function")) == 1
