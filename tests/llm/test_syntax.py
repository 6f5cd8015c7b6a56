import ast
import json
import warnings
from pathlib import Path

import pytest

from sedimenta.llm.grammars import GRAMMARS
from sedimenta.llm.source_files import source_files
from sedimenta.llm.syntax import Checker, check_syntax, syntax_rates

VALID = {
    "python": ["", "x = 1", "def f(a, /, *, b=2, **k) -> int:\n\tif a:\n\t\treturn {**k, 'a': [i for i in a if i]}\n", "class A(B, metaclass=M):\n    @d(1)\n    async def f(self): await x\n", "match p:\n    case [1, *r] if r: pass\n    case {'a': A(x=1) | None, **k}: ...\n", "x = f\"{a!r:>{w}} {b['k']}\"\ny = lambda *a, k=1: (yield)\n", "try:\n  pass\nexcept* E as e:\n  raise X from e\nelse: pass\nfinally:\n  pass\n", "with (a as b, c): pass\nx: int = a if b else c\nprint(*a, **b)\nfor i, in x: del a[1:2, ::3]\n", "'''\n<<<<<<< HEAD\n'''\n# =======\n", "a = 1; b = 2\\\n + 3\n"],
    "javascript": ["", "let a = /[/]\\/x/g.test(b) / 2\nfoo()\n", "export default class A extends B { #p = 1; static async *g() { yield* x } get v() { return `a${b ? `c${d}` : {}}` } }", "const {a, b: [c = 1, ...d], ...e} = f ?? g?.h?.[0]?.(1)", "for await (const x of y) if (x) continue; else break", "a: while (1) { break a }\nif (a) b\nelse c", "import d, * as n from 'm'\nexport * as q from \"r\"\nexport { x as y }", "x = async (a) => ({ ...a, async b() {}, [c]: 1, get d() { return 1 } })", "!function(){}(); var a = b ? c : d, e\n/* <<<<<<< */", "switch (a) { case 1: default: b() }\ntry { } catch { } finally { }", "new (foo())(1); new Map; a = b\n++c"],
    "typescript": ["const x: Map<string, number[]> = new Map<string, number[]>();", "interface A<T extends B = C> extends D { readonly a?: string; [k: string]: any; (x: number): void; new (): A }", "type U = { [K in keyof T]?: T[K] } | 'a' | ((x: number) => asserts x is string);", "abstract class Q<T> implements R { constructor(private readonly a: string, b?: number) { super() } abstract m(): void; x!: number = a as unknown as number }", "enum E { A = 1, B }\ndeclare module 'm' { export const x: number }\nfunction f<T>(this: X, ...a: T[]): a is B { return a!.b }", "let v = f<string>(a) < 3 && (<T,>(x: T) => x)(1); export type { Z } from './z'", "let a = b satisfies C; for (const k of <any>c) {}".replace("<any>", "")],
    "go": ["package a", "package a\n\nimport (\n\t\"x\"\n\ty \"z\"\n)\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\n\nfunc (t *T[K, V]) M(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[a]; ok && v > 1 {\n\t\treturn\n\t} else if x := f(); x != nil {\n\t}\n\tfor i := range 10 {\n\t\tgo func() { ch <- i }()\n\t}\n\tswitch y := z.(type) {\n\tcase int, []string:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\tcase ch <- 1:\n\t}\n\tp := []T{{1, 2}, {A: 3}}\n\tq := map[string]func(int) error{\"a\": nil}\n\treturn 1, nil\n}\n", "package a\nvar s = `<<<<<<< `\nconst c = 'x'\nfunc f() { a[1:2], b = c, d; x++ ; defer g(); L: for ;; { continue L } }\n"],
    "java": ["", "package a.b;\nimport static x.Y.*;\n@A(b = {1, 2}) public final class C<T extends D & E> extends F<T[]> implements G {\n int[] a = {-1, 2}, b; static { x(); }\n C() throws X { this(1); }\n <R> R m(final List<? super T> p, int... q) { for (var i : p) { } for (int i = 0, j; i < 3; i++, j--) ; try (var r = x()) { } catch (A | B e) { throw e; } finally { }\n Runnable r = () -> { }; f = (a, b) -> a + b; Supplier<T> s = ArrayList<T>::new; return (R) (Object) x; }\n}\nrecord P(int x) { P { } }\nsealed interface S permits T { default int f() { return switch (x) { case 1, 2 -> 3; case String t when t.isEmpty() -> { yield 4; } default -> throw e; }; } }\nenum E { A(1) { void f() { } }, B; int x; }", "class A { String s = \"\"\"\n <<<<<<< \"x\"\n \"\"\"; int x = a < b ? c >>> 2 : (int) d; Object o = new int[3][], p = new A() { }; }"],
    "rust": ["", "#![allow(x)]\nuse a::{self, b::*, c as d};\n#[derive(D)]\npub(crate) struct S<'a, T: A + 'a = B, const N: usize>(pub &'a T) where T: C;\nimpl<T> X for S<'_, T> where T: Y { const A: u8 = b'x'; type B = Vec<<T as Z>::O>; fn f(&mut self, (a, b): (i32, &dyn Fn(u8) -> u8)) -> Result<(), Box<dyn E>> { let v = match a { 1 | 2..=5 if b => x?, S { a, .. } => { } _ => return Err(e)?, }; if let Some(x) = y && z { } else { } 'l: loop { break 'l; } for i in 0..n { v[i] += 1 as u8 << 2; } let c = move |x: u8| -> u8 { x }; vec![1; 2]; println!(\"{}\", a); unsafe { f::<T>() } Ok(()) } }\nmacro_rules! m { ($x:expr) => { $x }; }\nenum E { A(u8), B { c: u8 }, C = 3 }\nconst R: &str = r#\"<<<<<<< \"#; /* a /* b */ c */"],
    "shell": ["", "#!/bin/bash\nset -e\nf() {\n  local a=\"$(g \"$1\" | sort)\"\n  if [ -n \"$a\" ] && [[ $a =~ ^x ]]; then echo \"${a:-b}\"; elif x; then :; else y; fi\n}\nfor i in a b; do f \"$i\"; done > /tmp/x 2>&1\nwhile read -r l; do continue; done < <(ls)\ncase \"$1\" in a|b) x ;; (*) y;; esac\ncat <<'EOF' | tr a b\n<<<<<<< it's \"\nEOF\na=(1 2); ((i++)); (cd x && y) &\n", "function g { echo 'if'; }\nuntil false; do ! x | y; done"],
    "json": ["{}", " [1, -2.5e3, \"a\\u00e9\", {\"b\": [null, true]}] ", "\"x\"", "0"],
}
INVALID = {
    "python": ["def f(:\n  pass", "if a:\npass", "x = (1,", "<<<<<<< HEAD\nx = 1\n", "  x = 1\n y = 2", "a = 'b", "x = 012", "print 'a'", "f\"{\"", "class A\n  pass"],
    "javascript": ["function f() {", "let x: number = 1;", "a = ;", "<<<<<<< HEAD\nlet a\n=======\n>>>>>>> b\n", "import x from", "{ a: 1, 'b': 2 }", "foo(", "def f():\n  pass", "`${a`", "return ]"],
    "typescript": ["const x: = 1;", "interface A { a: string", "func f() {}", "let a b;", "=======\n"],
    "go": ["", "func f() {}", "package a\nfunc f() {", "package a\nfunc f() { x := }\n", "package a\nimport x from 'y'\n", "package a\n>>>>>>> b\n"],
    "java": ["class A {", "class A { int f( { } }", "def f(): pass", "class A { int x = ; }", "class A { void f() { if a { } } }"],
    "rust": ["fn f() {", "fn f() { let x = ; }", "struct S { a }", "fn f( { }", "def f(): pass", "fn f() { return 1 } }"],
    "shell": ["if a; then b", "f() {", "echo \"a", "for i in a; echo; done", "case a in b) c", "<<<<<<< x\n=======\n", "a | | b", "fi", "x=$(if a)"],
    "json": ["", "{", "{'a': 1}", "[1,]", "{\"a\": 1} x", "[01]", "\"a\nb\"", "nul", "{\"a\" 1}"],
}


@pytest.fixture(scope="module")
def checker():
    return Checker()


@pytest.mark.parametrize("language", sorted(GRAMMARS))
def test_valid_sources(checker, language):
    for text in VALID[language]:
        grammar, lexer = GRAMMARS[language]
        assert checker.accepts(text, language), (language, text)


@pytest.mark.parametrize("language", sorted(GRAMMARS))
def test_invalid_sources(checker, language):
    for text in INVALID[language]:
        ok, line, col, cause = checker(text, language)
        assert not ok and cause, (language, text)


def test_grammar_agrees_with_the_standard_library(checker):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for text in VALID["python"]:
            ast.parse(text)
        for text in INVALID["python"]:
            with pytest.raises(SyntaxError):
                ast.parse(text)
    for text in VALID["json"]:
        json.loads(text)


def test_places_and_causes(checker):
    assert checker("x = 1\ny = (\n", "python")[1:] == (3, 1, "truncated")
    assert checker("a = 1\n<<<<<<< HEAD\nb = 2\n", "python")[1:] == (2, 1, "merge conflict") or checker("a = 1\n<<<<<<< HEAD\nb = 2\n", "python")[3] == "merge conflict"
    assert checker("package a\n\nfunc f() {\n}\n", "java")[3] == "written in go"
    assert checker("<!DOCTYPE html>\n<html>", "typescript")[3] == "markup"
    assert checker("(" * 3000, "python")[0] is False


def test_files_of_chunks(spark, tmp_path):
    rows = [
        ("1", "p", "a.py", "def f():", 1, "python", 0), ("1", "p", "a.py", "def f():", 1, None, 0), ("2", "p", "a.py", "  pass", 2, "python", 0), ("3", "p", "b.json", "{", 1, None, 0), ("4", "p", "c.md", "(", 1, "markdown", 0),
        ("5", None, "d.go", None, None, None, 0), ("6", "q", "e", "x", 1, None, 0),
    ]
    chunks = spark.createDataFrame(rows, "chunk_id string, project string, rel_path string, content string, start_line int, language string, text int")
    files = source_files(chunks)
    assert {(r.project, r.rel_path, r.language, r.text) for r in files.collect()} == {("p", "a.py", "python", "def f():\n  pass"), ("p", "b.json", "json", "{"), ("p", "c.md", "markdown", "("), ("", "d.go", "go", ""), ("q", "e", None, "x")}
    checked = check_syntax(files).collect()
    assert {(r.rel_path, r.valid) for r in checked} == {("a.py", True), ("b.json", False), ("d.go", False)}
    assert check_syntax(files.where("false")).count() == 0
    rates = {(r.project, r.language): (r.files, r.invalid) for r in syntax_rates(check_syntax(files)).collect()}
    assert rates[None, None] == (3, 2) and rates["p", None] == (2, 1) and rates["p", "json"] == (1, 1)


def test_grammar_alone_decides_real_sources_and_deep_nesting(checker):
    folder = Path(ast.__file__).parent
    seen = 0
    for path in sorted(folder.glob("*.py"))[::3] + sorted((folder / "json").glob("*.py")):
        text = path.read_text(errors="replace")
        if len(text) < 40_000:
            seen += 1
            assert checker(text, "python")[0], path
            assert not checker(text + "\n)", "python")[0], path
    assert seen > 30
    for n in (300, 3000):
        assert checker("[" * n + "]" * n, "json")[0] and checker("[" * n + "]" * (n - 1), "json")[3] == "truncated"
        assert checker("let x = " + "(" * n + "1" + ")" * n + ";\n", "javascript")[0]
