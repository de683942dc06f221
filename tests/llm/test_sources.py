import pytest

from quarryline.llm import grammars as G
from quarryline.llm import documented as D
from quarryline.llm import sources as S

VALID = {
    "python": "def f(x: int = 3) -> 'a':\n    return f'{x}'\n",
    "javascript": "import { a } from './b';\n/** d */\nexport const f = async ({ x, ...y }, [z] = []) => { for (const i of y) { if (i) continue; } return `a${x ? `b}` : '}'}`; };\nclass A extends B { static #p = 1; get q() { return /[/}]+/g.test(this.#p) } *[Symbol.iterator]() { yield 1 } }\nlet t = a\n++b\nswitch (a) { case 1: break; default: f?.(x ?? y) }\n",
    "typescript": "interface A<T extends object = {}> { readonly [k: string]: T; m?(x: number): void }\ntype U = 'a' | { b: string }[] | ((x: number) => void);\nexport abstract class C<T> implements A<T> { private x: number = 1; constructor(public y?: string) { super(); } f<K>(k: K): k is K { return <any>k as unknown as boolean } }\nenum E { A = 1, B }\nconst g = <T,>(x: T): T => x!;\n" .replace("<any>k as", "k as"),
    "java": "package a.b;\nimport static java.util.List.*;\n@Deprecated(since = \"1\") public final class A<T extends Comparable<T>> extends B implements C {\n  private static final int[] X = {1, 2};\n  @Override public <R> Map<String, List<R>> f(final int x, String... y) throws IOException { for (var e : y) { int z = (int) (x + 1L) >> 2; } Runnable r = () -> {}; try (var i = open()) { return new HashMap<>(); } catch (A | B e) { throw e; } finally { } }\n  enum E { P(1) { }, Q; }\n  record R(int a) { R { } }\n  char c = '\\u0041'; String t = \"\"\"\n   x\"y \"\"\";\n  int g() { return switch (c) { case 'a' -> 1; default -> { yield 2; } }; }\n}\n",
    "go": "// d\npackage a\n\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\n\ntype S[T any] struct {\n\ta, b int `json:\"a\"`\n\t*T\n}\n\nfunc (s *S[T]) F(a, b int, c ...string) (n int, err error) {\n\tif v, ok := m[a]; ok && v != nil {\n\t\tfor i := range []int{1, 2} {\n\t\t\tgo func() { fmt.Println(i) }()\n\t\t}\n\t} else if a > 1 {\n\t\treturn 1, nil\n\t}\n\tswitch x := y.(type) {\n\tcase int, string:\n\t\tch <- x\n\tdefault:\n\t}\n\treturn\n}\n\nvar z = map[string][]int{\"a\": {1}}\n",
    "c": "#include <stdio.h>\n#define M(x) \\\n  (x)\ntypedef struct n { int a[3]; struct n *next; } node;\nstatic const char *names[] = {\"a\", \"b\"};\nint (*fp)(int, char **);\nunsigned long f(node *p, int n) {\n  for (int i = 0; i < n; i++) { p->a[i] = (int)sizeof(node) * (n + 1); }\n  do { n--; } while (n > 0);\n  switch (n) { case 1: goto end; default: break; }\nend:\n  return (unsigned long)p->next ? 1UL : 'x';\n}\n",
}


@pytest.mark.parametrize("language", G.LANGUAGES)
def test_valid_and_damaged(language):
    text = VALID[language]
    assert G.valid(language, text) and G.valid(language, "\ufeff" + text) and G.valid(language, text.replace("\n", "\r\n")) and G.valid(language, "") and G.valid(language, None)
    lines = text.split("\n")
    for damaged in (text.replace("}", "", 1) if language != "python" else text.replace(")", "", 1), text[: len(text) * 2 // 3].rstrip().rstrip("}"), "\n".join([*lines[:2], "<<<<<<< HEAD", "=======", ">>>>>>> x", *lines[2:]]), "# Title\n\nSome words here.\n" if language not in ("python",) else "Some words here.\n"):
        assert not G.valid(language, damaged), damaged
    for other in G.LANGUAGES:
        if other != language and {language, other} != {"javascript", "typescript"}:
            assert not G.valid(other, text), other


def files(spark, *rows):
    return spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(rows)], "file_id long, path string, content string").selectExpr("file_id", "'r' as repository_id", "'s' as commit_sha", "path", "content", "timestamp('2024-01-01') as parsed_at", "'clash' as c")


def test_checked(spark):
    df = files(spark, ("a.py", "x = (1\n"), ("b.JS", VALID["java"]), ("c.go", VALID["go"]), ("d.txt", "?"), ("e.c", None), ("f.ts", "a <<<<<<< b\n"), (None, "x"))
    got = {r.file_id: r for r in S.checked(df.unionByName(df)).collect()}
    assert len(got) == 7
    assert [got[i].valid for i in range(7)] == [False, False, True, None, True, False, None]
    assert got[1].fault == "wrong extension" and got[1].accepted_by == ["java"] and got[0].fault == "truncated"
    errors = spark.createDataFrame([(1, "r", "s", ".\\a.py"), (2, "r", "s", "/home/x/r/c.go"), (3, "r", "s", None)], "error_id long, repository_id string, commit_sha string, file_path string").selectExpr("*", "timestamp('2024-01-01') as logged_at")
    rate = {r.language: r for r in S.rates(df, errors).collect()}
    assert (rate["python"].failing, rate["python"].logged, rate["go"].wrongly_logged) == (1, 1, 1)
    assert S.invalid(df.limit(0)).count() == 0


DOCUMENTED = [
    ("a.py", 'def f(a):\n    """Counts the rows of a.\n\n    :param a:\n    """\n\n\nclass K:\n    def g(self): "Short but real."; return 1\n\n    async def fetch_rows(self):\n        """Fetch rows."""\n        def inner():\n            r"""Inner " words."""\n            return "x"\n\ndef h():\n    f"""Not a docstring {1}."""\n\ndef joined():\n    "a sum " "of parts"\n    x = "later"\n\n@dec\ndef todo(\n    x,\n):\n    "TODO"\n', {("f", 0), ("g", 8), ("inner", 12), ("joined", 19)}),
    ("b.ts", "/** Adds things up. */\nexport const add = (a: number): number => { return a; };\n/* ordinary words here */\nfunction no() {}\n/** Lost, another statement follows. */\nconst x = 1;\nfunction none() {}\nclass A {\n  /** {@inheritDoc} */\n  m(): void { if (x) { call(); } }\n  /** Walks over `x }`. */\n  @dec({ a: 1 })\n  private async walk(a: string): Promise<void> { const s = `${f({})}`; }\n}\n", {("add", 1), ("walk", 12)}),
    ("c.java", "class A {\n  /** Reads it from the disk. */\n  @Ann({1, 2})\n  int read(int a) throws E { return b(a); }\n  /** @param a */\n  void set(int a) { new A() { void x() {} }; }\n  /**\n   * @param a words about it\n   */\n  static int use(int a) { return a; }\n}\n", {("read", 3), ("use", 9)}),
    ("d.go", "package a\n\n// Run drives the wheel.\n//go:noinline\nfunc Run(a int) int {\n\treturn a // done\n}\nfunc Bare() {}\n\n// Lost because of the gap.\n\nfunc Gap() {}\n\n// Walk walk.\nfunc (s *S) Walk() {}\n\n/* Block words stand\nhere. */\nfunc Block() {}\n", {("Run", 4), ("Block", 18)}),
    ("e.c", "/** Waits until it drains. */\nstatic int\nwait_all(int a)\n{\n    return 0;\n}\n// plain\nint other(void) { return 1; }\n/** Declared only, with words. */\nint proto(int a);\n", {("wait_all", 2)}),
    ("f.js", "/** Real words here. */\nfunction broken( {\n", set()),
    ("g.js", "", set()),
]


def test_documented(spark):
    df = files(spark, *[(p, c) for p, c, _ in DOCUMENTED])
    got: dict[int, set] = {}
    for r in D.documented(df.unionByName(df)).collect():
        got.setdefault(r.file_id, set()).add((r.name, r.start_line))
    for i, (path, _, want) in enumerate(DOCUMENTED):
        assert got.get(i, set()) == want, path
    code = {r.name: r.code for r in D.pairs(df).collect()}
    assert code["wait_all"].startswith("static int\nwait_all(int a)") and code["use"].endswith("}")


@pytest.mark.parametrize("text", ["", "...", "TODO", "Parses the row.", "parse_row()", "The parse_row method.", "Args:\n    a:\nReturns:", "/** @return */", "See base class.", "{@inheritDoc}", ":param a:\n:return:", "Description goes here.", "N/A", "parseRow function", "todo: write a description of this some day"])
def test_trivial(text):
    assert D.trivial(text, "parse_row")


@pytest.mark.parametrize("text", ["Parses the row from disk.", "Idempotent.", "Not thread-safe.", "Args:\n    a: the row to use", "@param a the row to use", "Liefert die Zeile.", "Parse row. TODO: handle nulls as well.", "O(n)", "行を返す"])
def test_not_trivial(text):
    assert not D.trivial(text, "parse_row")
