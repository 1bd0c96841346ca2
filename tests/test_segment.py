"""Declarations, comments and nesting of single texts; expected values are written down by hand."""

import pytest

from seamfinder.operators.lexer import lex
from seamfinder.operators.segment import forest, settled

F, M = "function_declaration", "method_declaration"
CASES = [
    ("js", "function a(s) {\n  return s.replace(/[{]/g, '');\n}\nfunction b() {\n}\n", [(1, 3, F, "a"), (4, 5, F, "b")]),
    ("js", "function a(x) {\n  return `a ${x ? `b ${x} {` : '}'} {`;\n}\nfunction b() {}\n", [(1, 3, F, "a"), (4, 4, F, "b")]),
    ("c", "#ifdef A\nint f(int a) {\n#else\nint f(void) {\n#endif\n  return 1;\n}\nint g(void) {\n}\n", [(2, 7, "function_definition", "f"), (8, 9, "function_definition", "g")]),
    ("c", "#if 0\nint no(void) {\n#else\nint f(void) {\n#endif\n}\n", [(4, 6, "function_definition", "f")]),
    ("rb", "class A\n  def a\n    x = <<~EOS\n      end\n      def c\n    EOS\n  end\n  def b\n  end\nend\n", [(1, 10, "class", "A"), (2, 7, "method", "a"), (8, 9, "method", "b")]),
    ("rs", "/* a /* b */ fn no() { */\nfn yes() {\n}\n", [(2, 3, "function_item", "yes")]),
    ("rs", "lazy_static! {\n a\n b\n c\n d\n e\n}\nvec! {\n 1 }\nfn a<'x>(b: &'x str) -> char { '{' }\nconst X: &str = r#\"fn no() { \"#;\nfn z() {}\n", [(1, 7, "token_tree", "lazy_static"), (10, 10, "function_item", "a"), (12, 12, "function_item", "z")]),
    ("js", "export default class extends X {\n  go() {}\n}\n", [(1, 3, "class_declaration", "default"), (2, 2, "method_definition", "go")]),
    ("js", "const f = x => x + 1;\nconst g = async (a, b) => a + b\nconst h = (a) =>\n  a * 2\nconst xs = [\n  1,\n];\nexport { f, g };\nexport const N = 5;\n",
     [(1, 1, "arrow_function", "f"), (2, 2, "arrow_function", "g"), (3, 4, "arrow_function", "h"), (5, 7, "array", "xs"), (8, 8, "export_statement", ""), (9, 9, "export_statement", "N")]),
    ("ts", "declare const z: string;\ndeclare module 'x' {\n  function f(): void;\n}\nnamespace N {\n  export class C<T> {\n    private x = (a: number) => { return a; };\n  }\n}\nconst o = {\n  m(a) { return a; },\n  n: function () { },\n};\n",
     [(1, 1, "declare_statement", "z"), (2, 4, "declare_statement", ""), (5, 9, "namespace_declaration", "N"), (6, 8, "class_declaration", "C"), (7, 7, "arrow_function", "x"), (10, 13, "object", "o"), (11, 11, "method_definition", "m"), (12, 12, "function_expression", "n")]),
    ("go", "package a\n\ntype A int\n\ntype F func(a int) error\n\ntype B struct {\n\tx int\n}\n", [(3, 3, "type_declaration", "A"), (5, 5, "type_declaration", "F"), (7, 9, "type_declaration", "B")]),
    ("cs", "class A {\n  string S => \"x\";\n  int F(int a) => a + 1;\n  public int P { get; set; }\n  public event Go Done;\n}\ndelegate int D(int a);\n", [(1, 6, "class_declaration", "A"), (2, 2, "property_declaration", "S"), (3, 3, M, "F"), (4, 4, "property_declaration", "P"), (5, 5, "event_declaration", "Done"), (7, 7, "delegate_declaration", "D")]),
    ("java", "enum E {\n  A {\n    int f() {\n      return 1;\n    }\n  },\n  B;\n  private int x = 5;\n  static {\n    go();\n  }\n}\n", [(1, 12, "enum_declaration", "E"), (3, 5, M, "f"), (8, 8, "field_declaration", "x"), (9, 11, "static_initializer", "")]),
    ("swift", "struct S {\n  let a = 1\n  func f() {\n    let c = 3\n  }\n}\ntypealias T = Int\n", [(1, 6, "struct_declaration", "S"), (2, 2, "constant_declaration", "a"), (3, 5, F, "f"), (7, 7, "typealias_declaration", "T")]),
    ("py", "@slow(\n  1)\nclass A:\n    def a(self,\n  b):\n        return {\n1: 2}\n\ndef d():\n    x = '''\ndef no():\n'''\n\"\"\"no\n\"\"\"\n", [(1, 7, "decorated_definition", ""), (3, 7, "class_definition", "A"), (4, 7, "function_definition", "a"), (9, 12, "function_definition", "d")]),
    ("cpp", "int x = 5;\nint proto(int a);\nvoid f() {\n  int local = 1'000;\n}\nstruct pair p = { 1, 2 };\ntypedef struct {\n int a;\n} q;\n", [(1, 1, "declaration", "x"), (2, 2, "declaration", "proto"), (3, 5, "function_definition", "f"), (7, 9, "struct_specifier", "")]),
    ("rb", "def plain\n  while a do\n  end\n  x = if b\n  end\nend\ndef one; end\ndef less = 1\ndef other\nend\n", [(1, 6, "method", "plain"), (7, 7, "method", "one"), (8, 8, "method", "less"), (9, 10, "method", "other")]),
]


@pytest.mark.parametrize("ext,text,want", CASES)
def test_declarations(ext, text, want):
    assert [(b.start, b.end, b.kind, b.name) for b in forest(text, ext)[0]] == want


TESTS = [
    ("js", "describe('x', () => {\n  function helper() {\n  }\n  it('y', function () {\n    const z = () => { return 1; };\n  });\n});\nfunction testIt() {}\nfunction other() {}\n", {"helper", "z", "testIt"}),
    ("java", "class A {\n  @Test\n  void a() {}\n  void testB() {}\n}\n", {"a"}),
    ("cs", "class A {\n  [Fact]\n  public void C() { }\n  void TestIt() { }\n  void Other() { }\n}\n[TestFixture]\nclass B { }\nclass CTests { }\n", {"C", "TestIt", "B", "CTests"}),
    ("swift", "class FooTests: XCTestCase {\n  func helper() {\n  }\n}\nclass Foo {\n  func testIt() {\n  }\n  func other() {\n  }\n}\n", {"FooTests", "helper", "testIt"}),
    ("rb", "describe 'x' do\n  def helper\n  end\n  it 'y' do\n    def z; end\n  end\nend\ndef plain\nend\ndef test_a\nend\n", {"helper", "z", "test_a"}),
    ("php", "<?php\nclass B {\n  public function testX(): int { return 1; }\n  /** @test */\n  function it() { }\n  function no() { }\n}\n", {"testX", "it"}),
    ("rs", "#[test]\nfn a() {}\nfn test_b() {}\n#[cfg(test)]\nmod checks {\n    fn c() {}\n}\nfn latest() {}\n", {"a", "test_b", "checks", "c"}),
    ("go", "func TestA(t *T) {}\nfunc Latest() {}\n", {"TestA"}), ("c", "void run_test(void) {}\nvoid g(void) {}\n", {"run_test"}), ("py", "def test_a(): pass\ndef a_test(): pass\n", {"test_a"}),
]


@pytest.mark.parametrize("ext,text,want", TESTS)
def test_tests(ext, text, want):
    assert {b.name for b in forest(text, ext)[0] if b.is_test} == want


def test_comments_have_blocks():
    """The next declaration in what they are in, over what isn't one; at a file's end the one before; else what they are in."""
    text = "// one\n// two\nuse a;\n\nfn a() {\n    // in a\n    x(); // beside code\n}\n\nimpl B {\n    /* for c,\n       in two lines */\n    fn c() {}\n    // at the end of the impl\n}\n// last\n"
    blocks, comments = forest(text, "rs")
    assert [(c.start, c.end, c.block >= 0 and blocks[c.block].name) for c in comments] == [(1, 1, "a"), (2, 2, "a"), (6, 6, "a"), (11, 12, "c"), (14, 14, "B"), (16, 16, "B")]
    assert [c.block for c in forest("// nothing\nuse a;\n", "rs")[1]] == [-1]
    assert [(c.start, c.block) for c in forest("@prop\n# between\ndef a():\n    # in it\n    pass\n", "py")[1]] == [(2, 1), (4, 1)] or forest("# a\n@p\ndef a(): pass\n", "py")[1][0].block == 0


def test_nested_choices():
    assert settled([]) == []
    # the inner one stays where neither has a priority; equal ones stay once
    assert settled([(1, 9, "object"), (3, 4, "arrow_function"), (3, 4, "arrow_function")]) == [(3, 4, "arrow_function")]
    # an important one stays in what isn't; what isn't important goes beside one that is
    assert settled([(1, 9, "class_declaration"), (3, 4, M)]) == [(1, 9, "class_declaration"), (3, 4, M)]
    assert settled([(1, 9, "function_item"), (3, 4, "token_tree")]) == [(1, 9, "function_item")]
    # two important ones: priority decides
    assert settled([(1, 9, "impl_item"), (3, 4, "function_item")]) == [(1, 9, "impl_item")]
    assert settled([(1, 9, "function_item"), (3, 4, "struct_item")]) == [(3, 4, "struct_item")]
    # partly overlapping: the earlier one
    assert settled([(1, 5, "a"), (4, 9, "b"), (11, 12, "c")]) == [(1, 5, "a"), (11, 12, "c")]


@pytest.mark.parametrize("family,text,code", [
    ("js", "a / 2 / b; c = /x{/; <b>d</b>", "a / 2 / b; c =     ; <b>d</b>"), ("js", "f(`${g(`}`)}`) }", "f(   g(   )  ) }"), ("js", "return /}/.test(x)", "return    .test(x)"),
    ("swift", 'let s = "a \\(f("}")) {"; x', "let s =      f(   )    ; x"), ("csharp", 'var s = $"a {x["k"]} {{ }}"; @"c:\\"; {', "var s =      x[   ]        ;       ; {"),
    ("php", "<b>{</b><?php $a = '{'; # }\n?>{<?php b", "              $a =    ;    \n         b"), ("ruby", "%w[a { b]; a % b; x =~ /{/\n__END__\nend", "         ; a % b; x =~    \n       \n   "),
    ("rust", "'a'; 'b: loop {} '\\'' r##\"{\"# \"##", "   ; 'b: loop {}               "), ("go", "`{\n` '{' \"\\\"{\"", "  \n        " + "     "), ("python", "x = f'{a}' # }\ny = \"\"\"\n{\"\"\"", "x = f'        \ny = \"  \n    "),
])
def test_only_code_is_left(family, text, code):
    got = lex(text, family).code
    assert got.rstrip() == code.rstrip() and len(got) == len(text)


def test_odd_texts():
    for ext in "rs js ts py go c cpp java cs rb php swift".split():
        for text in ("", "\n", "{", "}", "}}}{{{", "\"", "'", "`", "/*", "*/", "/", "<<~A", "${", "\\", "#", "(" * 50, "é{ü}", "class", "def", "fn a(", "x" * 10_000, "{\n" * 3000 + "}\n" * 3000, "#if\n#if\n#else\n", "\"\"\"", "@", "=begin", "$\"{"):
            blocks, comments = forest(text, ext)
            n = text.count("\n") + 1
            assert all(1 <= b.first <= b.start <= b.end <= n and b.parent < i for i, b in enumerate(blocks)) and all(1 <= c.start <= c.end <= n for c in comments)
