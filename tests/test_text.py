import pytest
from pyspark.sql import functions as F

from sourcemill.functions import hashing, paths, text
from sourcemill.sources import files


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


def test_line_ending(spark):
    cases = {"a\r\nb\n": "CRLF", "a\nb\r\n": "LF", "a\rb\n": "CR", "abc": "LF", "": "LF"}
    for value, want in cases.items():
        assert one(spark, value, text.line_ending) == want


def test_indent_and_display_width(spark):
    assert one(spark, "\t x", text.indent_width) == 5
    assert one(spark, "  \tx", text.indent_width) == 4
    assert one(spark, "", text.indent_width) == 0
    assert one(spark, "日本é", text.display_width) == 5
    assert one(spark, None, text.display_width) is None


def test_words_and_groups(spark):
    assert one(spark, "a the.b", lambda c: text.contains_word(c, "the"))
    assert not one(spark, "other théthe", lambda c: text.contains_word(c, "the"))
    assert one(spark, "{[()]}", text.balanced)
    assert not one(spark, ")(", text.balanced)
    assert one(spark, "((a)(b))", text.strip_group) == "(a)(b)"
    assert one(spark, "(((((a)))))", text.strip_group) == "(a)"
    assert one(spark, "()", text.strip_group) == ""


def test_dedent_and_wrap(spark):
    assert one(spark, "\n\n    a  \n      b\n\n    c\n\n", text.dedent) == "a\n  b\n\nc"
    assert one(spark, " \n ", text.dedent) == ""
    long = "one two three four\n\n- five six seven\n```\nkeep   this\n```\n# head line stays"
    assert one(spark, long, lambda c: text.wrap(c, 9)) == "one two\nthree\nfour\n\n- five\n  six\n  seven\n```\nkeep   this\n```\n# head line stays"


def test_names(spark):
    for value, want in {"MAX_SIZE": "constant", "X": "class", "Widget": "class", "name": "variable"}.items():
        assert one(spark, value, text.member_class) == want
    items = ["a10", "a9", "a2b", "a02", "b1"]
    keyed = spark.createDataFrame([(i,) for i in items], "v string").orderBy(text.natural_key(F.col("v")))
    assert [r.v for r in keyed.collect()] == ["a02", "a2b", "a9", "a10", "b1"]
    assert one(spark, "fooBar_baz", text.kebab) == "foo-bar-baz"
    assert one(spark, "foo_bar-baz", text.camel) == "FooBarBaz"


def test_classify(spark):
    cases = {
        "'x'": ("literal", ["'x'"]), "True": ("literal", ["True"]), "-1.5e3": ("literal", ["-1.5e3"]), "a.b . c": ("dotted_name", ["a", "b", "c"]),
        "f.g(x, y)": ("call", ["f", "g"]), "[1, a.b, f(2),]": ("sequence", ["1", "a.b", "f(2)"]), "[[1], 2]": ("dynamic", []), "f'{x}'": ("dynamic", []), "a + b": ("dynamic", []),
    }
    for value, (kind, parts) in cases.items():
        found = one(spark, value, text.classify_expr)
        assert (found.kind, list(found.parts)) == (kind, parts), value


def test_paths(spark):
    assert one(spark, "/a/./b/../c//d", paths.normalise) == "/a/c/d"
    assert one(spark, "../a/../..", paths.normalise) == "../.."
    assert one(spark, "/../a", paths.normalise) == "/a"
    assert one(spark, "a/b.test.pyi", paths.flavor) == "stub"
    assert one(spark, "Makefile", paths.language) is None
    assert one(spark, "/a b/ü~*.py", paths.file_uri) == "file:///a%20b/%C3%BC~%2A.py"
    assert one(spark, "file:///a%20b/+x", paths.path_of_uri) == "/a b/+x"
    assert one(spark, "http://a/b", paths.path_of_uri) is None
    assert one(spark, "a/b/c.py", paths.ancestors) == ["a/b", "a", ""]


def fnv(data: bytes) -> int:
    h = 14695981039346656037
    for b in data:
        h = (h ^ b) * 1099511628211 % 2**64
    return h


def test_fnv(spark):
    values = ["", "a", "foobar", "é" * 30, None]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", hashing.fnv1a64(F.col("v")).alias("h")).collect()
    assert {r.v: int(r.h) for r in rows} == {v: fnv((v or "").encode()) for v in values}
    assert one(spark, "p", lambda c: hashing.fingerprint(c, F.lit("C"), F.lit("t"))) == f"{fnv(b'p' + bytes([255]) + b'C' + bytes([255]) + b't' + bytes([255])):016x}"


def test_globs(spark):
    table = [
        ("*.py", "a/b/c.py", True), ("*.py", "c.pyi", False), ("src/*.py", "src/a.py", True), ("src/*.py", "src/x/a.py", False), ("src/**/a.py", "src/a.py", True), ("src/**/a.py", "src/x/y/a.py", True),
        ("build", "x/build/out.o", True), ("a?c/[!x]*", "abc/yes", True), ("a?c/[!x]*", "abc/xno", False), ("{a,b{1,2}}/f", "b2/f", True), ("./docs/", "docs/x.md", True), ("a.c", "abc", False),
    ]
    import re

    for pattern, path, want in table:
        assert bool(re.match(files.glob_regex(pattern), path)) == want, (pattern, path)
    df = spark.createDataFrame([("a/b.py",), ("test/b.py",), ("a/c.go",)], "path string")
    assert {r.path for r in files.glob_filter(df, ["*.py"], ["test"]).collect()} == {"a/b.py"}


def tree(folder, files):
    for name, data in files.items():
        p = folder / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)


def test_read_sources(spark, tmp_path):
    tree(tmp_path / "t", {
        "a/x.py": b"x = 1\n", "node_modules/y.js": b"", "b/bad.py": b"\xff\xfe", "pkg/__init__.py": b"", "pkg/_x.py": b"1", ".hidden/keep.html": b"<p>",
        ".gitignore": b"*.log\n", "static/vendor/lib.js": b"", "static/app.js": b"", "deep/a/b/c/d.py": b"d", ".git/config": b"", "empty.py": b"",
    })
    (tmp_path / "t" / "void").mkdir()
    (tmp_path / "t" / "link.py").symlink_to(tmp_path / "t" / "a" / "x.py")
    (tmp_path / "t" / "loop").symlink_to(tmp_path / "t")
    for root in (str(tmp_path / "t"), f"file://{tmp_path}/t/"):
        found = {r.path: (r.source, r.valid) for r in files.read_sources(spark, root).collect()}
        assert found == {
            "a/x.py": ("x = 1\n", True), "b/bad.py": (None, False), "pkg/__init__.py": ("", True), "pkg/_x.py": ("1", True), ".hidden/keep.html": ("<p>", True),
            ".gitignore": ("*.log\n", True), "static/app.js": ("", True), "deep/a/b/c/d.py": ("d", True), "empty.py": ("", True),
        }
    assert {r.path for r in files.read_sources(spark, str(tmp_path / "t"), skipped=()).collect()} >= {"node_modules/y.js", ".git/config"}
    with pytest.raises(FileNotFoundError):
        files.read_sources(spark, str(tmp_path / "no"))


def test_ignore_files_of_nested_repositories(spark, tmp_path):
    tree(tmp_path, {
        ".git/HEAD": b"", ".gitignore": b"# all\n\n*.log\n/out/\n!keep.log\n", "a.log": b"", "keep.log": b"", "out/x.py": b"", "src/out/x.py": b"",
        "src/.ignore": b"*.tmp\r\n", "src/y.tmp": b"", "src/b.log": b"", "sub/.git/HEAD": b"", "sub/c.log": b"", "sub/.gitignore": b"*.py\n", "sub/d.py": b"", "sub/.ignore": b"!d.py\n", "sub/e.py": b"",
    })
    listed = files.list_sources(spark, str(tmp_path))
    repositories = listed.where("kind = 'repository'").select(F.col("path").alias("base"))
    sources = files.read_sources(spark, str(tmp_path))
    found = files.apply_ignores(sources.select("path"), files.ignore_lines(sources), repositories=repositories)
    assert {r.path for r in found.where("ignored").collect()} == {"a.log", "out/x.py", "src/y.tmp", "src/b.log", "sub/e.py"}


def test_paths_are_ordered_by_component(spark):
    rows = ["src10/a", "src1/b", "src1/a/c", "src1", "src-1/a"]
    df = spark.createDataFrame([(r,) for r in rows], "path string")
    assert [r.path for r in df.orderBy(paths.order_key(F.col("path"))).collect()] == ["src-1/a", "src1", "src1/a/c", "src1/b", "src10/a"]
