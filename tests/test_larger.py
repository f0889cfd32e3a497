"""What larger tables showed: equal rows, long texts, many rows of one name."""

import json
import random
import re
import time
from collections import Counter

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from sourcemill.functions import text
from sourcemill.jobs import adapters as a
from sourcemill.jobs import incremental
from sourcemill.jobs import queries as library
from sourcemill.operators import compare, diff, lines, lint, names, report, spans
from sourcemill.operators.session import SHARE, tasks_for
from sourcemill.sources import files as sources
from sourcemill.streaming import changes


def test_equal_rules_stay(spark):
    rules = spark.createDataFrame([("R1", True, "stable"), ("R1", True, "stable"), ("R12", False, "preview"), ("Q", None, "stable")], "code string, default_on boolean, group string")
    selectors = lint.selector_frame(spark, extend=["R12"], ignore=["Q"])
    got = sorted((r.code, r.enabled) for r in lint.select_rules(rules, selectors, explicit=False).collect())
    assert got == [("Q", False), ("R1", True), ("R1", True), ("R12", True)]
    none = lint.selector_frame(spark)
    assert [r.enabled for r in lint.select_rules(rules.where("code = 'R1'"), none, explicit=False).collect()] == [True, True]


def test_long_middles_are_whole(spark):
    before = [f"{i % 37} {i}" if i % 3 else "the" for i in range(2000)]
    kept = [x for x in before if x != "the"]
    rows = [("a", "\n".join(before), "\n".join([*kept, "end"])), ("b", "\n".join(["x"] + ["u", "v"] * 600), "\n".join(["v", "u"] * 600))]
    got = {r.path: (r.deleted, r.inserted, r.equal) for r in diff.line_diff(spark.createDataFrame(rows, "path string, before string, after string"), exact=True).collect()}
    assert got == {"a": (667, 1, 1333), "b": (2, 1, 1199)}


def test_versions_of_odd_texts_like_their_sql(spark, tmp_path):
    """Texts without a letter, with blank lines at their ends, without a text, and, for the diff, two of one path."""
    texts = ["", "\n", "a\n", "a\n\n", "the\n", "a the\nb", "= end =\nthe", "x\r\n", "a\n\r\n", None, "the"]
    rows = [(i, t, "en", "src1") for i, t in enumerate(texts)]
    for name, twice in (("g4_line_diff", [(2, "c\nthe", "en", "src1"), (20, "n", None, "src1"), (21, "the", None, "src1")]), ("g5_drift", [])):
        folder = tmp_path / name
        spark.createDataFrame(rows + twice, "doc_id long, text string, lang string, source string").write.parquet(str(folder / "documents.parquet"))
        c = duckdb.connect()
        c.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
        want = c.execute(library.ORACLES[name])
        columns = [d[0] for d in want.description]
        got = library.QUERIES[name](spark, str(folder)).select(*columns).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_halved_middles_have_as_much_in_common(monkeypatch):
    r = random.Random(7)
    texts = [([str(r.randrange(k)) for _ in range(r.randrange(50))], [str(r.randrange(k)) for _ in range(r.randrange(50))]) for k in (2, 3, 9) for _ in range(60)]
    whole = [diff._steps(a, b, True).count("equal") for a, b in texts]
    monkeypatch.setattr(diff, "MIDDLE", 3)
    for (a, b), n in zip(texts, whole, strict=True):
        steps = diff._steps(a, b, True)
        assert steps.count("equal") == n and len(steps) == len(a) + len(b) - n


def test_name_that_every_scope_binds(spark):
    """A product of the references and scopes of one name would have 900 million rows."""
    n = 30000
    ids = spark.range(1, n + 1, 1, 4)
    one = F.lit(1).cast("long").alias("file_id")
    scopes = ids.select(one, F.col("id").alias("scope"), F.lit(0).cast("long").alias("parent"), F.lit("block").alias("class"), F.lit(False).alias("dynamic"))
    bindings = ids.select(one, F.col("id").alias("binding"), F.col("id").alias("scope"), F.lit("x").alias("name"), F.lit("value").alias("namespace"), F.lit(0).cast("long").alias("offset"), F.lit(None).cast("long").alias("visible_from"))
    refs = ids.select(one, F.lit("zig").alias("language"), F.col("id").alias("ref"), F.col("id").alias("scope"), F.lit(None).cast("long").alias("start"), F.lit("x").alias("name"), F.col("id").alias("offset"), F.lit("value").alias("namespace"), F.lit(None).cast("string").alias("retry"), F.lit(False).alias("qualified"))
    t = time.time()
    by_rules = names.resolve_by_rules(refs, bindings, scopes)
    by_chain = names.resolve_refs(refs, bindings, names.scope_chain(scopes))
    for found in (by_rules, by_chain):
        assert found.where("binding = ref and resolution = 'bound'").count() == n
    assert time.time() - t < 60


ODD = [(1, "aé b\n\nC😀(d)[]\n"), (2, ""), (3, None), (4, "\n"), (5, "((x"), (6, "éé"), (7, "Z"), (8, "a\r\n﻿b"), (9, "a" * 70 + "()" * 3)]


def test_words_brackets_and_lines_are_narrow(spark):
    df = spark.createDataFrame(ODD, "file_id int, source string").repartition(2)
    words, brackets, own = a.words_of(df), spans.bracket_tokens(df), lines.explode_lines(df)
    for found in (words, brackets, own):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Sort" not in plan
    want_words, want_brackets, want_lines = set(), set(), set()
    for i, text in ODD:
        at = 0
        for idx, part in enumerate(re.findall("[A-Za-z]+|[^A-Za-z]+", text or "")):
            if part[0].isascii() and part[0].isalpha():
                want_words.add((i, idx, at, len(part), "name" if part[0].isupper() else "word"))
            at += len(part.encode())
        at = 0
        for idx, part in enumerate(re.findall(r"[()\[\]{}]|[^()\[\]{}]+", text or "")):
            if part in "()[]{}":
                want_brackets.add((i, idx, at, 1, part))
            at += len(part.encode())
        at = 0
        for n, raw in enumerate(text.split("\n") if text is not None else []):
            held = raw[:-1] if raw.endswith("\r") and n < text.count("\n") else raw
            want_lines.add((i, n, at, at + len(held.encode()), held))
            at += len(raw.encode()) + 1
    assert {tuple(r) for r in words.collect()} == want_words
    assert {tuple(r) for r in brackets.collect()} == want_brackets
    assert {tuple(r) for r in own.collect()} == want_lines


def test_prefix_check_compares_only_files_that_differ(spark):
    """Words of a prefix that ends in a letter join the first word of some files, also of one without an id."""
    df = spark.createDataFrame([(1, "ab c"), (2, " ab"), (None, "x y"), (4, "12")], "file_id int, source string")
    words = lambda f: a.words_of(f).select("file_id", F.col("kind").alias("name"), "offset", (F.col("offset") + F.col("length")).alias("end"))
    after, expected = compare._extracted(df, words, "q")
    differ = compare.differing(after, expected, tuple(after.columns))
    assert sorted(str(r.file_id) for r in differ.collect()) == ["1", "2", "4", "None"]
    key = lambda r: str(tuple(r))
    found, whole = compare.prefix_check(df, words, "q"), compare.compare_rows(after, expected, tuple(after.columns))
    assert sorted(found.collect(), key=key) == sorted(whole.collect(), key=key)
    same = compare.differing(*compare._extracted(df, words, "## 1\n"), tuple(after.columns))
    assert same.count() == 0
    twice = after.unionByName(after)
    assert compare.differing(twice, after, tuple(after.columns)).count() == 4


def test_dedent_of_blank_and_empty_texts(spark):
    texts = [None, "", "\n \t\n", "  a \t\r\n\n    b\n  ", "a  b\n c\t"]
    got = [r.d for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(text.dedent(F.col("t")).alias("d")).collect()]
    assert got == [None, "", "", "a\n\n  b", "a  b\n c"]


def test_groups_of_streams_are_cheap():
    """A frame by concatenation and sorting costs a millisecond for each path."""
    parts = [pd.DataFrame({"version": [3, 1], "stamp": ["c", None]}), pd.DataFrame({"version": [2, 3], "stamp": ["b", "d"]})]
    assert changes._sorted(parts, "version", "stamp") == [(1, None), (2, "b"), (3, "c"), (3, "d")]
    t = time.perf_counter()
    for _ in range(1000):
        changes._sorted(parts, "version", "stamp")
    assert time.perf_counter() - t < 0.5


def test_pieces_of_lines_are_narrow(spark):
    rows = [(1, 0, 0, "a" * 200), (1, 1, 201, ("é" * 63 + "😀") * 3), (2, 0, 5, ""), (2, 1, 6, None), (None, 0, 0, "é"), (3, 0, 0, "b😀" * 40 + "c")]
    df = spark.createDataFrame(rows, "file_id int, line int, start long, text string").repartition(1)
    for unit, code in (("utf8", "utf-8"), ("utf16", "utf-16-be"), ("utf32", "utf-32-be")):
        found = lines._pieces(df, unit)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Sort" not in plan
        want, width = set(), {"utf8": 1, "utf16": 2, "utf32": 4}[unit]
        for i, line, start, t in rows:
            if t is not None and t.isascii():
                want.add((i, line, 0, start, 0, len(t), None))
            elif t is not None:
                for k in range(0, len(t), lines.PIECE):
                    part = t[k : k + lines.PIECE]
                    want.add((i, line, k // lines.PIECE, start + len(t[:k].encode()), len(t[:k].encode(code)) // width, len(part.encode()), part))
        assert {tuple(r) for r in found.collect()} == want


def test_findings_of_documents_are_made_once(spark):
    """Both formats and the fixes read one table of placed findings: the sources are not found in the plan of the documents."""
    files = spark.createDataFrame([(1, "p/a", "é x\nyy z\n"), (2, "p", "q")], "file_id int, path string, source string")
    own = lines.explode_lines(files)
    f = spark.createDataFrame([(1, 10, 3, 4), (1, 11, 0, 2), (2, 12, 0, 1), (1, 13, 3, 0)], "file_id int, finding_id int, offset long, length long").join(files.select("file_id", "path"), "file_id")
    f = f.withColumns({"code": F.lit("C"), "arrival": F.col("finding_id").cast("long"), "rule": F.lit("r"), "severity": F.lit("error"), "message": F.lit("m"), "applicability": F.lit("safe")})
    placed = report.positioned(f, own, text=False)
    assert sorted((r.finding_id, r.row, r.column, r.end_row, r.end_column) for r in placed.collect()) == [(10, 1, 3, 2, 3), (11, 1, 1, 1, 2), (12, 1, 1, 1, 2), (13, 1, 3, 1, 3)]
    edits = placed.select("finding_id", "file_id", F.lit(0).alias("ordinal"), "offset", "length", F.lit("X").alias("replacement"))
    found = report.documents(report.with_suggestions(placed, edits, own), ("rdjson", "sarif"))
    rows = {(r["format"], r["index"]): r["text"] for r in found.collect()}
    assert len(rows) == 12 and "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    fix = json.loads(rows["rdjson", 2].lstrip(","))
    assert fix["location"] == {"path": "p/a", "range": {"start": {"line": 1, "column": 3}, "end": {"line": 2, "column": 3}}}
    assert fix["suggestions"] == [{"range": fix["location"]["range"], "text": "X"}]


def full(source, f, edits, context):
    """What render_full says of one finding, by plain strings."""
    cut, at = [], 0
    for n, raw in enumerate(source.split("\n")):
        bom = n == 0 and raw.startswith("\ufeff")
        text = raw[1:] if bom else raw
        text = text[:-1] if text.endswith("\r") and n < source.count("\n") else text
        cut.append((at + 3 * bom, text))
        at += len(raw.encode()) + 1

    def place(offset):
        line = max(i for i, (start, _) in enumerate(cut) if i == 0 or start <= offset)
        start, text = cut[line]
        return line, len(text.encode()[: max(0, offset - start)].decode("utf-8", "ignore"))

    (line, column), (end, stop) = place(f["offset"]), place(f["offset"] + f["length"])
    gutter = len(str(line + 1 + context))
    out = [f"{f['path']}:{line + 1}:{column + 1}: {f['code']} [*] {f['message']}"]
    for i in range(max(0, line - context), min(len(cut), line + context + 1)):
        out.append(f"{i + 1}".rjust(gutter) + " | " + cut[i][1])
        if i == line:
            out.append(" " * gutter + " | " + " " * column + "^" * max(1, stop - column if end == line else len(cut[i][1]) - column + 1))
    if edits:
        first, last = place(edits[0][0])[0], place(edits[-1][0] + edits[-1][1])[0]
        held = "\n".join(text for _, text in cut[first : last + 1])
        new = held.encode()
        for offset, length, text in reversed(edits):
            new = new[: offset - cut[first][0]] + text.encode() + new[offset - cut[first][0] + length :]
        out += [f"- {x}" for x in held.split("\n")] + [f"+ {x}" for x in new.decode().split("\n")]
    return "\n".join(out) + "\n"


def test_full_reports_move_lines_once(spark):
    """Findings over several lines and at odd places, fixes far from them; the sources are in the plan once, and one exchange holds lines."""
    sources_ = {1: "aé b\n\nC😀(d)[]\nx" + "\ny" * 9 + "\nend", 2: "", 3: "\ufeffab\r\ncd", 4: "é" * 70 + "\nz", 5: "p\nq"}
    spots = [(1, 0, 2), (1, 3, 1), (1, 5, 2), (1, 6, 0), (1, 8, 4), (1, 8, 90), (1, 38, 3), (2, 0, 0), (2, 0, 5), (3, 0, 2), (3, 4, 2), (3, 5, 3), (3, 8, 1), (4, 2, 130), (4, 141, 1), (5, 0, 1), (5, 0, 1)]
    rows = [(file, 100 + i, f"p/{file}", "C", "safe", "m", offset, length) for i, (file, offset, length) in enumerate(spots)]
    fixes_ = {100: [(0, 1, "X"), (3, 0, "YZ")], 104: [(0, 1, ""), (17, 3, "two\nlines")], 107: [(0, 0, "new")], 113: [(0, 2, "e"), (141, 1, "Z")], 115: [(2, 1, "Q")], 116: [(0, 3, "")]}
    files = spark.createDataFrame(list(sources_.items()), "file_id int, source string")
    schema = "file_id int, finding_id int, path string, code string, applicability string, message string, offset long, length long"
    f, own = spark.createDataFrame([*rows, (6, 99, "none", "C", "safe", "m", 0, 1)], schema), lines.explode_lines(files)
    edits = spark.createDataFrame([(k, i, *e) for k, es in fixes_.items() for i, e in enumerate(es)], "finding_id int, ordinal int, offset long, length long, replacement string")
    for context in (0, 1, 2):
        want = {r[1]: full(sources_[r[0]], dict(zip(f.columns, r, strict=True)), fixes_.get(r[1]), context) for r in rows} | {99: None}
        for findings in (f, report.positioned(f, own, text=False)):
            assert {r.finding_id: r.text for r in report.render_full(findings, own, context, edits, partitions=3).collect()} == want
    plain = report.render_full(f, own)
    assert {r.finding_id: r.text for r in plain.collect()} == {r[1]: full(sources_[r[0]], dict(zip(f.columns, r, strict=True)), None, 1) for r in rows} | {99: None}
    placed = f.withColumns({c: F.lit(1) for c in ("row", "column", "end_row", "end_column")}).withColumn("line_text", F.lit(""))
    for findings, fix, n in ((f, None, 1), (placed, None, 1), (f, edits, 4), (placed, edits, 4)):
        plan = report.render_full(findings, own, edits=fix)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and plan.count("Exchange ") <= n


def test_paths_of_a_batch_are_dealt_to_tasks_by_input(spark, tmp_path):
    """A table of more splits is dealt to more tasks; the store and its changes meet there once."""
    spark.range(0, 9000, 1, 9).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert tasks_for(t, t) == max(4, SHARE * 2 * t.rdd.getNumPartitions()) > 4
    ids = spark.range(400)
    store = ids.where("id < 300").select(F.concat(F.lit("p"), "id").alias("path"), F.lit("h").alias("content_hash"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("flavor"), F.lit(1).alias("generation"), F.lit(0).alias("rebuilds"), F.col("id").alias("sequence"))
    new = ids.where("id >= 200").select(F.concat(F.lit("p"), "id").alias("path"), F.explode(F.array(F.lit(1), F.lit(2))).alias("version"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("flavor"), (F.col("id") % 10 == 0).alias("removed"))
    new = new.withColumn("content_hash", F.concat(F.lit("v"), "version"))
    found = incremental.upsert_batch(store, new, 40)
    assert 20 < len(found.inputFiles()) <= 40 + 40
    want = {f"p{i}": ("h", 1, 0, i) for i in range(200)} | {f"p{i}": (None, 2, 0, i) if i % 10 == 0 else ("v2", 2, 1, i) for i in range(200, 300)}
    want |= {p: ("v2", 1, 0, 300 + k) for k, p in enumerate(sorted(f"p{i}" for i in range(300, 400) if i % 10))}
    assert {r.path: (r.content_hash, r.generation, r.rebuilds, r.sequence) for r in found.collect()} == want


def test_numbers_come_from_the_sorted_partition(spark):
    """A window over partition numbers would shuffle once more, and put several partitions into one task."""
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"), F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id")).alias("v"))
    found = sources.numbered(df, "k", partitions=13)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.where("index <> k").count() == 0 and found.count() == 5000
    empty = sources.numbered(df.where("k < 0"), "k")
    assert empty.count() == 0 and empty.columns == ["k", "v", "index"]


def test_lines_of_orders_are_dealt_once_by_input(spark, tmp_path):
    """Each line and part once, and parameters counted, in tasks that hold the same share of a larger table."""
    rows = spark.range(0, 3000, 1, 9).select((F.col("id") % 500).alias("l_orderkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"), (F.col("id") % 750).alias("l_partkey"))
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    n = tasks_for(spark.read.parquet(str(tmp_path / "lineitem.parquet")))
    own = a.order_lines(spark, str(tmp_path))
    assert n > 4 and own.rdd.getNumPartitions() == n
    found = library.d17_duplicate_parameters(spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    held = {(i % 500, i % 4, i % 750) for i in range(3000)}
    assert {tuple(r) for r in own.collect()} == held
    count = Counter((o, line, str(part % 7)) for o, line, part in held)
    assert {tuple(r) for r in found.collect()} == {(*k, c) for k, c in count.items() if c > 1}
