import random

from sourcemill.operators import diff, lint
from sourcemill.streaming import changes

UPSERTS = "path string, version long, content_hash string, language string, flavor string, removed boolean"


def streamed(spark, tmp_path, batches, schema, build, mode):
    """Rows that a stream wrote, a list for each micro-batch."""
    source, out = tmp_path / "in", []
    source.mkdir(parents=True)

    def keep(df, _):
        out.append([tuple(r) for r in df.collect()])

    q = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"b{k}"))
            part = next((tmp_path / f"b{k}").glob("part-*"))
            part.rename(source / f"{k}.json")
            q.processAllAvailable()
    finally:
        q.stop()
    return out


def test_upserts(spark, tmp_path):
    batches = [
        [("a", 1, "h1", "py", None, False), ("b", 2, "g", "py", None, False), ("a", 2, "h1", "py", None, False)],
        [("a", 4, "h2", "py", None, False), ("c", 3, "h", "py", "stub", False)],
        [("b", 3, None, None, None, True), ("a", 5, "h2", "go", None, False), ("a", 3, "late", "py", None, False), ("c", 4, "h", "py", None, False)],
        [("b", 4, "g", "py", None, False), ("a", 5, "later", "py", None, False)],
    ]
    out = streamed(spark, tmp_path, batches, UPSERTS, changes.upsert_stream, "update")
    got = {r[0]: r[1:] for b in out for r in b}
    assert got == {
        "a": ("h2", "go", None, 3, 2, 1, 5, 1, "stale"), "b": ("g", "py", None, 3, 1, 0, 4, 4, "replaced"), "c": ("h", "py", None, 2, 1, 0, 4, 3, "replaced"),
    }
    entries = spark.createDataFrame([(k, v[7]) for k, v in got.items()], "path string, placed long")
    assert {r.path: r.sequence for r in changes.with_sequence(entries).collect()} == {"a": 0, "c": 1, "b": 2}


def test_shuffled_and_late_upserts_end_like_a_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"p{k % 7}", k, f"h{rng.randrange(3)}", "py", rng.choice([None, "stub"]), rng.random() < 0.15) for k in range(60)]
    mixed = rng.sample(rows, 60)
    out = streamed(spark, tmp_path, [mixed[:25], mixed[25:40], mixed[40:]], UPSERTS, changes.upsert_stream, "update")
    got = {r[0]: (r[1], r[3]) for b in out for r in b}
    last = {p: (None, None) if gone else (h, f) for p, _, h, _, f, gone in rows}
    assert got == last


def test_watch(spark, tmp_path):
    out = streamed(spark, tmp_path, [[("a", 1, "s"), ("b", 1, None)], [("a", 2, "s"), ("b", 2, "t")], [("a", 3, None)]], "path string, version long, stamp string", changes.watch_stream, "update")
    assert [sorted((r[0], r[2]) for r in b) for b in out if b] == [[("a", "changed"), ("b", "changed")], [("a", "unchanged"), ("b", "changed")], [("a", "changed")]]


def test_edits(spark, tmp_path):
    schema = "uri string, version long, ordinal long, start long, end long, text string"
    rows = [
        [("u", 1, 0, None, None, "hello")],
        [("u", 2, 0, 0, 1, "J"), ("u", 2, 1, 5, 5, "!"), ("u", 3, 0, 0, 1, "x"), ("u", 3, 1, 9, 3, "bad")],
        [("u", 2, 0, 0, 0, "late"), ("u", 4, 0, 6, 6, "?")],
    ]
    out = streamed(spark, tmp_path, rows, schema, changes.edit_stream, "update")
    assert [b[-1] for b in out if b][-1] == ("u", 4, "Jello!?", 2)
    whole = changes.edit_batch(spark.createDataFrame([r for b in rows for r in b if r[5] != "late"], schema)).collect()
    assert [tuple(r) for r in whole] == [("u", 4, "Jello!?", 1)]


def test_range_edits_like_whole_strings(spark, tmp_path):
    """Random edits by line and character over several micro-batches, against splices of encoded strings."""
    rng = random.Random(9)
    wide = {"utf8": "utf-8", "utf16": "utf-16-le", "utf32": "utf-32-le"}
    size = {"utf8": 1, "utf16": 2, "utf32": 4}
    piece = lambda: "".join(rng.choice(["a", "é", "🙂", "\n", "\r\n", "b c"]) for _ in range(rng.randrange(6)))
    schema = "uri string, version long, ordinal long, line long, character long, end_line long, end_character long, text string"
    for unit in wide:
        rows, text, want, version = [("d", 1, 0, None, None, None, None, "🙂x\ny\r\n")], "🙂x\ny\r\n", 0, 1
        for v in range(2, 40):
            items, now, bad = [], text, False
            for o in range(rng.randrange(1, 4)):
                spots = []
                for _ in range(2):
                    lines = now.split("\n")
                    line = rng.randrange(len(lines) + (rng.random() < 0.1))
                    own = lines[line] if line < len(lines) else ""
                    own = own[:-1] if own.endswith("\r") and line < len(lines) - 1 else own
                    units = own.encode(wide[unit])
                    spots.append((line, rng.randrange(len(units) // size[unit] + 1 + (rng.random() < 0.1)), units))
                spots.sort(key=lambda s: s[:2], reverse=rng.random() < 0.1)
                new = piece()
                items.append(("d", v, o, *spots[0][:2], *spots[1][:2], new))
                if bad:
                    continue
                try:
                    lines, places = now.split("\n"), []
                    for line, at, units in spots:
                        if line >= len(lines) or at * size[unit] > len(units):
                            raise UnicodeError
                        head = units[: at * size[unit]].decode(wide[unit])
                        units[at * size[unit] :].decode(wide[unit])
                        places.append(sum(len(x) + 1 for x in lines[:line]) + len(head))
                    if places[0] > places[1]:
                        raise UnicodeError
                    now = now[: places[0]] + new + now[places[1] :]
                except UnicodeError:
                    bad = True
            rows += items
            want += bad
            text, version = (text, version) if bad else (now, v)
        batches = [[r for r in rows if r[1] % 40 // 10 == k] for k in range(4)]
        out = streamed(spark, tmp_path / unit, batches, schema, lambda df, u=unit: changes.range_edit_stream(df, u), "update")
        assert [b[-1] for b in out if b][-1] == ("d", version, text, want)
        assert [tuple(r) for r in changes.range_edit_batch(spark.createDataFrame(rows, schema), unit).collect()] == [("d", version, text, want)]
        assert 3 < want < 36


def test_findings_equal_a_whole_run(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"f{i}.py", rng.choice(["a\n", "b \n", "c\t\n", "d"])) for i in range(40)]
    schema = "file_id long, path string, source string"
    out = streamed(spark, tmp_path, [rows[:25], rows[25:]], schema, changes.stream_findings, "append")
    whole = lint.line_findings(spark.createDataFrame(rows, schema))
    assert sorted(r for b in out for r in b) == sorted(tuple(r) for r in whole.collect())


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_diff_is_shortest_and_applies(spark):
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("xyz") for _ in range(rng.randrange(9))] for _ in range(2))
        s = diff._steps(a, b, True)
        assert s.count("equal") == lcs(a, b)
        i, out = iter(a), []
        j = iter(b)
        for step in s:
            if step == "insert":
                out.append(next(j))
            else:
                x = next(i)
                if step == "equal":
                    assert next(j) == x
                    out.append(x)
        assert out == b
    wide = diff._steps([str(i) for i in range(600)], [str(i) for i in range(1000, 1600)], True)
    assert wide == ["delete"] * 600 + ["insert"] * 600
    df = spark.createDataFrame([("p", "a\nb\nc\n", "a\nB\nc\n"), ("q", "same", "same")], "path string, before string, after string")
    got = diff.line_diff(df).collect()
    assert [tuple(r) for r in got] == [("p", 1, 1, 2, "--- p\n+++ p\n@@ -1,3 +1,3 @@\n a\n-b\n+B\n c\n")]
