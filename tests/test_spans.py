import random
import time

from pyspark.sql import functions as F

from sourcemill.operators import compare, fixes, graph, lines, lint, markup, spans


def test_lines(spark):
    df = spark.createDataFrame([(1, "﻿ab\r\nç\n"), (2, ""), (3, None)], "file_id int, source string")
    got = {(r.file_id, r.line): (r.start, r.end, r.text) for r in lines.explode_lines(df).collect()}
    assert got == {(1, 0): (3, 5, "ab"), (1, 1): (7, 9, "ç"), (1, 2): (10, 10, ""), (2, 0): (0, 0, "")}


def test_locate_units_and_back(spark):
    df = spark.createDataFrame([(1, "aé😀b\ncd")], "file_id int, source string")
    own = lines.explode_lines(df)
    at = spark.createDataFrame([(1, o) for o in (0, 1, 3, 7, 8, 9, 99)], "file_id int, offset long")
    want = {"utf8": [0, 1, 3, 7, 8, 0, 2], "utf16": [0, 1, 2, 4, 5, 0, 2], "utf32": [0, 1, 2, 3, 4, 0, 2]}
    for unit, columns in want.items():
        found = {r.offset: (r.line, r.column) for r in lines.locate(at, own, unit).collect()}
        assert [found[o][1] for o in (0, 1, 3, 7, 8, 9, 99)] == columns, unit
        points = spark.createDataFrame([(1, *found[o]) for o in (0, 1, 3, 7, 8, 9)], "file_id int, line int, column int")
        assert sorted(r.offset for r in lines.offset_at(points, own, unit).collect()) == [0, 1, 3, 7, 8, 9], unit
    inside = spark.createDataFrame([(1, 0, 2), (1, 0, 50), (1, 9, 0)], "file_id int, line int, column int")
    assert {(r.line, r.column): r.offset for r in lines.offset_at(inside, own, "utf8").collect()} == {(0, 2): None, (0, 50): None, (9, 0): None}
    assert {(r.line, r.column): r.offset for r in lines.offset_at(inside, own, "utf8", strict=False).collect()} == {(0, 2): 1, (0, 50): 8, (9, 0): None}


def walk(text):
    stack, out = [], {}
    kinds = {**spans.OPENING, **spans.CLOSING}
    for i, c in enumerate(text):
        if c in spans.OPENING:
            stack.append(i)
            out[i] = [len(stack), None]
        elif not stack:
            out[i] = [0, None]
        else:
            out[i] = [len(stack), None]
            j = stack.pop()
            if kinds[text[j]] == kinds[c]:
                out[i][1], out[j][1] = j, i
    return out


def test_brackets_like_a_stack(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("()[]{}") for _ in range(rng.randrange(1, 25))) for _ in range(200)]
    df = spark.createDataFrame([(f, i, c) for f, t in enumerate(texts) for i, c in enumerate(t)], "file_id int, idx long, text string")
    got = {(r.file_id, r.idx): [r.depth, r.partner] for r in spans.bracket_pairs(df).collect()}
    assert got == {(f, i): v for f, t in enumerate(texts) for i, v in walk(t).items()}


def test_merge_runs(spark):
    rng = random.Random(6)
    rows = [(f, a := rng.randrange(50), a + rng.randrange(6)) for f in range(30) for _ in range(12)]
    want = []
    for f in range(30):
        islands = []
        for _, a, b in sorted(r for r in rows if r[0] == f and r[1] < r[2]):
            if islands and a <= islands[-1][1]:
                islands[-1][1] = max(islands[-1][1], b)
            else:
                islands.append([a, b])
        want += [(f, *i) for i in islands]
    got = spans.merge_runs(spark.createDataFrame(rows, "file_id int, first int, last int"))
    assert sorted(tuple(r) for r in got.select("file_id", "first", "last").collect()) == sorted(want)


def overlap(a, b):
    return a[0] == b[0] or (a[0] < b[1] and b[0] < a[1])


def test_plan_apply_remap(spark):
    rng = random.Random(7)
    fix, edits = [], []
    for f in range(20):
        for k in range(15):
            i = f * 100 + k
            fix.append((i, f, rng.choice(["safe", "safe", "unsafe", "display"]), rng.choice([None, None, None, "g"])))
            edits += [(i, o, (at := rng.randrange(60)), rng.randrange(4), rng.choice(["", "xy"])) for o in range(rng.choice([1, 1, 2]))]
    want = set()
    for f in range(20):
        taken, groups = [], set()
        own = sorted((min(e[2] for e in edits if e[0] == x[0]), x[0], x) for x in fix if x[1] == f and x[2] == "safe")
        for _, i, x in own:
            es = [(e[2], e[2] + e[3]) for e in edits if e[0] == i]
            bad = any(overlap(p, q) for n, p in enumerate(es) for q in es[n + 1 :]) or any(overlap(p, q) for p in es for q in taken)
            if not bad and x[3] not in groups - {None}:
                taken += es
                groups.add(x[3])
                want.add((f, i))
    e = spark.createDataFrame(edits, "fix_id int, ordinal int, offset long, length long, replacement string")
    plan = fixes.plan_fixes(spark.createDataFrame(fix, "fix_id int, file_id int, applicability string, isolation string"), e)
    assert {tuple(r) for r in plan.collect()} == want

    source = spark.createDataFrame([(1, "aébc"), (2, "x")], "file_id int, source string")
    changes = spark.createDataFrame([(1, 1, 2, "EE"), (1, 2, 1, "no"), (1, 4, 0, "+"), (1, 9, 1, "no")], "file_id int, offset long, length long, replacement string")
    assert {r.file_id: (r.fixed, r.applied) for r in fixes.apply_edits(source, changes).collect()} == {1: ("aEEb+c", 2), 2: ("x", 0)}
    good = changes.where("replacement <> 'no'")
    at = spark.createDataFrame([(1, o) for o in range(6)] + [(2, 3)], "file_id int, offset long")
    moved = {(r.file_id, r.offset): r.moved for r in fixes.remap_offsets(at, good).collect()}
    assert moved == {(1, 0): 0, (1, 1): 3, (1, 2): 3, (1, 3): 3, (1, 4): 5, (1, 5): 6, (2, 3): 3}


def brute_plan(fix, edits):
    out, spans = [], {}
    for f, o, n in edits:
        spans.setdefault(f, []).append((o, o + n))
    over = lambda a, b: a[0] == b[0] or (a[0] < b[1] and b[0] < a[1])
    taken, groups = {}, set()
    for f, file, safe, group in sorted((x for x in fix if x[0] in spans), key=lambda x: (min(spans[x[0]])[0], x[0])):
        own, there = sorted(spans[f]), taken.setdefault(file, [])
        if safe != "safe" or (group is not None and (file, group) in groups):
            continue
        if any(over(a, b) for k, a in enumerate(own) for b in own[k + 1 :]) or any(over(a, b) for a in own for b in there):
            continue
        taken[file] += own
        groups.add((file, group))
        out.append((file, f))
    return sorted(out)


def test_plan_of_islands_equals_brute_force(spark):
    rng = random.Random(12)
    fix = [(i, rng.randrange(3), rng.choice(["safe", "safe", "safe", "unsafe"]), rng.choice([None] * 8 + ["g", "h"])) for i in range(900)]
    edits = [(i, rng.randrange(2500), rng.choice([0, 0, 1, 2, 5])) for i in range(900) for _ in range(rng.choice([1, 1, 1, 2, 3]))]
    f = spark.createDataFrame(fix, "fix_id int, file_id int, applicability string, isolation string")
    e = spark.createDataFrame([(i, 0, o, n) for i, o, n in edits], "fix_id int, ordinal int, offset long, length long")
    assert sorted(map(tuple, fixes.plan_fixes(f, e).collect())) == brute_plan(fix, edits)


def test_plan_of_one_large_file(spark):
    n = 200_000
    f = spark.range(n).select(F.col("id").alias("fix_id"), F.lit(1).alias("file_id"), F.lit("safe").alias("applicability"), F.when(F.col("id") % 1000 == 7, "g").alias("isolation"))
    e = spark.range(n).select(F.col("id").alias("fix_id"), F.lit(0).alias("ordinal"), (F.col("id") * 3).alias("offset"), F.when(F.col("id") % 5 == 0, 4).otherwise(2).cast("long").alias("length"))
    e = e.unionByName(spark.range(0, n, 1000).select(F.col("id").alias("fix_id"), F.lit(1).alias("ordinal"), (n * 3 + F.col("id")).alias("offset"), F.lit(2).cast("long").alias("length")))
    began = time.time()
    assert fixes.plan_fixes(f, e).count() == n - n // 5 - (n // 1000 - 1)
    assert time.time() - began < 60


def brute_claims(findings, directives):
    out = {}
    for i, file, code, line in findings:
        for late in (False, True):
            for f, d, kind, at, first, codes, wild in directives:
                if f != file or not (wild or code in codes) or (kind == "file") == late:
                    continue
                shut = any(f2 == file and k2 == "enable" and (w2 or code in c2) and at < l2 <= line for f2, _, k2, l2, _, c2, w2 in directives)
                if kind == "file" or (kind == "line" and first <= line <= at) or (kind == "disable" and at <= line and not shut):
                    out.setdefault(i, d)
    return out


DIRECTIVES = "file_id int, directive int, kind string, line int, first int, codes array<string>, wildcard boolean"


def test_region_claims_equal_brute_force(spark):
    rng = random.Random(5)
    findings = [(i, rng.randrange(3), rng.choice("ABC"), rng.randrange(60)) for i in range(300)]
    directives = []
    for file in range(3):
        at = 0
        for d in range(40):
            at += rng.randrange(3)
            kind, wild = rng.choice(["disable", "enable", "line", "line"] + ["file"] * (d % 19 == 18)), rng.random() < 0.15
            first = at + rng.randrange(2)
            directives.append((file, d, kind, first + rng.choice([0, 0, 1, 7]) if kind == "line" else at, first, [] if wild else rng.sample("ABC", rng.randrange(1, 3)), wild))
    f = spark.createDataFrame(findings, "finding_id int, file_id int, code string, line int")
    d = spark.createDataFrame(directives, DIRECTIVES)
    assert {r.finding_id: r.directive for r in lint.region_claims(f, d).collect()} == brute_claims(findings, directives)


def test_region_claims_of_one_large_file(spark):
    n = 100_000
    f = spark.range(n).select("id", F.lit(1).alias("file_id"), F.lit("A").alias("code"), F.col("id").cast("int").alias("line")).withColumnRenamed("id", "finding_id")
    kind = F.element_at(F.array(*map(F.lit, ("disable", "disable", "enable", "line"))), (F.col("id") % 4 + 1).cast("int"))
    d = spark.range(n).select(F.lit(1).alias("file_id"), F.col("id").cast("int").alias("directive"), kind.alias("kind"), F.col("id").cast("int").alias("line"), F.col("id").cast("int").alias("first"), F.array(F.lit("A")).alias("codes"), F.lit(False).alias("wildcard"))
    began = time.time()
    found = {r.finding_id: r.directive for r in lint.region_claims(f, d).collect()}
    assert time.time() - began < 60
    # Lines 0 and 1 of each four are disabled by the first, 2 enables, and 3 has its own directive.
    assert found == {i: i // 4 * 4 + (3 if i % 4 == 3 else 0) for i in range(n) if i % 4 != 2}


def test_cycles_like_a_walk(spark):
    rng = random.Random(8)
    for n, m in ((24, 34), (6, 0)):
        edges = [(rng.randrange(n), rng.choice([None, *range(n)])) for _ in range(m)]
        reach = {a: {a} for a in range(n)}
        for _ in range(n):
            for a in range(n):
                for s, d in edges:
                    if d is not None and s in reach[a]:
                        reach[a].add(d)
        want = {}
        for a in range(n):
            part = {b for b in range(n) if b in reach[a] and a in reach[b]}
            if len(part) > 1 or (a, a) in edges:
                want[a] = min(part)
        e = spark.createDataFrame([(s, 0, d) for s, d in edges], "src long, fact int, dst long")
        nodes = spark.createDataFrame([(a,) for a in range(n)], "node long")
        assert {r.node: r.component for r in graph.cycles(e, nodes).collect()} == want
        level = {r.node: (r.level, r.component) for r in graph.dependency_order(e, nodes).collect()}
        assert len(level) == n
        assert all(level[s][1] == level[d][1] or level[s][0] > level[d][0] for s, d in edges if d is not None)
        longest = {}

        def depth(c):
            if c not in longest:
                longest[c] = 0
                below = {level[d][1] for s, d in edges if d is not None and level[s][1] == c} - {c}
                longest[c] = max((depth(b) + 1 for b in below), default=0)
            return longest[c]

        assert all(level[a][0] == depth(level[a][1]) for a in range(n))
        if not m:
            continue
        roots = spark.createDataFrame([(0,), (1,)], "file long")
        assert {r.file for r in graph.reachable(e, roots).collect()} == reach[0] | reach[1]
        behind = {(r.file, r.dependent) for r in graph.transitive_dependents(e, roots).collect()}
        assert behind == {(f, s) for f in (0, 1) for s, d in edges if d is not None for s in [a for a in range(n) if s in reach[a]] if f in reach[d]}


def test_templates_of_any_depth(spark):
    n = 200
    kind = F.when(F.col("id") % 2 == 0, "extends").otherwise("include")
    facts = spark.range(n).select(F.col("id").alias("file_id"), F.lit(0).alias("fact"), kind.alias("kind"), F.concat(F.lit("t"), F.col("id") + 1).alias("specifier"))
    facts = facts.unionByName(spark.createDataFrame([(5, 1, "include", "t5"), (0, 1, "extends", "t2"), (0, 2, "extends", "t4")], "file_id long, fact int, kind string, specifier string"))
    keys = spark.range(n).select(F.concat(F.lit("t"), F.col("id")).alias("specifier"), F.col("id").alias("file_id"))
    got = {(r.file_id, r.target, r.specifier): (r.depth, r.extended, r.state) for r in graph.template_closure(facts, keys).collect()}
    assert len(got) == n * (n - 1) // 2 + 1 + n
    assert got[0, 1, None] == (1, 1, "found") and got[0, 2, None] == (1, 1, "found") and got[0, 3, None] == (2, 2, "found") and got[0, 5, None] == (2, 2, "found")
    assert got[5, 5, None] == (1, None, "circular") and got[1, 199, None] == (198, None, "found") and got[198, None, "t200"] == (2, None, "missing")
    chain = facts.withColumn("kind", F.lit("extends")).where("fact = 0")
    tree = {(r.file_id, r.depth): (r.target, r.state) for r in graph.template_tree(chain, keys).collect()}
    assert len(tree) == n * (n + 1) // 2 and tree[0, 199] == (199, "found") and tree[0, 200] == (None, "missing")
    ring = spark.createDataFrame([(1, 0, "extends", "t2"), (2, 0, "extends", "t3"), (3, 0, "extends", "t2"), (4, 0, "extends", "t4")], "file_id long, fact int, kind string, specifier string")
    rows = sorted((r.file_id, r.depth, r.target, r.state) for r in graph.template_tree(ring, keys).collect())
    assert rows == [(1, 1, 2, "found"), (1, 2, 3, "found"), (1, 3, 2, "circular"), (2, 1, 3, "found"), (2, 2, 2, "circular"), (3, 1, 2, "found"), (3, 2, 3, "circular"), (4, 1, 4, "circular")]


def test_long_chains_and_rings_take_few_rounds(spark):
    n = 5000
    name = lambda c: (c * 1237) % n
    ring = spark.range(n).select(name(F.col("id")).alias("src"), name((F.col("id") + 1) % n).alias("dst"))
    chain, nodes = ring.where("dst <> 0"), spark.range(n).select(F.col("id").alias("node"))
    assert graph.cycles(ring, nodes).agg(F.count("*"), F.countDistinct("component")).first() == (n, 1)
    assert graph.cycles(chain, nodes).count() == 0
    order = graph.dependency_order(chain, nodes).agg(F.min("level"), F.max("level"), F.countDistinct("level")).first()
    assert order == (0, n - 1, n)
    assert graph.reachable(chain, nodes.where("node = 0").select(F.col("node").alias("file"))).count() == n


def test_prefix_check_finds_planted_faults(spark):
    df = spark.createDataFrame([(1, "a (b) [c"), (2, "none"), (3, "é{}é")], "file_id int, source string")
    tokens = lambda f: spans.bracket_tokens(f).select("file_id", F.col("text").alias("name"), "offset", (F.col("offset") + F.col("length")).alias("end"))
    check = lambda extract: sorted(map(tuple, compare.prefix_check(df, extract, "# é\n").collect()))
    assert check(tokens) == []
    characters = lambda f: tokens(f).withColumn("offset", F.col("offset") - F.when(F.col("offset") > 4, 1).otherwise(0))
    assert {r[0] for r in check(characters)} == {1, 3}
    first = lambda f: tokens(f).where("offset < 9")
    assert all(r[-2:] == (1, 0) for r in check(first)) and len(check(first)) == 2
    flat = lambda f: f.select("file_id", F.char_length("source").alias("name"))
    assert len(check(flat)) == 6


def test_line_findings_edges(spark):
    rows = [(1, "a/Bad.py", "x\t\ny \r\n" + "é" * 101 + "\n" + "https://" + "a" * 120), (2, "ok.py", "fine\n"), (3, "n.py", None)]
    df = spark.createDataFrame(rows, "file_id int, path string, source string")
    got = sorted((r.file_id, r.code, r.line) for r in lint.line_findings(df).collect())
    assert got == [(1, "carriage_return", 2), (1, "file_name", 0), (1, "final_newline", 0), (1, "tab", 1), (1, "width", 3)]


def test_serial_equals_repartitioned(spark):
    df = spark.createDataFrame([(i, f"{i}.py", "a\n" * (i % 5) + "b \n") for i in range(200)], "file_id int, path string, source string")
    rows = lambda d: sorted(tuple(r) for r in lint.line_findings(d).collect())
    assert rows(df.coalesce(1)) == rows(df.repartition(7))
    assert lint.line_findings(df.where(F.lit(False))).count() == 0


def test_markup_regions_tags_and_holes(spark):
    page = """<!-- <script>no()</script> --><div X-DATA="{ open: {{ a }} }" @click='go("é")' style="" x-on:blur=b style=top>é</div>
<script></script><script type="text/template">no</script><script type=module>let a = 1 // x
</script><STYLE>p { /* c */ }</STYLE><script src=x>{% if a %}b(){% endif %} /* d */</script><a style='{{ s }}'>{# t #}</a><script>end"""
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    raw = page.encode()
    found = markup.markup_regions(df, tags={"X-DATA": "data", "@*": "on", "x-on:*": "on"}).orderBy("ordinal").collect()
    cut = lambda a, n: raw[a : a + n].decode()
    assert [(r.kind, r.tag, cut(r.offset, r.length), [cut(*h) for h in r.holes]) for r in found] == [
        ("attribute", "data", "{ open: {{ a }} }", ["{{ a }}"]), ("attribute", "on", 'go("é")', []), ("attribute", "on", "b", []), ("attribute", "style", "top", []),
        ("script", None, "let a = 1 // x\n", []), ("style", None, "p { /* c */ }", []), ("script", None, "{% if a %}b(){% endif %} /* d */", ["{% if a %}", "{% endif %}"]),
        ("attribute", "style", "{{ s }}", ["{{ s }}"]), ("script", None, "end", []),
    ]
    assert [r.ordinal for r in found] == list(range(9))
    comments = [(r.kind, cut(r.offset, r.length)) for r in markup.comment_spans(df).orderBy("ordinal").collect()]
    assert comments == [("html", "<!-- <script>no()</script> -->"), ("script", "// x"), ("style", "/* c */"), ("script", "/* d */"), ("template", "{# t #}")]


def test_markup_ids(spark):
    page = """<i id=a></i><i id="b" id="no"></i><i aria-activedescendant="a c" headers=" b "></i><label for="a"></label><label for="a b"></label>
<a href="#b"></a><a href="#"></a><a href="b"></a><i id="{{ x }}"></i><img usemap='#m'>"""
    defs, uses = markup.markup_ids(markup.attributes(spark.createDataFrame([(1, page)], "page_id long, html string")))
    assert sorted(r.name for r in defs.collect()) == ["a", "b"]
    assert sorted(r.name for r in uses.collect()) == ["a", "a", "b", "b", "c", "m"]


def test_locate_is_linear_and_knows_a_bom(spark):
    text = "\ufeffab\r\ncd\n" + "x\n" * 20_000
    n = len(text.encode())
    located = lines.locate(spark.createDataFrame([(1, i) for i in [-1, 0, 2, 3, 5, 7, *range(10, n, 2)]], "file_id long, offset long"), lines.explode_lines(spark.createDataFrame([(1, text)], "file_id long, source string")))
    got = {r.offset: (r.line, r.column) for r in located.collect()}
    assert [got[k] for k in (-1, 0, 2, 3, 5, 7)] == [(0, 0), (0, 0), (0, 0), (0, 0), (0, 2), (1, 0)]
    assert all(got[i] == (2 + (i - 10) // 2, 0) for i in range(10, n - 2, 2))


def test_masks_across_buckets(spark):
    regions = [(1, 0, 0, "ab\ncd" * 40), (1, 1, 500, "é" * 20), (2, 2, 0, "whole"), (1, 3, 900, "")]
    holes = [(1, 1, 3), (1, 60, 100), (1, 195, 320), (1, 530, 9), (2, 7, 2), (1, 0, 0)]
    df = spark.createDataFrame(regions, "file_id long, region long, offset long, text string")
    got = {r.region: r.text for r in spans.mask_spans(df, spark.createDataFrame(holes, "file_id long, offset long, length long"), bucket=16).collect()}
    for f, r, at, text in regions:
        b = bytearray(text.encode())
        for hf, c, n in holes:
            for i in range(max(0, c - at), min(len(b), c + n - at)) if hf == f else ():
                b[i] = b[i] if b[i] == 10 else 32
        assert got[r] == b.decode("utf-8", "replace")


def test_locate_in_long_lines(spark):
    text = "\ufeff" + "né𝄞x" * 90 + "\r\n" + "a" * 300 + "\n\nü" + "z" * 63 + "é"
    raw = text.encode()
    own = lines.explode_lines(spark.createDataFrame([(1, text)], "file_id long, source string"))
    at = spark.createDataFrame([(1, i) for i in range(-1, len(raw) + 3)], "file_id long, offset long")
    spans = [(r.line, r.start, r.end) for r in own.orderBy("line").collect()]
    for unit, size in (("utf8", lambda b: len(b)), ("utf16", lambda b: len(b.decode(errors="ignore").encode("utf-16-be")) // 2), ("utf32", lambda b: len(b.decode(errors="ignore")))):
        for r in lines.locate(at, own, unit).collect():
            line, start, end = max((x for x in spans if x[1] <= r.offset), default=spans[0])
            part = raw[start : max(start, min(r.offset, end))]
            assert (r.line, r.column) == (line, size(part.decode(errors="ignore").encode()))
