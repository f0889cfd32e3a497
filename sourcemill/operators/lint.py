"""The lint pipeline: line rules, rule selection, suppression, baselines and tallies."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import baseline_key
from ..functions.paths import file_name, order_key
from .lines import split_lines

FINDING = "file_id, code, line, message"


def line_findings(files: DataFrame, width: int = 100, banned: tuple[str, ...] = ()) -> DataFrame:
    """file_id, code, line (from 1; 0 for the file) and message: tab, carriage return, trailing space, width, banned text, missing newline, file name.

    Narrow: one pass over the lines, no shuffle.  A line over ``width`` code points is
    let pass where it holds ``https://``.
    """
    raw = F.col("raw")
    tests = [
        ("tab", F.contains(raw, F.lit("\t")), "the line carries a tab"),
        ("carriage_return", F.contains(raw, F.lit("\r")), "the line carries a carriage return"),
        ("trailing_space", F.endswith(raw, F.lit(" ")), "the line carries trailing whitespace"),
        ("width", (F.char_length(raw) > width) & ~F.contains(raw, F.lit("https://")), "the line is too wide"),
        *[("banned", F.contains(raw, F.lit(b)), f"the line carries {b}") for b in banned],
    ]
    hits = F.filter(F.array(*[F.when(test, F.struct(F.lit(code).alias("code"), F.lit(text).alias("message"))) for code, test, text in tests]), lambda x: x.isNotNull())
    found = split_lines(files).select("file_id", (F.col("line") + 1).alias("line"), F.explode(hits).alias("f")).select("file_id", "f.code", "line", "f.message")
    whole = [
        ("final_newline", F.col("source").isNotNull() & ~F.endswith("source", F.lit("\n")), "the file does not end with a newline"),
        ("file_name", file_name(F.col("path")).rlike("[^a-z0-9_.]"), "the file name is not snake case"),
    ]
    hits = F.filter(F.array(*[F.when(test, F.struct(F.lit(code).alias("code"), F.lit(text).alias("message"))) for code, test, text in whole]), lambda x: x.isNotNull())
    of_file = files.select("file_id", F.explode(hits).alias("f")).select("file_id", "f.code", F.lit(0).alias("line"), "f.message")
    return found.unionByName(of_file)


def _declaration_indent(text: Column) -> Column:
    one = F.rtrim(text).rlike(r";$") & text.rlike(r"^ *(pub )?(const|var) ")
    return F.when(one, F.length(F.regexp_extract(text, "^( *)", 1)))


def blank_line_findings(files: DataFrame) -> DataFrame:
    """file_id, code, line and message of blank lines that follow one, open or close a block or part two declarations, and of files that end with more than one newline.

    A file that ends so gives that one finding only.
    """
    many = F.endswith("source", F.lit("\n\n"))
    ends = files.where(many).select("file_id", F.lit("final_newlines").alias("code"), F.lit(0).alias("line"), F.lit("the file ends with more than one newline").alias("message"))
    rows = split_lines(files.where(~many).withColumn("source", F.regexp_replace("source", "\n+$", "")))
    order = Window.partitionBy("file_id").orderBy("line")
    above, below = F.coalesce(F.lag("raw").over(order), F.lit("")), F.coalesce(F.lead("raw").over(order), F.lit(""))
    rows = rows.withColumns({"above": above, "below": below}).where("raw = ''")
    code = F.when((F.col("line") > 0) & (F.col("above") == ""), "blank_after_blank")
    code = code.when(F.rtrim("above").rlike(r"\{$"), "blank_opens_block").when(F.ltrim("below").rlike(r"^\}"), "blank_closes_block")
    code = code.when(_declaration_indent(F.col("above")) == _declaration_indent(F.col("below")), "blank_parts_declarations")
    found = rows.select("file_id", code.alias("code"), (F.col("line") + 1).alias("line")).where("code is not null")
    return found.withColumn("message", F.concat(F.lit("the blank line "), F.regexp_replace(F.substring("code", 7, 99), "_", " "))).unionByName(ends)


def selector_frame(spark: SparkSession, select=None, extend=(), ignore=()) -> DataFrame:
    """kind (select or ignore) and prefix of rule selectors; ``ALL`` is the empty prefix."""
    rows = [("select", s) for s in (select or [])] + [("select", s) for s in extend] + [("ignore", s) for s in ignore]
    return spark.createDataFrame([(k, "" if s == "ALL" else s) for k, s in rows], "kind string, prefix string")


def select_rules(rules: DataFrame, selectors: DataFrame, explicit: bool, preview: bool = False) -> DataFrame:
    """rules(code, default_on, group) with enabled.

    A selector's strength is the length of its prefix.  Rules that are on by default
    count as selected with strength 0 unless select was given (``explicit``).  A rule is
    enabled where its best selection is stronger than its best ignore; rules in preview,
    deprecated or removed need their exact code, or preview mode for the first.
    Rows of equal rules stay: nothing is grouped or shuffled.
    """
    held = selectors.agg(F.collect_list(F.struct("kind", "prefix")).alias("_held"))
    n = rules.crossJoin(F.broadcast(held))  # one row
    hits = F.filter("_held", lambda x: F.startswith(F.col("code"), x["prefix"]))
    best = lambda kind: F.array_max(F.transform(F.filter(hits, lambda x: x["kind"] == kind), lambda x: F.length(x["prefix"])))
    exact = F.exists(hits, lambda x: (x["kind"] == "select") & (x["prefix"] == F.col("code")))
    n = n.withColumns({"_s": best("select"), "_i": best("ignore"), "_x": F.coalesce(exact, F.lit(False))})
    chosen = F.coalesce("_s", F.when(F.col("default_on") & F.lit(not explicit), 0))
    on = F.coalesce(chosen > F.coalesce("_i", F.lit(-1)), F.lit(False))
    group = (F.col("group") == "stable") | F.col("_x") | ((F.col("group") == "preview") & F.lit(preview))
    return n.withColumn("enabled", on & group).select(*rules.columns, "enabled")


def file_rules(enabled: DataFrame, files: DataFrame, own_ignores: DataFrame) -> DataFrame:
    """file_id and code of the rules that hold for each file.

    enabled: code of enabled rules and language (null: all); files: file_id, language;
    own_ignores: file_id, prefix.
    """
    held = files.select("file_id", "language").join(F.broadcast(enabled.withColumnRenamed("language", "_l")), F.col("_l").isNull() | (F.col("_l") == F.col("language")))  # the rule table of the library
    held = held.select("file_id", "code")
    return held.join(own_ignores, (held["file_id"] == own_ignores["file_id"]) & F.startswith(held["code"], own_ignores["prefix"]), "left_anti")


def run_rules(outputs: list[DataFrame], rules: DataFrame, files: DataFrame) -> DataFrame:
    """The findings of all rule outputs whose rule is enabled and covers the file's language, with the severity and fix that the policy leaves.

    outputs: file_id, code, line, message, severity, applicability (null without a fix).
    rules: code, enabled, language, severity, fixable, applicability (nulls: no override).
    """
    whole = outputs[0]
    for o in outputs[1:]:
        whole = whole.unionByName(o, allowMissingColumns=True)
    r = rules.where("enabled").select("code", F.col("language").alias("_l"), F.col("severity").alias("_s"), F.col("fixable").alias("_f"), F.col("applicability").alias("_a"))
    rows = whole.join(F.broadcast(r), "code").join(files.select("file_id", "language"), "file_id").where("_l is null or _l = language")  # the rule table of the library
    fix = F.when(F.coalesce("_f", F.lit(True)), F.when(F.col("applicability").isNotNull(), F.coalesce("_a", "applicability")))
    return rows.withColumn("severity", F.coalesce("_s", "severity")).withColumn("applicability", fix).drop("_l", "_s", "_f", "_a", "language")


# Severities from the lowest, and what report formats call them.
SEVERITIES = ("hint", "information", "warning", "error")
SEVERITY_NAMES = {
    "azure": ("warning", "warning", "warning", "error"),
    "github": ("notice", "notice", "warning", "error"),
    "gitlab": ("info", "info", "minor", "major"),
    "lsp": ("4", "3", "2", "1"),
    "rdjson": ("INFO", "INFO", "WARNING", "ERROR"),
    "sarif": ("note", "note", "warning", "error"),
}


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1


def severity_filter(findings: DataFrame, least: str) -> DataFrame:
    return findings.where(severity_rank(F.col("severity")) >= SEVERITIES.index(least))


def severity_as(severity: Column, format_: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in zip(SEVERITIES, SEVERITY_NAMES[format_], strict=True) for x in kv])
    return F.try_element_at(table, severity)


def tally(findings: DataFrame, unsafe: bool = False) -> DataFrame:
    """code, n, fixable and mark (all, some or none) of every code; fixable counts safe fixes, or all but display-only if unsafe."""
    can = F.col("applicability").isin("safe", "unsafe") if unsafe else F.col("applicability") == "safe"
    n = findings.groupBy("code").agg(F.count("*").alias("n"), F.sum(F.when(can, 1).otherwise(0)).alias("fixable"))
    return n.withColumn("mark", F.when(F.col("fixable") == F.col("n"), "all").when(F.col("fixable") > 0, "some").otherwise("none"))


def order_tally(tallied: DataFrame) -> DataFrame:
    return tallied.orderBy(F.col("n").desc(), "code")


def order_findings(findings: DataFrame) -> DataFrame:
    """By path (``/`` lowest), offset, code and arrival: a range partitioning, not one task."""
    return findings.orderBy(order_key(F.col("path")), "offset", "code", "arrival")


def with_related(findings: DataFrame, related: DataFrame) -> DataFrame:
    """findings with ``related``: its rows(finding_id, ordinal, file_id, offset, length, message) in order."""
    n = related.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "file_id", "offset", "length", "message"))).alias("related"))
    return findings.join(n, "finding_id", "left")


def timing_tally(timings: DataFrame) -> DataFrame:
    """stage, rule, nanos and documents, with subtotals of each stage and in all (nulls)."""
    return timings.rollup("stage", "rule").agg(F.sum("nanos").alias("nanos"), F.count_distinct("document").alias("documents"))


def effective_line(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """lines(file_id, line, ...) with at: the last line of the joined run that holds the line, or the line.

    runs(file_id, first, last) do not overlap, so an as-of window over one union finds
    the run that begins last at or before each line.
    """
    marks = runs.select("file_id", F.col("first").alias("_at"), F.lit(0).alias("_kind"), F.col("last").alias("_last"), F.lit(None).cast(lines.schema).alias("_row"))
    rows = lines.select("file_id", F.col("line").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_last"), F.struct(*lines.columns).alias("_row"))
    order = Window.partitionBy("file_id").orderBy("_at", "_kind")
    reach = F.last("_last", True).over(order)
    found = marks.unionByName(rows).withColumn("_reach", reach).where("_kind = 1")
    return found.select(*(F.col(f"_row.{c}").alias(c) for c in lines.columns), F.when(F.col("_reach") >= F.col("_at"), F.col("_reach")).otherwise(F.col("_at")).alias("at"))


def line_suppress(findings: DataFrame, directives: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, claims): findings that no line directive suppresses, and finding_id, directive of the others.

    findings: finding_id, file_id, line, code; directives: file_id, directive, line (null
    for the whole file), blanket, codes.  Both are matched at the last line of the joined
    run they stand in.  A directive for the whole file comes first, then the smallest number.
    """
    at_line = effective_line(findings.select("finding_id", "file_id", "line", "code"), runs)
    own = effective_line(directives.where("line is not null").select("file_id", "line", "directive", "blanket", "codes"), runs)
    covers = lambda d: F.col(f"{d}.blanket") | F.array_contains(F.col(f"{d}.codes"), F.col("f.code"))
    hits = at_line.alias("f").join(own.alias("d"), (F.col("f.file_id") == F.col("d.file_id")) & (F.col("f.at") == F.col("d.at")) & covers("d")).select("f.finding_id", F.lit(1).alias("rank"), "d.directive")
    whole = directives.where("line is null")
    wide = at_line.alias("f").join(whole.alias("d"), (F.col("f.file_id") == F.col("d.file_id")) & covers("d")).select("f.finding_id", F.lit(0).alias("rank"), "d.directive")
    claims = hits.unionByName(wide).groupBy("finding_id").agg(F.min(F.struct("rank", "directive")).alias("c")).select("finding_id", "c.directive")
    return findings.join(claims, "finding_id", "left_anti"), claims


def _dyadic(first, last) -> Column:
    """The lines first..last as few aligned blocks: structs of level k and number, the block number n of level k holding lines n 2^k to (n + 1) 2^k - 1."""
    lo, hi = f"cast(ceil({first} / power(2, k)) as bigint)", f"cast(floor(({last} + 1) / power(2, k)) as bigint)"
    left = f"if({lo} < {hi} and {lo} % 2 = 1, named_struct('level', k, 'block', {lo}), null)"
    right = f"if({hi} % 2 = 1 and {lo} + {lo} % 2 < {hi}, named_struct('level', k, 'block', {hi} - 1), null)"
    return F.expr(f"filter(flatten(transform(sequence(0, 31), k -> array({left}, {right}))), x -> x is not null)")


def region_claims(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """finding_id and directive: the first directive, in order, that suppresses each suppressed finding.

    directives: file_id, directive (its number), kind (file, line, disable, enable), line,
    first, codes, wildcard.  A file directive covers the file and comes first; a line
    directive covers first..line; a disable covers from its line on, unless an enable of
    the code after it stands at or before the finding.  Directives are numbered in the
    order of their lines.

    Disables, enables and findings of a file and code are swept together in the order of
    their lines: enables count up a number, and the first disable under the present
    number is the one that claims.  Stretches of line directives are looked up by
    aligned blocks of lines.  Both are linear in the rows of a file, up to a logarithm.
    """
    codes = directives.where("not wildcard").select("file_id", "directive", "kind", "line", "first", F.explode("codes").alias("code"))
    wild = directives.where("wildcard").select("file_id", "directive", "kind", "line", "first").join(findings.select("file_id", "code").distinct(), "file_id")
    d = codes.unionByName(wild.select(codes.columns))
    f = findings.select("finding_id", "file_id", "code", "line")
    # A disable on the line of an enable stands after it.
    marks = d.where("kind in ('enable', 'disable')").select("file_id", "code", F.col("line").cast("long").alias("line"), F.when(F.col("kind") == "enable", 0).otherwise(1).alias("turn"), F.col("directive").cast("long").alias("directive"), F.lit(None).cast(f.schema["finding_id"].dataType).alias("finding_id"))
    swept = marks.unionByName(f.select("file_id", "code", F.col("line").cast("long").alias("line"), F.lit(2).alias("turn"), F.lit(None).cast("long").alias("directive"), "finding_id"))
    swept = swept.withColumn("open", F.sum(F.when(F.col("turn") == 0, 1).otherwise(0)).over(Window.partitionBy("file_id", "code").orderBy("line", "turn")))
    since = Window.partitionBy("file_id", "code", "open").orderBy("line", "turn")
    swept = swept.withColumn("claim", F.min(F.when(F.col("turn") == 1, F.col("directive"))).over(since)).where("turn = 2 and claim is not null")
    hits = swept.select("finding_id", F.lit(1).alias("late"), F.col("claim").alias("directive"))
    whole = d.where("kind = 'file'").groupBy("file_id", "code").agg(F.min("directive").cast("long").alias("directive"))
    hits = hits.unionByName(f.join(whole, ["file_id", "code"]).select("finding_id", F.lit(0).alias("late"), "directive"))
    lines = d.where("kind = 'line' and first <= line").select("file_id", "code", "directive", F.explode(_dyadic("first", "line")).alias("b"))
    lines = lines.groupBy("file_id", "code", "b.level", "b.block").agg(F.min("directive").cast("long").alias("directive"))
    levels = [r["level"] for r in lines.select("level").distinct().collect()]  # 32 at most
    asked = f.withColumn("level", F.explode(F.array(*map(F.lit, levels or [0])))).withColumn("block", F.expr("cast(floor(line / power(2, level)) as bigint)"))
    hits = hits.unionByName(asked.join(lines, ["file_id", "code", "level", "block"]).select("finding_id", F.lit(1).alias("late"), "directive"))
    return hits.groupBy("finding_id").agg(F.min(F.struct("late", "directive")).alias("c")).select("finding_id", "c.directive")


def region_suppress(findings: DataFrame, directives: DataFrame) -> DataFrame:
    return findings.join(region_claims(findings, directives), "finding_id", "left_anti")


# What follows a marker in a comment, in the order in which it is tried.
DIRECTIVE_WORDS = (("file", "disable-file"), ("disable", "disable"), ("enable", "enable"), ("line", "ignore"))


def parse_directives(comments: DataFrame, marker: str) -> DataFrame:
    """file_id, directive, kind, line, first, codes and wildcard of the comments that hold ``marker:`` and a word.

    comments: file_id, offset, line, own_line (nothing else on it), next_line (the next
    line with code), text.  A line directive on a line of its own covers up to the next
    line with code.  Codes are words of letters, digits and ``-./_``; none means all.
    """
    word = F.regexp_extract("text", rf"\b{marker}:\s*([a-z-]+)", 1)
    kind = F.lit(None)
    for name, spelled in DIRECTIVE_WORDS:
        kind = F.when(word == spelled, F.coalesce(kind, F.lit(name))).otherwise(kind)
    rest = F.regexp_extract("text", rf"\b{marker}:\s*[a-z-]+\s*(.*)$", 1)
    codes = F.regexp_extract_all(F.regexp_replace(rest, r"\s--\s.*$", ""), F.lit(r"([0-9A-Za-z][0-9A-Za-z._/-]*)"), 1)
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("offset")) - 1
    rows = comments.withColumn("kind", kind).where("kind is not null").withColumns({"directive": number, "codes": codes})
    target = F.when((F.col("kind") == "line") & F.col("own_line"), F.coalesce("next_line", "line")).otherwise(F.col("line"))
    return rows.select("file_id", "directive", "kind", target.alias("line"), F.col("line").alias("first"), "codes", (F.size("codes") == 0).alias("wildcard"))


@dataclass(frozen=True)
class Markers:
    """What opens a directive of each kind in a comment, what encloses its list of codes, and how lines of annotation begin."""

    file: str
    disable: str
    enable: str
    line: str
    annotation: str = ""
    open: str = ""
    close: str = ""


#: Annotations that a directive is carried past, and lines of one of them.
ANNOTATIONS = 32


def _carried(rows: DataFrame, lines: DataFrame, prefix: str) -> DataFrame:
    """file_id, offset and target of rows(file_id, offset, line): the next line that no annotation begins on.

    An annotation goes on until its brackets close.  Where the file ends first, or there
    are too many, the target is the line after the directive.  Only the lines after a
    directive are looked up, and only where the next one is an annotation.
    """
    text = F.col("text")
    count = lambda which: F.length(F.regexp_replace(text, which, ""))
    seen = lines.select("file_id", F.col("line").alias("at"), F.startswith(F.ltrim(text), F.lit(prefix)).alias("starts"), (count(r"[^\[(]") - count(r"[^\])]")).alias("more"))
    next_ = rows.withColumn("at", F.col("line") + 1).join(seen, ["file_id", "at"], "left").where("starts").select("file_id", "offset", "line")
    reach = next_.select("file_id", "offset", "line", F.explode(F.expr(f"sequence(line + 1, line + {ANNOTATIONS * ANNOTATIONS + 1})")).alias("at"))
    after = reach.join(seen, ["file_id", "at"]).groupBy("file_id", "offset", "line").agg(F.array_sort(F.collect_list(F.struct("at", "starts", "more"))).alias("after"))
    state = "named_struct('target', cast(null as int), 'depth', 0, 'inside', 0, 'n', 0)"
    ends = f"(s.depth + x.more <= 0 or s.inside + 1 = {ANNOTATIONS})"
    step = f"""if(s.target is not null, s,
      if(s.inside = 0 and (s.n = {ANNOTATIONS} or not x.starts), named_struct('target', if(s.n = {ANNOTATIONS}, line + 1, x.at), 'depth', 0, 'inside', 0, 'n', s.n),
        named_struct('target', cast(null as int), 'depth', if({ends}, 0, s.depth + x.more), 'inside', if({ends}, 0, s.inside + 1), 'n', s.n + if(s.inside = 0, 1, 0))))"""
    return after.select("file_id", "offset", F.expr(f"aggregate(after, {state}, (s, x) -> {step}).target").alias("target"))


def region_directives(comments: DataFrame, lines: DataFrame, markers: Markers) -> DataFrame:
    """file_id, directive, kind, line, first, codes, wildcard and unclosed of the directives in comments, as region_claims takes them.

    comments: file_id, offset, text; lines: those of the files, by explode_lines.  The first
    marker found in the order file, disable, enable, line decides; what follows `` -- `` is a
    reason.  Codes are words of letters, digits and ``-./_`` that end in a letter or digit;
    none, a ``*`` or no list at all means all codes.  A line directive on a line of its own
    covers up to the next line past annotations.
    """
    at = lines.select("file_id", F.col("start").alias("pos"), F.lit(0).alias("turn"), F.struct("line", "start", F.col("text").alias("whole")).alias("l"), F.lit(None).cast("string").alias("text"))
    said = comments.select("file_id", F.col("offset").cast("long").alias("pos"), F.lit(1).alias("turn"), F.lit(None).cast(at.schema["l"].dataType).alias("l"), "text")
    placed = at.unionByName(said).withColumn("l", F.last("l", True).over(Window.partitionBy("file_id").orderBy("pos", "turn"))).where("turn = 1")
    blank = F.octet_length(F.regexp_extract("l.whole", r"^([\s\x0B]*)", 1))
    rows = placed.select("file_id", F.col("pos").alias("offset"), F.col("l.line").alias("line"), (F.col("pos") - F.col("l.start") <= blank).alias("own_line"), F.split_part("text", F.lit(" -- "), F.lit(1)).alias("body"))
    kind, rest = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in ("line", "enable", "disable", "file"):
        marker = getattr(markers, name)
        found = F.instr("body", marker)
        kind = F.when(found > 0, name).otherwise(kind)
        rest = F.when(found > 0, F.ltrim(F.substring(F.col("body"), found + len(marker), F.lit(1 << 30)))).otherwise(rest)
    rows = rows.withColumns({"kind": kind, "rest": rest}).where("kind is not null")
    listed = F.startswith("rest", F.lit(markers.open)) if markers.open else F.lit(True)
    inner = F.substring(F.col("rest"), F.lit(len(markers.open) + 1), F.lit(1 << 30))
    closed = F.contains(inner, F.lit(markers.close)) if markers.close else F.lit(True)
    inner = F.split_part(inner, F.lit(markers.close), F.lit(1)) if markers.close else inner
    inner = F.when(listed & ~F.contains(inner, F.lit("*")), inner).otherwise("")
    codes = F.regexp_extract_all(inner, F.lit(r"([0-9A-Za-z](?:[0-9A-Za-z._/-]*[0-9A-Za-z])?)"), 1)
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("offset")) - 1
    rows = rows.withColumns({"codes": codes, "unclosed": listed & ~closed, "directive": number})
    target = F.when((F.col("kind") == "line") & F.col("own_line"), F.col("line") + 1).otherwise(F.col("line"))
    if markers.annotation:
        carried = _carried(rows.where("kind = 'line' and own_line").select("file_id", "offset", "line"), lines, markers.annotation)
        rows = rows.join(carried.withColumnRenamed("target", "_t"), ["file_id", "offset"], "left")
        target = F.coalesce("_t", target)
    rows = rows.withColumn("target", target)
    return rows.select("file_id", "offset", "directive", "kind", F.col("target").alias("line"), F.least("target", F.col("line") + 1).alias("first"), "codes", (F.size("codes") == 0).alias("wildcard"), "unclosed")


def read_suppressions(comments: DataFrame, word: str = "noqa", file_prefixes: tuple[str, ...] = ("flake8:", "ruff:")) -> DataFrame:
    """file_id, offset, directive, line, blanket and codes of the comments that suppress by a word, as line_suppress takes them.

    comments: file_id, offset, line, text.  The word, in any case, stands at the start of
    the comment, after one of ``#*/`` or after a prefix that makes it hold for the file
    (line is null), and ends with the comment, a colon or white space.  After a colon, or
    after blanks where a code follows, comes a list of codes (capitals, then digits) up
    to the first other word.  No list suppresses everything; a malformed code makes a
    list blanket, or void if a colon stands before it, and so does an empty list.
    """
    end, quoted = r"(?=:|[\s\x0B]|\z)", re.escape(word)
    prefix = "[#/*]*[ \t]*(?:" + "|".join(map(re.escape, file_prefixes)) + ")[ \t]*"
    fits = rf"(?s)^(?:(?:.*?[#*/])?[ \t]*|{prefix})(?i:{quoted}){end}"
    rows = comments.where(F.col("text").rlike(fits)).withColumn("rest", F.regexp_extract("text", fits + "(.*)$", 1))
    colon = F.startswith("rest", F.lit(":"))
    body = F.when(colon, F.substring("rest", 2, 1 << 30)).when(F.col("rest").rlike(r"^[ \t]+[A-Z]+[0-9]"), F.ltrim("rest"))
    rows = rows.withColumns({"colon": colon, "list": F.coalesce(F.regexp_extract(body, r"^((?:[,\s\x0B]*[A-Z]+[0-9]+(?![0-9A-Za-z_-]))*)", 1), F.lit("")), "body": F.coalesce(body, F.lit(""))})
    bad = F.substring(F.col("body"), F.length("list") + 1, F.lit(1 << 30)).rlike(r"^[,\s\x0B]*[A-Z]+[0-9]")
    codes = F.when(bad, F.array().cast("array<string>")).otherwise(F.regexp_extract_all("list", F.lit("([A-Z]+[0-9]+)"), 1))
    rows = rows.withColumn("codes", codes).where(~F.col("colon") | (F.size("codes") > 0))
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("offset")) - 1
    return rows.select("file_id", "offset", number.alias("directive"), F.when(~F.col("text").rlike(rf"(?s)^{prefix}(?i:{quoted}){end}"), F.col("line")).alias("line"), (F.size("codes") == 0).alias("blanket"), "codes")


def unused_directives(directives: DataFrame, claims: DataFrame, findings: DataFrame, enabled: DataFrame) -> DataFrame:
    """file_id, directive, reason and dead codes of directives that do nothing.

    reason: unknown (a code that is no rule), closes (an enable that no disable before
    it opens), dead (never used, or codes that are enabled but were never used).  What a
    disable opened is carried on as running flags, of the file and of each code.
    """
    used = claims.join(findings.select("finding_id", "file_id", "code"), "finding_id").groupBy("file_id", "directive").agg(F.collect_set("code").alias("used"))
    known = enabled.agg(F.collect_set("code").alias("known"), F.collect_set(F.when(F.col("enabled"), F.col("code"))).alias("on"))
    rows = directives.join(used, ["file_id", "directive"], "left").crossJoin(F.broadcast(known))  # one row: the codes of the library
    before = Window.partitionBy("file_id").orderBy("directive").rowsBetween(Window.unboundedPreceding, -1)
    disable = F.col("kind") == "disable"
    every = F.max(disable & F.col("wildcard")).over(before)
    some = F.max(disable & (F.col("wildcard") | F.arrays_overlap("codes", "known"))).over(before)
    rows = rows.withColumns({"every": every, "some": some, "used": F.coalesce("used", F.array().cast("array<string>"))})
    # Of each code: whether a disable names it before.
    named = directives.where("kind in ('disable', 'enable') and not wildcard").select("file_id", "directive", "kind", F.explode(F.array_distinct("codes")).alias("code"))
    earlier = Window.partitionBy("file_id", "code").orderBy("directive").rowsBetween(Window.unboundedPreceding, -1)
    named = named.withColumn("opened", F.max(disable).over(earlier)).where("kind = 'enable'").groupBy("file_id", "directive").agg(F.max("opened").alias("opened"))
    rows = rows.join(named, ["file_id", "directive"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    opens = F.when(F.col("wildcard"), yes("some")).otherwise(yes("opened") | (yes("every") & F.arrays_overlap("codes", "known")))
    dead = F.array_sort(F.array_except(F.array_intersect("codes", "on"), "used"))
    reason = F.when(F.size(F.array_except("codes", "known")) > 0, "unknown")
    reason = reason.when(F.col("kind") == "enable", F.when(~yes(opens), "closes"))
    reason = reason.when(F.col("wildcard"), F.when(F.size("used") == 0, "dead")).when(F.size(dead) > 0, "dead")
    return rows.withColumn("reason", reason).where("reason is not null").select("file_id", "directive", "reason", F.when((F.col("reason") == "dead") & ~F.col("wildcard"), dead).otherwise(F.array().cast("array<string>")).alias("dead"))


def with_baseline_key(findings: DataFrame) -> DataFrame:
    """findings(path, code, text, ...) with key; text is the finding's line."""
    return findings.withColumn("key", baseline_key(F.col("path"), F.col("code"), F.col("text")))


def baseline_filter(keyed: DataFrame, baseline: DataFrame) -> DataFrame:
    return keyed.join(baseline.select("key").distinct(), "key", "left_anti")


def baseline_write(keyed: DataFrame, folder: str) -> None:
    """One decimal key for each line, sorted, without repeats."""
    keyed.select("key").distinct().orderBy("key").select(F.col("key").cast("string")).write.mode("overwrite").text(folder)


def baseline_read(spark: SparkSession, folder: str) -> DataFrame:
    """key of every readable line."""
    return spark.read.text(folder).select(F.expr("try_cast(trim(value) as decimal(20,0))").alias("key")).where("key is not null").distinct()
