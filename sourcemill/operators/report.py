"""Reports: findings as text, JSON and XML in the formats of common tools."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.hashing import fingerprint
from ..functions.paths import order_key
from ..sources.files import numbered
from .lint import order_tally, severity_as, tally
from .lines import column_at, locate


def _spanned(rows: DataFrame, lines: DataFrame, *key: str) -> DataFrame:
    """rows(file_id, offset, length, ...) with row, column, end_row and end_column from 1 in code points; key tells the rows of a file apart.

    Both ends are located at once. The start carries its row along, so that rows meet their ends in the
    partition of their file: nothing is joined back.
    """
    held = F.struct(*[c for c in rows.columns if c not in ("file_id", *key)])
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("offset").alias("at"), held.alias("held")), F.struct(F.lit(1).alias("side"), (F.col("offset") + F.col("length")).alias("at"), F.lit(None).alias("held")))
    points = rows.dropna(subset=list(key)).select("file_id", *key, F.inline(ends))
    own = Window.partitionBy("file_id", *key)
    place = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c) + 1)).over(own)
    found = locate(points, lines, offset="at").withColumns({"row": place("line", 0), "column": place("column", 0), "end_row": place("line", 1), "end_column": place("column", 1)})
    return found.where("side = 0").select(*(c if c in ("file_id", *key) else F.col(f"held.{c}").alias(c) for c in rows.columns), "row", "column", "end_row", "end_column")


def positioned(findings: DataFrame, lines: DataFrame, text: bool = True) -> DataFrame:
    """findings(finding_id, file_id, offset, length, ...) with row, column, end_row and end_column from 1 in code points, and the text of the first line as line_text.

    Only the format gitlab reads line_text; without ``text`` it is left out, and the lines are not joined for it.
    """
    out = _spanned(findings, lines, "finding_id")
    if not text:
        return out
    held = lines.select("file_id", (F.col("line") + 1).alias("row"), F.col("text").alias("line_text"))
    return out.join(held, ["file_id", "row"], "left").select(*out.columns, "line_text")


# The schema that SARIF documents name, and what reports say of the tool that made them.
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
TOOL = {"name": "sourcemill", "version": "0.1.0", "information_uri": "https://example.org/sourcemill", "rule_uri_prefix": "https://example.org/sourcemill/rules/", "rule_uri_suffix": ""}
LAST = (1 << 63) - 1


def rule_url(code: Column, tool: dict = TOOL) -> Column:
    return F.concat(F.lit(tool["rule_uri_prefix"]), code, F.lit(tool["rule_uri_suffix"]))


def _escape_github(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _fixable() -> Column:
    return F.coalesce(F.col("applicability").isin("safe", "unsafe"), F.lit(False))


def _line(format_: str, tool: dict = TOOL) -> Column:
    if format_ == "concise":
        return F.format_string("%s:%d:%d: %s%s %s", "path", "row", "column", "code", F.when(_fixable(), " [*]").otherwise(""), "message")
    if format_ == "github":
        return F.format_string("::%s file=%s,line=%d,col=%d,title=%s %s::%s", severity_as(F.col("severity"), "github"), "path", "row", "column", "code", "rule", _escape_github(F.col("message")))
    if format_ == "azure":
        return F.format_string("##vso[task.logissue type=%s;sourcepath=%s;linenumber=%d;columnnumber=%d;code=%s;]%s", severity_as(F.col("severity"), "azure"), "path", "row", "column", "code", "message")
    if format_ == "pylint":
        return F.format_string("%s:%d: [%s] %s", "path", "row", "code", "message")
    if format_ in ("json", "json_lines"):
        return F.to_json(F.struct(
            "code", F.col("column"), "end_column", F.col("end_row").alias("end_line"), F.col("path").alias("file"), _fixable().alias("fixable"),
            F.col("row").alias("line"), "message", F.col("related"), "rule", "severity", rule_url(F.col("code"), tool).alias("url"),
        ))
    if format_ == "gitlab":
        where = F.struct(F.struct(F.col("row").alias("begin")).alias("lines"), "path")
        mark = fingerprint(F.col("path"), F.col("code"), F.regexp_replace("line_text", r"^[ \t\n\r\x0b\f]+|[ \t\n\r\x0b\f]+$", ""))
        return F.to_json(F.struct(F.col("code").alias("check_name"), F.col("message").alias("description"), mark.alias("fingerprint"), where.alias("location"), severity_as(F.col("severity"), "gitlab").alias("severity")))
    if format_ == "rdjson":
        spot = lambda r, c: F.struct(F.col(r).alias("line"), F.col(c).alias("column"))
        where = F.struct("path", F.struct(spot("row", "column").alias("start"), spot("end_row", "end_column").alias("end")).alias("range"))
        code = F.struct(rule_url(F.col("code"), tool).alias("url"), F.col("code").alias("value"))
        return F.to_json(F.struct(code.alias("code"), where.alias("location"), "message", severity_as(F.col("severity"), "rdjson").alias("severity"), F.col("suggestions")))
    if format_ == "sarif":
        region = F.struct(F.col("row").alias("startLine"), F.col("column").alias("startColumn"), F.col("end_row").alias("endLine"), F.col("end_column").alias("endColumn"))
        where = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
        return F.to_json(F.struct(severity_as(F.col("severity"), "sarif").alias("level"), where.alias("locations"), F.struct(F.col("message").alias("text")).alias("message"), F.col("code").alias("ruleId")))
    raise ValueError(f"no such format: {format_}")


def render(findings: DataFrame, format_: str, tool: dict = TOOL) -> DataFrame:
    """One text row for each finding, with path, offset, code and arrival to order by.

    findings as positioned() gives them, with path, rule, severity, message, applicability
    and arrival; related (see with_related_places) and suggestions (see with_suggestions)
    are empty where they are missing, an index stays.  Formats: concise, github, azure, pylint, json,
    json_lines, gitlab, rdjson, sarif.  Nothing is sorted here: write_report does that.
    """
    for name in ("related", "suggestions"):
        if name not in findings.columns:
            findings = findings.withColumn(name, F.array().cast("array<string>"))
    index = ["index"] if "index" in findings.columns else []
    return findings.select("path", "offset", "code", "arrival", *index, _line(format_, tool).alias("text"))


def with_related_places(findings: DataFrame, related: DataFrame) -> DataFrame:
    """findings with ``related``: file, line, column and message of related(finding_id, ordinal, path, row, column, message), in order."""
    n = related.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.col("path").alias("file"), F.col("row").alias("line"), "column", "message"))).alias("_r"))
    none = F.array().cast("array<struct<column:int,file:string,line:int,message:string>>")
    places = F.transform("_r", lambda x: F.struct(x["column"].cast("int").alias("column"), x["file"].alias("file"), x["line"].cast("int").alias("line"), x["message"].alias("message")))
    return findings.join(n, "finding_id", "left").withColumn("related", F.coalesce(places, none)).drop("_r")


def with_suggestions(findings: DataFrame, edits: DataFrame, lines: DataFrame) -> DataFrame:
    """findings with ``suggestions``: the edits(finding_id, file_id, ordinal, offset, length, replacement) of their fixes as ranges and texts, in order."""
    placed = _spanned(edits.select("file_id", "finding_id", "ordinal", "offset", "length", "replacement"), lines, "finding_id", "ordinal")
    spot = lambda r, c: F.struct(F.col(c).alias("column"), F.col(r).alias("line"))
    range_ = F.struct(spot("end_row", "end_column").alias("end"), spot("row", "column").alias("start"))
    n = placed.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.struct(range_.alias("range"), F.col("replacement").alias("text")).alias("s")))).alias("_s"))
    none = F.array().cast("array<struct<range:struct<end:struct<column:int,line:int>,start:struct<column:int,line:int>>,text:string>>")
    return findings.join(n, "finding_id", "left").withColumn("suggestions", F.coalesce(F.transform("_s", lambda x: x["s"]), none)).drop("_s")


def document(rendered: DataFrame, format_: str, rules: DataFrame | None = None, tool: dict = TOOL) -> DataFrame:
    """index and text of the lines of one whole document: a head, the rows that render() gave for the format, and a tail.

    Formats: json (an array), rdjson, sarif; the last has the rules(code, name, summary)
    in its tail, a table of the library's size.  The rows are numbered by partition, in the order of a
    report, so that all but the first can begin with a comma and no task sees them all;
    ordered by index and joined by line ends they are the document.
    """
    return _framed(_in_order(rendered), format_, rules, tool)


def documents(findings: DataFrame, formats: tuple[str, ...], rules: DataFrame | None = None, tool: dict = TOOL) -> DataFrame:
    """format, index and text: document() of the findings in each of the formats. The findings are made and numbered once for all of them."""
    rows = _in_order(findings)
    out = [_framed(render(rows, f, tool), f, rules, tool).select(F.lit(f).alias("format"), "index", "text") for f in formats]
    return reduce(DataFrame.unionByName, out)


def _in_order(rows: DataFrame) -> DataFrame:
    """rows with index, their number from 0 in the order of a report."""
    return numbered(rows.withColumn("_path", order_key(F.col("path"))), "_path", "offset", "code", "arrival").drop("_path")


def _framed(rows: DataFrame, format_: str, rules: DataFrame | None, tool: dict) -> DataFrame:
    """The lines of document() of rows(index, text)."""
    spark = rows.sparkSession
    if format_ == "json":
        head, tail = "[", "]"
    elif format_ == "rdjson":
        head, tail = '{"diagnostics":[', f'],"severity":"WARNING","source":{json.dumps({"name": tool["name"], "url": tool["information_uri"]})}}}'
    elif format_ == "sarif":
        head, tail = f'{{"$schema":{json.dumps(SARIF_SCHEMA)},"runs":[{{"results":[', None
    else:
        raise ValueError(f"{format_} is no format of one document")
    body = rows.select("index", F.concat(F.when(F.col("index") == 0, "").otherwise(","), F.col("text")).alias("text"))
    ends = spark.createDataFrame([(-1, head)] + ([(LAST, tail)] if tail else []), "index long, text string")
    if tail is None:
        entry = F.to_json(F.struct(rule_url(F.col("code"), tool).alias("helpUri"), F.col("code").alias("id"), "name", F.struct(F.col("summary").alias("text")).alias("shortDescription")))
        held = (rules if rules is not None else spark.createDataFrame([], "code string, name string, summary string")).select("code", entry.alias("r"))
        list_ = held.agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "r"))), lambda x: x["r"]).alias("rules"))
        own = f'],"tool":{{"driver":{{"informationUri":{json.dumps(tool["information_uri"])},"name":{json.dumps(tool["name"])},"rules":['
        end = f'],"version":{json.dumps(tool["version"])}}}}}}}],"version":"2.1.0"}}'
        ends = ends.unionByName(list_.select(F.lit(LAST).cast("long").alias("index"), F.concat(F.lit(own), F.array_join("rules", ","), F.lit(end)).alias("text")))
    return body.unionByName(ends)


def render_grouped(findings: DataFrame) -> DataFrame:
    """path and text: a header for each file and its findings with aligned places."""
    place = F.format_string("%d:%d", "row", "column")
    rows = findings.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("offset", "code", "arrival", place.alias("place"), F.when(_fixable(), " [*]").otherwise("").alias("fix"), "message"))).alias("f"))
    width = F.array_max(F.transform("f", lambda x: F.length(x["place"])))
    lines = F.transform("f", lambda x: F.concat(F.lit("  "), F.rpad(x["place"], width, " "), F.lit("  "), x["code"], x["fix"], F.lit(" "), x["message"]))
    return rows.select("path", F.concat(F.col("path"), F.lit(":\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("text"))


@F.pandas_udf(StringType())
def _fix_diff(shown: pd.Series, edits: pd.Series) -> pd.Series:
    """The lines that the edits touch, removed and added; "" without edits."""

    def one(lines, own):
        if own is None or not len(own) or not len(lines):
            return ""
        lines = sorted(lines, key=lambda x: x["line"])
        text, base = "\n".join(x["text"] for x in lines).encode(), lines[0]["start"]
        first = text.rfind(b"\n", 0, own[0]["offset"] - base) + 1
        stop = text.find(b"\n", own[-1]["offset"] + own[-1]["length"] - base)
        stop = len(text) if stop < 0 else stop
        new, at = b"", first
        for e in own:
            new += text[at : e["offset"] - base] + e["replacement"].encode()
            at = e["offset"] - base + e["length"]
        new += text[at:stop]
        out = [f"- {x}" for x in text[first:stop].decode("utf-8", "replace").split("\n")] + [f"+ {x}" for x in new.decode("utf-8", "replace").split("\n")]
        return "\n".join(out) + "\n"

    return pd.Series([one(s, e) for s, e in zip(shown, edits, strict=True)])


def _beside(findings: DataFrame, lines: DataFrame, context: int, partitions: int | None) -> DataFrame:
    """findings with the lines near and, for those with edits, the lines that these touch; all in the partition of their file.

    Lines, findings and both ends of a finding's edits are dealt once by file. In one order of offsets each takes
    its line, in one order of lines the texts around it; the ends of edits meet by their finding. A finding that
    has its row stays on that line.
    """
    edited = "edits" in findings.columns
    held = F.struct(*[c for c in findings.columns if c != "file_id"]).alias("held")
    row = F.col("row") - 1 if "row" in findings.columns else F.lit(None)
    spot = lambda side, at, line=F.lit(None), own=F.lit(None): F.struct(F.lit(side).alias("side"), F.greatest(at.cast("long"), F.lit(0)).alias("at"), line.cast("int").alias("line"), own.alias("held"))
    spots = [spot("finding", F.col("offset"), row, held)]
    if edited:
        last = F.element_at("edits", -1)
        ends = F.when(F.col("edits").isNotNull(), F.array(spot("first", F.col("edits")[0]["offset"]), spot("last", last["offset"] + last["length"])))
        spots = F.concat(F.array(*spots), F.coalesce(ends, F.array()))
    points = findings.select("file_id", "finding_id", F.inline(spots if edited else F.array(*spots)))
    begin = F.when(F.col("line") == 0, 0).otherwise(F.col("start")).cast("long")
    texts = lines.select("file_id", F.lit("line").alias("side"), begin.alias("at"), "line", F.struct("line", "start", "text").alias("own"))
    rows = texts.unionByName(points, allowMissingColumns=True)
    rows = rows.repartition(partitions, "file_id") if partitions else rows.repartition("file_id")
    is_line = F.col("side") == "line"
    rows = rows.withColumn("line", F.coalesce("line", F.last(F.when(is_line, F.col("line")), True).over(Window.partitionBy("file_id").orderBy("at", ~is_line))))
    by_finding = Window.partitionBy("file_id", "finding_id")
    if edited:
        end = F.max(F.when(F.col("side") == "last", F.col("line"))).over(by_finding)
        on = F.when(F.col("side") == "first", F.sequence(F.col("line"), end)).when(F.col("side") != "last", F.array("line"))
        rows = rows.withColumn("_end", on).select("file_id", "finding_id", "side", F.explode("_end").alias("line"), "own", "held")
    around = Window.partitionBy("file_id").orderBy("line").rangeBetween(-context, max(context, 1))
    rows = rows.withColumn("near", F.collect_list("own").over(around)).where(~is_line)
    if edited:
        own = F.get(F.filter("near", lambda x: x["line"] == F.col("line")), F.lit(0))
        rows = rows.withColumn("touched", F.collect_list(F.when(F.col("side") == "first", own)).over(by_finding)).where("side = 'finding'")
    return rows.select("file_id", "held.*", "line", "near", *(["touched"] if edited else []))


def render_full(findings: DataFrame, lines: DataFrame, context: int = 1, edits: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """finding_id, path and text: the headline and the line with ``context`` lines around, the finding underlined.

    findings as positioned() gives them, or still without places: then these are found on the way, and the
    lines travel once for both.  With edits(finding_id, ordinal, offset, length, replacement) of fixes, the
    lines that they touch follow, removed and added.  Without partitions there are as many as the session says.
    """
    placed = "row" in findings.columns
    findings = findings.select("file_id", "finding_id", "path", "code", "applicability", "message", "offset", "length", *(["row", "column", "end_row", "end_column"] if placed else []))
    if edits is not None:
        n = edits.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "replacement"))).alias("edits"))
        findings = findings.join(n, "finding_id", "left")
    at = lambda n: F.get(F.filter("near", lambda x: x["line"] == F.col("line") + n), F.lit(0))
    rows = _beside(findings, lines, context, partitions).withColumns({"own": at(0), "next": at(1)})
    if placed:
        ends_here = F.col("end_row") == F.col("row")
    else:
        ends_here = F.col("next").isNull() | (F.col("offset") + F.col("length") < F.col("next.start"))
        column = lambda c: column_at(F.col("own.text"), F.col("own.start"), c) + 1
        rows = rows.withColumns({"row": F.col("line") + 1, "column": column(F.col("offset")), "end_column": column(F.col("offset") + F.col("length"))})
    shown = F.filter("near", lambda x: x["line"].between(F.col("line") - context, F.col("line") + context))
    gutter = F.length((F.col("row") + context).cast("string"))
    span = F.greatest(F.lit(1), F.when(ends_here, F.col("end_column") - F.col("column")).otherwise(F.char_length("own.text") - F.col("column") + 2))
    under = F.concat(F.repeat(F.lit(" "), gutter), F.lit(" | "), F.repeat(F.lit(" "), F.col("column") - 1), F.repeat(F.lit("^"), span))
    body = F.flatten(F.transform(F.when(F.size(shown) > 0, shown), lambda x: F.concat(
        F.array(F.concat(F.lpad((x["line"] + 1).cast("string"), gutter, " "), F.lit(" | "), x["text"])), F.when(x["line"] == F.col("row") - 1, F.array(under)).otherwise(F.array().cast("array<string>"))
    )))
    fixed = _fix_diff("touched", "edits") if edits is not None else F.lit("")
    return rows.select("finding_id", "path", F.concat(_line("concise"), F.lit("\n"), F.array_join(body, "\n"), F.lit("\n"), fixed).alias("text"))


def render_junit(findings: DataFrame) -> DataFrame:
    """path and text: one test suite for each file."""
    case = F.format_string('    <testcase name="%s" line="%d" column="%d"><failure message="%s"/></testcase>', _escape_xml(F.col("code")), "row", "column", _escape_xml(F.col("message")))
    rows = findings.groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("offset", "code", "arrival", case.alias("case")))).alias("f"))
    head = F.format_string('  <testsuite name="%s" tests="%d" failures="%d">', _escape_xml(F.col("path")), "n", "n")
    return rows.select("path", F.concat(head, F.lit("\n"), F.array_join(F.transform("f", lambda x: x["case"]), "\n"), F.lit("\n  </testsuite>")).alias("text"))


def statistics(findings: DataFrame, format_: str = "text", unsafe: bool = False, tool: dict = TOOL) -> DataFrame:
    """text rows of the tally, the most frequent code first; as json, one row with the whole array."""
    rows = tally(findings, unsafe)
    if format_ == "json":
        names = findings.groupBy("code").agg(F.min("rule").alias("name"))
        entry = F.struct("code", F.col("n").alias("count"), (F.col("mark") == "all").alias("fixable"), F.col("fixable").alias("fixable_count"), "name", rule_url(F.col("code"), tool).alias("url"))
        held = rows.join(names, "code").select(F.struct((-F.col("n")).alias("n"), "code", F.to_json(entry).alias("j")).alias("x"))
        # One element for each code of the rule table.
        return held.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["j"]), ","), F.lit("]")).alias("text"))
    mark = F.when(F.col("mark") == "all", "[*]").when(F.col("mark") == "some", "[-]").otherwise("[ ]")
    return order_tally(rows).select(F.format_string("%8d  %s  %s", "n", mark, "code").alias("text"))


def write_report(rendered: DataFrame, folder: str) -> None:
    """The texts in the order of path, offset, code and arrival, as text files in range-partitioned order."""
    rendered.orderBy(order_key(F.col("path")), "offset", "code", "arrival").select("text").write.mode("overwrite").text(folder)


def dump_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet under its name, by language where it has one."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("language") if "language" in df.columns else writer).parquet(f"{folder}/{name}")
