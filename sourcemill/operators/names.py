"""Facts, definitions, uses, scopes and references."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import checkpointed

MAX_DEPTH = 256
MAX_NAME_BYTES = 256

_NAME = r"[A-Za-z_$][\w$]*"


def _struct(kind: str, local=None, remote=None, specifier=None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(F.lit(kind).alias("kind"), lit(local).alias("local"), lit(remote).alias("remote"), lit(specifier).alias("specifier"))


def _listed(body: Column, build) -> Column:
    parts = F.filter(F.transform(F.split(F.regexp_replace(body, r"[(){}]", ""), ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, build)


def _renamed(part: Column) -> tuple[Column, Column]:
    """(remote, local) of ``a`` or ``a as b``."""
    remote = F.regexp_extract(part, r"^(\S+)", 1)
    local = F.regexp_extract(part, r"\sas\s+(\S+)$", 1)
    return remote, F.when(local == "", remote).otherwise(local)


def _python(t: Column) -> Column:
    plain = F.regexp_extract(t, r"^\s*import\s+([^#;]+)", 1)
    source, body = (F.regexp_extract(t, r"^\s*from\s+(\S+)\s+import\s+([^#;]+)", k) for k in (1, 2))
    exported = F.regexp_extract(t, r"^__all__\s*\+?=\s*[\[(]([^\])]*)", 1)

    def module(part):
        remote, local = _renamed(part)
        return _struct("import_module", F.when(remote == local, F.regexp_extract(remote, r"^([^.]+)", 1)).otherwise(local), None, remote)

    def member(part):
        remote, local = _renamed(part)
        return _struct("import_named", local, remote, source)

    named = _listed(exported, lambda p: _struct("export_named", F.regexp_replace(p, "[\"']", ""), None, None))
    star = F.array(_struct("import_namespace", None, None, source))
    return F.when(plain != "", _listed(plain, module)).when(F.trim(body) == "*", star).when(source != "", _listed(body, member)).when(exported != "", named)


def _javascript(t: Column) -> Column:
    quoted = r"[\"']([^\"']+)[\"']"
    effect = F.regexp_extract(t, rf"^\s*import\s+{quoted}", 1)
    clause, source = (F.regexp_extract(t, rf"^\s*import\s+(?:type\s+)?([^\"']+?)\s+from\s+{quoted}", k) for k in (1, 2))
    all_from = F.regexp_extract(t, rf"^\s*export\s+\*\s+from\s+{quoted}", 1)
    space, space_from = (F.regexp_extract(t, rf"^\s*export\s+\*\s+as\s+({_NAME})\s+from\s+{quoted}", k) for k in (1, 2))
    again, again_from = (F.regexp_extract(t, rf"^\s*export\s+(?:type\s+)?\{{([^}}]*)\}}\s+from\s+{quoted}", k) for k in (1, 2))
    local_list = F.regexp_extract(t, r"^\s*export\s+\{([^}]*)\}\s*;?\s*$", 1)
    declared = F.regexp_extract(t, rf"^\s*export\s+(?:async\s+)?(?:function\*?|class|const|let|var|interface|type|enum)\s+({_NAME})", 1)
    default = t.rlike(r"^\s*export\s+default\b")
    inner, bare = F.regexp_extract(clause, r"\{([^}]*)\}", 1), F.regexp_extract(clause, rf"^({_NAME})\s*(?:,|$)", 1)
    whole = F.regexp_extract(clause, rf"\*\s+as\s+({_NAME})", 1)

    def pick(kind, of):
        def build(part):
            remote, local = _renamed(part)
            return _struct(kind, local, remote, of)

        return build

    none = F.filter(F.array(_struct("", "", "", "")), lambda x: F.lit(False))
    imported = F.concat(
        F.when(bare != "", F.array(_struct("import_default", bare, "default", source))).otherwise(none),
        F.when(whole != "", F.array(_struct("import_namespace", whole, None, source))).otherwise(none),
        F.when(inner != "", _listed(inner, pick("import_named", source))).otherwise(none),
    )
    out = F.when(effect != "", F.array(_struct("import_side_effect", None, None, effect))).when(source != "", imported)
    out = out.when(all_from != "", F.array(_struct("export_all", None, None, all_from))).when(space != "", F.array(_struct("export_namespace", space, None, space_from)))
    out = out.when(again_from != "", _listed(again, pick("reexport_named", again_from)))
    out = out.when(local_list != "", _listed(local_list, lambda p: _struct("export_named", _renamed(p)[1], _renamed(p)[0], None)))
    return out.when(default, F.array(_struct("export_default", "default", None, None))).when(declared != "", F.array(_struct("export_named", declared, None, None)))


def _css(t: Column) -> Column:
    found = F.regexp_extract(t, r"^\s*@import\s+(?:url\()?\s*[\"']?([^\"')\s;]+)", 1)
    return F.when(found != "", F.array(_struct("import_side_effect", None, None, found)))


def _zig(t: Column) -> Column:
    local, found = (F.regexp_extract(t, r"(?:const|var)\s+([A-Za-z_]\w*)[^=]*=\s*@import\(\"([^\"]+)\"\)", k) for k in (1, 2))
    lone = F.regexp_extract(t, r"@import\(\"([^\"]+)\"\)", 1)
    return F.when(found != "", F.array(_struct("import_module", local, None, found))).when(lone != "", F.array(_struct("import_side_effect", None, None, lone)))


def _markup(t: Column) -> Column:
    base = F.regexp_extract(t, r"\{%-?\s*extends\s+[\"']([^\"']+)[\"']", 1)
    part = F.regexp_extract(t, r"\{%-?\s*include\s+[\"']([^\"']+)[\"']", 1)
    return F.when(base != "", F.array(_struct("extends", None, None, base))).when(part != "", F.array(_struct("include", None, None, part)))


def _go(t: Column) -> Column:
    body = F.regexp_extract(t, r"^\s*import\b\s*\(?(.*)$", 1)
    pattern = r"(?:([\p{L}_][\p{L}\p{N}_]*|\.)\s*)?[\"`]([^\"`]+)[\"`]"
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(pattern), 1).alias("local"), F.regexp_extract_all(body, F.lit(pattern), 2).alias("path"))
    package = lambda path: F.regexp_extract(path, r"([^/]*?)(?:(?<=[^/])/v[0-9]+)?$", 1)
    return F.when(body != "", F.transform(pairs, lambda p: _struct("import_named", F.when(p["local"] == "", package(p["path"])).otherwise(p["local"]), p["path"], p["path"])))


def _use_names(statements: pd.Series) -> pd.Series:
    """The names that ``use`` statements bring in, groups inside groups opened."""

    def names(text: str) -> list[tuple]:
        crate = re.match(r"\s*(?:pub(?:\([^)]*\))?\s+)?extern\s+crate\s+(\w+)(?:\s+as\s+(\w+))?", text)
        if crate:
            return [("import_named", crate[2] or crate[1], crate[1], crate[1])]
        public, body = re.match(r"\s*(pub(?:\([^)]*\))?\s+)?use\b([^;]*)", text).groups()
        kind, out, stack, path, local = "reexport_named" if public else "import_named", [], [], [], None

        def leaf():
            if path and path[-1] == "*":
                out.append(("import_namespace", None, None, "::".join(path[:-1]) or None))
            elif path:
                out.append((kind, local or path[-1], path[-1], "::".join(path[:-1]) or None))

        words = re.findall(r"r#\w+|\w+|[{},*]", body)
        for at, word in enumerate(words):
            if word == "{":
                stack.append(list(path))
            elif word in ",}":
                if at and words[at - 1] not in ",{}":
                    leaf()
                path, local = list(stack[-1]) if stack else [], None
                if word == "}" and stack:
                    stack.pop()
                    path = []
            elif word == "as":
                continue
            elif at and words[at - 1] == "as":
                local = word
            else:
                path.append(word)
        if words and words[-1] not in ",{}":
            leaf()
        return out

    return statements.map(names)


_FACTS = "array<struct<kind:string,local:string,remote:string,specifier:string>>"
READERS = {"python": _python, "javascript": _javascript, "typescript": _javascript, "css": _css, "zig": _zig, "markup": _markup, "go": _go}

# Statements that may go on over several lines; everything else is a statement for each line.
_BRACED = r"[ \t]*+(?:import|export)\b[ \t]*+(?:type\b[ \t]*+)?(?:[\w$]++[ \t]*+,[ \t]*+)?\{[^}/]*+(?:/(?:/[^\n]*+)?+[^}/]*+)*+\}[^\n]*+"
_SPANNING = {
    "python": r"[ \t]*+from[ \t]++\S++[ \t]++import[ \t]*+\([^)#]*+(?:#[^\n]*+[^)#]*+)*+\)[^\n]*+|__all__[ \t]*+\+?+=[ \t]*+[\[(][^\])#]*+(?:#[^\n]*+[^\])#]*+)*+[\])][^\n]*+|[ \t]*+(?:from|import)\b(?:[^\n]*\\\r?\n)++[^\n]*+",
    "javascript": _BRACED,
    "typescript": _BRACED,
    "go": r"[ \t]*+import[ \t]*+\([^)/]*+(?:/(?:/[^\n]*+)?+[^)/]*+)*+\)[^\n]*+",
    "rust": r"[ \t]*+(?:pub(?:\([^)]*+\))?+[ \t]++)?+(?:use|extern[ \t]++crate)\b[^;]*+;[^\n]*+",
}
_REMARK = {"python": r"#[^\n]*|\\\r?(?=\n)"}


def _statements(source: Column, language: str) -> Column:
    """The statements of a source, each on one line; those over several lines lose their remarks."""
    if language not in _SPANNING:
        return F.split(source, r"\r?\n")
    found = F.regexp_extract_all(source, F.lit(rf"(?m)^(?:{_SPANNING[language]}|[^\r\n]*+)"), F.lit(0))
    remark = _REMARK.get(language, r"(?m)(?<=\s|^)//[^\n]*")
    return F.transform(found, lambda t: F.when(F.contains(t, F.lit("\n")), F.regexp_replace(F.regexp_replace(t, remark, ""), r"\s*\n\s*", " ")).otherwise(t))


def extract_facts(files: DataFrame) -> DataFrame:
    """file_id, fact (its number), kind, only, local, remote and specifier of imports and exports.

    files: file_id, language, source.  This reads statements, those in brackets over
    several lines included, but it does not parse: what stands inside strings or comments
    is beyond it.
    """
    statements = F.lit(None)
    for language in (*READERS, "rust"):
        statements = F.when(F.col("language") == language, _statements(F.col("source"), language)).otherwise(statements)
    lines = files.where(F.col("language").isin(*READERS, "rust")).select("file_id", "language", F.posexplode(statements).alias("line", "raw"))
    found = F.lit(None)
    for language, read in READERS.items():
        found = F.when(F.col("language") == language, read(F.col("raw"))).otherwise(found)
    only = F.when(F.col("language") == "markup", F.col("raw").rlike(r"\{%-?\s*include\b[^%]*\bonly\b"))
    facts = lines.where("language <> 'rust'").select("file_id", "line", only.alias("only"), F.posexplode(found).alias("place", "f"))
    uses = lines.where(F.col("language") == "rust").where(F.col("raw").rlike(r"^\s*(pub(\([^)]*\))?\s+)?(use|extern\s+crate)\b"))
    facts = facts.unionByName(uses.select("file_id", "line", F.lit(None).cast("boolean").alias("only"), F.posexplode(F.pandas_udf(_use_names, _FACTS)("raw")).alias("place", "f")))
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("line", "place")) - 1
    return facts.select("file_id", number.alias("fact"), "f.kind", "only", "f.local", "f.remote", "f.specifier")


def imports(facts: DataFrame) -> DataFrame:
    return facts.where(F.startswith("kind", F.lit("import_")) | F.col("kind").isin("include", "extends"))


def exports(facts: DataFrame) -> DataFrame:
    return facts.where(F.startswith("kind", F.lit("export_")) | F.startswith("kind", F.lit("reexport_")))


def declarations(bindings: DataFrame) -> DataFrame:
    """file_id, name and binding of the file-level names; of a repeated name the last; names over 256 bytes are left out."""
    top = bindings.where((F.col("scope") == 0) & (F.octet_length("name") <= MAX_NAME_BYTES))
    return top.groupBy("file_id", "name").agg(F.max("binding").alias("binding"))


def forwards(facts: DataFrame) -> DataFrame:
    """file_id, local, fact, remote and specifier of the facts that pass a name on; of a repeated local the first."""
    rows = facts.where("specifier is not null and local is not null")
    return rows.groupBy("file_id", "local").agg(F.min_by(F.struct("fact", "remote", "specifier"), "fact").alias("f")).select("file_id", "local", "f.fact", "f.remote", "f.specifier")


def resolve_uses(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """uses with definition (the first in order, null without one) and definition_count.

    defs: file_id, def, kind, name; uses: file_id, use, kind, name.
    """
    d = defs.groupBy("file_id", "kind", "name").agg(F.min("def").alias("definition"), F.count("*").alias("definition_count"))
    return uses.join(d, ["file_id", "kind", "name"], "left").withColumn("definition_count", F.coalesce("definition_count", F.lit(0)))


def unused_defs(defs: DataFrame, uses: DataFrame) -> DataFrame:
    return defs.join(uses.select("file_id", "kind", "name").distinct(), ["file_id", "kind", "name"], "left_anti")


def missing_uses(defs: DataFrame, uses: DataFrame) -> DataFrame:
    return uses.join(defs.select("file_id", "kind", "name").distinct(), ["file_id", "kind", "name"], "left_anti")


def duplicate_defs(defs: DataFrame) -> DataFrame:
    """file_id, kind, name and n of what is defined more than once."""
    return defs.groupBy("file_id", "kind", "name").agg(F.count("*").alias("n")).where("n > 1")


def scope_chain(scopes: DataFrame, most: int = MAX_DEPTH) -> DataFrame:
    """file_id, scope, ancestor, distance and crossed (whether a dynamic scope lies before the ancestor), itself at distance 0.

    scopes: file_id, scope, parent, dynamic.  The distance doubles with every round, so
    256 levels take eight joins; every round is checkpointed.
    """
    hop = scopes.select("file_id", "scope", F.col("parent").alias("ancestor"), F.coalesce("dynamic", F.lit(False)).alias("crossed")).where("ancestor is not null")
    chain = scopes.select("file_id", "scope", F.col("scope").alias("ancestor"), F.lit(0).alias("distance"), F.lit(False).alias("crossed"))
    size = 1
    while size < most and not hop.isEmpty():
        # hop reaches exactly size steps up; chain holds all distances below size.
        up = hop.select("file_id", "scope", F.col("ancestor").alias("_mid"), F.col("crossed").alias("_c"))
        more = up.join(chain.select("file_id", F.col("scope").alias("_mid"), "ancestor", "distance", "crossed"), ["file_id", "_mid"])
        more = more.select("file_id", "scope", "ancestor", (F.col("distance") + size).alias("distance"), (F.col("_c") | F.col("crossed")).alias("crossed"))
        chain = checkpointed(chain.unionByName(more))
        far = hop.select("file_id", F.col("scope").alias("_mid"), "ancestor", "crossed")
        hop = checkpointed(up.join(far, ["file_id", "_mid"]).select("file_id", "scope", "ancestor", (F.col("_c") | F.col("crossed")).alias("crossed")))
        size *= 2
    return chain.where(F.col("distance") < most)


def resolve_refs(refs: DataFrame, bindings: DataFrame, chain: DataFrame, builtins: DataFrame | None = None, newest: bool = True) -> DataFrame:
    """refs with resolution (bound, builtin, maybe or unresolved) and binding.

    refs: file_id, ref, scope, name, offset.  bindings: file_id, binding, scope, name,
    visible_from (null: everywhere).  The nearest scope outward that holds a visible
    binding of the name wins, in it the newest (or oldest) binding.  A reference walks its
    own chain, so a name that many scopes of a file bind costs no product: it meets the
    scopes above it that bind the name, each once and not its bindings.  A running window
    over the bindings of a name in a scope, in the order in which they become visible,
    holds the one that counts.
    """
    b = bindings.select("file_id", F.col("scope").alias("ancestor"), "name", "binding", F.col("visible_from").cast("long").alias("at"))
    c = chain.select("file_id", "scope", "ancestor", "distance", "crossed")
    binders = b.select("file_id", "name", "ancestor").distinct()
    met = refs.select("file_id", "ref", "scope", "name", F.col("offset").cast("long").alias("at")).join(c.drop("crossed"), ["file_id", "scope"]).join(binders, ["file_id", "name", "ancestor"])
    key = ["file_id", "ancestor", "name"]
    both = b.select(*key, "at", F.lit(0).alias("kind"), "binding").unionByName(met.select(*key, "at", F.lit(1).alias("kind"), "ref", "distance"), allowMissingColumns=True)
    seen = Window.partitionBy(*key).orderBy(F.col("at").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("binding", (F.max if newest else F.min)("binding").over(seen)).where("kind = 1 and binding is not null")
    best = found.groupBy("file_id", "ref").agg(F.min_by("binding", "distance").alias("binding"))
    dynamic = c.where("crossed").select("file_id", "scope").distinct().withColumn("_dynamic", F.lit(True))
    out = refs.join(best, ["file_id", "ref"], "left").join(dynamic, ["file_id", "scope"], "left")
    built = F.lit(False)
    if builtins is not None:
        out = out.join(builtins.select("name").distinct().withColumn("_built", F.lit(True)), "name", "left")
        built = F.coalesce("_built", F.lit(False))
    kind = F.when(F.col("binding").isNotNull(), "bound").when(built, "builtin").when(F.coalesce("_dynamic", F.lit(False)), "maybe").otherwise("unresolved")
    return out.withColumn("resolution", kind).drop("_dynamic", "_built")


@dataclass(frozen=True)
class ScopeRules:
    """How a language looks names up.

    crosses: classes of scopes that are functions to what lies in them; skips: classes that a
    lookup passes by unless it starts there; order: which bindings of a scope a
    reference sees: ``from`` (visible before it), ``from_or_self`` (those, and a binding whose
    own name it is) or ``unordered``; ordered: the classes for which that holds, all if
    none are named, and only in these namespaces; newest: whether the last or the first
    of several counts; external: whether qualified names belong to other files.
    """

    crosses: tuple[str, ...] = ()
    skips: tuple[str, ...] = ()
    order: str = "from"
    ordered: tuple[str, ...] = ()
    namespaces: tuple[str, ...] = ()
    newest: bool = True
    external: bool = False


# The rules of languages.
SCOPE_RULES = {
    "go": ScopeRules(order="from_or_self", ordered=("block", "function"), namespaces=("value",), newest=False),
    "odin": ScopeRules(order="from_or_self"),
    "python": ScopeRules(crosses=("function", "lambda"), skips=("class",)),
    "rust": ScopeRules(external=True),
    "zig": ScopeRules(),
}


def resolve_by_rules(refs: DataFrame, bindings: DataFrame, scopes: DataFrame, builtins: DataFrame | None = None, rules: dict[str, ScopeRules] = SCOPE_RULES) -> DataFrame:
    """refs with resolution (bound, builtin, external, maybe or unresolved) and binding, by the rules of their language.

    refs: file_id, ref, language, scope, start (the scope where the lookup starts, null: its
    own), name, offset, namespace, retry (a namespace to try where the first has nothing, or
    null), qualified.  bindings: file_id, binding, scope, name, namespace, offset,
    visible_from (null: everywhere).  scopes: file_id, scope, parent, class, dynamic.
    builtins: language, name.  The rules are a table, joined to the chain of scopes by
    language and class of scope; a lookup that starts in another scope than its own counts
    as one from inside a function.

    As in resolve_refs, a reference walks its own chain and meets each scope that binds its
    name once: running windows over the bindings of a name in a scope hold the one that counts.
    """
    spark = refs.sparkSession
    table = [(language, r.order, list(r.ordered), list(r.namespaces), list(r.crosses), list(r.skips), r.newest, r.external) for language, r in rules.items()]
    table = F.broadcast(spark.createDataFrame(table, "language string, _order string, _ordered array<string>, _namespaces array<string>, _crosses array<string>, _skips array<string>, _newest boolean, _external boolean"))  # one row for each language
    chain = scope_chain(scopes).select("file_id", "scope", "ancestor", "distance").join(scopes.select("file_id", F.col("scope").alias("ancestor"), F.col("class").alias("_class"), F.coalesce("dynamic", F.lit(False)).alias("_dynamic")), ["file_id", "ancestor"])
    chain = checkpointed(chain)
    # The classes above a scope, 256 at most.
    above = chain.groupBy("file_id", "scope").agg(F.collect_list(F.struct("distance", "_class")).alias("_above"), F.max("_dynamic").alias("_dynamic"))
    r = refs.withColumn("_start", F.coalesce("start", "scope")).join(table, "language", "left")
    asked = F.filter(F.array(F.struct(F.lit(0).alias("turn"), F.col("namespace").alias("ns")), F.struct(F.lit(1).alias("turn"), F.col("retry").alias("ns"))), lambda x: x["ns"].isNotNull())
    r = r.withColumn("_asked", asked)
    binders = bindings.select("file_id", "name", "namespace", F.col("scope").alias("ancestor")).distinct()
    met = r.select("file_id", "ref", "name", F.col("offset").cast("long").alias("at"), "scope", "_start", "_order", "_ordered", "_namespaces", "_crosses", "_skips", "_newest", F.explode("_asked").alias("q"))
    met = met.select("*", "q.turn", F.col("q.ns").alias("namespace")).drop("q")
    met = met.join(chain.select("file_id", F.col("scope").alias("_start"), "ancestor", "distance", "_class"), ["file_id", "_start"])
    met = met.join(binders, ["file_id", "name", "namespace", "ancestor"])
    met = met.where(~(F.array_contains("_skips", F.col("_class")) & (F.col("distance") > 0)))
    ordered = ((F.size("_ordered") == 0) | F.array_contains("_ordered", F.col("_class"))) & ((F.size("_namespaces") == 0) | F.array_contains("_namespaces", F.col("namespace")))
    # A language whose functions are crossed sees all of an outer scope: its body runs later.
    inside = met.join(above.select("file_id", F.col("scope").alias("_start"), "_above"), ["file_id", "_start"])
    crossed = (F.col("_start") != F.col("scope")) | F.exists("_above", lambda x: (x["distance"] < F.col("distance")) & F.array_contains("_crosses", x["_class"]))
    met = inside.withColumn("order", F.when(ordered & ~crossed, F.col("_order")).otherwise("unordered")).drop("_above")
    key = ["file_id", "ancestor", "name", "namespace"]
    b = bindings.select("file_id", F.col("scope").alias("ancestor"), "name", "namespace", "binding", F.col("visible_from").cast("long").alias("at"), F.col("offset").cast("long").alias("own"))
    both = b.withColumn("kind", F.lit(0)).unionByName(met.select(*key, "ref", "at", F.lit(1).alias("kind"), "distance", "turn", "order", "_newest"), allowMissingColumns=True)
    seen = Window.partitionBy(*key).orderBy(F.col("at").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*key)
    of = lambda w: (F.min("binding").over(w), F.max("binding").over(w))
    both = both.withColumns({"_s0": of(seen)[0], "_s1": of(seen)[1], "_e0": of(every)[0], "_e1": of(every)[1]}).where("kind = 1")
    selves = b.where("own is not null").groupBy(*key, F.col("own").alias("at")).agg(F.min("binding").alias("_o0"), F.max("binding").alias("_o1"))
    both = both.join(selves, [*key, "at"], "left")
    self0, self1 = (F.when(F.col("order") == "from_or_self", F.col(c)) for c in ("_o0", "_o1"))
    least = F.when(F.col("order") == "unordered", F.col("_e0")).otherwise(F.least("_s0", self0))
    most = F.when(F.col("order") == "unordered", F.col("_e1")).otherwise(F.greatest("_s1", self1))
    both = both.withColumn("binding", F.when(F.col("_newest"), most).otherwise(least)).where("binding is not null")
    best = both.groupBy("file_id", "ref").agg(F.min_by("binding", F.struct("turn", "distance")).alias("binding"))
    out = r.join(best, ["file_id", "ref"], "left").join(above.select("file_id", F.col("scope").alias("_start"), "_dynamic"), ["file_id", "_start"], "left")
    built = F.lit(False)
    if builtins is not None:
        out = out.join(builtins.select("language", "name").distinct().withColumn("_built", F.lit(True)), ["language", "name"], "left")
        built = F.coalesce("_built", F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = F.when(F.col("binding").isNotNull(), "bound").when(built, "builtin").when(yes("_external") & yes("qualified"), "external").when(yes("_dynamic"), "maybe").otherwise("unresolved")
    return out.withColumn("resolution", kind).select(*refs.columns, "binding", "resolution")


def asof_binding(refs: DataFrame, bindings: DataFrame) -> DataFrame:
    """refs(file_id, ref, name, offset) with the last binding of the name at or before each: one window over both."""
    b = bindings.select("file_id", "name", F.col("offset").alias("at"), F.lit(0).alias("kind"), "binding", F.lit(None).cast("long").alias("ref"))
    r = refs.select("file_id", "name", F.col("offset").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("binding"), F.col("ref").cast("long"))
    order = Window.partitionBy("file_id", "name").orderBy("at", "kind", "binding")
    return b.unionByName(r).withColumn("binding", F.last("binding", True).over(order)).where("kind = 1").select("file_id", "ref", "name", F.col("at").alias("offset"), "binding")


def reference_counts(bindings: DataFrame, resolved: DataFrame) -> DataFrame:
    """bindings(file_id, binding, ...) with reference_count."""
    n = resolved.where("binding is not null").groupBy("file_id", "binding").agg(F.count("*").alias("reference_count"))
    return bindings.join(n, ["file_id", "binding"], "left").withColumn("reference_count", F.coalesce("reference_count", F.lit(0)))


def unused_bindings(bindings: DataFrame, resolved: DataFrame) -> DataFrame:
    return bindings.join(resolved.where("binding is not null").select("file_id", "binding").distinct(), ["file_id", "binding"], "left_anti")


def resolution_tally(resolved: DataFrame, kinds=("bound", "builtin", "external", "maybe", "unresolved"), context: str = "context") -> DataFrame:
    """file_id, context and one count column for each kind of resolution."""
    return resolved.groupBy("file_id", context).pivot("resolution", list(kinds)).count().na.fill(0)


def early_uses(resolved: DataFrame, bindings: DataFrame) -> DataFrame:
    """file_id, ref and binding of references before the end of their binding's dead zone."""
    b = bindings.where("dead_zone_end is not null").select("file_id", "binding", "dead_zone_end")
    return resolved.join(b, ["file_id", "binding"]).where("offset < dead_zone_end").select("file_id", "ref", "binding")


def redeclarations(bindings: DataFrame) -> DataFrame:
    """file_id, scope, name, binding and previous, where a scope binds a name again."""
    before = F.lag("binding").over(Window.partitionBy("file_id", "scope", "name").orderBy("binding"))
    return bindings.withColumn("previous", before).where("previous is not null").select("file_id", "scope", "name", "binding", "previous")


def scope_members(bindings: DataFrame) -> DataFrame:
    """file_id, scope and members: the names in order of binding."""
    return bindings.groupBy("file_id", "scope").agg(F.transform(F.array_sort(F.collect_list(F.struct("binding", "name"))), lambda x: x["name"]).alias("members"))


def rename_edits(bindings: DataFrame, resolved: DataFrame, renames: DataFrame) -> DataFrame:
    """file_id, offset, length and replacement: one edit for the name of each renamed binding and of each reference bound to it.

    renames: file_id, binding, new_name.  A binding that has its new name gives no edit.
    """
    r = renames.select("file_id", "binding", "new_name")
    own = bindings.select("file_id", "binding", "name", "offset").join(r, ["file_id", "binding"])
    bound = resolved.where("binding is not null").select("file_id", "binding", "name", "offset").join(r, ["file_id", "binding"])
    return own.unionByName(bound).where("name <> new_name").select("file_id", "offset", F.octet_length("name").alias("length"), F.col("new_name").alias("replacement")).distinct()


def duplicate_parameters(parameters: DataFrame) -> DataFrame:
    """file_id, function, name and n of parameters that a function names twice or more."""
    return parameters.groupBy("file_id", "function", "name").agg(F.count("*").alias("n")).where("n > 1")


def bare_except_not_last(handlers: DataFrame) -> DataFrame:
    """file_id, block and ordinal of handlers without a type that another handler follows."""
    after = F.lead("ordinal").over(Window.partitionBy("file_id", "block").orderBy("ordinal"))
    return handlers.withColumn("_next", after).where("type is null and _next is not null").select("file_id", "block", "ordinal")


def late_future_imports(statements: DataFrame) -> DataFrame:
    """file_id and ordinal of future imports after a statement of another kind (a docstring may lead)."""
    order = Window.partitionBy("file_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    other = ~F.col("kind").isin("future_import", "docstring")
    return statements.withColumn("_seen", F.max(other.cast("int")).over(order)).where("kind = 'future_import' and _seen = 1").select("file_id", "ordinal")


def used_before_global(uses: DataFrame, globals_: DataFrame) -> DataFrame:
    """file_id, function and name of names used before their global statement."""
    first = uses.groupBy("file_id", "function", "name").agg(F.min("offset").alias("used"))
    stated = globals_.groupBy("file_id", "function", "name").agg(F.min("offset").alias("stated"))
    return first.join(stated, ["file_id", "function", "name"]).where("used < stated").select("file_id", "function", "name")


def several_starred(targets: DataFrame) -> DataFrame:
    """file_id, statement and n of assignments with more than one starred target."""
    return targets.where("starred").groupBy("file_id", "statement").agg(F.count("*").alias("n")).where("n > 1")


def name_findings(resolved: DataFrame, bindings: DataFrame) -> DataFrame:
    """file_id, code, name and offset: F821 undefined name, F841 unused binding, F401 unused import, F811 redefined while unused."""
    undefined = resolved.where("resolution = 'unresolved'").select("file_id", F.lit("F821").alias("code"), "name", "offset")
    unused = unused_bindings(bindings, resolved)
    idle = unused.select("file_id", F.when(F.col("class") == "import", "F401").otherwise("F841").alias("code"), "name", "offset")
    again = redeclarations(bindings).join(unused.select("file_id", F.col("binding").alias("previous")), ["file_id", "previous"], "left_semi")
    again = again.join(bindings.select("file_id", "binding", "offset"), ["file_id", "binding"]).select("file_id", F.lit("F811").alias("code"), "name", "offset")
    return undefined.unionByName(idle).unionByName(again)
