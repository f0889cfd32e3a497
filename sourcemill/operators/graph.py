"""Import and call graphs: edges, cycles, order, resolution and reachability as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import Grown, checkpointed
from .spans import innermost

MAX_HOPS = 16
MAX_ROUNDS = 100_000


def import_edges(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """src, fact and dst: one edge for each fact with a specifier; dst is null where no file has it as its key.

    facts: file_id, fact, specifier; keys: specifier, file_id (of several files with one
    key the smallest counts).  A left join, so that popular specifiers are split by the
    engine like any skewed key.
    """
    k = keys.groupBy("specifier").agg(F.min("file_id").alias("dst"))
    return facts.join(k, "specifier", "left").select(F.col("file_id").alias("src"), "fact", "dst")


def unresolved_imports(edges: DataFrame) -> DataFrame:
    return edges.where("dst is null")


def dependents(edges: DataFrame) -> DataFrame:
    """file and dependent: the distinct importers of each file."""
    return edges.where("dst is not null").select(F.col("dst").alias("file"), F.col("src").alias("dependent")).distinct()


def _chains(step: DataFrame) -> DataFrame:
    """node, next, least, cuts and endless of the nodes with one step in steps (node, next), all distinct and none to the node itself.

    Such a node leads on without a choice.  next is where its chain stops, at a node with no
    step or several, or some node on it if it never stops (endless); least is the smallest
    node before next; cuts are nodes further and further along.  Each round goes four times
    as far, so a chain of n nodes takes log4(n) rounds.
    """
    only = step.groupBy("node").agg(F.min("next").alias("next"), F.count("*").alias("n")).where("n = 1")
    chains = checkpointed(only.select("node", "next", F.col("node").alias("least"), F.filter(F.array("next"), lambda x: F.lit(False)).alias("cuts"), F.lit(True).alias("endless")))
    reach, n = 1, chains.count()
    while reach <= n:
        far = chains.select(F.col("node").alias("_node"), F.col("next").alias("_next"), F.col("least").alias("_least"))
        for _ in range(3):
            on = F.col("_next").isNotNull()
            chains = chains.join(far, F.col("next") == F.col("_node"), "left").select(
                "node", F.coalesce("_next", "next").alias("next"), F.least("least", "_least").alias("least"), F.when(on, F.array_append("cuts", F.col("_next"))).otherwise(F.col("cuts")).alias("cuts"), on.alias("endless"),
            )
        chains, reach = checkpointed(chains), 4 * reach
        if chains.where("endless").isEmpty():
            break
    return chains


def _cuts(chains: DataFrame) -> DataFrame:
    return chains.select("node", F.explode("cuts").alias("next")).where("node <> next")


def _grow(front: DataFrame, step: DataFrame, keys: list[str], cuts: DataFrame | None = None) -> DataFrame:
    """All rows of keys + [node] that steps (node, next) reach from front, front included.

    Rounds follow the number of choices on a path, not its length: chains without a choice
    are crossed by shortcuts, which cuts (node, next) has if they are known.  Every row is
    written once, in the round that reached it.
    """
    step = checkpointed(step.where("node <> next").distinct())
    step = step.unionByName(_cuts(_chains(step)) if cuts is None else cuts)
    seen = Grown(front.sparkSession)
    front = seen.add(front.select(*keys, "node").distinct())
    for _ in range(MAX_ROUNDS):
        new = front.join(step, "node").select(*keys, F.col("next").alias("node")).distinct()
        front = seen.add(new.join(seen.all(), [*keys, "node"], "left_anti"))
        if front.isEmpty():
            return seen.all()
    raise RuntimeError("the closure did not settle")


def transitive_dependents(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """file and dependent: every file that reaches a changed(file) one over its imports."""
    step = edges.where("dst is not null").select(F.col("dst").alias("node"), F.col("src").alias("next")).distinct()
    front = changed.select("file", F.col("file").alias("node")).join(step, "node").select("file", F.col("next").alias("node"))
    return _grow(front, step, ["file"]).select("file", F.col("node").alias("dependent"))


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """file: the roots and every file that imports lead to from them."""
    step = edges.where("dst is not null").select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    return _grow(roots.select(F.col("file").alias("node")), step, []).select(F.col("node").alias("file"))


def orphans(files: DataFrame, edges: DataFrame, entry_points: DataFrame) -> DataFrame:
    """file: neither imported by another file nor an entry point."""
    used = edges.where("dst is not null and dst <> src").select(F.col("dst").alias("file")).unionByName(entry_points.select("file"))
    return files.select("file").join(used, "file", "left_anti")


def unreached(files: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    return files.select("file").join(reachable(edges, roots), "file", "left_anti")


def _peeled(left: DataFrame, one: str, other: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gone, rings, chains) of the edges (src, dst), followed from ``one`` to ``other``.

    gone has the nodes from which every way is a chain: one that stops, so no cycle holds
    them, or one that runs into a ring.  rings has node and component of the nodes on such
    rings, which nothing leaves.
    """
    step = left.select(F.col(one).alias("node"), F.col(other).alias("next"))
    chains = _chains(step)
    stopped = step.select(F.col("next").alias("node")).distinct().join(step.select("node"), "node", "left_anti")
    dead = chains.join(stopped.withColumnRenamed("node", "next"), "next", "left_semi").select("node").unionByName(stopped)
    endless = chains.where("endless").join(chains.select(F.col("node").alias("next")), "next", "left_semi")
    rings = endless.join(endless.select(F.col("next").alias("node")).distinct(), "node", "left_semi").select("node", F.col("least").alias("component"))
    return checkpointed(dead.unionByName(endless.select("node"))), rings, chains


def _without(left: DataFrame, gone: DataFrame) -> DataFrame:
    return checkpointed(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and component: the smallest node of its strongly connected component.

    Nodes on chains that stop, or run into a ring, are peeled off from both sides, again
    after each round.  In the rest, colours spread: every node takes the largest node that
    reaches it, and the nodes of a colour that reach its root backwards within the colour
    are one component.  Each round settles at least one component of every colour.
    Chains are crossed by shortcuts, so a ring or a chain of n nodes takes some log n rounds.
    """
    left = checkpointed(edges.where("dst is not null and src <> dst").select("src", "dst").distinct())
    done = Grown(edges.sparkSession)
    for _ in range(MAX_ROUNDS):
        n, before, chains = left.count(), None, None
        while n and n != before:
            gone, rings, chains = _peeled(left, "src", "dst")
            if not gone.isEmpty():
                done.add(rings)
                left = _without(left, gone)
                if left.isEmpty():
                    n = 0
                    break
            gone, rings, back = _peeled(left, "dst", "src")
            if not gone.isEmpty():
                done.add(rings)
                left = _without(left, gone)
            n, before = left.count(), n
        if not n:
            break
        there, back = _cuts(chains).select(F.col("node").alias("src"), F.col("next").alias("dst")), _cuts(back).select(F.col("next").alias("src"), F.col("node").alias("dst"))
        ways = checkpointed(left.unionByName(there).unionByName(back).distinct())
        colour = checkpointed(left.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:  # forward: the largest colour that arrives
            came = ways.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("c"))
            new = checkpointed(colour.join(came, "node", "left").select("node", F.greatest("colour", F.coalesce("c", "colour")).alias("colour"), (F.col("c") > F.col("colour")).alias("up")))
            colour = new.select("node", "colour")
            if new.where("up").isEmpty():
                break
        own = colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("b"))
        inside = ways.join(own[0], "src").join(own[1], "dst").where("a = b").select(F.col("dst").alias("node"), F.col("src").alias("next"))
        # What lies on a way between two nodes of a colour has that colour, so shortcuts stay inside.
        members = _grow(colour.where("node = colour").select("colour", "node"), inside, ["colour"], inside.limit(0))
        # A component may be large: its smallest node is summed up first, and joined back.
        least = members.groupBy("colour").agg(F.min("node").alias("component"))
        left = _without(left, done.add(members.join(least, "colour").select("node", "component")).select("node"))
    out = nodes.select("node").distinct()
    if not done.parts:
        return out.withColumn("component", F.col("node"))
    return out.join(done.all(), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cycles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """component and node of every cycle: components of two or more nodes, and nodes that import themselves."""
    parts = strong_components(edges, nodes)
    several = parts.where("node <> component").select("component").distinct()
    big = parts.join(several, "component", "left_semi").select("component", "node")
    own = edges.where("src = dst").select(F.col("src").alias("node")).distinct().join(big, "node", "left_anti")
    return big.unionByName(own.select(F.col("node").alias("component"), "node"))


def _through(one: DataFrame) -> DataFrame:
    """a, b, w and low of rows (a, b, w, low), one for each a: where the chain from a leads, with level(a) = max(low, level(b) + w).

    Such functions of a level are closed under composition; each round composes four.
    """
    reach, n = 1, one.count()
    while reach <= n:
        far = one.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("w").alias("_w"), F.col("low").alias("_low"))
        for _ in range(3):
            one = one.join(far, F.col("b") == F.col("_a"), "left").select(
                "a", F.coalesce("_b", "b").alias("b"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"), F.greatest("low", F.col("_low") + F.col("w")).alias("low"), F.col("_b").isNotNull().alias("moved"),
            )
        one, reach = checkpointed(one), 4 * reach
        if one.where("moved").isEmpty():
            break
    return one.select("a", "b", "w", "low")


def _levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """a and level of nodes(a): the longest path over edges (a, b), which have no cycle.

    Each round takes the nodes without an edge left, whose level is known, and puts what
    they give into the bound ``low`` of those above; nodes with one edge left are taken
    out of the graph as functions of where their chain leads.  Rounds thus follow the
    branching of the graph, not the length of its paths.
    """
    edges = checkpointed(edges.select("a", "b", F.lit(1).cast("long").alias("w")))
    left = checkpointed(nodes.select("a", F.lit(0).cast("long").alias("low")))
    known, waiting = Grown(edges.sparkSession), []
    for _ in range(MAX_ROUNDS):
        free = known.add(left.join(edges, "a", "left_anti").select("a", F.col("low").alias("level")))
        left = checkpointed(left.join(free, "a", "left_anti"))
        if left.isEmpty():
            break
        given = edges.join(free.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.max(F.col("level") + F.col("w")).alias("more"))
        left = checkpointed(left.join(given, "a", "left").select("a", F.greatest("low", F.coalesce("more", F.lit(0))).alias("low")))
        edges = checkpointed(edges.join(free.select(F.col("a").alias("b")), "b", "left_anti"))
        single = edges.groupBy("a").agg(F.min("b").alias("b"), F.min("w").alias("w"), F.count("*").alias("n")).where("n = 1").drop("n")
        single = checkpointed(single.join(left, "a"))
        if single.isEmpty():
            continue
        chains = _through(single)
        waiting.append(chains)
        left = checkpointed(left.join(chains, "a", "left_anti"))
        over = edges.join(chains.select("a"), "a", "left_anti").join(chains.select(F.col("a").alias("b"), F.col("b").alias("_b"), F.col("w").alias("_w"), F.col("low").alias("_low")), "b", "left")
        over = checkpointed(over)
        more = over.where("_b is not null").groupBy("a").agg(F.max(F.col("_low") + F.col("w")).alias("more"))
        left = checkpointed(left.join(more, "a", "left").select("a", F.greatest("low", F.coalesce("more", F.lit(0))).alias("low")))
        edges = checkpointed(over.groupBy("a", F.coalesce("_b", "b").alias("b")).agg(F.max(F.col("w") + F.coalesce("_w", F.lit(0))).alias("w")))
    for chains in reversed(waiting):
        ends = known.all().select(F.col("a").alias("b"), F.col("level").alias("_l"))
        known.add(chains.join(ends, "b").select("a", F.greatest("low", F.col("_l") + F.col("w")).alias("level")))
    return known.all()


def dependency_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component and level: what a file imports has a smaller level, unless they share a component.

    The level is the longest path in the graph of components; sorting by (level,
    component, node) is a valid order.
    """
    parts = checkpointed(strong_components(edges, nodes))
    a, b = parts.select(F.col("node").alias("src"), F.col("component").alias("a")), parts.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    between = edges.where("dst is not null").select("src", "dst").distinct().join(a, "src").join(b, "dst").where("a <> b").select("a", "b").distinct()
    levels = _levels(between, parts.select(F.col("component").alias("a")).distinct())
    return parts.join(levels.withColumnRenamed("a", "component"), "component").select("node", "component", F.col("level").cast("int").alias("level"))


def star_files(facts: DataFrame) -> DataFrame:
    """file_id of the files that pass on all names of another."""
    return facts.where(F.col("kind").isin("export_all", "import_namespace") & F.col("local").isNull()).select("file_id").distinct()


def resolve_exports(queries: DataFrame, forwards: DataFrame, edges: DataFrame, declarations: DataFrame, facts: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """file_id and name of every query with outcome, target_file, target_name and binding.

    A name that a forward fact of its file passes on is followed to the file of the
    fact's edge, under its remote name, at most ``hops`` times.  Outcomes: binding (found
    declared), maybe (a star import may supply it, or the chain is too long), missing,
    unresolved (the edge leads nowhere).  What a file says of a name is put together and
    partitioned once; only open queries take part in a round and are shuffled to it.
    """
    step = forwards.join(edges.select(F.col("src").alias("file_id"), "fact", "dst"), ["file_id", "fact"], "left").select(F.col("file_id").alias("at"), F.col("local").alias("as"), F.coalesce("remote", "local").alias("next"), "dst")
    held = declarations.select(F.col("file_id").alias("at"), F.col("name").alias("as"), "binding")
    stars = star_files(facts).select(F.col("file_id").alias("at"), F.lit(True).alias("star"))
    said = step.withColumn("forward", F.lit(True)).join(held, ["at", "as"], "full")
    said = checkpointed(said.repartition("at", "as"))
    stars = checkpointed(stars.repartition("at"))
    open_ = queries.select("file_id", "name", F.col("file_id").alias("at"), F.col("name").alias("as")).distinct()
    done = None
    for hop in range(hops + 1):
        tried = open_.join(said, ["at", "as"], "left").join(stars, "at", "left")
        outcome = F.when(F.col("forward") & F.col("dst").isNull(), "unresolved").when(F.col("forward"), F.lit("maybe") if hop == hops else None)
        outcome = outcome.when(F.col("binding").isNotNull(), "binding").when(F.col("star"), "maybe").otherwise("missing")
        tried = checkpointed(tried.withColumn("outcome", outcome))
        ended = tried.where("outcome is not null").select(
            "file_id", "name", "outcome", *(F.when(F.col("outcome") == "binding", F.col(c)).alias(n) for c, n in (("at", "target_file"), ("as", "target_name"), ("binding", "binding")))
        )
        done = ended if done is None else done.unionByName(ended)
        open_ = tried.where("outcome is null").select("file_id", "name", F.col("dst").alias("at"), F.col("next").alias("as"))
        if open_.isEmpty():
            break
    return done


def layer_violations(edges: DataFrame, files: DataFrame, allowed: DataFrame, exempt: str = r"(^|/)(test|fuzz)|_(test|fuzz)\.") -> DataFrame:
    """src, dst, src_layer and dst_layer of imports between layers that allowed(src_layer, dst_layer) does not list.

    files: file, path below the source root; its first directory is its layer.  Files
    whose path fits ``exempt`` may import anything.
    """
    layer = F.regexp_extract("path", "^([^/]+)/", 1)
    f = files.select("file", layer.alias("layer"), F.col("path").rlike(exempt).alias("free"))
    e = edges.where("dst is not null").select("src", "dst").distinct()
    e = e.join(f.select(F.col("file").alias("src"), F.col("layer").alias("src_layer"), "free"), "src").where("not free").drop("free")
    e = e.join(f.select(F.col("file").alias("dst"), F.col("layer").alias("dst_layer")), "dst").where("src_layer <> dst_layer")
    return e.join(allowed, ["src_layer", "dst_layer"], "left_anti").select("src", "dst", "src_layer", "dst_layer")


def stale_files(snapshot: DataFrame, files: DataFrame) -> DataFrame:
    """file of the snapshot(file, generation) rows that are gone or have another generation now."""
    now = files.select("file", F.col("generation").alias("_now"))
    return snapshot.join(now, "file", "left").where("_now is null or _now <> generation").select("file")


def call_edges(resolved: DataFrame, callees: DataFrame, functions: DataFrame) -> DataFrame:
    """file_id, source, target and offset: calls from the function around a callee to the function it is bound to.

    resolved: refs with binding; callees: file_id, ref; functions: file_id, function,
    binding, offset, length.
    """
    called = resolved.join(callees, ["file_id", "ref"], "left_semi").select("file_id", "offset", "binding")
    target = functions.select("file_id", "binding", F.col("function").alias("target"))
    called = called.join(target, ["file_id", "binding"]).select("file_id", "offset", "target")
    held = innermost(called, functions.select("file_id", F.col("function").alias("span_id"), "offset", "length"))
    return held.where("span_id is not null").select("file_id", F.col("span_id").alias("source"), "target", "offset")


def resolve_methods(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls(file_id, container, name, ...) with function, where exactly one function has that container and name."""
    one = functions.groupBy("file_id", "container", "name").agg(F.count("*").alias("n"), F.min("function").alias("function")).where("n = 1").drop("n")
    return calls.join(one, ["file_id", "container", "name"], "left")


def recursive_functions(calls: DataFrame) -> DataFrame:
    """file_id and function of functions that call themselves, directly or through others."""
    key = lambda c: F.struct("file_id", c)
    edges = calls.select(key(F.col("source").alias("function")).alias("src"), key(F.col("target").alias("function")).alias("dst"))
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return cycles(edges, nodes).select("node.file_id", "node.function")


# Spellings of no value, in whatever language, and marks of a result that may be absent or fail, by language.
VOID = ("()", "!noreturn", "!void", "None", "noreturn", "void")
FALLIBLE = {"javascript": ("null", "undefined"), "typescript": ("null", "undefined"), "odin": ("Maybe(",), "python": ("None", "Optional["), "rust": ("Option<", "Result<"), "zig": ("!", "?")}


def function_flags(functions: DataFrame) -> DataFrame:
    """functions(language, return_type, ...) with fallible and value.

    A function is fallible where its return type holds ``error`` or a mark of its
    language, and returns a value unless its type is a spelling of none, or is absent.
    """
    text = F.coalesce("return_type", F.lit(""))
    fallible = F.contains(text, F.lit("error"))
    for language, marks in FALLIBLE.items():
        for mark in marks:
            fallible = fallible | ((F.col("language") == language) & F.contains(text, F.lit(mark)))
    return functions.withColumns({"fallible": F.coalesce(fallible, F.lit(False)), "value": (text != "") & ~text.isin(*VOID)})


def agreed_flags(flagged: DataFrame) -> DataFrame:
    """name, fallible and value: what all functions of a name agree on, null where they differ."""
    agree = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    return flagged.groupBy("name").agg(agree("fallible"), agree("value"))


def _closure(pairs: DataFrame) -> DataFrame:
    """a, b, depth and extended of all pairs that pairs (a, b, depth, extended) lead along: the least sums, of all and of those without a null.

    Each round joins the closure with itself, so paths of twice the length are covered.
    """
    least = lambda df: df.groupBy("a", "b").agg(F.min("depth").alias("depth"), F.min("extended").alias("extended"))
    size = lambda df: tuple(df.agg(F.count("*"), F.sum("depth"), F.count("extended"), F.sum("extended")).first())
    whole = checkpointed(least(pairs))
    now, before = size(whole), None
    while now != before:
        far = whole.select(F.col("a").alias("b"), F.col("b").alias("_b"), F.col("depth").alias("_d"), F.col("extended").alias("_e"))
        more = whole.join(far, "b").select("a", F.col("_b").alias("b"), (F.col("depth") + F.col("_d")).alias("depth"), (F.col("extended") + F.col("_e")).alias("extended"))
        whole = checkpointed(least(whole.unionByName(more)))
        now, before = size(whole), now
    return whole


def template_tree(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """file_id, depth, target and state of the chain of ``extends`` from each template: found, missing or circular.

    A chain ends with a template that extends none, with a missing one, or where it comes
    back to one of its own (circular).  Of several extends in a file the first counts.
    """
    edges = import_edges(facts.where("kind = 'extends'"), keys).groupBy("src").agg(F.min_by(F.struct("dst"), "fact").alias("t")).select(F.col("src").alias("a"), F.col("t.dst").alias("b"))
    one = F.lit(1).alias("depth")
    found = _closure(edges.where("b is not null").select("a", "b", one, F.lit(1).alias("extended"))).where("a <> b").select(F.col("a").alias("file_id"), "depth", F.col("b").alias("target"))
    # Where the chain stands last, itself if it leads nowhere else, and what comes next there.
    last = found.groupBy("file_id").agg(F.max("depth").alias("depth"), F.max_by("target", "depth").alias("at"))
    last = edges.select(F.col("a").alias("file_id")).join(last, "file_id", "left").select("file_id", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("at", "file_id").alias("at"))
    ends = last.join(edges.select(F.col("a").alias("at"), F.col("b").alias("target")), "at")
    ends = ends.select("file_id", (F.col("depth") + 1).alias("depth"), "target", F.when(F.col("target").isNull(), "missing").otherwise("circular").alias("state"))
    return found.withColumn("state", F.lit("found")).unionByName(ends)


def template_closure(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """file_id, target, specifier, depth, extended and state of all that each template draws in by ``extends`` and ``include``.

    depth is the least number of steps, extended the least by extends alone (null if that
    does not lead there).  state is found, circular where a template draws in itself, or
    missing: then target is null and specifier says what was asked for, by the template or
    one that it draws in.  No depth is too great; every pair is one row.
    """
    used = facts.where("kind in ('extends', 'include') and specifier is not null")
    edges = import_edges(used, keys).join(used.select(F.col("file_id").alias("src"), "fact", "kind", "specifier"), ["src", "fact"])
    step = F.when(F.col("kind") == "extends", 1)
    whole = _closure(edges.where("dst is not null").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("depth"), step.alias("extended")))
    found = whole.select(F.col("a").alias("file_id"), F.col("b").alias("target"), F.lit(None).cast("string").alias("specifier"), "depth", "extended", F.when(F.col("a") == F.col("b"), "circular").otherwise("found").alias("state"))
    lost = edges.where("dst is null").select(F.col("src").alias("b"), "specifier", step.alias("step"))
    there = whole.select("a", "b", "depth", "extended").unionByName(lost.select(F.col("b").alias("a"), "b", F.lit(0).alias("depth"), F.lit(0).alias("extended")).distinct())
    missing = there.join(lost, "b").groupBy(F.col("a").alias("file_id"), "specifier").agg(F.min(F.col("depth") + 1).alias("depth"), F.min(F.col("extended") + F.col("step")).alias("extended"))
    return found.unionByName(missing.select("file_id", F.lit(None).cast(found.schema["target"].dataType).alias("target"), "specifier", "depth", "extended", F.lit("missing").alias("state")))
