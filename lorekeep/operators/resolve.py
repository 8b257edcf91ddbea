"""Resolvers: from names that code mentions to the nodes they mean, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import has_path_prefix, language, lower_first, package_of, short_name


def rpc_candidates(pkg: Column, svc: Column, method: Column, small: Column) -> Column:
    """Symbols that code generators make of an rpc, each with the language of its generator; ``small`` is the method with
    a small first letter.

    Fixed values: the names that generators for Go, Dart and TypeScript give to services and methods.
    """
    names = [
        ("go", F.concat(pkg, F.lit("."), svc, F.lit("Server."), method)),
        ("go", F.concat(pkg, F.lit("."), svc, F.lit("Client."), method)),
        ("go", F.concat(pkg, F.lit(".Unimplemented"), svc, F.lit("Server."), method)),
        ("go", F.concat(pkg, F.lit("."), svc, F.lit("Handler."), method)),
        ("dart", F.concat(pkg, F.lit("."), svc, F.lit("Client."), small)),
        ("dart", F.concat(pkg, F.lit("."), svc, F.lit("Base."), small)),
        ("ts", F.concat(pkg, F.lit("."), svc, F.lit("Client."), small)),
        ("ts", F.concat(pkg, F.lit("."), svc, F.lit("."), small)),
        ("ts", F.concat(pkg, F.lit("_grpc_web_pb."), svc, F.lit("Client."), small)),
        ("ts", F.concat(pkg, F.lit("_grpc_web_pb."), svc, F.lit("PromiseClient."), small)),
        ("ts", F.concat(pkg, F.lit("_pb_service."), svc, F.lit("Client."), small)),
    ]
    return F.array(*(F.struct(F.lit(i).alias("nth"), F.lit(lang).alias("lang"), name.alias("name")) for i, (lang, name) in enumerate(names)))


def implements_rpc(nodes: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """implements_rpc edges from generated symbols to rpcs (symbols whose metadata has an input type).

    ``manifest`` (proto_path, lang, prefix) says where generators write: a candidate outside all prefixes of its
    language is left out; without prefixes, or without a path, names alone decide.
    """
    rpcs = nodes.where(F.col("kind") == "symbol").where(F.col("metadata").contains('"input_type":') & F.col("id").startswith("sym:"))
    parts = F.split(F.regexp_replace("id", "^sym:", ""), r"\.")
    rpcs = rpcs.select(F.col("id").alias("to_node"), F.col("source_path").alias("proto_path"), parts.alias("parts")).where(F.size("parts") >= 3)
    named = rpcs.select("to_node", "proto_path", F.array_join(F.slice("parts", 1, F.size("parts") - 2), ".").alias("pkg"), F.element_at("parts", -2).alias("svc"), F.element_at("parts", -1).alias("method"))
    named = named.withColumn("small", lower_first(F.col("method")))
    asked = named.select("to_node", "proto_path", F.explode(rpc_candidates(*map(F.col, ("pkg", "svc", "method", "small")))).alias("c"))
    asked = asked.groupBy("to_node", F.col("c.name").alias("name")).agg(F.min(F.struct("c.nth", "c.lang", "proto_path")).alias("c")).select("to_node", F.concat(F.lit("sym:"), "name").alias("from_node"), "c.lang", "c.proto_path")
    found = asked.where("from_node <> to_node").join(nodes.select(F.col("id").alias("from_node"), "source_path"), "from_node")
    if manifest is not None:
        known = manifest.groupBy("proto_path", "lang").agg(F.collect_set("prefix").alias("prefixes"))
        found = found.join(known, ["proto_path", "lang"], "left")
        free = F.col("prefixes").isNull() | (F.coalesce("source_path", F.lit("")) == "") | (F.coalesce("proto_path", F.lit("")) == "")
        found = found.where(free | F.exists("prefixes", lambda p: has_path_prefix(F.col("source_path"), p)))
    return found.select("from_node", "to_node", F.lit("implements_rpc").alias("kind"), F.lit(1.0).alias("weight"), F.lit("{}").alias("metadata")).distinct()


def buf_manifest(plugins: DataFrame, protos: DataFrame) -> DataFrame:
    """(proto_path, lang, prefix) of every plugin (lang, out) for every proto file: both lists are those of one project,
    and the manifest is their product by definition. The link is their common project."""
    left = protos.select("proto_path", F.coalesce("project", F.lit("")).alias("project"))
    right = plugins.select("lang", F.col("out").alias("prefix"), F.coalesce("project", F.lit("")).alias("project"))
    return left.join(right, "project").select("proto_path", "lang", "prefix").distinct()


def resolve_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is a bare placeholder name (``is_placeholder``), moved to the symbols that it means.

    A symbol of the source's package wins; else the only symbol of that short name; else all of that name, each marked as
    ambiguous. Edges without any stay as they are.
    """
    real = nodes.where("NOT is_placeholder AND kind = 'symbol'").select(F.col("id").alias("real"), F.regexp_replace("id", "^sym:", "").alias("fqn"))
    real = real.withColumns({"short": short_name(F.col("fqn")), "pkg": package_of(F.col("fqn"))})
    bare = edges.join(nodes.where("is_placeholder").select(F.col("id").alias("to_node")), "to_node", "left_semi").where(F.col("to_node").startswith("sym:") & ~F.col("to_node").contains("."))
    bare = bare.withColumns({"short": F.regexp_replace("to_node", "^sym:", ""), "pkg": package_of(F.regexp_replace("from_node", "^sym:", ""))})
    near = bare.join(real.select("real", "short", "pkg"), ["short", "pkg"]).select("from_node", "to_node", "kind", "weight", "metadata", "real", F.lit(False).alias("ambiguous"))
    rest = bare.join(near.select("from_node", "to_node", "kind"), ["from_node", "to_node", "kind"], "left_anti")
    counts = real.groupBy("short").agg(F.count("*").alias("n"))
    wide = rest.join(real.select("real", "short").join(counts, "short"), "short").where("real <> from_node").select("from_node", "to_node", "kind", "weight", "metadata", "real", (F.col("n") > 1).alias("ambiguous"))
    moved = near.unionByName(wide)
    clean = F.from_json("metadata", "map<string,string>")
    meta = F.map_filter(F.coalesce(clean, F.create_map().cast("map<string,string>")), lambda k, v: k != "unresolved")
    meta = F.when(F.col("ambiguous"), F.map_concat(meta, F.create_map(F.lit("ambiguous_resolution"), F.lit("true")))).otherwise(meta)
    out = moved.select("from_node", F.col("real").alias("to_node"), "kind", "weight", F.to_json(meta).alias("metadata"))
    kept = edges.join(moved.select("from_node", "to_node", "kind").distinct(), ["from_node", "to_node", "kind"], "left_anti")
    return kept.select("from_node", "to_node", "kind", "weight", "metadata").unionByName(out.distinct())


def resolve_body_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_node, target_name, op, to_node, unresolved): a body's target by name, or the table before its last dot."""
    ids = nodes.select(F.col("id").alias("hit"))
    exact = edges.withColumn("want", F.concat(F.lit("sym:"), "target_name"))
    table = F.concat(F.lit("sym:"), F.regexp_replace("target_name", r"\.[^.]*$", ""))
    one = exact.join(ids.withColumnRenamed("hit", "h1"), F.col("want") == F.col("h1"), "left")
    two = one.withColumn("want2", F.when(F.col("target_name").rlike(r"\..*\."), table)).join(ids.withColumnRenamed("hit", "h2"), F.col("want2") == F.col("h2"), "left")
    found = F.coalesce("h1", "h2")
    return two.select("from_node", "target_name", "op", F.coalesce(found, F.col("want")).alias("to_node"), found.isNull().alias("unresolved"))


def test_subjects(path: Column) -> Column:
    """Paths that a test file may be the test of, in order of preference.

    Fixed values: naming rules of Go, Python, Java and JavaScript / TypeScript tests.
    """
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    up = F.regexp_replace(folder, r"[^/]+/$", "")
    last = F.regexp_extract(folder, r"([^/]+)/$", 1)
    none = F.array().cast("array<string>")
    go = F.when(stem.endswith("_test"), F.array(F.concat(folder, F.regexp_replace(stem, "_test$", ""), F.lit(".go")))).otherwise(none)
    subject = F.concat(F.regexp_replace(stem, "^test_", ""), F.lit(".py"))
    py = F.when(stem.startswith("test_"), F.when(last.isin("tests", "test"), F.array(F.concat(folder, subject), F.concat(up, subject))).otherwise(F.array(F.concat(folder, subject)))).when(stem.endswith("Tests"), F.array(F.concat(folder, F.regexp_replace(stem, "Tests$", ""), F.lit(".py")))).otherwise(none)
    java = F.when(stem.endswith("Test"), F.array(F.concat(folder, F.regexp_replace(stem, "Test$", ""), F.lit(".java")))).otherwise(none)
    matched = stem.rlike(r"\.(test|spec)$")
    inside = last == "__tests__"
    base = F.regexp_replace(stem, r"\.(test|spec)$", "")
    exts = F.when(ext.isin(".tsx", ".ts"), F.array(F.lit(".ts"), F.lit(".tsx"))).when(ext.isin(".jsx", ".js"), F.array(F.lit(".js"), F.lit(".jsx"), F.lit(".ts"), F.lit(".tsx"))).otherwise(F.array(ext))
    here, above = F.transform(exts, lambda e: F.concat(folder, base, e)), F.transform(exts, lambda e: F.concat(up, base, e))
    js = F.when(matched & inside, F.concat(here, above)).when(matched, here).when(inside, above).otherwise(none)
    return F.when(ext == ".go", go).when(ext == ".py", py).when(ext == ".java", java).when(ext.isin(".ts", ".tsx", ".js", ".jsx", ".mts", ".mjs", ".cts", ".cjs"), js).otherwise(none)


def test_edges(files: DataFrame) -> DataFrame:
    """tests edges between the paths of ``files``."""
    asked = files.select("path", F.explode(test_subjects(F.col("path"))).alias("subject")).where("path <> subject")
    hit = asked.join(files.select(F.col("path").alias("subject")), "subject", "left_semi")
    return hit.select(F.concat(F.lit("file:"), "path").alias("from_node"), F.concat(F.lit("file:"), "subject").alias("to_node"), F.lit("tests").alias("kind"), F.lit(1.0).alias("weight"), F.lit('{"heuristic":true}').alias("metadata")).distinct()


def resolve_type_variables(pending: DataFrame, variables: DataFrame) -> DataFrame:
    """(from_node, to_node, resolved): ``pending`` has an edge's argument names with the module that each comes from,
    ``variables`` the type variables by module and name."""
    asked = pending.select("from_node", "to_node", F.explode("type_args").alias("arg"))
    hit = asked.join(variables, (asked["arg.module"] == variables["module"]) & (asked["arg.name"] == variables["name"]))
    return hit.groupBy("from_node", "to_node").agg(F.sort_array(F.collect_set(F.concat_ws(".", "module", "name"))).alias("resolved"))


#: File endings that a module specifier may stand for, in order of preference.
MODULE_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mts", ".mjs", ".cts", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, specifier, target): relative specifiers of JavaScript and TypeScript, by preference of ending. A .js
    specifier means its TypeScript sibling if that is there."""
    folder = F.split(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), "/")
    steps = F.concat(F.filter(folder, lambda x: x != ""), F.filter(F.split("specifier", "/"), lambda x: ~x.isin("", ".")))
    clean = F.aggregate(steps, F.array().cast("array<string>"), lambda a, x: F.when((x == "..") & (F.size(a) > 0), F.slice(a, 1, F.size(a) - 1)).otherwise(F.concat(a, F.array(x))))
    whole = F.array_join(clean, "/")
    named = [F.concat(whole, F.lit(e)) for e in MODULE_ENDINGS]
    ts = F.when(whole.rlike(r"\.jsx?$"), F.concat(F.regexp_replace(whole, r"\.jsx?$", ""), F.lit(".ts")))
    asked = imports.where(F.col("specifier").startswith(".")).select("path", "specifier", F.posexplode(F.array(F.coalesce(ts, F.lit("\x00")), *named)).alias("nth", "target"))
    hit = asked.join(files.select(F.col("path").alias("target")), "target", "left_semi")
    return hit.groupBy("path", "specifier").agg(F.min(F.struct("nth", "target")).alias("m")).select("path", "specifier", F.col("m.target").alias("target"))


def rpc_implementations(edges: DataFrame, nodes: DataFrame, rpc: str, depth: int = 3) -> dict[str, DataFrame]:
    """What is known of an rpc: its node, implementations, callers over ``call`` up to ``depth`` hops, direct callers."""
    impl = edges.where((F.col("to_node") == rpc) & (F.col("kind") == "implements_rpc")).select(F.col("from_node").alias("id"))
    callers, front = None, impl.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        front = edges.where("kind = 'call'").join(front.select(F.col("id").alias("to_node")), "to_node", "left_semi").select(F.col("from_node").alias("id")).distinct().withColumn("depth", F.lit(d))
        callers = front if callers is None else callers.unionByName(front)
    near = callers.groupBy("id").agg(F.min("depth").alias("depth")).join(nodes, "id").orderBy("depth", "source_path", "id")
    direct = edges.where((F.col("to_node") == rpc) & (F.col("kind") == "call_rpc")).select(F.col("from_node").alias("id")).distinct()
    siblings = F.regexp_replace(F.lit(rpc), r"[^.]*$", "")
    related = nodes.where(F.col("id").startswith(siblings) & (F.col("id") != rpc) & F.col("metadata").contains('"input_type":')).orderBy("id")
    definition = nodes.where(F.col("id") == rpc)
    implementations = impl.join(nodes, "id").withColumns({"language": language(F.col("source_path")), "side": implementation_kind(F.col("id"))})
    return {
        "definition": definition, "fields": message_fields(definition, nodes), "implementations": implementations.orderBy("language", "id"),
        "callers": near, "direct": direct.join(nodes, "id").orderBy("id"), "related": related,
    }


def implementation_kind(node_id: Column) -> Column:
    """How generated names tell a server's side from a client's."""
    owner = F.regexp_extract(node_id, r"([^.]*)\.[^.]*$", 1)
    return F.when(owner.rlike("(Server|Handler|Base)$"), "server").when(owner.rlike("Client$"), "client").otherwise("stub")


def message_fields(rpcs: DataFrame, nodes: DataFrame, depth: int = 3) -> DataFrame:
    """(role, level, message, field, type, number): the fields of the rpcs' input and output messages, and of the messages
    that these have as fields, ``depth`` levels down. A type is looked for in the message's own scope and outwards."""
    of = lambda name: F.get_json_object("metadata", f"$.{name}")
    scope = F.regexp_replace("id", r"^sym:|\.[^.]*\.[^.]*$", "")
    wanted = rpcs.select(F.explode(F.array(F.struct(F.lit("input").alias("role"), of("input_type").alias("type")), F.struct(F.lit("output").alias("role"), of("output_type").alias("type")))).alias("w"), scope.alias("scope")).select("w.role", "w.type", "scope")
    fields = nodes.where(F.col("metadata").contains('"field_number":')).select(F.regexp_replace("id", r"^sym:|\.[^.]*$", "").alias("message"), F.col("label").alias("field"), of("type").alias("of"), of("value_type").alias("value"), of("field_number").cast("int").alias("number"))
    fields = fields.withColumn("type", F.when(F.col("of") == "map", F.col("value")).otherwise(F.col("of"))).drop("value")
    out = None
    for level in range(1, depth + 1):
        parts = F.split("scope", r"\.")
        outward = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.concat_ws(".", F.when(n > 0, F.array_join(F.slice(parts, F.lit(1), n), ".")), F.col("type")))
        asked = wanted.withColumn("type", F.regexp_replace("type", r"^\.", "")).select("role", "type", F.posexplode(outward).alias("nth", "message"))
        hit = asked.join(fields.select("message").distinct(), "message").groupBy("role", "type").agg(F.min(F.struct("nth", "message")).alias("m")).select("role", F.col("m.message").alias("message")).distinct()
        now = hit.join(fields, "message").select("role", F.lit(level).alias("level"), "message", "field", F.col("of").alias("type"), "number", F.col("type").alias("__type"))
        out = now if out is None else out.unionByName(now)
        wanted = now.select("role", F.col("__type").alias("type"), F.col("message").alias("scope")).distinct()
    return out.drop("__type").groupBy("role", "message", "field", "type", "number").agg(F.min("level").alias("level")).orderBy("role", "level", "message", "number")
