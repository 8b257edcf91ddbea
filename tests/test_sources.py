"""Handlers, the file source, the index passes and the tools."""

import io
import zipfile

import pytest

from lorekeep.api import Config, Workspace
from lorekeep.plans import faq, report
from lorekeep.sources import code, config, markdown, office
from lorekeep.sources.files import IgnoreRules, default_registry, glob_regex, matches_glob, python_source_roots
from lorekeep.sources.handlers import parse
from lorekeep.sources.parsed import Unit, bold_signals, chunks_of, note_signals, paragraphs, signal_meta, tokens


def values(signals, kind):
    return [s.value for s in signals if s.kind == kind]


def test_bold_signals():
    for text in ("**Warning:** do not use", "**Warning**: do not use"):
        s = bold_signals(text)
        assert values(s, "label") == ["warning"] and '"has_warning":true' in signal_meta(s)
    assert values(bold_signals("This API is **deprecated** now"), "risk") == ["deprecated"]
    assert [(s.value, s.detail) for s in bold_signals("**Timeout:** 30s") if s.kind == "label-value"] == [("timeout", "30s")]
    assert bold_signals("*italic* only") == [] and signal_meta([]) == "{}"


def test_notes():
    s = note_signals("a TODO: fix\nWHY because\nnothing")
    assert [(x.kind, x.value, x.detail, x.line) for x in s] == [("todo", "todo", "fix", 1), ("rationale", "why", "because", 2)]


def test_chunks():
    assert [tokens(x) for x in ("", "x", "a b c")] == [0, 1, 4]
    long = "\n\n".join(" ".join(["w"] * 200) for _ in range(5))
    assert len(paragraphs(long, 512)) == 5 and paragraphs(" ".join(["w"] * 2000), 512) == [" ".join(["w"] * 2000)]
    units = [Unit("section", "A", "A", "\n".join(f"line {i} " + "w " * 20 for i in range(6)), hierarchy=["T", "A"]), Unit("section", "B", "B", "w " * 60, hierarchy=["T", "B"]), Unit("section", "C", "C", "short")]
    made = chunks_of("T", "", units)
    assert [c.index for c in made] == [0, 1] and made[0].embedding_text.startswith("Document: T | Section: T > A\n\nline 0")
    assert made[1].content.startswith("line 3") and "line 3" not in made[1].embedding_text
    assert chunks_of("T", "w " * 60, [])[0].embedding_text.startswith("Document: T\n\nw") and chunks_of("T", "few", []) == []


def test_tables_and_diagrams():
    assert markdown.linearized(["Method", "Endpoint", "Auth"], [["GET", "/a", ""], ["POST", "/b", "yes"]]).split("\n") == ["[Table: 3 columns, 2 rows — Method, Endpoint, Auth]", "Method: GET, Endpoint: /a", "Method: POST, Endpoint: /b, Auth: yes"]
    assert markdown.html_table("<table><tr><th>A</th></tr><tr><td>1</td><td>2</td></tr></table>").endswith("A: 1, Column 2: 2")
    assert markdown.diagram_kind("mermaid", "") == "mermaid" and markdown.diagram_kind("puml", "") == "plantuml" and markdown.diagram_kind("go", "+--+") is None
    assert markdown.diagram_kind("", "+-----+\n|  A  |\n+-----+\n| B   |\n+-----+") == "ascii"
    assert markdown.diagram_summary("mermaid", "classDiagram\nclass X[Some thing]") .startswith("[Diagram: mermaid class")


def test_markdown_sections():
    d = markdown.parse_markdown("x/y.md", b"---\ntitle: T\ntype: adr\n---\nintro text\n\n# One\n\na\n\n```\n# no heading\n```\n## Two\n\n### Empty\n\n# Three\nb\n")
    assert (d.title, d.doc_type, d.summary, d.headings) == ("T", "adr", "intro text", ["One", "Two", "Empty", "Three"])
    assert [u.hierarchy for u in d.units] == [["One"], ["Three"]]


def test_config_formats():
    y = config.parse_yaml("a.yaml", b"# TODO: x\na: 1\nb:\n  c: 2\n")
    assert [u.path for u in y.units] == ["a", "b"] and values(y.units[0].signals, "todo") == ["todo"]
    assert config.parse_yaml("a.yaml", b"a: [1").units[0].metadata["parse_error"] and config.parse_yaml("a.yaml", b"- 1").units[0].path == "a.yaml"
    assert [u.content for u in config.parse_json("a.json", b'{"b":1,"a":{"c":2}}').units] == ['"a": {\n  "c": 2\n}', '"b": 1']
    assert [u.path for u in config.parse_toml("a.toml", b"x = 1\n[a]\ny = true\n").units] == ["a", "x"]
    assert values(config.parse_xml("a.xml", b"<a><!-- TODO fix --></a>").signals, "todo") and values(config.parse_properties("a.properties", b"! NOTE x\na=TODO").signals, "rationale") == ["note"]
    assert config.buf_plugins({"plugins": [{"remote": "buf.build/protocolbuffers/go", "out": "gen"}, {"name": "es", "out": "web"}]}) == [{"lang": "go", "out": "gen", "plugin": "go"}, {"lang": "ts", "out": "web", "plugin": "es"}]


def test_statements():
    assert [s for _, s in config.statements("SELECT ';'; -- note\nSELECT \"a;b\", $t$ ; $t$;\n/* ; */ SELECT 3 -- end")] == ["SELECT ';';", '-- note\nSELECT "a;b", $t$ ; $t$;', "/* ; */ SELECT 3 -- end"]
    assert config.statements("-- only\n/* comments */") == []


def refs(doc, kind):
    return {(r.source, r.target) for r in doc.refs if r.kind == kind}


def test_extractors():
    go = code.parse_braces("a.go", b'package p\nimport "fmt"\ntype T struct {\n\t*Base\n}\nfunc (t *T) Run() { help() }\nfunc help() {}\n', code.LANGUAGES["go"])
    assert [u.path for u in go.units] == ["p.T", "p.T.Run", "p.help"] and refs(go, "call") == {("p.T.Run", "p.help")} and refs(go, "inherits") == {("p.T", "Base")}
    py = code.parse_python("pkg/m.py", b"from . import x\nfrom a.b import Base as B\nclass C(B, mod.D):\n    def f(self):\n        g()\ndef g():\n    def inner(): pass\n")
    assert [u.path for u in py.units] == ["m.C", "m.C.f", "m.g"] and refs(py, "inherits") == {("m.C", "a.b.Base"), ("m.C", "mod.D")} and ("pkg/m.py", "pkg.x") in refs(py, "import")
    java = code.parse_braces("A.java", b"package q;\nimport a.B;\nclass A extends B implements I {\n  @Override\n  public void run() {\n    this.walk();\n  }\n  void walk() {}\n}\n", code.LANGUAGES["java"])
    assert refs(java, "inherits") == {("q.A", "B"), ("q.A", "I")} and ("q.A.run", "q.A.walk") in refs(java, "call")
    proto = code.parse_proto("a.proto", b"package p; service S { rpc Go(In) returns (stream Out) {} } message In { repeated string a = 1; }")
    assert [(u.kind, u.path) for u in proto.units] == [("service", "p.S"), ("rpc", "p.S.Go"), ("message", "p.In"), ("field", "p.In.a")] and proto.units[1].metadata["server_streaming"]
    sql = code.parse_sql_definitions("a.sql", b"CREATE TABLE s.t (id int PRIMARY KEY, u int REFERENCES users(id) ON DELETE SET NULL);\nALTER TABLE s.t ADD CONSTRAINT x FOREIGN KEY (u) REFERENCES o.users;")
    assert refs(sql, "references") == {("s.t.u", "public.users.id"), ("s.t.u", "o.users")} and ("s.t", "s.t.id") in refs(sql, "contains")
    stub = code.parse_connect("a_connect.ts", b'export const S = {\n typeName: "p.S",\n methods: {\n  go: { name: "Go", I: A, O: B, kind: MethodKind.Unary },\n }\n};')
    assert [u.path for u in stub.units] == ["p.S.go"] and stub.units[0].metadata["streaming_kind"] == "Unary"
    assert code.connect_call_sites("const c = createClient(S, t);\nfunction load() {\n  return c.go({});\n}\nc.go({});\n", {"S": "p.S"}) == [("load", "p.S.Go")]
    assert code.dart_call_sites("a.dart", "class A {\n  final SClient c;\n  void load() {\n    c.go(x);\n  }\n}\n", {"SClient": {"go": "p.S.Go"}}) == [("a.A.load", "p.S.Go")]


def test_bodies():
    body = "BEGIN\n SELECT 1 FROM users u JOIN a.b ON true;\n INSERT INTO log VALUES ('FROM x');\n EXECUTE 'DELETE FROM past';\n CALL p(1);\nEND"
    got = {(r.target, r.metadata["op"], r.metadata.get("via_execute", False)) for r in code.body_references("public.f", body)}
    assert got == {("public.users", "read", False), ("a.b", "read", False), ("public.log", "write", False), ("public.past", "write", True), ("public.p", "procedure_call", False)}


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = archive({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>', "word/styles.xml": f'<w:styles {w}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>'})
    assert office.docx_markdown(doc) == "# Head\n\nBody\n\n| A |\n| --- |"
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = archive({"xl/workbook.xml": f'<workbook {s} {r}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>', "xl/sharedStrings.xml": f"<sst {s}><si><t>k</t></si></sst>", "xl/worksheets/s1.xml": f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2</v></c></row><row r="2"><c r="A2"><v>3</v></c></row></sheetData></worksheet>'})
    assert office.xlsx_markdown(book, most_rows=1).startswith("## One\n\n| k |  | 2 |") and "1 more rows" in office.xlsx_markdown(book, most_rows=1)
    assert parse("pdf", "a.pdf", b"")["error"].startswith("NotImplementedError") and parse("docx", "a.docx", b"no zip")["error"]


def test_ignore_rules_and_globs(spark):
    from pyspark.sql import functions as F

    rules = IgnoreRules()
    rules.add("", "*.log\n/build/\n!keep.log\n# c\n")
    rules.add("sub", "x/*.txt\n")
    paths = {"a.log": True, "d/a.log": True, "d/keep.log": False, "build/x": True, "d/build/x": False, "sub/x/a.txt": True, "x/a.txt": False}
    assert {p: rules.ignored(p) for p in paths} == paths
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["path"]: r["i"] for r in df.select("path", rules.column(F.col("path")).alias("i")).collect()} == paths
    hit = lambda p, g: spark.createDataFrame([(p,)], "path string").where(matches_glob(F.col("path"), g)).count() == 1
    assert hit("a/b.md", "a/*.md") and not hit("a/c/b.md", "a/*.md") and hit("x/gen/y.md", "**gen/") and glob_regex("a?b") == "^a[^/]b$"
    reg = default_registry()
    assert reg.handlers_for("x/A.SQL") == ["sql", "sql-ddl"] and reg.handler_for("Dockerfile.dev") == "dockerfile" and reg.handler_for("a.bin") is None
    assert python_source_roots('[tool.setuptools.packages.find]\nwhere = ["src"]\n[tool.poetry]\npackages = [{include = "a", from = "lib"}]') == ["src", "lib"]


def test_workspace(spark, tmp_path):
    root = tmp_path / "project"
    (root / "docs").mkdir(parents=True)
    (root / "pkg").mkdir()
    (root / "docs" / "auth.md").write_text("# Auth\n\nSee pkg/a.go here. **Warning:** careful.\n\n" + "login token session " * 40)
    (root / "docs" / "other.md").write_text("# Other\n\nUses pkg/a.go too.\n\n" + "banana apple pear " * 40)
    (root / "pkg" / "a.go").write_text("package auth\n\nfunc Login() { check() }\nfunc check() {}\n")
    (root / "pkg" / "a_test.go").write_text("package auth\n\nfunc TestLogin() { Login() }\n")
    (root / ".gitignore").write_text("skip.go\n")
    (root / "pkg" / "skip.go").write_text("package skip\nfunc No() {}\n")
    w = Workspace(spark, str(root), f"file://{tmp_path}/store", config=Config())
    first = w.index()
    assert first["documents"] == 2 and first["errors"] == 0 and w.index()["chunks"] == first["chunks"]
    assert w.search_docs("login session", 1, include_refs=True).first()["file_path"] == "auth.md"
    context = w.get_context("login session", 1)
    assert [r["file_path"] for r in context["related"].collect()] == ["other.md"] and context["code"].count() == 1
    assert {(r["from_node"], r["kind"]) for r in w.graph_neighbors("auth.Login", "in").collect()} == {("file:pkg/a.go", "contains"), ("sym:auth.TestLogin", "call")}
    assert w.graph_path("auth.Login", "auth.check").count() == 1 and w.list_documents("guide").count() == 2
    assert w.store.read("edges").where("kind = 'tests'").count() == 1 and w.store.read("nodes").where("label = 'No'").count() == 0
    path = w.capture_session("A note: on Things", "body " * 60, "notes")
    assert w.get_document(path).count() == 1 and w.status()["documents"] == 3
    with pytest.raises(ValueError):
        w.update_docs("../outside.md", "x")
    r = report.analyze(w.store.read("nodes"), w.store.read("edges"))
    assert r.god_nodes and "## God nodes" in report.to_markdown(r) and '"schema_version": 1' in report.to_json(r)
    page = report.to_html(r, [{"id": "a", "label": "<b>", "degree": 1, "community": 1}, {"id": "b", "label": "b", "degree": 1, "community": 2}], [("a", "b")])
    assert "&lt;b&gt;" in page and "<line" in page


def test_faq(spark):
    from lorekeep.functions.embed import HashEmbedder

    rows = [("1", "How do I log in?", ""), ("2", "how do i log in?", "Use the form."), ("3", "Add feature", "x"), ("4", "Why is it slow?", "Because.")]
    got = faq.entries(faq.questions_from(spark.createDataFrame(rows, "id string, title string, detail string")), HashEmbedder(32)).collect()
    assert {(r["slug"], r["answer"], r["n"]) for r in got} == {("how-do-i-log-in", "Use the form.", 2), ("why-is-it-slow", "Because.", 1)}
    text = faq.as_markdown(spark.createDataFrame([("s", 'Say "x"?', "a", 1)], "slug string, question string, answer string, n int")).first()["content"]
    assert text.startswith('---\ntitle: "Say \\"x\\"?"\n')


def test_streams(spark, tmp_path):
    from lorekeep.operators.store import Store
    from lorekeep.streaming import incremental

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("one")
    store = Store(spark, f"file://{tmp_path}/store")
    make = lambda b: {"t": (b.selectExpr("path", "length"), ["path"])}
    for _ in range(2):
        incremental.index_incrementally(incremental.follow_files(spark, str(src)), store, make, f"{tmp_path}/ck").awaitTermination()
        (src / "b.txt").write_text("three")
    assert store.read("t").count() == 2
    spark.sql("SELECT CAST(id AS LONG) AS event_id, TIMESTAMP '2024-01-01' + make_interval(0,0,0,0,0,CAST(id AS INT),0) AS ts, id % 2 AS user_id, 'click' AS event_type FROM range(20)").coalesce(1).write.parquet(f"{tmp_path}/ev")
    for f in (incremental.tumbling, incremental.sliding, incremental.sessions, incremental.distinct_events):
        q = f(incremental.event_stream(spark, f"{tmp_path}/ev")).writeStream.format("memory").queryName(f.__name__).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("distinct_events").count() == 20
    assert spark.table("tumbling").count() == 1  # windows that the watermark has passed


PROTO = """syntax = "proto3";
package auth.v1;
service AuthService { rpc Login(LoginRequest) returns (stream Reply) {} rpc Logout(LoginRequest) returns (Reply) {} }
message LoginRequest { string name = 1; Device device = 2; }
message Device { string id = 1; }
message Reply { bool ok = 1; }
"""
STUB = """export const AuthService = {
  typeName: "auth.v1.AuthService",
  methods: {
    login: { name: "Login", I: LoginRequest, O: Reply, kind: MethodKind.ServerStreaming },
  }
};
"""
CALLER = """import { AuthService } from "./auth_connect";
import { thing } from "./thing";
const client = createClient(AuthService, transport);
export function signIn() {
  return client.login({});
}
"""


def test_calls_of_rpcs_traces_and_the_command_line(spark, tmp_path):
    import io as text_io
    import json

    from lorekeep.__main__ import main

    root = tmp_path / "project"
    (root / "docs").mkdir(parents=True)
    (root / "docs" / "a.md").write_text("# Sign in\n\n" + "login token session " * 40)
    for name, text in {"auth.proto": PROTO, "auth_connect.ts": STUB, "page.ts": CALLER, "thing.ts": "export function thing() {}\n"}.items():
        (root / name).write_text(text)
    w = Workspace(spark, str(root), f"file://{tmp_path}/store")
    assert w.index()["errors"] == 0
    edges = {(r["from_node"], r["to_node"], r["kind"]) for r in w.store.read("edges").collect()}
    assert ("sym:page.signIn", "sym:auth.v1.AuthService.Login", "call_rpc") in edges and ("file:page.ts", "file:thing.ts", "import") in edges
    made = json.loads(w.trace_rpc("AuthService.Login", "json"))
    assert made["definition"]["kind"] == "server streaming" and made["definition"]["package"] == "auth.v1" and made["definition"]["line"] == 3
    assert [(f["role"], f["message"], f["field"]) for f in made["definition"]["fields"]] == [("input", "auth.v1.LoginRequest", "name"), ("input", "auth.v1.LoginRequest", "device"), ("input", "auth.v1.Device", "id"), ("output", "auth.v1.Reply", "ok")]
    assert [r["symbol"] for r in made["direct_callers"]] == ["page.signIn"] and [r["symbol"] for r in made["related"]] == ["auth.v1.AuthService.Logout"]
    assert "## Callers of the rpc" in w.trace_rpc("auth.proto:Login", "markdown")
    with pytest.raises(ValueError):
        w.trace_rpc("Login", "xml")
    out = text_io.StringIO()
    at = ["--root", str(root), "--store", f"file://{tmp_path}/store", "--json"]
    assert main([*at, "status"], spark, out) == 0 and "documents\t1" in out.getvalue()
    assert main([*at, "search", "login session", "--limit", "1"], spark, out) == 0 and '"file_path": "a.md"' in out.getvalue()
    assert main([*at, "neighbors", "page.signIn", "--kind", "call_rpc"], spark, out) == 0 and main([*at, "trace", "nothing"], spark, out) == 1


def test_only_changed_files_are_parsed_and_models_are_guarded(spark, tmp_path):
    from lorekeep.functions.embed import HashEmbedder
    from lorekeep.plans import index as I
    from lorekeep.sources.files import scan, walk

    class Short:
        def summarize(self, text):
            return "short: " + text[:9]

    root = tmp_path / "project"
    (root / "docs").mkdir(parents=True)
    for name in "ab":
        (root / "docs" / f"{name}.md").write_text(f"# {name}\n\n" + f"{name}word other token " * 40)
    w = Workspace(spark, str(root), f"file://{tmp_path}/store", summarizer=Short())
    w.index()
    assert {r["summary"] for r in w.store.read("chunks").collect()} == {"short: Document:"}
    files = lambda: walk(scan(spark, f"{root}/docs"), default_registry())
    assert I.still_parsed(files(), w.store.read("parsed_docs"))[0].count() == 0
    (root / "docs" / "a.md").write_text("# a\n\n" + "changed text token " * 40)
    (root / "docs" / "b.md").unlink()
    fresh, kept = I.still_parsed(files(), w.store.read("parsed_docs"))
    assert [r["path"] for r in fresh.collect()] == ["a.md"] and kept.count() == 0
    assert w.index()["documents"] == 1 and w.search_docs("changed", 1).first()["file_path"] == "a.md"
    other = Workspace(spark, str(root), f"file://{tmp_path}/store", embedder=HashEmbedder(16))
    with pytest.raises(ValueError):
        other.index()
    assert other.reindex()["documents"] == 1 and len(other.store.read("chunks").first()["embedding"]) == 16


def test_questions_of_a_log_and_of_issues_become_documents(spark, tmp_path):
    root = tmp_path / "project"
    (root / "docs").mkdir(parents=True)
    (tmp_path / "log.txt").write_text("h1\x1fHow do I sign in?\x1fUse the form on the first page.\x1eh2\x1fAdd a feature\x1fNone.\x1e")
    (tmp_path / "issues.json").write_text('[{"id": "i1", "title": "Why is it slow?", "description": "d", "status": "closed", "close_reason": "Because of the cache."}, {"id": "i2", "title": "What now?", "description": "open one", "status": "open", "close_reason": ""}]')
    w = Workspace(spark, str(root), f"file://{tmp_path}/store")
    assert w.write_questions(str(tmp_path / "log.txt"), str(tmp_path / "issues.json")) == 2
    assert sorted(p.name for p in (root / "docs" / "faq").iterdir()) == ["how-do-i-sign-in.md", "why-is-it-slow.md"]


def test_the_rest_lives_without_the_training_data_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(here, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    code_ = "import __spark_entry__ as e; n = set(e.queries()); assert 'hybrid_search' in n and 'pipeline' not in n and not any(x.startswith('op1') for x in n), n; assert set(e.oracle_sql()) <= n; import lorekeep.api, lorekeep.__main__, tests.test_oracle"
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (copy / name).unlink()
        done = subprocess.run([sys.executable, "-c", code_], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
