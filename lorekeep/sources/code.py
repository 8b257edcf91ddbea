"""Symbols, imports, parents and calls of source files.

Python is read with its own parser; the other languages by line rules and nesting of braces, with strings and comments
blanked first. A symbol's path is the file's title (its package, else its stem), the names around it, and its own.
"""

from __future__ import annotations

import ast
import posixpath
import re
from dataclasses import dataclass, field

from lorekeep.sources.parsed import Parsed, Reference, Signal, Unit, note_signals

CLASS_LIKE = frozenset("class interface struct enum trait record object protocol extension mixin module type message service annotation".split())


@dataclass
class Rule:
    kind: str
    pattern: str


@dataclass
class Language:
    name: str
    rules: list[Rule]
    package: str = ""
    imports: list[str] = field(default_factory=list)
    parents: list[tuple[str, str]] = field(default_factory=list)
    calls: bool = False
    line_comment: str = "//"
    block_comment: tuple[str, str] | None = ("/*", "*/")
    quotes: str = "\"'`"
    ends: str = ""  # a language whose blocks end with a word


ID = r"[A-Za-z_$][\w$]*"
MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|async|export|default|declare|readonly|const|inline|suspend|data|companion|fileprivate|mutating|unsafe|pub(?:\([^)]*\))?|extern|virtual|synchronized|native|external|late|factory|base|non-sealed|inner|value|fun(?=\s+interface)|lateinit|indirect|final|required|convenience|class(?=\s+func))\s+)*"

#: How the languages declare symbols, parents and imports.
LANGUAGES: dict[str, Language] = {
    "go": Language(
        "go",
        [Rule("method", rf"^func\s*\(\s*(?:\w+\s+)?\*?(?P<recv>{ID})(?:\[[^\]]*\])?\s*\)\s*(?P<name>{ID})"), Rule("function", rf"^func\s+(?P<name>{ID})"), Rule("interface", rf"^(?:type\s+|\t)(?P<name>{ID})(?:\[[^\]]*\])?\s+interface\b"), Rule("struct", rf"^(?:type\s+|\t)(?P<name>{ID})(?:\[[^\]]*\])?\s+struct\b"), Rule("type", rf"^type\s+(?P<name>{ID})\s*=?\s*[\w\[\]*.(]")],
        package=r"(?m)^package\s+(\w+)", imports=[r"(?m)^import\s+(?:(?P<alias>[\w.]+)\s+)?\"(?P<target>[^\"]+)\""], calls=True,
    ),
    "java": Language(
        "java",
        [Rule("class", rf"^\s*{MODS}class\s+(?P<name>{ID})"), Rule("interface", rf"^\s*{MODS}@?interface\s+(?P<name>{ID})"), Rule("enum", rf"^\s*{MODS}enum\s+(?P<name>{ID})"), Rule("record", rf"^\s*{MODS}record\s+(?P<name>{ID})\s*[(<]"), Rule("method", rf"^\s*{MODS}(?:<[^>]+>\s+)?(?!return\b|new\b|else\b|throw\b)[\w<>\[\],.?& ]+\s+(?P<name>{ID})\s*\([^;=]*$"), Rule("constructor", rf"^\s*{MODS}(?P<name>[A-Z]\w*)\s*\([^;]*\)\s*(?:throws[^{{]+)?\{{"), Rule("field", rf"^\s*{MODS}(?!return\b|throw\b|package\b|import\b)[\w<>\[\],.?]+\s+(?P<name>{ID})\s*(?:=[^=].*)?;")],
        package=r"(?m)^\s*package\s+([\w.]+)\s*;", imports=[r"(?m)^\s*import\s+(?P<static>static\s+)?(?P<target>[\w.*]+)\s*;"], parents=[("extends", r"\bextends\s+([\w.<>, ]+?)(?=\s+implements\b|\s+permits\b|\s*\{|$)"), ("implements", r"\bimplements\s+([\w.<>, ]+?)(?=\s+permits\b|\s*\{|$)")], calls=True,
    ),
    "javascript": Language(
        "javascript",
        [Rule("class", rf"^\s*{MODS}class\s+(?P<name>{ID})"), Rule("interface", rf"^\s*{MODS}interface\s+(?P<name>{ID})"), Rule("enum", rf"^\s*{MODS}enum\s+(?P<name>{ID})"), Rule("type", rf"^\s*{MODS}type\s+(?P<name>{ID})(?:<[^=]*>)?\s*="), Rule("function", rf"^\s*{MODS}function\s*\*?\s*(?P<name>{ID})"), Rule("function", rf"^\s*{MODS}(?:const|let|var)?\s*(?P<name>{ID})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{ID})\s*(?::[^=]+)?=>"), Rule("method", rf"^\s+{MODS}(?:get\s+|set\s+|\*\s*)?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|constructor\b)#?(?P<name>{ID})\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^{{;]+)?\{{"), Rule("constructor", r"^\s+(?P<name>constructor)\s*\(")],
        imports=[r"(?m)^\s*(?:import|export)\s+(?:type\s+)?(?:[^'\";]*?\s+from\s+)?['\"](?P<target>[^'\"]+)['\"]", r"\brequire\(\s*['\"](?P<target>[^'\"]+)['\"]\s*\)"], parents=[("extends", r"\bextends\s+([\w.<>, ()$]+?)(?=\s+implements\b|\s*\{|$)"), ("implements", r"\bimplements\s+([\w.<>, $]+?)(?=\s*\{|$)")],
    ),
    "kotlin": Language(
        "kotlin",
        [Rule("interface", rf"^\s*{MODS}interface\s+(?P<name>{ID})"), Rule("enum", rf"^\s*{MODS}enum\s+class\s+(?P<name>{ID})"), Rule("annotation", rf"^\s*{MODS}annotation\s+class\s+(?P<name>{ID})"), Rule("class", rf"^\s*{MODS}class\s+(?P<name>{ID})"), Rule("object", rf"^\s*{MODS}object\s+(?P<name>{ID})"), Rule("type", rf"^\s*{MODS}typealias\s+(?P<name>{ID})"), Rule("function", rf"^\s*{MODS}(?:operator\s+|infix\s+|tailrec\s+)*fun\s+(?:<[^>]+>\s*)?(?:(?P<recv>{ID})(?:<[^>]*>)?\??\.)?(?P<name>{ID})"), Rule("property", rf"^\s*{MODS}va[lr]\s+(?P<name>{ID})")],
        package=r"(?m)^\s*package\s+([\w.]+)", imports=[r"(?m)^\s*import\s+(?P<target>[\w.*]+)(?:\s+as\s+(?P<alias>\w+))?"], parents=[("extends", r"(?:class|object|interface)\s+\w+(?:<[^>]*>)?(?:\s*(?:@?\w+\s+)*(?:constructor)?\([^)]*\))?\s*:\s*([^{]+)")],
    ),
    "swift": Language(
        "swift",
        [Rule("protocol", rf"^\s*{MODS}protocol\s+(?P<name>{ID})"), Rule("struct", rf"^\s*{MODS}struct\s+(?P<name>{ID})"), Rule("enum", rf"^\s*{MODS}enum\s+(?P<name>{ID})"), Rule("extension", rf"^\s*{MODS}extension\s+(?P<name>[\w.]+)"), Rule("class", rf"^\s*{MODS}(?:class|actor)\s+(?!func\b|var\b)(?P<name>{ID})"), Rule("type", rf"^\s*{MODS}typealias\s+(?P<name>{ID})"), Rule("function", rf"^\s*{MODS}func\s+(?P<name>{ID})"), Rule("constructor", rf"^\s*{MODS}(?P<name>init)\s*[?!]?\(")],
        imports=[r"(?m)^\s*(?:@testable\s+)?import\s+(?:(?:class|struct|enum|protocol|func|var)\s+)?(?P<target>[\w.]+)"], parents=[("conforms", r"(?:class|struct|enum|extension|protocol|actor)\s+[\w.]+(?:<[^>]*>)?\s*:\s*([^{]+?)(?=\s+where\b|\s*\{|$)")],
    ),
    "dart": Language(
        "dart",
        [Rule("mixin", rf"^\s*{MODS}mixin\s+(?:class\s+)?(?P<name>{ID})"), Rule("extension", rf"^\s*extension\s+(?:type\s+)?(?P<name>{ID})\s"), Rule("enum", rf"^\s*enum\s+(?P<name>{ID})"), Rule("class", rf"^\s*{MODS}(?:interface\s+)?class\s+(?P<name>{ID})"), Rule("type", rf"^\s*typedef\s+(?P<name>{ID})\s*[=<]"), Rule("function", rf"^\s*{MODS}(?!return\b|else\b|throw\b|new\b|await\b)(?:[\w<>?,. ]+\s+)(?:get\s+|set\s+)?(?P<name>{ID})\s*(?:<[^>]*>)?\([^;]*$")],
        imports=[r"(?m)^\s*(?:import|export)\s+['\"](?P<target>[^'\"]+)['\"](?:\s+as\s+(?P<alias>\w+))?", r"(?m)^\s*part\s+(?:of\s+)?['\"]?(?P<part>[^'\";]+)['\"]?\s*;"], parents=[("extends", r"\bextends\s+([\w.<>, ]+?)(?=\s+with\b|\s+implements\b|\s*\{|$)"), ("implements", r"\bimplements\s+([\w.<>, ]+?)(?=\s*\{|$)"), ("mixes", r"\bwith\s+([\w.<>, ]+?)(?=\s+implements\b|\s*\{|$)"), ("requires", r"mixin\s+\w+(?:<[^>]*>)?\s+on\s+([\w.<>, ]+?)(?=\s+implements\b|\s*\{|$)")],
    ),
    "rust": Language(
        "rust",
        [Rule("trait", rf"^\s*{MODS}trait\s+(?P<name>{ID})"), Rule("struct", rf"^\s*{MODS}struct\s+(?P<name>{ID})"), Rule("enum", rf"^\s*{MODS}enum\s+(?P<name>{ID})"), Rule("module", rf"^\s*{MODS}mod\s+(?P<name>{ID})"), Rule("impl", rf"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>{ID})"), Rule("type", rf"^\s*{MODS}type\s+(?P<name>{ID})"), Rule("function", rf"^\s*{MODS}(?:const\s+)?fn\s+(?P<name>{ID})"), Rule("macro", rf"^\s*macro_rules!\s+(?P<name>{ID})")],
        imports=[r"(?m)^\s*(?:pub\s+)?use\s+(?P<target>[^;]+);"], parents=[("extends", r"trait\s+\w+(?:<[^>]*>)?\s*:\s*([^{]+?)(?=\s+where\b|\s*\{|$)"), ("implements", r"impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s")], quotes='"',
    ),
    "ruby": Language(
        "ruby",
        [Rule("class", r"^\s*class\s+(?P<name>[A-Z][\w:]*)"), Rule("module", r"^\s*module\s+(?P<name>[A-Z][\w:]*)"), Rule("function", r"^\s*def\s+(?:self\.)?(?P<name>[\w?!=]+|[+\-*/<>=\[\]]+)"), Rule("attribute", r"^\s*attr_(?:reader|writer|accessor)\s+(?P<names>.+)$")],
        imports=[r"(?m)^\s*require(?:_relative)?\s*\(?\s*['\"](?P<target>[^'\"]+)['\"]"], parents=[("extends", r"class\s+[\w:]+\s*<\s*([\w:]+)")], line_comment="#", block_comment=("\n=begin", "\n=end"), quotes="\"'", ends="end",
    ),
}

#: Words that look like calls and are none.
NO_CALLS = frozenset("if for while switch catch return func function new super this throw else case defer go select range make len cap append panic print println string int synchronized assert try".split())


ANNOTATION = re.compile(r"^(?=\s*@)\s*(?:@(?!interface\b)[\w.]+(?:\([^)]*\))?\s+)+")


def blanked(text: str, lang: Language) -> str:
    """The text with strings and comments as spaces, line ends kept."""
    start, end = lang.block_comment or ("\0", "\0")
    quoted = "|".join(rf"{q}(?:\\.|[^{q}\\\n])*{q}" if q != "`" else r"`[^`]*`" for q in lang.quotes)
    pattern = re.compile(rf"{re.escape(lang.line_comment)}[^\n]*|{re.escape(start)}.*?(?:{re.escape(end)}|\Z)|{quoted}", re.S)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def blanked_comments(text: str, lang: Language) -> str:
    start, end = lang.block_comment or ("\0", "\0")
    return re.sub(rf"{re.escape(lang.line_comment)}[^\n]*|{re.escape(start)}.*?(?:{re.escape(end)}|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def comment_above(lines: list[str], at: int, lang: Language) -> str:
    """The comment lines that end right above line ``at``, without their marks."""
    out, i = [], at - 1
    while i >= 0 and (s := lines[i].strip()) and (s.startswith((lang.line_comment, "/*", "*", "@", "#[")) or s.endswith("*/")):
        out.append(re.sub(r"^(?://+!?|/\*+|\*+/?|#+)\s?|\*+/$", "", s).strip())
        i -= 1
    return "\n".join(x for x in out[::-1] if x)


def split_names(text: str) -> list[tuple[str, str]]:
    """(name, type arguments) of a list at its outer commas."""
    out, depth, held = [], 0, ""
    for c in text + ",":
        if c == "," and not depth:
            name = held.strip()
            if name:
                m = re.match(r"([\w.:$]+)\s*(?:<(.*)>)?", name, re.S)
                if m:
                    out.append((m[1], (m[2] or "").strip()))
            held = ""
            continue
        depth += (c in "<([") - (c in ">)]")
        held += c
    return out


def module_title(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", posixpath.basename(path))


def parse_braces(path: str, data: bytes, lang: Language) -> Parsed:
    text = data.decode("utf-8", "replace").replace("\r\n", "\n")
    code, bare = blanked(text, lang), blanked_comments(text, lang)
    m = re.search(lang.package, code) if lang.package else None
    package = m[1] if m else ""
    doc = Parsed(path, lang.name, package or module_title(path), "code", text, metadata={"package": package})
    comments = [re.sub(r"^\W+", "", a) for a, b in zip(text.split("\n"), code.split("\n")) if a != b and lang.line_comment in a]
    doc.signals = note_signals("\n".join(comments))
    lines, clean = text.split("\n"), code.split("\n")
    rules = [(r.kind, re.compile(r.pattern)) for r in lang.rules]
    inside: list[tuple[str, str, int]] = []  # names around, with kind and last line
    by_name: dict[str, list[str]] = {}
    spans: list[tuple[int, int, Unit]] = []
    for i, line in enumerate(clean):
        around = [(n, k) for n, k, _ in inside]
        # what stands in a function's body is no symbol
        if not any(k in ("function", "method", "constructor") for _, k in around):
            for kind, pattern in rules:
                hit = pattern.match(ANNOTATION.sub("", line) if lang.name in ("java", "kotlin", "dart") else line)
                if not hit:
                    continue
                if "names" in hit.groupdict():
                    for name in re.findall(r":(\w+)", hit["names"]):
                        doc.units.append(Unit("property", ".".join([doc.title, *(n for n, _ in around), name]), name, line.strip(), i + 1))
                    break
                name, receiver = hit["name"], hit.groupdict().get("recv")
                holder = any(k in CLASS_LIKE or k == "impl" for _, k in around)
                if kind == "function" and (holder or receiver):
                    kind = "method"
                if kind in ("method", "field", "property", "constructor") and lang.name in ("java", "javascript") and not holder and not receiver:
                    break
                names = [*(n for n, _ in around), *([receiver] if receiver else []), name]
                end = block_end(clean, i, lang)
                if kind != "impl":
                    above = comment_above(lines, i, lang)
                    body = "\n".join(lines[i : end + 1])
                    unit = Unit(kind, ".".join([doc.title, *names]), name, f"{above}\n\n{body}" if above else body, i + 1, note_signals(above))
                    if "@deprecated" in above.lower() or "@Deprecated" in above:
                        unit.signals.append(Signal("risk", "deprecated"))
                    doc.units.append(unit)
                    by_name.setdefault(name, []).append(unit.path)
                    spans.append((i, end, unit))
                near = line if lang.ends else " ".join(clean[i : min(end, i + 6) + 1])
                head = near.split("{")[0] + ("{" if "{" in near else "")
                owner = ".".join([doc.title, *names])
                for relation, parents in lang.parents:
                    for p in re.finditer(parents, head):
                        for parent, args in split_names(p[1].replace("&", ",").replace("+", ",")):
                            doc.refs.append(Reference("requires" if relation == "requires" else "inherits", owner, parent, lines[i].strip(), i + 1, {"relation": relation} | ({"type_args": args} if args else {})))
                if end > i and (kind in CLASS_LIKE or kind in ("function", "method", "constructor", "impl")):
                    inside.append((name, kind, end))
                if lang.name == "go" and kind in ("struct", "interface"):
                    for k in range(i + 1, end):
                        e = re.match(rf"^\s*(\*?)((?:\w+\.)?[A-Z]\w*)\s*$", clean[k])
                        if e:
                            doc.refs.append(Reference("inherits", owner, e[2].split(".")[-1], lines[k].strip(), k + 1, {"relation": "embeds"} | ({"pointer": True} if e[1] else {})))
                break
        inside = [x for x in inside if x[2] > i]
    for pattern in lang.imports:
        for hit in re.finditer(pattern, bare):
            g = hit.groupdict()
            line = bare.count("\n", 0, hit.start()) + 1
            if g.get("part"):
                doc.refs.append(Reference("part", path, g["part"].strip(), hit[0].strip(), line))
            elif g.get("target"):
                doc.refs.append(Reference("import", path, g["target"].strip(), hit[0].strip(), line, {k: (True if k == "static" else v) for k, v in g.items() if k in ("alias", "static") and v}))
    if lang.name == "go":
        for block in re.finditer(r"(?ms)^import\s*\((.*?)^\)", bare):
            for hit in re.finditer(r"(?m)^\s*(?:([\w.]+)\s+)?\"([^\"]+)\"", block[1]):
                doc.refs.append(Reference("import", path, hit[2], hit[0].strip(), bare.count("\n", 0, block.start(1) + hit.start()) + 1, {"alias": hit[1]} if hit[1] else {}))
    if lang.calls:
        for a, b, unit in spans:
            if unit.kind in ("function", "method", "constructor"):
                called = re.findall(rf"(?:^|[^\w$])(?:[\w$\])]+\.)*({ID})\s*\(", "\n".join(clean[a : b + 1]).split("{", 1)[-1])
                doc.refs += call_references(unit.path, called, by_name)
    return doc


def call_references(caller: str, called: list[str], by_name: dict[str, list[str]]) -> list[Reference]:
    """A call to a name that the file defines once is resolved, more often ambiguous, else unresolved."""
    out = []
    for name in dict.fromkeys(called):
        if name in NO_CALLS:
            continue
        hits = by_name.get(name, [])
        confidence = "resolved" if len(hits) == 1 else "ambiguous" if hits else "unresolved"
        out.append(Reference("call", caller, hits[0] if len(hits) == 1 else name, metadata={"confidence": confidence}))
    return out


def block_end(lines: list[str], start: int, lang: Language) -> int:
    """The last line of the block that begins at ``start``."""
    if lang.ends:
        indent = len(lines[start]) - len(lines[start].lstrip())
        for i in range(start + 1, len(lines)):
            if lines[i].strip() == lang.ends and len(lines[i]) - len(lines[i].lstrip()) <= indent:
                return i
        return start
    depth, seen = 0, False
    for i in range(start, len(lines)):
        for c in lines[i]:
            if c == "{":
                depth, seen = depth + 1, True
            elif c == "}":
                depth -= 1
                if seen and depth <= 0:
                    return i
            elif c == ";" and not seen:
                return i
        if not seen and i > start + 6:
            return start
    return len(lines) - 1 if seen else start


# --- Python ---


def parse_python(path: str, data: bytes) -> Parsed:
    text = data.decode("utf-8", "replace")
    title = module_title(path)
    doc = Parsed(path, "python", title, "code", text, metadata={"package": ""})
    doc.signals = note_signals("\n".join(m[1] for m in re.finditer(r"(?m)#\s?(.*)$", text)))
    tree = ast.parse(text)
    lines = text.split("\n")
    bindings: dict[str, str] = {}
    by_name: dict[str, list[str]] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                bindings[a.asname or a.name.split(".")[0]] = a.name
                doc.refs.append(Reference("import", path, a.name, lines[node.lineno - 1].strip(), node.lineno, {"alias": a.asname} if a.asname else {}))
        elif isinstance(node, ast.ImportFrom):
            module = resolve_relative(path, node.level, node.module or "")
            for a in node.names:
                target = f"{module}.{a.name}" if module else a.name
                if a.name != "*":
                    bindings[a.asname or a.name] = target
                doc.refs.append(Reference("import", path, target, lines[node.lineno - 1].strip(), node.lineno, {"alias": a.asname} if a.asname else {}))

    def dotted(n: ast.expr) -> str:
        return n.id if isinstance(n, ast.Name) else f"{dotted(n.value)}.{n.attr}" if isinstance(n, ast.Attribute) and dotted(n.value) else ""

    def base(owner: str, b: ast.expr) -> Reference:
        meta: dict = {"relation": "extends"}
        if isinstance(b, ast.Subscript):
            args = b.slice.elts if isinstance(b.slice, ast.Tuple) else [b.slice]
            meta["type_args"] = [ast.unparse(x) for x in args]
            b = b.value
        if isinstance(b, ast.Call):
            return Reference("base_factory", owner, ast.unparse(b.func), line=b.lineno, metadata=meta | {"unresolved_expression": ast.unparse(b)})
        name = dotted(b)
        if "." in name:
            head, _, rest = name.partition(".")
            return Reference("inherits", owner, f"{bindings.get(head, head)}.{rest}", line=b.lineno, metadata=meta | {"qualified_name": name})
        if name in ("NamedTuple", "TypedDict"):
            return Reference("inherits", owner, bindings.get(name, name), line=b.lineno, metadata=meta | {"node_kind": "external"})
        if name in bindings:
            return Reference("inherits", owner, bindings[name], line=b.lineno, metadata=meta)
        return Reference("inherits", owner, name, line=b.lineno, metadata=meta | {"unresolved": True})

    callers: list[tuple[str, ast.AST]] = []

    def visit(body: list[ast.stmt], names: list[str], in_class: bool) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if in_class else "function"
                dotted_path = ".".join([title, *names, n.name])
                first = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                above = "\n".join(ast.unparse(d) for d in n.decorator_list)
                note = ast.get_docstring(n) or ""
                head = "\n".join(filter(None, (above, note)))
                content = "\n".join(lines[n.lineno - 1 : n.end_lineno])
                unit = Unit(kind, dotted_path, n.name, f"{head}\n\n{content}" if head else content, first, note_signals(head))
                if any("deprecated" in ast.unparse(d) for d in n.decorator_list):
                    unit.signals.append(Signal("risk", "deprecated"))
                doc.units.append(unit)
                by_name.setdefault(n.name, []).append(dotted_path)
                if isinstance(n, ast.ClassDef):
                    doc.refs.extend(base(dotted_path, b) for b in n.bases)
                    visit(n.body, [*names, n.name], True)
                else:
                    callers.append((dotted_path, n))
            elif isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name) and ast.unparse(n.annotation).endswith("TypeAlias") or isinstance(n, getattr(ast, "TypeAlias", ())):
                name = n.target.id if isinstance(n, ast.AnnAssign) else n.name.id
                doc.units.append(Unit("type", ".".join([title, *names, name]), name, "\n".join(lines[n.lineno - 1 : n.end_lineno]), n.lineno))
            elif isinstance(n, (ast.If, ast.Try)) and not names:
                visit([*n.body, *n.orelse], names, in_class)

    visit(tree.body, [], False)
    doc.metadata["type_variables"] = [t.id for n in tree.body if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and dotted(n.value.func).split(".")[-1] in ("TypeVar", "ParamSpec", "TypeVarTuple") for t in n.targets if isinstance(t, ast.Name)]
    for caller, node in callers:
        called = [c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))]
        doc.refs += call_references(caller, called, by_name)
    return doc


def resolve_relative(path: str, level: int, module: str) -> str:
    """The dotted module that leading dots mean, from the file's folder."""
    if not level:
        return module
    folder = [p for p in posixpath.dirname(path).split("/") if p]
    return ".".join([*folder[: len(folder) - level + 1], *([module] if module else [])])


# --- protocol buffers ---

PROTO_TOKEN = re.compile(r"\"(?:\\.|[^\"])*\"|'(?:\\.|[^'])*'|[A-Za-z_][\w.]*|\d+|[{}()<>=;,\[\]]|[^\s]")


def parse_proto(path: str, data: bytes) -> Parsed:
    text = data.decode("utf-8", "replace")
    lang = LANGUAGES["java"]
    clean = blanked_comments(text, lang)
    package = m[1] if (m := re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", clean)) else ""
    doc = Parsed(path, "proto", package or module_title(path), "code", text, metadata={"package": package, "options": dict(re.findall(r"(?m)^\s*option\s+(\w+)\s*=\s*\"([^\"]*)\"\s*;", clean))})
    doc.signals = note_signals("\n".join(re.findall(r"//\s?(.*)", text)))
    for m in re.finditer(r"(?m)^\s*import\s+(public\s+|weak\s+)?\"([^\"]+)\"\s*;", clean):
        doc.refs.append(Reference("import", path, m[2], m[0].strip(), clean.count("\n", 0, m.start()) + 1, {m[1].strip(): True} if m[1] else {}))
    lines = text.split("\n")
    tokens = [(m[0], clean.count("\n", 0, m.start()) + 1) for m in PROTO_TOKEN.finditer(clean)]
    stack: list[tuple[str, str]] = []

    def add(kind: str, name: str, line: int, meta: dict | None = None, until: int | None = None) -> None:
        above = comment_above(lines, line - 1, lang)
        body = "\n".join(lines[line - 1 : until or line])
        unit = Unit(kind, ".".join([doc.title, *(n for _, n in stack if n), name]), name, f"{above}\n\n{body}" if above else body, line, note_signals(above), meta or {})
        if re.search(r"deprecated\s*=\s*true", body):
            unit.signals.append(Signal("risk", "deprecated"))
        doc.units.append(unit)

    i = 0
    while i < len(tokens):
        word, line = tokens[i]
        ahead = [t for t, _ in tokens[i : i + 24]]
        if word in ("message", "service", "enum", "oneof", "extend") and i + 2 < len(tokens) and tokens[i + 2][0] == "{":
            name = tokens[i + 1][0]
            if word == "extend":
                doc.refs.append(Reference("inherits", path, name, lines[line - 1].strip(), line, {"relation": "extends"}))
                stack.append((word, ""))
            else:
                add(word, name, line)
                stack.append((word, name if word != "oneof" else ""))
            if word == "oneof":
                stack[-1] = ("oneof", "")
            i += 3
        elif word == "rpc" and stack and stack[-1][0] == "service":
            m = re.match(r"rpc (\w+) \( (stream )?([\w.]+) \) returns \( (stream )?([\w.]+) \)", " ".join(ahead))
            if m:
                add("rpc", m[1], line, {"input_type": m[3], "output_type": m[5], "client_streaming": bool(m[2]), "server_streaming": bool(m[4])})
                i += len(m[0].split())
                if i < len(tokens) and tokens[i][0] == "{":
                    stack.append(("options", ""))
                    i += 1
            else:
                i += 1
        elif word == "}":
            if stack:
                stack.pop()
            i += 1
        elif word == "{":
            stack.append(("block", ""))
            i += 1
        elif stack and stack[-1][0] in ("message", "oneof", "extend") and (m := re.match(r"(?:(repeated|optional|required) )?(?:map < ([\w.]+) , ([\w.]+) >|([\w.]+)) (\w+) = (\d+)", " ".join(ahead))) and word not in ("option", "reserved", "extensions"):
            meta = {"field_number": int(m[6]), "type": m[4] or "map"} | ({"repeated": True} if m[1] == "repeated" else {}) | ({"key_type": m[2], "value_type": m[3]} if m[2] else {}) | ({"oneof": True} if stack[-1][0] == "oneof" else {})
            add("field", m[5], line, meta)
            while i < len(tokens) and tokens[i][0] != ";":
                i += 1
            i += 1
        else:
            i += 1
    return doc


# --- SQL definitions ---

NAME = r"(?:\"[^\"]+\"|\w+)(?:\s*\.\s*(?:\"[^\"]+\"|\w+))*"


def sql_name(text: str) -> str:
    parts = [p.strip().strip('"') for p in text.split(".")]
    return ".".join(parts if len(parts) > 1 else ["public", *parts])


def outer_parts(text: str) -> list[str]:
    """Parts at commas outside of parentheses and literals."""
    out, depth, held = [], 0, ""
    for t in re.findall(r"'(?:[^']|'')*'|\"[^\"]*\"|.", text, re.S):
        if t == "," and not depth:
            out.append(held.strip())
            held = ""
            continue
        depth += (t == "(") - (t == ")")
        held += t
    return [*out, held.strip()] if held.strip() else out


def inside_parentheses(text: str) -> str:
    depth, start = 0, text.find("(")
    for i in range(max(start, 0), len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if not depth and start >= 0 and i > start:
            return text[start + 1 : i]
    return text[start + 1 :] if start >= 0 else ""


REFERENCES = re.compile(rf"(?is)\bREFERENCES\s+({NAME})\s*(?:\(([^)]*)\))?(.*)")
ACTION = r"(?is)\bON\s+{0}\s+(CASCADE|RESTRICT|SET\s+NULL|SET\s+DEFAULT|NO\s+ACTION)"


def parse_sql_definitions(path: str, data: bytes) -> Parsed:
    from lorekeep.sources.config import statements

    text = data.decode("utf-8", "replace")
    doc = Parsed(path, "sql", module_title(path), "code", text)

    def foreign(table: str, columns: list[str], tail: str, line: int) -> None:
        m = REFERENCES.search(tail)
        if not m:
            return
        target, given = sql_name(m[1]), [x.strip().strip('"') for x in (m[2] or "").split(",") if x.strip()]
        meta = {k: a[1].upper() for k, verb in (("on_delete", "DELETE"), ("on_update", "UPDATE")) if (a := re.search(ACTION.format(verb), m[3]))}
        for c in columns:
            doc.refs.append(Reference("references", f"{table}.{c}", f"{target}.{given[0]}" if len(given) == 1 else target, tail.strip()[:200], line, meta))

    for line, s in statements(text):
        bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", s, flags=re.S).strip().rstrip(";")
        if m := re.match(rf"(?is)CREATE\s+(?:(?:GLOBAL|LOCAL)\s+)?(?:TEMP(?:ORARY)?\s+|UNLOGGED\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({NAME})\s*\(", bare):
            table, columns = sql_name(m[1]), []
            unit = Unit("table", table, table.split(".")[-1], s, line)
            doc.units.append(unit)
            for part in outer_parts(inside_parentheses(bare[m.end() - 1 :])):
                if k := re.match(r"(?is)(?:CONSTRAINT\s+\S+\s+)?FOREIGN\s+KEY\s*\(([^)]*)\)(.*)", part):
                    foreign(table, [x.strip().strip('"') for x in k[1].split(",")], k[2], line)
                elif re.match(r"(?is)(CONSTRAINT|PRIMARY\s+KEY|UNIQUE|CHECK|EXCLUDE|LIKE)\b", part):
                    continue
                elif k := re.match(r'(?is)("[^"]+"|\w+)\s+(.*)', part):
                    name, rest = k[1].strip('"'), k[2]
                    kind = re.match(r"(?is)((?:double\s+precision|character\s+varying|timestamp\s+with(?:out)?\s+time\s+zone|[\w.]+)(?:\s*\([^)]*\))?(?:\s*\[\])*)", rest)
                    key = bool(re.search(r"(?i)\bPRIMARY\s+KEY\b", rest))
                    meta = {"type": kind[1] if kind else "", "nullable": not (key or re.search(r"(?i)\bNOT\s+NULL\b", rest)), "primary_key": key}
                    if d := re.search(r"(?is)\bDEFAULT\s+('(?:[^']|'')*'(?:::\w+)?|[\w.]+(?:\([^)]*\))?)", rest):
                        meta["default"] = d[1]
                    columns.append(name)
                    doc.units.append(Unit("column", f"{table}.{name}", name, part, line, metadata=meta))
                    doc.refs.append(Reference("contains", table, f"{table}.{name}", "", line))
                    foreign(table, [name], rest, line)
            unit.metadata = {"schema": table.split(".")[0], "name": table.split(".")[-1], "columns": columns}
        elif m := re.match(rf"(?is)ALTER\s+TABLE\s+(?:ONLY\s+)?(?:IF\s+EXISTS\s+)?({NAME})\s+ADD\s+(?:CONSTRAINT\s+\S+\s+)?FOREIGN\s+KEY\s*\(([^)]*)\)(.*)", bare):
            foreign(sql_name(m[1]), [x.strip().strip('"') for x in m[2].split(",")], m[3], line)
        elif m := re.match(rf"(?is)CREATE\s+(UNIQUE\s+)?INDEX\s+(?:CONCURRENTLY\s+)?(?:IF\s+NOT\s+EXISTS\s+)?({NAME})\s+ON\s+(?:ONLY\s+)?({NAME})[^(]*\(", bare):
            table = sql_name(m[3])
            name = f"{table.split('.')[0]}.{m[2].split('.')[-1].strip(chr(34))}"
            doc.units.append(Unit("index", name, name.split(".")[-1], s, line, metadata={"unique": bool(m[1]), "table": table, "columns": outer_parts(inside_parentheses(bare[m.end() - 1 :]))}))
        elif m := re.match(rf"(?is)CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?(MATERIALIZED\s+)?VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?({NAME})", bare):
            doc.units.append(Unit("view", sql_name(m[2]), sql_name(m[2]).split(".")[-1], s, line, metadata={"materialized": bool(m[1])}))
        elif m := re.match(rf"(?is)CREATE\s+(?:OR\s+REPLACE\s+)?(FUNCTION|PROCEDURE)\s+({NAME})\s*\(", bare):
            args = outer_parts(inside_parentheses(bare[m.end() - 1 :]))
            kinds = [re.sub(r"(?is)\s+(DEFAULT|=).*$", "", a).split() for a in args]
            types = [k[-1] if len(k) > 1 else k[0] for k in kinds if k and k[0].upper() not in ("OUT",)]
            name = sql_name(m[2]) + (f"({','.join(types)})" if types else "")
            returns = re.search(r"(?is)\bRETURNS\s+((?:SETOF\s+)?[\w.]+)", bare)
            language = re.search(r"(?is)\bLANGUAGE\s+'?(\w+)'?", bare)
            doc.units.append(Unit("function", name, sql_name(m[2]).split(".")[-1], s, line, metadata={"returns": returns[1] if returns else "", "language": language[1].lower() if language else "", "args": args}))
            if (body := re.search(r"(?s)(\$\w*\$)(.*?)\1", s)) and (not language or language[1].lower() in ("plpgsql", "sql")):
                doc.refs += body_references(name, body[2])
        elif m := re.match(rf"(?is)CREATE\s+(SEQUENCE|SCHEMA|TYPE)\s+(?:IF\s+NOT\s+EXISTS\s+)?({NAME})", bare):
            name = m[2].strip('"') if m[1].upper() == "SCHEMA" else sql_name(m[2])
            doc.units.append(Unit(m[1].lower(), name, name.split(".")[-1], s, line))
    doc.metadata["migration"] = migration_tool(path, text)
    return doc


def migration_tool(path: str, text: str) -> str:
    """Marks of migration tools in names and comments."""
    if "+goose" in text:
        return "goose"
    if "-- migrate:up" in text:
        return "dbmate"
    if re.search(r"(^|/)V\d+(\.\d+)*__\w+\.sql$", path):
        return "flyway"
    if re.search(r"\.(up|down)\.sql$", path):
        return "golang-migrate"
    return ""


BODY_RULES = [
    ("write", rf"(?is)\bINSERT\s+INTO\s+({NAME})"),
    ("write", rf"(?is)\bUPDATE\s+(?:ONLY\s+)?({NAME})\s+(?:AS\s+\w+\s+|\w+\s+)?SET\b"),
    ("write", rf"(?is)\bDELETE\s+FROM\s+(?:ONLY\s+)?({NAME})"),
    ("write", rf"(?is)\bTRUNCATE\s+(?:TABLE\s+)?({NAME})"),
    ("write", rf"(?is)\bMERGE\s+INTO\s+({NAME})"),
    ("read", rf"(?is)(?<!DELETE\s)\b(?:FROM|JOIN|USING)\s+(?:ONLY\s+|LATERAL\s+)?({NAME})(?!\s*\()"),
    ("procedure_call", rf"(?is)\b(?:CALL|PERFORM)\s+({NAME})\s*\("),
]


def body_references(function: str, body: str, how: dict | None = None) -> list[Reference]:
    """What a function's statements read, write and call; text that EXECUTE runs, if it is a literal, is read too."""
    code = re.sub(r"--[^\n]*|/\*.*?\*/", " ", body, flags=re.S)
    out: dict[tuple[str, str], Reference] = {}
    executed = re.findall(r"(?is)\bEXECUTE\s+(?:format\s*\(\s*)?'((?:[^']|'')*)'", code)
    dynamic = bool(re.search(r"(?is)\bEXECUTE\s+(?!\s*(?:format\s*\(\s*)?')\w", code))
    assigned = dict(re.findall(r"(?is)(\w+)\s*:=\s*'((?:[^']|'')*)'\s*;", code))
    for name in re.findall(r"(?is)\bEXECUTE\s+(\w+)\s*[;\s]", code):
        if name in assigned:
            executed.append(assigned[name])
    plain = re.sub(r"'(?:[^']|'')*'", "''", code)
    ctes = {x.lower() for x in re.findall(r"(?is)(?:\bWITH\s+(?:RECURSIVE\s+)?|,\s*)(\w+)\s+AS\s*\(", plain)}
    for op, pattern in BODY_RULES:
        for m in re.finditer(pattern, plain):
            if m[1].lower() in ctes or m[1].lower() in ("select", "new", "old", "only", "lateral", "unnest", "generate_series", "values"):
                continue
            target = sql_name(m[1])
            key = (target, "call" if op == "procedure_call" else "data")
            if key in out and out[key].metadata["op"] != op:
                out[key].metadata["op"] = "both"
            else:
                out.setdefault(key, Reference("body_references", function, target, m[0].strip(), metadata={"op": op, "unresolved": True, "target_name": target} | (how or {}) | ({"uses_dynamic_sql": True} if dynamic else {})))
    found = list(out.values())
    for text in executed:
        nested = {"via_execute": True} | ({"nested_execute": True} if how else {})
        found += body_references(function, text.replace("''", "'").replace("%I", "x").replace("%s", "x"), nested)
    return found


# --- connect stubs ---


def parse_connect(path: str, data: bytes) -> Parsed:
    """Service objects of generated stubs: a method unit for each entry. They make no chunks."""
    text = data.decode("utf-8", "replace")
    doc = Parsed(path, "connect-es", module_title(path), "code", text)
    stem = module_title(path).lower()
    if not stem.endswith(("_connect", "_connectweb")) or "typeName" not in text:
        return doc
    for m in re.finditer(r"export\s+(?:const|declare\s+const)\s+(\w+)[^{=]*=?\s*\{", text):
        lines = text[m.end() - 1 :].split("\n")
        body = "\n".join(lines[: block_end(lines, 0, LANGUAGES["javascript"]) + 1])
        name = re.search(r"typeName\s*:\s*[\"']([\w.]+)[\"']", body)
        methods = re.search(r"methods\s*:\s*\{", body)
        if not name or not methods:
            continue
        for k in re.finditer(r"(\w+)\s*:\s*\{[^{}]*?name\s*:\s*[\"']\w+[\"'][^{}]*\}", body[methods.end() :]):
            kind = re.search(r"kind\s*:\s*MethodKind\.(\w+)", k[0])
            doc.units.append(Unit("method", f"{name[1]}.{k[1]}", k[1], k[0], metadata={"connect_es_stub": True, "service_typename": name[1], "const_name": m[1], "method_key": k[1], "streaming_kind": kind[1] if kind else ""}))
    return doc


CLIENT = re.compile(r"(?m)\b(?:const|let|var|readonly|this\.)?\s*(\w+)\s*(?::[^=]+)?=\s*create(?:Promise|Callback)?Client\(\s*(\w+)")


def connect_call_sites(text: str, stubs: dict[str, str]) -> list[tuple[str, str]]:
    """(enclosing function, rpc) of calls on clients made for a stub; ``stubs`` has a service's type name by constant.
    Calls outside of named functions don't count."""
    lang = LANGUAGES["javascript"]
    code = blanked_comments(text, lang)
    clients = {m[1]: stubs[m[2]] for m in CLIENT.finditer(code) if m[2] in stubs}
    doc = parse_braces("x.ts", text.encode(), lang)
    out = []
    for u in doc.units:
        if u.kind in ("function", "method"):
            for m in re.finditer(r"\b(?:this\.)?(\w+)\.(\w+)\s*\(", u.content):
                if m[1] in clients:
                    out.append((u.path.split(".", 1)[1], f"{clients[m[1]]}.{m[2][0].upper()}{m[2][1:]}"))
            for m in re.finditer(r"\{\s*([\w\s,]+)\}\s*=\s*(\w+)\s*;", u.content):
                if m[2] in clients:
                    for name in re.findall(r"\w+", m[1]):
                        if re.search(rf"\b{name}\s*\(", u.content[m.end() :]):
                            out.append((u.path.split(".", 1)[1], f"{clients[m[2]]}.{name[0].upper()}{name[1:]}"))
    return list(dict.fromkeys(out))


#: Endings of files that Dart generators write.
DART_GENERATED = (".g.dart", ".freezed.dart", ".pb.dart", ".pbgrpc.dart", ".pbenum.dart", ".pbjson.dart")


def dart_call_sites(path: str, text: str, registry: dict[str, dict[str, str]]) -> list[tuple[str, str]]:
    """(enclosing function, rpc) of calls on values of a generated client class; ``registry`` has rpcs by class and
    method. Bindings are locals, fields and getters of the same file."""
    if path.endswith(DART_GENERATED):
        return []
    code = blanked(text, LANGUAGES["dart"])
    bound: dict[str, str] = {}
    for cls in registry:
        for m in re.finditer(rf"\b(?:late\s+|final\s+)*{cls}\??\s+(?:get\s+)?(\w+)\s*(?:=|;|\(|,|\)|\{{|=>)", code):
            bound[m[1]] = cls
        for m in re.finditer(rf"\b(?:final|var|late)\s+(\w+)\s*=\s*(?:const\s+)?{cls}\s*\(", code):
            bound[m[1]] = cls
    out = []
    for u in parse_braces(path, text.encode(), LANGUAGES["dart"]).units:
        if u.kind in ("function", "method"):
            for m in re.finditer(r"\b(\w+)[?!]?\.(\w+)\s*\(", u.content):
                rpc = registry.get(bound.get(m[1], ""), {}).get(m[2])
                if rpc:
                    out.append((u.path, rpc))
    return list(dict.fromkeys(out))
