"""Small per-file parsers run inside tasks: definitions, calls and imports of one source text.

Only what needs a parser is done here; everything that relates files to each
other is a Spark join (see ``sources/code.py``).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from palisade.sources.scanner import CLASS_WORDS, definitions

FACT_SCHEMA = (
    "file_path string, fact string, name string, display string, chain array<string>, start bigint, end bigint, "
    "bases array<string>, module string, source_name string, text string, head string, seq bigint"
)


def _fact(fact: str, name: str, seq: int, **more) -> dict:
    row = {"fact": fact, "name": name, "display": None, "chain": None, "start": None, "end": None, "bases": None, "module": None, "source_name": None, "text": None, "head": None, "seq": seq}
    row.update(more)
    return row


def python_facts(path: str, source: str) -> Iterator[dict]:
    """Classes, functions, name calls and from-imports of a Python file; if it does not parse, what its lines tell."""
    counter = iter(range(1 << 60))
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        yield from _torn_python(source, counter)
        return
    yield from _python_scope(tree, [], source, counter)
    for stmt in tree.body:
        if isinstance(stmt, ast.ImportFrom):
            module = "." * stmt.level + (stmt.module or "")
            absolute = _absolute(module, path) if stmt.level else module
            for alias in stmt.names:
                yield _fact("import", alias.asname or alias.name, next(counter), module=absolute, source_name=alias.name, start=stmt.lineno - 1)


_HEAD = re.compile(r"([ \t]*)(class|def|async\s+def)\s+(\w+)")


def _torn_python(source: str, counter) -> Iterator[dict]:
    """Definitions of a file that does not parse: heads by pattern, extents by indentation."""
    lines = source.splitlines()
    width = [len(x.expandtabs()) - len(x.expandtabs().lstrip()) if x.strip() else None for x in lines]
    open_: list[tuple[int, str, bool]] = []  # indentation, name, class
    seen: dict[tuple, int] = {}
    for at, line in enumerate(lines):
        head = _HEAD.match(line)
        if width[at] is None or not head:
            continue
        while open_ and open_[-1][0] >= width[at]:
            open_.pop()
        below = next((k for k in range(at + 1, len(lines)) if width[k] is not None and width[k] <= width[at]), len(lines))
        end = max(k for k in range(at, below) if width[k] is not None)
        name, is_class = head[3], head[2] == "class"
        chain = [n for _, n, _ in open_]
        if all(c for *_, c in open_):
            if is_class:
                yield _fact("class", name, next(counter), display=name, chain=chain, start=at, end=end)
            else:
                seen[(*chain, name)] = again = seen.get((*chain, name), 0) + 1
                yield _fact("function", name, next(counter), display=name if again == 1 else f"{name}__{again}", chain=chain, start=at, end=end)
        open_.append((width[at], name, is_class))


def _absolute(module: str, path: str) -> str:
    dots = len(module) - len(module.lstrip("."))
    folders = path.split("/")[:-1]
    kept = folders[: max(0, len(folders) - (dots - 1))]
    rest = module[dots:]
    return ".".join([*kept, rest]) if rest else ".".join(kept)


def _python_scope(scope: ast.AST, chain: list[str], source: str, counter) -> Iterator[dict]:
    seen: dict[str, int] = {}
    for node in scope.body:
        if isinstance(node, ast.ClassDef):
            bases = [ast.get_source_segment(source, b) for b in [*node.bases, *node.keywords]]
            yield _fact("class", node.name, next(counter), display=node.name, chain=list(chain), start=node.lineno - 1, end=node.end_lineno - 1, bases=bases or None)
            yield from _python_scope(node, [*chain, node.name], source, counter)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            seen[node.name] = seen.get(node.name, 0) + 1
            shown = node.name if seen[node.name] == 1 else f"{node.name}__{seen[node.name]}"
            top = min([d.lineno for d in node.decorator_list], default=node.lineno)
            yield _fact("function", node.name, next(counter), display=shown, chain=list(chain), start=node.lineno - 1, end=node.end_lineno - 1, head=top - 1)
            for call in _python_calls(node):
                yield _fact("call", call, next(counter), display=shown, chain=list(chain))


def _python_calls(node: ast.AST) -> Iterator[str]:
    inside = [*node.body, node.args] + ([node.returns] if node.returns else [])
    for part in inside:
        todo = [part]
        for sub in todo:  # breadth first; leaves are left out, which is most of what ``ast.walk`` would visit
            if type(sub) is ast.Call and type(sub.func) is ast.Name:
                yield sub.func.id
            for name in sub._fields:
                value = getattr(sub, name, None)
                if type(value) is list:
                    todo += [x for x in value if isinstance(x, ast.AST) and type(x) not in _LEAVES]
                elif isinstance(value, ast.AST) and type(value) not in _LEAVES:
                    todo.append(value)


#: Nodes that hold no others.
_LEAVES = frozenset([ast.Name, ast.Constant, ast.Load, ast.Store, ast.Del])


# --- fixed values: definition heads of the brace languages --------------------
_RUST = re.compile(
    r"\b(?:struct|enum|trait)\s+(?P<cls>\w+)|\bfn\s+(?P<fn>\w+)|\bimpl\b(?P<open>[^{;]*)(?=\{)"
)
BRACE_HEADS = {"rust": _RUST}
_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|(?<![\w])'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`", re.S)


def scanned_facts(language: str, source: str) -> Iterator[dict]:
    """Classes and functions of JavaScript, TypeScript or Java."""
    for n, d in enumerate(definitions(language, source)):
        yield _fact(d["kind"], d["name"], n, display=d["shown"], chain=d["chain"], start=d["start"], end=d["end"], bases=[d["base"]] if d["base"] else None)


def _blank(match: re.Match) -> str:
    return re.sub(r"[^\n]", " ", match.group())


def brace_facts(language: str, source: str) -> Iterator[dict]:
    """Classes and functions of Rust, found by head patterns and brace matching.
    Partial by nature: it reads heads, not a grammar.  Bodies of functions are
    not entered; bodies of classes (and Rust ``impl`` blocks) are.
    """
    text = _NOISE.sub(_blank, source)
    heads, closing = BRACE_HEADS[language], _closing_braces(text)
    counter = iter(range(1 << 60))
    yield from _brace_scope(text, 0, len(text), [], heads, closing, counter)


def _closing_braces(text: str) -> dict[int, int]:
    pairs, stack = {}, []
    for m in re.finditer(r"[{}]", text):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()
    return pairs


def _brace_scope(text: str, at: int, stop: int, chain: list[str], heads, closing, counter) -> Iterator[dict]:
    seen: dict[str, int] = {}
    while at < stop:
        head = heads.search(text, at, stop)
        brace = text.find("{", at, stop)
        if head is None:
            return
        if 0 <= brace < head.start():
            at = closing.get(brace, brace) + 1  # some other block: not a scope of definitions
            continue
        groups = head.groupdict()
        body = text.find("{", head.end() - 1 if text[head.end() - 1 : head.end()] == "{" else head.end(), stop)
        semi = text.find(";", head.end(), stop)
        if 0 <= semi < body or body < 0:
            body = -1
        end = closing.get(body, stop - 1) if body >= 0 else (semi if semi >= 0 else head.end() - 1)
        line = lambda i: text.count("\n", 0, i)
        if groups.get("open") is not None:
            yield from _brace_scope(text, body + 1, end, chain, heads, closing, counter)
        elif groups.get("cls"):
            base = groups.get("base")
            yield _fact("class", groups["cls"], next(counter), display=groups["cls"], chain=list(chain), start=line(head.start()), end=line(end), bases=[base] if base else None)
            if body >= 0:
                yield from _brace_scope(text, body + 1, end, [*chain, groups["cls"]], heads, closing, counter)
        else:
            name = groups.get("fn") or groups["method"]
            if groups.get("fn") or chain:
                seen[name] = seen.get(name, 0) + 1
                shown = name if seen[name] == 1 else f"{name}__{seen[name]}"
                yield _fact("function", name, next(counter), display=shown, chain=list(chain), start=line(head.start()), end=line(end))
        at = end + 1


def facts_of(path: str, language: str, source: str) -> list[dict]:
    if not source or not source.strip():
        return []
    if language == "python":
        found = python_facts(path, source)
    elif language in BRACE_HEADS:
        found = brace_facts(language, source)
    elif language in CLASS_WORDS:
        found = scanned_facts(language, source)
    else:
        return []
    lines = source.splitlines()
    return [{"file_path": path, **_with_text(row, lines)} for row in found]


def _with_text(row: dict, lines: list[str]) -> dict:
    """Add a definition's own lines, and those of its decorators, each ended by a newline."""
    if row["fact"] in ("class", "function"):
        start, top = row["start"], row["head"]
        row["text"] = "\n".join(lines[start : row["end"] + 1])
        row["head"] = None if top is None else "".join(x + "\n" for x in lines[top:start])
    return row
