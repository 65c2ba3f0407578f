import ast
import time

import pytest

from palisade.sources import code, parsing
from palisade.sources.parsing import facts_of
from palisade.sources.scanner import definitions


def test_decorators_of_any_height():
    stack = "".join(f"@mark{i}(\n    {i},\n)\n" for i in range(15))
    facts = facts_of("a.py", "python", f"import x\n@app.get('/far')\n{stack}def far():\n    pass\n\ndef bare(): pass\n")
    far, bare = [f for f in facts if f["fact"] == "function"]
    assert far["head"] == f"@app.get('/far')\n{stack}" and far["text"] == "def far():\n    pass" and bare["head"] == ""


def test_a_torn_file_keeps_its_definitions():
    source = "class A(B):\n    def f(self):\n        print 'a'\n\n    async def g(self): pass\n\ndef h():\n    def k():\n        pass\n    return 1\ndef h(): pass\n"
    found = [(f["fact"], f["display"], f["chain"], f["start"], f["end"]) for f in facts_of("a.py", "python", source)]
    assert found == [("class", "A", [], 0, 4), ("function", "f", ["A"], 1, 2), ("function", "g", ["A"], 4, 4), ("function", "h", [], 6, 9), ("function", "h__2", [], 10, 10)]


JS = r'''import {a} from 'x'
/* class No { } */
const s = `class ${ `n${"}"}` } {`, r = /[/{]class No {/g
export default class Shop extends base.Store {
  #count = 0
  items = [{a: 1}]
  static make(x = {a: {}}) { return new Shop() }
  get size() { if (x) { y() } return 1 }
  async *walk() {}
  handler = () => { go() }
  make() { function inner() {} }
}
if (x) { function hidden() {} }
export async function load(u, {a, b}) {
  return fetch(u).then(r => r.json())
}
const f = function named() {}
function
 late() {}
class Torn {
  one() { (
  }
  two() {'''
TS = r'''@Injectable({ providedIn: 'root' })
export class Api<T extends { id: number }> extends Base<T> implements One {
  private readonly url: string = "x"
  constructor(private http: Http) { super() }
  @Input() name: { a: string }
  get<K>(key: K): Promise<{ a: number }> { return null as any }
  over(a: string): void
  over(a: any): void {}
}
interface Shape { area(): number }
type T = { a(): void }
declare function ext(): void
export function pick(o: { a: 1 }): { b: 2 } { return o as any }
'''
JAVA = r'''package a;
import java.util.*;
@Entity(name = "x")
public class Order<T extends Comparable<T>> extends base.Model implements A, B {
    private Map<String, List<Integer>> m = new HashMap<>() {{ put("a", null); }};
    static { init(); }
    public Order(int a) { this.a = a; }
    @Override
    public String toString() { return """ } class No { """; }
    public <K> List<K> all(K k) throws IOException, X {
        Runnable r = new Runnable() { public void run() {} };
        return null;
    }
    abstract int area();
    interface Inner { void go(); default int x() { return 1; } }
    int area(int x) { return 'a' + '{'; }
}
enum Color { RED { void f() {} }; void g() {} }
class Torn { void a() { if (x) {
'''

JS_FOUND = [
    ("class", [], "Shop", 3, 11, "base.Store"), ("function", ["Shop"], "make", 6, 6, None), ("function", ["Shop"], "size", 7, 7, None), ("function", ["Shop"], "walk", 8, 8, None),
    ("function", ["Shop"], "make__2", 10, 10, None), ("function", [], "load", 13, 15, None), ("function", [], "late", 17, 18, None), ("class", [], "Torn", 19, 22, None),
    ("function", ["Torn"], "one", 20, 21, None), ("function", ["Torn"], "two", 22, 22, None),
]
TS_FOUND = [
    ("class", [], "Api", 1, 8, "Base"), ("function", ["Api"], "constructor", 3, 3, None), ("function", ["Api"], "get", 5, 5, None), ("function", ["Api"], "over", 7, 7, None),
    ("function", [], "pick", 12, 12, None),
]
JAVA_FOUND = [
    ("class", [], "Order", 2, 16, "base.Model"), ("function", ["Order"], "toString", 7, 8, None), ("function", ["Order"], "all", 9, 12, None), ("function", ["Order"], "area", 13, 13, None),
    ("class", ["Order"], "Inner", 14, 14, None), ("function", ["Order", "Inner"], "go", 14, 14, None), ("function", ["Order", "Inner"], "x", 14, 14, None),
    ("function", ["Order"], "area__2", 15, 15, None), ("class", [], "Torn", 18, 18, None), ("function", ["Torn"], "a", 18, 18, None),
]


@pytest.mark.parametrize("language, text, want", [("javascript", JS, JS_FOUND), ("typescript", TS, TS_FOUND), ("tsx", TS, TS_FOUND), ("java", JAVA, JAVA_FOUND)])
def test_definitions_of_brace_languages(language, text, want):
    assert [(d["kind"], d["chain"], d["shown"], d["start"], d["end"], d["base"]) for d in definitions(language, text)] == want
    facts = facts_of("a", language, text)
    assert [(f["fact"], f["display"]) for f in facts] == [(w[0], w[2]) for w in want] and facts[-1]["text"].strip()


@pytest.mark.parametrize("language, text", [("javascript", JS), ("typescript", TS), ("java", JAVA)])
def test_files_torn_anywhere_keep_what_was_closed(language, text):
    """A cut file gives no error, and all definitions that ended before the cut."""
    lines = text.count("\n")
    whole = list(definitions(language, text))
    ends = [len("\n".join(text.split("\n")[: d["end"] + 1])) for d in whole]
    for cut in range(0, len(text), 3):
        found = [(d["kind"], d["shown"], d["start"]) for d in definitions(language, text[:cut])]
        for d, end in zip(whole, ends):
            if end < cut and d["end"] < lines - 3:
                assert (d["kind"], d["shown"], d["start"]) in found, (cut, d)


def test_router_patterns_take_linear_time(spark):
    """A word of 100,000 letters is no start of a variable but at its first letter; matches are as before."""
    text = 'r = APIRouter(prefix="/a")\n9x=APIRouter()\nés = HTTPBearer()\nq\n =  APIRouter(dependencies=[Depends(s)])\n# ' + "a" * 100_000 + "\n"
    files = lambda source: spark.createDataFrame([("a.py", "python", source, 9)], "file_path string, language string, source string, size_bytes long")
    code.CodeScan(files("x = 1"), "urn:x", "app").gates.first()
    start = time.time()
    row = code.CodeScan(files(text), "urn:x", "app").gates.first()
    assert time.time() - start < 10
    assert [tuple(m) for m in row.routers] == [("r", "/a"), ("9x", ""), ("q", "")]
    assert [tuple(m) for m in row.schemes] == [("s", "HTTPBearer")] and [tuple(m) for m in row.router_depends] == [("q", "Depends(s)")]


def test_calls_are_those_a_walk_finds():
    for path in (code.__file__, parsing.__file__, __file__):
        with open(path) as f:
            tree = ast.parse(f.read())
        for node in ast.walk(tree):
            if isinstance(node, ast.FunctionDef):
                inside = [*node.body, node.args] + ([node.returns] if node.returns else [])
                walked = [sub.func.id for part in inside for sub in ast.walk(part) if isinstance(sub, ast.Call) and isinstance(sub.func, ast.Name)]
                assert list(parsing._python_calls(node)) == walked
