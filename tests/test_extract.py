from conftest import rows

from skein.operators import evidence, extract, routes

EXPRESS = """
const express = require('express');
const { auth, limit: rate } = require("./middleware");
import users from './users.js'
const app = express();
// app.get('/commented', nope)
app.use('/api', auth, users);
app.get('/users/:id', auth, rate(3), getUser);
app.route('/things').get(list).post(make);
class Store extends Base {}
"""
FASTAPI = '''
from fastapi import APIRouter
router = APIRouter()

class Item(Base):
    name: str
    size: int = 3

@router.get("/items/{id}")
async def read(id: int):
    """Read one."""
    return helper(id)

def helper(x):
    return x if x else None

app.include_router(router, prefix="/v1")
'''
SPRING = """
package a.b;
import java.util.List;
@RestController
@RequestMapping("/api")
public class UserController {
    private final UserService users;
    @GetMapping("/users/{id}")
    public User find(Long id) { return users.find(id); }
    @PostMapping
    public User add(User u) { return u; }
}
"""


def kinds(path, text, kind):
    return [f[1:4] for f in extract.facts_of(path, text) if f[0] == kind]


def test_script():
    assert kinds("a.js", EXPRESS, "mount") == [("/api", "app", "users")]
    assert kinds("a.js", EXPRESS, "endpoint") == [("GET /users/:id", "app", "getUser"), ("GET /things", "app", ""), ("POST /things", "app", "")]
    assert ("auth", "GET /users/:id", "0") in kinds("a.js", EXPRESS, "middleware") and ("rate", "GET /users/:id", "1") in kinds("a.js", EXPRESS, "middleware")
    assert ("./middleware", "limit", "rate") not in kinds("a.js", EXPRESS, "import") and ("./middleware", "rate", "limit") in kinds("a.js", EXPRESS, "import")
    assert kinds("a.ts", "interface A { x: string; y?: number }\ninterface B {\n  x: string;\n  y?: number;\n}\nenum E { P = 'p', Q }", "model_field") == [("x", "B", "string!"), ("y", "B", "number")]
    assert kinds("a.ts", "enum E { P = 'p', Q }", "enum_value") == [("P", "E", "'p'"), ("Q", "E", "")]
    assert kinds("m.js", "const S = new Schema({ name: { type: String, required: true }, owner: { type: ObjectId, ref: 'User' } });", "reference") == [("User", "S", "owner")]


def test_python():
    assert kinds("m.py", FASTAPI, "endpoint") == [("GET /items/{id}", "", "read")]
    assert kinds("m.py", FASTAPI, "mount") == [("/v1", "", "router")]
    assert kinds("m.py", FASTAPI, "model_field") == [("name", "Item", "str!"), ("size", "Item", "int")]
    assert ("helper", "read", "") in kinds("m.py", FASTAPI, "call")
    assert kinds("broken.py", "def f(:\n  pass\nimport os", "function") == [("f", "", "")]


def test_java_go_and_files():
    assert kinds("U.java", SPRING, "endpoint") == [("GET /api/users/{id}", "UserController", ""), ("POST /api", "UserController", "")]
    assert ("users", "UserController", "UserService") in kinds("U.java", SPRING, "model_field")
    assert kinds("m.go", 'package a\n\nimport "fmt"\n\ntype T struct {\n\tName string `json:"n"`\n}\n\nfunc (t *T) Run() {}\n', "method") == [("Run", "T", "")]
    assert kinds("Dockerfile", "FROM a\nENV A=1 B=\"two\"\nEXPOSE 80 81\nRUN x \\\n  y", "docker") == [("FROM", "", "a"), ("ENV", "A", "1"), ("ENV", "B", "two"), ("EXPOSE", "80", ""), ("EXPOSE", "81", ""), ("RUN", "", "x    y")]
    assert ("job", "build", "") in kinds("ci.yml", "on: [push]\njobs:\n  build:\n    steps: []\n", "workflow") and ("trigger", "push", "") in kinds("ci.yml", "on: [push]\n", "workflow")
    assert kinds("s.prisma", "model A {\n  id Int\n  b String?\n}", "model_field") == [("id", "A", "Int!"), ("b", "A", "String?")]
    assert kinds("s.sql", "CREATE TABLE IF NOT EXISTS t (a int, FOREIGN KEY (a) REFERENCES u(id))", "reference") == [("u", "", "a")]
    assert extract.facts_of(None, "x") == [] and extract.facts_of("a.js", None) == [] and extract.facts_of("a.bin", "x") == []
    assert extract.balanced("f(a[1], '{')") and not extract.balanced("f(")


def test_tables(spark):
    files = spark.createDataFrame([("r", "src/app.js", EXPRESS), ("r", "src/users.js", "export function list() {}"), ("r", "src/main.py", FASTAPI), ("r", None, None), ("r", "web/x.jsx", "")], "repository string, path string, text string")
    facts = extract.file_facts(files, ["repository", "path"], path="path").cache()
    edges = rows(evidence.import_edges(facts, files))
    assert ("r", "src/app.js", "src/users.js", "internal") in edges and ("r", "src/app.js", "express", "external") in edges and ("r", "src/app.js", "./middleware", "unresolved") in edges
    assert ("r", "src/main.py:read", "src/main.py:helper") in rows(evidence.call_edges(facts))
    surface = {(r["method"], r["path"]): r for r in evidence.api_surface(facts).collect()}
    assert surface["GET", "/users/{id}"]["auth"] and not surface["GET", "/items/{id}"]["auth"]
    assert ("r", "framework", "express") in rows(evidence.tech_stack(facts))
    assert {r["module"]: r["type"] for r in evidence.modules(files).collect()} == {"src": "backend", "web": "frontend"}
    failing = extract.file_facts(files.limit(1), ["path"], path="path", extract=lambda p, t: 1 / 0)
    assert rows(failing)[0][1] == "error"
    assert rows(extract.file_facts(files.limit(0), ["path"], path="path")) == []


def test_route_labels(spark):
    df = spark.createDataFrame([("GET", "/users"), ("GET", "/users/:id"), ("POST", "/api/categories"), ("DELETE", "/statuses/{a}/items/{b}")], "m string, p string")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(routes.operation_id(F.col("m"), F.col("p"))).collect()]
    assert got == ["getUsers", "getUserById", "createCategory", "deleteStatusItem"]
    auth = spark.createDataFrame([(["jwtCheck", "adminRole"],), (["cookieSession"],), ([],), (None,)], "t array<string>").select(routes.auth_type(F.col("t"))).collect()
    assert [r[0] for r in auth] == ["JWT+RBAC", "Session", "Public", "Public"]
    ok = spark.createDataFrame([("/a/{id}",), ("/a//b",), ("a",), ("/{1x}",)], "p string").select(routes.valid_path(F.col("p"))).collect()
    assert [r[0] for r in ok] == [True, False, False, False]


def test_mounted_routes(spark):
    m = spark.createDataFrame([(1, "r", ("app.js", "app"), ("api.js", "router"), "/api"), (2, "r", ("api.js", "router"), ("p.js", "router"), "/projects"), (3, "q", ("a", "s"), ("b", "s"), "/x"), (4, "q", ("b", "s"), ("a", "s"), "/y")], "mount_id long, repository string, parent struct<file_path:string,router_symbol:string>, child struct<file_path:string,router_symbol:string>, mount_path string")
    c = spark.createDataFrame([("r", "p.js", "router", "GET", "/:id", 3, None), ("r", "p.js", "router", "PATCH", "/:id", 4, ["auth"]), ("q", "a", "s", "GET", "/z", 1, None)], "repository string, source_file string, router_symbol string, method string, path string, line_start int, middleware_tokens array<string>")
    got = {r["normalized_key"] for r in routes.resolve_routes(c, m, "strict").collect()}
    assert got == {"GET /api/projects/{id}", "PATCH /api/projects/{id}"}
    assert len(routes.resolve_routes(c, m).collect()) == 3


def test_calls_with_their_owners():
    js = """
class Cart extends Base {
  constructor(x) { super(x); this.total = sum(x); }
  async pay(card) { if (card.ok()) { return this.charge(card); } log(`no ${card}`); }
  charge(card) { return new Gateway().send(card) }
}
function sum(list) { return list.reduce((a, b) => add(a, b), 0); }
const add = (a, b) => { return plus(a, b); };
sum([1]);
"""
    got = {(f[0], f[1], f[2]) for f in extract.script_facts(js) if f[0] in ("call", "method")}
    assert {("method", "constructor", "Cart"), ("method", "pay", "Cart"), ("method", "charge", "Cart")} <= got
    assert {("call", "sum", "Cart.constructor"), ("call", "card.ok", "Cart.pay"), ("call", "this.charge", "Cart.pay"), ("call", "log", "Cart.pay"), ("call", "Gateway", "Cart.charge"), ("call", "list.reduce", "sum"), ("call", "add", "sum"), ("call", "plus", "add"), ("call", "sum", "")} <= got
    assert not any(f[1] in ("if", "super", "function", "pay", "constructor") for f in got if f[0] == "call")
    java = """
public class Order {
  Order(int n) { init(n); }
  void init(int n) { for (int i = 0; i < n; i++) { store.save(new Line(i)); } }
  public int total() { return this.sum("a(b)"); }
}
"""
    got = {(f[0], f[1], f[2]) for f in extract.java_facts(java) if f[0] in ("call", "method")}
    assert {("method", "Order", "Order"), ("method", "init", "Order"), ("method", "total", "Order"), ("call", "init", "Order.Order"), ("call", "store.save", "Order.init"), ("call", "Line", "Order.init"), ("call", "this.sum", "Order.total")} <= got
    go = "package a\n\nfunc (s *Store) Save(x int) error {\n\treturn check(s.db.Put(x))\n}\n\nfunc check(e error) error { return wrap(e) }\n"
    got = {(f[1], f[2]) for f in extract.go_facts(go) if f[0] == "call"}
    assert got == {("check", "Store.Save"), ("s.db.Put", "Store.Save"), ("wrap", "check")}


def test_route_chains_and_long_annotations():
    js = "router.route('/x').get((req, res) => { const a = 1; " + "res.send(a); " * 60 + "}).post(auth, (q, r) => { r.end(); }).delete(del);\nother.put('/y', h);"
    assert [f[1] for f in extract.script_facts(js) if f[0] == "endpoint"] == ["GET /x", "POST /x", "DELETE /x", "PUT /y"]
    java = '@RequestMapping("/base")\n@Tag(name = "' + "x (y) " * 80 + '")\n@RestController\npublic class A {\n  @GetMapping("/z")\n  public int z() { return 1; }\n}\n'
    assert [f[1] for f in extract.java_facts(java) if f[0] == "endpoint"] == ["GET /base/z"]


def test_call_edges(spark):
    from skein.operators import evidence

    f = [
        ("r", "a.js", "function", "run", "", "", 1), ("r", "a.js", "method", "go", "A", "", 2), ("r", "a.js", "method", "go", "B", "", 3), ("r", "b.js", "function", "run", "", "", 1), ("r", "b.js", "function", "only", "", "", 2),
        ("r", "a.js", "call", "run", "main", "", 5), ("r", "a.js", "call", "this.go", "A.start", "", 6), ("r", "a.js", "call", "x.only", "", "", 7), ("r", "c.js", "call", "run", "z", "", 8), ("r", "c.js", "call", "nowhere", "z", "", 9), ("r", "b.js", "call", "only", "only", "", 9),
    ]
    df = spark.createDataFrame(f, "repository string, path string, kind string, name string, owner string, value string, line int")
    assert rows(evidence.call_edges(df)) == [("r", "a.js:main", "a.js:run"), ("r", "a.js:module", "b.js:only"), ("r", "a.js:start", "a.js:go")]


def test_import_edges_of_both_kinds(spark):
    from skein.operators import evidence

    f = [("r", "a/b/m.py", "import", n) for n in (".x", "..y.z", "pkg", "src_mod.q", "os", "...gone")] + [("r", "w/v.ts", "import", n) for n in ("./u", "../a", "react", "./none")]
    files = [("r", p) for p in ("a/b/x.py", "a/y/z.py", "pkg/__init__.py", "src/src_mod/q.py", "w/u.ts", "a/index.js")]
    got = rows(evidence.import_edges(spark.createDataFrame(f, "repository string, path string, kind string, name string"), spark.createDataFrame(files, "repository string, path string")))
    assert got == sorted(
        [
            ("r", "a/b/m.py", "a/b/x.py", "internal"), ("r", "a/b/m.py", "a/y/z.py", "internal"), ("r", "a/b/m.py", "pkg/__init__.py", "internal"), ("r", "a/b/m.py", "src/src_mod/q.py", "internal"),
            ("r", "a/b/m.py", "os", "external"), ("r", "a/b/m.py", "...gone", "unresolved"), ("r", "w/v.ts", "w/u.ts", "internal"), ("r", "w/v.ts", "a/index.js", "internal"),
            ("r", "w/v.ts", "react", "external"), ("r", "w/v.ts", "./none", "unresolved"),
        ],
        key=repr,
    )
