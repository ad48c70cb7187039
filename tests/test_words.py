from pyspark.sql import functions as F

from skein.functions import verdicts, words


def one(spark, data, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(data, schema).coalesce(1).select(*cols).collect()]


def test_operation_ids(spark):
    cases = [
        ("GET", "/users", "getUsers"), ("POST", "/users", "createUser"), ("GET", "/users/:id", "getUserById"), ("PATCH", "/users/{id}", "updateUser"), ("PUT", "/users/{id}", "replaceUser"),
        ("DELETE", "/users/{id}", "deleteUserById"), ("DELETE", "/users", "deleteUsers"), ("POST", "/api/v2/categories", "createCategory"), ("GET", "/api/search/x", "searchResources"),
        ("GET", "/comments/{id}/reactions", "getCommentReaction"), ("GET", "/projects/{id}/dashboard/{day}", "getProjectDashboardByDay"), ("POST", "/comments/{id}/reactions", "createCommentReaction"),
        ("GET", "/", "getResource"), ("GET", "/{id}", "getResource"), ("OPTIONS", "/boxes", "optionsBox"), ("GET", "/people", "getPeople"), ("GET", None, "getResource"), ("GET", "/user-profiles", "getUserProfiles"),
    ]
    got = one(spark, cases, "m string, p string, want string", words.operation_id(F.col("m"), F.col("p")), "want")
    assert all(a == b for a, b in got), got


def test_words(spark):
    got = one(spark, [("companies", "company"), ("boxes", "box"), ("branches", "branch"), ("halves", "half"), ("heroes", "hero"), ("status", "status"), ("statuses", "status"), ("data", "datum"), ("is", "is"), ("bus", "bus"), (" ", "resource"), ("items", "item")], "w string, want string", words.singular(F.col("w")), "want")
    assert all(a == b for a, b in got), got
    got = one(spark, [("person", "people"), ("category", "categories"), ("day", "days"), ("box", "boxes"), ("status", "statuses"), ("item", "items")], "w string, want string", words.plural(F.col("w")), "want")
    assert all(a == b for a, b in got), got
    got = one(spark, [("deleteRestaurantDelete", "deleteRestaurant"), ("getGetUser", "getUser"), ("updateProfileUpdate", "updateProfile"), ("getUserUser", "getUser"), ("get", "getResource"), ("", "getResource"), (None, "getResource"), ("X", "X")], "w string, want string", words.strict_operation_id(F.col("w")), "want")
    assert all(a == b for a, b in got), got
    got = one(spark, [("a.b.run()", "run", "a"), ("a.b", "b", "a"), ("a", "a", "a"), ("", "", ""), (None, "", "")], "w string, leaf string, owner string", words.symbol_leaf(F.col("w")) == F.col("leaf"), words.symbol_owner(F.col("w")) == F.col("owner"))
    assert got == [(True, True)] * 5
    got = one(spark, [("GET", "/users", "List Users"), ("DELETE", "/api/users/{id}", "Delete User By Id"), ("PATCH", "/users/{id}/roles", "Update User roles".replace("roles", "Roles")), ("PUT", "/users/{id}", "Put User"), ("GET", "/", "List Resources")], "m string, p string, want string", words.route_summary(F.col("m"), F.col("p")), "want")
    assert all(a == b for a, b in got), got
    got = one(spark, [("https://h.test/a/b.git", "a/b"), ("git@h.test:a/b", "a/b"), ("https://h.test/b.git", None), ("https://other/a/b", None), (None, None)], "u string, want string", words.repo_slug(F.col("u"), "h.test"), "want")
    assert all(a == b for a, b in got), got


def test_verdicts(spark):
    p = F.col("p")
    got = one(
        spark,
        [("src/a.py", False, True), ("tests/a.py", True, False), ("src/Build/a.py", True, True), ("x/tsconfig.base.json", True, True), ("a/.env", True, False), ("a/b.bin", True, True), ("a/logo.PNG", True, False), ("web\\dist\\x.js", True, False), ("package-lock.json", True, False)],
        "p string, out boolean, safe boolean", verdicts.excluded(p) == F.col("out"), verdicts.safe_to_read(p) == F.col("safe"),
    )
    assert got == [(True, True)] * 9, got
    assert one(spark, [("a/gen/x.py",), ("a/x.py",)], "p string", verdicts.excluded(p, ["gen/", "*.tmp"])) == [(True,), (False,)]
    got = one(spark, [("corsAuth", "cors", "MINOR"), ("verifyToken", "auth", "MAJOR"), ("rateLimit", "rate_limiter", "PATCH"), ("json", "body_parser", "PATCH"), ("errorHandler", "error_handler", "MINOR"), ("x", "unknown", "MINOR")], "p string, t string, s string", verdicts.middleware_type(p) == F.col("t"), verdicts.middleware_severity(F.col("t")) == F.col("s"))
    assert got == [(True, True)] * 6
    got = one(spark, [(["jwtCheck", "adminRole"], "JWT+RBAC"), (["verify"], "JWT"), (["session"], "Session"), (["acl"], "RBAC"), (["cors"], "Public"), (None, "Public")], "p array<string>, want string", verdicts.auth_label(p) == F.col("want"))
    assert got == [(True,)] * 6
