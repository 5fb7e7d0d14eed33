import json

from brindle.functions import tool_outputs as to


def _out(spark, rows):
    return spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id int, tool string, text string")


def test_test_runs(spark):
    rows = [
        ("cargo", '{"type":"suite","event":"started"}\n{"type":"test","event":"ok","name":"a"}\n{"type":"test","event":"failed","name":"b"}\n{"type":"test","event":"ignored","name":"c"}'),
        ("cargo", "test result: ok. 3 passed; 0 failed; 1 ignored; finished in 0.50s\ntest result: FAILED. 1 passed; 2 failed; 0 ignored; finished in 1s"),
        ("nextest", "     Summary [   1.250s] 5 tests run: 4 passed, 1 failed, 2 skipped"),
        ("go", '{"Action":"pass","Test":"TestA"}\n{"Action":"fail","Test":"TestB"}\n{"Action":"fail","Package":"p"}'),
        ("go", "--- PASS: TestA (0.00s)\n    --- FAIL: TestA/b (0.00s)"),
        ("pytest", "==== 3 passed, 1 failed, 2 skipped in 0.25s ===="),
        ("vitest", '{"numTotalTests":3,"numPassedTests":2,"numFailedTests":1}'),
        ("playwright", '{"stats":{"expected":4,"unexpected":1,"skipped":0,"duration":12.5}}'),
        ("cypress", '{"stats":{"passes":4,"failures":1,"pending":2,"duration":9}}'),
        ("dotnet", '<TestRun><Counters total="5" passed="4" failed="1" notExecuted="0" /></TestRun>'),
        ("dotnet", "Failed!  - Failed:     1, Passed:     2, Skipped:     0, Total:     3"),
        ("swift", "Executed 5 tests, with 2 failures (0 unexpected) in 0.5 (0.6) seconds"),
        ("pytest", "nothing"), ("go", ""), ("go", None),
    ]
    got = [(r.passed, r.failed, r.skipped, r.duration_ms, r.tier) for r in to.test_results(_out(spark, rows)).orderBy("doc_id").collect()]
    assert got[:12] == [
        (1, 1, 1, None, "full"), (4, 2, 1, 500, "degraded"), (4, 1, 2, 1250, "full"), (1, 1, 0, None, "full"), (1, 1, 0, None, "degraded"), (3, 1, 2, 250, "full"), (2, 1, 0, None, "full"),
        (4, 1, 0, 12, "full"), (4, 1, 2, 9, "full"), (4, 1, 0, None, "full"), (2, 1, 0, None, "degraded"), (3, 2, 0, 500, "full"),
    ]
    assert {g[4] for g in got[12:]} == {"passthrough"}


def test_lint_reports(spark):
    rows = [
        ("eslint", json.dumps([{"filePath": "a.js", "messages": [{"ruleId": "semi", "severity": 2, "message": "m", "line": 3}, {"ruleId": None, "severity": 1, "message": "n", "line": 4}]}, {"filePath": "b.js", "messages": []}])),
        ("ruff", json.dumps([{"filename": "a.py", "code": "F401", "message": "unused", "location": {"row": 1, "column": 2}}])),
        ("mypy", '{"file":"a.py","line":2,"message":"bad","code":"arg-type","severity":"error"}\nFound 1'),
        ("golangci", json.dumps({"Issues": [{"FromLinter": "errcheck", "Text": "t", "Severity": "", "Pos": {"Filename": "a.go", "Line": 7}}]})),
        ("rubocop", json.dumps({"files": [{"path": "a.rb", "offenses": [{"severity": "convention", "message": "m", "cop_name": "Style/X", "location": {"line": 5}}]}]})),
        ("swiftlint", json.dumps([{"file": "a.swift", "line": 1, "reason": "r", "rule_id": "line_length", "severity": "Warning"}])),
        ("oxlint", json.dumps({"diagnostics": [{"filename": "a.ts", "message": "m", "code": "eslint(no-x)", "severity": "error", "labels": [{"span": {"line": 9}}]}]})),
        ("biome", json.dumps({"diagnostics": [{"category": "lint/a", "severity": "error", "description": "d", "location": {"path": {"file": "a.ts"}}}]})),
        ("black", "would reformat a.py\nOh no!"), ("prettier", "Checking formatting...\n[warn] src/a.ts\n[warn] Code style issues"), ("gofmt", "a.go\nb/c.go"), ("rustfmt", "Diff in /x/a.rs at line 4:\n-x"),
        ("ruff", "a.py:3:1: F401 unused import"), ("mypy", "a.py:3: error: bad thing  [arg-type]"), ("eslint", "nothing here"), ("ruff", None),
    ]
    got = [(r.tool, r.file, r.line, r.severity, r.rule) for r in to.tool_issues(_out(spark, rows)).orderBy("doc_id", "pos").collect()]
    assert got == [
        ("eslint", "a.js", 3, "error", "semi"), ("eslint", "a.js", 4, "warning", "unknown"), ("ruff", "a.py", 1, "error", "F401"), ("mypy", "a.py", 2, "error", "arg-type"), ("golangci", "a.go", 7, "warning", "errcheck"),
        ("rubocop", "a.rb", 5, "info", "Style/X"), ("swiftlint", "a.swift", 1, "warning", "line_length"), ("oxlint", "a.ts", 9, "error", "eslint(no-x)"), ("biome", "a.ts", None, "error", "lint/a"),
        ("black", "a.py", None, "warning", "black/format"), ("prettier", "src/a.ts", None, "warning", "prettier/format"), ("gofmt", "a.go", None, "warning", "gofmt/format"), ("gofmt", "b/c.go", None, "warning", "gofmt/format"),
        ("rustfmt", "/x/a.rs", 4, "warning", "rustfmt/format"), ("ruff", "a.py", 3, "error", "F401"), ("mypy", "a.py", 3, "error", "arg-type"),
    ]


def test_builds_and_packages(spark):
    rows = [
        ("cargo", '{"reason":"compiler-message","message":{"level":"error"}}\n{"reason":"compiler-message","message":{"level":"warning"}}\n{"reason":"build-finished"}'),
        ("cargo", "warning: unused\nerror[E0308]: mismatched"), ("tsc", "a.ts(3,1): error TS2322: bad\nb.ts(1,1): error TS1: x"), ("gradle", "w: x\nBUILD SUCCESSFUL in 1m 3s"), ("maven", "[WARNING] w\n[ERROR] /a/B.java:[3,4] bad\n[INFO] BUILD FAILURE\n[INFO] Total time:  2.500 s"), ("make", "a.c:1: error: x\nmake: *** [a] Error 1"), ("make", None),
    ]
    got = [(r.success, r.errors, r.warnings, r.duration_ms) for r in to.build_results(_out(spark, rows)).orderBy("doc_id").collect()]
    assert got == [(False, 1, 1, None), (False, 1, 1, None), (False, 2, 0, None), (True, 0, 1, 63000), (False, 1, 1, 2500), (False, 2, 0, None), (True, 0, 0, None)]
    rows = [
        ("npm", "added 12 packages, removed 1 package, changed 2 packages in 3s"), ("npm", '{"added":3,"removed":0,"changed":1}'), ("npm", '{"metadata":{"vulnerabilities":{"low":1,"moderate":2,"high":3,"critical":0}}}'),
        ("yarn", '{"type":"auditAdvisory","data":{}}\n{"type":"auditSummary","data":{"vulnerabilities":{"low":4,"high":1}}}'), ("npm", '{"a":{"current":"1","latest":"2"},"b":{"current":"1","latest":"3"}}'), ("pip", '[{"name":"a","version":"1","latest_version":"2"}]'),
        ("pip", "Successfully installed a-1 b-2"), ("pip", "a 1.0 requires b, which is not installed."), ("cargo", '{"vulnerabilities":{"count":2}}'), ("npm", "hm"),
    ]
    got = [(r.added, r.removed, r.changed, r.outdated, r.critical, r.high, r.low, r.conflicts, r.tier) for r in to.package_results(_out(spark, rows)).orderBy("doc_id").collect()]
    n = None
    assert got == [
        (12, 1, 2, n, n, n, n, n, "degraded"), (3, 0, 1, n, n, n, n, n, "full"), (n, n, n, n, 0, 3, 1, n, "full"), (n, n, n, n, n, 1, 4, n, "full"), (n, n, n, 2, n, n, n, n, "full"), (n, n, n, 1, n, n, n, n, "full"),
        (2, n, n, n, n, n, n, n, "degraded"), (n, n, n, n, n, n, n, 1, "degraded"), (n, n, n, n, n, 2, n, n, "full"), (n, n, n, n, n, n, n, n, "passthrough"),
    ]


def test_infra_tables_and_history(spark):
    rows = [
        ("aws", '{"Name":"x","Size":3}'), ("docker", '{"ID":"1"}\n{"ID":"2"}'), ("gh", '[{"n":1},{"n":2}]'), ("terraform", "Plan: 2 to add, 0 to change, 1 to destroy."), ("dig", "a.org.  300 IN A 1.2.3.4"),
        ("kubectl", "NAME   READY   STATUS\npod-a   1/1   Running"), ("kubectl", "Name:   x\nStatus:  Up"), ("curl", None), ("aws", "text"),
    ]
    got = [(r.doc_id, r.label, r.value) for r in to.infra_items(_out(spark, rows)).orderBy("doc_id", "pos").collect()]
    assert got == [
        (0, "Name", "x"), (0, "Size", "3"), (1, "ID", "1"), (1, "ID", "2"), (2, "n", "1"), (2, "n", "2"), (3, "add", "2"), (3, "change", "0"), (3, "destroy", "1"), (4, "a.org A", "1.2.3.4"),
        (5, "name", "pod-a"), (5, "ready", "1/1"), (5, "status", "Running"), (6, "Name", "x"), (6, "Status", "Up"), (7, None, None), (8, None, "text"),
    ]
    rows = [("psql", " id | n\n----+---\n 1 | a\n(1 row)"), ("mysql", "id\tn\n1\ta"), ("mysql", "+--+--+\n| id | n |\n+--+--+\n| 1 | a |\n+--+--+\n1 row in set"), ("sqlite3", "id|n\n1|a"), ("psql", "")]
    got = [(r.columns, r.rows) for r in to.db_rows(_out(spark, rows)).orderBy("doc_id").collect()]
    assert got == [(["id", "n"], [["1", "a"]])] * 4 + [([], [])]
    rows = [
        ("commit", "[main abc1234] fix it\n 2 files changed, 3 insertions(+), 1 deletion(-)"), ("push", "To x\n \trefs/heads/a:refs/heads/a\tabc1234..def5678\n!\trefs/heads/b:refs/heads/b\t[rejected]"),
        ("fetch", "From x\n   abc1234..def5678  main       -> origin/main\n * [new branch]      b          -> origin/b"), ("show", "commit abc1234def\nAuthor: A\nDate: D\n\n    subject\n\n    body"), ("show", None),
    ]
    got = [(r.branch, r.hash, r.subject, r.files, r.insertions, r.deletions, r.updated, r.rejected) for r in to.vcs_results(_out(spark, rows)).orderBy("doc_id").collect()]
    assert got == [("main", "abc1234", "fix it", 2, 3, 1, 0, 0), (None,) * 4 + (0, 0, 1, 1), (None,) * 4 + (0, 0, 2, 0), (None, "abc1234def", "subject", None, 0, 0, 0, 0), (None,) * 4 + (0, 0, 0, 0)]
    rows = [("tree", ".\n|-- a\n\n3 directories, 14 files"), ("ls", "total 8\ndrwxr-xr-x 2 r r 1 a\n-rw-r--r-- 1 r r 1 b"), ("wc", " 3 a"), ("find", None)]
    got = [(r.entries, r.folders, r.files) for r in to.file_results(_out(spark, rows)).orderBy("doc_id").collect()]
    assert got == [(3, 3, 14), (2, 1, 1), (1, None, None), (0, None, None)]


def test_scripts_images_names_downloads_descriptions_checks(spark):
    rows = [("npm", "> app@1.0.0 build\n> tsc -p .\n\nerror TS1\nnpm ERR! code ELIFECYCLE\nnpm ERR! Exit status 2"), ("npm", "> app@1.0.0 test\n> x\nok"), ("npm", "hm"), ("npm", None)]
    got = [(r.package, r.script, r.success, r.exit_code, r.tier) for r in to.script_results(_out(spark, rows)).orderBy("doc_id").collect()]
    assert got == [("app@1.0.0", "build", False, 2, "full"), ("app@1.0.0", "test", True, None, "full"), (None, None, True, None, "passthrough"), (None, None, None, None, "passthrough")]
    rows = [("docker", "#1 [internal] load\n#4 [1/3] FROM x\n#4 CACHED\n#5 [2/3] RUN a\n#5 DONE 1.5s\n#6 [3/3] COPY . .\n#7 writing image sha256:abc123 done"), ("docker", "Step 1/2 : FROM x\n ---> Using cache\nStep 2/2 : RUN y\nSuccessfully built 0a1b2c"), ("docker", "#5 [2/3] RUN a\n#5 ERROR: exit code: 1"), ("docker", None)]
    got = [(r.steps, r.cached, r.image, r.success, r.tier) for r in to.image_builds(_out(spark, rows)).orderBy("doc_id").collect()]
    assert got == [(3, 1, "sha256:abc123", True, "full"), (2, 1, "0a1b2c", True, "full"), (3, 0, None, False, "full"), (None, 0, None, None, "passthrough")]
    rows = [("nslookup", "Server:\t\t10.0.0.1\nAddress:\t10.0.0.1#53\n\nNon-authoritative answer:\nName:\ta.org\nAddress: 1.2.3.4\nName:\ta.org\nAddress: 1.2.3.5"), ("nslookup", "Server: x\n\n** server can't find b.org: NXDOMAIN"), ("nslookup", "")]
    got = [(r.server, r.names, r.addresses, r.error, r.tier) for r in to.name_lookups(_out(spark, rows)).orderBy("doc_id").collect()]
    assert got == [("10.0.0.1", ["a.org"], ["1.2.3.4", "1.2.3.5"], None, "full"), ("x", [], [], "NXDOMAIN", "full"), (None, [], [], None, "passthrough")]
    rows = [("wget", "--2024-- https://a.org/x\nHTTP request sent, awaiting response... 302 Found\nHTTP request sent, awaiting response... 200 OK\nLength: 500 (500) [text/html]\n'x' saved [500/500]"), ("wget", "--2024-- http://a.org/y\nHTTP request sent, awaiting response... 404 Not Found\nERROR 404: Not Found."), ("wget", "z")]
    got = [(r.url, r.status, r.bytes, r.file, r.success, r.tier) for r in to.downloads(_out(spark, rows)).orderBy("doc_id").collect()]
    assert got == [("https://a.org/x", 200, 500, "x", True, "full"), ("http://a.org/y", 404, None, None, False, "full"), (None, None, None, None, False, "passthrough")]
    rows = [("kubectl", "Name:  p\nNamespace: n\nStatus:  Running\nLabels: a=b\nEvents:\n  Type Reason\n  ---- ------\n  Normal  Pulled  x\n  Warning  BackOff y\n  Warning  Failed z"), ("kubectl", "no")]
    got = [(r.name, r.namespace, r.status, r.normal, r.warnings, r.tier) for r in to.descriptions(_out(spark, rows)).orderBy("doc_id").collect()]
    assert got == [("p", "n", "Running", 1, 2, "full"), (None, None, None, 0, 0, "passthrough")]
    rows = [("gh", "build\tpass\t1m\thttps://x\nlint\tfail\t2s\thttps://y\ndeploy\tpending\t0\thttps://z\nskip me\tskipping\t0\t"), ("gh", "no checks")]
    got = [(r.passed, r.failed, r.pending, r.skipped, r.failing, r.tier) for r in to.check_runs(_out(spark, rows)).orderBy("doc_id").collect()]
    assert got == [(1, 1, 1, 1, ["lint"], "full"), (0, 0, 0, 0, [], "passthrough")]
