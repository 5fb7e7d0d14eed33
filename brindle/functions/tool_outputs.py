"""Outputs of particular tools to canonical rows. Inputs are (doc_id, tool, text); every family has a structured reading (JSON, one
JSON a line, XML) before a textual one and reports its tier: full, degraded, or passthrough. All in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import lines_of

def _text() -> Column:
    return F.col("text")


def _num(rx: str) -> Column:
    """The first group as a number; null where the pattern does not occur."""
    return F.nullif(F.regexp_extract(_text(), rx, 1), F.lit("")).try_cast("bigint")


def _sum(rx: str) -> Column:
    """The sum of the first group over all matches; null without any."""
    found = F.regexp_extract_all(_text(), F.lit(rx), F.lit(1))
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x.try_cast("bigint"), F.lit(0))))


def _json(path: str) -> Column:
    return F.get_json_object(_text(), path)


def _events(schema: str) -> Column:
    """The JSON objects among the lines."""
    rows = F.filter(lines_of(_text()), lambda x: x.startswith("{"))
    return F.filter(F.transform(rows, lambda x: F.from_json(x, schema)), lambda x: x.isNotNull())


def _hits(rows: Column, test) -> Column:
    return F.size(F.filter(rows, test)).cast("bigint")


def _by_tool(cases: dict[str, Column], default: Column | None = None) -> Column:
    out = None
    for tool, value in cases.items():
        out = F.when(F.col("tool") == tool, value) if out is None else out.when(F.col("tool") == tool, value)
    return out if default is None else out.otherwise(default)


def test_results(outputs: DataFrame) -> DataFrame:
    """doc_id, tool, passed, failed, skipped, duration_ms, tier of cargo, nextest, go, pytest, vitest, playwright, cypress, dotnet
    and swift runs. Null and unread outputs have no counts."""
    counts = lambda p, f, s, d: F.struct(p.cast("bigint").alias("passed"), f.cast("bigint").alias("failed"), s.cast("bigint").alias("skipped"), d.cast("bigint").alias("duration_ms"))
    zero, none = F.lit(0), F.lit(None)
    ms = lambda rx: (F.nullif(F.regexp_extract(_text(), rx, 1), F.lit("")).try_cast("double") * 1000).cast("bigint")
    cargo, go = _events("type string, event string, name string, exec_time double"), _events("Action string, Test string, Elapsed double")
    case = lambda e: _hits(cargo, lambda x: (x["type"] == "test") & (x["event"] == e))
    step = lambda a: _hits(go, lambda x: (x["Action"] == a) & x["Test"].isNotNull())
    at = lambda n: _num(rf'<Counters\b[^>]*\b{n}="(\d+)"')
    structured = _by_tool({
        "cargo": F.when(F.exists(cargo, lambda x: x["type"] == "test"), counts(case("ok"), case("failed"), case("ignored"), none)),
        "go": F.when(F.exists(go, lambda x: x["Test"].isNotNull()), counts(step("pass"), step("fail"), step("skip"), none)),
        "vitest": F.when(_json("$.numTotalTests").isNotNull(), counts(_json("$.numPassedTests"), _json("$.numFailedTests"), F.coalesce(_json("$.numPendingTests"), F.lit("0")), none)),
        "playwright": F.when(_json("$.stats.expected").isNotNull(), counts(_json("$.stats.expected"), _json("$.stats.unexpected"), _json("$.stats.skipped"), _json("$.stats.duration").try_cast("double"))),
        "cypress": F.when(_json("$.stats.passes").isNotNull(), counts(_json("$.stats.passes"), _json("$.stats.failures"), _json("$.stats.pending"), _json("$.stats.duration").try_cast("double"))),
        "dotnet": F.when(at("total").isNotNull(), counts(at("passed"), at("failed"), F.coalesce(at("notExecuted"), zero), none)),
    })
    zeroed = lambda c: F.coalesce(c, zero)
    textual = _by_tool({
        "cargo": F.when(_text().rlike(r"test result: "), counts(zeroed(_sum(r"test result: .*?(\d+) passed")), zeroed(_sum(r"test result: .*?(\d+) failed")), zeroed(_sum(r"test result: .*?(\d+) ignored")), ms(r"finished in ([0-9.]+)s"))),
        "nextest": F.when(_text().rlike(r"Summary \["), counts(zeroed(_num(r"(\d+) passed")), zeroed(_num(r"(\d+) failed")), zeroed(_num(r"(\d+) skipped")), ms(r"Summary \[\s*([0-9.]+)s\]"))),
        "go": F.when(_text().rlike(r"(?m)^\s*--- (PASS|FAIL|SKIP):"), counts(*(F.regexp_count(_text(), F.lit(rf"(?m)^\s*--- {w}:")) for w in ("PASS", "FAIL", "SKIP")), none)),
        "dotnet": F.when(_text().rlike(r"Passed:\s*\d+"), counts(zeroed(_num(r"Passed:\s*(\d+)")), zeroed(_num(r"Failed:\s*(\d+)")), zeroed(_num(r"Skipped:\s*(\d+)")), none)),
        "swift": F.when(_text().rlike(r"Executed \d+ tests?"), counts(_num(r"Executed (\d+) tests?") - zeroed(_num(r"with (?:\d+ tests? skipped and )?(\d+) failures?")) - zeroed(_num(r"with (\d+) tests? skipped")), zeroed(_num(r"with (?:\d+ tests? skipped and )?(\d+) failures?")), zeroed(_num(r"with (\d+) tests? skipped")), ms(r"in ([0-9.]+) \("))),
    }, F.when(_text().rlike(r"\d+ (passed|failed)"), counts(zeroed(_num(r"(\d+) passed")), zeroed(_num(r"(\d+) failed")), zeroed(_num(r"(\d+) (?:skipped|pending|ignored)")), ms(r"in ([0-9.]+) ?s"))))
    rows = outputs.select("doc_id", "tool", structured.alias("a"), textual.alias("b"))
    tier = F.when(F.col("a").isNotNull(), "full").when(F.col("b").isNotNull(), F.when(F.col("tool").isin("pytest", "swift", "nextest"), "full").otherwise("degraded")).otherwise("passthrough")
    return rows.select("doc_id", "tool", F.coalesce("a", "b").alias("r"), tier.alias("tier")).select("doc_id", "tool", "r.passed", "r.failed", "r.skipped", "r.duration_ms", "tier")


ISSUE = "array<struct<file:string,line:bigint,severity:string,message:string,rule:string>>"


def _issue(file, line, severity, message, rule) -> Column:
    level = F.when(severity.isin("2", "error", "Error", "fatal"), "error").when(severity.isin("info", "note", "refactor", "convention"), "info").otherwise("warning")
    return F.struct(file.cast("string").alias("file"), line.cast("bigint").alias("line"), level.alias("severity"), message.cast("string").alias("message"), F.coalesce(rule.cast("string"), F.lit("unknown")).alias("rule"))


def tool_issues(outputs: DataFrame) -> DataFrame:
    """doc_id, tool, pos, file, line, severity, message, rule of eslint, ruff, mypy, golangci, biome, oxlint, rubocop and swiftlint
    reports and of formatters that list files (black, prettier, gofmt, rustfmt, dprint). An unread output gives no rows."""
    word = F.lit
    es = F.from_json(_text(), "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:string,message:string,line:bigint>>>>")
    ruff = F.from_json(_text(), "array<struct<filename:string,code:string,message:string,location:struct<row:bigint>>>")
    swift = F.from_json(_text(), "array<struct<file:string,line:bigint,reason:string,rule_id:string,severity:string>>")
    gol = F.from_json(_text(), "struct<Issues:array<struct<FromLinter:string,Text:string,Severity:string,Pos:struct<Filename:string,Line:bigint>>>>")["Issues"]
    cop = F.from_json(_text(), "struct<files:array<struct<path:string,offenses:array<struct<severity:string,message:string,cop_name:string,location:struct<line:bigint>>>>>>")["files"]
    ox = F.from_json(_text(), "struct<diagnostics:array<struct<filename:string,message:string,code:string,severity:string,labels:array<struct<span:struct<line:bigint>>>>>>")["diagnostics"]
    bio = F.from_json(_text(), "struct<diagnostics:array<struct<category:string,severity:string,description:string,location:struct<path:struct<file:string>>>>>")["diagnostics"]
    mypy = _events("file string, line bigint, message string, code string, severity string")
    none = F.lit(None)
    structured = _by_tool({
        "eslint": F.flatten(F.transform(es, lambda f: F.transform(f["messages"], lambda m: _issue(f["filePath"], m["line"], m["severity"], m["message"], m["ruleId"])))),
        "ruff": F.transform(ruff, lambda x: _issue(x["filename"], x["location"]["row"], word("error"), x["message"], x["code"])),
        "mypy": F.when(F.size(mypy) > 0, F.transform(mypy, lambda x: _issue(x["file"], x["line"], x["severity"], x["message"], x["code"]))),
        "golangci": F.transform(gol, lambda x: _issue(x["Pos"]["Filename"], x["Pos"]["Line"], F.coalesce(F.nullif(x["Severity"], word("")), word("warning")), x["Text"], x["FromLinter"])),
        "rubocop": F.flatten(F.transform(cop, lambda f: F.transform(f["offenses"], lambda o: _issue(f["path"], o["location"]["line"], o["severity"], o["message"], o["cop_name"])))),
        "swiftlint": F.transform(swift, lambda x: _issue(x["file"], x["line"], F.lower(x["severity"]), x["reason"], x["rule_id"])),
        "oxlint": F.transform(ox, lambda x: _issue(x["filename"], F.try_element_at(x["labels"], word(1))["span"]["line"], x["severity"], x["message"], x["code"])),
        "biome": F.transform(bio, lambda x: _issue(x["location"]["path"]["file"], none, x["severity"], x["description"], x["category"])),
    })
    listed = {"black": r"^would reformat (.+)$", "prettier": r"^\[warn\] (\S+\.\S+)$", "gofmt": r"^([^\s+@-].*\.go)$", "rustfmt": r"^Diff in (.+?)(?::| at line )\d+:?$", "dprint": r"^(?:from )?(/?\S+\.\w+):?$"}
    lines = lines_of(_text())
    files = lambda tool, rx: F.transform(F.filter(lines, lambda x: x.rlike(rx)), lambda x: _issue(F.regexp_extract(x, rx, 1), F.nullif(F.regexp_extract(x, r"(?::| at line )(\d+):?$", 1), word("")).try_cast("bigint"), word("warning"), word("not formatted"), word(f"{tool}/format")))
    rx = r"^\s*([^:\s][^:]*):(\d+):(?:\d+:)?\s*(?:(error|warning|note|info|[CWEFR]):?\s+)?(?:([A-Z]+\d+|[A-Z]\w+/\w+):?\s+)?(.*?)(?:\s+[\[(]([\w/-]+)[\])])?$"
    part = lambda x, i: F.regexp_extract(x, rx, i)
    one = lambda x: _issue(part(x, 1), part(x, 2), F.when(part(x, 3).isin("E", "F"), "error").when(part(x, 3) != "", part(x, 3)).otherwise("error"), part(x, 5), F.coalesce(F.nullif(part(x, 4), word("")), F.nullif(part(x, 6), word(""))))
    textual = _by_tool({tool: files(tool, r) for tool, r in listed.items()}, F.transform(F.filter(lines, lambda x: x.rlike(rx)), one))
    return outputs.select("doc_id", "tool", F.posexplode(F.coalesce(structured, textual)).alias("pos", "i")).select("doc_id", "tool", "pos", "i.*")


def build_results(outputs: DataFrame) -> DataFrame:
    """doc_id, tool, success, errors, warnings, duration_ms of cargo, make, tsc, gradle and maven builds."""
    count = lambda rx: F.coalesce(F.regexp_count(_text(), F.lit(rx)), F.lit(0)).cast("bigint")
    cargo = _events("reason string, message struct<level:string>")
    level = lambda w: _hits(cargo, lambda x: (x["reason"] == "compiler-message") & (x["message"]["level"] == w))
    json_lines = F.coalesce(F.size(cargo) > 0, F.lit(False))
    errors = _by_tool({
        "cargo": F.when(json_lines, level("error")).otherwise(count(r"(?m)^error(\[|:)")), "tsc": count(r"(?m)\berror TS\d+:"), "gradle": count(r"(?m)^(e: |.*\berror: |> Task \S+ FAILED)"),
        "maven": count(r"(?m)^\[ERROR\] .*:\[\d+,\d+\]"), "make": count(r"(?m)(\berror:|^make(\[\d+\])?: \*\*\*)"),
    }, count(r"(?mi)\berror\b[:\[]"))
    warnings = _by_tool({"cargo": F.when(json_lines, level("warning")).otherwise(count(r"(?m)^warning(\[|:)")), "gradle": count(r"(?m)^(w: |.*\bwarning: )"), "maven": count(r"(?m)^\[WARNING\] ")}, count(r"(?mi)\bwarning\b[:\[]"))
    won = _by_tool({"gradle": F.coalesce(_text().contains("BUILD SUCCESSFUL"), F.lit(False)), "maven": F.coalesce(_text().contains("BUILD SUCCESS"), F.lit(False))}, errors == 0)
    part = lambda rx, k: F.coalesce(F.nullif(F.regexp_extract(_text(), rx, 1), F.lit("")).try_cast("double"), F.lit(0)) * k
    took = F.when(_text().rlike(r"BUILD \w+ in \d"), part(r"BUILD \w+ in (?:.*? )?(\d+)m\b", 60_000) + part(r"BUILD \w+ in (?:\d+m )?(\d+)s", 1000)).when(_text().rlike(r"Total time:"), part(r"Total time:\s+(\d+):\d+ min", 60_000) + part(r"Total time:\s+(?:\d+:)?([0-9.]+)", 1000))
    return outputs.select("doc_id", "tool", won.alias("success"), errors.alias("errors"), warnings.alias("warnings"), took.cast("bigint").alias("duration_ms"))


def package_results(outputs: DataFrame) -> DataFrame:
    """doc_id, tool, added, removed, changed, outdated, critical, high, moderate, low, conflicts, tier of npm, pnpm, yarn, pip and cargo outputs:
    installs, audits, outdated lists and checks. Null where a kind of number is not in the output."""
    yarn = _events("type string, data struct<vulnerabilities:map<string,bigint>>")
    summary = F.try_element_at(F.filter(yarn, lambda x: x["type"] == "auditSummary"), F.lit(1))["data"]["vulnerabilities"]
    audit = F.from_json(_text(), "struct<metadata:struct<vulnerabilities:map<string,bigint>>>")["metadata"]["vulnerabilities"]
    advisories = F.from_json(_text(), "struct<vulnerabilities:struct<count:bigint>>")["vulnerabilities"]["count"]
    old_map = F.from_json(_text(), "map<string,struct<current:string,latest:string>>")
    old_list = F.from_json(_text(), "array<struct<name:string,version:string,latest_version:string>>")
    outdated = F.coalesce(F.when(_text().startswith("["), F.size(F.filter(old_list, lambda x: x["latest_version"].isNotNull()))), F.when(_text().startswith("{"), F.nullif(F.size(F.filter(F.map_values(old_map), lambda x: x["latest"].isNotNull())), F.lit(0))))
    grade = lambda k: F.coalesce(F.try_element_at(summary, F.lit(k)), F.try_element_at(audit, F.lit(k)), _num(rf"(?i)(\d+) {k}\b"))
    pip = F.regexp_extract(_text(), r"Successfully installed (.+)", 1)
    added = F.coalesce(_json("$.added").try_cast("bigint"), _num(r"\badded (\d+) packages?"), F.when(pip != "", F.size(F.split(F.trim(pip), r"\s+")).cast("bigint")), _num(r"(?m)^Packages: \+(\d+)"))
    rows = outputs.select(
        "doc_id", "tool", added.alias("added"), F.coalesce(_json("$.removed").try_cast("bigint"), _num(r"\bremoved (\d+) packages?"), _num(r"(?m)^Packages: (?:\+\d+ )?-(\d+)")).alias("removed"),
        F.coalesce(_json("$.changed").try_cast("bigint"), _num(r"\bchanged (\d+) packages?")).alias("changed"), outdated.cast("bigint").alias("outdated"), grade("critical").alias("critical"),
        F.coalesce(grade("high"), F.when(F.col("tool") == "cargo", advisories)).alias("high"), grade("moderate").alias("moderate"), grade("low").alias("low"),
        F.when(F.col("tool") == "pip", F.nullif(F.regexp_count(_text(), F.lit(r"(?m)^\S+ \S+ (has requirement|requires) ")), F.lit(0)).cast("bigint")).alias("conflicts"), (_text().startswith("{") | _text().startswith("[")).alias("json"),
    )
    some = F.coalesce("added", "removed", "changed", "outdated", "critical", "high", "moderate", "low", "conflicts").isNotNull()
    return rows.withColumn("tier", F.when(some & F.col("json"), "full").when(some, "degraded").otherwise("passthrough")).drop("json")


def infra_items(outputs: DataFrame) -> DataFrame:
    """doc_id, pos, label, value, tier of cloud, container and web tools: entries of a JSON object, of each object of an array or of
    lines, ``Key: value`` lines, plan summaries, resource records, or the cells of a table under its header. An output that
    none of these reads passes through: one row with its text as the value and no label."""
    pairs = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("value")))
    lines = F.filter(lines_of(_text()), lambda x: x.rlike(r"\S"))
    obj, arr = F.from_json(_text(), "map<string,string>"), F.from_json(_text(), "array<map<string,string>>")
    per_line = F.filter(F.transform(lines, lambda x: F.from_json(x, "map<string,string>")), lambda x: x.isNotNull())
    many = F.size(lines) > 1
    structured = F.when(_text().rlike(r"^\s*\["), F.flatten(F.transform(arr, pairs))).when(_text().rlike(r"^\s*\{") & many & F.forall(lines, lambda x: x.rlike(r"^\{.*\}\s*$")), F.flatten(F.transform(per_line, pairs))).when(_text().rlike(r"^\s*\{"), pairs(obj))
    plan = F.array(*(F.struct(F.lit(w).alias("label"), F.coalesce(F.nullif(F.regexp_extract(_text(), rf"(\d+) {rx}", 1), F.lit("")), F.lit("0")).alias("value")) for w, rx in (("add", "(?:to add|added)"), ("change", "(?:to change|changed)"), ("destroy", "(?:to destroy|destroyed)"))))
    record = r"^(\S+)\.\s+\d+\s+IN\s+([A-Z]+)\s+(.+)$"
    records = F.transform(F.filter(lines, lambda x: x.rlike(record)), lambda x: F.struct(F.concat_ws(" ", F.regexp_extract(x, record, 1), F.regexp_extract(x, record, 2)).alias("label"), F.regexp_extract(x, record, 3).alias("value")))
    keyed = r"^\s*<?\s*([A-Za-z][\w ./-]*?):\s+(\S.*?)\s*$"
    keys = F.transform(F.filter(lines, lambda x: x.rlike(keyed)), lambda x: F.struct(F.regexp_extract(x, keyed, 1).alias("label"), F.regexp_extract(x, keyed, 2).alias("value")))
    cells = lambda x: F.split(F.trim(x), r"\s{2,}|\t")
    header = F.try_element_at(lines, F.lit(1))
    table = F.flatten(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.zip_with(cells(header), cells(x), lambda h, c: F.struct(F.lower(h).alias("label"), c.alias("value")))))
    textual = F.when(F.col("tool").isin("terraform") & _text().rlike(r"(Plan|Apply complete!).*\d+ (to add|added)"), plan).when(F.exists(lines, lambda x: x.rlike(record)), records).when(header.rlike(r"^[A-Z][A-Z ()/_-]+(\s{2,}[A-Z][A-Z ()/_-]*)+\s*$") & many, table).when(F.size(keys) > 0, keys)
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    rows = outputs.select("doc_id", structured.alias("a"), textual.alias("b"), _text().alias("raw"))
    tier = F.when(some("a").isNotNull(), "full").when(some("b").isNotNull(), "degraded").otherwise("passthrough")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.col("raw").alias("value")))
    return rows.select("doc_id", F.posexplode(F.coalesce(some("a"), some("b"), whole)).alias("pos", "i"), tier.alias("tier")).select("doc_id", "pos", "i.label", "i.value", "tier")


def db_rows(outputs: DataFrame) -> DataFrame:
    """doc_id, columns, rows of psql, mysql (tabs or borders) and sqlite (pipes) results. Null or empty outputs have no columns."""
    lines = F.filter(lines_of(F.coalesce(_text(), F.lit(""))), lambda x: x.rlike(r"\S") & ~x.rlike(r"^[-+|= ]+$") & ~x.rlike(r"^\(\d+ rows?\)$") & ~x.rlike(r"^\d+ rows? in set"))
    split = lambda x: F.when(x.contains("\t"), F.split(x, "\t")).otherwise(F.split(F.regexp_replace(x, r"^\s*\||\|\s*$", ""), r"\|"))
    cells = F.transform(lines, lambda x: F.transform(split(x), lambda c: F.trim(c)))
    return outputs.select("doc_id", cells.alias("c")).select("doc_id", F.coalesce(F.try_element_at("c", F.lit(1)), F.array().cast("array<string>")).alias("columns"), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))).alias("rows"))


def vcs_results(outputs: DataFrame) -> DataFrame:
    """doc_id, tool, branch, hash, subject, files, insertions, deletions, updated, rejected of commit, push, fetch and show outputs."""
    made = r"(?m)^\[(\S+)(?: \(root-commit\))? ([0-9a-f]{7,40})\] (.*)$"
    show = F.col("tool") == "show"
    text = lambda rx, i=1: F.nullif(F.regexp_extract(_text(), rx, i), F.lit(""))
    moved = F.coalesce(F.regexp_count(_text(), F.lit(r"(?m)^(?:[ +*=-]\t\S+:\S+\t| [ +*-]? *(?:[0-9a-f]{7,}\.{2,3}[0-9a-f]{7,}|\[new [a-z]+\])\s)")), F.lit(0))
    lost = F.coalesce(F.regexp_count(_text(), F.lit(r"(?m)^(?:!\t| ! \[(?:remote )?rejected\])")), F.lit(0))
    return outputs.select(
        "doc_id", "tool", text(made).alias("branch"), F.coalesce(text(made, 2), F.when(show, text(r"(?m)^commit ([0-9a-f]{7,40})"))).alias("hash"), F.coalesce(text(made, 3), F.when(show, text(r"(?s)^commit .*?\n\n {4}([^\n]*)"))).alias("subject"),
        _num(r"(\d+) files? changed").alias("files"), F.coalesce(_num(r"(\d+) insertions?\(\+\)"), F.lit(0)).alias("insertions"), F.coalesce(_num(r"(\d+) deletions?\(-\)"), F.lit(0)).alias("deletions"), moved.cast("bigint").alias("updated"), lost.cast("bigint").alias("rejected"),
    )


def file_results(outputs: DataFrame) -> DataFrame:
    """doc_id, tool, entries, folders, files, text: listings are counted (a tree's own summary where it has one) and stay as they are."""
    n = F.size(F.filter(lines_of(F.coalesce(_text(), F.lit(""))), lambda x: x.rlike(r"\S") & ~x.rlike(r"^total \d+")))
    listing = F.col("tool") == "ls"
    folders = F.coalesce(_num(r"(\d+) director(?:y|ies)"), F.when(listing, F.coalesce(F.regexp_count(_text(), F.lit(r"(?m)^d[rwx-]{9}")), F.lit(0)).cast("bigint")))
    files = F.coalesce(_num(r"(?m), (\d+) files?$"), F.when(listing, F.coalesce(F.regexp_count(_text(), F.lit(r"(?m)^-[rwx-]{9}")), F.lit(0)).cast("bigint")))
    return outputs.select("doc_id", "tool", n.alias("entries"), folders.alias("folders"), files.alias("files"), "text")


def _first(rx: str, i: int = 1) -> Column:
    return F.nullif(F.regexp_extract(_text(), rx, i), F.lit(""))


def _every(rx: str, i: int = 1) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_text(), F.lit("")), F.lit(rx), F.lit(i)))


def _count_of(rx: str) -> Column:
    return F.coalesce(F.regexp_count(_text(), F.lit(rx)), F.lit(0)).cast("bigint")


def _tier(known: Column) -> Column:
    return F.when(F.coalesce(known, F.lit(False)), "full").otherwise("passthrough").alias("tier")


def script_results(outputs: DataFrame) -> DataFrame:
    """doc_id, package, script, success, exit_code, errors, tier of package scripts: the header's package and script, and how it ended."""
    head = r"(?m)^> (\S+@\S+) (\S+)\s*$"
    code = F.coalesce(_num(r"(?m)Exit status (\d+)"), _num(r"(?m)exit(?:ed with)? code:? (\d+)"))
    failed = _text().rlike(r"(?m)^(npm ERR!|npm error|\s*ELIFECYCLE|error Command failed)")
    return outputs.select("doc_id", _first(head).alias("package"), _first(head, 2).alias("script"), (~(failed | F.coalesce(code > 0, F.lit(False)))).alias("success"), code.alias("exit_code"), _count_of(r"(?mi)^(?:npm ERR!|npm error|(?!> ).*\berror\b)").alias("errors"), _tier(_first(head).isNotNull()))


def image_builds(outputs: DataFrame) -> DataFrame:
    """doc_id, steps, cached, image, success, tier of image builds in both progress layouts."""
    steps = F.coalesce(_num(r"(?m)^#\d+ \[(?:[\w-]+ )?\d+/(\d+)\]"), _num(r"(?m)^Step \d+/(\d+) :"))
    cached = _count_of(r"(?m)^#\d+ CACHED|^ ---> Using cache")
    image = F.coalesce(_first(r"writing image (sha256:[0-9a-f]+)"), _first(r"Successfully built ([0-9a-f]+)"))
    failed = _text().rlike(r"(?m)^#\d+ ERROR|^ERROR: failed|returned a non-zero code")
    return outputs.select("doc_id", steps.alias("steps"), cached.alias("cached"), image.alias("image"), (~failed).alias("success"), _tier(steps.isNotNull() | image.isNotNull()))


def name_lookups(outputs: DataFrame) -> DataFrame:
    """doc_id, server, names, addresses, error, tier of name server lookups; the server's own address is none of the answer's."""
    answer = r"(?m)^Name:\s*(\S+)\s*\nAddress:\s*(\S+)\s*$"
    server, error = _first(r"(?m)^Server:\s*(\S+)"), _first(r"(?m)^\*\* server can't find \S+: (\w+)")
    return outputs.select("doc_id", server.alias("server"), _every(answer).alias("names"), _every(answer, 2).alias("addresses"), error.alias("error"), _tier(server.isNotNull()))


def downloads(outputs: DataFrame) -> DataFrame:
    """doc_id, url, status, bytes, file, success, tier of downloads; the status is that of the last answer."""
    codes = F.regexp_extract_all(F.coalesce(_text(), F.lit("")), F.lit(r"awaiting response\.\.\. (\d{3})"), F.lit(1))
    saved = r"['‘]([^'’]+)['’] saved \[(\d+)"
    url = _first(r"(?m)^--\S.*?(https?://\S+)")
    return outputs.select("doc_id", url.alias("url"), F.try_element_at(codes, F.lit(-1)).cast("bigint").alias("status"), _first(saved, 2).cast("bigint").alias("bytes"), _first(saved).alias("file"), _first(saved).isNotNull().alias("success"), _tier(url.isNotNull()))


def descriptions(outputs: DataFrame) -> DataFrame:
    """doc_id, name, namespace, status, normal, warnings, tier of described resources, with their events counted by type."""
    key = lambda k: _first(rf"(?m)^{k}:[ \t]+(\S.*?)\s*$")
    return outputs.select("doc_id", key("Name").alias("name"), key("Namespace").alias("namespace"), key("Status").alias("status"), _count_of(r"(?m)^\s+Normal\s+\S").alias("normal"), _count_of(r"(?m)^\s+Warning\s+\S").alias("warnings"), _tier(key("Name").isNotNull()))


def check_runs(outputs: DataFrame) -> DataFrame:
    """doc_id, passed, failed, pending, skipped, failing, tier of lists of checks (name, state, time, address by tabs)."""
    state = lambda w: _count_of(rf"(?m)^[^\t\n]+\t(?:{w})\t")
    known = _count_of(r"(?m)^[^\t\n]+\t(?:pass|fail|pending|skipping)\t")
    return outputs.select("doc_id", state("pass").alias("passed"), state("fail").alias("failed"), state("pending").alias("pending"), state("skipping").alias("skipped"), _every(r"(?m)^([^\t\n]+)\tfail\t").alias("failing"), _tier(known > 0))


def diff_summary(body: DataFrame) -> DataFrame:
    """doc_id, file, hunks, added, removed, text of diff body lines (as ``parsers.diff_lines`` gives them), one row a file."""
    out = body.groupBy("doc_id", "file").agg(F.count_distinct("hunk").alias("hunks"), F.count_if(F.col("mark") == "+").alias("added"), F.count_if(F.col("mark") == "-").alias("removed"))
    return out.withColumn("text", F.format_string("%s (+%d -%d, %d hunks)", "file", "added", "removed", "hunks"))
