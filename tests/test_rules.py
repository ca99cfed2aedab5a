"""Rules on literal facts."""

import pytest

from lodeworks import rules
from lodeworks.operators import complexity
from lodeworks.rules import code, packages, shapes
from lodeworks.run import Options, config_of, find_config, parse, run
from lodeworks.sources.config_leaves import flatten_json
from lodeworks.sources.facts import SCHEMAS, Facts
from lodeworks.sources.projects import read_inbox, read_lock, read_numstat, read_projects


def facts(spark, **tables):
    return Facts(spark, tables={k: spark.createDataFrame([{c.split()[0]: r.get(c.split()[0]) for c in SCHEMAS[k].split(", ")} for r in v], SCHEMAS[k]) for k, v in tables.items()})


def decl(symbol, **more):
    base = dict(symbol_id=symbol, kind="method", name=symbol, accessibility="private", path="a.cs", line=1, ch=0, is_static=False, is_virtual=False, is_override=False, is_abstract=False, is_sealed=False, attributes=[], has_friends=False, span_end=1)
    return base | more


def symbols(df):
    return sorted(r.symbol_id for r in df.collect())


def test_unused_private(spark):
    f = facts(spark, declarations=[decl("a"), decl("b"), decl("c", attributes=["Fact"]), decl("d", attributes=["DataMember"]), decl("e", accessibility="public")], references=[dict(symbol_id="b", path="a.cs")])
    assert symbols(code.unused_private(f)) == ["a"]


def test_unreachable_first_of_a_block(spark):
    s = lambda b, i, **k: dict(block_id=b, path="a.cs", ord=i, line=i, exits=False, start_reachable=True, kind="expression") | k
    f = facts(spark, statements=[s("x", 1, exits=True), s("x", 2, kind="empty"), s("x", 3), s("x", 4), s("y", 1), s("y", 2)])
    assert [r.line_number for r in code.unreachable(f).collect()] == [3]


def test_write_only_and_event(spark):
    r = lambda s, k, **m: dict(symbol_id=s, path="a.cs", kind=k, is_candidate=False, is_subscription=False) | m
    f = facts(
        spark,
        declarations=[decl("w", kind="field"), decl("rw", kind="field"), decl("n", kind="field"), decl("ev", kind="event"), decl("ev2", kind="event"), decl("ev3", kind="event")],
        references=[r("w", "write"), r("w", "nameof"), r("rw", "write"), r("rw", "read"), r("ev", "x", is_subscription=True), r("ev2", "x")],
    )
    assert symbols(code.write_only(f)) == ["w"]
    assert symbols(code.event_never_raised(f)) == ["ev", "ev3"]


def test_unused_parameter_only_of_directly_called(spark):
    r = lambda s, d: dict(symbol_id=s, path="a.cs", is_direct_invocation=d)
    f = facts(spark, declarations=[decl("m"), decl("m2"), decl("m3"), *(decl("p" + m, kind="parameter", type_id=m) for m in ("m", "m2", "m3"))], references=[r("m", True), r("m2", True), r("m2", False)])
    assert symbols(code.unused_parameter(f)) == ["pm"]


def test_public_rescues(spark):
    f = facts(
        spark,
        declarations=[decl("T", kind="type", accessibility="public"), decl("S", kind="type", accessibility="public"), decl("I", accessibility="public"), decl("N", kind="type", accessibility="public")],
        references=[dict(symbol_id="IC", path="a.cs")],
        implements=[dict(symbol_id="I", contract_symbol_id="IC")],
        type_edges=[dict(type_id="x", used_type_id="T", via="serialized"), dict(type_id="T", used_type_id="N", via="property")],
    )
    assert symbols(code.unused_public(f)) == ["S"]


def test_using_prefers_the_global_diagnostic(spark):
    u = lambda pos, d, name="A": dict(path="a.cs", pos=pos, name=name, is_global=False, is_static=False, diagnostic=d, line=pos)
    f = facts(spark, usings=[u(1, None), u(2, "CS8019"), u(2, "CS8933"), u(3, "CS8019", "B")])
    assert sorted(r.message for r in code.unused_using(f).collect()) == ["Repeated using 'A'", "Unnecessary using 'B'"]


def test_virtual_and_families(spark):
    f = facts(
        spark,
        declarations=[decl("C", kind="type", accessibility="public"), decl("v", is_virtual=True, accessibility="public", type_id="C"), decl("D", kind="type", accessibility="public"), decl("w", is_virtual=True, accessibility="public", type_id="D", line=10, span_end=12), decl("w2", is_override=True, line=20, span_end=22)],
        references=[dict(symbol_id=s, path="a.cs", line=n) for s, n in (("C", 50), ("v", 51), ("D", 52), ("w", 21))],
        inherits=[dict(derived_id="E", base_id="D")],
        overrides=[dict(symbol_id="w2", base_symbol_id="w")],
    )
    assert symbols(code.never_overridden(f)) == ["C"]
    assert symbols(code.closed_family(f)) == ["w"]


def test_commented_code(spark):
    c = lambda n, t, kind="line": dict(path="a.cs", line=n, ch=0, kind=kind, text=t)
    f = facts(spark, comments=[c(i, f"// var x{i} = {i};") for i in range(13, 16)] + [c(19, "// if (a) {"), c(20, "// }")] + [c(30, "// TODO: x;"), c(31, "// y;")] + [c(40, "// just"), c(41, "// prose here")] + [c(1, "// Licensed under MIT;"), c(2, "// x;")] + [c(50, "/* a();\n b(); */", "block")])
    assert sorted(r.line_number for r in shapes.commented_code(f).collect()) == [13, 19, 50]


def test_redundant_packages(spark):
    def f(required, also=True):
        return facts(
            spark,
            package_refs=[dict(path="p", id="Serilog", min_version="4.0.0", line=1), dict(path="p", id="Serilog.Sinks.Console", min_version="6.0.0", line=2)],
            lock_packages=[dict(path="p", tfm="net8.0", id="Serilog", version="4.0.0"), dict(path="p", tfm="net8.0", id="Serilog.Sinks.Console", version="6.0.0")],
            lock_deps=[dict(path="p", tfm="net8.0", id="Serilog.Sinks.Console", dep_id="Serilog", min_version=required)] if also else [],
        )

    assert [r.line_number for r in packages.redundant_package(f("4.0.0")).collect()] == [1]
    assert not packages.redundant_package(f("3.9.0")).collect() and not packages.redundant_package(f("4.0.0", False)).collect()


def test_unused_package_and_consumers(spark):
    base = dict(
        projects=[dict(path=p, assembly_name=p, is_loaded=True, tfms=["net8.0"]) for p in "ab"],
        package_refs=[dict(path="a", id="P", min_version="1.0", line=3)],
        package_assemblies=[dict(path="a", id="P", assembly="P.dll")],
    )
    assert [r.certainty for r in packages.unused_package(facts(spark, **base)).collect()] == [2]
    used = base | dict(project_refs=[dict(path="b", ref_path="a", private_all=False)], used_assemblies=[dict(path="b", assembly="P.dll")])
    assert not packages.unused_package(facts(spark, **used)).collect()
    private = used | dict(package_refs=[base["package_refs"][0] | dict(private_all=True)])
    assert len(packages.unused_package(facts(spark, **private)).collect()) == 1


def test_exclusive_packages_hold_direct_ones(spark):
    f = facts(
        spark,
        package_refs=[dict(path="p", id=i, line=1) for i in ("A", "B", "C")],
        lock_deps=[dict(path="p", tfm="t", id=a, dep_id=b) for a, b in (("A", "B"), ("A", "X"), ("B", "Y"), ("C", "Z"), ("A", "Z"))],
    )
    got = {(r.id, r.node) for r in packages.package_subtree(f).collect()}
    assert got == {("a", "b"), ("a", "x")}  # Y stays through B itself, Z through C


def test_names_inside_longer_words(spark):
    names = spark.createDataFrame([("a", "Acme.Core"), ("b", "Acme.Web"), ("c", "Xy")], "path string, assembly_name string")
    texts = spark.createDataFrame([("t", 'load("Acme.Corelib")'), ("b", "Acme.Web")], "path string, text string")
    assert sorted(r.path for r in packages.spelled(names, texts).collect()) == ["a", "c"]


def test_entry_types_and_skipped_documents(spark):
    f = facts(
        spark,
        declarations=[
            decl("Home", kind="type"), decl("show", type_id="Home"), decl("Job", kind="type"), decl("Tests", kind="type"), decl("case", type_id="Tests", attributes=["TheoryAttribute"]), decl("help", type_id="Tests"),
            decl("Plain", kind="type"), decl("go", type_id="Plain"), decl("bench", attributes=["Benchmark"]), decl("made", path="x/obj/m.cs"), decl("head", path="h.cs"), decl("far", path="/else/f.cs"),
        ],
        inherits=[dict(derived_id="Home", base_id="Base"), dict(derived_id="Base", base_id="Web.ControllerBase"), dict(derived_id="Job", base_id="IConsumer`1")],
        documents=[dict(path=p, is_generated=False) for p in ("a.cs", "x/obj/m.cs", "h.cs", "/else/f.cs")],
        comments=[dict(path="h.cs", line=1, text="// <auto-generated/>"), dict(path="a.cs", line=9, text="// <auto-generated/>")],
        tokens=[dict(path=p, idx=0, tok="class", line=3) for p in ("h.cs", "a.cs")],
        roots=[dict(folder="a.cs"), dict(folder="x"), dict(folder="h.cs")],
    )
    assert sorted(r.symbol_id for r in f.live_declarations.collect()) == ["Plain", "go"]


def test_empty_members_and_static(spark):
    f = facts(
        spark,
        declarations=[
            decl("T", kind="type"), decl("c", kind="constructor", type_id="T", accessibility="public", is_empty=True, parameters=0), decl("d", kind="destructor", type_id="T", is_empty=True), decl("U", kind="type"),
            decl("c1", kind="constructor", type_id="U", accessibility="public", is_empty=True, parameters=0), decl("c2", kind="constructor", type_id="U", accessibility="public", parameters=1),
            decl("s", uses_instance=False), decl("i", uses_instance=True), decl("unknown"),
        ],
    )
    assert symbols(shapes.empty_member(f)) == ["c", "d"]
    assert [r.symbol_id for r in code.tighten(f).collect() if "static" in r.message] == ["s"]


def test_tests_are_not_measured(spark):
    nodes = [dict(body_id=b, node_id=i, parent_id=None, ord=i, kind="if", line=i) for b in ("m", "t") for i in range(20)]
    f = facts(spark, ast_nodes=nodes, declarations=[decl("m", path="src/a.cs"), decl("t", path="test/a.cs")])
    assert symbols(shapes.cyclomatic(f)) == ["m"] and symbols(shapes.cognitive(f)) == ["m"]


def test_namespace_of_a_place(spark):
    from lodeworks.operators.relations import namespace_of

    p = spark.createDataFrame([("a", 1), ("a", 5), ("a", 8), ("b", 3), ("c", 1)], "path string, line int")
    n = spark.createDataFrame([("a", "A", 3, 10, False), ("a", "A.B", 7, 9, False), ("b", "N", 1, None, True)], "path string, name string, line int, end_line int, file_scoped boolean")
    assert {(r.path, r.line): r.namespace for r in namespace_of(p, n).collect()} == {("a", 1): None, ("a", 5): "A", ("a", 8): "A.B", ("b", 3): "N", ("c", 1): None}


def test_orphans(spark):
    p = lambda n, **k: dict(path=n + ".csproj", assembly_name=n, output_type="Library", is_test=False, is_loaded=True, tfms=[]) | k
    f = facts(spark, projects=[p("App", output_type="Exe"), p("Core"), p("Orphan"), p("Plugin"), p("Tests", is_test=True), p("Loose", is_loaded=False)], project_refs=[dict(path="App.csproj", ref_path="Core.csproj")], spelled_names=[dict(path="x.json", text='load "Plugin" now')])
    assert sorted(r.file_path for r in packages.orphan(f).collect()) == ["Loose.csproj", "Orphan.csproj"]


def test_config_rules(spark):
    f = facts(spark, config_leaves=[dict(file="s.json", key=k, line=1) for k in ("SalesService:BaseUrl", "LegacySection:OldKey", "Logging:Level")], option_leaves=[dict(type_id="SalesOptions", path="SalesService", property=p) for p in ("BaseUrl", "Retries")])
    assert [r.message for r in packages.unbound_key(f).collect()] == ["Key 'LegacySection:OldKey' is bound to no option"]
    assert [r.message for r in packages.unset_option(f).collect()] == ["Option 'Retries' is never configured"]


def test_flatten_json(spark):
    df = spark.createDataFrame([("a", '{"S":{"U":"x","N":{"D":1}},"L":[1,2],"E":{}}'), ("b", "3"), ("c", "{bad")], "file string, json string")
    assert {(r.key, r.value) for r in flatten_json(df, "json").collect()} == {("S:U", "x"), ("S:N:D", "1"), ("L", "[1,2]")}


def test_flatten_json_of_any_depth(spark):
    deep = "1"
    for k in range(21):
        deep = f'{{"k{k}": {deep}}}'
    df = spark.createDataFrame([("a", deep)], "file string, json string")
    assert [tuple(r) for r in flatten_json(df, "json").collect()] == [("a", ":".join(f"k{k}" for k in reversed(range(21))), "1")]


def test_complexity(spark):
    n = lambda i, p, kind, **k: dict(body_id="m", node_id=i, parent_id=p, ord=i, kind=kind, line=i) | k
    # for { for { if } else } , a && b && c || d
    nodes = [n(0, None, "body"), n(1, 0, "for"), n(2, 1, "for"), n(3, 2, "if"), n(4, 3, "else"), n(5, 0, "expression"), n(6, 5, "and", operator="and"), n(7, 5, "and", operator="and"), n(8, 5, "or", operator="or")]
    f = facts(spark, ast_nodes=nodes)
    assert [tuple(r) for r in complexity.cyclomatic(f["ast_nodes"]).collect()] == [("m", 7)]
    assert [tuple(r) for r in complexity.cognitive(f["ast_nodes"]).collect()] == [("m", 1 + 2 + 3 + 1 + 2)]


def test_clone_sets_and_drift(spark):
    tokens = [dict(path=p, idx=i, tok=f"t{i}", line=i // 8 + 1, ch=0) for p in ("x/a.cs", "y/b.cs") for i in range(80)]
    more = dict(
        commits=[dict(sha="new", log_pos=0, is_merge=False), dict(sha="old", log_pos=1, is_merge=False)],
        commit_files=[dict(sha="new", path="x/a.cs"), dict(sha="old", path="y/b.cs"), dict(sha="old", path="x/a.cs")],
        hunks=[dict(sha="new", path="x/a.cs", old_start=3, old_count=1, new_start=3, new_count=1, added=["if (x is null) return;"], removed=["Go();"], changed_new_lines=[3], is_file_creation=False)],
    )
    f = facts(spark, tokens=tokens, **more)
    dup = shapes.duplicated(f).collect()
    assert [(r.file_path, r.line_number, [x.file_path for x in r.related]) for r in dup] == [("x/a.cs", 1, ["y/b.cs"])]
    assert [(r.file_path, r.line_number, r.certainty) for r in shapes.drifted(f).collect()] == [("x/a.cs", 3, 2)]
    both = facts(spark, tokens=tokens, **more | dict(commit_files=more["commit_files"] + [dict(sha="new", path="y/b.cs")]))
    assert not shapes.drifted(both).collect()


def test_project_files(spark):
    text = '<Project Sdk="Microsoft.NET.Sdk">\n<PropertyGroup><TargetFrameworks>net8.0;net9.0</TargetFrameworks><OutputType>Exe</OutputType></PropertyGroup>\n<ItemGroup>\n<PackageReference Include="A" Version="1.0" PrivateAssets="all" />\n<PackageReference Update="B"><Version>2.0</Version></PackageReference>\n<ProjectReference Include="..\\Core\\Core.csproj" />\n</ItemGroup></Project>'
    broken = "<Project><PropertyGroup><OutputType>Exe</PropertyGroup></Project>"
    t = read_projects(spark.createDataFrame([("/w/App/App.csproj", text), ("/w/bad.csproj", "no xml"), ("/w/broken.csproj", broken), ("/w/none.csproj", None)], "path string, text string"))
    p = t["projects"].collect()
    assert [(r.assembly_name, r.sdk, r.output_type, r.is_test, r.tfms) for r in p] == [("App", "Microsoft.NET.Sdk", "Exe", False, ["net8.0", "net9.0"])]
    assert sorted((r.id, r.min_version, r.private_all, r.line) for r in t["package_refs"].collect()) == [("A", "1.0", True, 4), ("B", "2.0", False, 5)]
    assert [(r.ref_path, r.line) for r in t["project_refs"].collect()] == [("/w/Core/Core.csproj", 6)]


def test_project_file_with_comments(spark):
    text = '<Project>\n<!-- a\nb <PackageReference Include="Z" Version="9" />\n-->\n<ItemGroup>\n<PackageReference Include="A" Version="[1.5.0, 2.0)" />\n</ItemGroup>\n<PropertyGroup><TargetFramework>net8.0</TargetFramework></PropertyGroup></Project>'
    t = read_projects(spark.createDataFrame([("/w/A.csproj", text)], "path string, text string"))
    assert [(r.id, r.min_version, r.line) for r in t["package_refs"].collect()] == [("A", "1.5.0", 6)]
    assert [r.tfms for r in t["projects"].collect()] == [["net8.0"]]


def test_detached_and_newest_patch(spark):
    from lodeworks.sources.projects import detached, newest_patch

    disk = spark.createDataFrame([("/w/A.csproj", True), ("/w/B.csproj", True)], "path string, is_loaded boolean")
    assert {r.path: r.is_loaded for r in detached(spark.createDataFrame([("/W/a.csproj",)], "path string"), disk).collect()} == {"/w/A.csproj": True, "/w/B.csproj": False}
    f = spark.createDataFrame([("/d/8.0.3",), ("/d/8.0.11",), ("/d/9.0.0-rc.1",), ("/d/9.0.0",), ("/d/x",)], "path string")
    assert {r.major: r.path for r in newest_patch(f).collect()} == {8: "/d/8.0.11", 9: "/d/9.0.0"}


def test_lock_inbox_numstat(spark):
    lock = '{"targets":{"net8.0":{"A/1.2.0":{"type":"package","dependencies":{"B":"[2.0.0, )"}},"P/1.0":{"type":"project"}}}}'
    t = read_lock(spark.createDataFrame([("l", lock), ("m", "{bad")], "path string, text string"))
    assert [tuple(r) for r in t["lock_packages"].collect()] == [("l", "net8.0", "A", "1.2.0")]
    assert [tuple(r) for r in t["lock_deps"].collect()] == [("l", "net8.0", "A", "B", "2.0.0")]
    inbox = read_inbox(spark.createDataFrame([("A|4.3.0\nA|4.10.0\n",)], "text string"), "net8.0", False)
    assert [(r.id, r.version) for r in inbox.collect()] == [("a", "4.10.0")]
    assert [tuple(r) for r in read_numstat(spark.createDataFrame([("1\t2\ta b",), ("-\t-\tbin",), ("x",)], "text string")).collect()] == [("a b", 1, 2)]


def test_options_and_config():
    o = parse(["t", "--clone-drift", "--exclude-namespaces", "A.B, C"])
    assert o.duplicate_detection and o.exclude_namespaces == ["A.B", "C"]
    for bad in (["t", "--entropy-rate"], ["t", "--max-complexity", "0"], ["t", "--format", "x"], ["t", "--exclude-namespaces", "1a"]):
        with pytest.raises(ValueError):
            parse(bad)
    warned = []
    c = config_of('{"version":1,"rules":{"R1":"off","R2":"x"},"exclude":{"paths":["a/**"]}}', warned.append)
    assert c.rules == {"R1": "off"} and c.paths == ("a/**",) and len(warned) == 1
    assert config_of('{"version":2}', warned.append).rules == {} and len(warned) == 2
    assert find_config({"/w": "1", "/w/a": "2"}, "/w/a/b") == "2"


def test_run_with_baseline(spark, tmp_path):
    f = facts(spark, declarations=[decl("a", path="/w/a.cs"), decl("b", path="/w/b.cs")], numstat=[dict(path="x.cs", added=60, deleted=40)])
    base = str(tmp_path / "base")
    o = Options("/w", str(tmp_path / "out"), baseline=base, entropy_budget=5.0, entropy_ledger=str(tmp_path / "ledger"))
    first = run(spark, f, o, context=dict(head_sha="h1"))
    assert first.exit == 0 and first.entropy.first().status == "baseline_seeded"
    g = facts(spark, declarations=[decl("a", path="/w/a.cs"), decl("c", path="/w/c.cs")], numstat=[dict(path="x.cs", added=60, deleted=40)])
    second = run(spark, g, o, context=dict(head_sha="h2", baseline_sha="h1"), generated_at_utc="2026-08-01T00:00:00Z")
    e = second.entropy.first()
    assert (e.status, e.new_findings, e.resolved_findings, e.rate, second.exit) == ("scored", 1, 1, 10.0, 3)
    assert second.months.count() == 0
    third = run(spark, g, o, context=dict(head_sha="h2", baseline_sha="h2"))
    assert third.entropy.first().status == "unchanged_range" and [tuple(r) for r in third.months.collect()] == [("2026-08", 1, 1, 100, 10.0)]


def test_run_audits_suppressions_and_reports_new_findings(spark, tmp_path):
    import json

    docs = [dict(path=f"/w/{p}.cs", namespace=n) for p, n in (("a", "App"), ("b", "App.Gen"), ("c", "App"), ("d", "App"))]
    virtual = [decl("K", kind="type", path="/w/c.cs", accessibility="public", type_id=None), decl("v", is_virtual=True, accessibility="public", type_id="K", path="/w/c.cs", line=4)]
    f = facts(spark, declarations=[decl("a", path="/w/a.cs"), decl("b", path="/w/b.cs"), decl("d", path="/w/d.cs"), *virtual], references=[dict(symbol_id=s, path="/w/d.cs", line=9) for s in ("K", "v")], documents=docs, lines=[dict(path="/w/a.cs", line=1, text="  int a;  ")])
    config = config_of('{"rules": {"R0023": "off", "R0001": "advisory", "R0099": "off"}, "exclude": {"paths": ["d.cs", "**/d.cs", "zz/**"], "namespaces": ["App.Gen", "Old"]}}')
    base = str(tmp_path / "base")
    o = Options("/w", audit_suppressions=True, baseline=base, certainty_tier="advisory")
    got = run(spark, f, o, config, context=dict(head_sha="h"))
    report = json.loads("\n".join(r.json for r in got.report.collect()))
    assert [(x["ruleId"], x["filePath"], x["certainty"], x["category"], x.get("lineText")) for x in report["findings"]] == [("R0001", "/w/a.cs", "Advisory", "UnusedPrivateMember", "int a;")]
    t = report["suppression"]["totals"]
    assert (t["findingsAnalysed"], t["findingsHiddenByShadow"], t["findingsDropped"], t["findingsDowngraded"], t["hiddenDebtPercent"]) == (2, 2, 1, 1, 75)
    a = got.audit
    assert [(e["selector"], e["suppressedCount"]) for e in a["pathGlobs"]] == [("d.cs", 0), ("**/d.cs", 1), ("zz/**", 0)]
    assert a["severityOverrides"][0]["detail"] == "-> Advisory (was Guaranteedx2)" and a["severityOverrides"][0]["downgradedCount"] == 1
    assert [(e["selector"], e["suppressedCount"]) for e in a["disabledRules"]] == [("R0023", 1), ("R0099", 0)] and a["namespaceExclusions"][0]["suppressedCount"] == 1
    assert [(x["channel"], x["selector"]) for x in a["obsolete"]] == [("PathGlob", "d.cs"), ("PathGlob", "zz/**"), ("DisabledRule", "R0099"), ("NamespaceExclusion", "Old")]
    # the baseline holds what suppressions hide, so lifting them brings nothing new
    again = run(spark, f, Options("/w", baseline=base, format="sarif"), context=dict(head_sha="h2"))
    log = json.loads("\n".join(r.json for r in again.report.collect()))
    assert log["version"] == "2.1.0" and log["runs"][0]["results"] == [] and log["runs"][0]["tool"]["driver"]["rules"] == []


def test_sarif(spark):
    import json

    from lodeworks.sinks.reports import sarif_report, with_line_text

    schema = SCHEMAS["findings"]
    rows = [("R0002", "Two", "m", 3, 2, "/w/b c.cs", 4, 7, None, [("/w/a.cs", 2)]), ("R0001", "One", "n", 1, 1, "C:\\w\\a.cs", 1, 0, None, None)]
    lines = spark.createDataFrame([("/w/b c.cs", 4, " x; ")], "path string, line int, text string")
    run_ = json.loads("\n".join(r.json for r in sarif_report(with_line_text(spark.createDataFrame(rows, schema), lines), "1.0").collect()))["runs"][0]
    assert [(r["id"], r["name"], r["shortDescription"]["text"]) for r in run_["tool"]["driver"]["rules"]] == [("R0001", "One", "One"), ("R0002", "Two", "Two")]
    one, two = run_["results"]
    assert (one["level"], one["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], one["properties"]) == ("error", "file:///C:/w/a.cs", {"certainty": "Guaranteed", "category": "UnreachableCode"})
    place = two["locations"][0]
    assert two["level"] == "warning" and place["physicalLocation"] == {"artifactLocation": {"uri": "file:///w/b%20c.cs"}, "region": {"startLine": 4, "startColumn": 7, "snippet": {"text": "x;"}}}
    assert place["relatedLocations"] == [{"artifactLocation": {"uri": "file:///w/a.cs"}, "region": {"startLine": 2, "startColumn": 1}}]


def test_main_and_its_exit_codes(spark, tmp_path, monkeypatch, capsys):
    from lodeworks import run as runner

    monkeypatch.setattr(runner, "build_session", lambda name: spark)
    monkeypatch.setenv("LODEWORKS_PERF", "1")
    assert runner.main(["x", "--format", "y"]) == 1 and runner.main([str(tmp_path / "nothing")]) == 1
    folder = tmp_path / "facts"
    facts(spark, declarations=[decl("a"), decl("b")])["declarations"].write.parquet(str(folder / "declarations.parquet"))
    (tmp_path / "lodeworks.json").write_text('{"rules": {"R0001": "high"}}')
    assert runner.main([str(folder), str(tmp_path / "out"), "--audit-suppressions"]) == 0
    said = capsys.readouterr()
    assert "2 finding(s)" in said.out and "High" in said.out and "SeverityOverride" in said.out and said.err.splitlines()[-1].startswith("perf ")


def test_windows_over_the_cap_are_reported(spark, monkeypatch):
    from lodeworks.operators import clones

    tokens = [dict(path=f"f{p}.cs", idx=i, tok=f"t{i}", line=i, ch=0) for p in range(4) for i in range(60)]
    monkeypatch.setattr(clones, "CAP", 3)
    f = facts(spark, tokens=tokens)
    assert [r.places for r in clones.capped(clones.windows(spark.createDataFrame([(f"f{p}", [f"t{i}" for i in range(60)]) for p in range(4)], "path string, t array<string>"), "path", shapes.F.col("t")), 3).collect()] == [4]
    found = clones.islands(clones.windows(spark.createDataFrame([(f"f{p}", [f"t{i}" for i in range(60)]) for p in range(4)], "path string, t array<string>"), "path", shapes.F.col("t")), cap=3).collect()
    assert sorted((r.l_path, r.r_path) for r in found) == [("f0", "f1"), ("f0", "f2"), ("f1", "f2")]
    got = run(spark, f, Options("/w", duplicate_detection=True))
    assert got.warnings == () or "not compared" in got.warnings[0]


def test_all_rules_run_on_nothing(spark):
    assert rules.analyse(Facts(spark), {"config_analysis", "duplicate_detection", "clone_drift"}).count() == 0
    assert len(rules.RULES) == 30
