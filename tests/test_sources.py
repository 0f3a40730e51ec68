from pyspark.sql import functions as F

from findings_engine.functions import columns as C
from findings_engine.operators import freshness as FR
from findings_engine.plans import queries as Q
from findings_engine.sources import indexes as I
from findings_engine.sources import registers as G


def test_tree_lister_keeps_init_and_prunes(spark, tmp_path):
    for name in ("pkg/__init__.py", "pkg/a.py", "node_modules/x.py", ".hidden/y.py", "pkg/b.jsx"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"def one():\r\n  pass\nclass Two:\n\xff\n")
    got = I.from_sources(I.read_sources(spark, str(tmp_path))).collect()
    assert sorted((r.name, r.path, r.line, r.qualified_name) for r in got) == [
        ("Two", "pkg/__init__.py", 3, "__init__.Two"), ("Two", "pkg/a.py", 3, "a.Two"),
        ("one", "pkg/__init__.py", 1, "__init__.one"), ("one", "pkg/a.py", 1, "a.one"),
    ]


def test_definition_patterns(spark):
    code = {
        "a.js": "export const shown = 1\nconst hidden = 2\nexport default function main() {}",
        "b.ts": "export abstract class Base {}\nexport const enum Kind {}",
        "c.tsx": "abstract class No {}",
        "d.rb": "def valid?\nend",
        "e.c": "static int *run(int x) {\nint later(int x);",
        "f.sql": "create table if not exists \"t1\" (x int)",
        "g.jsx": "export const out = 1",
    }
    rows = spark.createDataFrame([(k, v.encode()) for k, v in code.items()], "path string, content binary")
    assert {r.name for r in I.from_sources(rows).collect()} == {"shown", "main", "Base", "Kind", "valid?", "run", "t1"}


def test_line_numbers(spark):
    good = ["88", "88.0", '"88"', '"L88"', '"l 88"', '"88-94"', '"L88-L94"', '"L88..L94"', '"88–94"']
    bad = ["null", "true", "false", "0", "-1", "88.5", '""', '"L"', '"Lx"', '"line 88"', '"L88 trailing"', "[88]", '{"a": 88}']
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(good + bad)], "i int, t string")
    got = [r.n for r in rows.select("i", C.line_number(F.parse_json("t")).alias("n")).orderBy("i").collect()]
    assert got == [88] * len(good) + [None] * len(bad)


CASES = (
    ("null", None, None, None, None),
    ("{}", None, None, None, None),
    ('{"a": "x.py:L1"}', None, None, None, None),
    ('{"a": 1}', None, None, None, None),
    ('{"symbols": []}', None, None, None, None),
    ('{"symbols": {}}', None, None, None, None),
    ('{"symbols": {}, "repository": {"fingerprint": "f"}}', "f", True, None, None),
    ('{"symbols": {}, "repository": {"fingerprint": "f"}, "indexing": {"scope": {"kind": "all"}}}', "f", False, None, None),
    ('{"symbols": {}, "repository": {"fingerprint": "f"}, "indexing": {"scope": {"kind": "all"}, "partial": true}}', "f", True, None, None),
    ('{"symbols": {}, "repository": {"fingerprint": "f"}, "indexing": {"scope": {"kind": "all"}}}', "g", True, None, None),
    ('{"symbols": {}, "repository": {"commit": "c"}}', None, None, None, None),
    ('{"symbols": {}, "repository": {"commit": "c"}}', None, None, "d", False),
    ('{"symbols": {}, "repository": {"commit": "c"}}', None, None, "c", True),
    ('{"symbols": {}, "repository": {"commit": "c"}}', None, None, "c", False),
)


def test_freshness_table(spark):
    rows = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(CASES)], "case int, text string, fingerprint_now string, scope_known boolean, commit_now string, dirty_now boolean"
    )
    judged = FR.gate(FR.verdict(rows), require_fresh=True)
    got = [(r.status, r.reason, r.partial, r.exit_code) for r in judged.orderBy("case").collect()]
    assert [x[:2] for x in got] == [
        ("invalid", "not-a-symbol-index"), ("invalid", "not-a-symbol-index"), ("unknown", "legacy-index-without-provenance"),
        ("invalid", "not-a-symbol-index"), ("invalid", "symbols-not-a-mapping"), ("unknown", "legacy-index-without-provenance"),
        ("unknown", "fingerprint-scope-not-recorded"), ("unknown", "scope-cannot-be-rebuilt"), ("fresh", "fingerprint-match"),
        ("stale", "fingerprint-mismatch"), ("unknown", "git-unavailable-or-not-a-repository"), ("stale", "commit-mismatch"),
        ("stale", "working-tree-modified"), ("unknown", "commit-match-without-fingerprint"),
    ]
    assert got[8][2:] == (True, 1) and got[0][3] == 2


def test_gate_takes_only_true(spark):
    rows = spark.createDataFrame([(x,) for x in ('{"consult": true}', '{"consult": "true"}', '{"consult": 1}', "{}", "no")], "text string")
    assert [r.enabled for r in G.enabled(rows, "consult").collect()] == [True, False, False, False, False]


def test_half_a_state_is_none(spark):
    note = '{"content_hash":"h","linked":["a"],"locations":[%s],"files":[],"files_fingerprint":"f","ambiguous":[]}'
    whole = '{"schema_version":%d,"symbols_fingerprint":"s","options_fingerprint":"o","symbol_locations":{},"notes":{"n.md":%s}}'
    loc = '{"path":"p","line":1}'
    for text, n in ((whole % (3, note % loc), 1), (whole % (2, note % loc), 0), (whole % (3, note % ""), 0), ("{", 0)):
        assert G.link_state(spark.createDataFrame([(text,)], "text string"))[1].count() == n


def test_every_file_with_known_findings_gets_its_answer(spark, sf):
    known = {r.path for r in Q.consult_topk(spark, sf).select("path").distinct().collect()}
    assert {r.path for r in Q.consult_context(spark, sf).select("path").collect()} == known
