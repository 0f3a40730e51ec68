"""Indexes of real trees: envelope, completeness, scope and freshness after changes."""

import hashlib
import json

from pyspark.sql import functions as F

from findings_engine.functions import rx
from findings_engine.plans import provenance as P
from findings_engine.plans import reports as RP
from findings_engine.sources import indexes as I
from findings_engine.sources import registers as G
from findings_engine.sources import tree as T

PY = frozenset(rx.DEFINITIONS)


def _tree(root, files):
    for path, text in files.items():
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)


def test_index_of_a_tree_and_what_makes_it_stale(spark, tmp_path):
    _tree(tmp_path, {"a/users.py": "def validate(x):\n    pass\n", "b.go": "func Run(x int) {\n", "node_modules/x.py": "def no(): pass\n", "notes.md": "# x\n"})
    index = P.index_tree(spark, str(tmp_path))
    whole = json.loads(index.first().text)
    records = sorted(f"{p}\0{hashlib.sha256((tmp_path / p).read_bytes()).hexdigest()}\n" for p in ("a/users.py", "b.go"))
    assert whole["repository"]["fingerprint"] == "sha256:" + hashlib.sha256("".join(records).encode()).hexdigest()
    assert whole["repository"]["files_fingerprinted"] == 2 and whole["indexing"]["files_considered"] == ["a/users.py", "b.go"]
    assert set(whole["symbols"]) == {"validate", "Run"} and whole["indexing"]["partial"] is False
    assert whole["indexing"]["configuration_fingerprint"] == P.config_fingerprint(whole["indexing"]["configuration"])
    said = lambda: P.freshness_of(spark, str(tmp_path), index).first()
    assert (said().status, said().reason) == ("fresh", "fingerprint-match")
    _tree(tmp_path, {"other.md": "not in scope"})
    assert said().status == "fresh"
    _tree(tmp_path, {"added.py": "x = 1\n"})  # never indexed, so only a scope derived anew can see it
    row = said()
    assert (row.status, row.reason) == ("stale", "fingerprint-mismatch")
    assert "Run the symbol indexer again" in RP.freshness_text(P.freshness_of(spark, str(tmp_path), index)).first().report


def test_a_truncated_scan_says_so(spark, tmp_path):
    _tree(tmp_path, {f"f{i}.py": f"def name_{i}(): pass\n" for i in range(5)})
    assert T.count_files(str(tmp_path), PY, 3) == 4 and T.count_files(str(tmp_path), PY, 9) == 5
    whole = json.loads(P.index_tree(spark, str(tmp_path), 3).first().text)
    assert whole["indexing"]["partial"] is True and whole["indexing"]["warnings"][0]["message"] == "scan: max-files-reached at 3"
    assert json.loads(P.index_tree(spark, str(tmp_path), 5).first().text)["indexing"]["partial"] is False
    assert P.may_refresh(str(tmp_path), False, 5) == (True, None)
    ok, hint = P.may_refresh(str(tmp_path), False, 4)
    assert not ok and hint and P.may_refresh(str(tmp_path), True, 4) == (False, None)


def test_scopes(spark, tmp_path):
    _tree(tmp_path, {"a.py": "", "b.py": "", "skipped/c.py": ""})
    paths = lambda f: sorted(r.path for r in f.select("path").collect())
    files, known = P.discover_scope(spark, str(tmp_path), {"kind": "extensions", "extensions": [".py"], "exclude": ["skipped"]})
    assert known and paths(files) == ["a.py", "b.py"]
    named = spark.createDataFrame([("a.py",), ("gone.py",)], "path string")
    files, known = P.discover_scope(spark, str(tmp_path), {"kind": "ctags"}, named)
    assert known and paths(files) == ["a.py"]
    assert P.discover_scope(spark, str(tmp_path), {"kind": "ctags"}) == (None, False) == P.discover_scope(spark, str(tmp_path), None)


def test_backends_in_turn_keep_their_notes(spark):
    none = spark.createDataFrame([], "name string")
    one = spark.createDataFrame([("x",)], "name string")

    def broken():
        raise OSError("no tags")

    name, rows, notes = I.first_non_empty([("a", broken), ("b", lambda: (none, None)), ("c", lambda: (one, "cut short")), ("d", lambda: (one, None))])
    assert name == "c" and rows.count() == 1 and notes == ["a: OSError", "c: cut short"]
    assert I.first_non_empty([("b", lambda: (none, None))]) == ("none", None, [])


def test_a_vault_has_one_register(spark):
    text = spark.createDataFrame([('{"register": {"prefix": "RES", "source": "F.md"}, "generated_notes": []}',)], "text string")
    m = G.manifest(text)
    assert P.vault_conflict(m, "RES", "F.md") is None and P.vault_conflict(m, "BUG", "F.md", adopt=True) is None
    assert "prefix RES" in P.vault_conflict(m, "BUG", "F.md") and "F.md" in P.vault_conflict(m, "RES", "G.md")
    assert P.vault_conflict(m.limit(0), "BUG", "x") is None


def test_small_reports(spark):
    before = spark.createDataFrame([("a", "x"), ("b", "y")], "note string, text string")
    after = spark.createDataFrame([("a", "x"), ("b", "z"), ("c", "n")], "note string, text string")
    changed = RP.modified(before, after)
    assert {r.note for r in changed.collect()} == {"b", "c"}
    metrics = spark.range(1).select(F.lit(0).alias("unlinked_notes"))
    assert RP.link_report(metrics, changed, check=True).first().exit_code == 1 and RP.link_report(metrics, changed).first().exit_code == 0
    bare = spark.createDataFrame([("n", "only-ambiguous")], "note string, reason string")
    assert RP.unlinked_lines(bare).first().line == "n\n  reason: only ambiguous symbols found"
    reg = spark.createDataFrame([("r.md", "## One\ntext\n### Two words\n" + "".join(f"## H{c}x\n" for c in "abcdefghij"))], "path string, text string")
    assert [r.line for r in RP.inspect(reg).collect()][:2] == ["## One", "### Two words"] and RP.inspect(reg).count() == 8
    ids = spark.createDataFrame([("r.md", "## BUG-1 x\n## BUG-2 y\n## F7 z\n")], "path string, text string")
    assert [r.line for r in RP.inspect(ids).collect()] == ["BUG-<n> 2", "F<n> 1"]
    d = spark.createDataFrame([("s", 1, "block"), ("s", 2, "pass")], "session string, event_id int, decision string")
    got = {r.event_id: r.json for r in RP.capture_json(d, "F.md").collect()}
    assert got[2] is None and json.loads(got[1])["decision"] == "block" and "F.md" in json.loads(got[1])["reason"]
