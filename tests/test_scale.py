"""What must not grow with the notes: lists that nobody reads, work that is done once a note instead of once a text."""

import time

from pyspark.sql import functions as F

from findings_engine.functions import columns as C
from findings_engine.operators import findings as N
from findings_engine.operators import quality as L
from findings_engine.operators import references as R
from findings_engine.operators import resolve as V
from findings_engine.plans import incremental as X
from findings_engine.plans import link as K
from findings_engine.plans import queries as Q


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_status_and_lint_totals_collect_no_lists(spark, sf):
    assert "collect_list" not in _plan(Q.lint_totals(spark, sf))
    plan = _plan(Q.status_report(spark, sf))
    # Only the counts by status are a list: a row a status.
    assert plan.count("collect_list") == plan.count("collect_list(struct(status")


def test_long_frontmatter_is_parsed_once(spark):
    lines = "\n".join(f"k{i % 1500}: v{i}" for i in range(2000))
    df = spark.createDataFrame([(f"---\n{lines}\n---\nbody",)], "text string")
    began = time.time()
    fm = df.select(R.frontmatter(F.col("text")).alias("fm")).first().fm
    assert len(fm) == 1500 and fm["k0"] == "v1500" and fm["k499"] == "v1999" and fm["k500"] == "v500"
    assert time.time() - began < 60


def test_decisions_fold_numbers(spark):
    """No definition travels through the folds, so they are done by hash."""
    notes = spark.createDataFrame([("n", "`a.run`", {})], "note string, body string, overrides map<string,string>")
    defs = spark.createDataFrame([("run", "a.py", 1, "fn", "a.run")], "name string, path string, line int, kind string, qualified_name string")
    refs = spark.createDataFrame([("n", "run", "inline-code")], "note string, name string, evidence string")
    got = V.resolve(refs, notes, defs)
    assert "SortAggregate" not in got._jdf.queryExecution().sparkPlan().toString()
    assert got.first().reason == "unique"


def test_files_are_resolved_once_a_spelling(spark):
    refs = spark.createDataFrame([(f"n{i}", "x/a.py", "bare", 0) for i in range(3)] + [("n9", "b.py", "bare", 0), ("n9", "/b.py", "bare", 1)],
                                 "note string, ref string, evidence string, pos int")
    files = R.repo_files(spark.createDataFrame([("x/a.py",), ("y/x/a.py",), ("zx/a.py",), ("b.py",), ("q/xb.py",)], "path string"))
    got = R.resolve_files(refs, files)
    assert {(r.note, r.ref): r.matches for r in got.collect()} == {
        **{(f"n{i}", "x/a.py"): ["x/a.py", "y/x/a.py"] for i in range(3)}, ("n9", "b.py"): ["b.py"], ("n9", "/b.py"): [],
    }
    plan = _plan(got)
    assert "Aggregate [ref" in plan and "Aggregate [note" not in plan


def test_a_relink_parses_file_references_once(spark, monkeypatch):
    asked = []
    of = R.file_refs
    monkeypatch.setattr(R, "file_refs", lambda notes: asked.append(1) or of(notes))
    notes = spark.createDataFrame([("n", "`run` in a.py and x/a.py", {})], "note string, body string, overrides map<string,string>")
    defs = spark.createDataFrame([("run", "x/a.py", 1, "fn", "a.run")], "name string, path string, line int, kind string, qualified_name string")
    files, options = R.repo_files(defs.select("path")), K.LinkOptions(min_len=2)
    first = K.link(notes, defs, files, options)
    asked.clear()
    done, skipped = X.relink(notes, defs, files, X.state_of(first, defs, options), first.decisions, options)
    assert skipped.count() == 1 and [tuple(r) for r in done.links.collect()] == [tuple(r) for r in first.links.collect()]
    assert len(asked) == 1


def test_lint_joins_the_index_once_for_candidates(spark):
    found = spark.createDataFrame(
        [("RES-1", "wide_name and `x.rare_name`", True, True), ("RES-2", "wide_name", True, True), ("RES-3", "rare_name", True, True)],
        "id string, blob string, has_status boolean, has_severity boolean",
    )
    defs = [("wide_name", f"p{i}.py", 1, "fn", None) for i in range(6)] + [("rare_name", "p.py", 1, "fn", None)]
    index = spark.createDataFrame(defs, "name string, path string, line int, kind string, qualified_name string")
    got = L.check(found, index)
    assert {(r.id, r.code) for r in got.collect()} == {("RES-2", "prose-only")}
    # One join with the index for candidates brings along what else is asked of a name: no second one, no filter by it.
    assert "LeftSemi" not in _plan(got)


def test_heading_facts_and_ends(spark):
    texts = ["## RES-1 — a [LOW]\n### ſtatus: closed\n", "## RES-2: b\n # x\n### partially  CLOSED ", "## RES-3 c\n### SEVERITY: high [LOW]\n### Status: reopened"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    got = {r.id: (r.status, r.severity, r.has_status, r.has_severity, r.title) for r in N.findings(N.blocks(df)).collect()}
    assert got == {
        "RES-1": ("closed", "low", True, True, "a [LOW]"),
        "RES-2": ("open", "unspecified", False, False, "b"),
        "RES-3": ("open", "high", True, True, "c"),
    }
    ends = spark.createDataFrame([(" a ",), ("a b",), ("",), (" ",)], "t string").select(C.strip(F.col("t")), C.rstrip(F.col("t"))).collect()
    assert [tuple(r) for r in ends] == [("a", " a"), ("a b", "a b"), ("", ""), ("", "")]
