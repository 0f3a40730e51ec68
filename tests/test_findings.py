from findings_engine.operators import findings as N
from findings_engine.operators import quality as L
from findings_engine.operators import references as R
from findings_engine.plans import render as D
from pyspark.sql import functions as F


def found(spark, text, prefix="RES"):
    return N.findings(N.blocks(spark.createDataFrame([("r.md", text)], "path string, text string"), prefix), prefix)


def test_last_status_wins_and_sections_interleave(spark):
    text = (
        "# R\n\n## RES-01 — parser loses rows [HIGH]\n\nbody\n### STATUS: CLOSED\n\n"
        "## RES2 — other\nwas withdrawn in prose\n\n## RES-01 — again\n### status: reopened\n### SEVERITY: LOW\nsee XRES-5, RES2 and RES-01\n"
    )
    rows = {r.id: r for r in found(spark, text).collect()}
    assert set(rows) == {"RES-01", "RES2"}
    a, b = rows["RES-01"], rows["RES2"]
    assert (a.status, a.severity, a.sections, a.title, a.refs) == ("open", "low", 2, "parser loses rows [HIGH]", ["RES2", "RES-5"])
    assert (b.status, b.severity, b.sections) == ("open", "unspecified", 1)


def test_unresolved_is_not_resolved(spark):
    for word, status in (("UNRESOLVED", "open"), ("resolved", "closed"), ("partially closed", "partial"), ("retracted", "withdrawn")):
        assert found(spark, f"\n## RES-1 — {word}\n").first().status == status


def test_lowest_tag_in_a_heading(spark):
    assert found(spark, "\n## RES-1 — x [CRITICAL] [LOW]\n").first().severity == "low"


def test_prefix_is_quoted_and_crlf_folds(spark):
    rows = found(spark, "x\r\n## A.B-1 — one\r\n\r\n## AxB-2 — no\r\n", "A.B").collect()
    assert [r.id for r in rows] == ["A.B-1"]


def test_empty_and_headless_registers(spark):
    assert found(spark, "").count() == 0
    assert found(spark, "# nothing\n## here\n").count() == 0


def test_file_references(spark):
    body = "`./ops/deploy.sh` and `app.py` in src/(group)/[slug]/page.tsx, not https://host.com/x.yml or `.env`"
    notes = spark.createDataFrame([("n", body)], "note string, body string")
    got = {(r.ref, r.evidence) for r in R.file_refs(notes).collect()}
    assert got == {("ops/deploy.sh", "inline-code"), ("app.py", "inline-code"), ("src/(group)/[slug]/page.tsx", "bare")}


def test_suffix_join_abstains(spark):
    notes = spark.createDataFrame([("n", "`compose.yml` `a/compose.yml` `none.yml`")], "note string, body string")
    files = R.repo_files(spark.createDataFrame([("a/compose.yml",), ("b/compose.yml",), ("xa/compose.yml",)], "path string"))
    got = {r.ref: r.matches for r in R.resolve_files(R.file_refs(notes), files).collect()}
    assert got == {"compose.yml": ["a/compose.yml", "b/compose.yml", "xa/compose.yml"], "a/compose.yml": ["a/compose.yml"], "none.yml": []}


def test_lint_without_index(spark):
    f = found(spark, "\n## RES-1 — prose only\n\nnothing here\n\n## RES-2 — good [LOW]\n### STATUS: OPEN\n`parse_rows` fails\n")
    got = {(r.id, r.code) for r in L.check(f).collect()}
    assert got == {("RES-1", "prose-only"), ("RES-1", "missing-status"), ("RES-1", "missing-severity")}


def test_block_is_replaced_not_doubled(spark):
    links = spark.createDataFrame([("n", "f", "a.py", 3, 1)], "note string, name string, path string, line int, rank int")
    anchors = spark.createDataFrame([], "note string, path string, rank int")
    notes = spark.createDataFrame([("n", "---\nfindings_schema: 1\n---\n\n# N\n\nbody\n")], "note string, text string")
    once = D.rewritten(notes, D.block(links, anchors))
    twice = D.rewritten(once.select("note", "text"), D.block(links, anchors))
    assert once.first().changed and not twice.first().changed
    gone = D.rewritten(once.select("note", "text"), D.block(links, anchors).limit(0))
    assert "findings:code" not in gone.first().text and "body" in gone.first().text
    assert R.authored(F.lit("x")) is not None


def test_export_and_prune(spark, tmp_path):
    f = found(spark, "\n## RES-1 — one\n\n## RES-2 — two\n")
    D.export(D.note_text(f), str(tmp_path))
    (tmp_path / "RES-9.md").write_text("mine")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["RES-1.md", "RES-2.md", "RES-9.md"]
    old = spark.createDataFrame([("RES-2",), ("RES-9",), ("../x",)], "note string")
    assert D.prune(D.stale_notes(old, f.where("id = 'RES-1'"), "RES"), str(tmp_path)) == ["RES-2"]
