"""Decisions against a plain loop over every reference and every definition of its name."""

import random
import re

from findings_engine.functions import rx
from findings_engine.operators import resolve as V

CHAIN = re.compile(r"\b[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+\b")


def _place(path, line):
    return f"{path}:L{line}" if line else path


def _plain(note, name, overrides, defs):
    refs = set()
    for chain in CHAIN.findall(note):
        parts = chain.split(".")
        if name in parts:
            at = len(parts) - parts[::-1].index(name)
            ref = re.sub(rx.SYNTAX_PREFIX, "", ".".join(parts[:at]))
            if at > 1 and "." in ref:
                refs.add(ref)
    locs = sorted((d for d in defs if d[0] == name), key=lambda d: (d[1], d[2] or 0))
    want = overrides.get(name)

    def qualified(d):
        q = d[4]
        return bool(q) and any(q == r or q.endswith("." + r) or ("." in q and r.endswith("." + q)) for r in refs)

    def path_parts(d):
        stem = re.sub(r"^((?:.*/)?\.*[^/.][^/]*)\.[^./]*$", r"\1", d[1]).split("/")
        return stem[:-1] if stem[-1] == "__init__" else stem

    def by_path(d):
        parts = path_parts(d)
        for r in refs:
            seg = r.split(".")
            if any(len(parts) >= len(s) and parts[len(parts) - len(s) :] == s for s in (seg[:-1], seg)):
                return True
        return False

    dq = [d for d in locs if qualified(d)]
    dd = dq if dq or not refs else [d for d in locs if by_path(d)]
    q = [d for d in locs if d[4] and d[4] != name and d[4] in note]
    p = [d for d in locs if d[1] in note]
    o = [d for d in locs if want is not None and want in (d[4], d[1], _place(d[1], d[2]))]
    if want is not None:
        return ("frontmatter-override", o[0]) if o else ("override-unmatched", None)
    if refs and not dd:
        return "dotted-unmatched", None
    if len(locs) == 1:
        return "unique", locs[0]
    if len(q) > 1:
        return "multiple-qualified-names", None
    if len(p) > 1:
        return "multiple-paths-in-note", None
    if len(q) == 1 and len(p) == 1 and q != p:
        return "qualified-name-and-path-disagree", None
    if dd and len(p) == 1 and p[0] not in dd:
        return "dotted-and-path-disagree", None
    if len(q) == 1:
        return "qualified-name", q[0]
    if len(p) == 1:
        return "path-in-note", p[0]
    if refs:
        return (("dotted-name" if dq else "dotted-path"), dd[0]) if len(dd) == 1 else ("dotted-ambiguous", None)
    return "ambiguous", None


def test_decisions_equal_a_plain_loop(spark):
    r = random.Random(4)
    names = ["validate", "parse", "load_all", "run"]
    dirs = ["src", "src/app", "lib/app/core", "a", "pkg.d/x"]
    files = ["users.py", "payments.py", "__init__.py", "x.test.ts", "Makefile"]
    scopes = ["User", "app.User", "Pay", "core.Pay.Inner", "", None, "ODD", "validate"]
    defs = {}
    for _ in range(60):
        name = r.choice(names[:3])
        path = "/".join(filter(None, [r.choice([*dirs, ""]), r.choice(files)]))
        scope = r.choice(scopes)
        q = None if scope is None else "" if scope == "" else "SomethingElse" if scope == "ODD" else name if scope == "validate" else f"{scope}.{name}"
        line = r.choice([None, 3, 8, 12])
        defs[name, path, line] = (name, path, line, "fn", q)
    defs["run", "src/run.py", 1] = ("run", "src/run.py", 1, "fn", None)
    defs = list(defs.values())
    bits = [
        "`validate`", "User.validate", "app.User.validate", "xUser.validate", "self.User.parse", "core.Pay.Inner.load_all()", "Pay.parse.validate",
        "users.validate", "app.users.parse", "src/app/users.py", "xsrc/app/users.pyc", "lib/app/core/payments.py", "users.py", "Makefile", "a/Makefile",
        "SomethingElse", "pkg.d/x/x.test.ts", "core.load_all", "parse", "load_all", "run", "other.run", "Inner.load_all.load_all", "éUser.validate",
    ]
    notes, refs = [], []
    for i in range(400):
        body = "".join(r.choice(bits) + r.choice([" ", " ", ", ", "\n", ".", "/"]) for _ in range(r.randint(0, 6)))
        over = {}
        if r.random() < 0.2:
            d = r.choice(defs)
            over[r.choice(names)] = r.choice([d[1], _place(d[1], d[2]), d[4] or "none", "nowhere.py"])
        notes.append((f"n{i}", body, over))
        refs += [(f"n{i}", n, "inline-code") for n in r.sample(names, 2)]
    n = spark.createDataFrame(notes, "note string, body string, overrides map<string,string>")
    s = spark.createDataFrame(defs, "name string, path string, line int, kind string, qualified_name string")
    f = spark.createDataFrame(refs, "note string, name string, evidence string")
    got = {(x.note, x.name): (x.reason, x.location and (x.location.path, x.location.line), x.definitions) for x in V.resolve(f, n, s).collect()}
    text = {note: (body, over) for note, body, over in notes}
    reasons = set()
    for note, name, _ in refs:
        reason, d = _plain(*[text[note][0], name, text[note][1]], defs)
        reasons.add(reason)
        assert got[note, name] == (reason, d and (d[1], d[2]), sum(x[0] == name for x in defs)), (text[note], name)
    assert len(got) == len(refs) and len(reasons) >= 10
