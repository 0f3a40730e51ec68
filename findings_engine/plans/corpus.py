"""Registers, source trees and notes derived from order, line and part tables.

Plain tables hold no findings, so the queries of this package make them: an
order is a finding (and a note), a part is a definition in a source file, and
a line of an order is a place where its note names a part. The texts are made
to be parsed again by the operators; ``CTE`` says in SQL what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "RES"
#: Type -> file extension, and what defines a name in such a file.
LANGUAGES = {
    "economy": ("py", "def {}(x):"),
    "standard": ("ts", "export const {} = 1;"),
    "promo": ("go", "func (r R) {}(x int) {{"),
    "small": ("rs", "pub fn {}() {{"),
    "large": ("java", "  public static final class {} {{"),
    "medium": ("sql", "CREATE OR REPLACE VIEW {} AS"),
}
#: Types whose tags carry a scope; the others' definitions have no qualified name.
SCOPED = ("economy", "standard", "promo")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """By key over all partitions: parsing these texts costs far more than their size tells."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def registers(orders: DataFrame) -> DataFrame:
    """path, text: one register a customer, one section or two an order."""
    k = F.col("o_orderkey")
    when = lambda test, text: F.when(test, text).otherwise("")
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    head = F.concat(
        F.lit("## RES-"), _s(k), F.lit(" — order "), _s(k), F.lit(" of "), _s("o_custkey"),
        when(s == "P", F.lit(" partially closed")), when(p == "2-HIGH", F.lit(" [HIGH]")), when(p == "5-LOW", F.lit(" [LOW]")),
    )
    first = F.concat(
        head,
        F.lit("\n\nLate by one day.\n"),
        when(s == "F", F.lit("### STATUS: CLOSED\n")),
        when(p == "1-URGENT", F.lit("### SEVERITY: CRITICAL\n")),
        when(p == "3-MEDIUM", F.lit("### Severity: medium\n")),
        when(k % 3 == 0, F.lit("### F12 aside\n")),
        when(k % 5 == 0, F.concat(F.lit("\nSee RES-"), _s(k + 1), F.lit(", RES2 and XRES-"), _s(k), F.lit(".\n"))),
    )
    again = F.concat(F.lit("## RES-"), _s(k), F.lit(" — follow-up\n\n### STATUS: REOPENED\n### SEVERITY: HIGH\n"))
    parts = F.when(k % 7 == 0, F.array(first, again)).otherwise(F.array(first))
    rows = orders.select("o_custkey", F.struct(k.alias("k"), parts.alias("parts")).alias("s"))
    texts = F.flatten(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["parts"]))
    return _dealt(rows, "o_custkey").groupBy("o_custkey").agg(F.array_join(texts, "\n").alias("t")).select(
        F.concat(F.lit("reg-"), _s("o_custkey"), F.lit(".md")).alias("path"),
        F.concat(F.lit("# Register\n\nWhat was found.\n\n"), "t").alias("text"),
    )


def parts(part: DataFrame) -> DataFrame:
    """pk, name, brand, typ, ext, path."""
    typ = F.lower("p_type")
    ext = F.try_element_at(F.create_map(*[F.lit(x) for t, (e, _) in LANGUAGES.items() for x in (t, e)]), typ)
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
    return part.select(
        F.col("p_partkey").alias("pk"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"),
        brand.alias("brand"),
        typ.alias("typ"),
        ext.alias("ext"),
        F.concat(F.lit("src/"), brand, F.lit("/"), typ, F.lit("."), ext).alias("path"),
    )


def sources(part: DataFrame) -> DataFrame:
    """path, content: a file for each brand and type, each name defined once on an even line."""
    p = parts(part)
    defined = None
    for t, (_, pattern) in LANGUAGES.items():
        before, after = pattern.format("\0").split("\0")
        text = F.concat(F.lit(before), "name", F.lit(after + "\n  use "), "name", F.lit(";\n"))
        defined = (F if defined is None else defined).when(F.col("typ") == t, text)
    lines = F.transform(F.array_sort(F.collect_set(F.struct("name", defined.alias("t")))), lambda x: x["t"])
    return p.groupBy("path").agg(F.concat(F.lit("generated\n"), F.array_join(lines, "")).cast("binary").alias("content"))


def tags(part: DataFrame) -> DataFrame:
    """value: a tags line for each definition."""
    p = parts(part).groupBy("name", "path", "typ").agg((F.min("pk") + 1).alias("line"))
    scope = F.when(F.col("typ").isin(*SCOPED), F.concat(F.lit("\tclass:"), "typ")).otherwise("")
    return p.select(
        F.concat("name", F.lit("\t"), "path", F.lit('\t/^x$/;"\tkind:member\tline:'), _s("line"), scope).alias("value")
    )


def notes(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """path, text: an owned note for each order with lines; some have an override, right or wrong."""
    p = parts(part)
    k = F.col("l_orderkey")
    style = (k + F.col("l_linenumber")) % 6
    span = lambda *cs: F.concat(F.lit("`"), *cs, F.lit("`"))
    dot = F.lit(".")
    mention = (
        F.when(style == 0, span("name"))
        .when(style == 1, span("typ", dot, "name"))
        .when(style == 2, span("brand", dot, "typ", dot, "name"))
        .when(style == 3, F.col("name"))
        .when(style == 4, F.concat(span("name"), F.lit(" in "), "path"))
        .otherwise(span("typ", dot, "ext"))
    )
    # What an override is made of travels only with the orders that have one.
    chosen = (k % 11 == 0) | (k % 13 == 0)
    line = F.struct(
        F.col("l_linenumber").alias("ln"), "pk", F.concat(F.lit("- "), mention, F.lit(" breaks\n")).alias("t"),
        F.when(chosen, F.col("name")).alias("name"), F.when(chosen, F.col("path")).alias("path"),
    )
    rows = lineitem.join(p, lineitem["l_partkey"] == p["pk"]).select(k.alias("k"), line.alias("l"))
    whole = _dealt(rows, "k").groupBy("k").agg(F.sort_array(F.collect_list("l")).alias("ls"))
    first = F.get("ls", F.lit(0))
    override = lambda to: F.concat(F.lit("findings:\n  "), first["name"], F.lit(": "), to, F.lit("\n"))
    over = F.when(F.col("k") % 11 == 0, override(first["path"])).when(F.col("k") % 13 == 0, override(F.lit("nowhere.py")))
    return whole.select(
        F.concat(F.lit("vault/RES-"), _s("k"), F.lit(".md")).alias("path"),
        F.concat(
            F.lit("---\nfindings_schema: 1\nfindings_id: RES-"), _s("k"), F.lit("\nstatus: "),
            F.when(F.col("k") % 2 == 0, "open").otherwise("closed"), F.lit("\nseverity: "),
            F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), (F.col("k") % 4 + 1).cast("int")),
            F.lit("\n"), F.coalesce(over, F.lit("")), F.lit("---\n\n# RES-"), _s("k"), F.lit("\n\nRelated: none\n\n"),
            F.array_join(F.col("ls.t"), ""),
        ).alias("text"),
    )


#: The same facts for the oracle, as common table expressions by name, each with those it stands on.
CTE = {
    "sec": ((), """
sec as (
  select o_custkey c, o_orderkey k, 0 part,
    '## RES-' || o_orderkey || ' — order ' || o_orderkey || ' of ' || o_custkey
      || case when o_orderstatus = 'P' then ' partially closed' else '' end
      || case o_orderpriority when '2-HIGH' then ' [HIGH]' when '5-LOW' then ' [LOW]' else '' end
      || chr(10) || chr(10) || 'Late by one day.' || chr(10)
      || case when o_orderstatus = 'F' then '### STATUS: CLOSED' || chr(10) else '' end
      || case when o_orderpriority = '1-URGENT' then '### SEVERITY: CRITICAL' || chr(10) else '' end
      || case when o_orderpriority = '3-MEDIUM' then '### Severity: medium' || chr(10) else '' end
      || case when o_orderkey % 3 = 0 then '### F12 aside' || chr(10) else '' end
      || case when o_orderkey % 5 = 0 then chr(10) || 'See RES-' || (o_orderkey + 1) || ', RES2 and XRES-' || o_orderkey || '.' || chr(10) else '' end
      as block from orders
  union all
  select o_custkey, o_orderkey, 1, '## RES-' || o_orderkey || ' — follow-up' || chr(10) || chr(10)
      || '### STATUS: REOPENED' || chr(10) || '### SEVERITY: HIGH' || chr(10) from orders where o_orderkey % 7 = 0
)"""),
    "fin": ((), """
fin as (
  select 'reg-' || o_custkey || '.md' as path, o_orderkey k, 'RES-' || o_orderkey as id,
    case when o_orderkey % 7 = 0 or o_orderstatus = 'O' then 'open' when o_orderstatus = 'F' then 'closed' else 'partial' end as status,
    case when o_orderkey % 7 = 0 then 'high' when o_orderpriority = '1-URGENT' then 'critical' when o_orderpriority = '2-HIGH' then 'high'
      when o_orderpriority = '3-MEDIUM' then 'medium' when o_orderpriority = '5-LOW' then 'low' else 'unspecified' end as severity,
    case when o_orderkey % 7 = 0 then 2 else 1 end as sections,
    'order ' || o_orderkey || ' of ' || o_custkey || case when o_orderstatus = 'P' then ' partially closed' else '' end
      || case o_orderpriority when '2-HIGH' then ' [HIGH]' when '5-LOW' then ' [LOW]' else '' end as title,
    o_orderstatus = 'F' or o_orderkey % 7 = 0 as has_status,
    o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') or o_orderkey % 7 = 0 as has_severity
  from orders
)"""),
    "p": ((), """
p as (
  select *, 'src/' || brand || '/' || typ || '.' || ext as path from (
    select p_partkey pk, replace(p_name, ' ', '_') as name, lower(replace(p_brand, '#', '_')) brand, lower(p_type) typ,
      case lower(p_type) when 'economy' then 'py' when 'standard' then 'ts' when 'promo' then 'go' when 'small' then 'rs'
        when 'large' then 'java' when 'medium' then 'sql' end as ext from part)
)"""),
    "src": (("p",), """
src as (
  select path, name, ext as kind, typ, 2 * row_number() over (partition by path order by name) as line
  from (select distinct path, name, ext, typ from p)
)"""),
    "files": (("src",), """
files as (
  select path, 'generated' || chr(10) || string_agg(
    case typ when 'economy' then 'def ' || name || '(x):' when 'standard' then 'export const ' || name || ' = 1;'
      when 'promo' then 'func (r R) ' || name || '(x int) {' when 'small' then 'pub fn ' || name || '() {'
      when 'large' then '  public static final class ' || name || ' {' when 'medium' then 'CREATE OR REPLACE VIEW ' || name || ' AS' end
    || chr(10) || '  use ' || name || ';' || chr(10), '' order by name) as content from src group by path
)"""),
    "defs": (("p",), """
defs as (
  select name, path, typ, brand, min(pk) + 1 as line, case when typ in ('economy', 'standard', 'promo') then typ || '.' || name end as q
  from p group by name, path, typ, brand
)"""),
    "li": (("p",), """
li as (
  select *, case s when 0 then '`' || name || '`' when 1 then '`' || typ || '.' || name || '`'
      when 2 then '`' || brand || '.' || typ || '.' || name || '`' when 3 then name
      when 4 then '`' || name || '` in ' || path else '`' || typ || '.' || ext || '`' end as mention
  from (select l_orderkey k, l_linenumber ln, (l_orderkey + l_linenumber) % 6 as s, p.* from lineitem join p on pk = l_partkey)
)"""),
    "body": (("li",), """
body as (
  select k, string_agg('- ' || mention || ' breaks' || chr(10), '' order by ln, pk) as body from li group by k
)"""),
    "wants": (("li",), """
wants as (
  select k, name, case when k % 11 = 0 then path else 'nowhere.py' end as want
  from (select *, row_number() over (partition by k order by ln, pk) as place from li where k % 11 = 0 or k % 13 = 0) where place = 1
)"""),
    "dec": (("li", "body", "wants", "defs"), """
refs as (
  select k, name, min(case when s = 3 then 1 else 0 end) as ev from li where s <> 5 group by k, name
), dotted as (
  select distinct k, name, case s when 1 then typ || '.' || name else brand || '.' || typ || '.' || name end as ref from li where s in (1, 2)
), flags as (
  select r.k, r.name, r.ev, d.path, d.line, w.want,
    d.q is not null and contains(b.body, d.q) as qf, contains(b.body, d.path) as pf,
    coalesce((select bool_or(d.q = t.ref or ends_with(d.q, '.' || t.ref) or ends_with(t.ref, '.' || d.q)) from dotted t where t.k = r.k and t.name = r.name), false) as dq,
    coalesce((select bool_or(t.ref = d.typ || '.' || d.name or t.ref = d.brand || '.' || d.typ || '.' || d.name) from dotted t where t.k = r.k and t.name = r.name), false) as dp,
    exists (select 1 from dotted t where t.k = r.k and t.name = r.name) as hasr
  from refs r join defs d on d.name = r.name join body b on b.k = r.k left join wants w on w.k = r.k and w.name = r.name
), counted as (
  select k, name, min(ev) ev, max(want) want, count(*) n, bool_or(hasr) hasr,
    count(*) filter (qf) nq, count(*) filter (pf) np, count(*) filter (dq) ndq, count(*) filter (dp) ndp,
    max(path) filter (qf) qpath, max(path) filter (pf) ppath, max(path) filter (dq) dqpath, max(path) filter (dp) dppath,
    count(*) filter (pf and dq) pdq, count(*) filter (pf and dp) pdp,
    max(path) filter (path = want or path || ':L' || line = want) opath, max(path) anypath
  from flags group by k, name
), why as (
  select *, case
    when want is not null and opath is not null then 'frontmatter-override'
    when want is not null then 'override-unmatched'
    when hasr and ndq + ndp = 0 then 'dotted-unmatched'
    when n = 1 then 'unique'
    when nq > 1 then 'multiple-qualified-names'
    when np > 1 then 'multiple-paths-in-note'
    when nq = 1 and np = 1 and qpath <> ppath then 'qualified-name-and-path-disagree'
    when ndq + ndp > 0 and np = 1 and (case when ndq > 0 then pdq else pdp end) = 0 then 'dotted-and-path-disagree'
    when nq = 1 then 'qualified-name'
    when np = 1 then 'path-in-note'
    when hasr and ndq = 1 then 'dotted-name'
    when hasr and ndq = 0 and ndp = 1 then 'dotted-path'
    when hasr then 'dotted-ambiguous'
    else 'ambiguous' end as reason from counted
), dec as (
  select y.k, 'RES-' || y.k as note, y.name, case when ev = 0 then 'inline-code' else 'identifier' end as evidence, reason, l.path, d.line, y.n
  from why y
  cross join lateral (select case reason when 'frontmatter-override' then opath when 'unique' then anypath when 'qualified-name' then qpath
    when 'path-in-note' then ppath when 'dotted-name' then dqpath when 'dotted-path' then dppath end as path) l
  left join defs d on d.name = y.name and d.path = l.path
)"""),
    "frefs": (("li", "p"), """
spelled as (
  select k, case s when 1 then typ || '.' || name when 2 then brand || '.' || typ || '.' || name when 5 then typ || '.' || ext else path end as ref,
    case when s = 4 then 1 else 0 end as bare, ln, pk from li where s in (1, 2, 4, 5)
), frefs as (
  select k, ref, min(bare) as bare, min(struct_pack(bare := bare, ln := ln, pk := pk)) as pos from spelled group by k, ref
), fres as (
  select k, ref, bare, pos, count(f.path) as n, string_agg(f.path, ' ' order by f.path) as matches
  from frefs left join (select distinct path from p) f on ends_with('/' || f.path, '/' || ref) group by k, ref, bare, pos
)"""),
    "links": (("dec",), """
links as (
  select * from (select *, row_number() over (partition by k order by case when evidence = 'inline-code' then 0 else 1 end, name) as rank
    from dec where path is not null) where rank <= {cap}
)"""),
    "anchors": (("links", "frefs"), """
anchors as (
  select k, 'RES-' || k as note, path, rank from (
    select k, matches as path, row_number() over (partition by k order by min(pos)) as rank from fres where n = 1 group by k, matches) a
  where rank <= {cap} - (select count(*) from links l where l.k = a.k)
)"""),
}


def sql(select: str, *names: str, cap: int = 8) -> str:
    """A select over the named expressions and those that they stand on."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in CTE[name][0]:
            need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    return "with " + ",".join(CTE[n][1].replace("{cap}", str(cap)) for n in order) + "\n" + select
