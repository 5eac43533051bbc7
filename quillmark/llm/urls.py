"""URL filter by a tree of path templates, on DataFrame functions alone.

A url's verdict is that of the longest rule that fits it. The rest are judged by their template. The
segments of each host's paths, all of them, form a tree; runs of digits and long hexadecimal runs in a segment are one wildcard. Level by
level, rare children of a node are generalised into one branch. The branches of the node are then ordered by the shares of their urls
that rules block and allow, and neighbours that two-proportion z tests don't tell apart are merged, so unlike
branches stay apart however many siblings they have. A node with fewer than ``LEAST`` urls that go on is a leaf, as no test could part its
branches, and so is a path's end. A leaf is a template. Its purity is the share of blocked urls among its labelled ones, those that a rule blocks or
allows, smoothed by ``ALPHA`` urls of ``PRIOR``; more than ``REJECT`` blocks. Without labelled urls that is the prior, which allows.

Urls are first counted by host and shape, so the tree is built from one row for each shape, and branches with
equal counts are one row where they are ordered.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import Scratch

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MOST_RULES = 1000
#: Children with fewer urls are rare; nodes with fewer urls are leaves; the test's quantile.
RARE, LEAST, Z = 5, 10, 1.96
ALPHA, PRIOR, REJECT = 2.0, 0.5, 0.8
VARIABLE = "[0-9a-fA-F]{16,}|[0-9]+"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-case host and path; both empty if the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule (host and path prefix) that fits, or null; of equally long ones the first given."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = F.lit(None).cast("string")
    for _, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        h, slash, p = rule.partition("/")
        out = F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(slash + p)), F.lit(rule)).otherwise(out)
    return out


def _shape() -> Column:
    return F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, VARIABLE, "#"))


def _differ(x: str, n: str, y: str, m: str) -> str:
    """SQL: whether x of n and y of m differ by a two-proportion z test, each with one more hit and one more miss."""
    one, two, four, z = (f"CAST({v} AS DOUBLE)" for v in (1, 2, 4, Z))
    pooled = f"(({x} + {y} + {two}) / ({n} + {m} + {four}))"
    return f"abs(({x} + {one}) / ({n} + {two}) - ({y} + {one}) / ({m} + {two})) > {z} * sqrt({pooled} * ({one} - {pooled}) * ({one} / ({n} + {two}) + {one} / ({m} + {two})))"


#: Whether a branch differs from the one before it in the share of blocked or of allowed urls.
_APART = f"({_differ('nb', 'n', 'pb', 'pn')}) or ({_differ('na', 'n', 'pa', 'pn')})"
_COUNTS = ("n", "nb", "na")


def _level(shapes: DataFrame, level: int, scratch: Scratch) -> DataFrame:
    """Adds the level's branch to the template of each shape that goes on there; one that ends, or whose node is a leaf, is closed."""
    here = shapes.filter("open").withColumn("seg", F.get("shape", F.lit(level)))
    children = here.filter("seg is not null").groupBy("host", "template", "seg").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    children = scratch.put(children.withColumn("branch", F.when(F.col("n") < RARE, "*").otherwise(F.concat(F.lit("="), "seg"))), f"children-{level}")
    branches = children.groupBy("host", "template", "branch").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    kinds = branches.groupBy("host", "template", *_COUNTS).agg(F.count("*").alias("many"))
    node = Window.partitionBy("host", "template")
    order = node.orderBy(F.col("nb") / F.col("n"), F.col("na") / F.col("n"), "n")
    before = kinds.withColumn("m", F.sum(F.col("n") * F.col("many")).over(node)).filter(F.col("m") >= LEAST)
    before = before.select("*", F.lag("n").over(order).alias("pn"), F.lag("nb").over(order).alias("pb"), F.lag("na").over(order).alias("pa"))
    told = before.withColumn("g", F.sum(F.coalesce(F.expr(_APART), F.lit(True)).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    told = told.select("host", "template", *_COUNTS, "g", (F.sum("many").over(Window.partitionBy("host", "template", "g")) == 1).alias("alone"))
    told = scratch.put(told, f"told-{level}")
    new = F.when(F.col("alone"), F.col("branch")).otherwise(F.concat(F.lit("*"), F.col("g").cast("string")))
    named = branches.join(told.hint("merge"), ["host", "template", *_COUNTS]).select("host", "template", "branch", new.alias("new"))
    chosen = children.select("host", "template", "seg", "branch").join(named.hint("merge"), ["host", "template", "branch"]).select("host", "template", "seg", "new")
    joined = here.join(chosen.hint("merge"), ["host", "template", "seg"], "left")
    grown = F.when(F.col("new").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "new"))
    done = joined.select("host", "key", "shape", *_COUNTS, grown.alias("template"), (F.col("new").isNotNull() & (F.size("shape") > level + 1)).alias("open"))
    return shapes.filter("not open").unionByName(done)


def templates(shapes: DataFrame, scratch: Scratch) -> DataFrame:
    """The template of each shape; a level a round, until every shape is closed."""
    level, shapes = 0, scratch.put(shapes.withColumn("template", F.lit("")).withColumn("open", F.lit(True)), "level-0")
    while not shapes.filter("open").isEmpty():
        level += 1
        shapes = scratch.put(_level(shapes, level - 1, scratch), f"level-{level}")
        scratch.drop(f"level-{level - 1}", f"children-{level - 1}", f"told-{level - 1}")
    return shapes


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_column: str = "page_id") -> DataFrame:
    """(id_column, host, path, rule, verdict, template, purity) of each row; verdict is allow or block, template and purity are the method's.

    rules: (verdict, host and path prefix), MOST_RULES at most. A null url, and one without ``://``, have empty host and path. Equal urls
    get equal verdicts; rows that repeat a url count each. Paths of any depth are followed to their end. An empty table gives an empty result."""
    scratch = Scratch(pages.sparkSession, "urls")
    rows = pages.select(F.col(id_column), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select(id_column, host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", _shape()).withColumn("key", F.array_join("shape", "/"))
    verdicts = {v: [r for w, r in rules if w == v] for v in ("block", "allow")}
    labelled = {v: F.coalesce(F.col("rule").isin(own), F.lit(False)) for v, own in verdicts.items()}
    shapes = rows.groupBy("host", "key").agg(F.any_value("shape").alias("shape"), F.count("*").alias("n"), F.sum(labelled["block"].cast("long")).alias("nb"), F.sum(labelled["allow"].cast("long")).alias("na"))
    shapes = templates(shapes, scratch)
    leaves = shapes.groupBy("host", "template").agg(F.sum("nb").alias("b"), F.sum("na").alias("a"))
    pure = leaves.select("host", "template", ((F.col("b") + ALPHA * PRIOR) / (F.col("b") + F.col("a") + ALPHA)).alias("purity"))
    by_shape = scratch.put(shapes.select("host", "key", "template").join(scratch.put(pure, "pure").hint("merge"), ["host", "template"]), "by_shape")
    done = rows.select(id_column, "host", "path", "rule", "key").join(by_shape.hint("merge"), ["host", "key"])
    own = F.when(F.col("purity") > REJECT, "block").otherwise("allow")
    verdict = F.when(F.col("rule").isin(verdicts["block"]), "block").when(F.col("rule").isin(verdicts["allow"]), "allow").otherwise(own)
    return done.select(id_column, "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op5(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of each row."""
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


#: Levels that the SQL is written out for; it holds for tables whose paths have no more segments.
SQL_LEVELS = 6


def _levels_sql() -> str:
    out = []
    for k in range(SQL_LEVELS):
        before = f"l{k - 1}" if k else "shapes"
        out.append(f"""
, c{k} AS (SELECT host, template, shape[{k + 1}] AS seg, sum(n) AS n, sum(nb) AS nb, sum(na) AS na FROM {before} WHERE open AND len(shape) > {k} GROUP BY ALL)
, b{k} AS (SELECT host, template, CASE WHEN n < {RARE} THEN '*' ELSE '=' || seg END AS branch, sum(n) AS n, sum(nb) AS nb, sum(na) AS na FROM c{k} GROUP BY ALL)
, o{k} AS (SELECT * FROM b{k} SEMI JOIN (SELECT host, template FROM b{k} GROUP BY ALL HAVING sum(n) >= {LEAST}) USING (host, template))
, p{k} AS (SELECT *, lag(n) OVER w AS pn, lag(nb) OVER w AS pb, lag(na) OVER w AS pa FROM o{k} WINDOW w AS (PARTITION BY host, template ORDER BY nb / n::DOUBLE, na / n::DOUBLE, n))
, g{k} AS (SELECT host, template, branch, sum(coalesce({_APART}, TRUE)::INT) OVER (PARTITION BY host, template ORDER BY nb / n::DOUBLE, na / n::DOUBLE, n RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM p{k})
, m{k} AS (SELECT host, template, branch, CASE WHEN count(*) OVER (PARTITION BY host, template, g) = 1 THEN branch ELSE '*' || g END AS new FROM g{k})
, l{k} AS (SELECT s.host, s.key, s.shape, s.n, s.nb, s.na, CASE WHEN m.new IS NULL THEN s.template ELSE s.template || '/' || m.new END AS template, m.new IS NOT NULL AND len(s.shape) > {k + 1} AS open
    FROM {before} s LEFT JOIN c{k} c ON s.open AND s.host = c.host AND s.template = c.template AND s.shape[{k + 1}] = c.seg
    LEFT JOIN m{k} m ON m.host = c.host AND m.template = c.template AND m.branch = CASE WHEN c.n < {RARE} THEN '*' ELSE '=' || c.seg END)""")
    return "".join(out)


OP5_SQL = (
    rf"""
WITH r AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule,
    list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(s, '{VARIABLE}', '#', 'g')) AS shape FROM hp
), keyed AS (
  SELECT *, coalesce(array_to_string(shape, '/'), '') AS key FROM ruled
), shapes AS (
  SELECT host, key, any_value(shape) AS shape, count(*) AS n, count(*) FILTER (rule IN ('net/', 'example.com/de/')) AS nb, count(*) FILTER (rule IN ('example.net/en/', 'org/fr/')) AS na, '' AS template, TRUE AS open
  FROM keyed GROUP BY host, key
)"""
    + _levels_sql()
    + f"""
, pure AS (SELECT host, template, (sum(nb) + {ALPHA * PRIOR}::DOUBLE) / (sum(nb) + sum(na) + {ALPHA}::DOUBLE) AS purity FROM l{SQL_LEVELS - 1} GROUP BY host, template)
SELECT k.page_id, k.host, k.path, k.rule, CASE WHEN k.rule IN ('net/', 'example.com/de/') THEN 'block' WHEN k.rule IS NOT NULL THEN 'allow' WHEN p.purity > {REJECT} THEN 'block' ELSE 'allow' END AS verdict
FROM keyed k JOIN l{SQL_LEVELS - 1} l USING (host, key) JOIN pure p ON p.host = l.host AND p.template = l.template
"""
)
