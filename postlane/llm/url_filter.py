"""URL filter: host and path rules first, then a path-template tree for each host.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased.
Path: then up to `?`, `#` or the end. A null url, or one without `://`, has
both empty. A rule `host/path` fits its host and all subdomains if the path
starts with `/path`; the longest that fits wins.

The tree: a path's segments that hold a digit become `*` at once. Level by
level, the children of a node become `*` when they are many and thin (at least
`many` distinct ones, with fewer than `thin` urls each on average); a child
whose share of blocked urls does not differ significantly from that of all its
labelled siblings is merged with the others like it into `~`, and so is a child
without labels, which nothing sets apart from them. Urls that a rule decides
are the labels. A template is rejected when its smoothed purity,
(blocked + weight * overall share) / (labelled + weight), is at least `purity`;
urls of no labelled template are allowed. So an unlabelled branch is judged by
the siblings that are like the host's average, or allowed where there are none.

All of it is DataFrame functions. Counts are combined before each shuffle, and
only distinct (host, shape) pairs take part in the tree. Levels past `depth`
share one last segment; urls of any length are read whole. Clashing extra
columns are not read. Rules of equal length that both fit count in their given
order. Repeated rows count as often as they occur and each get a row. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlane.llm import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MANY, THIN, DEPTH, Z2, WEIGHT, PURITY = 16, 4, 4, 3.84, 4, 0.6


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fits(rule: str, host: Column, path: Column) -> Column:
    name, _, rest = rule.partition("/")
    return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row. `rules`: (allow or block, `host/path`), a list that fits in one expression."""
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    by_length = sorted(rules, key=lambda r: -len(r[1]))
    hits = [F.when(fits(r, F.col("host"), F.col("path")), F.lit(r)) for _, r in by_length]
    ruled = seen.withColumn("rule", F.coalesce(*hits) if hits else F.lit(None).cast("string"))
    action = F.when(F.col("rule").isin([r for a, r in rules if a == "block"]), "block").when(F.col("rule").isNotNull(), "allow")
    shape = F.regexp_replace(F.regexp_replace("path", "[^/]*[0-9][^/]*", "*"), "^/|/$", "")
    ruled = ruled.withColumn("shape", shape)
    blocked = (F.col("rule").isNotNull() & (action == "block")).cast("bigint")
    shapes = ruled.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("rule").alias("labelled"), F.sum(blocked).alias("blocked"))
    bad = rejected(shapes).withColumn("bad", F.lit(True))
    judged = ruled.join(bad, ["host", "shape"], "left")
    verdict = F.coalesce(action, F.when(F.col("bad"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def rejected(shapes: DataFrame) -> DataFrame:
    """The (host, shape) of rejected templates, of (host, shape, n, labelled, blocked)."""
    tree = store.saved(shapes)
    seg = lambda k: F.coalesce(F.get(F.split("shape", "/", DEPTH), F.lit(k)), F.lit(""))
    total = tree.agg(F.sum("labelled"), F.sum("blocked")).first()
    labelled, blocked = total[0] or 0, total[1] or 0
    tree = tree.withColumn("node", F.lit(""))
    for k in range(DEPTH):
        children = tree.groupBy("host", "node", seg(k).alias("seg")).agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        nodes = children.groupBy("host", "node").agg(F.count("*").alias("kinds"), F.sum("n").alias("all_n"), F.sum("l").alias("all_l"), F.sum("b").alias("all_b"))
        thin = (F.col("kinds") >= MANY) & (F.col("all_n") < THIN * F.col("kinds"))
        gap = F.col("b").cast("double") * F.col("all_l") - F.col("all_b").cast("double") * F.col("l")
        spread = Z2 * F.col("all_b").cast("double") * (F.col("all_l") - F.col("all_b")) * F.col("l")
        name = F.when(F.col("seg") == "", "").when(thin, "*").when(gap * gap <= spread, "~").otherwise(F.col("seg"))
        named = children.join(nodes, ["host", "node"]).select("host", "node", "seg", name.alias("name"))
        # A table each level: the plan of a level names the one before it three times.
        tree = store.saved(tree.withColumn("seg", seg(k)).join(named, ["host", "node", "seg"]).withColumn("node", F.concat("node", F.lit("/"), "name")).drop("seg", "name"))
    templates = tree.groupBy("host", "node").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    # Purity as whole numbers times the overall count, so that equal sums compare equal everywhere.
    reject = (F.col("l") > 0) & ((F.col("b") * labelled + WEIGHT * blocked).cast("double") >= PURITY * ((F.col("l") + WEIGHT) * labelled).cast("double"))
    return tree.join(templates.filter(reject).select("host", "node"), ["host", "node"], "left_semi").select("host", "shape")


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def oracle_sql(rules: list[tuple[str, str]] = RULES) -> str:
    """The same in SQL, level by level."""
    by_length = sorted(rules, key=lambda r: -len(r[1]))

    def fit(rule: str) -> str:
        name, _, rest = rule.partition("/")
        return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')"

    case = " ".join(f"WHEN {fit(r)} THEN '{r}'" for _, r in by_length)
    block = ", ".join(f"'{r}'" for a, r in rules if a == "block")
    parts = [
        "a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        "h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a)",
        f"hp AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)",
        f"ru AS (SELECT *, CASE {case} END AS rule, regexp_replace(regexp_replace(path, '[^/]*[0-9][^/]*', '*', 'g'), '^/|/$', '', 'g') AS shape FROM hp)",
        f"t0 AS (SELECT host, shape, count(*) AS n, count(rule) AS labelled, count(*) FILTER (WHERE rule IN ({block})) AS blocked, '' AS node FROM ru GROUP BY host, shape)",
        "tot AS (SELECT sum(labelled) AS l, sum(blocked) AS b FROM t0)",
    ]
    for k in range(DEPTH):
        s = "string_split(shape, '/')"
        seg = f"coalesce({s}[{k + 1}], '')" if k < DEPTH - 1 else f"coalesce(array_to_string({s}[{DEPTH}:], '/'), '')"
        parts += [
            f"s{k} AS (SELECT *, {seg} AS seg FROM t{k})",
            f"c{k} AS (SELECT host, node, seg, sum(n) AS n, sum(labelled) AS l, sum(blocked) AS b FROM s{k} GROUP BY ALL)",
            f"n{k} AS (SELECT host, node, count(*) AS kinds, sum(n) AS an, sum(l) AS al, sum(b) AS ab FROM c{k} GROUP BY ALL)",
            f"m{k} AS (SELECT host, node, seg, CASE WHEN seg = '' THEN '' WHEN kinds >= {MANY} AND an < {THIN} * kinds THEN '*' WHEN (b::DOUBLE * al - ab::DOUBLE * l) * (b::DOUBLE * al - ab::DOUBLE * l) <= {Z2}::DOUBLE * ab::DOUBLE * (al - ab) * l THEN '~' ELSE seg END AS name FROM c{k} JOIN n{k} USING (host, node))",
            f"t{k + 1} AS (SELECT host, shape, n, labelled, blocked, node || '/' || name AS node FROM s{k} JOIN m{k} USING (host, node, seg))",
        ]
    parts += [
        f"bad AS (SELECT host, node FROM t{DEPTH} GROUP BY ALL HAVING sum(labelled) > 0 AND (sum(blocked) * (SELECT l FROM tot) + {WEIGHT} * (SELECT b FROM tot))::DOUBLE >= {PURITY}::DOUBLE * ((sum(labelled) + {WEIGHT}) * (SELECT l FROM tot))::DOUBLE)",
        f"badshape AS (SELECT DISTINCT host, shape FROM t{DEPTH} JOIN bad USING (host, node))",
    ]
    return f"WITH {', '.join(parts)} SELECT page_id, host, path, rule, CASE WHEN rule IN ({block}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN s.shape IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM ru LEFT JOIN badshape s USING (host, shape)"
