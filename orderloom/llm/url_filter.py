"""URL filters: fixed rules, then a path-template tree per host.

Urls are first folded to shapes (runs of digits in a segment become ``#``) and
counted per host and shape, with how many of them a rule blocks or allows: those
are the labelled urls.  Everything after works on that table, so a host with a
third of all urls weighs as many rows as it has shapes.

The tree grows a level at a time, all hosts together, down to the deepest path;
a shape that is alone at its node ends there with the rest of its path.  At each
node

- a child segment becomes the wildcard ``*`` if it is variable: it holds digits, or
  at least half of the node's urls are in children that occur once;
- the other children are held against their siblings by likelihood-ratio tests:
  what follows them (end, a folded number, a word), and their labelled rate where
  both sides have labels.  Children that neither test tells apart from the siblings
  merge into one branch ``{}``, labelled or not; the others keep their names.

A template is the path of such segments.  Its purity is the blocked share of its
labelled urls, smoothed with ``STRENGTH`` towards a prior half way between its
parent's purity and the corpus's, one half at most; so a branch that merged with labelled ones has
their support, and one that stands apart takes less from its parent.  A purity of
``REJECT`` or more blocks the template's urls without a rule.

Defined cases: a null url or one without ``://`` has an empty host and path and
takes the root template of the empty host; rows may repeat and page_id may be null;
an empty table gives no rows; only page_id and url are read, other columns may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._plan import broadcastable, table, written

#: Fixed values of the contract: (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

REJECT, STRENGTH, DAMP = 0.8, 4.0, 0.5
#: Standard normal quantile of the tests that keep branches apart (one in a hundred).
APART = 2.326

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path) by the contract's reading."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """Segments with runs of digits folded."""
    return F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda s: s != "")


def _likelihood(observed: Column, expected: Column) -> Column:
    """A cell's part of the G statistic."""
    return F.when(observed > 0, 2 * observed * F.log(observed / expected)).otherwise(0.0)


def _critical(freedom: Column) -> Column:
    """The chi-square quantile by Wilson and Hilferty's cubes."""
    k = F.greatest(freedom, F.lit(1)).cast("double")
    return k * F.pow(1 - 2 / (9 * k) + APART * F.sqrt(2 / (9 * k)), F.lit(3.0))


def _unlike(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by`` of the segments whose counts over ``cell`` differ from their siblings'."""
    node = [c for c in by if c != "segment"]
    cells = rows.groupBy(*by, "cell").agg(F.sum("n").alias("o"))
    whole = cells.groupBy(*by).agg(F.sum("o").alias("own"))
    pooled = cells.groupBy(*node, "cell").agg(F.sum("o").alias("cell_n"))
    total = cells.groupBy(*node).agg(F.sum("o").alias("total"), F.countDistinct("cell").alias("kinds"))
    # a segment without urls in a cell has none to observe there, its siblings have
    grid = whole.join(pooled, node).join(total, node).join(cells, [*by, "cell"], "left").withColumn("o", F.coalesce("o", F.lit(0)))
    grid = grid.filter("own < total")
    expected = F.col("own") * F.col("cell_n") / F.col("total")
    others = (F.col("total") - F.col("own")) * F.col("cell_n") / F.col("total")
    g = F.sum(_likelihood(F.col("o"), expected) + _likelihood(F.col("cell_n") - F.col("o"), others))
    return grid.groupBy(*by).agg(g.alias("g"), F.max("kinds").alias("kinds")).filter(F.col("g") > _critical(F.col("kinds") - 1)).select(*by)


def _level(rows: DataFrame, depth: int) -> DataFrame:
    """The rows with the template grown by their segment at ``depth``, counted from 1."""
    follows = F.try_element_at("shape", F.lit(depth + 1))
    rows = rows.withColumn("segment", F.element_at("shape", F.lit(depth)))
    by = ["host", "template", "segment"]
    child = rows.groupBy(*by).agg(F.sum("n").alias("n"))
    node = child.groupBy("host", "template").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("single"))
    child = child.join(node, ["host", "template"]).withColumn("variable", F.col("segment").contains("#") | (2 * F.col("single") >= F.col("all")))
    fixed = rows.join(child.filter("not variable").select(*by), by, "left_semi")
    next_kind = F.when(follows.isNull(), "").when(follows.contains("#"), follows).otherwise("a")
    shapes = fixed.select(*by, next_kind.alias("cell"), "n")
    labels = fixed.select(*by, F.explode(F.array(
        F.struct(F.lit("b").alias("cell"), F.col("blocked").alias("n")), F.struct(F.lit("a").alias("cell"), F.col("allowed").alias("n"))
    )).alias("x")).select(*by, "x.cell", "x.n").filter("n > 0")
    apart = _unlike(shapes, by).unionByName(_unlike(labels, by)).distinct().withColumn("apart", F.lit(True))
    name = F.when(F.col("variable"), "*").when(F.col("apart"), F.col("segment")).otherwise("{}")
    named = child.join(apart, by, "left").select(*by, F.concat("template", F.lit("/"), name).alias("next"))
    return rows.join(named, by).withColumn("parents", F.concat("parents", F.array("template"))).withColumn("template", F.col("next")).drop("next", "segment")


def templates(shapes: DataFrame) -> DataFrame:
    """host, shape, template, parents (the templates above) and the counts, from (host, shape, n, blocked, allowed)."""
    active = written(shapes.withColumns({"template": F.lit(""), "parents": F.array().cast("array<string>")}))
    done, depth = [], 0
    while True:
        depth += 1
        more = F.size("shape") >= depth
        crowd = active.groupBy("host", "template").agg(F.count(F.lit(1)).alias("rows"))
        rest = active.join(crowd, ["host", "template"])
        tail = F.concat_ws("/", F.lit(""), F.transform(F.slice("shape", depth, F.greatest(F.size("shape"), F.lit(1))), lambda s: F.when(s.contains("#"), "*").otherwise(s)))
        alone = rest.filter(more & (F.col("rows") == 1)).drop("rows")
        done.append(active.filter(~more))
        done.append(alone.withColumn("parents", F.concat("parents", F.array("template"))).withColumn("template", F.concat("template", tail)))
        active = written(_level(rest.filter(more & (F.col("rows") > 1)).drop("rows"), depth))
        if active.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return written(out)


def purities(tree: DataFrame) -> DataFrame:
    """host, template, purity: of each template and, on the way, of its parents."""
    share = (F.coalesce(F.sum("blocked"), F.lit(0)) + 1) / (F.coalesce(F.sum("blocked") + F.sum("allowed"), F.lit(0)) + 2)
    corpus = tree.agg(F.least(share, F.lit(0.5)).alias("base"))  # many blocked elsewhere don't speak against a host
    line = F.concat("parents", F.array("template"))
    every = tree.select("host", F.col("template").alias("leaf"), "blocked", "allowed", F.posexplode(line).alias("level", "node"))
    counts = every.groupBy("host", F.col("node")).agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
    path = every.select("host", "leaf", "level", "node").distinct().join(counts, ["host", "node"])
    # from the root down: smoothed by what is above
    steps = path.groupBy("host", "leaf").agg(F.array_sort(F.collect_list(F.struct("level", "b", "a"))).alias("steps")).join(F.broadcast(corpus))
    begin = F.col("base")
    step = lambda p, s: (s["b"] + STRENGTH * (DAMP * p + (1 - DAMP) * F.col("base"))) / (s["b"] + s["a"] + STRENGTH)
    return steps.select("host", F.col("leaf").alias("template"), F.aggregate("steps", begin, step).alias("purity"))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity."""
    host, path = parsed(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruling": verdict, "shape": shape(F.col("path"))})
    count = lambda v: F.sum((F.coalesce(F.col("ruling"), F.lit("")) == v).cast("bigint"))
    shapes = written(rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), count("block").alias("blocked"), count("allow").alias("allowed")))
    tree = templates(shapes)
    placed = written(tree.select("host", "shape", "template").join(purities(tree), ["host", "template"]))
    method = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(broadcastable(placed, 8 << 20), ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruling", method).alias("verdict"), "template", "purity"
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
