"""URL filters by a tree of path templates.

Fixed rules decide the urls that they fit. They are also the labels of the method that
decides all others: per host, the segments of the paths are put into a tree, which is built
from the root down, level by level. Numbers, long hexadecimal and other generated segments
become wildcards by their shape. At each node the children that hold less than ``RARE`` of
the node's pages become one wildcard, so that others are few. These, and the wildcard, are
merged when they are alike: by descending pages, each joins the first group whose greatest
child has, by Jensen-Shannon divergence, the same mixture of shapes below it and the same
mixture of labels. Both mixtures are drawn to that of the pair by ``DRAWN`` pages, so that
few pages don't tell children apart, nor do unlabelled ones. What merges is one node of
the next level. A template's purity is the share of blocked pages among its labelled ones,
smoothed by ``PSEUDO`` pages and by ``UNSEEN`` of its unlabelled ones, half of them blocked:
a template whose labelled pages are all blocked is rejected from about one for four others on.

The rounds go as deep as the longest path that two keys of a host share: a key that is alone leaves
them. Their cost does not grow from one to the next. Shares and mixtures decide, not numbers
of rows, so that more rows of the same kind give the same tree.

Null urls and such without ``://`` have empty host and path and are allowed, as is
everything on a host without labels. Repeated rows get equal results and weigh as often as
they occur; of children with equally many pages the first by name leads. Long urls are used
whole. Extra columns are not looked at; an empty table gives no rows. All on DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import ascii_lower, checkpoint, lookup_join
from lodeframe.session import settle

# The rules of the contract.
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
#: Children with a lower share of the node's pages become one wildcard: at most 1 / RARE others are left.
RARE = 0.01
#: Children merge below this divergence (in bits), each drawn to the pair's mixture by so many pages.
DIVERGENCE, DRAWN = 0.05, 8.0
#: A template is rejected from this purity on, with so many pseudo-pages and such a weight of unlabelled pages.
PURITY, PSEUDO, UNSEEN = 0.75, 2.0, 0.25
#: Shapes that a segment can have, without its wording.
CLASSES = ["", "word", "word.", "{n}", "{n}.", "{x}", "{x}.", "{s}", "{s}."]


def host(url: Column) -> Column:
    found = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(F.when(url.contains("://"), found)), F.lit(""))


def path(url: Column) -> Column:
    found = F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.when(url.contains("://"), found), F.lit(""))


def rule_of(host_: Column, path_: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):
        domain, slash, rest = name.partition("/")
        fits = ((host_ == domain) | host_.endswith(f".{domain}")) & path_.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def shape(segment: Column) -> Column:
    """Generated segments by their shape: {n}, {x} for hexadecimal, {s} for long ones; an extension stays.

    Others stay as they are, after a mark if they start like a shape or a name of the tree.
    """
    ext = F.regexp_extract(segment, "(\\.[A-Za-z]{1,5})$", 1)
    stem = F.substring(segment, F.lit(1), F.length(segment) - F.length(ext))
    kind = F.when(stem.rlike("^[0-9]+$"), F.lit("{n}")).when(stem.rlike("^[0-9a-fA-F-]{8,}$") & stem.rlike("[0-9]"), F.lit("{x}")).when(F.length(stem) > 40, F.lit("{s}"))
    return F.coalesce(F.concat(kind, ext), F.when(segment.rlike("^[*~{=]"), F.concat(F.lit("="), segment)).otherwise(segment))


def shape_class(segment: Column) -> Column:
    """Which of ``CLASSES`` a segment has; null and empty ones have the first."""
    dot = F.when(segment.rlike("\\.[A-Za-z]{1,5}$"), ".").otherwise("")
    kind = F.when(segment.rlike("^\\{[nxs]\\}"), F.substring(segment, 1, 3)).otherwise("word")
    return F.when(F.coalesce(segment, F.lit("")) == "", "").otherwise(F.concat(kind, dot))


def divergence(one: str, other: str, n: str, m: str) -> str:
    """Jensen-Shannon divergence, as SQL, of two arrays of counts that sum to ``n`` and ``m``, each drawn to what they are together."""
    drawn = lambda c, of: f"({c} + {DRAWN}D * (u + v) / greatest({n} + {m}, 1)) / ({of} + {DRAWN}D)"
    pairs = f"zip_with({one}, {other}, (u, v) -> named_struct('p', {drawn('u', n)}, 'q', {drawn('v', m)}))"
    part = lambda p, q: f"if(z.{p} > 0, z.{p} * log2(2 * z.{p} / (z.p + z.q)) / 2, 0D)"
    return f"aggregate({pairs}, 0D, (s, z) -> s + {part('p', 'q')} + {part('q', 'p')})"


def _named(children: str) -> str:
    """A map from each child to its name in the tree, as SQL, from an array (less, seg, shapes, labels) by descending pages."""
    shapes = divergence("l.shapes", "x.shapes", "-l.less", "-x.less")
    labels = divergence("l.labels", "x.labels", "(l.labels[0] + l.labels[1])", "(x.labels[0] + x.labels[1])")
    lead = f"get(filter(a.leads, l -> {shapes} < {DIVERGENCE} and {labels} < {DIVERGENCE}), 0)"
    start = f"named_struct('leads', slice({children}, 1, 0), 'got', cast(array() as array<struct<seg: string, lead: string>>))"
    step = f"transform(array({lead}), f -> named_struct('leads', if(f is null, concat(a.leads, array(x)), a.leads), 'got', concat(a.got, array(named_struct('seg', x.seg, 'lead', coalesce(f.seg, x.seg))))))[0]"
    groups = f"aggregate({children}, {start}, (a, x) -> {step}, a -> a.got)"
    name = "case when e.lead = '*' then '*' when size(filter(g, o -> o.lead = e.lead)) > 1 then concat('~', e.lead) else e.seg end"
    return f"transform(array({groups}), g -> map_from_entries(transform(g, e -> struct(e.seg, {name}))))[0]"


def _names(rows: DataFrame, total: int) -> DataFrame:
    """host, up, names (of its children; ``*`` stands for all rare ones), alone, weight (rows) of each node."""
    below = [F.sum(F.when(F.col("below") == c, F.col("n")).otherwise(0)).cast("double") for c in CLASSES]
    labels = [F.sum(F.col("labelled") - F.col("blocked")).cast("double"), F.sum("blocked").cast("double")]
    child = rows.groupBy("host", "up", "seg").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.array(*below).alias("shapes"), F.array(*labels).alias("labels"))
    node = child.groupBy("host", "up").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("weight"))
    child = lookup_join(child, node, ["host", "up"], "weight", total)
    # What is left of a node are 1 / RARE children at most, and the wildcard.
    seg = F.when(F.col("n") >= RARE * F.col("pages"), F.col("seg")).otherwise("*")
    sums = lambda name, size: F.array(*[F.sum(F.col(name)[i]) for i in range(size)]).alias(name)
    few = child.withColumn("seg", seg).groupBy("host", "up", "seg").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"), sums("shapes", len(CLASSES)), sums("labels", 2))
    found = few.groupBy("host", "up").agg(F.sum("rows").alias("weight"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "seg", "shapes", "labels"))).alias("c"))
    return settle(found.select("host", "up", F.expr(_named("c")).alias("names"), (F.col("weight") == 1).alias("alone"), "weight"))


def templates(pages: DataFrame) -> tuple[DataFrame, int]:
    """host, key, n, template, purity, rejected for each ``key``, a path of shapes, and the number of pages.

    ``pages`` has host, key and label. The tree is built on the different keys of a host and cut
    from its lineage after each level, as the next one reads it more than once. A key that is alone
    in its node has nothing to be compared with, and what follows in it is taken as it is.
    """
    rows = pages.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.count(F.when(F.col("label") == "block", 1)).alias("blocked"))
    rows = checkpoint(rows.withColumn("t", F.split("key", "/")).withColumn("up", F.lit("")))
    size = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pages"), F.count(F.lit(1)).alias("keys")).first()
    parts, level = [], 0
    while not rows.isEmpty():
        now = rows.withColumn("seg", F.get("t", F.lit(level))).withColumn("below", shape_class(F.get("t", F.lit(level + 1))))
        now = lookup_join(now, _names(now, size["keys"]), ["host", "up"], "weight", size["keys"])
        level += 1
        name = F.coalesce(F.element_at("names", F.col("seg")), F.element_at("names", F.lit("*")))
        rest = F.array_join(F.slice("t", level, 1 << 30), "/")
        ended = F.col("alone") | (F.size("t") <= level)
        # Each level joins what the last one wrote, so sizes must not be estimated from sizes.
        now = settle(now.withColumn("up", F.concat("up", F.lit("/"), F.when(F.col("alone"), rest).otherwise(name))).withColumn("ended", ended).drop("seg", "below", "names", "alone"))
        parts.append(now.filter("ended"))
        rows = now.filter("not ended").drop("ended")
    rows = rows.withColumn("ended", F.lit(True))
    for part in parts:
        rows = rows.unionByName(part)
    rows = rows.select("host", "key", "n", "labelled", "blocked", F.col("up").alias("template"))
    found = rows.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("seen"), F.sum("blocked").alias("bad"), F.count(F.lit(1)).alias("keys"))
    found = checkpoint(found.withColumn("purity", purity(F.col("bad"), F.col("seen"), F.col("n"))).select("host", "template", "purity", "keys"))
    out = lookup_join(rows, found, ["host", "template"], "keys", size["keys"])
    return out.select("host", "key", "n", "template", "purity", (F.col("purity") >= PURITY).alias("rejected")), size["pages"]


def purity(bad: Column, seen: Column, n: Column) -> Column:
    """The share of blocked pages, with pseudo-pages and a part of the unlabelled ones, half of them blocked."""
    more = F.lit(PSEUDO) + UNSEEN * (n - seen)
    return (bad + more / 2) / (seen + more)


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    key = F.array_join(F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), shape), "/")
    rows = rows.withColumn("rule", rule).withColumn("label", says).withColumn("key", key)
    found, total = templates(rows.select("host", "key", "label"))
    rows = lookup_join(rows, checkpoint(found), ["host", "key"], "n", total)
    verdict = F.coalesce("label", F.when(F.col("rejected") & (F.col("host") != ""), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
