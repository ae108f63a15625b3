"""URL filters: listed rules first, and a path-template tree of each host for the rest.

Pages that a rule judges are the labelled ones. Paths are cut into segments, runs of digits generalised to ``#``, and followed to
their end, level by level. Below a host's template a segment with ``LEAST_PAGES`` pages or ``LEAST_LABELLED`` labelled ones is a branch
of its own, whatever its siblings are; only the sparse rest shares the wildcard ``*``. Branches whose labelled block shares do not differ
significantly (two-proportion z-test between neighbours by share) merge into one. A template's purity is its labelled block share,
smoothed by ``SMOOTHING`` pages of the share estimated for the node above it; at ``REJECT`` or more its pages without a rule are blocked.

Estimates go down the tree, from the overall share over the host to each node: a node's labelled pages count as they are, its other
pages, or ``SMOOTHING`` if those are fewer, at the estimate above. So a section without labels is rejected where most pages around it
are known and bad, and stays where the bad ones are a small section of a wide host. A path that ends at an inner node takes that
node's estimate.

All of it is grouping and joining of counts by host and template: pages are first summed by host and generalised path, so a host with
a third of all pages is a sum of partial sums, and a window sees only siblings with enough labelled pages. Templates that hold one
path, or too few pages for any branch, are ended at once, so the levels are those where paths with enough pages part.

Cases: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed unless its template is
rejected; a path ends at ``?``, ``#`` or the end; repeated pages count each; ties between equally long rules go to the
first by text; an empty table gives an empty result; other columns stay, but for those named like a result column, which
are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.llm.passes import carried, named
from doclens.session import materialise

# The listed rules, host and path as one.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

#: A segment with so many pages, or labelled pages, is a branch of its own.
LEAST_PAGES, LEAST_LABELLED = 5, 5
#: Neighbouring branches merge below this z-value, if both have enough labelled pages.
SIMILAR_Z = 1.645
#: Segments that the name of a merged branch lists; it counts the others.
NAMED = 8
SMOOTHING, REJECT = 10.0, 0.7

#: Templates of at most so many shapes are sent to all tasks (some 20 MB); others are joined, in so many salts of each shape.
BROADCAST_ROWS, SALTS = 100_000, 16

RESULT = ["host", "path", "rule", "template", "purity", "verdict"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r), r))[::-1]:
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: dict[str, str] = RULES) -> Column:
    return reduce(lambda out, r: F.when(rule == r, F.lit(rules[r])).otherwise(out), rules, F.lit(None).cast("string"))


def estimate(above: Column) -> Column:
    """Block share of a node's pages, given the estimate of the node above it."""
    unknown = F.greatest(F.col("n") - F.col("n_labelled"), F.lit(SMOOTHING))
    return (F.col("n_blocked") + unknown * above) / (F.col("n_labelled") + unknown)


def templates(paths: DataFrame) -> DataFrame:
    """``paths``: host, shape (generalised path), n, n_labelled, n_blocked. Adds the template that each falls under, and the
    estimate ``above`` it."""
    paths = materialise(paths, "url-paths")
    sums = [F.sum(c).alias(c) for c in ("n", "n_labelled", "n_blocked")]
    total = paths.agg(*sums).first()
    overall = min(0.5, (total.n_blocked or 0) / max(1, total.n_labelled or 0))
    hosts = paths.groupBy("host").agg(*sums).select("host", estimate(F.lit(overall)).alias("above"))
    segments = F.filter(F.split("shape", "/"), lambda s: s != "")
    live = paths.join(hosts, "host").withColumn("segments", segments).withColumn("template", F.lit(""))
    result = [*paths.columns, "template", "above"]
    enough = (F.col("n") >= LEAST_PAGES) | (F.col("n_labelled") >= LEAST_LABELLED)
    tested = F.col("n_labelled") >= LEAST_LABELLED
    share = F.col("n_blocked") / F.col("n_labelled")
    siblings = Window.partitionBy("host", "template").orderBy(share, "segment")
    before = [F.lag(c).over(siblings) for c in ("n_labelled", "n_blocked")]
    both = (F.col("n_blocked") + before[1]) / (F.col("n_labelled") + before[0])
    error = F.sqrt(both * (1 - both) * (1 / F.col("n_labelled") + 1 / before[0]))
    apart = F.abs(share - before[1] / before[0])
    opens = F.when((apart == 0) | (apart < SIMILAR_Z * error), 0).otherwise(1)
    members = Window.partitionBy("host", "template", "branch")
    key, level, done = ["host", "template", "segment"], 0, []
    while not live.isEmpty():
        here = live.withColumn("segment", F.get("segments", F.lit(level)))
        done.append(here.where("segment is null").select(*result))
        counts = materialise(here.where("segment is not null").groupBy(*key).agg(*sums, F.count("*").alias("shapes"), F.max("above").alias("above")), "url-counts")
        cut = counts.where(tested).withColumn("opens", opens).withColumn("branch", F.sum("opens").over(siblings.rowsBetween(Window.unboundedPreceding, 0)))
        placed = cut.withColumn("place", F.row_number().over(members.orderBy("segment"))).withColumn("size", F.count("*").over(members))
        listed = placed.where(F.col("place") <= NAMED).groupBy("host", "template", "branch").agg(F.array_join(F.array_sort(F.collect_list("segment")), "|").alias("listed"))
        more = F.when(F.col("size") > NAMED, F.concat(F.lit("|+"), F.col("size") - NAMED)).otherwise(F.lit(""))
        merged = placed.join(listed, ["host", "template", "branch"]).select(*counts.columns, F.concat("listed", more).alias("name"))
        alone = counts.where(~tested).withColumn("name", F.when(enough, F.col("segment")).otherwise(F.lit("*")))
        named = materialise(merged.unionByName(alone), "url-branches")
        # a branch that no further level can divide: the rest of its paths stands as it is, or is sparse altogether
        below = named.groupBy("host", "template", "name").agg(*sums, F.sum("shapes").alias("shapes"), F.max("above").alias("above"))
        ended = below.select("host", "template", "name", estimate(F.col("above")).alias("here"), F.when(~enough, F.lit("sparse")).when(F.col("shapes") == 1, F.lit("one")).alias("end"))
        step = here.join(named.join(ended, ["host", "template", "name"]).select(*key, "name", "here", "end"), key)
        rest = F.slice("segments", level + 2, F.size("segments"))
        tail = F.when(F.col("end") == "one", rest).when(F.col("end") == "sparse", F.transform(rest, lambda s: F.lit("*")))
        template = F.array_join(F.concat(F.array("template", "name"), F.coalesce(tail, F.array().cast("array<string>"))), "/")
        step = materialise(step.withColumn("template", template), "url-level")
        done.append(step.where("end is not null").select(*result))
        live, level = step.where("end is null").select(*paths.columns, "segments", "template", F.col("here").alias("above")), level + 1
    return reduce(DataFrame.unionByName, done, live.select(*result))


def judge(pages: DataFrame, rules: dict[str, str] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, template, purity and verdict. Columns travel under numbered names, whatever their own are."""
    kept = carried(pages, None, RESULT)
    host, path = host_and_path(named(url))
    base = pages.select(*(named(c).alias(f"c{i}") for i, c in enumerate(kept)), host.alias("host"), path.alias("path"))
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", F.regexp_replace("path", "[0-9]+", "#"))
    ruled = verdict_of(F.col("rule"), rules)
    paths = base.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count(ruled).alias("n_labelled"), F.coalesce(F.sum((ruled == "block").cast("long")), F.lit(0)).alias("n_blocked"))
    tree = materialise(templates(paths), "url-templates")
    purity = (F.sum("n_blocked") + SMOOTHING * F.max("above")) / (F.sum("n_labelled") + SMOOTHING)
    pure = tree.groupBy("host", "template").agg(purity.alias("purity"))
    of_shape = tree.select("host", "shape", "template").join(pure, ["host", "template"]).select("host", "shape", "template", "purity")
    if tree.count() <= BROADCAST_ROWS:  # a row for each host and shape
        found = base.join(F.broadcast(of_shape), ["host", "shape"], "left")
    else:  # pages of one very common shape are dealt to several tasks
        salted = of_shape.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = base.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(salted, ["host", "shape", "salt"], "left")
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    judged = found.withColumn("verdict", verdict)
    return judged.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), *RESULT)
