"""URL filtering by a tree of path templates for each host.

Rules (host, path, allowed) judge the URLs they fit; the longest wins. What they judge are the labels from which
all other URLs are judged. The paths of a host form a tree of segments, walked from the root, one level at a time for
all hosts together:

* *Shape.* Runs of digits are variable wherever they stand: ``825.html`` becomes ``<n>.html``.
* *Wildcards.* A child seen on few rows, among many siblings, is a variable segment and joins the wildcard ``*``.
* *Merging.* So does a child that is statistically like all its siblings together: its share of blocked labels is
  within a number of standard errors of theirs, and the shapes that follow it are spread like those after them (total
  variation distance). One child alone is not merged.
* *Purity.* A node's share of blocked labels is smoothed by its parent's: ``(blocked + strength * parent's) / (labels +
  strength)``; above the root of a host stands the share of all labels. A template is rejected when the share at its
  leaf exceeds a threshold.

Branches with few different paths are not walked further: their shapes are their templates. So the rounds grow with the
depth at which many paths still differ, not with the longest path. Paths that occur on many rows are one row with
counts; children of a node are counted by combining aggregates, and a node is one row on its side of each join, so a
host with a third of all rows does no harm.

Null URLs and those without ``://`` have an empty host and path and form a host of their own. An empty path is the root
of its host. Hosts keep ports and user names, so a rule does not fit ``user@host``, or ``host:80``. Repeated rows have equal
results. An empty table gives no rows; without any label nothing is rejected. Columns beside id and URL are not
read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import column, fold_ascii, stored


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allowed: bool

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Settings:
    few: int = 5  # rows below which a child may be a variable segment
    many: int = 8  # children from which on it is one, and different paths below which a branch is not walked
    errors: float = 2.0  # standard errors within which a child's labels are like its siblings'
    distance: float = 0.35  # total variation within which what follows is alike
    strength: float = 5.0  # labels that the parent's share counts for
    rejected: float = 0.8  # share of blocked labels above which a template is rejected


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(fold_ascii(after), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct (name, allowed); null where none does."""
    found = F.lit(None).cast("struct<name: string, allowed: boolean>")
    # The last condition to be added is the first to be asked.
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.allowed).alias("allowed"))).otherwise(found)
    return found


def _shapes(path: Column) -> Column:
    """The segments of a path with their runs of digits made variable; an empty path has none."""
    shape = F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "<n>")
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(shape, "/", -1))


def _share(blocked, labels, prior, strength: float):
    return (blocked + strength * prior) / (labels + strength)


#: What is known of a path on its way down: where it stands, that node's share and its number of different paths.
STATE = "host path shapes n blocked labels template node share alive".split()


def _level(walked: DataFrame, depth: int, s: Settings) -> DataFrame:
    """One step down for all rows: their child's segment or the wildcard joins the template."""
    own, after = F.get("shapes", F.lit(depth)), F.get("shapes", F.lit(depth + 1))
    rows = walked.withColumns({"own": own, "after": F.coalesce(F.concat(F.lit("/"), after), F.lit(""))})
    rows = rows.withColumn("paths", F.lit(1))
    sums = [F.sum(c).alias(c) for c in ("n", "blocked", "labels", "paths")]
    spread = stored(rows.groupBy("host", "node", "own", "after").agg(*sums), "children")
    children = spread.groupBy("host", "node", "own").agg(*sums)
    nodes = children.groupBy("host", "node").agg(
        F.count("*").alias("all_children"), *[F.sum(c).alias("all_" + c) for c in ("n", "blocked", "labels")]
    )
    follow = spread.groupBy("host", "node", "after").agg(F.sum("n").alias("follow_n"))
    # Half the sum of |p - q| is 1 minus the sum of the lesser of both.
    alike = (
        spread.join(follow, ["host", "node", "after"])
        .join(nodes.select("host", "node", "all_n"), ["host", "node"])
        .join(children.select("host", "node", "own", F.col("n").alias("own_n")), ["host", "node", "own"])
        .groupBy("host", "node", "own")
        .agg((1 - F.sum(F.least(F.col("n") / F.col("own_n"), F.col("follow_n") / F.col("all_n")))).alias("apart"))
    )
    expected = F.col("all_blocked") / F.greatest(F.col("all_labels"), F.lit(1))
    error = F.sqrt(F.col("labels") * expected * (1 - expected) + 1)
    variable = (F.col("n") < s.few) & (F.col("all_children") >= s.many)
    like = (F.abs(F.col("blocked") - F.col("labels") * expected) <= s.errors * error) & (F.col("apart") <= s.distance)
    judged = (
        children.join(nodes, ["host", "node"])
        .join(alike, ["host", "node", "own"])
        .withColumn("joins", variable | (like & (F.col("all_children") > 1)))
    )
    # A lone like child has nothing to merge with.
    partners = judged.filter("joins").groupBy("host", "node").agg(F.count("*").alias("partners"))
    judged = judged.join(partners, ["host", "node"], "left").withColumn(
        "segment", F.when(F.col("joins") & (F.col("partners") > 1), F.lit("*")).otherwise(F.col("own"))
    )
    judged = stored(judged.select("host", "node", "own", "segment", "blocked", "labels", "paths"), "judged")
    branches = judged.groupBy("host", "node", "segment").agg(
        *[F.sum(c).alias("branch_" + c) for c in ("blocked", "labels", "paths")]
    )
    steps = judged.select("host", "node", "own", "segment").join(branches, ["host", "node", "segment"])
    step = {
        "template": F.concat("template", F.lit("/"), "segment"),
        "node": F.xxhash64("node", "segment"),
        "share": _share(F.col("branch_blocked"), F.col("branch_labels"), F.col("share"), s.strength),
        "alive": F.col("branch_paths"),
    }
    down = rows.join(steps, ["host", "node", "own"]).withColumns(step).select(*STATE)
    return stored(down, f"level-{depth + 1}")


def templates(paths: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``host, path, template, share`` of different rows ``host, path, n, blocked, labels`` (rows and labels of each)."""
    s = settings
    total = paths.agg(F.sum("blocked") / F.greatest(F.sum("labels"), F.lit(1))).first()[0] or 0.0  # one number
    hosts = paths.groupBy("host").agg(
        F.sum("blocked").alias("host_blocked"), F.sum("labels").alias("host_labels"), F.count("*").alias("alive")
    )
    hosts = hosts.select(
        "host", "alive", _share(F.col("host_blocked"), F.col("host_labels"), F.lit(total), s.strength).alias("share")
    )
    start = {"shapes": _shapes(F.col("path")), "template": F.lit(""), "node": F.lit(0).cast("long")}
    walked = paths.join(hosts, "host").withColumns(start).select(*STATE)
    walked, depth, done = stored(walked, "level-0"), 0, []
    while True:
        goes_on = (F.size("shapes") > depth) & (F.col("alive") >= s.many)
        rest = F.concat_ws("/", F.col("template"), F.slice("shapes", depth + 1, F.greatest(F.size("shapes") - depth, F.lit(0))))
        ends = walked.filter(~goes_on).withColumn("walked", F.size("shapes") <= depth)
        done.append(ends.select("host", "path", rest.alias("template"), "share", "blocked", "labels", "walked"))
        walked = walked.filter(goes_on)
        if walked.isEmpty():
            break
        walked, depth = _level(walked, depth, s), depth + 1
    ended = done[0]
    for more in done[1:]:
        ended = ended.union(more)
    # The ends of branches that were not walked have labels of their own.
    leaves = ended.groupBy("host", "template").agg(
        *[F.sum(c).alias(c) for c in ("blocked", "labels")], F.max("share").alias("above"), F.max("walked").alias("walked")
    )
    share = _share(F.col("blocked"), F.col("labels"), F.col("above"), s.strength)
    leaves = leaves.select("host", "template", F.when(F.col("walked"), F.col("above")).otherwise(share).alias("share"))
    return ended.select("host", "path", "template").join(leaves, ["host", "template"])


def judged(pages: DataFrame, rules: list[Rule], id: str = "page_id", url: str = "url", settings: Settings = Settings()) -> DataFrame:
    """``id, host, path, rule, verdict`` of each row of ``pages``; template and share beside them where no rule fits."""
    address = column(url).cast("string")
    rows = pages.select(column(id).alias("id"), host_of(address).alias("host"), path_of(address).alias("path"))
    rows = rows.withColumn("fits", rule_of(rules, F.col("host"), F.col("path")))
    labelled, blocked = F.col("fits").isNotNull().cast("long"), (~F.col("fits.allowed")).cast("long")
    blocked = F.coalesce(F.sum(blocked), F.lit(0).cast("long"))
    paths = rows.groupBy("host", "path").agg(
        F.count("*").alias("n"), blocked.alias("blocked"), F.sum(labelled).alias("labels")
    )
    # Rules depend on host and path alone, so paths with labels need no verdict.
    paths = stored(paths, "paths")
    found = templates(paths, settings).join(paths.filter("labels = 0").select("host", "path"), ["host", "path"])
    none = {"template": F.lit(None).cast("string"), "share": F.lit(None).cast("double")}
    own = rows.filter("fits IS NOT NULL").withColumns(none)
    other = rows.filter("fits IS NULL").join(found, ["host", "path"]).select(*own.columns)
    verdict = F.when(F.coalesce("fits.allowed", F.col("share") <= settings.rejected), "allow").otherwise("block")
    return own.union(other).select(
        F.col("id").alias(id), "host", "path", F.col("fits.name").alias("rule"), verdict.alias("verdict"), "template", "share"
    )
