"""URL filters by a path-template tree (operator 1). DataFrame functions only.

Each url is split into host and path, the path into segments. Level by level, a segment stays a branch of its own if it
isn't an identifier (digits, long hexadecimal), at least ``MIN_URLS`` urls have it, and these are at least one in
``MOST_BRANCHES`` of its parent's; all others are ``*``. So a node has a bounded number of branches at any size of the input.

Bottom-up, at every level, sibling branches are merged whose smoothed labelled block rates don't differ significantly (a
two-proportion z test between neighbours in the order of the rate); a merged group shares its labels. The purity of a
template is smoothed down the tree: the rate of the domain (the host's last label), then the host's, then that of its
group at each level, each with ``PRIOR_WEIGHT`` pseudo-urls of the purity above it. A template is rejected if its purity
reaches ``REJECT`` and its domain has labels at all: without any labelled evidence above it, nothing is rejected. Urls under
an explicit rule are the labelled ones, and keep the rule's verdict.

Everything that is counted is counted by partial aggregation over (host, template), so a host with a third of all rows
costs no task more than the number of its distinct templates. What goes back to the urls, branches and verdicts, is
broadcast if it is small, else joined.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the verdict of the
template of the empty host, which has no labels: allow. A null page_id and repeated rows stay as they are; only ``page_id``
and ``url`` are read. An empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.llm.common import if_small, table, written

DEPTH = 5  # levels of the tree; what lies deeper is one wildcard
MIN_URLS = 3
MOST_BRANCHES = 64
IDENTIFIER = r"^([0-9]+|[0-9a-fA-F-]*[0-9][0-9a-fA-F-]*)(\.[A-Za-z0-9]+)?$"
PRIOR_WEIGHT = 4.0  # pseudo-urls with the purity above
Z = 1.96
REJECT = 0.5
DEEPER = "**"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    block: bool

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", False),
    Rule("example.org", "/es/", True),
    Rule("example.org", "/en/1", True),
    Rule("com", "/fr/", False),
    Rule("com", "/de/", True),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url."""
    whole = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(whole, _URL, 1), _UPPER, _LOWER), F.regexp_extract(whole, _URL, 2)


def longest_rule(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict (true: block) of the longest rule that fits; null if none does."""
    text, block = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # later ones, that is longer ones, go before
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        text, block = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.block)).otherwise(block)
    return text, block


def segment(level: int) -> Column:
    """Segment of the path at ``level`` (from 1), empty where the path has none; at the last level, all that is left."""
    found = F.split(F.regexp_replace("path", "^/", ""), "/", -1)
    if level < DEPTH:
        return F.coalesce(F.get(found, F.lit(level - 1)), F.lit(""))
    return F.when(F.size(found) < level, F.lit("")).when(F.size(found) > level, F.lit(DEEPER)).otherwise(F.coalesce(F.get(found, F.lit(level - 1)), F.lit("")))


def generalised(urls: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with a column ``template``: the path with variable segments as wildcards."""
    rows = urls.withColumn("template", F.lit(""))
    for level in range(1, DEPTH + 1):
        rows = rows.withColumn("segment", segment(level))
        # Counted by partial aggregations, never by gathering a host's urls.
        total = rows.groupBy("host", "template").agg(F.count("*").alias("total"))
        named = rows.filter((F.col("segment") != "") & (F.col("segment") != DEEPER) & ~F.col("segment").rlike(IDENTIFIER))
        counts = named.groupBy("host", "template", "segment").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_URLS)
        branches = written(counts.join(total, ["host", "template"]).filter(F.col("n") * MOST_BRANCHES >= F.col("total")).toDF("b_host", "b_template", "b_segment", "b_n", "b_total"))
        stays = F.col("b_host").isNotNull() | F.col("segment").isin("", DEEPER)
        rows = (
            rows.join(if_small(branches), (rows.host == branches.b_host) & (rows.template == branches.b_template) & (rows.segment == branches.b_segment), "left")
            .withColumn("template", F.concat("template", F.lit("/"), F.when(stays, F.col("segment")).otherwise(F.lit("*"))))
            .drop("segment", *branches.columns)
        )
    return rows


_COUNTS = ("n_labelled", "n_blocked")


def _summed(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _smoothed(above: Column, labelled: str = "n_labelled", blocked: str = "n_blocked") -> Column:
    return (F.col(blocked) + PRIOR_WEIGHT * above) / (F.col(labelled) + PRIOR_WEIGHT)


def merged(nodes: DataFrame) -> DataFrame:
    """``nodes`` (host, node, counts, host_purity) with ``branch``, the number of the group of similar siblings, and the
    group's counts as ``g_labelled`` and ``g_blocked``."""
    rated = nodes.withColumn("parent", F.regexp_replace("node", "/[^/]*$", "")).withColumn("weight", F.col("n_labelled") + PRIOR_WEIGHT).withColumn("rate", _smoothed(F.col("host_purity")))
    # A parent has MOST_BRANCHES branches and a few more at most, so these windows are small.
    siblings = Window.partitionBy("host", "parent").orderBy("rate", "node")
    pairs = rated.withColumn("before_rate", F.lag("rate").over(siblings)).withColumn("before_weight", F.lag("weight").over(siblings))
    pooled = (F.col("rate") * F.col("weight") + F.col("before_rate") * F.col("before_weight")) / (F.col("weight") + F.col("before_weight"))
    error2 = pooled * (1 - pooled) * (1 / F.col("weight") + 1 / F.col("before_weight"))
    differs = F.col("before_rate").isNotNull() & (F.pow(F.col("rate") - F.col("before_rate"), F.lit(2.0)) > Z * Z * error2)
    grouped = pairs.withColumn("differs", differs.cast("int")).withColumn("branch", F.sum("differs").over(siblings.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("host", "parent", "branch")
    return grouped.withColumn("g_labelled", F.sum("n_labelled").over(group)).withColumn("g_blocked", F.sum("n_blocked").over(group))


def domain(host: Column) -> Column:
    """The last label of a host, its port aside."""
    return F.regexp_extract(host, "([^.:]*)(:[0-9]*)?$", 1)


def template_verdicts(urls: DataFrame) -> DataFrame:
    """For each (host, template): purity and verdict.

    ``urls`` has host, template and ``label`` (true: block, false: allow, null: not labelled).
    """
    leaves = written(urls.groupBy("host", "template").agg(F.count("label").alias("n_labelled"), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)).alias("n_blocked")))
    hosts = _summed(leaves, "host").withColumn("domain", domain(F.col("host")))
    overall = hosts.agg((F.coalesce(F.sum("n_blocked"), F.lit(0)) / F.greatest(F.coalesce(F.sum("n_labelled"), F.lit(0)), F.lit(1))).alias("prior"))  # one row
    domains = written(_summed(hosts, "domain").join(F.broadcast(overall)).select("domain", _smoothed(F.col("prior")).alias("domain_purity"), (F.col("n_labelled") > 0).alias("evidence")))
    hosts = written(hosts.join(if_small(domains), "domain").select("host", _smoothed(F.col("domain_purity")).alias("host_purity"), "evidence"))
    out = leaves.select("host", "template").join(hosts, "host").withColumn("purity", F.col("host_purity"))
    for level in range(1, DEPTH + 1):
        node = F.regexp_extract("template", f"^((/[^/]*){{{level}}})", 1)
        nodes = merged(_summed(leaves, "host", node.alias("node")).join(hosts, "host")).select(F.col("host").alias("m_host"), "node", "g_labelled", "g_blocked")
        out = out.withColumn("at", node).join(nodes, (F.col("host") == F.col("m_host")) & (F.col("at") == F.col("node")))
        out = out.withColumn("purity", _smoothed(F.col("purity"), "g_labelled", "g_blocked")).drop("at", "m_host", "node", "g_labelled", "g_blocked")
    return written(out.select("host", "template", "purity", (F.col("evidence") & (F.col("purity") >= REJECT)).alias("reject")))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, template, verdict for each row of ``pages`` (page_id, url)."""
    host, path = parts(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, block = longest_rule(rules)
    rows = generalised(rows.withColumn("rule", rule).withColumn("label", block))
    verdicts = template_verdicts(rows).select(F.col("host").alias("v_host"), F.col("template").alias("v_template"), "reject")
    return rows.join(if_small(verdicts), (rows.host == verdicts.v_host) & (rows.template == verdicts.v_template), "left").select(
        "page_id", "host", "path", "rule", F.when(F.coalesce("label", "reject"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"), "template"
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    cases = sorted(RULES, key=lambda r: -len(r.text))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in cases)
    label = " ".join(f"WHEN {fits(r)} THEN {str(r.block).lower()}" for r in cases)
    sql = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(url, '{_URL}', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(url, '{_URL}', 2) AS path FROM u),
t0 AS (SELECT *, string_split(regexp_replace(path, '^/', ''), '/') AS seg, CASE {rule} END AS rule, CASE {label} END AS label, '' AS template FROM hp)"""
    smooth = lambda above, n="n_labelled", b="n_blocked": f"(({b} + {PRIOR_WEIGHT} * {above}) / ({n} + {PRIOR_WEIGHT}))"
    for k in range(1, DEPTH + 1):
        at = f"coalesce(seg[{k}], '')" if k < DEPTH else f"CASE WHEN len(seg) > {k} THEN '{DEEPER}' ELSE coalesce(seg[{k}], '') END"
        sql += f""",
s{k} AS (SELECT *, {at} AS segment FROM t{k - 1}),
w{k} AS (SELECT host, template, segment FROM (SELECT host, template, segment, count(*) AS n, sum(count(*)) OVER (PARTITION BY host, template) AS total FROM s{k} GROUP BY host, template, segment)
  WHERE segment NOT IN ('', '{DEEPER}') AND NOT regexp_matches(segment, '{IDENTIFIER}') AND n >= {MIN_URLS} AND n * {MOST_BRANCHES} >= total),
t{k} AS (SELECT s{k}.* EXCLUDE (template, segment), s{k}.template || '/' || CASE WHEN w{k}.host IS NOT NULL OR s{k}.segment IN ('', '{DEEPER}') THEN s{k}.segment ELSE '*' END AS template
  FROM s{k} LEFT JOIN w{k} ON s{k}.host = w{k}.host AND s{k}.template = w{k}.template AND s{k}.segment = w{k}.segment)"""
    sql += f""",
l AS (SELECT host, template, count(label) AS n_labelled, coalesce(sum(label::INT), 0) AS n_blocked FROM t{DEPTH} GROUP BY host, template),
h0 AS (SELECT host, regexp_extract(host, '([^.:]*)(:[0-9]*)?$', 1) AS domain, sum(n_labelled) AS n_labelled, sum(n_blocked) AS n_blocked FROM l GROUP BY host),
o AS (SELECT coalesce(sum(n_blocked), 0)::DOUBLE / greatest(coalesce(sum(n_labelled), 0), 1) AS prior FROM h0),
dm AS (SELECT domain, {smooth('prior')} AS domain_purity, n_labelled > 0 AS evidence FROM (SELECT domain, sum(n_labelled) AS n_labelled, sum(n_blocked) AS n_blocked FROM h0 GROUP BY domain), o),
h AS (SELECT host, {smooth('domain_purity')} AS host_purity, evidence FROM h0 JOIN dm USING (domain)),
p0 AS (SELECT l.host, template, evidence, host_purity AS purity FROM l JOIN h USING (host))"""
    for k in range(1, DEPTH + 1):
        sql += f""",
n{k} AS (SELECT host, node, regexp_replace(node, '/[^/]*$', '') AS parent, n_labelled, n_blocked, n_labelled + {PRIOR_WEIGHT} AS weight, {smooth('host_purity')} AS rate
  FROM (SELECT host, regexp_extract(template, '^((/[^/]*){{{k}}})', 1) AS node, sum(n_labelled) AS n_labelled, sum(n_blocked) AS n_blocked FROM l GROUP BY 1, 2) JOIN h USING (host)),
b{k} AS (SELECT *, lag(rate) OVER w AS before_rate, lag(weight) OVER w AS before_weight, (rate * weight + lag(rate) OVER w * lag(weight) OVER w) / (weight + lag(weight) OVER w) AS pooled FROM n{k} WINDOW w AS (PARTITION BY host, parent ORDER BY rate, node)),
d{k} AS (SELECT *, coalesce(pow(rate - before_rate, 2) > {Z * Z!r}::DOUBLE * (pooled * (1 - pooled) * (1 / weight + 1 / before_weight)), false)::INT AS differs FROM b{k}),
g{k} AS (SELECT *, sum(differs) OVER (PARTITION BY host, parent ORDER BY rate, node ROWS UNBOUNDED PRECEDING) AS branch FROM d{k}),
m{k} AS (SELECT host, node, sum(n_labelled) OVER m AS g_labelled, sum(n_blocked) OVER m AS g_blocked FROM g{k} WINDOW m AS (PARTITION BY host, parent, branch)),
p{k} AS (SELECT p.host, template, evidence, {smooth('purity', 'g_labelled', 'g_blocked')} AS purity FROM p{k - 1} p JOIN m{k} m ON p.host = m.host AND regexp_extract(template, '^((/[^/]*){{{k}}})', 1) = m.node)"""
    return sql + f"""
SELECT page_id, t.host, path, rule, CASE WHEN coalesce(label, evidence AND purity >= {REJECT}) THEN 'block' ELSE 'allow' END AS verdict, t.template
FROM t{DEPTH} t LEFT JOIN p{DEPTH} v ON t.host = v.host AND t.template = v.template"""


SQL = _sql()
