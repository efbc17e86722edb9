"""URL rules by host suffixes and path prefixes, met by short hash prefixes and confirmed by whole digests. DataFrame functions
only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: Hex digits of a digest that URLs and rules meet by: four bytes.
PREFIX = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case. Path: from there up to `?`, `#` or the end.
    Both are empty for null and where there is no `://`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(rules: DataFrame) -> DataFrame:
    """(rule, digest, prefix, host_length, verdict) of rules (host, path, verdict), one row per host and path: `block` wins over
    `allow`. Left out is what can fit no URL: no host, a host that holds `/`, `?` or `#`, a path that does not start with `/` or holds `?` or
    `#`, another verdict. A null path is an empty one and fits every path."""
    host = F.translate(F.col("host").cast("string"), _UPPER, _LOWER)
    path = F.coalesce(F.col("path").cast("string"), F.lit(""))
    sound = (host != "") & ~host.rlike("[/?#]") & path.rlike(r"^(/[^?#]*)?\z") & F.col("verdict").isin(ALLOW, BLOCK)
    kept = rules.where(sound).groupBy(host.alias("rule_host"), path.alias("rule_path")).agg(F.max("verdict").alias("verdict"))
    digest = F.sha2("rule", 256)
    return kept.withColumn("rule", F.concat("rule_host", "rule_path")).select(
        "rule", digest.alias("digest"), F.left(digest, F.lit(PREFIX)).alias("prefix"), F.length("rule_host").alias("host_length"),
        "rule_path", "verdict",
    )


def _shape(table: DataFrame):
    """How far URLs have to be expanded: most labels and most slashes of a rule, and the lengths of paths that do not end in a
    slash. One row; its array is no longer than the longest rule."""
    host = F.left("rule", F.col("host_length"))
    return table.agg(
        F.max(F.length(host) - F.length(F.replace(host, F.lit("."))) + 1).alias("labels"),
        F.max(F.length("rule_path") - F.length(F.replace("rule_path", F.lit("/")))).alias("slashes"),
        F.collect_set(F.when(~F.endswith("rule_path", F.lit("/")), F.length("rule_path"))).alias("lengths"),
    ).first()


def expressions(host: Column, path: Column, labels: int, slashes: int, lengths: list[int] = ()) -> Column:
    """The strings a rule can have that fits this host and path: each of the host's last 1 to `labels` labels and the whole host, if
    it has no more, with each prefix of the path that ends in one of its first `slashes` slashes or has one of `lengths` characters."""
    suffix = lambda k: F.call_function("substring_index", host, F.lit("."), -k)
    hosts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(labels)), suffix))
    start = lambda j: F.concat(F.call_function("substring_index", path, F.lit("/"), j), F.lit("/"))
    paths = F.transform(F.sequence(F.lit(1), F.lit(slashes)), start) if slashes else F.array().cast("array<string>")
    if lengths:
        cut = F.transform(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: F.when(F.length(path) >= n, F.left(path, n)))
        paths = F.concat(paths, cut)
    fitting = F.array_distinct(F.filter(paths, lambda p: F.startswith(path, p)))
    return F.flatten(F.transform(hosts, lambda h: F.transform(fitting, lambda p: F.concat(h, p))))


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of `pages`; rule is null and the verdict `default` where no rule fits.

    A rule (host, path, verdict) fits its host and all subdomains where the URL's path starts with the rule's. The rule with most
    characters wins, of equally long ones that with the longer host; `block` wins over `allow` for one host and path.

    Distinct (host, path) pairs are expanded, meet the rules by four bytes of SHA-256 and are confirmed by the whole digest; the
    best rule of each pair goes back to its pages. An expansion is bounded by the longest rules, however long a URL is. The join is an
    equi-join whose way Spark picks by the size of the rules; a hot host or a hot URL is one pair before it and is split by AQE
    in the last join.

    Nulls and texts without `://` have an empty host and path; no rule fits them. Repeated rows stay. Other columns are not read. An empty
    `rules` leaves every page at the default."""
    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    table = rule_table(rules)
    shape = _shape(table)
    if shape.labels is None:
        return parsed.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    asked = (
        parsed.where("host != ''").distinct()
        .withColumn("expression", F.explode(expressions(F.col("host"), F.col("path"), shape.labels, shape.slashes, shape.lengths)))
        .withColumn("asked", F.sha2("expression", 256)).drop("expression")
        .withColumn("prefix", F.left("asked", F.lit(PREFIX)))
    )
    best = F.struct(F.length("rule"), "host_length")
    found = (
        asked.join(table, "prefix").where("asked = digest")
        .groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), best).alias("best"))
    )
    return parsed.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
