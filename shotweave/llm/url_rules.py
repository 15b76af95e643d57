"""URL filter: a sort-merge range join of urls with host-and-path rules.

Hosts are reversed label by label (``a.example.net`` to ``net.example.a.``), so a rule's host and all its
subdomains form one interval of keys, and the intervals of nested hosts nest. Urls and rules are dealt to ranges of
this order and sorted; one sweep per range keeps the stack of hosts whose intervals are open. At a url, the
stack holds just the rules of its host and parent hosts; of these, rules whose path begins the url's path fit, and
the longest (host, then path) wins.

Range bounds come from a sample of the keys, a fixed number of them. A rule whose interval spans several ranges
goes to each (at most its nesting depth per bound beyond one copy of each rule). A key so frequent that several
bounds fall on it is split over all their ranges by row.

Defined results: null urls and urls without ``://`` have an empty host and path, and no rule fits an empty host;
rows that repeat a page or url are judged each; repeated rules count once (of the same host and path, "block" wins);
rules with a null host, path or verdict are ignored; further columns are ignored; an empty table gives an empty
result, an empty list of rules gives the default verdict.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_RANGE, MAX_RANGES, SAMPLE_PER_RANGE = 250_000, 4096, 50


def split_url(url: str | Column) -> tuple[Column, Column]:
    """(host, path) of a url column: the host ends at the first of ``/ ? #``, the path at the first of ``? #``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each ended by the lowest character: a parent host's key is a prefix of its subdomains'."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x01"), F.lit("\x01"))


def match_rules(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Verdicts for ``pages(page_id, url)`` under ``rules(host, path, verdict)``.

    Returns ``page_id, host, path, rule string`` (host and path of the winner, else null) and ``verdict``."""
    host, path = split_url(F.col("url").cast("string"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", F.concat(host_key(F.col("host")), "path"))
    rules = (rules.select(F.lower("host").alias("host"), "path", "verdict").dropna()
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    rules = rules.withColumn("key", host_key(F.col("host")))
    n = urls.count()
    ranges = max(1, min(MAX_RANGES, -(-n // ROWS_PER_RANGE), n))
    bounds: list[str] = []
    if n:
        ranges = max(ranges, min(n, int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        share = min(1.0, SAMPLE_PER_RANGE * ranges / n)
        keys = sorted(r[0] for r in urls.select("key").sample(share, seed=7).toLocalIterator())
        bounds = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []

    def range_of_url(it):
        for b in it:
            out = []
            for k, row in zip(b.column("key").to_pylist(), b.column("row").to_pylist(), strict=True):
                lo, hi = bisect_left(bounds, k), bisect_right(bounds, k)
                out.append(lo + row % (hi - lo + 1) if hi > lo else hi)
            yield b.append_column("part", pa.array(out, pa.int32()))

    def ranges_of_rule(it):
        for b in it:
            rows = b.to_pylist()
            out = [r | {"part": p} for r in rows
                   for p in range(bisect_left(bounds, r["key"]), bisect_left(bounds, r["key"][:-1] + "\x02") + 1)]
            yield pa.RecordBatch.from_pylist(out, schema=b.schema.append(pa.field("part", pa.int32())))

    row = F.pmod(F.xxhash64("page_id", "key"), F.lit(1 << 30))
    left = urls.select("key", "host", "path", F.lit(None).cast("string").alias("verdict"), "page_id", row.alias("row"),
                       F.lit(1).alias("kind"))
    right = rules.select("key", "host", "path", "verdict", F.lit(None).cast("long").alias("page_id"),
                         F.lit(0).cast("long").alias("row"), F.lit(0).alias("kind"))
    ddl = "key string, host string, path string, verdict string, page_id long, row long, kind int, part int"
    both = left.mapInArrow(range_of_url, ddl).unionByName(right.mapInArrow(ranges_of_rule, ddl))
    both = both.repartition(ranges, "part").sortWithinPartitions("part", "key", "kind")

    def sweep(it):
        stack: list[tuple[str, str, dict]] = []  # (key, host, rules by path) of open hosts
        part = None
        for b in it:
            col = {c: b.column(c).to_pylist() for c in ("key", "host", "path", "verdict", "page_id", "kind", "part")}
            rule, verdict, keep = [], [], []
            for i, key in enumerate(col["key"]):
                if col["part"][i] != part:
                    stack, part = [], col["part"][i]
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if col["kind"][i] == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, col["host"][i], {}))
                    stack[-1][2][col["path"][i]] = col["verdict"][i]
                    continue
                keep.append(i)
                found = None
                for _, host, paths in reversed(stack):
                    found = longest(paths, col["path"][i])
                    if found is not None:
                        found = (host + found, paths[found])
                        break
                rule.append(found[0] if found else None)
                verdict.append(found[1] if found else default)
            yield pa.RecordBatch.from_arrays(
                [pa.array([col[c][i] for i in keep], pa.int64() if c == "page_id" else pa.string())
                 for c in ("page_id", "host", "path")] + [pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"])

    return both.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")


def longest(paths: dict, path: str) -> str | None:
    """The longest of the rule paths that ``path`` begins with."""
    if len(paths) <= 8:
        return max((p for p in paths if path.startswith(p)), key=len, default=None)
    return next((path[:n] for n in range(len(path), -1, -1) if path[:n] in paths), None)
