"""URL filters: a blocked Bloom filter of listed keys before an exact hash join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: 64-bit words of the filter at most: half a megabyte, four keys a word up to a quarter of a million of them. Of longer lists more keys pass on to the exact join.
MAX_WORDS = 65536
#: Rules up to this many are joined by broadcast; more by shuffle.
BROADCAST_RULES = 100_000
RULE_KIND = "array<struct<verdict:string,rule_host:string,rule_path:string>>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: between the first :// and /, ?, # or the end, A-Z lower-cased; path: then up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) triples as a table: rule, rule_host, rule_path, verdict. There may be none."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows).cast(RULE_KIND))).withColumn("rule", F.concat("rule_host", "rule_path"))


def _mask(h: Column) -> Column:
    """Three bits of a block of 64."""
    one = F.lit(1).cast("long")
    bit = lambda k: F.call_function("shiftleft", one, F.shiftrightunsigned(h, 16 + 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))


def bloom_words(keys: DataFrame, column: str, n: int) -> list[int]:
    """Words of a blocked Bloom filter: at most MAX_WORDS of them reach the driver, whatever the list's size."""
    n_words = 8
    while n_words < min(MAX_WORDS, n // 4):
        n_words *= 2
    h = F.xxhash64(column)
    filled = keys.groupBy(F.pmod(h, F.lit(n_words)).alias("w")).agg(F.bit_or(_mask(h)).alias("m")).collect()
    words = [0] * n_words
    for r in filled:
        words[r["w"]] = r["m"]
    return words


def _may_hold(words: list[int], key: Column) -> Column:
    h = F.xxhash64(key)
    table = F.from_json(F.lit(str(words)), "array<bigint>")
    word = F.element_at(table, (F.pmod(h, F.lit(len(words))) + 1).cast("int"))
    return word.bitwiseAND(_mask(h)) == _mask(h)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule (host and path of the rule, else null), verdict.

    ``rules`` has verdict, rule_host, rule_path, rule: the listed canonical URLs. A rule fits
    its host and all subdomains, if the path starts with the rule's; the longest (host and
    path together, then host, then in order of verdicts, block first) wins. A URL with no listed key gets ``otherwise``. For each
    distinct (host, path), the keys a rule could have (suffixes of the host with as many
    labels and prefixes of the path of such lengths as rules have) pass the Bloom filter, and
    what it passes meets the rules in an exact hash join; so a hot host is one row a map task,
    and a very long host or path costs no more than the rules' own sizes. A (host, path) with a large share of the
    pages is joined apart. A null url, or one without ://, has an empty host and path and fits
    no rule. Repeated pages repeat; an empty table gives no rows, an empty list ``otherwise``;
    columns of pages that bear the result's names are replaced.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    known = rules.agg(F.count(F.lit(1)), F.collect_set(F.length("rule_path")), F.collect_set(F.size(F.split("rule_host", r"\.", -1)))).first()
    lengths, sizes = sorted(known[1]), sorted(known[2])
    words = bloom_words(rules, "rule", known[0])
    labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    suffixes = F.transform(F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"), lambda k: k <= labels), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("rule_host"), p.alias("rule_path")))))
    counted = written(parsed.groupBy("host", "path").agg(F.count(F.lit(1)).alias("rows")), "urls")
    possible = counted.where("host != ''").select("host", "path", "rows", F.inline(F.filter(keys, lambda k: _may_hold(words, F.concat(k.rule_host, k.rule_path)))))
    exact = F.broadcast(rules) if known[0] <= BROADCAST_RULES else rules
    found = possible.join(exact, ["rule_host", "rule_path"])
    order = F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("m"), "verdict", "rule")
    best = found.groupBy("host", "path", "rows").agg(F.max(order).alias("best"))
    best = best.select(F.col("host").alias("h"), F.col("path").alias("p"), "rows", "best.rule", "best.verdict")
    total = counted.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    out = hot_join(parsed, written(best, "verdicts"), [("host", "h"), ("path", "p")], "rows", total, "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
