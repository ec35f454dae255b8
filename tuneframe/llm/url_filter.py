"""URL filters: rules found by hash prefixes of host-suffix and path-prefix expressions.

A rule is a host and the start of a path; it fits its host and every
subdomain. A URL that a rule fits holds the rule's text as one of its own
expressions, a suffix of its host joined to a prefix of its path. So each
URL is expanded into the expressions that have the lengths of some rule,
expressions and rules meet in an equi-join on the first four bytes of their
SHA-256, the full digests confirm the meeting, and the longest rule wins.

Only lengths, digests and verdicts of rules move; a rule's text is read off
the URL. The list of distinct lengths is all that reaches the driver: n
different lengths take at least n * n / 2 characters of rules, so the list
grows with the square root of the rules at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneframe.llm.common import ascii_lower

#: Rules of which the join may send a copy to every executor: about 80 bytes each.
BROADCAST_RULES = 200_000
SALTS = 16


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _digest(text: str) -> str:
    return f"unhex(sha2(encode({text}, 'UTF-8'), 256))"


def prepared_rules(rules: DataFrame) -> DataFrame:
    """``prefix, digest, host_length, path_length, blocks`` of each rule once."""
    clean = rules.select(ascii_lower(F.col("host")).alias("host"), F.col("path"), F.col("verdict"))
    clean = clean.filter("host <> '' AND path IS NOT NULL AND verdict IN ('allow', 'block')")
    once = clean.groupBy("host", "path").agg(F.max((F.col("verdict") == "block").cast("int")).alias("blocks"))
    once = once.select(F.expr(_digest("concat(host, path)")).alias("digest"),
                       F.char_length("host").alias("host_length"), F.char_length("path").alias("path_length"), "blocks")
    return once.select(F.substring("digest", 1, 4).alias("prefix"), "*")


def expressions(urls: DataFrame, host_lengths: list[int], path_lengths: list[int]) -> DataFrame:
    """One row per expression of ``urls(url)`` that has the lengths of some rule.

    A host suffix starts at a label; a path prefix may end anywhere.
    """
    def lengths(values: list[int]) -> str:
        return f"array({', '.join(map(str, sorted(values)))})" if values else "cast(array() AS array<int>)"

    at = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    at = at.select("*", F.char_length("host").alias("hn"), F.char_length("path").alias("pn"))
    hosts = f"filter({lengths(host_lengths)}, h -> h = hn OR (h < hn AND substr(host, hn - h, 1) = '.'))"
    paths = f"filter({lengths(path_lengths)}, p -> p <= pn)"
    made = f"named_struct('h', h, 'p', p, 'digest', {_digest('concat(right(host, h), left(path, p))')})"
    all_of = f"flatten(transform({hosts}, h -> transform({paths}, p -> {made})))"
    out = at.select("url", F.explode(F.expr(all_of)).alias("e"))
    return out.select("url", F.substring("e.digest", 1, 4).alias("prefix"), "e.digest",
                      F.col("e.h").alias("host_length"), F.col("e.p").alias("path_length"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
          broadcast_rules: int = BROADCAST_RULES, salts: int = SALTS) -> DataFrame:
    """``id, url, host, path, rule, verdict`` of every row of ``pages``.

    ``rules(host, path, verdict)``: a rule fits a URL whose host is the
    rule's or a subdomain of it and whose path starts with the rule's. Of
    several rules the longest text wins, then the one with the longer host;
    a rule stated with both verdicts blocks. Without a rule the verdict is
    ``default`` and the rule null.

    A null URL or one without ``://`` has an empty host and path; no rule
    fits an empty host. Rules without a host, with a null path or with
    another verdict than allow or block take no part; a rule whose path
    neither is empty nor starts with ``/`` fits nothing. Rows that repeat
    are judged as rows of their own, null ids stay, an empty table gives no
    rows, and no rules give the default. Other columns are not read.

    Rules up to ``broadcast_rules`` are sent to every executor; more are
    joined by a shuffle whose hot expressions are dealt by ``salts``.
    """
    picked = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))
    known = prepared_rules(rules)
    sizes = known.agg(F.collect_set("host_length").alias("h"), F.collect_set("path_length").alias("p"),
                      F.count(F.lit(1)).alias("n")).first()
    found = expressions(picked.select("url"), sizes["h"], sizes["p"])
    key = ["prefix"]
    if sizes["n"] <= broadcast_rules:
        known = F.broadcast(known)
    else:
        key = ["prefix", "salt"]
        found = found.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(salts)).cast("int"))
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = found.alias("f").join(known.alias("k"), key)
    met = met.filter("f.digest = k.digest AND f.host_length = k.host_length AND f.path_length = k.path_length")
    # Length, host length and verdict in one number: its maximum is the winner, combined before the shuffle.
    weight = F.expr("((f.host_length + f.path_length) * 1073741824L + f.host_length) * 2 + k.blocks")
    best = met.select("f.url", weight.alias("weight")).groupBy("url").agg(F.max("weight").alias("weight"))
    out = picked.join(best, "url", "left")
    out = out.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "weight",
                     F.expr("cast(weight div 2 % 1073741824 AS int)").alias("hl"),
                     F.expr("cast(weight div 2147483648 AS int)").alias("total"))
    rule = F.expr("CASE WHEN weight IS NOT NULL THEN concat(right(host, hl), left(path, total - hl)) END")
    verdict = F.expr("CASE WHEN weight % 2 = 1 THEN 'block' WHEN weight % 2 = 0 THEN 'allow' END")
    return out.select("id", "url", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict"))
