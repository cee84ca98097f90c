"""Registrable domains by a table of public suffixes: the longest rule that a host ends in, by an equi-join on its suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that are sent along at most; a larger table is shuffled by suffix.
MOST_SENT = 100_000


def suffix_rules(lines: DataFrame, column: str = "rule") -> DataFrame:
    """(suffix, kind) of rules as the public list writes them: a name, ``*.`` before one, ``!`` before an exception; comments, blanks and repetitions go."""
    text = F.lower(F.regexp_extract(F.col(f"`{column}`"), r"^\s*([^\s/][^\s]*)", 1))
    kind = F.when(F.startswith(text, F.lit("!")), "exception").when(F.startswith(text, F.lit("*.")), "wildcard").otherwise("name")
    return lines.select(F.regexp_replace(text, r"^(?:!|\*\.)", "").alias("suffix"), kind.alias("kind")).where("suffix <> ''").distinct()


def registrable(hosts: DataFrame, rules: DataFrame, column: str = "host") -> DataFrame:
    """(host, suffix, domain) of each different host: its public suffix, and the name one label longer ("" if there is none).

    An exception wins, then the rule of most labels; without any, the last label is the suffix. Addresses, and null or empty hosts have neither.
    """
    own = hosts.select(F.lower(F.rtrim(F.col(f"`{column}`"), F.lit("."))).alias("host")).distinct()
    labels = F.split("host", r"\.")
    n = F.size(labels)
    tail = lambda k: F.array_join(F.slice(labels, n - k + 1, k), ".")
    each = own.where((F.col("host") != "") & ~F.col("host").rlike(r"^[0-9.]+$|:")).select("host", F.explode(F.sequence(F.lit(1), n)).alias("k")).withColumn("suffix", tail(F.col("k")))
    few = rules.limit(MOST_SENT + 1).count() <= MOST_SENT
    hit = each.join(F.broadcast(rules) if few else rules, "suffix", "left")
    # labels of the suffix that a rule makes; a wildcard needs one label more, and the last label alone is always a rule
    size = F.when(F.col("kind") == "name", F.col("k")).when((F.col("kind") == "wildcard") & (F.col("k") < n), F.col("k") + 1).when(F.col("kind") == "exception", F.col("k") - 1).when(F.col("k") == 1, 1)
    best = hit.groupBy("host").agg(F.max(F.when(F.col("kind") == "exception", size)).alias("x"), F.max(size).alias("m")).select("host", F.coalesce("x", "m").alias("k"))
    found = best.select("host", tail(F.col("k")).alias("suffix"), F.when(n > F.col("k"), tail(F.col("k") + 1)).otherwise("").alias("domain"))
    none = own.join(found, "host", "left_anti").select("host", F.lit("").alias("suffix"), F.lit("").alias("domain"))
    return found.unionByName(none)


def with_domain(rows: DataFrame, rules: DataFrame, host: Column, name: str = "domain") -> DataFrame:
    """Rows with the registrable domain of a host of theirs; hosts are looked up once each."""
    at = rows.withColumn("_host", F.lower(F.rtrim(host, F.lit("."))))
    found = registrable(at.select("_host"), rules, "_host").select(F.col("host").alias("_host"), F.col("domain").alias(name))
    return at.join(found, "_host", "left").drop("_host")
