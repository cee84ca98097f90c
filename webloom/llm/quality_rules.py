"""Quality rules: a table of thresholds compiled into one Spark projection.

Every figure is a built-in expression over the text, so the whole rule set is
one narrow projection without user functions and without a shuffle.

Defined results: a null text has no words and fails the base; ties do not
occur; repeated rows get the same verdict; an empty table gives an empty one;
other columns are ignored. Very long texts are judged whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.tables import documents, narrow

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: Bytes a character from which on a text is in another script than Latin.
OTHER_SCRIPT = 1.5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = """
the of and to in a is that it for on was be with as by this at from are or an
der die das und ist in den von zu mit sich auf für nicht ein eine als auch dem
le la les de des et est un une que en du dans pour qui sur au pas par
el los las y que en un una por con no se del su al es lo
""".split()


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie within the bounds; either may be missing. Texts below ``from_words`` words are not held to it."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


RULES = (
    Rule("length", "n_words", least=20),
    Rule("word_length", "mean_word_length", least=2.0, most=15.0),
    Rule("symbols", "symbols_per_word", most=0.25),
    Rule("stop_words", "stop_word_ratio", least=0.02, from_words=50),
    Rule("repeated_lines", "dup_line_ratio", most=0.5),
    Rule("repeated_words", "repeat_word_ratio", most=0.3),
    Rule("word_variety", "distinct_per_root", least=1.0, from_words=20),
    Rule("runs", "same_as_next_ratio", most=0.3),
)


def _prepared(docs: DataFrame, text_column: str) -> DataFrame:
    """Arrays that several figures use. Each is a column, so that no lambda computes it again."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    df = docs.withColumn("_text", text)
    df = df.withColumn("_words", F.filter(F.split("_text", SPACES), lambda w: w != ""))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_words")
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)]))
    df = df.withColumn("_windows", F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn("_ordered", F.when(some, ordered))
    found = F.transform("_ordered", lambda s, j: F.when((s.x == F.get("_ordered", j - 1).x) | (s.x == F.get("_ordered", j + 1).x), s.i))
    df = df.withColumn("_found", F.array_sort(F.array_compact(found)))
    return df


def _repeated(found: str) -> Column:
    """Words covered by windows that start at the ascending positions found."""
    reach = F.transform(found, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(found, j + 1) - p, F.lit(WINDOW))))
    return F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")


def measures() -> dict[str, Column]:
    """Every figure a rule may name, in terms of the prepared columns."""
    n = F.size("_words").cast("long")
    per = lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    n_lines = F.size("_lines").cast("long")
    dup_lines = n_lines - F.size(F.array_distinct("_lines")).cast("long")
    return {
        "n_words": n,
        "word_chars": F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": dup_lines,
        "n_repeat_words": _repeated("_found"),
        "mean_word_length": per(F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("double")),
        "symbols_per_word": per((F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("double")),
        # the listed languages are in Latin script, of little more than a byte a letter; others are not held to their words
        "stop_word_ratio": F.when(F.octet_length("_text") > OTHER_SCRIPT * F.length("_text"), 1.0).otherwise(per(F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("double"))),
        "dup_line_ratio": F.when(n_lines > 0, dup_lines / n_lines).otherwise(F.lit(0.0)),
        "repeat_word_ratio": per(_repeated("_found").cast("double")),
        # different words grow with about the root of a text's length, so that no natural text is too long for it
        "distinct_per_root": F.when(n > 0, F.size(F.array_distinct("_hashes")) / F.sqrt(n.cast("double"))).otherwise(F.lit(0.0)),
        "same_as_next_ratio": per(F.size(F.filter(F.transform("_hashes", lambda h, i: h == F.get("_hashes", i + 1)), lambda x: x)).cast("double")),
    }


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Judge each row: id, base figures, base_failed, kept, failed (names of the rules it fails)."""
    have = measures()
    need = list(dict.fromkeys([*BASE, *(r.metric for r in rules)]))
    df = _prepared(narrow(docs, id_column, text_column), text_column)
    # always true, but not foldable: a filter on a verdict must not be pushed below the figures,
    # where it would hold them several times over, within lambdas at that
    once = F.monotonically_increasing_id() >= 0
    df = df.select(F.col(f"`{id_column}`"), F.when(once, F.struct(*[have[m].alias(m) for m in need])).alias("_m"))
    failing = []
    for r in rules:
        x = F.col(f"_m.{r.metric}")
        bad = F.lit(False)
        bad = bad | (x < r.least) if r.least is not None else bad
        bad = bad | (x > r.most) if r.most is not None else bad
        failing.append(F.when(bad & (F.col("_m.n_words") >= r.from_words), F.lit(r.name)))
    base_failed = (F.col("_m.n_words") < MIN_WORDS) | (100 * F.col("_m.n_repeat_words") > MAX_REPEATED_PERCENT * F.col("_m.n_words"))
    df = df.withColumn("failed", F.array_compact(F.array(*failing)) if failing else F.array().cast("array<string>"))
    return df.select(
        f"`{id_column}`",
        *[F.col(f"_m.{m}").alias(m) for m in BASE],
        base_failed.alias("base_failed"),
        (~base_failed & (F.size("failed") == 0)).alias("kept"),
        F.array_join("failed", ",").alias("failed"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))
