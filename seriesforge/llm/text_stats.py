"""Per-document statistics as Spark columns, all over the whole text (native, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, let, shingles, text_or_empty, words

SYMBOLS = "[#*$%&|<>]"


def repeated_words(w: Column, n: int = 3) -> Column:
    """Words that lie in an n-word window found twice or more in the text, the first included."""
    def covered(h: Column) -> Column:
        def by_sorting(s: Column) -> Column:
            twice = F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]))
            return let(F.sort_array(F.transform(twice, lambda e: e["i"])), lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n)))), F.lit(0), lambda a, x: a + x))

        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ranked, by_sorting))

    return let(shingles(w, n, F.xxhash64), covered)


def removed(text: Column, pattern: str) -> Column:
    """Code points that the pattern matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def beside(docs: DataFrame, text_col: str, parts: dict[str, Column], made: dict[str, Column]) -> DataFrame:
    """docs + the columns `made`, whose expressions may use `parts`, columns of their own; columns of docs named like a made one
    give way, all others stay whatever their names."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))
    rows = rows.withColumns(parts).withColumns({f"made_{k}": v for k, v in made.items()})
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in made], *[F.col(f"made_{k}").alias(k) for k in made])


def full_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs + BASE (long)."""
    text = text_or_empty(F.col("text"))
    return beside(docs, text_col, {"w": words(F.col("text")), "lines": full_lines(text)}, {
        "n_words": F.size("w").cast("long"),
        "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "n_symbols": removed(text, SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("w")).cast("long"),
    })
