"""Quality rules: a table of thresholds compiled into one projection.

General texts: the time series of this library have no prose, so the operator
takes any table with an id and a text column.  Every measure is a Spark
expression over the whole text; no Python runs on the executors, nothing is
shuffled, and a text is never split over rows.

Defined results: a NULL or empty text has no words and fails; repeated rows are
judged each for itself; other columns of the input are not read and may have any
name; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.words import WORD

#: Frequent function words, by language (fixed values).
STOP_WORDS = {
    "en": "the of and to in that it is was for as with his he be on by at which have from this had not are but or her an they".split(),
    "fr": "de la le et les des en un une du que est pour qui dans au sur pas par plus avec ce il se ne sont son aux ou".split(),
    "es": "de la que el en y los del se las por un para con no una su al lo como más pero sus le ya este o es".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie".split(),
}


@dataclass(frozen=True)
class Rule:
    """``low <= top / bottom <= high``; a ratio over nothing breaks no rule."""

    name: str
    top: str
    bottom: str
    low: float | None = None
    high: float | None = None


#: Limits are wide: they stop texts that are no prose, not unusual prose.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.1),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
    Rule("words_per_line", "n_words", "n_lines", 2.0, None),
)


def _measures(repeat_window: int) -> list[dict[str, str]]:
    """Columns in the order in which each set may use the ones before it."""
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    listed = ", ".join(f"'{w}'" for w in stop)
    window = ", ".join(f"_w[i + {k}]" for k in range(repeat_window))
    return [
        {"_text": "coalesce({text}, '')"},
        {"_w": f"regexp_extract_all(_text, r'{WORD}', 0)",
         "_lines": f"filter(split(_text, r'\n', -1), l -> l rlike r'{WORD}')",
         "n_symbols": "cast(regexp_count(_text, '[#*$%&|<>]') as bigint)"},
        {"n_words": "cast(size(_w) as bigint)",
         "word_chars": "cast(char_length(array_join(_w, '')) as bigint)",
         "n_stop_words": f"cast(size(filter(_w, w -> w in ({listed}))) as bigint)",
         "n_lines": "cast(size(_lines) as bigint)",
         "n_dup_lines": "cast(size(_lines) - size(array_distinct(_lines)) as bigint)",
         "_h": f"if(size(_w) < {repeat_window}, cast(array() as array<bigint>), "
               f"transform(sequence(0, greatest(size(_w) - {repeat_window}, 0)), i -> xxhash64({window})))"},
        # Only a text in which some window occurs twice pays for sorting windows with their places.
        {"_at": "if(size(array_distinct(_h)) = size(_h), cast(array() as array<struct<h: bigint, i: int>>), "
                "sort_array(transform(_h, (h, i) -> struct(h as h, i as i))))"},
        {"_at": "sort_array(transform(filter(_at, (x, i) -> x.h = get(_at, i - 1).h or x.h = get(_at, i + 1).h), x -> x.i))"},
        # A place that opens a repeated window covers words up to the next such place, or the whole window.
        {"n_repeat_words": f"aggregate(transform(_at, (x, i) -> least({repeat_window}, "
                           f"coalesce(get(_at, i + 1) - x, {repeat_window}))), 0L, (s, x) -> s + x)"},
        {"base_failed": "n_words < {min_words} or 100 * n_repeat_words > {repeat_percent} * n_words"},
    ]


def _verdict(rules) -> Column:
    ok = ~F.col("base_failed")
    for r in rules:
        ratio = F.try_divide(F.col(r.top).cast("double"), F.col(r.bottom).cast("double"))
        for side, limit in ((ratio >= F.lit(r.low), r.low), (ratio <= F.lit(r.high), r.high)):
            if limit is not None:
                ok = ok & F.coalesce(side, F.lit(True))
    return ok


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, min_words: int = 10,
                  repeat_percent: int = 20, repeat_window: int = 5) -> DataFrame:
    """Measures and verdict per row: ``kept`` if the base check and every rule hold.

    The base check fails texts of under ``min_words`` words and texts in which more
    than ``repeat_percent`` percent of the words lie in windows of
    ``repeat_window`` words that occur twice or more.
    """
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_in"))
    for stage in _measures(repeat_window):
        out = out.withColumns({name: F.expr(sql.replace("{text}", "_in").replace("{min_words}", str(min_words))
                                            .replace("{repeat_percent}", str(repeat_percent)))
                               for name, sql in stage.items()})
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", _verdict(rules).alias("kept"), "n_stop_words", "n_lines")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows whose text passes, with all columns of the input; judged in the scan, without a join."""
    names = docs.columns
    judged = docs.withColumns({"_text_": F.col(text_col)}).withColumn("_row_", F.struct(*[F.col(f"`{c}`") for c in names]))
    verdict = quality_rules(judged.select(F.col("_row_"), F.col("_text_")), "_row_", "_text_", **limits)
    # A row number in the condition keeps the filter above the projection: pushed below it, every
    # measure would be written out again wherever another one uses it.
    numbered = verdict.withColumn("_number_", F.monotonically_increasing_id())
    return numbered.where("kept and _number_ >= 0").select(*[F.col("_row_")[c].alias(c) for c in names])
