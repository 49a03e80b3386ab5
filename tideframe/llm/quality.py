"""Quality rules: a threshold table compiled into one projection of built-in functions.

No user function and no shuffle: every metric of a text is computed inside its own row, repeated
three-word windows by sorting the row's own windows, so cost is n log n in a text's words.

Defined results: a null or blank text has zero words, fails the base rule and is not kept. Ratios
whose denominator is zero are zero. Rows are judged one by one, so repeated rows give repeated
results; other columns of the input are carried (``annotate``) or left out (``report``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages that the rules expect.
STOP_WORDS = {
    "en": "the of and to in a is that for with was on as by this it are be from at or an".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par au sur pas avec ce il".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como es".split(),
}


@dataclass(frozen=True)
class Rule:
    """A metric, and the closed range in which a good text's value lies."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The production thresholds. Metrics are expressions over the columns that ``_measures`` makes.
RULES = (
    Rule("length", "n_words", 50, None),
    Rule("word_length", "word_chars / n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols / n_words", None, 0.10),
    Rule("stop_words", "n_stop / n_words", 0.04, None),
    Rule("repeated_windows", "n_repeat_words / n_words", None, 0.50),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.50),
    Rule("bullet_lines", "n_bullets / n_lines", None, 0.90),
    Rule("ellipsis_lines", "n_ellipses / n_lines", None, 0.30),
    Rule("letter_words", "n_letter_words / n_words", 0.60, None),
)


def _repeat_words(words: str, n: str) -> tuple[Column, Column, Column]:
    """Windows of three words with their places; which neighbours are equal; the number of words in repeated ones."""
    windows = F.expr(
        f"case when {n} < 4 then array() else transform(slice({words}, 1, {n} - 2), "
        f"(w, i) -> struct(concat_ws(' ', w, {words}[i + 1], {words}[i + 2]) as t, i as i)) end"
    )
    s, m = "_windows", "size(_windows)"
    equal = f"zip_with(slice({s}, 1, greatest({m} - 1, 0)), slice({s}, 2, greatest({m} - 1, 0)), (a, b) -> a.t = b.t)"
    places = f"""sort_array(filter(zip_with(
        zip_with(concat(array(false), _equal), concat(_equal, array(false)), (x, y) -> x or y), {s},
        (f, x) -> if(f, x.i, -1)), i -> i >= 0))"""
    count = f"""aggregate({places}, struct(0 as upto, 0L as total),
        (a, p) -> struct(p + 3 as upto, a.total + (p + 3 - greatest(p, a.upto)) as total), a -> a.total)"""
    return windows, F.expr(equal), F.expr(f"case when {m} = 0 then 0L else {count} end")


def _measures(df: DataFrame, text: str) -> DataFrame:
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_text", t)
    df = df.withColumn("_words", F.filter(F.split("_text", SPLIT), lambda w: w != "")).withColumn(
        "_lines", F.filter(F.split("_text", "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    )
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_bullets": F.size(F.filter("_lines", lambda x: F.ltrim(x).rlike("^[-*•]"))).cast("long"),
            "n_ellipses": F.size(F.filter("_lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long"),
            "n_stop": F.size(F.filter("_words", lambda w: F.lower(w).isin(stop))).cast("long"),
            "n_letter_words": F.size(F.filter("_words", lambda w: w.rlike("\\p{L}"))).cast("long"),
            "_n": F.size("_words"),
        }
    )
    windows, equal, count = _repeat_words("_words", "_n")
    df = df.withColumn("_windows", F.sort_array(windows)).withColumn("_equal", equal)
    return df.withColumn("n_repeat_words", count.cast("long"))


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The rules as one boolean expression; never null."""
    whole = F.lit(True)
    for r in rules:
        top, _, below = r.metric.partition(" / ")
        value = F.col(top).cast("double")
        if below:
            value = F.when(F.col(below) > 0, value / F.col(below)).otherwise(F.lit(0.0))
        if r.low is not None:
            whole &= value >= F.lit(float(r.low))
        if r.high is not None:
            whole &= value <= F.lit(float(r.high))
    return whole


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: id, base measures, base_failed, kept."""
    few = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_raw"))
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    out = _measures(few, "_raw").withColumn("base_failed", failed)
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & compiled(rules)).alias("kept"))


def keep(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df whose text passes, with all their columns and no others."""
    packed = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"), df[f"`{text_col}`"].alias("_raw"))
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    # a plain filter would be pushed below the measures, with a copy of them for each of its terms
    passed = F.when(~failed & compiled(rules), F.array("_row"))
    return _measures(packed, "_raw").select(F.explode(passed).alias("_row")).select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from tideframe.llm.common import table

    return report(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    checks = []
    for r in RULES:
        top, _, below = r.metric.partition(" / ")
        value = f"(case when {below} > 0 then {top}::double / {below} else 0.0 end)" if below else f"{top}::double"
        checks += [f"{value} {sign} {float(x)}" for sign, x in ((">=", r.low), ("<=", r.high)) if x is not None]
    return f"""
    with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
    tok as (select rid, unnest(w) as w, unnest(range(1, len(w) + 1)) as pos
            from (select rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w from d)),
    tri as (select rid, pos, w || ' ' || lead(w) over x || ' ' || lead(w, 2) over x as g from tok window x as (partition by rid order by pos)),
    dup as (select rid, pos, count(*) over (partition by rid, g) > 1 as f from tri where g is not null),
    rep as (select rid, count(distinct pos + o) as n from dup, (values (0), (1), (2)) v(o) where f group by rid),
    wrd as (select rid, count(*) as n_words, count(*) filter (where lower(w) in ({stop})) as n_stop,
            count(*) filter (where regexp_matches(w, '\\p{{L}}')) as n_letter_words from tok group by rid),
    lin as (select rid, count(*) as n_lines, count(*) - count(distinct x) as n_dup_lines,
            count(*) filter (where regexp_matches(x, '^ *[-*•]')) as n_bullets,
            count(*) filter (where regexp_matches(x, '(\\.\\.\\.|…) *$')) as n_ellipses
            from (select rid, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^\\x20\\x09-\\x0D]') group by rid),
    m as (select d.doc_id, coalesce(n_words, 0) as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) as word_chars,
            length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
            coalesce(rep.n, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, coalesce(n_bullets, 0) as n_bullets,
            coalesce(n_ellipses, 0) as n_ellipses, coalesce(n_stop, 0) as n_stop, coalesce(n_letter_words, 0) as n_letter_words
          from d left join wrd using (rid) left join lin using (rid) left join rep using (rid)),
    f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
    select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
           n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
           not base_failed and {" and ".join(checks)} as kept from f"""
