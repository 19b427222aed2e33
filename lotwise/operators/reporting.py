"""Views over run tables as text, and the audit of numbers in prose."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the report's format.
BEGIN, END = "<!-- BEGIN:{} -->", "<!-- END:{} -->"


def markdown_table(header: Sequence[str], rows: Iterable[Sequence]) -> str:
    """A Markdown table of a small result; bars in cells are escaped."""
    cell = lambda x: str(x).replace("|", "\\|")
    lines = [f"| {' | '.join(map(cell, header))} |", f"|{'---|' * len(header)}"]
    return "\n".join([*lines, *(f"| {' | '.join(map(cell, r))} |" for r in rows)])


def interval(mean: Column, low: Column, high: Column, clip: bool = False) -> Column:
    """'0.759 [0.739, 0.779]', clipped to 0 and 1 where asked."""
    if clip:
        low, high = F.greatest(low, F.lit(0.0)), F.least(high, F.lit(1.0))
    return F.format_string("%.3f [%.3f, %.3f]", mean, low, high)


def signed(x: Column) -> Column:
    return F.format_string("%+.3f", x)


def percent(x: Column) -> Column:
    return F.concat(F.format_number(x * 100, 1), F.lit(" %"))


def verdict(low: Column, high: Column) -> Column:
    """What an interval of a difference says."""
    return F.when(low > 0, "higher").when(high < 0, "lower").otherwise("not told apart")


def scorecard(df: DataFrame, value: str, target: float) -> DataFrame:
    return df.withColumn("met", F.col(value) >= target)


def two_by_two(recs: DataFrame, row: str, column: str, value: str, rows: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(row, a column a level, difference): means of a 2 x 2 design, and under 'difference' what the row factor adds."""
    a, b = columns
    out = recs.groupBy(row).pivot(column, list(columns)).agg(F.avg(value)).withColumn("difference", F.col(b) - F.col(a))
    at = lambda c, level: F.max(F.when(F.col(row) == level, F.col(c)))
    last = out.agg(*[(at(c, rows[1]) - at(c, rows[0])).alias(c) for c in (*columns, "difference")]).select(F.lit("difference").alias(row), *columns, "difference")
    return out.unionByName(last)


def effect_rank(effects: DataFrame, name: str, effect: str, headline: str) -> DataFrame:
    """(n, rank, headline, median): where the headline's magnitude stands among all effects, the largest first, and the
    upper median of the magnitudes."""
    size = F.round(F.abs(effect), 12)
    head = effects.filter(F.col(name) == headline).select(size.alias("headline"))
    s = effects.select(size.alias("_s")).crossJoin(F.broadcast(head))  # one row
    out = s.agg(F.count("*").alias("n"), (F.count(F.when(F.col("_s") > F.col("headline"), 1)) + 1).alias("rank"), F.max("headline").alias("headline"), F.sort_array(F.collect_list("_s")).alias("_all"))
    return out.select("n", "rank", "headline", F.element_at("_all", F.floor(F.col("n") / 2).cast("int") + 1).alias("median"))


def checked_claims(claims: DataFrame, measured: DataFrame, digits: int = 3) -> DataFrame:
    """(label, source, expected, value, ok) of claims(label, source, expected) against measured(source, value); a claim
    whose source has no value doesn't hold."""
    out = claims.join(measured, "source", "left")
    return out.select("label", "source", "expected", "value", F.coalesce(F.round("expected", digits) == F.round("value", digits), F.lit(False)).alias("ok"))


#: What a claim has: the run that it is about, the paths of its values in the run's document, a Java format and a factor.
#: With ``records``, the path of an array, paths are those of its elements, those whose path ``where`` is true (NULL: all),
#: and ``how`` makes one value of theirs: count, sum, avg, min or max.
CLAIM = "label string, source string, paths array<string>, format string, factor double, records string, `where` string, how string"
FOLDS = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def texts_of_claims(claims: DataFrame, runs: DataFrame) -> DataFrame:
    """(label, source, n_runs, text) of claims of the schema CLAIM, from runs(source, document VARIANT) of any schemas, all
    in one plan. Labels are unique. A claim without a run, or one of whose values or records aren't
    there, has no text."""
    known = runs.withColumn("_run", F.lit(1))
    c = claims.join(known, "source", "left").withColumn("_part", F.when(F.col("records").isNull(), F.array("document")).otherwise(F.expr("try_variant_get(document, records, 'array<variant>')")))
    c = c.withColumn("_has", F.col("_part").isNotNull()).withColumn("_part", F.explode_outer("_part"))
    keep = F.col("where").isNull() | F.coalesce(F.expr("try_variant_get(_part, `where`, 'boolean')"), F.lit(False))
    c = c.withColumn("_keep", keep & F.col("_run").isNotNull()).select("*", F.posexplode_outer("paths").alias("_at", "_path"))
    value = F.when(F.col("_keep"), F.expr("try_variant_get(_part, _path, 'double')"))
    folded = F.when(F.col("how").isNull(), F.max(value))
    for name, fold in FOLDS.items():
        folded = folded.when((F.col("how") == name) & F.max("_has"), fold(value).cast("double"))
    one = c.groupBy("label", "source", "format", "factor", "how", "_at").agg(folded.alias("_value"), F.count("_run").alias("_runs"))
    values = one.groupBy("label", "source", "format", "factor").agg(F.array_sort(F.collect_list(F.struct("_at", F.col("_value").alias("value")))).alias("_v"), F.max(F.sign("_runs")).cast("int").alias("n_runs"))
    v = [F.col("factor") * F.element_at("_v", F.least(F.lit(i), F.size("_v"))).getField("value") for i in (1, 2, 3)]
    values = values.withColumn("a", v[0]).withColumn("b", v[1]).withColumn("c", v[2])
    there = (F.col("n_runs") > 0) & ~F.exists("_v", lambda x: x.getField("value").isNull())
    return values.select("label", "source", "n_runs", F.when(there, F.expr("format_string(format, a, b, c)")).alias("text"))


def audited(texts: DataFrame, document: str) -> DataFrame:
    """(label, source, text, status) of texts_of_claims: 'no run' (which is tolerated), 'no value', 'absent' if the
    document doesn't have the text, else 'ok'. Typographic signs for minus and dashes count as '-'."""
    plain = document.translate(dict.fromkeys((0x2212, 0x2013, 0x2014), "-"))
    status = F.when(F.col("n_runs") == 0, "no run").when(F.col("text").isNull(), "no value").when(F.contains(F.lit(plain), F.col("text")), "ok").otherwise("absent")
    return texts.select("label", "source", "text", status.alias("status"))


def inject(document: str, sections: dict[str, str]) -> str:
    """document with the text between each section's marks replaced; sections without marks are left out."""
    for name, text in sections.items():
        a, b = BEGIN.format(name), END.format(name)
        if a in document and b in document:
            head, _, rest = document.partition(a)
            _, _, tail = rest.partition(b)
            document = f"{head}{a}\n{text}\n{b}{tail}"
    return document


def stale(document: str, sections: dict[str, str]) -> bool:
    """Whether inject() would change the document."""
    return inject(document, sections) != document


FENCE, DATE, NAME, GROUPED, NUMBER = r"```[^`]*```", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[A-Za-z_]+[0-9]+[A-Za-z_0-9]*", r"([0-9]),([0-9]{3})", r"[0-9]+(?:\.[0-9]+)?"


def numbers(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number): the numbers of prose, without code, dates, names with digits and thousands separators."""
    t = F.coalesce(F.col(text), F.lit(""))
    for pattern in (FENCE, DATE, NAME):
        t = F.regexp_replace(t, pattern, " ")
    for _ in range(2):  # a match takes the digits around its comma, so that each second comma is left for another pass
        t = F.regexp_replace(t, GROUPED, "$1$2")
    return documents.select(key, F.explode(F.regexp_extract_all(t, F.lit(NUMBER), 0)).alias("number"))


def unclaimed(documents: DataFrame, claims: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, times): numbers in prose that claims(number) doesn't have."""
    return numbers(documents, key, text).groupBy(key, "number").agg(F.count("*").alias("times")).join(claims.select("number").distinct(), "number", "left_anti").select(key, "number", "times")


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """(keys, bin, n) of values from low to high; the upper end falls into the last bin."""
    width = (high - low) / bins
    b = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    return df.filter((F.col(value) >= low) & (F.col(value) <= high)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
