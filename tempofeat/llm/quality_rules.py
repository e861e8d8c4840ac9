"""Quality rules with adaptive thresholds, in DataFrame operations only.

Per document: base counts over the whole text. Per language and source: a
mergeable quantile sketch of each measure, a histogram of log-linear buckets;
the counts of a language's sources add up to the language's own and these to
one of everything. Buckets do not depend on the data or on the order of rows, so
equal tables give equal thresholds, at any size. A group's fences, quartiles
widened by a multiple of the quartile range, replace fixed cutoffs; a group with
too few rows takes its language's, or the overall ones. Documents are joined
with the fences of their group and judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempofeat.llm.shared import cut, stored, unused

SPACE = r"[\\x20\\x09-\\x0D]"  # inside SQL string literals
#: measure: smallest quartile range that counts, so that fences keep a distance from the quartiles.
MEASURES = {"symbol_rate": 0.02, "dup_line_rate": 0.1, "repeat_rate": 0.1, "word_length": 1.0}
#: Widths of the sketches' buckets below each bound, and beyond: powers of two, so that bucketing is exact.
WIDTHS = ((1.0, 2.0**-12), (64.0, 2.0**-6), (4096.0, 1.0), (2.0**18, 64.0), (2.0**24, 4096.0), (None, 2.0**18))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates `value` once and uses it in `body`, also inside lambdas."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeated(words: str) -> str:
    """SQL: how many of the words lie in a 3-word window found twice or more.

    Windows are compared by 64-bit hashes, sorted with their places: equal
    neighbours are repeats, and the union of their words follows from the gaps."""
    twin = "coalesce(get(s, j - 1).h = s[j].h, false) or coalesce(get(s, j + 1).h = s[j].h, false)"
    places = f"sort_array(filter(transform(sequence(0, size(s) - 1), j -> if({twin}, s[j].i, null)), x -> x is not null))"
    covered = "if(size(p) < 2, 0, aggregate(sequence(1, size(p) - 1), 3, (n, j) -> n + least(3, p[j] - p[j - 1])))"
    hashed = f"sort_array(transform(sequence(0, size({words}) - 3), i -> struct(xxhash64({words}[i], {words}[i + 1], {words}[i + 2]) as h, i as i)))"
    return f"if(size({words}) < 4, 0, {let(hashed, 's', let(places, 'p', covered))})"


def counts(text: str = "text") -> Column:
    """A struct of the base counts of a text (null: no words, no lines)."""
    t = f"coalesce({text}, '')"
    words = rf"filter(split({t}, '{SPACE}+'), x -> x <> '')"
    lines = rf"filter(split({t}, '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"
    of_words = let(words, "w", f"struct(size(w) as n, {repeated('w')} as r, length(array_join(w, '')) as c)")
    of_lines = let(lines, "l", "struct(size(l) as n, size(array_distinct(l)) as d)")
    symbols = rf"length(regexp_replace({t}, '[^#*$%&|<>]+', ''))"
    both = let(
        f"struct({of_words} as w, {of_lines} as l, {symbols} as s)",
        "c",
        "struct(cast(c.w.n as long) as n_words, cast(c.w.c as long) as word_chars, cast(c.s as long) as n_symbols,"
        " cast(c.l.n - c.l.d as long) as n_dup_lines, cast(c.w.r as long) as n_repeat_words, cast(c.l.n as long) as n_lines)",
    )
    return F.expr(both)


def measured(docs: DataFrame, text_col: str, least_words: int, repeat_percent: int, out: str) -> DataFrame:
    """docs with the base counts, base_failed and the measures in one struct `out`."""
    (own,) = unused(docs.columns, "counts")
    rows = docs.withColumn(own, counts(f"`{text_col}`"))
    c = {k: F.col(f"{own}.{k}") for k in (*BASE, "n_lines")}
    failed = (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > repeat_percent * c["n_words"])
    rate = lambda a, b: a / F.greatest(b, F.lit(1))
    measures = {
        "symbol_rate": rate(c["n_symbols"], c["word_chars"]),
        "dup_line_rate": c["n_dup_lines"] / (c["n_lines"] + 5),  # 5: one repeat says little in a text of few lines
        "repeat_rate": rate(c["n_repeat_words"], c["n_words"]),
        "word_length": rate(c["word_chars"], c["n_words"]),
    }
    fields = [*(c[k].alias(k) for k in BASE), failed.alias("base_failed"), *(v.cast("double").alias(k) for k, v in measures.items())]
    return rows.withColumn(out, F.struct(*fields)).drop(own)


def bucket(x: Column) -> Column:
    """The lower edge of the bucket that holds x: off by less than 2^-12 below 1, else by x / 64 at most."""
    out = F.floor(x / WIDTHS[-1][1]) * WIDTHS[-1][1]
    for bound, width in reversed(WIDTHS[:-1]):
        out = F.when(x < bound, F.floor(x / width) * width).otherwise(out)
    return out


def sketches(measures: DataFrame) -> DataFrame:
    """lang, source, measure, at and n: how many rows of a group have the measure in the bucket at `at`.

    Base-failed documents have no say: they give a null measure, which keeps
    their group known. Counts combine on the map side, so that a hot group
    sends its buckets once per task; they merge by adding."""
    each = [F.struct(F.lit(m).alias("measure"), bucket(F.col(f"q.{m}")).alias("at")) for m in MEASURES]
    none = F.array(F.struct(F.lit(None).cast("string").alias("measure"), F.lit(0.0).alias("at")))
    rows = measures.select("lang", "source", F.explode(F.when(F.col("q.base_failed"), none).otherwise(F.array(*each))).alias("m"))
    return rows.groupBy("lang", "source", "m.measure", "m.at").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
    """For each group of keys one struct: its rows n, and a_ and b_ of each measure, its lower and upper quartile."""
    own = sketch.where("measure is not null").groupBy(*keys, "measure", "at").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    # a window holds the buckets of one measure of one group: some ten thousand at most, whatever the rows
    own = own.withColumns({"upto": F.sum("n").over(group.orderBy("at")), "total": F.sum("n").over(group)})
    picks = [F.coalesce(F.max(F.when(F.col("measure") == next(iter(MEASURES)), F.col("total"))), F.lit(0)).alias("n")]
    for m in MEASURES:
        for label, share in (("a", 1), ("b", 3)):
            picks.append(F.min(F.when((F.col("measure") == m) & (4 * F.col("upto") >= share * F.col("total")), F.col("at"))).alias(f"{label}_{m}"))
    out = own.groupBy(*keys).agg(*picks)
    return out.select(*keys, F.struct("n", *(f"{x}_{m}" for m in MEASURES for x in "ab")).alias(name))


def fences(measures: DataFrame, least_rows: int, reach: float) -> DataFrame:
    """lang, source and fence of each group that has rows: the level its quartiles
    are of, and low_ and high_ of each measure (null where no row has a say).

    measures: lang, source and q."""
    sketch = cut(sketches(measures))
    by_lang = quartiles(sketch, ["lang"], "of_lang").withColumnRenamed("lang", "l")
    by_group = quartiles(sketch, ["lang", "source"], "of_group").select(F.col("lang").alias("g"), F.col("source").alias("s"), "of_group")
    groups = sketch.select("lang", "source").distinct()
    groups = groups.join(by_group, groups["lang"].eqNullSafe(F.col("g")) & groups["source"].eqNullSafe(F.col("s")), "left")
    groups = groups.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left")
    groups = groups.join(F.broadcast(quartiles(sketch, [], "of_all")))  # its one row
    level = F.when(F.col("of_group.n") >= least_rows, "source").when(F.col("of_lang.n") >= least_rows, "lang").otherwise("all")
    chosen = F.when(level == "source", F.col("of_group")).when(level == "lang", F.col("of_lang")).otherwise(F.col("of_all"))
    chosen = groups.select("lang", "source", level.alias("level"), chosen.alias("c"))
    out = [F.col("level")]
    for m, least in MEASURES.items():
        low, high = F.col(f"c.a_{m}"), F.col(f"c.b_{m}")
        spread = reach * F.greatest(high - low, F.lit(least))
        out += [(low - spread).alias(f"low_{m}"), (high + spread).alias(f"high_{m}")]
    return chosen.select("lang", "source", F.struct(*out).alias("fence"))


def judge(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_words: int = 50,
    repeat_percent: int = 50,
    least_rows: int = 100,
    reach: float = 3.0,
    broadcast_rows: int = 50_000,
    drop_text: bool = False,
) -> DataFrame:
    """docs with `__q` (base counts, base_failed, measures), `__level` and `__kept`.

    Columns of docs with these three names are replaced; all others stay, but
    the text if it is to be dropped. base_failed: under least_words words, or
    over repeat_percent of 100 of them repeated. __kept: not base_failed and
    every measure inside the fences of its language and source (nulls are a
    language and a source of their own; ties at a fence stay). A null or empty
    text has no words, so it fails; a very long one is measured whole. Repeated
    rows count as often as they stand; an empty table gives no rows. Each text
    is measured once: the measured rows are written to the shared folder and
    reread. Fences are joined by a broadcast up to `broadcast_rows` groups,
    counted.
    """
    docs = docs.drop("__q", "__level", "__kept")
    rows = measured(docs, text_col, least_words, repeat_percent, "__q")
    rows = stored(rows.drop(text_col) if drop_text else rows)
    limits = cut(fences(rows.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col("__q").alias("q")), least_rows, reach))
    lang, source, fence = unused(rows.columns, "fence_lang", "fence_source", "fence")
    small = limits.count() <= broadcast_rows
    limits = limits.toDF(lang, source, fence)
    same = F.col(lang_col).eqNullSafe(F.col(lang)) & F.col(source_col).eqNullSafe(F.col(source))
    joined = rows.join(F.broadcast(limits) if small else limits, same, "left")
    inside = F.lit(True)
    for m in MEASURES:
        inside &= F.coalesce(F.col(f"__q.{m}").between(F.col(f"{fence}.low_{m}"), F.col(f"{fence}.high_{m}")), F.lit(True))
    return joined.select(*rows.columns, F.col(f"{fence}.level").alias("__level"), (~F.col("__q.base_failed") & inside).alias("__kept"))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    judged = judge(docs, drop_text=True)
    return judged.select("doc_id", *(F.col(f"__q.{c}").alias(c) for c in (*BASE, "base_failed")), F.col("__kept").alias("kept"), F.col("__level").alias("fence_level"))
