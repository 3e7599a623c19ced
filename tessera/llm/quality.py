"""Quality rules whose thresholds adapt to each language and source, from mergeable quantile sketches.

Four measures of a document (whole numbers: letters a word, symbols a word, repeated lines, repeated
words) are sketched per (language, source): a sketch counts values in buckets that keep a value's five
leading bits, so a quantile is exact to 1/16, sketches merge by adding counts, and the result doesn't
depend on the order of rows or tasks.  A document passes if each measure lies within fences around the
middle half of its group: quartile -/+ FENCE times the larger of the interquartile range and a floor.
A group with fewer than LEAST documents takes the merged sketch of its language, or of all.

The counts are summed before they are shuffled; the thresholds, a row for each group, are joined back
by a broadcast if they are few, else by a join that may split hot groups.

Defined results: null texts and texts without a word have no words and fail the base rules; null language
and null source are groups of their own; repeated rows give repeated results and count as often as they
stand there; an empty table gives no rows; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import SPACES, lean, lots, written, written_bytes

SYMBOLS = "#*$%&|<>"
#: Words of a window; base rules: the fewest words, and the most repeated ones in a hundred.
WINDOW, FEWEST, REPEATED = 8, 20, 30
#: Documents that a group needs for thresholds of its own; interquartile ranges that a fence lies off; bytes of the thresholds' table up to which it is broadcast.
LEAST, FENCE, FEW_BYTES = 50, 3, 8 << 20
#: The measures: name, expression over the counts, the least range that counts, whether low values fail too.
#: The least ranges of the last two are a tenth of the base rule's cutoff, so that their fences lie well below it.
MEASURES = (
    ("word_length", "100 * word_chars div n_words", 100, True),
    ("symbols", "1000 * n_symbols div n_words", 50, False),
    ("dup_lines", "1000 * n_dup_lines div n_lines", 30, False),
    ("repeat_words", "1000 * n_repeat_words div n_words", 30, False),
)
ROWS = 256
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in windows which occur twice or more.

    Windows are named exactly: a name for each pair of words, of pairs of pairs, and of pairs of those.
    """
    if len(words) <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    names = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    step = 1
    while step < WINDOW:
        pairs = names[:-step] << 32 | names[step:]
        _, names, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(counts) == len(names):
            return 0
        step *= 2
    starts = np.flatnonzero(counts[names] > 1)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(change)))


def counts(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of a text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at just the six white characters
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def counted(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(id, lang, source, counts) of each row, as columns __id, lang, source and those of COUNTS."""
    kept = df.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("__text"))
    schema = T.StructType([*kept.schema.fields[:-1], *T._parse_datatype_string(COUNTS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches, 3, ROWS):
            rows = np.array([counts(t or "") for t in batch.column(3).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c) for c in rows.T)], schema.names)

    return kept.mapInArrow(lean(run), schema)


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED)


def bucket(value: str) -> Column:
    """The least value with the same five leading bits."""
    off = f"cast(greatest(0, length(bin({value})) - 5) as int)"
    return F.expr(f"shiftleft(shiftright({value}, {off}), {off})")


def sketched(rows: DataFrame) -> DataFrame:
    """Sketches of the documents that pass the base rules: (lang_key, source_key, measure, low, n)."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("measure"), F.expr(f"cast({e} as bigint)").alias("v")) for i, (_, e, _, _) in enumerate(MEASURES)])).alias("m")
    return rows.where(~base_failed()).select("lang_key", "source_key", each).select("lang_key", "source_key", "m.measure", bucket("m.v").alias("low")).groupBy("lang_key", "source_key", "measure", "low").agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketches: DataFrame, groups: DataFrame) -> DataFrame:
    """For each group (lang_key, source_key): the fences lo_i and hi_i of each measure, from the smallest merged sketch with enough documents."""
    everything = F.lit(None).cast("string")
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), a.alias("a"), b.alias("b")) for i, (a, b) in enumerate(((F.col("lang_key"), F.col("source_key")), (F.col("lang_key"), everything), (everything, everything)))])).alias("l")
    merged = sketches.select(levels, "measure", "low", "n").groupBy("l.level", "l.a", "l.b", "measure", "low").agg(F.sum("n").alias("n"))
    part = Window.partitionBy("level", "a", "b", "measure")
    cumulated = merged.withColumn("upto", F.sum("n").over(part.orderBy("low").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(part))

    def quartile(k: int) -> Column:
        return F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("low")))

    quartiles = cumulated.groupBy("level", "a", "b", "measure").agg(F.max("all").alias("all"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    floor = F.element_at(F.array(*[F.lit(m[2]) for m in MEASURES]), F.col("measure") + 1)
    off = F.lit(FENCE) * F.greatest(F.col("q3") - F.col("q1"), floor)
    wide = quartiles.withColumn("off", off).groupBy("level", "a", "b").agg(
        F.max("all").alias("all"),
        *[F.max(F.when(F.col("measure") == i, F.col("q3") + F.col("off"))).alias(f"hi_{i}") for i in range(len(MEASURES))],
        *[F.max(F.when(F.col("measure") == i, F.col("q1") - F.col("off"))).alias(f"lo_{i}") for i in range(len(MEASURES))],
    )
    found = [f"{side}_{i}" for i in range(len(MEASURES)) for side in ("lo", "hi")]
    out = groups
    for level, on in enumerate((("a", "b"), ("a",), ())):
        right = wide.where((F.col("level") == level) & (F.lit(level == 2) | (F.col("all") >= LEAST))).select(*[F.col(c).alias(f"{c}_{level}") for c in ("a", "b")], F.struct(*found).alias(f"f{level}"))
        cond = [F.col({"a": "lang_key", "b": "source_key"}[c]) == F.col(f"{c}_{level}") for c in on] or [F.lit(True)]
        test = cond[0]
        for c in cond[1:]:
            test = test & c
        out = out.join(F.broadcast(right) if level == 2 else right, test, "left")  # level 2 is one row
    best = F.coalesce("f0", "f1", "f2")
    return out.select("lang_key", "source_key", *[best[c].alias(c) for c in found])


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each row."""
    key = lambda c: F.when(F.col(c).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(c)))
    rows = written(counted(df, id_col, text_col, lang_col, source_col), "counts").withColumns({"lang_key": key("lang"), "source_key": key("source")})
    fences = written(thresholds(sketched(rows), rows.select("lang_key", "source_key").distinct()), "fences")
    joined = rows.join(F.broadcast(fences) if written_bytes(fences) <= FEW_BYTES else fences, ["lang_key", "source_key"], "left")
    passes = F.lit(True)
    for i, (_, expression, _, low) in enumerate(MEASURES):
        value = F.when(base_failed(), F.lit(0)).otherwise(F.expr(f"case when n_words > 0 and n_lines > 0 then {expression} else 0 end"))
        passes = passes & (value <= F.coalesce(F.col(f"hi_{i}"), value))
        if low:
            passes = passes & (value >= F.coalesce(F.col(f"lo_{i}"), value))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return joined.select(F.col("__id").alias(id_col), *names, base_failed().alias("base_failed"), (~base_failed() & passes).alias("kept"))
