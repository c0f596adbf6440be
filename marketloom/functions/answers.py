"""Reading directions out of free text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import FAILED, strip_u

#: The forms of an answer.
HORIZONS = (1, 3, 7)
HORIZON_PATTERN = r"(?U)未来\s*{}\s*个?交易日\s*[:：]\s*(涨|跌|上涨|下跌)"
SEPARATED = r"([涨跌])\s*[，,/\s]\s*([涨跌])\s*[，,/\s]\s*([涨跌])"
TRIPLET_LINE = r"(?U)^\s*" + SEPARATED + r"\s*$"
TRIPLET_PHRASE = r"(?U)(?:最终答案|答案|结论|预测结果)\s*[:：是为]?\s*" + SEPARATED
SINGLE_LINE = r"^([涨跌])$"
SINGLE_PHRASES = (r"(?U)(?:最终答案|答案|结论|预测结果)\s*[:：是为]\s*([涨跌])", r"(?U)(?:因此|所以|故|判断|预测)\s*(?:Day8)?\s*(?:为|是|将)?\s*([涨跌])")


def normalized(x: Column) -> Column:
    """上涨 and 下跌 as single characters; null for anything else."""
    value = strip_u(x)
    return F.when(value.isin("涨", "上涨"), F.lit("涨")).when(value.isin("跌", "下跌"), F.lit("跌"))


def lines_of(x: Column) -> Column:
    """Stripped lines that aren't empty."""
    return F.filter(F.transform(F.split(x, r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"), lambda s: strip_u(s)), lambda s: s != "")


def last_of(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(-1))


def found(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def label_triplet(x: Column, wide: bool = False) -> Column:
    """Three labels as an array, or null if the text isn't exactly three directions.

    The wide form also takes 、 / | as separators, runs of them as one, and drops spaces.
    """
    if wide:
        parts = F.split(F.replace(strip_u(x), F.lit(" "), F.lit("")), r"[，,、/|]+")
    else:
        parts = F.transform(F.split(strip_u(x), "[，,]"), lambda p: strip_u(p))
    read = F.transform(F.filter(parts, lambda p: p != ""), lambda p: normalized(p))
    return F.when((F.size(read) == 3) & F.forall(read, lambda p: p.isNotNull()), read)


def horizon_answers(x: Column) -> list[Column]:
    """The answer for each horizon by its own line, each null on its own."""
    return [normalized(found(x, HORIZON_PATTERN.format(h))) for h in HORIZONS]


def partial_triplet(x: Column) -> Column:
    return F.array(*horizon_answers(x))


def final_triplet(x: Column) -> Column:
    """All three horizon lines, else the last three lines if all are directions, else null."""
    by_line = F.array(*horizon_answers(x))
    lines = lines_of(x)
    tail = F.transform(F.when(F.size(lines) >= 3, F.slice(lines, -3, 3)), lambda s: normalized(last_of(F.split(s, "[:：]"))))
    whole = lambda xs: F.when(F.forall(xs, lambda p: p.isNotNull()), xs)
    return F.coalesce(whole(by_line), whole(tail))


def completion_text(x: Column, kind: T.DataType) -> Column:
    """Text of a completion that is a text or a list of messages (the first one's content); '' for an empty list."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.try_element_at(x, F.lit(1))["content"], F.lit(""))
    return x.cast("string")


def reference_triplet(label: Column, completion: Column) -> Column:
    """The reference directions of a row: of its label if it isn't blank, else of its completion; null if unreadable."""
    blank = strip_u(F.coalesce(label, F.lit(""))) == ""
    return F.when(blank, final_triplet(completion)).otherwise(label_triplet(label))


def one_line_triplet(x: Column) -> Column:
    """The last line that is a triplet, else the last phrase that names one, as 'a，b，c'; else the failure mark."""
    lines = lines_of(x)
    line = last_of(F.filter(lines, lambda s: s.rlike(TRIPLET_LINE)))
    by_line = F.concat_ws("，", *(found(line, TRIPLET_LINE, k) for k in (1, 2, 3)))
    text = F.array_join(lines, "\n")
    by_phrase = F.concat_ws("，", *(last_of(F.regexp_extract_all(text, F.lit(TRIPLET_PHRASE), k)) for k in (1, 2, 3)))
    return F.coalesce(F.when(line.isNotNull(), by_line), F.nullif(by_phrase, F.lit("")), F.lit(FAILED))


def split_triplet(x: Column) -> Column:
    """The three directions of a triplet line, null if it isn't one."""
    return F.when(strip_u(x).rlike(TRIPLET_LINE), F.array(*(found(strip_u(x), TRIPLET_LINE, k) for k in (1, 2, 3))))


def reference_label(x: Column) -> Column:
    return last_of(F.filter(lines_of(x), lambda s: s.rlike(SINGLE_LINE)))


def single_label(x: Column) -> Column:
    """The last line that is one direction, else the last match of the first phrase pattern that matches."""
    text = F.array_join(lines_of(x), "\n")
    return F.coalesce(reference_label(x), *(last_of(F.regexp_extract_all(text, F.lit(p), 1)) for p in SINGLE_PHRASES), F.lit(FAILED))


def last_line_float(x: Column) -> Column:
    """A number in the last line, a percent sign ignored; null if there is none."""
    line = last_of(lines_of(x))
    return F.nullif(F.regexp_extract(F.replace(line, F.lit("%"), F.lit("")), r"([-+]?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
