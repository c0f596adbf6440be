"""Prompts and messages, rendered with column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as S

# The texts below are part of the datasets' format.
FIELD_NOTE = "其中，open 表示开盘价，high 表示最高价，low 表示最低价，close 表示收盘价，volume 表示成交量，amplitude 表示振幅，pct_change 表示涨跌幅，turnover 表示换手率。"
WEEK_HEADER = "过去7个交易日的K线数据如下(归一化后)："
RULES = "【输出要求（必须严格遵守）】"
THINK_BEGIN, THINK_END = "【思维链开始】", "【思维链结束】"
THINK_HERE = f"{THINK_BEGIN}\n（在此撰写推理过程）\n{THINK_END}"
NEXT_DAY_TAIL = "请根据上文 Day1–Day7 的归一化 K 线，只预测下一个交易日（Day8）相对前一日是涨还是跌。\n\n" + RULES + "\n只输出一个字：「涨」或「跌」，不要输出其他任何文字、数字、标点或换行。"
NEXT_DAY_THINK_TAIL = (
    "请根据上文 Day1–Day7 的归一化 K 线，预测下一个交易日（Day8）相对前一日是涨还是跌。\n\n" + RULES + "\n请先分析 K 线趋势、量能与波动；将推理过程写在下面一对标记之间（只写推理过程）：\n" + THINK_HERE + "\n\n思维链结束后，请单独一行输出最终答案，仅一个字：「涨」或「跌」，不要引号、标点或其他文字。"
)
HORIZONS_TAIL = (
    "请根据上文 Day1–Day7 的归一化 K 线，预测未来 1 个、3 个、7 个交易日相对 Day7 收盘价是涨还是跌。\n\n" + RULES + "\n1. 先在“【思维链开始】”与“【思维链结束】”之间给出简短分析。\n2. 然后严格按照下面三行格式输出最终结论：\n"
    "未来1个交易日：涨/跌\n未来3个交易日：涨/跌\n未来7个交易日：涨/跌\n3. 最终结论只能使用“涨”或“跌”，不要输出其他同义词。"
)
SAMPLE_HEADER = "下面是一条股票日度样本，请根据该股票在目标日期当天可见的信息，预测下一个交易日相对当天是涨还是跌。\n\n你会看到：\n1. 该股票在目标日期及之前连续5个交易日的归一化K线"
SAMPLE_TEXT_ITEMS = "；\n2. 截止目标日期最近的news摘要；\n3. 截止目标日期最近的report摘要"
SAMPLE_TAIL = (
    "分别预测该股票相对当前交易日收盘价在以下三个阶段的涨跌：\n1. 1个交易日后\n2. 3个交易日后\n3. 7个交易日后\n\n" + RULES + "\n请先分析，再将推理过程写在下面一对标记之间（只写推理过程）：\n" + THINK_HERE + "\n\n思维链结束后，请单独一行按顺序输出三个阶段的答案，格式必须严格为：\n涨，涨，跌\n\n"
    "三个位置分别对应：1个交易日后、3个交易日后、7个交易日后。只输出这一行，不要输出其他文字。"
)
TRAINING_TAIL = (
    "请结合上面的 K 线、新闻摘要和研报摘要，预测未来 1 个交易日、3 个交易日和 7 个交易日的涨跌方向。\n\n" + RULES + "\n请先分析 K 线趋势、量能、波动与文本信息；将推理过程写在下面一对标记之间（只写推理过程）：\n" + THINK_HERE + "\n\n思维链结束后，请严格按下面三行输出最终答案：\n"
    "未来1个交易日：涨或跌\n未来3个交易日：涨或跌\n未来7个交易日：涨或跌\n\n注意：每一行最终答案只能写单个字“涨”或“跌”，不要输出其他词。"
)
KNOWN_ANSWER_HEAD = "下面是一道「根据过去7个交易日归一化K线，预测下一交易日涨跌方向」的数据集样本。\n\n【本题在数据集中的标准答案(第八个交易日相对第七个交易日涨跌方向)】\n"
KNOWN_ANSWER_TASK = "\n\n【原任务说明与K线特征（与训练数据中的 prompt 字段一致）】\n"
KNOWN_ANSWER_TAIL = (
    "\n\n请你**在已经知道标准答案的前提下**，用中文写出一段**合理、简洁**的思维链：说明如何从上述K线信息（趋势、量能、波动等）出发，能够**自然推出**该涨跌方向。\n\n思维链必须写在下面一对标记之间（只写推理过程)：\n" + THINK_HERE + "\n\n思维链结束后，请**单独一行**输出最终答案，且必须与标准答案**完全一致**，仅一个字：「涨」或「跌」，不要引号、标点或其他文字。"
)
SUMMARY_TASK = "全文，请你用中文总结其主要观点。\n\n要求：\n1. 总结要准确、简洁，不要编造。\n2. 突出核心事实、主要结论、相关影响。\n3. 保留时间信息，如果原文里有明确日期/时间，请在总结中体现。\n4. 只输出总结正文，不要加前缀说明，不要输出 JSON。\n\n"
ITEM_LIMITS = {"news": 1200, "reports": 1600, "serp": 1500}


def day_text() -> Column:
    """A normalised day of a row with n_* columns and amplitude, as it follows its number."""
    parts = [F.concat(F.lit(f"{f}="), S.fmt4(F.col(f"n_{f}"))) for f in ("open", "high", "low", "close", "volume")]
    parts += [F.concat(F.lit("amplitude="), S.fmt_amplitude(F.col("amplitude"))), F.concat(F.lit("pct_change="), S.fmt_signed4(F.col("n_pct_change"))), F.concat(F.lit("turnover="), S.fmt4(F.col("n_turnover")))]
    return F.concat_ws(", ", *parts)


def week_prompt(days: Column, kind: str = "train") -> Column:
    """Prompt over seven days' texts (see ``day_text``); kind is train, eval or horizons."""
    header = WEEK_HEADER if kind == "train" else f"{WEEK_HEADER}\n{FIELD_NOTE}"
    tail = {"train": NEXT_DAY_TAIL, "eval": NEXT_DAY_THINK_TAIL, "horizons": HORIZONS_TAIL}[kind]
    lines = F.array_join(F.transform(days, lambda day, i: F.concat(F.lit("Day"), (i + 1).cast("string"), F.lit(": "), day)), "\n")
    return F.concat_ws("\n", F.lit(header), lines, F.lit(""), F.lit(tail))


def shown(x: Column, missing: str) -> Column:
    return F.coalesce(x.cast("string"), F.lit(missing))


def sample_days(bars: Column, style: str = "eval") -> Column:
    """Lines of five normalised days, in the evaluator's or the trainer's style."""
    missing = "N/A" if style == "eval" else ""

    def line(bar: Column, i: Column) -> Column:
        day = F.coalesce(bar["trade_date"].cast("string"), F.lit(""))
        head = F.concat(F.lit("Day"), (i + 1).cast("string"), *([F.lit(" ("), day, F.lit("): ")] if style == "eval" else [F.lit(": trade_date="), day, F.lit(", ")]))
        rest = [F.concat(F.lit(f"{f}="), shown(bar[f], missing)) for f in ("open", "high", "low", "close", "volume", "amplitude", "pct_change", "turnover")]
        return F.concat(head, F.concat_ws(", ", *rest))

    return F.array_join(F.transform(bars, line), "\n")


def listed(items: Column, label: str) -> Column:
    """A labelled list of dated summaries."""
    def line(x: Column, i: Column) -> Column:
        return F.concat((i + 1).cast("string"), F.lit(". date="), shown(x["date"], ""), F.lit("\n   title="), shown(x["title"], ""), F.lit("\n   summary="), shown(x["summary"], ""))

    return F.when(F.size(items) == 0, F.lit(f"{label}：无")).otherwise(F.concat(F.lit(f"{label}：\n"), F.array_join(F.transform(items, line), "\n")))


def blocks(items: Column) -> Column:
    """Blocks of summaries; blank ones are left out but keep their number."""
    def block(x: Column, i: Column) -> Column:
        text = S.strip_u(shown(x["summary"], ""))
        return F.when(text != "", F.concat((i + 1).cast("string"), F.lit(". 日期="), S.strip_u(shown(x["date"], "")), F.lit("\n标题="), S.strip_u(shown(x["title"], "")), F.lit("\n"), text))

    return F.coalesce(F.nullif(F.array_join(F.filter(F.transform(items, block), lambda b: b.isNotNull()), "\n\n"), F.lit("")), F.lit("无"))


def sample_prompt(day: Column, stock: Column, bars: Column, news: Column, reports: Column, with_text: bool = True) -> Column:
    """The evaluator's prompt of a daily sample."""
    head = SAMPLE_HEADER + (SAMPLE_TEXT_ITEMS if with_text else "") + "。\n\n" + FIELD_NOTE
    parts = [F.lit(head), F.lit(""), F.concat(F.lit("目标日期："), day.cast("string")), F.concat(F.lit("股票代码："), stock), F.lit(""), F.lit("过去5个交易日的归一化K线："), sample_days(bars), F.lit("")]
    if with_text:
        parts += [listed(news, "截止该日最近的news摘要"), F.lit(""), listed(reports, "截止该日最近的report摘要"), F.lit(""), F.lit("请综合K线形态、量能变化、news摘要和report摘要，" + SAMPLE_TAIL)]
    else:
        parts.append(F.lit("请综合K线形态、量能变化与短期走势，" + SAMPLE_TAIL))
    return F.concat_ws("\n", *parts)


def training_prompt(day: Column, stock: Column, bars: Column, news: Column, reports: Column) -> Column:
    """The trainer's prompt of a daily sample."""
    return F.concat(
        F.lit("分析日期："), S.strip_u(day.cast("string")), F.lit("\n股票代码："), S.strip_u(stock), F.lit(f"\n\n过去5个交易日的归一化K线数据如下：\n{FIELD_NOTE}\n"), sample_days(bars, "train"),
        F.lit("\n\n近期新闻摘要如下：\n"), blocks(news), F.lit("\n\n近期研报摘要如下：\n"), blocks(reports), F.lit("\n\n" + TRAINING_TAIL),
    )


def known_answer_message(prompt: Column, gold: Column) -> Column:
    """Asks for the reasoning to a known answer."""
    return F.concat(F.lit(KNOWN_ANSWER_HEAD), gold, F.lit(KNOWN_ANSWER_TASK), S.strip_u(prompt), F.lit(KNOWN_ANSWER_TAIL))


def think_prompt(prompt: Column) -> Column:
    """A next-day prompt whose short tail (its first occurrence) asks for reasoning instead; appended if there is none."""
    text = S.strip_u(F.replace(prompt, F.lit("\r\n"), F.lit("\n")))
    at = F.instr(text, NEXT_DAY_TAIL)
    swapped = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(NEXT_DAY_THINK_TAIL), F.substring(text, at + len(NEXT_DAY_TAIL), F.char_length(text)))
    return F.when(at > 0, swapped).otherwise(F.concat(text, F.lit("\n\n" + NEXT_DAY_THINK_TAIL)))


def summary_message(path: Column, day: Column, title: Column, body: Column) -> Column:
    return F.concat(F.lit("下面是一篇"), S.content_kind(path), F.lit(SUMMARY_TASK + "原文日期："), shown(day, ""), F.lit("\n原文标题："), shown(title, ""), F.lit("\n原文如下：\n"), body)


def summary_body(day: Column, title: Column, summary: Column) -> Column:
    """Text of a summary file below its header."""
    dated, titled = F.when(day != "", F.concat(F.lit("时间："), day)), F.when(title != "", F.concat(F.lit("标题："), title))
    return F.concat(S.strip_u(F.concat_ws("\n", dated, titled, F.lit("主要观点："), S.strip_u(summary))), F.lit("\n"))


def section_items(items: Column, section: str) -> Column:
    """The numbered list of a section's items for a summary request."""
    if section == "comments":
        line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". 时间="), shown(x["publish_time"], ""), F.lit(" 点击="), shown(x["click_count"], "0"), F.lit(" 评论="), shown(x["comment_count"], "0"), F.lit(" 标题="), shown(x["title"], ""))
    elif section in ITEM_LIMITS:
        source = (lambda x: [F.lit("来源="), shown(x["source"], ""), F.lit(" ")]) if section == "serp" else (lambda x: [])
        line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), *source(x), F.lit("日期="), shown(x["date"], ""), F.lit("\n标题="), shown(x["title"], ""), F.lit("\n正文="), S.ellipsis(x["content"], ITEM_LIMITS[section]), F.lit("\n"))
    else:
        raise ValueError(f"unknown section {section!r}")
    return F.array_join(F.transform(items, line), "\n")


def live_days(bars: Column) -> Column:
    line = lambda x, i: F.concat((i + 1).cast("string"), *(F.concat(F.lit(("" if k else ". ") + (" " if k else "") + label), shown(x[f], "")) for k, (label, f) in enumerate((("日期=", "trade_date"), ("开=", "open"), ("收=", "close"), ("高=", "high"), ("低=", "low"), ("涨跌额=", "change_amount"), ("涨跌幅=", "pct_change"), ("成交量=", "volume"), ("成交额=", "amount")))))
    return F.when(F.size(bars) == 0, F.lit("无可用 K 线数据。")).otherwise(F.array_join(F.transform(bars, line), "\n"))
