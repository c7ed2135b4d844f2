"""What leaves as a file: calibrated words as tab-separated text, and the rows of a workbook's two sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of the text with the decimals of each, labels of a sheet's columns with their fields, names of the sheets.
DECIMALS = {"probability_known": 6, "frequency_prior_probability": 6, "zipf": 3, "cefr_adjustment": 2, "exam_adjustment": 2, "education_adjustment": 2, "selected_threshold": 2}
FIELDS = (
    "lemma", "part_of_speech", "probability_known", "classification", "total_count", "document_count", "zipf", "frequency_prior_probability", "cefr_level", "cefr_adjustment",
    "exam_tags", "exam_adjustment", "education_adjustment", "direct_response", "importance_tier", "important_boundary_protected", "selected_threshold",
)
LABELS = {
    "词": "display_form", "词性": "part_of_speech", "领域英文释义": "meaning_en", "领域中文释义": "meaning_zh", "论文原句": "context", "论文标题": "source_title", "论文链接": "source_url", "论文标识": "source_paper_id",
    "收录状态": "inclusion", "优先级": "importance_tier", "预测掌握度": "probability_known", "30 词回答": "direct_response", "覆盖论文数": "document_count", "出现次数": "total_count", "本次阈值": "selected_threshold",
}
SELECTED, OTHER = "个人词表", "其他候选"
INCLUSION = {"known": "暂不加入", "protected": "重要词保护后加入", "suggested": "建议加入"}
NOT_ASKED = "未抽到"


def calibration_text(rows: DataFrame) -> DataFrame:
    """Calibrated rows as the strings that a file of them holds; null is empty, tags are joined, flags are lower case."""
    kinds = dict(rows.dtypes)

    def shown(name: str) -> Column:
        if name not in kinds:
            return F.lit("").alias(name)
        c = F.col(name)
        if name == "exam_tags":
            out = F.array_join(c, " ")
        elif name in DECIMALS:
            out = F.format_string(f"%.{DECIMALS[name]}f", c.cast("double"))
            out = F.when(c.isNotNull(), out)
        else:
            out = c.cast("string")
        return F.coalesce(out, F.lit("")).alias(name)

    return rows.select(*[shown(f) for f in FIELDS])


def worksheet_text(c: Column) -> Column:
    """A text as a sheet can hold it: control characters but tab and line ends as _xHHHH_."""
    codes = [i for i in range(32) if i not in (9, 10, 13)]
    return reduce(lambda x, i: F.replace(x, F.lit(chr(i)), F.lit(f"_x{i:04X}_")), codes, c)


def cell(c: Column) -> Column:
    """A cell's text: trimmed, null as empty; plain numbers without needless zeros."""
    plain = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    number = F.regexp_replace(F.regexp_replace(plain, r"^\+", ""), r"\.0+$", "")
    return F.when(plain.rlike(r"^[+-]?\d+(?:\.\d*)?$"), number).otherwise(worksheet_text(plain))


def inclusion(classification: Column, protected: Column) -> Column:
    return F.when(classification == "likely_known", INCLUSION["known"]).when(F.coalesce(protected, F.lit(False)), INCLUSION["protected"]).otherwise(INCLUSION["suggested"])


def sheets(rows: DataFrame) -> DataFrame:
    """Export rows (with their card's fields) as labelled cells, and the sheet each belongs to."""
    kinds = dict(rows.dtypes)
    own = rows.withColumn("inclusion", inclusion(F.col("classification"), F.col("important_boundary_protected")))
    answer = F.nullif(F.trim(F.coalesce("direct_response", F.lit(""))), F.lit("")) if "direct_response" in kinds else F.lit(None).cast("string")
    own = own.withColumn("direct_response", F.coalesce(answer, F.lit(NOT_ASKED)))
    for name, places in (("probability_known", 1), ("selected_threshold", 0)):
        percent = F.floor(F.col(name) * 100 * 10**places + 0.5) / 10**places
        own = own.withColumn(name, F.when(F.col(name).isNotNull(), F.concat(F.format_string(f"%.{places}f", percent.cast("double")), F.lit("%"))).otherwise(""))
    sheet = F.when(F.col("classification") == "likely_known", OTHER).otherwise(SELECTED)
    return own.select(sheet.alias("sheet"), *[(cell(F.col(f)) if f in own.columns else F.lit("")).alias(label) for label, f in LABELS.items()])
