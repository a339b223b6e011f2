"""Annotation documents, conversation records and model answers: mapping, repair and conversion."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.operators.labels import ANOMALY

#: The type that each label is trained as, and that of any other.
TYPES = {
    "上行尖峰": "竖直尖峰",
    "下行尖峰": "竖直尖峰",
    "双向尖峰": "竖直尖峰",
    "点异常": "竖直尖峰",
    "阶跃": "阶跃突变",
    "突然漂移": "阶跃突变",
    "缓慢漂移": "模式变化",
    "模式突变": "模式变化",
    "异常平台": "异常平台",
}
OTHER_TYPE = "模式变化"
#: How a label is put into words for one row and for a range.
REASONS = {
    "上行尖峰": ("索引位置{start}处数据出现向上尖峰,数值急剧上升后迅速回落", "索引区间[{start},{end}]内数据出现向上尖峰,数值急剧上升后迅速回落"),
    "下行尖峰": ("索引位置{start}处数据出现向下尖峰,数值急剧下降后迅速回升", "索引区间[{start},{end}]内数据出现向下尖峰,数值急剧下降后迅速回升"),
    "双向尖峰": ("索引位置{start}处数据出现双向尖峰,数值先急剧变化后反向变化", "索引区间[{start},{end}]内数据出现双向尖峰,数值呈现剧烈震荡"),
    "阶跃上升": ("索引区间[{start},{end}]内数据发生阶跃上升,数值快速跃迁到更高水平",) * 2,
    "阶跃下降": ("索引区间[{start},{end}]内数据发生阶跃下降,数值快速跃迁到更低水平",) * 2,
    "突然漂移": ("索引区间[{start},{end}]内数据发生突然漂移,基线水平发生突变",) * 2,
    "缓慢漂移": ("索引区间[{start},{end}]内数据发生缓慢漂移,基线水平逐渐偏移",) * 2,
    "点异常": ("索引位置{start}处存在孤立异常点,与周围数据明显不符", "索引区间[{start},{end}]内存在多个孤立异常点"),
    "区间异常": ("索引区间[{start},{end}]内数据整体异常,与正常模式存在显著差异",) * 2,
    "震荡区间": ("索引区间[{start},{end}]内数据呈现异常震荡,波动幅度明显增大",) * 2,
    "上下文异常": ("索引区间[{start},{end}]内数据与前后上下文不一致,存在模式突变",) * 2,
}
OTHER_REASON = ("索引位置{start}处数据存在异常", "索引区间[{start},{end}]内数据存在异常")
#: Words for the attributes of a whole series, in their order.
ATTRIBUTES = {
    "frequency": {"high_freq": "高频", "low_freq": "低频"},
    "noise": {"noisy": "高噪声", "clean": "中等噪声", "almost_no_noise": "低噪声", "label_1766469170459": "无噪声"},
    "seasonal": {"has_periodic": "有周期性", "no_periodic": "无周期性", "label_1766475567943": "局部有周期性"},
    "trend": {"increase": "上升趋势", "decrease": "下降趋势", "stable": "趋势稳定", "multiple": "多段式趋势", "label_1766469189296": "无明显趋势"},
}
#: The label of no anomaly, its range and its reason; the label that is renamed, and where it stands in reasons.
NO_ANOMALY, WHOLE, NO_REASON = "无异常", (0, 4999), "该区间内无检测到异常"
SINGLE = "点异常"
RENAMED = [("点异常", "尖峰"), ("孤立异常点", "尖峰点")]
PLACEHOLDER = "<ts><ts/>"
#: Prompt parts by language: introduction, choice, answer mark.
PROMPTS = {
    "en": ("The following are multiple choice questions (with answers) about {subject}.\n\n", "\n{choice}. {content}", "\nAnswer:"),
    "zh": ("以下是中国关于{subject}考试的单项选择题，请选出其中的正确答案。\n\n", "\n{choice}. {content}", "\n答案："),
}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key)


def mapped_type(label: Column) -> Column:
    """The trained type of a label."""
    return F.coalesce(lookup(TYPES, label), F.lit(OTHER_TYPE))


def reason(label: Column, start: Column, end: Column) -> Column:
    """The label and its range in words."""
    one = F.coalesce(lookup({k: v[0] for k, v in REASONS.items()}, label), F.lit(OTHER_REASON[0]))
    many = F.coalesce(lookup({k: v[1] for k, v in REASONS.items()}, label), F.lit(OTHER_REASON[1]))
    return filled_template(F.when(start == end, one).otherwise(many), {"start": start, "end": end})


def filled_template(template: Column, values: dict[str, Column]) -> Column:
    """The template with {name} replaced by each value."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def attribute_text(attributes: Column) -> Column:
    """Words for a map of attributes, in fixed order, joined by a list comma; unknown ones are left out."""
    words = [lookup(table, F.try_element_at(attributes, F.lit(key))) for key, table in ATTRIBUTES.items()]
    return F.array_join(F.array_compact(F.array(*words)), "、")


def relabelled(anomalies: Column) -> Column:
    """The renamed label in the types and reasons of an anomaly list."""
    old, new = RENAMED[0]

    def words(text: Column) -> Column:
        for a, b in RENAMED:
            text = F.replace(text, F.lit(a), F.lit(b))
        return text

    return F.transform(anomalies, lambda a: F.struct(a["interval"].alias("interval"), F.when(a["type"] == old, new).otherwise(a["type"]).alias("type"), words(a["reason"]).alias("reason")))


def image_path(path: Column, folder: str) -> Column:
    """The picture of a record's point in another folder; a dataset prefix up to its underscore is dropped."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_replace(name, r"^.*?(gdsh_|zhlh_)", ""), F.lit(".jpg"))


def modified_anomalies(anomalies: Column) -> Column:
    """Anomalies with single-row marks widened by five rows and without those of no anomaly; where there was none of
    these, one over the whole range is added."""

    def widen(a: Column) -> Column:
        single = (a["type"] == SINGLE) & (a["interval"][0] == a["interval"][1])
        wide = F.array(F.greatest(F.lit(0), a["interval"][0] - 5), a["interval"][1] + 5)
        return F.struct(F.when(single, wide).otherwise(a["interval"]).alias("interval"), a["type"].alias("type"), a["reason"].alias("reason"))

    none = F.struct(F.array(*map(F.lit, WHOLE)).alias("interval"), F.lit(NO_ANOMALY).alias("type"), F.lit(NO_REASON).alias("reason"))
    real = F.transform(F.filter(anomalies, lambda a: a["type"] != NO_ANOMALY), widen)
    return F.when(F.exists(anomalies, lambda a: a["type"] == NO_ANOMALY), real).otherwise(F.concat(real, F.array(none))).cast(ANOMALY)


def repaired(df: DataFrame, prompt: str = "input", answer: str = "output", series: str = "timeseries") -> DataFrame:
    """Training rows made fit: the placeholder in front where it lacks, the answer as text, the series nested; rows
    without a series go."""
    text = F.coalesce(F.col(prompt), F.lit(""))
    out = df.where(F.size(F.coalesce(F.col(series), F.array().cast(df.schema[series].dataType))) > 0)
    out = out.withColumn(prompt, F.when(F.contains(text, F.lit(PLACEHOLDER)), text).otherwise(F.concat(F.lit(PLACEHOLDER + "\n"), text)))
    if df.schema[answer].dataType.typeName() != "string":
        out = out.withColumn(answer, F.to_json(answer))
    if df.schema[series].dataType.elementType.typeName() != "array":
        out = out.withColumn(series, F.array(series))
    return out


def model_intervals(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a row for each anomaly in the `anomalies = [...]` of a model's answer: start, end, label, and `outcome`,
    which is complete, truncated (what is whole is taken), empty or missing. Objects hold no braces of their own."""
    body = F.regexp_extract(F.coalesce(F.col(text), F.lit("")), r"(?s)anomalies\s*=\s*\[(.*)", 1)
    objects = F.regexp_extract_all("_body", F.lit(r"(\{[^{}]*\})"))
    found = F.transform(objects, lambda o: F.from_json(o, "range array<long>, label string"))
    there = F.rlike(F.coalesce(F.col(text), F.lit("")), F.lit(r"anomalies\s*=\s*\["))
    outcome = F.when(~there, "missing").when(F.size("_found") == 0, "empty").when(F.rlike("_body", F.lit(r"\}\s*,?\s*\]")), "complete").otherwise("truncated")
    out = df.withColumn("_body", body).withColumn("_found", F.filter(found, lambda a: F.size(a["range"]) == 2)).withColumn("outcome", outcome)
    out = out.withColumn("_a", F.explode_outer("_found"))
    return out.select(*df.columns, "outcome", F.col("_a")["range"][0].alias("start"), F.col("_a")["range"][1].alias("end"), F.col("_a")["label"].alias("label"))


def without_id(annotations: Column, id_: Column) -> Column:
    return F.filter(annotations, lambda a: a["id"] != id_)


def with_label(labels: Column, label: Column) -> Column:
    """The label at the end of a list unless it is there."""
    return F.when(F.exists(labels, lambda x: x == label), labels).otherwise(F.array_append(labels, label))


def new_layout(df: DataFrame, stamp: Column) -> DataFrame:
    """filename, overall_attribute, annotations and export_time of documents of either layout."""
    old = F.col("filename").isNull()
    return df.select(
        "record",
        F.coalesce("filename", "record").alias("filename"),
        F.when(old, F.col("overall_attributes")).otherwise(F.col("overall_attribute")).alias("overall_attribute"),
        "annotations",
        F.coalesce("export_time", stamp).alias("export_time"),
    )


def choice_question(question: Column, choices: dict[str, Column], lang: str = "en") -> Column:
    _, choice, answer = PROMPTS[lang]
    parts = [filled_template(F.lit(choice), {"choice": F.lit(k), "content": v}) for k, v in choices.items()]
    return F.concat(question, *parts, F.lit(answer))


def few_shot_prompt(items: DataFrame, subject: str, order: str, shots: int, lang: str = "en") -> DataFrame:
    """items (subject, order, question, answer) with `prompt`: the introduction, the first `shots` questions of the
    subject with their answers, and the row's own question. The support rows themselves get none."""
    ranked = items.withColumn("_k", F.row_number().over(W.partitionBy(subject).orderBy(order)))
    support = ranked.where(F.col("_k") <= shots).groupBy(subject).agg(F.array_sort(F.collect_list(F.struct("_k", "question", "answer"))).alias("_s"))
    shown = F.array_join(F.transform("_s", lambda s: F.concat(s["question"], s["answer"])), "")
    intro = filled_template(F.lit(PROMPTS[lang][0]), {"subject": F.col(subject)})
    return ranked.where(F.col("_k") > shots).join(support, subject).select(*items.columns, F.concat(intro, shown, "question").alias("prompt"))


def output_name(length: Column, n: Column, source: Column, split: bool, day: Column) -> Column:
    """Descriptive name of a training file."""
    parts = F.concat_ws("_", F.lit("chatts_tune"), length, F.concat(F.lit("n"), n), source, F.lit("split" if split else "nosplit"), F.date_format(day, "yyyyMMdd"))
    return F.concat(parts, F.lit(".jsonl"))


def training_set(series: DataFrame, segments: DataFrame, label: str, question: str) -> tuple[DataFrame, DataFrame]:
    """(samples, rejects): a sample for each point with segments: input, output and its series as one array; a reject for
    each point of segments without rows."""
    answer = F.transform(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos"))), lambda s: F.to_json(F.struct(F.lit("success").alias("status"), F.array(F.struct(F.array(s["start_pos"], s["end_pos"]).alias("interval"), F.lit(label).alias("type"))).alias("detected_anomalies"))))
    answers = segments.groupBy("point").agg(F.array_join(answer, ",").alias("output"), F.count("*").alias("n_anomalies"))
    values = series.groupBy("point").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("timeseries"))
    both = answers.join(values, "point", "left")
    samples = repaired(both.where("timeseries is not null").withColumn("input", F.lit(question)))
    return samples, both.where("timeseries is null").select("point", F.lit("no series").alias("reason"))
