"""Prompt rendering from template and example tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

DEFAULT_TEMPLATE = "alpaca"
_ALPACA = "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n"

# FIXED VALUES: prompt wording the models were trained with.
# id, system, before query, after query, before response, response start, delimiter
TEMPLATES = (
    ("qa", "", "User:\n", "\n\n", "Assistant:\n", "", "\n\n"),
    ("alpaca", _ALPACA, "### Instruction:\n", "\n\n", "### Response:\n", "", "\n\n"),
    ("wizardmath-cot", _ALPACA, "### Instruction:\n", "\n\n", "### Response: ", "Let's think step by step.", "\n\n"),
    (
        "deepseekmath", "", "User: ",
        "\nPlease reason step by step, and put your final answer within \\boxed{}.\n\n",
        "Assistant: ", "", "<｜end▁of▁sentence｜>",
    ),
    (
        "deepseekmath-tool", "", "User: ",
        "\nPlease integrate natural language reasoning with programs to solve the problem above, "
        "and put your final answer within \\boxed{}.\n\n",
        "Assistant: ", "", "<｜end▁of▁sentence｜>",
    ),
    (
        "xwinmath",
        "A chat between a curious user and an artificial intelligence assistant. The assistant "
        "gives helpful, detailed, and polite answers to the user's questions. ",
        "USER: ",
        " Give your solution in detail. In the end, write your final answer in the format of "
        "'The answer is: <ANSWER>.'.  ",
        "ASSISTANT: ", "", "\n\n",
    ),
    (
        "mammoth2-cot", "You are supposed to provide a solution to a given problem.\n\n\n",
        "Problem:\n", "\n", "Solution: ", "Let's think step by step.\n", "\n\n",
    ),
    (
        "llama3-math",
        "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n"
        "You are a helpful agent on solving math problems.<|eot_id|>",
        "<|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|>",
        "<|start_header_id|>assistant<|end_header_id|>\n\n", "", "<|eot_id|>\n",
    ),
)

# FIXED VALUES: model names that decide template and number of examples.
BASE_MODELS = (
    "deepseek-ai--deepseek-math-7b-base", "mistralai--Mistral-7B-v0.1",
    "meta-llama--Llama-2-7b-hf", "meta-llama--Llama-2-13b-hf", "meta-llama--Llama-2-70b-hf",
    "meta-llama--Meta-Llama-3-8B", "meta-llama--Meta-Llama-3-70B",
    "meta-llama--Meta-Llama-3.1-8B", "meta-llama--Meta-Llama-3.1-70B",
    "EleutherAI--llemma_7b", "EleutherAI--llemma_34b", "QWen--QWen-1.5-72B",
)
STEP_REWARD_MODELS = ("peiyi9979/mistral-7b-sft", "peiyi9979/math-shepherd-mistral-7b-rl")
INSTRUCT_MODELS = ("deepseek-ai/deepseek-math-7b-instruct", "deepseek-ai/deepseek-math-7b-rl")
CHAT_MODELS = (
    "meta-llama--Meta-Llama-3-8B-Instruct", "meta-llama--Meta-Llama-3-70B-Instruct",
    "meta-llama--Meta-Llama-3.1-8B-Instruct", "meta-llama--Meta-Llama-3.1-70B-Instruct",
)
ANSWER_REQUEST = 'Please solve the following problem and put your answer at the end with "The answer is: ". '
DEFAULT_SHOTS = {
    "math/test": 4, "math": 4, "gsm8k/test": 4, "gsm8k": 4, "mwpbench/college-math/test": 4,
    "college-math": 4, "college_math": 4, "deepmind": 4, "deepmind-mathematics": 8,
    "olympiadbench/OE_TO_maths_en_COMP": 4, "olympiad-OE_TO_maths_en_COMP": 4,
    "olympiad_OE_TO_maths_en_COMP": 4, "theoremqa": 5,
}


def template_table(spark: SparkSession, extra: list[tuple] | None = None) -> DataFrame:
    """Built-in templates plus rows of one's own."""
    return spark.createDataFrame([*TEMPLATES, *(extra or [])], schemas.TEMPLATE)


def read_templates(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Templates from JSON files of one object each; add them to ``template_table``.

    The id is the path as given, so a row may name its template by id or by path. A text
    that a file leaves out is that of the default template.
    """
    default = dict(zip(schemas.TEMPLATE_TEXTS, next(t for t in TEMPLATES if t[0] == DEFAULT_TEMPLATE)[1:], strict=True))
    texts = [F.coalesce(F.col(name), F.lit(default[name])).alias(name) for name in schemas.TEMPLATE_TEXTS]
    schema = ", ".join(f"{name} string" for name in schemas.TEMPLATE_TEXTS)
    out = template_table(spark).limit(0)
    for path in paths:
        read = spark.read.schema(schema).option("multiLine", True).json(path)
        out = out.unionByName(read.select(F.lit(path).alias("id"), *texts))
    return out


def shots_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_SHOTS.items()), "dataset string, default_shots int")


def template_id(prompt_type: Column, agent: Column) -> Column:
    """Template for a model; NULL for a tool model nobody knows."""
    chain = (
        F.when(agent.isin(*BASE_MODELS, *STEP_REWARD_MODELS), F.lit("qa"))
        .when(agent.isin(*INSTRUCT_MODELS), F.lit("deepseekmath"))
        .when(agent.startswith("Xwin-LM/Xwin-Math"), F.lit("xwinmath"))
        .when(agent.startswith("TIGER-Lab--MAmmoTH2"), F.lit("mammoth2-cot"))
        .when(agent.isin(*CHAT_MODELS), F.lit("llama3-math"))
        .otherwise(F.lit(DEFAULT_TEMPLATE))
    )
    tool = F.when(agent.isin(*INSTRUCT_MODELS), F.lit("deepseekmath-tool"))
    return F.when(prompt_type == "cot", chain).when(prompt_type == "tool", tool)


def choose_template(df: DataFrame, prompt_type: str | Column = "cot") -> DataFrame:
    """Add ``prompt_template`` and ``response_start`` (an override, else NULL) per row.

    A tool prompt for a model without one is an error.
    """
    kind = F.lit(prompt_type) if isinstance(prompt_type, str) else prompt_type
    agent = F.col("agent")
    message = F.concat(F.lit("no tool template for the model "), F.coalesce(agent, F.lit("NULL")))
    chosen = template_id(kind, agent)
    unknown = (kind == "tool") & chosen.isNull()
    return df.withColumns(
        {
            "prompt_template": F.when(unknown, F.raise_error(message).cast("string")).otherwise(chosen),
            "response_start": F.when(agent.contains("MMIQC"), F.lit(ANSWER_REQUEST)),
        }
    )


def example_count(n_shots: Column, agent: Column, default_shots: Column) -> Column:
    """Number of examples: given, or by model and dataset when negative or NULL."""
    adaptive = F.when(
        agent.isin(*BASE_MODELS) | F.lower(agent).contains("mammoth2"), default_shots
    ).otherwise(0)
    return F.when(n_shots >= 0, n_shots).otherwise(adaptive)


def examples_for(df: DataFrame, examples: DataFrame, shots: DataFrame) -> DataFrame:
    """Add ``examples``: the first n of the row's dataset; NULL where n asks for missing ones.

    ``examples`` has one row (dataset, examples ARRAY<STRUCT<q, a>>) per dataset.
    """
    listed = examples.withColumnRenamed("examples", "_all")
    joined = df.join(shots, "dataset", "left").join(listed, "dataset", "left")
    n = example_count(F.col("n_shots"), F.col("agent"), F.col("default_shots"))
    none = F.array().cast("array<struct<q:string,a:string>>")
    chosen = F.when(F.col("_n") == 0, none).otherwise(F.slice("_all", F.lit(1), F.col("_n")))
    return joined.withColumn("_n", n).withColumn("examples", chosen).drop("_n", "_all", "default_shots")


def qa_pair(query: Column, answer: Column) -> Column:
    return F.concat("query_prompt", query, "prompt_after_query", "resp_prompt", "prompt_before_resp", answer)


def prefix(query: Column) -> Column:
    """Query part of a prompt; blanks at its end go, line ends stay."""
    return F.rtrim(qa_pair(query, F.lit("")))


def render(df: DataFrame, templates: DataFrame, target: str = "prompt") -> DataFrame:
    """Add the full prompt: system text, examples, query.

    Unknown templates become the default one and are marked in ``defaulted``. The template
    table is a few rows, so it is broadcast.
    """
    known = F.broadcast(templates.select(F.col("id").alias("_known")))
    marked = df.join(known, F.col("prompt_template") == F.col("_known"), "left")
    used = F.coalesce(F.col("_known"), F.lit(DEFAULT_TEMPLATE))
    marked = marked.withColumns({"_used": used, "defaulted": F.col("_known").isNull()})
    joined = marked.join(F.broadcast(templates.withColumnRenamed("id", "_id")), F.col("_used") == F.col("_id"))
    if "response_start" in df.columns:
        start = F.coalesce(F.col("response_start"), F.col("prompt_before_resp"))
        joined = joined.withColumn("prompt_before_resp", start)
    query = prefix(F.col("query"))
    if "examples" in df.columns:
        shown = F.aggregate(
            "examples", F.lit(""), lambda acc, e: F.concat(acc, qa_pair(e["q"], e["a"]), "delim")
        )
        query = F.concat(shown, query)
    prompt = F.concat("sys_prompt", query)
    return joined.withColumn(target, prompt).select(*df.columns, target, "defaulted")


# FIXED VALUES: wording of Olympiad problems.
ANSWER_TYPES = (
    ("Numerical", "a numerical value", "数值"),
    ("Expression", "an expression", "表达式"),
    ("Equation", "an equation", "方程"),
    ("Interval", "an interval", "区间"),
)
OLYMPIAD_EN = {
    "proof": "The following is a theorem proving problem from an International {subject} competition. Please use logical reasoning and common theorems to prove the proposition in the problem according to the given requirements. Please use LaTeX format to represent the variables and formulas used in the proof.",
    "head": "The following is an open-ended problem from an International {subject} competition. ",
    "single": "The answer of The problem should be {type}. ",
    "same": "The problem has multiple answers, each of them should be {type}. ",
    "mixed": "The problem has multiple answers, with the answers in order being {type}. ",
    "task": "Please calculate the answer according to the given requirements and the information provided. Please use LaTeX format to represent the variables and formulas used in the solution process and results. Please end your solution with \"So the final answer is {box}.\" and give the result explicitly{unit}.",
    "box": "\\boxed{answer}", "boxes": "\\boxed{multiple answers connected with commas}",
    "unit_mark": "(unit)",
    "unit": ", note that the unit of the answer should not be included in \\boxed{}",
    "comma": ", ",
}
OLYMPIAD_ZH = {
    "proof": "以下是中国{subject}竞赛中的证明题。请根据题目的要求，运用逻辑推理及常用定理证明题目中的命题。证明过程中使用的变量和公式请使用LaTeX格式表示。",
    "head": "以下是中国{subject}竞赛中的解答题",
    "single": "，答案类型为{type}",
    "same": "，题目有多个答案，答案类型均为{type}",
    "mixed": "，题目有多个答案，答案类型分别为{type}",
    "task": "。请根据题目的要求和所提供的信息计算得出答案。解答过程和结果中使用的变量和公式请使用LaTeX格式表示。请在最后以“所以最终答案是{box}。”显式给出结果{unit}。",
    "box": "\\boxed{答案}", "boxes": "\\boxed{用英文逗号连接的多个答案}",
    "unit_mark": "(单位)", "unit": "，注意答案的单位不要放在\\boxed{}中", "comma": "、",
}


def _filled(text: str, **slots: Column) -> Column:
    """``text`` with its ``{slot}`` replaced by columns."""
    out = F.lit(text)
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def olympiad_query(df: DataFrame, subset: str, target: str = "query") -> DataFrame:
    """Add the problem text of an Olympiad subset; NULL for an unknown answer type.

    The subset name says whether it holds proofs (``TP``), mathematics (``maths``) and
    Chinese (``zh``).
    """
    chinese, maths, proof = "zh" in subset, "maths" in subset, "TP" in subset
    words = OLYMPIAD_ZH if chinese else OLYMPIAD_EN
    subject = F.lit(("数学" if maths else "物理") if chinese else ("Math" if maths else "Physics"))

    def type_text(kind: Column) -> Column:
        name = F.substring_index(kind, "-", 1)
        chain = None
        for key, english, han in ANSWER_TYPES:
            text = F.lit(han if chinese else english)
            chain = F.when(name.contains(key), text) if chain is None else chain.when(name.contains(key), text)
        return chain

    if proof:
        prompt = _filled(words["proof"], subject=subject)
    else:
        many, kinds = F.col("is_multiple_answer"), F.col("answer_type")
        each = F.transform(F.split(kinds, ","), type_text)
        unknown = F.exists(each, lambda t: t.isNull())
        several = F.when(
            F.size(F.array_distinct(each)) == 1, _filled(words["same"], type=each[0])
        ).otherwise(_filled(words["mixed"], type=F.array_join(each, words["comma"])))
        wording = (
            F.when(kinds.contains("Need_human_evaluate") | kinds.contains("Tuple"), F.lit(""))
            .when(~many, _filled(words["single"], type=type_text(kinds)))
            .when(unknown, F.lit(None))
            .otherwise(several)
        )
        has_unit = F.coalesce(F.col("unit"), F.lit("")) != ""
        box = F.concat(
            F.when(many, words["boxes"]).otherwise(words["box"]),
            F.when(has_unit, words["unit_mark"]).otherwise(""),
        )
        unit = F.when(has_unit, words["unit"]).otherwise("")
        prompt = F.concat(
            _filled(words["head"], subject=subject), wording, _filled(words["task"], box=box, unit=unit)
        )
    parts = [prompt]
    if not maths and "context" in df.columns:
        parts.append(F.col("context"))
    return df.withColumn(target, _joined([*parts, F.col("question")]))


def _joined(parts: list[Column]) -> Column:
    """Lines joined; NULL when one is NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = F.concat(out, F.lit("\n"), part)
    return out
