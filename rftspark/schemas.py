"""Explicit schemas; nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


QUERY = _struct(
    dataset=_S, query=_S, ref_ans=_S, ref_num=_D, prompt_template=_S, n_shots=_I,
    n_trials=_L, n_corrects=_L, max_n_trials=_I, min_n_corrects=_I,
    level=_I, domain=_S, n_step=_I, source=_S, abs_tol=_D, id=_S,
    extras=T.MapType(_S, _S),
)

RESPONSE = T.StructType(
    [f for f in QUERY.fields if f.name != "extras"]
    + _struct(
        finish_reason=_S, stop_reason=_S, cumulative_logprob=T.ArrayType(_D),
        ans=_S, correct=_B, agent=_S, resp=_S, extras=T.MapType(_S, _S),
    ).fields
)

TEMPLATE_TEXTS = ("sys_prompt", "query_prompt", "prompt_after_query", "resp_prompt", "prompt_before_resp", "delim")
TEMPLATE = _struct(id=_S, **{name: _S for name in TEMPLATE_TEXTS})
EXAMPLES = _struct(dataset=_S, examples=T.ArrayType(_struct(q=_S, a=_S)))

TOKENIZED = _struct(
    id=_S, input_ids=T.ArrayType(_I), labels=T.ArrayType(_I), attention_mask=T.ArrayType(_I)
)

_MESSAGE = _struct(role=_S, content=_S)
REQUEST = _struct(
    custom_id=_S, method=_S, url=_S,
    body=_struct(
        model=_S, messages=T.ArrayType(_MESSAGE), max_tokens=_I, n=_I, temperature=_D,
        top_p=_D, seed=_I, logprobs=_B, top_logprobs=_I,
    ),
)
BATCH_RESPONSE = _struct(
    custom_id=_S,
    response=_struct(
        body=_struct(model=_S, choices=T.ArrayType(_struct(index=_I, message=_MESSAGE)))
    ),
)

# Raw question files, by adapter.
RAW = {
    "math": _struct(problem=_S, level=_S, type=_S, solution=_S),
    "gsm8k": _struct(question=_S, answer=_S),
    "gsm8k-fix": _struct(query=_S, gt_ans=_S, query_metadata=_struct(n_step=_I)),
    "mwpbench": _struct(data_topic=_S, data_source=_S, question=_S, answer=_S, license=_S, question_number=_S),
    "deepmind-mathematics": _struct(question=_S, answer=_S),
    "olympiadbench": _struct(
        question=_S, final_answer=T.ArrayType(_S), error=_S, subfield=_S, answer_type=_S,
        is_multiple_answer=_B, unit=_S, context=_S,
    ),
    "theoremqa": _struct(Question=_S, Answer=_S),
    "odyssey-math": T.MapType(_S, _struct(question=_S, answer=_S, label=_S, level=_I)),
    "aops": _struct(problem=_S, answer=_S, link=_S),
    "file": _struct(query=_S, ref_ans=_S),
}
