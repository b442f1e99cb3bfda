"""Registered queries of answers: the whole way from a question to what is said, and what models and judges gave back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import answers as A
from tessera.plans import techniques as Q
from tessera.plans.registry import query, stored, table
from tessera.plans.sql import tokens_sql

_SHARED = f"len(list_intersect(list_distinct({tokens_sql('q')}), {tokens_sql('s')}))"
ANSWERS = f"""{Q.PIPELINE}, ap AS (SELECT an.qid, rnk, doc_id, b."text" q, list_filter(list_transform(regexp_split_to_array(an."text", '[.!؟]+'), lambda x: regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x != '') l FROM an JOIN b ON b.item_id = an.qid),
au AS (SELECT qid, rnk, doc_id, q, unnest(l) s, generate_subscripts(l, 1) i FROM ap WHERE rnk <= {A.DRAWN}), ab AS (SELECT qid, rnk, doc_id, s FROM au QUALIFY row_number() OVER (PARTITION BY qid, rnk ORDER BY {_SHARED} DESC, i) = 1),
al2 AS (SELECT qid, string_agg('- ' || s || ' [' || rnk || ']', chr(10) ORDER BY rnk) answer, list(doc_id ORDER BY rnk) FILTER (true) cited FROM ab GROUP BY 1)
SELECT sg.item_id qid, CASE WHEN route = 'simple' THEN 'direct' WHEN coalesce(refused, false) OR answer IS NULL THEN 'refused' ELSE 'answered' END status,
CASE WHEN route = 'simple' THEN '{A.DIRECT}' WHEN coalesce(refused, false) OR answer IS NULL THEN '{A.REFUSAL}' ELSE answer END answer, coalesce(CASE WHEN route != 'simple' AND NOT coalesce(refused, false) THEN cited END, []) cited, 0 invalid, true guarded
FROM sg LEFT JOIN ct ON ct.qid = sg.item_id LEFT JOIN al2 ON al2.qid = sg.item_id"""


@query(f"WITH {ANSWERS}")
def answer_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Every question's answer: route, retrieval by its techniques, sentences with their chunks, presentation and guard."""
    rows, trace = Q.run(spark, d)
    return A.answered(Q.questions(spark, d), stored(trace, "trace"), stored(rows, "answers"))


#: Answers of models in both shapes, whole and broken; texts are those of turns.
BODY = """CASE (conv_id + turn) % 9 WHEN 0 THEN concat('{"choices": [{"message": {"content": "', role, '"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": ', CAST(turn AS STRING), ', "completion_tokens": 7}}')
WHEN 1 THEN '{"choices": [{"message": {"content": "half"}, "finish_reason": "length"}], "usage": {"prompt_tokens": 5}}' WHEN 2 THEN '{"choices": []}' WHEN 3 THEN '{"choices": [{"message": {"content": "free"}}]}' WHEN 4 THEN 'no json'
WHEN 5 THEN concat('{"message": {"content": "', role, ' native"}, "done_reason": "stop", "prompt_eval_count": ', CAST(conv_id AS STRING), '}') WHEN 6 THEN '{"message": {"content": "x"}, "done_reason": "length", "prompt_eval_count": 3}'
WHEN 7 THEN '{"message": {"content": "x"}, "eval_count": 3}' ELSE '{"message": {}}' END"""
_J = "CASE WHEN json_valid(x) THEN x::JSON END"
PARSED = f"""r AS (SELECT conv_id, turn, {_J} j FROM (SELECT *, {BODY} x FROM conversations)), s AS (SELECT *, json_exists(j, '$.choices') ch FROM r),
f AS (SELECT conv_id, turn, coalesce(ch, false) ch, CASE WHEN ch THEN j ->> '$.choices[0].message.content' ELSE j ->> '$.message.content' END t, coalesce(CASE WHEN ch THEN j ->> '$.choices[0].finish_reason' ELSE j ->> '$.done_reason' END, '') finish,
CASE WHEN ch THEN j ->> '$.usage.prompt_tokens' ELSE j ->> '$.prompt_eval_count' END p, coalesce(CASE WHEN ch THEN j ->> '$.usage.completion_tokens' ELSE j ->> '$.eval_count' END, '0') d FROM s),
e AS (SELECT *, CASE WHEN t IS NULL THEN CASE WHEN ch THEN 'no choices' ELSE 'no message' END WHEN finish = 'length' THEN 'cut off' WHEN p IS NULL THEN 'no usage' END error FROM f)"""


@query(f"WITH {PARSED} SELECT conv_id, turn, CASE WHEN error IS NULL THEN t END \"text\", finish, CASE WHEN error IS NULL THEN p::BIGINT END prompt_tokens, CASE WHEN error IS NULL THEN d::BIGINT END completion_tokens, error FROM e")
def llm_parse(spark: SparkSession, d: str) -> DataFrame:
    """Answers of models in either shape, and why others can't be used."""
    return table(spark, d, "conversations").select("conv_id", "turn", A.response(F.expr(BODY)).alias("r")).select("conv_id", "turn", "r.*")


JUDGE = """CASE doc_id % 6 WHEN 0 THEN concat('{"context_relevance": 1, "faithfulness": ', CAST(doc_id % 2 AS STRING), ', "answer_relevance": 0.5, "correctness": null}') WHEN 1 THEN '{"faithfulness": "1", "correctness": 1}'
WHEN 2 THEN 'broken' WHEN 3 THEN '[1, 1, 1, 1]' WHEN 4 THEN '{"context_relevance": true, "correctness": {"a": 1}}' ELSE concat('{"answer_relevance": ', CAST(doc_id AS STRING), '}') END"""
_SCORE = "CASE WHEN json_type(j, '$.{k}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN (j ->> '$.{k}')::DOUBLE WHEN json_type(j, '$.{k}') = 'BOOLEAN' THEN (j ->> '$.{k}')::BOOLEAN::INT::DOUBLE END {k}"


@query(f"SELECT doc_id, {', '.join(_SCORE.format(k=k) for k in A.SCORES)} FROM (SELECT doc_id, {_J} j FROM (SELECT doc_id, {JUDGE} x FROM documents))")
def judge_parse(spark: SparkSession, d: str) -> DataFrame:
    """Four scores of every judgement, null where there is no number."""
    return table(spark, d, "documents").select("doc_id", A.judged(F.expr(JUDGE)).alias("s")).select("doc_id", "s.*")
