"""Queries on conversations and texts: rendering, token statistics, extraction, grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import dataset, preference, render, tokenize
from .registry import query

_ROLE = "(upper(left(role,1)) || lower(substr(role,2)))"
_TURNS = "(SELECT *, max(turn) OVER (PARTITION BY conv_id) = turn AS last FROM conversations)"
_COLON = f"""{_ROLE} || ':' AS ob, ' ' || text || chr(10) || chr(10) || CASE WHEN NOT last THEN '' WHEN role = 'assistant' THEN 'User:' ELSE '<UNUSED>' END AS ac"""


def _stats_sql(ob_weight: int, weight: str, length: int) -> str:
    return f"""
WITH p AS (SELECT conv_id, turn, {_COLON}, ({weight})::INT AS w FROM {_TURNS}),
 e AS (SELECT conv_id, 2*turn AS k, strlen(ob) AS n, {ob_weight} AS w FROM p UNION ALL SELECT conv_id, 2*turn+1, strlen(ac), w FROM p),
 o AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM e)
SELECT conv_id, CAST(least(max(upto), {length}) - 1 AS BIGINT) AS n_tokens,
 CAST(sum(w * greatest(least(upto, {length}) - greatest(upto - n, 1), 0)) AS BIGINT) AS n_loss_tokens FROM o GROUP BY conv_id"""


def _stats(t, train_on, length):
    c = render.conversations(t.conversations)
    return c.select("conv_id", render.byte_stats(render.pieces(c, "role_colon", train_on), length).alias("s")).select("conv_id", "s.n_tokens", "s.n_loss_tokens")


for _name, _train, _ob, _w in (
    ("last", "last_assistant_message", 0, "last AND role = 'assistant'"), ("all_asst", "all_assistant_messages", 0, "role = 'assistant'"), ("all_msgs", "all_messages", 0, "TRUE"),
    ("all_tokens", "all_tokens", 1, "TRUE"), ("user_sys", "all_user_and_system_messages", 0, "role IN ('user', 'system')"),
):
    query(_stats_sql(_ob, _w, 512), f"sft_token_stats_{_name}")(lambda t, train=_train: _stats(t, train, 512))


@query(f"""WITH s AS ({_stats_sql(0, "role = 'assistant'", 2048)}), r AS (SELECT conv_id, string_agg(ob || ac, '' ORDER BY turn) AS rendered FROM (SELECT conv_id, turn, {_COLON} FROM {_TURNS}) GROUP BY conv_id)
SELECT conv_id, rendered, n_tokens, n_loss_tokens FROM r JOIN s USING (conv_id)""")
def sft_render_role_colon(t):
    c = render.conversations(t.conversations)
    p = render.pieces(c, "role_colon", "all_assistant_messages")
    return c.select("conv_id", render.rendered(p).alias("rendered"), render.byte_stats(p, 2048).alias("s")).select("conv_id", "rendered", "s.n_tokens", "s.n_loss_tokens")


def _render_sql(start: str, part: str) -> str:
    return f"SELECT conv_id, '{start}' || string_agg({part}, '' ORDER BY turn) AS rendered FROM (SELECT *, turn = min(turn) OVER (PARTITION BY conv_id) AS fst, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY conv_id"


_NL = "CASE WHEN fst THEN '' ELSE chr(10) END"
_THINK = "CASE WHEN role = 'assistant' AND NOT contains(text, '</think>') AND NOT contains(text, '<think>') THEN '<think>' ELSE '' END"
_D = {k: "<｜" + k + "｜>" for k in ("User", "Assistant", "begin▁of▁sentence", "end▁of▁sentence")}
for _name, _template, _start, _part in (
    ("llama3", "llama3", "<|begin_of_text|>", "'<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|>'"),
    ("qwen3", "qwen3", "", f"{_NL} || '<|im_start|>' || role || chr(10) || {_THINK} || text || '<|im_end|>'"),
    ("qwen3_instruct", "qwen3_instruct", "", f"{_NL} || '<|im_start|>' || role || chr(10) || text || '<|im_end|>'"),
    ("gpt_oss", "gpt_oss_no_sysprompt", "", "'<|start|>' || role || CASE WHEN role = 'assistant' THEN '<|channel|>final' ELSE '' END || '<|message|>' || text || CASE WHEN last THEN '<|return|>' ELSE '<|end|>' END"),
    ("deepseekv3", "deepseekv3_system_as_user", _D["begin▁of▁sentence"], f"CASE WHEN role = 'assistant' THEN '{_D['Assistant']}' ELSE '{_D['User']}' END || text || CASE WHEN role = 'assistant' THEN '{_D['end▁of▁sentence']}' ELSE '' END"),
):

    @query(_render_sql(_start, _part), f"sft_render_{_name}")
    def _rendered(t, template=_template):
        c = render.conversations(t.conversations)
        return c.select("conv_id", render.rendered(render.pieces(c, template, "all_messages")).alias("rendered"))


@query("""SELECT conv_id, string_agg(CASE WHEN turn = f THEN '' ELSE chr(10) END || '<|im_start|>' || role || chr(10) || CASE WHEN role = 'assistant' AND NOT contains(text, '</think>') AND NOT contains(text, '<think>') THEN '<think>' ELSE '' END || text || '<|im_end|>', '' ORDER BY turn)
 || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || '</think>' || chr(10) || chr(10) || 'Sure' AS prompt
FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS f FROM conversations) GROUP BY conv_id""")
def generation_prompt_qwen3_no_thinking(t):
    c = render.conversations(t.conversations)
    return c.select("conv_id", render.generation_prompt(c, "qwen3_disable_thinking", prefill="Sure").alias("prompt"))


@query("""WITH q AS (SELECT conv_id, turn, text || CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN chr(10) || chr(10) || 'User: x' ELSE '  ' END AS r FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, trim(split_part(r, chr(10) || chr(10) || 'User:', 1), ' ' || chr(9) || chr(10) || chr(13)) AS content, contains(r, chr(10) || chr(10) || 'User:') AS ok FROM q""")
def parse_role_colon(t):
    r = F.concat("text", F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, "\n\nUser: x").otherwise("  "))
    rows = t.conversations.where("role = 'assistant'").select("conv_id", "turn", render.parse_stop_text(r, "\n\nUser:").alias("p"))
    return rows.select("conv_id", "turn", "p.content", "p.ok")


@query("""SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id HAVING arg_min(text, turn) <> ''""")
def first_user_prompt(t):
    return dataset.first_message(t.conversations)


@query("""SELECT conv_id, turn, CASE WHEN role IN ('human', 'user') THEN 'user' ELSE 'assistant' END AS with_user, CASE WHEN role = 'human' THEN 'user' ELSE 'assistant' END AS human_only FROM conversations""")
def role_remap(t):
    return t.conversations.select("conv_id", "turn", dataset.remap_role("role").alias("with_user"), dataset.remap_role("role", False).alias("human_only"))


@query("""WITH w AS (SELECT doc_id, text, regexp_split_to_array(regexp_replace(lower(text), '[!"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]', '', 'g'), '\\s+') AS w FROM documents)
SELECT doc_id, array_to_string(list_filter(w, lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ') AS normal, length(text) > 0 AS self_match FROM w""")
def qa_exact_match(t):
    """Documents of every language."""
    docs = t.documents
    gold = F.array(F.lit("something else"), F.concat(F.lit("  The "), "text", F.lit("!")))
    return docs.select("doc_id", text.normalize_qa("text").alias("normal"), text.matches_any("text", gold).alias("self_match"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, CASE WHEN l_linenumber % 3 = 0 THEN CAST(CAST(l_partkey AS VARCHAR) || CAST(l_suppkey AS VARCHAR) AS VARCHAR) WHEN l_linenumber % 3 = 1 THEN CAST(l_partkey AS VARCHAR) ELSE NULL END AS answer FROM lineitem""")
def gsm8k_extract(t):
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    said = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("so #### 7\n  #### "), part, F.lit(","), supp, F.lit(" \ndone"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("#### 1\n#### : "), part)).otherwise(F.lit("no idea"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"), text.gsm8k_answer(said).alias("answer"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source END AS summary, CASE WHEN doc_id % 3 = 0 THEN 'all of it' WHEN doc_id % 3 = 1 THEN lang ELSE lang || ' to the end' END AS feedback,
 CASE WHEN doc_id % 2 = 0 THEN source END AS answer, source AS final_word, CAST(doc_id AS BIGINT) AS number, 'x = ' || lang AS code FROM documents""")
def text_extractors(t):
    even, three = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3
    thought = F.when(even, F.concat(F.lit("thinking</think>\n "), F.col("source"), F.lit(" \n"))).otherwise(F.lit("thinking</think>  "))
    marked = F.when(three == 0, "all of it").when(three == 1, F.concat(F.lit("<f>"), F.col("lang"), F.lit("</f> <f>no</f>"))).otherwise(F.concat(F.lit("x<f>"), F.col("lang"), F.lit(" to the end")))
    answered = F.when(even, F.concat(F.lit("so Answer: "), F.col("source"), F.lit(" "))).otherwise(F.lit("Answer: a Answer: b"))
    fenced = F.concat(F.lit("```\nold\n```\ntext\n```python\n x = "), F.col("lang"), F.lit("\n```"))
    return t.documents.select(
        "doc_id", text.summary_after_thinking(thought).alias("summary"), text.between_marks(marked, "<f>", "</f>").alias("feedback"), text.single_answer(answered).alias("answer"),
        text.final_answer_word(F.concat(F.lit("Final Answer: "), F.col("source"), F.lit("."))).alias("final_word"), text.guess_number(F.concat(F.lit("Guess:  "), F.col("doc_id").cast("string"), F.lit(" "))).alias("number"), text.last_code_block(fenced).alias("code"),
    )


@query("""WITH t AS (SELECT conv_id, 'Human: ' || string_agg(text, ' Assistant: ' ORDER BY turn) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, CAST((SELECT count(*) FROM conversations c WHERE c.conv_id = t.conv_id) AS BIGINT) AS n_prompt FROM t""")
def hhh_filter(t):
    """Transcripts that differ in their last turn only: the prompt holds all the turns before it."""
    said = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda m: m["text"]), " Assistant: ").alias("s"))
    pairs = said.select("conv_id", F.concat(F.lit("Human: "), F.col("s"), F.lit(" Assistant: yes")).alias("chosen"), F.concat(F.lit("Human: "), F.col("s"), F.lit(" Assistant: no")).alias("rejected"))
    return preference.hhh_comparisons(pairs).select("conv_id", F.size("prompt_conversation").cast("bigint").alias("n_prompt"))


@query("""SELECT conv_id, count(*) + 5 AS n_messages, 'system: ==== Preference ====' AS before_label FROM conversations GROUP BY conv_id""")
def comparison_conversation(t):
    c = render.conversations(t.conversations).select("conv_id", F.transform("messages", lambda m: F.struct(m["role"], m["content"])).alias("prompt_conversation"))
    pairs = c.withColumns({"completion_a": F.array(preference.message("assistant", F.lit("yes"))), "completion_b": F.array(preference.message("assistant", F.lit("no"))), "label": F.lit("A")})
    shown = pairs.select("conv_id", preference.comparison_conversation().alias("m"))
    last = F.element_at("m", -1)
    return shown.select("conv_id", F.size("m").cast("bigint").alias("n_messages"), F.concat_ws(": ", last["role"], last["content"]).alias("before_label"))


@query("SELECT doc_id, md5(text) AS text_md5, octet_length(encode(text)) AS n_bytes FROM documents")
def token_round_trip(t):
    """Whole texts as ids of a byte-level vocabulary, and back again."""
    path = tokenize.vocabulary_path("byte_bpe_50k.json")
    ids = tokenize.token_ids(t.documents.select("doc_id", "text"), path).drop("text")
    return tokenize.token_texts(ids, path).select("doc_id", F.md5("text").alias("text_md5"), F.octet_length("text").cast("long").alias("n_bytes"))


@query()
def sft_token_stats_bpe(t):
    """Token statistics of rendered conversations by a byte-level vocabulary; held against the library in tests."""
    c = render.conversations(t.conversations)
    pieces = c.select("conv_id", render.pieces(c, "role_colon", "all_assistant_messages").alias("pieces"))
    return tokenize.token_stats(pieces, "conv_id", tokenize.vocabulary_path("byte_bpe_50k.json"), 2048)
