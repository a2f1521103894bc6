"""The queries of this subpackage, as (spark, sf_dir) -> DataFrame, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.ann import by_modulus, nearest
from sparkloom.llm.chat import format_conversations, read_back
from sparkloom.llm.common import read
from sparkloom.llm.decontam import contamination
from sparkloom.llm.gru_lm import lm_scores
from sparkloom.llm.packing import pack
from sparkloom.llm.secrets import secret_scan
from sparkloom.llm.simhash import simhash_components
from sparkloom.llm.substring_dedup import digests
from sparkloom.llm.suffix_dedup import suffix_dedup
from sparkloom.llm.toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), by_modulus(20))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents")).drop("row_tag")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts hold control strings."""
    own = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(own.unionByName(more)))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_prefix_forest, op2_simhash_dedup, op3_lm_scoring, op4_substring_dedup, op5_best_fit_packing, op6_suffix_dedup, op7_toxicity, op8_secret_scan, op9_chat_formatting, op10_decontamination)}


#: Words of each document, and its windows with the smallest doc_id and the number of documents that have them.
_WINDOWS = """
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + {n} - 1], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - {n} + 2)) as i from d)),
met as (select k, min(doc_id) as least, count(distinct doc_id) as holders from win group by k having holders > 1),
hit as (select doc_id, i, least < doc_id as later from win join met using (k)),
word as (select distinct doc_id, later, unnest(range(i, i + {n})) as j from hit)
"""

_OP4 = (
    _WINDOWS.format(n=13)
    + """
, each as (select doc_id, w, unnest(range(1, len(w) + 1)) as j from d),
kept as (select e.doc_id, string_agg(e.w[e.j], ' ' order by e.j) as text, count(*) as n from each e anti join (select * from word where later) x on e.doc_id = x.doc_id and e.j = x.j group by e.doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(len(d.w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(text, '')) as kept_sha256 from d left join kept using (doc_id)
"""
)

_OP6 = (
    _WINDOWS.format(n=50)
    + """
, every as (select distinct doc_id, 'repeated' as kind, j from word union all select doc_id, 'copied', j from word where later),
island as (select doc_id, kind, j, j - row_number() over (partition by doc_id, kind order by j) as island from every),
run as (select doc_id, kind, min(j) - 1 as a, max(j) as b from island group by doc_id, kind, island),
told as (select doc_id, kind, cast(sum(b - a) as bigint) as n, string_agg(a || ':' || b, ',' order by a) as runs from run group by doc_id, kind)
select r.doc_id, r.n as n_repeated, coalesce(c.n, 0) as n_copied, r.runs as repeated, coalesce(c.runs, '') as copied
from (select * from told where kind = 'repeated') r left join (select * from told where kind = 'copied') c using (doc_id)
"""
)

_CONTROL = "<<SYS>>|<</SYS>>|\\[INST\\]|\\[/INST\\]|<s>|</s>|\\[ROLE\\]|\\[/ROLE\\]|\\[TURN\\]|\\[/TURN\\]"
_OP9 = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f as (select *, length(text) + len(regexp_extract_all(text, '{_CONTROL}')) as body, length(role) + len(regexp_extract_all(role, '{_CONTROL}')) as head from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(body + case role when 'user' then 15 when 'assistant' then 9 when 'system' then 17 else 32 + head end) as bigint) as formatted_chars
from f group by conv_id
"""


def oracle_sql() -> dict[str, str]:
    """For what SQL can say; the others need XXH64, tokenizers, offsets of matches or fitted models."""
    return {"op4_substring_dedup": _OP4, "op6_suffix_dedup": _OP6, "op9_chat_formatting": _OP9}
