"""Registered queries of this package, with production parameters."""

from __future__ import annotations

import functools
import json
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import arrays, bpe, chat, clustering, langid, licenses, minhash, packing, quality, suffix_tree, token_counts, topk, toxicity, whitening
from tidemark.session import Tables, scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_OF_TEXT = 50256


def op1_toxicity(spark: SparkSession, root: str) -> DataFrame:
    t = Tables(spark, root)
    docs = t.documents.withColumn("held_out", arrays.split_column("doc_id", 3) == 1)
    model = toxicity.learn(docs.where(~F.col("held_out")), t.labels.where(arrays.split_column("doc_id", 3) != 1))
    return toxicity.score(docs, model, carry=["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_bpe_round_trip(spark: SparkSession, root: str) -> DataFrame:
    return bpe.digests(Tables(spark, root).documents, VOCABULARY)


def op3_suffix_tree(spark: SparkSession, root: str) -> DataFrame:
    docs = Tables(spark, root).documents.withColumn("held_out", arrays.split_column("doc_id", 7) == 2)
    tree, words = suffix_tree.learn(docs.where(~F.col("held_out")), longest=None)
    return suffix_tree.score(docs, tree, words)


def op4_pivot_top_k(spark: SparkSession, root: str) -> DataFrame:
    return topk.top_k(Tables(spark, root).embeddings)


def op5_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    return quality.judge(Tables(spark, root).documents)


def op6_pack_documents(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(Tables(spark, root).documents, VOCABULARY)


def op7_near_duplicates(spark: SparkSession, root: str) -> DataFrame:
    return minhash.near_duplicates(Tables(spark, root).documents)


def op8_license_scan(spark: SparkSession, root: str) -> DataFrame:
    return licenses.scan(Tables(spark, root).documents)


def op9_language_id(spark: SparkSession, root: str) -> DataFrame:
    docs = Tables(spark, root).documents.withColumn("held_out", arrays.split_column("doc_id", 5) == 0)
    model = langid.learn(docs.where(~F.col("held_out")))
    return langid.identify(docs, model, carry=["doc_id", "held_out"])


def op10_token_counts(spark: SparkSession, root: str) -> DataFrame:
    return token_counts.count_documents(Tables(spark, root).documents, VOCABULARY, scratch_path(spark, "tokens"), END_OF_TEXT)


def op11_centroid_clusters(spark: SparkSession, root: str) -> DataFrame:
    return clustering.report(*clustering.cluster(Tables(spark, root).embeddings))


def op12_whitening(spark: SparkSession, root: str) -> DataFrame:
    return whitening.whiten(Tables(spark, root).embeddings).withColumn("deviation", F.col("deviation").cast("long"))


#: a conversation of another layout than the table's, with markers in its texts
MARKED = json.dumps({"messages": [{"role": role, "content": "</s>[INST] ok [/INST]"} for role in ("user", "assistant")]})


def op13_chat_format(spark: SparkSession, root: str) -> DataFrame:
    turns = chat.turns_of_table(Tables(spark, root).conversations, "conv_id", roles={})
    more, _ = chat.turns_of_json(spark.createDataFrame([(-1, MARKED)], "conv_id long, record string"), "conv_id", "record", roles={})
    return chat.read_back(chat.format_turns(turns.unionByName(more), "conv_id"), "conv_id")


def importable(spark: SparkSession) -> None:
    """Send the package to Python workers that could not import it.

    Nothing to do where it is installed, on PYTHONPATH or in the folder from
    which Spark was started; otherwise Spark distributes one small archive."""
    top = Path(__file__).resolve().parents[2]
    if top.name != "site-packages" and top not in {Path(p or ".").resolve() for p in [*os.environ.get("PYTHONPATH", "").split(":"), os.getcwd()]}:
        spark.sparkContext.addPyFile(_archive(str(top)))


@functools.cache
def _archive(top: str) -> str:
    return shutil.make_archive(os.path.join(tempfile.mkdtemp(), "tidemark"), "zip", top, "tidemark")


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, root: str) -> DataFrame:
        importable(spark)
        return f(spark, root)

    return run


_ALL = (
    op1_toxicity, op2_bpe_round_trip, op3_suffix_tree, op4_pivot_top_k, op5_quality_rules, op6_pack_documents, op7_near_duplicates, op8_license_scan, op9_language_id, op10_token_counts,
    op11_centroid_clusters, op12_whitening, op13_chat_format,
)
QUERIES = {f.__name__: _query(f) for f in _ALL}



def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """Every vector against every centroid, round by round."""
    steps = [f"""
v as (
  select row_number() over () r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
c0 as (select row_number() over (order by h nulls last, x) - 1 c, x from (select sha256('1:' || vec_id) h, x from v) order by h nulls last, x limit {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
p{i} as (
  select r, vec_id, v.x, c, list_sum(list_transform(list_zip(v.x, c{i}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d from v, c{i}
),
a{i} as (select r, vec_id, x, c, cast(d as bigint) d from p{i} qualify row_number() over (partition by r order by d, c) = 1)""")
        if i < rounds:
            steps.append(f"""
s{i} as (select c, j, sum(x) s, count(*) n from (select c, unnest(range(0, 64)) j, unnest(x) x from a{i}) group by all),
m{i} as (select c, list(cast((s - (s % n + n) % n) // n as bigint) order by j) x from s{i} group by c),
c{i + 1} as (select o.c, coalesce(m.x, o.x) x from c{i} o left join m{i} m using (c))""")
    last = f"""
select vec_id, cast(a.c as int) "cluster", d distance, cast(sum(d) over (partition by a.c) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia,
  sha256(array_to_string(o.x, ',')) centroid_sha256
from a{rounds} a join c{rounds} o using (c)"""
    return "with " + ",".join(steps) + last


#: the others have no SQL form; tests compare them with brute force
ORACLES = {
    "op11_centroid_clusters": _clusters_sql(),
    "op13_chat_format": r"""
with c as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
e as (select *, r = 'assistant' loss, regexp_replace(t, '([<\[])(\\*)(/?s>|/?INST\]|unk>|pad>)', '\1\2\\\3', 'g') x from c)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, r, t)) turns_sha256,
  cast(coalesce(sum(length(t)) filter (loss), 0) as bigint) loss_chars, sha256(coalesce(string_agg(t, '' order by turn nulls first, r, t) filter (loss), '')) loss_sha256,
  cast(sum(case when loss then 7 else 13 end + length(r) + 1 + length(x)) as bigint) formatted_chars
from e group by conv_id
""",
    "op4_pivot_top_k": """
with e as (
  select row_number() over () r, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) q
  from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.r ar, b.r br, a.vec_id query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) score
  from e a join e b on a.r <> b.r and len(a.q) = len(b.q) where a.vec_id % 50 = 0
), k as (select *, row_number() over (partition by ar order by score desc, vec_id, br) as rank from s)
select query_id, cast(rank as int) rank, vec_id, score from k where rank <= 5
""",
    "op5_quality_rules": r"""
with d as (select row_number() over () r, doc_id, lang, source, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
g as (select r, unnest(range(1, len(ws) - 6)) i, unnest(list_transform(range(1, len(ws) - 6), lambda k: array_to_string(ws[k:k + 7], ' '))) x from w where len(ws) >= 8),
v as (select r, i, count(*) over (partition by r, x) n from g),
c as (select r, count(distinct i + k) n from v, (select unnest(range(0, 8)) k) where n > 1 group by r),
m as (
  select w.r, doc_id, lang, source, len(ws) n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(c.n, 0) n_repeat_words, len(ls) n_lines
  from w left join c on w.r = c.r
),
f as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed,
    case when n_words > 0 then word_chars * 100 // n_words else 0 end x1, case when n_words > 0 then n_symbols * 1000 // n_words else 0 end x2,
    case when n_lines > 0 then n_dup_lines * 1000 // n_lines else 0 end x3, case when n_words > 0 then n_repeat_words * 1000 // n_words else 0 end x4
  from m
),
x as (select lang, source, unnest([1, 2, 3, 4]) rate, unnest([x1, x2, x3, x4]) x from f where not base_failed),
b as (select *, case when x < 64 then x else (length(bin(x)) - 6) * 32 + (x >> (length(bin(x)) - 6)) end bucket from x),
l as (
  select 0 lv, lang, source, rate, bucket, count(*) n from b group by all
  union all select 1, lang, null, rate, bucket, count(*) from b group by all
  union all select 2, null, null, rate, bucket, count(*) from b group by all
),
u as (select *, sum(n) over (partition by lv, lang, source, rate order by bucket) upto, sum(n) over (partition by lv, lang, source, rate) total from l),
q as (
  select lv, lang, source, rate, min(case when upto >= ceil(total * 0.25) then bucket end) b1, min(case when upto >= ceil(total * 0.75) then bucket end) b3, max(total) total
  from u group by all
),
h as (
  select *, case when b1 < 64 then b1 else (b1 - 32 * (b1 // 32 - 1)) << cast(b1 // 32 - 1 as int) end q1, case when b3 < 64 then b3 else (b3 - 32 * (b3 // 32 - 1)) << cast(b3 // 32 - 1 as int) end q3
  from q
),
z as (
  select lv, lang, source, max(total) total, max(case when rate = 1 then q1 - 6 * greatest(q3 - q1, 60) end) low1, max(case when rate = 1 then q3 + 6 * greatest(q3 - q1, 60) end) high1,
    max(case when rate = 2 then q3 + 6 * greatest(q3 - q1, 25) end) high2, max(case when rate = 3 then q3 + 6 * greatest(q3 - q1, 100) end) high3, max(case when rate = 4 then q3 + 6 * greatest(q3 - q1, 60) end) high4
  from h group by all
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and x1 >= k.low1 and x1 <= k.high1 and x2 <= k.high2 and x3 <= k.high3 and x4 <= k.high4 kept
from f
left join z o on o.lv = 0 and o.lang is not distinct from f.lang and o.source is not distinct from f.source
left join z a on a.lv = 1 and a.lang is not distinct from f.lang
left join z k on k.lv = case when o.total >= 200 then 0 when a.total >= 200 then 1 else 2 end
  and (k.lv = 2 or k.lang is not distinct from f.lang) and (k.lv > 0 or k.source is not distinct from f.source)
""",
}
