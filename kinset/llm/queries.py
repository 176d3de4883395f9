"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinset.llm.infill import Infill, fill_in_middle, restored
from kinset.llm.lattice import near_vectors
from kinset.llm.licenses import scan_licenses
from kinset.llm.mixing import mix_sources
from kinset.llm.negatives import hard_negatives
from kinset.llm.ngram_join import ngram_jaccard_join
from kinset.llm.phrases import edited_fingerprints
from kinset.llm.pieces import encode_texts
from kinset.llm.pii import KINDS, find_personal_data
from kinset.llm.repeats import remove_repeats
from kinset.llm.substrings import remove_known_runs
from kinset.llm.toolcalls import as_tool_chat, link_tool_calls, tool_schemas
from kinset.llm.toxicity import CUT, score, train


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Place of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of all documents that 4-word shingles link at 0.85."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return ngram_jaccard_join(docs, words=4, num=85, den=100).select("doc_id", "n_shingles", "component_id", "n_links")


def op2_phrase_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return edited_fingerprints(docs).select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


#: Tools of the derived chats: parameters, their types, whether they are required (fixed values).
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", True)},
    "count": {"query": ("string", True), "limit": ("number", False)},
    "rate": {"query": ("string", True), "limit": ("integer", False), "deep": ("boolean", False)},
}


def op3_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls and results in chats derived from all conversations."""
    chats = as_tool_chat(table(spark, sf, "conversations"))
    return link_tool_calls(chats, tool_schemas(spark, TOOLS))


#: The same straight from the conversations: chains of calls two turns apart, numbered by window.
OP3_SQL = """with m as (select conv_id, turn, role, text,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) as w,
    regexp_extract(coalesce(text, ''), '^([A-Za-z]*)', 1) as q from conversations),
  c as (select conv_id, turn, w, q, 'call_' || conv_id || '_' || turn as call_id,
      (['search', 'count', 'rate', 'other'])[w % 4 + 1] as tool, w % 5 <> 0 as chained
    from (select conv_id, turn, min(w) as w, min(q) as q from m where role = 'assistant' group by all)),
  t as (select conv_id, turn, count(*) as times from m where role = 'assistant' group by all),
  r as (select conv_id, turn - 1 as turn, turn as result_turn, min(text) as result
    from m where role = 'user' group by all),
  s as (select *, sum(case when chained and before is not distinct from turn - 2 then 0 else 1 end)
        over (partition by conv_id, turn % 2 order by turn) as chain
    from (select *, lag(turn) over (partition by conv_id, turn % 2 order by turn) as before from c)),
  l as (select *, row_number() over (partition by conv_id, turn % 2, chain order by turn) - 1 as level from s),
  p as (select l.*, w % 11 = 0 as broken, w % 6 <> 0 as has_limit, w % 7 = 0 as text_limit, w % 13 = 0 as deep from l)
select conv_id, call_id, turn, tool, level::bigint as level, result_turn, times,
  problems = '' as valid, problems,
  '{"arguments":' || case when broken then '"none"' else '{' || case when deep then '"deep":true,' else '' end
      || case when has_limit then '"limit":' || case when text_limit then '"' || w || '"' else w::varchar end || ',' else '' end
      || '"query":"' || q || '"}' end
    || ',"id":"' || call_id || '","name":"' || tool || '","result":' || coalesce(to_json(result)::varchar, 'null') || '}' as line
from (select p.*, case when tool = 'other' then 'unknown tool' when broken then 'no object' else concat_ws(';',
      case when not has_limit and tool = 'search' then 'missing limit' end,
      case when has_limit and text_limit then 'type of limit' end,
      case when deep and tool <> 'rate' then 'unknown deep' end) end as problems from p) x
  left join r using (conv_id, turn) join t using (conv_id, turn)"""


def op4_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of the ids of every document and of the text decoded from them."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = encode_texts(docs, tokenizer_path()).select("doc_id", "ids", "decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_suffix_array(spark: SparkSession, sf: str) -> DataFrame:
    """What remains of all documents without the 200-byte strings that repeat."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What remains of all documents without the 50-word runs of earlier ones."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return remove_known_runs(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


def op7_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Licences and rights notices in all documents."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return scan_licenses(docs).drop("text", "matches")


#: Rows with this remainder of crc32(doc_id) by 4 are never learnt from.
HELD_OUT = 2


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == HELD_OUT


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of every document from a network fitted on the rows that are not held out."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    net = train(docs, table(spark, sf, "labels"), ~held_out())
    return score(docs, net).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"), "cut", "rejected",
    )


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """How many words of every document the mix of all sources takes."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "placed")


def op10_lattice_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate classes of all embeddings at a cosine of 0.95."""
    return near_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"))


def op11_infill(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of the fill-in-the-middle example of every document and of the text restored from it."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    made = fill_in_middle(docs, how=Infill(seed=42, rate=50, suffix_first=80))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored().cast("binary"), 256).alias("restored_sha256"),
    )


OP11_SQL = """with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as h
    from documents),
  u as (select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as parts,
    list_transform([1, 9, 17, 25], lambda i: ('0x' || h[i : i + 7])::bigint) as h from d),
  c as (select doc_id, t, parts, len(parts) as n, least(h[1] % (n + 1), h[2] % (n + 1)) as a,
    greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 50
      then 'plain' when h[4] % 100 < 80 then 'spm' else 'psm' end as form from u),
  p as (select doc_id, t, n, form, array_to_string(parts[1 : a], '') as prefix,
    array_to_string(parts[a + 1 : b], '') as middle, array_to_string(parts[b + 1 :], '') as suffix from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
  case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256 from p"""


def op12_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in all documents: the base spans counted and digested, and all spans."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = find_personal_data(docs)
    base = F.filter("spans", lambda s: s["base"])
    line = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of_kind = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans")
    )


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every hundredth embedding, with a seventh of the labels moved on by one."""
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, sf, "embeddings"), label=label)


OP13_SQL = """with r as (select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same,
      list_inner_product(a.v, b.v)::bigint as score
    from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
  p as (select anchor_id, other as positive_id, score as positive_score from s where same
    qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
  n as (select p.*, s.other as negative_id, s.score as negative_score,
      row_number() over (partition by anchor_id, positive_id order by s.score desc, s.other)::integer as rank
    from p join s using (anchor_id)
    where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5"""


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_phrase_fingerprints": op2_phrase_fingerprints,
    "op3_tool_calls": op3_tool_calls,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_suffix_array": op5_suffix_array,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_lattice_vectors": op10_lattice_vectors,
    "op11_infill": op11_infill,
    "op12_personal_data": op12_personal_data,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {"op3_tool_calls": OP3_SQL, "op11_infill": OP11_SQL, "op13_hard_negatives": OP13_SQL}
