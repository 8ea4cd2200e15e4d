"""Queries opN_<name> of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, brown, common, crf, kneser_ney, lines, matroska, middle, ngram_join, odd_sketch, packing, ppm, rules


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    learned = rules.fit(docs, common.read(spark, sf_dir, "labels"))
    return rules.judged(docs, learned, ["doc_id"])


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(common.read(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(common.read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(common.read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedupe(docs).withColumn("n_removed", F.size("removed_lines"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    held_out = common.fold("doc_id", 3) == 1
    trees = ppm.train(docs, ~held_out)
    out = ppm.identify(docs.select("doc_id", "text"), trees, ["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    held_out = common.fold("doc_id", 5) == 0
    models = kneser_ney.fit(docs, common.read(spark, sf_dir, "labels"), ~held_out)
    return kneser_ney.score(docs, models, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_brown_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    held_out = common.fold("doc_id", 7) == 2
    model, counts = brown.train(docs, ~held_out)
    return brown.score(docs, model, counts).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    held_out = common.fold("doc_id", 3) == 1
    chain = crf.fit(docs, common.read(spark, sf_dir, "labels"), ~held_out)
    return crf.score(docs, chain, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.components(common.read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(common.read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_ngram_jaccard, op3_bpe, op4_best_fit_packing, op5_matroska, op6_line_dedup, op7_language_id, op8_toxicity, op9_brown_bigrams, op10_line_crf,
        op11_odd_sketches, op12_filter_audit, op13_fill_in_middle,
    )
}

#: All pairs by shared shingles, then the transitive closure: whole tables, but no method for large ones.
NGRAM_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
g as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) end as gs from w),
d as (select doc_id, len(gs) as c, md5(array_to_string(list_sort(gs), chr(10))) as nid from g),
s as (select doc_id, unnest(gs) as shingle from g),
p as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b using (shingle) where a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from p join d a on a.doc_id = x join d b on b.doc_id = y where 5 * i >= 4 * (a.c + b.c - i) union all select a.doc_id, b.doc_id from d a join d b on a.c = 0 and b.c = 0 and a.doc_id <> b.doc_id),
r(node, root) as (select doc_id, doc_id from d union select e.y, r.root from r join e on e.x = r.node),
k as (select node as doc_id, min(root) as class_id from r group by 1),
n as (select x as doc_id, count(*) as links, count(distinct b.nid) filter (b.nid <> a.nid) as linked_texts from e join d a on a.doc_id = x join d b on b.doc_id = y group by 1)
select doc_id, class_id, coalesce(links, 0) as links, coalesce(linked_texts, 0) as linked_texts from k left join n using (doc_id)"""

#: As above for four words, lower case and 100 * intersection >= 80 * union; texts without words are linked with nothing.
COMPONENT_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
g as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' '))) end as gs from w),
d as (select doc_id, len(gs)::bigint as n_shingles from g),
s as (select doc_id, unnest(gs) as shingle from g),
p as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b using (shingle) where a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from p join d a on a.doc_id = x join d b on b.doc_id = y where 100 * i >= 80 * (a.n_shingles + b.n_shingles - i)),
r(node, root) as (select doc_id, doc_id from d union select e.y, r.root from r join e on e.x = r.node)
select doc_id, any_value(n_shingles) as n_shingles, min(root) as component_id, doc_id = min(root) as kept from r join d on doc_id = node group by doc_id"""

#: The five filters, the 120 orders spelled out, and sums of the failed filters' numbers.
AUDIT_SQL = r"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
firsts as (select coalesce(text, '') as text, min(doc_id) as first from documents group by 1),
f as (select t.doc_id, part, len(ws) < 200 as a, 100 * len(list_distinct(ws)) < 50 * len(ws) as b, 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 3 * length(t.text) as c,
  regexp_matches(t.text, '[#$%&*|]') as d, coalesce(t.doc_id > first, false) as e from t join firsts using (text)),
l as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by 1),
m as (select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as failed, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f left join l using (doc_id) group by 1, 2),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as l, unnest([1, 2, 4, 8, 16]) as bit),
o as (select a.l || b.l || c.l || d.l || e.l as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from x a, x b, x c, x d, x e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s as (select filter_order, step, bits[step] as own, coalesce(list_sum(bits[1 : step - 1]), 0)::int as earlier from o, range(1, 6) r(step)),
p as (select part, filter_order, step, own,
  coalesce(sum(n) filter ((failed & own) = 0 and (failed & earlier) = 0), 0)::bigint as kept, coalesce(sum(n) filter ((failed & own) <> 0 and (failed & earlier) = 0), 0)::bigint as removed,
  coalesce(sum(n) filter ((failed & own) <> 0 and (failed & earlier) <> 0), 0)::bigint as redundant, coalesce(sum(n) filter (failed = own), 0)::bigint as unique_fails,
  coalesce(sum(good) filter ((failed & own) <> 0 and (failed & earlier) = 0), 0)::bigint as good_lost, coalesce(sum(toxic) filter ((failed & own) <> 0 and (failed & earlier) = 0), 0)::bigint as toxic_lost
  from m, s group by 1, 2, 3, 4)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, own)::bigint as shapley from p"""

#: Units of every text as a list, cut by the numbers drawn from the hash of the id.
MIDDLE_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
d as (select *, len(units)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t),
f as (select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form,
  least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from d),
c as (select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix from f)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256 from c"""

ORACLES: dict[str, str] = {"op2_ngram_jaccard": NGRAM_SQL, "op11_odd_sketches": COMPONENT_SQL, "op12_filter_audit": AUDIT_SQL, "op13_fill_in_middle": MIDDLE_SQL}
