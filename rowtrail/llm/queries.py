"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtrail.llm import (decontaminate, fingerprints, language, licenses, lines, merkle, mixing, ngram_join, search, secrets, toxicity,
                          urls, vectors)
from rowtrail.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLES["op8_line_dedup"] = """
with rows as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
split as (
  select row, doc_id, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as pos from rows),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from split),
heavy as (select k, max(doc_id) as keeper from keyed where length(k) >= 40 group by k having count(distinct row) >= 5 and keeper is not null),
marked as (select s.*, h.k is not null and s.doc_id is distinct from h.keeper as gone from keyed s left join heavy h on s.k = h.k)
select doc_id, count(*) as n_lines, sum(gone::int)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by row, doc_id
"""


@query
def op9_source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op6_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade_toxicity(docs, model).drop("text")


@query
def op1_secret_scan(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@query
def op3_decontamination(spark, sf_dir):
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op3_decontamination"] = r"""
with words as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from documents),
sets as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
         from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from words where len(w) >= 5)),
item_words as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from benchmark),
item_sets as (select distinct item_id, array_to_string(w[i:i + 4], ' ') as s
              from (select item_id, w, unnest(range(1, len(w) - 3)) as i from item_words where len(w) >= 5)),
sizes as (select item_id, count(*)::int as item_size from item_sets group by item_id)
select doc_id, item_id, item_size, count(*)::int as shared, count(*) / item_size as containment
from sets join item_sets using (s) join sizes using (item_id) group by doc_id, item_id, item_size
having count(*) >= ceil(item_size * 0.8)
"""


@query
def op5_url_filter(spark, sf_dir):
    return urls.filter_urls(table(spark, sf_dir, "pages"))


ORACLES["op5_url_filter"] = r"""
with rest as (select page_id, html, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) as r from pages),
parts as (select page_id, html, translate(regexp_extract(r, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                 regexp_extract(r, '(?s)^[^/?#]*([^?#]*)', 1) as path from rest),
rules(h, p, says) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                             ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit as (select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(says, length(h || p)) as says
        from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id),
listed as (select host || path as key, bool_or(len(regexp_extract_all(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '[^\x20\x09-\x0D]+')) < 100) as listed
           from parts group by 1)
select page_id, host, path, rule, coalesce(says, case when listed then 'block' else 'allow' end) as verdict, listed
from parts join listed on host || path = key left join fit using (page_id)
"""


@query
def op7_ngram_join(spark, sf_dir):
    return ngram_join.ngram_classes(table(spark, sf_dir, "documents"))


ORACLES["op7_ngram_join"] = r"""
with recursive
words as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') as w from documents),
sets as (select distinct row, array_to_string(w[i:i + 2], ' ') as s
  from (select row, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from words where len(w) > 0)),
sizes as (select row, count(*) as n from sets group by row),
shared as (select a.row as x, b.row as y, count(*) as c from sets a join sets b on a.s = b.s and a.row < b.row group by 1, 2),
links as (select x, y from shared join sizes a on a.row = x join sizes b on b.row = y where 100 * c >= 90 * (a.n + b.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reach(x, y) as (select row, row from words union select reach.x, both_ways.y from reach join both_ways on reach.y = both_ways.x),
parts as (select x, min(doc_id) as component_id from reach join words on words.row = y group by x)
select doc_id, coalesce(n, 0) as n_shingles, (select count(*) from both_ways b where b.x = words.row) as n_links,
  component_id from words left join sizes using (row) join parts on parts.x = words.row
"""


@query
def op2_embedding_dedup(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op2_embedding_dedup"] = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
u as (select vec_id, e, sqrt(list_dot_product(e, e)) as n from v),
links as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id
          where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach(a, b) as (select vec_id, vec_id from v union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a as vec_id, min(b) as component_id from reach group by a)
select vec_id, (select count(*) from links where a = vec_id) as n_links, component_id, vec_id = component_id as kept from least
"""


@query
def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit_language(docs.where(language.fold() != 2))
    out = language.predict_language(docs, model)
    return out.select("doc_id", (language.fold() == 2).alias("held_out"), "lang_pred", "score")


@query
def op11_merkle_manifest(spark, sf_dir):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.dataset_manifest(table(spark, sf_dir, "documents"), tampered).drop("source")


ORACLES["op11_merkle_manifest"] = r"""
with recursive
crc as (
  select doc_id, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)) as flipped from documents),
fields as (
  select d.*, case when doc_id is null then '-' else strlen(doc_id::varchar) || ':' || doc_id end
      || case when source is null then '-' else strlen(source) || ':' || source end
      || case when lang is null then '-' else strlen(lang) || ':' || lang end
      || case when n_chars is null then '-' else strlen(n_chars::varchar) || ':' || n_chars end as head,
    case when xor(flipped, 4294967295) % 2 = 0 then replace(text, chr(10), '') else text end as probe
  from documents d join crc using (doc_id)),
leaves as (
  select doc_id, coalesce('s' || source, '') as grp, sha256(head || case when text is null then '-' else strlen(text) || ':' || text end) as leaf,
    sha256(head || case when probe is null then '-' else strlen(probe) || ':' || probe end) as probe,
    row_number() over (partition by source order by doc_id) - 1 as pos, count(*) over (partition by source) as n from fields),
low(grp, lev, pos, h, n) as (
  select grp, 0, pos, leaf, n from leaves
  union all
  select grp, lev + 1, pos // 3, sha256(string_agg(h, '' order by pos)), any_value((n + 2) // 3) from low where n > 1 group by grp, lev, pos // 3),
subs as (select grp, h as subroot, row_number() over (order by grp) - 1 as pos, count(*) over () as n from low where n = 1),
high(lev, pos, h, n) as (
  select 0, pos, subroot, n from subs
  union all
  select lev + 1, pos // 3, sha256(string_agg(h, '' order by pos)), any_value((n + 2) // 3) from high where n > 1 group by lev, pos // 3),
steps as (
  select l.doc_id, 0 as tree, s.lev, coalesce(string_agg(s.h, '' order by s.pos) filter (where s.pos < l.pos // (3 ** s.lev)::bigint), '') as lft,
    coalesce(string_agg(s.h, '' order by s.pos) filter (where s.pos > l.pos // (3 ** s.lev)::bigint), '') as rgt
  from leaves l join low s on s.grp = l.grp and s.n > 1 and s.pos // 3 = l.pos // (3 ** (s.lev + 1))::bigint group by l.doc_id, s.lev
  union all
  select l.doc_id, 1, s.lev, coalesce(string_agg(s.h, '' order by s.pos) filter (where s.pos < u.pos // (3 ** s.lev)::bigint), ''),
    coalesce(string_agg(s.h, '' order by s.pos) filter (where s.pos > u.pos // (3 ** s.lev)::bigint), '')
  from leaves l join subs u using (grp) join high s on s.n > 1 and s.pos // 3 = u.pos // (3 ** (s.lev + 1))::bigint group by l.doc_id, s.lev),
paths as (select doc_id, list(lft || '|' || rgt order by tree, lev) as path from steps group by doc_id),
folded as (
  select doc_id, leaf, subroot, sha256(array_to_string(list_transform(coalesce(path, []), lambda p: replace(p, '|', '')), '')) as proof_sha256,
    list_reduce(list_prepend(probe, coalesce(path, [])), lambda a, p: sha256(split_part(p, '|', 1) || a || split_part(p, '|', 2))) as folded_root
  from leaves join subs using (grp) left join paths using (doc_id))
select doc_id, leaf, subroot, h as root, proof_sha256, folded_root, folded_root = h as verified
from folded, (select h from high where n = 1)
"""


@query
def op12_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


@query
def op13_lexical_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_lexical_search"] = r"""
with words as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from documents),
sizes as (select doc_id, count(*) as n from words group by doc_id),
whole as (select count(*) as nd, sum(n)::bigint as l from sizes),
item_terms as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
tfs as (select doc_id, t, count(*) as tf from words where t in (select t from item_terms) group by doc_id, t),
weights as (select t, floor(1000 * ln((2 * nd + 2)::double / (2 * count(*) + 1)))::bigint as w from tfs, whole group by t, nd),
impacts as (select doc_id, t, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nd) // l))) as impact from tfs join sizes using (doc_id), whole),
scores as (select item_id, doc_id, sum(w * impact)::bigint as score from item_terms join weights using (t) join impacts using (t) group by item_id, doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50
"""
