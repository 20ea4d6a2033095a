"""The registered queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.llm import bpe, decontaminate, divergence, embed_dups, exact_dedup, html_wrap, jaccard_join, langid, learning, licenses, prefix_trie, quality, shards, toxicity
from tickloom.llm.common import crc_mod, query, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_bpe")
def op4_bpe(spark, sf_dir):
    """Token counts and digests of ids and decoded text of every document."""
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def _license_sql() -> str:
    def sql_list(words):
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    phrases = ", ".join(f"('{label}', {sql_list(p.split())})" for p, label in licenses.PHRASES.items())
    templates = ", ".join(f"('{label}', {sql_list(sorted(set(t.split())))})" for label, t in licenses.TEMPLATES.items())
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
with low as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, {word}) as words from low),
phrases(label, p) as (values {phrases}),
templates(label, p) as (values {templates}),
places as (
  select doc_id, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1] = p[1] and words[i + 1 : i + len(p)] = p)) as pos
  from w, phrases),
base as (
  select doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list(distinct label) as found from places group by 1),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line from w),
blocks as (
  select doc_id, label, len(list_intersect(list_distinct(regexp_extract_all(line, {word})), p)) / len(p)::double as share from lines, templates),
matched as (select doc_id, list(distinct label) as found, max(share) as share from blocks where share >= {licenses.THRESHOLD} - 1e-9 group by 1)
select w.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base.found), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.found, []), coalesce(matched.found, [])))), ','), '') as labels,
       case when n_base > 0 then 1.0::double else coalesce(share, 0.0::double) end as score
from w left join base using (doc_id) left join matched using (doc_id)"""


@query("op5_licenses", _license_sql())
def op5_licenses(spark, sf_dir):
    """License phrases and template matches of every document."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("blocks").withColumnRenamed("id", "doc_id")


@query("op9_language")
def op9_language(spark, sf_dir):
    """Predicted language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    prototypes = langid.learn(docs.where(~F.coalesce(held, F.lit(False))))
    found = langid.predict(docs, prototypes).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op10_shards")
def op10_shards(spark, sf_dir):
    """Eight shards of near equal bytes."""
    placed = shards.kd_shards(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_JACCARD_SQL = f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^ \t-\r]+') as words from documents),
s as (
  select doc_id, list_distinct(case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
         else list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i : i + 2], ' ')) end) as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as x from s),
ids as (select x, dense_rank() over (order by x) as xi from (select distinct x from e)),
p as (select doc_id, n, xi from e join ids using (x)),
links as (
  select a.doc_id as a, b.doc_id as b from p a join p b on a.xi = b.xi and a.doc_id < b.doc_id and a.n * 100 >= b.n * 90 and b.n * 100 >= a.n * 90
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select doc_id, doc_id from documents union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a)
select doc_id, cast(len(sh) as bigint) as n_shingles, c.component_id from s join (select a as doc_id, min(b) as component_id from reach group by 1) c using (doc_id)"""


@query("op7_jaccard", _JACCARD_SQL)
def op7_jaccard(spark, sf_dir):
    """Near-duplicate classes of every document: three words, similarity 0.9."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=90, den=100).withColumnRenamed("id", "doc_id")


_EMBEDDING_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as x from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0
    and len(list_filter(embedding, lambda e: e <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x)
  where list_cosine_similarity(a.x, b.x) >= 0.98),
reach(a, b) as (select vec_id, vec_id from embeddings union select reach.a, links.b from reach join links on reach.b = links.a),
c as (select a as vec_id, min(b) as component_id from reach group by 1),
n as (select a as vec_id, count(*) as n_links from links group by 1)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from c left join n using (vec_id)"""


@query("op6_embeddings", _EMBEDDING_SQL)
def op6_embeddings(spark, sf_dir):
    """Links and classes of every vector at cosine 0.98 within its label."""
    found = embed_dups.link(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


_WHITE = "'[^ \\t-\\r]+'"


def _shingle_sql(name: str, source: str, key: str) -> str:
    return f"""
{name}_w as (select {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {_WHITE}) as words from {source}),
{name} as (
  select {key}, list_distinct(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
         else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) end) as sh from {name}_w)"""


_LEAK_SQL = f"""
with {_shingle_sql('docs', 'documents', 'doc_id')},
{_shingle_sql('items', 'benchmark', 'item_id')},
wanted as (select item_id, len(sh) as n_item, unnest(sh) as x from items),
have as (select doc_id, unnest(sh) as x from docs)
select doc_id, item_id, cast(n_item as bigint) as n_item, count(*) as n_common, count(*) / n_item::double as containment
from wanted join have using (x) group by doc_id, item_id, n_item having count(*) >= 0.8 * n_item - 1e-9"""


@query("op3_decontamination", _LEAK_SQL)
def op3_decontamination(spark, sf_dir):
    """Documents that hold four fifths or more of a test item's five-word shingles."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def not_held_out():
    """Which rows of a label table (key k) classifiers may learn from."""
    return crc_mod(F.col("k"), 3) != 1


def _classified(spark, sf_dir, module, target: str, threshold: float):
    docs = table(spark, sf_dir, "documents")
    net = module.train(*learning.labelled_sample(docs, table(spark, sf_dir, "labels"), target, not_held_out(), module.PER_CLASS))
    held = F.coalesce(crc_mod(F.col("id"), 3) == 1, F.lit(False))
    return module.score(docs, net).select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    """Toxicity of every document."""
    return _classified(spark, sf_dir, toxicity, "toxic", 0.7)


@query("op2_quality")
def op2_quality(spark, sf_dir):
    """Quality of every document."""
    return _classified(spark, sf_dir, quality, "quality", 0.5)


_PAGES_SQL = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) as body from pages),
b as (select page_id, generate_subscripts(parts, 1) as nth, unnest(parts) as part from (select page_id, regexp_split_to_array(body, '</?(p|h1)>') as parts from a)),
c as (
  select page_id, nth, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(part, '<[^>]*>', '', 'g'),
         '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) as block from b),
d as (select page_id, string_agg(block, chr(10) order by nth) as text from c where block <> '' group by 1)
select a.page_id, a.url, coalesce(text, '') as text, cast(length(coalesce(text, '')) as bigint) as n_chars from a left join d using (page_id)"""


@query("op8_pages", _PAGES_SQL)
def op8_pages(spark, sf_dir):
    """Main text of every page."""
    found = html_wrap.main_text(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


_DEDUP_SQL = r"""
with n as (select doc_id, length(coalesce(text, '')) as n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body from documents),
g as (select *, row_number() over (partition by body order by n_chars desc, doc_id) as nth, first_value(doc_id) over (partition by body order by n_chars desc, doc_id) as keep_id,
  count(*) over (partition by body) as group_size from n)
select doc_id, keep_id, group_size, nth = 1 as kept, sha256(body) as text_sha256 from g"""


@query("op12_exact_dedup", _DEDUP_SQL)
def op12_exact_dedup(spark, sf_dir):
    """Which document of every group of equal texts stays."""
    return exact_dedup.duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


_AUDIT_SQL = rf"""
with d as (select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
w as (select doc, lang, source, unnest(words) as term from d),
kept as (select lang, term from w group by 1, 2 having count(distinct doc) >= 10),
v as (select lang, count(*)::hugeint as v from kept group by 1),
groups as (select lang, source, coalesce(v, 0)::hugeint as v from (select distinct lang, source from d) left join v using (lang)),
c as (select lang, source, term, count(*)::hugeint as n from w join kept using (lang, term) group by 1, 2, 3),
total as (select groups.lang, groups.source, any_value(v) as v, coalesce(sum(n), 0)::hugeint as total from groups left join c using (lang, source) group by 1, 2),
p as (select total.lang, total.source, term, coalesce(n, 0) as n, (1 + (1000000000::hugeint * (coalesce(n, 0) + 2)) // (total + 2 * v))::hugeint as p
  from total join kept using (lang) left join c using (lang, source, term)),
q as (select lang, term, (1 + (1000000000::hugeint * (sum(n) + 2)) // ((select sum(total) from total t where t.lang = p.lang) + 2 * (select any_value(v) from total t where t.lang = p.lang)))::hugeint as q
  from p group by lang, term),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
every as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source),
terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from p join q using (lang, term) where n > 0 and p > q)
select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from (select * from every union all select * from terms)
qualify part = 'pair' or rank <= 10"""


@query("op13_divergence", _AUDIT_SQL)
def op13_divergence(spark, sf_dir):
    """How far each two sources of a language stand apart, and the words that mark a source."""
    return divergence.audit(table(spark, sf_dir, "documents"))


_TRIE_SQL = r"""
with o as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, count(*) over (partition by conv_id) as n,
  {'r': coalesce(role, ''), 't': coalesce(text, '')} as turn from conversations where conv_id is not null),
crc as (select c, xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, len(c::varchar) + 1), lambda k: ascii(substring(c::varchar, k::int, 1))::ubigint)),
  lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), list_transform(range(8), lambda z: 0::ubigint)), lambda a, z: case when a % 2 = 1 then xor(a // 2, 3988292384::ubigint) else a // 2 end))) as code
  from (select distinct conv_id as c from conversations where conv_id is not null)),
lists as (select c, list(turn order by i) as own from o group by c),
whole as (select l.c, list_concat(coalesce(b.own, [])[1 : (code % 4)::bigint], l.own[(code % 4)::bigint + 1 :]) as turns
  from lists l join crc using (c) left join lists b on b.c = l.c - l.c % 20),
path as (select c, d::bigint as d, turns[1 : d] as prefix, len(turns) = d as ends, len(turns) as total from (select c, turns, unnest(range(0, len(turns) + 1)) as d from whole)),
node as (select prefix, d, min(c) as m, count(*) as n_convs, case when d = 0 then 0 else len(regexp_extract_all(any_value(prefix[d].t), '[^\x20\x09-\x0D]+')) end as words,
  sha256(coalesce(string_agg(case when ends then c::varchar end, ',' order by c), '')) as ends_sha256 from path group by prefix, d),
named as (select path.c, path.d, node.m, n_convs, words, ends_sha256 from path join node on path.prefix = node.prefix and path.d = node.d),
edges as (select distinct a.m, a.d, b.m as child from named a join named b on a.c = b.c and b.d = a.d + 1),
kids as (select m, d, count(*) as n_children from edges group by 1, 2),
parent as (select child as m, d + 1 as d, m as parent from edges),
below as (select distinct a.m, a.d, b.m as um, b.d as ud, b.n_convs, b.words from named a join named b on a.c = b.c and b.d >= a.d),
sums as (select b.m, b.d, sum((b.n_convs - 1) * b.words)::bigint as saved_tokens, count(*) filter (kids.m is null) as n_leaves
  from below b left join kids on kids.m = b.um and kids.d = b.ud group by 1, 2)
select n.m as conv_id, n.d as depth, parent.parent as parent_conv_id, n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, ends_sha256
from node n join sums on sums.m = n.m and sums.d = n.d left join kids on kids.m = n.m and kids.d = n.d left join parent on parent.m = n.m and parent.d = n.d"""


@query("op11_prefix_trie", _TRIE_SQL)
def op11_prefix_trie(spark, sf_dir):
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))
