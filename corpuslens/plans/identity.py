"""Identity queries: each mints ids over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ident
from .base import Registry, Tables

R = Registry()
DOC_SRC = "'src-' || left(sha256('src' || chr(10) || 'sha256:' || sha256(text)), 12)"
DOC_REP = "'rep-' || left(sha256(text), 12)"


@R.add(f"select doc_id, {DOC_REP} as rep_id, 'img-' || left(sha256(text), 12) as img_id from documents")
def id_rep(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ident.mint_rep_id(F.col("text")).alias("rep_id"), ident.mint_rep_id(F.col("text"), "img-").alias("img_id"))


@R.add(f"select doc_id, {DOC_SRC} as src_id from documents")
def id_src_bytes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ident.mint_src_id(F.lit(None).cast("string"), ident.sha256_hex(F.col("text"))).alias("src_id"))


@R.add(f"""
select d.doc_id, b.item_id, 'ext-' || left(sha256(concat_ws(chr(10), 'ext', {DOC_SRC.replace("text", "d.text")}, {DOC_REP.replace("text", "d.text")},
  '{{"representation_ref":"' || {DOC_REP.replace("text", "d.text")} || '","type":"char_range","value":{{"end":' || (instr(d.text, b.text) - 1 + length(b.text)) || ',"start":' || (instr(d.text, b.text) - 1) || '}}}}',
  b.text)), 12) as ext_id
from documents d join benchmark b on contains(d.text, b.text)""")
def id_ext(t: Tables) -> DataFrame:
    from ..operators.anchoring import hits

    found = hits(t.documents.select("doc_id", "text"), t.benchmark.select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")))
    start = F.instr("text", F.col("quote")) - 1
    rep = ident.mint_rep_id(F.col("text"))
    src = ident.mint_src_id(F.lit(None).cast("string"), ident.sha256_hex(F.col("text")))
    locator = ident.char_range_json(rep, start, start + F.length("quote"))
    return found.select("doc_id", F.col("quote_id").alias("item_id"), ident.mint_ext_id(src, rep, locator, F.col("quote")).alias("ext_id"))


@R.add("""
select doc_id, 'cod-' || left(sha256(concat_ws(chr(10), 'cod', 'cbk-000000000001', 'source', cast(doc_id as varchar), 'rater', '{"code":"q' || quality || '"}')), 12) as coded,
  'cod-' || left(sha256(concat_ws(chr(10), 'cod', 'cbk-000000000001', 'source', cast(doc_id as varchar), 'rater', '{"value":' || toxic || '}')), 12) as valued from labels""")
def id_cod(t: Tables) -> DataFrame:
    mint = lambda code, value: ident.mint_cod_id(F.lit("cbk-000000000001"), F.lit("source"), F.col("doc_id").cast("string"), F.lit("rater"), code, value)
    return t.labels.select("doc_id", mint(F.concat(F.lit("q"), F.col("quality").cast("string")), None).alias("coded"), mint(F.lit(None).cast("string"), F.col("toxic").cast("string")).alias("valued"))


@R.add("""
select o_custkey, case when n = 1 then one else 'sha256:' || sha256('{"inputs":[' || list || ']}') end as digest from (
  select o_custkey, count(*) as n, min('sha256:' || sha256(o_orderpriority || o_orderstatus)) as one,
    string_agg('{"id":"' || o_orderkey || '","sha256":"sha256:' || sha256(o_orderpriority || o_orderstatus) || '"}', ',' order by cast(o_orderkey as varchar)) as list
  from orders group by o_custkey)""")
def id_input_digest(t: Tables) -> DataFrame:
    inputs = F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("id"), ident.sha256_hex(F.concat("o_orderpriority", "o_orderstatus")).alias("sha256")))
    return t.orders.groupBy("o_custkey").agg(ident.input_digest(inputs).alias("digest"))


@R.add("""
select n_nationkey, 'gen-' || left(sha256('gen' || chr(10) || 'summary' || chr(10) || '["ext-' || n_regionkey || '","src-' || n_nationkey || '"]' || chr(10) || 'sha256:' || sha256(n_name)), 12) as gen_id,
  'syn-' || left(sha256('syn' || chr(10) || 'review' || chr(10) || n_name || chr(10) || '["ext-' || n_regionkey || '","src-' || n_nationkey || '"]'), 12) as syn_id,
  'cbk-' || left(sha256('cbk' || chr(10) || 'nations' || chr(10) || lower(n_name)), 12) as cbk_id from nation""")
def id_derived(t: Tables) -> DataFrame:
    ids = ident.collect_input_ids(F.array(F.concat(F.lit("src-"), F.col("n_nationkey"))), F.array(F.concat(F.lit("ext-"), F.col("n_regionkey"))))
    digest = F.concat(F.lit("sha256:"), ident.sha256_hex(F.col("n_name")))
    return t.nation.select("n_nationkey", ident.mint_gen_id(F.lit("summary"), ids, digest).alias("gen_id"), ident.mint_syn_id(F.lit("review"), F.col("n_name"), ids).alias("syn_id"), ident.mint_cbk_id(F.lit("nations"), F.lower("n_name")).alias("cbk_id"))


URL_SQL = r"""
with p as (
  select page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) as scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) as host,
    regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as query from pages),
q as (select *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: not (lower(split_part(x, '=', 1)) like 'utm\_%' escape '\' or
    lower(split_part(x, '=', 1)) in ('gclid', 'fbclid', 'msclkid', 'twclid', 'igshid', 'mc_cid', 'mc_eid', 'wbraid', 'gbraid')))), '&') as kept from p)
select page_id, scheme || '://' || regexp_replace(host, case scheme when 'http' then ':80$' else ':443$' end, '') ||
  case when path in ('', '/') then '/' else regexp_replace(path, '/+$', '') end || case when query <> '' and kept <> '' then '?' || kept else '' end as canonical from q"""


@R.add(URL_SQL)
def url_canonical(t: Tables) -> DataFrame:
    return ident.canonical_urls(t.pages.select("page_id", "url"), "url", "canonical").select("page_id", "canonical")


SLUG = "case when trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-') = '' then 'untitled' else regexp_replace(left(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-'), 60), '-+$', '') end"


@R.add(f"select p_partkey, {SLUG.format('p_name')} as slug from part")
def slug(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", ident.slugify(F.col("p_name"), ascii_only=True).alias("slug"))


@R.add(f"""
with s as (select p_partkey, {SLUG.format("p_brand || ' ' || p_type")} as base, 'src-' || left(sha256(cast(p_partkey as varchar)), 12) as id from part)
select p_partkey, case when row_number() over (partition by base order by p_partkey) = 1 then base else base || '--' || substr(id, 5, 6) end as slug from s""")
def id_slug_collision(t: Tables) -> DataFrame:
    """The first holder of a slug keeps it; the next ones get six digits of their id."""
    base = t.part.select("p_partkey", ident.slugify(F.concat_ws(" ", "p_brand", "p_type"), ascii_only=True).alias("base"), F.concat(F.lit("src-"), F.substring(ident.sha256_hex(F.col("p_partkey").cast("string")), 1, 12)).alias("id"))
    taken = F.row_number().over(Window.partitionBy("base").orderBy("p_partkey")) - 1
    return base.select("p_partkey", ident.slug_with_suffix(F.col("base"), F.col("id"), taken).alias("slug"))


@R.add("select text_sha, n_docs, first_doc from (select sha256(text) as text_sha, count(*) as n_docs, min(doc_id) as first_doc from documents group by 1) where n_docs > 1")
def rep_shared(t: Tables) -> DataFrame:
    """Representations that several sources share: equal hashes."""
    return t.documents.groupBy(ident.sha256_hex(F.col("text")).alias("text_sha")).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1")


@R.add("select l_orderkey, l_linenumber, count(*) as n, count(distinct sha256(l_partkey || ':' || l_suppkey)) as n_contents from lineitem group by 1, 2 having count(*) > 1")
def id_duplicate(t: Tables) -> DataFrame:
    """Ids held by several objects, and how many contents these have."""
    content = ident.sha256_hex(F.concat_ws(":", "l_partkey", "l_suppkey"))
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.countDistinct(content).alias("n_contents")).where("n > 1")


@R.add()
def pseudonyms(t: Tables) -> DataFrame:
    """Keyed hashes of names; SQL has no HMAC, tests hold them against one."""
    return t.customer.select("c_custkey", ident.pseudonym(F.col("c_name"), "corpus key").alias("pseudonym"))
