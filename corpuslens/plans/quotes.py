"""Quotation queries: gates, badges, anchoring, re-finding, markers, lines and contexts over documents and benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import anchoring, gates
from .base import Registry, Tables

R = Registry()


def _quotes(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))


def _extractions(t: Tables) -> DataFrame:
    """Passages found in documents, each as it stands and as a copy whose span is a code point too late."""
    found = anchoring.hits(t.documents.select("doc_id", "text"), _quotes(t))
    start = (F.instr("text", F.col("quote")) - 1).cast("long")
    copies = found.select("doc_id", "quote_id", "quote", start.alias("start"), F.length("quote").alias("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("shift"))
    key = F.concat_ws("-", F.lit("ext"), "doc_id", "quote_id", "shift")
    return copies.select(key.alias("extraction_id"), F.col("doc_id").cast("string").alias("representation_ref"), F.lit("char_range").alias("locator_type"), (F.col("start") + F.col("shift")).alias("c_start"), (F.col("start") + F.col("shift") + F.col("n")).alias("c_end"), F.col("quote").alias("direct_quote"), "doc_id", "quote_id", "shift")


def _reps(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").cast("string").alias("representation_id"), "text", F.lit(True).alias("utf8_ok"), "source")


EXT_SQL = """
ext as (
  select 'ext-' || d.doc_id || '-' || b.item_id || '-' || s.shift as extraction_id, d.doc_id, d.source, d.text, b.text as quote, instr(d.text, b.text) - 1 + s.shift as c_start,
    instr(d.text, b.text) - 1 + s.shift + length(b.text) as c_end from documents d join benchmark b on contains(d.text, b.text), (values (0), (1)) s(shift)),
gate as (
  select *, case when c_end > length(text) then 'locator_range_invalid' when substr(text, c_start + 1, c_end - c_start) <> quote then 'quote_gate_failed' end as code from ext)"""


@R.add(f"with {EXT_SQL} select extraction_id, code, case when code = 'quote_gate_failed' then instr(text, quote) - 1 end as drift from gate")
def gate_hop_b(t: Tables) -> DataFrame:
    return gates.hop_b(_extractions(t), _reps(t))


@R.add("select doc_id, sha256(text) as actual from documents where doc_id % 7 = 3 and text is not null")
def gate_hop_a(t: Tables) -> DataFrame:
    """Stored hashes in several spellings; every seventh document's is of another text."""
    stored = F.sha2(F.when(F.pmod("doc_id", F.lit(7)) == 3, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256)
    spelled = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.lit("SHA256:"), F.upper(stored))).otherwise(stored)
    return gates.hop_a(t.documents.withColumn("sha256", spelled), "sha256", "text").select("doc_id", F.sha2("text", 256).alias("actual"))


@R.add(f"""
with {EXT_SQL}, b as (select case when code is not null then 'failed' when doc_id % 3 = 0 then 'verified-to-transcript' when doc_id % 3 = 1 then 'verified-to-rewrite' else 'verified' end as badge from gate)
select badge, count(*) as n from b group by badge""")
def gate_badge(t: Tables) -> DataFrame:
    """A third of the documents counts as transcripts, a third as texts that a model made from texts."""
    kind = F.pmod("doc_id", F.lit(3))
    media = F.lit("text/plain")
    reps = t.documents.select(F.col("doc_id").cast("string").alias("representation_id"), F.when(kind == 0, "transcript").otherwise("reading").alias("role"), media.alias("media_type"), F.when(kind == 1, "model").otherwise("conversion").alias("method"), F.when(kind == 1, F.col("doc_id").cast("string")).alias("parent_representation_ref"))
    found = gates.hop_b(_extractions(t), _reps(t), "direct_quote", "locator_type", "representation_ref").join(gates.derivations(reps), F.col("representation_ref") == F.col("representation_id"))
    badge = gates.badge(F.col("direct_quote"), media, F.lit(True), F.col("locator_type"), F.col("code"), F.col("derived"), F.col("rewritten"))
    return found.groupBy(badge.alias("badge")).agg(F.count("*").alias("n"))


@R.add(f"with {EXT_SQL} select 'failed' as status, 0 as level from gate where code is not null having count(*) > 0 union all select 'passed', 1 from gate having count(code) = 0")
def gate_findings_level(t: Tables) -> DataFrame:
    found = gates.hop_b(_extractions(t), _reps(t)).where("code is not null").select("code", F.lit("error").alias("severity"), F.lit(1).alias("level"))
    return gates.level(found, F.lit(False), F.lit(True))



_PROPOSED = """
hit as (select d.doc_id, b.item_id, d.text, b.text as quote from documents d join benchmark b on contains(d.text, b.text)),
made as (select doc_id, item_id as quote_id, text, quote from hit union all select doc_id, item_id + 1000000, text, quote || chr(7) from hit union all select doc_id, item_id + 2000000, text, '' from hit union all select doc_id, item_id + 3000000, text, left(quote, 2) from hit),
again as (select *, case when quote = '' then 0 else instr(text, quote) end as p, quote <> '' and contains(substr(text, instr(text, quote) + 1), quote) as more from made),
status as (select doc_id, quote_id, p, case when quote = '' then 'invalid' when p = 0 then 'not_found' when more then 'ambiguous' else 'anchored' end as status from again)"""


def _proposed(t: Tables) -> DataFrame:
    """Passages that stand in a document as they are, with a strange end, as nothing, and cut to two letters."""
    found = anchoring.hits(t.documents.select("doc_id", "text"), _quotes(t))
    forms = [(0, F.col("quote")), (1, F.concat("quote", F.lit("\a"))), (2, F.lit("")), (3, F.substring("quote", 1, 2))]
    return found.select("doc_id", F.explode(F.array(*[F.struct((F.col("quote_id") + i * 1_000_000).alias("quote_id"), q.alias("quote")) for i, q in forms])).alias("x")).select("doc_id", "x.*")


@R.add(f"with {_PROPOSED} select doc_id, quote_id, status, case when status = 'anchored' then p - 1 end as start from status")
def anchor_status(t: Tables) -> DataFrame:
    return anchoring.anchor(t.documents, _proposed(t)).select("doc_id", "quote_id", "status", "start")


@R.add(f"with {_PROPOSED} select status, count(*) as n from status group by status")
def anchor_tally(t: Tables) -> DataFrame:
    return anchoring.tally(anchoring.anchor(t.documents, _proposed(t)))


_FIRST = "split_part(text, chr(10), 1)"


@R.add(f"""
with c as (select doc_id, text, replace({_FIRST}, ' ', '  ') as q from documents where text is not null),
n as (select *, trim(regexp_replace(q, '[\\s\\x{{A0}}]+', ' ', 'g')) as needle, regexp_replace(regexp_replace(text, '-[ \\t]*[\\r\\n]\\s*(\\p{{Ll}})', '\\1', 'g'), '[\\s\\x{{A0}}]+', ' ', 'g') as hay from c)
select doc_id, case when needle = '' then 'not_found' when contains(substr(hay, instr(hay, needle) + 1), needle) then 'ambiguous' else 'refound' end as status from n""")
def refind_normalized(t: Tables) -> DataFrame:
    """Each document's first line with its blanks doubled, found again with typesetting undone."""
    q = F.replace(F.substring_index("text", "\n", 1), F.lit(" "), F.lit("  "))
    return t.documents.where("text is not null").select("doc_id", tx.refind_status(F.col("text"), q)["status"].alias("status"))


@R.add("""
select doc_id, n as n_lines, p as first_line_chars, first, last from (
  select doc_id, len(string_split(text, chr(10))) - case when text like '%' || chr(10) then 1 else 0 end as n, length(split_part(text, chr(10), 1)) as p,
    length(left(text, length(text) // 2)) - length(replace(left(text, length(text) // 2), chr(10), '')) + 1 as first,
    length(left(text, greatest(length(text) // 2, length(text) - 1))) - length(replace(left(text, greatest(length(text) // 2, length(text) - 1)), chr(10), '')) + 1 as last from documents)""")
def line_range(t: Tables) -> DataFrame:
    """The lines of each document's second half."""
    n = F.length("text")
    where = tx.line_range(F.col("text"), F.floor(n / 2).cast("int"), n)
    return t.documents.select("doc_id", F.size(tx.text_lines(F.col("text"))).cast("long").alias("n_lines"), F.length(F.substring_index("text", "\n", 1)).cast("long").alias("first_line_chars"), where["first"].cast("long").alias("first"), where["last"].cast("long").alias("last"))


@R.add("""
select d.doc_id, b.item_id, sha256(substr(d.text, greatest(0, s - 200) + 1, least(length(d.text), s + length(b.text) + 260) - greatest(0, s - 200))) as context
from (select *, 0 as z from documents) d join benchmark b on contains(d.text, b.text), lateral (select instr(d.text, b.text) - 1 as s)""")
def context_window_cp(t: Tables) -> DataFrame:
    found = anchoring.hits(t.documents.select("doc_id", "text"), _quotes(t))
    start = F.instr("text", F.col("quote")) - 1
    return found.select("doc_id", F.col("quote_id").alias("item_id"), F.sha2(tx.context(F.col("text"), start, start + F.length("quote"), 200, 260), 256).alias("context"))


def _outputs(t: Tables) -> DataFrame:
    """A derived text for each item. It cites the item's own passage in a fence, and, by the item's number: a wrong wording inline, an id
    nobody has, and one to three quotations without a marker. Every third passage is superseded, every fifth retracted, every seventh
    has no quotation."""
    ext = lambda c: F.concat(F.lit("ext-"), F.lower(F.lpad(F.hex(c), 12, "0")))
    i = F.col("item_id")
    first = F.regexp_replace(F.substring_index("text", " ", 1), "[\n\"]", "-")
    wrong = F.when(i % 2 == 0, F.concat(F.lit('Then "'), first, F.lit('" ['), ext(i), F.lit("] too.\n"))).otherwise("")
    none = F.when(i % 4 < 2, F.concat(F.lit('And "'), first, F.lit('"['), ext(i + 1_000_000), F.lit("].\n"))).otherwise("")
    loose = F.repeat(F.lit('But "nobody cites this long sentence".\n'), (i % 3 + 1).cast("int"))
    text = F.concat(F.lit("```quote "), ext(i), F.lit("\n"), F.col("text"), F.lit("\n```\n"), wrong, none, loose, F.lit('A "short" word.'))
    status = F.when(i % 5 == 0, "retracted").when(i % 3 == 0, "superseded").otherwise("active")
    return t.benchmark.select(i.alias("object_id"), text.alias("output_text"), ext(i).alias("extraction_id"), F.when(i % 7 != 0, F.col("text")).alias("direct_quote"), status.alias("status"))


@R.add("""
select item_id as object_id, 1 + (item_id % 2 = 0)::int + (item_id % 4 < 2)::int as n_markers, 1 as n_blocks, cast(item_id % 3 + 1 as integer) as n_uncited, sha256(text) as block from benchmark""")
def markers(t: Tables) -> DataFrame:
    m = tx.quote_markers(F.col("output_text"))
    return _outputs(t).select("object_id", F.size(m).alias("n_markers"), F.size(F.filter(m, lambda x: x["form"] == "block")).alias("n_blocks"), F.size(tx.uncited_quotes(F.col("output_text"))).alias("n_uncited"), F.sha2(m[0]["quote"], 256).alias("block"))


@R.add("""
with m as (select item_id, 'block' as form, true as same, true as known from benchmark union all select item_id, 'inline', false, true from benchmark where item_id % 2 = 0 union all select item_id, 'inline', false, false from benchmark where item_id % 4 < 2),
c as (select item_id as object_id, form, case when not known then 'output_cites_unknown_extraction' when item_id % 7 = 0 then 'cited_extraction_not_quotable' when not same then 'output_quote_mismatch'
  when item_id % 5 = 0 then 'cites_retracted' when item_id % 3 = 0 then 'cites_superseded' end as code from m)
select object_id, form, code, case when code = 'cites_superseded' then 'warning' else 'error' end as severity from c where code is not null""")
def gate_hop_c(t: Tables) -> DataFrame:
    out = _outputs(t)
    return gates.hop_c(out, out).select("object_id", "form", "code", "severity")


@R.add("select doc_id, len(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) as n_numbers, array_to_string(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*'), ' ') as numbers from documents where text is not null")
def printed_numbers(t: Tables) -> DataFrame:
    n = tx.numbers(F.col("text"))
    return t.documents.where("text is not null").select("doc_id", F.size(n).cast("long").alias("n_numbers"), F.array_join(n, " ").alias("numbers"))


_HIDDEN = "select item_id, text as hidden from benchmark union all select item_id + 1000000, left(text, length(text) // 2) || repeat('@', length(text) // 2) from benchmark union all select item_id + 2000000, left(text, length(text) * 3 // 4) || repeat('#', length(text) // 4) from benchmark union all select item_id + 3000000, left(text, 30) from benchmark"


@R.add(f"""
with h0 as ({_HIDDEN}), h as (select item_id, trim(regexp_replace(hidden, '[\\s\\x{{A0}}]+', ' ', 'g')) as hidden from h0),
t as (select doc_id, trim(regexp_replace(text, '[\\s\\x{{A0}}]+', ' ', 'g')) as text from documents), w as (select item_id, hidden, unnest(case when length(hidden) >= 40 then range(1, length(hidden) - 40 + 2, 20) when length(hidden) >= 20 then [1] else [] end) as i from h),
n as (select item_id, count(*) as n from w group by 1), f as (select d.doc_id, w.item_id, count(*) as m from w join t d on contains(d.text, substr(w.hidden, w.i, 40)) group by 1, 2)
select doc_id, item_id, m as found, n as windows from f join n using (item_id) where m >= 0.6 * n""")
def leak_check(t: Tables) -> DataFrame:
    """Hidden passages of which 60 % of the windows stand in a document: whole ones, ones with half or a quarter spoilt, and short ones."""
    n = F.length("text")
    half, most = F.floor(n / 2).cast("int"), F.floor(n * 3 / 4).cast("int")
    left = lambda k: F.substring(F.col("text"), F.lit(1), k)
    forms = [F.col("text"), F.concat(left(half), F.repeat(F.lit("@"), half)), F.concat(left(most), F.repeat(F.lit("#"), F.floor(n / 4).cast("int"))), left(F.lit(30))]
    hidden = t.benchmark.select(F.explode(F.array(*[F.struct((F.col("item_id") + i * 1_000_000).alias("item_id"), x.alias("hidden")) for i, x in enumerate(forms)])).alias("x")).select("x.*")
    return gates.leaks(t.documents.select("doc_id", "text"), hidden)


@R.add("""
select doc_id, len(s) as n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) as longest from (
  select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as s from documents where text is not null)""")
def sentence_split(t: Tables) -> DataFrame:
    s = tx.sentences(F.col("text"))
    return t.documents.where("text is not null").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform(s, F.length)), F.lit(0)).cast("long").alias("longest"))


@R.add("""
with c as (select conv_id, turn, text, conv_id * 100 + turn as k from conversations where length(text) >= 60 and not regexp_matches(text, '[\u2026]|[.][.][.]')),
q as (select *, case k % 6 when 0 then substr(text, 3, 40) when 1 then replace(left(text, 40), ' ', '  ') when 2 then left(text, 20) || ' ... ' || right(text, 20) when 3 then '' when 4 then left(text, 30) || chr(7) || '?' else left(text, 1) end as raw from c),
t as (select *, trim(raw) as q, lower(regexp_replace(text, '\\s+', ' ', 'g')) as hay from q)
select conv_id, turn, case when q = '' then 'missing' when contains(text, q) then case when contains(substr(text, instr(text, q) + 1), q) then 'ambiguous' else 'exact' end
  when contains(hay, trim(lower(regexp_replace(q, '\\s+', ' ', 'g')))) then 'normalized' when k % 6 = 2 then 'elided' else 'not found' end as status from t""")
def quote_check(t: Tables) -> DataFrame:
    """Each turn quoted in six ways: a piece, with doubled blanks, with words left out, not at all, wrongly, and by its first letter."""
    rows = t.conversations.where((F.length("text") >= 60) & ~F.col("text").rlike("[\u2026]|[.][.][.]"))
    k = (F.col("conv_id") * 100 + F.col("turn")) % 6
    left = lambda n: F.substring("text", 1, n)
    quote = F.when(k == 0, F.substring("text", 3, 40)).when(k == 1, F.replace(left(40), F.lit(" "), F.lit("  "))).when(k == 2, F.concat(left(20), F.lit(" ... "), F.right("text", F.lit(20)))).when(k == 3, "").when(k == 4, F.concat(left(30), F.lit("\a?"))).otherwise(left(1))
    return rows.select("conv_id", "turn", tx.quote_check(F.col("text"), quote).alias("status"))
