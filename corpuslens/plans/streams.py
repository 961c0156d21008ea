"""Queries on word streams, page maps, paginations, quotations made unique, furniture and other people's words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import alignment, furniture, pageplaces, speakers, widening
from .base import Registry, Tables

R = Registry()


def _heard(words: Column) -> Column:
    """The words as another engine might have heard them: some dropped, some doubled by a filler, some wrong."""

    def one(w: Column, i: Column) -> Column:
        wrong = F.when(i % 83 == 5, F.array(F.reverse(w))).otherwise(F.array(w))
        return F.when(i % 97 == 11, F.array().cast("array<string>")).when(i % 89 == 7, F.array(w, F.lit("um"))).otherwise(wrong)

    return F.flatten(F.transform(words, one))


def _versions(t: Tables) -> DataFrame:
    words = alignment.words(F.col("text"))
    return t.documents.select("doc_id", words.alias("a")).withColumn("b", _heard(F.col("a")))


@R.add()
def word_errors(t: Tables) -> DataFrame:
    """Error rates of altered documents; tests hold them against a quadratic table of lengths."""
    return alignment.error_rates(_versions(t), "doc_id")


@R.add()
def word_changes(t: Tables) -> DataFrame:
    """Every difference of a document and its altered version."""
    found = alignment.word_changes(_versions(t), "doc_id")
    return found.select("doc_id", "kind", "a_from", "b_from", F.array_join("ours", " ").alias("ours"), F.array_join("theirs", " ").alias("theirs"))


@R.add()
def engine_disputes(t: Tables) -> DataFrame:
    found = alignment.disputes(_versions(t), "doc_id", ("um", "uh"))
    return found.select("doc_id", "a_from", "b_from", F.array_join("ours", " ").alias("ours"), F.array_join("theirs", " ").alias("theirs"))


@R.add()
def correction_guard(t: Tables) -> DataFrame:
    """Turns corrected with more and less care than is allowed."""
    words = alignment.words(F.col("text"))
    rows = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("turn_id"), words.alias("a"))
    every = F.col("turn_id") % 7 + 2
    changed = F.transform("a", lambda w, i: F.when(i % every == 1, F.concat(w, F.lit("~"))).otherwise(w))
    return alignment.guard(rows.select("turn_id", "a", changed.alias("b"), (F.col("turn_id") % 5).alias("disputed")), "turn_id")


@R.add("""
with recursive c as (select o_custkey as g, o_orderkey as i, o_totalprice as v from orders),
r(g, i, v, n) as (select g, i, v, 1 from c union select c.g, c.i, c.v, r.n + 1 from r join c on c.g = r.g and c.i > r.i and c.v > r.v)
select g as o_custkey, s.n as common, s.n - cast(max(r.n) as bigint) as moved from r join (select g, count(*) as n from c group by g) s using (g) group by g, s.n""")
def moved_keys(t: Tables) -> DataFrame:
    """A customer's orders listed by key and by price: how many stand elsewhere."""
    by = lambda place: t.orders.select("o_custkey", F.col("o_orderkey").alias("name"), F.col(place).alias("place"))
    return alignment.moved_keys(by("o_orderkey"), by("o_totalprice"), "o_custkey", "name", "place")


_NUMBERED = "array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: case when i % 2 = 0 then x || chr(10) || case when i % 5 = 0 then '- ' || (i // 2) || ' / 90' else cast(i // 2 as varchar) end else x end), chr(10))"


@R.add(f"""
with recursive l as (select doc_id, string_split({_NUMBERED}, chr(10)) as l from documents),
p as (select doc_id, generate_subscripts(l, 1) as i, regexp_replace(unnest(l), '^[-–—/|\\s.]+|[-–—/|\\s.]+$', '', 'g') as x from l),
c as (select doc_id, i, cast(regexp_extract(x, '(?i)^([0-9]{{1,5}})(?:\\s*(?:/|of)\\s*[0-9]{{1,5}})?$', 1) as bigint) as v from p
  where length(x) <= 12 and regexp_matches(x, '(?i)^([0-9]{{1,5}})(?:\\s*(?:/|of)\\s*[0-9]{{1,5}})?$')),
r(doc_id, i, v, n) as (select doc_id, i, v, 1 from c union select c.doc_id, c.i, c.v, r.n + 1 from r join c on c.doc_id = r.doc_id and c.i > r.i and c.v > r.v and c.v <= r.v + 3)
select l.doc_id, len(l.l) as lines, coalesce(s.n, 0) as numbers, coalesce(m.n, 0) as longest
from l left join (select doc_id, count(*) as n from c group by 1) s using (doc_id) left join (select doc_id, cast(max(n) as bigint) as n from r group by 1) m using (doc_id)""")
def folio_runs(t: Tables) -> DataFrame:
    """Documents with page numbers behind every second line: how long their longest ascending chain is."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    page = lambda i: F.when((i + 1) % 5 == 0, F.concat(F.lit("- "), F.floor((i + 1) / 2), F.lit(" / 90"))).otherwise(F.floor((i + 1) / 2).cast("string"))
    numbered = F.transform(lines, lambda x, i: F.when(i % 2 == 1, F.concat(x, F.lit("\n"), page(i))).otherwise(x))
    found = alignment.folios(t.documents.select("doc_id", F.array_join(numbered, "\n").alias("text")), "doc_id")
    return found.select("doc_id", "lines", "numbers", "longest")


#: Code points of a page cut from a document.
PAGE = 1200


def _pages(t: Tables) -> DataFrame:
    """Documents cut into pages, with a running head and lines wrapped elsewhere."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - 1), F.lit(PAGE))
    rows = t.documents.where("text is not null").select("doc_id", "text", F.posexplode(starts).alias("page", "at"))
    own = F.substring(F.col("text"), F.col("at") + 1, F.lit(PAGE))
    wrapped = F.regexp_replace(own, "([^ ]+ [^ ]+ [^ ]+) ", "$1\n")
    return rows.select("doc_id", (F.col("page") + 1).cast("long").alias("page"), F.concat(F.lit("[ "), F.col("page") + 1, F.lit(" ]\n"), wrapped).alias("text"))


@R.add()
def page_places(t: Tables) -> DataFrame:
    """Where pages cut from the documents begin in them; tests hold places against where they were cut."""
    return pageplaces.locate_pages(t.documents.select("doc_id", "text"), _pages(t), "doc_id")


@R.add()
def page_maps(t: Tables) -> DataFrame:
    return pageplaces.page_health(pageplaces.locate_pages(t.documents.select("doc_id", "text"), _pages(t), "doc_id"), "doc_id")


@R.add(f"""
with d as (select doc_id, text, unnest(range(0, greatest(1, length(text)), {PAGE})) as o from documents where text is not null),
p as (select doc_id, o // {PAGE} + 1 as page, regexp_replace(substr(text, o + 1, {PAGE}), '[^\\p{{L}}]+', '', 'g') as own from d),
w as (select *, lead(own) over (partition by doc_id order by page) as n from p),
s as (select *, case when coalesce(n, '') <> '' then right(own, 60) || left(n, 60) end as seam from w),
q as (select doc_id, o // {PAGE} as quote_id, left(regexp_replace(substr(text, o + 1 + {PAGE} - case when o // {PAGE} % 2 = 0 then 20 else 300 end, 90), '[^\\p{{L}}]+', '', 'g'), 30) as q from d),
h as (select q.doc_id, quote_id, count(*) filter (contains(own, q)) as a, min(page) filter (contains(own, q)) as pa, count(*) filter (contains(seam, q)) as b, min(page) filter (contains(seam, q)) as pb
  from q join s using (doc_id) where length(q) >= 12 group by 1, 2)
select q.doc_id, q.quote_id, cast(case when a = 1 then pa when a = 0 and b = 1 then pb end as bigint) as page from q left join h using (doc_id, quote_id)""")
def quote_pages(t: Tables) -> DataFrame:
    """The pages of quotations from inside pages and from over their ends."""
    pages = _pages(t)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - 1), F.lit(PAGE))
    rows = t.documents.where("text is not null").select("doc_id", "text", F.posexplode(starts).alias("n", "at"))
    back = F.when(F.col("n") % 2 == 0, 20).otherwise(300)
    quote = F.substring(F.col("text"), F.col("at") + 1 + PAGE - back, F.lit(90))
    return pageplaces.quote_pages(rows.select("doc_id", F.col("n").cast("long").alias("quote_id"), quote.alias("quote")), pages, "doc_id")


def _short_quotes(t: Tables, least: int) -> DataFrame:
    """Short pieces of every document, most of which stand in it several times."""
    rows = t.documents.where("text is not null").select("doc_id", "text", F.explode(F.array(*map(F.lit, range(1, 5)))).alias("quote_id"))
    at = F.floor(F.length("text") * F.col("quote_id") / 5).cast("int")
    return rows.select("doc_id", "quote_id", F.btrim(F.substring(F.col("text"), at + 1, F.lit(least) + 3 * F.col("quote_id"))).alias("quote"))


@R.add()
def widened_quotes(t: Tables) -> DataFrame:
    """Ambiguous pieces of every document, widened by words until they are unique; tests hold them against trying all widenings."""
    return widening.unique_quotes(_short_quotes(t, 2), t.documents.select("doc_id", "text"), "doc_id")


@R.add()
def sentence_quotes(t: Tables) -> DataFrame:
    """The same with whole sentences."""
    return widening.unique_quotes(_short_quotes(t, 2), t.documents.select("doc_id", "text"), "doc_id", how="sentences")


#: Documents with a page divider before every sixth line, a head behind it, a page number before it, a fence and a line of links.
_FURNISHED = """list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: case
  when i % 6 = 1 then '## Page ' || (i // 6 + 1) || chr(10) || 'Report ' || doc_id || chr(10) || x when i % 6 = 0 then x || chr(10) || chr(10) || '- ' || (i // 6) || ' -'
  when i % 12 = 4 then '```' || chr(10) || '- 7 -' || chr(10) || 'Page 9' || chr(10) || '```' || chr(10) || x when i % 12 = 9 then '[Home](/a) | http://x.org/' || i || chr(10) || x else x end)"""


@R.add(rf"""
with t as (select doc_id, unnest(string_split(array_to_string({_FURNISHED}, chr(10)), chr(10))) as line, generate_subscripts(string_split(array_to_string({_FURNISHED}, chr(10)), chr(10)), 1) as k from documents),
b as (select *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as bare from t),
f as (select *, regexp_matches(bare, '^(```|~~~)') as fence, regexp_matches(bare, '(?i)^(#{{1,6}}\s*)?(page|p\.)\s*[0-9]+\s*(of\s*[0-9]+\s*)?$') as mark, bare <> '' as "full",
  lower(trim(regexp_replace(regexp_replace(bare, '[0-9]+', '', 'g'), '\s+', ' ', 'g'))) as name from b),
n as (select *, coalesce(sum(fence::int) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as inside,
  sum("full"::int) over (partition by doc_id order by k) as n, sum(mark::int) over (partition by doc_id) as pages, sum("full"::int) over (partition by doc_id) as top from f),
m as (select *, case when mark then n end as d from n),
e as (select *, case when "full" then n - last_value(d ignore nulls) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding) end as since,
  case when "full" then first_value(d ignore nulls) over (partition by doc_id order by k rows between 1 following and unbounded following) - n end as until from m),
h as (select doc_id, name from e where pages >= 3 and length(name) between 1 and 120 group by doc_id, name having sum((coalesce(since, 0) = 1)::int + (coalesce(until, 0) = 1)::int) > 0.5 * max(pages)),
r as (select e.*, h.name is not null as head, regexp_replace(bare, '^[-–—/|\s.]+|[-–—/|\s.]+$', '', 'g') as num from e left join h using (doc_id, name)),
c as (select *, case when fence or inside then null when mark then 'page_marker'
  when (coalesce(since <= 2, false) or coalesce(until <= 2, false) or top - n < 2) and "full" and pages > 0 and length(num) <= 12 and (regexp_matches(num, '(?i)^[0-9]{{1,5}}(\s*(/|of)\s*[0-9]{{1,5}})?$') or regexp_matches(num, '^([ivxlcdm]{{2,7}}|[IVXLCDM]{{2,7}})$')) then 'page_number'
  when "full" and head then 'running_head'
  when "full" and regexp_matches(bare, '(?i)https?://|\]\(\s*[^)]*\)') and length(regexp_replace(regexp_replace(bare, '(?i)https?://[^\s<>"''\])]+', ' ', 'g'), '[^0-9A-Za-z]+', '', 'g')) < 20 then 'nav_line' end as reason from r),
o as (select doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) order by k) filter (reason is null), ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+', ''), '\s+$', '') as text,
  count(*) filter (reason = 'page_marker') as page_marker, count(*) filter (reason = 'page_number') as page_number, count(*) filter (reason = 'running_head') as running_head, count(*) filter (reason = 'nav_line') as nav_line from c group by doc_id)
select doc_id, page_marker, page_number, running_head, nav_line, sha256(case when text = '' then '' else text || chr(10) end) as text_sha256 from o""")
def without_furniture(t: Tables) -> DataFrame:
    lines = F.split(F.coalesce("text", F.lit("")), "\n")

    def one(x: Column, i0: Column) -> Column:
        i = i0 + 1
        page = F.floor(i / 6).cast("string")
        first = F.concat(F.lit("## Page "), (F.floor(i / 6) + 1).cast("string"), F.lit("\nReport "), F.col("doc_id").cast("string"), F.lit("\n"), x)
        fence = F.concat(F.lit("```\n- 7 -\nPage 9\n```\n"), x)
        links = F.concat(F.lit("[Home](/a) | http://x.org/"), i.cast("string"), F.lit("\n"), x)
        return F.when(i % 6 == 1, first).when(i % 6 == 0, F.concat(x, F.lit("\n\n- "), page, F.lit(" -"))).when(i % 12 == 4, fence).when(i % 12 == 9, links).otherwise(x)

    rows = t.documents.select("doc_id", F.array_join(F.transform(lines, one), "\n").alias("text"))
    found = furniture.without_furniture(rows, "doc_id")
    return found.select("doc_id", "page_marker", "page_number", "running_head", "nav_line", F.sha2("text", 256).alias("text_sha256"))


@R.add(r"""
with l as (select doc_id, string_split(text, chr(10)) as l from documents where length(text) > 0),
p as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as i, len(l) as n from l)
select d.doc_id, sha256(coalesce(o.own, '')) as own_sha256 from documents d left join (
  select doc_id, string_agg(line || case when i < n then chr(10) else '' end, '' order by i) filter (i % 3 <> 0 and not regexp_matches(line, '^\s*>')) as own from p group by doc_id) o using (doc_id)""")
def own_words(t: Tables) -> DataFrame:
    """Documents every third line of which quotes somebody."""
    quoted = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 2, F.concat(F.lit("> "), x)).otherwise(x))
    rows = t.documents.select("doc_id", F.when(F.length("text") > 0, F.array_join(quoted, "\n")).otherwise(F.col("text")).alias("text"))
    return furniture.own_words(rows, "doc_id", "markdown").select("doc_id", F.sha2("text", 256).alias("own_sha256"))


def _forum(t: Tables) -> DataFrame:
    """Turns that quote the turn before them as a forum does."""
    said = F.concat(F.lit("User "), F.col("conv_id"), F.lit(" said:\n"), F.coalesce("text", F.lit("")), F.lit("\nClick to expand...\n"))
    turn = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("Well.\n"), said, F.lit("I agree with that.\n"), said)).otherwise(F.col("text"))
    return t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), turn.alias("text"), F.array(F.lit("a"), F.lit("b")).alias("sources"))


@R.add()
def forum_quotes(t: Tables) -> DataFrame:
    """Own and quoted parts of forum posts; tests hold them against planted ones."""
    return furniture.quote_blocks(_forum(t), "turn_id", "xenforo")


@R.add()
def cell_units(t: Tables) -> DataFrame:
    """Lines of forum posts as units with their headings, quoted lines left out."""
    return furniture.segment_units(_forum(t), "turn_id", style="xenforo")


@R.add()
def reference_lists(t: Tables) -> DataFrame:
    """Documents with a list of works at their end, with and without its heading."""
    entry = F.concat_ws("\n\n", *[F.lit(f"Bo, A. ({2000 + i}). A title of a work that is long enough to be weighed, vol. {i}, pp. {i}-{i + 9}. doi 10.1/{i}") for i in range(6)])
    headed = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("References\n\n"), entry)).when(F.col("doc_id") % 3 == 1, entry)
    rows = t.documents.select("doc_id", F.concat_ws("\n\n", F.regexp_replace("text", "\n", "\n\n"), headed).alias("text"))
    return furniture.references(rows, "doc_id")


def _recordings(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Segments and captions made from events: a recording for each twentieth of the users, seconds from the day's begin."""
    second = F.unix_timestamp("ts").cast("double") % 86400
    rows = t.events.select((F.col("user_id") % 20).alias("rec"), "event_id", "event_type", second.alias("t"))
    segments = rows.select("rec", F.col("event_type").alias("sid"), F.col("t").alias("start"), (F.col("t") + 5 + F.col("event_id") % 40).alias("end"), F.when(F.col("event_id") % 7 == 0, "so?").otherwise("yes.").alias("text"))
    cues = rows.where("event_id % 3 = 0").select("rec", (F.col("t") + 2).alias("start"), (F.col("t") + 20).alias("end"), F.concat(F.lit("P "), F.col("event_type")).alias("speaker"))
    return segments, cues


@R.add("""
with r as (select user_id % 20 as rec, event_id, event_type, cast(floor(epoch(ts)) as bigint) % 86400 as t from events),
s as (select rec, event_type as sid, t as lo, t + 5 + event_id % 40 as hi from r), c as (select rec, 'P ' || event_type as name, t + 2 as s, t + 20 as e from r where event_id % 3 = 0)
select rec, sid, name, cast(sum(least(hi, e) - greatest(lo, s)) as double) as seconds from s join c using (rec) where s < hi and lo < e group by 1, 2, 3""")
def caption_votes(t: Tables) -> DataFrame:
    return speakers.caption_votes(*_recordings(t))


@R.add()
def named_speakers(t: Tables) -> DataFrame:
    """Every speaker's name by voice, captions and intake; tests hold it against a plain version."""
    segments, cues = _recordings(t)
    recs = t.events.select((F.col("user_id") % 20).alias("rec")).distinct()
    known = recs.where("rec % 4 = 0").select("rec", F.lit("click").alias("sid"), F.lit("Ann").alias("name"))
    intake = recs.where("rec % 3 = 0").select("rec", F.lit("Ann").alias("interviewer"), F.concat(F.lit("Guest "), "rec").alias("interviewee"))
    return speakers.named_speakers(segments, cues, known, intake)
