"""Text functions over code points: spans, lines, quotation markers, occurrences, folding for re-finding, sentences."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a re-find reads alike.
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
SINGLE_QUOTES = "\u2018\u2019\u201a\u201b\u2032"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f\u2033"
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl"}
EXT = "ext-[0-9a-f]{12}"
#: Words of questions that aren't searched for.
STOP_WORDS = ("what", "which", "does", "this", "that", "with", "from", "have", "about", "they", "their")
#: White space in patterns: the ASCII kinds and the Unicode ones.
SPACE = "\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


def span(text: Column, start: Column, end: Column) -> Column:
    """Code points start to end, 0-based and half-open."""
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def quoted_pattern(needle: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def occurrences(text: Column, needle: Column) -> Column:
    """How often needle stands in text, overlapping places included."""
    return F.when(needle == "", 0).otherwise(F.regexp_count(text, F.concat(F.lit("(?="), quoted_pattern(needle), F.lit(")"))))


def line_of(text: Column, at: Column) -> Column:
    """The 1-based line of a code point."""
    before = F.substring(text, F.lit(1), at.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def line_range(text: Column, start: Column, end: Column) -> Column:
    """First and last line of a span; an empty span lies on its start's line."""
    return F.struct(line_of(text, start).alias("first"), line_of(text, F.greatest(start, end - 1)).alias("last"))


def text_lines(text: Column) -> Column:
    """The lines; the empty piece after a final line feed isn't one."""
    parts = F.split(text, "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def block_markers(text: Column) -> Column:
    """Fenced quotations: (quote, ext_id, form)."""
    shape = f"(?m)^(`{{3,}})quote ({EXT})[ \\t]*\\n([\\s\\S]*?)\\n\\1[ \\t]*$"
    return F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(shape), F.lit(3)).alias("quote"), F.regexp_extract_all(text, F.lit(shape), F.lit(2)).alias("ext_id")), lambda x: F.struct(x["quote"].alias("quote"), x["ext_id"].alias("ext_id"), F.lit("block").alias("form")))


def without_blocks(text: Column) -> Column:
    return F.regexp_replace(text, f"(?m)^(`{{3,}})quote {EXT}[ \\t]*\\n[\\s\\S]*?\\n\\1[ \\t]*$", " ")


def inline_markers(text: Column) -> Column:
    shape = f'"([^"\\n]+)"\\s?\\[({EXT})\\]'
    return F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(shape), F.lit(1)).alias("quote"), F.regexp_extract_all(text, F.lit(shape), F.lit(2)).alias("ext_id")), lambda x: F.struct(x["quote"].alias("quote"), x["ext_id"].alias("ext_id"), F.lit("inline").alias("form")))


def quote_markers(text: Column) -> Column:
    """All markers: fenced ones first, then inline ones outside fences."""
    return F.concat(block_markers(text), inline_markers(without_blocks(text)))


def uncited_quotes(text: Column, least: int = 20) -> Column:
    """Double-quoted spans of `least` code points or more without a marker right behind."""
    all_ = F.regexp_extract_all(without_blocks(text), F.lit(f'"[^"\\n]+"(?:\\s?\\[{EXT}\\])?'), F.lit(0))
    bare = F.filter(all_, lambda x: x.endswith('"'))
    return F.filter(F.transform(bare, lambda x: F.substring(x, F.lit(2), F.length(x) - 2)), lambda x: F.length(x) >= least)


def fold_for_refind(text: Column) -> Column:
    """Typesetting undone: soft hyphens, words broken over lines, dash and quote forms, ligatures, ellipses, white space. Case stays."""
    s = F.replace(text, F.lit("\u00ad"), F.lit(""))
    s = F.regexp_replace(s, f"[-{DASHES}][{SPACE}]*[\\n\\r][{SPACE}]*(?=\\p{{Ll}})", "")
    s = F.translate(s, DASHES + SINGLE_QUOTES + DOUBLE_QUOTES, "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))
    for ligature, plain in LIGATURES.items():
        s = F.replace(s, F.lit(ligature), F.lit(plain))
    s = F.replace(s, F.lit("\u2026"), F.lit("..."))
    return F.regexp_replace(s, f"[{SPACE}]+", " ")


def _table(low: int, high: int, strip: bool) -> tuple[str, str]:
    """Code points of a range whose compatibility form is one other character, and these; strip: combining marks of the form don't count."""
    pairs = []
    for c in map(chr, range(low, high)):
        form = unicodedata.normalize("NFKD" if strip else "NFKC", c)
        form = "".join(x for x in form if not (strip and unicodedata.combining(x)))
        if len(form) == 1 and form != c:
            pairs.append((c, form))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Where letters with marks and full-width forms lie.
_MARKED = tuple(map("".join, zip(_table(0xA0, 0x250, True), _table(0x1E00, 0x1F00, True), strict=True)))
_WIDE = tuple(map("".join, zip(_table(0xFF01, 0xFF5F, False), _table(0x2070, 0x20A0, False), strict=True)))


def fold_marks(text: Column) -> Column:
    """Lower case without marks on Latin letters."""
    return F.regexp_replace(F.translate(F.lower(text), *_MARKED), "\\p{M}+", "")


def reader_fold(text: Column) -> Column:
    """A text as a reader compares it: case, emphasis signs, quote and dash forms, full-width forms, ligatures and white space don't count."""
    s = F.translate(F.coalesce(text, F.lit("")), *_WIDE)
    for ligature, plain in LIGATURES.items():
        s = F.replace(s, F.lit(ligature), F.lit(plain))
    s = F.replace(s, F.lit("\u2026"), F.lit("..."))
    # fixed values: quote and dash forms that are read alike; emphasis signs go
    s = F.translate(s, "\u2019\u2018\u201c\u201d\u2013\u2014\u00a0*_", "''\"\"-- ")
    return F.lower(F.btrim(F.regexp_replace(s, f"[{SPACE}]+", " ")))


def refind_variants(needle: Column) -> Column:
    """Spellings to try in order: as it is, first letter's case changed, final stop dropped, both."""

    def swapped(n: Column) -> Column:
        first = F.substring(n, 1, 1)
        other = F.when(first == F.lower(first), F.upper(first)).otherwise(F.lower(first))
        return F.when(other != first, F.concat(other, F.substring(n, 2, 1 << 30)))

    short = F.when((F.length(needle) > 1) & needle.endswith(".") & ~needle.endswith(".."), F.substring(needle, F.lit(1), F.length(needle) - 1))
    return F.filter(F.array(needle, swapped(needle), short, swapped(short)), lambda x: x.isNotNull())


def bound(c: Column, use) -> Column:
    """use(c) with c evaluated once, however often use takes it."""
    return F.transform(F.array(c), use)[0]


def refind_status(text: Column, candidate: Column) -> Column:
    """(status, candidates): refound, ambiguous or not_found under fold_for_refind; the first variant that occurs decides. Text and candidate
    are folded once, and places are counted for that variant only."""

    def decide(hay: Column, needle: Column) -> Column:
        first = F.get(F.filter(refind_variants(needle), lambda n: F.contains(hay, n)), 0)
        n = bound(first, lambda v: F.when(v.isNull() | (needle == ""), 0).otherwise(occurrences(hay, v)))
        return bound(n, lambda n: F.struct(F.when(n == 1, "refound").when(n > 1, "ambiguous").otherwise("not_found").alias("status"), n.alias("candidates")))

    needle = F.coalesce(F.btrim(fold_for_refind(candidate)), F.lit(""))
    return bound(needle, lambda needle: bound(fold_for_refind(text), lambda hay: decide(hay, needle)))


def fragments(quote: Column, least: int = 12) -> Column:
    """Pieces of a quotation between ellipses, trimmed, of `least` characters or more."""
    return F.filter(F.transform(F.split(quote, "\\s*(?:\u2026|\\.{3}|\\[\u2026\\]|\\[\\.{3}\\])\\s*"), lambda x: F.btrim(x)), lambda x: F.length(x) >= least)


def quote_check(text: Column, quote: Column) -> Column:
    """exact, ambiguous, normalized, elided, missing or not found."""
    q = F.btrim(F.coalesce(quote, F.lit("")))
    fold = lambda c: F.lower(fold_for_refind(c))
    pieces = fragments(q)

    def loose(hay: Column) -> Column:
        elided = (F.size(pieces) > 1) & F.forall(pieces, lambda p: F.contains(hay, fold(p)))
        return F.when(F.contains(hay, F.btrim(fold(q))), F.lit("normalized")).when(elided, "elided").otherwise("not found")

    direct = F.when(F.contains(text, q), bound(occurrences(text, q), lambda n: F.when(n == 1, F.lit("exact")).otherwise("ambiguous")))
    return F.when(q == "", F.lit("missing")).otherwise(F.coalesce(direct, bound(fold(text), loose)))


def sentences(text: Column) -> Column:
    """Pieces that end in a stop, question or exclamation mark before white space, or at the end."""
    return F.filter(F.transform(F.split(text, "(?<=[.!?])\\s+"), lambda x: F.btrim(x)), lambda x: x != "")


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("\\d+(?:[.,]\\d+)*"), F.lit(0))


def search_terms(query: Column, least: int = 4, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(f"[\\p{{L}}\\p{{N}}_]{{{least},}}"), F.lit(0)))
    return F.filter(words, lambda w: ~w.isin(*stop))


def context(text: Column, start: Column, end: Column, before: int, after: int) -> Column:
    low = F.greatest(F.lit(0), start - before)
    return span(text, low, F.least(F.length(text), end + after))


def own_words(text: Column) -> Column:
    """Text without lines that quote somebody else (`>` at the start)."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.ltrim(x).startswith(">")), "\n")


def sound_key(word: Column) -> Column:
    """Letters that sound alike folded, vowels after the first letter and repeats dropped."""
    s = F.regexp_replace(F.lower(word), "[^a-z]", "")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "ph", "f"), "ck|q|c", "k"), "z", "s")
    s = F.concat(F.substring(s, 1, 1), F.regexp_replace(F.substring(s, 2, 1 << 30), "[aeiouyhw]", ""))
    return F.regexp_replace(s, "(.)\\1+", "$1")


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour."""
    s = F.floor(seconds).cast("int")
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def clock_seconds(text: Column) -> Column:
    parts = F.reverse(F.transform(F.split(F.replace(text, F.lit(","), F.lit(".")), ":"), lambda x: x.try_cast("double")))
    return F.aggregate(F.sequence(F.lit(0), F.size(parts) - 1), F.lit(0.0), lambda a, i: a + F.element_at(parts, i + 1) * F.pow(F.lit(60.0), i))


def date_key(text: Column) -> Column:
    """A sort key for partial dates: missing month and day as 99, no year as 9999."""
    iso = "^(\\d{4})(?:-(\\d{2}))?(?:-(\\d{2}))?"
    part = lambda i: F.regexp_extract(F.coalesce(text, F.lit("")), iso, i)
    year = F.when(part(1) != "", part(1)).otherwise(F.regexp_extract(F.coalesce(text, F.lit("")), "(1[5-9]\\d\\d|20\\d\\d)", 1))
    fill = lambda c: F.when(c == "", "99").otherwise(c)
    return F.when(year == "", "9999").otherwise(F.concat_ws("-", year, fill(part(2)), fill(part(3))))


def list_cell(c: Column) -> Column:
    """A cell's parts between semicolons, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.btrim(x)), lambda x: x != "")


def first_object(answer: Column) -> Column:
    """The first JSON object in a model's answer, whatever stands around it, as text: from a brace to the nearest one that closes it; null
    if there is none. Braces inside strings don't count."""
    string = '"(?:[^"\\\\]|\\\\.)*+"'
    flat = f"(?:[^{{}}\"]|{string})*+"
    nested = flat
    for _ in range(8):
        nested = f"(?:[^{{}}\"]|{string}|\\{{{nested}\\}})*+"
    found = F.regexp_extract(answer, f"(?s)\\{{{nested}\\}}", 0)
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found)
