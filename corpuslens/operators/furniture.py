"""What a text holds besides its own: page furniture, navigation, repository coversheets, reference lists, other people's words.

Texts become their lines, and rules on neighbours are windows over a text's lines: running counts tell fences and pages, the last and next
values that aren't null tell what lies around. A text's lines are one group, as large as the text itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import alignment, linking

#: Phrases of a repository's coversheet, and how many of them, in how many lines, make one.
COVERSHEET = ("research portal", "repository", "eprints", "author accepted manuscript", "version of record", "link to published version", "terms of use", "citing this paper", "downloaded from", "this is the peer reviewed version", "general rights")
COVER_LINES, COVER_SIGNS = 60, 3
#: A page's divider, a link, a fence.
PAGE_MARK = r"(?i)^(#{1,6}\s*)?(page|p\.)\s*\d+\s*(of\s*\d+\s*)?$"
LINK = r"(?i)https?://|\]\(\s*[^)]*\)"
FENCE = r"^(```|~~~)"
#: Lines at a page's ends that may be a page number; pages from which running heads are looked for, and the share of them that
#: a head stands on; letters and digits that a line with a link needs to be a sentence, at either level; lines that repeat more often go.
EDGE_LINES, HEAD_PAGES, HEAD_SHARE, REPEATS = 2, 3, 0.5, 3
PROSE = {"standard": 20, "aggressive": 40}
CLASSES = ("page_marker", "page_number", "running_head", "repeated_line", "nav_line")


def line_key(line: Column) -> Column:
    """What tells repeated lines alike: white space, case and numbers don't."""
    return F.lower(F.btrim(F.regexp_replace(F.regexp_replace(line, r"\d+", ""), r"\s+", " ")))


def prose_weight(line: Column) -> Column:
    """Letters and digits of a line without its addresses and link signs."""
    return F.length(F.regexp_replace(F.regexp_replace(line, r"(?i)https?://[^\s<>\"'\])]+", " "), "[^0-9A-Za-z]+", ""))


def page_number_line(line: Column) -> Column:
    """A line that is nothing but a page number: of one to five digits, "12 / 340", or a Roman numeral of two to seven letters."""
    edge = alignment.EDGE_SIGNS
    return alignment.page_number(line).isNotNull() | line.rlike(f"^{edge}*+(?:[ivxlcdm]{{2,7}}|[IVXLCDM]{{2,7}}){edge}*$")


def coversheet(text: Column) -> Column:
    """The phrases of a coversheet that a text begins with, if there are enough to make one, else none. It is told, never taken out."""
    head = F.lower(F.substring_index(text, "\n", COVER_LINES))
    found = F.filter(F.array(*map(F.lit, COVERSHEET)), lambda m: F.contains(head, m))
    return F.when(F.size(found) >= COVER_SIGNS, found).otherwise(F.array().cast("array<string>"))


def lines_of(texts: DataFrame, key: str) -> DataFrame:
    """(key, at, line): a text's lines from 0 on; a null text is one empty line."""
    return texts.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))


def _with_folios(texts: DataFrame, key: str) -> DataFrame:
    """(key, ..., at, line, folio): the lines of texts (key, text, ...), and whether each is on the pagination of a text without dividers. Texts
    come by key before they are cut into lines, so that whatever is asked of a text's lines needs no further shuffle."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    divided = F.exists(lines, lambda x: bare_line(x).rlike(PAGE_MARK))
    paged = alignment.paginations(texts.where(~divided).select(key, "text"), key)
    before = F.concat(F.array(F.lit(-1)), F.col("places"))
    gaps = F.transform("places", lambda x, i: F.concat(F.array_repeat(F.lit(False), x - F.get(before, i) - 1), F.array(F.lit(True))))
    flags = F.coalesce(F.flatten(gaps), F.array().cast("array<boolean>"))
    rows = texts.repartition(key).join(paged, key, "left")
    more = [c for c in texts.columns if c not in (key, "text")]
    rows = rows.select(key, *more, F.posexplode(F.arrays_zip(lines.alias("line"), flags.alias("folio"))).alias("at", "x"))
    return rows.select(key, *more, "at", F.col("x.line").alias("line"), F.coalesce("x.folio", F.lit(False)).alias("folio"))


def bare_line(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\f"))


def marked_lines(texts: DataFrame, key: str, level: str = "standard") -> DataFrame:
    """(key, ..., at, line, reason): the lines of texts (key, text, ...) with the class of furniture that each is, or null.

    Page dividers; page numbers within two lines of a divider or the text's end, or, in a text without dividers, on its pagination; lines
    next to dividers that stand so on over half of three pages or more; links with next to no prose; and, at the aggressive level, short
    lines that stand more than three times. Lines between fences are kept as they are.

    All is told by windows over a text's lines that aren't blank: one shuffle of whole texts, and a fixed number of neighbours of each line."""
    all_ = Window.partitionBy(key, "full")
    w, named = all_.orderBy("at"), Window.partitionBy(key, "name")
    bare = bare_line(F.col("line"))
    rows = _with_folios(texts, key).withColumns({"fence": bare.rlike(FENCE), "mark": bare.rlike(PAGE_MARK), "full": bare != ""})
    beside = lambda i: F.lag("mark", i, False).over(w) | F.lead("mark", i, False).over(w)
    rows = rows.withColumns({
        "inside": F.coalesce(F.count_if("fence").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1,
        "beside": F.lag("mark", 1, False).over(w).cast("int") + F.lead("mark", 1, False).over(w).cast("int"),
        "near": reduce(Column.__or__, [beside(i) for i in range(1, EDGE_LINES + 1)]), "last": F.lead("at", EDGE_LINES).over(w).isNull(), "pages": F.count_if("mark").over(all_),
    })
    aggressive = level == "aggressive"
    name = F.when(F.col("full") & (F.lit(aggressive) | (F.col("pages") >= HEAD_PAGES)), line_key(bare))
    rows = rows.withColumn("name", name).withColumn("name", F.when(F.length("name").between(1, 120), F.col("name")))
    head = F.col("name").isNotNull() & (F.col("pages") >= HEAD_PAGES) & (F.sum("beside").over(named) > HEAD_SHARE * F.col("pages"))
    rows = rows.withColumns({"head": head, "repeats": (F.length("name") <= 80) & (F.count("*").over(named) > REPEATS) if aggressive else F.lit(False)})
    edge = F.col("near") | F.col("last")
    numbered = F.when(F.col("pages") > 0, edge & F.col("full")).otherwise(F.col("folio")) & page_number_line(bare)
    link = bare.rlike(LINK) & (prose_weight(bare) < PROSE[level])
    reason = F.when(F.col("fence") | F.col("inside"), F.lit(None).cast("string")).when(F.col("mark"), "page_marker").when(numbered, "page_number")
    reason = reason.when(F.col("full") & F.col("head"), "running_head").when(F.col("full") & F.col("repeats"), "repeated_line").when(F.col("full") & link, "nav_line")
    return rows.select(key, *[c for c in texts.columns if c not in (key, "text")], "at", "line", reason.alias("reason"))


def without_furniture(texts: DataFrame, key: str, level: str = "standard") -> DataFrame:
    """(key, text, page_marker, ..., nav_line, coversheet) of texts (key, text), one row for each key: the text without furniture, how many
    lines of each class went, and the coversheet's phrases. Blank lines that are left over fold into one; level "none" takes nothing out."""
    text = F.coalesce("text", F.lit(""))
    if level == "none":
        none = {c: F.lit(0).cast("long") for c in CLASSES}
        return texts.select(key, text.alias("text"), coversheet(text).alias("coversheet")).withColumns(none).select(key, "text", *CLASSES, "coversheet")
    rows = marked_lines(texts.select(key, "text", coversheet(text).alias("coversheet")), key, level)
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("reason").isNull(), F.struct("at", "line")))), lambda x: x["line"])
    out = rows.groupBy(key).agg(kept.alias("kept"), *[F.count_if(F.col("reason") == c).alias(c) for c in CLASSES], F.any_value("coversheet").alias("coversheet"))
    whole = F.regexp_replace(F.array_join("kept", "\n"), "\n{3,}", "\n\n")
    whole = F.regexp_replace(F.regexp_replace(whole, "^\n+", ""), r"\s+$", "")
    text = F.when(whole == "", "").otherwise(F.concat(whole, F.lit("\n")))
    return out.select(key, text.alias("text"), *CLASSES, "coversheet")


def page_edges(pages: DataFrame, running: DataFrame, key: str, edge: int = 4) -> DataFrame:
    """(key, page, text, removed) of pages (key, page, text) and their running lines (key, key as reports.running_lines has it in `line_key`):
    pages without running lines and bare page numbers among their first and last `edge` lines."""
    rows = pages.select(key, "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    n = F.count("*").over(Window.partitionBy(key, "page"))
    rows = rows.withColumns({"near": (F.col("at") < edge) | (F.col("at") >= n - edge), "line_key": F.lower(F.btrim(F.regexp_replace(F.regexp_replace("line", "[0-9]+", "#"), r"\s+", " ")))})
    rows = rows.join(running.select(key, "line_key", F.lit(True).alias("runs")), [key, "line_key"], "left")
    full = F.btrim("line") != ""
    gone = F.col("near") & full & (F.coalesce("runs", F.lit(False)) | F.btrim("line").rlike(r"^[\[(]?\d{1,4}[\])]?$"))
    kept = F.transform(F.array_sort(F.collect_list(F.when(~gone, F.struct("at", "line")))), lambda x: x["line"])
    return rows.groupBy(key, "page").agg(F.array_join(kept, "\n").alias("text"), F.count_if(gone).alias("removed"))


# reference lists

#: A reference list's heading, and what its entries are dense in: names with initials or numbers, years, volumes and links.
REFERENCES = r"(?i)^\s*(?:\d+(?:\.\d+)*\.?\s*)?(?:references|reference list|bibliography|literature cited|works cited|references and notes|notes and references)\b\s*:?\s*(?=$|[A-Z])"
ENTRY = (
    r"\b[A-Z][A-Za-z'\-]+,? (?:[A-Z]\.? ?){1,3}[,.:;(]|\b[A-Z][a-z]+, [A-Z]\.(?: ?[A-Z]\.)?|\b(?:[A-Z]\.\s?){1,3}[A-Z][a-z]+|\[\d{1,3}\]|(?:^|\s)\d{1,3}\.\s+[A-Z][a-z]+,? [A-Z]",
    r"\b(?:19|20)\d\d[a-z]?\b",
    r"doi|https?://|\bvol\.|\bpp\.|\d+\(\d+\)|\d+[-–]\d+",
)
#: A list begins in the last 60 % of its text; code points that a block needs to be weighed; signs in 100 code points; blocks
#: behind the list that may be something else, and how long they are at most.
LATE, WEIGHED, DENSE, FOOTERS, FOOTER = 0.4, 80, 3.0, 2, 600


def text_blocks(texts: DataFrame, key: str) -> DataFrame:
    """(key, block, start, text): runs of lines that aren't blank, numbered from 0, with the place of their first character that is no space."""
    w = Window.partitionBy(key).orderBy("at")
    rows = lines_of(texts, key).withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("full", F.col("line").rlike(r"\S"))
    first = F.col("full") & ~F.coalesce(F.lag("full").over(w), F.lit(False))
    rows = rows.withColumn("block", F.count_if(first).over(w) - 1).where("full")
    whole = rows.groupBy(key, "block").agg(F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("x"))
    text = F.array_join(F.transform("x", lambda x: x["line"]), "\n")
    lead = F.length(text) - F.length(F.regexp_replace(text, r"^\s+", ""))
    return whole.select(key, "block", (F.col("start") + lead).alias("start"), F.regexp_replace(text, r"^\s+", "").alias("text"))


def references(texts: DataFrame, key: str) -> DataFrame:
    """(key, start, found_by) of texts (key, text): where the reference list begins and whether its heading or the density of its entries told
    it; null where there is none, so that prose is never cut for one.

    A heading counts in the last 60 % of the text, the first one. Without one the blocks are looked through from the end, short ones left
    out: up to two short ones that aren't dense may lie behind the list, which reaches back to the first block that isn't dense."""
    sizes = texts.select(key, F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    blocks = text_blocks(texts, key).join(sizes, key).withColumn("late", F.col("start") > LATE * F.col("chars"))
    signs = sum((F.regexp_count("text", F.lit(p)) for p in ENTRY), F.lit(0))
    weighed = F.when(F.length("text") >= WEIGHED, F.struct((-F.col("block")).alias("r"), F.col("start"), F.length("text").alias("size"), (signs * 100 >= DENSE * F.length("text")).alias("dense")))
    per = blocks.groupBy(key).agg(F.min(F.when(F.col("late") & F.col("text").rlike(REFERENCES), F.col("start"))).alias("heading"), F.array_sort(F.collect_list(weighed)).alias("b"), F.max("chars").alias("chars"))
    first = F.array_position(F.transform("b", lambda x: x["dense"]), True).cast("int")  # 0: none
    per = per.withColumn("first", first)
    before = F.slice("b", F.lit(1), F.greatest(F.lit(0), F.col("first") - 1))
    allowed = (F.col("first") > 0) & (F.size(before) <= FOOTERS) & F.forall(before, lambda x: x["size"] < FOOTER)
    rest = F.slice("b", F.greatest(F.lit(1), F.col("first")), F.size("b") + 1)
    stop = F.array_position(F.transform(rest, lambda x: x["dense"]), False).cast("int")
    run = F.slice(rest, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(rest)))
    per = per.withColumn("dense", F.when(allowed, F.element_at(run, -1)["start"]))
    late = F.when(F.col("dense") > LATE * F.col("chars"), F.col("dense"))
    found = per.select(key, F.coalesce("heading", late).alias("start"), F.when(F.col("heading").isNotNull(), "heading").when(late.isNotNull(), "density").alias("found_by"))
    return texts.select(key).join(found, key, "left")


# other people's words

#: How a forum's quoted block begins and ends, and how a mail's does.
SAID, EXPAND, WROTE = r"(?m)^([^\n]{1,80}?) said:[ \t]*$", "Click to expand...", r"(?m)^On .{5,120} wrote:\s*$"


def quote_blocks(cells: DataFrame, key: str, style: str, nested: bool = False) -> DataFrame:
    """(key, start, end, kind, author, source) of cells (key, text, sources): a cell's own words and the blocks that it quotes, in code points.

    xenforo: a block ends at each EXPAND and begins at the last "name said:" line since the block before, else right behind that; its author
    is the name, its source the one of the same place in `sources` if there are as many as blocks. With nested, a block begins at the line
    that its end pairs with, as brackets do, and blocks inside it belong to it. markdown: runs of lines that begin with ">". email: all from
    the first "On ... wrote:" line on. Other styles: all is own. Empty cells have no row."""
    rows = cells.where(F.length("text") > 0)
    if style == "markdown":
        w = Window.partitionBy(key).orderBy("at")
        lines = lines_of(rows, key).withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        size = F.max("at").over(Window.partitionBy(key))
        lines = lines.withColumns({"quoted": F.col("line").rlike(r"^\s*>"), "end": F.col("start") + F.length("line") + F.when(F.col("at") < size, 1).otherwise(0)}).where("end > start")
        run = F.sum(F.when(F.col("quoted") == F.coalesce(F.lag("quoted").over(w), ~F.col("quoted")), 0).otherwise(1)).over(w)
        lines = lines.withColumn("run", run).groupBy(key, "run", "quoted").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        return lines.select(key, "start", "end", F.when(F.col("quoted"), "quote").otherwise("own").alias("kind"), F.lit("").alias("author"), F.lit("").alias("source"))
    if style == "email":
        head = F.regexp_extract("text", WROTE, 0)
        at = F.when(head != "", F.instr("text", head) - 1)
        parts = F.array(F.struct(F.lit(0).alias("start"), F.coalesce(at, F.length("text")).alias("end"), F.lit("own").alias("kind")), F.struct(at.alias("start"), F.length("text").alias("end"), F.lit("quote").alias("kind")))
        found = rows.select(key, F.explode(F.filter(parts, lambda x: x["end"] > x["start"])).alias("x")).select(key, "x.*")
        return found.select(key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "kind", F.lit("").alias("author"), F.lit("").alias("source"))
    if style != "xenforo":
        return rows.select(key, F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"), F.lit("own").alias("kind"), F.lit("").alias("author"), F.lit("").alias("source"))
    blocks = (_paired_blocks if nested else _forum_blocks)(rows, key)
    w = Window.partitionBy(key).orderBy("start")
    blocks = blocks.withColumn("i", F.row_number().over(w))
    counts = blocks.groupBy(key).agg(F.count("*").alias("n"))
    own = rows.select(key, F.length("text").cast("long").alias("size"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources")).join(counts, key, "left")
    named = blocks.join(own, key).withColumn("source", F.when(F.size("sources") == F.col("n"), F.get("sources", F.col("i") - 1)).otherwise(""))
    quotes = named.select(key, "start", "end", F.lit("quote").alias("kind"), "author", F.coalesce("source", F.lit("")).alias("source"))
    gaps = named.select(key, F.coalesce(F.lag("end").over(w), F.lit(0)).alias("s"), F.col("start").alias("e")).unionByName(
        own.join(blocks.groupBy(key).agg(F.max("end").alias("s")), key, "left").select(key, F.coalesce("s", F.lit(0)).alias("s"), F.col("size").alias("e"))
    )
    gaps = gaps.where("e > s").select(key, F.col("s").alias("start"), F.col("e").alias("end"), F.lit("own").alias("kind"), F.lit("").alias("author"), F.lit("").alias("source"))
    return quotes.unionByName(gaps)


def _forum_blocks(rows: DataFrame, key: str) -> DataFrame:
    """(key, start, end, author): a cell is cut behind each EXPAND; in a piece the block begins at the last "said" line."""
    pieces = rows.select(key, F.posexplode(F.split("text", r"\Q" + EXPAND + r"\E")).alias("i", "piece"), F.size(F.split("text", r"\Q" + EXPAND + r"\E")).alias("n"))
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("at", F.coalesce(F.sum(F.length("piece") + len(EXPAND)).over(w), F.lit(0))).where("i < n - 1")
    shape = r"(?s)^(.*\n|)([^\n]{1,80}?) said:[ \t]*(?:\n.*|)$"  # greedy: the last such line
    said = F.col("piece").rlike(shape)
    start = F.col("at") + F.when(said, F.length(F.regexp_extract("piece", shape, 1))).otherwise(0)
    author = F.when(said, F.btrim(F.regexp_extract("piece", shape, 2))).otherwise("")
    end = F.col("at") + F.length("piece") + len(EXPAND)
    return pieces.select(key, start.cast("long").alias("start"), end.cast("long").alias("end"), author.alias("author"))


def _paired_blocks(rows: DataFrame, key: str) -> DataFrame:
    """(key, start, end, author): "said" lines and EXPANDs pair as brackets; the outermost pairs are the blocks. An end without a line before it
    is nobody's, a line without an end begins nothing.

    Lines are worth 1 and ends -1. An end pairs with the last line before it at whose depth it closes; depths never fall below 0, which a
    running minimum sees to."""
    cut = F.split("text", f"(?={SAID})|(?<=\\Q{EXPAND}\\E)|(?=\\Q{EXPAND}\\E)")
    pieces = rows.select(key, F.posexplode(cut).alias("i", "piece"))
    w = Window.partitionBy(key).orderBy("i")
    pieces = pieces.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    found = pieces.withColumn("mark", F.when(F.col("piece") == EXPAND, -1).when(F.col("piece").rlike("^" + SAID.removeprefix("(?m)^").removesuffix("$") + r"(?:\n|$)"), 1)).where("mark is not null")
    found = found.withColumn("level", F.sum("mark").over(w))
    low = F.least(F.lit(0), F.min("level").over(w))
    found = found.withColumn("depth", F.col("level") - low)
    # an end that lowers the minimum has no line; lines of depth 1 that come back to 0 hold a block
    found = found.withColumn("lost", (F.col("mark") == -1) & (F.coalesce(F.lag("depth").over(w), F.lit(0)) == 0)).where("not lost")
    opens = F.when((F.col("mark") == 1) & (F.col("depth") == 1), F.struct("at", F.btrim(F.regexp_extract("piece", "^([^\n]{1,80}?) said:", 1)).alias("author")))
    found = found.withColumn("open", F.last(opens, ignorenulls=True).over(w))
    closed = found.where("mark = -1 and depth = 0")
    return closed.select(key, F.col("open.at").cast("long").alias("start"), (F.col("at") + len(EXPAND)).cast("long").alias("end"), F.col("open.author").alias("author"))


def own_words(cells: DataFrame, key: str, style: str) -> DataFrame:
    """(key, text): a cell's own words, what it quotes left out."""
    own = quote_blocks(cells, key, style).where("kind = 'own'").join(cells.select(key, "text"), key)
    part = F.struct("start", F.substring(F.col("text"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("t"))
    whole = own.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "").alias("own"))
    return cells.select(key).join(whole, key, "left").select(key, F.coalesce("own", F.lit("")).alias("text"))


def segment_units(cells: DataFrame, key: str, by: str = "line", least: int = 12, style: str | None = None, keep_heading: str | None = None) -> DataFrame:
    """(key, unit, n, start, end, heading) of cells (key, text, sources): units inside a cell, its lines (without bullets) or paragraphs of
    `least` code points or more; unit is key-001, key-002 and so on. Lines of quoted blocks are no units. A short capitalised line without a
    stop is a heading: the context of what follows it and no unit, unless it matches keep_heading, which makes any line both."""
    w = Window.partitionBy(key).orderBy("at")
    rows = lines_of(cells, key).withColumn("from", F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if by == "paragraph":
        blocks = text_blocks(cells, key).withColumn("text", F.regexp_replace("text", r"\s+$", ""))
        units = blocks.where(F.length("text") >= least).select(key, "start", (F.col("start") + F.length("text")).alias("end"), F.lit("").alias("heading"))
    elif by == "line":
        if style:
            quoted = quote_blocks(cells, key, style).where("kind = 'quote'").select(key, F.col("start").alias("c0"), F.col("end").alias("c1"), F.struct("start", "end").alias("block"))
            around = linking.block_at(rows.select(key, F.col("from").alias("place")), quoted, key)
            rows = rows.join(around.select(key, F.col("place").alias("from"), "block"), [key, "from"], "left")
            rows = rows.where("block is null or from < block.start or from + length(line) > block.end")
        lead = F.length(F.regexp_extract("line", "^[\\s\\-–•*​]*", 0))
        bare = F.regexp_replace(F.substring("line", lead + 1, F.length("line")), r"\s+$", "")
        rows = rows.select(key, "at", (F.col("from") + lead).alias("start"), bare.alias("bare")).where("bare <> ''")
        short = (F.length("bare") < 80) & ~F.col("bare").rlike("[.:?!;,]$") & F.col("bare").rlike(r"^\p{Lu}") & (F.size(F.split("bare", r"\s+")) <= 10)
        kept = F.col("bare").rlike(keep_heading) if keep_heading else F.lit(False)
        rows = rows.withColumns({"head": short | kept, "kept": kept})
        above = F.last(F.when(F.col("head"), F.col("bare")), ignorenulls=True).over(w)
        rows = rows.withColumn("above", above).where((~F.col("head") | F.col("kept")) & (F.length("bare") >= least))
        units = rows.select(key, "start", (F.col("start") + F.length("bare")).alias("end"), F.when(F.col("above") == F.col("bare"), "").otherwise(F.coalesce("above", F.lit(""))).alias("heading"))
    else:
        raise ValueError(f"units are lines or paragraphs, not {by}")
    n = F.row_number().over(Window.partitionBy(key).orderBy("start"))
    return units.withColumn("n", n).select(key, F.concat(F.col(key).cast("string"), F.lit("-"), F.format_string("%03d", "n")).alias("unit"), "n", "start", "end", "heading")
