"""The rule registry: every rule is one small query over the object tables, all findings are one table.

findings: (corpus, code, severity, level, object_id, detail); level is null for warnings. Ids resolve inside their own corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ident
from ..functions import text as tx
from ..sources.corpus import STAMP_KEY, Corpora
from ..sources.shared import checkpointed
from . import gates

#: The kinds of ids.
PREFIXES = {"sources": ("source_id", "src"), "extractions": ("extraction_id", "ext"), "generations": ("generation_id", "gen"), "syntheses": ("synthesis_id", "syn"), "codebooks": ("codebook_id", "cbk"), "codings": ("coding_id", "cod")}
#: What an object must have.
REQUIRED = {
    "corpora": ("spec_version", "corpus_id", "sections"),
    "sources": ("source_id", "source_kind", "representations"),
    "extractions": ("extraction_id", "source_id", "representation_ref", "type", "locator"),
    "generations": ("generation_id", "type", "stamp"),
    "syntheses": ("synthesis_id", "type", "stamp"),
    "codebooks": ("codebook_id", "namespace", "slug", "codes"),
    "codings": ("coding_id", "codebook_ref", "target", "coder"),
    "coding_sets": ("set_id", "coders"),
}
#: The bands of a confidence score.
BANDS = {"high": (0.67, 1.0), "medium": (0.34, 0.66), "low": (0.0, 0.33)}
#: Identifier schemes.
SCHEMES = ("doi", "isbn", "issn", "pmid", "pmcid", "arxiv", "handle", "url", "urn", "openalex", "wikidata")


def finding(rows: DataFrame, code: str | Column, object_id: str | Column, severity: str = "error", level: int | None = None, detail: str | Column | None = None) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else c if isinstance(c, Column) else F.col(c).cast("string")
    return rows.select("corpus", (F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(severity).alias("severity"), F.lit(level).cast("int").alias("level"), text(object_id).alias("object_id"), text(detail).alias("detail"))


def warning(rows: DataFrame, code: str, object_id: str | Column, detail: str | Column | None = None) -> DataFrame:
    return finding(rows, code, object_id, "warning", None, detail)


def missing(rows: DataFrame, key: str, known: DataFrame, id_: str) -> DataFrame:
    """Rows whose key, if they have one, is no id of their corpus."""
    return rows.where(F.col(key).isNotNull()).join(known.select("corpus", F.col(id_).alias(key)).distinct(), ["corpus", key], "left_anti")


def has_stamp() -> Column:
    return F.coalesce(F.col("stamp.produced_by.tool") != "", F.lit(False)) & F.coalesce(F.col("stamp.created_at") != "", F.lit(False))


def value_number(name: str, field: str = "locator") -> Column:
    return F.get_json_object(f"{field}.value", f"$.{name}").try_cast("long")


def shape_rules(c: Corpora) -> list[DataFrame]:
    """Rules 0.1, 0.2, 0.6, 0.7 and what the reader met."""
    version = F.coalesce("spec_version", F.lit(""))
    errors = ~F.col("code").isin("jsonl_torn_tail")
    out = [
        finding(c.corpora.where(~version.rlike("^1\\.")), "spec_version_missing", F.lit("corpus.json"), level=0, detail="spec_version"),
        finding(c.findings.where(errors), F.col("code"), "object_id", level=0, detail="detail"),
        warning(c.findings.where(~errors), "jsonl_torn_tail", "object_id", "detail"),
    ]
    for kind, columns in REQUIRED.items():
        rows = getattr(c, kind)
        id_ = PREFIXES[kind][0] if kind in PREFIXES else "at"
        lost = F.filter(F.array(*[F.when(F.col(x).isNull(), F.lit(x)) for x in columns]), lambda x: x.isNotNull())
        out.append(finding(rows.where(F.size(lost) > 0), "schema_invalid", F.coalesce(id_, "at"), level=0, detail=F.array_join(lost, ", ")))
    paths = c.representations.select("corpus", F.col("representation_id").alias("id"), "path")
    for kind, id_ in (("generations", "generation_id"), ("syntheses", "synthesis_id")):
        paths = paths.union(getattr(c, kind).where("output.value is null").select("corpus", id_, "output.path"))
    bad = paths.where("path is not null").withColumn("problem", ident.filename_problem(F.col("path"))).where("problem is not null")
    return [*out, finding(bad, "filename_illegal", "id", level=0, detail="problem")]


def file_rules(c: Corpora) -> list[DataFrame]:
    """Rules 0.3 to 0.5: containment, existence, hash."""
    inside = ident.lexically_inside(F.coalesce("path", F.lit("")))
    reps = c.representations.withColumn("inside", inside)
    met = reps.where("inside").join(c.files.select("corpus", F.col("rel").alias("path"), F.sha2("content", 256).alias("actual")), ["corpus", "path"], "left")
    return [
        finding(c.sources.where(F.coalesce(F.size("representations"), F.lit(0)) <= 0), "missing_representation", "source_id", level=0),
        finding(reps.where("not inside"), "path_escape", "representation_id", level=0, detail="path"),
        finding(met.where("actual is null"), "missing_file", "representation_id", level=0, detail="path"),
        finding(met.where(F.col("actual") != ident.bare_hash(F.col("sha256"))), "rep_hash_mismatch", "representation_id", level=0, detail="actual"),
    ]


def id_rules(c: Corpora) -> list[DataFrame]:
    """Rule 1.1: shape, uniqueness over all kinds, recomputation."""
    ids = None
    for kind, (column, prefix) in PREFIXES.items():
        rows = getattr(c, kind).select("corpus", F.col(column).alias("id"), F.lit(prefix).alias("kind"))
        ids = rows if ids is None else ids.union(rows)
    per = Window.partitionBy("corpus", "representation_id")
    reps = c.representations.withColumn("hash", ident.bare_hash(F.col("sha256")))
    reps = reps.withColumns({"n": F.count("*").over(per), "low": F.min("hash").over(per), "high": F.max("hash").over(per)})
    same = (F.col("low") == F.col("high")) & (F.col("low") != "")
    repeated = reps.where("n > 1").groupBy("corpus", "representation_id").agg(F.bool_and(same).alias("same"))
    ids = ids.union(c.representations.select("corpus", "representation_id", F.lit("rep")).distinct())
    counted = ids.groupBy("corpus", "id").agg(F.count("*").alias("n"), F.max("kind").alias("kind"))
    form = F.col("id").rlike("^(src|rep|img|ext|gen|syn|cbk|cod)-[0-9a-f]{12}$")
    bytes_ = c.files.select("corpus", F.col("rel").alias("path"), ident.mint_rep_id(F.col("content")).alias("minted"))
    out = [
        finding(counted.where(~F.coalesce(form, F.lit(False))), "id_format", "id", level=1, detail="kind"),
        finding(counted.where("n > 1 and id is not null"), "id_duplicate", "id", level=1),
        finding(repeated.where("not same"), "id_duplicate", "representation_id", level=1),
        warning(repeated.where("same"), "representation_shared", "representation_id"),
    ]
    met = c.representations.join(bytes_, ["corpus", "path"])
    out.append(finding(met.where(F.substring("representation_id", 5, 12) != F.substring("minted", 5, 12)), "id_mismatch", "representation_id", level=1, detail="minted"))
    urls = F.filter(F.array(*[ident.canonical_url(F.col(x)) for x in ("retrieval.original_url", "retrieval.final_url", "bibliographic.url")]), lambda x: x.isNotNull())
    hashes = F.filter(F.coalesce(F.transform("representations", lambda r: r["sha256"]), F.array().cast("array<string>")), lambda x: x.isNotNull())
    none = F.lit(None).cast("string")
    made = F.concat(F.transform(urls, lambda u: ident.mint_src_id(u, none)), F.transform(hashes, lambda h: ident.mint_src_id(none, h)))
    out.append(finding(c.sources.withColumn("made", made).where((F.size("made") > 0) & ~F.array_contains("made", F.col("source_id"))), "id_mismatch", "source_id", level=1))
    locator = ident.char_range_json(F.col("locator.representation_ref"), value_number("start"), value_number("end"))
    exts = c.extractions.where("locator.type = 'char_range' and source_id is not null and representation_ref is not null").withColumn("made", ident.mint_ext_id(F.col("source_id"), F.col("representation_ref"), locator, F.col("direct_quote"), F.col("text")))
    out.append(finding(exts.where("made <> extraction_id"), "id_mismatch", "extraction_id", level=1, detail="made"))
    d = "stamp.derived_from"
    inputs = ident.collect_input_ids(*[F.col(f"{d}.{x}") for x in ("source_ids", "representation_refs", "extraction_ids", "generation_ids", "synthesis_ids")])
    gens = c.generations.where("type is not null and stamp.input_digest is not null").withColumn("made", ident.mint_gen_id(F.col("type"), inputs, F.col("stamp.input_digest")))
    out.append(warning(gens.where("made <> generation_id"), "id_mismatch", "generation_id", "made"))
    syns = c.syntheses.where("type is not null").withColumn("made", ident.mint_syn_id(F.col("type"), F.col("question"), inputs))
    out.append(warning(syns.where("made <> synthesis_id"), "id_mismatch", "synthesis_id", "made"))
    books = c.codebooks.where("namespace <> '' and slug <> ''").withColumn("made", ident.mint_cbk_id(F.col("namespace"), F.col("slug")))
    out.append(finding(books.where("made <> codebook_id"), "id_mismatch", "codebook_id", level=1, detail="made"))
    value = F.when(F.col("value").isNotNull(), ident.json_string(F.col("value")))
    cods = c.codings.withColumn("made", ident.mint_cod_id(F.col("codebook_ref"), F.col("target.kind"), F.col("target.id"), F.col("coder"), F.col("code"), value))
    out.append(finding(cods.where("made <> coding_id"), "id_mismatch", "coding_id", level=1, detail="made"))
    return out


def reference_rules(c: Corpora) -> list[DataFrame]:
    """Rules 1.2, 1.3, 1.7, 1.8, 2.1, 2.2 and relations."""
    ext = c.extractions
    out = [
        warning(missing(c.representations, "parent_representation_ref", c.representations, "representation_id"), "dangling_representation", "representation_id", "parent_representation_ref"),
        finding(missing(ext, "source_id", c.sources, "source_id"), "dangling_source", "extraction_id", level=1, detail="source_id"),
        finding(missing(ext, "representation_ref", c.representations, "representation_id"), "dangling_representation", "extraction_id", level=1, detail="representation_ref"),
        finding(ext.where("locator is not null and not (locator.representation_ref <=> representation_ref)"), "locator_rep_mismatch", "extraction_id", level=1),
        warning(ext.where("coalesce(status, 'active') <> 'active'"), "flagged_extraction", "extraction_id", "status"),
        warning(ext.where("anchoring.method = 'normalized'"), "anchored_by_normalization", "extraction_id", F.array_join("anchoring.rules", ",")),
        warning(ext.where("type like 'x-%'"), "x_extension", "extraction_id", "type"),
    ]
    for kind, id_ in (("representations", "representation_id"), ("extractions", "extraction_id"), ("generations", "generation_id"), ("syntheses", "synthesis_id")):
        out.append(finding(getattr(c, kind).where(~has_stamp()), f"missing_{STAMP_KEY}", id_, level=1))
    for kind, id_ in (("codebooks", "codebook_id"), ("codings", "coding_id")):
        out.append(finding(getattr(c, kind).where("coalesce(stamp.produced_by.tool, '') = ''"), f"missing_{STAMP_KEY}", id_, level=1))
    band = reduce(lambda a, b: a.when(F.col("confidence") == b[0], ~F.col("confidence_score").between(*b[1])), BANDS.items(), F.when(F.lit(False), F.lit(False)))
    out.append(warning(ext.where(F.coalesce(band, F.lit(False))), "confidence_inconsistent", "extraction_id", "confidence"))
    lists = {"source_ids": ("dangling_source", c.sources, "source_id"), "representation_refs": ("dangling_representation", c.representations, "representation_id"), "extraction_ids": ("dangling_extraction", c.extractions, "extraction_id"), "generation_ids": ("dangling_generation", c.generations, "generation_id"), "synthesis_ids": ("dangling_synthesis", c.syntheses, "synthesis_id")}
    derived = c.generations.select("corpus", F.col("generation_id").alias("id"), "stamp", F.lit(True).alias("generated"))
    derived = derived.union(c.syntheses.select("corpus", "synthesis_id", "stamp", F.lit(False)))
    sources = F.coalesce(F.size("stamp.derived_from.source_ids"), F.lit(0)) > 0
    without = F.col("stamp.derived_from").isNull() | F.col("generated") & ~sources
    out.append(finding(derived.where(without), "missing_derived_from", "id", level=2))
    out.append(finding(derived.where("coalesce(stamp.input_digest, '') = ''"), "missing_input_digest", "id", level=2))
    for name, (code, known, id_) in lists.items():
        named = derived.where(~without).select("corpus", "id", F.explode(f"stamp.derived_from.{name}").alias("ref"))
        out.append(finding(missing(named, "ref", known, id_), code, "id", level=2, detail="ref"))
    one = derived.select("corpus", "id", F.col("stamp.input_digest").alias("digest"), F.explode("stamp.derived_from.representation_refs").alias("representation_id"))
    met = one.join(c.representations.select("corpus", "representation_id", "path").dropDuplicates(["corpus", "representation_id"]), ["corpus", "representation_id"])
    met = met.groupBy("corpus", "id").agg(F.count("*").alias("n"), F.first("path").alias("path"), F.first("digest").alias("digest")).where("n = 1 and digest is not null")
    met = met.join(c.files.select("corpus", F.col("rel").alias("path"), F.sha2("content", 256).alias("actual")), ["corpus", "path"])
    out.append(warning(met.where(F.col("actual") != ident.bare_hash(F.col("digest"))), "stale_input", "id", "actual"))
    for column in ("supersedes", "superseded_by"):
        out.append(finding(missing(c.syntheses, column, c.syntheses, "synthesis_id"), "dangling_synthesis", "synthesis_id", level=2, detail=column))
    out.append(finding(c.syntheses.where("supersedes = synthesis_id"), "dangling_synthesis", "synthesis_id", level=2, detail="supersedes"))
    claims = c.syntheses.select("corpus", "synthesis_id", F.explode("claims").alias("c"))
    evidence = claims.select("corpus", "synthesis_id", "c.source_ids", F.explode("c.evidence_ids").alias("evidence"))
    out.append(finding(missing(evidence, "evidence", ext, "extraction_id"), "dangling_extraction", "synthesis_id", level=2, detail="evidence"))
    backed = evidence.join(ext.select("corpus", F.col("extraction_id").alias("evidence"), "source_id"), ["corpus", "evidence"])
    listed = F.coalesce(F.array_contains("source_ids", F.col("source_id")), F.lit(False))
    out.append(finding(backed.where(~listed), "claim_missing_source", "synthesis_id", level=2, detail="evidence"))
    named = claims.select("corpus", "synthesis_id", F.explode("c.source_ids").alias("ref"))
    out.append(finding(missing(named, "ref", c.sources, "source_id"), "dangling_source", "synthesis_id", level=2, detail="ref"))
    relations = c.sources.select("corpus", "source_id", F.explode("relations").alias("r")).select("corpus", "source_id", "r.target").where("target like 'src-%'")
    out.append(warning(missing(relations, "target", c.sources, "source_id"), "relation_dangling", "source_id", "target"))
    schemes = c.sources.select("corpus", "source_id", F.explode("identifiers.scheme").alias("scheme"))
    out.append(warning(schemes.where(~F.col("scheme").isin(*SCHEMES) & ~F.col("scheme").rlike("^x-[a-z0-9-]+$")), "identifier_scheme_unknown", "source_id", "scheme"))
    aliases = c.sources.select("corpus", "source_id", F.explode("aliases").alias("space", "alias"))
    clash = aliases.groupBy("corpus", "space", "alias").agg(F.countDistinct("source_id").alias("n")).where("n > 1")
    out.append(warning(clash, "alias_collision", F.concat_ws(":", "space", "alias")))
    return out


def gated(c: Corpora) -> DataFrame:
    """(corpus, extraction_id, code): active quoted extractions and why their quotation isn't at its place, or null. A text is met once."""
    texts = c.files.select("corpus", F.col("rel").alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("whole"))
    reps = c.representations.select("corpus", F.col("representation_id").alias("representation_ref"), "media_type", "path").dropDuplicates(["corpus", "representation_ref"])
    quoted = c.extractions.where("coalesce(status, 'active') = 'active' and direct_quote is not null")
    rows = quoted.join(reps, ["corpus", "representation_ref"], "left").join(texts, ["corpus", "path"], "left")
    here = F.col("media_type").isNotNull()
    code = F.when(F.coalesce("locator.type", F.lit("")) != "char_range", "quote_locator_missing")
    code = code.when(here & ~gates.is_textual(F.col("media_type")), "quote_rep_not_text")
    met = gates.hop_b_code(F.col("whole"), F.col("whole").isNotNull(), F.col("locator.type"), value_number("start"), value_number("end"), F.col("direct_quote"))
    there = rows.join(c.files.select("corpus", F.col("rel").alias("path")).withColumn("there", F.lit(True)), ["corpus", "path"], "left")
    return there.select("corpus", "extraction_id", code.when(F.col("there"), met).alias("code"))


def quote_rules(c: Corpora, gate: DataFrame) -> list[DataFrame]:
    """Rules 1.4 to 1.6; an extraction out of range is named once."""
    ranges = c.extractions.where("locator.type in ('char_range', 'line_range')")
    a, b = value_number("start"), value_number("end")
    out = ranges.where(~F.coalesce(a <= b, F.lit(False))).select("corpus", "extraction_id", F.lit("locator_range_invalid").alias("code"))
    found = gate.where("code is not null").union(out).distinct()
    return [finding(found, F.col("code"), "extraction_id", level=1), *locator_rules(c)]


def locator_rules(c: Corpora) -> list[DataFrame]:
    """Secondary locators: their representation, its source, and whether boxes, lines and times lie inside it."""
    loc = c.extractions.select("corpus", "extraction_id", "source_id", F.explode("secondary_locators").alias("l")).select("corpus", "extraction_id", "source_id", F.col("l.type").alias("type"), F.col("l.representation_ref").alias("representation_id"), F.col("l.value").alias("v"))
    reps = c.representations.select("corpus", "representation_id", F.col("source_id").alias("owner"), "dimensions", "duration_seconds", "path")
    met = loc.join(reps, ["corpus", "representation_id"])
    lines = c.files.select("corpus", F.col("rel").alias("path"), F.size(tx.text_lines(F.col("content").cast("string"))).alias("lines"))
    number = lambda name: F.get_json_object("v", f"$.{name}").try_cast("double")
    box = (number("x") < 0) | (number("y") < 0) | (number("x") + number("w") > F.col("dimensions.width")) | (number("y") + number("h") > F.col("dimensions.height"))
    ranged = met.where("type = 'line_range'").join(lines, ["corpus", "path"])
    return [
        warning(missing(loc, "representation_id", c.representations, "representation_id"), "secondary_locator_dangling", "extraction_id", "representation_id"),
        warning(met.where("owner <> source_id"), "secondary_locator_cross_source", "extraction_id", "representation_id"),
        warning(met.where((F.col("type") == "bbox") & F.coalesce(box, F.lit(False))), "bbox_out_of_bounds", "extraction_id"),
        warning(ranged.where((number("start") < 1) | (number("end") > F.col("lines"))), "line_range_out_of_bounds", "extraction_id"),
        warning(met.where((F.col("type") == "timestamp") & gates.timestamp_problem(number("start"), number("end"), F.col("duration_seconds")).isNotNull()), "timestamp_out_of_bounds", "extraction_id"),
    ]


def output_rules(c: Corpora) -> list[DataFrame]:
    """Rules 2.3 to 2.7: derived texts, their quotations, the journal."""
    made = c.generations.select("corpus", F.col("generation_id").alias("object_id"), "output").union(c.syntheses.select("corpus", "synthesis_id", "output"))
    made = made.where("output.path is not null and output.value is null").select("corpus", "object_id", "output.path", "output.sha256")
    inside = made.where(ident.lexically_inside(F.col("path")))
    met = inside.join(c.files.select("corpus", F.col("rel").alias("path"), "content"), ["corpus", "path"], "left").withColumn("output_text", F.try_validate_utf8(F.col("content").cast("string")))
    there = met.where("content is not null")
    text = there.where("output_text is not null").select("corpus", "object_id", "output_text")
    marks = text.select("corpus", "object_id", F.explode(tx.quote_markers(F.col("output_text"))).alias("m")).select("corpus", "object_id", "m.quote", F.col("m.ext_id").alias("extraction_id"))
    known = c.extractions.select("corpus", "extraction_id", "direct_quote", F.coalesce("status", F.lit("active")).alias("status"), F.lit(True).alias("known")).dropDuplicates(["corpus", "extraction_id"])
    cited = marks.join(known, ["corpus", "extraction_id"], "left")
    real = cited.where("known and direct_quote is not null")
    claims = c.syntheses.select("corpus", F.col("synthesis_id").alias("object_id"), F.explode("claims").alias("c")).select("corpus", "object_id", F.explode(F.array_distinct(F.concat(F.coalesce("c.evidence_ids", F.array().cast("array<string>")), F.coalesce("c.source_ids", F.array().cast("array<string>"))))).alias("need")).distinct()
    loose = text.select("corpus", "object_id", F.explode(tx.uncited_quotes(F.col("output_text"))).alias("quote"))
    second = c.generations.select("corpus").union(c.syntheses.select("corpus")).distinct()
    at = F.coalesce(F.try_element_at("sections", F.lit(STAMP_KEY)), F.lit(f"{STAMP_KEY}/events.jsonl"))
    journal = c.corpora.select("corpus", at.alias("rel")).join(c.files.select("corpus", "rel"), ["corpus", "rel"])
    io = c.events.select("corpus", "event_id", F.explode(F.array("inputs", "outputs")).alias("m")).where("m is not null").select("corpus", "event_id", F.explode("m").alias("kind", "ids")).select("corpus", "event_id", F.explode("ids").alias("ref"))
    every = c.representations.select("corpus", F.col("representation_id").alias("id"))
    for kind, (column, _) in PREFIXES.items():
        every = every.union(getattr(c, kind).select("corpus", column))
    wanting = " or ".join(f"{x} is null" for x in ("event_id", "activity_type", "tool", "started_at", "status"))
    return [
        finding(made.where(~ident.lexically_inside(F.col("path"))), "path_escape", "object_id", level=0, detail="path"),
        finding(met.where("content is null"), "missing_output", "object_id", level=2, detail="path"),
        finding(there.where(F.sha2("content", 256) != ident.bare_hash(F.col("sha256"))), "output_hash_mismatch", "object_id", level=2),
        finding(text.join(claims, ["corpus", "object_id"]).where(~F.contains("output_text", F.col("need"))), "uncited_in_output", "object_id", level=2, detail="need"),
        finding(cited.where("known is null"), "output_cites_unknown_extraction", "object_id", level=2, detail="extraction_id"),
        finding(cited.where("known and direct_quote is null"), "cited_extraction_not_quotable", "object_id", level=2, detail="extraction_id"),
        finding(real.where("status = 'retracted'"), "cites_retracted", "object_id", level=2, detail="extraction_id"),
        warning(real.where("status = 'superseded'"), "cites_superseded", "object_id", "extraction_id"),
        finding(real.where("quote <> direct_quote"), "output_quote_mismatch", "object_id", level=2, detail="extraction_id"),
        warning(loose, "output_quote_uncited", "object_id", F.substring("quote", 1, 40)),
        finding(second.join(journal, "corpus", "left_anti"), "missing_journal", F.lit(STAMP_KEY), level=2),
        finding(c.events.where(wanting), "event_invalid", F.coalesce("event_id", F.lit("event")), level=2),
        warning(missing(io, "ref", every, "id"), "event_dangling_ref", "event_id", "ref"),
    ]


def coding_rules(c: Corpora, gate: DataFrame) -> list[DataFrame]:
    """Rules 1.10, 1.11 and the advisory ones about codings."""
    codes = c.codebooks.select("corpus", "codebook_id", F.explode("codes").alias("c")).select("corpus", "codebook_id", "c.*").where("code <> ''")
    unique = codes.groupBy("corpus", "codebook_id", "code").agg(F.count("*").alias("n"), F.min(F.nullif("parent", F.lit(""))).alias("parent"), F.bool_or(F.coalesce("deprecated", F.lit(False))).alias("deprecated"))
    above = unique.select("corpus", "codebook_id", F.col("code").alias("up"), F.col("parent").alias("next"))
    orphans = unique.where("parent is not null").join(above, (unique["corpus"] == above["corpus"]) & (unique["codebook_id"] == above["codebook_id"]) & (F.col("parent") == F.col("up")), "left_anti")
    book = c.codebooks.select("corpus", F.col("codebook_id").alias("codebook_ref"), F.coalesce("closed", F.lit(True)).alias("closed"), F.coalesce("multi_label", F.lit(False)).alias("multi"), F.col("revision_digest").alias("now"), F.transform(F.coalesce("codes", F.array().cast(c.codebooks.schema["codes"].dataType)), lambda x: x["code"]).alias("known")).dropDuplicates(["corpus", "codebook_ref"])
    full = c.codings.withColumns({"has_code": F.coalesce(F.col("code") != "", F.lit(False)), "has_value": F.coalesce(F.col("value") != "", F.lit(False))}).join(book, ["corpus", "codebook_ref"])
    wrong = (F.col("has_code") == F.col("has_value")) | F.col("closed") & F.col("has_value") | ~F.col("closed") & F.col("has_code")
    in_book = F.array_contains("known", F.col("code"))
    targets = c.codings.select("corpus", "coding_id", F.col("target.kind").alias("kind"), F.col("target.id").alias("id"))
    known = c.sources.select("corpus", F.lit("source").alias("kind"), F.col("source_id").alias("id")).union(c.representations.select("corpus", F.lit("representation"), "representation_id")).union(c.extractions.select("corpus", F.lit("extraction"), "extraction_id")).distinct()
    broken = gate.where("code is not null").select("corpus", F.col("extraction_id").alias("id")).union(c.extractions.where("coalesce(status, 'active') <> 'active'").select("corpus", "extraction_id")).distinct()
    declared = c.coding_sets.select("corpus", F.explode("coders.coder").alias("coder")).distinct()
    any_ = declared.select("corpus").distinct()
    active = full.where("coalesce(status, 'active') = 'active' and not multi and target.id is not null and coder is not null")
    label = F.when(F.col("has_code"), F.concat(F.lit("code:"), "code")).otherwise(F.concat(F.lit("value:"), "value"))
    split = active.groupBy("corpus", "codebook_ref", F.col("target.id").alias("id")).agg(F.countDistinct(label).alias("labels"), F.countDistinct("coder").alias("coders")).where("labels > 1 and coders > 1")
    used = full.where(F.col("closed") & ~wrong & in_book).select("corpus", F.col("codebook_ref").alias("codebook_id"), "code").distinct()
    refs = c.coding_sets.select("corpus", "set_id", F.explode("codebook_refs").alias("ref"))
    digest = ident.codebook_digest(F.to_json("codes"))
    return [
        warning(missing(refs, "ref", c.codebooks, "codebook_id"), "dangling_codebook", "set_id", "ref"),
        finding(missing(c.codings, "codebook_ref", c.codebooks, "codebook_id"), "dangling_codebook", "coding_id", level=1, detail="codebook_ref"),
        finding(full.where(wrong), "coding_open_closed_mismatch", "coding_id", level=1),
        finding(full.where(F.col("closed") & ~wrong & ~in_book), "coding_code_unknown", "coding_id", level=1, detail="code"),
        finding(targets.join(known, ["corpus", "kind", "id"], "left_anti"), "dangling_coding_target", "coding_id", level=1, detail="id"),
        warning(targets.where("kind = 'extraction'").join(broken, ["corpus", "id"], "left_semi"), "coding_targets_failed_gate", "coding_id", "id"),
        warning(full.where("codebook_revision_digest <> now"), "coding_codebook_drift", "coding_id"),
        warning(c.codings.join(any_, "corpus", "left_semi").where("coder is not null").join(declared, ["corpus", "coder"], "left_anti"), "coding_coder_undeclared", "coding_id", "coder"),
        warning(split, "coding_disagreement", "id", "codebook_ref"),
        warning(unique.where("not deprecated").join(used, ["corpus", "codebook_id", "code"], "left_anti"), "codebook_code_unused", "codebook_id", "code"),
        finding(unique.where("n > 1"), "codebook_code_duplicate", "codebook_id", level=1, detail="code"),
        finding(orphans, "codebook_parent_dangling", "codebook_id", level=1, detail="parent"),
        finding(_cycles(unique), "codebook_parent_cycle", "codebook_id", level=1, detail="code"),
        warning(c.codebooks.where("revision_digest is not null").where(digest != F.col("revision_digest")), "codebook_revision_stale", "codebook_id"),
    ]


def _cycles(codes: DataFrame) -> DataFrame:
    """Codes whose way up meets itself: each codebook's codes are one row's map, walked inside it."""
    books = codes.where("parent is not null").groupBy("corpus", "codebook_id").agg(F.map_from_entries(F.collect_list(F.struct("code", "parent"))).alias("up"))
    none = F.lit(None).cast("string")

    def ends(code: Column) -> Column:
        """null if the way up from code ends."""
        return F.aggregate(F.sequence(F.lit(1), F.size("up")), F.try_element_at("up", code), lambda at, _: F.when(at.isNotNull(), F.try_element_at("up", at)).otherwise(none))

    return books.select("corpus", "codebook_id", F.explode(F.filter(F.map_keys("up"), lambda x: ends(x).isNotNull())).alias("code"))


def count_rules(c: Corpora) -> list[DataFrame]:
    """The manifest's counts against the objects."""
    rows = None
    for kind in ("sources", "representations", "extractions", "generations", "syntheses", "codebooks", "codings"):
        n = getattr(c, kind).groupBy("corpus").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        rows = n if rows is None else rows.unionByName(n)
    told = c.corpora.select("corpus", F.explode("counts").alias("kind", "told")).where(F.col("kind").isin(*PREFIXES, "representations"))
    both = told.join(rows, ["corpus", "kind"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return [warning(both.where("told <> n"), "counts_mismatch", F.lit("corpus.json"), F.concat_ws(" ", "kind", "told", "n"))]


def findings(c: Corpora) -> DataFrame:
    """(corpus, code, severity, level, object_id, detail) of every rule. Each family of rules is written on its own, so that plans stay small
    and a report doesn't look for the findings again."""
    gate = checkpointed(gated(c))
    families = (shape_rules(c), file_rules(c), id_rules(c), reference_rules(c), quote_rules(c, gate), output_rules(c), coding_rules(c, gate), count_rules(c))
    return reduce(DataFrame.unionByName, [checkpointed(reduce(DataFrame.unionByName, rules)) for rules in families])


def report(c: Corpora, found: DataFrame) -> DataFrame:
    """(corpus, status, level, errors, warnings): the level that each corpus reaches, 2 at most with derived objects, 1 with extractions."""
    second = c.generations.select("corpus").union(c.syntheses.select("corpus")).distinct().withColumn("top", F.lit(2))
    first = c.extractions.select("corpus").distinct().withColumn("top", F.lit(1))
    top = c.corpora.select("corpus").distinct().withColumn("top", F.lit(0)).union(second).union(first).groupBy("corpus").agg(F.max("top").alias("top"))
    error = F.col("severity") == "error"
    per = found.groupBy("corpus").agg(F.count_if(error).alias("errors"), F.count_if(~error).alias("warnings"), F.min(F.when(error, F.col("level"))).alias("worst"))
    both = top.join(per, "corpus", "left")
    level = F.when(F.col("worst") <= 1, 0).when(F.col("worst") == 2, F.least("top", F.lit(1))).otherwise(F.col("top"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return both.select("corpus", F.when(zero("errors") > 0, "failed").otherwise("passed").alias("status"), level.alias("level"), zero("errors").alias("errors"), zero("warnings").alias("warnings"))
