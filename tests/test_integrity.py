"""The rule registry over corpora written here: one sound corpus of each kind, and one with each defect; all read and checked together."""

from __future__ import annotations

import copy
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import integrity
from corpuslens.sources import corpus as reader
from corpuslens.sources.corpus import STAMP_KEY

TEXT = "Wind turbines stand on the ridge.\nThe grid operator pays for balancing, and balancing is dear.\nNobody asked the village.\n"
QUOTE = "The grid operator pays for balancing"
WHEN = {"produced_by": {"tool": "t", "method": "manual"}, "created_at": "2026-01-02T03:04:05Z"}


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def jcs(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def short(prefix: str, key: str) -> str:
    return f"{prefix}-{sha(key)[:12]}"


class Made:
    """The objects of one corpus, to be changed before they are written. ids() mints what follows from the content."""

    def __init__(self, second: bool = False, coded: bool = False) -> None:
        self.text = TEXT
        rep, src = f"rep-{sha(TEXT)[:12]}", short("src", f"src\nsha256:{sha(TEXT)}")
        self.path = "sources/one/representations/text.md"
        self.source = {"source_id": src, "source_kind": "document", "title": "One", "extractions_path": "sources/one/extractions.jsonl", STAMP_KEY: WHEN, "representations": [{"representation_id": rep, "role": "clean_markdown", "media_type": "text/markdown", "path": self.path, "sha256": f"sha256:{sha(TEXT)}", STAMP_KEY: WHEN}]}
        start = TEXT.index(QUOTE)
        self.ext = {"source_id": src, "representation_ref": rep, "type": "quote", "direct_quote": QUOTE, "locator": {"type": "char_range", "representation_ref": rep, "value": {"start": start, "end": start + len(QUOTE)}}, STAMP_KEY: WHEN}
        self.mint_ext(self.ext)
        self.more: list[dict] = []
        self.tail = ""
        self.files: dict[str, str] = {}
        self.gen = self.syn = self.book = self.coding = None
        self.manifest = {"set_id": "cds-one", "coders": [{"coder": "a", "kind": "human"}]}
        if second:
            out = f'They say "{QUOTE}" [{self.ext["extraction_id"]}] of {src}.\n'
            digest = f"sha256:{sha(TEXT)}"
            derived = {"source_ids": [src], "representation_refs": [rep], "extraction_ids": [self.ext["extraction_id"]]}
            ids = sorted(x for v in derived.values() for x in v)
            self.gen = {"generation_id": short("gen", f"gen\nsummary\n{jcs(ids)}\n{digest}"), "type": "summary", "output": {"path": "sources/one/generated/out.md", "sha256": f"sha256:{sha(out)}"}, STAMP_KEY: WHEN | {"derived_from": derived, "input_digest": digest}}
            claim = {"claim_id": "c1", "text": "It pays.", "evidence_ids": [self.ext["extraction_id"]], "source_ids": [src]}
            self.syn = {"synthesis_id": short("syn", f"syn\nanswer\nWho pays?\n{jcs(ids)}"), "type": "answer", "question": "Who pays?", "claims": [claim], "output": {"path": "syntheses/s/out.md", "sha256": f"sha256:{sha(out)}"}, STAMP_KEY: WHEN | {"derived_from": derived, "input_digest": digest}}
            self.files |= {"sources/one/generated/out.md": out, "syntheses/s/out.md": out}
            self.event = {"event_id": "evt-000001", "activity_type": "generate", "tool": "t", "started_at": "2026-01-02T03:04:05Z", "status": "success", "inputs": {"source_ids": [src]}, "outputs": {"generation_ids": [self.gen["generation_id"]]}}
        if coded:
            codes = [{"code": "operator", "label": "Operator", "definition": "Runs it."}, {"code": "grid", "label": "Grid", "parent": "operator"}]
            self.book = {"codebook_id": short("cbk", "cbk\nown\nactor"), "namespace": "own", "slug": "actor", "title": "Actor", "codes": codes, STAMP_KEY: WHEN}
            self.coding = {"codebook_ref": self.book["codebook_id"], "code": "grid", "target": {"kind": "extraction", "id": self.ext["extraction_id"]}, "coder": "a", STAMP_KEY: WHEN}
            self.mint_coding()

    @staticmethod
    def mint_ext(x: dict) -> None:
        value = {k: x["locator"][k] for k in ("type", "representation_ref", "value")}
        x["extraction_id"] = short("ext", "\n".join(("ext", x["source_id"], x["representation_ref"], jcs(value), x.get("direct_quote") or x.get("text") or "")))

    def mint_coding(self) -> None:
        c = self.coding
        label = {"code": c["code"]} if c.get("code") else {"value": c.get("value")}
        c["coding_id"] = short("cod", "\n".join(("cod", c["codebook_ref"], c["target"]["kind"], c["target"]["id"], c["coder"], jcs(label))))

    def write(self, root) -> None:
        def put(rel: str, text: str) -> None:
            (root / rel).parent.mkdir(parents=True, exist_ok=True)
            (root / rel).write_text(text)

        sections = {"sources": "sources/", STAMP_KEY: f"{STAMP_KEY}/events.jsonl"}
        if self.syn:
            sections["syntheses"] = "syntheses/"
        if self.book:
            sections |= {"codebooks": "codebooks/", "codings": "codings/"}
        put("corpus.json", json.dumps({"own_spec_version": "1.15.1", "corpus_id": "cor-000000000001", "sections": sections, "counts": {"sources": 1}, "sources": [{"source_id": self.source["source_id"], "path": "sources/one/"}]}))
        put("sources/one/source.json", json.dumps(self.source))
        if self.text is not None:
            put("sources/one/representations/text.md", self.text)
        put("sources/one/extractions.jsonl", "".join(json.dumps(x) + "\n" for x in (self.ext, *self.more)) + self.tail)
        for rel, text in self.files.items():
            put(rel, text)
        if self.gen:
            put("sources/one/generated/g.json", json.dumps(self.gen))
            put("syntheses/s/synthesis.json", json.dumps(self.syn))
            if self.event:
                put(f"{STAMP_KEY}/events.jsonl", json.dumps(self.event) + "\n")
        if self.book:
            put("codebooks/b.json", json.dumps(self.book))
            put("codings/cds/manifest.json", json.dumps(self.manifest))
            put("codings/cds/items.jsonl", json.dumps(self.coding) + "\n")


def rewrite(m: Made, out: str) -> None:
    """Another derived text, with its hash."""
    for x in (m.gen, m.syn):
        m.files[x["output"]["path"]] = out
        x["output"]["sha256"] = f"sha256:{sha(out)}"


def other(m: Made, **change) -> dict:
    x = copy.deepcopy(m.ext) | change
    Made.mint_ext(x)
    m.more.append(x)
    return x


def shifted(m: Made) -> None:
    m.ext["locator"]["value"] = {"start": 5, "end": 5 + len(QUOTE)}
    Made.mint_ext(m.ext)


def outside(m: Made) -> None:
    m.ext["locator"]["value"] = {"start": 500, "end": 530}
    Made.mint_ext(m.ext)


def recoded(m: Made, **change) -> None:
    m.coding.update(change)
    m.mint_coding()


def second_source(m: Made, **change) -> dict:
    """The same bytes in another source."""
    m.files["sources/two/t.md"] = m.text
    rep = copy.deepcopy(m.source["representations"][0]) | {"path": "sources/two/t.md"} | change
    m.files["sources/two/source.json"] = json.dumps({"source_id": short("src", "src\nhttps://example.org/two"), "source_kind": "document", "retrieval": {"original_url": "https://example.org/two"}, "representations": [rep], STAMP_KEY: WHEN})
    return rep


#: name: (kind, change, codes that must be found)
CASES = {
    "quote fails": ("", lambda m: m.ext.update(direct_quote="The grid operator pays for nothing") or Made.mint_ext(m.ext), {"quote_gate_failed"}),
    "place drifts": ("", shifted, {"quote_gate_failed"}),
    "range outside": ("", outside, {"locator_range_invalid"}),
    "hash differs": ("", lambda m: m.source["representations"][0].update(sha256="sha256:" + "0" * 64), {"rep_hash_mismatch"}),
    "id differs": ("", lambda m: m.ext.update(extraction_id="ext-000000000000"), {"id_mismatch"}),
    "id twice": ("", lambda m: m.more.append(m.ext), {"id_duplicate"}),
    "id malformed": ("", lambda m: m.ext.update(extraction_id="ext-1"), {"id_format", "id_mismatch"}),
    "no stamp": ("", lambda m: m.ext.pop(STAMP_KEY), {f"missing_{STAMP_KEY}"}),
    "path escapes": ("", lambda m: m.source["representations"][0].update(path="../x.md"), {"path_escape", "filename_illegal"}),
    "file missing": ("", lambda m: setattr(m, "text", None), {"missing_file"}),
    "no representations": ("", lambda m: m.source.update(representations=[]), {"missing_representation", "dangling_representation"}),
    "torn line": ("", lambda m: setattr(m, "tail", '{"extraction_id": "ext-'), {"jsonl_torn_tail"}),
    "broken line": ("", lambda m: setattr(m, "tail", "{broken\n"), {"jsonl_invalid"}),
    "kind missing": ("", lambda m: m.source.pop("source_kind"), {"schema_invalid"}),
    "other locator": ("", lambda m: m.ext["locator"].update(type="page"), {"quote_locator_missing"}),
    "other representation": ("", lambda m: m.ext["locator"].update(representation_ref="rep-000000000000"), {"locator_rep_mismatch"}),
    "no text": ("", lambda m: m.source["representations"][0].update(media_type="image/png"), {"quote_rep_not_text"}),
    "no such source": ("", lambda m: m.ext.update(source_id="src-000000000000") or Made.mint_ext(m.ext), {"dangling_source"}),
    "retracted passage": ("", lambda m: m.ext.update(status="retracted"), {"flagged_extraction"}),
    "confidence": ("", lambda m: m.ext.update(confidence="high", confidence_score=0.2), {"confidence_inconsistent"}),
    "confidence gap": ("", lambda m: m.ext.update(confidence="medium", confidence_score=0.335), {"confidence_inconsistent"}),
    "own type": ("", lambda m: m.ext.update(type="x-own"), {"x_extension"}),
    "normalised": ("", lambda m: m.ext.update(anchoring={"method": "normalized", "rules": ["dash"]}), {"anchored_by_normalization"}),
    "secondary dangling": ("", lambda m: m.ext.update(secondary_locators=[{"type": "page", "representation_ref": "rep-000000000000", "value": 3}]), {"secondary_locator_dangling"}),
    "lines outside": ("", lambda m: m.ext.update(secondary_locators=[{"type": "line_range", "representation_ref": m.ext["representation_ref"], "value": {"start": 2, "end": 9}}]), {"line_range_out_of_bounds"}),
    "shared bytes": ("", second_source, {"representation_shared"}),
    "same id, other bytes": ("", lambda m: second_source(m, sha256="sha256:" + "1" * 64), {"id_duplicate"}),
    "unknown scheme": ("", lambda m: m.source.update(identifiers=[{"scheme": "shelf", "value": "1"}]), {"identifier_scheme_unknown"}),
    "relation dangling": ("", lambda m: m.source.update(relations=[{"type": "cites", "target": "src-ffffffffffff"}]), {"relation_dangling"}),
    "cites unknown": ("second", lambda m: rewrite(m, f'"{QUOTE}" [ext-ffffffffffff] and "{QUOTE}" [{m.ext["extraction_id"]}] {m.source["source_id"]}'), {"output_cites_unknown_extraction"}),
    "cites wrongly": ("second", lambda m: rewrite(m, f'"The grid operator pays" [{m.ext["extraction_id"]}] {m.source["source_id"]}'), {"output_quote_mismatch"}),
    "paraphrase quoted": ("second", lambda m: rewrite(m, f'"x" [{other(m, direct_quote=None, text="It pays.")["extraction_id"]}] and "{QUOTE}" [{m.ext["extraction_id"]}] {m.source["source_id"]}'), {"cited_extraction_not_quotable"}),
    "uncited quote": ("second", lambda m: rewrite(m, f'"{QUOTE}" [{m.ext["extraction_id"]}] {m.source["source_id"]} and "nobody is named for these words".'), {"output_quote_uncited"}),
    "uncited evidence": ("second", lambda m: rewrite(m, "Nothing is cited."), {"uncited_in_output"}),
    "output changed": ("second", lambda m: m.files.update({"syntheses/s/out.md": m.files["syntheses/s/out.md"] + "!"}), {"output_hash_mismatch"}),
    "output missing": ("second", lambda m: m.files.pop("syntheses/s/out.md"), {"missing_output"}),
    "claim without source": ("second", lambda m: m.syn["claims"][0].update(source_ids=[]), {"claim_missing_source"}),
    "evidence dangling": ("second", lambda m: m.syn["claims"][0].update(evidence_ids=["ext-ffffffffffff"]), {"dangling_extraction"}),
    "no inputs": ("second", lambda m: m.gen[STAMP_KEY].pop("derived_from"), {"missing_derived_from"}),
    "no digest": ("second", lambda m: m.gen[STAMP_KEY].pop("input_digest"), {"missing_input_digest"}),
    "stale": ("second", lambda m: m.syn[STAMP_KEY].update(input_digest="sha256:" + "2" * 64), {"stale_input"}),
    "supersedes itself": ("second", lambda m: m.syn.update(supersedes=m.syn["synthesis_id"]), {"dangling_synthesis"}),
    "no journal": ("second", lambda m: setattr(m, "event", None), {"missing_journal"}),
    "event incomplete": ("second", lambda m: m.event.pop("tool"), {"event_invalid"}),
    "event dangling": ("second", lambda m: m.event["outputs"].update(source_ids=["src-ffffffffffff"]), {"event_dangling_ref"}),
    "retracted cited": ("second", lambda m: m.ext.update(status="retracted"), {"cites_retracted"}),
    "superseded cited": ("second", lambda m: m.ext.update(status="superseded"), {"cites_superseded"}),
    "no codebook": ("coded", lambda m: recoded(m, codebook_ref="cbk-000000000000"), {"dangling_codebook"}),
    "no target": ("coded", lambda m: recoded(m, target={"kind": "extraction", "id": "ext-ffffffffffff"}), {"dangling_coding_target"}),
    "target of another kind": ("coded", lambda m: recoded(m, target={"kind": "source", "id": m.ext["extraction_id"]}), {"dangling_coding_target"}),
    "unknown code": ("coded", lambda m: recoded(m, code="nobody"), {"coding_code_unknown"}),
    "value in a closed book": ("coded", lambda m: recoded(m, code=None, value="free"), {"coding_open_closed_mismatch"}),
    "coding unstamped": ("coded", lambda m: m.coding.pop(STAMP_KEY), {f"missing_{STAMP_KEY}"}),
    "coding id differs": ("coded", lambda m: m.coding.update(coding_id="cod-000000000000"), {"id_mismatch"}),
    "coder undeclared": ("coded", lambda m: recoded(m, coder="z"), {"coding_coder_undeclared"}),
    "code twice": ("coded", lambda m: m.book["codes"].append({"code": "grid"}), {"codebook_code_duplicate"}),
    "parent missing": ("coded", lambda m: m.book["codes"][1].update(parent="nobody"), {"codebook_parent_dangling"}),
    "parents in a ring": ("coded", lambda m: m.book["codes"][0].update(parent="grid"), {"codebook_parent_cycle"}),
    "book changed": ("coded", lambda m: m.book.update(revision_digest="sha256:" + "3" * 64), {"codebook_revision_stale"}),
    "coding drifts": ("coded", lambda m: m.book.update(revision_digest="sha256:" + sha(jcs(m.book["codes"]))) or m.coding.update(codebook_revision_digest="sha256:" + "3" * 64), {"coding_codebook_drift"}),
    "broken passage coded": ("coded", lambda m: shifted(m) or recoded(m, target={"kind": "extraction", "id": m.ext["extraction_id"]}), {"coding_targets_failed_gate", "quote_gate_failed"}),
}
WARNINGS_ALONE = {"torn line", "retracted passage", "confidence", "confidence gap", "own type", "normalised", "secondary dangling", "lines outside", "shared bytes", "unknown scheme", "relation dangling", "uncited quote", "stale", "event dangling", "superseded cited", "coder undeclared", "book changed", "coding drifts"}


@pytest.fixture(scope="module")
def checked(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("corpora")
    for kind in ("", "second", "coded"):
        Made(kind == "second", kind == "coded").write(base / f"sound {kind}".strip().replace(" ", "-"))
    for name, (kind, change, _) in CASES.items():
        made = Made(kind == "second", kind == "coded")
        change(made)
        made.write(base / name.replace(" ", "-"))
    corpora = reader.load(spark, str(base))
    found = integrity.findings(corpora)
    rows = found.groupBy("corpus").agg(F.collect_set("code").alias("codes")).collect()
    report = {r["corpus"]: r for r in integrity.report(corpora, found).collect()}
    return {r["corpus"]: set(r["codes"]) for r in rows}, report


@pytest.mark.parametrize("name", CASES)
def test_defect_is_found(checked, name):
    codes, report = checked
    at = name.replace(" ", "-")
    assert CASES[name][2] <= codes.get(at, set())
    assert (report[at]["status"] == "passed") == (name in WARNINGS_ALONE)


@pytest.mark.parametrize(("name", "level"), [("sound", 1), ("sound-second", 2), ("sound-coded", 1)])
def test_sound_corpora_pass(checked, name, level):
    codes, report = checked
    assert codes.get(name, set()) <= {"codebook_code_unused"}
    assert (report[name]["status"], report[name]["level"], report[name]["errors"]) == ("passed", level, 0)


def test_levels(checked):
    _, report = checked
    assert report["output-changed"]["level"] == 1 and report["hash-differs"]["level"] == 0
