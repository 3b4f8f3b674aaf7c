"""Contracts: semantic answers made into validated contracts with numbered evidence, and the check of finished ones.

Each contract depends on its own row only, so both run inside Arrow batches next to the scan; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.functions import evidence as ev
from tessella.functions import fixed

COLLECTIONS = tuple(fixed.CONTRACT_LIMITS)
SEMANTIC = ("source_languages", "canonical_language", "capability", *COLLECTIONS)
TOP = ("schema_version", "skill_id", "source_hash", *SEMANTIC, "evidence", "extraction")
ARTIFACT = ("artifact", "format", "required", "constraints", "evidence_ids")
STATEMENT = ("statement", "evidence_ids")
ITEM = {"operations": ("action", "target", "outcome", "qualifiers", "evidence_ids"), "inputs": ARTIFACT, "outputs": ARTIFACT, "dependencies": ("name", "type", "required", "evidence_ids"), "preconditions": STATEMENT, "constraints": STATEMENT, "exclusions": STATEMENT, "quality_criteria": STATEMENT}
TEXTS = {"operations": ("action", "target"), "inputs": ("artifact",), "outputs": ("artifact",), "dependencies": ("name",)}
OPTIONAL_TEXTS = {"operations": ("outcome",), "inputs": ("format",), "outputs": ("format",)}
TEXT_LISTS = {"operations": ("qualifiers",), "inputs": ("constraints",), "outputs": ("constraints",)}


@dataclass(frozen=True)
class Extraction:
    provider: str = "injected"
    model: str = "injected"
    prompt_version: str = "contract_v2"
    temperature: float = 0.0


def source_hash(skill: dict) -> str:
    named = {f: skill.get(f) or "" for f in ("body", "description", "name", "skill_id")}
    return hashlib.sha256(json.dumps(named, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


# ---- reading semantic items -------------------------------------------------------------------------------------------
def _citations(item) -> list[dict]:
    quotes = item.get("evidence_quotes") if isinstance(item, dict) else None
    return [c for c in quotes if isinstance(c, dict)] if isinstance(quotes, list) else []


def _quotes(item) -> list[str]:
    return [c["quote"] for c in _citations(item) if isinstance(c.get("quote"), str)]


def _keys(item) -> set[tuple[str, str]]:
    return {(c["source_field"], " ".join(c["quote"].split()).casefold()) for c in _citations(item) if isinstance(c.get("source_field"), str) and isinstance(c.get("quote"), str) and c["quote"].strip()}


def _statement(item) -> str:
    value = item.get("statement") if isinstance(item, dict) else None
    return value if isinstance(value, str) else ""


def _excludes(skill: dict, item, index: int) -> bool:
    for n, c in enumerate(_citations(item)):
        quote, field = c.get("quote"), c.get("source_field")
        if not isinstance(quote, str) or not quote:
            continue
        if ev.EXPLICIT.search(quote):
            return True
        if field in ev.FIELDS:
            try:
                found = ev.align(skill, field, quote, f"exclusions[{index}].filter[{n}]")
            except ValueError:
                continue
            if ev.EXPLICIT.search(found.quote) or ev.near_exclusion_heading(skill.get(found.field) or "", found.start):
                return True
    return False


def share_out(sizes: dict[str, int]) -> dict[str, int]:
    """How many items each collection keeps of the total: its base share, then one by one in the order of filling up."""
    given = {f: min(n, fixed.CONTRACT_BASE[f]) for f, n in sizes.items()}
    left = fixed.CONTRACT_TOTAL - sum(given.values())
    while left > 0 and (open_ := [f for f in fixed.CONTRACT_FILL if given[f] < sizes[f]]):
        for f in open_[:left]:
            given[f] += 1
        left -= len(open_[:left])
    return given


class _Numbered:
    """Evidence spans, numbered in the order in which they are first cited."""

    def __init__(self, skill: dict):
        self.skill, self.ids, self.rows, self.warnings = skill, {}, [], []

    def convert(self, item, context: str) -> dict:
        if not isinstance(item, dict) or not isinstance(item.get("evidence_quotes"), list) or not item["evidence_quotes"]:
            raise ValueError(f"{context} must be an object with evidence_quotes")
        cited: list[str] = []
        problem = "no valid evidence"
        for n, c in enumerate(item["evidence_quotes"]):
            if not isinstance(c, dict) or c.get("source_field") not in ev.FIELDS or not isinstance(c.get("quote"), str) or not c["quote"]:
                problem = "a citation needs a source_field and a quote"
                continue
            try:
                found = ev.align(self.skill, c["source_field"], c["quote"], context)
            except ValueError as e:
                problem = str(e)
                self.warnings.append(f"dropped_invalid_evidence_quote:{context}[{n}]")
                continue
            self.warnings += found.warnings
            key = (found.field, found.quote)
            if key not in self.ids:
                self.ids[key] = f"ev_{len(self.ids) + 1:04d}"
                self.rows.append({"evidence_id": self.ids[key], "source_field": found.field, "quote": found.quote, "start_char": found.start, "end_char": found.start + len(found.quote)})
            if self.ids[key] not in cited:
                cited.append(self.ids[key])
        if not cited:
            raise ValueError(f"{context} has no valid evidence: {problem}")
        return {k: v for k, v in item.items() if k != "evidence_quotes"} | {"evidence_ids": cited}


def materialize(semantic: dict, skill: dict, how: Extraction = Extraction(), attempts: int = 1) -> dict:
    """The contract of a semantic answer; raises ``ValueError`` where it can't be one."""
    if missing := sorted(set(SEMANTIC) - set(semantic)):
        raise ValueError(f"the answer lacks {missing}")
    if unexpected := sorted(set(semantic) - set(SEMANTIC)):
        raise ValueError(f"the answer has more than was asked for: {unexpected}")
    numbered = _Numbered(skill)
    warn = numbered.warnings
    capability = numbered.convert(semantic["capability"], "capability")
    items: dict[str, list] = {}
    for f in COLLECTIONS:
        if not isinstance(semantic[f], list):
            raise ValueError(f"{f} must be a list")
        items[f] = semantic[f]

    def sift(field: str, why) -> None:
        kept = []
        for i, item in enumerate(items[field]):
            reason = why(i, item)
            if reason:
                warn.append(reason)
            else:
                kept.append(item)
        items[field] = kept

    def trigger(field: str):
        return lambda i, x: f"dropped_trigger_condition:{field}[{i}]" if any(ev.TRIGGER.search(q) for q in _quotes(x)) else f"dropped_nonprecondition:preconditions[{i}]" if field == "preconditions" and any(p.search(_statement(x)) for p in ev.NOT_PRECONDITION) else None

    def repeated(i: int, x):
        same = any(_statement(c) and _statement(x) and ev.same_statement(_statement(x), _statement(c), bool(_keys(x) & _keys(c))) for c in items["constraints"])
        return f"dropped_cross_field_duplicate:quality_criteria[{i}]:constraints" if same else None

    def excluded(i: int, x):
        if ev.CONDITIONAL.search("\n".join([_statement(x), *_quotes(x)])):
            return f"dropped_conditional_exclusion:exclusions[{i}]"
        if _keys(x) & {k for c in items["constraints"] for k in _keys(c)}:
            return f"dropped_cross_field_duplicate:exclusions[{i}]:constraints"
        return None if _excludes(skill, x, i) else f"dropped_implicit_exclusion:exclusions[{i}]"

    sift("inputs", trigger("inputs"))
    sift("preconditions", trigger("preconditions"))
    sift("quality_criteria", repeated)
    sift("exclusions", excluded)
    for f, most in fixed.CONTRACT_LIMITS.items():
        if len(items[f]) > most:
            warn.append(f"field_item_limit_applied:{f}:{len(items[f])}:{most}")
            items[f] = items[f][:most]
    total = sum(map(len, items.values()))
    if total > fixed.CONTRACT_TOTAL:
        given = share_out({f: len(x) for f, x in items.items()})
        items = {f: x[: given[f]] for f, x in items.items()}
        warn.append(f"total_item_limit_applied:{total}:{fixed.CONTRACT_TOTAL}")
    done: dict[str, list] = {}
    for f in COLLECTIONS:
        done[f] = []
        for i, item in enumerate(items[f]):
            try:
                done[f].append(numbered.convert(item, f"{f}[{i}]"))
            except ValueError:
                warn.append(f"dropped_unsupported_item:{f}[{i}]")
    warn += [f"source_{f}_truncated" for f, most in (("description", fixed.DESCRIPTION_CHARS), ("body", fixed.BODY_CHARS)) if len(skill.get(f) or "") > most]
    extraction = {"method": "llm", "provider": how.provider, "model": how.model, "prompt_version": how.prompt_version, "temperature": how.temperature, "status": "validated", "attempts": attempts, "warnings": list(dict.fromkeys(warn))}
    head = {"schema_version": "contract_v2", "skill_id": skill["skill_id"], "source_hash": source_hash(skill), "source_languages": semantic["source_languages"], "canonical_language": semantic["canonical_language"], "capability": capability}
    return head | done | {"evidence": numbered.rows, "extraction": extraction}


# ---- checking ---------------------------------------------------------------------------------------------------------
_LANGUAGE = re.compile(r"(?:und|[a-z]{2,3})(?:-[A-Za-z0-9]{2,8})*")


def problems(contract: dict, skill: dict) -> Iterator[str]:
    """What is wrong with a contract, in the order in which it is looked at."""

    def exact(where: str, value, names) -> Iterator[str]:
        if not isinstance(value, dict):
            yield f"{where} must be an object"
        elif set(value) != set(names):
            yield f"{where} fields differ: {sorted(set(value) ^ set(names))}"

    def filled(where: str, value) -> Iterator[str]:
        if not isinstance(value, str) or not value.strip():
            yield f"{where} must be a non-empty string"

    def texts(where: str, value) -> Iterator[str]:
        if not isinstance(value, list):
            yield f"{where} must be a list"
        else:
            for i, x in enumerate(value):
                yield from filled(f"{where}[{i}]", x)

    yield from exact("contract", contract, TOP)
    if contract.get("schema_version") != "contract_v2":
        yield "schema_version must be contract_v2"
    if contract.get("skill_id") != skill.get("skill_id"):
        yield "skill_id differs from the skill"
    if not isinstance(contract.get("source_hash"), str) or not re.fullmatch(r"[0-9a-f]{64}", contract["source_hash"]):
        yield "source_hash must be 64 lower-case hexadecimal digits"
    elif contract["source_hash"] != source_hash(skill):
        yield "source_hash differs from the skill's content"
    languages = contract.get("source_languages")
    if not isinstance(languages, list) or not languages or len(set(map(str, languages))) != len(languages) or not all(isinstance(x, str) and _LANGUAGE.fullmatch(x) for x in languages):
        yield "source_languages must be distinct language tags"
    if not isinstance(contract.get("canonical_language"), str) or not _LANGUAGE.fullmatch(contract["canonical_language"]):
        yield "canonical_language must be a language tag"
    known: set[str] = set()
    rows = contract.get("evidence")
    if not isinstance(rows, list):
        yield "evidence must be a list"
    for i, e in enumerate(rows if isinstance(rows, list) else []):
        yield from exact(f"evidence[{i}]", e, ("evidence_id", "source_field", "quote", "start_char", "end_char"))
        yield from filled(f"evidence[{i}].evidence_id", e.get("evidence_id"))
        start, end = e.get("start_char"), e.get("end_char")
        if e.get("source_field") not in ev.FIELDS or type(start) is not int or type(end) is not int or not 0 <= start < end or (skill.get(e["source_field"]) or "")[start:end] != e.get("quote"):
            yield f"evidence[{i}] does not quote its source"
        if e.get("evidence_id") in known:
            yield f"evidence[{i}] repeats an id"
        known.add(e.get("evidence_id"))
    used: set[str] = set()

    def references(where: str, item: dict) -> Iterator[str]:
        ids = item.get("evidence_ids")
        if not isinstance(ids, list) or not ids or len(set(ids)) != len(ids) or not set(ids) <= known:
            yield f"{where} must refer to known evidence, each once"
        else:
            used.update(ids)

    capability = contract.get("capability")
    yield from exact("capability", capability, ("summary", "evidence_ids"))
    yield from filled("capability.summary", capability.get("summary"))
    yield from references("capability", capability)
    for f in COLLECTIONS:
        if not isinstance(contract.get(f), list):
            yield f"{f} must be a list"
            continue
        for i, item in enumerate(contract[f]):
            where = f"{f}[{i}]"
            yield from exact(where, item, ITEM[f])
            for name in TEXTS.get(f, ("statement",)):
                yield from filled(f"{where}.{name}", item.get(name))
            for name in OPTIONAL_TEXTS.get(f, ()):
                if item.get(name) is not None:
                    yield from filled(f"{where}.{name}", item[name])
            for name in TEXT_LISTS.get(f, ()):
                yield from texts(f"{where}.{name}", item.get(name))
            if f == "dependencies" and item.get("type") not in fixed.DEPENDENCY_TYPES:
                yield f"{where}.type must be one of {', '.join(fixed.DEPENDENCY_TYPES)}"
            if "required" in ITEM[f] and item.get("required") not in (True, False, None):
                yield f"{where}.required must be true, false or null"
            yield from references(where, item)
    if known - used:
        yield f"evidence is never referred to: {sorted(known - used)}"
    how = contract.get("extraction")
    yield from exact("extraction", how, ("method", "provider", "model", "prompt_version", "temperature", "status", "attempts", "warnings"))
    for name in ("provider", "model", "prompt_version"):
        yield from filled(f"extraction.{name}", how.get(name))
    warmth, tries = how.get("temperature"), how.get("attempts")
    if how.get("method") != "llm" or how.get("status") not in fixed.EXTRACTION_STATUSES:
        yield "extraction.method or extraction.status is not valid"
    if isinstance(warmth, bool) or not isinstance(warmth, (int, float)) or not 0 <= warmth <= 2:
        yield "extraction.temperature must lie in 0..2"
    if type(tries) is not int or tries < 1:
        yield "extraction.attempts must be 1 or more"
    yield from texts("extraction.warnings", how.get("warnings"))


def check(contract: dict, skill: dict) -> str | None:
    """The first problem, or None."""
    return next(problems(contract, skill), None)


# ---- frames -----------------------------------------------------------------------------------------------------------
_ROW = pa.schema([("skill_id", pa.string()), ("contract", pa.string()), ("error", pa.string())])


def materialize_all(rows: DataFrame, how: Extraction = Extraction()) -> DataFrame:
    """(skill_id, contract JSON, error) of rows (skill_id, name, description, body, answer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                try:
                    done = materialize(ev.json_object(r["answer"]), r, how)
                    error = check(done, r)
                    out.append({"skill_id": r["skill_id"], "contract": None if error else json.dumps(done, ensure_ascii=False), "error": error})
                except (ValueError, TypeError, KeyError) as e:
                    out.append({"skill_id": r["skill_id"], "contract": None, "error": str(e)})
            yield pa.RecordBatch.from_pylist(out, schema=_ROW)

    return rows.select("skill_id", "name", "description", "body", "answer").mapInArrow(run, "skill_id string, contract string, error string")


def check_all(rows: DataFrame) -> DataFrame:
    """(skill_id, error) of rows (skill_id, name, description, body, contract JSON); error is null where all is well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                try:
                    out.append({"skill_id": r["skill_id"], "contract": None, "error": check(ev.json_object(r["contract"]), r)})
                except (ValueError, TypeError, AttributeError, KeyError) as e:
                    out.append({"skill_id": r["skill_id"], "contract": None, "error": str(e)})
            yield pa.RecordBatch.from_pylist(out, schema=_ROW)

    return rows.select("skill_id", "name", "description", "body", "contract").mapInArrow(run, "skill_id string, contract string, error string").drop("contract")
