"""Template files: one JSON object a file, or a list of them under ``templates``."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path

log = logging.getLogger(__name__)

#: Templates for the sample pages of ``sources.ledger``.
SAMPLES: list[dict] = [
    {
        "id": "default",
        "name": "Any statement",
        "document_type": "bank_statement",
        "detection": {"column_headers": ["date", "details", "debit", "credit", "balance"]},
    },
    {
        "id": "bank_a",
        "name": "Bank A",
        "document_type": "bank_statement",
        "detection": {
            "iban_patterns": ["IE[0-9]{2}AIBK.*"],
            "filename_patterns": ["*_aib.pdf"],
            "header_keywords": ["statement of account"],
            "exclude_keywords": ["draft only"],
        },
    },
    {"id": "bank_b", "name": "Bank B", "document_type": "bank_statement", "detection": {"iban_patterns": ["IE.*"], "exclude_keywords": ["draft only"]}},
    {
        "id": "card_a",
        "name": "Card A",
        "document_type": "credit_card_statement",
        "detection": {
            "document_identifiers": {"card_number_patterns": ["[*]{4} [*]{4} [*]{4} [0-9]{4}"]},
            "header_keywords": ["credit limit", "card statement"],
        },
    },
    {
        "id": "loan_default",
        "name": "Loans",
        "document_type": "loan_statement",
        "detection": {"document_identifiers": {"loan_reference_patterns": ["LN-[0-9]+"]}, "header_keywords": ["mortgage"]},
    },
]


def parse_template(raw: Mapping) -> dict:
    """A checked template; account patterns may stand in detection or, as before, under document_identifiers."""
    if not raw.get("id"):
        raise ValueError("a template needs an id")
    t = json.loads(json.dumps(raw))
    t.setdefault("name", t["id"])
    t.setdefault("enabled", True)
    t.setdefault("document_type", "bank_statement")
    d = t.setdefault("detection", {})
    d.setdefault("iban_patterns", d.get("document_identifiers", {}).get("iban_patterns", []))
    for name, pair in t.get("extraction", {}).get("columns", {}).items():
        if not (isinstance(pair, Sequence) and len(pair) == 2):
            raise ValueError(f"column {name} of {t['id']} needs two edges")
    overrides = t.get("extraction", {}).get("per_page_overrides", {})
    if overrides:
        t["extraction"]["per_page_overrides"] = {int(k): v for k, v in overrides.items()}
    return t


def load_file(path: str | Path) -> list[dict]:
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    if "id" in raw:
        return [parse_template(raw)]
    listed = raw.get("templates", [])
    return [parse_template({"id": k} | v) for k, v in listed.items()] if isinstance(listed, Mapping) else [parse_template(t) for t in listed]


def load_folder(folder: str | Path) -> list[dict]:
    """All valid templates of a folder; files that are not are logged and skipped."""
    found: list[dict] = []
    for path in sorted(Path(folder).glob("*.json")):
        try:
            found += load_file(path)
        except (ValueError, KeyError, AttributeError) as e:
            log.warning("template %s is skipped: %s", path, e)
    if not found:
        raise ValueError(f"no valid template in {folder}")
    return found


def load_folders(folders: Iterable[str | Path]) -> list[dict]:
    """Union by id over folders in order of priority: the first one wins."""
    chosen: dict[str, dict] = {}
    for folder in folders:
        if Path(folder).is_dir():
            for t in load_folder(folder):
                chosen.setdefault(t["id"], t)
    if not chosen:
        raise ValueError("no valid template")
    return list(chosen.values())


def usable(templates: Sequence[Mapping], require_iban: bool = False, kind: str | None = None, ids: Sequence[str] | None = None, force: str | None = None) -> list[dict]:
    """Enabled templates by type, id, entitlement or force; none is an error."""
    force = force or os.environ.get("FORCE_TEMPLATE")
    out = [
        dict(t)
        for t in templates
        if t.get("enabled", True)
        and (kind is None or t.get("document_type") == kind)
        and (ids is None or t["id"] in ids)
        and (not require_iban or t.get("detection", {}).get("iban_patterns"))
        and (not force or t["id"] == force)
    ]
    if not out:
        raise ValueError("no template is left")
    return out
