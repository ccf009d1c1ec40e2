"""Reproducibility record: the request, the root and the content-addressed specification beside it."""

from __future__ import annotations

import hashlib
import json
import os

VERSION = 1


def write_manifest(folder: str, request: dict, root: bytes, spec_text: str | None) -> str:
    """Writes manifest.json and spec-<sha256>.yaml in ``folder`` on the driver; returns the manifest's path."""
    record = {"schema_version": VERSION, "request": request, "state_root": "0x" + root.hex()}
    if spec_text is not None:
        digest = hashlib.sha256(spec_text.encode()).hexdigest()
        record["spec"] = {"file": f"spec-{digest}.yaml", "sha256": digest}
        with open(os.path.join(folder, record["spec"]["file"]), "w", encoding="utf-8") as f:
            f.write(spec_text)
    path = os.path.join(folder, "manifest.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(record, f, indent=2, sort_keys=True)
    return path


def read_manifest(path: str) -> tuple[dict, str | None]:
    """The record and the verified specification; a missing or changed sidecar is an error."""
    with open(path, encoding="utf-8") as f:
        record = json.load(f)
    if record.get("schema_version", 0) > VERSION:
        raise ValueError("manifest of a later version")
    if "spec" not in record:
        return record, None
    with open(os.path.join(os.path.dirname(path), record["spec"]["file"]), encoding="utf-8") as f:
        text = f.read()
    if hashlib.sha256(text.encode()).hexdigest() != record["spec"]["sha256"]:
        raise ValueError("specification differs from its recorded hash")
    return record, text
