"""Evidence register on the driver: intake with digest, duplicate check, manifest, custody, verification.

Files are copied and hashed in one pass; records of what happened are JSON lines that
are only ever appended.
"""

from __future__ import annotations

import hashlib
import json
import os
from datetime import UTC, datetime
from pathlib import Path

from auditlake.operators.integrity import evidence_id, large_file_digest, safe_name, within


def copy_and_hash(source: str, to: str) -> str:
    """Copy without overwriting; returns the digest of what was written."""
    h = hashlib.sha256()
    with open(source, "rb") as a, open(to, "xb") as b:
        while part := a.read(1 << 20):
            h.update(part)
            b.write(part)
    return h.hexdigest()


class Register:
    """A folder with originals (read-only), working copies and a manifest."""

    def __init__(self, root: str) -> None:
        self.root = Path(root)
        for d in ("original", "working"):
            (self.root / d).mkdir(parents=True, exist_ok=True)
        self.log = self.root / "manifest.jsonl"

    def entries(self) -> list[dict]:
        """Latest state of every item, in order of intake."""
        out: dict[str, dict] = {}
        if self.log.exists():
            for line in self.log.read_text().splitlines():
                e = json.loads(line)
                out.setdefault(e["evidence_id"], {"custody": []}).update({k: v for k, v in e.items() if k != "event"})
                out[e["evidence_id"]]["custody"].append({"event": e["event"], "at": e["at"]})
        return list(out.values())

    def _append(self, **e) -> None:
        with open(self.log, "a") as f:
            f.write(json.dumps(e | {"at": datetime.now(UTC).isoformat()}, sort_keys=True) + "\n")

    def find(self, sha256: str) -> dict | None:
        return next((e for e in self.entries() if e["sha256"] == sha256), None)

    def get(self, item: str) -> dict:
        if e := next((e for e in self.entries() if e["evidence_id"] == item), None):
            return e
        raise KeyError(item)

    def intake(self, source: str, prefix: str = "EV") -> dict:
        """Register a file; the same content again gives the first entry back. A failure leaves nothing behind."""
        digest = large_file_digest(source)
        if known := self.find(digest):
            self._append(evidence_id=known["evidence_id"], event="offered again")
            return known
        item = evidence_id(prefix, digest)
        name = safe_name(os.path.basename(source))
        made: list[Path] = []
        try:
            for d in ("original", "working"):
                p = within(str(self.root / d), f"{item}-{name}")
                made.append(p)
                if copy_and_hash(source, str(p)) != digest:
                    raise OSError("the file changed while it was copied")
            made[0].chmod(0o444)
        except Exception:
            for p in made:
                p.unlink(missing_ok=True)
            raise
        self._append(evidence_id=item, event="intake", name=name, sha256=digest, original=str(made[0]), working=str(made[1]))
        return self.get(item)

    def status(self, item: str) -> dict[str, str]:
        e = self.get(item)
        check = lambda p: "MISSING" if not os.path.exists(p) else "VERIFIED" if large_file_digest(p) == e["sha256"] else "INTEGRITY_FAILED"
        return {k: check(e[k]) for k in ("original", "working")}

    def open_for_analysis(self, item: str) -> str:
        """Path of the working copy, only if both copies are unchanged."""
        s = self.status(item)
        if set(s.values()) != {"VERIFIED"}:
            self._append(evidence_id=item, event="refused")
            raise ValueError(f"{item}: {s}")
        self._append(evidence_id=item, event="opened")
        return self.get(item)["working"]
