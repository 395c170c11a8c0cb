"""Input files: newest matches, snapshot ids in names."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from pathlib import Path

# Names of the exports' files.
PATTERNS = {
    "members": ("twitter-ListMembers-*.csv", "twitter-ListMembers-*.json"),
    "exporter": ("twitter-web-exporter-*.json",),
    "extra_members": ("manual_member_handles_*.txt", "manual_member_handles_*.json", "manual_member_handles_*.csv"),
}
_SNAPSHOT = re.compile(r"(\d{3,})$")


@dataclass(frozen=True)
class Source:
    kind: str
    path: Path
    snapshot_id: int | None
    order_key: int

    @staticmethod
    def of(kind: str, path: Path) -> Source:
        found = _SNAPSHOT.search(path.stem)
        number = int(found[1]) if found else None
        return Source(kind, path, number, number if number is not None else path.stat().st_mtime_ns)

    def fingerprint(self) -> dict:
        digest = hashlib.sha256()
        with self.path.open("rb") as f:
            for part in iter(lambda: f.read(1 << 20), b""):
                digest.update(part)
        state = self.path.stat()
        return {"path": str(self.path.resolve()), "snapshot_id": self.snapshot_id, "size_bytes": state.st_size, "mtime_ns": state.st_mtime_ns, "sha256": digest.hexdigest()}


def sources(folder: Path, kind: str) -> list[Source]:
    """Files of a kind by their order key (the snapshot id in the name, else the time of change)."""
    found = [Source.of(kind, p) for pattern in PATTERNS[kind] for p in folder.glob(pattern) if p.is_file()]
    return sorted(found, key=lambda s: (s.order_key, s.path.name))


def dataset(folder: Path, members: Path | None = None, exporter: Path | None = None, extra: Path | None = None) -> dict[str, Path | None]:
    """The files to analyse: the ones named, else the newest by time of change; a handle list
    only if it is named."""

    def newest(kind: str) -> Path | None:
        return max((p for pattern in PATTERNS[kind] for p in folder.glob(pattern)), key=lambda p: (p.stat().st_mtime_ns, p.name), default=None)

    out = {"members": members or newest("members"), "exporter": exporter or newest("exporter"), "extra_members": extra}
    for kind in ("members", "exporter"):
        if out[kind] is None or not Path(out[kind]).exists():
            raise FileNotFoundError(f"no {kind} file in {folder}")
    if extra is not None and not extra.exists():
        raise FileNotFoundError(str(extra))
    return out
