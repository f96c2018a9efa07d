"""Archives: monthly files of two kinds in two folders, listed and pruned on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from talkmill.functions import months

PREFIX = {"comment": "RC", "submission": "RS"}
_NAME = re.compile(r"(RC|RS)_(\d{4}-\d{2})\.zst", re.ASCII)


@dataclass(frozen=True)
class FileJob:
    kind: str
    month: str
    path: str

    @property
    def size(self) -> int:
        return Path(self.path).stat().st_size


@dataclass(frozen=True)
class Archive:
    """comments/RC_YYYY-MM.zst and submissions/RS_YYYY-MM.zst under root, or folders given by kind."""

    comments: str
    submissions: str

    @staticmethod
    def at(root: str) -> Archive:
        return Archive(f"{root}/comments", f"{root}/submissions")

    def discover(self, kinds: tuple[str, ...] = ("comment", "submission")) -> list[FileJob]:
        """All files of the kinds, comments first, chronological. A folder that doesn't exist is empty; other names are passed over."""
        out = []
        for kind, folder in (("comment", self.comments), ("submission", self.submissions)):
            p = Path(folder)
            if kind not in kinds or not p.exists():
                continue
            if not p.is_dir():
                raise NotADirectoryError(folder)
            for f in sorted(p.iterdir()):
                m = _NAME.fullmatch(f.name)
                if m and m[1] == PREFIX[kind] and 1 <= int(m[2][5:]) <= 12 and f.is_file():
                    out.append(FileJob(kind, m[2], str(f)))
        return out

    def plan(self, kinds: tuple[str, ...] = ("comment", "submission"), start: str | None = None, end: str | None = None) -> list[FileJob]:
        """The files within the months; holes are passed over."""
        found = self.discover(kinds)
        if not found:
            raise FileNotFoundError(f"no source files in {self.comments} and {self.submissions}")
        out = [j for j in found if (start or "") <= j.month <= (end or "9999-99")]
        if not out:
            have = months.as_ranges([j.month for j in found])
            raise FileNotFoundError(f"no files from {start or 'the first month'} to {end or 'the last'}; there are {have}")
        return out

    def missing(self, kinds: tuple[str, ...] = ("comment", "submission"), start: str | None = None, end: str | None = None) -> dict[str, list[str]]:
        """Holes in each kind's months within the range."""
        found = self.discover(kinds)
        return {k: months.holes([j.month for j in found if j.kind == k], start, end) for k in kinds}

    def describe(self) -> list[dict]:
        """A row per kind and a total: files, bytes, first and last month, missing months."""
        found, out = self.discover(), []
        for k in ("comment", "submission", "total"):
            js = [j for j in found if k in (j.kind, "total")]
            ms = [j.month for j in js]
            lacks = sum(len(months.holes([j.month for j in found if j.kind == x])) for x in ("comment", "submission") if k in (x, "total"))
            out.append({"source": k, "files": len(js), "bytes": sum(j.size for j in js), "first_month": min(ms, default=None), "last_month": max(ms, default=None), "missing_months": lacks})
        return out
