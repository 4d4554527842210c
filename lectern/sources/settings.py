"""Settings from TOML: for formatting, for finding files and for the linter."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from typing import Any

from lectern.plans.formatter import PASSES, SPACINGS, Options
from lectern.sources.documents import Discovery

FILES = (".lectern.toml", "lectern.toml", "pyproject.toml")
KINDS: dict[str, type] = {
    "wrap": str, "width": int, "semantic": bool, "plain": bool, "cleanups": bool, "smartquotes": bool, "ellipses": bool, "list-spacing": str,
    "include": list, "exclude": list, "extend-include": list, "extend-exclude": list, "force-exclude": bool, "respect-gitignore": bool, "files-max-size": int,
}
LINT_KINDS: dict[str, type] = {"rules": dict, "plugins": list, "context": str, "max-line-length": int, "discover-plugins": bool, "style": list}


@dataclass(frozen=True)
class Settings:
    formatting: dict[str, Any] = field(default_factory=dict)
    lint: dict[str, Any] = field(default_factory=dict)

    def options(self, **flags: Any) -> Options:
        """Flags win over settings, settings over defaults."""
        v = {**self.formatting, **{k.replace("_", "-"): x for k, x in flags.items() if x is not None}}
        wrap = v.get("wrap") or ("plain" if v.get("plain") else "semantic" if v.get("semantic") else "width")
        width = v.get("width", 0 if wrap == "semantic" else 88)
        return Options(wrap, width, frozenset(p for p in PASSES if v.get(p)), v.get("list-spacing", "loose"))

    def discovery(self) -> Discovery:
        v, d = self.formatting, Discovery()
        return Discovery(
            tuple(v.get("include", d.include)) + tuple(v.get("extend-include", ())),
            tuple(v.get("exclude", d.exclude)),
            tuple(v.get("extend-exclude", ())),
            v.get("force-exclude", False),
            v.get("files-max-size", d.max_size),
        )


def checked(values: dict[str, Any], kinds: dict[str, type], where: str) -> dict[str, Any]:
    for key, value in values.items():
        if key not in kinds:
            raise ValueError(f"{where}: no such setting: {key}")
        kind = kinds[key]
        if not isinstance(value, kind) or kind is int and isinstance(value, bool):
            raise ValueError(f"{where}: {key} is to be {kind.__name__}")
        if kind is list and not all(isinstance(x, str) for x in value):
            raise ValueError(f"{where}: {key} is to be a list of strings")
    if values.get("list-spacing", "loose") not in SPACINGS:
        raise ValueError(f"{where}: list-spacing is to be one of {', '.join(SPACINGS)}")
    return values


def parse(text: str, where: str = "settings", tool: bool = False) -> Settings:
    """Settings of a TOML text; ``tool``: those of its table tool.lectern. Unknown keys and wrong kinds are errors."""
    data = tomllib.loads(text)
    if tool:
        data = data.get("tool", {}).get("lectern", {})
    lint = checked(data.pop("lint", {}), LINT_KINDS, where)
    flat = {}
    for key in [*data]:
        if key in ("formatting", "file-discovery"):
            flat.update(data.pop(key))
    return Settings(checked({**data, **flat}, KINDS, where), lint)


def find(start: str) -> tuple[str, Settings] | None:
    """The nearest settings file, from a folder upwards; a project file counts if it has the tool's table."""
    folder = os.path.abspath(start)
    while True:
        for name in FILES:
            path = os.path.join(folder, name)
            if os.path.isfile(path):
                with open(path, encoding="utf-8") as f:
                    text = f.read()
                tool = name == "pyproject.toml"
                if not tool or "lectern" in tomllib.loads(text).get("tool", {}):
                    return path, parse(text, path, tool)
        parent = os.path.dirname(folder)
        if parent == folder:
            return None
        folder = parent
