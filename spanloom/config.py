"""Properties files: settings by name, families of settings by prefix, paths below a data folder (SRC33)."""

from __future__ import annotations

import re


class Settings(dict):
    """Settings of a properties text (``key = value``, ``key: value`` or ``key value``; ``#`` and ``!`` begin comments; a backslash continues a line)."""

    @classmethod
    def parse(cls, text: str) -> Settings:
        out, held = cls(), ""
        for line in text.splitlines():
            line = held + line.lstrip()
            held = ""
            if not line or (line[0] in "#!"):
                continue
            if (len(line) - len(line.rstrip("\\"))) % 2:
                held = line[:-1]
                continue
            out._put(line)
        if held:
            out._put(held)
        return out

    def _put(self, line: str) -> None:
        key, value = re.match(r"((?:\\.|[^\s=:\\])*)\s*[=:]?\s*(.*)", line, re.S).groups()
        self[_plain(key)] = _plain(value)

    def family(self, prefix: str) -> dict[str, str]:
        """All settings whose name begins with ``prefix``, in order of their names."""
        return {k: self[k] for k in sorted(self) if k.startswith(prefix)}

    def path(self, key: str, home: str = ".", under: str | None = None) -> str | None:
        """A file setting below the data folder: ``under`` names its setting, relative to ``home``; null without the setting."""
        if key not in self:
            return None
        data = self.get(under, ".") if under else "."
        top = data if _absolute(data) else f"{home}/{data}"
        return self[key] if _absolute(self[key]) else f"{top}/{self[key]}"


def _absolute(path: str) -> bool:
    return path.startswith("/") or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) is not None


def _plain(x: str) -> str:
    x = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), x)
    return re.sub(r"\\(.)", lambda m: {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}.get(m[1], m[1]), x)
