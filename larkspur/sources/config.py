"""Settings in key=value files."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Config:
    """Named string settings with typed reading. Lines that begin with ``#`` or ``!`` are comments; ``=`` or ``:`` parts name and value."""

    values: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Config:
        found = {}
        with open(path, encoding="utf-8") as f:
            for line in f:
                line = line.strip()
                if not line or line[0] in "#!":
                    continue
                at = min((i for i in (line.find("="), line.find(":")) if i >= 0), default=len(line))
                found[line[:at].strip()] = line[at + 1 :].strip()
        return cls(found)

    def store(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(f"{k}={v}\n" for k, v in sorted(self.values.items()))

    def copy(self) -> Config:
        return Config(dict(self.values))

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.values.get(name, default)

    def set(self, name: str, value: object) -> None:
        self.values[name] = ("true" if value else "false") if isinstance(value, bool) else str(value)

    def get_int(self, name: str, default: int | None = None) -> int | None:
        return int(self.values[name]) if name in self.values else default

    def get_float(self, name: str, default: float | None = None) -> float | None:
        return float(self.values[name]) if name in self.values else default

    def get_bool(self, name: str, default: bool | None = None) -> bool | None:
        return self.values[name].lower() in ("true", "yes", "1", "on") if name in self.values else default

    def get_list(self, name: str, separator: str = ",") -> list[str]:
        return [x.strip() for x in self.values.get(name, "").split(separator) if x.strip()]
