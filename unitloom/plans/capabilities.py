"""What a file may do when something interprets it, and whether a policy allows that. Driver logic over declarations."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import PurePosixPath


class CapabilityError(ValueError):
    """A grant that cannot be read."""


@dataclass(frozen=True)
class Grant:
    access: str  # read or write
    prefix: str

    @staticmethod
    def parse(text: str) -> Grant:
        access, colon, path = text.partition(":")
        if not colon or access not in ("read", "write"):
            raise CapabilityError(f"'{text}' is not a grant such as read:/path or write:/path")
        return Grant(access, normalised(path))

    def covers(self, access: str, path: str) -> bool:
        """A write grant covers reads; a prefix covers whole path parts."""
        fits = access == self.access or (self.access == "write" and access == "read")
        own, asked = PurePosixPath(self.prefix), PurePosixPath(normalised(path))
        return fits and (own == asked or own in asked.parents)


def normalised(path: str) -> str:
    """Without dots and with parents resolved as far as the text alone allows."""
    out: list[str] = []
    absolute = path.startswith("/")
    for part in path.split("/"):
        if part in ("", "."):
            continue
        if part == ".." and out and out[-1] != "..":
            out.pop()
        elif part != ".." or not absolute:
            out.append(part)
    return ("/" if absolute else "") + "/".join(out)


@dataclass(frozen=True)
class Capabilities:
    network: bool = False
    filesystem: tuple[str, ...] = ()
    env_read: tuple[str, ...] = ()
    max_memory_mb: int | None = None
    extra: dict = field(default_factory=dict, compare=False)

    @staticmethod
    def from_json(text: str) -> Capabilities:
        raw = json.loads(text)
        known = {"network", "filesystem", "env_read", "max_memory_mb"}
        return Capabilities(raw.get("network", False), tuple(raw.get("filesystem", ())), tuple(raw.get("env_read", ())), raw.get("max_memory_mb"), {k: v for k, v in raw.items() if k not in known})

    def grants(self) -> list[Grant]:
        return [Grant.parse(g) for g in self.filesystem]

    def allows(self, access: str, path: str) -> bool:
        return any(g.covers(access, path) for g in self.grants())

    def allows_env(self, name: str) -> bool:
        return "*" in self.env_read or name in self.env_read

    def allows_memory(self, mb: int) -> bool:
        return self.max_memory_mb is None or mb <= self.max_memory_mb

    def lint(self) -> list[tuple[str, str, str]]:
        """``(severity, field, message)`` of what is malformed or suspiciously broad."""
        found = []
        for text in self.filesystem:
            try:
                grant = Grant.parse(text)
            except CapabilityError as e:
                found.append(("error", "filesystem", str(e)))
                continue
            if grant.prefix in ("", "/"):
                found.append(("warning", "filesystem", f"'{text}' grants {grant.access} access to every path"))
            elif grant.prefix.split("/")[0] == "..":
                found.append(("warning", "filesystem", f"'{text}' leads out of the working directory"))
        if "*" in self.env_read:
            found.append(("warning", "env_read", "'*' hands out the whole environment"))
        if self.network and any(t.startswith("read:") for t in self.filesystem):
            found.append(("note", "network", "network and file reading together could carry data out"))
        return found

    def exceeds(self, policy: Capabilities) -> list[tuple[str, str, str]]:
        """Everything declared here that ``policy`` does not permit."""
        found = []
        if self.network and not policy.network:
            found.append(("error", "network", "the file wants network, the policy forbids it"))
        found += [("error", "filesystem", f"the policy does not permit {g.access}:{g.prefix}") for g in self.grants() if not policy.allows(g.access, g.prefix)]
        found += [("error", "env_read", f"the policy does not permit reading ${name}") for name in self.env_read if not policy.allows_env(name)]
        if self.max_memory_mb is not None and not policy.allows_memory(self.max_memory_mb):
            found.append(("error", "max_memory_mb", f"the file wants {self.max_memory_mb} MB, the policy caps it at {policy.max_memory_mb} MB"))
        return found
