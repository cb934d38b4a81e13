"""A git directory's small files, read on the driver: discovery, configuration, refs, HEAD."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from ..functions.parsing import Malformed, parse_oid

#: Fixed value: how many symbolic refs are followed.
MOST_HOPS = 8


class NotARepository(FileNotFoundError):
    pass


class Unsupported(ValueError):
    """A format that the engine refuses: objects named by another hash than SHA-1."""


def _text(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return None


# ------------------------------------------------------------------ config


def parse_config(text: str) -> dict[str, str]:
    """``section[.sub].key`` to value; sections and keys in lower case; a bare key is "true"."""
    out: dict[str, str] = {}
    section = ""
    for line in text.splitlines():
        # what stands in quotes stays; the first # or ; outside of them begins a comment
        line = re.match(r'(?:"[^"]*"|[^"#;])*(?:"[^"]*$)?', line)[0].strip()
        if m := re.fullmatch(r"\[(.*)\]", line):
            name, _, sub = (lambda s: re.match(r"(\S*)(\s?)(.*)", s, re.S).groups())(m[1].strip())
            section = f"{name.lower()}.{sub.strip().strip(chr(34))}" if _ else name.lower()
        elif line and section:
            key, equals, value = line.partition("=")
            value = value.strip()
            if len(value) >= 2 and value[0] == value[-1] == '"':
                value = value[1:-1].replace('\\"', '"')
            out[f"{section}.{key.strip().lower()}"] = value if equals else "true"
    return out


def config_bool(config: dict[str, str], key: str) -> bool:
    return config.get(key, "").lower() in ("true", "yes", "on", "1")


# -------------------------------------------------------------------- refs


@dataclass(frozen=True)
class Head:
    """ref and oid: on a branch; oid alone: detached; ref alone: a branch without commits."""

    ref: str | None
    oid: str | None

    def describe(self) -> str:
        if self.ref is None:
            return f"detached at {self.oid[:7]}"
        name = self.ref.removeprefix("refs/heads/")
        return name if self.oid else f"{name} (no commits yet)"


def packed_refs(git_dir: str) -> dict[str, str]:
    out = {}
    for line in (_text(os.path.join(git_dir, "packed-refs")) or "").splitlines():
        if line and line[0] not in "#^":
            oid, _, name = line.strip().partition(" ")
            if name and parse_oid(oid):
                out[name.strip()] = parse_oid(oid)
    return out


def loose_refs(git_dir: str) -> dict[str, str]:
    out = {}
    for folder, _, names in os.walk(os.path.join(git_dir, "refs")):
        for name in names:
            path = os.path.join(folder, name)
            if oid := parse_oid((_text(path) or "").strip()):
                out[os.path.relpath(path, git_dir).replace(os.sep, "/")] = oid
    return out


def all_refs(git_dir: str) -> list[tuple[str, str]]:
    """(name, oid) by name; a loose ref overrides the packed one."""
    return sorted((packed_refs(git_dir) | loose_refs(git_dir)).items())


def head(git_dir: str) -> Head:
    target, ref = (_text(os.path.join(git_dir, "HEAD")) or "").strip(), None
    for _ in range(MOST_HOPS + 1):
        if oid := parse_oid(target):
            return Head(ref, oid)
        if not target.startswith("ref:"):
            break
        ref = target[4:].strip()
        if not ref or ref.startswith("/") or ".." in ref.split("/"):
            raise Malformed(f"ref name {ref!r}")
        loose = _text(os.path.join(git_dir, ref))
        target = loose.strip() if loose is not None else packed_refs(git_dir).get(ref, "")
    return Head(ref or "HEAD", None)


# -------------------------------------------------------------- repository


@dataclass(frozen=True)
class Repository:
    git_dir: str
    work_tree: str | None
    shallow: bool

    @staticmethod
    def open(git_dir: str, work_tree: str | None = None) -> Repository:
        config = parse_config(_text(os.path.join(git_dir, "config")) or "")
        if (kind := config.get("extensions.objectformat", "sha1")).lower() != "sha1":
            raise Unsupported(f"objects named by {kind}")
        return Repository(git_dir, work_tree, os.path.isfile(os.path.join(git_dir, "shallow")))

    @staticmethod
    def discover(start: str) -> Repository:
        """The repository that start is in: a .git folder, a .git file that points to one, or a bare one."""
        at = os.path.realpath(start)
        if not os.path.exists(at):
            raise NotARepository(start)
        while True:
            dot = os.path.join(at, ".git")
            if os.path.isdir(dot):
                return Repository.open(dot, at)
            if os.path.isfile(dot) and (m := re.match(r"gitdir:\s*(.*\S)", _text(dot) or "")):
                return Repository.open(os.path.normpath(os.path.join(at, m[1])), at)
            if os.path.isfile(os.path.join(at, "HEAD")) and os.path.isdir(os.path.join(at, "objects")):
                return Repository.open(at)
            if (up := os.path.dirname(at)) == at:
                raise NotARepository(start)
            at = up

    @property
    def name(self) -> str:
        return os.path.basename(self.work_tree or "") or "repository"

    @property
    def head(self) -> Head:
        return head(self.git_dir)

    @property
    def refs(self) -> list[tuple[str, str]]:
        return all_refs(self.git_dir)
