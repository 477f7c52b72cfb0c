"""Single files of this machine: guarded reads and where profiles keep them."""

from __future__ import annotations

import os
import re
import stat
from dataclasses import dataclass
from pathlib import Path

from loamstack.functions import constants as K


class Refused(ValueError):
    """A file is not what may be read or written, is too large, or is not what it was."""


@dataclass(frozen=True)
class Identity:
    """What tells whether a file is still the one that was read; missing files have none."""

    device: int
    inode: int
    size: int
    modified: int

    @classmethod
    def of(cls, s: os.stat_result) -> Identity:
        return cls(s.st_dev, s.st_ino, s.st_size, s.st_mtime_ns)


def check_path(path: Path) -> Path:
    """The absolute path, refused if one of its parents is a symbolic link that can be swapped."""
    path = Path(os.path.abspath(path))
    for parent in path.parents:
        if parent.is_symlink():
            raise Refused(f"{parent} is a symbolic link")
    return path


def identity(path: Path) -> Identity | None:
    """The identity of a regular file with one name; None if there is nothing."""
    try:
        s = os.lstat(path)
    except FileNotFoundError:
        return None
    if not stat.S_ISREG(s.st_mode):
        raise Refused(f"{path} is not a regular file")
    if s.st_nlink != 1:
        raise Refused(f"{path} has more than one name")
    return Identity.of(s)


def read_text(path: Path, max_bytes: int = K.MAX_FILE_BYTES, attempts: int = 200) -> tuple[str, Identity | None]:
    """(text, identity) of a whole file in strict UTF-8; ("", None) if it is missing.

    A file that changes while it is read is read again.
    """
    path = check_path(path)
    for _ in range(attempts):
        before = identity(path)
        if before is None:
            return "", None
        if before.size > max_bytes:
            raise Refused(f"{path} has more than {max_bytes} bytes")
        fd = os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0) | getattr(os, "O_NONBLOCK", 0))
        with os.fdopen(fd, "rb") as f:
            data = f.read(max_bytes + 1)
            after = Identity.of(os.fstat(f.fileno()))
        if before == after == identity(path) and len(data) == after.size:
            try:
                return data.decode("utf-8"), after
            except UnicodeDecodeError as e:
                raise Refused(f"{path} is not UTF-8") from e
    raise Refused(f"{path} does not stop changing")


# Files of a profile and their default budgets.
PROFILE_FILES = (("MEMORY.md", "memory_char_limit", 2200), ("USER.md", "user_char_limit", 1375))


def profile_budgets(config: str) -> dict[str, int]:
    """Budget of each profile file, from the text of its configuration or the default."""
    found = {name: re.search(rf"{key}:\s*(\d+)", config) for name, key, _ in PROFILE_FILES}
    return {name: int(m[1]) if (m := found[name]) else default for name, _, default in PROFILE_FILES}


def profile_targets(home: Path) -> list[tuple[Path, int]]:
    """(path, budget) of the files a profile folder has."""
    try:
        config, _ = read_text(home / "config.yaml", K.MAX_SIDE_BYTES)
    except (OSError, Refused):
        config = ""
    budgets = profile_budgets(config)
    return [(p, budgets[name]) for name, _, _ in PROFILE_FILES if (p := home / "memories" / name).exists()]
