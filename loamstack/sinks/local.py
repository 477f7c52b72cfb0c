"""Durable writes of single files of this machine: replace, lock, append once, commit, recover."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import re
import tempfile
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

from loamstack.functions import constants as K
from loamstack.sources.local import Identity, Refused, check_path, identity, read_text

#: Stands for "whatever is there" in replace().
ANY = object()

SIDE_LIMITS = {"archive": K.MAX_SIDE_BYTES, "journal": K.MAX_JOURNAL_BYTES, "state": K.MAX_SIDE_BYTES, "pending": K.MAX_PENDING_BYTES}


def side_files(target: Path) -> dict[str, Path]:
    """The files beside a target; journal and lock are shared by its folder."""
    d, n = target.parent, target.name
    return {"state": d / f".{n}.loam-state.json", "archive": d / f"{n}.loam-archive.md", "journal": d / "LOAM-JOURNAL.md",
            "pending": d / f".{n}.loam-pending.json", "lock": d / ".loam.lock"}


def replace(path: Path, text: str, expected: Identity | None | object = ANY) -> None:
    """Writes a whole file so that a reader sees the old or the new one, and a crash loses neither.

    ``expected`` is the identity the file must still have, None for a file
    that must not be there.  An existing file keeps its permissions.
    """
    path = check_path(path)
    before = identity(path)
    fd, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(text.encode("utf-8"))
            if before is not None:
                os.fchmod(f.fileno(), os.stat(path).st_mode & 0o7777)
            f.flush()
            os.fsync(f.fileno())
        if expected is not ANY and identity(path) != expected:
            raise Refused(f"{path} has changed since it was read")
        os.replace(name, path)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(name)
        raise
    folder = os.open(path.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


def remove(path: Path, expected: Identity) -> None:
    """Removes the very file that was read."""
    if identity(path) != expected:
        raise Refused(f"{path} has changed since it was read")
    os.unlink(path)


@contextlib.contextmanager
def folder_lock(path: Path, seconds: float = K.LOCK_SECONDS) -> Iterator[None]:
    """An advisory lock that processes working in one folder share."""
    import fcntl

    path = check_path(path)
    identity(path)
    fd = os.open(path, os.O_RDWR | os.O_CREAT | os.O_NOFOLLOW, 0o600)
    try:
        end = time.monotonic() + seconds
        while True:
            try:
                fcntl.flock(fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() >= end:
                    raise Refused(f"{path} is held by another process") from None
                time.sleep(0.05)
        yield
    finally:
        os.close(fd)


def append_once(path: Path, heading: str, tx: str, block: str, max_bytes: int, rotate: bool = False) -> None:
    """Appends a block under the mark of its transaction, unless the mark is there.

    Beyond ``max_bytes`` the file starts anew where it may rotate, and the
    block is refused where it may not.
    """
    mark = f"<!-- loam-tx:{tx} -->"
    old, was = read_text(path, max_bytes)
    if mark in old:
        return
    record = f"{mark}\n{block.rstrip()}\n"
    start = old or f"# {heading}\n\n"
    text = start + ("" if start.endswith("\n") else "\n") + record
    if len(text.encode()) > max_bytes and rotate:
        text = f"# {heading} (rotated)\n\n{record}"
    if len(text.encode()) > max_bytes:
        raise Refused(f"{path} would have more than {max_bytes} bytes")
    replace(path, text, was)


@dataclass(frozen=True)
class Transaction:
    """All that a run writes for one file, named by its content."""

    target: str
    stamp: str
    original: str
    new_text: str
    archive: str
    report: str
    state_before: str
    state_after: str
    version: int = 1

    @property
    def tx(self) -> str:
        parts = (self.original, self.new_text, self.archive, self.report, self.state_before, self.state_after)
        return hashlib.sha256("\0".join(parts).encode("utf-8")).hexdigest()[:24]

    @property
    def backup(self) -> str:
        return f"{self.target}.bak-{re.sub('[-: ]', '', self.stamp)}-{self.tx[:8]}"

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"tx": self.tx}, ensure_ascii=False, sort_keys=True)

    @classmethod
    def from_json(cls, text: str, target: str) -> Transaction:
        """A stored transaction; refused unless it is complete, of this target and unchanged."""
        try:
            raw = json.loads(text)
            claimed = raw.pop("tx")
            t = cls(**raw)
            sound = all(isinstance(v, str) for k, v in raw.items() if k != "version") and raw.get("version") == 1 and type(raw["version"]) is int
        except (ValueError, TypeError, KeyError, AttributeError, RecursionError) as e:
            raise Refused("the pending transaction cannot be read") from e
        if not sound or t.target != target or t.tx != claimed:
            raise Refused("the pending transaction does not belong to this file or was changed")
        if "/" in t.backup or max(map(len, (t.original, t.new_text))) > K.MAX_FILE_BYTES:
            raise Refused("the pending transaction is out of bounds")
        return t


def _commit(path: Path, old: str, new: str, max_bytes: int) -> None:
    """Compare and set: nothing if the new text is there, refused if neither is."""
    now, was = read_text(path, max_bytes)
    if now == new and was is not None:
        return
    if now != old:
        raise Refused(f"{path} was changed from outside and is left as it is")
    replace(path, new, was)


def recover(target: Path) -> bool:
    """Finishes the transaction that is pending for a target; whether there was one.

    Every step can be repeated.  What was removed is in the archive before
    the target changes.
    """
    side = side_files(target)
    raw, was = read_text(side["pending"], K.MAX_PENDING_BYTES)
    if was is None:
        return False
    t = Transaction.from_json(raw, target.name)
    backup = target.parent / t.backup
    kept, there = read_text(backup)
    if there is None:
        replace(backup, t.original, None)
    elif kept != t.original:
        raise Refused(f"{backup} holds something else")
    if t.archive:
        append_once(side["archive"], "archive: removed entries, with reasons", t.tx, t.archive, K.MAX_SIDE_BYTES)
    _commit(target, t.original, t.new_text, K.MAX_FILE_BYTES)
    append_once(side["journal"], "journal of consolidations", t.tx, t.report, K.MAX_JOURNAL_BYTES, rotate=True)
    _commit(side["state"], t.state_before, t.state_after, K.MAX_SIDE_BYTES)
    remove(side["pending"], was)
    return True


def apply(target: Path, t: Transaction) -> None:
    """Writes a run: first the pending record, then by the same way as after a crash."""
    side = side_files(target)
    for name, limit in SIDE_LIMITS.items():
        read_text(side[name], limit)
    record = t.to_json()
    if len(record.encode()) > K.MAX_PENDING_BYTES:
        raise Refused("the transaction is too large")
    replace(side["pending"], record, None)
    recover(target)


def apply_unchanged(target: Path, t: Transaction) -> None:
    """A run that changes nothing still counts: journal and state."""
    side = side_files(target)
    append_once(side["journal"], "journal of consolidations", t.tx, t.report, K.MAX_JOURNAL_BYTES, rotate=True)
    _commit(side["state"], t.state_before, t.state_after, K.MAX_SIDE_BYTES)
