"""State of an index on a shared file system: manifest, pending marker, lock, atomic swap."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import re
import tempfile
from collections.abc import Iterator

SCHEMA = 2
ACTIVE, PENDING, LOCK = "active_index.json", "build_in_progress.json", ".index.lock"
_COLLECTION = re.compile(r"gen_[a-f0-9]{32}")


def read_json(path: str) -> dict | None:
    """An object, or None where there is no file. Links and other values are errors, and so is broken JSON."""
    if os.path.islink(path):
        raise ValueError(f"refusing a link: {path}")
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        value = json.load(f)
    if not isinstance(value, dict):
        raise ValueError(f"not an object: {path}")
    return value


def atomic_json(path: str, value: dict) -> None:
    """Readers see the old or the new object, never part of one."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".tmp-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, sort_keys=True)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        with contextlib.suppress(OSError):
            os.unlink(temporary)
        raise


def active_index(db: str) -> dict | None:
    """The validated manifest, or None. The file list itself stays in the generation's ``files`` table."""
    m = read_json(os.path.join(db, ACTIVE))
    if m is None:
        return None
    ok = (
        m.get("schema") == SCHEMA
        and isinstance(m.get("repo_dir"), str)
        and isinstance(m.get("collection"), str)
        and _COLLECTION.fullmatch(m["collection"])
        and isinstance(m.get("fingerprint"), dict)
        and type(m.get("chunks")) is int
        and m["chunks"] >= 0
    )
    if not ok:
        raise ValueError("the manifest is not valid")
    return m


def holds_other_data(db: str) -> bool:
    """Whether the folder has files although no index was ever made or begun in it."""
    if not os.path.isdir(db):
        return False
    own = {ACTIVE, PENDING, LOCK, "generations"}
    return any(name not in own and not name.startswith(".tmp-") for name in os.listdir(db))


def validate_owner(db: str, repo: str) -> None:
    for name in (ACTIVE, PENDING):
        m = read_json(os.path.join(db, name))
        if m is not None and m.get("repo_dir") != repo:
            raise ValueError("the index belongs to another repository")


def validate_location(db: str, repo: str) -> None:
    db, repo = os.path.abspath(db), os.path.abspath(repo)
    if os.path.commonpath([db, repo]) == repo:
        raise ValueError("the index must lie outside the repository")
    step = db
    while True:
        if os.path.islink(step):
            raise ValueError("the index path contains a link")
        if os.path.dirname(step) == step:
            return
        step = os.path.dirname(step)


@contextlib.contextmanager
def operation_lock(db: str, create: bool) -> Iterator[None]:
    """One operation at a time: fails at once if another process holds the lock."""
    path = os.path.join(db, LOCK)
    if not create and not os.path.exists(path):
        if os.path.isdir(db) and os.listdir(db):
            raise RuntimeError("the index has no operation lock; build it first")
        yield
        return
    if create:
        os.makedirs(db, mode=0o700, exist_ok=True)
    handle = os.open(path, os.O_RDWR | (os.O_CREAT if create else 0) | os.O_NOFOLLOW, 0o600)
    try:
        try:
            fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            raise RuntimeError("the index is busy") from None
        yield
    finally:
        os.close(handle)
