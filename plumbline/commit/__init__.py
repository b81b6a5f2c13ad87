"""Writers: one committer on the driver, a lock for each mine, all or nothing."""

from __future__ import annotations

import contextlib
import os
import shutil
import uuid


class Refusal(Exception):
    """A write that is not allowed; nothing was changed."""


@contextlib.contextmanager
def single_writer(root: str):
    """The mine's lock. A second writer is refused, not queued; readers are never held up; a stale lock is for a human to remove."""
    if "://" in root:
        raise Refusal("mines are written on this machine only")
    place, nonce = os.path.join(root, ".writer-lock"), uuid.uuid4().hex
    try:
        os.mkdir(place)
    except FileExistsError:
        raise Refusal("another writer holds the lock, or left it behind") from None
    with open(os.path.join(place, "owner"), "w") as f:
        f.write(nonce)
    try:
        yield nonce
    finally:
        with contextlib.suppress(OSError):
            with open(os.path.join(place, "owner")) as f:
                mine = f.read() == nonce
            if mine:
                shutil.rmtree(place)


def guarded(root: str, *parts: str) -> str:
    """The place of a file inside the mine; refuses a way out of it and symbolic links."""
    place = os.path.join(root, *parts)
    base = os.path.realpath(root)
    if os.path.commonpath([base, os.path.realpath(place)]) != base:
        raise Refusal(f"{place} is outside the mine")
    at = root
    for part in os.path.relpath(place, root).split(os.sep):
        at = os.path.join(at, part)
        if os.path.islink(at):
            raise Refusal(f"{at} is a symbolic link")
    return place


def replace_all(changes: dict[str, bytes], move=os.replace) -> None:
    """Writes all files or none: each is staged beside its place, then moved; a failed move takes the earlier ones back."""
    staged = {place: f"{place}.{uuid.uuid4().hex}.new" for place in changes}
    before: dict[str, bytes | None] = {}
    try:
        for place, data in changes.items():
            os.makedirs(os.path.dirname(place), exist_ok=True)
            with open(staged[place], "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
        for place in changes:
            old = None
            if os.path.lexists(place):
                with open(place, "rb") as f:
                    old = f.read()
            move(staged[place], place)
            before[place] = old
    except BaseException:
        for place, old in before.items():
            if old is None:
                os.unlink(place)
            else:
                with open(place, "wb") as f:
                    f.write(old)
        raise
    finally:
        for place in staged.values():
            with contextlib.suppress(OSError):
                os.unlink(place)


def append_lines(place: str, lines: list[str], header: str = "", write=None) -> None:
    """Appends whole lines or nothing; refuses a file whose last line has no end. What was there is not read or written again.

    If a write lands in part, the file is cut back to its old size, and that it
    is so long again is made sure of. ``write(file, data)`` does the writing.
    """
    new = "".join(line + "\n" for line in lines).encode("utf-8", "surrogateescape")
    if not os.path.lexists(place):
        replace_all({place: header.encode() + new})
        return
    if not os.path.isfile(place):
        raise Refusal(f"{place} is no file")
    with open(place, "r+b", buffering=0) as f:
        size = f.seek(0, os.SEEK_END)
        if size:
            f.seek(size - 1)
            if f.read(1) != b"\n":
                raise Refusal(f"{place} ends in a torn line")
        try:
            done = (write or (lambda file, data: file.write(data)))(f, new)
            if done != len(new):
                raise OSError(f"{done} of {len(new)} bytes were written to {place}")
            os.fsync(f.fileno())
        except BaseException as e:
            f.truncate(size)
            os.fsync(f.fileno())
            if os.fstat(f.fileno()).st_size != size:
                raise Refusal(f"{place} could not be rolled back to {size} bytes") from e
            raise Refusal(f"{place} was rolled back: {e}") from e
