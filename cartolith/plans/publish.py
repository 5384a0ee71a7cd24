"""All-or-nothing publication: staged beside the destination, then given its name if nothing has it."""

from __future__ import annotations

import os
import shutil
import uuid

from ..errors import EdgeError


def preflight(path: str, limit: int | None = None) -> int:
    """Bytes of a file or tree; links anywhere in it are refused, and so is more than ``limit``."""
    def refuse_link(p: str) -> None:
        if os.path.islink(p):
            raise EdgeError("FORMAT", "symbolic links are not followed", phase="open")

    refuse_link(path)
    if not os.path.exists(path):
        raise EdgeError("NOT_FOUND", "there is nothing at this path", phase="open")
    total = 0
    if os.path.isfile(path):
        total = os.lstat(path).st_size
    else:
        for folder, names, files in os.walk(path):
            for name in (*names, *files):
                refuse_link(os.path.join(folder, name))
            total += sum(os.lstat(os.path.join(folder, f)).st_size for f in files)
    if limit is not None and total > limit:
        raise EdgeError("LIMIT", "the input is larger than its limit", category="resource", phase="open")
    return total


class Stage:
    """A place beside ``target`` to write to. ``publish`` gives it the target's name; leaving without it removes it."""

    def __init__(self, target: str, limit: int | None = None) -> None:
        self.target, self.limit = os.path.abspath(target.rstrip("/")), limit
        self.path = os.path.join(os.path.dirname(self.target), f".{os.path.basename(self.target)}.{uuid.uuid4().hex}.part")

    def __enter__(self) -> Stage:
        if os.path.lexists(self.target):
            raise EdgeError("EXISTS", "the destination exists", category="conflict", phase="publish")
        return self

    def publish(self) -> dict:
        size = preflight(self.path, self.limit)
        for folder, _, names in os.walk(self.path) if os.path.isdir(self.path) else [(os.path.dirname(self.path), [], [os.path.basename(self.path)])]:
            for name in names:  # what is published is on the disk before it has its name
                with open(os.path.join(folder, name), "rb") as f:
                    os.fsync(f.fileno())
        if os.path.isdir(self.path):
            try:
                os.mkdir(self.target)  # takes the name or fails; a rename then replaces the empty folder at once
                os.rename(self.path, self.target)
            except FileExistsError:
                raise EdgeError("EXISTS", "the destination exists", category="conflict", phase="publish") from None
        else:
            try:
                os.link(self.path, self.target)  # never replaces
            except FileExistsError:
                raise EdgeError("EXISTS", "the destination exists", category="conflict", phase="publish") from None
            os.unlink(self.path)
        try:
            folder = os.open(os.path.dirname(self.target), os.O_RDONLY)
            os.fsync(folder)
            os.close(folder)
        except OSError:
            return {"bytes": size, "outcome": "durability_unconfirmed"}
        return {"bytes": size, "outcome": "published"}

    def __exit__(self, *_) -> None:
        if os.path.isdir(self.path):
            shutil.rmtree(self.path, ignore_errors=True)
        elif os.path.lexists(self.path):
            os.unlink(self.path)


def publish_set(stages: list[Stage]) -> dict:
    """Publish loose files that belong together, the main one last; if one can't be, those before are taken back."""
    done: list[Stage] = []
    try:
        results = []
        for stage in stages:
            results.append(stage.publish())
            done.append(stage)
        return {"bytes": sum(r["bytes"] for r in results), "outcome": max((r["outcome"] for r in results), key=["published", "durability_unconfirmed"].index)}
    except EdgeError:
        for stage in done:
            os.unlink(stage.target)
        raise
